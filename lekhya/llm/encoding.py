"""Problem 2: text garbled by decoding UTF-8 with an unknown single-byte code page.

Each wrong code page is a substitution cipher. A Devanagari letter is three bytes in UTF-8, so under any such page
it becomes three symbols of which the first is always the same; that symbol names the source of the garbling.
For each source the counts of neighbouring letter symbols are gathered over all rows (a table bounded by the square
of the alphabet), and expectation-maximization against the letter bigrams of clean text finds which symbol stands for
which letter, hence for which byte. With these bytes known, expectation-maximization against the bigrams of all other
characters finds the bytes that lead accented Latin letters and punctuation marks, and symbols that no Devanagari
letter has; text garbled twice is text in these letters too. The mappings are applied with translate(), twice for
text that was garbled twice.

Published code pages are one more starting point of the first expectation-maximization, which is taken only if it
ends at a greater likelihood; beyond that they serve only symbols of which nothing was learned, where a page agrees
with what was learned. Without any page the same sources are found (see the tests). Of a leading symbol with fewer
than min_runs garbled words nothing can be learned; it is a source if a published page reads all of them.

Nulls are never garbled. Empty texts and empty tables give no rows. A record counts as garbled if it has a
replacement character (U+FFFD) or a symbol sequence that is a Devanagari letter, an accented Latin letter or a
punctuation mark under one of the sources; foreign words that are right as they stand have none. Texts of any
length are read whole; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from encodings.aliases import aliases
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhya.llm.run import cut

RUN = r"[^\x00-\x7Fऀ-ॿ]+"
#: UTF-8 sequences, as Latin-1 characters, that show garbling.
DEVANAGARI = "\\u00E0[\\u00A4\\u00A5][\\u0080-\\u00BF]"
PUNCTUATION = "\\u00E2(?:\\u0080[\\u0090-\\u00BF]|\\u0082\\u00AC|\\u0084\\u00A2)"
LATIN = "(?:\\u00C2[\\u00A0-\\u00BF]|[\\u00C3-\\u00C5][\\u0080-\\u00BF])"
#: Weight, in letters, of a published page against what is seen.
TIE = 2.0
#: Letters of the Devanagari block, then the word boundary.
LETTERS = 128


def _single_byte_pages() -> dict[str, dict[str, int]]:
    """Published single-byte code pages that keep ASCII: symbol to byte, for bytes from 0x80."""
    pages = {}
    for name in sorted(set(aliases.values()), key=lambda n: (n not in ("latin_1", "cp1252"), n)):
        try:
            if bytes(range(32, 127)).decode(name) != "".join(map(chr, range(32, 127))):
                continue
            table = {}
            for b in range(128, 256):
                try:
                    ch = bytes([b]).decode(name)
                except UnicodeDecodeError:
                    ch = chr(b)  # an undefined byte passes as the control character of that number
                if len(ch) != 1:
                    raise ValueError(name)
                table.setdefault(ch, b)
            pages[name] = table
        except (LookupError, ValueError, UnicodeError):
            continue
    return pages


@dataclass(frozen=True)
class Source:
    """A learned cipher: its leading symbol, symbol to byte, code pages that agree, number of runs seen."""

    lead: str
    table: dict[str, int]
    pages: tuple[str, ...]
    runs: int

    def translate(self, c: Column, spaces: bool = True) -> Column:
        """The text with each symbol replaced by the Latin-1 character of its byte.

        Symbols of Latin-1 that the cipher lacks become '?'. Without spaces, so does white space whose byte is
        another one than in Latin-1, as it may simply follow a letter."""
        items = {chr(b): "?" for b in range(128, 256)} | {s: chr(b) if spaces or not s.isspace() or ord(s) == b else "?" for s, b in self.table.items()}
        return F.translate(c, "".join(items), "".join(items.values()))


def runs(texts: DataFrame) -> DataFrame:
    """Distinct runs of characters beyond ASCII and Devanagari with their counts. texts: column t."""
    odd = texts.where(F.col("t").rlike(RUN)).select(F.explode(F.regexp_extract_all("t", F.lit(f"({RUN})"), F.lit(1))).alias("run"))
    return odd.groupBy("run").agg(F.count("*").alias("n"))


def cipher_words(distinct_runs: DataFrame) -> DataFrame:
    """lead, n, p: runs that are whole Devanagari words under some page; p are the letters' second and third symbols,
    with '' at both ends."""
    letters = F.expr("transform(sequence(0, cast(length(run) / 3 as int) - 1), i -> substring(run, 3 * i + 1, 3))")
    word = distinct_runs.where("length(run) >= 6 and length(run) % 3 = 0").select("n", F.substring("run", 1, 1).alias("lead"), letters.alias("ls"))
    return word.where("forall(ls, x -> startswith(x, lead))").select("n", "lead", F.expr("concat(array(''), transform(ls, x -> substring(x, 2, 2)), array(''))").alias("p"))


def leads(words: DataFrame, min_runs: int, published: list[str]) -> dict[str, tuple[int, list[str]]]:
    """Leading symbols with their number of words and their two most frequent second symbols.

    Judged on the cluster, so that only as many rows come here as there are ciphers: two second symbols make up nine
    tenths of a cipher's letters. A lead of fewer than min_runs words is kept only if a published page has it."""
    per = words.select("lead", "n", F.explode(F.filter("p", lambda x: x != "")).alias("x")).groupBy("lead", F.substring("x", 1, 1).alias("s")).agg(F.sum("n").alias("n"))
    top = per.groupBy("lead").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "s"))), 1, 2).alias("top"))
    whole = words.groupBy("lead").agg(F.sum("n").alias("words"))
    kept = top.join(whole, "lead").where((F.aggregate("top", F.lit(0).cast("long"), lambda a, t: a - t["k"]) >= 0.9 * F.col("n")) & ((F.col("words") >= min_runs) | F.col("lead").isin(published)))
    return {r["lead"]: (r["words"], [t["s"] for t in r["top"]]) for r in kept.collect()}


def cipher_counts(words: DataFrame, lead: list[str]) -> list:
    """(lead, symbol pair, next symbol pair, count) of these leads: at most sources times letters squared."""
    pair = words.where(F.col("lead").isin(lead)).select("n", "lead", F.explode(F.expr("transform(sequence(0, size(p) - 2), i -> struct(p[i] as a, p[i + 1] as b))")).alias("x"))
    return pair.groupBy("lead", "x.a", "x.b").agg(F.sum("n").alias("n")).collect()


def letter_bigrams(texts: DataFrame) -> np.ndarray:
    """Smoothed joint probability of neighbouring Devanagari letters, of words of texts without odd characters; the last
    index is the edge."""
    words = texts.where(~F.col("t").rlike(RUN)).select(F.explode(F.regexp_extract_all("t", F.lit(r"([ऀ-ॿ]+)"), F.lit(1))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    edged = words.select("n", F.expr("transform(split(concat('#', w, '#'), ''), c -> ascii(c))").alias("c"))
    pair = edged.select("n", F.explode(F.expr("transform(sequence(0, size(c) - 2), i -> struct(c[i] as a, c[i + 1] as b))")).alias("x"))
    counts = np.full((LETTERS + 1, LETTERS + 1), 0.01)
    for r in pair.groupBy("x.a", "x.b").agg(F.sum("n").alias("n")).collect():
        a, b = (LETTERS if v == ord("#") else v - 0x900 for v in (r["a"], r["b"]))
        if 0 <= a <= LETTERS and 0 <= b <= LETTERS:
            counts[a, b] += r["n"]
    return counts / counts.sum()


def expectation_maximization(bigrams: np.ndarray, seen: np.ndarray, allowed: np.ndarray, prior: np.ndarray | float = 0.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """P(symbol | letter) that makes the seen counts of neighbouring symbols most likely, and their log likelihood.

    The last letter and the last symbol are the edge. allowed: whether a letter may be a symbol at all; prior: counts
    by letter and symbol that are added to what is seen."""
    fl, fs = bigrams.sum(1), np.maximum(seen.sum(1), 1e-9) / max(seen.sum(), 1e-9)
    allowed = allowed.copy()
    allowed[-1, :] = False
    allowed[:, -1] = False
    edge = np.zeros(allowed.shape)
    edge[-1, -1] = 1  # edges are seen as such
    emit = (np.exp(-np.abs(np.log(np.maximum(fl, 1e-12))[:, None] - np.log(fs)[None, :])) + 50 * prior) * allowed + edge
    for _ in range(rounds):
        emit /= np.maximum(emit.sum(1, keepdims=True), 1e-300)
        ratio = seen / np.maximum(emit.T @ bigrams @ emit, 1e-300)
        emit = (emit * (bigrams @ emit @ ratio.T + bigrams.T @ emit @ ratio) + prior + 1e-6) * allowed + edge
    emit /= np.maximum(emit.sum(1, keepdims=True), 1e-300)
    return emit, float((seen * np.log(np.maximum(emit.T @ bigrams @ emit, 1e-300))).sum())


def _solve(rows: list, bigrams: np.ndarray, fitting: list[dict[str, int]]) -> dict[str, dict[int, float]]:
    """Symbol to byte to weight, of a source's second and third symbols.

    Published pages are one hypothesis beside the one learned freely. It is kept unless the free one explains the
    counts better by more than its number of parameters makes likely (Bayesian information criterion), and even
    then a symbol seen often enough departs from the page."""
    symbols = sorted({p for r in rows for p in (r["a"], r["b"]) if p})
    at = {p: i for i, p in enumerate(symbols)} | {"": len(symbols)}
    seen = np.zeros((len(at), len(at)))
    for r in rows:
        seen[at[r["a"]], at[r["b"]]] += r["n"]
    hints = np.zeros((LETTERS + 1, len(at)))
    for page in fitting:
        for p in symbols:
            second, third = page.get(p[0], 0), page.get(p[1], 0)
            if second in (0xA4, 0xA5) and 0x80 <= third < 0xC0:
                hints[(second - 0xA4) * 64 + third - 0x80, at[p]] = TIE
    allowed = np.ones(hints.shape, dtype=bool)
    emit, free = expectation_maximization(bigrams, seen, allowed)
    if hints.any():
        by_page, bound = expectation_maximization(bigrams, seen, allowed, hints)
        if bound >= free - 0.5 * len(symbols) * np.log(max(seen.sum(), 2)):
            emit = by_page
    # P(letter | pair), then the byte of each symbol by the letters that its pairs stand for
    joint = emit * bigrams.sum(1)[:, None]
    votes: dict[str, dict[int, float]] = {}
    for p in symbols:
        post, n = joint[:-1, at[p]] / max(joint[:-1, at[p]].sum(), 1e-300), seen[:, at[p]].sum()
        for k in np.nonzero(post > 0.01)[0]:
            for sym, byte in ((p[0], 0xA4 + int(k) // 64), (p[1], 0x80 + int(k) % 64)):
                held = votes.setdefault(sym, {})
                held[byte] = held.get(byte, 0.0) + n * post[k]
    return votes


#: Characters that the second expectation-maximization may find beside the symbols of the sources themselves: Latin
#: letters and signs, spacing modifiers, general punctuation, currency and letterlike signs.
OTHER = (range(0xA0, 0x180), range(0x2C0, 0x2E0), range(0x2000, 0x2070), range(0x20A0, 0x20C0), range(0x2100, 0x2150))


def _class(symbols: str) -> str:
    return "".join(f"\\x{{{ord(c):X}}}" for c in symbols)


def other_bigrams(distinct_runs: DataFrame, symbols: str) -> tuple[list[str], np.ndarray]:
    """The characters of OTHER that stand by themselves in some text and the symbols given, with the joint probability
    of neighbours; the last index is the edge."""
    alphabet = "".join(chr(c) for r in OTHER for c in r)
    alone = [r["run"] for r in distinct_runs.where((F.length("run") == 1) & F.contains(F.lit(alphabet), F.col("run"))).select("run").collect()]
    letters = sorted({*alone, *symbols})
    cs = distinct_runs.select("n", F.expr("concat(array(''), split(run, ''), array(''))").alias("c"))
    pair = cs.select("n", F.explode(F.expr("transform(sequence(0, size(c) - 2), i -> struct(c[i] as a, c[i + 1] as b))")).alias("x"))
    known = lambda c: F.when(F.contains(F.lit("".join(letters)), c), c).otherwise("")
    at = {c: i for i, c in enumerate(letters)} | {"": len(letters)}
    counts = np.full((len(at), len(at)), 1e-3)
    for r in pair.groupBy(known(F.col("x.a")).alias("a"), known(F.col("x.b")).alias("b")).agg(F.sum("n").alias("n")).collect():
        counts[at[r["a"]], at[r["b"]]] += r["n"]
    return letters, counts / counts.sum()


def _occurrences(distinct_runs: DataFrame, symbols: list[str]) -> dict[str, int]:
    if not symbols:
        return {}
    one = distinct_runs.select("n", F.explode(F.split("run", "")).alias("s")).where(F.col("s").isin(symbols))
    return {r["s"]: r["n"] for r in one.groupBy("s").agg(F.sum("n").alias("n")).collect()}


def _units(distinct_runs: DataFrame, pattern: str) -> list:
    """(unit, next unit, count) of what the pattern finds in the runs, '' at the ends."""
    us = distinct_runs.select("n", F.regexp_extract_all("run", F.lit(f"({pattern})"), F.lit(1)).alias("u")).where("size(u) > 0").select("n", F.expr("concat(array(''), u, array(''))").alias("u"))
    pair = us.select("n", F.explode(F.expr("transform(sequence(0, size(u) - 2), i -> struct(u[i] as a, u[i + 1] as b))")).alias("x"))
    return pair.groupBy("x.a", "x.b").agg(F.sum("n").alias("n")).collect()


def _extend(table: dict[str, int], distinct_runs: DataFrame, pattern: str, letters: list[str], bigrams: np.ndarray, page: dict[str, int]) -> dict[str, int]:
    """The table with the symbols that units of other characters (what the pattern finds) show.

    A unit may stand for a letter of as many UTF-8 bytes, of which those of known symbols agree. A lead's units are
    all of one length; one of which less than four fifths can stand for any letter, or that mostly stands outside
    units, is ordinary text, and of several symbols for one leading byte the most frequent has it. Where several
    letters remain, page breaks the tie."""
    rows = _units(distinct_runs, pattern)
    units = sorted({u for r in rows for u in (r["a"], r["b"]) if u})
    if not units or not letters:
        return table
    at = {u: i for i, u in enumerate(units)} | {"": len(units)}
    seen = np.zeros((len(at), len(at)))
    for r in rows:
        seen[at[r["a"]], at[r["b"]]] += r["n"]
    taken, raw = set(table.values()), [c.encode() for c in letters]
    allowed = np.zeros((len(letters) + 1, len(at)), dtype=bool)
    for j, u in enumerate(units):
        for i, b in enumerate(raw):
            allowed[i, j] = len(b) == len(u) and all(table[s] == x if s in table else (x not in taken or page.get(s) == x) and (x >= 0xC0) == (k == 0) for k, (s, x) in enumerate(zip(u, b)))
        tie = [i for i, b in enumerate(raw) if allowed[i, j] and all(table.get(s, page.get(s)) == x for s, x in zip(u, b))]
        if tie:
            allowed[:, j] = False
            allowed[tie, j] = True
    emit, _ = expectation_maximization(bigrams, seen, allowed)
    joint = emit * bigrams.sum(1)[:, None]
    n, can = seen[:, :-1].sum(0), allowed[:-1, :-1].any(0)
    total: dict[str, dict[int, list[float]]] = {}
    for j, u in enumerate(units):
        t = total.setdefault(u[0], {2: [0.0, 0.0], 3: [0.0, 0.0]})[len(u)]
        t[0] += n[j]
        t[1] += n[j] * can[j]
    # a third symbol that isn't known yet leaves a unit of two, so units of three that can be letters count for more
    length = {s: 3 if t[3][1] >= 0.2 * t[2][0] and t[3][1] else 2 for s, t in total.items()}
    held = _occurrences(distinct_runs, sorted(s for s, t in total.items() if s not in table and t[length[s]][1] >= 2))
    support: dict[str, float] = {}
    lead_of: dict[int, tuple[float, str]] = {}
    new: dict[str, int] = {}
    used: set[int] = set()
    for j in sorted(range(len(units)), key=lambda j: (-n[j], units[j])):
        u = units[j]
        whole, good = total[u[0]][length[u[0]]]
        if not can[j] or not (n[j] >= 2 if u[0] in table else len(u) == length[u[0]] and good >= max(2, 0.8 * whole, 0.15 * held.get(u[0], 0))):
            continue
        order = np.argsort(-joint[:-1, j] * allowed[:-1, j], kind="stable")[: int(allowed[:-1, j].sum())]
        # two symbols seldom have one byte (only where two pages share a lead), so others come first
        fits = [i for i in order if all(new.get(s, x) == x for s, x in zip(u, raw[i]))]
        free = [i for i in fits if all(s in table or s in new or x not in used or page.get(s) == x for s, x in zip(u, raw[i]))]
        if not fits:
            continue
        for s, x in zip(u, raw[(free or fits)[0]]):
            if s not in table:
                new[s] = x
                used.add(x)
                support[s] = support.get(s, 0.0) + n[j]
    for s, x in new.items():
        if x >= 0xC0:
            lead_of[x] = max(lead_of.get(x, (0.0, "")), (support[s], s))
    return table | {s: x for s, x in new.items() if x < 0xC0 or lead_of[x][1] == s}


def learn(texts: DataFrame, min_runs: int = 5, published: dict[str, dict[str, int]] | None = None) -> list[Source]:
    """The sources of garbling in the texts (column t), most frequent first.

    min_runs: a leading symbol with fewer whole garbled words is no source, unless they read as Devanagari throughout
    under some published page. published: code pages, symbol to byte; those that Python has where None."""
    pages = _single_byte_pages() if published is None else published
    distinct_runs = cut(runs(texts))
    words = cipher_words(distinct_runs)
    found, tables = [], []
    kept = leads(words, min_runs, sorted({c for t in pages.values() for c, b in t.items() if b == 0xE0}))
    if not kept:
        return []
    by_lead: dict[str, list] = {}
    for r in cipher_counts(words, sorted(kept)):
        by_lead.setdefault(r["lead"], []).append(r)
    bigrams = letter_bigrams(texts)
    for lead, (n_words, second) in sorted(kept.items()):
        rows = [r for r in by_lead[lead] if all(p == "" or p[0] in second for p in (r["a"], r["b"]))]
        fitting = [n for n, t in pages.items() if t.get(lead) == 0xE0]
        reads = [n for n in fitting if all(pages[n].get(p[0]) in (0xA4, 0xA5) and 0x80 <= pages[n].get(p[1], 0) < 0xC0 for r in rows for p in (r["a"], r["b"]) if p)]
        if n_words < min_runs and not reads:
            continue
        votes = _solve(rows, bigrams, [pages[n] for n in fitting])
        table = {lead: 0xE0} | {s: max(v, key=v.get) for s, v in votes.items()}
        agree = {n: sum(sum(votes[s].values()) for s in votes if pages[n].get(s) == table[s]) for n in fitting}
        total = sum(sum(v.values()) for v in votes.values())
        # pages in order of agreement; another is added only for symbols that the ones before it don't have
        named, known = [], {}
        for n in sorted(fitting, key=lambda n: -agree[n]):
            new = {s for s in votes if s not in known and pages[n].get(s) == table[s]}
            if (not named and agree[n] >= 0.5 * total) or (named and new):
                named.append(n)
                known = pages[n] | known
        tables.append((lead, table, known, tuple(named), int(n_words)))
    tables.sort(key=lambda t: (-t[4], t[0]))
    # runs with letters of another source are that one's
    belongs = {lead: f"{_class(lead)}[{_class(''.join(s for s, b in t.items() if b in (0xA4, 0xA5)))}]" for lead, t, _, _, _ in tables}
    for lead, table, known, named, n in tables:
        other = "|".join(x for k, x in belongs.items() if k != lead)
        own = distinct_runs.where(~F.col("run").rlike(other)) if other else distinct_runs
        letters, others = other_bigrams(own, "".join(table))
        rest = _class("".join(s for s, b in table.items() if b < 0xC0))
        table = _extend(table, own, f"[^{rest}{_class(lead)}][{rest}]{{1,2}}(?=$|[^{rest}][{rest}])", letters, others, known)
        # now with the leads known: symbols in a continuation's place that no Devanagari letter has
        rest = _class("".join(s for s, b in table.items() if b < 0xC0))
        two, three = (_class("".join(s for s, b in table.items() if lo <= b < hi)) for lo, hi in ((0xC2, 0xE0), (0xE1, 0xF0)))
        new = [p for p in (f"[{two}][^{two}{three}]" if two else "", f"[{three}][{rest}][^{two}{three}]" if three else "") if p]
        if new:
            table = _extend(table, own, "|".join(new), letters, others, known)
            rest = _class("".join(s for s, b in table.items() if b < 0xC0))
            belongs[lead] = "|".join([belongs[lead], *(p for p in (f"[{two}][{rest}]" if two else "", f"[{three}][{rest}]{{2}}" if three else "") if p)])
        # nothing was learned of a symbol: the agreeing page has it
        found.append(Source(lead, known | table, named, n))
    return sorted(found, key=lambda s: (-s.runs, s.lead))


def damaged(c: Column, sources: list[Source]) -> Column:
    """Whether the text holds garbled characters."""
    tests = [F.contains(c, F.lit("�"))]
    for s in sources:
        tests.append(s.translate(c).rlike(f"{DEVANAGARI}|{PUNCTUATION}"))
        tests.append(s.translate(c, spaces=False).rlike(LATIN))
    return F.coalesce(c.rlike(RUN) & reduce(lambda a, b: a | b, tests), F.lit(False))


def _decode(run: Column, sources: list[Source]) -> Column:
    """A run as it read before it was garbled, or null."""
    tries = []
    for s in sources:
        raw = s.translate(run)
        text = F.expr("try_validate_utf8(cast(b as string))")
        plain = F.when(raw.rlike("^[\\u0080-\\u00FF]+$") & raw.rlike(f"{DEVANAGARI}|{PUNCTUATION}|{LATIN}"), F.try_validate_utf8(F.encode(raw, "ISO-8859-1").cast("string")))
        tries.append(plain)
    return F.coalesce(*tries) if tries else F.lit(None).cast("string")


def restore(df: DataFrame, sources: list[Source], text: str = "t") -> DataFrame:
    """df with columns restored (the text with each run that could be undone put right) and restorable."""
    pieces = F.regexp_extract_all(text, F.lit(f"({RUN}|[\\x00-\\x7F\\u0900-\\u097F]+)"), F.lit(1))

    def mend(x: Column) -> Column:
        return F.coalesce(F.when(x.rlike(RUN), _decode(x, sources)), x)

    once = F.array_join(F.transform(pieces, mend), "")
    out = df.withColumn("_once", once)
    again = F.array_join(F.transform(F.regexp_extract_all("_once", F.lit(f"({RUN}|[\\x00-\\x7F\\u0900-\\u097F]+)"), F.lit(1)), mend), "")
    out = out.withColumn("restored", F.when(F.col(text) == "", "").otherwise(again)).drop("_once")
    return out.withColumn("restorable", ~damaged(F.col("restored"), sources))


def garbled(df: DataFrame, sources: list[Source], id_col: str, text: str) -> DataFrame:
    """The damaged records: row_id, text, restored, restorable."""
    rows = df.select(F.col(id_col).alias("row_id"), F.col(text).alias("text")).where("text is not null")
    return restore(rows.where(damaged(F.col("text"), sources)), sources, "text")


def sources_of(*columns: tuple[DataFrame, str]) -> list[Source]:
    """Learns the sources from several text columns together."""
    texts = [df.select(F.col(c).alias("t")).where("t is not null") for df, c in columns]
    return learn(reduce(DataFrame.unionAll, texts)) if texts else []
