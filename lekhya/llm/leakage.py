"""Problem 7: passages of held-out items in documents.

Q-gram lemma filtering. Texts are brought to plain characters (no case, punctuation, spacing, look-alikes). For
every item the character q-grams that few items share are kept, and from the item itself follows how many of them
the shortest passage that counts must still have after its allowed edits. Documents' q-grams are looked up in
blocks, hits are counted per item in overlapping bands of diagonals (document position minus item position), and
only regions whose band reaches that number are retained. Each is verified by an alignment of words in its own band
of diagonals, widened by what edits may shift.

A passage counts if at least MIN_WORDS consecutive words of the item, first and last matching, stand in the document
with at most one edit (word replaced, dropped or put in) per EDIT_PER words. Words written apart or together match.

Items are taken ITEM_BLOCK at a time, so that the index that is broadcast stays bounded however many there are; all
documents are searched for each block of items. Null or empty texts hold nothing. Items of fewer than MIN_WORDS words
count when held whole. Documents are read whole, each copy by itself; a very long one in windows that overlap by more
than the longest item. Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhya.llm.forms import LIGATURES, LOOKALIKE, SEQUENCES, same_words

Q, MIN_WORDS, EDIT_PER = 6, 10, 8
#: Width of a band of diagonals; bands overlap by half.
BAND = 48
#: A q-gram shared by more items than this isn't counted.
SHARED = 6
#: Items that are searched for at a time (by hash of the id, so about as many).
ITEM_BLOCK = 20_000
#: Characters that are searched at a time.
WINDOW = 2_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_FILTER_BITS = 22
_NOISE = re.compile(r"\[\d\d:\d\d(?::\d\d)?\]|^[A-Z]: ", re.M)


def _plain_table() -> np.ndarray:
    """Code point to plain code point, 0 where a character is left out; by Unicode category and decomposition."""
    table = np.zeros(0x10000, dtype=np.uint16)
    look = dict(LOOKALIKE)
    for c in range(0x10000):
        ch = unicodedata.normalize("NFKD", look.get(chr(c), chr(c)))[:1]
        kind = unicodedata.category(ch)
        if kind[0] in "LN" or (0x900 <= c < 0x980 and kind[0] == "M" and c != 0x93C):
            low = ch.lower()[:1]
            table[c] = ord(look.get(low, low)) & 0xFFFF
    return table


_TABLE = _plain_table()
_FIRST, _SECOND = (np.zeros(0x10000, dtype=bool) for _ in "ab")
for _a, _b in SEQUENCES:
    _FIRST[ord(_a[0])] = _SECOND[ord(_a[1])] = True


def plain(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Plain characters of all texts in a row, and the number of each one's text."""
    big = "\n".join(texts)
    for a, b in LIGATURES:
        if a in big:
            texts = [t.replace(a, b) for t in texts]
            big = "\n".join(texts)
    codes = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    text = np.repeat(np.arange(len(texts)), lengths)[: len(codes)]
    out = _TABLE[np.where(codes < 0x10000, codes, 0)]
    keep = out > 0
    out, text = out[keep], text[keep]
    at = np.nonzero(_FIRST[out[:-1]] & _SECOND[out[1:]] & (text[:-1] == text[1:]))[0] if len(out) > 1 else []
    if len(at):
        drop = np.zeros(len(out), dtype=bool)
        out = out.copy()
        for a, b in SEQUENCES:
            hit = at[(out[at] == ord(a[0])) & (out[at + 1] == ord(a[1]))]
            out[hit] = ord(b)
            drop[hit + 1] = True
        out, text = out[~drop], text[~drop]
    return out, text


def grams(codes: np.ndarray) -> np.ndarray:
    """Hash of the Q characters from each position."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    c = codes.astype(np.uint64)
    h = c[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, Q):
            h *= np.uint64(_BASE)
            h += c[k : k + n]
        h *= np.uint64(_BASE)
    return h ^ (h >> np.uint64(29))


class Items:
    """Index of the held-out items."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        rows = [(i, t) for i, t in rows if t and same_words(t)]
        self.ids = [i for i, _ in rows]
        self.words = [same_words(t) for _, t in rows]
        codes, text = plain([" ".join(w) for w in self.words])
        h = grams(codes)
        text_h = text[: len(h)]
        ok = text_h == text[Q - 1 :] if len(h) else np.zeros(0, dtype=bool)
        start = np.searchsorted(text, np.arange(len(rows)))
        pos = np.arange(len(h)) - start[text_h] if len(h) else np.zeros(0, int)
        h, item, pos = h[ok], text_h[ok], pos[ok]
        holders = pd.DataFrame({"h": h, "i": item}).drop_duplicates().groupby("h").size()
        few = holders.reindex(h).to_numpy() <= SHARED if len(h) else np.zeros(0, dtype=bool)
        # the items' words in plain characters: where each begins, all items in a row
        flat = [x for w in self.words for x in w]
        of = np.repeat(np.arange(len(rows)), list(map(len, self.words))) if rows else np.zeros(0, int)
        size = np.bincount(plain(flat)[1], minlength=len(flat)) if flat else np.zeros(0, int)
        cut = np.searchsorted(of, np.arange(len(rows) + 1))
        self.ends = [np.concatenate(([0], np.cumsum(size[a:b]))) for a, b in zip(cut, cut[1:])]
        by_item = np.searchsorted(item, np.arange(len(rows) + 1))  # q-grams stand in order of their items
        places = [pos[a:b] for a, b in zip(by_item, by_item[1:])]
        self.pairs: list[dict[tuple[str, str], list[int]]] = []
        for w in self.words:
            own: dict[tuple[str, str], list[int]] = {}
            for x, p in enumerate(zip(w, w[1:])):
                own.setdefault(p, []).append(x)
            self.pairs.append(own)
        self.need = np.array([self._need(k, p[few[a:b]]) for k, (p, a, b) in enumerate(zip(places, by_item, by_item[1:]))], dtype=np.int64)
        scarce = np.nonzero(self.need < 2)[0]
        weak = np.isin(item, scarce)  # too few rare q-grams: all of them are counted
        use = few | weak
        for k in scarce:
            self.need[k] = max(1, self._need(k, places[k]))
        order = np.argsort(h[use], kind="stable")
        self.h, self.item, self.pos = h[use][order], item[use][order].astype(np.int32), pos[use][order].astype(np.int64)
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[(self.h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def _need(self, k: int, positions: np.ndarray) -> int:
        """The fewest counted q-grams left in any shortest passage of the item after its edits."""
        ends = self.ends[k]
        n, best = len(self.words[k]), 10**9
        has = np.zeros(int(ends[-1]) + 1, dtype=np.int64)
        has[positions[positions < len(has)]] = 1
        total = np.concatenate(([0], np.cumsum(has)))

        def count(a: int, b: int) -> int:  # q-grams inside characters a..b
            return int(total[b - Q + 1] - total[a]) if b - a >= Q else 0

        w = min(n, MIN_WORDS)
        for s in range(n - w + 1):
            a, b = int(ends[s]), int(ends[s + w])
            if w // EDIT_PER == 0:
                best = min(best, count(a, b))
            for e in range(s, s + w) if w // EDIT_PER else ():
                best = min(best, count(a, int(ends[e])) + count(int(ends[e + 1]), b))
        return best

    def candidates(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item, from, to): ranges of diagonals whose bands reach the item's number of q-grams."""
        codes, text = plain(texts)
        h = grams(codes)
        if not len(h) or not len(self.h):
            return []
        at = np.nonzero(self.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])[0]
        at = at[text[at] == text[at + Q - 1]]
        lo, hi = np.searchsorted(self.h, h[at], "left"), np.searchsorted(self.h, h[at], "right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        if not len(at):
            return []
        flat = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        item, doc = self.item[flat], text[np.repeat(at, n)]
        # regions can only come from pairs that reach the number over the whole text
        both = doc * len(self.ids) + item
        if len(texts) * len(self.ids) <= 1 << 22:
            total = np.bincount(both, minlength=1)[both]
        else:
            _, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
            total = counts[inverse]
        keep = total >= self.need[item]
        flat, item, doc, spot = flat[keep], item[keep], doc[keep], np.repeat(at, n)[keep]
        begin = np.searchsorted(text, np.arange(len(texts)))
        band = (spot - begin[doc] - self.pos[flat]) // (BAND // 2)
        # the same q-gram of an item counts once in a band
        p = pd.DataFrame({"d": doc, "i": item, "b": band, "p": self.pos[flat]})
        p = pd.concat([p, p.assign(b=p["b"] - 1)]).drop_duplicates()
        got = p.groupby(["d", "i", "b"]).size().reset_index(name="n")
        got = got[got["n"].to_numpy() >= self.need[got["i"].to_numpy()]]
        out: list[tuple[int, int, int, int]] = []
        for d, i, b in got[["d", "i", "b"]].itertuples(index=False, name=None):
            x, y = b * (BAND // 2), b * (BAND // 2) + BAND
            if out and out[-1][:2] == (d, i) and out[-1][3] >= x:
                out[-1] = (d, i, out[-1][2], y)  # bands that overlap are one region
            else:
                out.append((d, i, x, y))
        return out

    def holds(self, words: list[str], starts: np.ndarray, k: int, lo: int, hi: int) -> bool:
        """Whether a passage of the item stands in the words on the diagonals lo..hi. starts: where each word begins,
        in plain characters."""
        item, ends = self.words[k], self.ends[k]
        if len(item) == 1:
            return item[0] in words
        a, b = np.searchsorted(starts, [lo - BAND, hi + int(ends[-1]) + BAND])
        region, least = words[a:b], min(MIN_WORDS, len(item))
        joined = f" {' '.join(region)} "
        if any(f" {' '.join(item[x : x + least])} " in joined for x in range(len(item) - least + 1)):
            return True  # word for word
        # of the pairs of words in a shortest passage an edit breaks two, and so does other spacing
        held: set[int] = set()
        pairs = self.pairs[k]
        for p in zip(region, region[1:]):
            if p in pairs:
                held.update(pairs[p])
        if len(held) < least - 1 - 2 * (least // EDIT_PER) - 2:
            return False
        # what two words put in or dropped may shift
        slack = 2 * max(int(np.diff(ends).max()), int(np.diff(starts[a:b]).max(initial=0)))
        return stretch(item, region, ends[:-1], starts[a:b], lo - slack, hi + slack) >= least


def stretch(item: list[str], words: list[str], at: np.ndarray, starts: np.ndarray, lo: int, hi: int) -> int:
    """Words of the longest stretch of the item that stands in the words within the edits allowed.

    Word i of the item (begins at at[i]) may meet word j (begins at starts[j]) only where starts[j] - at[i] lies in
    lo..hi; what lies outside this band is never looked at."""
    m, n, far = len(item), len(words), 10**9
    first = np.searchsorted(starts, at + lo, "left").tolist()
    last = np.searchsorted(starts, at + hi, "right").tolist()
    above, row = [], [0] * (n + 1)  # the passage may start anywhere in the region
    steps: list[list[str]] = [[]]
    best, i, j = m + 1, 0, 0
    for x in range(1, m + 1):
        w = item[x - 1]
        before, above, row = above, row, [far] * (n + 1)
        row[0] = x
        how_row = [""] * (n + 1)
        steps.append(how_row)
        for y in range(first[x - 1] + 1, last[x - 1] + 1):
            v = words[y - 1]
            c, how = (above[y - 1], "=") if w == v else (above[y - 1] + 1, "x")
            if above[y] + 1 < c:
                c, how = above[y] + 1, "-"
            if row[y - 1] + 1 < c:
                c, how = row[y - 1] + 1, "+"
            if w != v:
                if y > 1 and above[y - 2] <= c and len(w) > len(v) and w == words[y - 2] + v:
                    c, how = above[y - 2], "2"
                if x > 1 and before[y - 1] <= c and len(v) > len(w) and v == item[x - 2] + w:
                    c, how = before[y - 1], "1"
            row[y] = c
            how_row[y] = how
            # a passage may end before the item does: the best end of any row will do, of equal ones the last row's
            if c + m - x < best or (c + m - x == best and x > i):
                best, i, j = c + m - x, x, y
    path = []  # per item word: matched, edits before it
    while i and j and (how := steps[i][j]):
        if how in ("=", "2"):
            path.append("=")
            i, j = i - 1, j - (2 if how == "2" else 1)
        elif how == "1":
            path += ["=", "="]
            i, j = i - 2, j - 1
        elif how == "x":
            path.append("x")
            i, j = i - 1, j - 1
        elif how == "-":
            path.append("-")
            i -= 1
        else:
            path.append("+")
            j -= 1
    path.reverse()
    best = 0
    for a, x in enumerate(path):
        if x != "=":
            continue
        held = edits = 0
        for y in path[a:]:
            held += y != "+"
            edits += y != "="
            if y == "=" and edits * EDIT_PER <= held:
                best = max(best, held)
    return best


def windows(text: str, overlap: int) -> list[str]:
    """The text in windows of WINDOW characters that end between words and overlap by at least so much."""
    if len(text) <= WINDOW:
        return [text]
    out, a = [], 0
    while True:
        b = a + max(WINDOW, 4 * overlap)
        while b < len(text) and not text[b].isspace():
            b += 1
        out.append(text[a:b])
        if b >= len(text):
            return out
        a = b - overlap
        while a > 0 and not text[a - 1].isspace():
            a -= 1


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block: int | None = None) -> DataFrame:
    """Pairs (id_col, item_id) of a document and an item of which it holds a passage. block: items at a time."""
    held = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    n = max(1, -(-held.count() // (block or ITEM_BLOCK)))
    some = [held if n == 1 else held.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k) for k in range(n)]
    found = [_leaks(docs, s, id_col, text_col).toDF(id_col, item_id) for s in some]
    return reduce(DataFrame.unionAll, found)


def _leaks(docs: DataFrame, held: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs d, i for one block of items."""
    found: list[Items] = []
    sent = docs.sparkSession.sparkContext.broadcast(sorted((r["i"], r["t"]) for r in held.collect()))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not found:
            found.append(Items(sent.value))
        index = found[0]
        overlap = 3 * max((len(t) for _, t in sent.value), default=0) + 1000
        for pdf in frames:
            owner, texts = [], []
            for d, t in zip(pdf["d"], pdf["t"]):
                for w in windows(_NOISE.sub(" ", t) if "[" in t or ": " in t else t, overlap):
                    owner.append(d)
                    texts.append(w)
            out: set = set()
            pieces = np.cumsum([len(t) for t in texts]) // WINDOW
            for a, b in zip(*(np.searchsorted(pieces, np.unique(pieces), side) for side in ("left", "right"))):
                some, words = texts[a:b], {}
                for d, k, lo, hi in index.candidates(some):
                    if (owner[a + d], index.ids[k]) in out:
                        continue
                    if d not in words:
                        w = same_words(some[d])
                        size = np.bincount(plain(w)[1], minlength=len(w)) if w else np.zeros(0, int)
                        # words keep nearly the same characters as the text; where not, the band is widened
                        words[d] = w, np.cumsum(size) - size, abs(int(size.sum()) - len(plain([some[d]])[0]))
                    w, starts, slack = words[d]
                    if index.holds(w, starts, k, lo - slack, hi + slack):
                        out.add((owner[a + d], index.ids[k]))
            if out:
                yield pd.DataFrame(sorted(out), columns=["d", "i"])

    kinds = dict(docs.select(F.col(id_col).alias("d")).dtypes) | dict(held.dtypes)
    texts = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).where("d is not null and t is not null")
    return texts.mapInPandas(search, f"d {kinds['d']}, i {kinds['i']}")
