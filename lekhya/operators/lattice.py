"""Lattice word error rate: utterances' transcripts aligned to bins, consensus per bin, two error rates per model.

Bins and groups depend on the order of the transcripts (similarity isn't transitive), so an utterance is worked on
in one piece; its size is bounded by its models and words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhya.functions.numbers import NUKTA
from lekhya.functions.similarity import MATRA_RANGE, NUMBER_FORMS
from lekhya.functions.text import DEVANAGARI_DIGITS
from lekhya.operators.wer import split_counts

HUMAN = "Human"
TRUST, WEAK = 3, 2
_DIGITS, _NUMBER, _SIGNS = str.maketrans(DEVANAGARI_DIGITS, "0123456789"), dict(NUMBER_FORMS), re.compile(MATRA_RANGE)
_OTHER = re.compile(r"[^0-9A-Za-zऀ-ॿ]+")


class Words:
    """Keys and similarities of tokens, each worked out once."""

    def __init__(self) -> None:
        self.keys: dict[str, tuple[str, str]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def key(self, t: str) -> str:
        return self.both(t)[0]

    def both(self, t: str) -> tuple[str, str]:
        k = self.keys.get(t)
        if k is None:
            if len(self.keys) > 200_000:  # bounds the memory of a worker
                self.keys.clear()
                self.pairs.clear()
            d = t.translate(_DIGITS)
            exact = _NUMBER.get(d, d).replace(NUKTA, "").replace("ँ", "ं")
            k = self.keys[t] = (exact, re.sub(r"(.)\1+", r"\1", _SIGNS.sub("", exact)))
        return k

    def similar(self, a: str, b: str) -> bool:
        if a == b:
            return bool(a)
        got = self.pairs.get((a, b))
        if got is None:
            (x, p), (y, q) = self.both(a), self.both(b)
            got = bool(a and b) and (x == y or p == q or (min(len(a), len(b)) > 2 and self._near(a, b)))
            self.pairs[a, b] = self.pairs[b, a] = got
        return got

    @staticmethod
    def _near(a: str, b: str, most: int = 2) -> bool:
        if abs(len(a) - len(b)) > most:
            return False
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
            if min(row) > most:
                return False
        return row[-1] <= most


def join_split_words(said: dict[str, list[str]], w: Words) -> dict[str, list[str]]:
    """Neighbouring tokens put together where the whole is a word of the utterance and a part is short."""
    known = {w.key(t) for tokens in said.values() for t in tokens}
    out = {}
    for name, tokens in said.items():
        kept, i = [], 0
        while i < len(tokens):
            pair = tokens[i : i + 2]
            whole = _OTHER.sub("", "".join(pair)).lower() if len(pair) == 2 else ""
            if whole and whole in known and min(map(len, pair)) <= 2:
                kept.append(whole)
                i += 2
            else:
                kept.append(tokens[i])
                i += 1
        out[name] = kept
    return out


def progressive(said: dict[str, list[str]], w: Words) -> list[dict[str, str | None]]:
    """Bins as dicts of transcript name to token or None; the human one first, then the others in order."""
    bins: list[dict[str, str | None]] = [{HUMAN: t} for t in said[HUMAN]]
    done = [HUMAN]
    for name, tokens in said.items():
        if name == HUMAN:
            continue
        fits = [[any(x and w.similar(t, x) for x in b.values()) for t in tokens] for b in bins]
        n, m = len(bins), len(tokens)
        cost = [list(range(m + 1))]
        for i in range(1, n + 1):
            row, above, fit = [i], cost[-1], fits[i - 1]
            for j in range(1, m + 1):
                row.append(min(above[j - 1] + (not fit[j - 1]), above[j] + 1, row[j - 1] + 1))
            cost.append(row)
        i, j, merged = n, m, []
        while i or j:
            if i and j and cost[i][j] == cost[i - 1][j - 1] + (not fits[i - 1][j - 1]):
                i, j = i - 1, j - 1
                merged.append(bins[i] | {name: tokens[j]})
            elif i and cost[i][j] == cost[i - 1][j] + 1:
                i -= 1
                merged.append(bins[i] | {name: None})
            else:
                j -= 1
                merged.append(dict.fromkeys(done) | {name: tokens[j]})
        bins = merged[::-1]
        done.append(name)
    return bins


def groups(bin_: dict[str, str | None], w: Words) -> list[tuple[list[str], set[str]]]:
    """(tokens, models) of each group of a bin: a token joins the first group that has one like it."""
    out: list[tuple[list[str], set[str]]] = []
    for name, t in bin_.items():
        if not t:
            continue
        home = next((g for g in out if any(w.similar(t, x) for x in g[0])), None)
        if home is None:
            home = ([], set())
            out.append(home)
        home[0].append(t)
        if name != HUMAN:
            home[1].add(name)
    return out


def decide(bins: list[dict[str, str | None]], w: Words, trust: int = TRUST) -> tuple[list[list[str]], list[tuple]]:
    """Accepted tokens of each bin, and the overrides of the human token (position, token, support, winners)."""
    accepted, overrides = [], []
    for position, b in enumerate(bins):
        found = groups(b, w)
        trusted = [g for g in found if len(g[1]) >= trust]
        taken = sorted({t for g in (trusted or found) for t in g[0]})
        accepted.append(taken)
        human = b.get(HUMAN)
        support = next((len(g[1]) for g in found if human in g[0]), 0) if human else 0
        if human and trusted and support < WEAK and human not in taken:
            overrides.append((position, human, support, [(g[0][0], sorted(set(g[0])), sorted(g[1])) for g in trusted]))
    return accepted, overrides


COUNTS = "struct<sub:long,del:long,ins:long,ref:long>"
SCHEMA = (
    f"segment string, n_bins int, overrides array<struct<position:int,reference_token:string,reference_support:int,winning_groups:array<struct<representative:string,tokens:array<string>,supporting_models:array<string>>>>>, "
    f"bins array<array<string>>, aligned array<struct<name:string,tokens:array<string>>>, scores array<struct<model:string,baseline:{COUNTS},lattice:{COUNTS}>>"
)


def lattices(df: DataFrame, id_col: str = "utterance_id", segment: str = "segment_url", reference: str = "reference", outputs: str = "model_outputs") -> DataFrame:
    """One row per utterance: bins (accepted tokens), aligned transcripts, overrides, counts per model.

    Null texts have no tokens; null elements of the outputs and unnamed ones are left out."""
    named = F.filter(F.coalesce(outputs, F.array()), lambda o: o["name"].isNotNull())
    rows = df.select(
        F.col(id_col).alias("u"),
        F.col(segment).alias("segment"),
        F.transform(named, lambda o: o["name"]).alias("names"),
        F.concat(F.array(F.coalesce(reference, F.lit(""))), F.transform(named, lambda o: F.coalesce(o["text"], F.lit("")))).alias("texts"),
    )

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = Words()
        for pdf in frames:
            out = []
            for u, segment, names, texts in zip(pdf["u"], pdf["segment"], pdf["names"], pdf["texts"]):
                said = {HUMAN: tokens_of(texts[0])} | {n: tokens_of(t) for n, t in zip(names, texts[1:]) if n != HUMAN}
                said = join_split_words(said, w)
                bins = progressive(said, w)
                accepted, overrides = decide(bins, w)
                scores = []
                for n in said:
                    if n == HUMAN:
                        continue
                    base = split_counts(said[HUMAN], said[n], lambda a, b: w.key(a) == w.key(b))
                    lattice = split_counts(accepted, said[n], lambda a, b: any(w.similar(b, x) for x in a))
                    scores.append({"model": n, "baseline": dict(zip(("sub", "del", "ins", "ref"), base)), "lattice": dict(zip(("sub", "del", "ins", "ref"), lattice))})
                found = [{"position": p, "reference_token": t, "reference_support": s, "winning_groups": [{"representative": a, "tokens": b, "supporting_models": c} for a, b, c in g]} for p, t, s, g in overrides]
                out.append((u, segment, len(bins), found, accepted, [{"name": n, "tokens": [b.get(n) for b in bins]} for n in said], scores))
            yield pd.DataFrame(out, columns=["u", "segment", "n_bins", "overrides", "bins", "aligned", "scores"])

    kind = dict(rows.dtypes)["u"]
    return rows.mapInPandas(build, f"u {kind}, {SCHEMA}").withColumnsRenamed({"u": id_col, "segment": segment})


def tokens_of(text: str) -> list[str]:
    """Python twin of functions.text.utterance_tokens."""
    try:
        if "à¤" in text or "à¥" in text or "ï¿½" in text:
            text = text.encode("latin-1").decode("utf-8")
    except UnicodeError:
        pass
    out = re.sub("[‌‍﻿]", " ", unicodedata.normalize("NFKC", text))
    return [t for t in (_OTHER.sub("", x).lower() for x in out.split()) if t]


def _guarded() -> tuple:
    """(errors of a kind of counts, reference length that stands, whether the baseline stands) of a score s."""
    errors = lambda c: F.col(f"s.{c}.sub") + F.col(f"s.{c}.del") + F.col(f"s.{c}.ins")
    held = errors("lattice") > errors("baseline")
    return errors, F.when(held, F.col("s.baseline.ref")).otherwise(F.col("s.lattice.ref")), held


def model_scores(found: DataFrame, id_col: str = "utterance_id") -> DataFrame:
    """id_col, model, baseline and final counts; the lattice counts stand unless they hold more errors."""
    errors, ref, held = _guarded()
    return found.select(id_col, F.explode("scores").alias("s")).select(
        id_col,
        F.col("s.model").alias("model"),
        errors("baseline").alias("baseline_errors"),
        F.col("s.baseline.ref").alias("baseline_ref"),
        F.when(held, errors("baseline")).otherwise(errors("lattice")).alias("lattice_errors"),
        ref.alias("lattice_ref"),
        held.alias("guarded"),
    )


def comparison(scores: DataFrame) -> DataFrame:
    """model, baseline_wer, lattice_wer, delta (of the rates rounded to six places)."""
    g = scores.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("baseline_errors", "baseline_ref", "lattice_errors", "lattice_ref")])
    rate = lambda e, n: F.bround(F.when(F.col(n) > 0, F.col(e) / F.col(n)).otherwise(F.lit(0.0)), 6)
    g = g.select("model", rate("baseline_errors", "baseline_ref").alias("baseline_wer"), rate("lattice_errors", "lattice_ref").alias("lattice_wer"))
    return g.withColumn("delta", F.bround(F.col("baseline_wer") - F.col("lattice_wer"), 6))


def summary(found: DataFrame, id_col: str = "utterance_id") -> DataFrame:
    """One row: means of the models' rates, improvement in per cent, utterances overridden, cases improved, guarded.

    One pass: every utterance hands on a row for each of its models and one of its own, and all are summed by model,
    so that no alignment is made twice."""
    own = F.when(F.size("overrides") > 0, 1).otherwise(0).alias("overridden")
    none = F.lit(None).cast(found.schema["scores"].dataType.elementType)
    rows = found.select(id_col, own, F.explode(F.concat("scores", F.array(none))).alias("s"))
    e, ref, held = _guarded()
    g = rows.groupBy(F.col("s.model").alias("model")).agg(
        *[F.sum(c).alias(n) for n, c in (("be", e("baseline")), ("bn", F.col("s.baseline.ref")), ("le", F.when(held, e("baseline")).otherwise(e("lattice"))), ("ln", ref))],
        F.count_if(~held & (e("lattice") < e("baseline"))).alias("improved"),
        F.count_if(held).alias("guarded"),
        F.count("*").alias("n"),
        F.sum("overridden").alias("overridden"),
    )
    rate = lambda x, n: F.bround(F.when(F.col(n) > 0, F.col(x) / F.col(n)).otherwise(F.lit(0.0)), 6)
    g = g.withColumns({"b": F.when(F.col("model").isNotNull(), rate("be", "bn")), "l": F.when(F.col("model").isNotNull(), rate("le", "ln"))})
    of_all = lambda c: F.coalesce(F.sum(F.when(F.col("model").isNull(), F.col(c))), F.lit(0)).cast("long")
    return g.agg(
        F.count("model").alias("models"),
        F.bround(F.avg("b"), 6).alias("avg_baseline_wer"),
        F.bround(F.avg("l"), 6).alias("avg_lattice_wer"),
        F.bround((F.sum("b") - F.sum("l")) / F.greatest(F.sum("b"), F.lit(1e-9)) * 100, 4).alias("improvement_percent"),
        F.coalesce(F.sum(F.when(F.col("model").isNotNull(), F.col("improved"))), F.lit(0)).alias("improved_cases"),
        F.coalesce(F.sum(F.when(F.col("model").isNotNull(), F.col("guarded"))), F.lit(0)).alias("guarded_cases"),
        of_all("n").alias("utterances"),
        of_all("overridden").alias("override_cases"),
    )


def improved_counts(scores: DataFrame) -> DataFrame:
    """model, improved: utterances in which the lattice counts fewer errors."""
    return scores.groupBy("model").agg(F.count_if(F.col("lattice_errors") < F.col("baseline_errors")).alias("improved"))


def improved_cases(scores: DataFrame, id_col: str = "utterance_id") -> DataFrame:
    return scores.where("lattice_errors < baseline_errors").select(id_col, "model", (F.col("baseline_errors") - F.col("lattice_errors")).alias("improvement"))
