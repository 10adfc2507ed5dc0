"""Word error rates: edit distances of token arrays, overlaps, error counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhya.functions.text import counted, once

#: Code points before those that stand for the distinct tokens of a pair: all beyond the first plane, a million.
FIRST = 0xFFFF


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two token arrays: each distinct token of the pair becomes one character, then levenshtein.

    Characters are made from their numbers as UTF-32, so a pair may have over a million distinct tokens."""

    def distance(x: Column, y: Column, vocabulary: Column) -> Column:
        def encode(tokens: Column) -> Column:
            codes = F.transform(tokens, lambda t: F.lpad(F.hex(F.array_position(vocabulary, t) + FIRST), 8, "0"))
            return F.decode(F.unhex(F.array_join(codes, "")), "UTF-32")

        return F.levenshtein(encode(x), encode(y))

    return once(lambda x, y: once(distance, x, y, F.array_distinct(F.concat(x, y))), a, b)


def overlap_ratio(prediction: Column, reference: Column) -> Column:
    """Size of the multiset intersection by reference tokens; 0 without any."""
    both = F.size(F.array_intersect(counted(prediction), counted(reference)))
    return F.when(F.size(reference) > 0, both / F.size(reference)).otherwise(F.lit(0.0))


def longest_unmatched(tokens: Column, other: Column) -> Column:
    """Length of the longest token that tokens has more often than other."""
    extra = F.array_except(counted(tokens), counted(other))
    return F.coalesce(F.array_max(F.transform(extra, lambda t: F.length(F.substring_index(t, "\u0001", 1)))), F.lit(0))


def corpus_wer(df: DataFrame, prediction: str, reference: str, by: list[str] | None = None) -> DataFrame:
    """Sum of edits by sum of reference tokens (null without any). prediction, reference: token arrays."""
    e = df.select(*(by or []), token_distance(F.col(prediction), F.col(reference)).cast("long").alias("e"), F.size(reference).cast("long").alias("n"))
    return e.groupBy(*(by or [])).agg(F.sum("e").alias("edits"), F.sum("n").alias("reference_tokens"), F.try_divide(F.sum("e"), F.sum("n")).alias("wer"))


def split_counts(reference: list, hypothesis: list, equal) -> tuple[int, int, int, int]:
    """(substitutions, deletions, insertions, reference length) of an alignment; of equal costs a match or
    substitution goes before a deletion, that before an insertion."""
    n, m = len(reference), len(hypothesis)
    cost = [list(range(m + 1))]
    for i in range(1, n + 1):
        row = [i]
        for j in range(1, m + 1):
            row.append(min(cost[i - 1][j - 1] + (not equal(reference[i - 1], hypothesis[j - 1])), cost[i - 1][j] + 1, row[j - 1] + 1))
        cost.append(row)
    i, j, s, d, k = n, m, 0, 0, 0
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (step := int(not equal(reference[i - 1], hypothesis[j - 1]))):
            s, i, j = s + step, i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            d, i = d + 1, i - 1
        else:
            k, j = k + 1, j - 1
    return s, d, k, n


def error_counts(df: DataFrame, id_col: str, reference: str, hypothesis: str) -> DataFrame:
    """id_col, sub, del, ins, ref by row of two token arrays."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [split_counts(list(r), list(h), str.__eq__) for r, h in zip(pdf["r"], pdf["h"])]
            yield pd.DataFrame([(i, *g) for i, g in zip(pdf["i"], got)], columns=["i", "sub", "del", "ins", "ref"])

    rows = df.select(F.col(id_col).alias("i"), F.coalesce(reference, F.array()).alias("r"), F.coalesce(hypothesis, F.array()).alias("h"))
    return rows.mapInPandas(count, f"i {dict(rows.dtypes)['i']}, sub long, del long, ins long, ref long").withColumnRenamed("i", id_col)


def wer(sub: Column, dele: Column, ins: Column, ref: Column) -> Column:
    """Error rate; 0 without reference tokens."""
    return F.when(ref > 0, (sub + dele + ins) / ref).otherwise(F.lit(0.0))
