"""Problem 1: records that differ only in formatting.

Byte-identical raw rows are collapsed first with a count, only the distinct survivors are brought to the
canonical form, and these are grouped again on the full canonical text, adding up the counts.

Nulls: a row with a null in the group column or in either text belongs to no group. Empty texts and texts of
punctuation only are texts like any other (canonical form ''). Very long texts are compared whole. Other
columns, whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is ignored besides case: Unicode punctuation and plain white space.
IGNORED = r"[\p{P} \t\n\x0B\f\r]+"


def canonical(c: Column) -> Column:
    """Lower case without punctuation and plain white space; nothing else changes."""
    return F.regexp_replace(F.lower(c), IGNORED, "")


def _raw(df: DataFrame, id_col: str, group_col: str, left: str, right: str) -> DataFrame:
    """Distinct raw rows with the number of their copies and their smallest id."""
    one = df.select(F.col(group_col).alias("g"), F.col(left).alias("a"), F.col(right).alias("b"), F.col(id_col).alias("i")).where("g is not null and a is not null and b is not null")
    return one.groupBy("g", "a", "b").agg(F.min("i").alias("i"), F.count("*").alias("n"))


def _keyed(raw: DataFrame) -> DataFrame:
    """The survivors with their canonical texts, in either order alike."""
    x, y = canonical(F.col("a")), canonical(F.col("b"))
    return raw.select("*", x.alias("x"), y.alias("y")).select("g", "a", "b", "i", "n", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))


def collapse(df: DataFrame, id_col: str = "sample_id", group_col: str = "recording_id", left: str = "word", right: str = "normalized_word") -> DataFrame:
    """One row per group of copies: group_col, first_id, text_lo, text_hi, n_raw (distinct raw forms), n_copies."""
    return (
        _keyed(_raw(df, id_col, group_col, left, right))
        .groupBy("g", "lo", "hi")
        .agg(F.min("i").alias("first_id"), F.count("*").alias("n_raw"), F.sum("n").alias("n_copies"))
        .select(F.col("g").alias(group_col), "first_id", F.col("lo").alias("text_lo"), F.col("hi").alias("text_hi"), "n_raw", "n_copies")
    )


def copies(df: DataFrame, id_col: str = "sample_id", group_col: str = "recording_id", left: str = "word", right: str = "normalized_word") -> DataFrame:
    """One row per copy besides the first of its group: first_id, copy_id.

    A window over the distinct survivors (never over raw rows) gives each raw form its group's first id; rows
    find it by an equi-join on their own raw texts, which adaptive execution splits where one form is hot.
    """
    keyed = _keyed(_raw(df, id_col, group_col, left, right))
    firsts = keyed.groupBy("g", "lo", "hi").agg(F.min("i").alias("first_id"), F.sum("n").alias("n_all")).where("n_all > 1")
    forms = keyed.join(firsts, ["g", "lo", "hi"]).select("g", "a", "b", "first_id")
    rows = df.select(F.col(group_col).alias("g"), F.col(left).alias("a"), F.col(right).alias("b"), F.col(id_col).alias("copy_id"))
    return rows.join(forms, ["g", "a", "b"]).where("copy_id <> first_id").select("first_id", "copy_id")
