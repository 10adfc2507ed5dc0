"""Transcript clean-up: spoken numbers to digits, English words tagged; coverage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhya.functions.english import BORROWED, HINTS, ROMAN_WORD, tag_english
from lekhya.functions.numbers import NUKTA, normalize_numbers, split_affixes
from lekhya.functions.text import nfkc, repair_mojibake, tagged_terms


def cleaned(df: DataFrame, text: str) -> DataFrame:
    """df with normalized (numbers as digits) and tagged (English words marked)."""
    return df.withColumn("normalized", normalize_numbers(F.col(text))).withColumn("tagged", tag_english(F.col("normalized")))


def tag_with_lexicon(df: DataFrame, id_col: str, text: str, hindi: DataFrame) -> DataFrame:
    """id_col, tagged: as tag_english, with a lexicon of any size (column word) joined on distinct cores."""
    tokens = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.trim(nfkc(repair_mojibake(F.col(text)))), r"(?U)\s+")).alias("pos", "t"))
    cut = tokens.select("*", split_affixes(F.col("t")).alias("a")).select("id", "pos", "t", "a", F.replace("a.core", F.lit(NUKTA), F.lit("")).alias("key"))
    known = hindi.select(F.replace("word", F.lit(NUKTA), F.lit("")).alias("key")).distinct().withColumn("hindi", F.lit(True))
    hit = F.col("a.core").rlike(ROMAN_WORD) | F.col("key").isin(BORROWED) | (F.col("hindi").isNull() & F.col("key").rlike("|".join(HINTS)))
    out = F.when(F.col("t").rlike(r"\[EN\].*\[/EN\]") | (F.col("key") == "") | ~hit, F.col("t")).otherwise(F.concat("a.leading", F.lit("[EN]"), "a.core", F.lit("[/EN]"), "a.trailing"))
    marked = cut.join(known, "key", "left").select("id", F.struct("pos", out.alias("t")).alias("p"))
    return marked.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), " ").alias("tagged")).withColumnRenamed("id", id_col)


def coverage(df: DataFrame, raw: str, normalized: str, tagged: str) -> DataFrame:
    """change ('Both', 'Number only', 'English only', 'No change') and n."""
    number, english = F.coalesce(F.col(raw) != F.col(normalized), F.lit(False)), F.coalesce(F.contains(tagged, F.lit("[EN]")), F.lit(False))
    kind = F.when(number & english, "Both").when(number, "Number only").when(english, "English only").otherwise("No change")
    return df.groupBy(kind.alias("change")).agg(F.count("*").alias("n"))


def top_terms(df: DataFrame, tagged: str, k: int = 12) -> DataFrame:
    """The k most frequent tagged terms."""
    return df.select(F.explode(tagged_terms(F.col(tagged))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def changed_first(df: DataFrame, before: str, after: str, index: str, k: int = 10) -> DataFrame:
    """k rows in index order, those whose text changed before the others."""
    return df.withColumn("changed", ~F.col(before).eqNullSafe(F.col(after))).orderBy(F.desc("changed"), index).limit(k)


def examples(df: DataFrame, before: str, after: str, index: str, fallback: DataFrame, k: int = 5) -> DataFrame:
    """The first k changed rows, filled up from fallback rows that change."""
    own = df.where(~F.col(before).eqNullSafe(F.col(after))).select(F.lit(0).alias("source"), F.col(index).cast("long").alias("idx"), F.col(before).alias("before"), F.col(after).alias("after"))
    spare = fallback.where(~F.col("before").eqNullSafe(F.col("after"))).select(F.lit(1).alias("source"), F.col("idx").cast("long").alias("idx"), "before", "after")
    return own.unionByName(spare).orderBy("source", "idx").limit(k)
