"""Registered queries of the llm operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya.llm import consensus, copies, encoding, frequency, leakage, lookalikes, mixing, repetition, subjects
from lekhya.llm.run import spread, table

Q3, TASK, FINAL, Q2, DOCS = "q3_low_confidence_samples", "task_records", "final_examples", "q2_examples", "documents"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(table(spark, d, Q3))


def p1_copies(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(table(spark, d, Q3))


def _sources(spark: SparkSession, d: str) -> list[encoding.Source]:
    return encoding.sources_of((table(spark, d, Q3), "word"), (table(spark, d, TASK), "reference"))


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    src = _sources(spark, d)
    a = encoding.garbled(table(spark, d, Q3), src, "sample_id", "word").select(F.lit(Q3).alias("source_table"), "*")
    b = encoding.garbled(table(spark, d, TASK), src, "row_idx", "reference").select(F.lit(TASK).alias("source_table"), "*")
    return a.unionAll(b)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("source_table", "row_id")


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d)


def _repetition(spark: SparkSession, d: str) -> DataFrame:
    a = repetition.measure(spread(table(spark, d, FINAL)), "example_id", "before").select(F.lit(FINAL).alias("source_table"), "*")
    b = repetition.measure(spread(table(spark, d, Q2)), "example_id", "raw_prediction").select(F.lit(Q2).alias("source_table"), "*")
    return a.unionAll(b)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(_repetition(spark, d)).select("source_table", "example_id")


def p3_repetition(spark: SparkSession, d: str) -> DataFrame:
    return _repetition(spark, d)


def _sound(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables that aren't garbled."""
    src = _sources(spark, d)
    q3 = table(spark, d, Q3).where(~encoding.damaged(F.col("word"), src))
    task = table(spark, d, TASK).where(~encoding.damaged(F.col("reference"), src))
    return q3, task


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    q3, task = _sound(spark, d)
    a = lookalikes.pairs(q3, "sample_id", "recording_id", ["word", "normalized_word"]).select(F.lit(Q3).alias("source_table"), "*")
    b = lookalikes.pairs(task, "row_idx", "segment_url", ["reference"]).select(F.lit(TASK).alias("source_table"), "*")
    return a.unionAll(b)


def p4_consistent(spark: SparkSession, d: str) -> DataFrame:
    """All rows of both tables; garbled ones take no part in classes, as in p4_found."""
    src = _sources(spark, d)
    a = lookalikes.consistent_all(table(spark, d, Q3), "sample_id", "recording_id", ["word", "normalized_word"], ~encoding.damaged(F.col("word"), src))
    b = lookalikes.consistent_all(table(spark, d, TASK), "row_idx", "segment_url", ["reference"], ~encoding.damaged(F.col("reference"), src))
    return a.select(F.lit(Q3).alias("source_table"), "*").unionByName(b.select(F.lit(TASK).alias("source_table"), "*"), allowMissingColumns=True)


def _consensus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Garbled references are as good as none; the outputs of their utterances count as all others."""
    garbled = encoding.damaged(F.col("reference"), _sources(spark, d))
    task = table(spark, d, TASK).withColumn("reference", F.when(~garbled, F.col("reference")))
    return consensus.consensus(spread(task))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d)[0].where("differs").select("utterance_id")


def p5_consensus(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d)[0]


def p5_reliability(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d)[1]


def _terms(spark: SparkSession, d: str) -> DataFrame:
    q3, task = table(spark, d, Q3), table(spark, d, TASK)
    a = frequency.mark(frequency.count_terms(frequency.values(q3, "word")), q3.count(), 1 / 200)
    b = frequency.mark(frequency.count_terms(frequency.pieces(spread(task), "reference")), task.where("reference is not null").count(), 1 / 20)
    return a.select(F.lit(f"{Q3}.word").alias("source_field"), "*").unionAll(b.select(F.lit(f"{TASK}.reference").alias("source_field"), "*"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark is not null").select("source_field", "term", "mark")


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(spread(table(spark, d, DOCS)), table(spark, d, "eval_items"))


def _mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(mixing.sized_documents(spread(table(spark, d, DOCS))), table(spark, d, "mix_targets"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_mixture(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects_of(spread(table(spark, d, DOCS)), table(spark, d, "subject_examples")).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, DOCS)
    return subjects.composition(subjects.subjects_of(spread(docs), table(spark, d, "subject_examples")), docs.count())


QUERIES = {f.__name__: f for f in (p1_found, p1_copies, p2_found, p2_restored, p3_found, p3_repetition, p4_found, p4_consistent, p5_found, p5_consensus, p5_reliability, p6_found, p6_terms, p7_found, p8_mixture, p8_shares, p9_found, p9_composition)}

_CANON = r"regexp_replace(lower({0}), '[\p{{P}} \t\n\v\f\r]+', '', 'g')"
_PAIRS = f"""select recording_id, sample_id, word, normalized_word,
  least({_CANON.format('word')}, {_CANON.format('normalized_word')}) lo,
  greatest({_CANON.format('word')}, {_CANON.format('normalized_word')}) hi
  from {Q3} where recording_id is not null and word is not null and normalized_word is not null"""

SQL = {
    "p1_found": f"select first_id, sample_id as copy_id from (select sample_id, min(sample_id) over (partition by recording_id, lo, hi) first_id from ({_PAIRS})) where sample_id <> first_id",
    "p1_copies": f"""select recording_id, min(sample_id) first_id, lo as text_lo, hi as text_hi, count(distinct (word, normalized_word)) n_raw, count(*) n_copies
        from ({_PAIRS}) group by recording_id, lo, hi""",
}
_TERMS = f"""
with v as (select word term, count(*) occurrences, count(*) records from {Q3} where word is not null group by word),
r as (select row_idx, unnest(regexp_split_to_array(reference, '[ \\t\\n\\x{{A0}}]+')) term from {TASK} where reference is not null),
t as (select term, count(*) occurrences, count(distinct row_idx) records from r where term <> '' group by term),
m as (select '{Q3}.word' source_field, term, occurrences, records,
        case when records = 1 then 'rare' when records >= (select count(*) from {Q3}) / 200.0 then 'common' end mark from v
      union all
      select '{TASK}.reference', term, occurrences, records,
        case when records = 1 then 'rare' when records >= (select count(*) from {TASK} where reference is not null) / 20.0 then 'common' end from t)
"""
SQL["p6_terms"] = _TERMS + "select source_field, term, occurrences, records, mark from m"
SQL["p6_found"] = _TERMS + "select source_field, term, mark from m where mark is not null"


def _repeated_sql(table: str, id_col: str, text: str) -> str:
    """id, n (words), k (repeated ones) of every text with words: second copies of six words by self-comparison of
    positions, loops by islands of words that equal the one a unit later."""
    space = r"\s\v\x{1C}-\x{1F}\x{85}\p{Z}"
    words = rf"list_filter(regexp_split_to_array(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}{space}\x{{900}}-\x{{963}}\x{{966}}-\x{{97F}}\x{{300}}-\x{{36F}}\x{{200C}}\x{{200D}}]', '', 'g'), '[{space}]+'), lambda x: x <> '')"
    return f"""(with r as (select {id_col} id, {words} w from {table} where {text} is not null),
      tk as (select id, i, w[i] t, len(w) n, w from (select id, w, unnest(range(1, len(w) + 1)) i from r)),
      gr as (select id, i, min(i) over (partition by id, array_to_string(w[i:i + 5], chr(1))) f from tk where i + 5 <= n),
      mt as (select id, i, u, n, coalesce(w[i + u] = t, false) and i + u <= n m from tk, (select unnest(range(1, 13)) u)),
      st as (select *, lag(m, 1, false) over (partition by id, u order by i) before, min(case when not m then i end) over (partition by id, u order by i rows between current row and unbounded following) stop from mt),
      lp as (select id, i + u a, (stop - i) // u * u len from st where m and not before and (stop - i) // u >= 2),
      mk as (select distinct id, p from (select id, unnest(range(i, i + 6)) p from gr where i - f >= 6 union all select id, unnest(range(a, a + len)) p from lp)),
      c as (select id, count(*) k from mk group by id)
      select r.id, len(r.w) n, coalesce(k, 0) k from r left join c on c.id = r.id where len(r.w) > 0)"""


SQL["p3_found"] = " union all ".join(f"select '{t}' source_table, id example_id from {_repeated_sql(t, 'example_id', c)} where k >= 0.4 * n" for t, c in ((FINAL, "before"), (Q2, "raw_prediction")))
