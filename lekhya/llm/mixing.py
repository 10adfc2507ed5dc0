"""Problem 8: mixing sources to target weights.

Weighted fair queueing: within each source documents stand in a seeded shuffled order, once per allowed use; a copy's
virtual finish time is the source's tokens up to and with it, divided by the source's weight. All copies are sorted
by finish time over the whole cluster and the mixture ends where the total budget is used up, so that every prefix of
the output has the wanted shares.

Running sums are made in two levels (sums of hash buckets, then sums inside a bucket), so that no task holds a whole
source. Sizes are tokens of a public tokenizer whose vocabulary file is a parameter.

Targets are a small table (one row per source; more than MAX_SOURCES are refused). Sources without a target, or with
a null one, are left out; targets without documents can't be met and are reported with share 0. The weights are the
target shares of the sources that have documents, scaled to sum 1. Without a budget the largest one is taken that
lets every source reach its weight. Null texts have no tokens and aren't used; empty texts have none either and are
left out. Documents with a null source are left out. Empty tables give an empty mixture.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lekhya.llm.run import cut

MAX_SOURCES = 100_000
#: Documents a bucket holds on average; a task's window is as large.
BUCKET_ROWS = 20_000
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the published pattern that splits text before the merges of rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(docs: DataFrame, columns: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns and n_tokens, the number of tokens of the text (null texts: 0).

    The vocabulary file is the driver's; it is sent to the executors with the job."""
    held: list = []
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rstrip("/").rsplit("/", 1)[-1]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not held:
            import tiktoken

            with open(SparkFiles.get(name), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            held.append(tiktoken.Encoding("held", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
        encode = held[0].encode_ordinary
        for pdf in frames:
            n = np.fromiter((len(encode(t)) if t else 0 for t in pdf["_text"]), dtype=np.int64, count=len(pdf))
            yield pdf.drop(columns="_text").assign(n_tokens=n)

    rows = docs.select(*columns, F.col(text).alias("_text"))
    kinds = dict(rows.dtypes)
    return rows.mapInPandas(count, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", n_tokens long")


def plan(totals: list[tuple[str, int]], targets: list[tuple[str, float, int]], budget: int | None = None) -> tuple[dict[str, float], int]:
    """Weights of the usable sources and the token budget."""
    tokens = {s: n for s, n in totals if n}
    usable = {s: (share, uses) for s, share, uses in targets if tokens.get(s) and share and share > 0 and uses and uses > 0}
    scale = sum(share for share, _ in usable.values())
    weights = {s: share / scale for s, (share, _) in usable.items()}
    if budget is None:
        budget = min((int(tokens[s] * usable[s][1] / w) for s, w in weights.items()), default=0)
    return weights, budget


def mixture(sized: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = 42, budget: int | None = None) -> DataFrame:
    """id_col, source_col, use (1..), n_tokens, finish (virtual time), running_tokens, in order of finish.

    sized: id_col, source_col and n_tokens; targets: source, target_share, max_repeats."""
    spark = sized.sparkSession
    rows = sized.select(F.col(id_col).alias("d"), F.col(source_col).alias("s"), "n_tokens").where("d is not null and s is not null and n_tokens > 0")
    held = targets.select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(held) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sums = rows.groupBy("s").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).where(F.col("s").isin([r["source"] for r in held]) if len(held) <= 1000 else F.lit(True)).collect()
    weights, budget = plan([(r["s"], r["t"]) for r in sums], [tuple(r) for r in held], budget)
    uses = {r["source"]: r["max_repeats"] for r in held}
    total = {r["s"]: r["t"] for r in sums}
    kinds = dict(rows.dtypes)
    known = spark.createDataFrame([(s, w, int(uses[s]), total[s]) for s, w in weights.items()], f"s {kinds['s']}, w double, uses int, total long")
    buckets = max(1, sum(r["n"] for r in sums) // BUCKET_ROWS)
    h = F.xxhash64(F.col("d"), F.lit(seed))
    ordered = rows.select("*", h.alias("h"), F.pmod(h, F.lit(buckets)).alias("b")).join(known, "s")
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy("s", "b").agg(F.sum("n_tokens").alias("t")).select("s", "b", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("s", "b").orderBy("h", "d").rowsBetween(Window.unboundedPreceding, 0)
    placed = ordered.select("*", F.sum("n_tokens").over(inside).alias("run")).join(offsets, ["s", "b"])
    copies = placed.select("*", F.explode(F.expr("sequence(1, uses)")).alias("use"))
    copies = copies.select("d", "s", "use", "n_tokens", (((F.col("use") - 1) * F.col("total") + F.col("offset") + F.col("run")) / F.col("w")).alias("finish"))
    # Uses that finish after twice the budget can only fall within it where sources have run dry; then all may count.
    dry = any(total[s] * uses[s] < w * budget for s, w in weights.items())
    if not dry:
        copies = copies.where(F.col("finish") <= 2.0 * budget)
    copies = copies.withColumn("q", F.floor(F.col("finish") / F.lit(max(budget, 1)) * F.lit(buckets)))
    blocks = copies.groupBy("q").agg(F.sum("n_tokens").alias("t"))
    # at most a few buckets per BUCKET_ROWS documents: the only window over one partition
    ahead = blocks.select("q", F.coalesce(F.sum("t").over(Window.orderBy("q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("q").orderBy("finish", "s", "d", "use").rowsBetween(Window.unboundedPreceding, 0)
    running = copies.select("*", F.sum("n_tokens").over(within).alias("run")).join(ahead, "q").select("d", "s", "use", "n_tokens", "finish", (F.col("ahead") + F.col("run")).alias("running_tokens"))
    mixed = running.where(F.col("running_tokens") <= budget).orderBy("finish", "s", "d", "use")
    return mixed.withColumnsRenamed({"d": id_col, "s": source_col})


def shares(mixed: DataFrame, targets: DataFrame, source_col: str = "source") -> DataFrame:
    """source, target_share, max_repeats, n_documents, most_uses, n_tokens, actual_share for every target."""
    got = mixed.groupBy(F.col(source_col).alias("source")).agg(F.countDistinct(mixed.columns[0]).alias("n_documents"), F.max("use").alias("most_uses"), F.sum("n_tokens").alias("n_tokens"))
    whole = got.agg(F.sum("n_tokens")).first()[0] or 1
    out = targets.select("source", "target_share", "max_repeats").join(got, "source", "left")
    return out.select("source", "target_share", "max_repeats", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), (F.coalesce("n_tokens", F.lit(0)) / F.lit(float(whole))).alias("actual_share"))


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source_col: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """Token sizes, written to the shared folder so that the tokenizer runs once."""
    return cut(token_counts(docs, [id_col, source_col], text, vocabulary))
