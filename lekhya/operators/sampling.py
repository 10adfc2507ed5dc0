"""Deterministic samples. Order is that of an explicit index column; random order is that of a seeded hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that one task numbers, about.
BLOCK_ROWS = 1_000_000


def shuffle_key(id_col: str, seed: int = 42) -> Column:
    """A seeded order that any engine with md5 can repeat."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def numbered(df: DataFrame, *order: Column | str, name: str = "rn", blocks: int | None = None) -> DataFrame:
    """df with its position (1..) in a total order, without one task holding all rows.

    Rows are range-partitioned (a block for about BLOCK_ROWS of them), sorted and numbered inside each partition, and
    partitions' sizes are summed."""
    blocks = blocks or max(8, -(-df.count() // BLOCK_ROWS))
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    part = df.repartitionByRange(blocks, *cols).withColumn("_b", F.spark_partition_id())
    inside = part.withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy(*cols)))
    sizes = inside.groupBy("_b").agg(F.count("*").alias("_n"))  # as many rows as blocks
    ahead = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    return inside.join(ahead, "_b").withColumn(name, F.col("_k") + F.col("_ahead")).drop("_b", "_k", "_ahead")


def stride_sample(df: DataFrame, index: str, n: int = 25) -> DataFrame:
    """Every step-th row of the index order, step = max(1, rows // n), n rows at most."""
    step = max(1, df.count() // n)
    return numbered(df, index).where(f"(rn - 1) % {step} = 0 and rn <= {step} * {n}").drop("rn")


def strata(df: DataFrame, size: str, id_col: str, k: int = 4) -> DataFrame:
    """df with its stratum 0..k-1: equal parts of the order by size (ties by id)."""
    n = df.count()
    return numbered(df, size, id_col).withColumn("stratum", F.least(F.lit(k - 1), F.floor((F.col("rn") - 1) * k / max(1, n))).cast("int")).drop("rn")


def quotas(sizes: list[int], target: int) -> list[int]:
    """Rows to take of each stratum: its share of the target, at least one, leaving one for each later stratum."""
    total, left, out = sum(sizes), target, []
    for i, n in enumerate(sizes):
        later = sum(1 for s in sizes[i + 1 :] if s)
        take = min(n, max(1, left - later), max(1, round(target * n / total))) if n else 0
        out.append(take)
        left -= take
    return out


def stratified_sample(df: DataFrame, size: str, id_col: str, target: int, k: int = 4, seed: int = 42) -> DataFrame:
    """target rows, spread over strata of size, in shuffled order; all rows if there are no more.

    A quota that rounding leaves unused is filled from the other rows in hash order."""
    n = df.count()
    h = shuffle_key(id_col, seed)
    if n <= target:
        return df.withColumn("stratum", F.lit(None).cast("int")).orderBy(h, id_col)
    held = strata(df, size, id_col, k)
    counted = {r["stratum"]: r["count"] for r in held.groupBy("stratum").count().collect()}  # k rows
    take = quotas([counted.get(s, 0) for s in range(k)], target)
    quota = F.array(*[F.lit(t) for t in take])
    # no stratum can give more than target rows: tasks cut theirs down to as many before they are brought together
    ranked = held.withColumn("_h", h).withColumn("_r", F.row_number().over(Window.partitionBy("stratum").orderBy("_h", id_col))).where(F.col("_r") <= target)
    first = (F.col("_r") <= F.get(quota, F.col("stratum"))).cast("int")
    return ranked.orderBy(first.desc(), "_h", id_col).limit(target).orderBy("_h", id_col).drop("_h", "_r")


def head(df: DataFrame, index: str, n: int = 100) -> DataFrame:
    """The first n rows of the index order; tasks keep n rows each before these meet."""
    return df.orderBy(index).limit(n)


def batches(df: DataFrame, index: str, size: int = 8) -> DataFrame:
    """df with its batch (0..): runs of so many rows in the index order."""
    return numbered(df, index).withColumn("batch", F.floor((F.col("rn") - 1) / size)).drop("rn")


def hash_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows of smallest hash; all if there are no more."""
    return df.orderBy(shuffle_key(id_col, seed), id_col).limit(n)


def split(df: DataFrame, id_col: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """df with fold 'validation' for the share of rows of smallest hash (at least one, not all), else 'train'."""
    n = df.count()
    k = max(1, min(n - 1, round(n * share))) if n > 1 else 0
    placed = numbered(df.withColumn("_h", shuffle_key(id_col, seed)), "_h", id_col)
    return placed.withColumn("fold", F.when(F.col("rn") <= k, "validation").otherwise("train")).drop("_h", "rn")
