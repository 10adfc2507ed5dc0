"""The row operators on streams, and windowed error rates with late data.

All text functions are expressions, so they run unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya.functions.repetition import clean_prediction
from lekhya.functions.text import comparison_tokens
from lekhya.operators.wer import token_distance


def read_stream(spark: SparkSession, folder: str, files: int = 16) -> DataFrame:
    """Parquet files as they arrive in a folder; the schema is that of the files there."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files).parquet(folder)


def cleaned_stream(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("cleaned", clean_prediction(F.col(text)))


def windowed_wer(df: DataFrame, time: str, prediction: str, reference: str, window: str = "1 day", late: str = "2 days", by: tuple[str, ...] = ()) -> DataFrame:
    """by.., start, edits, reference_tokens per window; rows later than the watermark are left out."""
    tokens = df.select(time, *by, comparison_tokens(F.col(prediction)).alias("p"), comparison_tokens(F.col(reference)).alias("r"))
    rows = tokens.select(time, *by, token_distance(F.col("p"), F.col("r")).cast("long").alias("e"), F.size("r").cast("long").alias("n"))
    if df.isStreaming:
        rows = rows.withWatermark(time, late)
    g = rows.groupBy(*by, F.window(time, window).alias("w")).agg(F.sum("e").alias("edits"), F.sum("n").alias("reference_tokens"))
    return g.select(*by, F.col("w.start").alias("start"), "edits", "reference_tokens")
