"""Readers and writers: manifests, paired recordings, segments, word lists, task sheets, JSON, CSV, stage artifacts."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "\ufeff"
SEGMENTS = "array<struct<start:double,end:double,text:string>>"
# Words that the usual CSV reader takes for missing ones.
NULL_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether files match, on whatever file system the path names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path or pattern that has files; an error if none has."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def read_split(spark: SparkSession, *patterns: str) -> DataFrame:
    """A parquet table from the first pattern that has files, e.g. the folder of a split, else its single file."""
    return spark.read.parquet(first_existing(spark, *patterns))


def eval_records(df: DataFrame, index: str, audio: str = "audio", text: str = "transcription", most: int | None = None, files: DataFrame | None = None) -> DataFrame:
    """index, audio_path, audio_bytes, text of the first rows that have audio: bytes of their own, or a path that is
    among the files (column path). Rows without a path are left out."""
    rows = df.select(index, F.col(f"{audio}.path").alias("audio_path"), F.col(f"{audio}.bytes").alias("audio_bytes"), F.col(text).alias("text"))
    if most is not None:
        rows = rows.orderBy(index).limit(most)
    rows = rows.where("audio_path <> ''")
    held = F.coalesce(F.length("audio_bytes") > 0, F.lit(False))
    if files is None:
        return rows.where(held)
    listed = files.select(F.col("path").alias("audio_path")).distinct().withColumn("listed", F.lit(True))
    return rows.join(listed, "audio_path", "left").where(held | F.col("listed")).select(index, "audio_path", "audio_bytes", "text")


def write_training_set(df: DataFrame, path: str) -> None:
    """Rows (audio_path, text) as parquet; an error if there are none."""
    if df.isEmpty():
        raise ValueError("no training rows")
    df.write.mode("overwrite").parquet(path)


def stripped(df: DataFrame) -> DataFrame:
    """df with byte order mark and white space taken off its column names."""
    return df.toDF(*[c.replace(BOM, "").strip() for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    """A CSV file with header, every column a string unless a schema is given; no inference pass over the data.

    multi_line: values may hold line breaks; a file is then read by one task."""
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("encoding", "UTF-8")
    return stripped(reader.schema(schema).csv(path) if schema else reader.csv(path))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest from CSV or parquet by extension, recording_id as a long."""
    if path.lower().endswith((".xlsx", ".xls")):
        raise ValueError("convert spreadsheets to CSV first")
    df = spark.read.parquet(path) if path.endswith(".parquet") else read_csv(spark, path)
    return df.withColumn("recording_id", F.try_to_number(F.col("recording_id").cast("string"), F.lit("9" * 18)).cast("long"))


def recording_urls(manifest: DataFrame, base: str, url: str = "rec_url_gcp") -> DataFrame:
    """recording_id, folder, audio_url, json_url; rows without an id or a folder in their URL have null URLs and ok false."""
    folder = F.nullif(F.regexp_extract(url, r"/hi/(\d+)/", 1), F.lit(""))
    ok = folder.isNotNull() & F.col("recording_id").isNotNull()
    make = lambda end: F.when(ok, F.concat(F.lit(base.rstrip("/") + "/"), folder, F.lit("/"), F.col("recording_id").cast("string"), F.lit(end)))
    return manifest.select("recording_id", folder.alias("folder"), make("_audio.wav").alias("audio_url"), make("_transcription.json").alias("json_url"), F.coalesce(ok, F.lit(False)).alias("ok"))


def paired_files(spark: SparkSession, folder: str) -> DataFrame:
    """audio_path, json_path of recordings that have both, in order; only names are listed, no file is read."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    pick = lambda end, name: names.where(F.endswith(F.lower("path"), F.lit(end))).select(stem.alias("stem"), F.col("path").alias(name))
    return pick(".wav", "audio_path").join(pick(".json", "json_path"), "stem").select("audio_path", "json_path").orderBy("audio_path")


def segments(df: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    """keep columns, pos, start, end, text of every segment of a JSON array that has a length."""
    s = df.select(*keep, F.posexplode(F.from_json(json_col, SEGMENTS)).alias("pos", "s"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return s.select(*keep, "pos", zero("s.start").alias("start"), zero("s.end").alias("end"), F.coalesce("s.text", F.lit("")).alias("text")).where("end > start")


def cut_audio(audio: Column, start: Column, end: Column, rate: Column) -> Column:
    """Samples of a segment, kept inside the recording."""
    n = F.size(audio)
    a = F.greatest(F.lit(0), F.least(n, F.floor(start * rate).cast("int")))
    b = F.greatest(F.lit(0), F.least(n, F.floor(end * rate).cast("int")))
    return F.when(b > a, F.slice(audio, a + 1, F.greatest(b - a, F.lit(0)))).otherwise(F.slice(audio, 1, 0))


def word_list(df: DataFrame, column: str | None = None) -> DataFrame:
    """word: from the column of that name, else 'word', else the first; missing and blank ones dropped, repeats kept."""
    name = column or ("word" if "word" in df.columns else df.columns[0])
    return df.select(F.col(name).alias("word")).where(F.col("word").isNotNull() & ~F.col("word").isin(*NULL_WORDS) & (F.trim("word") != ""))


def task_records(df: DataFrame, row: str = "row_idx") -> DataFrame:
    """A wide sheet as utterance_id, segment_url, reference, model_outputs (in column order).

    Columns are found by name: one with 'segment', one called 'human' or 'reference', those that start with 'model'."""
    low = {c: c.strip().lower() for c in df.columns}
    segment = next((c for c, x in low.items() if "segment" in x), None)
    human = next((c for c, x in low.items() if x in ("human", "reference")), None)
    models = [c for c, x in low.items() if x.startswith("model")]
    if segment is None or human is None or not models:
        raise ValueError("needs a segment column, a human one and model ones")
    text = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    return df.select(F.format_string("utt_%04d", F.col(row).cast("int")).alias("utterance_id"), text(segment).alias("segment_url"), text(human).alias("reference"), F.array(*[F.struct(F.lit(m.strip()).alias("name"), text(m).alias("text")) for m in models]).alias("model_outputs"))


def write_json(rows: DataFrame | dict | list, path: str) -> None:
    """A DataFrame as JSON lines by its tasks; a small summary as one indented file."""
    if isinstance(rows, DataFrame):
        rows.write.mode("overwrite").json(path)
        return
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(rows, ensure_ascii=False, indent=2), encoding="utf-8")


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines from a folder, or a file that holds one document."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(schema).json(path, multiLine=at.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(at))


def error_samples(df: DataFrame, value: str = "value") -> DataFrame:
    """prediction, reference from JSON texts that are either [prediction, reference] or an object with these names."""
    pair, named = F.from_json(value, "array<string>"), F.from_json(value, "struct<prediction:string,reference:string>")
    listed = F.startswith(F.trim(value), F.lit("["))
    pick = lambda i, n: F.coalesce(F.when(listed, F.get(pair, F.lit(i))).otherwise(named[n]), F.lit(""))
    return df.select(*[c for c in df.columns if c != value], pick(0, "prediction").alias("prediction"), pick(1, "reference").alias("reference"))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def artifact(spark: SparkSession, path: str, make: Callable[[], DataFrame], reuse: bool = True) -> DataFrame:
    """The rows kept under path, made and written first if they aren't there or reuse is off."""
    if not (reuse and exists(spark, f"{path}/_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def markdown(title: str, sections: list[tuple[str, DataFrame]], most: int = 50) -> str:
    """A report of small aggregates as Markdown tables; at most so many rows of each."""
    out = [f"# {title}"]
    for name, df in sections:
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in df.limit(most).collect()]
    return "\n".join(out) + "\n"
