import json

import pytest
from pyspark.sql import functions as F

from lekhya.sources import io
from lekhya.streaming import stream


def test_manifest_and_urls(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("﻿recording_id , rec_url_gcp\n7,https://x/hi/12/a.wav\n,https://x/hi/13/a.wav\n8,https://x/en/1.wav\n", encoding="utf-8")
    got = io.recording_urls(io.read_manifest(spark, str(p)), "https://y/").orderBy("recording_id").collect()
    assert [(r["recording_id"], r["ok"], r["audio_url"]) for r in got] == [(None, False, None), (7, True, "https://y/12/7_audio.wav"), (8, False, None)]
    with pytest.raises(ValueError):
        io.read_manifest(spark, "a.xlsx")
    with pytest.raises(FileNotFoundError):
        io.first_existing(spark, str(tmp_path / "no"))
    assert io.first_existing(spark, str(tmp_path / "no"), str(p)) == str(p)


def test_pairs(spark, tmp_path):
    for n in ("b.wav", "b.json", "a.wav", "c.json"):
        (tmp_path / n).write_bytes(b"x")
    got = io.paired_files(spark, str(tmp_path)).collect()
    assert [r["audio_path"].rsplit("/", 1)[1] for r in got] == ["b.wav"]


def test_segments(spark):
    rows = [(1, json.dumps([{"start": 0, "end": 1.5, "text": "a"}, {"start": 2, "end": 2}, {"end": 1}, {}])), (2, None), (3, "no json")]
    got = io.segments(spark.createDataFrame(rows, "id int, j string"), "j", ["id"]).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0.0, 1.5, "a"), (1, 2, 0.0, 1.0, "")]
    cut = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], 0.5, 9.0)], "a array<double>, s double, e double").select(io.cut_audio(F.col("a"), F.col("s"), F.col("e"), F.lit(2)).alias("x"))
    assert cut.first()["x"] == [2.0, 3.0, 4.0]


def test_words_and_tasks(spark):
    df = spark.createDataFrame([("a",), (None,), (" ",), ("NA",), ("a",)], "first string")
    assert [r["word"] for r in io.word_list(df).collect()] == ["a", "a"]
    wide = spark.createDataFrame([(1, "s1", "r", "x", None)], "row_idx int, `segment_url_link` string, `Human` string, `Model B` string, `Model A` string")
    r = io.task_records(wide).first()
    assert r["utterance_id"] == "utt_0001" and [tuple(m) for m in r["model_outputs"]] == [("Model B", "x"), ("Model A", "")]
    with pytest.raises(ValueError):
        io.task_records(df.withColumn("row_idx", F.lit(1)))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b'), (2, "क")], "i int, t string")
    io.write_csv(df, str(tmp_path / "c"))
    assert sorted((int(r["i"]), r["t"]) for r in io.read_csv(spark, str(tmp_path / "c")).collect()) == [(1, 'a "q", b'), (2, "क")]
    io.write_json(df, str(tmp_path / "j"))
    assert io.read_json(spark, str(tmp_path / "j"), "i int, t string").count() == 2
    io.write_json({"क": 1}, str(tmp_path / "d" / "x.json"))
    assert io.read_json(spark, str(tmp_path / "d" / "x.json"), "`क` int").first()[0] == 1
    made = []
    make = lambda: made.append(1) or df
    for _ in range(2):
        assert io.artifact(spark, str(tmp_path / "a"), make).count() == 2
    assert made == [1]
    assert "| 1 | a" in io.markdown("T", [("s", df)])
    rows = spark.createDataFrame([('["p", "r"]',), ('{"prediction": "p", "reference": "r"}',), ("[]",)], "value string")
    assert [tuple(r) for r in io.error_samples(rows).collect()] == [("p", "r"), ("p", "r"), ("", "")]


def test_stream(spark, tmp_path):
    spark.createDataFrame([("2025-01-01 10:00:00", "a b", "a c"), ("2025-01-01 11:00:00", "x x x x y", "y")], "t string, p string, r string").withColumn("t", F.col("t").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    out = stream.cleaned_stream(stream.read_stream(spark, str(tmp_path / "in")), "p")
    agg = stream.windowed_wer(out, "t", "cleaned", "r")
    q = agg.writeStream.outputMode("complete").format("memory").queryName("agg").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r)[1:] for r in spark.sql("select * from agg").collect()] == [(2, 3)]


def test_late_rows_are_left_out(spark, tmp_path):
    """A row that comes after the watermark has passed its window isn't counted; one within it is."""
    folder = str(tmp_path / "in")

    def put(*rows):
        spark.createDataFrame(rows, "t string, p string, r string").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)

    put(("2025-01-01 10:00:00", "a b", "a c"))
    agg = stream.windowed_wer(stream.read_stream(spark, folder), "t", "p", "r", window="1 day", late="1 day")
    q = agg.writeStream.outputMode("append").format("memory").queryName("late").start()
    q.processAllAvailable()
    put(("2025-01-05 10:00:00", "a", "a"))
    q.processAllAvailable()
    put(("2025-01-01 12:00:00", "z z z", "a"), ("2025-01-04 23:00:00", "a b", "a"))
    q.processAllAvailable()
    put(("2025-01-09 10:00:00", "a", "a"))
    q.processAllAvailable()
    q.stop()
    got = {str(r["start"])[:10]: (r["edits"], r["reference_tokens"]) for r in spark.sql("select * from late").collect()}
    assert got == {"2025-01-01": (1, 2), "2025-01-04": (1, 1), "2025-01-05": (0, 1)}


def test_eval_records(spark, tmp_path):
    rows = [(1, ("a.wav", b"x"), "t1"), (2, ("b.wav", b""), "t2"), (3, (None, b"x"), "t3"), (4, ("c.wav", None), "t4"), (5, None, "t5"), (6, ("d.wav", b"x"), "t6")]
    df = spark.createDataFrame(rows, "i int, audio struct<path:string,bytes:binary>, transcription string")
    assert [r["i"] for r in io.eval_records(df, "i", most=5).collect()] == [1]
    files = spark.createDataFrame([("c.wav",), ("c.wav",), ("e.wav",)], "path string")
    assert sorted(r["i"] for r in io.eval_records(df, "i", files=files).collect()) == [1, 4, 6]
    df.write.parquet(str(tmp_path / "legacy.parquet"))
    assert io.read_split(spark, str(tmp_path / "split" / "*.parquet"), str(tmp_path / "legacy.parquet")).count() == 6
    io.write_training_set(df.select("i"), str(tmp_path / "set"))
    with pytest.raises(ValueError):
        io.write_training_set(df.limit(0), str(tmp_path / "none"))
