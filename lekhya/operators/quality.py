"""Segment quality gate: the first rule a segment fails is its drop reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhya.functions.text import content_characters, dominant_fraction, longest_character_run, normalize_transcript, once, words
from lekhya.operators.sampling import stratified_sample

# Thresholds of the gate (seconds, shares, characters per second).
MIN_SECONDS, MAX_SECONDS = 0.35, 28.0
SHORT_SECONDS, SHORT_TOKENS = 1.6, 4
MAX_CHARACTER_RUN, MAX_DOMINANT = 6, 0.8
MIN_CHARS_PER_SECOND, MAX_CHARS_PER_SECOND = 0.35, 32.0
MIN_PEAK, MAX_CLIPPED, MIN_ACTIVE = 0.003, 0.02, 0.06
SAMPLE_RATE = 16_000


def audio_metrics(audio: Column) -> Column:
    """struct(active, clipped, peak) of an array of samples, in array functions only.

    The floor is the 0.6 quantile, linear between neighbours; a sample is active from the larger of 0.008, 2.5 times
    the floor and 0.08 times the peak."""

    def measures(loud: Column) -> Column:
        n = F.size(loud)
        at = (n - 1) * 0.6
        low = F.floor(at).cast("int")
        first = F.get(loud, low)
        floor = first + (F.get(loud, F.least(low + 1, n - 1)) - first) * (at - low)
        peak = F.coalesce(F.get(loud, n - 1), F.lit(0.0))
        return once(counted, loud, F.greatest(F.lit(0.008), floor * 2.5, peak * 0.08), peak)

    def counted(loud: Column, limit: Column, peak: Column) -> Column:
        n = F.size(loud)
        share = lambda keep: F.size(F.filter(loud, keep)) / n
        sound = (n > 0) & (peak > 1e-6)
        return F.struct(
            F.when(sound, share(lambda x: x >= limit)).otherwise(F.lit(0.0)).alias("active"),
            F.when(sound, share(lambda x: x >= 0.995)).otherwise(F.lit(0.0)).alias("clipped"),
            peak.alias("peak"),
        )

    return once(measures, F.array_sort(F.transform(audio, lambda x: F.abs(x).cast("double"))))


def text_rules(text: Column, seconds: Column) -> list[tuple[str, Column]]:
    """(reason, condition) on normalised text and duration, in order."""
    tokens = words(text)
    chars = content_characters(text)
    rate = chars / F.greatest(seconds, F.lit(1e-6))
    short = (seconds <= SHORT_SECONDS) & (F.size(tokens) <= SHORT_TOKENS)
    return [
        ("audio_too_short", seconds < MIN_SECONDS),
        ("audio_too_long", seconds > MAX_SECONDS),
        ("empty_text", F.length(text) == 0),
        ("no_content_characters", chars == 0),
        ("repeated_character_noise", longest_character_run(text) > MAX_CHARACTER_RUN),
        ("repeated_token_noise", (F.size(tokens) >= 4) & (dominant_fraction(tokens) > MAX_DOMINANT)),
        ("transcript_too_sparse", (rate < MIN_CHARS_PER_SECOND) & ~short),
        ("transcript_too_dense", rate > MAX_CHARS_PER_SECOND),
    ]


def _first(rules: list[tuple[str, Column]]) -> Column:
    reason = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, failed in rules:
        reason = reason.when(failed, name)
    return reason


def gate(df: DataFrame, text: str, audio: str | None = None, rate: Column | None = None, seconds: Column | None = None) -> DataFrame:
    """df with normalized_text and drop_reason (null: kept).

    With audio (an array of samples) the duration is its length by the rate; array measures are made in a later
    projection, for rows that passed the cheap rules. Without audio, seconds is an expression."""
    if audio is not None:
        seconds = F.size(F.coalesce(audio, F.array())) / F.greatest(rate if rate is not None else F.lit(SAMPLE_RATE), F.lit(1))
    out = df.withColumns({"normalized_text": normalize_transcript(F.col(text)), "_seconds": seconds})
    rules = text_rules(F.col("normalized_text"), F.col("_seconds"))
    if audio is None:
        return out.withColumn("drop_reason", _first(rules)).drop("_seconds")
    empty = F.size(F.coalesce(audio, F.array())) == 0
    out = out.withColumn("_cheap", _first([("empty_audio", empty), *rules]))
    out = out.withColumn("_m", F.when(F.col("_cheap").isNull(), audio_metrics(F.col(audio))))
    short = (F.col("_seconds") <= SHORT_SECONDS) & (F.size(words(F.col("normalized_text"))) <= SHORT_TOKENS)
    loud = _first([("near_silent_audio", F.col("_m.peak") < MIN_PEAK), ("clipped_audio", F.col("_m.clipped") > MAX_CLIPPED), ("low_speech_activity", (F.col("_m.active") < MIN_ACTIVE) & ~short)])
    return out.withColumn("drop_reason", F.coalesce("_cheap", loud)).drop("_seconds", "_cheap", "_m")


def first_valid(gated: DataFrame, index: str, n: int = 200) -> DataFrame:
    """The first n rows of the index order that pass the gate."""
    return gated.where("drop_reason is null").orderBy(index).limit(n)


def training_set(gated: DataFrame, id_col: str, target: int, seed: int = 42) -> DataFrame:
    """id_col, audio_path, text: target rows that pass the gate, spread over lengths of text, in shuffled order."""
    kept = gated.where("drop_reason is null").select(id_col, F.col("normalized_text").alias("text"), F.length("normalized_text").alias("size"))
    return stratified_sample(kept, "size", id_col, target, seed=seed).select(id_col, F.format_string("segment_%06d.wav", id_col).alias("audio_path"), "text")


def drop_counts(gated: DataFrame) -> DataFrame:
    """drop_reason ('kept' for kept rows), n."""
    return gated.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count("*").alias("n"))


def top_reasons(gated: DataFrame, k: int = 5) -> DataFrame:
    return drop_counts(gated).where("drop_reason <> 'kept'").orderBy(F.desc("n"), "drop_reason").limit(k)
