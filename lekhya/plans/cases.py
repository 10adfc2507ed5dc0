"""Literal cases of operators that plain SQL can't follow: rows given here, results worked out by hand.

They stand beside the queries over whole tables (plans.queries), which have the same operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya.functions import numbers, repetition, text
from lekhya.functions.english import tag_english
from lekhya.operators import lattice, quality, spelling, taxonomy, wer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _value(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def case(columns: str, *rows: tuple):
    """Registers a query whose rows must be these."""

    def add(f: Callable[[SparkSession], DataFrame]):
        names = ", ".join(f'"{c}"' for c in columns.split())
        values = ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)
        QUERIES[f.__name__] = lambda spark, d: f(spark)
        SQL[f.__name__] = f"select * from (values {values}) t({names})"
        return f

    return add


_LOOPS = ["a b a b a b c", "x a a a a y", "a a b", "ab abab ab ab", "p q r p q r p q r p q r z", "a a a b a a a b a a a b", "", "k"]


@case("id collapsed", (0, "a b c"), (1, "x a y"), (2, "a a b"), (3, "ab abab ab ab"), (4, "p q r z"), (5, "a b"), (6, ""), (7, "k"))
def repetition_collapse_cases(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(list(enumerate(_LOOPS)), "id int, t string")
    return df.select("id", repetition.collapse_loops(text.words(F.col("t")), max_ngram=4).alias("collapsed"))


@case("id cleaned", (0, "left right"), (1, "one two"), (2, "a b c d e"), (3, ""))
def repetition_clean_cases(spark: SparkSession) -> DataFrame:
    """Longer units than four words stay unless they are made of shorter loops; a null is an empty text."""
    rows = [(0, "left right right right right"), (1, "one  two\tone two | one two"), (2, "a b c d e"), (3, None)]
    return spark.createDataFrame(rows, "id int, t string").select("id", repetition.clean_prediction(F.col("t")).alias("cleaned"))


_SPOKEN = [
    ("उनके खेत में तीन सौ चौवन पेड़ हैं", "उनके खेत में 354 पेड़ हैं"),
    ("मेले में एक हजार दो सौ बच्चे थे", "मेले में 1200 बच्चे थे"),
    ("यह पुल उन्नीस सौ निन्यानवे का है", "यह पुल 1999 का है"),
    ("बीस हजार बोरी गेहूँ", "20000 बोरी गेहूँ"),
    ("दो हजार तीन सौ पाँच", "2305"),
    ("एक दो बार आना", "एक दो बार आना"),
    ("दो चार लोग", "दो चार लोग"),
    ("एक नाव आई", "एक नाव आई"),
    ("दस, बीस आम", "30 आम"),
    ("बीस तीस", "50"),
    ("सौ दीये", "100 दीये"),
    ("शून्य सौ", "100"),
    ("सड़सठ घर", "सड़सठ घर"),
    ("(दस घर", "(दस घर"),
    ("पंद्रह। पचास", "65"),
]


@case("id digits", *[(k, numbers.unicodedata.normalize("NFKC", b)) for k, (_, b) in enumerate(_SPOKEN)])
def cleanup_numbers_cases(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(_SPOKEN)], "id int, t string")
    return df.select("id", numbers.normalize_numbers(F.col("t")).alias("digits"))


@case("id total", (0, 354), (1, 1200), (2, 1999), (3, 20000), (4, 2305), (5, 3), (6, 6), (7, 1), (8, 30), (9, 50), (10, 100), (11, 100), (12, 0), (13, 10), (14, 65))
def number_totals_cases(spark: SparkSession) -> DataFrame:
    """Hundreds multiply, thousands close a group; every number word counts, those that stay words, too."""
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(_SPOKEN)], "id int, t string")
    runs = df.select("id", numbers.number_runs(text.words(text.squeeze(text.nfkc(F.col("t"))))).alias("r"))
    return runs.select("id", F.aggregate(F.transform("r", numbers.fold_values), F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@case("id normalized tagged", (0, "मेरी meeting 25 मिनट चली", "मेरी [EN]meeting[/EN] 25 मिनट चली"), (1, '"file", कहाँ है', '"[EN]file[/EN]", कहाँ है'), (2, "[EN]फोन[/EN] बजा", "[EN]फोन[/EN] बजा"), (3, "", ""))
def cleanup_pipeline_cases(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(0, "मेरी meeting पच्चीस मिनट चली"), (1, '"file", कहाँ है'), (2, "[EN]फोन[/EN] बजा"), (3, "")], "id int, t string")
    made = df.select("id", numbers.normalize_numbers(F.col("t")).alias("normalized"))
    return made.select("id", "normalized", tag_english(F.col("normalized")).alias("tagged"))


@case("id sub del ins ref", (0, 1, 0, 1, 3), (1, 0, 0, 1, 0), (2, 0, 2, 0, 2), (3, 0, 1, 0, 2), (4, 1, 0, 1, 1), (5, 0, 0, 0, 2), (6, 0, 0, 0, 0))
def wer_split_counts_cases(spark: SparkSession) -> DataFrame:
    rows = [(0, "a b c", "a x c d"), (1, "", "a"), (2, "a b", ""), (3, "a b", "b"), (4, "a", "b c"), (5, "a b", "a b"), (6, "", "")]
    df = spark.createDataFrame(rows, "id int, r string, h string").select("id", text.words(F.col("r")).alias("r"), text.words(F.col("h")).alias("h"))
    return wer.error_counts(df, "id", "r", "h")


def _errors(spark: SparkSession) -> DataFrame:
    rows = [(0, "a b a b a b c", "a b c"), (1, "x x x x y", "x y"), (2, "table", "window")]
    return taxonomy.classify(taxonomy.with_metrics(spark.createDataFrame(rows, "id int, prediction string, reference string")))


@case("id before after before_edits after_edits before_wer after_wer", (0, "a b a b a b c", "a b c", 4, 0, 4 / 3, 0.0), (1, "x x x x y", "x y", 3, 0, 1.5, 0.0))
def taxonomy_demo_cases(spark: SparkSession) -> DataFrame:
    return taxonomy.demo(_errors(spark), "id")


@case("selected improved unchanged worsened mean_before mean_after", (2, 2, 0, 0, 1.4167, 0.0))
def taxonomy_demo_summary_cases(spark: SparkSession) -> DataFrame:
    return taxonomy.demo_summary(taxonomy.demo(_errors(spark), "id"))


def _utterances(spark: SparkSession) -> DataFrame:
    """u1: three models outvote the human. u2: one model adds a word, one doesn't. u3: a word written apart."""
    rows = [
        ("u1", "s1", "table window", [("A", "table garden"), ("B", "table garden"), ("C", "table garden")]),
        ("u2", "s2", "table", [("A", "table purple"), ("B", "table")]),
        ("u3", "s3", "garden", [("A", "gard en"), (None, "x"), None]),
    ]
    df = spark.createDataFrame(rows, "utterance_id string, segment_url string, reference string, model_outputs array<struct<name:string,text:string>>")
    return lattice.lattices(df)


@case(
    "utterance_id n_bins bins aligned",
    ("u1", 2, '[["table"],["garden"]]', '[{"name":"Human","tokens":["table","window"]},{"name":"A","tokens":["table","garden"]},{"name":"B","tokens":["table","garden"]},{"name":"C","tokens":["table","garden"]}]'),
    ("u2", 2, '[["table"],["purple"]]', '[{"name":"Human","tokens":["table",null]},{"name":"A","tokens":["table","purple"]},{"name":"B","tokens":["table",null]}]'),
    ("u3", 1, '[["garden"]]', '[{"name":"Human","tokens":["garden"]},{"name":"A","tokens":["garden"]}]'),
)
def lattice_bins_cases(spark: SparkSession) -> DataFrame:
    return _utterances(spark).select("utterance_id", "n_bins", F.to_json("bins").alias("bins"), F.to_json("aligned").alias("aligned"))


@case("utterance_id position token support representative models", ("u1", 1, "window", 0, "garden", "A,B,C"))
def lattice_overrides_cases(spark: SparkSession) -> DataFrame:
    o = _utterances(spark).select("utterance_id", F.explode("overrides").alias("o")).select("utterance_id", "o.*", F.explode("o.winning_groups").alias("g"))
    return o.select("utterance_id", "position", F.col("reference_token").alias("token"), F.col("reference_support").alias("support"), "g.representative", F.array_join("g.supporting_models", ",").alias("models"))


_SCORES = [("u1", "A", 1, 2, 0, 2, False), ("u1", "B", 1, 2, 0, 2, False), ("u1", "C", 1, 2, 0, 2, False), ("u2", "A", 1, 1, 0, 2, False), ("u2", "B", 0, 1, 0, 1, True), ("u3", "A", 0, 1, 0, 1, False)]


@case("utterance_id model baseline_errors baseline_ref lattice_errors lattice_ref guarded", *_SCORES)
def lattice_scores_cases(spark: SparkSession) -> DataFrame:
    return lattice.model_scores(_utterances(spark))


@case("model baseline_wer lattice_wer delta", ("A", 0.5, 0.0, 0.5), ("B", 0.333333, 0.0, 0.333333), ("C", 0.5, 0.0, 0.5))
def lattice_comparison_cases(spark: SparkSession) -> DataFrame:
    return lattice.comparison(lattice.model_scores(_utterances(spark)))


@case("models avg_baseline_wer avg_lattice_wer improvement_percent improved_cases guarded_cases utterances override_cases", (3, 0.444444, 0.0, 100.0, 4, 1, 3, 1))
def lattice_summary_cases(spark: SparkSession) -> DataFrame:
    return lattice.summary(_utterances(spark))


@case("utterance_id model improvement", ("u1", "A", 1), ("u1", "B", 1), ("u1", "C", 1), ("u2", "A", 1))
def lattice_improved_cases(spark: SparkSession) -> DataFrame:
    return lattice.improved_cases(lattice.model_scores(_utterances(spark)))


@case("model improved", ("A", 2), ("B", 1), ("C", 1))
def lattice_improved_counts_cases(spark: SparkSession) -> DataFrame:
    return lattice.improved_counts(lattice.model_scores(_utterances(spark)))


@case(
    "id drop_reason",
    (0, "empty_audio"), (1, "audio_too_short"), (2, "audio_too_long"), (3, "empty_text"), (4, "repeated_character_noise"), (5, None), (6, "repeated_token_noise"), (7, "transcript_too_sparse"),
    (8, "transcript_too_dense"), (9, "near_silent_audio"), (10, "clipped_audio"), (11, "low_speech_activity"), (12, None),
)
def quality_gate_cases(spark: SparkSession) -> DataFrame:
    """One row for each rule that can hold, at 100 samples a second; the three rules of the samples themselves, too."""
    tone = lambda n: [0.01 if k % 4 else 0.5 for k in range(n)]
    rows = [
        (0, [], "abc def"), (1, tone(20), "abc"), (2, tone(2900), "abc " * 20), (3, tone(100), "!!!"), (4, tone(300), "aaaaaaa bc"), (5, tone(300), "aaaaaa bc"), (6, tone(300), "a a a a a b"), (7, tone(1000), "abc"),
        (8, tone(100), "abcdefghijk lmnopqrstuv wxyzabcdefg"), (9, [0.002] * 200, "some words here"), (10, [1.0] * 6 + tone(194), "some words here"), (11, [0.5] + [0.001] * 999, "a few words more than four here"), (12, [0.5] + [0.001] * 149, "two words"),
    ]
    df = spark.createDataFrame(rows, "id int, audio array<double>, t string")
    return quality.gate(df, "t", "audio", F.lit(100)).select("id", "drop_reason")


@case("id label note skipped", (0, "correct_spelling", "", False), (1, "incorrect_spelling", "extra sign", False), (2, None, "", True), (3, None, "", True), (4, "incorrect_spelling", "", False))
def spelling_response_cases(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(0, "y"), (1, "N: extra sign"), (2, "s"), (3, "  "), (4, " i ")], "id int, t string")
    return df.select("id", spelling.manual_response(F.col("t")).alias("r")).select("id", "r.*")
