"""Error metrics of prediction and reference, and the rule cascade that sorts errors into classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekhya.functions.repetition import collapse_loops, repetition_metrics
from lekhya.functions.text import comparison_tokens, digits, normalize_spaces, words
from lekhya.operators.sampling import numbered
from lekhya.operators.wer import longest_unmatched, overlap_ratio, token_distance

# Classes, their tags and what helps against them.
CLASSES = (
    ("Repetition / hallucination", "decoder_loop", "Penalise repetition while decoding, or collapse loops afterwards."),
    ("Number / numeral mismatch", "numeral_surface_form", "Bring spoken and written numbers to one form before scoring."),
    ("Deletion / truncation", "content_drop", "Segment long audio and lift the limit on generated tokens."),
    ("Surface-form / normalization mismatch", "surface_form_variation", "Normalise spelling and forms on both sides before scoring."),
    ("Rare content-word confusion", "rare_word_swap", "Bias decoding towards a lexicon, or add training text with such words."),
    ("Lexical / phonetic substitution", "content_word_substitution", "Add training data for the domain, rescore with a language model."),
    ("Semantic drift / insertion", "off_target_drift", "Filter noisy audio and lower the sampling temperature."),
)


#: Why errors of a class arise, in the order of CLASSES.
WHY = (
    "The decoder feeds on its own output, mostly in silence or noise.",
    "Both texts say the same number in other signs.",
    "The recording is longer than what the model reads, or decoding stops early.",
    "The words are the same in another spelling, spacing or punctuation.",
    "A name or term was seldom heard in training, and a common word takes its place.",
    "A word that sounds alike fits the language model better.",
    "What was heard has little to do with what was said.",
)


def with_metrics(df: DataFrame, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """df with the thirteen measures of an error. Texts are normalised once, in their own projection."""
    keep = [F.col(c) for c in df.columns]
    a = df.select(*keep, normalize_spaces(F.col(prediction)).alias("_p"), normalize_spaces(F.col(reference)).alias("_r"))
    a = a.select("*", comparison_tokens(F.col("_p")).alias("_pt"), comparison_tokens(F.col("_r")).alias("_rt"), words(F.col("_p")).alias("_pw"), F.replace("_p", F.lit(" "), F.lit("")).alias("_pc"), F.replace("_r", F.lit(" "), F.lit("")).alias("_rc"))
    a = a.select("*", token_distance(F.col("_pt"), F.col("_rt")).alias("token_edit_distance"), repetition_metrics(F.col("_pw")).alias("_m"))
    n, m = F.size("_rt"), F.size("_pt")
    p, r = digits(F.col(prediction)), digits(F.col(reference))
    return a.select(
        *keep,
        n.alias("ref_tokens"),
        m.alias("pred_tokens"),
        "token_edit_distance",
        (F.col("token_edit_distance") / F.greatest(n, F.lit(1))).alias("token_wer_proxy"),
        (F.levenshtein("_pc", "_rc") / F.greatest(F.length("_rc"), F.lit(1))).alias("char_edit_ratio"),
        (m / F.greatest(n, F.lit(1))).alias("length_ratio"),
        overlap_ratio(F.col("_pt"), F.col("_rt")).alias("overlap_ratio"),
        "_m.repeated_token_ratio",
        "_m.max_token_run",
        "_m.max_ngram_repeat",
        (p != r).alias("digit_mismatch"),
        longest_unmatched(F.col("_rt"), F.col("_pt")).alias("max_unmatched_ref_length"),
        longest_unmatched(F.col("_pt"), F.col("_rt")).alias("max_unmatched_pred_length"),
    )


def error_class() -> Column:
    """Class number (position in CLASSES) by the measures; the first rule that holds decides."""
    c = F.col
    longest = F.greatest("max_unmatched_ref_length", "max_unmatched_pred_length")
    return (
        F.when((c("repeated_token_ratio") >= 0.18) | (c("max_token_run") >= 4) | (c("max_ngram_repeat") >= 3) | (c("length_ratio") >= 1.55), 0)
        .when(c("digit_mismatch"), 1)
        .when(c("length_ratio") <= 0.78, 2)
        .when((c("overlap_ratio") >= 0.70) & (c("char_edit_ratio") <= 0.35) & c("length_ratio").between(0.85, 1.20), 3)
        .when((c("overlap_ratio") >= 0.45) & (longest >= 6), 4)
        .when(c("overlap_ratio") >= 0.35, 5)
        .otherwise(6)
    )


def classify(measured: DataFrame) -> DataFrame:
    """measured with category and tag."""
    names, tags = F.array(*[F.lit(a) for a, _, _ in CLASSES]), F.array(*[F.lit(b) for _, b, _ in CLASSES])
    return measured.withColumn("_k", error_class()).withColumns({"category": F.get(names, F.col("_k")), "tag": F.get(tags, F.col("_k"))}).drop("_k")


def ranked(classified: DataFrame, id_col: str) -> DataFrame:
    """Rows with their rank in the class, worst first (ties by id), and the size of the class.

    Rows are numbered over all classes at once, so that no task holds a whole class; sizes are seven rows."""
    order = classified.withColumn("_worst", -F.col("token_wer_proxy"))
    sizes = classified.groupBy("category").agg(F.count("*").alias("class_size"))
    before = Window.orderBy("category").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("category", "class_size", F.coalesce(F.sum("class_size").over(before), F.lit(0)).alias("_before"))
    placed = numbered(order, "category", "_worst", id_col).join(sizes, "category")
    return placed.withColumn("rank", F.col("rn") - F.col("_before")).drop("rn", "_worst", "_before")


def worst(classified: DataFrame, id_col: str, k: int = 10) -> DataFrame:
    """The k worst rows of each class; a rank filter that Spark turns into a per-partition limit first."""
    by = Window.partitionBy("category").orderBy(F.desc("token_wer_proxy"), id_col)
    return classified.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def severity(classified: DataFrame) -> DataFrame:
    """category, n, mean token error rate."""
    return classified.groupBy("category").agg(F.count("*").alias("n"), F.avg("token_wer_proxy").alias("mean_wer"))


def structured(classified: DataFrame, id_col: str, prediction: str = "prediction", reference: str = "reference", k: int = 10) -> DataFrame:
    """category, tag, n, why, fix, examples (the k worst rows, worst first, with their texts and measures)."""
    measures = ["ref_tokens", "pred_tokens", "token_edit_distance", "token_wer_proxy", "char_edit_ratio", "length_ratio", "overlap_ratio", "repeated_token_ratio", "max_token_run", "max_ngram_repeat", "digit_mismatch", "max_unmatched_ref_length", "max_unmatched_pred_length"]
    shown = F.struct("rank", F.col(id_col).alias("index"), F.col(reference).alias("reference"), F.col(prediction).alias("prediction"), F.struct(*measures).alias("metrics"))
    some = worst(classified, id_col, k).groupBy("category", "tag").agg(F.array_sort(F.collect_list(shown)).alias("examples"))
    n = classified.groupBy("category").agg(F.count("*").alias("n"))
    why, fix = (F.create_map(*[F.lit(x) for x in pairs])[F.col("category")] for pairs in ([y for (a, _, _), w in zip(CLASSES, WHY) for y in (a, w)], [y for a, _, f in CLASSES for y in (a, f)]))
    return some.join(n, "category").select("category", "tag", "n", why.alias("why"), fix.alias("fix"), "examples")


def top_fixes(classified: DataFrame, id_col: str, k: int = 5) -> DataFrame:
    """The k largest classes (ties by first id) with what helps against them."""
    fixes = F.create_map(*[F.lit(x) for a, _, f in CLASSES for x in (a, f)])
    g = classified.groupBy("category").agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"))
    return g.orderBy(F.desc("n"), "first_id").limit(k).select("category", "n", fixes[F.col("category")].alias("fix"))


def demo(classified: DataFrame, id_col: str, prediction: str = "prediction", reference: str = "reference", k: int = 8) -> DataFrame:
    """The k worst repetition errors (else the k worst of all) before and after loops are collapsed."""
    loop = F.col("category") == CLASSES[0][0]
    order = [F.desc("_loop"), F.desc(F.when(F.col("_loop"), F.col("repeated_token_ratio"))), F.desc(F.when(F.col("_loop"), F.col("max_ngram_repeat"))), F.desc("token_wer_proxy"), F.asc(id_col)]
    some = classified.withColumn("_loop", loop).orderBy(*order).limit(k)
    some = some.withColumn("_any", F.max("_loop").over(Window.partitionBy())).where("_loop or not _any")
    before = some.select(id_col, reference, F.col(prediction).alias("before"), collapse_loops(words(normalize_spaces(F.col(prediction)))).alias("after"), F.col("token_edit_distance").alias("before_edits"), F.col("token_wer_proxy").alias("before_wer"))
    after = with_metrics(before, "after", reference)
    return after.select(id_col, "before", "after", "before_edits", F.col("token_edit_distance").alias("after_edits"), "before_wer", F.col("token_wer_proxy").alias("after_wer"))


def demo_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("selected"),
        F.count_if(F.col("after_edits") < F.col("before_edits")).alias("improved"),
        F.count_if(F.col("after_edits") == F.col("before_edits")).alias("unchanged"),
        F.count_if(F.col("after_edits") > F.col("before_edits")).alias("worsened"),
        F.bround(F.avg("before_wer"), 4).alias("mean_before"),
        F.bround(F.avg("after_wer"), 4).alias("mean_after"),
    )
