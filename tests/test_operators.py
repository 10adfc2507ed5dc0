import datetime as dt
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lekhya.operators import cleanup, lattice, quality, sampling, spelling, taxonomy, wer
from lekhya.plans import queries


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_token_distance_and_overlap(spark):
    r = random.Random(1)
    rows = [([r.choice("abcd") * r.randrange(1, 3) for _ in range(r.randrange(8))], [r.choice("abcd") for _ in range(r.randrange(8))]) for _ in range(200)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for x in df.select("a", "b", wer.token_distance(F.col("a"), F.col("b")).alias("d"), wer.overlap_ratio(F.col("a"), F.col("b")).alias("o"), wer.longest_unmatched(F.col("a"), F.col("b")).alias("u")).collect():
        a, b = x["a"], x["b"]
        assert x["d"] == edits(a, b)
        both = sum(min(a.count(t), b.count(t)) for t in set(b))
        assert x["o"] == pytest.approx(both / len(b) if b else 0)
        assert x["u"] == max((len(t) for t in set(a) if a.count(t) > b.count(t)), default=0)
        s, d, i, n = wer.split_counts(b, a, str.__eq__)
        assert s + d + i == x["d"] and n == len(b)


def test_split_counts():
    assert wer.split_counts("a b c".split(), "a x c d".split(), str.__eq__) == (1, 0, 1, 3)
    assert wer.split_counts([], ["a"], str.__eq__) == (0, 0, 1, 0)


def test_wer_is_zero_without_reference(spark):
    df = spark.createDataFrame([(1, ["a"], []), (2, ["a"], ["a"])], "i int, h array<string>, r array<string>")
    got = {r["i"]: r for r in wer.error_counts(df, "i", "r", "h").withColumn("wer", wer.wer(F.col("sub"), F.col("del"), F.col("ins"), F.col("ref"))).collect()}
    assert got[1]["wer"] == 0 and got[1]["ins"] == 1 and got[2]["wer"] == 0


def test_gate(spark):
    loud = [0.9, -0.01, 0.01, 0.01, 0.01] * 4000
    speech = lambda sec: (loud * 9)[: int(1600 * sec)]
    rows = [
        ("empty_audio", [], "x"), ("audio_too_short", speech(0.2), "x"), ("audio_too_long", [0.1] * 46_401, "x"), ("empty_text", speech(1.0), "!!!"),
        ("repeated_character_noise", speech(1.0), "aaaaaaa bc"), (None, speech(1.0), "aaaaaa bc"), ("repeated_token_noise", speech(2.0), "a a a a a b"),
        (None, speech(2.0), "a a a a b"), ("transcript_too_sparse", [0.5] * 16_000, "abc"), ("transcript_too_dense", speech(1.0), "abcdefghijk" * 3),
        ("near_silent_audio", [0.002] * 1_600, "hello you"), ("clipped_audio", [1.0] * 48 + [0.3] * 1_552, "hello you"), ("low_speech_activity", [0.9] * 10 + [0.001] * 15_990, "hello you there"),
        (None, [0.9] * 10 + [0.001] * 2_390, "hi you"),
    ]
    df = spark.createDataFrame([(i, a, t) for i, (_, a, t) in enumerate(rows)], "i int, audio array<float>, text string")
    got = [r["drop_reason"] for r in quality.gate(df, "text", audio="audio", rate=F.lit(1600)).orderBy("i").collect()]
    assert got == [r[0] for r in rows]


def test_audio_metrics(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 10.0],), ([],), ([0.0, 0.0],)], "a array<float>")
    got = [tuple(r["m"]) for r in df.select(quality.audio_metrics(F.col("a")).alias("m")).collect()]
    assert got == [(0.25, 1.0, 10.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


@pytest.mark.parametrize("values, k", [(dict(repeated_token_ratio=0.18), 0), (dict(max_token_run=4), 0), (dict(max_ngram_repeat=3), 0), (dict(length_ratio=1.55), 0), (dict(digit_mismatch=True), 1), (dict(length_ratio=0.78), 2), (dict(length_ratio=0.85), 3), (dict(length_ratio=1.2, overlap_ratio=0.7, char_edit_ratio=0.35), 3), (dict(overlap_ratio=0.45, char_edit_ratio=0.5, max_unmatched_ref_length=6), 4), (dict(overlap_ratio=0.35, char_edit_ratio=0.5), 5), (dict(overlap_ratio=0.34), 6), (dict(max_token_run=4, digit_mismatch=True), 0)])
def test_error_classes(spark, values, k):
    base = dict(repeated_token_ratio=0.0, max_token_run=1, max_ngram_repeat=1, length_ratio=1.0, digit_mismatch=False, overlap_ratio=0.8, char_edit_ratio=0.1, max_unmatched_ref_length=3, max_unmatched_pred_length=3)
    df = spark.createDataFrame([tuple((base | values).values())], list(base))
    assert df.select(taxonomy.error_class().alias("k")).first()["k"] == k


def test_metrics_and_demo(spark):
    rows = [(1, "a b a b a b a b c", "a b c"), (2, "एक 12 दो", "एक 13 दो"), (3, None, "x y z"), (4, "", "")]
    m = taxonomy.classify(taxonomy.with_metrics(spark.createDataFrame(rows, "id int, prediction string, reference string")))
    got = {r["id"]: r for r in m.collect()}
    assert got[1]["tag"] == "decoder_loop" and got[2]["tag"] == "numeral_surface_form" and got[3]["tag"] == "content_drop"
    assert got[1]["token_edit_distance"] == 6 and got[4]["token_wer_proxy"] == 0
    d = taxonomy.demo(m, "id")
    assert [(r["id"], r["after"], r["after_edits"]) for r in d.collect()] == [(1, "a b c", 0)]
    assert taxonomy.demo_summary(d).first()["improved"] == 1
    assert [r["rank"] for r in taxonomy.worst(m, "id").where("category like 'Del%'").collect()] == [1, 2]


def test_samples(spark):
    df = spark.range(103).withColumn("size", F.col("id") % 7)
    assert [r["id"] for r in sampling.stride_sample(df, "id", 25).orderBy("id").collect()] == list(range(0, 100, 4))
    assert sampling.numbered(df, F.desc("id")).where("rn = 1").first()["id"] == 102
    strata = sampling.strata(df, "size", "id")
    order = sorted(range(103), key=lambda i: (i % 7, i))
    assert {r["id"]: r["stratum"] for r in strata.collect()} == {v: min(3, k * 4 // 103) for k, v in enumerate(order)}
    s = sampling.stratified_sample(df, "size", "id", 20)
    assert s.count() == 20 and s.select("id").distinct().count() == 20 and s.select("stratum").distinct().count() == 4
    assert sampling.stratified_sample(df, "size", "id", 500).count() == 103
    assert sampling.quotas([1, 1, 1, 97], 10) == [1, 1, 1, 7]
    assert sampling.split(df, "id").where("fold = 'validation'").count() == 10
    assert sampling.hash_sample(df, "id", 5).count() == 5 and sampling.hash_sample(df, "id", 500).count() == 103


LEXICON = "दिन दस अब है बात कंप्यूटर सड़क किताब".split()


def test_spelling(spark):
    lex = spelling.lexicon_of(spark.createDataFrame([(w,) for w in LEXICON[:5] + LEXICON[6:]], "word string"), "word")
    words = ["दिन", "दिनों", "computer", "कंप्यूटर", "दिन,", "नुसार", "कितब", "किताबबब", "", "सडक", None, "ाक", "समझदारी"]
    got = {r["word"]: r for r in spelling.classify(spark.createDataFrame([(w,) for w in words], "word string"), "word", lex).collect()}
    short = {w: (r["label"][:2], r["source"], r["confidence"], r["suggestion"]) for w, r in got.items()}
    assert short["दिन"] == ("co", "exact_dictionary", "high", None)
    assert short["दिनों"] == ("co", "inflected_dictionary", "medium", None) and "दिन." in got["दिनों"]["reason"]
    assert short["computer"] == ("co", "roman_english", "high", None)
    assert short["कंप्यूटर"] == ("co", "devanagari_english_strong", "high", None)
    assert short["दिन,"] == ("in", "invalid_pattern", "low", None) and "punctuation_contamination" in got["दिन,"]["reason"]
    assert short["कितब"] == ("in", "matra_match", "medium", "किताब")
    assert short["किताबबब"] == ("in", "invalid_pattern", "low", "किताब")
    assert short["सडक"] == ("in", "near_dictionary_match", "medium", unicodedata.normalize("NFKC", "सड़क"))
    assert short[""][1] == short[None][1] == "invalid_pattern"
    assert short["समझदारी"] == ("co", "plausible_unknown", "low", None)
    assert short["ाक"][1] == "invalid_pattern"


def test_nearest_and_phonetic_against_all_pairs(spark):
    r = random.Random(5)
    lexicon = sorted({"".join(r.choice("abcd") for _ in range(r.randrange(1, 9))) for _ in range(80)})
    words = sorted({"".join(r.choice("abcd") for _ in range(r.randrange(1, 10))) for _ in range(300)})
    lex, w = spark.createDataFrame([(x,) for x in lexicon], "entry string"), spark.createDataFrame([(x,) for x in words], "w string")
    got = {x["w"]: (x["distance"], x["candidate"]) for x in spelling.nearest(w, lex).collect()}
    want = {x: best for x in words if (best := min((edits(x, y), y) for y in lexicon))[0] <= 2}
    assert got == want
    near = {x["w"]: x["candidate"] for x in spelling.phonetic_match(w, lex).collect()}
    assert near == {x: y for x, (k, y) in want.items() if k <= 1 for k, y in [min((edits(x, y), y) for y in lexicon if y[0] == x[0] and edits(x, y) <= 1) if any(y[0] == x[0] and edits(x, y) <= 1 for y in lexicon) else (9, None)] if y}


def test_issues(spark):
    cases = {"": "empty_after_normalization", "12": "only_digits,no_letters", "aक": "mixed_script_noise", "ा": "marks_only_token,leading_dependent_mark", "क्": "trailing_halant", "क््क": "double_halant,repeated_diacritic", "काि": "consecutive_matras", "कककक": "repeated_character_noise", "क़ख़": "suspicious_nukta_usage", "१२": ""}
    df = spark.createDataFrame([(k,) for k in cases], "w string")
    assert {r["w"]: r["x"] for r in df.select("w", F.array_join(spelling.issues(F.col("w")), ",").alias("x")).collect()} == cases


def test_audit(spark):
    rows = [(1, "a,b", "correct_spelling", "incorrect_spelling", "r", "s", None), (2, "a", "correct_spelling", "incorrect_spelling", "r", "s", None), (3, "b", "incorrect_spelling", "correct_spelling", "Edit distance match", "near_dictionary_match", None), (4, "c", "correct_spelling", "correct_spelling", "r", "s", None)]
    df = spark.createDataFrame(rows, "i int, word string, predicted_label string, manual_label string, reason string, source string, reviewer_note string")
    a = spelling.audit(df, "predicted_label", "manual_label").first()
    assert (a["annotated"], a["system_right"], a["accuracy"], a["manual_correct"]) == (4, 1, 0.25, 2)
    assert {r["index"]: r["kind"] for r in spelling.failures(df, "i").collect()} == {1: "punctuation_or_tokenization_noise", 2: "plausible_but_wrong_forms", 3: "over_aggressive_near_match_rules"}
    assert spelling.audit(df.limit(0), "predicted_label", "manual_label").first()["accuracy"] is None
    m = spark.createDataFrame([("y good one",), ("N: bad",), ("s",), ("",), ("zz",)], "v string").select(spelling.manual_response(F.col("v")).alias("m")).collect()
    assert [tuple(r["m"]) for r in m] == [("correct_spelling", "good one", False), ("incorrect_spelling", "bad", False), (None, "", True), (None, "", True), (None, "", False)]


MODELS = ["H", "i", "k", "l"]


def task(spark, rows):
    return spark.createDataFrame([(f"u{k}", "s", ref, [(m, t) for m, t in zip(MODELS, said)]) for k, (ref, *said) in enumerate(rows)], "utterance_id string, segment_url string, reference string, model_outputs array<struct<name:string,text:string>>")


def test_lattice(spark):
    df = task(spark, [("मैं सियार घर", "मैं आराम घर", "मैं राम घर", "मैं आराम घर", "मैं घर"), ("", "a", None, "", "a"), (None, "x", "x", "x", "x")])
    found = lattice.lattices(df).collect()
    by = {r["utterance_id"]: r for r in found}
    o = by["u0"]["overrides"]
    assert [(x["position"], x["reference_token"], x["reference_support"]) for x in o] == [(1, "सियार", 0)]
    assert o[0]["winning_groups"][0]["tokens"] == ["आराम", "राम"] and o[0]["winning_groups"][0]["supporting_models"] == ["H", "i", "k"]
    s = {(r["utterance_id"], r["model"]): r for r in lattice.model_scores(lattice.lattices(df)).collect()}
    assert s["u0", "H"]["baseline_errors"] == 1 and s["u0", "H"]["lattice_errors"] == 0 and s["u0", "H"]["lattice_ref"] == 3
    assert s["u1", "H"]["baseline_errors"] == 1 and s["u1", "H"]["baseline_ref"] == 0
    assert lattice.summary(lattice.lattices(df)).first()["override_cases"] == 1
    assert lattice.lattices(df.limit(0)).count() == 0


def test_split_words_are_joined():
    w = lattice.Words()
    assert lattice.join_split_words({"Human": ["घरका", "है"], "H": ["घर", "का", "है"]}, w)["H"] == ["घरका", "है"]


def test_cleanup(spark):
    df = spark.createDataFrame([(1, "तीन सौ file", "300 file", "300 [EN]file[/EN]"), (2, "a", "a", "a"), (3, None, None, None)], "i int, raw string, n string, t string")
    assert {r["change"]: r["n"] for r in cleanup.coverage(df, "raw", "n", "t").collect()} == {"Both": 1, "No change": 2}
    assert [tuple(r) for r in cleanup.top_terms(df, "t").collect()] == [("file", 1)]
    assert [r["i"] for r in cleanup.changed_first(df, "raw", "n", "i").collect()] == [1, 2, 3]
    lex = spark.createDataFrame([("टीमें",)], "word string")
    got = cleanup.tag_with_lexicon(spark.createDataFrame([(1, "यह टीमें और टीमो, file")], "i int, t string"), "i", "t", lex)
    assert got.first()["tagged"] == "यह टीमें और [EN]टीमो[/EN], [EN]file[/EN]"


def test_windowed_wer_of_every_model(spark, tmp_path):
    at = [dt.datetime(2026, 1, 1, 9), dt.datetime(2026, 1, 1, 23), dt.datetime(2026, 1, 2), None]
    outputs = [[("Model H", "a b c"), ("Model i", "a x c"), (None, "a")], [("Model i", "a b"), ("Model k", None), None], [("Model k", "a b c")], [("Model H", "z")]]
    rows = [(k, t, ref, o) for k, (t, ref, o) in enumerate(zip(at, ["a b c", "a b c", "", "a"], outputs))]
    spark.createDataFrame(rows, "row_idx long, recorded_at timestamp, reference string, model_outputs array<struct<name:string,text:string>>").write.parquet(f"{tmp_path}/task_records.parquet")
    got = {tuple(r) for r in queries.stream_windowed_wer_models(spark, str(tmp_path)).collect()}
    assert got == {("Model H", "2026-01-01", 0, 3, 0.0), ("Model i", "2026-01-01", 2, 6, 2 / 6), ("Model k", "2026-01-01", 3, 3, 1.0), ("Model k", "2026-01-02", 3, 0, None)}


def test_token_distance_has_no_limit(spark):
    a = [f"t{k}" for k in range(30_000)]
    df = spark.createDataFrame([(a, a[:10] + ["x"] + a[11:-1]), ([], []), (["क", "b"], ["b"])], "a array<string>, b array<string>")
    assert [r["d"] for r in df.select(wer.token_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [2, 0, 1]


def test_reports_of_failures(spark):
    rows = [(k, f"w{k}", "correct_spelling", "incorrect_spelling", None, None, None) for k in range(7)] + [(20 + k, None, "correct_spelling", "incorrect_spelling", "English", None, None) for k in range(3)] + [(30, "z", "incorrect_spelling", "correct_spelling", None, None, None)]
    df = spark.createDataFrame(rows, "i int, word string, predicted_label string, manual_label string, reason string, source string, reviewer_note string")
    got = [tuple(r) for r in spelling.unreliable(spelling.failures(df, "i")).collect()]
    assert [(r[0], r[1], r[3]) for r in got] == [("plausible_but_wrong_forms", 7, [f"w{k}" for k in range(5)]), ("code_mixed_or_borrowed_words", 3, [None] * 3)]
    assert all(r[2] == dict(spelling.WHY)[r[0]] for r in got)
    codes = spark.createDataFrame([(0.8,), (0.75,), (0.6,), (0.1,), (None,)], "a double").select(spelling.takeaway(F.col("a"))["code"]).collect()
    assert [r[0] for r in codes] == ["reasonably_useful", "reasonably_useful", "ambiguous", "unreliable", "not_estimated"]


def test_batches_and_training_rows(spark):
    df = spark.createDataFrame([(k, "a" * k) for k in range(1, 31)], "i int, normalized_text string").withColumn("drop_reason", F.when(F.col("i") % 3 == 0, "x"))
    got = {r["i"]: r["batch"] for r in sampling.batches(df.select("i"), "i").collect()}
    assert got == {k: (k - 1) // 8 for k in range(1, 31)}
    rows = quality.training_set(df, "i", 8).collect()
    assert len(rows) == 8 and all(r["i"] % 3 and r["audio_path"] == f"segment_{r['i']:06d}.wav" and r["text"] == "a" * r["i"] for r in rows)
    assert [r["i"] for r in quality.first_valid(df, "i", 3).collect()] == [1, 2, 4]
    assert quality.training_set(df.limit(0), "i", 8).count() == 0
