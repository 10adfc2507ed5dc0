"""Spelling validation of words against a lexicon: orthography, stems, nearest words, the rule cascade, the audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekhya.functions.english import ROMAN_WORD
from lekhya.functions.similarity import DEPENDENT, matra_error, sound_key, sounds_like
from lekhya.functions.text import has_devanagari, has_digit, has_latin, normalize_word

# Suffixes of inflected words, in order of preference.
SUFFIXES = "ों ें याँ यों ाएँ ाए ियाँ ियों ाना ाने ाती ाता ाते ती ता ते ना नी कर पन वाला वाली वाले".split()
# English words in Devanagari.
BORROWED = (
    "कंप्यूटर कम्प्यूटर इंटरव्यू मैनेजर मैनेजमेंट फाइल फॉर्म ऑफिस फोन मोबाइल लैपटॉप प्रोजेक्ट सिस्टम डेटा कोड लॉगिन पासवर्ड जॉब टीम "
    "मीटिंग ड्राइवर ट्रेनर क्लास कोर्स मार्केट बैंक डॉक्टर पुलिस मैसेज मेल ईमेल वीडियो ऑडियो सॉफ्टवेयर हार्डवेयर नेटवर्क फीडबैक सेल्स "
    "मार्केटिंग प्रोडक्ट सर्विस डिजाइन मैप टिकट"
).split()
# Letter groups, then clusters, found in borrowed words.
HINTS = (
    "इंटर कंप कम्प मैने प्रोजे सिस्टम डेटा कोड लॉग पास जॉब मीट फाइल फॉर्म ऑफ फोन मोबा लैप ड्राइ ट्रे क्ला कोर्स बैंक डॉक मेल वीडि ऑडि सॉफ्ट "
    "हार्ड नेट ट्र ड्र फ्र ग्र क्ल प्ल स्क स्प स्ट कॉ ऑ"
).split()
# Punctuation that makes a raw word noise.
RAW_NOISE = r"[.,;:!?/\\|*_]"
#: Issues that alone make a spelling wrong.
HARD = (
    "empty_after_normalization", "only_digits", "mixed_script_noise", "no_letters", "marks_only_token", "leading_dependent_mark",
    "double_halant", "consecutive_matras", "repeated_diacritic", "repeated_character_noise",
)


def issues(w: Column) -> Column:
    """Orthographic issues of a normalised word, in fixed order."""
    dev, lat = has_devanagari(w), has_latin(w)
    rules = [
        ("only_digits", has_digit(w) & ~dev & ~lat),
        ("mixed_script_noise", dev & lat),
        ("no_letters", ~dev & ~lat),
        ("marks_only_token", w.rlike(f"^{DEPENDENT}+$")),
        ("leading_dependent_mark", w.rlike(f"^{DEPENDENT}")),
        ("trailing_halant", w.rlike("्$")),
        ("double_halant", w.rlike("्{2,}")),
        ("consecutive_matras", w.rlike("[ा-ौ]{2,}")),
        ("repeated_diacritic", w.rlike(r"([ऺ-्ॎ-ॗॢॣ])\1+")),
        ("repeated_character_noise", w.rlike(r"(.)\1{2,}")),
        ("suspicious_nukta_usage", w.rlike("़.*़|^़")),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    return F.when(w == "", F.array(F.lit("empty_after_normalization"))).otherwise(found)


def is_hard(found: Column) -> Column:
    return F.arrays_overlap(found, F.array(*[F.lit(x) for x in HARD]))


def is_plausible(w: Column) -> Column:
    return has_devanagari(w) & ~has_latin(w) & ~is_hard(issues(w))


def lexicon_of(df: DataFrame, word: str) -> DataFrame:
    """Distinct normal forms (column entry)."""
    return df.where(F.col(word).isNotNull()).select(normalize_word(F.col(word)).alias("entry")).where("entry <> ''").distinct()


def stems(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """w, stem: a word of the lexicon itself, else what is left without the first suffix that leaves one."""
    ends = F.array(F.lit(""), *[F.lit(s) for s in SUFFIXES])
    tried = words.select("w", F.posexplode(ends).alias("k", "s")).where((F.col("s") == "") | (F.endswith("w", F.col("s")) & (F.length("w") > F.length("s") + 1)))
    tried = tried.select("w", "k", F.substr("w", F.lit(1), F.length("w") - F.length("s")).alias("entry"))
    return tried.join(lexicon, "entry").groupBy("w").agg(F.min_by("entry", "k").alias("stem"))


def within(words: DataFrame, lexicon: DataFrame, distance: int) -> DataFrame:
    """w, entry, k: words and lexicon words at most so many edits (k) apart.

    Blocks: a pair within d edits of words longer than d shares one of d + 1 pieces of the lexicon word, at a place
    shifted by at most d; shorter lexicon words are met by their length. Both are equi-joins, so the lexicon may
    grow; no pair of words outside a common block is compared."""
    d = distance
    n = F.length("entry")
    cut = F.expr(f"transform(sequence(0, {d}), i -> struct(i as i, cast(floor(i * length(entry) / {d + 1}) as int) as a, cast(floor((i + 1) * length(entry) / {d + 1}) as int) as b))")
    long = lexicon.where(n > d).select("entry", F.explode(cut).alias("c"))
    long = long.select("entry", F.concat_ws("|", n, F.col("c.i"), F.substr("entry", F.col("c.a") + 1, F.col("c.b") - F.col("c.a"))).alias("block"))
    short = lexicon.where(n <= d).select("entry", F.concat(F.lit("#"), n.cast("string")).alias("block"))
    keys = F.expr(
        f"""array_distinct(flatten(transform(filter(sequence(greatest({d + 1}, length(w) - {d}), length(w) + {d}), n -> length(w) + {d} >= {d + 1}), n -> flatten(transform(sequence(0, {d}), i ->
            transform(filter(transform(sequence(-{d}, {d}), s -> cast(floor(i * n / {d + 1}) as int) + s), a -> a >= 0 and a + cast(floor((i + 1) * n / {d + 1}) as int) - cast(floor(i * n / {d + 1}) as int) <= length(w)),
                a -> concat_ws('|', n, i, substr(w, a + 1, cast(floor((i + 1) * n / {d + 1}) as int) - cast(floor(i * n / {d + 1}) as int)))))))))"""
    )
    near_short = F.expr(f"transform(sequence(greatest(1, length(w) - {d}), greatest(1, least({d}, length(w) + {d}))), n -> concat('#', n))")
    asked = words.where("w <> ''").select("w", F.explode(F.concat(keys, near_short)).alias("block"))
    met = asked.join(long.unionByName(short), "block").where(F.abs(F.length("w") - n) <= d)
    return met.select("w", "entry", F.levenshtein("w", "entry", d).alias("k")).where("k >= 0")


def nearest(words: DataFrame, lexicon: DataFrame, distance: int = 2) -> DataFrame:
    """w, candidate, distance: the nearest lexicon word (ties by candidate) within the distance."""
    best = within(words, lexicon, distance).groupBy("w").agg(F.min(F.struct("k", "entry")).alias("b"))
    return best.select("w", F.col("b.entry").alias("candidate"), F.col("b.k").alias("distance"))


def phonetic_match(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """w, candidate: a lexicon word of like sound at fewer than two edits (ties by distance, candidate) that has the
    same sound key or the same first character."""
    w, e = F.col("w"), F.col("entry")
    alike = (sound_key(w) == sound_key(e)) | (F.substring("w", 1, 1) == F.substring("entry", 1, 1))
    near = within(words, lexicon, 1).where(alike & sounds_like(w, e))
    return near.groupBy("w").agg(F.min(F.struct("k", "entry")).alias("b")).select("w", F.col("b.entry").alias("candidate"))


def english_kind(w: Column, in_lexicon: Column) -> Column:
    """'strong', 'medium' or null."""
    return F.when(w.rlike(ROMAN_WORD) | w.isin(BORROWED), "strong").when(in_lexicon, None).when(w.rlike("|".join(HINTS)), "medium")


def confidence(source: Column, distance: Column) -> Column:
    return (
        F.when(source.isin("exact_dictionary", "roman_english", "devanagari_english_strong"), "high")
        .when(source.isin("inflected_dictionary", "devanagari_english_medium", "phonetic_match", "matra_match"), "medium")
        .when((source == "near_dictionary_match") & (distance <= 1), "medium")
        .otherwise("low")
    )


def reason(source: Column, found: Column, candidate: Column, stem: Column) -> Column:
    # Texts that explain a decision.
    two = F.array_join(F.slice(found, 1, 2), ", ")
    quoted = lambda text: F.concat(F.lit(text + " '"), candidate, F.lit("'."))
    return (
        F.when(source == "exact_dictionary", "Exact match in curated Hindi lexicon.")
        .when(source == "inflected_dictionary", F.concat(F.lit("Matches a common Hindi stem: "), stem, F.lit(".")))
        .when(source == "roman_english", "Roman-script English token, treated as correctly spelled.")
        .when(source == "devanagari_english_strong", "Recognized Devanagari spelling of an English borrowing.")
        .when(source == "devanagari_english_medium", "Likely Devanagari form of an English word.")
        .when(source == "near_dictionary_match", quoted("Edit distance match with common Hindi word"))
        .when(source == "phonetic_match", quoted("Phonetically similar to common Hindi word"))
        .when(source == "matra_match", quoted("Likely matra/diacritic variant of"))
        .when(source == "invalid_pattern", F.concat(F.lit("Suspicious Hindi character pattern: "), F.when(two == "", "invalid orthographic pattern").otherwise(two), F.lit(".")))
        .when(source == "plausible_unknown", "Ambiguous form: plausible Hindi spelling but outside curated lexicon.")
        .otherwise(F.concat(F.lit("Unknown token with ambiguous or noisy spelling: "), F.when(two == "", "unknown form").otherwise(two), F.lit(".")))
    )


def decide(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """w, label, source, confidence, reason, suggestion for distinct normalised words (column w).

    Stems and nearest words are looked up by joins for words that need them; one expression then decides."""
    base = words.select("w", issues(F.col("w")).alias("found"))
    base = base.join(lexicon.select(F.col("entry").alias("w"), F.lit(True).alias("listed")), "w", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    base = base.withColumn("english", english_kind(F.col("w"), F.col("listed")))
    open_ = base.where("english is null and not listed and w <> ''").select("w")
    stem = stems(open_, lexicon)
    near = nearest(open_.join(stem, "w", "left_anti"), lexicon)
    a = base.join(stem, "w", "left").join(near, "w", "left")
    w, cand = F.col("w"), F.col("candidate")
    source = (
        F.when(w == "", "invalid_pattern")
        .when((F.col("english") == "strong") & w.rlike(r"^[\x00-\x7F]*$"), "roman_english")
        .when(F.col("english") == "strong", "devanagari_english_strong")
        .when(F.col("english") == "medium", "devanagari_english_medium")
        .when(F.col("listed"), "exact_dictionary")
        .when(F.col("stem").isNotNull(), "inflected_dictionary")
        .when(is_hard(F.col("found")), "invalid_pattern")
        .when(F.coalesce(matra_error(w, cand), F.lit(False)), "matra_match")
        .when(cand.isNotNull(), "near_dictionary_match")
        .when(is_plausible(w), "plausible_unknown")
        .otherwise("unknown_suspicious")
    )
    a = a.withColumn("source", source)
    wrong = F.col("source").isin("invalid_pattern", "matra_match", "near_dictionary_match", "unknown_suspicious")
    return a.select(
        "w",
        F.when(wrong, "incorrect_spelling").otherwise("correct_spelling").alias("label"),
        "source",
        confidence(F.col("source"), F.col("distance")).alias("confidence"),
        reason(F.col("source"), F.col("found"), cand, F.col("stem")).alias("reason"),
        cand.alias("suggestion"),
    )


def classify(df: DataFrame, word: str, lexicon: DataFrame) -> DataFrame:
    """df with normalized_form, label, source, confidence, reason, suggestion.

    Decisions are made once per distinct normal form and joined back; raw punctuation overrides them."""
    rows = df.withColumn("normalized_form", normalize_word(F.col(word)))
    made = decide(rows.select(F.col("normalized_form").alias("w")).distinct(), lexicon)
    made = made.select(F.col("w").alias("normalized_form"), *[F.col(c).alias(f"_{c}") for c in ("label", "source", "confidence", "reason", "suggestion")])
    noise = F.coalesce(F.col(word).rlike(RAW_NOISE), F.lit(False))
    fixed = {"label": "incorrect_spelling", "source": "invalid_pattern", "confidence": "low", "reason": "Suspicious Hindi character pattern: punctuation_contamination.", "suggestion": None}
    joined = rows.drop(*fixed).join(made, "normalized_form")
    return joined.withColumns({c: F.when(noise, F.lit(v).cast("string")).otherwise(F.col(f"_{c}")) for c, v in fixed.items()}).drop(*[f"_{c}" for c in fixed])


def manual_label(c: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(v.isin("y", "yes", "correct", "correct_spelling", "c"), "correct_spelling").when(v.isin("n", "no", "incorrect", "incorrect_spelling", "i"), "incorrect_spelling")


def manual_response(c: Column) -> Column:
    """struct(label, note, skipped) of a reviewer's answer: a letter, then a note."""
    v = F.trim(F.coalesce(c, F.lit("")))
    pattern = r"^\s*([ynsYNScCiI])(?:[\s:,\-]+(.*))?$"
    token, note = F.lower(F.regexp_extract(v, pattern, 1)), F.trim(F.regexp_extract(v, pattern, 2))
    return F.struct(F.when(token != "s", manual_label(token)).alias("label"), note.alias("note"), ((v == "") | (token == "s")).alias("skipped"))


def audit(df: DataFrame, predicted: str, manual: str) -> DataFrame:
    """One row: counts of reviewed rows, and the share that the labels got right (null without rows)."""
    right = F.count_if(F.col(predicted) == F.col(manual))
    n = F.count("*")
    of = lambda c, v: F.count_if(F.col(c) == v)
    return df.agg(
        n.alias("annotated"),
        right.alias("system_right"),
        (n - right).alias("system_wrong"),
        F.bround(F.try_divide(right, n), 4).alias("accuracy"),
        of(predicted, "correct_spelling").alias("predicted_correct"),
        (n - of(predicted, "correct_spelling")).alias("predicted_incorrect"),
        of(manual, "correct_spelling").alias("manual_correct"),
        (n - of(manual, "correct_spelling")).alias("manual_incorrect"),
    )


def failure_kind(word: Column, predicted: Column, manual: Column, why: Column, source: Column, note: Column) -> Column:
    r, n = F.lower(F.coalesce(why, F.lit(""))), F.lower(F.coalesce(note, F.lit("")))
    has = lambda c, x: F.contains(c, F.lit(x))
    missed = (manual == "correct_spelling") & (predicted == "incorrect_spelling")
    return (
        F.when(F.coalesce(word.rlike("[,.;:|]"), F.lit(False)) | has(r, "punctuation") | has(n, "token"), "punctuation_or_tokenization_noise")
        .when(has(r, "english") | F.coalesce(source.isin("roman_english", "devanagari_english_strong", "devanagari_english_medium"), F.lit(False)), "code_mixed_or_borrowed_words")
        .when(missed & (has(r, "edit distance") | has(r, "match")), "over_aggressive_near_match_rules")
        .when(missed, "rare_valid_words_outside_lexicon")
        .when((manual == "incorrect_spelling") & (predicted == "correct_spelling"), "plausible_but_wrong_forms")
        .when(F.coalesce(source == "matra_match", F.lit(False)) | has(r, "matra") | has(r, "diacritic"), "matra_or_orthographic_variation")
        .otherwise("other_ambiguous_forms")
    )


def failures(df: DataFrame, index: str, k: int = 10, word: str = "word", predicted: str = "predicted_label", manual: str = "manual_label", why: str = "reason", source: str = "source", note: str = "reviewer_note") -> DataFrame:
    """Wrong rows by kind: kind, n (rows of the kind), rank, index, word; the first k of each kind."""
    wrong = df.where(F.col(predicted) != F.col(manual)).withColumn("kind", failure_kind(*[F.col(c) for c in (word, predicted, manual, why, source, note)]))
    n = wrong.groupBy("kind").agg(F.count("*").alias("n"))
    first = wrong.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(index))).where(F.col("rank") <= k)
    return first.join(n, "kind").select("kind", "n", "rank", F.col(index).alias("index"), F.col(word).alias("word"))


#: Why words of a kind of failure are hard to judge.
WHY = (
    ("punctuation_or_tokenization_noise", "Marks hold several words together, and the check sees one odd token."),
    ("code_mixed_or_borrowed_words", "English words in Devanagari look rare to rules that know Hindi words only."),
    ("over_aggressive_near_match_rules", "A rare but right word is taken for a typing error of a common one near it."),
    ("rare_valid_words_outside_lexicon", "Names, dialect and rare words are right, but a short word list lacks them."),
    ("plausible_but_wrong_forms", "The misspelling follows all rules of the script, so no rule objects."),
    ("matra_or_orthographic_variation", "Vowel signs vary between spellings that readers accept alike."),
    ("other_ambiguous_forms", "Only the sentence around the word could tell."),
)
#: What the accuracy of the reviewed rows means, from which accuracy on.
TAKEAWAYS = ((0.75, "reasonably_useful", "Unsure decisions are mostly right; borrowed and rare words fail most."), (0.5, "ambiguous", "Unsure decisions are truly open cases; the rules end where context is needed."), (0.0, "unreliable", "Unsure decisions are no better than chance; the rules follow the word list too closely."))


def takeaway(accuracy: Column) -> Column:
    """struct(code, meaning); not_estimated without reviewed rows."""
    out = F.when(accuracy.isNull(), F.struct(F.lit("not_estimated").alias("code"), F.lit("Nothing was reviewed.").alias("meaning")))
    for least, code, meaning in TAKEAWAYS:
        out = out.when(accuracy >= least, F.struct(F.lit(code).alias("code"), F.lit(meaning).alias("meaning")))
    return out


def unreliable(failed: DataFrame, kinds: int = 2, words: int = 5) -> DataFrame:
    """kind, n, why, words: the most frequent kinds of failures() (ties by kind) with their first words."""
    some = failed.where(F.col("rank") <= words).groupBy("kind", "n").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("w"))
    why = F.create_map(*[F.lit(x) for p in WHY for x in p])
    return some.orderBy(F.desc("n"), "kind").limit(kinds).select("kind", "n", why[F.col("kind")].alias("why"), F.transform("w", lambda x: x["word"]).alias("words"))


def ordered_counts(df: DataFrame, label: str = "label", confidence: str = "confidence") -> DataFrame:
    """place, label, confidence, n in the order of report: labels, then confidences from high to low; others last."""
    rank = lambda c, *names: F.coalesce(F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k)])[F.col(c)], F.lit(len(names)))
    g = df.groupBy(label, confidence).agg(F.count("*").alias("n"))
    place = rank(label, "correct_spelling", "incorrect_spelling") * 4 + rank(confidence, "high", "medium", "low")
    return g.select(place.alias("place"), label, confidence, "n").orderBy("place")


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


