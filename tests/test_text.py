import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lekhya.functions import english, numbers, repetition, similarity, text
from lekhya.functions.repetition import trim_tail
from lekhya.plans import queries


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_repair(spark):
    word = "अच्छा"
    bad = word.encode().decode("latin-1")
    got = column(spark, [bad, bad[:-1], "x" + bad, bad + "अ", "plain", None, "café", ""], text.repair_mojibake)
    assert got == [word, bad[:-1], "x" + word, bad + "अ", "plain", "", "café", ""]


def test_normal_forms(spark):
    values = ["  ａ  b|c।\n", None, "", "क़‍ख", "Hi, (x)‌!"]
    assert column(spark, values, text.normalize_spaces) == ["a b c", "", "", "क़‍ख", "Hi, (x)‌!"]
    assert column(spark, values, text.normalize_transcript) == ["a b c", "", "", "क़ ख", "Hi x"]
    assert column(spark, values, text.normalize_word) == ["abc।", "", "", "क़ख", "hix"]
    assert column(spark, values, text.utterance_tokens) == [["a", "bc।"], [], [], ["क़", "ख"], ["hi", "x"]]
    assert column(spark, values, text.comparison_tokens) == [["a", "b", "c"], [], [], ["क़", "ख"], ["Hi", "x"]]


def test_measures(spark):
    assert column(spark, ["aaab b", "", None, "a a", "ककक"], text.longest_character_run) == [3, 0, 0, 1, 3]
    assert column(spark, ["ab1 क!", None], text.content_characters) == [4, 0]
    assert column(spark, [["a", "b", "a"], []], text.dominant_fraction, "array<string>") == [2 / 3, 0.0]
    assert column(spark, ["x 1,200 ३४ y", None], text.digits) == [["1,200", "३४"], []]
    assert column(spark, ["a [EN]b[/EN] [EN]c d[/EN]"], text.tagged_terms) == [["b", "c d"]]
    assert column(spark, ["a" * 30, "b"], lambda c: text.truncate(c, 10)) == ["a" * 7 + "...", "b"]


def greedy_blocks(tokens, most, least=3):
    out, i = [], 0
    while i < len(tokens):
        for n in range(min(most, (len(tokens) - i) // least), 0, -1):
            k = 1
            while tokens[i + k * n : i + (k + 1) * n] == tokens[i : i + n]:
                k += 1
            if k >= least:
                out.append((tokens[i : i + n * k], n, k))
                i += n * k
                break
        else:
            i += 1
    return out


def test_repetition_against_a_scan(spark):
    r = random.Random(3)
    lists = [[r.choice("ab") if k % 3 else r.choice("abc") for _ in range(r.randrange(0, 30))] for k in range(300)]
    got = column(spark, lists, repetition.repetition_metrics, "array<string>")
    for tokens, m in zip(lists, got):
        blocks = greedy_blocks(tokens, 8)
        run = max((len(list(g)) for _, g in __import__("itertools").groupby(tokens)), default=0)
        assert m["max_token_run"] == run
        assert m["max_ngram_repeat"] == (max([k for _, _, k in blocks], default=1) if tokens else 0)
        assert m["repeated_token_ratio"] == pytest.approx(sum(len(b) for b, _, _ in blocks) / len(tokens) if tokens else 0)


@pytest.mark.parametrize("before, after", [("a b a b a b c", "a b c"), ("x a a a a y", "x a y"), ("a a b", "a a b"), ("ab abab ab ab", "ab abab ab ab"), ("p q r p q r p q r p q r z", "p q r z"), (" ".join(["a a a b"] * 3), "a b")])
def test_collapse(spark, before, after):
    assert column(spark, [before], repetition.clean_prediction) == [after]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=20))
def test_trim_tail_leaves_no_loop(tokens):
    out = trim_tail(list(tokens))
    assert out == tokens[: len(out)]
    for n in range(1, 5):
        assert not (len(out) >= 3 * n and out[-n:] == out[-2 * n : -n] == out[-3 * n : -2 * n])


NUMBERS = [
    ("गोदाम में तीन सौ चौवन बोरे बचे", "गोदाम में 354 बोरे बचे"),
    ("बाँध से एक हज़ार दो सौ घर दिखे", "बाँध से 1200 घर दिखे"),
    ("किला उन्नीस सौ निन्यानवे तक बंद रहा", "किला 1999 तक बंद रहा"),
    ("कुल बीस हजार ईंटें लगीं", "कुल 20000 ईंटें लगीं"),
    ("दो-चार आम तोड़ो", "दो-चार आम तोड़ो"),
    ("एक दो बार फिर देखो", "एक दो बार फिर देखो"),
    ("पेड़ पर एक चिड़िया थी", "पेड़ पर एक चिड़िया थी"),
    ("दस, बीस आम", "30 आम"),
    ("बीस तीस", "50"),
    ("सौ रुपये", "100 रुपये"),
    ("शून्य सौ", "100"),
    ("सड़सठ लोग", "सड़सठ लोग"),
    ("(दस लोग", "(दस लोग"),
    ("बीस तीस। दस", "50। 10"),
    ("plain  text", "plain text"),
    (None, None),
]


def test_numbers(spark):
    assert column(spark, [a for a, _ in NUMBERS], numbers.normalize_numbers) == [b for _, b in NUMBERS]
    assert column(spark, [[3, 100, 54], [1, 1000, 2, 100], [0, 100], [20, 30], []], numbers.fold_values, "array<int>") == [354, 1200, 100, 50, 0]
    assert len(numbers.NUMBERS) == 112 and max(numbers.NUMBERS.values()) == 1000


def test_number_totals(spark, tmp_path):
    """All number words are folded run by run, against brute force over random texts."""
    r = random.Random(3)
    words = ["सौ", "हजार", "हज़ार", "ह\u095bार", "दो", "तीन", "पाँच", "बीस", "चौवन", "घर", "और"]
    texts = [" ".join(r.choice(["", "", "", "("]) * (r.random() < 0.1) + r.choice(words) + r.choice(["", "", "", "।", ","]) for _ in range(r.randrange(12))) for _ in range(300)]
    texts += ["तीन सौ चौवन लोग", "दो हज़ार पाँच सौ रुपये और बीस", "एक लाख", "", None, "सौ\u3000बीस"]
    spark.createDataFrame(list(enumerate(texts)), "example_id long, raw_prediction string").write.parquet(f"{tmp_path}/q2_examples.parquet")
    got = {x["example_id"]: x for x in queries.number_totals(spark, str(tmp_path)).collect()}
    assert set(got) == {k for k, t in enumerate(texts) if t is not None}

    def brute(t):
        out, run, ended = [], [], False
        for lead, core, trail in map(numbers._affixes, unicodedata.normalize("NFKC", t).split()):
            v = numbers.NUMBERS.get(core.replace(numbers.NUKTA, ""))
            if run and (v is None or lead or ended):
                out.append(numbers.fold(run))
                run = []
            ended = v is not None and bool(trail) and bool(run)
            run += [v] if v is not None else []
        return out + ([numbers.fold(run)] if run else [])

    for k, t in enumerate(texts):
        if t is not None:
            assert got[k]["numbers"] == brute(t) and got[k]["total"] == sum(brute(t)), t
    assert [got[k]["numbers"] for k in (300, 301, 305)] == [[354], [2500, 20], [120]]


def test_english(spark):
    got = column(spark, ["कल garden में बैठे", "सिस्टम डेटा reload होगा", '"file", है', "[EN]फोन[/EN]", "  ", None], english.tag_english)
    assert got == ["कल [EN]garden[/EN] में बैठे", "[EN]सिस्टम[/EN] [EN]डेटा[/EN] [EN]reload[/EN] होगा", '"[EN]file[/EN]", है', "[EN]फोन[/EN]", "  ", None]


def test_similarity(spark):
    pairs = [("आराम", "राम", True, False), ("ये।", "ये", False, False), ("दस", "सौ", True, False), ("पाँच", "5", True, True), ("हाँ", "हां", True, True), ("", "a", False, False)]
    df = spark.createDataFrame(pairs, "a string, b string, s boolean, k boolean")
    for r in df.select("*", similarity.similar(F.col("a"), F.col("b")).alias("x"), (similarity.comparison_key(F.col("a")) == similarity.comparison_key(F.col("b"))).alias("y")).collect():
        assert (r["x"], r["y"]) == (r["s"], r["k"]), r
