"""Problems 1, 2 and 4 against brute force, with odd cases."""

import itertools
import random
import unicodedata

from pyspark.sql import functions as F

from lekhya.llm import copies, encoding, lookalikes, queries
from lekhya.llm.forms import same_words

SCHEMA = "sample_id long, recording_id long, word string, normalized_word string, g int, i int, n int"


def canon(t):
    return "".join(c for c in t.lower() if not unicodedata.category(c).startswith("P") and c not in " \t\n\r\x0b\f")


def test_copies(spark):
    r = random.Random(2)
    words = ["Ab c", "ab,c", "ABC", "abc!", "क ख", "कख।", "", "...", None, "a bc", "x" * 50_000, "X" * 50_000 + "."]
    rows = [(k, r.choice([1, 1, 1, 2, None]), r.choice(words), r.choice(words), 1, 2, 3) for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    groups = {}
    for k, g, a, b, *_ in rows:
        if None not in (g, a, b):
            groups.setdefault((g, *sorted((canon(a), canon(b)))), []).append(k)
    want = {(v[0], k) for v in groups.values() for k in v[1:]}
    got = [tuple(x) for x in copies.copies(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {(x["first_id"], x["n_copies"]) for x in copies.collapse(df).collect()} == {(v[0], len(v)) for v in groups.values()}
    assert copies.copies(df.limit(0)).count() == copies.collapse(df.limit(0)).count() == 0


HINDI = "रेलगाड़ी देर से मिला पड़ोस अच्छा लगा किताब घर बाज़ार मौसम त्योहार कहानी सफ़र रास्ता किराया स्कूल छुट्टी परसों टोली बोली ऑफिस ऐसा औरत उल्का".split()


def swap(text, page):
    out = []
    for b in text.encode():
        try:
            out.append(bytes([b]).decode(page))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def test_garbled_text_is_found_and_restored(spark):
    r = random.Random(4)
    clean = [" ".join(r.choices(HINDI, k=5)) for _ in range(300)]
    right = ["café", "Übung", "книга", "θάλασσα", "£40", "½", "«नाम»", "Ângela", "Ãvore", "ﬁt", "vеmo x", "ｆｕｌｌ", "", None]
    bad = [(swap(t, p), t) for p in ("latin-1", "cp1252", "cp437", "mac_roman", "koi8_r") for t in clean[:12]]
    bad += [(swap(swap(t, "cp1252"), "cp1252"), t) for t in clean[12:16]] + [("kal " + swap("é’", "cp437"), "kal é’"), ("घर " + swap("पड़ोस", "koi8_r") + " में", "घर पड़ोस में")]
    broken = ["मुक�थि", swap("किताब", "cp1252")[:-1]]
    texts = clean + right + [b for b, _ in bad] + broken
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("text", F.lit("x"))
    src = encoding.sources_of((df, "t"))
    assert {p for s in src for p in s.pages} >= {"cp437", "mac_roman", "koi8_r"}
    got = {x["row_id"]: x for x in encoding.garbled(df, src, "id", "t").collect()}
    first = len(clean) + len(right)
    assert set(got) == set(range(first, len(texts)))
    for k, (_, t) in enumerate(bad):
        assert (got[first + k]["restored"], got[first + k]["restorable"]) == (t, True)
    assert not any(got[first + len(bad) + k]["restorable"] for k in range(len(broken)))
    assert encoding.sources_of((df.limit(0), "t")) == [] and encoding.garbled(df.limit(0), [], "id", "t").count() == 0


def test_unknown_page_is_learned_from_bigrams(spark):
    """A page that no published table has, and no tables at all: Devanagari, accented letters and punctuation."""
    r = random.Random(5)
    letters = [chr(c) for c in (*range(0x915, 0x929), *range(0x92A, 0x931), 0x932, *range(0x935, 0x93A), *range(0x93E, 0x944), 0x947, 0x94B, 0x902, 0x94D)]
    after = {c: r.choices(letters, [1 / (1 + k) ** 1.5 for k in range(len(letters))], k=12) for c in letters}

    def word():
        out = [letters[int(r.random() ** 2 * len(letters))]]
        while len(out) < 3 or r.random() < 0.6:
            out.append(r.choice(after[out[-1]]))
        return "".join(out)

    symbols = r.sample([chr(c) for c in range(0x13A0, 0x1400) if chr(c).isprintable()] + [chr(c) for c in range(0x10A0, 0x10C6)], 128)
    garble = lambda t: "".join(chr(b) if b < 128 else symbols[b - 128] for b in t.encode())
    words = [word() for _ in range(6000)]
    clean = [" ".join(words[k : k + 4]) for k in range(0, 6000, 4)] + [f"caf{c}{k}" for k in range(20) for c in "éèôé"] + [f"so{c} yes{k}" for k in range(20) for c in "’…–’…"]
    bad = [" ".join(word() for _ in range(2)) for _ in range(900)] + [f"b{k}{c}" for k in range(15) for c in "éè’…–"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(clean + [garble(t) for t in bad])], "id long, t string")
    src = encoding.learn(df.select("t"), published={})
    assert [s.lead for s in src] == [symbols[0x60]] and src[0].pages == ()
    got = {x["row_id"]: x for x in encoding.garbled(df, src, "id", "t").collect()}
    found = [k for k in range(len(bad)) if len(clean) + k in got]
    assert len(found) == len(got) and len(found) >= 0.95 * len(bad)
    right = total = 0
    for k in found[:800]:
        for x, y in zip(bad[k], got[len(clean) + k]["restored"]):
            right, total = right + (x == y), total + 1
    assert right >= 0.85 * total


ALIKE = ["office", "\u043effice", "\uff4f\uff46\uff46\uff49\uff43\uff45", "of\u200bfice", "o\ufb03ce", "Office", "office!", "आज", "\u0905\u093eज", "\u0958लम", "\u0915\u093cलम", "caf\u00e9", "cafe\u0301", "cafe", "a b", "a\u00a0b", "a  b", "a\tb", "12", "\u0967\u0968", "", None]
CLASS = [0, 0, 0, 0, 0, 1, 2, 3, 3, 4, 4, 5, 5, 6, 7, 7, 8, 9, 10, 11, 12, None]


def test_lookalikes(spark):
    rows = [(k, g, a, b) for k, (g, a, b) in enumerate((g, a, b) for g in (1, None) for a in ALIKE for b in ALIKE[:9])]
    df = spark.createDataFrame(rows, "sample_id long, recording_id long, word string, normalized_word string").withColumn("g", F.lit(1)).withColumn("t0", F.lit("z"))
    cls = dict(zip(ALIKE, CLASS))
    ok = [(k, (a, b), (cls[a], cls[b])) for k, g, a, b in rows if g and None not in (a, b)]
    want = {(x[0], y[0]) for x, y in itertools.combinations(ok, 2) if x[2] == y[2] and x[1] != y[1]}
    got = [tuple(r) for r in lookalikes.pairs(df, "sample_id", "recording_id", ["word", "normalized_word"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    c = lookalikes.consistent(df, "sample_id", "recording_id", ["word"]).select("canonical_word").distinct().collect()
    nfc = lambda t: unicodedata.normalize("NFC", t)
    assert len(c) == 5 and {nfc(r[0]) for r in c} == {nfc(t) for t in ("office", "आज", "क़लम", "café", "a b")}
    assert lookalikes.pairs(df.limit(0), "sample_id", "recording_id", ["word"]).count() == 0


def test_every_row_gets_a_consistent_form(spark):
    rows = [(k, g, a, b) for k, (g, a, b) in enumerate((g, a, b) for g in (1, 1, None) for a in ALIKE for b in [None, *ALIKE[:9]])]
    df = spark.createDataFrame(rows, "sample_id long, recording_id long, word string, normalized_word string").withColumn("g", F.lit(1)).withColumn("own", F.lit("z"))
    cls = dict(zip(ALIKE, CLASS))
    got = {r["sample_id"]: r for r in lookalikes.consistent_all(df, "sample_id", "recording_id", ["word", "normalized_word"], F.col("sample_id") % 50 != 0).collect()}
    assert len(got) == len(rows) and all((got[k]["canonical_word"] is None, got[k]["canonical_normalized_word"] is None, got[k]["recording_id"]) == (a is None, b is None, g) for k, g, a, b in rows)
    forms, classes = {}, {}
    for k, g, a, b in rows:
        if g and k % 50:
            forms.setdefault((cls[a], cls[b]), set()).add((got[k]["canonical_word"], got[k]["canonical_normalized_word"]))
            classes.setdefault((cls[a], cls[b]), set()).add((a, b))
    assert all(len(f) == 1 for f in forms.values()) and len({x for f in forms.values() for x in f}) == len(forms)
    assert all(got[k]["n_forms"] == (len(classes[cls[a], cls[b]]) if g and k % 50 else 1) for k, g, a, b in rows)
    alone = {a: got[k]["canonical_word"] for k, g, a, b in rows if g is None and b is None}
    assert alone["ｏｆｆｉｃｅ"] == alone["of\u200bfice"] == "office" and alone[""] == ""
    assert lookalikes.consistent_all(df.limit(0), "sample_id", "recording_id", ["word"]).count() == 0


def test_consistent_query_has_all_rows_of_both_tables(spark, tmp_path):
    spark.createDataFrame([(1, 7, "ｆｕｌｌ", "full"), (2, 7, "full", "full"), (3, 7, "अाज", None), (4, None, "a", "b"), (5, 7, "मुक�थि", "x")], "sample_id long, recording_id long, word string, normalized_word string").write.parquet(f"{tmp_path}/q3_low_confidence_samples.parquet")
    spark.createDataFrame([(1, "s1", "अाज घर"), (2, "s1", "आज घर"), (3, "s2", "оk"), (4, "s3", None)], "row_idx long, segment_url string, reference string").write.parquet(f"{tmp_path}/task_records.parquet")
    got = {(r["source_table"][0], r["sample_id"] or r["row_idx"]): r for r in queries.p4_consistent(spark, str(tmp_path)).collect()}
    assert len(got) == 9
    assert [got["q", k]["canonical_word"] for k in range(1, 6)] == ["full", "full", "आज", "a", "मुक�थि"] and [got["q", k]["n_forms"] for k in range(1, 6)] == [2, 2, 1, 1, 1]
    assert [got["t", k]["canonical_reference"] for k in range(1, 5)] == ["आज घर", "आज घर", "ok", None]


def test_same_words():
    assert same_words("The оﬃce, अाज!") == ["the", "office", "आज"] and same_words(None) == same_words("") == []
