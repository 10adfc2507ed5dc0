"""Problems 3 and 6 against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lekhya.llm import frequency, repetition


def repeated(words):
    n, marks = len(words), set()
    for i in range(n - 5):
        if any(words[j : j + 6] == words[i : i + 6] for j in range(i - 5)):
            marks |= set(range(i, i + 6))
    for p in range(1, 13):
        i = 0
        while i + p < n:
            k = 0
            while i + p + k < n and words[i + k] == words[i + p + k]:
                k += 1
            if k // p >= 2:
                marks |= set(range(i + p, i + p + k // p * p))
            i += max(1, k) if k else 1
    return marks


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=4))
def test_marks(texts):
    words = np.array([w for t in texts for w in t], dtype=np.int64)
    own = np.array([i for i, t in enumerate(texts) for _ in t], dtype=np.int64)
    got = repetition.repeated_words(words, own)
    at = 0
    for t in texts:
        assert {k for k in range(len(t)) if got[at + k]} == repeated(t)
        at += len(t)


def test_measure(spark):
    loop = "देखिए यह घर " * 40
    rows = [(1, "a b c d"), (2, loop), (3, None), (4, ""), (5, "..."), (6, "one two three four five six seven. One, two three four five six seven!"), (7, "x " * 30_000), (8, "fine words stay here\nHome | About us | Help\nfine end"), (9, "good\nhttps://example.org/a/b\n-- ** a ** --\na > b > c"), (10, "a b c d e f g. h a b c d e f")]
    df = spark.createDataFrame(rows, "example_id long, before string").withColumn("id", F.lit("q")).withColumn("t", F.lit(0))
    got = {r["example_id"]: r for r in repetition.measure(df, "example_id", "before").collect()}
    assert len(got) == 10 and [got[k]["rejected"] for k in range(1, 11)] == [False, True, False, False, False, True, True, True, True, True]
    assert sorted(r["example_id"] for r in repetition.repetitive(repetition.measure(df, "example_id", "before")).collect()) == [2, 6, 7, 10]
    assert got[2]["n_repeated"] == 117 and got[6]["share"] == 0.5 and got[7]["n_repeated"] == 29_999 and got[3]["kept"] is None
    assert got[8]["kept"] == "fine words stay here\nfine end" and (got[8]["n_failed"], got[8]["n_lost"], got[8]["n_words"], got[8]["share"]) == (1, 4, 10, 0.0)
    assert got[9]["kept"] == "good" and got[9]["n_failed"] == 3 and (got[10]["n_lost"], got[10]["n_repeated"]) == (7, 6)
    assert repetition.measure(df.limit(0), "example_id", "before").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.text("ab", max_size=9), max_size=120), max_size=4), st.integers(1, 6), st.integers(1, 40))
def test_burst_tries_merge(lists, limit, most):
    want, merged = Counter(), frequency.BurstTrie()
    for terms in lists:
        trie, own = frequency.BurstTrie(), Counter()
        for t in terms:
            assert trie.add("long common " + t, 2, 1, limit) == (t not in own)
            own[t] += 1
        assert {t: (o, n) for t, o, n in trie.items()} == {"long common " + t: (2 * c, c) for t, c in own.items()} and trie.size == len(own)
        held = 0
        for p, node in trie.subtrees(most):
            assert node.size <= most or node.leaf is not None
            held += node.size
            for q, leaf in node.containers():
                merged.graft(p + q, leaf, limit)
        assert held == len(own)
        want += own
    assert {t: (o, n) for t, o, n in merged.items()} == {"long common " + t: (2 * c, c) for t, c in want.items()} and merged.size == len(want)


def test_deep_trie():
    """Terms that are prefixes of each other, and long ones that differ at the end only."""
    trie = frequency.BurstTrie()
    terms = ["a" * k for k in range(3000)] + ["x" * 50_000 + str(k) for k in range(200)]
    for t in terms:
        trie.add(t)
    assert sorted(t for t, _, _ in trie.items()) == sorted(terms)


def test_routes_place_terms(spark):
    """Crowded prefixes are split, a route's terms meet in one task, and routes hold about as many terms as they may."""
    r = random.Random(3)
    terms = [f"https://example.org/{r.randrange(30_000)}" for _ in range(8000)] + [r.choice("bcd") * 3 + str(k) for k in range(300)] + ["https://example.org/", "", "h"]
    df = spark.createDataFrame([([t],) for t in terms], "terms array<string>").repartition(5)
    subtrees = frequency.cut(df.mapInPandas(frequency._cut, "prefix string, size long, subtree binary"))
    split, sizes = frequency.routes(subtrees, 500)
    assert "https://example.org/" in split and "bbb" not in split and max(sizes.values()) <= 500 and len(split) > 20
    assert frequency.route_of("bbb7", split) == "b" and frequency.route_of("https://example.org/", split) == "https://example.org/"
    firsts, numbers = frequency.placement(sizes, 4)
    assert numbers == sorted(set(numbers)) and len(numbers) == 4 and firsts == sorted(firsts)
    got = {x["term"]: x["occurrences"] for x in frequency.count_terms(df, 500).collect()}
    assert got == Counter(terms)
    where = frequency.count_terms(df, 500).select("term", F.spark_partition_id().alias("task")).collect()
    tasks = {}
    for x in where:
        tasks.setdefault(frequency.route_of(x["term"], split), set()).add(x["task"])
    assert all(len(v) == 1 for v in tasks.values()) and len(set.union(*tasks.values())) == 4


def test_counts(spark):
    r = random.Random(6)
    texts = [None if k % 50 == 0 else " ".join(r.choice(["हाँ", "a", "b", f"w{r.randrange(400)}", " ", "A", "लंबा" * 3000]) for _ in range(r.randrange(8))) for k in range(600)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i long, t string").withColumn("term", F.lit(1)).withColumn("route", F.lit(1))
    got = {x["term"]: (x["occurrences"], x["records"]) for x in frequency.count_terms(frequency.pieces(df, "t")).collect()}
    occ, rec = Counter(), Counter()
    for t in texts:
        terms = [x for x in re.split("[ \t\n ]+", t or "") if x]
        occ.update(terms)
        rec.update(set(terms))
    assert got == {t: (occ[t], rec[t]) for t in occ}
    whole = {x["term"]: x["occurrences"] for x in frequency.count_terms(frequency.values(df, "t")).collect()}
    assert whole == Counter(t for t in texts if t is not None)
    marks = {x["term"]: x["mark"] for x in frequency.mark(frequency.count_terms(frequency.pieces(df, "t")), 588, 1 / 20).collect()}
    assert all(marks[t] == ("rare" if rec[t] == 1 else "common" if rec[t] >= 29.4 else None) for t in rec)
    assert frequency.count_terms(frequency.values(df.limit(0), "t")).count() == 0


def test_empty_batch():
    assert list(repetition._measure(iter([pd.DataFrame({"id": [], "t": []})]))) == []
