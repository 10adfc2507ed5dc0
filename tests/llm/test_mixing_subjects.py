"""Problems 8 and 9."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lekhya.llm import mixing, subjects
from lekhya.llm.subjects import roman


def test_mixture(spark):
    r = random.Random(1)
    rows = [(k, s, r.randrange(0, 40)) for k, s in enumerate(r.choices(["a", "b", "c", "other", None], [60, 25, 5, 5, 5], k=3000))] + [(9000, "a", 0)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").withColumn("s", F.lit(1)).withColumn("d", F.lit(1))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 6), ("none", 0.1, 3), ("bad", None, 1)], "source string, target_share double, max_repeats int")
    out = mixing.mixture(sized, targets).collect()
    tokens = {s: sum(n for _, x, n in rows if x == s) for s in "abc"}
    budget = min(tokens["a"] / (5 / 9 / 1.0 * 0.9), tokens["b"] * 2 / 0.3, tokens["c"] * 6 / 0.2)
    total = sum(x["n_tokens"] for x in out)
    assert total <= budget and total > 0.98 * budget
    size = {d: n for d, _, n in rows}
    assert all(size[x["doc_id"]] == x["n_tokens"] for x in out)
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        own = [x for x in out if x["source"] == s]
        assert sum(x["n_tokens"] for x in own) / total == pytest.approx(share, abs=0.02)
        assert max(x["use"] for x in own) <= {"a": 1, "b": 2, "c": 6}[s]
    assert len({(x["doc_id"], x["use"]) for x in out}) == len(out)
    running = [x["running_tokens"] for x in out]
    assert running == sorted(running) and running[-1] == total
    half = out[: len(out) // 2]
    assert sum(x["n_tokens"] for x in half if x["source"] == "a") / sum(x["n_tokens"] for x in half) == pytest.approx(0.5, abs=0.05)
    rep = {x["source"]: x for x in mixing.shares(mixing.mixture(sized, targets), targets).collect()}
    assert rep["none"]["actual_share"] == 0 and rep["c"]["most_uses"] > 1
    assert mixing.mixture(sized.limit(0), targets).count() == mixing.mixture(sized, targets.limit(0)).count() == 0
    assert sum(x["n_tokens"] for x in mixing.mixture(sized, targets, budget=1000).collect()) <= 1000


@pytest.mark.skipif(not os.path.exists(mixing.VOCABULARY), reason="no tokenizer files")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "a", "hello world"), (2, "b", None), (3, "c", "")], "doc_id long, source string, text string")
    got = {x["doc_id"]: x["n_tokens"] for x in mixing.token_counts(df, ["doc_id"], "text").collect()}
    assert got[1] in (2, 3) and got[2] == got[3] == 0


def test_roman():
    for a, b in (("गन्ना", "ganna"), ("खेत", "khet"), ("सिंचाई", "sinchaee"), ("ट्रैक्टर", "traiktar"), ("ज़मानत", "zamanat")):
        assert roman(a) == roman(b)


TOPICS = {"sea": "boat wave harbour sail anchor tide fish net".split(), "sky": "cloud wing pilot storm wind star moon kite".split(), "art": "paint brush canvas frame colour sketch clay museum".split()}
SMALL = "the a we you that was here there and today they went with some of it".split()


def sentence(r, topic):
    words = r.choices(SMALL, k=6) + (r.choices(TOPICS[topic], k=3) if topic else r.choices(SMALL, k=3)) + ["n" + "".join(r.choices("aeiou", k=6))]
    r.shuffle(words)
    return " ".join(words)


def test_subjects(spark, monkeypatch):
    r = random.Random(5)
    examples = [(k, t, ". ".join(sentence(r, t if r.random() < 0.8 else None) for _ in range(3))) for k, t in enumerate(list(TOPICS) * 12)] + [(99, None, "x"), (98, "sea", None)]
    docs, want = [], set()
    for d in range(300):
        own = r.sample(list(TOPICS), r.choice([0, 1, 1, 2]))
        parts = [sentence(r, t) for t in own for _ in range(4)] + [sentence(r, None) for _ in range(4)]
        r.shuffle(parts)
        docs.append((d, (" " if d % 4 == 0 else ". ").join(parts)))
        want |= {(d, t) for t in own}
    docs += [(900, None), (901, ""), (902, "!!!"), (903, " ".join(sentence(r, None) for _ in range(5_000)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("subject", F.lit("x")).withColumn("d", F.lit(1))
    ex = spark.createDataFrame(examples, "example_id long, subject string, text string")
    got = [(x["doc_id"], x["subject"]) for x in subjects.subjects_of(df, ex).collect()]
    hit = len(set(got) & want)
    assert len(got) == len(set(got)) and hit / len(got) > 0.93 and hit / len(want) > 0.93
    assert not {d for d, _ in got} & {900, 901, 902, 903}
    # the same whatever the partitions, and however their gradients are added up
    monkeypatch.setattr(subjects, "FAN_IN", 2)
    again = {(x["doc_id"], x["subject"]) for x in subjects.subjects_of(df.repartition(7), ex).collect()}
    assert len(again ^ set(got)) <= 2
    assert subjects.subjects_of(df.limit(0), ex).count() == 0 and subjects.subjects_of(df, ex.limit(0)).count() == 0


def test_gradient():
    """What partitions hand back is the derivative of the loss by each part's scores."""
    texts = ["wave harbour. the boat went there", "cloud and wind", "", "we paint"]
    b = subjects.Block.of(texts, subjects.Forms())
    u = subjects.Units(subjects.Texts(b, np.full(subjects.BUCKETS, 0.5, np.float32)))
    r = np.random.default_rng(1)
    scores, bias = r.normal(size=(3 * subjects.BUCKETS, 2)), r.normal(size=2)
    y, c = r.integers(0, 2, (len(u.own), 2)).astype(float), r.random((len(u.own), 2))

    def loss(s):
        p = 1 / (1 + np.exp(-u.outputs(s, bias)))
        return -(c * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    g = subjects.Gradient.unpack(u.gradient(scores, bias, y, c).pack(), 2)
    assert len(u.own) == 4 and list(u.own) == [0, 0, 1, 3]
    for k in (0, 3, len(g.at) - 1):
        moved = scores.copy()
        moved[g.at[k], 1] += 1e-4
        assert (loss(moved) - loss(scores)) / 1e-4 == pytest.approx(g.g[k, 1], abs=1e-3)
