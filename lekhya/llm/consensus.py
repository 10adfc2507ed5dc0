"""Problem 5: a consensus of several annotators' transcripts.

Every utterance's transcripts are aligned word by word to slots. Over all utterances, the share of slots on which two
annotators agree, less the share that would agree by chance, and corrected for how many slots both have, makes the
agreement matrix; its leading eigenvector, found by power iteration with joins over the sparse matrix, gives each
annotator's reliability. Reliabilities weigh the votes on each slot.

The reference takes part in the matrix as one more annotator (its errors are independent of the models'), but never
votes. Annotators that share errors agree with each other more than their skill warrants; what they err on alike is
taken out of the matrix (see reliabilities()), and where they vote alike their votes count for less (see winner()).

Null or empty outputs and null elements of the list are no votes. A slot with equal weights takes the vote of the
most reliable annotator, then the smaller word. An utterance without any output has consensus null and agreement
null. Words are compared without case, punctuation, spacing and look-alike characters. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhya.llm.forms import same_words
from lekhya.llm.run import cut

REFERENCE = "reference"


def align(base: list[str], other: list[str]) -> list[list[str]]:
    """Words of other by slot: slot 2i+1 is word i of base, slot 2i the gap before it."""
    n, m = len(base), len(other)
    slots: list[list[str]] = [[] for _ in range(2 * n + 1)]
    if base == other:
        for i, w in enumerate(base):
            slots[2 * i + 1] = [w]
        return slots
    a = 0
    while a < n and a < m and base[a] == other[a]:
        slots[2 * a + 1] = [base[a]]
        a += 1
    b = 0
    while b < n - a and b < m - a and base[n - 1 - b] == other[m - 1 - b]:
        b += 1
        slots[2 * (n - b) + 1] = [base[n - b]]
    x, y = base[a : n - b], other[a : m - b]
    p, q = len(x), len(y)
    near = [[0.0] * q for _ in range(p)]
    for i in range(p):
        for j in range(q):
            near[i][j] = 0.0 if x[i] == y[j] else 1.0 + (0.9 if x[i][:1] != y[j][:1] and x[i][-1:] != y[j][-1:] else 0.0)
    cost = [[0.0] * (q + 1) for _ in range(p + 1)]
    for i in range(p + 1):
        cost[i][0] = float(i)
    cost[0] = [float(j) for j in range(q + 1)]
    for i in range(1, p + 1):
        for j in range(1, q + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + near[i - 1][j - 1], cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    i, j = p, q
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + near[i - 1][j - 1]:
            i, j = i - 1, j - 1
            slots[2 * (a + i) + 1] = [y[j]]
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
            slots[2 * (a + i)].insert(0, y[j])
    return slots


def slots_of(transcripts: dict[str, list[str]]) -> dict[str, list[str]]:
    """Word (or '' for none) of every annotator by slot; the base is the transcript nearest to all others."""
    counts = Counter(" ".join(t) for t in transcripts.values())
    bag = Counter(w for t in transcripts.values() for w in set(t))
    base = min(transcripts.values(), key=lambda t: (-counts[" ".join(t)], -sum(bag[w] for w in set(t)) / (len(t) + 1), len(t), t))
    same: dict[str, list[list[str]]] = {}
    rows = {}
    for name, t in transcripts.items():
        key = " ".join(t)
        if key not in same:
            same[key] = align(base, t)
        rows[name] = same[key]
    keep = [k for k in range(2 * len(base) + 1) if k % 2 or any(r[k] for r in rows.values())]
    out: dict[str, list[str]] = {n: [] for n in rows}
    for k in keep:
        width = 1 if k % 2 else max(len(r[k]) for r in rows.values())
        for n, r in rows.items():
            out[n] += (r[k] + [""] * width)[:width]
    return out


def _aligned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for uid, ref, outputs in zip(pdf["u"], pdf["r"], pdf["m"]):
            said = {}
            for o in outputs if outputs is not None else ():
                if o is not None and o["name"] is not None and (w := same_words(o["text"])):
                    said.setdefault(o["name"], w)
            r = same_words(ref)
            if r:
                said[REFERENCE] = r
            if not said:
                rows.append((uid, [], []))
                continue
            s = slots_of(said)
            names = sorted(s)
            rows.append((uid, names, ["\x1f".join(s[n]) for n in names]))
        yield pd.DataFrame(rows, columns=["u", "names", "slots"])


def aligned(df: DataFrame, id_col: str, reference: str, outputs: str) -> DataFrame:
    """u, names (array), slots (array of the annotators' words joined by U+001F)."""
    rows = df.select(F.col(id_col).alias("u"), F.col(reference).alias("r"), F.col(outputs).alias("m"))
    return rows.mapInPandas(_aligned, f"u {dict(rows.dtypes)['u']}, names array<string>, slots array<string>")


def winner(heard: list[str], order: list[str], weights: dict[str, float], shared: dict[tuple[str, str], float]) -> tuple[str, float]:
    """The word of a slot and its share of the votes. order: annotators, most reliable first; heard: their words.

    Of annotators that vote alike, each weighs 1 / (1 + what it shares of its errors with the others)."""
    groups: dict[str, list[str]] = {}
    for a, w in zip(order, heard):
        groups.setdefault(w, []).append(a)
    if len(groups) == 1:
        return heard[0], 1.0
    votes = {w: sum(weights.get(a, 0.05) / (1 + sum(shared.get((a, b), 0.0) for b in g if b != a)) for a in g) for w, g in groups.items()}
    best = max(votes.values())
    word = min((w for w, x in votes.items() if math.isclose(x, best, rel_tol=1e-9)), key=lambda w: (order.index(groups[w][0]), w))
    return word, votes[word] / sum(votes.values())


def agreements(slots: DataFrame, weights: dict[str, float], shared: dict[tuple[str, str], float]) -> DataFrame:
    """By pair of annotators: n (slots both have), same (equal ones), wrong (equal ones the weighted vote goes against).

    Without weights there is no vote and nothing is wrong."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[str, str], list[float]] = {}
        for pdf in frames:
            for names, packed in zip(pdf["names"], pdf["slots"]):
                names = list(names)
                words = [s.split("\x1f") for s in packed]
                n = len(words[0]) if words else 0
                hard = [k for k in range(n) if any(w[k] != words[0][k] for w in words)]
                order = sorted((a for a in names if a != REFERENCE), key=lambda a: (-weights.get(a, 0.05), a))
                at = {a: words[names.index(a)] for a in order}
                right = {k: winner([at[a][k] for a in order], order, weights, shared)[0] for k in hard} if weights and order else {}
                for i, a in enumerate(names):
                    for j in range(i + 1, len(names)):
                        t = total.setdefault((a, names[j]), [0, 0, 0])
                        t[0] += n
                        t[1] += n
                        for k in hard:
                            if words[i][k] != words[j][k]:
                                t[1] -= 1
                            elif right and words[i][k] != right[k]:
                                t[2] += 1
        if total:
            yield pd.DataFrame([(a, b, *v) for (a, b), v in total.items()], columns=["a", "b", "n", "same", "wrong"])

    part = slots.mapInPandas(count, "a string, b string, n double, same double, wrong double")
    return part.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "same", "wrong")]).where("n > 0")


def _word_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        words = Counter(w for slots in pdf["slots"] for s in slots for w in s.split("\x1f"))
        if words:
            yield pd.DataFrame(words.items(), columns=["w", "n"])


def chance(slots: DataFrame) -> float:
    """Probability that two words drawn at random are equal."""
    words = slots.mapInPandas(_word_counts, "w string, n double").groupBy("w").agg(F.sum("n").alias("n"))
    r = words.agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q")).first()
    return r["q"] / r["s"] ** 2 if r["s"] else 0.0


def agreement_matrix(pairs: DataFrame, by_chance: float) -> DataFrame:
    """Sparse matrix a, b, n, same, wrong, x (agreement other than in shared errors, above chance), trust.

    Pairs of annotators that met on few slots count for less, by n / (n + 100). Both directions; no diagonal."""
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", "same", "wrong"))
    agree = (F.col("same") - F.col("wrong")) / F.col("n")
    return both.select("*", F.greatest(F.lit(0.0), (agree - by_chance) / (1 - by_chance)).alias("x"), (F.col("n") / (F.col("n") + 100)).alias("trust"))


def leading_eigenvector(matrix: DataFrame, steps: int = 8) -> DataFrame:
    """a, v: leading eigenvector of x, scaled so that x(a, b) is about v(a) v(b); power iteration by joins.

    The matrix has no diagonal, and some pairs count for less (trust) or are missing; each entry is therefore
    divided by the vector's own weight over the pairs present, which makes up for diagonal and overlaps alike. An
    entry's old value comes along on the diagonal, so that a step is one join and one aggregation and the plan grows
    by as much with each."""
    old = F.lit(None).cast("double")
    links = matrix.select("a", "b", "x", "trust").unionAll(matrix.select("a").distinct().select("a", F.col("a").alias("b"), old, old))
    links = cut(links)
    v = links.where("a = b").select("a", F.lit(0.9).alias("v"))
    for _ in range(steps):
        met = links.join(v.select(F.col("a").alias("b"), F.col("v").alias("vb")), "b")
        found = F.sum(F.col("trust") * F.col("x") * F.col("vb")) / F.sum(F.col("trust") * F.col("vb") * F.col("vb"))
        own = F.max(F.when(F.col("a") == F.col("b"), F.col("vb")))
        # the mean of old and new entry keeps the iteration from swinging between two scales
        v = met.groupBy("a").agg(((own + F.coalesce(found, own)) / 2).alias("v"))
    return cut(v)


def reliabilities(slots: DataFrame, rounds: int = 2) -> tuple[list[tuple[str, float, float]], dict[tuple[str, str], float]]:
    """(annotator, reliability 0..1, weight of its vote), and by pair the part of a's errors that b makes too.

    Annotators that err together agree more than their skill explains. After a first fit, the votes show on which
    words pairs err alike; these agreements are taken out of the matrix and the eigenvector is found again."""
    by_chance, weights, shared, trust = chance(slots), {}, {}, []
    for k in range(rounds + 1):
        m = cut(agreement_matrix(agreements(slots, weights, shared), by_chance))
        if not k and m.select("a").distinct().limit(MAX_ANNOTATORS + 1).count() > MAX_ANNOTATORS:
            raise ValueError(f"more than {MAX_ANNOTATORS} annotators")
        v = F.least(F.lit(0.9995), F.greatest(F.lit(0.01), F.col("v")))
        rows = leading_eigenvector(m).select("a", v.alias("v")).collect()
        trust = sorted((r["a"], r["v"], max(0.05, math.log(r["v"] / (1 - r["v"])))) for r in rows)
        weights = {a: w for a, _, w in trust}
        skill = {a: v for a, v, _ in trust}
        if k:
            shared = {(r["a"], r["b"]): min(1.0, r["wrong"] / r["n"] / (1 - skill[r["a"]])) for r in m.where("wrong > 0").collect()}
            shared = {p: x for p, x in shared.items() if x > 0.05}
    return trust, shared


def vote(slots: DataFrame, weights: dict[str, float], shared: dict[tuple[str, str], float]) -> DataFrame:
    """u, consensus, agreement (mean share of votes for its words), n, differs (from the reference, null without one)."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for u, names, packed in zip(pdf["u"], pdf["names"], pdf["slots"]):
                said = dict(zip(names, (p.split("\x1f") for p in packed)))
                ref = said.pop(REFERENCE, None)
                if not said:
                    rows.append((u, None, None, 0, None))
                    continue
                order = sorted(said, key=lambda a: (-weights.get(a, 0.05), a))
                won = [winner(heard, order, weights, shared) for heard in zip(*(said[a] for a in order))]
                text = " ".join(w for w, _ in won if w)
                differs = None if ref is None else text.replace(" ", "") != "".join(ref)
                rows.append((u, text, sum(x for _, x in won) / len(won) if won else None, len(said), differs))
            yield pd.DataFrame(rows, columns=["u", "consensus", "agreement", "n", "differs"])

    return slots.mapInPandas(count, f"u {dict(slots.dtypes)['u']}, consensus string, agreement double, n int, differs boolean")


#: The annotators are a bounded set; more are refused.
MAX_ANNOTATORS = 1_000


def consensus(df: DataFrame, id_col: str = "utterance_id", reference: str = "reference", outputs: str = "model_outputs") -> tuple[DataFrame, DataFrame]:
    """(id_col, consensus, agreement, n, differs) per utterance, and (annotator, reliability, weight)."""
    slots = cut(aligned(df, id_col, reference, outputs))
    trust, shared = reliabilities(slots)
    voted = vote(slots, {a: w for a, _, w in trust}, shared).withColumnRenamed("u", id_col)
    return voted, df.sparkSession.createDataFrame(trust, "annotator string, reliability double, weight double")
