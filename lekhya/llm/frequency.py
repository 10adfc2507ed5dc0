"""Problem 6: occurrences and records of every distinct term, with a mark on rare and common ones.

Burst tries: every task counts its terms in a trie whose leaves are small containers; a container that grows past
BURST terms bursts into one per next character, below the characters that its terms have in common. A task hands its
trie over as subtrees of bounded size, each with the prefix that leads to it, written to the shared folder.

From the sizes of the subtrees follow the routing prefixes: a prefix with more than ROUTE_TERMS terms below it, over
all tasks, is split into its next characters, so that crowded parts of the alphabet get long prefixes and others short
ones. Routes in order of their prefixes are packed to tasks of like size and rows are sent to these tasks by route
alone. A task takes one route after the other and merges its subtrees node by node into one trie.

Only distinct terms of a task travel, so a hot term costs one entry per task. The routing prefixes (one for about
ROUTE_TERMS terms) are all that comes to the driver. Nulls are no terms. Whole values may be empty, which is a term;
pieces are never empty. Terms of any length are kept whole. An empty table gives an empty result.
"""

from __future__ import annotations

import marshal
from bisect import bisect_right
from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhya.llm.run import cut

#: A leaf container bursts beyond this many terms.
BURST = 64
#: Terms below a routing prefix beyond which it is split.
ROUTE_TERMS = 100_000
#: Distinct terms of a task that are counted before its trie is handed over and started anew.
HELD = 200_000
#: The same for their characters.
HELD_CHARACTERS = 50_000_000
#: A task's trie is handed over in subtrees of at most a SUBTREES-th of its terms, and of PIECE terms.
SUBTREES, PIECE = 256, 500

Counts = list[int]  # occurrences, records


class BurstTrie:
    """Counts of terms.

    A node is a leaf (a dict of suffixes) or an inner node: skip (characters that all its terms have next), end (the
    counts of the term that ends there) and kids by next character. size: number of terms below."""

    __slots__ = ("leaf", "skip", "kids", "end", "size")

    def __init__(self, leaf: dict[str, Counts] | None = None) -> None:
        self.leaf: dict[str, Counts] | None = {} if leaf is None else leaf
        self.skip, self.kids, self.end, self.size = "", {}, None, len(self.leaf)

    def add(self, term: str, occurrences: int = 1, records: int = 1, limit: int = BURST) -> bool:
        """Adds to the counters of a term; True if it is new."""
        path, node, at = [], self, 0
        while True:
            path.append(node)
            if node.leaf is not None:
                held = node.leaf.get(term[at:])
                if held is None:
                    node.leaf[term[at:]] = [occurrences, records]
                break
            if node.skip:
                if not term.startswith(node.skip, at):
                    node._part(len(commonprefix((node.skip, term[at : at + len(node.skip)]))))
                at += len(node.skip)
            if at == len(term):
                held = node.end
                if held is None:
                    node.end = [occurrences, records]
                break
            kid = node.kids.get(term[at])
            if kid is None:
                kid = node.kids[term[at]] = BurstTrie()
            node, at = kid, at + 1
        if held is not None:
            held[0] += occurrences
            held[1] += records
            return False
        for n in path:
            n.size += 1
        if node.leaf is not None and len(node.leaf) > limit:
            node._burst(limit)
        return True

    def _part(self, n: int) -> None:
        """Splits the skipped characters after the first n."""
        kid = BurstTrie()
        kid.leaf, kid.skip, kid.kids, kid.end, kid.size = self.leaf, self.skip[n + 1 :], self.kids, self.end, self.size
        self.skip, self.kids, self.end = self.skip[:n], {self.skip[n]: kid}, None

    def _burst(self, limit: int) -> None:
        todo = [self]
        while todo:
            node = todo.pop()
            terms, node.leaf = node.leaf, None
            node.skip = commonprefix((min(terms), max(terms)))
            n = len(node.skip)
            for t, counts in terms.items():
                if len(t) == n:
                    node.end = counts
                else:
                    node.kids.setdefault(t[n], BurstTrie()).leaf[t[n + 1 :]] = counts
            for kid in node.kids.values():
                kid.size = len(kid.leaf)
                if kid.size > limit:
                    todo.append(kid)

    def containers(self, prefix: str = "") -> Iterator[tuple[str, dict[str, Counts]]]:
        """(prefix, suffixes with their counts) of every leaf, and of every term that ends at an inner node."""
        stack = [(prefix, self)]
        while stack:
            p, n = stack.pop()
            if n.leaf is not None:
                if n.leaf:
                    yield p, n.leaf
                continue
            p += n.skip
            if n.end is not None:
                yield p, {"": n.end}
            stack.extend((p + c, k) for c, k in n.kids.items())

    def items(self, prefix: str = "") -> Iterator[tuple[str, int, int]]:
        for p, leaf in self.containers(prefix):
            for s, (o, r) in leaf.items():
                yield p + s, o, r

    def subtrees(self, most: int) -> Iterator[tuple[str, "BurstTrie"]]:
        """(prefix, node) of disjoint subtrees of at most so many terms (or single leaves) that hold all terms."""
        stack = [("", self)]
        while stack:
            p, n = stack.pop()
            if n.size <= most or n.leaf is not None:
                if n.size:
                    yield p, n
                continue
            p += n.skip
            if n.end is not None:
                yield p, BurstTrie({"": n.end})
            stack.extend((p + c, k) for c, k in n.kids.items())

    def graft(self, prefix: str, leaf: dict[str, Counts], limit: int = BURST) -> None:
        """Merges a container that another trie has under the prefix: into the leaf at that place as a whole where
        there is one, else term by term below it."""
        path, node, at = [], self, 0
        while node.leaf is None and at < len(prefix):
            if node.skip and not prefix.startswith(node.skip, at):
                break
            if at + len(node.skip) >= len(prefix):
                break
            path.append(node)
            at += len(node.skip)
            kid = node.kids.get(prefix[at])
            if kid is None:
                kid = node.kids[prefix[at]] = BurstTrie()
            node, at = kid, at + 1
        rest = prefix[at:]
        if node.leaf is None:
            before = node.size
            for s, (o, r) in leaf.items():
                node.add(rest + s, o, r, limit)
            new = node.size - before
        else:
            new = 0
            for s, (o, r) in leaf.items():
                held = node.leaf.get(rest + s)
                if held is None:
                    node.leaf[rest + s] = [o, r]
                    new += 1
                else:
                    held[0] += o
                    held[1] += r
            node.size += new
            if len(node.leaf) > limit:
                node._burst(limit)
        for n in path:
            n.size += new


def _tries(frames: Iterator[pd.DataFrame]) -> Iterator[BurstTrie]:
    """Tries over frames with an array column terms, one row being one record."""
    trie, characters = BurstTrie(), 0
    for pdf in frames:
        for terms in pdf["terms"]:
            seen = set()
            for t in terms:
                if trie.add(t, 1, int(t not in seen)):
                    characters += len(t)
                seen.add(t)
            if trie.size >= HELD or characters >= HELD_CHARACTERS:
                yield trie
                trie, characters = BurstTrie(), 0
    if trie.size:
        yield trie


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for trie in _tries(frames):
        rows = []
        for p, node in trie.subtrees(max(1, min(PIECE, trie.size // SUBTREES))):
            rows.append((p, node.size, marshal.dumps(list(node.containers()))))
        for a in range(0, len(rows), 500):
            yield pd.DataFrame(rows[a : a + 500], columns=["prefix", "size", "subtree"])


def routes(subtrees: DataFrame, most: int = ROUTE_TERMS) -> tuple[frozenset[str], dict[str, int]]:
    """(prefixes that are split, sizes of the routes they leave): a route is a split prefix with one more character,
    or the term that ends with it.

    A prefix is split if more than so many terms lie below it. Found level by level, so that only crowded branches
    are looked into; characters that all subtrees of a branch have in common are skipped in one step."""
    whole = subtrees.agg(F.sum("size").alias("n"), F.min("prefix").alias("a"), F.max("prefix").alias("b")).first()
    split: set[str] = set()
    size = {"": int(whole["n"] or 0)}
    found = [("", whole["a"] or "", whole["b"] or "")]
    while True:
        level: dict[int, list[str]] = {}  # by length
        for p, a, b in found:
            if size[p] > most:
                end = commonprefix((a, b))
                split.update(end[:n] for n in range(len(p), len(end) + 1))
                size.update((end[:n], size[p]) for n in range(len(p) + 1, len(end) + 1))
                level.setdefault(len(end), []).append(end)
        if not level:
            return frozenset(split), {p: n for p, n in size.items() if p not in split}
        # a subtree that ends at a split prefix has its terms below, but at no one place
        branch = [F.when((F.length("prefix") > n) & F.substring("prefix", 1, n).isin(ps), F.substring("prefix", 1, n + 1)) for n, ps in level.items()]
        by = subtrees.select("size", "prefix", F.coalesce(*branch).alias("p")).where("p is not null").groupBy("p")
        found = []
        for r in by.agg(F.sum("size").alias("n"), F.min("prefix").alias("a"), F.max("prefix").alias("b")).collect():
            size[r["p"]] = int(r["n"])
            found.append((r["p"], r["a"], r["b"]))


def route_of(term: str, split: frozenset[str]) -> str:
    """The route of a term or of a subtree's prefix: one character more than the last prefix that is split."""
    n = 0
    while n < len(term) and term[:n] in split:
        n += 1
    return term[:n]


def placement(sizes: dict[str, int], tasks: int) -> tuple[list[str], list[int]]:
    """First routes of each task and their numbers: routes in order, packed to tasks of about the same size."""
    whole, done, begins = max(1, sum(sizes.values())), 0, [("", 0)]
    for p in sorted(sizes):
        task = min(tasks - 1, done * tasks // whole)
        if task > begins[-1][1]:
            begins.append((p, task))
        done += sizes[p]
    return [p for p, _ in begins], [k for _, k in begins]


def count_terms(terms: DataFrame, most: int = ROUTE_TERMS) -> DataFrame:
    """term, occurrences, records over rows with an array column terms (one row is one record)."""
    spark = terms.sparkSession
    subtrees = cut(terms.select("terms").where("terms is not null").mapInPandas(_cut, "prefix string, size long, subtree binary"))
    split, sizes = routes(subtrees, most)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts, numbers = placement(sizes, tasks)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for prefix, subtree in zip(pdf["prefix"], pdf["subtree"]):
                route = route_of(prefix, split)
                if route not in split:
                    rows.append((route, prefix, subtree))
                    continue
                parted: dict[str, dict[str, Counts]] = {}  # a subtree above a split goes to several routes
                for p, leaf in marshal.loads(subtree):
                    for s, c in leaf.items():
                        parted.setdefault(route_of(prefix + p + s, split), {})[prefix + p + s] = c
                rows.extend((r, "", marshal.dumps([("", leaf)])) for r, leaf in parted.items())
            tasks_of = [numbers[bisect_right(firsts, r) - 1] for r, _, _ in rows]
            yield pd.DataFrame({"task": tasks_of, "route": [r for r, _, _ in rows], "prefix": [p for _, p, _ in rows], "subtree": [t for _, _, t in rows]})

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        route, trie = None, BurstTrie()

        def out() -> Iterator[pd.DataFrame]:
            rows = list(trie.items())
            for a in range(0, len(rows), 20_000):
                yield pd.DataFrame(rows[a : a + 20_000], columns=["term", "occurrences", "records"])

        for pdf in frames:
            for r, prefix, subtree in zip(pdf["route"], pdf["prefix"], pdf["subtree"]):
                if r != route:
                    yield from out()
                    route, trie = r, BurstTrie()
                for p, leaf in marshal.loads(subtree):
                    trie.graft(prefix + p, leaf)
        yield from out()

    sent = subtrees.mapInPandas(send, "task int, route string, prefix string, subtree binary")
    placed = sent.repartitionById(tasks, F.col("task")).sortWithinPartitions("route")
    return placed.select("route", "prefix", "subtree").mapInPandas(merge, "term string, occurrences long, records long")


def mark(counts: DataFrame, n_records: int, common_share: float) -> DataFrame:
    """Adds mark: 'rare' for terms of one record, else 'common' for those in at least the share of all records."""
    m = F.when(F.col("records") == 1, "rare").when(F.col("records") >= F.lit(n_records * common_share), "common")
    return counts.withColumn("mark", m)


def pieces(df: DataFrame, text: str) -> DataFrame:
    """Records' terms between spaces, tabs, line feeds and no-break spaces."""
    return df.select(F.expr(f"filter(split({text}, '[ \\\\t\\\\n\\\\u00A0]+'), x -> x <> '')").alias("terms"))


def values(df: DataFrame, text: str) -> DataFrame:
    """Records' terms where the whole value is the term."""
    return df.where(F.col(text).isNotNull()).select(F.array(F.col(text)).alias("terms"))
