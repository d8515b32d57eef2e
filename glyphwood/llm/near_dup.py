"""MinHash near-dedup: a chosen-path set similarity join.

Documents are sets of word shingles. A document's minwise tokens are its least shingles under independent orders. Each of
several independent trees branches documents by the minwise token at a chosen order: a node holds the documents that agree
on all tokens of its path, so similar documents tend to stay together. Small nodes are compared exhaustively by sketches
(one byte of each of 128 minwise tokens), larger ones branch again. A node that still holds more than a fixed share of all
documents (there are few such nodes: the share bounds their number) isn't gathered: in the first levels each of its
documents is compared with the node's pivots, the members that agree most with large nodes in all trees, and it branches on
until it isn't hot, or DEPTH tokens of its members agree. What then stays together is looked at MOST_HELD rows at a time.

Candidates are confirmed on the full sets, and the confirmed links' components give the result. Documents with equal sets
are one vertex from the start, so copies never multiply. Links are wanted for what they connect: a node first gives a
spanning forest of its candidates, those that agree most before others. Once these are confirmed, nodes that had more
candidates are looked at again, and give all candidates that lie between two components: the same components come out as
if all had been confirmed, and a group of near copies gives pairs in proportion to its size.

Defined results: a document without words (or with a null text) has an empty set, is linked with nothing and is its own
component; one with fewer words than a shingle has its whole word sequence as its only shingle; the smallest doc_id of a
component names it; repeated rows are copies of each other, and rows that share an id are one vertex; null ids never name a component unless all its ids are null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, forget, map_arrow, small_batches, table, tidy, word_hashes, written
from .suffix_dedup import _joined

SHINGLE, PERCENT = 5, 80
#: Hot levels that have pivots, levels in all, those looked at together once a node is hot; minwise tokens.
LEVELS, DEPTH, TOGETHER, TOKENS = 4, 62, 8, 128


def trees_for(recall: float, similarity: float, depth: int) -> int:
    """Trees of which one at least keeps a pair together for `depth` tokens with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth))


#: Wanted share of the pairs just at the threshold that meet, if all their nodes are hot at every level; independent trees.
RECALL = 0.99
TREES = trees_for(RECALL, PERCENT / 100, 1 + LEVELS)
#: Documents of a node that are compared exhaustively in one go.
SMALL = 256
#: A node with more than one in HOT of all documents, and than LEAST_HOT, is compared with PIVOTS pivots. At most HOT * TREES * LEVELS nodes are.
HOT, LEAST_HOT, PIVOTS = 2000, SMALL, 4
#: Sketch agreement that makes a candidate (0.8 less four deviations).
MAYBE = 0.66
#: Rows of one node that a task holds; members of it that later rows of it meet, if it has more.
MOST_HELD, CARRIED = 60_000, 64
#: Edges of a contracted graph that one task may join.
MOST_AT_ONCE = 10_000

_rng = np.random.Generator(np.random.PCG64(977))
_FACTORS = _rng.integers(0, 1 << 63, TOKENS, np.uint64) * np.uint64(2) + np.uint64(1)
#: The order that each tree branches by at each level; the first TREES orders are the trees' first.
_CHOSEN = np.array([[t, *(_rng.permutation(np.arange(TREES, TOKENS))[: 63])] for t in range(TREES)])


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Distinct shingles of each text as sorted 64-bit identifiers."""
    ids, counts = word_hashes([(t or "").encode() for t in texts])
    out, at = [], 0
    for n in counts.tolist():
        own, at = ids[at : at + n], at + n
        parts = min(size, n)
        if n:
            joined = _joined(np.full(n - parts + 1, parts, np.uint64), own[: n - parts + 1])
            for k in range(1, parts):
                joined = _joined(joined, own[k : n - parts + 1 + k])
            own = np.unique(joined)
        out.append(own)
    return out


def minwise(own: np.ndarray) -> np.ndarray:
    """The least of the set under each order, as 32-bit tokens."""
    best = None
    for at in range(0, len(own), 2048):
        part = ((own[at : at + 2048, None] * _FACTORS[None, :]) >> np.uint64(32)).min(axis=0)
        best = part if best is None else np.minimum(best, part)
    return best.astype(np.uint32)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, name (of the set), heads (the trees' first tokens), sketch."""

    def make(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n", "name", "heads", "sketch")}
        for i, own in zip(cols["doc_id"], shingle_sets(cols["text"], size), strict=True):
            row = (i, 0, None, None, None)
            if len(own):
                tokens = minwise(own)
                row = (i, len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), tokens[:TREES].tobytes(), (tokens & np.uint32(255)).astype(np.uint8).tobytes())
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
        return out

    return map_arrow(docs.select("doc_id", "text"), make, "doc_id long, n long, name binary, heads binary, sketch binary", "near")


def matrix(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def deeper(node: np.ndarray, tokens: np.ndarray, level: int) -> np.ndarray:
    """The nodes below those of a level, by the tokens that come next."""
    return _joined(node, tokens.astype(np.uint64) + np.uint64(level << 8))


def branch(heads: np.ndarray, sketch: np.ndarray, hot: list[np.ndarray], upto: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document and tree: its node at the first level where that isn't hot, `upto` at most, and that level."""
    node = _joined(np.broadcast_to(np.arange(TREES, dtype=np.uint64), heads.shape), heads.astype(np.uint64))
    level = np.zeros(heads.shape, np.int64)
    for k in range(upto):
        on = (level == k) & np.isin(node, hot[k])
        if not on.any():
            break
        node, level = np.where(on, deeper(node, sketch[:, _CHOSEN[:, k + 1]], k), node), np.where(on, k + 1, level)
    return node, level


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def spanning(pairs: np.ndarray, n: int) -> np.ndarray:
    """Indices of pairs that form a forest, in their order."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for k, (a, b) in enumerate(pairs.tolist()):
        a, b = root(a), root(b)
        if a != b:
            up[a] = b
            out.append(k)
    return np.array(out, np.int64), np.array([root(x) for x in range(n)])


def likely(sizes: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (places) of a few documents that may be similar, those that agree most first."""
    a, b = np.triu_indices(len(sizes), 1)
    fit = 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
    a, b = a[fit], b[fit]
    agree = np.concatenate([(sketch[a[k : k + 4096]] == sketch[b[k : k + 4096]]).mean(axis=1) for k in range(0, len(a), 4096)] or [np.zeros(0)])
    order = np.argsort(-agree, kind="stable")
    order = order[agree[order] >= least_agreement(percent)]
    return np.stack([a[order], b[order]], axis=1)


def least_agreement(percent: int) -> float:
    return MAYBE - (0.8 - percent / 100)


#: What a node gives: pairs to be confirmed first, and sets of members whose other pairs may have to be (places of the
#: members, the hub that alone is paired with the others, or -1).
Found = tuple[np.ndarray, list[tuple[np.ndarray, int]]]


def compare(sizes: np.ndarray, sketch: np.ndarray, percent: int) -> Found:
    """A forest of the likely pairs among a few documents, and the members of all others."""
    pairs = likely(sizes, sketch, percent)
    forest = spanning(pairs, len(sizes))[0]
    rest = np.ones(len(pairs), bool)
    rest[forest] = False
    return pairs[forest], [(np.unique(pairs[rest]), -1)] if rest.any() else []


def join_node(sizes: np.ndarray, sketch: np.ndarray, percent: int, tree: int, level: int, small: int = SMALL) -> Iterator[tuple[np.ndarray, Found]]:
    """Members (places) and findings of the small nodes of a node: branches by its tree's own orders until nodes are small,
    then compares."""
    agreement = least_agreement(percent)
    todo, entry = [(np.arange(len(sizes)), level)], level
    while todo:
        own, level = todo.pop()
        part = sketch[own]
        if len(own) <= small:
            yield own, compare(sizes[own], part, percent)
            continue
        if level > DEPTH:  # all agree on half of their tokens: who isn't near the first is compared with all
            near = (part == part[0]).mean(axis=1) >= agreement
            at, rest = np.flatnonzero(near)[1:], np.flatnonzero(~near)
            yield own, (np.stack([at, np.zeros(len(at), np.int64)], axis=1), [])
            for k in range(0, len(rest), small // 2):
                for j in range(0, len(own), small // 2):
                    both = own[np.unique(np.concatenate([rest[k : k + small // 2], np.arange(j, min(j + small // 2, len(own)))]))]
                    yield both, compare(sizes[both], sketch[both], percent)
            continue
        tokens = part[:, _CHOSEN[tree, level]]
        values, counts = np.unique(tokens, return_counts=True)
        if level == entry and counts.max() > 0.7 * len(own):  # mostly alike: each is compared with the members that agree most with all
            common = (part == np.array([np.bincount(c, minlength=256).argmax() for c in part.T])).sum(axis=1)
            for k, p in enumerate(np.argsort(-common, kind="stable")[:PIVOTS].tolist()):
                near = np.flatnonzero((part == part[p]).mean(axis=1) >= agreement)
                near = near[near != p]
                pairs = np.stack([near, np.full(len(near), p)], axis=1)
                yield own, (pairs, []) if k == 0 else (pairs[:0], [(np.append(near, p), p)] if len(near) else [])
        todo += [(own[tokens == v], level + 1) for v in values[counts > 1].tolist()]


PAIRS_DDL = "a long, b long, x long, y long"
FOUND_DDL = "a long, b long, uid long, hub boolean, n long, sketch binary"


def framed(pairs: list[np.ndarray]) -> pd.DataFrame:
    """Distinct pairs as a frame, the lesser id first."""
    rows = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    rows = np.unique(np.sort(rows, axis=1), axis=0) if len(rows) else rows
    return pd.DataFrame({"a": rows[:, 0], "b": rows[:, 1]})


class Nodes:
    """The tree's nodes that are hot, and their pivots. What is here is bounded by HOT, trees and levels."""

    def __init__(self, reps: DataFrame, total: int, percent: int):
        self.reps, self.percent, self.small, self.most_held = reps, percent, SMALL, MOST_HELD
        #: What may be compared exhaustively isn't hot, whatever the table's size.
        self.least = max(total // HOT, LEAST_HOT, SMALL)
        self.hot: list[np.ndarray] = []
        step = 1
        while len(self.hot) <= DEPTH - 1:
            found = self._hot_from(len(self.hot), min(step, DEPTH - len(self.hot)))
            self.hot += found
            step = TOGETHER
            if not len(found[-1]):
                break
        while self.hot and not len(self.hot[-1]):
            self.hot.pop()
        self.starred = min(len(self.hot), LEVELS)
        self.pivots = self._best() if self.hot else {}

    def __getstate__(self) -> dict:
        """What tasks get along."""
        return {k: v for k, v in self.__dict__.items() if k != "reps"}

    def _hot_from(self, first: int, levels: int) -> list[np.ndarray]:
        """Hot nodes of some levels: members of hot nodes are counted at all of them at once."""
        hot = list(self.hot)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    sketch = matrix(f["sketch"], "u1")
                    node, at = branch(matrix(f["heads"], "<u4"), sketch, hot, first)
                    row, tree = np.nonzero(at == first)
                    own, parts = node[row, tree], []
                    for k in range(first, first + levels):
                        if k > first:
                            own = deeper(own, sketch[row, _CHOSEN[tree, k]], k - 1)
                        keys, counts = np.unique(own, return_counts=True)
                        parts.append(pd.DataFrame({"level": k, "node": signed(keys), "count": counts}))
                    yield pd.concat(parts)

        counted = self.reps.select("heads", "sketch").mapInPandas(tidy("near", run), "level int, node long, count long")
        rows = counted.groupBy("level", "node").agg(F.sum("count").alias("n")).filter(F.col("n") > self.least).select("level", "node").collect()
        out: list[list[int]] = [[] for _ in range(levels)]
        for level, node in rows:
            out[level - first].append(node)
        return [np.array(sorted(x), np.int64).view(np.uint64) for x in out]

    def on(self, heads: np.ndarray, sketch: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Each document's node at a level by tree, and where that is hot."""
        node, at = branch(heads, sketch, self.hot, level)
        return node, (at == level) & np.isin(node, self.hot[level])

    def _best(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        def popular(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Of each frame, the best pivots of each hot node."""
            for f in frames:
                if not len(f):
                    continue
                heads, sketch = matrix(f["heads"], "<u4"), matrix(f["sketch"], "u1")
                score, nodes = np.zeros(len(f), np.int64), []
                for k in range(self.starred):
                    node, on = self.on(heads, sketch, k)
                    score += on.sum(axis=1)
                    nodes.append((node, on))
                ids = f["a"].to_numpy()
                parts = []
                for node, on in nodes:
                    row, tree = np.nonzero(on)
                    parts.append(pd.DataFrame({"node": signed(node[row, tree]), "score": score[row], "a": ids[row], "row": row}))
                best = pd.concat(parts).sort_values(["score", "a"], ascending=[False, True]).groupby("node").head(PIVOTS)
                yield best.assign(sketch=f["sketch"].to_numpy()[best["row"]])[["node", "score", "a", "sketch"]]

        best = self.reps.select("a", "heads", "sketch").mapInPandas(tidy("near", popular), "node long, score long, a long, sketch binary")
        order = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "a", "sketch"))), 1, PIVOTS)
        return {r[0]: (np.array([p["a"] for p in r[1]]), np.array([np.frombuffer(p["sketch"], np.uint8) for p in r[1]])) for r in best.groupBy("node").agg(order.alias("p")).collect()}

    def pivot_ids(self) -> DataFrame:
        return self.reps.sparkSession.createDataFrame([(int(p),) for p in sorted({x for own, _ in self.pivots.values() for x in own.tolist()})], "a long")

    def near_pivots(self, f: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each hot node of a frame's documents: places, its pivots' ids, and the agreement of each pivot with each (0
        where it is too little, or a pivot itself)."""
        heads, sketch, ids = matrix(f["heads"], "<u4"), matrix(f["sketch"], "u1"), f["a"].to_numpy()
        for k in range(self.starred):
            node, on = self.on(heads, sketch, k)
            for x in np.unique(signed(node[on])).tolist():
                members = np.flatnonzero((on & (signed(node) == x)).any(axis=1))
                agree = np.stack([(sketch[members] == own).mean(axis=1) for own in self.pivots[x][1]])
                agree[(self.pivots[x][0][:, None] == ids[members]) | (agree < least_agreement(self.percent))] = 0
                yield members, self.pivots[x][0], agree

    def first(self) -> DataFrame:
        """Of FOUND_DDL: pairs (a, b) to be confirmed first, in forests of their nodes; and, with a uid, members whose other
        pairs are looked at again once components are known."""
        percent, hot = self.percent, self.hot

        def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Each document's nodes that are not hot (or can't be branched further)."""
            for f in frames:
                if len(f):
                    node, at = branch(matrix(f["heads"], "<u4"), matrix(f["sketch"], "u1"), hot, len(hot))
                    row, tree = np.nonzero(at >= 0)
                    yield pd.DataFrame({"node": signed(node[row, tree]), "tree": tree, "level": at[row, tree], "a": f["a"].to_numpy()[row], "n": f["n"].to_numpy()[row], "sketch": f["sketch"].to_numpy()[row]})

        def inside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Nodes, whose rows follow each other."""
            from pyspark import TaskContext

            uid = TaskContext.get().partitionId() << 40
            held: pd.DataFrame | None = None
            for f in frames:
                held = f if held is None else pd.concat([held, f], ignore_index=True)
                if len(held) < 20_000:
                    continue
                tail = held["node"] == held["node"].iloc[-1]
                if not tail.all():
                    yield self._found(held[~tail], uid)
                    held = held[tail].reset_index(drop=True)
                elif len(held) >= self.most_held:  # only a node that stayed hot to the last level is as large
                    yield self._found(held, uid)
                    held = held[:CARRIED]
                else:
                    continue
                uid += 1 << 24
            if held is not None and len(held):
                yield self._found(held, uid)

        small_batches(self.reps.sparkSession, 4000)
        cold = self.reps.select("a", "n", "heads", "sketch").mapInPandas(tidy("near", rows), "node long, tree int, level int, a long, n long, sketch binary")
        shuffled = cold.repartition(int(self.reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node").sortWithinPartitions("node")
        out = shuffled.mapInPandas(tidy("near", inside), FOUND_DDL)
        if not self.pivots:
            return out

        def stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Each document with the best pivot of each of its hot nodes."""
            for f in frames:
                if len(f):
                    ids, pairs = f["a"].to_numpy(), []
                    for members, pivots, agree in self.near_pivots(f):
                        best, near = agree.argmax(axis=0), agree.max(axis=0) > 0
                        pairs.append(np.stack([ids[members[near]], pivots[best[near]]], axis=1))
                    yield framed(pairs).assign(uid=None, hub=False, n=0, sketch=None).astype({"uid": "Int64"})

        return out.unionByName(self.reps.select("a", "heads", "sketch").mapInPandas(tidy("near", stars), FOUND_DDL))

    def _found(self, f: pd.DataFrame, uid: int) -> pd.DataFrame:
        node = f["node"].to_numpy()
        cuts = np.flatnonzero(np.diff(node)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(node)]])
        several = ends - starts > 1
        ids, sizes, tree, level, raw = (f[c].to_numpy() for c in ("a", "n", "tree", "level", "sketch"))
        chosen = np.repeat(several, ends - starts)
        sketch = np.zeros((len(f), TOKENS), np.uint8)
        if chosen.any():
            sketch[chosen] = matrix(f["sketch"][chosen], "u1")
        pairs: list[np.ndarray] = []
        again: list[tuple[int, int, bool]] = []
        for s, e in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
            if e - s == 2:
                if 100 * min(sizes[s], sizes[s + 1]) >= self.percent * max(sizes[s], sizes[s + 1]) and (sketch[s] == sketch[s + 1]).mean() >= least_agreement(self.percent):
                    pairs.append(ids[None, s : s + 2])
                continue
            for own, (forest, groups) in join_node(sizes[s:e], sketch[s:e], self.percent, int(tree[s]), int(level[s]) + 1, self.small):
                at = own + s
                pairs.append(ids[at[forest]])
                for members, hub in groups:
                    again += [(int(x), uid, bool(k == hub)) for k, x in zip(members.tolist(), at[members].tolist(), strict=True)]
                    uid += 1
        one = framed(pairs).assign(uid=None, hub=False, n=0, sketch=None)
        where = [x for x, _, _ in again]
        two = pd.DataFrame({"a": ids[where], "b": None, "uid": [u for _, u, _ in again], "hub": [h for _, _, h in again], "n": sizes[where], "sketch": raw[where]}) if again else one[:0]
        return pd.concat([one.astype({"b": "Int64", "uid": "Int64"}), two.astype({"b": "Int64", "uid": "Int64"})], ignore_index=True)

    def later(self, again: DataFrame, found: DataFrame) -> DataFrame:
        """Of PAIRS_DDL: all likely pairs (a, b) that the components found(v, c) leave apart, and these components."""
        percent = self.percent
        named = found.toDF("a", "c")

        def inside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Groups, whose rows follow each other; a group has SMALL members, or a hub."""
            rest: pd.DataFrame | None = None
            for f in frames:
                held = f if rest is None else pd.concat([rest, f], ignore_index=True)
                last = held["uid"] == held["uid"].iloc[-1]
                hub = held["hub"] & last
                yield across(held[~last])
                rest = held[last]
                if len(rest) > self.most_held and hub.any():  # a hub stays, its members may go
                    yield across(rest)
                    rest = held[hub]
            if rest is not None:
                yield across(rest)

        def across(f: pd.DataFrame) -> pd.DataFrame:
            out = [np.zeros((0, 4), np.int64)]
            for _, g in f.groupby("uid"):
                ids, c = g["a"].to_numpy(), g["c"].to_numpy()
                if (c == c[0]).all():
                    continue
                hub = np.flatnonzero(g["hub"].to_numpy())
                if len(hub):
                    pairs = np.stack([np.arange(len(ids)), np.full(len(ids), hub[0])], axis=1)
                else:
                    pairs = likely(g["n"].to_numpy(), matrix(g["sketch"], "u1"), percent)
                pairs = pairs[c[pairs[:, 0]] != c[pairs[:, 1]]]
                out.append(np.stack([ids[pairs[:, 0]], ids[pairs[:, 1]], c[pairs[:, 0]], c[pairs[:, 1]]], axis=1))
            return ordered(out)

        def ordered(parts: list[np.ndarray]) -> pd.DataFrame:
            rows = np.concatenate(parts)
            rows = np.where((rows[:, 0] > rows[:, 1])[:, None], rows[:, [1, 0, 3, 2]], rows)
            return pd.DataFrame(np.unique(rows, axis=0) if len(rows) else rows, columns=["a", "b", "x", "y"])

        with_c = lambda df: df.join(named, "a", "left").withColumn("c", F.coalesce("c", "a"))
        small_batches(self.reps.sparkSession, 4000)
        dealt = with_c(again.select("a", "uid", "hub", "n", "sketch")).repartition(int(self.reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "uid").sortWithinPartitions("uid", F.desc("hub"))
        out = dealt.mapInPandas(tidy("near", inside), PAIRS_DDL)
        if self.pivots:
            of = {r.a: r.c for r in with_c(self.pivot_ids()).collect()}

            def stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for f in frames:
                    if len(f):
                        ids, c, parts = f["a"].to_numpy(), f["c"].to_numpy(), [np.zeros((0, 4), np.int64)]
                        for members, pivots, agree in self.near_pivots(f):
                            names = np.array([of[p] for p in pivots.tolist()])
                            q, m = np.nonzero((agree > 0) & (names[:, None] != c[members]))
                            parts.append(np.stack([ids[members[m]], pivots[q], c[members[m]], names[q]], axis=1))
                        yield ordered(parts)

            out = out.unionByName(with_c(self.reps.select("a", "heads", "sketch")).mapInPandas(tidy("near", stars), PAIRS_DDL))
        return out.filter("a <> b").distinct()


def sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id, own: the full set of each document of ids(doc_id); no other text becomes a set again."""
    texts = docs.select("doc_id", "text").join(ids.distinct(), "doc_id", "left_semi")

    def sets(cols: dict[str, list]) -> dict[str, list]:
        return {"id": cols["doc_id"], "own": [own.tobytes() for own in shingle_sets(cols["text"], size)]}

    return written(map_arrow(texts, sets, "id long, own binary", "near"), "near-sets")


def confirmed(own: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b, x, y): (x, y), as a and b, of those whose full sets are similar."""

    def check(cols: dict[str, list]) -> dict[str, list]:
        keep = []
        for p, q in zip(cols["own_a"], cols["own_b"], strict=True):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
            keep.append(100 * both >= percent * (len(p) + len(q) - both))
        pick = lambda c: [v for v, k in zip(c, keep, strict=True) if k]
        return {"a": pick(cols["x"]), "b": pick(cols["y"])}

    small_batches(own.sparkSession, 500)
    half = pairs.join(own.select(F.col("id").alias("b"), F.col("own").alias("own_b")), "b")
    return map_arrow(half.join(own.select(F.col("id").alias("a"), F.col("own").alias("own_a")), "a"), check, "a long, b long", "near")


def linked(docs: DataFrame, nodes: Nodes, size: int, percent: int) -> DataFrame:
    """v, c: the components of all candidates that are similar. Forests of nodes are confirmed first; then every likely pair
    that lies between two of the components found so far, whose links are links between components."""
    firsts = written(nodes.first(), "near-found")
    pairs = checkpointed(firsts.filter("uid IS NULL AND a <> b").select("a", "b").distinct())
    # every member of a later pair is known by now, so texts are fetched once
    members = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(firsts.filter("uid IS NOT NULL").select(F.col("a").alias("doc_id")))
    if nodes.pivots:
        members = members.unionByName(nodes.pivot_ids().toDF("doc_id"))
    own = sets_of(docs, members, size)
    links = checkpointed(confirmed(own, pairs.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")), percent))
    found = components(links)
    later = checkpointed(nodes.later(firsts.filter("uid IS NOT NULL"), found).join(pairs, ["a", "b"], "left_anti"))
    more = components(checkpointed(confirmed(own, later, percent)))
    forget(docs.sparkSession, own, firsts)
    merged = found.join(more.toDF("c", "m"), "c", "left").select("v", F.coalesce("m", "c").alias("c"))
    return checkpointed(merged.unionByName(more.join(found.select("v"), "v", "left_anti")))


def joined_at_once(edges: DataFrame) -> DataFrame:
    """v, c of a graph of MOST_AT_ONCE edges at most, in one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *[f[["a", "b"]].to_numpy(np.int64) for f in frames]])
        names, back = np.unique(pairs, return_inverse=True)
        roots = spanning(back.reshape(-1, 2), len(names))[1]
        yield pd.DataFrame({"v": names, "c": names[roots]})

    return edges.coalesce(1).mapInPandas(tidy("near", run), "v long, c long")


def components(links: DataFrame) -> DataFrame:
    """v, c: the least vertex reachable from v, for every vertex with a link.

    Each round every vertex joins the neighbour (or stays with itself) that comes first in an order drawn anew, and the
    graph is contracted to those chosen, so a group of copies is one vertex after a round or two, whatever its size. What
    is left in the end, a bounded number of edges, is joined in one task.
    """
    edges = checkpointed(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    rounds: list[DataFrame] = []
    while left := edges.limit(MOST_AT_ONCE + 1).count():
        if left <= MOST_AT_ONCE:
            rounds.append(checkpointed(joined_at_once(edges)))
            break
        place = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(rounds))).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        both = edges.select("a", "b").union(edges.select("b", "a")).toDF("v", "w")
        chosen = both.groupBy("v").agg(F.min(place("w")).alias("m")).select("v", F.least("m", place("v"))["id"].alias("c"))
        rounds.append(checkpointed(chosen))
        ends = rounds[-1].toDF("a", "ca"), rounds[-1].toDF("b", "cb")
        moved = edges.join(ends[0], "a").join(ends[1], "b").filter("ca <> cb")
        edges = checkpointed(moved.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("c"))
    root = rounds[-1]
    for chosen in reversed(rounds[:-1]):
        root = chosen.join(root.toDF("c", "r"), "c", "left").select("v", F.coalesce("r", "c").alias("c"))
    least = root.groupBy("c").agg(F.min("v").alias("least"))
    return checkpointed(root.join(least, "c").select("v", F.col("least").alias("c")))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    docs = docs.select("doc_id", "text")
    sketched = written(sketches(docs, size), "near-sketches")
    filled = sketched.filter("n > 0")
    # the vertex of a set is its least id; sets of null ids alone stay unlinked
    first = filled.groupBy("name").agg(F.min("doc_id").alias("a"), F.first("n").alias("n"), F.first("heads").alias("heads"), F.first("sketch").alias("sketch"))
    reps = written(first, "near-sets-of-copies")
    total = reps.count()
    plain = sketched.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    of = linked(docs, Nodes(reps.filter("a IS NOT NULL"), total, percent), size, percent)
    named = reps.select("name", "a").join(of, F.col("a") == F.col("v"), "left").select("name", F.coalesce("c", "a").alias("component_id"))
    named = written(named, "near-names")
    forget(docs.sparkSession, reps)
    found = filled.select("doc_id", F.col("n").alias("n_shingles"), "name").join(named, "name").select("doc_id", "n_shingles", "component_id")
    return found.unionByName(plain).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 2-word shingles are similar."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


def oracle_parts(documents: str, size: int, percent: int = PERCENT) -> str:
    """DuckDB common table expressions; the last, near_found, is (doc_id, n_shingles, component_id) by brute force."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
    near_words AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM {documents}
    ), near_shingles AS (
        SELECT DISTINCT doc_id, array_to_string(ws[i:i+{size - 1}], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {size - 2}, 2))) AS i FROM near_words WHERE len(ws) > 0)
    ), near_sizes AS (
        SELECT doc_id, count(*) AS n FROM near_shingles GROUP BY doc_id
    ), near_shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM near_shingles a JOIN near_shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
    ), near_links AS (
        SELECT a, b FROM near_shared p JOIN near_sizes x ON x.doc_id = a JOIN near_sizes y ON y.doc_id = b WHERE 100 * p.n >= {percent} * (x.n + y.n - p.n)
    ), near_both AS (
        SELECT a, b FROM near_links UNION ALL SELECT b, a FROM near_links
    ), near_reach AS (
        SELECT a, b FROM near_both UNION SELECT r.a, l.b FROM near_reach r JOIN near_both l ON r.b = l.a
    ), near_found AS (
        SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id
        FROM near_words w LEFT JOIN near_sizes s USING (doc_id) LEFT JOIN near_reach r ON r.a = w.doc_id GROUP BY w.doc_id, s.n
    )"""


def oracle() -> str:
    return f"WITH RECURSIVE {oracle_parts('documents', 2)} SELECT *, doc_id = component_id AS kept FROM near_found"
