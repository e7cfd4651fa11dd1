"""Hard negatives by inner product, over cover trees of norm-augmented candidates.

Every candidate x gets one more component, sqrt(M^2 - |x|^2), so that all lie on a
sphere of radius M; a query has 0 there and keeps its inner products. A cover tree
holds the distinct vectors: the root covers all, and a node's children are a net of
its points, further apart than a level's distance and each point within that distance
of its child. The distance shrinks by `BASE` from level to level, and each node keeps
the covering radius that its points really need. On the sphere, a node with centre c
and radius r lies within an angle of 2 asin(r / 2M) of c, which bounds all inner
products of a query with its points, above and below.

A query descends all trees of its task at once, best upper bound first, a few nodes
at a time; nodes whose bounds lie outside all its windows, or below the k-th score
that each of them holds by then, are skipped. Leaves are verified exactly, row by
row. So results are exact; on vectors without any structure most nodes are looked at.

1. the rows that take part are written, with integer components;
2. each task builds trees of at most `TREE_ROWS` of its rows; a tree is a row of the
   index table. No vector is shuffled and no key decides where a row goes, so copies
   and frequent labels do not matter;
3. trees are dealt in groups, and anchors (a stated query set, in order of arrival)
   go past every group: first for positives, then, with a window for each, for
   negatives. A group gives at most k rows for a window, and a window function takes
   the best of these.

Rows with a null label or vector, with a null or non-finite component, or with a null
id (it could not be named) take no part; nor do those whose integer components have
squares that sum to 2^45 or more, beyond which percentages of scores are not exact. Of
vectors of different lengths, the shorter counts as followed by zeros. Rows that
repeat an id are rows of their own; none is a positive of an anchor with its id. Ties
go by smaller id. Copies of a vector are one point of a tree. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions

TREE_ROWS, TREES_AT_ONCE, LEAF, BASE, NODES_AT_ONCE = 8192, 64, 8, 1.3, 64
TREES = "place int, tree binary"
FOUND = "anchor long, place int, id long, score long"


def vectors(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: float) -> DataFrame:
    """`id, label, v` of the rows that take part; v = floor(scale * component)."""
    chosen = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    chosen = chosen.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    chosen = chosen.withColumn("x", F.transform("x", lambda c: F.floor(F.lit(scale) * F.when(F.abs(c) < 1e9, c).otherwise(1e9)).cast("double")))
    size = F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)
    return chosen.where(size < float(1 << 45)).select("id", "label", F.col("x").cast("array<int>").alias("v"))


def matrix(column: pa.ListArray) -> np.ndarray:
    """A row for each list, followed by zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Tree:
    """A cover tree. points: distinct vectors in order of the leaves; a node's points, or its children, lie together."""

    FIELDS = ("points", "row_at", "ids", "labels", "centre", "radius", "child_from", "child_to", "point_from", "point_to")

    def __init__(self, **fields):
        for name in self.FIELDS:
            setattr(self, name, fields[name])
        self.size = float(np.sqrt((self.points**2).sum(axis=1).max(initial=0)))

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> "Tree":
        points, of = np.unique(rows, axis=0, return_inverse=True)
        of = of.reshape(-1)
        square = (points**2).sum(axis=1)
        raised = np.column_stack([points, np.sqrt(np.maximum(square.max() - square, 0))])
        centre, radius, child, leaf, order = [0], [0.0], [(0, 0)], [(0, 0)], []
        held = [np.arange(len(points))]
        at = 0
        while at < len(held):  # level by level: children are appended together
            mine = held[at]
            far = np.sqrt(((raised[mine] - raised[centre[at]]) ** 2).sum(axis=1)) if len(mine) > 1 else np.zeros(1)
            radius[at] = float(far.max())
            if len(mine) <= LEAF or radius[at] < 1:
                leaf[at] = (len(order), len(order) + len(mine))
                order.extend(mine.tolist())
            else:
                heads, owner = _net(raised[mine], far, int(np.flatnonzero(mine == centre[at])[0]), radius[at] / BASE)
                by = np.argsort(owner, kind="stable")
                parts = np.split(mine[by], np.flatnonzero(np.diff(owner[by])) + 1)
                child[at] = (len(held), len(held) + len(heads))
                centre += mine[heads].tolist()
                held += parts
                radius += [0.0] * len(heads)
                child += [(0, 0)] * len(heads)
                leaf += [(0, 0)] * len(heads)
            held[at] = None
            at += 1
        order = np.array(order, np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by = np.lexsort((ids, place[of]))
        spread = lambda pairs: [np.array(x, np.int64) for x in zip(*pairs, strict=True)]
        (child_from, child_to), (point_from, point_to) = spread(child), spread(leaf)
        row_at = np.searchsorted(place[of][by], np.arange(len(order) + 1))
        return cls(points=points[order], row_at=row_at, ids=ids[by], labels=labels[by], centre=place[np.array(centre)], radius=np.array(radius), child_from=child_from, child_to=child_to, point_from=point_from, point_to=point_to)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{n: getattr(self, n).astype(np.int32) if n == "points" else getattr(self, n) for n in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> "Tree":
        with np.load(io.BytesIO(data)) as held:
            return cls(**{n: held[n].astype(np.float64) if n == "points" else held[n] for n in cls.FIELDS})

    def bounds(self, nodes: np.ndarray, query: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
        """Greatest and least inner product that the nodes' points can have."""
        dot = self.points[self.centre[nodes]] @ query
        high, low = dot.copy(), dot.copy()
        wide = np.flatnonzero(self.radius[nodes] > 0)
        if len(wide):
            most = max(length * self.size, 1e-300)
            angle = np.arccos(np.clip(dot[wide] / most, -1, 1))
            reach = 2 * np.arcsin(np.minimum(1, self.radius[nodes[wide]] / (2 * self.size))) + 1e-7  # rounding of the roots and angles
            high[wide] = most * np.cos(np.maximum(angle - reach, 0)) + 1e-6 * most
            low[wide] = most * np.cos(np.minimum(angle + reach, np.pi)) - 1e-6 * most
        return high, low


def _net(points: np.ndarray, far: np.ndarray, first: int, apart: float) -> tuple[np.ndarray, np.ndarray]:
    """Heads further than `apart` from each other, and for each point the nearest head, within `apart`. far: distances from `first`."""
    square = (points**2).sum(axis=1)
    distance = lambda to: np.sqrt(np.maximum(square[:, None] + square[to] - 2 * (points @ points[to].T), 0))
    nearest, owner, heads = far.copy(), np.zeros(len(points), np.int64), [first]
    while len(uncovered := np.flatnonzero(nearest > apart)):
        tried = uncovered[:: max(1, len(uncovered) // NODES_AT_ONCE)][:NODES_AT_ONCE]
        away = distance(tried)
        chosen = []
        for k in range(len(tried)):
            if not chosen or away[tried[chosen], k].min() > apart:
                chosen.append(k)
        away = away[:, chosen]
        away[tried[chosen], np.arange(len(chosen))] = 0
        best = away.argmin(axis=1)
        closer = away[np.arange(len(points)), best] < nearest
        owner[closer] = len(heads) + best[closer]
        nearest[closer] = away[closer, best[closer]]
        heads += tried[chosen].tolist()
    return np.array(heads), owner


class Query:
    """One anchor, its windows [low, high] of scores, and the `k` best rows of each so far."""

    def __init__(self, vector: np.ndarray, lows, highs, k: int, wanted):
        """wanted(labels, ids) tells which rows may be found."""
        self.vector, self.k, self.wanted = vector, k, wanted
        self.lows, self.highs = np.array(lows, float), np.array(highs, float)
        self.bars = self.lows.copy()
        self.scores, self.ids = ([np.zeros(0, np.int64) for _ in self.lows] for _ in range(2))

    def needed(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return ((high[:, None] >= self.bars) & (low[:, None] <= self.highs)).any(axis=1)

    def verify(self, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        at = self.needed(scores, scores)
        at[at] = self.wanted(labels[at], ids[at])
        scores, ids = scores[at], ids[at]
        for w in range(len(self.lows)) if len(ids) else ():
            inside = (scores >= self.bars[w]) & (scores <= self.highs[w])
            if inside.any():
                s, i = np.concatenate([self.scores[w], scores[inside].astype(np.int64)]), np.concatenate([self.ids[w], ids[inside]])
                first = np.lexsort((i, -s))[: self.k]
                self.scores[w], self.ids[w] = s[first], i[first]
                if len(first) == self.k:
                    self.bars[w] = max(self.lows[w], float(s[first[-1]]))


def descend(forest: list[Tree], query: Query) -> int:
    """Best-first through all trees; how many nodes were opened."""
    vectors_, lengths = [], []
    for tree in forest:
        v = np.zeros(tree.points.shape[1])
        v[: min(len(v), len(query.vector))] = query.vector[: len(v)]
        vectors_.append(v)
        lengths.append(float(np.sqrt(v @ v)))
    opened = 0
    of, node = np.arange(len(forest)), np.zeros(len(forest), np.int64)
    high, low = np.full(len(forest), np.inf), np.full(len(forest), -np.inf)
    while True:
        at = query.needed(high, low)
        of, node, high, low = of[at], node[at], high[at], low[at]
        if not len(node):
            return opened
        next_ = np.argpartition(-high, NODES_AT_ONCE)[:NODES_AT_ONCE] if len(node) > NODES_AT_ONCE else np.arange(len(node))
        rest = np.ones(len(node), bool)
        rest[next_] = False
        opened += len(next_)
        new = [(of[rest], node[rest], high[rest], low[rest])]
        for t in np.unique(of[next_]):
            tree, mine = forest[t], node[next_[of[next_] == t]]
            inner = tree.child_to[mine] > tree.child_from[mine]
            if not inner.all():
                points = _ranges(tree.point_from[mine[~inner]], tree.point_to[mine[~inner]])
                rows = _ranges(tree.row_at[points], tree.row_at[points + 1])
                scores = np.repeat(tree.points[points] @ vectors_[t], tree.row_at[points + 1] - tree.row_at[points])
                query.verify(scores, tree.ids[rows], tree.labels[rows])
            if inner.any():
                children = _ranges(tree.child_from[mine[inner]], tree.child_to[mine[inner]])
                bounds = tree.bounds(children, vectors_[t], lengths[t])
                new.append((np.full(len(children), t), children, *bounds))
        of, node, high, low = (np.concatenate(x) for x in zip(*new, strict=True))


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    sizes = ends - starts
    return np.repeat(ends - sizes.cumsum(), sizes) + np.arange(sizes.sum())


def index(rows: DataFrame) -> DataFrame:
    """TREES over the rows of `vectors`."""

    def tree(parts, place):
        ids, labels, columns = zip(*parts, strict=True)
        width = max(x.shape[1] for x in columns)
        points = np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in columns])
        built = Tree.build(np.concatenate(ids), np.concatenate(labels), points)
        return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([built.dump()], pa.binary())], ["place", "tree"])

    def run(batches):
        parts, n, place = [], 0, TaskContext.get().partitionId()
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, TREE_ROWS - n)
                parts.append((part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False), matrix(part.column(2))))
                at, n = at + part.num_rows, n + part.num_rows
                if n == TREE_ROWS:
                    yield tree(parts, place)
                    parts, n, place = [], 0, place + 1
        if parts:
            yield tree(parts, place)

    return rows.mapInArrow(run, TREES)


def search(trees: DataFrame, groups: int, queries: DataFrame, k: int, same_label: bool) -> DataFrame:
    """FOUND: for every window of `queries` (anchor, id, label, v, lows, highs) its `k` best rows of every group of trees."""
    none = lambda kind: F.lit(None).cast(kind)
    left = trees.select("group", F.lit(0).alias("kind"), "tree", none("long").alias("anchor"), none("long").alias("id"), none("long").alias("label"), none("array<int>").alias("v"), none("array<long>").alias("lows"), none("array<long>").alias("highs"))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"), none("binary").alias("tree"), "anchor", "id", "label", "v", "lows", "highs")
    dealt = left.unionByName(right).repartitionById(groups, F.col("group")).sortWithinPartitions("group", "kind")

    def run(batches):
        forest, now = [], None
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if row["group"] != now:
                        forest, now = [], row["group"]
                    if row["kind"] == 0:
                        forest.append(Tree.load(row["tree"]))
                        continue
                    own, label = row["id"], row["label"]
                    wanted = (lambda labels, ids: (labels == label) & (ids != own)) if same_label else (lambda labels, ids: labels != label)
                    query = Query(np.array(row["v"], float), row["lows"], row["highs"], k, wanted)
                    descend(forest, query)
                    out += [(row["anchor"], w, i, s) for w in range(len(query.lows)) for i, s in zip(query.ids[w].tolist(), query.scores[w].tolist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["anchor", "place", "id", "score"])

    found = dealt.mapInArrow(run, FOUND)
    first = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`anchor_id, positive_id, rank, negative_id, positive_score, negative_score`.

    For each anchor (`is_anchor`, over `id`) and each of its first `positives` rows of
    the same label, the first `negatives` rows of other labels whose score is between
    `least` and `most` percent of the positive's.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    chosen = scratch.save(vectors(rows, id_col, vector_col, label, scale), "vectors")
    trees = scratch.save(index(chosen), "trees")
    n = trees.count()
    groups = max(1, min(n, max(partitions(spark), -(-n // TREES_AT_ONCE))))
    trees = trees.withColumn("group", F.pmod("place", F.lit(groups)))
    anchors = scratch.save(chosen.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    any_score = lambda x: F.array(F.lit(x).cast("long")).alias
    asked = anchors.select("*", any_score(-(1 << 53))("lows"), any_score(1 << 53)("highs"))
    found = search(trees, groups, asked, positives, same_label=True)
    told = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("told"))  # at most `positives`
    of = lambda f: F.transform("told", lambda t: f(t["positive_score"]).cast("long"))
    low, high = (lambda s: -F.floor(-(s * least) / 100)), (lambda s: F.floor(s * most / 100))
    asked = scratch.save(anchors.join(told, "anchor").withColumns({"lows": of(low), "highs": of(high)}), "asked")
    found = search(trees, groups, asked, negatives, same_label=False)
    of_anchor = asked.select("anchor", F.col("id").alias("anchor_id"), F.posexplode("told").alias("place", "t")).select("anchor", "anchor_id", "place", "t.positive_id", "t.positive_score")
    out = found.join(of_anchor, ["anchor", "place"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
