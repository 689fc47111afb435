"""Density clustering under cosine distance, best labels of points, and connected components, without collecting points.

Neighbours come from the metric index.  Best labels ask for the largest similarity, however small, so there points meet labelled
points block by block: a task multiplies two blocks tile by tile, keeps a bounded heap a point, and gives out no more than that."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept
from .metric import density_links, matrix

#: Points of a block, which are copied to as many tasks as the other side has blocks, labelled points and points multiplied at once.
BLOCK, TILE, ROWS = 16_384, 2048, 256
#: Edges that a task replaces by stars at a time, and edges of a task, about.
RUN_EDGES, TASK_EDGES = 1 << 20, 4 << 20


def _blocks(points: DataFrame, other: DataFrame, block: int, barred: bool = False) -> DataFrame:
    """x, y (a pair of blocks), side (0: of points, 1: of other), i, v, label, barred: the rows of each task."""
    size, width = (max(1, -(-df.count() // block)) for df in (points, other))
    label = lambda df: (F.col("label") if "label" in df.columns else F.lit(None)).cast("long").alias("label")
    off = (F.col("barred") if barred else F.lit(None)).cast("array<long>").alias("barred")
    own = lambda n: F.pmod(F.xxhash64("i"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    values = ["i", F.col("v").cast("array<float>").alias("v")]
    a = points.select(own(size).alias("x"), every(width).alias("y"), F.lit(0).alias("side"), *values, label(points), off)
    return a.unionByName(other.select(every(size).alias("x"), own(width).alias("y"), F.lit(1).alias("side"), *values, label(other), F.lit(None).cast("array<long>").alias("barred")))


def _label_maxima(m: np.ndarray, rows: np.ndarray, q: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The largest product of each of ``rows`` with the rows ``q`` of each label, whose rows begin at ``begins``."""
    best = np.full((len(rows), len(begins)), -np.inf)
    for to in range(0, len(q), TILE):
        sim = m[rows] @ m[q[to : to + TILE]].T
        first = int(np.searchsorted(begins, to, "right")) - 1
        cuts = np.maximum(begins[first : np.searchsorted(begins, to + sim.shape[1], "left")] - to, 0)
        best[:, first : first + len(cuts)] = np.maximum(best[:, first : first + len(cuts)], np.maximum.reduceat(sim, cuts, axis=1))
    return best


def group_maxima(points: DataFrame, other: DataFrame, others: bool = False, block: int = BLOCK) -> DataFrame:
    """points: i, v; other: i, v, label.  (i, label, score): the largest dot product of each point with the points of ``other`` of
    each label; with ``others`` labels of points count too, and only other labels do.  Tasks take their maxima first: no pair is shuffled."""

    def multiply(key, table):
        side, ids, labels = table["side"].to_numpy(), table["i"].to_numpy(), table["label"].to_numpy(zero_copy_only=False)
        m = matrix(table["v"], table.num_rows)
        p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        q = q[np.argsort(labels[q], kind="stable")]
        found = []
        if len(p) and len(q):
            own, begins = np.unique(labels[q], return_index=True)
            for at in range(0, len(p), ROWS):
                rows = p[at : at + ROWS]
                best = _label_maxima(m, rows, q, begins)
                if others:
                    best[labels[rows][:, None] == own[None, :]] = -np.inf
                    k = best.argmax(1)
                    some = np.flatnonzero(best[np.arange(len(rows)), k] > -np.inf)
                    found.append((ids[rows][some], own[k[some]], best[some, k[some]]))
                else:
                    found.append((np.repeat(ids[rows], len(own)), np.tile(own, len(rows)), best.ravel()))
        i, label, score = (np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(3))
        return pa.table({"i": i.astype(np.int64), "label": label.astype(np.int64), "score": score.astype(np.float64)})

    parts = _blocks(points, other, block).groupBy("x", "y").applyInArrow(multiply, "i long, label long, score double")
    return parts.groupBy("i", "label").agg(F.max("score").alias("score"))


def top_labels(points: DataFrame, other: DataFrame, keep: int = 2, block: int = BLOCK) -> DataFrame:
    """points: i, v and perhaps barred (labels that count as -1); other: i, v, label.  (i, label, score, rank): the ``keep`` labels with the largest
    dot product (not below -1) for each point, ties to the lowest label.

    A task keeps ``keep`` labels a point of those it sees, with what is barred taken into account, which is enough: the k-th best label
    of all is among the k best of the task that holds its nearest point.  So ``keep`` rows a point and block leave a task."""
    barred = "barred" in points.columns

    def multiply(key, table):
        side, ids, labels = table["side"].to_numpy(), table["i"].to_numpy(), table["label"].to_numpy(zero_copy_only=False)
        m, off = matrix(table["v"], table.num_rows), table["barred"]
        p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        q = q[np.argsort(labels[q], kind="stable")]
        found = []
        if len(p) and len(q):
            own, begins = np.unique(labels[q], return_index=True)
            for at in range(0, len(p), ROWS):
                rows = p[at : at + ROWS]
                best = np.maximum(_label_maxima(m, rows, q, begins), -1.0)
                for k, x in enumerate(off.take(pa.array(rows)).to_pylist() if barred else []):
                    if x:
                        best[k, np.isin(own, x)] = -1.0
                for _ in range(min(keep, len(own))):
                    k = best.argmax(1)  # the first of equals: labels ascend
                    found.append((ids[rows], own[k], best[np.arange(len(rows)), k]))
                    best[np.arange(len(rows)), k] = -np.inf
        i, label, score = (np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(3))
        return pa.table({"i": i.astype(np.int64), "label": label.astype(np.int64), "score": score.astype(np.float64)})

    parts = _blocks(points, other, block, barred).groupBy("x", "y").applyInArrow(multiply, "i long, label long, score double")
    best = parts.groupBy("i", "label").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "label"))  # of ``keep`` rows a block
    return best.withColumn("rank", rank).where(F.col("rank") <= keep)


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node of some edges to the least one that they connect it with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while (root[a] != root[b]).any():
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    some = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[some], nodes[root[some]]


def contracted(edges: DataFrame, many: int) -> DataFrame:
    """edges: u, v.  Edges with the same components: each of ``many`` tasks gives out one a node at most, whatever it gets."""

    def run(batches):
        held, n, u, v = [], 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            held.append((batch["u"].to_numpy(), batch["v"].to_numpy()))
            n += batch.num_rows
            if n >= RUN_EDGES:
                u, v = _stars(*(np.concatenate([x, *(h[k] for h in held)]) for k, x in enumerate((u, v))))
                held, n = [], 0
        if held:
            u, v = _stars(*(np.concatenate([x, *(h[k] for h in held)]) for k, x in enumerate((u, v))))
        for k in range(0, len(u), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(u[k : k + (1 << 18)]), pa.array(v[k : k + (1 << 18)])], ["u", "v"])

    return edges.select("u", "v").repartition(many).mapInArrow(run, "u long, v long")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): the least node that edges (u, v) reach, for every row of nodes (node); large-star and small-star steps until
    nothing changes, each step kept in the shared folder."""
    now = kept(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sign = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = least.select("u", F.col("m").alias("v")).union(large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = kept(small.distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 32)))).first()
        if seen == sign:
            return nodes.join(now, nodes["node"] == now["u"], "left").select("node", F.coalesce("v", "node").alias("root"))
        sign = seen


def dbscan(points: DataFrame, eps: float, min_samples: int, block: int = BLOCK) -> DataFrame:
    """points: i, v (unit vectors).  (i, label, is_core): clusters numbered by their lowest core, border points with the lowest
    adjacent cluster, noise -1.  A point counts among its own neighbours; zero vectors are neighbours of nothing.

    Tasks count neighbours and give out what connects cores and borders them, not all pairs: a group of equal vectors is no larger than its rows."""
    found = kept(density_links(points, 1 - eps, min_samples - 1, block))
    close = found.where("j IS NOT NULL").select("i", "j")
    both = close.union(close.select(F.col("j").alias("i"), F.col("i").alias("j")))
    degree = found.where("j IS NULL").groupBy("i").agg((F.sum("n") + 1).alias("n"))
    cores = points.select("i").join(degree, "i", "left").where(F.coalesce("n", F.lit(1)) >= min_samples).select("i")
    inner = close.join(cores, "i").join(cores.select(F.col("i").alias("j")), "j").select(F.col("i").alias("u"), F.col("j").alias("v"))
    # tasks of the links have each connected what they hold: most links say the same again
    roots = kept(components(cores.select(F.col("i").alias("node")), contracted(inner, 1 + close.count() // TASK_EDGES)))
    numbers = roots.select("root").distinct().withColumn("label", F.row_number().over(Window.orderBy("root")) - 1)  # one row a cluster
    core_labels = roots.join(numbers, "root").select(F.col("node").alias("i"), "label")
    border = both.join(core_labels.select(F.col("i").alias("j"), "label"), "j").groupBy("i").agg(F.min("label").alias("near"))
    out = points.select("i").join(core_labels, "i", "left").join(border, "i", "left")
    return out.select("i", F.coalesce("label", "near", F.lit(-1)).cast("int").alias("label"), F.col("label").isNotNull().alias("is_core"))


def covers(labels: DataFrame) -> DataFrame:
    """label, cover (lowest member), n of each cluster."""
    return labels.where("label >= 0").groupBy("label").agg(F.min("i").alias("cover"), F.count(F.lit(1)).alias("n"))
