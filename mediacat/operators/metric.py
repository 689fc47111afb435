"""An exact metric index over vectors: cells around pivots under the angle, which obeys the triangle inequality.

Each point belongs to the cell of its nearest pivot and, inside it, to a ring of its angle to the pivot.  For a point x at angle
d(x, p) of a foreign pivot p, a neighbour within the angle t in the cell of p has

* d(x, p) <= d(x, own pivot) + 2 t, since its own pivot is no farther from it than x's, and
* a ring that reaches [d(x, p) - t, d(x, p) + t].

So x visits the rings that pass both tests, and no pair outside them is ever multiplied.  Pivots come from a bounded sample and
decide about the work, never about the result; where the points have no structure at that angle, all rings pass and all pairs meet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import kept

#: Rows that pivots are chosen from, pivots at most, rows of a cell on average at least, and slack of the angle tests for rounding.
SAMPLE, PIVOTS, CELL, SLACK = 8192, 256, 2048, 1e-5
#: Blocks of points without structure, and bytes of a block at most: so many copies of each point leave its task however many points there
#: are, until blocks are as large as that.
BLOCKS, BLOCK_BYTES = 8, 128 << 20


def matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    """A column of vectors as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1) if rows else np.zeros((0, 1))


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)


def angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angle of each row with each pivot; zero vectors are at a right angle with everything."""
    return np.arccos(np.clip(unit(m) @ pivots.T, -1.0, 1.0))


def choose_pivots(points: DataFrame, reach: float, most: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Pivots so that each row of a sample (the ``sample`` rows of the smallest hash of the id) is within ``reach`` of one, or ``most`` of them: each
    next one is the row that is farthest from all before."""
    return _pivots_of(_sampled(points, sample), reach, most)


def _sampled(points: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    rows = points.select("i", F.col("v").cast("array<double>").alias("v")).orderBy(F.xxhash64("i"), "i").limit(sample).toArrow()
    m = unit(matrix(rows["v"], rows.num_rows))
    return m[(m != 0).any(axis=1)]


def _pivots_of(m: np.ndarray, reach: float, most: int) -> np.ndarray:
    if not len(m):
        return np.zeros((0, m.shape[1]))
    chosen, far = [0], angles(m, m[:1])[:, 0]
    while len(chosen) < most and far.max() > reach:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, angles(m, m[chosen[-1:]])[:, 0])
    return m[chosen]


@dataclass(frozen=True)
class Cells:
    """points: i, v, cell, far (angle to the pivot), ring; pivots; width of a ring; (cell, ring) -> rows of each ring."""

    points: DataFrame
    pivots: np.ndarray
    width: float
    rings: dict[tuple[int, int], int]


def with_cells(points: DataFrame, pivots: np.ndarray, width: float) -> DataFrame:
    """points: i, v, more.  Adds cell, far and ring; zero vectors, which have no direction, are left out."""

    def place(batches):
        for batch in batches:
            m = matrix(batch["v"], batch.num_rows)
            some = np.flatnonzero((m != 0).any(axis=1))
            if len(some):
                a = angles(m[some], pivots)
                cell = a.argmin(axis=1)
                far = a[np.arange(len(some)), cell]
                out = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell.astype(np.int32)), pa.array(far), pa.array((far / width).astype(np.int32))], [*batch.schema.names, "cell", "far", "ring"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(place, f"{fields}, cell int, far double, ring int")


def cells(points: DataFrame, reach: float, most: int = PIVOTS) -> Cells:
    """The index of ``points`` (i, v) for neighbours within the angle ``reach``, kept in the shared folder.  Cells of fewer rows than
    ``CELL`` on average would cost more copies than they save products, and so would any cells where most points of a sample must visit
    most pivots: such points are one cell of one ring."""
    m = _sampled(points)
    pivots, width = _pivots_of(m, reach / 2, min(most, 1 + points.count() // CELL)), max(reach, 1e-3)
    if len(pivots) > 1:
        a = angles(m, pivots)
        cell, far = a.argmin(axis=1), a.min(axis=1)
        ends = np.array([far[cell == c].max(initial=0.0) for c in range(len(pivots))])
        if ((a <= far[:, None] + 2 * reach + SLACK) & (a - reach - SLACK <= ends)).sum() > len(m) * (len(pivots) + 1) / 2:
            pivots, width = pivots[:1], 4.0
    placed = kept(with_cells(points.select("i", F.col("v").cast("array<float>").alias("v")), pivots, width)) if len(pivots) else None
    if placed is None:
        return Cells(points.where(F.lit(False)), pivots, width, {})
    sizes = placed.groupBy("cell", "ring").count().collect()  # a row a ring: pivots times a few
    return Cells(placed, pivots, width, {(r["cell"], r["ring"]): r["count"] for r in sizes})


def visits(a: np.ndarray, cell: np.ndarray, far: np.ndarray, reach: float, width: float, rings: dict[tuple[int, int], int]) -> list[tuple[int, int, np.ndarray]]:
    """(cell, ring, rows): the rings of later cells, and the next ring of the own one, that rows at the angles ``a`` to the pivots must see."""
    out = []
    own = (far / width).astype(np.int64)
    for (c, r), _ in sorted(rings.items()):
        d = a[:, c]
        near = (d + reach + SLACK >= r * width) & (d - reach - SLACK <= (r + 1) * width)
        foreign = (cell < c) & (d <= far + 2 * reach + SLACK) & near
        inside = (cell == c) & (own < r) & near
        rows = np.flatnonzero(foreign | inside)
        if len(rows):
            out.append((c, r, rows))
    return out


def _dealt(points: DataFrame, least: float, block: int, most: int) -> DataFrame | None:
    """Rows (cell, ring, block, shard, side, i, v) sorted by task, the first four columns: sides 0 and 1 for the points of a block, side 1 for those
    of them that this task multiplies with the block, and side 2 for others that it is multiplied with.  None if no point has a direction.

    A ring of many points is dealt to several tasks by a hash, and so are its visitors.  A task holds ``block`` points of one ring, more where
    all points are one cell."""
    reach = float(np.arccos(np.clip(least, -1.0, 1.0)))
    index = cells(points, reach, most)
    if not index.rings:
        return None
    pivots, width, rings = index.pivots, index.width, index.rings
    flat, total = width > np.pi, sum(rings.values())
    if flat:
        block = max(block, min(-(-total // BLOCKS), BLOCK_BYTES // (8 * pivots.shape[1])))
    blocks = {k: -(-n // block) for k, n in rings.items()}

    def tally(batches):  # how many visitors each ring has
        n: dict[tuple[int, int], int] = {}
        for batch in batches:
            a = angles(matrix(batch["v"], batch.num_rows), pivots)
            for c, r, rows in visits(a, batch["cell"].to_numpy(), batch["far"].to_numpy(), reach, width, rings):
                n[c, r] = n.get((c, r), 0) + len(rows)
        yield pa.RecordBatch.from_pydict({"cell": [c for c, _ in n], "ring": [r for _, r in n], "n": list(n.values())}, pa.schema([("cell", pa.int32()), ("ring", pa.int32()), ("n", pa.int64())]))

    few = flat or total <= 7 * block  # no ring can have so many visitors that they need a second task
    seen = [] if few else index.points.mapInArrow(tally, "cell int, ring int, n long").groupBy("cell", "ring").agg(F.sum("n").alias("n")).collect()
    visitors = {(r["cell"], r["ring"]): r["n"] for r in seen}
    shards = {k: -(-(visitors.get(k, 0) + n) // ((2 if flat else 8) * block)) for k, n in rings.items()}
    # a partition a task: by their bytes, which say nothing of the products, equal vectors would all meet in one, and by a hash some
    first, every = {}, 0
    for k in sorted(rings):
        first[k], every = every, every + blocks[k] * shards[k]
    many = min(every, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def deal(batches):
        names = ["part", "cell", "ring", "block", "shard", "side"]

        def rows(batch, at, c, r, b, s, side):
            part = (first[c, r] + b * shards[c, r] + s) % many
            values = [np.broadcast_to(np.int32(x), len(at)) for x in (part, c, r, b, s, side)]
            own = batch.take(pa.array(at))
            return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in values), own["i"], own["v"]], [*names, "i", "v"])

        for batch in batches:
            a = angles(matrix(batch["v"], batch.num_rows), pivots)
            i, cell, far, ring = (batch[x].to_numpy() for x in ("i", "cell", "far", "ring"))
            mixed = (i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for c, r in set(zip(cell.tolist(), ring.tolist())):
                own = np.flatnonzero((cell == c) & (ring == r))
                mine = mixed[own] % np.uint64(blocks[c, r])
                shard = (mixed[own] >> np.uint64(12)) % np.uint64(shards[c, r])
                for b in range(blocks[c, r]):
                    for s in range(shards[c, r]):
                        if len(at := own[(mine == b) & (shard != s)]):
                            yield rows(batch, at, c, r, b, s, 0)
                        if len(at := own[(mine == b) & (shard == s)]):
                            yield rows(batch, at, c, r, b, s, 1)
                        if len(at := own[(mine < b) & (shard == s)]):
                            yield rows(batch, at, c, r, b, s, 2)
            for c, r, at in visits(a, cell, far, reach, width, rings):
                shard = (mixed[at] >> np.uint64(12)) % np.uint64(shards[c, r])
                for s in range(shards[c, r]):
                    if len(part := at[shard == s]):
                        for b in range(blocks[c, r]):
                            yield rows(batch, part, c, r, b, s, 2)

    tasks = index.points.mapInArrow(deal, "part int, cell int, ring int, block int, shard int, side int, i long, v array<float>")
    return tasks.repartitionById(many, F.col("part")).drop("part").sortWithinPartitions("cell", "ring", "block", "shard", "side")


def _parts(batches, rows: int):
    """(task, side, i, v) of at most ``rows`` rows, as they come."""
    for batch in batches:
        columns = [batch[x].to_numpy() for x in ("cell", "ring", "block", "shard", "side", "i")]
        v = matrix(batch["v"], batch.num_rows)
        keys = np.stack(columns[:5], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            for at in range(a, b, rows):
                to = min(at + rows, b)
                yield tuple(keys[a, :4].tolist()), int(keys[a, 4]), columns[5][at:to], v[at:to]


def _meetings(batches, rows: int):
    """What a task does, in order: ("block", i, v) for the points of its block, then those that are multiplied with it, at most ``rows`` at a
    time: ("own", i, v) for points of the block itself and ("other", i, v)."""
    key, held = None, None

    def opened():
        ids, m, mine = (np.concatenate([h[k] for h in held]) for k in range(3))
        yield "block", ids, m
        at = np.flatnonzero(mine)
        for k in range(0, len(at), rows):
            yield "own", ids[at[k : k + rows]], m[at[k : k + rows]]

    for task, side, i, v in _parts(batches, rows):
        if task != key:
            if held:
                yield from opened()
            key, held = task, []
        if side < 2:
            held.append((i, v, np.full(len(i), side == 1)))
            continue
        if held is not None:
            if held:
                yield from opened()
            else:  # a hash has left the block empty
                yield "block", i[:0], v[:0]
            held = None
        yield "other", i, v
    if held:
        yield from opened()


def neighbour_pairs(points: DataFrame, least: float, block: int = 8192, stream: int = 2048, most: int = PIVOTS) -> DataFrame:
    """points: i (distinct), v (unit vectors).  (i, j, sim), i < j, of the pairs with dot product >= ``least`` (> 0 for zero vectors to have none).

    A task multiplies whoever visits its block ``stream`` rows at a time; pairs leave it as they are found."""
    tasks = _dealt(points, least, block, most)
    if tasks is None:
        return points.sparkSession.createDataFrame([], "i long, j long, sim double")

    def multiply(batches):
        kept_ids = m = None

        def pairs(i, v, own):
            for at in range(0, len(m), stream):
                sim = v @ m[at : at + stream].T
                x, y = np.nonzero(sim >= least)
                u, w = i[x], kept_ids[at + y]
                ok = u < w if own else u != w  # within a block both orders of a pair come up
                u, w, s = u[ok], w[ok], sim[x, y][ok]
                for k in range(0, len(u), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, w)[k : k + (1 << 18)]), pa.array(np.maximum(u, w)[k : k + (1 << 18)]), pa.array(s[k : k + (1 << 18)])], ["i", "j", "sim"])

        for what, i, v in _meetings(batches, stream):
            if what == "block":
                kept_ids, m = i, v
            else:
                yield from pairs(i, v, what == "own")

    return tasks.mapInArrow(multiply, "i long, j long, sim double")


class _Block:
    """The points of a task's block: how many neighbours each has been seen with, and which of them the links given out connect."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, least: float, enough: int) -> None:
        self.ids, self.m, self.least, self.enough = ids, m, least, enough
        self.seen, self.visited, self.group = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.arange(len(ids))

    def meet(self, i: np.ndarray, v: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows meet the block: (neighbours of each row in it, link ends among the rows, link ends in the block)."""
        near = np.empty((len(i), len(self.ids)), bool)
        for at in range(0, len(self.ids), 2048):
            near[:, at : at + 2048] = v @ self.m[at : at + 2048].T >= self.least
        if own:
            near &= i[:, None] != self.ids[None, :]
        counts, columns = near.sum(axis=1), near.sum(axis=0)
        self.seen += columns
        if own:
            near &= i[:, None] < self.ids[None, :]  # both orders of a pair come up
        else:
            self.visited += columns
        dense, full = counts >= self.enough, self.seen >= self.enough
        x, y = np.nonzero(near & ~(dense[:, None] & full[None, :]))
        links = [(x, y)]
        near &= full[None, :]
        for r in np.flatnonzero(dense):
            at = np.flatnonzero(near[r])
            if len(at):
                groups, first = np.unique(self.group[at], return_index=True)
                links.append((np.full(len(first), r), at[first]))
                if len(groups) > 1:
                    self.group[np.isin(self.group, groups)] = groups[0]
        x, y = (np.concatenate([link[k] for link in links]) for k in range(2))
        return counts, x, y


def density_links(points: DataFrame, least: float, enough: int, block: int = 8192, stream: int = 1024, most: int = PIVOTS) -> DataFrame:
    """points: i (distinct), v (unit vectors).  What tells which points have ``enough`` neighbours (dot product >= ``least``) and what those connect:
    rows (i, null, n), whose sum over n is the number of neighbours of i, and rows (i, j, 0) of neighbours.

    Not all pairs leave a task.  A point with ``enough`` neighbours inside a task has enough of them; of the pairs of two such points only those
    go out that connect what the task's earlier ones have not.  Other points have fewer than ``enough`` pairs in the task, and all of them go
    out.  So a task gives out at most about ``enough`` rows a point, however many pairs it finds."""
    tasks = _dealt(points, least, block, most)
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("n", pa.int64())])
    if tasks is None:
        return points.sparkSession.createDataFrame([], "i long, j long, n long")

    def degrees(i, n):
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(i[some]), pa.nulls(len(some), pa.int64()), pa.array(n[some])], schema=schema)

    def multiply(batches):
        own = None
        for what, i, v in _meetings(batches, stream):
            if what == "block":
                if own is not None:
                    yield degrees(own.ids, own.visited)
                own = _Block(i, v, least, enough)
                continue
            n, x, y = own.meet(i, v, what == "own")
            yield degrees(i, n)
            for k in range(0, len(x), 1 << 18):
                a, b = i[x[k : k + (1 << 18)]], own.ids[y[k : k + (1 << 18)]]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int64))], schema=schema)
        if own is not None:
            yield degrees(own.ids, own.visited)

    return tasks.mapInArrow(multiply, "i long, j long, n long")
