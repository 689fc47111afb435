"""Vectors stored by cell, and searches that read only the cells that can hold a hit.

A cell is a pivot and the largest angle of its vectors to it.  No vector of a cell at the angle a from the query can be nearer
than a - far, so its cosine is at most cos(max(a - far, 0)): cells whose bound is below the threshold, or below the k-th best
found so far, are not read.  Results are exact; how many cells are left out depends on how the vectors lie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, literal
from .metric import PIVOTS, choose_pivots, unit, with_cells

#: Vectors of a cell on average at least, and vectors that a search for the nearest reads before it asks which other cells it needs: so many
#: take less time than another job.
CELL_ROWS, FIRST_ROWS = 256, 50_000


@dataclass(frozen=True)
class VectorIndex:
    """placed: file_id, embedding (unit vectors), cell, stored in a folder a cell; cells: cell, pivot, far, n, at most ``PIVOTS`` rows, cell -1 for
    zero vectors, which are like nothing."""

    placed: DataFrame
    cells: DataFrame
    #: The folder that the cells are published in, which never changes: they are read once in a session.
    folder: str | None = None


def placed_vectors(vectors: DataFrame, most: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(placed, cells) of vectors (file_id, embedding)."""
    points = vectors.select(F.col("file_id").alias("i"), F.col("embedding").alias("v"))
    pivots = choose_pivots(points, 0.0, max(1, min(most, points.count() // CELL_ROWS)))
    if not len(pivots):
        zero = vectors.select("file_id", "embedding", F.lit(-1).alias("cell"))
        return zero, zero.groupBy("cell").agg(F.lit(None).cast("array<double>").alias("pivot"), F.lit(0.0).alias("far"), F.count(F.lit(1)).alias("n"))
    found = with_cells(points, pivots, 1.0)
    zero = points.where(~F.exists("v", lambda x: x != 0)).select("i", "v", F.lit(-1).alias("cell"), F.lit(0.0).alias("far"))
    every = found.select("i", "v", "cell", "far").unionByName(zero)
    at = vectors.sparkSession.createDataFrame([(k, p.tolist()) for k, p in enumerate(pivots)], "cell int, pivot array<double>")
    sizes = every.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n"))
    return every.select(F.col("i").alias("file_id"), F.col("v").alias("embedding"), "cell").repartition("cell"), sizes.join(F.broadcast(at), "cell", "left")


_READ: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}


def _cells(index: VectorIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell, rows, far, pivot) of the cells."""
    if index.folder in _READ:
        return _READ[index.folder]
    rows = index.cells.where("pivot IS NOT NULL").collect()
    out = tuple(np.array([r[n] for r in rows]) for n in ("cell", "n", "far", "pivot"))
    if index.folder:
        if len(_READ) >= 16:
            _READ.clear()
        _READ[index.folder] = out
    return out


def bounds(index: VectorIndex, vector: list[float]) -> list[tuple[float, int, int]]:
    """(largest possible dot product, cell, rows) of each cell, the best first."""
    cell, n, far, pivots = _cells(index)
    if not len(cell):
        return []
    q = np.asarray(vector, float)
    angle = np.arccos(np.clip(unit(q[None, :]) @ pivots.T, -1, 1))[0]
    top = np.cos(np.clip(angle - far, 0, np.pi)) * float(np.linalg.norm(q)) + 1e-6  # vectors are of unit length up to rounding
    return sorted(zip(top.tolist(), cell.tolist(), n.tolist()), reverse=True)


def _in(index: VectorIndex, cells: list[int], vector: list[float]) -> DataFrame:
    """file_id, sim of the vectors of some cells; others' folders are not read."""
    return index.placed.where(F.col("cell").isin(cells) if cells else F.lit(False)).select("file_id", dot(F.col("embedding"), literal(vector)).alias("sim"))


def near(index: VectorIndex, vector: list[float], least: float) -> DataFrame:
    """file_id, sim of all vectors with a dot product of at least ``least`` (above 0)."""
    return _in(index, [c for top, c, _ in bounds(index, vector) if top >= least], vector).where(F.col("sim") >= least)


def nearest(index: VectorIndex, vector: list[float], k: int, least: float, files: DataFrame | None = None) -> DataFrame:
    """file_id, sim of the ``k`` nearest vectors, of ``files`` (file_id) if given; ties to the lowest id.

    The nearest cells that hold a few times ``k`` vectors are read first; their k-th best is the bar for the other cells."""
    order = [(top, c, n) for top, c, n in bounds(index, vector) if top >= least]
    first, held = 0, 0
    while first < len(order) and held < max(4 * k, FIRST_ROWS):
        held += order[first][2]
        first += 1

    def best(cells: list[int]) -> DataFrame:
        found = _in(index, cells, vector).where(F.col("sim") >= least)
        found = found if files is None else found.join(files, "file_id", "left_semi")
        return found.orderBy(F.desc("sim"), "file_id").limit(k)

    if first == len(order):
        return best([c for _, c, _ in order])
    some = best([c for _, c, _ in order[:first]]).collect()  # k rows at most
    bar = some[-1]["sim"] if len(some) == k else least
    return best([c for top, c, _ in order if top >= bar])
