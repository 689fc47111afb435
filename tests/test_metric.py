"""The metric index and the bounded heaps of labels against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediacat.operators import cluster, metric, people


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + k, v.tolist()) for k, v in enumerate(x)], "i long, v array<float>")


def grouped(rng, groups, each, dim, spread):
    return unit(np.repeat(unit(rng.normal(size=(groups, dim))), each, 0) + spread * rng.normal(size=(groups * each, dim)))


@pytest.mark.parametrize("least", [0.4, 0.7, 0.95, 0.999])
@pytest.mark.parametrize("block", [7, 50, 4096])
def test_neighbour_pairs_equal_all_pairs(spark, monkeypatch, least, block):
    monkeypatch.setattr(metric, "CELL", 20)
    rng = np.random.default_rng(int(least * 1000) + block)
    x = np.concatenate([grouped(rng, 6, 25, 12, 0.1), unit(rng.normal(size=(60, 12))), np.zeros((3, 12))]).astype(np.float32)
    x[-5] = x[0]  # a copy
    got = [(r["i"], r["j"]) for r in metric.neighbour_pairs(frame(spark, x), least, block=block, stream=16).collect()]
    sims = x.astype(float) @ x.T.astype(float)
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if sims[i, j] >= least}


def test_only_near_rings_meet(spark, monkeypatch):
    """Points of groups that are far apart are copied to few rings: the work is far from all pairs."""
    rng = np.random.default_rng(3)
    x = grouped(rng, 40, 50, 64, 0.05)
    monkeypatch.setattr(metric, "CELL", 40)
    reach = float(np.arccos(0.8))
    index = metric.cells(frame(spark, x), reach)
    a = metric.angles(x, index.pivots)
    cell = a.argmin(1)
    far = a[np.arange(len(x)), cell]
    meetings = sum(len(rows) * index.rings[c, r] for c, r, rows in metric.visits(a, cell, far, reach, index.width, index.rings)) + sum(n * n // 2 for n in index.rings.values())
    assert len(index.pivots) >= 30 and meetings < 0.1 * len(x) ** 2 / 2


def test_a_ring_of_a_third_of_all_points_goes_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(metric, "CELL", 50)
    rng = np.random.default_rng(8)
    x = np.concatenate([unit(np.ones((1, 8)) + 0.01 * rng.normal(size=(300, 8))), unit(rng.normal(size=(600, 8)))]).astype(np.float32)
    got = {(r["i"], r["j"]) for r in metric.neighbour_pairs(frame(spark, x), 0.99, block=32, stream=10).collect()}
    sims = x.astype(float) @ x.T.astype(float)
    assert got == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if sims[i, j] >= 0.99}


def test_no_points(spark):
    none = frame(spark, np.zeros((1, 4))).limit(0)
    assert metric.neighbour_pairs(none, 0.5).count() == 0 and metric.neighbour_pairs(frame(spark, np.zeros((3, 4))), 0.5).count() == 0


@pytest.mark.parametrize("block", [5, 1000])
def test_top_labels_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(cluster, "TILE", 7)
    monkeypatch.setattr(cluster, "ROWS", 4)
    rng = np.random.default_rng(block)
    x, y = unit(rng.normal(size=(30, 6))).astype(np.float32), unit(rng.normal(size=(50, 6))).astype(np.float32)
    y[1], labels = y[0], rng.integers(0, 9, 50)
    labels[:2] = [4, 2]  # a tie between two labels
    x[0] = y[0]
    off = {k: sorted(set(rng.integers(0, 9, k % 11).tolist())) for k in range(30)}
    off[0] = []
    points = spark.createDataFrame([(k, v.tolist(), off[k] or None) for k, v in enumerate(x)], "i long, v array<float>, barred array<long>")
    other = spark.createDataFrame([(100 + k, v.tolist(), int(b)) for k, (v, b) in enumerate(zip(y, labels))], "i long, v array<float>, label long")
    sims = x.astype(float) @ y.T.astype(float)
    want = {}
    for i in range(30):
        scores = sorted((-(-1.0 if b in off[i] else sims[i, labels == b].max()), b) for b in set(labels.tolist()))
        want.update({(i, rank): (b, -s) for rank, (s, b) in enumerate(scores[:3], 1)})
    rows = cluster.top_labels(points, other, 3, block=block).collect()
    got = {(r["i"], r["rank"]): (r["label"], r["score"]) for r in rows}
    assert got.keys() == want.keys() and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert [got[k][1] for k in sorted(got)] == pytest.approx([want[k][1] for k in sorted(want)])
    assert want[0, 1][0] == 2


def test_a_face_makes_few_rows_however_many_people_there_are(spark):
    rng = np.random.default_rng(1)
    x, y = unit(rng.normal(size=(40, 8))), unit(rng.normal(size=(600, 8)))
    faces = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<float>")
    refs = spark.createDataFrame([(1000 + k, v.tolist(), k) for k, v in enumerate(y)], "id long, embedding array<float>, person_id long")
    best = people.best_people(faces, refs, spark.createDataFrame([(0, int((x @ y.T)[0].argmax()))], "face_id long, person_id long"))
    second = int(np.argsort(-(x @ y.T)[0])[1])
    assert best.count() == 40 and best.where("face_id = 0").first()["person_id"] == second
    names = spark.createDataFrame([(k, "x" if k % 2 else None) for k in range(600)], "id long, name string")
    made = people.decided(best, names, people.Settings(0.9, 0.5)).collect()
    assert {r["decision"] for r in made} <= {"auto", "suggested", "orphan"} and all((r["score"] >= 0.9) == (r["decision"] == "auto") for r in made)


def test_cell_bounds_hold_for_every_pair():
    rng = np.random.default_rng(6)
    x = np.concatenate([grouped(rng, 8, 30, 5, 0.2), unit(rng.normal(size=(100, 5)))])
    pivots = x[::17]
    a = metric.angles(x, pivots)
    cell, width, reach = a.argmin(1), 0.3, 0.5
    far = a[np.arange(len(x)), cell]
    ring = (far / width).astype(int)
    rings = {}
    for k in zip(cell.tolist(), ring.tolist()):
        rings[k] = rings.get(k, 0) + 1
    seen = {(c, r, int(k)) for c, r, rows in metric.visits(a, cell, far, reach, width, rings) for k in rows}
    near = np.arccos(np.clip(x @ x.T, -1, 1)) <= reach
    for i, j in zip(*np.nonzero(near)):
        if (cell[i], ring[i]) != (cell[j], ring[j]):
            assert (int(cell[j]), int(ring[j]), int(i)) in seen or (int(cell[i]), int(ring[i]), int(j)) in seen


def brute_dbscan(x, least, need):
    """(label, is_core) of each point, over all pairs."""
    near = x.astype(float) @ x.T.astype(float) >= least
    np.fill_diagonal(near, False)
    core = near.sum(1) + 1 >= need
    root = np.where(core, np.arange(len(x)), len(x))
    while True:
        step = np.array([min([root[i], *root[near[i] & core]]) if core[i] else len(x) for i in range(len(x))])
        if (step == root).all():
            break
        root = step
    number = {r: k for k, r in enumerate(sorted(set(root[core])))}
    own = [number[root[i]] if core[i] else min((number[r] for r in root[near[i] & core]), default=-1) for i in range(len(x))]
    return [(k, bool(c)) for k, c in zip(own, core)]


@pytest.mark.parametrize(("least", "need", "block"), [(0.5, 3, 50), (0.8, 8, 7), (0.97, 1, 50), (0.97, 2, 4096)])
def test_dbscan_equals_all_pairs(spark, monkeypatch, least, need, block):
    monkeypatch.setattr(metric, "CELL", 40)
    rng = np.random.default_rng(need * 100 + block)
    copies = np.repeat(unit(rng.normal(size=(3, 6))), 30, 0)
    x = np.concatenate([copies, grouped(rng, 4, 15, 6, 0.12), unit(rng.normal(size=(80, 6))), np.zeros((2, 6))]).astype(np.float32)[rng.permutation(232)]
    got = {r["i"]: (r["label"], r["is_core"]) for r in cluster.dbscan(frame(spark, x), 1 - least, need, block).collect()}
    assert [got[i] for i in range(len(x))] == brute_dbscan(x, least, need)


def test_pairs_of_a_dense_group_stay_in_their_tasks(spark):
    """600 copies are 179,700 pairs; what leaves the tasks grows with the points."""
    x = np.repeat(unit(np.arange(1, 9).reshape(1, 8).astype(float)), 600, 0).astype(np.float32)
    found = metric.density_links(frame(spark, x), 0.9, 2)
    assert found.where("j IS NOT NULL").count() < 3 * len(x) and found.agg(F.sum("n")).first()[0] == 600 * 599


def test_points_without_structure_are_one_cell(spark, monkeypatch):
    """Where most points must visit most pivots, cells would only make copies of them."""
    monkeypatch.setattr(metric, "CELL", 40)
    rng = np.random.default_rng(1)
    index = metric.cells(frame(spark, unit(rng.normal(size=(800, 64))).astype(np.float32)), float(np.arccos(0.38)))
    assert len(index.pivots) == 1 and list(index.rings) == [(0, 0)]


def test_points_leave_their_task_in_few_copies(spark, monkeypatch):
    """However many points without structure there are, and none is sent twice to one task."""
    x = unit(np.random.default_rng(8).normal(size=(4000, 24)))
    monkeypatch.setattr(metric, "BLOCKS", 4)
    monkeypatch.setattr(metric, "CELL", 40)
    copies = []
    for n in (1000, 4000):
        tasks = metric._dealt(frame(spark, x[:n]), 0.5, 64, 4)
        assert tasks.groupBy("cell", "ring", "block", "shard", "i").count().where("count > 1").count() == 0
        copies.append(tasks.count() / n)
    assert max(copies) < 4 and abs(copies[1] - copies[0]) < 0.5


def test_links_are_contracted_to_one_a_node(spark, monkeypatch):
    monkeypatch.setattr(cluster, "RUN_EDGES", 50)
    rng = np.random.default_rng(9)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (2000, 2)) if a % 3 == b % 3] + [(900, 900), (901, 902)]
    edges = spark.createDataFrame(pairs, "u long, v long")
    few = cluster.contracted(edges, 2)
    nodes = spark.createDataFrame([(k,) for k in [*range(300), 900, 901, 902]], "node long")
    found = {r["node"]: r["root"] for r in cluster.components(nodes, few).collect()}
    assert found == {r["node"]: r["root"] for r in cluster.components(nodes, edges).collect()} and found[902] == 901 and found[299] == 2
    assert few.count() <= 2 * 303 < len(pairs)
