"""Vectors stored by cell: exact results out of fewer files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediacat import catalog as cat
from mediacat.operators import vector_index
from mediacat.plans.index import stored_vectors, sync_vectors


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(12, 32))
    x = np.repeat(centres, 200, 0) + 0.15 * rng.normal(size=(2400, 32))
    x = np.concatenate([x, np.zeros((5, 32))])
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


@pytest.fixture(scope="module")
def store(spark, vectors, tmp_path_factory):
    c = cat.Catalog(spark, f"file://{tmp_path_factory.mktemp('cells')}", cat.root_id("v"))
    c.publish({"clip_embeddings": spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "file_id long, embedding array<float>")})
    old, vector_index.CELL_ROWS = vector_index.CELL_ROWS, 60
    assert sync_vectors(c) and not sync_vectors(c)
    vector_index.CELL_ROWS = old
    return c


def files_read(df):
    """Files that the scan has read, by its own metric."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if name.startswith("Scan parquet"):
            total += p.metrics().apply("numFiles").value()
        children = p.children()
        todo += [children.apply(k) for k in range(children.size())]
        if "QueryStage" in name:
            todo.append(p.plan())
    return total


def test_a_search_reads_the_cells_that_can_hold_a_hit(spark, store, vectors, monkeypatch):
    monkeypatch.setattr(vector_index, "FIRST_ROWS", 100)
    index = stored_vectors(store)
    every = len(index.placed.inputFiles())
    for q in (vectors[3], vectors[700], vectors[2300] * 2, -vectors[5]):
        sims = vectors.astype(float) @ q.astype(float)
        found = vector_index.near(index, q.tolist(), 0.8)
        assert {r["file_id"]: r["sim"] for r in found.collect()} == pytest.approx({int(k): sims[k] for k in np.flatnonzero(sims >= 0.8)})
        best = vector_index.nearest(index, q.tolist(), 10, 0.2)
        want = sorted(((-sims[k], k) for k in range(len(sims)) if sims[k] >= 0.2))[:10]
        assert [r["file_id"] for r in best.collect()] == [k for _, k in want]
        assert files_read(found) < every / 3 and files_read(best) < every / 2


def test_filters_and_few_hits(spark, store, vectors):
    index, q = stored_vectors(store), vectors[0]
    sims = vectors.astype(float) @ q.astype(float)
    odd = spark.range(1, 2400, 2).select(F.col("id").alias("file_id"))
    got = [r["file_id"] for r in vector_index.nearest(index, q.tolist(), 5, 0.2, odd).collect()]
    assert got == [k for _, k in sorted((-sims[k], k) for k in range(1, 2400, 2) if sims[k] >= 0.2)[:5]]
    none = odd.where("file_id < 0")
    assert vector_index.nearest(index, q.tolist(), 5, 0.2, none).count() == 0
    many = vector_index.nearest(index, q.tolist(), 5000, 0.9).count()
    assert many == int((sims >= 0.9).sum())


def test_changes_are_noticed(spark, store):
    before = store.version()
    store.publish({"clip_embeddings": store.read("clip_embeddings").where("file_id <> 7")})
    assert sync_vectors(store) and store.version() == before + 2 and store.read("clip_placed").where("file_id = 7").count() == 0
    store.publish({"clip_embeddings": store.read("clip_embeddings").limit(0)})
    assert sync_vectors(store)
    assert vector_index.near(stored_vectors(store), [1.0] * 32, 0.1).count() == 0
