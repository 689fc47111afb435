import collections

import corpus_pipeline
from pyspark.sql import functions as F
from mediacat.llm.shared import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        rows = docs.collect()
        if name == "packing":
            break
        ids = [r["doc_id"] for r in rows]
        assert docs.columns == corpus_pipeline.COLUMNS and set(ids) <= before and len(set(ids)) == len(ids)
        before = set(ids)
    assert {r["doc_id"] for r in rows} == before
    bins = collections.defaultdict(int)
    for r in rows:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 4096 and all(r["ids_crc32"] >= 0 for r in rows)


def test_awkward_rows(spark):
    prose = " ".join(f"the of word{i}" for i in range(60))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, prose, "en", "s", 9), (3, prose, "en", "s", 9), (None, prose + " more", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.by_rules(spark, docs, SF).collect()] == [3, 3, None]
    assert corpus_pipeline.by_near_duplicates(spark, docs, SF).count() == 3
    assert corpus_pipeline.by_benchmark(spark, docs, SF).count() == 5
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_every_stage_keeps_what_brute_force_keeps(spark, tmp_path):
    """Each stage's decisions recomputed in plain Python (the rules by their SQL) from what the stage before has kept.  The labels are by
    length here: of the given ones only good ones pass the rules at this size."""
    import shutil

    import duckdb
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from mediacat.llm import quality_classifier
    from mediacat.llm.queries import OP10_SQL
    from test_operators import brute_components, brute_contamination, check_packing

    names = corpus_pipeline.COLUMNS
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    rows += [{**rows[k], "doc_id": 9000 + k, "text": rows[k]["text"] + (" and one word more" if k % 2 else "")} for k in range(0, 60, 3)]
    rows += [{**rows[1], "doc_id": 9999, "text": t} for t in ("", None)]
    middle = sorted(r["n_chars"] for r in rows)[len(rows) // 2]
    shutil.copy(f"{SF}/benchmark.parquet", tmp_path)
    pq.write_table(pa.table({"doc_id": [r["doc_id"] for r in rows], "quality": pa.array([int(r["n_chars"] > middle) for r in rows], pa.int32())}), tmp_path / "labels.parquet")
    sf = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda rs: spark.createDataFrame([tuple(r[c] for c in names) for r in rs], schema).withColumns({c: F.lit("odd") for c in ("score", "predicted", "carried", "times", "own", "matches", "contaminated", "_hash")})
    run = lambda stage, rs: stage(spark, frame(rs), sf).collect()
    left = lambda rs, ids: [r for r in rs if r["doc_id"] in ids]
    stages = [f for _, f in corpus_pipeline.STAGES]

    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist(rows))
    kept = {i for i, ok in con.execute(f"SELECT doc_id, kept FROM ({OP10_SQL})").fetchall() if ok}
    got = run(stages[0], rows)
    assert sorted(r["doc_id"] for r in got) == sorted(kept) and got[0].__fields__ == names
    rows = left(rows, kept)

    labels = {}
    for r in pq.read_table(f"{sf}/labels.parquet").to_pylist():
        if r["quality"] is not None:
            labels[r["doc_id"]] = min(r["quality"], labels.get(r["doc_id"], 1))
    x = {r["doc_id"]: quality_classifier.statistics(r["text"]) for r in rows}
    known = [i for i in x if i in labels]
    model = quality_classifier.fit(frame(rows), spark.read.parquet(f"{sf}/labels.parquet"))
    matrix = np.array([x[i] for i in known])
    assert np.allclose(model.mean, matrix.mean(0)) and np.allclose(model.scale, np.maximum(matrix.std(0), 1e-6))
    score = lambda v: float(np.clip(np.interp(model.fourier(np.array([v])) @ model.weights, model.knots, model.values), 0, 1)[0])
    kept = {i for i, v in x.items() if score(v) >= 0.7}
    assert sorted(r["doc_id"] for r in run(stages[1], rows)) == sorted(kept) and 0 < len(kept) < len(rows)
    rows = left(rows, kept)

    groups = brute_components([(r["doc_id"], r["text"]) for r in rows], 5, 80)
    kept = {least for _, least in groups.values()}
    assert sorted(r["doc_id"] for r in run(stages[2], rows)) == sorted(kept) and len(kept) < len(rows)
    rows = left(rows, kept)

    found = brute_contamination(rows, {b["item_id"]: b["text"] for b in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()})
    kept = {i for i, hits in found.items() if not hits}
    assert sorted(r["doc_id"] for r in run(stages[3], rows)) == sorted(kept) and len(kept) < len(rows)
    rows = left(rows, kept)

    packed = run(stages[4], rows)
    assert {r["doc_id"] for r in packed} == kept
    bins, least = check_packing(packed, [(r["doc_id"], r["text"]) for r in rows])
    assert bins <= least + 1
