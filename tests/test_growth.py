"""What must not grow with the input: plans without needless shuffles, and the results they must keep."""

import os
import threading
from datetime import date

import pytest
from pyspark.sql import functions as F

from mediacat.catalog import Catalog
from mediacat.functions import vectors
from mediacat.operators import cluster, fts, metric, people, search
from mediacat.plans import bindings, index
from mediacat.plans.extract import extractor
from mediacat.plans.index import Staged, listed, scan, sync_index
from mediacat.plans.upkeep_queries import stand_ins
from mediacat.sources.listing import list_folder
from mediacat.sources.pictures import PictureWriter, save_pictures

PAGES = [(1, 1, "foo bar foo"), (1, 2, ""), (2, 1, "bar, Bár baz"), (3, 1, None), (4, 1, "foo")]


def texts(spark, rows=PAGES):
    return spark.createDataFrame(rows, "file_id long, page int, content string")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(str(r.asDict()) for r in df.collect())


def test_postings_are_made_within_pages(spark):
    t = texts(spark)
    found = fts.postings(t)
    assert "Exchange" not in plan(found)
    assert rows(found) == rows(fts.postings(t, distinct=False)) and found.where("token = 'bar' AND file_id = 2").first()["positions"] == [0, 1]


def test_runs_of_tokens_are_cut_between_pages(spark, monkeypatch):
    long = [(k, 1, "a b a " * k) for k in range(1, 9)]
    whole = rows(fts.postings(texts(spark, long), distinct=False))
    monkeypatch.setattr(fts, "RUN_TOKENS", 10)
    monkeypatch.setattr(fts._page_runs, "__module__", "__main__")  # sent to workers by value, with the smaller cut
    assert rows(fts.postings(texts(spark, long))) == whole


def test_pages_that_share_a_key_are_brought_together(spark, tmp_path):
    t = texts(spark, [*PAGES, (1, 1, "bar bar foo"), (None, 1, "foo")])
    assert {r["token"]: (r["tf"], len(r["positions"])) for r in fts.postings(t).where("file_id = 1 AND page = 1").collect()} == {"foo": (3, 3), "bar": (3, 3)}
    assert {r["token"]: (r["df"], r["cf"]) for r in fts.token_frequencies(t).collect()} == {"foo": (3, 5), "bar": (2, 5), "baz": (1, 1)}
    c = Catalog(spark, str(tmp_path), "a" * 16)
    assert sync_index(c, t) == 7 and rows(c.read("fts_postings")) == rows(fts.postings(t).select(*c.read("fts_postings").columns))


def test_token_frequencies_shuffle_tokens_alone(spark):
    found = fts.token_frequencies(texts(spark))
    assert {r["token"]: (r["df"], r["cf"]) for r in found.collect()} == {"foo": (2, 3), "bar": (2, 3), "baz": (1, 1)}
    assert plan(found).split("Initial Plan")[-1].count("Exchange") == 1


def test_the_first_index_compares_with_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fts, "index_changes", lambda *a: pytest.fail("nothing is indexed yet"))
    c = Catalog(spark, str(tmp_path), "a" * 16)
    assert sync_index(c, texts(spark)) == len(PAGES) and rows(c.read("fts_totals")) == rows(fts.totals(texts(spark)))


def test_vector_searches_make_no_text_index(spark, monkeypatch):
    monkeypatch.setattr(bindings, "published", lambda *a: pytest.fail("no text is searched"))
    assert bindings.catalogue(spark, "/root/testdata/sf0.001").vector_index is not None


def test_settings_are_not_shuffled(spark):
    key = "key string, value string"
    defaults = spark.range(1000).select(F.concat(F.lit("note "), "id").alias("key"), F.lit("0").alias("value")).union(spark.createDataFrame([("auto", "0.7"), ("eps", "0.3"), (None, "1")], key))
    meta = spark.range(1000).select(F.concat(F.lit("other "), "id").alias("key"), F.lit("9").alias("value")).union(spark.createDataFrame([("faces_t_auto", "0.8")], key))
    out = people.effective_settings(meta, defaults)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "hashpartitioning" not in plan(people.effective_settings(meta, defaults))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out.count() == 1003 and {r["key"]: r["value"] for r in out.where("key IN ('auto', 'eps') OR key IS NULL").collect()} == {"auto": "0.8", "eps": "0.3", None: "1"}


def test_files_with_several_people_take_one_join(spark):
    files = spark.range(6).select("id")
    faces = spark.createDataFrame([(0, 1, "user"), (0, 2, "auto"), (1, 1, "user"), (1, 1, "auto"), (2, 2, "user"), (2, 1, "suggested"), (3, 1, None), (3, 2, "user"), (4, 2, "auto"), (4, 1, "user")], "file_id long, person_id long, assign_source string")
    c = search.Lazy(faces=lambda: faces)
    found = search.with_people(c, search.Query(people=(1, 2)), files)
    assert [r["id"] for r in found.orderBy("id").collect()] == [0, 4] and plan(found).split("Initial Plan")[0].count("LeftSemi") == 1
    assert [r["id"] for r in search.with_people(c, search.Query(people=(1, 1)), files).orderBy("id").collect()] == [0, 1, 4]


def test_what_a_chunk_has_extracted_is_stored_without_joins(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"picture,1000,800,2019:07:01 10:11:12")
    work = spark.createDataFrame([(5, "a.jpg", "image", ["date", "faces", "clip", "ocr"])], "id long, rel_path string, kind string, todo array<string>")
    found = extractor(str(tmp_path), stand_ins(), date(2026, 1, 1))(work)
    assert all("Join" not in plan(found[t]) for t in ("files", "texts", "faces", "clip_embeddings"))
    assert [r["file_id"] for t in ("texts", "faces", "clip_embeddings") for r in found[t].collect()] == [5, 5, 5]


def test_a_chunk_is_one_table(spark, tmp_path):
    for name, content in (("a.jpg", b"picture,1000,800,2019:07:01 10:11:12"), ("bad.jpg", b"junk,1,1,"), ("huge.jpg", b"picture,100000,100000,")):
        (tmp_path / name).write_bytes(content)
    work = spark.createDataFrame([(k, n, "image", ["date", "thumb", "faces", "clip", "ocr"]) for k, n in enumerate(("a.jpg", "bad.jpg", "huge.jpg"), 5)], "id long, rel_path string, kind string, todo array<string>")
    found = extractor(str(tmp_path), stand_ins(), date(2026, 1, 1))(work)
    staged = Staged(Catalog(spark, f"file://{tmp_path}/cat", "a" * 16))
    assert staged.add("x", {"raw": found["raw"].drop("thumb")}) == {"files": 3, "errors": 2}  # what is too large is an error, too
    assert sorted(n for n in os.listdir(f"{staged.base.removeprefix('file://')}/x") if not n.startswith(".")) == ["_DONE", "raw"] and staged.chunks() == ["x"]
    out = staged.read(["x"])
    for t in ("files", "texts", "faces", "clip_embeddings"):
        assert rows(out[t]) == rows(found[t]) and out[t].count()
    assert found["thumbs"].count() == 2 and out["thumbs"].count() == 0


def test_only_files_without_an_extension_are_opened(spark, tmp_path):
    for name in ("a.jpg", "b", ".c"):
        (tmp_path / name).write_bytes(b"%PDF-1.4")
    heads = {r["rel_path"]: r["head"] and bytes(r["head"]) for r in list_folder(spark, str(tmp_path), bare=True).collect()}
    every = {r["rel_path"]: r["head"] and bytes(r["head"]) for r in list_folder(spark, str(tmp_path)).collect()}
    assert heads == {**every, "a.jpg": None} and every["a.jpg"] == b"%PDF-1.4"
    assert {r["rel_path"]: r["kind"] for r in listed(spark, str(tmp_path)).collect()} == {"a.jpg": "image", "b": "pdf", ".c": "pdf"}


def test_the_first_scan_writes_no_dependent_tables(spark, tmp_path):
    seen = spark.createDataFrame([("a.jpg", "image", 1, 1.0), ("b.pdf", "pdf", 1, 1.0)], "rel_path string, kind string, size long, mtime double")
    store = Catalog(spark, f"file://{tmp_path}", "a" * 16)
    scan(store, seen)
    assert store.read("files").count() == 2 and not any(store.holds(t) for t in ("texts", "faces", "clip_embeddings", "face_negatives"))
    ids = {r["rel_path"]: r["id"] for r in store.read("files").collect()}
    store.publish({"texts": texts(spark, [(i, 1, "x") for i in ids.values()]), "faces": spark.createDataFrame([(n, i) for n, i in enumerate(ids.values())], "id long, file_id long"),
                   "face_negatives": spark.createDataFrame([(0, 1), (1, 1), (9, 1)], "face_id long, person_id long")})
    store.publish({"files": store.read("files").withColumn("status", F.lit("done"))})
    scan(store, seen.withColumn("size", F.when(F.col("rel_path") == "a.jpg", 2).otherwise(F.col("size")).cast("long")))
    assert [r["file_id"] for r in store.read("texts").collect()] == [ids["b.pdf"]] and store.read("faces").count() == 2 and store.read("face_negatives").count() == 2


def test_chunks_run_side_by_side(spark, tmp_path, monkeypatch):
    (tmp_path / "m").mkdir()
    for k in range(14):
        (tmp_path / "m" / f"{k}.jpg").write_bytes(b"picture,1000,800,2019:07:01 10:11:12")
    store, both, add, states = Catalog(spark, f"file://{tmp_path}/cat", "a" * 16), threading.Barrier(2, timeout=60), Staged.add, []

    def waits(self, name, tables):
        both.wait()  # breaks if nobody else comes
        return add(self, name, tables)

    monkeypatch.setattr(Staged, "add", waits)
    root = str(tmp_path / "m")
    counts = index.run_index(spark, root, store, extractor(root, stand_ins(), date(2026, 1, 1)), chunk_files=7, progress=states.append)
    assert counts["processed"] == 14 and counts["errors"] == 0 and [s["done"] for s in states] == sorted(s["done"] for s in states) and states[-1]["done"] == 14


def test_chunks_under_way_are_finished_when_one_fails():
    ended, second = [], threading.Event()

    def begun(pool):
        yield pool.submit(lambda: second.wait(60) and ended.append(1))
        second.set()
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        list(index._in_flight(begun))
    assert ended == [1]


def test_names_of_a_marked_folder_stay_with_the_tasks(spark, tmp_path):
    out = str(tmp_path / "out")
    writer = PictureWriter(out, marked=True)
    told = writer.write(iter([{"name": "a/b/1.jpg", "content": b"1"}, {"name": "../2.jpg", "content": b"2"}]))
    assert told.names == [] and open(f"{out}/a/b/1.jpg", "rb").read() == b"1" and open(f"{out}/2.jpg", "rb").read() == b"2"
    writer.commit([told])
    assert sorted(os.listdir(out)) == ["2.jpg", "a"]
    save_pictures(spark.range(20).select(F.format_string("a/%d.jpg", "id").alias("name"), F.lit(b"x").alias("content")), out, str(tmp_path / "in"), marked=True)
    assert sorted(os.listdir(out)) == ["2.jpg", "a"] and len(os.listdir(f"{out}/a")) == 21


def test_a_norm_is_made_once_a_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,), ([3.0, None],)], "v array<double>").select(vectors.normalise(F.col("v")).alias("u"))
    inner = df._jdf.queryExecution().analyzed().toString().split("Project", 1)[1]
    assert inner.index("aggregate(") < inner.index("transform(")  # not made again for each number
    assert [r["u"] for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0], [], None, [3.0 / 1e-12, None]]


def test_groups_of_equal_vectors_are_dealt_to_several_tasks(spark):
    rows = spark.range(4000).select(F.col("id").alias("i"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: (k == F.col("id") % 10).cast("float")).alias("v"))
    dealt = metric._dealt(rows, 0.95, 100, 256).withColumn("p", F.spark_partition_id())
    tasks = dealt.groupBy("p").agg(F.countDistinct("cell", "ring", "block", "shard").alias("n")).collect()
    assert len(tasks) == 8 and max(r["n"] for r in tasks) - min(r["n"] for r in tasks) <= 1
    assert {r["n"] for r in cluster.dbscan(rows, 0.05, 50).groupBy("label").agg(F.count("*").alias("n")).collect()} == {400}
