import io
import os
import zipfile
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mediacat import catalog as cat
from mediacat.functions.dates import resolve_date
from mediacat.operators import browse, cdc, cluster, fts, people, search
from mediacat.plans import index
from mediacat.plans.index import run_index
from mediacat.schema import TABLES, empty
from mediacat.sources import documents, listing
from mediacat.streaming.monitor import TICK, fingerprint, settled, settling, start_monitor

FACES = TABLES["faces"]


def docx(*paragraphs, cells=()):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in paragraphs)
    t = "<w:tbl><w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in cells) + "</w:tr></w:tbl>" if cells else ""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p}{t}</w:body></w:document>")
        z.writestr("docProps/core.xml", "<x><dcterms:created>2020-01-02T03:04:05Z</dcterms:created></x>")
    return out.getvalue()


@pytest.fixture
def sample(spark):
    axis = lambda a, b: [a, b] + [0.0] * 510
    files = [(1, "lake1.jpg", "image", "2018-04-02", False), (2, "lake2.jpg", "image", "2018-09-21", False), (3, "party.jpg", "image", "2017-11-30", False), (4, "badge.webp", "image", "2018-05-05", True),
             (5, "board.jpg", "image", "2018-06-17", False), (6, "minutes.pdf", "pdf", "2016-02-08", False), (7, "flyer.pdf", "pdf", "2016-03-09", False)]
    f = spark.createDataFrame(files, "id long, rel_path string, kind string, taken_at string, is_sticker boolean")
    f = f.withColumns({"status": F.lit("done"), **{c: F.lit(None).cast("string") for c in ("city", "state", "country")}})
    clip = spark.createDataFrame([(1, axis(1.0, 0.0)), (2, axis(0.6, 0.8)), (3, axis(0.0, 1.0)), (4, axis(1.0, 0.0)), (5, axis(0.0, 1.0))], "file_id long, embedding array<float>")
    texts = spark.createDataFrame([(5, 1, "Welcome to the Láke"), (6, 1, "Clara Brito asks for a new jetty at the lake"), (7, 1, "Nothing of that sort")], "file_id long, page int, content string")
    persons = spark.createDataFrame([(1, "Clara Brito", False, None), (2, "Zoé", False, None)], TABLES["people"])
    rows = [(1, 1, 1, "cluster"), (2, 1, 2, "user"), (3, 2, 1, "auto"), (4, 3, 1, "suggested")]
    faces = spark.createDataFrame(rows, "id long, file_id long, person_id long, assign_source string")
    return search.Catalogue(f, texts, faces, persons, clip), lambda t: axis(1.0, 0.0)


def names(df):
    return [r["rel_path"] for r in df.collect()]


def test_search_goldens(sample):
    c, encode = sample
    r = search.search(c, search.Query(text="lake"), encode)
    assert names(r.hits)[0] == "lake1.jpg" and set(names(r.hits)) == {"lake1.jpg", "lake2.jpg", "board.jpg", "minutes.pdf"} and r.all_hits.count() == 4
    assert names(search.search(c, search.Query(text="lake", order="date"), encode).hits) == ["lake2.jpg", "board.jpg", "lake1.jpg", "minutes.pdf"]
    ranged = search.search(c, search.Query(text="lake", date_from="2018-04-01", date_to="2018-06-17"), encode)
    assert set(names(ranged.hits)) == {"lake1.jpg", "board.jpg"} and ranged.without_text.first()["total"] == 2
    assert names(search.search(c, search.Query(people=(1, 2))).hits) == ["lake1.jpg"]
    assert set(names(search.search(c, search.Query(text="lake")).hits)) == {"board.jpg", "minutes.pdf"}
    person = search.search(c, search.Query(text="clara  BRITO"), encode)
    assert set(names(person.hits)) == {"lake1.jpg", "lake2.jpg"} and names(person.mentions) == ["minutes.pdf"]
    assert search.find_person(c, "ZOE") == 2
    assert names(search.search(c, search.Query(kinds=("pdf",))).hits) == ["flyer.pdf", "minutes.pdf"]
    assert search.search(c, search.Query()).all_hits.count() == 6
    assert names(search.search(c, replace(search.Query(), limit=2, offset=1)).hits) == ["board.jpg", "lake1.jpg"]
    months = {r["month"]: r["n"] for r in browse.month_counts(search.candidates(c, search.Query(kinds=("image",)))).collect()}
    assert months == {"2018-09": 1, "2018-06": 1, "2018-04": 1, "2017-11": 1}
    assert search.Query(kinds=("image", "bad"), limit=9999, offset=-3, order="x").clamped() == search.Query(kinds=("image",), limit=500)
    assert '"rel_path":"lake2.jpg"' in search.json_rows(search.search(c, search.Query()).hits).first()["value"]
    near = {r["id"]: (r["previous"], r["next"]) for r in search.neighbours(c.files, [F.col("id")]).collect()}
    assert near[1] == (None, 2) and near[7] == (6, None)


def test_fifty_thousand_vectors(spark):
    """A hundred groups and noise, without a matrix of all pairs in any task."""
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(100, 128))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.concatenate([np.repeat(centres, 450, 0) + 0.03 * rng.normal(size=(45_000, 128)), rng.normal(size=(5_000, 128))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    points = pa.table({"i": np.arange(len(x)), "v": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 128).cast(pa.list_(pa.float32()))})
    labels = cluster.dbscan(spark.createDataFrame(points), 0.3, 3).where("label >= 0").groupBy("label").count().collect()
    assert len(labels) == 100 and sum(r["count"] for r in labels) == 45_000


def test_group_maxima(spark, monkeypatch):
    monkeypatch.setattr(cluster, "TILE", 5)
    rng = np.random.default_rng(4)
    x, labels = rng.normal(size=(40, 6)).astype(np.float32).astype(float), rng.integers(0, 7, 40)
    df = spark.createDataFrame([(k, v.tolist(), int(b)) for k, (v, b) in enumerate(zip(x, labels))], "i long, v array<float>, label long")
    sims = x @ x.T
    got = {(r["i"], r["label"]): r["score"] for r in cluster.group_maxima(df.where("i < 20").select("i", "v"), df, block=9).collect()}
    assert got == pytest.approx({(i, int(b)): sims[i, labels == b].max() for i in range(20) for b in set(labels)})
    got = {r["i"]: r["score"] for r in people.impostor_scores(df).collect()}
    assert got == pytest.approx({i: sims[i, labels != labels[i]].max() for i in range(40)})


def test_dbscan_borders_and_edges(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 16))
    pts = np.concatenate([b + 0.12 * rng.normal(size=(20, 16)) for b in base] + [rng.normal(size=(40, 16)), np.zeros((2, 16))])
    norm = np.linalg.norm(pts, axis=1, keepdims=True)
    pts = pts / np.maximum(norm, 1e-12)
    eps, least = 0.12, 4

    def brute():
        near = pts @ pts.T >= 1 - eps
        np.fill_diagonal(near, True)
        core = near.sum(1) >= least
        label, cur = np.full(len(pts), -1), 0
        for s in range(len(pts)):
            if core[s] and label[s] < 0:
                todo = [s]
                label[s] = cur
                while todo:
                    for j in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                        label[j] = cur
                        todo.append(j)
                cur += 1
        for i in np.flatnonzero(~core):
            own = label[near[i] & core]
            label[i] = own.min() if len(own) else -1
        return label.tolist()

    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pts)], "i long, v array<double>")
    got = {r["i"]: r["label"] for r in cluster.dbscan(df, eps, least, block=37).collect()}
    assert [got[i] for i in range(len(pts))] == brute()
    alone = spark.createDataFrame([(0, [1.0, 0.0])], "i long, v array<double>")
    assert [cluster.dbscan(alone, 0.3, m).first()["label"] for m in (1, 2)] == [0, -1]
    assert cluster.dbscan(alone.limit(0), 0.3, 2).count() == 0


def faces_df(spark, rows):
    full = [(i, f, None, 0.9, v, p, s, None, False) for i, f, v, p, s in rows]
    return spark.createDataFrame(full, FACES)


def test_grouping_and_corrections(spark):
    e = lambda k, a=1.0: [a if i == k else (1 - a * a) ** 0.5 if i == 7 else 0.0 for i in range(8)]
    rows = [(i, 1, e(0), None, None) for i in range(1, 5)] + [(i, 2, e(1), None, None) for i in range(5, 8)] + [(8, 3, e(2), None, None), (9, 4, e(0), None, None), (10, 1, [0.0] * 8, None, None)]
    files = spark.createDataFrame([(1, False, "done"), (2, False, "done"), (3, False, "done"), (4, True, "done")], "id long, is_sticker boolean, status string")
    s = people.Settings(0.8, 0.6, 0.1, 3)
    faces, persons, stats = people.group_faces(faces_df(spark, rows), files, empty(spark, "people"), empty(spark, "face_negatives"), s)
    faces, persons = faces.cache(), persons.cache()
    assert {r["what"]: r["n"] for r in stats.collect()} == {"clustered": 7, "people": 2}
    assert persons.count() == 2 and {r["cover_face_id"] for r in persons.collect()} == {1, 5}
    assert faces.where("person_id IS NULL").count() == 3
    more = faces.unionByName(faces_df(spark, [(20, 1, e(0, 0.95), None, None), (21, 1, e(0, 0.75), None, None)]))
    out = {r["id"]: (r["assign_source"], r["person_id"]) for r in people.group_faces(more, files, persons, empty(spark, "face_negatives"), s)[0].collect()}
    assert out[20][0] == "auto" and out[21][0] is None
    named = people.rename_person(persons, out[20][1], " Ana ")
    out = {r["id"]: r["assign_source"] for r in people.group_faces(more, files, named, empty(spark, "face_negatives"), s)[0].collect()}
    assert out[21] == "suggested"
    veto = spark.createDataFrame([(20, int(faces.where("id = 1").first()["person_id"]))], TABLES["face_negatives"])
    assert {r["id"]: r["assign_source"] for r in people.group_faces(more, files, named, veto, s)[0].collect()}[20] != "auto"
    with pytest.raises(ValueError):
        people.merge_people(faces, persons, veto, 1, 1)
    with pytest.raises(ValueError):
        people.Settings(0.6, 0.7).checked()
    merged, left, _ = people.merge_people(faces, persons, veto, 1, 2)
    assert left.count() == 1 and merged.where("person_id = 1").count() == 7
    after, persons2, negatives = people.remove_face(faces, persons, empty(spark, "face_negatives"), 1)
    assert after.where("id = 1").first()["person_id"] is None and negatives.count() == 1 and {r["cover_face_id"] for r in persons2.collect()} == {2, 5}
    again, gone = people.reset_groups(faces, persons)
    assert again.where("person_id IS NOT NULL").count() == 0 and gone.count() == 0
    pid, grown = people.person_for_name(named, "ANA")
    assert pid == faces.where("id = 1").first()["person_id"] and grown.count() == 2
    manual = people.add_manual_face(faces, {"file_id": 1, "bbox": (0, 0, 50, 50), "embedding": e(3), "person_id": 1})
    new = manual.where("manual").first()["id"]
    assert people.delete_manual_face(manual, 1).count() == 11 and people.delete_manual_face(manual, new).count() == 10


def test_scan_states(spark):
    known = [("a.jpg", "image", 1, 1.0, "done", None, ["date"]), ("b.jpg", "image", 1, 1.0, "done", None, ["date"]), ("c.jpg", "image", 1, 1.0, "missing", None, ["date"]), ("d.jpg", "image", 1, 1.0, "missing", "bad", []),
             (".h/e.jpg", "image", 1, 1.0, "done", None, []), ("f.mp4", "other", 1, 1.0, "done", None, []), ("g.jpg", "image", 1, 1.0, "error", "bad", [])]
    k = spark.createDataFrame(known, "rel_path string, kind string, size long, mtime double, status string, error string, stages_done array<string>")
    seen = spark.createDataFrame([("a.jpg", "image", 1, 2.0), ("c.jpg", "image", 1, 1.0), ("d.jpg", "image", 1, 1.0), ("f.mp4", "other", 1, 1.0), ("g.jpg", "image", 1, 1.0), ("n.jpg", "image", 5, 1.0)], "rel_path string, kind string, size long, mtime double")
    got = {r["rel_path"]: (r["change"], r["status"]) for r in cdc.apply_scan(k, seen).collect()}
    assert got == {"a.jpg": ("changed", "pending"), "b.jpg": ("gone", "missing"), "c.jpg": ("reappeared", "done"), "d.jpg": ("reappeared", "error"), "f.mp4": ("unchanged", "done"), "g.jpg": ("unchanged", "error"), "n.jpg": ("new", "pending")}
    assert {r["rel_path"] for r in cdc.apply_scan(k, seen, retry_errors=True).where("status = 'pending'").collect()} == {"a.jpg", "d.jpg", "g.jpg", "n.jpg"}
    pending = {(r["rel_path"], r["size"], r["mtime"]) for r in cdc.pending_changes(k, seen).collect()}
    assert ("b.jpg", -1, 0.0) in pending and ("n.jpg", 5, 1.0) in pending


def test_forced_and_retried_scans_forget(spark):
    known = [("a.jpg", "image", 1, 1.0, "done", None, ["date"]), ("b.jpg", "image", 1, 1.0, "error", "bad", ["date"]), ("c.mp4", "other", 1, 1.0, "done", None, [])]
    k = spark.createDataFrame(known, "rel_path string, kind string, size long, mtime double, status string, error string, stages_done array<string>")
    seen = k.select("rel_path", "kind", "size", "mtime")
    got = lambda **flags: {r["rel_path"]: (r["status"], r["error"], r["stages_done"], r["forget_place"]) for r in cdc.apply_scan(k, seen, **flags).collect()}
    assert got(force=True) == {"a.jpg": ("pending", None, None, True), "b.jpg": ("pending", None, None, True), "c.mp4": ("done", None, [], False)}
    assert got(force=True, retry_errors=True) == {"a.jpg": ("pending", None, None, True), "b.jpg": ("pending", None, None, False), "c.mp4": ("done", None, [], False)}


def test_settings_of_a_folder(spark):
    meta = empty(spark, "meta")
    assert people.load_settings(meta) == people.Settings()
    saved = people.save_settings(meta, people.Settings(0.8, 0.25, 0.2))
    assert people.load_settings(saved) == people.Settings(0.8, 0.25, 0.2) and people.load_settings(people.reset_settings(saved)) == people.Settings()
    with pytest.raises(ValueError):
        people.save_settings(meta, people.Settings(0.8, 0.19))


def test_versions_share_unchanged_tables(spark, tmp_path):
    c = cat.Catalog(spark, f"file://{tmp_path}", cat.root_id("x"))
    rows = lambda v: spark.createDataFrame([("a", v)], "key string, value string")
    persons = spark.createDataFrame([(1, "Ana", False, None)], TABLES["people"])
    assert (c.publish({"meta": rows("1"), "people": persons}), c.publish({"meta": rows("2")})) == (1, 2)
    written = lambda: len(list((tmp_path / f"root_id={cat.root_id('x')}/data").glob("*/people")))
    assert written() == 1 and c.read("people").count() == 1 and c.read("people_keys").first()["name_key"] == "ana"
    assert c.read("meta").first()["value"] == "2" and c.read("meta", 1).first()["value"] == "1"
    c.clean()
    assert c.read("people").count() == 1 and c.read("meta").first()["value"] == "2" and written() == 1


def test_catalogues_are_opened_and_switched(spark, tmp_path):
    all_of = cat.Catalogues(spark, f"file://{tmp_path}/catalogues")
    assert all_of.latest() is None and all_of.roots().count() == 0
    first = all_of.open("/media/a", 10.0)
    first.publish({"people": spark.createDataFrame([(1, "Ana", False, None)], TABLES["people"])})
    all_of.open("/media/b", 20.0)
    assert all_of.latest().base.endswith(cat.root_id("/media/b"))
    again = all_of.open("/media/a", 30.0)
    assert again.read("people").count() == 1 and all_of.latest().base == first.base
    assert [(r["root_path"], r["last_used"]) for r in all_of.recent().collect()] == [("/media/a", 30.0), ("/media/b", 20.0)]
    assert cat.get_meta(again.read("meta"), "schema_version") == str(cat.SCHEMA_VERSION)


def test_two_writers_never_undo_each_other(spark, tmp_path):
    first, second = (cat.Catalog(spark, f"file://{tmp_path}", cat.root_id("y")) for _ in range(2))
    rows = lambda v: spark.createDataFrame([("a", v)], "key string, value string")
    base = first.publish({"meta": rows("0")})
    assert first.publish({"meta": rows("1")}, base) == base + 1
    with pytest.raises(cat.Conflict):
        second.publish({"meta": rows("2"), "people": empty(spark, "people")}, base)
    assert second.version() == base + 1 and second.read("meta").first()["value"] == "1" and not second.holds("people")
    assert len(list((tmp_path / f"root_id={cat.root_id('y')}/data").iterdir())) == 2  # the loser has taken its own away
    assert second.publish({"meta": rows("3")}) == base + 2 and first.read("meta").first()["value"] == "3"


def test_index_after_changes_equals_a_rebuild(spark, tmp_path):
    c = cat.Catalog(spark, f"file://{tmp_path}", cat.root_id("z"))
    table = lambda *rows: spark.createDataFrame(rows, "content string, file_id long, page int")
    rows = lambda df: sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())
    steps = [
        (table(("One two one", 1, 1), ("three", 1, 2), ("two", 2, 1), (None, 5, 1)), 4),
        (table(("One two one", 1, 1), ("three", 1, 2), ("two", 2, 1), (None, 5, 1)), 0),
        (table(("One two one", 1, 1), ("three four", 1, 2), ("new", 3, 1), (None, 5, 1)), 3),  # one changed, one gone, one new
        (table(), 4),
    ]
    for texts, n in steps:
        c.publish({"texts": texts})
        version = c.version()
        assert index.sync_index(c) == n and c.version() == version + (n > 0)
        whole = fts.postings(texts)
        assert rows(c.read("fts_postings")) == rows(whole) and c.read("fts_totals").first()["n"] == texts.count()
        assert rows(c.read("fts_totals")) == rows(fts.totals(texts))
        got = fts.match_index(index.stored_index(c), "one")
        assert rows(got) == rows(fts.match(texts, "one").drop("content"))


def test_index_end_to_end(spark, tmp_path):
    root = tmp_path / "media"
    for rel, content in {"inbox/IMG-20190818-WA0044.jpg": b"\xff\xd8\xff", "papers/budget.docx": docx("Dear Zoé", "", cells=("a", "b")), "noext": b"%PDF-1.4", "VID-20190818-WA0045.mp4": b"x", ".hid/x.jpg": b"x", "bad.docx": b"junk"}.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_bytes(content)
    os.symlink(root / "noext", root / "link.pdf")
    store = cat.Catalog(spark, f"file://{tmp_path}/cat", cat.root_id(str(root)))

    def extract(work):
        paths = work.select("rel_path").collect()
        content = spark.createDataFrame([(r["rel_path"], bytearray((root / r["rel_path"]).read_bytes())) for r in paths], "rel_path string, content binary")
        read = documents.read_docx(content.where("rel_path LIKE '%.docx'")).cache()
        texts = read.where("error IS NULL").join(work.select(F.col("id").alias("file_id"), "rel_path"), "rel_path").select("content", "file_id", "page")
        date = resolve_date(F.substring_index("rel_path", "/", -1), F.lit("2026-09-24").cast("date"), F.lit(None).cast("timestamp_ntz"), F.col("created"), F.lit(0.0))
        files = work.join(read.select("rel_path", "error", "created"), "rel_path", "left").select("rel_path", "error", F.col("todo").alias("ran"), date.alias("d"))
        return {"files": files.select("rel_path", "error", "ran", F.col("d.taken_at").alias("r_taken_at"), F.col("d.date_source").alias("r_date_source")), "texts": texts}

    counts = run_index(spark, str(root), store, extract)
    assert counts["new"] == 5 and counts["processed"] == 4 and counts["errors"] == 1
    files = {r["rel_path"]: r for r in store.read("files").collect()}
    assert files["noext"]["kind"] == "pdf" and files["VID-20190818-WA0045.mp4"]["status"] == "done" and files["bad.docx"]["status"] == "error"
    assert files["inbox/IMG-20190818-WA0044.jpg"]["taken_at"] == "2019-08-18"
    assert (files["papers/budget.docx"]["taken_at"], files["papers/budget.docx"]["date_source"]) == ("2020-01-02T03:04:05", "document")
    assert store.read("texts").first()["content"] == "Dear Zoé\na | b"
    found = search.search(index.searchable(store), search.Query(text="ZOE")).hits.collect()
    assert [(r["rel_path"], r["snippet"]) for r in found] == [("papers/budget.docx", "Dear [Zoé]\na | b")]
    assert len({r["id"] for r in files.values()}) == 5
    again = run_index(spark, str(root), store, extract)
    assert again["processed"] == 0 and again["unchanged"] == 5
    os.remove(root / "papers/budget.docx")
    assert run_index(spark, str(root), store, extract)["gone"] == 1
    assert search.search(index.searchable(store), search.Query(text="zoe")).hits.count() == 0
    version = store.version()
    assert store.migrate() == version + 1 and store.migrate() == version + 1
    assert cat.get_meta(store.read("meta"), "root_path") == str(root)
    with pytest.raises(ValueError):
        run_index(spark, str(root), store, extract, only=["nope"])


def test_listing_and_monitor(spark, tmp_path, tmp_path_factory):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/.nomedia").write_bytes(b"")
    (tmp_path / "x.jpg").write_bytes(b"abc")
    assert {(r["rel_path"], r["size"]) for r in listing.list_folder(spark, str(tmp_path)).collect()} == {("a/.nomedia", 0), ("x.jpg", 3)}
    ticks = spark.createDataFrame([(1, "f", 1, 1.0), (2, "f", 2, 1.0), (3, "f", 2, 1.0)], "tick int, rel_path string, size long, mtime double")
    assert {r["tick"]: r["act"] for r in settled(ticks).collect()} == {1: False, 2: False, 3: True}
    assert fingerprint(ticks.limit(0)) is None
    known = spark.createDataFrame([], "rel_path string, size long, mtime double, status string")
    done = []
    q = start_monitor(spark, str(tmp_path), lambda: known, lambda: done.append(1), str(tmp_path_factory.mktemp("checkpoint")), seconds=1)
    try:
        for _ in range(60):
            if done:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert done


def test_settling_survives_a_restart(spark, tmp_path):
    """The state is the checkpoint's: each run of the query is another one, and sees only ticks that the runs before have not."""
    found = []

    def run(*ticks):
        spark.createDataFrame(list(ticks), TICK).write.mode("append").parquet(f"{tmp_path}/ticks")
        stream = settling(spark.readStream.schema(TICK).parquet(f"{tmp_path}/ticks"))
        keep = lambda batch, _: found.extend(tuple(r) for r in batch.collect())
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    signs = [None, "1", "2", "2", None, "3", "3", "3"]
    run(*[("a", k, s) for k, s in enumerate(signs[:3])], ("b", 0, "9"))
    run(("a", 3, "2"), ("b", 1, "8"))
    run(*[("a", k, signs[k]) for k in range(4, 6)], ("b", 2, "8"))
    run(*[("a", k, signs[k]) for k in range(6, 8)])
    assert [act for root, _, act in sorted(found) if root == "a"] == [False, False, False, True, False, False, True, False]
    assert [act for root, _, act in sorted(found) if root == "b"] == [False, False, True]


def test_model_manifest(spark):
    manifest = listing.model_manifest(spark.createDataFrame([("| `m.onnx` | ABC | MIT | web |",), ("| x | y |",), ("|---|---|---|---|",)], "value string"))
    assert [tuple(r) for r in manifest.collect()] == [("m.onnx", "ABC", "MIT", "web")]
    assert listing.check_models(manifest, spark.createDataFrame([], "file string, content binary")).first()["state"] == "absent"
