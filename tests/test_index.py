"""Index runs in chunks: batches of bounded size, resumption after a kill, cancellation, pictures that appear when committed."""

import hashlib
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from mediacat import catalog as cat
from mediacat.functions import geometry
from mediacat.plans import extract, index
from mediacat.plans.extract import Engines, EngineSource, extracted, extractor, in_batches, region_faces
from mediacat.sources import listing
from mediacat.sources.pictures import PictureWriter, Written, save_pictures


def image(content, header_only):
    w, h = map(int, content.split(b",")[1:3])
    return {"width": w, "height": h, "exif_date": "2019:07:01 10:11:12", "lat_ref": None, "lat": None, "lon_ref": None, "lon": None}


def engines(log=None):
    def encode(contents):
        if log:
            with open(log, "a") as f:
                f.write(f"{len(contents)} {sum(map(len, contents))}\n")
        return [[float(b) for b in hashlib.sha256(c).digest()[:4]] for c in contents]

    face = lambda w, score: {"x": 1.0, "y": 2.0, "w": w, "h": 60.0, "score": score, "embedding": [0.0, 2.0]}
    return Engines(image=image, thumb=lambda c: c[:6], faces=lambda c: [face(50.0, 0.9), face(39.0, 0.9), face(50.0, 0.79)], encode=encode,
                   pdf=lambda c: (["text of a page", ""], None), render=lambda c, k: b"page %d" % k, ocr=lambda c: [(c.decode(errors="ignore")[:6], 0.9)])


def folder(path, n=12):
    path.mkdir()
    for k in range(n):
        (path / f"p{k:02d}.jpg").write_bytes(b"picture,%d,800," % (1000 + k) + b"x" * 100 * k)
    (path / "doc.pdf").write_bytes(b"%PDF")
    (path / "bad.jpg").write_bytes(b"junk")
    return str(path)


def test_batches_by_bytes():
    cut = lambda sizes, most, n=100: list(in_batches(iter(sizes), lambda x: x, most, n))
    assert cut([3, 3, 3, 20, 1, 1], 7) == [[3, 3], [3], [20], [1, 1]] and cut([], 5) == [] and cut([1] * 5, 100, 2) == [[1, 1], [1, 1], [1]]


def test_encoder_gets_bounded_batches_and_is_made_once(spark, tmp_path):
    root, log, made = folder(tmp_path / "m"), str(tmp_path / "log"), str(tmp_path / "made")

    def load():
        with open(made, "a") as f:
            f.write(f"{os.getpid()}\n")
        return engines(log)

    work = spark.createDataFrame([(f"p{k:02d}.jpg", "image", ["clip"]) for k in range(12)], "rel_path string, kind string, todo array<string>").coalesce(1)
    source = EngineSource(f"test-{tmp_path}", load)
    for _ in range(2):
        rows = extracted(work, root, source, batch_bytes=1500).collect()
    assert all(r["error"] is None and len(r["embedding"]) == 4 for r in rows)
    sizes = [tuple(map(int, x.split())) for x in open(log)]
    assert sum(n for n, _ in sizes) == 24 and len(sizes) > 6 and all(total <= 1500 or n == 1 for n, total in sizes)
    pids = open(made).read().split()
    assert len(pids) == len(set(pids))  # once a process


def test_pictures_come_to_the_encoder_in_its_form(spark, tmp_path):
    import numpy as np

    root = folder(tmp_path / "m", 2)
    pixels = lambda c: np.full((40, 60, 3), len(c) % 256, np.uint8)
    source = Engines(pixels=pixels, encode=lambda xs: [[x.shape == (3, 224, 224), float(x[0, 0, 0])] for x in xs])
    work = spark.createDataFrame([("p00.jpg", "image", ["clip"]), ("p01.jpg", "image", ["clip"])], "rel_path string, kind string, todo array<string>")
    got = {r["rel_path"]: r["embedding"] for r in extracted(work, root, source).collect()}
    for name, (whole, value) in got.items():
        size = os.path.getsize(f"{root}/{name}") % 256
        assert whole == 1.0 and value == pytest.approx((size / 255 - geometry.MEAN[0]) / geometry.STD[0], abs=1e-5)


def test_text_encoder_gives_unit_vectors():
    import public_tokenizers

    asked = []
    encode = geometry.text_encoder(public_tokenizers.path("word_bpe_49k.json"), lambda ids: asked.append(ids) or [3.0, 4.0], length=8)
    assert encode(" a  lake\n") == [0.6, 0.8] and len(asked[0]) == 8 and asked[0][-1] == geometry.PAD
    assert encode("a lake") == [0.6, 0.8] and asked[0] == asked[1]


def test_chunks_survive_a_kill(spark, tmp_path):
    root, thumbs = folder(tmp_path / "m"), str(tmp_path / "thumbs")
    store = cat.Catalog(spark, f"file://{tmp_path}/cat", cat.root_id(root))
    inner, seen, states = extractor(root, engines(), date(2026, 9, 24)), [], []

    def dies(work):
        if len(seen) == 2:
            raise RuntimeError("killed")
        seen.append({r["rel_path"] for r in work.select("rel_path").collect()})
        return inner(work)

    with pytest.raises(RuntimeError):
        index.run_index(spark, root, store, dies, chunk_files=4, thumbs=thumbs)
    (tmp_path / "cat" / f"root_id={cat.root_id(root)}" / "staged" / "half").mkdir()  # a chunk that was being written
    assert store.read("files").where("status = 'done'").count() == 0 and len(index.Staged(store).chunks()) == 2
    again = []

    def goes_on(work):
        again.append({r["rel_path"] for r in work.select("rel_path").collect()})
        return inner(work)

    counts = index.run_index(spark, root, store, goes_on, chunk_files=4, thumbs=thumbs, progress=states.append)
    first, second = set().union(*seen), set().union(*again)
    assert not first & second and len(first | second) == 14 and counts["resumed"] == 2 and counts["processed"] == len(second) and counts["errors"] == 1
    assert states[-1]["done"] == states[-1]["total"] == len(second) and index.Staged(store).chunks() == []
    files = {r["rel_path"]: r for r in store.read("files").collect()}
    assert {p for p, r in files.items() if r["status"] == "done"} == set(files) - {"bad.jpg"}
    assert store.read("clip_embeddings").count() == 12
    # the detector's filter: score and the shorter side; boxes are in pixels of the original
    assert store.read("faces").groupBy("file_id").count().where("count <> 1").count() == 0 and store.read("faces").count() == 12
    assert {int(n[:-4]) for n in os.listdir(thumbs)} == {r["id"] for p, r in files.items() if p != "bad.jpg"}
    assert open(f"{thumbs}/{files['doc.pdf']['id']}.jpg", "rb").read() == b"page 1"
    texts = store.read("texts").where(F.col("file_id") == files["doc.pdf"]["id"]).orderBy("page").collect()
    assert [(r["page"], r["content"]) for r in texts] == [(1, "text of a page"), (2, "page 2")]
    assert index.run_index(spark, root, store, goes_on)["processed"] == 0


def test_saved_chunks_are_not_saved_twice(spark, tmp_path, monkeypatch):
    root = folder(tmp_path / "m", 3)
    store = cat.Catalog(spark, f"file://{tmp_path}/cat", cat.root_id(root))
    monkeypatch.setattr(index.Staged, "drop", lambda self, names: None)  # dies before it can delete
    index.run_index(spark, root, store, extractor(root, engines(), date(2026, 9, 24)))
    texts = store.read("texts").count()
    assert index.Staged(store).chunks()
    assert index.merge_staged(store, root) == 0 and store.read("texts").count() == texts


def test_a_cancelled_run_keeps_its_chunks(spark, tmp_path):
    root = folder(tmp_path / "m", 8)
    store = cat.Catalog(spark, f"file://{tmp_path}/cat", cat.root_id(root))
    inner, calls = extractor(root, engines(), date(2026, 9, 24)), []

    def run(work):
        calls.append(index.index_tag(store) in spark.sparkContext.getJobTags())
        return inner(work)

    counts = index.run_index(spark, root, store, run, chunk_files=3, cancelled=lambda: len(calls) >= 2)
    done = store.read("files").where("status IN ('done', 'error')").count()
    assert calls == [True, True] and 0 < counts["processed"] == done < 10 and index.index_tag(store) not in spark.sparkContext.getJobTags()


def test_pictures_appear_when_committed(spark, tmp_path):
    out, rows = str(tmp_path / "out"), spark.createDataFrame([(f"{k}.jpg", bytearray([k])) for k in range(20)], "name string, content binary").repartition(4)
    with pytest.raises(ValueError):
        save_pictures(rows, str(tmp_path / "in" / "x"), str(tmp_path / "in"))
    bad = rows.withColumn("content", F.when(F.col("name") == "7.jpg", F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    with pytest.raises(Exception):
        save_pictures(bad, out, str(tmp_path / "in"))
    assert not os.path.exists(out) or [n for n in os.listdir(out) if n.endswith("jpg")] == []
    save_pictures(rows, out, str(tmp_path / "in"))
    assert sorted(os.listdir(out)) == sorted(f"{k}.jpg" for k in range(20)) and open(f"{out}/7.jpg", "rb").read() == b"\x07"
    writer = PictureWriter(out)
    told = writer.write(iter([{"name": "new.jpg", "content": b"1"}]))
    assert isinstance(told, Written) and "new.jpg" not in os.listdir(out)
    writer.abort([told])
    assert "new.jpg" not in os.listdir(out) and "_staged" not in os.listdir(out)


def test_region_embed_takes_the_nearest_face(spark, tmp_path):
    root = folder(tmp_path / "m", 1)
    asked = []

    def region(content, r, zoom):
        face = lambda x, y, score: {"x": (x - r["x0"]) * zoom, "y": (y - r["y0"]) * zoom, "w": 40 * zoom, "h": 40 * zoom, "score": score, "embedding": [3.0, 4.0]}
        return [] if r["x0"] > 500 else [face(100, 100, 0.6), face(130, 100, 0.9)]

    boxes = spark.createDataFrame([(1, "p00.jpg", (100, 102, 40, 40), 1000, 800), (2, "p00.jpg", (900, 100, 50, 50), 1000, 800), (3, "p00.jpg", (999, 799, 1, 1), 1000, 800)], "key long, rel_path string, box struct<x:int,y:int,w:int,h:int>, width int, height int")
    got = {r["key"]: r for r in region_faces(boxes, root, Engines(region=region)).collect()}
    assert tuple(got[1]["bbox"]) == (100, 100, 40, 40) and got[1]["det_score"] == 0.6 and got[1]["embedding"] == pytest.approx([0.6, 0.8])
    assert got[2]["bbox"] is None and got[3]["bbox"] is None and asked == []
    assert extract.engines_here(Engines()) == Engines()


def test_one_folder_on_top_is_many_tasks(spark, tmp_path):
    root = tmp_path / "m"
    for k in range(24):
        (root / "only" / f"d{k}" / ".hidden").mkdir(parents=True)
        (root / "only" / f"d{k}" / "f.jpg").write_bytes(b"\xff\xd8\xff")
        (root / "only" / f"d{k}" / ".kept").write_bytes(b"x")
        (root / "only" / f"d{k}" / ".hidden" / "g.jpg").write_bytes(b"x")
    os.symlink(root / "only" / "d0", root / "link")
    os.symlink(root / "only" / "d0" / "f.jpg", root / "link.jpg")
    rows = listing.list_folder(spark, str(root)).withColumn("task", F.spark_partition_id()).collect()
    assert {r["rel_path"] for r in rows} == {f"only/d{k}/{n}" for k in range(24) for n in ("f.jpg", ".kept")}
    assert len({r["task"] for r in rows}) > 4 and all(bytes(r["head"]) == b"\xff\xd8\xff" for r in rows if r["rel_path"].endswith("f.jpg"))
    by_uri = listing.list_folder(spark, f"file://{root}/only").collect()
    assert {r["rel_path"] for r in by_uri} == {f"d{k}/{n}" for k in range(24) for n in ("f.jpg", ".kept")}
    assert listing.list_folder(spark, str(tmp_path / "absent")).count() == 0


def test_a_running_job_is_stopped_by_its_tag(spark, tmp_path):
    import threading
    import time

    root = folder(tmp_path / "m", 8)
    store = cat.Catalog(spark, f"file://{tmp_path}/cat", cat.root_id(root))
    quick, calls, raised = extractor(root, engines(), date(2026, 9, 24)), [], []

    def slow(contents):
        time.sleep(60)
        return []

    def run(work):
        calls.append(1)
        return quick(work) if len(calls) == 1 else extractor(root, Engines(image=image, encode=slow), date(2026, 9, 24))(work)

    def job():
        try:
            index.run_index(spark, root, store, run, chunk_files=5)
        except Exception as e:
            raised.append(e)

    began, thread = time.time(), threading.Thread(target=job)
    thread.start()
    while thread.is_alive() and time.time() - began < 120:
        if len(calls) == 2:
            time.sleep(2)
            spark.sparkContext.cancelJobsWithTag(index.index_tag(store))
        thread.join(1)
    assert not thread.is_alive() and raised and len(index.Staged(store).chunks()) == 1
    counts = index.run_index(spark, root, store, quick)
    assert counts["resumed"] == 1 and store.read("files").where("status = 'pending'").count() == 0
