"""Registered queries on sources, sinks, upkeep of the catalogue and small functions, and their SQL."""

from __future__ import annotations

import io
import os
import zipfile
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as cat
from ..functions import dates, geo, geometry, text, vectors
from ..operators import browse, cdc, cluster, fts, listing_index, people, search
from ..schema import TABLES
from ..sources import documents, listing
from ..sources.pictures import save_pictures
from ..storage import shared_folder
from ..streaming import monitor
from .bindings import bound, bound_id, tables
from .catalog_queries import _CHANGES, _FREE, _SCORES, AUTO, EPS, HIT, SAMPLES, SUGGEST, VISIBLE, _known, query, rounded
from .extract import Engines, EngineSource, encoded, extractor
from .index import run_index, searchable


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def word_file(paragraphs: list[str], cells: list[str] = (), created: str = "2020-01-02T03:04:05Z") -> bytes:
    """A small Word file."""
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in paragraphs)
    if cells:
        body += "<w:tbl><w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in cells) + "</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
        z.writestr("docProps/core.xml", f"<x><dcterms:created>{created}</dcterms:created></x>")
    return out.getvalue()


def _word_files(rows: DataFrame) -> DataFrame:
    """rows: name, paragraphs, cells.  name, content."""
    import pandas as pd

    def make(batches):
        for batch in batches:
            yield pd.DataFrame({"name": batch["name"], "content": [word_file(list(p), list(c)) for p, c in zip(batch["paragraphs"], batch["cells"])]})

    return rows.mapInPandas(make, "name string, content binary")


def _media_rows(spark, sf) -> DataFrame:
    """name, content of a media file for each document: pictures, pdf and Word files, films, broken pictures and stickers."""
    i = F.col("doc_id")
    picture = F.format_string("picture,%d,800,2019:07:%02d 10:11:12", 1000 + 100 * (i % 50), i % 28 + 1)
    case = lambda jpg, pdf, other, bad, sticker: F.when(i % 5 == 0, jpg).when(i % 5 == 1, pdf).when(i % 5 == 3, other).when(i % 10 == 4, bad).otherwise(sticker)
    name = case(F.format_string("a/%d.jpg", i), F.format_string("b/%d.pdf", i), F.format_string("x/%d.mp4", i), F.format_string("bad/%d.jpg", i), F.format_string("STK-20230101-WA%d.webp", i))
    content = case(picture, F.format_string("first %d||third", i), F.lit("x"), F.lit("junk,1,1,"), F.lit("picture,10,10,"))
    d = _read(spark, sf, "documents").where("doc_id IS NOT NULL")
    words = d.where("doc_id % 5 = 2").select(F.format_string("c/%d.docx", i).alias("name"), F.array(i.cast("string")).alias("paragraphs"), F.array().cast("array<string>").alias("cells"))
    return d.where("doc_id % 5 <> 2").select(name.alias("name"), F.encode(content, "UTF-8").alias("content")).union(_word_files(words))


#: The names and kinds of the same files.
_MEDIA = """SELECT doc_id AS i, CASE WHEN doc_id % 5 = 0 THEN 'a/' || doc_id || '.jpg' WHEN doc_id % 5 = 1 THEN 'b/' || doc_id || '.pdf' WHEN doc_id % 5 = 2 THEN 'c/' || doc_id || '.docx'
  WHEN doc_id % 5 = 3 THEN 'x/' || doc_id || '.mp4' WHEN doc_id % 10 = 4 THEN 'bad/' || doc_id || '.jpg' ELSE 'STK-20230101-WA' || doc_id || '.webp' END AS rel_path,
  CASE WHEN doc_id % 5 = 0 THEN 'jpg' WHEN doc_id % 5 = 1 THEN 'pdf' WHEN doc_id % 5 = 2 THEN 'docx' WHEN doc_id % 5 = 3 THEN 'mp4' WHEN doc_id % 10 = 4 THEN 'bad' ELSE 'sticker' END AS k FROM documents WHERE doc_id IS NOT NULL"""


def _media(spark, sf) -> str:
    """The folder of these files in the shared folder: written by Spark, once for each state of the table."""
    root = f"{shared_folder(spark)}/media/{bound_id(spark, f'{sf}/documents.parquet')}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}.ready")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        save_pictures(_media_rows(spark, sf), root, "/nonexistent/root", marked=True)
        fs.create(path).close()
    return root


# --- sources ---------------------------------------------------------------------------------------------------------------
@query(f"""SELECT rel_path, CASE k WHEN 'jpg' THEN 36 WHEN 'pdf' THEN length('first ' || i || '||third') WHEN 'mp4' THEN 1 WHEN 'bad' THEN 9 WHEN 'sticker' THEN 14 END::BIGINT AS size FROM ({_MEDIA})""")
def folder_scan(spark, sf):
    """All files below a folder; what a zip archive takes is not compared."""
    return listing.list_folder(spark, _media(spark, sf)).select("rel_path", F.when(~F.endswith("rel_path", F.lit(".docx")), F.col("size")).alias("size"))


_ZIP = io.BytesIO()
with zipfile.ZipFile(_ZIP, "w") as _z:
    _z.writestr("a.txt", "a")
_HEADS = [("p%d", b"%PDF-1.4", "pdf"), ("j%d", b"\xff\xd8\xff\xe0", "image"), ("n%d", b"\x89PNGxxxx", "image"), ("b%d", b"BM", "image"), ("w%d", b"RIFF1234WEBPVP8 ", "image"), ("h%d", b"0000ftypheic", "image"),
          ("d%d", word_file(["x"]), "docx"), ("z%d", _ZIP.getvalue(), "other"), ("t%d", b"PK\x03\x04 torn", "other"), ("e%d", b"", "other"), ("x%d.pdf", b"no", "pdf"), ("y%d.JPG", b"", "image"), ("v%d.mp4", b"%PDF-", "other")]


@query("SELECT replace(name, '%d', doc_id::VARCHAR) AS rel_path, kind FROM documents JOIN (VALUES " + ", ".join(f"({k}, '{n}', '{kind}')" for k, (n, _, kind) in enumerate(_HEADS)) + f") AS t(k, name, kind) ON doc_id % {len(_HEADS)} = k")
def folder_kinds(spark, sf):
    """Kinds of files by name or first bytes: one file a document, with the first bytes of one of several formats."""
    k = F.col("doc_id") % len(_HEADS)
    pick = lambda values: F.array(*map(F.lit, values))[k.cast("int")]
    name = F.replace(pick([n for n, _, _ in _HEADS]), F.lit("%d"), F.col("doc_id").cast("string"))
    root = f"{shared_folder(spark)}/kinds-{os.urandom(6).hex()}"
    save_pictures(_read(spark, sf, "documents").where("doc_id IS NOT NULL").select(name.alias("name"), pick([bytearray(c) for _, c, _ in _HEADS]).alias("content")), root, "/nonexistent/root")
    return listing.list_folder(spark, root).select("rel_path", listing.listed_kind().alias("kind"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def content_hashes(spark, sf):
    return _read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", listing.content_hash(F.encode("text", "UTF-8")).alias("hash"))


@query("SELECT concat(doc_id, '.docx') AS rel_path, CASE WHEN doc_id % 50 <> 0 THEN concat('doc ', doc_id, chr(10), n_chars, ' | ', source) END AS content, CASE WHEN doc_id % 50 <> 0 THEN '2020-01-02T03:04:05' END AS created, CASE WHEN doc_id % 50 = 0 THEN 'BadZipFile' END AS error FROM documents")
def word_texts(spark, sf):
    d = _read(spark, sf, "documents").where("doc_id IS NOT NULL")
    name = F.format_string("%d.docx", "doc_id").alias("name")
    good = _word_files(d.where("doc_id % 50 <> 0").select(name, F.array(F.format_string("doc %d", "doc_id"), F.lit("  ")).alias("paragraphs"), F.array(F.col("n_chars").cast("string"), "source").alias("cells")))
    rows = good.union(d.where("doc_id % 50 = 0").select(name, F.lit(bytearray(b"junk")).alias("content")))
    found = documents.read_docx(rows.withColumnRenamed("name", "rel_path"))
    return found.select("rel_path", "content", dates.iso(F.col("created")).alias("created"), F.substring_index("error", ":", 1).alias("error"))


def _pages(spark, sf) -> DataFrame:
    """Pages of files, every third without a text layer; the file's content stands for its pages."""
    return bound(spark, sf, "texts").select(F.col("file_id").cast("string").alias("rel_path"), "page", F.when(F.col("page") % 3 != 0, F.col("content")).otherwise(" ").alias("content"))


@query("SELECT CAST(file_id AS STRING) AS rel_path, page FROM b_texts WHERE page % 3 = 0 OR trim(content) = ''", ("texts",))
def textless_pages(spark, sf):
    p = _pages(spark, sf)
    return documents.textless_pages(p, p)


@query("SELECT CAST(file_id AS STRING) AS rel_path, page, concat('page ', page) AS content FROM b_texts WHERE page % 3 = 0 OR trim(content) = ''", ("texts",))
def recognised_pages(spark, sf):
    p = _pages(spark, sf)
    return documents.recognised_pages(p.withColumn("content", F.encode("rel_path", "UTF-8")), p, lambda c, k: str(k).encode(), lambda c: [(f" page {c.decode()} ", 0.9), ("blur", 0.2), (" ", 0.9)])


@query("SELECT doc_id::STRING AS rel_path, (n_chars % 7)::INT AS page, doc_id % 5 BETWEEN 1 AND 4 AND n_chars % 7 BETWEEN 1 AND doc_id % 5 AS ok FROM documents WHERE doc_id IS NOT NULL")
def pages_to_render(spark, sf):
    d = _read(spark, sf, "documents").where("doc_id IS NOT NULL").withColumn("rel_path", F.col("doc_id").cast("string"))
    counts = d.select("rel_path", (F.col("doc_id") % 5).cast("int").alias("pages"))
    return documents.pages_to_render(d.select("rel_path", (F.col("n_chars") % 7).cast("int").alias("page")), counts).select("rel_path", "page", "ok")


_GAZETTEER = """SELECT c_name AS name, CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE concat('S', c_nationkey % 4) END AS state, CASE WHEN c_nationkey % 5 = 0 THEN concat('K', c_nationkey) ELSE n_name END AS country,
  c_acctbal AS lat, c_custkey::DOUBLE AS lon FROM customer JOIN nation ON n_nationkey = c_nationkey"""


def _gazetteer(spark, sf) -> DataFrame:
    code = F.concat(F.lit("K"), F.col("c_nationkey"))
    cities = _read(spark, sf, "customer").select(F.col("c_name").alias("name"), code.alias("country_code"), (F.col("c_nationkey") % 4).cast("string").alias("region_code"), F.col("c_acctbal").alias("lat"), F.col("c_custkey").cast("double").alias("lon"))
    n = _read(spark, sf, "nation")
    countries = n.where("n_nationkey % 5 <> 0").select(F.concat(F.lit("K"), F.col("n_nationkey")).alias("country_code"), F.col("n_name").alias("country"))
    region = (F.col("n_nationkey") % 4).cast("string")
    regions = n.where("n_nationkey % 3 <> 0").select(F.concat(F.lit("K"), F.col("n_nationkey")).alias("country_code"), region.alias("region_code"), F.concat(F.lit("S"), region).alias("state"))
    return listing.build_gazetteer(cities, countries, regions)


@query(_GAZETTEER)
def gazetteer_build(spark, sf):
    return _gazetteer(spark, sf)


@query(_GAZETTEER)
def gazetteer_round_trip(spark, sf):
    path = f"{shared_folder(spark)}/gazetteer-{os.urandom(6).hex()}"
    listing.write_gazetteer(_gazetteer(spark, sf), path)
    return listing.read_gazetteer(spark, path).select("name", "state", "country", "lat", "lon")


@query("SELECT n_name || '.onnx' AS file, CASE n_nationkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'differs' ELSE 'absent' END AS state FROM nation")
def model_manifest_check(spark, sf):
    n = _read(spark, sf, "nation")
    name = F.concat("n_name", F.lit(".onnx"))
    lines = n.select(F.concat(F.lit("| `"), name, F.lit("` | "), F.upper(F.sha2(F.encode("n_name", "UTF-8"), 256)), F.lit(" | MIT | web |")).alias("value"))
    lines = lines.union(_rows(spark, [("| file | hash | licence | origin |",), ("|---|---|---|---|",), ("text",)], "value string"))
    present = n.where("n_nationkey % 3 < 2").select(name.alias("file"), F.encode(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise("other"), "UTF-8").alias("content"))
    return listing.check_models(listing.model_manifest(lines), present)


# --- catalogue versions and sinks ------------------------------------------------------------------------------------------
@query("SELECT id, name, hidden, cover_face_id, 2 AS version FROM b_people UNION ALL SELECT NULL, 'v1', NULL, NULL, 1", ("people",))
def catalogue_versions(spark, sf):
    """A table published once, read through a later version that changed another table only."""
    c = cat.Catalog(spark, f"{shared_folder(spark)}/catalogue-{os.urandom(6).hex()}", cat.root_id(sf))
    first = c.publish({"meta": _rows(spark, [("a", "v1")], "key string, value string")})
    c.publish({"people": bound(spark, sf, "people")})
    later = c.publish({"meta": _rows(spark, [("a", "v3")], "key string, value string")})
    meta = c.read("meta", first).select(F.lit(None).cast("long").alias("id"), F.col("value").alias("name"), F.lit(None).cast("boolean").alias("hidden"), F.lit(None).cast("long").alias("cover_face_id"), F.lit(first).alias("version"))
    return c.read("people", later).select("id", "name", "hidden", "cover_face_id", F.lit(later - 1).alias("version")).union(meta)


_ROOTS = "SELECT md5(o_orderkey::STRING) AS h, o_orderkey AS k FROM orders"


@query(f"SELECT substr(h, 1, 16) AS root_id FROM ({_ROOTS}) ORDER BY (k * 7919) % 1000003 DESC, 1 LIMIT 1")
def latest_catalogue(spark, sf):
    return cat.latest_root(_roots(spark, sf))


def _roots(spark, sf) -> DataFrame:
    o = _read(spark, sf, "orders").select(F.substring(F.md5(F.encode(F.col("o_orderkey").cast("string"), "UTF-8")), 1, 16).alias("root_id"), ((F.col("o_orderkey") * 7919) % 1000003).alias("last_used"))
    return o.union(_rows(spark, [("not-an-id", 9999999)], "root_id string, last_used long"))


@query(f"SELECT substr(h, 1, 16) AS root_id, (k * 7919) % 1000003 AS last_used FROM ({_ROOTS}) ORDER BY 2 DESC, 1 LIMIT 40")
def recent_catalogues(spark, sf):
    return cat.recent_roots(_roots(spark, sf)).limit(40)


@query(f"SELECT printf('%6d  %-10s  %s', id, coalesce(substr(taken_at, 1, 10), ''), rel_path) AS value FROM b_files WHERE {VISIBLE}", ("files",))
def text_lines(spark, sf):
    return search.lines(search.listing(tables(spark, sf), search.Query()))


_PLACE = "nullif(array_to_string(list_filter([city, state, country], lambda x: x <> ''), ', '), '')"


@query(
    f"SELECT to_json({{'id': id, 'rel_path': rel_path, 'kind': kind, 'taken_at': taken_at, 'score': 1.0::DOUBLE, 'page': NULL, 'snippet': NULL, 'place': {_PLACE}}})::VARCHAR AS value FROM b_files WHERE {VISIBLE}",
    ("files",),
)
def json_lines(spark, sf):
    return search.json_rows(search.listing(tables(spark, sf), search.Query()))


@query("SELECT concat(doc_id, '.bin') AS name, strlen(coalesce(text, ''))::BIGINT AS size FROM documents")
def saved_content(spark, sf):
    """Contents written as files that appear when the whole write is committed, and listed again."""
    d = _read(spark, sf, "documents").where("doc_id IS NOT NULL")
    root = f"{shared_folder(spark)}/saved-{os.urandom(6).hex()}"
    save_pictures(d.select(F.format_string("%d.bin", "doc_id").alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")), root, "/nonexistent/root")
    return listing.list_folder(spark, root, head=False).select(F.col("rel_path").alias("name"), "size")


# --- parameters and predicates -----------------------------------------------------------------------------------------
@query(
    """SELECT o_orderkey AS k, least(greatest(o_orderkey % 1300 - 400, 1), 500)::INT AS lim, greatest(o_orderkey % 40 - 20, 0)::INT AS off,
      CASE o_orderkey % 3 WHEN 1 THEN 'date' ELSE 'relevance' END AS ordering, CASE o_orderkey % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'pdf,docx' ELSE '' END AS kinds FROM orders"""
)
def query_clamps(spark, sf):
    """Parameters of a query a row, as a log of searches holds them, brought into their ranges."""
    k = F.col("o_orderkey")
    given = _read(spark, sf, "orders").select(
        k.alias("k"), (k % 1300 - 400).alias("lim"), (k % 40 - 20).alias("off"), F.when(k % 3 == 0, "relevance").when(k % 3 == 1, "date").otherwise("size").alias("ordering"),
        F.when(k % 4 == 0, F.array(F.lit("image"), F.lit("exe"))).when(k % 4 == 1, F.array(F.lit("pdf"), F.lit("docx"))).otherwise(F.array(F.lit("other"))).alias("kinds"),
    )
    c = search.clamps(F.col("lim"), F.col("off"), F.col("ordering"), F.col("kinds"))
    return given.select("k", c["limit"].cast("int").alias("lim"), c["offset"].cast("int").alias("off"), c["order"].alias("ordering"), F.array_join(c["kinds"], ",").alias("kinds"))


_THREE = "SELECT event_id, (event_id % 75 + 28) / 100.0::DOUBLE AS a, (event_id % 83 + 18) / 100.0::DOUBLE AS s, (event_id % 70 + 3) / 100.0::DOUBLE AS e, (event_id % 52)::INT AS m FROM events"


def _thresholds(spark, sf) -> DataFrame:
    i = F.col("event_id")
    part = lambda n, low: (i % n + low) / F.lit(100.0)
    return _read(spark, sf, "events").select("event_id", part(75, 28).alias("a"), part(83, 18).alias("s"), part(70, 3).alias("e"), (i % 52).cast("int").alias("m"))


@query(f"SELECT event_id, a BETWEEN 0.3 AND 0.99 AND s BETWEEN 0.2 AND 0.99 AND e BETWEEN 0.05 AND 0.7 AND m BETWEEN 2 AND 50 AND s <= a AS ok FROM ({_THREE})")
def settings_checked(spark, sf):
    return _thresholds(spark, sf).select("event_id", people.settings_valid(F.col("a"), F.col("s"), F.col("e"), F.col("m")).alias("ok"))


#: A meta table: a row an order, and what a folder's settings may be.
_META = """SELECT concat('note ', o_orderkey) AS key, o_orderstatus AS value FROM orders UNION ALL SELECT k, v FROM (VALUES ('monitor', '0'), ('faces_eps', '0.1'), ('faces_t_auto', '0.8')) AS t(k, v)"""


def _meta(spark, sf) -> DataFrame:
    own = _read(spark, sf, "orders").select(F.concat(F.lit("note "), "o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"))
    return own.union(_rows(spark, [("monitor", "0"), ("faces_eps", "0.1"), ("faces_t_auto", "0.8")], "key string, value string"))


@query(f"""WITH m AS ({_META}), s AS (SELECT * FROM m WHERE key NOT LIKE 'faces%' UNION ALL VALUES ('faces_t_auto', '0.75'), ('faces_t_suggest', '0.25'), ('faces_eps', '0.3'))
  SELECT 'saved' AS what, key, value FROM s UNION ALL SELECT 'reset', key, value FROM s WHERE key NOT LIKE 'faces%' UNION ALL VALUES ('loaded', 'auto', '0.75')""")
def settings_saved(spark, sf):
    saved = people.save_settings(_meta(spark, sf), people.Settings(0.75, 0.25))
    own = _rows(spark, [("loaded", "auto", str(people.load_settings(saved).auto))], "what string, key string, value string")
    return saved.select(F.lit("saved").alias("what"), "key", "value").union(own).union(people.reset_settings(saved).select(F.lit("reset").alias("what"), "key", "value"))


@query("SELECT event_id, array_to_string(list_sort(list_filter(list_distinct([['clip', 'x', 'ocr', 'faces', 'all'][event_id % 5 + 1], ['faces', 'y', 'clip'][event_id % 3 + 1]]), lambda x: x NOT IN ('clip', 'ocr', 'faces'))), ',') AS unknown FROM events")
def unknown_stages(spark, sf):
    i = F.col("event_id").cast("int")
    names = lambda *x: F.array(*map(F.lit, x))
    given = F.array(names("clip", "x", "ocr", "faces", "all")[i % 5], names("faces", "y", "clip")[i % 3])
    return _read(spark, sf, "events").select("event_id", F.array_join(cdc.unknown(given), ",").alias("unknown"))


_BOX = "vec_id % 60 AS x, vec_id % 45 AS y, 5 + vec_id % 70 AS w, 6 + vec_id % 64 AS h"


def _boxes(spark, sf) -> DataFrame:
    v = F.col("vec_id")
    box = F.struct(*[x.cast("int").alias(n) for n, x in (("x", v % 60), ("y", v % 45), ("w", 5 + v % 70), ("h", 6 + v % 64))])
    return _read(spark, sf, "embeddings").select(v.alias("id"), (v % 40).alias("file_id"), box.alias("bbox"), (v % 100 / 100).alias("det_score"), "embedding")


@query(f"SELECT id FROM (SELECT vec_id AS id, vec_id % 100 / 100.0 AS s, {_BOX} FROM embeddings) WHERE s >= 0.8 AND least(w, h) >= 40")
def detections(spark, sf):
    return people.detections(_boxes(spark, sf)).select("id")


@query(f"SELECT id, w >= 8 AND h >= 8 AND x + w <= 100 AND y + h <= 90 AS ok FROM (SELECT vec_id AS id, {_BOX} FROM embeddings)")
def boxes_valid(spark, sf):
    return _boxes(spark, sf).select("id", people.valid_box(F.col("bbox"), F.lit(100), F.lit(90)).alias("ok"))


@query(f"""SELECT file_id, arg_min(id, {{'d': (x + w / 2 - 50) * (x + w / 2 - 50) + (y + h / 2 - 40) * (y + h / 2 - 40), 'i': id}}) AS id FROM (SELECT vec_id AS id, vec_id % 40 AS file_id, {_BOX} FROM embeddings) GROUP BY file_id""")
def closest_detections(spark, sf):
    drawn = F.struct(*[F.lit(v).alias(n) for n, v in zip("xywh", (40, 30, 20, 20))])
    return people.closest_detection(_boxes(spark, sf), drawn).select("file_id", "id")


@query("SELECT vec_id AS id, vec_id % 9 <> 0 AS signature FROM embeddings")
def blank_signatures(spark, sf):
    e = _read(spark, sf, "embeddings")
    blank = F.when(F.col("vec_id") % 9 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    return e.select(F.col("vec_id").alias("id"), vectors.has_signature(blank).alias("signature"))


@query("SELECT p.id, p.name FROM b_people p WHERE NOT hidden AND contains(lower(coalesce(name, concat('person #', id))), 'an') AND id IN (SELECT person_id FROM b_faces)", ("people", "faces"))
def people_filtered(spark, sf):
    return browse.filter_people(browse.people_overview(bound(spark, sf, "people"), bound(spark, sf, "faces")), "AN").select("id", "name")


_FACES_OF = "SELECT f.id, f.person_id, p.name, f.assign_source AS source, f.assign_score AS score, manual, true AS signature FROM b_faces f LEFT JOIN b_people p ON p.id = f.person_id WHERE f.file_id = 42"


def _faces_of(spark, sf) -> DataFrame:
    boxed = bound(spark, sf, "faces").withColumn("bbox", F.struct(F.lit(0).alias("x")))
    return browse.faces_of_file(boxed, bound(spark, sf, "people"), 42).drop("bbox")


@query(_FACES_OF, ("people", "faces"))
def faces_of_file(spark, sf):
    return _faces_of(spark, sf)


@query(f"SELECT * FROM ({_FACES_OF}) WHERE source = 'auto'", ("people", "faces"))
def faces_of_file_automatic(spark, sf):
    return browse.ai_only(_faces_of(spark, sf))


@query("SELECT id, rel_path FROM b_files WHERE id = 14 AND status <> 'missing'", ("files",))
def live_file(spark, sf):
    return search.live_file(bound(spark, sf, "files"), 14).select("id", "rel_path")


@query(f"SELECT id, lag(id) OVER (ORDER BY taken_at DESC NULLS LAST, id DESC) AS previous, lead(id) OVER (ORDER BY taken_at DESC NULLS LAST, id DESC) AS next FROM (SELECT * FROM b_files WHERE {VISIBLE} ORDER BY taken_at DESC NULLS LAST, id DESC LIMIT 100)", ("files",))
def neighbour_items(spark, sf):
    page = search.search(tables(spark, sf), search.Query(limit=100)).hits
    return search.neighbours(page, [F.desc_nulls_last("taken_at"), F.desc("id")])


@query(f"SELECT {HIT} FROM b_files WHERE {VISIBLE} ORDER BY taken_at DESC NULLS LAST, id DESC LIMIT 60", ("files",))
def scrolled_pages(spark, sf):
    pages = [search.search(tables(spark, sf), search.Query(offset=k)).hits.select("id", "rel_path", "kind", "taken_at") for k in (0, 20, 40)]
    return pages[0].union(pages[1]).union(pages[2])


@query("SELECT count(*) AS pages, count(DISTINCT file_id) AS files FROM b_texts WHERE page >= 1", ("texts",))
def text_pages(spark, sf):
    return browse.text_pages(bound(spark, sf, "texts"))


@query("SELECT id FROM b_files WHERE substr(taken_at, 1, 10) = '2019-04-11'", ("files",))
def files_on_day(spark, sf):
    return browse.files_on_day(bound(spark, sf, "files"), "2019-04-11").select("id")


# --- text of files -------------------------------------------------------------------------------------------------------
@query("SELECT t.file_id, count(*) AS n FROM b_texts t JOIN b_files f ON f.id = t.file_id WHERE f.status <> 'pending' AND f.kind <> 'other' GROUP BY 1", ("texts", "files"))
def texts_without_stale(spark, sf):
    return fts.without_stale(bound(spark, sf, "texts"), bound(spark, sf, "files")).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id AS file_id, 0 AS page, {_PLACE} AS content FROM b_files WHERE {_PLACE} IS NOT NULL", ("files",))
def place_texts(spark, sf):
    return fts.place_texts(bound(spark, sf, "files"))


@query("SELECT file_id, left(string_agg(content, chr(10) || chr(10) ORDER BY page), 5000) AS content FROM b_texts GROUP BY file_id", ("texts",))
def document_views(spark, sf):
    return text.docx_view(bound(spark, sf, "texts"), 5000)


@query("SELECT file_id, count(*) + 1 AS n, sum(page) + 900 AS pages FROM b_texts GROUP BY file_id", ("texts",))
def save_texts(spark, sf):
    """Recognised pages come beside the text layer that is there."""
    t = bound(spark, sf, "texts")
    new = t.select("file_id").distinct().select("file_id", F.lit(900).alias("page"), F.lit("seen").alias("content"))
    return cdc.save_texts(t, new).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.sum("page").alias("pages"))


# --- small functions -----------------------------------------------------------------------------------------------------
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(f"SELECT id, translate(name, '{_UPPER}', '{_LOWER}') AS nocase, nullif(trim(CASE WHEN id % 3 = 0 THEN '  ' ELSE concat(' ', name, ' ') END), '') AS name FROM b_people WHERE name IS NOT NULL", ("people",))
def person_names(spark, sf):
    p = bound(spark, sf, "people").where("name IS NOT NULL")
    padded = F.when(F.col("id") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "name", F.lit(" ")))
    return p.select("id", text.nocase(F.col("name")).alias("nocase"), text.person_name(padded).alias("name"))


@query(r"SELECT doc_id, trim(regexp_replace(t, '[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ') AS line, left(t, 500) AS error FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN concat('  ', text, chr(9), ' ', chr(160)) WHEN 2 THEN replace(text, ' ', chr(11) || chr(12)) ELSE concat(chr(10), text, chr(12288), chr(13)) END AS t FROM documents)")
def collapsed_texts(spark, sf):
    """Whole texts, some with white space of all kinds at their ends and inside."""
    k, t = F.col("doc_id") % 4, F.col("text")
    made = F.when(k == 0, t).when(k == 1, F.concat(F.lit("  "), t, F.lit("\t \xa0"))).when(k == 2, F.replace(t, F.lit(" "), F.lit("\x0b\x0c"))).otherwise(F.concat(F.lit("\n"), t, F.lit("\u3000\r")))
    return _read(spark, sf, "documents").select("doc_id", text.collapse(made).alias("line"), text.error_text(made).alias("error"))


@query(f"SELECT id, concat_ws(',', x, y, w, h) AS box, w AS width, (x + y)::INT AS corner FROM (SELECT vec_id AS id, {_BOX} FROM embeddings)")
def boxes_as_text(spark, sf):
    b = _boxes(spark, sf).select("id", text.bbox_format(F.col("bbox")).alias("box"))
    parsed = text.bbox_parse(F.col("box"))
    return b.select("id", "box", parsed["w"].cast("long").alias("width"), (parsed["x"] + parsed["y"]).alias("corner"))


@query(
    """, g AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN concat('#', c_custkey % 3000) WHEN 1 THEN concat(c_custkey % 3000) WHEN 2 THEN concat(' customer ', c_custkey - 1 + 30, ' ') WHEN 3 THEN '  ' ELSE concat('NEW ', c_custkey % 7) END AS given, c_custkey % 5 AS w FROM customer),
    n AS (SELECT name, lower(name) AS l, min(id) AS id FROM b_people GROUP BY ALL)
    SELECT k, CASE WHEN w <= 1 THEN (SELECT min(id) FROM b_people p WHERE p.id = k % 3000) WHEN w = 2 THEN (SELECT min(id) FROM n WHERE l = lower(trim(given))) END AS id, w = 4 OR (w = 2 AND NOT EXISTS (SELECT 1 FROM n WHERE l = lower(trim(given)))) AS made FROM g""",
    ("people",),
)
def person_references(spark, sf):
    """What a user has typed for a person, a row each: ``#12`` or ``12`` that exists, a name that somebody has, or a new name."""
    k = F.col("c_custkey")
    typed = F.when(k % 5 == 0, F.concat(F.lit("#"), k % 3000)).when(k % 5 == 1, (k % 3000).cast("string")).when(k % 5 == 2, F.concat(F.lit(" customer "), k + 29, F.lit(" "))).when(k % 5 == 3, "  ").otherwise(F.concat(F.lit("NEW "), k % 7))
    p = bound(spark, sf, "people")
    found = people.resolve_references(p, _read(spark, sf, "customer").select(k.alias("k"), typed.alias("given")))
    return found.select("k", "id", "made")


@query(
    """SELECT id, concat(substr(taken_at, 9, 2), '/', substr(taken_at, 6, 2), '/', substr(taken_at, 1, 4), CASE WHEN length(taken_at) > 10 THEN concat(' ', substr(taken_at, 12, 5)) ELSE '' END) AS shown,
      concat(substr(taken_at, 1, 7), '-01') AS date_from, strftime(last_day(CAST(substr(taken_at, 1, 10) AS DATE)), '%Y-%m-%d') AS date_to FROM b_files WHERE taken_at IS NOT NULL""",
    ("files",),
)
def display_dates(spark, sf):
    f = bound(spark, sf, "files").where("taken_at IS NOT NULL")
    return f.select("id", dates.display_date(F.col("taken_at")).alias("shown"), dates.month_bounds(text.month_key(F.col("taken_at"))).alias("b")).select("id", "shown", "b.*")


@query("SELECT event_id, CASE WHEN event_id % 5 < 3 THEN strftime(make_timestamp(event_id * 1000000000), '%Y-%m-%dT%H:%M:%S') END AS stamp FROM events")
def modification_times(spark, sf):
    """Times that no date has are null."""
    t = F.when(F.col("event_id") % 5 == 3, F.lit(1e15)).when(F.col("event_id") % 5 == 4, F.lit(float("inf"))).otherwise(F.col("event_id") * 1000.0 + 0.5)
    return _read(spark, sf, "events").select("event_id", dates.iso(dates.mtime_stamp(t)).alias("stamp"))


@query("SELECT vec_id, round(list_aggregate(list_transform(embedding::DOUBLE[], lambda x: (3 * x) / sqrt(9 * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 'sum'), 6) AS total FROM embeddings")
def normalised_vectors(spark, sf):
    unit = vectors.normalise(F.transform("embedding", lambda x: x.cast("double") * 3))
    return rounded(_read(spark, sf, "embeddings").select("vec_id", F.aggregate(unit, F.lit(0.0), lambda a, x: a + x).alias("total")), "total")


@query("SELECT vec_id, len(embedding)::INT AS n, round(list_sum(embedding::DOUBLE[]), 6) AS total, (4 * len(embedding))::INT AS bytes FROM embeddings")
def vector_blobs(spark, sf):
    e = _read(spark, sf, "embeddings").select("vec_id", geometry.to_blob(F.col("embedding")).alias("blob"))
    back = e.withColumn("v", geometry.from_blob(F.col("blob")))
    return rounded(back.select("vec_id", F.size("v").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"), F.length("blob").alias("bytes")), "total")


@query(
    """SELECT event_id, concat_ws('; ', CASE WHEN event_id % 4 > 0 THEN concat('Camera=', CASE event_id % 4 WHEN 1 THEN 'Acme' WHEN 2 THEN 'X100' ELSE 'Acme X100' END) END,
      CASE event_id % 3 WHEN 0 THEN printf('Exposure=1/%d s', event_id % 200 + 2) WHEN 1 THEN 'Exposure=2.5 s' END, CASE WHEN event_id % 5 > 0 THEN printf('Aperture=f/%.1f', (event_id % 5 * 1.4)::DOUBLE) END,
      CASE WHEN event_id % 6 > 0 THEN printf('ISO=%d', event_id % 6 * 100) END, CASE WHEN event_id % 7 > 0 THEN printf('Focal length=%.1f mm', (event_id % 7 * 10.5)::DOUBLE) || CASE WHEN event_id % 2 = 0 THEN printf(' (%d mm equiv.)', event_id % 7 * 15) ELSE '' END END,
      CASE event_id % 3 WHEN 0 THEN 'Flash=not fired' WHEN 1 THEN 'Flash=fired' END, CASE WHEN event_id % 8 = 0 THEN 'Software=Edit 2' END) AS described FROM events"""
)
def exif_descriptions(spark, sf):
    k = lambda m: F.col("event_id") % m
    some = lambda cond, value: F.when(cond, value).cast("string")
    e = F.struct(
        some(k(4).isin(1, 3), F.lit("Acme\x00")).alias("make"), some(k(4) >= 2, F.lit(" X100 ")).alias("model"), F.lit("").alias("lens"),
        F.when(k(3) == 0, (1.0 / (k(200) + 2)).cast("string")).when(k(3) == 1, F.lit("2.5")).otherwise("nan").alias("exposure"), (k(5) * 1.4).cast("string").alias("aperture"),
        (k(6) * 100).cast("string").alias("iso"), (k(7) * 10.5).cast("string").alias("focal"), some(k(2) == 0, (k(7) * 15).cast("string")).alias("focal35"),
        F.when(k(3) < 2, k(3) + 16).cast("int").alias("flash"), some(k(8) == 0, F.lit("Edit 2")).alias("software"),
    )
    pairs = F.transform(vectors.exif_description(e), lambda p: F.concat(p["label"], F.lit("="), p["value"]))
    return _read(spark, sf, "events").select("event_id", F.array_join(pairs, "; ").alias("described"))


@query("SELECT event_id, CASE WHEN event_id * 977 > 1048576 THEN printf('%.1f MB', event_id * 977 / 1048576.0::DOUBLE) ELSE printf('%d KB', floor(event_id * 977 / 1024.0::DOUBLE + 0.5)::BIGINT) END AS size, CASE WHEN event_id % 500 < 60 THEN printf('%d s', event_id % 500) ELSE printf('%d min', event_id % 500 // 60) END AS elapsed FROM events")
def sizes_and_times(spark, sf):
    return _read(spark, sf, "events").select("event_id", text.file_size(F.col("event_id") * 977).alias("size"), text.elapsed(F.col("event_id") % 500).alias("elapsed"))


_PICTURE = "SELECT event_id, (event_id * 37 % 5000 + 1)::INT AS w, (event_id * 53 % 4000 + 1)::INT AS h FROM events"


def _pictures(spark, sf) -> DataFrame:
    i = F.col("event_id")
    return _read(spark, sf, "events").select("event_id", (i * 37 % 5000 + 1).cast("int").alias("w"), (i * 53 % 4000 + 1).cast("int").alias("h"))


def _fit_sql(side: int, name: str) -> str:
    part = lambda x: f"CASE WHEN greatest(w, h) <= {side} THEN {x} ELSE greatest(round({x} * {side}.0::DOUBLE / greatest(w, h)), 1) END::INT"
    return f"{part('w')} AS {name}_w, {part('h')} AS {name}_h"


@query(f"SELECT event_id, {_fit_sql(256, 'thumb')}, {_fit_sql(2560, 'view')}, round(CASE WHEN greatest(w, h) <= 1600 THEN 1.0::DOUBLE ELSE greatest(w, h) / 1600.0::DOUBLE END, 6) AS scale, CASE WHEN event_id % 8 >= 5 THEN h ELSE w END AS turned FROM ({_PICTURE})")
def picture_sizes(spark, sf):
    w, h = F.col("w"), F.col("h")
    p = _pictures(spark, sf).select("event_id", geometry.scaled(w, h, geometry.THUMB).alias("t"), geometry.scaled(w, h, geometry.PREVIEW).alias("v"), geometry.working_scale(w, h).alias("scale"), geometry.oriented(w, h, F.col("event_id") % 8)["w"].alias("turned"))
    return rounded(p.select("event_id", F.col("t.w").alias("thumb_w"), F.col("t.h").alias("thumb_h"), F.col("v.w").alias("view_w"), F.col("v.h").alias("view_h"), "scale", "turned"), "scale")


@query(
    f"""SELECT event_id, cw, ch, round_even((cw - 224) / 2.0::DOUBLE, 0)::INT AS cleft, round_even((ch - 224) / 2.0::DOUBLE, 0)::INT AS ctop
    FROM (SELECT event_id, CASE WHEN w > h THEN 224 * w // h ELSE 224 END::INT AS cw, CASE WHEN w > h THEN 224 ELSE 224 * h // w END::INT AS ch FROM ({_PICTURE}))"""
)
def encoder_crops(spark, sf):
    p = _pictures(spark, sf).select("event_id", geometry.encoder_crop(F.col("w"), F.col("h")).alias("c"))
    return p.select("event_id", F.col("c.w").alias("cw"), F.col("c.h").alias("ch"), F.col("c.left").alias("cleft"), F.col("c.top").alias("ctop"))


@query(
    f"""SELECT id, greatest(x - m, 0)::INT AS x0, greatest(y - m, 0)::INT AS y0, least(100, x + w + m)::INT AS x1, least(90, y + h + m)::INT AS y1, round(200.0::DOUBLE / greatest(w, h), 6) AS zoom
    FROM (SELECT *, greatest(w, h) // 2 AS m FROM (SELECT vec_id AS id, {_BOX} FROM embeddings)) WHERE least(100, x + w + m) - greatest(x - m, 0) >= 8 AND least(90, y + h + m) - greatest(y - m, 0) >= 8"""
)
def search_regions(spark, sf):
    r = _boxes(spark, sf).select("id", geometry.search_region(F.col("bbox"), F.lit(100), F.lit(90)).alias("r")).where("r IS NOT NULL")
    return rounded(r.select("id", *[F.col(f"r.region.{c}").cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")], "r.zoom"), "zoom")


@query(f"SELECT id, printf('%d,%d,%d,%d', greatest(x - m, 0), greatest(y - m, 0), least(100, x + w + m), least(90, y + h + m)) AS cut FROM (SELECT *, floor(greatest(w, h) / 3.0::DOUBLE)::BIGINT AS m FROM (SELECT vec_id AS id, {_BOX} FROM embeddings))")
def face_crops(spark, sf):
    pictures = _rows(spark, [(k, bytearray(b"x"), 100, 90) for k in range(40)], "file_id long, content binary, width int, height int")
    cut = documents.face_crops(_boxes(spark, sf), pictures, lambda c, b: ",".join(str(b[n]) for n in ("x0", "y0", "x1", "y1")).encode())
    return cut.select("id", F.decode("content", "UTF-8").alias("cut"))


@query("SELECT id, lat IS NOT NULL AND city IS NULL AS unresolved FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN 1.0 END AS lat, CASE c_custkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN '' END AS city FROM customer)")
def unresolved_positions(spark, sf):
    f = _located(spark, sf)
    todo = cdc.unresolved(f).select("id", F.lit(True).alias("todo"))
    return f.join(todo, "id", "left").select("id", F.coalesce("todo", F.lit(False)).alias("unresolved"))


def _located(spark, sf) -> DataFrame:
    p = bound(spark, sf, "points")
    city = F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, "")
    return p.select("id", F.when(F.col("id") % 3 > 0, F.col("lat")).alias("lat"), F.when(F.col("id") % 3 > 0, F.col("lon")).alias("lon"), city.alias("city"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("country"))


@query(
    """, f AS (SELECT id, lat, lon, id % 3 > 0 AS there, CASE id % 4 WHEN 0 THEN 'a' WHEN 1 THEN '' END AS city FROM b_points),
    d AS (SELECT p.id, q.place_id, q.name, cos(radians(p.lat)) * cos(radians(q.lat)) * cos(radians(p.lon) - radians(q.lon)) + sin(radians(p.lat)) * sin(radians(q.lat)) AS dot FROM f p CROSS JOIN b_places q),
    best AS (SELECT id, arg_max(name, {'d': round(dot, 12), 'k': -place_id}) AS name FROM d WHERE dot >= cos(60.0 / 6371.0) GROUP BY id)
    SELECT f.id, CASE WHEN f.there AND f.city IS NULL THEN coalesce(best.name, '') ELSE f.city END AS city FROM f LEFT JOIN best ON best.id = f.id""",
    ("points", "places"),
)
def resolve_places(spark, sf):
    return cdc.resolve_places(_located(spark, sf), bound(spark, sf, "places")).select("id", "city")


# --- scans, results, corrections ----------------------------------------------------------------------------------------
@query(_CHANGES + "SELECT change, count(*) AS n FROM c GROUP BY change", ("known", "seen"))
def scan_stats(spark, sf):
    return cdc.scan_stats(cdc.changes(_known(spark, sf), bound(spark, sf, "seen")))


_AFTER = (
    _CHANGES
    + """, s AS (SELECT rel_path, kind, CASE WHEN change IN ('new', 'changed') THEN CASE kind WHEN 'other' THEN 'done' ELSE 'pending' END WHEN change IN ('gone', 'missing') THEN 'missing'
      WHEN change = 'reappeared' THEN CASE WHEN error IS NOT NULL THEN 'error' WHEN stages_text <> '' OR kind = 'other' THEN 'done' ELSE 'pending' END ELSE old END AS status,
      CASE WHEN change NOT IN ('new', 'changed') THEN error END AS error, CASE WHEN change NOT IN ('new', 'changed') THEN stages_text END AS stages FROM c WHERE change <> 'purged')
"""
)


def _again(when: str, forget: str) -> str:
    return f"SELECT rel_path, CASE WHEN {when} THEN 'pending' ELSE status END AS status, CASE WHEN NOT ({when}) THEN error END AS error, CASE WHEN NOT ({when}) THEN nullif(stages, '') END AS stages, {forget} AS forget_place FROM s"


def _scanned(spark, sf, **flags) -> DataFrame:
    out = cdc.apply_scan(_known(spark, sf), bound(spark, sf, "seen"), **flags)
    return out.select("rel_path", "status", "error", F.nullif(text.stages_text(F.col("stages_done")), F.lit("")).alias("stages"), "forget_place")


_FORCED = "status IN ('done', 'error') AND kind <> 'other'"


@query(_AFTER + _again(_FORCED, _FORCED), ("known", "seen"))
def scan_forced(spark, sf):
    return _scanned(spark, sf, force=True)


@query(_AFTER + _again("status = 'error'", "false"), ("known", "seen"))
def scan_retried(spark, sf):
    return _scanned(spark, sf, retry_errors=True)


@query(_AFTER + _again("status = 'error' OR (status = 'done' AND kind <> 'other')", "status = 'done' AND kind <> 'other'"), ("known", "seen"))
def scan_forced_and_retried(spark, sf):
    return _scanned(spark, sf, force=True, retry_errors=True)


@query(
    """SELECT id, CASE WHEN id % 3 = 0 THEN 'error' WHEN id % 3 = 1 THEN 'done' ELSE status END AS status, CASE WHEN id % 3 = 0 THEN 'bad' WHEN id % 3 = 1 THEN NULL ELSE error END AS error,
      CASE WHEN id % 3 = 1 AND id % 2 = 0 THEN NULL ELSE taken_at END AS taken_at, CASE WHEN id % 3 = 1 AND id % 2 = 1 THEN NULL ELSE city END AS city, CASE WHEN id % 3 = 1 AND id % 2 = 1 THEN CASE WHEN id % 5 > 0 THEN 1.5 END ELSE 9.0 END::DOUBLE AS lat FROM b_files""",
    ("files",),
)
def save_results(spark, sf):
    """Every third file failed; of the others each second one ran ``date`` and found none, and the others ``gps``."""
    f = bound(spark, sf, "files").withColumns({"stages_done": text.stages_array(F.col("stages_text")), "lat": F.lit(9.0)})
    r = f.where("id % 3 < 2").select(
        "rel_path", F.when(F.col("id") % 3 == 0, "bad").alias("error"), F.when(F.col("id") % 2 == 0, F.array(F.lit("date"))).otherwise(F.array(F.lit("gps"))).alias("ran"),
        F.lit(None).cast("string").alias("r_taken_at"), F.when(F.col("id") % 5 > 0, 1.5).alias("r_lat"),
    )
    return cdc.save_results(f, r).select("id", "status", "error", "taken_at", "city", "lat")


@query("""SELECT id, array_to_string(list_filter(['faces', 'clip', 'ocr'], lambda s: list_contains(string_split(stages_text, ','), s)), ',') AS heavy FROM b_files""", ("files",))
def heavy_stages(spark, sf):
    f = bound(spark, sf, "files")
    return f.select("id", text.stages_text(cdc.heavy_due(text.stages_array(F.col("stages_text")))).alias("heavy"))


@query("SELECT id, CASE WHEN id = 4 THEN 'Anna' ELSE name END AS name, CASE WHEN id = 4 THEN true ELSE hidden END AS hidden FROM b_people", ("people",))
def rename_person(spark, sf):
    return people.rename_person(bound(spark, sf, "people"), 4, " Anna ", True).select("id", "name", "hidden")


@query("SELECT max(id) + 1 AS id, 7 AS file_id, 'user' AS assign_source, true AS manual, 0.0::DOUBLE AS det_score FROM b_faces", ("faces",))
def manual_faces(spark, sf):
    """One drawn face that stays and one that is deleted again; others can not be."""
    f = bound(spark, sf, "faces").withColumn("bbox", F.lit(None).cast("struct<x: int, y: int, w: int, h: int>")).select(*TABLES["faces"].names)
    one = people.add_manual_face(f, {"file_id": 7, "bbox": (0, 0, 9, 9), "person_id": 1})
    two = people.add_manual_face(one, {"file_id": 8, "bbox": (0, 0, 9, 9), "person_id": 1})
    top = two.agg(F.max("id")).first()[0]
    left = people.delete_manual_face(people.delete_manual_face(two, top), 5)
    return left.where("manual OR id = -1").select("id", F.col("file_id").cast("int").alias("file_id"), "assign_source", "manual", "det_score")


@query(f"""SELECT key, value FROM ({_META}) WHERE key NOT IN (SELECT concat('note ', o_orderkey) FROM orders WHERE o_orderkey % 3 = 0)
  UNION ALL SELECT concat('note ', o_orderkey), 'new' FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT concat('fresh ', o_orderkey), 'new' FROM orders WHERE o_orderkey % 5 = 0""")
def settings_upsert(spark, sf):
    """Rows with known keys replaced, others added."""
    o = _read(spark, sf, "orders")
    row = lambda df, what: df.select(F.concat(F.lit(what), "o_orderkey").alias("key"), F.lit("new").alias("value"))
    return cat.upsert(_meta(spark, sf), row(o.where("o_orderkey % 3 = 0"), "note ").union(row(o.where("o_orderkey % 5 = 0"), "fresh ")), ["key"])


@query("SELECT c_custkey AS root, CASE c_custkey % 3 WHEN 1 THEN false ELSE true END AS enabled FROM customer")
def monitor_switch(spark, sf):
    """Folders whose meta says that they are not watched; without a word they are."""
    c = F.col("c_custkey")
    meta = _read(spark, sf, "customer").where(c % 3 > 0).select(c.alias("root"), F.lit("monitor").alias("key"), F.when(c % 3 == 1, "0").otherwise("1").alias("value"))
    roots = _read(spark, sf, "customer").select(c.alias("root"))
    return monitor.switched_on(roots, meta)


_GROUPED = (
    _SCORES
    + f""", j AS (SELECT sc.face_id, sc.person_id, CASE WHEN g.face_id IS NOT NULL THEN -1.0 ELSE score END AS score FROM sc LEFT JOIN b_negatives g ON g.face_id = sc.face_id AND g.person_id = sc.person_id),
    t AS (SELECT face_id, arg_max(person_id, {{'s': score, 'p': -person_id}}) AS person_id, max(score) AS score FROM j GROUP BY face_id),
    dec AS (SELECT face_id, CASE WHEN score >= {AUTO} THEN 'auto' WHEN score >= {SUGGEST} AND p.name IS NOT NULL THEN 'suggested' ELSE 'orphan' END AS decision FROM t JOIN b_people p ON p.id = person_id),
    orph AS (SELECT id, v FROM ({_FREE}) WHERE id NOT IN (SELECT face_id FROM dec WHERE decision <> 'orphan')),
    e AS (SELECT a.id AS i, b.id AS j FROM orph a JOIN orph b ON a.id <> b.id WHERE list_dot_product(a.v, b.v) >= {1 - EPS}),
    core AS (SELECT i FROM e GROUP BY i HAVING count(*) + 1 >= {SAMPLES}), ce AS (SELECT i, j FROM e WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)),
    reach AS (SELECT i, i AS j FROM core UNION SELECT reach.i, ce.j FROM reach JOIN ce ON ce.i = reach.j), root AS (SELECT i, min(j) AS root FROM reach GROUP BY i),
    grouped AS (SELECT i FROM root UNION SELECT i FROM e WHERE j IN (SELECT i FROM core))
"""
)


@query(
    _GROUPED + "SELECT decision AS what, count(*) AS n FROM dec WHERE decision <> 'orphan' GROUP BY 1 UNION ALL SELECT 'clustered', count(*) FROM grouped UNION ALL SELECT 'people', count(DISTINCT root) FROM root",
    ("files", "faces", "people", "negatives"),
)
def group_faces(spark, sf):
    s = people.Settings(AUTO, SUGGEST, EPS, SAMPLES)
    return people.group_faces(bound(spark, sf, "faces"), bound(spark, sf, "files"), bound(spark, sf, "people"), bound(spark, sf, "negatives"), s)[2]


@query(
    _GROUPED + "SELECT count(*) FILTER (WHERE person_id IS NOT NULL OR id IN (SELECT face_id FROM dec WHERE decision <> 'orphan') OR id IN (SELECT i FROM grouped)) AS assigned, count(*) AS faces FROM b_faces",
    ("files", "faces", "people", "negatives"),
)
def group_faces_assigned(spark, sf):
    s = people.Settings(AUTO, SUGGEST, EPS, SAMPLES)
    out = people.group_faces(bound(spark, sf, "faces"), bound(spark, sf, "files"), bound(spark, sf, "people"), bound(spark, sf, "negatives"), s)[0]
    return out.agg(F.count("person_id").alias("assigned"), F.count(F.lit(1)).alias("faces"))


@query("SELECT a.vec_id AS i, b.label::BIGINT AS label, round(max(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0 GROUP BY 1, 2")
def label_maxima(spark, sf):
    """Queries are the stated set, every row whose id is divisible by 20, against all rows."""
    e = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("v"), "label")
    return rounded(cluster.group_maxima(e.where("i % 20 = 0").select("i", "v"), e), "score")


# --- the index, end to end ----------------------------------------------------------------------------------------------
def _picture(content: bytes, header_only: bool) -> dict:
    """The stand-in for a decoder: a picture is ``picture,width,height,date``."""
    kind, w, h, taken = content.decode().split(",")
    if kind != "picture":
        raise ValueError("no picture")
    return {"width": None if header_only else int(w), "height": None if header_only else int(h), "exif_date": taken or None, "lat_ref": "S", "lat": [22.0, 30.0], "lon_ref": "W", "lon": [43.5]}


def _group_of(content: bytes) -> list[float]:
    """The stand-in for a face's signature: pictures of one width show one person."""
    width = int(content.split(b",")[1])
    return [2.0 if k == width // 100 % 50 else 0.0 for k in range(50)]


def stand_ins() -> Engines:
    """Engines without models: what they find follows from the content alone."""
    return Engines(
        image=_picture, thumb=lambda c: c[:4], faces=lambda c: [{"x": 1.0, "y": 2.0, "w": 50.0, "h": 60.0, "score": s, "embedding": _group_of(c)} for s in (0.9, 0.79)], ocr=lambda c: [(" sign ", 0.9), ("blur", 0.1)],
        encode=lambda cs: [[3.0, 4.0] for _ in cs], pdf=lambda c: ([p.strip() for p in c.decode().split("|")], None), render=lambda c, k: b"page",
    )


def _index(spark, sf) -> cat.Catalog:
    """The catalogue of the media files after an index run in chunks: made once for each state of the table, as a user's is."""
    root = _media(spark, sf)
    store = cat.Catalog(spark, f"{shared_folder(spark)}/catalogue", cat.root_id(root))
    if cat.get_meta(store.read("meta"), "last_index_processed") is None:
        counts = run_index(spark, root, store, extractor(root, stand_ins(), date.today()), settings=people.Settings(0.99, 0.9, 0.05, 50), chunk_files=5_000)
        row = _rows(spark, [(f"count_{k}", str(n)) for k, n in counts.items()], "key string, value string")
        store.publish({"meta": cat.upsert(store.read("meta"), row, ["key"])})
    return store


@query(f"""SELECT rel_path, CASE k WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'mp4' THEN 'other' ELSE 'image' END AS kind, CASE k WHEN 'bad' THEN 'error' ELSE 'done' END AS status,
  CASE k WHEN 'jpg' THEN printf('2019-07-%02dT10:11:12', i % 28 + 1) WHEN 'pdf' THEN 'today' WHEN 'docx' THEN '2020-01-02T03:04:05' WHEN 'sticker' THEN '2023-01-01' END AS taken_at,
  CASE k WHEN 'jpg' THEN 'exif' WHEN 'pdf' THEN 'mtime' WHEN 'docx' THEN 'document' WHEN 'sticker' THEN 'whatsapp_android' END AS date_source,
  CASE k WHEN 'jpg' THEN 'date,gps,thumb,faces,clip,ocr' WHEN 'pdf' THEN 'date,thumb,text,ocr' WHEN 'docx' THEN 'date,text' WHEN 'sticker' THEN 'date,gps,thumb,clip' END AS stages,
  CASE WHEN k IN ('jpg', 'sticker') THEN -22.5::DOUBLE END AS lat, CASE k WHEN 'jpg' THEN 1000 + 100 * (i % 50) WHEN 'sticker' THEN 10 END::INT AS width FROM ({_MEDIA})""")
def index_files(spark, sf):
    f = _index(spark, sf).read("files")
    return f.select("rel_path", "kind", "status", F.when(F.col("date_source") == "mtime", "today").otherwise(F.col("taken_at")).alias("taken_at"), "date_source", F.nullif(text.stages_text(F.col("stages_done")), F.lit("")).alias("stages"), "lat", "width")


@query(
    f"""SELECT rel_path, 1 AS page, 'sign' AS content FROM ({_MEDIA}) WHERE k = 'jpg' UNION ALL SELECT rel_path, unnest([1, 2, 3]), unnest(['first ' || i, 'sign', 'third']) FROM ({_MEDIA}) WHERE k = 'pdf'
    UNION ALL SELECT rel_path, 1, i::VARCHAR FROM ({_MEDIA}) WHERE k = 'docx'"""
)
def index_texts(spark, sf):
    store = _index(spark, sf)
    return store.read("texts").join(store.read("files").select(F.col("id").alias("file_id"), "rel_path"), "file_id").select("rel_path", "page", "content")


@query(
    f"""SELECT rel_path, greatest(w, 1600)::INT AS longest, concat_ws(',', round_even(s, 0)::INT, round_even(2 * s, 0)::INT, round_even(50 * s, 0)::INT, round_even(60 * s, 0)::INT) AS box, 1.0::DOUBLE AS norm
    FROM (SELECT *, greatest(w, 1600) / 1600.0::DOUBLE AS s FROM (SELECT rel_path, 1000 + 100 * (i % 50) AS w FROM ({_MEDIA}) WHERE k = 'jpg'))"""
)
def index_faces(spark, sf):
    """One face a picture: the engine's second one is below the least score."""
    store = _index(spark, sf)
    files = store.read("files").select(F.col("id").alias("file_id"), "rel_path", F.greatest("width", F.lit(1600)).alias("longest"))
    f = store.read("faces").join(files, "file_id")
    return rounded(f.select("rel_path", "longest", text.bbox_format(F.col("bbox")).alias("box"), vectors.dot(F.col("embedding"), F.col("embedding")).alias("norm")), "norm")


@query(f"""SELECT 'new' AS what, count(*) AS n FROM ({_MEDIA}) UNION ALL SELECT 'processed', count(*) FILTER (WHERE k <> 'mp4') FROM ({_MEDIA}) UNION ALL SELECT 'errors', count(*) FILTER (WHERE k = 'bad') FROM ({_MEDIA})
  UNION ALL SELECT 'vectors', count(*) FILTER (WHERE k IN ('jpg', 'sticker')) FROM ({_MEDIA})""")
def index_counts(spark, sf):
    store = _index(spark, sf)
    held = store.read("meta").where("key IN ('count_new', 'count_processed', 'count_errors')").select(F.substring("key", 7, 99).alias("what"), F.col("value").cast("long").alias("n"))
    return held.union(store.read("clip_embeddings").agg(F.lit("vectors"), F.count(F.lit(1))))


@query(f"""SELECT rel_path, list_extract(['sign', 'third', 'first'], p) AS word, CASE p WHEN 1 THEN CASE k WHEN 'pdf' THEN 2 ELSE 1 END WHEN 2 THEN 3 ELSE 1 END AS page FROM ({_MEDIA}), (VALUES (1), (2), (3)) AS t(p) WHERE k = 'pdf' OR (k = 'jpg' AND p = 1)""")
def index_postings(spark, sf):
    """The full-text index that the run has left: the postings of three words."""
    store = _index(spark, sf)
    mine = store.read("fts_postings").where(F.col("token").isin("sign", "third", "first"))
    return mine.join(store.read("files").select(F.col("id").alias("file_id"), "rel_path"), "file_id").select("rel_path", F.col("token").alias("word"), "page")


@query(f"""SELECT id, rel_path, taken_at FROM (SELECT row_number() OVER (ORDER BY rel_path) AS id, rel_path, k, CASE k WHEN 'jpg' THEN printf('2019-07-%02dT10:11:12', i % 28 + 1) ELSE '2023-01-01' END AS taken_at FROM ({_MEDIA}))
  WHERE k IN ('jpg', 'sticker') ORDER BY taken_at DESC, id DESC LIMIT 60 OFFSET 40""")
def listing_by_cursor(spark, sf):
    """The second and third page of pictures out of the stored listing, each after the last row of the one before."""
    c, pages, cursor = searchable(_index(spark, sf)), [], None
    for limit in (40, 30, 30):
        pages.append(search.search(c, search.Query(kinds=("image",), stickers=True, limit=limit, after=cursor)).hits.select("id", "rel_path", "taken_at"))
        cursor = listing_index.next_cursor(pages[-1])
    return pages[1].union(pages[2])


@query("SELECT doc_id, least(strlen(text), 20)::BIGINT AS first_bytes, true AS bounded FROM documents WHERE text IS NOT NULL")
def encoded_batches(spark, sf):
    """Contents given to an encoder made once a worker, in batches of at most 256 KB (or one content)."""
    d = _read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    source = EngineSource("first-bytes", lambda: Engines(encode=lambda cs: [[float(len(c[:20]))] for c in cs]))
    out = encoded(d, "doc_id", "content", source, batch_bytes=256 << 10)
    return out.select("doc_id", F.col("embedding")[0].cast("long").alias("first_bytes"), ((F.col("batch_bytes") <= 256 << 10) | (F.col("batch_files") == 1)).alias("bounded"))


@query("SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END * (event_id % 90 + (event_id % 60) / 60.0::DOUBLE), 6) + 0.0 AS value FROM events")
def exif_angles(spark, sf):
    k = lambda m: (F.col("event_id") % m).cast("double")
    angle = geo.degrees(F.array(k(90), k(60)))
    return rounded(_read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, -angle).otherwise(angle).alias("value")), "value")
