"""The catalogue's tables bound to the test tables, as SQL that Spark and DuckDB read alike where they can."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..catalog import Catalog, Conflict, root_id
from ..operators.search import Lazy
from ..schema import SCHEMA_VERSION
from ..storage import shared_folder
from .index import stored_index, stored_vectors, sync_index, sync_vectors

FILES = """
SELECT doc_id AS id, concat(source, '/', CASE doc_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END, CAST(doc_id AS STRING),
         CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 4 THEN '.mp4' ELSE '.jpg' END) AS rel_path,
       CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 4 THEN 'other' ELSE 'image' END AS kind,
       n_chars AS size, CAST(1600000000 + doc_id * 61 AS DOUBLE) AS mtime,
       CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 2 = 1 THEN concat(CAST(DATE '2019-01-01' + CAST(doc_id % 1500 AS INT) AS STRING), 'T12:30:00')
            ELSE CAST(DATE '2019-01-01' + CAST(doc_id % 1500 AS INT) AS STRING) END AS taken_at,
       CASE doc_id % 4 WHEN 0 THEN 'exif' WHEN 1 THEN 'camera_name' WHEN 2 THEN 'mtime' ELSE NULL END AS date_source,
       (doc_id % 17 = 0 AND doc_id % 5 IN (2, 3)) AS is_sticker,
       CASE doc_id % 11 WHEN 0 THEN 'missing' WHEN 1 THEN 'error' WHEN 2 THEN 'pending' ELSE 'done' END AS status,
       CASE WHEN doc_id % 11 = 1 THEN concat('error ', CAST(doc_id AS STRING)) END AS error,
       CASE doc_id % 3 WHEN 0 THEN 'date,thumb' WHEN 1 THEN 'date,gps,thumb,faces,clip,ocr' ELSE '' END AS stages_text,
       CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE CASE doc_id % 3 WHEN 0 THEN 'Brasil' WHEN 1 THEN 'France' ELSE 'Portugal' END END AS country,
       CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('S', CAST(doc_id % 4 AS STRING)) END AS state,
       CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('C', CAST(doc_id % 9 AS STRING)) END AS city
FROM documents
"""
PEOPLE = """
SELECT CAST(c_custkey - 1 AS BIGINT) AS id,
       CASE c_custkey - 1 WHEN 0 THEN 'Maria Souza' WHEN 1 THEN 'João Lima' WHEN 2 THEN 'Ana' WHEN 3 THEN 'Zé' WHEN 4 THEN 'ana maria' WHEN 10 THEN 'Ninguém' WHEN 11 THEN 'Of The'
         ELSE CASE WHEN c_custkey > 20 AND c_custkey % 3 > 0 THEN concat('Customer ', CAST(c_custkey - 1 AS STRING)) END END AS name,
       (c_custkey - 1) % 50 = 3 AS hidden, CAST(CASE c_custkey - 1 WHEN 0 THEN 30 WHEN 2 THEN 9000000 END AS BIGINT) AS cover_face_id
FROM customer
"""
FACES = """
SELECT vec_id AS id, (vec_id * 7) % 100 AS file_id, CAST((vec_id * 37) % 1000 AS DOUBLE) / 1000 AS det_score, embedding,
       CAST(CASE WHEN vec_id % 3 = 0 THEN label END AS BIGINT) AS person_id,
       CASE WHEN vec_id % 3 = 0 THEN CASE vec_id % 12 WHEN 0 THEN 'cluster' WHEN 3 THEN 'user' WHEN 6 THEN 'auto' ELSE 'suggested' END END AS assign_source,
       CASE WHEN vec_id % 12 IN (6, 9) THEN CAST((vec_id * 13) % 100 AS DOUBLE) / 100 END AS assign_score, false AS manual
FROM embeddings
"""
NEGATIVES = "SELECT vec_id AS face_id, CAST(label AS BIGINT) AS person_id FROM embeddings WHERE vec_id % 7 = 0"
CLIP = "SELECT vec_id AS file_id, embedding FROM embeddings"
PLACES = """
SELECT CAST(n_nationkey AS BIGINT) AS place_id, n_name AS name, concat('R', CAST(n_regionkey AS STRING)) AS state, 'X' AS country,
       CAST((n_nationkey * 37) % 120 AS DOUBLE) - 60 + 0.25 AS lat, CAST((n_nationkey * 71) % 360 AS DOUBLE) - 179.9 AS lon FROM nation
"""
POINTS = """
SELECT c_custkey AS id, CAST(((c_custkey % 25) * 37) % 120 AS DOUBLE) - 60 + CAST(c_custkey % 11 AS DOUBLE) / 10 AS lat,
       CAST(((c_custkey % 25) * 71) % 360 AS DOUBLE) - 180 + CAST(c_custkey % 7 AS DOUBLE) / 8 AS lon FROM customer
"""
_PATH = "concat(CASE WHEN o_orderkey % 23 = 0 THEN '.trash/' ELSE 'in/' END, 'f', CAST(o_orderkey AS STRING), CASE o_orderkey % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.pdf' ELSE '.bin' END)"
_KIND = "CASE o_orderkey % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'pdf' ELSE 'other' END"
KNOWN = f"""
SELECT {_PATH} AS rel_path, {_KIND} AS kind, o_orderkey * 10 AS size, CAST(o_orderkey AS DOUBLE) + 0.5 AS mtime,
       CASE WHEN o_orderkey % 13 = 0 THEN 'missing' WHEN o_orderkey % 29 = 0 THEN 'error' WHEN o_orderkey % 17 = 0 THEN 'pending' ELSE 'done' END AS status,
       CASE WHEN o_orderkey % 29 = 0 THEN 'bad' END AS error, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'date,thumb' END AS stages_text
FROM orders WHERE o_orderkey % 10 <> 0
"""
SEEN = f"""
SELECT {_PATH} AS rel_path, {_KIND} AS kind, o_orderkey * 10 + CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS size,
       CAST(o_orderkey AS DOUBLE) + CASE WHEN o_orderkey % 31 = 0 THEN 1.5 ELSE 0.5 END AS mtime
FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 23 <> 0
"""
NAMES = """
SELECT event_id AS id, CAST(event_id % 28 + 1 AS INT) AS day,
  CASE event_id % 9
    WHEN 0 THEN concat('IMG-202305', CAST(event_id % 22 + 10 AS STRING), '-WA0007.jpg')
    WHEN 1 THEN concat('WhatsApp Image 2022-0', CAST(event_id % 9 + 1 AS STRING), '-1', CAST(event_id % 10 AS STRING), ' at 9.05.', CAST(event_id % 50 + 10 AS STRING), ' PM.jpeg')
    WHEN 2 THEN concat('WhatsApp Video 2021-1', CAST(event_id % 4 AS STRING), '-05 at ', CAST(event_id % 26 AS STRING), '.05.09.mp4')
    WHEN 3 THEN concat('PXL_201912', CAST(event_id % 30 + 10 AS STRING), '_2105', CAST(event_id % 60 + 10 AS STRING), '123.jpg')
    WHEN 4 THEN concat('20230514-2', CAST(event_id % 10 AS STRING), '0509(0).jpg')
    WHEN 5 THEN 'IMG-19891231-WA0001.jpg' WHEN 6 THEN 'IMG-20260925-WA0001.jpg' WHEN 7 THEN 'STK-20260926-WA1.webp' ELSE 'holiday.png' END AS name,
  CASE WHEN event_id % 4 = 0 THEN concat('2021:12:', CAST(event_id % 25 + 10 AS STRING), ' 10:11:12') WHEN event_id % 4 = 1 THEN '0000:00:00 00:00:00' END AS exif,
  CASE WHEN event_id % 5 = 0 THEN concat('D:202305', CAST(event_id % 25 + 10 AS STRING), '210509-03''00''') WHEN event_id % 5 = 1 THEN 'D:2023' WHEN event_id % 5 = 2 THEN '20230514' END AS pdf,
  CASE WHEN event_id % 6 = 0 THEN 0.0E0 ELSE CAST(1500000000 + event_id * 1000 AS DOUBLE) + 0.75E0 END AS mtime
FROM events
"""
TICKS = """
SELECT DISTINCT event_id % 40 AS tick, concat('f', CAST(event_id % 3 AS STRING)) AS rel_path, CAST(100 + ((event_id % 40) - (event_id % 40) % 3) AS BIGINT) AS size, 1.5E0 AS mtime
FROM events WHERE event_id % 40 % 10 <> 9
"""

SQL = {"files": FILES, "people": PEOPLE, "faces": FACES, "negatives": NEGATIVES, "clip": CLIP, "places": PLACES, "points": POINTS, "known": KNOWN, "seen": SEEN, "names": NAMES, "ticks": TICKS}
TABLES = ["documents", "embeddings", "nation", "customer", "orders", "events"]

#: One row a line of a document; the engines count lines differently.
TEXTS_SPARK = "SELECT doc_id AS file_id, pos + 1 AS page, content FROM documents LATERAL VIEW posexplode(split(text, '\n')) t AS pos, content"
TEXTS_DUCK = "SELECT doc_id AS file_id, unnest(range(1, len(l) + 1))::INT AS page, unnest(l) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A bound table; only the base table it reads is opened."""
    text = TEXTS_SPARK if name == "texts" else SQL[name]
    base = next((t for t in TABLES if f"FROM {t}" in text), None)
    if base is None:
        return spark.sql(text)
    return spark.sql(text.replace(f"FROM {base}", "FROM {base}"), base=given(spark, f"{sf_dir}/{base}.parquet"))


_SCHEMAS: dict[str, StructType] = {}


def given(spark: SparkSession, path: str) -> DataFrame:
    """A given table; its schema is read from the files once for each state of the table."""
    sign = table_sign(spark, path)
    if sign not in _SCHEMAS:
        _SCHEMAS[sign] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[sign]).parquet(path)


def table_sign(spark: SparkSession, path: str) -> str:
    """What tells one state of a table from another: the names, sizes and times of its files."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(base)
    return ";".join(sorted(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}" for f in files))


def bound_id(spark: SparkSession, path: str, *names: str) -> str:
    """The id of a catalogue of bound tables: another state of the table, another binding or another schema makes another one."""
    return root_id(";".join([str(SCHEMA_VERSION), table_sign(spark, path), *(SQL.get(n, TEXTS_SPARK) for n in names)]))


def published(spark: SparkSession, sf_dir: str) -> Catalog:
    """The index of the bound texts and the bound people as a published catalogue in the shared folder.

    It is found by what the base table's files are, their names, sizes and times: another table makes another one, and a
    table that is there is read, in this session or a later one."""
    store = Catalog(spark, f"{shared_folder(spark)}/bound", bound_id(spark, f"{sf_dir}/documents.parquet", "texts", "people"))
    if not store.version():
        try:
            store.publish({"people": bound(spark, sf_dir, "people")}, 0)
        except Conflict:  # another session makes it, too
            pass
    if not store.holds("fts_totals"):
        try:
            sync_index(store, bound(spark, sf_dir, "texts"))
        except Conflict:
            pass
    return store


def published_vectors(spark: SparkSession, sf_dir: str) -> Catalog:
    """The bound vectors in the same way."""
    store = Catalog(spark, f"{shared_folder(spark)}/bound", bound_id(spark, f"{sf_dir}/embeddings.parquet", "clip"))
    if not store.holds("clip_placed"):
        try:
            sync_vectors(store, bound(spark, sf_dir, "clip"))
        except Conflict:
            pass
    return store


def build_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full-text index of the bound texts made afresh, as the first index run makes it: its totals.  For measurements."""
    store = Catalog(spark, f"{shared_folder(spark)}/fresh", root_id(uuid.uuid4().hex))
    sync_index(store, bound(spark, sf_dir, "texts"))
    return store.read("fts_totals")


def catalogue(spark: SparkSession, sf_dir: str) -> Lazy:
    """The catalogue as a search reads it: with its index, which is made when a search first asks for it."""
    store = cache(lambda: published(spark, sf_dir))
    return Lazy(index=lambda: stored_index(store()), people_keys=lambda: store().read("people_keys"), vector_index=lambda: stored_vectors(published_vectors(spark, sf_dir)), listing=lambda: None, **_bare(spark, sf_dir))


def tables(spark: SparkSession, sf_dir: str) -> Lazy:
    """The bare tables, for queries without text."""
    return Lazy(index=lambda: None, people_keys=lambda: None, vector_index=lambda: None, listing=lambda: None, **_bare(spark, sf_dir))


def _bare(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    return {n: lambda n=n: bound(spark, sf_dir, n) for n in ("files", "texts", "faces", "people", "clip")}


def with_bound(*names: str) -> str:
    """The WITH clause that defines bound tables for DuckDB, b_<name> each."""
    text = {**SQL, "texts": TEXTS_DUCK}
    return "WITH RECURSIVE " + ", ".join(f"b_{n} AS ({text[n]})" for n in names)
