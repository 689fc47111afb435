"""The catalogue's tables as constant schemas, and readers that add what older versions lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

SCHEMA_VERSION = 5

_TYPES = {"string": StringType(), "long": LongType(), "int": IntegerType(), "double": DoubleType(), "boolean": BooleanType(), "strings": ArrayType(StringType()), "ints": ArrayType(IntegerType()), "doubles": ArrayType(DoubleType()), "vector": ArrayType(FloatType())}
_TYPES["box"] = StructType([StructField(n, IntegerType()) for n in "xywh"])
_TYPES["key"] = StructType([StructField("taken_at", StringType()), StructField("id", LongType())])


def _table(columns: str) -> StructType:
    """A schema from ``name type`` pairs; it needs no session."""
    return StructType([StructField(n, _TYPES[t]) for n, t in (c.split() for c in columns.split(","))])


_FILES = (
    "id long, rel_path string, kind string, size long, mtime double, hash string, taken_at string, date_source string, width int, height int, "
    "is_sticker boolean, status string, error string, stages_done strings, lat double, lon double, city string, state string, country string"
)
TABLES: dict[str, StructType] = {
    "meta": _table("key string, value string"),
    "files": _table(_FILES),
    "texts": _table("content string, file_id long, page int"),
    "people": _table("id long, name string, hidden boolean, cover_face_id long"),
    "faces": _table("id long, file_id long, bbox box, det_score double, embedding vector, person_id long, assign_source string, assign_score double, manual boolean"),
    "face_negatives": _table("face_id long, person_id long"),
    "clip_embeddings": _table("file_id long, embedding vector"),
    "places": _table("name string, state string, country string, lat double, lon double"),
    # derived from the tables above
    "listing": _table(_FILES + ", part int"),
    "listing_fences": _table("part int, n long, newest key, oldest key"),
    "fts_postings": _table("token string, file_id long, page int, tf int, len int, positions ints"),
    "fts_pages": _table("file_id long, page int, len int, sign long"),
    "fts_totals": _table("n long, avg double"),
    "people_keys": _table("id long, name_key string"),
    "clip_placed": _table("file_id long, embedding vector, cell int"),
    "clip_cells": _table("cell int, pivot doubles, far double, n long"),
}

#: The column that a table has a folder a value of, and columns whose sorted ranges a table is written in: a filter on the first reads
#: few files or row groups.
PARTITIONED = {"clip_placed": "cell", "listing": "part"}
CLUSTERED = {"fts_postings": ["token", "file_id", "page"]}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order; those that an older version lacks are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table].fields])
