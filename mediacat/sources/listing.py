"""Folder listing in rounds, and classification of files by name and first bytes."""

from __future__ import annotations

import io
import logging
import os
import zipfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import basename, extension
from ..storage import kept
from .pictures import file_system

log = logging.getLogger(__name__)

#: Extensions and brands of images.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".heic", ".heif", ".bmp"]
HEIF_BRANDS = [b"heic", b"heix", b"hevc", b"heim", b"heis", b"mif1", b"msf1"]
#: First bytes that a listing carries.
HEAD_BYTES = 16
#: Entries of a folder that are held at a time.
LIST_ROWS = 10_000


#: Fixed value: the first bytes of a zip archive.
ZIP = b"PK\x03\x04"


def archive_kind(content) -> str:
    """docx for a zip (a path or a file object) with a Word document inside, else other."""
    try:
        with zipfile.ZipFile(content) as z:
            return "docx" if "word/document.xml" in z.namelist() else "other"
    except (OSError, ValueError, zipfile.BadZipFile):  # ValueError: shorter than what ends an archive
        return "other"


def _entries(root: str, rel: str) -> Iterator[tuple[str, bool, int, float]]:
    """(rel_path, is a folder, size, mtime) of what a folder holds.  Folders that begin with a dot are left out, symbolic links not followed."""
    if "://" in root:
        files, base = file_system(root)
        for e in files.get_file_info(fs.FileSelector(f"{base}/{rel}".rstrip("/"))):
            folder = e.type == fs.FileType.Directory
            if not (folder and e.base_name.startswith(".")) and e.type in (fs.FileType.Directory, fs.FileType.File):
                yield f"{rel}/{e.base_name}".lstrip("/"), folder, e.size or 0, (e.mtime_ns or 0) / 1e9
        return
    with os.scandir(os.path.join(root, rel)) as entries:
        for e in entries:
            path = f"{rel}/{e.name}".lstrip("/")
            if e.is_dir(follow_symlinks=False):
                if not e.name.startswith("."):
                    yield path, True, 0, 0.0
            elif e.is_file(follow_symlinks=False):
                stat = e.stat(follow_symlinks=False)
                yield path, False, stat.st_size, stat.st_mtime


def _listed(folders: DataFrame, root: str) -> DataFrame:
    """folders: rel_path.  rel_path, is_dir, size, mtime of what they hold; one that cannot be listed is logged and left out."""
    schema = pa.schema([("rel_path", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("mtime", pa.float64())])

    def run(batches):
        for batch in batches:
            for rel in batch["rel_path"].to_pylist():
                try:
                    found = _entries(root, rel)
                    while part := list(islice(found, LIST_ROWS)):
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part), schema.types)], schema=schema)
                except OSError as e:
                    log.warning("cannot list %s: %s", rel, e)

    return folders.mapInArrow(run, "rel_path string, is_dir boolean, size long, mtime double")


def _with_heads(listed: DataFrame, root: str) -> DataFrame:
    """Adds head and archive of the files, dealt evenly to the tasks, whatever folder they are in."""

    def run(batches):
        files, base = file_system(root)
        for batch in batches:
            heads, archives = [], []
            for rel in batch["rel_path"].to_pylist():
                head = archive = None
                try:
                    with files.open_input_file(f"{base}/{rel}") as f:
                        head = f.read(HEAD_BYTES)
                        if "." not in rel.rsplit("/", 1)[-1] and head.startswith(ZIP):
                            f.seek(0)
                            archive = archive_kind(f)
                except OSError:
                    pass
                heads.append(head)
                archives.append(archive)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary()), pa.array(archives, pa.string())], [*batch.schema.names, "head", "archive"])

    return listed.mapInArrow(run, "rel_path string, size long, mtime double, head binary, archive string")


def list_folder(spark: SparkSession, root: str, head: bool = True, bare: bool = False) -> DataFrame:
    """rel_path, size, mtime, head, archive (what a zip without an extension is) of all files below ``root``, hidden files too; folders that begin
    with a dot are not entered, symbolic links not followed.  ``head`` = False opens no file, ``bare`` only those without an extension, whose kind their bytes decide.

    Breadth first: each round lists the folders that the one before has found, spread over all tasks, and is kept in the shared folder;
    so the depth of the tree, not the width of any folder, is the number of rounds.  Files are opened in a pass of their own."""
    root = root if "://" in root else os.path.abspath(root)
    many = spark.sparkContext.defaultParallelism
    folders, files = spark.createDataFrame([("",)], "rel_path string"), None
    while True:
        level = kept(_listed(folders, root))
        own = level.where("NOT is_dir").select("rel_path", "size", "mtime")
        files = own if files is None else files.unionByName(own)
        folders = level.where("is_dir").select("rel_path")
        if folders.isEmpty():
            break
        folders = folders.repartition(many)
    if head and bare:
        named = kind_of(F.col("rel_path")).isNotNull()
        return _unopened(files.where(named)).unionByName(_with_heads(files.where(~named).repartition(many), root))
    return _with_heads(files.repartition(many), root) if head else _unopened(files)


def _unopened(files: DataFrame) -> DataFrame:
    return files.select("*", F.lit(None).cast("binary").alias("head"), F.lit(None).cast("string").alias("archive"))


def in_hidden_folder(rel_path: Column) -> Column:
    parts = F.split(rel_path, "/")
    return F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.startswith(p, F.lit(".")))


def kind_of(path: Column) -> Column:
    """image, pdf, docx or other by extension; null without one, for which the bytes decide."""
    ext = extension(path)
    return F.when(ext == "", F.lit(None)).when(ext.isin(IMAGE_EXTENSIONS), "image").when(ext == ".pdf", "pdf").when(ext == ".docx", "docx").otherwise("other")


def sniff_kind(head: Column) -> Column:
    """The kind by first bytes; ``zip`` archives need their content (see ``archive_kind``)."""
    starts = lambda b: F.startswith(head, F.lit(b))
    image = (
        starts(b"\xff\xd8\xff") | starts(b"\x89PNG") | starts(b"BM") | (starts(b"RIFF") & (F.substring(head, 9, 4) == F.lit(b"WEBP")))
        | ((F.substring(head, 5, 4) == F.lit(b"ftyp")) & F.substring(head, 9, 4).isin(HEIF_BRANDS))
    )
    return F.when(starts(b"%PDF-"), "pdf").when(image, "image").when(starts(b"PK\x03\x04"), "zip").otherwise("other")


@F.pandas_udf(StringType())
def word_archive_kind(content: pd.Series) -> pd.Series:
    """docx for a zip with a Word document inside, else other."""

    return content.map(lambda raw: archive_kind(io.BytesIO(raw or b"")))


def is_sticker(path: Column) -> Column:
    name = basename(path)
    return F.startswith(name, F.lit("STK-")) & F.endswith(F.lower(name), F.lit(".webp"))


def content_hash(content: Column) -> Column:
    """SHA-256 of the content: stable, though no digest of another family equals it."""
    return F.sha2(content, 256)


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """name, state, country, lat, lon of a tab-separated file (compressed or not), with place_id for ties: a hash of the row, the
    same whoever reads the file."""
    schema = "name string, state string, country string, lat double, lon double"
    rows = spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path).fillna("", ["state", "country"])
    return rows.withColumn("place_id", F.xxhash64("name", "state", "country", "lat", "lon"))


def build_gazetteer(cities: DataFrame, countries: DataFrame, regions: DataFrame) -> DataFrame:
    """cities: name, country_code, region_code, lat, lon; countries: country_code, country; regions: country_code, region_code, state.

    Codes without a name keep the code as country and the empty text as state; ordered for the sink."""
    named = cities.join(countries, "country_code", "left").join(regions, ["country_code", "region_code"], "left")
    return named.select("name", F.coalesce("state", F.lit("")).alias("state"), F.coalesce("country", "country_code").alias("country"), "lat", "lon").orderBy("country", "state", "name", "lat", "lon")


def write_gazetteer(places: DataFrame, path: str) -> None:
    places.write.mode("overwrite").option("sep", "\t").option("emptyValue", "").option("compression", "gzip").csv(path)


def model_manifest(lines: DataFrame) -> DataFrame:
    """lines: value.  (file, sha256, licence, origin) of a Markdown table's four-cell rows about model files."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(F.translate(x, "`", "")))
    rows = lines.select(cells.alias("c")).where((F.size("c") == 4) & F.regexp_like(F.col("c")[0], F.lit(r"\.(onnx|json|gz)$")))
    return rows.select(*[F.col("c")[k].alias(n) for k, n in enumerate(("file", "sha256", "licence", "origin"))])


def listed_kind() -> Column:
    """The kind of a listed file: by extension, or without one by first bytes and what a zip holds."""
    sniffed = sniff_kind(F.col("head"))
    return F.coalesce(kind_of(F.col("rel_path")), F.when(sniffed == "zip", F.coalesce("archive", F.lit("other"))).otherwise(sniffed), F.lit("other"))


def check_models(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """present: file, content.  ok, absent or differs for each file of the manifest."""
    state = F.when(F.col("own").isNull(), "absent").when(F.col("own") == F.lower("sha256"), "ok").otherwise("differs")
    return manifest.join(present.select("file", F.sha2("content", 256).alias("own")), "file", "left").select("file", state.alias("state"))
