"""Shared folder, stored tables, bounds of the batches that Python gets, and fold helpers."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: list[str] = []
#: Settings that bound what a task holds of whole texts, which are long: bytes of an Arrow batch, on both sides of the pipe, and
#: rows that the Parquet reader decodes at a time.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.parquet.columnarReaderBatchSize": "256"}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).  Where it is unset, a temporary one, on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="mediacat-"))
    return _FALLBACK[0]


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends there, executors may go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mediacat-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote for these tables, which nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession):
    """Whatever runs inside is bound by ``BATCH``; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bounded_session(spark: SparkSession) -> SparkSession:
    """The session with these bounds from here on, for results that whoever asked for them evaluates."""
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    return spark


def give_back() -> None:
    """Hands freed memory back to the system: a worker is used again, and must not keep what an earlier task took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(function):
    """``function`` over batches; what its task held goes back when the task ends."""

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def text_rows(df: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """Only the id and the text, under the names ``doc_id`` and ``text``, and ``carried``, a struct of the other columns
    that are to come along: no other column can clash, and the text goes to Python once."""
    carried = [F.struct(*[F.col(c) for c in carry if c != text_col], F.lit(0).alias("_")).alias("carried")] if carry else []
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carried)


def carried_schema(source: DataFrame) -> str:
    """The schema text of ``carried`` and the text, for functions that pass them on."""
    return f", text string, carried {source.schema['carried'].dataType.simpleString()}" if "carried" in source.columns else ""


def carried_part(batch, where) -> list:
    return [batch["text"].take(where), batch["carried"].take(where)] if "carried" in batch.schema.names else []


def carried_columns(carry: list[str] | None, text_col: str) -> list[Column]:
    """The struct ``carried`` as the caller asked for it, made of what a function passed on."""
    return [F.struct(*[(F.col("text") if c == text_col else F.col("carried")[c]).alias(c) for c in carry]).alias("carried")] if carry else []
