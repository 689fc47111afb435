"""Folder monitor on Structured Streaming: act only when two ticks in a row see the same pending changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..catalog import get_meta
from ..operators.cdc import pending_changes
from ..sources.listing import kind_of, list_folder

SECONDS = 60


def fingerprint(changes: DataFrame) -> str | None:
    """A digest of a whole set of changes, null if it is empty: sums of row hashes, so the order does not matter."""
    row = F.xxhash64("rel_path", "size", "mtime")
    out = changes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("a"), F.sum(F.pmod(F.xxhash64(row, F.lit(1)), F.lit(1 << 31))).alias("b")).first()
    return f"{out['n']}:{out['a']}:{out['b']}" if out["n"] else None


def settled(ticks: DataFrame) -> DataFrame:
    """Batch twin of the monitor: ticks (tick, rel_path, size, mtime) -> tick, act."""
    from pyspark.sql import Window

    row = F.xxhash64("rel_path", "size", "mtime")
    sets = ticks.groupBy("tick").agg(F.count("rel_path").alias("n"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("s"))
    w = Window.orderBy("tick")  # one row a tick
    same = (F.col("n") > 0) & (F.col("n") == F.lag("n").over(w)) & (F.col("s") == F.lag("s").over(w))
    return sets.select("tick", F.coalesce(same, F.lit(False)).alias("act"))


#: A tick: the folder, its number, and the fingerprint of its pending changes (null: none, or not watched).
TICK = StructType([StructField("root", StringType()), StructField("tick", LongType()), StructField("sign", StringType())])


def _settle(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The rule for one folder: act on a tick whose changes are those of the tick before, and then forget them.  The changes last seen are
    the state, which the checkpoint keeps."""
    last, out = (state.get[0] if state.exists else None), []
    ticks = pd.concat(list(frames)).sort_values("tick")
    for tick, sign in zip(ticks["tick"], ticks["sign"]):
        act = isinstance(sign, str) and sign == last
        last = sign if isinstance(sign, str) and not act else None
        out.append((key[0], tick, act))
    state.update((last,))
    yield pd.DataFrame(out, columns=["root", "tick", "act"])


def settling(ticks: DataFrame) -> DataFrame:
    """root, tick, act of a stream of ticks, one state a folder."""
    return ticks.groupBy("root").applyInPandasWithState(_settle, "root string, tick long, act boolean", "last string", "append", GroupStateTimeout.NoTimeout)


def enabled(meta: DataFrame) -> bool:
    return get_meta(meta, "monitor") != "0"


def switched_on(roots: DataFrame, meta: DataFrame) -> DataFrame:
    """roots: root; meta: root, key, value.  root, enabled: the same for many folders at once."""
    off = meta.where("key = 'monitor' AND value = '0'").select("root", F.lit(True).alias("_off")).distinct()
    return roots.join(off, "root", "left").select("root", F.col("_off").isNull().alias("enabled"))


class Monitor:
    """The two queries of a monitor: one writes ticks, the other acts on them."""

    def __init__(self, *queries: StreamingQuery) -> None:
        self.queries = queries

    def stop(self) -> None:
        for q in self.queries:
            q.stop()

    def awaitTermination(self, seconds: float) -> bool:  # noqa: N802  (as of a query)
        return any(q.awaitTermination(seconds / len(self.queries)) for q in self.queries)


def start_monitor(
    spark: SparkSession, root: str, known: Callable[[], DataFrame], index: Callable[[], None], checkpoint: str, meta: Callable[[], DataFrame] | None = None, seconds: float = SECONDS
) -> Monitor:
    """Lists the folder on every trigger and calls ``index`` once changes have settled; a restart on the same checkpoint goes on where
    it was, with the changes that were seen last."""

    def tick(batch: DataFrame, number: int) -> None:
        sign = None
        if meta is None or enabled(meta()):
            seen = list_folder(spark, root, head=False).withColumn("kind", F.coalesce(kind_of(F.col("rel_path")), F.lit("other")))
            sign = fingerprint(pending_changes(known(), seen))
        spark.createDataFrame([(root, number, sign)], TICK).coalesce(1).write.mode("append").parquet(f"{checkpoint}/ticks")

    def act(batch: DataFrame, number: int) -> None:
        if batch.agg(F.count_if("act")).first()[0]:  # all of the batch, or its state would not be whole
            index()

    spark.createDataFrame([], TICK).write.mode("append").parquet(f"{checkpoint}/ticks")
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    every = {"processingTime": f"{seconds} seconds"}
    writer = clock.writeStream.foreachBatch(tick).option("checkpointLocation", f"{checkpoint}/clock").trigger(**every).start()
    ticks = spark.readStream.schema(TICK).parquet(f"{checkpoint}/ticks")
    actor = settling(ticks).writeStream.foreachBatch(act).option("checkpointLocation", f"{checkpoint}/settled").trigger(**every).start()
    return Monitor(writer, actor)


class Progress(StreamingQueryListener):
    """Collects the number of the last finished tick; a job group cancels a running one."""

    def __init__(self) -> None:
        self.ticks = -1

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.ticks = event.progress.batchId

    def onQueryTerminated(self, event) -> None:
        pass


def in_group(spark: SparkSession, group: str, job: Callable[[], None]) -> None:
    """Runs a job that ``spark.sparkContext.cancelJobGroup(group)`` can stop between its actions."""
    spark.sparkContext.setJobGroup(group, group, interruptOnCancel=False)
    try:
        job()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
