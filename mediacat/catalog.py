"""Versioned Parquet snapshots of a catalogue: read, publish, meta, identities.

``publish`` writes the changed tables into a folder of its own and then makes the file ``versions/N``, a JSON map from each table to
the folder that holds it.  That file is renamed into place and never replaced: of two writers that start from the same version one
gets a ``Conflict``, and neither touches what the other has written.  Readers take the newest version, and unchanged tables are
not written again.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import fold_name_udf
from .schema import CLUSTERED, PARTITIONED, SCHEMA_VERSION, TABLES, conform, empty
from .storage import kept

ROOT_ID = r"^[0-9a-f]{16}$"


def root_id(root: str) -> str:
    """The id of an indexed root: 16 hex digits of the SHA-256 of its absolute path."""
    return hashlib.sha256(root.encode()).hexdigest()[:16]


class Conflict(RuntimeError):
    """Another writer has published a version since the one that the changes start from."""


class Catalog:
    def __init__(self, spark: SparkSession, base: str, root: str) -> None:
        self.spark, self.base = spark, f"{base.rstrip('/')}/root_id={root}"

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        """The newest version; 0 if there is none."""
        fs, path = self._fs()
        folder = path(f"{self.base}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _where(self, version: int) -> dict[str, str]:
        """The folder of each table, as seen by ``version``."""
        if not version:
            return {}
        fs, path = self._fs()
        stream = fs.open(path(f"{self.base}/versions/{version}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def holds(self, table: str) -> bool:
        return self.folder(table) is not None

    def folder(self, table: str, version: int | None = None) -> str | None:
        """Where a table of a version is; what is there never changes."""
        held = self._where(self.version() if version is None else version)
        return f"{self.base}/{held[table]}/{table}" if table in held else None

    def read(self, table: str, version: int | None = None) -> DataFrame:
        folder = self.folder(table, version)
        if folder is None:
            return empty(self.spark, table)
        return self.spark.read.schema(TABLES[table]).parquet(folder)  # columns that an older version lacks are null

    def publish(self, changed: dict[str, DataFrame], onto: int | None = None) -> int:
        """Writes a version in which ``changed`` replaces those tables; the others stay where they are.

        ``onto`` is the version that the changes start from, the newest one if none is given; if there is a newer one when all
        is written, nothing is published and ``Conflict`` is raised.  Folded names go with the people they belong to."""
        old = self.version() if onto is None else onto
        held, folder = self._where(old), f"data/{uuid.uuid4().hex}"
        if "people" in changed:
            changed = {**changed, "people_keys": changed["people"].select("id", fold_name_udf(F.col("name")).alias("name_key"))}
        for table, df in changed.items():
            df = conform(df, table)
            if table in CLUSTERED:
                df = df.repartitionByRange(*CLUSTERED[table]).sortWithinPartitions(*CLUSTERED[table])
            if table in PARTITIONED:
                df.write.partitionBy(PARTITIONED[table]).parquet(f"{self.base}/{folder}/{table}")
            else:
                df.write.parquet(f"{self.base}/{folder}/{table}")
            held[table] = folder
        try:
            self._commit(old + 1, json.dumps(held))
        except Conflict:
            fs, path = self._fs()
            fs.delete(path(f"{self.base}/{folder}"), True)  # this writer's own
            raise
        return old + 1

    def _commit(self, version: int, text: str) -> None:
        """Makes the file of a version by a rename that does not replace one."""
        jvm, (fs, path) = self.spark.sparkContext._jvm, self._fs()
        fs.mkdirs(path(f"{self.base}/versions"))
        mine, final = path(f"{self.base}/versions/.{uuid.uuid4().hex}"), path(f"{self.base}/versions/{version}")
        out = fs.create(mine)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(mine, final, none)
        except Py4JJavaError as e:
            fs.delete(mine, False)
            if fs.exists(final):
                raise Conflict(f"version {version} is there already") from e
            raise

    def clean(self) -> None:
        """Deletes tables that older versions hold and the newest one does not; no older version can be read afterwards."""
        fs, path = self._fs()
        last = self.version()
        held = self._where(last)
        for v in (s.getPath().getName() for s in fs.listStatus(path(f"{self.base}/versions"))):
            if v.isdigit() and int(v) < last:
                for table, folder in self._where(int(v)).items():
                    if held.get(table) != folder:
                        fs.delete(path(f"{self.base}/{folder}/{table}"), True)
                        if not fs.listStatus(path(f"{self.base}/{folder}")):
                            fs.delete(path(f"{self.base}/{folder}"), True)
                fs.delete(path(f"{self.base}/versions/{v}"), False)

    def migrate(self) -> int:
        """Brings the catalogue to the present schema version; repeating it changes nothing."""
        meta = self.read("meta")
        known = get_meta(meta, "schema_version")
        if known == str(SCHEMA_VERSION):
            return self.version()
        return self.publish({"meta": upsert(meta, self.spark.createDataFrame([("schema_version", str(SCHEMA_VERSION))], TABLES["meta"]), ["key"])})


class Catalogues:
    """The catalogues below a base folder, one a root: opening one brings it up to date and makes it the latest."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    def open(self, root: str, now: float | None = None) -> Catalog:
        """The catalogue of a root, made if there is none, migrated if it is older; ``now`` (seconds) is noted as its last use."""
        c = Catalog(self.spark, self.base, root_id(root))
        c.migrate()
        version = c.version()
        rows = self.spark.createDataFrame([("root_path", root), ("last_used", repr(float(time.time() if now is None else now)))], TABLES["meta"])
        c.publish({"meta": upsert(c.read("meta", version), rows, ["key"])}, version)
        return c

    def roots(self) -> DataFrame:
        """root_id, root_path, last_used of every catalogue that has been opened: one small read of all their meta tables."""
        fs, path = Catalog(self.spark, self.base, "")._fs()
        base = path(self.base)
        names = [s.getPath().getName() for s in fs.listStatus(base)] if fs.exists(base) else []
        ids = [n.removeprefix("root_id=") for n in names if n.startswith("root_id=")]
        metas = [Catalog(self.spark, self.base, i).read("meta").withColumn("root_id", F.lit(i)) for i in ids]
        every = reduce(DataFrame.unionByName, metas) if metas else empty(self.spark, "meta").withColumn("root_id", F.lit(""))
        value = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
        found = every.groupBy("root_id").agg(value("root_path").alias("root_path"), value("last_used").cast("double").alias("last_used"))
        return found.where("last_used IS NOT NULL")

    def recent(self) -> DataFrame:
        return recent_roots(self.roots())

    def latest(self) -> Catalog | None:
        """The catalogue used last, which a program opens when no root is named."""
        row = latest_root(self.roots()).first()
        return Catalog(self.spark, self.base, row["root_id"]) if row and row["root_id"] else None


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def get_meta(meta: DataFrame, key: str) -> str | None:
    row = meta.where(F.col("key") == key).select("value").first()
    return row["value"] if row else None


def assign_ids(new: DataFrame, existing: DataFrame, order: str, id_col: str = "id") -> DataFrame:
    """Ids for new rows: their rank by ``order`` after the largest existing id.  The rows are kept in sorted ranges first, so that
    whoever reads them finds the same ranges; ranks come from a count per range, and no task numbers all rows."""
    ranged = kept(new.orderBy(order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))  # one row a range
    top = existing.agg(F.max(id_col)).first()[0] or 0
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = ranged.join(F.broadcast(before), "_part").withColumn(id_col, F.lit(top) + F.coalesce("_before", F.lit(0)) + inside)
    return out.drop("_part", "_at", "_n", "_before")


def latest_root(roots: DataFrame) -> DataFrame:
    """roots: root_id, last_used.  The most recently used catalogue."""
    return roots.where(F.col("root_id").rlike(ROOT_ID)).agg(F.max_by("root_id", "last_used").alias("root_id"))


def recent_roots(roots: DataFrame) -> DataFrame:
    return roots.where(F.col("root_id").rlike(ROOT_ID)).orderBy(F.desc("last_used"), "root_id")


def is_unset(value: Column) -> Column:
    return value.isNull() | (value == "")
