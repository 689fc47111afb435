"""The index driver: scan, extraction of due stages, places and grouping, published as catalogue versions.

The work list is done in chunks, a few at a time.  What a chunk has extracted is stored beside the catalogue and marked as done; a run that
is killed or cancelled loses ``IN_FLIGHT`` chunks at most, and the next run saves what it finds and goes on with the rest.  Tables are
written once a run, not once a chunk."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, assign_ids, get_meta, upsert
from ..operators import cdc, fts, listing_index, people, vector_index
from ..operators.search import Lazy
from ..schema import TABLES
from ..sources.listing import in_hidden_folder, is_sticker, list_folder, listed_kind
from ..sources.pictures import save_pictures
from ..storage import drop_kept, kept
from .extract import ROWS, file_error, tables_of

#: extract(work list: id, rel_path, kind, todo) -> {"files": rel_path, error, ran, r_*; "texts", "clip_embeddings", "faces": new rows; perhaps
#: "thumbs": file_id, thumb; or "raw": rows of ``extract.ROWS``, of which all these are made when they are saved}
Extractor = Callable[[DataFrame], dict[str, DataFrame]]


def listed(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, kind, size, mtime of the folder; extension-less files go by their first bytes."""
    rows = list_folder(spark, root, bare=True).where(~in_hidden_folder(F.col("rel_path")))
    return rows.select("rel_path", listed_kind().alias("kind"), "size", "mtime")


def scan(catalog: Catalog, seen: DataFrame, force: bool = False, retry_errors: bool = False) -> int:
    """Publishes the catalogue after a scan: ids for new files, stale rows of changed and purged ones gone."""
    files = catalog.read("files")
    after = cdc.apply_scan(files, seen, force, retry_errors)
    rows = after.join(files.drop("kind", "size", "mtime", "status", "error", "stages_done", "is_sticker"), "rel_path", "left")
    fresh = F.col("change").isin("new", "changed")
    reset = {"hash": F.when(~fresh, F.col("hash")), **{c: F.when(~fresh & ~F.col("forget_place"), F.col(c)) for c in ("lat", "lon", "city", "state", "country")}}
    rows = rows.withColumns({**reset, "is_sticker": is_sticker(F.col("rel_path"))}).select(*TABLES["files"].names)
    old = rows.where("id IS NOT NULL")
    new = assign_ids(rows.where("id IS NULL").drop("id"), files, "rel_path").select(*TABLES["files"].names)
    # only tables that are there can have stale rows; with any of them the scan's result is read several times
    held = [t for t in ("texts", "faces", "clip_embeddings", "face_negatives") if catalog.holds(t)]
    out = kept(old.unionByName(new)) if held else old.unionByName(new)
    changed = {"files": out}
    if "texts" in held:
        changed["texts"] = fts.without_stale(cdc.cascade(catalog.read("texts"), out, "file_id"), out)
    for table in {"faces", "clip_embeddings"} & set(held):
        changed[table] = cdc.cascade(catalog.read(table), out.where("kind <> 'other'"), "file_id")
    if "face_negatives" in held:
        changed["face_negatives"] = cdc.cascade(catalog.read("face_negatives"), changed.get("faces", catalog.read("faces")), "face_id")
    version = catalog.publish(changed)
    if held:
        drop_kept(out)
    return version


def sync_index(catalog: Catalog, texts: DataFrame | None = None) -> int:
    """Brings the full-text index up to the catalogue's texts (or those given) and publishes it; how many pages changed.

    Only pages whose text changed are tokenised; if none did, nothing is written.  A run that died before this is mended by the next.
    Where nothing is indexed yet all pages are new, and there is nothing to compare them with."""
    version = catalog.version()
    texts = catalog.read("texts") if texts is None else texts
    if not catalog.holds("fts_pages"):
        n, distinct = fts.page_count(texts)
        if n:
            pages = kept(fts.page_signs(texts))
            catalog.publish({"fts_postings": fts.postings(texts, distinct), "fts_pages": pages, "fts_totals": fts.page_totals(pages)}, version)
            drop_kept(pages)
        return n
    changes = kept(fts.index_changes(texts, catalog.read("fts_pages")))
    n = changes.count()
    if n:
        postings, pages = fts.updated_index(texts, catalog.read("fts_postings"), catalog.read("fts_pages"), changes)
        catalog.publish({"fts_postings": postings, "fts_pages": pages, "fts_totals": fts.page_totals(pages)}, version)
    drop_kept(changes)
    return n


def sync_vectors(catalog: Catalog, vectors: DataFrame | None = None) -> bool:
    """Brings the vector index up to the catalogue's vectors (or those given); whether anything had changed."""
    version = catalog.version()
    vectors = (catalog.read("clip_embeddings") if vectors is None else vectors).select("file_id", "embedding")
    sign = lambda df: df.select("file_id", F.col("embedding").cast("array<float>").alias("embedding")).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.pmod(F.xxhash64("file_id", "embedding"), F.lit(1 << 31))), F.lit(0))).first()
    if sign(vectors) == sign(catalog.read("clip_placed")):
        return False
    placed, cells = vector_index.placed_vectors(vectors)
    placed = kept(placed)  # pivots are chosen once for both tables
    catalog.publish({"clip_placed": placed.repartition("cell"), "clip_cells": cells}, version)
    drop_kept(placed)
    return True


def stored_vectors(catalog: Catalog, version: int | None = None) -> vector_index.VectorIndex:
    return vector_index.VectorIndex(catalog.read("clip_placed", version), catalog.read("clip_cells", version), catalog.folder("clip_cells", version))


def sync_listing(catalog: Catalog, part_rows: int = listing_index.PART_ROWS) -> bool:
    """Brings the stored listing up to the catalogue's files; whether they had changed.  Meta says which files it is of."""
    version = catalog.version()
    source = catalog.folder("files", version) or ""
    if get_meta(catalog.read("meta", version), "listing_of") == source:
        return False
    rows = kept(listing_index.in_parts(catalog.read("files", version), part_rows))
    meta = catalog.spark.createDataFrame([("listing_of", source)], TABLES["meta"])
    catalog.publish({"listing": rows, "listing_fences": listing_index.fences_of(rows), "meta": upsert(catalog.read("meta", version), meta, ["key"])}, version)
    drop_kept(rows)
    return True


_FENCES: dict[str, tuple] = {}


def stored_listing(catalog: Catalog, version: int | None = None) -> listing_index.Listing | None:
    """The stored listing, if it is of this version's files.  Its fences, a row a part, are read once a session."""
    version = catalog.version() if version is None else version
    folder = catalog.folder("listing_fences", version)
    if folder is None or get_meta(catalog.read("meta", version), "listing_of") != catalog.folder("files", version):
        return None
    if folder not in _FENCES:
        if len(_FENCES) >= 16:
            _FENCES.clear()
        rows = catalog.read("listing_fences", version).orderBy("part").collect()
        _FENCES[folder] = tuple((r["part"], r["n"], tuple(r["newest"]), tuple(r["oldest"])) for r in rows)
    return listing_index.Listing(catalog.read("listing", version), _FENCES[folder])


def stored_index(catalog: Catalog) -> fts.Index:
    """The index that a search reads."""
    return fts.Index(catalog.read("fts_postings"), catalog.read("fts_totals"))


def searchable(catalog: Catalog) -> Lazy:
    """The published tables as a search reads them, with the stored index and folded names, all of one version."""
    version = catalog.version()
    read = lambda table: lambda: catalog.read(table, version)
    index = lambda: fts.Index(catalog.read("fts_postings", version), catalog.read("fts_totals", version))
    return Lazy(files=read("files"), texts=read("texts"), faces=read("faces"), people=read("people"), clip=read("clip_embeddings"), index=index, people_keys=read("people_keys"), vector_index=lambda: stored_vectors(catalog, version), listing=lambda: stored_listing(catalog, version))


#: Files of a chunk, about, and chunks that run at a time: while the last tasks of one end and the next is planned, cores would wait.
CHUNK_FILES, IN_FLIGHT = 100_000, 2
_EXTRACTED = ("files", "texts", "clip_embeddings", "faces")


class Staged:
    """Chunks of extracted rows beside the catalogue, each a folder of tables that counts once it holds ``_DONE``."""

    def __init__(self, catalog: Catalog) -> None:
        self.catalog, self.base = catalog, f"{catalog.base}/staged"
        self.fs, self.path = catalog._fs()

    def chunks(self) -> list[str]:
        """Chunks that are whole, by name; others are deleted, they were being written when their run died."""
        if not self.fs.exists(self.path(self.base)):
            return []
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(self.base)))
        whole = [n for n in names if self.fs.exists(self.path(f"{self.base}/{n}/_DONE"))]
        for n in set(names) - set(whole):
            self.fs.delete(self.path(f"{self.base}/{n}"), True)
        return whole

    def add(self, name: str, tables: dict[str, DataFrame]) -> dict[str, int]:
        """Stores a chunk; files and errors in it, counted as they are written.  Of extracted rows nothing else is stored, so that a chunk is one
        pass and one table."""
        main, made = "raw" if "raw" in tables else "files", Observation()
        counts = F.count(F.lit(1)).alias("files"), F.count(file_error() if main == "raw" else F.col("error")).alias("errors")
        tables = {**tables, main: tables[main].observe(made, *counts)}
        write = lambda table: tables[table].write.mode("overwrite").parquet(f"{self.base}/{name}/{table}")
        with ThreadPoolExecutor(len(tables)) as pool:  # small jobs, side by side, under the tag of this thread
            list(pool.map(inheritable_thread_target(self.catalog.spark)(write), tables))
        self.fs.create(self.path(f"{self.base}/{name}/_DONE")).close()
        return dict(made.get)

    def read(self, names: list[str]) -> dict[str, DataFrame]:
        held = {t: [f"{self.base}/{n}/{t}" for n in names if self.fs.exists(self.path(f"{self.base}/{n}/{t}"))] for t in ("raw", *_EXTRACTED, "thumbs")}
        raw = held.pop("raw")
        out = {t: self.catalog.spark.read.parquet(*paths) for t, paths in held.items() if paths}
        if raw:
            made = tables_of(self.catalog.spark.read.schema(ROWS).parquet(*raw))  # thumbnails that were not asked for are null
            out |= {t: out[t].unionByName(made[t], allowMissingColumns=True) if t in out else made[t] for t in held}
        return out

    def drop(self, names: list[str]) -> None:
        for n in names:
            self.fs.delete(self.path(f"{self.base}/{n}"), True)


def merge_staged(catalog: Catalog, root: str, thumbs: str | None = None) -> int:
    """Saves all staged chunks in one version, with their names in meta, and deletes them; how many there were.

    A chunk whose name is in meta was saved by a run that died before it could delete it.  Thumbnails, if a folder is given,
    are ``<file id>.jpg`` there, written before the version: their files are replaced, so a repetition does no harm."""
    staged, version = Staged(catalog), catalog.version()
    names = staged.chunks()
    saved = set((get_meta(catalog.read("meta"), "saved_chunks") or "").split(","))
    fresh = [n for n in names if n not in saved]
    if fresh:
        out = staged.read(fresh)
        files = cdc.save_results(catalog.read("files"), out["files"])
        changed = {"files": files}
        if "texts" in out:
            changed["texts"] = cdc.save_texts(catalog.read("texts"), out["texts"])
        if "clip_embeddings" in out:
            changed["clip_embeddings"] = cdc.save_vectors(catalog.read("clip_embeddings"), out["clip_embeddings"])
        if "faces" in out:
            done = out["files"].where("error IS NULL AND array_contains(ran, 'faces')").join(files.select("id", "rel_path"), "rel_path").select(F.col("id").alias("file_id"))
            faces = catalog.read("faces")
            merged = cdc.merge_faces(faces.join(done, "file_id", "left_semi"), out["faces"])
            rest = faces.join(done, "file_id", "left_anti")
            changed["faces"] = rest.unionByName(assign_ids(merged, faces, "file_id"), allowMissingColumns=True)
        if thumbs and "thumbs" in out:
            save_pictures(out["thumbs"].select(F.format_string("%d.jpg", "file_id").alias("name"), F.col("thumb").alias("content")), thumbs, root)
        row = catalog.spark.createDataFrame([("saved_chunks", ",".join(fresh))], TABLES["meta"])
        catalog.publish({**changed, "meta": upsert(catalog.read("meta"), row, ["key"])}, version)
    staged.drop(names)
    return len(fresh)


def _in_flight(begun: Callable[[ThreadPoolExecutor], Iterator[Future]], most: int = IN_FLIGHT) -> Iterator[dict[str, int]]:
    """What the tasks of ``begun`` give, in order; the next one begins when fewer than ``most`` are under way.  If one fails, those under
    way are still waited for."""
    with ThreadPoolExecutor(most) as pool:
        running: deque[Future] = deque()
        for task in begun(pool):
            running.append(task)
            if len(running) == most:
                yield running.popleft().result()
        while running:
            yield running.popleft().result()


def index_tag(catalog: Catalog) -> str:
    """The tag of the jobs of an index run: ``spark.sparkContext.cancelJobsWithTag(index_tag(catalog))`` stops the one that is running."""
    return f"index-{catalog.base.rsplit('root_id=', 1)[-1]}"


def run_index(
    spark: SparkSession, root: str, catalog: Catalog, extract: Extractor, places: DataFrame | None = None, settings: people.Settings | None = None,
    only: list[str] | None = None, force: bool = False, retry_errors: bool = False, cancelled: Callable[[], bool] = lambda: False,
    chunk_files: int = CHUNK_FILES, progress: Callable[[dict[str, int]], None] = lambda state: None, thumbs: str | None = None,
) -> dict[str, int]:
    """Brings the catalogue up to date with the folder; counts of changes and of files processed, and errors.

    ``cancelled`` is asked before each chunk; ``progress`` gets the files done so far, all of them and the errors after each.  What an earlier
    run has left staged is saved first, before the scan can find that its files have changed since."""
    if only is not None and cdc.unknown_stages(only):
        raise ValueError(f"unknown stages: {', '.join(cdc.unknown_stages(only))}")
    tag = index_tag(catalog)
    spark.sparkContext.addJobTag(tag)
    try:
        return _run_index(spark, root, catalog, extract, places, settings, only, force, retry_errors, cancelled, chunk_files, progress, thumbs)
    finally:
        spark.sparkContext.removeJobTag(tag)


def _run_index(spark, root, catalog, extract, places, settings, only, force, retry_errors, cancelled, chunk_files, progress, thumbs) -> dict[str, int]:
    counts = {"resumed": merge_staged(catalog, root, thumbs)}
    seen = kept(listed(spark, root))  # the folder is listed once
    counts |= {r["change"]: r["n"] for r in cdc.scan_stats(cdc.changes(catalog.read("files"), seen)).collect()}
    scan(catalog, seen, force, retry_errors)
    drop_kept(seen)
    due = cdc.work_list(catalog.read("files"), only)
    total, staged = due.count(), Staged(catalog)
    counts["processed"] = done = errors = 0
    chunks, run, many = max(1, -(-total // chunk_files)), uuid.uuid4().hex, spark.sparkContext.defaultParallelism
    # in ranges of the chunk: each chunk reads its own rows, not the whole list
    work = kept(due.withColumn("_chunk", F.pmod(F.xxhash64("id"), F.lit(chunks))), "_chunk")

    def begun(pool: ThreadPoolExecutor) -> Iterator[Future]:
        """The chunks, each as it is given to the pool; whether to go on is asked before each."""
        for k in range(chunks if total else 0):
            if cancelled():
                break
            found = extract(work.where(F.col("_chunk") == k).drop("_chunk").repartition(many))
            if "raw" in found:
                found = {"raw": found["raw"] if thumbs else found["raw"].drop("thumb")}
            tables = {name: df for name, df in found.items() if name in ("raw", *_EXTRACTED, *(["thumbs"] if thumbs else []))}
            yield pool.submit(inheritable_thread_target(spark)(staged.add), f"{run}-{k:06d}", tables)

    for made in _in_flight(begun):
        done, errors = done + made["files"], errors + made["errors"]
        progress({"done": done, "total": total, "errors": errors})
    drop_kept(work)
    counts["processed"] = done
    merge_staged(catalog, root, thumbs)
    if places is not None and not cancelled():
        files = cdc.resolve_places(catalog.read("files"), places)
        labels = fts.place_texts(files)
        catalog.publish({"files": files, "texts": catalog.read("texts").where("page <> 0").unionByName(labels)})
    sync_index(catalog)
    sync_vectors(catalog)
    settings = settings or people.load_settings(catalog.read("meta"))
    if catalog.read("faces").where("person_id IS NULL").limit(1).count() and not cancelled() and (only is None or "faces" in only):
        faces, everyone, _ = people.group_faces(catalog.read("faces"), catalog.read("files"), catalog.read("people"), catalog.read("face_negatives"), settings)
        catalog.publish({"faces": faces, "people": everyone})
    meta = spark.createDataFrame([("root_path", root), ("last_index_processed", str(counts["processed"]))], "key string, value string")
    catalog.publish({"meta": upsert(catalog.read("meta"), meta, ["key"])})
    sync_listing(catalog)
    counts["errors"] = catalog.read("files").where("status = 'error'").count()
    return counts
