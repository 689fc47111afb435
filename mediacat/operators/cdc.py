"""Change capture between a folder and the catalogue, work lists and saving of extraction results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import upsert
from ..functions.geo import nearest_place
from ..functions.vectors import iou
from ..sources.listing import in_hidden_folder

#: Stages of each kind in order; the cheap ones that always run; those that stickers skip; those on request.
KIND_STAGES = {"image": ["date", "gps", "thumb", "faces", "clip", "ocr"], "pdf": ["date", "thumb", "text", "ocr"], "docx": ["date", "text"]}
BASE_STAGES = ["date", "gps", "thumb", "text"]
STICKER_SKIPS = ["faces", "ocr"]
HEAVY_STAGES = ["faces", "clip", "ocr"]
IDENTICAL = ("size", "mtime", "kind")


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def required_stages(kind: Column, sticker: Column, only: list[str] | None = None) -> Column:
    """The stages a file needs; heavy ones only if asked for, none of some kinds for stickers."""
    stages = F.coalesce(*[F.when(kind == k, _strings(v)) for k, v in KIND_STAGES.items()], _strings([]))
    if only is not None:
        stages = F.filter(stages, lambda s: s.isin(BASE_STAGES + list(only)))
    return F.when(sticker, F.array_except(stages, _strings(STICKER_SKIPS))).otherwise(stages)


def unknown_stages(given: list[str]) -> list[str]:
    return sorted(set(given) - set(HEAVY_STAGES))


def unknown(given: Column) -> Column:
    """The same for an array of names."""
    return F.array_sort(F.array_except(given, _strings(HEAVY_STAGES)))


def changes(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Full outer difference of catalogue and folder on rel_path, with change: new, changed, reappeared, unchanged, purged
    (now in a hidden folder), gone or missing (already known to be)."""
    k = known.select("rel_path", *[F.col(c).alias(f"old_{c}") for c in IDENTICAL], F.col("status").alias("old_status"), F.lit(True).alias("is_known"))
    s = seen.select("rel_path", *[F.col(c).alias(f"new_{c}") for c in IDENTICAL], F.lit(True).alias("is_seen"))
    both = k.join(s, "rel_path", "full_outer")
    differs = F.coalesce((F.col("old_size") != F.col("new_size")) | (F.col("old_mtime") != F.col("new_mtime")) | (F.col("old_kind") != F.col("new_kind")), F.lit(True))
    change = (
        F.when(F.col("is_known").isNull(), "new")
        .when(F.col("is_seen").isNull() & in_hidden_folder(F.col("rel_path")), "purged")
        .when(F.col("is_seen").isNull() & (F.col("old_status") == "missing"), "missing")
        .when(F.col("is_seen").isNull(), "gone")
        .when(differs, "changed")
        .when(F.col("old_status") == "missing", "reappeared")
        .otherwise("unchanged")
    )
    return both.withColumn("change", change)


def pending_changes(known: DataFrame, seen: DataFrame) -> DataFrame:
    """rel_path, size, mtime of new and altered files, and (path, -1, 0) of gone ones; changes nothing, ignores kinds."""
    both = known.select("rel_path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), "status").join(
        seen.select("rel_path", F.col("size").alias("new_size"), F.col("mtime").alias("new_mtime")), "rel_path", "full_outer"
    )
    there = F.col("new_size").isNotNull()
    altered = there & F.coalesce((F.col("old_size") != F.col("new_size")) | (F.col("old_mtime") != F.col("new_mtime")) | (F.col("status") == "missing"), F.lit(True))
    gone = ~there & (F.col("status") != "missing")
    return both.where(altered | gone).select("rel_path", F.coalesce("new_size", F.lit(-1)).cast("long").alias("size"), F.coalesce("new_mtime", F.lit(0.0)).alias("mtime"))


def apply_scan(known: DataFrame, seen: DataFrame, force: bool = False, retry_errors: bool = False) -> DataFrame:
    """The catalogue after a scan: rel_path, kind, size, mtime, status, error, stages_done, change, forget_place; purged rows are gone.

    known: the first seven; seen: rel_path, kind, size, mtime.  A file that reappears is an error, done or pending again
    by what it had reached.  ``retry_errors`` makes files in error pending as if new, ``force`` all others that have stages, whose
    positions are forgotten too; both may be given."""
    c = changes(known, seen).where("change <> 'purged'").join(known.select("rel_path", "error", "stages_done"), "rel_path", "left")
    kind, fresh = F.coalesce("new_kind", "old_kind"), F.col("change").isin("new", "changed")
    idle = F.when(kind == "other", "done").otherwise("pending")
    back = F.when(F.col("error").isNotNull(), "error").when((F.size(F.coalesce("stages_done", F.array())) > 0) | (kind == "other"), "done").otherwise("pending")
    status = F.when(fresh, idle).when(F.col("change").isin("gone", "missing"), "missing").when(F.col("change") == "reappeared", back).otherwise(F.col("old_status"))
    out = c.select(
        "rel_path", kind.alias("kind"), F.coalesce("new_size", "old_size").alias("size"), F.coalesce("new_mtime", "old_mtime").alias("mtime"), status.alias("status"),
        F.when(~fresh, F.col("error")).alias("error"), F.when(~fresh, F.col("stages_done")).alias("stages_done"), "change",
    )
    retried = F.lit(retry_errors) & (F.col("status") == "error")
    forced = F.lit(force) & ~retried & F.col("status").isin("done", "error") & (F.col("kind") != "other")
    again = retried | forced
    return out.withColumns({
        "status": F.when(again, "pending").otherwise(F.col("status")), "error": F.when(~again, F.col("error")),
        "stages_done": F.when(~again, F.col("stages_done")), "forget_place": forced,
    })


def scan_stats(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def work_list(files: DataFrame, only: list[str] | None = None) -> DataFrame:
    """id, rel_path, kind, todo: all stages of pending files, the missing ones of done files."""
    required = required_stages(F.col("kind"), F.col("is_sticker"), only)
    have = F.when(F.col("status") == "pending", _strings([])).otherwise(F.coalesce("stages_done", _strings([])))
    todo = F.array_except(required, have)
    return files.where("status IN ('pending', 'done') AND kind <> 'other'").select("id", "rel_path", "kind", todo.alias("todo")).where(F.size("todo") > 0)


def heavy_due(todo: Column) -> Column:
    return F.array_intersect(todo, _strings(HEAVY_STAGES))


def stages_after(kind: Column, before: Column, ran: Column) -> Column:
    """The union of stages in the order of the kind."""
    order = F.coalesce(*[F.when(kind == k, _strings(v)) for k, v in KIND_STAGES.items()], _strings([]))
    have = F.array_union(F.coalesce(before, _strings([])), ran)
    return F.filter(order, lambda s: F.array_contains(have, s))


def merge_faces(old: DataFrame, new: DataFrame) -> DataFrame:
    """Faces of reprocessed files: ``new`` detections (file_id, n, bbox, det_score, embedding) take the person of the user's last
    old face they overlap by more than half; manual faces that no detection finds again stay.

    old: id, file_id, bbox, det_score, embedding, person_id, assign_source, assign_score, manual; only files of ``new`` are given."""
    meets = iou(F.col("bbox"), F.col("old_bbox")) > 0.5
    known = old.where("assign_source = 'user'").select("file_id", F.col("id").alias("old_id"), F.col("bbox").alias("old_bbox"), F.col("person_id").alias("old_person"))
    carried = new.join(known, "file_id").where(meets).groupBy("file_id", "n").agg(F.max_by("old_person", "old_id").alias("person_id"))
    fresh = new.join(carried, ["file_id", "n"], "left").select(
        "file_id", "bbox", "det_score", "embedding", "person_id", F.when(F.col("person_id").isNotNull(), "user").alias("assign_source"),
        F.lit(None).cast("double").alias("assign_score"), F.lit(False).alias("manual"),
    )
    manual = old.where("manual").withColumnRenamed("bbox", "old_bbox")
    found = manual.join(new.select("file_id", "bbox"), "file_id").where(meets).select("id").distinct()
    stay = manual.join(found, "id", "left_anti").withColumnRenamed("old_bbox", "bbox").select(*fresh.columns)
    return fresh.unionByName(stay)


#: The stage whose run sets a value, to null if it found none; other values are kept where a run has none.
VALUE_STAGE = {"hash": "date", "taken_at": "date", "date_source": "date", "lat": "gps", "lon": "gps"}


def save_results(files: DataFrame, results: DataFrame) -> DataFrame:
    """results: rel_path, error, ran (stages), and a column ``r_<name>`` for each extracted value.  Failed files keep their old
    values; a run of a stage overwrites its values, with null too; a run of gps resets the place; stages add up."""
    r = results.select("rel_path", F.col("error").alias("r_error"), F.col("ran").alias("r_ran"), *[c for c in results.columns if c.startswith("r_")])
    joined = files.join(r, "rel_path", "left")
    hit, failed = F.col("r_ran").isNotNull() | F.col("r_error").isNotNull(), F.col("r_error").isNotNull()
    ok = hit & ~failed
    ran = lambda stage: ok & F.array_contains(F.coalesce("r_ran", _strings([])), stage)
    out = {"status": F.when(failed, "error").when(ok, "done").otherwise(F.col("status")), "error": F.when(failed, F.left("r_error", F.lit(500))).when(~ok, F.col("error"))}
    out["stages_done"] = F.when(ok, stages_after(F.col("kind"), F.col("stages_done"), F.col("r_ran"))).otherwise(F.col("stages_done"))
    for c in files.columns:
        if f"r_{c}" in r.columns and c not in out:
            fresh = F.when(ran(VALUE_STAGE[c]), F.col(f"r_{c}")) if c in VALUE_STAGE else F.when(ok, F.coalesce(f"r_{c}", c))
            out[c] = fresh.when(~ran(VALUE_STAGE[c]) if c in VALUE_STAGE else ~ok, F.col(c))
    for c in ("city", "state", "country"):
        if c in files.columns:
            out[c] = F.when(~ran("gps"), F.col(c))
    return joined.withColumns(out).select(*files.columns)


def save_texts(texts: DataFrame, new: DataFrame) -> DataFrame:
    """Adds pages (file_id, page, content).  Stale ones went when the scan made their file pending, so recognised pages
    come beside a text layer that is there already."""
    return texts.unionByName(new)


def save_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(vectors, new, ["file_id"])


def cascade(dependents: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Dependent rows but for those whose parent is gone."""
    return dependents.join(parents.select(F.col("id").alias(key)), key, "left_semi")


def unresolved(files: DataFrame) -> DataFrame:
    """Files with a position that no place has been looked up for."""
    return files.where("lat IS NOT NULL AND city IS NULL")


def resolve_places(files: DataFrame, places: DataFrame) -> DataFrame:
    """Files with places filled in where a position had none; resolved to nowhere is the empty text."""
    todo = unresolved(files).select("id", "lat", "lon")
    found = nearest_place(todo, places).select("id", F.coalesce("name", F.lit("")).alias("_city"), F.coalesce("state", F.lit("")).alias("_state"), F.coalesce("country", F.lit("")).alias("_country"))
    joined = files.join(found, "id", "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in ("city", "state", "country")}).select(*files.columns)
