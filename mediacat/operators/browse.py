"""Counts, roll-ups and listings for browsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import day_key, month_key, nocase

NOT_SUGGESTED = "assign_source <> 'suggested'"


def month_counts(files: DataFrame) -> DataFrame:
    """month (null: undated), n; newest first, undated last."""
    return files.groupBy(month_key(F.col("taken_at")).alias("month")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc_nulls_last("month"))


def place_counts(files: DataFrame) -> DataFrame:
    """country, state, city, n of located files."""
    located = files.where("city IS NOT NULL AND city <> ''")
    return located.groupBy("country", "state", "city").agg(F.count(F.lit(1)).alias("n")).orderBy("country", "state", "city")


def date_tree(files: DataFrame) -> DataFrame:
    """Roll-up year > month with level 0 (all dated), 1 (year), 2 (month), and one level -1 row of undated files."""
    dated = files.where("taken_at IS NOT NULL").select(F.substring("taken_at", 1, 4).alias("year"), month_key(F.col("taken_at")).alias("month"))
    tree = dated.rollup("year", "month").agg((F.lit(2) - F.grouping("year") - F.grouping("month")).cast("int").alias("level"), F.count(F.lit(1)).alias("n"))
    undated = files.where("taken_at IS NULL").agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("year"), F.lit(None).cast("string").alias("month"), F.lit(-1).alias("level"), "n")
    return tree.select("year", "month", "level", "n").unionByName(undated)


def place_tree(files: DataFrame) -> DataFrame:
    """Roll-up country > state > city with level 1..3; each level biggest first, ties by name."""
    located = files.where("city IS NOT NULL AND city <> ''")
    level = (F.lit(3) - F.grouping("country") - F.grouping("state") - F.grouping("city")).cast("int")
    tree = located.rollup("country", "state", "city").agg(level.alias("level"), F.count(F.lit(1)).alias("n"))
    return tree.where("level > 0").orderBy("level", F.desc("n"), "country", "state", "city")


def people_overview(people: DataFrame, faces: DataFrame) -> DataFrame:
    """People who have faces: id, name, hidden, faces and files that count (not suggested), cover (their first face if unset or gone)."""
    sums = faces.where("person_id IS NOT NULL").groupBy("person_id").agg(
        F.sum(F.when(F.expr(NOT_SUGGESTED), 1).otherwise(0)).alias("faces"),
        F.count_distinct(F.when(F.expr(NOT_SUGGESTED), F.col("file_id"))).alias("files"),
        F.min("id").alias("first_face"),
    )
    covers = faces.select(F.col("id").alias("cover_face_id"), F.lit(True).alias("there"))
    joined = people.join(sums, people["id"] == sums["person_id"]).join(covers, "cover_face_id", "left")
    return joined.select("id", "name", "hidden", "faces", "files", F.when(F.col("there"), F.col("cover_face_id")).otherwise(F.col("first_face")).alias("cover"))


def people_report(people: DataFrame, faces: DataFrame) -> DataFrame:
    """All people, with or without faces: id, name, faces, suggested; most faces first."""
    sums = faces.where("person_id IS NOT NULL").groupBy("person_id").agg(
        F.count_if(F.expr(NOT_SUGGESTED)).alias("faces"), F.count_if(F.col("assign_source") == "suggested").alias("suggested")
    )
    out = people.join(sums, people["id"] == sums["person_id"], "left").select("id", "name", F.coalesce("faces", F.lit(0)).alias("faces"), F.coalesce("suggested", F.lit(0)).alias("suggested"))
    return out.orderBy(F.desc("faces"), "id")


def people_order(overview: DataFrame) -> DataFrame:
    """Named people first, by name without ASCII case, then the most files."""
    return overview.orderBy(F.col("name").isNull(), nocase(F.col("name")), F.desc("faces"), "id")


def filter_people(overview: DataFrame, text: str = "", hidden: bool = False) -> DataFrame:
    label = F.lower(F.coalesce("name", F.concat(F.lit("person #"), F.col("id").cast("string"))))
    return overview.where((F.lit(hidden) | ~F.col("hidden")) & F.contains(label, F.lit(text.lower())))


def people_in_files(faces: DataFrame, people: DataFrame) -> DataFrame:
    """file_id, person_id, name, ai (all faces assigned automatically), score of named people in each file."""
    named = faces.where(NOT_SUGGESTED).join(people.where("name IS NOT NULL").select(F.col("id").alias("person_id"), "name"), "person_id")
    return named.groupBy("file_id", "person_id", "name").agg(F.bool_and(F.col("assign_source") == "auto").alias("ai"), F.max("assign_score").alias("score"))


def faces_of_file(faces: DataFrame, people: DataFrame, file_id: int) -> DataFrame:
    """Boxes of one file with optional names, and whether each has a signature."""
    from ..functions.vectors import has_signature

    names = people.select(F.col("id").alias("person_id"), "name")
    return faces.where(F.col("file_id") == file_id).join(names, "person_id", "left").select(
        "id", "bbox", "person_id", "name", F.col("assign_source").alias("source"), F.col("assign_score").alias("score"), "manual", has_signature(F.col("embedding")).alias("signature")
    )


def ai_only(items: DataFrame) -> DataFrame:
    return items.where(F.col("source") == "auto")


def dashboard(files: DataFrame, people: DataFrame, faces: DataFrame) -> DataFrame:
    """One row of counters; each table is read once, and one-row sums are put side by side."""
    a = faces.agg(
        F.count(F.lit(1)).alias("faces"), F.count_if(F.col("assign_source") == "suggested").alias("suggested"),
        F.count_if(F.col("person_id").isNull()).alias("unassigned"),
    )
    b = people.agg(F.count(F.lit(1)).alias("people"), F.count("name").alias("named"))
    c = files.agg(F.count_if(F.col("kind") != "other").alias("files"), F.count_if(F.col("status") == "error").alias("errors"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))


def histograms(files: DataFrame, columns: tuple[str, ...] = ("kind", "status", "date_source")) -> DataFrame:
    """what, value (none for null), n; most first, in one pass over the files."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.coalesce(F.col(c), F.lit("none")).alias("value")) for c in columns]))
    return files.select(pairs.alias("p")).groupBy("p.what", "p.value").agg(F.count(F.lit(1)).alias("n")).orderBy("what", F.desc("n"), "value")


def first_errors(files: DataFrame, limit: int = 20) -> DataFrame:
    return files.where("status = 'error'").select("rel_path", "error").orderBy("rel_path").limit(limit)


def suggestions(faces: DataFrame, people: DataFrame, limit: int = 200) -> DataFrame:
    """Suggested faces, best first, with the cover (smallest face id) of their person."""
    covers = faces.where(NOT_SUGGESTED).groupBy("person_id").agg(F.min("id").alias("cover"))
    names = people.select(F.col("id").alias("person_id"), "name")
    out = faces.where("assign_source = 'suggested'").join(names, "person_id").join(covers, "person_id", "left")
    return out.select("id", "file_id", "person_id", "name", F.col("assign_score").alias("score"), "cover").orderBy(F.desc("score"), "id").limit(limit)


def unassigned(faces: DataFrame, files: DataFrame, limit: int = 500, offset: int = 0) -> DataFrame:
    """Faces without a person in live files that are no stickers, the surest first."""
    live = files.where("NOT is_sticker AND status <> 'missing'").select(F.col("id").alias("file_id"), "rel_path")
    out = faces.where("person_id IS NULL").join(live, "file_id").select("id", "file_id", "rel_path", "det_score")
    return out.orderBy(F.desc("det_score"), "id").offset(offset).limit(min(limit, 500))


def faces_of_person(faces: DataFrame, person: int) -> DataFrame:
    """The person's faces: suggested ones last, then those without a score, the least sure first."""
    mine = faces.where(F.col("person_id") == person)
    return mine.select("id", "file_id", "assign_source", "assign_score").orderBy(F.coalesce(F.col("assign_source") == "suggested", F.lit(False)), F.col("assign_score").isNull(), "assign_score", "id")


def text_pages(texts: DataFrame) -> DataFrame:
    return texts.where("page >= 1").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("file_id").alias("files"))


def files_on_day(files: DataFrame, day: str) -> DataFrame:
    return files.where(day_key(F.col("taken_at")) == day)
