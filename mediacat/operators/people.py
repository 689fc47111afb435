"""Face assignment, grouping and the user's corrections, as functions from tables to tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import upsert
from ..functions.text import nocase, person_name, person_reference
from ..functions.vectors import has_signature
from ..storage import kept
from .cluster import dbscan, group_maxima, top_labels


#: Numbers in a face's signature.
EMBEDDING = 128


#: Least and greatest value of each setting.
RANGES = {"auto": (0.3, 0.99), "suggest": (0.2, 0.99), "eps": (0.05, 0.7), "min_samples": (2, 50)}


def settings_valid(auto: Column, suggest: Column, eps: Column, min_samples: Column) -> Column:
    """Whether a row of settings may be used; a missing one may not."""
    out = suggest <= auto
    for c, (low, high) in zip((auto, suggest, eps, min_samples), RANGES.values()):
        out = out & c.between(low, high)
    return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class Settings:
    auto: float = 0.7
    suggest: float = 0.6
    eps: float = 0.3
    min_samples: int = 3

    def checked(self) -> Settings:
        """Itself, or ValueError: no setting of an invalid set is used."""
        for name, (low, high) in RANGES.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie between {low} and {high}")
        if self.suggest > self.auto:
            raise ValueError("suggest must not exceed auto")
        return self


#: The keys of meta that hold a folder's settings.
META_KEYS = {"auto": "faces_t_auto", "suggest": "faces_t_suggest", "eps": "faces_eps"}


def effective_settings(meta: DataFrame, defaults: DataFrame) -> DataFrame:
    """defaults: key, value.  The defaults with what meta overrides under the key's entry of ``META_KEYS``.

    Of meta only the rows of those entries are joined, a handful; keys without an entry would else meet in one task."""
    keys = F.create_map(*[F.lit(x) for pair in META_KEYS.items() for x in pair])
    own = meta.where(F.col("key").isin(list(META_KEYS.values()))).select(F.col("key").alias("_key"), F.col("value").cast("string").alias("own"))
    return defaults.join(F.broadcast(own), F.col("_key") == keys[F.col("key")], "left").select("key", F.coalesce("own", "value").alias("value"))


def load_settings(meta: DataFrame) -> Settings:
    """The settings saved for the folder, defaults where there are none."""
    saved = {r["key"]: r["value"] for r in meta.where(F.col("key").isin(list(META_KEYS.values()))).collect()}
    return Settings(**{name: float(saved[key]) for name, key in META_KEYS.items() if key in saved})


def save_settings(meta: DataFrame, s: Settings) -> DataFrame:
    """meta with the settings; ValueError, and nothing saved, if one of them is out of range."""
    s = s.checked()
    rows = meta.sparkSession.createDataFrame([(key, repr(float(getattr(s, name)))) for name, key in META_KEYS.items()], "key string, value string")
    return upsert(meta, rows, ["key"])


def reset_settings(meta: DataFrame) -> DataFrame:
    return meta.where(~F.col("key").isin(list(META_KEYS.values())))


def detections(found: DataFrame, least: float = 0.8, side: int = 40) -> DataFrame:
    return found.where((F.col("det_score") >= least) & (F.least("bbox.w", "bbox.h") >= side))


def closest_detection(found: DataFrame, box: Column) -> DataFrame:
    """For each file the detection whose centre is nearest the box's, by squared distance."""
    dx = F.col("bbox.x") + F.col("bbox.w") / 2 - (box["x"] + box["w"] / 2)
    dy = F.col("bbox.y") + F.col("bbox.h") / 2 - (box["y"] + box["h"] / 2)
    return found.groupBy("file_id").agg(F.min_by(F.struct("id", "bbox"), F.struct(dx * dx + dy * dy, F.col("id"))).alias("d")).select("file_id", "d.*")


def valid_box(box: Column, width: Column, height: Column) -> Column:
    return (box["w"] >= 8) & (box["h"] >= 8) & (box["x"] >= 0) & (box["y"] >= 0) & (box["x"] + box["w"] <= width) & (box["y"] + box["h"] <= height)


def assignable(faces: DataFrame, files: DataFrame) -> DataFrame:
    """Faces without a person in live files that are no stickers."""
    live = files.where("NOT is_sticker AND status <> 'missing'").select(F.col("id").alias("file_id"))
    return faces.where("person_id IS NULL").join(live, "file_id", "left_semi").where(has_signature(F.col("embedding")))


def references(faces: DataFrame) -> DataFrame:
    """Faces that speak for their person: clustered or confirmed ones, whatever became of the file."""
    return faces.where("person_id IS NOT NULL AND assign_source IN ('cluster', 'user')")


def person_scores(candidates: DataFrame, refs: DataFrame) -> DataFrame:
    """face_id, person_id, score: the largest similarity to a reference face of the person (-1 if none is above)."""
    best = group_maxima(
        candidates.select(F.col("id").alias("i"), F.col("embedding").alias("v")), refs.select(F.col("id").alias("i"), F.col("embedding").alias("v"), F.col("person_id").alias("label"))
    )
    return best.select(F.col("i").alias("face_id"), F.col("label").alias("person_id"), F.greatest("score", F.lit(-1.0)).alias("score"))


def best_people(candidates: DataFrame, refs: DataFrame, negatives: DataFrame | None = None, keep: int = 1) -> DataFrame:
    """face_id, person_id, score, rank: the ``keep`` best people of each face, ties to the lowest id; vetoed pairs score -1.

    Unlike ``person_scores`` this makes ``keep`` rows a face, however many people there are: each face brings its vetoes along."""
    points = candidates.select(F.col("id").alias("i"), F.col("embedding").alias("v"))
    if negatives is not None:
        barred = negatives.groupBy(F.col("face_id").alias("i")).agg(F.collect_set("person_id").alias("barred"))
        points = points.join(barred, "i", "left")
    best = top_labels(points, refs.select(F.col("id").alias("i"), F.col("embedding").alias("v"), F.col("person_id").alias("label")), keep)
    return best.select(F.col("i").alias("face_id"), F.col("label").alias("person_id"), "score", "rank")


def decided(best: DataFrame, people: DataFrame, s: Settings) -> DataFrame:
    """face_id, person_id, score, decision of each face's best person; whether they have a name is asked afterwards."""
    named = people.select(F.col("id").alias("person_id"), F.col("name").isNotNull().alias("named"))
    decision = F.when(F.col("score") >= s.auto, "auto").when((F.col("score") >= s.suggest) & F.col("named"), "suggested").otherwise("orphan")
    return best.join(named, "person_id", "left").select("face_id", "person_id", "score", decision.alias("decision"))


def group_faces(faces: DataFrame, files: DataFrame, people: DataFrame, negatives: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(faces, people, stats) after assigning what can be and clustering the rest into new unnamed people."""
    s = s.checked()
    free = assignable(faces, files)
    made = kept(decided(best_people(free, references(faces), negatives), people, s))  # read three times below
    orphans = free.select(F.col("id").alias("i"), F.col("embedding").alias("v")).join(made.where("decision <> 'orphan'").select(F.col("face_id").alias("i")), "i", "left_anti")
    labels = dbscan(orphans, s.eps, s.min_samples).where("label >= 0")
    top = people.agg(F.max("id")).first()[0] or 0
    grouped = kept(labels.select(F.col("i").alias("id"), (F.col("label") + top + 1).cast("long").alias("new_person")))  # faces and people are made of it
    taken = made.where("decision <> 'orphan'").select(F.col("face_id").alias("id"), F.col("person_id").alias("found"), F.col("score").alias("found_score"), "decision")
    out = faces.join(taken, "id", "left").join(grouped, "id", "left").select(
        *[F.col(c) for c in faces.columns if c not in ("person_id", "assign_source", "assign_score")],
        F.coalesce("person_id", "found", "new_person").alias("person_id"),
        F.when(F.col("found").isNotNull(), F.col("decision")).when(F.col("new_person").isNotNull(), "cluster").otherwise(F.col("assign_source")).alias("assign_source"),
        F.when(F.col("found").isNotNull(), F.col("found_score")).otherwise(F.col("assign_score")).alias("assign_score"),
    )
    fresh = grouped.groupBy(F.col("new_person").alias("id")).agg(F.min("id").alias("cover_face_id")).select("id", F.lit(None).cast("string").alias("name"), F.lit(False).alias("hidden"), "cover_face_id")
    stats = made.groupBy(F.col("decision").alias("what")).agg(F.count(F.lit(1)).alias("n")).where("what <> 'orphan'").union(grouped.agg(F.lit("clustered"), F.count(F.lit(1)))).union(fresh.agg(F.lit("people"), F.count(F.lit(1))))
    return out, people.unionByName(fresh), stats


def _unassign(faces: DataFrame, when: Column) -> DataFrame:
    return faces.withColumns({c: F.when(~F.coalesce(when, F.lit(False)), F.col(c)) for c in ("person_id", "assign_source", "assign_score")})


def without_empty(people: DataFrame, faces: DataFrame) -> DataFrame:
    """People but for unnamed ones that no face belongs to."""
    used = faces.where("person_id IS NOT NULL").select(F.col("person_id").alias("id"), F.lit(True).alias("used")).distinct()
    return people.join(used, "id", "left").where("name IS NOT NULL OR used").drop("used")


def reset_groups(faces: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Un-assigns all but the user's faces of unnamed people, and automatic and suggested ones of everyone."""
    named = people.select(F.col("id").alias("person_id"), F.col("name").isNotNull().alias("_named"))
    joined = faces.join(named, "person_id", "left")
    off = F.col("assign_source").isin("auto", "suggested") | (~F.col("_named") & (F.col("assign_source") != "user"))
    out = _unassign(joined, off).select(*faces.columns)
    return out, without_empty(people, out)


def rename_person(people: DataFrame, person: int, name: str | None = None, hidden: bool | None = None) -> DataFrame:
    own = F.col("id") == person
    out = people if name is None else people.withColumn("name", F.when(own, person_name(F.lit(name))).otherwise(F.col("name")))
    return out if hidden is None else out.withColumn("hidden", F.when(own, F.lit(hidden)).otherwise(F.col("hidden")))


def merge_people(faces: DataFrame, people: DataFrame, negatives: DataFrame, keep: int, gone: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Moves faces and vetoes of ``gone`` to ``keep``; vetoes against its own members go, and so does ``gone``."""
    if keep == gone:
        raise ValueError("a person cannot be merged with themselves")
    move = lambda df: df.withColumn("person_id", F.when(F.col("person_id") == gone, F.lit(keep)).otherwise(F.col("person_id")))
    out = move(faces)
    own = out.where(F.col("person_id") == keep).select(F.col("id").alias("face_id"), "person_id")
    vetoes = move(negatives).dropDuplicates(["face_id", "person_id"]).join(own, ["face_id", "person_id"], "left_anti")
    return out, people.where(F.col("id") != gone), vetoes


def person_for_name(people: DataFrame, name: str) -> tuple[int, DataFrame]:
    """(id, people): the person of that name without ASCII case, or a new one."""
    found = people.where(nocase(F.col("name")) == nocase(F.lit(name.strip()))).agg(F.min("id")).first()[0]
    if found is not None:
        return found, people
    new = (people.agg(F.max("id")).first()[0] or 0) + 1
    row = people.sparkSession.createDataFrame([(new, name.strip(), False, None)], people.schema)
    return new, people.unionByName(row)


def person_from_reference(people: DataFrame, text: str) -> tuple[int | None, DataFrame]:
    """(id, people) for ``#12`` or ``12``, which must exist, or a name, which is made where nobody has it; (None, people) if blank or
    unknown."""
    kind, value = person_reference(text)
    if kind == "name":
        return person_for_name(people, value)
    if kind == "id" and people.where(F.col("id") == value).limit(1).count():
        return value, people
    return None, people


def resolve_references(people: DataFrame, given: DataFrame) -> DataFrame:
    """given: given (text), more.  Adds id, of the person meant, and made: whether the text is a name that nobody has, for which a person is
    to be made.  ``#12`` and ``12`` mean an id that must exist; names are compared without ASCII case, and the lowest id wins."""
    text = F.btrim("given")
    number = F.regexp_extract(text, r"^#?([0-9]{1,18})$", 1)
    asked = given.withColumns({"_id": F.when(number != "", number.cast("long")), "_name": F.when((number == "") & (text != ""), nocase(text))})
    ids = people.select(F.col("id").alias("_id"), F.lit(True).alias("_there"))
    names = people.where("name IS NOT NULL").groupBy(nocase(F.col("name")).alias("_name")).agg(F.min("id").alias("_named"))
    out = asked.join(ids, "_id", "left").join(names, "_name", "left")
    found = F.coalesce(F.when(F.col("_there"), F.col("_id")), F.col("_named"))
    return out.select(*given.columns, found.alias("id"), (F.col("_name").isNotNull() & F.col("_named").isNull()).alias("made"))


def assign_face(faces: DataFrame, negatives: DataFrame, face: int, person: int) -> tuple[DataFrame, DataFrame]:
    """The user says whose face it is; a veto against it goes."""
    own = F.col("id") == face
    out = faces.withColumns({
        "person_id": F.when(own, F.lit(person)).otherwise(F.col("person_id")),
        "assign_source": F.when(own, "user").otherwise(F.col("assign_source")),
        "assign_score": F.when(~own, F.col("assign_score")),
    })
    return out, negatives.where(~((F.col("face_id") == face) & (F.col("person_id") == person)))


def remove_face(faces: DataFrame, people: DataFrame, negatives: DataFrame, face: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The user says the face is not that person's: a veto, no person, and another cover if it was theirs."""
    veto = faces.where((F.col("id") == face) & F.col("person_id").isNotNull()).select(F.col("id").alias("face_id"), "person_id")
    out = _unassign(faces, F.col("id") == face)
    first = out.where("person_id IS NOT NULL").groupBy(F.col("person_id").alias("id")).agg(F.min("id").alias("_first"))
    cover = F.when(F.col("cover_face_id") == face, F.col("_first")).otherwise(F.col("cover_face_id"))
    return out, people.join(first, "id", "left").withColumn("cover_face_id", cover).drop("_first"), negatives.unionByName(veto).dropDuplicates(["face_id", "person_id"])


def add_manual_face(faces: DataFrame, row: dict) -> DataFrame:
    """row: file_id, bbox, person_id, and det_score and embedding if a face was found in the box: without them the score is 0 and
    the signature the zero vector, which is like nothing."""
    new = (faces.agg(F.max("id")).first()[0] or 0) + 1
    values = {"id": new, "det_score": 0.0, "embedding": [0.0] * EMBEDDING, "assign_source": "user", "assign_score": None, "manual": True, **row}
    return faces.unionByName(faces.sparkSession.createDataFrame([tuple(values.get(c) for c in faces.columns)], faces.schema))


def delete_manual_face(faces: DataFrame, face: int) -> DataFrame:
    return faces.where(~((F.col("id") == face) & F.col("manual")))


def top_two(scores: DataFrame) -> DataFrame:
    """face_id, best, second (-1 if there is none) over people."""
    w = Window.partitionBy("face_id").orderBy(F.desc("score"), "person_id")
    firsts = scores.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("face_id")
    return firsts.agg(F.max(F.when(F.col("r") == 1, F.col("score"))).alias("best"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))), F.lit(-1.0)).alias("second"))


def impostor_scores(points: DataFrame) -> DataFrame:
    """points: i, v, label.  The best similarity of each to a point of another label."""
    return group_maxima(points, points, others=True).groupBy("i").agg(F.max("score").alias("score"))


def sweep(values: DataFrame, column: str, thresholds: list[float]) -> DataFrame:
    """Share of rows at or above each threshold, in one pass."""
    sums = values.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(column) >= t).alias(f"c{k}") for k, t in enumerate(thresholds)])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col(f"c{k}") / F.greatest("n", F.lit(1))).alias("share")) for k, t in enumerate(thresholds)]))
    return sums.select(rows.alias("r")).select("r.*")


def adjusted_rand(pairs: DataFrame) -> DataFrame:
    """pairs: a, b (two labellings).  One row: n, ari."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    s = cells.agg(F.sum(two("c")).alias("both"), F.sum("c").alias("n"))
    a = cells.groupBy("a").agg(F.sum("c").alias("c")).agg(F.sum(two("c")).alias("rows"))
    b = cells.groupBy("b").agg(F.sum("c").alias("c")).agg(F.sum(two("c")).alias("cols"))
    every = F.col("n") * (F.col("n") - 1) / 2
    chance = F.try_divide(F.col("rows") * F.col("cols"), every)
    ari = F.coalesce(F.try_divide(F.col("both") - chance, (F.col("rows") + F.col("cols")) / 2 - chance), F.lit(1.0))
    return s.join(F.broadcast(a)).join(F.broadcast(b)).select(F.col("n").cast("long").alias("n"), ari.alias("ari"))


def stage_rates(runs: DataFrame) -> DataFrame:
    """runs: seconds map<string, double>.  stage, seconds, ms an item, items a second."""
    each = runs.select(F.explode("seconds").alias("stage", "s"))
    return each.groupBy("stage").agg(F.sum("s").alias("seconds"), (F.avg("s") * 1000).alias("ms_per_item"), (F.count(F.lit(1)) / F.sum("s")).alias("items_per_second"))
