"""Hybrid search: structured filters, full text and vectors fused by min-max, ranked and paged."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import day_key, fold_name, fold_name_udf, fts_fold_py, person_reference, place_label, ui_fold
from ..functions.vectors import dot, literal
from . import fts, listing_index, vector_index
from .listing_index import Listing
from .vector_index import VectorIndex

CLIP_LEAST, CLIP_WEIGHT = 0.2, 0.5
KINDS = ("image", "pdf", "docx")


@dataclass(frozen=True)
class Query:
    text: str = ""
    people: tuple[int, ...] = ()
    date_from: str | None = None
    date_to: str | None = None
    kinds: tuple[str, ...] = ()
    country: str | None = None
    state: str | None = None
    city: str | None = None
    stickers: bool = False
    order: str = "relevance"
    limit: int = 20
    offset: int = 0
    after: tuple[str | None, int] | None = None  # of a listing: the key of the last row seen

    def clamped(self) -> Query:
        """Unknown kinds dropped, order defaulted, limit 1..500, offset not negative."""
        return replace(
            self, kinds=tuple(k for k in self.kinds if k in KINDS), order=self.order if self.order in ("relevance", "date") else "relevance",
            limit=min(max(self.limit, 1), 500), offset=max(self.offset, 0),
        )


def clamps(limit: Column, offset: Column, order: Column, kinds: Column) -> Column:
    """The same rules as columns, for queries that come as rows: struct(limit, offset, order, kinds)."""
    known = F.array(*map(F.lit, KINDS))
    return F.struct(
        F.least(F.greatest(limit, F.lit(1)), F.lit(500)).alias("limit"), F.greatest(offset, F.lit(0)).alias("offset"),
        F.when(order.isin("relevance", "date"), order).otherwise("relevance").alias("order"), F.filter(kinds, lambda k: F.array_contains(known, k)).alias("kinds"),
    )


@dataclass(frozen=True)
class Catalogue:
    """The tables that a search reads.  With ``index`` it reads postings instead of texts; with ``vector_index`` the cells that a vector can be in; with ``people_keys`` (id, name_key: the folded name) a
    person's name is found by equality."""

    files: DataFrame
    texts: DataFrame
    faces: DataFrame
    people: DataFrame
    clip: DataFrame
    index: fts.Index | None = None
    people_keys: DataFrame | None = None
    vector_index: VectorIndex | None = None
    listing: Listing | None = None


class Lazy:
    """The same, each table opened when it is first asked for: a search needs few of them, and opening one takes longer than reading it."""

    def __init__(self, **openers: Callable[[], DataFrame | fts.Index | None]) -> None:
        self._openers = openers

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in self._openers:
            raise AttributeError(name)
        value = self._openers[name]()
        setattr(self, name, value)
        return value


@dataclass(frozen=True)
class Results:
    hits: DataFrame
    all_hits: DataFrame  # before paging: its count is the total
    mentions: DataFrame | None = None
    person: int | None = None
    without_text: DataFrame | None = field(default=None)


def visible(q: Query) -> Column:
    """Base visibility and the query's filters as one conjunction, all of it pushable to the scan."""
    out = (F.col("status") == "done") & (F.col("kind") != "other")
    if not q.stickers:
        out = out & ~F.col("is_sticker")
    if q.kinds:
        out = out & F.col("kind").isin(*q.kinds)
    if q.date_from:
        out = out & (day_key(F.col("taken_at")) >= q.date_from)
    if q.date_to:
        out = out & (day_key(F.col("taken_at")) <= q.date_to)
    for name in ("country", "state", "city"):
        if (value := getattr(q, name)) is not None:
            out = out & (F.col(name) == value)
    return out


def candidates(c: Catalogue, q: Query) -> DataFrame:
    """The files that pass the filters and hold all the people; suggested faces, and those without a source, don't count."""
    return with_people(c, q, c.files.where(visible(q)))


def with_people(c: Catalogue, q: Query, found: DataFrame) -> DataFrame:
    people = sorted(set(q.people))
    if not people:
        return found
    # a row a file, summed up where the faces are read: a file's many faces neither come to one task nor into the join
    held = c.faces.where(F.col("person_id").isin(people) & (F.col("assign_source") != "suggested")).groupBy(F.col("file_id").alias("id"))
    all_of_them = reduce(lambda a, b: a & b, [F.bool_or(F.col("person_id") == p) for p in people])
    return found.join(held.agg(all_of_them.alias("_all")).where("_all").select("id"), "id", "left_semi")


def hit_columns(score: Column, page: Column, snippet: Column) -> list[Column]:
    label = place_label(F.col("city"), F.col("state"), F.col("country"))
    return [F.col("id"), F.col("rel_path"), F.col("kind"), F.col("taken_at"), score.alias("score"), page.alias("page"), snippet.alias("snippet"), label.alias("place")]


def _no_snippet() -> Column:
    return F.lit(None).cast("string")


def listing(c: Catalogue, q: Query) -> DataFrame:
    """Hits without text, newest first, each with score 1."""
    return candidates(c, q).select(*hit_columns(F.lit(1.0), F.lit(None).cast("int"), _no_snippet())).orderBy(F.desc_nulls_last("taken_at"), F.desc("id"))


def listing_page(c: Catalogue | Lazy, q: Query, found: DataFrame) -> DataFrame:
    """The page of a listing: out of the stored one, where there is one, by cursor or offset."""
    if c.listing is not None:
        rows = listing_index.page(c.listing, visible(q), q.limit, q.after, q.offset, lambda df: with_people(c, q, df))
        return rows.select(*hit_columns(F.lit(1.0), F.lit(None).cast("int"), _no_snippet())).orderBy(F.desc_nulls_last("taken_at"), F.desc("id"))
    return page(found if q.after is None else found.where(listing_index.after(q.after)), q)


def page_scores(c: Catalogue, text: str) -> DataFrame:
    """file_id, score, page of the best page of each file that matches."""
    return fts.best_page(fts.match_index(c.index, text) if c.index else fts.match(c.texts, text))


def near_vectors(c: Catalogue, vector: list[float], least: float = CLIP_LEAST) -> DataFrame:
    """file_id, sim of the vectors that are near enough."""
    if c.vector_index is not None:
        return vector_index.near(c.vector_index, vector, least)
    return c.clip.select("file_id", dot(F.col("embedding"), literal(vector)).alias("sim")).where(F.col("sim") >= least)


def nearest_files(c: Catalogue | Lazy, q: Query, vector: list[float], k: int, least: float = CLIP_LEAST) -> DataFrame:
    """file_id, sim of the ``k`` candidates whose vectors are nearest, ties to the lowest id."""
    own = candidates(c, q).select(F.col("id").alias("file_id"))
    if c.vector_index is not None:
        return vector_index.nearest(c.vector_index, vector, k, least, own)
    return near_vectors(c, vector, least).join(own, "file_id", "left_semi").orderBy(F.desc("sim"), "file_id").limit(k)


def vector_scores(c: Catalogue, q: Query, vector: list[float], least: float = CLIP_LEAST) -> DataFrame:
    """file_id, sim of the candidates whose vector is near enough."""
    return near_vectors(c, vector, least).join(candidates(c, q).select(F.col("id").alias("file_id")), "file_id", "left_semi")


def fused(c: Catalogue, q: Query, vector: list[float] | None, text_weight: float = 1 - CLIP_WEIGHT) -> DataFrame:
    """All hits of text and vector among the candidates, each side min-max scaled over its own matches (equal values are all 1), missing
    sides 0.  Both sides become one row a file, whose shuffle serves the bounds and the scores alike."""
    none = F.lit(None).cast("int")
    rows = page_scores(c, q.text).select("file_id", F.col("score").alias("text"), F.lit(None).cast("double").alias("vector"), F.col("page").cast("int").alias("page"))
    if vector is not None:
        rows = rows.unionByName(near_vectors(c, vector).select("file_id", F.lit(None).cast("double").alias("text"), F.col("sim").alias("vector"), none.alias("page")))
    own = candidates(c, q).select(F.col("id").alias("file_id"), "rel_path", "kind", "taken_at", "city", "state", "country")
    shown = ["rel_path", "kind", "taken_at", "city", "state", "country"]
    pairs = rows.join(own, "file_id").groupBy("file_id").agg(*[F.max(x).alias(x) for x in ("text", "vector", "page")], *[F.first(x).alias(x) for x in shown])
    bounds = pairs.agg(*[f(x).alias(f"{name}_{x}") for x in ("text", "vector") for name, f in (("lo", F.min), ("hi", F.max))])

    def scaled(side: str) -> Column:
        low, span = F.col(f"lo_{side}"), F.col(f"hi_{side}") - F.col(f"lo_{side}")
        return F.coalesce(F.when(F.col(side).isNotNull(), F.when(span < 1e-9, 1.0).otherwise((F.col(side) - low) / span)), F.lit(0.0))

    total = text_weight * scaled("text") + CLIP_WEIGHT * scaled("vector")
    both = pairs.join(F.broadcast(bounds)).select(F.col("file_id").alias("id"), total.alias("total"), "page", *shown)
    return both.select(*hit_columns(F.col("total"), F.col("page"), _no_snippet()))


def ranked(hits: DataFrame, order: str) -> DataFrame:
    day = F.coalesce("taken_at", F.lit(""))
    return hits.orderBy(day.desc(), "id") if order == "date" else hits.orderBy(F.desc("score"), day, "id")


def page(hits: DataFrame, q: Query) -> DataFrame:
    return hits.offset(q.offset).limit(q.limit)


def with_snippets(c: Catalogue, hits: DataFrame, text: str) -> DataFrame:
    """One page of hits with the snippets of their pages.  Its rows, 500 at most, come to the driver once, and only the
    texts of these files are read."""
    spark = hits.sparkSession
    rows = hits.collect()
    local = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "`_at` int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema))
    ids = sorted({r["id"] for r in rows if r["page"] is not None})
    if not ids:
        return local.orderBy("_at").drop("_at")
    shown = c.texts.where(F.col("file_id").isin(ids)).select(F.col("file_id").alias("id"), "page", "content")
    shown = shown.join(F.broadcast(local.select("id", "page")), ["id", "page"], "left_semi").select("id", "page", fts.snippet(F.col("content"), text).alias("_snippet"))
    out = local.join(F.broadcast(shown), ["id", "page"], "left").withColumn("snippet", F.col("_snippet"))
    return out.orderBy("_at").select(*hits.columns)


def find_person(c: Catalogue | Lazy, text: str) -> int | None:
    """The named person, hidden ones too, whose folded name equals the text; the lowest id wins."""
    wanted = fold_name(text)
    if not wanted:
        return None
    keys = c.people_keys if c.people_keys is not None else c.people.select("id", fold_name_udf(F.col("name")).alias("name_key"))
    return keys.where(F.col("name_key") == wanted).agg(F.min("id")).first()[0]


def search(c: Catalogue, q: Query, encode_text=None, snippets: bool = True) -> Results:
    """The three branches: no text, a person's name, and the general one.  Parameters out of range are clamped."""
    q = q.clamped()
    text = q.text.strip()
    if not text:
        found = listing(c, q)
        return Results(listing_page(c, q, found), found)
    shown = lambda hits: with_snippets(c, hits, text) if snippets else hits
    person = find_person(c, text)
    if person is not None:
        mine = replace(q, text="", people=(*q.people, person))
        photos = listing(c, mine)
        mentions = ranked(fused(c, replace(q, text=text), None, 1.0), q.order).limit(q.limit)
        return Results(listing_page(c, mine, photos), photos, shown(mentions), person)
    vector = encode_text(text) if encode_text else None
    found = ranked(fused(c, replace(q, text=text), vector), q.order)
    without = candidates(c, q).agg(F.count(F.lit(1)).alias("total")) if q.people or q.date_from or q.date_to or q.kinds else None
    return Results(shown(page(found, q)), found, without_text=without)


def search_text(c: Catalogue, text: str, limit: int = 50) -> DataFrame:
    """Full text alone."""
    q = Query(text=text, limit=limit).clamped()
    return with_snippets(c, page(ranked(fused(c, q, None, 1.0), "relevance"), q), text)


def live_file(files: DataFrame, file_id: int) -> DataFrame:
    return files.where((F.col("id") == file_id) & (F.col("status") != "missing")).limit(1)


def _begins(parts: Column, word: str) -> Column:
    return F.exists(parts, lambda p: F.startswith(p, F.lit(word)))


def autocomplete(people: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """people: id, name, files.  Names that begin with the text, then those all of whose words do, then those that hold them."""
    kind, _ = person_reference(text)
    words = [fts_fold_py(w) for w in text.split()]
    if kind != "name" or not words:
        return people.where(F.lit(False))
    whole = fts_fold_py(text.strip())
    name = ui_fold(F.col("name"))
    parts = F.split(name, r"\s+")
    begins = [_begins(parts, w) for w in words]
    every = lambda cs: reduce(lambda a, b: a & b, cs)
    ok = every([b | F.contains(name, F.lit(w)) for b, w in zip(begins, words)])
    rank = F.when(F.startswith(name, F.lit(whole)), 0).when(every(begins), 1).otherwise(2)
    return people.where(F.col("name").isNotNull() & ok).select("id", "name", "files", rank.alias("rank")).orderBy("rank", F.desc("files"), "name", "id").limit(limit)


def lines(hits: DataFrame) -> DataFrame:
    """Hits as text rows."""
    return hits.select(F.format_string("%6d  %-10s  %s", "id", F.coalesce(F.substring("taken_at", 1, 10), F.lit("")), "rel_path").alias("value"))


def json_rows(hits: DataFrame) -> DataFrame:
    return hits.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def neighbours(hits: DataFrame, keys: list[Column]) -> DataFrame:
    """Each hit of one page (a bounded number) with the ids before and after it."""
    from pyspark.sql import Window

    w = Window.orderBy(*keys)
    return hits.select("id", F.lag("id").over(w).alias("previous"), F.lead("id").over(w).alias("next"))
