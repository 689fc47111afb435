"""The registered queries of the catalogue and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, geo, text
from ..operators import browse, cdc, cluster, fts, people, search
from ..sources import listing
from ..streaming import monitor
from .bindings import bound, catalogue, published, tables, with_bound
from .index import stored_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TEXT, LEAST = "estion of", 0.2
AUTO, SUGGEST, EPS, SAMPLES = 0.40, 0.30, 0.62, 3


def query(sql: str | None = None, bind: tuple[str, ...] = ()):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"{with_bound(*bind)}{',' if sql.lstrip().startswith(',') else ''} {sql.lstrip().lstrip(',')}" if bind else sql
        return f

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


VISIBLE = "status = 'done' AND kind <> 'other' AND NOT is_sticker"
HIT = "id, rel_path, kind, taken_at"


# --- listing and filters -----------------------------------------------------------------------------------------
@query(f"SELECT {HIT} FROM b_files WHERE {VISIBLE} AND kind IN ('image') AND substr(taken_at, 1, 10) BETWEEN '2019-06-01' AND '2021-12-31' ORDER BY taken_at DESC NULLS LAST, id DESC LIMIT 50", ("files",))
def files_plain_page(spark, sf):
    q = search.Query(kinds=("image",), date_from="2019-06-01", date_to="2021-12-31", limit=50)
    return search.search(tables(spark, sf), q).hits.select("id", "rel_path", "kind", "taken_at")


@query(f"SELECT count(*) AS total FROM b_files WHERE {VISIBLE} AND kind IN ('pdf', 'docx')", ("files",))
def files_total_without_text(spark, sf):
    return search.search(tables(spark, sf), search.Query(text="estion", kinds=("pdf", "docx")), snippets=False).without_text


_WITH_ALL = "EXISTS (SELECT 1 FROM b_faces x WHERE x.file_id = f.id AND person_id = {} AND assign_source <> 'suggested')"


@query(
    " UNION ALL ".join(f"SELECT {a} AS a, {b} AS b, {HIT} FROM b_files f WHERE {VISIBLE} AND {_WITH_ALL.format(a)} AND {_WITH_ALL.format(b)}" for a in range(5) for b in range(a)),
    ("files", "faces"),
)
def files_all_people(spark, sf):
    """The files of each pair of five people."""
    c = tables(spark, sf)
    pairs = [search.candidates(c, search.Query(people=(a, b))).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "id", "rel_path", "kind", "taken_at") for a in range(5) for b in range(a)]
    return reduce(DataFrame.unionByName, pairs)


@query(f"SELECT {HIT}, city FROM b_files WHERE {VISIBLE} AND country = 'Brasil' AND state = 'S2'", ("files",))
def files_any_place(spark, sf):
    return search.candidates(tables(spark, sf), search.Query(country="Brasil", state="S2")).select("id", "rel_path", "kind", "taken_at", "city")


@query("SELECT count(*) AS n, count_if(is_sticker) AS stickers FROM b_files WHERE status = 'done' AND kind <> 'other'", ("files",))
def files_stickers_included(spark, sf):
    return search.candidates(tables(spark, sf), search.Query(stickers=True)).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_sticker").alias("stickers"))


@query(f"SELECT id, array_to_string(list_filter([city, state, country], lambda x: x <> ''), ', ') AS place FROM b_files WHERE {VISIBLE} AND city <> ''", ("files",))
def place_label(spark, sf):
    f = search.candidates(tables(spark, sf), search.Query()).where("city <> ''")
    return f.select("id", text.place_label(F.col("city"), F.col("state"), F.col("country")).alias("place"))


# --- browse --------------------------------------------------------------------------------------------------------
@query("SELECT substr(taken_at, 1, 7) AS month, count(*) AS n FROM b_files GROUP BY 1", ("files",))
def count_by_month(spark, sf):
    return browse.month_counts(bound(spark, sf, "files"))


@query("SELECT country, state, city, count(*) AS n FROM b_files WHERE city <> '' GROUP BY ALL", ("files",))
def count_by_place(spark, sf):
    return browse.place_counts(bound(spark, sf, "files"))


@query(
    """, d AS (SELECT substr(taken_at, 1, 4) AS year, substr(taken_at, 1, 7) AS month FROM b_files WHERE taken_at IS NOT NULL)
    SELECT year, month, (2 - grouping(year) - grouping(month))::INT AS level, count(*) AS n FROM d GROUP BY ROLLUP (year, month)
    UNION ALL SELECT NULL, NULL, -1, count(*) FROM b_files WHERE taken_at IS NULL""",
    ("files",),
)
def tree_year_month_rollup(spark, sf):
    return browse.date_tree(bound(spark, sf, "files"))


@query(
    """SELECT country, state, city, (3 - grouping(country) - grouping(state) - grouping(city))::INT AS level, count(*) AS n FROM b_files
    WHERE city <> '' GROUP BY ROLLUP (country, state, city) HAVING grouping(country) = 0""",
    ("files",),
)
def tree_place_rollup(spark, sf):
    return browse.place_tree(bound(spark, sf, "files"))


@query(
    """SELECT p.id, p.name, p.hidden, sum(CASE WHEN assign_source <> 'suggested' THEN 1 ELSE 0 END)::BIGINT AS faces,
      count(DISTINCT CASE WHEN assign_source <> 'suggested' THEN file_id END) AS files,
      CASE WHEN p.cover_face_id IN (SELECT id FROM b_faces) THEN p.cover_face_id ELSE min(f.id) END AS cover
    FROM b_people p JOIN b_faces f ON f.person_id = p.id GROUP BY p.id, p.name, p.hidden, p.cover_face_id""",
    ("people", "faces"),
)
def people_overview_api(spark, sf):
    return browse.people_order(browse.people_overview(bound(spark, sf, "people"), bound(spark, sf, "faces")))


@query(
    """SELECT p.id, p.name, coalesce(count_if(assign_source <> 'suggested'), 0)::BIGINT AS faces, coalesce(count_if(assign_source = 'suggested'), 0)::BIGINT AS suggested
    FROM b_people p LEFT JOIN b_faces f ON f.person_id = p.id GROUP BY p.id, p.name""",
    ("people", "faces"),
)
def people_overview_cli(spark, sf):
    return browse.people_report(bound(spark, sf, "people"), bound(spark, sf, "faces"))


@query(
    """SELECT file_id, person_id, name, bool_and(assign_source = 'auto') AS ai, max(assign_score) AS score
    FROM b_faces f JOIN b_people p ON p.id = f.person_id WHERE name IS NOT NULL AND assign_source <> 'suggested' GROUP BY ALL""",
    ("people", "faces"),
)
def people_in_file_ai_flag(spark, sf):
    return browse.people_in_files(bound(spark, sf, "faces"), bound(spark, sf, "people"))


@query(
    """SELECT (SELECT count(*) FROM b_faces) AS faces, (SELECT count(*) FROM b_faces WHERE assign_source = 'suggested') AS suggested,
      (SELECT count(*) FROM b_faces WHERE person_id IS NULL) AS unassigned, (SELECT count(*) FROM b_people) AS people, (SELECT count(name) FROM b_people) AS named,
      (SELECT count(*) FROM b_files WHERE kind <> 'other') AS files, (SELECT count(*) FROM b_files WHERE status = 'error') AS errors""",
    ("files", "people", "faces"),
)
def status_dashboard(spark, sf):
    return browse.dashboard(bound(spark, sf, "files"), bound(spark, sf, "people"), bound(spark, sf, "faces"))


@query(
    """SELECT 'kind' AS what, kind AS value, count(*) AS n FROM b_files GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM b_files GROUP BY 2
    UNION ALL SELECT 'date_source', coalesce(date_source, 'none'), count(*) FROM b_files GROUP BY 2""",
    ("files",),
)
def status_histograms(spark, sf):
    return browse.histograms(bound(spark, sf, "files"))


@query("SELECT rel_path, error FROM b_files WHERE status = 'error' ORDER BY rel_path LIMIT 20", ("files",))
def first_errors(spark, sf):
    return browse.first_errors(bound(spark, sf, "files"))


@query(
    """SELECT f.id, f.file_id, f.person_id, p.name, f.assign_score AS score,
      (SELECT min(x.id) FROM b_faces x WHERE x.person_id = f.person_id AND x.assign_source <> 'suggested') AS cover
    FROM b_faces f JOIN b_people p ON p.id = f.person_id WHERE f.assign_source = 'suggested' ORDER BY f.assign_score DESC, f.id LIMIT 200""",
    ("people", "faces"),
)
def suggestions_topk(spark, sf):
    return browse.suggestions(bound(spark, sf, "faces"), bound(spark, sf, "people"))


@query(
    """SELECT x.id, x.file_id, f.rel_path, x.det_score FROM b_faces x JOIN b_files f ON f.id = x.file_id
    WHERE x.person_id IS NULL AND NOT f.is_sticker AND f.status <> 'missing' ORDER BY x.det_score DESC, x.id LIMIT 100 OFFSET 20""",
    ("files", "faces"),
)
def unassigned_page(spark, sf):
    return browse.unassigned(bound(spark, sf, "faces"), bound(spark, sf, "files"), 100, 20)


@query("SELECT id, file_id, assign_source, assign_score FROM b_faces WHERE person_id = 4", ("faces",))
def person_faces_order(spark, sf):
    return browse.faces_of_person(bound(spark, sf, "faces"), 4)


@query(
    """, o AS (SELECT p.id, p.name, count(DISTINCT CASE WHEN assign_source <> 'suggested' THEN file_id END) AS files, lower(strip_accents(p.name)) AS f
       FROM b_people p JOIN b_faces x ON x.person_id = p.id GROUP BY p.id, p.name)
    SELECT id, name, files, (CASE WHEN starts_with(f, 'ma') THEN 0 WHEN len(list_filter(string_split(f, ' '), lambda w: starts_with(w, 'ma'))) > 0 THEN 1 ELSE 2 END)::INT AS rank
    FROM o WHERE contains(f, 'ma') ORDER BY rank, files DESC, name, id LIMIT 8""",
    ("people", "faces"),
)
def autocomplete_rank(spark, sf):
    return search.autocomplete(browse.people_overview(bound(spark, sf, "people"), bound(spark, sf, "faces")), "Ma")


@query(f"SELECT {HIT}, 1.0::DOUBLE AS score FROM b_files WHERE {VISIBLE} ORDER BY taken_at DESC NULLS LAST, id DESC LIMIT 500 OFFSET (SELECT greatest(count(taken_at) - 10, 0) FROM b_files WHERE {VISIBLE})", ("files",))
def undated_last(spark, sf):
    """The page that begins ten files before the undated ones."""
    c = tables(spark, sf)
    dated = search.candidates(c, search.Query()).agg(F.count("taken_at")).first()[0]
    return search.search(c, search.Query(limit=9999, offset=dated - 10)).hits.select("id", "rel_path", "kind", "taken_at", "score")


# --- dates, classification -------------------------------------------------------------------------------------------
_DATES = (
    f"""
, t AS (SELECT *, regexp_extract(name, '{dates.WHATSAPP_ANDROID}', 1) AS a, regexp_extract(name, '{dates.WHATSAPP_DESKTOP}', ['d', 'c', 'h']) AS w,
    regexp_extract(name, '{dates.CAMERA}', ['d', 'c']) AS k FROM b_names),"""
    r"""
c AS (SELECT *, CASE WHEN a <> '' THEN try_strptime(a, '%Y%m%d') WHEN w.d <> '' AND w.h <> '' THEN try_strptime(w.d || ' ' || w.c || ' ' || w.h, '%Y-%m-%d %I.%M.%S %p')
      WHEN w.d <> '' THEN try_strptime(w.d || ' ' || w.c, '%Y-%m-%d %H.%M.%S') WHEN k.d <> '' THEN try_strptime(k.d || k.c, '%Y%m%d%H%M%S') END AS n,
    CASE WHEN a <> '' THEN 'whatsapp_android' WHEN w.d <> '' THEN 'whatsapp_desktop' WHEN k.d <> '' THEN 'camera_name' END AS ns,
    try_strptime(exif, '%Y:%m:%d %H:%M:%S') AS e, CASE WHEN regexp_matches(pdf, '^(D:)?\d{14}') THEN try_strptime(regexp_extract(pdf, '\d{14}'), '%Y%m%d%H%M%S')
      WHEN regexp_matches(pdf, '^(D:)?\d{8}') THEN try_strptime(regexp_extract(pdf, '\d{8}'), '%Y%m%d') END AS p, make_timestamp(floor(mtime)::BIGINT * 1000000) AS m FROM t),
r AS (SELECT id, CASE WHEN n::DATE BETWEEN DATE '1990-01-01' AND DATE '2026-09-25' THEN CASE ns WHEN 'whatsapp_android' THEN strftime(n, '%Y-%m-%d') ELSE strftime(n, '%Y-%m-%dT%H:%M:%S') END
      WHEN e::DATE BETWEEN DATE '1990-01-01' AND DATE '2026-09-25' THEN strftime(e, '%Y-%m-%dT%H:%M:%S') WHEN p::DATE BETWEEN DATE '1990-01-01' AND DATE '2026-09-25' THEN strftime(p, '%Y-%m-%dT%H:%M:%S')
      WHEN m::DATE BETWEEN DATE '1990-01-01' AND DATE '2026-09-25' THEN strftime(m, '%Y-%m-%dT%H:%M:%S') END AS taken_at,
    CASE WHEN n::DATE BETWEEN DATE '1990-01-01' AND DATE '2026-09-25' THEN ns WHEN e::DATE BETWEEN DATE '1990-01-01' AND DATE '2026-09-25' THEN 'exif'
      WHEN p::DATE BETWEEN DATE '1990-01-01' AND DATE '2026-09-25' THEN 'document' WHEN m::DATE BETWEEN DATE '1990-01-01' AND DATE '2026-09-25' THEN 'mtime' END AS date_source, e, p FROM c)
"""
)


def _resolved(spark, sf):
    names = bound(spark, sf, "names")
    found = dates.resolve_date(F.col("name"), F.lit("2026-09-24").cast("date"), dates.exif_stamp(F.col("exif")), dates.pdf_stamp(F.col("pdf")), F.col("mtime"))
    return names.select("id", "exif", "pdf", found.alias("d"))


@query(_DATES + "SELECT id, taken_at, date_source FROM r", ("names",))
def date_resolution(spark, sf):
    return _resolved(spark, sf).select("id", "d.taken_at", "d.date_source")


@query(_DATES + "SELECT date_source, count(*) AS n FROM r GROUP BY 1", ("names",))
def date_source_counts(spark, sf):
    return _resolved(spark, sf).groupBy("d.date_source").agg(F.count(F.lit(1)).alias("n"))


@query(_DATES + "SELECT id, strftime(p, '%Y-%m-%dT%H:%M:%S') AS stamp FROM r", ("names",))
def pdf_date_parse(spark, sf):
    return bound(spark, sf, "names").select("id", dates.iso(dates.pdf_stamp(F.col("pdf"))).alias("stamp"))


@query(_DATES + "SELECT id, strftime(e, '%Y-%m-%dT%H:%M:%S') AS stamp FROM r", ("names",))
def exif_date_parse(spark, sf):
    return bound(spark, sf, "names").select("id", dates.iso(dates.exif_stamp(F.col("exif"))).alias("stamp"))


@query(
    r"""SELECT rel_path, CASE regexp_extract(lower(rel_path), '\.[^./]+$') WHEN '.jpg' THEN 'image' WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' ELSE 'other' END AS kind,
      starts_with(rel_path, '.') AS hidden FROM b_seen""",
    ("seen",),
)
def classify_extension(spark, sf):
    path = F.col("rel_path")
    return bound(spark, sf, "seen").select("rel_path", listing.kind_of(path).alias("kind"), listing.in_hidden_folder(path).alias("hidden"))


@query("SELECT id, starts_with(name, 'STK-') AND ends_with(lower(name), '.webp') AS sticker FROM b_names", ("names",))
def sticker_flag(spark, sf):
    return bound(spark, sf, "names").select("id", listing.is_sticker(F.col("name")).alias("sticker"))


@query("SELECT rel_path, starts_with(rel_path, '.') AS hidden FROM b_known", ("known",))
def hidden_folder(spark, sf):
    return bound(spark, sf, "known").select("rel_path", listing.in_hidden_folder(F.col("rel_path")).alias("hidden"))


_STAGES = """CASE kind WHEN 'image' THEN CASE WHEN is_sticker THEN ['date', 'gps', 'thumb', 'clip'] ELSE ['date', 'gps', 'thumb', 'faces', 'clip', 'ocr'] END
  WHEN 'pdf' THEN ['date', 'thumb', 'text', 'ocr'] WHEN 'docx' THEN ['date', 'text'] ELSE [] END"""


@query(f"SELECT id, array_to_string({_STAGES}, ',') AS stages FROM b_files", ("files",))
def required_stages(spark, sf):
    return bound(spark, sf, "files").select("id", text.stages_text(cdc.required_stages(F.col("kind"), F.col("is_sticker"))).alias("stages"))


@query(
    f""", w AS (SELECT id, list_filter({_STAGES}, lambda s: status = 'pending' OR NOT list_contains(string_split(stages_text, ','), s)) AS todo
       FROM b_files WHERE status IN ('pending', 'done') AND kind <> 'other') SELECT id, array_to_string(todo, ',') AS todo FROM w WHERE len(todo) > 0""",
    ("files",),
)
def worklist_missing_stages(spark, sf):
    files = bound(spark, sf, "files").withColumn("stages_done", text.stages_array(F.col("stages_text")))
    return cdc.work_list(files).select("id", text.stages_text(F.col("todo")).alias("todo"))


# --- places ----------------------------------------------------------------------------------------------------------
@query(
    """SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END * (event_id % 80 + (event_id % 60) / 60.0 + (event_id % 50) / 3600.0)::DOUBLE, 6) AS lat,
      round(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END * (event_id % 170 + 0.5)::DOUBLE, 6) AS lon FROM events WHERE event_id % 5 > 0"""
)
def gps_decimal(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = lambda m: (F.col("event_id") % m).cast("double")
    lat = F.array(F.when(F.col("event_id") % 5 == 0, k(80) + 95).otherwise(k(80)), k(60), k(50))
    found = geo.gps_from_exif(F.when(F.col("event_id") % 2 == 0, "S").otherwise("N"), lat, F.when(F.col("event_id") % 3 == 0, "W").otherwise("E"), F.array(k(170) + 0.5))
    return rounded(e.select("event_id", found.alias("p")).where("p IS NOT NULL").select("event_id", "p.lat", "p.lon"), "lat", "lon")


@query(
    """, d AS (SELECT p.id, q.place_id, q.name, cos(radians(p.lat)) * cos(radians(q.lat)) * cos(radians(p.lon) - radians(q.lon)) + sin(radians(p.lat)) * sin(radians(q.lat)) AS dot
       FROM b_points p CROSS JOIN b_places q),
    best AS (SELECT id, arg_max(name, {'d': round(dot, 12), 'k': -place_id}) AS name FROM d WHERE dot >= cos(60.0 / 6371.0) GROUP BY id)
    SELECT p.id, best.name FROM b_points p LEFT JOIN best ON best.id = p.id""",
    ("points", "places"),
)
def nearest_place_60km(spark, sf):
    return geo.nearest_place(bound(spark, sf, "points"), bound(spark, sf, "places")).select("id", "name")


# --- full text ---------------------------------------------------------------------------------------------------------
_TOKENS = r""", tok AS (SELECT file_id, page, list_filter(regexp_split_to_array(lower(strip_accents(content)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM b_texts)"""
_BM25 = (
    _TOKENS
    + """, n AS (SELECT file_id, page, len(w) AS l, len(list_filter(w, lambda x: x = 'estion')) AS t0, len(list_filter(w, lambda x: x = 'fur')) AS t1 FROM tok),
s AS (SELECT count(*) AS n, avg(l) AS a, count_if(t0 > 0) AS d0, count_if(t1 > 0) AS d1 FROM n),
m AS (SELECT file_id, page, {terms} AS score FROM n, s WHERE {hit})
"""
)


def _term(k: int) -> str:
    ratio = f"((s.n - d{k} + 0.5) / (d{k} + 0.5))"
    return f"greatest(CASE WHEN {ratio} > 1 THEN ln({ratio}) ELSE 0 END, 1e-6) * t{k} * 2.2 / (t{k} + 1.2 * (0.25 + 0.75 * l / a))"


_ONE = _BM25.replace("{terms}", _term(0)).replace("{hit}", "t0 > 0")


@query(_TOKENS + ", e AS (SELECT file_id, page, unnest(w) AS token FROM tok) SELECT token, count(DISTINCT (file_id, page)) AS df, count(*) AS cf FROM e GROUP BY token", ("texts",))
def tokens_df(spark, sf):
    return fts.token_frequencies(bound(spark, sf, "texts"))


@query(_TOKENS + "SELECT file_id, page FROM tok WHERE list_contains(w, 'the') AND list_contains(w, 'estion')", ("texts",))
def fts_match_and(spark, sf):
    return fts.match_index(stored_index(published(spark, sf)), "the Éstion").select("file_id", "page")


@query(_TOKENS + "SELECT file_id, page FROM tok WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')", ("texts",))
def fts_phrase(spark, sf):
    return fts.match_index(stored_index(published(spark, sf)), "of-the").select("file_id", "page")


@query(_ONE + "SELECT file_id, page, round(score, 6) AS score FROM m", ("texts",))
def bm25_pages(spark, sf):
    return rounded(fts.match_index(stored_index(published(spark, sf)), "estion").select("file_id", "page", "score"), "score")


@query(_ONE + "SELECT file_id, arg_max(page, {'s': score, 'p': -page}) AS page, round(max(score), 6) AS score FROM m GROUP BY file_id", ("texts",))
def bm25_best_page(spark, sf):
    return rounded(fts.best_page(fts.match_index(stored_index(published(spark, sf)), "estion")).select("file_id", "page", "score"), "score")


@query(_ONE + "SELECT file_id, page, round(score, 6) AS score FROM m", ("texts",))
def bm25_without_index(spark, sf):
    return rounded(fts.match(bound(spark, sf, "texts"), "estion").select("file_id", "page", "score"), "score")


@query(_TOKENS + ", e AS (SELECT file_id, page, len(w) AS len, unnest(w) AS token FROM tok) SELECT token, file_id, page, len::INT AS len, count(*)::INT AS tf FROM e GROUP BY ALL", ("texts",))
def postings_index(spark, sf):
    return stored_index(published(spark, sf)).postings.drop("positions")


@query(
    _TOKENS + "SELECT file_id, page, true AS short, 1 AS marks FROM tok WHERE len(list_filter(w, lambda x: x = 'estion')) = 1",
    ("texts",),
)
def snippet_terms(spark, sf):
    """Pages with one match: a window of at most twelve tokens that marks it."""
    held = F.size(F.filter(text.tokens(F.col("content")), lambda t: t == "estion"))
    shown = fts.match(bound(spark, sf, "texts"), "estion").where(held == 1).withColumn("snippet", fts.snippet(F.col("content"), "estion"))
    return shown.select("file_id", "page", (F.size(text.tokens(F.col("snippet"))) <= 12).alias("short"), F.size(text.highlights(F.col("snippet"))).alias("marks"))


# --- vectors and hybrid search -------------------------------------------------------------------------------------------
_VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_SIM = f"list_dot_product(embedding::DOUBLE[], {_VECTOR})"


def _vector(spark, sf) -> list[float]:
    """The stand-in for an encoded query: one row's vector."""
    return list(spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id = 0").first()["embedding"])


@query(f"SELECT file_id, round({_SIM}, 6) AS sim FROM b_clip WHERE {_SIM} >= 0.2", ("clip",))
def clip_threshold(spark, sf):
    return rounded(search.near_vectors(catalogue(spark, sf), _vector(spark, sf), LEAST), "sim")


@query(f"SELECT file_id, round({_SIM}, 6) AS sim FROM b_clip JOIN b_files f ON f.id = file_id WHERE {VISIBLE} AND {_SIM} >= 0.2 ORDER BY {_SIM} DESC, file_id LIMIT 10", ("clip", "files"))
def clip_topk(spark, sf):
    c = catalogue(spark, sf)
    return rounded(search.nearest_files(c, search.Query(), _vector(spark, sf), 10), "sim")


_HYBRID = (
    _ONE
    + f""", c AS (SELECT * FROM b_files WHERE {VISIBLE}),
ft AS (SELECT file_id, arg_max(page, {{'s': score, 'p': -page}}) AS page, max(score) AS score FROM m WHERE file_id IN (SELECT id FROM c) GROUP BY file_id),
fn AS (SELECT file_id, page, CASE WHEN max(score) OVER () - min(score) OVER () < 1e-9 THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS fts FROM ft),
v AS (SELECT file_id, {_SIM} AS sim FROM b_clip WHERE file_id IN (SELECT id FROM c)),
vn AS (SELECT file_id, CASE WHEN max(sim) OVER () - min(sim) OVER () < 1e-9 THEN 1.0 ELSE (sim - min(sim) OVER ()) / (max(sim) OVER () - min(sim) OVER ()) END AS clip FROM v WHERE sim >= 0.2),
h AS (SELECT coalesce(fn.file_id, vn.file_id) AS id, page, 0.5 * coalesce(clip, 0) + 0.5 * coalesce(fts, 0) AS score FROM fn FULL JOIN vn ON fn.file_id = vn.file_id),
o AS (SELECT h.id, rel_path, kind, taken_at, page, score FROM h JOIN b_files f ON f.id = h.id)
SELECT id, rel_path, kind, taken_at, page, round(score, 6) AS score FROM o ORDER BY """
)
_BIND = ("files", "texts", "clip")


def _hybrid(spark, sf, order: str, limit: int) -> DataFrame:
    vector = _vector(spark, sf)
    found = search.search(catalogue(spark, sf), search.Query(text="estion", order=order, limit=limit), lambda t: vector, snippets=False)
    return rounded(found.hits.select("id", "rel_path", "kind", "taken_at", "page", "score"), "score")


@query(_HYBRID + "score DESC, coalesce(taken_at, ''), id LIMIT 500", _BIND)
def hybrid_search(spark, sf):
    return _hybrid(spark, sf, "relevance", 500)


@query(_HYBRID + "coalesce(taken_at, '') DESC, id LIMIT 25", _BIND)
def hybrid_search_by_date(spark, sf):
    return _hybrid(spark, sf, "date", 25)


@query(
    f"""SELECT {HIT} FROM b_files f WHERE {VISIBLE} AND EXISTS (SELECT 1 FROM b_faces x WHERE x.file_id = f.id AND person_id = 1 AND assign_source <> 'suggested')
    ORDER BY taken_at DESC NULLS LAST, id DESC LIMIT 50""",
    ("files", "faces"),
)
def search_person_photos(spark, sf):
    return search.search(catalogue(spark, sf), search.Query(text="JOAO lima", limit=50), snippets=False).hits.select("id", "rel_path", "kind", "taken_at")


_TWO = _BM25.replace("'fur'", "'the'").replace("'estion'", "'of'")
_BOTH = _TWO.replace("{terms}", f"{_term(0)} + {_term(1)}").replace("{hit}", "t0 > 0 AND t1 > 0")
_TEXT_HITS = f""", c AS (SELECT * FROM b_files WHERE {VISIBLE}),
ft AS (SELECT file_id, arg_max(page, {{'s': score, 'p': -page}}) AS page, max(score) AS score FROM m WHERE file_id IN (SELECT id FROM c) GROUP BY file_id),
fn AS (SELECT file_id, page, CASE WHEN max(score) OVER () - min(score) OVER () < 1e-9 THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS score FROM ft)
SELECT id, rel_path, kind, taken_at, page, round(score, 6) AS score FROM fn JOIN b_files f ON f.id = file_id ORDER BY """


def _hits(df: DataFrame) -> DataFrame:
    return rounded(df.select("id", "rel_path", "kind", "taken_at", "page", "score"), "score")


@query(_BOTH + _TEXT_HITS + "score DESC, coalesce(taken_at, ''), id LIMIT 20", ("files", "texts"))
def search_person_mentions(spark, sf):
    return _hits(search.search(catalogue(spark, sf), search.Query(text="of  THE")).mentions)


@query(_BOTH + _TEXT_HITS + "coalesce(taken_at, '') DESC, id LIMIT 20", ("files", "texts"))
def search_person_mentions_by_date(spark, sf):
    return _hits(search.search(catalogue(spark, sf), search.Query(text="of the", order="date")).mentions)


@query(_BOTH.replace("'the'", "'estion'") + _TEXT_HITS + "score DESC, coalesce(taken_at, ''), id LIMIT 50", ("files", "texts"))
def search_text_only(spark, sf):
    return _hits(search.search_text(catalogue(spark, sf), TEXT))


# --- people ----------------------------------------------------------------------------------------------------------------
_FREE = "SELECT x.id, x.embedding::DOUBLE[] AS v FROM b_faces x JOIN b_files f ON f.id = x.file_id WHERE x.person_id IS NULL AND NOT f.is_sticker AND f.status <> 'missing'"
_SCORES = f""", a AS ({_FREE}), b AS (SELECT person_id, embedding::DOUBLE[] AS v FROM b_faces WHERE person_id IS NOT NULL AND assign_source IN ('cluster', 'user')),
sc AS (SELECT a.id AS face_id, b.person_id, max(list_dot_product(a.v, b.v)) AS score FROM a CROSS JOIN b GROUP BY 1, 2)"""


def _scores(spark, sf) -> DataFrame:
    faces = bound(spark, sf, "faces")
    return people.person_scores(people.assignable(faces, bound(spark, sf, "files")), people.references(faces))


@query(_SCORES + "SELECT face_id, person_id, round(score, 6) AS score FROM sc", ("files", "faces"))
def face_person_scores(spark, sf):
    return rounded(_scores(spark, sf), "score")


@query(
    _SCORES
    + """, j AS (SELECT sc.face_id, sc.person_id, CASE WHEN g.face_id IS NOT NULL THEN -1.0 ELSE score END AS score FROM sc LEFT JOIN b_negatives g ON g.face_id = sc.face_id AND g.person_id = sc.person_id),
    t AS (SELECT face_id, arg_max(person_id, {'s': score, 'p': -person_id}) AS person_id, max(score) AS score FROM j GROUP BY face_id)
    SELECT face_id, person_id, round(score, 6) AS score, CASE WHEN score >= 0.4 THEN 'auto' WHEN score >= 0.3 AND p.name IS NOT NULL THEN 'suggested' ELSE 'orphan' END AS decision
    FROM t JOIN b_people p ON p.id = person_id""",
    ("files", "faces", "people", "negatives"),
)
def face_assignment(spark, sf):
    s = people.Settings(AUTO, SUGGEST, EPS, SAMPLES)
    faces = bound(spark, sf, "faces")
    best = people.best_people(people.assignable(faces, bound(spark, sf, "files")), people.references(faces), bound(spark, sf, "negatives"))
    return rounded(people.decided(best, bound(spark, sf, "people"), s), "score")


def _points(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("i"), F.col("embedding").alias("v"), "label")


_THRESHOLDS = [0.2, 0.3, 0.4, 0.5]


@query(
    """WITH s AS (SELECT a.vec_id, max(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS score FROM embeddings a JOIN embeddings b ON a.label <> b.label GROUP BY 1)
    SELECT t AS threshold, round(avg(CASE WHEN score >= t THEN 1.0 ELSE 0.0 END), 6) AS share FROM s, (VALUES (0.2::DOUBLE), (0.3), (0.4), (0.5)) v(t) GROUP BY t"""
)
def face_impostor_sweep(spark, sf):
    return rounded(people.sweep(people.impostor_scores(_points(spark, sf)), "score", _THRESHOLDS), "share")


@query(
    _SCORES
    + """, r AS (SELECT face_id, score, row_number() OVER (PARTITION BY face_id ORDER BY score DESC, person_id) AS r FROM sc)
    SELECT face_id, round(max(CASE WHEN r = 1 THEN score END), 6) AS best, round(coalesce(max(CASE WHEN r = 2 THEN score END), -1), 6) AS second FROM r WHERE r <= 2 GROUP BY face_id""",
    ("files", "faces"),
)
def orphan_top2(spark, sf):
    faces = bound(spark, sf, "faces")
    best = people.best_people(people.assignable(faces, bound(spark, sf, "files")), people.references(faces), keep=2)
    return rounded(people.top_two(best), "best", "second")


_DBSCAN = """WITH RECURSIVE e AS (SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.38),
core AS (SELECT i FROM e GROUP BY i HAVING count(*) + 1 >= 3), ce AS (SELECT i, j FROM e WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)),
reach AS (SELECT i, i AS j FROM core UNION SELECT reach.i, ce.j FROM reach JOIN ce ON ce.i = reach.j), root AS (SELECT i, min(j) AS root FROM reach GROUP BY i),
num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS label FROM (SELECT DISTINCT root FROM root)), cl AS (SELECT i, label FROM root JOIN num USING (root)),
bl AS (SELECT e.i, min(label) AS near FROM e JOIN cl ON cl.i = e.j GROUP BY e.i),
lab AS (SELECT vec_id AS i, coalesce(cl.label, near, -1)::INT AS label, cl.label IS NOT NULL AS is_core, m.label AS truth FROM embeddings m LEFT JOIN cl ON cl.i = vec_id LEFT JOIN bl ON bl.i = vec_id)
"""


@query(_DBSCAN + "SELECT i, label, is_core FROM lab")
def dbscan_labels(spark, sf):
    return cluster.dbscan(_points(spark, sf), EPS, SAMPLES)


@query(_DBSCAN + "SELECT i FROM lab WHERE is_core")
def dbscan_core(spark, sf):
    return cluster.dbscan(_points(spark, sf), EPS, SAMPLES).where("is_core").select("i")


@query(_DBSCAN + "SELECT label, min(i) AS cover, count(*) AS n FROM lab WHERE label >= 0 GROUP BY label")
def cluster_covers(spark, sf):
    return cluster.covers(cluster.dbscan(_points(spark, sf), EPS, SAMPLES))


@query(
    _DBSCAN
    + """, c AS (SELECT label AS a, truth AS b, count(*) AS c FROM lab WHERE label >= 0 GROUP BY 1, 2), s AS (SELECT sum(c * (c - 1) / 2) AS x, sum(c) AS n FROM c),
    r AS (SELECT sum(t * (t - 1) / 2) AS x FROM (SELECT sum(c) AS t FROM c GROUP BY a)), k AS (SELECT sum(t * (t - 1) / 2) AS x FROM (SELECT sum(c) AS t FROM c GROUP BY b))
    SELECT s.n::BIGINT AS n, round((s.x - r.x * k.x / (s.n * (s.n - 1) / 2)) / ((r.x + k.x) / 2 - r.x * k.x / (s.n * (s.n - 1) / 2)), 6) AS ari FROM s, r, k"""
)
def cluster_ari(spark, sf):
    labels = cluster.dbscan(_points(spark, sf), EPS, SAMPLES).where("label >= 0").join(_points(spark, sf).select("i", F.col("label").alias("b")), "i")
    return rounded(people.adjusted_rand(labels.select(F.col("label").alias("a"), "b")), "ari")


def _face_columns(df: DataFrame) -> DataFrame:
    return df.select("id", "person_id", "assign_source", "assign_score")


def _corrected(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    return bound(spark, sf, "faces"), bound(spark, sf, "people"), bound(spark, sf, "negatives")


_RESET = """, o AS (SELECT x.id, coalesce(assign_source IN ('auto', 'suggested') OR (p.name IS NULL AND assign_source <> 'user'), false) AS off, person_id, assign_source, assign_score
      FROM b_faces x LEFT JOIN b_people p ON p.id = x.person_id)"""


@query(
    _RESET + "SELECT id, CASE WHEN NOT off THEN person_id END AS person_id, CASE WHEN NOT off THEN assign_source END AS assign_source, CASE WHEN NOT off THEN assign_score END AS assign_score FROM o",
    ("people", "faces"),
)
def reset_groups(spark, sf):
    faces, persons, _ = _corrected(spark, sf)
    return _face_columns(people.reset_groups(faces, persons)[0])


@query(_RESET + "SELECT id, name, hidden, cover_face_id FROM b_people WHERE name IS NOT NULL OR id IN (SELECT person_id FROM o WHERE NOT off)", ("people", "faces"))
def reset_groups_people(spark, sf):
    faces, persons, _ = _corrected(spark, sf)
    return people.reset_groups(faces, persons)[1]


@query(
    """, n AS (SELECT DISTINCT face_id, CASE WHEN person_id = 2 THEN 1 ELSE person_id END AS person_id FROM b_negatives)
    SELECT face_id, person_id::BIGINT AS person_id FROM n WHERE NOT (person_id = 1 AND face_id IN (SELECT id FROM b_faces WHERE person_id IN (1, 2)))""",
    ("negatives", "faces"),
)
def merge_people(spark, sf):
    return people.merge_people(*_corrected(spark, sf), 1, 2)[2]


@query("SELECT id, CASE WHEN person_id = 2 THEN 1 ELSE person_id END AS person_id, assign_source, assign_score FROM b_faces", ("faces",))
def merge_people_faces(spark, sf):
    return _face_columns(people.merge_people(*_corrected(spark, sf), 1, 2)[0])


@query("SELECT id, name, hidden, cover_face_id FROM b_people WHERE id <> 2", ("people",))
def merge_people_rest(spark, sf):
    return people.merge_people(*_corrected(spark, sf), 1, 2)[1]


@query(
    """SELECT p.id, p.name, p.hidden, CASE WHEN p.cover_face_id = 30 THEN (SELECT min(x.id) FROM b_faces x WHERE x.person_id = p.id AND x.id <> 30) ELSE p.cover_face_id END AS cover_face_id FROM b_people p""",
    ("people", "faces"),
)
def remove_face(spark, sf):
    return people.remove_face(*_corrected(spark, sf), 30)[1]


@query(
    "SELECT id, CASE WHEN id <> 30 THEN person_id END AS person_id, CASE WHEN id <> 30 THEN assign_source END AS assign_source, CASE WHEN id <> 30 THEN assign_score END AS assign_score FROM b_faces",
    ("faces",),
)
def remove_face_faces(spark, sf):
    return _face_columns(people.remove_face(*_corrected(spark, sf), 30)[0])


@query("SELECT face_id, person_id FROM b_negatives UNION SELECT id, person_id FROM b_faces WHERE id = 30 AND person_id IS NOT NULL", ("negatives", "faces"))
def remove_face_vetoes(spark, sf):
    return people.remove_face(*_corrected(spark, sf), 30)[2]


@query("SELECT id, person_id, assign_source FROM (SELECT id, CASE WHEN id = 31 THEN 4 ELSE person_id END AS person_id, CASE WHEN id = 31 THEN 'user' ELSE assign_source END AS assign_source FROM b_faces)", ("faces",))
def assign_face(spark, sf):
    return people.assign_face(bound(spark, sf, "faces"), bound(spark, sf, "negatives"), 31, 4)[0].select("id", F.col("person_id").cast("long").alias("person_id"), "assign_source")


@query(
    """WITH f AS (SELECT vec_id, vec_id % 100 AS file_id, vec_id % 50 AS x, vec_id % 30 AS y, 40 + vec_id % 9 AS w, 50 AS h, label FROM embeddings),
    o AS (SELECT * FROM f WHERE vec_id % 2 = 0), n AS (SELECT * FROM f WHERE vec_id % 2 = 1),
    i AS (SELECT o.vec_id AS old_id, o.label, n.vec_id AS n, n.file_id, greatest(least(n.x + n.w, o.x + o.w) - greatest(n.x, o.x), 0) * greatest(least(n.y + n.h, o.y + o.h) - greatest(n.y, o.y), 0) AS k, n.w * n.h + o.w * o.h AS a
      FROM n JOIN o ON o.vec_id % 100 = n.file_id - 1 WHERE o.vec_id % 3 = 0),
    m AS (SELECT n, arg_max(label, old_id)::BIGINT AS person_id FROM i WHERE k > 0.5 * (a - k) GROUP BY n)
    SELECT n.vec_id AS n, m.person_id, CASE WHEN m.person_id IS NOT NULL THEN 'user' END AS assign_source FROM n LEFT JOIN m ON m.n = n.vec_id"""
)
def save_faces_iou(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    box = F.struct((F.col("vec_id") % 50).cast("int").alias("x"), (F.col("vec_id") % 30).cast("int").alias("y"), (40 + F.col("vec_id") % 9).cast("int").alias("w"), F.lit(50).alias("h"))
    new = e.where("vec_id % 2 = 1").select((F.col("vec_id") % 100 - 1).alias("file_id"), F.col("vec_id").alias("n"), box.alias("bbox"), F.col("vec_id").cast("double").alias("det_score"), "embedding")
    old = e.where("vec_id % 2 = 0").select(
        F.col("vec_id").alias("id"), (F.col("vec_id") % 100).alias("file_id"), box.alias("bbox"), F.lit(1.0).alias("det_score"), "embedding", F.col("label").cast("long").alias("person_id"),
        F.when(F.col("vec_id") % 3 == 0, "user").otherwise("auto").alias("assign_source"), F.lit(None).cast("double").alias("assign_score"), F.lit(False).alias("manual"),
    )
    return cdc.merge_faces(old, new).select(F.col("det_score").cast("long").alias("n"), "person_id", "assign_source")


# --- change capture ----------------------------------------------------------------------------------------------------------
_CHANGES = """, c AS (SELECT coalesce(k.rel_path, s.rel_path) AS rel_path, CASE WHEN k.rel_path IS NULL THEN 'new' WHEN s.rel_path IS NULL AND starts_with(k.rel_path, '.') THEN 'purged'
    WHEN s.rel_path IS NULL AND k.status = 'missing' THEN 'missing' WHEN s.rel_path IS NULL THEN 'gone' WHEN k.size <> s.size OR k.mtime <> s.mtime OR k.kind <> s.kind THEN 'changed'
    WHEN k.status = 'missing' THEN 'reappeared' ELSE 'unchanged' END AS change, k.status AS old, k.error, k.stages_text, coalesce(s.kind, k.kind) AS kind, s.size, s.mtime
  FROM b_known k FULL JOIN b_seen s ON s.rel_path = k.rel_path)
"""


def _known(spark, sf) -> DataFrame:
    return bound(spark, sf, "known").withColumn("stages_done", text.stages_array(F.col("stages_text")))


@query(_CHANGES + "SELECT rel_path, change FROM c", ("known", "seen"))
def scan_changes(spark, sf):
    return cdc.changes(_known(spark, sf), bound(spark, sf, "seen")).select("rel_path", "change")


@query(
    _CHANGES
    + """SELECT rel_path, kind, change, CASE WHEN change IN ('new', 'changed') THEN CASE kind WHEN 'other' THEN 'done' ELSE 'pending' END WHEN change IN ('gone', 'missing') THEN 'missing'
      WHEN change = 'reappeared' THEN CASE WHEN error IS NOT NULL THEN 'error' WHEN stages_text <> '' OR kind = 'other' THEN 'done' ELSE 'pending' END ELSE old END AS status FROM c WHERE change <> 'purged'""",
    ("known", "seen"),
)
def scan_apply(spark, sf):
    return cdc.apply_scan(_known(spark, sf), bound(spark, sf, "seen")).select("rel_path", "kind", "change", "status")


@query(
    """SELECT coalesce(k.rel_path, s.rel_path) AS rel_path, coalesce(s.size, -1)::BIGINT AS size, coalesce(s.mtime, 0) AS mtime FROM b_known k FULL JOIN b_seen s ON s.rel_path = k.rel_path
    WHERE (s.rel_path IS NULL AND k.status <> 'missing') OR k.rel_path IS NULL OR (s.rel_path IS NOT NULL AND (k.size <> s.size OR k.mtime <> s.mtime OR k.status = 'missing'))""",
    ("known", "seen"),
)
def pending_changes(spark, sf):
    return cdc.pending_changes(_known(spark, sf), bound(spark, sf, "seen"))


@query("""WITH d AS (SELECT concat(k, o_orderkey) AS key, v AS value FROM orders, (VALUES ('auto', '0.7'), ('note', '0.6')) AS t(k, v) UNION ALL VALUES ('auto', '0.7'), ('suggest', '0.6'), ('eps', '0.3'))
  SELECT key, CASE key WHEN 'eps' THEN '0.25' WHEN 'auto' THEN '0.8' ELSE value END AS value FROM d""")
def settings_effective(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    named = lambda k, v: o.select(F.concat(F.lit(k), "o_orderkey").alias("key"), F.lit(v).alias("value"))
    defaults = spark.createDataFrame([("auto", "0.7"), ("suggest", "0.6"), ("eps", "0.3")], "key string, value string").union(named("auto", "0.7")).union(named("note", "0.6"))
    meta = named("faces_t_", "9").union(spark.createDataFrame([("faces_eps", "0.25"), ("faces_t_auto", "0.8"), ("faces_auto", "0.1"), ("monitor", "0")], "key string, value string"))
    return people.effective_settings(meta, defaults)


@query(
    """SELECT event_type AS stage, round(sum(value), 4) AS seconds, round(avg(value) * 1000, 4) AS ms_per_item, round(count(*) / sum(value), 4) AS items_per_second FROM events WHERE value IS NOT NULL GROUP BY event_type"""
)
def stage_seconds(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where("value IS NOT NULL")
    rates = people.stage_rates(e.select(F.create_map("event_type", "value").alias("seconds")))
    return rates.withColumns({c: F.round(c, 4) for c in ("seconds", "ms_per_item", "items_per_second")})


@query(
    """, s AS (SELECT tick, string_agg(DISTINCT rel_path || ':' || size, ',' ORDER BY rel_path || ':' || size) AS s, count(*) AS n FROM b_ticks GROUP BY tick)
    SELECT tick, coalesce(s = lag(s) OVER (ORDER BY tick) AND n = lag(n) OVER (ORDER BY tick), false) AS act FROM s""",
    ("ticks",),
)
def monitor_settled(spark, sf):
    return monitor.settled(bound(spark, sf, "ticks"))


from . import upkeep_queries  # noqa: E402, F401  (registers its queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
