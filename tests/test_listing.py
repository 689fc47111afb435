"""The stored listing: pages by cursor and offset equal slices of the whole order, out of few parts."""

import random

import pytest
from pyspark.sql import functions as F

from mediacat import catalog as cat
from mediacat.operators import listing_index, search
from mediacat.plans.index import searchable, stored_listing, sync_listing
from mediacat.schema import TABLES

N = 400


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rnd = random.Random(5)
    rows = [(k, f"f{k}.jpg", rnd.choice(["image", "pdf"]), None if k % 9 == 0 else f"20{rnd.randint(10, 23)}-0{rnd.randint(1, 9)}-01", k % 50 == 0, "done" if k % 11 else "error") for k in range(N)]
    files = spark.createDataFrame(rows, "id long, rel_path string, kind string, taken_at string, is_sticker boolean, status string")
    files = files.select(*[F.col(f.name) if f.name in files.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES["files"].fields])
    c = cat.Catalog(spark, f"file://{tmp_path_factory.mktemp('listing')}", cat.root_id("l"))
    c.publish({"files": files})
    assert stored_listing(c) is None and sync_listing(c, part_rows=40) and not sync_listing(c, part_rows=40)
    return c


def order(rows):
    dated = sorted((r for r in rows if r["taken_at"] is not None), key=lambda r: (r["taken_at"], r["id"]), reverse=True)
    return [r["id"] for r in dated + sorted((r for r in rows if r["taken_at"] is None), key=lambda r: -r["id"])]


def test_parts_follow_the_order(store):
    held = stored_listing(store)
    assert len(held.fences) >= 8 and sum(f[1] for f in held.fences) == N
    rows = store.read("listing").collect()
    ids = [i for part in sorted({r["part"] for r in rows}) for i in order([r for r in rows if r["part"] == part])]
    assert ids == order(store.read("files").collect())
    for _, _, newest, oldest in held.fences:
        assert listing_index._reaches(oldest, newest) or newest == oldest


@pytest.mark.parametrize("offset, limit", [(0, 7), (5, 40), (123, 50), (395, 20), (400, 5), (0, 500)])
def test_pages_by_offset(store, offset, limit):
    found = listing_index.page(stored_listing(store), None, limit, offset=offset)
    assert order_of(found) == order(store.read("files").collect())[offset : offset + limit]
    if limit <= 50:  # few parts are read
        assert parts_read(found) <= 4


def order_of(df):
    return [r["id"] for r in df.collect()]


def parts_read(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    import re

    inside = re.search(r"part#\d+ IN \(([^)]*)\)", plan)
    return len(inside[1].split(",")) if inside else 1


def test_scrolling_by_cursor_shows_every_row_once(spark, store):
    c, seen, cursor = searchable(store), [], None
    q = dict(kinds=("image",), limit=30)
    want = order([r for r in store.read("files").collect() if r["kind"] == "image" and r["status"] == "done" and not r["is_sticker"]])
    while True:
        hits = search.search(c, search.Query(**q, after=cursor)).hits
        page = order_of(hits)
        if not page:
            break
        seen += page
        cursor = listing_index.next_cursor(hits)
    assert seen == want
    assert order_of(search.search(c, search.Query(**q, offset=35)).hits) == want[35:65]
    bare = search.Catalogue(store.read("files"), None, store.read("faces"), None, None)
    middle = (store.read("files").where(F.col("id") == want[50]).first()["taken_at"], want[50])
    assert order_of(search.search(bare, search.Query(**q, after=middle)).hits) == want[51:81] == order_of(search.search(c, search.Query(**q, after=middle)).hits)


def test_people_filter_pages_too(spark, store):
    faces = spark.createDataFrame([(k, k * 3 % N, None, 0.9, [1.0], 1, "user", None, False) for k in range(200)], TABLES["faces"])
    c = search.Catalogue(store.read("files"), None, faces, None, None, listing=stored_listing(store))
    q = search.Query(people=(1,), limit=25, offset=10)
    assert order_of(search.search(c, q).hits) == order_of(search.page(search.listing(c, q), q))


def test_a_listing_of_other_files_is_not_used(store):
    store.publish({"files": store.read("files").where("id <> 3")})
    assert stored_listing(store) is None and sync_listing(store) and stored_listing(store) is not None
