import pytest
from pyspark.sql import functions as F

from mediacat.functions import dates, geo, text, vectors
from mediacat.operators import cdc, fts
from mediacat.sources import listing

TODAY, TOMORROW = "2026-09-24", "20260925"


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[1]}" for k, v in values.items()) or "z int"
    return spark.createDataFrame([tuple(v[0] for v in values.values()) or (1,)], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name, exif, expected",
    [
        ("VID-20170809-WA0102.mp4", None, ("2017-08-09", "whatsapp_android")),
        ("AUD-20170809-WA0001.opus", None, ("2017-08-09", "whatsapp_android")),
        ("VID-20170809-XY0102.mp4", None, None),
        ("WhatsApp Video 2018-11-03 at 7.41.22.mp4", None, ("2018-11-03T07:41:22", "whatsapp_desktop")),
        ("WhatsApp Image 2018-11-03 at 12.05.59 AM.jpeg", None, ("2018-11-03T00:05:59", "whatsapp_desktop")),
        ("WhatsApp Image 2018-11-03 at 12.05.59 PM.jpeg", None, ("2018-11-03T12:05:59", "whatsapp_desktop")),
        ("IMG_20160229_081530.jpg", None, ("2016-02-29T08:15:30", "camera_name")),
        ("Screenshot_20160229-081530.png", None, ("2016-02-29T08:15:30", "camera_name")),
        ("20160229-081530 (copy).jpg", None, ("2016-02-29T08:15:30", "camera_name")),
        ("IMG-20190045-WA0009.jpg", "2015:07:04 06:05:04", ("2015-07-04T06:05:04", "exif")),
        ("IMG-20150229-WA0009.jpg", "2015:07:04 06:05:04", ("2015-07-04T06:05:04", "exif")),
        ("IMG-19851026-WA0009.jpg", "2015:07:04 06:05:04", ("2015-07-04T06:05:04", "exif")),
        ("IMG-20261001-WA0009.jpg", "2015:07:04 06:05:04", ("2015-07-04T06:05:04", "exif")),
        ("WhatsApp Image 2018-11-03 at 31.00.00.jpeg", "2015:07:04 06:05:04", ("2015-07-04T06:05:04", "exif")),
        ("20160229_089930.jpg", "2015:07:04 06:05:04", ("2015-07-04T06:05:04", "exif")),
        (f"IMG-{TOMORROW}-WA0009.jpg", None, ("2026-09-25", "whatsapp_android")),
        ("IMG-19900101-WA0009.jpg", None, ("1990-01-01", "whatsapp_android")),
        ("y.jpg", "    :  :     :  :  ", None),
    ],
)
def test_dates(spark, name, exif, expected):
    got = one(
        spark, dates.resolve_date(F.col("n"), F.lit(TODAY).cast("date"), dates.exif_stamp(F.col("e")), dates.pdf_stamp(F.lit(None).cast("string")), F.lit(0.0)),
        n=(name, "string"), e=(exif, "string"),
    )
    assert (got and tuple(got)) == expected


@pytest.mark.parametrize(
    "value, expected",
    [("D:20180203", "2018-02-03T00:00:00"), ("D:20180203172139Z", "2018-02-03T17:21:39"), ("20180203172139+02'00'", "2018-02-03T17:21:39"), ("", None), ("D:", None), ("D:201802", None), ("D:20184003", None), ("none", None)],
)
def test_pdf_dates(spark, value, expected):
    assert one(spark, dates.iso(dates.pdf_stamp(F.col("v"))), v=(value, "string")) == expected


def test_document_and_mtime(spark):
    cols = dict(n=("x.png", "string"), m=(1500000000.9, "double"))
    got = one(spark, dates.resolve_date(F.col("n"), F.lit(TODAY).cast("date"), F.lit(None).cast("timestamp_ntz"), dates.pdf_stamp(F.lit("20200102")), F.col("m")), **cols)
    assert tuple(got) == ("2020-01-02T00:00:00", "document")
    got = one(spark, dates.resolve_date(F.col("n"), F.lit(TODAY).cast("date"), F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz"), F.col("m")), **cols)
    assert tuple(got) == ("2017-07-14T02:40:00", "mtime")
    assert one(spark, dates.display_date(F.lit("2023-05-14T21:05:09"))) == "14/05/2023 21:05"
    assert tuple(one(spark, dates.month_bounds(F.lit("2024-02")))) == ("2024-02-01", "2024-02-29")


def test_foldings(spark):
    assert one(spark, text.fts_fold(F.lit("Ünï ÇAFÉ Łø Straße ﬁ"))) == "uni cafe łø straße ﬁ"
    assert text.fold_name("  ÜNÏ   ﬁn Straße ") == "uni fin strasse"
    assert one(spark, text.nocase(F.lit("CAFÉ"))) == "cafÉ"
    assert one(spark, text.tokens(F.lit("Foo-bar_baz, 12ª"))) == text.tokens_py("Foo-bar_baz, 12ª") == ["foo", "bar", "baz", "12ª"]
    assert text.fts_query('lake "OR" ( foo-bar') == [["lake"], ["or"], ["foo", "bar"]]
    assert one(spark, text.person_name(F.lit("  "))) is None
    assert text.person_reference(" #12 ") == ("id", 12) and text.person_reference("Zé") == ("name", "Zé")
    assert one(spark, text.place_label(F.lit("Rio"), F.lit(""), F.lit(None).cast("string"))) == "Rio"
    assert one(spark, text.place_label(F.lit(""), F.lit(""), F.lit(None).cast("string"))) is None
    assert one(spark, text.file_size(F.lit(5 * 1024 * 1024))) == "5.0 MB" and one(spark, text.file_size(F.lit(2048))) == "2 KB"
    quarters = [one(spark, text.file_size(F.lit(k << 18))) for k in (5, 7, 9, 39)]
    assert quarters == ["1.2 MB", "1.8 MB", "2.2 MB", "9.8 MB"]  # halves go to the even digit, as in SQL's printf
    assert one(spark, text.file_size(F.lit((2 << 20) - 1))) == "2.0 MB" and one(spark, text.file_size(F.lit(None).cast("long"))) is None


def test_kinds(spark):
    names = {"p.JPEG": "image", "b.pdf": "pdf", "c.docx": "docx", "d.mp4": "other", "noext": None, "dir.x/noext": None, ".nomedia": None}
    for name, kind in names.items():
        assert one(spark, listing.kind_of(F.col("n")), n=(name, "string")) == kind
    heads = {b"%PDF-1.4": "pdf", b"\xff\xd8\xff\xe0": "image", b"\x89PNG\r\n\x1a\n": "image", b"RIFF1234WEBPVP8 ": "image", b"0000ftypheic": "image", b"PK\x03\x04": "zip", b"xx": "other", b"": "other"}
    for head, kind in heads.items():
        assert one(spark, listing.sniff_kind(F.col("h")), h=(bytearray(head), "binary")) == kind
    assert one(spark, listing.in_hidden_folder(F.lit(".trash/a.jpg"))) and not one(spark, listing.in_hidden_folder(F.lit("x/.nomedia")))
    assert one(spark, listing.is_sticker(F.lit("a/STK-1.WEBP"))) and not one(spark, listing.is_sticker(F.lit("a/stk-1.webp")))


def test_stages(spark):
    req = lambda kind, sticker, only=None: one(spark, cdc.required_stages(F.lit(kind), F.lit(sticker), only))
    assert req("image", True) == ["date", "gps", "thumb", "clip"]
    assert req("pdf", False, ["clip"]) == ["date", "thumb", "text"]
    assert req("other", False) == []
    assert one(spark, cdc.stages_after(F.lit("image"), F.array(F.lit("thumb")), F.array(F.lit("date"), F.lit("clip")))) == ["date", "thumb", "clip"]
    assert cdc.unknown_stages(["clip", "foo"]) == ["foo"]


def test_gps(spark):
    got = one(spark, geo.gps_from_exif(F.lit("S"), F.array(F.lit(22.0), F.lit(30.0), F.lit(36.0)), F.lit("W"), F.array(F.lit(43.5))))
    assert abs(got["lat"] + 22.51) < 1e-9 and got["lon"] == -43.5
    zero = F.array(F.lit(0.0))
    assert one(spark, geo.gps_from_exif(F.lit("N"), zero, F.lit("E"), zero)) is None
    assert one(spark, geo.gps_from_exif(F.lit("N"), F.array(F.lit(95.0)), F.lit("E"), zero)) is None
    assert one(spark, geo.gps_from_exif(F.lit("N"), F.array(F.lit(float("nan"))), F.lit("E"), F.array(F.lit(1.0)))) is None
    assert one(spark, geo.gps_from_exif(F.lit("N"), F.array().cast("array<double>"), F.lit("E"), F.array(F.lit(1.0)))) is None


def test_nearest_place_against_all_pairs(spark):
    import math
    import random

    rnd = random.Random(5)
    places = [(k, f"p{k}", "s", "c", rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for k in range(400)] + [(400, "east", "", "", 10.0, 179.99), (401, "pole", "", "", 89.9, 10.0), (402, "twin", "", "", 10.0, 179.99)]
    points = [(k, p[4] + rnd.uniform(-0.6, 0.6), p[5] + rnd.uniform(-0.8, 0.8)) for k, p in enumerate(places)]
    points = [(k, max(-90.0, min(90.0, a)), max(-180.0, min(180.0, b))) for k, a, b in points] + [(900, 10.0, -179.9), (901, 89.95, -170.0), (902, -40.0, -20.0)]

    def unit(a, b):
        a, b = math.radians(a), math.radians(b)
        return math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)

    want = {}
    for k, a, b in points:
        u = unit(a, b)
        best = max(((sum(x * y for x, y in zip(u, unit(p[4], p[5]))), -p[0], p[1]) for p in places))
        want[k] = best[2] if best[0] >= math.cos(60 / 6371) else None
    p = spark.createDataFrame(places, "place_id long, name string, state string, country string, lat double, lon double")
    got = {r["id"]: r["name"] for r in geo.nearest_place(spark.createDataFrame(points, "id long, lat double, lon double"), p).collect()}
    assert got == want


def test_vectors(spark):
    box = lambda *v: F.struct(*[F.lit(x).alias(n) for n, x in zip("xywh", v)])
    assert one(spark, vectors.iou(box(0, 0, 10, 10), box(0, 5, 10, 10))) == pytest.approx(1 / 3)
    assert one(spark, vectors.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    assert one(spark, vectors.normalise(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert not one(spark, vectors.has_signature(F.array(F.lit(0.0), F.lit(0.0))))


def test_exif_description(spark):
    e = F.struct(F.lit("Canon").alias("make"), F.lit("R5").alias("model"), F.lit("").alias("lens"), F.lit("0.004").alias("exposure"), F.lit("2.8").alias("aperture"), F.lit("x").alias("iso"), F.lit("35").alias("focal"), F.lit("52.5").alias("focal35"), F.lit(1).alias("flash"), F.lit("Edit\x00").alias("software"))
    assert [tuple(r) for r in one(spark, vectors.exif_description(e))] == [("Camera", "Canon R5"), ("Exposure", "1/250 s"), ("Aperture", "f/2.8"), ("Focal length", "35.0 mm (53 mm equiv.)"), ("Flash", "fired"), ("Software", "Edit")]


def test_bm25_and_phrases(spark):
    import math

    rows = [(1, 1, "foo bar baz"), (2, 1, "bar foo"), (3, 1, "Foo-bar foo bar qux quux"), (4, 1, ""), (5, 2, "nothing here"), (5, 1, "other words")]
    t = spark.createDataFrame(rows, "file_id long, page int, content string")
    assert {r["file_id"] for r in fts.match(t, "foo-bar").collect()} == {1, 3}
    assert {r["file_id"] for r in fts.match(t, "foo bar").collect()} == {1, 2, 3}
    assert fts.match(t, "(").count() == 0
    n, df, avg = 6, 1, (3 + 2 + 6 + 0 + 2 + 2) / 6
    want = math.log((n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / avg))
    got = fts.match(t, "baz").first()
    assert got["score"] == pytest.approx(want)
    index = fts.Index(fts.postings(t), fts.totals(t))
    for q in ("foo", "foo bar", "foo-bar", "baz", "foo-bar qux", "nothing", "none", "(", "bar-foo foo"):
        rows = lambda df: {(r["file_id"], r["page"]): round(r["score"], 9) for r in df.collect()}
        assert rows(fts.match(t, q)) == rows(fts.match_index(index, q))
    assert fts.postings(t).where("token = 'foo' AND file_id = 3").first()["positions"] == [0, 2]


def test_snippets_equal_those_of_the_index_library():
    """The same windows and marks as SQLite's full-text index gives."""
    import random
    import sqlite3

    c = sqlite3.connect(":memory:")
    try:
        c.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize=\"unicode61 remove_diacritics 2\")")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index here")
    rnd = random.Random(2)
    words = "foo bar baz qux the of alpha béta gamma e\u0301ps zeta".split()
    for _ in range(400):
        content = "".join(rnd.choice(words) + rnd.choice([" ", " ", ". ", ", ", "-", ": ", "_"]) for _ in range(rnd.randint(1, 60))).strip()
        query = rnd.choice(["foo", "foo bar", "foo-bar", "the-of baz", "alpha", "qux foo-bar", "eps"])
        c.execute("DELETE FROM t")
        c.execute("INSERT INTO t VALUES (?)", (content,))
        found = c.execute("SELECT snippet(t, 0, '[', ']', '…', 12) FROM t WHERE t MATCH ?", (" ".join(f'"{x}"' for x in query.split()),)).fetchone()
        if found:
            assert fts.snippet_text(content, fts.fts_query(query)) == found[0]


def test_encoder_input_and_tokens(spark):
    import numpy as np
    import public_tokenizers

    from mediacat.functions import geometry

    flat = geometry.encoder_input(np.full((300, 500, 3), 128, np.uint8))
    assert flat.shape == (3, 224, 224) and np.allclose(flat[0], (128 / 255 - geometry.MEAN[0]) / geometry.STD[0], atol=1e-5)
    ramp = np.repeat(np.arange(224, dtype=np.uint8)[None, :, None], 224, 0).repeat(3, 2)
    assert np.allclose(geometry.encoder_input(ramp)[1] * geometry.STD[1] + geometry.MEAN[1], ramp[:, :, 1] / 255, atol=1e-5)  # no resampling at that size
    ids = one(spark, geometry.encoder_tokens(F.col("t"), public_tokenizers.path("word_bpe_49k.json")), t=("  a   small dog ", "string"))
    assert len(ids) == 77 and ids[-1] == geometry.PAD and ids[:3] == one(spark, geometry.encoder_tokens(F.col("t"), public_tokenizers.path("word_bpe_49k.json")), t=("a small dog", "string"))[:3]
