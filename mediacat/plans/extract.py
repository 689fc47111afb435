"""Extraction by stages: one pass over the files' contents runs the due stages of each file, and columns make values of what came out.

Decoders, recognisers and encoders are injected as ``Engines``, or as an ``EngineSource`` that makes them once a worker process.  A
task holds the contents of ``batch_bytes`` and one file at most: that much goes to the encoder at a time, and its rows leave the task.  A
file that fails is a row with its error and stops no other."""

from __future__ import annotations

import posixpath
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, geo, geometry
from ..operators.people import detections
from ..sources.documents import docx_text
from ..sources.pictures import file_system

#: Bytes of contents, and files, that are decoded before the encoder runs and their rows go.
BATCH_BYTES, BATCH_FILES = 64 << 20, 256
#: Stages that need a picture's pixels; without any of them only its header is read.
PIXELS = {"thumb", "faces", "clip", "ocr"}
SCHEMA = (
    "rel_path string, error string, ran array<string>, hash string, width int, height int, exif_date string, created timestamp_ntz, mtime double, lat_ref string, lat array<double>, "
    "lon_ref string, lon array<double>, pages array<struct<page: int, content: string>>, faces array<struct<x: double, y: double, w: double, h: double, score: double, embedding: array<float>>>, "
    "embedding array<float>, thumb binary, seconds map<string, double>"
)
#: The same with the file's id, and the day that dates are resolved on: what is stored of a chunk.
ROWS = f"file_id long, {SCHEMA}, today date"


@dataclass(frozen=True)
class Engines:
    """image(content, header_only) -> width, height, exif_date, lat_ref, lat, lon_ref, lon; thumb(content) -> picture bytes;
    faces(content) -> x, y, w, h, score, embedding on the working copy; ocr(content) -> [(line, confidence)];
    region(content, {x0, y0, x1, y1}, zoom) -> the same, found in that part of the picture, in zoomed pixels of it;
    encode(contents) -> vectors, or with pixels(content) -> (height, width, 3) bytes, encode(inputs) of pictures brought into the encoder's form; pdf(content) -> (page texts, creation time); render(content, page) -> picture bytes."""

    image: Callable | None = None
    thumb: Callable | None = None
    faces: Callable | None = None
    ocr: Callable | None = None
    encode: Callable | None = None
    pdf: Callable | None = None
    render: Callable | None = None
    region: Callable | None = None
    pixels: Callable | None = None

    def vectors(self, contents: list[bytes]) -> list[list[float]]:
        """The encoder's vectors of some contents."""
        given = contents if self.pixels is None else [geometry.encoder_input(self.pixels(c)) for c in contents]
        return [[float(x) for x in v] for v in self.encode(given)]


@dataclass(frozen=True)
class EngineSource:
    """Makes the engines where they are used: ``load()`` runs once in each worker process for each ``name``, since models take
    seconds to load and hundreds of MB."""

    name: str
    load: Callable[[], Engines]


_LOADED: dict[str, Engines] = {}


def engines_here(source: Engines | EngineSource) -> Engines:
    """The engines of this process."""
    if isinstance(source, Engines):
        return source
    if source.name not in _LOADED:
        _LOADED[source.name] = source.load()
    return _LOADED[source.name]


def in_batches(items: Iterator, size: Callable, most_bytes: int, most: int) -> Iterator[list]:
    """Lists of at most ``most`` items, cut as soon as their sizes reach ``most_bytes``; an item larger than that is a list of its own at
    the latest."""
    held, total = [], 0
    for item in items:
        n = size(item)
        if held and total + n > most_bytes:
            yield held
            held, total = [], 0
        held.append(item)
        total += n
        if total >= most_bytes or len(held) >= most:
            yield held
            held, total = [], 0
    if held:
        yield held


def encoded(rows: DataFrame, key: str, content: str, source: Engines | EngineSource, batch_bytes: int = BATCH_BYTES, batch_files: int = BATCH_FILES) -> DataFrame:
    """key, embedding (what the encoder gives), batch_bytes and batch_files (of the batch that the row was in) of each row with content."""
    wanted = rows.where(F.col(content).isNotNull()).select(F.col(key).alias("key"), F.col(content).cast("binary").alias("content"))

    def run(batches):
        own = engines_here(source)
        pairs = ((k, bytes(c)) for batch in batches for k, c in zip(batch["key"], batch["content"]))
        for part in in_batches(pairs, lambda p: len(p[1]), batch_bytes, batch_files):
            vectors = own.vectors([c for _, c in part])
            yield pd.DataFrame({"key": [k for k, _ in part], "embedding": vectors, "batch_bytes": sum(len(c) for _, c in part), "batch_files": len(part)})

    kind = wanted.schema["key"].dataType.simpleString()
    return wanted.mapInPandas(run, f"key {kind}, embedding array<float>, batch_bytes long, batch_files int").withColumnRenamed("key", key)


def read_lines(engine: Callable, content: bytes, least: float = 0.5) -> str:
    return "\n".join(t.strip() for t, s in engine(content) if s >= least and t.strip())


def process(path: str, kind: str, todo: list[str], content: bytes, engines: Engines) -> dict:
    """The due stages of one file, but for the encoder's, which takes several files at once."""
    import hashlib

    out: dict = {"seconds": {}, "pages": []}
    due = set(todo)

    def timed(stage: str, call: Callable):
        began = time.perf_counter()
        try:
            return call()
        finally:
            out["seconds"][stage] = out["seconds"].get(stage, 0.0) + time.perf_counter() - began

    if "date" in due:
        out["hash"] = timed("hash", lambda: hashlib.sha256(content).hexdigest())
    if kind == "image" and engines.image:
        out |= timed("decode" if due & PIXELS else "gps", lambda: engines.image(content, not due & PIXELS))
        if "thumb" in due and engines.thumb:
            out["thumb"] = timed("thumb", lambda: engines.thumb(content))
        if "faces" in due and engines.faces:
            out["faces"] = timed("faces", lambda: engines.faces(content))
        if "ocr" in due and engines.ocr and (text := timed("ocr", lambda: read_lines(engines.ocr, content))):
            out["pages"].append({"page": 1, "content": text})
    elif kind == "pdf" and engines.pdf:
        texts, made = timed("text", lambda: engines.pdf(content))
        if "thumb" in due and engines.thumb and engines.render and texts:  # of the first page
            out["thumb"] = timed("thumb", lambda: engines.thumb(engines.render(content, 1)))
        if due & {"text", "thumb"}:
            out["created"] = made
            out["pages"] += [{"page": k, "content": t} for k, t in enumerate(texts, 1) if t.strip()]
        if "ocr" in due and engines.ocr and engines.render:  # pages without a text layer
            for k in [k for k, t in enumerate(texts, 1) if not t.strip()]:
                if text := timed("ocr", lambda k=k: read_lines(engines.ocr, engines.render(content, k))):
                    out["pages"].append({"page": k, "content": text})
    elif kind == "docx":
        text, out["created"] = timed("text", lambda: docx_text(content))
        out["pages"] += [{"page": 1, "content": text}] if text.strip() else []
    return out


def extracted(work: DataFrame, root: str, engines: Engines | EngineSource, batch_bytes: int = BATCH_BYTES, batch_files: int = BATCH_FILES, ids: bool = False) -> DataFrame:
    """work: rel_path, kind, todo.  A row a file of ``SCHEMA``: every file is opened once, in the task that its row is in.  With ``ids`` work
    has id, too, and the row begins with it as file_id."""
    names = ["file_id", "rel_path", "error", "ran", "hash", "width", "height", "exif_date", "created", "mtime", "lat_ref", "lat", "lon_ref", "lon", "pages", "faces", "embedding", "thumb", "seconds"]

    def run(batches):
        own = engines_here(engines)
        files, base = file_system(root)

        def read():
            for batch in batches:
                for own_id, path, kind, todo in zip(batch["file_id"], batch["rel_path"], batch["kind"], batch["todo"]):
                    row, content = {"file_id": own_id, "rel_path": path, "ran": list(todo)}, b""
                    try:
                        full = posixpath.join(base, path)
                        with files.open_input_stream(full) as f:
                            content = f.read()
                        row |= {"mtime": files.get_file_info(full).mtime_ns / 1e9, **process(path, kind, list(todo), content, own)}
                    except Exception as e:
                        row, content = {"file_id": own_id, "rel_path": path, "ran": list(todo), "error": f"{type(e).__name__}: {e}"[:500]}, b""
                    yield row, content if "clip" in todo and own.encode and "error" not in row else b""

        for part in in_batches(read(), lambda x: len(x[1]) + len(x[0].get("thumb") or b""), batch_bytes, batch_files):
            waiting = [(row, content) for row, content in part if content]
            if waiting:
                began = time.perf_counter()
                try:
                    for (row, _), v in zip(waiting, own.vectors([c for _, c in waiting])):
                        row["embedding"] = v
                except Exception as e:
                    for row, _ in waiting:
                        row["error"] = f"clip: {type(e).__name__}: {e}"[:500]
                share = (time.perf_counter() - began) / len(waiting)
                for row, _ in waiting:
                    row["seconds"]["clip"] = share
            yield pd.DataFrame([[row.get(n) for n in names] for row, _ in part], columns=names, dtype=object)

    found = work.select((F.col("id") if ids else F.lit(-1)).cast("long").alias("file_id"), "rel_path", "kind", "todo").mapInPandas(run, f"file_id long, {SCHEMA}")
    return found if ids else found.drop("file_id")


def region_faces(boxes: DataFrame, root: str, engines: Engines | EngineSource) -> DataFrame:
    """boxes: key, rel_path, box (drawn by the user), width, height.  key, bbox, det_score, embedding of the face in each box: of the faces
    that the engine finds in the box and its surroundings, zoomed, the one whose centre is nearest to the box's; null columns if there is none."""
    todo = boxes.select("key", "rel_path", "box", geometry.search_region(F.col("box"), F.col("width"), F.col("height")).alias("s"))

    def run(batches):
        own = engines_here(engines)
        files, base = file_system(root)
        for batch in batches:
            rows = []
            for key, path, box, s in zip(batch["key"], batch["rel_path"], batch["box"], batch["s"]):
                found = []
                if s is not None:
                    with files.open_input_stream(posixpath.join(base, path)) as f:
                        found = own.region(f.read(), dict(s["region"]), float(s["zoom"]))
                x, y = box["x"] + box["w"] / 2, box["y"] + box["h"] / 2
                for f in found:  # back to pixels of the picture
                    f |= {n: f[n] / s["zoom"] + s["region"].get({"x": "x0", "y": "y0"}.get(n), 0) for n in "xywh"}
                best = min(found, key=lambda f: (f["x"] + f["w"] / 2 - x) ** 2 + (f["y"] + f["h"] / 2 - y) ** 2, default=None)
                rows.append((key, best and {n: round(best[n]) for n in "xywh"}, best and float(best["score"]), best and [float(v) for v in best["embedding"]]))
            yield pd.DataFrame(rows, columns=["key", "bbox", "det_score", "embedding"], dtype=object)

    from ..functions.vectors import normalise

    kind = todo.schema["key"].dataType.simpleString()
    out = todo.mapInPandas(run, f"key {kind}, bbox struct<x:int,y:int,w:int,h:int>, det_score double, embedding array<float>")
    return out.withColumn("embedding", F.when(F.col("embedding").isNotNull(), normalise(F.col("embedding")).cast("array<float>")))


def file_error() -> Column:
    """The error of an extracted row."""
    fits = geometry.accepted(F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0)))
    return F.when(~fits, "ValueError: too many pixels").otherwise(F.col("error"))


def tables_of(out: DataFrame) -> dict[str, DataFrame]:
    """Results, pages, faces, vectors, seconds and thumbnails of extracted rows (``ROWS``), each by a projection of them."""
    from ..functions.vectors import normalise

    good = out.where("error IS NULL")
    when = dates.resolve_date(F.substring_index("rel_path", "/", -1), F.col("today"), dates.exif_stamp(F.col("exif_date")), F.col("created"), F.col("mtime"))
    place = geo.gps_from_exif(F.col("lat_ref"), F.col("lat"), F.col("lon_ref"), F.col("lon"))
    files = out.withColumns({"d": when, "p": place}).select(
        "rel_path", file_error().alias("error"), "ran", F.col("hash").alias("r_hash"), F.col("d.taken_at").alias("r_taken_at"), F.col("d.date_source").alias("r_date_source"),
        F.col("width").alias("r_width"), F.col("height").alias("r_height"), F.col("p.lat").alias("r_lat"), F.col("p.lon").alias("r_lon"),
    )
    texts = good.select("file_id", F.explode("pages").alias("s")).select(F.col("s.content").alias("content"), "file_id", F.col("s.page").alias("page"))
    box = geometry.box_times(F.col("f"), geometry.working_scale(F.col("width"), F.col("height")))
    faces = detections(good.where("faces IS NOT NULL").select("file_id", "width", "height", F.posexplode("faces").alias("n", "f")).select(
        "file_id", "n", box.alias("bbox"), F.col("f.score").alias("det_score"), normalise(F.col("f.embedding")).cast("array<float>").alias("embedding")
    ))
    vectors = good.where("embedding IS NOT NULL").select("file_id", normalise(F.col("embedding")).cast("array<float>").alias("embedding"))
    return {"files": files, "texts": texts, "faces": faces, "clip_embeddings": vectors, "seconds": good.select("seconds"), "thumbs": good.where("thumb IS NOT NULL").select("file_id", "thumb")}


class Extracted(dict):
    """``raw``, the extracted rows, and the tables made of them, each when it is asked for: their plans take longer to make than a small chunk."""

    def __missing__(self, name: str) -> DataFrame:
        self.update(made := tables_of(self["raw"]))
        return made[name]


def extractor(root: str, engines: Engines | EngineSource, today: date, batch_bytes: int = BATCH_BYTES) -> Callable[[DataFrame], dict[str, DataFrame]]:
    """The extractor that the index driver calls: ``raw``, the extracted rows of a work list, and the tables made of them.

    Nothing is stored here: the driver stores ``raw`` and reads the tables from what it has stored.  Whoever collects several of the tables given
    runs the engines for each."""

    def extract(work: DataFrame) -> dict[str, DataFrame]:
        raw = extracted(work, root, engines, batch_bytes, ids=True).withColumn("today", F.lit(str(today)).cast("date"))
        return Extracted(raw=raw)

    return extract
