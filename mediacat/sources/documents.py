"""Readers of file contents.  Word files need only the standard library; image, PDF and recognition engines are injected."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.vectors import normalise

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> tuple[str, datetime | None]:
    """(paragraphs, then table rows with cells joined by a spaced bar, without blank lines; creation time)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        core = z.read("docProps/core.xml").decode() if "docProps/core.xml" in z.namelist() else ""
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    lines = [text(p) for p in body.findall(f"{_W}p")]
    lines += [" | ".join(text(c) for c in row.findall(f"{_W}tc")) for t in body.iter(f"{_W}tbl") for row in t.findall(f"{_W}tr")]
    made = re.search(r"<dcterms:created[^>]*>([^<]+)<", core)
    stamp = None
    if made:
        stamp = datetime.fromisoformat(made[1].replace("Z", "+00:00"))
        stamp = stamp.astimezone(timezone.utc).replace(tzinfo=None)
    return "\n".join(x for x in lines if x.strip()), stamp


def read_files(files: DataFrame, read: Callable[[str, bytes], Iterator[dict]], schema: str) -> DataFrame:
    """files: rel_path, content.  Rows that ``read(rel_path, content)`` yields, with rel_path and error; a failing file gives one
    row with its error and does not stop the others.  ``schema`` names the reader's own columns."""
    names = [part.split()[0] for part in re.split(r",\s*(?![^<]*>)", schema)]

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["rel_path"], batch["content"]):
                try:
                    rows += [{"rel_path": path, "error": None, **r} for r in read(path, content)]
                except Exception as e:
                    rows.append({"rel_path": path, "error": f"{type(e).__name__}: {e}"[:500]})
            yield pd.DataFrame(rows, columns=["rel_path", "error", *names], dtype=object)

    return files.select("rel_path", "content").mapInPandas(run, f"rel_path string, error string, {schema}")


def read_docx(files: DataFrame) -> DataFrame:
    """One row a Word file: page 1, its text and creation time."""

    def read(path: str, content: bytes):
        text, made = docx_text(content)
        yield {"page": 1, "content": text, "created": made}

    return read_files(files, read, "page int, content string, created timestamp_ntz")


def read_pdf(files: DataFrame, engine: Callable[[bytes], tuple[list[str], datetime | None]]) -> DataFrame:
    """One row a page with text, by an injected engine that gives the pages' texts and the creation time."""

    def read(path: str, content: bytes):
        pages, made = engine(content)
        yield from ({"page": k, "content": t, "created": made, "pages": len(pages)} for k, t in enumerate(pages, 1) if t.strip())

    return read_files(files, read, "page int, content string, created timestamp_ntz, pages int")


def pages_to_render(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """wanted: rel_path, page; counts: rel_path, pages.  ok is false for pages outside 1..pages."""
    return wanted.join(counts, "rel_path", "left").withColumn("ok", F.coalesce(F.col("page").between(1, F.col("pages")), F.lit(False)))


def textless_pages(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """The pages (rel_path, page) without a text layer, which recognition should read."""
    return pages.select("rel_path", "page").join(texts.where(F.trim("content") != "").select("rel_path", "page"), ["rel_path", "page"], "left_anti")


def recognise(images: DataFrame, engine: Callable[[bytes], list[tuple[str, float]]], least: float = 0.5) -> DataFrame:
    """Lines that an injected engine reads with enough confidence, blank ones left out, joined."""

    def read(path: str, content: bytes):
        lines = [t.strip() for t, s in engine(content) if s >= least and t.strip()]
        yield {"content": "\n".join(lines)}

    return read_files(images, read, "content string")


def read_images(files: DataFrame, engine: Callable[[bytes, bool], dict], header_only: bool = False) -> DataFrame:
    """Size, EXIF date and GPS parts by an injected decoder; ``header_only`` asks it to decode no pixels."""

    def read(path: str, content: bytes):
        yield engine(content, header_only)

    return read_files(files, read, "width int, height int, exif_date string, lat_ref string, lat array<double>, lon_ref string, lon array<double>")


def recognised_pages(pages: DataFrame, texts: DataFrame, render: Callable[[bytes, int], bytes], engine: Callable[[bytes], list[tuple[str, float]]], least: float = 0.5) -> DataFrame:
    """pages: rel_path, page, content (of the file).  rel_path, page, content (text) of those without a text layer, rendered and read."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, page, content in zip(batch["rel_path"], batch["page"], batch["content"]):
                text = "\n".join(t.strip() for t, s in engine(render(bytes(content), int(page))) if s >= least and t.strip())
                rows += [(path, page, text)] if text else []
            yield pd.DataFrame(rows, columns=["rel_path", "page", "content"])

    wanted = pages.join(textless_pages(pages, texts), ["rel_path", "page"], "left_semi")
    return wanted.select("rel_path", "page", "content").mapInPandas(run, "rel_path string, page int, content string")


def encode(files: DataFrame, encoder: Callable[[list[bytes]], list[list[float]]]) -> DataFrame:
    """One unit vector a file, by an injected encoder called once a batch."""

    def run(batches):
        for batch in batches:
            vectors = encoder(list(batch["content"]))
            yield pd.DataFrame({"rel_path": batch["rel_path"], "embedding": [[float(x) for x in v] for v in vectors]})

    found = files.select("rel_path", "content").mapInPandas(run, "rel_path string, embedding array<float>")
    return found.withColumn("embedding", normalise(F.col("embedding")).cast("array<float>"))


#: Shares of a face's longer side that are kept around it: in a list of faces, and in a portrait.
LIST_MARGIN, PORTRAIT_MARGIN = 1 / 3, 1 / 2


def face_crops(faces: DataFrame, images: DataFrame, crop: Callable[[bytes, dict], bytes], margin: float = LIST_MARGIN) -> DataFrame:
    """Crops of faces (id, file_id, bbox, det_score) out of images (file_id, content, width, height), the surest first; the box grows by a
    share of its longer side, stays inside the picture, and is cut by an injected engine, a batch of faces at a time."""
    box = geometry.grown(F.col("bbox"), geometry.crop_margin(F.col("bbox"), margin), F.col("width"), F.col("height"))
    rows = faces.join(images, "file_id").select("id", "det_score", box.alias("box"), "content")

    def cut(batches):
        for batch in batches:
            done = [crop(bytes(c), dict(b)) for c, b in zip(batch["content"], batch["box"])]
            yield pd.DataFrame({"id": batch["id"], "det_score": batch["det_score"], "content": done})

    return rows.mapInPandas(cut, "id long, det_score double, content binary").orderBy(F.desc("det_score"), "id")
