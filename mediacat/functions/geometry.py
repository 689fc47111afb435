"""Sizes and boxes of pictures: thumbnails, working copies, face crops and the encoder's input, as Column expressions; and the
arithmetic on decoded pixels that goes with them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType

#: Longest sides of thumbnail, working copy and preview, pixels above which a picture is refused.
THUMB, WORK, PREVIEW, MOST_PIXELS = 256, 1600, 2560, 300_000_000
#: The encoder's input side, its means and deviations a channel, its context length and padding id.
SIDE, CONTEXT, PAD = 224, 77, 1
MEAN, STD = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)
#: Side of a drawn box when it is searched, and the least side of the region around it.
ZOOMED, LEAST_REGION = 200, 8


def oriented(width: Column, height: Column, orientation: Column) -> Column:
    """struct(w, h) after the EXIF orientation: 5 to 8 turn the picture by a quarter."""
    turned = F.coalesce(orientation.between(5, 8), F.lit(False))
    return F.struct(F.when(turned, height).otherwise(width).alias("w"), F.when(turned, width).otherwise(height).alias("h"))


def accepted(width: Column, height: Column) -> Column:
    return width.cast("long") * height <= MOST_PIXELS


def scaled(width: Column, height: Column, side: int) -> Column:
    """struct(w, h) that fits into a square of ``side`` without changing the shape; smaller pictures stay as they are."""
    longest = F.greatest(width, height)
    part = lambda x: F.greatest(F.round(x * F.lit(float(side)) / longest), F.lit(1)).cast("int")
    small = longest <= side
    return F.struct(F.when(small, width).otherwise(part(width)).cast("int").alias("w"), F.when(small, height).otherwise(part(height)).cast("int").alias("h"))


def working_scale(width: Column, height: Column) -> Column:
    """Original over working size: what boxes found on the working copy are multiplied by."""
    longest = F.greatest(width, height)
    return F.when(longest <= WORK, F.lit(1.0)).otherwise(longest / F.lit(float(WORK)))


def box_times(box: Column, scale: Column) -> Column:
    """A box found on the working copy in pixels of the original, rounded half to even."""
    return F.struct(*[F.bround(box[n] * scale).cast("int").alias(n) for n in "xywh"])


def grown(box: Column, margin: Column, width: Column, height: Column) -> Column:
    """struct(x0, y0, x1, y1): the box with a margin on all sides, inside the picture."""
    zero = F.lit(0)
    return F.struct(
        F.greatest(zero, box["x"] - margin).alias("x0"), F.greatest(zero, box["y"] - margin).alias("y0"),
        F.least(width, box["x"] + box["w"] + margin).alias("x1"), F.least(height, box["y"] + box["h"] + margin).alias("y1"),
    )


def crop_margin(box: Column, share: float) -> Column:
    return F.floor(F.greatest(box["w"], box["h"]) * share).cast("int")


def search_region(box: Column, width: Column, height: Column) -> Column:
    """struct(region, zoom) that a drawn box is searched in: half its longer side as margin, zoomed to ``ZOOMED`` pixels; null if too small."""
    r = grown(box, F.floor(F.greatest(box["w"], box["h"]) / 2).cast("int"), width, height)
    zoom = F.lit(float(ZOOMED)) / F.greatest(box["w"], box["h"], F.lit(1))
    return F.when((r["x1"] - r["x0"] >= LEAST_REGION) & (r["y1"] - r["y0"] >= LEAST_REGION), F.struct(r.alias("region"), zoom.alias("zoom")))


def encoder_crop(width: Column, height: Column) -> Column:
    """struct(w, h, left, top): the size whose shorter side is ``SIDE``, and the place of the centre crop, halves rounded to even."""
    wide = width > height
    w = F.when(wide, F.floor(F.lit(SIDE) * width / height)).otherwise(SIDE).cast("int")
    h = F.when(wide, SIDE).otherwise(F.floor(F.lit(SIDE) * height / width)).cast("int")
    return F.struct(w.alias("w"), h.alias("h"), F.bround((w - SIDE) / 2).cast("int").alias("left"), F.bround((h - SIDE) / 2).cast("int").alias("top"))


def _cubic(n: int, to: int) -> np.ndarray:
    """The (to, n) matrix of antialiased bicubic resampling (a = -0.5)."""
    scale = max(n / to, 1.0)
    centre = (np.arange(to) + 0.5) * n / to
    x = np.abs((np.arange(n)[None, :] + 0.5 - centre[:, None]) / scale)
    weight = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))
    return weight / weight.sum(1, keepdims=True)


def encoder_input(pixels: np.ndarray) -> np.ndarray:
    """(3, SIDE, SIDE) normalised floats of (height, width, 3) bytes: shorter side to ``SIDE``, centre crop."""
    h, w = pixels.shape[:2]
    to_w, to_h = (SIDE, SIDE * h // w) if w <= h else (SIDE * w // h, SIDE)
    rows = np.clip(np.rint(np.einsum("ij,hjc->hic", _cubic(w, to_w), pixels.astype(np.float64))), 0, 255)
    out = np.clip(np.rint(np.einsum("ij,jwc->iwc", _cubic(h, to_h), rows)), 0, 255)
    left, top = round((to_w - SIDE) / 2), round((to_h - SIDE) / 2)
    out = out[top : top + SIDE, left : left + SIDE] / 255.0
    return ((out - np.array(MEAN)) / np.array(STD)).transpose(2, 0, 1).astype(np.float32)


def encoder_ids(path: str, length: int = CONTEXT, pad: int = PAD) -> Callable[[list[str | None]], list[list[int]]]:
    """What turns texts into ids under a tokenizer file: white space collapsed, cut and padded to ``length``.  The file is read at the first call."""
    loaded = []

    def encode(texts: list[str | None]) -> list[list[int]]:
        if not loaded:
            from tokenizers import Tokenizer

            loaded.append(Tokenizer.from_file(path))
            loaded[0].enable_truncation(length)
            loaded[0].enable_padding(pad_id=pad, length=length)
        return [e.ids for e in loaded[0].encode_batch([" ".join((t or "").split()) for t in texts])]

    return encode


def encoder_tokens(text: Column, path: str, length: int = CONTEXT, pad: int = PAD) -> Column:
    """The same as a column."""
    ids = encoder_ids(path, length, pad)

    @F.pandas_udf(ArrayType(LongType()))
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(ids(texts.tolist()))

    return encode(text)


def text_encoder(path: str, model: Callable[[list[int]], list[float]], length: int = CONTEXT, pad: int = PAD) -> Callable[[str], list[float]]:
    """What a search encodes its text with: ids under the tokenizer file, the model's vector of them, scaled to unit length."""
    ids = encoder_ids(path, length, pad)

    def encode(text: str) -> list[float]:
        v = np.asarray(model(ids([text])[0]), np.float64)
        return (v / max(float(np.sqrt(v @ v)), 1e-12)).tolist()

    return encode


def to_blob(vector: Column) -> Column:
    """A vector as little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return pack(vector)


def from_blob(blob: Column) -> Column:
    """The vector of little-endian 32-bit floats."""

    @F.pandas_udf(ArrayType(FloatType()))
    def unpack(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return unpack(blob)
