"""Vector arithmetic in double precision as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def literal(vector: list[float]) -> Column:
    """The vector as one expression: a call for each number would take longer than the search."""
    return F.expr(f"array({', '.join(f'{float(x)!r}D' for x in vector)})") if vector else F.array().cast("array<double>")


def normalise(a: Column) -> Column:
    """The vector over its norm.  The norm is the end of the sum, which is made once: beside each number it would be made again for each."""
    over = lambda s: F.transform(a, lambda x: x.cast("double") / F.greatest(F.sqrt(s), F.lit(1e-12)))
    return F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x, over)


def has_signature(a: Column) -> Column:
    """False for the zero vector, which stands for a face without signature."""
    return F.exists(a, lambda x: x != 0)


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes over their union; 0 when the union is."""
    w = F.greatest(F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]), F.lit(0))
    h = F.greatest(F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]), F.lit(0))
    union = a["w"] * a["h"] + b["w"] * b["h"] - w * h
    return F.when(union > 0, (w * h) / union).otherwise(F.lit(0.0))


def number(value: Column) -> Column:
    """A positive number, or null for what is none."""
    x = F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double")
    return F.when(~F.isnan(x) & (x > 0), x)


def short_number(x: Column) -> Column:
    """Up to six significant digits without trailing zeros."""
    return F.regexp_replace(F.format_string("%.6g", x), r"(?:\.0+|(\.[0-9]*?)0+)$", "$1")


def exif_description(e: Column) -> Column:
    """Label and value pairs of an EXIF struct (make, model, lens, exposure, aperture, iso, focal, focal35, flash, software), absent ones
    left out."""
    exposure, aperture, iso, focal, focal35 = (number(e[n]) for n in ("exposure", "aperture", "iso", "focal", "focal35"))
    pair = lambda label, value: F.when(value.isNotNull(), F.struct(F.lit(label).alias("label"), value.alias("value")))
    text = lambda c: F.nullif(F.btrim(c, F.lit("\x00 ")), F.lit(""))
    none = F.lit(None).cast("string")
    wide = F.when(focal35.isNotNull(), F.format_string(" (%.0f mm equiv.)", focal35)).otherwise("")
    return F.array_compact(
        F.array(
            pair("Camera", F.nullif(F.concat_ws(" ", text(e["make"]), text(e["model"])), F.lit(""))),
            pair("Lens", text(e["lens"])),
            pair("Exposure", F.when(exposure.isNull(), none).when(exposure < 1, F.format_string("1/%d s", F.bround(1 / exposure).cast("long"))).otherwise(F.concat(short_number(exposure), F.lit(" s")))),
            pair("Aperture", F.when(aperture.isNotNull(), F.format_string("f/%.1f", aperture))),
            pair("ISO", F.when(iso.isNotNull(), F.format_string("%.0f", iso))),
            pair("Focal length", F.when(focal.isNotNull(), F.concat(F.format_string("%.1f mm", focal), wide))),
            pair("Flash", F.when(e["flash"].isNotNull(), F.when(e["flash"].bitwiseAND(1) == 1, "fired").otherwise("not fired"))),
            pair("Software", text(e["software"])),
        )
    )
