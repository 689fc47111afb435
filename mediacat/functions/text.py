"""Foldings, names and small text functions as Column expressions.  Three foldings coexist and must not be mixed."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _bare(ranges: list[tuple[int, int]]) -> tuple[str, str]:
    """Letters with marks, and the single letters left when the marks go; those that expand to more are not in it."""
    pairs = []
    for a, b in ranges:
        for c in map(chr, range(a, b)):
            bare = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
            if len(bare) == 1 and bare != c:
                pairs.append((c, bare))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


MARKS = "".join(map(chr, range(0x300, 0x370)))
_FROM, _TO = _bare([(0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000)])


def strip_marks(text: Column) -> Column:
    """Diacritics off, letter by letter; ß, ø, ł and ligatures stay."""
    return F.translate(text, _FROM + MARKS, _TO)


def fts_fold(text: Column) -> Column:
    """The full-text index's folding."""
    return strip_marks(F.lower(text))


def tokens(text: Column) -> Column:
    """Tokens of the index: runs of letters, digits and private-use characters, folded."""
    return F.array_remove(F.split(fts_fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{Co}]+"), "")


def fts_fold_py(text: str) -> str:
    return text.lower().translate(str.maketrans(_FROM, _TO[: len(_FROM)], MARKS))


def tokens_py(text: str) -> list[str]:
    return [t for t in "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in fts_fold_py(text)).split()]


def fts_query(text: str) -> list[list[str]]:
    """Phrases of a query: each white-space term is one, operators are inert; terms without tokens drop out."""
    return [p for p in map(tokens_py, text.split()) if p]


def fold_name(text: str | None) -> str | None:
    """The folding of people's names: compatibility decomposition, marks off, case folded, white space collapsed."""
    if text is None:
        return None
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(bare.casefold().split())


@F.pandas_udf(StringType())
def fold_name_udf(names: pd.Series) -> pd.Series:  # people are few; nothing built in decomposes
    return names.map(fold_name)


def ui_fold(text: Column) -> Column:
    return F.lower(strip_marks(text))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def nocase(text: Column) -> Column:
    """ASCII-only case folding."""
    return F.translate(text, _UPPER, _LOWER)


def person_name(text: Column) -> Column:
    """Trimmed, and null where nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


#: Fixed value: what counts as white space when runs of it are collapsed.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def collapse(text: Column) -> Column:
    """Runs of white space of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def day_key(taken_at: Column) -> Column:
    return F.substring(taken_at, 1, 10)


def month_key(taken_at: Column) -> Column:
    return F.substring(taken_at, 1, 7)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The lower-cased suffix of the file name with its dot; empty without one, or where the name only begins with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def bbox_parse(text: Column) -> Column:
    parts = F.split(text, ",")
    return F.struct(*[parts[k].cast("int").alias(n) for k, n in enumerate("xywh")])


def bbox_format(box: Column) -> Column:
    return F.concat_ws(",", *[box[n] for n in "xywh"])


def error_text(text: Column) -> Column:
    return F.left(text, F.lit(500))


def stages_text(stages: Column) -> Column:
    return F.array_join(stages, ",")


def stages_array(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), ","), "")


def place_label(city: Column, state: Column, country: Column) -> Column:
    return F.nullif(F.array_join(F.filter(F.array(city, state, country), lambda x: x != ""), ", "), F.lit(""))


def person_reference(text: str) -> tuple[str, int | str | None]:
    """("id", n) for ``#12`` or ``12``, ("name", text) otherwise, ("none", None) if blank."""
    text = text.strip()
    if m := re.fullmatch(r"#?(\d+)", text):
        return "id", int(m[1])
    return ("name", text) if text else ("none", None)


def file_size(size: Column) -> Column:
    """Above one MB in MB with one decimal, halves to the even one (1.25 MB is 1.2 MB), else in whole KB, halves up; null
    without a size.  The decimal is found in whole numbers: ``format_string`` rounds halves up."""
    size = size.cast("long")
    mb, rest = F.shiftright(size, 20), size.bitwiseAND(F.lit((1 << 20) - 1)) * 10
    tenth, left = F.shiftright(rest, 20), rest.bitwiseAND(F.lit((1 << 20) - 1))
    tenth = tenth + F.when((left > 1 << 19) | ((left == 1 << 19) & (tenth % 2 == 1)), 1).otherwise(0)
    return F.when(size > 1 << 20, F.format_string("%d.%d MB", mb + F.when(tenth == 10, 1).otherwise(0), tenth % 10)).when(size.isNotNull(), F.format_string("%d KB", F.floor(size / F.lit(1024.0) + 0.5).cast("long")))


def elapsed(seconds: Column) -> Column:
    return F.when(seconds < 60, F.concat(F.floor(seconds).cast("string"), F.lit(" s"))).otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min")))


def highlights(snippet: Column) -> Column:
    """The marked parts of a snippet."""
    return F.regexp_extract_all(snippet, F.lit(r"\[([^\]]*)\]"), F.lit(1))


def docx_view(texts, most: int = 100_000):
    """texts: file_id, page, content.  The pages from 1 on joined by blank lines, bounded in length."""
    pages = texts.where("page >= 1").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("page", "content"))).alias("p"))
    return pages.select("file_id", F.left(F.array_join("p.content", "\n\n"), F.lit(most)).alias("content"))
