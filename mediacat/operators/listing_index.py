"""The plain listing stored in its order, in parts, so that a page is read from the parts that it lies in.

A part is a range of the order newest first (undated last, then by descending id); ``fences`` say what each part holds.  A page is
asked for by cursor, the key of the last row seen, or by offset.  Parts are read from the cursor's on, more and more of them, until the
page is full: no page sorts or skips what lies before it, and without filters an offset is looked up in the fences.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a part, about.
PART_ROWS = 50_000
#: (taken_at, id) of a row.
Cursor = tuple[str | None, int]


@dataclass(frozen=True)
class Listing:
    """rows: the files' columns and part, stored in a folder a part; fences: (part, rows, first key, last key) in order."""

    rows: DataFrame
    fences: tuple[tuple[int, int, Cursor, Cursor], ...]


def _ordered() -> list[Column]:
    return [F.desc_nulls_last("taken_at"), F.desc("id")]


def in_parts(files: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """files with part, the number of the range that the row lies in; rows of a range stay in one task."""
    parts = max(1, -(-files.count() // part_rows))
    return files.repartitionByRange(parts, *_ordered()).sortWithinPartitions(*_ordered()).withColumn("part", F.spark_partition_id())


def fences_of(rows: DataFrame) -> DataFrame:
    """part, n, newest, oldest (struct taken_at, id): a row a part."""
    key = F.struct("taken_at", "id")
    # the order of structs puts nulls first and small ids first, which is this order backwards
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("newest"), F.min(key).alias("oldest"))


def after(cursor: Cursor) -> Column:
    """Whether a row comes after the cursor."""
    at, number = cursor
    if at is None:
        return F.col("taken_at").isNull() & (F.col("id") < number)
    return F.col("taken_at").isNull() | (F.col("taken_at") < at) | ((F.col("taken_at") == at) & (F.col("id") < number))


def _reaches(oldest: Cursor, cursor: Cursor) -> bool:
    """Whether a part whose last row is ``oldest`` has rows after the cursor."""
    if cursor[0] is None or oldest[0] is None:
        return oldest[0] is None and (cursor[0] is not None or oldest[1] < cursor[1])
    return oldest[0] < cursor[0] or oldest[0] == cursor[0] and oldest[1] < cursor[1]


def page(listing: Listing, where: Column | None, limit: int, cursor: Cursor | None = None, offset: int = 0, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``limit`` rows in order after the cursor and ``offset`` more, of those that pass ``where`` and ``keep`` (which may join)."""
    parts = [f for f in listing.fences if cursor is None or _reaches(f[3], cursor)]
    if where is None and cursor is None:  # whole parts can be skipped unread
        while parts and parts[0][1] <= offset:
            offset -= parts[0][1]
            parts = parts[1:]
    many = 1
    while True:
        some = parts[:many]
        found = listing.rows.where(F.col("part").isin([f[0] for f in some]) if some else F.lit(False))
        found = found if cursor is None else found.where(after(cursor))
        found = keep(found if where is None else found.where(where)).orderBy(*_ordered())
        if len(some) == len(parts) or where is None and sum(f[1] for f in some[1 if cursor else 0 :]) >= offset + limit:
            break
        if where is not None and found.limit(offset + limit).count() >= offset + limit:
            break
        many *= 4
    return found.offset(offset).limit(limit) if offset else found.limit(limit)


def next_cursor(hits: DataFrame) -> Cursor | None:
    """The cursor of the page after ``hits`` (one page); None if it is empty."""
    row = hits.agg(F.min(F.struct("taken_at", "id")).alias("k")).first()["k"]
    return (row["taken_at"], row["id"]) if row else None
