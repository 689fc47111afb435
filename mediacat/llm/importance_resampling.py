"""Importance resampling of documents towards a target text, by hashed n-grams and CRC combination.

A feature is a run of one to ``most_words`` consecutive words joined by one space; its bucket is the CRC-32 of its
bytes modulo the number of buckets.  Each word's CRC is computed once.  CRC-32 is linear over GF(2): with S(n) the
matrix that shifts a register by n zero bytes, crc(x + y) = S(len y) crc(x) xor crc(y), so the CRC of every longer run
follows from those of its words and their lengths, and no n-gram is ever spelled out.

A document's weight is the floored mean of the gains of its features' buckets; Gumbel noise out of the id turns the
highest scores into a draw without replacement.  Two passes over the texts: bucket counts (added up in each task
before the shuffle, a table of fixed size), then weights.  Ranks come from a sort by ranges of the rows above the
cut, without a window over all rows; the cut comes from a histogram of the scores, which are small integers.

Null and empty texts have no features and weight 0; very long texts count whole; a null id is hashed as no text and comes
last among equals; rows that repeat an id have the same noise, and ties of score and id go to fewer features, then to either,
since such rows are alike in all columns; an empty table gives no rows, and an empty target leaves the gains to the smoothing.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import released, stored, text_rows
from .words import _LOWER, buffers, slices, word_spans

#: Bytes that part words: all ASCII but digits and letters.  Upper-case letters are lowered before.
BETWEEN = np.zeros(256, bool)
BETWEEN[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: Words up to this many bytes are hashed side by side, longer ones one by one.
SHORT = 48


def _byte_table() -> np.ndarray:
    """The CRC register after each byte value, from the reflected polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c.astype(np.uint32)


BYTE = _byte_table()


class Shift:
    """The matrix S(n) as four tables of 256 columns' sums, one for each byte of the register."""

    def __init__(self, columns: np.ndarray) -> None:
        self.columns = columns  # image of each of the 32 bits
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        self.tables = np.stack([np.bitwise_xor.reduce(np.where(bits, columns[8 * k : 8 * k + 8], np.uint32(0)), axis=1) for k in range(4)])

    def __call__(self, crc: np.ndarray) -> np.ndarray:
        t = self.tables
        return t[0][crc & 255] ^ t[1][(crc >> 8) & 255] ^ t[2][(crc >> 16) & 255] ^ t[3][crc >> 24]


@functools.cache
def power(k: int) -> Shift:
    """S(2^k), by squaring."""
    if k:
        half = power(k - 1)
        return Shift(half(half.columns))
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    return Shift(BYTE[unit & 255] ^ (unit >> np.uint32(8)))


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """S(length) applied to each CRC: one table step for every binary digit of the lengths."""
    crc, left, k = crc.copy(), lengths.copy(), 0
    while len(left) and left.any():
        odd = np.flatnonzero(left & 1)
        crc[odd] = power(k)(crc[odd])
        left >>= 1
        k += 1
    return crc


def word_crcs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, once: the k-th byte of all words at a time."""
    sizes = ends - starts
    order = np.argsort(-np.minimum(sizes, SHORT + 1), kind="stable")
    by_size = sizes[order]
    long = int(np.searchsorted(-by_size, -SHORT, "left"))
    out = np.zeros(len(starts), np.uint32)
    for i in order[:long]:
        out[i] = zlib.crc32(raw[starts[i] : ends[i]])
    rest, by_size = order[long:], by_size[long:]
    register, begins = np.full(len(rest), 0xFFFFFFFF, np.uint32), starts[rest]
    for k in range(int(by_size[0]) if len(rest) else 0):
        n = int(np.searchsorted(-by_size, -k, "left"))  # words longer than k
        register[:n] = BYTE[(register[:n] ^ raw[begins[:n] + k]) & 255] ^ (register[:n] >> np.uint32(8))
    out[rest] = ~register
    return out


SPACE_CRC = np.uint32(zlib.crc32(b" "))


def features(texts: pa.Array, most_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC of every feature, text of every feature, number of words of each text)."""
    raw, offsets = buffers(texts)
    raw = _LOWER[raw]
    starts, ends, firsts = word_spans(raw, offsets, BETWEEN)
    sizes, crc = ends - starts, word_crcs(raw, starts, ends)
    owner = np.repeat(np.arange(len(texts)), np.diff(firsts))
    spaced = shifted(np.full(len(crc), SPACE_CRC, np.uint32), sizes) ^ crc  # of " word"
    run, crcs, owners = crc, [crc], [owner]
    for n in range(1, most_words):
        if n >= len(crc):
            break
        run = shifted(run[:-1], sizes[n:] + 1) ^ spaced[n:]
        inside = owner[n:] == owner[:-n]
        crcs.append(run[inside])
        owners.append(owner[n:][inside])
    return np.concatenate(crcs), np.concatenate(owners), np.diff(firsts)


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = 10_000, most_words: int = 2) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket; buckets without any are missing."""

    @released
    def count(batches):
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in slices(batch["text"], batch["text"]):
                n += np.bincount((features(texts, most_words)[0] % np.uint32(buckets)).astype(np.int64), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["bucket", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = 10_000, most_words: int = 2) -> np.ndarray:
    """Gain of each bucket in thousandths of the log of the ratio of smoothed shares, target over ``docs``.

    The two tables of counts have at most ``buckets`` rows each, whatever the corpus."""
    held = []
    for part in (docs, target):
        n = np.zeros(buckets, np.int64)
        for r in bucket_counts(part, text_col, buckets, most_words).collect():
            n[r["bucket"]] = r["n"]
        held.append(n)
    s, t = held
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", most_words: int = 2) -> DataFrame:
    """One row a document: doc_id, n_words, n_features, weight (mean gain, floored; 0 without features)."""
    source = text_rows(docs, id_col, text_col)

    @released
    def weigh(batches):
        for batch in batches:
            for ids, texts in slices(batch["text"], batch["doc_id"]):
                crc, owner, words = features(texts, most_words)
                n = np.bincount(owner, minlength=len(texts)).astype(np.int64)
                order = np.argsort(owner, kind="stable")
                sums = np.concatenate(([0], np.cumsum(gain[crc[order] % np.uint32(len(gain))])))  # whole numbers: exact
                last = np.cumsum(n)
                mean = (sums[last] - sums[last - n]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int64)) for x in (words, n, mean))], ["doc_id", "n_words", "n_features", "weight"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = 7) -> Column:
    """Gumbel noise in thousandths, floored, out of the first eight hexadecimal digits of the hash of ``seed:id``."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def drawn(scored: DataFrame, percent: int = 25, least_words: int = 20) -> DataFrame:
    """``scored`` (doc_id, n_words, n_features, weight, score; a stored table, read three times) with the rank of the ``percent`` of the rows of
    at least ``least_words`` words that score highest; the other rows have no rank.

    Scores are integers between the least and the greatest gain plus the range of the noise, some ten thousands of them, so
    their histogram is of bounded size.  Only rows from the score of the last rank up are sorted, by ranges."""
    able = F.col("n_words") >= least_words
    counts = scored.where(able).groupBy("score").count().orderBy(F.desc("score")).collect()
    total = sum(r["count"] for r in counts)
    take, cut, seen = total * percent // 100, None, 0
    for r in counts:
        if seen >= take:
            break
        cut, seen = r["score"], seen + r["count"]
    ranked = F.lit(False) if cut is None else able & (F.col("score") >= cut)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    spread = F.xxhash64(F.monotonically_increasing_id())  # rows alike in all else may go to several ranges
    ranges = scored.where(ranked).withColumn("spread", spread).repartitionByRange(*order, F.asc("spread")).sortWithinPartitions(*order, F.asc("spread"))
    place = stored(ranges.drop("spread").withColumn("at", F.monotonically_increasing_id()))  # task in the upper bits, row in the lower 33
    task = F.shiftright("at", 33)
    tasks = place.groupBy(task.alias("task")).count()  # a row a task of the sort
    before = tasks.select("task", (F.sum("count").over(Window.orderBy("task")) - F.col("count")).alias("before"))
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    first = place.withColumn("task", task).join(F.broadcast(before), "task").select(*columns, F.when(rank <= take, rank).alias("rank"))
    return first.union(scored.where(~ranked).select(*columns, F.lit(None).cast("long").alias("rank")))


def importance_resampling(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, most_words: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row a document: doc_id, n_words, n_features, weight, score, rank (1 for the first drawn; null where not drawn)."""
    gain = gains(docs, target, text_col, buckets, most_words)
    weighed = weights(docs, gain, id_col, text_col, most_words)
    scored = stored(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    return drawn(scored, percent, least_words)
