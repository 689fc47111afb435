"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted-shingle check.

Words are runs between white space and ASCII punctuation, A-Z lower-cased.  A document is contaminated by
an item when some window of the item's number of words (the whole document where it is shorter) has a
weighted shingle similarity of ``least`` or more with it: sum of min over sum of max of the shingles'
weights, a shingle's weight being its count over the number of items of the whole benchmark that hold it (1 at least):
with several blocks of items, the holders are counted over all of them first, and each text gets the counts of its shingles.

Windows without any shingle of any item have similarity 0, so only windows around such shingles are
fingerprinted.  Fingerprints have 64 bits in BLOCKS blocks; within RADIUS bits some block differs in one
bit at most, and every block table is probed for those: no fingerprint within the radius is missed.
Items of fewer words than a shingle are one shingle, found by equality.  Null and empty texts and items
match nothing; items that repeat id and text are one; repeated rows are judged one by one; of windows with equal similarity the first
is reported; very long texts are searched whole; other columns are not read, so none can clash; an empty table gives no rows, and
an empty benchmark contaminates nothing.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .shared import carried_columns, carried_part, carried_schema, released, stored, text_rows
from .words import SPACE_OR_PUNCTUATION, mix, shingle_hashes, slices, word_hashes

SHINGLE, LEAST = 5, 0.8
BITS, BLOCKS, RADIUS = 64, 11, 21
#: Items held by a task at once: larger benchmarks are searched in blocks of so many.
ITEM_BLOCK = 20_000
#: And characters of theirs.
ITEM_CHARS = 32 << 20
#: Shingles of several items held by a task at once, where there are several blocks of items.
SHARED_BLOCK = 1 << 20
#: Pairs of a fingerprint and an item looked at together.
PAIRS = 4 << 20
_HIT = np.dtype([("at", "<u4"), ("n", "<u4")])
_EDGES = np.linspace(0, BITS, BLOCKS + 1).astype(int)
_SLOTS = 1 << 20


def simhash(signs: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of rows of 64 sums."""
    return np.packbits(signs > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def bit_signs(shingles: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(mix(shingles).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.float64) * 2 - 1


class HammingIndex:
    """All fingerprints within RADIUS bits of a query, by BLOCKS tables probed within one bit."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        self.tables = []
        for a, b in zip(_EDGES[:-1], _EDGES[1:]):
            table = np.zeros((1 << (b - a), len(prints)), bool)
            key = self._key(prints, a, b)
            for flip in [0, *(1 << k for k in range(b - a))]:
                table[key ^ flip, np.arange(len(prints))] = True
            self.tables.append(table)

    @staticmethod
    def _key(prints: np.ndarray, a: int, b: int) -> np.ndarray:
        return ((prints >> np.uint64(BITS - b)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, print) places of all pairs within the radius, found for as many queries at a time as PAIRS allows."""
        some = max(1, PAIRS // max(len(self.prints), 1))
        found = [np.zeros((2, 0), np.int64)]
        for at in range(0, len(queries), some):
            own = queries[at : at + some]
            near = np.zeros((len(own), len(self.prints)), bool)
            for table, a, b in zip(self.tables, _EDGES[:-1], _EDGES[1:]):
                near |= table[self._key(own, a, b)]
            q, p = np.nonzero(near)
            close = np.bitwise_count(own[q] ^ self.prints[p]) <= RADIUS
            found.append(np.stack([q[close] + at, p[close]]))
        q, p = np.concatenate(found, 1)
        return q, p


class Items:
    """The benchmark as shingle tables, fingerprints and indexes by size."""

    def __init__(self, ids: list[int], texts: list[str], shingle: int, least: float, holders: dict[int, int] | None = None) -> None:
        """``holders``: how many items hold a shingle, where more than one does; by default as many as among these."""
        self.shingle, self.least = shingle, least
        words, firsts = word_hashes(pa.array(texts, pa.string()), SPACE_OR_PUNCTUATION)
        cut = [words[a:b] for a, b in zip(firsts[:-1], firsts[1:])]
        self.short: dict[int, dict[int, list[int]]] = {}
        self.ids, self.sizes, lists = [], [], []
        for i, w in zip(ids, cut):
            if len(w) >= shingle:
                self.ids.append(i)
                self.sizes.append(len(w))
                lists.append(shingle_hashes(w, shingle)[: len(w) - shingle + 1])
            elif len(w):
                self.short.setdefault(len(w), {}).setdefault(int(shingle_hashes(w, len(w))[0]), []).append(i)
        held = Counter(h for s in lists for h in set(s.tolist()))
        self.weights = {h: 1.0 / (n if holders is None else holders.get(h, 1)) for h, n in held.items()}
        self.known = np.array(sorted(held), np.uint64)
        self.weight_of = np.array([self.weights[h] for h in self.known.tolist()])
        self.maybe = np.zeros(_SLOTS, bool)
        self.maybe[(self.known & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
        self.bags = [self.bag(s, self.weight(s)) for s in lists]
        self.totals = [sum(b.values()) for b in self.bags]
        self.by_size: dict[int, list[int]] = defaultdict(list)
        for k, n in enumerate(self.sizes):
            self.by_size[n].append(k)
        prints = [simhash((bit_signs(s) * self.weight(s)[:, None]).sum(0, keepdims=True))[0] for s in lists]
        self.index = {n: HammingIndex(np.array([prints[k] for k in ks], np.uint64)) for n, ks in self.by_size.items()}
        self.sizes_with: dict[int, set[int]] = defaultdict(set)  # of items with the shingle
        for s, n in zip(lists, self.sizes):
            for h in set(s.tolist()):
                self.sizes_with[h].add(n)

    def weight(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.ones(len(shingles))
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return np.where(self.known[at] == shingles, self.weight_of[at], 1.0)

    def bag(self, shingles: np.ndarray, weights: np.ndarray) -> dict[int, float]:
        weight = dict(zip(shingles.tolist(), weights.tolist()))
        return {h: n * weight[h] for h, n in Counter(shingles.tolist()).items()}

    def similarity(self, window: np.ndarray, weights: np.ndarray, item: int) -> float:
        bag, other = self.bag(window, weights), self.bags[item]
        common = sum(min(v, other[h]) for h, v in bag.items() if h in other)
        return common / (sum(bag.values()) + self.totals[item] - common)

    def known_places(self, shingles: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.maybe[(shingles & np.uint64(_SLOTS - 1)).astype(np.int64)])
        if not len(at) or not len(self.known):
            return at[:0]
        k = np.minimum(np.searchsorted(self.known, shingles[at]), len(self.known) - 1)
        return at[self.known[k] == shingles[at]]

    def matches(self, texts: pa.Array, shared: list[bytes] | None = None) -> list[list[tuple[int, int, int, float]]]:
        """For each text its best window of each item that contaminates it: (item id, first word, end word, similarity).

        ``shared``: each text's shingles that several items hold, where other items than these count too."""
        words, firsts = word_hashes(texts, SPACE_OR_PUNCTUATION)
        best: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(len(texts))]

        def found(doc: int, item_id: int, a: int, b: int, similarity: float) -> None:
            if (similarity, -a) > (best[doc].get(item_id, (-1, 0, 0))[0], -best[doc].get(item_id, (-1, 0, 0))[1]):
                best[doc][item_id] = (similarity, a, b)

        for n, table in self.short.items():
            h = shingle_hashes(words, n)
            for p in np.flatnonzero(np.isin(h, np.array(sorted(table), np.uint64))).tolist():
                doc = int(np.searchsorted(firsts, p, "right")) - 1
                if p + n <= firsts[doc + 1]:
                    for item_id in table[int(h[p])]:
                        found(doc, item_id, p - int(firsts[doc]), p - int(firsts[doc]) + n, 1.0)
        shingles = shingle_hashes(words, self.shingle)
        weights = self.weight(shingles) if shared is None else shared_weights(shared, firsts)
        hits = self.known_places(shingles)
        docs = np.searchsorted(firsts, hits, "right") - 1
        inside = hits + self.shingle <= firsts[docs + 1]
        hits, docs = hits[inside], docs[inside]
        for doc in np.unique(docs).tolist():
            first, end = int(firsts[doc]), int(firsts[doc + 1])
            places: dict[int, list[int]] = defaultdict(list)
            for p in hits[docs == doc].tolist() if len(hits) < 1000 else hits[np.searchsorted(docs, doc) : np.searchsorted(docs, doc, "right")].tolist():
                for n in self.sizes_with[int(shingles[p])]:
                    places[n].append(p)
            for n, at in places.items():
                self._windows(shingles, weights, doc, first, end, n, np.array(at), found)
        return [[(i, a, b, s) for i, (s, a, b) in sorted(m.items())] for m in best]

    def _windows(self, shingles, weights, doc, first, end, n, at, found) -> None:
        """Searches the windows of n words that hold a known shingle."""
        if end - first <= n:
            starts, length = np.array([first]), end - first
        else:
            span = n - self.shingle + 1
            starts = np.unique((at[:, None] - np.arange(span)[None, :]).ravel())
            starts, length = starts[(starts >= first) & (starts + n <= end)], n
        width = length - self.shingle + 1  # shingles of a window
        while len(starts):
            cut = np.flatnonzero(np.diff(starts) > width)
            run = starts[: min(int(cut[0]) + 1 if len(cut) else len(starts), 4096)]
            starts = starts[len(run) :]
            low = int(run[0])
            part = shingles[low : int(run[-1]) + width]
            total = np.vstack([np.zeros((1, BITS)), np.cumsum(bit_signs(part) * weights[low : int(run[-1]) + width][:, None], 0)])
            prints = simhash(np.round(total[run - low + width] - total[run - low], 9))
            ks = self.by_size[n]
            for q, p in zip(*(x.tolist() for x in self.index[n].search(prints))):
                a = int(run[q])
                s = self.similarity(shingles[a : a + width], weights[a : a + width], ks[p])
                if s >= self.least:
                    found(doc, self.ids[ks[p]], a - first, a - first + length, s)


def shared_weights(shared: list[bytes], firsts: np.ndarray) -> np.ndarray:
    """The weight of the shingle at each word of texts with these ``shared`` places."""
    out = np.ones(int(firsts[-1]))
    for own, first in zip(shared, firsts[:-1]):
        hit = np.frombuffer(own, _HIT)
        out[int(first) + hit["at"].astype(np.int64)] = 1.0 / hit["n"]
    return out


def shared_shingles(items: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(k, h: block and shingle of each item; h, n: the shingles that several items hold, and how many do)."""

    def cut(batches):
        for batch in batches:
            for where, texts in slices(batch["text"], pa.array(range(len(batch)))):
                words, firsts = word_hashes(texts, SPACE_OR_PUNCTUATION)
                sets = [np.unique(shingle_hashes(words[a:b], shingle)[: b - a - shingle + 1]) if b - a >= shingle else np.zeros(0, np.uint64) for a, b in zip(firsts[:-1], firsts[1:])]
                ks = batch["k"].take(where).take(pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
                yield pa.RecordBatch.from_arrays([ks, pa.array(np.concatenate(sets).view(np.int64))], ["k", "h"])

    own = stored(items.select("k", "text").mapInArrow(cut, "k long, h long"))
    return own, stored(own.groupBy("h").agg(F.count("k").alias("n")).where("n > 1"))


def with_shared(source: DataFrame, shared: DataFrame, shingle: int, shared_block: int) -> DataFrame:
    """``source`` with ``shared``, the places and counts of each text's shingles that several items hold."""
    parts = max(1, -(-shared.count() // shared_block))

    def marked(known: np.ndarray, n: np.ndarray, narrow: bool):
        def mark(batches):
            for batch in batches:
                out = []
                for _, texts in slices(batch["text"], pa.array(range(len(batch)))):
                    words, firsts = word_hashes(texts, SPACE_OR_PUNCTUATION)
                    shingles = shingle_hashes(words, shingle)
                    k = np.minimum(np.searchsorted(known, shingles), max(len(known) - 1, 0))
                    at = np.flatnonzero(known[k] == shingles) if len(known) else np.zeros(0, np.int64)
                    docs = np.searchsorted(firsts, at, "right") - 1
                    at, docs = (x[at + shingle <= firsts[docs + 1]] for x in (at, docs))
                    hit = np.zeros(len(at), _HIT)
                    hit["at"], hit["n"] = at - firsts[docs], n[k[at]]
                    out += [x.tobytes() for x in np.split(hit, np.searchsorted(docs, np.arange(1, len(texts))))]
                if narrow:
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "shared"])
                else:
                    some = pa.array([i for i, x in enumerate(out) if x], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch["row"].take(some), pa.array(out, pa.binary()).take(some)], ["row", "shared"])

        return mark

    found = None
    for k in range(parts):
        block = shared.where(F.pmod(F.xxhash64("h"), F.lit(parts)) == k).toArrow()  # of a bounded size
        known, n = block["h"].to_numpy().view(np.uint64), block["n"].to_numpy()
        order = np.argsort(known)
        if parts == 1:
            return source.mapInArrow(marked(known[order], n[order], True), StructType([*source.schema, StructField("shared", BinaryType())]))
        one = source.select("row", "text").mapInArrow(marked(known[order], n[order], False), "row long, shared binary")
        found = one if found is None else found.union(one)
    found = found.groupBy("row").agg(F.concat_ws("", F.collect_list(F.hex("shared"))).alias("shared"))
    return stored(source.join(found, "row", "left").withColumn("shared", F.coalesce(F.unhex("shared"), F.lit(b""))).select(*source.columns, "shared"))


def decontamination(
    docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", item_block: int = ITEM_BLOCK, carry: list[str] | None = None,
    shared_block: int = SHARED_BLOCK,
) -> DataFrame:
    """One row a document: doc_id, contaminated, matches (array of item_id, start, end, similarity; words of the document),
    and ``carried`` if columns are to come along."""
    source = text_rows(docs, id_col, text_col, carry).withColumn("row", F.monotonically_increasing_id())
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    held = items.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    parts = max(1, -(-held[0] // item_block), -(-(held[1] or 0) // ITEM_CHARS))
    kind = source.schema["doc_id"].dataType.simpleString()
    along = ["text", "carried"] if carry else []
    names = ["doc_id", "row", "matches", *(["text", "carried"] if carry else [])]
    match = "array<struct<item_id: long, start: long, end: long, similarity: double>>"

    def against(shared: Broadcast):
        @released
        def search(batches):
            own = shared.value
            for batch in batches:
                for where, texts in slices(batch["text"], pa.array(range(len(batch)))):
                    counted = batch["shared"].take(where).to_pylist() if "shared" in batch.schema.names else None
                    got = [[dict(zip(("item_id", "start", "end", "similarity"), m)) for m in x] for x in own.matches(texts, counted)]
                    kind_ = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("similarity", pa.float64())]))
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].take(where), batch["row"].take(where), pa.array(got, kind_), *carried_part(batch, where)], names)

        return search

    items = items.withColumn("k", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("long"))
    if parts > 1:
        source = stored(source)  # the row numbers must be the same for each block of items
        shingles, several = shared_shingles(items, shingle)
        source = with_shared(source, several, shingle, shared_block)
    found = None
    for k in range(parts):
        block = items.where(F.col("k") == k).orderBy("item_id", "text").collect()  # of a bounded size
        holders = None
        if parts > 1:
            held = several.join(shingles.where(F.col("k") == k).select("h"), "h", "left_semi").toArrow()
            holders = dict(zip(held["h"].to_numpy().view(np.uint64).tolist(), held["n"].to_pylist()))
        own = Items([r["item_id"] for r in block], [r["text"] for r in block], shingle, least, holders)
        one = source.mapInArrow(against(docs.sparkSession.sparkContext.broadcast(own)), f"doc_id {kind}, row long, matches {match}{carried_schema(source)}")
        found = one if found is None else found.union(one)
    if parts > 1:
        found = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in along], F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), "matches", *carried_columns(carry, text_col))
