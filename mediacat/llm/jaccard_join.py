"""Exact Jaccard join of word-shingle sets, with signature trees inside blocks of shared prefix shingles.

Two sets with enough overlap share a shingle among the first ``n - least overlap + 1`` shingles of each,
whatever total order the shingles have.  The order here puts shingles that very many texts hold last (a
fixed-size table of hash slots, filled over all texts, says which), then goes by hash.

1. Texts become sets; equal sets are one *class*, known by a 64-bit fingerprint.
2. Classes that share a prefix shingle form its block.  Every class is compared exactly with the most
   central class of its blocks; the links found join classes to provisional components.
3. Blocks with two components or more are searched exhaustively: a signature tree over its classes
   (nodes: OR of the members' bitmaps, size range, the one component if there is only one) is traversed
   against itself, and node pairs that cannot hold a link between different components are left out;
   large blocks are dealt in pairs of parts, and a pair needs enough shingles from the block's own on.  Candidate pairs whose
   signatures leave room for enough overlap are compared exactly.
4. Links of 2 and 3 give the components.

Null and empty texts have no shingles and are linked with nothing; repeated rows are one class; very long texts count whole, and
batches and remembered sets are bounded by bytes; blocks whose leader ties take the greatest fingerprint, which changes no
result; other columns are not read, so none can clash; an empty table gives no rows.  No candidate is dropped at any step.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import released, small_batches, stored, text_rows
from .words import mix, shingle_hashes, shingle_sets, slices, word_hashes

#: Bits of the table that picks texts before they are shuffled.
FILTER_BITS = 1 << 23
#: Parts of the hash range whose shingles a class's signature counts.
SIGNATURE = 128
#: Slots of the table of shingle counts, chunks it is cut into, tasks whose tables are added first.
SLOTS, CHUNKS, MERGED = 1 << 22, 16, 64
#: Classes of a block searched by one task; larger blocks are cut into parts, and pairs of parts are tasks.
PART = 2048
LEAF = 16
#: Bytes of sets that a comparing task remembers before it starts afresh.
KNOWN_BYTES = 32 << 20


def least_overlap(n: int | np.ndarray, percent: int):
    """The least intersection of a set of size n with any set it can link to."""
    return -(-(percent * n) // 100)


def pair_overlap(a, b, percent: int):
    """The least intersection that links sets of sizes a and b."""
    return -(-(percent * (a + b)) // (100 + percent))


def frequent_slots(source: DataFrame, size: int) -> np.ndarray:
    """A rank for each slot of shingle hashes: 0 unless the slot is fuller than chance has it.

    Each task counts its shingles in a table of SLOTS numbers; the tables are added up chunk by chunk in rounds, MERGED of
    them at a time, until one is left: no task holds more, however many tasks there are, and at most SLOTS numbers come to the driver."""
    width = SLOTS // CHUNKS

    @released
    def count(batches):
        counts = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for _, texts in slices(batch["text"], batch["doc_id"]):
                words, firsts = word_hashes(texts)
                h = shingle_hashes(words, size)
                inside = np.ones(len(h), bool)
                for k in range(1, size):  # shingles that run into the next text
                    at = firsts[1:] - k
                    inside[at[at >= 0]] = False
                np.add.at(counts, (h[inside] & np.uint64(SLOTS - 1)).astype(np.int64), 1)
        task = TaskContext.get().partitionId()
        own = [zlib.compress(counts[k * width : (k + 1) * width].tobytes(), 1) for k in range(CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([task] * CHUNKS, pa.int32()), pa.array(own, pa.binary())], ["chunk", "task", "counts"])

    def total(table):
        out = np.zeros(width, np.uint64)
        for packed in table["counts"].to_pylist():
            raw = zlib.decompress(packed)
            out += np.frombuffer(raw, np.uint32 if len(raw) == 4 * width else np.uint64)
        return out

    def merge(key, table):
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total(table).tobytes(), 1)], pa.binary())})

    def finish(key, table):
        counts = total(table)
        mean = float(counts.mean())
        full = np.flatnonzero(counts > above_noise(mean, 4))
        rank = 2 * np.log2(counts[full] - mean)
        return pa.table({"slot": pa.array(full + key[0].as_py() * width), "rank": pa.array(rank.astype(np.int32))})

    tables = source.mapInArrow(count, "chunk int, task int, counts binary")
    left = source.rdd.getNumPartitions()
    while left > MERGED:
        tables = tables.groupBy("chunk", F.floor(F.col("task") / MERGED).cast("int").alias("task")).applyInArrow(merge, "chunk int, task int, counts binary")
        left = -(-left // MERGED)
    found = tables.groupBy("chunk").applyInArrow(finish, "slot long, rank int").toArrow()
    ranks = np.zeros(SLOTS, np.uint8)
    ranks[found["slot"].to_numpy()] = found["rank"].to_numpy()
    return ranks


def above_noise(mean: float, sigmas: float) -> float:
    """A count that a slot of rare shingles alone does not reach."""
    return mean + sigmas * mean**0.5 + 4


def sets_with_prefixes(source: DataFrame, size: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """doc_id, h (hash of the text), n (set size), fp (fingerprint, null for the empty set), sig (shingles in each of SIGNATURE parts of
    the hash range, a byte each; null if one has too many), prefix."""

    @released
    def build(batches):
        for batch in batches:
            for where, texts in slices(batch["text"], pa.array(range(len(batch)))):
                n, fps, sigs, prefixes = [], [], [], []
                for s in shingle_sets(texts, size):
                    n.append(len(s))
                    fps.append(fingerprint(s))
                    parts = np.bincount((s >> np.uint64(40)).astype(np.int64) % SIGNATURE, minlength=SIGNATURE)
                    sigs.append(parts.astype(np.uint8).tobytes() if parts.max() < 256 else None)
                    p = len(s) - least_overlap(len(s), percent) + 1 if len(s) else 0
                    r = ranks[(s & np.uint64(SLOTS - 1)).astype(np.int64)]
                    chosen = s[np.lexsort((s, r))[:p]] if r.any() else s[:p]
                    prefixes.append(chosen.view(np.int64))
                offsets = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                values = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(where), batch["h"].take(where), pa.array(n, pa.int64()), pa.array(fps, pa.int64()), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), values)],
                    ["doc_id", "h", "n", "fp", "sig", "prefix"],
                )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.withColumn("h", F.xxhash64("text")).mapInArrow(build, f"doc_id {kind}, h long, n long, fp long, sig binary, prefix array<long>")


def fingerprint(s: np.ndarray) -> int | None:
    if not len(s):
        return None
    total = np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)
    return int(mix(total).view(np.int64)[0])


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b: classes) whose sets link, compared exactly."""
    both = pairs.join(texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), "a"
    )

    @released
    def compare(batches):
        known: dict[int, np.ndarray] = {}
        held = 0  # bytes of sets known from earlier batches
        for batch in batches:
            a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
            if held > KNOWN_BYTES:
                known, held = {}, 0
            for side, column in ((a, batch["text_a"]), (b, batch["text_b"])):
                fresh = {fp: i for i, fp in enumerate(side) if fp not in known}
                if fresh:
                    sets = shingle_sets(column.take(pa.array(list(fresh.values()))), size)
                    known.update(zip(fresh, sets))
                    held += sum(s.nbytes for s in sets)
            hit = []
            for i, (x, y) in enumerate(zip(a, b)):
                s, t = known[x], known[y]
                common = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * common >= percent * (len(s) + len(t) - common):
                    hit.append(i)
            yield pa.RecordBatch.from_arrays([batch["a"].take(pa.array(hit, pa.int64())), batch["b"].take(pa.array(hit, pa.int64()))], ["u", "v"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "u long, v long")


def bitmap(s: np.ndarray) -> bytes:
    """One bit a shingle; twice as many bits as shingles at least, a power of two, so that halves fold on each other."""
    bits = 1 << max(9, int(2 * len(s) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[((s >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def fold(rows: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of bytes) OR-folded to ``width`` bytes."""
    while rows.shape[-1] > width:
        half = rows.shape[-1] // 2
        rows = rows[..., :half] | rows[..., half:]
    return rows


class Node:
    __slots__ = ("low", "high", "bits", "size_low", "size_high", "extra", "rest", "label", "left", "right")

    def __init__(self, low: int, high: int, bits: np.ndarray, sizes: np.ndarray, rests: np.ndarray, extra: np.ndarray, labels: np.ndarray) -> None:
        self.low, self.high = low, high
        self.bits = np.bitwise_or.reduce(bits[low:high], 0)
        self.size_low, self.size_high = int(sizes[low:high].min()), int(sizes[low:high].max())
        self.rest = int(rests[low:high].max())
        self.extra = int(extra[low:high].max())  # shingles of a member beyond its own bits
        self.label = int(labels[low]) if (labels[low:high] == labels[low]).all() else None
        self.left = self.right = None
        if high - low > LEAF:
            mid = (low + high) // 2
            self.left, self.right = (Node(a, b, bits, sizes, rests, extra, labels) for a, b in ((low, mid), (mid, high)))


class SignatureTree:
    """Classes ordered by component and size; ``pairs`` yields all pairs of places (i, j) that may link two components."""

    def __init__(self, sizes: np.ndarray, rests: np.ndarray, labels: np.ndarray, bitmaps: list[bytes]) -> None:
        self.order = np.lexsort((labels, sizes)) if len(set(labels.tolist())) > len(labels) // 2 else np.lexsort((sizes, labels))
        width = min(map(len, bitmaps))
        own = [np.frombuffer(b, np.uint8) for b in bitmaps]
        self.bits = np.stack([fold(own[i], width) for i in self.order])
        self.sizes, self.rests, self.labels = sizes[self.order], rests[self.order], labels[self.order]
        self.counts = np.bitwise_count(self.bits).sum(1).astype(np.int64)
        self.extra = self.sizes - self.counts
        self.root = Node(0, len(self.order), self.bits, self.sizes, self.rests, self.extra, self.labels)


def traverse(x: SignatureTree, y: SignatureTree, percent: int):
    """Pairs of places in x and y that may link; x may be y, and then each pair comes once."""
    same = x is y
    width = min(x.bits.shape[1], y.bits.shape[1])
    xb, yb = fold(x.bits, width), fold(y.bits, width)
    x_extra, y_extra = (t.sizes - np.bitwise_count(b).sum(1).astype(np.int64) for t, b in ((x, xb), (y, yb)))
    grow_x, grow_y = int((x_extra - x.extra).max()), int((y_extra - y.extra).max())
    stack = [(x.root, y.root)]
    while stack:
        a, b = stack.pop()
        if a.label is not None and a.label == b.label:
            continue
        if 100 * a.size_high < percent * b.size_low or 100 * b.size_high < percent * a.size_low:
            continue
        common = int(np.bitwise_count(fold(a.bits, width) & fold(b.bits, width)).sum())
        most = min(common + min(a.extra + grow_x, b.extra + grow_y), a.size_high, b.size_high, a.rest, b.rest)
        if most < pair_overlap(a.size_low, b.size_low, percent):
            continue
        if a.left is None and b.left is None:
            i, j = np.meshgrid(np.arange(a.low, a.high), np.arange(b.low, b.high), indexing="ij")
            ok = x.labels[i] != y.labels[j]
            if same:
                ok &= i < j
            i, j = i[ok], j[ok]
            both = np.bitwise_count(xb[i] & yb[j]).sum(1)
            ok = np.minimum(both + np.minimum(x_extra[i], y_extra[j]), np.minimum(x.rests[i], y.rests[j])) >= pair_overlap(x.sizes[i], y.sizes[j], percent)
            yield x.order[i[ok]], y.order[j[ok]]
        elif b.left is None or (a.left is not None and a.high - a.low >= b.high - b.low):
            if same and a is b:
                stack += [(a.left, a.left), (a.left, a.right), (a.right, a.right)]
            else:
                stack += [(a.left, b), (a.right, b)]
        else:
            stack += [(a, b.left), (a, b.right)]


def sized_pairs(sizes: np.ndarray, rests: np.ndarray, labels: np.ndarray, group: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs in small groups whose sizes allow a link, and whose shingles from the group's own on
    (``rests``) do too: the block of a pair's first common shingle finds it.  Rows come by group, then size.  Each
    small group is a single leaf, and all leaves are searched at once."""
    here = np.arange(len(sizes))
    found_i, found_j = [here[:0]], [here[:0]]
    step = 1
    while len(here):
        here = here[here + step < len(sizes)]
        there = here + step
        ok = (group[here] == group[there]) & (100 * sizes[here] >= percent * sizes[there])  # later ones are larger still
        here, there = here[ok], there[ok]
        differ = (labels[here] != labels[there]) & (np.minimum(rests[here], rests[there]) >= pair_overlap(sizes[here], sizes[there], percent))
        found_i.append(here[differ])
        found_j.append(there[differ])
        step += 1
    return np.concatenate(found_i), np.concatenate(found_j)


def bounded_pairs(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` whose signatures leave room for enough overlap: in each part of the hash range two sets share no more
    shingles than the one with fewer has."""
    signatures = rows.select("fp", "n", "sig").join(both_ends(pairs), "fp", "left_semi").dropDuplicates(["fp"])
    both = pairs.join(signatures.toDF("b", "n_b", "sig_b"), "b").join(signatures.toDF("a", "n_a", "sig_a"), "a")

    @released
    def bound(batches):
        for batch in batches:
            n_a, n_b = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
            keep = np.ones(len(n_a), bool)
            sig_a, sig_b = batch["sig_a"].to_pylist(), batch["sig_b"].to_pylist()
            at = np.array([k for k, (x, y) in enumerate(zip(sig_a, sig_b)) if x is not None and y is not None], np.int64)
            if len(at):
                x, y = (np.frombuffer(b"".join([s[k] for k in at.tolist()]), np.uint8).reshape(len(at), SIGNATURE) for s in (sig_a, sig_b))
                keep[at] = np.minimum(x, y).sum(1, dtype=np.int64) >= pair_overlap(n_a[at], n_b[at], percent)
            where = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch["a"].take(where), batch["b"].take(where)], ["a", "b"])

    return both.select("a", "b", "n_a", "sig_a", "n_b", "sig_b").mapInArrow(bound, "a long, b long")


#: Blocks of so many classes or fewer are one leaf.
SMALL = 64


def search_blocks(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of whole blocks; rows come by (key, i, j) and size, with bitmaps in large blocks."""
    key, i, j, part = (table[c].to_numpy() for c in ("key", "i", "j", "part"))
    fps, sizes, rests, labels = (table[c].to_numpy() for c in ("fp", "n", "rest", "label"))
    begins = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
    counts = np.diff(np.append(begins, len(key)))
    large = table["bits"].is_valid().to_numpy()
    at = np.flatnonzero(~large)
    p, q = sized_pairs(sizes[at], rests[at], labels[at], np.repeat(np.arange(len(begins)), counts)[at], percent)
    found = [(at[p], at[q])]
    for b, c in zip(begins.tolist(), counts.tolist()):
        if not large[b]:
            continue
        bits = table["bits"].slice(b, c).to_pylist()
        trees = {}
        for side in {int(i[b]), int(j[b])}:
            own = np.flatnonzero(part[b : b + c] == side)
            if len(own):
                trees[side] = b + own, SignatureTree(sizes[b + own], rests[b + own], labels[b + own], [bits[k] for k in own.tolist()])
        if int(i[b]) in trees and int(j[b]) in trees:
            (own_x, x), (own_y, y) = trees[int(i[b])], trees[int(j[b])]
            found += [(own_x[s], own_y[t]) for s, t in traverse(x, y, percent)]
    p, q = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    return np.minimum(fps[p], fps[q]), np.maximum(fps[p], fps[q])


def block_pairs(members: DataFrame, signatures: DataFrame | None, percent: int) -> DataFrame:
    """Distinct candidate pairs (a, b) of the blocks: members has key, fp, n, rest, label, c (block size); signatures has fp, bits of the classes
    in large blocks."""
    none = F.lit(None).cast("binary")
    if signatures is None:
        members = members.withColumn("bits", none)
    else:
        large = members.where(F.col("c") > SMALL).join(signatures.select("fp", "bits"), "fp")
        members = members.where(F.col("c") <= SMALL).withColumn("bits", none).unionByName(large)
    dealt = members.withColumn("parts", F.ceil(F.col("c") / PART).cast("int")).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    # a row of part p goes to the tasks (i, j), i <= j, with i = p or j = p
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp", "n", "rest", "label", "bits")

    @released
    def search(batches):
        rest: list[pa.RecordBatch] = []  # rows of a block that may go on in the next batch
        for batch in batches:
            key = [batch[c].to_numpy() for c in ("key", "i", "j")]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], 0)) + 1
            cut = int(new[-1]) if len(new) else 0
            if rest and any(rest[0][c][0].as_py() != batch[c][0].as_py() for c in ("key", "i", "j")) and not cut:
                yield _emit(rest, percent)
                rest = []
            if cut:
                yield _emit([*rest, batch.slice(0, cut)], percent)
                rest = []
            rest.append(batch.slice(cut))
        if rest:
            yield _emit(rest, percent)

    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "fp")
    return ordered.mapInArrow(search, "a long, b long").distinct()


def _emit(batches: list[pa.RecordBatch], percent: int) -> pa.RecordBatch:
    a, b = search_blocks(pa.Table.from_batches(batches), percent)
    pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def texts_of(source: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp, text of the ``wanted`` classes (fp), one row each, stored.

    A class's text is that of its row with the least id.  A bit table of fixed size, over hashes of the texts asked for,
    drops nearly all other texts before anything is shuffled; the join behind it is exact."""
    owners = rows.join(wanted, "fp", "left_semi").groupBy("fp", "doc_id", "h").agg(F.count(F.lit(1)).alias("times"))
    owners = owners.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h", "times")).alias("o"))
    owners = stored(owners.select("fp", F.col("o.doc_id").alias("own"), F.col("o.h").alias("h"), F.col("o.times").alias("times")))
    table = np.zeros(FILTER_BITS, bool)
    slots = owners.select(F.pmod("h", F.lit(FILTER_BITS)).alias("s")).distinct().limit(FILTER_BITS // 2 + 1).toArrow()["s"].to_numpy()
    table[slots] = True
    packed = zlib.compress(np.packbits(table).tobytes(), 1) if len(slots) <= FILTER_BITS // 2 else b""  # a full table filters nothing

    @released
    def pick(batches):
        bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8)) if packed else None
        for batch in batches:
            if bits is None:
                yield batch
            else:
                yield batch.take(pa.array(np.flatnonzero(bits[batch["h"].to_numpy() % FILTER_BITS])))

    kind = source.schema["doc_id"].dataType.simpleString()
    near = source.withColumn("h", F.xxhash64("text")).mapInArrow(pick, f"doc_id {kind}, text string, h long").withColumnRenamed("h", "text_h")
    found = near.join(owners, (near["text_h"] == owners["h"]) & near["doc_id"].eqNullSafe(owners["own"]))
    return stored(found.where("times = 1").select("fp", "text").union(found.where("times > 1").select("fp", "text").dropDuplicates(["fp"])))


def bitmaps(texts: DataFrame, size: int) -> DataFrame:
    """fp, bits: the bitmaps of the classes' sets."""

    @released
    def draw(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["fp"], pa.array([bitmap(s) for s in shingle_sets(batch["text"], size)], pa.binary())], ["fp", "bits"])

    return texts.mapInArrow(draw, "fp long, bits binary")


def both_ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()


def _placed(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row a document: doc_id, h (hash of its text), n (size of its set), root (of its component; null for the empty set)."""
    source = text_rows(docs, id_col, text_col)
    ranks = frequent_slots(source, size)
    rows = stored(sets_with_prefixes(source, size, percent, ranks))
    classes = rows.where("fp IS NOT NULL").groupBy("fp").agg(F.first("prefix").alias("prefix"))
    sizes = rows.where("fp IS NOT NULL").groupBy("fp").agg(F.first("n").alias("n"))
    keyed = classes.select("fp", F.posexplode("prefix").alias("pos", "key"))
    blocks = keyed.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("key")
    members = stored(keyed.join(blocks, "key").join(sizes, "fp"))  # of blocks with two classes or more
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    central = members.join(counts, "key").groupBy("fp").agg(F.sum("c").alias("w"))
    leaders = members.join(central, "fp").groupBy("key").agg(F.max(F.struct("w", "fp", "n")).alias("l"))
    led = members.join(leaders, "key").where((F.col("fp") != F.col("l.fp")) & (100 * F.least("n", "l.n") >= percent * F.greatest("n", "l.n")))
    # near copies share most of their prefixes; links with less in common are left to the search of blocks
    led = led.groupBy("fp", "n", "l").agg(F.count(F.lit(1)).alias("shared")).where(400 * F.col("shared") >= (100 - percent) * F.col("n"))
    pairs = led.groupBy(F.col("fp").alias("b")).agg(F.max(F.struct("shared", "l")).alias("best"))
    pairs = stored(pairs.select(F.col("best.l.fp").alias("a"), "b"))
    links = stored(verified(pairs, texts_of(source, rows, both_ends(pairs)), size, percent))
    roots = components(links)

    labelled = members.join(roots, members["fp"] == roots["node"], "left").select("key", "fp", "n", (F.col("n") - F.col("pos")).alias("rest"), F.coalesce("root", "fp").alias("label"))
    open_ = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key", "c")
    blocked = stored(labelled.join(open_, "key"))
    large = blocked.where(F.col("c") > SMALL)
    signatures = stored(bitmaps(texts_of(source, rows, large.select("fp").distinct()), size)) if not large.isEmpty() else None
    found = stored(block_pairs(blocked, signatures, percent))
    if not found.isEmpty():
        near = stored(bounded_pairs(found, rows, percent))
        roots = components(links.union(stored(verified(near, texts_of(source, rows, both_ends(near)), size, percent))))
    return rows.join(roots, rows["fp"] == roots["node"], "left").select("doc_id", "h", "n", F.coalesce("root", "fp").alias("root"))


def jaccard_components(docs: DataFrame, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest id that links reach, its own included)."""
    with small_batches(docs.sparkSession):
        placed = _placed(docs, size, percent, id_col, text_col)
    ids = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(ids, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a component, and one for each document without words: own, own_hash (id of a document and ``xxhash64`` of its text) and
    times, the number of rows with both.  Of a component it is the row with the smallest id, rows without one last, then the smallest hash."""
    with small_batches(docs.sparkSession):
        placed = _placed(docs, size, percent, id_col, text_col)
    one = placed.groupBy("doc_id", "h", "root").agg(F.count(F.lit(1)).alias("times"))
    least = one.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h", "times")).alias("o")).select("o.*")
    named: list[Column] = [F.col("doc_id").alias("own"), F.col("h").alias("own_hash"), F.col("times")]
    return least.select(named).union(one.where("root IS NULL").select(named))
