"""Alignment of two tokenizers over the bytes of whole texts, and how good each link of two ids is corpus-wide.

A and B tokens of a text cover the same bytes.  Places where both end cut them into groups, and an A and a B token that
share a byte are linked.  An id pair's count is the number of documents that hold it linked; a link is best if no pair of its A
id has a higher count.

Both tokenizers cut at white space that follows other characters, so texts are cut there and each distinct chunk is
aligned once; texts with a character that a piece of B holds after another kind of character are aligned whole.

The tokens become a stored table in one pass.  A slice of documents gives one row of digests and, for each A id in it, one row of postings
(B ids, documents, multiplicities as packed numbers); a task gives its pair counts, added up, a row an A id.  Then, by A id:

1. The tasks' counts are added up, a table of at most as many rows as A has ids, each of at most as many entries as B has.
2. Postings are cogrouped with these counts, as one stream sorted so that an id's counts come before its postings: memory holds the
   counts of one id, Spark's sort spills.  Ids with more postings than a task's share go to several tasks, each of which gets their counts.
3. Each task adds up contributions slice by slice and gives them out in parts of bounded size; they are added up by document
   in a second stream sorted by slice, where the digests come first.

Null and empty texts have no tokens, nor have texts whose tokens do not spell them (zeros, empty ``groups_sha256``); very long texts count
whole; repeated rows are documents of their own and count as such; ties for the highest count are all best; an empty table
gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released, small_batches, stored, text_rows
from .token_counts import PRETOKEN, WHITE, byte_symbols
from .words import slices

#: Chunks that a task remembers, chunks longer than this are not; distinct pairs and documents' sums that a task holds before it gives
#: them out.  Memory depends on them, results do not.
CACHE_CHUNKS, CACHE_CHARS, HELD_PAIRS, HELD_SUMS = 300_000, 64, 2_000_000, 1_000_000
#: Words that are encoded at a time.
LINE = 1024
_B_BITS, _DOC_BITS = 20, 22


def packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers of equal length, each at the least width that holds it."""
    out = [len(columns[0]).to_bytes(4, "little")]
    for x in columns:
        top = int(x.max(initial=0))
        width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
        out += [bytes([width]), x.astype(f"<u{width}").tobytes()]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:4], "little"), 4, []
    while at < len(data):
        width = data[at]
        out.append(np.frombuffer(data, f"<u{width}", n, at + 1).astype(np.int64))
        at += 1 + n * width
    return out


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind, width: tuple[int, ...] = ()) -> None:
        self.n, self.held = 0, np.zeros((1024, *width), kind)

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.held):
            more = np.zeros((max(2 * len(self.held), self.n + len(x)), *self.held.shape[1:]), self.held.dtype)
            more[: self.n] = self.held[: self.n]
            self.held = more
        self.held[self.n : self.n + len(x)] = x
        self.n += len(x)


def _ends(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of parts of these sizes."""
    ends = np.cumsum(sizes)
    return ends - sizes, ends


class Aligner:
    """Aligned chunks of texts: ids of both sides, groups and links."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        held = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.a_bytes = [held.get(i, b"") for i in range(max(held) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(self.a_bytes) > 1 << (62 - _B_BITS - _DOC_BITS) or len(self.b_bytes) > 1 << _B_BITS:
            raise ValueError("the vocabularies are too large")
        self.ranks = self._ranked(a_path)
        self.space = self.b.piece_to_id("▁")
        # white space that a piece holds together with something else; a space may only begin a piece
        plain = [p.replace("▁", " ") for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        white = re.compile(f"[{WHITE}]")
        mixed = {c for p in plain if len(p) > 1 for c in white.findall(p) if c != " "}
        if any(" " in p.lstrip(" ") for p in plain):
            mixed.add(" ")
        self.whole = re.compile(f"[{''.join(map(re.escape, sorted(mixed)))}]") if mixed else None
        self.word = re.compile(f" [^{WHITE}▁]+")
        self.cut = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_opens, self.b_opens = np.array([x[:1] == b" " for x in self.a_bytes]), np.array([p[:1] == "▁" for p in pieces])
        # each id with what follows it: another one of its side, the other side, the next group, nothing
        self.spelled = np.array([[f"{i}{c}" for i in range(max(len(self.a_bytes), len(self.b_bytes)))] for c in (",", "|", ";", "")], object)
        self.known: dict[str, int] = {}
        self._clear()

    def _ranked(self, path: str):
        """An encoder of the same vocabulary that is several times faster, where ids are in the order of the merges; else None."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        joined = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in merges]
        cut = spec.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not spec.get("normalizer")
        if not plain or joined != list(range(256, 256 + len(merges))) or sorted(vocab.values()) != list(range(len(vocab))):
            return None
        return tiktoken.Encoding("ranked", pat_str=PRETOKEN, mergeable_ranks={self.a_bytes[i]: i for i in vocab.values()}, special_tokens={})

    def _clear(self) -> None:
        self.known.clear()
        self.groups: list[str] = []
        self.table = Grown(np.int64, (4,))  # A tokens, B tokens, groups and links of each chunk; all 0 if its tokens do not spell it
        self.begins, self.links = Grown(np.int64), Grown(np.int64)  # first link of each chunk; A id and B id of each link as one number

    def chunks(self, text: str) -> list[str]:
        """Parts of the space and the text, each aligned by itself."""
        spaced = " " + text
        return [spaced] if self.whole and self.whole.search(spaced) else self.cut.findall(spaced)

    def _a_ids(self, text: str) -> list[int]:
        return self.ranks.encode_ordinary(text) if self.ranks else self.a.encode(text, add_special_tokens=False).ids

    def _b_ids(self, chunk: str) -> list[int]:
        """The chunk's first space is the one that this tokenizer puts first, before any text but the empty one."""
        if chunk[0] == " ":
            return self.b.encode(chunk[1:]) if len(chunk) > 1 else [self.space]
        ids = self.b.encode(chunk)
        return ids[1:] if ids[0] == self.space else ids

    def _coded(self, chunks: list[str]) -> Iterator[tuple[list[str], tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]:
        """Parts of the chunks with (all ids, ids of each chunk) of A and of B.  Words after one space are encoded many at a time: each
        begins where a token begins with a space."""
        words, rest = [], []
        for c in chunks:
            (words if self.word.fullmatch(c) else rest).append(c)
        for at in range(0, len(words), LINE):
            part = words[at : at + LINE]
            line = "".join(part)
            sides = []
            for ids, opens in ((self._a_ids(line), self.a_opens), (self.b.encode(line[1:]), self.b_opens)):
                flat = np.array(ids, np.int64)
                begins = np.flatnonzero(opens[flat])
                if len(begins) == len(part) and begins[0] == 0:
                    sides.append((flat, np.diff(np.append(begins, len(flat)))))
            if len(sides) == 2:
                yield part, *sides
            else:
                rest += part
        for at in range(0, len(rest), LINE):
            part = rest[at : at + LINE]
            lists = [[encode(c) for c in part] for encode in (self._a_ids, self._b_ids)]
            yield part, *((np.fromiter(chain.from_iterable(x), np.int64), np.array([len(ids) for ids in x], np.int64)) for x in lists)

    def _align(self, chunks: list[str], a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> None:
        """Aligns chunks that their tokens spell, as one run of bytes, and remembers them; the others are remembered as not spelled."""
        (a_ids, a_n), (b_ids, b_n) = a, b
        data = "".join(chunks).encode()
        if any(b"".join(map(held.__getitem__, ids.tolist())) != data for held, ids in ((self.a_bytes, a_ids), (self.b_bytes, b_ids))):
            self._align_apart(chunks, a, b)
            return
        a_begin, a_end = _ends(self.a_size[a_ids])
        b_end = np.cumsum(self.b_size[b_ids])
        # B tokens of each A token: from the first that ends after its start to the first that ends at its end or later
        first, last = np.searchsorted(b_end, a_begin, "right"), np.searchsorted(b_end, a_end, "left")
        n = last - first + 1
        begin, _ = _ends(n)
        links = (np.repeat(a_ids, n) << _B_BITS) | b_ids[np.repeat(first - begin, n) + np.arange(int(n.sum()))]
        a_closes, b_closes = b_end[last] == a_end, np.zeros(len(b_ids), bool)
        b_closes[last[a_closes]] = True
        of = lambda closes: np.concatenate(([0], np.cumsum(closes)[:-1]))  # noqa: E731  group of each token
        side = np.concatenate((2 * of(a_closes), 2 * of(b_closes) + 1))
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate((a_ids, b_ids))[order]
        follows = np.append(np.where(side[1:] == side[:-1], 0, np.where(side[:-1] % 2 == 0, 1, 2)), 3)
        chunk_begin, chunk_end = _ends(a_n + b_n)
        follows[chunk_end - 1] = 3
        spelled = self.spelled[follows, ids].tolist()
        self.known.update(zip(chunks, range(len(self.groups), len(self.groups) + len(chunks))))
        self.groups += ["".join(spelled[x:y]) for x, y in zip(chunk_begin.tolist(), chunk_end.tolist())]
        starts, _ = _ends(a_n)
        n_links = np.add.reduceat(n, starts)
        self.begins.add(self.links.n + _ends(n_links)[0])
        self.links.add(links)
        self.table.add(np.stack((a_n, b_n, np.add.reduceat(a_closes.astype(np.int64), starts), n_links), axis=1))

    def _align_apart(self, chunks: list[str], a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> None:
        for k, (chunk, x, y) in enumerate(zip(chunks, zip(*_ends(a[1])), zip(*_ends(b[1])))):
            own = a[0][slice(*x)], b[0][slice(*y)]
            if all(b"".join(map(held.__getitem__, ids.tolist())) == chunk.encode() for held, ids in zip((self.a_bytes, self.b_bytes), own)):
                self._align([chunk], (own[0], a[1][k : k + 1]), (own[1], b[1][k : k + 1]))
            else:
                self.known[chunk] = len(self.groups)
                self.groups.append("")
                self.begins.add(np.array([self.links.n]))
                self.table.add(np.zeros((1, 4), np.int64))

    def learn(self, texts: list[list[str]]) -> list[list[int]]:
        """Numbers of the chunks of each text; they hold until the next call."""
        if len(self.groups) > CACHE_CHUNKS:
            self._clear()
        new = [c for c in dict.fromkeys(chain.from_iterable(texts)) if c not in self.known]
        for part in self._coded(new):
            self._align(*part)
        out = [list(map(self.known.__getitem__, t)) for t in texts]
        for c in new:
            if len(c) > CACHE_CHARS:
                del self.known[c]
        return out

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """(A tokens, B tokens, groups and links of each text as rows of a table, hash of each text's groups, links, text of each link)."""
        numbers = self.learn([self.chunks(t) if t else [] for t in texts])
        length = np.array([len(cs) for cs in numbers], np.int64)
        owner = np.repeat(np.arange(len(texts)), length)
        flat = np.fromiter(chain.from_iterable(numbers), np.int64, int(length.sum()))
        table = self.table.held[flat]
        good = np.bincount(owner, table[:, 0] == 0, len(texts)) == 0  # texts all of whose chunks are spelled by their tokens
        digests = [hashlib.sha256(";".join(map(self.groups.__getitem__, cs)).encode()).hexdigest() if ok and cs else "" for ok, cs in zip(good.tolist(), numbers)]
        size = np.where(good[owner], table[:, 3], 0)
        at = np.repeat(self.begins.held[flat] - _ends(size)[0], size) + np.arange(int(size.sum()))
        counts = np.stack([np.bincount(owner, w, len(texts)).astype(np.int64) for w in table.T], axis=1) * good[:, None]
        return counts, digests, self.links.held[at], np.repeat(owner, size)


_TOKENS = "kind int, a int, slice long, n long, data binary, ids array<{id}>, digests array<string>"


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of each run of equal numbers."""
    begins = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return begins, np.append(begins[1:], len(x))


def _table(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of three kinds: 0 a task's counts of an A id's pairs, 1 a slice's postings of an A id, 2 a slice's digests."""
    source = text_rows(docs, id_col, text_col)
    id_type = source.schema["doc_id"].dataType.simpleString()

    @released
    def read(batches):
        own, task, number, held = Aligner(a_path, b_path), TaskContext.get().partitionId(), 0, []
        schema = None

        def counts_out():
            keys = np.concatenate([k for k, _ in held])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], np.concatenate([n for _, n in held])[order]
            begins, _ = _runs(keys)
            keys, n = keys[begins], np.add.reduceat(n, begins)
            a, b = keys >> _B_BITS, keys & ((1 << _B_BITS) - 1)
            return [{"kind": 0, "a": int(a[x]), "n": int(y - x), "data": packed(b[x:y], n[x:y])} for x, y in zip(*_runs(a))]

        for batch in batches:
            schema = schema or pa.schema([("kind", pa.int32()), ("a", pa.int32()), ("slice", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("ids", pa.list_(batch.schema.field("doc_id").type)), ("digests", pa.list_(pa.string()))])
            for ids, texts in slices(batch["text"], batch["doc_id"]):
                counts, digests, links, owner = own.align(texts.to_pylist())
                where, number = (task << 32) | number, number + 1
                rows = [{"kind": 2, "slice": where, "n": len(texts), "data": packed(*counts.T), "ids": ids.to_pylist(), "digests": digests}]
                keys, times = np.unique((links << _DOC_BITS) | owner, return_counts=True)
                pair, doc = keys >> _DOC_BITS, keys & ((1 << _DOC_BITS) - 1)
                a, b = pair >> _B_BITS, pair & ((1 << _B_BITS) - 1)
                rows += [{"kind": 1, "a": int(a[x]), "slice": where, "n": int(y - x), "data": packed(b[x:y], doc[x:y], times[x:y])} for x, y in zip(*_runs(a))]
                yield _table(schema, rows)
                begins, ends = _runs(pair)
                if len(begins):
                    held.append((pair[begins], ends - begins))  # documents of each pair
                if sum(len(k) for k, _ in held) > HELD_PAIRS:
                    yield _table(schema, counts_out())
                    held.clear()
        if held:
            yield _table(schema, counts_out())

    return source.mapInArrow(read, _TOKENS.format(id=id_type))


def _rows(batches, names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in names))


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, data: B ids and in how many documents each is linked with a), one row an A id."""

    @released
    def add(batches):
        now, total = None, np.zeros(1 << _B_BITS, np.int64)

        def out():
            b = np.flatnonzero(total)
            row = {"a": now, "data": packed(b, total[b])}
            total[b] = 0
            return pa.RecordBatch.from_pylist([row], pa.schema([("a", pa.int32()), ("data", pa.binary())]))

        for a, data in _rows(batches, ["a", "data"]):
            if now not in (None, a):
                yield out()
            now = a
            b, n = unpacked(data)
            total[b] += n  # the B ids of one row are distinct
        if now is not None:
            yield out()

    part = found.where("kind = 0").select("a", "data").repartition("a").sortWithinPartitions("a")
    return part.mapInArrow(add, "a int, data binary")


def contributions(found: DataFrame, counts: DataFrame) -> DataFrame:
    """(slice, data: documents of the slice, best links and sum of counts that some of the A ids give them)."""
    spark = found.sparkSession
    postings = found.where("kind = 1")
    sizes = postings.groupBy("a").agg(F.sum("n").alias("n")).collect()  # at most as many rows as A has ids
    share = max(1, sum(r["n"] for r in sizes) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    parts = spark.createDataFrame([(r["a"], -(-r["n"] // share)) for r in sizes if r["n"] > share], "a int, parts long")  # fewer than four a partition
    spread = lambda df: df.join(F.broadcast(parts), "a", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    counted = spread(counts).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(-1).cast("long").alias("slice"), "data")
    posted = spread(postings.select("a", "slice", "data")).select("a", F.pmod(F.xxhash64("slice"), F.col("parts")).alias("part"), "slice", "data")

    @released
    def score(batches):
        by_slice: dict[int, list] = {}
        held = 0
        df = np.zeros(1 << _B_BITS, np.int64)
        b_now, best = np.zeros(0, np.int64), 0

        def out():
            rows = []
            for where, parts in by_slice.items():
                doc, n, total = (np.concatenate(x) for x in zip(*parts))
                docs, back = np.unique(doc, return_inverse=True)
                sums = [np.zeros(len(docs), np.int64) for _ in range(2)]
                np.add.at(sums[0], back, n)
                np.add.at(sums[1], back, total)
                rows.append({"slice": where, "data": packed(docs, *sums)})
            by_slice.clear()
            return pa.RecordBatch.from_pylist(rows, pa.schema([("slice", pa.int64()), ("data", pa.binary())]))

        for where, data in _rows(batches, ["slice", "data"]):
            if where < 0:
                df[b_now] = 0
                b_now, n = unpacked(data)
                df[b_now], best = n, int(n.max())
                continue
            b, doc, times = unpacked(data)
            n = df[b]
            by_slice.setdefault(where, []).append((doc, np.where(n == best, times, 0), times * n))
            held += len(b)
            if held > HELD_SUMS:
                yield out()
                held = 0
        if by_slice:
            yield out()

    both = counted.unionByName(posted).repartition("a", "part").sortWithinPartitions("a", "part", "slice")
    return both.select("slice", "data").mapInArrow(score, "slice long, data binary")


def summed(found: DataFrame, given: DataFrame) -> DataFrame:
    """One row a document, of its slice's digests and all contributions to it."""
    id_type = found.schema["ids"].dataType.elementType.simpleString()
    digests = found.where("kind = 2").select("slice", F.lit(0).alias("kind"), "data", "ids", "digests")
    parts = given.select("slice", F.lit(1).alias("kind"), "data", F.lit(None).cast(f"array<{id_type}>").alias("ids"), F.lit(None).cast("array<string>").alias("digests"))
    names = ["n_a", "n_b", "n_groups", "n_links"]

    @released
    def add(batches):
        held, id_kind = None, None

        def out():
            ids, digest, table, n_best, count_sum = held
            columns = [*table, n_best, count_sum]
            return pa.RecordBatch.from_arrays([pa.array(ids, id_kind), *(pa.array(x) for x in columns), pa.array(digest, pa.string())], ["doc_id", *names, "n_best", "count_sum", "groups_sha256"])

        for batch in batches:
            id_kind = batch.schema.field("ids").type.value_type
            for kind, data, ids, digest in _rows([batch], ["kind", "data", "ids", "digests"]):
                if kind == 0:
                    if held:
                        yield out()
                    held = (ids, digest, unpacked(data), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64))
                else:
                    doc, n, total = unpacked(data)
                    held[3][doc] += n
                    held[4][doc] += total
        if held:
            yield out()

    both = digests.unionByName(parts).repartition("slice").sortWithinPartitions("slice", "kind")
    return both.select("kind", "data", "ids", "digests").mapInArrow(add, f"doc_id {id_type}, {', '.join(f'{x} long' for x in names)}, n_best long, count_sum long, groups_sha256 string")


def token_alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (of ``a1,a2|b1;a3|b2,b3``)."""
    with small_batches(docs.sparkSession):
        found = stored(tokens(docs, a_path, b_path, id_col, text_col))
    return summed(found, contributions(found, stored(pair_counts(found))))
