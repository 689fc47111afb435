"""Token counts of whole texts under a byte-level BPE, by rank-synchronous merging of ragged arrays.

Texts are cut at special strings and at white space exactly as the tokenizer's own pattern cuts, distinct
pieces of a batch are held as one ragged array of symbols, and in each round every piece applies its
own lowest-rank pair at all its places at once.  Null and empty texts have 0 bytes and tokens; very long
texts are counted whole; repeated rows are counted one by one; a count equal to the limit is not over it; an empty table gives
no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import released, text_rows
from .words import slices

#: Fixed value: the published byte-level pre-token pattern.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the code points that the pattern's \s means.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Chunks remembered by a task before it starts afresh: memory, not results, depends on it.
CACHE_CHUNKS = 600_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class RankMerger:
    """Counts the symbols that are left of many byte strings after all merges."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        self.base = max(vocab.values()) + 1
        self.first = np.array([vocab[c] for c in byte_symbols()], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        key = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        to = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.rank, self.to = key[order], order.astype(np.int64), to[order]

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        out = np.array([len(p) for p in pieces], np.int64)
        if not len(out):
            return out
        symbols = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), out)
        none = len(self.keys)
        while len(symbols) > 1:
            key = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            fits = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.where(fits, self.rank[at], none)
            begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lowest = np.minimum.reduceat(np.append(rank, none), begins)
            sizes = np.diff(np.append(begins, len(symbols)))
            alive = lowest < none
            if not alive.all():  # pieces without a pair are done
                out[owner[begins[~alive]]] = sizes[~alive]
                live = np.repeat(alive, sizes)
                symbols, owner = symbols[live], owner[live]
                if not len(symbols):
                    break
                rank, at = np.append(rank, none)[live][:-1], np.append(at, 0)[live][:-1]
                sizes, lowest = sizes[alive], lowest[alive]
            chosen = rank == np.repeat(lowest, sizes)[:-1]
            chosen &= owner[:-1] == owner[1:]
            hits = np.flatnonzero(chosen)
            run = np.cumsum(np.concatenate(([True], np.diff(hits) > 1))) - 1  # of equal symbols: every other pair counts
            start = hits[np.concatenate(([True], np.diff(hits) > 1))]
            hits = hits[(hits - start[run]) % 2 == 0]
            symbols[hits] = self.to[at[hits]]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if len(symbols) == 1:
            out[owner[0]] = 1
        return out


class TokenCounter:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merger = RankMerger(spec["model"]["vocab"], spec["model"]["merges"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(PRETOKEN)
        self.runs = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self.plain: dict[str, int] = {}  # counts of chunks as they stand
        self.spaced: dict[str, int] = {}  # counts of chunks after one space

    def _learn(self, plain: set[str], spaced: set[str]) -> None:
        if len(self.plain) + len(self.spaced) > CACHE_CHUNKS:
            self.plain.clear()
            self.spaced.clear()
        chunks = [*plain, *(" " + x for x in spaced)]
        cut = [self.pattern.findall(x) for x in chunks]
        pieces = {p: i for i, p in enumerate(dict.fromkeys(p for c in cut for p in c))}
        n = self.merger.counts([p.encode() for p in pieces])
        for x, c in zip(chunks, cut):
            total = int(sum(n[pieces[p]] for p in c))
            if x in plain:
                self.plain[x] = total
            if x[0] == " " and x[1:] in spaced:
                self.spaced[x[1:]] = total

    def _chunks(self, text: str) -> tuple[list[str], list[str]]:
        """(chunks as they stand, chunks after one space)."""
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return self.runs.findall(text), []
        first, *rest = text.split(" ")
        return [first] if first else [], rest

    def count(self, texts: list[str]) -> list[int]:
        parts: list[tuple[int, list[str], list[str]]] = []
        out = [0] * len(texts)
        for i, text in enumerate(texts):
            spans = [text]
            if self.cut and any(s in text for s in self.special):
                spans = self.cut.split(text)
                out[i] = len(spans) - 1
            parts += [(i, *self._chunks(s)) for s in spans if s]
        known_p, known_s = self.plain, self.spaced
        plain = {x for _, a, _ in parts for x in a if x not in known_p}
        spaced = {x for _, _, b in parts for x in b if x not in known_s}
        if plain or spaced:
            before = (len(known_p), len(known_s))
            self._learn(plain, spaced)
            if (len(known_p), len(known_s)) < before:  # started afresh
                self._learn({x for _, a, _ in parts for x in a if x not in known_p}, {x for _, _, b in parts for x in b if x not in known_s})
        for i, a, b in parts:
            out[i] += sum(map(known_p.__getitem__, a)) + sum(map(known_s.__getitem__, b))
        return out


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    source = text_rows(docs, id_col, text_col)

    @released
    def count(batches):
        own = TokenCounter(tokenizer)
        for batch in batches:
            for ids, texts in slices(batch["text"], batch["doc_id"]):
                strings = [t or "" for t in texts.to_pylist()]
                n = own.count(strings)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(t.encode()) for t in strings], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
