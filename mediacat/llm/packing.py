"""Best-fit packing of token pieces by bin completion.

Documents are turned into ids (then one end id), only those above the capacity are cut, and the pieces
are packed in groups of bounded size, each in one task.  In a group best-fit decreasing gives the
incumbent; where a lower bound allows fewer bins, a depth-first search over the emptiest bins, then over
more and more of them, fills the bin of the largest piece left with each undominated set of smaller pieces
of the fullest sums, the fullest first, and prunes by waste.  The search stops after SEARCH_STEPS steps a group;
then the best bins so far stand, which is one bin a group above the bound at most in what has been measured.

Null and empty texts are a piece of the end id alone; very long texts are many pieces, their last one the rest;
repeated rows are packed one by one; pieces of equal length are dealt by their start; columns other than the id and the text are
not read, so none can clash; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released, small_batches, stored, text_rows
from .words import SPACE, buffers, slices

CAPACITY = 4096
#: Pieces packed together by one task; the last bins of a group are the only ones that grouping can waste.
GROUP_PIECES = 32_768
#: Lengths that the search in a group may look at before the best bins found stand (a node looks at each distinct length left),
#: alternatives for each bin, and bins searched at first.
SEARCH_STEPS, BRANCHES, FIRST_BINS = 250_000, 4, 16
#: Units whose ids a task remembers before it starts afresh, and bytes of text that it turns into ids at a time: memory and
#: time depend on them, results do not.
CACHE_UNITS, PART_BYTES, WORDS_A_LINE = 400_000, 4 << 20, 200
#: Fixed value: the published pattern whose matches this tokenizer's pieces are.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def facts(spec: dict) -> tuple[bool, bool]:
    """(whether no piece of a tokenizer file spans white space or an ASCII letter and a sign beside it, whether it lower-cases)."""
    normal, cut = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = normal.get("normalizers", [normal] if normal else [])
    first = (cut.get("pretokenizers") or [cut])[0]
    plain = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in steps)
    own = first.get("type") == "Split" and first.get("pattern") == {"Regex": PIECES} and first.get("behavior") == "Removed" and first.get("invert") is True
    return plain and own, any(x["type"] == "Lowercase" for x in steps)


class ChunkIds:
    """Unsigned 32-bit ids of whole texts.  Where the tokenizer file says that no piece spans white space, or an ASCII letter and a
    sign beside it, a text's ids are those of the units between such places in turn, and each distinct unit is encoded once;
    with any other file whole texts are encoded."""

    def __init__(self, path: str, most: int = CACHE_UNITS) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.in_units, self.lowers = facts(spec)
        special = [t["content"] for t in spec.get("added_tokens") or []]
        # a letter always begins or ends a piece next to these; the apostrophe is no such sign, nor is any of a special string
        signs = set("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~") - set("".join(special))
        self.sign = np.zeros(256, bool)
        self.sign[[ord(c) for c in signs]] = True
        self.special = [t.encode() for t in special]
        self.known: dict[str, bytes] = {}
        # ids that end a word, where the file has a mark for that
        mark, vocab = spec["model"].get("end_of_word_suffix"), spec["model"]["vocab"] if isinstance(spec["model"].get("vocab"), dict) else {}
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if mark and t.endswith(mark)]] = True

    def _learn(self, units: list[str]) -> None:
        if len(self.known) > self.most:
            self.known.clear()
        new = [x for x in units if x not in self.known]
        words = [x for x in new if x.isascii() and x.isalpha()] if self.ends.any() else []
        if words:  # each is one piece, so many are encoded as one text and told apart by their ends
            lines = [" ".join(words[i : i + WORDS_A_LINE]) for i in range(0, len(words), WORDS_A_LINE)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            to = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(to) == len(words):
                data = ids.tobytes()
                self.known.update(zip(words, (data[a:b] for a, b in zip([0, *to], to))))
                new = [x for x in new if x not in self.known]
        self.known.update(zip(new, (array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False))))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with an end id after each, first id of each text and the total)."""
        if not self.in_units:
            found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            ends = np.array([end_id], "<u4")
            return np.concatenate([x for f in found for x in (f, ends)] or [ends[:0]]), np.cumsum([0, *(len(f) + 1 for f in found)])
        raw, offsets = buffers(texts)
        inside = ~SPACE[raw]
        letter, sign = _LETTER[raw], self.sign[raw]
        begins = np.zeros(len(raw) + 1, bool)
        begins[offsets[:-1]] = True
        begins[1:-1] |= ~inside[:-1] | (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
        starts = np.flatnonzero(inside & begins[:-1])
        firsts = np.searchsorted(starts, offsets)
        whole = raw.tobytes()
        if self.lowers and not any(x[:2] in whole for x in self.special):  # else case may tell special strings from others
            upper = (raw >= 65) & (raw <= 90)
            upper[:-1] &= raw[1:] < 128  # a mark may follow, which small letters compose with otherwise
            raw = raw + upper.astype(np.uint8) * np.uint8(32)
        data = raw[inside]
        at = np.cumsum(inside, dtype=np.int32)[starts] - 1
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        distinct = units.dictionary.to_pylist()
        self._learn(distinct)
        ids = [*map(self.known.__getitem__, distinct), np.array([end_id], "<u4").tobytes()]
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.cumsum(length) - length
        # the units of each text, then the end
        which = np.insert(units.indices.to_numpy(), firsts[1:], len(distinct))
        held = length[which]
        total = np.append(0, np.cumsum(held))
        flat = np.frombuffer(b"".join(ids), "<u4")[np.repeat(begin[which] - total[:-1], held) + np.arange(int(total[-1]))]
        return flat, total[firsts + np.arange(len(firsts))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", cache_units: int = CACHE_UNITS, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32."""
    source = text_rows(docs, id_col, text_col)

    @released
    def cut(batches):
        own = ChunkIds(tokenizer, cache_units)
        for batch in batches:
            for ids, texts in slices(batch["text"], batch["doc_id"], part_bytes):
                flat, firsts = own.encode(texts, end_id)
                rows = []
                for i, (first, last) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist())):
                    for k, at in enumerate(range(first, last, capacity)):
                        to = min(at + capacity, last)
                        rows.append((i, k, at - first, to - at, zlib.crc32(flat[at:to])))
                i, k, start, length, crc = (np.array(c, np.int64) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(i)), pa.array(k.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing over lengths: a list of bins, each a list of lengths."""
    room: dict[int, list[int]] = defaultdict(list)  # free space -> bins
    spaces = np.zeros(capacity + 1, bool)
    bins: list[list[int]] = []
    for n in sorted(lengths, reverse=True):
        tail = spaces[n:]
        at = int(tail.argmax())
        if tail[at]:
            free = n + at
            b = room[free].pop()
            if not room[free]:
                spaces[free] = False
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(n)
        room[free - n].append(b)
        spaces[free - n] = True
    return bins


def least_bins(lengths: list[int], capacity: int) -> int:
    """A lower bound of the bins: for each length k, pieces above capacity - k take a bin each, those above the half
    too, and what does not fit beside the latter of the pieces from k on takes more."""
    n = np.sort(np.array(lengths, np.int64))
    if not len(n):
        return 0
    total = np.append(0, np.cumsum(n))
    half = int(np.searchsorted(n, capacity // 2, "right"))
    k = np.unique(np.append(n[:half], 0))
    low, big = np.searchsorted(n, k, "left"), np.searchsorted(n, capacity - k, "right")
    room = (big - half) * capacity - (total[big] - total[half])
    more = np.maximum(0, -(-(total[half] - total[low] - room) // capacity))
    return int((len(n) - half + more).max())


def fits_into(pieces: tuple[int, ...], larger: tuple[int, ...]) -> bool:
    """Whether first fit, largest first, puts the pieces into the larger ones: then a filling by these dominates one by those."""
    room = sorted(larger)
    for n in sorted(pieces, reverse=True):
        k = next((k for k, r in enumerate(room) if r >= n), None)
        if k is None:
            return False
        room[k] -= n
        room.sort()
    return True


def fillings(left: Counter, room: int, most: int) -> list[tuple[int, ...]]:
    """Sets of the lengths left, of any number of pieces, for the ``most`` fullest sums in ``room``, without those that another dominates.

    The sums that can be reached are bits of a number for each prefix of the sizes; each sum's set takes the largest pieces it can."""
    sizes = sorted(n for n, c in left.items() if c > 0 and n <= room)
    mask = (1 << (room + 1)) - 1
    reach = [1]
    for n in sizes:
        bits, count, step = reach[-1], min(left[n], room // n), 1
        while count > 0:
            step = min(step, count)
            bits |= bits << (n * step) & mask
            count -= step
            step *= 2
        reach.append(bits)
    found: list[tuple[int, ...]] = []
    sums = reach[-1]
    while sums and len(found) < most:
        s = sums.bit_length() - 1
        sums ^= 1 << s
        taken: list[int] = []
        for k in range(len(sizes), 0, -1):
            if not s:
                break
            n = sizes[k - 1]
            t = min(left[n], s // n)
            while t and not reach[k - 1] >> (s - t * n) & 1:
                t -= 1
            taken += [n] * t
            s -= t * n
        if not any(fits_into(tuple(taken), f) for f in found):
            found.append(tuple(taken))
    return found


def search(lengths: list[int], capacity: int, target: int, steps: int) -> tuple[list[list[int]] | None, int]:
    """(at most ``target`` bins for the lengths, or None if there are none or the steps run out; steps used), depth first."""
    spare = target * capacity - sum(lengths)  # waste that a solution may have
    if spare < 0 or least_bins(lengths, capacity) > target:
        return None, 0

    def options(left: Counter) -> list[list[int]]:
        largest = max(left)
        rest = left - Counter([largest])
        return [[largest, *f] for f in reversed(fillings(rest, capacity - largest, BRANCHES))]  # the fullest last: it goes first

    used = 0
    stack = [(Counter(lengths), [], 0, options(Counter(lengths)))]
    while stack and used < steps:
        left, bins, waste, todo = stack[-1]
        if not todo:
            stack.pop()
            continue
        filled = todo.pop()
        used += len(left)
        lost = waste + capacity - sum(filled)
        if lost > spare:
            todo.clear()  # the others waste more
            continue
        rest, now = left - Counter(filled), [*bins, filled]
        if not rest:
            return now, used
        end = best_fit(list(rest.elements()), capacity) if rest.total() <= 4 * (target - len(now)) else None
        if end is not None and len(now) + len(end) <= target:
            return now + end, used
        stack.append((rest, now, lost, options(rest)))
    return None, used


def complete(lengths: list[int], capacity: int, steps: int = SEARCH_STEPS) -> list[list[int]]:
    """Bins for the lengths.  Best fit gives the incumbent; where the bound allows one bin less, bin completion searches the
    pieces of its emptiest bins, then of more and more of them up to all, for bins that are fewer."""
    best = best_fit(lengths, capacity)
    bound = least_bins(lengths, capacity)
    some = FIRST_BINS
    while len(best) > bound and steps > 0:
        best.sort(key=sum)
        part = best[:some]
        found, used = search([n for b in part for n in b], capacity, len(part) - 1, max(steps // 2, 1) if some < len(best) else steps)
        steps -= max(used, 1)
        if found is not None:
            best = found + best[some:]
        elif some >= len(best):
            break
        else:
            some *= 4
    return best


def pack(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to stored pieces.  Groups are dealt by a hash of the piece, so that none
    is larger than about ``group_pieces`` however the documents come."""
    groups = max(1, -(-cut.count() // group_pieces))
    dealt = cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))

    def fill(key, table):  # a bounded number of pieces without texts
        lengths = table["length"].to_numpy()
        by = defaultdict(list)
        for i in np.lexsort((table["start"].to_numpy(), lengths)).tolist():
            by[int(lengths[i])].append(i)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        full = by.pop(capacity, [])
        bins = complete([n for n, rows in by.items() for _ in rows], capacity)
        by[capacity] = full
        for b, filled in enumerate([*bins, *([capacity] for _ in full)]):
            at = 0
            for n in filled:
                i = by[n].pop()
                sequence[i], offset[i] = b, at
                at += n
        sequence += int(key[0].as_py()) << 32
        return table.drop_columns(["g"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    kind = cut.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("g").applyInArrow(fill, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", **memory: int) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  ``memory``: cache_units, part_bytes."""
    with small_batches(docs.sparkSession):
        cut = stored(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, **memory))
    return pack(cut, capacity)
