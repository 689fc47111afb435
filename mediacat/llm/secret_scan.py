"""Secrets in whole texts and in whatever is encoded in them.

A worklist of layers, the text itself first.  Each layer is scanned with the three patterns and then unwrapped:

* URL and Unicode escapes (``%41``, ``\\u0041``, ``\\x41``, ``\\u{41}``, ``&#65;``): every stretch that holds one is a new layer with one
  level of them decoded; stretches end at characters that neither a pattern nor an escape can hold.  After ``LEVELS`` levels
  of nothing but escapes the next layer is their fixpoint, however deep they are nested, by one walk with a stack, so that time
  stays in proportion to the text.  (Compressed data below more levels than that would have to come out before the fixpoint.)
* base64, both alphabets, with line breaks and at each of the four alignments, so that letters in front do no harm;
* zlib, gzip, bzip2, xz and zstandard data, wherever its signature stands in decoded bytes.

New layers go back to the list until none is left; a layer with the same content at the same place as an earlier one is not
opened again, so data that unpacks to itself ends.  Each character of a layer knows its place in the text, so a finding in
any layer is a span of the text; all of a compressed layer stands where the compressed data stands.

Compressed data can unpack to a thousand times its size, and again inside: a text may unpack to ``MOST_UNPACKED`` bytes in all
(a guard of the worker's memory, a parameter); ``unopened`` counts layers that would have gone beyond, 0 for a whole scan.

Null and empty texts have no findings; very long texts are scanned whole; equal findings of several layers are one; repeated rows
are scanned one by one; an empty table gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import bz2
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import released, text_rows
from .words import slices

#: In the order in which findings at one place are listed.
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
LEAST_VALUE = 6
#: A run that is too short holds no longer one, so the least length may stand in the pattern.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
MOST_UNPACKED = 64 << 20

#: Stretches of characters that patterns and escapes are made of.
_STRETCH = re.compile(r"""[A-Za-z0-9+/_.=\-"'\x20:%\\{}&#;~!*()]+""")
_ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
LEVELS = 16
_HEX = "0123456789abcdefABCDEF"
#: An escape at the end of what has been read, and the length of the longest.
_ENDS, _LONGEST = re.compile(f"(?:{_ESCAPE.pattern})$"), 12
#: Base64 of 12 bytes, the least that any pattern takes, has 16 characters.
LEAST_CODED = 16
_CODED = re.compile(r"[A-Za-z0-9+/_-]+(?:\r?\n[A-Za-z0-9+/_-]+)*")
_PLAIN = str.maketrans("-_", "+/")
_BREAKS = re.compile(r"[\r\n]+")
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")


def findings(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' leftmost matches that do not overlap, each kind by itself."""
    found = [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [(1, *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    return found + [(2, *m.span()) for m in HEX.finditer(text)]


def _code(m: re.Match) -> int | None:
    """The character that an escape stands for."""
    code = int(m[7]) if m[7] else int(next(g for g in m.groups() if g), 16)
    return None if code > 0x10FFFF or 0xD800 <= code < 0xE000 else code


def unescaped(text: str) -> tuple[str, list[int], list[int]]:
    """``text`` with one level of its escapes decoded, and where each character's source starts and ends."""
    out, starts, ends, at = [], [], [], 0
    for m in _ESCAPE.finditer(text):
        if (code := _code(m)) is not None:
            a, b = m.span()
            out += [text[at:a], chr(code)]
            starts += [*range(at, a), a]
            ends += [*range(at + 1, a + 1), b]
            at = b
    return "".join([*out, text[at:]]), [*starts, *range(at, len(text))], [*ends, *range(at + 1, len(text) + 1)]


def fully_unescaped(text: str) -> tuple[str, list[int], list[int]]:
    """``text`` with its escapes decoded until none is left, and where each character's source starts and ends.

    Characters go on a stack; whenever its end is an escape, that is replaced by what it stands for.  Each replacement
    makes the stack shorter, so the walk takes time in proportion to the text."""
    chars: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    for at, c in enumerate(text):
        chars.append(c)
        starts.append(at)
        ends.append(at + 1)
        while (c := chars[-1]) in _HEX or c in ";}":
            tail = "".join(chars[-_LONGEST:])
            m = _ENDS.search(tail)
            code = _code(m) if m else None
            if code is None:
                break
            n = len(tail) - m.start()
            first, last = starts[-n], ends[-1]
            del chars[-n:], starts[-n:], ends[-n:]
            chars.append(chr(code))
            starts.append(first)
            ends.append(last)
    return "".join(chars), starts, ends


class Layer:
    """Text whose characters know their places: all at ``start`` on (lists None), each by itself, or all at one place."""

    def __init__(self, text: str, starts: np.ndarray | int, ends: np.ndarray | int, path: tuple[str, ...]) -> None:
        self.text, self.starts, self.ends, self.path = text, starts, ends, path

    def place(self, start: int, end: int) -> tuple[int, int]:
        if isinstance(self.starts, int):  # of unpacked data
            return self.starts, self.ends
        return int(self.starts[start]), int(self.ends[end - 1])

    def part(self, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray | int, np.ndarray | int]:
        """Places of characters that come of the characters ``at`` to ``to`` (exclusive) of this layer."""
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return self.starts[at], self.ends[to - 1]


class Text(Layer):
    """The text itself: every character stands where it stands."""

    def __init__(self, text: str) -> None:
        super().__init__(text, 0, len(text), ())

    def place(self, start: int, end: int) -> tuple[int, int]:
        return start, end

    def part(self, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.asarray(at), np.asarray(to)


def unpacked(data: bytes, most: int) -> tuple[bytes, int] | None:
    """(what compressed data at the beginning of ``data`` holds, as far as it can be read; bytes that it takes), or None if it holds
    more than ``most`` bytes."""
    import zstandard

    makers = {b"\x1f\x8b": lambda: zlib.decompressobj(31), b"BZ": bz2.BZ2Decompressor, b"\xfd7": lambda: lzma.LZMADecompressor(memlimit=64 << 20)}
    out, rest = b"", b""
    try:
        if data[:2] == b"\x28\xb5":
            reader, at = zstandard.ZstdDecompressor(max_window_size=64 << 20).decompressobj(), 0
            while at < len(data) and not reader.eof and len(out) <= most:  # 64 bytes hold a few MB at most
                out += reader.decompress(data[at : at + 64])
                at += 64
            rest = reader.unused_data + data[at:]
        else:
            reader = makers.get(data[:2], lambda: zlib.decompressobj(15))()
            out = reader.decompress(data, most + 1)
            rest = reader.unused_data
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError):
        pass  # damaged or no such data: what came before the damage counts
    return None if len(out) > most else (out, len(data) - len(rest))


def _escapes(layer: Layer) -> Iterator[Layer]:
    if not _ESCAPE.search(layer.text):
        return
    decode = fully_unescaped if layer.path[-LEVELS:] == ("escape",) * LEVELS else unescaped
    for m in _STRETCH.finditer(layer.text):
        if _ESCAPE.search(m[0]):
            text, starts, ends = decode(m[0])
            if len(text) < len(m[0]):
                at = m.start()
                yield Layer(text, *layer.part(np.array(starts, np.int64) + at, np.array(ends, np.int64) + at), (*layer.path, "escape"))


def _coded(layer: Layer) -> Iterator[Layer]:
    for m in _CODED.finditer(layer.text):
        if m.end() - m.start() < LEAST_CODED:
            continue
        run, at = m[0], np.arange(m.start(), m.end())
        if "\n" in run:
            at = at[[c not in "\r\n" for c in run]]
            run = _BREAKS.sub("", run)
        run = run.translate(_PLAIN)
        for shift in range(4):
            n = (len(run) - shift) // 4 * 4
            rest = (len(run) - shift) % 4
            code = run[shift:] if rest != 1 else run[shift : shift + n]
            if len(code) < LEAST_CODED:
                continue
            data = base64.b64decode(code + "=" * (-len(code) % 4))
            k = np.arange(len(data))
            first = at[shift + k * 4 // 3]
            last = at[shift + np.minimum((k * 8 + 7) // 6, len(code) - 1)]
            yield Layer(data.decode("latin-1"), *layer.part(first, last + 1), (*layer.path, "base64"))


class Unpacker:
    """Opens compressed data in layers, up to ``left`` bytes in all."""

    def __init__(self, most: int) -> None:
        self.left, self.unopened = most, 0

    def layers(self, layer: Layer) -> Iterator[Layer]:
        if not layer.path:  # characters of the text itself are no bytes
            return
        data = layer.text.encode("latin-1", "replace")
        for m in _PACKED.finditer(data):
            opened = unpacked(data[m.start() :], self.left)
            if opened is None:
                self.unopened += 1
            elif opened[0]:
                inner, used = opened
                self.left -= len(inner)
                yield Layer(inner.decode("latin-1"), *layer.place(m.start(), m.start() + used), (*layer.path, "compressed"))


def scan(text: str, most: int = MOST_UNPACKED) -> tuple[list[tuple[int, int, int, str]], int]:
    """((kind, start, end, path) of all findings, path the layers above joined by ``>``; number of layers not opened for ``most``).

    The worklist is a stack of what is left of each layer's own layers, made one at a time, so that few are held at once."""
    found: dict[tuple[int, int, int], str] = {}
    unpacker, seen = Unpacker(most), set()
    work: list[Iterator[Layer]] = [iter([Text(text)])]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        sign = (*layer.place(0, len(layer.text)), hash(layer.text)) if layer.text else None
        if sign is None or sign in seen:
            continue
        seen.add(sign)
        for kind, start, end in findings(layer.text):
            found.setdefault((kind, *layer.place(start, end)), ">".join(layer.path))
        work.append(chain(_escapes(layer), _coded(layer), unpacker.layers(layer)))
    return [(*k, path) for k, path in found.items()], unpacker.unopened


FOUND = "array<struct<kind:string,start:long,end:long,path:string>>"


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_unpacked: int = MOST_UNPACKED) -> DataFrame:
    """One row a document: doc_id, ``found`` (kind, start, end in code points, path: empty for the text itself, else the layers
    from the outermost in, joined by ``>``; by start, then kind as in ``KINDS``, then end) and ``unopened``."""
    source = text_rows(docs, id_col, text_col)

    @released
    def search(batches):
        for batch in batches:
            for ids, texts in slices(batch["text"], batch["doc_id"]):
                found, unopened = [], []
                for text in texts.to_pylist():
                    rows, closed = scan(text or "", most_unpacked)
                    rows.sort(key=lambda r: (r[1], r[0], r[2]))
                    found.append([{"kind": KINDS[k], "start": a, "end": b, "path": path} for k, a, b, path in rows])
                    unopened.append(closed)
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("path", pa.string())]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, kind), pa.array(unopened, pa.int64())], ["doc_id", "found", "unopened"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(search, f"doc_id {kind}, found {FOUND}, unopened long")


def listed(found: Column) -> Column:
    """kind:start:end of findings, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
