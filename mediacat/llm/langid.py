"""Language identification by cross-parsing: the language whose labelled text parses a text into the fewest phrases.

Per language a bounded sample of labelled texts, an even share of each, becomes a suffix automaton over all letters of the samples.  A text is cut greedily into
longest substrings of a language's sample (walks from the automaton's root; a character that the
sample lacks is a phrase by itself).  The language with the fewest phrases a character wins, ties going to the one
whose sample lacks fewer of the text's characters, then to the first name.  Long texts are walked as segments side by side: each begins in the state that the symbols before it
lead to, and is walked again wherever the segment before it ends in another one, until all agree; so the phrases are
those of one walk over the whole text.  Null texts and texts without a letter give ``und`` and 0; repeated rows are judged one
by one; other columns are not read, so none can clash; an empty table gives no rows; without labelled text every text is ``und``.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released, text_rows
from .words import slices

#: Bounds of the fitted sample: characters of a language's text in its automaton, and texts looked at.
SAMPLE_CHARS, SAMPLE_TEXTS = 40_000, 48
#: Symbols of a segment, and symbols before it that its first state is guessed from: time depends on them, results do not.
SEGMENT, BEFORE = 256, 40
#: Letters, the most frequent, whose transitions are a dense table; those of all others are looked up by search.
DENSE = 200
#: Windows that a text longer than its share of the sample gives.
WINDOWS = 4


def sample_texts(labelled: DataFrame, id_col: str, text_col: str, label_col: str, texts: int = SAMPLE_TEXTS) -> dict[str, list[str]]:
    """Up to about ``texts`` whole texts a label, chosen by a hash of the id; rows without label, text or letters don't count."""
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    at = F.pmod(F.xxhash64(F.lit("sample"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 40))
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 4 * texts / n) * (1 << 40)))])
    picked = rows.where(at < limit[F.col("lang")])
    # about 4 * texts rows a label: a bounded number
    firsts = picked.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct(at.alias("at"), "doc_id"))), 1, texts).alias("ids"))
    ids = firsts.select("lang", F.explode("ids.doc_id").alias("doc_id")).distinct()
    out: dict[str, list[str]] = {lang: [] for lang in counts}
    # of a text longer than all that the automaton can take only evenly spaced windows come to the driver
    step = F.floor((F.length("text") - SAMPLE_CHARS) / (WINDOWS - 1)).cast("int")
    windows = F.concat_ws("\n", *[F.substring(F.col("text"), step * k + 1, F.lit(SAMPLE_CHARS)) for k in range(WINDOWS)])
    bounded = F.when(F.length("text") > WINDOWS * SAMPLE_CHARS, windows).otherwise(F.col("text"))
    for r in picked.join(F.broadcast(ids), ["lang", "doc_id"], "left_semi").select("lang", bounded.alias("text"), at.alias("at")).orderBy("lang", "at", "text").toLocalIterator():
        if r["text"] not in out[r["lang"]]:
            out[r["lang"]].append(r["text"])
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def even_share(texts: list[str], most: int) -> str:
    """The texts, or where they have more than ``most`` characters windows of the long ones, all of one size, and the others whole."""
    left, share, rest = most, most, len(texts)
    for n in sorted(map(len, texts)):
        share = max((left - rest) // rest, 0)  # a break goes with each
        if n > share:
            break
        left, rest, share = left - n - 1, rest - 1, most
    out = []
    for text in texts:
        if len(text) <= share:
            out.append(text)
            continue
        size = max((share - WINDOWS + 1) // WINDOWS, 1)
        out += [text[a : a + size] for a in np.linspace(0, len(text) - size, WINDOWS).astype(int).tolist()]
    return "\n".join(out)


@cache
def letter_table() -> tuple[np.ndarray, np.ndarray]:
    """(which code points are letters, the lower case of each code point): two tables of fixed size."""
    letters = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(letters).tolist():
        lower[c] = ord(chr(c).lower()[0])
    return letters, lower


def build_automaton(symbols: list[int], width: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Transitions of the suffix automaton of ``symbols``: a (states, width) table, where 0, the root, means none, and
    (states, symbols, targets) of the symbols from ``width`` on."""
    nexts: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    table = np.zeros((len(nexts), width), np.int32)
    sizes = [len(x) for x in nexts]
    state = np.repeat(np.arange(len(nexts)), sizes)
    symbol, target = (np.fromiter((y for x in nexts for y in f(x)), np.int64, len(state)) for f in (dict.keys, dict.values))
    few = symbol < width
    table[state[few], symbol[few]] = target[few]
    return table, (state[~few], symbol[~few], target[~few])


class CrossParser:
    """Phrases that each language needs for a text."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.langs = sorted(samples)
        letters, lower = letter_table()
        counts: dict[str, int] = {}
        for text in samples.values():
            for ch in text.lower():
                if ch.isalpha():
                    counts[ch] = counts.get(ch, 0) + 1
        alphabet = sorted(counts, key=lambda c: (-counts[c], c))
        self.width = min(len(alphabet), DENSE) + 2
        symbol = np.ones(0x110000, np.uint32)  # 1: all that is no letter; 0: letters of no sample
        symbol[letters] = 0
        for k, ch in enumerate(alphabet):
            symbol[ord(ch)] = k + 2
        self.symbol = np.where(symbol == 0, symbol[lower], symbol)
        built = [build_automaton(self.symbols(samples[x]).tolist(), self.width) for x in self.langs]
        tables = [t for t, _ in built]
        starts = np.cumsum([0, *(len(t) for t in tables)])[:-1]
        self.roots = (starts * self.width).astype(np.int32)
        self.table = np.concatenate([np.where(t > 0, (t + s) * self.width, 0) for t, s in zip(tables, starts)]).astype(np.int32).ravel() if tables else np.zeros(0, np.int32)
        self.scalar = memoryview(self.table)
        keys = [self._key((state + s) * self.width, c) for (_, (state, c, _)), s in zip(built, starts)]
        to = [(target + s) * self.width for (_, (_, _, target)), s in zip(built, starts)]
        keys, to = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (keys, to))
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], to[order].astype(np.int32)
        every = np.arange(len(alphabet) + 2, dtype=np.int32)
        self.lacking = [self.step(np.full(len(every), root, np.int32), every) == 0 for root in self.roots]  # symbols of no phrase but their own

    @staticmethod
    def _key(state: np.ndarray, c: np.ndarray) -> np.ndarray:
        return state.astype(np.int64) * 0x200000 + c

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where the symbols lead from the states; 0 means nowhere."""
        if not len(self.keys):
            return self.table[state + c]
        few = c < self.width
        to = self.table[state + np.where(few, c, 0)]
        many = np.flatnonzero(~few)
        if len(many):
            key = self._key(state[many], c[many])
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            to[many] = np.where(self.keys[at] == key, self.targets[at], 0)
        return to

    def symbols(self, text: str) -> np.ndarray:
        """Lower-cased letters as symbols, each run of others as one break."""
        s = self.symbol[code_points(text)]
        return s[~((s == 1) & (np.concatenate(([1], s[:-1])) == 1))]

    def _walk(self, root: int, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases that begin in each segment, state after it) of segments, longest first, that are entered in ``state``.

        A state other than the root is an open phrase; a phrase begins at each symbol that continues none."""
        state, found = state.copy(), np.zeros(len(begin), np.int32)
        for a in range(0, len(begin), 16_384):
            own, n = slice(a, a + 16_384), len(begin[a : a + 16_384])
            live = np.searchsorted(-length[own], -np.arange(int(length[a]) if n else 0), "left")  # segments longer than t
            now, count, first = state[own], found[own], begin[own]
            for t, n in enumerate(live.tolist()):
                c = symbols[first[:n] + t]
                held = now[:n]
                to = self.step(held, c)
                miss = np.flatnonzero((to == 0) | (held == root))
                if len(miss):
                    again = self.step(np.full(len(miss), root, np.int32), c[miss])
                    again[again == 0] = root  # a symbol of no sample is a phrase by itself
                    to[miss] = again
                    count[miss] += 1
                now[:n] = to
        return found, state

    def _walk_one(self, root: int, symbols: list[int], state: int) -> tuple[int, int]:
        """The same for one segment, letter by letter: where a single segment is left, arrays of width one would take longer."""
        table, width, found = self.scalar, self.width, 0
        for c in symbols:
            to = table[state + c] if c < width else int(self.step(np.array([state], np.int32), np.array([c], np.int32))[0])
            if not to or state == root:
                to = (table[root + c] if c < width else int(self.step(np.array([root], np.int32), np.array([c], np.int32))[0])) or root
                found += 1
            state = to
        return found, state

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases by language and text, share of symbols that a language lacks, number of letters of each text)."""
        parts = [self.symbols(t) for t in texts]
        letters = np.array([int((p != 1).sum()) for p in parts], np.int64)
        sizes = np.array([len(p) for p in parts], np.int64)
        symbols = np.concatenate([np.zeros(0, np.uint32), *parts]).astype(np.int32)
        segments = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), segments)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(segments) - segments, segments)  # place of a segment in its text
        text_begin = np.cumsum(sizes) - sizes
        begin = text_begin[owner] + at * SEGMENT
        length = np.minimum(SEGMENT, sizes[owner] - at * SEGMENT)
        order = np.argsort(-length, kind="stable")
        place = np.argsort(order, kind="stable")
        begin, length, at = begin[order], length[order], at[order]
        later = np.flatnonzero(at > 0)
        prior = place[order[later] - 1]  # the segment before each of these
        total, lacked = np.zeros((2, len(self.langs), len(texts)))
        of_text = np.repeat(np.arange(len(texts)), sizes)
        for k, root in enumerate(self.roots.tolist()):
            lacked[k] = np.bincount(of_text, self.lacking[k][symbols], len(texts)) / (sizes + 1) if len(symbols) else 0
            enter = np.full(len(owner), root, np.int32)
            enter[later] = self._walk(root, symbols, begin[later] - BEFORE, np.full(len(later), BEFORE), enter[later])[1]
            found, leave = self._walk(root, symbols, begin, length, enter)
            wrong = np.flatnonzero(enter[later] != leave[prior])
            if len(wrong):  # once for all together; where guesses still fail, one after the other, remembering what comes of what
                redo = later[wrong]
                enter[redo] = leave[prior[wrong]]
                found[redo], leave[redo] = self._walk(root, symbols, begin[redo], length[redo], enter[redo])
                self._mend(root, symbols, begin, length, place, at, enter, found, leave)
            total[k] = np.bincount(owner[order], found, len(texts)) if len(owner) else 0
        return total, lacked, letters

    def _mend(self, root, symbols, begin, length, place, at, enter, found, leave) -> None:
        """Walks the segments again, in the order of the text, whose state on entry is not the one before them on leaving.

        Repeated lines and junk give the same segments in the same states again and again: each such pair is walked once."""
        known: dict[tuple[bytes, int], tuple[int, int]] = {}
        before = np.flatnonzero(at[place] > 0)
        todo = before[enter[place[before]] != leave[place[before - 1]]].tolist()  # in the order of the texts
        for j in todo:
            while j < len(place) and at[place[j]] > 0 and enter[place[j]] != leave[place[j - 1]]:
                p = int(place[j])
                part, state = symbols[begin[p] : begin[p] + length[p]], int(leave[place[j - 1]])
                key = (part.tobytes(), state)
                if key not in known:
                    known[key] = self._walk_one(root, part.tolist(), state)
                enter[p] = state
                found[p], leave[p] = known[key]
                j += 1

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        total, lacked, letters = self.phrases([t or "" for t in texts])
        known = letters > 0
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        best = (total + lacked).argmin(0)  # of as many phrases those with fewer symbols that the sample lacks
        ranked = np.sort(total, 0)
        # the winner's odds when phrases are evidence: 1 for a lone language
        odds = np.exp(-(ranked - ranked[0]) / np.sqrt(np.maximum(ranked[0], 1))).sum(0)
        score = np.where(known, 1 / odds, 0.0)
        return [self.langs[b] if k else "und" for b, k in zip(best, known)], score.tolist()


def language_id(docs: DataFrame, samples: dict[str, list[str]], sample_chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, lang_pred, score (0 to 1).  Workers build the automata from the bounded samples."""
    source = text_rows(docs, id_col, text_col)
    bounded = {lang: even_share(texts, sample_chars) for lang, texts in samples.items() if any(ch.isalpha() for t in texts for ch in t)}

    @released
    def judge(batches):
        own = CrossParser(bounded)
        for batch in batches:
            for ids, texts in slices(batch["text"], batch["doc_id"], 4 << 20):
                lang, score = own.judge(texts.to_pylist())
                yield pa.RecordBatch.from_arrays([ids, pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(judge, f"doc_id {kind}, lang_pred string, score double")
