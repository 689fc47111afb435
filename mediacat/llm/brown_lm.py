"""Brown class-based bigram model: exchange clustering gives classes, class transitions and word emissions give probabilities.

Training counts every token of every training text.  The most frequent words are clustered by the exchange
algorithm over their bigrams.  Then every other training word moves once, over all its bigrams, to the class that
makes them likeliest (its neighbours outside the clustered words count with their suffix class); only words unseen
in training have the class in which clustered words with their last letters have most mass.  log10 p of a text is
the sum over its tokens, the end included, of log10 p(class | class before) + log10 p(word | class); the first
class before is the end's.

* p(c | b) = (bigrams(b, c) + TRANSITION * p(c)) / (bigrams(b) + TRANSITION), p(c) the smoothed share of class c
* p(w | c) = (count(w) + EMISSION) / (tokens of c + EMISSION * (words of c + 1)): one share of EMISSION is left for
  the words that training has not seen

Once every word has its class, the texts are read once more and each is kept as its sequence of classes, a byte a token: class
bigrams and scores both come from these.  The words counted by ``BROADCAST_WORDS`` are looked up in each task; counts and classes of
all other words come by joins of the bigrams that hold one, so no count is dropped.

Null and empty texts have one token, the end; very long texts are read whole, in parts of a batch of bounded bytes; words with equal
counts are ordered by their bytes, and of equally likely classes the first is taken; repeated rows are scored one by one; other columns
are not read, so none can clash; an empty table gives no rows; without training rows every count is zero.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import released, small_batches, stored, text_rows
from .words import slices

#: Words clustered by exchange, classes, rounds over all of them; suffix lengths for the class of unseen words.
CLUSTERED, CLASSES, ROUNDS = 3000, 48, 6
SUFFIXES = (4, 3, 2, 1)
BROADCAST_WORDS = 100_000
EMISSION, TRANSITION = 0.5, 10.0
END = b" "  # no word holds a blank


def _as_binary(words) -> pa.Array:
    return pa.array(words, pa.binary())


def joined(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """(the tokens of all texts one after the other, the place after each text's end)."""
    out: list[bytes] = []
    ends = []
    for text in texts.to_pylist():
        out += (text or "").encode().lower().split()
        out.append(END)
        ends.append(len(out))
    return out, np.array(ends, np.int64)


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array whose items are the bytes of ``values`` up to each of ``ends`` (in values)."""
    offsets = (np.concatenate([[0], ends]) * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def word_counts(train: DataFrame) -> DataFrame:
    """word (binary), c: all tokens of the training texts, summed in each task before they are shuffled."""

    @released
    def count(batches):
        own: Counter[bytes] = Counter()
        for batch in batches:
            for _, texts in slices(batch["text"], pa.array(range(len(batch)))):
                own.update(joined(texts)[0])
                if len(own) > 400_000:
                    yield _counts(own)
                    own.clear()
        yield _counts(own)

    return train.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _counts(own: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_as_binary(list(own)), pa.array(list(own.values()), pa.int64())], ["word", "c"])


def exchange(bigrams: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Classes of words by exchange: each word in turn goes where the class bigram likelihood is highest.

    ``bigrams`` is (words, words); word 0, the end, keeps class 0 for itself.  Words start dealt by frequency."""
    n = len(bigrams)
    freq = bigrams.sum(1) + bigrams.sum(0)
    k = min(classes, max(n, 1))
    of = np.zeros(n, np.int64)
    order = [int(w) for w in np.argsort(-freq[1:], kind="stable") + 1]
    for at, w in enumerate(order):
        of[w] = 1 + at % (k - 1) if k > 1 else 0
    if k < 3:
        return of
    onto = np.zeros((n, k))
    onto[np.arange(n), of] = 1
    right, left = bigrams @ onto, bigrams.T @ onto  # counts of each word with the classes after and before it
    table = onto.T @ right
    row, col = table.sum(1), table.sum(0)
    own = np.diag(bigrams).copy()
    xlogx = lambda x: x * np.log(np.maximum(x, 1e-12))
    succ, pred = bigrams.sum(1), bigrams.sum(0)
    for _ in range(rounds):
        moved = 0
        for w in order:
            a = of[w]
            r, l, s = right[w], left[w], own[w]
            # take w out of its class
            table[a] -= r
            table[:, a] -= l
            table[a, a] += s
            row[a] -= succ[w]
            col[a] -= pred[w]
            r0, l0 = r.copy(), l.copy()
            r0[a] -= s
            l0[a] -= s
            # what each class c gains: its row and column change by w's counts
            gain = (xlogx(table + r0[None, :]) - xlogx(table)).sum(1) + (xlogx(table + l0[:, None]) - xlogx(table)).sum(0)
            d = np.diag(table)
            gain += xlogx(d + r0 + l0 + s) - xlogx(d + r0) - xlogx(d + l0) + xlogx(d)
            gain -= xlogx(row + succ[w]) - xlogx(row) + xlogx(col + pred[w]) - xlogx(col)
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            of[w] = b
            table[b] += r0
            table[:, b] += l0
            table[b, b] += s
            row[b] += succ[w]
            col[b] += pred[w]
            if b != a:
                moved += 1
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[:, a] -= bigrams[w]
                left[:, b] += bigrams[w]
        if moved <= len(order) // 500:
            break
    return of


@dataclass
class Classes:
    """A class for every possible word: a bounded table of clustered words, and of suffixes for the others."""

    words: dict[bytes, int]
    suffixes: dict[bytes, int]
    rest: int
    size: int
    table: np.ndarray  # bigrams of the clustered words by class

    def by_suffix(self, word: bytes) -> int:
        for k in SUFFIXES:
            if len(word) >= k and (c := self.suffixes.get(word[-k:])) is not None:
                return c
        return self.rest

    def of(self, word: bytes) -> int:
        c = self.words.get(word)
        return self.by_suffix(word) if c is None else c


@dataclass
class BrownModel:
    classes: Classes
    transition: np.ndarray  # log10 p(class | class before)
    mass: np.ndarray  # tokens of each class
    types: np.ndarray  # words of each class
    total: int
    distinct: int
    counts: DataFrame  # word, c, k: all training words with their classes
    fitted: Reading  # the documents that the model was fitted with


@dataclass
class Reading:
    """Documents as classes.  rows: doc_id, row, train, n_tokens, n_known, base_score and score as far as the bounded table tells, seq (a
    byte a token: its class, OPEN for words beyond the table); words: row, c, k and pairs: row, train, k1, k2 of those words, or None."""

    rows: DataFrame
    words: DataFrame | None
    pairs: DataFrame | None


def cluster(train: DataFrame, counts: DataFrame, clustered: int, classes: int, rounds: int) -> tuple[Classes, dict[bytes, int]]:
    """The classes that exchange gives the most frequent words, and their counts."""
    top = counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(clustered).union(counts.where(F.col("word") == F.lit(END))).toArrow()  # a bounded number
    known = dict(zip(top["word"].to_pylist(), top["c"].to_pylist()))
    ends = known.pop(END, 0)
    index = {END: 0} | {w: k for k, w in enumerate(sorted(known, key=lambda w: (-known[w], w)), 1)}
    n = len(index)
    place = _Place(index)

    @released
    def pairs(batches):
        own = np.zeros(n * n, np.uint32)
        for batch in batches:
            for _, texts in slices(batch["text"], pa.array(range(len(batch)))):
                words, _ = joined(texts)
                ids = np.concatenate([[0], np.fromiter(map(place.__getitem__, words), np.int64, len(words))])  # an end before the first word of all
                ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
                np.add.at(own, (ids[:-1] * n + ids[1:])[ok], 1)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at].astype(np.int64))], ["pair", "c"])

    bigrams = np.zeros(n * n, np.float64)
    # at most n * n sums come to the driver, whatever the corpus
    for batch in train.select("text").mapInArrow(pairs, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow().to_batches():
        bigrams[batch["pair"].to_numpy()] = batch["c"].to_numpy()
    of = exchange(bigrams.reshape(n, n), classes, rounds)
    mass: dict[bytes, Counter] = {}
    freq = bigrams.reshape(n, n).sum(0)
    for w, k in index.items():
        if w != END:
            for s in {w[-j:] for j in SUFFIXES if len(w) >= j}:
                mass.setdefault(s, Counter())[int(of[k])] += freq[k]
    by_class = np.bincount(of[1:], weights=freq[1:], minlength=2)
    suffixes = {s: max(sorted(c), key=c.__getitem__) for s, c in mass.items()}
    size = max(int(of.max()) + 1, 2)
    onto = np.zeros((n, size))
    onto[np.arange(n), of] = 1
    table = onto.T @ bigrams.reshape(n, n) @ onto
    return Classes({w: int(of[k]) for w, k in index.items()}, suffixes, int(by_class[1:].argmax()) + 1, size, table), known | {END: ends}


class _Place(dict):
    """Places of words; -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return -1


class _Ids(dict):
    """Numbers words as they come, and notes the class of each by ``cls`` and whether exchange has not clustered it."""

    def __init__(self, cls: Classes) -> None:
        self.cls, self.kinds, self.other = cls, [], []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        k = self.cls.words.get(word)
        self.other.append(k is None)
        self.kinds.append(self.cls.by_suffix(word) if k is None else k)
        return at


def all_classes(train: DataFrame, cls: Classes, known: dict[bytes, int]) -> DataFrame:
    """word, c, k: every training word; those that exchange has not clustered go where their bigrams are likeliest."""
    size = cls.size

    @released
    def neighbours(batches):
        """Counts of each other word with the class after it (k) and before it (size + k)."""
        ids, keys = _Ids(cls), []
        kinds, others = np.zeros(0, np.int64), np.zeros(0, bool)

        def summed():
            words, flat = list(ids), np.concatenate(keys) if keys else np.zeros(0, np.int64)
            at, c = np.unique(flat, return_counts=True)
            own, first = np.unique(at // (2 * size), return_index=True)
            near = np.stack([at % (2 * size), c], 1).astype("<u4")
            return pa.RecordBatch.from_arrays([_as_binary([words[i] for i in own.tolist()]), binaries(near.ravel(), 2 * np.append(first[1:], len(at))[: len(own)])], ["word", "near"])

        held = 0
        for batch in batches:
            for _, texts in slices(batch["text"], pa.array(range(len(batch)))):
                words, _ = joined(texts)
                x = np.concatenate([[ids[END]], np.fromiter(map(ids.__getitem__, words), np.int64, len(words))])
                if len(ids) > len(kinds):
                    kinds = np.append(kinds, np.array(ids.kinds[len(kinds) :], np.int64))
                    others = np.append(others, np.array(ids.other[len(others) :], bool))
                k, other = kinds[x], others[x]
                keys.append((x[:-1] * (2 * size) + k[1:])[other[:-1]])
                keys.append((x[1:] * (2 * size) + size + k[:-1])[other[1:]])
                held += len(keys[-1]) + len(keys[-2])
                if len(ids) > 200_000 or held > 4_000_000:
                    yield summed()
                    ids, keys, held = _Ids(cls), [], 0
                    kinds, others = np.zeros(0, np.int64), np.zeros(0, bool)
        yield summed()

    share = (cls.table.sum(1) + 1) / (cls.table.sum(1) + 1).sum()
    step = np.log((cls.table + TRANSITION * share) / (cls.table.sum(1, keepdims=True) + TRANSITION))
    after = step.T - np.log(cls.table.sum(1) + 1)  # of (class after, own class), with the word's share of its class
    weights = np.vstack([after, step])  # the rows below: (class before, own class)

    @released
    def choose(batches):
        """Rows come by word: a word's parts are added up, those of the last word of a batch with the next one's."""
        last, open_ = None, np.zeros(2 * size)  # a word that may go on, and its counts so far

        def chosen(words: pa.Array, dense: np.ndarray):
            gain = dense @ weights
            gain[:, 0] = -np.inf  # the end's
            return pa.RecordBatch.from_arrays([words, pa.array(dense[:, :size].sum(1).astype(np.int64)), pa.array(gain.argmax(1).astype(np.int32))], ["word", "c", "k"])

        for batch in batches:
            if not len(batch):
                continue
            words, flat = batch["word"], batch["near"]
            offsets = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
            near = np.frombuffer(flat.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<u4").reshape(-1, 2).astype(np.int64)
            fresh = np.append(True, pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False))
            at = np.repeat(np.cumsum(fresh) - 1, np.diff(offsets) // 8)
            own = words.take(pa.array(np.flatnonzero(fresh)))
            dense = np.bincount(at * (2 * size) + near[:, 0], near[:, 1], len(own) * 2 * size).reshape(-1, 2 * size)
            if last is not None and own[0].as_py() == last:
                dense[0] += open_
            elif last is not None:
                yield chosen(_as_binary([last]), open_[None, :])
            last, open_ = own[len(own) - 1].as_py(), dense[-1].copy()
            if len(own) > 1:
                yield chosen(own.slice(0, len(own) - 1), dense[:-1])
        if last is not None:
            yield chosen(_as_binary([last]), open_[None, :])

    near = train.select("text").mapInArrow(neighbours, "word binary, near binary").repartition("word").sortWithinPartitions("word")
    clustered = pa.table({"word": _as_binary(list(known)), "c": pa.array(list(known.values()), pa.int64()), "k": pa.array([cls.words[w] for w in known], pa.int32())})
    spark = train.sparkSession
    schema = "word binary, c long, k int"
    return stored(near.mapInArrow(choose, schema).unionByName(spark.createDataFrame(clustered.to_pandas(), schema).where("c > 0")))


def bounded(lexicon: DataFrame, words: int) -> tuple[_Place, np.ndarray, np.ndarray]:
    """The place of each of the most frequent words, a bounded number, and their counts and classes by place."""
    top = lexicon.orderBy(F.desc("c"), "word").limit(words).toArrow()
    return _Place((w, at) for at, w in enumerate(top["word"].to_pylist())), top["c"].to_numpy().astype(np.int64), top["k"].to_numpy().astype(np.int64)


_OPEN_SQL = "array<struct<at: int, w: binary, k: int, before: int, after: int>>"


def occurrences(words: list[bytes], ends: np.ndarray, k: np.ndarray, known: np.ndarray) -> pa.Array:
    """A list a text of its words beyond the bounded table: place, word, its class if it is unseen, and the classes before and
    after it: null if that is such a word too, -1 after the text."""
    at = np.flatnonzero(~known)
    begins = np.append(0, ends[:-1])
    text = np.searchsorted(ends, at, "right")
    first, last = at == begins[text], at == ends[text] - 1
    before, seen = np.where(first, 0, k[at - 1]), first | known[at - 1]
    after, next_seen = np.where(last, -1, k[np.minimum(at + 1, len(k) - 1)]), last | known[np.minimum(at + 1, len(k) - 1)]
    int32 = lambda x, ok=None: pa.array(x.astype(np.int32), mask=None if ok is None else ~ok)
    rows = pa.StructArray.from_arrays(
        [int32(at - begins[text]), _as_binary([words[i] for i in at.tolist()]), int32(k[at]), int32(before, seen), int32(after, next_seen)], ["at", "w", "k", "before", "after"]
    )
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.searchsorted(at, ends)]).astype(np.int32)), rows)


def looked_up(rows: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, c, k of each word in the column ``open`` of ``rows``; row, train, k1, k2 of each bigram that holds one)."""
    one = rows.select("row", "train", F.explode("open").alias("o")).select("row", "train", "o.*")
    own = lexicon.select(F.col("word").alias("w"), "c", F.col("k").alias("own"))
    one = stored(one.join(own, "w", "left").select("row", "train", "at", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("own", "k").alias("k"), "before", "after"))
    left = one.where("after IS NULL").select("row", "train", "at", F.col("k").alias("k1"))
    right = one.where("before IS NULL").select("row", (F.col("at") - 1).alias("at"), F.col("k").alias("k2"))
    pairs = one.where("before IS NOT NULL").select("row", "train", F.col("before").alias("k1"), F.col("k").alias("k2"))
    pairs = pairs.union(one.where("after >= 0").select("row", "train", "k", "after")).union(left.join(right, ["row", "at"]).select("row", "train", "k1", "k2"))
    return one.select("row", "c", "k"), stored(pairs)


#: The byte of a word whose class a join tells.
OPEN = 255


def read(source: DataFrame, lexicon: DataFrame, cls: Classes, mass: np.ndarray, types: np.ndarray, broadcast_words: int) -> Reading:
    """source: doc_id, text, train."""
    source = source.withColumn("row", F.monotonically_increasing_id())
    total, distinct = int(mass.sum()), int(types.sum())
    place, c, kinds = bounded(lexicon, broadcast_words)
    everything = distinct <= len(place)  # no word beyond the table was seen in training
    base_rest = math.log10(total + 0.5 * (distinct + 1))
    emit_rest = np.log10(mass + EMISSION * (types + 1))
    shared = source.sparkSession.sparkContext.broadcast((place, np.append(np.log10(c + 0.5), math.log10(0.5)), np.append(kinds, 0)))  # a bounded number of words

    @released
    def first(batches):
        """Sums over the words of the bounded table, classes, and the other words of a text with their neighbours."""
        place, gain, kinds = shared.value
        of = cls.of
        for batch in batches:
            for at, texts in slices(batch["text"], pa.array(range(len(batch)))):
                words, ends = joined(texts)
                ids = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                begins = np.append(0, ends[:-1])
                seen = ids >= 0
                k = kinds[ids]
                rare = np.flatnonzero(~seen)
                k[rare] = np.fromiter((of(words[i]) for i in rare.tolist()), np.int64, len(rare))
                mine = seen | everything
                summed = lambda x: np.add.reduceat(x, begins)  # noqa: B023, E731
                found = summed(np.where(mine, gain[ids], 0.0))
                n = ends - begins
                more = occurrences(words, ends, k, mine)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(at), batch["row"].take(at), batch["train"].take(at), pa.array(n), pa.array(summed(seen.astype(np.int64))), pa.array(found - n * base_rest),
                     pa.array(found - summed(np.where(mine, emit_rest[k], 0.0))), binaries(np.where(mine, k, OPEN).astype(np.uint8), ends), more],
                    ["doc_id", "row", "train", "n_tokens", "n_known", "base_score", "score", "seq", "open"],
                )

    kind = source.schema["doc_id"].dataType.simpleString()
    rows = stored(source.mapInArrow(first, f"doc_id {kind}, row long, train boolean, n_tokens long, n_known long, base_score double, score double, seq binary, open {_OPEN_SQL}"))
    words, pairs = (None, None) if everything else looked_up(rows, lexicon)
    return Reading(rows.drop("open"), words, pairs)


def _pairs_of(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class before each token, its class, place after each text's end) of sequences of classes; an end comes before the first token."""
    offsets = np.frombuffer(seqs.buffers()[1], np.int32)[seqs.offset : seqs.offset + len(seqs) + 1].astype(np.int64)
    k = np.frombuffer(seqs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.int64)
    offsets = offsets - offsets[0]
    before = np.append(0, k[:-1])
    before[offsets[:-1]] = 0
    return before, k, offsets[1:]


def class_bigrams(reading: Reading, size: int) -> np.ndarray:
    """Class bigrams of the training texts."""

    @released
    def count(batches):
        own = np.zeros((OPEN + 1) * (OPEN + 1), np.int64)
        for batch in batches:
            if len(batch):
                before, k, _ = _pairs_of(batch["seq"])
                own += np.bincount(before * (OPEN + 1) + k, minlength=len(own))
        own = own.reshape(OPEN + 1, OPEN + 1)[:size, :size].ravel()
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at])], ["pair", "c"])

    table = np.zeros((size, size))
    for r in reading.rows.where("train").select("seq").mapInArrow(count, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).collect():
        table[divmod(r["pair"], size)] += r["c"]
    if reading.pairs is not None:
        for r in reading.pairs.where("train").groupBy("k1", "k2").count().collect():
            table[r["k1"], r["k2"]] += r["count"]
    return table


def fit(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", clustered: int = CLUSTERED, classes: int = CLASSES, rounds: int = ROUNDS,
    broadcast_words: int = BROADCAST_WORDS,
) -> BrownModel:
    """Learns from the rows of ``docs`` where ``training`` holds, and reads all rows; ``fitted_scores`` scores them."""
    if not 2 <= classes < OPEN:
        raise ValueError(f"classes must lie between 2 and {OPEN - 1}")
    source = docs.withColumn("_train", F.coalesce(training, F.lit(False))).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col("_train").alias("train"))
    with small_batches(docs.sparkSession):
        train = source.where("train")
        cls, known = cluster(train, stored(word_counts(train)), clustered, classes, rounds)
        size = cls.size
        lexicon = all_classes(train, cls, known)
        mass, types = np.zeros(size), np.zeros(size)
        for r in lexicon.groupBy("k").agg(F.sum("c").alias("mass"), F.count("c").alias("types")).collect():
            mass[r["k"]], types[r["k"]] = r["mass"], r["types"]
        reading = read(source, lexicon, cls, mass, types, broadcast_words)
        table = class_bigrams(reading, size)
    share = (mass + 1) / (mass + 1).sum()
    transition = np.log10((table + TRANSITION * share) / (table.sum(1, keepdims=True) + TRANSITION))
    return BrownModel(cls, transition, mass, types, int(mass.sum()), int(types.sum()), lexicon, reading)


def _scores(reading: Reading, model: BrownModel) -> DataFrame:
    transition, size = model.transition, len(model.transition)
    steps = np.zeros((OPEN + 1, OPEN + 1))
    steps[:size, :size] = transition

    @released
    def add(batches):
        for batch in batches:
            if not len(batch):
                continue
            before, k, ends = _pairs_of(batch["seq"])
            own = np.add.reduceat(steps[before, k], np.append(0, ends[:-1]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["row"], batch["n_tokens"], batch["n_known"], batch["base_score"], pa.array(batch["score"].to_numpy() + own)],
                ["doc_id", "row", "n_tokens", "n_known", "base_score", "score"],
            )

    kind = reading.rows.schema["doc_id"].dataType.simpleString()
    partial = reading.rows.drop("train").mapInArrow(add, f"doc_id {kind}, row long, n_tokens long, n_known long, base_score double, score double")
    if reading.words is not None:
        spark = reading.rows.sparkSession
        emit_rest = np.log10(model.mass + EMISSION * (model.types + 1))
        cells = spark.createDataFrame([(a, b, float(transition[a, b])) for a in range(size) for b in range(size)], "k1 int, k2 int, step double")
        rests = spark.createDataFrame([(a, float(emit_rest[a])) for a in range(size)], "k int, rest double")
        none = F.lit(0.0)
        gain = F.log10(F.col("c") + 0.5)
        words = reading.words.join(F.broadcast(rests), "k").select("row", gain.alias("base"), (gain - F.col("rest")).alias("gain"), F.when(F.col("c") > 0, 1).otherwise(0).alias("more"))
        pairs = reading.pairs.join(F.broadcast(cells), ["k1", "k2"]).select("row", none.alias("base"), F.col("step").alias("gain"), F.lit(0).alias("more"))
        more = words.union(pairs).groupBy("row").agg(*[F.sum(x).alias(x) for x in ("base", "gain", "more")])
        plus = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
        partial = partial.join(more, "row", "left").select("doc_id", "n_tokens", plus("n_known", "more"), plus("base_score", "base"), plus("score", "gain"))
    return partial.select(
        "doc_id", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    )


def fitted_scores(model: BrownModel) -> DataFrame:
    """One row a document that ``fit`` was given: doc_id, n_tokens, n_known, train_tokens, base_score (unigram), score, perplexity."""
    return _scores(model.fitted, model)


def perplexity_scores(docs: DataFrame, model: BrownModel, id_col: str = "doc_id", text_col: str = "text", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The same for any documents."""
    with small_batches(docs.sparkSession):
        reading = read(text_rows(docs, id_col, text_col).withColumn("train", F.lit(False)), model.counts, model.classes, model.mass, model.types, broadcast_words)
    return _scores(reading, model)
