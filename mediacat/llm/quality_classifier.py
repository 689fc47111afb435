"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration.

Every whole text becomes a vector of statistics.  A bounded sample of labelled rows fits their scale, the
ridge weights on the Fourier features (each task sums its own normal equations) and, on rows of the
sample that the ridge has not seen, the isotonic calibration.  Null and empty texts have the statistics
of no words and are scored like any other; very long texts are measured whole; repeated rows are scored
one by one; a score equal to the threshold is predicted 1, and of several labels of a document the least counts;
an empty table gives no rows; other columns are not read; without labels of both kinds every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import carried_columns, carried_part, carried_schema, released, stored, text_rows
from .words import slices

#: Bound of the fitted sample, in labelled rows.
SAMPLE_ROWS = 20_000
FEATURES, WIDTH, RIDGE, SEED = 256, 3.0, 1.0, 7
THRESHOLD = 0.7

NAMES = ["log_words", "mean_word", "sd_word", "upper", "digit", "symbol", "punct", "non_ascii", "white", "exclaim", "distinct",
         "top_word", "adjacent", "log_lines", "mean_line", "dup_lines", "pipe_lines", "marked_words", "short_words", "ended_lines"]

_KIND = np.zeros(128, np.uint8)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>@^~=+_\\{}[]", ".,;:?'\"-()/", " \t\n\r\x0b\x0c", "!"), 1):
    for _c in _chars:
        _KIND[ord(_c)] = _k


def statistics(text: str | None) -> list[float]:
    text = text or ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_ = points[points < 128]
    kinds = np.bincount(_KIND[ascii_], minlength=7)
    n = max(len(points), 1)
    words = text.split()
    m = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(len(lines), 1)
    marked = sum(w[-1] in "#*$%&|!<>@" for w in words)
    solid = max(n - kinds[5], 1)
    return [
        np.log1p(len(words)), min(lengths.mean(), 60), min(lengths.std(), 60), kinds[1] / solid, kinds[2] / solid, kinds[3] / solid, kinds[4] / solid,
        (len(points) - len(ascii_)) / solid, kinds[5] / n, kinds[6] / m, len(counts) / m, max(counts.values(), default=0) / m,
        sum(a == b for a, b in zip(words, words[1:])) / m, np.log1p(len(lines)), np.log1p(len(words) / k), (len(lines) - len(set(lines))) / k,
        sum("|" in x for x in lines) / k, marked / m, float((lengths <= 3).sum()) / m, sum(x.rstrip()[-1] in ".!?" for x in lines) / k,
    ]


def vectors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    source = text_rows(docs, id_col, text_col)

    @released
    def measure(batches):
        for batch in batches:
            for ids, texts in slices(batch["text"], batch["doc_id"]):
                values = pa.array(np.array([statistics(t) for t in texts.to_pylist()]).ravel())
                yield pa.RecordBatch.from_arrays([ids, pa.FixedSizeListArray.from_arrays(values, len(NAMES)).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    return source.mapInArrow(measure, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    base: float | None = None

    def fourier(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(x), self.base)
        return np.clip(np.interp(self.fourier(x) @ self.weights, self.knots, self.values), 0, 1)


def fourier(z: np.ndarray) -> np.ndarray:
    """Features whose dot products approximate a Gaussian kernel of ``WIDTH`` over scaled statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, 1 / WIDTH, (len(NAMES), FEATURES))
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    out = np.sqrt(2 / FEATURES) * np.cos(np.clip(z, -8, 8) @ w + b)
    return np.hstack([out, np.ones((len(z), 1))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best non-decreasing fit of y by x: the middle of each pooled block, and its mean."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of x
    for a, b in zip(x[order], y[order]):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + c, blocks[-1][2] + t]
    return np.array([t / c for _, c, t in blocks]), np.array([s / c for s, c, _ in blocks])


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, rows: int) -> DataFrame:
    """One row a labelled document, at most about ``rows`` of them, by a hash of the id."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.min("y").alias("y"))
    n = known.count()
    share = min(1.0, rows / max(n, 1))
    return known.where(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from the labels given; the caller leaves out those it holds out."""
    sample = labelled_sample(labels, id_col, label_col, sample_rows)
    # the sample has a bounded number of short rows, so every task may hold it
    rows = stored(vectors(docs.join(F.broadcast(sample.select(F.col("doc_id").alias(id_col))), id_col, "left_semi"), id_col, text_col).join(F.broadcast(sample), "doc_id"))
    scale = rows.select(*[f(F.element_at("x", k + 1)).alias(f"{n}{k}") for k in range(len(NAMES)) for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.count("y").alias("n"), F.sum("y").alias("ones")).first()
    zeros = np.zeros(1)
    if not scale["n"] or scale["ones"] in (0, scale["n"]):
        return Model(zeros, zeros, zeros, zeros, zeros, base=scale["ones"] / scale["n"] if scale["n"] else 0.5)
    mean = np.array([scale[f"m{k}"] for k in range(len(NAMES))])
    spread = np.maximum([scale[f"s{k}"] for k in range(len(NAMES))], 1e-6)
    split = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(10)) < 4

    def sums(batches):
        gram, moment = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            x = np.array(batch["x"].to_pylist()).reshape(-1, len(NAMES))
            phi = fourier((x - mean) / spread)
            y = batch["y"].to_numpy(zero_copy_only=False).astype(float)
            weight = batch["w"].to_numpy(zero_copy_only=False)
            gram += (phi * weight[:, None]).T @ phi
            moment += phi.T @ (weight * y)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([moment.tobytes()], pa.binary())], ["gram", "moment"])

    ones = scale["ones"] / scale["n"]
    weight = F.when(F.col("y") == 1, 0.5 / ones).otherwise(0.5 / (1 - ones))  # both labels weigh the same in the ridge
    gram, moment = RIDGE * np.eye(FEATURES + 1), np.zeros(FEATURES + 1)
    for r in rows.where(~split).select("x", "y", weight.alias("w")).repartition(8).mapInArrow(sums, "gram binary, moment binary").collect():
        gram += np.frombuffer(r["gram"]).reshape(gram.shape)
        moment += np.frombuffer(r["moment"])
    model = Model(mean, spread, np.linalg.solve(gram, moment), zeros, zeros)
    held = rows.where(split).select("doc_id", "x", "y").orderBy("doc_id").collect()  # bounded: part of the sample
    if not held or len({r["y"] for r in held}) < 2:
        held = rows.select("doc_id", "x", "y").orderBy("doc_id").collect()
    x = model.fourier(np.array([r["x"] for r in held])) @ model.weights
    model.knots, model.values = isotonic(x, np.array([float(r["y"]) for r in held]))
    return model


def quality_scores(
    docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """One row a document: doc_id, score (0 to 1), predicted (1 where score >= threshold), and ``carried`` if asked for."""
    source = text_rows(docs, id_col, text_col, carry)
    names = ["doc_id", "score", "predicted", *(["text", "carried"] if carry else [])]

    @released
    def judge(batches):
        for batch in batches:
            for where, texts in slices(batch["text"], pa.array(range(len(batch)))):
                score = model.score(np.array([statistics(t) for t in texts.to_pylist()]))
                own = [batch["doc_id"].take(where), pa.array(score), pa.array((score >= threshold).astype(np.int32)), *carried_part(batch, where)]
                yield pa.RecordBatch.from_arrays(own, names)

    found = source.mapInArrow(judge, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double, predicted int{carried_schema(source)}")
    return found.select("doc_id", "score", "predicted", *carried_columns(carry, text_col))
