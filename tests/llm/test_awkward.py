"""Every operator on awkward tables: nulls in any column, empty and very long texts, ties, repeated rows, no rows, clashing names."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mediacat.llm import brown_lm, decontamination, html_extraction, jaccard_join, langid, packing, quality_classifier, quality_rules, token_counts, url_filters

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PROSE = " ".join(f"the of word{k} und" for k in range(60))
ROWS = [(1, None), (2, ""), (2, ""), (None, PROSE), (3, PROSE), (3, PROSE), (4, PROSE + " more"), (5, "word " * 40_000), (6, " \n\t "), (7, "é" * 5000), (None, None), (8, "x"), (8, "another text of this id")]
#: Names that the operators use themselves, here with values and types of their own.
CLASH = ["n_tokens", "n_bytes", "score", "predicted", "lang_pred", "h", "fp", "n", "sig", "prefix", "row", "carried", "matches", "piece", "length", "g", "seq", "open", "train", "k", "c", "word", "w", "m",
         "kept", "base_failed", "x", "y", "label", "root", "own", "times", "held_out", "lex", "host", "path", "rule", "template", "purity"]


def tables(spark, rows, names):
    plain = spark.createDataFrame(rows, names)
    return plain, plain.select("*", *[F.lit("odd").alias(x) if k % 2 else F.lit(None).cast("int").alias(x) for k, x in enumerate(CLASH) if x not in plain.columns])


def bench(spark):
    return spark.createDataFrame([(1, "the of word3 und the of word4 und the of word5 und"), (1, "the of word3 und the of word4 und the of word5 und"), (2, None), (None, "x")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(3, 1), (4, 1), (8, 0), (8, 1), (2, 0), (None, 1), (5, None)], "doc_id long, quality int")


OPERATORS = {
    "token_counts": lambda s, d: token_counts.token_counts(d, BYTE),
    "decontamination": lambda s, d: decontamination.decontamination(d, bench(s)).select("doc_id", "contaminated"),
    "language_id": lambda s, d: langid.language_id(d, {"aa": [PROSE], "bb": ["ééé"]}),
    "packing": lambda s, d: packing.best_fit_packing(d, WORD).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "brown_lm": lambda s, d: brown_lm.fitted_scores(brown_lm.fit(d, F.col("doc_id") > 2)).select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("score", 6)),
    "quality_classifier": lambda s, d: quality_classifier.quality_scores(d, quality_classifier.fit(d, labels(s))).select("doc_id", F.round("score", 6), "predicted"),
    "jaccard_join": lambda s, d: jaccard_join.jaccard_components(d, 4, 85),
    "quality_rules": lambda s, d: quality_rules.quality_rules(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, name):
    plain, clashing = tables(spark, ROWS, "doc_id long, text string")
    want = sorted(str(tuple(r)) for r in OPERATORS[name](spark, plain).collect())
    assert sorted(str(tuple(r)) for r in OPERATORS[name](spark, clashing).collect()) == want
    if name != "packing":
        assert len(want) == len(ROWS)
    same = [r for r in want if r.startswith("(3,")]
    assert len(same) >= 2 and len(set(same)) == len(same) // 2  # repeated rows are alike
    assert OPERATORS[name](spark, clashing.limit(0)).count() == 0


def test_pages(spark):
    rows = [(1, "http://a.org/x", None), (None, None, "<p>Words and words.</p>"), (2, "", ""), (2, "", ""), (3, "http://b.com/" + "deep/" * 300, "<p>" + "long words " * 20_000 + "</p>"), (4, "://", "<"), (4, "http://h", "text")]
    plain, clashing = tables(spark, rows, "page_id long, url string, html string")
    for apply in (html_extraction.extract, lambda d: url_filters.url_filters(d).drop("template", "purity")):
        want = sorted(str(tuple(r)) for r in apply(plain).collect())
        assert len(want) == len(rows) and sorted(str(tuple(r)) for r in apply(clashing).collect()) == want
        assert apply(clashing.limit(0)).count() == 0


def test_carried_columns_come_along(spark):
    _, clashing = tables(spark, ROWS, "doc_id long, text string")
    carry = ["text", "score", "row", "doc_id"]
    want = sorted(str(tuple(r)) for r in clashing.select(*carry).collect())
    model = quality_classifier.fit(clashing, labels(spark))
    for out in (quality_classifier.quality_scores(clashing, model, carry=carry), decontamination.decontamination(clashing, bench(spark), carry=carry)):
        assert sorted(str(tuple(r)) for r in out.select("carried.*").select(*carry).collect()) == want


def test_one_of_each_group_stays(spark):
    plain, _ = tables(spark, ROWS, "doc_id long, text string")
    got = {(r["own"], r["times"]) for r in jaccard_join.representatives(plain, 5, 80).collect()}
    # 3 stands for its copy, the row without an id and the near copy; texts without words stand for themselves
    assert got == {(1, 1), (2, 2), (3, 2), (5, 1), (6, 1), (7, 1), (None, 1), (8, 1)}


def test_block_size_changes_no_result_and_the_bins_meet_the_bound():
    import random

    rnd = random.Random(7)
    for _ in range(20):
        lengths = [rnd.randint(1, 60) for _ in range(rnd.randint(1, 200))]  # many pieces a bin
        out = packing.complete(lengths, 100)
        assert sorted(n for b in out for n in b) == sorted(lengths) and max(map(sum, out)) <= 100
        assert packing.least_bins(lengths, 100) <= len(out) <= packing.least_bins(lengths, 100) + 1
    assert packing.fillings(Counter([1] * 40), 30, 1) == [(1,) * 30]
    assert packing.fits_into((2, 2, 1), (4, 1)) and not packing.fits_into((3, 3), (5,))


def test_bins_against_every_packing():
    import random
    from itertools import combinations

    def fewest(lengths):
        best = len(lengths)

        def place(left, bins):
            nonlocal best
            if bins >= best:
                return
            if not left:
                best = bins
                return
            first, rest = left[0], left[1:]
            for n in range(len(rest) + 1):
                for chosen in combinations(range(len(rest)), n):
                    if first + sum(rest[i] for i in chosen) <= 10:
                        place([x for i, x in enumerate(rest) if i not in chosen], bins + 1)

        place(sorted(lengths, reverse=True), 0)
        return best

    rnd = random.Random(3)
    for _ in range(25):
        lengths = [rnd.randint(2, 8) for _ in range(8)]
        assert len(packing.complete(lengths, 10)) == fewest(lengths)


def test_ids_of_any_tokenizer():
    from tokenizers import Tokenizer
    import pyarrow as pa

    texts = ["Ab CD ef-GH's", "", None, "x  y\n"]
    library, own = Tokenizer.from_file(BYTE), packing.ChunkIds(BYTE)
    assert not own.in_units and packing.ChunkIds(WORD).in_units
    flat, first = own.encode(pa.array(texts), 1)
    for t, a, b in zip(texts, first[:-1], first[1:]):
        assert flat[a:b].tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 1]


def test_fourier_features_approximate_the_kernel(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    z = rng.normal(size=(40, len(quality_classifier.NAMES))) * 0.6
    phi = quality_classifier.fourier(z)[:, :-1]
    gap = ((z[:, None, :] - z[None, :, :]) ** 2).sum(-1)
    kernel = np.exp(-gap / (2 * quality_classifier.WIDTH**2))
    assert np.abs(phi @ phi.T - kernel).mean() < 0.08


def test_summed_normal_equations_equal_one_solve(spark):
    import numpy as np

    texts = [(k, ("fine words stand here, and more of them. " * (k % 7 + 1)) if k % 2 else "BUY!!! $$$ " * (k % 5 + 1)) for k in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    marks = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, marks)
    split = {r["doc_id"]: r["s"] for r in marks.select("doc_id", (F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(10)) < 4).alias("s")).collect()}
    x = np.array([quality_classifier.statistics(t) for _, t in texts])
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-6)
    phi, y = quality_classifier.fourier(z), np.array([k % 2 for k in range(80)], float)
    own = np.array([not split[k] for k in range(80)])
    gram = quality_classifier.RIDGE * np.eye(phi.shape[1]) + phi[own].T @ phi[own]
    want = np.linalg.solve(gram, phi[own].T @ y[own])  # both labels are as frequent: all weights are 1
    assert np.allclose(model.weights, want, atol=1e-6)
