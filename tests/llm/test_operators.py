"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on awkward rows."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from mediacat.llm import brown_lm, decontamination, html_extraction, jaccard_join, langid, packing, quality_classifier, queries, words
from mediacat.llm.components import components
from mediacat.llm.token_counts import TokenCounter, token_counts
from oracle import spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
AWKWARD = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a b c", None), (4, "word " * 30000, None), (5, "é" * 3000, "x"), (6, "the same words stand here", None), (7, "the same words stand here", None), (8, "the", "y")]


def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def split(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string, score string")


def strings():
    rnd = random.Random(1)
    alphabet = "JhTI\u030c\u0331\u0307.,'<|>()A \n\t'sabÀ1.,<|>é  x  　\x1c\x85​﻿́İß×ªΣ"
    out = ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 3, 20, 200]))) for _ in range(1500)]
    return out + ["a<|endoftext|><|endoftext|> b", " 's don't I'LL we'll", "aaaa" * 60, "日本語 テキスト", "x" * 3000, " ", "\n \n\n"] + [d["text"] for d in documents()]


def test_word_hashes_follow_words():
    texts = ["Ab ab  c\x0bD", None, "", " x", "é É"]
    h, first = words.word_hashes(pa.array(texts))
    assert np.diff(first).tolist() == [4, 0, 0, 1, 2]
    assert h[0] == h[1] and len(set(h.tolist())) == 6
    sets = words.shingle_sets(pa.array(["a b c d e", "b c d e", "a b", "b a", None]), 4)
    assert [len(s) for s in sets] == [2, 1, 1, 1, 0] and sets[1][0] in sets[0] and sets[2][0] != sets[3][0]


def test_min_cut_is_minimal():
    rnd = random.Random(3)
    for _ in range(150):
        n = rnd.randint(1, 8)
        u = [rnd.choice([-1, 1]) * rnd.random() * 2 for _ in range(n)]
        e = {(a, b): rnd.random() for a in range(n) for b in range(a) if rnd.random() < 0.5}
        cost = lambda lab: sum(x for x, k in zip(u, lab) if x > 0 and not k) + sum(-x for x, k in zip(u, lab) if x < 0 and k) + sum(w for (a, b), w in e.items() if lab[a] != lab[b])  # noqa: B023, E731
        assert cost(html_extraction.min_cut(u, e)) == pytest.approx(min(cost(lab) for lab in itertools.product([True, False], repeat=n)))


def test_extraction(spark):
    import html

    pages = {r["page_id"]: r for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    for r in queries.op1_html_extraction(spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]
    df = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", "<p"), (2, "u", "<article>" + "<p>word word.</p>" * 5000)], "page_id long, url string, html string")
    assert sorted(r["n_chars"] for r in html_extraction.extract(df).collect()) == [0, 0, 0, 5000 * 12 - 2]
    assert html_extraction.extract(df.limit(0)).count() == 0


LONG, MORE = "A long enough paragraph of the article, with several words and a full stop at its end.", "Another paragraph goes on with the story and it ends with a full stop as well."
SIDE = "<div class='sidebar'><h3>More</h3><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></div>"
#: Pages of several layouts, and their articles.
PAGES = [
    (f"<body><div class='layout with-sidebar'><article><h1>T</h1><p>{LONG}</p><p>{MORE}</p></article>{SIDE}</div></body>", ["T", LONG, MORE]),
    (f"<body><div class='page comments open'><article><h1>T</h1><p>{LONG}</p><p>{MORE}</p></article><div id=comments><p>Nice article, thank you so much for it!</p></div></div></body>", ["T", LONG, MORE]),
    (f"<body><article><div class='entry-header'><h1>The title</h1></div><p>{LONG}</p></article></body>", ["The title", LONG]),
    (f"<body><header class=site-header><a href=/>Home</a></header><article><header class='entry-header'><h1>The title</h1></header><p>{LONG}</p></article></body>", ["The title", LONG]),
    (f"<article><p>Here is <math><mi>x</mi></math> in the middle of a paragraph.</p><p>{LONG}</p></article>", ["Here is x in the middle of a paragraph.", LONG]),
    (f"<article><p>{LONG}</p><ul><li><a href=a>first linked item</a></li><li><a href=b>second linked item</a></li></ul><p>{MORE}</p></article>", [LONG, "first linked item", "second linked item", MORE]),
    (f"<html><head><title>x</title><meta a=b><div><article><p>{LONG}</p></article></div>", [LONG]),
    (f"<head><title>x</title><p>{LONG}</p><p>{MORE}</p>", [LONG, MORE]),
    (f"<body><form id=f1><div><h1>T</h1><p>{LONG}</p><p>{MORE}</p></div></form></body>", ["T", LONG, MORE]),
    (f"<body><main><article><h1>T</h1><p>{LONG}</p></article><section id=comments><h3>Comments</h3><article><p>A fine and long enough article, thanks.</p></article><article><p>{MORE}</p></article></section></main></body>", ["T", LONG]),
    ("<body><header>Site</header><main><article><h1>T</h1><p>a b &lt;c&gt;.<form><label>mail</label></form><aside>More</aside></article><section id=comments><h3>Comments</h3><article><p>A fine and long enough article, thanks.</p></article></section></main><div class='cookie-notice'>We use cookies here.</div>", ["T", "a b <c>."]),
    (f"<body><div class='header'><h1>Site name</h1><p>Tagline</p></div><div class=post><h2>T here</h2><p>{LONG}</p><p>{MORE}</p></div><div class=footer><p>Copyright by the owners, all rights reserved here.</p></div></body>", ["T here", LONG, MORE]),
]


@pytest.mark.parametrize("page, article", PAGES)
def test_layouts(page, article):
    assert html_extraction.main_text(page).split("\n\n") == article


def test_unclosed_elements_swallow_nothing():
    got = html_extraction.main_text(f"<body><article><h1>T</h1><button>Go<p>{LONG}</p><svg><p>{MORE}</p></article></body>").split("\n\n")
    assert {"T", LONG, MORE} <= set(got)


def test_token_counts(spark, awkward):
    library, texts = Tokenizer.from_file(BYTE), strings()
    assert TokenCounter(BYTE).count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = sorted(str(tuple(r)) for r in token_counts(awkward, BYTE).collect())
    want = sorted(str((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024)) for i, t, _ in AWKWARD)
    assert got == want and token_counts(awkward.limit(0), BYTE).count() == 0


def check_packing(rows, texts):
    library = Tokenizer.from_file(WORD)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    seen, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, pieces in seen.items():
        pieces = sorted(set(pieces))
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and sum(n for _, _, n in pieces) == len(ids[i])
        assert all(n == 4096 for _, _, n in pieces[:-1])
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    return len(bins), -(-sum(r["length"] for r in rows) // 4096)


def test_packing(spark, awkward):
    rows = queries.op5_best_fit_packing(spark, SF).collect()
    bins, bound = check_packing(rows, [(d["doc_id"], d["text"]) for d in documents()])
    assert bins <= bound + 1
    rows = packing.best_fit_packing(awkward.where("doc_id <> 2 OR doc_id IS NULL"), WORD).collect()
    check_packing(rows, [(i, t) for i, t, _ in AWKWARD])
    assert packing.best_fit_packing(awkward.limit(0), WORD).count() == 0
    library, texts = Tokenizer.from_file(WORD), strings()
    flat, first = packing.ChunkIds(WORD).encode(pa.array([*texts, None]), 1)
    for t, a, b in zip([*texts, ""], first[:-1], first[1:]):
        assert flat[a:b].tolist() == [*library.encode(t, add_special_tokens=False).ids, 1]


def test_bin_completion_beats_best_fit():
    lengths = [6, 5, 5, 4, 4, 3, 3]  # best fit leaves gaps of one; two bins of 6+... do not
    assert sum(lengths) == 30 and len(packing.complete(lengths, 10)) == 3
    rnd = random.Random(5)
    for _ in range(30):
        lengths = [rnd.randint(20, 60) for _ in range(24)]
        out = packing.complete(lengths, 100)
        assert sorted(n for b in out for n in b) == sorted(lengths) and max(map(sum, out)) <= 100 and len(out) <= len(packing.best_fit(lengths, 100))


def brute_contamination(docs, items):
    """doc_id -> items that one of the text's windows holds, all windows of all texts compared."""
    cut = lambda t: re.findall(r"[^\x00-\x20!-/:-@\[-`{-~]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    held = collections.Counter(g for t in items.values() for g in set(shingles(cut(t))))
    bag = lambda w: {g: c / held.get(g, 1) for g, c in collections.Counter(shingles(w)).items()}
    want = {}
    for d in docs:
        w = cut(d["text"])
        own, hits = set(shingles(w)), set()
        for i, t in items.items():
            o, n = bag(cut(t)), len(cut(t))
            if own.isdisjoint(o):
                continue
            for a in range(max(1, len(w) - n + 1)):
                b = bag(w[a : a + n])
                common = sum(min(v, o.get(g, 0)) for g, v in b.items())
                if common >= 0.8 * (sum(b.values()) + sum(o.values()) - common) - 1e-12:
                    hits.add(i)
                    break
        want[d["doc_id"]] = hits
    return want


def test_decontamination(spark, awkward):
    want = brute_contamination(documents(), {b["item_id"]: b["text"] for b in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()})
    got = {r["doc_id"]: set(r["item_ids"]) for r in queries.op3_decontamination(spark, SF).collect()}
    assert got == want and any(want.values())
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "same words"), (4, "The same, words stand here!"), (5, "nothing of this sort is there at all")], "item_id long, text string")
    for block in (100, 2):
        out = decontamination.decontamination(awkward, bench, item_block=block)
        assert sorted((r["doc_id"], [m["item_id"] for m in r["matches"]]) for r in out.where("contaminated").collect()) == [(6, [3, 4]), (7, [3, 4])]
        assert out.count() == len(AWKWARD)
    assert decontamination.decontamination(awkward, bench.limit(0)).where("contaminated").count() == 0


def test_hamming_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = []
    for k, b in enumerate(base):
        bits = rng.choice(64, size=k % (decontamination.RADIUS + 1), replace=False)
        near.append(int(b) ^ int(sum(1 << int(x) for x in bits)))
    q, p = decontamination.HammingIndex(base).search(np.array(near, np.uint64))
    assert {(k, k) for k in range(40)} <= set(zip(q.tolist(), p.tolist()))


def test_language_id(spark, awkward):
    truth = {d["doc_id"]: d["lang"] for d in documents()}
    rows = queries.op4_language_id(spark, SF).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    samples = {"xx": ["the same words stand there"], "yy": ["ééé àà"]}
    got = sorted(str(tuple(r)[:2]) for r in langid.language_id(awkward, samples).collect())
    assert got == sorted(str((i, "und" if not t else "yy" if "é" in t else "xx")) for i, t, _ in AWKWARD)
    assert {r["lang_pred"] for r in langid.language_id(awkward, {}).collect()} == {"und"}


def greedy(parser, sample, text):
    """Phrases of a whole text, one after the other; symbols that the sample lacks are phrases by themselves."""
    reference, symbols = ("".join(chr(256 + x) for x in parser.symbols(t).tolist()) for t in (sample, text))
    n = at = 0
    while at < len(symbols):
        k = 1
        while symbols[at] in reference and at + k < len(symbols) and symbols[at : at + k + 1] in reference:
            k += 1
        at, n = at + k, n + 1
    return n


@pytest.mark.parametrize("segment, before", [(256, 40), (7, 2), (5, 0)])
def test_cross_parsing_counts_phrases(monkeypatch, segment, before):
    monkeypatch.setattr(langid, "SEGMENT", segment)
    monkeypatch.setattr(langid, "BEFORE", before)
    parser = langid.CrossParser({"r": "abcabd"})
    assert parser.phrases(["abczabc", "abczzabcz", "zza", "ddd"])[0][0].tolist() == [3, 5, 3, 3]
    rnd = random.Random(8)
    for _ in range(12):  # letters of the sample, others and breaks, up to many segments
        samples = {"q": "xyz abc xyzzy", "r": "".join(rnd.choice("abcd  .") for _ in range(rnd.choice([3, 50, 300]))) + "a"}
        parser = langid.CrossParser(samples)
        texts = ["".join(rnd.choice("abcdz é-1 ") for _ in range(rnd.choice([0, 5, 60, 900]))) for _ in range(6)]
        found = parser.phrases(texts)[0]
        assert [found[k].tolist() for k in (0, 1)] == [[greedy(parser, samples[x], t) for t in texts] for x in parser.langs]


def tokens(text):
    return [*(w.encode() for w in split(text)), b" "]


def test_brown_lm(spark, awkward):
    docs = documents()
    training = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 5 != 1]
    counts = collections.Counter(w for d in training for w in [*split(d["text"]), None])
    n, v = sum(counts.values()), len(counts)
    rows = queries.op6_brown_lm(spark, SF).collect()
    text = {d["doc_id"]: [*split(d["text"]), None] for d in docs}
    for r in rows:
        w = text[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    frame = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string")
    model = brown_lm.fit(frame, frame["doc_id"] % 2 == 0)
    whole, few = ({r["doc_id"]: (r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in brown_lm.perplexity_scores(frame, model, broadcast_words=k).collect()} for k in (10**6, 50))
    assert whole == few == {r["doc_id"]: (r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in brown_lm.fitted_scores(model).collect()}
    # every score by hand, from the classes, counts and transitions of the model
    lexicon = {bytes(r["word"]): (r["c"], r["k"]) for r in model.counts.collect()}
    for d in docs:
        before = want = 0
        for w in tokens(d["text"]):
            c, k = lexicon.get(w) or (0, model.classes.of(w))
            want += model.transition[before, k] + math.log10((c + brown_lm.EMISSION) / (model.mass[k] + brown_lm.EMISSION * (model.types[k] + 1)))
            before = k
        assert whole[d["doc_id"]][2] == pytest.approx(want, abs=1e-5)
    # emissions and transitions are distributions: over all words, known or not, after any class
    assert np.allclose((10**model.transition).sum(1), 1)
    assert brown_lm.perplexity_scores(awkward, model).count() == len(AWKWARD)
    assert brown_lm.perplexity_scores(awkward, brown_lm.fit(awkward.limit(0), awkward["doc_id"] > 0)).count() == len(AWKWARD)


def test_exchange_separates_alternating_words():
    big = np.zeros((7, 7))
    for a in (1, 2, 3):
        for b in (4, 5, 6):
            big[a, b] = big[b, a] = 10
    of = brown_lm.exchange(big, 3, 10)
    assert len(set(of[1:4])) == 1 and len(set(of[4:7])) == 1 and of[1] != of[4]


def test_brown_classes_of_rare_words_follow_their_neighbours(spark):
    # "sat" and "met" come where "xa" and "ya" do, but share their last letters with "at" and "et"
    texts = ["at xa et ya", "et xa at ya", "at ya et xa"] * 20 + ["at sat et ya", "et sat at xa", "at met et met"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole, few = (brown_lm.fit(frame, frame["doc_id"] >= 0, clustered=4, classes=3, broadcast_words=k) for k in (1000, 2))
    k = {bytes(r["word"]): r["k"] for r in whole.counts.collect()}
    assert k[b"sat"] == k[b"met"] == k[b"xa"] == k[b"ya"] != k[b"at"] == k[b"et"] and len(k) == 7
    assert {bytes(r["word"]): r["c"] for r in whole.counts.collect()} == collections.Counter(w for t in texts for w in tokens(t))
    # every bigram counts with these classes, whether its words are in the bounded table or joined
    table = np.zeros((3, 3))
    for t in texts:
        ids = [0, *(k[w] for w in tokens(t))]
        for a, b in zip(ids, ids[1:]):
            table[a, b] += 1
    share = (whole.mass + 1) / (whole.mass + 1).sum()
    want = np.log10((table + brown_lm.TRANSITION * share) / (table.sum(1, keepdims=True) + brown_lm.TRANSITION))
    assert np.allclose(whole.transition, want) and np.allclose(few.transition, want)


def test_quality_classifier(spark, awkward):
    truth = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    rows = queries.op7_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.93 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    x, y = quality_classifier.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert y.tolist() == [0, 0.5, 1] and (np.diff(x) > 0).all()
    labels = spark.createDataFrame([(4, 1), (4, None), (None, 0)], "doc_id long, quality int")
    model = quality_classifier.fit(awkward, labels)
    assert {r["score"] for r in quality_classifier.quality_scores(awkward, model).collect()} == {1.0}
    assert quality_classifier.quality_scores(awkward, quality_classifier.fit(awkward, labels.limit(0))).first()["score"] == 0.5


def test_url_filters(spark):
    assert spark_rows(queries.op8_url_filters(spark, SF)) == sql_rows(queries.OP8_SQL, "sf0.001")
    from mediacat.llm.url_filters import url_filters

    urls = [None, "no-scheme", "http://EXAMPLE.org/es/1?x", "https://a.example.org/en/12#t", "http://x.org", "http://x.org/", "http://b.com/de/", "http://notexample.net/es/", "http://c.com/fr/x", "http://u?q=/a"]
    df = spark.createDataFrame([(k, u, "z") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters(df).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("example.org", "/es/1", "example.org/es/", "block") and got[3] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[4] == ("x.org", "", None, "allow") and got[5][2:] == ("org/", "allow") and got[6][2:] == ("com/de/", "block") and got[7][2] is None
    assert got[8][2:] == ("com/fr/", "allow") and got[9][:2] == ("u", "") and url_filters(df.limit(0)).count() == 0
    blocked = spark.createDataFrame([(k, f"http://h.com/de/{k}") for k in range(60)] + [(100, "http://h.com/xx/7")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filters(blocked).collect()}[100] == "block"


def test_path_tree_of_any_depth(spark):
    """Labelled sections that differ only deep down, and a blocked section among many allowed ones."""
    from mediacat.llm.url_filters import url_filters

    rules = [("block", f"deep.com/a/b/c/d/spam/{k}") for k in range(6)] + [("allow", f"deep.com/a/b/c/d/good/{k}") for k in range(6)]
    rules += [("allow", f"wide.com/s{chr(97 + k)}/x") for k in range(12)] + [("block", "wide.com/bad/x")]
    urls = [f"http://deep.com/a/b/c/d/{kind}/{k}{j}" for kind in ("spam", "good") for k in range(6) for j in range(8)]
    urls += [f"http://wide.com/s{chr(97 + k)}/x{j}" for k in range(12) for j in range(10)] + [f"http://wide.com/bad/x{j}" for j in range(60)]
    open_ = ["http://deep.com/a/b/c/d/spam/999", "http://deep.com/a/b/c/d/good/999", "http://wide.com/bad/7", "http://wide.com/sb/7", "http://wide.com/new/7"]
    df = spark.createDataFrame(list(enumerate(open_ + urls)), "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["template"]) for r in url_filters(df, rules).where("page_id < 5").collect()}
    assert [got[k][0] for k in range(5)] == ["block", "allow", "block", "allow", "allow"]
    assert got[0][1] == "/*/*/*/*/spam" and got[2][1] == "/bad"


def brute_components(rows, size, percent):
    sets = []
    for i, t in rows:
        w = split(t)
        sets.append((i, frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            common = len(s & t)
            if common and 100 * common >= percent * (len(s) + len(t) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[find(k)] = min(low.get(find(k), i), i)
    return {i: (len(s), low[find(k)]) for k, (i, s) in enumerate(sets)}


def near_copies():
    rnd = random.Random(9)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    rows = []
    for family in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 8, 40, 200]))] + (passage if family % 2 else [])
        for _ in range(8):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((len(rows) * 7 % 97, " ".join(copy)))
    return rows + [(200, None), (201, ""), (202, "  "), (203, "one two"), (204, "one  TWO"), (205, "two one")]


@pytest.mark.parametrize("size, percent, blocks", [(4, 85, (64, 2048, 16)), (5, 80, (1, 3, 2))])
def test_jaccard_join(spark, monkeypatch, size, percent, blocks):
    for name, value in zip(("SMALL", "PART", "LEAF"), blocks):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df, size, percent).collect()}
    assert got == brute_components(rows, size, percent)


def test_jaccard_join_awkward_rows(spark, awkward):
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard_join.jaccard_components(awkward, 4, 85).collect())
    assert got == [(0, 1, 0), (1, 0, 1), (2, 0, 2), (2, 0, 2), (4, 1, 4), (5, 1, 5), (6, 2, 6), (7, 2, 6), (8, 1, 8)]
    assert jaccard_join.jaccard_components(awkward.limit(0), 4, 85).count() == 0


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)]
    parent = list(range(60))
    for _ in range(60):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(k, k) == parent[k] for k in range(60))
