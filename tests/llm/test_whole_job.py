"""Results that must not depend on the size of the input."""

import collections
import random

import pytest

from mediacat.llm import decontamination, html_extraction, langid


@pytest.mark.parametrize("shared_block", [1 << 20, 3])
def test_decontamination_does_not_depend_on_blocks(spark, shared_block):
    rnd = random.Random(2)
    word = lambda: f"w{rnd.randrange(5000)}"
    common = [[word() for _ in range(9)] for _ in range(3)]
    items = [(k, " ".join([*common[k % 3], *(word() for _ in range(8)), *common[(k + 1) % 3][: k % 9]])) for k in range(24)]
    docs = []
    for k, (_, text) in enumerate(items * 3):
        w = text.split()
        for _ in range(k % 4):
            w[rnd.choice([0, 1, 2, len(w) - 1])] = word()
        docs.append((k, " ".join([word(), word(), *w, *common[k % 3], word()])))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda block: {
        r["doc_id"]: [(m["item_id"], m["start"], m["end"], round(m["similarity"], 9)) for m in r["matches"]]
        for r in decontamination.decontamination(frame, bench, item_block=block, shared_block=shared_block).collect()
    }
    whole = rows(100)
    assert rows(5) == whole and len(whole) == len(docs)
    assert {len(m) > 0 for m in whole.values()} == {True, False}

def test_extraction_does_not_depend_on_the_size_of_a_page():
    run = "".join(f"<li>five short words number {k} here</li>" for k in range(5))
    long = "<li>" + "word " * 40 + "end.</li>"
    part = "<ul>" + 2 * long + run + 2 * long + "</ul>"
    alone = html_extraction.main_text(f"<body>{part}</body>").split("\n\n")
    assert len(alone) == 9  # the run of short items stays
    many = html_extraction.main_text("<body>" + part * 400 + "</body>").split("\n\n")
    assert collections.Counter(many) == {t: n * 400 for t, n in collections.Counter(alone).items()}


def test_every_letter_of_the_samples_counts(spark):
    rnd = random.Random(4)
    hangul, han = [chr(0xAC00 + k) for k in range(600)], [chr(0x4E00 + k) for k in range(600)]
    samples = {"aa": ["".join(rnd.choice(hangul) for _ in range(3000))], "zz": ["".join(rnd.choice(han) for _ in range(3000))]}
    parser = langid.CrossParser({x: t[0] for x, t in samples.items()})
    for reference, row in zip((samples["aa"][0], samples["zz"][0]), parser.phrases([samples["zz"][0][50:90] + hangul[3] * 2])[0]):
        text, n, at = samples["zz"][0][50:90] + hangul[3] * 2, 0, 0
        while at < len(text):
            k = 1
            while at + k < len(text) and text[at : at + k + 1] in reference:
                k += 1
            at, n = at + k, n + 1
        assert row.tolist() == [n]
    rare = [(1, hangul[1] + hangul[500] + hangul[7] + hangul[599]), (2, han[1] + han[500] + han[7] + han[599])] + [(10 + k, c) for k, c in enumerate(han)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.language_id(spark.createDataFrame(rare, "doc_id long, text string"), samples).collect()}
    seen = set(samples["zz"][0])
    assert got[1] == "aa" and got[2] == "zz" and len(seen) > 500


def test_a_long_text_is_not_the_whole_sample():
    out = langid.even_share(["a" * 5000, "bc", "d" * 900, "e" * 70], 1000)
    assert len(out) <= 1000 and "bc" in out.split("\n") and "e" * 70 in out.split("\n") and out.count("d") > 400 and out.count("a") > 400
    assert langid.even_share(["ab", "c"], 40) == "ab\nc"


def test_repetitive_texts_take_time_in_proportion():
    import time

    import numpy as np

    rnd = random.Random(6)
    words = ["the", "word", "und", "is", "abba", "日本"]
    parser = langid.CrossParser({x: " ".join(rnd.choice(words[k : k + 4]) for _ in range(4000)) for k, x in enumerate(("aa", "bb", "cc"))})
    texts = ["word " * 3000, "ab" * 4000, "ab" * 1000 + "the word of " * 700, "xyz" * 2500, " ".join(rnd.choice(words) for _ in range(3000))]
    found = parser.phrases(texts)[0]
    one = lambda state, c: int(parser.step(np.array([state], np.int32), np.array([c], np.int32))[0])
    for k, text in enumerate(texts):
        for row, root in zip(found, parser.roots.tolist()):
            state, n = root, 0
            for c in parser.symbols(text).tolist():
                to = one(state, c)
                if not to or state == root:
                    to, n = one(root, c) or root, n + 1
                state = to
            assert row[k] == n
    began = time.time()
    parser.judge(["word " * 200_000, "ab" * 500_000])
    assert time.time() - began < 6


PARAGRAPH = "<p>" + "The committee met on Monday to weigh the plan, and it heard from many people. " * 3 + "</p>"


@pytest.mark.parametrize("names", ['class="post has-comments"', 'class="page comments open"', 'id="search-results"', 'class="modal"', 'class="widget-area"'])
def test_an_element_with_all_of_the_text_is_the_article_whatever_its_name(names):
    assert html_extraction.main_text(f"<div {names}><h1>A title</h1>{PARAGRAPH * 2}</div>").count("committee") == 6


@pytest.mark.parametrize("opening", ['section id="legal-basis"', 'section id="search-engines"', 'div class="story-menu-planning"', 'div class="reply-of-the-minister"', 'section class="cookies-in-the-kitchen"'])
def test_a_word_of_furniture_in_a_name_hides_no_part_of_an_article(opening):
    tag = opening.split()[0]
    page = f"<body><article><h1>A title</h1>{PARAGRAPH}<{opening}>{PARAGRAPH}</{tag}><div class='share-buttons'><a href=x>Share</a> <a href=y>Tweet</a></div><div class='related-posts'><p>{'Another story that you might like to read now. ' * 3}</p></div></article></body>"
    text = html_extraction.main_text(page)
    assert text.count("committee") == 6 and "Tweet" not in text and "Another story" not in text
