"""Full-text search over pages: a stored inverted index, phrase match, BM25, best page and snippet as DataFrames.

The index is three tables of the catalogue: postings, clustered by token, pages with their length and a hash of their text, and one row
of totals.  ``index_changes`` compares the hashes with the texts, and ``updated_index`` tokenises the pages that changed, no other.  A search
reads the postings of its own tokens and the totals.  ``match`` works on the texts themselves, for tables without an index."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import fts_query, tokens, tokens_py

K1, B = 1.2, 0.75
SNIPPET_TOKENS = 12
#: Tokens that a task brings into order at a time, or one page.
RUN_TOKENS = 1 << 20


@dataclass(frozen=True)
class Index:
    """postings: token, file_id, page, tf, len (tokens of the page), positions; totals: one row, n (pages) and avg (of len)."""

    postings: DataFrame
    totals: DataFrame


def tokenised(texts: DataFrame) -> DataFrame:
    """texts: file_id, page, content.  Adds tokens."""
    return texts.select("file_id", "page", "content", tokens(F.col("content")).alias("tokens"))


def page_count(texts: DataFrame) -> tuple[int, bool]:
    """(rows of ``texts``, whether each has a file and page of its own)."""
    row = texts.groupBy("file_id", "page").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return row[0], row[1] <= 1


def _page_runs(batches):
    """Each page's tokens as runs of equal ones with their positions."""
    for batch in batches:
        sizes = pa.compute.list_value_length(batch["tokens"]).to_numpy()
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN_TOKENS, "right")))
            part, n = batch.slice(at, to - at), sizes[at:to].astype(np.int64)
            at = to
            words = part["tokens"].flatten().dictionary_encode()
            if not len(words):
                continue
            row = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            key = row * len(words.dictionary) + words.indices.to_numpy()
            order = np.argsort(key, kind="stable")  # positions of a token stay in order
            begins = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
            first = order[begins]
            of = pa.array(row[first])
            cuts = np.r_[begins, len(order)].astype(np.int32)
            found = [words.dictionary.take(words.indices.take(pa.array(first))), part["file_id"].take(of), part["page"].take(of), part["len"].take(of)]
            yield pa.RecordBatch.from_arrays([*found, pa.array(np.diff(cuts)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(pos[order].astype(np.int32)))], ["token", "file_id", "page", "len", "tf", "positions"])


def postings(texts: DataFrame, distinct: bool | None = None) -> DataFrame:
    """token, file_id, page, tf, len, positions: a row for each token of each page.

    A page's tokens are in one row, so its task counts them and nothing is shuffled; only where rows share a file and page (``distinct`` says
    that none do, if it is known) their tokens are brought together."""
    rows = tokenised(texts).select("file_id", "page", F.size("tokens").alias("len"), "tokens")
    if page_count(texts)[1] if distinct is None else distinct:
        kind = lambda c: rows.schema[c].dataType.simpleString()
        found = rows.mapInArrow(_page_runs, f"token string, file_id {kind('file_id')}, page {kind('page')}, len int, tf int, positions array<int>")
        return found.select("token", "file_id", "page", "len", "tf", "positions")
    each = rows.select("file_id", "page", "len", F.posexplode("tokens").alias("pos", "token"))
    return each.groupBy("token", "file_id", "page", "len").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def totals(texts: DataFrame) -> DataFrame:
    return tokenised(texts).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("avg"))


def index_changes(texts: DataFrame, pages: DataFrame) -> DataFrame:
    """file_id, page, fresh (there is a text to index), stale (there are postings to drop) of each page whose text is not the indexed one."""
    now = texts.select("file_id", "page", F.xxhash64("content").alias("now"), F.lit(True).alias("_now"))
    old = pages.select("file_id", "page", F.col("sign").alias("old"), F.lit(True).alias("_old"))
    both = now.join(old, ["file_id", "page"], "full").where(F.col("_now").isNull() | F.col("_old").isNull() | ~F.col("now").eqNullSafe(F.col("old")))
    return both.select("file_id", "page", F.col("_now").isNotNull().alias("fresh"), F.col("_old").isNotNull().alias("stale"))


def updated_index(texts: DataFrame, old_postings: DataFrame, old_pages: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, pages) after ``changes``: those of stale pages go, those of fresh ones come."""
    key = ["file_id", "page"]
    stale, fresh = changes.where("stale").select(key), texts.join(changes.where("fresh").select(key), key, "left_semi").select("file_id", "page", "content")
    return old_postings.join(stale, key, "left_anti").unionByName(postings(fresh)), old_pages.join(stale, key, "left_anti").unionByName(page_signs(fresh))


def page_signs(texts: DataFrame) -> DataFrame:
    """file_id, page, len (tokens), sign (hash of the text)."""
    return tokenised(texts).select("file_id", "page", F.size("tokens").alias("len"), F.xxhash64("content").alias("sign"))


def page_totals(pages: DataFrame) -> DataFrame:
    """One row: n (pages) and avg (tokens of a page)."""
    return pages.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg"))


def phrase_count(column: Column, phrase: list[str]) -> Column:
    """How often a phrase occurs in an array of tokens; one pass, no explode."""
    if len(phrase) == 1:
        return F.size(F.filter(column, lambda t: t == phrase[0]))
    wanted = F.array(*[F.lit(p) for p in phrase])
    return F.size(F.filter(column, lambda t, i: (t == phrase[0]) & (F.slice(column, i + 1, len(phrase)) == wanted)))


def _phrase_positions(at: dict[str, Column], phrase: list[str]) -> Column:
    """Occurrences of a phrase by the positions of its tokens in a page."""
    if len(phrase) == 1:
        return F.size(at[phrase[0]])
    follows = lambda p: [F.array_contains(at[t], p + k) for k, t in enumerate(phrase) if k]

    def whole(p: Column) -> Column:
        out = F.lit(True)
        for x in follows(p):
            out = out & x
        return out

    return F.size(F.filter(at[phrase[0]], whole))


def _scored(counted: DataFrame, phrases: list[list[str]], stats: DataFrame) -> DataFrame:
    """counted: len, tf0, tf1, ...; stats: one row with n, avg, df0, df1, ...  Rows with every phrase, with their BM25 score."""
    score, hit = F.lit(0.0), F.lit(True)
    for k in range(len(phrases)):
        tf, df = F.col(f"tf{k}").cast("double"), F.col(f"df{k}").cast("double")
        idf = F.greatest(F.ln((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.greatest("avg", F.lit(1e-9))))
        hit = hit & (tf > 0)
    return counted.join(F.broadcast(stats)).where(hit).withColumn("score", score)  # stats is one row


def match(texts: DataFrame, query: str) -> DataFrame:
    """file_id, page, content, score of the rows of ``texts`` in which every phrase of the query occurs (BM25; statistics over all rows)."""
    phrases = fts_query(query)
    rows = tokenised(texts)
    if not phrases:
        return rows.where(F.lit(False)).select("file_id", "page", "content", F.lit(0.0).alias("score"))
    counted = rows.select("file_id", "page", "content", F.size("tokens").alias("len"), *[phrase_count(F.col("tokens"), p).alias(f"tf{k}") for k, p in enumerate(phrases)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(phrases))])
    return _scored(counted, phrases, stats).select("file_id", "page", "content", "score")


def match_index(index: Index, query: str) -> DataFrame:
    """file_id, page, score like ``match``, from the postings of the query's tokens alone."""
    phrases = fts_query(query)
    wanted = sorted({t for p in phrases for t in p})
    mine = index.postings.where(F.col("token").isin(wanted)) if wanted else index.postings.where(F.lit(False))
    if not phrases:
        return mine.select("file_id", "page", F.lit(0.0).alias("score"))
    if phrases == [wanted] and len(wanted) == 1:  # one token: its postings are the counts
        counted = mine.select("file_id", "page", "len", F.col("tf").alias("tf0"))
    else:
        empty = F.array().cast("array<int>")
        at = {t: F.coalesce(F.first(F.when(F.col("token") == t, F.col("positions")), True), empty) for t in wanted}
        pages = mine.groupBy("file_id", "page").agg(F.first("len").alias("len"), *[x.alias(f"at{k}") for k, x in enumerate(at.values())])
        held = {t: F.col(f"at{k}") for k, t in enumerate(at)}
        counted = pages.select("file_id", "page", "len", *[_phrase_positions(held, p).alias(f"tf{k}") for k, p in enumerate(phrases)])
    found = counted.agg(*[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(phrases))])
    return _scored(counted, phrases, index.totals.join(F.broadcast(found))).select("file_id", "page", "score")


def best_page(matched: DataFrame) -> DataFrame:
    """file_id, score, page of each file's best row; the first page wins ties."""
    best = F.max_by(F.struct("score", "page"), F.struct("score", -F.col("page")))
    return matched.groupBy("file_id").agg(best.alias("b")).select("file_id", "b.score", "b.page")


#: Letters, digits, private-use characters, and the marks on them.
_WORD = re.compile("(?:[^\\W_]|[\ue000-\uf8ff])(?:[^\\W_]|[\ue000-\uf8ff\u0300-\u036f])*")


def _token_spans(text: str) -> list[tuple[str, int, int]]:
    """(folded token, begin, end) of each token of a text."""
    out = []
    for m in _WORD.finditer(text):
        folded = tokens_py(m[0])
        if folded:
            out.append((folded[0], m.start(), m.end()))
    return out


def snippet_text(text: str | None, phrases: list[list[str]], width: int = SNIPPET_TOKENS) -> str:
    """The ``width`` tokens of a text that hold the most phrases, each run of phrase words in brackets, ellipses where text is left out.

    A window counts 1000 for each phrase it holds and 1 for each repetition; among windows around an occurrence one that begins a
    sentence counts 100 more, 120 at the text's beginning.  The first best window is shown."""
    text = text or ""
    spans = _token_spans(text)
    words = [w for w, _, _ in spans]
    hits = sorted((i, k) for k, p in enumerate(phrases) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p)
    starts = [0] + [i for i in range(1, len(spans)) if re.search(r"[.:]\s", text[spans[i - 1][2] : spans[i][1] + 1])]

    def score(begin: int) -> tuple[int, int]:
        """(score, the begin that centres what the window holds)."""
        seen, total, first, last = set(), 0, -1, 0
        for i, k in hits:
            if begin <= i < begin + width:
                total += 1 if k in seen else 1000
                seen.add(k)
                first = i if first < 0 else first
                last = i + len(phrases[k])
        centred = first - int((width - (last - first)) / 2)
        return total, max(0, min(centred, len(words) - width))

    best, begin = 0, 0
    for i, _ in hits:
        own, centred = score(i)
        if own > best:
            best, begin = own, centred
        sentence = max((s for s in starts if s <= i), default=0)
        if len(words) > width and sentence < i:
            own = score(sentence)[0] + (120 if sentence == 0 else 100)
            if own > best:
                best, begin = own, sentence
    end = min(begin + width, len(words))
    if not words:
        return text
    runs: list[list[int]] = []  # occurrences that overlap stand in one pair of brackets
    for a, b in sorted((i, min(i + len(phrases[k]), end)) for i, k in hits if begin <= i < end):
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    low = 0 if begin == 0 else spans[begin][1]
    high = len(text) if end == len(words) else spans[end - 1][2]
    out, at = ["" if begin == 0 else "…"], low
    for a, b in runs:
        out += [text[at : spans[a][1]], "[", text[spans[a][1] : spans[b - 1][2]], "]"]
        at = spans[b - 1][2]
    return "".join([*out, text[at:high], "" if end == len(words) else "…"])


def snippet(content: Column, query: str) -> Column:
    """The snippet of a page for a query; meant for the rows of one page of results."""
    phrases = fts_query(query)

    @F.pandas_udf(StringType())
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet_text(t, phrases))

    return cut(content)


def token_frequencies(texts: DataFrame) -> DataFrame:
    """token, df (pages that hold it), cf (its occurrences).  Tasks add up their pages' tokens; only where rows share a file and page
    they are brought together first."""
    if page_count(texts)[1]:
        mark = lambda n: lambda t: F.struct(t.alias("token"), F.lit(n).alias("df"), F.lit(1 - n).alias("cf"))
        own = F.concat(F.transform("tokens", mark(0)), F.transform(F.array_distinct("tokens"), mark(1)))
        each = tokenised(texts).select(F.inline(own))
        return each.groupBy("token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    each = tokenised(texts).select("file_id", "page", F.explode("tokens").alias("token")).groupBy("token", "file_id", "page").agg(F.count(F.lit(1)).alias("tf"))
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def place_texts(files: DataFrame) -> DataFrame:
    """Page-0 rows that make place labels searchable."""
    from ..functions.text import place_label

    label = place_label(F.col("city"), F.col("state"), F.col("country"))
    return files.select(F.col("id").alias("file_id"), F.lit(0).alias("page"), label.alias("content")).where("content IS NOT NULL")


def without_stale(texts: DataFrame, files: DataFrame) -> DataFrame:
    """Texts but for those of files that are to be processed again, or have become a kind without text."""
    stale = files.where("status = 'pending' OR kind = 'other'").select(F.col("id").alias("file_id"))
    return texts.join(stale, "file_id", "left_anti")
