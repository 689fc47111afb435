"""Quality rules: a table of thresholds compiled into one projection of built-in functions only.

``measures`` is a single expression over the text column: each intermediate array (words, windows, ranks) is bound once by a
``transform`` over a one-element array, so nothing is computed twice and no projection is stacked on another.  Thresholds are
compared with counts and ratios of lengths, symbols, stop words and lines.

Null and empty texts have no words and fail ``base``; repeated rows are judged one by one, so there are no ties; other columns
of the input are not read and can not clash; an empty table gives no rows.  Very long texts cost about n log n in their words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"

#: Short words that ordinary prose of the corpus languages holds.
STOP_WORDS = ["the", "of", "and", "to", "in", "that", "is", "der", "die", "und", "das", "ein", "ist", "mit",
              "de", "la", "le", "et", "les", "des", "un", "une", "que", "el", "los", "en", "y", "para", "con"]
LONGEST = max(map(len, STOP_WORDS))  # longer words are not looked at

#: name, SQL expression over the measures, least, most (None: open).  A text outside any row's bounds is rejected.
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("n_words", "n_words", 50, None),
    ("repeat_ratio", "n_repeat_words / greatest(n_words, 1)", None, 0.5),
    ("mean_word", "word_chars / greatest(n_words, 1)", 2, 12),
    ("symbol_ratio", "n_symbols / greatest(n_words, 1)", None, 0.3),
    ("stop_ratio", "n_stop_words / greatest(n_words, 1)", 0.02, None),
    ("dup_line_ratio", "n_dup_lines / greatest(n_lines, 1)", None, 0.5),
]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words"]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words in windows of three that occur twice or more."""

    def of_windows(h: Column) -> Column:
        # (window, place) in order: equal windows stand side by side
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), bound(ranked, of_ranks)).otherwise(F.lit(0))

    def of_ranks(rank: Column) -> Column:
        twice = lambda x, j: ((j > 0) & (F.get(rank, j - 1)["h"] == x["h"])) | F.coalesce(F.get(rank, j + 1)["h"] == x["h"], F.lit(False))
        return bound(F.array_sort(F.transform(F.filter(rank, twice), lambda x: x["i"])), of_places)

    def of_places(places: Column) -> Column:
        # a window covers three words, or fewer if the next one begins before its end
        own = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))))
        return F.aggregate(own, F.lit(0), lambda a, x: a + x)

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 3, bound(windows, of_windows)).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """The struct of ``COUNTS`` of a whole text."""

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).alias("n_words"), F.size(F.filter(words, lambda w: (F.octet_length(w) <= LONGEST) & F.lower(w).isin(STOP_WORDS))).alias("n_stop_words"), _repeated(words).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

    def of_text(t: Column) -> Column:
        solid = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0)
        return F.struct(
            bound(F.array_remove(F.split(t, SPACE), ""), of_words).alias("w"),
            bound(solid, of_lines).alias("l"),
            F.length(F.translate(t, BLANKS, "")).alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
        )

    def named(m: Column) -> Column:
        at = {"n_words": m["w"], "n_stop_words": m["w"], "n_repeat_words": m["w"], "n_lines": m["l"], "n_dup_lines": m["l"]}
        return F.struct(*[at.get(c, m)[c].cast("long").alias(c) for c in COUNTS])

    return bound(bound(F.coalesce(text, F.lit("")), of_text), named)


def broken(m: Column, rules: list[tuple[str, str, float | None, float | None]] = RULES) -> dict[str, Column]:
    """``base_failed`` and one boolean ``fails_<rule>`` a rule over a struct of measures, compiled from the table."""

    def value(expression: str) -> Column:
        part, _, by = expression.partition(" / greatest(")
        return m[part] if not by else m[part] / F.greatest(m[by.split(",")[0]], F.lit(1))

    out = {"base_failed": (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])}
    for name, expression, least, most in rules:
        x = value(expression)
        out[f"fails_{name}"] = (F.lit(False) if least is None else x < least) | (F.lit(False) if most is None else x > most)
    return out


def _any(tests: dict[str, Column]) -> Column:
    out = F.lit(False)
    for x in tests.values():
        out = out | x
    return out


def keeps(text: Column, rules: list[tuple[str, str, float | None, float | None]] = RULES) -> Column:
    """Whether the rules keep a text: a filter's condition, evaluated once a row."""
    return bound(measures(text), lambda m: ~_any(broken(m, rules)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row a document: its measures, base_failed, the broken rules and kept."""

    def judged(m: Column) -> Column:
        tests = broken(m, rules)
        return F.struct(*[m[c].alias(c) for c in COUNTS], *[x.alias(c) for c, x in tests.items()], (~_any(tests)).alias("kept"))

    return docs.select(F.col(id_col).alias("doc_id"), bound(measures(F.col(text_col)), judged).alias("m")).select("doc_id", "m.*")
