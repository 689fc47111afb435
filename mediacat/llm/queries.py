"""The registered queries opN_<name>, thin digests of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown_lm
from .decontamination import decontamination
from .html_extraction import extract
from .importance_resampling import importance_resampling
from .jaccard_join import jaccard_components
from .langid import language_id, sample_texts
from .packing import best_fit_packing
from .quality_classifier import fit, quality_scores
from .quality_rules import RULES, STOP_WORDS, quality_rules
from .secret_scan import KINDS, listed, secret_scan
from .shared import bounded_session, crc_fold
from .token_alignment import token_alignment
from .token_counts import token_counts
from .url_filters import FANOUT, PRIOR, PURITY, Z, Z_MANY, url_filters
from .url_filters import RULES as URL_RULES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), limit=1024)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), shingle=5, least=0.8)
    similarity = F.coalesce(F.array_max(F.transform("matches", lambda m: m["similarity"])), F.lit(0.0))
    return found.select("doc_id", "contaminated", F.array_distinct("matches.item_id").alias("item_ids"), similarity.alias("similarity"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 4) == 2
    samples = sample_texts(docs.where(~held_out), "doc_id", "text", "lang")
    return language_id(docs, samples).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1)


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 5) == 1
    scores = brown_lm.fitted_scores(brown_lm.fit(docs, ~held_out))
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = crc_fold(F.col("doc_id"), 4) == 2
    model = fit(docs, labels.where(~held_out))
    return quality_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), size=4, percent=85)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(_table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["path"] == "")
    of = lambda kind: lambda x: x["kind"] == kind
    counts = [F.size(F.filter(base, of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), "unopened")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resampling(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=25, least_words=20, buckets=10_000, most_words=2, seed=7)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def _rules_sql() -> str:
    bad = []
    for _, value, least, most in RULES:
        bad += [f"{value} < {least}"] if least is not None else []
        bad += [f"{value} > {most}"] if most is not None else []
    return " OR ".join(bad)


OP10_SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, {{'a': w[i], 'b': w[i + 1], 'c': w[i + 2]}} AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({', '.join(f"'{s}'" for s in STOP_WORDS)})))::BIGINT AS n_stop_words
  FROM t LEFT JOIN cov ON cov.doc_id = t.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR {_rules_sql()}) AS kept
FROM b
"""


def _fits_sql() -> tuple[str, str]:
    rule = verdict = "CASE"
    for kind, text in sorted(URL_RULES, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = text.partition("/")
        fits = f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}')"
        rule, verdict = f"{rule} {fits} THEN '{text}'", f"{verdict} {fits} THEN '{kind}'"
    return f"{rule} END", f"{verdict} END"


OP8_SQL = f"""
WITH RECURSIVE a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS u FROM pages),
p AS (SELECT page_id, translate(regexp_extract(u, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
j AS (SELECT page_id, host, path, {_fits_sql()[0]} AS rule, {_fits_sql()[1]} AS ruled,
             list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '#' ELSE x END) AS segs FROM p),
t0 AS (SELECT host, segs, count(ruled) AS l, sum(CASE WHEN ruled = 'block' THEN 1 ELSE 0 END) AS b FROM j GROUP BY host, segs),
pi AS (SELECT (coalesce(sum(b), 0) + 1.0)::DOUBLE / (coalesce(sum(l), 0) + 2) AS v FROM t0),
w AS (
  SELECT host, segs, l, b, '' AS node, 0 AS k, true AS goes, (sum(b) OVER (PARTITION BY host) + {PRIOR}::DOUBLE * pi.v) / (sum(l) OVER (PARTITION BY host) + {PRIOR}::DOUBLE) AS purity FROM t0, pi
  UNION ALL
  SELECT host, segs, l, b, branch AS node, k + 1 AS k, bb > 0 AND bb < bl AND len(segs) > k + 1 AS goes, (bb + {PRIOR}::DOUBLE * purity) / (bl + {PRIOR}::DOUBLE) AS purity
  FROM (SELECT *, sum(l) OVER (PARTITION BY host, branch) AS bl, sum(b) OVER (PARTITION BY host, branch) AS bb
    FROM (SELECT *, node || '/' || CASE WHEN abs(cb - cl * p) > z * sqrt(cl * p * (1.0::DOUBLE - p)) + 0.5 THEN s ELSE '*' END AS branch
      FROM (SELECT *, CASE WHEN nl > 0 THEN nb::DOUBLE / nl ELSE 0.0::DOUBLE END AS p, CASE WHEN max(r) OVER (PARTITION BY host, node) > {FANOUT} THEN {Z_MANY}::DOUBLE ELSE {Z}::DOUBLE END AS z
        FROM (SELECT *, sum(l) OVER (PARTITION BY host, node) AS nl, sum(b) OVER (PARTITION BY host, node) AS nb, sum(l) OVER (PARTITION BY host, node, s) AS cl,
                     sum(b) OVER (PARTITION BY host, node, s) AS cb, dense_rank() OVER (PARTITION BY host, node ORDER BY s) AS r
          FROM (SELECT *, coalesce(segs[k + 1], '') AS s FROM w WHERE goes)))))
),
tree AS (SELECT host, segs, arg_max(purity, k) AS purity FROM w GROUP BY host, segs)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.ruled, CASE WHEN tree.purity >= {PURITY} THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN tree ON tree.host = j.host AND tree.segs = j.segs
"""

#: CRC-32 byte by byte over the distinct features, with its table of 256 registers made by eight halvings.
OP13_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM tab WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM tab WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
names AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS k FROM names, crcs),
s AS (SELECT k, count(*) AS n FROM df JOIN hashed USING (f) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM bf JOIN hashed USING (f) GROUP BY k),
gains AS (
  SELECT k, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (SELECT coalesce(sum(n), 0) + 10000 FROM s)::DOUBLE) / ((coalesce(s.n, 0) + 1)::DOUBLE * (SELECT coalesce(sum(n), 0) + 10000 FROM t)::DOUBLE)))::BIGINT AS g
  FROM s FULL JOIN t USING (k)),
weights AS (SELECT r, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight, count(*) AS n_features FROM df JOIN hashed USING (f) JOIN gains USING (k) GROUP BY r),
scored AS (
  SELECT d.r, doc_id, d.n, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM d LEFT JOIN weights USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS p, count(*) OVER () AS able FROM scored WHERE n >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN p <= 25 * able // 100 THEN p END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (r)
"""

OP9_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'),
    lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 3) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM t WHERE len(w) >= 4)
  UNION ALL SELECT doc_id, w AS g FROM t WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c.c >= 85 * (p.n + q.n - c.c)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT t.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(t.doc_id, coalesce(min(reach.b), t.doc_id))::BIGINT AS component_id
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN reach ON reach.a = t.doc_id GROUP BY t.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_html_extraction, op2_token_counts, op3_decontamination, op4_language_id, op5_best_fit_packing, op6_brown_lm, op7_quality_classifier, op8_url_filters, op9_ngram_jaccard_join, op10_quality_rules,
             op11_secret_scan, op12_token_alignment, op13_importance_resampling]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filters": OP8_SQL, "op9_ngram_jaccard_join": OP9_SQL, "op10_quality_rules": OP10_SQL, "op13_importance_resampling": OP13_SQL}
