"""A corpus pipeline over ``documents``: quality rules, quality classifier, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next one's docs.  All stages but the last return the columns of ``documents``; rows that a stage rejects go.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm import packing, quality_classifier, quality_rules
from mediacat.llm.decontamination import decontamination
from mediacat.llm.jaccard_join import representatives
from mediacat.llm.shared import bounded_session, dropped, shared_dir, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The stages' operators need models and tokenizers that SQL cannot express; a test holds what each stage keeps against brute force.
ORACLE_SQL = None


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality rules keep, by one filter: the rows themselves are not touched.

    Null and empty texts go (they have no words); very long texts are read whole; repeated rows are judged alike, one by one;
    an empty table stays empty; columns other than those of ``documents`` are left out, so none can clash."""
    bounded_session(spark)
    return docs.select(COLUMNS).where(quality_rules.keeps(F.col("text")))


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, fitted on the labels of the documents given, predicts to be good.

    Null and empty texts have the statistics of no words and are judged by them; a document with several labels counts
    with the least; a score equal to the threshold is good; without labels of both kinds all scores are the share of label 1, or
    0.5 without any, so none is kept below the threshold; very long texts are judged whole; repeated rows are judged one by one; an empty table
    stays empty; columns other than those of ``documents`` are left out, so none can clash."""
    bounded_session(spark)  # whoever writes the stage evaluates it
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.quality_scores(docs, model, carry=COLUMNS).where("predicted = 1").select("carried.*")


def by_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, similarity 0.8).

    That is the one with the smallest id, those without an id last, and where ids tie the one with the smallest hash of its text.
    Rows that repeat id and text are one document and one of them stays.  Documents without words, null texts among them, are no
    duplicates of anything; very long texts count whole; an empty table stays empty; other columns are left out, so none can clash."""
    bounded_session(spark)
    kept = representatives(docs, size=5, percent=80)
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("_hash"))
    found = rows.join(kept, rows["doc_id"].eqNullSafe(kept["own"]) & (rows["_hash"] == kept["own_hash"]))
    once, more = found.where("times = 1").select(COLUMNS), found.where("times > 1").select(COLUMNS)
    return once.union(more.dropDuplicates(["doc_id", "text"]))


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of the benchmark.

    Null and empty texts hold none and stay; very long texts are searched whole; repeated rows are judged one by one; a
    similarity equal to the least one counts; an empty table stays empty, and an empty benchmark drops nothing; other columns are left out, so none can clash."""
    bounded_session(spark)  # whoever writes the stage evaluates it
    found = decontamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shingle=5, least=0.8, carry=COLUMNS)
    return found.where("NOT contaminated").select("carried.*")


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents left into sequences of at most 4096 tokens, a row a piece.

    Null and empty texts are a piece of the end id; very long texts are cut into pieces; repeated rows are packed one by one;
    an empty table gives no pieces."""
    import public_tokenizers

    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality_rules", by_rules),
    ("quality_classifier", by_classifier),
    ("near_duplicates", by_near_duplicates),
    ("decontamination", by_benchmark),
    ("packing", into_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    with small_batches(spark):
        for name, stage in STAGES:
            path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs, done = spark.read.parquet(path), before
            before = docs
            if done is not None:
                dropped(done)
    return docs
