from pyspark.sql import functions as F

from mediacat.llm.quality_rules import keeps, quality_rules
from mediacat.llm.queries import OP10_SQL, op10_quality_rules
from oracle import spark_rows, sql_rows


def test_against_sql(spark):
    assert spark_rows(op10_quality_rules(spark, "/root/testdata/sf0.001")) == sql_rows(OP10_SQL, "sf0.001")


def test_edge_cases(spark):
    prose = " ".join(f"the of word{i}" for i in range(60))
    rows = [(1, None, "x"), (2, "", "x"), (3, prose, None), (3, prose, None), (None, "a b", "x"), (4, "spam now " * 20000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = {(r.doc_id, r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules(df).collect()}
    assert got == {(1, 0, 0, True, False), (2, 0, 0, True, False), (3, 180, 0, False, True), (None, 2, 0, True, False), (4, 40000, 40000, True, False)}
    assert quality_rules(df.limit(0)).count() == 0
    assert df.where(keeps(F.col("text"))).collect() == [(3, prose, None), (3, prose, None)]


def test_measures_are_one_projection(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = quality_rules(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split") == 2  # words and lines, each bound once
