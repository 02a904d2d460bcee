"""Global ranks by ranges against sorting."""

from pyspark.sql import functions as F

from lumenfold.operators.ranks import numbered
from lumenfold.plans import cases


def test_ranks_of_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 101).alias("score"), F.col("id").cast("string").alias("name")).repartition(5)
    ranked, n = numbered(rows, F.col("score").desc(), "name", ranges=7)
    assert n == 5000 and ranked.columns == ["score", "name", "rank"]
    want = sorted(map(tuple, rows.collect()), key=lambda r: (-r[0], r[1]))
    assert [(r["score"], r["name"]) for r in sorted(ranked.collect(), key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 5001))


def test_equal_keys_and_no_rows(spark):
    same = spark.range(300).select(F.lit(1).alias("score"), F.lit("a").alias("name"))
    ranked, n = numbered(same, "score", "name")
    assert n == 300 and sorted(r["rank"] for r in ranked.collect()) == list(range(1, 301))
    ranked, n = numbered(same.where("false"), "score")
    assert n == 0 and ranked.count() == 0


def test_difficulty_of_ten_million_rows(spark):
    """No single-partition window, and the shares are exact."""
    scored = spark.range(10_000_000).select((F.hash("id") % 1000).cast("double").alias("score"), F.col("id").alias("case_id"))
    found = cases.difficulty(scored)
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {r.difficulty: r for r in found.groupBy("difficulty").agg(F.count("*").alias("n"), F.min("score").alias("a"), F.max("score").alias("b")).collect()}
    assert {k: r.n for k, r in rows.items()} == {"easy": 3_000_000, "medium": 4_000_000, "hard": 3_000_000}
    assert rows["easy"].b <= rows["medium"].a and rows["medium"].b <= rows["hard"].a
