"""Poisson replication against SQL, its distribution and odd rows."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from jobtrail.llm import mixing, queries
from tests.llm.odd import SMALL, empty_frame, odd_frame


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op3_mixing"])
    names = [c[0] for c in want.description]
    got = queries.op3_mixing(spark, SMALL).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_copies_follow_the_poisson_distribution(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"),
                                      F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    out = mixing.poisson_mix(docs, weights, epochs=1.0)
    per_doc = docs.join(out.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").na.fill(0)
    for source, rate, total in (("a", 3.0, 10_000), ("b", 1 / 3, 30_000)):
        seen = {r["n"]: r["count"] for r in per_doc.where(F.col("source") == source).groupBy("n").count().collect()}
        for k in range(6):
            p = math.exp(-rate) * rate ** k / math.factorial(k)
            assert abs(seen.get(k, 0) / total - p) < 5 * math.sqrt(p / total)


def test_high_rates_are_sums_of_pieces(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("s").alias("source"))
    counts = [r["n"] for r in mixing.poisson_mix(docs, epochs=100.0).groupBy("doc_id").agg(F.count("*").alias("n")).collect()]
    assert abs(sum(counts) / 400 - 100) < 2.5
    variance = sum((c - 100) ** 2 for c in counts) / 400
    assert 70 < variance < 140


def test_shuffle_is_global_and_repeatable(spark):
    docs = queries.table(spark, SMALL, "documents")
    rows = [r["mix_order"] for r in mixing.poisson_mix(docs).collect()]
    again = [r["mix_order"] for r in mixing.poisson_mix(docs.repartition(7)).collect()]
    assert sorted(rows) == sorted(again)
    parts = mixing.poisson_mix(docs).select(F.spark_partition_id().alias("p"), "mix_order").collect()
    for p in {r["p"] for r in parts}:
        mine = [r["mix_order"] for r in parts if r["p"] == p]
        assert mine == sorted(mine)


def test_odd_rows(spark):
    df = odd_frame(spark).withColumn("mix_copy", F.lit("clash"))
    out = mixing.poisson_mix(df, epochs=3.0)
    assert out.columns == [c for c in df.columns if c != "mix_copy"] + ["mix_copy", "mix_order"]
    rows = out.collect()
    assert len(rows) > len(df.columns)
    assert {r.source for r in rows} <= {None, "s"}
    assert mixing.poisson_mix(empty_frame(spark)).count() == 0


def test_unlisted_sources_are_left_out(spark):
    weights = spark.createDataFrame([("s", 1.0)], "source string, weight double")
    out = mixing.poisson_mix(odd_frame(spark), weights, epochs=2.0)
    assert {r.source for r in out.collect()} == {"s"}


@pytest.mark.parametrize("limit", [0, 10_000])
def test_many_sources_are_joined_by_shuffling(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "SENT_SOURCES", limit)
    rows = sorted(str(tuple(r)) for r in mixing.poisson_mix(odd_frame(spark), epochs=3.0).collect())
    monkeypatch.setattr(mixing, "SENT_SOURCES", 10_000)
    assert rows == sorted(str(tuple(r)) for r in mixing.poisson_mix(odd_frame(spark), epochs=3.0).collect())


def test_main_path_is_native(spark):
    plan = queries.op3_mixing(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("few", [True, False])
def test_columns_with_internal_names_and_a_hot_source(spark, few, monkeypatch):
    """Columns named like everything the operator adds on its way come out as they went in; so does a source of most rows."""
    monkeypatch.setattr(mixing, "SENT_SOURCES", 10_000 if few else 0)
    names = ["_source", "_pieces", "_cumulative", "_copies", "_identity", "_mix0", "_mix0s0", "_r_source", "_zero", "rate", "bytes"]
    plain = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"),
                                    F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 9)).alias("source"))
    named = plain.select("*", *[F.concat(F.lit(n), "doc_id").alias(n) for n in names])
    want = sorted(map(tuple, mixing.poisson_mix(plain).collect()), key=str)
    got = mixing.poisson_mix(named)
    assert sorted(map(tuple, got.select("doc_id", "text", "source", "mix_copy", "mix_order").collect()), key=str) == want
    assert got.where(" OR ".join(f"{n} <> concat('{n}', doc_id)" for n in names)).count() == 0
