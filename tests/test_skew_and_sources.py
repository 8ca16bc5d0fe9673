import json
import os
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators.skew import count_rows, heavy_keys, max_of, min_of, ranked_within, salted_aggregate, skew_join, sum_of
from lodestone.sources import corpus
from lodestone.sources.tables import clean_postings, current_docs, valid_postings


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("hot", i, i) for i in range(60)] + [(f"k{i}", i, 1) for i in range(20)] + [(None, 1, 5)], "k string, id int, n int")


def test_salted_aggregate(rows):
    heavy = heavy_keys(rows, "k", 0.3)
    assert heavy == ["hot"]
    got = {r.k: tuple(r)[1:] for r in salted_aggregate(rows, "k", [count_rows("c"), sum_of("n", "s"), max_of("n", "hi"), min_of("n", "lo")], heavy, ["id"]).collect()}
    want = {r.k: tuple(r)[1:] for r in rows.groupBy("k").agg(F.count("*"), F.sum("n"), F.max("n"), F.min("n")).collect()}
    assert got == want and len(got) == 22
    assert salted_aggregate(rows.limit(0), "k", [count_rows("c")], heavy_keys(rows.limit(0), "k"), ["id"]).count() == 0


def test_a_light_key_is_spread_over_many_tasks(spark):
    """A key of 0.8% of the rows is more than its share of 200 tasks."""
    from lodestone.operators.skew import SALT, with_salt

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(400_000).select(F.when(F.col("id") % 125 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 9000)).alias("k"), "id")
        heavy = heavy_keys(df, "k")
        assert heavy == ["hot"] and heavy.salts["hot"] >= 6
        tasks = with_salt(df, "k", heavy, ["id"]).repartition(200, "k", SALT).groupBy(F.spark_partition_id().alias("p")).count().toPandas()["count"]
        assert len(tasks) >= 190 and tasks.max() <= 3 * tasks.median()
        plain = df.repartition(200, "k").groupBy(F.spark_partition_id().alias("p")).count().toPandas()["count"]
        assert plain.max() > tasks.max()
        totals = salted_aggregate(df, "k", [count_rows("n")], heavy, ["id"])
        assert totals.where("k = 'hot'").first().n == 3200 and totals.count() == 9000 - 72 + 1  # 72 of the 9000 remainders are always hot
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_tables_go_with_clean_and_sweep(spark):
    from lodestone.operators.index import exists
    from lodestone.session import clean, materialize, sweep

    short, long = materialize(spark.range(3), "short"), materialize(spark.range(3), "long", lasting=True)
    clean(spark)
    assert not exists(spark, short.inputFiles()[0]) and long.count() == 3
    assert sweep(spark, 0) >= 0 and long.count() == 3


def _shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {os.path.join(r, f) for d in dirs for r, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    from lodestone.operators.index import exists
    from lodestone.session import discard, materialize

    before = _shuffle_files(spark)
    df = spark.range(5000).groupBy((F.col("id") % 100).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    kept = materialize(df, "counts")
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left and kept.agg(F.sum("n")).first()[0] == 5000
    discard(kept)
    assert not exists(spark, kept.inputFiles()[0])
    assert sorted(map(tuple, df.collect()))[:2] == [(0, 50), (1, 50)]


def test_skew_join(spark, rows):
    right = spark.createDataFrame([("hot", "x"), ("k3", "y"), ("none", "z")], "k string, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(repr, rows.join(right, "k", how).collect()))
        assert sorted(map(repr, skew_join(rows, right, "k", how, ["hot"], ["id"], 4).collect())) == plain


def test_ranked_within(spark):
    df = spark.createDataFrame([("hot", i % 37, i) for i in range(300)] + [("cold", i, i) for i in range(5)], "g string, s int, id int")
    order = [F.col("s").desc()]
    a = sorted(map(tuple, ranked_within(df, ["g"], order, "r", "g", []).collect()))
    assert a == sorted(map(tuple, ranked_within(df, ["g"], order, "r", "g", ["hot"]).collect()))
    order = [F.col("s").desc(), F.col("id")]
    a = sorted(map(tuple, ranked_within(df, ["g"], order, "r", "g", [], True).collect()))
    assert a == sorted(map(tuple, ranked_within(df, ["g"], order, "r", "g", ["hot"], True).collect()))


def test_clean_postings(spark):
    p = spark.createDataFrame([(" Law ", 1, 2, "2024-01-01"), ("law", 1, 5, "2024-01-02"), ("law", 1, 4, "2024-01-02"), ("x", 1, 0, "2024-01-01"), ("x", 1, None, "2024-01-01"), (None, 1, 1, "2024-01-01"),
                               (" ", 1, 1, "2024-01-01"), ("y", None, 1, "2024-01-01"), ("y", 9, 1, "2024-01-01"), ("z", 2, 3, None), ("z", 2, 1, "2024-01-01")], "term string, doc_rowid long, tf long, at string")
    p = p.withColumn("indexed_at", F.to_timestamp("at")).drop("at")
    docs = spark.createDataFrame([(1,), (2,), (2,)], "doc_rowid long")
    assert sorted(map(tuple, clean_postings(p, docs).collect())) == [("law", 1, 5), ("z", 2, 1)]
    assert valid_postings(p.limit(0)).count() == 0


def test_current_docs(spark):
    d = spark.createDataFrame([(1, "old", "2024-01-01"), (1, "new", "2024-02-01"), (1, "new", "2024-02-01"), (2, "a", None), (2, "b", "2023-01-01"), (None, "x", "2024-01-01"), (3, None, "2024-01-01")], "doc_rowid long, raw_text string, at string")
    d = d.withColumn("ingested_at", F.to_timestamp("at"))
    assert sorted(map(tuple, current_docs(d, "raw_text").collect())) == [(1, "new"), (2, "b"), (3, None)]


def test_read_corpus(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"doc_id": "x", "tokens": ["a"], "raw_text": "t"}, {"tokens": None}, {"raw_text": "u", "extra": 1}]))
    got = sorted(map(tuple, corpus.read_corpus(spark, f"file://{tmp_path}/c.json").collect()))
    assert got == [("1", [], ""), ("2", [], "u"), ("x", ["a"], "t")]
    assert corpus.read_corpus(spark, f"file://{tmp_path}/c.json", limit=1).count() == 1
    cat = corpus.Catalogue([corpus.Dataset("c", "C", f"file://{tmp_path}/c.json", "x"), corpus.Dataset("n", "N", f"file://{tmp_path}/no.json", "x")])
    assert {r.key: r.available for r in cat.listing(spark).collect()} == {"c": True, "n": False}
    with pytest.raises(KeyError):
        cat.get("zz")


def test_queries_and_qrels(spark):
    q = spark.createDataFrame([("1", None, " ", "d"), ("2", "t", "x", "d"), ("2", "t", "x", "d"), (None, "t", "x", "d"), ("3", None, None, None)], "query_id string, title string, text string, description string")
    assert sorted(map(tuple, corpus.read_queries(q).collect())) == [("1", "d"), ("2", "t"), ("3", "")]
    r = spark.createDataFrame([("1", "a", 2, "2024-01-01"), ("1", "a", -1, "2024-01-02"), ("1", "b", None, "2024-01-01")], "query_id string, doc_id string, relevance int, at string").withColumn("judged_at", F.to_timestamp("at"))
    assert sorted(map(tuple, corpus.read_qrels(r).collect()), key=str) == [("1", "a", -1), ("1", "b", None)]


def test_preprocess(spark):
    raw = spark.createDataFrame([(1, " ", "The Cat's")], "doc_id int, text string, body string")
    assert tuple(corpus.preprocess(raw, text_fields=("text", "body")).first()) == ("1", ["the", "cats"], "The Cat's")
