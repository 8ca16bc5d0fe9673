"""Queries of problem 1: per-key results over postings in which a few terms and docs hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.skew import count_rows, heavy_keys, salted_aggregate, sum_of
from lodestone.session import materialize
from lodestone.sources.tables import CLEAN_SQL, clean_postings, table

TERM_SHARE, DOC_ROWS = 0.03, 120


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return materialize(clean_postings(table(spark, d, "postings"), table(spark, d, "docs")), "clean")


def _totals(clean: DataFrame, key: str, other: str) -> DataFrame:
    return salted_aggregate(clean, key, [count_rows("n_rows"), sum_of("tf", "sum_tf")], heavy_keys(clean, key), [other])


def p1_totals(spark: SparkSession, d: str) -> DataFrame:
    """Row count and sum of tf of every term and of every doc_rowid of the clean postings."""
    clean = _clean(spark, d)
    terms = _totals(clean, "term", "doc_rowid").select(F.lit("term").alias("key_kind"), F.col("term").alias("key_value"), "n_rows", "sum_tf")
    docs = _totals(clean, "doc_rowid", "term").select(F.lit("doc_rowid").alias("key_kind"), F.col("doc_rowid").cast("string").alias("key_value"), "n_rows", "sum_tf")
    return terms.unionByName(docs)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms with at least 3% of the clean postings and docs with at least 120 of them."""
    clean = _clean(spark, d)
    all_rows = clean.count()
    terms = _totals(clean, "term", "doc_rowid").where(F.col("n_rows") >= TERM_SHARE * all_rows)
    docs = _totals(clean, "doc_rowid", "term").where(F.col("n_rows") >= DOC_ROWS)
    return terms.select(F.lit("term").alias("key_kind"), F.col("term").alias("key_value")).unionByName(
        docs.select(F.lit("doc_rowid").alias("key_kind"), F.col("doc_rowid").cast("string").alias("key_value")))


QUERIES = {"p1_found": p1_found, "p1_totals": p1_totals}
SQL = {
    "p1_totals": f"""WITH {CLEAN_SQL}
SELECT 'term' AS key_kind, term AS key_value, count(*) AS n_rows, sum(tf)::BIGINT AS sum_tf FROM clean GROUP BY term
UNION ALL SELECT 'doc_rowid', doc_rowid::VARCHAR, count(*), sum(tf)::BIGINT FROM clean GROUP BY doc_rowid""",
    "p1_found": f"""WITH {CLEAN_SQL}
SELECT 'term' AS key_kind, term AS key_value FROM clean GROUP BY term HAVING count(*) >= {TERM_SHARE} * (SELECT count(*) FROM clean)
UNION ALL SELECT 'doc_rowid', doc_rowid::VARCHAR FROM clean GROUP BY doc_rowid HAVING count(*) >= {DOC_ROWS}""",
}
