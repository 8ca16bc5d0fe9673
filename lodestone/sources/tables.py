"""Readers of the supplied tables, and the shared clean-ups of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.skew import heavy_keys, skew_join

BLANKS = " \t\n\r"


def known_time(col: str) -> Column:
    """The time, or the oldest one where it is null."""
    return F.coalesce(F.col(col), F.lit("0001-01-01 00:00:00").cast("timestamp"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_docs(docs: DataFrame, *cols) -> DataFrame:
    """(doc_rowid, cols) of the row with the greatest ingested_at of each doc_rowid.

    A null time is the oldest; equal times are settled by the greatest values. Rows without doc_rowid are
    dropped. One shuffle: versions and repeated rows are combined before it, so a doc_rowid with very many
    rows is no hot spot. Pass an expression that is null where its text is of no use, and less is moved.
    """
    best = F.max(F.struct(known_time("ingested_at").alias("at"), *cols)).alias("v")
    return docs.where(F.col("doc_rowid").isNotNull()).groupBy("doc_rowid").agg(best).select("doc_rowid", *[f"v.`{c}`" for c in _names(docs, cols)])


def _names(df: DataFrame, cols) -> list[str]:
    return df.select(*cols).columns


def valid_postings(postings: DataFrame) -> DataFrame:
    """(term, doc_rowid, tf) of usable rows: term in lower case without blanks around it, the latest row of each
    (term, doc_rowid). Equal times: the greater tf. A null time is the oldest."""
    rows = postings.select(F.lower(F.trim("term", F.lit(BLANKS))).alias("term"), "doc_rowid", "tf", known_time("indexed_at").alias("at"))
    rows = rows.where("term is not null and term <> '' and doc_rowid is not null and tf >= 1")
    return rows.groupBy("term", "doc_rowid").agg(F.max(F.struct("at", "tf")).alias("v")).select("term", "doc_rowid", F.col("v.tf").alias("tf"))


def clean_postings(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """valid_postings of docs that exist. Docs with a large share of the rows are salted in the join."""
    ids = docs.select("doc_rowid").distinct()
    heavy = heavy_keys(postings, "doc_rowid")
    return skew_join(valid_postings(postings), ids, "doc_rowid", "left_semi", heavy, ["term"]).select("term", "doc_rowid", "tf")


def doc_count(docs: DataFrame) -> int:
    """N: the number of distinct doc_rowid."""
    return docs.select("doc_rowid").where("doc_rowid is not null").distinct().count()


CLEAN_SQL = r"""
valid AS (
  SELECT lower(trim(term, chr(32) || chr(9) || chr(10) || chr(13))) AS term, doc_rowid, tf, indexed_at FROM postings
  WHERE term IS NOT NULL AND doc_rowid IS NOT NULL AND tf >= 1),
clean AS (
  SELECT term, doc_rowid, tf FROM valid
  WHERE term <> '' AND doc_rowid IN (SELECT doc_rowid FROM docs)
  QUALIFY row_number() OVER (PARTITION BY term, doc_rowid ORDER BY indexed_at DESC NULLS LAST, tf DESC) = 1),
ndocs AS (SELECT count(DISTINCT doc_rowid) AS n FROM docs)"""

CURRENT_SQL = """
cur AS (
  SELECT * FROM docs WHERE doc_rowid IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_rowid ORDER BY ingested_at DESC NULLS LAST, raw_text DESC NULLS LAST) = 1)"""
