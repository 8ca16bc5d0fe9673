"""Problem 7: how distinctive a term is in a record, by log-entropy weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.skew import heavy_counts, skew_join
from lodestone.session import materialize
from lodestone.sources.tables import CLEAN_SQL, clean_postings, doc_count, table


def term_spread(clean: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, gf, global_weight), by two aggregations: rows by (term, tf), then by term.

    With p = tf / gf the entropy of a term's spread is ln gf - sum(tf ln tf) / gf. The global weight is one minus
    that entropy over ln N: 1 for a term in one record, near 0 for one spread evenly over all; 1 where N < 2. The
    first aggregation leaves a term with as many rows as it has different tf, so frequent terms are no hot spots.
    """
    by_tf = clean.groupBy("term", "tf").agg(F.count(F.lit(1)).alias("n"))
    sums = by_tf.groupBy("term").agg(
        F.sum("n").alias("df"), F.sum(F.col("n") * F.col("tf")).alias("gf"), F.sum(F.col("n") * F.col("tf") * F.log(F.col("tf").cast("double"))).alias("tlt"))
    entropy = F.log("gf") - F.col("tlt") / F.col("gf")
    weight = F.lit(1.0) if n_docs < 2 else F.greatest(F.lit(0.0), 1 - entropy / F.log(F.lit(float(n_docs))))
    return sums.select("term", "df", "gf", weight.alias("global_weight"))


def log_entropy(clean: DataFrame, n_docs: int, share: float | None = None) -> DataFrame:
    """(term, doc_rowid, tf, df, weight) of clean postings: weight = (1 + ln tf) * global weight.

    Frequent terms (more rows than a slice of a task's share, or at least ``share`` of all) are salted in the join, in as many parts as
    they have slices. Rows must be unique per (term, doc_rowid)
    with tf >= 1, as clean_postings leaves them; an empty input gives no row.
    """
    spread = materialize(term_spread(clean, n_docs), "spread")
    rows = clean.count()
    heavy = heavy_counts(spread, "term", "df", rows, share)
    joined = skew_join(clean, spread, "term", "inner", heavy, ["doc_rowid"])
    return joined.select("term", "doc_rowid", "tf", "df", ((1 + F.log(F.col("tf").cast("double"))) * F.col("global_weight")).alias("weight"))


def _weights(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    docs = table(spark, d, "docs")
    n = doc_count(docs)
    return log_entropy(materialize(clean_postings(table(spark, d, "postings"), docs), "clean"), n), n


def p7_weights(spark: SparkSession, d: str) -> DataFrame:
    """The weight of every clean posting."""
    return _weights(spark, d)[0].select("term", "doc_rowid", "tf", F.round("weight", 6).alias("weight"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Clean postings with df >= 2 and (1 + ln tf) ln(N / df) >= 1.5 ln N.

    Entropy is at most ln df, so the weight is at least (1 + ln tf) ln(N / df) / ln N: a weight of 1.5 or more misses
    none of the cases, and the exact condition is checked on what it leaves.
    """
    weights, n = _weights(spark, d)
    ln_n = F.log(F.lit(float(max(n, 1))))
    exact = (1 + F.log(F.col("tf").cast("double"))) * F.log(F.lit(float(n)) / F.col("df")) >= 1.5 * ln_n
    return weights.where(F.col("weight") >= 1.5 - 1e-9).where((F.col("df") >= 2) & exact).select("doc_rowid", "term")


QUERIES = {"p7_found": p7_found, "p7_weights": p7_weights}
SQL = {
    "p7_found": f"""WITH {CLEAN_SQL}, dfs AS (SELECT term, count(*) AS df FROM clean GROUP BY term)
SELECT doc_rowid, term FROM clean JOIN dfs USING (term), ndocs WHERE df >= 2 AND (1 + ln(tf)) * ln(n / df) >= 1.5 * ln(n)""",
    "p7_weights": f"""WITH {CLEAN_SQL}, s AS (SELECT term, sum(tf) AS gf, sum(tf * ln(tf)) AS tlt FROM clean GROUP BY term)
SELECT term, doc_rowid, tf, round((1 + ln(tf)) * greatest(0, 1 - (ln(gf) - tlt / gf) / ln(n)), 6) AS weight FROM clean JOIN s USING (term), ndocs""",
}
