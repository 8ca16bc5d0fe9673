"""Effectiveness measures (E1-E10) for all queries in one job. run (qid, doc_id, rank), qrels (qid, doc_id, rel)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10, recall_depth: int | None = None, ap_depth: int | None = None, queries: DataFrame | None = None) -> DataFrame:
    """(qid, p, recall, ap, ndcg) of every query of ``queries`` (qid; by default those of qrels); without hits all are 0.

    Relevant is rel > 0. P divides by k even for shorter lists (0 if k < 1), recall and AP by all relevant documents.
    nDCG has linear gains: a negative judgement lowers DCG, the ideal list has positive ones only. qrels must have one
    row per (qid, doc_id) (see ``latest``); null rel counts as not judged.
    """
    judged = run.join(qrels.where("rel is not null").select("qid", "doc_id", "rel"), ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    upto = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    judged = judged.withColumn("hit", (F.col("rel") > 0).cast("int")).withColumn("hits", F.sum("hit").over(upto))
    inside = lambda depth: F.col("rank") <= depth if depth else F.lit(True)
    got = judged.groupBy("qid").agg(
        F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias("top_hits"), F.sum(F.when(inside(recall_depth), F.col("hit")).otherwise(0)).alias("all_hits"),
        F.sum(F.when(inside(ap_depth) & (F.col("hit") == 1), F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.sum(F.when(F.col("rank") <= k, F.col("rel") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    best = Window.partitionBy("qid").orderBy(F.col("rel").desc(), "doc_id")
    ideal = qrels.where("rel > 0").withColumn("i", F.row_number().over(best)).groupBy("qid").agg(
        F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("i") <= k, F.col("rel") / F.log2(F.col("i") + 1.0)).otherwise(0.0)).alias("ideal"))
    base = (queries if queries is not None else qrels).select("qid").distinct()
    share = lambda a, b: F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0))
    return base.join(got, "qid", "left").join(ideal, "qid", "left").select(
        "qid", (F.coalesce("top_hits", F.lit(0)) / k if k > 0 else F.lit(0.0)).alias("p"), share("all_hits", "relevant").alias("recall"),
        share("precisions", "relevant").alias("ap"), share("dcg", "ideal").alias("ndcg"))


def aggregate(rows: DataFrame) -> DataFrame:
    """Means over queries to 4 decimals, and their number; zeros for none. Rounding to 9 decimals first takes out what the
    order of summation leaves, so that a mean half way between two values rounds the same way every time."""
    mean = lambda c: F.round(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 9), 4)
    return rows.agg(mean("ap").alias("map"), mean("recall").alias("recall"), mean("p").alias("p_at_k"), mean("ndcg").alias("ndcg_at_k"), F.count(F.lit(1)).alias("num_queries"))


MEASURES = ("map", "recall", "p_at_k", "ndcg_at_k")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per measure with before, after and the difference of the rounded figures."""
    long = lambda df, name: df.select(F.explode(F.create_map(*[x for m in MEASURES for x in (F.lit(m), F.col(m))])).alias("measure", name))
    both = long(before, "before").join(long(after, "after"), "measure")
    return both.withColumn("delta", F.round(F.col("after") - F.col("before"), 4))


def latest(qrels: DataFrame) -> DataFrame:
    """(qid, doc_id, rel) of the last judgement of each pair; equal times: the greater grade. Null ids are dropped."""
    rows = qrels.where("qid is not null and doc_id is not null")
    return rows.groupBy("qid", "doc_id").agg(F.max(F.struct("judged_at", "rel")).alias("v")).select("qid", "doc_id", F.col("v.rel").alias("rel"))


def markdown(rows: DataFrame) -> str:
    """A small table as Markdown text."""
    head, body = rows.columns, rows.collect()
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(str(v) for v in r) + " |" for r in body)])
