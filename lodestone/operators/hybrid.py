"""Fusion and reranking of runs (H1-H8). Scored lists are (qid, model, doc_id, score, rank), one row per qid, model and doc_id."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.lexical import top_k

RRF_K, STAGE1_SHARE = 60, 1e-3


def minmax(score: Column, *group: str) -> Column:
    """H1: the score scaled to 0..1 in its group; a constant group gives 1."""
    w = Window.partitionBy(*group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, 1.0).otherwise((score - low) / (high - low))


def union_runs(runs: Mapping[str, DataFrame]) -> DataFrame:
    """Runs of several models as one scored list."""
    out = None
    for model, run in runs.items():
        one = run.select("qid", F.lit(model).alias("model"), "doc_id", "score", "rank")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no runs")
    return out


def _weight(weights: Mapping[str, float] | None) -> Column:
    out = F.lit(1.0)
    for model, w in (weights or {}).items():
        out = F.when(F.col("model") == model, float(w)).otherwise(out)
    return out


def _fused(rows: DataFrame, part: Column, shown: Column, k: int) -> DataFrame:
    parts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "shown"))))
    return top_k(rows.withColumn("part", part).withColumn("name", shown["name"]).withColumn("shown", shown["shown"]).groupBy("qid", "doc_id").agg(F.sum("part").alias("score"), parts.alias("components")), k)


def fuse_weighted(scored: DataFrame, weights: Mapping[str, float] | None = None, k: int = 10) -> DataFrame:
    """H2, H4: sum of weight * min-max score over the models that have the document; components hold the raw scores.
    A model without a weight counts 1."""
    rows = scored.withColumn("unit", minmax(F.col("score"), "qid", "model"))
    return _fused(rows, _weight(weights) * F.col("unit"), F.struct(F.col("model").alias("name"), F.col("score").alias("shown")), k)


def fuse_rrf(scored: DataFrame, weights: Mapping[str, float] | None = None, k: int = 10) -> DataFrame:
    """H3, H4: sum of weight / (60 + rank); components hold <model>_rank."""
    return _fused(scored, _weight(weights) / (RRF_K + F.col("rank")), F.struct(F.concat("model", F.lit("_rank")).alias("name"), F.col("rank").cast("double").alias("shown")), k)


def serial(stage1: DataFrame, stage2: DataFrame, k: int = 10, names: Sequence[str] = ("stage1", "stage2")) -> DataFrame:
    """H5: candidates of stage 1 ranked by min-max of their stage 2 score (0 where it has none) + 0.001 * min-max of stage 1.
    Only candidates of stage 1 come out; components hold the raw scores of both."""
    one = stage1.select("qid", "doc_id", F.col("score").alias("s1"), minmax(F.col("score"), "qid").alias("n1"))
    two = stage2.join(stage1.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi").select("qid", "doc_id", F.col("score").alias("s2"), minmax(F.col("score"), "qid").alias("n2"))
    both = one.join(two, ["qid", "doc_id"], "left")
    parts = F.map_filter(F.create_map(F.lit(f"{names[0]}_stage1"), F.col("s1"), F.lit(f"{names[1]}_stage2"), F.col("s2")), lambda _, v: v.isNotNull())
    return top_k(both.select("qid", "doc_id", (F.coalesce("n2", F.lit(0.0)) + STAGE1_SHARE * F.col("n1")).alias("score"), parts.alias("components")), k)
