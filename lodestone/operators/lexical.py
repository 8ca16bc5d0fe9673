"""Lexical ranking (L1-L8) of whole batches of queries.

Queries are rows (qid, tokens array<string>) with optional k1, b, exp_terms array<string> and exp_weight. A run is
(qid, doc_id, score, rank): score rounded to 6 decimals, rank by score downwards and then doc_id.

Postings hold what scoring needs of their document. Those of the batch's terms are brought together in parts of the documents,
the batch's queries are sent to each part, and a task scores them there in arrays (see ``parts``), so that the many partial scores
are never rows and only the first k per query and part move on. Candidates go to the part of their document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.index import Index
from lodestone.operators.parts import SLICE_DOCS, Part
from lodestone.operators.skew import heavy_counts, skew_join
from lodestone.session import materialize

K1, B = 1.5, 0.75
BROADCAST_ROWS = 500_000  # terms, or ids of documents, that are broadcast at most: some 50 MB
PART_DOCS = 40_000  # documents that meet the queries in one task
OUT_ROWS = 2_500_000  # rows that come out of a task at most


def _optional(queries: DataFrame, name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in queries.columns else F.lit(default)


def top_k(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Ranks (qid, doc_id, score) by rounded score, then doc_id, and keeps the first k of each query."""
    rounded = scores.withColumn("score", F.round(score, 6))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc_id")
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, qtf, mult, k1, b): mult is the weight of expansion terms (L5), 1 for others."""
    weight = _optional(queries, "exp_weight", 1.0).cast("double")
    exp = F.col("exp_terms") if "exp_terms" in queries.columns else F.array().cast("array<string>")
    rows = queries.select("qid", F.explode("tokens").alias("term"), exp.alias("exp"), weight.alias("w"), _optional(queries, "k1", K1).cast("double").alias("k1"), _optional(queries, "b", B).cast("double").alias("b"))
    mult = F.when(F.coalesce(F.array_contains("exp", F.col("term")), F.lit(False)), F.col("w")).otherwise(1.0)
    return rows.where("term is not null").withColumn("mult", mult).groupBy("qid", "term", "mult", "k1", "b").agg(F.count(F.lit(1)).alias("qtf"))


def tfidf_weights(index: Index, queries: DataFrame) -> DataFrame:
    """L1: (qid, term, weight) with (1 + ln qtf) * idf * mult of terms with a positive idf."""
    known = query_terms(queries).join(index.terms.where("idf > 0"), "term")
    return known.select("qid", "term", "idf", ((1 + F.log(F.col("qtf").cast("double"))) * F.col("idf") * F.col("mult")).alias("weight"))


def tfidf_terms(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, term, w, flat, slope) whose gains (see ``parts``) add up to the cosine. The query norm counts the terms that the index
    knows; a query of norm 0 scores 0."""
    w = tfidf_weights(index, queries)
    norms = w.groupBy("qid").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("qnorm"))
    part = F.when(F.col("qnorm") > 0, F.col("weight") * F.col("idf") / F.col("qnorm")).otherwise(0.0)
    return w.join(norms, "qid").select("qid", "term", part.alias("w"), F.lit(0.0).alias("flat"), F.lit(0.0).alias("slope"))


def bm25_terms(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, term, w, flat, slope) over distinct query terms; k1 and b per query, null for the default, 0 honoured."""
    n, avgdl = index.meta.select("num_docs").scalar(), index.meta.select(F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl"))).scalar()
    terms = query_terms(queries).join(index.terms.select("term", "df"), "term")
    k1, b = F.col("k1"), F.col("b")
    weight = F.col("mult") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (k1 + 1)
    return terms.select("qid", "term", weight.alias("w"), (k1 * (1 - b)).alias("flat"), (k1 * b / avgdl).alias("slope"))


SCORERS = {"tfidf": (tfidf_terms, "tfidf_norm"), "bm25": (bm25_terms, "length")}


def _scored(index: Index, queries: DataFrame, model: str, k: int, candidates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, bags): hits (bag, doc_id, score) with the first k of each part at least, or all candidates (qid, doc_id) that share a
    term; bags (bag, qids). Queries of the same terms and weights are one bag, but not where candidates are given."""
    make, figure = SCORERS[model]
    some = candidates is not None
    terms = materialize(make(index, queries), "asked")
    numbered = materialize(terms.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "terms")
    entry = F.struct("tid", "w", "flat", "slope")
    bags = terms.join(numbered, "term").groupBy("qid").agg(F.sort_array(F.collect_list(entry)).alias("terms"))
    bags = bags.groupBy("terms").agg(F.collect_list("qid").alias("qids")) if not some else bags.select("terms", F.array("qid").alias("qids"))
    bags = materialize(bags.withColumn("bag", F.monotonically_increasing_id()), "bags")
    n_docs, n_bags, n_terms = index.meta.first()["num_docs"], bags.count(), numbered.count()
    n_parts = max(1, ceil(n_docs / PART_DOCS), min(bags.sparkSession.sparkContext.defaultParallelism, n_docs // 500))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(n_parts)).cast("int").alias("part")
    posts = index.full().select("term", "doc_id", "tf", figure)
    if n_terms <= BROADCAST_ROWS:
        posts = posts.join(F.broadcast(numbered), "term")
    else:
        heavy = heavy_counts(index.terms, "term", "df", max(n_terms, index.terms.agg(F.sum("df")).first()[0] or 0))
        posts = skew_join(posts, numbered, "term", "inner", heavy, ["doc_id"])
    kind = dict(posts.dtypes)["doc_id"]
    hits = f"bag long, doc_id {kind}, score double"
    none = [F.lit(None).cast("long").alias("bag"), F.lit(None).cast(dict(bags.dtypes)["terms"]).alias("terms"), *([F.lit(None).cast(f"array<{kind}>").alias("cands")] if some else [])]
    # one row a document: a task is sent rows one by one, which costs more than what is in them
    docs = posts.groupBy("doc_id").agg(F.max(F.col(figure).cast("double")).alias("figure"), F.collect_list("tid").alias("tids"), F.collect_list(F.col("tf").cast("int")).alias("tfs"))
    rows = docs.select(part, "doc_id", "figure", "tids", "tfs", *none)
    empty = [F.lit(None).cast(t).alias(c) for c, t in rows.dtypes[1:5]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        numbers = t["part"].to_numpy()
        for p in np.unique(numbers):  # one, unless the shuffle put two into one task
            own = Part(t.filter(pa.array(numbers == p)), model, None if some else SLICE_DOCS)
            yield from own.asked() if some else own.first(k)

    def met(asked: DataFrame) -> DataFrame:
        both = rows.unionByName(asked.select("part", *empty, "bag", "terms", *(["cands"] if some else [])))
        return both.repartitionById(n_parts, F.col("part")).mapInArrow(run, hits)

    if some:
        wanted = candidates.select("qid", "doc_id").distinct().groupBy("qid", part).agg(F.collect_list("doc_id").alias("cands"))
        return met(wanted.join(bags.select(F.col("qids")[0].alias("qid"), "bag", "terms"), "qid")), bags
    # each round has bags whose first k of a part are at most OUT_ROWS rows
    rounds = ceil(n_bags * min(k, PART_DOCS) / OUT_ROWS) or 1
    each = bags.select("bag", "terms", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"))
    turns = [met(each.where(F.pmod(F.xxhash64("bag"), F.lit(rounds)) == turn) if rounds > 1 else each) for turn in range(rounds)]
    if rounds > 1:  # the shuffle of a round is gone before the next
        turns = [materialize(top_k(h.withColumnRenamed("bag", "qid"), k).select(F.col("qid").alias("bag"), "doc_id", "score"), "turn") for h in turns]
    return reduce(DataFrame.unionByName, turns), bags


def _named(ranked: DataFrame, bags: DataFrame) -> DataFrame:
    """A run of bags, as one of their queries."""
    return ranked.withColumnRenamed("qid", "bag").join(bags.select("bag", F.explode("qids").alias("qid")), "bag").select("qid", "doc_id", "score", "rank")


def search(index: Index, queries: DataFrame, model: str = "bm25", k: int = 10) -> DataFrame:
    """The first k documents of each query. A null qid has none."""
    hits, bags = _scored(index, queries.where("qid is not null"), model, k)
    return _named(materialize(top_k(hits.withColumnRenamed("bag", "qid"), k), "run"), bags)


def rescore(index: Index, queries: DataFrame, candidates: DataFrame, model: str = "bm25", k: int = 1_000_000_000) -> DataFrame:
    """Candidates (qid, doc_id) scored with the figures of the whole index; those without a common term have no row."""
    hits, bags = _scored(index, queries, model, k, candidates)
    return _named(materialize(top_k(hits.withColumnRenamed("bag", "qid"), k), "run"), bags)


def with_text(index: Index, run: DataFrame) -> DataFrame:
    """The run with raw_text, joined after the top k. Texts of other documents aren't moved."""
    wanted = run.select("doc_id").distinct()
    few = wanted.count() <= BROADCAST_ROWS
    return run.join(index.texts.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi"), "doc_id", "left")
