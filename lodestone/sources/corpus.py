"""Corpus, query and judgement readers, sinks and the dataset catalogue."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import lemmatised, stemmed_tokens, tokens
from lodestone.operators.index import exists
from lodestone.sources.tables import known_time

CORPUS_SCHEMA = "doc_id string, tokens array<string>, raw_text string"
QUERY_FIELDS = ("title", "text", "description", "query")


@dataclass(frozen=True)
class Dataset:
    """A corpus known by key: its files, their format and where its index lives."""

    key: str
    name: str
    path: str
    index_path: str
    format: str = "json"
    query_fields: Sequence[str] = QUERY_FIELDS


class Catalogue:
    """Datasets by key."""

    def __init__(self, datasets: Sequence[Dataset] = ()):
        self.by_key = {d.key: d for d in datasets}

    def get(self, key: str) -> Dataset:
        if key not in self.by_key:
            raise KeyError(f"unknown dataset {key!r}; known: {sorted(self.by_key)}")
        return self.by_key[key]

    def listing(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(d.key, d.name, d.path, exists(spark, d.path)) for d in self.by_key.values()], "key string, name string, path string, available boolean")


def read_corpus(spark: SparkSession, path: str, format: str = "json", limit: int | None = None) -> DataFrame:
    """(doc_id, tokens, raw_text) with null tokens as [], null text as ''. JSON may be one array (format json: one task reads a
    file of it) or one record a line (jsonl, in parallel).
    A missing doc_id becomes the row's running number, in file order. ``limit`` (None or 0: all) keeps the first by number."""
    reader = spark.read.schema(CORPUS_SCHEMA)
    df = reader.option("multiLine", True).json(path) if format == "json" else reader.json(path) if format == "jsonl" else reader.format(format).load(path)
    df = df.withColumn("__at", F.monotonically_increasing_id())
    if limit:
        df = df.orderBy("__at").limit(limit)
    if not df.where("doc_id is null").isEmpty():  # number rows by partition sizes, without bringing them together
        df = df.withColumn("__part", F.shiftright("__at", 33))
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = df.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first")).withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
        df = df.join(sizes.select("__part", "off", "first"), "__part").withColumn("doc_id", F.coalesce("doc_id", (F.col("off") + F.col("__at") - F.col("first")).cast("string")))
    return df.select("doc_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), F.coalesce("raw_text", F.lit("")).alias("raw_text"))


def preprocess(raw: DataFrame, id_col: str = "doc_id", text_fields: Sequence[str] = ("text",), keep_raw: bool = True, stop_words: tuple[str, ...] | None = None, limit: int | None = None,
               stemmer: Callable[[DataFrame], DataFrame] | None = None, lemmas: DataFrame | None = None) -> DataFrame:
    """Corpus records from raw texts: the first field that isn't blank. ``stemmer`` maps a column ``term``, as in Engine;
    ``lemmas`` (form, pos, lemma) are applied before it, each form as a noun."""
    rows = raw.select(F.col(id_col).cast("string").alias("doc_id"), first_filled(raw, text_fields).alias("raw_text"))
    if limit:
        rows = rows.orderBy("doc_id").limit(limit)
    out = rows.select("doc_id", tokens(F.col("raw_text"), stop_words=stop_words).alias("tokens"), "raw_text")
    if lemmas is not None:
        out = stemmed_tokens(out, lambda d: lemmatised(d.withColumn("pos", F.lit("NN")), lemmas).drop("pos"))
    out = stemmed_tokens(out, stemmer) if stemmer else out
    return out if keep_raw else out.drop("raw_text")


def write_corpus(records: DataFrame, path: str, format: str = "json") -> None:
    """Corpus records as JSON lines (read them as ``jsonl``) or Parquet."""
    records.write.mode("overwrite").format(format).save(path)


def first_filled(df: DataFrame, fields: Sequence[str]):
    """The first of the fields that df has and that isn't null or blank; else ''."""
    return F.coalesce(*[F.when(F.trim(F.col(f)) != "", F.col(f)) for f in fields if f in df.columns], F.lit(""))


def read_queries(queries: DataFrame, fields: Sequence[str] = QUERY_FIELDS, limit: int | None = None) -> DataFrame:
    """S3: (qid, text), one row per query_id: of repeated ones the latest asked_at, then the greatest text. Null ids are dropped."""
    at = known_time("asked_at") if "asked_at" in queries.columns else F.lit(0)
    rows = queries.where("query_id is not null").groupBy(F.col("query_id").alias("qid")).agg(F.max(F.struct(at.alias("at"), first_filled(queries, fields).alias("text"))).alias("v"))
    out = rows.select("qid", F.col("v.text").alias("text"))
    return out.orderBy("qid").limit(limit) if limit else out


def read_qrels(qrels: DataFrame) -> DataFrame:
    """(qid, doc_id, rel), the last judgement of each pair; equal times: the greater grade."""
    rows = qrels.where("query_id is not null and doc_id is not null").groupBy(F.col("query_id").alias("qid"), "doc_id")
    return rows.agg(F.max(F.struct(known_time("judged_at").alias("at"), F.col("relevance").alias("rel"))).alias("v")).select("qid", "doc_id", F.col("v.rel").alias("rel"))


def readiness(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(name, n) rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
