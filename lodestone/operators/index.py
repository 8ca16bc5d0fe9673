"""Inverted index (I1-I15): postings, terms, docs and corpus figures as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import Analyser


SMALL_ROWS = 200_000  # terms or documents whose figures are broadcast to the postings at most: some 20 MB


@dataclass
class Index:
    """postings (term, doc_id, tf), terms (term, df, idf), docs (doc_id, length, tfidf_norm), meta (num_docs, avgdl, total_terms)
    in one row, and texts (doc_id, raw_text), which scoring never reads. Postings that are stored also hold length and tfidf_norm
    of their document, so that scoring joins no further table."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    meta: DataFrame
    texts: DataFrame | None = None
    analyser: Analyser = Analyser()

    PARTS = ("postings", "terms", "docs", "meta", "texts")

    def full(self) -> DataFrame:
        """postings with length and tfidf_norm of their document."""
        return self.postings if "length" in self.postings.columns else self.postings.join(self.docs, "doc_id")

    def save(self, path: str) -> None:
        """Parquet, postings with length and tfidf_norm, sorted by term inside each file so that a term filter skips row groups."""
        for p in self.PARTS:
            if (df := getattr(self, p)) is not None:
                if p == "postings":
                    df = self.full().select("term", "doc_id", "tf", "length", "tfidf_norm").repartition("term").sortWithinPartitions("term", "doc_id")
                if p == "meta":
                    df = df.withColumn("analyser", F.lit(self.analyser.dumps()))
                df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{p}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        if not exists(spark, f"{path}/postings"):
            raise FileNotFoundError(f"no index at {path}: write one with build_index(...).save(path)")
        out = cls(*[spark.read.parquet(f"{path}/{p}") if exists(spark, f"{path}/{p}") else None for p in cls.PARTS])
        if "analyser" in out.meta.columns:
            out.analyser = Analyser.loads(out.meta.select("analyser").first()[0])
            out.meta = out.meta.drop("analyser")
        return out


def exists(spark: SparkSession, path: str) -> bool:
    """S9"""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def build_index(docs: DataFrame, tokens: Column, id_col: str = "doc_id", text_col: str | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> Index:
    """The index of a corpus; ``tokens`` gives each row's array of terms.

    Null terms are dropped, a null array is an empty one; documents without terms count in N and have length 0 and norm 0.
    Ids must be unique and not null (see ``check_unique``). An empty corpus has N 0 and avgdl 0. ``keep`` (table, name), such as
    ``session.materialize``, writes each stage once, so that texts are tokenized once however many parts are used; the postings
    then hold length and tfidf_norm of their document.
    """
    stored, keep = keep is not None, keep or (lambda df, name: df)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.array_compact(F.coalesce(tokens, F.array().cast("array<string>"))).alias("tokens"))
    rows = keep(rows, "tokens")
    postings = keep(rows.select("doc_id", F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf")), "postings")
    lengths = rows.select("doc_id", F.size("tokens").cast("long").alias("length"))
    counts = lengths.agg(F.count(F.lit(1)).alias("num_docs"), F.sum("length").alias("total"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = keep(df.select("term", "df", F.log(counts.select("num_docs").scalar() / F.col("df")).alias("idf")), "terms")
    weight = (1 + F.log(F.col("tf").cast("double"))) * F.col("idf")
    norms = postings.join(_small(terms.select("term", "idf"), stored), "term").groupBy("doc_id").agg(F.sqrt(F.sum(weight * weight)).alias("tfidf_norm"))
    doc_rows = keep(lengths.join(norms, "doc_id", "left").select("doc_id", "length", F.coalesce("tfidf_norm", F.lit(0.0)).alias("tfidf_norm")), "docs")
    n_terms = terms.agg(F.count(F.lit(1)).alias("total_terms"))
    meta = counts.select(
        "num_docs", F.when(F.col("num_docs") > 0, F.coalesce(F.col("total"), F.lit(0)) / F.col("num_docs")).otherwise(0.0).alias("avgdl"), n_terms.scalar().alias("total_terms"))
    meta = keep(meta, "meta")
    if stored:
        postings = keep(postings.join(_small(doc_rows, stored), "doc_id").select("term", "doc_id", "tf", "length", "tfidf_norm"), "scored")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("raw_text")) if text_col else None
    return Index(postings, terms, doc_rows, meta, texts)


def _small(table: DataFrame, stored: bool) -> DataFrame:
    """The table, to be broadcast if it is stored, so that counting it is cheap, and has at most SMALL_ROWS rows."""
    return F.broadcast(table) if stored and table.count() <= SMALL_ROWS else table


def index_texts(docs: DataFrame, text_col: str, analyser: Analyser = Analyser(), id_col: str = "doc_id", keep: Callable[[DataFrame, str], DataFrame] | None = None) -> Index:
    """The index of raw texts, treated by ``analyser``, which stays with it."""
    rows = analyser.add(docs.select(id_col, F.col(text_col).alias("__text")), "__text")
    out = build_index(rows, F.col("tokens"), id_col, "__text", keep)
    out.analyser = analyser
    return out


def check_unique(docs: DataFrame, id_col: str = "doc_id") -> None:
    """Raises if an id is null or repeated."""
    bad = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"{id_col} is null or repeated: {bad[0][0]!r}")


def lookup(index: Index, terms: DataFrame) -> DataFrame:
    """Df and idf of each (term), 0 when absent."""
    return terms.join(index.terms, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"), F.coalesce("idf", F.lit(0.0)).alias("idf"))


def postings_of(index: Index, terms: DataFrame) -> DataFrame:
    """I8: (term, doc_id, tf, length, tfidf_norm) of the postings of the given terms."""
    return index.full().join(terms.select("term").distinct(), "term", "left_semi").select("term", "doc_id", "tf", "length", "tfidf_norm")


def docs_by_id(index: Index, ids: DataFrame) -> DataFrame:
    """(doc_id, raw_text) of known ids; others are dropped. A null text reads as empty."""
    return index.texts.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.coalesce("raw_text", F.lit("")).alias("raw_text"))


def vocabulary(index: Index, prefix: str = "", limit: int | None = 20, min_df: int = 1) -> DataFrame:
    """Terms that begin with a prefix, by df downwards and then by term."""
    got = index.terms.where(F.col("term").startswith(prefix) & (F.col("df") >= min_df)).orderBy(F.col("df").desc(), "term")
    return got.limit(limit) if limit else got
