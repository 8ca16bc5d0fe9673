"""Command line: python -m lodestone.cli build | preprocess | search | evaluate | status.

Reads and writes paths of any file system Spark knows; queries and judgements are Parquet tables like the supplied ones.
"""

from __future__ import annotations

import argparse
import json
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.engine import Engine, open_engine, status
from lodestone.functions.text import STOP_WORDS, Analyser, stemmed_tokens
from lodestone.operators import dense
from lodestone.operators.index import Index, build_index, check_unique
from lodestone.operators.metrics import markdown
from lodestone.session import DEFAULTS, materialize
from lodestone.sources import corpus
from lodestone.sources.vectors import save_words, write_store

SERVICE_LIMIT = 5000  # documents of a build without a limit of its own under --service


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="index a corpus of (doc_id, tokens, raw_text); tokens are made from raw_text if it has none")
    r = sub.add_parser("preprocess", help="corpus records from raw texts")
    for x in (b, r):
        x.add_argument("--corpus", required=True), x.add_argument("--format", default="json"), x.add_argument("--limit", type=int, default=0)
        x.add_argument("--stop-words", action="store_true"), x.add_argument("--stem", action="store_true"), x.add_argument("--no-raw", action="store_true")
    r.add_argument("--out", required=True), r.add_argument("--fields", nargs="+", default=["text"]), r.add_argument("--out-format", default="json")
    b.add_argument("--service", action="store_true", help=f"at most {SERVICE_LIMIT} documents unless --limit is given, lexical index only")
    b.add_argument("--models", nargs="*", default=[], help="dense models beside the index: word2vec, or a name with --encoder")
    b.add_argument("--sample", type=int, default=0, help="documents that word2vec is trained on, the first by id (0: all); all are embedded")
    b.add_argument("--dim", type=int, default=100), b.add_argument("--epochs", type=int, default=3), b.add_argument("--partitions", type=int, default=1)
    s = sub.add_parser("search")
    s.add_argument("query"), s.add_argument("--top-k", type=int, default=10)
    e = sub.add_parser("evaluate")
    e.add_argument("--queries", required=True), e.add_argument("--qrels", required=True), e.add_argument("--num-queries", type=int, default=50)
    e.add_argument("--depth", type=int, default=100), e.add_argument("--out"), e.add_argument("--all-models", action="store_true")
    e.add_argument("--refine", action="store_true"), e.add_argument("--compare", action="store_true", help="without and with refinement")
    for x in (s, e):
        x.add_argument("--model", default="bm25"), x.add_argument("--k1", type=float), x.add_argument("--b", type=float)
    e.add_argument("--synonyms", help="Parquet of (word, sense, pos, lemma)"), e.add_argument("--dictionary", help="Parquet of (word); by default terms of five documents or more")
    for x in (b, s, e):
        x.add_argument("--encoder", help="module:function that gives the encoder object of the dense models other than word2vec")
    for x in (b, s, e, sub.add_parser("status")):
        x.add_argument("--index", required=True)
    return p


def _encoder(spec: str | None):
    if not spec:
        return None
    module, name = spec.split(":")
    return getattr(import_module(module), name)()


def _query_encoder(encoder):
    return lambda rows: dense.encode_documents(rows, encoder, "qid", "text").withColumnRenamed("doc_id", "qid")


def _build(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = corpus.read_corpus(spark, a.corpus, a.format, a.limit or (SERVICE_LIMIT if a.service else 0))
    check_unique(docs)
    analyser = Analyser(stop_words=STOP_WORDS if a.stop_words else (), stem=a.stem)
    made = docs.where("size(tokens) = 0").select("doc_id", "raw_text", analyser.tokens(F.col("raw_text")).alias("tokens"))
    made = stemmed_tokens(made) if a.stem else made
    docs = materialize(docs.where("size(tokens) > 0").select("doc_id", "raw_text", "tokens").unionByName(made), "corpus")
    index = build_index(docs, F.col("tokens"), text_col=None if a.no_raw else "raw_text")
    index.analyser = analyser
    index.save(a.index)
    for model in [] if a.service else a.models:
        if model == "word2vec":
            sample = docs.orderBy("doc_id").limit(a.sample) if a.sample else docs
            words = materialize(dense.word_vectors(dense.train_word2vec(sample, a.dim, epochs=a.epochs, partitions=a.partitions)), "words")
            save_words(words, f"{a.index}/words")
            vectors = dense.document_vectors(docs.select("doc_id", F.explode_outer("tokens").alias("term")), words)
        elif (encoder := _encoder(a.encoder)) is not None:
            text = F.when(F.trim("raw_text") != "", F.col("raw_text")).otherwise(F.array_join("tokens", " "))
            vectors = dense.encode_documents(docs.withColumn("text", text), encoder)
        else:
            raise ValueError(f"{model!r} needs --encoder")
        write_store(vectors, f"{a.index}/stores/{model}", model)


def _evaluate(spark: SparkSession, engine: Engine, a: argparse.Namespace) -> DataFrame:
    queries, qrels = corpus.read_queries(spark.read.parquet(a.queries)), corpus.read_qrels(spark.read.parquet(a.qrels))
    options = {"num_queries": a.num_queries, "depth": a.depth, "k1": a.k1, "b": a.b}
    if a.refine or a.compare:
        common = engine.index.terms.where("df >= 5 and term rlike '^[a-z]+$'").select(F.col("term").alias("word"))
        engine.dictionary = spark.read.parquet(a.dictionary) if a.dictionary else common
        engine.synonyms = spark.read.parquet(a.synonyms) if a.synonyms else spark.createDataFrame([], "word string, sense int, pos int, lemma string")
    if a.compare:
        return engine.compare_refinement(queries, qrels, a.model, **options)
    if a.refine:
        options["refine"] = True
    if a.all_models:
        return engine.evaluate_all(queries, qrels, **options)
    return engine.evaluate(queries, qrels, a.model, **options)[1].select(F.lit(a.model).alias("model"), "*")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Runs a command; prints and returns its report."""
    a = _parser().parse_args(args)
    spark = spark or SparkSession.builder.config(map=DEFAULTS).getOrCreate()
    if a.command == "preprocess":
        raw = spark.read.option("multiLine", True).json(a.corpus) if a.format == "json" else spark.read.json(a.corpus) if a.format == "jsonl" else spark.read.format(a.format).load(a.corpus)
        stemmer = Analyser(stem=a.stem).stemmer
        corpus.write_corpus(corpus.preprocess(raw, text_fields=a.fields, keep_raw=not a.no_raw, stop_words=STOP_WORDS if a.stop_words else None, limit=a.limit, stemmer=stemmer), a.out, a.out_format)
        report = f"written to {a.out}"
    elif a.command in ("build", "status"):
        if a.command == "build":
            _build(spark, a)
        report = markdown(status(spark, a.index))
    else:
        encoder = _encoder(a.encoder)
        others = {a.model: _query_encoder(encoder)} if encoder and a.model not in ("tfidf", "bm25", "word2vec", "parallel", "serial") else {"bert": _query_encoder(encoder)} if encoder else {}
        engine = open_engine(spark, a.index, others)
        if a.command == "search":
            q = spark.createDataFrame([("q", a.query)], "qid string, text string")
            report = markdown(engine.search(q, a.model, a.top_k, a.k1, a.b, with_text=engine.index.texts is not None).orderBy("rank").drop("qid"))
        else:
            rows = _evaluate(spark, engine, a)
            report = markdown(rows)
            if a.out:
                with open(a.out, "w") as f:
                    json.dump([r.asDict() for r in rows.collect()], f)
    print(report)
    return report


if __name__ == "__main__":
    main()
