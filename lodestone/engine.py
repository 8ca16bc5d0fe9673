"""The facade (A1-A4, A10, A12, E8-E10, S12): one object per index, answering batches of queries (qid, text), and one that opens
the indexes of a catalogue."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import stemmed_tokens
from lodestone.operators import dense, hybrid, lexical, metrics
from lodestone.operators import refine as refinement
from lodestone.operators.index import Index, exists
from lodestone.session import materialize
from lodestone.sources.vectors import open_store, load_words

LEXICAL = ("tfidf", "bm25")
HYBRIDS = ("parallel", "serial")
DEFAULT_ORDER = ("bm25", "bert", "word2vec", "tfidf")
SYNONYM_WEIGHT = 0.4


@dataclass
class Engine:
    """``vectors`` has a table (doc_id, vec) per dense model; ``encoders`` turns a table (qid, text) into (qid, vec) for each.
    ``analyse`` gives the tokens of a text column and ``stemmer`` maps a column ``term``; by default both are the index's own."""

    index: Index
    vectors: Mapping[str, DataFrame] = field(default_factory=dict)
    encoders: Mapping[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    dictionary: DataFrame | None = None
    synonyms: DataFrame | None = None
    stemmer: Callable[[DataFrame], DataFrame] | None = None
    analyse: Callable[[Column], Column] | None = None
    _evaluated: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.stemmer = self.stemmer or (self.index.analyser.stemmer if self.analyse is None else None)
        self.analyse = self.analyse or self.index.analyser.tokens

    def models(self) -> list[str]:
        """A2: single models, and both hybrids as soon as there are two of them."""
        return [*LEXICAL, *self.vectors, *HYBRIDS]

    def context(self, queries: DataFrame, k1: float | None = None, b: float | None = None) -> DataFrame:
        """A4: queries with tokens, analysed and stemmed as the index is, and parameters."""
        rows = queries.select("qid", "text", self.analyse(F.col("text")).alias("tokens"))
        if self.stemmer:
            rows = stemmed_tokens(rows, self.stemmer)
        return rows.withColumn("k1", F.lit(k1).cast("double")).withColumn("b", F.lit(b).cast("double"))

    def refine(self, queries: DataFrame, history: DataFrame | None = None, spell: bool = True, expand: bool = True, use_history: bool = True) -> DataFrame:
        """R7"""
        if self.dictionary is None or self.synonyms is None:
            raise ValueError("refinement needs the tables dictionary and synonyms")
        return refinement.refine(queries, self.index, self.dictionary, self.synonyms, history, spell, expand, use_history, self.stemmer, self.analyse)

    def suggest(self, queries: DataFrame, history: DataFrame) -> DataFrame:
        return refinement.suggest(queries, history, self.index.terms, stemmer=self.stemmer, analyse=self.analyse)

    def _single(self, model: str, ctx: DataFrame, k: int, candidates: DataFrame | None = None) -> DataFrame:
        if model in LEXICAL:
            return lexical.search(self.index, ctx, model, k) if candidates is None else lexical.rescore(self.index, ctx, candidates, model, k)
        if model not in self.vectors:
            raise ValueError(f"unknown model {model!r}; there are {self.models()}")
        q = self.encoders[model](ctx.select("qid", "text"))
        return dense.exact_top_k(self.vectors[model], q, k) if candidates is None else dense.rescore(self.vectors[model], q, candidates)

    def search(self, queries: DataFrame, model: str = "bm25", k: int = 10, k1: float | None = None, b: float | None = None, refine: bool = False, history: DataFrame | None = None,
               models: Sequence[str] | None = None, fusion: str = "weighted", weights: Mapping[str, float] | None = None, pool: int | None = None,
               stage1: str | None = None, stage2: str | None = None, candidate_k: int = 100, with_text: bool = False) -> DataFrame:
        """A1: a run (qid, doc_id, score, rank) of the first k, with components for hybrids and raw_text if asked for.

        parallel fuses ``models`` over pools of max(100, 5 k); serial reranks candidate_k of stage1 by stage2. The default pair of
        both is the first two of bm25, bert, word2vec and tfidf that there are. With ``refine``, lexical models get corrected tokens, synonyms at weight 0.4 and history
        terms, dense ones the corrected text.
        """
        ctx = self.context(queries, k1, b)
        if refine:
            got = self.refine(queries, history).select("qid", F.col("corrected").alias("text"), "tokens", "exp_terms")
            ctx = got.withColumn("exp_weight", F.lit(SYNONYM_WEIGHT)).withColumn("k1", F.lit(k1).cast("double")).withColumn("b", F.lit(b).cast("double"))
        if model == "parallel":
            usable = [m for m in (models or DEFAULT_ORDER) if m in LEXICAL or m in self.vectors]
            usable = usable if models else usable[:2]
            if len(usable) < 2:
                raise ValueError("fusion needs at least two models")
            if fusion not in ("weighted", "rrf"):
                raise ValueError(f"unknown fusion {fusion!r}")
            lists = hybrid.union_runs({m: self._single(m, ctx, pool or max(100, 5 * k)) for m in usable})
            run = (hybrid.fuse_weighted if fusion == "weighted" else hybrid.fuse_rrf)(lists, weights, k)
        elif model == "serial":
            pair = [m for m in DEFAULT_ORDER if m in LEXICAL or m in self.vectors]
            stage1 = stage1 or pair[0]
            stage2 = stage2 or next(m for m in pair if m != stage1)
            for m in (stage1, stage2):
                if m not in LEXICAL and m not in self.vectors:
                    raise ValueError(f"stage {m!r} isn't available")
            first = self._single(stage1, ctx, candidate_k)
            run = hybrid.serial(first, self._single(stage2, ctx, 1_000_000_000, first), k, (stage1, stage2))
        else:
            run = self._single(model, ctx, k)
        return lexical.with_text(self.index, run) if with_text else run

    def search_refined(self, queries: DataFrame, history: DataFrame | None = None, **options) -> DataFrame:
        """A10: refine, then search with the corrected text only: synonyms and history terms are left out here."""
        fixed = self.refine(queries, history).select("qid", F.col("corrected").alias("text"))
        return self.search(fixed, history=history, **options)

    def evaluate(self, queries: DataFrame, qrels: DataFrame, model: str = "bm25", num_queries: int | None = 50, depth: int = 100, **options) -> tuple[DataFrame, DataFrame]:
        """(per query, aggregate) over the first ``num_queries`` judged queries by qid (None or 0: all). A12: the results of the same
        tables and settings are computed once and kept."""
        key = (queries.semanticHash(), qrels.semanticHash(), model, num_queries, depth, *sorted((k, v.semanticHash() if isinstance(v, DataFrame) else repr(v)) for k, v in options.items()))
        if key not in self._evaluated:
            judged = queries.join(qrels.select("qid").distinct(), "qid", "left_semi")
            if num_queries:
                judged = judged.orderBy("qid").limit(num_queries)
            rows = materialize(metrics.per_query(self.search(judged, model, depth, **options), qrels, queries=judged), "evaluated")
            self._evaluated[key] = rows.select("qid", *[F.round(c, 4).alias(c) for c in ("p", "recall", "ap", "ndcg")]), metrics.aggregate(rows)
        return self._evaluated[key]

    def compare_refinement(self, queries: DataFrame, qrels: DataFrame, model: str = "bm25", **options) -> DataFrame:
        """The measures without and with refinement (spelling and synonyms)."""
        before = self.evaluate(queries, qrels, model, **options)[1]
        return metrics.compare(before, self.evaluate(queries, qrels, model, refine=True, **options)[1])

    def evaluate_all(self, queries: DataFrame, qrels: DataFrame, **options) -> DataFrame:
        """One row per model."""
        out = None
        for m in self.models():
            one = self.evaluate(queries, qrels, m, **options)[1].select(F.lit(m).alias("model"), "*")
            out = one if out is None else out.unionByName(one)
        return out


def word_encoder(words: DataFrame, analyse: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    """V2 for queries: (qid, text) to the mean of the word vectors (term, vec)."""

    def encode(rows: DataFrame) -> DataFrame:
        toks = rows.select(F.col("qid").alias("doc_id"), F.explode_outer(analyse(F.col("text"))).alias("term"))
        return dense.document_vectors(toks, words).withColumnRenamed("doc_id", "qid")

    return encode


def open_engine(spark: SparkSession, path: str, encoders: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None, **tables) -> Engine:
    """The engine of an index with the vector stores written beside it: word2vec with its own words, others where an encoder is given."""
    index, vectors, encoders = Index.load(spark, path), {}, dict(encoders or {})
    if exists(spark, f"{path}/words"):
        encoders.setdefault("word2vec", word_encoder(load_words(spark, f"{path}/words"), index.analyser.tokens))
    for model in encoders:
        if exists(spark, f"{path}/stores/{model}"):
            vectors[model] = open_store(spark, f"{path}/stores/{model}").vectors
    return Engine(index, vectors, encoders, **tables)


def status(spark: SparkSession, path: str, models: Sequence[str] = ("bert", "word2vec")) -> DataFrame:
    """One row: which parts exist, and the corpus figures (null without an index)."""
    there = exists(spark, f"{path}/postings")
    flags = [F.lit(there).alias("lexical"), *[F.lit(exists(spark, f"{path}/stores/{m}/meta")).alias(m) for m in models], F.lit(exists(spark, f"{path}/words")).alias("word_vectors")]
    figures = Index.load(spark, path).meta if there else spark.createDataFrame([(None, None, None)], "num_docs long, avgdl double, total_terms long")
    return figures.select(*flags, "num_docs", F.round("avgdl", 2).alias("avgdl"), "total_terms")


class Engines:
    """A3: the engines of a catalogue's datasets, each opened at its first use."""

    def __init__(self, spark: SparkSession, catalogue, **options):
        self.spark, self.catalogue, self.options, self.opened = spark, catalogue, options, {}

    def get(self, key: str) -> Engine:
        """An index written anew is opened anew (``forget`` it); a missing one is an error that names the command."""
        data = self.catalogue.get(key)
        if key not in self.opened:
            if not exists(self.spark, f"{data.index_path}/postings"):
                raise FileNotFoundError(f"no index for {key!r}; run: python -m lodestone.cli build --corpus {data.path} --format {data.format} --index {data.index_path}")
            self.opened[key] = open_engine(self.spark, data.index_path, **self.options)
        return self.opened[key]

    def forget(self, key: str) -> None:
        self.opened.pop(key, None)
