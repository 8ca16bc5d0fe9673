"""Queries of the retrieval operators over the supplied tables, and their SQL.

documents is the corpus, queries the query set (the first filled of title, text, description), embeddings and vectors the
vector stores, search_results the scored lists, qrels the judgements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import dense, hybrid, lexical, metrics, refine
from lodestone.operators.index import Index, build_index, docs_by_id, lookup, postings_of, vocabulary
from lodestone.operators.skew import heavy_keys, ranked_within
from lodestone import session
from lodestone.session import materialize, spread
from lodestone.sources import corpus, vectors
from lodestone.sources.tables import CURRENT_SQL, current_docs, known_time, table

QUERIES, SQL = {}, {}
_built: dict[tuple, Index] = {}
SYNONYMS = [("school", 1, 1, "school"), ("school", 1, 2, "college"), ("school", 1, 3, "education"), ("school", 2, 1, "swarm"), ("teachers", 1, 1, "school_teacher"),
            ("teachers", 1, 2, "instructors"), ("teachers", 1, 3, "workers"), ("public", 1, 1, "national"), ("ban", 1, 1, "rule"), ("ban", 1, 2, "law"), ("reduce", 1, 1, "lower"),
            ("reduce", 1, 2, "cut"), ("arguments", 1, 1, "reason"), ("accept", 1, 1, "support"), ("online", 1, 1, "digital"), ("free", 1, 1, "open"), ("streets", 1, 1, "roads")]
HISTORY = ["public transport", "school uniforms for students", "online voting", "free school meals", "tax on sugar", "public surveillance of streets"]
PROBE = ["school", "public", "the", "xyzzy", "tax"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table: another stamp means other data."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)))


def _index(spark: SparkSession, d: str) -> Index:
    """The index over documents, written once per session and state of the files (A3); later queries read it."""
    key = spark.sparkContext.applicationId, d, _stamp(spark, f"{d}/documents.parquet")
    if key in _built:
        return _built[key]
    ix = build_index(_docs(spark, d), T.tokens(F.col("text")), text_col="text", keep=lambda df, name: materialize(df, name, lasting=True))
    _built[key] = Index(spread(ix.postings), ix.terms, ix.docs, ix.meta, ix.texts)
    return _built[key]


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return corpus.read_queries(table(spark, d, "queries"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("qid", "text", T.tokens(F.col("text")).alias("tokens"))


# SQL shared by the oracles
_SPLIT = r"list_filter(string_split_regex(regexp_replace(lower({c}), '[!-/:-@\[-`{{-~]', '', 'g'), '[\s\x0B\x{{85}}\p{{Z}}]+'), lambda x: regexp_full_match(x, '\p{{L}}+'))"
TOK = f"tok AS (SELECT doc_id, unnest({_SPLIT.format(c='text')}) AS term FROM documents)"
IX = f"""{TOK},
pst AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT d.doc_id, coalesce(l.n, 0) AS length FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1) l USING (doc_id)),
meta AS (SELECT count(*) AS num_docs, sum(length) / count(*) AS avgdl FROM dl),
terms AS (SELECT term, count(*) AS df, ln(num_docs / count(*)) AS idf FROM pst, meta GROUP BY term, num_docs),
nrm AS (SELECT d.doc_id, coalesce(sqrt(sum(((1 + ln(tf)) * idf) ** 2)), 0) AS tfidf_norm, any_value(length) AS length FROM dl d LEFT JOIN pst USING (doc_id) LEFT JOIN terms USING (term) GROUP BY d.doc_id)"""
Q = """qs AS (
  SELECT query_id AS qid, coalesce(CASE WHEN trim(title) <> '' THEN title END, CASE WHEN trim(text) <> '' THEN text END, CASE WHEN trim(description) <> '' THEN description END, '') AS text
  FROM queries WHERE query_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY asked_at DESC NULLS LAST, 2 DESC) = 1)"""
QT = f"{Q}, qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({_SPLIT.format(c='text')}) AS term FROM qs) GROUP BY ALL)"


def _bm25_sql(terms: str, k1: str = "1.5", b: str = "0.75", key: str = "qid", mult: str = "1.0") -> str:
    """SELECT key, doc_id, score over query terms (key, term, ...)."""
    return f"""SELECT {key}, doc_id, round(sum({mult} * ln(1 + (num_docs - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * length / avgdl))), 6) AS score
  FROM {terms} JOIN terms USING (term) JOIN pst USING (term) JOIN dl USING (doc_id), meta GROUP BY {key}, doc_id"""


_TFIDF = """w AS (SELECT qid, term, idf, (1 + ln(qtf)) * idf AS weight FROM qt JOIN terms USING (term) WHERE idf > 0),
qn AS (SELECT qid, sqrt(sum(weight ** 2)) AS qnorm FROM w GROUP BY qid),
tfs AS (SELECT qid, doc_id, round(CASE WHEN any_value(tfidf_norm) * any_value(qnorm) > 0 THEN sum(weight * (1 + ln(tf)) * idf) / (any_value(tfidf_norm) * any_value(qnorm)) ELSE 0 END, 6) AS score
  FROM w JOIN pst USING (term) JOIN nrm USING (doc_id) JOIN qn USING (qid) GROUP BY qid, doc_id)"""


def _ranked(source: str, k: int | None = 10, key: str = "qid", cols: str = "") -> str:
    top = f" QUALIFY rank <= {k}" if k else ""
    return f"SELECT {key}, doc_id, score{cols}, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, doc_id)::INTEGER AS rank FROM {source}{top}"


@query("tokens", f"SELECT doc_id, pos::INTEGER AS pos, toks[pos + 1] AS token FROM (SELECT doc_id, toks, unnest(range(0, len(toks))) AS pos FROM (SELECT doc_id, {_SPLIT.format(c='text')} AS toks FROM documents))")
def tokens(spark, d):
    """T1-T5"""
    return _docs(spark, d).select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "token"))


@query("tokens_stop", f"WITH {TOK} SELECT doc_id, term AS token, count(*) AS n FROM tok WHERE term NOT IN ({', '.join(repr(w) for w in T.STOP_WORDS)}) GROUP BY ALL")
def tokens_stop(spark, d):
    """T6"""
    return _docs(spark, d).select("doc_id", F.explode(T.tokens(F.col("text"), stop_words=T.STOP_WORDS)).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


@query("tokens_stem")
def tokens_stem(spark, d):
    """Counts of stems over documents"""
    rows = _docs(spark, d).select(F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return T.stemmed(rows).groupBy("term").agg(F.sum("n").alias("n"))


LEMMAS = [("schools", "n", "school"), ("students", "n", "student"), ("taxes", "n", "tax"), ("rules", "n", "rule"), ("people", "n", "person"), ("streets", "n", "street"), ("is", "v", "be"), ("are", "v", "be")]


@query("tokens_lemma", f"WITH {TOK} SELECT coalesce(l.lemma, term) AS lemma, count(*) AS n FROM tok LEFT JOIN (VALUES {', '.join(map(repr, LEMMAS))}) l(form, pos, lemma) ON l.form = term AND l.pos = 'n' GROUP BY ALL")
def tokens_lemma(spark, d):
    """Counts of lemmas over documents, every word taken for a noun"""
    rows = _docs(spark, d).select(F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).withColumn("pos", F.lit("NN"))
    lemmas = spark.createDataFrame(LEMMAS, "form string, pos string, lemma string")
    return T.lemmatised(rows, lemmas).groupBy(F.col("term").alias("lemma")).agg(F.sum("n").alias("n"))


@query("language_guess", f"""WITH {TOK}, cw AS (SELECT DISTINCT lower(lang) AS lang, lower(word) AS term FROM common_words WHERE lang IS NOT NULL AND word IS NOT NULL),
h AS (SELECT doc_id, lang, count(*) AS n FROM tok JOIN cw USING (term) GROUP BY ALL), b AS (SELECT doc_id, lang FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) = 1)
SELECT doc_id, b.lang AS lang, coalesce(len({_SPLIT.format(c='text')}), 0)::INTEGER AS n_tags FROM documents LEFT JOIN b USING (doc_id)""")
def language_guess(spark, d):
    """The language of each document by its common words, and a tag for each token"""
    lexicon = spark.createDataFrame([("school", "NN"), ("the", "DT")], "form string, pos string")
    got = T.preprocessed(_docs(spark, d), "text", lexicon, table(spark, d, "common_words"), T.Analyser())
    return got.select("doc_id", "lang", F.size("pos_tags").alias("n_tags"))


@query("process_count", f"SELECT doc_id, coalesce(len({_SPLIT.format(c='text')}), 0)::INTEGER AS num_tokens FROM documents")
def process_count(spark, d):
    """T11"""
    return _docs(spark, d).select("doc_id", F.size(T.tokens(F.col("text"))).alias("num_tokens"))


@query("query_words", f"WITH {Q} SELECT qid, word, count(*) AS n FROM (SELECT qid, unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS word FROM qs) GROUP BY ALL")
def query_words(spark, d):
    """S3, T12"""
    return _queries(spark, d).select("qid", F.explode(T.words(F.col("text"))).alias("word")).groupBy("qid", "word").agg(F.count(F.lit(1)).alias("n"))


@query("load_queries", f"WITH {Q} SELECT qid, text FROM qs")
def load_queries(spark, d):
    """S3"""
    return _queries(spark, d)


_QRELS = """qr AS (SELECT query_id AS qid, doc_id, relevance AS rel FROM qrels WHERE query_id IS NOT NULL AND doc_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY judged_at DESC NULLS LAST, relevance DESC NULLS LAST) = 1)"""


@query("load_qrels", f"WITH {_QRELS} SELECT * FROM qr")
def load_qrels(spark, d):
    """S4"""
    return corpus.read_qrels(table(spark, d, "qrels"))


@query("readiness", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'queries', count(*) FROM queries UNION ALL SELECT 'qrels', count(*) FROM qrels")
def readiness(spark, d):
    """S2, S14"""
    return corpus.readiness({n: table(spark, d, n) for n in ("documents", "queries", "qrels")})


@query("index_postings", f"WITH {IX} SELECT term, doc_id, tf FROM pst")
def index_postings(spark, d):
    """I1"""
    return _index(spark, d).postings.select("term", "doc_id", "tf")


@query("index_docs", f"WITH {IX} SELECT doc_id, length, round(tfidf_norm, 6) AS tfidf_norm FROM nrm")
def index_docs(spark, d):
    """I2, I5"""
    return _index(spark, d).docs.select("doc_id", "length", F.round("tfidf_norm", 6).alias("tfidf_norm"))


@query("index_terms", f"WITH {IX} SELECT term, df, round(idf, 6) AS idf FROM terms WHERE df >= 2")
def index_terms(spark, d):
    """I3, I4, I12"""
    return _index(spark, d).terms.where("df >= 2").select("term", "df", F.round("idf", 6).alias("idf"))


@query("index_meta", f"WITH {IX} SELECT num_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM terms) AS total_terms FROM meta")
def index_meta(spark, d):
    """I6, I13, S12"""
    return _index(spark, d).meta.select("num_docs", F.round("avgdl", 6).alias("avgdl"), "total_terms")


@query("index_token_docs", f"""WITH {CURRENT_SQL}, p AS (SELECT doc_rowid AS doc_id, unnest(tokens) AS term FROM cur)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p WHERE term IS NOT NULL GROUP BY term""")
def index_token_docs(spark, d):
    """I1, I3 over the stored tokens of current docs"""
    docs = current_docs(table(spark, d, "docs"), "raw_text", "tokens")
    return build_index(docs, F.col("tokens"), "doc_rowid").postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("vocab_prefix", f"WITH {IX} SELECT term, df FROM terms WHERE starts_with(term, 'pr') ORDER BY df DESC, term LIMIT 20")
def vocab_prefix(spark, d):
    """A top-k report"""
    return vocabulary(_index(spark, d), "pr").select("term", "df")


@query("term_lookup", f"WITH {IX} SELECT t.term, coalesce(df, 0) AS df, round(coalesce(idf, 0), 6) AS idf FROM (SELECT unnest({PROBE}) AS term) t LEFT JOIN terms USING (term)")
def term_lookup(spark, d):
    """I7"""
    return lookup(_index(spark, d), spark.createDataFrame([(t,) for t in PROBE], "term string")).select("term", "df", F.round("idf", 6).alias("idf"))


@query("postings_lookup", f"WITH {IX} SELECT term, doc_id, tf, length, round(tfidf_norm, 6) AS tfidf_norm FROM pst JOIN nrm USING (doc_id) WHERE term IN ({', '.join(map(repr, PROBE))})")
def postings_lookup(spark, d):
    """I8"""
    return postings_of(_index(spark, d), spark.createDataFrame([(t,) for t in PROBE], "term string")).withColumn("tfidf_norm", F.round("tfidf_norm", 6))


@query("docs_by_id", "SELECT doc_id, coalesce(text, '') AS raw_text FROM documents WHERE doc_id IN (0, 3, 77, 500, -5)")
def docs_by_ids(spark, d):
    """I9"""
    return docs_by_id(_index(spark, d), spark.createDataFrame([(i,) for i in (0, 3, 77, 500, -5)], "doc_id long"))


@query("tfidf_weights", f"WITH {IX}, {QT}, {_TFIDF} SELECT qid, term, round(weight, 6) AS weight FROM w")
def tfidf_weights(spark, d):
    """L1"""
    return lexical.tfidf_weights(_index(spark, d), _asked(spark, d)).select("qid", "term", F.round("weight", 6).alias("weight"))


@query("tfidf_topk", f"WITH {IX}, {QT}, {_TFIDF} {_ranked('tfs')}")
def tfidf_topk(spark, d):
    """L2"""
    return lexical.search(_index(spark, d), _asked(spark, d), "tfidf")


@query("bm25_topk", f"WITH {IX}, {QT}, s AS ({_bm25_sql('qt')}) {_ranked('s')}")
def bm25_topk(spark, d):
    """L3, L4"""
    return lexical.search(_index(spark, d), _asked(spark, d))


_GRID = [(1.5, 0.75), (0.0, 0.75), (1.5, 0.0), (1.5, 1.0), (3.0, 0.5)]


@query("bm25_params", f"""WITH {IX}, {QT}, g AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}::DOUBLE, {b}::DOUBLE)' for i, (a, b) in enumerate(_GRID))}) t(no, k1, b)),
qg AS (SELECT qid || '/' || no AS qid, term, k1, b FROM qt, g), s AS ({_bm25_sql('qg', 'k1', 'b')}) {_ranked('s')}""")
def bm25_params(spark, d):
    """L4: a grid of k1 and b, all in one job"""
    grid = F.explode(F.array(*[F.struct(F.lit(str(i)).alias("no"), F.lit(a).alias("k1"), F.lit(b).alias("b")) for i, (a, b) in enumerate(_GRID)]))
    asked = _asked(spark, d).withColumn("g", grid).select(F.concat("qid", F.lit("/"), "g.no").alias("qid"), "tokens", "g.k1", "g.b")
    return lexical.search(_index(spark, d), asked)


@query("bm25_weighted", f"""WITH {IX}, {QT}, qe AS (SELECT DISTINCT qid, term, CASE WHEN term IN ('school', 'public', 'tax') THEN 0.4 ELSE 1.0 END AS mult FROM (
  SELECT qid, term FROM qt UNION ALL SELECT qid, unnest(['school', 'public', 'tax']) FROM qs)), s AS ({_bm25_sql('qe', mult='mult')}) {_ranked('s')}""")
def bm25_weighted(spark, d):
    """L5"""
    extra = F.array(*map(F.lit, ("school", "public", "tax")))
    asked = _asked(spark, d).select("qid", F.concat("tokens", extra).alias("tokens"), extra.alias("exp_terms"), F.lit(0.4).alias("exp_weight"))
    return lexical.search(_index(spark, d), asked)


@query("bm25_rescore", f"WITH {IX}, {QT}, {_TFIDF}, c AS ({_ranked('tfs', 20)}), s AS ({_bm25_sql('qt')}) SELECT s.qid, s.doc_id, s.score, row_number() OVER (PARTITION BY s.qid ORDER BY s.score DESC, s.doc_id)::INTEGER AS rank FROM s JOIN c USING (qid, doc_id)")
def bm25_rescore(spark, d):
    """The first 20 of TF-IDF scored by BM25"""
    ix, asked = _index(spark, d), _asked(spark, d)
    return lexical.rescore(ix, asked, lexical.search(ix, asked, "tfidf", 20))


@query("tfidf_rescore", f"WITH {IX}, {QT}, {_TFIDF}, s AS ({_bm25_sql('qt')}), c AS ({_ranked('s', 20)}) SELECT t.qid, t.doc_id, t.score, row_number() OVER (PARTITION BY t.qid ORDER BY t.score DESC, t.doc_id)::INTEGER AS rank FROM tfs t JOIN c USING (qid, doc_id)")
def tfidf_rescore(spark, d):
    """The first 20 of BM25 scored by TF-IDF"""
    ix, asked = _index(spark, d), _asked(spark, d)
    return lexical.rescore(ix, asked, lexical.search(ix, asked, "bm25", 20), "tfidf")


_SAFE = "CASE WHEN length(text) > 600 THEN text[1:600] || '…' ELSE text END"
for _a, _b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
    _SAFE = f"replace({_SAFE}, '{_a}', '{_b}')"


@query("search_with_text", f"WITH {IX}, {QT}, s AS ({_bm25_sql('qt')}), r AS ({_ranked('s')}) SELECT qid, doc_id, rank, replace({_SAFE}, chr(10), '<br>') AS snippet FROM r JOIN documents USING (doc_id)")
def search_with_text(spark, d):
    """L8, T14"""
    ix = _index(spark, d)
    return lexical.with_text(ix, lexical.search(ix, _asked(spark, d))).select("qid", "doc_id", "rank", T.snippet(F.col("raw_text")).alias("snippet"))


# The escaping as single private characters, so that no word is found inside an entity or tag; put in after the marks.
_BARE = "CASE WHEN length(text) > 600 THEN text[1:600] || '…' ELSE text END"
_ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;"), ("\n", "<br>")]
for _i, (_a, _b) in enumerate(_ENTITIES):
    _BARE = f"replace({_BARE}, {'chr(10)' if _a == chr(10) else repr(_a) if _a != chr(39) * 2 else chr(39) * 4}, chr({0xE000 + _i}))"
_MARKED = "CASE WHEN len(ws) > 0 THEN regexp_replace(bare, '(?i)\\b(' || array_to_string(ws, '|') || ')\\b', '<mark>\\1</mark>', 'g') ELSE bare END"
for _i, (_a, _b) in enumerate(_ENTITIES):
    _MARKED = f"replace({_MARKED}, chr({0xE000 + _i}), '{_b}')"


@query("highlights", f"""WITH {IX}, {QT}, s AS ({_bm25_sql('qt')}), r AS ({_ranked('s')}),
h AS (SELECT r.*, {_BARE} AS bare, list_sort(list_distinct(list_filter(regexp_extract_all(q.text, '[a-zA-Z]+'), lambda w: length(w) >= 2))) AS w0 FROM r JOIN documents USING (doc_id) JOIN (SELECT qid, text AS qtext FROM qs) q0 USING (qid) JOIN (SELECT qid, text FROM qs) q USING (qid)),
l AS (SELECT *, list_transform(list_sort(list_transform(w0, lambda w: struct_pack(l := -length(w), w := w))), lambda x: x.w) AS ws FROM h)
SELECT qid, doc_id, rank, {_MARKED} AS snippet FROM l""".replace("documents USING (doc_id)", "documents d USING (doc_id)").replace(_BARE, _BARE.replace("text", "d.text")))
def highlights(spark, d):
    """Snippets with the query's words marked"""
    ix, asked = _index(spark, d), _asked(spark, d)
    hits = lexical.with_text(ix, lexical.search(ix, asked).join(asked.select("qid", "text"), "qid"))  # texts of documents are joined last
    none = F.array().cast("array<string>")
    terms = T.highlight_terms(F.col("text"), none, F.map_from_arrays(none, none))
    return hits.select("qid", "doc_id", "rank", T.highlighted(T.snippet(F.col("raw_text")), terms).alias("snippet"))


@query("score_bar", f"WITH {IX}, {QT}, s AS ({_bm25_sql('qt')}), r AS ({_ranked('s')}) SELECT qid, doc_id, round(greatest(2, least(100, abs(score) / max(abs(score)) OVER (PARTITION BY qid) * 100)), 4) AS bar FROM r")
def score_bar(spark, d):
    """T16"""
    from pyspark.sql import Window

    run = lexical.search(_index(spark, d), _asked(spark, d))
    return run.select("qid", "doc_id", F.round(T.score_bar(F.col("score"), F.max(F.abs("score")).over(Window.partitionBy("qid"))), 4).alias("bar"))


def _embeddings(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")


@query("vectors_norm", "SELECT vec_id, i::INTEGER AS i, round((embedding::DOUBLE[])[i + 1] / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS x FROM (SELECT *, unnest(range(0, len(embedding))) AS i FROM embeddings)")
def vectors_norm(spark, d):
    """V5, S7"""
    rows = _embeddings(spark, d).select(F.col("doc_id").alias("vec_id"), F.posexplode(dense.normalised(F.col("vec"))).alias("i", "x"))
    return rows.select("vec_id", "i", F.round("x", 6).alias("x"))


@query("vector_store", "SELECT vec_id AS doc_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 3) AS unit, 64 AS dim, (SELECT count(*) FROM embeddings) AS n FROM embeddings")
def vector_store(spark, d):
    """The store of embeddings, written and opened; the supplied vectors are of unit length already"""
    path = f"{session.scratch(spark)}/store"
    vectors.write_store(_embeddings(spark, d), path, "embeddings")
    store = vectors.open_store(spark, path)
    return store.vectors.select("doc_id", F.round(dense.norm(F.col("vec")), 3).alias("unit"), F.lit(store.dim).alias("dim"), F.lit(store.n).alias("n"))


@query("dense_topk", f"WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) {_ranked('s')}")
def dense_topk(spark, d):
    """V6: every vector with an id divisible by 20 against all"""
    v = _embeddings(spark, d)
    return dense.exact_top_k(v, v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "vec"), exclude_self=True)


@query("dense_rescore", "WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.label = b.label) " + _ranked("s", None))
def dense_rescore(spark, d):
    """V7: candidates with the query's label, and one unknown id"""
    v = _embeddings(spark, d)
    asked = v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "vec", "label")
    cands = asked.select("qid", "label").join(v.select("doc_id", "label"), "label").select("qid", "doc_id").unionByName(asked.select("qid", F.lit(-1).cast("long").alias("doc_id")))
    return dense.rescore(v, asked, cands)


_USABLE = "vec is not null and size(vec) > 0 and size(vec) = dim and vec_row is not null and model is not null and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0)"


@query("multilingual_topk", f"""WITH u AS (SELECT model, vec_row, max(vec)::DOUBLE[] AS v FROM vectors
  WHERE vec IS NOT NULL AND len(vec) = dim AND len(vec) > 0 AND vec_row IS NOT NULL AND model IS NOT NULL
    AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY model, vec_row),
s AS (SELECT a.model, a.vec_row AS qid, b.vec_row AS doc_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM u a JOIN u b ON a.model = b.model AND len(a.v) = len(b.v) AND a.vec_row % 20 = 0 AND a.vec_row <> b.vec_row)
SELECT model, qid, doc_id, score, row_number() OVER (PARTITION BY model, qid ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= 10""")
def multilingual_topk(spark, d):
    """The same search over each store of vectors: rows with an id divisible by 20 against all of their model, for every model"""
    rows = materialize(table(spark, d, "vectors").where(_USABLE).groupBy("model", F.col("vec_row").alias("doc_id")).agg(F.max("vec").alias("vec")), "stores")
    out = None
    for model in sorted(r[0] for r in rows.select("model").distinct().collect()):
        store = rows.where(F.col("model") == model).select("doc_id", "vec")
        run = dense.exact_top_k(store, store.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "vec"), exclude_self=True).select(F.lit(model).alias("model"), "*")
        out = run if out is None else out.unionByName(run)
    return out if out is not None else spark.createDataFrame([], "model string, qid long, doc_id long, score double, rank int")


def _word_vector(term, dim: int = 8):
    return F.array(*[(F.conv(F.substring(F.md5(term), 1 + 2 * i, 2), 16, 10).cast("double") - 127.5) / 127.5 for i in range(dim)])


@query("mean_pool", f"""WITH {IX}, wv AS (SELECT term, list_transform(range(0, 8), lambda i: (('0x' || md5(term)[1 + 2 * i:2 + 2 * i])::INTEGER - 127.5) / 127.5) AS v FROM terms),
u AS (SELECT term, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM wv),
e AS (SELECT doc_id, tf, v, unnest(range(0, 8)) AS i FROM pst JOIN u USING (term)), m AS (SELECT doc_id, i, sum(v[i + 1] * tf) / sum(tf) AS value FROM e GROUP BY ALL)
SELECT doc_id, i::INTEGER AS i, round(coalesce(value, 0), 6) AS value FROM (SELECT doc_id, unnest(range(0, 8)) AS i FROM documents) LEFT JOIN m USING (doc_id, i)""")
def mean_pool(spark, d):
    """V2 with word vectors made from md5; documents without words have zeros"""
    toks = _docs(spark, d).select("doc_id", F.explode_outer(T.tokens(F.col("text"))).alias("term"))
    wv = toks.where("term is not null").select("term").distinct().select("term", _word_vector(F.col("term")).alias("vec"))
    return dense.mean_vectors(toks, wv).select("doc_id", F.posexplode("vec").alias("i", "value")).withColumn("value", F.round("value", 6))


@query("window_pairs", f"""WITH t AS (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM (SELECT doc_id, {_SPLIT.format(c='text')} AS toks FROM documents))
SELECT toks[i] AS center, toks[i + o] AS context, count(*) AS n FROM t, (SELECT unnest([-5, -4, -3, -2, -1, 1, 2, 3, 4, 5]) AS o) WHERE i + o BETWEEN 1 AND len(toks) GROUP BY ALL""")
def window_pairs(spark, d):
    """V11"""
    pairs = dense.window_pairs(_docs(spark, d).select("doc_id", T.tokens(F.col("text")).alias("tokens")))
    return pairs.groupBy("center", "context").agg(F.count(F.lit(1)).alias("n"))


@query("sampling_shares", f"WITH {TOK}, v AS (SELECT term, count(*) AS n FROM tok GROUP BY term HAVING count(*) >= 2) SELECT term, round(n ** 0.75 / (SELECT sum(n ** 0.75) FROM v), 9) AS share FROM v")
def sampling_shares(spark, d):
    """V9, V10"""
    vocabulary = dense.training_vocabulary(_docs(spark, d).select(T.tokens(F.col("text")).alias("tokens")), most=None)
    return dense.sampling_shares(vocabulary).select("term", F.round("share", 9).alias("share"))


@query("word2vec_similar")
def word2vec_similar(spark, d):
    """Trained on the documents' tokens"""
    model = dense.train_word2vec(_docs(spark, d).select(T.tokens(F.col("text")).alias("tokens")))
    return dense.most_similar(dense.word_vectors(model), spark.createDataFrame([(t,) for t in PROBE], "term string"), 5)


def _scored(spark, d) -> DataFrame:
    """The scored lists of search_results: the latest row of each pair, models in lower case, ranked by score."""
    rows = table(spark, d, "search_results").where("query_id is not null and doc_id is not null and components is not null")
    last = rows.groupBy(F.col("query_id").alias("qid"), "doc_id").agg(F.max(F.struct(known_time("run_at").alias("at"), F.array_sort(F.map_entries("components")).alias("e"))).alias("v"))
    long = last.select("qid", "doc_id", F.explode("v.e").alias("e")).select("qid", "doc_id", F.lower("e.key").alias("model"), F.col("e.value").alias("score"))
    long = long.where("score is not null and not isnan(score)").groupBy("qid", "model", "doc_id").agg(F.max("score").alias("score"))
    heavy = heavy_keys(rows, "query_id")  # a query with many of the rows is ranked in ranges
    return ranked_within(long, ["qid", "model"], [F.col("score").desc(), F.col("doc_id")], "rank", "qid", heavy, unique=True).withColumn("rank", F.col("rank").cast("int"))


_SCORED = """latest AS (SELECT * FROM search_results WHERE query_id IS NOT NULL AND doc_id IS NOT NULL AND components IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY run_at DESC NULLS LAST) = 1),
ent AS (SELECT query_id AS qid, doc_id, unnest(map_entries(components)) AS x FROM latest),
sc0 AS (SELECT qid, lower(x.key) AS model, doc_id, max(x.value) AS score FROM ent WHERE x.value IS NOT NULL AND NOT isnan(x.value) GROUP BY ALL),
sc AS (SELECT *, row_number() OVER (PARTITION BY qid, model ORDER BY score DESC, doc_id) AS r, min(score) OVER (PARTITION BY qid, model) AS lo, max(score) OVER (PARTITION BY qid, model) AS hi FROM sc0),
mm AS (SELECT *, CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END AS unit FROM sc)"""
_WEIGHTS = {"bm25": 0.5, "bert": 0.3}


@query("minmax_norm", f"WITH {_SCORED} SELECT qid, model, doc_id, round(unit, 6) AS unit FROM mm")
def minmax_norm(spark, d):
    """H1"""
    return _scored(spark, d).select("qid", "model", "doc_id", F.round(hybrid.minmax(F.col("score"), "qid", "model"), 6).alias("unit"))


def _flat(run: DataFrame, name: str) -> DataFrame:
    return run.withColumn(name, F.round(F.element_at("components", name), 6)).drop("components")


@query("fuse_weighted", f"""WITH {_SCORED}, f AS (SELECT qid, doc_id, round(sum(CASE model WHEN 'bm25' THEN 0.5 WHEN 'bert' THEN 0.3 ELSE 1 END * unit), 6) AS score,
  round(max(CASE WHEN model = 'bm25' THEN score END), 6) AS bm25 FROM mm GROUP BY ALL) {_ranked('f', cols=', bm25')}""")
def fuse_weighted(spark, d):
    """H2, H4"""
    return _flat(hybrid.fuse_weighted(_scored(spark, d), _WEIGHTS), "bm25")


@query("fuse_rrf", f"""WITH {_SCORED}, f AS (SELECT qid, doc_id, round(sum(CASE model WHEN 'bm25' THEN 0.5 WHEN 'bert' THEN 0.3 ELSE 1 END / (60 + r)), 6) AS score,
  max(CASE WHEN model = 'bm25' THEN r END)::DOUBLE AS bm25_rank FROM sc GROUP BY ALL) {_ranked('f', cols=', bm25_rank')}""")
def fuse_rrf(spark, d):
    """H3, H4"""
    return _flat(hybrid.fuse_rrf(_scored(spark, d), _WEIGHTS), "bm25_rank")


_LIKE = f"""{IX}, dq AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
qt AS (SELECT t.doc_id AS qid, term, count(*) AS qtf FROM tok t JOIN dq ON dq.qid = t.doc_id GROUP BY ALL), s AS ({_bm25_sql('qt')}), rl AS ({_ranked('s', 100)}),
ds AS (SELECT dq.qid, e.vec_id AS doc_id, round(list_cosine_similarity(dq.v, e.embedding::DOUBLE[]), 6) AS score FROM dq, embeddings e), rd AS ({_ranked('ds', 100)}),
both_ AS (SELECT qid, 'bm25' AS model, doc_id, score FROM rl UNION ALL SELECT qid, 'dense', doc_id, score FROM rd),
mm AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS unit FROM both_ WINDOW w AS (PARTITION BY qid, model)),
f AS (SELECT qid, doc_id, round(sum(CASE model WHEN 'bm25' THEN 0.6 ELSE 0.4 END * unit), 6) AS score FROM mm GROUP BY ALL)"""


@query("fuse_dense", f"WITH {_LIKE} {_ranked('f')}")
def fuse_dense(spark, d):
    """H2: documents like a document, by BM25 and by vectors, which some documents lack; queries are the vectors with an id divisible by 20"""
    ix, v = _index(spark, d), _embeddings(spark, d).select("doc_id", "vec")
    asked = v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "vec")
    texts = _docs(spark, d).join(asked.select(F.col("qid").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("qid"), T.tokens(F.col("text")).alias("tokens"))
    lists = hybrid.union_runs({"bm25": lexical.search(ix, texts, k=100), "dense": dense.exact_top_k(v, asked, 100)})
    return hybrid.fuse_weighted(lists, {"bm25": 0.6, "dense": 0.4}).drop("components")


@query("serial_rerank", f"""WITH {_SCORED}, one AS (SELECT qid, doc_id, score AS s1, unit AS n1 FROM mm WHERE model = 'bm25'),
two0 AS (SELECT qid, doc_id, score AS s2 FROM sc JOIN one USING (qid, doc_id) WHERE model = 'bert'),
two AS (SELECT *, CASE WHEN max(s2) OVER w = min(s2) OVER w THEN 1 ELSE (s2 - min(s2) OVER w) / (max(s2) OVER w - min(s2) OVER w) END AS n2 FROM two0 WINDOW w AS (PARTITION BY qid)),
f AS (SELECT qid, doc_id, round(coalesce(n2, 0) + 0.001 * n1, 6) AS score FROM one LEFT JOIN two USING (qid, doc_id)) {_ranked('f')}""")
def serial_rerank(spark, d):
    """H5: bm25 candidates reranked by bert, which lacks some of them"""
    scored = _scored(spark, d)
    return hybrid.serial(scored.where("model = 'bm25'"), scored.where("model = 'bert'")).drop("components")


_RUN = """run0 AS (SELECT query_id AS qid, doc_id, score FROM search_results WHERE query_id IS NOT NULL AND doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
  QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY run_at DESC NULLS LAST, score DESC) = 1),
run AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM run0)"""
_EVAL = """j AS (SELECT run.*, coalesce(rel, 0) AS rel, (coalesce(rel, 0) > 0)::INT AS hit FROM {run} run LEFT JOIN qr USING (qid, doc_id)),
h AS (SELECT *, sum(hit) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM j),
g AS (SELECT qid, sum(CASE WHEN rank <= 10 THEN hit ELSE 0 END) AS top_hits, sum(hit) AS all_hits, sum(CASE WHEN hit = 1 THEN hits / rank ELSE 0 END) AS precisions,
  sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) AS dcg FROM h GROUP BY qid),
i0 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS i FROM qr WHERE rel > 0),
i1 AS (SELECT qid, count(*) AS relevant, sum(CASE WHEN i <= 10 THEN rel / log2(i + 1) ELSE 0 END) AS ideal FROM i0 GROUP BY qid),
pq AS (SELECT qid, coalesce(top_hits, 0) / 10 AS p, coalesce(all_hits / relevant, 0) AS recall, coalesce(precisions / relevant, 0) AS ap, coalesce(CASE WHEN ideal > 0 THEN dcg / ideal END, 0) AS ndcg
  FROM (SELECT DISTINCT qid FROM qr) LEFT JOIN g USING (qid) LEFT JOIN i1 USING (qid))"""


def _run(spark, d) -> DataFrame:
    rows = table(spark, d, "search_results").where("query_id is not null and doc_id is not null and score is not null and not isnan(score)")
    last = rows.groupBy(F.col("query_id").alias("qid"), "doc_id").agg(F.max(F.struct(known_time("run_at").alias("at"), "score")).alias("v")).select("qid", "doc_id", F.col("v.score").alias("score"))
    heavy = heavy_keys(rows, "query_id")
    return ranked_within(last, ["qid"], [F.col("score").desc(), F.col("doc_id")], "rank", "qid", heavy, unique=True).withColumn("rank", F.col("rank").cast("int"))


@query("eval_per_query", f"WITH {_QRELS}, {_RUN}, {_EVAL.format(run='run')} SELECT qid, round(p, 6) AS p, round(recall, 6) AS recall, round(ap, 6) AS ap, round(ndcg, 6) AS ndcg FROM pq")
def eval_per_query(spark, d):
    """E1-E6"""
    rows = metrics.per_query(_run(spark, d), corpus.read_qrels(table(spark, d, "qrels")))
    return rows.select("qid", *[F.round(c, 6).alias(c) for c in ("p", "recall", "ap", "ndcg")])


_AGG = "SELECT round(round(avg(ap), 9), 4) AS map, round(round(avg(recall), 9), 4) AS recall, round(round(avg(p), 9), 4) AS p_at_k, round(round(avg(ndcg), 9), 4) AS ndcg_at_k, count(*) AS num_queries FROM pq"


@query("eval_aggregate", f"WITH {_QRELS}, {_RUN}, {_EVAL.format(run='run')} {_AGG}")
def eval_aggregate(spark, d):
    """E7, E8"""
    return metrics.aggregate(metrics.per_query(_run(spark, d), corpus.read_qrels(table(spark, d, "qrels"))))


_PARTS = " UNION ALL ".join(f"SELECT '{m}' AS model, * FROM (WITH one AS (SELECT qid, doc_id, r AS rank FROM sc WHERE model = '{m}'), {_EVAL.format(run='one')} {_AGG})" for m in ("bm25", "tfidf", "bert", "word2vec", "multilingual"))


@query("eval_models", f"WITH {_QRELS}, {_SCORED} {_PARTS}")
def eval_models(spark, d):
    """One row per model of the scored lists"""
    scored, qrels = materialize(_scored(spark, d), "scored"), corpus.read_qrels(table(spark, d, "qrels"))
    out = None
    for m in ("bm25", "tfidf", "bert", "word2vec", "multilingual"):
        one = metrics.aggregate(metrics.per_query(scored.where(F.col("model") == m), qrels)).select(F.lit(m).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("eval_compare", f"""WITH {_QRELS}, {_SCORED}, bm AS (SELECT qid, doc_id, r AS rank FROM sc WHERE model = 'bm25'), te AS (SELECT qid, doc_id, r AS rank FROM sc WHERE model = 'bert'),
x AS (SELECT * FROM (WITH {_EVAL.format(run='bm')} {_AGG})), y AS (SELECT * FROM (WITH {_EVAL.format(run='te')} {_AGG}))
SELECT m AS measure, CASE m WHEN 'map' THEN x.map WHEN 'recall' THEN x.recall WHEN 'p_at_k' THEN x.p_at_k ELSE x.ndcg_at_k END AS before,
  CASE m WHEN 'map' THEN y.map WHEN 'recall' THEN y.recall WHEN 'p_at_k' THEN y.p_at_k ELSE y.ndcg_at_k END AS after, round(after - before, 4) AS delta
FROM x, y, (SELECT unnest(['map', 'recall', 'p_at_k', 'ndcg_at_k']) AS m)""")
def eval_compare(spark, d):
    """bm25 before, bert after"""
    scored, qrels = materialize(_scored(spark, d), "scored"), corpus.read_qrels(table(spark, d, "qrels"))
    side = lambda m: metrics.aggregate(metrics.per_query(scored.where(F.col("model") == m), qrels))
    return metrics.compare(side("bm25"), side("bert"))


@query("eval_change", f"""WITH {_QRELS}, {_SCORED}, bm AS (SELECT qid, doc_id, r AS rank FROM sc WHERE model = 'bm25'), te AS (SELECT qid, doc_id, r AS rank FROM sc WHERE model = 'bert'),
x AS (SELECT * FROM (WITH {_EVAL.format(run='bm')} {_AGG})), y AS (SELECT * FROM (WITH {_EVAL.format(run='te')} {_AGG}))
SELECT m AS measure, CASE WHEN a = 0 THEN 0 ELSE round((b - a) / a * 100, 4) END AS percent FROM (
  SELECT m, CASE m WHEN 'map' THEN x.map WHEN 'recall' THEN x.recall WHEN 'p_at_k' THEN x.p_at_k ELSE x.ndcg_at_k END AS a,
    CASE m WHEN 'map' THEN y.map WHEN 'recall' THEN y.recall WHEN 'p_at_k' THEN y.p_at_k ELSE y.ndcg_at_k END AS b FROM x, y, (SELECT unnest(['map', 'recall', 'p_at_k', 'ndcg_at_k']) AS m))""")
def eval_change(spark, d):
    """The change from bm25 to bert in percent"""
    return eval_compare(spark, d).select("measure", F.round(T.percent_change(F.col("before"), F.col("after")), 4).alias("percent"))


def _dictionary(ix: Index) -> DataFrame:
    return ix.terms.where("df >= 5 and term rlike '^[a-z]+$'").select(F.col("term").alias("word"))


_SPELL = f"""WITH {IX}, {Q}, dict AS (SELECT term AS word, df FROM terms WHERE df >= 5 AND regexp_full_match(term, '[a-z]+')),
ask AS (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS w FROM qs)),
open AS (SELECT word FROM ask WHERE length(word) > 3 AND word NOT IN (SELECT word FROM dict) AND word NOT IN (SELECT term FROM terms)),
near AS (SELECT o.word, d.word AS cand, d.df, damerau_levenshtein(o.word, d.word) AS dist FROM open o JOIN dict d ON abs(length(o.word) - length(d.word)) <= 2),
fx AS (SELECT word, cand AS best FROM near WHERE dist <= 2 QUALIFY row_number() OVER (PARTITION BY word ORDER BY dist, df DESC, cand) = 1)"""
_CORRECTED = """fm AS (SELECT coalesce(map_from_entries(list((word, best))), MAP {'': ''}) AS m FROM fx),
pt AS (SELECT qid, text, list_transform(regexp_extract_all(text, '[a-zA-Z]+|[^a-zA-Z]+'), lambda p: struct_pack(p := p, b := CASE WHEN m[lower(p)] <> lower(p) THEN m[lower(p)] END)) AS ps FROM qs, fm),
cq AS (SELECT qid, text, array_to_string(list_transform(ps, lambda x: coalesce(x.b, x.p)), '') AS corrected, len(list_distinct(list_filter(ps, lambda x: x.b IS NOT NULL)))::INTEGER AS n FROM pt)"""


@query("spell_candidates", f"{_SPELL} SELECT word, cand, dist::INTEGER AS d FROM near WHERE dist <= 2")
def spell_candidates(spark, d):
    """T13"""
    ix = _index(spark, d)
    return refine.candidates(_queries(spark, d).select(F.explode(T.words(F.col("text"))).alias("word")), _dictionary(ix), ix.terms)


@query("spell_best", f"{_SPELL} SELECT * FROM fx")
def spell_best(spark, d):
    """T13, R1"""
    ix = _index(spark, d)
    asked = _queries(spark, d).select(F.explode(T.words(F.col("text"))).alias("word"))
    return refine.corrections(asked, _dictionary(ix), ix.terms)


@query("spell_queries", f"{_SPELL}, {_CORRECTED} SELECT qid, text, corrected, n FROM cq")
def spell_queries(spark, d):
    """R2"""
    ix, qs = _index(spark, d), _queries(spark, d)
    fixes = refine.corrections(qs.select(F.explode(T.words(F.col("text"))).alias("word")), _dictionary(ix), ix.terms)
    return refine.correct_queries(qs, fixes).select("qid", "text", "corrected", F.size("corrections").alias("n"))


def _synonyms(spark) -> DataFrame:
    return spark.createDataFrame(SYNONYMS, "word string, sense int, pos int, lemma string")


def _expand_sql(source: str) -> str:
    """CTE ex (qid, e): the synonyms taken for the texts of ``source`` (qid, text)."""
    rows = ", ".join(repr(r) for r in SYNONYMS)
    return f"""syn AS (SELECT * FROM (VALUES {rows}) t(word, sense, pos, lemma) QUALIFY sense = min(sense) OVER (PARTITION BY word)),
sw AS (SELECT qid, text, unnest(range(1, len(ws) + 1)) AS wno, ws FROM (SELECT qid, text, list_transform(regexp_extract_all(text, '[a-zA-Z]+'), lambda x: lower(x)) AS ws FROM {source})),
sc1 AS (SELECT qid, wno, pos AS no, replace(lower(lemma), '_', ' ') AS cand, word FROM sw JOIN syn ON syn.word = ws[wno]),
sl AS (SELECT qid, list_sort(list(struct_pack(wno := wno, no := no, cand := cand))) AS c FROM sc1 WHERE NOT contains(cand, ' ') AND cand <> word AND cand IN (SELECT term FROM terms) GROUP BY qid),
ex AS (SELECT qid, list_transform(list_reduce(c, lambda t, x: CASE WHEN list_contains(own, x.cand) OR len(list_filter(t, lambda y: y.cand = x.cand OR y.wno = x.wno)) > 0 THEN t ELSE list_append(t, x) END, list_slice(c, 1, 0)), lambda y: y.cand) AS e
  FROM sl JOIN (SELECT qid, {_SPLIT.format(c='text')} AS own FROM {source}) USING (qid))"""


@query("synonym_expand", f"WITH {IX}, {Q}, {_expand_sql('qs')} SELECT qid, array_to_string(e, ' ') AS expansions FROM ex")
def synonym_expand(spark, d):
    """R3"""
    return refine.expand(_queries(spark, d), _synonyms(spark), _index(spark, d).terms).select("qid", F.array_join("expansions", " ").alias("expansions"))


def _history(spark, qs: DataFrame) -> DataFrame:
    """The same past queries for every query."""
    return qs.select("qid", F.posexplode(F.array(*map(F.lit, HISTORY))).alias("pos", "query"))


def _hist_sql(source: str) -> str:
    return f"""hist AS (SELECT (i - 1)::INTEGER AS pos, ({HISTORY})[i] AS query FROM range(1, {len(HISTORY) + 1}) t(i)),
own AS (SELECT qid, text, {_SPLIT.format(c='text')} AS own FROM {source}),
past AS (SELECT qid, text, own, pos, query, {_SPLIT.format(c='query')} AS toks FROM own, hist WHERE list_has_any(own, {_SPLIT.format(c='query')}))"""


_HIST = _hist_sql("qs")
_NEW_TERMS = """t AS (SELECT qid, own, pos, unnest(range(1, len(toks) + 1)) AS i, toks FROM past),
n AS (SELECT qid, toks[i] AS term, min(-pos * 1000 + i) AS f FROM t WHERE NOT list_contains(own, toks[i]) AND toks[i] IN (SELECT term FROM terms) GROUP BY ALL),
ht AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY f)::INTEGER AS pos, term FROM n QUALIFY pos <= 3)"""


@query("suggest", f"""WITH {IX}, {Q}, {_HIST},
lw AS (SELECT qid, text, list_transform(regexp_extract_all(text, '[a-zA-Z]+'), lambda x: lower(x)) AS ws FROM qs),
px AS (SELECT DISTINCT ws[-1] AS prefix FROM lw WHERE len(ws) > 0),
best AS (SELECT prefix, term, row_number() OVER (PARTITION BY prefix ORDER BY df DESC, term) AS rk FROM px JOIN terms ON starts_with(term, prefix) QUALIFY rk <= 5),
al AS (SELECT qid, 0 AS kind, pos AS rk, query AS suggestion FROM past WHERE lower(trim(query)) <> lower(trim(text))
  UNION ALL SELECT qid, 1, rk, s FROM (SELECT qid, text, rk, array_to_string(list_concat(ws[:-2], [term]), ' ') AS s FROM lw JOIN best ON ws[-1] = prefix) WHERE s <> lower(text)),
fi AS (SELECT qid, suggestion, min(kind * 1000000 + rk) AS f FROM al GROUP BY ALL)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY f)::INTEGER AS pos, suggestion FROM fi QUALIFY pos <= 5""")
def suggest(spark, d):
    """R4"""
    qs = _queries(spark, d)
    return refine.suggest(qs, _history(spark, qs), _index(spark, d).terms)


@query("history_terms", f"WITH {IX}, {Q}, {_HIST}, {_NEW_TERMS} SELECT * FROM ht")
def history_terms(spark, d):
    """R5"""
    qs = _queries(spark, d)
    return refine.history_terms(qs, _history(spark, qs), _index(spark, d).terms)


@query("refined_search", f"""{_SPELL}, {_CORRECTED}, cs AS (SELECT qid, corrected AS text FROM cq), {_expand_sql('cs')}, {_hist_sql('cs')}, {_NEW_TERMS},
al AS (SELECT qid, unnest({_SPLIT.format(c='text')}) AS term FROM cs UNION ALL SELECT qid, unnest(e) FROM ex UNION ALL SELECT qid, term FROM ht),
qe AS (SELECT DISTINCT al.qid, al.term, CASE WHEN list_contains(ex.e, al.term) THEN 0.4 ELSE 1.0 END AS mult FROM al LEFT JOIN ex USING (qid)),
s AS ({_bm25_sql('qe', mult='mult')}) {_ranked('s')}""")
def refined_search(spark, d):
    """BM25 with spelling, synonyms at 0.4 and history"""
    from lodestone.engine import Engine

    ix, qs = _index(spark, d), _queries(spark, d)
    return Engine(ix, dictionary=_dictionary(ix), synonyms=_synonyms(spark)).search(qs, "bm25", refine=True, history=_history(spark, qs))


_POOLS = f"{IX}, {QT}, {_TFIDF}, s AS ({_bm25_sql('qt')}), rb AS ({_ranked('s', 100)}), rt AS ({_ranked('tfs', 100)})"


@query("parallel_search", f"WITH {_POOLS}, f AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT qid, doc_id, rank FROM rb UNION ALL SELECT qid, doc_id, rank FROM rt) GROUP BY ALL) {_ranked('f')}")
def parallel_search(spark, d):
    """A1, H6, H7: BM25 and TF-IDF fused by reciprocal ranks"""
    from lodestone.engine import Engine

    return Engine(_index(spark, d)).search(_queries(spark, d), "parallel", fusion="rrf").drop("components")


@query("serial_search", f"""WITH {_POOLS}, one AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS n1 FROM rb WINDOW w AS (PARTITION BY qid)),
two AS (SELECT qid, doc_id, CASE WHEN max(t.score) OVER w = min(t.score) OVER w THEN 1 ELSE (t.score - min(t.score) OVER w) / (max(t.score) OVER w - min(t.score) OVER w) END AS n2 FROM tfs t SEMI JOIN rb USING (qid, doc_id) WINDOW w AS (PARTITION BY qid)),
f AS (SELECT qid, doc_id, round(coalesce(n2, 0) + 0.001 * n1, 6) AS score FROM one LEFT JOIN two USING (qid, doc_id)) {_ranked('f')}""")
def serial_search(spark, d):
    """A1, H8: BM25 candidates reranked by TF-IDF"""
    from lodestone.engine import Engine

    return Engine(_index(spark, d)).search(_queries(spark, d), "serial").drop("components")
