import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.functions.text import STANDARD, stemmed, tokens
from lodestone.operators import dense, hybrid, lexical, metrics, refine
from lodestone.operators.index import Index, build_index, check_unique, docs_by_id, lookup, vocabulary

DOCS = [("a", "cat dog cat"), ("b", "cat"), ("c", "bird dog cat"), ("e", ""), ("n", None), ("p", "123 !!")]


@pytest.fixture(scope="module")
def index(spark):
    return build_index(spark.createDataFrame(DOCS, "doc_id string, text string"), tokens(F.col("text")), text_col="text")


def ask(spark, *texts):
    return spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "qid int, tokens array<string>")


def as_dict(run):
    return {(r.qid, r.doc_id): r.score for r in run.collect()}


def test_index(spark, index):
    assert {r.doc_id: r.length for r in index.docs.collect()} == {"a": 3, "b": 1, "c": 3, "e": 0, "n": 0, "p": 0}
    m = index.meta.first()
    assert (m.num_docs, m.avgdl, m.total_terms) == (6, 7 / 6, 3)
    idf = {r.term: r.idf for r in index.terms.collect()}
    assert idf["cat"] == pytest.approx(math.log(6 / 3))
    norm = {r.doc_id: r.tfidf_norm for r in index.docs.collect()}
    assert norm["e"] == 0 and norm["a"] == pytest.approx(math.hypot((1 + math.log(2)) * math.log(2), math.log(3)))
    assert [r.term for r in vocabulary(index, "").collect()] == ["cat", "dog", "bird"]
    assert {r.term: r.df for r in lookup(index, spark.createDataFrame([("cat",), ("zz",)], "term string")).collect()} == {"cat": 3, "zz": 0}
    assert {r.doc_id: r.raw_text for r in docs_by_id(index, spark.createDataFrame([("n",), ("zz",)], "doc_id string")).collect()} == {"n": ""}


def test_empty_index(spark):
    ix = build_index(spark.createDataFrame([], "doc_id string, text string"), tokens(F.col("text")), text_col="text")
    assert ix.meta.first() == (0, 0.0, 0)
    assert lexical.search(ix, ask(spark, "cat")).count() == 0


def test_duplicate_ids_raise(spark):
    with pytest.raises(ValueError):
        check_unique(spark.createDataFrame([("a",), ("a",)], "doc_id string"))
    with pytest.raises(ValueError):
        check_unique(spark.createDataFrame([(None,)], "doc_id string"))
    check_unique(spark.createDataFrame([("a",), ("b",)], "doc_id string"))


def bm25(tf, df, length, n=6, avgdl=7 / 6, k1=1.5, b=0.75):
    return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))


def test_bm25(spark, index):
    got = as_dict(lexical.search(index, ask(spark, "cat cat dog zz")))
    assert got[0, "a"] == pytest.approx(bm25(2, 3, 3) + bm25(1, 2, 3), abs=1e-6)
    assert got[0, "b"] == pytest.approx(bm25(1, 3, 1), abs=1e-6)
    zero = ask(spark, "cat dog").withColumn("k1", F.lit(0.0))
    assert as_dict(lexical.search(index, zero))[0, "a"] == pytest.approx(math.log(1 + 3.5 / 3.5) + math.log(1 + 4.5 / 2.5), abs=1e-6)
    flat = ask(spark, "cat").withColumn("b", F.lit(0.0))
    assert as_dict(lexical.search(index, flat))[0, "c"] == pytest.approx(bm25(1, 3, 3, b=0), abs=1e-6)
    weighted = ask(spark, "cat dog").withColumn("exp_terms", F.array(F.lit("dog"))).withColumn("exp_weight", F.lit(0.4))
    assert as_dict(lexical.search(index, weighted))[0, "a"] == pytest.approx(bm25(2, 3, 3) + 0.4 * bm25(1, 2, 3), abs=1e-6)


def test_tfidf(spark, index):
    got = as_dict(lexical.search(index, ask(spark, "cat cat dog", "zz", "zz bird"), "tfidf"))
    cat, dog, bird = math.log(2), math.log(3), math.log(6)
    q = [(1 + math.log(2)) * cat, dog]
    d = [(1 + math.log(2)) * cat, dog]
    assert got[0, "a"] == pytest.approx((q[0] * d[0] + q[1] * d[1]) / (math.hypot(*q) * math.hypot(*d)), abs=1e-6)
    assert got[2, "c"] == pytest.approx(bird / math.sqrt(cat**2 + dog**2 + bird**2), abs=1e-6)
    assert not any(k[0] == 1 for k in got)
    everywhere = build_index(spark.createDataFrame([("a", "x"), ("b", "x x")], "doc_id string, text string"), tokens(F.col("text")))
    assert lexical.search(everywhere, ask(spark, "x"), "tfidf").count() == 0
    assert lexical.search(everywhere, ask(spark, "x")).count() == 2


def test_rescore_equals_search_on_candidates(spark, index):
    q = ask(spark, "cat dog", "bird")
    cands = spark.createDataFrame([(0, "a"), (0, "zz"), (1, "a"), (1, "c")], "qid int, doc_id string")
    for m in ("bm25", "tfidf"):
        full = as_dict(lexical.search(index, q, m))
        assert as_dict(lexical.rescore(index, q, cands, m)) == {k: v for k, v in full.items() if k in {(0, "a"), (1, "c")}}


def test_ties_by_id(spark):
    ix = build_index(spark.createDataFrame([(i, "x y") for i in "dbca"] + [("z", "q")], "doc_id string, text string"), tokens(F.col("text")))
    assert [r.doc_id for r in lexical.search(ix, ask(spark, "x"), k=3).orderBy("rank").collect()] == ["a", "b", "c"]


def test_save_and_load(spark, index, tmp_path):
    index.save(f"file://{tmp_path}/ix")
    again = Index.load(spark, f"file://{tmp_path}/ix")
    q = ask(spark, "cat dog")
    assert as_dict(lexical.search(again, q)) == as_dict(lexical.search(index, q))
    with pytest.raises(FileNotFoundError):
        Index.load(spark, f"file://{tmp_path}/none")


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, [3.0, 4.0]), (5, None), (6, [1.0])], "doc_id long, vec array<float>")
    q = spark.createDataFrame([(10, [2.0, 0.0]), (11, [0.0, 0.0]), (12, None)], "qid long, vec array<float>")
    got = [(r.doc_id, r.score) for r in dense.exact_top_k(v, q, 10).orderBy("rank").collect()]
    assert got == [(1, 1.0), (4, 0.6), (3, 0.0), (2, -1.0)]
    many = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(7)], "qid long, vec array<float>")
    assert dense.exact_top_k(v, many, 2, block=3).count() == 14
    cands = spark.createDataFrame([(10, 4), (10, 99), (10, 2)], "qid long, doc_id long")
    assert as_dict(dense.rescore(v, q, cands)) == {(10, 4): 0.6, (10, 2): -1.0}
    assert dense.exact_top_k(v.limit(0), q, 3).count() == 0


def test_mean_vectors(spark):
    toks = spark.createDataFrame([("d", "a"), ("d", "a"), ("d", "b"), ("d", "zz"), ("e", "zz"), ("n", None)], "doc_id string, term string")
    wv = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [0.0, 5.0]), ("c", None)], "term string, vec array<float>")
    got = {r.doc_id: r.vec for r in dense.mean_vectors(toks, wv).collect()}
    assert got == {"d": pytest.approx([2 / 3, 1 / 3]), "e": [0, 0], "n": [0, 0]}
    unit = {r.doc_id: r.vec for r in dense.document_vectors(toks, wv).collect()}
    assert unit["d"] == pytest.approx([2 / 5**0.5, 1 / 5**0.5]) and unit["e"] == [0, 0]
    assert dense.mean_vectors(toks, wv.limit(0)).where("size(vec) > 0").count() == 0


def test_dense_ids_of_any_type(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(700, 3)), 1)
    v = spark.createDataFrame([(f"d{i:03}", [float(c) for c in r]) for i, r in enumerate(x)] + [(None, [1.0, 1.0, 1.0])], "doc_id string, vec array<float>")
    q = v.select(F.col("doc_id").alias("qid"), "vec").where("doc_id < 'd050'")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    want = {}
    for i in range(50):
        if x[i].any():
            s = np.round(u @ u[i], 6)
            s[i] = -9
            want[f"d{i:03}"] = [f"d{j:03}" for j in sorted(range(700), key=lambda j: (-s[j], j))[:7]]
    for options in ({}, {"block": 9, "part_rows": 60}):
        got = {}
        for r in dense.exact_top_k(v, q, 7, exclude_self=True, **options).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.doc_id)
        assert got == want


def test_vector_store(spark, tmp_path):
    from lodestone.sources.vectors import load_words, open_store, save_words, write_store

    v = spark.createDataFrame([("a", [3.0, 4.0]), ("z", [0.0, 0.0]), ("n", None), (None, [1.0, 1.0]), ("q", [float("nan"), 1.0])], "doc_id string, vec array<float>")
    path = f"file://{tmp_path}/store"
    write_store(v, path, "m")
    got = open_store(spark, path)
    assert (got.model, got.dim, got.n) == ("m", 2, 2) and {r.doc_id: r.vec for r in got.vectors.collect()} == {"a": pytest.approx([0.6, 0.8]), "z": [0, 0]}
    with pytest.raises(FileNotFoundError):
        open_store(spark, f"file://{tmp_path}/none")
    for bad in ([("a", [1.0]), ("a", [2.0])], [("a", [1.0]), ("b", [1.0, 2.0])]):
        with pytest.raises(ValueError):
            write_store(spark.createDataFrame(bad, "doc_id string, vec array<float>"), f"file://{tmp_path}/bad", "m")
    write_store(v.limit(0), f"file://{tmp_path}/empty", "m")
    assert open_store(spark, f"file://{tmp_path}/empty").n == 0
    words = spark.createDataFrame([("x", [1.0, 2.0])], "term string, vec array<float>")
    save_words(words, f"file://{tmp_path}/words")
    assert load_words(spark, f"file://{tmp_path}/words").first().vec == [1.0, 2.0]


def scored(spark, rows):
    return spark.createDataFrame(rows, "qid int, model string, doc_id string, score double, rank int")


def test_fusion(spark):
    rows = [(0, "m", "a", 3.0, 1), (0, "m", "b", 1.0, 2), (0, "n", "c", 7.0, 1), (0, "n", "a", 7.0, 2)]
    got = {r.doc_id: r for r in hybrid.fuse_weighted(scored(spark, rows), {"m": 0.5}).collect()}
    assert {k: v.score for k, v in got.items()} == {"a": 1.5, "c": 1.0, "b": 0.0}
    assert got["a"].components == {"m": 3.0, "n": 7.0}
    rrf = {r.doc_id: r for r in hybrid.fuse_rrf(scored(spark, rows)).collect()}
    assert rrf["a"].score == pytest.approx(1 / 61 + 1 / 62, abs=1e-6) and rrf["a"].components == {"m_rank": 1.0, "n_rank": 2.0}


def test_serial(spark):
    one = spark.createDataFrame([(0, "a", 9.0, 1), (0, "b", 5.0, 2), (0, "c", 1.0, 3)], "qid int, doc_id string, score double, rank int")
    two = spark.createDataFrame([(0, "b", 0.9995, 1), (0, "c", 1.0, 2), (0, "zz", 9.0, 3)], "qid int, doc_id string, score double, rank int")
    got = {r.doc_id: (r.score, r.components) for r in hybrid.serial(one, two, names=("x", "y")).collect()}
    assert got["a"] == (0.001, {"x_stage1": 9.0}) and got["c"][0] == 1.0 and got["b"][0] == 0.0005 and "zz" not in got


def test_metrics_worked(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("x", "a", 1)], "qid string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "a", 2), ("q", "c", 1), ("q", "d", 1), ("q", "b", -2), ("x", "a", 0), ("h", "a", 1)], "qid string, doc_id string, rel int")
    got = {r.qid: r for r in metrics.per_query(run, qrels).collect()}
    q = got["q"]
    assert (q.p, q.recall, q.ap) == (0.2, pytest.approx(2 / 3), pytest.approx((1 + 2 / 3) / 3))
    assert q.ndcg == pytest.approx((2 - 2 / math.log2(3) + 1 / 2) / (2 + 1 / math.log2(3) + 1 / 2))
    for k in ("x", "h"):
        assert tuple(got[k])[1:] == (0, 0, 0, 0)
    agg = metrics.aggregate(metrics.per_query(run, qrels)).first()
    assert agg.num_queries == 3 and agg.p_at_k == round(0.2 / 3, 4)
    assert metrics.aggregate(metrics.per_query(run.limit(0), qrels.limit(0))).first() == (0, 0, 0, 0, 0)


def test_corrections(spark):
    asked = spark.createDataFrame([("shcool",), ("school",), ("sch",), ("condm",), ("cndm",), ("zzzzzzz",), ("uncommn",)], "word string")
    words = spark.createDataFrame([("school",), ("condom",), ("condor",), ("uncommon",)], "word string")
    df = spark.createDataFrame([("school", 5), ("condom", 2), ("condor", 9)], "term string, df long")
    assert {r.word: r.best for r in refine.corrections(asked, words, df).collect()} == {"shcool": "school", "condm": "condom", "cndm": "condom"}
    qs = spark.createDataFrame([(1, "The Shcool, condm!"), (2, "fine"), (3, "")], "qid int, text string")
    fixes = refine.corrections(qs.select(F.explode(F.split(F.lower(F.regexp_replace("text", "[^a-zA-Z ]", "")), " ")).alias("word")), words, df)
    got = {r.qid: (r.corrected, r.corrections) for r in refine.correct_queries(qs, fixes).collect()}
    assert got == {1: ("The school, condom!", {"Shcool": "school", "condm": "condom"}), 2: ("fine", {}), 3: ("", {})}


def distance(a, b):
    """Damerau-Levenshtein distance by its table, with edits between swapped letters allowed."""
    big, last = len(a) + len(b), {}
    d = {(-1, -1): big}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = big, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = big, j
    for i in range(1, len(a) + 1):
        at = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), at
            at = j if a[i - 1] == b[j - 1] else at
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


@settings(max_examples=500, deadline=None)
@given(st.text("ab", max_size=6), st.text("abc", max_size=6))
def test_within_equals_the_distance_table(a, b):
    for most in (1, 2):
        assert refine.within(a, b, most) == (distance(a, b) <= most)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=18, max_size=34), st.lists(st.tuples(st.integers(0, 3), st.integers(0, 33), st.sampled_from("abcz")), max_size=2))
def test_edited_words_share_a_key(word, changes):
    w = word
    for kind, i, c in changes:
        i = min(i, len(w) - 1)
        w = w[:i] + w[i + 1 :] if kind == 0 else w[:i] + c + w[i:] if kind == 1 else w[:i] + c + w[i + 1 :] if kind == 2 else w[:i] + w[i + 1 : i + 2] + w[i] + w[i + 2 :]
    assert not set(refine.asked_keys(w)).isdisjoint(refine.known_keys(word))
    assert len(refine.asked_keys("q" * 20_000)) < 200


def test_synonyms(spark):
    qs = spark.createDataFrame([(1, "big car fast")], "qid int, text string")
    syn = spark.createDataFrame([("big", 1, 1, "big"), ("big", 1, 2, "very_large"), ("big", 1, 3, "large"), ("big", 2, 1, "grown"), ("car", 1, 1, "large"), ("car", 1, 2, "auto"), ("fast", 1, 1, "rare")], "word string, sense int, pos int, lemma string")
    df = spark.createDataFrame([("large", 3), ("auto", 1), ("grown", 4)], "term string, df long")
    assert refine.expand(qs, syn, df).first().expansions == ["large", "auto"]


def test_suggest_and_history(spark):
    qs = spark.createDataFrame([(1, "school uni")], "qid int, text string")
    hist = spark.createDataFrame([(1, 0, "school uni"), (1, 1, "public school bus"), (1, 2, "dogs"), (1, 3, "school bus meals")], "qid int, pos int, query string")
    terms = spark.createDataFrame([("uniform", 9), ("union", 9), ("unit", 1), ("bus", 2), ("meals", 1), ("public", 1)], "term string, df long")
    assert [r.suggestion for r in refine.suggest(qs, hist, terms, 4).orderBy("pos").collect()] == ["public school bus", "school bus meals", "school uniform", "school union"]
    assert [r.term for r in refine.history_terms(qs, hist, terms, 2).orderBy("pos").collect()] == ["bus", "meals"]


def test_engine(spark, index):
    e = Engine(index)
    qs = spark.createDataFrame([(0, "cat dog"), (1, "bird")], "qid int, text string")
    assert e.models() == ["tfidf", "bm25", "parallel", "serial"]
    assert e.search(qs, "serial", 2).count() == 3 and e.search(qs, "parallel", with_text=True).where("raw_text is null").count() == 0
    for bad in ({"model": "zz"}, {"model": "parallel", "models": ["bm25", "zz"]}, {"model": "serial", "stage2": "zz"}):
        with pytest.raises(ValueError):
            e.search(qs, **bad)
    qrels = spark.createDataFrame([(0, "a", 1), (5, "a", 1)], "qid int, doc_id string, rel int")
    rows, agg = e.evaluate(qs, qrels)
    assert agg.first().num_queries == 1


def test_refinement_is_analysed_like_the_index(spark):
    qs = spark.createDataFrame([(1, "running schools")], "qid int, text string")
    hist = spark.createDataFrame([(1, 0, "the school buses"), (1, 1, "dogs")], "qid int, pos int, query string")
    terms = spark.createDataFrame([("school", 3), ("bu", 2), ("buse", 2), ("run", 1)], "term string, df long")
    got = refine.history_terms(qs, hist, terms, stemmer=stemmed, analyse=STANDARD.tokens).collect()
    assert [r.term for r in got] == ["buse"]
    assert [r.suggestion for r in refine.suggest(qs, hist, terms, stemmer=stemmed, analyse=STANDARD.tokens).orderBy("pos").collect()] == ["the school buses", "running school"]


def test_catalogue_of_engines(spark, tmp_path):
    from lodestone.engine import Engines, status
    from lodestone.operators.index import index_texts
    from lodestone.sources.corpus import Catalogue, Dataset

    docs = spark.createDataFrame([("a", "Running dogs"), ("b", "A cat"), ("c", None)], "doc_id string, text string")
    path = f"file://{tmp_path}/ix"
    engines = Engines(spark, Catalogue([Dataset("x", "X", "nowhere", path)]))
    with pytest.raises(FileNotFoundError, match="lodestone.cli build"):
        engines.get("x")
    index_texts(docs, "text", STANDARD).save(path)
    e = engines.get("x")
    assert engines.get("x") is e and e.index.analyser == STANDARD
    qs = spark.createDataFrame([("q", "the dog runs"), (None, "cat")], "qid string, text string")
    assert [r.doc_id for r in e.search(qs).collect()] == ["a"]
    assert status(spark, path).first().num_docs == 3
    qrels = spark.createDataFrame([("q", "a", 1)], "qid string, doc_id string, rel int")
    assert e.evaluate(qs, qrels)[1] is e.evaluate(qs, qrels)[1] and e.evaluate(qs, qrels, k1=2.0)[1] is not e.evaluate(qs, qrels)[1]


def test_a_large_batch_is_joined_by_term(spark, index, monkeypatch):
    q = ask(spark, "cat dog bird", "cat", "dog zz")
    cands = spark.createDataFrame([(0, "a"), (1, "b")], "qid int, doc_id string")
    want = [as_dict(lexical.search(index, q, m)) for m in ("bm25", "tfidf")] + [as_dict(lexical.rescore(index, q, cands))]
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 0)
    assert want == [as_dict(lexical.search(index, q, m)) for m in ("bm25", "tfidf")] + [as_dict(lexical.rescore(index, q, cands))]


def test_word2vec_similar_trains_the_full_model(spark, monkeypatch):
    from lodestone.operators import dense
    from lodestone.plans import retrieval

    sizes, train = [], dense.train_word2vec

    def seen(*a, **k):
        model = train(*a, **k)
        sizes.append((model.getVectorSize(), model.getMaxIter()))
        return model

    monkeypatch.setattr(dense, "train_word2vec", seen)
    got = retrieval.word2vec_similar(spark, "/root/testdata/sf0.001").groupBy("term").count().collect()
    assert sizes == [(100, 3)] and got and all(r["count"] == 5 for r in got)
