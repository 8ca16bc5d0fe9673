import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import leaks, log_entropy, quality, rank_scores, term_counts
from lodestone.llm.holdout import HOLDOUT


def test_suffix_array_and_index_against_brute_force():
    rng = np.random.default_rng(1)
    for n, symbols in ((1, 2), (30, 2), (500, 3), (2000, 60), (3000, 2)):
        words = rng.integers(1, symbols + 1, n)
        if n == 3000:
            words[:] = 1
        x = np.append(words, 0)
        assert leaks.suffix_array(x, max(1, symbols.bit_length())).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist()) or n == 3000
        ix = leaks.FMIndex(words, symbols)
        for m in (1, 2, 5):
            if m > n:
                continue
            phrases = np.stack([words[i : i + m] for i in rng.integers(0, n - m + 1, 20)] + [rng.integers(1, symbols + 1, m) for _ in range(20)])
            lo, hi = ix.search(phrases)
            for p, a, b in zip(phrases, lo, hi):
                want = [i for i in range(n - m + 1) if (words[i : i + m] == p).all()]
                assert sorted(ix.locate(np.arange(a, b)).tolist()) == want


def test_merged_spans():
    g, a, z = leaks.merge_spans(np.array([1, 0, 1, 1, 0]), np.array([5, 0, 0, 3, 4]), np.array([9, 2, 3, 6, 6]))
    assert list(zip(g, a, z)) == [(0, 0, 2), (0, 4, 6), (1, 0, 9)]
    assert all(len(v) == 0 for v in leaks.merge_spans(*[np.zeros(0, np.int64)] * 3))


@pytest.mark.parametrize("shard,block", [(1_000_000, 500_000), (40, 500_000), (40, 7)])
def test_leaks_against_brute_force(spark, shard, block):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 20])))) for i in range(20)] + [(90, None), (91, "")]
    docs = []
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 150))]
        src = rng.choice(items[:20])[1].split()
        a = rng.randrange(0, len(src) // 2)
        at = rng.randrange(0, len(w) + 1)
        w[at:at] = src[a : a + rng.randrange(4, 12)]
        docs.append((i, ", ".join(w).upper() if i % 2 else "\n".join(w)))
    docs += [(70, None), (71, ""), (72, "?!"), (None, items[0][1]), (0, docs[0][1])]
    n = 5
    words = lambda t: "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in (t or "").lower()).split()
    grams = lambda t: {tuple(words(t)[i : i + n]) for i in range(len(words(t)) - n + 1)}
    want = {(d, i) for (d, t), (i, s) in itertools.product(docs, items) if grams(t) & grams(s)}
    corpus = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    spans = leaks.leaked_spans(corpus, spark.createDataFrame(items, "item_id long, text string"), phrase=n, shard_words=shard, block_phrases=block)
    got = spans.collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 20
    by_id = dict(docs[:60])
    item = dict(items)
    for r in got:
        if r.doc_id is not None:
            w, g = words(by_id[r.doc_id]), grams(item[r.item_id])
            assert all(tuple(w[i : i + n]) in g for i in (r.first_word, r.end_word - n))
    assert leaks.leaked_spans(corpus.limit(0), spark.createDataFrame(items, "item_id long, text string"), phrase=n).count() == 0
    assert leaks.leaked_spans(corpus, spark.createDataFrame([], "item_id long, text string"), phrase=n).count() == 0


def test_several_blocks_cost_one_build(spark, monkeypatch):
    built, build = [], leaks.shard_indexes

    def seen(*a):
        built.append(build(*a))
        return built[-1]

    monkeypatch.setattr(leaks, "shard_indexes", seen)
    corpus = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(f"i{i}", " ".join(f"w{i}x{j}" for j in range(3, 20))) for i in range(30)], "item_id string, text string")
    got = leaks.leaked_spans(corpus, items, block_phrases=20)
    assert sorted(map(tuple, got.collect())) == sorted((i, f"i{i}", 3, 20) for i in range(30))
    assert len(built) == 1 and built[0].inputFiles()


def test_radix_counts_recurse(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"t{int(rng.expovariate(0.01))}", i, 1 + i % 3) for i in range(4000)] + [("hot", i, 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "term string, doc_rowid long, tf long").withColumn("h", F.lit(1)).withColumn("df", F.lit("clash"))
    want = {r.term: (r.o, r.d) for r in df.groupBy("term").agg(F.sum("tf").alias("o"), F.count("*").alias("d")).collect()}
    for limit in (500_000, 50):
        monkeypatch.setattr(term_counts, "PART_ROWS", limit)
        assert {r.term: (r.occurrences, r.df) for r in term_counts.term_counts(df, 3).collect()} == want
    assert term_counts.term_counts(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, 1, 1), ("a", 1, None), ("", 2, 5)], "term string, doc_rowid long, tf long")
    assert {tuple(r) for r in term_counts.term_counts(odd).collect()} == {("a", 0, 1), ("", 5, 1)}
    marks = term_counts.marked(spark.createDataFrame([("r", 2), ("m", 3), ("c", 21), ("e", 20)], "term string, df long"), 100)
    assert {r.term: r.mark for r in marks.collect()} == {"r": "rare", "m": None, "c": "common", "e": None}


def test_log_entropy(spark):
    rows = [("one", 1, 4), ("even", 1, 2), ("even", 2, 2), ("even", 3, 2), ("even", 4, 2), ("two", 1, 3), ("two", 2, 1)]
    df = spark.createDataFrame(rows, "term string, doc_rowid long, tf long").withColumn("df", F.lit("clash"))
    got = {(r.term, r.doc_rowid): r.weight for r in log_entropy.log_entropy(df.select("term", "doc_rowid", "tf"), 4, share=0.5).collect()}
    h = -(0.75 * math.log(0.75) + 0.25 * math.log(0.25))
    assert got["one", 1] == pytest.approx(1 + math.log(4)) and got["even", 3] == pytest.approx(0, abs=1e-9)
    assert got["two", 1] == pytest.approx((1 + math.log(3)) * (1 - h / math.log(4)))
    assert log_entropy.log_entropy(df.limit(0).select("term", "doc_rowid", "tf"), 0).count() == 0


def test_rank_significance_against_simulation(spark):
    ranks = [[0.1, 0.2, 0.9], [1.0], [0.05, 0.06, 0.07, 0.08], [1.0, 1.0]]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in ranks], "r array<double>").select(rank_scores.rank_significance(F.col("r"))).collect()]
    u = np.sort(np.random.default_rng(0).random((200_000, 4)), axis=1)
    for r, g in zip(ranks, got):
        n = len(r)
        s = np.sort(np.random.default_rng(n).random((200_000, n)), axis=1)
        want = min(1, n * min((s[:, k] <= x).mean() for k, x in enumerate(sorted(r))))
        assert g == pytest.approx(want, abs=0.01)


def _results(spark, rows):
    return spark.createDataFrame(rows, "query_id string, doc_id string, components map<string,double>, at string").withColumn("run_at", F.to_timestamp("at")).drop("at").withColumn("rank", F.lit("clash"))


def test_aggregate_ranks(spark):
    nan = float("nan")
    rows = [("q", "a", {"M": 9.0, "n": 0.1}, "2024-01-02"), ("q", "a", {"m": 0.0}, "2024-01-01"), ("q", "b", {"m": 5.0, "n": nan}, "2024-01-01"), ("q", "c", {"m": 5.0, "n": 0.9}, "2024-01-01"),
            ("q", "d", {}, "2024-01-01"), ("q", None, {"m": 1.0}, "2024-01-01"), ("q", "e", None, "2024-01-01"), (None, "a", {"m": 1.0}, "2024-01-01"), ("z", "a", {"m": nan}, None), ("q", "b", {"m": 5.0, "n": nan}, "2024-01-01")]
    got = {(r.query_id, r.doc_id): (r.n_models, r.n_docs, r.place_sum) for r in rank_scores.aggregate_ranks(_results(spark, rows)).collect()}
    assert got == {("q", "a"): (2, 4, 3), ("q", "b"): (2, 4, 5), ("q", "c"): (2, 4, 3), ("q", "d"): (2, 4, 7), ("z", "a"): (0, 1, 0)}
    assert rank_scores.aggregate_ranks(_results(spark, rows).limit(0)).count() == 0


def test_first_docs_need_no_significance(spark, monkeypatch, tmp_path):
    """'b' has one first place and the least rho, 'a' the least sum of places; on equal sums the lesser doc_id is first."""
    scores = {"a": (7.0, 7.0, 7.0), "b": (9.0, 0.0, 0.0), "c": (1.0, 9.0, 2.0), "d": (2.0, 1.0, 9.0)}
    rows = [("q", d, dict(zip("lmn", s)), "2024-01-01") for d, s in scores.items()] + [("tie", d, {"m": 1.0}, None) for d in "yx"] + [("none", "a", {}, None)]
    _results(spark, rows).write.parquet(f"{tmp_path}/search_results.parquet")
    called, rho = [], rank_scores.rank_significance
    monkeypatch.setattr(rank_scores, "rank_significance", lambda c: called.append(c) or rho(c))
    assert sorted(map(tuple, rank_scores.p6_found(spark, str(tmp_path)).collect())) == [("q", "a"), ("tie", "x")]
    assert not called
    ranked = {(r.query_id, r.doc_id): r.rank for r in rank_scores.p6_ranking(spark, str(tmp_path)).collect()}
    assert called and len(ranked) == 7 and sorted(v for (q, _), v in ranked.items() if q == "q") == [1, 2, 3, 4]


def test_stats_equal_plain_python(spark):
    common = ["the", "is", "été"]
    texts = [t for t, _ in HOLDOUT] + ["", " \n\t", "The é is. \r\n\r\n été!?\n\n x", "a" * 50_000 + ".", "1 2 3", "été the"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "doc_id int, text string").withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: tuple(r[f] for f in quality.FEATURES) for r in quality.text_stats(df, common).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(quality.stats_of(t, set(common))), t


def natural(n, rng):
    return np.column_stack([rng.integers(30, 400, n), rng.uniform(4.2, 5.8, n), rng.uniform(0.015, 0.06, n), rng.uniform(0.8, 1, n), rng.uniform(0.3, 0.6, n)])


def test_trees_on_held_out_rows():
    rng = np.random.default_rng(0)
    draw = lambda n: np.column_stack([rng.integers(0, 200, n), rng.uniform(1, 12, n), rng.uniform(0, 0.3, n), rng.uniform(0, 1, n), rng.uniform(0, 0.6, n)])
    x, new = draw(4000), draw(4000)
    label = lambda a: (quality.signs(a) >= 2).astype(float)
    model = quality.BoostedTrees().fit(x, label(x))
    assert ((model.margin(new) > 0) == (label(new) > 0)).mean() > 0.9
    empty = quality.train_on(np.zeros((0, 5)), np.zeros(0), set())
    assert np.isfinite(empty.probability(draw(10))).all()


def test_the_gate_drops_prose_and_no_case():
    """Prose alone teaches the trees, by its spoilt versions; every pair of signs is looked at, most prose isn't."""
    rng = np.random.default_rng(9)
    common = {"the", "to", "of", "and", "that", "it", "is", "in", "for", "not", "der", "die", "das", "und", "nicht", "es", "la", "le", "les", "que", "de", "el", "en", "no", "y", "lo", "a", "on", "i"}
    model = quality.train_on(natural(3000, rng), np.zeros(3000), common)
    prose, bad = natural(2000, rng), np.array([[8, 8], [2.2, 9.5], [0.3, 0.3], [0.2, 0.2], [0.05, 0.05]])
    assert (model.probability(prose) < model.gate).mean() > 0.7
    for pair in itertools.combinations(range(5), 2):
        for way in range(2):
            x = natural(200, rng)
            x[:, pair] = bad[list(pair), way] * rng.uniform(0.95, 1.05, (200, 2))
            assert (model.probability(x) >= model.gate).all(), pair


def test_form_labels(spark):
    prose = "We met on Tuesday, and the mayor said that the road was too old. Nobody in the town liked the plan that the road should go."
    texts = [prose, "a;b;c\n1;2;3\n4;5;6", "1. One thing\n2. Two things\n3. Three", "Home > A > B > C", "x" * 100, "WIN WIN WIN WIN WIN WIN now", "xkv jqz zrt pwq lmn bcd fgh jkl mnp qrs.", "", "{ a }\n<b>\n{ c }"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "i int, text string")
    assert {r.i: r.label for r in quality.with_form(df).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: None, 7: None, 8: 1, 99: None}


def test_junk_of_a_small_table(spark):
    prose = "We met on Tuesday, and the mayor said that the road was too old. Nobody in the town liked the plan that the road should go."
    rows = [(i, prose + f" It is the {i} time that we say it.") for i in range(60)] + [(90, ""), (91, " \n"), (92, "a;b;1\nc;d;2"), (93, None), (92, "a;b;1\nc;d;2")]
    words = spark.createDataFrame([("en", "the"), ("en", "that"), ("en", "it"), ("en", None), ("en", "was"), ("en", "in")], "lang string, word string")
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")), words).collect()
    assert len(got) == 64 and {90, 91, 92} <= {r.doc_id for r in got if r.looked_at}
    assert quality.quality(spark.createDataFrame([], "doc_id long, text string"), words).count() == 0
