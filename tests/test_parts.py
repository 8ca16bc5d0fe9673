import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexical, parts
from lodestone.plans import catalogue
from lodestone.session import clean

DATA = "/root/testdata/sf0.001"
SEARCHES = ["bm25_params", "bm25_rescore", "parallel_search", "serial_search", "refined_search", "bm25_weighted", "highlights", "score_bar", "tfidf_rescore"]


def _table(docs, bags):
    """docs: {id: (figure, {tid: tf})}, bags: {number: [(tid, w, flat, slope)]}"""
    entry = pa.struct([("tid", pa.int64()), ("w", pa.float64()), ("flat", pa.float64()), ("slope", pa.float64())])
    rows = [{"doc_id": i, "figure": float(f), "tids": list(t), "tfs": list(t.values()), "bag": None, "terms": None} for i, (f, t) in docs.items()]
    rows += [{"doc_id": None, "figure": None, "tids": None, "tfs": None, "bag": b, "terms": [dict(zip(("tid", "w", "flat", "slope"), e)) for e in t]} for b, t in bags.items()]
    return pa.Table.from_pylist(rows, pa.schema([("doc_id", pa.string()), ("figure", pa.float64()), ("tids", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("bag", pa.int64()), ("terms", pa.list_(entry))]))


def test_first_of_a_part_is_that_of_all_scores():
    """Slices, ties across slices, weights of 0 and below, several settings."""
    rng = np.random.default_rng(5)
    docs = {f"d{i:04}": (int(rng.integers(5, 60)), {int(t): int(rng.integers(1, 4)) for t in np.unique(rng.zipf(1.3, 12) % 40)}) for i in range(900)}
    docs |= {f"e{i}": docs["d0007"] for i in range(30)}  # ties
    bags = {b: [(int(t), float(rng.choice([0.3, 1.0, 2.5] + [0.0, -0.7] * (b % 5 == 0))), *((0.4, 0.05), (0.0, 0.0))[b % 2]) for t in np.unique(rng.integers(0, 40, 4))] for b in range(40)}
    got = {}
    for batch in parts.Part(_table(docs, bags), "bm25", 128).first(7):
        for b, d, s in zip(*(c.to_pylist() for c in batch.columns)):
            got.setdefault(b, []).append((d, round(s, 6)))
    for b, terms in bags.items():
        want = []
        for d, (figure, tfs) in docs.items():
            if any(t in tfs for t, *_ in terms):
                want.append((d, sum(w * tfs[t] / (tfs[t] + flat + slope * figure) for t, w, flat, slope in terms if t in tfs)))
        want = sorted(((d, round(s, 6)) for d, s in want), key=lambda x: (-x[1], x[0]))[:7]
        assert sorted(got.get(b, []), key=lambda x: (-x[1], x[0])) == [(d, pytest.approx(s, abs=1e-9)) for d, s in want]


def test_rounding_is_that_of_spark(spark):
    values = [0.0000005, 1.0000005, 2.0000015, 2.6755565, -1.0000005, -0.0000015, 3.25, 1e-9, 12.3456785, 0.1 + 0.2]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6)).collect()]
    assert [x / 1e6 for x in parts.rounded(np.array(values))] == want


@pytest.mark.parametrize("name", SEARCHES)
def test_only_the_first_of_each_part_are_rows(spark, monkeypatch, name):
    """What is sorted for the first k is k rows a query and part, not every document that shares a term."""
    if not os.path.exists(DATA):
        pytest.skip("no data")
    sizes, top_k = [], lexical.top_k

    def counted(scores, k, score="score"):
        sizes.append((scores.count(), scores.select("qid").distinct().count() * k))
        return top_k(scores, k, score)

    monkeypatch.setattr(lexical, "top_k", counted)
    catalogue.QUERIES[name](spark, DATA).count()
    clean(spark)
    assert sizes and all(rows <= most for rows, most in sizes)
