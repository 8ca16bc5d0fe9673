import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import similar_vectors as sv

SCHEMA = "vec_row long, doc_id string, model string, dim int, vec array<float>"


def frame(spark, x, model="m"):
    return spark.createDataFrame([(i, f"d{i}", model, x.shape[1], [float(v) for v in r]) for i, r in enumerate(x)], SCHEMA)


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return [set(r) for r in np.argsort(-s, axis=1, kind="stable")[:, :k]]


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 3000)] + 0.6 * rng.normal(size=(3000, 24))
    got = {}
    for r in sv.neighbours(frame(spark, x), 10, probes=8, leaf_rows=100).collect():
        got.setdefault(r.vec_row, set()).add(r.neighbour)
    true = brute(x, 10)
    assert all(len(v) == 10 for v in got.values()) and len(got) == 3000
    assert np.mean([len(got[i] & true[i]) / 10 for i in range(3000)]) >= 0.9


def test_regions_and_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    one = sorted(map(tuple, sv.neighbours(frame(spark, x), 5, probes=2, leaf_rows=30).select("vec_row", "neighbour").collect()))
    monkeypatch.setattr(sv, "REGION_ROWS", 40)
    assert one == sorted(map(tuple, sv.neighbours(frame(spark, x), 5, probes=2, leaf_rows=30).select("vec_row", "neighbour").collect()))
    q = sv.fit(x / np.linalg.norm(x, axis=1, keepdims=True), 3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    own = q.leaves(u, 1)[:, 0]
    o = np.argsort(own, kind="stable")
    asked = [sv.search_region(q, np.arange(300), q.leaves(u[o], 2), x[o], own[o], q.encode(u[o], own[o]), o, 5)]
    monkeypatch.setattr(sv, "QUERY_BLOCK", 7), monkeypatch.setattr(sv, "ROW_BITS", 6), monkeypatch.setattr(sv, "ROW_BLOCK", 64)
    asked.append(sv.search_region(q, np.arange(300), q.leaves(u[o], 2), x[o], own[o], q.encode(u[o], own[o]), o, 5))
    assert (asked[0][0] == asked[1][0]).mean() > 0.99 and (asked[0][0] >= 0).all()


def test_rounds_send_few_copies_and_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[800:] = x[:100]
    monkeypatch.setattr(sv, "REGION_ROWS", 60)
    tables, materialize = [], sv.materialize
    monkeypatch.setattr(sv, "materialize", lambda df, name: tables.append((name, df.columns)) or materialize(df, name))
    ask = lambda: sorted(map(tuple, sv.neighbours(frame(spark, x), 5, probes=6, leaf_rows=20).collect()))
    several = ask()
    assert [n for n, _ in tables].count("found") > 1
    monkeypatch.setattr(sv, "ROUND_COPIES", 1000), tables.clear()
    assert ask() == several and [n for n, _ in tables].count("found") == 1
    assert len({r[1] for r in several}) == 900


def test_integer_tables_add_up():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 17)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = sv.fit(x, 6)
    own = q.leaves(x, 1)[:, 0]
    codes = q.encode(x, own)
    assert (sv.unpacked(sv.packed(codes), codes.shape[1]) == codes).all()
    tables, scale = q.integer_tables(x[:50])
    total = tables[np.arange(codes.shape[1])[None], codes].astype(np.int64).sum(1)  # (rows, queries)
    assert np.abs(total).max() < 32_000
    exact = x[:50] @ q.decode(codes)[:, :17].T
    assert np.abs(total.T / scale[:, None] - exact).max() < 1e-3


def test_regions_hold_even_rows():
    rng = np.random.default_rng(8)
    c, sizes = rng.normal(size=(90, 6)), rng.integers(1, 60, 90)
    for many in (1, 2, 3, 7):
        r = sv.regions_of(c, sizes, many)
        rows = np.bincount(r, sizes)
        assert len(rows) == many and rows.max() < 1.5 * rows.mean() + 60


def test_dirty_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "a", "m", 2, [1.0, 0.0]), (1, "a", "m", 2, [1.0, 0.0]), (2, None, "m", 2, [1.0, 0.001]), (3, "c", "m", 2, None), (4, "c", "m", 2, []), (5, "c", "m", 2, [1.0]),
            (6, "c", "m", 2, [0.0, 0.0]), (7, "c", "m", 2, [nan, 1.0]), (8, "c", "m", 2, [inf, 1.0]), (9, "c", "m", 2, [None, 1.0]), (10, "x", "n", 2, [1.0, 0.0]), (11, "x", None, 2, [1.0, 0.0]), (12, "d", "m", 2, [1.0, 0.0])]
    got = sorted(map(tuple, sv.neighbours(spark.createDataFrame(rows, SCHEMA)).select("vec_row", "neighbour").collect()))
    assert got == [(1, 2), (1, 12), (2, 1), (2, 12), (12, 1), (12, 2)]
    assert sv.neighbours(spark.createDataFrame([], SCHEMA)).count() == 0


def test_anisotropic_codes_favour_the_parallel_error():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = sv.fit(x, 4)
    own = q.leaves(x, 1)[:, 0]
    base = x - q.centroids[own]
    plain = sv._encode(sv._cut(base), sv._cut(x), q.tables, 1.0, 0)
    along = lambda codes: np.mean(((base - q.decode(codes)[:, :16]) * x).sum(1) ** 2)
    sv_codes = sv._encode(sv._cut(base), sv._cut(x), q.tables, 10.0, 2)
    assert along(sv_codes) < along(plain)
    assert q.decode(plain).shape == (2000, 16) and plain.max() < 16


def with_copies(n, seed):
    """A third of the rows are copies of the vector in the middle of the others."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 24)) + 1
    x = (centres[rng.integers(0, 40, n)] + 0.6 * rng.normal(size=(n, 24))).astype(np.float32)
    hot = rng.random(n) < 1 / 3
    x[hot] = x[~hot].mean(0)
    return x, hot


def test_leaves_are_distinct_and_hold_rows():
    x, _ = with_copies(3000, 6)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = sv.fit(x, 60)
    assert len(q.centroids) >= 50 and set(q.leaves(x, 1)[:, 0]) == set(range(len(q.centroids)))
    between = q.centroids @ q.centroids.T - 2 * np.eye(len(q.centroids))
    assert between.max() < 1 - 1e-6


def test_a_third_of_the_rows_are_copies(spark):
    x, hot = with_copies(3000, 6)
    got = {}
    for r in sv.neighbours(frame(spark, x), 10, probes=8, leaf_rows=50).collect():
        got.setdefault(r.vec_row, set()).add(r.neighbour)
    copies = np.flatnonzero(hot)
    for i in (copies[0], copies[7], copies[-1]):
        assert got[i] == set([c for c in copies if c != i][:10])
    true = brute(x.astype(np.float64), 10)
    others = np.flatnonzero(~hot)
    assert len(got) == 3000 and np.mean([len(got[i] & true[i]) / 10 for i in others]) >= 0.9


def test_probes_grow_with_the_leaves():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(8000, 12)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, true = sv.fit(x, 2100), brute(x, 10)
    assert len(q.centroids) > 2000
    own, near = q.leaves(x, 1)[:, 0], q.leaves(x[:400], sv.probes_of(len(q.centroids)))
    recall = np.mean([np.isin(own[list(true[i])], near[i]).mean() for i in range(400)])
    few = np.mean([np.isin(own[list(true[i])], near[i, : sv.PROBES]).mean() for i in range(400)])
    assert near.shape[1] == sv.probes_of(len(q.centroids)) > 90
    assert recall >= 0.8 and recall > few + 0.1
