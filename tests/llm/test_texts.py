import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import near_duplicates as nd
from lodestone.llm import pack_bins as pb
from lodestone.llm import split_text as sp

WORDS = "the law of school state and people should not reduce taxes for all in our town because it is right".split()


def joined(text, pieces):
    return "".join(text[a + o : b] for a, b, o, _ in pieces)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc", " ", "\n", "\r\n", "\n\n", ". ", "- x", "# h\n", "wordword", "é", "😀", "\t", "<p>", "</p>", "1) "]), max_size=120).map("".join), st.integers(12, 40), st.integers(0, 11))
def test_pieces_give_the_text_back(text, limit, overlap):
    pieces = sp.split_text(text, limit, overlap)
    assert joined(text, pieces) == text
    assert all(b - a <= limit and 0 <= o <= overlap for a, b, o, _ in pieces)
    assert pieces[0][2] == 0
    longest = max(map(len, text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")))
    assert any(h for *_, h in pieces) == (len(text) > limit and longest > limit)


def test_natural_boundaries():
    text = "# One\n" + "Some words here. " * 20 + "\n\n# Two\n" + "Other words there. " * 20
    cuts = [text[b - 1 : b + 1] for _, b, *_ in sp.split_text(text, 400, 40)[:-1]]
    assert "\n#" in [text[b - 1 : b + 1] for _, b, *_ in sp.split_text(text, 400, 40)[:-1]] and all(c[0] in " \n" for c in cuts)
    hard = sp.split_text("x" * 3100)
    assert [b - a for a, b, *_ in hard] and max(b - a for a, b, *_ in hard) <= 1500 and hard[0][3]
    assert not any(h for *_, h in sp.split_text("y" * 700 + "</p>" + "z" * 700 + " " + "z" * 200))
    assert not any(h for *_, h in sp.split_text("y" * 1500 + " " + "z" * 1400))


def _sections(n, lines=6):
    return "".join(f"# Heading {i}\n\n" + " ".join(f"Sentence {i} {j} has some words." for j in range(lines)) + "\n\n" for i in range(n))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([1, 2, 3, 9, 14, 30]), min_size=1, max_size=12), st.integers(120, 500))
def test_no_piece_mixes_an_opened_node_with_others(sections, limit):
    text = "".join(f"# H{i}\n\n" + " ".join(f"Sentence {i} {j} has some words." for j in range(n)) + "\n\n" for i, n in enumerate(sections))
    room, at, nodes = limit - 10, 0, []
    for i, n in enumerate(sections):
        size = len(f"# H{i}\n\n" + " ".join(f"Sentence {i} {j} has some words." for j in range(n)) + "\n\n")
        nodes.append((at, at + size, size > room))
        at += size
    spans = sp._pack(text, 0, len(text), 0, limit, room)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(p[1] == q[0] for p, q in zip(spans, spans[1:]))
    if len(text) > room:
        for a, b in spans:
            for x, y, opened in nodes:
                if opened and a < y and x < b:
                    assert x <= a and b <= y, (a, b, x, y)


def test_a_heading_stays_with_its_body():
    text = _sections(3, 40)
    pieces = sp.split_text(text, 400, 40)
    assert joined(text, pieces) == text
    for a, b, o, _ in pieces:
        own = text[a + o : b]
        assert "# Heading" not in own or own.startswith("# Heading") and "Sentence" in own
    small = "# One\n\nA b c.\n\n# Two\n\nD e f.\n\n# Three\n\n" + "G h i. " * 30
    assert [small[a + o : b][:5] for a, b, o, _ in sp.split_text(small, 100, 10)][:2] == ["# One", "# Thr"]


def test_split_long(spark):
    rows = [(1, "a " * 1000), (2, "short"), (3, ""), (4, None), (5, "q" * 5000), (1, "a " * 1000), (6, " " * 4000), (7, "w " * 100_000)]
    df = spark.createDataFrame(rows, "doc_rowid long, raw_text string").withColumn("piece", F.lit("clash")).withColumn("text", F.lit(None).cast("string"))
    got = sp.split_long(df)
    assert {r[0] for r in got.select("doc_rowid").distinct().collect()} == {1, 5, 6, 7}
    assert got.where("length(text) > 1500 or overlap > 150").count() == 0
    parts = got.where("doc_rowid = 7").orderBy("piece").collect()
    assert "".join(r.text[r.overlap :] for r in parts) == "w " * 100_000
    assert sp.split_long(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80))
def test_best_fit_decreasing(sizes):
    sizes = sorted(sizes, reverse=True)
    bins = pb.best_fit_decreasing(sizes, 50)
    room: list[int] = []
    for s, b in zip(sizes, bins):  # the tightest open bin, by looking at all
        fit = [r for r in room if r >= s]
        if fit:
            assert room[b] == min(fit)
        else:
            assert b == len(room)
            room.append(50)
        room[b] -= s
    assert all(r >= 0 for r in room)


def test_cut_sizes():
    for text in ("x" * 5000, "é" * 3000, "😀" * 2000, "a" * 2048, "a" * 4096, "aé" * 1365):
        cuts, raw, at = pb.cut_sizes(text, 2048), text.encode(), 0
        assert sum(cuts) == len(raw) + 1 and max(cuts) <= 2048 and min(cuts) > 0
        for c in cuts[:-1]:
            raw[at : at + c].decode()
            at += c
        raw[at:].decode()


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(0, 3000)) for i in range(400)] + [(400, None), (401, ""), (401, ""), (None, "abc"), (402, "é" * 10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bin", F.lit(1)).withColumn("size", F.lit("clash"))
    got = pb.pack(df, shard_items=150).collect()
    full: dict = {}
    for r in got:
        full[r.shard, r.bin] = full.get((r.shard, r.bin), 0) + r.n_tokens
    assert max(full.values()) <= 2048
    total = sum(len(t.encode()) + 1 for _, t in rows if t is not None)
    assert sum(full.values()) == total and len(full) <= total / 2048 * 1.1 + 4
    split = {r.doc_id for r in got if r.piece > 0}
    assert split == {i for i, t in rows if t and len(t.encode()) + 1 > 2048}
    assert sum(r.doc_id == 401 for r in got) == 2 and not any(r.doc_id == 400 for r in got)
    assert pb.pack(df.limit(0)).count() == 0


def _brute(texts, k, t):
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for i, w in ((i, x.split()) for i, x in texts)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def _edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        i = rng.randrange(len(w))
        kind = rng.randrange(4)
        if kind == 0:
            w[i] = rng.choice(WORDS)
        elif kind == 1:
            w.insert(i, rng.choice(WORDS))
        elif kind == 2 and len(w) > 3:
            del w[i]
        else:
            w = w[i:] + w[:i]
    return w


@pytest.mark.parametrize("k,t,hot", [(3, 0.6, 8192), (5, 0.8, 8192), (3, 0.6, 4), (2, 0.55, 8192), (3, 1.0, 8192)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, k, t, hot):
    rng = random.Random(k * 7 + hot)
    base = [[rng.choice(WORDS) for _ in range(rng.choice([3, 4, 5, 8, 25, 60, 300]))] for _ in range(45)]
    texts = [(i, " ".join(w)) for i, w in enumerate(base + [_edited(rng, rng.choice(base), rng.choice([1, 1, 2, 5])) for _ in range(180)])] + [(900, ""), (901, "one"), (902, "no no no no no no"), (903, "no no no no no no no")]
    monkeypatch.setattr(nd, "HOT_BLOCK", 3)
    got = {(r.a, r.b) for r in nd.similar_pairs(spark.createDataFrame(texts, "id long, words string"), k, t, part_keys=500, hot_run=hot).collect()}
    want = _brute(texts, k, t)
    assert got == want and len(want) > (20 if t < 1 else 5)
    assert nd.similar_pairs(spark.createDataFrame([], "id long, words string"), k, t).count() == 0


@pytest.mark.parametrize("hot", [8192, 4])
def test_rounds_change_nothing(spark, monkeypatch, hot):
    rng = random.Random(hot)
    base = [[rng.choice(WORDS) for _ in range(rng.choice([5, 25, 60, 150]))] for _ in range(30)]
    texts = [(i, " ".join(w)) for i, w in enumerate(base + [_edited(rng, rng.choice(base), rng.choice([1, 2, 5])) for _ in range(120)])]
    monkeypatch.setattr(nd, "HOT_BLOCK", 3)
    names, materialize = [], nd.materialize
    monkeypatch.setattr(nd, "materialize", lambda df, name: names.append(name) or materialize(df, name))
    df = spark.createDataFrame(texts, "id long, words string")
    got = {(r.a, r.b) for r in nd.similar_pairs(df, 3, 0.6, part_keys=500, hot_run=hot, round_bytes=9).collect()}
    assert got == _brute(texts, 3, 0.6) and len(got) > 20
    assert names.count("met") > 1


def test_no_round_sends_more_than_its_bytes_however_many_parts():
    n, elements, signed = 1_000_000, 145_000_000, 45_000_000
    for parts in (12, 125, 620, 2300, 100_000):
        rounds, keys = nd.rounds_of(n, elements, signed, parts, 0.6, 9 * elements), 0.8 * 145 + 1
        mine, met = keys / rounds, nd.ceil_parts(parts, rounds)
        assert n * mine * 5 + signed * min(met, mine) <= 9 * elements * 1.6  # min() is above the expected number of parts
        assert 1 <= rounds <= 8 and (parts > 12 or rounds == 1)
    assert nd.rounds_of(0, 0, 0, 12, 0.6, 0) == 1


def test_positional_filter_is_a_lower_bound():
    """For every element that two sorted sets share, the filter never counts more unmatched elements than there are, and some."""
    rng, above = random.Random(4), 0
    for _ in range(400):
        top = rng.choice([12, 60, 900])
        a, b = (sorted(rng.sample(range(top), rng.randrange(2, top))) for _ in range(2))
        differ = len(set(a) ^ set(b))
        both = sorted(set(a) & set(b))
        if both:
            i, j = np.array([a.index(v) for v in both]), np.array([b.index(v) for v in both])
            x, y = np.full(len(both), len(a)), np.full(len(both), len(b))
            got = nd.apart(nd.coarse_position(i, x), x, nd.coarse_position(j, y), y)
            assert got.max() <= differ
            above += int(got.max() > abs(len(a) - len(b)))
    assert above > 20


def test_classes_of_copies(spark):
    long = " ".join(WORDS) + " one two three"
    rows = [(1, long, "2024-01-01"), (2, long.upper() + "!!", "2024-01-01"), (3, "short text", "2024-01-01"), (4, None, "2024-01-01"), (5, long, "2024-01-01"), (5, "now short", "2024-02-01"), (6, "", None), (None, long, "2024-01-01"), (2, long.upper() + "!!", "2024-01-01")]
    df = spark.createDataFrame(rows, "doc_rowid long, raw_text string, at string").withColumn("ingested_at", F.to_timestamp("at"))
    members, texts = nd.current_classes(df)
    assert sorted(map(tuple, members.collect())) == [(1, 1), (2, 1)]
    assert [r.id for r in texts.collect()] == [1]
