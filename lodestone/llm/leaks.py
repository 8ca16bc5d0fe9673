"""Problem 9: held-out passages inside the corpus, found by backward search in an FM-index of each corpus shard."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import materialize
from lodestone.sources.tables import table

PHRASE = 13  # consecutive plain words
SHARD_WORDS = 1_000_000  # words indexed together; a shard takes about 60 bytes a word while it is built
BLOCK_PHRASES = 500_000  # phrases searched in one pass over the indexes, about: an item's phrases stay together
SAMPLE = 4  # every so many suffix positions are kept


def plain_text(col: str | Column) -> Column:
    """The plain words of a text, with single spaces: lower case, all but a-z and 0-9 is a space."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


class BitRank:
    """A bit vector that counts its ones before any position: words of 64 bits and running sums."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)])

    def __getstate__(self):
        return self.words

    def __setstate__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletTree:
    """Symbols by levels of bits, highest first, each level stably sorted by the bit above (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, seq = [], symbols
        for b in range(bits - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(bool)
            seq = np.concatenate([seq[~bit], seq[bit]])
            self.levels.append((b, BitRank(bit), len(bit) - int(bit.sum())))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i."""
        start, end = np.zeros_like(i), i.copy()
        for b, bits, zeros in self.levels:
            one = ((symbol >> b) & 1).astype(bool)
            s, e = bits.ones(start), bits.ones(end)
            start, end = np.where(one, zeros + s, start - s), np.where(one, zeros + e, end - e)
        return end - start

    def step(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at i, how often it occurs before i)."""
        symbol, start, at = np.zeros_like(i), np.zeros_like(i), i.copy()
        for b, bits, zeros in self.levels:
            one = bits.at(at).astype(bool)
            s, e = bits.ones(start), bits.ones(at)
            start, at = np.where(one, zeros + s, start - s), np.where(one, zeros + e, at - e)
            symbol |= one.astype(symbol.dtype) << b
        return symbol, at - start


def suffix_array(x: np.ndarray, bits: int) -> np.ndarray:
    """Suffixes of x in order, by prefix doubling from packed symbols; only ties are sorted again. x ends with its one 0."""
    n, per = len(x), max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(per):
        key <<= bits
        if k < n:
            key[: n - k] |= x[k:]
    sa = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[sa][1:] != key[sa][:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    length = per
    while True:
        tied = ~(new & np.concatenate([new[1:], [True]]))
        at = np.flatnonzero(tied)
        if not len(at):
            return sa
        rows = sa[at]
        group, nxt = rank[rows], np.where(rows + length < n, rank[np.minimum(rows + length, n - 1)], -1)
        order = np.lexsort((nxt, group))
        rows, group, nxt = rows[order], group[order], nxt[order]
        sa[at] = rows
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])])
        new[at] = fresh
        rank[rows] = np.maximum.accumulate(np.where(fresh, at, 0))
        length *= 2


class FMIndex:
    """Backward search and location over a sequence of word numbers (1 and up; 0 ends it)."""

    def __init__(self, words: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        x = np.append(words, 0)
        bits = max(1, int(n_symbols).bit_length())
        sa = suffix_array(x, bits)
        self.tree = WaveletTree(x[sa - 1], bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=n_symbols + 1))])
        marked = sa % sample == 0
        self.marked, self.samples, self.size = BitRank(marked), sa[marked].astype(np.int32 if len(x) < 2**31 else np.int64), len(x)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [lo, hi) of suffixes that begin with each phrase (one per row), from its last word backwards."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            lo[live] = self.first[c] + self.tree.rank(c, lo[live])
            hi[live] = self.first[c] + self.tree.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        hi = np.maximum(lo, hi)
        found = np.zeros(len(phrases), bool)
        found[live] = True
        return np.where(found, lo, 0), np.where(found, hi, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: back along the text to the next sampled one."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.marked.at(at).astype(bool)
            out[todo[hit]] = self.samples[self.marked.ones(at[hit])] + steps
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                symbol, before = self.tree.step(at)
                at, steps = self.first[symbol] + before, steps + 1
        return out


def merge_spans(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of a group made one."""
    o = np.lexsort((start, group))
    group, start, end = group[o], start[o], end[o]
    base = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1])])) * (int(end.max(initial=0)) + 2)
    reach = np.maximum.accumulate(base + end)
    new = np.concatenate([[True], (base + start)[1:] > reach[:-1]])[: len(start)]
    at = np.flatnonzero(new)
    return group[at], start[at], (np.maximum.reduceat(base + end, at) - base[at]) if len(at) else end[:0]


def _shards(batches: Iterator[pa.RecordBatch], shard_words: int, phrase: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, pa.Array]]:
    """(ids, row and first word of each part, all words) of about shard_words words. A longer text is cut into parts that
    share phrase - 1 words, so that no phrase is lost."""
    ids, rows, firsts, parts, held = [], [], [], [], 0
    for b in batches:
        lists = pc.split_pattern(b.column(1), " ")
        flat, offsets = lists.values, lists.offsets.to_numpy()
        for i, id_ in enumerate(b.column(0).to_pylist()):
            a, z = int(offsets[i]), int(offsets[i + 1])
            if z - a < phrase:
                continue
            for s in range(a, max(a + 1, z - phrase + 1), shard_words):
                e = min(s + shard_words + phrase - 1, z)
                rows.append(len(ids))
                firsts.append(s - a)
                parts.append(flat.slice(s, e - s))
                held += e - s
                ids.append(id_)
                if held >= shard_words:
                    yield ids, np.array(rows), np.array(firsts), parts
                    ids, rows, firsts, parts, held = [], [], [], [], 0
    if ids:
        yield ids, np.array(rows), np.array(firsts), parts


def shard_indexes(docs: DataFrame, phrase: int = PHRASE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(shard binary): an FM-index for about every ``shard_words`` words of docs (id, text of plain words), with the words it knows, the
    ids of its texts, where they start, and the first word of each. Made inside the scan and written once to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows, firsts, parts in _shards(batches, shard_words, phrase):
            sizes = np.array([len(p) for p in parts])
            coded = pa.concat_arrays(parts).dictionary_encode()
            words = np.ones(int(sizes.sum()) + len(sizes), np.int64)  # 1 stands between texts
            starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
            inside = np.ones(len(words), bool)
            inside[starts + sizes] = False
            words[inside] = coded.indices.to_numpy().astype(np.int64) + 2
            known = pa.array(coded.dictionary.to_pylist(), pa.string())
            blob = pickle.dumps((FMIndex(words, len(known) + 1), known, ids, rows, firsts, starts), 5)
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["shard"])

    return materialize(docs.mapInArrow(run, "shard binary"), "shards")


def _search(phrases: np.ndarray, owners: np.ndarray, vocabulary: pa.Array):
    """A task that yields (id, item, first word, end word) of the merged occurrences. phrases: numbers into vocabulary."""
    length = phrases.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blob in (x for b in batches for x in b.column(0)):
            index, words, ids, rows, firsts, starts = pickle.loads(blob.as_py())
            known = pc.fill_null(pc.index_in(vocabulary, words), -1).to_numpy().astype(np.int64)
            usable = np.flatnonzero((known[phrases] >= 0).all(axis=1))
            if not len(usable):
                continue
            lo, hi = index.search(known[phrases[usable]] + 2)
            many = hi - lo
            if not many.sum():
                continue
            row_no = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
            where, owner = index.locate(row_no), np.repeat(owners[usable], many)
            part = np.searchsorted(starts, where, side="right") - 1
            begin = where - starts[part] + firsts[part]
            n_items = int(owners.max()) + 1
            group, a, z = merge_spans(rows[part] * n_items + owner, begin, begin + length)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[g // n_items] for g in group]), pa.array(group % n_items), pa.array(a), pa.array(z)], names=["id", "item", "first", "end"])

    return run


def leaked_spans(corpus: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                 phrase: int = PHRASE, shard_words: int = SHARD_WORDS, block_phrases: int = BLOCK_PHRASES) -> DataFrame:
    """(doc_id, item_id, first_word, end_word): merged spans of plain words of corpus texts that are phrases of an item.

    A phrase is any run of ``phrase`` plain words of an item. Each task indexes its own texts shard by shard; the indexes are
    written once and searched for all phrases of a block at once, so a larger test set costs searches, not indexing or memory.
    Items are cut into phrases by Spark and reach the tasks in blocks of about ``block_phrases`` (8 bytes a word each). Null,
    empty and short texts hold no phrase. Null ids of the corpus stay null; a repeated row counts as its own text, and the same
    span twice is one row. Extra columns are ignored.
    """
    kind, item_kind = corpus.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    spark = corpus.sparkSession
    words = items.where(F.col(item_text).isNotNull()).select(F.col(item_col).alias("item_id"), F.split(plain_text(item_text), " ").alias("w")).where(F.size("w") >= phrase)
    cut = words.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - phrase + 1), lambda i: F.array_join(F.slice("w", i, phrase), " "))).alias("phrase"))
    cut = materialize(cut.distinct(), "phrases")
    blocks = -(-cut.count() // block_phrases)
    if not blocks:
        return spark.createDataFrame([], f"doc_id {kind}, item_id {item_kind}, first_word long, end_word long")
    docs = corpus.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), plain_text(text_col).alias("text"))
    shards = shard_indexes(docs, phrase, shard_words)
    out = None
    for block in range(blocks):
        got = cut.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toPandas()
        if not len(got):
            continue
        owner, keys = pd.factorize(got["item_id"], use_na_sentinel=False)
        flat = pc.list_flatten(pc.split_pattern(pa.array(got["phrase"]), " ")).dictionary_encode()
        numbers = flat.indices.to_numpy().astype(np.int32).reshape(-1, phrase)
        hits = shards.mapInArrow(_search(numbers, owner, flat.dictionary), f"id {kind}, item long, first long, end long")
        names = spark.createDataFrame([(i, None if pd.isna(v) else v.item() if hasattr(v, "item") else v) for i, v in enumerate(keys)], f"item long, item_id {item_kind}")
        hits = hits.join(F.broadcast(names), "item").select(F.col("id").alias("doc_id"), "item_id", F.col("first").alias("first_word"), F.col("end").alias("end_word"))
        hits = materialize(hits, "hits") if blocks > 1 else hits
        out = hits if out is None else out.unionByName(hits)
    return out.distinct()


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of documents to remove, with the items they leak."""
    return leaked_spans(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, item_id) of documents that contain 13 consecutive plain words of an item."""
    return p9_spans(spark, d).select("doc_id", "item_id").distinct()


QUERIES = {"p9_found": p9_found, "p9_spans": p9_spans}


def _grams(relation: str, key: str, place: bool = True) -> str:
    return rf"""SELECT {key}{', i' if place else ''}, array_to_string(w[i:i + {PHRASE - 1}], ' ') AS g FROM (
  SELECT {key}, w, unnest(range(1, len(w) - {PHRASE - 2})) AS i FROM (
    SELECT {key}, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM {relation} WHERE text IS NOT NULL))"""


SQL = {
    "p9_found": f"SELECT DISTINCT doc_id, item_id FROM ({_grams('documents', 'doc_id')}) a JOIN ({_grams('benchmark', 'item_id')}) b USING (g)",
    "p9_spans": f"""WITH h AS (SELECT DISTINCT doc_id, item_id, i - 1 AS a FROM ({_grams('documents', 'doc_id')}) x JOIN ({_grams('benchmark', 'item_id', False)}) y USING (g)),
n AS (SELECT *, coalesce(a > lag(a) OVER w + {PHRASE}, true) AS fresh FROM h WINDOW w AS (PARTITION BY doc_id, item_id ORDER BY a)),
s AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY doc_id, item_id ORDER BY a) AS no FROM n)
SELECT doc_id, item_id, min(a) AS first_word, max(a) + {PHRASE} AS end_word FROM s GROUP BY doc_id, item_id, no""",
}
