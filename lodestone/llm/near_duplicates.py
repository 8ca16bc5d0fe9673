"""Problem 5: records with small edits, by rare-first prefix filtering on n-grams of shingles.

Texts are sets of hashed shingles of k words. All sets are sorted by one order, rare shingles first. Two sets with
overlap o and H elements in only one of them share two neighbouring elements of that order, or the first element,
whenever o > H, so whenever their similarity is over one half: o elements can't be kept apart by fewer than o others.
In fact they share at least o - H such pairs. So the pairs (n-grams of the sorted set, with a mark before its first
element) are themselves sets to which prefix filtering applies: of each text's pairs, sorted by how rare they are,
only the first n - ceil(n (3t - 2 + ...)) + 1 are needed (see ``prefix_length``). Where single shingles are frequent, pairs
of them still are rare, so candidates don't grow with the square of the collection.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.leaks import plain_text
from lodestone.operators.skew import heavy_keys, skew_join
from lodestone.session import discard, freed_shuffles, materialize
from lodestone.sources.tables import known_time, table

SHINGLE, THRESHOLD, MIN_WORDS = 5, 0.8, 20
SKETCH_BITS = 20  # counts by hash: a fixed 2 ** 20 counters, whatever the size of the collection
SKETCH_ROWS = 256  # rows that carry the counters
PART_KEYS = 4_000_000  # keys brought together in one task
ROUND_BYTES = 9  # shuffled a shingle at most in one round
KEY_BYTES, OWN_BYTES = 5, 6  # of a key and its position, and of a text's number, size and number of keys
CHUNK_DOCS, CHUNK_BYTES = 4096, 2 << 20  # texts handled at once
PAIRS_AT_ONCE = 1 << 21
HOT_RUN = 8192  # a key of more texts is compared in blocks of HOT_BLOCK, spread over all tasks
HOT_BLOCK = 2048
FILTER_BITS = 22  # of the bitmap of texts that occur in candidates
SIGNATURE, SIGNED = 192, 102  # bits of the parity signature of a set of up to SIGNED elements; twice as many for each doubling

_P = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """_P ** j and its inverse, modulo 2 ** 64, for j up to n."""
    while len(_powers[0]) <= n:
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            step = np.uint64(pow(base, len(_powers[k]), 1 << 64))
            _powers[k] = np.concatenate([_powers[k], _powers[k] * step])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 47-bit hash) of every run of k words in texts of plain words with single spaces, in text order."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    full = np.flatnonzero(np.diff(offsets))
    space = np.flatnonzero(data == 32)
    starts = np.sort(np.concatenate([offsets[:-1][full], space + 1]))
    ends = np.sort(np.concatenate([offsets[1:][full], space]))
    row = full[np.searchsorted(offsets[:-1][full], starts, side="right") - 1]
    if len(starts) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    powers, inverse = _power_tables(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(data * powers[: len(data)], dtype=np.uint64)])
    a, b = starts[: len(starts) - k + 1], ends[k - 1 :]
    same = row[: len(row) - k + 1] == row[k - 1 :]
    a, b = a[same], b[same]
    return row[: len(row) - k + 1][same], mix((sums[b] - sums[a]) * inverse[a]) >> np.uint64(17)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most CHUNK_DOCS rows and about CHUNK_BYTES of text in column 1."""
    for b in batches:
        size = b.column(1).nbytes / max(1, b.num_rows)
        step = int(max(1, min(CHUNK_DOCS, CHUNK_BYTES // max(1, size))))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def _unique(row: np.ndarray, rank: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, low) without repeats, sorted by row, rank (below 32) and low (47 bits)."""
    packed = np.sort((row.astype(np.uint64) << np.uint64(52)) | (rank.astype(np.uint64) << np.uint64(47)) | low)
    if len(packed):
        packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
    return (packed >> np.uint64(52)).astype(np.int64), packed & np.uint64((1 << 47) - 1)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(47 - SKETCH_BITS)).astype(np.int64)


def sorted_sets(texts: pa.Array, k: int, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, by row and rare first: by coarse rarity class, then by hash."""
    row, h = shingles(texts, k)
    return _unique(row, rarity[_bucket(h)] // 3, h)


def neighbour_keys(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """47-bit hashes of each element with the one before it in its set, or with the mark before the first."""
    before = np.zeros_like(h)
    before[1:] = h[:-1]
    before[np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]] = np.uint64(1 << 50)
    return mix(mix(before) + h) >> np.uint64(17)


def needed_overlap(x, y, t: float):
    """The least overlap of sets of x and y elements with similarity t."""
    return np.ceil((x + y) * t / (1 + t) - 1e-9)


def prefix_length(n: np.ndarray, t: float) -> np.ndarray:
    """How many of a set's n keys must be tried. A partner of similarity t leaves a elements of this set and b of its own
    unmatched, with o = n - a and a + b <= o (1 - t) / t; the shared keys are at least o - a - b >= o (2t - 1) / t, and o >= t n."""
    return n - np.ceil(n * (2 * t - 1) - 1e-9).astype(np.int64) + 1


POSITIONS = 256  # a position is sent as its share of the set, in so many steps


def coarse_position(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (at * POSITIONS // np.maximum(size, 1)).astype(np.uint8)


def apart(p: np.ndarray, x: np.ndarray, q: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The positional filter: at least so many elements are in only one of two sets of x and y elements that share the element at the
    coarse positions p and q. Elements before it in one set can only match elements before it in the other, so those in excess
    before it, and those after it, are unmatched; a coarse position stands for a range of places."""
    low = lambda c, n: -(-(c.astype(np.int64) * n) // POSITIONS)
    high = lambda c, n: ((c.astype(np.int64) + 1) * n - 1) // POSITIONS
    i0, i1, j0, j1 = low(p, x), high(p, x), low(q, y), high(q, y)
    before = np.maximum(0, np.maximum(i0 - j1, j0 - i1))
    after = np.maximum(0, np.maximum((x - i1) - (y - j0), (y - j1) - (x - i0)))
    return before + after


def level_of(sizes: np.ndarray) -> np.ndarray:
    """The level of a set's signature."""
    return np.clip(np.ceil(np.log2(np.maximum(sizes, 1) / SIGNED)), 0, 12).astype(np.uint8)


def _least_type(most: int):
    return np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.int64


def signatures(row: np.ndarray, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(level of each set, packed bits of the sets of each level): the parity of the elements by hash modulo SIGNATURE * 2 ** level."""
    level = level_of(sizes)
    out: dict[int, np.ndarray] = {}
    for v in np.unique(level).tolist():
        at = np.flatnonzero(level == v)
        width = SIGNATURE << v
        place = np.full(len(sizes), -1)
        place[at] = np.arange(len(at))
        packed = []
        for i in range(0, len(at), step := max(1, (1 << 22) // width)):
            mine = (place[row] >= i) & (place[row] < i + step)
            n = min(step, len(at) - i)
            bits = np.bincount((place[row[mine]] - i) * width + (h[mine] % np.uint64(width)).astype(np.int64), minlength=n * width) & 1
            packed.append(np.packbits(bits.astype(bool).reshape(n, width), axis=1, bitorder="little"))
        out[v] = np.concatenate(packed)
    return level, out


class Sets:
    """Sizes and signatures of sets, for the filters on pairs. bits: packed rows of each level, in the order of the sets."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, level: np.ndarray, bits: dict[int, np.ndarray], t: float):
        self.ids, self.sizes, self.level, self.bits, self.t = ids, sizes.astype(np.int64), level, bits, t
        # A pair is compared at its lower level; a signature folds to half its width by adding its halves.
        self.by_level: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        above, above_at = np.zeros((0, 0), np.uint64), np.zeros(0, np.int64)
        for v in range(int(level.max(initial=0)), -1, -1):
            own_at, words = np.flatnonzero(level == v), (SIGNATURE << v) // 64
            own = np.ascontiguousarray(bits[v]).view(np.uint64) if v in bits else np.zeros((0, words), np.uint64)
            if len(above_at):
                own, own_at = np.concatenate([own, above[:, :words] ^ above[:, words:]]), np.concatenate([own_at, above_at])
            place = np.zeros(len(ids), np.int64)
            place[own_at] = np.arange(len(own_at))
            self.by_level[v] = place, own
            above, above_at = own, own_at

    def slim(self, at: np.ndarray) -> tuple:
        """What a task elsewhere needs to compare these sets."""
        level = self.level[at]
        return self.ids[at], self.sizes[at], level, {v: self.by_level[v][1][self.by_level[v][0][at[level == v]]].view(np.uint8) for v in np.unique(level).tolist()}

    @staticmethod
    def joined(parts: list[tuple], t: float) -> Sets:
        levels = {v for p in parts for v in p[3]}
        bits = {v: np.concatenate([p[3][v] for p in parts if v in p[3]]) for v in levels}
        return Sets(*[np.concatenate([p[i] for p in parts]) for i in range(3)], bits, t)

    def near(self, i: np.ndarray, j: np.ndarray, p: np.ndarray | None = None, q: np.ndarray | None = None) -> np.ndarray:
        """Which pairs may reach the threshold: by length, by the suffix filter on signatures (the number of elements in only one set is
        at least the number of bits in which their parities differ), which leaves fewest, then by the positions p and q of the shared key."""
        x, y = self.sizes[i], self.sizes[j]
        need = needed_overlap(x, y, self.t)
        ok = (np.minimum(x, y) >= need) & (self.ids[i] != self.ids[j])
        most, low = x + y - 2 * need, np.minimum(self.level[i], self.level[j])
        for v, (place, bits) in self.by_level.items():
            at = np.flatnonzero(ok & (low == v))
            if len(at):
                differ = np.zeros(len(at), np.int64)
                a, b = place[i[at]], place[j[at]]
                for w in range(bits.shape[1]):
                    differ += np.bitwise_count(bits[a, w] ^ bits[b, w])
                ok[at] = differ <= most[at]
        if p is not None:
            at = np.flatnonzero(ok)
            ok[at] = apart(p[at], x[at], q[at], y[at]) <= most[at]
        return ok


def _pairs(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for j in first[i] .. first[i] + count[i] - 1, some PAIRS_AT_ONCE at a time."""
    total = np.cumsum(count)
    a = 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS_AT_ONCE, side="right")))
        n = count[a:b]
        i = np.repeat(np.arange(a, b), n)
        yield i, np.repeat(first[a:b] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        a = b


_MET = ["a", "b", "run", "no", "least", "most", "blob"]


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=_MET)


def _emit(sets: Sets, i: np.ndarray, j: np.ndarray, seen: list[np.ndarray], p: np.ndarray | None = None, q: np.ndarray | None = None) -> None:
    ok = sets.near(i, j, p, q)
    x, y = sets.ids[i[ok]], sets.ids[j[ok]]
    if len(x):
        seen.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0))


def _flushed(seen: list[np.ndarray], at_least: int) -> Iterator[pa.RecordBatch]:
    if sum(map(len, seen)) > at_least:
        got = np.unique(np.concatenate(seen), axis=0)
        seen.clear()
        for i in range(0, len(got), 50_000):
            yield _pair_batch(got[i : i + 50_000, 0], got[i : i + 50_000, 1])


def _count_sketch(texts: DataFrame, value) -> np.ndarray:
    """2 ** SKETCH_BITS counts over all texts of the buckets that ``value(text array)`` gives: one array per task, cut in
    SKETCH_ROWS rows, summed by row as they stream in. Only the sums, of fixed size, reach the driver."""
    width = (1 << SKETCH_BITS) // SKETCH_ROWS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros(1 << SKETCH_BITS, np.int64), False
        for b in _chunks(batches):
            total += np.bincount(_bucket(value(b.column(1))), minlength=1 << SKETCH_BITS)
            any_ = True
        if any_:
            rows = total.reshape(SKETCH_ROWS, width)
            small = rows.astype(np.int32) if total.max() < 2**31 else rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SKETCH_ROWS), pa.int32()), pa.array([r.tobytes() for r in small], pa.binary())], names=["row", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for r, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[r] = total.get(r, 0) + np.frombuffer(c, np.int32 if len(c) == 4 * width else np.int64).astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["row", "counts"])

    parts = min(SKETCH_ROWS, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    with freed_shuffles(texts.sparkSession):
        sums = texts.mapInArrow(count, "row int, counts binary").repartition(parts, "row").mapInArrow(add, "row int, counts binary").collect()
    out = np.zeros((SKETCH_ROWS, width), np.int64)
    for r in sums:
        out[r["row"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


def _classes(counts: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(counts, 1)).astype(np.uint8)


def rounds_of(texts: int, elements: int, signed: int, parts: int, t: float, most: float) -> int:
    """In how many rounds to send the keys of so many texts of so many elements in all, so that none sends more than ``most`` bytes.
    A text sends its keys and, to each part that gets any of them, its signature (``signed`` bytes for all texts together): the more
    parts, the more signatures."""
    keys = 2 * (1 - t) * elements / max(1, texts) + 1
    rounds = 1
    while True:
        met, mine = ceil_parts(parts, rounds), keys / rounds
        if rounds >= keys or texts * mine * KEY_BYTES + signed * met * (1 - (1 - 1 / met) ** mine) <= most:
            return rounds
        rounds += 1


def ceil_parts(parts: int, rounds: int) -> int:
    return max(1, -(-parts // rounds))


def similar_pairs(texts: DataFrame, k: int = SHINGLE, t: float = THRESHOLD, part_keys: int = PART_KEYS, hot_run: int = HOT_RUN, round_bytes: float = ROUND_BYTES) -> DataFrame:
    """(a, b, similarity) of all pairs a < b of texts (id long, words string) whose sets of k-word shingles have a Jaccard
    similarity of at least t (over one half). words: plain words with single spaces, ids unique, no null.

    Every pair over the threshold comes out: keys, lengths and signatures only drop pairs that can't reach it, and each
    candidate is verified once on its whole texts. Texts of fewer than k words have no shingle and no partner. Keys that would
    take more than ``round_bytes`` of shuffle a shingle are met in rounds, a slice of them each, and made again for each.
    """
    if not 0.5 < t <= 1:
        raise ValueError("the threshold must be over one half")
    spark = texts.sparkSession
    counts = _count_sketch(texts, lambda x: shingles(x, k)[1])
    rarity = _classes(counts)
    key_rarity = _classes(_count_sketch(texts, lambda x: neighbour_keys(*sorted_sets(x, k, rarity))))
    elements = int(counts.sum())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(elements / part_keys))
    size = F.length("words") - F.length(F.translate("words", " ", "")) + 2 - k  # of the set, if no shingle repeats
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1)) / SIGNED)))
    n, signed = texts.agg(F.count(F.lit(1)), F.sum(F.pow(F.lit(2.0), level) * (SIGNATURE // 8) + OWN_BYTES)).first()
    rounds = rounds_of(n, elements, signed or 0, parts, t, round_bytes * elements)
    parts = ceil_parts(parts, rounds)  # of a round
    slices = np.uint64(parts * rounds)

    def keys(turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            ids = b.column(0).to_numpy()
            row, h = sorted_sets(b.column(1), k, rarity)
            sizes = np.bincount(row, minlength=len(ids))
            level, signs = signatures(row, h, sizes)
            place = np.zeros(len(ids), np.int64)
            for v in signs:
                place[level == v] = np.arange(len(signs[v]))
            key = neighbour_keys(row, h)
            at = coarse_position(np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row], sizes[row])
            # by row, rare first; elements are distinct, so are a set's keys but for chance
            rarest = np.argsort((row.astype(np.uint64) << np.uint64(52)) | (key_rarity[_bucket(key)].astype(np.uint64) << np.uint64(47)) | key)
            row, key, at = row[rarest], key[rarest], at[rarest]
            take = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row] < prefix_length(sizes, t)[row]
            if rounds > 1:
                take &= key % slices % np.uint64(rounds) == turn
            row, key, at = row[take], key[take], at[take]
            part = (key % slices // np.uint64(rounds)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            row, part, at = row[order], part[order], at[order]
            short = ((key[order] // slices) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=parts + 1))
            blobs = []
            for a, z in zip(edges[:-1], edges[1:]):
                own, many = np.unique(row[a:z], return_counts=True)  # keys are still sorted by row inside a part
                mine, least = level[own], int(ids[own].min())
                number = (ids[own] - least).astype(_least_type(int(ids[own].max()) - least))
                bits = {v: signs[v][place[own[mine == v]]] for v in np.unique(mine).tolist()}
                blobs.append(pickle.dumps((least, number, sizes[own].astype(_least_type(int(sizes[own].max()))), bits, many.astype(_least_type(int(many.max()))), short[a:z], at[a:z]), 5))
            if blobs:
                yield pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def meet(turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list] = {}
        for b in batches:
            for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by_part.setdefault(p, []).append(pickle.loads(blob))
        for part, blobs in by_part.items():
            sets = Sets.joined([(x[1].astype(np.int64) + x[0], x[2].astype(np.int64), level_of(x[2].astype(np.int64)), x[3]) for x in blobs], t)
            key = np.concatenate([x[5] for x in blobs]).astype(np.uint64)
            doc = np.repeat(np.arange(len(sets.ids)), np.concatenate([x[4] for x in blobs]))
            place = np.concatenate([x[6] for x in blobs])
            size = np.minimum(sets.sizes, (1 << 32) - 1).astype(np.uint64)
            both = (key << np.uint64(32)) | size[doc]
            order = np.argsort(both)
            both, doc, place = both[order], doc[order], place[order]
            key = both >> np.uint64(32)
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            run = np.diff(np.append(start, len(key)))
            hot, hot_runs = np.repeat(run > hot_run, run), [(s, n) for s, n in zip(start[run > hot_run], run[run > hot_run])]
            at = np.flatnonzero(np.repeat(run > 1, run) & ~hot)
            # of the texts before with the same key, those not too short: the length filter, by search in (key, size)
            least = np.ceil(size[doc[at]].astype(np.float64) * t - 1e-9).astype(np.uint64)
            low = np.searchsorted(both, (key[at] << np.uint64(32)) | least)
            seen: list[np.ndarray] = []
            for i, j in _pairs(low, at - low):
                _emit(sets, doc[at[i]], doc[j], seen, place[at[i]], place[j])
                yield from _flushed(seen, 1_000_000)
            yield from _flushed(seen, 0)
            for s, n in hot_runs:  # each block once; which of them meet is Spark's to say
                for no, i in enumerate(range(s, s + n, HOT_BLOCK)):
                    cut = slice(i, min(i + HOT_BLOCK, s + n))
                    own = sets.sizes[doc[cut]]
                    blob = pickle.dumps((sets.slim(doc[cut]), place[cut]), 5)
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([((part * rounds + turn) << 32) | int(key[s])], pa.int64()), pa.array([no], pa.int32()), pa.array([int(own.min())], pa.int64()), pa.array([int(own.max())], pa.int64()), pa.array([blob], pa.binary())], names=_MET)

    def meet_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for left, right in zip(b.column(0), b.column(1)):
                (x, p), (y, q) = pickle.loads(left.as_py()), pickle.loads(right.as_py())
                sets, seen = Sets.joined([x, y], t), []
                for i, j in _pairs(np.full(len(x[0]), len(x[0])), np.full(len(x[0]), len(y[0]))):
                    _emit(sets, i, j, seen, p[i], q[j - len(x[0])])
                yield from _flushed(seen, 0)

    met_kind = "a long, b long, run long, no int, least long, most long, blob binary"
    turns = []
    for turn in range(rounds):  # the shuffle of a round is gone before the next
        sent = texts.mapInArrow(partial(keys, turn), "part int, blob binary").repartitionById(parts, F.col("part"))
        turns.append(materialize(sent.mapInArrow(partial(meet, turn), met_kind), "met"))
    met = reduce(DataFrame.unionByName, turns)
    blocks = met.where("blob is not null")
    # blocks of a key's texts, in order of size: those meet whose lengths may match
    one, two = (blocks.select("run", F.col("no").alias(f"{c}_no"), F.col("least").alias(f"{c}_least"), F.col("most").alias(f"{c}_most")) for c in "xy")
    meeting = one.join(two, "run").where((F.col("x_no") <= F.col("y_no")) & (F.col("x_most") >= F.lit(t) * F.col("y_least"))).select("run", "x_no", "y_no")
    blobs = lambda c: blocks.select("run", F.col("no").alias(f"{c}_no"), F.col("blob").alias(f"{c}_blob"))
    pairs = meeting.join(blobs("x"), ["run", "x_no"]).join(blobs("y"), ["run", "y_no"]).select("x_blob", "y_blob")
    candidates = met.where("blob is null").select("a", "b")
    if not blocks.isEmpty():
        candidates = candidates.unionByName(pairs.repartition(parts).mapInArrow(meet_blocks, met_kind).select("a", "b"))
    candidates = materialize(candidates.distinct(), "candidates")
    discard(*turns)

    # Only texts in candidates are moved: a bitmap of their ids, of fixed size, drops most others at the scan.
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    bits = candidates.select(F.explode(F.array("a", "b")).alias("id")).select(spot("id").alias("bit")).distinct()
    rows = bits.groupBy(F.shiftright("bit", 15).alias("w")).agg(F.expr("bitmap_construct_agg(bit & 32767)").alias("m")).collect()
    bitmap = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in rows:
        bitmap[r["w"] * 4096 : (r["w"] + 1) * 4096] = np.frombuffer(r["m"], np.uint8)

    @F.pandas_udf("boolean")
    def listed(s):
        v = s.to_numpy()
        return s.map(lambda _: True) if not len(v) else s.__class__((bitmap[v >> 3] >> (v & 7) & 1).astype(bool))

    some = texts.where(listed(spot("id")))
    # a text in very many candidates is salted
    joined = skew_join(candidates, some.select(F.col("id").alias("a"), F.col("words").alias("x")), "a", "inner", heavy_keys(candidates, "a"), ["b"])
    joined = skew_join(joined, some.select(F.col("id").alias("b"), F.col("words").alias("y")), "b", "inner", heavy_keys(candidates, "b"), ["a"]).select("a", "b", "x", "y")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                n = b.num_rows
                zero = np.zeros(1 << SKETCH_BITS, np.uint8)
                (rx, hx), (ry, hy) = sorted_sets(b.column(2), k, zero), sorted_sets(b.column(3), k, zero)
                packed = np.sort(np.concatenate([(r.astype(np.uint64) << np.uint64(47)) | h for r, h in ((rx, hx), (ry, hy))]))
                common = np.bincount((packed[1:][packed[1:] == packed[:-1]] >> np.uint64(47)).astype(np.int64), minlength=n)
                union = np.bincount(rx, minlength=n) + np.bincount(ry, minlength=n) - common
                sim = common / np.maximum(union, 1)
                ok = common >= t * union - 1e-9
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok)), pa.array(sim[ok])], names=["a", "b", "similarity"])

    return joined.mapInArrow(verify, "a long, b long, similarity double")


def current_classes(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(doc_rowid, rep) of current docs of at least ``min_words`` plain words, rep the least doc_rowid with the same plain
    words; and (id, words) of each rep. Only hashes are compared to find them; texts are moved once, copies combined before."""
    rows = docs.where("doc_rowid is not null").select("doc_rowid", known_time("ingested_at").alias("at"), plain_text("raw_text").alias("words"))
    enough = F.size(F.split("words", " ")) >= min_words
    digest = F.unhex(F.md5("words"))
    latest = rows.select("doc_rowid", "at", F.when(enough, digest).alias("h")).groupBy("doc_rowid").agg(F.max(F.struct("at", "h")).alias("v"))
    current = materialize(latest.select("doc_rowid", F.col("v.h").alias("h")).where("h is not null"), "current")
    classes = current.groupBy("h").agg(F.min("doc_rowid").alias("rep"))
    members = materialize(skew_join(current, classes, "h", "inner", heavy_keys(current, "h"), ["doc_rowid"]).select("doc_rowid", "rep"), "members")
    words = rows.where(enough).select(digest.alias("h"), "words").groupBy("h").agg(F.first("words").alias("words"))
    texts = materialize(words.join(classes, "h").select(F.col("rep").alias("id"), "words"), "texts")
    discard(current)
    return members, texts


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    """Each current doc of 20 plain words or more, with the representative of the docs with the same plain words."""
    return current_classes(table(spark, d, "docs"))[0]


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of representatives with similar sets of 3-word shingles, and their similarity."""
    return similar_pairs(current_classes(table(spark, d, "docs"))[1], 3, 0.6).withColumn("similarity", F.round("similarity", 6))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of current docs with a similarity of at least 0.60 (3-word shingles): similar representatives with all their
    members, and members of one class with each other."""
    members, texts = current_classes(table(spark, d, "docs"))
    pairs = similar_pairs(texts, 3, 0.6).select("a", "b")
    pairs = pairs.unionByName(members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    x = members.select(F.col("doc_rowid").alias("x"), F.col("rep").alias("a"))
    y = members.select(F.col("doc_rowid").alias("y"), F.col("rep").alias("b"))
    one = materialize(skew_join(x, pairs, "a", "inner", heavy_keys(x, "a"), ["x"]), "one_side")  # classes with many members are salted
    both = skew_join(one, y, "b", "inner", heavy_keys(one, "b"), ["x", "a"]).where("a <> b or x < y")
    return both.select(F.least("x", "y").alias("doc_rowid_a"), F.greatest("x", "y").alias("doc_rowid_b"))


QUERIES = {"p5_found": p5_found, "p5_pairs": p5_pairs, "p5_members": p5_members}
_CUR = r"""cur AS (
  SELECT doc_rowid, trim(regexp_replace(lower(raw_text), '[^a-z0-9]+', ' ', 'g')) AS t, string_split(t, ' ') AS w FROM docs WHERE doc_rowid IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_rowid ORDER BY ingested_at DESC NULLS LAST) = 1)"""


def _similar_sql(source: str) -> str:
    """CTEs up to c (x, y, o) and n (doc_rowid, n) over texts of ``source`` (doc_rowid, w)."""
    return f"""s AS (SELECT DISTINCT doc_rowid, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_rowid, w, unnest(range(1, len(w) - 1)) AS i FROM {source} WHERE len(w) >= 20)),
n AS (SELECT doc_rowid, count(*) AS n FROM s GROUP BY doc_rowid),
c AS (SELECT a.doc_rowid AS x, b.doc_rowid AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_rowid < b.doc_rowid GROUP BY ALL)"""


_JOINED = "FROM c JOIN n nx ON nx.doc_rowid = x JOIN n ny ON ny.doc_rowid = y WHERE o >= 0.6 * (nx.n + ny.n - o) - 1e-9"
SQL = {
    "p5_found": f"WITH {_CUR}, {_similar_sql('cur')} SELECT x AS doc_rowid_a, y AS doc_rowid_b {_JOINED}",
    "p5_members": f"WITH {_CUR} SELECT doc_rowid, min(doc_rowid) OVER (PARTITION BY t) AS rep FROM cur WHERE len(w) >= 20",
    "p5_pairs": f"WITH {_CUR}, reps AS (SELECT min(doc_rowid) AS doc_rowid, any_value(w) AS w FROM cur GROUP BY t), {_similar_sql('reps')} SELECT x AS a, y AS b, round(o / (nx.n + ny.n - o), 6) AS similarity {_JOINED}",
}
