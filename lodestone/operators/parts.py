"""Scoring of a batch of queries over one part of the documents, in arrays.

A part is the postings of some ten thousand documents. Queries are bags of weighted terms; equal ones are one bag. A bag's scores
are added up in one dense array over a slice of the part that stays in the processor's cache, and only documents that can still
be among the first k of the bag leave it. So partial scores are never rows of a table, and what leaves a part is k rows a bag.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_DOCS = 8192  # documents scored at once
DENSE = 6  # a term that more than one in so many documents of a slice hold is kept as a value for every document
HELD_VALUES = 12_000_000  # kept values of terms; beyond that they are made again
PAIRS_AT_ONCE = 4_000_000
OUT_ROWS = 50_000


def rounded(score: np.ndarray) -> np.ndarray:
    """Scores in millionths, rounded as Spark rounds to 6 decimals: halves of the decimal form away from zero. NaN is greatest."""
    wide = score * 1e6 + 0.5
    out = np.floor(wide)
    for i in np.flatnonzero(np.abs(wide - np.rint(wide)) <= 1e-9 + 1e-15 * np.abs(wide)):
        if np.isfinite(score[i]):
            out[i] = int(Decimal(repr(float(score[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP).scaleb(6))
    return np.where(np.isnan(out), np.inf, out)


def _gain(kind: str, tf: np.ndarray, figure: np.ndarray, flat: float | np.ndarray, slope: float | np.ndarray) -> np.ndarray:
    """What a posting gives a query term of weight 1. figure: for bm25 the length of the document, for tfidf its norm."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(figure > 0, (1 + np.log(tf)) / figure, 0.0) if kind == "tfidf" else tf / (tf + flat + slope * figure)


class Part:
    """Postings, which come as a row a document, in the order of (slice, term, document), documents numbered by their ids, and the bags that ask for them."""

    def __init__(self, rows: pa.Table, kind: str, width: int | None):
        self.kind = kind
        is_bag = rows["bag"].is_valid()
        posts, bags = rows.filter(pc.invert(is_bag)), rows.filter(is_bag)
        ids, lists = posts["doc_id"].combine_chunks(), posts["tids"].combine_chunks()
        order = pc.sort_indices(ids)
        self.docs = ids.take(order)
        rank = np.empty(len(ids), np.int64)
        rank[order.to_numpy()] = np.arange(len(ids))
        held = np.diff(lists.offsets.to_numpy())
        doc = np.repeat(rank, held)
        figure = np.repeat(posts["figure"].to_numpy(), held)
        term, tf = lists.flatten().to_numpy(), posts["tfs"].combine_chunks().flatten().to_numpy()
        self.width = width or max(1, len(self.docs))
        self.slices = -(-len(self.docs) // self.width)
        self.terms = np.unique(term)
        key = (doc // self.width * len(self.terms) + np.searchsorted(self.terms, term)) * self.width + doc % self.width
        order = np.argsort(key)
        self.key, self.tf, self.figure = key[order], tf[order].astype(np.float64), figure[order]
        self.bag = bags["bag"].to_numpy()
        lists = bags["terms"].combine_chunks()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        fields = [lists.values.field(n).to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] for n in ("tid", "w", "flat", "slope")] if len(bags) else [np.zeros(0)] * 4
        self.cands = bags["cands"].combine_chunks() if "cands" in bags.column_names else None
        # entries of terms that no document of the part holds are left out
        at = np.minimum(np.searchsorted(self.terms, fields[0]), max(0, len(self.terms) - 1))
        there = self.terms[at] == fields[0] if len(self.terms) else np.zeros(len(at), bool)
        owner = np.repeat(np.arange(len(self.bag)), np.diff(offsets))
        self.term, self.w, self.flat, self.slope, self.owner = at[there], fields[1][there], fields[2][there], fields[3][there], owner[there]
        self.start = np.searchsorted(self.owner, np.arange(len(self.bag) + 1))

    def _out(self, bag: np.ndarray, doc: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(bag), OUT_ROWS):
            s = slice(i, i + OUT_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(self.bag[bag[s]], pa.int64()), self.docs.take(pa.array(doc[s])), pa.array(score[s], pa.float64())], names=["bag", "doc_id", "score"])

    def first(self, k: int) -> Iterator[pa.RecordBatch]:
        """The first k documents of each bag by rounded score, then id: (bag, doc_id, score). Slices go by rising id, so a later document
        must be better than the k-th so far."""
        setting = np.unique(np.stack([self.flat, self.slope], 1), axis=0, return_inverse=True)[1].reshape(-1) if len(self.w) else np.zeros(0, np.int64)
        columns, n_settings = self.term * (int(setting.max(initial=0)) + 1) + setting, int(setting.max(initial=0)) + 1
        odd = np.zeros(len(self.bag), bool)  # bags whose documents may have a score that isn't above 0
        odd[self.owner[~((self.w > 0) & (self.flat >= 0) & (self.slope >= 0))]] = True
        firsts = np.full(len(self.bag), -1)
        firsts[self.owner[::-1]] = setting[::-1]
        turn = [i for i in np.argsort(firsts, kind="stable").tolist() if self.start[i] < self.start[i + 1]]  # bags of one setting share values
        columns_, w_, start = columns.tolist(), self.w.tolist(), self.start.tolist()
        least = np.full(len(self.bag), -np.inf)
        kept = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for s in range(self.slices):
            here = min(self.width, len(self.docs) - s * self.width)
            bounds = np.searchsorted(self.key, (s * len(self.terms) + np.arange(len(self.terms) + 1)) * self.width)
            values: dict[int, tuple] = {}
            held, score, one = 0, np.empty(here), np.empty(here)
            found: list[tuple[int, np.ndarray, np.ndarray]] = []
            n_chunks = 4 * k if here >= 16 * k else 0
            for i in turn:
                score.fill(0)
                seen = np.zeros(here, bool) if odd[i] else None
                for e in range(start[i], start[i + 1]):
                    got = values.get(c := columns_[e])
                    if got is None:
                        if held > HELD_VALUES:
                            values.clear()
                            held = 0
                        t = c // n_settings
                        a, b = bounds[t], bounds[t + 1]
                        at = self.key[a:b] % self.width
                        gain = _gain(self.kind, self.tf[a:b], self.figure[a:b], self.flat[e], self.slope[e])
                        if (b - a) * DENSE > here:
                            whole = np.zeros(here)
                            whole[at] = gain
                            got = whole, at, True
                        else:
                            got = gain, at, False
                        values[c] = got
                        held += len(got[0]) + len(at)
                    gain, at, dense = got
                    if dense:
                        np.multiply(gain, w_[e], out=one)
                        score += one
                    elif len(at):
                        score[at] += gain * w_[e]
                    if seen is not None:
                        seen[at] = True
                low = least[i]
                if seen is None:
                    low = max(low, 0.0)
                    if n_chunks and not np.isfinite(least[i]):  # k chunks hold a document of so much, so k documents do
                        tops = score[: here // n_chunks * n_chunks].reshape(n_chunks, -1).max(1)
                        kth = float(np.partition(tops, n_chunks - k)[n_chunks - k])
                        low = max(low, kth - 1.5e-6 - 1e-12 * abs(kth))
                    at = np.flatnonzero(score > low)
                else:
                    at = np.flatnonzero(seen & ~(score <= low))
                if len(at):
                    found.append((i, at + s * self.width, score[at]))
            if found:
                kept = self._kept(kept, found, k, least)
        yield from self._out(*kept)

    @staticmethod
    def _kept(kept: tuple, found: list, k: int, least: np.ndarray) -> tuple:
        """The first k of what was kept and found; ``least`` gets what a later document must be above."""
        bag = np.concatenate([kept[0], np.repeat([f[0] for f in found], [len(f[1]) for f in found])])
        doc, score = np.concatenate([kept[1], *[f[1] for f in found]]), np.concatenate([kept[2], *[f[2] for f in found]])
        millionths = rounded(score)
        order = np.lexsort((doc, -millionths, bag))
        edges = np.flatnonzero(np.diff(bag[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(edges, np.diff(np.append(edges, len(order))))
        last = order[place == k - 1]
        bound = (millionths[last] + 0.5) / 1e6
        least[bag[last]] = bound - 1e-9 - 1e-12 * np.abs(bound)
        order = order[place < k]
        return bag[order], doc[order], score[order]

    def asked(self) -> Iterator[pa.RecordBatch]:
        """The scores of each bag's candidates that hold one of its terms; all documents are one slice here."""
        if not len(self.bag) or not len(self.docs):
            return
        offsets = self.cands.offsets.to_numpy().astype(np.int64)
        where = pc.index_in(self.cands.values, value_set=self.docs)[int(offsets[0]) : int(offsets[-1])]
        doc = where.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = offsets - offsets[0]
        each = np.diff(offsets)
        made = np.concatenate([[0], np.cumsum(each * np.diff(self.start))])
        i = 0
        while i < len(self.bag):
            j = max(i + 1, int(np.searchsorted(made, made[i] + PAIRS_AT_ONCE, side="right")) - 1)
            entries = np.arange(self.start[i], self.start[j])
            n = each[self.owner[entries]]
            e = np.repeat(entries, n)
            cand = np.repeat(offsets[self.owner[entries]] - (np.cumsum(n) - n), n) + np.arange(len(e))
            key = self.term[e] * self.width + doc[cand]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = (doc[cand] >= 0) & (self.key[at] == key)
            e, cand, at = e[hit], cand[hit] - offsets[i], at[hit]
            part = self.w[e] * _gain(self.kind, self.tf[at], self.figure[at], self.flat[e], self.slope[e])
            most = int(offsets[j] - offsets[i])
            score, hits = np.bincount(cand, part, most), np.bincount(cand, minlength=most)
            got = np.flatnonzero(hits)
            yield from self._out(np.repeat(np.arange(i, j), each[i:j])[got], doc[offsets[i] : offsets[j]][got], score[got])
            i = j
