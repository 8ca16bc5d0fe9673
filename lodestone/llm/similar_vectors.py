"""Problem 2: the most similar vectors of every vector, by score-aware anisotropic quantisation and exact reranking.

Equal vectors are searched for once: the first of their rows stands for all, and brings the others along as neighbours.
The collection is cut into leaves around centroids, and leaves near each other form regions, one task each. Inside its leaf each
vector is stored as packed four-bit codes, one per few dimensions, chosen to keep the error parallel to the vector small (it
is that part that changes inner products). A region is sent the leaves its rows look into. A row scans their codes by adding up
entries of its own integer tables; a few dozen of the best are compared exactly, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import md5
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.session import discard, freed_shuffles, materialize
from lodestone.sources.tables import table

TRAIN_ROWS, TRAIN_PER_LEAF = 20_000, 8  # the sample per model on which centroids and codes are fitted: so many rows, or so many a leaf if that is more
LEAF_ROWS = 400  # vectors per leaf aimed at
MAX_LEAVES = 50_000  # so the sample has at most 400,000 rows; beyond 20 million vectors of a model leaves would grow
FULL = 3  # a leaf of more than so many times the rows aimed at is cut by centroids of its own
PROBES = 28  # leaves a row looks into at least; twice the square root of their number if that is more
REGION_ROWS = 24_000  # rows that search together in one task
ROUND_COPIES = 1.5  # copies of the vectors that are shuffled at once, on average: regions search in rounds
PER_LEAF, RERANK = 32, 160  # the best by codes of each leaf, and of all leaves, that are compared exactly
QUERY_BLOCK, ROW_BITS = 2048, 11  # rows that search at once, and bits of the number of codes that are scanned at once
ROW_BLOCK = 1 << ROW_BITS
THRESHOLD = 0.2  # inner products from which errors matter: gives the weight of the parallel error
CODES = 16  # four bits
SUB = 2  # dimensions per code
SAME = 1e-6  # centroids whose cosine falls short of 1 by less are one place
_LOWEST = np.int16(-32768)


@dataclass
class Quantiser:
    centroids: np.ndarray  # (leaves, dim)
    tables: np.ndarray  # (codes per vector, CODES, SUB)
    eta: float
    sizes: np.ndarray | None = None  # rows of the sample in each leaf

    def leaves(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Numbers of the nearest leaves, nearest first."""
        n = min(probes, len(self.centroids))
        out = np.empty((len(x), n), np.int32)
        step = max(1, (1 << 23) // len(self.centroids))
        for a in range(0, len(x), step):
            score = x[a : a + step] @ self.centroids.T
            near = np.argpartition(-score, n - 1, axis=1)[:, :n]
            out[a : a + step] = np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, 1), axis=1, kind="stable"), 1)
        return out

    def encode(self, x: np.ndarray, leaf: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (n, m), two sweeps of coordinate descent on |e|^2 + (eta - 1) <e, x>^2, e the error of the residual."""
        return _encode(_cut(x - self.centroids[leaf]), _cut(x), self.tables, self.eta, sweeps)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        got = self.tables[np.arange(self.tables.shape[0]), codes]
        return got.reshape(len(codes), -1)

    def integer_tables(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes per vector, CODES, n) int16 entries and each row's scale: sums over all codes, and a product with a centroid in
        the same scale, stay inside int16."""
        exact = np.einsum("nms,mks->mkn", _cut(x), self.tables)
        scale = 32_000 / (np.abs(exact).max(1).sum(0) + 1)
        return np.rint(exact * scale).astype(np.int16), scale


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte."""
    codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return codes[:, 0::2] | (codes[:, 1::2] << 4)


def unpacked(bytes_: np.ndarray, m: int) -> np.ndarray:
    return np.stack([bytes_ & 15, bytes_ >> 4], 2).reshape(len(bytes_), -1)[:, :m]


def _cut(x: np.ndarray) -> np.ndarray:
    """(n, m, SUB), padded with zeros."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % SUB))).reshape(len(x), -1, SUB)


def _encode(r: np.ndarray, x: np.ndarray, tables: np.ndarray, eta: float, sweeps: int) -> np.ndarray:
    n, m, _ = r.shape
    codes = np.empty((n, m), np.uint8)
    for j in range(m):
        codes[:, j] = ((r[:, j, None] - tables[j]) ** 2).sum(2).argmin(1)
    err = r - tables[np.arange(m), codes]
    along = (err * x).sum(2)
    total = along.sum(1)
    for _ in range(sweeps):
        for j in range(m):
            e = r[:, j, None] - tables[j]
            part = np.einsum("nks,ns->nk", e, x[:, j])
            cost = (e**2).sum(2) + (eta - 1) * ((total - along[:, j])[:, None] + part) ** 2
            codes[:, j] = cost.argmin(1)
            new = part[np.arange(n), codes[:, j]]
            total += new - along[:, j]
            along[:, j] = new
    return codes


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the product with it."""
    own, score = np.empty(len(x), np.int64), np.empty(len(x), x.dtype)
    step = max(1, (1 << 23) // max(1, len(centroids)))
    for a in range(0, len(x), step):
        s = x[a : a + step] @ centroids.T
        own[a : a + step] = s.argmax(1)
        score[a : a + step] = s.max(1)
    return own, score


def _apart(centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids without those that nearly equal an earlier one."""
    repeats = np.zeros(len(centroids), bool)
    for a in range(0, len(centroids), 512):
        near = centroids[a : a + 512] @ centroids.T > 1 - SAME
        repeats[a : a + 512] = near.argmax(1) < np.arange(a, a + len(near))
    return np.flatnonzero(~repeats)


def k_means(x: np.ndarray, leaves: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """Spherical k-means. It starts at distinct vectors; after each round centroids without rows or equal to another move to the
    distinct rows worst served, and those left in the end are dropped. So every centroid has rows of x, and no two are the same."""
    distinct = np.sort(np.unique(np.round(x, 3), axis=0, return_index=True)[1])
    leaves = max(1, min(leaves, len(distinct)))
    centroids = x[rng.choice(distinct, leaves, replace=False)].copy()
    for i in range(rounds):
        own, score = _nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centroids)
        idle = np.setdiff1d(np.arange(leaves), np.intersect1d(_apart(centroids), own))
        if len(idle) and i < rounds - 1:
            far = distinct[np.argsort(score[distinct], kind="stable")][: len(idle)]
            centroids[idle[: len(far)]] = x[far]
    centroids = centroids[_apart(centroids)]
    return centroids[np.unique(_nearest(x, centroids)[0])]  # centroids that have a row keep it when empty ones go


def fit(x: np.ndarray, leaves: int, seed: int = 7, rounds: int = 8) -> Quantiser:
    """Centroids, then code tables by alternating codes and weighted least squares. Leaves that hold more than FULL times their share
    of the rows, as dense places do, are cut by centroids of their own."""
    rng = np.random.default_rng(seed)
    n, dim = x.shape
    centroids = k_means(x, leaves, rng, rounds)
    own, _ = _nearest(x, centroids)
    count, share = np.bincount(own, minlength=len(centroids)), n / max(1, leaves)
    if (full := np.flatnonzero(count > FULL * share)).size:
        inner = [k_means(x[own == c], ceil(count[c] / share), rng, rounds) for c in full]
        centroids = np.concatenate([np.delete(centroids, full, 0), *inner])
        centroids = centroids[_apart(centroids)]
        centroids = centroids[np.unique(_nearest(x, centroids)[0])]
        own, _ = _nearest(x, centroids)
    r, cut = _cut(x - centroids[own]), _cut(x)
    m = r.shape[1]
    eta = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    tables = np.stack([r[rng.choice(n, CODES, replace=n < CODES), j] for j in range(m)])
    for _ in range(rounds):  # plain k-means to begin with
        for j in range(m):
            c = ((r[:, j, None] - tables[j]) ** 2).sum(2).argmin(1)
            count = np.bincount(c, minlength=CODES)
            for s in range(SUB):
                mean = np.bincount(c, r[:, j, s], CODES) / np.maximum(count, 1)
                tables[j, :, s] = np.where(count > 0, mean, tables[j, :, s])
    for _ in range(3):
        codes = _encode(r, cut, tables, eta, 1)
        along = ((r - tables[np.arange(m), codes]) * cut).sum(2)
        total = along.sum(1)
        for j in range(m):
            xs, outer = cut[:, j], np.einsum("na,nb->nab", cut[:, j], cut[:, j])
            rest = total - along[:, j] + (r[:, j] * xs).sum(1)  # <error, x> if this code were zero
            for k in range(CODES):
                at = codes[:, j] == k
                if at.any():
                    left = at.sum() * np.eye(SUB) + (eta - 1) * outer[at].sum(0)
                    right = r[at, j].sum(0) + (eta - 1) * (xs[at] * rest[at, None]).sum(0)
                    tables[j, k] = np.linalg.solve(left + 1e-9 * np.eye(SUB), right)
            new = ((r[:, j] - tables[j, codes[:, j]]) * xs).sum(1)
            total += new - along[:, j]
            along[:, j] = new
    return Quantiser(centroids.astype(np.float32), tables.astype(np.float32), eta, np.bincount(own, minlength=len(centroids)))


def regions_of(centroids: np.ndarray, sizes: np.ndarray, many: int) -> np.ndarray:
    """A region for each leaf: the leaves are halved ``many`` - 1 times along the axis of their greatest spread, with even rows."""
    out, parts = np.zeros(len(centroids), np.int32), [(np.arange(len(centroids)), many)]
    made = 0
    while parts:
        at, n = parts.pop()
        if n <= 1 or len(at) < 2:
            out[at] = made
            made += 1
            continue
        x = centroids[at] - np.average(centroids[at], axis=0, weights=sizes[at] + 1e-9)
        order = np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")
        filled, left = np.cumsum(sizes[at][order]), n // 2
        cut = int(np.clip(np.searchsorted(filled, filled[-1] * left / n) + 1, 1, len(at) - 1))
        parts += [(at[order[:cut]], left), (at[order[cut:]], n - left)]
    return out


def probes_of(leaves: int) -> int:
    """Leaves a row looks into where there are so many: a fixed number would lose more and more as they grow."""
    return max(PROBES, ceil(2 * sqrt(leaves)))


def search_region(q: Quantiser, ask: np.ndarray, near: np.ndarray, x: np.ndarray, leaf: np.ndarray, codes: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, cosines) (len(ask), k) of the best rows for the rows ``ask`` of x, -1 where there are fewer. x holds raw vectors
    in order of their leaves, codes (n, m) their codes, ``near`` the leaves each row of ask looks into.

    The scan adds one int16 table entry per code for all rows that look into a leaf at once: an entry's row of the table holds
    the values of all of them side by side.
    """
    norms = np.linalg.norm(x.astype(np.float64), axis=1)
    unit = (x[ask] / norms[ask, None]).astype(np.float32)
    first = np.searchsorted(leaf, np.arange(len(q.centroids) + 1))
    best_at, best = np.full((len(ask), k), -1, np.int64), np.full((len(ask), k), -np.inf)
    for a in range(0, len(ask), QUERY_BLOCK):
        u, own = unit[a : a + QUERY_BLOCK], near[a : a + QUERY_BLOCK]
        tables, scale = q.integer_tables(u)
        score, at = np.full((*own.shape, PER_LEAF), _LOWEST), np.full((*own.shape, PER_LEAF), -1, np.int64)
        flat = own.ravel()
        order = np.argsort(flat, kind="stable")
        edges = np.flatnonzero(np.diff(flat[order], prepend=-1, append=len(q.centroids)))
        for s, e in zip(edges[:-1], edges[1:]):
            c = int(flat[order[s]])
            if first[c] == first[c + 1]:
                continue
            row, slot = np.divmod(order[s:e], own.shape[1])
            mine = np.ascontiguousarray(tables[:, :, row])
            base = np.rint((u[row] @ q.centroids[c]) * scale[row]).astype(np.int16)
            for z in range(first[c], first[c + 1], ROW_BLOCK):
                block = codes[z : min(z + ROW_BLOCK, first[c + 1])]
                total = np.repeat(base[None], len(block), 0)
                for j in range(block.shape[1]):
                    total += mine[j].take(block[:, j], axis=0)
                n = min(PER_LEAF, len(block))
                # the place in the block goes into the low bits, so that one partition of plain numbers gives both
                key = (np.ascontiguousarray(total.T).astype(np.int32) << ROW_BITS) | np.arange(len(block), dtype=np.int32)
                key = np.partition(key, len(block) - n, axis=1)[:, len(block) - n :]
                got, where = (key >> ROW_BITS).astype(np.int16), (key & (ROW_BLOCK - 1)) + z
                if z > first[c]:  # a leaf of several blocks: keep the best of both
                    got, where = np.concatenate([score[row, slot], got], 1), np.concatenate([at[row, slot], where], 1)
                    keep = np.argpartition(got, got.shape[1] - PER_LEAF, axis=1)[:, -PER_LEAF:]
                    got, where, n = np.take_along_axis(got, keep, 1), np.take_along_axis(where, keep, 1), PER_LEAF
                score[row, slot, :n], at[row, slot, :n] = got, where
        score, at = score.reshape(len(u), -1), at.reshape(len(u), -1)
        n = min(RERANK, score.shape[1])
        top = np.take_along_axis(at, np.argpartition(score, score.shape[1] - n, axis=1)[:, -n:], 1)
        for z in range(0, len(u), 256):
            rows, cand = ask[a + z : a + min(z + 256, len(u))], top[z : z + 256]
            exact = np.einsum("qd,qnd->qn", x[rows].astype(np.float64), x[cand].astype(np.float64)) / (norms[rows][:, None] * norms[cand])
            exact[(cand < 0) | (cand == rows[:, None])] = -np.inf
            o = np.lexsort((ids[cand], -exact), axis=1)[:, :k]
            best[a + z : a + z + len(rows), : o.shape[1]] = np.take_along_axis(exact, o, 1)
            best_at[a + z : a + z + len(rows), : o.shape[1]] = np.take_along_axis(cand, o, 1)
    return np.where(np.isfinite(best), best_at, -1), best


_KNOWN = ("vec is not null and size(vec) > 0 and size(vec) = dim and vec_row is not null and model is not null "
          "and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0)")


def usable(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, ids): rows (space, same, vec and more) with the raw vector as bytes, and ids (model, vec_row, doc_id, space, same), one per
    (model, vec_row): of several the one with the greatest ``same``, then doc_id. Usable are rows whose vec is as long as dim,
    finite, without nulls and not all zero. space is model and length, same a fingerprint of the direction."""

    def prints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for space, g in f.groupby("space", sort=False):
                x = np.stack(g["vec"].to_numpy()).astype(np.float32)
                wide = x.astype(np.float64)
                unit = (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32) + np.float32(0)  # -0.0 is 0.0
                yield pd.DataFrame({"model": g["model"].to_numpy(), "space": space, "vec_row": g["vec_row"].to_numpy(), "doc_id": g["doc_id"].to_numpy(),
                                    "same": [md5(v.tobytes()).digest() for v in unit], "vec": [v.tobytes() for v in x]})

    known = vectors.where(F.expr(_KNOWN)).select("model", F.concat_ws("/", "model", F.size("vec")).alias("space"), "vec_row", F.col("doc_id").cast("string").alias("doc_id"), "vec")
    rows = materialize(known.mapInPandas(prints, "model string, space string, vec_row long, doc_id string, same binary, vec binary"), "prints")
    ids = rows.groupBy("model", "vec_row").agg(F.max(F.struct("same", "space", "doc_id")).alias("v")).select("model", "vec_row", "v.doc_id", "v.space", "v.same")
    return rows, materialize(ids, "ids")


def _matrix(v) -> np.ndarray:
    return np.frombuffer(b"".join(v), np.float32).reshape(len(v), -1)


def _units(v) -> np.ndarray:
    x = _matrix(v).astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def neighbours(vectors: DataFrame, k: int = 10, probes: int | None = None, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(model, vec_row, doc_id, neighbour, cosine): for every usable row the k rows of the same model and length with the greatest
    cosine.

    Fewer where the model has fewer other rows in the leaves looked into; ties by smaller vec_row. Rows repeated with
    one vec_row count once, unusable rows not at all, and equal vectors under different vec_rows are neighbours: they are
    stored and asked for once, as the smallest vec_row with the next k, so a large group of copies costs no more than one row.
    Centroids and tables are fitted on a sample of distinct vectors of each model, chosen by a hash (TRAIN_ROWS, or
    TRAIN_PER_LEAF a leaf); every row is stored and every row is a query. Each vector is sent once to each region that looks into
    its leaf, with its codes; rows that search aren't sent again, they come with their own leaf.
    """
    spark = vectors.sparkSession
    prints, ids = usable(vectors)
    rows = prints.select("space", "same", "vec")
    counts = {r["space"]: r["n"] for r in ids.select("space", "same").distinct().groupBy("space").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return spark.createDataFrame([], "model string, vec_row long, doc_id string, neighbour long, cosine double")
    cores = spark.sparkContext.defaultParallelism
    fitted: dict[str, Quantiser] = {}
    region: dict[str, np.ndarray] = {}
    n_regions = 0
    for space, n in sorted(counts.items()):
        leaves = min(MAX_LEAVES, max(1, round(n / leaf_rows)))
        share = min(1.0, max(TRAIN_ROWS, TRAIN_PER_LEAF * leaves) / n)
        some = rows.where((F.col("space") == space) & (F.pmod(F.xxhash64("same"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
        sample = _units(some.groupBy("same").agg(F.first("vec").alias("vec")).orderBy("same").select("vec").toPandas()["vec"])
        fitted[space] = fit(sample, min(leaves, max(1, len(sample) // 4)))
        many = max(ceil(n / REGION_ROWS), round(cores * n / sum(counts.values())))
        region[space] = regions_of(fitted[space].centroids, fitted[space].sizes, many) + n_regions
        n_regions = int(region[space].max()) + 1
    first = Window.partitionBy("space", "same").orderBy("vec_row")  # cut to k + 1 rows a group before the shuffle
    copies = ids.select("space", "same", "vec_row").withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1).groupBy("space", "same").agg(
        F.sort_array(F.collect_list("vec_row")).alias("copies"))
    heads = rows.groupBy("space", "same").agg(F.first("vec").alias("vec")).join(copies, ["space", "same"])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        looked: dict[str, np.ndarray] = {}  # region * leaves + leaf of the leaves that the task's regions look into
        for f in frames:
            for space, g in f.groupby("space", sort=False):
                q, x = fitted[space], _units(g["vec"])
                near = q.leaves(x, probes or probes_of(len(q.centroids)))
                own = region[space][near[:, 0]]
                codes = packed(q.encode(x, near[:, 0]))
                pairs = np.unique(own[:, None].astype(np.int64) * len(q.centroids) + near)
                looked[space] = np.union1d(looked[space], pairs) if space in looked else pairs
                yield pd.DataFrame({"space": space, "leaf": near[:, 0], "region": own, "probes": None, "same": g["same"], "codes": [c.tobytes() for c in codes], "copies": g["copies"], "vec": g["vec"]})
        for space, pairs in looked.items():
            at, leaf = np.divmod(pairs, len(fitted[space].centroids))
            edges = np.flatnonzero(np.diff(at, prepend=-1))
            yield pd.DataFrame({"space": space, "leaf": -1, "region": at[edges].astype(np.int32), "probes": np.split(leaf.astype(np.int32), edges[1:]), "same": None, "codes": None, "copies": None, "vec": None})

    kind = "space string, leaf int, region int, probes array<int>, same binary, codes binary, copies array<long>, vec binary"
    both = materialize(heads.select("space", "same", "vec", "copies").mapInPandas(place, kind), "placed")
    discard(prints)
    placed = both.where("leaf >= 0").drop("probes")
    # one row per leaf and region that looks into it
    wanted = both.where("leaf < 0").select("space", "region", F.explode("probes").alias("leaf")).distinct().groupBy("space", "leaf").agg(F.collect_list("region").alias("to"))
    wanted = materialize(wanted, "wanted")
    sizes = placed.groupBy("space", "leaf").agg(F.count(F.lit(1)).alias("n")).join(wanted, ["space", "leaf"])
    with freed_shuffles(spark):
        n, copies_sent = sizes.agg(F.sum("n"), F.sum(F.col("n") * F.size("to"))).first()
    # every round has a region for each core
    rounds = max(1, min(n_regions // cores, ceil((copies_sent or 0) / (ROUND_COPIES * max(1, n or 0)))))

    def sent(turn: int) -> DataFrame:
        """What the regions of a round are sent."""
        to = wanted.withColumn("to", F.filter("to", lambda r: r % rounds == turn)).where(F.size("to") > 0)
        rows = placed.withColumnRenamed("region", "home").join(F.broadcast(to), ["space", "leaf"])
        return rows.select("space", "leaf", "home", "codes", "vec", F.col("copies")[0].alias("head"), F.when(F.size("copies") > 1, F.col("copies")).alias("copies"), F.explode("to").alias("region"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        numbers, homes = t["region"].to_numpy(), t["home"].to_numpy()
        for r in np.unique(numbers):  # one, unless the shuffle put two into one task
            at = np.flatnonzero(numbers == r)
            leaf = t["leaf"].to_numpy()[at]
            at = at[np.argsort(leaf, kind="stable")]
            part = t.take(pa.array(at))
            q, leaf, ids_ = fitted[part["space"][0].as_py()], part["leaf"].to_numpy(), part["head"].to_numpy()
            x = _matrix(part["vec"].to_pylist())
            codes = unpacked(np.frombuffer(b"".join(part["codes"].to_pylist()), np.uint8).reshape(len(x), -1), q.tables.shape[0])
            ask = np.flatnonzero(homes[at] == r)
            copied = part["copies"].is_valid().to_numpy()
            size = np.ones(len(x), np.int64)
            lists = {int(i): np.array(part["copies"][int(i)].as_py(), np.int64) for i in np.flatnonzero(copied)}
            for i, v in lists.items():
                size[i] = len(v)
            unit = (x[ask] / np.linalg.norm(x[ask].astype(np.float64), axis=1, keepdims=True)).astype(np.float32)
            where, cos = search_region(q, ask, q.leaves(unit, probes or probes_of(len(q.centroids))), x, leaf, codes, ids_, k)
            out_ids, out_cos, out_n = [], [], np.zeros(len(ask), np.int32)
            for i, (row, c) in enumerate(zip(where, cos)):
                row, c = row[row >= 0], c[row >= 0]
                names = ids_[row]
                if (size[row] > 1).any():
                    names, c = np.concatenate([lists.get(int(y), ids_[y : y + 1]) for y in row]), np.repeat(c, size[row])
                    keep = np.lexsort((names, -c))[:k]
                    names, c = names[keep], c[keep]
                out_ids.append(names), out_cos.append(c)
                out_n[i] = len(names)
            offsets = pa.array(np.concatenate([[0], np.cumsum(out_n)]).astype(np.int32))
            lists_of = lambda v, kind_: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v), kind_))
            if len(ask):
                whole = pa.table([part["space"].take(pa.array(ask)), pa.array(ids_[ask]), lists_of(out_ids, pa.int64()), lists_of(out_cos, pa.float64())], names=["space", "head", "ids", "cos"])
                yield from whole.to_batches(max_chunksize=10_000)

    pairs = F.transform(F.arrays_zip("ids", "cos"), lambda p: F.struct((-p["cos"]).alias("minus"), p["ids"].alias("id")))
    turns = []
    for turn in range(rounds):  # the shuffle of a round is gone before the next
        numbered = sent(turn).repartitionById(ceil(n_regions / rounds), F.floor(F.col("region") / rounds).cast("int"))
        found = numbered.mapInArrow(search, "space string, head long, ids array<long>, cos array<double>")
        turns.append(materialize(found.select("space", "head", pairs.alias("p")), "found"))
    merged = reduce(DataFrame.unionByName, turns)
    # rows that are alone with their vector have what was found for it; copies have each other first
    groups = placed.where(F.size("copies") > 1).select("space", "same", "copies", F.col("copies")[0].alias("head")).join(merged, ["space", "head"]).drop("head")
    copy = lambda c: F.struct(F.lit(-1.0).alias("minus"), c.alias("id"))
    others = F.transform(F.filter("copies", lambda c: c != F.col("vec_row")), copy)
    shared = ids.join(groups, ["space", "same"]).select("model", "vec_row", "doc_id", F.slice(F.array_sort(F.concat(others, "p")), 1, k).alias("p"))
    single = placed.where(F.size("copies") == 1).select("space", F.col("copies")[0].alias("head"))
    alone = ids.join(merged.join(single, ["space", "head"], "left_semi").withColumnRenamed("head", "vec_row"), ["space", "vec_row"]).select("model", "vec_row", "doc_id", "p")
    flat = alone.unionByName(shared).select("model", "vec_row", "doc_id", F.explode("p").alias("p"))
    return flat.select("model", "vec_row", "doc_id", F.col("p.id").alias("neighbour"), (-F.col("p.minus")).alias("cosine"))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar rows of every usable row, with the doc_id of both."""
    best = materialize(neighbours(table(spark, d, "vectors")), "neighbours")
    names = best.select("model", F.col("vec_row").alias("neighbour"), F.col("doc_id").alias("neighbour_doc_id")).distinct()
    return best.join(names, ["model", "neighbour"]).select("model", "vec_row", "doc_id", "neighbour", "neighbour_doc_id", "cosine")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with a cosine of at least 0.90, from the neighbours of every row."""
    near = neighbours(table(spark, d, "vectors")).where("cosine >= 0.9")
    return near.select(F.least("vec_row", "neighbour").alias("vec_row_a"), F.greatest("vec_row", "neighbour").alias("vec_row_b"), "model").distinct().select("vec_row_a", "vec_row_b")


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours}
SQL = {
    "p2_found": """WITH u AS (
  SELECT DISTINCT ON (model, vec_row) model, vec_row, vec::DOUBLE[] AS v FROM vectors
  WHERE vec IS NOT NULL AND len(vec) = dim AND len(vec) > 0 AND vec_row IS NOT NULL AND model IS NOT NULL
    AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0)
SELECT a.vec_row AS vec_row_a, b.vec_row AS vec_row_b FROM u a JOIN u b ON a.model = b.model AND a.vec_row < b.vec_row AND len(a.v) = len(b.v)
WHERE list_cosine_similarity(a.v, b.v) >= 0.9""",
}
