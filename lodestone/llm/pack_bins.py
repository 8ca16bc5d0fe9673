"""Problem 8: filling containers of fixed capacity by best-fit decreasing, with a segment tree over remaining capacities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import table

CAPACITY = 2048
SHARD_ITEMS = 20_000  # items packed together; each shard leaves few containers that are not full


class CapacityTree:
    """Open bins by remaining capacity: leaf c holds the bins with c left, inner nodes tell which subtrees hold any."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.bins: dict[int, list[int]] = {}

    def add(self, left: int, bin_no: int) -> None:
        self.bins.setdefault(left, []).append(bin_no)
        self._change(left, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and gives (remaining, bin) of the tightest bin with at least ``need`` left, in logarithmic time."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):  # up to the first ancestor with a filled right sibling
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        left = i - self.size
        self._change(left, -1)
        return left, self.bins[left].pop()

    def _change(self, leaf: int, by: int) -> None:
        i = leaf + self.size
        while i:
            self.count[i] += by
            i >>= 1


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin numbers of items given in decreasing size; every size is between 0 and capacity."""
    tree, out, opened = CapacityTree(capacity), [], 0
    for s in sizes:
        hit = tree.take(s)
        if hit is None:
            hit = capacity, opened
            opened += 1
        out.append(hit[1])
        tree.add(hit[0] - s, hit[1])
    return out


def cut_sizes(text: str, capacity: int) -> list[int]:
    """Token counts of the pieces of a text of more than ``capacity`` tokens: UTF-8 bytes, cut between characters; the
    last piece also holds the end token."""
    raw, at, out = text.encode(), 0, []
    end = len(raw)
    while end - at + 1 > capacity:
        to = min(at + capacity, end)
        while to < end and (raw[to] & 0xC0) == 0x80:
            to -= 1
        out.append(to - at)
        at = to
    return [*out, end - at + 1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, piece, n_tokens, shard, bin): every text in one container, or in one per piece if it exceeds the capacity.

    Sizes are tokens of the ByT5 byte tokenizer: UTF-8 bytes and one end token. Only sizes are moved, never texts.
    Items are spread over shards by a hash of (id, piece), so shards are even whatever the source or the sizes, and
    each is packed alone. A null text is no item; an empty one has one token. A null id is kept as an id. Repeated
    rows are packed each. Extra columns are ignored.
    """
    if capacity < 8:
        raise ValueError("capacity must be at least 8")

    @F.pandas_udf("array<int>")
    def cuts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut_sizes(t, capacity))

    sized = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), (F.octet_length(text_col) + 1).alias("size"), F.col(text_col).alias("body"))
    whole = sized.where(F.col("size") <= capacity).select("doc_id", F.lit(0).alias("piece"), F.col("size").cast("int").alias("n_tokens"))
    long = sized.where(F.col("size") > capacity).select("doc_id", F.posexplode(cuts("body")).alias("piece", "n_tokens"))
    items = whole.unionByName(long)
    shards = max(1, -(-docs.where(F.col(text_col).isNotNull()).count() // shard_items))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        pdf["bin"] = best_fit_decreasing(pdf["n_tokens"].tolist(), capacity)
        return pdf

    spread = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    kind = dict(spread.dtypes)["doc_id"]
    return spread.groupBy("shard").applyInPandas(fill, f"doc_id {kind}, piece int, n_tokens int, shard int, bin int")


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of one, with its container."""
    return pack(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that were split over containers."""
    return pack(table(spark, d, "documents")).where("piece = 1").select("doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """What the packing must keep: documents, their tokens, containers over capacity, documents under the capacity that were split,
    and whether the containers are at most 2% and 8 more than the tokens need."""
    packed = pack(table(spark, d, "documents"))
    bins = packed.groupBy("shard", "bin").agg(F.sum("n_tokens").alias("n")).select("n", F.lit(None).cast("long").alias("pieces"))
    docs = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"))
    is_doc = F.col("pieces").isNotNull()
    got = docs.select("n", "pieces").unionByName(bins).agg(
        F.count_if(is_doc).alias("documents"), F.coalesce(F.sum(F.when(is_doc, F.col("n"))), F.lit(0)).alias("tokens"), F.count_if(~is_doc).alias("bins"),
        F.count_if(~is_doc & (F.col("n") > CAPACITY)).alias("over_capacity"), F.count_if(is_doc & (F.col("pieces") > 1) & (F.col("n") <= CAPACITY)).alias("split_in_vain"))
    full = F.col("bins") <= 1.02 * F.ceil(F.col("tokens") / CAPACITY) + 8
    return got.select("documents", "tokens", "over_capacity", "split_in_vain", full.alias("well_filled"))


QUERIES = {"p8_found": p8_found, "p8_packing": p8_packing, "p8_fill": p8_fill}
SQL = {
    "p8_found": f"SELECT doc_id FROM documents WHERE strlen(text) + 1 > {CAPACITY}",
    "p8_fill": "SELECT count(*) AS documents, coalesce(sum(strlen(text) + 1), 0)::BIGINT AS tokens, 0::BIGINT AS over_capacity, 0::BIGINT AS split_in_vain, true AS well_filled FROM documents WHERE text IS NOT NULL",
}
