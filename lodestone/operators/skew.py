"""Joins and aggregations whose work stays even when a few keys hold most rows (problem 1).

A key is heavy if it holds more rows than a slice, a quarter of what a task gets on average: so heaviness follows the number of
tasks, and a heavy key is spread over as many salts as it has slices. The salt is pseudo-random: a hash of the row's other
columns. A salt drawn by rand() could differ when a lost executor's task runs again on rows in another order, which would
lose or repeat rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestone.session import freed_shuffles, materialize

SLICES = 4  # of a task's fair share; so at most SLICES * tasks keys are heavy
SALTS = 16  # for keys given without a number of their own
SALT = "__salt"


class Heavy(list):
    """Heavy keys, with the number of salts of each."""

    def __init__(self, salts: Mapping):
        super().__init__(salts)
        self.salts = dict(salts)


@dataclass(frozen=True)
class Merge:
    """An aggregate in two stages: ``partial`` over rows gives ``name``, ``merge`` over partials gives the result."""

    name: str
    partial: Column
    merge: Column


def count_rows(name: str) -> Merge:
    return Merge(name, F.count(F.lit(1)).alias(name), F.sum(name).alias(name))


def sum_of(col: str, name: str) -> Merge:
    return Merge(name, F.sum(col).alias(name), F.sum(name).alias(name))


def max_of(col: str, name: str) -> Merge:
    return Merge(name, F.max(col).alias(name), F.max(name).alias(name))


def min_of(col: str, name: str) -> Merge:
    return Merge(name, F.min(col).alias(name), F.min(name).alias(name))


def _slice(df: DataFrame, total: int, share: float | None) -> float:
    return max(1.0, total * (share or 1 / (SLICES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def heavy_counts(counts: DataFrame, key: str, n: str, total: int, share: float | None = None) -> Heavy:
    """The keys of a table (key, n) with more rows than a slice (or ``share`` of ``total``), and their salts. Nulls are never heavy. At
    most SLICES per task (or 1 / share) reach the driver."""
    rows = _slice(counts, total, share)
    test = F.col(n) >= F.lit(rows) if share else F.col(n) > F.lit(rows)
    with freed_shuffles(counts.sparkSession):
        got = counts.where(test & F.col(key).isNotNull()).select(key, n).collect()
    return Heavy({r[0]: max(2, ceil(r[1] / rows)) for r in got})


def heavy_keys(df: DataFrame, key: str, share: float | None = None) -> Heavy:
    """``heavy_counts`` of the rows of df, all of them counted, combined before the shuffle."""
    return heavy_counts(df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), key, "__n", df.count(), share)


def _salts(df: DataFrame, key: str, heavy: Sequence, salts: int, name: str) -> DataFrame:
    """Adds the number of salts of heavy keys, null for others: a table of at most SLICES rows per task is broadcast."""
    rows = [(v, n) for v, n in (heavy.salts.items() if isinstance(heavy, Heavy) else ((v, salts) for v in heavy))]
    kind = StructType([StructField("__key", df.schema[key].dataType), StructField(name, IntegerType())])
    small = df.sparkSession.createDataFrame(rows, kind)
    return df.join(F.broadcast(small), df[key] == small["__key"], "left").drop("__key")


def with_salt(df: DataFrame, key: str, heavy: Sequence, by: Sequence[str], salts: int = SALTS) -> DataFrame:
    """Adds the salt column: 0 for other keys, from 0 up for heavy ones by a hash of the columns ``by``."""
    if not heavy:
        return df.withColumn(SALT, F.lit(0))
    return _salts(df, key, heavy, salts, "__n").withColumn(SALT, F.coalesce(F.pmod(F.xxhash64(*by), F.col("__n")).cast("int"), F.lit(0))).drop("__n")


def salted_aggregate(df: DataFrame, key: str, aggs: Sequence[Merge], heavy: Sequence, by: Sequence[str], salts: int = SALTS) -> DataFrame:
    """Two-stage salted aggregation, one row per key.

    Rows of heavy keys get a salt; the first stage aggregates per (key, salt), the second merges the
    partials of each key. A null key is one group. Repeated rows count each. An empty input gives no
    row. Extra columns are ignored, also ones named like the results.
    """
    first = with_salt(df, key, heavy, by, salts).groupBy(key, SALT).agg(*[m.partial for m in aggs])
    return first.groupBy(key).agg(*[m.merge for m in aggs])


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str, heavy: Sequence, by: Sequence[str], salts: int = SALTS) -> DataFrame:
    """Join on ``key`` where the left side may hold few keys in most rows (how: inner, left or left_semi, left_anti).

    Heavy keys of the left side are spread by salt, and only their right rows are repeated for every salt.
    Nulls match nothing. The right side should have few rows per heavy key.
    """
    if not heavy:
        return left.join(right, key, how)
    spread = F.sequence(F.lit(0), F.coalesce(F.col("__n"), F.lit(1)) - 1)
    right = _salts(right, key, heavy, salts, "__n").withColumn(SALT, F.explode(spread)).drop("__n")
    return with_salt(left, key, heavy, by, salts).join(right, [key, SALT], how).drop(SALT)


def ranked_within(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, heavy_by: str, heavy: Sequence, unique: bool = False) -> DataFrame:
    """Adds ``name``: 1 + the number of rows of the group that come before, by ``order`` (``unique``: row numbers).

    Groups are ranked by a window each. Groups of which column ``heavy_by`` holds a heavy value are cut instead by
    range partitioning on (group, order), ranked inside each range, and shifted by the rows in the ranges before;
    only those counts, at most one per range and group, come together. Equal rows fall into one range.
    """
    place = F.row_number() if unique else F.rank()
    window = place.over(Window.partitionBy(*group).orderBy(*order)).cast("long")
    if not heavy:
        return df.withColumn(name, window)
    marked = _salts(df, heavy_by, heavy, SALTS, "__n")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = materialize(marked.where("__n is not null").drop("__n").repartitionByRange(4 * n, *group, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = hot.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = hot.withColumn(name, place.over(Window.partitionBy(*group, "__range").orderBy(*order)).cast("long"))
    shifted = inside.join(F.broadcast(offsets), [*group, "__range"]).withColumn(name, F.col(name) + F.col("__off"))
    return marked.where("__n is null").drop("__n").withColumn(name, window).unionByName(shifted.drop("__range", "__off"))
