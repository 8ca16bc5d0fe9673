"""Problem 4: occurrences and record counts of every term, by recursive radix spilling with DuckDB."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import CLEAN_SQL, clean_postings, doc_count, table

RARE_DF, COMMON_SHARE = 2, 0.2
FANOUT_BITS = 4  # each level splits by so many more bits of the hash
PART_ROWS = 500_000  # a part of more rows is split further
DUCKDB_MEMORY = "256MB"
_SCHEMA = pa.schema([("term", pa.string()), ("h", pa.int64()), ("occurrences", pa.int64()), ("df", pa.int64())])


def _scratch(given: str) -> str:
    """A folder for one task inside the executor's own spill folders, another one for each task in turn; the task removes it at its
    end. Where the cluster names none it lies in the executor's working folder, which ends with the executor."""
    roots = os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("LOCAL_DIRS") or given or os.getcwd()
    folders = [r for part in roots.split(os.pathsep) for r in part.split(",") if r]
    context = TaskContext.get()
    root = folders[(context.taskAttemptId() if context else 0) % len(folders)]
    os.makedirs(root, exist_ok=True)
    return tempfile.mkdtemp(prefix="radix-", dir=root)


def _sum(table_: pa.Table, folder: str) -> pa.Table:
    import duckdb

    with duckdb.connect(config={"memory_limit": DUCKDB_MEMORY, "threads": 1, "temp_directory": f"{folder}/duckdb"}) as con:
        con.register("part", table_)
        got = con.sql("SELECT term, any_value(h) AS h, sum(occurrences)::BIGINT AS occurrences, sum(df)::BIGINT AS df FROM part GROUP BY term")
        return got.to_arrow_table().cast(_SCHEMA)


def _split(batches: Iterator[pa.Table], shift: int, folder: str) -> Iterator[pa.Table]:
    """Aggregated tables of the batches. Each batch is cut by FANOUT_BITS bits of the hash into spill files; a file of more
    than PART_ROWS rows is aggregated once per chunk, and split by the next bits if that doesn't bring it down."""
    files: dict[int, tuple[str, pa.ipc.RecordBatchFileWriter, list[int]]] = {}
    mask = (1 << FANOUT_BITS) - 1
    for t in batches:
        way = (t["h"].to_numpy() >> shift) & mask
        order = np.argsort(way, kind="stable")
        t, way = t.take(pa.array(order)), way[order]
        edges = np.flatnonzero(np.diff(way, prepend=-1, append=mask + 1))
        for a, b in zip(edges[:-1], edges[1:]):
            k = int(way[a])
            if k not in files:
                path = f"{folder}/{shift}-{k}-{len(os.listdir(folder))}.arrow"
                files[k] = path, pa.ipc.new_file(path, _SCHEMA), [0]
            files[k][1].write_table(t.slice(a, b - a))
            files[k][2][0] += b - a
    for _, w, _ in files.values():
        w.close()
    for path, _, (rows,) in files.values():
        with pa.memory_map(path) as src:
            reader = pa.ipc.open_file(src)
            parts = (_sum(pa.Table.from_batches([reader.get_batch(i)]), folder) for i in range(reader.num_record_batches))
            if rows <= PART_ROWS or shift + FANOUT_BITS >= 56:
                yield _sum(reader.read_all(), folder)
            else:
                yield from _split(parts, shift + FANOUT_BITS, folder)
        os.remove(path)


def _radix_sum(first_shift: int, spill: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task: batches in chunks, each chunk aggregated before it is spilled, so one hot term stays one row per chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = _scratch(spill)
        try:

            def chunks() -> Iterator[pa.Table]:
                held, rows = [], 0
                for b in batches:
                    held.append(b)
                    rows += b.num_rows
                    if rows >= PART_ROWS:
                        yield _sum(pa.Table.from_batches(held).cast(_SCHEMA), folder)
                        held, rows = [], 0
                if held:
                    yield _sum(pa.Table.from_batches(held).cast(_SCHEMA), folder)

            for t in _split(chunks(), first_shift, folder):
                yield from t.to_batches()
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


def term_counts(postings: DataFrame, parts: int | None = None) -> DataFrame:
    """(term, occurrences, df) of postings unique per (term, doc_rowid).

    Stage 1 aggregates each task's own rows, so a term that holds a third of all rows leaves it as one row per task
    and part. Stage 2 brings together terms with the same hash bits (Spark's shuffle is the first level of the
    spilling), and splits what is too large by further bits of the hash, down to parts that DuckDB aggregates.
    A null term is dropped, a null tf counts as 0 occurrences; no row gives no row.
    """
    n = parts or int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = postings.where("term is not null").select(
        "term", F.xxhash64("term").alias("h"), F.coalesce("tf", F.lit(0)).cast("long").alias("occurrences"), F.lit(1).cast("long").alias("df"))
    schema = "term string, h long, occurrences long, df long"
    spark = postings.sparkSession
    spill = tempfile.gettempdir() if spark.sparkContext.master.startswith("local[") else spark.conf.get("spark.local.dir", "")
    local = rows.mapInArrow(_radix_sum(0, spill), schema)
    return local.repartition(n, "h").mapInArrow(_radix_sum(FANOUT_BITS, spill), schema).drop("h")


def marked(counts: DataFrame, n_docs: int) -> DataFrame:
    """Adds mark: 'rare' for df <= 2, 'common' for df > 0.2 N, else null. A term that is both is rare."""
    return counts.withColumn("mark", F.when(F.col("df") <= RARE_DF, "rare").when(F.col("df") > COMMON_SHARE * n_docs, "common"))


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences, df and mark of every term of the clean postings."""
    docs = table(spark, d, "docs")
    return marked(term_counts(clean_postings(table(spark, d, "postings"), docs)), doc_count(docs)).select("term", "occurrences", "df", "mark")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms marked rare or common."""
    return p4_terms(spark, d).where("mark is not null").select("term", "mark")


QUERIES = {"p4_found": p4_found, "p4_terms": p4_terms}
_COUNTS = f"""WITH {CLEAN_SQL}, counts AS (SELECT term, sum(tf)::BIGINT AS occurrences, count(*) AS df FROM clean GROUP BY term),
marked AS (SELECT counts.*, CASE WHEN df <= {RARE_DF} THEN 'rare' WHEN df > {COMMON_SHARE} * n THEN 'common' END AS mark FROM counts, ndocs)"""
SQL = {"p4_terms": f"{_COUNTS} SELECT * FROM marked", "p4_found": f"{_COUNTS} SELECT term, mark FROM marked WHERE mark IS NOT NULL"}
