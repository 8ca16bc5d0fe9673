"""Session defaults, the folder all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dir: dict[str, str] = {}
_roots: set[str] = set()


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("lodestone")
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    return b.config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.driver.memory", memory).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master without that setting gets a folder of its own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.TemporaryDirectory(prefix="lodestone-")
        atexit.register(own.cleanup)
        _own_dir[app] = f"file://{own.name}"
    return _own_dir[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; so is a local folder
        pass


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, lasting: bool = False) -> str:
    """A new folder of this session in the shared one. It goes with ``clean`` unless it is ``lasting``, else when the driver ends; what
    a crash leaves goes with ``sweep``."""
    root = _folder(spark)
    if root not in _roots:
        _roots.add(root)
        atexit.register(_delete, spark, root)
    return f"{root}/{'lasting' if lasting else 'tables'}/{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is described and run inside loses its shuffle files as soon as it has run, not when the driver collects its garbage."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)


def materialize(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write df as a table into a ``scratch`` folder and read it back: lineage ends there, and a lost executor loses nothing. The
    shuffle files of the writing go at once."""
    path = f"{scratch(df.sparkSession, lasting)}/{name}"
    with freed_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that nothing reads any more; no plan that is still to run may hold them."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f"/lodestone/{df.sparkSession.sparkContext.applicationId}/" in path:
                _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Deletes the intermediate tables of all queries of this session so far; call it when their results have been read."""
    _delete(spark, f"{_folder(spark)}/tables")


def sweep(spark: SparkSession, hours: float = 48) -> int:
    """Deletes what other sessions left in the shared folder and haven't written to for so many hours; gives their number."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lodestone")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    old = []
    for s in fs.listStatus(p) if fs.exists(p) else []:
        newest = max([s.getModificationTime(), *(c.getModificationTime() for c in fs.listStatus(s.getPath()))])
        if newest < (time.time() - 3600 * hours) * 1000 and s.getPath().getName() != spark.sparkContext.applicationId:
            old.append(s.getPath())
    for path in old:
        fs.delete(path, True)
    return len(old)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its files give fewer tasks than there are cores; else as it is. Only small inputs are moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
