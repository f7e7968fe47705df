"""Session-level helpers: durable scratch tables and table loading.

Iterative operators cut their lineage by writing a compressed table into the
shared folder that the session names in ``spark.checkpoint.dir``.  Such a table
survives the loss of any executor, unlike a local checkpoint, and gives the
optimiser true sizes for the next round.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; only a session within one process (tests) may go without and gets one of its own.

    Executors on other machines don't see a folder of this one, so a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="kinweave-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


_roots: set[str] = set()


def release(spark: SparkSession) -> None:
    """Removes the scratch tables of all operators that ran in this process; call it when their results are stored."""
    while _roots:
        _delete(spark, _roots.pop())


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _roots else None
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            release(spark)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            _roots.clear()


class Scratch:
    """Tables of one operator run, kept below the shared checkpoint folder until :func:`release` or the end of the process."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
        _roots.add(self.root)
        self._count = 0
        self._paths: dict[int, str] = {}

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it as read back, without its lineage."""
        self._count += 1
        path = f"{self.root}/t{self._count}"
        df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = path
        return back

    def drop(self, *frames: DataFrame | None) -> None:
        """Remove tables that nothing reads any more."""
        for df in frames:
            path = self._paths.pop(id(df), None) if df is not None else None
            if path is not None:
                _delete(self.spark, path)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One input table; the scan keeps only the columns that the plan uses."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer splits than there are; a large input keeps its splits and moves nothing."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
