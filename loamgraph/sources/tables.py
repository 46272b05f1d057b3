"""Reading the project's Parquet tables and keeping intermediate ones."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder. Columns are pruned by the plan that reads it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows in at least two partitions a core, for work in Python that costs far more than a shuffle.

    A table that is read in more partitions is left as it is. The key is a unique one, so parts are even.
    """
    least = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least, key)


def tasks(spark: SparkSession) -> int:
    """Parts for grouped work in Python, where the optimiser would join small groups of few bytes to one long task."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables, which every executor can read: the session's `spark.checkpoint.dir`.

    Only a local master may do without the setting and then uses a temporary folder of this machine. On a cluster each executor would
    write to a disk of its own and a later read would find a part of the rows, so there its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "loamgraph-scratch")


_open: dict[int, list["Scratch"]] = {}


class Scratch:
    """Intermediate tables in the folder that all executors share (`shared_root`).

    A kept table is written once, so a lost executor costs no recomputation, a loop's lineage stays short, and a later join knows its size.
    A result may read such tables until it is consumed; then `close`, or `release` for all of a session, deletes them. What is left goes when the JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark).rstrip('/')}/loamgraph-{uuid.uuid4().hex}"
        self._fs_path(self.root, mark=True)
        self.n = 0
        _open.setdefault(id(spark), []).append(self)

    def _fs_path(self, path: str, mark: bool = False):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if mark:
            fs.deleteOnExit(p)
        return fs, p

    def keep(self, df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
        """The same rows, read from a written table. `replaces` is an earlier table nothing needs any more."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._loam_path = path
        if replaces is not None:
            self.drop(replaces)
        return kept

    def counted(self, df: DataFrame, replaces: DataFrame | None = None, **sums) -> tuple[DataFrame, dict]:
        """keep, with the number of rows (`n`) and further aggregates, taken while the table is written: no second job."""
        seen = Observation()
        kept = self.keep(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in sums.items()]), replaces)
        return kept, seen.get

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_loam_path", None)
        if path:
            fs, p = self._fs_path(path)
            fs.delete(p, True)

    def close(self) -> None:
        fs, p = self._fs_path(self.root)
        fs.delete(p, True)


def release(spark: SparkSession) -> None:
    """Deletes every intermediate table of the session's queries; results that were not consumed yet can't be read after it."""
    for s in _open.pop(id(spark), []):
        s.close()
