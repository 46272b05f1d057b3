"""Versioned Parquet tables: read, union, keep the last write, write a new version, move a pointer."""

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from loamgraph.operators import graph
from loamgraph.schema import EDGES_DDL, NODES_DDL

SCHEMAS = {"nodes": NODES_DDL, "edges": EDGES_DDL}


class Store:
    """nodes and edges under one folder. A version is complete before the pointer names it, so readers never see half of one.

    Writes are idempotent: the same rows again leave the tables as they are. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self, name: str):
        return self._path(f"{self.folder}/{name}.json")

    def version(self, name: str) -> str | None:
        if not self._fs.exists(self._pointer(name)):
            return None
        text = "".join(r[0] for r in self.spark.read.text(self._pointer(name).toString()).collect())  # one short line
        return json.loads(text)["version"]

    def read(self, name: str) -> DataFrame | None:
        v = self.version(name)
        return None if v is None else self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}/{v}")

    def write(self, name: str, df: DataFrame, by: str | None = "kind") -> str:
        v = f"{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        (df.write.partitionBy(by) if by else df.write).parquet(f"{self.folder}/{name}/{v}")
        out = self._fs.create(self._pointer(name), True)
        out.write(bytearray(json.dumps({"version": v}).encode()))
        out.close()
        return v

    def upsert(self, name: str, rows: DataFrame) -> str:
        """nodes or edges: what is there and what comes, of each key the last write."""
        now = self.read(name)
        both = rows if now is None else now.unionByName(rows, allowMissingColumns=True)
        return self.write(name, graph.nodes_now(both) if name == "nodes" else graph.edges_now(both))

    def write_manifest(self, rows: DataFrame) -> str:
        """Which branches were captured: rows of the same id replace earlier ones."""
        v = self.version("manifest")
        old = None if v is None else self.spark.read.parquet(f"{self.folder}/manifest/{v}")
        both = rows if old is None else old.join(rows.select("id"), "id", "left_anti").unionByName(rows)
        return self.write("manifest", both, by=None)

    def manifest(self) -> DataFrame | None:
        v = self.version("manifest")
        return None if v is None else self.spark.read.parquet(f"{self.folder}/manifest/{v}")

    def wipe_plane(self, branch: str | None) -> None:
        n, e = graph.wipe_plane(self.read("nodes"), self.read("edges"), branch)
        self.write("nodes", n)
        self.write("edges", e)
