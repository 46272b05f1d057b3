"""The same fold as a stream: sightings in, the present graph out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions.instants import instant
from loamgraph.schema import EDGES_DDL, NODES_DDL
from loamgraph.sources.store import Store


def fold_stream(spark: SparkSession, incoming: str, name: str, store: Store, checkpoint: str):
    """Starts a stream over Parquet files that arrive in a folder; each batch is upserted into the store.

    A late row is harmless: the last write is decided by the rows' own instants, not by arrival. A batch that is run again after a failure changes nothing.
    """
    schema = NODES_DDL if name == "nodes" else EDGES_DDL
    rows = spark.readStream.schema(schema).parquet(incoming)
    return rows.writeStream.foreachBatch(lambda df, _: store.upsert(name, df) if df.limit(1).count() else None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_activity(rows: DataFrame, late: str = "7 days", width: str = "1 day") -> DataFrame:
    """window_start, kind, n: writes per kind and day of their own instant; on a stream, state older than `late` is let go."""
    timed = rows.withColumn("at", instant("committed_at")).where(F.col("at").isNotNull())
    g = timed.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), "kind", "n")
