"""Per-key results when a few keys hold most rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_profile(
    edges: DataFrame, left: str = "src", right: str = "dst", kind: str = "kind", heavy_share: float = 0.005, salts: int = 64
) -> DataFrame:
    """For each id on each side: its rows, distinct partners, rows per kind, share of all rows, and whether it was salted.

    Two-stage salted aggregation. A first count per key finds the keys with at least `heavy_share` of
    all rows; there can be at most 1/heavy_share of them on a side, which bounds what is broadcast.
    Rows of those keys get one of `salts` salts, partial results are computed per (key, salt) and then
    merged by key. The salt is a hash of the partner, not a random number: partial distinct counts of
    different salts then never overlap, so they add up exactly, and a task that is run again after a
    lost executor makes the same salts.

    Columns: edge_side, key_id, n_rows, n_partners, rows_per_kind (map), row_share, salted.
    Rows with a null id count towards the total but make no key; a null partner is no partner; a null
    kind counts under `unknown`. Repeated rows count each time. An empty table gives an empty result.
    Other columns of the input are ignored, whatever their names.
    """
    e = edges.select(F.col(left).alias("_l"), F.col(right).alias("_r"), F.coalesce(F.col(kind), F.lit("unknown")).alias("_k"))
    both = e.select(
        F.explode(
            F.array(
                F.struct(F.lit("src").alias("edge_side"), F.col("_l").alias("key_id"), F.col("_r").alias("partner")),
                F.struct(F.lit("dst").alias("edge_side"), F.col("_r").alias("key_id"), F.col("_l").alias("partner")),
            )
        ).alias("s"),
        "_k",
    ).select("s.edge_side", "s.key_id", "s.partner", "_k")
    total = edges.count()  # one number; a columnar source answers it from its footers
    named = both.where(F.col("key_id").isNotNull())
    heavy = (
        named.groupBy("edge_side", "key_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= max(heavy_share * total, 2))
        .select("edge_side", "key_id", F.lit(True).alias("is_heavy"))
    )
    marked = named.join(F.broadcast(heavy), ["edge_side", "key_id"], "left").withColumn(
        "salt", F.when(F.col("is_heavy"), F.pmod(F.xxhash64(F.coalesce(F.col("partner"), F.lit(""))), F.lit(salts)).cast("int")).otherwise(F.lit(-1))
    )
    kinds = (
        marked.groupBy("edge_side", "key_id", "salt", "_k")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("edge_side", "key_id", "_k")
        .agg(F.sum("n").alias("n"), F.max("salt").alias("salt"))
        .groupBy("edge_side", "key_id")
        .agg(
            F.sum("n").alias("n_rows"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "n")))).alias("rows_per_kind"),
            (F.max("salt") >= 0).alias("salted"),
        )
    )
    partners = (
        marked.where(F.col("partner").isNotNull())
        .select("edge_side", "key_id", "salt", "partner")
        .distinct()
        .groupBy("edge_side", "key_id", "salt")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("edge_side", "key_id")
        .agg(F.sum("n").alias("n_partners"))
    )
    return (
        kinds.join(partners, ["edge_side", "key_id"], "left")
        .select(
            "edge_side",
            "key_id",
            "n_rows",
            F.coalesce("n_partners", F.lit(0)).alias("n_partners"),
            "rows_per_kind",
            (F.col("n_rows") / F.lit(max(total, 1))).alias("row_share"),
            "salted",
        )
    )
