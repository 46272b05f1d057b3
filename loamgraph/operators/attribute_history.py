"""Full history of changing attributes, from snapshots or updates in any order."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.instants import instant

#: Width of the stretches by which a much-seen entity's sightings are split; any width gives the same result.
STRETCH_DAYS = 30


def change_log(sightings: DataFrame, entity: str, at: str, attributes: Sequence[str]) -> DataFrame:
    """One row per change of one attribute of one entity: the event log, with each attribute's own intervals.

    Columns: entity_id, attribute, value (string), valid_from, valid_to (null while it holds).
    `at` is a timestamp column or ISO-8601 text with an offset. Rows without an entity or a readable instant say
    nothing about time and are left out. A null value is a value: it opens an interval of its own. If
    one instant shows several values of an attribute, the smallest non-null one counts. Repeats and
    arrival order do not matter. Extra columns are ignored.
    """
    when = F.col(at) if dict(sightings.dtypes)[at].startswith("timestamp") else instant(at)
    base = sightings.select(
        F.col(entity).cast("string").alias("entity_id"), when.alias("seen_at"), *[F.col(a).cast("string").alias(f"v{i}") for i, a in enumerate(attributes)]
    ).where(F.col("entity_id").isNotNull() & F.col("seen_at").isNotNull())
    # one row per entity and instant first: map-side combined, so a much-repeated entity shrinks before it is shuffled
    per_instant = base.groupBy("entity_id", "seen_at").agg(*[F.min(f"v{i}").alias(f"v{i}") for i in range(len(attributes))])
    state = F.struct(*[f"v{i}" for i in range(len(attributes))])
    # a hot entity's sightings are split by calendar stretch; what repeats its predecessor inside a stretch ends here
    stretch = Window.partitionBy("entity_id", F.floor(F.unix_seconds("seen_at") / (86400 * STRETCH_DAYS))).orderBy("seen_at")
    turns = (
        per_instant.withColumn("_s", state)
        .withColumn("_p", F.lag("_s").over(stretch))
        .where(F.col("_p").isNull() | ~F.col("_s").eqNullSafe(F.col("_p")))
    )
    # so an entity brings no more rows here than it has changes and stretches
    w = Window.partitionBy("entity_id").orderBy("seen_at")
    first = F.row_number().over(w) == 1
    marked = turns.select(
        "entity_id",
        "seen_at",
        *[
            F.when(first | ~F.col(f"v{i}").eqNullSafe(F.lag(f"v{i}").over(w)), F.struct(F.lit(a).alias("attribute"), F.col(f"v{i}").alias("value"))).alias(f"c{i}")
            for i, a in enumerate(attributes)
        ],
    )
    changes = marked.select("entity_id", "seen_at", F.explode(F.array_compact(F.array(*[f"c{i}" for i in range(len(attributes))]))).alias("c")).select(
        "entity_id", "seen_at", "c.attribute", "c.value"
    )
    nxt = Window.partitionBy("entity_id", "attribute").orderBy("seen_at")
    return changes.select("entity_id", "attribute", "value", F.col("seen_at").alias("valid_from"), F.lead("seen_at").over(nxt).alias("valid_to"))


def combined_history(log: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """The attributes' own intervals, split at the union of their boundary dates and coalesced.

    Columns: entity_id, one per attribute, valid_from, valid_to. Adjacent periods in which no attribute
    differs are one row. `log` is the result of change_log (or rows of that form from elsewhere).
    """
    edges = log.select("entity_id", F.col("valid_from").alias("b"), "attribute", "value")
    # a boundary carries the values that start there; each attribute's last start before it still holds
    at_bound = edges.groupBy("entity_id", "b").agg(
        *[F.max(F.when(F.col("attribute") == a, F.struct(F.col("value").alias("value")))).alias(f"s{i}") for i, a in enumerate(attributes)]
    )
    w = Window.partitionBy("entity_id").orderBy("b")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    held = at_bound.select("entity_id", "b", *[F.last(f"s{i}", ignorenulls=True).over(run)["value"].alias(f"h{i}") for i in range(len(attributes))])
    state = F.struct(*[f"h{i}" for i in range(len(attributes))])
    fresh = held.withColumn("_s", state).withColumn("_p", F.lag("_s").over(w)).where(F.col("_p").isNull() | ~F.col("_s").eqNullSafe(F.col("_p")))
    return fresh.select("entity_id", *[F.col(f"h{i}").alias(a) for i, a in enumerate(attributes)], F.col("b").alias("valid_from"), F.lead("b").over(w).alias("valid_to"))


def entity_history(sightings: DataFrame, entity: str, at: str, attributes: Sequence[str]) -> DataFrame:
    """change_log and combined_history in one: one row per version of an entity."""
    return combined_history(change_log(sightings, entity, at, attributes), attributes)
