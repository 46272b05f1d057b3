"""References to records that do not exist, or did not exist yet."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.instants import instant, month_of
from loamgraph.functions.identity import PLANE_SEPARATOR


def quoted_or_listed(reason: Column) -> Column:
    """All ids that a refusal names, as an array; empty for a refusal that names none, null for null.

    Loader versions write lists in back-quotes, in double quotes, as a bracketed list of single-quoted
    items, or after `not found:` parted by semicolons. Ids may hold commas, brackets and the plane
    separator; a separator that was written as an escape is read back.
    """
    r = reason.cast("string")
    listed = F.split(F.regexp_extract(r, r"(?s)not found:\s*(.*)$", 1), r";\s+")
    found = (
        F.when(r.contains("`"), F.regexp_extract_all(r, F.lit(r"`([^`]+)`"), 1))
        .when(r.contains("['") | r.contains('["'), F.regexp_extract_all(r, F.lit(r"""(?:\[|, )(?:'|")(.+?)(?:'|")(?=, (?:'|")|\])(?!\w)"""), 1))
        .when(r.contains('"'), F.regexp_extract_all(r, F.lit(r'"([^"]+)"'), 1))
        .when(r.contains("not found:"), listed)
        .otherwise(F.array().cast("array<string>"))
    )
    clean = F.transform(found, lambda x: F.replace(F.trim(x), F.lit("\\x1f"), F.lit(PLANE_SEPARATOR)))
    return F.when(r.isNotNull(), F.filter(clean, lambda x: x != ""))


def first_quoted(reason: Column) -> Column:
    """The first quoted name of a text, in whichever of the three quote characters; null if there is none."""
    r = reason.cast("string")
    return F.nullif(F.regexp_extract(r, r"""(?s)(['"`])(.+?)\1(?=$|[\s,;.)\]])""", 2), F.lit(""))


def references(edges: DataFrame, coverage_records: DataFrame, rejections: DataFrame, coverage_results: DataFrame) -> DataFrame:
    """Every reference of the four tables: ref_table, pool (which known records count), ref_id, ref_at."""
    parts = [
        edges.select(F.lit("edges").alias("ref_table"), F.lit("id").alias("pool"), F.col("dst").alias("ref_id"), F.coalesce(instant("created_at"), instant("committed_at")).alias("ref_at")),
        coverage_records.select(F.lit("coverage_records"), F.lit("method"), F.explode("covered"), F.col("loaded_at")),
        rejections.select(F.lit("decision_rejections"), F.lit("id"), F.explode(quoted_or_listed(F.col("reason"))), F.col("rejected_at")),
        coverage_results.select(F.lit("coverage_results"), F.lit("method"), F.explode("reasons").alias("r"), F.col("loaded_at").alias("t")).select(
            "coverage_results", "method", first_quoted(F.col("r")), "t"
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where(F.col("ref_id").isNotNull())


def known_records(nodes: DataFrame, platform_nodes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every record that can be referred to, once: pool, ref_id, known_at (its earliest instant)."""
    all_nodes = nodes.select("id", "qualified_name", "kind", "committed_at").unionByName(platform_nodes.select("id", "qualified_name", "kind", "committed_at"))
    at = instant("committed_at")
    rows = (
        all_nodes.select(F.explode(F.array(F.struct(F.lit("id").alias("pool"), F.col("id").alias("ref_id")), F.when(F.col("kind") == "Method", F.struct(F.lit("method").alias("pool"), F.col("qualified_name").alias("ref_id"))))).alias("k"), at.alias("known_at"))
        .select("k.pool", "k.ref_id", "known_at")
        .union(decisions.select(F.lit("id"), F.col("decision_id"), instant("created_at")))
    )
    return rows.where(F.col("ref_id").isNotNull()).groupBy("pool", "ref_id").agg(F.min("known_at").alias("known_at"))


def orphan_references(refs: DataFrame, known: DataFrame, heavy_share: float = 0.002) -> DataFrame:
    """References whose record is absent or younger than the reference, per table, month and id.

    Columns: ref_table, ref_month, ref_id, ref_state (`absent` or `late`), n_rows.

    References are first pre-aggregated per (table, pool, id, month), on the map side too, so a key that
    holds a third of all rows is one row a month before anything is joined. Keys that still stand for
    at least `heavy_share` of all references (at most 1/heavy_share of them) are checked against their
    known records by broadcast; the other keys go through a shuffle join; both results are united.
    `late` compares the earliest reference of the month with the record's earliest instant. A record
    without a readable instant is known at all times; a reference without one can only be absent, and
    has a null month. Null ids refer to nothing. Empty tables give what remains.
    """
    grouped = (
        refs.withColumn("ref_month", month_of(F.col("ref_at")))
        .groupBy("ref_table", "pool", "ref_id", "ref_month")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("ref_at").alias("first_at"))
    )
    total = refs.count()  # one number
    heavy = (
        refs.groupBy("pool", "ref_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= max(heavy_share * total, 2))
        .select("pool", "ref_id", F.lit(True).alias("is_heavy"))
    )
    marked = grouped.join(F.broadcast(heavy), ["pool", "ref_id"], "left")
    heavy_known = known.join(F.broadcast(heavy), ["pool", "ref_id"], "left_semi").withColumn("exists", F.lit(True))
    checked_heavy = marked.where(F.col("is_heavy")).drop("is_heavy").join(F.broadcast(heavy_known), ["pool", "ref_id"], "left")
    checked_rest = marked.where(F.col("is_heavy").isNull()).drop("is_heavy").join(known.withColumn("exists", F.lit(True)), ["pool", "ref_id"], "left")
    both = checked_heavy.unionByName(checked_rest)
    state = F.when(F.col("exists").isNull(), F.lit("absent")).when(F.col("known_at") > F.col("first_at"), F.lit("late"))
    return both.select("ref_table", "ref_month", "ref_id", state.alias("ref_state"), "n_rows").where(F.col("ref_state").isNotNull())


def orphan_report(found: DataFrame) -> DataFrame:
    """Per table, period and state: distinct ids and rows behind them."""
    return found.groupBy("ref_table", "ref_month", "ref_state").agg(F.count(F.lit(1)).alias("n_ids"), F.sum("n_rows").alias("n_rows"))
