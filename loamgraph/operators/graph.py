"""The present graph: last write wins, planes, and what is known of a node."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.identity import plane_of, scoped_id
from loamgraph.functions.instants import instant
from loamgraph.operators.hierarchy import newest_by
from loamgraph.schema import EDGE_LAYERS


def nodes_now(nodes: DataFrame) -> DataFrame:
    """One row per (kind, id): the sighting with the latest instant; of equal ones the latest to arrive, then the greatest commit, path and line."""
    n = nodes.where(F.col("kind").isNotNull() & F.col("id").isNotNull())
    last = [F.desc_nulls_last(c) for c in ("ingested_at", "source_commit", "path", "start_line", "end_line", "committed_at")]
    return newest_by(n, ["kind", "id"], [instant("committed_at").desc_nulls_last(), *last])


def edges_now(edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """One row per (kind, src, dst): the latest write. Null ends make no edge."""
    e = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    e = e.where(F.col("kind").isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull())
    at = F.coalesce(instant("created_at"), instant("committed_at"))
    last = [F.desc_nulls_last(c) for c in ("ingested_at", "source_commit", "resolution", "confidence", "code_bound_at")]
    return newest_by(e, ["kind", "src", "dst"], [at.desc_nulls_last(), *last])


def labels(now: DataFrame) -> DataFrame:
    """One row per id: where an id has several kinds, the smallest counts."""
    return newest_by(now, ["id"], [F.col("kind").asc()])


def admitted(edges: DataFrame, now: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes; the others drop out."""
    ids = now.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def wrong_layer(edges: DataFrame) -> DataFrame:
    """Rows whose layer is not that of their kind: there should be none."""
    layer = F.create_map(*[F.lit(x) for kv in EDGE_LAYERS.items() for x in kv])
    return edges.where(~F.col("edge_kind").eqNullSafe(F.element_at(layer, F.col("kind"))))


def to_plane(nodes: DataFrame, edges: DataFrame, branch: str) -> tuple[DataFrame, DataFrame]:
    """The same graph in a named plane: ids and both ends of edges are rewritten alike."""
    b = F.lit(branch)
    return nodes.withColumns({"branch": b, "id": scoped_id(b, F.col("qualified_name"))}), edges.withColumns({"src": scoped_id(b, F.col("src")), "dst": scoped_id(b, F.col("dst"))})


def wipe_plane(nodes: DataFrame, edges: DataFrame, branch: str | None) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of one named plane and the edges that touch it. The bare plane cannot be wiped."""
    if branch is None:
        raise ValueError("the bare plane cannot be wiped")
    there = lambda c: plane_of(F.col(c)).eqNullSafe(F.lit(branch))
    return nodes.where(~F.col("branch").eqNullSafe(F.lit(branch))), edges.where(~there("src") & ~there("dst"))


def reap_planes(nodes: DataFrame, edges: DataFrame, live: list[str]) -> tuple[DataFrame, DataFrame]:
    """Only the bare plane and the planes named live."""
    ok = lambda c: plane_of(F.col(c)).isNull() | plane_of(F.col(c)).isin(*live)
    return nodes.where(F.col("branch").isNull() | F.col("branch").isin(*live)), edges.where(ok("src") & ok("dst"))


def admit_modifies(rows: DataFrame, now: DataFrame) -> DataFrame:
    """Changes whose file is, or once was, a File of the accumulated graph."""
    return rows.join(now.where(F.col("kind") == "File").select(F.col("id").alias("dst")), "dst", "left_semi")
