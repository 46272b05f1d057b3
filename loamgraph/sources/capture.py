"""Whole histories as jobs: all commits of a repository folded into the store, bare or per branch."""

import datetime
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions.identity import scoped_id
from loamgraph.operators import graph
from loamgraph.operators.components import community_graph
from loamgraph.schema import EDGES_DDL, NODES_DDL
from loamgraph.sources import extract, history
from loamgraph.sources.store import Store
from loamgraph.sources.tables import Scratch, spread


@dataclass(frozen=True)
class Captured:
    commits: int
    nodes: int
    edges: int
    modifies: int
    branches: tuple[str, ...] = ()


def _shaped(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a stored table; what is missing is null."""
    from loamgraph.schema import _struct

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in _struct(ddl)])


def snapshots(spark: SparkSession, repo: str, revisions: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, modifies) of every commit of `revisions` (source_commit, author, committed_at, commit_ord), each commit read once.

    An edge whose end is no node of the same commit drops out. Communities are those of each commit's own graph. Changes are kept if the
    file is one of the whole history's.
    """
    name = os.path.basename(os.path.abspath(repo))
    log = scratch.keep(revisions)
    texts = history.trees(spread(log.select("source_commit"), "source_commit"), repo).withColumn("repo", F.lit(name))
    f = scratch.keep(extract.facts(spread(texts, "path")))
    nodes = extract.extracted_nodes(f).drop("repo").withColumn("id", F.col("qualified_name"))
    root = log.select("source_commit", F.lit("Repo").alias("kind"), F.lit(name).alias("id"), F.lit(name).alias("qualified_name"), F.lit(name).alias("name"))
    nodes = scratch.keep(nodes.unionByName(root, allowMissingColumns=True))
    files = nodes.where(F.col("kind") == "File").select("source_commit", F.lit("CONTAINS").alias("kind"), F.lit(name).alias("src"), F.col("id").alias("dst"))
    edges = extract.extracted_edges(f, scratch).drop("repo").unionByName(files, allowMissingColumns=True)
    ids = nodes.select("source_commit", "id").distinct()
    edges = edges.join(ids.withColumnRenamed("id", "src"), ["source_commit", "src"], "left_semi").join(ids.withColumnRenamed("id", "dst"), ["source_commit", "dst"], "left_semi")
    edges = scratch.keep(edges.withColumn("edge_kind", F.lit("deterministic")))
    # one graph a commit: ids carry the commit while components are sought
    tag = lambda c: F.concat("source_commit", F.lit("\x00"), c)
    c_nodes, c_edges = community_graph(nodes.select(tag("id").alias("id"), "kind"), edges.select("kind", tag("src").alias("src"), tag("dst").alias("dst")), scratch)
    bare = lambda c: F.element_at(F.split(c, "\x00"), 2)
    member = scratch.keep(c_edges.select("kind", F.element_at(F.split("src", "\x00"), 1).alias("source_commit"), bare("src").alias("src"), "dst", "edge_kind"))
    made = member.select("source_commit", F.lit("Community").alias("kind"), F.col("dst").alias("id"), F.col("dst").alias("qualified_name")).distinct()
    stamp = log.select("source_commit", "author", "committed_at")
    nodes = nodes.unionByName(made, allowMissingColumns=True).join(stamp, "source_commit").withColumn("code_bound_at", F.col("committed_at"))
    edges = edges.unionByName(member, allowMissingColumns=True).join(stamp, "source_commit").withColumn("code_bound_at", F.col("committed_at"))
    changes = history.changed_paths(spread(log.select("source_commit"), "source_commit"), repo).where(F.col("status") != "D")
    mods = changes.join(stamp, "source_commit").select(F.lit("MODIFIES").alias("kind"), F.col("source_commit").alias("src"), F.col("path").alias("dst"), F.lit("deterministic").alias("edge_kind"), "source_commit", "author", "committed_at")
    return scratch.keep(_shaped(nodes, NODES_DDL)), scratch.keep(_shaped(edges, EDGES_DDL)), scratch.keep(_shaped(mods, EDGES_DDL))


def backfill(spark: SparkSession, repo: str, store: Store) -> Captured:
    """Folds every commit of HEAD's history into the store's bare plane. An empty repository gives zeros; the same history again changes nothing."""
    scratch = Scratch(spark)
    log = history.commits(spark, repo) if history.has_commits(repo) else None
    if log is None:
        return Captured(0, 0, 0, 0)
    nodes, edges, mods = snapshots(spark, repo, log, scratch)
    store.upsert("nodes", nodes)
    mods = graph.admit_modifies(mods, store.read("nodes"))
    store.upsert("edges", edges.unionByName(mods))
    head = log.orderBy(F.desc("commit_ord")).first()["source_commit"]
    done = Captured(log.count(), nodes.where(F.col("source_commit") == head).count(), edges.where(F.col("source_commit") == head).count(), mods.count())
    scratch.close()
    return done


def capture(spark: SparkSession, repo: str, branches: list[str], store: Store) -> Captured:
    """Each branch's whole history in a plane of its own. Every commit is read once and its rows go to all branches that reach it.

    A shallow clone and unknown branches are refused before anything is written. Planes are wiped first; the manifest says `pending` for each branch until all is
    stored, then `captured`, so a capture that broke off can be told.
    """
    names = history.check_branches(repo, branches)
    scratch = Scratch(spark)
    member = scratch.keep(history.membership(spark, repo, names))
    per = {r["branch"]: r["n"] for r in member.groupBy("branch").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per branch
    manifest = lambda status, at: spark.createDataFrame([(f"capture:{chr(31).join(names)}{chr(31)}{b}", b, status, per.get(b, 0), history.head(repo, b), at) for b in names], "id string, branch string, status string, commit_count long, head_sha string, captured_at string")
    store.write_manifest(manifest("pending", None))
    log = history.commits(spark, repo, *[f"refs/heads/{b}" for b in names])
    nodes, edges, _ = snapshots(spark, repo, log, scratch)
    nodes = nodes.drop("branch").join(member, "source_commit").withColumn("id", scoped_id(F.col("branch"), F.col("qualified_name")))
    edges = edges.join(member, "source_commit").withColumns({"src": scoped_id(F.col("branch"), F.col("src")), "dst": scoped_id(F.col("branch"), F.col("dst"))}).drop("branch")
    for b in names:
        if store.read("nodes") is not None:
            store.wipe_plane(b)
    store.upsert("nodes", _shaped(nodes, NODES_DDL))
    store.upsert("edges", _shaped(edges, EDGES_DDL))
    store.write_manifest(manifest("captured", datetime.datetime.now(datetime.timezone.utc).isoformat()))
    done = Captured(log.count(), nodes.count(), edges.count(), 0, tuple(names))
    scratch.close()
    return done
