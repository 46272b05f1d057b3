"""Questions about the graph, each over all nodes at once or for a table of seeds."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.identity import plane_of
from loamgraph.functions.instants import instant
from loamgraph.functions.routes import cosine, match_confidence, match_path, match_verb, relevance, stale
from loamgraph.sources.tables import Scratch, tasks

#: Files of one commit that count for co-change, in order of id.
CHANGE_FAN_OUT = 512


def churn(modifies: DataFrame) -> DataFrame:
    """file_id, churn: distinct commits that changed each file."""
    return modifies.groupBy(F.col("dst").alias("file_id")).agg(F.count_distinct("src").alias("churn"))


def cochange(seeds: DataFrame, modifies: DataFrame) -> DataFrame:
    """seed, file_id, n_commits: files of the seed's plane changed by the same commits, the seed left out before a commit's files are cut."""
    m = modifies.select(F.col("src").alias("c"), F.col("dst").alias("f")).distinct()
    mine = m.join(seeds.select(F.col("seed").alias("f")), "f", "left_semi").select("c", F.col("f").alias("seed"))
    both = mine.join(m, "c").where((F.col("f") != F.col("seed")) & plane_of(F.col("f")).eqNullSafe(plane_of(F.col("seed"))))
    cut = Window.partitionBy("seed", "c").orderBy("f")
    both = both.withColumn("rn", F.row_number().over(cut)).where(F.col("rn") <= CHANGE_FAN_OUT)
    return both.groupBy("seed", F.col("f").alias("file_id")).agg(F.count(F.lit(1)).alias("n_commits"))


def runtime_impact(edges: DataFrame, now: DataFrame) -> DataFrame:
    """method_id, test_id: tests observed to cover each method."""
    ids = now.where(F.col("kind") == "Method").select("id").distinct()
    c = edges.where(F.col("kind") == "COVERS").select(F.col("dst").alias("method_id"), F.col("src").alias("test_id")).distinct()
    return c.join(ids.withColumnRenamed("id", "method_id"), "method_id", "left_semi").join(ids.withColumnRenamed("id", "test_id"), "test_id", "left_semi")


def edge_precision(edges: DataFrame, now: DataFrame, suffix: str = ".java") -> DataFrame:
    """Calls and dependencies from files of that suffix that rest on a name alone."""
    e = edges.where(F.col("kind").isin("CALLS", "DEPENDS_ON") & (F.col("resolution") == "name"))
    n = now.where(F.col("path").endswith(suffix)).select(F.col("id").alias("src"), F.col("path").alias("src_path")).distinct()
    ids = now.select(F.col("id").alias("dst")).distinct()
    return e.join(n, "src").join(ids, "dst", "left_semi").select("src", "kind", "dst", "src_path")


def package_of(containers: DataFrame, now: DataFrame) -> DataFrame:
    """node_id, package_id, n_paths: every Package above a node, with the number of containment paths."""
    p = now.where(F.col("kind") == "Package").select(F.col("id").alias("ancestor_id")).distinct()
    return containers.join(p, "ancestor_id", "left_semi").select("node_id", F.col("ancestor_id").alias("package_id"), "n_paths")


def call_locality(edges: DataFrame, now: DataFrame, packages: DataFrame, suffix: str = ".java") -> DataFrame:
    """Per caller in files of that suffix: typed calls into other packages, into its own, with a package unknown, and calls by name; their ratio.

    A node in several packages, or in one by several paths, counts once for each path, as containment paths do.
    """
    callers = now.where((F.col("kind") == "Method") & F.col("path").endswith(suffix)).select(F.col("id").alias("src"), "path").groupBy("src").agg(F.min("path").alias("path"))
    c = edges.where(F.col("kind") == "CALLS").select("src", "dst", "resolution").join(callers, "src")
    c = c.join(now.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    mine = packages.select(F.col("node_id").alias("src"), F.col("package_id").alias("p"), F.col("n_paths").alias("np"))
    theirs = packages.select(F.col("node_id").alias("dst"), F.col("package_id").alias("q"), F.col("n_paths").alias("nq"))
    j = c.join(mine, "src", "left").join(theirs, "dst", "left").withColumn("n", F.coalesce("np", F.lit(1)) * F.coalesce("nq", F.lit(1)))
    typed = F.col("resolution") == "typed"
    known = F.col("p").isNotNull() & F.col("q").isNotNull()
    add = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias(name)
    g = j.groupBy("src", "path").agg(
        add(typed & known & (F.col("p") != F.col("q")), "cross_calls"),
        add(typed & known & (F.col("p") == F.col("q")), "same_calls"),
        add(typed & ~known, "unresolved_calls"),
        add(F.col("resolution") == "name", "name_calls"),
        F.array_join(F.array_sort(F.collect_set(F.when(typed & known & (F.col("p") != F.col("q")), F.col("dst")))), "|").alias("cross_ids"),
    )
    all_known = F.col("cross_calls") + F.col("same_calls")
    return g.withColumn("cross_ratio", F.when(all_known > 0, F.round(F.col("cross_calls") / all_known, 6)).otherwise(F.lit(0.0)))


def refactor_candidates(locality: DataFrame) -> DataFrame:
    """Callers that cross packages and also call by name, with the ids that ground it and a neutral sentence."""
    c = locality.where((F.col("cross_calls") > 0) & (F.col("name_calls") > 0))
    return c.withColumn("facts", F.format_string("%d typed call(s) into other packages, %d by name only", "cross_calls", "name_calls"))


def peers(now: DataFrame) -> DataFrame:
    """Per symbol in two planes or more: each plane's row ranked newest first, whether it is freshest, and whether the planes' commits differ.

    Rows without a readable instant come last and are never freshest.
    """
    n = now.select("kind", "qualified_name", "branch", "source_commit", "committed_at").where(F.col("qualified_name").isNotNull()).withColumn("at", instant("committed_at"))
    w = Window.partitionBy("kind", "qualified_name")
    n = n.withColumn("n_planes", F.count(F.lit(1)).over(w)).where(F.col("n_planes") > 1)
    o = w.orderBy(F.desc_nulls_last("at"), F.asc_nulls_first("branch"))
    n = n.withColumns({"rank": F.row_number().over(o).cast("long"), "freshest": F.coalesce(F.col("at") == F.max("at").over(w), F.lit(False)), "lo": F.min("source_commit").over(w), "hi": F.max("source_commit").over(w)})
    return n.select("kind", "qualified_name", "branch", "source_commit", "rank", "freshest", (F.col("lo") != F.col("hi")).alias("diverged"), "n_planes")


def entity_channel(links: DataFrame, now: DataFrame, limit: int = 25) -> DataFrame:
    """anchor, entity_id, is_stale, refs: for each node, the entities (src of links) about it with all nodes these refer to.

    The first `limit` (entity, reference) rows of an anchor count, in order of entity and reference; whether an entity is stale at its anchor comes from the anchor's
    own row, which is not cut. stale: the text of the time its code was bound at differs from the node's.
    """
    ids = newest_committed(now)
    l = links.select(F.col("src").alias("entity_id"), F.col("dst").alias("ref"), "code_bound_at").join(ids.withColumnRenamed("id", "ref"), "ref")
    l = l.withColumn("is_stale", stale(F.col("code_bound_at"), F.col("committed_at"))).select("entity_id", "ref", "is_stale")
    anchors = l.select(F.col("ref").alias("anchor"), "entity_id", "is_stale")
    rows = anchors.join(l.select("entity_id", "ref"), "entity_id")
    w = Window.partitionBy("anchor").orderBy("entity_id", "ref")
    rows = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)
    return rows.groupBy("anchor", "entity_id").agg(F.max("is_stale").alias("is_stale"), F.array_join(F.array_sort(F.collect_list("ref")), "|").alias("refs"))


def newest_committed(now: DataFrame) -> DataFrame:
    """id, committed_at of the node with the smallest kind of that id."""
    return now.groupBy("id").agg(F.min_by("committed_at", "kind").alias("committed_at"))


def decision_channel(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """decision_id, target, relation, valid_from, valid_to, live: what each decision is about, and whether a later one superseded it.

    valid_to is the creation time of the decision that was loaded last (ingested_at, then instant, then text) of those that supersede it; the decision lives while there is none.
    """
    d = decisions.groupBy("decision_id").agg(F.min("created_at").alias("valid_from"))
    s = edges.where(F.col("kind") == "SUPERSEDES").select(F.col("dst").alias("decision_id"), F.struct("ingested_at", instant("created_at").alias("t"), "created_at").alias("c"))
    ends = s.groupBy("decision_id").agg(F.max("c").alias("c")).select("decision_id", F.col("c.created_at").alias("valid_to"))
    t = edges.where(F.col("kind").isin("DECIDES", "SUPERSEDES", "ADDRESSES_RISK")).select(F.col("src").alias("decision_id"), F.col("dst").alias("target"), F.col("kind").alias("relation"))
    return t.join(d, "decision_id").join(ends, "decision_id", "left").withColumn("live", F.col("valid_to").isNull())


def risk_channel(decisions: DataFrame) -> DataFrame:
    """risk_id, n_decisions, decided: decisions that address each risk and the nodes they decide."""
    d = decisions.groupBy("decision_id").agg(F.min("addresses_risks").alias("rs"), F.min("decides").alias("ds"))
    r = d.select("decision_id", F.explode("rs").alias("risk_id"), "ds")
    flat = r.select("risk_id", "decision_id", F.explode_outer("ds").alias("t"))
    return flat.groupBy("risk_id").agg(F.count_distinct("decision_id").alias("n_decisions"), F.array_join(F.array_sort(F.collect_set("t")), "|").alias("decided"))


def relation_channel(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """anchor, relation, other, direction: each inferred relation from both of its ends."""
    e = edges.where(F.col("kind").isin(kinds)).select("src", "dst", "kind").distinct()
    out = e.select(F.col("src").alias("anchor"), F.col("kind").alias("relation"), F.col("dst").alias("other"), F.lit("out").alias("direction"))
    return out.union(e.where(F.col("src") != F.col("dst")).select("dst", "kind", "src", F.lit("in")))


def semantic(summaries: DataFrame, query: Column, k: int, floor: float = 0.6, branches: list[str] | None = None, vector: str = "embedding", dimension: int = 64) -> DataFrame:
    """summary_id, target_id, score of the k best summaries for a query vector, above the floor.

    The planes asked for are chosen after the k best, so fewer may come back; filter the summaries first to choose before.
    """
    fine = (F.size(vector) == dimension) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))
    s = summaries.where(F.coalesce(fine, F.lit(False))).groupBy("summary_id").agg(F.min("target_id").alias("target_id"), F.min(vector).alias("v"))
    s = s.withColumn("score", relevance(cosine(F.col("v"), query))).where(F.col("score") >= floor).drop("v")
    top = s.orderBy(F.desc("score"), "summary_id").limit(max(1, k))
    return top if branches is None else top.where(plane_of(F.col("target_id")).isin(*branches))


def _usable(summaries: DataFrame, vector: str, dimension: int) -> DataFrame:
    fine = (F.size(vector) == dimension) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    s = summaries.where(F.coalesce(fine, F.lit(False)) & F.col("summary_id").isNotNull())
    return s.groupBy("summary_id").agg(F.min("target_id").alias("target_id"), F.min(vector).alias("v"))


#: Vectors of one block of queries or of summaries.
QUERY_BLOCK, SUMMARY_BLOCK = 1024, 4096


def semantic_many(summaries: DataFrame, queries: DataFrame, k: int, floor: float = 0.6, branches: list[str] | None = None, vector: str = "embedding", dimension: int = 64, scratch: Scratch | None = None) -> DataFrame:
    """query_id, summary_id, target_id, score: `semantic` for each vector of a table of queries (summary_id and vector) against all summaries.

    Both sides are dealt to blocks; a block of summaries meets each block of queries in one task, as two matrices, and keeps each query's k best; those of all blocks
    are then ranked. Cosines in double precision, ties to the smaller id.
    """
    scratch = scratch or Scratch(summaries.sparkSession)
    rows, n = scratch.counted(_usable(summaries, vector, dimension))
    asked, q = scratch.counted(_usable(queries, vector, dimension))
    deal = lambda df, count, size, name: df.withColumn(name, F.pmod(F.xxhash64("summary_id"), F.lit(-(-count // size) or 1)).cast("int"))
    blocks = -(-q["n"] // QUERY_BLOCK) or 1
    left = deal(rows, n["n"], SUMMARY_BLOCK, "sb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("sb", "qb", "summary_id", "v")
    right = deal(asked, q["n"], QUERY_BLOCK, "qb").withColumn("sb", F.explode(F.sequence(F.lit(0), F.lit((-(-n["n"] // SUMMARY_BLOCK) or 1) - 1)))).select("sb", "qb", F.col("summary_id").alias("query_id"), "v")

    def meet(s, q):
        if not len(s) or not len(q):
            return pd.DataFrame({"query_id": pd.Series([], dtype=object), "summary_id": pd.Series([], dtype=object), "score": pd.Series([], dtype=float)})
        s = s.sort_values("summary_id")
        unit = lambda c: (lambda m: m / np.sqrt((m * m).sum(1, keepdims=True)))(np.stack(c.to_numpy()).astype(float))
        score = (1 + np.maximum(np.einsum("ij,kj->ik", unit(q["v"]), unit(s["v"])), 0)) / 2
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]  # stable: equal scores stay in order of id
        at = np.repeat(np.arange(len(q)), order.shape[1])
        best = score[at, order.ravel()]
        fine = best >= floor
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[at[fine]], "summary_id": s["summary_id"].to_numpy()[order.ravel()[fine]], "score": best[fine]})

    parallel = tasks(summaries.sparkSession)
    found = left.repartition(parallel, "sb", "qb").groupBy("sb", "qb").cogroup(right.repartition(parallel, "sb", "qb").groupBy("sb", "qb")).applyInPandas(meet, "query_id string, summary_id string, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "summary_id")
    top = found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(1, k)).drop("rn").join(rows.select("summary_id", "target_id"), "summary_id")
    return top if branches is None else top.where(plane_of(F.col("target_id")).isin(*branches))


def api_links(calls: DataFrame, endpoints: DataFrame, host_grounded: Column | None = None) -> DataFrame:
    """call_id, endpoint_id, matched_route, verb, candidate_count, confidence: calls and endpoints on one canonical route, in one plane.

    Equal routes are joined by hash; verbs then agree, or one of them is a wildcard.
    """
    c = calls.select(F.col("id").alias("call_id"), match_verb(F.col("qualified_name")).alias("cv"), match_path(F.col("qualified_name")).alias("route"), F.coalesce("branch", F.lit("")).alias("b"), (host_grounded if host_grounded is not None else F.lit(False)).alias("grounded"))
    e = endpoints.select(F.col("id").alias("endpoint_id"), match_verb(F.col("qualified_name")).alias("ev"), match_path(F.col("qualified_name")).alias("route"), F.coalesce("branch", F.lit("")).alias("b"))
    j = c.join(e, ["route", "b"]).where((F.col("cv") == F.col("ev")) | (F.col("cv") == "*") | (F.col("ev") == "*"))
    j = j.withColumn("candidate_count", F.count(F.lit(1)).over(Window.partitionBy("call_id")))
    wild = (F.col("cv") == "*") | (F.col("ev") == "*")
    verb = F.when(F.col("cv") != "*", F.col("cv")).otherwise(F.col("ev"))
    conf = match_confidence(F.col("route").contains("{"), wild, F.col("grounded"), F.col("candidate_count"))
    return j.select("call_id", "endpoint_id", F.col("route").alias("matched_route"), verb.alias("verb"), "candidate_count", conf.alias("confidence"))


def unguarded(endpoints: DataFrame, edges: DataFrame) -> DataFrame:
    """Endpoints of file routes that nothing guards."""
    g = edges.where(F.col("kind") == "GUARDS").select(F.col("dst").alias("id")).distinct()
    return endpoints.where(~F.col("qualified_name").startswith("spring:")).join(g, "id", "left_anti")


def endpoint_reach(edges: DataFrame, depth: int = 10, scratch=None) -> DataFrame:
    """seed (endpoint), id, depth: handlers at 1, what they call from 2."""
    from loamgraph.operators.traverse import reach

    handlers = edges.where(F.col("kind") == "HANDLES").select(F.col("dst").alias("seed"), F.col("src").alias("id")).distinct()
    calls = edges.where(F.col("kind") == "CALLS").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    deeper = reach(handlers, calls, depth - 1, scratch=scratch)
    far = deeper.withColumn("depth", F.col("depth") + 1)
    return handlers.withColumn("depth", F.lit(1)).unionByName(far).groupBy("seed", "id").agg(F.min("depth").alias("depth"))


def realized(edges: DataFrame) -> DataFrame:
    """route_id, file_id: files that realize a route, endpoint, layout or hook; read either way."""
    return edges.where(F.col("kind") == "REALIZES").select(F.col("dst").alias("route_id"), F.col("src").alias("file_id")).distinct()


def server_only_imports(edges: DataFrame, now: DataFrame) -> DataFrame:
    """Files that run anywhere and import files that must stay on the server. A null mark is no mark."""
    i = edges.where(F.col("kind") == "IMPORTS").select("src", "dst").distinct()
    f = now.where(F.col("kind") == "File")
    s = f.where(F.col("server_only")).select(F.col("id").alias("dst"))
    u = f.where(F.col("server_only").isNull()).select(F.col("id").alias("src"))
    return i.join(s, "dst", "left_semi").join(u, "src", "left_semi").select("src", "dst")


def grounding(summaries: DataFrame, known: DataFrame) -> DataFrame:
    """summary_id, n_refs, confidence: the share of claims' references that exist, to 3 decimals, halves to even; 0 without any."""
    s = summaries.groupBy("summary_id").agg(F.min_by("claims", F.to_json("claims")).alias("claims"))
    r = s.select("summary_id", F.explode_outer(F.flatten(F.transform("claims", lambda c: c["source_refs"]))).alias("id"))
    j = r.join(known.select("id").distinct().withColumn("there", F.lit(1)), "id", "left")
    return j.groupBy("summary_id").agg(F.count("id").alias("n_refs"), F.coalesce(F.bround(F.count("there") / F.nullif(F.count("id"), F.lit(0)), 3), F.lit(0.0)).alias("confidence"))
