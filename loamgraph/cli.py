"""Command line over a store: fold histories, load payloads, ask."""

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.operators import answers, hierarchy, loaders, recall, traverse
from loamgraph.session import local_session
from loamgraph.sources import capture, history
from loamgraph.sources.store import Store

SUMMARIES = "summary_id string, target_id string, claims array<struct<text string, source_refs array<string>>>, generator string, model string, source_commit string, created_at string, confidence double, embedding array<float>, embedding_model string"
DECISIONS = "decision_id string, title string, decides array<string>, supersedes array<string>, addresses_risks array<string>, generator string, model string, source_commit string, created_at string, confidence double"
RISKS = "title string, flags array<string>, generator string, model string, source_commit string, created_at string, confidence double"
COVERAGE = "batch_no long, test_qualified_name string, covered array<string>, source_commit string"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loamgraph")
    p.add_argument("--store", required=True, help="folder of the graph")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, *names, limit=True):
        c = sub.add_parser(name)
        for n in names:
            c.add_argument(n)
        if limit:
            c.add_argument("--limit", type=int, default=25)
        return c

    add("backfill", "repo", limit=False)
    add("capture", "repo", limit=False).add_argument("branches", nargs="+")
    add("query", "id").add_argument("--depth", type=int, default=1)
    add("reconcile", "name").add_argument("--branch", action="append")
    for name in ("churn", "edge-precision", "call-locality", "refactor-candidates"):
        add(name)
    add("cochange", "file")
    add("test-impact", "id").add_argument("--depth", type=int, default=10)
    add("runtime-test-impact", "id")
    c = add("changeset-impact")
    c.add_argument("--file", action="append", default=[])
    c.add_argument("--method", action="append", default=[])
    c.add_argument("--commit")
    for name in ("load", "load-decisions", "load-risks", "load-coverage"):
        add(name, "path", limit=False)
    return p


def _show(df: DataFrame, limit: int) -> int:
    for r in df.limit(limit).collect():
        print("\t".join("" if v is None else str(v) for v in r))
    return 0


def run(args: argparse.Namespace, spark) -> int:
    """0, or 2 if a seed or branch is missing."""
    store = Store(spark, args.store)
    if args.command == "backfill":
        print(capture.backfill(spark, args.repo, store))
        return 0
    if args.command == "capture":
        try:
            print(capture.capture(spark, args.repo, args.branches, store))
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        return 0
    now, edges = store.read("nodes"), store.read("edges")
    if now is None or edges is None:
        print("the store is empty", file=sys.stderr)
        return 2
    seed = getattr(args, "id", None) or getattr(args, "file", None) if args.command != "changeset-impact" else None
    if isinstance(seed, str) and not now.where(F.col("id") == seed).limit(1).count():
        print(f"{seed!r} is no node of the graph", file=sys.stderr)
        return 2
    mods = edges.where(F.col("kind") == "MODIFIES")
    if args.command == "query":
        print(recall.text_of(recall.Graph(now, edges).recall(args.id, args.depth, args.limit)))
    elif args.command == "reconcile":
        rows = recall.Graph(now, edges).peers(args.name, args.branch, args.limit)
        for peer, said in rows:
            print(peer, recall.text_of(said), sep="\n")
        return 0 if rows else 2
    elif args.command == "churn":
        return _show(answers.churn(mods).orderBy(F.desc("churn"), "file_id"), args.limit)
    elif args.command == "cochange":
        pairs = answers.cochange(now.where(F.col("id") == args.file).select(F.col("id").alias("seed")).distinct(), mods)
        return _show(pairs.orderBy(F.desc("n_commits"), "file_id"), args.limit)
    elif args.command == "edge-precision":
        return _show(answers.edge_precision(edges, now).orderBy("src", "kind", "dst"), args.limit)
    elif args.command in ("call-locality", "refactor-candidates"):
        local = answers.call_locality(edges, now, answers.package_of(hierarchy.containers_by_depth(edges), now))
        return _show((answers.refactor_candidates(local) if args.command == "refactor-candidates" else local).orderBy("src"), args.limit)
    elif args.command == "test-impact":
        one = now.where(F.col("id") == args.id).select(F.col("id").alias("seed"), "id").distinct()
        return _show(traverse.test_impact(one, edges, now, args.depth).orderBy("depth", "id").select("id", "depth"), args.limit)
    elif args.command == "runtime-test-impact":
        return _show(answers.runtime_impact(edges, now).where(F.col("method_id") == args.id).orderBy("test_id"), args.limit)
    elif args.command == "changeset-impact":
        seeds = traverse.change_set(now, edges, args.file, args.method, args.commit)
        return _show(traverse.test_impact(seeds, edges, now).groupBy("id").agg(F.min("depth").alias("depth")).orderBy("depth", "id"), args.limit)
    else:
        ddl = {"load": SUMMARIES, "load-decisions": DECISIONS, "load-risks": RISKS, "load-coverage": COVERAGE}[args.command]
        payload = history.payloads(spark, args.path, ddl)
        if args.command == "load-coverage":
            rows, report = loaders.coverage_load(payload, now)
            rows = rows.select(F.lit("COVERS").alias("kind"), F.col("test_id").alias("src"), F.col("method_id").alias("dst"), F.lit("runtime").alias("edge_kind"))
        else:
            judge, make = {"load": (loaders.judged_summaries, loaders.summary_rows), "load-decisions": (loaders.judged_decisions, loaders.decision_rows), "load-risks": (loaders.judged_risks, loaders.risk_rows)}[args.command]
            # what earlier loads brought counts as known beside the nodes
            known = now.select("id").union(edges.where(F.col("edge_kind") == "inferred").select("src")).distinct()
            rows, report = make(payload, known, now), judge(payload, known).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))
        store.upsert("edges", capture._shaped(rows, capture.EDGES_DDL))
        return _show(report, 1000)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return run(args, local_session())


if __name__ == "__main__":
    sys.exit(main())
