"""Scalar rules, planes, walks, channels and loaders on small graphs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loamgraph.functions import identity, instants, routes
from loamgraph.operators import answers, components, graph, loaders, traverse
from loamgraph.schema import EDGES_DDL, NODES_DDL

T1, T2 = "2025-09-03T16:22:54+09:00", "2025-09-04T00:00:00Z"


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize("given,wanted", [("api//orders/", "/api/orders"), ("", "/"), ("/api/users/[id]", "/api/users/[id]")])
def test_endpoint_path(spark, given, wanted):
    assert value(spark, routes.endpoint_path(F.lit(given))) == wanted


@pytest.mark.parametrize("segment,wanted", [("[id]", "{}"), ("{userId}", "{}"), ("{id:[0-9]+}", "{}"), (":id", "{}"), ("${id}", "{}"), ("[[slug]]", "{}"), ("[...rest]", "{**}"), ("**", "{**}"), ("{*path}", "{**}"), ("Users", "Users")])
def test_canonical_path(spark, segment, wanted):
    once = routes.canonical_path(F.lit(f"https://h.example/API/{segment}"))
    assert value(spark, once) == f"/API/{wanted}"
    assert value(spark, routes.canonical_path(once)) == f"/API/{wanted}"


def test_match_key_and_call_name(spark):
    for qn in ("GET /api/users/[id]", "spring:GET /api/users/{userId}", "apicall:GET /api/users/{}"):
        assert value(spark, routes.match_verb(F.lit(qn))) == "GET"
        assert value(spark, routes.match_path(F.lit(qn))) == "/api/users/{}"
    assert value(spark, routes.api_call_name(F.lit("get"), F.lit("`/api/orders/${id}`"))) == "apicall:GET /api/orders/{}"
    for bad in ("url", "'/a' + b", "`${x}`"):
        assert value(spark, routes.api_call_name(F.lit("GET"), F.lit(bad))) is None


def test_confidence(spark):
    f, t = F.lit(False), F.lit(True)
    assert value(spark, routes.match_confidence(f, f, f, F.lit(1))) == 1.0
    assert value(spark, routes.match_confidence(f, f, t, F.lit(1))) == 0.7
    assert value(spark, routes.match_confidence(f, f, t, F.lit(2))) == 0.4
    assert value(spark, routes.match_confidence(t, t, f, F.lit(1))) == 0.4


def test_instants(spark):
    ts = {x: value(spark, F.unix_seconds(instants.instant(F.lit(x)))) for x in ("2024-01-01T09:00:00+09:00", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00", "not-a-date", "")}
    assert ts["2024-01-01T09:00:00+09:00"] == ts["2024-01-01T00:00:00Z"] == 1704067200
    assert ts["2024-01-01T00:00:00"] is None and ts["not-a-date"] is None and ts[""] is None


def test_scores(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    assert value(spark, routes.relevance(routes.cosine(a, F.array(F.lit(0.0), F.lit(2.0))))) == 0.5
    assert value(spark, routes.relevance(routes.cosine(a, F.array(F.lit(-1.0), F.lit(0.0))))) == 0.5
    assert value(spark, routes.cosine(a, F.array(F.lit(1.0)))) is None
    for bad in ([1.0], [1.0, float("nan")], "x", None):
        with pytest.raises(ValueError):
            routes.check_query_vector(bad, 2)


def nodes(spark, *rows):
    """kind, qualified_name, branch, path, is_test, commit, time"""
    full = [(k, q if b is None else f"branch:{b}\x1f{q}", q, q, b, p, 1, 2, t, None, None, None, c, "who <w@x>", at, at, None) for k, q, b, p, t, c, at in rows]
    return spark.createDataFrame(full, NODES_DDL)


def edges(spark, *rows):
    """kind, src, dst, resolution"""
    return spark.createDataFrame([(k, s, d, None, r, "c", "who", T1, T1, None, None, None, None, None, None) for k, s, d, r in rows], EDGES_DDL)


def test_planes(spark):
    n = nodes(spark, ("Class", "A", None, "a.java", None, "c1", T1), ("Class", "A", "main", "a.java", None, "c2", T2), ("Class", "A", "gone", "a.java", None, "c3", T2))
    e = edges(spark, ("CALLS", "A", "A", "typed"), ("CALLS", "branch:main\x1fA", "A", "typed"))
    left, le = graph.wipe_plane(n, e, "main")
    assert {r.branch for r in left.collect()} == {None, "gone"} and le.count() == 1
    assert {r.branch for r in graph.reap_planes(n, e, ["main"])[0].collect()} == {None, "main"}
    with pytest.raises(ValueError):
        graph.wipe_plane(n, e, None)
    pn, pe = graph.to_plane(n.where("branch is null"), e.limit(1), "dev")
    assert pn.first()["id"] == "branch:dev\x1fA" == pe.first()["src"] and identity.PLANE_SEPARATOR == "\x1f"


def test_last_write_wins_and_replay(spark):
    n = nodes(spark, ("File", "f", None, "old", None, "c1", T1), ("File", "f", None, "new", None, "c2", "2025-09-04T10:00:00+09:00"), ("File", "f", None, "x", None, "c3", "no time"))
    once = [tuple(r) for r in graph.nodes_now(n).collect()]
    assert len(once) == 1 and once[0][5] == "new"
    assert [tuple(r) for r in graph.nodes_now(n.union(n)).collect()] == once
    assert graph.nodes_now(n.limit(0)).count() == 0


def test_neighbourhood_bounds(spark):
    star = edges(spark, *[("CALLS", "hub", f"n{i:02d}", "typed") for i in range(40)], ("MODIFIES", "hub", "zz", None), ("CONTAINS", "n00", "deep", None))
    known = spark.createDataFrame([(f"n{i:02d}",) for i in range(40)] + [("hub",), ("deep",), ("zz",)], "id string")
    seeds = spark.createDataFrame([("hub",), ("unknown",)], "seed string")
    got = traverse.neighbourhood(seeds, star, known, 1, 3).collect()
    assert sorted(r["id"] for r in got) == ["hub", "n00", "n01"] and {r["seed"] for r in got} == {"hub"}
    assert traverse.neighbourhood(seeds, star, known, 1, 1).count() == 1
    two = {r["id"]: r["depth"] for r in traverse.neighbourhood(seeds, star, known, 2, 60).collect()}
    assert two["deep"] == 2 and "zz" not in two and len(two) == 42
    assert traverse.neighbourhood(seeds, star, known, 1, 60, relations=["MODIFIES"]).count() == 1


def test_neighbourhood_limits_by_hop_and_start(spark):
    """Both ways of a second hop with a limit of its own, against a walk in Python; a hub lies beyond every limit."""
    links = {(f"n{i:02d}", f"n{(i * i + k) % 60:02d}") for i in range(60) for k in (1, 7)} | {("n05", f"n{i:02d}") for i in range(60)}
    rows = [(k, a, b, None) for a, b in sorted(links) for k in (["CALLS", "CONTAINS"] if a < b else ["IMPORTS"])]
    e, known = edges(spark, *rows, ("CALLS", "n01", "unknown", None)), spark.createDataFrame([(f"n{i:02d}",) for i in range(60)], "id string")
    near = {}
    for kind, a, b, _ in rows:
        for x, y in ((a, b), (b, a)):
            if x != y:
                near.setdefault(x, {}).setdefault(y, []).append(kind)
    want = set()
    for seed in sorted(near):
        seen, last = {seed}, [seed]
        for d, limit in ((1, 4), (2, 9)):
            found = {}
            for a in last:
                for b, kinds in near[a].items():
                    if b not in seen:
                        found.setdefault(b, []).extend(kinds)
            last = sorted(found)[: limit - len(seen)]
            seen |= {*last}
            want |= {(seed, b, min(found[b]), d) for b in last}
    seeds, got = known.withColumnRenamed("id", "seed"), lambda df: sorted(tuple(r) for r in df.where("depth > 0").collect())
    one = traverse.neighbourhood(seeds, e, known, 1, 4)
    assert got(traverse.neighbourhood(seeds, e, known, 2, [4, 9])) == sorted(want)
    assert got(traverse.neighbourhood(None, e, known, 1, 9, start=one)) == sorted(want)
    assert got(traverse.neighbourhood(seeds, e, known, 2, [4, 9], since=2)) == sorted(r for r in want if r[3] == 2)
    assert traverse.neighbourhood(seeds, e, known, 2, 1, since=2).count() == 0


def test_neighbourhood_does_not_shuffle_candidates(spark):
    """400 seeds call 24 of 200 methods each, and meet some 400 candidates at the second hop, of which 25 stay: these alone are moved."""
    rng, name = random.Random(1), lambda k, i: k + hashlib.sha256(f"{k}{i}".encode()).hexdigest()
    e = edges(spark, *[("CALLS", name("m", i), name("h", k), None) for i in range(400) for k in rng.sample(range(200), 24)]).localCheckpoint()
    known = spark.createDataFrame([(name("m", i),) for i in range(400)] + [(name("h", k),) for k in range(200)], "id string").localCheckpoint()
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    assert traverse.neighbourhood(known.where("id like 'm%'").withColumnRenamed("id", "seed"), e, known, 2, 50).agg(F.count("id")).first()[0] == 400 * 50
    assert shuffled() - before < 4_000_000


def test_test_impact(spark):
    e = edges(spark, ("CALLS", "t1", "m", "typed"), ("CALLS", "h", "m", "typed"), ("CALLS", "t2", "h", "typed"), ("CALLS", "m", "m", "typed"))
    n = nodes(spark, ("Method", "m", None, "p", None, "c", T1), ("Method", "h", None, "p", None, "c", T1), ("Method", "t1", None, "p", True, "c", T1), ("Method", "t2", None, "p", True, "c", T1))
    seeds = spark.createDataFrame([("m", "m")], "seed string, id string")
    assert {(r["id"], r["depth"]) for r in traverse.test_impact(seeds, e, n).collect()} == {("t1", 1), ("t2", 2)}


def test_churn_and_cochange(spark):
    m = spark.createDataFrame([("e1", "SVC"), ("e1", "CTRL"), ("e2", "SVC"), ("e3", "SVC")], "src string, dst string")
    assert {tuple(r) for r in answers.churn(m).collect()} == {("SVC", 3), ("CTRL", 1)}
    assert [tuple(r) for r in answers.cochange(spark.createDataFrame([("SVC",)], "seed string"), m).collect()] == [("SVC", "CTRL", 1)]


def test_locality_and_candidates(spark):
    kinds = [("Package", p, None, None, None, "c", T1) for p in "abc"] + [("Method", f"m{p}", None, f"src/{p}.java", None, "c", T1) for p in "abc"]
    n = nodes(spark, *kinds)
    packages = spark.createDataFrame([(f"m{p}", p, 1) for p in "abc"], "node_id string, package_id string, n_paths long")
    e = edges(spark, ("CALLS", "ma", "mb", "typed"), ("CALLS", "ma", "mc", "name"))
    r = answers.call_locality(e, n, packages).first()
    assert (r["cross_calls"], r["same_calls"], r["unresolved_calls"], r["name_calls"], r["cross_ratio"]) == (1, 0, 0, 1, 1.0)
    c = answers.refactor_candidates(answers.call_locality(e, n, packages)).first()
    assert c["facts"] == "1 typed call(s) into other packages, 1 by name only" and c["cross_ids"] == "mb"


def test_peers(spark):
    n = nodes(spark, ("Class", "A", "x", "p", None, "c1", "2025-01-01T09:00:00+09:00"), ("Class", "A", "y", "p", None, "c2", "2025-01-01T05:00:00+00:00"), ("Class", "A", "z", "p", None, "c2", "2025-01-01T05:00:00"), ("Class", "B", None, "p", None, "c", T1))
    got = {r["branch"]: r for r in answers.peers(n).collect()}
    assert [b for b, _ in sorted(got.items(), key=lambda kv: kv[1]["rank"])] == ["y", "x", "z"]
    assert got["y"]["freshest"] and not got["x"]["freshest"] and not got["z"]["freshest"] and got["x"]["diverged"]


def test_components_any_order(spark):
    rnd = random.Random(1)
    pairs = [(f"v{rnd.randrange(60):02d}", f"v{rnd.randrange(60):02d}") for _ in range(45)] + [("z1", "z2"), (None, "z1")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    for order in (pairs, [(b, a) for a, b in reversed(pairs)]):
        got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(order, "a string, b string"), spark.createDataFrame([("lone",)], "node string")).collect()}
        assert got == {**{v: find(v) for v in parent}, "lone": "lone"}


def test_channels(spark):
    n = nodes(spark, ("Class", "A", None, "p", None, "c", T2), ("Class", "B", None, "p", None, "c", T1))
    e = edges(spark, ("SUMMARIZES", "s1", "A", None), ("SUMMARIZES", "s1", "B", None), ("SUMMARIZES", "s2", "A", None), ("SUMMARIZES", "s2", "nowhere", None))
    got = {(r["anchor"], r["entity_id"]): (r["is_stale"], r["refs"]) for r in answers.entity_channel(e, n).collect()}
    assert got == {("A", "s1"): (True, "A|B"), ("A", "s2"): (True, "A"), ("B", "s1"): (False, "A|B")}
    cut = answers.entity_channel(e, n, limit=1).where("anchor='A'").first()
    assert cut["refs"] == "A" and cut["is_stale"]


SUMMARIES = "summary_id string, target_id string, claims array<struct<text:string,source_refs:array<string>>>, generator string, model string, source_commit string, created_at string, embedding array<float>, embedding_model string"


def test_summary_rules(spark):
    ok = [("t", ["A"])]
    v = [0.0] * 63 + [1.0]
    rows = [
        ("1", "A", ok, " ", "m", "c", T1, None, None),
        ("2", "A", ok, "g", None, "c", T1, None, None),
        ("3", "A", [], "g", "m", "c", T1, None, None),
        ("4", "A", [("t", [])], "g", "m", "c", T1, None, None),
        ("5", "A", ok, "g", "m", "c", T1, [1.0], "e"),
        ("6", "A", ok, "g", "m", "c", T1, v, None),
        ("7", "nowhere", ok, "g", "m", "c", T1, v, "e1"),
        ("8", "A", ok, "g", "m", "c", T2, v, "e2"),
        ("9", "A", ok, "g", "m", "c", T2, v, "e1"),
        ("9", "A", ok, "g", "m", "c", T2, v, "e1"),
    ]
    got = {r[0]: r[2] for r in loaders.judged_summaries(spark.createDataFrame(rows, SUMMARIES), spark.createDataFrame([("A",)], "id string")).collect()}
    assert got == {"1": "no generator", "2": "no model", "3": "no claims", "4": "claim without references", "5": "embedding length", "6": "embedding without model", "7": "unknown reference", "8": "another embedding model", "9": None}


def test_coverage_load(spark):
    n = nodes(spark, ("Method", "t", None, "p", True, "c", T1), ("Method", "m", None, "p", None, "c", T1), ("Method", "m", "b", "p", None, "c", T1))
    r = spark.createDataFrame([("t", ["m", "gone", None], 1), ("m", ["t"], 1), ("t", None, 2)], "test_qualified_name string, covered array<string>, batch_no long")
    e, report = loaders.coverage_load(r, n)
    assert [tuple(x) for x in e.collect()] == [("t", "m")]
    assert {tuple(x) for x in report.select("batch_no", "intended", "rejected", "loaded", "skipped").collect()} == {(1, 2, 1, 1, 1), (2, 1, 0, 0, 0)}


def test_relations_and_api_links(spark):
    known = spark.createDataFrame([("A",), ("B",)], "id string")
    r = spark.createDataFrame([("A", "B", "RELATES_TO", "g"), ("A", "B", "CALLS", "g"), ("A", "X", "RELATES_TO", "g"), ("A", "B", "RELATES_TO", "")], "src string, dst string, kind string, generator string")
    assert sorted(str(x["reject_reason"]) for x in loaders.judged_relations(r, known).collect()) == ["None", "no generator", "unknown endpoint", "unknown relation"]
    mk = lambda *q: spark.createDataFrame([(x, x, b) for x, b in q], "id string, qualified_name string, branch string")
    links = answers.api_links(mk(("apicall:GET /a/{}", None), ("apicall:POST /b", "main")), mk(("spring:GET /a/{id}", None), ("* /a/[x]", None), ("POST /b", None)))
    got = {(r["call_id"], r["endpoint_id"]): (r["verb"], r["candidate_count"], r["confidence"]) for r in links.collect()}
    assert got == {("apicall:GET /a/{}", "spring:GET /a/{id}"): ("GET", 2, 0.7), ("apicall:GET /a/{}", "* /a/[x]"): ("GET", 2, 0.4)}


def test_routes(spark):
    e = edges(spark, ("GUARDS", "hook", "GET /safe", None), ("HANDLES", "h", "GET /open", None), ("CALLS", "h", "x", "typed"), ("CALLS", "x", "y", "typed"), ("IMPORTS", "u", "s", None), ("IMPORTS", "s2", "s", None), ("REALIZES", "f", "GET /open", None))
    ep = spark.createDataFrame([("GET /safe",), ("GET /open",), ("spring:GET /z",)], "id string").withColumn("qualified_name", F.col("id"))
    assert [r["id"] for r in answers.unguarded(ep, e).collect()] == ["GET /open"]
    assert {(r["id"], r["depth"]) for r in answers.endpoint_reach(e).collect()} == {("h", 1), ("x", 2), ("y", 3)}
    assert [tuple(r) for r in answers.realized(e).collect()] == [("GET /open", "f")]
    f = nodes(spark, ("File", "u", None, "u", None, "c", T1), ("File", "s", None, "s", None, "c", T1), ("File", "s2", None, "s2", None, "c", T1)).withColumn("server_only", F.when(F.col("id").isin("s", "s2"), F.lit(True)))
    assert [tuple(r) for r in answers.server_only_imports(e, f).collect()] == [("u", "s")]
