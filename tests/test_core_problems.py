"""Loops, hierarchies, orphans, histories and heavy keys on small fixtures and against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loamgraph.operators import attribute_history as ah
from loamgraph.operators import heavy_keys, hierarchy, orphans
from loamgraph.plans.core_problems import p3_descendants
from loamgraph.schema import EDGES_DDL, NODES_DDL


def edge_rows(spark, rows, extra=False):
    """kind, src, dst, committed_at"""
    df = spark.createDataFrame(rows, "kind string, src string, dst string, committed_at string")
    return df.withColumns({"salt": F.lit(1), "key_id": F.lit("x"), "partner": F.lit("y"), "n": F.lit(3)}) if extra else df


def closure(links):
    out = defaultdict(set)
    for a, b in links:
        out[a].add(b)
    reach = {}
    for s in {x for e in links for x in e}:
        seen, todo = set(), list(out[s])
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += out[v]
        reach[s] = seen
    return reach


def loops_by_force(links):
    r = closure(links)
    return {(v, min(w for w in r[v] | {v} if w == v or v in r.get(w, ()))) for v in r if v in r[v]}


@pytest.mark.parametrize("seed", range(2))
def test_loops_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    links = [(f"n{rnd.randrange(40):02d}", f"n{rnd.randrange(40):02d}") for _ in range(52)]
    got = {tuple(r) for r in hierarchy.loops(spark.createDataFrame(links, "parent string, child string")).collect()}
    assert got == loops_by_force(set(links))


def test_long_loop_and_self_loop(spark):
    ring = [(f"r{i:03d}", f"r{(i + 1) % 60:03d}") for i in range(60)] + [("a", "a"), ("a", "b"), ("t", "r000")]
    got = {tuple(r) for r in hierarchy.loops(spark.createDataFrame(ring, "parent string, child string")).collect()}
    assert got == loops_by_force(ring)


def test_loops_of_nothing(spark):
    assert hierarchy.loops(hierarchy.distinct_links(spark.createDataFrame([], EDGES_DDL))).count() == 0
    nulls = spark.createDataFrame([(None, "a"), ("a", None)], "src string, dst string").withColumn("kind", F.lit("CONTAINS"))
    assert hierarchy.loops(hierarchy.distinct_links(nulls)).count() == 0


def test_hierarchy(spark):
    rows = [
        ("CONTAINS", "root", "a", "2024-01-01T00:00:00Z"),
        ("CONTAINS", "root", "b", "2024-01-01T00:00:00Z"),
        ("CONTAINS", "a", "c", "2024-01-01T00:00:00Z"),
        ("CONTAINS", "b", "c", "2024-01-01T09:00:00+09:00"),  # the same instant: the smaller parent counts
        ("CONTAINS", "b", "d", "2024-02-01T00:00:00Z"),
        ("CONTAINS", "a", "d", "2024-01-31T23:00:00-05:00"),  # later than the row above
        ("CONTAINS", "a", "d", "2024-01-31T23:00:00-05:00"),
        ("CONTAINS", "x", "y", "2024-01-01T00:00:00Z"),
        ("CONTAINS", "y", "x", "2024-01-01T00:00:00Z"),
        ("CONTAINS", "y", "z", "not a time"),
        ("CONTAINS", None, "q", "2024-01-01T00:00:00Z"),
        ("CALLS", "c", "root", "2024-01-01T00:00:00Z"),
    ]
    nodes = spark.createDataFrame([("lonely",), (None,), ("branch:m\x1flib",)], "id string")
    h = {r["node_id"]: r for r in hierarchy.hierarchy(edge_rows(spark, rows, extra=True), nodes).collect()}
    assert h["c"]["parent_id"] == "a" and h["d"]["parent_id"] == "a" and h["d"]["depth"] == 2
    assert h["d"]["full_path"] == ["root", "a", "d"] and h["d"]["root_id"] == "root"
    assert h["lonely"]["depth"] == 0 and h["branch:m\x1flib"]["full_path"] == ["lib"]
    assert {k for k, r in h.items() if r["state"] == "in_loop_or_below"} == {"x", "y", "z"}
    df = hierarchy.hierarchy(edge_rows(spark, rows))
    pairs = {(r["ancestor_id"], r["descendant_id"], r["distance"]) for r in hierarchy.ancestor_pairs(df).collect()}
    assert pairs == {("root", "a", 1), ("root", "b", 1), ("root", "c", 2), ("root", "d", 2), ("a", "c", 1), ("a", "d", 1)}
    assert {(r[0], r[1], r[2]) for r in hierarchy.descendant_counts(df).collect()} == {("root", 4, 2), ("a", 2, 1)}


def test_descendants_at_loops(spark, tmp_path):
    rnd = random.Random(5)
    parent = {f"n{i:02d}": f"n{rnd.randrange(40):02d}" for i in range(40) if i % 9}
    parent |= {"x": "y", "y": "w", "w": "x", "own": "own", "z": "y", "zz": "z", "leaf": "own", "c": "root"}
    at = "2024-01-01T00:00:00Z"
    edge_rows(spark, [("CONTAINS", p, c, at) for c, p in parent.items()]).write.parquet(str(tmp_path / "edges.parquet"))
    for name in ("nodes", "platform_nodes"):
        spark.createDataFrame([], NODES_DDL).write.parquet(str(tmp_path / f"{name}.parquet"))
    want = set()
    for c in parent:
        seen, v, n = {c}, c, 0
        while parent.get(v, c) not in seen:
            v, n = parent[v], n + 1
            seen.add(v)
            want.add((v, c, n))
    got = [tuple(r) for r in p3_descendants(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {("y", "z", 1), ("y", "zz", 2), ("own", "leaf", 1)} <= want


def test_hierarchy_of_nothing(spark):
    assert hierarchy.hierarchy(spark.createDataFrame([], EDGES_DDL)).count() == 0


def test_reason_parsers(spark):
    q = "`"
    texts = {
        "unresolved edge targets: ['branch:m\x1fa.B#c(Map<String,Long>)', 'decision:1']": ["branch:m\x1fa.B#c(Map<String,Long>)", "decision:1"],
        "targets not found: a.b; c#d(int,long)": ["a.b", "c#d(int,long)"],
        '2 unknown target(s) -> "x[0]" / "y"': ["x[0]", "y"],
        f"refused, nothing behind {q}p.Q{q} | {q}r{q}": ["p.Q", "r"],
        "no decides targets": [],
        "missing model": [],
        "": [],
    }
    df = spark.createDataFrame([(k,) for k in texts] + [(None,)], "reason string")
    got = {r[0]: r[1] for r in df.select("reason", orphans.quoted_or_listed(F.col("reason"))).collect()}
    assert got.pop(None) is None and got == texts
    cov = {"edge skipped, covered method `a#b(int)` not found (test `t`)": "a#b(int)", "unresolved test 't' (not an is_test Method); record rejected": "t", 'covered "a" missing; wanted by "b"': "a", "nothing": None}
    df = spark.createDataFrame([(k,) for k in cov], "r string")
    assert {r[0]: r[1] for r in df.select("r", orphans.first_quoted(F.col("r"))).collect()} == cov


def test_orphans(spark):
    refs = spark.createDataFrame(
        [("edges", "id", "gone", 100), ("edges", "id", "gone", 100), ("edges", "id", "new", 100), ("edges", "id", "new", 10**7), ("edges", "id", "ok", 100), ("edges", "id", "timeless", 1), ("edges", "id", "gone", None)] + [("edges", "id", "hub", 50 + i) for i in range(200)],
        "ref_table string, pool string, ref_id string, s long",
    ).withColumn("ref_at", F.timestamp_seconds("s")).withColumn("exists", F.lit(0))
    known = spark.createDataFrame([("id", "new", 5000), ("id", "ok", 100), ("id", "timeless", None), ("method", "gone", 1), ("id", "hub", 60)], "pool string, ref_id string, s long").withColumn("known_at", F.timestamp_seconds("s")).drop("s")
    for share in (0.002, 0.9):
        got = {tuple(r) for r in orphans.orphan_references(refs.drop("exists"), known, share).collect()}
        assert got == {("edges", "1970-01", "gone", "absent", 2), ("edges", None, "gone", "absent", 1), ("edges", "1970-01", "new", "late", 1), ("edges", "1970-01", "hub", "late", 200)}
    empty = refs.drop("exists").limit(0)
    assert orphans.orphan_references(empty, known).count() == 0
    assert orphans.orphan_references(refs.drop("exists"), known.limit(0)).where("ref_state='absent'").count() == 7


def history_by_force(rows, attrs):
    per = defaultdict(dict)
    for e, t, *vs in rows:
        if e is None or t is None:
            continue
        old = per[e].get(t)
        vals = [min((x for x in (a, b) if x is not None), default=None) for a, b in zip(vs, old or vs)]
        per[e][t] = vals
    out = set()
    for e, at in per.items():
        times, last, runs = sorted(at), None, []
        for t in times:
            if last is None or at[t] != last:
                runs.append((t, at[t]))
                last = at[t]
        for i, (t, v) in enumerate(runs):
            out.add((e, *v, t, runs[i + 1][0] if i + 1 < len(runs) else None))
    return out


def test_history_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", "hot", "hot", "hot", None]), rnd.choice([None, *range(0, 40_000_000, 400_000)]), rnd.choice(["x", "y", None]), rnd.choice(["1", "2"])) for _ in range(900)]
    df = spark.createDataFrame(rows, "e string, s long, p string, q string").withColumn("at", F.timestamp_seconds("s")).withColumns({"seen_at": F.lit(0), "v0": F.lit(1), "b": F.lit(2)})
    h = ah.entity_history(df, "e", "at", ["p", "q"])
    got = {(r["entity_id"], r["p"], r["q"], r["f"], r["t"]) for r in h.select("entity_id", "p", "q", F.unix_seconds("valid_from").alias("f"), F.unix_seconds("valid_to").alias("t")).collect()}
    assert got == history_by_force(rows, 2)


def test_history_text_instants(spark):
    rows = [("n", "2024-01-01T00:00:00Z", "a"), ("n", "2024-01-01T09:00:00+09:00", "a"), ("n", "2024-01-02T00:00:00", "zzz"), ("n", "2024-03-01T00:00:00+00:00", "b"), ("n", "2024-02-01T00:00:00+05:30", "a"), ("n", "2024-04-01T00:00:00Z", "a")]
    h = ah.entity_history(spark.createDataFrame(rows, "id string, committed_at string, path string"), "id", "committed_at", ["path"])
    assert [r["path"] for r in h.orderBy("valid_from").collect()] == ["a", "b", "a"]
    assert ah.entity_history(spark.createDataFrame([], NODES_DDL), "id", "committed_at", ["path"]).count() == 0


def test_key_profile(spark):
    rnd = random.Random(5)
    rows = [("K" + str(rnd.randrange(3)), rnd.choice(["hub"] * 5 + [f"s{i}" for i in range(9)] + [None]), rnd.choice([f"d{i}" for i in range(30)] + [None]), "t") for _ in range(800)] + [(None, "hub", "d1", "t")]
    got = {(r["edge_side"], r["key_id"]): r for r in heavy_keys.key_profile(edge_rows(spark, rows, extra=True), heavy_share=0.1, salts=7).collect()}
    for side, i, j in (("src", 1, 2), ("dst", 2, 1)):
        for key in {r[i] for r in rows} - {None}:
            mine = [r for r in rows if r[i] == key]
            g = got[side, key]
            assert g["n_rows"] == len(mine) and g["n_partners"] == len({r[j] for r in mine} - {None})
            assert dict(g["rows_per_kind"]) == dict(Counter(r[0] or "unknown" for r in mine))
            assert g["salted"] == (len(mine) >= 0.1 * len(rows))
    assert len(got) == len({r[1] for r in rows} - {None}) + len({r[2] for r in rows} - {None})
    assert heavy_keys.key_profile(spark.createDataFrame([], EDGES_DDL)).count() == 0
