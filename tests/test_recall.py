"""Answers with channels, gaps and handles; payload files; the command line; writing loaders."""

import pytest
from pyspark.sql import functions as F

from loamgraph import cli
from loamgraph.operators import loaders, recall, traverse
from loamgraph.schema import EDGES_DDL, NODES_DDL
from loamgraph.sources import tables
from loamgraph.sources.capture import _shaped
from loamgraph.sources.payload_files import Divergent, write_payload
from loamgraph.sources.store import Store

AT = "2025-01-01T00:00:00Z"


@pytest.fixture(scope="module")
def graph(spark):
    names = [("Class", "ctl", None), ("Method", "ctl#a()", None), ("Method", "ctl#t()", True), ("Class", "svc", None), ("Method", "svc#b()", None), ("File", "F.java", None)]
    nodes = spark.createDataFrame([(k, i, i, t, "F.java", "c1", AT) for k, i, t in names], "kind string, id string, qualified_name string, is_test boolean, path string, source_commit string, committed_at string")
    links = [("CONTAINS", "ctl", "ctl#a()"), ("CONTAINS", "ctl", "ctl#t()"), ("CONTAINS", "svc", "svc#b()"), ("CONTAINS", "F.java", "ctl"), ("CALLS", "ctl#a()", "svc#b()"), ("CALLS", "ctl#t()", "ctl#a()"), ("DEPENDS_ON", "ctl", "svc"), ("MODIFIES", "c1", "F.java"),
             ("SUMMARIZES", "summary:1", "ctl"), ("SUMMARIZES", "summary:1", "svc"), ("RISKS", "risk:1", "ctl"), ("DECIDES", "decision:1", "ctl"), ("DECIDES", "decision:2", "svc"), ("SUPERSEDES", "decision:2", "decision:1"), ("MEMBER_OF", "ctl", "community:x"), ("RELATES_TO", "ctl", "svc")]
    edges = spark.createDataFrame([(k, a, b, "deterministic", "2024-01-01T00:00:00Z", AT) for k, a, b in links], "kind string, src string, dst string, edge_kind string, code_bound_at string, created_at string")
    return _shaped(nodes, NODES_DDL), _shaped(edges, EDGES_DDL)


def test_recall(graph):
    g = recall.Graph(*graph)
    a = g.recall("ctl", 1, 3)
    assert [i["id"] for i in a.items] == ["ctl", "F.java", "ctl#a()"] and a.handle and all("author" not in i for i in a.items)
    more = g.expand(a.handle, 10)
    assert [i["id"] for i in more.items] == ["ctl#t()", "svc"]
    assert a.summaries[0]["stale"] and [r["id"] for r in a.summaries[0]["refs"]] == ["ctl", "svc"]
    assert a.risks[0]["id"] == "risk:1" and a.relations == [{"src": "ctl", "kind": "RELATES_TO", "dst": "svc"}]
    assert {d["id"]: d["live"] for d in a.decisions} == {"decision:1": False}
    assert g.recall("nobody").gaps and g.recall("ctl", relations=["IMPORTS", "RISKS"]).gaps == ["'ctl' has no IMPORTS relation"]
    assert [i["id"] for i in g.community("community:x").items] == ["ctl"] and g.community("community:y").gaps
    assert [i["id"] for i in g.risk("risk:1").items] == ["ctl"] and {i["relation"] for i in g.decision("decision:2").items} == {"DECIDES", "SUPERSEDES"}
    assert "more can be expanded" in recall.text_of(a)
    assert len(g.recall("ctl", limit=0).items) == 1


def test_change_set(graph):
    now, edges = graph
    ids = lambda **k: sorted(r["id"] for r in traverse.change_set(now, edges, **k).collect())
    assert ids(files=["F.java"]) == ids(commit="c1") == ["ctl#a()", "ctl#t()"] and ids(methods=["svc#b()", "ctl"]) == ["svc#b()"] and ids() == []


def test_writing_loaders(spark, graph):
    now, _ = graph
    known = now.select("id")
    risks = spark.createDataFrame([(" big ", ["svc", "ctl"], "g", "m", "c", AT, 0.5), ("none", [], "g", "m", "c", AT, 0.5), ("gone", ["ctl", "zz"], "g", "m", "c", AT, 0.5), ("mute", ["ctl"], " ", "m", "c", AT, 0.5)], cli.RISKS)
    assert {(r["title"], r["reject_reason"]) for r in loaders.judged_risks(risks, known).collect()} == {("big", None), ("none", "no flags"), ("gone", "unknown flag"), ("mute", "no generator")}
    rows = loaders.risk_rows(risks, known, now).collect()
    assert {r["dst"] for r in rows} == {"ctl", "svc"} and len({r["src"] for r in rows}) == 1 and all(r["code_bound_at"] == AT for r in rows)
    d = [("d1", ["zz"], None), ("d2", ["ctl"], ["d1"]), ("d3", ["ctl"], ["d2"]), ("d4", ["svc"], None), ("d5", ["svc"], ["d4"])]
    decisions = spark.createDataFrame([(i, "t", a, s, None, "g", "m", "c", f"2025-01-0{k + 1}T00:00:00Z", 0.5) for k, (i, a, s) in enumerate(d)], cli.DECISIONS)
    judged = {r["decision_id"]: r["reject_reason"] for r in loaders.judged_decisions(decisions, known).collect()}
    assert [i for i, why in judged.items() if why is None] and {i for i, why in judged.items() if why is None} == {"d4", "d5"}
    assert {(r["kind"], r["dst"]) for r in loaders.decision_rows(decisions, known, now).collect()} == {("DECIDES", "svc"), ("SUPERSEDES", "d4")}
    refs = spark.createDataFrame([("community:x", "ctl"), ("community:x", "ctl#a()"), ("community:x", "svc#b()")], "community_id string, id string")
    inside = loaders.in_community(refs, graph[1].where("kind = 'MEMBER_OF'"), graph[1].where("kind = 'CONTAINS'"))
    assert {r["id"] for r in inside.collect()} == {"ctl", "ctl#a()"}


def test_command_line(spark, graph, tmp_path, capsys):
    store = Store(spark, str(tmp_path))
    ask = lambda *a: cli.run(cli.parser().parse_args(["--store", str(tmp_path), *a]), spark)
    assert ask("churn") == 2
    store.upsert("nodes", graph[0]), store.upsert("edges", graph[1])
    assert ask("query", "ctl") == 0 and "Class svc" in capsys.readouterr().out
    assert ask("query", "nobody") == 2 and ask("churn") == 0 and ask("test-impact", "svc#b()") == 0
    assert "ctl#t()\t2" in capsys.readouterr().out
    assert ask("changeset-impact", "--method", "ctl#a()") == 0 and "ctl#t()" in capsys.readouterr().out
    write_payload(str(tmp_path / "in" / "r.json"), [{"title": "x", "flags": ["ctl"], "generator": "g", "model": "m", "source_commit": "c", "created_at": AT}])
    assert ask("load-risks", str(tmp_path / "in")) == 0
    assert store.read("edges").where("kind = 'RISKS'").count() == 2


def test_payload_files(tmp_path):
    p = str(tmp_path / "x" / "a.json")
    assert write_payload(p, [{"a": 1}]) and not write_payload(p, [{"a": 1}])
    with pytest.raises(Divergent):
        write_payload(p, [{"a": 2}])


def test_scratch_is_released_and_must_be_shared(spark, monkeypatch):
    s = tables.Scratch(spark)
    kept = s.keep(spark.range(3))
    fs, p = s._fs_path(kept._loam_path)
    assert fs.exists(p)
    tables.release(spark)
    assert not fs.exists(p)

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "spark://far:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(RuntimeError):
        tables.shared_root(Far)
