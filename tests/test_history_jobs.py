"""Backfill and capture of small repositories, call typing, requests in sources, configuration files."""

import subprocess

import pytest
from pyspark.sql import functions as F

from loamgraph.sources import capture, config, extract
from loamgraph.sources.store import Store


def git(folder, *args):
    subprocess.run(["git", "-C", str(folder), "-c", "user.name=n", "-c", "user.email=n@x", *args], check=True, capture_output=True)


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture()
def repo(tmp_path):
    r = tmp_path / "app"
    r.mkdir()
    git(r, "init", "-q", "-b", "main")
    (r / "A.java").write_text("package p;\npublic class A { void run() { stop(); } void stop() { } }\n")
    git(r, "add", "."), git(r, "commit", "-qm", "one")
    git(r, "branch", "feature")
    (r / "B.java").write_text("package p;\nclass B extends A { void more() { run(); } }\n")
    git(r, "add", "."), git(r, "commit", "-qm", "two")
    return r


def test_backfill_twice_is_once(spark, repo, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    done = capture.backfill(spark, str(repo), store)
    assert done.commits == 2 and done.modifies == 2
    first = [rows_of(store.read("nodes"), "kind", "id", "source_commit"), rows_of(store.read("edges"), "kind", "src", "dst", F.coalesce("resolution", F.lit("")))]
    assert {("CALLS", "p.A#run()", "p.A#stop()", "typed"), ("CALLS", "p.B#more()", "p.A#run()", "typed")} <= set(first[1])
    assert sum(k == "Community" for k, *_ in first[0]) >= 1 and any(e[0] == "MEMBER_OF" for e in first[1])
    capture.backfill(spark, str(repo), store)
    assert first == [rows_of(store.read("nodes"), "kind", "id", "source_commit"), rows_of(store.read("edges"), "kind", "src", "dst", F.coalesce("resolution", F.lit("")))]


def test_capture_of_two_branches(spark, repo, tmp_path):
    store = Store(spark, str(tmp_path / "planes"))
    done = capture.capture(spark, str(repo), ["main", "feature", "main"], store)
    assert done.branches == ("feature", "main") and done.commits == 2
    ids = {r["id"] for r in store.read("nodes").where("kind = 'Class'").collect()}
    assert ids == {"branch:main\x1fp.A", "branch:feature\x1fp.A", "branch:main\x1fp.B"}
    assert rows_of(store.manifest(), "branch", "status", "commit_count") == [("feature", "captured", 1), ("main", "captured", 2)]
    with pytest.raises(ValueError):
        capture.capture(spark, str(repo), ["absent"], store)


def edges_of(spark, files):
    f = extract.facts(spark.createDataFrame([("r", "c", p, t) for p, t in files.items()], "repo string, source_commit string, path string, content string"))
    return f, {(r["src"], r["dst"], r["resolution"]) for r in extract.call_edges(f).collect()}


def test_call_typing(spark):
    base = "package a; public class Top { void go() { } }"
    files = {
        "a/Top.java": base,
        "a/Mid.java": "package a; class Mid extends Top { }",
        "a/Low.java": "package a; class Low extends Mid { void low() { go(); } }",
        "a/Side.java": "package a; class Side extends Top { void side() { } }",
        "x/Svc.java": "package x; public class Svc { public void save() { } }",
        "y/Svc.java": "package y; public class Svc { public void save() { } }",
        "u/Narrow.java": "package u; import x.Svc; class Narrow { private Svc s; void f() { s.save(); } }",
        "u/Wide.java": "package u; class Wide { private Svc s; void f() { s.save(); } }",
        "u/Known.java": "package u; class Known { private Mid m; private java.util.List l; void f() { m.side(); m.go(); } void h(Other o) { o.go(); } void i() { Nowhere.go(); } }",
    }
    _, got = edges_of(spark, files)
    assert ("a.Low#low()", "a.Top#go()", "typed") in got  # two levels up
    assert ("u.Narrow#f()", "x.Svc#save()", "typed") in got and not any(s == "u.Narrow#f()" and d.startswith("y.") for s, d, _ in got)
    assert {("u.Wide#f()", "x.Svc#save()", "name"), ("u.Wide#f()", "y.Svc#save()", "name")} <= got
    assert ("u.Known#f()", "a.Top#go()", "typed") in got and not any(d == "a.Side#side()" for _, d, _ in got)  # no siblings
    assert not any(s == "u.Known#h(Other)" for s, _, _ in got)  # a declared type from elsewhere
    assert ("u.Known#i()", "a.Top#go()", "name") in got  # no class of that name: by name


def test_requests_and_configuration(spark):
    files = {
        "web/a.ts": "import axios from 'axios'; import { get } from './wrapper';\nfunction load() { fetch('/api/users'); axios.post('/api/orders', {}); get('/not/one'); fetch(url); fetch('/api/x', { method: 'PUT' }); }",
        "web/P.svelte": "<h1>it's</h1>\n<script lang=\"ts\">\nfunction shown() { fetch('/api/shown'); }\n</script>\n",
        "s/C.java": 'package s; class C { @Value("${portal.url:http://d}") private String base; private RestTemplate rest; private WebClient web; void f() { rest.getForObject("/j/a", String.class); web.post().uri("/j/b").retrieve(); rest.getForObject(base + "/j/c", String.class); } void help(String p) { rest.getForObject(p, String.class); } void g() { help("/j/d"); } }',
    }
    f, _ = edges_of(spark, files)
    refs = f.where("fact = 'config'").select("repo", F.col("b").alias("field"), F.col("c").alias("text"))
    assert rows_of(refs, "field", "text") == [("base", "${portal.url:http://d}")]
    yml = spark.createDataFrame([("r", "src/main/resources/application.yml", "portal:\n  url: http://one\n"), ("r", "application-dev.yaml", "portal.url: ${ENV}\n"), ("r", "application-bad.yml", ": ["), ("r", "vite.config.ts", "export default { server: { proxy: { '/api': 'http://h:1', '/env': process.env.X, '/alt': { target: env.A || 'http://h:2' }, '/re': { target: 'http://h:3', rewrite: (p) => p } } } }")], "repo string, path string, content string")
    values = config.properties(yml, spark.createDataFrame([("r", "portal.url")], "repo string, key string"))
    hosts = config.grounded(refs, values)
    assert rows_of(hosts, "field", "host") == [("base", "http://one")]
    got = {(r["qualified_name"], r["derived"], r["host"]) for r in extract.api_calls(f, hosts).collect()}
    assert got == {("apicall:GET /api/users", False, None), ("apicall:POST /api/orders", False, None), ("apicall:PUT /api/x", False, None), ("apicall:GET /api/shown", False, None), ("apicall:GET /j/a", False, None), ("apicall:POST /j/b", False, None), ("apicall:GET /j/c", True, "http://one"), ("apicall:GET /j/d", True, None)}
    assert rows_of(config.proxy_rules(yml), "prefix", "gap") == [("/alt", False), ("/api", False), ("/env", True), ("/re", True)]
    two = spark.createDataFrame([("r", "portal.url", None, "http://one"), ("r", "portal.url", "x", "http://two")], "repo string, key string, profile string, value string")
    assert rows_of(config.grounded(refs, two), "field", "host") == [("base", None)] and rows_of(config.grounded(refs, two.limit(0)), "host") == [("http://d",)]
    assert config.value_ref("#{x}") is None and config.value_ref("${a.b}") == ("a.b", None)
