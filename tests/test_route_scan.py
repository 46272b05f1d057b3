"""Routes from file names and annotations."""

from pyspark.sql import functions as F

from loamgraph.operators import route_scan as rs
from loamgraph.sources import extract

PATHS = ["src/routes/+page.svelte", "src/routes/+error.svelte", "src/routes/(app)/blog/[slug]/+page.ts", "src/routes/blog/+layout.server.ts", "src/routes/api/users/[id=hex]/+server.ts", "src/routes/blog/page.ts", "src/hooks.server.ts", "src/lib/server/db.ts", "src/lib/a.ts"]


def test_file_routes(spark):
    files = spark.createDataFrame([("r", p) for p in PATHS] + [("other", "src/routes/+page.ts")], "repo string, path string")
    fn = spark.createDataFrame([("r", PATHS[4], "GET", "f#GET"), ("r", PATHS[4], "helper", "f#helper"), ("r", PATHS[2], "load", "f#load")], "repo string, path string, name string, qualified_name string")
    nodes, edges = rs.file_routes(files, fn)
    got = {tuple(r) for r in nodes.collect()}
    assert got == {("r", "Route", "/"), ("r", "Route", "/blog/[slug]"), ("r", "Endpoint", "GET /api/users/[id=hex]"), ("r", "Layout", "layout:/blog"), ("r", "Hook", "hook:src/hooks.server.ts"), ("other", "Route", "/")}
    e = {tuple(r)[1:] for r in edges.where("repo='r'").collect()}
    assert {x for x in e if x[0] == "GUARDS"} == {("GUARDS", "hook:src/hooks.server.ts", d) for d in ("/", "/blog/[slug]", "GET /api/users/[id=hex]")} | {("GUARDS", "layout:/blog", "/blog/[slug]")}
    assert ("HANDLES", "f#GET", "GET /api/users/[id=hex]") in e and ("LOADS", "f#load", "/blog/[slug]") in e and ("REALIZES", PATHS[1], "/") in e
    assert {r["path"] for r in files.where(rs.server_only(F.col("path"))).collect()} == {PATHS[3], PATHS[4], PATHS[6], PATHS[7]}


JAVA = '@RestController\n@RequestMapping("/api/v1")\npublic class C {\n  @GetMapping({"/a", "/b/{id}"})\n  public String get(String x) { return x; }\n  @RequestMapping(value = "c", method = {RequestMethod.PUT, RequestMethod.POST})\n  void put() { }\n  @RequestMapping\n  void any() { }\n  void plain() { }\n}\n'
VIEW = '@Controller\nclass V {\n  @GetMapping("/page")\n  String page() { return "v"; }\n  @GetMapping("/data")\n  @ResponseBody\n  String data() { return "d"; }\n}\n@Service @Repository class S { @GetMapping("/no") void f() {} }\n'


def test_annotated_endpoints(spark):
    f = extract.facts(spark.createDataFrame([("r", "c", "C.java", JAVA), ("r", "c", "V.java", VIEW)], "repo string, source_commit string, path string, content string")).cache()
    classes = extract.annotations(f, "Class").withColumnRenamed("id", "class_id")
    methods = extract.annotations(f, "Method").withColumnRenamed("id", "method_id").withColumn("class_id", F.element_at(F.split("method_id", "#"), 1))
    got = {(r["method_id"], r["qualified_name"]) for r in rs.annotated_endpoints(classes, methods.drop("repo", "source_commit")).collect()}
    assert got == {("C#get(String)", "spring:GET /api/v1/a"), ("C#get(String)", "spring:GET /api/v1/b/{id}"), ("C#put()", "spring:PUT /api/v1/c"), ("C#put()", "spring:POST /api/v1/c"), ("C#any()", "spring:* /api/v1"), ("V#data()", "spring:GET /data")}
    roles = {r["class_id"]: r["role"] for r in classes.select("class_id", rs.role_of(F.transform("marks", lambda m: m["name"])).alias("role")).collect()}
    assert roles == {"C": "controller", "V": "controller", "S": "repository"}


def test_proxied(spark):
    rules = spark.createDataFrame([("/api", "http://a", False), ("/api/v2", "http://b", False), ("/env", None, True), ("/env", "http://c", False)], "prefix string, target string, gap boolean")
    got = {r["path"]: (r["target"], r["matched"]) for r in rs.proxied(spark.createDataFrame([("/api/x",), ("/api/v2/y",), ("/env/z",), ("/apix",)], "path string"), rules).collect()}
    assert got == {"/api/x": ("http://a", "/api/x"), "/api/v2/y": ("http://b", "/api/v2/y"), "/env/z": (None, None), "/apix": (None, "/apix")}
