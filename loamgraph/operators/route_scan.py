"""Routes, endpoints, layouts, hooks and guards: read from file names and annotations by column expressions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.routes import endpoint_path

#: Exported names that answer HTTP verbs; verbs of annotations; roles of stereotypes, strongest first.
HANDLER_NAMES = ["GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD", "fallback"]
VERB_OF = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
ROLES = [("RestController", "controller"), ("Controller", "controller"), ("Repository", "repository"), ("Service", "service"), ("Component", "component")]


def server_only(path: Column) -> Column:
    """True for files that must stay on the server, else null: the mark is never false."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.when(path.contains(".server.") | base.startswith("+server.") | path.startswith("src/lib/server/") | path.contains("/src/lib/server/"), F.lit(True))


def route_url(path: Column) -> Column:
    """URL of a file under src/routes: its folder without `(group)` segments, other segments literal."""
    rel = F.regexp_replace(F.regexp_replace(path, r"^src/routes/?", ""), r"[^/]*$", "")
    kept = F.filter(F.split(rel, "/"), lambda s: (s != "") & ~s.rlike(r"^\([^/]*\)$"))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def file_routes(files: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a file-system router. files: repo, path; functions: repo, path, name, qualified_name. Paths begin at src/.

    nodes: repo, kind, qualified_name. edges: repo, kind, src, dst, kinds REALIZES, HANDLES, LOADS, GUARDS. A server hook guards every endpoint and route of its repository; a
    server layout guards the routes at and below its URL, never an endpoint. Files of layouts are matched by the ancestors of each route, an equi join.
    """
    f = files.select("repo", "path").where(F.col("path").isNotNull()).distinct().withColumn("base", F.element_at(F.split("path", "/"), -1))
    r = f.where(F.col("path").startswith("src/routes/")).withColumn("url", route_url(F.col("path")))
    page = r.where(F.col("base").startswith("+page."))
    shown = r.where(F.col("base").startswith("+page.") | F.col("base").startswith("+error.")).join(page.select("repo", "url").distinct(), ["repo", "url"], "left_semi")
    routes = page.select("repo", F.lit("Route").alias("kind"), F.col("url").alias("qualified_name")).distinct()
    fn = functions.select("repo", "path", F.col("name").alias("fname"), F.col("qualified_name").alias("fqn"))
    served = r.where(F.col("base").startswith("+server.")).join(fn.where(F.col("fname").isin(HANDLER_NAMES)), ["repo", "path"]).withColumn("ep", F.concat_ws(" ", "fname", "url"))
    endpoints = served.select("repo", F.lit("Endpoint").alias("kind"), F.col("ep").alias("qualified_name")).distinct()
    layout = r.where(F.col("base").startswith("+layout.")).withColumn("lq", F.concat(F.lit("layout:"), "url"))
    layouts = layout.select("repo", F.lit("Layout").alias("kind"), F.col("lq").alias("qualified_name")).distinct()
    hook = f.where(F.col("path").rlike(r"^src/(hooks\.(ts|js)|hooks\.(server|client)\.[^/]*)$")).withColumn("hq", F.concat(F.lit("hook:"), "path"))
    hooks = hook.select("repo", F.lit("Hook").alias("kind"), F.col("hq").alias("qualified_name")).distinct()
    edge = lambda df, kind, src, dst: df.select("repo", F.lit(kind).alias("kind"), F.col(src).alias("src"), F.col(dst).alias("dst"))
    loads = page.where(~F.col("base").endswith(".svelte")).join(fn.where(F.col("fname") == "load"), ["repo", "path"])
    guarded = routes.union(endpoints).select("repo", F.col("qualified_name").alias("dst"))
    by_hook = hook.where(F.col("base").startswith("hooks.server.")).join(guarded, "repo")
    up = F.transform(F.sequence(F.lit(0), F.size(F.split("qualified_name", "/"))), lambda i: F.array_join(F.slice(F.split(F.col("qualified_name"), "/"), F.lit(1), i), "/"))
    above = routes.select("repo", F.col("qualified_name").alias("dst"), F.explode(F.array_distinct(F.transform(up, lambda p: F.when(p == "", "/").otherwise(p)))).alias("url"))
    by_layout = layout.where(F.col("base").isin("+layout.server.ts", "+layout.server.js")).join(above, ["repo", "url"])
    nodes = routes.union(endpoints).union(layouts).union(hooks)
    edges = edge(shown, "REALIZES", "path", "url").union(edge(served, "REALIZES", "path", "ep")).union(edge(layout, "REALIZES", "path", "lq")).union(edge(hook, "REALIZES", "path", "hq"))
    edges = edges.union(edge(served, "HANDLES", "fqn", "ep")).union(edge(loads, "LOADS", "fqn", "url")).union(edge(by_hook, "GUARDS", "hq", "dst")).union(edge(by_layout, "GUARDS", "lq", "dst"))
    return nodes, edges.distinct()


def role_of(marks: Column) -> Column:
    """The strongest role among a class's annotation names; null without any."""
    out = F.lit(None).cast("string")
    for name, role in reversed(ROLES):
        out = F.when(F.array_contains(marks, name), F.lit(role)).otherwise(out)
    return out


def annotated_endpoints(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """class_id, method_id, verb, qualified_name of the endpoints that annotated handlers answer, once each.

    classes: class_id, marks; methods: class_id, method_id, marks. A mark is (name, paths array, method text). The class must be a controller, and class or method must
    return a body. Verbs times paths, joined to the class's base path; a mapping without verb answers any (`*`).
    """
    has = lambda c, n: F.exists(c, lambda m: m["name"] == n)
    base = F.coalesce(F.try_element_at(F.flatten(F.transform(F.filter("marks", lambda m: m["name"] == "RequestMapping"), lambda m: m["paths"])), F.lit(1)), F.lit(""))
    c = classes.where(has("marks", "RestController") | has("marks", "Controller"))
    c = c.select("class_id", base.alias("base"), (has("marks", "RestController") | has("marks", "ResponseBody")).alias("body"))
    m = methods.join(c, "class_id").where(F.col("body") | has("marks", "ResponseBody")).select("class_id", "method_id", "base", F.posexplode("marks").alias("at", "m"))
    fixed = F.element_at(F.create_map(*[F.lit(x) for kv in VERB_OF.items() for x in kv]), F.col("m.name"))
    named = F.regexp_extract_all(F.coalesce("m.method", F.lit("")), F.lit(r"RequestMethod\.(\w+)"), 1)
    verbs = F.when(F.col("m.name").isin(*VERB_OF), F.array(fixed)).when(F.col("m.name") == "RequestMapping", F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("*"))))
    paths = F.when(F.size("m.paths") > 0, F.col("m.paths")).otherwise(F.array(F.lit("")))
    x = m.where(F.col("m.name").isin("RequestMapping", *VERB_OF)).select("class_id", "method_id", "base", F.explode(verbs).alias("verb"), paths.alias("ps"))
    x = x.select("class_id", "method_id", "verb", "base", F.explode("ps").alias("p"))
    return x.select("class_id", "method_id", "verb", F.concat(F.lit("spring:"), "verb", F.lit(" "), endpoint_path(F.concat_ws("/", "base", "p"))).alias("qualified_name")).distinct()


def proxied(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path, prefix, target, matched: the longest rule prefix of each path. A rule without a fixed target (`gap`) makes its path unmatchable; among equal prefixes the gap wins.

    Prefixes of a path are tried by an equi join, whole segments at a time.
    """
    cut = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split(F.col("path"), "/"), F.lit(1), i), "/"))
    tried = paths.select("path", F.explode(cut).alias("prefix")).where(F.col("prefix") != "")
    r = rules.groupBy("prefix").agg(F.max("gap").alias("gap"), F.min("target").alias("target"))
    hit = tried.join(r, "prefix").withColumn("rn", F.row_number().over(Window.partitionBy("path").orderBy(F.length("prefix").desc()))).where("rn = 1")
    out = paths.select("path").distinct().join(hit.select("path", "prefix", "gap", "target"), "path", "left")
    return out.select("path", "prefix", F.when(~F.coalesce("gap", F.lit(False)), F.col("target")).alias("target"), F.when(F.coalesce("gap", F.lit(False)), F.lit(None)).otherwise(F.col("path")).alias("matched"))
