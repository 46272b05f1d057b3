"""Registered queries over the code graph, with the SQL that must give the same rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions import routes
from loamgraph.functions.identity import bare_name, plane_of, scoped_id
from loamgraph.operators import answers, components, graph, hierarchy, loaders, route_scan, traverse
from loamgraph.schema import RELATION_TYPES
from loamgraph.sources import extract
from loamgraph.sources.tables import Scratch, spread, table
from loamgraph.streaming import fold

# ------------------------------------------------------------------ shared parts

_NODES = """alln as (select kind, id, qualified_name, name, branch, path, start_line, end_line, is_test, source_commit, committed_at, code_bound_at, ingested_at from nodes
 union all select kind, id, qualified_name, name, branch, path, start_line, end_line, is_test, source_commit, committed_at, code_bound_at, ingested_at from platform_nodes),
now as (select * from (select *, row_number() over (partition by kind, id order by try_cast(committed_at as timestamptz) desc nulls last, ingested_at desc nulls last,
 source_commit desc nulls last, path desc nulls last, start_line desc nulls last, end_line desc nulls last, committed_at desc nulls last) rn from alln where kind is not null and id is not null) where rn = 1)"""
_EDGES = """en as (select * from (select *, row_number() over (partition by kind, src, dst order by coalesce(try_cast(created_at as timestamptz), try_cast(committed_at as timestamptz)) desc nulls last,
 ingested_at desc nulls last, source_commit desc nulls last, resolution desc nulls last, confidence desc nulls last, code_bound_at desc nulls last) rn from edges where kind is not null and src is not null and dst is not null) where rn = 1)"""
_MOD = "m as (select distinct src, dst from edges where kind='MODIFIES' and src is not null and dst is not null)"
_PLANE = "case when {0} like 'branch:%' and strpos({0}, chr(31)) > 0 then substr({0}, 8, strpos({0}, chr(31)) - 8) end"
#: Seeds of walks: every method. What is bounded is the answer to each seed.
_SEEDS = "seeds as (select distinct id seed from now where kind='Method')"


def _now(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes_now(table(spark, d, "nodes").unionByName(table(spark, d, "platform_nodes")))


def _edges(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    return graph.edges_now(table(spark, d, "edges"), list(kinds) or None)


def _modifies(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").where(F.col("kind") == "MODIFIES")
    return e.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()


def _methods(now: DataFrame) -> DataFrame:
    return now.where(F.col("kind") == "Method").select(F.col("id").alias("seed")).distinct()


QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ change history


@query(f"with {_MOD} select dst as file_id, count(*) as churn from m group by dst order by churn desc, file_id limit 25")
def churn_topk(spark: SparkSession, d: str) -> DataFrame:
    return answers.churn(_modifies(spark, d)).orderBy(F.desc("churn"), "file_id").limit(25)


_COCHANGE = f"""with {_MOD}, s as (select distinct dst seed from m),
b as (select s.seed, a.src c, x.dst f, row_number() over (partition by s.seed, a.src order by x.dst) rn from s join m a on a.dst=s.seed join m x on x.src=a.src
 where x.dst<>s.seed and ({_PLANE.format('x.dst')}) is not distinct from ({_PLANE.format('s.seed')})),
g as (select seed, f, count(*) n from b where rn<=512 group by all)"""


@query(_COCHANGE + " select seed, f as file_id, n as n_commits from (select *, row_number() over (partition by seed order by n desc, f) k from g) where k <= 25")
def cochange_topk(spark: SparkSession, d: str) -> DataFrame:
    m = Scratch(spark).keep(_modifies(spark, d))
    seeds = m.select(F.col("dst").alias("seed")).distinct()
    return _top(answers.cochange(seeds, m), "seed", [F.desc("n_commits"), F.asc("file_id")], 25)


def _top(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


@query(f"""with {_NODES}, {_MOD}, f as (select distinct id from now where kind='File') select m.src, m.dst from m join f on f.id=m.dst""")
def modifies_asof(spark: SparkSession, d: str) -> DataFrame:
    return graph.admit_modifies(_modifies(spark, d), _now(spark, d)).select("src", "dst")


# ------------------------------------------------------------------ the present graph


@query(f"with {_NODES} select kind, id, path, cast(coalesce(start_line, -1) as bigint) as start_line, is_test, source_commit, committed_at from now")
def upsert_last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    line = F.coalesce("start_line", F.lit(-1)).cast("long").alias("start_line")
    return _now(spark, d).select("kind", "id", "path", line, "is_test", "source_commit", "committed_at")


@query(f"with {_EDGES} select kind, src, dst, resolution, source_commit from en")
def edges_last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("kind", "src", "dst", "resolution", "source_commit")


@query(f"with {_NODES} select kind, id from now where branch is distinct from 'main'")
def plane_wipe(spark: SparkSession, d: str) -> DataFrame:
    return graph.wipe_plane(_now(spark, d), _edges(spark, d), "main")[0].select("kind", "id")


@query(f"with {_EDGES} select kind, src, dst from en where coalesce({_PLANE.format('src')}, 'main')='main' and coalesce({_PLANE.format('dst')}, 'main')='main'")
def plane_reap_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.reap_planes(_now(spark, d), _edges(spark, d), ["main"])[1].select("kind", "src", "dst")


@query(f"with {_NODES}, {_EDGES}, i as (select distinct id from now) select kind, src, dst from en where src in (select id from i) and dst in (select id from i)")
def admitted_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.admitted(_edges(spark, d), _now(spark, d)).select("kind", "src", "dst")


@query("""select kind, edge_kind, count(*) as n from (select kind, edge_kind from edges union all select kind, 'runtime' from edges where kind in ('DECIDES', 'COVERS')) where edge_kind is distinct from case when kind in ('SUMMARIZES','RISKS','DECIDES','SUPERSEDES','ADDRESSES_RISK','CAUSALLY_RELATES','RELATES_TO','CONFLICTS_WITH','CALLS_API') then 'inferred' when kind='COVERS' then 'runtime' else 'deterministic' end group by all""")
def edge_layer_violations(spark: SparkSession, d: str) -> DataFrame:
    """The tables hold no row of a wrong layer; decisions and coverage under the layer `runtime` are added, of which coverage is right."""
    e = table(spark, d, "edges").select("kind", "edge_kind")
    planted = e.where(F.col("kind").isin("DECIDES", "COVERS")).withColumn("edge_kind", F.lit("runtime"))
    return graph.wrong_layer(e.union(planted)).groupBy("kind", "edge_kind").agg(F.count(F.lit(1)).alias("n"))


@query("select distinct id, case when branch is null then qualified_name else 'branch:' || branch || chr(31) || qualified_name end as scoped, case when strpos(id, chr(31)) > 0 then substr(id, strpos(id, chr(31)) + 1) else id end as bare from nodes")
def scoped_ids(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes")
    return n.select("id", scoped_id(F.col("branch"), F.col("qualified_name")).alias("scoped"), bare_name(F.col("id")).alias("bare")).distinct()


# ------------------------------------------------------------------ walks

_VIEW = """v0 as (select src a, dst b, kind r from en where kind in ('CALLS','DEPENDS_ON','CONTAINS','IMPORTS') and src<>dst), v1 as (select * from v0 union select b, a, r from v0),
ids as (select distinct id from now), v as (select a, b, min(r) r from v1 join ids on ids.id=v1.b group by all)"""


def _hop(i: int, seen: str, out: str, limit: int = 25) -> str:
    return f"""c{i} as (select s.seed, v.b id, min(v.r) relation from {seen} s join v on v.a=s.id where s.depth={i - 1} and not exists (select 1 from {seen} q where q.seed=s.seed and q.id=v.b) group by all),
{out} as (select * from {seen} union all select seed, id, relation, {i} from (select c.*, row_number() over (partition by c.seed order by id) rn, {limit} - (select count(*) from {seen} q where q.seed=c.seed) room from c{i} c) where rn <= room)"""


_S0 = "s0 as (select seed, seed id, cast(null as varchar) relation, 0 depth from seeds)"


@query(f"with {_NODES}, {_EDGES}, {_SEEDS}, {_VIEW}, {_S0}, {_hop(1, 's0', 's1')} select seed, id, relation, depth from s1")
def neighborhood_d1(spark: SparkSession, d: str) -> DataFrame:
    now = _now(spark, d)
    return traverse.neighbourhood(_methods(now), _edges(spark, d, *traverse.WALKED), now, 1, 25)


@query(f"with {_NODES}, {_EDGES}, {_SEEDS}, {_VIEW}, {_S0}, {_hop(1, 's0', 's1')}, {_hop(2, 's1', 's2')} select seed, id, relation, depth from s2")
def neighborhood_d2(spark: SparkSession, d: str) -> DataFrame:
    now = _now(spark, d)
    return traverse.neighbourhood(_methods(now), _edges(spark, d, *traverse.WALKED), now, 2, 25)


@query(f"with {_NODES}, {_EDGES}, {_SEEDS}, {_VIEW}, {_S0}, {_hop(1, 's0', 's1')}, {_hop(2, 's1', 's2', 50)} select seed, id, relation, depth from s2 where depth=2")
def expand_next_hop(spark: SparkSession, d: str) -> DataFrame:
    """A walk reads the keys of nodes and edges only, so the newest row of each key need not be found."""
    ids = table(spark, d, "nodes").select("kind", "id").union(table(spark, d, "platform_nodes").select("kind", "id")).dropna()
    links = table(spark, d, "edges").select("kind", "src", "dst")
    return traverse.neighbourhood(_methods(ids), links, ids, 2, [25, 50], since=2)


_IMPACT = """st as (select a, b from (select dst a, src b, row_number() over (partition by dst order by src) rn from (select distinct src, dst from en where kind='CALLS' and src<>dst)) where rn<=512),
w(seed, id, depth) as (select seed, id, 0 from {seeds} union select w.seed, st.b, w.depth+1 from w join st on st.a=w.id where w.depth<10),
g as (select seed, id, min(depth) depth from w group by all) select seed, id, depth from g where depth>0 and id in (select id from now where is_test and kind in ('Method','Function'))"""


@query(f"with recursive {_NODES}, {_EDGES}, called as (select distinct id seed, id from now where kind='Method'), {_IMPACT.format(seeds='called')}")
def test_impact(spark: SparkSession, d: str) -> DataFrame:
    now, e = _now(spark, d), _edges(spark, d, "CALLS")
    return traverse.test_impact(_methods(now).withColumn("id", F.col("seed")), e, now)


_CHANGESET = f"""{_NODES}, {_EDGES}, {_MOD}, fs as (select m.src seed, m.dst id from m),
dn(file, id) as (select distinct id, id from fs union select dn.file, e.dst from dn join en e on e.kind='CONTAINS' and e.src=dn.id),
dm as (select distinct file, id from dn where id<>file and id in (select id from now where kind='Method')),
ms as (select distinct fs.seed, dm.id from fs join dm on dm.file=fs.id except select seed, id from fs)"""


@query(f"with recursive {_CHANGESET} select seed, id from ms")
def changeset_methods(spark: SparkSession, d: str) -> DataFrame:
    return _changed(spark, d)[0]


def _changed(spark: SparkSession, d: str):
    now, e, m = _now(spark, d), _edges(spark, d, "CONTAINS", "CALLS"), _modifies(spark, d)
    files = m.select(F.col("src").alias("seed"), F.col("dst").alias("id"))
    s = Scratch(spark)
    e = s.keep(e)
    return traverse.changed_methods(files, e, now, s), e, now, s


@query(f"with recursive {_CHANGESET}, {_IMPACT.format(seeds='ms')}")
def changeset_impact_commit(spark: SparkSession, d: str) -> DataFrame:
    methods, e, now, s = _changed(spark, d)
    return traverse.test_impact(methods, e, now, scratch=s)


_BY_FILE = f"""{_NODES}, {_EDGES}, fs as (select distinct id seed, id from now where kind='File'),
dn(seed, id) as (select seed, id from fs union select dn.seed, e.dst from dn join en e on e.kind='CONTAINS' and e.src=dn.id),
ms as (select distinct seed, id from dn where id<>seed and id in (select id from now where kind='Method'))"""


@query(f"with recursive {_BY_FILE}, {_IMPACT.format(seeds='ms')}")
def changeset_impact_files(spark: SparkSession, d: str) -> DataFrame:
    """Every file as a change set of its own."""
    s = Scratch(spark)
    now, e = s.keep(_now(spark, d)), s.keep(_edges(spark, d, "CONTAINS", "CALLS"))
    files = now.where(F.col("kind") == "File").select(F.col("id").alias("seed"), "id").distinct()
    return traverse.test_impact(traverse.changed_methods(files, e, now, s), e, now, scratch=s)


@query(f"with {_NODES}, {_EDGES}, mm as (select distinct id from now where kind='Method') select distinct dst as method_id, src as test_id from en where kind='COVERS' and src in (select id from mm) and dst in (select id from mm)")
def runtime_test_impact(spark: SparkSession, d: str) -> DataFrame:
    return answers.runtime_impact(_edges(spark, d, "COVERS"), _now(spark, d))


# ------------------------------------------------------------------ containment and locality

_LOOPS = """sd as (select src a from en where kind='CONTAINS' intersect select dst from en where kind='CONTAINS'),
l as (select distinct src a, dst b from en where kind='CONTAINS'), core as (select l.* from l where a in (select a from sd) and b in (select a from sd)),
r(x, y) as (select a, b from core union select r.x, c.b from r join core c on c.a=r.y),
mu as (select r.x, min(least(r.x, r.y)) g from r join r q on q.x=r.y and q.y=r.x group by r.x),
ac as (select l.* from l left join mu p on p.x=l.a left join mu q on q.x=l.b where p.g is null or q.g is null or p.g<>q.g),
pa(anc, node, len) as (select a, b, 1 from ac union all select pa.anc, ac.b, pa.len+1 from pa join ac on ac.a=pa.node),
cont as (select anc, node, count(*) n_paths, min(len) min_depth from pa group by all)"""


@query(f"with recursive {_EDGES}, {_LOOPS} select anc as ancestor_id, node as node_id, n_paths, cast(min_depth as integer) as min_depth from cont")
def containment_closure(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.containers_by_depth(table(spark, d, "edges"))


_PKG = f"{_LOOPS}, pk as (select node, anc p, n_paths n from cont where anc in (select id from now where kind='Package'))"


@query(f"with recursive {_NODES}, {_EDGES}, {_PKG} select node as node_id, p as package_id, cast(n as bigint) as n_paths from pk")
def package_of(spark: SparkSession, d: str) -> DataFrame:
    return answers.package_of(hierarchy.containers_by_depth(table(spark, d, "edges")), _now(spark, d))


_LOCAL = f"""{_NODES}, {_EDGES}, {_PKG}, cl as (select id, min(path) path from now where kind='Method' and path like '%.java' group by id), ids as (select distinct id from now),
j as (select c.src, cl.path, c.dst, c.resolution res, a.p, b.p q, coalesce(a.n,1)*coalesce(b.n,1) n from en c join cl on cl.id=c.src join ids on ids.id=c.dst left join pk a on a.node=c.src left join pk b on b.node=c.dst where c.kind='CALLS'),
loc as (select src, path, cast(coalesce(sum(n) filter (res='typed' and p is not null and q is not null and p<>q),0) as bigint) cross_calls,
 cast(coalesce(sum(n) filter (res='typed' and p is not null and q is not null and p=q),0) as bigint) same_calls,
 cast(coalesce(sum(n) filter (res='typed' and (p is null or q is null)),0) as bigint) unresolved_calls, cast(coalesce(sum(n) filter (res='name'),0) as bigint) name_calls,
 coalesce(array_to_string(list_sort(list(distinct dst) filter (res='typed' and p is not null and q is not null and p<>q)), '|'), '') cross_ids from j group by all),
lr as (select *, case when cross_calls+same_calls>0 then round(cross_calls/(cross_calls+same_calls), 6) else 0.0 end cross_ratio from loc)"""


def _locality(spark: SparkSession, d: str) -> DataFrame:
    now = _now(spark, d)
    packages = answers.package_of(hierarchy.containers_by_depth(table(spark, d, "edges")), now)
    return answers.call_locality(_edges(spark, d, "CALLS"), now, packages)


@query(f"with recursive {_LOCAL} select * from lr")
def call_locality(spark: SparkSession, d: str) -> DataFrame:
    return _locality(spark, d)


@query(f"with recursive {_LOCAL} select *, cast(cross_calls as varchar) || ' typed call(s) into other packages, ' || cast(name_calls as varchar) || ' by name only' as facts from lr where cross_calls>0 and name_calls>0")
def refactor_candidates(spark: SparkSession, d: str) -> DataFrame:
    return answers.refactor_candidates(_locality(spark, d))


@query(f"""with {_NODES}, {_EDGES}, n as (select distinct id, path from now where path like '%.java') select src, en.kind, dst, n.path as src_path from en join n on n.id=en.src
 where en.kind in ('CALLS','DEPENDS_ON') and resolution='name' and dst in (select id from now)""")
def edge_precision(spark: SparkSession, d: str) -> DataFrame:
    return answers.edge_precision(_edges(spark, d, "CALLS", "DEPENDS_ON"), _now(spark, d))


# ------------------------------------------------------------------ communities

_UNITS = f"""{_NODES}, {_EDGES}, u as (select distinct e.dst m, e.src u from en e join now a on a.id=e.src join now b on b.id=e.dst where e.kind='CONTAINS' and ((a.kind='Class' and b.kind='Method') or (a.kind='File' and b.kind='Function'))),
pr as (select distinct least(x.u, y.u) a, greatest(x.u, y.u) b from en c join u x on x.m=c.src join u y on y.m=c.dst where c.kind='CALLS' and x.u<>y.u)"""


@query(f"with {_UNITS} select a, b from pr")
def lifted_call_pairs(spark: SparkSession, d: str) -> DataFrame:
    return components.lifted_pairs(_now(spark, d), _edges(spark, d, "CONTAINS", "CALLS"))


_COMM = f"""{_UNITS}, nd as (select distinct u id from u union select id from now where kind='Class'), bp as (select a, b from pr union select b, a from pr),
cc(id, label) using key (id) as (select id, id from nd union (select bp.b, min(cc.label) from cc join bp on bp.a=cc.id join recurring.cc old on old.id=bp.b where cc.label<old.label group by bp.b)),
cm as (select id, label, 'community:' || sha256(cast(count(*) over (partition by label) as varchar) || ':' || cast(sum(cast('0x' || substr(sha256(id), 1, 15) as bigint)) over (partition by label) as varchar)) cid, count(*) over (partition by label) n from cc)"""


@query(f"with recursive {_COMM} select id as member, label, cid as community_id, n as n_members from cm")
def community_assign(spark: SparkSession, d: str) -> DataFrame:
    return components.communities(_now(spark, d), _edges(spark, d, "CONTAINS", "CALLS"))


@query(f"with recursive {_COMM} select cid as community_id, count(*) as n, min(id) as first_member from cm group by 1")
def community_members(spark: SparkSession, d: str) -> DataFrame:
    c = components.communities(_now(spark, d), _edges(spark, d, "CONTAINS", "CALLS"))
    return c.groupBy("community_id").agg(F.count(F.lit(1)).alias("n"), F.min("member").alias("first_member"))


# ------------------------------------------------------------------ summaries, decisions, relations

_SEM = f"""s as (select summary_id, min(target_id) target_id, min(embedding) v from summaries where summary_id is not null and len(embedding)=64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x)))=0 group by 1),
u as (select summary_id, target_id, list_transform(v, lambda x: cast(x as double)) v from s where len(list_filter(v, lambda x: x<>0))>0),
q as (select summary_id query_id, v qv from u where cast('0x' || substr(md5(summary_id), 1, 8) as bigint) % 20 = 0),
sc as (select query_id, summary_id, target_id, (1+greatest(list_cosine_similarity(v, qv), 0))/2 score from q, u),
top as (select * from (select *, row_number() over (partition by query_id order by score desc, summary_id) rn from sc where score>=0.6) where rn<=25)"""


def _semantic(spark: SparkSession, d: str, branches: list[str] | None = None) -> DataFrame:
    """Queries are the summaries whose id hashes to a multiple of 20, as the ids are no numbers; all are searched, in blocks."""
    s = table(spark, d, "summaries")
    asked = F.conv(F.substring(F.md5("summary_id"), 1, 8), 16, 10).cast("long") % 20 == 0
    hits = answers.semantic_many(s, s.where(asked), 25, branches=branches)
    return hits.select("query_id", "summary_id", "target_id", F.round("score", 6).alias("score"))


@query(f"with {_SEM} select query_id, summary_id, target_id, round(score, 6) score from top")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    return _semantic(spark, d)


@query(f"with {_SEM} select query_id, summary_id, target_id, round(score, 6) score from top where ({_PLANE.format('target_id')}) in ('main', 'develop')")
def semantic_topk_branch(spark: SparkSession, d: str) -> DataFrame:
    return _semantic(spark, d, ["main", "develop"])


# a second plane beside the bare one, with other commits for about half of the names, so that peers and divergences exist

_PLANES = f"""{_NODES}, both_planes as (select kind, qualified_name, branch, source_commit, committed_at from now union all
 select kind, qualified_name, 'release', case when substr(md5(qualified_name), 1, 1) < '8' then 'c' || source_commit else source_commit end, committed_at from now where branch is null and qualified_name is not null)"""


def _planes(spark: SparkSession, d: str) -> DataFrame:
    now = _now(spark, d).select("kind", "id", "qualified_name", "branch", "source_commit", "committed_at")
    copy = graph.to_plane(now.where(F.col("branch").isNull() & F.col("qualified_name").isNotNull()), now.select(F.col("id").alias("src"), F.col("id").alias("dst")), "release")[0]
    other = F.when(F.substring(F.md5("qualified_name"), 1, 1) < "8", F.concat(F.lit("c"), "source_commit")).otherwise(F.col("source_commit"))
    return now.unionByName(copy.withColumn("source_commit", other))


@query(
    f"""with {_PLANES}, n as (select kind, qualified_name, branch, source_commit, try_cast(committed_at as timestamptz) t, count(*) over (partition by kind, qualified_name) c from both_planes where qualified_name is not null),
w as (select * from n where c>1) select kind, qualified_name, branch, source_commit, row_number() over (partition by kind, qualified_name order by t desc nulls last, branch nulls first) as rank,
 coalesce(t = max(t) over (partition by kind, qualified_name), false) as freshest, min(source_commit) over (partition by kind, qualified_name) <> max(source_commit) over (partition by kind, qualified_name) as diverged, c as n_planes from w"""
)
def reconcile_peers(spark: SparkSession, d: str) -> DataFrame:
    return answers.peers(_planes(spark, d))


@query(f"with {_PLANES} select kind, qualified_name, count(distinct source_commit) as n_commits from both_planes group by all having count(distinct source_commit) > 1")
def code_divergence(spark: SparkSession, d: str) -> DataFrame:
    g = _planes(spark, d).groupBy("kind", "qualified_name").agg(F.count_distinct("source_commit").alias("n_commits"))
    return g.where(F.col("n_commits") > 1)


_CHANNEL = """l as (select e.src ent, e.dst ref, coalesce(e.code_bound_at <> i.committed_at, false) st from en e join (select id, arg_min(committed_at, kind) committed_at from now group by id) i on i.id=e.dst where e.kind='{k}'),
rr as (select a.ref anchor, a.ent, a.st, b.ref, row_number() over (partition by a.ref order by a.ent, b.ref) rn from l a join l b on b.ent=a.ent)
select anchor, ent as entity_id, bool_or(st) as is_stale, string_agg(ref, '|' order by ref) as refs from rr where rn<=25 group by all"""


@query(f"with {_NODES}, {_EDGES}, " + _CHANNEL.format(k="SUMMARIZES"))
def summary_channel(spark: SparkSession, d: str) -> DataFrame:
    return answers.entity_channel(_edges(spark, d, "SUMMARIZES"), _now(spark, d))


@query(f"with {_NODES}, {_EDGES}, " + _CHANNEL.format(k="DECIDES"))
def decision_refs_channel(spark: SparkSession, d: str) -> DataFrame:
    return answers.entity_channel(_edges(spark, d, "DECIDES"), _now(spark, d))


@query(
    f"""with {_EDGES}, dd as (select decision_id, min(created_at) valid_from from decisions group by 1), s as (select dst decision_id, arg_max(created_at, (ingested_at, try_cast(created_at as timestamptz), created_at)) valid_to from en where kind='SUPERSEDES' group by 1)
select e.src as decision_id, e.dst as target, e.kind as relation, valid_from, valid_to, valid_to is null as live from en e join dd on dd.decision_id=e.src left join s on s.decision_id=e.src where e.kind in ('DECIDES','SUPERSEDES','ADDRESSES_RISK')"""
)
def decision_channel(spark: SparkSession, d: str) -> DataFrame:
    return answers.decision_channel(_edges(spark, d, "DECIDES", "SUPERSEDES", "ADDRESSES_RISK"), table(spark, d, "decisions")).select("decision_id", "target", "relation", "valid_from", "valid_to", "live")


@query("""with x as (select decision_id, min(addresses_risks) rs, min(decides) ds from decisions group by 1), r as (select decision_id, unnest(rs) risk_id, ds from x),
f as (select risk_id, decision_id, unnest(case when len(ds)>0 then ds else [null] end) t from r) select risk_id, count(distinct decision_id) as n_decisions, coalesce(array_to_string(list_sort(list(distinct t) filter (t is not null)), '|'), '') as decided from f group by 1""")
def risk_channel(spark: SparkSession, d: str) -> DataFrame:
    return answers.risk_channel(table(spark, d, "decisions"))


@query("with e as (select distinct src, dst, kind from edges where kind in ('CAUSALLY_RELATES','RELATES_TO','CONFLICTS_WITH') and src is not null and dst is not null) select src as anchor, kind as relation, dst as other, 'out' as direction from e union all select dst, kind, src, 'in' from e where src<>dst")
def relation_channel(spark: SparkSession, d: str) -> DataFrame:
    return answers.relation_channel(_edges(spark, d, *RELATION_TYPES), RELATION_TYPES)


def _known(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").select("id").union(table(spark, d, "platform_nodes").select("id"))


_KNOWN = "known as (select id from nodes union select id from platform_nodes)"
_REFS = "list_concat([target_id], coalesce(flatten(list_transform(claims, lambda c: c.source_refs)), []))"


@query(
    f"""with {_KNOWN}, s as (select distinct on (summary_id) * from summaries where summary_id is not null),
j as (select *, coalesce(trim(generator)='', true) bg, coalesce(trim(model)='', true) bm, coalesce(len(claims), 0) nc, len(list_filter(claims, lambda c: coalesce(len(c.source_refs), 0)=0)) bare from s),
est as (select embedding_model m from j where not bg and not bm and nc>0 and bare=0 and len(embedding)=64 and embedding_model is not null order by try_cast(created_at as timestamptz), summary_id limit 1),
bad as (select distinct summary_id from (select summary_id, unnest({_REFS}) r from s) where r is not null and r not in (select id from known))
select summary_id, target_id, case when bg then 'no generator' when bm then 'no model' when nc=0 then 'no claims' when bare>0 then 'claim without references' when len(embedding)<>64 then 'embedding length'
 when embedding is not null and embedding_model is null then 'embedding without model' when embedding is not null and embedding_model<>(select m from est) then 'another embedding model'
 when summary_id in (select summary_id from bad) then 'unknown reference' end as reject_reason from j"""
)
def load_summaries_report(spark: SparkSession, d: str) -> DataFrame:
    return loaders.judged_summaries(table(spark, d, "summaries"), _known(spark, d))


@query(
    f"""with recursive {_KNOWN}, x as (select distinct on (decision_id) *, try_cast(created_at as timestamptz) t from decisions where decision_id is not null),
bad as (select distinct decision_id from (select decision_id, unnest(decides) r from x) where r is not null and r not in (select id from known)),
sup as (select s.decision_id from (select decision_id, t, unnest(supersedes) o from x) s left join x p on p.decision_id=s.o where p.t is null or p.t>=s.t),
first as (select decision_id, case when coalesce(trim(generator)='', true) then 'no generator' when coalesce(trim(model)='', true) then 'no model' when coalesce(len(decides), 0)=0 then 'decides nothing'
 when decision_id in (select decision_id from bad) then 'unknown target' when decision_id in (select decision_id from sup) then 'supersedes no earlier decision' end as reason from x),
lost(decision_id) as (select decision_id from first where reason is not null union select s.decision_id from (select decision_id, unnest(supersedes) o from x) s join lost on lost.decision_id=s.o)
select decision_id, coalesce(reason, case when decision_id in (select decision_id from lost) then 'supersedes no earlier decision' end) as reject_reason from first"""
)
def load_decisions_report(spark: SparkSession, d: str) -> DataFrame:
    return loaders.judged_decisions(table(spark, d, "decisions"), _known(spark, d))


# the tables name risks only in decisions: each stands for a payload whose flags are what the decision decides, without its first for every second risk

_RISKS = """rk as (select distinct trim(unnest(addresses_risks)) title, generator, model, coalesce(source_commit, '') sc, list_sort(case when contains('02468ace', substr(md5(decision_id), 1, 1)) then [] else coalesce(decides, []) end) flags from decisions where decision_id is not null)"""


def _risks(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "decisions").where(F.col("decision_id").isNotNull())
    none = F.array().cast("array<string>")
    flags = F.when(F.substring(F.md5("decision_id"), 1, 1).isin(*"02468ace"), none).otherwise(F.coalesce("decides", none))
    return x.select(F.explode("addresses_risks").alias("title"), "generator", "model", "source_commit", "created_at", "confidence", flags.alias("flags"))


@query(
    f"""with {_KNOWN}, {_RISKS}, i as (select distinct on (id) *, 'risk:' || sha256(array_to_string(list_concat([title, sc], flags), chr(0))) id from rk where title is not null),
bad as (select distinct id from (select id, unnest(flags) r from i) where r is not null and r not in (select id from known))
select id as risk_id, title, case when coalesce(trim(generator)='', true) then 'no generator' when coalesce(trim(model)='', true) then 'no model' when len(flags)=0 then 'no flags'
 when id in (select id from bad) then 'unknown flag' end as reject_reason from i"""
)
def load_risks_report(spark: SparkSession, d: str) -> DataFrame:
    return loaders.judged_risks(_risks(spark, d), _known(spark, d)).select("risk_id", "title", "reject_reason")


@query(
    f"""with {_KNOWN}, r as (select distinct src, dst, kind, generator from edges where kind in ('RELATES_TO','DEPENDS_ON') and src is not null and dst is not null)
select src, dst, kind, case when coalesce(trim(generator)='', true) then 'no generator' when kind not in ('CAUSALLY_RELATES','RELATES_TO','CONFLICTS_WITH') then 'unknown relation'
 when src not in (select id from known) or dst not in (select id from known) then 'unknown endpoint' end as reject_reason from r"""
)
def load_relations_report(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").where(F.col("kind").isin("RELATES_TO", "DEPENDS_ON") & F.col("src").isNotNull() & F.col("dst").isNotNull())
    return loaders.judged_relations(e, _known(spark, d))


_COVER = f"""{_NODES}, mm as (select qualified_name q, id, is_test, branch is not null p from now where kind='Method'),
nm as (select q, arg_min(id, (p, id)) id, coalesce(bool_or(is_test), false) marked, arg_min(id, (p, id)) filter (is_test) tid from mm group by q),
t as (select r.batch_no, r.covered, nm.tid from coverage_records r left join nm on nm.q=r.test_qualified_name and nm.marked),
x as (select batch_no, tid, unnest(covered) q from t where tid is not null), y as (select x.*, nm.id mid from x left join nm on nm.q=x.q)"""


@query(f"""with {_COVER}, per as (select batch_no, count(*) intended, count(*) filter (tid is null) rejected from t group by 1), pr as (select batch_no, count(mid) loaded, count(*) filter (mid is null and q is not null) skipped from y group by 1)
select batch_no, intended, rejected, coalesce(loaded, 0) as loaded, coalesce(skipped, 0) as skipped from per left join pr using (batch_no)""")
def load_coverage_report(spark: SparkSession, d: str) -> DataFrame:
    return loaders.coverage_load(table(spark, d, "coverage_records"), _now(spark, d))[1]


@query(f"with {_COVER} select distinct tid as test_id, mid as method_id from y where mid is not null")
def load_coverage_edges(spark: SparkSession, d: str) -> DataFrame:
    return loaders.coverage_load(table(spark, d, "coverage_records"), _now(spark, d))[0]


@query("select distinct summary_id, 'summary:' || sha256(coalesce(target_id || chr(0), '') || coalesce(generator || chr(0), '') || coalesce(model || chr(0), '') || source_commit) as content_id from summaries where summary_id is not null and source_commit is not null")
def hash_ids(spark: SparkSession, d: str) -> DataFrame:
    return loaders.summary_ids(table(spark, d, "summaries").where(F.col("summary_id").isNotNull() & F.col("source_commit").isNotNull())).select("summary_id", "content_id").distinct()


@query(
    f"""with {_KNOWN}, s as (select summary_id, arg_min(claims, cast(to_json(claims) as varchar)) claims from summaries group by 1), r as (select summary_id, unnest(flatten(list_transform(claims, lambda c: c.source_refs))) id from s),
g as (select summary_id, count(id) n, count(*) filter (id in (select id from known)) k from r group by 1)
select s.summary_id, coalesce(n, 0) as n_refs, coalesce(round_even(k / n, 3), 0.0) as confidence from s left join g using (summary_id)"""
)
def grounding_confidence(spark: SparkSession, d: str) -> DataFrame:
    return answers.grounding(table(spark, d, "summaries"), _known(spark, d))


# ------------------------------------------------------------------ routes
# The tables hold no routes; parts stand for them: every third one is declared and called, the others are declared or called with a variable.

_VERB = "(array['GET','POST','PUT','*'])[1 + (p_partkey // 3) % 4]"
_ROUTES = f"""rt as (select p_partkey k, {_VERB} verb, '/' || lower(replace(p_type, ' ', '/')) || '/' || p_size lit, '/' || lower(replace(p_type, ' ', '/')) tmpl from part),
ep as (select distinct case when k%2=0 then 'spring:' else '' end || verb || ' ' || case when k%3=0 then lit else tmpl || case when k%2=0 then '/{{id}}' else '/[id]' end end qn from rt where k%3=0 or k%2=0),
ca as (select distinct 'apicall:' || verb || ' ' || case when k%3=0 then lit else tmpl || '/{{}}' end qn from rt where k%3=0 or k%2=1),
cn as (select qn, split_part(replace(replace(qn,'spring:',''),'apicall:',''),' ',1) v, regexp_replace(split_part(replace(replace(qn,'spring:',''),'apicall:',''),' ',2), '/(\\[[^/]*\\]|\\{{[^/]*\\}})', '/{{}}', 'g') r from (select qn from ep union all select qn from ca))"""


def _routes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    verb = F.element_at(F.array(*[F.lit(x) for x in ("GET", "POST", "PUT", "*")]), (F.floor(k / 3) % 4 + 1).cast("int"))
    stem = F.concat(F.lit("/"), F.lower(F.replace("p_type", F.lit(" "), F.lit("/"))))
    literal = F.concat(stem, F.lit("/"), F.col("p_size").cast("string"))
    p = table(spark, d, "part")
    ep = p.where((k % 3 == 0) | (k % 2 == 0)).select(F.concat(F.when(k % 2 == 0, "spring:").otherwise(""), verb, F.lit(" "), F.when(k % 3 == 0, literal).otherwise(F.concat(stem, F.when(k % 2 == 0, "/{id}").otherwise("/[id]")))).alias("qualified_name"))
    ca = p.where((k % 3 == 0) | (k % 2 == 1)).select(routes.api_call_name(verb, F.concat(F.lit("`"), F.when(k % 3 == 0, literal).otherwise(F.concat(stem, F.lit("/${id}"))), F.lit("`"))).alias("qualified_name"))
    full = lambda x: x.distinct().select(F.col("qualified_name").alias("id"), "qualified_name", F.lit(None).cast("string").alias("branch"))
    return full(ca), full(ep)


@query(f"with {_ROUTES} select distinct qn, v as verb, r as route from cn")
def match_key(spark: SparkSession, d: str) -> DataFrame:
    ca, ep = _routes(spark, d)
    qn = F.col("qualified_name")
    return ca.union(ep).select(qn.alias("qn"), routes.match_verb(qn).alias("verb"), routes.match_path(qn).alias("route")).distinct()


_LINKS = f"""{_ROUTES}, lk as (select c.qn call_id, e.qn endpoint_id, c.r matched_route, case when c.v<>'*' then c.v else e.v end verb, c.v='*' or e.v='*' wild from (select distinct * from cn where qn like 'apicall:%') c join (select distinct * from cn where qn not like 'apicall:%') e on c.r=e.r and (c.v=e.v or c.v='*' or e.v='*')),
lc as (select *, count(*) over (partition by call_id) candidate_count from lk), ln as (select call_id, endpoint_id, matched_route, verb, candidate_count,
 cast(least(case when contains(matched_route, '{{') then 0.7 else 1 end, case when wild then 0.4 else 1 end, case when candidate_count>1 then 0.7 else 1 end) as double) confidence from lc)"""


@query(f"with {_LINKS} select * from ln")
def calls_api_links(spark: SparkSession, d: str) -> DataFrame:
    return answers.api_links(*_routes(spark, d))


@query(f"with {_LINKS} select endpoint_id, count(*) as n_calls, min(call_id) as first_call from ln group by 1")
def endpoint_callers(spark: SparkSession, d: str) -> DataFrame:
    return answers.api_links(*_routes(spark, d)).groupBy("endpoint_id").agg(F.count(F.lit(1)).alias("n_calls"), F.min("call_id").alias("first_call"))


@query(f"with {_LINKS} select call_id, count(*) as n_endpoints, min(endpoint_id) as first_endpoint from ln group by 1")
def call_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return answers.api_links(*_routes(spark, d)).groupBy("call_id").agg(F.count(F.lit(1)).alias("n_endpoints"), F.min("endpoint_id").alias("first_endpoint"))


# parts stand for the files of routed applications too: their type gives the folder, their number the file's role

_TREE = """pt as (select p_partkey k, 'r' || (p_size % 10) repo, lower(p_type) x, 'd' || (p_size % 7) y from part),
fl as (select k, repo, 'src/routes/(' || y || ')/' || x || '/' || y || '/' || ['+page.svelte', '+page.server.ts', '+server.ts', '+layout.server.ts', '+layout.svelte', 'store.server.ts', 'util.ts'][1 + k % 7] path, '/' || x || '/' || y url, k % 7 role from pt),
rt as (select distinct repo, url from fl where role in (0, 1)), fn as (select k, repo, path, url, role, case when role = 2 then ['GET', 'POST', 'DELETE'][1 + k % 3] else 'load' end fname, 'fn:' || k qn from fl where role in (1, 2)),
ep as (select distinct repo, fname || ' ' || url q from fn where role = 2), hk as (select distinct repo, 'src/hooks.server.ts' path from fl where repo in ('r1', 'r4', 'r7')),
re as (select distinct * from (select repo, path src, url dst from fl where role in (0, 1) union all select f.repo, f.path, n.fname || ' ' || f.url from fl f join fn n on n.repo=f.repo and n.path=f.path where f.role=2
 union all select repo, path, 'layout:' || url from fl where role in (3, 4) union all select repo, path, 'hook:' || path from hk)),
gd as (select hk.repo, ep.q dst from hk join ep using (repo))"""


def _app(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, at = F.col("p_partkey"), lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    folder = F.concat(F.lit("d"), (F.col("p_size") % 7).cast("string"))
    name = at(["+page.svelte", "+page.server.ts", "+server.ts", "+layout.server.ts", "+layout.svelte", "store.server.ts", "util.ts"])
    path = F.concat(F.lit("src/routes/("), folder, F.lit(")/"), F.lower("p_type"), F.lit("/"), folder, F.lit("/"), name)
    f = table(spark, d, "part").select(k.alias("k"), F.concat(F.lit("r"), (F.col("p_size") % 10).cast("string")).alias("repo"), path.alias("path"), at(["GET", "POST", "DELETE"]).alias("verb"))
    hooks = f.where(F.col("repo").isin("r1", "r4", "r7")).select("repo", F.lit("src/hooks.server.ts").alias("path")).distinct()
    fn = f.where(F.col("path").rlike(r"/\+(page\.server|server)\.ts$")).select("k", "repo", "path", F.when(F.col("path").endswith("/+server.ts"), F.col("verb")).otherwise("load").alias("name"), F.concat(F.lit("fn:"), "k").alias("qualified_name"))
    nodes, edges = route_scan.file_routes(f.select("repo", "path").union(hooks), fn)
    return nodes, edges, f


@query(f"with {_TREE} select repo, dst as route_id, src as file_id from re")
def route_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that realize each route, endpoint, layout or hook."""
    e = _app(spark, d)[1].where(F.col("kind") == "REALIZES")
    return e.select("repo", F.col("dst").alias("route_id"), F.col("src").alias("file_id")).distinct()


@query(f"with {_TREE} select repo, src as file_id, count(*) as n_routes, min(dst) as first_route from re group by all")
def file_route(spark: SparkSession, d: str) -> DataFrame:
    e = _app(spark, d)[1].where(F.col("kind") == "REALIZES").select("repo", "src", "dst").distinct()
    return e.groupBy("repo", F.col("src").alias("file_id")).agg(F.count(F.lit(1)).alias("n_routes"), F.min("dst").alias("first_route"))


@query(f"with {_TREE} select repo, q as endpoint from ep where (repo, q) not in (select repo, dst from gd)")
def unguarded_endpoints(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, _ = _app(spark, d)
    scoped = lambda c: F.concat_ws("|", "repo", c)
    ends = nodes.where(F.col("kind") == "Endpoint").select("repo", "qualified_name", scoped("qualified_name").alias("id"))
    return answers.unguarded(ends, edges.select("kind", scoped("src").alias("src"), scoped("dst").alias("dst"))).select("repo", F.col("qualified_name").alias("endpoint"))


@query(
    f"""with recursive {_TREE}, h as (select distinct f.repo || '|' || n.fname || ' ' || f.url seed, n.qn id from fl f join fn n on n.repo=f.repo and n.path=f.path where f.role=2), n as (select count(*) n from part),
st as (select distinct 'fn:' || p_partkey a, 'fn:' || ((p_partkey * 7 + 1) % n) b from part, n where (p_partkey * 7 + 1) % n <> p_partkey),
w(seed, id, depth) as (select seed, id, 1 from h union select w.seed, st.b, depth+1 from w join st on st.a=w.id where depth<10)
select seed, id, cast(min(depth) as integer) as depth from w group by all"""
)
def endpoint_reachable(spark: SparkSession, d: str) -> DataFrame:
    """Part k's function calls that of part (7k + 1) modulo the number of parts."""
    _, edges, _ = _app(spark, d)
    parts = table(spark, d, "part")
    n = parts.count()
    calls = parts.select(F.lit("CALLS").alias("kind"), F.concat(F.lit("fn:"), "p_partkey").alias("src"), F.concat(F.lit("fn:"), ((F.col("p_partkey") * 7 + 1) % n).cast("string")).alias("dst"))
    handles = edges.where(F.col("kind") == "HANDLES").select("kind", "src", F.concat_ws("|", "repo", "dst").alias("dst"))
    return answers.endpoint_reach(handles.union(calls))


@query(f"with {_TREE}, n as (select count(*) n from part), im as (select distinct a.repo || '|' || a.path src, b.repo || '|' || b.path dst, a.role ra, b.role rb from fl a, n join fl b on b.k=(a.k * 3 + 2) % n) select distinct src, dst from im where ra not in (1, 2, 3, 5) and rb in (1, 2, 3, 5)")
def server_only_imports(spark: SparkSession, d: str) -> DataFrame:
    """Part k's file imports that of part (3k + 2) modulo the number of parts."""
    f = _app(spark, d)[2].select("k", F.concat_ws("|", "repo", "path").alias("id"), route_scan.server_only(F.col("path")).alias("server_only"))
    n = f.count()
    i = f.select(((F.col("k") * 3 + 2) % n).alias("k"), F.col("id").alias("src")).join(f.select("k", F.col("id").alias("dst")), "k")
    return answers.server_only_imports(i.select(F.lit("IMPORTS").alias("kind"), "src", "dst"), f.select("id", F.lit("File").alias("kind"), "server_only").distinct())


@query("""with x as (select distinct p_partkey, 'http://h' || (p_partkey % 3) || '//' || lower(replace(p_type, ' ', '//')) || '/' || ['[id]', '{userId}', ':id', '[...rest]', '**', 'API'][1 + p_partkey % 6] || '/' p from part),
y as (select p_partkey, 'http://h' || (p_partkey % 3) host, '/' || array_to_string(list_filter(string_split(regexp_replace(p, '^https?://[^/]*', ''), '/'), lambda q: q<>''), '/') f2 from x)
select p_partkey, host, f2 as path, regexp_replace(regexp_replace(f2, '/(\\[\\.\\.\\.rest\\]|\\*\\*)$', '/{**}'), '/(\\[id\\]|\\{userId\\}|:id)$', '/{}') as canonical from y""")
def route_canonical(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    last = F.element_at(F.array(*[F.lit(x) for x in ("[id]", "{userId}", ":id", "[...rest]", "**", "API")]), (k % 6 + 1).cast("int"))
    p = F.concat(F.lit("http://h"), (k % 3).cast("string"), F.lit("//"), F.lower(F.replace("p_type", F.lit(" "), F.lit("//"))), F.lit("/"), last, F.lit("/"))
    x = table(spark, d, "part").select("p_partkey", p.alias("p")).distinct()
    return x.select("p_partkey", routes.route_host(F.col("p")).alias("host"), routes.endpoint_path(F.regexp_replace("p", r"^https?://[^/]*", "")).alias("path"), routes.canonical_path(F.col("p")).alias("canonical"))


# ------------------------------------------------------------------ source texts


@query()
def extract_nodes(spark: SparkSession, d: str) -> DataFrame:
    return extract.extracted_nodes(extract.facts(spread(table(spark, d, "source_files"), "file_no")))


@query()
def extract_edges(spark: SparkSession, d: str) -> DataFrame:
    f = Scratch(spark).keep(extract.facts(spread(table(spark, d, "source_files"), "file_no")))
    return extract.extracted_edges(f)


@query("select strftime(date_trunc('day', timezone('UTC', try_cast(committed_at as timestamptz))), '%Y-%m-%d') as day, kind, count(*) as n from edges where try_cast(committed_at as timestamptz) is not null group by all")
def daily_writes(spark: SparkSession, d: str) -> DataFrame:
    w = fold.windowed_activity(table(spark, d, "edges"))
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "kind", "n")
