"""Registered queries of the general data problems."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators import attribute_history, heavy_keys, hierarchy, orphans
from loamgraph.sources.tables import Scratch, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The nodes on loops, from what the hierarchy's frontiers from the roots never reach."""
    return hierarchy.placed_and_looped(table(spark, d, "edges"), None, "CONTAINS", Scratch(spark))[3]


def _all_nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").unionByName(table(spark, d, "platform_nodes"))


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.hierarchy(table(spark, d, "edges"), _all_nodes(spark, d))
    others = F.coalesce(F.array_join("other_parents", " | "), F.lit("")).alias("other_parents")
    return h.select("node_id", "parent_id", others, "root_id", F.col("depth").cast("long").alias("depth"), F.array_join("full_path", " > ").alias("full_path"), "state", "loop_id")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark)
    h = scratch.keep(hierarchy.hierarchy(table(spark, d, "edges"), _all_nodes(spark, d)))
    pairs = hierarchy.ancestor_pairs(h).unionByName(hierarchy.pairs_at_loops(h, scratch))
    return pairs.select("ancestor_id", "descendant_id", F.col("distance").cast("long").alias("distance"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = orphans.references(*(table(spark, d, n) for n in ("edges", "coverage_records", "decision_rejections", "coverage_results")))
    known = orphans.known_records(*(table(spark, d, n) for n in ("nodes", "platform_nodes", "decisions")))
    return orphans.orphan_references(refs, known)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_month", "ref_id", "ref_state")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    h = attribute_history.entity_history(table(spark, d, "nodes"), "id", "committed_at", ["path"])
    changed = h.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("entity_id")
    return h.join(changed, "entity_id", "left_semi").select(
        F.col("entity_id").alias("node_id"),
        F.unix_seconds("valid_from").alias("valid_from"),
        F.coalesce(F.unix_seconds("valid_to"), F.lit(-1)).cast("long").alias("valid_to"),
    )


#: The attributes of a node that may change over its life.
NODE_ATTRIBUTES = ["path", "name", "start_line", "end_line", "is_test", "role", "code_bound_at"]


def p6_history(spark: SparkSession, d: str) -> DataFrame:
    h = attribute_history.entity_history(table(spark, d, "nodes"), "id", "committed_at", NODE_ATTRIBUTES)
    return h.withColumns({"valid_from": F.unix_seconds("valid_from"), "valid_to": F.coalesce(F.unix_seconds("valid_to"), F.lit(-1)).cast("long")})


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    p = heavy_keys.key_profile(table(spark, d, "edges"))
    return p.where(F.col("row_share") >= 0.02).select("edge_side", "key_id")


def p7_profile(spark: SparkSession, d: str) -> DataFrame:
    p = heavy_keys.key_profile(table(spark, d, "edges"))
    kinds = F.array_join(F.transform(F.map_entries("rows_per_kind"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return p.select("edge_side", "key_id", "n_rows", "n_partners", kinds.alias("rows_per_kind"))


QUERIES = {f.__name__: f for f in (p3_found, p3_hierarchy, p3_descendants, p5_found, p5_report, p6_found, p6_history, p7_found, p7_profile)}

_T = "try_cast({} as timestamptz)"

SQL = {
    "p3_found": """
with recursive l as (select distinct src a, dst b from edges where kind='CONTAINS' and src is not null and dst is not null),
seed as (select a from l intersect select b from l),
core as (select l.* from l join seed s on s.a=l.a join seed t on t.a=l.b),
r(x, y) as (select a, b from core union select r.x, c.b from r join core c on c.a=r.y),
m as (select r.x, r.y from r join r q on q.x=r.y and q.y=r.x)
select x as node_id, min(least(x, y)) as loop_id from m group by x""",
    "p5_found": """
with k as (
 select 'id' pool, id k, try_cast(committed_at as timestamptz) t from nodes union all select 'id', id, try_cast(committed_at as timestamptz) from platform_nodes
 union all select 'id', decision_id, try_cast(created_at as timestamptz) from decisions
 union all select 'method', qualified_name, try_cast(committed_at as timestamptz) from nodes where kind='Method'
 union all select 'method', qualified_name, try_cast(committed_at as timestamptz) from platform_nodes where kind='Method'),
known as (select pool, k, min(t) t from k where k is not null group by all),
dr as (select reason, rejected_at, case
  when contains(reason, chr(96)) then regexp_extract_all(reason, chr(96)||'([^'||chr(96)||']+)'||chr(96), 1)
  when contains(reason, '[''') then string_split(replace(regexp_extract(reason, '\\[''(.*)''\\]', 1), ''', ''', chr(30)), chr(30))
  when contains(reason, '"') then regexp_extract_all(reason, '"([^"]+)"', 1)
  when contains(reason, 'not found:') then string_split(regexp_extract(reason, 'not found: (.*)$', 1), '; ')
  else [] end ids from decision_rejections),
cr as (select unnest(reasons) r, loaded_at from coverage_results),
refs as (
 select 'edges' ref_table, 'id' pool, dst k, coalesce(try_cast(created_at as timestamptz), try_cast(committed_at as timestamptz)) t from edges
 union all select 'coverage_records', 'method', unnest(covered), loaded_at from coverage_records
 union all select 'decision_rejections', 'id', unnest(ids), rejected_at from dr
 union all select 'coverage_results', 'method', coalesce(nullif(regexp_extract(r, '^[^''"'||chr(96)||']*''([^'']+)''', 1), ''), nullif(regexp_extract(r, '^[^''"'||chr(96)||']*"([^"]+)"', 1), ''), nullif(regexp_extract(r, '^[^''"'||chr(96)||']*'||chr(96)||'([^'||chr(96)||']+)'||chr(96), 1), '')), loaded_at from cr)
select distinct ref_table, strftime(timezone('UTC', r.t), '%Y-%m') ref_month, r.k ref_id, case when known.k is null then 'absent' else 'late' end ref_state
from refs r left join known on known.pool=r.pool and known.k=r.k
where r.k is not null and (known.k is null or known.t > r.t)""",
    "p6_found": """
with s as (select id, try_cast(committed_at as timestamptz) t, min(path) p from nodes where id is not null group by all),
c as (select *, lag(p) over w lp, row_number() over w rn from s where t is not null window w as (partition by id order by t)),
v as (select id, t, lead(t) over (partition by id order by t) n, count(*) over (partition by id) cnt from c where rn=1 or p is distinct from lp)
select id as node_id, cast(floor(epoch(t)) as bigint) as valid_from, coalesce(cast(floor(epoch(n)) as bigint), -1) as valid_to from v where cnt > 1""",
    "p7_found": """
with b as (select 'src' edge_side, src key_id from edges union all select 'dst', dst from edges)
select edge_side, key_id from b where key_id is not null group by all having count(*) >= 0.02 * (select count(*) from edges)""",
    "p7_profile": """
with b as (select 'src' edge_side, src key_id, dst p, coalesce(kind, 'unknown') k from edges union all select 'dst', dst, src, coalesce(kind, 'unknown') from edges),
kk as (select edge_side, key_id, k, count(*) n from b where key_id is not null group by all),
ks as (select edge_side, key_id, cast(sum(n) as bigint) n_rows, string_agg(k || '=' || n, ',' order by k) rows_per_kind from kk group by all)
select ks.edge_side, ks.key_id, n_rows, n_partners, rows_per_kind from ks join
 (select edge_side, key_id, count(distinct p) n_partners from b where key_id is not null group by all) using (edge_side, key_id)""",
}
_REFS = SQL["p5_found"][: SQL["p5_found"].rindex("select distinct ref_table")]
SQL["p5_report"] = f"""
{_REFS.rstrip()}, g as (select ref_table, pool, k, strftime(timezone('UTC', t), '%Y-%m') ref_month, count(*) n, min(t) t from refs where k is not null group by all),
o as (select ref_table, ref_month, n, case when known.k is null then 'absent' else 'late' end ref_state from g left join known on known.pool=g.pool and known.k=g.k where known.k is null or known.t > g.t)
select ref_table, ref_month, ref_state, count(*) as n_ids, cast(sum(n) as bigint) as n_rows from o group by all"""
_A = ", ".join(f"min(cast({c} as varchar)) {c}" for c in NODE_ATTRIBUTES)
_S = "(" + ", ".join(NODE_ATTRIBUTES) + ")"
SQL["p6_history"] = f"""
with s as (select id, try_cast(committed_at as timestamptz) t, {_A} from nodes where id is not null group by all),
c as (select *, lag(row{_S}) over w lp, row_number() over w rn from s where t is not null window w as (partition by id order by t)),
v as (select * from c where rn=1 or row{_S} is distinct from lp)
select id as entity_id, {", ".join(NODE_ATTRIBUTES)}, cast(floor(epoch(t)) as bigint) as valid_from, coalesce(cast(floor(epoch(lead(t) over (partition by id order by t))) as bigint), -1) as valid_to from v"""
_BARE = "case when {0} like 'branch:%' and contains({0}, chr(31)) then substr({0}, strpos({0}, chr(31)) + 1) else {0} end"
_TREE = f"""l as (select src p, dst c, max(coalesce(epoch_us(try_cast(committed_at as timestamptz)), -4611686018427387904)) t from edges where kind='CONTAINS' and src is not null and dst is not null group by all),
nw as (select * from (select *, row_number() over (partition by c order by t desc, p) rn from l) where rn=1),
ids as (select p id from l union select c from l union select id from nodes where id is not null union select id from platform_nodes where id is not null),
tr(id, parent, root, depth, path) as (select id, cast(null as varchar), id, cast(0 as bigint), {_BARE.format("id")} from ids where id not in (select c from l)
 union all select nw.c, tr.id, tr.root, tr.depth+1, tr.path || ' > ' || {_BARE.format("nw.c")} from tr join nw on nw.p=tr.id)"""
SQL["p3_hierarchy"] = f"""
with recursive {_TREE}, seed as (select p a from l intersect select c from l), core as (select l.p a, l.c b from l join seed s on s.a=l.p join seed t on t.a=l.c),
r(x, y) as (select a, b from core union select r.x, c.b from r join core c on c.a=r.y), lp as (select r.x, min(least(r.x, r.y)) g from r join r q on q.x=r.y and q.y=r.x group by 1),
ot as (select l.c, string_agg(l.p, ' | ' order by l.p) o from l join nw on nw.c=l.c where l.p<>nw.p group by 1)
select ids.id as node_id, coalesce(tr.parent, case when tr.id is null then nw.p end) as parent_id, coalesce(ot.o, '') as other_parents, tr.root as root_id, tr.depth, tr.path as full_path,
 case when tr.id is null then 'in_loop_or_below' else 'placed' end as state, lp.g as loop_id
from ids left join tr on tr.id=ids.id left join nw on nw.c=ids.id left join ot on ot.c=ids.id left join lp on lp.x=ids.id"""
SQL["p3_descendants"] = f"""
with recursive {_TREE}, up(node, anc, n, seen) as (select c, p, cast(1 as bigint), [c, p] from nw where c<>p
 union all select up.node, nw.p, up.n+1, list_append(up.seen, nw.p) from up join nw on nw.c=up.anc where not list_contains(up.seen, nw.p))
select anc as ancestor_id, node as descendant_id, n as distance from up"""
