"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.functions.identity import repository_of
from loamgraph.llm import abuse, cooccurrence, leakage, mixing, neighbours, source_validity
from loamgraph.sources.tables import Scratch, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return source_validity.file_faults(table(spark, d, "source_files")).where(F.col("fault").isNotNull()).select("file_no")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return source_validity.fault_rates(source_validity.file_faults(table(spark, d, "source_files")))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.memberships(table(spark, d, "edges").where(F.col("kind") == "MODIFIES"), "src", "dst", repository_of(F.col("dst")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    s = cooccurrence.surprising_pairs(_changes(spark, d), min_pair=5)
    far = F.col("n_ab") * F.col("n") >= 3 * F.col("n_a") * F.col("n_b")
    return s.where(far).select(F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"))


def p2_surprise(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.surprising_pairs(_changes(spark, d), min_pair=1)


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that shares a commit, with its counts and lift."""
    s = p2_surprise(spark, d)
    return s.select("scope", "item_a", "item_b", "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest(table(spark, d, "summaries"), "summary_id", "embedding", "embedding_model", 5, 64)
    return neighbours.close_pairs(near, 0.9).select(F.col("a").alias("summary_a"), F.col("b").alias("summary_b"))


def p4_nearest(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", None, 5, 64)
    return near.select(F.col("a").alias("vec_id"), F.col("b").alias("neighbour_id"), F.round("cos", 6).alias("cosine"))


def p4_search(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 20 is a query against all vectors; itself, or its copy with the smallest id, comes first."""
    scratch = Scratch(spark)
    rows, classes, dtype = neighbours.folded(table(spark, d, "embeddings"), "vec_id", "embedding", None, 64, scratch)
    graph = neighbours.build(classes.select("nid", "scope", F.element_at("members", 1)["raw"].alias("raw")), scratch, dtype)
    queries = rows.where(F.col("key") % 20 == 0)
    hits = neighbours.search(graph, queries.select(F.col("key").alias("qid"), "scope", "raw"), 10, scratch=scratch)
    # a node stands for all copies of its vector
    copies = hits.join(classes.select("nid", F.explode("members.key").alias("neighbour_id")), "nid")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cos"), "neighbour_id"))
    best = copies.withColumn("rank", rank.cast("long")).where(F.col("rank") <= 10)
    return best.select(F.col("qid").alias("vec_id"), "neighbour_id", "rank", F.round("cos", 6).alias("cosine"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(_leaks(spark, d), table(spark, d, "eval_items"))


#: Talk early, records of work late: time in training and relative weight. Other sources keep an even weight.
CURRICULUM = {"chat_log": [(0.0, 2.0), (1.0, 0.5)], "issue_thread": [(0.0, 1.5), (0.5, 1.0), (1.0, 0.5)], "readme": [(0.0, 0.5), (1.0, 1.5)], "commit_message": [(0.0, 0.8), (1.0, 1.2)]}


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.assign(table(spark, d, "documents"), table(spark, d, "mix_targets"), CURRICULUM)


def p9_uses(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def _judged(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return abuse.scored(docs, abuse.fit(docs, table(spark, d, "review_labels")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("abusive").select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("doc_id", "source", F.round("score", 6).alias("score"), "abusive")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_judged(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p2_found, p2_surprise, p2_counts, p4_found, p4_nearest, p4_search, p8_found, p8_report, p9_uses, p9_shares, p10_found, p10_scores, p10_rates)}

SQL = {
    "p2_found": """
with m as (select distinct src, dst, string_split(case when dst like 'branch:%' and contains(dst, chr(31)) then substr(dst, strpos(dst, chr(31)) + 1) else dst end, '/')[1] repo
 from edges where kind='MODIFIES' and src is not null and dst is not null),
i as (select repo, dst, count(*) n from m group by all), r as (select repo, count(distinct src) n from m group by all),
p as (select a.repo, a.dst x, b.dst y, count(*) n from m a join m b on a.src=b.src and a.repo=b.repo and a.dst<b.dst group by all having count(*) >= 5)
select x as file_a, y as file_b from p join i a on a.repo=p.repo and a.dst=p.x join i b on b.repo=p.repo and b.dst=p.y join r on r.repo=p.repo where p.n*r.n >= 3*a.n*b.n""",
    "p2_counts": """
with m as (select distinct src, dst, string_split(case when dst like 'branch:%' and contains(dst, chr(31)) then substr(dst, strpos(dst, chr(31)) + 1) else dst end, '/')[1] repo
 from edges where kind='MODIFIES' and src is not null and dst is not null),
i as (select repo, dst, count(*) n from m group by all), r as (select repo, count(distinct src) n from m group by all),
p as (select a.repo, a.dst x, b.dst y, count(*) n from m a join m b on a.src=b.src and a.repo=b.repo and a.dst<b.dst group by all)
select p.repo as scope, x as item_a, y as item_b, p.n as n_ab, i.n as n_a, b.n as n_b, r.n as n, round(p.n * r.n / (i.n * b.n), 6) as lift
from p join i on i.repo=p.repo and i.dst=p.x join i b on b.repo=p.repo and b.dst=p.y join r on r.repo=p.repo""",
    "p4_found": """
with r as (select summary_id k, min(embedding) v, embedding_model m from summaries where summary_id is not null and len(embedding)=64
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x)))=0 and len(list_filter(embedding, lambda x: x<>0))>0 group by all),
d as (select k, m, list_transform(v, lambda x: cast(x as double)) v from r),
c as (select a.k x, b.k y, list_cosine_similarity(a.v, b.v) c from d a join d b on a.m is not distinct from b.m and a.k<>b.k),
t as (select *, row_number() over (partition by x order by c desc, y) rn from c)
select distinct least(x, y) as summary_a, greatest(x, y) as summary_b from t where rn<=5 and c>=0.9""",
    "p4_nearest": """
with d as (select vec_id k, list_transform(min(embedding), lambda x: cast(x as double)) v from embeddings where len(embedding)=64 group by 1),
c as (select a.k x, b.k y, list_cosine_similarity(a.v, b.v) c from d a join d b on a.k<>b.k),
t as (select *, row_number() over (partition by x order by c desc, y) rn from c)
select x as vec_id, y as neighbour_id, round(c, 6) as cosine from t where rn<=5""",
}
