"""Checked loading of payloads: the first failing rule rejects a row, the rest of the batch loads."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.instants import instant
from loamgraph.functions.routes import hashed_id
from loamgraph.schema import RELATION_TYPES
from loamgraph.sources.tables import Scratch


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def _missing(payload: DataFrame, key: str, refs: Column, known: DataFrame) -> DataFrame:
    """Keys of rows of which some reference is unknown."""
    r = payload.select(key, F.explode(refs).alias("id")).where(F.col("id").isNotNull()).distinct()
    return r.join(known.select("id").distinct(), "id", "left_anti").select(key).distinct().withColumn("unresolved", F.lit(True))


def judged_summaries(summaries: DataFrame, known: DataFrame, dimension: int = 64) -> DataFrame:
    """summary_id, target_id, reject_reason (null: loads) of each distinct summary.

    Rules in order: generator, model, claims, references of every claim, length of the embedding, its model named, the established embedding model
    (that of the first well-formed embedded summary, by creation and id, even if it fails later rules), unknown references.
    """
    s = summaries.dropDuplicates(["summary_id"]).where(F.col("summary_id").isNotNull())
    has = F.col("embedding").isNotNull()
    bare = F.exists("claims", lambda c: F.coalesce(F.size(c["source_refs"]), F.lit(0)) <= 0)
    formed = ~_blank("generator") & ~_blank("model") & (F.coalesce(F.size("claims"), F.lit(0)) > 0) & ~F.coalesce(bare, F.lit(True)) & has & (F.size("embedding") == dimension) & F.col("embedding_model").isNotNull()
    first = s.where(formed).agg(F.min(F.struct(instant("created_at").alias("t"), "summary_id", "embedding_model")).alias("m")).first()["m"]
    refs = F.concat(F.array("target_id"), F.coalesce(F.flatten(F.transform("claims", lambda c: c["source_refs"])), F.array().cast("array<string>")))
    established = F.lit(first["embedding_model"] if first else None).cast("string")
    s = s.join(_missing(s, "summary_id", refs, known), "summary_id", "left")
    reason = (
        F.when(_blank("generator"), "no generator")
        .when(_blank("model"), "no model")
        .when(F.coalesce(F.size("claims"), F.lit(0)) <= 0, "no claims")
        .when(F.coalesce(bare, F.lit(True)), "claim without references")
        .when(has & (F.size("embedding") != dimension), "embedding length")
        .when(has & F.col("embedding_model").isNull(), "embedding without model")
        .when(has & (F.col("embedding_model") != established), "another embedding model")
        .when(F.col("unresolved"), "unknown reference")
    )
    return s.select("summary_id", "target_id", reason.alias("reject_reason"))


def judged_decisions(decisions: DataFrame, known: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """decision_id, reject_reason. A decision may supersede decisions created before it, of the same batch too, but none that was rejected or comes later.

    A rejected decision is not there to be superseded, so those that name it are rejected in turn, until nothing changes.
    """
    scratch = scratch or Scratch(decisions.sparkSession)
    d = decisions.where(F.col("decision_id").isNotNull()).dropDuplicates(["decision_id"]).withColumn("seq", instant("created_at"))
    targets = F.coalesce("decides", F.array().cast("array<string>"))
    d = d.join(_missing(d, "decision_id", targets, known), "decision_id", "left")
    sup = scratch.keep(d.select("decision_id", "seq", F.explode("supersedes").alias("old")))
    prior = d.select(F.col("decision_id").alias("old"), F.col("seq").alias("old_seq"))
    bad = sup.join(prior, "old", "left").where(F.col("old_seq").isNull() | (F.col("old_seq") >= F.col("seq"))).select("decision_id").distinct().withColumn("bad_target", F.lit(True))
    d = d.join(bad, "decision_id", "left")
    reason = (
        F.when(_blank("generator"), "no generator")
        .when(_blank("model"), "no model")
        .when(F.size(targets) == 0, "decides nothing")
        .when(F.col("unresolved"), "unknown target")
        .when(F.col("bad_target"), "supersedes no earlier decision")
    )
    judged, n = scratch.counted(d.select("decision_id", reason.alias("reject_reason")), bad=F.count("reject_reason"))
    while True:
        lost = judged.where(F.col("reject_reason").isNotNull()).select(F.col("decision_id").alias("old"))
        after = sup.join(lost, "old", "left_semi").select("decision_id").distinct().withColumn("late", F.lit(True))
        before = n["bad"]
        judged, n = scratch.counted(
            judged.join(after, "decision_id", "left").select("decision_id", F.coalesce("reject_reason", F.when(F.col("late"), "supersedes no earlier decision")).alias("reject_reason")), bad=F.count("reject_reason")
        )
        if n["bad"] == before:
            return judged


def judged_risks(risks: DataFrame, known: DataFrame) -> DataFrame:
    """title, source_commit, risk_id, reject_reason of risk payloads (title, flags, generator, model, source_commit), once each.

    Rules in order: generator, model, no flags, unknown flags. The id is a hash of the trimmed title, the commit and the sorted flags, repeats of a flag included.
    """
    flags = F.array_sort(F.coalesce("flags", F.array().cast("array<string>")))
    r = risks.where(F.col("title").isNotNull()).select(F.trim("title").alias("title"), "generator", "model", F.coalesce("source_commit", F.lit("")).alias("source_commit"), flags.alias("flags"))
    r = r.withColumn("risk_id", hashed_id("risk:", F.concat(F.array("title", "source_commit"), "flags"))).dropDuplicates(["risk_id"])
    r = r.join(_missing(r, "risk_id", F.col("flags"), known), "risk_id", "left")
    reason = F.when(_blank("generator"), "no generator").when(_blank("model"), "no model").when(F.size("flags") == 0, "no flags").when(F.col("unresolved"), "unknown flag")
    return r.select("title", "source_commit", "risk_id", reason.alias("reject_reason"), "flags")


def in_community(refs: DataFrame, community_edges: DataFrame, contains: DataFrame) -> DataFrame:
    """Of refs (community_id, id), those that are members of the community or that a member Class contains. community_edges: src, dst of MEMBER_OF."""
    m = community_edges.select(F.col("src").alias("id"), F.col("dst").alias("community_id")).distinct()
    under = contains.select(F.col("src").alias("owner"), F.col("dst").alias("id")).join(m.withColumnRenamed("id", "owner"), "owner").select("id", "community_id")
    return refs.select("community_id", "id").distinct().join(m.union(under.select("id", "community_id")).distinct(), ["community_id", "id"], "left_semi")


def _inferred(payload: DataFrame, kind, src, dst, now: DataFrame, anchor=None) -> DataFrame:
    """Rows of inferred edges. What the anchor's (else the target's) code was at when it was bound comes from the present graph."""
    e = payload.select(kind.alias("kind"), src.alias("src"), dst.alias("dst"), (anchor if anchor is not None else dst).alias("_anchor"), "source_commit", "created_at", "generator", "model", "confidence")
    at = now.groupBy(F.col("id").alias("_anchor")).agg(F.min_by("committed_at", "kind").alias("code_bound_at"))
    return e.where(F.col("dst").isNotNull()).join(at, "_anchor", "left").drop("_anchor").withColumn("edge_kind", F.lit("inferred")).distinct()


def summary_rows(summaries: DataFrame, known: DataFrame, now: DataFrame) -> DataFrame:
    """SUMMARIZES edges of the summaries that load: from each to its target and all references, bound to the target."""
    ok = judged_summaries(summaries, known).where(F.col("reject_reason").isNull()).select("summary_id")
    s = summaries.dropDuplicates(["summary_id"]).join(ok, "summary_id", "left_semi")
    refs = F.array_distinct(F.concat(F.array("target_id"), F.flatten(F.transform("claims", lambda c: c["source_refs"]))))
    return _inferred(s.withColumn("ref", F.explode(refs)), F.lit("SUMMARIZES"), F.col("summary_id"), F.col("ref"), now, F.col("target_id"))


def risk_rows(risks: DataFrame, known: DataFrame, now: DataFrame) -> DataFrame:
    """RISKS edges of the risks that load, all bound to the first of the sorted flags."""
    ok = judged_risks(risks, known).where(F.col("reject_reason").isNull()).select("risk_id", "flags", "title", "source_commit")
    r = risks.withColumns({"title": F.trim("title"), "flags": F.array_sort("flags")}).dropDuplicates(["title", "source_commit", "flags"]).join(ok, ["title", "source_commit", "flags"])
    return _inferred(r.withColumn("flag", F.explode("flags")), F.lit("RISKS"), F.col("risk_id"), F.col("flag"), now, F.element_at("flags", 1))


def decision_rows(decisions: DataFrame, known: DataFrame, now: DataFrame) -> DataFrame:
    """DECIDES, SUPERSEDES and ADDRESSES_RISK edges of the decisions that load, bound to the first target that is no decision."""
    ok = judged_decisions(decisions, known).where(F.col("reject_reason").isNull()).select("decision_id")
    d = decisions.dropDuplicates(["decision_id"]).join(ok, "decision_id", "left_semi")
    each = lambda c, k: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(F.lit(k).alias("k"), x.alias("t")))
    d = d.withColumn("e", F.explode(F.concat(each("decides", "DECIDES"), each("supersedes", "SUPERSEDES"), each("addresses_risks", "ADDRESSES_RISK"))))
    return _inferred(d, F.col("e.k"), F.col("decision_id"), F.col("e.t"), now, bound_anchor(F.col("decides")))


def bound_anchor(targets: Column) -> Column:
    """The first target that is no decision."""
    return F.try_element_at(F.filter(targets, lambda x: ~x.startswith("decision:")), F.lit(1))


def relation_rows(relations: DataFrame, known: DataFrame, now: DataFrame) -> DataFrame:
    """Edges of the relations that load, bound to their source."""
    ok = judged_relations(relations, known).where(F.col("reject_reason").isNull()).select("src", "dst", "kind")
    r = relations.join(ok, ["src", "dst", "kind"], "left_semi")
    return _inferred(r, F.col("kind"), F.col("src"), F.col("dst"), now, F.col("src"))


def judged_relations(relations: DataFrame, known: DataFrame) -> DataFrame:
    """src, dst, kind, reject_reason of relation payloads."""
    ids = known.select("id").distinct()
    r = relations.select("src", "dst", "kind", "generator").distinct()
    a, b = ids.select(F.col("id").alias("src"), F.lit(1).alias("a")), ids.select(F.col("id").alias("dst"), F.lit(1).alias("b"))
    r = r.join(a, "src", "left").join(b, "dst", "left")
    reason = F.when(_blank("generator"), "no generator").when(~F.coalesce(F.col("kind").isin(RELATION_TYPES), F.lit(False)), "unknown relation").when(F.col("a").isNull() | F.col("b").isNull(), "unknown endpoint")
    return r.select("src", "dst", "kind", reason.alias("reject_reason"))


def coverage_load(records: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, report): test_id, method_id pairs that load, and per batch intended, loaded, rejected records and skipped references.

    A record needs a test that is a marked Method; a covered name that is no Method only drops out. A name in several planes means the bare plane's node, else the smallest id.
    """
    m = now.where(F.col("kind") == "Method").select("qualified_name", "id", "is_test", F.col("branch").isNotNull().alias("p"))
    names = m.groupBy("qualified_name").agg(F.min(F.struct("p", "id"))["id"].alias("id"), F.coalesce(F.max("is_test"), F.lit(False)).alias("marked"), F.min(F.when(F.col("is_test"), F.struct("p", "id")))["id"].alias("test_id"))
    r = records.select("batch_no", "test_qualified_name", "covered").withColumn("rec", F.xxhash64("batch_no", "test_qualified_name", "covered"))
    t = r.join(names.where("marked").select(F.col("qualified_name").alias("test_qualified_name"), "test_id"), "test_qualified_name", "left")
    x = t.where(F.col("test_id").isNotNull()).select("batch_no", "test_id", F.explode("covered").alias("qualified_name"))
    x = x.join(names.select("qualified_name", F.col("id").alias("method_id")), "qualified_name", "left")
    edges = x.where(F.col("method_id").isNotNull()).select("test_id", "method_id").distinct()
    per = t.groupBy("batch_no").agg(F.count(F.lit(1)).alias("intended"), F.count_if(F.col("test_id").isNull()).alias("rejected"))
    pairs = x.groupBy("batch_no").agg(F.count("method_id").alias("loaded"), F.count_if(F.col("method_id").isNull() & F.col("qualified_name").isNotNull()).alias("skipped"))
    return edges, per.join(pairs, "batch_no", "left").fillna(0, ["loaded", "skipped"])


def summary_ids(payload: DataFrame) -> DataFrame:
    """Adds the content id of a summary: of target, generator, model and commit."""
    return payload.withColumn("content_id", hashed_id("summary:", F.array("target_id", "generator", "model", "source_commit")))
