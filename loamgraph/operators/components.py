"""Connected components by joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.sources.tables import Scratch


def components(pairs: DataFrame, singles: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """node, label: the least node of its component. pairs: a, b in either order; singles: node.

    Labels move over pairs and jump to the label of the label, so rounds grow with the logarithm of the longest path.
    Offers are combined on the map side, so a hub is no hot spot.
    """
    scratch = scratch or Scratch(pairs.sparkSession)
    p = pairs.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = scratch.keep(p.union(p.select(F.col("b"), F.col("a"))).distinct())
    ids = both.select(F.col("a").alias("node"))
    if singles is not None:
        ids = ids.union(singles.select("node").where(F.col("node").isNotNull()))
    state = scratch.keep(ids.distinct().withColumn("label", F.col("node")))
    while True:
        offers = both.join(state.select(F.col("node").alias("a"), "label"), "a").select(F.col("b").alias("node"), "label")
        jumps = state.join(state.select(F.col("node").alias("label"), F.col("label").alias("far")), "label").select("node", F.col("far").alias("label"))
        # the old label's own node hears of the better one too
        own = state.select("node", "label", F.col("label").alias("old"))
        heard = own.unionByName(offers.union(jumps).withColumn("old", F.lit(None).cast(dict(state.dtypes)["label"])))
        merged = scratch.keep(heard.groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")))
        moved = merged.where(F.col("label") != F.col("old")).limit(1).count()
        scratch.drop(state)
        state = merged.select("node", "label")
        state._loam_path = merged._loam_path
        if not moved:
            return state


def unit_of(now: DataFrame, edges: DataFrame) -> DataFrame:
    """member, unit: the Class that contains a Method, or the File that contains a Function."""
    c = edges.where(F.col("kind") == "CONTAINS").select(F.col("src").alias("unit"), F.col("dst").alias("member"))
    kinds = now.select("id", "kind").distinct()
    j = c.join(kinds.select(F.col("id").alias("unit"), F.col("kind").alias("uk")), "unit").join(kinds.select(F.col("id").alias("member"), F.col("kind").alias("mk")), "member")
    return j.where(((F.col("uk") == "Class") & (F.col("mk") == "Method")) | ((F.col("uk") == "File") & (F.col("mk") == "Function"))).select("member", "unit").distinct()


def lifted_pairs(now: DataFrame, edges: DataFrame) -> DataFrame:
    """a < b: pairs of units between whose members there is a call."""
    u = unit_of(now, edges)
    calls = edges.where(F.col("kind") == "CALLS").select("src", "dst")
    j = calls.join(u.select(F.col("member").alias("src"), F.col("unit").alias("a")), "src").join(u.select(F.col("member").alias("dst"), F.col("unit").alias("b")), "dst")
    return j.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def communities(now: DataFrame, edges: DataFrame, scratch: Scratch | None = None, published: bool = False) -> DataFrame:
    """member, label, community_id, n_members over Classes and Files with functions; single ones are kept.

    community_id: a hash of the number of members and of the sum of their own hashes, which is the same in any order and needs no list of them, so it
    serves components of any size. published: the hash of all sorted members in one text, as other tools make it; it gathers a component in one row.
    """
    u = unit_of(now, edges).select(F.col("unit").alias("node")).union(now.where(F.col("kind") == "Class").select(F.col("id").alias("node")))
    c = components(lifted_pairs(now, edges), u.distinct(), scratch)
    own = F.conv(F.substring(F.sha2("node", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    text = F.array_join(F.array_sort(F.collect_list("node")), "\x00") if published else F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(own).cast("string"))
    ids = c.groupBy("label").agg(F.concat(F.lit("community:"), F.sha2(text, 256)).alias("community_id"), F.count(F.lit(1)).alias("n_members"))
    return c.join(ids, "label").select(F.col("node").alias("member"), "label", "community_id", "n_members")


def community_graph(now: DataFrame, edges: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a Community node for each community and a MEMBER_OF edge from each member to it."""
    c = communities(now, edges, scratch)
    nodes = c.groupBy("community_id").agg(F.max("n_members").alias("n_members")).select(F.lit("Community").alias("kind"), F.col("community_id").alias("id"), F.col("community_id").alias("qualified_name"), "n_members")
    return nodes, c.select(F.lit("MEMBER_OF").alias("kind"), F.col("member").alias("src"), F.col("community_id").alias("dst"), F.lit("deterministic").alias("edge_kind"))
