"""Parent-child rows of unknown depth: paths, depths, roots, descendants and loops."""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.identity import bare_name
from loamgraph.functions.instants import instant
from loamgraph.sources.tables import Scratch


def distinct_links(edges: DataFrame, kind: str | None = "CONTAINS") -> DataFrame:
    """parent, child: distinct links of one kind, of any age. Rows with a null end link nothing."""
    e = edges.where(F.col("kind") == kind) if kind else edges
    return e.select(F.col("src").alias("parent"), F.col("dst").alias("child")).where(F.col("parent").isNotNull() & F.col("child").isNotNull()).distinct()


def _from_roots(links: DataFrame, ids: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """node_id, parent_id, root_id, depth, id_path, full_path of all nodes that no loop lies above, one table a level.

    links: parent, child, n_parents (of the child), newest (whether this parent is the child's newest). A frontier of nodes extends along all links, of
    any age; a node joins the next frontier when the last of its parents has reached it, so it is placed once, with the path of its newest parent. What is never
    placed lies on a loop or below one.
    """
    level = ids.join(links.select(F.col("child").alias("node_id")), "node_id", "left_anti").select(
        "node_id",
        F.lit(None).cast("string").alias("parent_id"),
        F.col("node_id").alias("root_id"),
        F.lit(0).alias("depth"),
        F.array("node_id").alias("id_path"),
        F.array(bare_name(F.col("node_id"))).alias("full_path"),
    )
    level, seen = scratch.counted(level)
    done, waiting, n = [level], None, seen["n"]
    while n:
        up = level.select(F.col("node_id").alias("parent"), F.struct(F.col("node_id").alias("id"), "root_id", "depth", "id_path", "full_path").alias("up"))
        hits = links.join(up, "parent").select("child", "n_parents", F.lit(1).cast("long").alias("hits"), F.when(F.col("newest"), F.col("up")).alias("up"))
        if waiting is not None:
            hits = hits.unionByName(waiting)
        # equal parts of a child's parents are added up on the map side, so a child of a million parents is no hot spot
        hits = hits.groupBy("child", "n_parents").agg(F.sum("hits").alias("hits"), F.max("up").alias("up"))
        ready = F.col("hits") == F.col("n_parents")
        hits, seen = scratch.counted(hits, ready=F.count_if(ready))
        waiting, level, n = hits.where(~ready), _below(hits.where(ready)), seen["ready"]
        done.append(level)
    return done


def _below(hits: DataFrame) -> DataFrame:
    """The rows of children whose newest parent's row is `up`."""
    return hits.select(
        F.col("child").alias("node_id"),
        F.col("up.id").alias("parent_id"),
        F.col("up.root_id").alias("root_id"),
        (F.col("up.depth") + 1).alias("depth"),
        F.concat("up.id_path", F.array("child")).alias("id_path"),
        F.concat("up.full_path", F.array(bare_name(F.col("child")))).alias("full_path"),
    )


def _trim(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """The links on or between loops, and perhaps others, and their number: level by level, links from roots and links to leaves drop off, while that halves them."""
    left, seen = scratch.counted(links.select("parent", "child"))
    n, before = seen["n"], None
    while n and (before is None or 2 * n <= before):
        # frontier joins: a link stays while its parent is someone's child and its child is someone's parent
        step = left.join(left.select(F.col("child").alias("parent")), "parent", "left_semi").join(left.select(F.col("parent").alias("child")), "child", "left_semi")
        left, seen = scratch.counted(step.select("parent", "child"), replaces=left)
        n, before = seen["n"], n
    return left, n


def _least_both_ways(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, above (least id that reaches it) and below (least id that it reaches), itself included in both.

    Labels move along links, and by jumps to the label of the label, so a long loop takes rounds in
    the order of the logarithm of its length. Offers are combined on the map side, so a hub is no hot spot.
    """
    none = F.lit(None).cast("string")
    state = scratch.keep(links.select(F.explode(F.array("parent", "child")).alias("node")).distinct().select("node", F.col("node").alias("above"), F.col("node").alias("below")))
    while True:
        up, down = state.select(F.col("node").alias("parent"), F.col("above")), state.select(F.col("node").alias("child"), F.col("below"))
        offers = links.join(up, "parent").select(F.col("child").alias("node"), "above", none.alias("below"))
        offers = offers.union(links.join(down, "child").select("parent", none, "below"))
        offers = offers.union(state.join(state.select(F.col("node").alias("above"), F.col("above").alias("far")), "above").select("node", "far", none))
        offers = offers.union(state.join(state.select(F.col("node").alias("below"), F.col("below").alias("far")), "below").select("node", none, "far"))
        new = state.select("*", F.col("above").alias("a0"), F.col("below").alias("b0")).unionByName(offers.withColumns({"a0": none, "b0": none}))
        new = new.groupBy("node").agg(F.min("above").alias("above"), F.min("below").alias("below"), F.max("a0").alias("a0"), F.max("b0").alias("b0"))
        new, seen = scratch.counted(new, moved=F.count_if((F.col("above") != F.col("a0")) | (F.col("below") != F.col("b0"))))
        scratch.drop(state)
        state = new.select("node", "above", "below")
        state._loam_path = new._loam_path
        if not seen["moved"]:
            return state


def loops(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node_id, loop_id for every node that reaches itself; loop_id is the least id of its loop.

    Level-wise frontier joins take away what hangs from roots or ends in leaves. Of what is left, each node takes the least id that reaches
    it and the least that it reaches: where both are one id, node and id lie on one loop, and all nodes with that pair are that loop.
    Nodes of one loop always share both, so only links between such nodes go on, without the found ones, until none is left.
    All by joins. A link from a node to itself is a loop of one.
    """
    scratch = scratch or Scratch(links.sparkSession)
    links = scratch.keep(links.select("parent", "child"))
    own = links.where(F.col("parent") == F.col("child")).select(F.col("parent").alias("node_id"), F.col("parent").alias("loop_id"))
    parts = [scratch.keep(own)]
    core, n = _trim(links.where(F.col("parent") != F.col("child")), scratch)
    while n:
        colour = _least_both_ways(core, scratch)
        parts.append(colour.where(F.col("above") == F.col("below")).select(F.col("node").alias("node_id"), F.col("above").alias("loop_id")))
        rest = colour.where(F.col("above") != F.col("below"))
        c1 = rest.select(F.col("node").alias("parent"), "above", "below")
        c2 = rest.select(F.col("node").alias("child"), "above", "below")
        core, n = _trim(core.join(c1, "parent").join(c2, ["child", "above", "below"]), scratch)
    out = _all_of(parts)
    # a node alone with its own id is no loop of several; a node of a larger loop may also link to itself: one row, with the least id
    sizes = out.groupBy("loop_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("node_id") != F.col("loop_id")).alias("several")).where("several").select("loop_id")
    found = parts[0].unionByName(out.join(sizes, "loop_id", "left_semi").select("node_id", "loop_id"))
    return found.groupBy("node_id").agg(F.min("loop_id").alias("loop_id"))


def placed_and_looped(edges: DataFrame, nodes: DataFrame | None, kind: str, scratch: Scratch) -> tuple[list[DataFrame], DataFrame, DataFrame, DataFrame]:
    """(levels, unreached, links, loops): what frontiers from the roots place, the nodes they never reach, all links, and the loops among the unreached."""
    e = edges.where(F.col("kind") == kind).where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    age = -F.coalesce(F.unix_micros(instant("committed_at")), F.lit(-(2**62)))
    each = scratch.keep(e.groupBy(F.col("src").alias("parent"), F.col("dst").alias("child")).agg(F.min(age).alias("age")))
    best = each.groupBy("child").agg(F.min(F.struct("age", "parent"))["parent"].alias("first"), F.count(F.lit(1)).alias("n_parents"))
    links = each.join(best, "child").select("parent", "child", "n_parents", (F.col("parent") == F.col("first")).alias("newest"))
    links = scratch.keep(links, replaces=each)
    ids = links.select(F.col("parent").alias("node_id")).union(links.select("child"))
    if nodes is not None:
        ids = ids.union(nodes.select("id").where(F.col("id").isNotNull()))
    ids = scratch.keep(ids.distinct())
    levels = _from_roots(links, ids, scratch)
    unreached = scratch.keep(ids.join(_all_of(levels).select("node_id"), "node_id", "left_anti"))
    ends = lambda c: unreached.withColumnRenamed("node_id", c)
    found = scratch.keep(loops(links.join(ends("child"), "child", "left_semi").join(ends("parent"), "parent", "left_semi"), scratch))
    return levels, unreached, links, found


def hierarchy(edges: DataFrame, nodes: DataFrame | None = None, kind: str = "CONTAINS", scratch: Scratch | None = None) -> DataFrame:
    """node_id, parent_id, other_parents, root_id, depth, id_path, full_path, state, loop_id: one row for every node.

    Level-wise frontier joins from the roots, over links of any age, extend paths and depths (`_from_roots`). A node's place is that below its newest parent
    (of equally new ones the smallest; an unreadable instant counts as the oldest); its other parents are kept, sorted, in other_parents. Nodes that
    this never reaches lie on a loop or below one. Among them frontiers go on along newest parents, which places those that have
    moved out of a loop; the others get state `in_loop_or_below` and null depth, root and paths. The links among unreached nodes show the loops
    (`loops`): loop_id is the least id of the loop that a node is on, through links of any age, else null. Ids of `nodes` without any
    link are roots of depth 0. Null ends link nothing; repeated rows count once; extra columns are ignored; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    scratch = scratch or Scratch(spark)
    done, unreached, links, found = placed_and_looped(edges, nodes, kind, scratch)
    # among the unreached: on from placed nodes along newest parents
    newest = scratch.keep(links.where("newest").join(unreached.withColumnRenamed("node_id", "child"), "child", "left_semi").select("parent", "child"))
    level, n = _all_of(done).join(newest.select(F.col("parent").alias("node_id")), "node_id", "left_semi"), 1
    while n:
        up = level.select(F.col("node_id").alias("parent"), F.struct(F.col("node_id").alias("id"), "root_id", "depth", "id_path", "full_path").alias("up"))
        level, seen = scratch.counted(_below(newest.join(up, "parent").select("child", "up")))
        n = seen["n"]
        done.append(level)
    placed = _all_of(done).withColumn("state", F.lit("placed"))
    lost = unreached.join(placed.select("node_id"), "node_id", "left_anti").join(newest.select(F.col("child").alias("node_id"), F.col("parent").alias("parent_id")), "node_id", "left")
    every = placed.unionByName(lost.withColumn("state", F.lit("in_loop_or_below")), allowMissingColumns=True)
    others = links.where(~F.col("newest")).groupBy(F.col("child").alias("node_id")).agg(F.array_sort(F.collect_list("parent")).alias("other_parents"))
    return every.join(others, "node_id", "left").join(found, "node_id", "left")


def _all_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ancestor_pairs(placed: DataFrame) -> DataFrame:
    """ancestor_id, descendant_id, distance for every placed node and each node above it. For nodes on and below loops see `pairs_at_loops`."""
    p = placed.where(F.col("id_path").isNotNull()).select(F.col("node_id").alias("descendant_id"), "depth", F.posexplode("id_path").alias("pos", "ancestor_id"))
    return p.where(F.col("pos") < F.col("depth")).select("ancestor_id", "descendant_id", (F.col("depth") - F.col("pos")).alias("distance"))


def _in_turn(group: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one loop with their places, from the least id on downwards. Every node has one parent, so a loop is a ring."""
    below = dict(zip(group["parent"], group["child"]))
    ring = [min(below)]
    while below[ring[-1]] != ring[0]:
        ring.append(below[ring[-1]])
    return pd.DataFrame({"top": ring, "loop_id": ring[0], "place": range(len(ring)), "size": len(ring)})


def pairs_at_loops(placed: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """ancestor_id, descendant_id, distance for the nodes of `hierarchy` that no root reaches, over each child's newest parent.

    Frontiers start from every node of a loop over the links outside loops. A node has the nodes on the way up to its loop above it and
    all of the loop; a node of a loop has the others of it above it, at the distance of the way down, and never itself.
    Together with `ancestor_pairs` these are all pairs, each once.
    """
    scratch = scratch or Scratch(placed.sparkSession)
    lost = placed.where((F.col("state") == "in_loop_or_below") & F.col("parent_id").isNotNull())
    links = scratch.keep(lost.select(F.col("parent_id").alias("parent"), F.col("node_id").alias("child")))
    ids = scratch.keep(loops(links, scratch))
    in_loop = ids.select(F.col("node_id").alias("child"), "loop_id")
    # one parent a child: the link to a node of a loop comes from that loop
    rings = links.join(in_loop, "child").groupBy("loop_id").applyInPandas(_in_turn, "top string, loop_id string, place long, size long")
    rings = scratch.keep(rings)
    outside = scratch.keep(links.join(in_loop, "child", "left_anti").select("parent", "child"))
    level, seen = scratch.counted(rings.select(F.col("top").alias("node_id"), "top", F.lit(0).alias("depth"), F.array("top").alias("id_path")))
    below = level
    while seen["n"]:
        up = level.withColumnRenamed("node_id", "parent")
        level, seen = scratch.counted(
            outside.join(up, "parent").select(F.col("child").alias("node_id"), "top", (F.col("depth") + 1).alias("depth"), F.concat("id_path", F.array("child")).alias("id_path"))
        )
        below = below.unionByName(level)
    others = rings.select("loop_id", F.col("top").alias("ancestor_id"), F.col("place").alias("above"))
    around = (
        below.join(rings, "top")
        .join(others, "loop_id")
        .where(F.col("above") != F.col("place"))
        .select("ancestor_id", F.col("node_id").alias("descendant_id"), (F.pmod(F.col("place") - F.col("above"), F.col("size")) + F.col("depth")).cast("int").alias("distance"))
    )
    return ancestor_pairs(below).unionByName(around)


def descendant_counts(placed: DataFrame) -> DataFrame:
    """node_id, n_descendants, height: aggregated on the map side, so a root of all rows is no hot spot."""
    pairs = ancestor_pairs(placed)
    return pairs.groupBy(F.col("ancestor_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_descendants"), F.max("distance").alias("height"))


def containers_by_depth(edges: DataFrame, kind: str = "CONTAINS", scratch: Scratch | None = None) -> DataFrame:
    """ancestor_id, node_id, n_paths, min_depth over all links of any age: one row per pair, with the number of link paths.

    Links inside loops are left out first, so the number of paths is finite. Level-wise: the ancestors
    at distance n join the links above them, counts are multiplied and added up.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    links = scratch.keep(distinct_links(edges, kind))
    inside = loops(links, scratch)
    a, b = inside.select(F.col("node_id").alias("parent"), F.col("loop_id").alias("lp")), inside.select(F.col("node_id").alias("child"), F.col("loop_id").alias("lc"))
    acyclic = links.join(a, "parent", "left").join(b, "child", "left").where(~F.coalesce(F.col("lp") == F.col("lc"), F.lit(False))).select("parent", "child")
    acyclic = scratch.keep(acyclic)
    level, seen = scratch.counted(acyclic.select(F.col("parent").alias("ancestor_id"), F.col("child").alias("node_id"), F.lit(1).cast("long").alias("n_paths"), F.lit(1).alias("distance")))
    parts = [level]
    while seen["n"]:
        nxt = (
            level.join(acyclic.select(F.col("parent").alias("node_id"), "child"), "node_id")
            .groupBy("ancestor_id", "child", "distance")
            .agg(F.sum("n_paths").alias("n_paths"))
            .select("ancestor_id", F.col("child").alias("node_id"), "n_paths", (F.col("distance") + 1).alias("distance"))
        )
        level, seen = scratch.counted(nxt)
        parts.append(level)
    return _all_of(parts).groupBy("ancestor_id", "node_id").agg(F.sum("n_paths").alias("n_paths"), F.min("distance").alias("min_depth"))


def newest_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
