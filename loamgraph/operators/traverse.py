"""Bounded walks from many seeds at once."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.schema import WALKED
from loamgraph.sources.tables import Scratch, tasks


#: Places of the relations in the order of their names: an item of a walk is four times a node's number, and the place of its relation.
_RELATIONS = sorted(WALKED)


def _numbered(known: DataFrame, start: DataFrame | None, scratch: Scratch) -> DataFrame:
    """n, id, known: ids of `known`, and of a walk's start, numbered in their order; walks move and compare numbers only."""
    ids = known.select("id", F.lit(True).alias("known"))
    if start is not None:
        ids = ids.union(start.select("seed", F.lit(False))).union(start.select("id", F.lit(False)))
    ids = ids.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("known").alias("known"))
    return scratch.keep(ids.repartitionByRange("id").sortWithinPartitions("id").withColumn("n", F.monotonically_increasing_id()))


def _block(n: str):
    """Seeds whose ids are close, as those of one repository are, form a block."""
    return F.shiftright(n, 10).alias("block")


def _near(edges: DataFrame, numbered: DataFrame, relations: list[str] | None, most: int, scratch: Scratch) -> DataFrame:
    """a, near: a node's first `most` known neighbours, both ways, each with its least relation, as sorted items. Walked relations only, whatever is asked for."""
    kinds = [r for r in (relations or WALKED) if r in WALKED]
    place = F.array_position(F.array(*[F.lit(r) for r in _RELATIONS]), F.col("kind")) - 1
    e = edges.where(F.col("kind").isin(kinds) & (F.col("src") != F.col("dst"))).select("src", "dst", place.alias("r"))
    for end, n in (("src", "a"), ("dst", "b")):
        e = e.join(numbered.select(F.col("id").alias(end), F.col("n").alias(n), F.col("known").alias(f"{n}_known")), end)
    both = e.selectExpr("inline(array(struct(a as a, b as b, b_known as known, r as r), struct(b as a, a as b, a_known as known, r as r)))").where("known")
    items = both.groupBy("a", "b").agg(F.min("r").alias("r")).select("a", (F.col("b") * 4 + F.col("r")).alias("item"))
    first = items.withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy("item"))).where(F.col("rn") <= most)
    return scratch.keep(first.groupBy("a").agg(F.sort_array(F.collect_list("item")).alias("near")))


def _none(kind: str, name: str):
    return F.lit(None).cast(kind).alias(name)


def _hop(state: DataFrame, near: DataFrame, limit: int) -> DataFrame:
    """The state one hop on: a row for each seed with all it has seen, what it saw last (frontier) and that as items.

    A node's neighbours are sent to each block of seeds once, not to each seed, and met there; candidates are never shuffled.
    """
    asks = state.where(F.size("seen") < limit).select("block", "seed", F.explode("frontier").alias("a"))
    sent = asks.select("block", "a").distinct().join(near, "a")
    rows = state.select("block", _none("long", "a"), "seed", _none("array<long>", "near"), "seen")
    rows = rows.union(asks.select("block", "a", "seed", _none("array<long>", "near"), _none("array<long>", "seen")))
    rows = rows.union(sent.select("block", "a", _none("long", "seed"), "near", _none("array<long>", "seen")))
    rows = rows.repartition(tasks(state.sparkSession), "block")
    rows = rows.withColumn("near", F.first("near", ignorenulls=True).over(Window.partitionBy("block", "a"))).where(F.col("seed").isNotNull())
    met = rows.groupBy("block", "seed").agg(F.first("seen", ignorenulls=True).alias("seen"), F.flatten(F.collect_list("near")).alias("found"))
    known = F.flatten(F.transform("seen", lambda n: F.array(*[n * 4 + r for r in range(4)])))
    room = F.greatest(F.lit(limit) - F.size("seen"), F.lit(0))
    met = met.select("block", "seed", "seen", room.alias("room"), F.slice(F.sort_array(F.array_except("found", known)), 1, room * 4).alias("found"))
    least = F.filter("found", lambda x, i: (i == 0) | (F.shiftright(x, 2) != F.shiftright(F.get("found", i - 1), 2)))
    new = met.select("block", "seed", "seen", F.slice(least, 1, F.col("room")).alias("items"))
    new = new.withColumn("frontier", F.transform("items", lambda x: F.shiftright(x, 2)))
    return new.select("block", "seed", F.concat("seen", "frontier").alias("seen"), "frontier", "items")


def _named(levels: dict[int, DataFrame], numbered: DataFrame) -> DataFrame:
    """seed, id, relation, depth of the items of each level. A name, too, is sent to each block once."""
    rows = reduce(DataFrame.union, [s.select("block", "seed", F.explode("items").alias("item"), F.lit(d).alias("depth")) for d, s in levels.items()])
    rows = rows.withColumn("n", F.shiftright("item", 2))
    asked = rows.select("block", "n", _none("long", "seed")).union(rows.select("block", F.col("seed").alias("n"), "seed"))
    names = asked.groupBy("block", "n").agg(F.max("seed").alias("seed")).join(numbered.select("n", "id"), "n")
    rows = rows.select("block", "n", "seed", "item", "depth", _none("string", "id"))
    rows = rows.union(names.select("block", "n", "seed", _none("long", "item"), _none("int", "depth"), "id"))
    rows = rows.repartition(tasks(numbered.sparkSession), "block")
    rows = rows.withColumn("id", F.first("id", ignorenulls=True).over(Window.partitionBy("block", "n"))).where(F.col("seed").isNotNull())
    seed = F.first(F.when(F.col("depth").isNull(), F.col("id")), ignorenulls=True).over(Window.partitionBy("block", "seed"))
    relation = F.when(F.col("depth") > 0, F.get(F.array(*[F.lit(r) for r in _RELATIONS]), F.col("item").bitwiseAND(3).cast("int")))
    rows = rows.select(seed.alias("seed"), "id", relation.alias("relation"), "depth")
    return rows.where(F.col("depth").isNotNull())


def neighbourhood(seeds: DataFrame | None, edges: DataFrame, known: DataFrame, depth: int, limit: int | list[int], relations: list[str] | None = None, start: DataFrame | None = None, scratch: Scratch | None = None, since: int = 0) -> DataFrame:
    """seed, id, relation, depth: what lies within `depth` hops of each seed, the seed itself first.

    A hop takes nodes not seen before in order of id, each once with its least relation, until the seed has `limit` items with itself (a list: one limit for each hop).
    Only nodes of `known` (id) count. A walk that has seen s nodes takes limit - s more, and no more than s of a node's neighbours are seen, so each node's
    neighbours beyond the first `limit` are cut before any join: a hub costs no more than any other node, and the result is the same.
    start: an earlier result to go on from, instead of seeds (its greatest depth is the frontier). since: only rows of this depth or beyond it are named and returned.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    limits = limit if isinstance(limit, list) else [limit] * depth
    start = start if start is None else scratch.keep(start)
    numbered = _numbered(known, start, scratch)
    near = _near(edges, numbered, relations, max(limits, default=0), scratch)
    levels, at = {}, 0
    if start is None:
        n = seeds.select(F.col("seed").alias("id")).distinct().join(numbered.where("known"), "id")
        state = levels[0] = scratch.keep(n.select(_block("n"), F.col("n").alias("seed"), F.array("n").alias("seen"), F.array("n").alias("frontier"), F.array(F.col("n") * 4).alias("items")))
    else:
        at = start.agg(F.max("depth")).first()[0] or 0
        s = start.join(numbered.select(F.col("id").alias("seed"), F.col("n").alias("s")), "seed").join(numbered.select("id", "n"), "id").groupBy("s")
        s = s.agg(F.collect_list("n").alias("seen"), F.collect_list(F.when(F.col("depth") == at, F.col("n"))).alias("frontier"))
        state = scratch.keep(s.select(_block("s"), F.col("s").alias("seed"), "seen", "frontier"))
    for d, most in enumerate(limits[:depth], at + 1):
        state, wrote = scratch.counted(_hop(state, near, most), new=F.sum(F.size("items")))
        if not wrote["new"]:
            break
        levels[d] = state
    scratch.drop(near)
    rest = {d: s for d, s in levels.items() if d >= since}
    for d in levels.keys() - rest:
        if levels[d] is not state:
            scratch.drop(levels[d])
    if start is None:
        return _named(rest or {since: state.limit(0)}, numbered)
    start = start.where(F.col("depth") >= since)
    return start.unionByName(_named(rest, numbered)) if rest else start


def reach(seeds: DataFrame, steps: DataFrame, depth: int, fan_out: int | None = 512, scratch: Scratch | None = None) -> DataFrame:
    """seed, id, depth (least, from 1) of all that steps (a, b) lead to from each seed, the seed left out.

    fan_out: how many steps, in order of b, are followed from each node; None follows all.
    """
    scratch = scratch or Scratch(steps.sparkSession)
    view = steps.select("a", "b").where(F.col("a") != F.col("b")).distinct()
    if fan_out is not None:
        view = view.withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy("b"))).where(F.col("rn") <= fan_out).drop("rn")
    view = scratch.keep(view)
    level = scratch.keep(seeds.select("seed", F.col("id"), F.lit(0).alias("depth")).distinct())
    seen = level
    for d in range(1, depth + 1):
        new = level.select("seed", F.col("id").alias("a")).join(view, "a").select("seed", F.col("b").alias("id")).distinct()
        level, wrote = scratch.counted(new.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(d)))
        if not wrote["n"]:
            break
        seen = seen.unionByName(level)
    return seen.where(F.col("depth") > 0)


def test_impact(seeds: DataFrame, edges: DataFrame, now: DataFrame, depth: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """seed, id, depth: test methods that reach each seed (seed, id) through calls, production callers included on the way."""
    back = edges.where(F.col("kind") == "CALLS").select(F.col("dst").alias("a"), F.col("src").alias("b"))
    tests = now.where(F.col("is_test") & F.col("kind").isin("Method", "Function")).select("id").distinct()
    return reach(seeds, back, depth, scratch=scratch).join(tests, "id", "left_semi").select("seed", "id", "depth")


def changed_methods(files: DataFrame, edges: DataFrame, now: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """seed, id: methods that the named files (seed, id) contain, at any depth."""
    down = edges.where(F.col("kind") == "CONTAINS").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    methods = now.where(F.col("kind") == "Method").select("id").distinct()
    return reach(files, down, 32, fan_out=None, scratch=scratch).join(methods, "id", "left_semi").select("seed", "id")


def change_set(now: DataFrame, edges: DataFrame, files: list[str] = (), methods: list[str] = (), commit: str | None = None, kinds: tuple[str, ...] = ("Method",), scratch: Scratch | None = None) -> DataFrame:
    """seed, id: the methods of a change set of file paths, method ids and a commit's files, each once. Only nodes of `kinds` are methods."""
    able = now.where(F.col("kind").isin(*kinds)).select("id").distinct()
    by_path = now.where((F.col("kind") == "File") & F.col("path").isin(list(files))).select("id")
    by_commit = edges.where((F.col("kind") == "MODIFIES") & (F.col("src") == F.lit(commit))).select(F.col("dst").alias("id"))
    changed = by_path.union(by_commit).distinct().select(F.lit("change").alias("seed"), "id")
    inside = changed_methods(changed, edges, now, scratch).select("id")
    return inside.union(able.where(F.col("id").isin(list(methods)))).join(able, "id", "left_semi").distinct().select(F.lit("change").alias("seed"), "id")
