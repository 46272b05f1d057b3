"""The most similar vectors of every vector: NN-descent by joins, and greedy search in the graph that it builds."""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.sources.tables import Scratch, tasks

#: Neighbours a node keeps in the graph, more than are asked for; trees of the first graph, and rows a leaf should have.
KEEP, TREES, LEAF = 16, 3, 1024
#: Trees are fitted on at most so many vectors, the first by a hash of their id; levels they may have. Deeper cuts use common hyperplanes.
TREE_SAMPLE, TREE_LEVELS = 20_000, 10
#: A leaf of more rows than this is dealt to parts of about half as many.
LARGEST_LEAF = 4096
#: Rounds of neighbours of neighbours at most, and the share of changed links below which it ends.
ROUNDS, SETTLED = 8, 0.002
#: Directions that agree in steps of 1/GRID on every axis are one node; so many of its members, the first by key, are compared one by one. Nodes of more rows than HOT are joined in parts.
GRID, MEMBERS, HOT = 32_768, 32, 20_000

_LINKS = "nid long, nb array<long>, cos array<float>, fresh array<boolean>"


def usable(vectors: DataFrame, key: str, vector: str, scope: str | None, dimension: int) -> DataFrame:
    """scope, key, v: one row per key whose vector has `dimension` finite values, not all zero.

    Of several vectors under one key the smallest counts; rows that repeat are one. A null scope is a scope of its own.
    """
    v = F.col(vector)
    fine = (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select((F.col(scope) if scope else F.lit(None)).cast("string").alias("scope"), F.col(key).alias("key"), v.alias("v")).where(F.col("key").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.groupBy("scope", "key").agg(F.min("v").alias("v")).withColumn("scope", F.coalesce("scope", F.lit("")))


# ------------------------------------------------------------------ arrays in and out of Arrow


def _whole(column):
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _matrix(column, dtype=np.float32) -> np.ndarray:
    """Binary values of equal length as rows of numbers."""
    column = _whole(column)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if not len(column):
        return np.empty((0, 1), dtype)
    if column.type != pa.binary():
        column = column.cast(pa.binary())
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(dtype).reshape(len(column), -1)


def _blobs(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m)
    width = m.shape[1] * m.itemsize
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.arange(0, (len(m) + 1) * width, width, dtype=np.int32)), pa.py_buffer(m)])


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a list column."""
    column = _whole(column)
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(np.asarray(column.offsets))


def _numbers(column) -> np.ndarray:
    return _whole(column).to_numpy(zero_copy_only=False)


def _units(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)  # so that neither very short nor very long vectors leave the range
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _best(a: np.ndarray, b: np.ndarray, cos: np.ndarray, old: np.ndarray, keep: int) -> pa.Table:
    """Per a the `keep` best distinct b as lists; fresh tells those that no old list had."""
    order = np.lexsort((~old, b, a))
    a, b, cos, old = a[order], b[order], cos[order], old[order]
    once = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.empty(0, bool)
    a, b, cos, old = a[once], b[once], cos[once], old[once]
    order = np.lexsort((b, -cos, a))
    a, b, cos, old = a[order], b[order], cos[order], old[order]
    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.empty(0, int)
    place = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    top = place < keep
    ends = pa.array(np.append(0, np.cumsum(np.add.reduceat(top, starts, dtype=np.int64))).astype(np.int32) if len(a) else np.zeros(1, np.int32))
    parts = [pa.ListArray.from_arrays(ends, pa.array(x[top])) for x in (b, cos.astype(np.float32), ~old)]
    return pa.table({"nid": pa.array(a[starts], pa.int64()), "nb": parts[0], "cos": parts[1], "fresh": parts[2]})


class Trees:
    """Random-projection trees as level-wise arrays of hyperplanes, and common hyperplanes for levels below."""

    def __init__(self, sample: np.ndarray, trees: int, levels: int, more: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.levels, self.more, self.trees = levels, more, trees
        dim = sample.shape[1]
        self.planes = rng.standard_normal((trees, (1 << levels) - 1, dim)).astype(np.float32)
        self.offsets = np.zeros((trees, (1 << levels) - 1), np.float32)
        self.common = rng.standard_normal((trees, more, dim)).astype(np.float32)
        for t in range(trees):
            at = np.zeros(len(sample), int)
            for level in range(levels):
                base = (1 << level) - 1
                for node in np.unique(at):
                    rows = np.flatnonzero(at == node)
                    if len(rows) > 1:
                        # between two of its vectors, shifted to the median
                        a, b = sample[rng.choice(rows)], sample[rng.choice(rows)]
                        if np.any(a != b):
                            self.planes[t, base + node] = a - b
                        self.offsets[t, base + node] = np.median(sample[rows] @ self.planes[t, base + node])
                side = np.einsum("ij,ij->i", sample, self.planes[t, base + at]) > self.offsets[t, base + at]
                at = at * 2 + side

    def leaves(self, v: np.ndarray, tree: int) -> np.ndarray:
        at = np.zeros(len(v), np.int64)
        for level in range(self.levels):
            base = (1 << level) - 1
            at = at * 2 + (np.einsum("ij,ij->i", v, self.planes[tree, base + at]) > self.offsets[tree, base + at])
        for p in self.common[tree]:
            at = at * 2 + (v @ p > 0)
        return at


class Graph:
    """nodes: nid, scope, u (unit vector, bytes of floats), leaf, blk; links: nid, nb, cos, fresh; coded: adds u and leaf to rows of nid, scope, raw."""

    def __init__(self, nodes: DataFrame, links: DataFrame, coded):
        self.nodes, self.links, self.coded = nodes, links, coded


def folded(vectors: DataFrame, key: str, vector: str, scope: str | None, dimension: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, type]:
    """(rows, classes, type of number): rows scope, key, raw, nid; classes nid, scope, members (key, raw), n.

    Vectors of one direction, equal or rescaled copies, become one node whose id is a hash of the scope and of the direction in steps of 1/GRID: no join
    is needed to find it. A class keeps its first MEMBERS keys with their vectors, and its number of rows; row limits apply before the shuffle, so a third of all rows in one class is no hot spot.
    """
    u = usable(vectors, key, vector, scope, dimension)
    dtype = np.float64 if dict(u.dtypes)["v"] == "array<double>" else np.float32
    kind = dict(u.dtypes)["key"]

    def pack(batches):
        for b in batches:
            if b.num_rows:
                m = _lists(b["v"])[0].astype(dtype).reshape(b.num_rows, -1)
                steps = np.round(_units(m) * GRID).astype(np.int32)
                ids = [xxhash.xxh64_intdigest(s.tobytes(), seed=xxhash.xxh32_intdigest(p)) for s, p in zip(steps, b["scope"].to_pylist())]
                yield pa.RecordBatch.from_arrays([b["scope"], b["key"], _blobs(m), pa.array(np.array(ids, np.uint64).view(np.int64))], ["scope", "key", "raw", "nid"])

    rows = scratch.keep(u.select("scope", "key", "v").mapInArrow(pack, f"scope string, key {kind}, raw binary, nid long"))
    w = Window.partitionBy("nid").orderBy("key")
    heads = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= MEMBERS)
    classes = heads.groupBy("nid").agg(F.min("scope").alias("scope"), F.sort_array(F.collect_list(F.struct("key", "raw"))).alias("members"))
    counts = rows.groupBy("nid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MEMBERS)
    classes = classes.join(counts, "nid", "left").withColumn("n", F.coalesce("n", F.size("members").cast("long")))
    return rows, scratch.keep(classes), dtype


def _within(t: pa.Table) -> pa.Table:
    """All of one leaf's part against each other."""
    ids, m = _numbers(t["nid"]), _matrix(t["u"])
    n = len(ids)
    if n < 2:
        none = np.empty(0, np.int64)
        return _best(none, none, np.empty(0, np.float32), np.empty(0, bool), KEEP)
    s = m @ m.T
    np.fill_diagonal(s, -2)
    k = min(KEEP, n - 1)
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(n), k)
    return _best(ids[rows], ids[best.ravel()], s[rows, best.ravel()], np.zeros(n * k, bool), KEEP)


def _descend(near: pa.Table, vectors: pa.Table) -> pa.Table:
    """near: the fresh (gn) and other (go) general neighbours of one block's nodes; vectors: id, u and the worst kept cosine of every neighbour named there.

    Pairs of a fresh neighbour with any other neighbour of the same node are compared, each once in a block.
    """
    none = np.empty(0, np.int64)
    ids = _numbers(vectors["id"])
    order = np.argsort(ids)
    ids = ids[order]
    pairs = []
    (gn, ln), (go, lo) = _lists(near["gn"]), _lists(near["go"])
    gn, go = np.searchsorted(ids, gn), np.searchsorted(ids, go)
    an, ao = np.cumsum(ln) - ln, np.cumsum(lo) - lo
    for i in range(near.num_rows):
        new = np.unique(gn[an[i] : an[i] + ln[i]])
        every = np.unique(np.concatenate([new, go[ao[i] : ao[i] + lo[i]]]))
        a, b = np.repeat(new, len(every)), np.tile(every, len(new))
        pairs.append(np.minimum(a, b) * len(ids) + np.maximum(a, b))
    flat = np.unique(np.concatenate(pairs)) if pairs else none
    a, b = flat // max(1, len(ids)), flat % max(1, len(ids))
    a, b = a[a != b], b[a != b]
    if not len(a):
        return _best(none, none, np.empty(0, np.float32), np.empty(0, bool), KEEP)
    m, worst = _matrix(vectors["u"])[order], _numbers(vectors["worst"])[order]
    s = np.concatenate([np.einsum("ij,ij->i", m[a[i : i + 50_000]], m[b[i : i + 50_000]]) for i in range(0, len(a), 50_000)])
    one, two = s > worst[a], s > worst[b]
    x, y, c = np.concatenate([a[one], b[two]]), np.concatenate([b[one], a[two]]), np.concatenate([s[one], s[two]])
    return _best(ids[x], ids[y], c, np.zeros(len(x), bool), KEEP)


def _merge(lists: DataFrame) -> DataFrame:
    """One list per node from several: distinct neighbours, the best KEEP of them. fresh in: false marks the earlier list. Rows of a node lie together in a sorted part."""

    def run(batches):
        held = None
        for b in batches:
            nb, n = _lists(b["nb"])
            flat = [np.repeat(_numbers(b["nid"]), n), nb, _lists(b["cos"])[0], ~_lists(b["fresh"])[0].astype(bool)]
            flat = flat if held is None else [np.concatenate(p) for p in zip(held, flat)]
            if not len(flat[0]):
                continue
            cut = np.searchsorted(flat[0], flat[0][-1])  # the last node may go on in the next batch
            if cut:
                yield from _best(*[x[:cut] for x in flat], KEEP).to_batches()
            held = [x[cut:] for x in flat]
        if held is not None and len(held[0]):
            yield from _best(*held, KEEP).to_batches()

    return lists.repartition(tasks(lists.sparkSession), "nid").sortWithinPartitions("nid").mapInArrow(run, _LINKS)


def build(units: DataFrame, scratch: Scratch, dtype: type = np.float32, rounds: int = ROUNDS) -> Graph:
    """The neighbour graph. units: nid, scope, raw (bytes of numbers), one row per direction of a scope as made by `folded`.

    First links come from random-projection trees: each scope's leaves hold about LEAF rows, larger leaves are dealt to parts,
    and all rows of a part are compared. Then, round by round, the neighbours of each node, both ways, are compared with one another if one of the two is
    new to the node, and each keeps its best. A round is done by blocks of nearby nodes, so a block needs each vector once, and by joins; incoming links
    are cut at the best KEEP of a node before they are gathered, so a node that is everybody's neighbour is no hot spot. Nodes without a new
    neighbour take no part in a round.
    """
    spark = units.sparkSession
    sizes = scratch.keep(units.groupBy("scope").agg(F.count(F.lit(1)).alias("n")))
    top = sizes.agg(F.max("n")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(top, 1) / LEAF)))
    levels = min(depth, TREE_LEVELS)
    sample = [r["raw"] for r in units.orderBy(F.xxhash64("nid")).select("raw").limit(TREE_SAMPLE).collect()]  # bounded
    m = np.stack([np.frombuffer(x, dtype) for x in sample]) if sample else np.ones((1, 1), dtype)
    shared = spark.sparkContext.broadcast(Trees(_units(m).astype(np.float32), TREES, levels, depth - levels))

    def leaves(batches):
        t = shared.value
        for b in batches:
            if b.num_rows:
                m = _units(_matrix(b["raw"], dtype)).astype(np.float32)
                codes = np.stack([t.leaves(m, i) for i in range(t.trees)], axis=1)
                ends = pa.array(np.arange(0, codes.size + 1, t.trees, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b["nid"], b["scope"], _blobs(m), pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))], ["nid", "scope", "u", "codes"])

    # a smaller scope uses fewer levels of the same trees
    own = F.least(F.lit(depth), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF)))).cast("int")
    cuts = F.broadcast(sizes.select("scope", (F.lit(depth) - own).alias("cut")))  # one row per scope

    def coded(rows: DataFrame) -> DataFrame:
        c = rows.select("nid", "scope", "raw").mapInArrow(leaves, "nid long, scope string, u binary, codes array<long>").join(cuts, "scope")
        c = c.withColumn("codes", F.expr("transform(codes, c -> shiftright(c, cut))")).drop("cut")
        return c.withColumn("leaf", F.xxhash64("scope", F.element_at("codes", 1)))

    nodes = scratch.keep(coded(units))
    parallel = tasks(spark)
    tree = F.posexplode("codes").alias("tree", "code")
    place = F.xxhash64("scope", "tree", "code").alias("place")
    large = nodes.select("scope", tree).groupBy(place).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGEST_LEAF)
    parts = F.coalesce(F.ceil(F.col("n") * 2 / LARGEST_LEAF), F.lit(1))
    placed = nodes.select("nid", "scope", "u", tree).select("nid", "u", "tree", place).join(large, "place", "left").withColumn("part", F.pmod(F.xxhash64("nid", "tree"), parts))
    first = placed.select("place", "part", "nid", "u").repartition(parallel, "place", "part").groupBy("place", "part").applyInArrow(_within, _LINKS)
    links, seen = scratch.counted(_merge(first), moved=F.sum(F.size(F.filter("fresh", lambda x: x))))
    # blocks of a hot leaf are dealt too
    blocks = nodes.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGEST_LEAF)
    blk = F.xxhash64("leaf", F.pmod(F.xxhash64("nid"), F.coalesce(F.ceil(F.col("n") * 2 / LARGEST_LEAF), F.lit(1))))
    nodes, count = scratch.counted(nodes.join(blocks, "leaf", "left").select("nid", "scope", "u", "leaf", blk.alias("blk")), replaces=nodes)
    for _ in range(rounds):
        if (seen["moved"] or 0) <= SETTLED * count["n"] * KEEP:
            break
        out = links.select("nid", F.explode(F.arrays_zip("nb", "cos", "fresh")).alias("x")).select("nid", "x.nb", "x.cos", "x.fresh")
        w = Window.partitionBy("nb").orderBy(F.desc("cos"), "nid")
        back = out.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= KEEP).select(F.col("nb").alias("nid"), F.col("nid").alias("nb"), "fresh")
        gather = lambda new: F.collect_list(F.when(F.col("fresh") if new else ~F.col("fresh"), F.col("nb")))
        general = out.select("nid", "nb", "fresh").union(back).groupBy("nid").agg(gather(True).alias("gn"), gather(False).alias("go")).where(F.size("gn") > 0)
        general = scratch.keep(general.join(nodes.select("nid", "blk"), "nid").select("blk", "gn", "go"))
        needed = general.select(F.col("blk").alias("to"), F.explode(F.concat("gn", "go")).alias("id")).distinct()
        worst = F.when(F.size("cos") >= KEEP, F.element_at("cos", -1)).otherwise(F.lit(-2.0)).cast("float")
        known = nodes.select(F.col("nid").alias("id"), "u").join(links.select(F.col("nid").alias("id"), worst.alias("worst")), "id")
        fetched = needed.join(known, "id").select("to", "id", "u", "worst")
        new = general.repartition(parallel, "blk").groupBy("blk").cogroup(fetched.repartition(parallel, "to").groupBy("to")).applyInArrow(_descend, _LINKS)
        before = links.select("nid", "nb", "cos", F.transform("nb", lambda x: F.lit(False)).alias("fresh"))
        merged, seen = scratch.counted(_merge(before.unionByName(new)), moved=F.sum(F.size(F.filter("fresh", lambda x: x))))
        scratch.drop(links)
        scratch.drop(general)
        links = merged
    return Graph(nodes, links, coded)


def nearest(vectors: DataFrame, key: str, vector: str, scope: str | None, k: int, dimension: int, scratch: Scratch | None = None) -> DataFrame:
    """scope, a, b, cos: the k most similar other vectors b of every a, within its scope; cos in double precision, ties to the smaller key.

    Copies, rescaled ones too, are put together first, so that a group of them is one node of the graph however large it is (`folded`). The graph gives KEEP
    candidates a node; cosines between all members of a node and those of its candidates are then computed in double precision. In a class of more than MEMBERS rows, whose members
    differ by less than two steps of 1/GRID on any axis, the members after the first MEMBERS take the first k keys of the class. Unusable vectors (see `usable`) take no
    part. Loss of accuracy: neighbours that no tree leaf and no round of neighbours' neighbours brought together; tests hold recall against brute
    force at 0.9 and more. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(vectors.sparkSession)
    rows, classes, dtype = folded(vectors, key, vector, scope, dimension, scratch)
    kind = dict(rows.dtypes)["key"]
    graph = build(classes.select("nid", "scope", F.element_at("members", 1)["raw"].alias("raw")), scratch, dtype)
    schema = f"scope string, a {kind}, b {kind}, cos double"

    def exact(near: pa.Table, theirs: pa.Table) -> pa.Table:
        ids = _numbers(theirs["id"])
        order = np.argsort(ids)
        ids = ids[order]
        members = _whole(theirs["members"])
        begin, size = np.asarray(members.offsets)[:-1] - np.asarray(members.offsets)[0], np.diff(np.asarray(members.offsets))
        flat = members.flatten()
        keys, m = flat.field("key"), _matrix(flat.field("raw"), dtype).astype(np.float64)
        m = m / np.abs(m).max(axis=1, keepdims=True) if len(m) else m
        norm = np.sqrt(np.einsum("ij,ij->i", m, m))
        rank = np.empty(len(keys), np.int64)
        rank[np.argsort(keys.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(keys))
        nb, n = _lists(near["nb"])
        rough, at = _lists(near["cos"])[0], np.cumsum(n) - n
        of = lambda i: np.arange(begin[order[i]], begin[order[i]] + size[order[i]])
        mine = np.searchsorted(ids, _numbers(near["nid"]))
        found = np.searchsorted(ids, nb)
        xa, xb, xc, xs = [], [], [], []
        scopes = near["scope"].to_pylist()
        for i, me in enumerate(mine):
            r = rough[at[i] : at[i] + n[i]]
            # the rough cosine of a node stands for members up to a step of 1/GRID away on every axis
            close = found[at[i] : at[i] + n[i]][r >= (r[k - 1] if len(r) >= k else -2) - 1e-3]
            own = of(me)
            cand = np.concatenate([own, *[of(c) for c in close]])
            # one by one, not by blocks: equal vectors then give equal numbers
            c = np.einsum("ij,kj->ik", m[own], m[cand]) / (norm[own][:, None] * norm[cand][None, :])
            for row, a in zip(c, own):
                best = np.lexsort((rank[cand], -row))
                best = best[cand[best] != a][:k]
                xa += [a] * len(best)
                xb.append(cand[best])
                xc.append(row[best])
                xs += [scopes[i]] * len(best)
        b = pa.array(np.concatenate(xb) if xb else np.empty(0, np.int64))
        return pa.table({"scope": pa.array(xs, pa.string()), "a": keys.take(pa.array(np.array(xa, np.int64))), "b": keys.take(b), "cos": pa.array(np.concatenate(xc) if xc else np.empty(0), pa.float64())})

    # a class that is alone in its scope has no links, but may have members
    blank = F.array()
    links = graph.nodes.select("nid", "scope", "blk").join(graph.links.select("nid", "nb", "cos"), "nid", "left")
    links = scratch.keep(links.withColumns({"nb": F.coalesce("nb", blank.cast("array<long>")), "cos": F.coalesce("cos", blank.cast("array<float>"))}))
    needed = links.select(F.col("blk").alias("to"), F.explode(F.concat("nb", F.array("nid"))).alias("id")).distinct()
    fetched = needed.join(classes.select(F.col("nid").alias("id"), "members"), "id").select("to", "id", "members")
    parallel = tasks(rows.sparkSession)
    full = links.repartition(parallel, "blk").groupBy("blk").cogroup(fetched.repartition(parallel, "to").groupBy("to")).applyInArrow(exact, schema)
    big = classes.where(F.col("n") > MEMBERS)
    if not big.limit(1).count():
        return full
    # the later members of large classes; very large ones are joined in parts
    hot = scratch.keep(big.where(F.col("n") > HOT).select("nid", F.ceil(F.col("n") / HOT).cast("int").alias("salts")))  # at most one per HOT rows
    heads = big.select("nid", F.slice("members", 1, k).alias("heads"), F.element_at("members", -1)["key"].alias("last")).join(F.broadcast(hot), "nid", "left")
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    later = rows.join(F.broadcast(hot), "nid", "left").withColumn("salt", F.pmod(F.xxhash64("key"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    later = later.join(heads, ["nid", "salt"]).where(F.col("key") > F.col("last")).select("scope", F.col("key").alias("a"), "raw", F.explode("heads").alias("h"))

    def against(batches):
        for b in batches:
            if b.num_rows:
                x, y = _matrix(b["raw"], dtype).astype(np.float64), _matrix(b["other"], dtype).astype(np.float64)
                c = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
                yield pa.RecordBatch.from_arrays([b["scope"], b["a"], b["b"], pa.array(c)], ["scope", "a", "b", "cos"])

    later = later.select("scope", "a", F.col("h.key").alias("b"), "raw", F.col("h.raw").alias("other")).mapInArrow(against, schema)
    return full.unionByName(later)


def close_pairs(near: DataFrame, least: float) -> DataFrame:
    """a < b, cos: pairs of which one is among the other's nearest and whose cosine is at least `least`, once each."""
    p = near.where(F.col("cos") >= least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cos")
    return p.groupBy("a", "b").agg(F.max("cos").alias("cos"))


def search(graph: Graph, queries: DataFrame, k: int, beam: int = 48, expand: int = 8, entries: int = 24, scratch: Scratch | None = None) -> DataFrame:
    """qid, nid, cos, rank: the k best nodes for each query (qid, scope, raw) by greedy search in the graph.

    Each query starts from `entries` nodes of its own leaf in the first tree and a few of its whole scope. A round expands its best `expand` nodes that were not yet,
    by joins with links and vectors, and keeps the best `beam`; it ends when no query has any left to expand among them. All queries advance together.
    """
    scratch = scratch or Scratch(queries.sparkSession)
    nodes, links = graph.nodes, graph.links
    q = scratch.keep(graph.coded(queries.withColumnRenamed("qid", "nid")).select(F.col("nid").alias("qid"), "scope", F.col("u").alias("qu"), "leaf"))

    def score(batches):
        for b in batches:
            if b.num_rows:
                c = np.einsum("ij,ij->i", _matrix(b["qu"]).astype(np.float64), _matrix(b["u"]).astype(np.float64))
                yield pa.RecordBatch.from_arrays([b["qid"], b["nid"], pa.array(c)], ["qid", "nid", "cos"])

    scored = lambda pairs: pairs.select("qid", "nid", "qu", "u").mapInArrow(score, "qid long, nid long, cos double").withColumn("done", F.lit(False))
    shown = lambda by, n: nodes.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64("nid")))).where(F.col("rn") <= n).select(by, "nid")
    begin = q.join(shown("leaf", entries), "leaf").select("qid", "nid").union(q.join(shown("scope", 4), "scope").select("qid", "nid")).distinct()
    state = scratch.keep(scored(begin.join(q.select("qid", "qu"), "qid").join(nodes.select("nid", "u"), "nid")))
    order = Window.partitionBy("qid").orderBy(F.desc("cos"), "nid")
    while True:
        turn = Window.partitionBy("qid", "done").orderBy(F.desc("cos"), "nid")
        marked, seen = scratch.counted(state.withColumn("now", ~F.col("done") & (F.row_number().over(turn) <= expand)), now=F.count_if("now"))
        if not seen["now"]:
            break
        found = marked.where("now").join(links.select("nid", F.explode("nb").alias("nb")), "nid").select("qid", F.col("nb").alias("nid")).distinct().join(marked.select("qid", "nid"), ["qid", "nid"], "left_anti")
        new = scored(found.join(q.select("qid", "qu"), "qid").join(nodes.select("nid", "u"), "nid"))
        after = marked.select("qid", "nid", "cos", (F.col("done") | F.col("now")).alias("done")).unionByName(new)
        state = scratch.keep(after.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= beam).drop("rn"), replaces=state)
        scratch.drop(marked)
    return state.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).select("qid", "nid", "cos", F.col("rn").alias("rank"))
