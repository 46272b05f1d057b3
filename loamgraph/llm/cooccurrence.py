"""Items that appear together more often than chance would have it."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.sources.tables import Scratch, tasks

#: Baskets of more items are counted in another way, so that no basket emits all its pairs in one task.
LARGE_BASKET = 2_000
#: Different tails of one scope that one group works out, about.
TAILS = 4_000


def memberships(records: DataFrame, basket: str, item: str, scope) -> DataFrame:
    """scope, basket, item: distinct, without nulls. scope: a column over the records."""
    m = records.select(scope.alias("scope"), F.col(basket).alias("basket"), F.col(item).alias("item"))
    return m.where(F.col("scope").isNotNull() & F.col("basket").isNotNull() & F.col("item").isNotNull()).distinct()


def _pairs_within(lists: DataFrame, items: str) -> DataFrame:
    """scope, item_a, item_b for each pair of a sorted array of items."""
    x = lists.select("scope", items, F.posexplode(items).alias("pos", "item_a"))
    return x.select("scope", "item_a", F.explode(F.slice(items, F.col("pos") + 2, F.size(items))).alias("item_b"))


def pair_counts(m: DataFrame, min_pair: int, scratch: Scratch, large: int = LARGE_BASKET) -> DataFrame:
    """scope, item_a < item_b, n_ab >= min_pair: in how many baskets both are. Exact.

    An item in fewer than min_pair baskets can be in no such pair and is left out first. Baskets of up to `large` items
    emit their pairs, counted on the map side. Of the larger ones, let a scope have h. While h < min_pair, a pair that
    counts must share a smaller basket, so the larger ones are only looked up for pairs that do so, by joins on
    (basket, item). Only in scopes with more of them than that, their items are dealt to blocks and each pair
    of blocks is a task of its own.
    """
    often = m.groupBy("scope", "item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pair).select("scope", "item")
    m = scratch.keep(m.join(often, ["scope", "item"], "left_semi"))
    sizes = m.groupBy("scope", "basket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= 2)
    big = scratch.keep(sizes.where(F.col("size") > large))
    small = m.join(big, ["scope", "basket"], "left_anti") if big.count() else m
    lists = small.groupBy("scope", "basket").agg(F.sort_array(F.collect_list("item")).alias("items")).where(F.size("items") >= 2)
    counts = _pairs_within(lists, "items").groupBy("scope", "item_a", "item_b").agg(F.count(F.lit(1)).alias("n_ab"))
    if big.count() == 0:
        return counts.where(F.col("n_ab") >= min_pair)
    counts = scratch.keep(counts)
    per_scope = big.groupBy("scope").agg(F.count(F.lit(1)).alias("h"))
    few = per_scope.where(F.col("h") < min_pair)
    # scopes with few large baskets: look the candidates up
    candidates = counts.join(few, "scope").where(F.col("n_ab") + F.col("h") >= min_pair)
    inside = m.join(big.join(few, "scope", "left_semi").select("scope", "basket"), ["scope", "basket"], "left_semi")
    by_item = inside.groupBy("scope", "item").agg(F.collect_set("basket").alias("bs"))  # at most min_pair - 1 baskets each
    looked = (
        candidates.join(by_item.select("scope", F.col("item").alias("item_a"), F.col("bs").alias("ba")), ["scope", "item_a"], "left")
        .join(by_item.select("scope", F.col("item").alias("item_b"), F.col("bs").alias("bb")), ["scope", "item_b"], "left")
        .withColumn("n_ab", F.col("n_ab") + F.coalesce(F.size(F.array_intersect("ba", "bb")), F.lit(0)).cast("long"))
        .select("scope", "item_a", "item_b", "n_ab")
    )
    # scopes with many: blocks of items, one group for each pair of blocks
    many = per_scope.where(F.col("h") >= min_pair).select("scope")
    blocks = F.ceil(F.col("size") / (large / 2)).cast("int")
    wide = m.join(big.join(many, "scope", "left_semi"), ["scope", "basket"]).withColumn("k", blocks).withColumn("b", F.pmod(F.xxhash64("item"), F.col("k")).cast("int"))
    dealt = wide.select("scope", "basket", "item", "b", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    groups = dealt.groupBy("scope", "basket", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2")).agg(F.sort_array(F.collect_list(F.struct("item", "b"))).alias("xs"))
    pos = groups.select("scope", "b1", "b2", "xs", F.posexplode("xs").alias("pos", "x"))
    both = pos.select("scope", "b1", "b2", "x", F.explode(F.slice("xs", F.col("pos") + 2, F.size("xs"))).alias("y"))
    wide_counts = (
        both.where((F.col("b1") == F.col("b2")) | (F.col("x.b") != F.col("y.b")))
        .groupBy("scope", F.col("x.item").alias("item_a"), F.col("y.item").alias("item_b"))
        .agg(F.count(F.lit(1)).alias("n_ab"))
    )
    rest = counts.join(few.select("scope"), "scope", "left_anti")
    added = rest.unionByName(wide_counts).groupBy("scope", "item_a", "item_b").agg(F.sum("n_ab").alias("n_ab"))
    return looked.unionByName(added).where(F.col("n_ab") >= min_pair)


#: Distinct degrees or sizes of a scope that are fitted one by one; above, values within CLASS_WIDTH of one another are fitted as one class of their mean.
EXACT_CLASSES, CLASS_WIDTH = 400, 0.01


def classes_of(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and counts as they are, or, where there are many, in classes of log-spaced bounds: the fit's memory then no longer grows with the data.

    A class stands for values within CLASS_WIDTH of one another, and chances are about in proportion to values, so a chance is off by less than CLASS_WIDTH of itself.
    """
    if len(values) <= EXACT_CLASSES:
        return values.astype(float), counts.astype(float)
    at = np.where(values <= 1 / CLASS_WIDTH, values, 1 / CLASS_WIDTH + np.floor(np.log(np.maximum(values * CLASS_WIDTH, 1)) / math.log1p(CLASS_WIDTH))).astype(np.int64)
    _, at = np.unique(at, return_inverse=True)
    n = np.bincount(at, counts)
    return np.bincount(at, values * counts) / n, n


def fit_null(item_degrees: np.ndarray, item_counts: np.ndarray, sizes: np.ndarray, size_counts: np.ndarray, rounds: int = 500, tol: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """The bipartite configuration model: x per item degree and y per basket size with P(item in basket) = xy/(1+xy).

    Solved over classes of equal degree and equal size, by fixed-point steps, so that each item's expected number of
    baskets is its degree and each basket's expected number of items its size.
    """
    d, s = item_degrees.astype(float), sizes.astype(float)
    total = float((d * item_counts).sum())
    x, y = d / math.sqrt(total), s / math.sqrt(total)
    for _ in range(rounds):
        nx = d / np.maximum((size_counts * y / (1 + np.outer(x, y))).sum(1), 1e-300)
        ny = s / np.maximum((item_counts[:, None] * nx[:, None] / (1 + np.outer(nx, y))).sum(0), 1e-300)
        nx, ny = np.minimum(nx, 1e12), np.minimum(ny, 1e12)
        moved = max(np.max(np.abs(nx - x) / x), np.max(np.abs(ny - y) / y))
        x, y = nx, ny
        if moved < tol:
            break
    return x, y


def _sum_of_trials(p: np.ndarray, counts: np.ndarray, length: int, lf: np.ndarray) -> np.ndarray:
    """The first `length` chances of a sum of independent trials: a product of binomial polynomials, cut at that degree."""
    pmf = np.zeros(length)
    pmf[0] = 1.0
    for q, n in zip(p, counts):
        if q > 0:
            k = np.arange(min(n, length - 1) + 1)
            b = np.exp(lf[n] - lf[k] - lf[n - k] + k * math.log(q) + (n - k) * math.log1p(-q))
            pmf = np.convolve(pmf, b)[:length]
    return pmf


def tail(p: np.ndarray, counts: np.ndarray, least: int, lf: np.ndarray | None = None) -> float:
    """P(X >= least) for a sum of independent trials, counts[i] of them with chance p[i]: the Poisson-binomial tail.

    One minus the chances below `least`, exact up to rounding; where that leaves less than 1e-9, the tail is summed
    from `least` on instead, until its terms vanish. lf: logarithms of factorials up to the largest count.
    """
    p, counts = np.clip(p, 0.0, 1.0 - 1e-15), counts.astype(np.int64)
    trials = int(counts.sum())
    if least <= 0:
        return 1.0
    if least > trials:
        return 0.0
    if lf is None:
        lf = log_factorials(int(counts.max()))
    rest = 1 - float(_sum_of_trials(p, counts, least, lf).sum())
    length = least + 20
    while rest <= 1e-9:
        length = min(trials + 1, length * 2)
        pmf = _sum_of_trials(p, counts, length, lf)
        above = float(pmf[least:].sum())
        if length == trials + 1 or pmf[-1] <= 1e-12 * above:
            return above
    return min(1.0, rest)


def _many_sums(q: np.ndarray, counts: np.ndarray, length: int, lf: np.ndarray) -> np.ndarray:
    """_sum_of_trials for many rows of chances at once."""
    pmf = np.zeros((len(q), length))
    pmf[:, 0] = 1.0
    lq, lr = np.log(np.maximum(q, 1e-300)), np.log1p(-q)
    for j, n in enumerate(counts):
        k = np.arange(min(n, length - 1) + 1)
        b = np.exp((lf[n] - lf[k] - lf[n - k])[None, :] + lq[:, j : j + 1] * k + lr[:, j : j + 1] * (n - k))
        new = np.zeros_like(pmf)
        for t in k:
            new[:, t:] += b[:, t : t + 1] * pmf[:, : length - t]
        pmf = new
    return pmf


def tails(q: np.ndarray, counts: np.ndarray, least: np.ndarray, lf: np.ndarray) -> np.ndarray:
    """`tail` of many rows: rows of like thresholds share their arrays, rows that need care go one by one."""
    q = np.clip(q, 0.0, 1.0 - 1e-15)
    out = np.empty(len(q))
    size = np.ceil(np.log2(np.maximum(least, 1))).astype(int)
    for z in np.unique(size):
        rows = np.flatnonzero(size == z)
        for i in range(0, len(rows), 1000):
            at = rows[i : i + 1000]
            reach = np.arange(int(least[at].max()))
            rest = 1 - np.where(reach[None, :] < least[at][:, None], _many_sums(q[at], counts, max(1, len(reach)), lf), 0).sum(1)
            out[at] = np.minimum(1.0, rest)
            far = at[rest <= 1e-9]
            if len(far):
                reach = np.arange(int(least[far].max()) + 40)
                pmf = _many_sums(q[far], counts, len(reach), lf)
                above = np.where(reach[None, :] >= least[far][:, None], pmf, 0).sum(1)
                done = (pmf[:, -1] <= 1e-12 * above) & (above > 0)
                out[far] = above
                for r in far[~done]:
                    out[r] = tail(q[r], counts, int(least[r]), lf)
    return out


def log_factorials(top: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top + 1, dtype=float)))])


def _fit_of_scope(h: pd.DataFrame) -> pd.DataFrame:
    """One histogram row per class in; the scope's fitted values as arrays out: x of every degree, y and number of every class of sizes."""
    it, ba = h[h["side"] == "item"].sort_values("v"), h[h["side"] == "basket"].sort_values("v")
    degrees = it["v"].to_numpy()
    d, dc = classes_of(degrees, it["c"].to_numpy())
    s, sc = classes_of(ba["v"].to_numpy(), ba["c"].to_numpy())
    x, y = fit_null(d, dc, s, sc)
    if len(d) != len(degrees):
        # every degree's own x, for the classes' y
        x = np.interp(degrees, d, x / d) * degrees
        for _ in range(20):
            x = degrees / np.concatenate([(sc * y / (1 + np.outer(part, y))).sum(1) for part in np.array_split(x, 1 + len(x) // 1000)])
    return pd.DataFrame([(h["scope"].iat[0], degrees.tolist(), x.tolist(), y.tolist(), np.round(sc).astype(np.int64).tolist())], columns=["scope", "degrees", "x", "y", "counts"])


def _tails_of_part(kinds: pd.DataFrame) -> pd.DataFrame:
    """Distinct (n_a, n_b, n_ab) of one scope, each with that scope's fit."""
    first = kinds.iloc[0]
    y, c = np.asarray(first["y"], float), np.asarray(first["counts"], np.int64)
    xs, lf = dict(zip(first["degrees"], first["x"])), log_factorials(int(c.max()))
    x = np.array([[xs[a], xs[b]] for a, b in zip(kinds["n_a"], kinds["n_b"])])
    p, r = x[:, :1] * y[None, :], x[:, 1:] * y[None, :]
    q = p / (1 + p) * (r / (1 + r))
    out = kinds[["scope", "n_a", "n_b", "n_ab", "n_pairs"]].copy()
    out["expected"] = (q * c).sum(1)
    out["p_value"] = tails(q, c, kinds["n_ab"].to_numpy(), lf)
    return out


def surprising_pairs(m: DataFrame, min_pair: int = 2, scratch: Scratch | None = None, large: int = LARGE_BASKET) -> DataFrame:
    """How often each pair of items shares a basket, and how far beyond chance.

    m: scope, basket, item as made by `memberships`; each scope (a repository) is a world of its own, and a pair
    lies in one scope. Columns: scope, item_a < item_b, n_ab, n_a, n_b, n (baskets of the scope), lift (n_ab*n/(n_a*n_b)),
    expected, p_value, q_value. Pairs with n_ab >= min_pair, all of them; counts are exact.

    Null: a bipartite configuration model fitted per scope, honouring each item's frequency and each basket's size.
    It is fitted over histograms: two items of equal degree have equal chances, so its input and the
    number of different tails depend on the number of distinct degrees, not of rows. p_value: Poisson-binomial
    tail P(X >= n_ab). q_value: Benjamini-Hochberg over all pairs of the scope's items, those that share no basket
    included; with min_pair above 1 the pairs left out take no rank, so it is then an upper bound. Nulls link nothing, repeated rows count once, an empty table gives an empty result.
    """
    scratch = scratch or Scratch(m.sparkSession)
    m = scratch.keep(m.select("scope", "basket", "item"))
    degree = scratch.keep(m.groupBy("scope", "item").agg(F.count(F.lit(1)).alias("deg")))
    size = scratch.keep(m.groupBy("scope", "basket").agg(F.count(F.lit(1)).alias("size")))
    worlds = size.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).join(degree.groupBy("scope").agg(F.count(F.lit(1)).alias("n_items")), "scope")
    pairs = pair_counts(m, min_pair, scratch, large)
    pairs = (
        pairs.join(degree.select("scope", F.col("item").alias("item_a"), F.col("deg").alias("n_a")), ["scope", "item_a"])
        .join(degree.select("scope", F.col("item").alias("item_b"), F.col("deg").alias("n_b")), ["scope", "item_b"])
        .join(worlds, "scope")
    )
    pairs = scratch.keep(pairs)
    hist = (
        degree.groupBy("scope", F.lit("item").alias("side"), F.col("deg").alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
        .unionByName(size.groupBy("scope", F.lit("basket").alias("side"), F.col("size").alias("v")).agg(F.count(F.lit(1)).alias("c")))
    )
    # a tail depends on the unordered degrees and the count; a scope's tails are dealt over parts of about TAILS
    lo, hi = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    kinds = pairs.groupBy("scope", lo.alias("n_a"), hi.alias("n_b"), "n_ab").agg(F.count(F.lit(1)).alias("n_pairs"))
    kinds = scratch.keep(kinds)
    parts = kinds.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / TAILS).alias("parts"))
    kinds = scratch.keep(kinds.join(parts, "scope").withColumn("part", F.pmod(F.xxhash64("n_a", "n_b", "n_ab"), F.col("parts")).cast("int")).drop("parts"))
    # the optimiser would join these small groups to one task
    parallel = tasks(m.sparkSession)
    fits = hist.repartition(parallel, "scope").groupBy("scope").applyInPandas(_fit_of_scope, "scope string, degrees array<long>, x array<double>, y array<double>, counts array<long>")
    fits = scratch.keep(fits)
    placed = scratch.keep(kinds.select("scope", "part").distinct().join(fits, "scope"))
    tails = kinds.repartition(parallel, "scope", "part").groupBy("scope", "part").cogroup(placed.repartition(parallel, "scope", "part").groupBy("scope", "part"))
    chances = scratch.keep(
        tails.applyInPandas(
            lambda k, f: _tails_of_part(k.assign(**{c: [f[c].iat[0]] * len(k) for c in ("degrees", "x", "y", "counts")})),
            "scope string, n_a long, n_b long, n_ab long, n_pairs long, expected double, p_value double",
        )
    )
    q = false_discovery(chances, worlds)
    return (
        pairs.withColumns({"lo": lo, "hi": hi})
        .join(q.select("scope", F.col("n_a").alias("lo"), F.col("n_b").alias("hi"), "n_ab", "expected", "p_value", "q_value"), ["scope", "lo", "hi", "n_ab"])
        .select("scope", "item_a", "item_b", "n_ab", "n_a", "n_b", "n", (F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("lift"), "expected", "p_value", "q_value")
    )


def false_discovery(chances: DataFrame, worlds: DataFrame, buckets: int = 2048) -> DataFrame:
    """Adds q_value: Benjamini-Hochberg steps within each scope.

    Ranks come from counts per bucket of log p and ranks inside a bucket, so no window holds a whole scope.
    """
    lg = F.least(F.lit(buckets - 1), F.floor(-F.log10(F.greatest("p_value", F.lit(1e-300))) * (buckets / 300.0))).cast("int")
    c = chances.withColumn("bucket", F.lit(buckets - 1) - lg)  # ascending with p
    per = c.groupBy("scope", "bucket").agg(F.sum("n_pairs").alias("n"))
    before = per.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("scope").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("scope", "bucket").orderBy("p_value")
    tests = F.col("n_items") * (F.col("n_items") - 1) / 2
    ranked = c.join(before.drop("n"), ["scope", "bucket"]).join(worlds.select("scope", "n_items"), "scope")
    ranked = ranked.withColumn("raw", F.least(F.lit(1.0), F.col("p_value") * tests / (F.col("ahead") + F.sum("n_pairs").over(w))))
    least = ranked.groupBy("scope", "bucket").agg(F.min("raw").alias("least"))
    later = least.withColumn("later", F.min("least").over(Window.partitionBy("scope").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.min("raw").over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    return ranked.withColumn("in_bucket", inside).join(later.select("scope", "bucket", "later"), ["scope", "bucket"]).withColumn("q_value", F.least("in_bucket", F.coalesce("later", F.lit(1.0))))
