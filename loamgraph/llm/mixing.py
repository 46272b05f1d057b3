"""Mixing sources to target weights along a training curriculum."""

import base64
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from loamgraph.sources.tables import Scratch, spread

#: A public byte-level vocabulary as ranks, and the pattern by which texts are cut before it applies.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows of a source that one task adds up, about.
STRIPE = 50_000

_loaded: dict = {}


def _encoder(path: str):
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counts(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of each whole text; 0 for null and empty ones. The vocabulary must be readable at that path on every executor."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        e = _encoder(vocabulary)
        return pd.Series([0 if not isinstance(t, str) else len(e.encode_ordinary(t)) for t in texts], dtype="int64")

    return count(text)


def source_name(c: Column) -> Column:
    """Trimmed, lower case, dashes as underscores; null for null and blank."""
    return F.nullif(F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_")), F.lit(""))


def curriculum(schedules: Mapping[str, Sequence[tuple[float, float]]]) -> list[tuple[str, float, float, float, float, float, float]]:
    """Each source's schedule as pieces: source, t0, t1, weight at t0, weight at t1, integral up to t0, integral up to t1.

    A schedule is points (time in 0..1, relative weight), straight between them, constant before the first and after the last;
    it is scaled so that its integral is 1. A schedule without any weight counts as constant.
    """
    out = []
    for source, points in schedules.items():
        p = sorted((min(max(float(t), 0.0), 1.0), max(0.0, float(w))) for t, w in points)
        if not p or sum(w for _, w in p) == 0:
            p = [(0.0, 1.0)]
        p = ([(0.0, p[0][1])] if p[0][0] > 0 else []) + p + ([(1.0, p[-1][1])] if p[-1][0] < 1 else [])
        area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(p, p[1:]))
        if area <= 0:
            p, area = [(0.0, 1.0), (1.0, 1.0)], 1.0
        done = 0.0
        for (t0, w0), (t1, w1) in zip(p, p[1:]):
            step = (t1 - t0) * (w0 + w1) / 2 / area
            if step > 0:
                out.append((source, t0, t1, w0 / area, w1 / area, done, done + step))
            done += step
    return out


def supply(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens of each document, once; source is null where none is named."""
    d = documents.select("doc_id", "source", F.col("text").alias("doc_text")).where(F.col("doc_id").isNotNull())
    d = spread(d, "doc_id").select("doc_id", source_name(F.col("source")).alias("source"), token_counts(F.col("doc_text"), vocabulary).alias("n_tokens"))
    return d.groupBy("doc_id").agg(F.max_by("source", F.struct("n_tokens", "source")).alias("source"), F.max("n_tokens").alias("n_tokens"))


def demand(sizes: DataFrame, targets: DataFrame, budget: float | None = None) -> DataFrame:
    """Per target source: target_share, max_repeats, supply_tokens, demand_tokens (share of the total), granted_tokens, unmet_tokens.

    budget: tokens of the whole mixture. Without one, it is the largest total at which every source that has any tokens can
    meet its share within its repeats. A source gives at most its supply times its repeats; the rest of its demand is reported as unmet, never
    taken from another source. Targets spelled alike are added up, with the smaller number of repeats; a null share is 0, null repeats are 1.
    """
    t = targets.select(source_name(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("s"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("r"))
    t = t.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("s").alias("target_share"), F.min("r").alias("max_repeats"))
    have = sizes.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("supply_tokens"), F.count(F.lit(1)).alias("n_documents"))
    t = t.join(have, "source", "left").fillna(0, ["supply_tokens", "n_documents"])
    most = F.col("supply_tokens") * F.col("max_repeats")
    if budget is None:
        budget = t.where((most > 0) & (F.col("target_share") > 0)).agg(F.min(most / F.col("target_share"))).first()[0] or 0.0
    t = t.withColumn("demand_tokens", F.col("target_share") * F.lit(float(budget))).withColumn("granted_tokens", F.least(F.col("demand_tokens"), most.cast("double")))
    return t.withColumn("unmet_tokens", F.col("demand_tokens") - F.col("granted_tokens"))


def assign(documents: DataFrame, targets: DataFrame, schedules: Mapping[str, Sequence[tuple[float, float]]] | None = None, budget: float | None = None, vocabulary: str = VOCABULARY, seed: int = 0, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(uses, shares): every use of every document with its place in training, sorted by it, and what each source got.

    uses: doc_id, source, use_no (from 1), n_tokens, position (0..1). shares: the columns of `demand`, used_tokens, n_uses, actual_share, most_uses.

    The time-varying weight of each source is integrated to its cumulative token demand over training time; that is inverted at each document's place in
    its source's token count, which gives the document's position. A source that repeats runs through its documents again in the same order, so two
    uses of one are as far apart as can be. Documents are ordered by a hash of their id. Their running token sums are taken by stripes: sums within stripes of
    about STRIPE rows, added to the sums of the stripes before, so no task holds a whole source. The result is sorted by range partitions of
    position. A document belongs to the last, partial pass if the middle of its tokens does; so shares are met to within one document a source. Null or empty texts and
    sources that no target names are never used. Empty tables give empty results.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark)
    sizes = scratch.keep(supply(documents, vocabulary))
    plan = scratch.keep(demand(sizes, targets, budget))
    sizes = sizes.where(F.col("n_tokens") > 0)
    named = sizes.join(F.broadcast(plan.select("source", "n_documents", "supply_tokens", "granted_tokens", "max_repeats")), "source")
    # a place in 0..1 by hash; equal stripes of it hold about equally many rows
    place = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(float(2**53))).alias("place")
    rows = named.select("*", place).withColumn("stripe", F.floor(F.col("place") * F.ceil(F.col("n_documents") / STRIPE)).cast("long"))
    within = Window.partitionBy("source", "stripe").orderBy("place", "doc_id")
    rows = rows.withColumn("upto", F.sum("n_tokens").over(within))
    stripes = rows.groupBy("source", "stripe").agg(F.sum("n_tokens").alias("t"))
    before = stripes.withColumn("before", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    rows = rows.join(before, ["source", "stripe"]).withColumn("middle", F.col("before") + F.col("upto") - F.col("n_tokens") / 2)
    passes = F.least(F.col("max_repeats"), F.floor((F.col("granted_tokens") - F.col("middle")) / F.col("supply_tokens") + 1)).cast("int")
    rows = rows.withColumn("n_uses", F.greatest(passes, F.lit(0))).where(F.col("n_uses") > 0)
    uses = rows.select("doc_id", "source", "n_tokens", "middle", "supply_tokens", "granted_tokens", F.explode(F.sequence(F.lit(1), F.col("n_uses"))).alias("use_no"))
    share = ((F.col("use_no") - 1) * F.col("supply_tokens") + F.col("middle")) / F.col("granted_tokens")
    uses = uses.withColumn("c", F.least(F.lit(1.0), share))
    pieces = curriculum(schedules or {})
    if pieces:
        p = spark.createDataFrame(pieces, "source string, t0 double, t1 double, w0 double, w1 double, c0 double, c1 double")
        p = p.select(source_name(F.col("source")).alias("source"), F.struct("c1", "t0", "t1", "w0", "w1", "c0").alias("p")).groupBy("source").agg(F.sort_array(F.collect_list("p")).alias("ps"))
        uses = uses.join(F.broadcast(p), "source", "left")  # a piece per point of the given schedules
        piece = F.try_element_at(F.filter("ps", lambda x: (x["c1"] >= F.col("c")) | (x["c1"] >= 1 - 1e-12)), F.lit(1))
        uses = uses.withColumn("p", piece)
        slope = (F.col("p.w1") - F.col("p.w0")) / (F.col("p.t1") - F.col("p.t0"))
        need = F.greatest(F.col("c") - F.col("p.c0"), F.lit(0.0))
        root = F.sqrt(F.greatest(F.col("p.w0") * F.col("p.w0") + 2 * slope * need, F.lit(0.0)))
        # from w0*x + slope*x*x/2 = need, in the form that bears a slope of 0
        x = F.when(F.col("p.w0") + root > 0, 2 * need / (F.col("p.w0") + root)).otherwise(F.lit(0.0))
        position = F.when(F.col("p").isNull(), F.col("c")).otherwise(F.least(F.col("p.t0") + x, F.col("p.t1")))
    else:
        position = F.col("c")
    uses = scratch.keep(uses.select("doc_id", "source", F.col("use_no").cast("long").alias("use_no"), "n_tokens", position.alias("position")))
    used = uses.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.count(F.lit(1)).alias("n_uses"), F.max("use_no").alias("most_uses"))
    total = used.agg(F.sum("used_tokens")).first()[0] or 1
    shares = plan.join(used, "source", "left").fillna(0, ["used_tokens", "n_uses", "most_uses"]).withColumn("actual_share", F.col("used_tokens") / F.lit(total))
    return uses.orderBy("position", "source", "doc_id", "use_no"), shares
