"""Evaluation texts inside training texts."""

import math
from collections import defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.texts import words
from loamgraph.sources.tables import spread

#: A leak is a passage of so many successive words of an item.
PASSAGE = 16
#: Words in a shingle. A few words of a passage may be changed, so shingles are shorter than the usual five.
SHINGLE = 3
#: Signature length, step of the items' passages in words, and the share of a passage's shingles that must be in a window.
PERMUTATIONS, STEP, CONTAINED = 48, 4, 0.5
#: Window sizes (shingles) by which the corpus side is partitioned: the upper ends of the partitions.
SIZES = (8, 16, 24, 32)
#: In a verified passage, the share of words that stand in the text, and the largest gap between two matching stretches.
COVERED, GAP = 0.8, 6
#: Up to so many signature values of the items (8 bytes each) are sent to every task; beyond, values are joined by shuffle.
BROADCAST_KEYS = 4_000_000

_rng = np.random.default_rng(20240801)
_MUL = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_TAGS = np.arange(PERMUTATIONS, dtype=np.uint64)


def _word_ids(tokens: list[str], cache: dict[str, int]) -> np.ndarray:
    out = np.empty(len(tokens), np.uint64)
    for i, w in enumerate(tokens):
        v = cache.get(w)
        if v is None:
            v = cache[w] = xxhash.xxh64_intdigest(w)
        out[i] = v
    return out


def shingles(ids: np.ndarray) -> np.ndarray:
    """One hash per run of SHINGLE words."""
    n = len(ids) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            h = (h ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def _permuted(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = h[:, None] * _MUL[None, :] + _ADD[None, :]
        return v ^ (v >> np.uint64(31))


def _keys(mins: np.ndarray) -> np.ndarray:
    """Signature values with the number of their permutation in the lowest bits."""
    return (mins & ~np.uint64(63)) | _TAGS[None, :]


def item_signatures(tokens: list[str], cache: dict[str, int]) -> np.ndarray:
    """Keys of each passage of an item, one row per passage. Items shorter than a passage are one passage; of under SHINGLE words, none."""
    ids = _word_ids(tokens, cache)
    starts = range(0, max(1, len(ids) - PASSAGE + STEP), STEP)
    rows = []
    for s in starts:
        s = min(s, max(0, len(ids) - PASSAGE))
        h = shingles(ids[s : s + PASSAGE])
        if len(h):
            rows.append(_permuted(h).min(0))
    return _keys(np.array(rows)) if rows else np.empty((0, PERMUTATIONS), np.uint64)


def fewest_shingles(items: list[list[str]]) -> int:
    """The least number of an item's shingles that a verified passage holds, over the given items: they must cover COVERED of its words."""
    return min((max(1, math.ceil(COVERED * min(PASSAGE, len(w)) / SHINGLE)) for w in items if len(w) >= SHINGLE), default=1)


def window_signatures(ids: np.ndarray, of_items: np.ndarray | None = None, fewest: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each window of a text, and the windows' sizes: two adjoining blocks of 16 shingles, so any passage is inside one.

    of_items: the items' shingles, sorted. A stretch of three blocks with fewer than `fewest` of them can hold no passage that verifies, so its windows are left out.
    """
    h = shingles(ids)
    if of_items is None or not len(h):
        return _windows_of(h)
    if not len(of_items):
        return _windows_of(h[:0])
    at = np.searchsorted(of_items, h)
    at[at == len(of_items)] = 0
    hit = of_items[at] == h
    if not hit.any():
        return _windows_of(h[:0])
    per = np.add.reduceat(hit, np.arange(0, len(h), PASSAGE), dtype=np.int64)
    around = per.copy()
    around[1:] += per[:-1]
    around[:-1] += per[1:]
    full = around >= fewest
    near = full.copy()
    near[1:] |= full[:-1]
    near[:-1] |= full[1:]
    if near.all():
        return _windows_of(h)
    runs = np.flatnonzero(np.diff(np.concatenate([[0], near.view(np.int8), [0]]))).reshape(-1, 2)
    parts = [_windows_of(h[a * PASSAGE : b * PASSAGE]) for a, b in runs] or [_windows_of(h[:0])]
    return np.concatenate([k for k, _ in parts]), np.concatenate([s for _, s in parts])


def _windows_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(h):
        return np.empty((0, PERMUTATIONS), np.uint64), np.empty(0, int)
    starts = np.arange(0, len(h), PASSAGE)
    mins = np.minimum.reduceat(_permuted(h), starts, axis=0)
    sizes = np.diff(np.append(starts, len(h)))
    if len(mins) > 1:
        mins, sizes = np.minimum(mins[:-1], mins[1:]), sizes[:-1] + sizes[1:]
    return _keys(mins), sizes


def least_matches(size: int) -> int:
    """Equal signature values that a window of that size must share with a passage.

    The window's partition gives the size's upper end u; containment t of a passage of q shingles is at least the
    Jaccard similarity t/(1+u/q-t). Half of the matches expected there are asked for.
    """
    q = PASSAGE - SHINGLE + 1
    u = next((x for x in SIZES if size <= x), SIZES[-1])
    return max(1, int(0.5 * PERMUTATIONS * CONTAINED / (1 + u / q - CONTAINED)))


def places_of(item: list[str]) -> dict[tuple, list[int]]:
    """Where each shingle stands in an item."""
    at = defaultdict(list)
    for i in range(len(item) - SHINGLE + 1):
        at[tuple(item[i : i + SHINGLE])].append(i)
    return at


def leaked_span(doc: list[str], at: dict[tuple, list[int]], where=None) -> tuple[int, float]:
    """Longest stretch of the item, in its words, that stands in the text, and the share of those words found there.

    Every shingle of the text that the item has is placed at all its positions in the item. Stretches join to runs when the gap
    is at most GAP words on either side and about equal on both. In each run the longest part with a share of COVERED or more is
    sought over all its stretches' starts, so a thin beginning takes nothing from a dense rest; a word for word stretch stays in one run.
    where: the places in the text at which a shingle of the item may stand, in order; all if not given.
    """
    open_runs: list[list] = []  # starts of stretches (item word, words covered before it), last item word, last doc word, covered words
    best = (0, 0.0)
    for d in range(len(doc) - SHINGLE + 1) if where is None else where:
        places = at.get(tuple(doc[d : d + SHINGLE]))
        if not places:
            continue
        open_runs = [r for r in open_runs if d - r[2] <= GAP + 1]
        for p in places:
            joined, rank = None, (False, 0)
            for r in open_runs:
                gi, gd = p - r[1] - 1, d - r[2] - 1  # words between; negative where they overlap
                # a shingle of the text prolongs a run once only
                if p > r[1] - SHINGLE and p + SHINGLE - 1 > r[1] and gi <= GAP and gd >= 1 - SHINGLE and abs(gi - gd) <= 3:
                    fit = (gi == gd == 1 - SHINGLE, r[3])
                    if joined is None or fit > rank:
                        joined, rank = r, fit
            last = p + SHINGLE - 1
            if joined is None:
                joined = [[(p, 0)], last, d + SHINGLE - 1, SHINGLE]
                open_runs.append(joined)
            else:
                if p > joined[1] + 1:
                    joined[0].append((p, joined[3]))
                joined[3] += min(SHINGLE, last - joined[1])
                joined[1], joined[2] = last, d + SHINGLE - 1
            for start, before in joined[0]:
                span = last - start + 1
                if span <= best[0]:
                    break
                share = (joined[3] - before) / span
                if share >= COVERED:
                    best = (span, share)
                    break
    return best


def is_leak(doc: list[str], item: list[str], at: dict[tuple, list[int]] | None = None, where=None) -> tuple[int, float] | None:
    span, share = leaked_span(doc, places_of(item) if at is None else at, where)
    return (span, share) if span >= min(PASSAGE, len(item)) and span >= SHINGLE else None


def leaks(documents: DataFrame, items: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, item_id, n_words, covered: every item of which a text holds a passage, and the longest such passage.

    Words are compared after markup, hidden characters, accents, case, punctuation and look-alike letters are
    out of the way (texts.words). Each item is cut into passages of 16 words, each text into windows that overlap so that
    any passage lies in one. MinHash signatures of windows are compared with those of passages, with as many equal values asked for as
    containment means at the window's size (least_matches). Candidates are then verified exactly on the whole text (leaked_span).

    The items' signatures and words go to every task, after a check of their size against `broadcast_keys`; then nothing is
    shuffled. A larger item set is joined by signature value instead, with the same result. An item shorter than a passage counts if
    all of it is there. Null or empty texts and items of under three words leak nothing; repeated rows give one result; other
    columns are ignored.
    """
    docs = documents.select("doc_id", F.col("text").alias("doc_text")).where(F.col("doc_id").isNotNull() & F.col("doc_text").isNotNull())
    its = items.select("item_id", F.col("text").alias("item_text")).where(F.col("item_id").isNotNull() & F.col("item_text").isNotNull())
    length = its.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()[0]
    # an item has at most one passage per STEP words, and a word at least two characters with its blank
    if length / 2 / STEP * PERMUTATIONS <= broadcast_keys:
        found = _by_broadcast(docs, its)
    else:
        found = _by_join(docs, its)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", "covered")).alias("m")).select("doc_id", "item_id", "m.n_words", "m.covered")


_FOUND = "doc_id {t}, item_id {u}, n_words int, covered double"


def _by_broadcast(docs: DataFrame, its: DataFrame) -> DataFrame:
    types = dict(docs.dtypes) | dict(its.dtypes)
    cache: dict[str, int] = {}
    names, tokens, keys, owners = [], [], [], []
    for item_id, text in its.distinct().collect():  # its size was checked
        w = words(text)
        k = item_signatures(w, cache)
        for row in k:
            keys.append(row)
            owners.append(len(names))
        names.append(item_id)
        tokens.append(w)
    flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    passage = np.repeat(np.arange(len(keys)), PERMUTATIONS)
    order = np.argsort(flat, kind="stable")
    # every value once, with the passages that have it
    values, first = np.unique(flat[order], return_index=True)
    ends = np.append(first[1:], len(flat))
    theirs = np.unique(np.concatenate([shingles(_word_ids(w, cache)) for w in tokens])) if tokens else np.empty(0, np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast((names, tokens, np.array(owners, int), values, first, ends, passage[order], theirs, fewest_shingles(tokens)))

    def search(batches):
        names, tokens, owners, values, first, ends, passages, theirs, fewest = shared.value
        cache: dict[str, int] = {}
        placed: dict[int, tuple] = {}
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["doc_text"]):
                w = words(text)
                if len(cache) > 2_000_000:
                    cache.clear()
                ids = _word_ids(w, cache)
                sig, sizes = window_signatures(ids, theirs, fewest)
                if not len(sig):
                    continue
                flat = sig.ravel()
                at = np.searchsorted(values, flat)
                at[at == len(values)] = 0
                hit = np.flatnonzero(values[at] == flat)
                if not len(hit):
                    continue
                # equal values per window and passage, all at once
                begin, many = first[at[hit]], ends[at[hit]] - first[at[hit]]
                spots = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
                pair, n = np.unique(np.repeat(hit // PERMUTATIONS, many) * len(owners) + passages[spots], return_counts=True)
                need = np.array([least_matches(int(z)) for z in sizes])
                h = shingles(ids)
                for c in np.unique(owners[pair[n >= need[pair // len(owners)]] % len(owners)]).tolist():
                    if c not in placed:
                        placed[c] = places_of(tokens[c]), np.unique(shingles(_word_ids(tokens[c], cache)))
                    where = np.flatnonzero(np.isin(h, placed[c][1]))
                    # fewer shingles than a passage must hold can't verify
                    if len(where) >= fewest and (got := is_leak(w, tokens[c], placed[c][0], where.tolist())):
                        out.append((doc_id, names[c], *got))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_words", "covered"])

    return spread(docs, "doc_id").mapInPandas(search, _FOUND.format(t=types["doc_id"], u=types["item_id"]))


def _by_join(docs: DataFrame, its: DataFrame) -> DataFrame:
    types = dict(docs.dtypes) | dict(its.dtypes)

    def emit(id_col, text_col, windows):
        def run(batches):
            cache: dict[str, int] = {}
            for b in batches:
                out = []
                if len(cache) > 2_000_000:
                    cache.clear()
                for i, text in zip(b[id_col], b[text_col]):
                    w = words(text)
                    if windows:
                        sig, sizes = window_signatures(_word_ids(w, cache))
                    else:
                        sig = item_signatures(w, cache)
                        sizes = np.zeros(len(sig), int)
                    for k, (row, size) in enumerate(zip(sig.view(np.int64), sizes)):
                        out += [(i, k, least_matches(int(size)) if windows else 0, int(v)) for v in row]
                yield pd.DataFrame(out, columns=[id_col, "part", "need", "key"])

        return run

    d = spread(docs, "doc_id").mapInPandas(emit("doc_id", "doc_text", True), f"doc_id {types['doc_id']}, part int, need int, key long")
    i = its.distinct().mapInPandas(emit("item_id", "item_text", False), f"item_id {types['item_id']}, part int, need int, key long")
    i = i.select("item_id", F.col("part").alias("passage"), "key")
    candidates = (
        d.join(i, "key").groupBy("doc_id", "part", "need", "item_id", "passage").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.col("need")).select("doc_id", "item_id").distinct()
    )

    def verify(batches):
        for b in batches:
            out = []
            for doc_id, item_id, dt, it in zip(b["doc_id"], b["item_id"], b["doc_text"], b["item_text"]):
                if got := is_leak(words(dt), words(it)):
                    out.append((doc_id, item_id, *got))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_words", "covered"])

    full = candidates.join(docs, "doc_id").join(its.distinct(), "item_id").select("doc_id", "item_id", "doc_text", "item_text")
    return full.mapInPandas(verify, _FOUND.format(t=types["doc_id"], u=types["item_id"]))


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per suite: items, items that leaked, affected documents, pairs."""
    i = items.select("item_id", "suite").distinct()
    return i.join(found, "item_id", "left").groupBy("suite").agg(
        F.count_distinct("item_id").alias("n_items"),
        F.count_distinct(F.when(F.col("doc_id").isNotNull(), F.col("item_id"))).alias("n_leaked_items"),
        F.count_distinct("doc_id").alias("n_documents"),
        F.count("doc_id").alias("n_pairs"),
    )
