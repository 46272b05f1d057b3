"""Abusive, hateful or sexual content: a string-kernel machine over sentences."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.llm.texts import plain
from loamgraph.sources.tables import spread

#: Lengths of the subsequences, the widest stretch one may spread over, and the decay per letter of that stretch.
LENGTHS, STRETCH, DECAY = ((3, 5), (4, 6)), 6, 0.7
#: Bits of a feature's number.
BITS = 20
#: Weight of words, and of pairs of words with at most one between, beside the letters' subsequences.
WORD, PAIR = 1.6, 1.0
#: Nystroem landmarks: sentences of either class. Training reads at most so many documents labelled clean and abusive, the first by a hash of their id.
LANDMARKS, TRAIN_DOCUMENTS = 400, (1_800, 600)
#: Weight of errors against margin, and rounds in which each abusive document's worst sentence is chosen again.
COST, ROUNDS = 30.0, 4
#: Dimensions of the signed hashing with which labelled sentences are compared before training.
SKETCH = 1024
#: How many times likelier beside sentences of abusive documents than of clean ones a sentence must be to vote, or the kernel value that none of the clean ones may reach.
LIKELIER, NOVEL = 4.0, 0.3
#: Letters of a sentence that are scored as one; a longer one is scored in pieces, with so many letters in common.
LONGEST, OVERLAP = 2_000, 300

_CUT = re.compile(r"(?<=[.!?…。！？])[\"')\]]*\s+|[\r\n]+|\s[|]\s|;\s+")
_LEAD = re.compile(r"^\s*(?:[-*>#|+•]+\s*|//+\s*|\[\d{1,2}:\d{2}(?::\d{2})?\]\s*|\d+[.)]\s+)*(?:[a-z]+\([^()\s]{1,40}\):\s*|[a-z]+-?\d*:\s+)?")
_NAME = re.compile(r"\b(?=[A-Za-z][a-z]*+[A-Z])(?=\w*?[a-z])\w++(?:\(\))?|\b[A-Za-z]\w*+\(\)|(?<![\w<])[/.]?\w++(?:[/\\]\w[\w.]*+)+|#\d++|`[^`\n]+`")
_MAY_NAME = re.compile(r"[#`/\\]|\(\)|[A-Za-z][A-Z]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .*_-]){2,}[^\W\d_](?![^\W_])")
_NUMBER = re.compile(r"\d+")
# a run of letters and the signs that stand for some, tried once per run, so that one endless run costs no more than its length
_LEET_RUN = re.compile(r"(?<![a-z0134579@$!*])[a-z]*+[0134579@$!*][a-z0134579@$!*]*+")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})
_OTHER = re.compile(r"[^\w' ]+|_+")


def _read_signs(m: re.Match) -> str:
    """The letters that a run's signs stand for, if a letter comes after one of them; else the run as it is."""
    upto = m[0].rstrip("0134579@$!*")
    return m[0].rstrip("!").translate(_LEET) if upto and not upto.isalpha() else m[0]


def pieces(sentence: str) -> list[str]:
    """A sentence of up to LONGEST letters as it is; a longer one as consecutive overlapping pieces, cut at blanks where there are any."""
    out, at = [], 0
    while len(sentence) - at > LONGEST:
        end = sentence.rfind(" ", at + LONGEST - OVERLAP, at + LONGEST)
        end = at + LONGEST if end < 0 else end
        out.append(sentence[at:end].strip())
        back = sentence.rfind(" ", end - 2 * OVERLAP, end - OVERLAP)
        at = end - OVERLAP if back < 0 else back + 1
    return [*out, sentence[at:].strip()]


def _read(part: str) -> list[str]:
    """One raw sentence in the form the kernel reads."""
    s = plain(_NAME.sub(" ¤ ", part) if _MAY_NAME.search(part) else part)
    s = _LEAD.sub("", s)
    s = _SPACED.sub(lambda m: re.sub(r"[ .*_-]", "", m[0]), s)
    s = _LEET_RUN.sub(_read_signs, s)
    s = _NUMBER.sub("9", s).replace("¤", " 8 ")
    s = " ".join(_OTHER.sub(" ", s).split())
    return pieces(s) if s else []


def sentences(text: str, known: dict[str, list[str]] | None = None) -> list[str]:
    """A text's sentences in the form the kernel reads; whole texts, repeats included once. Very long sentences come in pieces.

    Identifiers, paths and issue numbers become one sign, numbers another: they say nothing about tone. Letters spaced
    out are joined, digits inside words read as letters, masks dropped. What remains of spelling tricks is for the kernel's gaps.
    known: raw sentences read before, which texts with common lines share.
    """
    known = {} if known is None else known
    out = {}
    for part in _CUT.split(text.replace("\xa0", " ")):
        got = known.get(part)
        if got is None:
            got = known[part] = _read(part)
        for s in got:
            out[s] = None
    return list(out)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, feature, weight) of the gap-weighted subsequence kernel's explicit features, added up per sentence.

    A feature is a run of 3 or 4 letters in order, spread over at most STRETCH letters; its weight decays with the
    stretch. The inner product of two sentences' features is their subsequence kernel.
    """
    joined = "".join(f"  {t} " + " " * STRETCH for t in texts)
    lengths = np.array([len(t) + 3 + STRETCH for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    n = len(codes) - STRETCH
    if n <= 0:
        return np.empty(0, int), np.empty(0, np.int64), np.empty(0)
    own = owner[:n] << (BITS + 3)
    blank = codes == np.uint64(32)
    alive = ~blank[:n]
    sums: dict[tuple, np.ndarray] = {}  # hashes of the letters so far, shared by all runs that begin alike
    found = []
    with np.errstate(over="ignore"):
        sums[()] = codes[:n] * np.uint64(0x9E3779B97F4A7C15)
        for length, widest in LENGTHS:
            for rest in itertools.combinations(range(1, widest), length - 1):
                for k in range(1, length):
                    if rest[:k] not in sums:
                        h = (sums[rest[: k - 1]] ^ codes[rest[k - 1] : rest[k - 1] + n]) * np.uint64(0xBF58476D1CE4E5B9)
                        sums[rest[:k]] = h ^ (h >> np.uint64(31))
                last = rest[-1]
                ok = alive & (owner[last : last + n] == owner[:n])
                # the last letter is no blank unless letters adjoin: word ends count, empty stretches do not
                if last != length - 1:
                    ok &= ~blank[last : last + n]
                key = (sums[rest] >> np.uint64(64 - BITS)).astype(np.int64) << 3 | (last + 1 - length)
                found.append((own | key)[ok])
    found += [o << (BITS + 3) | k << 3 | c for k, o, c in _word_features(texts)]
    # sentence, feature and class of weight in one number: a plain sort brings equal features together
    flat = np.sort(np.concatenate(found))
    if not len(flat):
        return np.empty(0, int), np.empty(0, np.int64), np.empty(0)
    w = _WEIGHTS[flat & 7]
    flat >>= 3
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    w = np.add.reduceat(w, first)
    flat = flat[first]
    return flat >> BITS, flat & ((1 << BITS) - 1), w


#: Weights by class: letters by how far they are spread, words, pairs of words by their distance.
_WEIGHTS = np.array([1.0, DECAY, DECAY**2, DECAY**3, WORD, PAIR, PAIR * DECAY, 0.0])


def _word_features(texts: list[str]):
    """The same kernel with words for letters: single words, and pairs with at most one word between. feature, sentence, class of weight."""
    split = [t.split(" ") for t in texts]
    ids: dict[str, int] = {}
    flat = np.array([ids.setdefault(w, len(ids)) for ws in split for w in ws], np.int64)
    if not len(flat):
        return
    hashed = np.array([xxhash.xxh64_intdigest(w) for w in ids], np.uint64)[flat]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(ws) for ws in split])
    top = np.uint64(64 - BITS)
    yield (hashed >> top).astype(np.int64), owner, 4
    with np.errstate(over="ignore"):
        for gap in (1, 2):
            if len(flat) > gap:
                same = owner[gap:] == owner[:-gap]
                h = (hashed[:-gap] * np.uint64(0x9E3779B97F4A7C15)) ^ hashed[gap:]
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                yield (h >> top).astype(np.int64)[same], owner[gap:][same], 4 + gap


class Model:
    """A linear reading of kernel values against landmarks, collapsed to one weight per feature."""

    def __init__(self, weights: np.ndarray, rare: np.ndarray, bias: float, threshold: float):
        self.weights, self.rare, self.bias, self.threshold = weights.astype(np.float32), rare.astype(np.float32), bias, threshold

    def scores(self, texts: list[str]) -> np.ndarray:
        s, f, w = features(texts)
        norm = np.sqrt(np.bincount(s, (w * self.rare[f]) ** 2, minlength=len(texts)))
        dot = np.bincount(s, w * self.weights[f], minlength=len(texts))
        return np.where(norm > 0, dot / np.maximum(norm, 1e-12), 0.0) + self.bias


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float, w: np.ndarray | None = None, steps: int = 12) -> np.ndarray:
    """Squared-hinge support vector machine by Newton steps; the last column of x is the bias."""
    w = np.zeros(x.shape[1]) if w is None else w.copy()
    reg = np.ones(x.shape[1])
    reg[-1] = 1e-3
    for _ in range(steps):
        margin = y * (x @ w)
        act = margin < 1
        act &= weight > 0
        xa, ca = x[act].astype(float), weight[act] * cost
        grad = reg * w - xa.T @ (ca * (y[act] - xa @ w))
        hess = (xa * ca[:, None]).T @ xa
        hess[np.diag_indices_from(hess)] += reg
        step = np.linalg.solve(hess, grad)
        # halve until the objective falls
        def objective(v):
            m = np.maximum(0, 1 - y * (x @ v))
            return 0.5 * (reg * v * v).sum() + 0.5 * cost * (weight * m * m).sum()

        now, t = objective(w), 1.0
        while t > 1e-3 and objective(w - t * step) > now:
            t /= 2
        w = w - t * step
        if np.max(np.abs(step)) < 1e-5:
            break
    return w


def _compact(texts: list[str], step: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features() of many sentences in little memory: where each begins, features, weights."""
    counts, fs, ws = [], [], []
    for i in range(0, len(texts), step):
        s, f, w = features(texts[i : i + step])
        counts.append(np.bincount(s, minlength=len(texts[i : i + step])))
        fs.append(f.astype(np.int32))
        ws.append(w.astype(np.float32))
    return np.append(0, np.cumsum(np.concatenate(counts))), np.concatenate(fs), np.concatenate(ws)


def _sketch(start: np.ndarray, f: np.ndarray, w: np.ndarray, step: int = 400) -> np.ndarray:
    """Sentences as short vectors whose inner products are close to their kernel values."""
    n = len(start) - 1
    out = np.empty((n, SKETCH), np.float32)
    for i in range(0, n, step):
        a, b, m = start[i], start[min(i + step, n)], min(step, n - i)
        h = (f[a:b].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        sign = np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
        row = np.repeat(np.arange(m), np.diff(start[i : i + m + 1]))
        out[i : i + m] = np.bincount(row * SKETCH + (h >> np.uint64(54)).astype(int), w[a:b] * sign, minlength=m * SKETCH).reshape(m, SKETCH)
    return out


def train(docs: list[tuple[str, int]], seed: int = 7) -> Model:
    """Fit on labelled documents (text, 0 or 1).

    Labels are of documents, and err, so each abusive document's bad sentence is found first: the one that lies nearer to sentences of other
    abusive documents than to those of clean ones, or far from all clean ones. Documents without any such sentence don't vote. Then the
    machine is fitted, chooses each abusive document's worst sentence again, and drops clean sentences that it finds plainly bad, for some rounds.
    Features weigh more the fewer labelled sentences have them.
    """
    rng = np.random.default_rng(seed)
    split = [(sentences(t), y) for t, y in docs if t]
    split = [(s, y) for s, y in split if s]
    pos = [(i, x) for i, (s, y) in enumerate(split) if y == 1 for x in s]
    neg = sorted({x for s, y in split if y == 0 for x in s})
    if not pos or not neg:
        return Model(np.zeros(1 << BITS), np.ones(1 << BITS), -1.0, 0.0)
    texts, own = [x for _, x in pos] + neg, np.array([i for i, _ in pos])
    n_pos, n = len(pos), len(texts)
    start, f, w = _compact(texts)
    rare = (np.log((n + 1) / (np.bincount(f, minlength=1 << BITS) + 1)) + 0.1).astype(np.float32)
    w *= rare[f]
    w /= np.repeat(np.sqrt(np.add.reduceat(w * w, start[:-1])), np.diff(start))

    sketch = _sketch(start, f, w)
    # every occurrence counts on either side, so a sentence that all documents share is equally near to both
    times = Counter(x for q, y in split if y == 0 for x in q)
    each = np.array([times[x] for x in neg], np.float32)
    bad_docs, clean_docs = sum(y == 1 for _, y in split), sum(y == 0 for _, y in split)
    near = lambda v: np.clip((v - 0.25) / 0.5, 0, 1)
    lead, may = np.empty(n_pos), np.empty(n_pos, bool)
    for i in range(0, n_pos, 200):
        part = sketch[i : min(i + 200, n_pos)]
        like_bad = part @ sketch[:n_pos].T
        like_bad[own[i : i + len(part)][:, None] == own[None, :]] = 0.0
        like_clean = part @ sketch[n_pos:].T
        lead[i : i + len(part)] = np.log((near(like_bad).sum(1) + 0.5) / (bad_docs + 1) / ((near(like_clean) @ each + 0.5) / (clean_docs + 1)))
        may[i : i + len(part)] = (lead[i : i + len(part)] > math.log(LIKELIER)) | (like_clean.max(1) < NOVEL)
    del sketch
    rows = [np.flatnonzero(own == i) for i in dict.fromkeys(own.tolist())]

    # landmarks: the sentences that vote at first, and clean ones
    first = [r[np.argmax(np.where(may[r], lead[r], -9.0))] for r in rows if may[r].any()]
    half = LANDMARKS // 2
    marks = list(rng.choice(first, min(half, len(first)), replace=False)) if first else []
    marks += [n_pos + i for i in rng.choice(len(neg), min(LANDMARKS - len(marks), len(neg)), replace=False)]
    used = np.unique(np.concatenate([f[start[i] : start[i + 1]] for i in marks]))
    look = np.full(1 << BITS, -1)
    look[used] = np.arange(len(used))
    m = np.zeros((len(used), len(marks)), np.float32)
    for j, i in enumerate(marks):
        m[look[f[start[i] : start[i + 1]]], j] = w[start[i] : start[i + 1]]
    val, vec = np.linalg.eigh((m.T @ m).astype(float))
    keep = val > 1e-6 * val.max()
    root = vec[:, keep] / np.sqrt(val[keep])
    k = np.zeros((n, len(marks)), np.float32)
    for i in range(n):
        c, x = look[f[start[i] : start[i + 1]]], w[start[i] : start[i + 1]]
        there = c >= 0
        k[i] = x[there] @ m[c[there]]
    x = np.hstack([k @ root.astype(np.float32), np.ones((n, 1), np.float32)])
    del k, f, w

    y = np.concatenate([np.ones(n_pos), -np.ones(len(neg))])
    weight = np.concatenate([np.zeros(n_pos), np.ones(len(neg))])
    weight[first] = 1.0
    beta = _svm(x, y, weight, COST)
    for _ in range(ROUNDS):
        got = x @ beta
        weight[:n_pos] = 0.0
        for r in rows:
            best = r[np.argmax(np.where(may[r] | (lead[r] > 0.5), got[r], -9.0))]
            if (may[best] and got[best] > -0.5) or (lead[best] > 0.5 and got[best] > 0.2):
                weight[best] = 1.0
        weight[n_pos:] = np.where(got[n_pos:] > 0.3, 0.0, 1.0)
        beta = _svm(x, y, weight, COST, beta)
    flat = np.zeros(1 << BITS)
    flat[used] = m @ (root @ beta[:-1])
    model = Model(flat * rare, rare, float(beta[-1]), 0.0)
    model.threshold = _cut([(max(model.scores(s)), lab) for s, lab in split])
    return model


def _cut(scored: list[tuple[float, int]]) -> float:
    """The score that best parts the two labels by F1, kept near the machine's own border: between -0.3 and 0.3, the middle of the best stretch."""
    values = np.array([s for s, _ in scored])
    labels = np.array([y for _, y in scored])
    grid = np.linspace(-0.3, 0.3, 61)
    f1 = []
    for g in grid:
        hit = values > g
        tp = float((hit & (labels == 1)).sum())
        f1.append(2 * tp / max(1.0, hit.sum() + labels.sum()))
    best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
    return float(np.median(grid[best]))


def labelled(documents: DataFrame, labels: DataFrame, limits: tuple[int, int] = TRAIN_DOCUMENTS) -> DataFrame:
    """doc_text, abusive of documents whose raters agree: at most `limits` clean and abusive ones, chosen by a hash of the id, so the same at every run."""
    votes = labels.where(F.col("doc_id").isNotNull() & F.col("abusive").isin(0, 1)).groupBy("doc_id").agg(F.min("abusive").alias("lo"), F.max("abusive").alias("abusive")).where(F.col("lo") == F.col("abusive"))
    docs = documents.select("doc_id", F.col("text").alias("doc_text")).where(F.col("doc_text").isNotNull())
    order = Window.partitionBy("abusive").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = votes.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.when(F.col("abusive") == 0, limits[0]).otherwise(limits[1])).drop("_n")
    return docs.join(picked, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "doc_text", "abusive")


def fit(documents: DataFrame, labels: DataFrame, limits: tuple[int, int] = TRAIN_DOCUMENTS) -> Model:
    rows = labelled(documents, labels, limits).orderBy("doc_id").collect()  # bounded by the limits
    return train([(r["doc_text"], int(r["abusive"])) for r in rows])


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, source, score, abusive, worst for every document: its worst sentence's score, whether that passes the cut, and the sentence.

    source is trimmed, lower-cased, with dashes as underscores; null becomes `unknown`. A null or empty text has the score of
    no sentence at all, null, and is not abusive. Every sentence of a text is scored, whatever its length. Documents are judged one by one: nothing
    is shuffled, and only the model (one weight per feature) is sent to tasks. Other columns are ignored.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    source = F.coalesce(F.nullif(F.replace(F.lower(F.trim("source")), F.lit("-"), F.lit("_")), F.lit("")), F.lit("unknown"))
    docs = documents.select("doc_id", source.alias("source"), F.col("text").alias("doc_text"))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        model = shared.value
        known: dict[str, float] = {}
        parts: dict[str, list[str]] = {}
        for b in batches:
            if len(known) + len(parts) > 500_000:
                known.clear()
                parts.clear()
            split = [sentences(t, parts) if isinstance(t, str) else [] for t in b["doc_text"]]
            new = sorted({s for ss in split for s in ss if s not in known}, key=len)
            size, part = 0, []
            for s in [*new, None]:
                if s is None or size + len(s) > 20_000:
                    if part:
                        known.update(zip(part, model.scores(part).tolist()))
                    size, part = 0, []
                if s is not None:
                    part.append(s)
                    size += len(s)
            best = [max(((known[s], s) for s in ss), default=(None, None)) for ss in split]
            yield pd.DataFrame(
                {"doc_id": b["doc_id"], "source": b["source"], "score": [x for x, _ in best], "abusive": [x is not None and x > model.threshold for x, _ in best], "worst": [s for _, s in best]}
            )

    return spread(docs, "doc_id").mapInPandas(run, f"doc_id {kind}, source string, score double, abusive boolean, worst string")


def rates(judged: DataFrame) -> DataFrame:
    """Per source: documents, abusive ones, their rate."""
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if("abusive").alias("n_abusive"), F.round(F.avg(F.col("abusive").cast("double")), 6).alias("abusive_rate"))
