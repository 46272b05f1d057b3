"""Neighbour graph and greedy search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgraph.llm import neighbours as nn
from loamgraph.sources.tables import Scratch


def clustered(n, dim, seed):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((n // 12, dim))
    return (centres[r.integers(0, len(centres), n)] + 0.35 * r.standard_normal((n, dim))) * r.uniform(0.1, 9, (n, 1))


def table(spark, x, extra=()):
    return spark.createDataFrame([(f"s{i:05d}", [float(v) for v in row], "m1" if i % 5 else "m2") for i, row in enumerate(x)] + list(extra), "summary_id string, embedding array<float>, model string")


def nearest_by_force(x, scope, k):
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    out = {}
    for s in set(scope):
        at = [i for i, v in enumerate(scope) if v == s]
        c = u[at] @ u[at].T
        np.fill_diagonal(c, -3)
        for row, i in enumerate(at):
            best = sorted(range(len(at)), key=lambda j: (-round(c[row, j], 12), at[j]))[:k]
            out[i] = [at[j] for j in best if j != row]
    return out


def test_recall_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(nn, "LEAF", 64)
    monkeypatch.setattr(nn, "LARGEST_LEAF", 128)
    x = clustered(900, 16, 1)
    odd = [("n1", None, "m1"), ("n2", [], "m1"), ("n3", [0.0] * 16, "m1"), ("n4", [float("nan")] + [1.0] * 15, "m1"), ("n5", [None] + [1.0] * 15, "m1"), ("n6", [1.0] * 15, "m1"), (None, [1.0] * 16, "m1"), ("alone", [1.0] * 16, "m3")]
    df = table(spark, x, odd)
    df = df.union(df.limit(50)).withColumns({"key": F.lit(0), "nid": F.lit(1), "v": F.lit(2)})
    got = {}
    for r in nn.nearest(df, "summary_id", "embedding", "model", 5, 16).collect():
        assert r["a"] not in {"n1", "n2", "n3", "n4", "n5", "n6", "alone"}
        got.setdefault(int(r["a"][1:]), []).append(int(r["b"][1:]))
    want = nearest_by_force(x, ["m1" if i % 5 else "m2" for i in range(len(x))], 5)
    assert all(len(v) == 5 for v in got.values()) and len(got) == 900
    assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want]) >= 0.95
    assert nn.nearest(df.limit(0), "summary_id", "embedding", "model", 5, 16).count() == 0


def test_a_third_are_copies(spark):
    x = np.vstack([np.tile(clustered(12, 16, 2)[0], (200, 1)), clustered(400, 16, 3)])
    rows = nn.nearest(table(spark, x).withColumn("model", F.lit(None).cast("string")), "summary_id", "embedding", "model", 5, 16).collect()
    got = {}
    for r in rows:
        got.setdefault(r["a"], []).append(r["b"])
    first = [f"s{i:05d}" for i in range(6)]
    for i in (0, 3, 150):
        me = f"s{i:05d}"
        assert sorted(got[me]) == [b for b in first if b != me][:5]
    pairs = nn.close_pairs(nn.nearest(table(spark, x[:3]), "summary_id", "embedding", None, 5, 16), 0.9).collect()
    assert {(r["a"], r["b"]) for r in pairs} == {("s00000", "s00001"), ("s00000", "s00002"), ("s00001", "s00002")}


def test_a_third_are_rescaled_copies(spark, monkeypatch):
    monkeypatch.setattr(nn, "HOT", 50)
    one = clustered(12, 16, 2)[:1]
    x = np.vstack([one * np.linspace(0.01, 9, 200)[:, None], clustered(400, 16, 3)]).astype(np.float32)
    df = table(spark, x).withColumn("model", F.lit(None).cast("string"))
    got = {}
    for r in nn.nearest(df, "summary_id", "embedding", "model", 5, 16).collect():
        got.setdefault(int(r["a"][1:]), []).append((int(r["b"][1:]), r["cos"]))
    assert len(got) == 600 and all(len(v) == 5 for v in got.values())
    for i in range(200):
        assert all(b < 200 and b != i and c > 1 - 1e-9 for b, c in got[i])
    rest = nearest_by_force(x, [0] * 600, 5)
    assert np.mean([len({b for b, _ in got[i]} & set(rest[i])) / 5 for i in range(200, 600)]) >= 0.95


def recall_of(links, x, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -3)
    want = np.argsort(-c, axis=1)[:, :k]
    got = {r["nid"]: r["nb"] for r in links.collect()}
    return np.mean([len(set(got.get(i, [])[:k]) & set(w.tolist())) / k for i, w in enumerate(want)])


def packed(spark, x):
    return spark.createDataFrame([(i, "", row.astype(np.float32).tobytes()) for i, row in enumerate(x)], "nid long, scope string, raw binary")


def test_descent_mends_a_poor_first_graph(spark, monkeypatch):
    """Two trees with tiny leaves and common hyperplanes below the second level: most neighbours come from the rounds alone."""
    for name, value in (("LEAF", 12), ("LARGEST_LEAF", 24), ("TREES", 2), ("TREE_LEVELS", 2)):
        monkeypatch.setattr(nn, name, value)
    x = clustered(1200, 16, 6)
    s = Scratch(spark)
    units = s.keep(packed(spark, x))
    before, after = recall_of(nn.build(units, s, rounds=0).links, x), recall_of(nn.build(units, s).links, x)
    assert before < 0.6 and after >= 0.9


def test_greedy_search(spark, monkeypatch):
    monkeypatch.setattr(nn, "LEAF", 128)
    x = clustered(1500, 16, 4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = Scratch(spark)
    units = s.keep(packed(spark, x))
    g = nn.build(units, s)
    q = units.where("nid % 20 = 0").withColumnRenamed("nid", "qid")
    found = {}
    for r in nn.search(g, q, 10).collect():
        found.setdefault(r["qid"], set()).add(r["nid"])
    assert len(found) == 75
    c = u @ u.T
    assert np.mean([len(found[i] & set(np.argsort(-c[i])[:10].tolist())) / 10 for i in found]) >= 0.9
