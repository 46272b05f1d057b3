"""Leaks, mixing and abuse on small tables."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loamgraph.llm import abuse, leakage, mixing
from loamgraph.llm.texts import words

rnd = random.Random(9)
VOCABULARY = [f"{a}{b}{c}" for a in "bdgklmnprst" for b in "aeiou" for c in ("n", "r", "lo", "mi")]


def prose(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCABULARY) for _ in range(n)]


ITEMS = {i: " ".join(prose(50, i)) for i in range(12)}


def disguised(ws):
    out = list(ws)
    out[7] = "inserted"
    text = " ".join(w.upper() if k % 5 == 0 else w for k, w in enumerate(out))
    return "<p>" + text.replace("a", "а", 3).replace(" ", "&nbsp; ", 2).replace(" ", ",\n// ", 6) + "</p>​"


def cases():
    docs, want = [], set()
    for i in range(12):
        w = ITEMS[i].split()
        docs.append((100 + i, " ".join(prose(200, 1000 + i) + w + prose(300, 2000 + i))))
        want.add((100 + i, i))
        docs.append((200 + i, " ".join(prose(90, 3000 + i)) + " " + disguised(w[5:40]) + " " + " ".join(prose(20, i + 50))))
        want.add((200 + i, i))
        docs.append((300 + i, " ".join(prose(60, 4000 + i) + w[10:26] + prose(70, 5000 + i))))
        want.add((300 + i, i))
        docs.append((400 + i, " ".join(prose(60, 6000 + i) + w[10:22] + prose(70, 7000 + i))))  # too short a quotation
    docs += [(1, None), (2, ""), (3, "two words"), (100, docs[0][1])]
    return docs, want


@pytest.mark.parametrize("keys", [leakage.BROADCAST_KEYS, 0])
def test_leaks(spark, keys):
    docs, want = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(0), "key": F.lit(0)})
    it = spark.createDataFrame([(i, "s", t) for i, t in ITEMS.items()] + [(90, "s", None), (91, "s", ""), (92, "s", "ab cd")], "item_id long, suite string, text string").withColumn("doc_id", F.lit(5))
    found = leakage.leaks(d, it, keys)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    report = leakage.leak_report(found, it).first()
    assert report["n_leaked_items"] == 12 and report["n_documents"] == 36
    assert leakage.leaks(d.limit(0), it, keys).count() == 0 and leakage.leaks(d, it.limit(0), keys).count() == 0


def test_verbatim_passage_after_edited_words(spark):
    item = prose(60, 77)
    sparse = [w if k % 6 < 3 else f"other{k}" for k, w in enumerate(item)]
    docs = {
        1: item[:3] + [f"new{k}" for k in range(6)] + item[9:25],  # three words, six changed ones, sixteen word for word
        2: sparse[:30] + item[30:],  # half edited, half word for word
        3: item[:30] + sparse[30:],
        4: sparse,
        5: item[:3] + [f"new{k}" for k in range(6)] + item[9:20],
        6: "so on and on and on".split() + ["so"] * 20,
    }
    at = leakage.places_of(item)
    found = {k: leakage.is_leak(ws, item, at) for k, ws in docs.items()}
    assert {k for k, v in found.items() if v} == {1, 2, 3}
    assert found[1] == (16, 1.0) and found[2][0] >= 30 and found[3][0] >= 30
    periodic = ["ha"] * 20 + item[:5]
    assert leakage.is_leak(["so", *periodic], periodic) == (25, 1.0)
    d = spark.createDataFrame([(k, " ".join(ws)) for k, ws in docs.items()], "doc_id long, text string")
    it = spark.createDataFrame([(1, "s", " ".join(item))], "item_id long, suite string, text string")
    assert {r["doc_id"] for r in leakage.leaks(d, it).collect()} == {1, 2, 3}


def test_words():
    assert words("C​afé &amp; <b>C0DE</b> м-o—х 2024") == ["cafe", "code", "m", "o", "x", "2024"]


def test_schedule_pieces_add_up():
    p = mixing.curriculum({"a": [(0.2, 1), (0.6, 3)], "b": [], "c": [(0, 0)], "d": [(0, 0), (0.5, 0), (1, 2)]})
    for s in "abcd":
        mine = [x for x in p if x[0] == s]
        assert abs(mine[-1][6] - 1) < 1e-12 and all(abs((t1 - t0) * (w0 + w1) / 2 - (c1 - c0)) < 1e-12 for _, t0, t1, w0, w1, c0, c1 in mine)


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRIPE", 20)
    docs = [(i, ["Chat-Log", " chat_log", "CHAT_LOG"][i % 3], "word " * (1 + i % 7)) for i in range(150)] + [(1000 + i, "readme", "tiny text here") for i in range(10)] + [(2000, None, "x"), (2001, "other", "x"), (2002, "readme", None), (2003, "readme", "")]
    targets = spark.createDataFrame([("chat_log", 0.5, 1), ("README", 0.4, 3), ("absent", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumns({"stripe": F.lit(0), "upto": F.lit(0)})
    uses, shares = mixing.assign(d, targets, {"chat_log": [(0, 2), (1, 0)]})
    u = uses.toPandas()
    assert (u["position"].diff().dropna() >= 0).all() and u["position"].between(0, 1).all()
    assert u.groupby(["doc_id"]).size().max() <= 3 and set(u["source"]) == {"chat_log", "readme"} and not set(u["doc_id"]) & {2000, 2001, 2002, 2003}
    s = {r["source"]: r for r in shares.collect()}
    assert s["absent"]["used_tokens"] == 0 and s["absent"]["unmet_tokens"] == s["absent"]["demand_tokens"] > 0
    for n in ("chat_log", "readme"):
        biggest = u[u["source"] == n]["n_tokens"].max()
        assert abs(s[n]["used_tokens"] - s[n]["granted_tokens"]) <= biggest
    chat = u[u["source"] == "chat_log"]
    assert 0.68 < chat[chat["position"] <= 0.5]["n_tokens"].sum() / chat["n_tokens"].sum() < 0.82
    big = mixing.assign(d, targets, budget=10_000.0)[1].where("source='readme'").first()
    assert big["most_uses"] == 3 and big["used_tokens"] == 3 * big["supply_tokens"] and big["unmet_tokens"] > 0
    for empty in (mixing.assign(d.limit(0), targets), mixing.assign(d, targets.limit(0))):
        assert empty[0].count() == 0


GOOD_LINES = ["the loader binds the {} before the {} runs", "we moved the {} out of the {}", "please rename the {}, the old name hides a {}", "i hate how slow the {} is", "the list of bad words, such as idiot, is for the {} filter"]
BAD_LINES = ["you are a stupid idiot, leave the {} alone", "shut up, you worthless fool", "nobody wants you here, you stupid pig", "only an idiot like you breaks the {}"]


def corpus(n, seed):
    r = random.Random(seed)
    fill = lambda x: x.format(r.choice(VOCABULARY), r.choice(VOCABULARY))
    out = []
    for i in range(n):
        bad = i % 4 == 0
        lines = [fill(r.choice(GOOD_LINES)) for _ in range(r.randint(1, 5))]
        if bad:
            lines.insert(r.randrange(len(lines) + 1), fill(r.choice(BAD_LINES)))
        out.append((i, "\n".join(lines), int(bad)))
    return out


def test_abuse_held_out(spark):
    docs = corpus(400, 1)
    r = random.Random(2)
    labels = [(i, y if r.random() > 0.05 else 1 - y) for i, _, y in docs]  # raters err
    test = corpus(200, 3)
    tricks = [(900, "you are a s t u p i d  i d i o t, leave the bon alone", 1), (901, "y0u are a stup1d idi0t, leave the bon alone", 1), (902, "you are a stu​pid idiiiot, leave the bon alone", 1)]
    d = spark.createDataFrame([(i, t, "A-b ") for i, t, _ in docs] , "doc_id long, text string, source string")
    model = abuse.fit(d, spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, abusive int"))
    t = spark.createDataFrame([(i, x, "A-b " if i % 2 else None) for i, x, _ in test + tricks] + [(990, None, "c"), (991, "", "c"), (992, "ok " * 200_000, "c")], "doc_id long, text string, source string").withColumn("score", F.lit(0))
    got = {r["doc_id"]: r for r in abuse.scored(t, model).collect()}
    hit = {i for i, r in got.items() if r["abusive"]}
    truth = {i for i, _, y in test + tricks if y}
    assert len(hit & truth) / len(truth) >= 0.9 and len(hit & truth) / len(hit) >= 0.9 and {900, 901, 902} <= hit
    assert got[990]["score"] is None and not got[990]["abusive"] and not got[991]["abusive"]
    assert {r["source"] for r in abuse.rates(abuse.scored(t, model)).collect()} == {"a_b", "unknown", "c"}
    nothing = abuse.fit(d, spark.createDataFrame([], "doc_id long, abusive int"))
    assert abuse.scored(t, nothing).where("abusive").count() == 0 and abuse.scored(t.limit(0), nothing).count() == 0


def test_all_of_a_long_sentence_is_scored():
    filler = " ".join(f"plain{VOCABULARY[k % 97]}" for k in range(120_000))
    assert len(filler) > 1_050_000
    read = abuse.sentences(filler + " zz bad end of it")
    assert any(s.endswith("zz bad end of it") for s in read) and max(map(len, read)) <= abuse.LONGEST
    rnd = random.Random(3)
    for text in (" ".join(prose(3_000, 5)), "".join(rnd.choice("abcdefg") for _ in range(9_000)), "a" * abuse.LONGEST, "word"):
        parts, at = abuse.pieces(text), 0
        assert max(map(len, parts)) <= abuse.LONGEST and (len(parts) == 1) == (len(text) <= abuse.LONGEST)
        for p in parts:  # each piece begins inside the one before, or at its end
            begin = text.index(p, max(0, at - 2 * abuse.OVERLAP))
            assert begin <= max(0, at - abuse.OVERLAP)
            at = begin + len(p)
        assert at == len(text)


def test_long_words_tags_and_texts_are_read_whole_and_soon():
    began = time.time()
    for token in ("a" * 2_000_000, "1" * 2_000_000, "aB1" * 600_000):
        read = abuse.sentences(f"{token} zz bad end of it")
        assert read[-1].endswith("zz bad end of it")
    comment, tag = "<!--" + "hidden words " * 200 + "-->", '<div class="' + "c " * 300 + '" data-x=\'1\' hidden>'
    assert words(f"one {comment} two {tag} three a <b and c> d <!-- open") == ["one", "two", "three", "a", "d", "open"]
    assert words("x <b " + "word, " * 100 + "> y")[:3] == ["x", "b", "word"]  # too long, and no attributes
    assert abuse.sentences("see `" + "some code " * 20 + "` please") == ["see 8 please"]
    assert time.time() - began < 30


def test_tokens_of_a_long_text_are_those_of_one_encoding(spark):
    text = " ".join(prose(100_000, 8)) + "  " + "x" * 50_000
    assert len(text) > 400_000
    got = spark.createDataFrame([(1, text), (2, None), (3, "")], "i int, t string").select("i", mixing.token_counts(F.col("t")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {1: len(mixing._encoder(mixing.VOCABULARY).encode_ordinary(text)), 2: 0, 3: 0}
