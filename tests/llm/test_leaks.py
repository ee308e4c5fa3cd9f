import random

import numpy as np

from graphloom.llm import leaks
from graphloom.llm.leaks import LEAST, Items, leaked_items, letters, shingles


def words(rng, n):
    return ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n)]


def test_letters():
    assert letters("Ein Übel-\nstand: straße №1 — “naïve”, 漢字") == "einubelstandstrasseno1naive漢字".encode()
    assert letters(None) == letters("") == letters(" \n-") == b""


def test_found_and_not_found(spark):
    rng = random.Random(1)
    items = [(i, " ".join(words(rng, 90))) for i in range(30)]
    docs = []
    for i, (_, t) in enumerate(items):
        w = t.split()
        around = words(rng, 300)
        part = w[20:60]
        altered = [x.upper() + ("," if k % 3 else "") if k % 9 else x[:-1] + "x" for k, x in enumerate(part)]
        if i % 3 == 0:
            docs.append((i, " ".join(around[:150] + altered + around[150:]), True))
        elif i % 3 == 1:  # interrupted once
            docs.append((i, " ".join(around[:50] + part[:20] + around[50:110] + part[20:] + around[110:]), True))
        else:  # scattered phrases, and too short a passage
            docs.append((i, " ".join(sum((part[k : k + 3] + around[k * 6 : k * 6 + 18] for k in range(0, 40, 3)), []) + w[:15]), False))
    docs += [(100, None, False), (101, "", False), (102, "x" * 30000, False), (103, docs[0][1], False)]
    rows = spark.createDataFrame([(d, t, "x") for d, t, _ in docs], "doc_id long, text string, share string")
    got = {(r.doc_id, r.item_id) for r in leaked_items(rows, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, d) for d, _, yes in docs if yes} | {(103, 0)}


def test_several_passes_and_empty_tables(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, 40))) for i in range(12)] + [(50, None), (51, ""), (52, "short")]
    docs = spark.createDataFrame([(i, t) for i, t in items[:12]], "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(leaks, "PASS_BYTES", 1000)
    assert sorted((r.doc_id, r.item_id) for r in leaked_items(docs, it).collect()) == [(i, i) for i in range(12)]
    assert leaked_items(docs.limit(0), it).count() == 0
    assert leaked_items(docs, it.limit(0)).count() == 0


def test_minhash_finds_what_exact_search_finds():
    rng = random.Random(3)
    texts = [" ".join(words(rng, rng.choice([30, 80, 150]))) for _ in range(40)]
    own = Items(list(range(40)), texts)
    docs = []
    for k in range(200):
        w = texts[k % 40].split()
        a = rng.randrange(len(w) // 2)
        part = [x if rng.random() < 0.9 else x + "q" for x in w[a : a + len(w) * 2 // 5 + 1]]
        docs.append(" ".join(words(rng, 100) + part + words(rng, 100)))
    grams = [shingles(letters(t)) for t in docs]
    doc = np.repeat(np.arange(len(docs)), [len(g) for g in grams])
    pairs = set(own.search(own.masked(np.concatenate(grams)), doc).tolist())
    exact = {d * 40 + i for d in range(len(docs)) for i in range(40) if own.share(grams[d], i) >= LEAST}
    assert len(exact) > 150 and exact <= pairs


def test_light_pieces_among_many_heavy_ones():
    """An altered passage is a chain of light pieces; hundreds of heavier scattered ones must not hide it."""
    rng = random.Random(4)
    item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    fresh = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    scattered = "".join(item[a : a + 40] + fresh(30) for a in (rng.randrange(2960) for _ in range(400)))
    altered = "".join(item[a : a + 30] + fresh(1) for a in range(600, 1848, 31))
    own = Items([1], [item])
    assert own.share(shingles(scattered.encode()), 0) < LEAST
    for text in (altered, scattered + altered, scattered + fresh(2000) + altered + fresh(2000) + scattered):
        assert own.share(shingles(text.encode()), 0) >= 0.4


def test_thin_start_does_not_hide_a_dense_passage():
    """A chain that reaches farther back over thin pieces has more shingles and is not dense enough; the passage after them is."""
    rng = random.Random(5)
    item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    fresh = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    thin = "".join(item[a : a + 15] + fresh(100) for a in range(0, 1495, 115))
    dense = "".join(item[a : a + 30] + fresh(1) for a in range(1495, 2735, 31))
    own = Items([1], [item])
    assert own.share(shingles((thin + dense).encode()), 0) >= 0.4


def test_copies_and_near_copies_of_an_item_are_found(spark, monkeypatch):
    """Six ids of one text, five near-copies of another, and a line of instruction in all, which is no leak in one pass or in several."""
    rng = random.Random(7)
    line = " ".join(words(rng, 60))
    texts = [" ".join(words(rng, 90)) for _ in range(8)]
    near = [" ".join(w if rng.random() < 0.98 else "other" for w in texts[1].split()) for _ in range(5)]
    items = [(k, f"{line} {texts[0]}" if k % 2 else f"{line.upper()}, {texts[0]}!") for k in range(6)]
    items += [(10 + k, f"{line} {t}") for k, t in enumerate(near)] + [(20 + k, f"{line} {t}") for k, t in enumerate(texts[2:])]
    around = [" ".join(words(rng, 200)) for _ in range(5)]
    docs = [(k, f"{around[k]} {t} {around[k]}") for k, t in enumerate(texts[:4])] + [(9, f"{around[4]} {line} {around[4]}")]
    want = {(0, k) for k in range(6)} | {(1, 10 + k) for k in range(5)} | {(2, 20), (3, 21)}
    rows, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (8_000_000, 2000):
        monkeypatch.setattr(leaks, "PASS_BYTES", size)
        got = [(r.doc_id, r.item_id) for r in leaked_items(rows, it).collect()]
        assert set(got) == want and len(got) == len(want)
