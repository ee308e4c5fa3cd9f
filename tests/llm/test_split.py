import random
import re

import numpy as np

from graphloom.llm.split import TOKEN, _pieces, greedy_cuts, split_oversized


def by_hand(begin, end, natural, limit, overlap):
    out = []
    for b, e in zip(begin, end):
        s = b
        while e - s > limit:
            ok = [x for x in natural if s + overlap < x <= s + limit and x < e]
            to = max(ok) if ok else s + limit
            out.append((s, to))
            s = to - overlap
        out.append((s, e))
    return out


def test_cuts_equal_a_sequential_loop():
    rng = random.Random(3)
    for _ in range(300):
        sizes = [rng.randint(1, 400) for _ in range(rng.randint(1, 4))]
        end = np.cumsum(sizes)
        begin = end - sizes
        limit = rng.randint(3, 40)
        overlap = rng.randint(0, limit - 1)
        natural = np.array(sorted(set(range(end[-1])) & set(rng.sample(range(end[-1]), min(end[-1], rng.randint(0, 30))))), dtype=np.int64)
        natural = natural[~np.isin(natural, begin)]
        a, b = greedy_cuts(begin, end, natural, limit, overlap)
        assert list(zip(a.tolist(), b.tolist())) == by_hand(begin.tolist(), end.tolist(), natural.tolist(), limit, overlap)


def test_round_trip_and_limits():
    rng = random.Random(5)
    alphabet = ["word", "x1", ".", "!", "\n", "\n\n", " ", "\t", "漢", "字", "。", "é", "”", "😀", "_a", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 600))) for _ in range(60)] + ["", "   ", "a" * 5000, "漢" * 2000]
    k, pieces, a, b, n = _pieces(texts, 50, 7)
    for i, t in enumerate(texts):
        spans = [m.span() for m in re.finditer(TOKEN, t)]
        assert n[i] == len(spans)
        mine = [(p, x, y) for j, p, x, y in zip(k, pieces, a, b) if j == i]
        if not spans:
            assert not mine
            continue
        whole, done = "", 0
        for p, x, y in mine:
            assert len(re.findall(TOKEN, p)) == y - x <= 50
            assert x == (done - 7 if done else 0)
            skip = [m.start() for m in re.finditer(TOKEN, p)][7] if done else 0
            whole, done = whole + p[skip:], y
        assert whole == t and done == len(spans)


def test_cuts_at_pauses(spark):
    text = "One two three four. Five six seven eight nine ten. Eleven twelve"
    rows = spark.createDataFrame([("f", 0, text, 10, 24, 1)], "source_file string, chunk_index int, text string, token_start int, token_end int, piece int")
    got = [tuple(r)[3:] for r in split_oversized(rows, ["source_file", "chunk_index"], 8, 2).orderBy("piece").collect()]
    assert [g[0] for g in got] == ["One two three four. ", "four. Five six seven eight nine ten", "nine ten. Eleven twelve"]
    assert [g[1:] for g in got] == [(10, 15, "given"), (13, 21, "given"), (19, 24, "given")]


def test_pieces_join_to_their_text(spark):
    from graphloom.llm.split import joined_pieces

    rng = random.Random(9)
    texts = ["".join(rng.choice(["word", "x_1", ".", "\n", " ", "\t", "漢", "é", "😀", "  "]) for _ in range(rng.randint(40, 400))) for _ in range(30)]
    rows = [("f", i, t, None, None) for i, t in enumerate(texts)] + [("f", 0, texts[0], 1, 2)]
    df = spark.createDataFrame(rows, "source_file string, chunk_index int, text string, token_start int, token_end int")
    got = joined_pieces(split_oversized(df, ["source_file", "chunk_index"], 20, 6), ["source_file", "chunk_index"], 6).collect()
    assert {r.chunk_index: r.text for r in got} == {i: t for i, t in enumerate(texts) if len(re.findall(TOKEN, t)) > 20}
    assert max(r.longest for r in got) <= 20 and len(got) > 20


def test_dirty_rows(spark):
    long = "w " * 30
    schema = "source_file string, chunk_index int, text string, token_start int, token_end int, offsets string"
    rows = [("a", 0, None, 0, 1, "x"), ("a", 1, "", 0, 0, None), ("a", 2, "  \n", None, None, ""), (None, None, long, None, 5, "x"), ("b", 0, long, 60, 30, "x"), ("b", 0, long, 60, 30, "x"), ("c", 1, long, 5, 35, "x")]
    got = split_oversized(spark.createDataFrame(rows, schema), ["source_file", "chunk_index"], 20, 5).collect()
    assert {(r.source_file, r.piece, r.token_start, r.token_end, r.offsets) for r in got} == {
        (None, 0, 0, 20, "local"), (None, 1, 15, 30, "local"), ("b", 0, 30, 50, "swapped"), ("b", 1, 45, 60, "swapped"), ("c", 0, 5, 25, "given"), ("c", 1, 20, 35, "given"),
    }
    assert len(got) == 8
    assert split_oversized(spark.createDataFrame([], schema), ["source_file"]).count() == 0
