import random

from graphloom.operators.hierarchy import CYCLE, descendants, hierarchy

SCHEMA = "session_id string, type string, parent string, depth string"


def by_hand(rows):
    norm = lambda x: x.strip().lower() or None if x is not None else None
    up = {(s, norm(t)): (t, norm(p)) for s, t, p, _ in rows}
    out = {}
    for (s, k), (t, p) in up.items():
        seen, at, d = {k}, k, 0
        while (nxt := up[s, at][1]) is not None and (s, nxt) in up:
            if nxt in seen:
                d = -1
                break
            seen.add(nxt)
            at, d = nxt, d + 1
        out[s, t] = (up[s, at][0], d) if d >= 0 else (CYCLE, -1)
    return out


def test_random_forests_equal_a_walk(spark):
    rng = random.Random(2)
    rows = []
    for s in ("a", "b"):
        names = [f"T{s}{i}" for i in range(80)]
        for i, n in enumerate(names):
            p = rng.choice([None, "", "  ", "nowhere", *([names[i - 1]] * 12 if i else []), *rng.sample(names, 2)])
            rows.append((s, n, rng.choice([str.lower, str.upper, lambda x: f" {x} "])(p) if p else p, "x"))
    got = {(r.session_id, r.type): (r.root, r.depth) for r in hierarchy(spark.createDataFrame(rows + rows[:9], SCHEMA)).collect()}
    assert got == by_hand(rows)


def test_long_chain_paths_and_descendants(spark):
    rows = [("s", f"c{i}", f"c{i - 1}" if i else None, "") for i in range(40)]
    tree = hierarchy(spark.createDataFrame(rows, SCHEMA))
    last = tree.where("type = 'c39'").first()
    assert last.depth == 39 and last.path == [f"c{i}" for i in range(40)]
    d = descendants(tree)
    assert d.count() == 40 * 41 // 2 and d.where("ancestor = 'c5' and descendant = 'c9'").first().distance == 4


def test_dirty_and_empty(spark):
    rows = [(None, "A", "b", ""), (None, "B", None, ""), ("s", None, "A", ""), ("s", "A", "A", ""), ("s", "Below", " a ", "")]
    got = {(r.session_id, r.type): (r.root, r.depth, r.path) for r in hierarchy(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(None, "A"): ("B", 1, ["B", "A"]), (None, "B"): ("B", 0, ["B"]), ("s", "A"): (CYCLE, -1, None), ("s", "Below"): (CYCLE, -1, None)}
    assert hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_parent_is_salted(spark):
    rows = [("s", f"c{i}", "root2", "") for i in range(300)] + [("s", "root2", "root", ""), ("s", "root", None, "")]
    got = hierarchy(spark.createDataFrame(rows, SCHEMA), paths=False)
    assert got.where("root = 'root' and depth = 2").count() == 300
