import random

import __spark_entry__


def test_compatible_pairs_of_all_properties_and_sessions(spark, tmp_path):
    """Against brute force: ten properties, parents that differ by session, loops, a type of one session only."""
    rng = random.Random(6)
    types = [f"T{k}" for k in range(9)]
    concepts = [(s, t, rng.choice([None, *types])) for s in ("s1", "s2", "s3") for t in types[: 9 if s == "s3" else 7]]
    concepts += [("s1", "T0", "T5"), ("s1", "T0", None), ("s2", "T1", "T2"), ("s2", "T2", "T1")]
    nodes = [(f"n{k}", types[k % 9]) for k in range(12)] + [("n0", "T8")]
    edges = [(rng.choice(["leads", "works_at", "knows", "part_of"]), f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(5)]
    for name, rows, schema in (("concepts", concepts, "session_id string, type string, parent string"), ("nodes", nodes, "id string, type string"), ("edges", edges, "type string, from string, to string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    def ancestors(s, t):
        seen, todo = {t}, [t]
        while todo:
            x = todo.pop()
            for y in {p for q, c, p in concepts if q == s and c == x and p} - seen:
                seen.add(y)
                todo.append(y)
        return seen

    joined = {(d, r) for _, f, t in edges for i, d in nodes if i == f for j, r in nodes if j == t}
    want = set()
    for s in ("s1", "s2", "s3"):
        own = sorted({t for q, t, _ in concepts if q == s})
        up = {t: ancestors(s, t) for t in own}
        want |= {(s, a, b) for a in own for b in own if any((x, y) in joined or (y, x) in joined for x in up[a] for y in up[b])}
    got = __spark_entry__.queries()["sch_compatible_all"](spark, str(tmp_path)).collect()
    assert {(r.session_id, r.a, r.b) for r in got} == want and len(got) == len(want)
    assert 0 < len(want) < 9 * 9 + 7 * 7 * 2


def test_loops_stop_the_walk(spark):
    """A concept on a loop or below one keeps what it meets once; parents are matched as written."""
    from graphloom.operators import ontology as O

    links = {"a": "b", "b": "c", "c": "a", "d": "b", "e": None, "f": "e", "g": "E", "h": "h", "i": "nowhere"}
    rows = [("s", k, t, p, [t.upper()]) for k, (t, p) in enumerate(links.items())] + [("t", 0, "a", None, None), (None, 0, "x", "y", ["X"]), (None, 1, "y", "x", ["Y"])]
    c = spark.createDataFrame(rows, "session_id string, pos int, type string, parent string, attributes array<string>")

    def walk(t):
        out = []
        while t in links and t not in out:
            out.append(t)
            t = links[t]
        return out

    want = {("s", t): "".join(x.upper() for x in reversed(walk(t))) for t in links} | {("t", "a"): "", (None, "x"): "YX", (None, "y"): "XY"}
    assert {(r.session_id, r.type): "".join(r.attributes) for r in O.flatten(c).collect()} == {k: v for k, v in want.items()}
    assert {(r.type, r.ancestor) for r in O.ancestors(c.where("session_id = 's'")).collect()} == {(t, x) for t in links for x in walk(t)}
    assert O.ancestors(c.limit(0)).count() == 0


def test_closure_folds_a_knot(spark, monkeypatch):
    """Of types that all lead to each other no table holds the pairs before the result does: joined pair by pair they cost the cube of their number."""
    from graphloom.operators import ontology as O

    rng = random.Random(3)
    n, held = 200, []
    links = {(f"k{i}", f"k{(i + 1) % n}") for i in range(n)} | {(f"k{i}", f"k{rng.randrange(n)}") for i in range(n) for _ in range(4)} | {(f"k{i}", "k0") for i in range(0, n, 2)} | {("k0", f"k{i}") for i in range(0, n, 9)}
    links |= {("below", "k7"), ("k9", "above")}
    cut = O.cut
    monkeypatch.setattr(O, "cut", lambda d, *a: (t := cut(d, *a), held.append(t.count()))[0])
    got = {(r.type, r.ancestor) for r in O.closure(spark.createDataFrame(sorted(links), "type string, parent string")).collect()}
    knot = [f"k{i}" for i in range(n)]
    assert got == {(a, b) for a in [*knot, "below"] for b in [*knot, "above"]} | {("below", "below")}
    assert max(held) < len(got) / 10


def test_closure_against_brute_force(spark):
    """Rings without a hub, nested and joined loops, a chain, a hub off the loops, a type that is null, parents that are no types, rows without a session."""
    from graphloom.operators import ontology as O

    rng = random.Random(5)
    links = [("s", f"r{i}", f"r{(i + 1) % 23}") for i in range(23)] + [("s", f"q{i}", f"q{(i + 1) % 6}") for i in range(6)] + [("s", "r4", "q1"), ("s", "q3", "c0"), ("s", "c9", "q5")]
    links += [("s", f"c{i}", f"c{i + 1}") for i in range(12)] + [("s", "h", f"u{i}") for i in range(20)] + [("s", f"d{i}", "h") for i in range(20)]
    links += [("t", f"x{i}", rng.choice([None, "", *[f"x{k}" for k in range(25)]])) for i in range(25) for _ in range(2)]
    links += [("t", None, "x1"), ("t", None, None), (None, "r1", "r9"), ("t", "r1", "r9"), ("t", "same", "same")]
    d = spark.createDataFrame(links, "session_id string, type string, parent string")

    def want(rows):
        up = {}
        for t, p in rows:
            up.setdefault(t, set()).update({p} - {None})
        out = set()
        for t in up:
            seen, todo = {t}, [t]
            while todo:
                new = up.get(todo.pop(), set()) - seen
                seen |= new
                todo += new
            out |= {(t, a) for a in seen}
        return out

    got = [tuple(r) for r in O.closure(d, ("session_id",)).select("session_id", "type", "ancestor").collect()]
    assert len(got) == len(set(got)) and set(got) == {(s, *x) for s in ("s", "t") for x in want([(t, p) for q, t, p in links if q == s])}
    got = [tuple(r) for r in O.closure(d.select("type", "parent")).collect()]
    assert len(got) == len(set(got)) and set(got) == want([(t, p) for _, t, p in links])
    assert O.closure(d.limit(0)).count() == 0
