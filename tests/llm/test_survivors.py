import random
from datetime import datetime

from graphloom.llm.survivors import by_posterior, by_trust, candidates, surviving_records

NODE = "node_key long, session_id string, id string, confidence double, attributes map<string,struct<value:string,confidence:double>>, source_files array<string>, ingested_at timestamp_ntz, attr string, value string"
NAN = float("nan")


def node(key, i, conf, attrs, files=("f",), day=1):
    return (key, "s", i, conf, None if attrs is None else {a: (v, c) for a, (v, c) in attrs.items()}, None if files is None else list(files), datetime(2024, 1, day) if day else None, "x", "y")


def test_order_of_trust(spark):
    rows = [
        node(1, "a", 0.5, {"n": ("one", 0.5)}), node(2, "a", 0.4, {"n": ("two", 0.6)}), node(3, "a", 0.9, {"n": ("n/a", 1.0), "m": (" ", 1.0)}),
        node(4, "b", NAN, {"n": ("x", 0.5)}), node(5, "b", 7.0, {"n": ("y", 0.5)}, day=2), node(6, "b", -1.0, {"n": ("z", 0.5)}, ("f", "f", " ", ""), day=2),
        node(7, "c", 0.5, {"n": ("x", NAN)}, ("f", "g")), node(8, "c", 0.5, {"n": ("y", 9.0)}, ("f",)), node(8, "c", 0.5, {"n": ("y", 9.0)}, ("f",)), node(9, "c", 0.5, {"n": ("z", 0.0)}, None),
        node(10, "d", 1.0, {"n": ("alone", 1.0)}), node(10, "d", 1.0, {"n": ("alone", 1.0)}),
        node(11, "e", None, {"n": ("p", None)}, day=None), node(12, "e", None, {"n": ("q", None)}, day=None), node(13, None, 1.0, {"n": ("r", 1.0)}), node(14, "e", 1.0, None),
    ]
    df = spark.createDataFrame(rows, NODE)
    got = {(r.id, r.attr): r.node_key for r in by_trust(candidates(df)).collect()}
    assert got == {("a", "n"): 2, ("b", "n"): 5, ("c", "n"): 9, ("e", "n"): 11}
    assert {r.id: r.attributes for r in surviving_records(by_trust(candidates(df))).collect()}["a"] == {"n": "two"}
    assert by_trust(candidates(df.limit(0))).count() == 0 and by_posterior(candidates(df.limit(0))).count() == 0


def test_copied_votes_count_less(spark):
    """Two sources copy a bad one. Where many others speak the copies give themselves away; where only two do, three copied votes must not win."""
    rng = random.Random(3)
    rows, key = [], 0
    for i in range(80):
        wrong = f"wrong{rng.randint(0, 3)}" if rng.random() < 0.5 or i >= 60 else "right"
        good = [f"good{k}" for k in range(5 if i < 60 else 2)]
        values = {"bad": wrong, "copy1": wrong, "copy2": wrong} | {g: "right" if rng.random() < 0.9 or i >= 60 else f"odd{rng.randint(0, 9)}" for g in good}
        for s, v in values.items():
            key += 1
            rows.append(node(key, f"e{i}", 0.8, {"v": (v, 0.8)}, (s,)))
    got = by_posterior(candidates(spark.createDataFrame(rows, NODE))).collect()
    assert len(got) == 80 and all(0 <= r.posterior <= 1 for r in got)
    assert sum(r.value == "right" for r in got) >= 78


def test_repeated_rows_and_ties(spark):
    rows = [node(1, "a", 0.5, {"v": ("x", 0.5)}, ("f",)), node(2, "a", 0.5, {"v": ("X ", 0.5)}, ("g",)), node(3, "a", 0.5, {"v": ("y", 0.5)}, ("h",))]
    one = by_posterior(candidates(spark.createDataFrame(rows, NODE))).first()
    again = by_posterior(candidates(spark.createDataFrame(rows * 3, NODE))).first()
    assert (one.value, one.n_sources, one.node_key) == (again.value, again.n_sources, again.node_key) == ("x", 2, 1)


def test_copies_are_found_where_a_third_source_leads(spark):
    """Five sources copy each other, and every false value they share is led by another, more accurate source that they met never before."""
    rows, key = [], 0
    for i in range(205):
        wrong, contested = i % 10 < 3, i >= 200
        values = {f"good{k}": "right" if contested or (i + 7 * k) % 20 else f"odd{k}" for k in range(3 if contested else 9)}
        values |= {f"copy{k}": "wrong" if wrong or contested else "right" for k in range(5)}
        if wrong or contested:
            values[f"z{i}"] = "wrong"
        else:
            values |= {f"z{k}": "right" for k in range(205) if (k % 10 < 3 or k >= 200) and (k + i) % 20 == 0}
        for s, v in values.items():
            key += 1
            rows.append(node(key, f"e{i}", 0.8, {"v": (v, 0.8)}, (s,)))
    got = {r.id: r.value for r in by_posterior(candidates(spark.createDataFrame(rows, NODE))).collect()}
    assert len(got) == 205 and all(v == "right" for v in got.values())
