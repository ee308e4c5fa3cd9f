import random
from datetime import datetime, timedelta

import pytest

from graphloom.operators.references import orphan_counts, orphan_references, parent_spans, references

T0 = datetime(2024, 1, 1)
EDGE = "id string, `from` string, `to` string, ingested_at timestamp_ntz, cell int, h string"
NODE = "id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz, key string"


def day(n):
    return None if n is None else T0 + timedelta(days=n)


@pytest.mark.parametrize("cell_rows", [200_000, 40])
def test_random_tables_equal_a_nested_loop(spark, cell_rows):
    rng = random.Random(7)
    ids = [f"n{i}" for i in range(30)] + ["", " ", "é"]
    nodes = [(rng.choice(ids), day(rng.randint(0, 20)), day(rng.choice([None, None, rng.randint(1, 30)])), "x") for _ in range(60)] + [(None, day(1), None, "x"), ("n1", None, None, "x")]
    hot = "n3"
    edges = [(f"e{i}", rng.choice([hot, hot, None, "", *ids, "N3", "n3 "]), rng.choice([*ids, "gone"]), day(rng.choice([None, *range(25)])), 1, "h") for i in range(200)]
    edges += edges[:10]
    want = set()
    for e in edges:
        for end, key in (("from", e[1]), ("to", e[2])):
            there = e[3] is not None and any(n[0] == key and n[1] is not None and n[1] <= e[3] and (n[2] is None or n[2] > e[3]) for n in nodes)
            if key is not None and not there:
                want.add((e[0], end))
    o = orphan_references(references(spark.createDataFrame(edges, EDGE)), parent_spans(spark.createDataFrame(nodes, NODE)), cell_rows)
    assert {(r.ref_id, r.endpoint) for r in o.collect()} == want
    c = orphan_counts(o)
    assert c.agg({"references": "sum"}).first()[0] >= len(want) - 10 and {r.table for r in c.collect()} == {"edges"}


def test_empty_tables(spark):
    e, n = spark.createDataFrame([], EDGE), spark.createDataFrame([], NODE)
    one = spark.createDataFrame([("e", "a", None, day(1), 1, "")], EDGE)
    assert orphan_references(references(e), parent_spans(n)).count() == 0
    assert [(r.ref_id, r.endpoint) for r in orphan_references(references(one), parent_spans(n)).collect()] == [("e", "from")]
