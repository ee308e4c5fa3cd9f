import random

from pyspark.sql import functions as F

from graphloom.functions.text import clamp, duration, edge_key, label_name, relation_name, slug, snake, stable_id, without_fence
from graphloom.operators import assemble as A
from graphloom.operators import validate as V


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_identity(spark):
    assert one(spark, "  Jean-Luc  Ünal!  ", slug) == "jeanluc-nal"
    assert one(spark, "Ann  Lee", lambda x: stable_id(F.lit("Soft Eng."), x)) == "softeng-ann-lee"
    assert one(spark, "?!", lambda x: stable_id(F.lit("T"), x)) == "t-"
    assert len(one(spark, "a", lambda x: edge_key(x, x, x))) == 64
    assert [one(spark, t, snake) for t in ("worksAt", "part of-X")] == ["works_at", "part_of_x"]
    assert one(spark, "HTTPServer2 x", label_name) == "HttpServer2X" and one(spark, "worksAt", relation_name) == "WORKS_AT" and one(spark, "", label_name) == "" and one(spark, "12 1a bC", label_name) == "ABC" and one(spark, "1a", relation_name) == "1_A"
    assert one(spark, "```json\n{}\n```", without_fence) == "{}" and one(spark, 3725, duration, "int") == "1h 02m 05s"


def test_clamp(spark):
    values = {"0.5": 0.5, "2": 1.0, "-1": 0.0, "nan": 1.0, "1_0": 0.0, "0.5f": 0.0, "x": 0.0, None: 0.0, " .25 ": 0.25}
    got = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in values], "x string").select("x", clamp(F.col("x"))).collect()}
    assert got == values


def fold(occ):
    top = max(c for _, c in occ)
    rows = [v for v, c in occ if c == top]
    acc = rows[0]
    if top == 1.0:
        for v in rows[1:]:
            if acc is not None and v is not None and v != acc:
                acc = f"{acc}; {v}"
    return acc, top


def test_attribute_conflicts_equal_a_fold(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for g in range(60):
        occ = [(rng.choice(["A", "B", "C", None]), rng.choice([0.0, 0.5, 1.0, 1.0])) for _ in range(rng.randint(1, 7))]
        want[f"g{g}"] = fold(occ)
        rows += [(f"g{g}", "f", i, v, c, True) for i, (v, c) in enumerate(occ)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "stable_id string, source_file string, pos int, value string, confidence double, is_text boolean")
    assert {r.stable_id: (r.value, r.confidence) for r in A.merge_attributes(df, ["stable_id"]).collect()} == want


def test_nodes_edges_and_endpoints(spark):
    schema = "source_file string, pos int, raw_id string, type string, name string, confidence string, aliases array<string>"
    nodes = A.with_stable_ids(spark.createDataFrame([("b", 0, "n1", "P", "Ann", "0.4", ["A."]), ("a", 1, "n1", "P", "ann", "0.8", None), ("a", 0, "n2", "P", "", "bad", ["Ann"])], schema))
    m = {r.stable_id: r for r in A.merge_nodes(nodes).collect()}
    assert m["p-ann"].name == "ann" and m["p-ann"].occurrences == 2 and A.node_files(nodes).where("stable_id = 'p-ann'").count() == 2 and abs(m["p-ann"].confidence - 0.6) < 1e-9 and m["p-ann"].aliases == ["A."]
    assert m["p-n2"].confidence == 0.0 and m["p-n2"].aliases == ["Ann"]
    e = spark.createDataFrame([("a", 0, "k", "n1", "Ann", 0.5), ("a", 1, "k", "p-n2", "zzz", 0.7), ("b", 0, "k", "n1", "Ann", 1.5)], "source_file string, pos int, type string, src string, dst string, confidence double")
    r = A.resolve_endpoints(e, nodes)
    assert sorted((x.src, x.dst) for x in r.collect()) == [("p-ann", "p-ann"), ("p-ann", "p-ann"), ("p-n2", "zzz")]
    g = {(x.src, x.dst): x for x in A.merge_edges(r).collect()}
    assert g["p-ann", "p-ann"].confidence == 0.75 and g["p-ann", "p-ann"].occurrences == 2 and len(g["p-ann", "p-ann"].id) == 11
    assert A.merge_nodes(nodes.limit(0)).count() == 0 and A.merge_edges(e.limit(0)).count() == 0


def test_name_maps(spark):
    m = spark.createDataFrame([("P", "a", "b"), ("P", "b", "a"), ("P", "c", "a"), ("P", "d", "e"), ("Q", "a", "x")], "type string, alias string, canonical string")
    assert sorted((r.type, r.alias) for r in A.drop_cycles(m).collect()) == [("P", "d"), ("Q", "a")]
    nodes = spark.createDataFrame([("P", " D "), ("P", "z"), ("Q", "A"), ("P", None)], "type string, name string")
    assert [r.name for r in A.apply_name_map(nodes, A.drop_cycles(m)).orderBy("type", F.col("name").asc_nulls_first()).collect()] == [None, "e", "z", "x"]
    ok, bad = A.check_name_map(spark.createDataFrame([("P", "b")], "type string, name string"), m.union(spark.createDataFrame([("P", "b", "b"), ("P", None, "b")], m.schema)))
    assert sorted(r.alias for r in ok.collect()) == ["a"] and bad.count() == 5


def test_recover(spark):
    nodes = spark.createDataFrame([("f", 0, "a", "P"), ("f", 1, "b", "P"), ("f", 2, "c", "P"), ("f", 3, "x", "Alien"), ("g", 0, "a", "P")], "source_file string, pos int, raw_id string, type string")
    edges = spark.createDataFrame([("f", 0, "knows", "a", "b", 0.5), ("f", 1, "odd", "a", "c", 0.5), ("f", 2, "knows", "a", "x", None), ("g", 0, "knows", "a", "b", 0.1)], "source_file string, pos int, type string, src string, dst string, confidence double")
    kinds, props = spark.createDataFrame([("P",)], "type string"), spark.createDataFrame([("knows",)], "type string")
    n, e = V.recover(nodes, edges, kinds, props)
    assert sorted((r.source_file, r.raw_id) for r in n.collect()) == [("f", "a"), ("f", "b")] and e.count() == 1
    rules = {(r.source_file, r.rule) for r in V.extraction_errors(nodes, edges, kinds, props).collect()}
    assert rules == {("f", "undeclared node type"), ("f", "undeclared edge type"), ("f", "no confidence"), ("g", "unknown target")}  # b is a node of f only
    prior = spark.createDataFrame([("g", "b")], "source_file string, raw_id string")
    assert "unknown target" not in {r.rule for r in V.extraction_errors(nodes.withColumn("attributes", F.lit(None)), edges, kinds, props, prior).where("rule <> 'no attributes'").collect()}
    assert V.extraction_errors(nodes.withColumn("attributes", F.lit(None)), edges, kinds, props).where("rule = 'no attributes'").count() == 5
    answers = spark.createDataFrame([("a", '{"nodes": [], "edges": []}'), ("b", '{"nodes": [], "x": 1}'), ("c", "[1]"), ("d", None)], "label string, answer string")
    assert {tuple(r) for r in V.structure_errors(answers).collect()} == {("b", "missing key", "edges"), ("b", "unexpected key", "x"), ("c", "no object", None), ("d", "no object", None)}


def test_name_cycles_are_exact(spark):
    m = spark.createDataFrame([("P", "bob", "Bob"), ("P", "Bob", "Robert"), ("P", "x", "y"), ("P", "y", "x"), ("P", "z", " x")], "type string, alias string, canonical string")
    assert sorted(r.alias for r in A.drop_cycles(m).collect()) == ["Bob", "bob", "z"]


def test_merge_log_counts_what_was_joined(spark):
    rows = [("g", "f", 0, "Ann Lee", 1.0, True), ("g", "f", 1, "Bob", 1.0, True), ("g", "f", 2, "Ann", 0.4, True), ("h", "f", 0, "x", 0.5, True), ("h", "f", 1, "y", 0.6, True)]
    df = spark.createDataFrame(rows, "stable_id string, source_file string, pos int, value string, confidence double, is_text boolean")
    log = A.merge_log(df, A.merge_attributes(df, ["stable_id"]), ["stable_id"], "stable_id").collect()
    assert {r.stable_id: (r.winning, r.losing, r.concatenated) for r in log} == {"g": (0, 1, 2), "h": (1, 1, 0)}  # "Ann" lost, though the result contains it


def test_assembly(spark):
    nodes = spark.createDataFrame([("a", 0, "n1", "P", "Bobby", "0.5", ["B."]), ("a", 1, "n2", "O", "Zet", "1", None), ("b", 0, "n9", "P", "Robert", "0.9", None)], "source_file string, pos int, raw_id string, type string, name string, confidence string, aliases array<string>")
    attrs = spark.createDataFrame([("a", 0, "job", "smith", 0.4, True), ("b", 0, "job", "baker", 0.8, True)], "source_file string, pos int, attr string, value string, confidence double, is_text boolean")
    edges = spark.createDataFrame([("a", 0, "at", "n1", "n2", 0.5), ("b", 0, "at", "n9", "zet", 0.7), ("b", 1, "at", "n9", "lost", 0.7)], "source_file string, pos int, type string, src string, dst string, confidence double")
    extra = spark.createDataFrame([("a", 0, "since", "2020", 0.5, True), ("b", 0, "since", "2021", 0.6, True)], attrs.schema)
    norm = spark.createDataFrame([("P", "bobby", "Robert")], "type string, alias string, canonical string")
    prior = spark.createDataFrame([("synonym_collapse", "o-x"), ("node_merge", "o-y")], "event string, id string")
    out = A.assemble(nodes, attrs, edges, extra, norm, prior, "max")
    assert {r.stable_id: (r.confidence, r.aliases) for r in out["nodes"].collect()} == {"p-robert": (0.9, ["B.", "bobby"]), "o-zet": (1.0, None)}
    assert [(r.src, r.dst, r.confidence, r.occurrences) for r in out["edges"].collect()] == [("p-robert", "o-zet", 0.7, 2)]
    assert [r.value for r in out["edge_attributes"].collect()] == ["2021"] and [(r.stable_id, r.value) for r in out["attributes"].collect()] == [("p-robert", "baker")]
    assert sorted((r.event, r.id) for r in out["log"].collect()) == [("node_merge", "p-robert"), ("synonym_collapse", "o-x")]
