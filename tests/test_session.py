import json

import pytest

from graphloom.operators import chunks as C
from graphloom.operators import merge as M
from graphloom.operators import ontology as O
from graphloom.operators import orphans as P
from graphloom.operators import report as R
from graphloom.operators.answers import Busy, Overflow, answered, ask, carried, gated, patiently, pending, tasks
from graphloom.operators.export import load_script, write_json, write_text
from graphloom.session import Build, Config, Session, Stage, list_sessions
from graphloom.sources import files as S
from graphloom.sources.turtle import base_schema, read_turtle, synonyms, triples

V = lambda v, c=0.9: {"value": v, "confidence": c}
NODES = [
    {"id": "person-ann", "type": "Person", "confidence": 0.9, "attributes": {"name": V("Ann"), "title": V(None, 0.0)}, "aliases": ["A. \"X\""], "source_files": ["a.md"]},
    {"id": "person-bob", "type": "Person", "confidence": 0.5, "attributes": {"name": V("Bob")}, "source_files": ["a.md", "b.md"]},
    {"id": "org-zet", "type": "Organization", "confidence": 1.0, "attributes": {"name": V("Zet\nLtd")}, "aliases": [], "source_files": []},
]
EDGES = [{"id": "e1", "type": "worksAt", "from": "person-ann", "to": "org-zet", "confidence": 0.8, "method": "llm_extraction", "attributes": {}, "source_files": []}, {"id": "e2", "type": "odd", "from": "person-ann", "to": "person-bob", "confidence": 0.8, "method": "orphan_inferred"}]
SCHEMA = {"concepts": [{"type": "Agent", "parent": None, "attributes": ["name"]}, {"type": "Person", "parent": "Agent", "attributes": ["title"]}], "properties": [{"name": "worksAt", "domain": "Person", "range": "Organization", "attributes": []}]}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("sessions")
    for n in ("2024-01", "2024-02"):
        (root / n / "output").mkdir(parents=True)
        (root / n / "intermediate").mkdir()
        (root / n / "output" / "nodes.jsonl").write_text("\n".join(map(json.dumps, NODES)) + "\n\n{broken\n")
        (root / n / "output" / "edges.jsonl").write_text("\n".join(map(json.dumps, EDGES)))
        (root / n / "intermediate" / "schema.json").write_text(json.dumps(SCHEMA, indent=1))
    return root


def test_session(spark, folder, tmp_path):
    s = Session(spark, str(folder / "2024-01"))
    assert [r.id for r in s.search("bob").collect()] == ["person-bob"] and s.node("org-zet").count() == 1
    assert [(r.other, r.outgoing) for r in s.neighbors("org-zet").collect()] == [("person-ann", False)]
    assert [r.id for r in s.path_between("person-bob", "org-zet").orderBy("hop").collect()] == ["person-bob", "person-ann", "org-zet"]
    assert s.subgraph(types=["Person"], least=0.6)[0].count() == 1 and s.hubs(1).first().id == "person-ann" and s.orphans().count() == 0
    assert s.stats().first().components == 1 and s.context("Zet\nLtd", 1).count() == 2 and s.types().count() == 2
    lines = {r.line for r in s.turtle().collect()}
    assert 'data:org-zet ex:name "Zet\\nLtd" .' in lines and 'data:person-ann skos:altLabel "A. \\"X\\"" .' in lines and "data:person-ann ex:worksAt data:org-zet ." in lines
    assert not any("ex:odd" in x or "ex:title \"" in x for x in lines) and "ex:Person rdfs:subClassOf ex:Agent ." in lines
    back = triples("\n".join(r.line for r in s.turtle().orderBy("section").collect()))
    assert ("http://example.org/data#org-zet", "http://example.org/schema#name", "Zet\nLtd", True) in back and ("http://example.org/schema#worksAt", "http://www.w3.org/2000/01/rdf-schema#range", "http://example.org/schema#Organization", False) in back
    assert "[[Zet\nLtd]]" in s.note("person-ann").first().note
    assert [(r.session) for r in list_sessions(spark, str(folder)).collect()] == ["2024-02", "2024-01"]
    with pytest.raises(ValueError):
        list_sessions(spark, str(folder) + "/../x")
    write_text(s.turtle(), f"{tmp_path}/ttl")
    assert spark.read.text(f"{tmp_path}/ttl").count() == sum(x.count("\n") + 1 for x in lines)
    write_json(s.nodes, f"{tmp_path}/json")
    back = spark.read.schema(S.NODE).json(f"{tmp_path}/json")
    assert sorted(map(str, back.collect())) == sorted(map(str, s.nodes.collect()))
    assert [(r.type, r.n, r.samples) for r in s.types().collect()] == [("Person", 2, ["person-ann", "person-bob"]), ("Organization", 1, ["org-zet"])]
    assert [(r.hop, r.src, r.dst, r.edge_id) for r in s.path_edges("person-bob", "org-zet").orderBy("hop").collect()] == [(1, "person-ann", "person-bob", "e2"), (2, "person-ann", "org-zet", "e1")]
    assert [(r.id, r.name) for r in s.neighbor_summaries("org-zet").collect()] == [("person-ann", "Ann")]
    bundle = s.export(f"{tmp_path}/out")
    rows = sorted(spark.read.text(f"{tmp_path}/out/csv/nodes_Person").collect())
    assert [r[0] for r in rows] == ["id,_aliases,_node_confidence,_parents,_source_files,name,name_confidence", 'person-ann,"A. \\"X\\"",0.9,Agent,a.md,Ann,0.9', "person-bob,,0.5,Agent,a.md;b.md,Bob,0.9"]
    assert bundle["relationships_WORKS_AT"] == ["confidence", "method", "source_files"]
    browser, shell = load_script(bundle), load_script(bundle, "/data/x")
    assert "FROM 'file:/nodes_Person.csv' AS row" in browser and "FROM 'file:///data/x/nodes_Person.csv' AS row" in shell
    assert "n._parents = CASE WHEN row._parents = '' THEN [] ELSE split(row._parents, ';') END" in browser and "n.name_confidence = CASE WHEN row.name_confidence = '' THEN null ELSE toFloat(row.name_confidence) END" in browser
    assert browser.count(":auto LOAD CSV") == len(bundle) == 4 and "MERGE (a)-[r:WORKS_AT]->(b)" in browser
    m = s.merge(Session(spark, str(folder / "2024-02")))
    assert m.nodes.count() == 3 and m.edges.count() == 2 and {f for r in m.nodes.collect() for f in r.source_files or []} == {"session_a/a.md", "session_a/b.md"}
    with pytest.raises(ValueError):
        s.source(node="person-ann")
    from graphloom.__main__ import answer, parser
    from graphloom.operators import graph as G
    from graphloom.operators.export import page, render_edges, render_table

    ask_for = lambda *words: answer(spark, parser().parse_args([str(folder / "2024-01"), *words]))
    assert [r.id for r in ask_for("search", "bob").collect()] == ["person-bob"] and ask_for("types").count() == 2 and ask_for("path", "person-bob", "org-zet").count() == 2
    assert ask_for("context", "Ann", "--mode", "dfs").first().line == "# Context: Ann" and ask_for("export", f"{tmp_path}/cli") is None
    html = page(render_table(s.entities, G.degrees(s.edges)), render_edges(s.edges), "A & B")
    assert "<h1>A &amp; B</h1>" in html and '"id":"person-ann"' in html and '"src":"person-ann","dst":"org-zet","width":2' in html
    s.mentions = spark.createDataFrame([("person-ann", "a.md", 0), ("person-ann", "a.md", 1), ("org-zet", "a.md", 1), ("person-bob", "b.md", 0)], "id string, source_file string, chunk_index int")
    s.chunks = spark.createDataFrame([("a.md", 0, "x " * 200 + "Ann came."), ("a.md", 1, "Ann, Zet"), ("b.md", 0, "Bob")], "source_file string, chunk_index int, text string")
    got = s.source(node="person-ann").orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.total) for r in got] == [(0, 2), (1, 2)] and got[0].text.startswith("…x x") and got[0].text.endswith("Ann came.")
    assert [(r.chunk_index, r.exact) for r in s.source(edge="e1").collect()] == [(1, True)]
    assert sorted((r.source_file, r.chunk_index, r.exact) for r in s.source(edge="e2").collect()) == [("a.md", 0, False), ("a.md", 1, False), ("b.md", 0, False)]
    text = [r.line for r in s.context_text("Ann").orderBy("pos").collect()]
    assert text[1] == "Seeds: person-ann | Mode: bfs | Depth: 2" and text[2] == "Nodes: 3 | Edges: 2" and "- person-ann --[worksAt]--> org-zet (conf=0.80)" in text
    assert [r.line for r in s.context_text("Ann", "dfs", 2).orderBy("pos").collect()][2] == "Nodes: 3 | Edges: 2"
    assert s.context_text("Ann", budget=20).orderBy("pos").collect()[-1].line == "... (cut at the budget)" and s.context_text("nobody at all").count() == 1


def test_build_skips_retries_and_invalidates(spark, tmp_path):
    calls = []

    def step(name, fail=0):
        def run(tables):
            calls.append(name)
            if calls.count(name) <= fail:
                raise RuntimeError("once")
            return {name: spark.range(3)}

        return run

    stages = [Stage("a", step("a", 1), ("a",)), Stage("b", step("b", 9), ("b",), blocking=False), Stage("c", step("c"), ("c",), review=True)]
    b = Build(spark, str(tmp_path), stages)
    assert set(b.run()) == {"a"} and b.state == {"a": "done", "b": "failed", "c": "waiting"} and len(b.warnings) == 1
    b.approve("c")
    assert set(b.run()) == {"a", "c"} and calls.count("a") == 2
    assert json.loads((tmp_path / "state.json").read_text())["c"] == "done"
    told = []
    more = [Stage("x", step("x", 2), ("x",), feedback=lambda tables, e: told.append(str(e)) or {"x": spark.range(1)}), Stage("y", lambda t: (_ for _ in ()).throw(ValueError("wrong use")), ("y",)), Stage("z", step("z"), ("z",))]
    second = Build(spark, f"{tmp_path}/second", more)
    assert set(second.run(only=("z",))) == {"z"}
    with pytest.raises(ValueError):
        second.run()
    assert told == ["once"] and second.state == {"x": "done", "y": "failed", "z": "done"} and not (tmp_path / "second" / "state.json.new").exists()
    b.invalidate("a", keep=("c",))
    assert set(b.run(until="a")) == {"a"} and calls.count("a") == 3 and calls.count("c") == 1


def test_config():
    c = Config.read("llm: {model: x}\nprofiles:\n  big: {llm: {window: 9}}\n").profile("big")
    assert c.get("llm", "window") == 9 and c.get("llm", "model") is None and c.get("no", "such", default=1) == 1
    with pytest.raises(KeyError):
        c.profile("none")


def test_files_and_turtle(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("---\nt: x\n---\nüber  all")
    (tmp_path / "in" / "sub" / "b.md").write_text("x")
    (tmp_path / "in" / "sub" / "empty.md").write_text("")
    (tmp_path / "in" / "c.txt").write_text("no")
    got = {r.source_file: (r.content, r.token_count) for r in S.read_markdown(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.md": ("---\nt: x\n---\nüber  all", 6), "sub/b.md": ("x", 1)}
    page = "<h2>T &amp; x</h2><p>a <b>b</b><script>x</script></p><ol><li>1</li><li>2<ul><li>n</li></ul></li></ol><img src=x><p><a href=y>link</a></p>"
    assert S.markdown_of(page).split() == "## T & x a **b** 1. 1 2. 2 - n link".split() and "\n  - n" in S.markdown_of(page) and S.markdown_of(None) is None
    (tmp_path / "o.ttl").write_text('@prefix : <http://x/#> .\n@prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix skos: <http://www.w3.org/2004/02/skos/core#> .\n# note\n:A a owl:Class ; rdfs:label "a \\"q\\""@en .\n:B a owl:Class ; rdfs:subClassOf :A .\n:p a owl:ObjectProperty ; rdfs:domain :A ; rdfs:range :B , :C .\n:A skos:exactMatch :Z ; skos:broader :Y .\n')
    t = read_turtle(spark, str(tmp_path / "o.ttl"))
    concepts, props = base_schema(t)
    assert sorted(map(tuple, concepts.collect())) == [("A", None), ("B", "A")] and [tuple(r) for r in props.collect()] == [("p", "A", "B")]
    assert {tuple(r) for r in synonyms(t).collect()} == {("A", "Z", "exact"), ("Z", "A", "exact"), ("A", "Y", "broad")}
    assert ("http://x/#A", "http://www.w3.org/2000/01/rdf-schema#label", 'a "q"', True) in triples((tmp_path / "o.ttl").read_text())
    from graphloom.operators import validate as V

    bad = spark.createDataFrame([("p", "A", "Q")], "name string, domain string, range string")
    _, fixed, left = V.checked_schema(concepts, bad, lambda c, p, e: (c.limit(0), p.where("false")))
    assert fixed.count() == 0 and left.count() == 0 and V.checked_schema(concepts, bad, lambda c, p, e: (c, p))[2].count() == 1
    links = spark.createDataFrame([("http://a/1", "http://a/2"), ("http://a/2", "http://b/3"), ("http://a/2", "http://a/4")], "src string, dst string")
    seeds = spark.createDataFrame([("http://a/1",)], "url string")
    assert [(r.url, r.hop) for r in S.crawl_order(links, seeds, 3).collect()] == [("http://a/1", 0), ("http://a/2", 1), ("http://a/4", 2)]
    assert S.crawl_order(links, seeds, 3, same_host=False, most=2).count() == 2


def test_session_for_a_merge(spark, folder):
    root = folder / "2024-02"
    (root / "intermediate" / "raw_extractions.json").write_text(json.dumps({"a.md": {"nodes": [{"id": "n1", "type": "P"}], "edges": []}, "it's.md": {"nodes": [], "edges": [{"type": "k", "from": "n1", "to": "n1"}]}}))
    (root / "intermediate" / "raw").mkdir()
    (root / "intermediate" / "raw" / "s1.json").write_text('{"nodes": [], "edges": []}')
    (root / "intermediate" / "raw" / "s2.json").write_text("{broken")
    (root / "intermediate" / "file_manifest.json").write_text(json.dumps({"a.md": "old text", "it's.md": {"content": "new text", "sha256": "x", "token_count": 2}}))
    t = S.read_merge_session(spark, str(root))
    assert {r.source_file: (len(r.nodes), len(r.edges)) for r in t["extractions"].collect()} == {"a.md": (1, 0), "it's.md": (0, 1)}
    assert [r.shard for r in t["shards"].collect()] == ["s1"]
    assert {r.source_file: (r.content, r.token_count) for r in S.migrated(t["manifest"]).collect()} == {"a.md": ("old text", 2), "it's.md": ("new text", 2)}


def test_chunks_and_packing(spark):
    f = spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(23))), ("b", ""), ("c", None), ("d", "one two")], "source_file string, content string")
    got = [(r.source_file, r.chunk_index, r.token_start, r.token_end) for r in C.chunk(f, 10, 3).orderBy("source_file", "chunk_index").collect()]
    assert got == [("a", 0, 0, 10), ("a", 1, 7, 17), ("a", 2, 14, 23), ("b", 0, 0, 0), ("d", 0, 0, 2)]
    items = spark.createDataFrame([("f", i, n) for i, n in enumerate([3, 4, 5, 20, 1, 1])], "file string, i int, n long")
    assert [r.batch for r in C.pack(items, ["file"], ["i"], "n", 8).orderBy("i").collect()] == [0, 0, 1, 2, 3, 3]
    many = spark.createDataFrame([(f"f{i % 40:02d}", i, 1 + i % 5) for i in range(400)], "file string, i int, n long")
    assert C.sample_batches(10, 3, 1) == C.sample_batches(10, 3, 1) and C.sample_batches(2, 3, 1) == [0, 1]
    many = many.unionByName(spark.createDataFrame([("f50", 0, 0), ("f50", 1, 0), ("f50", 2, 40), ("f50", 3, 0), ("f50", 4, 3), ("f60", 0, None)], many.schema))
    want, used, number = [], 0, 0
    for r in sorted(many.collect(), key=lambda r: (r.file, r.i)):
        n = r.n or 0
        if used and used + n > 10:
            used, number = 0, number + 1
        used += n
        want.append((r.file, r.i, number))
    for tasks in (1, 5):
        assert sorted((r.file, r.i, r.batch) for r in C.pack_pooled(many, ["file", "i"], "n", 10, tasks).collect()) == want
    assert C.pack_pooled(many.limit(0), ["file", "i"], "n", 10).count() == 0


def test_budgets(spark):
    assert [C.nice_number(x) for x in (182_400, 14_999, 9_999, 4_321, 99)] == [180_000, 10_000, 5_000, 4_000, 99]
    b = C.token_budget(200_000, 8_000)
    assert (b["headroom"], b["request"], b["chunk"], b["overlap"], b["reserve_chars"]) == (192_000, 180_000, 10_000, 1_000, 48_000)
    assert C.token_budget(200_000, headroom=192_000) == b
    with pytest.raises(ValueError):
        C.token_budget(1000)
    assert C.token_budget(1000, 0, divisor=31)["chunk"] == 100 and C.token_budget(1000, 0, divisor=31)["overlap"] == 10
    d, n = C.better_divisor(192_000, 2_000_000, 10_000, 1_000)
    assert 4 <= d < 32 and 50 <= n <= 500 and C.chunks_of(10, 20, 5) == 1
    rows = spark.createDataFrame([(192_000,), (1000,), (7,)], "h long")
    for r in C.token_budgets(rows, "h").collect():
        one = C.token_budget(r.h, 0)
        assert (r.request, r.chunk, r.overlap, r.reserve_chars) == (one["request"], one["chunk"], one["overlap"], one["reserve_chars"])


def test_ontology_orphans_merge_and_answers(spark):
    assert O.fold_proposals([[{"type": "worksAt", "attributes": ["a"]}, None, {"type": "Relationship"}], [{"type": "works-at", "parent": "X", "attributes": ["b", "a"]}, {"type": "Firm", "parent": None}, {"type": "Company", "parent": "Org"}]], {("firm", "company")}, frozenset({"Firm"})) == [
        {"type": "worksAt", "parent": "X", "attributes": ["a", "b"]}, {"type": "Firm", "parent": None, "attributes": []}]
    links = spark.createDataFrame([("A", None), ("B", "A"), ("C", "B"), ("X", "Y"), ("Y", "X")], "type string, parent string")
    assert {(r.type, r.ancestor) for r in O.closure(links).collect()} == {("A", "A"), ("B", "B"), ("B", "A"), ("C", "C"), ("C", "B"), ("C", "A"), ("X", "X"), ("X", "Y"), ("Y", "X"), ("Y", "Y")}
    o = spark.createDataFrame([("o1", "Ann", ["f", "g"])], "id string, name string, source_files array<string>")
    failed = spark.createDataFrame([("g", 1, "see ANN"), ("g", 0, "no"), ("h", 0, "Ann")], "source_file string, chunk_index int, text string")
    assert [tuple(r) for r in P.recovered(o, failed).collect()] == [("o1", "g", 1)]
    ans = spark.createDataFrame([("o1", "p", "k", True, 0.8), ("o1", "p", "bad", False, 0.8)], "orphan string, peer string, type string, flipped boolean, confidence double")
    c = P.confirmed(ans, spark.createDataFrame([("o1", "p", 0.4)], "orphan string, peer string, score double"), spark.createDataFrame([("o1", "p", "k")], "orphan string, peer string, type string")).collect()
    assert [(r.src, r.dst, r.confidence) for r in c] == [("p", "o1", 0.56)]
    a = spark.createDataFrame([("x",)], "source_file string")
    with pytest.raises(ValueError):
        M.disjoint_union(a, a, ["source_file"])
    t = tasks(spark.createDataFrame([("s", "u1", "l"), ("s", "u2", "l"), ("s", "u1", "l")], "system string, user string, label string"))
    answers = ask(t, lambda s, u: "```json\n{\"nodes\": [{\"id\": \"n\"}], \"edges\": []}\n```" if u == "u1" else "oops")
    got = {r.user: (r.error, r.parsed and len(r.parsed.nodes)) for r in answered(t, answers).collect()}
    assert got == {"u1": (None, 1), "u2": ("no JSON", None)} and pending(t, answers.limit(1)).count() == 1

    def broken(s, u):
        raise Overflow("too long")

    failed = ask(t, broken)
    assert {r.failure for r in failed.collect()} == {"Overflow: too long"} and gated(failed, 2).count() == 2
    with pytest.raises(RuntimeError):
        gated(failed, 1)
    waits, tries = [], []

    def moody(s, u):
        tries.append(u)
        if len(tries) < 3:
            raise Busy()
        return "" if len(tries) == 3 else "fine"

    assert patiently(moody, 5, 1.0, sleep=waits.append)("s", "u") == "fine" and waits == [1.0, 2.0]
    with pytest.raises(Busy):
        patiently(lambda s, u: (_ for _ in ()).throw(Busy()), 2, sleep=waits.append)("s", "u")
    ch = spark.createDataFrame([("f", 1, "b c"), ("f", 0, "a b"), ("g", 0, None)], "source_file string, chunk_index int, text string")
    assert {(r.source_file, r.chunk_index): (r.prior, r.found) for r in carried(ch, lambda prior, text: text.split()).collect()} == {("f", 0): ([], ["a", "b"]), ("f", 1): (["a", "b"], ["b", "c"]), ("g", 0): ([], [])}
    log = spark.createDataFrame([(0, "23:59:50", "RUN a"), (1, "00:01:00", "DONE a"), (2, "10:00:00", "RUN b"), (3, "10:00:05", "RUN b"), (4, "11:00:06", "DONE b"), (5, "x", "noise")], "pos int, clock string, message string")
    assert {r.step: r.took for r in R.timeline(log).collect()} == {"a": "1m 10s", "b": "1h 00m 01s"}
    lines = spark.createDataFrame([("10:00:00 [INFO] a.b — hello — x",), ("junk",)], "value string")
    assert [tuple(r) for r in S.read_run_log(lines).collect()] == [("10:00:00", "INFO", "a.b", "hello — x")]
