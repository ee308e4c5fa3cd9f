"""Queries on exports in other formats, isolated nodes' answers, incremental extraction, merged sessions, the model's boundary and the run's report."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import answers as L
from graphloom.operators import assemble as A
from graphloom.operators import export as X
from graphloom.operators import graph as G
from graphloom.operators import merge as M
from graphloom.operators import ontology as O
from graphloom.operators import orphans as P
from graphloom.operators import report as R
from graphloom.plans.building import CLAMP, EDG, OCC, SLUG, attribute_occurrences, edge_occurrences, norm_map, occurrences, properties
from graphloom.plans.exporting import ATTR, PROPS, attributes
from graphloom.plans.querying import GRAPH, MENTIONS, WEAK, _CAND, _orphan_inputs, graph, mentions, strong_edges
from graphloom.plans.registry import Catalogue, table
from graphloom.sources.files import NODE

query = Catalogue()
QUERIES, SQL = query.queries, query.sql

# formats


def _format(fmt, node, edge, head, middle, tail):
    fixed = " UNION ALL ".join(f"SELECT {k}, '{x}'" for k, x in ((0, head), (2, middle), (4, tail)) if x)
    parts = [p for p in (fixed, node and f"SELECT DISTINCT 1, {node} FROM gn", edge and f"SELECT DISTINCT 3, {edge} FROM ge") if p]
    return f"WITH {GRAPH}, l(section, line) AS ({' UNION ALL '.join(parts)}) SELECT section, line FROM l"


_X = "replace(replace({0}, '&', '&amp;'), chr(39), '&#x27;')"
_Q = "'\"' || replace({0}, '\"', chr(39)) || '\"'"


@query(_format("graphml", "'<node id=\"' || " + _X.format("id") + " || '\"/>'", "'<edge source=\"' || " + _X.format("src") + " || '\" target=\"' || " + _X.format("dst") + " || '\"/>'", '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">', "", "</graph></graphml>"))
def snk_graphml(spark, d):
    return X.graph_lines(*graph(spark, d), "graphml")


@query(_format("gexf", "'<node id=\"' || " + _X.format("id") + " || '\" label=\"' || " + _X.format("type") + " || '\"/>'", "'<edge source=\"' || " + _X.format("src") + " || '\" target=\"' || " + _X.format("dst") + " || '\"/>'", '<gexf version="1.2"><graph defaultedgetype="directed"><nodes>', "</nodes><edges>", "</edges></graph></gexf>"))
def snk_gexf(spark, d):
    return X.graph_lines(*graph(spark, d), "gexf")


@query(_format("gml", "'node [ id ' || " + _Q.format("id") + " || ' label ' || " + _Q.format("type") + " || ' ]'", "'edge [ source ' || " + _Q.format("src") + " || ' target ' || " + _Q.format("dst") + " || ' ]'", "graph [ directed 1", "", "]"))
def snk_gml(spark, d):
    return X.graph_lines(*graph(spark, d), "gml")


@query(_format("pajek", _Q.format("id"), _Q.format("src") + " || ' ' || " + _Q.format("dst"), "*vertices", "*arcs", ""))
def snk_pajek(spark, d):
    return X.graph_lines(*graph(spark, d), "pajek")


@query(_format("edgelist", "", "src || ' ' || dst", "", "", ""))
def snk_edgelist(spark, d):
    return X.graph_lines(*graph(spark, d), "edgelist")


@query(f"WITH {GRAPH} SELECT 1 AS section, id AS a, type AS b, NULL AS c, NULL AS e FROM gn UNION SELECT 3, src, dst, id, type FROM ge")
def snk_node_link(spark, d):
    """The node-link JSON read back."""
    rows = X.graph_lines(*graph(spark, d), "json").where("section in (1, 3)")
    j = lambda k: F.get_json_object("line", f"$.{k}")
    return rows.select("section", F.coalesce(j("id"), j("source")).alias("a"), F.coalesce(j("node_type"), j("target")).alias("b"), j("label").alias("c"), j("edge_type").alias("e"))


@query("""SELECT id, type, CASE WHEN NOT isnan(confidence) THEN round(confidence, 6) END AS confidence, array_to_string(list_sort(list_transform(map_entries(attributes), lambda e: e.key || '=' || coalesce(e.value.value, '~'))), '|') AS attributes, array_to_string(aliases, '|') AS aliases, array_to_string(source_files, '|') AS source_files FROM nodes""")
def snk_nodes_roundtrip(spark, d):
    """Every record written as a line of JSON and read back."""
    n = table(spark, d, "nodes").select("id", "type", F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence"), "attributes", "aliases", "source_files")
    back = X.json_lines(n).select(F.from_json("line", NODE).alias("r")).select("r.*")
    told = F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat(e.key, F.lit("="), F.coalesce(e.value["value"], F.lit("~")))))
    return back.select("id", "type", F.round("confidence", 6).alias("confidence"), F.when(F.size("attributes") >= 0, F.array_join(told, "|")).alias("attributes"), F.array_join("aliases", "|").alias("aliases"), F.array_join("source_files", "|").alias("source_files"))


_UP = """up AS (WITH RECURSIVE one AS (SELECT type, min(parent) AS parent FROM concepts WHERE session_id = (SELECT max(session_id) FROM concepts) AND type IS NOT NULL GROUP BY 1),
w(type, above, way) AS (SELECT type, parent, [type] FROM one UNION ALL SELECT w.type, o.parent, list_append(w.way, o.type) FROM w JOIN one o ON o.type = w.above WHERE NOT list_contains(w.way, o.type))
SELECT type, array_to_string(arg_max(way, len(way))[2:], ';') AS parents FROM w GROUP BY 1)"""
_REC = "rec AS (SELECT id, type, aliases, source_files FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY node_key) AS k FROM nodes WHERE id IS NOT NULL) WHERE k = 1)"
_PROPERTY = f"""WITH {_UP}, {_REC}, {ATTR}, lab AS (SELECT id, regexp_replace(type, '[^A-Za-z]', '', 'g') AS label FROM rec), l AS (
  SELECT id, '_parents' AS key, coalesce(parents, '') AS text FROM rec LEFT JOIN up USING (type) UNION ALL SELECT id, '_source_files', array_to_string(coalesce(source_files, []), ';') FROM rec
  UNION ALL SELECT id, '_aliases', array_to_string(aliases, ';') FROM rec WHERE aliases IS NOT NULL UNION ALL SELECT id, attr, max(value) FROM ax WHERE value IS NOT NULL GROUP BY 1, 2)"""


def _node_properties(spark, d):
    """Of each id the record of least key, with the attributes of all; parents by the last session's schema."""
    c = table(spark, d, "concepts")
    last = c.agg(F.max("session_id")).first()[0]
    n = table(spark, d, "nodes").where("id is not null").groupBy("id").agg(F.min_by(F.struct("type", "aliases", "source_files"), "node_key").alias("r")).select("id", "r.*", F.lit(0.5).alias("confidence"))
    return X.node_properties(n, attributes(spark, d), O.parents(c.where(F.col("session_id") == last)))


@query(_PROPERTY + " SELECT id, label, key, text FROM l JOIN lab USING (id)")
def snk_node_properties(spark, d):
    """Those that are texts: numbers are written as each engine writes them."""
    return _node_properties(spark, d).where("key not like '%confidence'")


@query(_PROPERTY + " SELECT label, string_agg(DISTINCT key, ',' ORDER BY key) AS columns FROM (SELECT * FROM l UNION ALL SELECT id, '_node_confidence', '' FROM rec UNION ALL SELECT DISTINCT id, attr || '_confidence', '' FROM ax WHERE value IS NOT NULL AND confidence IS NOT NULL) JOIN lab USING (id) GROUP BY 1")
def snk_neo4j_columns(spark, d):
    return X.csv_columns(_node_properties(spark, d), "label")


_WANTED = ["_aliases", "_parents", "_source_files", "city", "email", "name", "title"]


@query(_PROPERTY + " SELECT label, id, " + ", ".join(f"coalesce(max(text) FILTER (WHERE key = '{k}'), '') AS \"{k}\"" for k in _WANTED) + " FROM l JOIN lab USING (id) GROUP BY 1, 2")
def snk_neo4j_nodes(spark, d):
    """The texts of the CSV rows of all labels."""
    return X.csv_rows(_node_properties(spark, d), ["label", "id"], _WANTED)


@query("""WITH er AS (SELECT id, min(type) AS type, min("from") AS src, min("to") AS dst, min(method) AS method FROM edges GROUP BY 1), ex AS (SELECT DISTINCT id, e.key AS attr, e.value.value AS value FROM (SELECT id, unnest(map_entries(attributes)) AS e FROM edges))
SELECT id AS edge_id, upper(type) AS relation, src, dst, 'method' AS key, coalesce(method, '') AS text FROM er UNION ALL SELECT id, upper(type), src, dst, attr, max(value) FROM ex JOIN er USING (id) WHERE value IS NOT NULL GROUP BY ALL""")
def snk_edge_properties(spark, d):
    e = table(spark, d, "edges")
    one = e.groupBy("id").agg(F.min("type").alias("type"), F.min("from").alias("src"), F.min("to").alias("dst"), F.min("method").alias("method"))
    one = one.withColumn("confidence", F.lit(0.5)).withColumn("source_files", F.array().cast("array<string>"))
    long = e.select("id", F.explode("attributes").alias("attr", "a")).select("id", "attr", "a.value", "a.confidence").distinct()
    return X.edge_properties(one, long).where("key = 'method' or key not in ('confidence', 'source_files') and key not like '%confidence'")


@query(_PROPERTY + """, q AS (SELECT id, label, key, CASE WHEN regexp_matches(text, '[,"\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS c FROM l JOIN lab USING (id))
SELECT 0 AS section, 'id,city,name' AS line UNION ALL SELECT 1, id || ',' || coalesce(max(c) FILTER (WHERE key = 'city'), '') || ',' || coalesce(max(c) FILTER (WHERE key = 'name'), '') FROM q GROUP BY id""")
def snk_csv_lines(spark, d):
    return X.csv_lines(X.csv_rows(_node_properties(spark, d), ["id"], ["city", "name"]))


@query(f"WITH {GRAPH}, c AS (SELECT id, max(CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END) AS c FROM edges GROUP BY 1) SELECT ge.id, src, dst, CASE WHEN c >= 0.8 THEN 2 ELSE 1 END AS width FROM ge JOIN c USING (id)")
def snk_html_edges(spark, d):
    c = table(spark, d, "edges").groupBy("id").agg(F.max(F.when(F.col("confidence").between(0, 1), F.col("confidence"))).alias("confidence"))
    return X.render_edges(graph(spark, d)[1].join(c, "id"))


# assembly


@query(f"""WITH {EDG}, ea AS (SELECT e.source_file, e.pos, e.type, e.src, e.dst, a.key AS attr, a.value.value AS value, a.value.confidence AS confidence FROM (SELECT DISTINCT session_id, id, type, "from" AS f, "to" AS t, unnest(map_entries(attributes)) AS a FROM edges) x JOIN edg e ON e.source_file = x.session_id AND e.pos = x.id AND e.type = x.type AND e.src IS NOT DISTINCT FROM x.f AND e.dst IS NOT DISTINCT FROM x.t),
u AS (SELECT DISTINCT source_file, pos, type, src, dst, attr, value, confidence FROM ea WHERE src IS NOT NULL AND dst IS NOT NULL),
m AS (SELECT type, src, dst, attr, max({CLAMP("confidence")}) AS top, arg_min_null(value, (-{CLAMP("confidence")}, source_file, pos)) AS first, list(value ORDER BY source_file, pos) FILTER (WHERE {CLAMP("confidence")} = 1) AS full_ FROM u GROUP BY 1, 2, 3, 4)
SELECT type, src, dst, attr, CASE WHEN top = 1 THEN list_reduce(full_, lambda a, v: CASE WHEN a IS NOT NULL AND v IS NOT NULL AND v <> a THEN a || '; ' || v ELSE a END) ELSE first END AS value, top AS confidence FROM m""")
def asm_edge_attributes(spark, d):
    return A.merge_attributes(_edge_attributes(spark, d), ["type", "src", "dst", "attr"])


def _edge_attributes(spark, d):
    e = table(spark, d, "edges").where(F.col("from").isNotNull() & F.col("to").isNotNull())
    return e.select(F.col("session_id").alias("source_file"), F.col("id").alias("pos"), "type", F.col("from").alias("src"), F.col("to").alias("dst"), F.explode("attributes").alias("attr", "a")).select("source_file", "pos", "type", "src", "dst", "attr", "a.value", "a.confidence", F.lit(True).alias("is_text")).distinct()


@query(f"""WITH {OCC}, f AS (SELECT stable_id, arg_min(type, (source_file, pos)) AS type, arg_min_null(name, (source_file, pos)) AS name FROM occ GROUP BY 1), own AS (SELECT DISTINCT stable_id, unnest(aliases) AS a FROM occ),
norm AS (SELECT DISTINCT type, unnest(aliases) AS alias, attributes['name'].value AS canonical FROM nodes), al AS (SELECT * FROM own UNION SELECT stable_id, alias FROM f JOIN norm ON norm.type = f.type AND norm.canonical = f.name)
SELECT stable_id, string_agg(a, '|' ORDER BY a) AS aliases FROM al JOIN f USING (stable_id) WHERE a IS NOT NULL AND a IS DISTINCT FROM name GROUP BY 1""")
def asm_annotated(spark, d):
    n = A.merge_nodes(occurrences(spark, d))
    return A.annotated(n, A.alias_index(norm_map(spark, d))).where("aliases is not null").select("stable_id", F.array_join("aliases", "|").alias("aliases"))


@query(f"""WITH {OCC}, {EDG}, raw AS (SELECT raw_id, arg_max(stable_id, (source_file, pos)) AS s FROM occ GROUP BY 1), ids AS (SELECT DISTINCT stable_id FROM occ), by_name AS (SELECT regexp_replace(stable_id, '^[^-]*-', '') AS s, min(stable_id) AS one FROM ids GROUP BY 1 HAVING count(*) = 1),
r AS (SELECT e.type, coalesce(a.s, i.stable_id, n.one, e.src) AS src, coalesce(a2.s, i2.stable_id, n2.one, e.dst) AS dst, e.confidence FROM edg e
LEFT JOIN raw a ON a.raw_id = e.src LEFT JOIN ids i ON i.stable_id = e.src LEFT JOIN by_name n ON n.s = {SLUG("e.src")} LEFT JOIN raw a2 ON a2.raw_id = e.dst LEFT JOIN ids i2 ON i2.stable_id = e.dst LEFT JOIN by_name n2 ON n2.s = {SLUG("e.dst")})
SELECT type, src, dst, round(max({CLAMP("confidence")}), 6) AS confidence, count(*) AS occurrences FROM r WHERE src IN (SELECT stable_id FROM ids) AND dst IN (SELECT stable_id FROM ids) GROUP BY 1, 2, 3""")
def asm_driver(spark, d):
    """All steps of assembly; shown are its edges."""
    attrs = attribute_occurrences(spark, d).drop("stable_id")
    return A.assemble(occurrences(spark, d).drop("stable_id"), attrs, edge_occurrences(spark, d), how="max")["edges"].select("type", "src", "dst", F.round("confidence", 6).alias("confidence"), "occurrences")


# isolated nodes


@query(_CAND + """, th AS (SELECT m1.source_file, m1.chunk_index, gn.type, count(*) AS n FROM m1 JOIN orp USING (id) JOIN gn USING (id) GROUP BY 1, 2, 3),
sy AS (SELECT a, b FROM tp UNION SELECT b, a FROM tp), hit AS (SELECT source_file, chunk_index, sy.b AS type, CAST(sum(n) AS BIGINT) AS hits FROM th JOIN sy ON sy.a = th.type GROUP BY 1, 2, 3)
SELECT m1.source_file, m1.chunk_index, m1.id AS peer, coalesce(hits, 0) AS hits, CAST(row_number() OVER (PARTITION BY m1.source_file, m1.chunk_index ORDER BY coalesce(hits, 0) DESC, m1.id) AS INTEGER) AS rank FROM m1 JOIN gn USING (id) LEFT JOIN hit ON hit.source_file = m1.source_file AND hit.chunk_index = m1.chunk_index AND hit.type = gn.type
WHERE m1.id NOT IN (SELECT id FROM orp) AND EXISTS (SELECT 1 FROM th WHERE th.source_file = m1.source_file AND th.chunk_index = m1.chunk_index)""")
def orp_peers(spark, d):
    return P.ranked_peers(*_orphan_inputs(spark, d))


_ANSWERS = f"""WITH {GRAPH}, {WEAK}, {MENTIONS}, g AS (SELECT source_file, chunk_index, m1.id, length(m1.id) % 2 = 0 AS blank FROM m1 JOIN orp USING (id)), pr AS (SELECT source_file, chunk_index, min(id) AS peer FROM m1 GROUP BY 1, 2),
kind AS (SELECT source_file, chunk_index, peer, min(g.id) AS one, length(source_file) % 6 AS k FROM g JOIN pr USING (source_file, chunk_index) GROUP BY 1, 2, 3, 5),
a AS (SELECT * FROM kind WHERE k <> 5), e AS (SELECT source_file, chunk_index, 'knows' AS type, one AS src, peer AS dst, 0.7512::DOUBLE AS confidence FROM a WHERE k <= 1)"""


def _answered(spark, d):
    """Groups of isolated nodes, and answers made for them by the length of the file's name: an edge (with one of an unknown type, or to nowhere), none, an object, no JSON, no answer."""
    orphans, _, m, _ = _orphan_inputs(spark, d)
    g = m.join(orphans, "id", "left_semi").select("source_file", "chunk_index", "id", (F.length("id") % 2 == 0).alias("blank"))
    peer = m.groupBy("source_file", "chunk_index").agg(F.min("id").alias("peer"))
    a = g.groupBy("source_file", "chunk_index").agg(F.min("id").alias("one")).join(peer, ["source_file", "chunk_index"]).withColumn("k", F.length("source_file") % 6).where("k <> 5")
    edge = lambda kind, to: F.struct(F.lit(kind).alias("type"), F.col("one").alias("from"), to.alias("to"), F.lit(0.75123).alias("confidence"))
    text = F.when(F.col("k") <= 1, F.concat(F.lit("```json\n"), F.to_json(F.array(edge("knows", F.col("peer")), edge("no such type", F.col("peer")), edge("knows", F.lit("nowhere")))), F.lit("\n```"))).when(F.col("k") == 2, "[]").when(F.col("k") == 3, '{"edges": []}').otherwise("I found nothing.")
    props = spark.createDataFrame([("knows",), ("leads",)], "name string")
    return P.confirmed_groups(g, a.select("source_file", "chunk_index", text.alias("answer")), props, graph(spark, d)[0])


@query(_ANSWERS + " SELECT e.source_file, e.chunk_index, e.type, src, dst, confidence, 'orphan_inferred' AS method FROM e WHERE dst IN (SELECT id FROM gn)")
def orp_confirmed(spark, d):
    return _answered(spark, d)[0]


@query(_ANSWERS + " SELECT g.id, g.source_file, g.chunk_index, CASE k WHEN 3 THEN 'wrong_type' WHEN 4 THEN 'parse_error' WHEN 5 THEN 'error' ELSE 'llm_rejected' END AS reason FROM g JOIN kind USING (source_file, chunk_index) WHERE NOT (k <= 1 AND (g.id = kind.one OR g.id = kind.peer))")
def orp_rejections(spark, d):
    return _answered(spark, d)[1]


@query(_ANSWERS + " SELECT g.id, CASE WHEN bool_or(k <= 1 AND (g.id = kind.one OR g.id = kind.peer)) THEN 'blank_recovered' ELSE 'blank_unresolved' END AS quality FROM g JOIN kind USING (source_file, chunk_index) WHERE blank AND k <= 2 GROUP BY 1")
def orp_quality(spark, d):
    return _answered(spark, d)[2]


@query(_ANSWERS + ", new AS (SELECT DISTINCT 'edge-' || left(sha256(type || '|' || src || '|' || dst), 10) AS id, type, src, dst FROM e) SELECT id, type, src, dst FROM ge UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM ge)")
def orp_overlay(spark, d):
    from graphloom.functions.text import edge_id, edge_key

    more = _answered(spark, d)[0].select(edge_id(edge_key(F.col("type"), F.col("src"), F.col("dst")), 10).alias("id"), "type", "src", "dst").distinct()
    return P.overlay(graph(spark, d)[1].select("id", "type", "src", "dst"), more)


@query(_CAND + """, top AS (SELECT orphan, peer, round(least(1.0, shared / n), 4) AS score FROM ok, big QUALIFY row_number() OVER (PARTITION BY orphan ORDER BY shared DESC, peer) <= 3),
x AS (SELECT top.*, a.type AS ta, b.type AS tb FROM top JOIN gn a ON a.id = orphan JOIN gn b ON b.id = peer) SELECT CASE WHEN length(peer) % 2 = 0 THEN peer ELSE orphan END AS src, CASE WHEN length(peer) % 2 = 0 THEN orphan ELSE peer END AS dst, 'knows' AS type, round(0.8 * least(1.0, 0.5 + 0.5 * score), 4) AS confidence, 'orphan_inferred' AS method FROM x WHERE ta = 'Person' AND tb = 'Person'""")
def orp_confirm_pairs(spark, d):
    """Every candidate answered with the same property, which is declared between persons only; half of the answers turn the direction."""
    o, t, m, pairs = _orphan_inputs(spark, d)
    c = P.candidates(o, t, m, pairs, top=3)
    answers = c.select("orphan", "peer", F.lit("knows").alias("type"), (F.length("peer") % 2 == 0).alias("flipped"), F.lit(0.8).alias("confidence"))
    person = t.where("type = 'Person'").select("id")
    exact = c.select("orphan", "peer").join(person.withColumnRenamed("id", "orphan"), "orphan").join(person.withColumnRenamed("id", "peer"), "peer").withColumn("type", F.lit("knows"))
    return P.confirmed(answers, c.select("orphan", "peer", "score"), exact)


# incremental extraction

_CK = "ck AS (SELECT DISTINCT source_file, chunk_index FROM chunks)"


@query(f"WITH {_CK} SELECT * FROM ck WHERE NOT ((source_file, chunk_index) IN (SELECT (source_file, chunk_index) FROM ck WHERE chunk_index % 2 = 0) AND length(source_file) % 4 <> 0)")
def inc_todo(spark, d):
    """Chunks of even number were done before; a quarter of the files changed since."""
    c = table(spark, d, "chunks").select("source_file", "chunk_index").distinct()
    return P.todo_chunks(c, c.where("chunk_index % 2 = 0"), c.where("length(source_file) % 4 = 0").select("source_file"))


@query(f"WITH {GRAPH}, {WEAK}, {MENTIONS}, {PROPS}, h AS (SELECT DISTINCT m1.source_file, m1.chunk_index, gn.id, coalesce(gn.name, '') AS name, gn.type, p.name AS property FROM m1 JOIN orp USING (id) JOIN gn USING (id) JOIN props p ON p.domain = gn.type WHERE gn.type IS NOT NULL) SELECT source_file, chunk_index, 'Node: ' || name || ' (id=' || id || ', type=' || type || '); new: ' || string_agg(property, ', ' ORDER BY property) AS line FROM (SELECT DISTINCT * FROM h) GROUP BY source_file, chunk_index, id, name, type")
def inc_hints(spark, d):
    """All properties of an isolated node's type stand for new ones."""
    n, _ = graph(spark, d)
    o, _, m, _ = _orphan_inputs(spark, d)
    props = properties(spark, d).select(F.col("domain").alias("type"), F.col("name").alias("property")).distinct()
    h = m.join(o, "id", "left_semi").join(n.select("id", F.coalesce("name", F.lit("")).alias("name"), "type"), "id").join(props, "type")
    return P.hint_lines(h)


@query(f"WITH n AS (SELECT id, type, {CLAMP('confidence')} AS c, node_key % 2 AS late FROM nodes WHERE id IS NOT NULL), u AS (SELECT id, late, max(c) AS c, min(type) AS type FROM n GROUP BY 1, 2) SELECT id, arg_min(type, (-c, late)) AS type, max(c) AS confidence FROM u GROUP BY 1")
def inc_appended(spark, d):
    """Records of even keys stand for the earlier extraction, of odd ones for the later."""
    from graphloom.functions.text import clamp

    n = table(spark, d, "nodes").where("id is not null")
    half = lambda k: n.where(F.col("node_key") % 2 == k).groupBy("id").agg(F.min("type").alias("type"), F.max(clamp(F.col("confidence"))).alias("confidence"))
    return P.appended(half(0), half(1), ["id"], "confidence")


# merged sessions: concepts and nodes of sessions of even and odd length of text


@query("WITH s AS (SELECT CASE WHEN length(type) % 2 = 0 THEN 'session_a' ELSE 'session_b' END AS session_id, pos, type, attributes FROM concepts), k AS (SELECT lower(regexp_replace(regexp_replace(type, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[\\s\\-_]+', '_', 'g')) AS key, * FROM s) SELECT key, count(DISTINCT session_id) AS sessions, count(DISTINCT a) AS attributes FROM (SELECT key, session_id, unnest(CASE WHEN len(attributes) > 0 THEN attributes ELSE [NULL] END) AS a FROM k) GROUP BY 1")
def mrg_schema(spark, d):
    c = table(spark, d, "concepts")
    return M.merged_schema(c.where("length(type) % 2 = 0"), c.where("length(type) % 2 = 1")).select("key", "sessions", F.size("attributes").cast("long").alias("attributes"))


@query(f"WITH {MENTIONS} SELECT id, CASE WHEN length(id) % 2 = 0 THEN 'session_a/' ELSE 'session_b/' END || source_file AS source_file, chunk_index FROM m1")
def mrg_index(spark, d):
    m = mentions(spark, d)
    return M.merged_index(m.where("length(id) % 2 = 0"), m.where("length(id) % 2 = 1")).select("id", "source_file", "chunk_index")


_REX = f"WITH {GRAPH}, {MENTIONS}, {_CK}, p AS (SELECT DISTINCT e.type AS name, n.type AS kind FROM ge e JOIN gn n ON n.id IN (e.src, e.dst)), s AS (SELECT p.name, m1.source_file, m1.chunk_index, count(*) AS score FROM p JOIN gn ON gn.type = p.kind JOIN m1 ON m1.id = gn.id GROUP BY 1, 2, 3), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, source_file, chunk_index) <= 5)"


@query(_REX + " SELECT 'full' AS strategy, count(*) AS chunks FROM ck UNION ALL SELECT 'surgical', count(*) FROM (SELECT source_file, chunk_index FROM t INTERSECT SELECT * FROM ck) UNION ALL SELECT 'none', 0")
def mrg_reextract(spark, d):
    n, e = graph(spark, d)
    t = n.select("id", "type")
    wanted = e.select(F.col("type").alias("name"), F.explode(F.array("src", "dst")).alias("id")).join(t, "id").select("name", F.col("type").alias("kind")).distinct()
    c, m = table(spark, d, "chunks"), mentions(spark, d)
    rows = [M.reextraction(s, c, wanted, t, m, 5).agg(F.lit(s).alias("strategy"), F.count("*").alias("chunks")) for s in ("full", "surgical", "none")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"WITH {PROPS} SELECT * FROM props WHERE name NOT IN ('knows', 'leads')")
def mrg_new_properties(spark, d):
    return M.new_properties(properties(spark, d), spark.createDataFrame([("knows",), ("leads",)], "name string"))


@query(f"WITH {GRAPH}, {WEAK} SELECT 'records' AS step, (SELECT count(*) FROM nodes) AS nodes, count(*) AS edges, count(*) FILTER (WHERE type IN ('knows', 'leads')) AS declared FROM edges UNION ALL SELECT 'graph', (SELECT count(*) FROM gn), count(*), count(*) FILTER (WHERE type IN ('knows', 'leads')) FROM ge UNION ALL SELECT 'strong', (SELECT count(*) FROM gn WHERE id NOT IN (SELECT id FROM orp)), count(*), count(*) FILTER (WHERE type IN ('knows', 'leads')) FROM w")
def mrg_trace(spark, d):
    n, e = graph(spark, d)
    strong = strong_edges(spark, d)
    props = spark.createDataFrame([("knows",), ("leads",)], "name string")
    kept = n.join(G.orphans(n, strong).select("id"), "id", "left_anti")
    return M.count_trace({"records": (table(spark, d, "nodes"), table(spark, d, "edges")), "graph": (n, e), "strong": (kept, strong)}, props)


@query("WITH o AS (SELECT session_id, row_number() OVER (ORDER BY session_id DESC) AS k FROM (SELECT DISTINCT session_id FROM concepts)), c AS (SELECT k, type, min(parent) AS parent, list_sort(coalesce(min(attributes), [])) AS a FROM concepts JOIN o USING (session_id) WHERE k <= 2 GROUP BY 1, 2) SELECT coalesce(n.type, b.type) AS type, CASE WHEN b.type IS NULL THEN 'added' WHEN n.type IS NULL THEN 'removed' ELSE 'altered' END AS change FROM (SELECT * FROM c WHERE k = 1) n FULL JOIN (SELECT * FROM c WHERE k = 2) b ON n.type = b.type WHERE b.type IS NULL OR n.type IS NULL OR n.parent IS DISTINCT FROM b.parent OR n.a <> b.a")
def sch_delta_types(spark, d):
    """Of the last session against the one before it."""
    c = table(spark, d, "concepts")
    last, before = [r[0] for r in c.select("session_id").distinct().orderBy(F.desc("session_id")).limit(2).collect()]
    return O.delta(c.where(F.col("session_id") == last), c.where(F.col("session_id") == before))


@query("WITH b AS (SELECT DISTINCT session_id, type FROM concepts WHERE type IS NOT NULL), n AS (SELECT session_id, count(*) AS n FROM b GROUP BY 1) SELECT session_id, CASE WHEN length(session_id) > 0 AND n % 3 = 2 THEN upper(type) ELSE type END AS type FROM b JOIN n USING (session_id)")
def sch_harmonised(spark, d):
    """A third of the schemas is rewritten in capitals; of another third the answer has one concept only, but where that is half of them; the rest gets no JSON."""
    c = table(spark, d, "concepts").where("type is not null")
    per = c.select("session_id", "type").distinct().groupBy("session_id").agg(F.array_sort(F.collect_list("type")).alias("t"))
    rows = lambda xs: F.to_json(F.struct(F.transform(xs, lambda t: F.struct(t.alias("type"), F.lit("x").alias("parent"))).alias("concepts")))
    n = F.size("t")
    answer = F.when(n % 3 == 2, rows(F.transform("t", F.upper))).when((n % 3 == 1) & (n > 2), rows(F.slice("t", 1, 1))).otherwise("no JSON")
    return O.harmonised(c, per.select("session_id", answer.alias("answer"))).select("session_id", "type")


# the model's boundary


@query("SELECT source_file AS label, CAST(len(list_distinct(regexp_extract_all(text, '\\b[A-Z][a-z]+ [A-Z][a-z]{4,}\\b'))) AS INTEGER) AS nodes, CAST(NULL AS VARCHAR) AS error FROM documents WHERE text IS NOT NULL")
def llm_roundtrip(spark, d):
    """Documents asked of a model that names the capitalised pairs of words of a text, answers parsed, nodes counted per document."""

    def model(system: str, user: str) -> str:
        import json
        import re

        found = sorted(set(re.findall(r"\b[A-Z][a-z]+ [A-Z][a-z]{4,}\b", user, re.ASCII)))
        return "```json\n" + json.dumps({"nodes": [{"id": x, "type": "Person", "confidence": 0.9, "attributes": {"name": {"value": x, "confidence": 0.9}}} for x in found], "edges": []}) + "\n```"

    docs = table(spark, d, "documents").where("text is not null")
    asked = L.tasks(docs.select(F.lit("extract").alias("system"), F.col("text").alias("user"), "source_file").withColumnRenamed("source_file", "label"))
    return L.answered(asked, L.gated(L.ask(asked, L.patiently(model)), 0)).select("label", F.size("parsed.nodes").alias("nodes"), "error")


@query("SELECT sha256('fix' || chr(10) || '--user--' || chr(10) || user_ || chr(10) || '--ctx--' || chr(10) || doc_id || ' again') AS task_id, doc_id || ' again' AS label FROM (SELECT doc_id, 'Name all.' || chr(10) || chr(10) || 'Your answer was:' || chr(10) || 'x' || doc_id || chr(10) || chr(10) || 'It is wrong: blank' || chr(10) || 'Answer again.' AS user_ FROM documents WHERE doc_id % 2 = 0)")
def llm_corrections(spark, d):
    """Every second answer was found wrong."""
    i = F.col("doc_id").cast("string")
    judged = table(spark, d, "documents").select(F.lit("t").alias("task_id"), F.lit("Name all.").alias("user"), F.concat(F.lit("x"), i).alias("answer"), i.alias("label"), F.when(F.col("doc_id") % 2 == 0, "blank").alias("error"))
    return L.corrections(judged, "fix").select("task_id", "label")


@query("WITH c AS (SELECT DISTINCT ON (source_file, chunk_index) source_file, chunk_index, list_distinct(regexp_extract_all(text, '\\b[A-Z][a-z]{5,}\\b')) AS f FROM chunks ORDER BY source_file, chunk_index, text), w AS (SELECT source_file, chunk_index, unnest(f) AS x FROM c), n AS (SELECT c.source_file, c.chunk_index, count(DISTINCT x) AS prior FROM c LEFT JOIN w ON w.source_file = c.source_file AND w.chunk_index < c.chunk_index GROUP BY 1, 2) SELECT n.*, len(f) AS found FROM n JOIN c USING (source_file, chunk_index)")
def stream_carried(spark, d):
    """A file's chunks in order, each with the number of capitalised words that those before it had."""
    import re

    c = table(spark, d, "chunks").groupBy("source_file", "chunk_index").agg(F.min("text").alias("text"))
    found = L.carried(c, lambda prior, text: sorted(set(re.findall(r"\b[A-Z][a-z]{5,}\b", text, re.ASCII))))
    return found.select("source_file", "chunk_index", F.size("prior").cast("long").alias("prior"), F.size("found").cast("long").alias("found"))


# the report


@query(f"""WITH {GRAPH}, {WEAK}, c AS (SELECT {CLAMP('confidence')} AS c FROM nodes), r AS (
SELECT 'summary' AS section, 'nodes' AS item, count(*) AS n FROM gn UNION ALL SELECT 'summary', 'edges', count(*) FROM ge UNION ALL SELECT 'summary', 'records', count(*) FROM nodes
UNION ALL SELECT 'types', type, count(*) FROM gn GROUP BY 2 UNION ALL SELECT 'edge types', type, count(*) FROM ge GROUP BY 2 UNION ALL SELECT 'methods', method, count(*) FROM edges GROUP BY 2
UNION ALL SELECT 'confidence', CASE WHEN c >= 0.9 THEN '0.9' WHEN c >= 0.7 THEN '0.7' WHEN c >= 0.5 THEN '0.5' ELSE '0.0' END, count(*) FROM c GROUP BY 2
UNION ALL SELECT 'merged', CASE WHEN k > 1 THEN 'several records' ELSE 'one record' END, count(*) FROM (SELECT id, count(DISTINCT node_key) AS k FROM nodes WHERE id IS NOT NULL GROUP BY 1) GROUP BY 2
UNION ALL SELECT 'isolated', (SELECT type FROM gn WHERE gn.id = orp.id), count(*) FROM orp GROUP BY 2 UNION ALL SELECT 'sources', 'files', count(DISTINCT f) FROM (SELECT unnest(source_files) AS f FROM nodes WHERE id IS NOT NULL)
UNION ALL SELECT 'sessions', session_id, count(*) FROM nodes GROUP BY 2 UNION ALL SELECT 'calls', event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'schema', 'concepts', count(DISTINCT type) FROM concepts UNION ALL SELECT 'schema', 'properties', count(DISTINCT type) FROM edges)
SELECT section, item, n FROM r""")
def rpt_report(spark, d):
    n, e = graph(spark, d)
    return R.run_report(table(spark, d, "nodes"), n, e, table(spark, d, "edges"), strong_edges(spark, d), table(spark, d, "concepts"), table(spark, d, "events").select(F.col("event_type").alias("stage")))
