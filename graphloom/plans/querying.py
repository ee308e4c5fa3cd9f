"""Queries on a finished graph, its ontology and its isolated nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.text import clamp, display_name
from graphloom.operators import assemble as A
from graphloom.operators import graph as G
from graphloom.operators import ontology as O
from graphloom.operators import orphans as P
from graphloom.operators.components import connected_components
from graphloom.operators.hierarchy import CYCLE, hierarchy
from graphloom.plans.building import CANON, CLAMP, properties
from graphloom.plans.general import _TREE
from graphloom.plans.registry import Catalogue, table

query = Catalogue()
QUERIES, SQL = query.queries, query.sql

GRAPH = f"""gn AS (SELECT id, min(type) AS type, min(attributes['name'].value) AS name, max({CLAMP("confidence")}) AS confidence FROM nodes WHERE id IS NOT NULL GROUP BY id),
ge AS (SELECT DISTINCT id, type, "from" AS src, "to" AS dst FROM edges WHERE "from" IS NOT NULL AND "to" IS NOT NULL),
nm AS (SELECT DISTINCT id, type, name FROM (SELECT id, type, attributes['name'].value AS name FROM nodes UNION ALL SELECT id, type, unnest(aliases) FROM nodes) WHERE id IS NOT NULL AND name IS NOT NULL),
av AS (SELECT DISTINCT id, type, unnest(map_values(attributes)).value AS value FROM nodes WHERE id IS NOT NULL),
hub AS (SELECT dst AS id FROM ge GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""
SIMPLE = "simple AS (SELECT DISTINCT src, dst FROM ge), und AS (SELECT src, dst FROM simple UNION SELECT dst, src FROM simple)"


def graph(spark, d):
    n = table(spark, d, "nodes").where("id is not null")
    name = F.try_element_at("attributes", F.lit("name")).getField("value")
    nodes = n.groupBy("id").agg(F.min("type").alias("type"), F.min(name).alias("name"), F.max(clamp(F.col("confidence"))).alias("confidence"))
    edges = table(spark, d, "edges").select("id", "type", F.col("from").alias("src"), F.col("to").alias("dst")).where("src is not null and dst is not null").distinct()
    return nodes, edges


def names(spark, d):
    n = table(spark, d, "nodes").where("id is not null")
    own = n.select("id", "type", F.try_element_at("attributes", F.lit("name")).getField("value").alias("name"))
    return own.unionByName(n.select("id", "type", F.explode("aliases").alias("name"))).where("name is not null").distinct()


def values(spark, d):
    return table(spark, d, "nodes").where("id is not null").select("id", "type", F.explode("attributes").alias("k", "a")).select("id", "type", "a.value").distinct()


def hub(spark, d):
    return graph(spark, d)[1].groupBy("dst").count().orderBy(F.desc("count"), "dst").first()["dst"]


@query(f"WITH {GRAPH}, h AS (SELECT id, max(CASE WHEN lower(name) = 'partners' THEN 100 WHEN starts_with(lower(name), 'partners') THEN 80 WHEN contains(lower(name), 'partners') THEN 60 END) AS score FROM nm GROUP BY 1), s AS (SELECT * FROM h WHERE score IS NOT NULL UNION ALL SELECT DISTINCT id, 40 FROM av WHERE contains(lower(value), 'partners') AND id NOT IN (SELECT id FROM h WHERE score IS NOT NULL)) SELECT id, score FROM s ORDER BY score DESC, id LIMIT 20")
def gq_search(spark, d):
    return G.search(names(spark, d), values(spark, d), "Partners")


@query(f"WITH {GRAPH}, h AS (SELECT DISTINCT id FROM nm WHERE type = 'Company' AND contains(lower(name), 'health')), s AS (SELECT id, 60 AS score FROM h UNION ALL SELECT DISTINCT id, 40 FROM av WHERE type = 'Company' AND contains(lower(value), 'health') AND id NOT IN (SELECT id FROM h)) SELECT id, score FROM s ORDER BY score DESC, id LIMIT 15")
def gq_search_attribute(spark, d):
    return G.search(names(spark, d), values(spark, d), "health", "Company", 15)


@query(f"WITH {GRAPH} SELECT gn.* FROM gn JOIN hub USING (id)")
def gq_node(spark, d):
    h = hub(spark, d)
    return graph(spark, d)[0].where(F.col("id") == h)


def _near(direction):
    out = "SELECT e.id AS edge_id, type, dst AS other, true AS outgoing FROM ge e JOIN hub ON src = hub.id"
    into = "SELECT e.id, type, src, false FROM ge e JOIN hub ON dst = hub.id"
    return f"WITH {GRAPH} SELECT * FROM ({ {'outgoing': out, 'incoming': into.replace('e.id,', 'e.id AS edge_id,').replace('src, false', 'src AS other, false AS outgoing'), 'both': out + ' UNION ALL ' + into}[direction] }) ORDER BY outgoing DESC, edge_id LIMIT 50"


@query(_near("both"))
def gq_neighbors_both(spark, d):
    return G.neighbours(graph(spark, d)[1], hub(spark, d))


@query(_near("outgoing"))
def gq_neighbors_out(spark, d):
    return G.neighbours(graph(spark, d)[1], hub(spark, d), "outgoing")


@query(_near("incoming"))
def gq_neighbors_in(spark, d):
    return G.neighbours(graph(spark, d)[1], hub(spark, d), "incoming")


@query(f"WITH {GRAPH} SELECT type, count(*) AS n, min(id) AS sample FROM gn GROUP BY 1")
def gq_list_types(spark, d):
    return graph(spark, d)[0].groupBy("type").agg(F.count("*").alias("n"), F.min("id").alias("sample"))


@query(f"WITH {GRAPH}, k AS (SELECT id FROM gn WHERE confidence >= 0.8 AND type IN ('Person', 'Organization')) SELECT ge.id, ge.type, src, dst FROM ge WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def gq_subgraph(spark, d):
    n, e = graph(spark, d)
    return G.subgraph(n, e, types=["Person", "Organization"], least=0.8)[1]


@query(f"WITH {GRAPH} SELECT id, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming, count(*) AS degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM ge UNION ALL SELECT dst, 0, 1 FROM ge) GROUP BY 1 ORDER BY degree DESC, id LIMIT 10")
def gq_hubs(spark, d):
    return G.hubs(graph(spark, d)[1])


@query(f"WITH {GRAPH} SELECT * FROM gn WHERE id NOT IN (SELECT src FROM ge UNION SELECT dst FROM ge)")
def gq_orphans(spark, d):
    return G.orphans(*graph(spark, d))


_COMP = f"WITH RECURSIVE {GRAPH}, {SIMPLE}, r(v, u) AS (SELECT src, dst FROM und UNION SELECT r.v, und.dst FROM r JOIN und ON und.src = r.u), comp AS (SELECT v AS vertex, least(min(u), v) AS component FROM r GROUP BY v)"


@query(_COMP + " SELECT * FROM comp")
def gq_components(spark, d):
    return connected_components(graph(spark, d)[1], "src", "dst")


@query(_COMP + """, ids AS (SELECT id FROM gn UNION SELECT src FROM simple UNION SELECT dst FROM simple), c AS (SELECT count(*) AS n, (SELECT count(*) FROM simple) AS m, count(*) - (SELECT count(*) FROM comp) AS alone FROM ids)
SELECT n AS nodes, m AS edges, round(m / (n * (n - 1.0)), 6) AS density, (SELECT count(DISTINCT component) FROM comp) + alone AS components, round(2.0 * m / n, 2) AS mean_degree, (SELECT count(*) FROM simple WHERE src = dst) AS loops,
(SELECT string_agg(type || '=' || n, '; ' ORDER BY n DESC, type) FROM (SELECT type, count(*) AS n FROM gn GROUP BY 1)) AS types, (SELECT count(DISTINCT f) FROM (SELECT unnest(source_files) AS f FROM nodes WHERE id IS NOT NULL)) AS source_files FROM c""")
def gq_stats(spark, d):
    return G.statistics(*graph(spark, d), table(spark, d, "nodes").where("id is not null").select(F.explode("source_files").alias("source_file")))


@query(f"WITH {GRAPH}, {SIMPLE}, h0 AS (SELECT id FROM gn ORDER BY id LIMIT 3), h1 AS (SELECT h0.id AS seed, dst AS id FROM h0 JOIN und ON src = h0.id), h2 AS (SELECT seed, dst AS id FROM h1 JOIN und ON src = h1.id), a AS (SELECT id AS seed, id, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) SELECT seed, id, min(hop) AS hop FROM a GROUP BY 1, 2")
def gq_bfs_depth2(spark, d):
    n, e = graph(spark, d)
    return G.within(e, n.select("id").orderBy("id").limit(3), 2)


@query(f"WITH {GRAPH}, {SIMPLE}, s AS (SELECT id, max(CASE WHEN lower(name) = 'logistics' THEN 100 WHEN contains(lower(name), 'logistics') OR (name <> '' AND contains('logistics', lower(name))) THEN 60 END) AS score FROM nm WHERE name <> '' GROUP BY 1), b AS (SELECT * FROM s WHERE score IS NOT NULL UNION ALL SELECT DISTINCT id, 40 FROM av WHERE contains(lower(value), 'logistics') AND id NOT IN (SELECT id FROM s WHERE score IS NOT NULL)), h0 AS (SELECT id FROM b ORDER BY score DESC, id LIMIT 3), h1 AS (SELECT h0.id AS seed, dst AS id FROM h0 JOIN und ON src = h0.id), h2 AS (SELECT seed, dst AS id FROM h1 JOIN und ON src = h1.id), a AS (SELECT id AS seed, id, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) SELECT seed, id, min(hop) AS hop FROM a GROUP BY 1, 2")
def gq_context(spark, d):
    seeds = G.context_seeds(names(spark, d), values(spark, d), "Logistics").select("id")
    return G.within(graph(spark, d)[1], seeds, 2)


@query(f"WITH RECURSIVE {GRAPH}, {SIMPLE}, s AS (SELECT min(src) AS a FROM simple WHERE src <> dst), r(id, hop) AS (SELECT a, 0 FROM s UNION SELECT dst, hop + 1 FROM r JOIN simple ON src = r.id WHERE hop < 4), f AS (SELECT id, min(hop) AS hop FROM r GROUP BY 1) SELECT hop, count(*) AS n FROM f GROUP BY 1")
def gq_reach(spark, d):
    """How many vertices are reached in how many steps along the edges."""
    e = graph(spark, d)[1]
    a = e.where("src <> dst").agg(F.min("src").alias("id"))
    return G.within(e, a, 4, directed=True).groupBy("hop").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {GRAPH}, {SIMPLE}, s AS (SELECT min(src) AS a FROM simple WHERE src <> dst), r(id, hop) AS (SELECT a, 0 FROM s UNION SELECT dst, hop + 1 FROM r JOIN simple ON src = r.id WHERE hop < 5),
f AS (SELECT id, min(hop) AS hop FROM r GROUP BY 1), t AS (SELECT hop, id FROM f WHERE hop = (SELECT max(hop) FROM f WHERE hop <= 3) ORDER BY id LIMIT 1),
p(hop, id) AS (SELECT hop, id FROM t UNION ALL SELECT p.hop - 1, (SELECT min(src) FROM simple JOIN f ON f.id = simple.src WHERE dst = p.id AND f.hop = p.hop - 1) FROM p WHERE p.hop > 0) SELECT hop, id FROM p""")
def gq_shortest_path(spark, d):
    e = graph(spark, d)[1]
    a = e.where("src <> dst").agg(F.min("src").alias("id"))
    far = G.within(e, a, 3, directed=True)
    t = far.orderBy(F.desc("hop"), "id").first()
    return G.shortest_path(e, t["seed"], t["id"])


#: The chunk of each of its files that a node stands in: one of those cut earlier, by the length of its id; the first where none were.
MENTIONS = "cn AS (SELECT source_file, max(chunk_index) + 1 AS n FROM chunks GROUP BY 1), mn AS (SELECT DISTINCT id, unnest(source_files) AS source_file FROM nodes WHERE id IS NOT NULL), m1 AS (SELECT id, source_file, CAST(length(id) % coalesce(n, 1) AS INTEGER) AS chunk_index FROM mn LEFT JOIN cn USING (source_file) WHERE trim(source_file) <> '')"


def mentions(spark, d):
    m = table(spark, d, "nodes").where("id is not null").select("id", F.explode("source_files").alias("source_file")).distinct().where("trim(source_file) <> ''")
    n = table(spark, d, "chunks").groupBy("source_file").agg((F.max("chunk_index") + 1).alias("n"))
    return m.join(n, "source_file", "left").select("id", "source_file", (F.length("id") % F.coalesce("n", F.lit(1))).cast("int").alias("chunk_index"))


@query(f"WITH {GRAPH}, {MENTIONS}, b AS (SELECT g.src, g.dst, s.source_file FROM ge g JOIN m1 s ON s.id = g.src JOIN m1 t ON t.id = g.dst AND t.source_file = s.source_file ORDER BY ALL LIMIT 1), k AS (SELECT m1.source_file, chunk_index, bool_or(id = b.src) AND bool_or(id = b.dst) AS exact FROM m1, b WHERE id IN (b.src, b.dst) GROUP BY 1, 2) SELECT * FROM k WHERE exact = (SELECT bool_or(exact) FROM k) ORDER BY source_file LIMIT 3")
def gq_edge_chunks(spark, d):
    m, e = mentions(spark, d), graph(spark, d)[1]
    s = e.join(m.select(F.col("id").alias("src"), "source_file"), "src").join(m.select(F.col("id").alias("dst"), "source_file"), ["dst", "source_file"])
    r = s.orderBy("src", "dst", "source_file").first()
    return G.source_chunks(m, r["src"], r["dst"])


@query("SELECT id, coalesce(nullif(attributes['name'].value, ''), nullif(attributes['subject'].value, ''), nullif(attributes['title'].value, ''), id) AS name FROM nodes")
def prj_display_name(spark, d):
    return table(spark, d, "nodes").select("id", display_name(F.col("attributes"), F.col("id")).alias("name"))


# the ontology


_WALK = """WITH RECURSIVE one AS (SELECT session_id, type, min(parent) AS parent FROM concepts WHERE type IS NOT NULL GROUP BY 1, 2),
w(session_id, type, above, up) AS (SELECT session_id, type, parent, [type] FROM one
  UNION ALL SELECT w.session_id, w.type, o.parent, list_append(w.up, o.type) FROM w JOIN one o ON o.session_id = w.session_id AND o.type = w.above WHERE NOT list_contains(w.up, o.type)),
tree AS (SELECT session_id, type, list_reverse(arg_max(up, len(up))) AS up FROM w GROUP BY 1, 2)"""


@query(_WALK + """, atr AS (SELECT session_id, type, arg_min(attributes, pos) AS a FROM concepts WHERE attributes IS NOT NULL GROUP BY 1, 2),
x AS (SELECT session_id, type, unnest(up) AS anc, generate_subscripts(up, 1) AS k FROM tree)
SELECT x.session_id, x.type, array_to_string(flatten(list(coalesce(atr.a, []) ORDER BY k)), '|') AS attributes FROM x LEFT JOIN atr ON atr.session_id = x.session_id AND atr.type = x.anc GROUP BY 1, 2""")
def sch_flatten(spark, d):
    c = table(spark, d, "concepts")
    return O.flatten(c).select("session_id", "type", F.array_join("attributes", "|").alias("attributes"))


@query(_WALK + " SELECT session_id, type, unnest(up) AS ancestor FROM tree")
def sch_ancestors(spark, d):
    return O.ancestors(table(spark, d, "concepts"))


_LAST = "last AS (SELECT max(session_id) AS session_id FROM concepts), c AS (SELECT DISTINCT type FROM concepts WHERE session_id = (SELECT session_id FROM last))"


@query("WITH s AS (SELECT DISTINCT session_id, type FROM concepts), o AS (SELECT session_id, row_number() OVER (ORDER BY session_id) AS k FROM (SELECT DISTINCT session_id FROM concepts)), p AS (SELECT s.*, k FROM s JOIN o USING (session_id)), a AS (SELECT coalesce(x.k, y.k + 1) AS k, x.type IS NOT NULL AND y.type IS NULL AS added, x.type IS NULL AS removed FROM p x FULL JOIN p y ON x.type = y.type AND x.k = y.k + 1) SELECT o.session_id, count(*) FILTER (WHERE added) AS added, count(*) FILTER (WHERE removed) AS removed FROM a JOIN o USING (k) GROUP BY 1")
def sch_delta(spark, d):
    return O.history(table(spark, d, "concepts"))


@query(f"WITH s AS (SELECT session_id, pos, type, attributes FROM concepts), k AS (SELECT lower(regexp_replace(regexp_replace(type, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[\\s\\-_]+', '_', 'g')) AS key, * FROM s) SELECT key, arg_min(type, (session_id, pos)) AS type, count(DISTINCT session_id) AS sessions, count(DISTINCT a) AS attributes FROM (SELECT key, type, session_id, pos, unnest(CASE WHEN len(attributes) > 0 THEN attributes ELSE [NULL] END) AS a FROM k) GROUP BY 1")
def sch_merge_proposals(spark, d):
    m = O.merge_proposals(table(spark, d, "concepts"))
    return m.select("key", "type", "sessions", F.size("attributes").cast("long").alias("attributes"))


_PAIR = "props AS (SELECT DISTINCT e.type AS name, n.type AS domain, m.type AS range FROM edges e JOIN (SELECT DISTINCT id, type FROM nodes) n ON n.id = e.\"from\" JOIN (SELECT DISTINCT id, type FROM nodes) m ON m.id = e.\"to\")"
@query("WITH RECURSIVE l AS (SELECT DISTINCT session_id, type, parent FROM concepts), anc(session_id, type, a) AS (SELECT DISTINCT session_id, type, type FROM l UNION SELECT l.session_id, l.type, l.parent FROM l WHERE l.parent IS NOT NULL UNION SELECT l.session_id, l.type, x.a FROM l JOIN anc x ON x.type = l.parent AND x.session_id = l.session_id), " + _PAIR + ", dr AS (SELECT DISTINCT domain, range FROM props) SELECT DISTINCT x.session_id, x.type AS a, y.type AS b FROM dr p JOIN anc x ON x.a = p.domain JOIN anc y ON y.a = p.range AND y.session_id = x.session_id UNION SELECT DISTINCT x.session_id, y.type, x.type FROM dr p JOIN anc x ON x.a = p.domain JOIN anc y ON y.a = p.range AND y.session_id = x.session_id")
def sch_compatible_all(spark, d):
    """Of all properties, through all parent links of each session; hierarchies of different sessions don't mix."""
    return O.compatible(O.closure(table(spark, d, "concepts"), ("session_id",)), properties(spark, d), ("session_id",))


@query("WITH p AS (SELECT DISTINCT e.type AS name, n.type AS domain, m.type AS range FROM edges e JOIN (SELECT DISTINCT id, type FROM nodes) n ON n.id = e.\"from\" JOIN (SELECT DISTINCT id, type FROM nodes) m ON m.id = e.\"to\"), b AS (SELECT domain AS type, name || ' -> ' || range AS o, NULL AS i, name, range AS other FROM p UNION ALL SELECT range, NULL, name || ' <- ' || domain, name, domain FROM p) SELECT type, string_agg(o, '; ' ORDER BY name, other) AS outgoing, string_agg(i, '; ' ORDER BY name, other) AS incoming FROM b GROUP BY 1")
def sch_edge_listing(spark, d):
    return O.edge_listing(properties(spark, d))


@query(_TREE + "SELECT session_id, type, depth, lpad('', 2 * depth, ' ') || '- ' || type AS line, path FROM tree")
def sch_tree(spark, d):
    return O.rendered(hierarchy(table(spark, d, "concepts")).where(F.col("root") != CYCLE))


# isolated nodes

WEAK = "w AS (SELECT e.* FROM ge e JOIN (SELECT id, max(CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0 ELSE confidence END) AS c FROM edges GROUP BY 1) x USING (id) WHERE x.c >= 0.9), orp AS (SELECT id FROM gn WHERE id NOT IN (SELECT src FROM w UNION SELECT dst FROM w))"


def strong_edges(spark, d):
    """Edges of a confidence of 0.9 at least, so that nodes without one are isolated."""
    e = table(spark, d, "edges").select("id", F.when(F.col("confidence").isNull() | F.isnan("confidence"), 0.0).otherwise(F.col("confidence")).alias("c")).groupBy("id").agg(F.max("c").alias("c")).where("c >= 0.9")
    return graph(spark, d)[1].join(e.select("id"), "id", "left_semi")


_CAND = f"""WITH {GRAPH}, {WEAK}, {MENTIONS}, co AS (SELECT a.id AS orphan, b.id AS peer, count(*) AS shared FROM m1 a JOIN orp o ON o.id = a.id JOIN m1 b ON b.source_file = a.source_file AND b.chunk_index = a.chunk_index AND b.id <> a.id GROUP BY 1, 2),
big AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM m1 GROUP BY id)), tp AS (SELECT DISTINCT x.type AS a, y.type AS b FROM ge JOIN gn x ON x.id = src JOIN gn y ON y.id = dst),
ok AS (SELECT co.* FROM co JOIN gn x ON x.id = orphan JOIN gn y ON y.id = peer WHERE EXISTS (SELECT 1 FROM tp WHERE (a = x.type AND b = y.type) OR (a = y.type AND b = x.type)))"""


def _orphan_inputs(spark, d):
    n, e = graph(spark, d)
    t = n.select("id", "type")
    pairs = e.join(t.select(F.col("id").alias("src"), F.col("type").alias("a")), "src").join(t.select(F.col("id").alias("dst"), F.col("type").alias("b")), "dst").select("a", "b").distinct()
    return G.orphans(n, strong_edges(spark, d)).select("id"), t, mentions(spark, d), pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


@query(_CAND + " SELECT orphan, peer, shared, round(least(1.0, shared / n), 4) AS score FROM ok, big QUALIFY row_number() OVER (PARTITION BY orphan ORDER BY shared DESC, peer) <= 3")
def orp_candidates(spark, d):
    return P.candidates(*_orphan_inputs(spark, d), top=3)


@query(_CAND + " SELECT DISTINCT orphan FROM co WHERE orphan NOT IN (SELECT orphan FROM ok WHERE shared >= 2)")
def orp_gap(spark, d):
    return P.schema_gaps(*_orphan_inputs(spark, d), least=2)


@query(f"WITH {GRAPH}, {WEAK}, {MENTIONS} SELECT source_file, chunk_index, string_agg(m1.id, ',' ORDER BY m1.id) FILTER (WHERE o.id IS NOT NULL) AS orphans, count(*) FILTER (WHERE o.id IS NULL) AS connected FROM m1 LEFT JOIN orp o ON o.id = m1.id GROUP BY 1, 2 HAVING count(o.id) > 0")
def orp_chunk_groups(spark, d):
    o, _, m, _ = _orphan_inputs(spark, d)
    return P.chunk_groups(o, m)


@query(f"WITH {GRAPH}, {WEAK}, {MENTIONS} SELECT id FROM orp WHERE id NOT IN (SELECT id FROM m1)")
def orp_unresolvable(spark, d):
    o, _, m, _ = _orphan_inputs(spark, d)
    return P.unresolvable(o, m)


_INC = f"WITH {GRAPH}, {MENTIONS}, p AS (SELECT DISTINCT e.type AS name, n.type AS kind FROM ge e JOIN gn n ON n.id IN (e.src, e.dst)), s AS (SELECT p.name, m1.source_file, m1.chunk_index, count(*) AS score FROM p JOIN gn ON gn.type = p.kind JOIN m1 ON m1.id = gn.id GROUP BY 1, 2, 3)"


@query(_INC + " SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, source_file, chunk_index) <= 5")
def inc_surgical_topk(spark, d):
    n, e = graph(spark, d)
    t = n.select("id", "type")
    p = e.select(F.col("type").alias("name"), F.explode(F.array("src", "dst")).alias("id")).join(t, "id").select("name", F.col("type").alias("kind")).distinct()
    return P.surgical_chunks(p, t, mentions(spark, d), 5)


@query(f"WITH {MENTIONS}, k(name, prefix) AS (VALUES ('law', 'lawyer'), ('care', 'nurse'), ('care', 'coach')), s AS (SELECT name, source_file, chunk_index, count(*) AS score FROM m1 JOIN k ON k.prefix = split_part(id, '-', 1) GROUP BY 1, 2, 3) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, source_file, chunk_index) <= 4")
def inc_backfill_topk(spark, d):
    k = spark.createDataFrame([("law", "lawyer"), ("care", "nurse"), ("care", "coach")], "name string, prefix string")
    return P.backfill_chunks(k, mentions(spark, d), 4)


_RENAMED = f"ren AS (SELECT id AS old, min(regexp_replace(lower(type), '[^a-z0-9]', '', 'g') || '-' || id) AS new FROM nodes WHERE type <> 'Person' GROUP BY 1)"


@query(f"WITH {MENTIONS}, {_RENAMED} SELECT coalesce(new, id) AS id, source_file, chunk_index FROM m1 LEFT JOIN ren ON old = id")
def nrm_remap(spark, d):
    ren = table(spark, d, "nodes").where("type <> 'Person'").select(F.col("id").alias("old"), F.concat(F.regexp_replace(F.lower("type"), "[^a-z0-9]", ""), F.lit("-"), "id").alias("new")).groupBy("old").agg(F.min("new").alias("new"))
    return A.remap_ids(mentions(spark, d), ren)


@query("WITH n AS (SELECT DISTINCT type, attributes['name'].value AS name FROM nodes WHERE attributes['name'].value <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY name) - 1 AS k, count(*) OVER (PARTITION BY type) AS c FROM n) SELECT type, CAST(k // 40 AS INTEGER) AS request, count(*) AS names, min(name) AS first FROM k WHERE c >= 2 GROUP BY 1, 2")
def nrm_requests(spark, d):
    n = table(spark, d, "nodes").select("type", F.try_element_at("attributes", F.lit("name")).getField("value").alias("name"))
    r = A.names_to_review(A.name_inventory(n), 2, 40)
    return r.select("type", "request", F.size("names").cast("long").alias("names"), F.get("names", F.lit(0)).alias("first"))


@query(f"WITH {GRAPH}, {WEAK}, o AS (SELECT DISTINCT n.id, n.attributes['name'].value AS name, unnest(n.source_files) AS source_file FROM nodes n JOIN orp USING (id)), h AS (SELECT o.id, c.source_file, c.chunk_index FROM o JOIN chunks c USING (source_file) WHERE name <> '' AND contains(lower(c.text), lower(name))) SELECT id, arg_min(source_file, (source_file, chunk_index)) AS source_file, arg_min(chunk_index, (source_file, chunk_index)) AS chunk_index FROM h GROUP BY 1")
def orp_recovered(spark, d):
    """The chunks cut earlier stand for those that failed."""
    n, _ = graph(spark, d)
    o = table(spark, d, "nodes").join(G.orphans(n, strong_edges(spark, d)).select("id"), "id", "left_semi")
    o = o.select("id", F.try_element_at("attributes", F.lit("name")).getField("value").alias("name"), "source_files")
    return P.recovered(o, table(spark, d, "chunks").select("source_file", "chunk_index", "text"))


@query("WITH RECURSIVE l AS (SELECT DISTINCT type, parent FROM concepts), anc(type, ancestor) AS ((SELECT type, type FROM l UNION SELECT type, parent FROM l WHERE parent IS NOT NULL) UNION SELECT l.type, x.ancestor FROM l JOIN anc x ON x.type = l.parent) SELECT * FROM anc")
def sch_closure(spark, d):
    """Of all sessions at once, with several parents to a type and loops."""
    return O.closure(table(spark, d, "concepts").select("type", "parent").distinct())
