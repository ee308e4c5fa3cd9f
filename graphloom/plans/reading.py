"""Queries on sources and files, texts, budgets, and what a graph is read for: summaries, paths, context, excerpts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.text import duration, file_slug, seconds_of, without_counter, without_fence
from graphloom.operators import assemble as A
from graphloom.operators import chunks as C
from graphloom.operators import graph as G
from graphloom.operators import ontology as O
from graphloom.operators import orphans as P
from graphloom.operators import validate as V
from graphloom.plans.building import occurrences, properties
from graphloom.plans.querying import GRAPH, MENTIONS, SIMPLE, graph, hub, mentions, names, values
from graphloom.plans.registry import Catalogue, table
from graphloom.plans.texts import FILES, WINDOWS, _chunk_sizes, _packed, files
from graphloom.sources import files as S

query = Catalogue()
QUERIES, SQL = query.queries, query.sql

# budgets and batches


def _NICE(x):
    return "CASE " + " ".join(f"WHEN {x} >= {s} THEN {x} // {s} * {s}" for s in C.STEPS) + f" ELSE {x} END"


@query(f"""WITH h AS (SELECT doc_id, 900 + doc_id * 37 % 250000 AS headroom FROM documents), r AS (SELECT *, CAST(floor(headroom * 0.95::DOUBLE) AS BIGINT) AS x FROM h),
b AS (SELECT *, {_NICE('x')} AS request FROM r), c AS (SELECT *, request // 12 AS y FROM b), w AS (SELECT *, greatest({_NICE('y')}, 100) AS chunk FROM c), o AS (SELECT *, CAST(floor(chunk * 0.1::DOUBLE) AS BIGINT) AS z FROM w)
SELECT doc_id, headroom, request, chunk, greatest({_NICE('z')}, 10) AS overlap, (headroom - request) * 4 AS reserve_chars FROM o""")
def chk_token_budget(spark, d):
    """Budgets for as many sizes of a model's room as there are documents."""
    return C.token_budgets(table(spark, d, "documents").select("doc_id", (F.lit(900) + F.col("doc_id") * 37 % 250000).alias("headroom")), "headroom")


@query(f"WITH {WINDOWS} SELECT source_file || '::' || (chunk_index + 1) AS chunk_key, text FROM ch")
def chk_texts(spark, d):
    return C.chunk_texts(C.chunk(table(spark, d, "documents").select("source_file", F.col("text").alias("content")), 200, 20))


@query("WITH " + _packed("""n AS (SELECT DISTINCT type, attributes['name'].value AS name FROM nodes WHERE attributes['name'].value <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY name) AS k FROM n),
t AS (SELECT type, count(*) AS n, CAST(sum(strlen(name) + 4) AS BIGINT) AS bytes FROM k WHERE k <= 40 GROUP BY 1), it AS (SELECT 0 AS one, type, CAST((bytes + strlen(type) + 4) // 4 AS BIGINT) AS tokens FROM t WHERE n >= 2)""", "one", "type") + " SELECT type, tokens, batch AS request FROM p JOIN i USING (one, k)")
def chk_inventory(spark, d):
    n = table(spark, d, "nodes").select("type", F.try_element_at("attributes", F.lit("name")).getField("value").alias("name"))
    return C.inventory_requests(A.name_inventory(n), 450, 40)


@query("WITH " + _packed(WINDOWS + ", it AS (SELECT source_file, chunk_index, token_end - token_start AS tokens FROM ch)", "source_file", "chunk_index") + ", s AS (SELECT source_file AS files, batch, count(*) AS chunk_count FROM p JOIN i USING (source_file, k) GROUP BY 1, 2) SELECT files, batch, chunk_count FROM s WHERE NOT (batch % 2 = 0 AND chunk_count % 3 <> 0)")
def chk_unfinished(spark, d):
    """Batches against an earlier run that knew every second of them, a third of these with another number of chunks."""
    s = C.pack(_chunk_sizes(spark, d), ["source_file"], ["chunk_index"], "tokens", 450).groupBy(F.col("source_file").alias("files"), "batch").agg(F.count("*").alias("chunk_count"))
    return C.unfinished(s, s.where("batch % 2 = 0").withColumn("chunk_count", F.when(F.col("chunk_count") % 3 == 0, F.col("chunk_count") + 1).otherwise(F.col("chunk_count"))))


# repairs


@query("SELECT node_key, array_to_string(list_filter(coalesce(aliases, []), lambda x: x IS NOT NULL), '|') AS aliases FROM nodes")
def flt_nulls(spark, d):
    return table(spark, d, "nodes").select("node_key", F.array_join(V.without_nulls(F.col("aliases")), "|").alias("aliases"))


@query("SELECT node_key, e.key AS attr, e.value.value AS value, coalesce(CASE WHEN isnan(e.value.confidence) THEN NULL ELSE e.value.confidence END, CASE WHEN e.value.value IS NULL THEN 0.0 ELSE 0.5 END) AS confidence FROM (SELECT node_key, unnest(map_entries(attributes)) AS e FROM nodes)")
def flt_scalars(spark, d):
    """Confidences that are no number count as missing."""
    long = table(spark, d, "nodes").select("node_key", F.explode("attributes").alias("attr", "a"))
    return long.select("node_key", "attr", V.scalar_value(F.col("a.value"), F.when(~F.isnan("a.confidence"), F.col("a.confidence"))).alias("s")).select("node_key", "attr", "s.value", "s.confidence")


@query("SELECT session_id, pos, type, array_to_string(list_filter(coalesce(attributes, []), lambda x: x IS NOT NULL), '|') AS attributes FROM concepts WHERE type IS NOT NULL")
def flt_schema_clean(spark, d):
    return O.cleaned_schema(table(spark, d, "concepts")).select("session_id", "pos", "type", F.array_join("attributes", "|").alias("attributes"))


_GUARD = "b AS (SELECT session_id, type FROM concepts), a AS (SELECT session_id, type FROM concepts WHERE parent IS NOT NULL), x AS (SELECT count(*) AS n, (SELECT count(*) FROM b) AS m FROM a)"


@query(f"WITH {_GUARD} SELECT * FROM a WHERE (SELECT n > 0 AND 2 * n >= m FROM x) UNION ALL SELECT * FROM b WHERE NOT (SELECT n > 0 AND 2 * n >= m FROM x)")
def flt_schema_guard(spark, d):
    c = table(spark, d, "concepts")
    return V.keep_if_whole(c.select("session_id", "type"), c.where("parent is not null").select("session_id", "type"))


@query("""WITH props AS (SELECT DISTINCT e.type AS name, n.type AS domain, m.type AS range FROM edges e JOIN (SELECT DISTINCT id, type FROM nodes) n ON n.id = e."from" JOIN (SELECT DISTINCT id, type FROM nodes) m ON m.id = e."to"), k AS (SELECT DISTINCT type FROM concepts WHERE parent IS NULL)
SELECT * FROM props WHERE domain IN (SELECT type FROM k) AND range IN (SELECT type FROM k)""")
def flt_gap_proposals(spark, d):
    """The properties that edges show stand for proposals; the types at the top of a session's hierarchy are declared."""
    return P.proposed_properties(properties(spark, d), table(spark, d, "concepts").where("parent is null"))


# reading a graph


@query(f"WITH {GRAPH}, near AS (SELECT * FROM (SELECT e.id AS edge_id, dst AS other, true AS outgoing FROM ge e JOIN hub ON src = hub.id UNION ALL SELECT e.id, src, false FROM ge e JOIN hub ON dst = hub.id) ORDER BY outgoing DESC, edge_id LIMIT 50) SELECT DISTINCT other AS id, type, name FROM near LEFT JOIN gn ON gn.id = other")
def gq_neighbor_summaries(spark, d):
    n, e = graph(spark, d)
    return G.neighbour_summaries(G.neighbours(e, hub(spark, d)), n)


@query(f"WITH {GRAPH}, k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY id) AS k FROM gn) SELECT type, count(*) AS n, string_agg(id, ',' ORDER BY id) FILTER (WHERE k <= 3) AS samples FROM k GROUP BY 1")
def gq_type_counts(spark, d):
    return G.type_counts(graph(spark, d)[0]).withColumn("samples", F.array_join("samples", ","))


@query(f"""WITH RECURSIVE {GRAPH}, {SIMPLE}, s AS (SELECT min(src) AS a FROM simple WHERE src <> dst), r(id, hop) AS (SELECT a, 0 FROM s UNION SELECT dst, hop + 1 FROM r JOIN simple ON src = r.id WHERE hop < 5),
f AS (SELECT id, min(hop) AS hop FROM r GROUP BY 1), t AS (SELECT hop, id FROM f WHERE hop = (SELECT max(hop) FROM f WHERE hop <= 3) ORDER BY id LIMIT 1),
p(hop, id) AS (SELECT hop, id FROM t UNION ALL SELECT p.hop - 1, (SELECT min(src) FROM simple JOIN f ON f.id = simple.src WHERE dst = p.id AND f.hop = p.hop - 1) FROM p WHERE p.hop > 0),
st AS (SELECT a.hop + 1 AS hop, a.id AS here, b.id AS other FROM p a JOIN p b ON b.hop = a.hop + 1)
SELECT hop, min(id) AS edge_id, arg_min(type, (id, type)) AS type, arg_min(src, (id, type)) AS src, arg_min(dst, (id, type)) AS dst FROM st JOIN ge ON (src = here AND dst = other) OR (src = other AND dst = here) GROUP BY 1""")
def gq_path_edges(spark, d):
    e = _sure_edges(spark, d)
    a = e.where("src <> dst").agg(F.min("src").alias("id"))
    t = G.within(e, a, 3, directed=True).orderBy(F.desc("hop"), "id").first()
    return G.path_edges(G.shortest_path(e, t["seed"], t["id"]), e)


def _sure_edges(spark, d):
    """The graph's edges with a confidence: the highest of those delivered."""
    c = table(spark, d, "edges").select("id", F.when(F.col("confidence").between(0, 1), F.col("confidence")).alias("c")).groupBy("id").agg(F.max("c").alias("confidence"))
    return graph(spark, d)[1].join(c, "id", "left")


_SURE = "se AS (SELECT ge.*, c.confidence FROM ge LEFT JOIN (SELECT id, max(CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END) AS confidence FROM edges GROUP BY 1) c USING (id))"
_QUESTION, _ROOM = "Logistics", 4 * 600


@query(f"""WITH {GRAPH}, {SIMPLE}, {_SURE},
s AS (SELECT id, max(CASE WHEN lower(name) = 'logistics' THEN 100 WHEN contains(lower(name), 'logistics') OR (name <> '' AND contains('logistics', lower(name))) THEN 60 END) AS score FROM nm WHERE name <> '' GROUP BY 1), b AS (SELECT * FROM s WHERE score IS NOT NULL UNION ALL SELECT DISTINCT id, 40 FROM av WHERE contains(lower(value), 'logistics') AND id NOT IN (SELECT id FROM s WHERE score IS NOT NULL)),
h0 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS place FROM b ORDER BY score DESC, id LIMIT 3),
h1 AS (SELECT h0.id AS seed, dst AS id FROM h0 JOIN und ON src = h0.id), h2 AS (SELECT seed, dst AS id FROM h1 JOIN und ON src = h1.id),
w AS (SELECT seed, id, min(hop) AS hop FROM (SELECT id AS seed, id, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY 1, 2),
inc AS (SELECT *, src AS here, dst AS other FROM se UNION ALL SELECT *, dst, src FROM se),
tr AS (SELECT w.seed, w.id, w.hop, min((here, inc.id, inc.type, src, dst, confidence)) AS m FROM w JOIN inc ON other = w.id JOIN w x ON x.seed = w.seed AND x.id = inc.here AND x.hop = w.hop - 1 GROUP BY 1, 2, 3),
te AS (SELECT seed, id, hop, m[2] AS edge_id, '- ' || m[4] || ' --[' || m[3] || ']--> ' || m[5] || ' (conf=' || printf('%.2f', coalesce(m[6], 0.0)) || ')' AS line FROM tr),
o AS (SELECT id, min(hop) AS hop FROM w GROUP BY 1),
mx AS (SELECT id, string_agg(attr || '=' || value, ', ' ORDER BY attr) AS x FROM (SELECT id, e.key AS attr, max(e.value.value) AS value FROM (SELECT id, unnest(map_entries(attributes)) AS e FROM nodes) WHERE e.value.value <> '' AND e.key <> 'name' GROUP BY 1, 2) GROUP BY 1),
head AS (SELECT unnest([0, 1, 2, 3, 4]) AS pos, unnest(['# Context: {_QUESTION}', (SELECT 'Seeds: ' || string_agg(id, ', ' ORDER BY place) || ' | Mode: bfs | Depth: 2' FROM h0), 'Nodes: ' || (SELECT count(*) FROM o) || ' | Edges: ' || (SELECT count(*) FROM te), '', '## Nodes']) AS line),
nl AS (SELECT row_number() OVER (ORDER BY hop, gn.id) AS k, '- [' || coalesce(type, '') || '] ' || coalesce(nullif(name, ''), gn.id) || ' (' || gn.id || ') conf=' || printf('%.2f', coalesce(confidence, 0.0)) || coalesce(' (' || x || ')', '') AS line FROM o JOIN gn USING (id) LEFT JOIN mx ON mx.id = gn.id),
nc AS (SELECT *, (SELECT sum(length(line)) FROM head) + sum(length(line)) OVER (ORDER BY k) AS upto FROM nl), nk AS (SELECT * FROM nc WHERE upto - length(line) <= {_ROOM}),
n2 AS (SELECT k + 4 AS pos, line FROM nk UNION ALL SELECT max(k) + 5, '... (cut at the budget)' FROM nk HAVING max(upto) > {_ROOM}), u AS (SELECT coalesce(max(upto), (SELECT sum(length(line)) FROM head)) AS used, coalesce(max(k), 0) + 4 AS last FROM nk),
el AS (SELECT row_number() OVER (ORDER BY o, edge_id) AS k, line FROM (SELECT edge_id, min((place, hop, te.id)) AS o, min(line) AS line FROM te JOIN h0 ON h0.id = te.seed GROUP BY 1)),
ec AS (SELECT *, (SELECT used FROM u) + 16 + sum(length(line)) OVER (ORDER BY k) AS upto FROM el), ek AS (SELECT * FROM ec WHERE upto - length(line) <= {_ROOM} AND (SELECT used FROM u) < {_ROOM}),
e2 AS (SELECT (SELECT last FROM u) + 2 + k AS pos, line FROM ek UNION ALL SELECT (SELECT last FROM u) + 3 + max(k), '... (cut at the budget)' FROM ek HAVING max(upto) > {_ROOM} UNION ALL SELECT last + 1, '' FROM u WHERE used < {_ROOM} UNION ALL SELECT last + 2, '## Relationships' FROM u WHERE used < {_ROOM})
SELECT CAST(pos AS INTEGER) AS pos, line FROM head UNION ALL SELECT CAST(pos AS INTEGER), line FROM n2 UNION ALL SELECT CAST(pos AS INTEGER), line FROM e2""")
def gq_context_text(spark, d):
    n = graph(spark, d)[0]
    long = table(spark, d, "nodes").where("id is not null").select("id", F.explode("attributes").alias("attr", "a")).select("id", "attr", "a.value")
    seeds = [r["id"] for r in G.context_seeds(names(spark, d), values(spark, d), _QUESTION).collect()]
    return G.context_text(n, long, _sure_edges(spark, d), seeds, _QUESTION, budget=_ROOM // 4)


def EXCERPT(rows: str) -> str:
    """CTEs that end in `ex` (all columns of `rows` and excerpt): rows has text and names (a list, small letters)."""
    return f"""e0 AS (SELECT *, lower(text) AS low, length(text) AS n FROM {rows}),
e1 AS (SELECT *, flatten(list_transform(list_filter(names, lambda x: x <> ''), lambda x: list_transform(range(1, len(string_split(low, x))), lambda k: CAST(list_sum(list_transform(string_split(low, x)[1:k], lambda y: length(y))) + (k - 1) * length(x) AS BIGINT)))) AS ps FROM e0),
e2 AS (SELECT *, list_transform(list_sort(list_distinct(ps)), lambda p: [{{'a': greatest(p - 80, 0), 'b': least(greatest(p - 80, 0) + 240, n)}}]) AS sp FROM e1),
e3 AS (SELECT *, CASE WHEN len(sp) > 0 THEN list_reduce(sp, lambda acc, s: CASE WHEN s[1].a <= acc[-1].b THEN list_concat(acc[:-2], [{{'a': acc[-1].a, 'b': greatest(acc[-1].b, s[1].b)}}]) ELSE list_concat(acc, s) END) END AS mg FROM e2),
e4 AS (SELECT *, list_transform(range(1, len(mg) + 1), lambda i: {{'a': mg[i].a, 'b': mg[i].b, 'upto': list_sum(list_transform(mg[1:i], lambda m: m.b - m.a))}}) AS mc FROM e3),
ex AS (SELECT *, CASE WHEN mg IS NULL THEN text[1:240] || CASE WHEN n > 240 THEN '…' ELSE '' END ELSE array_to_string(list_filter(list_transform(mc, lambda m: CASE
  WHEN m.upto <= 600 THEN CASE WHEN m.a > 0 THEN '…' ELSE '' END || text[CAST(m.a + 1 AS BIGINT):CAST(m.b AS BIGINT)] || CASE WHEN m.b < n THEN '…' ELSE '' END
  WHEN m.upto - (m.b - m.a) <= 600 AND 600 - (m.upto - (m.b - m.a)) > 80 THEN CASE WHEN m.a > 0 THEN '…' ELSE '' END || text[CAST(m.a + 1 AS BIGINT):CAST(m.a + 600 - (m.upto - (m.b - m.a)) AS BIGINT)] || '…' END), lambda t: t IS NOT NULL), '\n---\n') END AS excerpt FROM e4)"""


@query("WITH t0 AS (SELECT doc_id, text, ['manager', 'director', 'trainerin'] AS names FROM documents WHERE text IS NOT NULL), " + EXCERPT("t0") + " SELECT doc_id, excerpt FROM ex")
def str_excerpt(spark, d):
    """Excerpts of every document around the mentions of three roles."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", G.excerpt(F.col("text"), F.array(F.lit("manager"), F.lit("director"), F.lit("trainerin"))).alias("excerpt"))


_CHUNK = "ct AS (SELECT source_file, chunk_index, min(text) AS text FROM chunks GROUP BY 1, 2)"
_TOLD = "told AS (SELECT id, list(DISTINCT lower(name)) AS names FROM nm WHERE name <> '' GROUP BY 1)"
_MOST = "mo AS (SELECT id FROM m1 JOIN ct USING (source_file, chunk_index) GROUP BY 1 ORDER BY count(*) DESC, id LIMIT 1)"


@query(f"WITH {GRAPH}, {MENTIONS}, {_CHUNK}, {_TOLD}, {_MOST}, k AS (SELECT m1.* FROM m1 JOIN mo USING (id)), k3 AS (SELECT * FROM k ORDER BY source_file, chunk_index LIMIT 3), t0 AS (SELECT source_file, chunk_index, text, names, true AS exact, (SELECT count(*) FROM k) AS total FROM k3 JOIN ct USING (source_file, chunk_index) JOIN told USING (id)), " + EXCERPT("t0") + " SELECT source_file, chunk_index, exact, total, excerpt AS text FROM ex")
def gq_source_node(spark, d):
    """Of the node with most chunks whose text is known."""
    m, c = mentions(spark, d), table(spark, d, "chunks").select("source_file", "chunk_index", "text")
    best = m.join(c.select("source_file", "chunk_index").distinct(), ["source_file", "chunk_index"], "left_semi").groupBy("id").count().orderBy(F.desc("count"), "id").first()
    return G.source_excerpts(m, c, names(spark, d), node=best["id"])


@query(f"""WITH {GRAPH}, {MENTIONS}, {_CHUNK}, {_TOLD}, b AS (SELECT g.src, g.dst FROM ge g JOIN m1 s ON s.id = g.src JOIN m1 t ON t.id = g.dst AND t.source_file = s.source_file JOIN ct ON ct.source_file = s.source_file AND ct.chunk_index IN (s.chunk_index, t.chunk_index) WHERE g.src <> g.dst ORDER BY ALL LIMIT 1),
k AS (SELECT m1.source_file, chunk_index, bool_or(id = b.src) AND bool_or(id = b.dst) AS exact, bool_or(id = b.src) AS s FROM m1, b WHERE id IN (b.src, b.dst) GROUP BY 1, 2), a AS (SELECT * FROM k WHERE exact = (SELECT bool_or(exact) FROM k)), k3 AS (SELECT * FROM a ORDER BY s DESC, source_file, chunk_index LIMIT 3),
t0 AS (SELECT source_file, chunk_index, text, (SELECT list_distinct(flatten(list(names))) FROM told, b WHERE id IN (b.src, b.dst)) AS names, exact, (SELECT count(*) FROM a) AS total FROM k3 JOIN ct USING (source_file, chunk_index)), """ + EXCERPT("t0") + " SELECT source_file, chunk_index, exact, total, excerpt AS text FROM ex")
def gq_source_edge(spark, d):
    """Of the first edge whose ends stand in one file of which a chunk is known."""
    m, e, c = mentions(spark, d), graph(spark, d)[1], table(spark, d, "chunks").select("source_file", "chunk_index", "text")
    s = e.where("src <> dst").join(m.select(F.col("id").alias("src"), "source_file", F.col("chunk_index").alias("x")), "src").join(m.select(F.col("id").alias("dst"), "source_file", F.col("chunk_index").alias("y")), ["dst", "source_file"])
    known = c.select("source_file", F.col("chunk_index").alias("z")).distinct()
    r = s.join(known, "source_file").where("z in (x, y)").orderBy("src", "dst").first()
    return G.source_excerpts(m, c, names(spark, d), edge=(r["src"], r["dst"]))


@query(f"""WITH RECURSIVE {GRAPH}, {SIMPLE}, w(walked, stack) AS (SELECT [min(src)], [min(src)] FROM und
  UNION ALL SELECT CASE WHEN v IS NULL THEN walked ELSE list_append(walked, v) END, CASE WHEN v IS NULL THEN stack[:-2] WHEN len(stack) < 2 THEN list_append(stack, v) ELSE stack END
  FROM (SELECT walked, stack, (SELECT min(dst) FROM und WHERE src = stack[-1] AND NOT list_contains(walked, dst)) AS v FROM w WHERE len(stack) > 0)),
l AS (SELECT arg_max(walked, len(walked)) AS walked FROM w) SELECT CAST(unnest(range(0, len(walked))) AS INTEGER) AS pos, unnest(walked) AS id FROM l""")
def gq_dfs(spark, d):
    e = graph(spark, d)[1]
    a = e.agg(F.least(F.min("src"), F.min("dst"))).first()[0]
    return spark.createDataFrame(list(enumerate(G.depth_first(e, a, 2))), "pos int, id string")


# sources and files

_TOKENS = "list_filter(regexp_split_to_array({}, '[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda t: t <> '')"


@query(f"WITH {FILES} SELECT source_file, sha256, token_count FROM f WHERE content IS NOT NULL")
def src_manifest_migrated(spark, d):
    """A manifest of which every second entry has the old form, the text alone."""
    f = files(spark, d).where("content is not null")
    k = F.length("source_file") % 2
    new, old = F.to_json(F.struct("content", "sha256", "token_count")), F.to_json(F.array("content"))
    entry = F.when(k == 0, new).otherwise(F.substr(old, F.lit(2), F.length(old) - 2))
    return S.migrated(f.select("source_file", entry.alias("entry"))).select("source_file", "sha256", "token_count")


@query(f"WITH {FILES}, x AS (SELECT source_file, sha256, length(source_file) % 5 AS k FROM f) SELECT source_file, CASE WHEN k = 0 THEN 'convert' WHEN k = 1 THEN 'convert' WHEN k = 2 THEN 'remove' WHEN k = 3 THEN 'convert' ELSE 'keep' END AS what FROM x WHERE sha256 IS NOT NULL")
def src_conversion_state(spark, d):
    """Against an earlier run that did not know a fifth of the files, knew a fifth with another hash, and a fifth that are gone; of another fifth the output was lost."""
    f = files(spark, d).where("sha256 is not null").withColumn("k", F.length("source_file") % 5)
    before = f.where("k <> 0").select("source_file", F.when(F.col("k") == 1, "x").otherwise(F.col("sha256")).alias("sha256"))
    return S.conversion_state(f.where("k <> 2").select("source_file", "sha256"), before, f.where("k <> 3").select("source_file"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN upper(text) END AS content, CASE WHEN doc_id % 3 = 2 THEN 'no converter for odd' END AS failure FROM documents WHERE text IS NOT NULL AND regexp_full_match(text, '[\\x00-\\x7F]*')")
def src_converted(spark, d):
    """Texts pass, another kind goes through a converter that is given, a third has none: its failure is a row. ASCII texts, whose capitals are the same everywhere."""
    docs = table(spark, d, "documents").where("text is not null").where(F.col("text").rlike(r"\A[\x00-\x7F]*\z"))
    kind = F.element_at(F.array(F.lit("text"), F.lit("loud"), F.lit("odd")), (F.col("doc_id") % 3 + 1).cast("int"))
    return S.converted(docs.select("doc_id", kind.alias("route"), F.col("text").alias("content")), {"loud": str.upper})


_URLS = "n0 AS (SELECT DISTINCT src, dst FROM (SELECT 'https://' || split_part(\"from\", '-', 1) || '.example/' || \"from\" AS src, 'https://' || split_part(\"to\", '-', 1) || '.example/' || \"to\" AS dst FROM edges WHERE regexp_full_match(\"from\", '[a-z]+-[a-z0-9-]+') AND regexp_full_match(\"to\", '[a-z]+-[a-z0-9-]+')))"


@query(f"WITH RECURSIVE {_URLS}, l AS (SELECT * FROM n0 WHERE split_part(src, '/', 3) = split_part(dst, '/', 3)), r(url, hop) AS (SELECT min(src), 0 FROM l UNION SELECT dst, hop + 1 FROM r JOIN l ON src = url WHERE hop < 3) SELECT url, min(hop) AS hop FROM r GROUP BY 1")
def src_crawl(spark, d):
    """Edges stand for links between pages, types of nodes for hosts."""
    ok = lambda c: F.col(c).rlike(r"\A[a-z]+-[a-z0-9-]+\z")
    url = lambda c: F.concat(F.lit("https://"), F.split_part(F.col(c), F.lit("-"), F.lit(1)), F.lit(".example/"), F.col(c))
    links = table(spark, d, "edges").where(ok("from") & ok("to")).select(url("from").alias("src"), url("to").alias("dst")).distinct()
    same = links.where(F.split_part("src", F.lit("/"), F.lit(3)) == F.split_part("dst", F.lit("/"), F.lit(3)))
    return S.crawl_order(links, same.agg(F.min("src").alias("url")), 3)


_KINDS = ["text/html", "application/pdf", "image/jpeg", "text/plain; charset=x", "application/octet-stream", "video/mp4"]


@query(f"WITH k AS (SELECT doc_id, {_KINDS}[doc_id % 6 + 1] AS kind, 'https://x.example/' || CASE WHEN doc_id % 4 = 0 THEN 'a.PDF' ELSE 'b' END AS url FROM documents) SELECT doc_id, (starts_with(kind, 'text/') OR kind = 'application/pdf' OR ends_with(lower(url), '.pdf')) AS wanted, CASE doc_id % 6 WHEN 1 THEN '.pdf' WHEN 2 THEN '.jpg' WHEN 3 THEN '.txt' ELSE '' END AS ending, doc_id % 5 = 0 AS there FROM k")
def src_assets(spark, d):
    """Every fifth asset was fetched before with the same hash."""
    docs = table(spark, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 6 + 1).cast("int")).alias("kind"), F.concat(F.lit("https://x.example/"), F.when(F.col("doc_id") % 4 == 0, "a.PDF").otherwise("b")).alias("url"), F.col("doc_id").cast("string").alias("sha256"))
    had = docs.select(F.concat("url", F.col("doc_id").cast("string")).alias("url"), F.when(F.col("doc_id") % 5 == 0, F.col("sha256")).otherwise("x").alias("sha256"))
    now = docs.withColumn("key", F.concat("url", F.col("doc_id").cast("string")))
    there = S.already_fetched(now.select(F.col("key").alias("url"), "sha256", "doc_id"), had).select("doc_id", F.lit(True).alias("there"))
    return now.join(there, "doc_id", "left").select("doc_id", S.asset_wanted(F.col("kind"), F.col("url")).alias("wanted"), S.ending_of(F.col("kind")).alias("ending"), F.coalesce("there", F.lit(False)).alias("there"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'team/repo' || doc_id END AS repository, CASE WHEN doc_id % 3 = 0 THEN 2 WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END AS depth, NOT regexp_matches(source_file, '(^|/)\\.') AND lower(regexp_extract(source_file, '\\.([^./]+)$', 1)) IN ('md', 'markdown', 'txt', 'rst', 'html', 'pdf') AND NOT starts_with(source_file, 'node_modules/') AS kept FROM documents")
def src_code_hosts(spark, d):
    """Addresses of repositories, of sites, and of single pages; files of a repository worth reading."""
    docs, k = table(spark, d, "documents"), F.col("doc_id") % 3
    url = F.when(k == 0, F.concat(F.lit("https://github.com/team/repo"), F.col("doc_id").cast("string"), F.lit(".git"))).when(k == 1, F.lit("https://notes.example/")).otherwise(F.lit("https://notes.example/a/page.html"))
    return docs.select("doc_id", S.code_host(url).alias("repository"), S.crawl_depth(url).alias("depth"), S.repository_file(F.col("source_file")).alias("kept"))


@query("SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, CASE WHEN event_id % 7 = 0 THEN 'WARNING' ELSE 'INFO' END AS level, 'loader.' || event_type AS logger, 'user ' || user_id || ' — x' AS message FROM events WHERE event_id % 5 <> 0")
def src_run_log(spark, d):
    """A log written of the events, every fifth line broken."""
    e = table(spark, d, "events")
    line = F.concat(F.date_format("ts", "HH:mm:ss"), F.when(F.col("event_id") % 5 == 0, F.lit(" ")).otherwise(F.lit(" [")), F.when(F.col("event_id") % 7 == 0, "WARNING").otherwise("INFO"), F.lit("] loader."), "event_type", F.lit(" — user "), F.col("user_id").cast("string"), F.lit(" — x"))
    return S.read_run_log(e.select("event_id", line.alias("value")))


# texts


@query("SELECT doc_id, regexp_replace(source_file, '[/\\\\:]', '_', 'g') AS slug, regexp_replace(regexp_replace(source_file, '\\.[^.]*$', ''), '[_\\- ]*\\d+$', '') AS stem, split_part(source_file || '::' || doc_id, '::', -1) AS chunk FROM documents")
def str_file_names(spark, d):
    return table(spark, d, "documents").select("doc_id", file_slug(F.col("source_file")).alias("slug"), without_counter(F.regexp_replace("source_file", r"\.[^.]*$", "")).alias("stem"), F.split_part(F.concat("source_file", F.lit("::"), F.col("doc_id").cast("string")), F.lit("::"), F.lit(-1)).alias("chunk"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '[' || doc_id || ']' ELSE '{\"n\": ' || doc_id || '}' END AS answer FROM documents")
def str_fences(spark, d):
    """Answers in a fence with a language, in one without, and bare."""
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    body = F.concat(F.lit('{"n": '), n, F.lit("}"))
    return table(spark, d, "documents").select("doc_id", without_fence(F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nbye"))).when(k == 1, F.concat(F.lit("```\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit(" \n["), n, F.lit("]\n")))).alias("answer"))


@query("WITH s AS (SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, date_part('hour', ts) * 3600 + date_part('minute', ts) * 60 + CAST(floor(date_part('second', ts)) AS BIGINT) AS s FROM events) SELECT event_id, CAST(s AS INTEGER) AS seconds, CASE WHEN s >= 3600 THEN printf('%dh %02dm %02ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS took FROM s")
def str_durations(spark, d):
    s = seconds_of(F.date_format("ts", "HH:mm:ss"))
    return table(spark, d, "events").select("event_id", s.alias("seconds"), duration(s).alias("took"))


@query("SELECT node_key, array_to_string(list_sort(list_transform(list_filter(map_entries(attributes), lambda e: e.value.value IS NOT NULL), lambda e: e.key)), '|') AS attributes FROM nodes")
def map_with_values(spark, d):
    return table(spark, d, "nodes").select("node_key", F.array_join(F.array_sort(F.map_keys(F.map_filter("attributes", lambda k, v: v["value"].isNotNull()))), "|").alias("attributes"))


@query(f"""WITH o AS (SELECT DISTINCT type, attributes['name'].value AS name, unnest(aliases) AS alias FROM nodes) SELECT type, alias, count(DISTINCT name) AS names, min(name) AS first FROM o GROUP BY 1, 2""")
def map_inverted(spark, d):
    """Which names an alias stands for: the maps of aliases turned round."""
    o = occurrences(spark, d).select("type", "name", F.explode("aliases").alias("alias")).distinct()
    return o.groupBy("type", "alias").agg(F.countDistinct("name").alias("names"), F.min("name").alias("first"))
