"""Queries on exports, merged sessions, reports, requests to the language model, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.text import task_id
from graphloom.operators import export as X
from graphloom.operators import graph as G
from graphloom.operators import merge as M
from graphloom.operators import report as R
from graphloom.plans.building import properties
from graphloom.plans.querying import GRAPH, graph
from graphloom.plans.registry import Catalogue, table
from graphloom.shared import shared_dir

query = Catalogue()
QUERIES, SQL = query.queries, query.sql

_L = "regexp_replace({0}, '[^A-Za-z0-9_-]', '_', 'g')"
_T = "replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '\"', '\\\"'), '\n', '\\n'), '\r', '\\r'), '\t', '\\t')"
PROPS = 'props AS (SELECT DISTINCT e.type AS name, n.type AS domain, m.type AS range FROM edges e JOIN (SELECT DISTINCT id, type FROM nodes) n ON n.id = e."from" JOIN (SELECT DISTINCT id, type FROM nodes) m ON m.id = e."to")'
ATTR = "ax AS (SELECT DISTINCT id, e.key AS attr, e.value.value AS value, e.value.confidence AS confidence FROM (SELECT id, unnest(map_entries(attributes)) AS e FROM nodes WHERE id IS NOT NULL))"


def attributes(spark, d):
    return table(spark, d, "nodes").where("id is not null").select("id", F.explode("attributes").alias("attr", "a")).select("id", "attr", "a.value", "a.confidence").distinct()


@query(f"""WITH {PROPS}, a AS (SELECT type, parent, unnest(attributes) AS attr FROM concepts)
SELECT DISTINCT 1 AS section, 'ex:' || {_L.format('type')} || ' rdf:type rdfs:Class .' AS line FROM concepts WHERE type IS NOT NULL
UNION SELECT 2, 'ex:' || {_L.format('type')} || ' rdfs:subClassOf ex:' || {_L.format('parent')} || ' .' FROM concepts WHERE parent <> '' AND type IS NOT NULL
UNION SELECT 3, 'ex:' || {_L.format('attr')} || ' rdf:type rdf:Property ;\n    rdfs:domain ex:' || {_L.format('type')} || ' ;\n    rdfs:range  rdfs:Literal .' FROM a WHERE attr IS NOT NULL AND type IS NOT NULL
UNION SELECT 4, 'ex:' || {_L.format('name')} || ' rdf:type rdf:Property ;\n    rdfs:domain ex:' || {_L.format('domain')} || ' ;\n    rdfs:range  ex:' || {_L.format('range')} || ' .' FROM props""")
def snk_schema_ttl(spark, d):
    return X.schema_turtle(table(spark, d, "concepts"), properties(spark, d))


@query(f"""WITH {GRAPH}, {ATTR}, al AS (SELECT DISTINCT id, unnest(aliases) AS alias FROM nodes WHERE id IS NOT NULL)
SELECT 0 AS section, unnest(['@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .', '@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .', '@prefix ex: <http://example.org/schema#> .', '@prefix data: <http://example.org/data#> .', '@prefix skos: <http://www.w3.org/2004/02/skos/core#> .']) AS line
UNION SELECT 5, 'data:' || {_L.format('id')} || ' rdf:type ex:' || {_L.format('type')} || ' .' AS line FROM gn
UNION SELECT 6, 'data:' || {_L.format('id')} || ' ex:' || {_L.format('attr')} || ' "' || {_T.format('value')} || '" .' FROM ax WHERE value IS NOT NULL
UNION SELECT 7, 'data:' || {_L.format('id')} || ' skos:altLabel "' || {_T.format('alias')} || '" .' FROM al WHERE alias IS NOT NULL
UNION SELECT 8, 'data:' || {_L.format('src')} || ' ex:' || {_L.format('type')} || ' data:' || {_L.format('dst')} || ' .' FROM ge WHERE type IN ('knows', 'leads', 'member_of', 'part_of', 'works_at')""")
def snk_ttl_lines(spark, d):
    """Half of the edge types are declared."""
    n, e = graph(spark, d)
    alias = table(spark, d, "nodes").where("id is not null").select("id", F.explode("aliases").alias("alias"))
    declared = spark.createDataFrame([(x,) for x in ("knows", "leads", "member_of", "part_of", "works_at")], "name string")
    return X.turtle_prefixes(spark).unionByName(X.graph_turtle(n, attributes(spark, d), alias, X.declared_relations(e, declared)))


@query(f"WITH {ATTR}, f AS (SELECT id, 'attr_' || regexp_replace(attr, '[^A-Za-z0-9_]', '_', 'g') AS key, value, CASE WHEN isnan(confidence) THEN NULL ELSE confidence END AS confidence FROM ax) SELECT id, key || '_value' AS key, max(coalesce(value, '')) AS text, NULL::DOUBLE AS number FROM f GROUP BY 1, 2 UNION ALL SELECT id, key || '_confidence', NULL, round(max(coalesce(confidence, 0.0)), 6) FROM f GROUP BY 1, 2")
def snk_nx_flat(spark, d):
    """Confidences read back as numbers; those that are no number count as missing. An attribute of several confidences shows the one greatest as a text, which is the greatest number within 0..1."""
    a = attributes(spark, d).withColumn("confidence", F.when(~F.isnan("confidence"), F.col("confidence"))).groupBy("id", "attr", "value").agg(F.max("confidence").alias("confidence"))
    top = a.groupBy("id", "attr").agg(F.max("confidence").alias("top"))
    one = a.join(top, ["id", "attr"]).select("id", "attr", "value", F.col("top").alias("confidence"))
    f, sure = X.flat_attributes(one), F.col("key").endswith("_confidence")
    return f.select("id", "key", F.when(~sure, F.col("text")).alias("text"), F.when(sure, F.round(F.col("text").cast("double"), 6)).alias("number"))


@query(f"WITH {GRAPH} SELECT upper(type) AS relation, src, dst, count(*) AS n FROM ge GROUP BY 1, 2, 3")
def snk_neo4j_edges(spark, d):
    return X.csv_relations(graph(spark, d)[1]).groupBy("relation", "src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH}, t AS (SELECT *, coalesce(nullif(name, ''), id) AS title FROM gn) SELECT type, CAST(row_number() OVER (PARTITION BY type ORDER BY title, id) AS INTEGER) AS position, '- [[' || title || ']]' AS line FROM t")
def snk_vault_index(spark, d):
    return X.note_index(graph(spark, d)[0])


@query(f"""WITH {GRAPH}, {ATTR}, t AS (SELECT id, type, confidence, coalesce(nullif(name, ''), id) AS title FROM gn), u AS (SELECT DISTINCT src, dst, type FROM ge)
SELECT id, 0 AS section, '---\ntype: ' || coalesce(type, '') || '\nid: ' || id || coalesce('\nconfidence: ' || printf('%.2f', confidence), '') || '\n---\n# ' || title AS line FROM t
UNION ALL SELECT DISTINCT id, 1, '- **' || attr || '**: ' || value || coalesce(' (' || printf('%.2f', CASE WHEN isnan(confidence) THEN NULL ELSE confidence END) || ')', '') FROM ax WHERE value IS NOT NULL AND attr <> 'name'
UNION ALL SELECT src, 2, '- ' || u.type || ' [[' || coalesce(title, dst) || ']]' FROM u LEFT JOIN t ON t.id = dst WHERE src IN (SELECT id FROM gn)
UNION ALL SELECT dst, 3, '- ' || u.type || ' [[' || coalesce(title, src) || ']]' FROM u LEFT JOIN t ON t.id = src WHERE dst IN (SELECT id FROM gn)
UNION ALL SELECT DISTINCT id, 4, '- ' || f FROM (SELECT id, unnest(source_files) AS f FROM nodes WHERE id IS NOT NULL) WHERE trim(f) <> ''""")
def snk_vault_notes(spark, d):
    n, e = graph(spark, d)
    files = table(spark, d, "nodes").where("id is not null").select("id", F.explode("source_files").alias("source_file")).where("trim(source_file) <> ''")
    return X.note_lines(n, attributes(spark, d).withColumn("confidence", F.when(~F.isnan("confidence"), F.col("confidence"))), e, files)


@query(f"""WITH {GRAPH}, deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM ge UNION ALL SELECT dst FROM ge) GROUP BY 1), k AS (SELECT type, row_number() OVER (ORDER BY type) - 1 AS k FROM (SELECT DISTINCT type FROM gn)), m AS (SELECT greatest(max(degree), 1) AS top FROM deg)
SELECT id, CAST(k % 10 AS INTEGER) AS colour, round(10 + 30 * coalesce(degree, 0) / top, 1) AS size, CASE WHEN coalesce(degree, 0) >= 0.15 * top THEN 15 ELSE 0 END AS label_size FROM gn JOIN k USING (type) LEFT JOIN deg USING (id), m""")
def snk_html_render(spark, d):
    n, e = graph(spark, d)
    return X.render_table(n, G.degrees(e))


@query(f"WITH {GRAPH} , p AS (SELECT src, dst, (row_number() OVER (PARTITION BY src ORDER BY dst) - 1) // 1000 AS p FROM (SELECT DISTINCT src, dst FROM ge)) SELECT 2 AS section, src || ' ' || string_agg(dst, ' ' ORDER BY dst) AS line FROM p GROUP BY src, p")
def snk_adjacency(spark, d):
    return X.graph_lines(*graph(spark, d), "adjacency")


@query()
def snk_nodes_jsonl(spark, d):
    n = table(spark, d, "nodes").select("id", "type", F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence"), "attributes", "aliases", "source_files")
    return X.json_lines(n)


# sessions A and B: documents and nodes of even and odd keys

_AB = "a AS (SELECT 'session_a/' || source_file AS source_file, sha256(text) AS sha256, 'session_a' AS session FROM documents WHERE doc_id % 2 = 0), b AS (SELECT 'session_b/' || source_file, sha256(text), 'session_b' FROM documents WHERE doc_id % 2 = 1)"


@query(f"WITH {_AB} SELECT * FROM a UNION ALL SELECT * FROM b")
def mrg_manifest(spark, d):
    m = table(spark, d, "documents").select("source_file", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "doc_id")
    return M.merged_manifest(m.where("doc_id % 2 = 0"), m.where("doc_id % 2 = 1"))


@query("SELECT node_key, array_to_string(list_transform(source_files, lambda f: CASE WHEN starts_with(f, 'a/') THEN f ELSE 'a/' || f END), ',') AS source_files FROM nodes")
def mrg_namespace_union(spark, d):
    n = table(spark, d, "nodes").select("node_key", "source_files")
    return M.namespaced(n, "a", (), ("source_files",)).select("node_key", F.array_join("source_files", ",").alias("source_files"))


_ORIGIN = f"WITH {GRAPH}, na AS (SELECT DISTINCT id FROM nodes WHERE node_key % 2 = 0), nb AS (SELECT DISTINCT id FROM nodes WHERE node_key % 2 = 1), og AS (SELECT id, CASE WHEN id IN (SELECT id FROM na WHERE id IS NOT NULL) THEN CASE WHEN id IN (SELECT id FROM nb WHERE id IS NOT NULL) THEN 'both' ELSE 'a' END WHEN id IN (SELECT id FROM nb WHERE id IS NOT NULL) THEN 'b' ELSE 'new' END AS origin FROM gn)"


def _origin(spark, d):
    n = table(spark, d, "nodes").select("id", "node_key")
    return M.provenance(graph(spark, d)[0], n.where("node_key % 2 = 0"), n.where("node_key % 2 = 1"))


@query(_ORIGIN + " SELECT * FROM og")
def mrg_provenance(spark, d):
    return _origin(spark, d)


@query(_ORIGIN + " SELECT ge.id, CASE WHEN (coalesce(s.origin IN ('a', 'both'), false) AND coalesce(t.origin IN ('b', 'both'), false)) OR (coalesce(s.origin IN ('b', 'both'), false) AND coalesce(t.origin IN ('a', 'both'), false)) THEN 'cross' WHEN s.origin IN ('a', 'both') AND t.origin IN ('a', 'both') THEN 'a' WHEN s.origin IN ('b', 'both') AND t.origin IN ('b', 'both') THEN 'b' ELSE 'new' END AS kind FROM ge LEFT JOIN og s ON s.id = src LEFT JOIN og t ON t.id = dst")
def mrg_edge_provenance(spark, d):
    return M.edge_provenance(graph(spark, d)[1], _origin(spark, d))


# reports: events stand for calls

_RULES = [("^click", "extraction"), ("^view", "schema"), ("^pur", "names")]


@query("WITH c AS (SELECT CASE WHEN regexp_matches(event_type, '^click') THEN 'extraction' WHEN regexp_matches(event_type, '^view') THEN 'schema' WHEN regexp_matches(event_type, '^pur') THEN 'names' ELSE 'other' END AS stage, user_id, value FROM events) SELECT stage, count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS tokens, round(sum(value), 3) AS seconds FROM c GROUP BY ROLLUP (stage)")
def agg_llm_rollup(spark, d):
    return R.call_statistics(table(spark, d, "events").select(F.col("event_type").alias("context"), F.col("user_id").alias("total_tokens"), F.col("value").alias("duration_s")), _RULES)


@query("WITH e AS (SELECT event_id AS pos, date_part('hour', ts) * 3600 + date_part('minute', ts) * 60 + CAST(floor(date_part('second', ts)) AS BIGINT) AS s, CASE WHEN event_id % 3 = 0 THEN 'RUN' ELSE 'DONE' END AS what, event_type AS step FROM events), w AS (SELECT *, last_value(CASE WHEN what = 'RUN' THEN s END IGNORE NULLS) OVER (PARTITION BY step ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS began FROM e), x AS (SELECT step, arg_max(began, pos) AS b, arg_max(s, pos) AS s FROM w WHERE what = 'DONE' GROUP BY 1), y AS (SELECT step, b, ((s - b) % 86400 + 86400) % 86400 AS t FROM x) SELECT step, CAST(b AS INTEGER) AS started, CASE WHEN t >= 3600 THEN printf('%dh %02dm %02ds', t // 3600, t % 3600 // 60, t % 60) WHEN t >= 60 THEN printf('%dm %02ds', t // 60, t % 60) ELSE printf('%ds', t) END AS took FROM y")
def rpt_timeline(spark, d):
    e = table(spark, d, "events")
    return R.timeline(e.select(F.col("event_id").alias("pos"), F.date_format("ts", "HH:mm:ss").alias("clock"), F.concat(F.when(F.col("event_id") % 3 == 0, "RUN ").otherwise("DONE "), "event_type").alias("message")))


@query("SELECT type, method, count(*) AS n FROM edges GROUP BY 1, 2")
def agg_edge_counts(spark, d):
    return R.counts(table(spark, d, "edges"), "type", "method")


@query("SELECT count(DISTINCT f) AS files FROM (SELECT unnest(source_files) AS f FROM nodes)")
def agg_source_files(spark, d):
    return table(spark, d, "nodes").select(F.explode("source_files").alias("f")).agg(F.countDistinct("f").alias("files"))


@query("SELECT DISTINCT doc_id, sha256('extract' || chr(10) || '--user--' || chr(10) || coalesce(text, '') || chr(10) || '--ctx--' || chr(10) || source_file) AS task_id FROM documents")
def llm_task_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", task_id(F.lit("extract"), F.coalesce("text", F.lit("")), F.col("source_file")).alias("task_id"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_counts(spark, d):
    """Extension: the streaming aggregate over the table of events."""
    from graphloom.streaming.append import event_counts

    return event_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT source_file, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def stream_append(spark, d):
    """All documents taken up by a stream, run twice: the second run finds nothing new."""
    import os
    import uuid

    from graphloom.streaming.append import append_stream

    root = f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents")
    folder, name = os.path.split(f"{d}/documents.parquet")
    for run in range(2):
        src = spark.readStream.schema(docs.schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}" if os.path.isdir(f"{d}/{name}") else f"{folder}/{name[:-8]}*.parquet")
        q = append_stream(spark, src.select("source_file", F.col("text").alias("content")).where("content is not null"), f"{root}/state", f"{root}/checkpoint-{run}")
        q.awaitTermination()
    return spark.read.parquet(f"{root}/state").select("source_file", "sha256").distinct()
