"""Queries that build a graph: identities, merging, normalisation, validation. Over nodes and edges as extracted occurrences, and over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import canonical, clamp, edge_id, edge_key, label_name, relation_name, slug, snake, stable_id
from graphloom.operators import assemble as A
from graphloom.operators import validate as V
from graphloom.plans.registry import Catalogue, table

query = Catalogue()
QUERIES, SQL = query.queries, query.sql

_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def CANON(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '{_WS}+', ' ', 'g'), '^ +| +$', '', 'g')"


def SLUG(x: str) -> str:
    return f"regexp_replace(regexp_replace({CANON(x)}, '[^a-z0-9 ]', '', 'g'), ' +', '-', 'g')"


def STABLE(kind: str, name: str) -> str:
    return f"regexp_replace(lower({kind}), '[^a-z0-9]', '', 'g') || '-' || {SLUG(name)}"


def CLAMP(x: str) -> str:
    return f"greatest(0.0, least(1.0, coalesce({x}, 0.0)))"


#: The occurrences: one per record of nodes; the session stands for the file.
OCC = f"""occ AS (SELECT *, {STABLE("type", "coalesce(nullif(name, ''), raw_id)")} AS stable_id FROM (
  SELECT DISTINCT session_id AS source_file, node_key AS pos, id AS raw_id, type, attributes['name'].value AS name, confidence, aliases FROM nodes)),
att AS (SELECT o.source_file, o.pos, o.stable_id, e.key AS attr, e.value.value AS value, e.value.confidence AS confidence
  FROM (SELECT DISTINCT session_id, node_key, unnest(map_entries(attributes)) AS e FROM nodes) n JOIN occ o ON o.source_file = n.session_id AND o.pos = n.node_key)"""
EDG = 'edg AS (SELECT DISTINCT session_id AS source_file, id AS pos, type, "from" AS src, "to" AS dst, confidence FROM edges)'


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes")
    name = F.try_element_at("attributes", F.lit("name")).getField("value")
    return A.with_stable_ids(n.select(F.col("session_id").alias("source_file"), F.col("node_key").alias("pos"), F.col("id").alias("raw_id"), "type", name.alias("name"), "confidence", "aliases").distinct())


def attribute_occurrences(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes")
    name = F.try_element_at("attributes", F.lit("name")).getField("value")
    rows = A.with_stable_ids(n.select(F.col("session_id").alias("source_file"), F.col("node_key").alias("pos"), F.col("id").alias("raw_id"), "type", name.alias("name"), "attributes"))
    long = rows.select("source_file", "pos", "stable_id", F.explode("attributes").alias("attr", "a"))
    return long.select("source_file", "pos", "stable_id", "attr", "a.value", "a.confidence", F.lit(True).alias("is_text")).distinct()


def edge_occurrences(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges")
    return e.select(F.col("session_id").alias("source_file"), F.col("id").alias("pos"), "type", F.col("from").alias("src"), F.col("to").alias("dst"), "confidence").distinct()


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Attribute occurrences of parts, which share 64 names: true merges with conflicting values and confidences of exactly 1."""
    p = table(spark, d, "part").select(F.lit("part").alias("source_file"), F.col("p_partkey").alias("pos"), stable_id(F.lit("Part"), F.col("p_name")).alias("stable_id"), (F.col("p_size") / 50.0).alias("confidence"), "p_brand", "p_type")
    pairs = F.explode(F.array(F.struct(F.lit("brand").alias("attr"), F.col("p_brand").alias("value")), F.struct(F.lit("kind").alias("attr"), F.col("p_type").alias("value"))))
    return p.select("source_file", "pos", "stable_id", "confidence", pairs.alias("x")).select("source_file", "pos", "stable_id", "x.attr", "x.value", "confidence", F.lit(True).alias("is_text"))


PARTS = f"""part_att AS (SELECT p_partkey AS pos, {STABLE("'Part'", "p_name")} AS stable_id, unnest(['brand', 'kind']) AS attr, unnest([p_brand, p_type]) AS value, p_size / 50.0 AS confidence FROM part)"""
_MERGED = """m AS (SELECT {1}, max(""" + CLAMP("confidence") + """) AS top, arg_min_null(value, (-""" + CLAMP("confidence") + """, {2})) AS first,
  list(value ORDER BY {2}) FILTER (WHERE """ + CLAMP("confidence") + """ = 1) AS full_ FROM {0} GROUP BY ALL),
merged AS (SELECT * EXCLUDE (top, first, full_), CASE WHEN top = 1 THEN list_reduce(full_, lambda a, v: CASE WHEN a IS NOT NULL AND v IS NOT NULL AND v <> a THEN a || '; ' || v ELSE a END) ELSE first END AS value, top AS confidence FROM m)"""


@query(f"SELECT DISTINCT id, type, name, {STABLE('type', 'name')} AS stable_id FROM (SELECT id, type, attributes['name'].value AS name FROM nodes)")
def ids_stable_id(spark, d):
    n = table(spark, d, "nodes").select("id", "type", F.try_element_at("attributes", F.lit("name")).getField("value").alias("name"))
    return n.withColumn("stable_id", stable_id(F.col("type"), F.col("name"))).distinct()


@query("""SELECT DISTINCT id, sha256(type || '|' || "from" || '|' || "to") AS key, 'edge-' || left(sha256(type || '|' || "from" || '|' || "to"), 6) AS short FROM edges""")
def ids_edge_key(spark, d):
    key = edge_key(F.col("type"), F.col("from"), F.col("to"))
    return table(spark, d, "edges").select("id", key.alias("key"), edge_id(key).alias("short")).distinct()


@query(f"SELECT node_key, {CLAMP('confidence')} AS confidence FROM nodes")
def flt_clamp(spark, d):
    return table(spark, d, "nodes").select("node_key", clamp(F.col("confidence")).alias("confidence"))


def _WORDS(x):
    for border in ("([a-z])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        x = f"regexp_replace({x}, '{border}', '\\1 \\2', 'g')"
    return f"list_filter(regexp_split_to_array({x}, '[^A-Za-z0-9]+'), lambda p: p <> '')"


_NAMES = "t AS (SELECT DISTINCT type FROM concepts UNION SELECT DISTINCT type || 'Ref' || pos || '_of-' || upper(type) || 'Item' FROM concepts UNION SELECT DISTINCT pos || ' ' || type FROM concepts)"


@query(f"""WITH {_NAMES} SELECT type, lower(regexp_replace(regexp_replace(type, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[\\s\\-_]+', '_', 'g')) AS snake,
array_to_string(list_transform({_WORDS("regexp_replace(type, '^[^A-Za-z]+', '')")}, lambda p: upper(p[1]) || lower(p[2:])), '') AS label, array_to_string(list_transform({_WORDS('type')}, lambda p: upper(p)), '_') AS relation FROM t""")
def str_type_names(spark, d):
    """Types, and identifiers made of them with acronyms, numbers and signs."""
    c, t = table(spark, d, "concepts"), F.col("type")
    more = [c.select("type"), c.select(F.concat("type", F.lit("Ref"), F.col("pos").cast("string"), F.lit("_of-"), F.upper("type"), F.lit("Item"))), c.select(F.concat(F.col("pos").cast("string"), F.lit(" "), "type"))]
    return more[0].union(more[1]).union(more[2]).distinct().select("type", snake(t).alias("snake"), label_name(t).alias("label"), relation_name(t).alias("relation"))


def _merged_nodes(how):
    agg = "avg" if how == "mean" else "max"
    return f"""WITH {OCC} SELECT stable_id, arg_min(type, (source_file, pos)) AS type, round({agg}({CLAMP("confidence")}), 6) AS confidence, count(*) AS occurrences FROM occ GROUP BY stable_id"""


def _nodes(spark, d, how):
    n = A.merge_nodes(occurrences(spark, d), how)
    return n.select("stable_id", "type", F.round("confidence", 6).alias("confidence"), "occurrences")


@query(_merged_nodes("mean"))
def asm_nodes_mean(spark, d):
    return _nodes(spark, d, "mean")


@query(_merged_nodes("max"))
def asm_nodes_max(spark, d):
    return _nodes(spark, d, "max")


@query(f"WITH {OCC} SELECT stable_id, source_file, count(*) AS occurrences FROM occ GROUP BY 1, 2")
def asm_node_files(spark, d):
    return A.node_files(occurrences(spark, d))


@query(f"""WITH {OCC}, f AS (SELECT stable_id, arg_min_null(name, (source_file, pos)) AS name FROM occ GROUP BY 1), a AS (SELECT DISTINCT stable_id, unnest(aliases) AS alias FROM occ)
SELECT stable_id, string_agg(alias, '|' ORDER BY alias) AS aliases FROM a JOIN f USING (stable_id) WHERE alias IS DISTINCT FROM name AND alias IS NOT NULL GROUP BY 1""")
def asm_alias_union(spark, d):
    return A.merge_nodes(occurrences(spark, d)).where("aliases is not null").select("stable_id", F.array_join("aliases", "|").alias("aliases"))


@query(f"WITH {OCC}, " + _MERGED.format("att", "stable_id, attr", "(source_file, pos)") + " SELECT * FROM merged")
def asm_attr_conflict(spark, d):
    return A.merge_attributes(attribute_occurrences(spark, d), ["stable_id", "attr"])


@query(f"WITH {PARTS}, " + _MERGED.format("part_att", "stable_id, attr", "pos") + " SELECT * FROM merged")
def asm_attr_conflict_parts(spark, d):
    return A.merge_attributes(parts(spark, d), ["stable_id", "attr"])


@query(f"WITH {PARTS}, " + _MERGED.format("part_att", "stable_id, attr", "pos") + """, n AS (SELECT stable_id, count(DISTINCT pos) AS occurrences FROM part_att GROUP BY 1 HAVING count(DISTINCT pos) > 1)
SELECT stable_id, any_value(occurrences) AS occurrences, count(*) FILTER (WHERE a.value = m.value) AS winning, count(*) FILTER (WHERE a.value <> m.value AND a.confidence < 1) AS losing,
count(*) FILTER (WHERE a.value <> m.value AND a.confidence >= 1) AS concatenated FROM part_att a JOIN merged m USING (stable_id, attr) JOIN n USING (stable_id) GROUP BY 1""")
def asm_merge_log(spark, d):
    p = parts(spark, d)
    return A.merge_log(p, A.merge_attributes(p, ["stable_id", "attr"]), ["stable_id", "attr"], "stable_id")


@query(f"WITH {EDG} SELECT 'edge-' || left(sha256(type || '|' || src || '|' || dst), 6) AS id, type, src, dst, round(avg({CLAMP('confidence')}), 6) AS confidence, count(*) AS occurrences FROM edg GROUP BY type, src, dst")
def asm_edges(spark, d):
    return A.merge_edges(edge_occurrences(spark, d)).select("id", "type", "src", "dst", F.round("confidence", 6).alias("confidence"), "occurrences")


@query("SELECT l_suppkey AS supplier, l_partkey AS part, max(l_quantity) / 50.0 AS confidence, count(*) AS occurrences FROM lineitem GROUP BY 1, 2")
def asm_edges_supplies(spark, d):
    li = table(spark, d, "lineitem").select(F.lit("supplies").alias("type"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_quantity") / 50.0).alias("confidence"))
    return A.merge_edges(li, "max").select(F.col("src").alias("supplier"), F.col("dst").alias("part"), "confidence", "occurrences")


@query(f"""WITH {OCC} SELECT source_file, stable_id, attr, arg_min_null(value, (-{CLAMP("confidence")}, pos)) AS value, max({CLAMP("confidence")}) AS confidence FROM att GROUP BY 1, 2, 3""")
def asm_dedup_in_file(spark, d):
    return A.dedup_in_file(attribute_occurrences(spark, d))


@query(f"""WITH {OCC}, {EDG}, raw AS (SELECT raw_id, arg_max(stable_id, (source_file, pos)) AS s FROM occ GROUP BY 1), ids AS (SELECT DISTINCT stable_id FROM occ),
by_name AS (SELECT regexp_replace(stable_id, '^[^-]*-', '') AS s, min(stable_id) AS one FROM ids GROUP BY 1 HAVING count(*) = 1)
SELECT e.source_file, e.pos, coalesce(a.s, i.stable_id, n.one, e.src) AS src, coalesce(a2.s, i2.stable_id, n2.one, e.dst) AS dst FROM edg e
LEFT JOIN raw a ON a.raw_id = e.src LEFT JOIN ids i ON i.stable_id = e.src LEFT JOIN by_name n ON n.s = {SLUG("e.src")}
LEFT JOIN raw a2 ON a2.raw_id = e.dst LEFT JOIN ids i2 ON i2.stable_id = e.dst LEFT JOIN by_name n2 ON n2.s = {SLUG("e.dst")}""")
def join_endpoint_resolution(spark, d):
    return A.resolve_endpoints(edge_occurrences(spark, d).select("source_file", "pos", "src", "dst"), occurrences(spark, d))


@query(f"""WITH {OCC}, {EDG} SELECT source_file, pos FROM edg e WHERE EXISTS (SELECT 1 FROM occ o WHERE o.source_file = e.source_file AND o.raw_id = e.src) AND EXISTS (SELECT 1 FROM occ o WHERE o.source_file = e.source_file AND o.raw_id = e.dst)""")
def flt_dangling_edges(spark, d):
    return A.dangling_edges(edge_occurrences(spark, d), occurrences(spark, d)).select("source_file", "pos")


@query(f"WITH {OCC} SELECT type, count(DISTINCT name) AS names, min(name) AS first, max(name) AS last FROM occ WHERE name <> '' GROUP BY 1")
def nrm_inventory(spark, d):
    return A.name_inventory(occurrences(spark, d)).groupBy("type").agg(F.count("*").alias("names"), F.min("name").alias("first"), F.max("name").alias("last"))


#: A map of names made from the records: every alias of a record stands for its name.
NORM = "norm AS (SELECT DISTINCT type, unnest(aliases) AS alias, attributes['name'].value AS canonical FROM nodes)"


def norm_map(spark, d):
    n = table(spark, d, "nodes")
    return n.select("type", F.explode("aliases").alias("alias"), F.try_element_at("attributes", F.lit("name")).getField("value").alias("canonical")).distinct()


@query(f"""WITH {NORM}, known AS (SELECT DISTINCT type, attributes['name'].value AS name FROM nodes WHERE confidence >= 0.7 AND NOT isnan(confidence)),
j AS (SELECT n.*, k.name FROM norm n LEFT JOIN known k ON k.type = n.type AND k.name = n.canonical WHERE alias IS DISTINCT FROM canonical)
SELECT type, alias, CASE WHEN alias IS NULL OR canonical IS NULL THEN 'not a text' ELSE 'unknown canonical name' END AS rule FROM j WHERE alias IS NULL OR canonical IS NULL OR name IS NULL""")
def nrm_validate(spark, d):
    known = table(spark, d, "nodes").where("confidence >= 0.7 and not isnan(confidence)").select("type", F.try_element_at("attributes", F.lit("name")).getField("value").alias("name"))
    return A.check_name_map(known, norm_map(spark, d))[1]


@query(f"""WITH RECURSIVE {NORM}, one AS (SELECT type, alias, min(canonical) AS canonical FROM norm WHERE alias IS NOT NULL AND canonical IS NOT NULL GROUP BY 1, 2),
good(type, alias) AS (SELECT type, alias FROM one a WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.type = a.type AND b.alias = a.canonical)
  UNION ALL SELECT o.type, o.alias FROM one o JOIN good g ON g.type = o.type AND g.alias = o.canonical)
SELECT o.type, o.alias, o.canonical FROM one o JOIN good USING (type, alias)""")
def nrm_cycles(spark, d):
    m = norm_map(spark, d).where("alias is not null and canonical is not null")
    return A.drop_cycles(m.groupBy("type", "alias").agg(F.min("canonical").alias("canonical")))


@query(f"""WITH {OCC}, {NORM}, m AS (SELECT type, {CANON("alias")} AS c, min(canonical) AS t FROM norm GROUP BY 1, 2)
SELECT source_file, pos, coalesce(m.t, name) AS name FROM occ LEFT JOIN m ON m.type = occ.type AND m.c = {CANON("occ.name")}""")
def nrm_apply(spark, d):
    return A.apply_name_map(occurrences(spark, d), norm_map(spark, d)).select("source_file", "pos", "name")


@query(f"WITH {NORM} SELECT type, canonical AS name, string_agg(DISTINCT alias, '|' ORDER BY alias) AS aliases FROM norm GROUP BY 1, 2")
def asm_alias_index(spark, d):
    return A.alias_index(norm_map(spark, d)).select("type", "name", F.array_join("aliases", "|").alias("aliases"))


#: The ontology of the latest session stands for the declared schema; half of the edge types are declared.
DECLARED = "decl AS (SELECT DISTINCT type FROM edges WHERE type IN ('knows', 'leads', 'member_of', 'part_of', 'works_at')), kinds AS (SELECT DISTINCT type FROM concepts)"


def _declared(spark, d):
    return table(spark, d, "edges").where(F.col("type").isin("knows", "leads", "member_of", "part_of", "works_at")).select("type").distinct()


@query(f"WITH {DECLARED}, {EDG} SELECT source_file, pos, type FROM edg WHERE type IN (SELECT type FROM decl)")
def flt_declared_edges(spark, d):
    return V.declared(edge_occurrences(spark, d), _declared(spark, d), "type").select("source_file", "pos", "type")


@query(f"""WITH {DECLARED}, {OCC}, {EDG}, e AS (
  SELECT source_file, 'undeclared node type' AS rule, raw_id AS what FROM occ WHERE type NOT IN (SELECT type FROM kinds)
  UNION ALL SELECT source_file, 'node without id', NULL FROM occ WHERE raw_id IS NULL OR raw_id = ''
  UNION ALL SELECT source_file, 'undeclared edge type', pos FROM edg WHERE type NOT IN (SELECT type FROM decl)
  UNION ALL SELECT e.source_file, 'unknown source', src FROM edg e WHERE NOT EXISTS (SELECT 1 FROM occ WHERE raw_id = src AND raw_id <> '' AND occ.source_file = e.source_file)
  UNION ALL SELECT e.source_file, 'unknown target', dst FROM edg e WHERE NOT EXISTS (SELECT 1 FROM occ WHERE raw_id = dst AND raw_id <> '' AND occ.source_file = e.source_file)
  UNION ALL SELECT source_file, 'no confidence', pos FROM edg WHERE confidence IS NULL
  UNION ALL SELECT session_id, 'no attributes', id FROM nodes WHERE attributes IS NULL)
SELECT source_file, rule, what, count(*) AS n FROM e GROUP BY 1, 2, 3""")
def flt_validate_extraction(spark, d):
    """Every session is an extraction of its own; attributes are those of the records."""
    kinds = table(spark, d, "concepts").select("type").distinct()
    errors = V.extraction_errors(occurrences(spark, d), edge_occurrences(spark, d), kinds, _declared(spark, d))
    bare = table(spark, d, "nodes").select(F.col("session_id").alias("source_file"), F.col("id").alias("raw_id"), F.lit("").alias("type"), "attributes").where("attributes is null")
    nothing = edge_occurrences(spark, d).where("false")
    more = V.extraction_errors(bare, nothing, kinds, _declared(spark, d)).where("rule = 'no attributes'")
    return errors.unionByName(more).groupBy("source_file", "rule", "what").agg(F.count("*").alias("n"))


@query(f"""WITH {DECLARED}, {OCC}, {EDG}, n1 AS (SELECT DISTINCT source_file, raw_id FROM occ WHERE type IN (SELECT type FROM kinds)),
e1 AS (SELECT e.* FROM edg e WHERE type IN (SELECT type FROM decl) AND EXISTS (SELECT 1 FROM n1 WHERE n1.source_file = e.source_file AND n1.raw_id = e.src) AND EXISTS (SELECT 1 FROM n1 WHERE n1.source_file = e.source_file AND n1.raw_id = e.dst))
SELECT source_file, raw_id FROM n1 WHERE EXISTS (SELECT 1 FROM e1 WHERE e1.source_file = n1.source_file AND n1.raw_id IN (e1.src, e1.dst))""")
def flt_partial_recover(spark, d):
    nodes, _ = V.recover(occurrences(spark, d), edge_occurrences(spark, d), table(spark, d, "concepts").select("type").distinct(), _declared(spark, d))
    return nodes.select("source_file", "raw_id").distinct()


@query(f"""WITH {OCC}, sch AS (SELECT DISTINCT type, unnest(attributes) AS attr FROM concepts)
SELECT o.source_file, o.pos, s.attr FROM occ o JOIN sch s USING (type) WHERE NOT EXISTS (SELECT 1 FROM att a WHERE a.source_file = o.source_file AND a.pos = o.pos AND a.attr = s.attr)""")
def flt_backfill(spark, d):
    c = table(spark, d, "concepts").select("type", F.explode("attributes").alias("attr")).distinct()
    full = V.backfill(attribute_occurrences(spark, d), occurrences(spark, d), c)
    return full.where("added").select("source_file", "pos", "attr")


@query("""WITH p AS (SELECT DISTINCT type AS name, "from" AS f, "to" AS t FROM edges), dom AS (SELECT e.type AS name, n.type AS domain, m.type AS range FROM edges e JOIN (SELECT DISTINCT id, type FROM nodes) n ON n.id = e."from" JOIN (SELECT DISTINCT id, type FROM nodes) m ON m.id = e."to"),
props AS (SELECT DISTINCT name, domain, range FROM dom), kinds AS (SELECT DISTINCT type FROM concepts)
SELECT 'undefined_domain' AS rule, name, domain AS what FROM props WHERE domain NOT IN (SELECT type FROM kinds)
UNION SELECT 'undefined_range', name, range FROM props WHERE range NOT IN (SELECT type FROM kinds)
UNION SELECT 'undefined_parent', type, parent FROM concepts c WHERE parent IS NOT NULL AND parent NOT IN (SELECT type FROM kinds)""")
def val_tbox(spark, d):
    return V.schema_errors(table(spark, d, "concepts"), properties(spark, d))


def properties(spark, d):
    """name, domain, range as the edges show them."""
    from graphloom.shared import salted_lookup

    n = table(spark, d, "nodes").select("id", "type").groupBy("id").agg(F.array_sort(F.collect_set("type")).alias("t"))
    e = table(spark, d, "edges").select(F.col("type").alias("name"), F.col("from").alias("f"), F.col("to").alias("t")).distinct()
    e = salted_lookup(e, n.select(F.col("id").alias("f"), F.col("t").alias("dom")), ["f"], "inner")
    e = salted_lookup(e, n.select(F.col("id").alias("t"), F.col("t").alias("ran")), ["t"], "inner")
    return e.select("name", F.explode("dom").alias("domain"), "ran").select("name", "domain", F.explode("ran").alias("range")).distinct()


@query(f"WITH {DECLARED} SELECT DISTINCT 'undeclared_type' AS rule, type AS what FROM nodes WHERE type NOT IN (SELECT type FROM kinds) UNION SELECT DISTINCT 'undeclared_predicate', type FROM edges WHERE type NOT IN (SELECT type FROM decl)")
def val_abox(spark, d):
    return V.graph_errors(table(spark, d, "nodes"), table(spark, d, "edges"), table(spark, d, "concepts").select("type").distinct(), _declared(spark, d))


@query(f"""WITH f AS (SELECT node_key, unnest(aliases) AS a FROM nodes)
SELECT node_key, {CANON("a")} AS canon, {SLUG("a")} AS slug, count(*) AS n FROM f WHERE a IS NOT NULL GROUP BY 1, 2, 3""")
def str_canonical(spark, d):
    a = table(spark, d, "nodes").select("node_key", F.explode("aliases").alias("a")).where("a is not null")
    return a.groupBy("node_key", canonical(F.col("a")).alias("canon"), slug(F.col("a")).alias("slug")).agg(F.count("*").alias("n"))
