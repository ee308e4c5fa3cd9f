"""A graph in the formats others read: JSON lines, Turtle, CSV bundles with load scripts, note vaults, plain graph formats. Texts are rendered as columns; files are written by the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import attribute_key, label_name, relation_name, turtle_local, turtle_text
from graphloom.operators.chunks import running_totals
from graphloom.shared import salted_lookup

#: The vocabularies of Turtle files.
RDF, RDFS, SKOS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2004/02/skos/core#"
#: Prefixes of the schema's and the data's names, and what they stand for.
SCHEMA, DATA = ("ex", "http://example.org/schema#"), ("data", "http://example.org/data#")

#: Neighbours in one line of an adjacency list; a hub has several lines.
LINE_ENDS = 1000


def json_lines(rows: DataFrame) -> DataFrame:
    """line: every row as a JSON object; nulls inside attributes are kept, missing aliases are not written."""
    keep = rows.drop("attributes")
    head = F.to_json(F.struct(*[F.col(f"`{c}`") for c in keep.columns]))
    if "attributes" not in rows.columns:
        return rows.select(head.alias("line"))
    attrs = F.to_json("attributes", {"ignoreNullFields": "false"})
    return rows.select(F.concat(F.substring(head, 1, F.length(head) - 1), F.lit(',"attributes":'), F.coalesce(attrs, F.lit("{}")), F.lit("}")).alias("line"))


def _ex(c: str | Column) -> Column:
    return F.concat(F.lit(f"{SCHEMA[0]}:"), turtle_local(F.col(c) if isinstance(c, str) else c))


def _data(c: str) -> Column:
    return F.concat(F.lit(f"{DATA[0]}:"), turtle_local(F.col(c)))


def turtle_prefixes(spark: SparkSession, skos: bool = True) -> DataFrame:
    """section (0), line: the prefixes of a Turtle file; that of alternative labels only where there are any."""
    names = [("rdf", RDF), ("rdfs", RDFS), SCHEMA, DATA, *([("skos", SKOS)] if skos else [])]
    return spark.createDataFrame([(0, f"@prefix {p}: <{n}> .") for p, n in names], "section int, line string")


def schema_turtle(concepts: DataFrame, properties: DataFrame) -> DataFrame:
    """section, line of classes, their parents, attributes (one for each concept that has it) and object properties."""
    prop = lambda name, domain, to: F.concat(name, F.lit(" rdf:type rdf:Property ;\n    rdfs:domain "), domain, F.lit(" ;\n    rdfs:range  "), to, F.lit(" ."))
    lines = [
        concepts.select(F.lit(1).alias("section"), F.concat(_ex("type"), F.lit(" rdf:type rdfs:Class .")).alias("line")),
        concepts.where("parent <> ''").select(F.lit(2), F.concat(_ex("type"), F.lit(" rdfs:subClassOf "), _ex("parent"), F.lit(" ."))),
        concepts.select("type", F.explode("attributes").alias("attr")).select(F.lit(3), prop(_ex("attr"), _ex("type"), F.lit("rdfs:Literal"))),
        properties.select(F.lit(4), prop(_ex("name"), _ex("domain"), _ex("range"))),
    ]
    return reduce(DataFrame.union, lines).where("line is not null").distinct()


def graph_turtle(nodes: DataFrame, attributes: DataFrame, aliases: DataFrame, edges: DataFrame) -> DataFrame:
    """section, line of types, literals (nulls left out), alternative labels and relations. Inputs: (id, type), (id, attr, value), (id, alias), (src, type, dst)."""
    text = lambda c: F.concat(F.lit('"'), turtle_text(F.col(c)), F.lit('"'))
    lines = [
        nodes.select(F.lit(5).alias("section"), F.concat(_data("id"), F.lit(" rdf:type "), _ex("type"), F.lit(" .")).alias("line")),
        attributes.where("value is not null").select(F.lit(6), F.concat(_data("id"), F.lit(" "), _ex("attr"), F.lit(" "), text("value"), F.lit(" ."))),
        aliases.where("alias is not null").select(F.lit(7), F.concat(_data("id"), F.lit(" skos:altLabel "), text("alias"), F.lit(" ."))),
        edges.select(F.lit(8), F.concat(_data("src"), F.lit(" "), _ex("type"), F.lit(" "), _data("dst"), F.lit(" ."))),
    ]
    return reduce(DataFrame.union, lines).distinct()


def declared_relations(edges: DataFrame, properties: DataFrame) -> DataFrame:
    """Edges whose type is a property of the schema: the others are not written as triples."""
    return edges.join(properties.select(F.col("name").alias("type")).distinct(), "type", "left_semi")


def flat_attributes(attributes: DataFrame) -> DataFrame:
    """id, key, text: attr_<name>_value and attr_<name>_confidence; a missing value is empty, a missing confidence 0.0."""
    name = attribute_key(F.col("attr"))
    pair = lambda what, text: F.struct(F.concat(F.lit("attr_"), name, F.lit(f"_{what}")).alias("key"), text.alias("text"))
    pairs = F.array(pair("value", F.coalesce("value", F.lit(""))), pair("confidence", F.coalesce("confidence", F.lit(0.0)).cast("string")))
    return attributes.select("id", F.explode(pairs).alias("p")).select("id", "p.key", "p.text").groupBy("id", "key").agg(F.max("text").alias("text"))


def attribute_properties(attributes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, key, text: each attribute that has a value, and <name>_confidence where that is known."""
    kept = attributes.where("value is not null")
    pairs = F.array(F.struct(F.col("attr").alias("key"), F.col("value").alias("text")), F.struct(F.concat("attr", F.lit("_confidence")).alias("key"), F.col("confidence").cast("string").alias("text")))
    return kept.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.key", "p.text").where("text is not null")


def node_properties(nodes: DataFrame, attributes: DataFrame, ancestors: DataFrame) -> DataFrame:
    """id, label, key, text: the properties of every node in long form.

    nodes: id, type, confidence, aliases, source_files; attributes: id, attr, value, confidence; ancestors: type, parents
    (an array, nearest first). _node_confidence, _parents and _source_files are always there, _aliases where the record has that list; lists are joined by ;.
    """
    joined = nodes.join(ancestors.select("type", "parents"), "type", "left").withColumn("label", label_name(F.col("type")))
    many = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ";")
    own = {"_node_confidence": F.coalesce(F.col("confidence").cast("string"), F.lit("")), "_parents": many(F.col("parents")), "_source_files": many(F.col("source_files")), "_aliases": F.when(F.col("aliases").isNotNull(), many(F.col("aliases")))}
    fixed = joined.select("id", "label", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("text")) for k, v in own.items()])).alias("p")).select("id", "label", "p.key", "p.text").where("text is not null")
    more = attribute_properties(attributes, ["id"]).join(nodes.select("id", label_name(F.col("type")).alias("label")), "id").select("id", "label", "key", "text")
    return fixed.unionByName(more).groupBy("id", "label", "key").agg(F.max("text").alias("text"))


def edge_properties(edges: DataFrame, attributes: DataFrame) -> DataFrame:
    """edge_id, relation, src, dst, key, text: confidence, method and source_files of every edge (id, type, src, dst, ...), and its attributes (id, attr, value, confidence)."""
    head = edges.select(F.col("id").alias("edge_id"), relation_name(F.col("type")).alias("relation"), "src", "dst", "confidence", "method", "source_files")
    own = {"confidence": F.coalesce(F.col("confidence").cast("string"), F.lit("")), "method": F.coalesce("method", F.lit("")), "source_files": F.array_join(F.coalesce("source_files", F.array().cast("array<string>")), ";")}
    keys = ["edge_id", "relation", "src", "dst"]
    fixed = head.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("text")) for k, v in own.items()])).alias("p")).select(*keys, "p.key", "p.text")
    more = attribute_properties(attributes.withColumnRenamed("id", "edge_id"), ["edge_id"]).join(head.select(*keys), "edge_id").select(*keys, "key", "text")
    return fixed.unionByName(more).groupBy(*keys, "key").agg(F.max("text").alias("text"))


def csv_relations(edges: DataFrame) -> DataFrame:
    """relation, src, dst of every edge, as the files of its relation name them."""
    return edges.select(relation_name(F.col("type")).alias("relation"), "src", "dst")


def csv_columns(properties: DataFrame, group: str) -> DataFrame:
    """group, columns: the sorted keys that each label's or relation's rows have."""
    a = properties.select(group, "key").distinct()
    return a.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("columns"))


def csv_rows(properties: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per node or edge, a column for each of `columns`, missing ones empty: the pivot is told its columns and needs no pass of its own."""
    wide = properties.groupBy(*keys).pivot("key", columns).agg(F.max("text"))
    return wide.select(*keys, *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])


def csv_lines(rows: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """section, line of one CSV file, header first: values with commas, quotes or line ends are quoted, quotes doubled."""
    cell = lambda c: F.when(F.col(f"`{c}`").rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(F.col(f"`{c}`"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    head = ",".join((names or {}).get(c, c) for c in rows.columns)
    body = rows.select(F.lit(1).alias("section"), F.concat_ws(",", *[cell(c) for c in rows.columns]).alias("line"))
    return rows.sparkSession.createDataFrame([(0, head)], "section int, line string").unionByName(body)


def write_csv_bundle(nodes: DataFrame, edges: DataFrame, folder: str) -> dict[str, list[str]]:
    """Writes nodes_<label> and relationships_<relation> folders of CSV below `folder`, of node_properties() and edge_properties(); returns the columns of each. One pass for each label, of which a schema has few."""
    made = {}
    for df, group, keys, names, start in ((nodes, "label", ["id"], {}, "nodes"), (edges, "relation", ["edge_id", "src", "dst"], {"src": "from", "dst": "to"}, "relationships")):
        for r in csv_columns(df, group).orderBy(group).collect():
            columns = r["columns"].split(",")
            rows = csv_rows(df.where(F.col(group) == r[group]), keys, columns).orderBy(*keys[-2:]).drop("edge_id")
            for old, new in names.items():
                rows = rows.withColumnRenamed(old, new)
            rows.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{folder}/{start}_{r[group]}")
            made[f"{start}_{r[group]}"] = columns
    return made


def _casts(columns: list[str], row: str, var: str) -> list[str]:
    """Assignments of CSV columns: lists by their names, numbers by theirs, all else as text; empty cells are missing."""
    lists = ("_parents", "_aliases", "_source_files", "source_files")
    out = []
    for c in columns:
        v = f"{row}.{c}" if c.isidentifier() else f"{row}.`{c}`"
        to = f"{var}.{c}" if c.isidentifier() else f"{var}.`{c}`"
        full = f"split({v}, ';')" if c in lists else f"toFloat({v})" if c == "confidence" or c.endswith("_confidence") else v
        out.append(f"{to} = CASE WHEN {v} = '' THEN {'[]' if c in lists else 'null'} ELSE {full} END")
    return out


def load_script(bundle: dict[str, list[str]], base: str | None = None, rows: int = 1000, mark: str = "_GraphNode") -> str:
    """Cypher that loads a bundle of write_csv_bundle(): constraint, nodes by label, relations by type.

    base: the folder's absolute path for a shell, or None for a browser, which reads from its import folder.
    """
    at = (lambda f: f"file://{base}/{f}.csv") if base else (lambda f: f"file:/{f}.csv")
    out = [f"CREATE CONSTRAINT {mark.lower()}_id_unique IF NOT EXISTS\nFOR (n:{mark}) REQUIRE n.id IS UNIQUE;"]
    for name, columns in bundle.items():
        kind, _, label = name.partition("_")
        var = "n" if kind == "nodes" else "r"
        sets = ",\n      ".join(_casts(columns, "row", var))
        if kind == "nodes":
            body = [f"  MERGE (n:{mark} {{id: row.id}})", f"  SET n:{label}"]
        else:
            body = [f"  MATCH (a:{mark} {{id: row.from}})", f"  MATCH (b:{mark} {{id: row.to}})", f"  MERGE (a)-[r:{label}]->(b)"]
        out.append("\n".join([f":auto LOAD CSV WITH HEADERS FROM '{at(name)}' AS row", "CALL {", "  WITH row", *body, *([f"  SET\n      {sets}"] if sets else []), f"}} IN TRANSACTIONS OF {rows} ROWS;"]))
    return "\n\n".join(out) + "\n"


def render_table(nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """id, colour, size, label_size of the drawing: colours by the type's place among the sorted types modulo ten, sizes by degree, labels for the larger ones."""
    kinds = nodes.select("type").distinct().withColumn("k", F.row_number().over(Window.orderBy("type")) - 1)  # one row per type
    top = degree.agg(F.greatest(F.max("degree"), F.lit(1)).alias("top"))
    d = nodes.join(F.broadcast(kinds), "type").join(degree, "id", "left").withColumn("deg", F.coalesce("degree", F.lit(0))).crossJoin(F.broadcast(top))
    return d.select("id", (F.col("k") % 10).cast("int").alias("colour"), F.round(10 + 30 * F.col("deg") / F.col("top"), 1).alias("size"), F.when(F.col("deg") >= 0.15 * F.col("top"), 15).otherwise(0).alias("label_size"))


def render_edges(edges: DataFrame) -> DataFrame:
    """id, src, dst, width of the drawing: edges of a confidence of 0.8 at least are twice as wide."""
    return edges.select("id", "src", "dst", F.when(F.col("confidence") >= 0.8, 2).otherwise(1).alias("width"))


PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1><svg id="g" width="1000" height="800"></svg><script>
const nodes = [{nodes}], edges = [{edges}], colours = ["#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#ff9da7", "#9c755f", "#bab0ac"];
const at = new Map(nodes.map((n, i) => [n.id, [500 + 380 * Math.cos(2 * Math.PI * i / nodes.length), 400 + 330 * Math.sin(2 * Math.PI * i / nodes.length)]]));
const add = (name, attributes, text) => {{ const e = document.createElementNS("http://www.w3.org/2000/svg", name); for (const k in attributes) e.setAttribute(k, attributes[k]); if (text) e.textContent = text; document.getElementById("g").append(e); }};
for (const e of edges) {{ const a = at.get(e.src), b = at.get(e.dst); if (a && b) add("line", {{x1: a[0], y1: a[1], x2: b[0], y2: b[1], stroke: "#999", "stroke-width": e.width}}); }}
for (const n of nodes) {{ const p = at.get(n.id); add("circle", {{cx: p[0], cy: p[1], r: n.size / 2, fill: colours[n.colour]}}, n.id); if (n.label_size) add("text", {{x: p[0], y: p[1], "font-size": n.label_size}}, n.id); }}
</script></body></html>
"""


def page(table: DataFrame, edges: DataFrame, title: str, most: int = 2000) -> str:
    """One HTML page of the `most` largest nodes of render_table() and the edges of render_edges() between them. A page that people look at is small: it is made on the driver."""
    from html import escape

    n = table.orderBy(F.desc("size"), "id").limit(most)
    shown = n.select("id")
    e = edges.join(shown.withColumnRenamed("id", "src"), "src", "left_semi").join(shown.withColumnRenamed("id", "dst"), "dst", "left_semi").orderBy("id").limit(10 * most)
    rows = lambda d: ",\n".join(r[0].replace("</", "<\\/") for r in d.select(F.to_json(F.struct("*"))).collect())
    return PAGE.format(title=escape(title), nodes=rows(n), edges=rows(e.select("src", "dst", "width")))


def note_lines(nodes: DataFrame, attributes: DataFrame, edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """id, section, line of the Markdown note of every node: 0 front matter and title, 1 attributes but the name, 2 outgoing and 3 incoming links, 4 sources.

    Lines, not whole notes, since a hub's links may be a large part of all. nodes: id, type, name and, if known, confidence;
    attributes: id, attr, value and, if known, confidence; files: id, source_file.
    """
    title = nodes.select("id", F.coalesce(F.nullif("name", F.lit("")), F.col("id")).alias("title"))
    sure = F.when(F.col("confidence").isNotNull(), F.concat(F.lit("\nconfidence: "), F.format_string("%.2f", "confidence"))) if "confidence" in nodes.columns else F.lit("")
    head = nodes.join(title, "id").select("id", F.lit(0).alias("section"), F.concat(F.lit("---\ntype: "), F.coalesce("type", F.lit("")), F.lit("\nid: "), "id", F.coalesce(sure, F.lit("")), F.lit("\n---\n# "), "title").alias("line"))
    told = F.when(F.col("confidence").isNotNull(), F.concat(F.lit(" ("), F.format_string("%.2f", "confidence"), F.lit(")"))).otherwise("") if "confidence" in attributes.columns else F.lit("")
    attr = attributes.where("value is not null and attr <> 'name'").select("id", F.lit(1), F.concat(F.lit("- **"), "attr", F.lit("**: "), "value", told))

    def links(a: str, b: str, section: int) -> DataFrame:
        e = edges.select(F.col(a).alias("id"), F.col(b).alias("other"), "type").distinct().join(nodes.select("id"), "id", "left_semi")
        e = salted_lookup(e, title.select(F.col("id").alias("other"), "title"), ["other"])
        return e.select("id", F.lit(section), F.concat(F.lit("- "), "type", F.lit(" [["), F.coalesce("title", "other"), F.lit("]]")))

    out = head.union(attr.distinct()).union(links("src", "dst", 2)).union(links("dst", "src", 3))
    return out if files is None else out.union(files.select("id", F.lit(4), F.concat(F.lit("- "), "source_file")).distinct())


def note(lines: DataFrame, node_id: str) -> DataFrame:
    """note: one node's note as one text."""
    mine = lines.where(F.col("id") == node_id)
    heads = F.create_map(*[F.lit(x) for x in (1, "\n\n## Attributes\n", 2, "\n\n## Outgoing\n", 3, "\n\n## Incoming\n", 4, "\n\n## Sources\n")])
    per = mine.groupBy("section").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("section", "text"))), lambda x: F.concat(F.when(x.section > 0, F.element_at(heads, x.section)).otherwise(""), x.text))
    return per.agg(F.array_join(whole, "").alias("note"))


def note_index(nodes: DataFrame) -> DataFrame:
    """type, position, line: the entries of the vault's index, by type and name. Numbered by running totals over ranges, so no task sorts a whole type."""
    title = F.coalesce(F.nullif("name", F.lit("")), F.col("id"))
    o = nodes.select("type", "id", title.alias("title")).withColumn("_o", F.struct("type", "title", "id")).withColumn("_one", F.lit(1).cast("long"))
    k = running_totals(o, "_o", "_one", int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = k.groupBy(F.col("type").alias("_t")).agg(F.min("before").alias("first"))  # one row per type
    j = k.join(F.broadcast(first), F.col("type").eqNullSafe(F.col("_t")))
    return j.select("type", (F.col("before") - F.col("first") + 1).cast("int").alias("position"), F.concat(F.lit("- [["), "title", F.lit("]]")).alias("line"))


def graph_lines(nodes: DataFrame, edges: DataFrame, fmt: str) -> DataFrame:
    """section, line of a graph in graphml, gml, gexf, pajek, edgelist, adjacency or node-link json (an array's last line has no comma: see write_text)."""
    from graphloom.functions.text import html_text

    n, e = nodes.select("id", "type").distinct(), edges.select("src", "dst").distinct()
    x = lambda c: html_text(F.col(c))
    q = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit("'")), F.lit('"'))
    forms = {
        "graphml": ('<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">', F.concat(F.lit('<node id="'), x("id"), F.lit('"/>')), F.concat(F.lit('<edge source="'), x("src"), F.lit('" target="'), x("dst"), F.lit('"/>')), "</graph></graphml>"),
        "gexf": ('<gexf version="1.2"><graph defaultedgetype="directed"><nodes>', F.concat(F.lit('<node id="'), x("id"), F.lit('" label="'), x("type"), F.lit('"/>')), F.concat(F.lit('<edge source="'), x("src"), F.lit('" target="'), x("dst"), F.lit('"/>')), "</edges></graph></gexf>"),
        "gml": ("graph [ directed 1", F.concat(F.lit("node [ id "), q("id"), F.lit(" label "), q("type"), F.lit(" ]")), F.concat(F.lit("edge [ source "), q("src"), F.lit(" target "), q("dst"), F.lit(" ]")), "]"),
        "pajek": ("*vertices", q("id"), F.concat(q("src"), F.lit(" "), q("dst")), ""),
        "edgelist": ("", F.lit(None).cast("string"), F.concat_ws(" ", "src", "dst"), ""),
    }
    if fmt == "json":
        quoted = lambda **kv: F.to_json(F.struct(*[F.col(c).alias(k) for k, c in kv.items()]))
        rows = [n.select(F.lit(1).alias("section"), quoted(id="id", node_type="type").alias("line")), edges.select("id", "type", "src", "dst").distinct().select(F.lit(3), quoted(source="src", target="dst", label="id", edge_type="type"))]
        head = nodes.sparkSession.createDataFrame([(0, '{"directed": true, "multigraph": false, "graph": {}, "nodes": ['), (2, '], "links": ['), (4, "]}")], "section int, line string")
        return head.union(rows[0]).union(rows[1])
    if fmt == "adjacency":
        part = F.floor((F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1) / LINE_ENDS)
        return e.withColumn("p", part).groupBy("src", "p").agg(F.array_join(F.array_sort(F.collect_list("dst")), " ").alias("d")).select(F.lit(2).alias("section"), F.concat_ws(" ", "src", "d").alias("line"))
    head, node, edge, tail = forms[fmt]
    spark = nodes.sparkSession
    middle = {"gexf": "</nodes><edges>", "pajek": "*arcs"}.get(fmt, "")
    fixed = spark.createDataFrame([(0, head), (2, middle), (4, tail)], "section int, line string").where("line <> ''")
    return fixed.unionByName(n.select(F.lit(1).alias("section"), node.alias("line")).where("line is not null")).unionByName(e.select(F.lit(3).alias("section"), edge.alias("line")))


def write_text(lines: DataFrame, path: str) -> None:
    """Lines with their section as files of a folder, in order of section and line: a distributed sort, no driver loop."""
    lines.orderBy("section", "line").select("line").write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    json_lines(rows).write.mode("overwrite").text(path)
