"""Checks and repairs of extractions, schemas and graphs. Declared names are few by nature, so Spark may broadcast them by their size."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.shared import salted_lookup


def declared(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Rows whose `column` is declared."""
    return rows.join(names.select(F.col(names.columns[0]).alias(column)).distinct(), column, "left_semi")


def without_nulls(items: Column) -> Column:
    return F.filter(F.coalesce(items, F.array()), lambda x: x.isNotNull())


def scalar_value(value: Column, confidence: Column) -> Column:
    """A bare value as value with confidence: 0 if null, 0.5 if not, its own where it has one."""
    return F.struct(value.alias("value"), F.coalesce(confidence, F.when(value.isNull(), 0.0).otherwise(0.5)).alias("confidence"))


def backfill(attrs: DataFrame, nodes: DataFrame, schema: DataFrame) -> DataFrame:
    """The attribute occurrences, and a null of confidence 0 for every attribute that the schema (type, attr) gives a node's type and the node lacks; added says which."""
    due = nodes.join(schema, "type").select("source_file", "pos", "stable_id", "attr").distinct()
    missing = due.join(attrs.select("source_file", "pos", "attr"), ["source_file", "pos", "attr"], "left_anti")
    empty = missing.select("source_file", "pos", "stable_id", "attr", F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("confidence"), F.lit(False).alias("is_text"), F.lit(True).alias("added"))
    return attrs.withColumn("added", F.lit(False)).unionByName(empty)


def structure_errors(answers: DataFrame, keys: tuple[str, ...] = ("nodes", "edges")) -> DataFrame:
    """label, rule, what of answers (label, answer: JSON text) whose top level is no object, lacks one of `keys` or has another. What fails here is not looked at further."""
    have = F.json_object_keys("answer")
    missing, more = F.array_except(F.array(*map(F.lit, keys)), have), F.array_except(have, F.array(*map(F.lit, keys)))
    none = F.struct(F.lit("no object").alias("rule"), F.lit(None).cast("string").alias("what"))
    each = lambda rule, xs: F.transform(xs, lambda x: F.struct(F.lit(rule).alias("rule"), x.alias("what")))
    errors = F.when(have.isNull(), F.array(none)).otherwise(F.concat(each("missing key", missing), each("unexpected key", more)))
    return answers.select("label", F.inline(errors))


def extraction_errors(nodes: DataFrame, edges: DataFrame, concepts: DataFrame, properties: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """source_file, rule, what: undeclared types, missing ids or attributes, unknown endpoints, missing confidences of each file's extraction.

    An endpoint is known if a node of the same file, or of prior (source_file, raw_id), has that id; hot ones are salted.
    Attributes are looked at where nodes have that column. Domains and ranges are not looked at.
    """
    row = lambda df, rule, what: df.select("source_file", F.lit(rule).alias("rule"), F.col(what).cast("string").alias("what"))
    ids = nodes.where("raw_id <> ''").select("source_file", "raw_id")
    ids = (ids if prior is None else ids.unionByName(prior.select("source_file", "raw_id"))).distinct().withColumn("known", F.lit(True))
    unknown = lambda end: salted_lookup(edges, ids.withColumnRenamed("raw_id", end), ["source_file", end]).where("known is null")
    found = [
        row(nodes.join(concepts.select("type"), "type", "left_anti"), "undeclared node type", "raw_id"),
        row(nodes.where("raw_id is null or raw_id = ''").withColumn("raw_id", F.lit(None).cast("string")), "node without id", "raw_id"),
        row(edges.join(properties.select("type"), "type", "left_anti"), "undeclared edge type", "pos"),
        row(unknown("src"), "unknown source", "src"),
        row(unknown("dst"), "unknown target", "dst"),
        row(edges.where("confidence is null"), "no confidence", "pos"),
    ]
    if "attributes" in nodes.columns:
        found.append(row(nodes.where("attributes is null"), "no attributes", "raw_id"))
    return reduce(DataFrame.unionByName, found)


def recover(nodes: DataFrame, edges: DataFrame, concepts: DataFrame, properties: DataFrame, prior: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What can be kept of a faulty extraction: nodes of declared types, declared edges between them, and of the nodes those with such an edge or known before (prior: source_file, raw_id)."""
    n = declared(nodes, concepts, "type")
    known = n.select("source_file", "raw_id") if prior is None else n.select("source_file", "raw_id").unionByName(prior)
    known = known.distinct()
    e = declared(edges, properties, "type")
    for end in ("src", "dst"):
        e = e.join(known.select("source_file", F.col("raw_id").alias(end)), ["source_file", end], "left_semi")
    used = e.select("source_file", F.explode(F.array("src", "dst")).alias("raw_id"))
    if prior is not None:
        used = used.unionByName(prior)
    return n.join(used.distinct(), ["source_file", "raw_id"], "left_semi"), e


def schema_errors(concepts: DataFrame, properties: DataFrame) -> DataFrame:
    """rule, name, what: domains and ranges of properties, and parents of concepts, that are no concepts. Each once."""
    kinds = concepts.select("type").distinct()
    row = lambda df, rule, name, what: df.select(F.lit(rule).alias("rule"), F.col(name).alias("name"), F.col(what).alias("what"))
    missing = lambda df, c: df.where(F.col(c).isNotNull()).join(kinds.select(F.col("type").alias(c)), c, "left_anti")
    parents = concepts.select(F.col("type").alias("name"), "parent")
    all_ = [row(missing(properties, "domain"), "undefined_domain", "name", "domain"), row(missing(properties, "range"), "undefined_range", "name", "range"), row(missing(parents, "parent"), "undefined_parent", "name", "parent")]
    return reduce(DataFrame.unionByName, all_).distinct()


def checked_schema(concepts: DataFrame, properties: DataFrame, correct: Callable[[DataFrame, DataFrame, DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The schema after one correction where it has errors (correct gets concepts, properties and errors), and the errors that are left. It never fails: what is left is recorded."""
    errors = schema_errors(concepts, properties)
    if errors.isEmpty():
        return concepts, properties, errors
    fixed = correct(concepts, properties, errors)
    concepts = keep_if_whole(concepts, fixed[0])
    return concepts, fixed[1], schema_errors(concepts, fixed[1])


def graph_errors(nodes: DataFrame, edges: DataFrame, concepts: DataFrame, properties: DataFrame) -> DataFrame:
    """rule, what: types of nodes and of edges that are not declared. Each once."""
    n = nodes.select("type").distinct().join(concepts.select("type"), "type", "left_anti").select(F.lit("undeclared_type").alias("rule"), F.col("type").alias("what"))
    e = edges.select("type").distinct().join(properties.select("type"), "type", "left_anti").select(F.lit("undeclared_predicate").alias("rule"), F.col("type").alias("what"))
    return n.unionByName(e)


def keep_if_whole(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rewritten schema, unless it has no concepts or fewer than half of those before."""
    n, m = before.count(), after.count()
    return after if m and 2 * m >= n else before
