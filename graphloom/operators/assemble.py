"""Extracted occurrences to one graph: identities, merging of duplicates, confidence rules, name normalisation.

Occurrence tables: nodes (source_file, pos, raw_id, type, name, confidence, aliases) and their attributes in long form
(source_file, pos, attr, value, confidence); edges (source_file, pos, type, src, dst, confidence). Order is always by
(source_file, pos), so that results don't depend on how rows are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import canonical, clamp, edge_id, edge_key, slug, stable_id
from graphloom.operators.chunks import running_totals
from graphloom.operators.hierarchy import hierarchy
from graphloom.shared import salted_lookup

OCC = ["source_file", "pos"]


def with_stable_ids(nodes: DataFrame) -> DataFrame:
    """Adds stable_id; a node without name is named by its raw id."""
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("raw_id"))
    return nodes.withColumn("stable_id", stable_id(F.col("type"), name))


def endpoint_map(nodes: DataFrame) -> DataFrame:
    """raw_id, stable_id over all files; of several the last occurrence counts."""
    return nodes.groupBy("raw_id").agg(F.max_by("stable_id", F.struct(*OCC)).alias("stable_id"))


def resolve_endpoints(edges: DataFrame, nodes: DataFrame, ends: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """Endpoints as stable ids: through the raw id, else already stable, else by a name that one node alone has; else as written. Hot endpoints are salted."""
    raw = endpoint_map(nodes)
    ids = nodes.select("stable_id").distinct()
    by_name = nodes.select(F.regexp_replace("stable_id", "^[^-]*-", "").alias("s"), "stable_id").distinct().groupBy("s").agg(F.min("stable_id").alias("one"), F.count("*").alias("n")).where("n = 1").drop("n")
    for end in ends:
        e = salted_lookup(edges.withColumn("_raw", F.col(end)), raw.select(F.col("raw_id").alias("_raw"), F.col("stable_id").alias("_a")), ["_raw"])
        e = salted_lookup(e, ids.select(F.col("stable_id").alias("_raw"), F.lit(True).alias("_is")), ["_raw"])
        e = salted_lookup(e.withColumn("_slug", slug(F.col(end))), by_name.select(F.col("s").alias("_slug"), "one"), ["_slug"])
        edges = e.withColumn(end, F.coalesce("_a", F.when(F.col("_is"), F.col("_raw")), "one", F.col(end))).drop("_raw", "_a", "_is", "_slug", "one")
    return edges


def mean_or_max(c: str, how: str) -> Column:
    if how not in ("mean", "max"):
        raise ValueError("confidences are merged by mean or max")
    return (F.avg if how == "mean" else F.max)(clamp(F.col(c)))


def merge_nodes(nodes: DataFrame, how: str = "mean") -> DataFrame:
    """One row per stable_id: type and name of the first occurrence, mean or greatest confidence, aliases (sorted, without the name; null if none), occurrences. The files are in node_files()."""
    first = lambda c: F.min_by(c, F.struct(*OCC))
    out = nodes.groupBy("stable_id").agg(first("type").alias("type"), first("name").alias("name"), mean_or_max("confidence", how).alias("confidence"), F.count("*").alias("occurrences"))
    each = nodes.select("stable_id", F.explode("aliases").alias("a")).where("a is not null").distinct().groupBy("stable_id").agg(F.array_sort(F.collect_list("a")).alias("a"))
    kept = F.filter("a", lambda a: ~a.eqNullSafe(F.col("name")))
    return out.join(each, "stable_id", "left").withColumn("aliases", F.when(F.size(kept) > 0, kept)).drop("a")


def node_files(nodes: DataFrame) -> DataFrame:
    """stable_id, source_file, occurrences: where a node stands, in long form, since a node may stand in a large part of all files."""
    return nodes.groupBy("stable_id", "source_file").agg(F.count("*").alias("occurrences"))


def merge_attributes(attrs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value, confidence, of the attribute occurrences (keys, source_file, pos, value, confidence, is_text).

    The highest confidence wins, of equal ones the first. Among texts of full confidence every one that differs from what
    has been put together so far is appended after '; '. Losing rows never leave the map side: only those of the highest
    confidence are collected.
    """
    c = attrs.withColumn("confidence", clamp(F.col("confidence")))
    top = c.groupBy(*keys).agg(F.max("confidence").alias("top"), F.min_by(F.struct("value", "is_text"), F.struct(-F.col("confidence"), *OCC)).alias("first"))
    full = c.where("confidence = 1").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*OCC, "value", "is_text"))).alias("all"))
    texts = F.transform(F.slice("all", 2, 1 << 30), lambda o: F.struct(o.value.alias("value"), o.is_text.alias("is_text")))
    joins = lambda acc, o: acc.is_text & o.is_text & acc.value.isNotNull() & o.value.isNotNull() & (acc.value != o.value)
    fold = F.aggregate(texts, F.struct(F.get("all", F.lit(0)).value.alias("value"), F.get("all", F.lit(0)).is_text.alias("is_text")), lambda acc, o: F.struct(F.when(joins(acc, o), F.concat(acc.value, F.lit("; "), o.value)).otherwise(acc.value).alias("value"), acc.is_text.alias("is_text")))
    joined = full.where(F.size("all") > 1).select(*keys, fold.value.alias("joined"), F.lit(True).alias("_j"))
    return top.join(joined, keys, "left").select(*keys, F.when(F.col("_j"), F.col("joined")).otherwise(F.col("first.value")).alias("value"), F.col("top").alias("confidence"))


def merge_edges(edges: DataFrame, how: str = "mean", digits: int = 6) -> DataFrame:
    """One row per (type, src, dst), grouped on the full key: id, method, mean or greatest confidence, occurrences. No edge is lost where short ids collide."""
    g = edges.groupBy("type", "src", "dst").agg(mean_or_max("confidence", how).alias("confidence"), F.count("*").alias("occurrences"))
    key = edge_key(F.col("type"), F.col("src"), F.col("dst"))
    return g.select(edge_id(key, digits).alias("id"), key.alias("key"), "type", "src", "dst", "confidence", F.lit("llm_extraction").alias("method"), "occurrences")


def merge_log(attrs: DataFrame, merged: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Of every entity of several occurrences: how many, and how many attribute values won, lost and were put together: texts of full confidence that differ from the result are its parts."""
    n = attrs.groupBy(id_col).agg(F.countDistinct(F.struct(*OCC)).alias("occurrences")).where("occurrences > 1")
    w = attrs.join(merged.select(*keys, F.col("value").alias("won")), keys)
    lost = ~F.col("value").eqNullSafe(F.col("won"))
    part = lost & F.col("won").isNotNull() & F.col("value").isNotNull() & F.col("is_text") & (clamp(F.col("confidence")) == 1)
    counts = w.groupBy(id_col).agg(F.count_if(~lost).alias("winning"), F.count_if(lost & ~part).alias("losing"), F.count_if(part).alias("concatenated"))
    return n.join(counts, id_col)


def dedup_in_file(attrs: DataFrame) -> DataFrame:
    """source_file, stable_id, attr: the value of highest confidence within the file, of equal ones the first. Nothing is put together."""
    best = F.max_by(F.struct("value", "confidence"), F.struct(clamp(F.col("confidence")), -F.col("pos")))
    return attrs.groupBy("source_file", "stable_id", "attr").agg(best.alias("b")).select("source_file", "stable_id", "attr", "b.value", clamp(F.col("b.confidence")).alias("confidence"))


def name_inventory(nodes: DataFrame) -> DataFrame:
    """type, name: the distinct names of each type, in long form."""
    return nodes.where("name <> ''").select("type", "name").distinct()


def check_name_map(names: DataFrame, norm_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The usable rows (type, alias, canonical) and the errors (type, alias, rule) of a map. Rows of an alias onto itself vanish silently."""
    known = names.select("type", F.col("name").alias("canonical"), F.lit(True).alias("_known")).distinct()
    j = norm_map.join(known, ["type", "canonical"], "left").where(~F.col("alias").eqNullSafe(F.col("canonical")))
    bad = F.when(F.col("alias").isNull() | F.col("canonical").isNull(), "not a text").when(F.col("_known").isNull(), "unknown canonical name")
    return j.where(bad.isNull()).select("type", "alias", "canonical"), j.where(bad.isNotNull()).select("type", "alias", bad.alias("rule"))


def drop_cycles(norm_map: DataFrame) -> DataFrame:
    """The map without aliases whose chain reaches a cycle: pointer doubling over alias -> canonical, names compared as written."""
    lost = hierarchy(norm_map, "type", "alias", "canonical", paths=False, exact=True).where("depth < 0").select("type", "alias")
    return norm_map.join(lost, ["type", "alias"], "left_anti")


def apply_name_map(nodes: DataFrame, norm_map: DataFrame) -> DataFrame:
    """Names rewritten by one step of the map, compared in canonical form; of several rows the least canonical name."""
    m = norm_map.groupBy("type", canonical(F.col("alias")).alias("_c")).agg(F.min("canonical").alias("_to"))
    return salted_lookup(nodes.withColumn("_c", canonical(F.col("name"))), m, ["type", "_c"]).withColumn("name", F.coalesce("_to", "name")).drop("_c", "_to")


def alias_index(norm_map: DataFrame) -> DataFrame:
    """type, name, aliases: the map turned round."""
    return norm_map.groupBy("type", F.col("canonical").alias("name")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def dangling_edges(edges: DataFrame, nodes: DataFrame, keep: bool = True, scope: tuple[str, ...] = ("source_file",)) -> DataFrame:
    """Edges whose both ends are nodes of the same file (keep), or the others. AQE splits a hot end's partition: these are semi joins that probe with the edges."""
    ids = nodes.select(*scope, "raw_id").distinct()
    on = lambda end: ids.select(*scope, F.col("raw_id").alias(end))
    good = edges.join(on("src"), [*scope, "src"], "left_semi").join(on("dst"), [*scope, "dst"], "left_semi")
    if keep:
        return good
    a = edges.join(on("src"), [*scope, "src"], "left_anti")
    return a.unionByName(edges.join(on("src"), [*scope, "src"], "left_semi").join(on("dst"), [*scope, "dst"], "left_anti"))


def remap_ids(index: DataFrame, renamed: DataFrame, column: str = "id") -> DataFrame:
    """An index of chunks and ids after renames (old, new): ids without one stay."""
    return salted_lookup(index.withColumnRenamed(column, "old"), renamed.select("old", "new"), ["old"]).withColumn(column, F.coalesce("new", "old")).drop("old", "new")


def names_to_review(inventory: DataFrame, least: int = 2, most: int = 500) -> DataFrame:
    """type, request, names: the sorted names of every type with at least `least`, `most` to a request of the language model. Numbered by running totals over ranges, so no task sorts a whole type."""
    o = inventory.select("type", "name", F.struct("type", "name").alias("_o"), F.lit(1).cast("long").alias("_one"))
    k = running_totals(o, "_o", "_one", int(inventory.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = k.groupBy("type").agg(F.min("before").alias("first"), F.count("*").alias("n")).where(F.col("n") >= least)  # one row per type
    j = k.join(F.broadcast(first), "type").withColumn("request", F.floor((F.col("before") - F.col("first")) / most).cast("int"))
    return j.groupBy("type", "request").agg(F.array_sort(F.collect_list("name")).alias("names"))


def annotated(nodes: DataFrame, index: DataFrame) -> DataFrame:
    """Merged nodes with the aliases that alias_index() (type, name, aliases) has for their name joined to their own, sorted, without the name itself; null if none."""
    more = index.groupBy("type", "name").agg(F.flatten(F.collect_list("aliases")).alias("_more"))
    j = salted_lookup(nodes, more, ["type", "name"])
    both = F.array_sort(F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("_more", F.array().cast("array<string>")))))
    kept = F.filter(both, lambda a: a.isNotNull() & ~a.eqNullSafe(F.col("name")))
    return j.withColumn("aliases", F.when(F.size(kept) > 0, kept)).drop("_more")


def assemble(nodes: DataFrame, attributes: DataFrame, edges: DataFrame, edge_attributes: DataFrame | None = None, norm_map: DataFrame | None = None, prior_log: DataFrame | None = None, how: str = "mean") -> dict[str, DataFrame]:
    """All steps from occurrences to one graph: names by the map, identities, merged nodes, attributes and files, endpoints, merged edges and theirs, and the log.

    nodes: source_file, pos, raw_id, type, name, confidence, aliases; attributes: source_file, pos, attr, value, confidence,
    is_text; edges: source_file, pos, type, src, dst, confidence; edge_attributes as attributes. Edges without an end that is
    a node are left out. prior_log: events (event, id, ...) of an earlier run, of which synonym_collapse stays.
    """
    m = drop_cycles(norm_map) if norm_map is not None else None
    named = with_stable_ids(apply_name_map(nodes, m) if m is not None else nodes)
    out = {"nodes": merge_nodes(named, how), "files": node_files(named)}
    if m is not None:
        out["nodes"] = annotated(out["nodes"], alias_index(m))
    attrs = attributes.join(named.select(*OCC, "stable_id"), OCC)
    out["attributes"] = merge_attributes(attrs, ["stable_id", "attr"])
    ids = out["nodes"].select(F.col("stable_id").alias("raw_id"))
    ends = dangling_edges(resolve_endpoints(edges, named), ids, scope=())
    out["edges"] = merge_edges(ends, how)
    if edge_attributes is not None:
        out["edge_attributes"] = merge_attributes(edge_attributes.join(ends.select(*OCC, "type", "src", "dst"), OCC), ["type", "src", "dst", "attr"])
    out["log"] = merge_log(attrs, out["attributes"], ["stable_id", "attr"], "stable_id").withColumnRenamed("stable_id", "id").withColumn("event", F.lit("node_merge"))
    if prior_log is not None:
        out["log"] = out["log"].unionByName(prior_log.where("event = 'synonym_collapse'"), allowMissingColumns=True)
    return out
