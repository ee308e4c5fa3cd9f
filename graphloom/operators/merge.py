"""Two sessions to one: namespaces, disjoint unions, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def namespaced(rows: DataFrame, alias: str, columns: tuple[str, ...] = ("source_file",), lists: tuple[str, ...] = ()) -> DataFrame:
    """File names under `alias/`, in plain columns and in lists; names already under it stay."""
    put = lambda c: F.when(c.startswith(f"{alias}/"), c).otherwise(F.concat(F.lit(f"{alias}/"), c))
    for c in columns:
        rows = rows.withColumn(c, put(F.col(c)))
    for c in lists:
        rows = rows.withColumn(c, F.transform(c, put))
    return rows


def disjoint_union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables; ValueError if they share a key."""
    both = a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_semi").limit(1).collect()
    if both:
        raise ValueError(f"both sessions hold {tuple(both[0])}")
    return a.unionByName(b)


def merged_manifest(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("session_a", "session_b")) -> DataFrame:
    """source_file, sha256, session of both manifests."""
    parts = [namespaced(m, n).select("source_file", "sha256", F.lit(n).alias("session")) for m, n in zip((a, b), names)]
    return disjoint_union(*parts, ["source_file"])


def provenance(merged: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """id, origin: whether a merged node (id) stands in session a, b, both or is new."""
    j = merged.select("id").distinct().join(a.select("id").distinct().withColumn("a", F.lit(True)), "id", "left").join(b.select("id").distinct().withColumn("b", F.lit(True)), "id", "left")
    return j.select("id", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "a").when(F.col("b"), "b").otherwise("new").alias("origin"))


def edge_provenance(edges: DataFrame, origin: DataFrame) -> DataFrame:
    """id, kind of every edge: cross if its ends stand in both sessions between them (that is asked first), else a, b or new."""
    e = edges.join(origin.select(F.col("id").alias("src"), F.col("origin").alias("s")), "src", "left").join(origin.select(F.col("id").alias("dst"), F.col("origin").alias("t")), "dst", "left")
    in_a = lambda c: F.coalesce(F.col(c).isin("a", "both"), F.lit(False))
    in_b = lambda c: F.coalesce(F.col(c).isin("b", "both"), F.lit(False))
    cross = (in_a("s") & in_b("t")) | (in_b("s") & in_a("t"))
    return e.select("id", F.when(cross, "cross").when(in_a("s") & in_a("t"), "a").when(in_b("s") & in_b("t"), "b").otherwise("new").alias("kind"))


def reextraction(strategy: str, chunks: DataFrame, wanted: DataFrame, kinds: DataFrame, mentions: DataFrame, top: int) -> DataFrame:
    """source_file, chunk_index to be extracted again after two schemas became one: none, all (full), or for each new property (name, kind) the `top` chunks that say most on its kinds (surgical)."""
    every = chunks.select("source_file", "chunk_index").distinct()
    if strategy == "full":
        return every
    if strategy == "none":
        return every.where("false")
    if strategy != "surgical":
        raise ValueError("the strategies are none, surgical and full")
    from graphloom.operators.orphans import surgical_chunks

    return surgical_chunks(wanted, kinds, mentions, top).select("source_file", "chunk_index").distinct().join(every, ["source_file", "chunk_index"], "left_semi")


def new_properties(merged: DataFrame, before: DataFrame) -> DataFrame:
    """Properties (name, domain, range) of a merged schema that a session's own lacks, by name."""
    return merged.join(before.select("name").distinct(), "name", "left_anti")


def merged_schema(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, type, sessions, attributes of the concepts of both sessions, those of a proposed first: see ontology.merge_proposals."""
    from graphloom.operators.ontology import merge_proposals

    tagged = [x.select(F.lit(n).alias("session_id"), "pos", "type", "attributes") for n, x in (("session_a", a), ("session_b", b))]
    return merge_proposals(tagged[0].unionByName(tagged[1]))


def merged_index(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("session_a", "session_b")) -> DataFrame:
    """The mentions (id, source_file, chunk_index) of both sessions under their names."""
    return namespaced(a, names[0]).unionByName(namespaced(b, names[1]))


def count_trace(steps: dict[str, tuple[DataFrame, DataFrame]], properties: DataFrame) -> DataFrame:
    """step, nodes, edges, declared: how many nodes and edges stand after each step, and how many of the edges are of declared types."""
    known = properties.select(F.col("name").alias("type")).distinct().withColumn("d", F.lit(True))
    out = None
    for name, (n, e) in steps.items():
        row = e.join(known, "type", "left").agg(F.count("*").alias("edges"), F.count_if("d").alias("declared")).crossJoin(n.agg(F.count("*").alias("nodes"))).select(F.lit(name).alias("step"), "nodes", "edges", "declared")  # one row each
        out = row if out is None else out.unionByName(row)
    return out
