"""Isolated nodes and the chunks worth reading again. Inputs: orphans (id), kinds (id, type), mentions (id, source_file, chunk_index), pairs (a, b: types that may be joined)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import clamp, without_fence
from graphloom.shared import salted_lookup

CHUNK = ["source_file", "chunk_index"]


def typed(mentions: DataFrame, kinds: DataFrame) -> DataFrame:
    """mentions with the type of each node; hot nodes are salted."""
    return salted_lookup(mentions, kinds.select("id", "type"), ["id"], "inner")


def compatible_cooccurrence(orphans: DataFrame, kinds: DataFrame, mentions: DataFrame, pairs: DataFrame) -> DataFrame:
    """orphan, peer, shared: in how many chunks an orphan stands with each node of a type that may be joined to it. The types meet first, so other pairs are never made."""
    t = typed(mentions, kinds)
    mine = t.join(orphans, "id", "left_semi").select(F.col("id").alias("orphan"), *CHUNK, F.col("type").alias("a"))
    wanted = mine.join(pairs.select("a", F.col("b").alias("type")).distinct(), "a")
    return t.withColumnRenamed("id", "peer").join(wanted, [*CHUNK, "type"]).where("orphan <> peer").groupBy("orphan", "peer").agg(F.count("*").alias("shared"))


def candidates(orphans: DataFrame, kinds: DataFrame, mentions: DataFrame, pairs: DataFrame, least: int = 1, top: int = 5) -> DataFrame:
    """orphan, peer, shared, score: the nodes that an orphan stands with most often, of types that may be joined. The score is the share of the chunks of the node that stands in most."""
    ok = compatible_cooccurrence(orphans, kinds, mentions, pairs).where(F.col("shared") >= least)
    most = mentions.groupBy("id").count().agg(F.max("count").alias("n"))
    w = Window.partitionBy("orphan").orderBy(F.desc("shared"), "peer")
    ranked = ok.select("orphan", "peer", "shared", F.row_number().over(w).alias("k")).where(F.col("k") <= top)
    return ranked.crossJoin(F.broadcast(most)).select("orphan", "peer", "shared", F.round(F.least(F.lit(1.0), F.col("shared") / F.col("n")), 4).alias("score"))  # one row on the right


def schema_gaps(orphans: DataFrame, kinds: DataFrame, mentions: DataFrame, pairs: DataFrame, least: int = 1) -> DataFrame:
    """Orphans that stand with others, of which none may be joined to them. That others stand there is seen from the chunk's number of nodes."""
    crowded = mentions.groupBy(*CHUNK).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select(*CHUNK)
    with_others = mentions.join(orphans, "id", "left_semi").join(crowded, CHUNK, "left_semi").select(F.col("id").alias("orphan")).distinct()
    ok = compatible_cooccurrence(orphans, kinds, mentions, pairs).where(F.col("shared") >= least)
    return with_others.join(ok.select("orphan"), "orphan", "left_anti")


def chunk_groups(orphans: DataFrame, mentions: DataFrame) -> DataFrame:
    """source_file, chunk_index, orphans (sorted, joined by commas), connected: one row per chunk with an orphan."""
    m = mentions.join(orphans.withColumn("o", F.lit(True)), "id", "left")
    g = m.groupBy(*CHUNK).agg(F.array_sort(F.collect_list(F.when(F.col("o"), F.col("id")))).alias("orphans"), F.count_if(F.col("o").isNull()).alias("connected"))
    return g.where(F.size("orphans") > 0).withColumn("orphans", F.array_join("orphans", ","))


def ranked_peers(orphans: DataFrame, kinds: DataFrame, mentions: DataFrame, pairs: DataFrame) -> DataFrame:
    """source_file, chunk_index, peer, hits, rank: the connected nodes of each chunk with orphans, by how many of these they may be joined to, then by id; those of no orphan too.

    Orphans are counted by type before they meet the peers, so a chunk's pairs are never made.
    """
    t = typed(mentions, kinds)
    mine = t.join(orphans, "id", "left_semi").groupBy(*CHUNK, F.col("type").alias("a")).agg(F.count("*").alias("n"))
    for_type = mine.join(pairs.select("a", F.col("b").alias("type")).distinct(), "a").groupBy(*CHUNK, "type").agg(F.sum("n").alias("hits"))
    peers = t.join(orphans, "id", "left_anti").join(mine.select(*CHUNK).distinct(), CHUNK, "left_semi")
    j = peers.join(for_type, [*CHUNK, "type"], "left").select(*CHUNK, F.col("id").alias("peer"), F.coalesce("hits", F.lit(0)).alias("hits"))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy(*CHUNK).orderBy(F.desc("hits"), "peer")))


def unresolvable(orphans: DataFrame, mentions: DataFrame) -> DataFrame:
    return orphans.join(mentions, "id", "left_anti")


def recovered(orphan_names: DataFrame, failed_chunks: DataFrame) -> DataFrame:
    """id, source_file, chunk_index: the first failed chunk (source_file, chunk_index, text) of a node's own files (id, name, source_files) that mentions its name, case ignored."""
    f = orphan_names.select("id", "name", F.explode("source_files").alias("source_file")).join(failed_chunks, "source_file")
    hit = f.where((F.col("name") != "") & F.lower("text").contains(F.lower("name")))
    return hit.groupBy("id").agg(F.min(F.struct(*CHUNK)).alias("c")).select("id", "c.*")


def confirmed(answers: DataFrame, cands: DataFrame, exact: DataFrame, base: float = 0.5, weight: float = 0.5) -> DataFrame:
    """Edges from answers (orphan, peer, type, flipped, confidence) about candidates: type valid for the exact types (orphan, peer, type), confidence times what the score supports."""
    j = answers.join(cands, ["orphan", "peer"]).join(exact, ["orphan", "peer", "type"], "left_semi")
    src, dst = (F.when(F.col("flipped"), F.col(b)).otherwise(F.col(a)) for a, b in (("orphan", "peer"), ("peer", "orphan")))
    return j.select(src.alias("src"), dst.alias("dst"), "type", F.round(F.col("confidence") * F.least(F.lit(1.0), base + weight * F.col("score")), 4).alias("confidence"), F.lit("orphan_inferred").alias("method"))


EDGE_LIST = "array<struct<type:string,`from`:string,`to`:string,confidence:double,rationale:string>>"


def confirmed_groups(groups: DataFrame, answers: DataFrame, properties: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a model's answers say of groups of orphans: (edges, rejections, quality).

    groups: source_file, chunk_index, id, blank (whether the chunk's extraction had come back empty), a row per orphan;
    answers: source_file, chunk_index, answer (JSON). edges: type, src, dst, confidence, method, source_file, chunk_index, of
    the answered ones that are declared and lead between known nodes. rejections: id, source_file, chunk_index, reason: no
    answer (error), no JSON (parse_error), no list (wrong_type), no edge (llm_rejected). quality: id, quality of orphans of blank chunks.
    """
    text = without_fence(F.col("answer"))
    a = answers.groupBy(*CHUNK).agg(F.max("answer").alias("answer")).withColumn("why", F.when(F.try_parse_json(text).isNull(), "parse_error").when(~text.startswith("["), "wrong_type"))
    listed = a.where("why is null").select(*CHUNK, F.inline(F.from_json(text, EDGE_LIST)))
    e = listed.select(*CHUNK, "type", F.col("from").alias("src"), F.col("to").alias("dst"), "confidence").join(properties.select(F.col("name").alias("type")).distinct(), "type", "left_semi")
    ids = nodes.select("id").distinct()
    for end in ("src", "dst"):
        e = e.join(ids.withColumnRenamed("id", end), end, "left_semi")
    e = e.select("type", "src", "dst", F.round(clamp(F.coalesce("confidence", F.lit(0.5))), 4).alias("confidence"), F.lit("orphan_inferred").alias("method"), *CHUNK)
    found = e.select(*CHUNK, F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("found", F.lit(True))
    judged = groups.join(a.select(*CHUNK, "why", F.lit(True).alias("answered")), CHUNK, "left").join(found, [*CHUNK, "id"], "left")
    reason = F.when(F.col("answered").isNull(), "error").otherwise(F.coalesce("why", F.lit("llm_rejected")))
    quality = judged.where("blank and answered and why is null").groupBy("id").agg(F.max("found").alias("f")).select("id", F.when(F.col("f"), "blank_recovered").otherwise("blank_unresolved").alias("quality"))
    return e, judged.where("found is null").select("id", *CHUNK, reason.alias("reason")), quality


def backfilled_attributes(edges: DataFrame, properties: DataFrame) -> DataFrame:
    """type, src, dst, attr, value, confidence: a null of confidence 0 for every attribute that the property of an inferred edge has (name, attributes)."""
    attrs = properties.select(F.col("name").alias("type"), F.explode("attributes").alias("attr")).distinct()
    return edges.select("type", "src", "dst").distinct().join(attrs, "type").select("type", "src", "dst", "attr", F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("confidence"))


def proposed_properties(proposals: DataFrame, concepts: DataFrame) -> DataFrame:
    """The proposed properties (name, domain, range) whose domain and range are concepts."""
    kinds = concepts.select("type").distinct()
    for end in ("domain", "range"):
        proposals = proposals.join(kinds.withColumnRenamed("type", end), end, "left_semi")
    return proposals


def overlay(edges: DataFrame, more: DataFrame) -> DataFrame:
    """edges and those of `more` whose id is new."""
    return edges.unionByName(more.join(edges.select("id"), "id", "left_anti"), allowMissingColumns=True)


def _best(scored: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("name").orderBy(F.desc("score"), *CHUNK)
    return scored.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top).drop("k")


def surgical_chunks(wanted: DataFrame, kinds: DataFrame, mentions: DataFrame, top: int) -> DataFrame:
    """name, source_file, chunk_index, score: for each new property (name, kind) the chunks with most nodes of its kinds. top = 0 selects none."""
    s = mentions.join(kinds, "id").join(wanted.withColumnRenamed("kind", "type"), "type")
    return _best(s.groupBy("name", *CHUNK).agg(F.count("*").alias("score")), top)


def backfill_chunks(wanted: DataFrame, mentions: DataFrame, top: int) -> DataFrame:
    """The same for new concepts (name, prefix of the ids of its parent or siblings)."""
    s = mentions.withColumn("prefix", F.split_part("id", F.lit("-"), F.lit(1))).join(wanted, "prefix")
    return _best(s.groupBy("name", *CHUNK).agg(F.count("*").alias("score")), top)


def todo_chunks(chunks: DataFrame, done: DataFrame, changed: DataFrame) -> DataFrame:
    """The chunks (source_file, chunk_index, ...) still to be extracted: those never done, and all of the files that changed (source_file)."""
    valid = done.select(*CHUNK).distinct().join(changed.select("source_file").distinct(), "source_file", "left_anti")
    return chunks.join(valid, CHUNK, "left_anti")


def hint_lines(hints: DataFrame) -> DataFrame:
    """source_file, chunk_index, line: what a chunk's request says of orphans (id, name, type, property; chunks as source_file, chunk_index) for which the schema has got new properties."""
    props = F.array_join(F.array_sort(F.collect_set("property")), ", ")
    per = hints.groupBy(*CHUNK, "id", "name", "type").agg(props.alias("p"))
    line = F.concat(F.lit("Node: "), "name", F.lit(" (id="), "id", F.lit(", type="), "type", F.lit("); new: "), "p")
    return per.select(*CHUNK, line.alias("line"))


def appended(prior: DataFrame, more: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """Rows of an earlier extraction and of a later one, one for each key: the higher `rank`, of equal ones the earlier. Earlier rows of the same chunk are not taken out."""
    both = prior.withColumn("_late", F.lit(0)).unionByName(more.withColumn("_late", F.lit(1)))
    rest = [c for c in prior.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce(F.col(rank), F.lit(0.0)), -F.col("_late")))
    return both.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*").select(*prior.columns)
