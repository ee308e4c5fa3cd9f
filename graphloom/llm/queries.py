"""Queries of the operators for training data over the test tables, and SQL where it can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.encode import Ranks, decode_ids, encode_corpus
from graphloom.llm.leaks import leaked_items
from graphloom.llm.names import entities, entity_pairs, name_forms
from graphloom.llm.split import joined_pieces, split_oversized
from graphloom.llm.subjects import subject_shares, train_rules
from graphloom.llm.survivors import COPY_PRIOR, COPY_RATE, DIGITS, FALSE_VALUES, ROUNDS, STAND_INS, by_posterior, by_trust, candidates, surviving_records

#: Where the vocabulary files of public tokenizers are.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(spark.read.parquet(f"{d}/chunks.parquet"), ["source_file", "chunk_index"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).select("source_file", "chunk_index").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p1_joined(spark: SparkSession, d: str) -> DataFrame:
    """Every oversized text put together again from its pieces, and whether all of them are within the limit."""
    whole = joined_pieces(_pieces(spark, d), ["source_file", "chunk_index"])
    return whole.select("source_file", "chunk_index", "text", (F.col("longest") <= 500).alias("within"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark.read.parquet(f"{d}/nodes.parquet"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return by_trust(_candidates(spark, d)).select("id", "attr", "node_key")


def p3_fused(spark: SparkSession, d: str) -> DataFrame:
    return by_posterior(_candidates(spark, d)).withColumn("posterior", F.round("posterior", 6))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    shown = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e.key, F.lit("="), e.value)), "; ")
    return surviving_records(by_trust(_candidates(spark, d))).select("id", shown.alias("attributes"))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return entities(name_forms(spark.read.parquet(f"{d}/nodes.parquet").select("id", "type", "attributes", "aliases")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return entity_pairs(_entities(spark, d))


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    """One row per id: its entity, named by its least id, and the number of ids of that entity. An id whose names say nothing is an entity of its own."""
    every = spark.read.parquet(f"{d}/nodes.parquet").where("id is not null").select("id").distinct()
    of = every.join(_entities(spark, d), "id", "left").withColumn("entity", F.coalesce("entity", F.concat(F.lit("i "), "id")))
    sizes = of.groupBy("entity").agg(F.min("id").alias("entity_id"), F.count("*").alias("ids"))
    return of.join(sizes, "entity").select("id", "entity_id", "ids")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(spark.read.parquet(f"{d}/documents.parquet"), f"{TOKENIZERS}/byte_bpe_50k.json", ["doc_id"])


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text read back from its ids."""
    return p6_ids(spark, d).select("doc_id", decode_ids(F.col("ids"), Ranks(f"{TOKENIZERS}/byte_bpe_50k.json")).alias("text"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """The items that leaked, into how many documents, and the largest share of them found in one."""
    return _leaks(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.max("share"), 6).alias("share"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    docs, labels, areas = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "subject_labels", "subjects"))
    return subject_shares(docs, train_rules(docs, labels, areas))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Of the whole corpus: documents and sentences of each subject."""
    return _subjects(spark, d).groupBy("subject").agg(F.count("*").alias("documents"), F.sum("n").alias("sentences"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_joined, p3_found, p3_fused, p3_records, p5_found, p5_entities, p6_ids, p6_decoded, p7_found, p7_items, p8_found, p8_composition)}

_VALID = "CASE WHEN {0} IS NULL OR isnan({0}) OR {0} < 0 OR {0} > 1 THEN -1 ELSE {0} END"
_BEST = f"""WITH c AS (
  SELECT id, node_key, {_VALID.format("confidence")} AS rc, len(list_distinct(list_filter(source_files, lambda f: trim(f) <> ''))) AS nf, ingested_at, unnest(map_entries(attributes)) AS e
  FROM nodes WHERE id IN (SELECT id FROM nodes GROUP BY id HAVING count(DISTINCT node_key) > 1)),
best AS (
  SELECT id, e.key AS attr, node_key, e.value.value AS value FROM c
  WHERE e.value.value IS NOT NULL AND lower(regexp_replace(e.value.value, '^\\s+|\\s+$', '', 'g')) NOT IN ({", ".join(f"'{x}'" for x in STAND_INS)})
  QUALIFY row_number() OVER (PARTITION BY id, e.key ORDER BY {_VALID.format("e.value.confidence")} DESC, rc DESC, coalesce(nf, 0) DESC, ingested_at DESC NULLS LAST, node_key) = 1)
"""


def _fused() -> str:
    """The fusion as SQL, its rounds one after the other."""
    copy, n = COPY_RATE, FALSE_VALUES
    steps = [
        f"""c0 AS MATERIALIZED (SELECT id, node_key, {_VALID.format("confidence")} AS rc, list_distinct(list_filter(coalesce(source_files, []), lambda f: trim(f) <> '')) AS files, ingested_at, session_id, unnest(map_entries(attributes)) AS e
  FROM nodes WHERE id IN (SELECT id FROM nodes GROUP BY id HAVING count(DISTINCT node_key) > 1))""",
        f"""cand AS MATERIALIZED (SELECT id, e.key AS attr, node_key, e.value.value AS value, lower(regexp_replace(e.value.value, '^\\s+|\\s+$', '', 'g')) AS v, {_VALID.format("e.value.confidence")} AS ac, rc, len(files) AS nf, ingested_at, session_id, files FROM c0
  WHERE e.value.value IS NOT NULL AND lower(regexp_replace(e.value.value, '^\\s+|\\s+$', '', 'g')) NOT IN ({", ".join(f"'{x}'" for x in STAND_INS)}))""",
        "best AS MATERIALIZED (SELECT id, attr, v, value, node_key, ac, rc, nf, ingested_at FROM cand QUALIFY row_number() OVER (PARTITION BY id, attr, v ORDER BY ac DESC, rc DESC, nf DESC, ingested_at DESC NULLS LAST, node_key, value DESC) = 1)",
        "claims AS MATERIALIZED (SELECT id, attr, v, source, max(CASE WHEN ac < 0 THEN 0.5 ELSE greatest(ac, 0.05) END)::DOUBLE AS w FROM (SELECT *, unnest(CASE WHEN len(files) > 0 THEN files ELSE ['session ' || coalesce(session_id, '')] END) AS source FROM cand) GROUP BY ALL)",
        "sizes AS MATERIALIZED (SELECT source, count(*) AS size FROM claims GROUP BY 1)",
    ]
    for k in range(ROUNDS):
        votes = "SELECT *, 0.8::DOUBLE AS a, 0.0::DOUBLE AS dep FROM claims" if k == 0 else f"SELECT c.*, x.a, coalesce(y.dep, 0.0) AS dep FROM claims c JOIN acc{k - 1} x USING (source) LEFT JOIN cop{k - 1} y USING (id, attr, v, source)"
        steps += [
            f"val{k} AS MATERIALIZED (SELECT id, attr, v, sum(w * ln({n} * a / (1 - a)) * (1 - {copy}::DOUBLE * dep)) AS score, count(*) AS n_sources FROM ({votes}) GROUP BY 1, 2, 3)",
            f"top{k} AS MATERIALIZED (SELECT id, attr, max(score) AS top, count(*) AS k FROM val{k} GROUP BY 1, 2)",
            f"z{k} AS MATERIALIZED (SELECT id, attr, sum(exp(score - top)) + greatest({n + 1} - max(k), 0) * exp(-max(top)) AS z FROM val{k} JOIN top{k} USING (id, attr) GROUP BY 1, 2)",
            f"pos{k} AS MATERIALIZED (SELECT id, attr, v, n_sources, exp(score - top) / z AS p FROM val{k} JOIN top{k} USING (id, attr) JOIN z{k} USING (id, attr))",
        ]
        if k + 1 < ROUNDS:
            steps += [
                f"jud{k} AS MATERIALIZED (SELECT id, attr, v, source, p FROM claims JOIN pos{k} USING (id, attr, v))",
                f"acc{k} AS MATERIALIZED (SELECT source, greatest(0.05, least(0.95, round((sum(p) + 4 * 0.8) / (count(*) + 4), {DIGITS})))::DOUBLE AS a FROM jud{k} GROUP BY 1)",
                f"pr{k} AS MATERIALIZED (SELECT CASE WHEN sa.size <= sb.size THEN a ELSE b END AS one, CASE WHEN sa.size <= sb.size THEN b ELSE a END AS two, f FROM (SELECT x.source AS a, y.source AS b, count(*) AS f FROM jud{k} x JOIN jud{k} y USING (id, attr, v) WHERE x.p < 0.5 AND y.p < 0.5 AND x.source < y.source GROUP BY 1, 2) JOIN sizes sa ON sa.source = a JOIN sizes sb ON sb.source = b)",
                f"pc{k} AS MATERIALIZED (SELECT one, two, f, x.id, x.attr, x.v, x.p, x.v = y.v AS same FROM pr{k} JOIN jud{k} x ON x.source = one JOIN jud{k} y ON y.source = two AND y.id = x.id AND y.attr = x.attr)",
                f"""at{k} AS MATERIALIZED (SELECT one, two, id, attr, max(f) AS f, bool_or(same) AS same, count(*) FILTER (WHERE same AND p >= 0.5) AS t,
  sum(CASE WHEN same AND p < 0.5 THEN ln(({copy}::DOUBLE * (0.8 * p + 0.2 * (1 - p)) + (1 - {copy}::DOUBLE) * (0.64::DOUBLE * p + 0.04::DOUBLE / {n} * (1 - p))) / (0.64::DOUBLE * p + 0.04::DOUBLE / {n} * (1 - p))) ELSE 0.0 END) AS fl FROM pc{k} GROUP BY 1, 2, 3, 4)""",
                f"dep{k} AS MATERIALIZED (SELECT one, two, 1 / (1 + exp(-(ln({COPY_PRIOR}::DOUBLE / (1 - {COPY_PRIOR}::DOUBLE)) + sum(fl) + least(sum(t), 2 * max(f)) * ln(({copy}::DOUBLE * 0.8 + (1 - {copy}::DOUBLE) * 0.64) / 0.64) + count(*) FILTER (WHERE NOT same) * ln(1 - {copy}::DOUBLE)))) AS dep FROM at{k} GROUP BY 1, 2)",
                f"cop{k} AS MATERIALIZED (SELECT id, attr, v, CASE WHEN (x.a, x.source) < (y.a, y.source) THEN one ELSE two END AS source, max(dep) AS dep FROM pc{k} JOIN dep{k} USING (one, two) JOIN acc{k} x ON x.source = one JOIN acc{k} y ON y.source = two WHERE same GROUP BY 1, 2, 3, 4)",
            ]
    last = ROUNDS - 1
    return "WITH " + ",\n".join(steps) + f"""
SELECT id, attr, value, round(p, 6) AS posterior, n_sources, node_key FROM pos{last} JOIN best USING (id, attr, v) QUALIFY row_number() OVER (PARTITION BY id, attr ORDER BY round(p, {DIGITS}) DESC, ac DESC, rc DESC, nf DESC, ingested_at DESC NULLS LAST, node_key, value DESC) = 1"""


SQL = {
    "p3_fused": _fused(),
    "p1_found": r"SELECT DISTINCT source_file, chunk_index FROM chunks WHERE len(regexp_extract_all(text, '[0-9A-Za-z_]+|[^ \t\n\r0-9A-Za-z_]')) > 500",
    "p1_joined": r"SELECT DISTINCT source_file, chunk_index, text, true AS within FROM chunks WHERE len(regexp_extract_all(text, '[0-9A-Za-z_]+|[^ \t\n\r0-9A-Za-z_]')) > 500",
    "p3_found": _BEST + "SELECT id, attr, node_key FROM best",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p3_records": _BEST + "SELECT id, string_agg(attr || '=' || value, '; ' ORDER BY attr) AS attributes FROM best GROUP BY id",
}
