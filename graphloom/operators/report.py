"""Aggregates of run logs and call logs for the run's report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import clamp, duration, seconds_of


def first_match(text: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """The name of the first rule (pattern, name) that a text matches."""
    out = None
    for pattern, name in rules:
        out = (F.when if out is None else out.when)(text.rlike(pattern), name)
    return out.otherwise(other) if out is not None else F.lit(other)


def call_statistics(calls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """stage, calls, tokens, seconds of calls (context, total_tokens, duration_s), and the grand total with a null stage."""
    c = calls.withColumn("stage", first_match(F.col("context"), rules))
    return c.rollup("stage").agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens"), F.round(F.sum("duration_s"), 3).alias("seconds"))


def timeline(log: DataFrame, run: str = "RUN", done: str = "DONE") -> DataFrame:
    """step, started, took: from the last RUN line of each step to its DONE line; runs over midnight wrap. log: clock, message ('RUN step' or 'DONE step')."""
    m = log.select(seconds_of(F.col("clock")).alias("s"), F.col("pos"), F.regexp_extract("message", rf"^({run}|{done}) (\S+)$", 1).alias("what"), F.regexp_extract("message", rf"^({run}|{done}) (\S+)$", 2).alias("step")).where("step <> ''")
    w = Window.partitionBy("step").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    d = m.withColumn("began", F.last(F.when(F.col("what") == run, F.col("s")), ignorenulls=True).over(w)).where(F.col("what") == done)
    last = d.groupBy("step").agg(F.max_by(F.struct("began", "s"), "pos").alias("x"))
    took = F.pmod(F.col("x.s") - F.col("x.began"), F.lit(86400))
    return last.select("step", F.col("x.began").alias("started"), duration(took).alias("took"))


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def run_report(records: DataFrame, nodes: DataFrame, edges: DataFrame, edge_records: DataFrame, strong: DataFrame, concepts: DataFrame, calls: DataFrame) -> DataFrame:
    """section, item, n: the figures of a run's report, in eleven sections.

    records and edge_records are what was extracted, nodes and edges the graph made of it, strong the edges that keep a node
    from being isolated, calls (stage) the requests to a model. Every figure is one aggregate.
    """
    c = clamp(F.col("confidence"))
    level = F.when(c >= 0.9, "0.9").when(c >= 0.7, "0.7").when(c >= 0.5, "0.5").otherwise("0.0")
    per = records.where("id is not null").groupBy("id").agg(F.countDistinct("node_key").alias("k"))
    ends = strong.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    parts = [
        ("summary", nodes.select(F.lit("nodes").alias("item"))), ("summary", edges.select(F.lit("edges").alias("item"))), ("summary", records.select(F.lit("records").alias("item"))),
        ("types", nodes.select(F.col("type").alias("item"))), ("edge types", edges.select(F.col("type").alias("item"))), ("methods", edge_records.select(F.col("method").alias("item"))),
        ("confidence", records.select(level.alias("item"))), ("merged", per.select(F.when(F.col("k") > 1, "several records").otherwise("one record").alias("item"))),
        ("isolated", nodes.join(ends, "id", "left_anti").select(F.col("type").alias("item"))),
        ("sources", records.where("id is not null").select(F.explode("source_files").alias("f")).distinct().select(F.lit("files").alias("item"))),
        ("sessions", records.select(F.col("session_id").alias("item"))), ("calls", calls.select(F.col("stage").alias("item"))),
        ("schema", concepts.where("type is not null").select("type").distinct().select(F.lit("concepts").alias("item"))), ("schema", edge_records.select("type").distinct().select(F.lit("properties").alias("item"))),
    ]
    return reduce(DataFrame.unionByName, [rows.groupBy("item").agg(F.count("*").alias("n")).select(F.lit(s).alias("section"), "item", "n") for s, rows in parts])


def rendered_report(figures: DataFrame) -> DataFrame:
    """section, line: run_report() as Markdown, most first within a section."""
    w = Window.partitionBy("section").orderBy(F.desc("n"), "item")
    return figures.select("section", F.row_number().over(w).alias("k"), F.concat(F.lit("- "), F.coalesce("item", F.lit("(none)")), F.lit(": "), F.col("n").cast("string")).alias("line")).orderBy("section", "k").select("section", "line")
