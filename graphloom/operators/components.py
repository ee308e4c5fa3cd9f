"""Connected components by least labels of neighbours and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.shared import cut, drop, salted_lookup


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """vertex, component (the least vertex of its component) of an undirected graph; vertices without edges don't occur.

    Each round takes the least label among neighbours (aggregated on both sides of the shuffle, so hubs don't hurt), then
    the label's own label, which shortens long paths by half; rows of hot labels are salted in that join. Rounds end
    when no label changes. Null ends are left out; repeated edges and self-loops do no harm.
    """
    e = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null")
    e = cut(e.union(e.select("u", "v")).distinct(), "edges")
    label = cut(e.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("label")), "label")
    while True:
        near = salted_lookup(e, label.withColumnRenamed("v", "u"), ["u"], "inner").groupBy("v").agg(F.min("label").alias("m"))
        least = cut(label.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "m").alias("label")), "least")
        own = least.select(F.col("v").alias("label"), F.col("label").alias("next"))
        after = cut(salted_lookup(least, own, ["label"]).select("v", "old", F.coalesce("next", "label").alias("label")), "after")
        changed = not after.where("old <> label").isEmpty()
        drop(least)
        drop(label)
        label = after.select("v", "label")
        label._graphloom_path = after._graphloom_path
        if not changed:
            drop(e)
            return label.select(F.col("v").alias("vertex"), F.col("label").alias("component"))
