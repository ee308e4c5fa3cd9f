"""Parent-child rows to full hierarchies, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.shared import blank_to_null, cut, drop, salted_lookup

CYCLE = "(cycle)"


def links(rows: DataFrame, space: str = "session_id", name: str = "type", parent: str = "parent", exact: bool = False) -> DataFrame:
    """One row per concept: _space, _key, _name, _parent (the key of its parent, null for a root).

    Names match within their space, ignoring case and surrounding white space, or exact as written. Rows whose name is null are no concepts.
    Of repeated keys the row least by (name as written, parent) counts, nulls last. A null space is a space of its own.
    """
    key, up = (F.col(name), F.col(parent)) if exact else (F.lower(blank_to_null(F.col(name))), F.lower(blank_to_null(F.col(parent))))
    one = (
        rows.select(F.col(space).alias("_space"), F.coalesce(key, F.lit("")).alias("_key"), F.col(name).alias("_name"), up.alias("_up"))
        .where(F.col("_name").isNotNull())
        .groupBy("_space", "_key")
        .agg(F.min(F.struct("_name", F.col("_up").isNull().alias("n"), "_up")).alias("m"))
        .select(F.coalesce("_space", F.lit("")).alias("_space"), F.col("_space").isNull().alias("_nospace"), "_key", F.col("m._name").alias("_name"), F.col("m._up").alias("_up"))
    )
    return one


def hierarchy(rows: DataFrame, space: str = "session_id", name: str = "type", parent: str = "parent", paths: bool = True, exact: bool = False) -> DataFrame:
    """Path, depth and root of every concept. Names are matched as links() does.

    Returns space, name, root, depth and, with paths, path (names from the root down, as an array).
    A concept whose parent is null, blank or unknown in its space is a root: depth 0, its own root.
    A concept on a loop or below one gets root '(cycle)', depth -1 and a null path. An empty table gives no rows.

    Each round joins every unfinished pointer to the row it points at, so the distance covered doubles. Depths have no
    gaps: a round that finishes no row proves that the rows left hang on loops, so there are log2(depth) + 2 rounds.
    Finished rows leave the join; hot parents are salted; each round is cut in the shared folder.
    """
    one = cut(links(rows, space, name, parent, exact), "links")
    key = ["_space", "_nospace", "_key"]
    known = one.select("_space", "_nospace", F.col("_key").alias("_up"), F.lit(True).alias("_known"))
    start = salted_lookup(one, known, ["_space", "_nospace", "_up"])
    seg = F.array("_name") if paths else F.lit(None).cast("array<string>")
    start = start.select(*key, "_name", F.when(F.col("_known"), F.col("_up")).alias("_ptr"), seg.alias("_seg"))
    start = start.withColumn("_dist", F.when(F.col("_ptr").isNull(), 0).otherwise(1)).withColumn("_root", F.when(F.col("_ptr").isNull(), F.col("_name")))
    start = cut(start, "start")
    drop(one)
    done = [start.where("_ptr is null").select(*key, "_name", "_root", "_dist", "_seg")]
    active, old = start.where("_ptr is not null"), None
    while True:
        table = active.select(*key, F.col("_ptr").alias("_p2"), F.col("_dist").alias("_d2"), F.col("_seg").alias("_s2"), F.lit(None).cast("string").alias("_r2"))
        for d in done:
            table = table.unionByName(d.select(*key, F.lit(None).cast("string").alias("_p2"), F.col("_dist").alias("_d2"), F.col("_seg").alias("_s2"), F.col("_root").alias("_r2")))
        table = table.withColumnRenamed("_key", "_ptr")
        moved = salted_lookup(active, table, ["_space", "_nospace", "_ptr"], "inner").select(
            *key, "_name", F.col("_p2").alias("_ptr"), F.concat("_seg", "_s2").alias("_seg"), (F.col("_dist") + F.col("_d2")).alias("_dist"), F.col("_r2").alias("_root")
        )
        moved = cut(moved, "round")
        finished = moved.where("_root is not null").select(*key, "_name", "_root", "_dist", "_seg")
        rest = moved.where("_root is null")
        drop(old)
        any_finished, any_left = (n > 0 for n in moved.agg(F.count("_root"), F.count_if(F.col("_root").isNull())).first())
        done.append(finished)
        if not any_finished or not any_left:
            break
        old, active = None, rest
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    path = F.reverse("_seg")
    out = out.select(*key, "_name", "_root", F.col("_dist").alias("_depth"), path.alias("_path"))
    lost = rest.select(*key, "_name", F.lit(CYCLE).alias("_root"), F.lit(-1).alias("_depth"), F.lit(None).cast("array<string>").alias("_path"))
    out = out.unionByName(lost)
    cols = [F.when(~F.col("_nospace"), F.col("_space")).alias(space), F.col("_name").alias(name), F.col("_root").alias("root"), F.col("_depth").cast("int").alias("depth")]
    return out.select(*cols, *([F.col("_path").alias("path")] if paths else []))


def walks(rows: DataFrame, space: str = "session_id", name: str = "type", parent: str = "parent", exact: bool = False) -> DataFrame:
    """space, name, path: every concept's way up, from the root down; a way that runs into a loop ends before the first concept it would meet again.

    What hierarchy() leaves on loops is doubled on among itself until every way repeats a concept: its different concepts, in order, are the walk.
    """
    tree = cut(hierarchy(rows, space, name, parent, exact=exact), "tree")
    whole, lost = tree.where("depth >= 0").select(space, name, "path"), tree.where("depth < 0").select(F.col(space).alias("_s"), F.col(name).alias("_n"))
    if lost.isEmpty():
        return whole
    on = links(rows, space, name, parent, exact).withColumn("_s", F.when(~F.col("_nospace"), F.col("_space")))
    on = on.join(lost, on["_s"].eqNullSafe(lost["_s"]) & (on["_name"] == lost["_n"]), "left_semi").select("_space", "_nospace", "_key", "_name", "_up")
    now = cut(on.select("_space", "_nospace", "_key", F.col("_up").alias("_ptr"), F.array("_name").alias("_seg")), "loops")
    while True:
        table = now.select("_space", "_nospace", F.col("_key").alias("_ptr"), F.col("_ptr").alias("_p2"), F.col("_seg").alias("_s2"))
        after = cut(salted_lookup(now, table, ["_space", "_nospace", "_ptr"], "inner").select("_space", "_nospace", "_key", F.col("_p2").alias("_ptr"), F.concat("_seg", "_s2").alias("_seg")), "loops")
        drop(now)
        now = after
        if now.where(F.size(F.array_distinct("_seg")) == F.size("_seg")).isEmpty():
            break
    path = F.array_distinct("_seg")
    rest = now.select(F.when(~F.col("_nospace"), F.col("_space")).alias(space), F.get(path, F.lit(0)).alias(name), F.reverse(path).alias("path"))
    return whole.unionByName(rest)


def descendants(tree: DataFrame, space: str = "session_id", name: str = "type") -> DataFrame:
    """All (ancestor, descendant, distance) pairs of a hierarchy() with paths; every finished concept is its own at distance 0."""
    e = tree.where("depth >= 0").select(space, F.col(name).alias("descendant"), F.col("depth"), F.posexplode("path").alias("pos", "ancestor"))
    return e.select(space, "ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))
