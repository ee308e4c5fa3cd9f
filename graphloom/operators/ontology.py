"""Operators on concepts (session_id, pos, type, parent, attributes) and properties (name, domain, range)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import snake, without_fence
from graphloom.operators.components import connected_components
from graphloom.operators.hierarchy import walks
from graphloom.shared import cut, drop, salted_lookup

SLOT = 64


def ancestors(concepts: DataFrame) -> DataFrame:
    """session_id, type, ancestor: every concept with itself and all above it, parents matched as written. On a loop the walk stops before it would meet a concept again."""
    return walks(concepts, exact=True).select("session_id", "type", F.explode("path").alias("ancestor"))


def parents(concepts: DataFrame) -> DataFrame:
    """session_id, type, parents: the ancestors of every concept, nearest first, as an array."""
    up = F.reverse(F.slice("path", 1, F.size("path") - 1))
    return walks(concepts, exact=True).select("session_id", "type", up.alias("parents"))


def flatten(concepts: DataFrame) -> DataFrame:
    """session_id, type, attributes: those of the root first, down to the concept's own; repeated ones stay. Loops as in ancestors()."""
    own = concepts.where("attributes is not null").groupBy("session_id", "type").agg(F.min_by("attributes", "pos").alias("own"))
    up = walks(concepts, exact=True).select("session_id", "type", F.posexplode("path").alias("k", "ancestor"))
    own = own.select(F.col("session_id").alias("_s"), F.col("type").alias("_a"), "own")
    all_ = up.join(own, F.col("session_id").eqNullSafe(F.col("_s")) & (F.col("ancestor") == F.col("_a")), "left")
    lists = F.transform(F.array_sort(F.collect_list(F.struct("k", "own"))), lambda x: F.coalesce(x.own, F.array().cast("array<string>")))
    return all_.groupBy("session_id", "type").agg(F.flatten(lists).alias("attributes"))


def closure(links: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """type, ancestor of all (type, parent) rows: reflexive and transitive. A type may have several parents; loops do no harm. by: columns, such as session_id, that links don't lead across; rows without them are left out.

    Names are numbered, names that lead to each other folded to one, and only what then lies above what is doubled (ways()). Folded names
    are written out at the end, by slots of SLOT of them on either side, so that no task gets all pairs of a large loop.
    """
    for c in by:
        links = links.where(F.col(c).isNotNull())
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))  # noqa: E731  a type may be null
    rows = cut(links.select(*by, "type", "parent").distinct(), "links")
    own = rows.select(*by, F.col("type").alias("name"), F.lit(True).alias("own"))
    up = rows.where("parent is not null").select(*by, F.col("parent").alias("name"), F.lit(False).alias("own"))
    names = cut(own.unionByName(up).groupBy(*by, "name").agg(F.max("own").alias("own")).withColumn("id", F.monotonically_increasing_id()), "names")
    ids = names.select(*by, key("name").alias("_key"), "id")
    steps = salted_lookup(rows.where("parent is not null").withColumn("_key", key("type")), ids, [*by, "_key"], "inner").select(*by, "parent", F.col("id").alias("a"))
    steps = salted_lookup(steps.withColumn("_key", key("parent")), ids, [*by, "_key"], "inner").select("a", F.col("id").alias("b"))
    roots, pairs = ways(names.select("id"), steps)
    drop(rows)
    slot = F.pmod(F.xxhash64("id"), F.lit(max(1, names.count() // SLOT)))
    slots = cut(names.join(roots, "id").groupBy(*by, "root", slot.alias("slot")).agg(F.collect_list(F.when(F.col("own"), F.struct("name"))).alias("types"), F.collect_list(F.struct("name")).alias("names")), "slots")
    drop(names)
    pairs = pairs.unionByName(slots.select(F.col("root").alias("a"), F.col("root").alias("b")).distinct())
    types = slots.where(F.size("types") > 0).select(*by, F.col("root").alias("a"), "types")
    x = pairs.join(slots.select(F.col("root").alias("b"), "slot"), "b").join(types, "a")
    x = x.repartition(max(8, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "b", "slot")  # a number, as what goes in tells nothing of what comes out
    x = x.join(slots.select(F.col("root").alias("b"), "slot", "names"), ["b", "slot"]).select(*by, F.explode("types").alias("t"), "names")
    return x.select(*by, F.col("t.name").alias("type"), F.explode("names").alias("n")).select(*by, "type", F.col("n.name").alias("ancestor"))


def ways(ids: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """roots (id, root) and pairs (a, b): steps (a, b) lead from root to root by pairs, each once, and ids of the same root lead to each other.

    far holds the ways of 2^k steps, known all shorter than 2^(k+1), so every length is made up in one way only and rounds are the
    logarithm of the longest way. Pairs known in both directions are folded and their ways found anew. The n-th folding waits for k >= n,
    so there are no more foldings than rounds. Ways back to their own start are dropped: any two vertices on a way have one without them.
    """
    roots, steps, folds = ids.select("id", F.col("id").alias("root")), cut(steps.where("a <> b").distinct(), "steps"), 1
    hub = _around_hub(steps)
    if hub is not None:
        roots, steps = _folded(roots, steps, hub)
    while True:
        far, known, k = steps, cut(_both(steps), "known"), 0
        while True:
            loops = known.where("way = 3")
            if k >= folds and not loops.isEmpty():
                break
            ahead = cut(_composed(far, far), "far")
            if far is not steps:
                drop(far)
            far = ahead
            if far.isEmpty():
                if k >= folds or loops.isEmpty():
                    drop(far)
                    drop(steps)
                    return roots, known.select(F.when(F.col("way") == 1, F.col("lo")).otherwise(F.col("hi")).alias("a"), F.when(F.col("way") == 1, F.col("hi")).otherwise(F.col("lo")).alias("b"))
                break
            old = known.where("way in (1, 3)").select(F.col("lo").alias("a"), F.col("hi").alias("b")).unionByName(known.where("way in (2, 3)").select(F.col("hi").alias("a"), F.col("lo").alias("b")))
            more = cut(_both(old.unionByName(far).unionByName(_composed(old, far))), "known")
            drop(known)
            known, k = more, k + 1
        root = connected_components(loops, "lo", "hi").withColumnRenamed("component", "to")
        if far is not steps:
            drop(far)
        old = roots
        roots, steps = _folded(roots, steps, root)
        drop(old)
        drop(known)
        folds += 1


def _folded(roots: DataFrame, steps: DataFrame, root: DataFrame) -> tuple[DataFrame, DataFrame]:
    """roots and steps with every vertex of root (vertex, to) put in its place; the steps given are deleted."""
    after = cut(salted_lookup(roots, root.withColumnRenamed("vertex", "root"), ["root"]).select("id", F.coalesce("to", "root").alias("root")), "roots")
    moved = steps
    for c in ("a", "b"):
        moved = salted_lookup(moved, root.withColumnRenamed("vertex", c), [c]).withColumn(c, F.coalesce("to", c)).drop("to")
    moved = cut(moved.select("a", "b").where("a <> b").distinct(), "steps")
    drop(steps)
    return after, moved


def _around_hub(steps: DataFrame) -> DataFrame | None:
    """vertex, to: what eight steps or fewer lead to and back from the vertex with most ways through it, and that vertex; None if these ways are fewer than the steps are.

    Without it the pairs of a large knot would be found one by one before it is folded; what is farther off is left to ways().
    """
    ends = steps.select(F.col("b").alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(steps.select(F.col("a").alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    top, total = ends.groupBy("v").agg((F.sum("x") * F.sum("y")).alias("n"), F.sum("x").alias("x")).agg(F.max(F.struct("n", "v")), F.sum("x")).first()
    if top is None or top.n <= total:
        return None
    way = F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(True).alias("up"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.lit(False).alias("up"), F.col("a").alias("w")))).alias("s")
    both = steps.select(way).select("s.*")
    seen = steps.sparkSession.createDataFrame([(top.v, True), (top.v, False)], "v long, up boolean")
    new = seen
    for _ in range(8):
        met = both.join(new, ["v", "up"], "left_semi").select(F.col("w").alias("v"), "up").distinct()
        new = cut(met.join(seen, ["v", "up"], "left_anti"), "met")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return cut(seen.groupBy("v").count().where("count = 2").select(F.col("v").alias("vertex"), F.lit(top.v).alias("to")), "hub")


def _both(pairs: DataFrame) -> DataFrame:
    """lo, hi, way of (a, b) rows: 1 from the lower to the higher, 2 the other way, 3 both."""
    return pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.when(F.col("a") < F.col("b"), 1).otherwise(2).alias("way")).groupBy("lo", "hi").agg(F.bit_or("way").alias("way"))


def _composed(first: DataFrame, then: DataFrame) -> DataFrame:
    """a, b of the ways (a, m) of first and (m, b) of then, each once, none back to its start. What leads to a vertex m is dealt to slots of about 1,000, for each of which the rows of then are repeated."""
    many = F.broadcast(first.groupBy(F.col("b").alias("m")).count().where("count > 1000").select("m", F.ceil(F.col("count") / 1000).alias("n")))  # a thousandth of first at most
    left = first.withColumnRenamed("b", "m").join(many, "m", "left").select("m", "a", F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("a"), F.col("n"))).otherwise(F.lit(0)).alias("slot"))
    right = then.withColumnRenamed("a", "m").join(many, "m", "left").select("m", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("n", F.lit(1)) - 1)).alias("slot"))
    return left.join(right, ["m", "slot"]).where("a <> b").select("a", "b").distinct()


def compatible(anc: DataFrame, properties: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """a, b: pairs of types that some property joins, in either direction, through any of their ancestors. by: columns of anc within which they meet."""
    p = properties.select("domain", "range").distinct()
    x = p.join(anc.select(*by, F.col("type").alias("a"), F.col("ancestor").alias("domain")), "domain").join(anc.select(*by, F.col("type").alias("b"), F.col("ancestor").alias("range")), [*by, "range"]).select(*by, "a", "b").distinct()
    return x.unionByName(x.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def history(concepts: DataFrame) -> DataFrame:
    """session_id, added, removed: types that each session has and the one before it has not, and the other way round."""
    s = concepts.select("session_id", "type").distinct()
    order = s.select("session_id").distinct().withColumn("k", F.row_number().over(Window.orderBy("session_id")))  # as many rows as sessions
    p = s.join(F.broadcast(order) if order.count() < 100_000 else order, "session_id").select("type", "k")
    before = p.select("type", (F.col("k") + 1).alias("k"), F.lit(1).alias("old"))
    j = p.withColumn("new", F.lit(1)).join(before, ["type", "k"], "full")
    return j.groupBy("k").agg(F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("new").isNull()).alias("removed")).join(order, "k").select("session_id", "added", "removed")


def merge_proposals(concepts: DataFrame, reserved: tuple[str, ...] = ("relationship",)) -> DataFrame:
    """key, type, sessions, attributes: proposals whose names agree in snake case are one concept, named as first proposed, with the attributes of all in first-seen order."""
    keyed = concepts.select(snake(F.col("type")).alias("key"), "type", "session_id", "pos", F.coalesce("attributes", F.array().cast("array<string>")).alias("attributes")).where(~F.col("key").isin(*reserved))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("session_id", "pos", "attributes"))), lambda x: x.attributes)
    return keyed.groupBy("key").agg(F.min_by("type", F.struct("session_id", "pos")).alias("type"), F.countDistinct("session_id").alias("sessions"), F.array_distinct(F.flatten(lists)).alias("attributes"))


def edge_listing(properties: DataFrame) -> DataFrame:
    """type, outgoing, incoming: what may leave a node of each type and what may reach it, as text for prompts; null where nothing does."""
    one = properties.select(F.col("domain").alias("type"), F.lit("o").alias("way"), "name", F.col("range").alias("other"))
    both = one.unionByName(properties.select(F.col("range").alias("type"), F.lit("i").alias("way"), "name", F.col("domain").alias("other")))
    shown = lambda way, sign: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("way") == way, F.struct("name", "other")))), lambda x: F.concat(x["name"], F.lit(sign), x["other"])), "; "), F.lit(""))
    return both.groupBy("type").agg(shown("o", " -> ").alias("outgoing"), shown("i", " <- ").alias("incoming"))


def cleaned_schema(concepts: DataFrame) -> DataFrame:
    """concepts without those that have no type; missing attributes are an empty list, nulls in the list go."""
    return concepts.where("type is not null").withColumn("attributes", F.filter(F.coalesce("attributes", F.array().cast("array<string>")), lambda a: a.isNotNull()))


SCHEMA_ANSWER = "struct<concepts:array<struct<type:string,parent:string,attributes:array<string>>>>"


def harmonised(concepts: DataFrame, answers: DataFrame) -> DataFrame:
    """session_id, type, parent, attributes: each session's schema as a model rewrote it (session_id, answer), or as it was.

    It stays as it was where there is no answer, where that is no JSON object with concepts, or has none of them, or fewer than half of those before.
    """
    before = cleaned_schema(concepts).select("session_id", "type", "parent", "attributes").dropDuplicates(["session_id", "type"])
    n = before.groupBy("session_id").agg(F.count("*").alias("n"))
    parsed = answers.select("session_id", F.from_json(without_fence(F.col("answer")), SCHEMA_ANSWER).concepts.alias("c")).where("c is not null")
    new = cleaned_schema(parsed.select("session_id", F.inline("c"))).dropDuplicates(["session_id", "type"])
    good = new.groupBy("session_id").agg(F.count("*").alias("m")).join(n, "session_id").where("2 * m >= n").select("session_id")
    return before.join(good, "session_id", "left_anti").unionByName(new.join(good, "session_id", "left_semi").select(before.columns))


def delta(concepts: DataFrame, before: DataFrame) -> DataFrame:
    """type, change: concepts added, removed, or of other parent or attributes than before (altered)."""
    pick = lambda d, n: d.select("type", F.struct("parent", F.array_sort(F.coalesce("attributes", F.array().cast("array<string>"))).alias("a")).alias(n)).dropDuplicates(["type"])
    j = pick(concepts, "new").join(pick(before, "old"), "type", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.to_json("new") != F.to_json("old"), "altered")
    return j.select("type", change.alias("change")).where("change is not null")


def write_delta(concepts: DataFrame, before: DataFrame, path: str, version: str) -> None:
    """Appends delta() to the history at `path` as one version. Written again, a version replaces itself."""
    delta(concepts, before).write.mode("overwrite").parquet(f"{path}/version={version}")


def rendered(tree: DataFrame) -> DataFrame:
    """session_id, type, depth, line, path: an indented line for each concept; sorted by path they read as a tree."""
    return tree.select("session_id", "type", "depth", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), F.col("type")).alias("line"), F.array_join("path", " > ").alias("path"))


def fold_proposals(proposals: list[list[dict]], synonyms: set[tuple[str, str]] = frozenset(), locked: frozenset[str] = frozenset(), reserved: frozenset[str] = frozenset({"relationship"})) -> list[dict]:
    """Concepts of ordered proposals as one schema, with a thesaurus: a proposal joins the first concept whose name is equal, equal in snake case, or a synonym.

    Matching over synonyms is not transitive, so the order counts and the fold is sequential; it runs on the driver over a
    schema, which is small by nature. merge_proposals() is the distributed form without a thesaurus. Attributes are joined in
    first-seen order; a missing parent is filled unless the concept is locked; entries that are no records are skipped.
    """
    import re

    norm = lambda x: re.sub(r"[\s\-_]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", x)).lower()
    out: list[dict] = []
    for proposal in proposals:
        for c in proposal:
            if not isinstance(c, dict) or not isinstance(c.get("type"), str) or c["type"].lower() in reserved:
                continue
            name = c["type"]
            same = next((o for o in out if o["type"] == name or norm(o["type"]) == norm(name) or (norm(o["type"]), norm(name)) in synonyms or (norm(name), norm(o["type"])) in synonyms), None)
            attrs = [a for a in c.get("attributes") or [] if isinstance(a, str)]
            if same is None:
                out.append({"type": name, "parent": c.get("parent"), "attributes": list(dict.fromkeys(attrs))})
            else:
                same["attributes"] = list(dict.fromkeys([*same["attributes"], *attrs]))
                if same["parent"] is None and same["type"] not in locked:
                    same["parent"] = c.get("parent")
    return out
