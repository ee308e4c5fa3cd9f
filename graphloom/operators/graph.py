"""Queries on a graph: search, neighbours, paths, subgraphs, context, hubs, statistics, sources.

A graph is nodes (id, type, name, confidence, ...) and edges (id, type, src, dst, confidence, ...). Loops over frontiers
cut the simple graph once and each round in the shared folder. Where a hub's edges meet a frontier, or the ends of edges a
table of nodes, AQE splits the hub's partition: these are inner, left and semi joins that probe with the edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.shared import cut, drop


def search(names: DataFrame, attributes: DataFrame, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """id, score: 100 for an equal name or alias, 80 for a prefix, 60 for a part; 40 for part of an attribute of nodes without such a name.

    names: id, type, name (one row per name or alias); attributes: id, type, value. Highest scores first, then ids; each id once.
    """
    q = query.lower()
    if kind is not None:
        names, attributes = names.where(F.col("type") == kind), attributes.where(F.col("type") == kind)
    low = F.lower("name")
    score = F.when(low == q, 100).when(low.startswith(q), 80).when(low.contains(q), 60)
    hit = names.withColumn("score", score).where("score is not null").groupBy("id").agg(F.max("score").alias("score"))
    part = attributes.where(F.lower("value").contains(q)).select("id").distinct().join(hit, "id", "left_anti").withColumn("score", F.lit(40))
    return hit.unionByName(part).orderBy(F.desc("score"), "id").limit(limit)


def incident(edges: DataFrame) -> DataFrame:
    """Every edge from both its ends: edge_id, type, id, other, outgoing. A self-loop stands twice."""
    out = edges.select(F.col("id").alias("edge_id"), "type", F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(True).alias("outgoing"))
    return out.unionByName(edges.select(F.col("id").alias("edge_id"), "type", F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(False).alias("outgoing")))


def neighbours(edges: DataFrame, node: str, direction: str = "both", kind: str | None = None, limit: int | None = 50) -> DataFrame:
    """edge_id, type, other of the edges at a node, at most `limit` by (outgoing first, edge_id); filters reach the scan."""
    wanted = {"outgoing": [("src", "dst", True)], "incoming": [("dst", "src", False)], "both": [("src", "dst", True), ("dst", "src", False)]}[direction]
    parts = [edges.where(F.col(a) == node).select(F.col("id").alias("edge_id"), "type", F.col(b).alias("other"), F.lit(o).alias("outgoing")) for a, b, o in wanted]
    e = reduce(DataFrame.unionByName, parts)
    if kind is not None:
        e = e.where(F.col("type") == kind)
    return e.orderBy(F.desc("outgoing"), "edge_id").limit(limit) if limit else e


def subgraph(nodes: DataFrame, edges: DataFrame, ids: list[str] | None = None, types: list[str] | None = None, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Nodes that pass all filters, and the edges with both ends among them."""
    n = nodes.where(F.col("confidence") >= least)
    if ids is not None:
        n = n.where(F.col("id").isin(ids))
    if types is not None:
        n = n.where(F.col("type").isin(types))
    k = n.select("id").distinct()
    return n, edges.join(k.withColumnRenamed("id", "src"), "src", "left_semi").join(k.withColumnRenamed("id", "dst"), "dst", "left_semi")


def simple_edges(edges: DataFrame) -> DataFrame:
    return edges.where("src is not null and dst is not null").select("src", "dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """id, outgoing, incoming, degree. A self-loop counts on both sides. Aggregated on both sides of the shuffle."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    e = edges.select(ends.alias("e")).select("e.*").where("id is not null")
    return e.groupBy("id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"), F.count("*").alias("degree"))


def hubs(edges: DataFrame, top: int = 10) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(top)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at which no edge stands."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct()
    return nodes.join(ends, "id", "left_anti")


def type_counts(nodes: DataFrame, samples: int = 3) -> DataFrame:
    """type, n, samples: nodes of each type and the least of their ids. No group is collected: the window keeps its first rows only."""
    n = nodes.groupBy("type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("type").orderBy("id")
    first = nodes.select("type", "id", F.row_number().over(w).alias("k")).where(F.col("k") <= samples)
    few = first.groupBy("type").agg(F.array_sort(F.collect_list("id")).alias("samples"))
    return n.join(few, n["type"].eqNullSafe(few["type"]), "left").select(n["type"], "n", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def neighbour_summaries(near: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, type, name of the different nodes among neighbours(); ends that are no nodes have neither type nor name."""
    return near.select(F.col("other").alias("id")).distinct().join(nodes.select("id", "type", "name"), "id", "left")


def statistics(nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, density, components, mean_degree and loops of the simple directed graph; ends of edges that are no nodes count as nodes.

    Also types, the nodes of each type as text, most first; and source_files, the different source_file of files.
    """
    spark = nodes.sparkSession
    simple = cut(simple_edges(edges), "simple")
    loops = simple.where("src = dst").count()
    ids = cut(nodes.select("id").union(simple.select("src")).union(simple.select("dst")).distinct(), "ids")
    n, m = ids.count(), simple.count()
    comp = connected_components(simple, "src", "dst")
    c = comp.select("component").distinct().count() + n - comp.count()
    kinds = nodes.groupBy("type").count().orderBy(F.desc("count"), "type").collect()  # one row per type
    count = files.select("source_file").distinct().count() if files is not None else None
    for d in (simple, ids, comp):
        drop(d)
    row = (n, m, round(m / (n * (n - 1)), 6) if n > 1 else 0.0, c, round((2 * m) / n, 2) if n else 0.0, loops, "; ".join(f"{r['type']}={r['count']}" for r in kinds), count)
    return spark.createDataFrame([row], "nodes long, edges long, density double, components long, mean_degree double, loops long, types string, source_files long")


def within(edges: DataFrame, seeds: DataFrame, depth: int, directed: bool = False, kinds: list[str] | None = None) -> DataFrame:
    """seed, id, hop: every vertex within `depth` steps of each seed (column id), at its least number of steps."""
    if kinds is not None:
        edges = edges.where(F.col("type").isin(kinds))
    e = simple_edges(edges)
    e = cut(e if directed else e.union(e.select("dst", "src")).distinct(), "simple")
    seen = cut(seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("hop", F.lit(0)), "seen")
    front = seen
    for hop in range(1, depth + 1):
        step = e.withColumnRenamed("src", "id").join(front, "id").select("seed", F.col("dst").alias("id")).distinct()
        front = cut(step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    drop(e)
    return seen


def both_ways(edges: DataFrame) -> DataFrame:
    """edge_id, type, confidence, src, dst, at, other: every edge from both its ends."""
    e = edges.select(F.col("id").alias("edge_id"), "type", "confidence", "src", "dst")
    return e.withColumns({"at": F.col("src"), "other": F.col("dst")}).unionByName(e.withColumns({"at": F.col("dst"), "other": F.col("src")}))


def tree_edges(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """seed, id, hop, parent, edge_id, type, src, dst, confidence: of each vertex that within() reached its least neighbour one step nearer, and the first edge between them in either direction."""
    e = both_ways(edges)
    near = reached.select("seed", F.col("id").alias("at"), (F.col("hop") + 1).alias("hop"))
    first = F.min(F.struct("at", "edge_id", "type", "src", "dst", "confidence"))
    t = e.join(near, "at").withColumnRenamed("other", "id").join(reached, ["seed", "id", "hop"], "left_semi").groupBy("seed", "id", "hop").agg(first.alias("m"))
    return t.select("seed", "id", "hop", F.col("m.at").alias("parent"), "m.edge_id", "m.type", "m.src", "m.dst", "m.confidence")


def fitted(lines: list[str], used: int, budget: int) -> tuple[list[str], int]:
    """The lines up to the first that passes a budget of characters, a note after that one, and the characters used."""
    out = []
    for line in lines:
        out.append(line)
        used += len(line)
        if used > budget:
            out.append("... (cut at the budget)")
            return out, used + len(out[-1])
    return out, used


def context_text(nodes: DataFrame, attributes: DataFrame, edges: DataFrame, seeds: list[str], question: str, mode: str = "bfs", depth: int = 2, budget: int = 2000) -> DataFrame:
    """pos, line: what a graph says on a question, in at most about `budget` tokens of four characters.

    From each seed a breadth-first or depth-first tree is walked over the undirected graph; nodes follow by (hop, id) - in
    depth-first order with mode dfs - then the trees' edges, each once. Only as many rows come to the driver as can fit:
    no line is shorter than ten characters.
    """
    spark = nodes.sparkSession
    room, most = 4 * budget, 4 * budget // 10 + 1
    if not seeds:
        return spark.createDataFrame([(0, f"No nodes found for '{question}'.")], "pos int, line string")
    if mode == "dfs":
        rows = [(s, v, k, p) for s in seeds for k, (v, p) in enumerate(depth_first_tree(edges, s, depth))]
        walked = spark.createDataFrame(rows, "seed string, id string, hop int, parent string")
        e = both_ways(edges).select(F.col("at").alias("parent"), F.col("other").alias("id"), F.struct("edge_id", "type", "src", "dst", "confidence").alias("e"))
        trees = e.join(walked.where("parent is not null"), ["parent", "id"]).groupBy("seed", "id", "hop").agg(F.min("e").alias("e")).select("seed", "id", "hop", "e.*")
    else:
        walked = within(edges, spark.createDataFrame([(s,) for s in seeds], "id string"), depth)
        trees = tree_edges(edges, walked)
    trees = cut(trees, "trees")
    order = walked.groupBy("id").agg(F.min("hop").alias("hop"))
    extra = attributes.where("value <> '' and attr <> 'name'").groupBy("id", "attr").agg(F.max("value").alias("value")).groupBy("id").agg(F.array_sort(F.collect_list(F.concat("attr", F.lit("="), "value"))).alias("x"))
    shown = order.join(nodes, "id").join(extra, "id", "left")
    more = F.when(F.size("x") > 0, F.concat(F.lit(" ("), F.array_join("x", ", "), F.lit(")"))).otherwise("")
    name = F.coalesce(F.nullif("name", F.lit("")), F.col("id"))
    line = F.concat(F.lit("- ["), F.coalesce("type", F.lit("")), F.lit("] "), name, F.lit(" ("), "id", F.lit(") conf="), F.format_string("%.2f", F.coalesce("confidence", F.lit(0.0))), more)
    head = [f"# Context: {question}", f"Seeds: {', '.join(seeds)} | Mode: {mode} | Depth: {depth}", f"Nodes: {order.count()} | Edges: {trees.count()}", "", "## Nodes"]
    body, used = fitted([r[0] for r in shown.orderBy("hop", "id").select(line).limit(most).collect()], sum(map(len, head)), room)
    lines = head + body
    if used < room:
        place = F.element_at(F.create_map(*[F.lit(x) for k, s in enumerate(seeds) for x in (s, k)]), F.col("seed"))
        link = F.concat(F.lit("- "), "src", F.lit(" --["), "type", F.lit("]--> "), "dst", F.lit(" (conf="), F.format_string("%.2f", F.coalesce("confidence", F.lit(0.0))), F.lit(")"))
        each = trees.groupBy("edge_id").agg(F.min(F.struct(place.alias("p"), "hop", "id")).alias("o"), F.min(link).alias("line"))
        title = ["", "## Relationships"]
        lines += title + fitted([r[0] for r in each.orderBy("o", "edge_id").select("line").limit(most).collect()], used + sum(map(len, title)), room)[0]
    drop(trees)
    return spark.createDataFrame(list(enumerate(lines)), "pos int, line string")


def context_seeds(names: DataFrame, attributes: DataFrame, question: str, most: int = 3) -> DataFrame:
    """id, score of the first nodes that a question is about: 100 for an equal name, 60 where either holds the other, 40 for an attribute. Empty names match nothing."""
    q = question.lower()
    low = F.lower("name")
    hit = names.where("name <> ''").withColumn("score", F.when(low == q, 100).when(low.contains(q) | F.lit(q).contains(low), 60)).where("score is not null").groupBy("id").agg(F.max("score").alias("score"))
    part = attributes.where(F.lower("value").contains(q)).select("id").distinct().join(hit, "id", "left_anti").withColumn("score", F.lit(40))
    return hit.unionByName(part).orderBy(F.desc("score"), "id").limit(most)


def depth_first_tree(edges: DataFrame, seed: str, depth: int) -> list[tuple[str, str | None]]:
    """(vertex, parent) in depth-first order, at most `depth` steps deep, neighbours by their ids. Sequential by nature, so it runs on the driver, over the edges within `depth` steps only."""
    reached = within(edges, edges.sparkSession.createDataFrame([(seed,)], "id string"), depth).select("id").distinct()
    near = cut(reached, "near")
    e = simple_edges(edges)
    e = e.union(e.select("dst", "src")).distinct().join(near.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi")
    nxt: dict[str, list[str]] = {}
    for r in e.orderBy("src", "dst").toLocalIterator():
        nxt.setdefault(r[0], []).append(r[1])
    drop(near)
    seen, order, stack = {seed}, [(seed, None)], [(seed, iter(nxt.get(seed, ())))]
    while stack:
        at, rest = stack[-1]
        v = next((x for x in rest if x not in seen), None)
        if v is None:
            stack.pop()
            continue
        seen.add(v)
        order.append((v, at))
        if len(stack) < depth:
            stack.append((v, iter(nxt.get(v, ()))))
    return order


def depth_first(edges: DataFrame, seed: str, depth: int) -> list[str]:
    """The vertices of depth_first_tree()."""
    return [v for v, _ in depth_first_tree(edges, seed, depth)]


def shortest_path(edges: DataFrame, source: str, target: str, most: int = 5) -> DataFrame:
    """hop, id of one shortest path: along the edges' direction if there is such a path, else against it too; none if it has more than `most` steps. Of equal parents the least id.

    Where a directed path exists, however long, no undirected one is tried: so the directed search goes on beyond `most`.
    """
    spark = edges.sparkSession
    for both in (False, True):
        e = simple_edges(edges)
        e = cut(e.union(e.select("dst", "src")).distinct() if both else e, "simple")
        start = spark.createDataFrame([(source, None, 0)], "id string, parent string, hop int")
        front, fronts, found = start, [start], source == target
        while not found and not (both and len(fronts) > most):
            step = e.withColumnRenamed("src", "at").join(front.select(F.col("id").alias("at"), "hop"), "at").groupBy(F.col("dst").alias("id")).agg(F.min("at").alias("parent"), (F.max("hop") + 1).alias("hop"))
            seen = reduce(DataFrame.unionByName, [f.select("id") for f in fronts])
            front = cut(step.join(seen, "id", "left_anti"), "path")
            if front.isEmpty():
                break
            fronts.append(front)
            found = not front.where(F.col("id") == target).isEmpty()
        drop(e)
        if found:
            break
    path, at = [], target if found and len(fronts) <= most + 1 else None
    for hop in range(len(fronts) - 1, -1, -1):
        if at is not None:
            path.append((hop, at))
            at = fronts[hop].where(F.col("id") == at).first()["parent"]
    for f in fronts[1:]:
        drop(f)
    return spark.createDataFrame(sorted(path), "hop int, id string")


def path_edges(path: DataFrame, edges: DataFrame) -> DataFrame:
    """hop, src, dst, edge_id, type of every step of shortest_path(): the first edge between the two in either direction."""
    step = path.select((F.col("hop") + 1).alias("hop"), F.col("id").alias("at")).join(path.select("hop", F.col("id").alias("other")), "hop")
    return both_ways(edges).join(F.broadcast(step), ["at", "other"]).groupBy("hop").agg(F.min(F.struct("edge_id", "type", "src", "dst")).alias("m")).select("hop", "m.*")  # a path has few steps


def source_chunks(mentions: DataFrame, src: str, dst: str, most: int | None = 3) -> DataFrame:
    """source_file, chunk_index, exact: chunks both ends of an edge stand in, in the first end's order; where there are none, those of either."""
    m = mentions.where(F.col("id").isin(src, dst)).select("source_file", "chunk_index", (F.col("id") == src).alias("s"), (F.col("id") == dst).alias("d"))
    g = m.groupBy("source_file", "chunk_index").agg(F.max("s").alias("s"), F.max("d").alias("d")).withColumn("exact", F.col("s") & F.col("d"))
    best = g.crossJoin(F.broadcast(g.agg(F.max("exact").alias("any"))))  # one row
    best = best.where((F.col("exact") == F.col("any"))).orderBy(F.desc("s"), "source_file", "chunk_index")
    return (best.limit(most) if most else best).select("source_file", "chunk_index", "exact")


def source_excerpts(mentions: DataFrame, chunks: DataFrame, names: DataFrame, node: str | None = None, edge: tuple[str, str] | None = None, most: int = 3) -> DataFrame:
    """source_file, chunk_index, exact, total, text: what the chunks say of a node, or of the two ends of an edge.

    The first `most` of all `total` chunks that source_chunks() finds, each narrowed to the windows around the names (id,
    name); a chunk whose text (source_file, chunk_index, text) is not known is left out.
    """
    ends = (node, node) if node is not None else edge
    all_ = cut(source_chunks(mentions, *ends, None), "sources")
    total = all_.count()
    some = all_.orderBy("source_file", "chunk_index").limit(most) if node is not None else source_chunks(mentions, *ends, most)
    told = [r[0] for r in names.where(F.col("id").isin(*ends) & (F.col("name") != "")).select("name").distinct().orderBy("name").collect()]  # the names of two nodes
    shown = F.array(*[F.lit(x) for x in told]) if told else F.array().cast("array<string>")
    text = chunks.join(F.broadcast(some.select("source_file", "chunk_index", "exact")), ["source_file", "chunk_index"]).groupBy("source_file", "chunk_index", "exact").agg(F.min("text").alias("t"))  # `most` rows
    return text.select("source_file", "chunk_index", "exact", F.lit(total).cast("long").alias("total"), excerpt(F.col("t"), shown).alias("text"))


def excerpt(text: Column, names: Column, context: int = 80, window: int = 240, most: int = 600, least: int = 80) -> Column:
    """Windows around all mentions of any of the names: from `context` characters before one, `window` long; overlapping ones joined.

    Windows are put together up to `most` characters; of the one that passes that the rest is shown if more than `least` are
    left. Three dots in one mark where text is left out. The text's head where none is mentioned.
    """
    low, n = F.lower(text), F.length(text)
    spots = F.flatten(F.transform(F.filter(names, lambda x: F.length(x) > 0), lambda x: _places(low, F.lower(x))))
    spans = F.array_sort(F.transform(F.array_distinct(spots), lambda p: F.struct(F.greatest(p - context, F.lit(0)).alias("a"), F.least(F.greatest(p - context, F.lit(0)) + window, n).alias("b"))))

    def join(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        over = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(s.a <= last.b, F.concat(over, F.array(F.struct(last.a.alias("a"), F.greatest(last.b, s.b).alias("b"))))).otherwise(F.concat(acc, F.array(s)))

    merged = F.aggregate(spans, F.slice(spans, 1, 0), lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(join(acc, s)))
    dots = lambda c: F.when(c, "…").otherwise("")

    def put(acc: Column, s: Column) -> Column:
        piece = F.substring(text, s.a + 1, s.b - s.a)
        rest = F.lit(most) - acc.used
        whole = F.concat(dots(s.a > 0), piece, dots(s.b < n))
        part = F.concat(dots(s.a > 0), F.substring(piece, F.lit(1), rest), F.lit("…"))
        fits = F.length(piece) <= rest
        out = F.when(acc.full, acc.out).when(fits, F.concat(acc.out, F.array(whole))).when(rest > least, F.concat(acc.out, F.array(part))).otherwise(acc.out)
        return F.struct(out.alias("out"), (acc.used + F.when(acc.full, 0).otherwise(F.length(piece))).alias("used"), (acc.full | ~fits).alias("full"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("full"))
    parts = F.aggregate(merged, start, put, lambda acc: acc.out)
    return F.when(F.size(spans) > 0, F.array_join(parts, "\n---\n")).otherwise(F.concat(F.substring(text, 1, window), dots(n > window)))


def _places(text: Column, what: Column) -> Column:
    """Where `what` stands in `text`, from 0, overlapping places too: the text is cut before each, and the pieces' lengths are added up."""
    pieces = F.split(text, F.concat(F.lit("(?=\\Q"), what, F.lit("\\E)")), -1)
    step = lambda acc, p: F.struct((acc.at + F.length(p)).alias("at"), F.when((acc.at > 0) | text.startswith(what), F.concat(acc.out, F.array(acc.at))).otherwise(acc.out).alias("out"))
    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc.out)
