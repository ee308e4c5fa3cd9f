"""Cutting texts into overlapping chunks, and packing them into batches of a token budget."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import WS, without_counter
from graphloom.shared import cut, drop


def without_frontmatter(text: Column) -> Column:
    """The text without one leading block between lines of --- or +++."""
    return F.regexp_replace(text, r"\A(?:---|\+\+\+)\n(?s:.*?)\n(?:---|\+\+\+)\n", "")


def tokens(text: Column) -> Column:
    """The words between white space. Other tokenizers can stand in its place: all that follows counts positions only."""
    return F.filter(F.split(text, f"{WS}+"), lambda t: t != "")


def truncated(text: Column, most: int) -> Column:
    """The first `most` tokens; all of the text for 0."""
    return text if most == 0 else F.array_join(F.slice(tokens(text), 1, most), " ")


def window_starts(n: Column, window: int, overlap: int) -> Column:
    """Where the windows over n tokens start; the last is the first that reaches the end."""
    if not 0 <= overlap < window:
        raise ValueError("the overlap must be less than the window")
    return F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(window - overlap))


def chunk(files: DataFrame, window: int = 500, overlap: int = 50, file: str = "source_file", text: str = "content") -> DataFrame:
    """source_file, chunk_index, text, token_start, token_end of all files. Files without tokens give one empty chunk; null texts none. No shuffle."""
    t = files.select(file, tokens(without_frontmatter(F.col(text))).alias("_t")).where("_t is not null")
    piece = lambda s: F.struct(s.alias("token_start"), F.array_join(F.slice("_t", s + 1, window), " ").alias("text"), F.least(s + window, F.size("_t")).alias("token_end"))
    e = t.select(file, F.posexplode(F.transform(window_starts(F.size("_t"), window, overlap), piece)).alias("chunk_index", "c"))  # a text's tokens are not copied into its windows
    return e.select(file, "chunk_index", "c.text", "c.token_start", "c.token_end")


def chunk_texts(chunks: DataFrame, file: str = "source_file") -> DataFrame:
    """chunk_key, text: chunks by the key file::number, numbers from 1."""
    return chunks.select(F.concat(F.col(file), F.lit("::"), (F.col("chunk_index") + 1).cast("string")).alias("chunk_key"), "text")


def chunk_count(n: Column, window: int, overlap: int) -> Column:
    return F.greatest(F.lit(1), F.ceil((n - overlap) / (window - overlap))).cast("int")


def pack(items: DataFrame, group: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """group, order, size and batch (from 0 in each group): greedy packing in order within each group.

    An item that doesn't fit opens the next batch; one larger than the budget has its own. Groups are sorted within
    partitions and streamed: a task keeps the running size of one batch and collects no group, however large.
    """
    rows = items.select(*group, *order, F.col(size).cast("long").alias(size))
    schema = T.StructType([*rows.schema, T.StructField("batch", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used, number = None, 0, 0
        for b in batches:
            out = []
            for *key, n in zip(*(b.column(c).to_pylist() for c in (*group, size))):
                n = n or 0
                if key != last:
                    last, used, number = key, 0, 0
                if used and used + n > budget:
                    used, number = 0, number + 1
                used += n
                out.append(number)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], schema.names)

    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)


def running_totals(rows: DataFrame, order: str, size: str, tasks: int) -> DataFrame:
    """rows, cut, with `before`: the sum of `size` over all rows earlier in the order. Ranges are written once, summed, and their totals added up, so no task sees all rows."""
    ranged = cut(rows.repartitionByRange(tasks, order).withColumn("_range", F.spark_partition_id()), "ranges")
    per = ranged.groupBy("_range").agg(F.sum(size).alias("n"))
    first = per.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_first"))  # `tasks` rows
    w = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(first), "_range").withColumn("before", F.col("_first") + F.sum(size).over(w) - F.col(size)).drop("_range", "_first")


def pack_pooled(items: DataFrame, order: list[str], size: str, budget: int, tasks: int | None = None) -> DataFrame:
    """order, size, batch (from 0): greedy packing of one ordered list over all files, exactly that of a single pass.

    Where a batch begins decides where the next one does, so the list is numbered, every item is joined to the first item
    that no longer fits beside it, and this table of successors is squared: after k rounds all beginnings up to number 2**k
    are known. The successor is found by running totals (successors). Batches are counted by a running sum over the
    beginnings. Items without size count 0; an item larger than the budget has a batch of its own.
    """
    tasks = tasks or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = items.select(*order, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias(size))
    keyed = rows.withColumn("_o", F.struct(*order))
    placed = running_totals(keyed.withColumn("_one", F.lit(1).cast("long")), "_o", "_one", tasks).withColumnRenamed("before", "_k")
    placed = cut(running_totals(placed, "_o", size, tasks), "placed")  # _k: number of the item; before: tokens of all earlier ones
    # the next batch begins at the first item that ends beyond the budget, or after it where nothing of any size stands before it
    starts = placed.select("_k", "before", (F.col("before") + budget).alias("_limit"))
    found = successors(starts, placed.select((F.col("before") + F.col(size)).alias("_end"), F.struct("_k", "before").alias("_item")), tasks)
    step = F.when(F.col("_item.before") > F.col("before"), F.col("_item._k")).otherwise(F.col("_item._k") + 1)
    nxt = cut(found.select("_k", step.alias("_next")), "next")
    reached = cut(placed.where("_k = 0").select("_k"), "reached")
    jump = nxt
    while True:
        more = jump.join(reached, "_k", "left_semi").select(F.col("_next").alias("_k")).where("_k is not null")
        after = cut(reached.union(more).distinct(), "reached")
        grown = after.count() > reached.count()
        drop(reached)
        reached = after
        if not grown:
            break
        twice = cut(jump.join(jump.select(F.col("_k").alias("_next"), F.col("_next").alias("_then")), "_next", "left").select("_k", F.col("_then").alias("_next")), "next")
        drop(jump)
        jump = twice
    marked = placed.join(reached.withColumn("_new", F.lit(1).cast("long")), "_k", "left").withColumn("_new", F.coalesce("_new", F.lit(0).cast("long")))
    out = running_totals(marked.drop("before"), "_o", "_new", tasks)
    for d in (jump, reached, placed):
        drop(d)
    return out.select(*order, size, (F.col("before") + F.col("_new") - 1).cast("int").alias("batch"))


def successors(starts: DataFrame, ends: DataFrame, tasks: int) -> DataFrame:
    """starts (_limit and more) with _item: of the ends (_end, _item; both grow together) the first beyond the limit, null if there is none.

    Both are put in one order and cut into ranges. Within a range a running minimum from the end finds the next item; where
    a range holds none, it is that of the first range after it which does.
    """
    cols = [c for c in starts.columns if c != "_limit"]
    a = starts.select(F.col("_limit").alias("_v"), F.lit(1).alias("_is"), *cols, F.lit(None).cast(ends.schema["_item"].dataType).alias("_item"))
    b = ends.select(F.col("_end").alias("_v"), F.lit(0).alias("_is"), *[F.lit(None).cast(starts.schema[c].dataType).alias(c) for c in cols], "_item")
    # what ends at the limit still fits: at equal values ends stand before starts
    ranged = cut(a.unionByName(b).withColumn("_o", F.struct("_v", "_is", "_item")).repartitionByRange(tasks, "_o").withColumn("_range", F.spark_partition_id()), "ranges")
    first = ranged.groupBy("_range").agg(F.min("_item").alias("_f"))  # `tasks` rows
    later = first.select("_range", F.min("_f").over(Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    w = Window.partitionBy("_range").orderBy(F.desc("_o")).rowsBetween(Window.unboundedPreceding, -1)
    near = ranged.withColumn("_near", F.min("_item").over(w)).where("_is = 1")
    return near.join(F.broadcast(later), "_range").select(*cols, F.coalesce("_near", "_later").alias("_item"))


def batch_map(packed: DataFrame, keys: list[str], file: str, index: str, size: str) -> DataFrame:
    """keys, files, chunks (file::number from 1), total: what each batch holds."""
    c = F.array_sort(F.collect_list(F.struct(file, index)))
    shown = F.transform(c, lambda x: F.concat(x[file], F.lit("::"), (x[index] + 1).cast("string")))
    return packed.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(file)), ",").alias("files"), F.array_join(shown, ",").alias("chunks"), F.sum(size).alias("total"))


def concat_groups(files: DataFrame, budget: int, path: str = "source_file", size: str = "token_count") -> DataFrame:
    """folder, stem, source_file, token_count, batch: files over the budget alone (batch -1), the others packed by folder, in the order of (name without its counter, name)."""
    f = files.withColumn("folder", F.regexp_replace(path, "/?[^/]*$", "")).withColumn("stem", without_counter(F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.[^.]*$", "")))
    small = pack(f.where(F.col(size) <= budget), ["folder"], ["stem", path], size, budget)
    return small.unionByName(f.where(F.col(size) > budget).select("folder", "stem", path, F.col(size).cast("long").alias(size), F.lit(-1).alias("batch")))


def virtual_files(packed: DataFrame, texts: DataFrame, path: str = "source_file", text: str = "content") -> DataFrame:
    """folder, batch, content: the texts of each batch put together under their sources' headings."""
    parts = F.array_sort(F.collect_list(F.struct("stem", path, text)))
    shown = F.transform(parts, lambda p: F.concat(F.lit("--- SOURCE: "), p[path], F.lit(" ---\n"), F.coalesce(p[text], F.lit(""))))
    return packed.where("batch >= 0").join(texts, path).groupBy("folder", "batch").agg(F.array_join(shown, "\n\n").alias("content"))


def inventory_requests(names: DataFrame, budget: int, most: int) -> DataFrame:
    """type, tokens, request: types (type, name) with two names at least, packed in order of their names into requests of a token budget, at four bytes to a token.

    Of each type the first `most` names count, which is the rule of such a request and bounds it. One row per type is packed.
    """
    w = Window.partitionBy("type").orderBy("name")
    kept = names.select("type", "name", F.row_number().over(w).alias("k")).where(F.col("k") <= most)
    per = kept.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.octet_length("name") + 4).alias("bytes")).where("n >= 2")
    tokens_ = F.floor((F.col("bytes") + F.octet_length("type") + 4) / 4).cast("long")
    return pack(per.select(F.lit(0).alias("all"), "type", tokens_.alias("tokens")), ["all"], ["type"], "tokens", budget).select("type", "tokens", F.col("batch").alias("request"))


def sample_batches(n: int, most: int, seed: int) -> list[int]:
    """The numbers of at most `most` of n batches, the same for the same seed, in order."""
    return list(range(n)) if n <= most else sorted(random.Random(seed).sample(range(n), most))


def unfinished(selection: DataFrame, done: DataFrame) -> DataFrame:
    """Batches (batch, chunk_count, files) not done before with the same composition."""
    return selection.join(done, ["batch", "chunk_count", "files"], "left_anti")


#: What a rounded number of tokens is a multiple of.
STEPS = (10000, 5000, 2000, 1000, 500, 200, 100)


def nice_number(x: int) -> int:
    """x rounded down to a multiple of the largest of STEPS that is no larger; as it is below them."""
    return next((x // s * s for s in STEPS if x >= s), x)


def nice_numbers(x: Column) -> Column:
    """nice_number() of a column of whole numbers."""
    return F.coalesce(*[F.when(x >= s, F.floor(x / s).cast("long") * s) for s in STEPS], x.cast("long"))


def token_budget(context: int, output: int | None = None, headroom: int | None = None, divisor: int = 12, margin: float = 0.05, overlap: float = 0.1) -> dict[str, int]:
    """How many tokens a request, its chunks and their overlap may have: the context less the answer, less a margin that is kept for feedback (in tokens, and in characters at four to a token)."""
    if output is None and headroom is None:
        raise ValueError("either the answer's size or the room for the request must be given")
    headroom = context - output if headroom is None else headroom
    output = context - headroom if output is None else output
    request = nice_number(int(headroom * (1 - margin)))
    window = max(nice_number(int(request / divisor)), 100)
    return {
        "context": context, "output": output, "headroom": headroom, "request": request, "reserve": headroom - request, "reserve_chars": 4 * (headroom - request),
        "chunk": window, "overlap": max(nice_number(int(window * overlap)), 10),
    }


def token_budgets(rows: DataFrame, headroom: str, divisor: int = 12, margin: float = 0.05, overlap: float = 0.1) -> DataFrame:
    """rows with request, chunk, overlap and reserve_chars of token_budget(), for a column of headrooms."""
    request = nice_numbers(F.floor(F.col(headroom) * (1 - margin)).cast("long"))
    window = F.greatest(nice_numbers(F.floor(F.col("request") / divisor).cast("long")), F.lit(100))
    out = rows.withColumn("request", request).withColumn("chunk", window)
    return out.withColumn("overlap", F.greatest(nice_numbers(F.floor(F.col("chunk") * overlap).cast("long")), F.lit(10))).withColumn("reserve_chars", (F.col(headroom) - F.col("request")) * 4)


def chunks_of(tokens: int, window: int, overlap: int) -> int:
    """How many chunks a corpus makes if it is cut as one text."""
    return 1 if tokens <= window or window <= overlap else math.ceil((tokens - overlap) / (window - overlap))


def better_divisor(headroom: int, tokens: int, window: int, overlap: int, least: int = 50, most: int = 500, aim: int = 200, start: int = 12) -> tuple[int, int]:
    """The first divisor from 4 to 31 for which a corpus makes `least` to `most` chunks, and their number; if there is none, the one (or `start`, with the chunks given) that comes nearest to `aim`."""
    best = start, chunks_of(tokens, window, overlap)
    for d in range(4, 32):
        b = token_budget(headroom, 0, divisor=d)
        n = chunks_of(tokens, b["chunk"], b["overlap"])
        if least <= n <= most:
            return d, n
        if abs(n - aim) < abs(best[1] - aim):
            best = d, n
    return best
