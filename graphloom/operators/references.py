"""References to records that do not exist: sorted arrays of parents per key range, probed by binary search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: References a cell holds at most on average; a range with more is salted.
CELL_ROWS = 200_000


def references(edges: DataFrame, table: str = "edges", ends: tuple[str, ...] = ("from", "to"), ref_id: str = "id", at: str = "ingested_at") -> DataFrame:
    """The references of a table in long form: table, endpoint, ref_id, key, at. Null endpoints refer to nothing and are left out."""
    ends_of = F.explode(F.array(*[F.struct(F.lit(e).alias("endpoint"), F.col(f"`{e}`").alias("key")) for e in ends]))
    long = edges.select(F.col(ref_id).alias("ref_id"), F.col(at).alias("at"), ends_of.alias("e"))
    return long.select(F.lit(table).alias("table"), "e.endpoint", "ref_id", "e.key", "at").where("key is not null")


def parent_spans(nodes: DataFrame, key: str = "id", since: str = "ingested_at", until: str = "deleted_at") -> DataFrame:
    """When each key is there: key, since, until (null: still). Of records that end together only the earliest start counts."""
    return nodes.where(F.col(key).isNotNull() & F.col(since).isNotNull()).groupBy(F.col(key).alias("key"), F.col(until).alias("until")).agg(F.min(since).alias("since"))


def _micros(col: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.cast(pc.cast(col, pa.timestamp("us")), pa.int64()), np.iinfo(np.int64).max))


def _probe(refs: pa.Table, parents: pa.Table) -> pa.Table:
    """The rows of refs without a parent at their time. Both tables hold one key range."""
    out = ["table", "endpoint", "ref_id", "key", "at"]
    if not refs.num_rows or not parents.num_rows:
        return refs.select(out)
    parents = parents.sort_by([("h", "ascending"), ("key", "ascending"), ("since", "ascending")]).combine_chunks()
    key, h, since, until = parents["key"], np.asarray(parents["h"]), _micros(parents["since"]), _micros(parents["until"])
    # one code per key; a reference then finds its key's stretch in the sorted array of (code, since)
    first = np.concatenate([[True], np.asarray(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)))]) if len(key) > 1 else np.array([True])
    code, head = np.cumsum(first) - 1, np.flatnonzero(first)
    starts, ends = np.unique(since), np.unique(until)
    width = len(starts) + 1
    at_since = code * width + np.searchsorted(starts, since, "right")
    longest = np.maximum.accumulate(code * len(ends) + np.searchsorted(ends, until)) - code * len(ends)  # latest end so far within the key
    rh, rkey, t = np.asarray(refs["h"]), refs["key"].combine_chunks(), _micros(refs["at"])
    known_at = ~np.asarray(pc.is_null(refs["at"]))
    heads, names = h[head], key.take(pa.array(head)).combine_chunks()
    lo, hi = np.searchsorted(heads, rh, "left"), np.searchsorted(heads, rh, "right")
    mine = np.full(len(rh), -1)
    for k in range(int((hi - lo).max(initial=0))):  # more than one step only where hashes collide
        i = np.minimum(lo + k, len(heads) - 1)
        same = np.asarray(pc.equal(names.take(pa.array(i)), rkey)) & (lo + k < hi)
        mine[same] = i[same]
    last = np.searchsorted(at_since, mine * width + np.searchsorted(starts, t, "right"), "right") - 1
    ok = (mine >= 0) & known_at & (last >= 0)
    last = np.maximum(last, 0)
    found = ok & (code[last] == mine) & (ends[longest[last]] > t)
    return refs.select(out).filter(pa.array(~found))


def orphan_references(refs: DataFrame, parents: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The references (see references()) whose key no parent (see parent_spans()) holds at the reference's time.

    A parent holds a key at t if since <= t and until is null or later than t. Keys are compared exactly, blanks
    included. A reference without time is an orphan. No parents: all are orphans; no references: no rows. Repeated
    references stay repeated.

    Keys are cut into ranges of their 64-bit hash, of about cell_rows references and parents at most. A range that holds more, because of
    hot keys, is salted: its references are split over several cells and its parents repeated in each. The hot ranges
    are fewer than references / cell_rows, which bounds what is broadcast.
    """
    n = max(1, refs.count(), parents.count())
    ranges = max(1, 2 ** int(np.ceil(np.log2(n / cell_rows))) if n > cell_rows else 1)
    spread = lambda d: d.withColumn("h", F.xxhash64("key")).withColumn("cell", F.floor((F.shiftrightunsigned("h", 33)) * F.lit(ranges) / F.lit(2**31)).cast("int"))
    refs, parents = spread(refs), spread(parents)
    hot = refs.groupBy("cell").count().where(F.col("count") > 2 * cell_rows).select("cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("salts"))
    hot = [(r["cell"], r["salts"]) for r in hot.collect()]
    if hot:
        salts = F.broadcast(refs.sparkSession.createDataFrame(hot, "cell int, salts int"))
        refs = refs.join(salts, "cell", "left").withColumn("salt", F.pmod(F.xxhash64("ref_id", "endpoint", "at"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        parents = parents.join(salts, "cell", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    else:
        refs, parents = refs.withColumn("salt", F.lit(0)), parents.withColumn("salt", F.lit(0))
    schema = refs.select("table", "endpoint", "ref_id", "key", "at").schema
    return refs.groupBy("cell", "salt").cogroup(parents.groupBy("cell", "salt")).applyInArrow(_probe, schema)


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table, endpoint and month (yyyy-MM of the reference's time, null without one): references and distinct keys."""
    month = F.date_format("at", "yyyy-MM")
    each = orphans.groupBy("table", "endpoint", month.alias("month"), "key").agg(F.countDistinct("ref_id").alias("n"), F.max(F.col("ref_id").isNull().cast("int")).alias("z"))
    return each.groupBy("table", "endpoint", "month").agg(F.sum(F.col("n") + F.col("z")).alias("references"), F.count("*").alias("keys"))
