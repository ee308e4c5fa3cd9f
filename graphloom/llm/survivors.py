"""One surviving record per group of duplicates, attribute by attribute: by Bayesian fusion with copy detection, or by a fixed order of trust."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.shared import cut, drop, salted_lookup, trimmed

#: Values that stand for "unknown", compared without case and surrounding blanks.
STAND_INS = ("", "-", "--", "?", "??", "n/a", "na", "nan", "nil", "no data", "none", "not available", "not known", "null", "tba", "tbd", "undefined", "unknown")

#: Share of a copier's values that it copies; odds before any evidence that one source copies another; false values an attribute may have.
COPY_RATE, COPY_PRIOR, FALSE_VALUES = 0.8, 0.2, 10
ROUNDS = 3
#: Digits to which accuracies and posteriors are compared: what differs less is a tie, whatever the order of sums.
DIGITS = 9


def valid_confidence(x: Column) -> Column:
    """x if it is a number within 0..1, else -1: below every valid one, and equal to each other."""
    return F.when(x.isNotNull() & ~F.isnan(x) & x.between(0, 1), x).otherwise(F.lit(-1.0))


def candidates(nodes: DataFrame) -> DataFrame:
    """One row per usable attribute value of each record of an id that stands under two or more different node_key.

    Columns id, attr, node_key, value, ac and rc (confidences of attribute and record, -1 if not valid), n_files
    (distinct source files that are not blank), ingested_at, session_id, files. Usable: not null, not blank, not a
    stand-in for unknown. Records without id belong to no group; null maps and files count as empty.
    """
    files = F.array_distinct(F.filter(F.coalesce("source_files", F.array().cast("array<string>")), lambda f: f.isNotNull() & (F.length(trimmed(f)) > 0)))
    rows = nodes.where(F.col("id").isNotNull()).select("id", "node_key", "session_id", valid_confidence(F.col("confidence")).alias("rc"), files.alias("files"), "ingested_at", "attributes")
    several = rows.groupBy("id").agg(F.min("node_key").alias("lo"), F.max("node_key").alias("hi")).where("lo <> hi").select("id")
    long = rows.select("*", F.explode("attributes").alias("attr", "a")).select("id", "attr", "node_key", F.col("a.value").alias("value"), valid_confidence(F.col("a.confidence")).alias("ac"), "rc", F.size("files").alias("n_files"), "ingested_at", "session_id", "files")
    usable = long.where(F.col("value").isNotNull() & ~F.lower(trimmed(F.col("value"))).isin(*STAND_INS))
    return usable.join(several, "id", "left_semi")


def trust() -> Column:
    """What orders candidates: attribute confidence, record confidence, distinct files, later ingested_at, smaller node_key."""
    return F.struct("ac", "rc", "n_files", "ingested_at", (-F.col("node_key")).alias("least"))


def by_trust(cands: DataFrame) -> DataFrame:
    """id, attr, node_key, value: the candidate that trust() puts first. Exact repetitions tie and give one row. Aggregated on both sides of the shuffle."""
    best = cands.groupBy("id", "attr").agg(F.max(F.struct(trust().alias("t"), "value")).alias("b"))
    return best.select("id", "attr", (-F.col("b.t.least")).alias("node_key"), F.col("b.value").alias("value"))


def shared_claims(judged: DataFrame, sizes: DataFrame) -> DataFrame:
    """id, attr, v, one, two, dep: every claim that two sources share, for all pairs that share a false one; dep: the probability that one copies.

    judged: id, attr, v, source, posterior; sizes: source, size. Pairs come from the false values alone. Their other
    claims are looked up from the source of fewer, so a pair costs no more than these. A shared value speaks for copying
    the more, the less likely it is; an attribute for which both have values, and none in common, speaks against it.
    """
    false = judged.where("posterior < 0.5").select("id", "attr", "v", "source")
    both = false.withColumnRenamed("source", "a").join(false.withColumnRenamed("source", "b"), ["id", "attr", "v"]).where("a < b")
    found = pairs = cut(both.groupBy("a", "b").agg(F.count("*").alias("f")), "found")
    for side in ("a", "b"):
        pairs = salted_lookup(pairs, sizes.select(F.col("source").alias(side), F.col("size").alias(f"size_{side}")), [side], "inner")
    few = F.col("size_a") <= F.col("size_b")
    pairs = cut(pairs.select(F.when(few, F.col("a")).otherwise(F.col("b")).alias("one"), F.when(few, F.col("b")).otherwise(F.col("a")).alias("two"), "f"), "pairs")
    mine = pairs.join(judged.withColumnRenamed("source", "one"), "one")
    claims = salted_lookup(mine, judged.select("id", "attr", F.col("v").alias("other"), F.col("source").alias("two")), ["id", "attr", "two"], "inner")
    claims = cut(claims.withColumn("same", F.col("v") == F.col("other")), "pair_claims")
    # chances of one to say a value, and of both apart from each other, at an accuracy of 0.8
    p = F.col("posterior")
    own, apart = 0.8 * p + 0.2 * (1 - p), 0.8 * 0.8 * p + 0.2 * 0.2 / FALSE_VALUES * (1 - p)
    more_false, more_true = F.log((COPY_RATE * own + (1 - COPY_RATE) * apart) / apart), math.log((COPY_RATE * 0.8 + (1 - COPY_RATE) * 0.8 * 0.8) / (0.8 * 0.8))
    at = claims.groupBy("one", "two", "id", "attr").agg(F.max("f").alias("f"), F.sum(F.when(F.col("same") & (p < 0.5), more_false).otherwise(0.0)).alias("false"), F.count_if(F.col("same") & (p >= 0.5)).alias("t"), F.max("same").alias("same"))
    of = at.groupBy("one", "two").agg(F.max("f").alias("f"), F.sum("false").alias("false"), F.sum("t").alias("t"), F.count_if(~F.col("same")).alias("apart"))
    odds = F.lit(math.log(COPY_PRIOR / (1 - COPY_PRIOR))) + F.col("false") + F.least(F.col("t"), F.col("f") * 2) * more_true + F.col("apart") * math.log(1 - COPY_RATE)
    dep = of.select("one", "two", (1 / (1 + F.exp(-odds))).alias("dep"))
    shared = cut(salted_lookup(claims.where("same").select("id", "attr", "v", "one", "two"), dep, ["one", "two"], "inner"), "shared")
    for d in (found, pairs, claims):
        drop(d)
    return shared


def copied(shared: DataFrame, accuracy: DataFrame) -> DataFrame:
    """id, attr, v, source, dep: for each claim of shared_claims() the highest probability that its source copies a more accurate one that shares it."""
    for side in ("one", "two"):
        shared = salted_lookup(shared, accuracy.select(F.col("source").alias(side), F.struct("a", "source").alias(f"rank_{side}")), [side], "inner")
    copier = F.when(F.col("rank_one") < F.col("rank_two"), F.col("one")).otherwise(F.col("two"))
    return shared.groupBy("id", "attr", "v", copier.alias("source")).agg(F.max("dep").alias("dep"))


def by_posterior(cands: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """id, attr, value, posterior, n_sources, node_key: the value of maximum posterior probability, and its most trusted record.

    Sources are the files a record was taken from (its session where it has none); values are compared without case and
    surrounding blanks. Each round (1) adds up, per value, its sources' votes ln(n a / (1 - a)) for accuracy a, weighted
    by the extraction's confidence and by the chance that the vote isn't copied; (2) takes posteriors per attribute;
    (3) re-estimates every source's accuracy as the mean posterior of its values, smoothed; (4) for all pairs of sources
    that share a false value, gathers over all attributes how many false and true values they share: shared false values
    are unlikely unless one copies. Of a pair the more accurate source is the origin (of equal ones that of the greater
    name); a vote is discounted by the most likely of its origins that say the same. Ties go to the most trusted record.
    """
    n = FALSE_VALUES
    source = F.explode(F.when(F.size("files") > 0, F.col("files")).otherwise(F.array(F.concat(F.lit("session "), F.coalesce("session_id", F.lit(""))))))
    claim = cands.select("id", "attr", F.lower(trimmed(F.col("value"))).alias("v"), "value", "node_key", "ac", "rc", "n_files", "ingested_at", source.alias("source"))
    weight = F.max(F.when(F.col("ac") < 0, 0.5).otherwise(F.greatest("ac", F.lit(0.05))))
    claims = cut(claim.groupBy("id", "attr", "v", "source").agg(weight.alias("w"), F.max(F.struct(trust().alias("t"), "value")).alias("b")), "claims")
    sizes = cut(claims.groupBy("source").agg(F.count("*").alias("size")), "sizes")
    accuracy, shared, old = None, None, [claims, sizes]
    for k in range(rounds):
        c = claims
        if accuracy is None:
            c = c.withColumn("a", F.lit(0.8))
        else:
            c = c.join(accuracy, "source", "left")
        c = cut(c.select("id", "attr", "v", "source", "w", "b", "a"), "votes")
        old.append(c)
        if shared is None:
            c = c.withColumn("dep", F.lit(0.0))
        else:
            c = c.join(copied(shared, accuracy), ["id", "attr", "v", "source"], "left").withColumn("dep", F.coalesce("dep", F.lit(0.0)))
        vote = F.col("w") * F.log(n * F.col("a") / (1 - F.col("a"))) * (1 - COPY_RATE * F.col("dep"))
        values = c.groupBy("id", "attr", "v").agg(F.sum(vote).alias("score"), F.count("*").alias("n_sources"), F.max("b").alias("b"))
        values = cut(values, "values")
        old.append(values)
        tops = values.groupBy("id", "attr").agg(F.max("score").alias("top"), F.count("*").alias("k"))
        scaled = values.join(tops, ["id", "attr"]).withColumn("odds", F.exp(F.col("score") - F.col("top")))
        unseen = F.greatest(F.lit(n + 1) - F.max("k"), F.lit(0)) * F.exp(-F.max("top"))
        total = scaled.groupBy("id", "attr").agg((F.sum("odds") + unseen).alias("z"))
        posterior = scaled.join(total, ["id", "attr"]).withColumn("posterior", F.col("odds") / F.col("z"))
        posterior = cut(posterior.select("id", "attr", "v", "posterior", "n_sources", "b"), "posterior")
        if k + 1 < rounds:
            judged = claims.select("id", "attr", "v", "source").join(posterior.select("id", "attr", "v", "posterior"), ["id", "attr", "v"])
            judged = cut(judged, "judged")
            mean = (F.sum("posterior") + 4 * 0.8) / (F.count("*") + 4)
            accuracy = cut(judged.groupBy("source").agg(F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.round(mean, DIGITS))).alias("a")), "accuracy")
            shared = shared_claims(judged, sizes)
            old += [posterior, judged, accuracy, shared]
    w = F.struct(F.round("posterior", DIGITS).alias("posterior"), F.col("b.t").alias("t"), F.col("b.value").alias("value"), "n_sources")
    best = posterior.groupBy("id", "attr").agg(F.max(w).alias("m"))
    for d in old:
        drop(d)
    return best.select("id", "attr", F.col("m.value").alias("value"), F.col("m.posterior").alias("posterior"), F.col("m.n_sources").alias("n_sources"), (-F.col("m.t.least")).alias("node_key"))


def surviving_records(chosen: DataFrame) -> DataFrame:
    """id and its attributes (a map) from by_trust() or by_posterior()."""
    pairs = F.array_sort(F.collect_list(F.struct("attr", "value")))
    return chosen.groupBy("id").agg(F.map_from_entries(pairs).alias("attributes"))
