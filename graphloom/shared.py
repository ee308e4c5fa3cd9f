"""Cutting lineage in the shared folder, and splitting hot join keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs on one machine. RuntimeError on a cluster without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("a cluster must name its shared folder in spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there, and the copy outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._graphloom_path = path
    return back


def drop(df: DataFrame | None) -> None:
    """Deletes what cut() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        _delete(df.sparkSession, path)


def cleanup(spark: SparkSession) -> None:
    """Deletes all that this application cut, at its end: results that were not written elsewhere go with it."""
    _delete(spark, f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def salted_lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", parts: int | None = None) -> DataFrame:
    """left joined to right, whose keys are unique, with the rows of hot keys of left spread over several tasks.

    A key is hot if it holds more than 1/parts of the rows of left, so there are fewer than `parts` of them: that bounds
    what is broadcast. The rows of right for hot keys are repeated once per salt; all others stay as they are. Salts are hashes of the
    row, so a task that runs again gives the same ones.
    """
    spark = left.sparkSession
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = left.groupBy(*keys).count()
    total, most = counts.agg(F.sum("count"), F.max("count")).first()
    if not total or most * parts <= total:
        return left.join(right, keys, how)
    hot = counts.where(F.col("count") * parts > total).select(*keys, F.lit(True).alias("_hot"))
    known = [r.asDict() for r in hot.drop("_hot").collect()]
    hot = F.broadcast(spark.createDataFrame([tuple(r[k] for k in keys) + (True,) for r in known], hot.schema))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(c) for c, kind in left.dtypes if not kind.startswith("map")]), F.lit(parts)).cast("int")).otherwise(F.lit(0))
    salts = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))
    a = left.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    b = right.join(hot, keys, "left").withColumn("_salt", salts).drop("_hot")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def blank_to_null(x: Column) -> Column:
    """x without surrounding white space (of any script), null where nothing remains."""
    y = trimmed(x)
    return F.when(F.length(y) > 0, y)


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
