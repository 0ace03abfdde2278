"""Tables between steps: lineage cut by Parquet in the shared folder, and running numbers."""

from __future__ import annotations

import contextlib
import functools
import operator
import os
import sys
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this process only where that is unset and all runs in this process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="plotweave-"))
    return _own[0]


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where it lies at the same path on all nodes."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if top not in env.get("PYTHONPATH", "").split(":") + os.environ.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in [env.get("PYTHONPATH", ""), top] if x)
    if top not in sys.path:
        sys.path.append(top)
    return spark


_where: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_scopes: list[list[tuple[SparkSession, str]]] = []


def staged(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """df written once and read back, with its schema or another one of the same storage. Iterations call this so that a lost
    executor repeats one step only. The table goes with unstaged(), or when the scope of passing() ends in which it was made."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(schema or df.schema).parquet(path)
    _where[out] = path
    if _scopes:
        _scopes[-1].append((spark, path))
    return out


_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def once(df: DataFrame) -> DataFrame:
    """staged(df), for large ones: the shuffles that made it go at once, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANED, None)
    conf.set(_CLEANED, "true")
    try:
        return staged(df)
    finally:
        conf.set(_CLEANED, before) if before is not None else conf.unset(_CLEANED)


def unstaged(*tables: DataFrame | None) -> None:
    """Deletes the tables of staged() that nothing will read again; other DataFrames and None are left alone."""
    for t in tables:
        if t is not None and (path := _where.pop(t, None)):
            removed(t.sparkSession, path)


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, at its end, the tables that were staged within it, but for those given to what it yields: these belong to the
    scope outside. For steps of an iteration, and for whoever writes a result of these operators elsewhere."""
    _scopes.append([])
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(_where[table])
        return table

    try:
        yield keep
    finally:
        for spark, path in _scopes.pop():
            if path not in kept:
                removed(spark, path)
            elif _scopes:
                _scopes[-1].append((spark, path))


def numbered(df: DataFrame, *order: Column | str, name: str = "id") -> DataFrame:
    """Adds 0, 1, … in the given order, without a task that sees all rows: range partitions are numbered apart, and the
    rows of the partitions before, one number for each, are added."""
    held = staged(df.orderBy(*order).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row")))
    held = held.withColumn("__row", F.col("__row").bitwiseAND((1 << 33) - 1))
    before, starts = 0, []
    for part, n in sorted(tuple(r) for r in held.groupBy("__part").count().collect()):
        starts.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "__part int, __start long")
    return held.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__row") + F.col("__start")).drop("__part", "__row", "__start")


def ranked(df: DataFrame, groups: list[str], *order: Column | str, name: str = "rank", size: str | None = None) -> DataFrame:
    """Adds 1, 2, … within each group in the given order, and the group's size if that is named. Rows are numbered by range
    partitions, so a group with most of the rows is many tasks; groups themselves (strata, bins, labels) are few."""
    held = numbered(df, *[F.col(g) for g in groups], *order, name="__at")
    starts = held.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)]).agg(F.min("__at").alias("__first"), F.count("*").alias("__size"))
    same = functools.reduce(operator.and_, [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)], F.lit(True))
    out = held.join(F.broadcast(starts), same).withColumn(name, F.col("__at") - F.col("__first") + 1)
    out = out.withColumn(size, F.col("__size")) if size else out
    return out.drop("__at", "__first", "__size", *[f"__g{i}" for i in range(len(groups))])


def percentiles(df: DataFrame, groups: list[str], column: str, share: float) -> DataFrame:
    """groups, limit: the value below which a share of each group's values lies, linear between two of them. Values are ranked
    by range partitions, so that no task holds a group's values. Nulls don't count; a group without values has no row."""
    rows = ranked(df.where(F.col(column).isNotNull()).select(*groups, F.col(column).cast("double").alias("_x")), groups, "_x", name="_r", size="_k")
    at = F.lit(share) * (F.col("_k") - 1)
    near = rows.where((F.col("_r") - 1 == F.floor(at)) | (F.col("_r") - 1 == F.ceil(at)))
    limit = F.min("_x") + (F.max("_x") - F.min("_x")) * (F.max(at) - F.max(F.floor(at)))
    return near.groupBy(*groups).agg(limit.alias("limit"))
