"""Shared-folder tables, hot-key joins and worker set-up for the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A broadcast of hot keys has fewer rows than this: a key is hot when it holds more than 1/HOT_KEYS of all rows.
HOT_KEYS = 2000
#: Bytes of a batch of rows that a worker gets. Spark's own bound is eight times as large.
BATCH_BYTES = 8 << 20
#: 64-bit words of a bitmap that is broadcast.
BITMAP_WORDS = 1 << 17

_own_root: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a folder of this process only where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="plotweave-"))
    return _own_root[0]


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package where it lies at the same path on all nodes, and bounds the batches that are sent
    to them, unless the session has its own bound."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in ("64MB", "67108864", "67108864b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(":") + os.environ.get("PYTHONPATH", "").split(":")
    if top not in have:
        env["PYTHONPATH"] = ":".join(x for x in [env.get("PYTHONPATH", ""), top] if x)
    if top not in sys.path:
        sys.path.append(top)
    return spark


def trimmed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """f, for mapInArrow, that gives unused memory back to the system when its task ends: workers live on between stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library can't
            ctypes.CDLL(None).malloc_trim(0)

    return run


class Scratch:
    """Parquet tables in the shared folder. They cut lineage, so a lost executor costs only tasks of the running stage.

    What an operator returns may still read them. Whoever writes the result within passing() has them deleted then.
    """

    _passing: list[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = ready(spark), f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        if Scratch._passing:
            Scratch._passing[-1].append(self)

    @classmethod
    @contextlib.contextmanager
    def passing(cls) -> Iterator[None]:
        """Deletes, at its end, the tables of operators that were called within it."""
        cls._passing.append([])
        try:
            yield
        finally:
            for own in cls._passing.pop():
                own.drop()

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df, written once and read back."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner equi-join that no hot key slows down. right has one row for each key, and weight counts left's rows with it.

    Keys with more than 1/HOT_KEYS of left's rows, fewer than HOT_KEYS by construction, are joined by broadcast; the
    others are joined by a shuffle, where no key is large. Both sides are read more than once and should be tables.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    limit = total // HOT_KEYS
    hot = F.broadcast(right.where(F.col(weight) > limit))
    cold = left.join(F.broadcast(right.where(F.col(weight) > limit).select(*keys)), keys, "left_anti")
    return left.join(hot, keys).unionByName(cold.join(right.where(F.col(weight) <= limit), keys))


def maybe_in(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """df and a boolean maybe: false only where no row of keys has the same value in column, a hash of 64 bits.

    A bitmap of at most BITMAP_WORDS words, whatever the size of keys, is broadcast. The fuller it is the less it says, so
    whoever asks must look up the rows with maybe in keys; those are few while keys is small.
    """
    word, bit = F.expr(f"pmod(shiftright({column}, 6), {BITMAP_WORDS})"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    bitmap = keys.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    out = df.withColumn("_word", word).join(F.broadcast(bitmap), "_word", "left")
    return out.withColumn("maybe", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")


def parts(spark: SparkSession, least: int = 1) -> int:
    """The session's number of shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
