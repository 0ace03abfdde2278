"""Exact dedup by deterministic block naming. DataFrame functions only.

Texts are cut into blocks of fixed size. The distinct blocks are sorted and get their places, 0, 1, …, as names; then adjacent
names are paired, the distinct pairs sorted and named, and so on, until each document has one name. Two documents of as many rounds
have the same name exactly if their texts are equal: names stand for contents, not for hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch, hot_join, table, text_of

BLOCK_BYTES = 2048


def _blocks(text, size: int):
    raw = F.encode(text, "UTF-8")
    count = F.ceil(F.octet_length(text) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(raw, i * size + 1, F.lit(size)))
    return F.when(count > 0, cut).otherwise(F.array().cast("array<binary>"))


def _named(distinct: DataFrame, by: list[str], scratch: Scratch, table_name: str) -> DataFrame:
    """Adds name: the row's place, from 0, among all rows sorted by `by`, in which no two are equal. Names are the same however
    the rows are dealt out: range partitions are numbered apart, and the numbers of rows in those before are added."""
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    held = scratch.write(distinct.orderBy(*by).select("*", F.spark_partition_id().alias("part"), row.alias("at")), table_name)
    starts, before = [], 0
    for part, n in sorted(tuple(r) for r in held.groupBy("part").count().collect()):  # a row for each partition
        starts.append((part, before))
        before += n
    offsets = F.broadcast(distinct.sparkSession.createDataFrame(starts, "part int, first long"))
    return held.join(offsets, "part").withColumn("name", F.col("at") + F.col("first")).drop("part", "at", "first")


def name_documents(docs: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, names): rows has row_id, doc_id, sha256 (binary), n_blocks; names has row_id, level, name.

    (level, name) is the same for two rows exactly if their texts are equal; null text counts as empty (level -1).

    A whole block moves once, to be found among the distinct blocks. Afterwards a pair of 64-bit keys stands for it, which
    is first proved to differ between all distinct blocks; if it didn't, all would be done again with other keys. Blocks are
    sorted, and so named, by these keys.
    Blocks and pairs that many documents share are made distinct before they are shuffled and get their names by broadcast.
    """
    text, seed = text_of(), 0
    while True:
        blocks, keys = _blocks(text, block_bytes), lambda b, s=seed: (F.xxhash64(b, F.lit(s)).alias("a"), F.xxhash64(F.lit(~s), b).alias("b"))
        distinct = docs.select(F.explode(blocks).alias("block")).groupBy("block").agg(F.count("*").alias("n"))
        keyed = scratch.write(distinct.select(*keys(F.col("block")), "n"), f"keyed{seed}")
        if not keyed.groupBy("a", "b").count().where("count > 1").limit(1).count():
            break
        seed += 1
    names = _named(keyed, ["a", "b"], scratch, "names")
    rows = scratch.write(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.unhex(F.sha2(text, 256)).alias("sha256"), F.transform(blocks, lambda b: F.struct(*keys(b))).alias("blocks")).withColumn("n_blocks", F.size("blocks")), "rows")
    spelled = rows.where("n_blocks > 0").select("row_id", F.col("n_blocks").alias("length"), F.posexplode("blocks").alias("place", "block")).select("row_id", "length", "place", "block.a", "block.b")
    state = scratch.write(hot_join(spelled, names, ["a", "b"], "n").select("row_id", "length", "place", "name"), "level0")
    done = rows.where("n_blocks = 0").select("row_id", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("name"))
    level, longest = 0, rows.agg(F.max("n_blocks")).first()[0] or 0
    done = done.unionByName(state.where("length = 1").select("row_id", F.lit(level).alias("level"), "name"))
    while longest > 1:
        pairs = state.where("length > 1").groupBy("row_id", F.ceil(F.col("length") / 2).cast("int").alias("length"), F.floor(F.col("place") / 2).cast("int").alias("place"))
        one = lambda odd: F.coalesce(F.max(F.when(F.col("place") % 2 == odd, F.col("name"))), F.lit(-1)).alias("ab"[odd])
        pairs = scratch.write(pairs.agg(one(0), one(1)), f"pairs{level}")
        names = _named(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"], scratch, f"pair_names{level}")
        level, longest = level + 1, -(-longest // 2)
        state = scratch.write(hot_join(pairs, names, ["a", "b"], "n").select("row_id", "length", "place", "name"), f"level{level}")
        scratch.drop(f"pairs{level - 1}", f"pair_names{level - 1}")
        done = done.unionByName(state.where("length = 1").select("row_id", F.lit(level).alias("level"), "name"))
    return rows, done


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row for each row of docs.

    Of rows with equal texts the one with the largest doc_id is kept; among several of that doc_id, one. Null text counts as
    empty, null doc_id as smallest. Very long texts: whole, as blocks. No rows: no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rows, names = name_documents(docs, scratch, block_bytes)
    named = scratch.write(rows.select("row_id", "doc_id", "sha256").join(names, "row_id"), "named")
    best = F.max(F.struct("doc_id", (-F.col("row_id")).alias("r"))).alias("best")
    groups = scratch.write(named.groupBy("level", "name").agg(best, F.count("*").alias("group_size")), "groups")
    out = hot_join(named, groups, ["level", "name"], "group_size")
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.r") == -F.col("row_id")).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"))


def op2(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
    doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
