"""Mixing sources to target weights by a time-varying curriculum. DataFrame functions only, no Python on executors.

Each source has a weight schedule over training time 0..1, a piecewise linear curve. Its integral, scaled to the source's
target, is the source's cumulative demand for words. A document stands at a place in its source's stream of words, and the
inverse of the demand at that place is its training position. Documents are range-sorted by position.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: A document's words: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """weights and curves repeat over the sources in code point order, null last. A curve lists knots (time, weight)."""

    weights: tuple[int, ...] = (3, 1, 2)
    curves: tuple[tuple[tuple[float, float], ...], ...] = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 1.75)), ((0.0, 1.5), (1.0, 0.5)))
    #: The mix has half as many words again as the documents.
    budget_percent: int = 150
    max_passes: int = 2


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """source, source_size -> source, source_size, curve (index), target.

    The budget is shared by weight; no source passes max_passes times its size, and what it leaves goes to the others by
    weight. Closed form instead of rounds: in order of size over weight, the sources that stop at their limit come first.
    The window over all sources sees one row for each source.
    """
    k, n = mix.max_passes, len(mix.weights)
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_fill = W.orderBy((F.col("source_size") / F.col("weight")).asc(), "rank")
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("curve", F.col("rank") % n)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, mix.weights)), F.col("curve") + 1).cast("long"))
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    filled = ranked.withColumns({
        "size_before": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "weight_left": F.sum("weight").over(by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)),
        "budget": F.sum("source_size").over(every) * mix.budget_percent,
    })
    full = 100 * k * F.col("source_size") * F.col("weight_left") <= F.col("weight") * (F.col("budget") - 100 * k * F.col("size_before"))
    filled = filled.withColumn("full", full)
    filled = filled.withColumns({
        "full_size": F.sum(F.when(F.col("full"), F.col("source_size")).otherwise(0)).over(every),
        "open_weight": F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every),
    })
    share = (F.col("weight") * (F.col("budget") - 100 * k * F.col("full_size"))).cast("double") / (100 * F.col("open_weight")).cast("double")
    target = F.when(F.col("full"), (k * F.col("source_size")).cast("double")).otherwise(share)
    return filled.select("source", "source_size", F.col("curve").cast("int").alias("curve"), target.alias("target"))


def position(curve: Column, share: Column, mix: Mix = Mix()) -> Column:
    """The time at which a source with this curve has taken this share of its target; null beyond 1, which is never reached."""
    out = F.lit(None).cast("double")
    for i, knots in enumerate(mix.curves):
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        total, done, at = sum(areas), 0.0, F.lit(None).cast("double")
        for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
            rest, slope = share * total - done, (w1 - w0) / (t1 - t0)
            inverse = t0 + 2 * rest / (w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0))))
            inside = (share < 1) & (share * total >= done)
            at = F.when(inside & (share * total < done + area) if t1 < 1 else inside, inverse).otherwise(at)
            done += area
        out = F.when(curve == i, at).otherwise(out)
    return out


def order_key() -> Column:
    """Where a document stands in its source's stream: md5 of doc_id and of the text's md5, so that documents of one doc_id
    or none don't stand together."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary"))


def _mixed(docs: DataFrame, mix: Mix, keep_rows: bool) -> DataFrame:
    """What mix_sources returns, and passes: an array of (position, words, whole). In no order; with keep_rows a struct column
    row has the input's row, whatever its columns are called."""
    cols = [F.col("doc_id"), F.col("source"), words(F.col("text")).alias("size"), order_key().alias("key")]
    digits = max(1, round(math.log(max(docs.select(F.lit(1)).count(), 1), 16) / 2))
    keys = {"name": F.coalesce("source", F.lit("")), "unnamed": F.col("source").isNull(), "bucket": F.substring("key", 1, digits)}
    rows = docs.select(*cols, *([F.struct("*").alias("row")] if keep_rows else [])).withColumns(keys)
    bucket = ["unnamed", "name", "bucket"]
    within = W.partitionBy(*bucket).orderBy("key", "doc_id", "size")
    rows = rows.withColumn("inside", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size"))
    sums = docs.select(*cols).withColumns(keys).groupBy(*bucket, "source").agg(F.sum("size").alias("bucket_size"))
    before = W.partitionBy("unnamed", "name").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    goals = targets(sums.groupBy("source", "unnamed", "name").agg(F.sum("bucket_size").alias("source_size")).select("source", "source_size"), mix)
    goals = goals.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed"), "source_size", "curve", "target")
    starts = sums.withColumn("outside", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).select(*bucket, "outside").join(goals, ["unnamed", "name"])
    out = rows.join(starts, bucket).withColumn("start", F.col("inside") + F.col("outside"))

    def one(p: int) -> Column:
        at = F.col("start") + p * F.col("source_size")
        share = F.when(F.col("target") > 0, at / F.col("target")).otherwise(F.lit(2.0))
        got = F.greatest(F.least(F.floor("target") - at, F.col("size")), F.lit(0)).cast("long")
        whole = F.when(F.col("size") > 0, 2 * at + F.col("size") <= 2 * F.col("target")).otherwise(F.lit(p == 0))
        return F.struct(position(F.col("curve"), share, mix).alias("position"), got.alias("words"), whole.alias("whole"))

    out = out.withColumn("passes", F.array(*[one(p) for p in range(mix.max_passes)]))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    times = F.size(F.filter("passes", lambda x: x["whole"])).cast("long")
    first = F.col("passes")[0]["position"]
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), times.alias("times"), first.alias("position"), "passes", *(["row"] if keep_rows else []))


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, times, position; sorted by position.

    The order within a source is that of order_key. A source's stream is cut off exactly at its target, rounded down, so
    its last document may be taken in part: taken counts words. training_stream takes whole documents: times says how
    often, a pass counting if at least half of it lies before the cut. position: the training position of the first pass,
    null where the document isn't reached.

    Hot sources: a source's stream is cut into buckets by key; sums within buckets and sums of buckets are separate, and
    both have about the square root of the rows.

    Null text or empty text: size 0, taken 0. Very long texts: whole. Null source: a source of its own, last. Null doc_id:
    ordered by its text. Repeated rows: each is a document. No rows: no rows. Other columns are ignored.
    """
    return _mixed(docs, mix, False).drop("passes").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def training_stream(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents' own rows, one for each pass that is taken whole, range-sorted by training position. For nulls, ties and
    repeated rows see mix_sources."""
    passes = _mixed(docs, mix, True).select("row", F.explode("passes").alias("pass")).where("pass.whole")
    return passes.orderBy(F.col("pass.position").asc_nulls_last(), "row.doc_id").select("row.*")


def op1(spark, sf_dir: str) -> DataFrame:
    from .scratch import table

    return mix_sources(table(spark, sf_dir, "documents"))


def _position_sql(mix: Mix) -> str:
    """position() in SQL, over columns curve and share."""
    arms = []
    for i, knots in enumerate(mix.curves):
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        total, done = sum(areas), 0.0
        for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
            rest, slope = f"(share * {total!r}::DOUBLE - {done!r}::DOUBLE)", (w1 - w0) / (t1 - t0)
            inverse = f"{t0!r}::DOUBLE + {rest} * 2::DOUBLE / ({w0!r}::DOUBLE + sqrt(greatest({w0 * w0!r}::DOUBLE + {2 * slope!r}::DOUBLE * {rest}, 0::DOUBLE)))"
            before = f" AND share * {total!r}::DOUBLE < {done + area!r}::DOUBLE" if t1 < 1 else ""
            arms.append(f"WHEN curve = {i} AND share < 1 AND share * {total!r}::DOUBLE >= {done!r}::DOUBLE{before} THEN {inverse}")
            done += area
    return "CASE " + "\n    ".join(arms) + " END"


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS c FROM d GROUP BY source),
w AS (SELECT *, CASE c WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
    row_number() OVER (ORDER BY source ASC NULLS LAST) AS r FROM s),
f AS (SELECT *,
    coalesce(sum(source_size) OVER (ORDER BY source_size / CAST(weight AS DOUBLE), r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size_before,
    sum(weight) OVER (ORDER BY source_size / CAST(weight AS DOUBLE), r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
    sum(source_size) OVER () * 150 AS budget FROM w),
g AS (SELECT *, 200 * source_size * weight_left <= weight * (budget - 200 * size_before) AS is_full FROM f),
h AS (SELECT *, sum(CASE WHEN is_full THEN source_size ELSE 0 END) OVER () AS full_size,
    sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS open_weight FROM g),
t AS (SELECT source, source_size, c AS curve, CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE)
    ELSE CAST(weight * (budget - 200 * full_size) AS DOUBLE) / CAST(100 * open_weight AS DOUBLE) END AS target FROM h),
o AS (SELECT d.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),
p AS (SELECT o.doc_id, o.size, o.start, t.source_size, t.target, t.curve,
    CASE WHEN t.target > 0 THEN CAST(o.start AS DOUBLE) / t.target ELSE 2::DOUBLE END AS share
    FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
    CAST(greatest(least(CAST(floor(target) AS BIGINT) - start, size), 0)
       + greatest(least(CAST(floor(target) AS BIGINT) - start - source_size, size), 0) AS BIGINT) AS taken,
    CAST(CASE WHEN size = 0 THEN 1 ELSE (2 * start + size <= 2 * target)::BIGINT + (2 * (start + source_size) + size <= 2 * target)::BIGINT END AS BIGINT) AS times,
    {_position_sql(Mix())} AS position
FROM p
"""
