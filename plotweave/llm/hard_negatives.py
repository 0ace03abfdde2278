"""Hard-negative mining by a two-dimensional block matrix product.

Rows and anchors are packed into panels of SIDE vectors, cut into chunks of CHUNK dimensions. Each pair of an anchor panel and a row
panel is a tile; its chunks are multiplied apart, the partial tiles are shuffled to one place and added, and each tile gives on
only the top k that an anchor, or a window of an anchor and a positive, can still want. Panels are in order of labels, so that
the first of two passes, which finds positives, touches only tiles in which labels meet, and the second only the others.

Products are float64 where that is exact (all sums below 2**53), else 64-bit integers; both give the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import Scratch, parts, table, trimmed
from .vectors import SCALE, integers, longest, whole

#: Vectors in a panel, dimensions in a chunk, row panels that meet an anchor panel in one place.
SIDE, CHUNK, GROUP = 512, 32, 8
#: Bytes of partial tiles that a shuffle partition should have.
SHUFFLED = 64 << 20
#: Stands for a null vec_id, which is larger than any other.
_NULL = np.iinfo(np.int64).max
#: Less than any score of rows. Scores stay below 2**55, so that their hundredfold fits into 64 bits.
_NONE = -(1 << 56)


@dataclass(frozen=True)
class Mining:
    """The first `positives` of an anchor's label; for each the first `negatives` with low * positive <= 100 * negative <= high * positive."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100


def _packed(x: np.ndarray) -> bytes:
    """x in the narrowest integers that hold it, after their size."""
    for size in (1, 2, 4, 8):
        limit = 1 << (8 * size - 1)
        if size == 8 or not x.size or -limit <= x.min() and x.max() < limit:
            return bytes([size]) + np.ascontiguousarray(x, f"<i{size}").tobytes()
    raise AssertionError


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).reshape(-1, width).astype(np.int64)


_PANEL = "panel long, chunk int, low long, high long, data binary"


def _panels(side: int, chunk: int, width: int, most: int):
    """Rows in order of labels -> a panel's chunks, and as chunk -1 what is known of its rows: vec_id, label, place."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, n = TaskContext.get().partitionId() << 32, [], 0

        def out(batch: pa.Table, number: int) -> pa.RecordBatch:
            ids = batch["vec_id"].combine_chunks().fill_null(_NULL).to_numpy()
            by_id = np.argsort(ids, kind="stable")
            label = batch["label"].combine_chunks().to_numpy()[by_id]
            place = batch["place"].combine_chunks().to_numpy()[by_id]
            x = integers(batch["embedding"].combine_chunks(), width, most)[by_id]
            cut = [_packed(np.stack([ids[by_id], label, place], 1))] + [_packed(x[:, at : at + chunk]) for at in range(0, width, chunk)]
            k = len(cut)
            return pa.RecordBatch.from_arrays([pa.array([number] * k, pa.int64()), pa.array(range(-1, k - 1), pa.int32()), pa.array([int(label.min())] * k, pa.int64()), pa.array([int(label.max())] * k, pa.int64()), pa.array(cut, pa.binary())], ["panel", "chunk", "low", "high", "data"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= side:
                rows = pa.Table.from_batches(held)
                yield out(rows.slice(0, side), block)
                rest = rows.slice(side)
                held, n, block = rest.to_batches(), rest.num_rows, block + 1
        if n:
            yield out(pa.Table.from_batches(held), block)

    return trimmed(pack)


def _partial(chunk: int, width: int):
    """Pairs of panel chunks -> partial tiles; of chunks -1, what is known of both."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = batch["windows"]
            for i in range(batch.num_rows):
                c, a, r = batch["chunk"][i].as_py(), batch["a_data"][i].as_py(), batch["r_data"][i].as_py()
                if c < 0:
                    w = np.array([(x["place"], x["positive"], x["score"]) for x in windows[i].as_py() or ()], np.int64)
                    data = len(a).to_bytes(8, "little") + len(r).to_bytes(8, "little") + a + r + _packed(w.reshape(-1, 3))
                else:
                    size = min(chunk, width - c * chunk)
                    x, y = _unpacked(a, size), _unpacked(r, size)
                    if int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * size < 1 << 53:
                        data = _packed((x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64))
                    else:
                        data = _packed(x @ y.T)
                yield pa.RecordBatch.from_arrays([batch["a_panel"].slice(i, 1), batch["r_group"].slice(i, 1), batch["r_panel"].slice(i, 1), pa.array([c], pa.int32()), pa.array([data], pa.binary())], ["a_panel", "r_group", "r_panel", "chunk", "data"])

    return trimmed(multiply)


def _first(keys: np.ndarray, k: int) -> np.ndarray:
    """The first k rows of each run of equal keys."""
    starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
    return np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys)))) < k


_FOUND = "a_panel long, anchor long, anchor_id long, positive int, score long, vec_id long, place long"


def _reduce(mining: Mining, second: bool):
    """Partial tiles, those of an anchor panel and of a tile next to each other -> the best of each anchor among its label's rows,
    or in the second pass of each window among the others."""

    def best_of(scores: np.ndarray, head: bytes) -> np.ndarray:
        """Columns of _FOUND without a_panel."""
        a_size, r_size = int.from_bytes(head[:8], "little"), int.from_bytes(head[8:16], "little")
        a, r, windows = (_unpacked(x, 3) for x in (head[16 : 16 + a_size], head[16 + a_size : 16 + a_size + r_size], head[16 + a_size + r_size :]))
        same = a[:, 1][:, None] == r[:, 1]
        if not second:
            same &= a[:, 2][:, None] != r[:, 2]
        s = np.where(same ^ second, scores, _NONE)
        order = np.argsort(-s, axis=1, kind="stable")  # rows of a panel are in order of vec_id
        if not second:
            col = order[:, : mining.positives]
            row, positive = np.repeat(np.arange(len(a)), col.shape[1]), np.zeros(col.size, np.int64)
            col = col.ravel()
        else:
            by_place = np.argsort(a[:, 2])
            at = by_place[np.searchsorted(a[by_place, 2], windows[:, 0])]
            s_sorted, least, most = np.take_along_axis(s, order, 1), mining.low * windows[:, 2][:, None], mining.high * windows[:, 2][:, None]
            to = (100 * s_sorted[at] > most).sum(1)[:, None] + np.arange(mining.negatives)
            fits, to = to < s.shape[1], np.minimum(to, s.shape[1] - 1)
            fits &= 100 * s_sorted[at[:, None], to] >= least
            row, positive, col = np.repeat(at, mining.negatives)[fits.ravel()], np.repeat(windows[:, 1], mining.negatives)[fits.ravel()], order[at[:, None], to][fits]
        value = s[row, col]
        found = np.stack([a[row, 2], a[row, 0], positive, value, r[col, 0], r[col, 2]], 1)
        return found[value > _NONE]

    def merged(found: list[np.ndarray]) -> np.ndarray:
        x = np.concatenate(found)
        if not len(x):
            return x
        x = x[np.lexsort((x[:, 5], x[:, 4], -x[:, 3], x[:, 2], x[:, 0]))]
        return x[_first(x[:, [0, 2]], mining.negatives if second else mining.positives)]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        panel, tile, head, scores, best = None, None, None, None, []

        def flush():
            if best and len(x := merged(best)):
                cols = [pa.array(np.full(len(x), panel)), *(pa.array(x[:, i]) for i in range(6))]
                cols[3] = cols[3].cast(pa.int32())
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _FOUND.split(", ")])

        for batch in batches:
            for a, t, c, data in zip(*(batch[n] for n in ("a_panel", "r_panel", "chunk", "data"))):
                a, t, c, data = a.as_py(), t.as_py(), c.as_py(), data.as_py()
                if (a, t) != (panel, tile) and scores is not None:
                    best = [merged([*best, best_of(scores, head)])]
                    scores = None
                if a != panel:
                    yield from flush()
                    best = []
                panel, tile = a, t
                if c < 0:
                    head = data
                    width = (int.from_bytes(head[8:16], "little") - 1) // head[16 + int.from_bytes(head[:8], "little")] // 3
                else:
                    part = _unpacked(data, width)
                    scores = part if scores is None else scores + part
        if scores is not None:
            best = [merged([*best, best_of(scores, head)])]
        yield from flush()

    return trimmed(reduce)


@dataclass(frozen=True)
class _Grid:
    """How tiles are dealt out: row panels by groups, which the anchor panels visit, and partial tiles over partitions."""

    mining: Mining
    chunk: int
    width: int
    groups: int
    partitions: int

    def best(self, anchors: DataFrame, rows: DataFrame, windows: DataFrame | None) -> DataFrame:
        """_FOUND and rank: the best of the tiles in which labels meet, or, with windows (a_panel, windows), of those that have others."""
        second, mining, kind = windows is not None, self.mining, "array<struct<place:long,positive:int,score:long>>"
        own = lambda df, p: df.select(F.col("panel").alias(f"{p}_panel"), "chunk", F.col("low").alias(f"{p}_low"), F.col("high").alias(f"{p}_high"), F.col("data").alias(f"{p}_data"))
        a = own(anchors, "a").join(windows, "a_panel") if second else own(anchors, "a").withColumn("windows", F.lit(None).cast(kind))
        a = a.withColumn("windows", F.when(F.col("chunk") < 0, F.col("windows"))).withColumn("r_group", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))))
        r = own(rows, "r").withColumn("r_group", F.pmod(F.xxhash64("r_panel"), F.lit(self.groups)).cast("int"))
        meet = (F.col("a_low") <= F.col("r_high")) & (F.col("r_low") <= F.col("a_high"))
        one_label = (F.col("a_low") == F.col("a_high")) & (F.col("r_low") == F.col("r_high")) & (F.col("a_low") == F.col("r_low"))
        # An anchor panel has a copy for each group, which Spark's estimate of its size leaves out: never a broadcast.
        pairs = a.hint("merge").join(r.hint("merge"), ["r_group", "chunk"]).where(~one_label if second else meet).select("a_panel", "r_group", "r_panel", "chunk", "a_data", "r_data", "windows")
        tiles = pairs.mapInArrow(_partial(self.chunk, self.width), "a_panel long, r_group int, r_panel long, chunk int, data binary")
        placed = tiles.repartition(self.partitions, "a_panel", "r_group").sortWithinPartitions("a_panel", "r_panel", "chunk")
        order = W.partitionBy("anchor", "positive").orderBy(F.col("score").desc(), "vec_id", "place")
        found = placed.mapInArrow(_reduce(mining, second), _FOUND).withColumn("rank", F.row_number().over(order))
        return found.where(F.col("rank") <= (mining.negatives if second else mining.positives))


def hard_negatives(vectors: DataFrame, is_anchor: Column, mining: Mining = Mining(), side: int = SIDE, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from vectors (vec_id, label, embedding).

    Rows with a null label, a null vector or null, infinite or NaN components take no part. Labels are whole numbers. A score
    is the integer inner product of floor(256 x); vectors of different lengths are filled up with zeros. Higher scores come
    first, ties by smaller vec_id, null vec_ids last. Repeated rows are rows of their own: one may be the positive of another,
    and an anchor that occurs twice has its result twice. is_anchor is a condition on vec_id and label; null is false. No
    rows, no anchors, no positives or none in the window: no rows. Other columns are ignored. Vectors so large that scores
    leave 55 bits raise ValueError.

    No label, however large, is one task: rows of a label are dealt to panels by a hash, and tiles by panels.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = vectors.where(F.col("label").isNotNull() & whole()).select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    n, size = longest(rows)
    width = max(1, size)
    most = int((2**55 / width) ** 0.5)
    held = scratch.write(rows.withColumn("place", F.monotonically_increasing_id()).withColumn("anchor", F.coalesce(is_anchor, F.lit(False))), "held")

    def panels(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        count, order = df.count(), ("label", "salt")
        dealt = df.withColumn("salt", F.xxhash64("place")).repartitionByRange(max(1, -(-count // (side * GROUP))), *order).sortWithinPartitions(*order)
        return scratch.write(dealt.select("vec_id", "label", "place", "embedding").mapInArrow(_panels(side, chunk, width, most), _PANEL), name), count

    (r, n), (a, n_anchors) = panels(held, "rows"), panels(held.where("anchor"), "anchors")
    grid = _Grid(mining, chunk, width, max(1, n // (side * GROUP)), max(parts(spark), -(-n * n_anchors * 4 * -(-width // chunk) // SHUFFLED)))
    positives = scratch.write(grid.best(a, r, None).withColumnRenamed("rank", "positive_rank"), "positives")
    window = F.struct(F.col("anchor").alias("place"), F.col("positive_rank").cast("int").alias("positive"), "score")
    windows = positives.where("score >= 0").groupBy("a_panel").agg(F.collect_list(window).alias("windows"))  # side * positives at most
    negatives = grid.best(a, r, windows)
    named = lambda c: F.when(F.col(c) < _NULL, F.col(c))
    mine = positives.select("anchor", F.col("positive_rank").alias("positive"), "anchor_id", named("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = negatives.select("anchor", "positive", "rank", named("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return mine.join(found, ["anchor", "positive"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.w, b.w) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""
