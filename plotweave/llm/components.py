"""Connected components by hooking, pointer jumping and contraction. Links and labels stay in tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch, hot_join

#: Once so few links are left between components, one task joins them in memory (some 40 MB). More links are contracted first.
LOCAL_LINKS = 200_000


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links -> id, root: the smallest id of its component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for batch in batches:
        for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist()):
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    ids = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], ["id", "root"])


def components(links: DataFrame, scratch: Scratch, name: str, local_links: int = LOCAL_LINKS) -> DataFrame:
    """links (x, y) of longs -> table (id, root): each linked id and the smallest id that it is connected with.

    While there are many links, each round every component hooks onto its smallest neighbour, chains of hooks are halved,
    and links within a component go. Every row is joined by hot_join, so a node with a third of all links doesn't fill a task.
    """
    tidy = lambda df: df.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    solved = lambda df: df.coalesce(1).mapInArrow(_solve, "id long, root long")
    links = scratch.write(tidy(links), f"{name}-links0")
    many = links.limit(local_links + 1).count()
    if many <= local_links:
        return scratch.write(solved(links), f"{name}-roots")
    ids = links.select(F.col("x").alias("id")).union(links.select("y")).distinct()
    roots = scratch.write(ids.withColumn("root", F.col("id")), f"{name}-roots0")

    def moved(df: DataFrame, c: str, hooks: DataFrame, step: str) -> DataFrame:
        """df with c replaced by where it hooks, if it does."""
        weight = df.groupBy(F.col(c).alias("_at")).agg(F.count("*").alias("_n")).join(hooks.select(F.col("node").alias("_at"), F.col("up").alias("_to")), "_at", "left")
        moves = scratch.write(weight.select(F.col("_at").alias(c), "_n", F.coalesce("_to", "_at").alias("_to")), f"{name}-moves{step}{c}")
        return hot_join(df, moves, [c], "_n").drop(c, "_n").withColumnRenamed("_to", c).select(*df.columns)

    step = 0
    while many > local_links:
        step += 1
        hooks = scratch.write(links.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("up")), f"{name}-hooks{step}")
        for half in "ab":
            hooks = scratch.write(moved(hooks, "up", hooks, f"{step}{half}"), f"{name}-hooks{step}{half}")
        roots = scratch.write(moved(roots, "root", hooks, str(step)), f"{name}-roots{step}")
        half = scratch.write(moved(links, "x", hooks, str(step)), f"{name}-half{step}")
        links = scratch.write(tidy(moved(half, "y", hooks, str(step))), f"{name}-links{step}")
        many = links.limit(local_links + 1).count()
    if many:
        last = scratch.write(solved(links).select(F.col("id").alias("node"), F.col("root").alias("up")), f"{name}-last")
        roots = scratch.write(moved(roots, "root", last, "last"), f"{name}-roots")
    return roots
