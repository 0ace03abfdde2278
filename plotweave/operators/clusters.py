"""Clustering under cannot-link constraints, and what is picked from clusters by distance.

Constraints are never needed as pairs here. Chains with equal keys and different signatures exclude each other, so the number
of conflicts of a chain with a cluster is the cluster's count of its keys less that of its signature (see chains).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import cosine, distance, norm, squared_distance
from ..sources.tables import passing, percentiles, ranked, ready, staged, unstaged
from .assign import STEP, distances, in_chunks, penalised, repaired, vectors, with_closest, within
from .quality import centroids, each_two_blocks, matrix, near_blocks, to_centroids
from .sampling import drawn

#: Points of a block of pairs. A point is sent to as many places as its group has blocks.
BLOCK = 2048
#: Bins of a pass over distances, and the number of pairs from which their distances are collected by value.
BINS, FEW_PAIRS = 1 << 16, 1 << 18
#: Starts of k-means at a time.
STARTS = 4

# Picking by distance


def closest_share(points: DataFrame, centers: DataFrame, percent: float, order: str = "id") -> DataFrame:
    """The percent % of each cluster's points that lie closest to its centre, one at least; adds distance and rank."""
    d = to_centroids(points, centers).withColumn("distance", F.sqrt("d2")).drop("d2")
    near = ranked(d, ["cluster"], "distance", order, size="_n")
    return near.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * percent / 100))).drop("_n")


def density_ranks(points: DataFrame, centers: DataFrame) -> DataFrame:
    """cluster, mean_distance, density_rank from 0, densest first; empty clusters last. One row for each cluster."""
    mean = to_centroids(points, centers).groupBy("cluster").agg(F.avg(F.sqrt("d2")).alias("mean_distance"))
    rows = centers.select("cluster").join(mean, "cluster", "left")
    return rows.withColumn("density_rank", F.row_number().over(W.orderBy(F.col("mean_distance").asc_nulls_last(), "cluster")) - 1)


def density_strata(ranks: DataFrame) -> DataFrame:
    """Adds stratum: high before n // 4, low from 3n // 4, medium between."""
    n = F.count("*").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    r = F.col("density_rank")
    return ranks.withColumn("stratum", F.when(r < F.floor(n / 4), "high").when(r >= F.floor(3 * n / 4), "low").otherwise("medium"))


def nearest(points: DataFrame, centers: DataFrame) -> DataFrame:
    """Adds nearest and d2: the closest centre, ties to the smaller cluster. Centres (k rows) go to the workers as a matrix."""
    ready(points.sparkSession)
    rows = centers.select("cluster", "center").orderBy("cluster").collect()  # k rows
    return with_closest(points, np.array([r.center for r in rows], float), [r.cluster for r in rows], "nearest", centers.schema["cluster"].dataType)


def nearest_clusters(centers: DataFrame) -> DataFrame:
    """cluster, other, distance, rank: a cluster's other clusters by the distance of centres. k² rows."""
    a, b = centers.select("cluster", "center"), centers.select(F.col("cluster").alias("other"), F.col("center").alias("_o"))
    d = a.crossJoin(F.broadcast(b)).where("cluster <> other").withColumn("distance", distance("center", "_o")).drop("center", "_o")
    return d.withColumn("rank", F.row_number().over(W.partitionBy("cluster").orderBy("distance", "other")))


def eligible(points: DataFrame, centers: DataFrame, percentile: float) -> DataFrame:
    """Points whose distance to their own centre is at most the percentile of all such distances."""
    d = staged(to_centroids(points, centers).withColumn("distance", F.sqrt("d2")).drop("d2"))
    return d.crossJoin(F.broadcast(percentiles(d, [], "distance", percentile / 100).withColumnRenamed("limit", "threshold"))).where("distance <= threshold")  # one row


def pairwise_threshold(points: DataFrame, percentile: float, block: int = BLOCK) -> float | None:
    """The percentile of the distances of all pairs of points, linear between two of them.

    Pairs are entries of matrices of two blocks. A pass counts squared distances by bins; the bin that holds the wanted one is
    cut into bins by the next pass, until few pairs are left or rounding could decide. What is left is computed from
    differences and counted by value, with the least of those beyond. So no pass holds more than its bins, whatever the number
    of pairs.
    """
    rows = points.select("id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    n, norm2 = rows.agg(F.count("*"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).first()
    if n < 2:
        return None
    dims = len(rows.first().vector)
    pairs, top = n * (n - 1) // 2, 4 * norm2
    err = 16 * (dims + 4) * 2.0**-53 * norm2 + 1e-300  # of a squared distance by a matrix product
    at = percentile / 100 * (pairs - 1)
    rank = int(np.floor(at))
    low, high, left = -err, top + err, pairs
    while left > FEW_PAIRS and high - low > 64 * err:
        edges = np.linspace(low, high, BINS + 1)
        counts, _ = _distance_counts(rows, block, low, high, edges)
        bins = np.zeros(BINS, np.int64)
        below = counts.pop(-1, 0)
        for i, c in counts.items():
            bins[int(i)] = c
        i, width = int(np.searchsorted(below + np.cumsum(bins), rank, side="right")), high - low
        left, low, high = int(bins[i]), edges[i] - 2 * err, edges[i + 1] + 2 * err
        if high - low > 0.5 * width:
            break
    counts, beyond = _distance_counts(rows, block, low, high, None, 2 * err)
    below = counts.pop(-1, 0)
    values = np.sort(np.array(list(counts), float))
    upto = below + np.cumsum([counts[v] for v in values])
    i = int(np.searchsorted(upto, rank, side="right"))
    x = float(np.sqrt(values[i]))
    y = x if at == rank or rank + 1 < upto[i] else float(np.sqrt(values[i + 1] if i + 1 < len(values) else beyond))
    return x + (y - x) * (at - rank)


def _distance_counts(rows: DataFrame, block: int, low: float, high: float, edges: np.ndarray | None, slack: float = 0.0) -> tuple[dict, float | None]:
    """How many pairs have a squared distance below low (at -1), and how many of those up to high lie in each bin between edges,
    or without edges have each value; then also the least value beyond, of pairs that slack doesn't rule out."""

    def count(own, others):
        import pyarrow as pa

        x = matrix(own)
        y = x if others is None else matrix(others)
        x2, y2 = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
        below, bins, found, beyond = 0, np.zeros(0 if edges is None else len(edges) - 1, np.int64), {}, np.inf
        for at in range(0, len(x), STEP):
            for to in range(at if others is None else 0, len(y), 8 * STEP):
                a, b = x[at : at + STEP], y[to : to + 8 * STEP]
                d = x2[at : at + STEP, None] + y2[to : to + 8 * STEP] - 2 * (a @ b.T)
                real = np.ones(d.shape, bool) if others is not None else np.arange(at, at + len(a))[:, None] < np.arange(to, to + len(b))
                below += int((real & (d < low)).sum())
                inside = real & (d >= low) & (d <= high)
                if edges is not None:
                    place = ((d[inside] - low) * (len(bins) / (high - low))).astype(np.int64)
                    bins += np.bincount(np.clip(place, 0, len(bins) - 1), minlength=len(bins))
                else:
                    i, j = np.nonzero(inside)
                    over = np.where(real & (d > high), d, np.inf)
                    if len(over) and np.isfinite(least := over.min()) and least <= beyond + slack:
                        p, q = np.nonzero(over <= least + slack)
                        for k in range(0, len(p), 1 << 16):
                            beyond = min(beyond, float(((a[p[k : k + (1 << 16)]] - b[q[k : k + (1 << 16)]]) ** 2).sum(1).min()))
                    for k in range(0, len(i), 1 << 16):
                        values, n = np.unique(((a[i[k : k + (1 << 16)]] - b[j[k : k + (1 << 16)]]) ** 2).sum(1), return_counts=True)
                        for v, c in zip(values.tolist(), n.tolist()):
                            found[v] = found.get(v, 0) + c
        some = np.flatnonzero(bins)
        keys, n = (some.astype(float).tolist(), bins[some].tolist()) if edges is not None else (list(found), list(found.values()))
        return pa.table({"at": pa.array([-1.0, *keys], pa.float64()), "n": pa.array([below, *n], pa.int64()), "beyond": pa.array([beyond] * (1 + len(n)), pa.float64())})

    told = each_two_blocks(rows, block, ["id", "vector"], count, "at double, n long, beyond double")
    got = told.groupBy("at").agg(F.sum("n").alias("n"), F.min("beyond").alias("beyond")).collect()  # a row for each bin, or for each of few values
    return {x["at"]: x["n"] for x in got}, min((x["beyond"] for x in got), default=None)


def near_anchors(points: DataFrame, centers: DataFrame, threshold: float, least_cosine: float) -> DataFrame:
    """Points near their centre: squared distance at most the cluster's percentile threshold (below 1) or the value itself,
    and cosine at least least_cosine."""
    c = points.join(F.broadcast(centers.select("cluster", "center")), "cluster").withColumns({"d2": squared_distance("vector", "center"), "cos": cosine("vector", "center", zero=0.0)}).drop("center")
    if threshold < 1:
        c = staged(c)
        c = c.join(F.broadcast(percentiles(c, ["cluster"], "d2", threshold)), "cluster").where("d2 <= limit").drop("limit")  # a row for each cluster
    else:
        c = c.where(F.col("d2") <= threshold)
    return c.where(F.col("cos") >= least_cosine)


def carried_centers(old_points: DataFrame, new_vectors: DataFrame, centers: DataFrame, share: float) -> DataFrame:
    """cluster, center: the mean, among new_vectors (id, vector), of the old points nearest to each old centre: share of all
    points of the cluster, 3 to 100 of them."""
    d = ranked(to_centroids(old_points, centers).select("id", "cluster", "d2"), ["cluster"], "d2", "id", name="_r", size="_n")
    near = d.where(F.col("_r") <= F.greatest(F.lit(3), F.least(F.lit(100), F.floor(F.col("_n") * share)))).select("id", "cluster")
    return centroids(near.join(new_vectors.select("id", "vector"), "id")).select("cluster", "center")


# Mining training pairs


def mined_pairs(points: DataFrame, *, same_pos: float = 0.75, same_neg: float = 0.5, other_pos: float = 0.675, neighbours: int | None = None, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """anchor, kind, other, similarity from points (id, cluster, vector, keys, signature).

    same_pos: the most similar of the cluster that doesn't exclude the anchor; same_neg: the most similar that does;
    other_pos: the most similar from other clusters that doesn't; other_neg: the least similar of those. With neighbours,
    other clusters are so many points only, drawn by hash, the same for all anchors. The first three must pass their
    thresholds. Ties go to the smaller id. Within a cluster only pairs above the lower of the two thresholds matter: as unit vectors they lie
    within a radius, and blocks that lie farther apart are skipped (see quality.near_blocks). Each block's best go on.
    """
    near = near_pairs(points, same_pos=same_pos, same_neg=same_neg, block=block)
    return near.unionByName(far_pairs(points, other_pos=other_pos, neighbours=neighbours, seed=seed, block=block))


def _minable(points: DataFrame) -> DataFrame:
    return points.select("id", "cluster", F.col("vector").cast("array<double>").alias("vector"), "keys", "signature")


def near_pairs(points: DataFrame, *, same_pos: float = 0.75, same_neg: float = 0.5, block: int = BLOCK) -> DataFrame:
    """The part of mined_pairs() with both points in one cluster."""
    kind = dict(points.dtypes)["id"]
    rows = _minable(points)

    def best_of(own, others):
        import pyarrow as pa

        x, y = matrix(own), matrix(others)
        out = ([], [], [], [])
        if len(x) and len(y):
            unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)
            sim = unit(x) @ unit(y).T
            a, b = own["id"].to_numpy(), others["id"].to_numpy()
            order = np.argsort(b, kind="stable")
            codes = {c: np.unique(np.array([v or "" for v in own[c].to_pylist() + others[c].to_pylist()]), return_inverse=True)[1] for c in ("keys", "signature")}
            (k, keys), (s, signs) = ((v[: len(a)], v[len(a) :][order]) for v in codes.values())
            known, b = own["keys"].combine_chunks().is_valid().to_numpy(zero_copy_only=False), b[order]
            there = others["keys"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)[order]
            signed = [t["signature"].combine_chunks().is_valid().to_numpy(zero_copy_only=False) for t in (own, others)]
            s, signs = np.where(signed[0], s, -1), np.where(signed[1][order], signs, -1)
            for at in range(0, len(a), 256):
                some, i = sim[at : at + 256][:, order], slice(at, at + 256)
                bad = (k[i, None] == keys) & (s[i, None] != signs) & known[i, None] & there
                self_ = a[i, None] == b
                for name, fits in (("same_pos", ~bad & ~self_), ("same_neg", bad & ~self_)):
                    value = np.where(fits, some, -np.inf)
                    best = value.argmax(1)
                    hit = np.flatnonzero(fits.any(1))
                    for column, values in zip(out, (a[i][hit], [name] * len(hit), b[best[hit]], value[hit, best[hit]])):
                        column.extend(values)
        ids = own["id"].type
        return pa.table([pa.array(out[0], ids), pa.array(out[1], pa.string()), pa.array(out[2], ids), pa.array(out[3], pa.float64())], ["anchor", "kind", "other", "similarity"])

    least = min(same_pos, same_neg)
    length = norm(F.col("vector"))
    unit = rows.withColumn("vector", F.when(length > 0, F.transform("vector", lambda x: x / length)).otherwise(F.col("vector")))
    # A vector of zeros has similarity 0 with all others, so it must meet them if that passes a threshold.
    radius = float(np.sqrt(max(0.0, 2 - 2 * least))) if least >= 0 else np.inf
    near, _ = near_blocks(unit, radius, block, ["cluster"], rows.columns, best_of, f"anchor {kind}, kind string, other {kind}, similarity double")
    first = F.min(F.struct((-F.col("similarity")).alias("s"), "other")).alias("p")
    near = near.groupBy("anchor", "kind").agg(first).select("anchor", "kind", F.col("p.other").alias("other"), (-F.col("p.s")).alias("similarity"))
    return near.where(F.col("similarity") > F.when(F.col("kind") == "same_pos", same_pos).otherwise(same_neg))


def far_pairs(points: DataFrame, *, other_pos: float = 0.675, neighbours: int | None = None, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """The part of mined_pairs() with points of other clusters."""
    rows = _minable(points).where("cluster IS NOT NULL")
    far = _far_in_blocks(rows, block) if neighbours is None else _far_of_drawn(rows, neighbours, seed)
    pos = F.struct(F.lit("other_pos").alias("kind"), F.col("p.other").alias("other"), (-F.col("p.s")).alias("similarity"))
    neg = F.struct(F.lit("other_neg").alias("kind"), F.col("n.other").alias("other"), F.col("n.s").alias("similarity"))
    found = far.select("anchor", F.explode(F.array(F.when(-F.col("p.s") > other_pos, pos), F.when(F.col("n").isNotNull(), neg))).alias("x"))
    return found.where("x IS NOT NULL").select("anchor", "x.*")


def _far_of_drawn(rows: DataFrame, neighbours: int, seed: int) -> DataFrame:
    """anchor, p (-similarity, other), n (similarity, other): of so many points by hash, the best that an anchor may meet and the
    worst of all, in other clusters."""
    a = rows.select(F.col("id").alias("anchor"), F.col("cluster").alias("c"), F.col("vector").alias("v"), F.col("keys").alias("k"), F.col("signature").alias("s"))
    sample = F.broadcast(rows.withColumnRenamed("id", "other").orderBy(*drawn("other", seed)).limit(neighbours))
    bad = F.coalesce((F.col("k") == F.col("keys")) & (F.col("s") != F.col("signature")), F.lit(False))
    far = a.join(sample, F.col("c") != F.col("cluster")).select("anchor", "other", cosine("v", "vector", zero=0.0).alias("sim"), bad.alias("bad"))
    most, least = F.struct((-F.col("sim")).alias("s"), "other"), F.struct(F.col("sim").alias("s"), "other")
    return far.groupBy("anchor").agg(F.min(F.when(~F.col("bad"), most)).alias("p"), F.min(least).alias("n"))


def _far_in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """What _far_of_drawn() gives of all points. A matrix of two blocks screens for both of them; pairs that rounding can't tell
    from the best are computed one dimension after the other, so that equal vectors are equally similar wherever they lie."""
    kind = dict(rows.dtypes)["id"]

    def best_of(own, others):
        import pyarrow as pa

        tables = [t.sort_by("id") for t in ((own,) if others is None else (own, others))]
        xs, out = [matrix(t) for t in tables], ([], [], [], [])
        if all(len(x) for x in xs):
            codes = []
            for c in ("cluster", "keys", "signature"):
                names: dict = {}
                codes.append([np.array([-1 if v is None else names.setdefault(v, len(names)) for v in t[c].to_pylist()], np.int64) for t in tables])
            ids = [t["id"].to_numpy() for t in tables]
            size = [sum((x[:, j] * x[:, j] for j in range(x.shape[1])), np.zeros(len(x))) for x in xs]
            units = [x / np.sqrt(np.where(n > 0, n, 1))[:, None] for x, n in zip(xs, size)]
            slack = 16 * (xs[0].shape[1] + 4) * 2.0**-53
            for m, o in ((0, 0),) if others is None else ((0, 1), (1, 0)):
                # Of others that no anchor can tell apart only the first is looked at.
                same = np.concatenate([xs[o], np.stack([c[o] for c in codes], 1)], 1)
                first = np.sort(np.unique(same, axis=0, return_index=True)[1])
                y, unit, n, (cluster, keys, signs), name = xs[o][first], units[o][first], size[o][first], [c[o][first] for c in codes], ids[o][first]
                for at in range(0, len(xs[m]), 256):
                    i = slice(at, at + 256)
                    sim = units[m][i] @ unit.T
                    off = (codes[0][m][i, None] == cluster)
                    k, s = codes[1][m][i, None], codes[2][m][i, None]
                    bad = (k == keys) & (k >= 0) & (s != signs) & (s >= 0) & (signs >= 0)
                    for what, value in (("p", np.where(off | bad, -np.inf, sim)), ("n", np.where(off, -np.inf, -sim))):
                        top = value.max(1, keepdims=True)
                        row, col = np.nonzero((value >= top - slack) & (top > -np.inf))
                        for part in np.array_split(np.arange(len(row)), len(row) // (1 << 18) + 1):
                            a, b = xs[m][at + row[part]], y[col[part]]
                            dot = sum((a[:, j] * b[:, j] for j in range(a.shape[1])), np.zeros(len(a)))
                            length = np.sqrt(size[m][at + row[part]] * n[col[part]])
                            exact = np.where(length > 0, dot / np.where(length > 0, length, 1), 0.0) * (-1 if what == "p" else 1)
                            order = np.lexsort((col[part], exact, row[part]))
                            best = order[np.flatnonzero(np.append(True, np.diff(row[part][order]) > 0))] if len(order) else order
                            for column, values in zip(out, (ids[m][at + row[part][best]], [what] * len(best), exact[best], name[col[part][best]])):
                                column.extend(values)
        ids = tables[0]["id"].type
        return pa.table([pa.array(out[0], ids), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64()), pa.array(out[3], ids)], ["anchor", "what", "s", "other"])

    rows = staged(rows)
    some = rows.where("vector IS NOT NULL")
    far = each_two_blocks(some, block, rows.columns, best_of, f"anchor {kind}, what string, s double, other {kind}")
    # Without a vector there is no similarity: all are alike, and the first stands for them.
    firsts = rows.groupBy(F.col("cluster").alias("_c")).agg(F.min("id").alias("other"))  # a row for each cluster
    blank = rows.where("vector IS NULL").join(F.broadcast(firsts), F.col("cluster") != F.col("_c")).groupBy(F.col("id").alias("anchor")).agg(F.min("other").alias("other"))
    far = far.unionByName(blank.select("anchor", F.lit("n").alias("what"), F.lit(None).cast("double").alias("s"), "other"))
    one = F.struct("s", "other")
    return far.groupBy("anchor").agg(F.min(F.when(F.col("what") == "p", one)).alias("p"), F.min(F.when(F.col("what") == "n", one)).alias("n"))


def balanced_pairs(pairs: DataFrame, ratio: float = 1.0, wanted: int | None = None, seed: int = 0) -> DataFrame:
    """mined_pairs with ratio positives for each negative; adds positive.

    Of the side that has too many, one pair of each anchor with both sides is kept first, in the order of a draw, then
    others. With wanted, at most so many pairs, both sides drawn evenly in that ratio.
    """
    rows = staged(pairs.withColumn("positive", F.col("kind").endswith("_pos")).withColumn("_h", F.md5(F.concat_ws(":", "anchor", "other", "kind", F.lit(seed)).cast("binary"))))
    n = {r.positive: r["count"] for r in rows.groupBy("positive").count().collect()}  # two rows
    pos, neg = n.get(True, 0), n.get(False, 0)
    if wanted is not None:
        total = min(wanted, pos + neg)
        keep = {True: int(total * ratio / (1 + ratio))}
        keep[False] = total - keep[True]
    else:
        keep = {True: min(pos, int(neg * ratio)), False: min(neg, int(pos / ratio))}
    both = rows.groupBy("anchor").agg((F.countDistinct("positive") == 2).alias("_both"))
    one = W.partitionBy("anchor", "positive").orderBy("_h")  # four rows at most
    first = (F.row_number().over(one) == 1) & F.col("_both") if wanted is None else F.lit(False)
    drawn = ranked(rows.join(both, "anchor").withColumn("_first", first), ["positive"], F.col("_first").desc(), "_h", name="_r")
    return drawn.where(F.col("_r") <= F.when(F.col("positive"), keep[True]).otherwise(keep[False])).drop("_h", "_both", "_first", "_r")


# Clustering


def kmeans(points: DataFrame, k: int, n_init: int = 10, max_iter: int = 300, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(assignment, centres) of the best of n_init starts by cost. Starts don't depend on each other, so STARTS of them run side by
    side, as the jobs of one leave most cores idle."""
    rows = staged(points.select("id", F.col("vector").cast("array<double>").alias("vector"), array_to_vector(F.col("vector").cast("array<double>")).alias("features")))
    spark = points.sparkSession
    fit = inheritable_thread_target(spark)(lambda i: KMeans(k=k, maxIter=max_iter, seed=seed + i, tol=1e-4).fit(rows))
    with ThreadPoolExecutor(STARTS) as pool:
        best = min(pool.map(fit, range(n_init)), key=lambda m: m.summary.trainingCost)
    centers = points.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(best.clusterCenters())], "cluster int, center array<double>")
    return best.transform(rows).select("id", F.col("prediction").alias("cluster")), centers


def constrained_seeds(points: DataFrame, k: int, w: float = 0.0, seed: int = 0) -> DataFrame:
    """cluster, id, center: constraint-aware k-means++. points: id, vector, keys, signature.

    The first centre is drawn evenly. Then a point's score is its squared distance to the nearest centre plus w for each
    chosen point that it excludes; chosen points score 0, and one is drawn by score (evenly over the rest if all are 0). With
    w = 0 this is plain k-means++. A draw is the point of largest log(u) / score, u from a hash of its id, so that one
    aggregation makes it.
    """
    rows = staged(points.select("id", F.col("vector").cast("array<double>").alias("vector"), "keys", "signature"))
    state = rows.withColumns({"d2": F.lit(None).cast("double"), "bonus": F.lit(0.0), "taken": F.lit(False)})
    chosen = []
    for i in range(min(k, rows.count())):
        u = (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(1 << 52)).cast("double") + 1) / float((1 << 52) + 1)
        score = F.coalesce("d2", F.lit(1.0)) + F.col("bonus")
        draw = F.struct((score > 0).alias("some"), (F.ln(u) / F.when(score > 0, score).otherwise(1.0)).alias("draw"), "id", "vector", "keys", "signature")
        got = state.where(~F.col("taken")).agg(F.max(draw).alias("x")).first().x
        chosen.append((i, got.id, list(got.vector)))
        near = squared_distance("vector", F.lit(list(got.vector)))
        excludes = (F.col("keys") == F.lit(got["keys"])) & (F.col("signature") != F.lit(got.signature))
        state = state.withColumns({"d2": F.least(F.coalesce("d2", near), near), "bonus": F.col("bonus") + F.when(excludes, w).otherwise(0.0), "taken": F.col("taken") | (F.col("id") == got.id)})
        if i % 5 == 4:
            state = staged(state)
    return points.sparkSession.createDataFrame(chosen, f"cluster int, id {dict(points.dtypes)['id']}, center array<double>")


@dataclass
class Fit:
    """A clustering: assignment (id, cluster), centres (cluster, center), cost, violations by iteration."""

    assignment: DataFrame
    centers: DataFrame
    cost: float
    violations: list[int] = field(default_factory=list)
    iterations: int = 0


_PAIRS = lambda n: n * (n - 1) / 2


def _violations(assigned: DataFrame, limit: float | None) -> int:
    """Cannot-link pairs within clusters of which both points are open. Without a limit of their distance in closed form; with
    one, pairs of a cluster's equal keys are compared, in blocks that the index doesn't rule out."""
    rows = assigned.where("open AND keys IS NOT NULL")
    if limit is None:
        groups = rows.groupBy("cluster", "keys", "signature").agg(F.count("*").alias("n"))
        each = groups.groupBy("cluster", "keys").agg((_PAIRS(F.sum("n")) - F.sum(_PAIRS(F.col("n")))).alias("v"))
        return int(each.agg(F.coalesce(F.sum("v"), F.lit(0)).cast("long")).first()[0])

    def count(own, others):
        import pyarrow as pa

        n = 0
        if len(own) and len(others):
            x, y, ids, names = matrix(own), matrix(others), others["id"].to_numpy(), {}
            mine, signs = (np.array([names.setdefault(s, len(names)) for s in t["signature"].to_pylist()]) for t in (own, others))
            for at in range(0, len(x), STEP):
                some = slice(at, at + STEP)
                n += int((within(x[some], y, limit) & (ids > own["id"].to_numpy()[some, None]) & (signs != mine[some, None])).sum())
        return pa.table({"n": pa.array([n], pa.int64())})

    pairs, _ = near_blocks(rows, limit, BLOCK, ["cluster", "keys"], ["id", "vector", "signature"], count, "n long")
    return int(pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def _start(points: DataFrame, centers: DataFrame | None, k: int, w: float, seed: int) -> tuple[DataFrame, np.ndarray]:
    """(rows, centres): the points' columns in a table, and the k centres to begin with."""
    ready(points.sparkSession)
    rows = staged(points.select("id", F.col("vector").cast("array<double>").alias("vector"), "keys", "signature"))
    centers = centers if centers is not None else constrained_seeds(rows, k, w, seed)
    return rows, np.array([r.center for r in centers.orderBy("cluster").collect()], float)  # k rows


def _held(rows: DataFrame) -> DataFrame:
    """rows kept by the executors, dealt by id: iterations read them again and join to them, and only what is joined moves."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id").persist()


def _moved(assigned: DataFrame, rows: DataFrame, table: np.ndarray) -> np.ndarray:
    """Means of the clusters; an empty one keeps its centre."""
    means = {r.cluster: r.center for r in centroids(assigned.select("id", "cluster").join(rows.select("id", "vector"), "id")).collect()}  # k rows
    return np.array([means.get(i, table[i]) for i in range(len(table))])


def _centers_of(spark, table: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(table)], "cluster int, center array<double>")


def weighted_pckmeans(points: DataFrame, k: int, w: float, *, centers: DataFrame | None = None, centroid_percentile: float = 100.0, pairwise_percentile: float | None = None, max_iter: int = 100, patience: int = 10, tol: float = 1e-4, seed: int = 0, mode: str = "exact", blocks: int = 64) -> Fit:
    """Constrained k-means with a penalty of w for each cannot-link pair in a cluster. points: id, vector, keys, signature.

    Each iteration assigns points by squared distance plus penalty, counts violations, and moves centres to means (an empty
    cluster keeps its own). Cost is the squared distances to the nearest centres before the move plus w for each violation;
    the best iteration is returned. It stops after patience iterations without a better cost, or once centres move less
    than tol.

    mode "exact": points see the choices of all points before them by id. As only those with equal keys matter, sets of keys
    are assigned apart from each other, and large ones in chunks of CHUNK points, by rounds (see assign.penalised). mode
    "blocks": points are dealt to so many blocks by hash and see only choices within their block. This is approximate.

    Points beyond the centroid percentile of distances neither pay nor cause penalties. Pairs whose distance lies beyond the
    pairwise percentile, that of all pairs, aren't constrained either; then the vectors of the
    earlier points of a set of keys are held, in one task for each set, and violations are counted pair by pair.
    """
    rows, table = _start(points, centers, k, w, seed)
    apart = None if pairwise_percentile is None else pairwise_threshold(rows, pairwise_percentile)
    rows, whole_rows = staged(_chunked(rows, mode, blocks, apart)), rows
    unstaged(whole_rows)
    table_of_rows, rows = rows, _held(rows)
    best, since, history = None, 0, []
    for iteration in range(max_iter):
        with passing() as kept:
            assigned = kept(staged(_assign(rows, table, w, centroid_percentile, apart)))
            if apart is not None and mode == "exact" and w:  # a pair counts where its later point chose
                history.append(int(assigned.agg(F.coalesce(F.sum("hits"), F.lit(0))).first()[0]))
            else:
                history.append(_violations(assigned if apart is None else assigned.join(rows.select("id", "vector"), "id"), apart))
            cost = (assigned.agg(F.sum("d2")).first()[0] or 0.0) + w * history[-1]
            new = _moved(assigned, rows, table)
        if best is None or cost < best[0]:
            if best:
                unstaged(best[1])
            best, since = (cost, assigned, new), 0
        else:
            unstaged(assigned)
            since += 1
        shift, table = float(((new - table) ** 2).sum()), new
        if since >= patience or iteration and shift < tol:
            break
    rows.unpersist()
    unstaged(table_of_rows)
    cost, assigned, table = best
    return Fit(assigned.select("id", "cluster"), _centers_of(points.sparkSession, table), cost, history, iteration + 1)


def _chunked(rows: DataFrame, mode: str, blocks: int, apart: float | None) -> DataFrame:
    """Adds chunk and scope: points choose after those of equal keys, and in mode "blocks" of their block."""
    out = rows.withColumn("chunk", F.lit(0)) if apart is not None or mode == "blocks" else in_chunks(rows)
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)) if mode == "blocks" else F.lit(0)
    return out.withColumn("scope", F.concat(block.cast("string"), F.lit(":"), F.col("keys")))


def _assign(rows: DataFrame, table: np.ndarray, w: float, percentile: float, apart: float | None) -> DataFrame:
    """id, keys, signature, cluster, d2 (to the nearest centre), open (within the percentile), and of penalised points hits."""
    k, columns = len(table), ["id", "keys", "signature", "cluster", "d2", "open"]
    scored = rows.withColumn("open", F.lit(True))
    if percentile < 100 or not w:
        near = with_closest(rows, table, list(range(k)), "cluster", "integer")
        if percentile < 100:
            near = staged(near)
            limit = percentiles(near.select(F.sqrt("d2").alias("d")), [], "d", percentile / 100).first()
            near = near.withColumn("open", F.sqrt("d2") <= F.lit(limit[0] if limit else None))
        else:
            near = near.withColumn("open", F.lit(True))
        if not w:
            return near.select(*columns)
        scored = near.drop("cluster", "d2")
    told = scored.select("id", "vector", "signature", "open", "chunk", F.col("scope").alias("keys"))
    return penalised(told, table, w, apart).withColumn("keys", F.expr("substring(keys, instr(keys, ':') + 1)")).select(*columns, "hits")


def _repairs(table: np.ndarray, whole: bool):
    """For mapInArrow over rows that come sorted by keys and id: the points of one set of keys are repaired together, as others
    can't conflict. whole: id, cluster, d2, hits of all points; else, for each cluster that the partition has points of, their
    number, the sum of their vectors, d2 and hits."""

    def run(batches):
        import pyarrow as pa

        at, held, k = None, [], len(table)
        number, total, cost, hit = np.zeros(k, np.int64), np.zeros(table.shape), np.zeros(k), np.zeros(k, np.int64)

        def done(ids, x, d, clusters, hits):
            if whole:
                yield pa.RecordBatch.from_arrays([ids, pa.array(clusters, pa.int32()), pa.array(d), pa.array(hits)], ["id", "cluster", "d2", "hits"])
                return
            np.add.at(number, clusters, 1)
            np.add.at(cost, clusters, d)
            np.add.at(hit, clusters, hits)
            for c in np.unique(clusters):
                total[c] += x[clusters == c].sum(0)

        def flush():
            if held:
                x, d, order, signs = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3, 4))
                clusters, hits = repaired(order, signs)
                yield from done(pa.concat_arrays([h[0] for h in held]), x, d, np.array(clusters), np.array(hits, np.int64))
                held.clear()

        for batch in batches:
            x = vectors(batch["vector"])
            d = distances(x, table)
            order, least = np.argsort(d, 1, kind="stable")[:, :3], d.min(1)
            keys = np.array(batch["keys"].to_pylist(), object)
            for some in np.split(np.arange(len(keys)), np.flatnonzero(keys[1:] != keys[:-1]) + 1) if len(keys) else ():
                if keys[some[0]] != at:
                    yield from flush()
                    at = keys[some[0]]
                ids = batch["id"].slice(some[0], len(some))
                if at is None:
                    yield from done(ids, x[some], least[some], order[some, 0], np.zeros(len(some), np.int64))
                else:
                    held.append((ids, x[some], least[some], order[some], np.array([str(s) for s in batch["signature"].slice(some[0], len(some)).to_pylist()])))
        yield from flush()
        if not whole:
            some = np.flatnonzero(number)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(number[some]), pa.array(total[some].tolist(), pa.list_(pa.float64())), pa.array(cost[some]), pa.array(hit[some])], ["cluster", "n", "total", "d2", "hits"])

    return run


def pckmeans_repair(points: DataFrame, k: int, *, centers: DataFrame | None = None, max_iter: int = 100, tol: float = 1e-4, seed: int = 0) -> Fit:
    """Nearest assignment, then the cannot-link pairs are repaired one after the other (see assign.repaired), until centres move
    at most tol. Sets of keys are repaired apart from each other, each in one task, in time linear in its points but for
    sorting; the task holds their vectors. Rows are dealt by keys once; an iteration is one pass over them, of which only the
    sums of each task's clusters move. The result is a last pass with the centres of the last iteration."""
    rows, table = _start(points, centers, k, 0.0, seed)
    kind, history = dict(rows.dtypes)["id"], []
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    free = F.when(F.col("keys").isNull(), F.xxhash64("id"))  # points without keys go anywhere
    dealt = rows.repartition(n, "keys", free).sortWithinPartitions("keys", "id").persist()
    for iteration in range(max_iter):
        used = table
        parts = dealt.mapInArrow(_repairs(used, False), "cluster int, n long, total array<double>, d2 double, hits long")
        sums = Summarizer.sum(array_to_vector("total"))
        found = parts.groupBy("cluster").agg(vector_to_array(sums).alias("total"), F.sum("n").alias("n"), F.sum("d2").alias("d2"), F.sum("hits").alias("hits")).collect()  # k rows
        history.append(sum(x.hits for x in found))
        table = used.copy()
        for x in found:
            table[x.cluster] = np.array(x.total) / x.n
        if float(np.sqrt(((table - used) ** 2).sum())) <= tol:
            break
    assigned = staged(dealt.mapInArrow(_repairs(used, True), f"id {kind}, cluster int, d2 double, hits long"))
    dealt.unpersist()
    unstaged(rows)
    cost = assigned.agg(F.sum("d2")).first()[0] or 0.0
    return Fit(assigned.select("id", "cluster"), _centers_of(points.sparkSession, table), cost, history, iteration + 1)


def sweep(points: DataFrame, ks: range = range(50, 501, 50), w: float = 0.5, **options) -> dict[int, Fit]:
    """A clustering for each number of clusters."""
    return {k: weighted_pckmeans(points, k, w, **options) for k in ks}


def reseeded(points: DataFrame, centers: DataFrame, violations: DataFrame, share: float = 0.3, w: float = 0.0, seed: int = 0) -> DataFrame:
    """Centres, of which the share with most violations (cluster, violations) are drawn anew by constrained_seeds."""
    worst = [r.cluster for r in violations.orderBy(F.col("violations").desc(), "cluster").limit(max(1, int(centers.count() * share))).collect()]
    fresh = constrained_seeds(points, len(worst), w, seed).withColumn("_i", F.col("cluster"))
    names = points.sparkSession.createDataFrame(list(enumerate(worst)), "_i int, _c int")
    fresh = fresh.join(F.broadcast(names), "_i").select(F.col("_c").alias("cluster"), "center")
    return centers.where(~F.col("cluster").isin(worst)).select("cluster", "center").unionByName(fresh)


def example_memory(old: DataFrame, new: DataFrame, most: int) -> DataFrame:
    """Old and new examples without repeats, new ones first, at most half of most: the memory is bounded by design."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    first = both.groupBy(*old.columns).agg(F.min("_age").alias("_age"))
    return first.orderBy("_age", *old.columns).limit(most // 2).drop("_age")


# Deep constrained clustering: forward formulas (deep.py trains)


def soft_assignment(points: DataFrame, centers: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Adds q, an array by cluster: Student's t of the distances, normalised."""
    listed = centers.agg(F.sort_array(F.collect_list(F.struct("cluster", "center"))).alias("_c"))
    raw = F.transform("_c", lambda c: F.pow(1 + squared_distance(F.col("vector"), c["center"]) / alpha, F.lit(-(alpha + 1) / 2)))
    rows = points.crossJoin(F.broadcast(listed)).withColumn("_r", raw).drop("_c")
    total = F.aggregate("_r", F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("q", F.transform("_r", lambda x: x / total)).drop("_r")


def target_distribution(soft: DataFrame) -> DataFrame:
    """Adds p: q² over the cluster's sum of q, normalised."""
    sums = soft.select(F.posexplode("q").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("f"))
    listed = sums.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "f"))), lambda x: x["f"]).alias("_f"))
    rows = soft.crossJoin(F.broadcast(listed)).withColumn("_w", F.zip_with("q", "_f", lambda x, f: x * x / f)).drop("_f")
    total = F.aggregate("_w", F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("p", F.transform("_w", lambda x: x / total)).drop("_w")


def pair_loss(soft: DataFrame, edges: DataFrame, clip: float = 1e-10) -> DataFrame:
    """One row: loss, the mean of -ln(1 - Σ q₁q₂) over cannot-link pairs; satisfied, the share with different clusters."""
    a, b = soft.select(F.col("id").alias("i"), F.col("q").alias("qi")), soft.select(F.col("id").alias("j"), F.col("q").alias("qj"))
    both = edges.join(a, "i").join(b, "j")
    same = F.aggregate(F.zip_with("qi", "qj", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    top = lambda q: F.array_position(q, F.array_max(q))
    return both.agg(F.avg(-F.ln(F.greatest(1 - same, F.lit(clip)))).alias("loss"), F.avg((top(F.col("qi")) != top(F.col("qj"))).cast("double")).alias("satisfied"))
