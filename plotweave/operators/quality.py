"""Measures of clusterings, annotators and models."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import dot, norm, squared_distance
from ..sources.tables import ready, staged


def centroids(points: DataFrame) -> DataFrame:
    """cluster, center, size from (cluster, vector)."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("vector").cast("array<double>"))))
    return points.groupBy("cluster").agg(mean.alias("center"), F.count("*").alias("size"))


def to_centroids(points: DataFrame, centers: DataFrame) -> DataFrame:
    """Adds d2, the squared distance to the own cluster's centre."""
    return points.join(F.broadcast(centers.select("cluster", "center")), "cluster").withColumn("d2", squared_distance("vector", "center")).drop("center")


def cohesion(points: DataFrame, centers: DataFrame) -> DataFrame:
    """cluster, size, mean_distance, wcss."""
    d = to_centroids(points, centers)
    return d.groupBy("cluster").agg(F.count("*").alias("size"), F.avg(F.sqrt("d2")).alias("mean_distance"), F.sum("d2").alias("wcss"))


def separation(points: DataFrame, centers: DataFrame | None = None) -> DataFrame:
    """One row: n, k, wcss, bcss, calinski_harabasz. The last uses label means, whatever the centres are."""
    means = centroids(points)
    overall = points.agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("vector").cast("array<double>")))).alias("mean"))  # one row
    between = lambda c, n: c.join(n, "cluster").crossJoin(F.broadcast(overall)).agg(F.sum(F.col("n") * squared_distance("center", "mean")).alias("b"))
    sizes = means.select("cluster", F.col("size").alias("n"))
    own = means if centers is None else centers
    w, b = to_centroids(points, own).agg(F.sum("d2").alias("wcss"), F.count("*").alias("n")), between(own.select("cluster", "center"), sizes).withColumnRenamed("b", "bcss")
    wm, bm = to_centroids(points, means).agg(F.sum("d2").alias("wm")), between(means.select("cluster", "center"), sizes).withColumnRenamed("b", "bm")
    out = w.crossJoin(b).crossJoin(wm).crossJoin(bm).crossJoin(means.agg(F.count("*").alias("k")))  # single rows
    return out.select("n", "k", "wcss", "bcss", ((F.col("bm") / (F.col("k") - 1)) / (F.col("wm") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))


def ch_band(x: Column) -> Column:
    return F.when(x < 10, "poor").when(x < 100, "moderate").otherwise("good")


def silhouette_band(x: Column) -> Column:
    return F.when(x < 0.25, "none").when(x < 0.5, "weak").when(x < 0.7, "reasonable").otherwise("strong")


def block_pairs(points: DataFrame, block: int, by: list[str], columns: list[str], compare, schema: str) -> DataFrame:
    """compare(rows, others) -> table, for each batch and each block of the points that are equal in by. Batches and blocks
    have about block points, so no task sees more than two of them; every ordered pair of points meets once."""
    ready(points.sparkSession)
    sizes = points.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("_n")) if by else points.agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    own = points.select(*columns)
    own = own.join(sizes, by) if by else own.crossJoin(F.broadcast(sizes))  # one row
    dealt = own.withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    rows = dealt.withColumnRenamed("_own", "_a").withColumn("_b", other).drop("_n")
    others = dealt.select(*[F.col(c).alias(c) for c in columns], F.col("_own").alias("_b"), other.alias("_a"))
    return rows.groupBy(*by, "_a", "_b").cogroup(others.groupBy(*by, "_a", "_b")).applyInArrow(compare, schema)


def each_two_blocks(points: DataFrame, block: int, columns: list[str], compare, schema: str, most: int = 24) -> DataFrame:
    """compare(rows, others) -> table, for each two of the blocks that points are dealt to, whichever comes first, and for each
    block with None for others: every unordered pair of points meets once. Blocks have about block points, but are most at
    most, so that a point is sent to no more places than that."""
    import pyarrow.compute as pc

    ready(points.sparkSession)
    n = max(1, min(most, math.ceil(points.count() / block)))
    dealt = points.select(*columns, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("_own"))
    met = dealt.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(*columns, "_own", F.least("_own", "_p").alias("_a"), F.greatest("_own", "_p").alias("_b"))

    def both(key, table):
        a, b = (k.as_py() for k in key)
        rows = table.select(columns)
        return compare(rows, None) if a == b else compare(*(rows.filter(pc.equal(table["_own"], x)) for x in (a, b)))

    return met.repartition(n * (n + 1) // 2, "_a", "_b").groupBy("_a", "_b").applyInArrow(both, schema)


def near_blocks(points: DataFrame, radius: float, block: int, by: list[str], columns: list[str], compare, schema: str, most_pivots: int = 32) -> tuple[DataFrame, DataFrame]:
    """(what block_pairs gives, without the block pairs in which no two points lie within radius; blocks: by, _a, _b, near).

    points have id, vector and no nulls in by. A large group gets some of its points as pivots, as many as it has blocks;
    each point goes to the cell of its nearest pivot, and cells are cut into blocks. By the triangle inequality two points
    are at least as far apart as their distances to any pivot differ, so the ranges of a block's distances to the pivots rule
    other blocks out. Points that lie within radius always meet; near says which pairs of blocks did.
    """
    ready(points.sparkSession)
    own = points.select(*dict.fromkeys([*by, *columns, "id", "vector"]))
    drawn = W.partitionBy(*by).orderBy(F.xxhash64("id"), "id")
    sizes = own.groupBy(*by).agg(F.least(F.ceil(F.count("*") / block), F.lit(most_pivots)).cast("int").alias("_p"))
    first = own.withColumn("_r", F.row_number().over(drawn)).where(F.col("_r") <= most_pivots).join(sizes, by).where(F.col("_r") <= F.col("_p"))
    pivots = first.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "vector"))), lambda x: x["vector"]).alias("_pivots"))  # most_pivots at most
    rows = own.join(pivots, by).withColumn("_d", F.transform("_pivots", lambda p: F.sqrt(squared_distance(F.col("vector"), p)))).drop("_pivots")
    rows = staged(rows.withColumn("_cell", (F.array_position("_d", F.array_min("_d")) - 1).cast("int")))
    cells = rows.groupBy(*by, "_cell").agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    rows = rows.join(cells, [*by, "_cell"]).withColumn("_block", F.struct("_cell", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int").alias("part")))
    ranges = rows.select(*by, "_block", F.posexplode("_d").alias("_i", "_x")).groupBy(*by, "_block", "_i").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    listed = staged(ranges.groupBy(*by, "_block").agg(F.sort_array(F.collect_list(F.struct("_i", "lo", "hi"))).alias("_range")))
    a, b = (listed.select(*by, F.col("_block").alias(n), F.col("_range").alias(f"_r{n}")) for n in ("_a", "_b"))
    apart = F.array_max(F.zip_with("_r_a", "_r_b", lambda x, y: F.greatest(x["lo"] - y["hi"], y["lo"] - x["hi"])))
    slack = 1e-9 * (1 + F.array_max(F.transform("_r_a", lambda x: x["hi"])))
    met = staged(a.join(b, by).select(*by, "_a", "_b", (apart <= radius + slack).alias("near")))
    near = met.where("near").drop("near")
    rows = rows.select(*dict.fromkeys([*by, *columns]), "_block")
    left = rows.withColumnRenamed("_block", "_a").join(near, [*by, "_a"])
    again = lambda df, *names: df.select(*[F.col(c).alias(c) for c in df.columns if c not in names[::2]], *[F.col(c).alias(n) for c, n in zip(names[::2], names[1::2])])  # noqa: E731  as columns of its own
    right = again(rows, "_block", "_b").join(again(near), [*by, "_b"])
    return left.groupBy(*by, "_a", "_b").cogroup(right.groupBy(*by, "_a", "_b")).applyInArrow(compare, schema), met


def matrix(table) -> object:
    """The vectors of an Arrow table, a row each."""
    import numpy as np

    lists = table["vector"].combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def distance_matrix(x, y):
    """Euclidean distances of rows by a matrix product; those of which rounding could show are computed from differences."""
    import numpy as np

    size = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)
    d2 = size - 2 * (x @ y.T)
    row, col = np.nonzero(d2 < 1e-4 * size)
    for at in range(0, len(row), 1 << 16):
        a, b = row[at : at + (1 << 16)], col[at : at + (1 << 16)]
        d2[a, b] = ((x[a] - y[b]) ** 2).sum(1)
    return np.sqrt(np.maximum(d2, 0))


def silhouette(points: DataFrame, block: int = 1 << 14) -> DataFrame:
    """id, cluster, silhouette: Euclidean. 0 for a point alone in its cluster, and for all if there is one cluster.

    Exact distances to all points are quadratic by definition: one matrix of distances for each batch and block, of which
    the sums by cluster go on.
    """
    kind = dict(points.dtypes)
    rows = points.select("id", "cluster", F.col("vector").cast("array<double>").alias("vector"))

    def sums(own, others):
        import numpy as np
        import pyarrow as pa

        x, y = matrix(own), matrix(others)
        if not len(x) or not len(y):
            return own.select(["id", "cluster"]).slice(0, 0).append_column("other", others["cluster"].slice(0, 0)).append_column("total", pa.array([], pa.float64()))
        clusters, place = np.unique(others["cluster"].to_numpy(), return_inverse=True)
        member = (place[:, None] == np.arange(len(clusters))).astype(float)
        total = np.concatenate([distance_matrix(x[at : at + 128], y) @ member for at in range(0, len(x), 128)])
        each = np.repeat(np.arange(len(x)), len(clusters))
        out = own.select(["id", "cluster"]).take(pa.array(each))
        out = out.append_column("other", pa.array(np.tile(clusters, len(x)), others["cluster"].type))
        return out.append_column("total", pa.array(total.ravel(), pa.float64()))

    total = block_pairs(rows, block, [], ["id", "cluster", "vector"], sums, f"id {kind['id']}, cluster {kind['cluster']}, other {kind['cluster']}, total double")
    total = total.groupBy("id", "cluster", "other").agg(F.sum("total").alias("total"))
    sizes = points.groupBy("cluster").agg(F.count("*").alias("size"))
    mean = total.join(F.broadcast(sizes.withColumnRenamed("cluster", "other")), "other").withColumn("own", F.col("other") == F.col("cluster"))
    a = F.max(F.when(F.col("own"), F.when(F.col("size") > 1, F.col("total") / (F.col("size") - 1)).otherwise(F.lit(-1.0))))
    b = F.min(F.when(~F.col("own"), F.col("total") / F.col("size")))
    both = mean.groupBy("id", "cluster").agg(a.alias("a"), b.alias("b"))
    value = F.when(F.col("a").isNull() | (F.col("a") < 0) | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return both.select("id", "cluster", F.coalesce(value, F.lit(0.0)).alias("silhouette"))


def exact_purity(classes: DataFrame) -> DataFrame:
    """purity from (cluster, class): the share of points that are of their cluster's most frequent class."""
    counts = classes.groupBy("cluster", "class").count()
    tops = counts.groupBy("cluster").agg(F.max("count").alias("top"), F.sum("count").alias("n"))
    return tops.agg((F.sum("top") / F.sum("n")).alias("purity"), F.sum("n").alias("n"))


def role_purity(roles: DataFrame) -> DataFrame:
    """key, purity from (cluster, key, role): a role's largest share, averaged over the clusters that have the key."""
    counts = roles.groupBy("cluster", "key", "role").count()
    shares = counts.groupBy("cluster", "key").agg((F.max("count") / F.sum("count")).alias("share"))
    return shares.groupBy("key").agg(F.avg("share").alias("purity"))


def confusion(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def cohens_kappa(pairs: DataFrame, a: str, b: str, variance: str = "simplified") -> DataFrame:
    """One row: n, kappa, se, z, p_value, ci_low, ci_high, band.

    variance "simplified": one theta for both terms, the sum of cells times squared margins over n². "textbook": the two
    thetas of the asymptotic variance.
    """
    cells = [tuple(r) for r in confusion(pairs, a, b).collect()]  # a row for each pair of classes
    n = sum(c for *_, c in cells)
    spark = pairs.sparkSession
    schema = "n long, kappa double, se double, z double, p_value double, ci_low double, ci_high double, band string"
    classes = sorted({x for r in cells for x in r[:2]}, key=str)
    row = {k: sum(c for x, _, c in cells if x == k) / n for k in classes} if n else {}
    column = {k: sum(c for _, y, c in cells if y == k) / n for k in classes} if n else {}
    po, pe = (sum(c for x, y, c in cells if x == y) / n, sum(row[k] * column[k] for k in classes)) if n else (0, 1)
    if not n or pe == 1:
        return spark.createDataFrame([(n, None, None, None, None, None, None, None)], schema)
    kappa = (po - pe) / (1 - pe)
    if variance == "simplified":
        t1 = t2 = sum(c * (row[x] + column[y]) ** 2 for x, y, c in cells) / n**2
    else:
        t1 = sum(c / n * (row[x] + column[x]) for x, y, c in cells if x == y)
        t2 = sum(c / n * (column[x] + row[y]) ** 2 for x, y, c in cells)
    var = po * (1 - po) / (n * (1 - pe) ** 2) + 2 * (1 - po) * (2 * po * pe - t1) / (n * (1 - pe) ** 3) + (1 - po) ** 2 * (t2 - 4 * pe**2) / (n * (1 - pe) ** 4)
    se = math.sqrt(var) if var >= 0 else float("nan")
    z = kappa / math.sqrt(pe / (n * (1 - pe) ** 2))
    p = 2 * (1 - normal_cdf(abs(z)))
    band = "p<.001" if p < 0.001 else "p<.01" if p < 0.01 else "p<.05" if p < 0.05 else "n.s."
    return spark.createDataFrame([(n, kappa, se, z, p, kappa - 1.959963984540054 * se, kappa + 1.959963984540054 * se, band)], schema)


def intraclass(ratings: DataFrame, a: str, b: str, low: float | None = 0, high: float | None = 4) -> DataFrame:
    """One row: icc2, icc2k, icc3, icc3k of two raters, from the sums of a two-way analysis of variance.

    Two made-up subjects on whom both agree, at the ends of the scale, are added unless low and high are null.
    """
    rows = ratings.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    s = rows.agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") ** 2 + F.col("y") ** 2).alias("q"), F.sum((F.col("x") + F.col("y")) ** 2).alias("r"))
    ends = [v for v in (low, high) if v is not None]
    e1, e2 = float(sum(ends)), float(sum(v * v for v in ends))
    n = F.col("n") + len(ends)
    x, y, q, r = F.coalesce("x", F.lit(0.0)) + e1, F.coalesce("y", F.lit(0.0)) + e1, F.coalesce("q", F.lit(0.0)) + 2 * e2, F.coalesce("r", F.lit(0.0)) + 4 * e2
    mean = (x + y) ** 2 / (2 * n)
    ss_rows, ss_cols, ss_all = r / 2 - mean, (x**2 + y**2) / n - mean, q - mean
    out = s.select(n.alias("n"), (ss_rows / (n - 1)).alias("msr"), ss_cols.alias("msc"), ((ss_all - ss_rows - ss_cols) / (n - 1)).alias("mse"))
    r_, c_, e_, n_ = F.col("msr"), F.col("msc"), F.col("mse"), F.col("n")
    return out.select("n", ((r_ - e_) / (r_ + e_ + 2 * (c_ - e_) / n_)).alias("icc2"), ((r_ - e_) / (r_ + (c_ - e_) / n_)).alias("icc2k"), ((r_ - e_) / (r_ + e_)).alias("icc3"), ((r_ - e_) / r_).alias("icc3k"))


def class_report(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    """class, support, precision, recall, f1; 0 where a ratio has no cases."""
    cells = confusion(pairs, truth, predicted)
    hit = cells.where("a = b").select(F.col("a").alias("class"), F.col("n").alias("hit"))
    t = cells.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("support"))
    p = cells.groupBy(F.col("b").alias("class")).agg(F.sum("n").alias("guessed"))
    rows = t.join(p, "class", "full").join(hit, "class", "left").na.fill(0, ["support", "guessed", "hit"])
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    h, s, g = F.col("hit"), F.col("support"), F.col("guessed")
    return rows.select("class", "support", ratio(h, g).alias("precision"), ratio(h, s).alias("recall"), ratio(2 * h, s + g).alias("f1"))


def class_scores(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy, macro_f1, weighted_f1."""
    rep = class_report(pairs, truth, predicted)
    return rep.agg((F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def fidelity(cells: DataFrame, truth: str, predicted: str, clip: float = 1e-15) -> DataFrame:
    """One row: mse, r2, cross_entropy over all cells of two probability tables."""
    t, p = F.col(truth), F.col(predicted)
    clipped = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return cells.agg(
        F.avg((t - p) ** 2).alias("mse"),
        (1 - F.sum((t - p) ** 2) / (F.sum(t * t) - F.sum(t) ** 2 / F.count("*"))).alias("r2"),
        (-F.avg(t * F.ln(clipped))).alias("cross_entropy"),
    )
