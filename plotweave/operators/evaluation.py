"""Material for human evaluation: sheets, intrusion tests, and their scores."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import content_words, set_jaccard
from ..sources.tables import ranked
from .clusters import closest_share, density_ranks, density_strata, nearest_clusters
from .sampling import drawn

#: Partners that a point of a pool is tried with.
TRIES = 50


def annotation_sample(chains: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """One annotated chain of each of n documents."""
    known = chains.where("annotation IS NOT NULL")
    one = known.withColumn("_r", F.row_number().over(W.partitionBy("doc_id").orderBy(*drawn("chain_id", seed)))).where("_r = 1").drop("_r")
    return one.orderBy(*drawn("doc_id", seed)).limit(n)


def theme_sample(points: DataFrame, centers: DataFrame, themes: DataFrame, sizes: dict[str, int] | None = None, per_cluster: int = 25, seed: int = 42) -> DataFrame:
    """Chains of clusters with a theme: so many clusters of each density stratum, then per_cluster chains of each."""
    sizes = sizes or {"high": 15, "medium": 20, "low": 15}
    ranks = density_ranks(points, centers).join(themes.where("framing_pattern_detected").select("cluster"), "cluster", "left_semi")
    strata = density_strata(ranks.withColumn("density_rank", F.row_number().over(W.orderBy("density_rank")) - 1))
    picked = strata.withColumn("_r", F.row_number().over(W.partitionBy("stratum").orderBy(*drawn("cluster", seed))))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("stratum"))
    chosen = F.broadcast(picked.where(F.col("_r") <= limit).select("cluster", "stratum"))  # as many rows as sizes say
    rows = points.join(chosen, "cluster").withColumn("_r", F.row_number().over(W.partitionBy("cluster").orderBy(*drawn("id", seed))))
    return rows.where(F.col("_r") <= per_cluster).drop("_r")


def positives(points: DataFrame, centers: DataFrame, threshold: float = 0.6, percent: float = 25.0) -> DataFrame:
    """cluster, a, b: two of each cluster's closest points, of different documents and with a word overlap below the threshold.

    Where no pair passes, the closest pair of different documents; else the closest two. points: id, cluster, doc_id, text,
    vector. In a pool each point is tried with the TRIES that follow it by hash, as many tries as a random search has.
    """
    pool = closest_share(points, centers, percent).withColumn("w", content_words("text"))
    pool = ranked(pool, ["cluster"], *drawn("id", 0), name="h")
    # those that follow a point within TRIES places are in its block or the next one, so texts move three times, not TRIES times
    block = F.floor(F.col("h") / TRIES)
    a = pool.select("cluster", block.alias("block"), F.col("h").alias("ha"), F.col("id").alias("a"), F.col("doc_id").alias("da"), F.col("w").alias("wa"), F.col("rank").alias("ra"))
    b = pool.select("cluster", F.explode(F.array(block, block - 1)).alias("block"), F.col("h").alias("hb"), F.col("id").alias("b"), F.col("doc_id").alias("db"), F.col("w").alias("wb"), F.col("rank").alias("rb"))
    pairs = a.join(b, ["cluster", "block"]).where(F.col("hb").between(F.col("ha") + 1, F.col("ha") + TRIES))
    other = F.col("da") != F.col("db")
    level = F.when(other & (set_jaccard("wa", "wb") < threshold), 0).when(other, 1).otherwise(2)
    order = F.struct(level.alias("level"), F.greatest("ra", "rb").alias("far"), F.least("ra", "rb").alias("near"), F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    best = pairs.groupBy("cluster").agg(F.min(order).alias("o"))
    return best.select("cluster", F.col("o.x").alias("a"), F.col("o.y").alias("b"))


def intruder_pool(points: DataFrame, centers: DataFrame, percent: float = 25.0) -> DataFrame:
    """cluster, difficulty, other: clusters that an intruder may come from. easy: the farthest quarter; medium: the nearest
    quarter; hard: the nearest. Clusters with fewer than two points take no part."""
    sizes = points.groupBy("cluster").count().where("count > 1").select("cluster")
    near = nearest_clusters(centers.join(sizes, "cluster", "left_semi"))
    n = F.count("*").over(W.partitionBy("cluster"))
    ranked = near.withColumn("_m", F.greatest(F.lit(1), F.floor(n * percent / 100))).withColumn("_n", n)
    level = F.filter(F.array(F.when(F.col("rank") > F.col("_n") - F.col("_m"), "easy"), F.when(F.col("rank") <= F.col("_m"), "medium"), F.when(F.col("rank") == 1, "hard")), lambda x: x.isNotNull())
    return ranked.select("cluster", F.explode(level).alias("difficulty"), "other")


def intruders(points: DataFrame, centers: DataFrame, percent: float = 25.0, seed: int = 0) -> DataFrame:
    """cluster, difficulty, source_cluster, intruder: a point of the closest quarter of a drawn cluster of the pool."""
    pool = intruder_pool(points, centers, percent)
    draw = lambda c: F.md5(F.concat_ws(":", "cluster", "difficulty", c, F.lit(seed)).cast("binary")).alias("h")
    one = pool.groupBy("cluster", "difficulty").agg(F.min(F.struct(draw("other"), "other"))["other"].alias("source_cluster"))
    close = closest_share(points, centers, percent).select(F.col("cluster").alias("source_cluster"), F.col("id").alias("intruder"))
    rows = one.join(close, "source_cluster")
    pick = F.min(F.struct(draw("intruder"), "intruder"))["intruder"]
    return rows.groupBy("cluster", "difficulty", "source_cluster").agg(pick.alias("intruder"))


def drawn_clusters(clusters: list[int], n: int, seed: int = 0) -> list[int]:
    """n draws, each with weight 1 / (draws of it so far + 1). The state is a count for each cluster."""
    r, used, out = random.Random(seed), dict.fromkeys(clusters, 0), []
    for _ in range(n):
        c = r.choices(clusters, [1 / (used[c] + 1) for c in clusters])[0]
        used[c] += 1
        out.append(c)
    return out


def intrusion_examples(points: DataFrame, centers: DataFrame, n: int = 50, threshold: float = 0.6, seed: int = 0) -> DataFrame:
    """example_no, sentences (three in drawn order), answer (the intruder's place), difficulty, cluster, source_cluster, ids."""
    spark = points.sparkSession
    pair = positives(points, centers, threshold)
    able = sorted(r.cluster for r in pair.select("cluster").collect())  # a row for each cluster
    third = n // 3
    levels = ["easy"] * third + ["medium"] * third + ["hard"] * (n - 2 * third)
    plan = spark.createDataFrame([(i, c, d) for i, (c, d) in enumerate(zip(drawn_clusters(able, n, seed), levels))], "example_no int, cluster int, difficulty string") if able else spark.createDataFrame([], "example_no int, cluster int, difficulty string")
    plan = plan.withColumn("cluster", F.col("cluster").cast(dict(points.dtypes)["cluster"]))
    rows = plan.join(pair, "cluster").join(intruders(points, centers, seed=seed), ["cluster", "difficulty"])
    items = F.array(*[F.struct(F.xxhash64(F.lit(seed), "example_no", F.lit(k)).alias("h"), F.col(k).alias("id"), F.lit(k == "intruder").alias("odd")) for k in ("a", "b", "intruder")])
    rows = rows.withColumn("x", F.array_sort(items)).withColumn("ids", F.transform("x", lambda y: y["id"]))
    rows = rows.withColumn("answer", F.array_position(F.transform("x", lambda y: y["odd"]), F.lit(True)) - 1)
    long = rows.select("example_no", "cluster", "difficulty", "source_cluster", "ids", "answer", F.posexplode("ids").alias("place", "id"))
    texts = long.join(points.select("id", "text"), "id")
    listed = texts.groupBy("example_no", "cluster", "difficulty", "source_cluster", "ids", "answer").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda y: y["text"]).alias("sentences"))
    return listed


def intrusion_scores(examples: DataFrame, predictions: DataFrame) -> DataFrame:
    """difficulty, method, n, accuracy; null stands for all. examples: example_no, answer, difficulty, method."""
    both = examples.join(predictions.select("example_no", "predicted"), "example_no").withColumn("hit", (F.col("answer") == F.col("predicted")).cast("double"))
    return both.groupingSets([[], [F.col("difficulty")], [F.col("method")]], "difficulty", "method").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"))


