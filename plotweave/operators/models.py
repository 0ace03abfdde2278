"""Features of documents from their clusters, frame prediction, surrogates and their explanation."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, UnivariateFeatureSelector
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import finite
from ..functions.words import CAST, GROUPS, MERGED_GROUPS
from .sampling import folds, split


def cluster_counts(chains: DataFrame, k: int) -> DataFrame:
    """doc_id, counts: an array of k numbers of chains by cluster. One aggregation; no column for each cluster."""
    n = chains.groupBy("doc_id", "cluster").agg(F.count("*").alias("n"))
    entries = n.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "n"))).alias("m"))
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    return entries.select("doc_id", at.alias("counts"))


def role_names(domain: str) -> list[str]:
    """group:role of a domain's groups, merged as chains merge them, without Other."""
    groups = sorted({MERGED_GROUPS.get(g, g) for g in GROUPS[domain]} - {"Other"})
    return [f"{g}:{r}" for g in groups for r in sorted(CAST)]


def role_counts(chains: DataFrame, names: list[str], column: str = "role_feats") -> DataFrame:
    """doc_id, column: how many chains have each group:role of names. chains: doc_id, roles (map)."""
    rows = chains.select("doc_id", F.explode("roles").alias("g", "r")).groupBy("doc_id", F.concat_ws(":", "g", "r").alias("name")).count()
    entries = rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "count"))).alias("m"))
    out = chains.select("doc_id").distinct().join(entries, "doc_id", "left")
    at = [F.coalesce(F.try_element_at("m", F.lit(n)), F.lit(0).cast("long")) for n in names]
    return out.select("doc_id", F.array(*at).alias(column))


def structural_features(chains: DataFrame, k: int) -> DataFrame:
    """Eight numbers for each document from (doc_id, chain_id, cluster, strength): its dominant cluster over k (ties to the one
    that comes first), the entropy of its clusters over its largest value (0 for one), mean strength, distinct clusters over
    chains, the largest share, the largest strength, distinct clusters over k, deviation of strengths over their mean."""
    n = chains.groupBy("doc_id", "cluster").agg(F.count("*").alias("n"), F.min("chain_id").alias("first"))
    total = chains.groupBy("doc_id").agg(F.count("*").alias("total"), F.avg("strength").alias("mean"), F.max("strength").cast("double").alias("max"), F.stddev_pop("strength").alias("sd"))
    p = F.col("n") / F.col("total")
    by = n.join(total, "doc_id").groupBy("doc_id", "total", "mean", "max", "sd").agg(F.max_by("cluster", F.struct("n", -F.col("first"))).alias("dominant"), (-F.sum(p * F.log2(p))).alias("h"), F.count("*").alias("unique"), F.max(p).alias("share"))
    return by.select(
        "doc_id",
        (F.col("dominant") / k).alias("dominant_cluster"),
        F.when(F.col("unique") > 1, F.col("h") / F.log2(F.col("unique").cast("double"))).otherwise(0.0).alias("diversity"),
        F.col("mean").alias("mean_strength"),
        (F.col("unique") / F.col("total")).alias("unique_ratio"),
        F.col("share").alias("concentration"),
        F.col("max").alias("max_strength"),
        (F.col("unique") / k).alias("coverage"),
        finite(F.when(F.col("mean") != 0, F.col("sd") / F.col("mean"))).alias("strength_variation"),
    )


STRUCTURAL = ["dominant_cluster", "diversity", "mean_strength", "unique_ratio", "concentration", "max_strength", "coverage", "strength_variation"]


def frame_dataset(chains: DataFrame, articles: DataFrame, k: int, domain: str, exclude: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """doc_id, text, cluster_feats, cluster_feats_frequency, role_feats, stance_feats, frame_label, split (70/15/15 by label).

    Roles are the domain's own. Scaling is left to fit_scaler, which looks at the training split only.
    """
    feats = structural_features(chains, k).select("doc_id", F.array(*STRUCTURAL).alias("cluster_feats"))
    out = feats.join(cluster_counts(chains, k).withColumnRenamed("counts", "cluster_feats_frequency"), "doc_id")
    out = out.join(role_counts(chains, role_names(domain)), "doc_id").join(role_counts(chains, ["Stance:Pro", "Stance:Anti"], "stance_feats"), "doc_id")
    rows = out.join(articles.select("doc_id", "text", F.col("primary_frame").alias("frame_label")), "doc_id").where("frame_label IS NOT NULL")
    rows = rows.where(~F.col("frame_label").isin(*exclude)) if exclude else rows
    return split(rows, {"train": 0.7, "dev": 0.15, "test": 0.15}, "frame_label", seed=seed)


@dataclass
class Scaler:
    """Means and population deviations; a constant column is only centred."""

    mean: list[float]
    scale: list[float]

    def apply(self, rows: DataFrame, column: str, out: str) -> DataFrame:
        m, s = F.lit(self.mean), F.lit(self.scale)
        return rows.withColumn(out, F.zip_with(F.zip_with(F.col(column).cast("array<double>"), m, lambda x, y: x - y), s, lambda x, y: x / y))


def fit_scaler(rows: DataFrame, column: str) -> Scaler:
    got = rows.select(F.posexplode(F.col(column).cast("array<double>")).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
    return Scaler([r.m for r in got], [r.s or 1.0 for r in got])


def _indexed(rows: DataFrame, label: str, column: str, vocabulary: DataFrame | None = None):
    indexer = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip").fit(vocabulary or rows)
    return indexer, indexer.transform(rows.withColumn("features", array_to_vector(F.col(column).cast("array<double>"))))


@dataclass
class Frames:
    """A fitted classifier with its labels and scaler."""

    model: object
    labels: list[str]
    scaler: Scaler | None
    column: str

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds predicted and, where the model has them, probabilities in order of labels."""
        data = self.scaler.apply(rows, self.column, "_x") if self.scaler else rows.withColumn("_x", F.col(self.column).cast("array<double>"))
        out = self.model.transform(data.withColumn("features", array_to_vector("_x")))
        if "probability" in out.columns:
            out = out.withColumn("probabilities", vector_to_array("probability"))
        names = F.array(*map(F.lit, self.labels))
        return out.withColumn("predicted", F.get(names, F.col("prediction").cast("int"))).drop("features", "_x", "rawPrediction", "probability", "prediction")


def fit_frames(rows: DataFrame, label: str, column: str, kind: str = "logistic", *, scale: bool = True, c: float = 0.5, elastic: float = 0.0, seed: int = 42, **options) -> Frames:
    """kind: logistic (multinomial; inverse regularisation c), one_vs_rest, forest, network (layers=…)."""
    scaler = fit_scaler(rows, column) if scale else None
    data = scaler.apply(rows, column, "_x") if scaler else rows.withColumn("_x", F.col(column).cast("array<double>"))
    indexer, data = _indexed(data, label, "_x")
    n, k = data.count(), len(indexer.labels)
    logistic = LogisticRegression(regParam=1 / (c * max(n, 1)), elasticNetParam=elastic, standardization=False, maxIter=options.get("max_iter", 1000), family="multinomial" if kind == "logistic" else "auto")
    if kind == "logistic":
        model = logistic.fit(data)
    elif kind == "one_vs_rest":
        model = OneVsRest(classifier=logistic).fit(data)
    elif kind == "forest":
        model = RandomForestClassifier(numTrees=options.get("trees", 100), maxDepth=options.get("depth", 8), seed=seed).fit(data)
    elif kind == "network":
        width = len(data.first().features)
        model = MultilayerPerceptronClassifier(layers=[width, *options.get("layers", (64, 32, 16)), k], maxIter=options.get("max_iter", 100), seed=seed).fit(data)
    else:
        raise ValueError(kind)
    return Frames(model, indexer.labels, scaler, column)


def cross_validate(rows: DataFrame, label: str, column: str, k: int = 5, repeats: int = 5, key: str = "doc_id", **options) -> DataFrame:
    """repeat, fold, accuracy, macro_f1, weighted_f1 of repeated stratified cross-validation."""
    from .quality import class_scores

    dealt, out = folds(rows, label, k, repeats, key).cache(), []
    try:
        for r in range(repeats):
            own = dealt.where(F.col("repeat") == r)
            for f in range(k):
                model = fit_frames(own.where(F.col("fold") != f), label, column, **options)
                got = class_scores(model.predict(own.where(F.col("fold") == f)), label, "predicted").first()
                out.append((r, f, got.accuracy, got.macro_f1, got.weighted_f1))
    finally:
        dealt.unpersist()
    return rows.sparkSession.createDataFrame(out, "repeat int, fold int, accuracy double, macro_f1 double, weighted_f1 double")


@dataclass
class Surrogate:
    """One regression for each class's probability; predictions are cut at 0 and add up to 1."""

    models: list
    column: str

    def predict(self, rows: DataFrame) -> DataFrame:
        out = rows.withColumn("_f", array_to_vector(F.col(self.column).cast("array<double>")))
        names = []
        for i, m in enumerate(self.models):
            names.append(f"_p{i}")
            out = m.setFeaturesCol("_f").setPredictionCol(f"_p{i}").transform(out)
        raw = F.array(*[F.greatest(F.col(n), F.lit(0.0)) for n in names])
        total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
        even = F.array(*[F.lit(1 / len(names))] * len(names))
        return out.withColumn("fitted", F.when(total > 0, F.transform(raw, lambda x: x / total)).otherwise(even)).drop("_f", *names)


def fit_surrogate(rows: DataFrame, column: str, probabilities: str, classes: int, kind: str = "linear", *, alpha: float = 0.01, l1_ratio: float = 0.5, depth: int = 5, rounds: int = 20, step: float = 0.1, seed: int = 42) -> Surrogate:
    """kind: linear (elastic net: alpha, l1_ratio) or trees (gradient boosting: depth, rounds, step)."""
    data = rows.withColumn("features", array_to_vector(F.col(column).cast("array<double>"))).cache()
    if kind == "linear":
        learner = LinearRegression(regParam=alpha, elasticNetParam=l1_ratio, standardization=False)
    elif kind == "trees":
        learner = GBTRegressor(maxDepth=depth, maxIter=rounds, stepSize=step, seed=seed)
    else:
        raise ValueError(kind)
    models = [learner.fit(data.withColumn("label", F.get(probabilities, F.lit(i)))) for i in range(classes)]
    data.unpersist()
    return Surrogate(models, column)


def search_surrogate(rows: DataFrame, column: str, probabilities: str, classes: int, kind: str = "linear", trials: int = 50, key: str = "doc_id", seed: int = 42) -> tuple[Surrogate, dict, float]:
    """(surrogate of all rows, its parameters, its loss on held-out rows): the best of so many random draws of parameters by the
    mean squared error on a fifth of the rows, which is kept from the fits that are compared."""
    from .quality import fidelity

    r, best = random.Random(seed), None
    dealt = split(rows, {"train": 0.8, "test": 0.2}, key=key, seed=seed).cache()
    for _ in range(trials):
        drawn = {"alpha": 10 ** r.uniform(-5, 1), "l1_ratio": r.random()} if kind == "linear" else {"depth": r.randint(2, 8), "rounds": r.randint(10, 60), "step": 10 ** r.uniform(-2, -0.3)}
        told = fit_surrogate(dealt.where("split = 'train'"), column, probabilities, classes, kind, **drawn).predict(dealt.where("split = 'test'"))
        cells = told.select(F.explode(F.arrays_zip(F.col(probabilities).alias("p"), "fitted")).alias("x")).select("x.p", "x.fitted")
        loss = fidelity(cells, "p", "fitted").first().mse
        if loss is not None and (best is None or loss < best[1]):
            best = drawn, loss
    dealt.unpersist()
    drawn, loss = best or ({}, math.nan)
    return fit_surrogate(rows, column, probabilities, classes, kind, **drawn), drawn, loss


def aligned(predictions: DataFrame, features: DataFrame) -> DataFrame:
    """Predictions beside the rows that they are of: joined by (split, doc_id), never by place."""
    return predictions.join(features, ["split", "doc_id"])


def agreements(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of which two models predict the same: doc_id, predicted."""
    return a.select("doc_id", "predicted").join(b.select("doc_id", F.col("predicted").alias("_b")), "doc_id").where("predicted = _b").drop("_b")


def coefficients(fitted: Frames, names: list[str], top: int | None = 5):
    """(label, feature, coefficient) rows: for each class the top largest and smallest."""
    matrix, out = fitted.model.coefficientMatrix.toArray(), []
    for label, row in zip(fitted.labels, matrix):
        order = sorted(zip(names, map(float, row)), key=lambda x: (-x[1], x[0]))
        out += [(label, n, c) for n, c in (order if top is None or 2 * top >= len(order) else order[:top] + order[-top:])]
    return out


def importances(fitted: Frames, names: list[str]):
    """(feature, importance) rows of a forest, largest first."""
    return sorted(zip(names, map(float, fitted.model.featureImportances.toArray())), key=lambda x: (-x[1], x[0]))


def screened(rows: DataFrame, label: str, column: str, top: int) -> list[int]:
    """Places of the features that tell most of the label by an F-test."""
    _, data = _indexed(rows, label, column)
    selector = UnivariateFeatureSelector(featuresCol="features", labelCol="label", outputCol="o", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(top)
    return sorted(selector.fit(data).selectedFeatures)


def permutation_importance(fitted: Frames, rows: DataFrame, label: str, names: list[str], seed: int = 42):
    """(feature, loss of accuracy when it is shuffled among rows), largest first."""
    hit = lambda df: fitted.predict(df).agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] or 0.0
    base, out = hit(rows), []
    from ..sources.tables import numbered

    held = numbered(rows, F.xxhash64("doc_id"), "doc_id", name="_a").cache()
    for i, name in enumerate(names):
        other = numbered(rows.select("doc_id", F.get(fitted.column, F.lit(i)).alias("_v")), F.xxhash64("doc_id", F.lit(seed)), "doc_id", name="_a").select("_a", "_v")
        own = F.col(fitted.column).cast("array<double>")
        parts = [F.slice(own, 1, i), F.array(F.col("_v").cast("double")), F.slice(own, i + 2, len(names))]
        mixed = held.join(other, "_a").withColumn(fitted.column, F.concat(*parts))
        out.append((name, base - hit(mixed)))
    held.unpersist()
    return sorted(out, key=lambda x: (-x[1], x[0]))


class EarlyStopper:
    """Says stop after patience values that are worse than the best by min_delta at least; a new best starts over, and values
    between change nothing. Losses are better when they are small, scores when they are large."""

    def __init__(self, patience: int = 1, min_delta: float = 0.0):
        self.patience, self.min_delta, self.best, self.bad = patience, min_delta, math.inf, 0

    def stop(self, loss: float) -> bool:
        if loss < self.best:
            self.best, self.bad = loss, 0
        elif loss >= self.best + self.min_delta:
            self.bad += 1
        return self.bad >= self.patience

    def stop_score(self, score: float) -> bool:
        return self.stop(-score)
