"""Features of predicate-object mentions, and clustering that refines its encoder, all through plugs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import masked, strip_negation
from ..sources.tables import ready, staged
from .clusters import Fit, balanced_pairs, carried_centers, closest_share, mined_pairs, weighted_pckmeans
from .plugs import Embedder, HashEmbedder, embed, expand
from .quality import exact_purity
from .terms import salience_flags


def span_vectors(rows: DataFrame, key: str, tokens: str, first: str, last: str, make: Callable[[], Embedder] = HashEmbedder, batch: int = 32) -> DataFrame:
    """key, vector: the mean of the vectors of the words first to last (from 0, both included); null if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = make()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                out = []
                for words, i, j in zip(*(part[c].to_pylist() for c in ("_t", "_i", "_j"))):
                    chosen = words[i : j + 1] if words and i is not None and j is not None and i >= 0 else []
                    out.append(np.mean(own.embed(chosen), 0).tolist() if chosen else None)
                yield pa.RecordBatch.from_arrays([part[key], pa.array(out, pa.list_(pa.float64()))], [key, "vector"])

    src = rows.select(key, F.col(tokens).alias("_t"), F.col(first).cast("int").alias("_i"), F.col(last).cast("int").alias("_j"))
    return src.mapInArrow(run, f"{key} {dict(src.dtypes)[key]}, vector array<double>")


def masked_span(tokens: str, first: str, last: str, mask: str = "[MASK]"):
    """The sentence with the words first to last replaced by one mask."""
    t, i, j = F.col(tokens), F.col(first), F.col(last)
    return F.concat_ws(" ", F.slice(t, F.lit(1), i), F.array(F.lit(mask)), F.slice(t, j + 2, F.greatest(F.size(t) - j - 1, F.lit(0))))


def mention_features(svos: DataFrame, sentences: DataFrame, verbs: DataFrame, heads: DataFrame, k: int = 10, make: Callable[[], Embedder] = HashEmbedder) -> DataFrame:
    """Salient mentions with a vector and an expansion for verb and object head; null where there is no word to take.

    svos: sent_id, svo_id, verb (lemma, idx), obj_head, obj_head_index; sentences: sent_id, tokens (words). Mentions that
    aren't salient go before any model sees them.
    """
    rows = svos.select("sent_id", "svo_id", strip_negation("verb.lemma").alias("verb"), F.col("verb.idx").alias("verb_index"), "obj_head", "obj_head_index")
    kept = salience_flags(rows, verbs, heads).join(sentences.select("sent_id", F.col("tokens").alias("_words")), "sent_id")
    kept = staged(kept.withColumn("mention_id", F.concat_ws("_", "sent_id", "svo_id")))
    out = kept.drop("_words")
    for name, at in (("verb", "verb_index"), ("obj", "obj_head_index")):
        known = kept.where(F.col(at).isNotNull())
        vectors = span_vectors(known, "mention_id", "_words", at, at, make).withColumnRenamed("vector", f"{name}_vec")
        guesses = expand(known.withColumn("_m", masked("_words", at)), "mention_id", "_m", k, make).withColumnRenamed("expansion", f"{name}_exp")
        out = out.join(vectors, "mention_id", "left").join(guesses, "mention_id", "left")
    return out


def phrase_features(svos: DataFrame, sentences: DataFrame, k: int = 10, make: Callable[[], Embedder] = HashEmbedder) -> DataFrame:
    """sent_id, svo_id, part (subj, verb, obj), vector, expansion: of a part's words from its first to its last index, the
    whole span under one mask."""
    part = lambda name, idx: svos.select("sent_id", "svo_id", F.lit(name).alias("part"), F.array_min(idx).alias("first"), F.array_max(idx).alias("last"))
    rows = part("subj", F.col("subj.idx")).unionByName(part("verb", F.array(F.col("verb.idx")))).unionByName(part("obj", F.col("obj.idx"))).where("first IS NOT NULL")
    rows = staged(rows.join(sentences.select("sent_id", F.col("tokens").alias("_words")), "sent_id").withColumn("id", F.concat_ws("_", "sent_id", "svo_id", "part")))
    vectors = span_vectors(rows, "id", "_words", "first", "last", make)
    guesses = expand(rows.withColumn("_m", masked_span("_words", "first", "last")), "id", "_m", k, make)
    return rows.select("id", "sent_id", "svo_id", "part").join(vectors, "id").join(guesses, "id").drop("id")


class Tuner(Protocol):
    def __call__(self, make: Callable[[], Embedder], pairs: DataFrame) -> Callable[[], Embedder]:
        """An encoder tuned on pairs (anchor, kind, other, similarity)."""


@dataclass
class Refined:
    fit: Fit
    make: Callable[[], Embedder]
    purity: float
    history: list[tuple[float, int]] = field(default_factory=list)


def refine(chains: DataFrame, k: int, w: float, tune: Tuner, make: Callable[[], Embedder] = HashEmbedder, rounds: int = 3, share: float = 0.25, ratio: float = 1.0, **options) -> Refined:
    """Cluster, mine pairs, tune the encoder, encode again. chains: id, text, keys, signature.

    Returns the round of the best purity among each cluster's closest share, ties to fewer violations. Centres are carried
    over: the next round starts from the means, in the new space, of the points that were nearest.
    """
    from .quality import centroids

    best, centers, history = None, None, []
    for _ in range(rounds):
        points = staged(chains.select("id", "keys", "signature").join(embed(chains, "id", "text", make), "id"))
        if centers is not None:
            moved = {r.cluster: r.center for r in carried_centers(old, points, centers, share).collect()}  # noqa: F821  k rows
            rows = [(r.cluster, moved.get(r.cluster, r.center)) for r in centers.collect()]
            start = points.sparkSession.createDataFrame(rows, "cluster int, center array<double>")
        else:
            start = None
        fit = weighted_pckmeans(points, k, w, centers=start, **options)
        own = points.join(fit.assignment, "id")
        close = closest_share(own, centroids(own), 100 * share)
        purity = exact_purity(close.where("signature IS NOT NULL").select("cluster", F.col("signature").alias("class"))).first().purity or 0.0
        history.append((purity, fit.violations[-1]))
        if best is None or (purity, -fit.violations[-1]) > (best.purity, -best.history[-1][1]):
            best = Refined(fit, make, purity, list(history))
        old, centers = staged(own), fit.centers
        make = tune(make, balanced_pairs(mined_pairs(old), ratio))
    best.history = history
    return best


def classify(rows: DataFrame, key: str, text: str, make: Callable[[], Callable[[list[str]], list[list[float]]]], labels: list[str], batch: int = 64) -> DataFrame:
    """key, predicted, probabilities of a text classifier that make builds once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                p = model([x or "" for x in part["_text"].to_pylist()])
                top = [labels[int(np.argmax(x))] for x in p]
                yield pa.RecordBatch.from_arrays([part[key], pa.array(top, pa.string()), pa.array(p, pa.list_(pa.float64()))], [key, "predicted", "probabilities"])

    ready(rows.sparkSession)
    src = rows.select(key, F.col(text).alias("_text"))
    return src.mapInArrow(run, f"{key} {dict(src.dtypes)[key]}, predicted string, probabilities array<double>")
