"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded from its characters and words; gated attention,
learned from labels of whole documents, weighs the passages, and the weighted mean of their encodings gives the score.
Training runs on the driver over a bounded sample of labelled documents; scoring runs over all documents on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import ready, table, text_of, trimmed

PASSAGE = 40
#: A model is fitted on at most so many labelled documents, those that come first by md5(doc_id), and of those on as many as
#: have no more passages together than the second number says, some 80 MB of features (see train).
SAMPLE_DOCS = 6000
SAMPLE_PASSAGES = 200_000
THRESHOLD = 0.3

_SPECIAL = b".,;:!?|#$%&*-_/\\()<>[]{}@\"'=+~^`"
_CLASSES = 7 + len(_SPECIAL)
_CLASS = np.full(256, 6, np.int64)  # other control characters
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 0, 1, 2
_CLASS[0xC0:], _CLASS[0x80:0xC0] = 3, 4  # first and later bytes of other characters
for _i, _c in enumerate(_SPECIAL):
    _CLASS[_c] = 7 + _i
PAIRS = 48
FEATURES = _CLASSES + PAIRS + 7


def passages(text: str) -> np.ndarray:
    """A row of features for each PASSAGE words; one row of zeros for a text without words."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return np.zeros((1, FEATURES), np.float32)
    count = -(-n // PASSAGE)
    lengths = np.fromiter(map(len, words), np.int64, n)
    of_word = np.arange(n) // PASSAGE
    raw = np.frombuffer(b"".join(words), np.uint8)
    of_byte = np.repeat(of_word, lengths)
    kind = _CLASS[raw]
    size = np.bincount(of_byte, minlength=count).astype(np.float32)
    counts = np.bincount(of_byte * _CLASSES + kind, minlength=count * _CLASSES).reshape(count, _CLASSES) / size[:, None]
    pair = (raw[:-1].astype(np.int64) * 31 + raw[1:]) * 2654435761 % 2**32 * PAIRS >> 32
    pairs = np.bincount(of_byte[1:] * PAIRS + pair, minlength=count * PAIRS).reshape(count, PAIRS) / size[:, None]
    n_words = np.bincount(of_word, minlength=count).astype(np.float32)
    distinct = np.array([len(set(words[i : i + PASSAGE])) for i in range(0, n, PASSAGE)], np.float32)
    again = np.zeros(n, np.float32)
    again[1:] = np.fromiter(map(eq, words, words[1:]), np.float32, n - 1)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    first, last = kind[starts], kind[starts + lengths - 1]
    mean = lambda x: np.bincount(of_word, x, minlength=count) / n_words
    own = np.stack([n_words / PASSAGE, size / n_words / 8, distinct / n_words, mean(again), mean(first == 1), mean(last >= 7), np.full(count, np.log1p(n) / 8)], 1)
    return np.concatenate([np.sqrt(counts), np.sqrt(pairs), own], 1).astype(np.float32)


@dataclass
class Model:
    """weights: encoder E, e; attention V, U, w; score c, b. Features are standardised by mean and scale."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict]:
        """Scores of bags whose rows of x begin at starts, and what the gradients need."""
        p = self.weights
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (v * u) @ p["w"]
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        a = np.exp(a - np.maximum.reduceat(a, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return y, {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "bag": bag}

    def gradients(self, y: np.ndarray, target: np.ndarray, k: dict, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy."""
        p, bag, h, a = self.weights, k["bag"], k["h"], k["a"]
        d = (y - target) / len(y)
        dz = d[:, None] * p["c"]
        da = (dz[bag] * h).sum(1)
        ds = a * (da - np.add.reduceat(a * da, starts)[bag])
        dvu = ds[:, None] * p["w"]
        dv, du = dvu * k["u"] * (1 - k["v"] ** 2), dvu * k["v"] * k["u"] * (1 - k["u"])
        dh = a[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T
        dx = dh * (1 - h**2)
        return {"E": k["x"].T @ dx, "e": dx.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (k["v"] * k["u"]).T @ ds, "c": k["z"].T @ d, "b": d.sum()}


def fit(bags: list[np.ndarray], target: np.ndarray, *, hidden: int = 32, gate: int = 16, epochs: int = 30, least_steps: int = 1500, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on cross-entropy, for so many epochs, more if that makes too few steps. Without rows, or of one class only, the score is the smoothed share of class 1."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags) if bags else np.zeros((1, FEATURES), np.float32)
    mean, scale = every.mean(0), every.std(0) + 1e-2
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    share = (target.sum() + 1) / (len(target) + 2)
    p = {"E": init(FEATURES, hidden), "e": np.zeros(hidden, np.float32), "V": init(hidden, gate), "U": init(hidden, gate), "w": init(gate), "c": np.zeros(hidden, np.float32), "b": np.float32(np.log(share / (1 - share)))}
    model = Model(p, mean, scale)
    if len(set(target.tolist())) < 2:
        return model
    m, s, t = {k: 0 * v for k, v in p.items()}, {k: 0 * v for k, v in p.items()}, 0
    epochs = max(epochs, -(-least_steps // -(-len(bags) // batch)))
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            starts = np.concatenate(([0], np.cumsum([len(bags[i]) for i in own])[:-1])).astype(np.int64)
            y, kept = model.forward(np.concatenate([bags[i] for i in own]), starts)
            t += 1
            for k, g in model.gradients(y, target[own], kept, starts).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p[k] = (p[k] - step * (m[k] / (1 - 0.9**t) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8) + decay * p[k])).astype(np.float32)
    return model


def held_out() -> Column:
    """Whether a row is kept from training: crc32 of its doc_id as text, '' for null, is a multiple of five."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from plotweave.llm.quality import passages

    for batch in batches:
        raw = [passages(x.as_py()).tobytes() for x in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["key"], batch["label"], pa.array(raw, pa.binary())], ["key", "label", "passages"])


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_passages: int = SAMPLE_PASSAGES) -> Model:
    """From labels (doc_id, quality) of rows that aren't held out. Several labels of a doc_id: the largest counts.

    Equal rows count once. The first text of every doc_id comes before the second of any, so that a doc_id with many texts has
    a share of the sample only while there is room. A document that doesn't fit among the passages that are left is left
    out, and others are taken; documents with more than a twentieth of all passages come last.
    """
    spark = ready(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = known.withColumn("key", F.md5(F.col("doc_id").cast("string").cast("binary"))).orderBy("key").limit(sample_docs)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("key", "label", "text").withColumn("h", F.xxhash64("text"))
    size = F.greatest(F.ceil(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) / PASSAGE), F.lit(1))
    texts = rows.select("key", "h", size.alias("n")).distinct().withColumn("long", F.col("n") > sample_passages // 20)
    turn = F.row_number().over(Window.partitionBy("key").orderBy("long", "h"))
    first = texts.withColumn("turn", turn).where(F.col("turn") <= sample_docs).orderBy("long", "turn", "key", "h").limit(sample_docs)
    taken, left = [], sample_passages
    for r in first.select("key", "h", "n").collect():  # sample_docs rows of two hashes and a number
        if r.n <= left:
            taken.append((r.key, r.h))
            left -= r.n
    rows = rows.join(F.broadcast(spark.createDataFrame(taken, "key string, h long")), ["key", "h"]).dropDuplicates(["key", "h"])
    got = sorted(rows.select("key", "label", "text").mapInArrow(_encode, f"key string, label {dict(labels.dtypes)['quality']}, passages binary").collect(), key=lambda r: (r.key, bytes(r.passages)))
    bags = [np.frombuffer(r.passages, np.float32).reshape(-1, FEATURES) for r in got]
    return fit(bags, np.array([r.label for r in got], np.float32))


def _score(model: Model, within: int | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The text is a column, or the field of that number within row."""
        from plotweave.llm.quality import passages

        for batch in batches:
            out: list[float] = []
            texts = batch["text"] if within is None else batch["row"].field(within)
            for at in range(0, batch.num_rows, 64):
                bags = [passages(x.as_py() or "") for x in texts[at : at + 64]]
                starts = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1])).astype(np.int64)
                out += model.forward(np.concatenate(bags), starts)[0].tolist()
            yield (batch.drop_columns(["text"]) if within is None else batch).append_column("score", pa.array(out, pa.float64()))

    return trimmed(score)


def score_quality(docs: DataFrame, model: Model, *, keep_rows: bool = False) -> DataFrame:
    """doc_id, score; one row for each row of docs. With keep_rows a struct column row has the input's row.

    Null text counts as empty, and empty text is one passage of no words. Very long texts: whole, 64 texts at a time. Equal
    texts have equal scores, so repeated rows do, and null doc_ids are scored like others. No rows: no rows. Other columns are
    ignored.
    """
    ready(docs.sparkSession)
    rows = docs.select("doc_id", F.struct("*").alias("row") if keep_rows else F.col("text"))
    within = docs.columns.index("text") if keep_rows else None
    return rows.mapInArrow(_score(model, within), rows.drop("text").schema.add("score", "double"))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
