"""Deep clustering under cannot-link constraints: an encoder, a decoder and cluster centres trained together.

The loss is that of reconstruction, plus the divergence of soft assignments from their target, plus a penalty for cannot-link pairs
that share a cluster. Each step is one job: tasks add up the gradients of their rows, the sums are added by parts of the parameters,
and only the parameters' size reaches the driver, which makes the step. A lost task repeats its part of one step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import numbered, ready, staged, unstaged
from .assign import vectors
from .clusters import Fit, kmeans
from .lowrank import _PANEL, _summed

#: Parameters in a part of the sum; rows that a task goes through at a time; points of a block whose pairs are made in tiles.
PART, ROWS, TILE = 1 << 14, 1024, 4096
_CLIP = 1e-10


@dataclass
class Net:
    """w: encoder W1 b1 W2 b2, decoder W3 b3 W4 b4, centres mu. alpha: degrees of freedom of the soft assignment."""

    w: dict[str, np.ndarray]
    alpha: float = 1.0

    @classmethod
    def drawn(cls, width: int, hidden: int, dims: int, k: int, seed: int, alpha: float = 1.0) -> Net:
        r = np.random.default_rng(seed)
        layers = {"1": (width, hidden), "2": (hidden, dims), "3": (dims, hidden), "4": (hidden, width)}
        w = {}
        for n, (a, b) in layers.items():
            w |= {f"W{n}": r.normal(0, np.sqrt(2 / (a + b)), (a, b)), f"b{n}": np.zeros(b)}
        return cls(w | {"mu": np.zeros((k, dims))}, alpha)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.w["W1"] + self.w["b1"], 0)
        return h, h @ self.w["W2"] + self.w["b2"]

    def soft(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(assignment, its sums before they are normalised, 1 + squared distance / alpha)."""
        t = 1 + ((z[:, None] - self.w["mu"]) ** 2).sum(2) / self.alpha
        r = t ** (-(self.alpha + 1) / 2)
        return r / r.sum(1, keepdims=True), r.sum(1, keepdims=True), t

    def _from_soft(self, z: np.ndarray, g: np.ndarray, q: np.ndarray, total: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients by z and by mu from that by q."""
        by_r = (g - (g * q).sum(1, keepdims=True)) / total
        by_d2 = by_r * -(self.alpha + 1) / (2 * self.alpha) * q * total / t
        away = z[:, None] - self.w["mu"]
        return 2 * (by_d2[:, :, None] * away).sum(1), -2 * (by_d2[:, :, None] * away).sum(0)

    def _from_z(self, x: np.ndarray, h: np.ndarray, g: np.ndarray) -> dict[str, np.ndarray]:
        back = (g @ self.w["W2"].T) * (h > 0)
        return {"W2": h.T @ g, "b2": g.sum(0), "W1": x.T @ back, "b1": back.sum(0)}

    def of_points(self, x: np.ndarray, totals: np.ndarray | None, gamma: float) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """(gradients, sums of the assignment, loss), summed over points. totals: the sums by cluster that the target is made
        with; without them only the reconstruction counts."""
        w = self.w
        h, z = self.encode(x)
        h2 = np.maximum(z @ w["W3"] + w["b3"], 0)
        off = h2 @ w["W4"] + w["b4"] - x
        loss, g = float((off**2).mean(1).sum()), 2 * off / x.shape[1]
        back = (g @ w["W4"].T) * (h2 > 0)
        out = {"W4": h2.T @ g, "b4": g.sum(0), "W3": z.T @ back, "b3": back.sum(0), "mu": np.zeros_like(w["mu"])}
        by_z = back @ w["W3"].T
        q, total, t = self.soft(z)
        if totals is not None:
            p = q**2 / totals
            p /= p.sum(1, keepdims=True)
            loss += gamma * float((p * np.log(np.maximum(p, _CLIP) / np.maximum(q, _CLIP))).sum())
            more, out["mu"] = self._from_soft(z, -gamma * p / np.maximum(q, _CLIP), q, total, t)
            by_z = by_z + more
        return out | self._from_z(x, h, by_z), q.sum(0), loss

    def of_pairs(self, x: np.ndarray, y: np.ndarray, w: float) -> tuple[dict[str, np.ndarray], float]:
        """(gradients, loss) of w * -ln(1 - the chance that both ends are in one cluster), summed over pairs."""
        (h1, z1), (h2, z2) = self.encode(x), self.encode(y)
        (q1, s1, t1), (q2, s2, t2) = self.soft(z1), self.soft(z2)
        apart = np.maximum(1 - (q1 * q2).sum(1, keepdims=True), _CLIP)
        g1, m1 = self._from_soft(z1, w * q2 / apart, q1, s1, t1)
        g2, m2 = self._from_soft(z2, w * q1 / apart, q2, s2, t2)
        a, b = self._from_z(x, h1, g1), self._from_z(y, h2, g2)
        return {n: a[n] + b[n] for n in a} | {"mu": m1 + m2}, float(-w * np.log(apart).sum())


    def of_tile(self, x: np.ndarray, y: np.ndarray | None, signs: np.ndarray, others: np.ndarray | None, w: float) -> tuple[dict[str, np.ndarray], float]:
        """What of_pairs() gives for all pairs of a row of x and one of y with different signs, or of two rows of x if y is None.
        A row is encoded once, whatever the number of its pairs, which are entries of a matrix of some rows at a time."""
        h1, z1 = self.encode(x)
        q1, s1, t1 = self.soft(z1)
        h2, z2 = (h1, z1) if y is None else self.encode(y)
        q2, s2, t2 = (q1, s1, t1) if y is None else self.soft(z2)
        others = signs if y is None else others
        g1, g2, logs = np.zeros_like(q1), np.zeros_like(q2), 0.0
        for at in range(0, len(x), ROWS // 4):
            some = slice(at, at + ROWS // 4)
            bad = signs[some, None] != others
            apart = np.maximum(1 - q1[some] @ q2.T, _CLIP)
            by = bad / apart
            g1[some] = by @ q2
            if y is not None:
                g2 += by.T @ q1[some]
            apart[~bad] = 1
            logs += _logs(apart)
        by_z, by_mu = self._from_soft(z1, w * g1, q1, s1, t1)
        out = self._from_z(x, h1, by_z)
        if y is None:
            return out | {"mu": by_mu}, -w * logs / 2
        by_z, more = self._from_soft(z2, w * g2, q2, s2, t2)
        back = self._from_z(y, h2, by_z)
        return {n: out[n] + back[n] for n in out} | {"mu": by_mu + more}, -w * logs


def _logs(m: np.ndarray) -> float:
    """The sum of logarithms of numbers from _CLIP to 1, sixteen at a time by their product."""
    n = m.shape[1] // 16
    product = m[:, :n].copy()
    for i in range(1, 16):
        product *= m[:, i * n : (i + 1) * n]
    return float(np.log(product).sum() + np.log(m[:, 16 * n :]).sum())


def _tiles(points: DataFrame, block: int) -> tuple[DataFrame, int]:
    """(rows of two blocks of points with equal keys, or of one with itself; the number of cannot-link pairs). Each pair of points
    is in one of them, which has the vectors of its blocks one after the other, and numbers for their signatures."""
    bound = points.where("keys IS NOT NULL AND signature IS NOT NULL")
    signs = staged(numbered(bound.groupBy("keys", "signature").agg(F.count("*").alias("n")), "keys", "signature", name="sign"))
    pairs = lambda n: n * (n - 1) / 2
    each = signs.groupBy("keys").agg(F.sum("n").alias("_all"), (pairs(F.sum("n")) - F.sum(pairs(F.col("n")))).cast("long").alias("_pairs")).where("_pairs > 0")
    sizes = staged(each.select("keys", "_pairs", F.ceil(F.col("_all") / block).cast("int").alias("_n")))
    dealt = bound.join(signs, ["keys", "signature"]).join(sizes, "keys").withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    listed = dealt.groupBy("keys", "_n", "_b").agg(F.sort_array(F.collect_list(F.struct("id", "sign", "vector"))).alias("_x"))  # about block points
    blocks = staged(listed.select("keys", "_n", "_b", F.flatten("_x.vector").alias("vector"), F.col("_x.sign").alias("signs")))
    a = blocks.select("keys", F.col("_b").alias("_p"), F.explode(F.sequence("_b", F.col("_n") - 1)).alias("_q"), "vector", "signs")
    b = blocks.where("_b > 0").select("keys", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_p"), F.col("_b").alias("_q"), F.col("vector").alias("other"), F.col("signs").alias("others"))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = a.hint("merge").join(b, ["keys", "_p", "_q"], "left").repartition(parts, "keys", "_p", "_q").sortWithinPartitions("keys", "_p", "_q")
    out = staged(met.select("vector", "other", "signs", "others"))
    n = int(sizes.agg(F.coalesce(F.sum("_pairs"), F.lit(0))).first()[0])
    unstaged(signs, sizes, blocks)
    return out, n


def _flat(parts: dict[str, np.ndarray], like: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([np.ravel(parts.get(n, np.zeros_like(v))) for n, v in like.items()])


def _step(rows: DataFrame, net: Net, totals: np.ndarray | None, gamma: float, w: float, n: int, n_pairs: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean gradient, sums of the assignment, mean loss) over points and pairs: rows with one vector, with two, or tiles of many."""
    size, k = sum(v.size for v in net.w.values()), len(net.w["mu"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = np.zeros(size + k + 1)
        for batch in batches:
            tile, pair = (batch[c].is_valid().to_numpy(zero_copy_only=False) for c in ("signs", "other"))
            for i in np.flatnonzero(tile):
                signs, others = (batch[c][int(i)].values for c in ("signs", "others"))
                x, y = (None if v is None else v.to_numpy().reshape(len(s), -1) for v, s in ((batch["vector"][int(i)].values, signs), (batch["other"][int(i)].values, others)))
                g, loss = net.of_tile(x, y, signs.to_numpy(), None if y is None else others.to_numpy(), w)
                sums += np.concatenate([_flat(g, net.w) / n_pairs, np.zeros(k), [loss / n_pairs]])
            for chosen in (np.flatnonzero(~tile & ~pair), np.flatnonzero(~tile & pair)):
                for at in range(0, len(chosen), ROWS):
                    some = pa.array(chosen[at : at + ROWS])
                    x = vectors(batch["vector"].take(some))
                    if pair[chosen[0]]:
                        g, loss = net.of_pairs(x, vectors(batch["other"].take(some)), w)
                        q, share = np.zeros(k), 1 / n_pairs
                    else:
                        g, q, loss = net.of_points(x, totals, gamma)
                        share = 1 / n
                    sums += np.concatenate([_flat(g, net.w) * share, q, [loss * share]])
        cut = [sums[i : i + PART] for i in range(0, len(sums), PART)]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary()), pa.array([task] * len(cut), pa.int32())], ["block", "data", "task"])

    got = sorted(_summed(rows.mapInArrow(run, f"{_PANEL}, task int"), "task").collect(), key=lambda r: r.block)  # the parameters
    sums = np.concatenate([np.frombuffer(bytes(r.data), float) for r in got])
    return sums[:size], sums[size : size + k], float(sums[-1])


def encoded(points: DataFrame, net: Net) -> DataFrame:
    """id, vector (the encoding), cluster (the likeliest, ties to the first), q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = net.encode(vectors(batch["vector"]))[1] if batch.num_rows else np.zeros((0, net.w["mu"].shape[1]))
            q = net.soft(z)[0]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel())) for m in (z, q)]
            yield pa.RecordBatch.from_arrays([batch["id"], lists[0], pa.array(q.argmax(1), pa.int32()), lists[1]], ["id", "vector", "cluster", "q"])

    rows = points.select("id", F.col("vector").cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, f"id {dict(points.dtypes)['id']}, vector array<double>, cluster int, q array<double>")


def deep_clusters(points: DataFrame, edges: DataFrame | None, k: int, *, hidden: int = 64, dims: int = 10, gamma: float = 0.1, w: float = 0.5, alpha: float = 1.0, warm_up: int = 50, steps: int = 100, rate: float = 0.01, tol: float = 1e-3, seed: int = 0) -> tuple[Fit, Net, list[float]]:
    """(assignment and centres in the encoding, the trained net, losses by step) of points (id, vector) and cannot-link pairs (i, j).

    Without edges the pairs are those of points (with keys, signature, too) that have equal keys and different signatures; these are
    never made: two blocks of points are a tile (see of_tile), so that a step encodes a point once for each of its blocks.

    The autoencoder is trained alone for warm_up steps; k-means over the encodings gives the centres; then all is trained
    together. A step uses the gradient over all points and all pairs (Adam); targets are made with the clusters' sums of the
    step before. It ends early when less than tol of the points change their cluster, looked at every ten steps. Sums are
    made in one order, so the same rows in the same partitions give the same result.
    """
    spark = ready(points.sparkSession)
    own = staged(points.select("id", F.col("vector").cast("array<double>").alias("vector"), *(["keys", "signature"] if edges is None else [])))
    none = [F.lit(None).cast("array<long>").alias(c) for c in ("signs", "others")]
    if edges is None:
        both, n_pairs = _tiles(own, TILE)
    else:
        a, b = own.select(F.col("id").alias("i"), "vector"), own.select(F.col("id").alias("j"), F.col("vector").alias("other"))
        both = staged(edges.select("i", "j").join(a, "i").join(b, "j").select("vector", "other", *none))
        n_pairs = both.count()
    plain = own.select("vector", F.lit(None).cast("array<double>").alias("other"), *none)
    n = own.count()
    net = Net.drawn(len(own.first().vector), hidden, dims, k, seed, alpha)
    first, second, losses, taken = 0.0, 0.0, [], 0

    def adam(g: np.ndarray) -> None:
        nonlocal first, second, taken
        taken += 1
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move, at = rate * (first / (1 - 0.9**taken)) / (np.sqrt(second / (1 - 0.999**taken)) + 1e-8), 0
        for name, v in net.w.items():
            net.w[name] = v - move[at : at + v.size].reshape(v.shape)
            at += v.size

    for _ in range(warm_up):
        adam(_step(plain, net, None, gamma, 0.0, n, 1)[0])
    centers = kmeans(encoded(own, net), k, n_init=3, seed=seed)[1]
    net.w["mu"] = np.array([r.center for r in centers.orderBy("cluster").collect()])  # k rows
    rows = plain.unionByName(both) if n_pairs and w else plain
    totals, before, first, second, taken = _step(plain, net, None, gamma, 0.0, n, 1)[1], None, 0.0, 0.0, 0
    for step in range(steps):
        g, totals, loss = _step(rows, net, totals, gamma, w, n, max(1, n_pairs))
        losses.append(loss)
        adam(g)
        if step % 10 == 9:
            now = staged(encoded(own, net).select("id", "cluster"))
            changed = now.join(before.withColumnRenamed("cluster", "old"), "id").where("cluster <> old").count() if before is not None else n
            unstaged(before)
            before = now
            if changed < tol * n:
                break
    unstaged(before)
    found = staged(encoded(own, net))
    unstaged(own, both)
    table = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(net.w["mu"])], "cluster int, center array<double>")
    return Fit(found.select("id", "cluster"), table, losses[-1] if losses else 0.0, [], len(losses)), net, losses
