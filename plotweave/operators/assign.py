"""Assignment of points to centres: by distance, and under cannot-link penalties in the order of ids.

Distances are numpy work on Arrow batches; a point's vector is moved, or its distances to all centres where those are fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

from ..sources.tables import ranked, staged, unstaged

#: Points of a set of keys that are assigned one after the other in one task; a larger set is cut into so large chunks.
CHUNK = 20_000
#: Points that are compared with earlier ones at a time, where only near ones count.
STEP = 512


def vectors(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all lists of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distances(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, each a sum of squared differences."""
    out = np.empty((len(x), len(table)))
    for i, c in enumerate(table):
        d = x - c
        out[:, i] = np.einsum("ij,ij->i", d, d)
    return out


def closest(x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre, squared distance), ties to the first. A matrix product screens; centres that it can't tell apart from the best,
    by a bound on its rounding, are compared by their sums of squared differences."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0)
    x2, c2 = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", table, table)
    rough = c2 - 2 * (x @ table.T)
    slack = 8 * (x.shape[1] + 4) * 2.0**-53 * (x2[:, None] + c2)
    open_ = rough - slack <= (rough + slack).min(1, keepdims=True)
    row, centre = np.nonzero(open_)
    d = x[row] - table[centre]
    exact = np.einsum("ij,ij->i", d, d)
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    least = np.minimum.reduceat(exact, starts)
    hit = np.flatnonzero(exact == least[row])
    best = np.empty(len(x), np.int64)
    best[row[hit][::-1]] = centre[hit][::-1]  # the first of equal ones is written last
    return best, least


def within(x: np.ndarray, y: np.ndarray, limit: float) -> np.ndarray:
    """Whether a row of x and one of y lie at most limit apart. A matrix product screens; pairs for which its rounding could decide
    are compared by their sums of squared differences."""
    size = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)
    off = size - 2 * (x @ y.T) - limit * limit
    out = off <= 0
    row, col = np.nonzero(~(np.abs(off) > 8 * (x.shape[1] + 4) * 2.0**-53 * (size + limit * limit)))
    for at in range(0, len(row), 1 << 16):
        i, j = row[at : at + (1 << 16)], col[at : at + (1 << 16)]
        out[i, j] = np.sqrt(((x[i] - y[j]) ** 2).sum(1)) <= limit
    return out


def with_closest(rows: DataFrame, table: np.ndarray, names: list, cluster: str, kind: DataType | str) -> DataFrame:
    """Adds, of the centres in table, the name of the closest and its squared distance d2. Null vectors get nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["vector"]
            some = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False)) if len(table) else np.zeros(0, np.int64)
            best, d2 = closest(vectors(x.take(pa.array(some))), table)
            at, d = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            at[some], d[some] = best, d2
            named = pa.array([None if i < 0 else names[i] for i in at], arrow)
            yield batch.append_column(cluster, named).append_column("d2", pa.array(d, mask=at < 0))

    schema = StructType([*rows.schema.fields]).add(cluster, kind).add("d2", "double")
    arrow = to_arrow_type(schema[cluster].dataType)
    return rows.mapInArrow(run, schema)


def in_chunks(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Adds chunk: 0, or for points of a set of keys that has more than CHUNK points the number of its chunk in order of id."""
    most = most or CHUNK
    large = rows.where("keys IS NOT NULL").groupBy("keys").count().where(F.col("count") > most).select("keys")  # one in CHUNK rows at most
    if not large.limit(1).count():
        return rows.withColumn("chunk", F.lit(0))
    hot = ranked(rows.join(F.broadcast(large), "keys").select("id", "keys"), ["keys"], "id", name="_r")
    return rows.join(hot.select("id", F.floor((F.col("_r") - 1) / most).cast("int").alias("chunk")), "id", "left").fillna(0, ["chunk"])


def _near_in_order(x: np.ndarray, signs: np.ndarray, costs: np.ndarray, w: float, apart: float, before: list) -> tuple[np.ndarray, np.ndarray]:
    """(clusters, conflicts in them) of points of one set of keys in order of ids, after those of before: blocks of vectors, signs
    and clusters, to which these are added. A block's points are compared with all earlier ones by matrices."""
    chosen, hits, one = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.eye(costs.shape[1])
    for at in range(0, len(x), STEP):
        some, sign, cost = x[at : at + STEP], signs[at : at + STEP], costs[at : at + STEP]
        n = np.zeros(cost.shape)
        for y, others, c in before:
            n += (within(some, y, apart) & (sign[:, None] != others)) @ one[c]
        own = within(some, some, apart) & (sign[:, None] != sign)
        for i in range(len(some)):
            c = int(np.argmin(cost[i] + w * n[i]))
            chosen[at + i], hits[at + i] = c, n[i, c]
            n[i + 1 :, c] += own[i + 1 :, i]
        before.append((some, sign, chosen[at : at + STEP]))
    return chosen, hits


_COLUMNS = ["id", "keys", "chunk", "signature", "cluster", "d2", "open", "hits"]


def _priced(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """rows with the squared distances to all centres in the place of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(vectors(batch["vector"]), table)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * len(table), pa.int32()), pa.array(d.ravel()))
            yield batch.set_column(batch.schema.get_field_index("vector"), "vector", lists)

    return rows.mapInArrow(run, rows.schema)


def _in_order(bound: DataFrame, starts: DataFrame | None, table: np.ndarray, w: float, apart: float | None, priced: bool = False) -> DataFrame:
    """_COLUMNS of points (id, keys, chunk, signature, vector, open), each choosing after those of its chunk with smaller ids.

    starts: keys, chunk, signature (null: all), cluster, n, the choices of the chunks before. With apart, only points so near
    count, so the vectors of a chunk's earlier points are held, and there must be one chunk. hits: the conflicts of a point with
    those before it in the cluster that it chose. priced: vector has the distances to the centres.
    """
    k, kind = len(table), dict(bound.dtypes)["id"]
    columns = {"id": kind, "keys": "string", "chunk": "int", "signature": "string", "vector": "array<double>", "open": "boolean", "cluster": "int", "n": "long"}
    shaped = lambda df: df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, everyone, alike, before, names = None, None, {}, [], {}
        for batch in batches:
            is_start = batch["cluster"].is_valid().to_numpy(zero_copy_only=False)
            points = np.flatnonzero(~is_start)
            x = vectors(batch["vector"].take(pa.array(points)))
            costs = x if priced and len(points) else distances(x, table)
            chosen, hits, line = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64), 0
            sets = np.array(batch["keys"].to_pylist(), object) if apart is not None else np.zeros(0, object)
            for some in np.split(np.arange(len(sets)), np.flatnonzero(sets[1:] != sets[:-1]) + 1) if len(sets) else ():
                if sets[some[0]] != at:
                    at, before, names = sets[some[0]], [], {}
                signs = np.array([names.setdefault(s, len(names)) for s in batch["signature"].slice(some[0], len(some)).to_pylist()])
                chosen[some], hits[some] = _near_in_order(x[some], signs, costs[some], w, apart, before)
            for i, key in enumerate(zip(batch["keys"].to_pylist(), batch["chunk"].to_pylist(), batch["signature"].to_pylist(), batch["cluster"].to_pylist(), batch["n"].to_pylist(), batch["open"].to_pylist())) if apart is None else ():
                keys, chunk, sign, cluster, n, open_ = key
                if (keys, chunk) != at:
                    at, everyone, alike = (keys, chunk), np.zeros(k), {}
                if is_start[i]:
                    (everyone if sign is None else alike.setdefault(sign, np.zeros(k)))[cluster] = n
                    continue
                cost = costs[line]
                if not open_:
                    c = int(np.argmin(cost))
                else:
                    own = alike.setdefault(sign, np.zeros(k))
                    c = int(np.argmin(cost + w * (everyone - own)))
                    hits[line] = everyone[c] - own[c]
                    everyone[c] += 1
                    own[c] += 1
                chosen[line] = c
                line += 1
            if len(points):
                mine = batch.take(pa.array(points))
                yield pa.RecordBatch.from_arrays([mine["id"], mine["keys"], mine["chunk"], mine["signature"], pa.array(chosen, pa.int32()), pa.array(costs.min(1)), mine["open"], pa.array(hits)], _COLUMNS)

    rows = shaped(bound) if starts is None else shaped(bound).unionByName(shaped(starts))
    ordered = rows.repartition("keys", "chunk").sortWithinPartitions("keys", "chunk", F.col("cluster").isNull(), "id")
    return ordered.mapInArrow(run, f"id {kind}, keys string, chunk int, signature string, cluster int, d2 double, open boolean, hits long")


def _starts(assigned: DataFrame) -> DataFrame:
    """keys, chunk, signature, cluster, n: how many points of the chunks before chose each cluster, by the signatures that the
    chunk has, and null for all of them; none of 0."""
    counts = assigned.where("open").groupBy("keys", "chunk", "signature", "cluster").agg(F.count("*").alias("n"))
    total = counts.groupBy("keys", "chunk", "cluster").agg(F.sum("n").alias("n")).select("keys", "chunk", F.lit(None).cast("string").alias("signature"), "cluster", "n")
    asked = assigned.select("keys", "chunk", "signature").distinct()
    each = asked.join(counts.select("keys", "signature", "cluster").distinct(), ["keys", "signature"])
    every = assigned.select("keys", "chunk").distinct().join(total.select("keys", "cluster").distinct(), "keys").withColumn("signature", F.lit(None).cast("string"))
    wanted = each.unionByName(every.select(each.columns)).withColumn("n", F.lit(0).cast("long"))
    before = W.partitionBy("keys", "signature", "cluster").orderBy("chunk").rangeBetween(W.unboundedPreceding, -1)
    rows = counts.unionByName(total).unionByName(wanted.select(counts.columns)).withColumn("before", F.sum("n").over(before))
    return rows.groupBy("keys", "chunk", "signature", "cluster").agg(F.max("before").alias("n")).where("n > 0")


def penalised(rows: DataFrame, table: np.ndarray, w: float, apart: float | None) -> DataFrame:
    """id, keys, signature, cluster, d2 (to the nearest centre), open, hits of points (id, vector, keys, signature, open, chunk).

    Every point sees the choices of all points with smaller ids, of which only those with equal keys matter to it. So sets of
    keys are assigned apart from each other. A set of several chunks is assigned chunk by chunk from guessed counts of what
    the chunks before chose, all at once; a chunk whose counts turn out to be others is done again, until all counts are those
    of the result. The first chunk is right at once, the second at the latest a round later, so rounds end, and what they end
    with is what one pass over all ids gives.
    """
    keep = ["id", "keys", "signature", "cluster", "d2", "open", "hits"]
    free = with_closest(rows.where("keys IS NULL OR NOT open").select("id", "vector", "keys", "signature", "open"), table, list(range(len(table))), "cluster", "integer").withColumn("hits", F.lit(0).cast("long")).select(*keep)
    bound = rows.where("keys IS NOT NULL AND open")
    priced = apart is None and table.shape[0] < table.shape[1]  # the shorter of the two is moved
    bound = _priced(bound, table) if priced else bound
    found = staged(_in_order(bound, None, table, w, apart, priced))
    large = found.where("chunk > 0").select("keys").distinct()
    if apart is not None or not large.limit(1).count():
        return free.unionByName(found.select(*keep))
    large = staged(large)  # one in CHUNK rows at most
    done, known = staged(found.join(F.broadcast(large), "keys").select(*_COLUMNS)), None
    hot = bound.join(F.broadcast(large), "keys")
    while True:
        starts = staged(_starts(done))
        other = starts if known is None else starts.exceptAll(known).unionByName(known.exceptAll(starts))
        again = staged(other.select("keys", "chunk").distinct())
        unstaged(known)
        if not again.limit(1).count():
            break
        redone = _in_order(hot.join(F.broadcast(again), ["keys", "chunk"]), starts.join(F.broadcast(again), ["keys", "chunk"]), table, w, apart, priced)
        next_ = staged(redone.unionByName(done.join(F.broadcast(again), ["keys", "chunk"], "left_anti").select(*_COLUMNS)))
        unstaged(done, again)
        done, known = next_, starts
    unstaged(starts, again)
    cold = found.join(F.broadcast(large), "keys", "left_anti")
    return free.unionByName(cold.select(*keep)).unionByName(done.select(*keep))


# Repair pair by pair


def _in_turn(order: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What repaired() gives, pair after pair, for fewer than three clusters: there a later point can move, too."""
    at, hits = order[:, 0].copy(), np.zeros(len(order), np.int64)
    other = lambda i, not_this: next((c for c in order[i][1:] if c != not_this), None)
    for i in range(len(order)):
        j = i
        while True:
            rest = np.flatnonzero((at[j + 1 :] == at[i]) & (sign[j + 1 :] != sign[i]))
            if not len(rest):
                break
            j += 1 + int(rest[0])
            hits[i] += 1
            if (c := other(i, at[j])) is not None:
                at[i] = c
            elif (c := other(j, at[i])) is not None:
                at[j] = c
    return at, hits


def repaired(order: list[list[int]], signatures: list) -> tuple[list[int], list[int]]:
    """(clusters, pairs found in conflict by their first point) of points of equal keys, in order of ids, from their three
    closest clusters. Points begin in their closest cluster. Pairs are taken in order; if both are in one cluster and their
    signatures differ, the first moves to the closest cluster that is neither its closest of all nor the second's, or, if
    there is none, the second moves so.

    With three clusters the first can always move, so later points still stand where they began, and a point's way is given by
    these places: from its first conflict at home it goes to its second cluster, and from then on every conflict sends it to
    the other of its second and third. In the sequence of later points that stand in one of the two with other signatures, a
    conflict is the first of each run of one cluster. So conflicts are runs, counted once for all points with the same two
    clusters and signature; each point costs two searches in sorted places.
    """
    if not len(order):
        return [], []
    order = np.array(order)
    sign = np.unique(np.array([str(x) for x in signatures]), return_inverse=True)[1]
    if order.shape[1] < 3:
        at, hits = _in_turn(order, sign)
        return at.tolist(), hits.tolist()
    n, home = len(order), order[:, 0]
    at, hits, first = home.copy(), np.zeros(n, np.int64), np.full(n, n)
    places = {int(c): np.flatnonzero(home == c) for c in np.unique(home)}
    for p in places.values():
        starts = np.flatnonzero(np.append(True, sign[p][1:] != sign[p][:-1]))
        after = np.append(p[starts[1:]], n)
        first[p] = np.repeat(after, np.diff(np.append(starts, len(p))))  # the first later one of another signature
    moved = np.flatnonzero(first < n)
    key = np.stack([np.minimum(order[moved, 1], order[moved, 2]), np.maximum(order[moved, 1], order[moved, 2]), sign[moved]], 1)
    kinds, which = np.unique(key, axis=0, return_inverse=True)
    by_kind = np.argsort(which.ravel(), kind="stable")
    for (a, b, s), own in zip(kinds.tolist(), np.split(moved[by_kind], np.cumsum(np.bincount(which.ravel()))[:-1])):
        both = np.concatenate([places.get(a, home[:0]), places.get(b, home[:0])])
        both = np.sort(both[sign[both] != s])
        label = home[both]
        change = np.append(True, label[1:] != label[:-1]) if len(both) else np.zeros(0, bool)
        run = np.cumsum(change) - 1
        for second, third in ((a, b), (b, a)):
            mine = own[order[own, 1] == second]
            there = np.flatnonzero(label == second)
            to = np.searchsorted(both[there], first[mine], side="right")
            stays = to == len(there)
            at[mine], hits[mine] = second, 1
            goes = mine[~stays]
            if len(goes):
                hits[goes] = 2 + run[-1] - run[there[to[~stays]]]
                at[goes] = third if label[-1] == second else second
    return at.tolist(), hits.tolist()
