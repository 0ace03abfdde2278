"""Compression of vectors to codes: each part of a vector is replaced by the number of the nearest entry of its codebook.

The nearest entry is found by a float32 matrix product over all entries with an interval that rounding can't leave. Entries whose
intervals overlap the best are evaluated again in 64-bit integers, ties going to the lower number, so results are exact and the
same on every machine. Codebooks have a bounded size (entries times components) and are the only thing that reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch, hot_join, table, trimmed
from .vectors import integers, longest, whole

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rounding unit of float32 and float64.
_U32, _U64 = 2.0**-24, 2.0**-53
#: Rows that are compared with a codebook at a time.
_ROWS = 4096


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest entry, squared distance, entries evaluated in integers beside the chosen ones) for each row.

    Screened is |c|² - 2 x·c. Of the float32 product each of the m terms passes at most m + 2 roundings (two conversions, a
    product, sums in any order), so it is off by at most g |x| |c|, g = (m + 2) u / (1 - (m + 2) u) by Cauchy and Schwarz.
    """
    m = x.shape[1]
    g = (m + 2) * _U32 / (1 - (m + 2) * _U32)
    cross = (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    square = (entries * entries).sum(1).astype(np.float64)
    score = square - 2 * cross
    norms = np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None] * np.sqrt(square)
    half = 2 * g * norms * (1 + 64 * (m + 4) * _U64) + 8 * _U64 * (square + 2 * np.abs(cross)) + 1e-30
    open_ = score - half <= (score + half).min(1, keepdims=True)
    best = np.argmax(open_, 1)
    again = np.flatnonzero(open_.sum(1) > 1)
    evaluated = 0
    if len(again):
        row, entry = np.nonzero(open_[again])
        exact = ((x[again][row] - entries[entry]) ** 2).sum(1)
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(exact, starts)[row]
        hit = np.flatnonzero(exact == least)
        best[again[row[hit][::-1]]] = entry[hit][::-1]  # the first of equal ones is written last
        evaluated = len(row)
    return best, ((x - entries[best]) ** 2).sum(1), evaluated


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, vectors in parts, entries, squared distances), a few rows at a time."""
    n_parts, _, m = books.shape
    for whole_batch in batches:
        for at in range(0, whole_batch.num_rows, _ROWS):
            batch = whole_batch.slice(at, _ROWS)
            x = integers(batch["embedding"], n_parts * m, most).reshape(-1, n_parts, m)
            found = [nearest(x[:, p], books[p]) for p in range(n_parts)]
            yield batch, x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(books: np.ndarray, most: int) -> Callable:
    def run(batches):
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for _, x, entry, _ in _assigned(batches, books, most):
            for p in range(len(books)):
                np.add.at(sums[p], entry[:, p], x[:, p])
                counts[p] += np.bincount(entry[:, p], minlength=books.shape[1])
        part, entry = np.nonzero(counts)
        slot = (part * books.shape[1] + entry)[:, None] * books.shape[2] + np.arange(books.shape[2])
        yield pa.RecordBatch.from_arrays([pa.array(slot.ravel()), pa.array(sums[part, entry].ravel()), pa.array(np.repeat(counts[part, entry], books.shape[2]))], ["slot", "total", "n"])

    return trimmed(run)


def _coded(books: np.ndarray, most: int) -> Callable:
    def run(batches):
        for batch, _, entry, d in _assigned(batches, books, most):
            code = [bytes(row).hex() for row in entry.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(code, pa.string()), pa.array(d.sum(1), pa.int64())], ["vec_id", "label", "code", "error"])

    return trimmed(run)


def compress(vectors: DataFrame, n_parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), codebooks) of vectors (vec_id, label, embedding).

    Rows go whose vector is null or holds null or infinite components or NaN. Codebooks, at most 256 entries each, start as
    the parts of the rows of smallest vec_id (nulls last, equal ones by their vectors); in each round they become the floors
    of the means of what is assigned to them, and unused entries stay. Fewer rows than entries: as many entries as rows.
    Vectors of different lengths, or of one that n_parts doesn't divide, are filled up with zeros, which changes no distance.
    Repeated rows: each counts. No rows: no rows, empty codebooks. Other columns are ignored. Components so large that
    distances leave 64 bits raise ValueError.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = vectors.where(whole()).select("vec_id", "label", "embedding")
    n, size = longest(rows)
    m = max(1, -(-size // n_parts))
    most = int((2**61 / (n_parts * m)) ** 0.5)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()  # entries rows
    kind = pa.list_(pa.float64())
    start = integers(pa.array([list(r.embedding) for r in first], kind), n_parts * m, most) if first else np.zeros((0, n_parts * m), np.int64)
    books = np.ascontiguousarray(start.reshape(len(first), n_parts, m).swapaxes(0, 1))
    for _ in range(rounds if n else 0):
        moved = rows.select("embedding").mapInArrow(_sums(books, most), "slot long, total long, n long").groupBy("slot").agg(F.sum("total"), F.sum("n"))
        flat = books.reshape(-1)
        for slot, total, count in moved.collect():  # a row for each component of each entry
            flat[slot] = total // count
    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(_coded(books, most), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    return out if n else out.limit(0), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256; see compress. A label's errors are summed before they are joined,
    null being a label of its own."""
    scratch = Scratch(vectors.sparkSession, "codes")
    coded, books = compress(vectors)
    named = {"named": F.col("label").isNotNull(), "name": F.coalesce(F.col("label").cast("string"), F.lit(""))}
    rows = scratch.write(coded.withColumns(named).drop("label"), "coded")
    errors = scratch.write(rows.groupBy("named", "name").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "errors")
    return hot_join(rows, errors, ["named", "name"], "n").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12(spark, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _round_sql(i: int) -> str:
    """Assignment a{i} by codebooks c{i}, and the codebooks that follow."""
    return f"""
a{i} AS MATERIALIZED (SELECT r, p, w, e, d FROM (SELECT x.r, x.p, x.w, c.e, list_dot_product(x.w, x.w) - 2 * list_dot_product(x.w, c.w) + list_dot_product(c.w, c.w) AS d
    FROM x JOIN c{i} c USING (p)) QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, e) = 1),
m{i} AS (SELECT p, e, list(v ORDER BY k) AS w FROM (SELECT p, e, k, floor(sum(w[k]) / count(*)) AS v FROM a{i}, generate_series(1, (SELECT any_value(len(w)) FROM x)) AS g(k)
    GROUP BY p, e, k) GROUP BY p, e),
c{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{i}.w, c.w) AS w FROM c{i} c LEFT JOIN m{i} USING (p, e)),"""


OP12_SQL = f"""
WITH v AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0),
x AS MATERIALIZED (SELECT r, p, list_transform(embedding[p * (len(embedding) // {PARTS}) + 1 : (p + 1) * (len(embedding) // {PARTS})], lambda y: floor(256 * CAST(y AS DOUBLE))) AS w
    FROM v, generate_series(0, {PARTS - 1}) AS g(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, w FROM x WHERE r <= {ENTRIES}),{"".join(_round_sql(i) for i in range(ROUNDS + 1))}
f AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(list_transform(w, lambda y: CAST(y AS BIGINT)), ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256
FROM f JOIN v USING (r)
"""
