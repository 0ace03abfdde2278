"""Document fingerprints by context-triggered piecewise hashing, and their likeness.

A hash of the last seven bytes decides where chunks end; each chunk gives one character. The block size, a power of two,
is chosen by length and halved while it gives too few ends; a fingerprint has the signatures at that size and at twice it,
"size:signature:signature". Two fingerprints are compared by edit distance (insertions and deletions) at a block size that both have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import parts, ready, table, text_of

WINDOW, LEAST_BLOCK, WANTED, GRAM = 7, 4, 64, 4
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Bytes of a long text that are hashed at a time.
PIECE = 1 << 20
_MIX, _BASE = np.uint32(0x9E3779B1), 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2^64, and of its inverse; n is PIECE + 1 at most."""
    if len(_POWERS.get("up", ())) < n:
        size = min(1 << max(16, (n - 1).bit_length()), PIECE + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _rolling(data: np.ndarray) -> np.ndarray:
    """For each byte a mixed 32-bit hash of it and the six before it."""
    x = data.astype(np.uint32)
    h = x * np.uint32(0x01000193)
    factor = 0x01000193
    for k in range(1, WINDOW):
        factor = factor * 0x01000193 % 2**32
        h[k:] += x[:-k] * np.uint32(factor)
    h *= _MIX
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def _ends(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of chunks at this size, and their hashes; a piece of the text at a time."""
    if len(x) <= PIECE:
        h = _rolling(x)
        ends = np.flatnonzero((h & np.uint32(size - 1)) == size - 1)
        return ends + 1, h[ends]
    ends, hashes = [], []
    for at in range(0, len(x), PIECE):
        lead = min(at, WINDOW - 1)
        h = _rolling(x[at - lead : at + PIECE])[lead:]
        some = np.flatnonzero((h & np.uint32(size - 1)) == size - 1)
        ends.append(some + (at + 1))
        hashes.append(h[some])
    return np.concatenate(ends), np.concatenate(hashes)


def _chunks(x: np.ndarray, many: list[np.ndarray]) -> list[np.ndarray]:
    """For each list of cuts, the first of them 0 and the last the text's length, the hashes of the chunks between: sums of
    bytes times powers of a base by their place in the chunk."""
    out = [np.zeros(len(cuts) - 1, np.uint64) for cuts in many]
    for at in range(0, len(x), PIECE):
        piece = x[at : at + PIECE]
        up, down = _powers(len(piece) + 1)
        prefix = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=prefix[1:])
        for cuts, sums in zip(many, out):
            first, last, own = 0, len(sums), cuts
            if len(piece) < len(x):
                first, last = np.searchsorted(cuts, at, "right") - 1, np.searchsorted(cuts, at + len(piece), "left")
                own = np.clip(cuts[first : last + 1] - at, 0, len(piece))
            part = (prefix[own[1:]] - prefix[own[:-1]]) * down[own[:-1]]
            if cuts[first] < at:  # a chunk that began in a piece before
                part[:1] *= np.uint64(pow(_BASE, int(at - cuts[first]), 1 << 64))
            sums[first:last] += part
    return out


def _signatures(x: np.ndarray, many: list[np.ndarray]) -> list[str]:
    """One for each list of ends."""
    cuts = [np.concatenate(([0], ends if len(ends) and ends[-1] == len(x) else [*ends, len(x)])).astype(np.int64) for ends in many]
    out = []
    for chunk in _chunks(x, cuts):
        chunk ^= chunk >> np.uint64(29)
        chunk *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(ALPHABET[(chunk >> np.uint64(58)).astype(np.int64)].tobytes().decode())
    return out


def fingerprint(data: bytes) -> str:
    """Memory beside the bytes is that of a PIECE, some 40 MB, and of the chunk ends."""
    n = len(data)
    if not n:
        return f"{LEAST_BLOCK}::"
    x = np.frombuffer(data, np.uint8)
    block = LEAST_BLOCK
    while block * WANTED < n:
        block *= 2
    ends, h = _ends(x, max(LEAST_BLOCK, block // 2))
    pick = lambda size: ends[(h & np.uint32(size - 1)) == size - 1]
    while block > LEAST_BLOCK and len(pick(block)) < WANTED // 2:
        block //= 2
        if block > LEAST_BLOCK and len(ends) < WANTED // 2:
            ends, h = _ends(x, block // 2)
    return ":".join([str(block), *_signatures(x, [pick(block), pick(2 * block)])])


def _shared(a: str, b: str) -> int:
    """Length of the common prefix, found by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        at = (low + high + 1) // 2
        low, high = (at, high) if a[low:at] == b[low:at] else (low, at - 1)
    return low


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, all of a row's cells at once in one integer, without what both begin with."""
    same = _shared(a, b)
    if same:
        return same + _common(a[same:], b[same:])
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _near(a: str, b: str, size: int) -> float:
    if size > 2 * LEAST_BLOCK and min(len(a), len(b)) < GRAM:
        return 0.0  # repetitive texts without ends at this size; their few characters agree by chance
    if a == b:
        return 1.0
    k = min(GRAM, len(a), len(b))
    if not k or {a[i : i + k] for i in range(len(a) - k + 1)}.isdisjoint(b[i : i + k] for i in range(len(b) - k + 1)):
        return 0.0
    return 2.0 * _common(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints. 0 if block sizes are further apart than twice, or no four characters agree in a row."""
    if a == b:
        return 1.0
    (p, a1, a2), (q, b1, b2) = a.split(":"), b.split(":")
    p, q = int(p), int(q)
    if p == q:
        return max(_near(a1, b1, p), _near(a2, b2, 2 * p))
    if q == 2 * p:
        return _near(a2, b1, q)
    return _near(a1, b2, p) if p == 2 * q else 0.0


_OUT = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _successors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part, guest, doc_id: each part's own documents, then the one that follows them."""
    from plotweave.llm.fingerprints import fingerprint, likeness

    own, kind = None, None  # the document before, whose next has not come yet: part, doc_id, text, bytes, fingerprint
    ids: list = []
    rows: list[tuple] = []
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for part, guest, doc_id, text in zip(*(batch[c].to_pylist() for c in ("part", "guest", "doc_id", "text"))):
            if guest and (own is None or own[0] != part):
                continue  # only the first guest is a part's next document
            data = text.encode("utf-8", "surrogatepass")
            mark = own[3] if own and own[2] == text else fingerprint(data)
            if own and own[0] == part:
                n = len(own[2])
                edited = (own[2][: n - n // 2] + text[: n // 2]).encode("utf-8", "surrogatepass")
                changed = fingerprint(edited)
                ids.append(own[1])
                rows.append((n, hashlib.sha256(edited).hexdigest(), own[3], changed, likeness(own[3], changed), likeness(own[3], mark)))
            own = None if guest else (part, doc_id, text, mark)
            if len(rows) >= 2000:
                yield _batch(ids, rows, kind)
                ids, rows = [], []
    if rows:
        yield _batch(ids, rows, kind)


def _batch(ids: list, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows), _OUT))], ["doc_id", *(n for n, _ in _OUT)])


def _with_part(rows: DataFrame, cuts: list, shares: list[int]) -> DataFrame:
    """Adds part: by the number of cuts that are not above doc_id, found by halving; 0 for null. Rows of a cut itself (for the
    first part: of null) that shares says are many are cut further, by ranges of h, and stand before the part's others."""
    low = F.lit(0)
    for step in reversed([1 << b for b in range(len(cuts).bit_length())]):
        above = F.get(F.lit(cuts), low + (step - 1)) <= F.col("doc_id")
        rows = rows.withColumn("part", F.when((low + step <= len(cuts)) & above, low + step).otherwise(low))
        low = F.col("part")
    rows, many = rows.withColumn("part", low), F.get(F.lit(shares), low)
    cut = F.when(low == 0, F.col("doc_id").isNull()).otherwise(F.col("doc_id") == F.get(F.lit(cuts), low - 1)) if cuts else F.col("doc_id").isNull()
    place = F.least(F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * many), many - 1)
    return rows.withColumn("part", (low * (max(shares) + 1) + F.when(cut & (many > 0), place).otherwise(many)).cast("int"))


def _hot_rows(texts: DataFrame, n: int) -> list:
    """doc_id and h of the groups of equal rows that have more than 1/n of all rows, hence fewer than n."""
    counts = texts.groupBy("doc_id", "h").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    return counts.where((F.col("count") > 1) & (F.col("count") > total // n)).select("doc_id", "h").collect()


#: Copies of a row that a task writes at a time.
COPIES = 10_000


def _copies_apart(texts: DataFrame, hot: list) -> tuple[DataFrame, DataFrame]:
    """Rows with one row only of each hot group, the last one; and doc_id, text, copies: how many more the group has. All of
    these are followed by their like, so they are computed once and needn't go to their group's part."""
    spark, kind = texts.sparkSession, dict(texts.dtypes)["doc_id"]
    keys = F.broadcast(spark.createDataFrame(hot, f"hot_id {kind}, hot_h long"))  # fewer than n rows
    same = F.col("doc_id").eqNullSafe(F.col("hot_id")) & (F.col("h") == F.col("hot_h"))
    groups = texts.join(keys, same, "left_semi").groupBy("doc_id", "h", "text").count()
    rows = texts.join(keys, same, "left_anti").unionByName(groups.drop("count"))
    return rows, groups.select("doc_id", "text", (F.col("count") - 1).alias("copies")).where("copies > 0")


def _own_successors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What documents give that are followed by an equal one; with copies."""
    from plotweave.llm.fingerprints import fingerprint, likeness

    for batch in batches:
        rows = []
        for text in batch["text"].to_pylist():
            n = len(text)
            edited = (text[: n - n // 2] + text[: n // 2]).encode("utf-8", "surrogatepass")
            mark, changed = fingerprint(text.encode("utf-8", "surrogatepass")), fingerprint(edited)
            rows.append((n, hashlib.sha256(edited).hexdigest(), mark, changed, likeness(mark, changed), 1.0))
        if rows:
            yield _batch(batch["doc_id"].to_pylist(), rows, batch.schema.field("doc_id").type).append_column("copies", batch["copies"])


def _repeated(copies: DataFrame, schema: str) -> DataFrame:
    """The results of copies, as many rows as they say, written by many tasks."""
    once = copies.mapInArrow(_own_successors, f"{schema}, copies long")
    lots = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))).alias("lot")
    spread = once.select("*", lots).repartition(parts(copies.sparkSession), F.xxhash64("fingerprint", "lot"))
    mine = F.least(F.lit(COPIES), F.col("copies") - F.col("lot") * COPIES).cast("int")
    return spread.withColumn("mine", F.explode(F.sequence(F.lit(1), mine))).drop("copies", "lot", "mine")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row for each row of docs.

    A document's edited text has its last half replaced by the first characters of the next document by doc_id, and after
    the last comes the first. Documents go to parts by ranges of doc_id, so whole texts move once; a part's next document,
    the first of the part that follows, is sent to both.

    Null text counts as empty. Very long texts: whole; hashed in pieces. Null doc_ids come first. Rows of equal doc_id are
    ordered by a hash of their text, and make several parts if they are many; equal rows follow each other, and groups of them
    that have more rows than a part are computed once and never gathered. A single row is its own next. No rows: no rows. Other columns are ignored.
    """
    spark = ready(docs.sparkSession)
    n = 4 * parts(spark, 8)
    some = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n), F.count("*"), F.count("doc_id")).first()
    quantiles = some[0] or []
    cuts, nulls = sorted(set(quantiles)), n * (some[1] - some[2]) // max(1, some[1])
    shares = [nulls if nulls > 1 else 0, *(k if (k := quantiles.count(c)) > 1 else 0 for c in cuts)]
    texts = docs.select("doc_id", F.xxhash64(text_of()).alias("h"), text_of().alias("text"))
    hot = _hot_rows(texts, n)
    if hot:
        texts, copies = _copies_apart(texts, hot)
        return _in_parts(texts, cuts, shares).unionByName(_repeated(copies, _schema(docs)))
    return _in_parts(texts, cuts, shares)


def _in_parts(texts: DataFrame, cuts: list, shares: list[int]) -> DataFrame:
    """Each row with the one that follows it: parts are sorted, and what comes after a part's last row is sent to it, too."""
    spark, schema = texts.sparkSession, _schema(texts)
    rows = _with_part(texts, cuts, shares)
    first = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "h")).alias("first")
    firsts = {r["part"]: (r["first"]["doc_id"], r["first"]["h"]) for r in rows.groupBy("part").agg(first).collect()}  # a row for each part
    order = sorted(firsts)
    heads = [(order[i - 1], *firsts[p]) for i, p in enumerate(order)]  # the part that it is sent to, doc_id, h
    if not heads:
        return rows.select("part", F.lit(False).alias("guest"), "doc_id", "text").limit(0).mapInArrow(_successors, schema)
    guests = spark.createDataFrame(heads, f"part int, its_id {dict(texts.dtypes)['doc_id']}, its_h long")
    send = F.broadcast(guests.groupBy("its_id", "its_h").agg(F.collect_list("part").alias("to")))  # as many rows as parts
    joined = rows.join(send, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("h") == F.col("its_h")), "left")
    none = F.array().cast("array<struct<part:int,guest:boolean>>")
    dealt = F.concat(F.array(F.struct("part", F.lit(False).alias("guest"))), F.coalesce(F.transform("to", lambda p: F.struct(p.alias("part"), F.lit(True).alias("guest"))), none))
    dealt = joined.select(F.explode(dealt).alias("x"), "doc_id", "h", "text").select("x.part", "x.guest", "doc_id", "h", "text")
    return dealt.repartition(parts(spark), "part").sortWithinPartitions("part", "guest", "doc_id", "h", "text").mapInArrow(_successors, schema)


def _schema(docs: DataFrame) -> str:
    return f"doc_id {dict(docs.dtypes)['doc_id']}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op3(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
