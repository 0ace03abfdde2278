"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

1. Each text's word shingles are hashed to 64 bits; one hash function puts them into bins, each bin keeps its least value,
   and an empty bin takes that of a bin found by its own sequence of hashes (optimal densification). Bands of bins are keys.
2. Rows with equal sets of shingles form a class and are one node from here on.
3. In each bucket the node that shares most buckets with others is the centre of a star; only centre and members are
   compared, on full sets. Linked nodes form components.
4. Members that aren't in the component of their bucket's first centre become centres too, and are compared with the bucket's
   members of other components. Blocks of CHUNK centres and CHUNK members look at each pair once, in the first bucket that
   both are in; sketches, an exact bound on what two sets share, leave few pairs whose full sets are compared. So no link
   between two members of a bucket is lost, while a bucket of copies of one text costs one comparison for each member.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .scratch import Scratch, hot_join, maybe_in, parts, table, text_of, trimmed

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_CACHED_WORDS = 250_000
#: Centres, and members, of one block.
CHUNK = 256
#: Groups of hashes whose sizes bound from above what two sets have in common.
GROUPS = 128
#: Pairs looked at by their sketches in the first round; each further round looks at eight times as many.
WORK = 2_000_000_000


@dataclass(frozen=True)
class Near:
    """The defaults are for a similarity of 0.8: two such texts share no band with a probability of 5e-8."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < _CACHED_WORDS:
            self[word] = h
        return h


_HASHES = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of k words; of all words if there are fewer; of none for no word."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    size = min(k, n)
    x = np.full(n - size + 1, size * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for j in range(size):
        x = _mix(x + h[j : n - size + 1 + j])
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def sketch(hashes: np.ndarray) -> bytes:
    """How many hashes fall into each group, one byte each. No two sets share more than the sum of their smaller counts, and
    a count that doesn't fit is as large as can be."""
    counts = np.bincount((hashes % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


@dataclass
class _Side:
    """One side of a block: a row for each of its nodes."""

    id: np.ndarray
    n: np.ndarray
    root: np.ndarray
    sketch: np.ndarray
    bands: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> _Side:
        ids, sizes, roots = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        return cls(ids, sizes, roots, np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, GROUPS), np.array([r[4] for r in rows], np.int64))


def may_link(held: _Side, i: int, side: _Side, bucket: int, both: bool, percent: int) -> np.ndarray:
    """Which of held can be linked with the i-th of side, best first. Pairs of one component and pairs that share an earlier
    band, whose block has them, are left out; so are those that cannot reach the similarity by their sizes and sketches, and,
    if both are centres, one of the two ways round."""
    n, root, own = side.n[i], side.root[i], side.sketch[i]
    other = (held.root != root) & (100 * np.minimum(held.n, n) >= percent * np.maximum(held.n, n))
    some = np.flatnonzero(other & (held.id < side.id[i]) if both else other)
    same = held.bands[some] == side.bands[i]
    some = some[held.bands[some, same.argmax(1)] == bucket]
    table = held.sketch[some]
    most = np.minimum(table, own).sum(1, dtype=np.int64)
    likeness = most / np.maximum(held.n[some] + n - most, 1)
    ok = (100 * most >= percent * (held.n[some] + n - most)) | (table == 255).any(1) | (own == 255).any()
    return some[ok][np.argsort(-likeness[ok], kind="stable")]


_BLOCK = ["bucket", "i", "j"]
#: side: 0 for a centre, 1 for a member, 2 for a member that is a centre, too.
_PICKED = "bucket long, i int, j int, side int, id long, root long, partners array<long>"


def _compare(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, the centres first. Out come, block by block, the centres and members of pairs that may be
        links: members with the centres that they are to be compared with."""
        key, held, waiting, sides = None, [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held or not waiting:
                return
            left, right, used, out = _Side.of(held), _Side.of(waiting), set(), []
            for k in range(len(waiting)):
                some = may_link(left, k, right, key[0], sides[k] == 2, percent)
                if len(some):
                    used.update(some.tolist())
                    out.append((*key, 1, int(right.id[k]), int(right.root[k]), left.id[some].tolist()))
            out += [(*key, 0, int(left.id[k]), int(left.root[k]), None) for k in sorted(used)]
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [*_BLOCK, "side", "id", "root", "partners"])

        for batch in batches:
            for bucket, i, j, side, *node in zip(*(batch[c].to_pylist() for c in (*_BLOCK, "side", "id", "n", "root", "sketch", "bands"))):
                if key != (bucket, i, j):
                    yield from flush()
                    key, held, waiting, sides = (bucket, i, j), [], [], []
                if not side:
                    held.append(node)
                elif held:
                    waiting.append(node)
                    sides.append(side)
        yield from flush()

    return trimmed(compare)


class Signer:
    """Band keys of a set by one-permutation hashing."""

    def __init__(self, near: Near):
        self.near, self.bins = near, near.bands * near.rows
        self.bin_ids = np.arange(self.bins, dtype=np.uint64)
        self.factors = _mix(np.arange(1, near.rows + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)

    def keys(self, sets: list[np.ndarray]) -> np.ndarray:
        """Of each set, none of them empty, a row of band keys. All sets are in one sort; at most 2**31 bins."""
        mixed, bins = _mix(np.concatenate(sets) + np.uint64(0x632BE59BD9B4E019)), np.uint64(self.bins)
        first_bin = np.repeat(np.arange(len(sets), dtype=np.uint64) * bins, [len(s) for s in sets])
        both = np.sort((first_bin + ((mixed >> np.uint64(32)) * bins >> np.uint64(32)) << np.uint64(32)) | (mixed & np.uint64(0xFFFFFFFF)))
        where = (both >> np.uint64(32)).astype(np.int64)
        first = np.concatenate(([True], where[1:] != where[:-1]))
        values, filled = np.zeros(len(sets) * self.bins, np.uint64), np.zeros(len(sets) * self.bins, bool)
        values[where[first]] = both[first] & np.uint64(0xFFFFFFFF)
        filled[where[first]] = True
        empty, attempt = np.flatnonzero(~filled), 0
        while len(empty):
            attempt += 1
            own = empty % self.bins
            tried = (_mix(self.bin_ids + np.uint64(attempt * 0x9E3779B97F4A7C15 % 2**64)) % bins).astype(np.int64)[own] + (empty - own)
            hit = filled[tried]
            values[empty[hit]] = values[tried[hit]]
            empty = empty[~hit]
        rows = values.reshape(len(sets), self.near.bands, self.near.rows)
        return _mix((_mix(rows + np.uint64(1)) * self.factors).sum(2, dtype=np.uint64) + np.arange(self.near.bands, dtype=np.uint64))


def _sign(near: Near):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plotweave.llm.near_dedup import shingles

        signer = Signer(near)
        for batch in batches:
            sizes, digests, keys, sketches = [], [], [], []
            waiting: list[np.ndarray] = []

            def flush() -> None:
                if waiting:
                    keys.append(signer.keys(waiting).view(np.int64).ravel())
                    waiting.clear()

            held = 0
            for text in batch["text"]:
                s = shingles(text.as_py(), near.words)
                raw = s.tobytes()
                sizes.append(len(s))
                digests.append((np.uint64(xxhash.xxh3_64_intdigest(raw)).view(np.int64), np.uint64(xxhash.xxh64_intdigest(raw)).view(np.int64)))
                sketches.append(sketch(s))
                if len(s):
                    waiting.append(s)
                    held += len(s)
                    if len(waiting) == 256 or held > 200_000:
                        flush()
                        held = 0
            flush()
            counts = np.where(np.array(sizes, np.int64) > 0, near.bands, 0)
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            out = batch.drop_columns(["text"])
            d = [pa.array([int(x[i]) for x in digests], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(sizes, pa.int64()), *d, bands, pa.array(sketches, pa.binary())], [*out.schema.names, "n", "d1", "d2", "bands", "sketch"])

    return trimmed(sign)


def similar(own: np.ndarray, other: np.ndarray, percent: int) -> bool:
    if len(own) > len(other):
        own, other = other, own
    at = np.searchsorted(other, own)
    common = int((other[np.minimum(at, len(other) - 1)] == own).sum())
    return 100 * common >= percent * (len(own) + len(other) - common)


def _confirm(near: Near):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, centres first. Each member is compared, on full sets, with its partners, but not with a
        second one of a component that it is linked with."""
        from plotweave.llm.near_dedup import shingles

        key, held = None, {}
        for batch in batches:
            xs, ys = [], []
            for bucket, i, j, side, node, root, partners, text in zip(*(batch[c].to_pylist() for c in (*_BLOCK, "side", "id", "root", "partners", "text"))):
                if key != (bucket, i, j):
                    key, held = (bucket, i, j), {}
                s = shingles(text, near.words)
                if not side:
                    held[node] = root, s
                    continue
                linked = set()
                for centre in partners:
                    its_root, own = held[centre]
                    if its_root not in linked and similar(own, s, near.percent):
                        linked.add(its_root)
                        xs.append(centre)
                        ys.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["x", "y"])

    return trimmed(confirm)


def _confirmed(picked: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """picked: rows of _PICKED. The links among their pairs."""
    rows = picked.join(texts, "id").repartition(parts(texts.sparkSession), *_BLOCK).sortWithinPartitions(*_BLOCK, "side")
    return rows.mapInArrow(_confirm(near), "x long, y long")


def _keys(text: Column) -> list[Column]:
    """t1, t2, k: what tells a row's text and doc_id from others. The seed of a second column's hash is the first one's: a
    number before the text makes the two hashes of the text independent."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.xxhash64("doc_id").alias("k")]


_KEYS = ["t1", "t2", "k"]


def _chosen_texts(keyed: DataFrame, chosen: DataFrame, scratch: Scratch) -> DataFrame:
    """id, text for the rows of keyed that chosen names by _KEYS."""
    texts = maybe_in(keyed, chosen, "t1").where("maybe").select(*_KEYS, "text").dropDuplicates(_KEYS)
    return scratch.write(texts.join(chosen, _KEYS).select("id", "text"), "texts")


def near_classes(docs: DataFrame, near: Near, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows has doc_id, n, d1, d2, t1, t2, k for each row of docs; classes has d1, d2, count, id, root, component."""
    keyed = docs.select("doc_id", *_keys(text_of()), text_of().alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    rows = scratch.write(keyed.mapInArrow(_sign(near), f"doc_id {kind}, t1 long, t2 long, k long, n long, d1 long, d2 long, bands array<long>, sketch binary"), "rows")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t1", "t2", "k", "n", "bands", "sketch")).alias("best")
    classes = rows.where("n > 0").groupBy("d1", "d2").agg(best, F.count("*").alias("count"))
    classes = scratch.write(classes.select("d1", "d2", "count", *[f"best.{c}" for c in ("doc_id", "t1", "t2", "k", "n", "bands", "sketch")], F.monotonically_increasing_id().alias("id")), "classes")

    # nodes: classes that share a bucket with another one, and those buckets. Each has near.bands buckets at most.
    banded = classes.select("id", F.explode("bands").alias("bucket"))
    buckets = scratch.write(banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    shared = hot_join(banded, buckets, ["bucket"], "size").groupBy("id").agg(F.sum("size").alias("shared"), F.collect_list("bucket").alias("buckets"))
    nodes = scratch.write(shared.join(classes.select("id", "t1", "t2", "k", "n", "bands", "sketch"), "id"), "nodes")
    texts = _chosen_texts(keyed, nodes.select("id", "t1", "t2", "k"), scratch)
    alike = lambda a, b: 100 * F.least(a, b) >= near.percent * F.greatest(a, b)

    # Stars: blocks of one centre and the members that it may be linked with, once for all their buckets.
    members = nodes.select(F.explode("buckets").alias("bucket"), "id", "n", "shared")
    centre = F.max(F.struct("shared", -F.col("id"), "n")).alias("c")
    stars = scratch.write(members.groupBy("bucket").agg(centre, F.count("*").alias("size")).select("bucket", (-F.col("c.col2")).alias("centre"), F.col("c.n").alias("m"), F.col("c.shared").alias("reach"), "size"), "stars")
    pairs = hot_join(members, stars, ["bucket"], "size").where(alike(F.col("n"), F.col("m")) & (F.col("id") != F.col("centre")))
    chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("reach") / (8 * CHUNK))).cast("int").alias("i")
    pairs = scratch.write(pairs.select("centre", "id", chunk).distinct(), "pairs")
    block = [F.col("centre").alias("bucket"), "i", F.lit(0).alias("j")]
    picked = pairs.select(*block, F.lit(1).alias("side"), "id", F.col("id").alias("root"), F.array("centre").alias("partners"))
    picked = picked.unionByName(pairs.select(*block).distinct().select("*", F.lit(0).alias("side"), F.col("bucket").alias("id"), F.col("bucket").alias("root"), F.lit(None).cast("array<long>").alias("partners")))
    links = scratch.write(_confirmed(picked, texts, near), "links0")

    # Members outside their centre's component become centres too, against all of the bucket that are not in theirs. All
    # at once if their pairs are few enough to be looked at, else a share first, as what that links needn't be looked at.
    done, step, last = None, 0, False
    while True:
        roots = components(links, scratch, f"components{step}")
        if last:
            break
        placed = scratch.write(nodes.select("id", "shared", "buckets").join(roots, "id", "left").select("id", "shared", F.coalesce("root", "id").alias("root"), "buckets"), f"placed{step}")
        members = placed.select(F.explode("buckets").alias("bucket"), "id", "root", "shared")
        top = F.max(F.struct("shared", -F.col("id"), "root")).alias("top")
        mixed = members.groupBy("bucket").agg(top, F.count("*").alias("size"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
        mixed = scratch.write(mixed.select("bucket", F.col("top.root").alias("top"), "size"), f"mixed{step}")
        open_ = scratch.write(hot_join(members, mixed, ["bucket"], "size").select("bucket", "id", "root", (F.col("root") != F.col("top")).alias("outside"), "size"), f"open{step}")
        outside = open_.where("outside").select("bucket", "id", "root", "size")
        if done is not None:
            outside = outside.join(done, ["bucket", "id"], "left_anti")
        work = outside.agg(F.sum("size")).first()[0] or 0
        if not work:
            break
        share, last = WORK * 8**step / work, work <= WORK * 8**step
        if not last:
            outside = scratch.write(outside.where(F.pmod(F.xxhash64("id", "bucket"), F.lit(1 << 30)) < int(share * (1 << 30))), f"outside{step}")
            done = outside.select("bucket", "id") if done is None else done.unionByName(outside.select("bucket", "id"))
        sizes = outside.groupBy("bucket").agg(F.count("*").alias("centres"), F.first("size").alias("size"))
        sizes = scratch.write(sizes.select("bucket", "size", F.ceil(F.col("centres") / CHUNK).cast("int").alias("ni"), F.ceil(F.col("size") / CHUNK).cast("int").alias("nj")), f"sizes{step}")
        side = F.when(F.col("outside"), 2).otherwise(1) if last else F.lit(1)
        of = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        centres = hot_join(outside.drop("size"), sizes, ["bucket"], "size").select("bucket", "id", "root", of("ni").alias("i"), each("nj").alias("j"), F.lit(0).alias("side"))
        others = hot_join(open_.drop("size"), sizes, ["bucket"], "size").select("bucket", "id", "root", each("ni").alias("i"), of("nj").alias("j"), side.alias("side"))
        rows_ = centres.unionByName(others).join(nodes.select("id", "n", "sketch", "bands"), "id")
        rows_ = rows_.repartition(parts(docs.sparkSession), *_BLOCK).sortWithinPartitions(*_BLOCK, "side")
        picked = scratch.write(rows_.mapInArrow(_compare(near.percent), _PICKED), f"picked{step}")
        links = links.unionByName(scratch.write(_confirmed(picked, texts, near), f"links{step + 1}"))
        scratch.drop(f"placed{step}", f"mixed{step}", f"open{step}", f"sizes{step}", f"picked{step}")
        step += 1

    grouped = scratch.write(classes.select("d1", "d2", "count", "id", "doc_id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "grouped")
    tops = scratch.write(grouped.groupBy("root").agg(F.min("doc_id").alias("component"), F.count("*").alias("size")), "tops")
    named = scratch.write(hot_join(grouped, tops, ["root"], "size").select("d1", "d2", "count", "id", "root", "component"), "named")
    scratch.drop("texts", "nodes", "buckets", "stars", "pairs", "classes", "grouped", "tops")
    return rows.select("doc_id", "n", "d1", "d2", *_KEYS), named


def _labelled(docs: DataFrame, near: Near) -> tuple[DataFrame, Scratch]:
    """doc_id, n, component, kept and _KEYS for each row of docs."""
    scratch = Scratch(docs.sparkSession, "near")
    rows, classes = near_classes(docs, near, scratch)
    out = ["doc_id", "n", "component", F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"), *_KEYS]
    linked = hot_join(rows.where("n > 0"), classes.select("d1", "d2", "count", "component"), ["d1", "d2"], "count").select(*out)
    return linked.unionByName(rows.where("n = 0").withColumn("component", F.col("doc_id")).select(*out)), scratch


def near_dedup(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs.

    Two texts are linked when percent % of all their shingles are in both; component_id is the smallest doc_id that can be
    reached, and kept says that it is the row's own. Shingles are compared by 64-bit hashes: two sets of m shingles seem to
    share one that they don't with a probability of m * m / 2**64.

    Null text and text without words: no shingles, no links, kept. Fewer words than a shingle has: one shingle of them all.
    Very long texts: whole; a worker holds a block's centres, CHUNK sets at most, and one batch of texts.
    Null doc_id: it joins a component like others but never names it unless all are null (component_id null, kept).
    Repeated rows: linked; rows of the smallest doc_id are all kept. No rows: no rows. Other columns are ignored.
    """
    return _labelled(docs, near)[0].select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def keep_one(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """The rows of docs, with all their columns, that near_dedup keeps. Each row is judged by its own text and doc_id, so that
    of two rows with equal doc_id and other texts one can go. For nulls, ties and repeated rows see near_dedup."""
    labelled, scratch = _labelled(docs, near)
    gone = scratch.write(labelled.where("NOT kept").select(*_KEYS).distinct(), "gone")
    whole = maybe_in(docs.select(F.struct("*").alias("row"), *_keys(text_of())), gone, "t1")
    stay = whole.where("maybe").join(gone, _KEYS, "left_anti")
    return whole.where("NOT maybe").select("row.*").unionByName(stay.select("row.*"))


def op5(spark, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), Near(words=3, percent=85, bands=32, rows=5))
