"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. A store keeps, in the shared folder,
- postings: which document holds which key (what makes deletion possible),
- counts: for each key how many documents hold it, and the largest doc_id of these (exact),
- filters: a cuckoo filter for each shard of the keys that enough documents hold. Postings that no filter knows stay where they are; only the others
  are shuffled to the exact table. Cuckoo filters, unlike Bloom filters, forget a key when deletions make it rare.
Keys are stored as two hashes of 64 bits with different seeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .scratch import HOT_KEYS, Scratch, hot_join, maybe_in, ready, table, text_of, trimmed

SPACE, UPPER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Keys of a shard, at most about twice as many.
SHARD_KEYS = 1 << 20
#: Filters that a task has at a time, some 25 million keys.
FILTER_BYTES = 64 << 20
#: Shards lie in the tables of as many changes; then all are written together.
GENERATIONS = 16


class CuckooFilter:
    """Buckets of four 16-bit fingerprints. Keys are pairs of 64-bit hashes and must be inserted once each."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int = 64, data: bytes | None = None):
        if data is None:
            self.table = np.zeros((1 << max(2, int(capacity / (self.SLOTS * 0.85))).bit_length(), self.SLOTS), np.uint16)
        else:
            self.table = np.frombuffer(data, np.uint16).reshape(-1, self.SLOTS).copy()

    def places(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        fp = (a.view(np.uint64) >> np.uint64(48)) | np.uint64(1)
        first = b.view(np.uint64) & mask
        return fp, first, self.other(first, fp)

    def other(self, place, fp):
        return (place ^ (fp * np.uint64(0x5BD1E995))) & np.uint64(len(self.table) - 1)

    def contains(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        fp, i, j = self.places(a, b)
        return (self.table[i] == fp[:, None]).any(1) | (self.table[j] == fp[:, None]).any(1)

    def insert(self, a: np.ndarray, b: np.ndarray) -> bool:
        """False if the filter is too full; it must then be built anew, larger."""
        rng = np.random.default_rng(0)
        for fp, i, j in zip(*(x.tolist() for x in self.places(a, b))):
            for place in (i, j):
                free = np.flatnonzero(self.table[place] == 0)
                if len(free):
                    self.table[place, free[0]] = fp
                    break
            else:
                place = i
                for _ in range(self.KICKS):
                    slot = rng.integers(self.SLOTS)
                    self.table[place, slot], fp = fp, int(self.table[place, slot])
                    place = int(self.other(np.uint64(place), np.uint64(fp)))
                    free = np.flatnonzero(self.table[place] == 0)
                    if len(free):
                        self.table[place, free[0]] = fp
                        break
                else:
                    return False
        return True

    def delete(self, a: np.ndarray, b: np.ndarray) -> None:
        for fp, i, j in zip(*(x.tolist() for x in self.places(a, b))):
            for place in (i, j):
                held = np.flatnonzero(self.table[place] == fp)
                if len(held):
                    self.table[place, held[0]] = 0
                    break

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> CuckooFilter:
        capacity = len(a)
        while not (new := cls(capacity)).insert(a, b):
            capacity *= 2
        return new

    def dump(self) -> bytes:
        return self.table.tobytes()


def line_keys(text: Column, min_chars: int) -> Column:
    """array of (a, b): the distinct keys of at least min_chars code points."""
    keys = F.transform(F.split(text, "\n", -1), lambda line: F.translate(F.btrim(line, F.lit(SPACE)), UPPER, UPPER.lower()))
    keys = F.filter(keys, lambda k: F.char_length(k) >= min_chars)
    return F.array_distinct(F.transform(keys, lambda k: F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"))))


#: Spark hashes columns one after the other, each with the last one's hash as seed: the seed of the line after a number.
_SEED = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)


def _key_of(line: bytes) -> tuple[int, int]:
    """What line_keys has for a stripped and lower-cased line."""
    return xxhash.xxh64_intdigest(line, 42), xxhash.xxh64_intdigest(line, _SEED)


def _row_key() -> list[Column]:
    """r1, r2: what tells a row's doc_id and text from others."""
    return [F.xxhash64("doc_id", text_of()).alias("r1"), F.xxhash64(F.lit(1), "doc_id", text_of()).alias("r2")]


def postings(docs: DataFrame, min_chars: int) -> DataFrame:
    return docs.select("doc_id", *_row_key(), F.explode(line_keys(text_of(), min_chars)).alias("key")).select("doc_id", "r1", "r2", "key.a", "key.b")


def _shard(bits: int) -> Column:
    """The first bits of b, as a number from 0: shards are ranges of b."""
    return (F.shiftright("b", 64 - bits) + (1 << (bits - 1))).cast("int").alias("shard")


class LineStore:
    """State of the line dedup over all documents inserted and not deleted.

    Postings are runs, one for each insertion, sorted by key within their files; a deletion adds the doc_ids that it takes out
    of the runs before it. Counts have all keys, by shard, and a change aggregates its own postings and writes the shards that
    it touches; held says in which generation's tables a shard lies. Old tables stay as they are, so a change that fails leaves
    the store as it was. Filters have the keys that enough documents hold.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 5, min_chars: int = 40):
        self.spark, self.min_docs, self.min_chars, self.generation, self.bits = ready(spark), min_docs, min_chars, 0, 0
        self.scratch = Scratch(spark, "lines")
        self.held: dict[int, int] = {}
        self.runs: list[tuple[int, DataFrame]] = []
        self.deleted: list[tuple[int, DataFrame]] = []

    @property
    def postings(self) -> DataFrame:
        """doc_id, r1, r2, a, b: which row, of those that are there now, holds which key."""
        out = None
        for made, run in self.runs:
            for when, ids in self.deleted:
                if when > made:
                    run = run.join(ids, run.doc_id.eqNullSafe(ids.doc_id), "left_anti")
            out = run if out is None else out.unionByName(run)
        return out

    @property
    def counts(self) -> DataFrame:
        """a, b, n, top: the keys that enough documents hold, the number of these and their largest doc_id."""
        return self._tables("counts").where(F.col("n") >= self.min_docs).select("a", "b", "n", "top")

    @property
    def filters(self) -> DataFrame:
        return self._tables("filters")

    def insert(self, docs: DataFrame) -> LineStore:
        g = self.generation + 1
        run = self.scratch.write(postings(docs, self.min_chars).sortWithinPartitions("b"), f"postings{g}")
        change = run.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
        self._schemas(run)
        self._became(g, change if not self.held else self.scratch.write(change, f"change{g}"))
        self.runs.append((g, run))
        return self

    def delete(self, doc_ids: DataFrame) -> LineStore:
        """Forgets all documents whose doc_id is in doc_ids; keys that become rare leave the filters. The largest doc_id is looked
        for anew for keys that have lost it, among the postings of these keys."""
        if not self.runs:
            return self
        g, now = self.generation + 1, self.postings
        ids = self.scratch.write(doc_ids.select("doc_id").distinct(), f"deleted{g}")
        gone = now.join(ids, now.doc_id.eqNullSafe(ids.doc_id), "left_semi").groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
        gone = self.scratch.write(gone, f"gone{g}")
        self.deleted.append((g, ids))
        try:
            left = maybe_in(self.postings, gone, "b").where("maybe").join(gone.select("a", "b"), ["a", "b"], "left_semi")
            tops = left.groupBy("a", "b").agg(F.max("doc_id").alias("top"))
            change = gone.drop("top").join(tops, ["a", "b"], "left").select("a", "b", (-F.col("n")).alias("n"), "top")
            self._became(g, self.scratch.write(change, f"change{g}"), anew=True)
        except BaseException:
            self.deleted.pop()
            raise
        return self

    def _schemas(self, run: DataFrame) -> None:
        kind = dict(run.dtypes)["doc_id"]
        self.schemas = {"counts": f"a long, b long, n long, was long, top {kind}, shard int", "filters": "filter binary, shard int"}

    def _tables(self, name: str, shards: set[int] | None = None) -> DataFrame:
        """The rows of these shards, or of all, each from the generation that it was written in last."""
        out = self.spark.createDataFrame([], self.schemas[name])
        for g in sorted(set(self.held.values())):
            own = [s for s, at in self.held.items() if at == g and (shards is None or s in shards)]
            if own:
                read = self.spark.read.schema(self.schemas[name]).parquet(f"{self.scratch.path}/{name}{g}")
                out = out.unionByName(read.where(F.col("shard").isin(own)))
        return out

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").partitionBy("shard").option("compression", "zstd").parquet(f"{self.scratch.path}/{name}")

    def _became(self, g: int, change: DataFrame, anew: bool = False) -> None:
        """Merges a change of counts (with anew, tops that stand for the old ones) into the shards that it touches."""
        keys = change.agg(F.approx_count_distinct("b")).first()[0] + (self._tables("counts").count() if self.held else 0)
        wanted = max(3, (keys // SHARD_KEYS).bit_length())
        grown = wanted > self.bits
        bits = wanted if grown else self.bits
        old, sieves = self._tables("counts").limit(0), self._tables("filters").limit(0)
        if grown or len(set(self.held.values())) >= GENERATIONS:
            touched = None  # all shards, each of which is then in one generation
            old = self._tables("counts")
        else:
            touched = {r.shard for r in change.select(_shard(bits)).distinct().collect()}
            old = self._tables("counts", touched)
        if not grown:
            sieves = self._tables("filters", touched)
        rows = change.select(_shard(bits), "a", "b", "n", F.lit(0).cast("long").alias("was"), "top", F.lit(True).alias("new"))
        rows = rows.unionByName(old.select(_shard(bits), "a", "b", "n", F.col("n").alias("was"), "top", F.lit(False).alias("new")))
        top = F.max(F.struct("new", "top"))["top"] if anew else F.max("top")
        merged = rows.repartition("shard").groupBy("shard", "a", "b").agg(F.sum("n").alias("n"), F.sum("was").alias("was"), top.alias("top"))
        self._write(merged.where("n > 0 or was > 0").sortWithinPartitions("shard", "b"), f"counts{g}")
        now = self.spark.read.schema(self.schemas["counts"]).parquet(f"{self.scratch.path}/counts{g}")
        is_in, was_in = F.col("n") >= self.min_docs, (F.col("was") >= self.min_docs) & F.lit(not grown)
        change = F.when(is_in & ~was_in, 1).when(was_in & ~is_in, -1).otherwise(0)
        often = now.where(is_in | was_in).select("shard", "a", "b", change.alias("change"))
        changed = often.groupBy("shard").cogroup(sieves.groupBy("shard")).applyInArrow(_change_filter, "shard int, filter binary")
        self._write(changed, f"filters{g}")
        live = {r.shard for r in now.select("shard").distinct().collect()}  # shards are few: each has SHARD_KEYS keys
        self.held = {**(self.held if touched is not None else {}), **dict.fromkeys(live, g)}
        self.bits, self.generation = bits, g

    def _waves(self) -> Iterator[list[int]]:
        """Neighbouring shards, as many as have FILTER_BYTES together."""
        wave, size = [], 0
        for r in self.filters.select("shard", F.octet_length("filter").alias("size")).orderBy("shard").collect():
            if wave and size + r["size"] > FILTER_BYTES:
                yield wave
                wave, size = [], 0
            wave.append(r.shard)
            size += r["size"]
        if wave:
            yield wave

    def dropped(self) -> DataFrame:
        """doc_id, r1, r2, a, b: the keys of which a document loses all lines: another document, of larger doc_id, holds them too.

        Filters go to all tasks in waves of FILTER_BYTES. A wave's shards are a range of b, by which the postings' files are
        sorted, so it reads their row groups of that range only.
        """
        pairs, names, step = self.postings, [], 64 - self.bits
        for i, wave in enumerate(self._waves()):
            raw = {r.shard: bytes(r["filter"]) for r in self._tables("filters", set(wave)).collect()}
            sent = self.spark.sparkContext.broadcast(raw)
            least, most = ((s - (1 << (self.bits - 1))) << step for s in (wave[0], wave[-1] + 1))
            own = pairs.where((F.col("b") >= least) & (F.col("b") <= most - 1))
            names.append(f"passing{self.generation}-{i}")
            self.scratch.write(own.mapInArrow(_passing(sent, self.bits), pairs.schema), names[-1])
            sent.unpersist()
        if not names:
            return pairs.limit(0)
        passing = self.spark.read.schema(pairs.schema).parquet(*[f"{self.scratch.path}/{n}" for n in names])
        probed = hot_join(passing, self.counts, ["a", "b"], "n")
        return probed.where(~F.col("doc_id").eqNullSafe(F.col("top"))).drop("top", "n")


def _ints(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64, copy=False)


def _change_filter(rows: pa.Table, held: pa.Table) -> pa.Table:
    shard = (rows if rows.num_rows else held)["shard"][0].as_py()
    change, a, b = _ints(rows["change"]), _ints(rows["a"]), _ints(rows["b"])
    old = CuckooFilter(data=held["filter"][0].as_py()) if held.num_rows else None
    if old is not None:
        old.delete(a[change < 0], b[change < 0])
    if old is None or not old.insert(a[change > 0], b[change > 0]):
        old = CuckooFilter.of(a[change >= 0], b[change >= 0])
    return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([old.dump()], pa.binary())})


def _passing(sent, bits: int):
    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings whose key may be in the exact table, by its shard's filter."""
        filters = {shard: CuckooFilter(data=raw) for shard, raw in sent.value.items()}
        for batch in batches:
            a, b = (batch[c].to_numpy().astype(np.int64, copy=False) for c in "ab")
            shard, some = (b >> (64 - bits)) + (1 << (bits - 1)), np.zeros(len(b), bool)
            order = np.argsort(shard, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if len(own) and int(shard[own[0]]) in filters:
                    some[own] = filters[int(shard[own[0]])].contains(a[own], b[own])
            yield batch.filter(pa.array(some))

    return trimmed(passing)


def _cut(min_chars: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = SPACE.encode()
        for batch in batches:
            texts, total, lost = [], [], []
            for text, gone in zip(batch["text"].to_pylist(), batch["gone"].to_pylist()):
                lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                total.append(len(lines))
                if gone:
                    gone = {(x["a"] % 2**64, x["b"] % 2**64) for x in gone}
                    lines = [x for x in lines if len(k := x.strip(space).lower()) < min_chars or _key_of(k) not in gone or len(k.decode()) < min_chars]
                    text = b"\n".join(lines).decode()
                texts.append(text)
                lost.append(total[-1] - len(lines))
            out = batch.drop_columns(["text", "gone"])
            yield out.append_column("text", pa.array(texts, pa.string())).append_column("n_lines", pa.array(total, pa.int64())).append_column("n_dropped", pa.array(lost, pa.int64()))

    return trimmed(cut)


def _with_gone(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Adds gone to rows. Rows that certainly lose no line stay where they are; of others, many equal ones are dealt to copies
    of what they look for."""
    marked = maybe_in(rows, gone.select("r1"), "r1")
    stay = marked.where(~F.col("maybe")).drop("maybe").withColumn("gone", F.lit(None).cast(gone.schema["gone"].dataType))
    limit = max(1, (gone.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    hot = gone.where(F.col("n") > limit).select("r1", "r2", F.expr(f"n div {limit} + 1").alias("copies"))  # fewer than HOT_KEYS
    found = gone.drop("n").join(F.broadcast(hot), ["r1", "r2"], "left")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long"))))).drop("copies")
    asked = marked.where("maybe").drop("maybe").join(F.broadcast(hot), ["r1", "r2"], "left")
    asked = asked.withColumn("copy", F.pmod(F.monotonically_increasing_id(), F.coalesce("copies", F.lit(1).cast("long"))) + 1).drop("copies")
    return stay.unionByName(asked.join(found, ["r1", "r2", "copy"], "left").drop("copy"))


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, *, keep_rows: bool = False) -> DataFrame:
    """doc_id, text (the lines that stay), n_lines, n_dropped: one row for each row of docs.

    Lines whose key has min_chars code points and is held by min_docs documents stay only in the one of largest doc_id.
    With keep_rows a struct column row has the input's other columns.

    Null text and empty text: one empty line. Very long texts: whole, one at a time. Rows of equal doc_id: each counts as a
    document, and all of the largest doc_id keep their lines. Null doc_id: smaller than any; rows are told apart by their
    texts, so many of them make no large group. No rows: no rows. Other columns are ignored.
    """
    store = LineStore(docs.sparkSession, min_docs, min_chars).insert(docs)
    gone = store.dropped().groupBy("r1", "r2").agg(F.collect_set(F.struct("a", "b")).alias("gone"), F.count("*").alias("n"))
    gone = store.scratch.write(gone.withColumn("n", F.expr("n div size(gone)")), "gone")  # n: equal rows
    rows = docs.select("doc_id", *_row_key(), text_of().alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")] if keep_rows else []))
    joined = _with_gone(rows, gone).drop("r1", "r2")
    schema = joined.drop("text", "gone").schema.add("text", "string").add("n_lines", "long").add("n_dropped", "long")
    return joined.mapInArrow(_cut(min_chars), schema)


def op8(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, line, translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM d)),
h AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT r) >= 5),
m AS (SELECT l.*, h.k IS NOT NULL AND l.doc_id IS DISTINCT FROM h.top AS gone FROM l LEFT JOIN h ON l.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
