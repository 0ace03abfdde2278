"""Packing documents into training sequences by best-fit decreasing.

A document's ids are first cut into full windows. What remains of all documents goes, longest first, each to the open
window with the least room that is enough, found by a segment tree over remaining capacity. Then the emptiest windows of
a shard are cut up to fill the others.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch, parts, ready, table, text_of, trimmed
from .token_counts import path_of

TOKENIZER, WINDOW, END_ID = "word_bpe_49k.json", 2048, 1
#: Remainders packed together, about: as many as fit in a worker's memory with their ids.
SHARD_ROWS = 3000
#: In order, at least so many shards that have as many rows each; more only where SHARD_ROWS asks for them.
ORDERED_SHARDS = 64
#: Room in a window that is left as padding instead of cutting another document, less one: none is left.
LEAST_GAP = 1
#: Shards of a partition, some 60 MB of ids.
SHARDS_EACH = 16
#: Words whose ids a worker remembers.
CACHED_WORDS = 250_000
#: Texts of only these characters have words that normalisation and white space keep apart.
PLAIN = regex.compile(r"[^\t\n\r\x20-\x7e¡-¬®-ÿŒœŠšŽžŸ]")


class _Words(dict):
    """Ids of the words between white space, as bytes of the id type."""

    def __init__(self, pieces: Callable[[str], list[int]], kind):
        self.pieces, self.kind = pieces, kind

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.pieces(word), self.kind).tobytes()
        if len(self) < CACHED_WORDS:
            self[word] = ids
        return ids


@functools.cache
def encoder(name: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids, as the tokenizer's own library gives them without added special tokens.

    For a byte-pair vocabulary with word ends and lower case, plain texts are encoded word by word: the merges run in a
    second library over the same vocabulary, the word's end written as a byte that UTF-8 never has.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    path = path_of(name)
    own = Tokenizer.from_file(path)
    kind = np.uint16 if own.get_vocab_size() < 1 << 16 else np.uint32
    slow = lambda text: np.array(own.encode(text, add_special_tokens=False).ids, kind)
    with open(path) as f:
        spec = json.load(f)
    model, steps = spec["model"], [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    split = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or steps != ["NFC", "Replace", "Lowercase"] or split.get("behavior") != "Removed" or not split.get("invert"):
        return slow
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    # The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    assert set(byte_of) == set(ByteLevel.alphabet())
    ranks = {bytes(byte_of[c] for c in word.removesuffix("</w>")) + b"\xff" * word.endswith("</w>"): i for word, i in model["vocab"].items() if len(word) > 1 or word in byte_of}
    ranks.setdefault(b"\xff", max(ranks.values()) + 1)
    core = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
    find = regex.compile(split["pattern"]["Regex"]).findall
    words = _Words(lambda word: [i for piece in find(word.lower()) for i in core.encode_single_piece(piece.encode() + b"\xff")], kind)
    special = [x.content for x in own.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        if PLAIN.search(text) or any(x in text for x in special):
            return slow(text)
        return np.frombuffer(b"".join(map(words.__getitem__, text.split())), kind)

    return encode


class Rooms:
    """Segment tree over the room 1..window of open windows; each leaf has the windows with just that room."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, room: int, which: int) -> None:
        self.open[room].append(which)
        self._add(room, 1)

    def _add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window with at least this room."""
        at = least + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def plan(lengths: list[int], window: int = WINDOW, least_gap: int = LEAST_GAP) -> list[tuple[int, int, int, int, int]]:
    """(piece, first, length, sequence, offset) for pieces of at most window ids, longest first; pieces may be cut. What is left
    in the last window goes to sequences whose sizes are powers of two."""
    rooms, held = Rooms(window), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if (found := rooms.take(n)) is None:
            found = window, len(held)
            held.append([])
        held[found[1]].append((i, 0, n))
        if found[0] > n:
            rooms.put(found[0] - n, found[1])
    held.sort(key=lambda pieces: -sum(n for *_, n in pieces))
    fill = [sum(n for *_, n in pieces) for pieces in held]
    last, at = len(held) - 1, 0
    while at < last:
        gap = window - fill[at]
        if gap < least_gap:
            at += 1
            continue
        i, first, n = held[last].pop()
        take = min(gap, n)
        if take < n:
            held[last].append((i, first, n - take))
        held[at].append((i, first + n - take, take))
        fill[at] += take
        fill[last] -= take
        if not held[last]:
            last -= 1
    out, sequence = [], 0
    for pieces in held[: last + 1]:
        room, offset = _unpadded(sum(n for *_, n in pieces), window, least_gap), 0
        for i, first, n in pieces:
            while n:
                take = min(n, room[0] - offset)
                out.append((i, first, take, sequence, offset))
                first, n, offset = first + take, n - take, offset + take
                if offset == room[0]:
                    sequence, offset = sequence + 1, 0
                    room.pop(0)
        sequence += offset > 0
    return out


def _unpadded(n: int, window: int, least_gap: int) -> list[int]:
    """Sizes of the sequences for a window's n ids: one, if it is as good as full, else powers of two, which aren't padded."""
    return [window] if window - n < least_gap else [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _cut(name: str, window: int, keys: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plotweave.llm.packing import encoder

        encode = encoder(name)
        for batch in batches:
            rows, starts, lengths, totals, pieces = [], [], [], [], []
            size = 0
            for k, text in enumerate(batch["text"]):
                ids = encode(text.as_py())
                ids = np.append(ids, ids.dtype.type(END_ID))
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    rows.append(k)
                    starts.append(start)
                    lengths.append(len(piece))
                    totals.append(len(ids))
                    pieces.append(piece.tobytes())
                    size += piece.nbytes
                if size > 8 << 20:
                    yield _pieces(batch, keys, rows, starts, lengths, totals, pieces)
                    rows, starts, lengths, totals, pieces, size = [], [], [], [], [], 0
            yield _pieces(batch, keys, rows, starts, lengths, totals, pieces)

    return trimmed(cut)


def _pieces(batch: pa.RecordBatch, keys: list[str], rows: list, starts: list, lengths: list, totals: list, pieces: list) -> pa.RecordBatch:
    own = batch.select(keys).take(pa.array(rows, pa.int64()))
    return pa.RecordBatch.from_arrays([*own.columns, pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(totals, pa.int64()), pa.array(pieces, pa.binary())], [*keys, "start", "length", "doc_tokens", "ids"])


def _pack(name: str, window: int, least_gap: int, ordered: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard. Full windows go on at once; the remainders of a shard are held until it ends.

        Ordered: a sequence's number within its shard begins with the rank of its document, or of its ids' mean document.
        """
        from plotweave.llm.packing import encoder

        width = encoder(name)("").dtype.itemsize
        shard, n_full, held, full, kind = None, 0, [], [], None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for row in zip(*(batch[c].to_pylist() for c in ("shard", "doc_id", "start", "length", "doc_tokens", "ids", *(["rank"] if ordered else [])))):
                if row[0] != shard:
                    yield from _placed(shard, held, window, least_gap, width, kind, ordered)
                    shard, n_full, held = row[0], 0, []
                if row[3] < window:
                    held.append(row[1:])
                    continue
                n_full += 1
                number = (row[6] << 21) + row[2] // window if ordered else (1 << 32) + n_full
                full.append((*row[1:6], (shard << 33) + number, 0))
                if len(full) == 1000:
                    yield _placed_batch(full, width, kind)
                    full = []
        yield from _placed(shard, held, window, least_gap, width, kind, ordered)
        if full:
            yield _placed_batch(full, width, kind)

    return trimmed(pack)


def _placed(shard, held: list, window: int, least_gap: int, width: int, kind, ordered: bool) -> Iterator[pa.RecordBatch]:
    rows, planned = [], plan([x[2] for x in held], window, least_gap)
    weights: dict[int, tuple[int, int]] = {}  # by sequence: ids, ranks summed over ids
    for i, _, n, sequence, _ in planned if ordered else []:
        a, b = weights.get(sequence, (0, 0))
        weights[sequence] = a + n, b + n * held[i][5]
    for i, first, n, sequence, offset in planned:
        doc_id, start, _, total, ids = held[i][:5]
        if ordered:
            sequence += (weights[sequence][1] // weights[sequence][0] << 21) + (1 << 20)
        rows.append((doc_id, start + first, n, total, ids[first * width : (first + n) * width], (shard << 33) + sequence, offset))
        if len(rows) == 1000:
            yield _placed_batch(rows, width, kind)
            rows = []
    if rows:
        yield _placed_batch(rows, width, kind)


def _placed_batch(rows: list, width: int, kind) -> pa.RecordBatch:
    long = pa.int64()
    ids = [np.frombuffer(x[4], np.uint16 if width == 2 else np.uint32).astype("<u4").tobytes() for x in rows]
    columns = [pa.array([x[i] for x in rows], t) for i, t in ((0, kind), (1, long), (2, long), (3, long))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary()), *(pa.array([x[i] for x in rows], long) for i in (5, 6))], ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"])


def _written(docs: DataFrame) -> DataFrame:
    """docs as Parquet files whose names and rows have its order."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        return docs
    return Scratch(docs.sparkSession, "packing").write(docs, "docs")


def _ranked(docs: DataFrame) -> tuple[DataFrame, int]:
    """shard, rank (within the shard), doc_id, text of written docs, dealt by contiguous ranges; and how many shards."""
    spark, file, row = docs.sparkSession, F.col("_metadata.file_path"), F.col("_metadata.row_index")
    counts = {r.file: r.n for r in docs.groupBy(file.alias("file")).agg(F.count("*").alias("n")).collect()}  # a row for each file
    n, starts = 0, []
    for name in sorted(counts):
        starts.append((name, n))
        n += counts[name]
    size = min(SHARD_ROWS, max(ORDERED_SHARDS, n // ORDERED_SHARDS))
    offsets = F.broadcast(spark.createDataFrame(starts, "file string, first long"))
    rows = docs.select(file.alias("file"), row.alias("at"), "doc_id", text_of().alias("text")).join(offsets, "file")
    at = F.col("first") + F.col("at")
    return rows.select(F.floor(at / size).alias("shard"), F.pmod(at, F.lit(size)).cast("int").alias("rank"), "doc_id", "text"), -(-n // size)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW, least_gap: int = LEAST_GAP, *, in_order: bool = False) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (little-endian 32-bit), sequence_id, offset: one row for each piece.

    Each document's ids, the end id included, lie in exactly one piece each; the pieces of a sequence follow each other
    without gaps and have window ids together at most. With least_gap 1 every sequence is full or has a power of two of ids,
    so that none is padded. Documents are dealt to shards by row, so neither long documents nor repeated rows or ids make a
    shard large; shards are packed apart. Of a very long text only what is beyond its full windows waits for its shard's end.

    in_order: the order of docs, in files that of file names and rows, is that of training. Shards are contiguous ranges of
    it, and sequence_id follows it: by shard, and within a shard by the mean place of a sequence's ids.

    Null text counts as empty: a piece of just the end id. Null doc_id stays null. No rows: no rows. Other columns are
    ignored.
    """
    spark = ready(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    if in_order:
        rows, shards = _ranked(_written(docs))
        keys, typed = ["shard", "rank", "doc_id"], f"shard long, rank int, doc_id {kind}"
    else:
        shards = -(-max(1, docs.select(F.lit(1)).count()) // SHARD_ROWS)
        rows = docs.select(F.pmod(F.monotonically_increasing_id(), F.lit(shards)).alias("shard"), "doc_id", text_of().alias("text"))
        keys, typed = ["shard", "doc_id"], f"shard long, doc_id {kind}"
    pieces = rows.mapInArrow(_cut(tokenizer, window, keys), f"{typed}, start long, length long, doc_tokens long, ids binary")
    each = max(parts(spark), -(-shards // SHARDS_EACH))
    dealt = pieces.repartitionById(each, F.pmod("shard", F.lit(each)).cast("int")).sortWithinPartitions(*keys, "start")
    return dealt.mapInArrow(_pack(tokenizer, window, least_gap, in_order), f"doc_id {kind}, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long")


def op6(spark, sf_dir: str) -> DataFrame:
    out = pack_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
