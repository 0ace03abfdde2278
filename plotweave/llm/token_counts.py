"""Token counts through a digest cache.

The cache is a Parquet table (content, tokenizer, n_tokens) of SHA-256 digests: of the normalised content and of the
tokenizer's file. Texts are joined to it; only distinct misses are encoded, and their counts are appended.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.utils import AnalysisException

from .scratch import Scratch, hot_join, maybe_in, ready, scratch_root, table, text_of, trimmed

TOKENIZER = "byte_bpe_50k.json"
#: Texts of only these characters are cut into words alike by both libraries; other texts go to the tokenizer's own.
PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-¬®-ſ]")


def path_of(name: str) -> str:
    """A tokenizer's file: name itself if it is a path, else the public file of that name."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def digest_of(name: str) -> bytes:
    with open(path_of(name), "rb") as f:
        return hashlib.sha256(name.rpartition(os.sep)[2].encode() + b"\0" + f.read()).digest()


@functools.cache
def counter(name: str):
    """A function from a text to its number of tokens, as the file's own library gives them.

    Beside a byte-level .json may lie a .tiktoken of the same vocabulary. It gives the same pieces several times faster,
    and is used for plain texts without special strings.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = path_of(name)
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, num_threads=1))
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    slow = lambda text: len(own.encode(text, add_special_tokens=False).ids)
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    special = [x.content for x in own.get_added_tokens_decoder().values()]

    def count(text: str) -> int:
        if PLAIN.search(text) or any(x in text for x in special):
            return slow(text)
        return len(fast.encode_ordinary(text))

    return count


def _encode(name: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plotweave.llm.token_counts import counter

        count = counter(name)
        for batch in batches:
            counts = pa.array([count(x.as_py()) for x in batch["text"]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["content"], counts], ["content", "n_tokens"])

    return trimmed(encode)


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, cache: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens: one row for each row of docs. cache: the table's path; without one, that of all runs in
    the shared folder. A key that several runs have appended is read once.

    Null text counts as empty, with no tokens. Very long texts: whole. Repeated texts are encoded once. Null doc_id stays
    null. No rows: no rows. Other columns are ignored.
    """
    spark = ready(docs.sparkSession)
    scratch = Scratch(spark, "tokens")
    cache, version = cache or f"{scratch_root(spark)}/token-counts", digest_of(tokenizer)
    schema = "content binary, tokenizer binary, n_tokens long"
    content = F.unhex(F.sha2(text_of(), 256)).alias("content")
    rows = scratch.write(docs.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), content), "rows")
    wanted = scratch.write(rows.groupBy("content").agg(F.count("*").alias("n")), "wanted")
    try:
        known = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == F.lit(version))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], schema)
    known = known.select("content", "n_tokens").join(wanted.select("content"), "content", "left_semi").groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    known = scratch.write(known, "known")
    missing = wanted.join(known, "content", "left_anti").select("content", F.xxhash64("content").alias("hash"))
    missing = scratch.write(missing, "missing")
    # Only texts that may be missing move, and copies of one text are one row before they do.
    texts = maybe_in(docs.select(content, text_of().alias("text")).withColumn("hash", F.xxhash64("content")), missing, "hash").where("maybe")
    misses = texts.groupBy("content").agg(F.first("text").alias("text")).join(missing.select("content"), "content", "left_semi")
    fresh = scratch.write(misses.mapInArrow(_encode(tokenizer), "content binary, n_tokens long"), "fresh")
    fresh.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = scratch.write(wanted.join(known.unionByName(fresh), "content"), "counts")
    scratch.drop("wanted", "known", "missing", "fresh")
    return hot_join(rows, counts, ["content"], "n").select("doc_id", "n_bytes", "n_tokens")


def op9(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 512)
