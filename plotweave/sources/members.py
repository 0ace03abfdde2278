"""The members of large JSON objects, read by as many tasks as a file has splits.

A file is read in fragments that end with a closing brace, so Spark cuts it by bytes. Whether a fragment begins inside a string,
and how deep, depends on all text before it. So each split is first summed up for both cases, in a string or not: what it does to
the depth, and at which depths objects end. These sums, one row for each split, tell every split its true beginning; then all
know where members of the outermost object end, and the fragments of a member are put together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import ready

_QUOTE = re.compile(r'\\.|(")', re.S)


def outside(fragment: str) -> tuple[int, list[int]]:
    """(quotes modulo 2, [what the depth changes by if the fragment begins outside a string, if inside]) with the brace at its end."""
    ends = [m.start() for m in _QUOTE.finditer(fragment) if m[1]] if '"' in fragment else []
    change, at = [0, 0], 0
    for i, end in enumerate([*ends, len(fragment)]):
        part = fragment[at:end]
        change[i % 2] += part.count("{") + part.count("[") - part.count("}") - part.count("]")
        at = end + 1
    odd = len(ends) % 2
    change[odd] -= 1  # the closing brace that cut the fragment off is outside if the last part is
    return odd, change


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments in order -> for each split and beginning: end state, change of depth, how often a brace ended at which depth."""
    found: dict[tuple, list] = {}
    for batch in batches:
        for file, start, text in zip(*(batch[c].to_pylist() for c in ("file", "start", "value"))):
            sums = found.setdefault((file, start), [[s, 0, Counter()] for s in (0, 1)])
            odd, change = outside(text)
            for held in sums:
                held[1] += change[held[0]]
                held[0] ^= odd
                if not held[0]:  # ends outside a string, so with a real brace
                    held[2][held[1]] += 1
    rows = [(file, start, s, *held[:2], list(held[2]), list(held[2].values())) for (file, start), sums in found.items() for s, held in enumerate(sums)]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "start", "begins", "ends", "change", "depths", "times"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments with their split's true beginning -> fragments with the number of the member that they belong to."""
    at, inside, depth, member = None, 0, 0, 0
    for batch in batches:
        out = []
        for file, start, text, *begin in zip(*(batch[c].to_pylist() for c in ("file", "start", "value", "inside", "depth", "member"))):
            if (file, start) != at:
                at, (inside, depth, member) = (file, start), begin
            odd, change = outside(text)
            depth += change[inside]
            inside ^= odd
            out.append(member)
            member += not inside and depth == 1
        yield pa.RecordBatch.from_arrays([batch["file"], batch["row"], pa.array(out, pa.int64()), batch["value"]], ["file", "row", "member", "value"])


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """member: a JSON object with one member of a file's outermost object (and what stands before it that is no object itself),
    for each of them. Files may have several objects one after the other. Splits are as large as spark.sql.files.maxPartitionBytes
    says; a member, as an article, is one row."""
    ready(spark)
    read = spark.read.option("lineSep", "}").text(path)
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), "value")
    sums: dict[str, dict[int, dict]] = {}
    for r in rows.mapInArrow(_summed, "file string, start long, begins int, ends int, change long, depths array<long>, times array<long>").collect():  # two rows for each split
        sums.setdefault(r.file, {}).setdefault(r.start, {})[r.begins] = r
    begins = []
    for file, splits in sums.items():
        inside = depth = member = 0
        for start in sorted(splits):
            begins.append((file, start, inside, depth, member))
            own = splits[start][inside]
            member += sum(n for d, n in zip(own.depths, own.times) if depth + d == 1)
            inside, depth = own.ends, depth + own.change
    known = F.broadcast(spark.createDataFrame(begins, "file string, start long, inside int, depth long, member long"))
    pieces = rows.join(known, ["file", "start"]).select("file", "start", "row", "value", "inside", "depth", "member").mapInArrow(_numbered, "file string, row long, member long, value string")
    whole = pieces.groupBy("file", "member").agg(F.sort_array(F.collect_list(F.struct("row", "value"))).alias("p"))
    text = F.regexp_replace(F.array_join(F.transform("p", lambda x: x["value"]), "}"), r"^[\s,{}]+", "")
    return whole.where(F.length(text) > 0).select(F.concat(F.lit("{"), text, F.lit("}}")).alias("member"))
