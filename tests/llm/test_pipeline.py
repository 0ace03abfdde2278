"""Stages of the pipeline on the smallest tables, each against its own input."""

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in cp.STAGES:
        out.append(f(spark, out[-1], SF).cache())
    return out


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "near_duplicates", "mixing", "packing"]


def test_quality_drops_rejected_only(steps, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = steps[1].join(labels, "doc_id").agg(F.avg("quality")).first()[0]
    before = steps[0].join(labels, "doc_id").agg(F.avg("quality")).first()[0]
    assert kept > before and steps[1].count() > 0.7 * steps[0].count()


def test_line_dedup_keeps_documents(steps):
    assert steps[2].count() == steps[1].count()
    changed = steps[2].join(steps[1].select("doc_id", F.col("text").alias("old")), "doc_id").where("text <> old")
    assert changed.where(F.char_length("text") != F.col("n_chars")).count() == 0


def test_near_duplicates_keep_one_of_each_group(steps):
    from plotweave.llm.near_dedup import near_dedup

    assert near_dedup(steps[3]).where("NOT kept").count() == 0
    groups = near_dedup(steps[2]).select("component_id").distinct().count()
    assert groups == steps[3].count()


def test_mixing_takes_documents_as_they_are(steps):
    assert steps[4].select("doc_id", "text").distinct().join(steps[3].select("doc_id", "text"), ["doc_id", "text"], "left_anti").count() == 0
    assert steps[4].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_packing_has_all_ids(steps):
    got = steps[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    copies = steps[4].groupBy("doc_id").count()
    assert got.join(copies, "doc_id").where(F.col("n") != F.col("t") * F.col("count")).count() == 0


def test_sequences_follow_the_curves(spark, tmp_path):
    """Three sources of the same size, written and read again: early and late sequences have their curves' weights there."""
    rows = [(i, f"{'abc'[i % 3]} " * 400 + f"{i}", "en", "abc"[i % 3], 800) for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    cp.mixing(spark, docs, SF).write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    for given in (mixed, cp.mixing(spark, docs, SF)):
        got = cp.packing(spark, given, SF).join(docs.select("doc_id", "source"), "doc_id").select("sequence_id", "offset", "source", "length").toPandas()
        assert got["length"].sum() == cp.packing(spark, given, SF).agg(F.sum("length")).first()[0]
        assert not got.duplicated(["sequence_id", "offset"]).any() and got.groupby("sequence_id")["length"].sum().max() <= 2048
        got = got.sort_values(["sequence_id", "offset"])
        at = (got["length"].cumsum() - got["length"] / 2) / got["length"].sum()
        share = lambda which: got[which].groupby("source")["length"].sum() / got["length"][which].sum()
        early, late, whole = share(at < 0.2), share(at > 0.8), share(at >= 0)
        assert early["b"] < 0.8 * whole["b"] < 0.8 * late["b"]
        assert late["c"] < 0.8 * whole["c"] < 0.8 * early["c"]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(None, None, None, None, None), (None, "x y z", "en", "s", 5), (3, "x y z", "en", None, 5), (3, "x y z", "en", None, 5), (3, "another text of this id", "de", "s", 23), (4, "", "en", "s", 0), (5, "word " * 3000, "en", "s", 15000), (6, "word " * 3000, "fr", "t", 15000), (7, "a line that many documents have, and that is long enough", "en", "t", 57)]


@pytest.fixture(scope="module")
def labels_only(tmp_path_factory, spark):
    """A folder with just the labels, for the stage that learns from them."""
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stages_without_rows(spark, labels_only, name, stage):
    docs = spark.createDataFrame([], DOCS)
    out = stage(spark, docs, labels_only)
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stages_with_nulls_repeats_and_clashing_columns(spark, labels_only, name, stage):
    docs = spark.createDataFrame(ROWS, DOCS)
    more = docs.select(*[F.lit(c).alias(c) for c in ("row", "n", "id", "size", "t1", "k", "maybe", "gone", "pass", "position", "key", "score", "a", "b", "shard", "component", "h")], "*")
    got, wide = (stage(spark, d, labels_only) for d in (docs, more))
    own = [c for c in got.columns if c not in ("sequence_id", "offset", "start", "length", "ids_crc32")]
    show = lambda df: sorted(map(str, df.select(*own).distinct().collect()))
    assert show(got) == show(wide) and got.count() > 0
    if name != "packing":
        assert wide.columns == more.columns


def test_line_dedup_stage_cuts_lines_and_counts_characters(spark, labels_only):
    line = "a line that many documents have, and that is long enough"
    docs = spark.createDataFrame([(i, f"own {i}\n{line}", "en", "s", 99) for i in range(6)], DOCS)
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.line_dedup(spark, docs, labels_only).collect()}
    assert got == {**{i: (f"own {i}", 5) for i in range(5)}, 5: (f"own 5\n{line}", 99)}


def test_near_duplicates_of_repeated_ids(spark, labels_only):
    """Of ids 3 and 7 with equal texts one goes, and so does no row of id 7 with another text."""
    docs = spark.createDataFrame([(3, "one text that is here twice", "en", "s", 1), (7, "one text that is here twice", "en", "s", 2), (7, "quite another text of the same id", "en", "s", 3)], DOCS)
    got = cp.near_duplicates(spark, docs, labels_only).collect()
    assert sorted((r.doc_id, r.n_chars) for r in got) == [(3, 1), (7, 3)]


def test_run_equals_the_stages(spark, steps):
    """run writes each stage and reads it again; its pieces are those of the stages."""
    got = cp.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    want = steps[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
