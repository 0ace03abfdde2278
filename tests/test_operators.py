"""Rules of single operators on fixtures whose results are known by hand."""

import json
import os
import math
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.functions import columns as fc
from plotweave.functions.register import register
from plotweave.operators import chains as ch
from plotweave.operators import clusters as cl
from plotweave.operators import documents as doc
from plotweave.operators import enrichment as en
from plotweave.operators import evaluation as ev
from plotweave.operators import models as mo
from plotweave.operators import plugs
from plotweave.operators import quality as qu
from plotweave.operators import sampling as sa
from plotweave.operators import terms as te
from plotweave.operators.svo import Sentence
from plotweave.sources import corpus as co
from plotweave.sources.tables import numbered, percentiles, ranked, staged
from plotweave.streaming.resume import enrich_available


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).first().x


def test_verbs(spark):
    assert one(spark, fc.strip_verb_sense("v"), v="set_up_-1") == "set_up"
    assert one(spark, fc.verb_stem("v"), v="set_up_-1") == "set"
    assert one(spark, fc.strip_negation("v"), v="!take") == "take"


def test_span_and_masking(spark):
    assert tuple(one(spark, fc.span_of("t", "s"), t="ab cab", s="ab")) == (0, 2)
    assert one(spark, fc.span_of("t", "s"), t="ab", s="x") is None
    assert one(spark, fc.masked(F.array(F.lit("a"), F.lit("b")), F.lit(1))) == "a [MASK]"


def test_salience(spark):
    assert one(spark, fc.salience(F.lit(1), F.lit(100))) == pytest.approx(6.0)
    assert one(spark, fc.salience(F.lit(10), F.lit(None).cast("long"))) == -1
    assert one(spark, fc.salience(F.lit(100), F.lit(10**6))) == pytest.approx(5 * 2)


def test_similarities(spark):
    assert one(spark, fc.jaccard_words("a", "b"), a="The cat sat", b="a CAT ran") == pytest.approx(1 / 3)
    assert one(spark, fc.jaccard_words("a", "b"), a="the", b="a") == 0
    ab, ba = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("a"))
    assert one(spark, fc.rank_overlap(ab, ba)) == pytest.approx(0.5)
    assert one(spark, fc.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)), zero=0.0)) == 0
    assert one(spark, fc.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT strip_verb_sense('go_2') a, jaccard_words('big cat', 'cat dog') b, cosine(array(1D, 0D), array(1D, 0D)) c, rbo(array('a', 'b'), array('a', 'c')) d, salience(1, 100) e").first()
    assert (row.a, round(row.b, 6), row.c, row.d, row.e) == ("go", 0.333333, 1.0, 0.75, 6.0)


def test_model_answers(spark):
    said = "<think>a\nb</think>x<think>c</think>y<think>a\nb</think>"
    assert one(spark, fc.thinking("s"), s=said) == "a\nb"
    assert one(spark, fc.answer("s"), s=said) == "x<think>c</think>y"
    schema, enums = "characters ARRAY<STRUCT<role:STRING>>, stance STRING", {"stance": ["Pro"], "characters[].role": ["Hero"]}
    ok = lambda s: one(spark, fc.valid_json("s", schema, enums), s=s)
    assert ok('{"characters": [{"role": "Hero"}], "stance": "Pro"}').stance == "Pro"
    for bad in ("{", '{"characters": [{"role": "King"}], "stance": "Pro"}', '{"stance": "Pro"}', '{"characters": [], "stance": "Con"}'):
        assert ok(bad) is None


def test_sentences(spark):
    rows = spark.createDataFrame([("d", 'He met Mr. Smith of the U.S. army. It cost 3. Then... he left! "Why?" she asked.')], "doc_id string, text string")
    got = [r.text for r in doc.split_sentences(rows).orderBy("line_no").collect()]
    assert got[0].startswith("He met Mr.") and "It cost 3. Then ...  he left!" in got
    assert not any(s.startswith("army") for s in got)


def test_numbered_is_dense(spark):
    got = numbered(spark.range(1000).withColumn("k", F.xxhash64("id")), "k", name="n").orderBy("k").collect()
    assert [r.n for r in got] == list(range(1000))


def test_excerpts(spark):
    b = lambda s1, s2, first, last: one(spark, doc.excerpt_bounds(F.lit(s1), F.lit(s2), F.lit(first), F.lit(last), 2))
    assert tuple(b(5, 6, 0, 20)) == (3, 8)
    assert tuple(b(0, 1, 0, 20)) == (0, 5)
    assert tuple(b(20, 19, 0, 20)) == (15, 20)
    assert tuple(b(1, 1, 0, 2)) == (0, 2)
    assert b(5, 8, 0, 20) is None


def test_touching_counts_as_overlap(spark):
    s = spark.sql("SELECT 'd' doc_id, 1 sent_id, named_struct('start', 10, 'end', 20) span")
    a = spark.createDataFrame([("d", 20, 25), ("d", 0, 10), ("d", 21, 30)], "doc_id string, start int, end int")
    assert doc.overlapping(s, a).count() == 2


def test_event_pairs_equal_all_pairs(spark):
    rows = [("d", i, (i * 7) % 13, f"v_{i}", "o") for i in range(40)] + [("e", 99, 1, "v_1", "o")]
    got = {(r.e1.event_id, r.e2.event_id) for r in doc.event_pairs(spark.createDataFrame(rows, "doc_id string, event_id int, sent_id long, verb_sense string, obj_head string")).collect()}
    order = sorted(rows[:40], key=lambda r: (r[2], r[1]))
    assert got == {(a[1], b[1]) for i, a in enumerate(order) for b in order[i + 1 :] if b[2] - a[2] <= 2}


def test_salient_terms(spark):
    t = spark.createDataFrame([("a", 5, 3.0), ("the", 9, 9.0), ("b", 2, 2.0), ("c", 5, 1.0)], "term string, local long, salience double")
    names = lambda ratio, least: {r.term for r in te.salient_terms(t, ratio, least, ["the"]).collect()}
    assert names(0.5, 1) == {"a", "b"} and names(0.5, 3) == {"a"} and names(0.1, 1) == set()


def test_disambiguation(spark):
    m = spark.createDataFrame([(1, "go", [1.0, 0.0], ["a", "b"]), (2, "go", None, ["a"]), (3, "zz", [1.0, 0.0], ["a"]), (4, "be", [1.0, 0.0], ["a"])], "mention_id int, lemma string, vector array<double>, ranking array<string>")
    s = spark.createDataFrame([("go", 0, [0.0, 1.0], ["a", "b"]), ("go", 1, [1.0, 0.0], ["a", "c"]), ("be", 5, None, ["x"])], "lemma string, sense_id int, vector array<double>, ranking array<string>")
    assert {r.mention_id: r.sense for r in te.disambiguate(m, s).collect()} == {1: 1, 2: -2, 3: -1, 4: 0}


def test_svd_keeps_inner_products(spark):
    r = np.random.default_rng(0)
    a = r.random((12, 5))
    rows = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(12) for j in range(5)], "item long, column int, value double")
    got = np.array([x.vector for x in te.reduced(rows, 5).orderBy("item").collect()])
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    want = u[:, :4] * s[:4]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-6)


def test_svd_spans_the_leading_space(spark, monkeypatch):
    """Fewer dimensions than items, several blocks, columns that one item has alone: the leading space and what is in it are numpy's."""
    from plotweave.operators import lowrank

    monkeypatch.setattr(lowrank, "BLOCK", 16)
    r = np.random.default_rng(2)
    a = (r.standard_normal((90, 8)) * 3.0 ** -np.arange(8)) @ r.standard_normal((8, 60)) * (r.random((90, 60)) < 0.5)
    a = np.concatenate([a, np.diag(r.random(90) * 0.01)], 1)
    a[17] = 0
    rows = [(1000 + int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    got = {x["item"]: x.vector for x in lowrank.truncated_svd(spark.createDataFrame(rows, "item long, column int, value double").repartition(5), 6).collect()}
    assert set(got) == {1000 + i for i in range(90) if i != 17}
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    x = np.array([got.get(1000 + i, [0.0] * 6) for i in range(90)])
    assert np.allclose(np.linalg.norm(x, axis=0), s[:6], rtol=1e-6)
    assert np.allclose(np.linalg.svd(u[:, :6].T @ (x / s[:6]))[1], 1, atol=1e-6)
    assert np.allclose(x @ x.T, (u[:, :6] * s[:6] ** 2) @ u[:, :6].T, atol=1e-5 * s[0] ** 2)
    assert lowrank.truncated_svd(spark.createDataFrame([], "item long, column int, value double")).count() == 0


def test_svd_in_single_precision_by_stripes_and_parts(spark, monkeypatch):
    """As for many items: panels of 32-bit numbers, dimensions by stripes, columns in several parts, values divided by their norm."""
    from plotweave.operators import lowrank

    for name, value in (("BLOCK", 16), ("PRECISE", 0), ("COLUMNS", 16)):
        monkeypatch.setattr(lowrank, name, value)
    r = np.random.default_rng(3)
    a = (r.standard_normal((90, 8)) * 1.5 ** -np.arange(8)) @ r.standard_normal((8, 60))
    a = np.concatenate([a, np.diag(r.random(90) * 0.01)], 1)
    rows = [(int(i), f"w{j}", float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    got = {x["item"]: x.vector for x in lowrank.truncated_svd(spark.createDataFrame(rows, "item long, column string, value double"), 6, unit=True).collect()}
    x, (u, s, _) = np.array([got[i] for i in range(90)]), np.linalg.svd(a / np.linalg.norm(a, axis=1, keepdims=True), full_matrices=False)
    assert np.allclose(np.linalg.norm(x, axis=0), s[:6], rtol=1e-4)
    assert np.allclose(x @ x.T, (u[:, :6] * s[:6] ** 2) @ u[:, :6].T, atol=1e-4)


def test_svd_writes_nothing_with_a_row_for_each_column(spark, monkeypatch):
    """Many columns, few items: no table has numbers for each column and dimension."""
    from pyspark.sql.readwriter import DataFrameWriter

    from plotweave.operators import lowrank

    sizes, write = [], DataFrameWriter.parquet

    def parquet(self, path, *args, **options):
        write(self, path, *args, **options)
        sizes.append(sum(f.stat().st_size for f in pathlib.Path(path.removeprefix("file://")).glob("*.parquet")))

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    rows = [(i, j, 1.0 + (i * j) % 7) for j in range(3000) for i in (j % 40, (j + 1 + j // 40 % 39) % 40)]
    assert lowrank.truncated_svd(spark.createDataFrame(rows, "item long, column int, value double"), 20).count() == 40
    assert max(sizes) < 300_000  # 3,000 columns by 30 dimensions are 720,000 bytes


def test_staged_tables_go(spark):
    import glob

    from plotweave.sources.tables import passing, shared_folder, staged, unstaged

    count = lambda: len(glob.glob(shared_folder(spark).removeprefix("file://") + "/staged-*"))
    before = count()
    with passing():
        staged(spark.range(3))
        kept = staged(spark.range(4))
        assert count() == before + 2 and kept.count() == 4
    assert count() == before
    t = staged(spark.range(3))
    unstaged(t, None, spark.range(2))
    assert count() == before


def characters(spark, rows):
    return spark.createDataFrame([(c, g, r, i) for i, (c, g, r) in enumerate(rows)], "chain_id long, grp string, role string, pos int")


def test_votes_and_merged_groups(spark):
    rows = [(1, "Workers", "Hero"), (1, "Refugees", "Victim"), (1, "Judiciary", "Threat"), (1, "Judiciary", "Hero"), (1, "Other", "Hero"), (1, "Government", "Neutral"), (2, "Government", "Neutral")]
    got = {r.chain_id: r for r in ch.group_roles(characters(spark, rows), spark.createDataFrame([(1, "Pro"), (2, "Neutral")], "chain_id long, stance string")).collect()}
    assert set(got) == {1}
    assert got[1].roles == {"Immigrants": "Victim", "Judiciary": "Hero", "Stance": "Pro"} and got[1].strength == 3


def test_closed_form_equals_pairs(spark):
    r = np.random.default_rng(3)
    rows = [(int(c), f"g{g}", ["Hero", "Victim", "Threat"][r.integers(3)]) for c in range(120) for g in range(3) if r.random() < 0.6]
    roles = ch.group_roles(characters(spark, rows))
    labels = spark.createDataFrame([(i, i % 4) for i in range(120)], "chain_id long, cluster int")
    edges = ch.cannot_links(roles)
    made = {x["cluster"]: x["count"] for x in ch.violated_pairs(labels, edges).groupBy("cluster").count().collect()}
    assert made == {x.cluster: x.violations for x in ch.violations(labels, roles).collect() if x.violations}


def test_trend():
    assert ch.violation_trend([5, 4, 3]) == "consistently decreasing"
    assert ch.violation_trend([3, 3, 3]) == "consistently increasing"
    assert ch.violation_trend([5, 6, 3]) == "decreasing" and ch.violation_trend([1, 5]) == "increasing"


@pytest.fixture(scope="module")
def blobs(spark):
    r = np.random.default_rng(1)
    rows = []
    for i in range(90):
        c = i % 3
        rows.append((i, c, (r.normal(0, 0.3, 2) + [[0, 0], [5, 0], [0, 5]][c]).tolist(), "k" if i % 2 else None, f"k={i % 4}"))
    return spark.createDataFrame(rows, "id long, cluster int, vector array<double>, keys string, signature string").cache()


def test_exact_mode_is_the_sequential_rule(spark, blobs):
    """One iteration against a loop over points in order that pays w for each earlier conflict."""
    fit = cl.weighted_pckmeans(blobs, 3, 2.0, max_iter=1, seed=5)
    centers = cl.constrained_seeds(blobs, 3, 2.0, 5).orderBy("cluster").collect()
    c = np.array([x.center for x in centers])
    points, chosen = blobs.orderBy("id").collect(), []
    for p in points:
        cost = ((np.array(p.vector) - c) ** 2).sum(1)
        for q, k in chosen:
            if p["keys"] and p["keys"] == q["keys"] and p.signature != q.signature:
                cost[k] += 2.0
        chosen.append((p, int(cost.argmin())))
    assert {r.id: r.cluster for r in fit.assignment.collect()} == {p.id: k for p, k in chosen}


def test_constrained_clustering_lowers_violations(spark, blobs):
    plain, strict = cl.weighted_pckmeans(blobs, 3, 0.0, max_iter=8), cl.weighted_pckmeans(blobs, 3, 50.0, max_iter=8)
    assert min(strict.violations) < plain.violations[-1]
    assert cl.weighted_pckmeans(blobs, 3, 0.5, max_iter=4, mode="blocks", blocks=4).assignment.count() == 90
    assert cl.pckmeans_repair(blobs, 3, max_iter=3).assignment.count() == 90
    assert cl.kmeans(blobs, 3, n_init=2)[0].groupBy("cluster").count().count() == 3


def test_quality_measures(spark, blobs):
    c = qu.centroids(blobs)
    x, y = np.array([r.vector for r in blobs.orderBy("id").collect()]), np.array([r.cluster for r in blobs.orderBy("id").collect()])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(90):
        a = d[i][y == y[i]].sum() / ((y == y[i]).sum() - 1)
        b = min(d[i][y == k].mean() for k in range(3) if k != y[i])
        want.append((b - a) / max(a, b))
    assert np.allclose([r.silhouette for r in qu.silhouette(blobs, block=16).orderBy("id").collect()], want)
    assert [r.silhouette for r in qu.silhouette(blobs.withColumn("cluster", F.lit(0))).collect()] == [0.0] * 90
    s = qu.separation(blobs, c).first()
    assert s.wcss + s.bcss == pytest.approx(((x - x.mean(0)) ** 2).sum())


def test_closest_share_keeps_one(spark, blobs):
    got = cl.closest_share(blobs.where("id < 4"), qu.centroids(blobs), 25)
    assert got.groupBy("cluster").count().agg(F.min("count"), F.max("count")).first()[:] == (1, 1)


def test_empty_cluster_is_least_dense(spark, blobs):
    c = qu.centroids(blobs).select("cluster", "center").unionByName(spark.createDataFrame([(9, [9.0, 9.0])], "cluster int, center array<double>"))
    assert cl.density_ranks(blobs, c).orderBy(F.col("density_rank").desc()).first().cluster == 9


def test_kappa_and_icc(spark):
    rows = [(0, 0)] * 20 + [(0, 1)] * 5 + [(1, 0)] * 10 + [(1, 1)] * 15
    df = spark.createDataFrame(rows, "a int, b int")
    k = qu.cohens_kappa(df, "a", "b", "textbook").first()
    assert k.kappa == pytest.approx(0.4) and k.ci_low < 0.4 < k.ci_high and k.se == pytest.approx(0.1261, abs=1e-3)
    same = qu.intraclass(spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "a int, b int"), "a", "b").first()
    assert same.icc2 == pytest.approx(1) and same.n == 5


def test_class_scores(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "t string, p string")
    s = qu.class_scores(df, "t", "p").first()
    assert (s.accuracy, round(s.macro_f1, 6)) == (0.5, round((0.5 + 2 / 3 + 0) / 3, 6))


def test_quotas(spark):
    rows = spark.createDataFrame([(i, 0 if i < 7 else 1 if i < 9 else 2) for i in range(10)], "doc_id int, bin int")
    assert {r.bin: r.quota for r in sa.bin_quotas(rows, 4).collect()} == {0: 3, 1: 1, 2: 0}
    takes = lambda *rows: {r.bin: r["take"] for r in sa.redistributed(spark.createDataFrame(rows, "bin int, size long, quota long")).collect()}
    assert takes((0, 10, 4), (1, 1, 4), (2, 5, 4)) == {0: 7, 1: 1, 2: 4}
    assert takes((0, 2, 5), (1, 1, 5)) == {0: 2, 1: 1}
    assert takes((0, 3, 3), (1, 4, 2)) == {0: 3, 1: 2}
    r = np.random.default_rng(4)
    for _ in range(5):
        sizes, quotas = r.integers(0, 30, 8), r.integers(0, 20, 8)
        got = takes(*[(i, int(a), int(b)) for i, (a, b) in enumerate(zip(sizes, quotas))])
        assert sum(got.values()) == min(sizes.sum(), quotas.sum()) and all(got[i] <= n and got[i] >= min(n, q) for i, (n, q) in enumerate(zip(sizes, quotas)))


def test_temporal_bins_clamp_the_last(spark):
    df = spark.sql("SELECT id doc_id, timestamp_seconds(id * 10) ts FROM range(11)")
    assert [r.bin for r in sa.temporal_bins(df, 5).orderBy("doc_id").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 4]
    assert sa.temporal_bins(df.where("doc_id = 3"), 5).first().bin == 0
    with pytest.raises(ValueError):
        sa.eligible_docs(spark.createDataFrame([(1, 2)], "doc_id int, n_events int"), 3, 1)


def test_stratified_sample(spark):
    df = spark.createDataFrame([(i, "a" if i < 60 else "b" if i < 90 else "c" if i < 97 else "Other primary") for i in range(100)], "doc_id int, f string")
    got = {r.f: r["count"] for r in sa.stratified_sample(df, "f", 40).groupBy("f").count().collect()}
    assert got == {"a": 20, "b": 13, "c": 7}


def test_diverse_sample_takes_each_document_first(spark):
    df = spark.createDataFrame([(i, i // 10) for i in range(40)], "chain_id int, doc_id int")
    assert sa.diverse_sample(df, 4).select("doc_id").distinct().count() == 4
    assert sa.diverse_sample(df, 7).count() == 7 and sa.diverse_sample(df, 99).count() == 40


def tokens(spec):
    return [{"i": i, "text": t, "lemma": l, "pos": p, "dep": d, "head": h} for i, (t, l, p, d, h) in enumerate(spec)]


def triples(spec):
    return [((x["subj"] or {}).get("text"), x["verb"]["lemma"], (x["obj"] or {}).get("text")) for x in Sentence(tokens(spec)).triples()]


def test_svo_forms():
    assert triples([("She", "she", "PRON", "nsubj", 1), ("ate", "eat", "VERB", "ROOT", 1), ("soup", "soup", "NOUN", "dobj", 1)]) == [("She", "eat", "soup")]
    assert triples([("She", "she", "PRON", "nsubj", 2), ("never", "never", "ADV", "neg", 2), ("ate", "eat", "VERB", "ROOT", 2), ("soup", "soup", "NOUN", "dobj", 2)]) == [("She", "!eat", "soup")]
    passive = [("Soup", "soup", "NOUN", "nsubjpass", 2), ("was", "be", "AUX", "auxpass", 2), ("eaten", "eat", "VERB", "ROOT", 2), ("by", "by", "ADP", "agent", 2), ("her", "she", "PRON", "pobj", 3)]
    assert triples(passive) == [("her", "eat", "Soup")]
    both = [("He", "he", "PRON", "nsubj", 1), ("beat", "beat", "VERB", "ROOT", 1), ("and", "and", "CCONJ", "cc", 1), ("hurt", "hurt", "VERB", "conj", 1), ("me", "I", "PRON", "dobj", 3)]
    assert triples(both)[:2] == [("He", "beat", "me"), ("He", "hurt", "me")]
    assert triples([("He", "he", "PRON", "nsubj", 1), ("slept", "sleep", "VERB", "ROOT", 1)]) == [("He", "sleep", None)]
    xcomp = [("He", "he", "PRON", "nsubj", 1), ("wants", "want", "VERB", "ROOT", 1), ("to", "to", "PART", "aux", 3), ("eat", "eat", "VERB", "xcomp", 1), ("soup", "soup", "NOUN", "dobj", 3)]
    assert triples(xcomp)[0] == ("He", "eat", "soup")
    assert triples([]) == []


def test_parsing_by_plug(spark):
    got = plugs.parse_sentences(spark.createDataFrame([(1, "dogs chased the cat"), (2, None)], "sent_id long, text string")).collect()
    assert [t.text for t in got[0].tokens] == ["dogs", "chased", "the", "cat"] and got[1].tokens == []
    v = plugs.embed(spark.createDataFrame([(1, "a b"), (2, None)], "k long, t string"), "k", "t").collect()
    assert len(v[0].vector) == 64 and v[1].vector is None
    assert plugs.windows(1200, 510) == [(0, 510), (255, 765), (510, 1020), (765, 1200)]


class Flaky:
    def __init__(self):
        self.n = 0

    def chat(self, system, user, schema=None):
        if schema is None:
            return "<think>hm</think>" + user
        self.n += 1
        if "never" in user:
            raise RuntimeError
        return "{" if self.n % 2 else json.dumps({"prediction": "causal"})


def test_two_calls_with_retries(spark):
    rows = spark.createDataFrame([(1, "good"), (2, "never"), (3, None)], "id long, p string").coalesce(1)
    got = {r.id: (r.reason, r.answer) for r in en.ask(rows, "id", "p", en.CAUSAL, Flaky, Flaky).collect()}
    assert got == {1: ("hm", '{"prediction": "causal"}'), 2: ("hm", None), 3: (None, None)}


class Counting:
    """Notes each call in a folder; ends its process the first time that it is asked about the row to die on."""

    def __init__(self, folder, die=None):
        self.folder, self.die = folder, die

    def chat(self, system, user, schema=None):
        import time
        import uuid as ids
        from pathlib import Path

        if schema is None:
            if self.die and user == self.die and not Path(self.folder, "died").exists():
                time.sleep(2)
                Path(self.folder, "died").touch()
                os._exit(1)
            Path(self.folder, f"{user}-{ids.uuid4().hex}").touch()
        return json.dumps({"prediction": "causal"})


def test_answers_are_kept(spark, tmp_path):
    """Two actions ask once; a task that died with its worker asks for what is missing; other prompts are asked anew."""
    calls = lambda d: sorted(p.name.split("-")[0] for p in (tmp_path / d).iterdir() if p.name != "died")
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "id long, p string").coalesce(1)
    for d, die in (("a", None), ("b", "p39")):
        (tmp_path / d).mkdir()
        folder = str(tmp_path / d)
        ask = lambda: en.ask(rows, "id", "p", en.CAUSAL, lambda: Counting(folder, die), lambda: Counting(folder), concurrency=2, log=f"{tmp_path}/log-{d}")  # noqa: B023
        if die:
            with pytest.raises(Exception, match="worker|Worker|crash|EOF"):
                ask().collect()
            assert (tmp_path / d / "died").exists()
            before = len(calls(d))
            assert before > 8
        got = ask()
        assert sum(r.answer is not None for r in got.collect()) == 40
        assert got.where("answer IS NULL").count() == 0 and got.count() == 40
        assert set(calls(d)) == {f"p{i}" for i in range(40)} and len(calls(d)) <= 40 + (8 * 4 if die else 0)
    more = rows.withColumn("p", F.concat("p", F.lit("!")))
    assert en.ask(more, "id", "p", en.CAUSAL, lambda: Counting(str(tmp_path / "a")), lambda: Counting(str(tmp_path / "a")), log=f"{tmp_path}/log-a").count() == 40
    assert len(calls("a")) == 80
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_resume_works_on_what_is_missing(spark, tmp_path):
    rows, seen = spark.range(10).withColumnRenamed("id", "k"), []
    work = lambda df: (seen.append(df.count()), df.withColumn("v", F.col("k") * 2))[1]
    path = f"{tmp_path}/out"
    en.resume(spark, rows.where("k < 4"), "k", path, work)
    assert en.resume(spark, rows, "k", path, work, batches=2).count() == 10 and seen[0] == 4 and sum(seen) == 10


def test_stream_appends_new_files_only(spark, tmp_path):
    src, sink, cp = (f"{tmp_path}/{x}" for x in ("src", "sink", "cp"))
    work = lambda df: df.withColumn("y", F.col("id") + 1)
    for a, b in ((0, 5), (5, 9)):
        spark.range(a, b).write.mode("append").parquet(src)
        enrich_available(spark, src, "id long", work, sink, cp)
    assert sorted(r.y for r in spark.read.parquet(sink).collect()) == list(range(1, 10))


def test_edge_store(spark, tmp_path):
    store = co.EdgeStore(spark, f"{tmp_path}/edges")
    store.add(spark.createDataFrame([(2, 1), (1, 3), (4, 4)], "i long, j long"))
    store.add(spark.createDataFrame([(1, 2)], "i long, j long"))
    assert sorted(map(tuple, store.edges().collect())) == [(1, 2), (1, 3)]
    assert store.contains(spark.createDataFrame([(3, 1), (2, 3)], "i long, j long")).count() == 1
    assert {r.node: r.neighbours for r in store.adjacency().collect()} == {1: [2, 3], 2: [1], 3: [1]}


def test_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"a-1": {"text": "T", "primary_frame": 1.2, "annotations": {"framing": {"x": [{"start": 0, "end": 3, "code": 1.0}]}}}, "a-2": {"text": "U", "primary_frame": None}}))
    got = {r.doc_id: r for r in co.read_json_corpus(spark, str(tmp_path / "c.json")).collect()}
    assert got["a-1"].primary_frame == "1.2" and got["a-1"].annotations[0].annotator == "x" and got["a-2"].primary_frame is None
    (tmp_path / "l.txt").write_text("one\n\n two \n")
    assert [tuple(r) for r in co.read_lines(spark, str(tmp_path / "l.txt")).orderBy("sent_id").collect()] == [(0, "one"), (1, "two")]
    (tmp_path / "r.tsv").write_text("1\t2\n3\t4\n")
    assert [tuple(r) for r in co.read_ratings(spark, str(tmp_path / "r.tsv"), "INT").orderBy("row").collect()] == [(0, 1, 2), (1, 3, 4)]
    conf = co.Config.from_json('{"news": {"w_cl": 0.1}, "guns": {"inherits": "news", "n_clusters": 200}}')
    assert conf["guns"].w_cl == 0.1 and conf["guns"].n_clusters == 200


def test_intrusion_material(spark, blobs):
    p = blobs.withColumn("doc_id", F.col("id") % 7).withColumn("text", F.concat(F.lit("alpha beta w"), F.col("id").cast("string")))
    c = qu.centroids(p)
    ex = ev.intrusion_examples(p, c, 9).collect()
    assert len(ex) == 9 and all(len(set(r.ids)) == 3 and 0 <= r.answer <= 2 for r in ex)
    where = {r.id: r.cluster for r in p.collect()}
    assert all(where[r.ids[int(r.answer)]] == r.source_cluster != r.cluster for r in ex)
    assert all(where[i] == r.cluster for r in ex for k, i in enumerate(r.ids) if k != r.answer)
    sheet = spark.createDataFrame([(r.example_no, int(r.answer), r.difficulty, "m") for r in ex], "example_no int, answer int, difficulty string, method string")
    told = spark.createDataFrame([(r.example_no, int(r.answer)) for r in ex], "example_no int, predicted int")
    assert {r.accuracy for r in ev.intrusion_scores(sheet, told).collect()} == {1.0}
    assert sorted(ev.drawn_clusters([1, 2, 3], 30).count(x) for x in (1, 2, 3))[0] > 5


def test_frame_dataset(spark):
    chains = spark.createDataFrame([(0, "d", 1, {"Immigrants": "Hero", "Stance": "Pro"}, 2), (1, "d", 1, {"Judiciary": "Threat"}, 1), (2, "e", 0, {"Immigrants": "Hero"}, 1)], "chain_id long, doc_id string, cluster int, roles map<string,string>, strength int")
    got = {r.doc_id: r for r in mo.frame_dataset(chains, spark.createDataFrame([("d", "T", "x"), ("e", "U", None)], "doc_id string, text string, primary_frame string"), 3, "immigration").collect()}
    assert set(got) == {"d"} and got["d"].cluster_feats_frequency == [0, 2, 0] and got["d"].stance_feats == [1, 0] and sum(got["d"].role_feats) == 2
    assert len(mo.role_names("immigration")) == 18 and len(mo.role_names("guncontrol")) == 21


def test_scaler_and_models(spark):
    r = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, (r.normal(0, 1, 3) + [3 * (i % 2), 0, 0]).tolist(), "ab"[i % 2]) for i in range(120)], "doc_id long, x array<double>, y string")
    sc = mo.fit_scaler(rows, "x")
    x = np.array([q.z for q in sc.apply(rows, "x", "z").collect()])
    assert np.allclose(x.mean(0), 0) and np.allclose(x.std(0), 1)
    fit = mo.fit_frames(rows, "y", "x")
    assert qu.class_scores(fit.predict(rows), "y", "predicted").first().accuracy > 0.85
    assert mo.permutation_importance(fit, rows, "y", ["a", "b", "c"])[0][0] == "a"
    assert mo.screened(rows, "y", "x", 1) == [0]
    net = mo.fit_frames(rows, "y", "x", "network", layers=(8,))
    assert mo.agreements(fit.predict(rows), net.predict(rows)).count() > 90


def test_cross_validation_and_importances(spark):
    r = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, (r.normal(0, 1, 2) + [4 * (i % 2), 0]).tolist(), "ab"[i % 2]) for i in range(60)], "doc_id long, x array<double>, y string")
    got = mo.cross_validate(rows, "y", "x", k=3, repeats=2).collect()
    assert sorted((g.repeat, g.fold) for g in got) == [(i, j) for i in range(2) for j in range(3)]
    assert min(g.accuracy for g in got) > 0.8 and all(0 <= g.macro_f1 <= 1 and 0 <= g.weighted_f1 <= 1 for g in got)
    told = mo.importances(mo.fit_frames(rows, "y", "x", "forest", trees=5, depth=3), ["a", "b"])
    assert [n for n, _ in told] == ["a", "b"] and abs(sum(v for _, v in told) - 1) < 1e-9


def test_positives_like_a_loop_over_followers(spark):
    """Pools of more than two blocks, so that pairs cross their borders, with one document that has most of the points."""
    r, words = np.random.default_rng(2), [f"word{i}" for i in range(12)]
    made = [(i, int(i % 40 == 0), f"d{0 if i % 3 else i % 7}", " ".join(r.choice(words, 4)), r.normal(0, 1, 2).tolist()) for i in range(170)]
    p = spark.createDataFrame(made, "id long, cluster int, doc_id string, text string, vector array<double>")
    centers = qu.centroids(p)
    pool = cl.closest_share(p, centers, 100.0).withColumn("w", fc.content_words("text"))
    held = pool.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(sa.drawn("id", 0))]).collect()
    expected = {}
    for cluster in (0, 1):
        own = sorted((q for q in held if q.cluster == cluster), key=lambda q: tuple(q[c] for c in q.__fields__ if c.startswith("_o")))
        best = []
        for i, x in enumerate(own):
            for y in own[i + 1 : i + 51]:
                a, b = set(x.w), set(y.w)
                alike = len(a & b) / len(a | b) if a | b else 0.0
                level = 2 if x.doc_id == y.doc_id else 0 if alike < 0.6 else 1
                best.append((level, max(x.rank, y.rank), min(x.rank, y.rank), min(x.id, y.id), max(x.id, y.id)))
        expected[cluster] = min(best)[3:]
    assert {q.cluster: (q.a, q.b) for q in ev.positives(p, centers, percent=100.0).collect()} == expected


def test_early_stopper():
    s = mo.EarlyStopper(2, 0.1)
    assert [s.stop(x) for x in (1.0, 1.05, 1.2, 1.2)] == [False, False, False, True]


def test_soft_assignment(spark, blobs):
    soft = cl.soft_assignment(blobs, qu.centroids(blobs))
    t = cl.target_distribution(soft)
    assert all(math.isclose(sum(r.q), 1) and math.isclose(sum(r.p), 1) for r in t.collect())
    edges = spark.createDataFrame([(0, 1), (0, 3)], "i long, j long")
    got = cl.pair_loss(soft, edges).first()
    assert got.satisfied == 0.5 and got.loss > 0


def test_entry_without_the_training_data_part(tmp_path):
    """A copy of the repository without its folders and the pipeline still gives the other queries."""
    import os
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(top, tmp_path / "copy", ignore=lambda folder, names: [n for n in names if n in (".git", "llm", "__pycache__", "corpus_pipeline.py")])
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'centroid_topk' in q and set(o) <= set(q) and not [n for n in q if n[:2] == 'op' and n[2].isdigit() or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_mention_features(spark):
    from plotweave.operators import features as fe

    sentences = spark.createDataFrame([(1, ["dogs", "chased", "the", "cat"])], "sent_id long, tokens array<string>")
    svos = spark.sql("SELECT 1L sent_id, 0 svo_id, named_struct('text', 'dogs', 'idx', array(0)) subj, named_struct('lemma', '!chase', 'idx', 1, 'negated', true) verb, named_struct('text', 'the cat', 'idx', array(2, 3)) obj, 'cat' obj_head, 3 obj_head_index")
    verbs, none = spark.createDataFrame([("chase",)], "term string"), spark.createDataFrame([], "term string")
    got = fe.mention_features(svos, sentences, verbs, none).first()
    assert got.verb == "chase" and not got.all_salient and len(got.verb_vec) == 64
    assert [x.tok for x in got.obj_exp] == ["chased", "dogs", "the"]
    assert fe.mention_features(svos, sentences, none, none).count() == 0
    parts = {r.part: [x.tok for x in r.expansion] for r in fe.phrase_features(svos, sentences).collect()}
    assert parts == {"subj": ["cat", "chased", "the"], "verb": ["cat", "dogs", "the"], "obj": ["chased", "dogs"]}


def test_refining_an_encoder(spark):
    from plotweave.operators import features as fe

    rows = [(i, f"word{i % 2} extra{i % 5}", "g", f"g={i % 2}") for i in range(40)]
    chains = spark.createDataFrame(rows, "id long, text string, keys string, signature string")
    seen = []
    got = fe.refine(chains, 2, 0.5, lambda make, pairs: (seen.append(pairs.columns), make)[1], rounds=2, max_iter=3)
    assert len(got.history) == len(seen) == 2 and got.purity == max(p for p, _ in got.history)
    assert got.fit.assignment.count() == 40


def test_classifier_plug(spark):
    from plotweave.operators import features as fe

    rows = spark.createDataFrame([(1, "aa"), (2, None)], "k long, t string")
    got = fe.classify(rows, "k", "t", lambda: lambda ts: [[float(len(t) > 0), float(not t)] for t in ts], ["full", "empty"]).collect()
    assert [(r.k, r.predicted) for r in got] == [(1, "full"), (2, "empty")]


def conflicts(points, at, apart=np.inf):
    """Pairs of a cluster that exclude each other, in a loop."""
    return sum(at[i] == at[j] and a.keys == b.keys and a.signature != b.signature and np.linalg.norm(np.array(a.vector) - b.vector) <= apart for j, b in enumerate(points) for i, a in enumerate(points[:j]))


@pytest.fixture(scope="module")
def bound(spark):
    """Points of two blobs with keys and signatures, some without keys."""
    r = np.random.default_rng(8)
    rows = [(i, (r.normal(0, 1, 3) + 3 * (i % 2)).tolist(), None if i % 11 == 0 else f"k{i % 4}", f"s{i % 3}") for i in range(80)]
    return staged(spark.createDataFrame(rows, "id long, vector array<double>, keys string, signature string"))


@pytest.mark.parametrize("chunk,w", [(7, 0.5), (5, 4.0), (9, 0.01), (1000, 2.0)])
def test_large_sets_of_keys_in_chunks(spark, monkeypatch, chunk, w):
    """Chunks that begin from guessed counts end with what one pass over all ids gives; one set of keys holds most points."""
    from plotweave.operators import assign

    monkeypatch.setattr(assign, "CHUNK", chunk)
    r = np.random.default_rng(int(w * 100) + chunk)
    rows = [(i, r.normal(0, 1, 3).tolist(), None if i % 13 == 0 else "hot" if i % 3 else f"k{i % 2}", f"s{int(r.integers(4))}") for i in range(120)]
    points = spark.createDataFrame(rows, "id long, vector array<double>, keys string, signature string").repartition(3)
    centers = spark.createDataFrame([(i, rows[i][1]) for i in range(5)], "cluster int, center array<double>")
    got = cl.weighted_pckmeans(points, 5, w, centers=centers, max_iter=1)
    table, counts, at = np.array([x[1] for x in rows[:5]]), {}, []
    for _, v, keys, sign in rows:
        cost = ((np.array(v) - table) ** 2).sum(1)
        if keys is not None:
            cost = cost + w * (counts.setdefault(keys, np.zeros(5)) - counts.setdefault((keys, sign), np.zeros(5)))
        at.append(int(np.argmin(cost)))
        if keys is not None:
            counts[keys][at[-1]] += 1
            counts[keys, sign][at[-1]] += 1
    assert [x.cluster for x in got.assignment.orderBy("id").collect()] == at


def test_first_places_of_sentences(spark):
    import random

    from plotweave.operators.spans import first_places

    r = random.Random(4)
    for n, letters in ((0, "a"), (1, "ab"), (40, "ab"), (300, "abc d\u00e9\U0001f389"), (2000, "a"), (3000, "ab")):
        text = "".join(r.choice(letters) for _ in range(n))
        wanted = ["", None, "x", text, text + "a", *(text[(a := r.randrange(n + 1)) : a + r.choice([1, 2, 3, 7, 8, 9, 31, 64, 200])] for _ in range(80)), *("".join(r.choice(letters) for _ in range(k)) for k in (1, 2, 3, 5))]
        assert first_places(text, wanted) == [None if w is None or text.find(w) < 0 else text.find(w) for w in wanted]
    s = spark.createDataFrame([(1, 0, "b c"), (1, 1, "zz"), (1, 2, None), (1, 3, "b c"), (2, 0, "a"), (3, 0, "a")], "doc_id long, sent_id long, text string")
    a = spark.createDataFrame([(1, "a b c b c"), (2, None)], "doc_id long, text string")
    got = {(x.doc_id, x.sent_id): x.span and tuple(x.span) for x in doc.with_spans(s, a).collect()}
    assert got == {(1, 0): (2, 5), (1, 1): None, (1, 2): None, (1, 3): (2, 5), (2, 0): None}


def test_a_document_of_many_sentences(spark):
    """100,000 sentences in one document: spans in one pass, annotations meet only the sentences near them."""
    n = 100_000
    texts = [f"sentence {i} of {i % 7}." for i in range(n)]
    s = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, sent_id long, text string")
    spans = staged(doc.with_spans(s, spark.createDataFrame([(1, " ".join(texts))], "doc_id long, text string")))
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    assert spans.where("span IS NULL").count() == 0
    assert spans.agg(F.sum("span.start")).first()[0] == int(starts[:-1].sum())
    marks = [(1, int(starts[i]) + 3, int(starts[i + 2]) - 1, i) for i in range(0, n - 2, 50)] + [(1, 500, 400, -1), (1, None, 7, -2), (1, 0, int(starts[-1]), -3), (2, 0, 9, -4)]
    got = doc.overlapping(spans, spark.createDataFrame(marks, "doc_id long, start int, end int, k int"))
    by = {x.k: x["count"] for x in got.groupBy("k").count().collect()}
    inside = sum(1 for a, t in zip(starts, texts) if 500 <= a + len(t) and 400 >= a)
    want = {i: sum(1 for j in range(max(0, i - 2), min(n, i + 5)) if b <= starts[j] + len(texts[j]) and e >= starts[j]) for _, b, e, i in marks[:-4]}
    assert by == want | {-3: n} | ({-1: inside} if inside else {})


def test_phrases_and_events_meet_on_the_rarer_lemma(spark):
    import random

    r = random.Random(2)
    phrases = [(r.randrange(3), i, [r.choice("abcdefg") for _ in range(r.randrange(5))]) for i in range(60)] + [(0, 99, None)]
    events = [(r.randrange(3), j, r.choice("abcdefg") + "_1", r.choice("abcdefgh")) for j in range(60)] + [(0, 77, None, "a")]
    got = doc.phrase_events(spark.createDataFrame(phrases, "doc_id long, phrase int, lemmas array<string>"), spark.createDataFrame(events, "doc_id long, event int, verb_sense string, obj_head string"))
    want = sorted((p, e) for d, p, ls in phrases for d2, e, v, o in events if d == d2 and ls and v and v[0] in ls and o in ls)
    assert sorted((x.phrase, x.event) for x in got.collect()) == want and want


def test_a_store_of_runs(spark, tmp_path, monkeypatch):
    """Versions, lookups that read the asked buckets, merged runs, and changes that fail."""
    from plotweave.sources import runs

    store = runs.Runs(spark, f"{tmp_path}/s", 8)
    assert store.pairs().count() == 0 and store.lookup(spark.range(3).withColumnRenamed("id", "k")).count() == 0
    want = set()
    for n in range(4):
        new = [(k, v) for k in range(n, 60, 3) for v in (k % 7, n)]
        store.add(spark.createDataFrame(new, "k long, v long"))
        want |= set(new)
    assert {tuple(r) for r in store.pairs().collect()} == want and store.pairs().count() == len(want)
    asked = spark.createDataFrame([(5,), (999,), (None,)], "k long")
    found = store.lookup(asked)
    assert {tuple(r) for r in found.collect()} == {p for p in want if p[0] == 5}
    assert len({f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}) <= 2 and "Exchange hashpartitioning(k" not in found._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    store.replace(spark.createDataFrame([(5,), (6,)], "k long"), spark.createDataFrame([(5, 100)], "k long, v long"))
    want = {p for p in want if p[0] not in (5, 6)} | {(5, 100)}
    assert {tuple(r) for r in store.pairs().collect()} == want
    held = store.version()
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("no")))
        for change in (lambda: store.add(spark.createDataFrame([(1, 1)], "k long, v long")), lambda: store.replace(spark.createDataFrame([(1,)], "k long"), spark.createDataFrame([], "k long, v long"))):
            with pytest.raises(OSError):
                change()
    assert store.version() == held and {tuple(r) for r in store.pairs().collect()} == want
    store.compact()
    assert all(len(r) == 1 for r in store.runs().values())
    store.vacuum()
    assert {tuple(r) for r in runs.Runs(spark, f"{tmp_path}/s").pairs().collect()} == want
    assert len(list((tmp_path / "s" / "versions").glob("*.json"))) == 1
    near = co.AdjacencyStore(spark, f"{tmp_path}/first")
    near.put(spark.createDataFrame([(1, [2]), (3, [])], "node long, neighbours array<long>"))
    assert [tuple(r) for r in near.pairs().collect()] == [(1, 2)]


def test_large_json_objects_are_split(spark, tmp_path):
    """Braces, quotes and backslashes in strings, nested values, any layout: splits of a few bytes give what one task gives."""
    import random

    from plotweave.sources.members import read_members

    r = random.Random(3)
    nasty = ['}', '{', '"', '\\', '\\"', '}}{{', '"}', '\n', '[', ']', 'é🎉', ',', ': {"x": 1}', '']
    value = lambda n: "".join(r.choice(nasty) for _ in range(n))
    big = {f"k{i}{value(2)}": {"text": value(r.randrange(30)), "headline": None, "annotations": {"framing": {value(1): [{"start": 1, "end": 2, "code": "3"}]}}} for i in range(120)}
    (tmp_path / "one.json").write_text(json.dumps(big, indent=1, ensure_ascii=False) + "\n\n")
    small = {"a": {"text": "x"}, "b": {}}
    (tmp_path / "two.json").write_text(json.dumps(small) + json.dumps({"c": {"text": "}"}}))
    (tmp_path / "none.json").write_text("{}")
    (tmp_path / "empty.json").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("128m", "700b", "64b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            got = {}
            for row in read_members(spark, str(tmp_path)).collect():
                got |= json.loads(row.member)
            assert got == big | small | {"c": {"text": "}"}}, size
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "one.json")).rdd.getNumPartitions() > 50
        texts = {x.doc_id: x.text for x in co.read_json_corpus(spark, str(tmp_path / "one.json")).collect()}
        assert texts == {k: v["text"] for k, v in big.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_gradients_of_the_deep_net():
    from plotweave.operators.deep import Net

    r = np.random.default_rng(1)
    net = Net.drawn(5, 7, 3, 4, 2, alpha=1.5)
    net.w["mu"] = r.normal(0, 1, (4, 3))
    for b in ("b1", "b2", "b3", "b4"):
        net.w[b] = r.normal(0, 0.3, net.w[b].shape)
    x, y, totals = r.normal(0, 1, (6, 5)), r.normal(0, 1, (6, 5)), np.array([1.0, 2.0, 1.5, 0.7])
    target = net.soft(net.encode(x)[1])[0] ** 2 / totals
    target /= target.sum(1, keepdims=True)

    def points():  # the target is held fixed, as in the gradient
        h, z = net.encode(x)
        off = np.maximum(z @ net.w["W3"] + net.w["b3"], 0) @ net.w["W4"] + net.w["b4"] - x
        return (off**2).mean(1).sum() + 0.3 * (target * np.log(target / net.soft(z)[0])).sum()

    for got, loss in ((net.of_points(x, totals, 0.3)[0], points), (net.of_pairs(x, y, 0.6)[0], lambda: net.of_pairs(x, y, 0.6)[1])):
        for name, g in got.items():
            for at in list(np.ndindex(g.shape))[:: max(1, g.size // 6)]:
                keep = net.w[name][at]
                net.w[name][at] = keep + 1e-6
                up = loss()
                net.w[name][at] = keep - 1e-6
                down = loss()
                net.w[name][at] = keep
                assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-5), (name, at)


def test_deep_clusters(spark):
    """The loss falls, fewer pairs share a cluster than after k-means, and a second run gives the same."""
    from plotweave.operators.deep import deep_clusters

    r = np.random.default_rng(5)
    blob = r.normal(0, 1, (4, 6)) * 2
    x = [(i, (blob[i % 4] + r.normal(0, 0.9, 6)).tolist()) for i in range(120)]
    points = spark.createDataFrame(x, "id long, vector array<double>").repartition(2)
    pairs = [(i, j) for i in range(120) for j in range(i + 1, min(120, i + 12)) if i % 4 != j % 4]
    edges = spark.createDataFrame(pairs, "i long, j long").repartition(2)
    shared = lambda rows: (lambda at: sum(at[i] == at[j] for i, j in pairs))({q.id: q.cluster for q in rows.collect()})
    options = {"hidden": 16, "dims": 4, "w": 2.0, "warm_up": 20, "rate": 0.02, "seed": 1, "tol": 0.0}
    fit, net, losses = deep_clusters(points, edges, 4, steps=50, **options)
    assert losses[-1] < losses[0] / 1.5 and fit.assignment.count() == 120 and fit.centers.count() == 4
    assert shared(fit.assignment) <= shared(cl.kmeans(points, 4, n_init=3)[0])
    assert np.allclose(deep_clusters(points, edges, 4, steps=4, **options)[2], losses[:4], rtol=1e-9)


def test_tiles_of_the_deep_net():
    """A tile's gradients and loss are those of its pairs."""
    from plotweave.operators.deep import Net

    r = np.random.default_rng(1)
    net = Net.drawn(5, 7, 3, 4, 2)
    net.w["mu"] = r.normal(0, 1, (4, 3))
    for n, m in ((18, 18), (40, 3), (300, 70)):
        x, y, signs, others = r.normal(0, 1, (n, 5)), r.normal(0, 1, (m, 5)), r.integers(0, 3, n), r.integers(0, 3, m)
        for tile, (i, j), ends in ((net.of_tile(x, y, signs, others, 0.6), np.nonzero(signs[:, None] != others), y), (net.of_tile(x, None, signs, None, 0.6), np.nonzero(np.triu(signs[:, None] != signs)), x)):
            want, loss = net.of_pairs(x[i], ends[j], 0.6)
            assert tile[1] == pytest.approx(loss) and all(np.allclose(tile[0][name], want[name], atol=1e-9) for name in want)


def test_deep_clusters_without_pairs(spark, monkeypatch, bound):
    """Points with keys and signatures give what the list of their pairs gives; no pair is made, but rows of two blocks are."""
    from plotweave.operators import chains, deep

    monkeypatch.setattr(deep, "TILE", 7)
    points = bound.coalesce(1)
    edges = chains.cannot_links(bound.where("keys IS NOT NULL").select(F.col("id").alias("chain_id"), "keys", "signature"))
    tiles, n = deep._tiles(bound, 7)
    assert n == edges.count() and 4 < tiles.count() < 60
    options = {"hidden": 8, "dims": 3, "w": 2.0, "warm_up": 1, "steps": 2, "seed": 1, "tol": 0.0}
    want, got = deep.deep_clusters(points, edges, 4, **options), deep.deep_clusters(points, None, 4, **options)
    assert np.allclose(got[2], want[2], rtol=1e-9) and sorted(got[0].assignment.collect()) == sorted(want[0].assignment.collect())


def test_near_blocks_skip_what_lies_apart(spark):
    """All pairs within the radius meet, once in each order, and most blocks of far blobs don't."""
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(0, 0.3, (60, 3)) + 20 * r.normal(0, 1, 3) for _ in range(6)] + [np.ones((30, 3))])
    points = spark.createDataFrame([(i, "abc"[i % 2], v.tolist()) for i, v in enumerate(x)], "id long, g string, vector array<double>").repartition(4)

    def pairs(own, others):
        import pyarrow as pa

        d = np.sqrt(((qu.matrix(own)[:, None] - qu.matrix(others)) ** 2).sum(2)) if len(own) and len(others) else np.zeros((0, 0))
        a, b = np.nonzero(d <= 1.0)
        return pa.table({"i": own["id"].take(pa.array(a)), "j": others["id"].take(pa.array(b))})

    got, met = qu.near_blocks(points, 1.0, 16, ["g"], ["id", "vector"], pairs, "i long, j long")
    want = sorted((i, j) for i in range(len(x)) for j in range(len(x)) if i % 2 == j % 2 and np.linalg.norm(x[i] - x[j]) <= 1.0)
    assert sorted((p.i, p.j) for p in got.collect()) == want
    near = {p.near: p["count"] for p in met.groupBy("near").count().collect()}
    assert near[False] > near[True]


def test_repair_in_closed_form():
    """Against the pairs taken one after the other, and a large set of keys in seconds."""
    import time

    from plotweave.operators.assign import _in_turn, repaired

    r = np.random.default_rng(6)
    for k in (1, 2, 3, 4, 9):
        for n in (1, 2, 30, 200):
            for signs in (1, 2, 5):
                order = np.array([r.permutation(k)[:3] for _ in range(n)])
                sign = r.integers(0, signs, n)
                at, hits = _in_turn(order, sign)
                assert repaired(order.tolist(), sign.tolist()) == (at.tolist(), hits.tolist()), (k, n, signs)
    order, began = np.array([r.permutation(10)[:3] for _ in range(100_000)]).tolist(), time.time()
    at, hits = repaired(order, r.integers(0, 6, 100_000).tolist())
    assert time.time() - began < 20 and len(at) == 100_000 and sum(hits) > 10**8


def test_closest_centre_is_exact(spark):
    from plotweave.operators.assign import closest, distances

    r = np.random.default_rng(3)
    table = r.normal(0, 1, (50, 8)) + 1000
    table[9] = table[4]
    x = np.concatenate([r.normal(0, 1, (300, 8)) + 1000, table, (table[:25] + table[25:]) / 2])
    d = distances(x, table)
    best, d2 = closest(x, table)
    assert best.tolist() == d.argmin(1).tolist() and np.array_equal(d2, d.min(1))
    points = spark.createDataFrame([(1, [0.0, 1.0], "a"), (2, None, "b")], "id long, vector array<double>, note string")
    centers = spark.createDataFrame([(7, [0.0, 0.0]), (3, [0.0, 2.0])], "cluster int, center array<double>")
    assert [(x.id, x.note, x.nearest, x.d2) for x in cl.nearest(points, centers).orderBy("id").collect()] == [(1, "a", 3, 1.0), (2, "b", None, None)]


def test_thresholds_of_constraints(spark, bound):
    """One iteration against a loop in which a point pays for each earlier one that it excludes, that is open, and near."""
    points = bound.orderBy("id").collect()
    centers = spark.createDataFrame([(i, points[i].vector) for i in range(4)], "cluster int, center array<double>")
    table, x = np.array([points[i].vector for i in range(4)]), np.array([p.vector for p in points])
    d = ((x[:, None] - table) ** 2).sum(2)
    apart = cl.pairwise_threshold(bound, 40)
    for centroid, pairwise, w in ((100, None, 0.5), (70, None, 0.5), (100, 40, 0.5), (70, 40, 2.0)):
        open_ = np.sqrt(d.min(1)) <= np.percentile(np.sqrt(d.min(1)), centroid)
        limit, at = apart if pairwise else np.inf, []
        for j, p in enumerate(points):
            cost = d[j].copy()
            for i in range(j):
                q = points[i]
                if open_[i] and open_[j] and p.keys is not None and p.keys == q.keys and p.signature != q.signature and np.linalg.norm(x[i] - x[j]) <= limit:
                    cost[at[i]] += w
            at.append(int(np.argmin(cost)))
        got = cl.weighted_pckmeans(bound, 4, w, centers=centers, centroid_percentile=centroid, pairwise_percentile=pairwise, max_iter=1)
        assert [r.cluster for r in got.assignment.orderBy("id").collect()] == at
        some = [i for i in range(len(points)) if open_[i] and points[i].keys is not None]
        assert got.violations == [conflicts([points[i] for i in some], [at[i] for i in some], limit)]


def test_repair_pair_by_pair(spark, bound):
    points = bound.orderBy("id").collect()
    for k in (2, 3, 5):
        centers = spark.createDataFrame([(i, points[i].vector) for i in range(k)], "cluster int, center array<double>")
        d = ((np.array([p.vector for p in points])[:, None] - np.array([points[i].vector for i in range(k)])) ** 2).sum(2)
        order, at, hits = np.argsort(d, axis=1, kind="stable"), d.argmin(1).tolist(), 0
        for i, a in enumerate(points):
            for j in range(i + 1, len(points)):
                b = points[j]
                if a.keys is None or a.keys != b.keys or a.signature == b.signature or at[i] != at[j]:
                    continue
                hits += 1
                first = [c for c in order[i][1:] if c != at[j]]
                second = [c for c in order[j][1:] if c != at[i]]
                if first:
                    at[i] = first[0]
                elif second:
                    at[j] = second[0]
        got = cl.pckmeans_repair(bound, k, centers=centers, max_iter=1)
        assert [r.cluster for r in got.assignment.orderBy("id").collect()] == at and got.violations == [hits]


def test_silhouette_and_pairs_in_blocks(spark, bound):
    """Blocks of few points give what one block of all gives, and that is what loops give."""
    p = bound.withColumn("cluster", (F.col("id") % 3).cast("int"))
    rows = p.orderBy("id").collect()
    x = np.array([r.vector for r in rows])
    d = np.linalg.norm(x[:, None] - x, axis=2)
    want = {}
    for i, r in enumerate(rows):
        mean = {c: np.mean([d[i, j] for j, q in enumerate(rows) if q.cluster == c and j != i]) for c in range(3)}
        a, b = mean.pop(r.cluster), min(mean.values())
        want[r.id] = (b - a) / max(a, b)
    for block in (7, 512):
        assert {r.id: pytest.approx(r.silhouette) for r in qu.silhouette(p, block).collect()} == want
    sim = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    best = {}
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and a.cluster == b.cluster:
                kind = "same_neg" if a.keys is not None and a.keys == b.keys and a.signature != b.signature else "same_pos"
                if (i, kind) not in best or sim[i, j] > best[i, kind][1] + 1e-12:
                    best[i, kind] = j, sim[i, j]
    for block in (7, 512):
        got = cl.mined_pairs(p, same_pos=-2, same_neg=-2, block=block).where("kind LIKE 'same%'").collect()
        assert {(r.anchor, r.kind): (r.other, pytest.approx(r.similarity)) for r in got} == best


def test_balanced_pairs(spark):
    rows = [(i, "same_pos" if i < 30 else "other_pos", 100 + i, 0.5) for i in range(40)] + [(i, "same_neg", 200 + i, 0.5) for i in range(5, 15)]
    df = spark.createDataFrame(rows, "anchor long, kind string, other long, similarity double")
    for ratio, wanted, n in ((1.0, None, (10, 10)), (2.0, None, (20, 10)), (8.0, None, (40, 5)), (1.0, 12, (6, 6))):
        got = cl.balanced_pairs(df, ratio, wanted).collect()
        assert (sum(r.positive for r in got), sum(not r.positive for r in got)) == n
    one = cl.balanced_pairs(df, 1.0).where("positive").collect()
    assert {r.anchor for r in one} == set(range(5, 15))


def test_percentiles_without_a_buffer(spark):
    r = np.random.default_rng(3)
    rows = [(g, float(v)) for g, n in (("a", 17), ("b", 1), ("c", 40)) for v in r.normal(size=n)]
    df = spark.createDataFrame([*rows, ("d", None)], "g string, x double")
    for q in (0.0, 0.25, 0.8, 1.0):
        assert {x.g: pytest.approx(x["limit"]) for x in percentiles(df, ["g"], "x", q).collect()} == {g: np.percentile([v for h, v in rows if h == g], 100 * q) for g in "abc"}
        assert percentiles(df, [], "x", q).first()["limit"] == pytest.approx(np.percentile([v for _, v in rows], 100 * q))


def test_ranks_within_groups(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 10 < 8, "big").when(F.col("id") % 10 == 8, "small").alias("g"))
    got = ranked(df, ["g"], F.col("id").desc(), name="r", size="n").collect()
    for g, n in (("big", 400), ("small", 50), (None, 50)):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.r)
        assert [r.r for r in own] == list(range(1, n + 1)) and {r.n for r in own} == {n}
        assert [r.id for r in own] == sorted((r.id for r in own), reverse=True)


def test_sheets_and_tables(spark, tmp_path):
    import csv

    df = spark.createDataFrame([(1, 'a "b"'), (2, "c\td")], "id long, text string")
    co.write_sheet(df, f"{tmp_path}/sheet")
    (part,) = (tmp_path / "sheet").glob("part-*.csv")
    with open(part, newline="") as f:
        assert sorted(csv.reader(f, delimiter="\t", doublequote=True)) == [["1", 'a "b"'], ["2", "c\td"], ["id", "text"]]
    co.write_sentences(spark.createDataFrame([("d", 1, "x"), ("d", 0, "y"), ("e", 2, "z")], "doc_id string, sent_id long, text string"), f"{tmp_path}/s")
    assert {r.doc_id: r.sent_ids for r in spark.read.parquet(f"{tmp_path}/s/doc_sentences").collect()} == {"d": [0, 1], "e": [2]}


def test_settings_in_two_formats():
    text = """
    base { # settings of all
      "seed" = 42
      "num_clusters" = 10
    }
    news = ${base} {
      "corpus_path" = "./a#b" // a path
      "event_chain_num_threshold" = 30
    }"""
    conf = co.Config.from_hocon(text)
    assert conf["news"].n_clusters == 10 and conf["news"].max_chains == 30 and conf["news"].dataset == "news"
    assert conf["news"].paths == {"seed": "42", "corpus_path": "./a#b"} and conf["base"].max_chains is None


def test_early_stopper_of_scores():
    s = mo.EarlyStopper(2, 0.1)
    assert [s.stop_score(x) for x in (0.5, 0.45, 0.3, 0.6, 0.4, 0.4)] == [False, False, False, False, False, True]


def test_chat_server():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"message": {"content": "hello"}} if self.path == "/api/chat" else {"status": "success"}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = plugs.ChatServer("m", f"http://127.0.0.1:{server.server_port}", seed=7, temperature=0.2, num_ctx=100)
    assert client.chat("s", "u", {"type": "object"}) == client.chat("s", "u") == "hello"
    server.shutdown()
    assert [p for p, _ in seen] == ["/api/pull", "/api/chat", "/api/chat"] and seen[1][1]["format"] == {"type": "object"} and "format" not in seen[2][1]
    assert seen[1][1]["options"] == {"seed": 7, "temperature": 0.2, "num_ctx": 100, "num_predict": 2048} and [m["content"] for m in seen[1][1]["messages"]] == ["s", "u"]


def test_surrogates_are_searched(spark):
    r = np.random.default_rng(2)
    x = r.random((150, 2))
    rows = [(i, a.tolist(), [float((a[0] > 0.5) != (a[1] > 0.5)), float((a[0] > 0.5) == (a[1] > 0.5))]) for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, "doc_id long, x array<double>, p array<double>")
    _, _, linear = mo.search_surrogate(df, "x", "p", 2, trials=3)
    model, drawn, trees = mo.search_surrogate(df, "x", "p", 2, "trees", trials=2)
    assert trees < 0.1 < linear and set(drawn) == {"depth", "rounds", "step"}
    assert all(math.isclose(sum(r.fitted), 1) for r in model.predict(df).collect())


def test_sweep_has_a_fit_for_each_size(spark, bound):
    assert {k: f.assignment.select("cluster").distinct().count() <= k for k, f in cl.sweep(bound, range(2, 5), max_iter=2).items()} == {2: True, 3: True, 4: True}


def test_lemmas_by_plug(spark):
    rows = spark.createDataFrame([(1, "Dogs chased cats"), (2, None)], "k long, text string")
    assert {r.k: r.lemmas for r in plugs.lemmatize(rows, "k").collect()} == {1: ["dog", "chas", "cat"], 2: []}


def test_conjuncts_are_found_once():
    """Three joined objects after one verb, and two heads whose conjuncts don't repeat."""
    spec = [("dogs", "dog", "NOUN", "nsubj", 1), ("chase", "chase", "VERB", "ROOT", 1), ("cats", "cat", "NOUN", "dobj", 1), ("and", "and", "CCONJ", "cc", 2), ("mice", "mouse", "NOUN", "conj", 2), ("and", "and", "CCONJ", "cc", 4), ("birds", "bird", "NOUN", "conj", 4)]
    s = Sentence(tokens(spec))
    assert s.conjuncts([2], s.joins, lambda t: s.pos[t] == "NOUN") == [4, 6]
    assert s.conjuncts([2, 4], s.joins, lambda t: s.pos[t] == "NOUN") == [4, 6]


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace as N

    from plotweave.sources.tables import shared_folder

    def session(master, folder=None):
        conf = N(get=lambda key, default=None: folder)
        return N(conf=conf, sparkContext=N(master=master, getConf=lambda: conf))

    with pytest.raises(ValueError):
        shared_folder(session("spark://host:7077"))
    assert shared_folder(session("spark://host:7077", "hdfs://shared/")) == "hdfs://shared"


def test_adjacency_store(spark, tmp_path):
    store = co.AdjacencyStore(spark, f"{tmp_path}/near")
    rows = lambda *r: spark.createDataFrame(list(r), "node long, neighbours array<long>")
    store.merge(rows((1, [2, 3]), (4, [5])))
    store.merge(rows((1, [3, 6])))
    nodes = spark.createDataFrame([(1,), (4,), (9,)], "node long")
    assert {r.node: r.neighbours for r in store.get(nodes).collect()} == {1: [2, 3, 6], 4: [5], 9: []}
    store.put(rows((4, [7, 8])))
    assert {r.node: r.neighbours for r in store.get(nodes).collect()} == {1: [2, 3, 6], 4: [7, 8], 9: []}
    assert [tuple(r) for r in store.contains(spark.createDataFrame([(1, 6), (4, 5)], "node long, neighbour long")).collect()] == [(1, 6)]


def some_roles(spark, n=400, seed=5):
    r = np.random.default_rng(seed)
    rows = [(int(i), k := "ab"[int(r.integers(2))], f"{k}={r.integers(3)}") for i in r.permutation(n)] + [(n, "c", "c=0"), (n + 1, "d", "d=0"), (n + 2, "d", "d=0")]
    return rows, spark.createDataFrame(rows, "chain_id long, keys string, signature string").cache()


def plain_links(rows):
    return {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] != b[2]}


@pytest.mark.parametrize("block", [1000, 37])
def test_links_by_blocks(spark, block):
    rows, roles = some_roles(spark)
    got = [tuple(r) for r in ch.cannot_links(roles, block).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_links(rows)


def test_link_summary_makes_no_pairs(spark):
    rows, roles = some_roles(spark)
    ends = {}
    for i, j in plain_links(rows):
        ends.setdefault(i, []).append(j)
        ends.setdefault(j, []).append(i)
    assert {tuple(r) for r in ch.link_summary(roles).collect()} == {(i, len(o), min(o), max(o)) for i, o in ends.items()}


@pytest.mark.parametrize("clusters", [(3, 4), (200, 150), (390, 1, 400)])
def test_violations_of_iterations(spark, clusters):
    rows, roles = some_roles(spark)
    r = np.random.default_rng(1)
    at = [{x[0]: int(r.integers(k)) for x in rows if x[0] % 17} for k in clusters]
    labels = [spark.createDataFrame(list(a.items()), "chain_id long, cluster int") for a in at]
    times = {(i, j): sum(i in a and a[i] == a.get(j) for a in at) for i, j in plain_links(rows)}
    some = sum(any(i in a and a[i] == a.get(j) for i, j in times) for a in at)
    got = [tuple(x) for x in ch.violation_history(roles, labels).collect()]
    assert len(got) == len({x[:2] for x in got}) and set(got) == {(i, j, n, n == some) for (i, j), n in times.items() if n}
    for n in (1, 10, 60):
        want = sorted(((i, j, t) for (i, j), t in times.items() if t), key=lambda x: (-x[2], x[0], x[1]))[:n]
        assert [tuple(x) for x in ch.most_violated_within(roles, labels, n).collect()] == want


def test_a_run_is_written_by_one_shuffle(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    from plotweave.sources.runs import Runs

    plans, sort = [], DataFrame.sortWithinPartitions
    monkeypatch.setattr(DataFrame, "sortWithinPartitions", lambda df, *c, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or sort(df, *c, **k))
    runs = Runs(spark, str(tmp_path / "r"))
    runs.add(spark.range(40).selectExpr("id % 5 AS k", "id % 10 AS v"))
    assert plans[0].count("Exchange") == 1
    assert sorted(tuple(r) for r in runs.pairs().collect()) == sorted({(i % 5, i % 10) for i in range(40)})


def test_distance_matrix_of_copies():
    r = np.random.default_rng(2)
    x = r.normal(1000, 1, (60, 16))
    y = np.concatenate([x[:20], x[:20] + 1e-7, r.normal(0, 1, (20, 16))])
    want = np.sqrt(((x[:, None] - y) ** 2).sum(2))
    assert np.allclose(qu.distance_matrix(x, y), want, rtol=1e-9, atol=0) and (qu.distance_matrix(x, y)[np.arange(20), np.arange(20)] == 0).all()


def test_parts_of_mined_pairs(spark):
    """Either part comes without the work of the other."""
    r = np.random.default_rng(4)
    p = spark.createDataFrame([(i, i % 3, r.normal(size=4).tolist(), ["a", None][i % 5 == 0], f"s{i % 2}") for i in range(60)], "id long, cluster int, vector array<double>, keys string, signature string")
    near, far = cl.near_pairs(p, same_pos=0.1, same_neg=0.05), cl.far_pairs(p, other_pos=0.1, neighbours=20)
    assert "CoGroup" not in far._jdf.queryExecution().executedPlan().toString()
    got = {tuple(x) for x in near.unionByName(far).collect()}
    assert got == {tuple(x) for x in cl.mined_pairs(p, same_pos=0.1, same_neg=0.05, other_pos=0.1, neighbours=20).collect()} and len({x[1] for x in got}) == 4


@pytest.mark.parametrize("step", [3, 512])
def test_near_points_in_order(monkeypatch, step):
    """Blocks against a loop over earlier points, with copies and a limit that is the distance of many pairs; 6,000 points of one
    set of keys in seconds."""
    import time

    from plotweave.operators import assign

    monkeypatch.setattr(assign, "STEP", step)
    r = np.random.default_rng(4)
    x = np.repeat(r.integers(-2, 3, (40, 3)), 3, 0)[r.permutation(120)] / 10 + 100
    signs, table = r.integers(0, 3, 120), x[:4] + 0.01
    costs, limit, before = assign.distances(x, table), float(np.sqrt(((x[1] - x[0]) ** 2).sum())), []
    got = [np.concatenate(p) for p in zip(*(assign._near_in_order(x[i], signs[i], costs[i], 0.02, limit, before) for i in (slice(0, 50), slice(50, 120))))]
    at, hits = [], []
    for j in range(120):
        near = [at[i] for i in range(j) if signs[i] != signs[j] and np.sqrt(((x[i] - x[j]) ** 2).sum()) <= limit]
        n = np.bincount(near, minlength=4)
        at.append(int(np.argmin(costs[j] + 0.02 * n)))
        hits.append(n[at[-1]])
    assert got[0].tolist() == at and got[1].tolist() == hits and sum(hits)
    if step > 3:
        x, began = r.normal(0, 1, (6000, 64)), time.time()
        hits = assign._near_in_order(x, r.integers(0, 3, 6000), assign.distances(x, x[:10]), 0.1, 12.0, [])[1]
        assert time.time() - began < 20 and hits.sum() > 10**5


def test_starts_of_kmeans_run_side_by_side(spark, blobs, monkeypatch):
    """Four starts wait for each other, and the best one is that of starts one after the other."""
    import threading

    at_once, real = threading.Barrier(4), cl.KMeans

    class Waiting:
        def __init__(self, **options):
            self.inner = real(**options)

        def fit(self, rows):
            at_once.wait(30)
            return self.inner.fit(rows)

    monkeypatch.setattr(cl, "STARTS", 1)
    want = sorted(cl.kmeans(blobs.coalesce(1), 3, n_init=4)[0].collect())
    monkeypatch.undo()
    monkeypatch.setattr(cl, "KMeans", Waiting)
    assert sorted(cl.kmeans(blobs.coalesce(1), 3, n_init=4)[0].collect()) == want


def test_distances_move_where_they_are_fewer(spark, monkeypatch):
    """Fewer centres than dimensions give what as many do of which the added ones lie far away; held rows don't move to be joined."""
    from plotweave.operators import assign

    monkeypatch.setattr(assign, "CHUNK", 20)
    r = np.random.default_rng(3)
    data = [(i, r.normal(0, 1, 6).tolist(), None if i % 9 == 0 else f"k{i % 2}", f"s{i % 3}", i % 7 != 0) for i in range(120)]
    rows = assign.in_chunks(spark.createDataFrame(data, "id long, vector array<double>, keys string, signature string, open boolean").repartition(3))
    few = np.array([x[1] for x in data[:3]])
    taken = []
    monkeypatch.setattr(assign, "_priced", lambda *a, f=assign._priced: taken.append(1) or f(*a))
    got = sorted(assign.penalised(rows, few, 0.5, None).drop("open").collect(), key=lambda x: x.id)
    assert len(taken) == 1 and got == sorted(assign.penalised(rows, np.concatenate([few, np.full((4, 6), 1e3)]), 0.5, None).drop("open").collect(), key=lambda x: x.id) and len(taken) == 1
    held = cl._held(rows)
    assert held.count() == 120
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assigned = spark.createDataFrame([(i, i % 3) for i in range(120)], "id long, cluster int")
    assert plan(assigned.hint("merge").join(held.select("id", "vector"), "id")).count("Exchange hashpartitioning") == 1
    held.unpersist()
