"""Every query with SQL against DuckDB on the smallest tables; the others against what must hold of them."""

import inspect
import math
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.operators import clusters as cl, models as mo
from plotweave.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def tidy(f):
    f = f[sorted(f.columns)].copy()
    for c in f.columns:
        if f[c].dtype == object or str(f[c].dtype).startswith("str"):
            f[c] = f[c].astype(str)
        elif str(f[c].dtype) != "bool":
            f[c] = f[c].astype(float).round(5)
    return f.sort_values(list(f.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got, want = tidy(QUERIES[name](spark, SF).toPandas()), tidy(duck.sql(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        bad = got[c].astype(str) != want[c].astype(str)
        assert not bad.any(), (c, got[bad].head(3), want[bad].head(3))


def test_samples_have_their_sizes(spark):
    per = {r["lang"]: r["count"] for r in QUERIES["balanced_sample"](spark, SF).groupBy("lang").count().collect()}
    assert all(n <= 14 for n in per.values())
    folds = QUERIES["cv_folds"](spark, SF).groupBy("lang", "repeat", "fold").count().collect()
    by = {}
    for r in folds:
        by.setdefault((r["lang"], r["repeat"]), []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in by.values() if len(v) == 5)


def test_clusterings(spark):
    for name in ("kmeans", "weighted_pckmeans", "weighted_pckmeans_blocks", "weighted_pckmeans_thresholds", "pckmeans_repair"):
        got = QUERIES[name](spark, SF)
        assert got.count() == got.select("id").distinct().count() == 500
    assert QUERIES["cl_init"](spark, SF).select("id").distinct().count() == 10


def test_reseeding_replaces_the_worst(spark):
    """The share of clusters with most violations get points as centres, the others keep theirs."""
    from plotweave.operators import chains as ch, quality as qu
    from plotweave.plans import catalogue, views

    p = views.points(spark, SF)
    old = {r.cluster: r.center for r in qu.centroids(p).collect()}
    bad = {r.cluster: r.violations for r in ch.violations(p.select(p.id.alias("chain_id"), "cluster"), catalogue._roles(spark, SF)).collect()}
    got = {r.cluster: r.center for r in QUERIES["reseeded"](spark, SF).collect()}
    worst = sorted(bad, key=lambda c: (-bad[c], c))[: max(1, int(len(old) * 0.3))]
    vectors = {tuple(r.vector) for r in p.collect()}
    assert set(got) == set(old) and {c for c in old if got[c] != old[c]} == set(worst)
    assert all(tuple(got[c]) in vectors for c in worst)


def test_coefficients_name_the_extremes(spark):
    rows = QUERIES["coefficients"](spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r.label, []).append(r.coefficient)
    assert len(by) == 10 and all(len(v) == 10 and v == sorted(v, reverse=True) and v[0] > 0 > v[-1] for v in by.values())


def test_svd_embed_has_the_words_of_documents(spark):
    """Fewer documents than dimensions: inner products are those of the TF-IDF rows of whole texts."""
    texts = {r.doc_id: re.findall(r"\w\w+", (r.text or "").lower(), re.ASCII) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    df = Counter(w for ws in texts.values() for w in set(ws))
    rows = {}
    for i, ws in texts.items():
        x = {w: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in Counter(ws).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        rows[i] = {w: v / norm for w, v in x.items()}
    got = {r["item"]: np.array(r.vector) for r in QUERIES["svd_embed"](spark, SF).collect()}
    assert set(got) == {i for i, x in rows.items() if x}
    for i in sorted(got):
        for j in sorted(got):
            assert abs(got[i] @ got[j] - sum(v * rows[j].get(w, 0.0) for w, v in rows[i].items())) < 1e-4


def test_span_overlap_looks_for_lines_of_annotated_documents_only(spark, tmp_path, monkeypatch):
    from plotweave.operators import documents as doc

    docs = [(1, "one line\nanother line", "en"), (2, "no annotation\nhere", "en"), (3, "no language", None), (4, None, "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    events = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 1, 1), (3, 3, 0), (4, 4, 0), (5, 9, 0)], "event_id long, user_id long, k int")
    events.selectExpr("event_id", "user_id", "'view' AS event_type", "1.0D AS value", "concat('{\"k\": ', k, '}') AS props", "timestamp_seconds(event_id) AS ts").write.parquet(str(tmp_path / "events.parquet"))
    seen, find = [], doc.with_spans
    monkeypatch.setattr(doc, "with_spans", lambda s, d: seen.append(sorted(r.doc_id for r in d.select("doc_id").collect())) or find(s, d))
    got = sorted(tuple(r) for r in QUERIES["span_overlap"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(con.execute(ORACLES["span_overlap"]).fetchall()) and len(got) == 3
    assert seen == [[1, 3, 4]]


def test_svo_extract_parses_and_extracts_in_one_task(spark):
    """Tokens don't leave Python, and the triples are those of the two steps apart."""
    from plotweave.operators import documents as doc, plugs, svo
    from plotweave.plans import catalogue

    got = QUERIES["svo_extract"](spark, SF)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = svo.extract_svos(plugs.parse_sentences(doc.number_sentences(catalogue._sentences(spark, SF))))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


@pytest.mark.parametrize("operator, name", [(cl.kmeans, "kmeans"), (cl.weighted_pckmeans, "weighted_pckmeans"), (cl.pckmeans_repair, "pckmeans_repair"), (mo.fit_frames, "frame_regression"), (mo.fit_frames, "surrogates"), (mo.fit_frames, "frame_forest")])
def test_fits_run_to_the_operators_own_limits(spark, monkeypatch, operator, name):
    given = {}

    def stop(*args, **options):
        given.update(inspect.signature(operator).bind(*args, **options).arguments)
        raise InterruptedError

    monkeypatch.setattr(inspect.getmodule(operator), operator.__name__, stop)
    with pytest.raises(InterruptedError):
        QUERIES[name](spark, SF)
    options = {**given, **given.get("options", {})}
    assert not {"max_iter", "n_init", "trees", "patience", "tol"} & set(options)


def test_models_run(spark):
    assert 0 <= QUERIES["frame_regression"](spark, SF).first().accuracy <= 1
    assert QUERIES["surrogates"](spark, SF).first().mse < 0.05


def test_top_tokens_are_added_in_the_order_of_events(spark, tmp_path):
    """Equal exact sums that differ as doubles: files cut between the events of a word give what SQL gives in one pass."""
    rows = [(0, 2, 0.1), (1, 2, 0.2), (2, 2, 0.3), (3, 1, 0.6)]
    folder = tmp_path / "events.parquet"
    for part in (rows[:1], rows[1:]):
        table = spark.createDataFrame([(i, 7, "view", v, f'{{"k": {k}}}') for i, k, v in part], "event_id long, user_id long, event_type string, value double, props string")
        table.withColumn("ts", F.timestamp_seconds("event_id")).coalesce(1).write.mode("append").parquet(str(folder))
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/*.parquet' ORDER BY event_id")
    want = con.execute(ORACLES["top_tokens"]).fetchall()
    assert want == [(7, "o2 o1")] and [tuple(r) for r in QUERIES["top_tokens"](spark, str(tmp_path)).collect()] == want
