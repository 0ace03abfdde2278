"""What larger tables and odd rows showed."""

from datetime import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.operators import chains as ch, clusters as cl
from plotweave.plans.catalogue import ORACLES, QUERIES


@pytest.fixture
def apart(spark):
    """Each file is a partition of its own."""
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    yield
    spark.conf.unset("spark.sql.files.openCostInBytes")


def events(spark, folder, *parts):
    """events.parquet with a file for each part: rows (event_id, user_id, event_type, value, k)."""
    for rows in parts:
        data = [(e, datetime(2024, 1, 1), u, t, v, f'{{"k": {k}}}') for e, u, t, v, k in rows]
        spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet' ORDER BY event_id")
    return con


def test_rank_overlap_adds_in_the_order_of_events(spark, apart, tmp_path):
    con = events(spark, tmp_path, [(0, 1, "click", 0.6, 1), (1, 1, "view", 0.1, 2)], [(2, 1, "view", 0.2, 3), (3, 1, "view", 0.3, 4)])
    assert [tuple(r) for r in QUERIES["rank_overlap"](spark, str(tmp_path)).collect()] == con.sql(ORACLES["rank_overlap"]).fetchall() == [(1, 1.0)]


def test_top_tokens_of_rows_that_share_an_event_id(spark, tmp_path):
    """0.1 + 0.2 + 0.3 is more than 0.6, 0.3 + 0.2 + 0.1 is not."""
    same = [(1, 1, "view", v, 2) for v in (0.1, 0.2, 0.3)]
    for name, rows in (("up", same), ("down", same[::-1])):
        events(spark, tmp_path / name, [(0, 1, "view", 0.6, 1), *rows])
        assert [tuple(r) for r in QUERIES["top_tokens"](spark, str(tmp_path / name)).collect()] == [(1, "o2 o1")], name


@pytest.mark.parametrize("block", [7, 4096])
def test_far_pairs_meets_all_points(spark, block):
    """Against a loop over all pairs; copies and multiples of vectors are ties that go to the smaller id."""
    r = np.random.default_rng(6)
    base = r.integers(-3, 4, (20, 5)).astype(float)
    base[3] = 0
    data = [(i, i % 3, (base[i % 20] * (1 + i % 2)).tolist(), ["a", None, "b"][i % 5 % 3], f"s{i % 2}") for i in range(60)]
    want = {}
    for i, c, x, k, s in data:
        met = []
        for j, d, y, l, t in data:
            if c != d:
                n = np.sqrt(np.dot(x, x) * np.dot(y, y))
                met.append((np.dot(x, y) / n if n else 0.0, j, k is not None and k == l and s != t))
        top = min((-v, j) for v, j, bad in met if not bad)
        if -top[0] > 0.1:
            want[i, "other_pos"] = (top[1], round(-top[0], 9))
        worst = min((v, j) for v, j, _ in met)
        want[i, "other_neg"] = (worst[1], round(worst[0], 9))
    p = spark.createDataFrame(data, "id long, cluster int, vector array<double>, keys string, signature string").repartition(3)
    got = cl.far_pairs(p, other_pos=0.1, block=block).collect()
    assert {(x.anchor, x.kind): (x.other, round(x.similarity, 9)) for x in got} == want and len(got) == len(want)


def test_far_pairs_without_vectors(spark):
    p = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 1, None), (3, 1, [0.0, 1.0]), (4, None, [1.0, 1.0])], "id long, cluster int, vector array<double>")
    got = cl.far_pairs(p.withColumns({"keys": F.lit("k"), "signature": F.lit("s")}), other_pos=0.1).collect()
    assert sorted(tuple(x) for x in got) == [(1, "other_neg", 3, 0.0), (2, "other_neg", 1, None), (3, "other_neg", 1, 0.0)]


@pytest.mark.parametrize("copies", [1, 40])
def test_pairwise_threshold_of_all_pairs(spark, monkeypatch, copies):
    monkeypatch.setattr(cl, "FEW_PAIRS", 50)
    x = np.repeat(np.random.default_rng(7).normal(5, 1, (1200 // copies, 3)), copies, 0)
    p = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, vector array<double>").repartition(3)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))[np.triu_indices(len(x), 1)]
    for q in (0, 2.5, 40, 75.3, 100):
        assert cl.pairwise_threshold(p, q, block=500) == pytest.approx(np.percentile(d, q), rel=1e-12, abs=1e-300), q


def test_repair_iterations_write_no_tables(spark, monkeypatch):
    r = np.random.default_rng(8)
    p = spark.createDataFrame([(i, r.normal(size=3).tolist(), ["a", "b", None][i % 3], f"s{i % 2}") for i in range(60)], "id long, vector array<double>, keys string, signature string")
    centers = spark.createDataFrame([(i, [float(i), 0.0, 0.0]) for i in range(3)], "cluster int, center array<double>")
    made = []
    monkeypatch.setattr(cl, "staged", lambda df, f=cl.staged: made.append(1) or f(df))
    fit = cl.pckmeans_repair(p, 3, centers=centers, max_iter=4)
    assert fit.iterations == 4 and len(made) == 2 and fit.assignment.count() == 60


def test_chains_go_to_few_places(spark, monkeypatch):
    roles = spark.createDataFrame([(i, "k", f"s{i % 3}") for i in range(40)], "chain_id long, keys string, signature string")
    monkeypatch.setattr(ch, "MOST_BLOCKS", 3)
    pairs = [tuple(r) for r in ch.cannot_links(roles, 2).collect()]
    assert sorted(pairs) == [(i, j) for i in range(40) for j in range(i + 1, 40) if i % 3 != j % 3]
