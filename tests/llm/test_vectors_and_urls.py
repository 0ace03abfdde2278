"""Vector codes, hard negatives and URL filters against plain versions of their contracts, with nulls, ties, repeats and no rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.llm import hard_negatives, url_filter, vector_codes
from plotweave.llm.hard_negatives import Mining

SCHEMA = "vec_id long, label int, embedding array<float>"


def vectors(n=230, d=32, seed=3):
    r = np.random.default_rng(seed)
    centre = r.standard_normal((5, d))
    rows = [(i, int(i % 5), [float(x) for x in np.float32(centre[i % 5] * 0.2 + 0.3 * r.standard_normal(d))]) for i in range(n)]
    rows[7] = (7, 2, None)
    rows[8] = (8, None, rows[8][2])
    rows[9] = (9, 1, [*rows[9][2][:-1], None])
    rows[11] = (11, 1, [math.nan, *rows[11][2][1:]])
    rows[12] = (12, 1, [math.inf, *rows[12][2][1:]])
    for i in range(40, 60):  # copies, with ties in everything
        rows[i] = (i, i % 3, rows[40][2])
    return rows + [rows[20], rows[20], (None, 3, rows[21][2])]


def clean(rows):
    return [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]


def integers(rows):
    return np.array([[math.floor(256 * x) for x in r[2]] for r in rows], object)


def plain_codes(rows, parts, entries, rounds):
    rows = sorted(clean(rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = integers(rows)
    m = x.shape[1] // parts
    x = x.reshape(len(rows), parts, m)
    books = [[list(x[e, p]) for e in range(min(entries, len(rows)))] for p in range(parts)]

    def assign():
        out = []
        for row in x:
            each = [min((sum((a - b) ** 2 for a, b in zip(row[p], c)), e) for e, c in enumerate(books[p])) for p in range(parts)]
            out.append(each)
        return out

    for _ in range(rounds):
        chosen = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [x[i, p] for i in range(len(rows)) if chosen[i][p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    chosen = assign()
    error = [sum(d for d, _ in c) for c in chosen]
    by_label = {}
    for r, e in zip(rows, error):
        by_label[r[1]] = by_label.get(r[1], 0) + e
    sha = hashlib.sha256(",".join(str(v) for p in books for e in p for v in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{e:02x}" for _, e in c), err, by_label[r[1]], sha) for r, c, err in zip(rows, chosen, error)), key=str)


def test_codes(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("code", F.lit("clash")).withColumn("name", F.lit(1))
    got = sorted((tuple(r) for r in vector_codes.vector_codes(df).collect()), key=str)
    assert got == plain_codes(rows, 16, 64, 2)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_codes_of_few_rows(spark, n):
    rows = [(i, None, [0.5, -0.25, 1.0]) for i in range(n)]
    got = vector_codes.vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.code, r.error) for r in got] == [("00" * 16, 0)] * n  # equal vectors, filled up to 16 parts: the first entry


def test_vectors_of_different_lengths_are_filled_up(spark):
    long, short = [1.0] * 32, [1.0] * 8
    books = vector_codes.compress(spark.createDataFrame([(1, 0, long), (2, 0, short)], SCHEMA))[1]
    assert books.shape == (16, 2, 2) and books[:, 1].ravel().tolist() == [256] * 8 + [0] * 24


@pytest.mark.parametrize("scale", [1, 300, 10**6, 10**8])
def test_screening_never_loses_the_nearest(scale):
    r = np.random.default_rng(scale)
    for m in (1, 4, 7):
        entries = r.integers(-scale, scale + 1, (64, m))
        entries[5], entries[40] = entries[3], entries[41]  # ties go to the lower number
        x = np.concatenate([r.integers(-scale, scale + 1, (500, m)), entries, (entries[:32] + entries[32:]) // 2, entries + r.integers(-1, 2, entries.shape)])
        best, d, evaluated = vector_codes.nearest(x, entries)
        exact = ((x[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
        assert best.tolist() == [min(range(64), key=lambda e: (row[e], e)) for row in exact]
        assert d.tolist() == exact.min(1).tolist()
        assert evaluated < 64 * len(x) / 2 or scale == 1


def test_components_too_large(spark):
    with pytest.raises(Exception, match="too large"):
        vector_codes.vector_codes(spark.createDataFrame([(1, 1, [1e30] * 16)], SCHEMA)).collect()


def plain_negatives(rows, every, mining):
    rows = [r for r in clean(rows) if r[1] is not None]
    x = integers(rows)
    inf = float("inf")
    name = lambda i: inf if rows[i][0] is None else rows[i][0]
    out = []
    for a, row in enumerate(rows):
        if row[0] is None or row[0] % every:
            continue
        score = [int(s) for s in x @ x[a]]
        order = sorted((i for i in range(len(rows)) if i != a), key=lambda i: (-score[i], name(i)))
        for p in [i for i in order if rows[i][1] == row[1]][: mining.positives]:
            fits = [i for i in order if rows[i][1] != row[1] and mining.low * score[p] <= 100 * score[i] <= mining.high * score[p]]
            out += [(row[0], rows[p][0], k + 1, rows[i][0], score[p], score[i]) for k, i in enumerate(fits[: mining.negatives])]
    return sorted(out, key=str)


@pytest.mark.parametrize("side,chunk,mining", [(512, 32, Mining()), (16, 5, Mining()), (7, 8, Mining(3, 2, 50, 120))])
def test_negatives(spark, side, chunk, mining):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"place": F.lit("clash"), "anchor": F.lit("clash")})
    got = sorted((tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, mining, side, chunk).collect()), key=str)
    want = plain_negatives(rows, 10, mining)
    assert got == want and len(want) > 50


def test_negatives_of_large_components(spark):
    """Partial tiles beyond 2**53 are summed in integers."""
    r = np.random.default_rng(1)
    rows = [(i, i % 2, [float(x) for x in np.float32(r.standard_normal(4) * 90000)]) for i in range(40)]
    got = sorted((tuple(x) for x in hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") < 9, chunk=3).collect()), key=str)
    assert got == sorted((x for x in plain_negatives(rows, 1, Mining()) if x[0] < 9), key=str) and got


def test_no_negatives(spark):
    for rows in ([], [(1, 1, [1.0])], [(0, 1, [1.0]), (1, 1, [1.0])], [(0, None, [1.0]), (100, 1, None)]):
        assert hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).count() == 0


URLS = [
    None, "", "no scheme", "http://", "https://Example.COM/en/a", "https://x.example.com/en/", "https://example.com/en", "https://www.EXAMPLE.com/en/x?y=/en/", "http://a.www.example.com/en/#z",
    "http://notexample.com/en/", "http://com/", "http://com", "http://com?x", "http://a.net/es/", "http://net/fr/q", "http://a.net/ES/", "http://a.net/de/es/", "http://org/es/", "ftp://u@a.com:80/p://q",
    "http://ÄB.com/é", "http://a.com/\n?x", "://x.net/fr/", "http://" + "a." * 30000 + "net/es/" + "z" * 100000, "http://a.com//", "http://.com/x",
]


def plain_rule(url):
    rest = url.partition("://")[2] if url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in url_filter.RULES for h, p in [r[1].split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    best = max(fits, key=lambda r: len(r[1]), default=None)
    return host, path, best and best[1], best and best[0]


def test_rules(spark):
    rows = [(i, u, "clash") for i, u in enumerate([*URLS, URLS[4]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, url_filter.train(pages)).collect()}
    assert len(got) == len(rows)
    for i, u, _ in rows:
        host, path, rule, verdict = plain_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert {r.rule for r in got.values()} == {None, *(r[1] for r in url_filter.RULES)}


def test_trees_judge_what_rules_do_not_see(spark):
    """Of held-out URLs that rules would label, the trees, which see no rule, agree with most; verdicts don't depend on partitions."""
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    seen, unseen = (pages.where((F.crc32(F.col("url").cast("binary")) % 3 == 0) == x) for x in (False, True))
    model = url_filter.train(seen)
    got = url_filter.judge_urls(unseen, model).where("rule IS NOT NULL").collect()
    assert sum((r.score > 0.5) == (r.verdict == "block") for r in got) >= 0.9 * len(got) and len(got) > 20
    again = url_filter.judge_urls(unseen, url_filter.train(seen.repartition(7))).collect()
    assert {r.page_id: r.verdict for r in again} == {r.page_id: r.verdict for r in url_filter.judge_urls(unseen, model).collect()}
    plan = url_filter.judge_urls(pages, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan


def test_urls_without_labels(spark):
    none = spark.createDataFrame([(1, "x"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in url_filter.judge_urls(none, url_filter.train(none)).collect()} == {"allow"}
    one = spark.createDataFrame([(1, "http://a.net/es/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in url_filter.judge_urls(one, url_filter.train(one)).collect()} == {"block"}
    assert url_filter.judge_urls(none.limit(0), url_filter.train(none.limit(0))).count() == 0


def test_entropy(spark):
    texts = ["", "aaaa", "abab", "hello world", "héé東"]
    want = [-sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t)) + 0.0 for t in texts]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(url_filter._entropy(F.col("t"))).collect()
    assert [r[0] for r in got] == pytest.approx(want, abs=1e-12)


def test_no_panel_is_broadcast(spark):
    """An anchor panel has a copy for each group of row panels; Spark's estimate of its size has one."""
    rows = spark.createDataFrame([(i, i % 3, [float(i % 7), 1.0]) for i in range(300)], "vec_id long, label long, embedding array<double>")
    joins = [line for line in hard_negatives.hard_negatives(rows, F.col("vec_id") % 10 == 0, side=4, chunk=1)._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "r_group" in line]
    assert joins and not any("Broadcast" in line for line in joins)
