"""What the contracts ask beyond the small fixtures: large groups, long texts, hot ids, held-out rows and pages marked by hand."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.llm import exact_dedup, fingerprints, html_text, licenses, near_dedup, packing, quality, token_counts
from plotweave.llm.near_dedup import Near


def near_copies(n, seed=3):
    """A text of 90 words and copies of it with 0 to 6 words replaced, as many pairs just above as just below the threshold."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(90)]
    out = []
    for i in range(n):
        own = list(words)
        for _ in range(r.randint(0, 6)):
            own[r.randrange(90)] = f"x{r.randrange(400)}"
        out.append(" ".join(own))
    return out


def exact_components(texts, k, percent):
    """By a matrix of all pairs."""
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if (w := t.split()) else set() for t in texts]
    column = {}
    rows = [[column.setdefault(x, len(column)) for x in s] for s in sets]
    m = np.zeros((len(texts), len(column)), np.float32)
    for i, s in enumerate(rows):
        m[i, s] = 1
    common, size = m @ m.T, np.array([len(s) for s in sets])
    link = (100 * common >= percent * (size[:, None] + size - common)) & (size > 0) & (size[:, None] > 0)
    root = np.arange(len(texts))
    while True:
        new = np.array([root[link[i]].min() if link[i].any() else root[i] for i in range(len(texts))])
        new = np.minimum(new, root)
        if (new == root).all():
            return root.tolist(), int(link.sum() - (size > 0).sum()) // 2
        root = new


@pytest.mark.parametrize("work", [near_dedup.WORK, 3000])
def test_a_large_group_of_near_copies(spark, monkeypatch, work):
    """2,000 near copies, most pairs no links: all components equal those of an exact join, in one round and in many."""
    monkeypatch.setattr(near_dedup, "WORK", work)
    texts = near_copies(2000)
    want, links = exact_components(texts, 3, 85)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(df, Near(3, 85, 32, 5)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) > 50 and links > 10_000


def test_blocks_leave_no_pair_out():
    """Of random sets, may_link names each pair that is a link, in the first bucket that both share, and only there."""
    r = np.random.default_rng(4)
    near = Near(3, 85, 32, 5)
    signer, base = near_dedup.Signer(near), r.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.where(r.random(300) < 0.05, r.integers(0, 2**63, 300).astype(np.uint64), base)) for _ in range(40)]
    rows = [(i, len(s), i, near_dedup.sketch(s), keys) for i, (s, keys) in enumerate(zip(sets, signer.keys(sets).view(np.int64).tolist()))]
    side, found = near_dedup._Side.of(rows), {}
    for b in {k for row in rows for k in row[4]}:
        held = near_dedup._Side.of(own := [x for x in rows if b in x[4]])
        for k in range(len(own)):
            for at in near_dedup.may_link(held, k, held, b, True, 85):
                found.setdefault((own[at][0], own[k][0]), []).append(b)
    for i in range(40):
        for j in range(i + 1, 40):
            if near_dedup.similar(sets[i], sets[j], 85) and set(rows[i][4]) & set(rows[j][4]):
                assert found[i, j] == [next(x for x, y in zip(rows[i][4], rows[j][4]) if x == y)]
    assert all(len(v) == 1 and i < j for (i, j), v in found.items()) and len(side.id) == 40


def test_quality_on_held_out_documents(spark):
    """Rows that are never learned from: nearly all are right, and the score ranks them."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("truth"))
    got = quality.op4(spark, sf).where("held_out").join(labels, "doc_id").toPandas()
    good, bad = got[got["truth"] == 1]["score"].to_numpy(), got[got["truth"] == 0]["score"].to_numpy()
    assert len(good) > 20 and len(bad) > 10
    assert (got["predicted"] == got["truth"]).mean() > 0.95
    assert (good[:, None] > bad).mean() > 0.98


@pytest.fixture(scope="module")
def labelled(spark):
    sf = "/root/testdata/sf0.001"
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")


@pytest.mark.parametrize("case", ["equal rows", "other texts", "long document", "nulls"])
def test_quality_sample_survives(spark, labelled, case):
    """With a bound that the labelled documents reach: many rows of the first doc_id, or a document beyond the bound, leave a
    model that tells documents apart nearly as it did without them."""
    docs, labels = labelled
    plain = quality.train(docs, labels, sample_docs=60, sample_passages=600)
    usable = labels.where(~quality.held_out()).withColumn("k", F.md5(F.col("doc_id").cast("string").cast("binary"))).orderBy("k")
    first = usable.first().doc_id
    if case == "equal rows":
        more = docs.where(F.col("doc_id") == first).crossJoin(spark.range(100)).select("doc_id", "text")
    elif case == "other texts":
        more = spark.range(100).select(F.lit(first).alias("doc_id"), F.concat(F.lit("some other text "), F.col("id").cast("string")).alias("text"))
    elif case == "long document":
        more = spark.createDataFrame([(first, "word " * (40 * 700)), (first, "word " * (40 * 100))], "doc_id long, text string")
    else:
        more = spark.createDataFrame([(None, None), (first, None), (None, "x")], "doc_id long, text string")
        labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (first, None, 0), (first, 7, 0)], "doc_id long, quality int, toxic int").select(*[F.col(c).cast(t) for c, t in labels.dtypes]))
    model = quality.train(docs.unionByName(more), labels, sample_docs=60, sample_passages=600)
    score = lambda m: {r.doc_id: r.score for r in quality.score_quality(docs, m).collect()}
    a, b = score(plain), score(model)
    assert max(b.values()) - min(b.values()) > 0.8
    assert sum((a[i] >= 0.5) == (b[i] >= 0.5) for i in a) > 0.9 * len(a)


def test_quality_without_a_sample(spark, labelled):
    docs, labels = labelled
    for d, l, room in ((docs.limit(0), labels, 600), (docs, labels.limit(0), 600), (docs, labels, 0)):
        assert {round(r.score, 6) for r in quality.score_quality(docs.limit(5), quality.train(d, l, 60, room)).collect()} == {0.5}


def test_quality_sample_is_bounded(spark):
    """A few very long documents don't take more passages than the bound, and the model is one of the rest."""
    rows = [(i, "word " * (40 * 50 if i < 3 else 40)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []

    def fit(bags, target):
        seen.append(sum(map(len, bags)))
        return quality.Model({}, np.zeros(1), np.ones(1))

    keep = quality.fit
    try:
        quality.fit = fit
        quality.train(docs, labels, sample_passages=30)
        quality.train(docs, labels)
    finally:
        quality.fit = keep
    held = {r.doc_id for r in docs.where(quality.held_out()).collect()}
    assert seen[0] <= 30 and seen[1] == sum(50 if i < 3 else 1 for i in range(60) if i not in held)


@pytest.mark.parametrize("piece", [64, 1000, 4096])
def test_fingerprints_in_pieces(monkeypatch, piece):
    """Pieces of a text give the fingerprint of the whole, for texts with and without ends in a piece."""
    r = random.Random(piece)
    datas = [bytes(r.randrange(256) for _ in range(n)) for n in (1, 63, 64, 65, 999, 5000, 20_000)] + [b"ab" * 9000, b"x" * 9000]
    want = [fingerprints.fingerprint(d) for d in datas]
    monkeypatch.setattr(fingerprints, "PIECE", piece)
    monkeypatch.setattr(fingerprints, "_POWERS", {})
    assert [fingerprints.fingerprint(d) for d in datas] == want


def test_fingerprints_of_hot_ids(spark):
    """A third of the rows without doc_id and a third with one: they make several parts, and each row still has its next."""
    r = random.Random(6)
    texts = [" ".join(f"t{r.randrange(5000)}" for _ in range(r.randint(1, 60))) for _ in range(900)]
    ids = [None] * 300 + [50] * 300 + [100 + i for i in range(300)]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    order = df.select("doc_id", "text", F.xxhash64("text").alias("h")).orderBy("doc_id", "h", "text").collect()
    want = []
    for x, y in zip(order, [*order[1:], order[0]]):
        n = len(x.text)
        edited = x.text[: n - n // 2] + y.text[: n // 2]
        marks = [fingerprints.fingerprint(t.encode()) for t in (x.text, edited, y.text)]
        want.append((x.doc_id, n, *marks[:2], fingerprints.likeness(marks[0], marks[1]), fingerprints.likeness(marks[0], marks[2])))
    got = fingerprints.fingerprints(df).select("doc_id", "n_chars", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("hot", [7, None])
def test_fingerprints_of_equal_rows(spark, monkeypatch, hot):
    """Thousands of equal rows, of one doc_id or of none: each has a result, their texts don't meet in a part."""
    monkeypatch.setattr(fingerprints, "COPIES", 100)
    same = "the same words again and again, " * 20
    rows = [(hot, same)] * 2500 + [(hot, "another text of that id")] * 3 + [(i, f"text {i} " * (i % 9)) for i in range(60) if i != hot] + [(8, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    order = [(r.doc_id, r.text) for r in df.selectExpr("doc_id", "coalesce(text, '') text").selectExpr("*", "xxhash64(text) h").orderBy("doc_id", "h", "text").collect()]
    marks = {}
    mark = lambda t: marks.get(t) or marks.setdefault(t, fingerprints.fingerprint(t.encode()))
    want = []
    for (i, x), (_, y) in zip(order, [*order[1:], order[0]]):
        edited = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        want.append((i, len(x), hashlib.sha256(edited.encode()).hexdigest(), mark(x), mark(edited), fingerprints.likeness(mark(x), mark(edited)), fingerprints.likeness(mark(x), mark(y))))
    seen = []
    keep = fingerprints._in_parts
    monkeypatch.setattr(fingerprints, "_in_parts", lambda t, *a: seen.append(t.where("doc_id <=> %s" % ("null" if hot is None else hot)).count()) or keep(t, *a))
    got = fingerprints.fingerprints(df)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert seen[0] < 10


def test_fingerprints_of_equal_rows_only(spark):
    got = fingerprints.fingerprints(spark.createDataFrame([(3, "one text")] * 500, "doc_id long, text string")).collect()
    assert len(got) == 500 and len(set(got)) == 1 and got[0].near_next == 1.0


def test_sequences_are_not_padded():
    r = random.Random(5)
    for n, window in ((0, 2048), (1, 2048), (3, 2048), (40, 256), (500, 2048)):
        lengths, sizes = [r.randint(1, min(300, window)) for _ in range(n)], {}
        got = packing.plan(lengths, window)
        for i, first, length, sequence, offset in got:
            assert offset == sizes.get(sequence, 0) and length > 0
            sizes[sequence] = offset + length
        assert sum(sizes.values()) == sum(lengths) and all(x == window or x & (x - 1) == 0 for x in sizes.values())
        for i, x in enumerate(lengths):
            at = 0
            for _, first, length, *_ in sorted(p for p in got if p[0] == i):
                assert first == at
                at += length
            assert at == x
        assert sorted(sizes) == list(range(len(sizes)))


def test_packing_has_a_partition_for_so_many_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 5)
    df = spark.createDataFrame([(i, "some words") for i in range(700)], "doc_id long, text string")
    out = packing.pack_documents(df)
    assert out.rdd.getNumPartitions() == -(-140 // packing.SHARDS_EACH) and out.agg(F.sum("length")).first()[0] == out.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]


PAGES = [
    ("""<html><head><title>The mill | Valley News</title></head><body><div id="top-nav"><a href="/">Home</a> <a href="/sport">Sport</a> <a href="/news">News</a></div>
<div class="cookie-banner">We use cookies to improve your visit. <button>Accept</button></div>
<div class="wrapper"><div class="story-body"><h1>Old mill opens again after forty years</h1><p>The mill on the river bank was closed when its owner moved away, and nobody had looked after it since then.</p>
<p>Last week, volunteers from three villages finished the work on the wheel &amp; the roof, and the doors were opened.</p><div class="advert">Buy new shoes today, half price!</div>
<blockquote>We never thought that so many people would come to help us.</blockquote><ul><li>The wheel turns on Saturdays.</li><li>Bread is sold in the yard.</li></ul></div>
<div class="related"><h3>More stories</h3><ul><li><a href="/a">Bridge closed for a month</a></li><li><a href="/b">School wins a prize</a></li></ul></div></div>
<div id="comments"><h2>2 comments</h2><div class="comment"><b>anna</b><p>Wonderful news, I will visit it soon.</p></div><div class="comment"><b>tom</b><p>At last, well done.</p></div></div>
<div class="footer">Copyright Valley News. All rights reserved. <a href="/imprint">Imprint</a></div></body></html>""",
     "Old mill opens again after forty years\nThe mill on the river bank was closed when its owner moved away, and nobody had looked after it since then.\nLast week, volunteers from three villages finished the work on the wheel & the roof, and the doors were opened.\nWe never thought that so many people would come to help us.\nThe wheel turns on Saturdays.\nBread is sold in the yard."),
    ("""<!doctype html><body><header class="site-header"><a href="/">Garden letters</a><nav><ul><li><a href="/1">Archive</a><li><a href="/2">About</a></ul></nav></header>
<main><article class="post"><h1>How to keep bees<br>in a town</h1><p class="first">Bees need water, flowers and a quiet place, which a flat roof can give them.
<p>In spring the hive should be looked at every week; a strong one may swarm in <em>May</em> or June.<h2>What to plant</h2><p>Lavender, thyme and clover give nectar for many weeks and need little care.</article>
<aside class="sidebar"><h3>Newsletter</h3><form action="/subscribe"><label>Your address</label><input name="mail"><button>Subscribe</button></form></aside></main>
<footer><p>Written by hand. <a href="/rss">Feed</a></p></footer></body>""",
     "How to keep bees in a town\nBees need water, flowers and a quiet place, which a flat roof can give them.\nIn spring the hive should be looked at every week; a strong one may swarm in May or June.\nWhat to plant\nLavender, thyme and clover give nectar for many weeks and need little care."),
    ("""<html><body><nav class="menu"><a href="#">Start</a> | <a href="#">Contact</a></nav><script>var x = "<p>no text</p>";</script><style>p { color: red }</style>
<article><h1>On falling stones</h1><p>A stone that falls for a time <math><mi>t</mi></math> has gone <math><mi>s</mi><mo>=</mo><mfrac><mi>g</mi><mn>2</mn></mfrac></math> of the way that is meant here.</p>
<p>A picture would show it: <svg><text>labels</text></svg> but <select><option>one<option>two</select> words must do, and they are enough for most readers of this page.</p>
<p><object data="x.pdf">The table is also available as text.</object> The numbers were taken again a year later.</p></article>
<footer class="footer">&copy; The school of mines</footer></body></html>""",
     "On falling stones\nA stone that falls for a time t has gone s=g2 of the way that is meant here.\nA picture would show it: but words must do, and they are enough for most readers of this page.\nThe table is also available as text. The numbers were taken again a year later."),
]


def test_pages_marked_by_hand():
    trees = html_text.model()
    assert html_text.extract([p for p, _ in PAGES], trees) == [t for _, t in PAGES]


@pytest.mark.parametrize("tag", ["svg", "select", "object", "math", "template", "noscript"])
def test_unclosed_elements_hide_nothing(tag):
    page, want = PAGES[0]
    got = html_text.extract([page.replace("<p>The mill", f"<p><{tag}>The mill")], html_text.model())[0]
    assert got == want


def test_pages_take_linear_time():
    """Unmatched end tags over many open elements, unclosed hidden ones, and many links."""
    for piece in ("<span><b>", "</i></b>", "<svg>", "<select><select></select>", "<a href='x'>y", "<b><div><span></b>"):
        small, large = ("<body>" + "<span>" * n + piece * n for n in (4000, 16_000))
        took = []
        for page in (small, large):
            began = time.perf_counter()
            html_text.blocks(nodes := html_text.parse(page), [True] * len(nodes))
            took.append(time.perf_counter() - began)
        assert took[1] < 12 * took[0] + 0.2, piece


def test_pages_with_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "u", PAGES[0][0], 5, "t"), (1, "u", PAGES[0][0], 5, "t"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, text string")
    got = html_text.extract_pages(df).collect()
    assert sorted(str(r.page_id) for r in got) == ["1", "1", "None"] and {r.text for r in got} == {PAGES[0][1], ""}
    assert all(r.n_chars == len(r.text) for r in got)


def test_very_long_texts(spark):
    """Texts of some megabytes beside short ones go through every operator whole."""
    r = random.Random(1)
    long = " ".join(f"w{r.randrange(3000)}" for _ in range(400_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short"), (4, None)], "doc_id long, text string")
    dedup = {x.doc_id: x.component_id for x in near_dedup.near_dedup(df).collect()}
    assert dedup == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {x.doc_id: x.kept for x in exact_dedup.exact_dedup(df).collect()} == {i: True for i in range(1, 5)}
    marks = {x.doc_id: x for x in fingerprints.fingerprints(df).collect()}
    assert marks[1].n_chars == len(long) and marks[1].near_next > 0.9
    assert {x.doc_id: x.n_words for x in licenses.scan_licenses(df).collect()} == {1: 400_000, 2: 400_001, 3: 1, 4: 0}
    pieces = packing.pack_documents(df).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert all(x.n == x.t for x in pieces)
    assert {x.doc_id: x.n_bytes for x in token_counts.count_tokens(df).collect()}[2] == len(long) + 4
    assert all(0 <= x.score <= 1 for x in quality.score_quality(df, quality.fit([], np.zeros(0, "f4"))).collect())


def test_each_part_of_a_licence_gives_its_label_only():
    """A file that holds any one of the templates, with other words round it, has that template's label and no other."""
    own, r = licenses.Scanner(), random.Random(2)
    words = lambda n: " ".join(f"v{r.randrange(500)}" for _ in range(n))
    for label, text in licenses.TEMPLATES:
        n, places, spans = own.scan(f"{words(30)} {text} {words(30)}")
        assert {x[0] for x in spans} | {x for _, x in places} == {label}, text
    assert own.scan("a notice of no warranty, provided as is, for any purpose and without any fee " + words(50))[2] == []
