"""Each operator against a plain version of its contract, on small fixtures with nulls, ties, repeats and long texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.llm import exact_dedup, fingerprints, html_text, licenses, line_dedup, mixing, near_dedup, packing, quality, token_counts
from plotweave.llm.near_dedup import Near

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = [say(14) + "." for _ in range(3)]
    out = [None, "", " ", "\n\n", "one", "One two", "ONE TWO", "one two three", "naïve Straße 東京 🎉", "a\x1cb c", "İstanbul ſ K", "<|endoftext|> x <|startoftext|>"]
    for i in range(60):
        lines = [say(r.randint(3, 40)).capitalize() for _ in range(r.randint(1, 5))]
        if i % 3 == 0:
            lines.insert(r.randrange(len(lines) + 1), ("  " if i % 2 else "") + shared[i % 2].upper() + "\t" * (i % 4))
        out.append("\n".join(lines))
    base = out[-1] + " " + say(120)
    for i in range(12):
        words = base.split(" ")
        for _ in range(i // 3):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        out.append(" ".join(words))
    out += [base, base, base + "!", say(9000), "Released under the MIT License. The Apache-license, GENERAL public\nLicense", "mit license mit license"]
    out.append(say(30) + " " + licenses.TEMPLATES[0][1] + " " + say(30))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "c", "a"][i % 5], 7) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


def rows_of(df):
    return {r.doc_id: r.asDict() for r in df.collect()}


def test_mixing(docs):
    got = rows_of(mixing.mix_sources(docs))
    size = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts())}
    source = {i: ["b", "a", None, "c", "a"][i % 5] for i in size}
    names = ["a", "b", "c", None]
    weight = dict(zip(names, (3, 1, 2, 3)))
    total = {s: sum(n for i, n in size.items() if source[i] == s) for s in names}
    target, open_, left = {}, set(names), 1.5 * sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in full} if full else share
        left -= sum(2 * total[s] for s in full)
        open_ = open_ - full if full else set()
    for i, r in got.items():
        assert (r["size"], r["source_size"]) == (size[i], total[source[i]])
        assert r["target"] == pytest.approx(target[source[i]])
        assert 0 <= r["taken"] <= 2 * r["size"]
    for s in names:
        assert abs(sum(r["taken"] for i, r in got.items() if source[i] == s) - target[s]) < 1
    again = rows_of(mixing.mix_sources(docs.repartition(3)))
    assert {i: r["taken"] for i, r in got.items()} == {i: r["taken"] for i, r in again.items()}
    order = [2 if r.position is None else r.position for r in mixing.mix_sources(docs).collect()]
    assert order == sorted(order)
    stream = mixing.training_stream(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in stream} == {i: r["times"] for i, r in got.items() if r["times"]}


def test_mixing_positions_invert_demand(spark):
    """position against numeric integration: the curve's area up to it is the share of all its area; null from 1 on."""
    shares = [i / 97 for i in range(97)] + [0.999999, 1.0, 1.5]
    df = spark.createDataFrame([(c, s) for c in range(3) for s in shares], "curve int, share double")
    got = {(r.curve, r.share): r.at for r in df.select("curve", "share", mixing.position(F.col("curve"), F.col("share")).alias("at")).collect()}
    for curve, knots in enumerate(mixing.Mix().curves):
        steps = np.linspace(0, 1, 200_001)
        weight = np.interp(steps, *zip(*knots))
        area = np.concatenate(([0], np.cumsum((weight[1:] + weight[:-1]) / 2)))
        for s in shares:
            if s >= 1:
                assert got[curve, s] is None
            else:
                assert np.interp(got[curve, s], steps, area / area[-1]) == pytest.approx(s, abs=1e-7)


def test_mixing_takes_more_where_the_curve_is_higher(spark):
    """Of three sources of one size, one rises and one falls: the positions of their documents follow their curves."""
    df = spark.createDataFrame([(i, "w " * 20, "abc"[i % 3]) for i in range(1500)], "doc_id long, text string, source string")
    got = mixing.mix_sources(df).join(df.select("doc_id", "source"), "doc_id").toPandas()
    for source, knots in zip("abc", mixing.Mix().curves):
        own = got[(got["source"] == source) & got["position"].notna()].sort_values("position")
        demand = got[got["source"] == source]["target"].iloc[0]
        taken = 20 * np.arange(len(own))
        steps = np.linspace(0, 1, 2001)
        weight = np.interp(steps, *zip(*knots))
        area = np.concatenate(([0], np.cumsum((weight[1:] + weight[:-1]) / 2)))
        assert np.allclose(np.interp(own["position"], steps, demand * area / area[-1]), taken, atol=1)


@pytest.mark.parametrize("block", [4, 64, 2048])
def test_exact_dedup(docs, block):
    got = rows_of(exact_dedup.exact_dedup(docs, block))
    groups = {}
    for i, t in enumerate(texts()):
        groups.setdefault(t or "", []).append(i)
    for i, t in enumerate(texts()):
        g = groups[t or ""]
        assert got[i] == {"doc_id": i, "keep_id": max(g), "group_size": len(g), "kept": i == max(g), "text_sha256": hashlib.sha256((t or "").encode()).hexdigest()}


def test_fingerprints(docs):
    got, ts = rows_of(fingerprints.fingerprints(docs)), [t or "" for t in texts()]
    assert len(got) == len(ts)
    for i, t in enumerate(ts):
        other = ts[(i + 1) % len(ts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        r = got[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.fingerprint(t.encode())
        assert r["edited_fingerprint"] == fingerprints.fingerprint(edited.encode())
        assert r["near_next"] == fingerprints.likeness(r["fingerprint"], fingerprints.fingerprint(other.encode()))
        assert 0 <= r["near_edited"] <= 1


def test_fingerprint_by_bytes():
    """Signatures against a loop over bytes; edit distance against the usual table."""
    r = random.Random(3)

    def slow(data):
        n, block = len(data), 4
        while block * 64 < n:
            block *= 2

        def h(i):
            x, f = 0, 1
            for k in range(7):
                f = f * 0x01000193 % 2**32
                if i >= k:
                    x += data[i - k] * f
            x = x * 0x9E3779B1 % 2**32
            x ^= x >> 15
            x = x * 0x85EBCA6B % 2**32
            return x ^ x >> 13

        def signature(size):
            out, state, power = "", 0, 1
            for i, b in enumerate(data):
                state = (state + (b + 1) * power) % 2**64
                power = power * fingerprints._BASE % 2**64
                if h(i) % size == size - 1 or i == n - 1:
                    c = state ^ state >> 29
                    out += chr(fingerprints.ALPHABET[c * 0xBF58476D1CE4E5B9 % 2**64 >> 58])
                    state, power = 0, 1
            return out

        ends = sum(h(i) % block == block - 1 for i in range(n))
        if block > 4 and ends < 32:
            block //= 2
        return f"{block}:{signature(block)}:{signature(2 * block)}"

    for n in (1, 6, 7, 50, 300, 3000):
        data = bytes(r.randrange(256) for _ in range(n))
        assert fingerprints.fingerprint(data) == slow(data)
    for _ in range(50):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(1, 20))) for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert fingerprints._common(a, b) == table[-1][-1]


def test_repetitive_texts_keep_halving():
    """Few distinct windows: the block is halved until it gives enough ends, and one character at twice it says nothing."""
    r, halvings, marks = random.Random(11), [], []
    for k in (2, 5, 9, 20, 40) * 6:
        phrase = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(k)) + ". "
        data = (phrase * (14000 // len(phrase) + 1)).encode()
        h = fingerprints._rolling(np.frombuffer(data, np.uint8)).tolist()
        ends = lambda size: sum(x % size == size - 1 for x in h)
        first = block = 4
        while block * 64 < len(data):
            first = block = block * 2
        while block > 4 and ends(block) < 32:
            block //= 2
        size, one, two = fingerprints.fingerprint(data).split(":")
        last = lambda s: h[-1] % s != s - 1
        assert (int(size), len(one), len(two)) == (block, ends(block) + last(block), ends(2 * block) + last(2 * block))
        halvings.append((first // block).bit_length() - 1)
        marks.append((size, one, two))
    assert max(halvings) > 2
    for size, one, two in marks:
        for _, other, _ in marks:
            if int(size) > 8 and len(two) < 4 and one != other and set(one).isdisjoint(other):
                assert fingerprints.likeness(f"{size}:{one}:{two}", f"{size}:{other}:{two}") == 0


def test_likeness_tells_edits_from_others():
    r = random.Random(9)
    say = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n)).encode()
    for n in (400, 2000, 9000):
        a, b = say(n), say(n)
        edited = a[: n // 2] + b[: n // 2]
        f = fingerprints.fingerprint
        assert fingerprints.likeness(f(a), f(a)) == 1
        assert fingerprints.likeness(f(a), f(edited)) > 0.3 > fingerprints.likeness(f(a), f(b))


def test_near_dedup(docs):
    for near in (Near(3, 85, 32, 5), Near()):
        got, sets = rows_of(near_dedup.near_dedup(docs, near)), []
        for t in texts():
            w = WORD.findall(lower(t or ""))
            k = min(near.words, len(w))
            sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
        root = list(range(len(sets)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= near.percent * len(a | sets[j]):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
        for i, s in enumerate(sets):
            assert got[i] == {"doc_id": i, "n_shingles": len(s), "component_id": find(i), "kept": find(i) == i}


def test_near_dedup_finds_chains(spark):
    """A chain of small edits, where only neighbours are alike, and a centre with many copies that differ from each other."""
    r = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    chain = [" ".join(words)]
    for i in range(30):
        words[6 * i : 6 * i + 3] = [f"x{i}a", f"x{i}b", f"x{i}c"]
        chain.append(" ".join(words))
    centre = [f"c{i}" for i in range(150)]
    star = [" ".join(centre)]
    for i in range(60):
        own = list(centre)
        for k in r.sample(range(150), 3):
            own[k] = f"y{i}-{k}"
        star.append(" ".join(own))
    rows = [(i, t) for i, t in enumerate(chain + star)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(near_dedup.near_dedup(df, Near(3, 85, 32, 5)))
    sets = [set(zip(t.split(), t.split()[1:], t.split()[2:])) for _, t in rows]
    like = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if like(a, b):
                    root[i] = root[j] = min(root[i], root[j])
    assert [got[i]["component_id"] for i in range(len(rows))] == root


@pytest.mark.parametrize("gap", [1, 8])
def test_packing(docs, gap):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(token_counts.path_of(packing.TOKENIZER))
    pieces = packing.pack_documents(docs, least_gap=gap).collect()
    ids = {i: own.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts())}
    sequences, parts = {}, {}
    for p in pieces:
        assert p.doc_tokens == len(ids[p.doc_id]) and p.length > 0
        raw = b"".join(x.to_bytes(4, "little") for x in ids[p.doc_id][p.start : p.start + p.length])
        assert bytes(p.ids) == raw and len(raw) == 4 * p.length
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        parts.setdefault(p.doc_id, []).append((p.start, p.length))
    for i, x in ids.items():
        at = 0
        for start, n in sorted(parts[i]):
            assert start == at
            at += n
        assert at == len(x)
    total = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
        total += 0 if at & (at - 1) == 0 else 2048 - at  # sequences of a power of two aren't padded
    assert total <= (gap - 1) * len(sequences)


def test_best_fit_takes_the_tightest_window():
    r = random.Random(2)
    lengths = [r.randint(1, 60) for _ in range(300)]
    rooms, slow = packing.Rooms(64), {}
    for n in lengths:
        got = rooms.take(n)
        fits = [room for room, held in slow.items() if room >= n and held]
        assert (got is None) == (not fits)
        if got:
            assert got[0] == min(fits)
            slow[got[0]].remove(got[1])
        room = (got[0] if got else 64) - n
        if room:
            rooms.put(room, id(n))
            slow.setdefault(room, []).append(id(n))


def test_licenses(docs):
    got = rows_of(licenses.scan_licenses(docs))
    for i, t in enumerate(texts()):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
        places = [(k, label) for k in range(len(w)) for phrase, label in licenses.PHRASES.items() if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert {x for _, x in places} <= set(r["labels"].split(",")) - {""}
        assert 0 <= r["score"] <= 1
    last = got[len(texts()) - 1]
    assert last["labels"] == "mit" and last["base_labels"] == "" and last["spans"][0]["covered"] == 1 and last["spans"][0]["start"] == 30


def test_matching_statistics():
    r = random.Random(4)
    for _ in range(30):
        sequences = [[r.randrange(4) for _ in range(r.randint(1, 12))] for _ in range(3)]
        own = licenses.Automaton(sequences)
        text = [r.randrange(5) for _ in range(40)]
        inside = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i, len(s) + 1)}
        for end, (state, n) in enumerate(own.statistics(text), 1):
            assert n == max(k for k in range(end + 1) if tuple(text[end - k : end]) in inside)
            run = text[end - n : end]
            ends = {(s, e) for s, q in enumerate(sequences) for e in range(n, len(q) + 1) if q[e - n : e] == run}
            assert not n or own.ends[state] == ends
            whole = {s for s, q in enumerate(sequences) if len(q) <= n and text[end - len(q) : end] == q}
            assert {s for s, size in own.whole[state] if size <= n} == whole


def kept_lines(ts, gone=()):
    rows = {i: (t or "").split("\n") for i, t in enumerate(ts) if i not in gone}
    key = lambda x: lower(x.strip(SPACE))
    holders = {}
    for i, lines in rows.items():
        for k in {key(x) for x in lines if len(key(x)) >= 40}:
            holders.setdefault(k, set()).add(i)
    drop = lambda i, x: len(holders.get(key(x), ())) >= 5 and i != max(holders[key(x)])
    return {i: [x for x in lines if not drop(i, x)] for i, lines in rows.items()}


def test_line_dedup(docs):
    got, want = rows_of(line_dedup.dedup_lines(docs)), kept_lines(texts())
    for i, t in enumerate(texts()):
        n = len((t or "").split("\n"))
        assert got[i] == {"doc_id": i, "n_lines": n, "n_dropped": n - len(want[i]), "text": "\n".join(want[i])}
    assert sum(r["n_dropped"] for r in got.values()) > 5


def test_line_store_forgets(docs):
    """Deleting documents gives what the others alone would have given, and filters have no trace of rare keys."""
    store = line_dedup.LineStore(docs.sparkSession).insert(docs.where("doc_id < 50")).insert(docs.where("doc_id >= 50"))
    gone = [r.doc_id for r in docs.select("doc_id").collect() if r.doc_id % 4 == 0]
    held = store.postings.where("doc_id % 4 <> 0")
    store.delete(docs.where("doc_id % 4 = 0"))
    got, want = {}, kept_lines(texts(), gone)
    for r in store.dropped().collect():
        got.setdefault(r.doc_id, set()).add((r.a, r.b))
    assert set(got) == {i for i, x in want.items() if len(x) < len((texts()[i] or "").split("\n"))}
    fresh = line_dedup.LineStore(docs.sparkSession).insert(docs.where("doc_id % 4 <> 0"))
    assert sorted(map(tuple, store.counts.collect())) == sorted(map(tuple, fresh.counts.collect()))
    assert store.postings.count() == held.count()
    for r in store.filters.collect():
        own = line_dedup.CuckooFilter(data=r.filter)
        assert (own.table != 0).sum() == store.counts.where(line_dedup._shard(store.bits) == r.shard).count()


def test_line_keys_are_two_hashes(spark):
    """The second hash isn't a function of the first one, and both are what the cutting of lines computes."""
    import xxhash

    lines = [f"line {i} of a text that is long enough to have a key" for i in range(50)]
    rows = spark.createDataFrame([("\n".join(lines),)], "text string").select(F.explode(line_dedup.line_keys(F.col("text"), 40)).alias("k")).select("k.*").collect()
    assert [(r.a % 2**64, r.b % 2**64) for r in rows] == [line_dedup._key_of(x.encode()) for x in lines]
    assert all(r.b % 2**64 not in (xxhash.xxh64_intdigest(x, r.a % 2**64) for x in (b"b", (1).to_bytes(4, "little"))) for r in rows)


def test_line_dedup_of_repeated_ids(spark):
    """Each row is a document, in the operator as in its SQL; rows of one doc_id have their own texts."""
    import duckdb
    import pyarrow as pa

    shared = "this line is in many documents and has a key"
    lines = [shared, f"{shared}\none", f"two\n{shared}", shared, f"{shared}\n{shared}\nend"]
    for ids, dropped in (([1, 1, 1, 1, 2], 4), ([None] * 5, 0), ([None, None, 3, 3, None], 4)):
        df = spark.createDataFrame(list(zip(ids, lines)), "doc_id long, text string")
        got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in line_dedup.dedup_lines(df).collect()]
        con = duckdb.connect()
        con.register("documents", pa.table({"doc_id": pa.array(ids, pa.int64()), "text": lines}))
        want = con.sql(line_dedup.OP8_SQL).fetchall()
        assert sorted(got, key=str) == sorted(want, key=str) and sum(r[2] for r in got) == dropped


def test_line_dedup_in_waves(docs, monkeypatch):
    """Where not all filters may be sent at once, they are in several waves, with the same result."""
    want = rows_of(line_dedup.dedup_lines(docs))
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 1)
    assert len(list(line_dedup.LineStore(docs.sparkSession).insert(docs)._waves())) > 1
    assert rows_of(line_dedup.dedup_lines(docs)) == want


@pytest.fixture
def line_store(spark):
    line = lambda k: f"line {k} of many that are long enough for a key"
    rows = [(i, "\n".join(line(k) for k in range(60) if (i * k) % 7 < 3)) for i in range(40)]
    return line_dedup.LineStore(spark).insert(spark.createDataFrame(rows, "doc_id long, text string")), rows, line


def _state(store):
    return sorted(map(tuple, store.counts.collect())), sorted(map(tuple, store.dropped().collect()))


def _shards_written(store, g):
    import os

    return {int(x.split("=")[1]) for x in os.listdir(f"{store.scratch.path}/counts{g}") if x.startswith("shard=")}


def test_line_store_writes_touched_shards_only(spark, line_store):
    """An insertion and a deletion of one line write its shard only, and give what one insertion of all would have given."""
    store, rows, line = line_store
    more = [(1000, line(3))]
    before = dict(store.held)
    store.insert(spark.createDataFrame(more, "doc_id long, text string"))
    assert len(_shards_written(store, 2)) == 1 < len(before)
    assert sum(g == 2 for g in store.held.values()) == 1
    assert _state(store) == _state(line_dedup.LineStore(spark).insert(spark.createDataFrame(rows + more, "doc_id long, text string")))
    store.delete(spark.createDataFrame([(1000,), (4711,)], "doc_id long"))
    assert len(_shards_written(store, 3)) == 1
    assert _state(store) == _state(line_dedup.LineStore(spark).insert(spark.createDataFrame(rows, "doc_id long, text string")))
    store.insert(spark.createDataFrame(more, "doc_id long, text string"))  # a doc_id that was deleted may come again
    assert _state(store) == _state(line_dedup.LineStore(spark).insert(spark.createDataFrame(rows + more, "doc_id long, text string")))


def test_line_store_grows_and_compacts(spark, line_store, monkeypatch):
    """More keys make more shards, and many changes end in one generation, with the same state."""
    store, rows, line = line_store
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    monkeypatch.setattr(line_dedup, "GENERATIONS", 3)
    for i in range(5):
        more = [(2000 + i, line(3 + i)), (3000 + i, line(100 + i))]
        store.insert(spark.createDataFrame(more, "doc_id long, text string"))
        rows = rows + more
    assert store.bits > 3 and len(set(store.held.values())) <= 4
    assert _state(store) == _state(line_dedup.LineStore(spark).insert(spark.createDataFrame(rows, "doc_id long, text string")))


def test_failed_change_leaves_the_store(spark, line_store, monkeypatch):
    store, rows, line = line_store
    want = _state(store)
    with monkeypatch.context() as m:
        m.setattr(line_dedup.LineStore, "_write", lambda *a: 1 / 0)
        for change in (lambda: store.insert(spark.createDataFrame([(7000, line(1))], "doc_id long, text string")), lambda: store.delete(spark.createDataFrame([(3,)], "doc_id long"))):
            with pytest.raises(ZeroDivisionError):
                change()
    assert _state(store) == want
    store.delete(spark.createDataFrame([(3,)], "doc_id long"))
    assert _state(store) == _state(line_dedup.LineStore(spark).insert(spark.createDataFrame([r for r in rows if r[0] != 3], "doc_id long, text string")))


def test_line_dedup_of_equal_rows(spark):
    """Hundreds of equal rows lose their lines, rows that lose none stay as they are."""
    shared = "this line is in many documents and has a key"
    rows = [(1, f"{shared}\nx")] * 300 + [(2, shared)] + [(10 + i, f"line {i}") for i in range(40)]
    got = sorted((r.doc_id, r.text, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == sorted([(1, "x", 1)] * 300 + [(2, shared, 0)] + [(10 + i, f"line {i}", 0) for i in range(40)])


def test_cuckoo_filter():
    import numpy as np

    r = np.random.default_rng(1)
    a, b = (r.integers(-(2**63), 2**63, 5000) for _ in "ab")
    own = line_dedup.CuckooFilter.of(a, b)
    assert own.contains(a, b).all()
    assert own.contains(*(r.integers(-(2**63), 2**63, 20000) for _ in "ab")).mean() < 0.01
    own.delete(a[:2500], b[:2500])
    assert own.contains(a[2500:], b[2500:]).all() and own.contains(a[:2500], b[:2500]).mean() < 0.02


def test_token_counts(docs, tmp_path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(token_counts.path_of("byte_bpe_50k.json"))
    want = {i: (len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts())}
    cache = f"{tmp_path}/cache"
    first = rows_of(token_counts.count_tokens(docs.where("doc_id < 60"), cache=cache))
    held = docs.sparkSession.read.parquet(cache).count()
    both = rows_of(token_counts.count_tokens(docs, cache=cache))
    for got in (first, both):
        assert {i: (r["n_bytes"], r["n_tokens"]) for i, r in got.items()} == {i: want[i] for i in got}
    stored = docs.sparkSession.read.parquet(cache)
    assert stored.count() == len({t or "" for t in texts()}) > held == stored.select("content").distinct().count() - (stored.count() - held)
    docs.sparkSession.read.parquet(cache).write.parquet(f"{tmp_path}/copy")
    docs.sparkSession.read.parquet(f"{tmp_path}/copy").write.mode("append").parquet(cache)  # as two runs at once leave it
    assert token_counts.count_tokens(docs, cache=cache).count() == len(texts()) and rows_of(token_counts.count_tokens(docs, cache=cache)) == both
    other = rows_of(token_counts.count_tokens(docs, "piece_bpe_32k.model", cache))
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.path_of("piece_bpe_32k.model"))
    assert all(other[i]["n_tokens"] == len(sp.encode(t or "")) for i, t in enumerate(texts()))


def test_second_run_encodes_nothing(spark, docs, monkeypatch):
    """The cache of all runs lies in the shared folder: the second run reads what the first has stored."""
    first = rows_of(token_counts.count_tokens(docs))

    def encode(name):
        def fail(batches):
            for batch in batches:
                assert not batch.num_rows
                yield from ()

        return fail

    monkeypatch.setattr(token_counts, "_encode", encode)
    assert rows_of(token_counts.count_tokens(docs)) == first


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_fast_encoders_equal_the_library(name):
    """All characters that the fast ways take, alone and in words, beside strings of them drawn at random."""
    from tokenizers import Tokenizer

    own, r = Tokenizer.from_file(token_counts.path_of(name)), random.Random(7)
    every = [chr(c) for c in range(0x250)]
    samples = [*every, *(a + b for a in "a1 '-\n" for b in every), *(b + "'s" + b for b in every)]
    samples += ["".join(r.choice(every) if r.random() < 0.2 else r.choice("aeioutnshr  '.,-1\n") for _ in range(r.randint(1, 60))) for _ in range(1500)]
    samples += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 25))) for _ in range(3000)]
    want = [e.ids for e in own.encode_batch(samples, add_special_tokens=False)]
    if name.startswith("byte"):
        assert [token_counts.counter(name)(s) for s in samples] == [len(x) for x in want]
    else:
        assert [packing.encoder(name)(s).tolist() for s in samples] == want


def test_quality_learns_and_never_sees_held_out(spark):
    r = random.Random(6)
    say = lambda n: " ".join("".join(r.choice("aeioutnshr") for _ in range(r.randint(2, 8))) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        good = i % 4 > 0
        text = say(r.randint(5, 120))
        rows.append((i, text if good else re.sub(" ", r.choice([" ### ", "!! ", " | "]), text).upper()))
        held = zlib.crc32(str(i).encode()) % 5 == 0
        labels.append((i, int(good) if not held else int(not good)))  # held-out labels are wrong and must not matter
    docs = spark.createDataFrame(rows + [(400, None), (401, "")], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {x.doc_id: x for x in quality.score_quality(docs, model).select("*", quality.held_out().alias("held_out")).collect()}
    right = [(got[i].score >= 0.3) == (i % 4 > 0) for i in range(400) if got[i].held_out]
    assert sum(right) / len(right) > 0.95
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert got[400].score == got[401].score and 0 <= got[400].score <= 1


def test_quality_gradients():
    import numpy as np

    r = np.random.default_rng(0)
    x, starts, target = r.standard_normal((9, quality.FEATURES)).astype(np.float64), np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0])
    p = {"E": r.standard_normal((quality.FEATURES, 4)) * 0.1, "e": r.standard_normal(4), "V": r.standard_normal((4, 3)), "U": r.standard_normal((4, 3)), "w": r.standard_normal(3), "c": r.standard_normal(4), "b": np.float64(0.1)}
    model = quality.Model(p, np.zeros(quality.FEATURES), np.ones(quality.FEATURES))

    def loss():
        y = model.forward(x, starts)[0]
        return -(target * np.log(y) + (1 - target) * np.log(1 - y)).mean()

    y, kept = model.forward(x, starts)
    for k, g in model.gradients(y, target, kept, starts).items():
        at = (0,) * np.ndim(p[k])
        old = p[k]
        up, down = np.array(old, float), np.array(old, float)
        up[at] += 1e-5
        down[at] -= 1e-5
        p[k] = up
        high = loss()
        p[k] = down
        low = loss()
        p[k] = old
        assert (high - low) / 2e-5 == pytest.approx(np.asarray(g)[at], rel=1e-3, abs=1e-7)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="masthead"><a href="/">Site name</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy now</div><div class="layout"><article><h1>Head&amp;line</h1><p>First  para<b>graph</b> of text,
with &lt;tags&gt; and more words to read here.<br>After a break.<p>Second paragraph, unclosed, with a <a href="#">link</a> in it.
<ul><li>point one is long enough</li><li>point two as well</li></ul></article><aside class="sidebar"><h3>Related</h3><ul><li><a>x</a></li><li><a>y</a></li></ul></aside></div>
<form><label>Mail</label><input><button>Go</button></form><section id="comments"><h2>Comments</h2><div class="comment"><b>Bob</b><p>Nice one!</p></div></section>
<!-- hidden --><footer>&copy; 2024 Legal</footer></body></html>"""


def test_html_text(spark):
    want = "Head&line\nFirst paragraph of text, with <tags> and more words to read here. After a break.\nSecond paragraph, unclosed, with a link in it.\npoint one is long enough\npoint two as well"
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", PAGE), (5, "x", "<p>open <b>never closed " * 500), (6, "y", "<<<>>< a='\" <!-- x")]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r.url: r for r in got}
    assert by["u"].text == by["w"].text == want and by["u"].n_chars == len(want)
    assert by[None].text == by["v"].text == "" and len(got) == len(rows)


def test_html_decode_keeps_no_child_of_a_dropped_node():
    maker, trees = html_text._Pages(77), html_text.model()
    for _ in range(30):
        nodes = html_text.parse(maker.page().replace(" k=1", ""))
        kept = html_text.decode(nodes, trees.log_odds(html_text.features([nodes])))
        assert all(kept[n.parent] for n, k in zip(nodes[1:], kept[1:]) if k)


def test_html_held_out_pages():
    maker, trees, right = html_text._Pages(123), html_text.model(), []
    for _ in range(120):
        page = maker.page()
        marks = [True] + [bool(m[2]) for m in re.finditer(r"<([a-z][a-z0-9]*)[^>]*?( k=1)?>", page.partition("</head>")[2]) if m[1] not in html_text.VOID]
        nodes = html_text.parse(page.replace(" k=1", ""))
        right.append(html_text.blocks(nodes, html_text.decode(nodes, trees.log_odds(html_text.features([nodes])))) == html_text.blocks(nodes, marks))
    assert sum(right) / len(right) > 0.9


@pytest.mark.parametrize("local", [0, 3, 10**6])
def test_components(spark, local):
    from plotweave.llm.components import components
    from plotweave.llm.scratch import Scratch

    r = random.Random(8)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    root = {x: x for link in links for x in link if link[0] != link[1]}
    for _ in links:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(links, "x long, y long"), Scratch(spark, "t"), "c", local)
    assert {r.id: r.root for r in got.collect()} == root
