"""More of the query catalogue: lookups, sheets, samples, and the model-backed chain with rules in place of models."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..functions import columns as fc
from ..operators import chains as ch
from ..operators import clusters as cl
from ..operators import documents as doc
from ..operators import enrichment as en
from ..operators import evaluation as ev
from ..operators import models as mo
from ..operators import plugs
from ..operators import quality as qu
from ..operators import sampling as sa
from ..operators import svo as sv
from ..operators import terms as te
from ..sources import corpus as co
from ..sources.tables import shared_folder
from .catalogue import BINS, CONTENT, EVENTS, LINES, LINKS, ORACLES, PAIRS, _events, _iterations, _pairs, _posts, _roles, _sentences, _texts, _with_centers, query, r6
from .views import CENTERS, MENTIONS, PLACED, VOTES, mentions, placed, points, read


def md5(*parts: str) -> str:
    """The lot that sampling.lot gives, in SQL."""
    return "md5(" + " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


# Sources and lookups


@query("SELECT d.doc_id, d.source AS headline, d.n_chars AS text, l.quality AS label FROM documents d JOIN labels l USING (doc_id) WHERE d.source IS NOT NULL")
def slot_join(spark, sf):
    d = read(spark, sf, "documents")
    headlines, texts = d.where("source IS NOT NULL").select("doc_id", F.col("source").alias("headline")), d.select("doc_id", F.col("n_chars").alias("text"))
    return co.join_slots(headlines, texts, read(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))).select("doc_id", "headline", "text", "label")


@query(f"WITH {LINES}, s AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS sent_id, text FROM lines) SELECT sent_id, text FROM s WHERE sent_id IN (SELECT 7 * event_id FROM events)")
def line_lookup(spark, sf):
    wanted = read(spark, sf, "events").select((7 * F.col("event_id")).alias("sent_id")).distinct()
    return co.lines_by_number(doc.number_sentences(_sentences(spark, sf)), wanted).select("sent_id", "text")


@query("SELECT c.conv_id, c.turn, d.doc_id, d.n_chars FROM conversations c JOIN documents d ON CAST(d.doc_id AS VARCHAR) = split_part('site-' || CAST(c.conv_id AS VARCHAR) || '-' || CAST(c.turn AS VARCHAR), '-', 2)")
def article_lookup(spark, sf):
    said = read(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws("-", F.lit("site"), "conv_id", "turn").alias("line_doc"))
    d = read(spark, sf, "documents").select("doc_id", "n_chars", F.col("doc_id").cast("string").alias("key"))
    return said.withColumn("key", co.article_key("line_doc")).join(d, "key").select("conv_id", "turn", "doc_id", "n_chars")


@query("""SELECT cluster, '{"cluster":"' || CAST(cluster AS VARCHAR) || '","theme":"theme ' || CAST(n AS VARCHAR) || '"}' AS json FROM (SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY 1) WHERE n % 2 = 0""")
def themes_json(spark, sf):
    n = points(spark, sf).groupBy("cluster").agg(F.count("*").alias("n"))
    return co.themes_json(n.select("cluster", (F.col("n") % 2 == 0).alias("framing_pattern_detected"), F.concat(F.lit("theme "), F.col("n").cast("string")).alias("theme")))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d') || ' 00:00:00' END AS ts FROM events")
def event_time(spark, sf):
    """Times written in three formats and one that is none, read again."""
    e, ts = read(spark, sf, "events"), F.col("ts").cast("timestamp")
    written = F.element_at(F.array(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(ts, "MM/dd/yyyy"), F.lit("some day")), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", F.date_format(fc.event_time(written), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query(f"WITH {EVENTS} SELECT doc_id, CAST(count(*) AS INTEGER) AS n_events FROM ev GROUP BY 1")
def event_count(spark, sf):
    by_sentence = _events(spark, sf).groupBy("doc_id", "sent_id").agg(F.collect_list("event_id").alias("events"))
    sentences = by_sentence.groupBy("doc_id").agg(F.collect_list(F.struct("events")).alias("sentences"))
    return sentences.select("doc_id", fc.event_count("sentences").alias("n_events"))


@query(f"WITH {PAIRS} SELECT (SELECT count(DISTINCT doc_id) FROM m) AS documents, count(DISTINCT doc_id) AS with_pairs, count(*) AS pairs, round(count(*) / count(DISTINCT doc_id), 6) AS mean_pairs FROM pairs")
def corpus_totals(spark, sf):
    docs = mentions(spark, sf).select("doc_id").distinct()
    return doc.pair_totals(docs, _pairs(spark, sf)).select("documents", "with_pairs", "pairs", r6("mean_pairs"))


@query(f"WITH {BINS} SELECT count(*) AS documents, CAST(sum(n_events) AS BIGINT) AS events, CAST(sum(n_events * (n_events - 1) // 2) AS BIGINT) AS possible_pairs FROM bins")
def sample_totals(spark, sf):
    return sa.sample_totals(_posts(spark, sf))


# Stores and files: written to the shared folder and read again


def _path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {LINKS} SELECT i, j FROM links")
def edge_store(spark, sf):
    """Edges added in both directions, in two batches."""
    store, edges = co.EdgeStore(spark, _path(spark, "edges")), ch.cannot_links(_roles(spark, sf))
    store.add(edges.select(F.col("j").alias("i"), F.col("i").alias("j")))
    store.add(edges.where("i % 3 = 0"))
    return store.edges()


@query(f"WITH {LINKS}, b AS (SELECT i AS node, j AS o FROM links UNION ALL SELECT j, i FROM links) SELECT node, CAST(count(*) AS INTEGER) AS degree, min(o) AS first FROM b WHERE node % 2 = 0 GROUP BY 1")
def neighbour_store(spark, sf):
    """Neighbours merged from two halves of each node's edges, for the even nodes."""
    store = co.AdjacencyStore(spark, _path(spark, "neighbours"))
    edges = ch.cannot_links(_roles(spark, sf))
    both = edges.unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j")))
    for half in (0, 1):
        store.merge(both.where(F.col("j") % 2 == half).select(F.col("i").alias("node"), F.array("j").alias("neighbours")))
    got = store.get(ch.link_summary(_roles(spark, sf)).where("node % 2 = 0").select("node"))
    return got.select("node", F.size("neighbours").alias("degree"), F.get("neighbours", F.lit(0)).alias("first"))


@query("SELECT CAST(quality AS INTEGER) AS annotator1, CAST(toxic AS INTEGER) AS annotator2, count(*) AS n FROM labels GROUP BY 1, 2")
def ratings_sheet(spark, sf):
    path = _path(spark, "ratings")
    co.write_sheet(read(spark, sf, "labels").select("quality", "toxic"), path, header=False)
    return co.read_ratings(spark, path, "INT").groupBy("annotator1", "annotator2").agg(F.count("*").alias("n"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, length(text) AS n_chars, md5(text) AS digest, source AS label FROM documents WHERE text IS NOT NULL")
def json_corpus(spark, sf):
    """Documents written as JSON objects of some 500 members each and read again, by splits of the files."""
    path, d = _path(spark, "json"), read(spark, sf, "documents").where("text IS NOT NULL")
    article = F.to_json(F.struct("text", F.col("source").alias("label")))
    member = F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit('": '), article)
    objects = d.groupBy(F.floor(F.col("doc_id") / 500)).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(member), ", "), F.lit("}")).alias("value"))
    objects.select("value").write.text(path)
    return co.read_json_corpus(spark, path).select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"), "label")


@query("SELECT 'line ' || CAST(doc_id AS VARCHAR) AS text, count(*) OVER () AS lines FROM documents")
def line_file(spark, sf):
    """Lines with white space round them and blank ones between, read and numbered without gaps."""
    path, text = _path(spark, "lines"), F.concat(F.lit("  line "), F.col("doc_id").cast("string"), F.lit(" \n\n "))
    read(spark, sf, "documents").select(text.alias("value")).write.text(path)
    lines = co.read_lines(spark, path)
    last = lines.agg((F.max("sent_id") + 1).alias("lines"))
    return lines.crossJoin(F.broadcast(last)).select("text", "lines")  # one row


@query(f"WITH {LINES}, s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS sent_id FROM lines) SELECT doc_id, CAST(count(*) AS INTEGER) AS n, min(sent_id) AS first, max(sent_id) AS last FROM s GROUP BY 1")
def sentence_sink(spark, sf):
    path = _path(spark, "sentences")
    co.write_sentences(doc.number_sentences(_sentences(spark, sf)), path)
    ids = spark.read.parquet(f"{path}/doc_sentences")
    return ids.select("doc_id", F.size("sent_ids").alias("n"), F.get("sent_ids", F.lit(0)).alias("first"), F.element_at("sent_ids", -1).alias("last"))


@query(f"SELECT n, CASE WHEN abs(z) > 3.290527 THEN 'p<.001' WHEN abs(z) > 2.575829 THEN 'p<.01' WHEN abs(z) > 1.959964 THEN 'p<.05' ELSE 'n.s.' END AS band FROM ({ORACLES['cohens_kappa']})")
def kappa_band(spark, sf):
    return qu.cohens_kappa(read(spark, sf, "labels"), "quality", "toxic").select("n", "band")


# Events, phrases, terms


@query(f"WITH m AS ({MENTIONS}) SELECT p.position AS phrase_id, count(*) AS n, min(e.position) AS first_event FROM m p JOIN m e ON e.doc_id = p.doc_id AND split_part(e.verb_sense, '_', 1) = split_part(p.verb_sense, '_', 1) AND e.obj_head = p.obj_head WHERE p.position % 10 = 0 GROUP BY 1")
def phrase_events(spark, sf):
    m = mentions(spark, sf)
    phrases = m.where("position % 10 = 0").select("doc_id", F.col("position").alias("phrase_id"), F.array(F.lit("of"), "obj_head", fc.verb_stem("verb_sense")).alias("lemmas"))
    found = doc.phrase_events(phrases, m.select("doc_id", "position", "verb_sense", "obj_head"))
    return found.groupBy("phrase_id").agg(F.count("*").alias("n"), F.min("position").alias("first_event"))


@query(f"SELECT split_part(verb_sense, '_', 1) AS verb, obj_head AS lemma, round(sum(value / 100), 6) AS weight FROM ({MENTIONS}) GROUP BY 1, 2")
def expansion_sums(spark, sf):
    m = mentions(spark, sf).select(fc.verb_stem("verb_sense").alias("verb"), F.array(F.struct(F.col("obj_head").alias("tok"), (F.col("value") / 100).alias("p"))).alias("x"))
    return te.expansion_sums(m, "verb", "x").select("verb", "lemma", r6("weight"))


@query(f"SELECT position AS svo_id, CASE WHEN k % 7 > 0 THEN obj_head END AS obj_head, CASE WHEN k % 7 > 0 THEN CAST(position % 9 + 1 AS INTEGER) END AS obj_head_index FROM ({MENTIONS})")
def object_heads(spark, sf):
    """Heads of objects of two words; every seventh object has two spaces, so that its parse can't be matched."""
    at = (F.col("position") % 9).cast("int")
    text = F.concat(F.lit("the"), F.when(F.col("k") % 7 > 0, " ").otherwise("  "), F.col("obj_head"))
    m = mentions(spark, sf).select("position", "k", "obj_head", F.struct(text.alias("text"), F.array(at, at + 1).alias("idx")).alias("obj"))
    heads = m.select(F.concat(F.lit("the "), "obj_head").alias("text"), F.col("obj_head").alias("lemma"), F.lit(1).alias("at")).distinct()
    return sv.object_heads(m.select(F.col("position").alias("svo_id"), "obj"), heads).select("svo_id", "obj_head", "obj_head_index")


@query("SELECT vec_id AS id, CAST(2 * len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: 3 * x)), 6) AS total FROM embeddings")
def joined_vectors(spark, sf):
    v = points(spark, sf).withColumn("double", F.transform("vector", lambda x: 2 * x)).select("id", te.joined_vectors("vector", "double").alias("v"))
    return v.select("id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"""WITH w AS (SELECT doc_id, obj_head, sum(value) / 1000 AS p FROM ({MENTIONS}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, obj_head) AS r FROM w)
SELECT doc_id, string_agg(obj_head, ' ' ORDER BY r) AS tokens FROM r WHERE r <= 5 GROUP BY 1""")
def top_tokens(spark, sf):
    """Values are doubles, and where two exact sums are equal the order of additions decides. They are added in the order of events,
    as SQL does that reads the table once from its start; so sums don't depend on partitions."""
    m = mentions(spark, sf).select("doc_id", F.col("obj_head").alias("tok"), "position", "value")
    w = te.summed(m, ["doc_id", "tok"], "value", "position").withColumn("p", F.col("total") / 1000)
    rows = w.groupBy("doc_id").agg(F.collect_list(F.struct("tok", "p")).alias("x"))
    return rows.select("doc_id", F.array_join(F.transform(fc.top_tokens("x", 5), lambda t: t["tok"]), " ").alias("tokens"))


SENSES = "sn AS (SELECT event_type AS lemma, s AS sense_id, ['o' || CAST(s AS VARCHAR), 'o' || CAST(s + 1 AS VARCHAR), 'o0', 'o5'] AS ranking FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'error'), range(3) t(s) WHERE event_type <> 'view' OR s = 0)"


@query(f"""WITH {SENSES}, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT event_id, event_type AS lemma, k, ['o' || CAST(k % 7 AS VARCHAR), 'o5', 'o' || CAST(k % 3 AS VARCHAR) || 'x'] AS ranking FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)),
x AS (SELECT m.event_id, m.lemma, sense_id, CASE WHEN sense_id = 2 THEN 0 ELSE list_cosine_similarity(a.v, b.v) * list_sum(list_transform(range(1, 4), lambda d: len(list_intersect(m.ranking[1:d], sn.ranking[1:d])) / d)) / 3 END AS score, m.event_id % 11 = 0 AS none
  FROM m LEFT JOIN sn USING (lemma) LEFT JOIN v a ON a.vec_id = m.event_id % 200 LEFT JOIN v b ON b.vec_id = 10 * sense_id),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(score, 12) DESC, sense_id) AS r, count(sense_id) OVER (PARTITION BY event_id) AS n FROM x)
SELECT event_id AS mention_id, CAST(CASE WHEN none THEN -2 WHEN n = 0 THEN -1 WHEN n = 1 THEN 0 ELSE sense_id END AS INTEGER) AS sense FROM r WHERE r = 1""")
def verb_senses(spark, sf):
    """Verbs of no, one and three senses, of which one has no vector; every eleventh mention has none."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = read(spark, sf, "events").select("event_id", F.col("event_type").alias("lemma"), k.alias("k"))
    v = points(spark, sf).select(F.col("id").alias("vec_id"), "vector")
    o = lambda c: F.concat(F.lit("o"), c.cast("string"))
    m = e.withColumn("vec_id", F.col("event_id") % 200).join(v, "vec_id", "left")
    m = m.select(F.col("event_id").alias("mention_id"), "lemma", F.when(F.col("event_id") % 11 != 0, F.col("vector")).alias("vector"), F.array(o(F.col("k") % 7), F.lit("o5"), F.concat(o(F.col("k") % 3), F.lit("x"))).alias("ranking"))
    s = e.where("lemma <> 'error'").select("lemma").distinct().withColumn("sense_id", F.explode(F.array(*map(F.lit, range(3))))).where("lemma <> 'view' OR sense_id = 0")
    s = s.withColumn("vec_id", (10 * F.col("sense_id")).cast("long")).join(v, "vec_id").select("lemma", "sense_id", F.when(F.col("sense_id") < 2, F.col("vector")).alias("vector"), F.array(o(F.col("sense_id")), o(F.col("sense_id") + 1), F.lit("o0"), F.lit("o5")).alias("ranking"))
    return te.disambiguate(m, s).select("mention_id", "sense")


# Chains and clusters


MERGED = f"""ch AS (SELECT event_id // 4 AS chain_id, event_id AS pos, CASE event_type WHEN 'click' THEN 'Refugees' WHEN 'view' THEN 'Immigrants' WHEN 'error' THEN 'Workers' WHEN 'signup' THEN 'Other' ELSE 'Gun Right Advocates' END AS grp,
  CASE k % 4 WHEN 0 THEN 'Hero' WHEN 1 THEN 'Victim' WHEN 2 THEN 'Threat' ELSE 'Neutral' END AS role FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)),
vt AS (SELECT chain_id, grp, role, p, row_number() OVER (PARTITION BY chain_id, grp ORDER BY n DESC, role) AS rn, min(p) OVER (PARTITION BY chain_id, grp) AS first_pos
  FROM (SELECT chain_id, grp, role, count(*) AS n, min(pos) AS p FROM ch WHERE role <> 'Neutral' AND grp <> 'Other' GROUP BY ALL)),
mg AS (SELECT chain_id, CASE WHEN grp = 'Gun Right Advocates' THEN 'Gun Rights Advocates' ELSE 'Immigrants' END AS grp, role, first_pos FROM vt WHERE rn = 1),
ro AS (SELECT chain_id, grp, arg_max(role, first_pos) AS role FROM mg GROUP BY 1, 2
  UNION ALL SELECT DISTINCT chain_id, 'Stance', CASE chain_id % 3 WHEN 0 THEN 'Pro' ELSE 'Anti' END FROM ch WHERE chain_id % 3 < 2)"""


@query(f"WITH {MERGED} SELECT chain_id, string_agg(grp, '|' ORDER BY grp) AS keys, string_agg(grp || '=' || role, '|' ORDER BY grp) AS signature, CAST(count(*) AS INTEGER) AS strength FROM ro GROUP BY 1")
def merged_group_roles(spark, sf):
    """Three groups that count as one, one of another spelling, and stances."""
    k = F.get_json_object("props", "$.k").cast("int")
    name = F.element_at(F.create_map(*[F.lit(x) for kv in {"click": "Refugees", "view": "Immigrants", "error": "Workers", "signup": "Other", "purchase": "Gun Right Advocates"}.items() for x in kv]), F.col("event_type"))
    role = F.element_at(F.array(*map(F.lit, ("Hero", "Victim", "Threat", "Neutral"))), k % 4 + 1)
    rows = read(spark, sf, "events").select(F.floor(F.col("event_id") / 4).cast("long").alias("chain_id"), F.col("event_id").alias("pos"), name.alias("grp"), role.alias("role"))
    stance = F.element_at(F.array(*map(F.lit, ("Pro", "Anti", "Neutral"))), (F.col("chain_id") % 3 + 1).cast("int"))
    stances = rows.select("chain_id").distinct().withColumn("stance", stance)
    return ch.group_roles(rows, stances).select("chain_id", "keys", "signature", "strength")


@query("WITH a AS (SELECT vec_id AS doc_id, label AS predicted FROM embeddings) SELECT doc_id, predicted FROM a WHERE predicted = doc_id % 10")
def agreements(spark, sf):
    a = points(spark, sf).select(F.col("id").alias("doc_id"), F.col("cluster").alias("predicted"))
    return mo.agreements(a, a.select("doc_id", (F.col("doc_id") % 10).cast(dict(a.dtypes)["predicted"]).alias("predicted")))


@query("""WITH e AS (SELECT vec_id % 3 AS answer, CASE label % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, 'm' || CAST(label % 2 AS VARCHAR) AS method, vec_id % 2 AS predicted FROM embeddings)
SELECT difficulty, method, count(*) AS n, round(avg(CASE WHEN answer = predicted THEN 1.0 ELSE 0 END), 6) AS accuracy FROM e GROUP BY GROUPING SETS ((), (difficulty), (method))""")
def intrusion_scores(spark, sf):
    p = points(spark, sf)
    level = F.element_at(F.array(*map(F.lit, ("easy", "medium", "hard"))), (F.col("cluster") % 3 + 1).cast("int"))
    sheet = p.select(F.col("id").alias("example_no"), (F.col("id") % 3).alias("answer"), level.alias("difficulty"), F.concat(F.lit("m"), (F.col("cluster") % 2).cast("string")).alias("method"))
    return ev.intrusion_scores(sheet, p.select(F.col("id").alias("example_no"), (F.col("id") % 2).alias("predicted"))).select("difficulty", "method", "n", r6("accuracy"))


NEAR = f"{CENTERS}, rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY sqrt(d2), id) AS r, count(*) OVER (PARTITION BY cluster) AS n FROM dist), close AS (SELECT id, cluster, r FROM rk WHERE r <= greatest(1, floor(n * 0.25)))"
FAR = """z AS (SELECT cluster FROM dist GROUP BY 1 HAVING count(*) > 1), cd AS (SELECT a.cluster, b.cluster AS other, sum((a.c - b.c) * (a.c - b.c)) AS d FROM cen a JOIN cen b ON a.i = b.i AND a.cluster <> b.cluster WHERE a.cluster IN (FROM z) AND b.cluster IN (FROM z) GROUP BY 1, 2),
rr AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY d, other) AS r, count(*) OVER (PARTITION BY cluster) AS n FROM cd), mm AS (SELECT *, greatest(1, floor(n * 0.25)) AS m FROM rr),
pool AS (SELECT cluster, 'easy' AS difficulty, other FROM mm WHERE r > n - m UNION ALL SELECT cluster, 'medium', other FROM mm WHERE r <= m UNION ALL SELECT cluster, 'hard', other FROM mm WHERE r = 1)"""


@query(f"""WITH {NEAR}, {FAR}, o AS (SELECT *, row_number() OVER (PARTITION BY cluster, difficulty ORDER BY {md5("cluster", "difficulty", "other", "0")}, other) AS k FROM pool),
i AS (SELECT o.cluster, difficulty, other AS source_cluster, c.id AS intruder, row_number() OVER (PARTITION BY o.cluster, difficulty ORDER BY {md5("o.cluster", "difficulty", "c.id", "0")}, c.id) AS k2 FROM o JOIN close c ON c.cluster = o.other WHERE k = 1)
SELECT cluster, difficulty, source_cluster, intruder FROM i WHERE k2 = 1""")
def intruders(spark, sf):
    return ev.intruders(*_with_centers(spark, sf))


@query(f"""WITH {NEAR}, p AS (SELECT c.*, c.id % 50 AS doc, {CONTENT.format("coalesce(d.text, 'point ' || CAST(c.id AS VARCHAR))")} AS w, row_number() OVER (PARTITION BY c.cluster ORDER BY {md5("c.id", "0")}, c.id) AS h FROM close c LEFT JOIN documents d ON d.doc_id = c.id),
x AS (SELECT a.cluster, least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, greatest(a.r, b.r) AS far, least(a.r, b.r) AS near, a.doc <> b.doc AS other,
  CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END AS j FROM p a JOIN p b ON a.cluster = b.cluster AND b.h BETWEEN a.h + 1 AND a.h + 50),
y AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY CASE WHEN other AND j < 0.6 THEN 0 WHEN other THEN 1 ELSE 2 END, far, near, a, b) AS k FROM x) SELECT cluster, a, b FROM y WHERE k = 1""")
def intrusion_positives(spark, sf):
    p = _texts(spark, sf)
    return ev.positives(p, qu.centroids(p))


@query(f"WITH {PLACED} SELECT doc_id, chain_id AS chain_no, row_number() OVER (ORDER BY doc_id, chain_id) - 1 AS chain_id FROM placed")
def flat_chains(spark, sf):
    rows = placed(spark, sf).select("doc_id", F.col("chain_id").alias("chain_no"))
    return ch.flat_chains(rows).select("doc_id", "chain_no", "chain_id")


@query(f"WITH {LINKS}, {PLACED}, h AS (SELECT 0 AS it, i, j FROM links JOIN placed p ON p.chain_id = i JOIN placed q ON q.chain_id = j AND q.cluster = p.cluster UNION ALL SELECT 1, i, j FROM links WHERE i % 10 = j % 10), t AS (SELECT i, j, count(*) AS times FROM h GROUP BY 1, 2) SELECT i, j, times FROM t ORDER BY times DESC, i, j LIMIT 10")
def most_violated(spark, sf):
    return ch.most_violated_within(*_iterations(spark, sf))


@query(f"""WITH m AS ({MENTIONS}), u AS (SELECT verb_sense, obj_head, min(position % 2) AS age FROM m GROUP BY 1, 2) SELECT verb_sense, obj_head FROM u ORDER BY age, verb_sense, obj_head LIMIT 30""")
def example_memory(spark, sf):
    m = mentions(spark, sf)
    new, old = (m.where(F.col("position") % 2 == i).select("verb_sense", "obj_head") for i in (0, 1))
    return cl.example_memory(old, new, 60)


@query(f"""WITH {VOTES}, e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT id, label, v, keys, signature FROM e JOIN roles ON chain_id = id),
s AS (SELECT a.id AS anchor, b.id AS other, list_cosine_similarity(a.v, b.v) AS sim, a.keys = b.keys AND a.signature <> b.signature AS bad FROM p a JOIN p b ON a.label = b.label AND a.id <> b.id),
r AS (SELECT anchor, bad, max(sim) AS sim FROM s GROUP BY 1, 2), k AS (SELECT count(*) FILTER (NOT bad AND sim > 0.1) AS pos, count(*) FILTER (bad AND sim > 0.05) AS neg FROM r)
SELECT positive, CASE WHEN positive THEN least(pos, CAST(floor(neg * 0.5) AS BIGINT)) ELSE least(neg, CAST(floor(pos / 0.5) AS BIGINT)) END AS n FROM k, (VALUES (true), (false)) t(positive) WHERE n > 0""")
def pair_balance(spark, sf):
    p = points(spark, sf).join(_roles(spark, sf).select(F.col("chain_id").alias("id"), "keys", "signature"), "id")
    mined = cl.near_pairs(p, same_pos=0.1, same_neg=0.05)
    return cl.balanced_pairs(mined, 0.5).groupBy("positive").agg(F.count("*").alias("n"))


@query("SELECT e.vec_id AS doc_id, e.split, e.label AS predicted, d.n_chars FROM (SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM embeddings) e JOIN documents d ON d.doc_id = e.vec_id")
def aligned_predictions(spark, sf):
    told = points(spark, sf).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"), F.col("cluster").alias("predicted"))
    feats = read(spark, sf, "documents").select("doc_id", "n_chars").crossJoin(F.broadcast(spark.createDataFrame([("test",), ("train",)], "split string")))  # two rows
    return mo.aligned(told, feats).select("doc_id", "split", "predicted", "n_chars")


def _frame(k: int = 5):
    return F.concat(F.lit("frame "), (F.col("doc_id") % k).cast("string"))


@query(f"""WITH {VOTES}, {PLACED}, c AS (SELECT doc_id, count(*) AS chains FROM placed JOIN roles USING (chain_id) GROUP BY 1), f AS (SELECT c.*, 'frame ' || CAST(doc_id % 5 AS VARCHAR) AS frame_label FROM c JOIN documents USING (doc_id) WHERE doc_id % 5 NOT IN (3, 4)),
r AS (SELECT *, row_number() OVER (PARTITION BY frame_label ORDER BY {md5('doc_id', '42')}, doc_id) - 1 AS r, count(*) OVER (PARTITION BY frame_label) AS n FROM f)
SELECT doc_id, frame_label, chains, CASE WHEN r < n * 0.7::DOUBLE THEN 'train' WHEN r < n * 0.85::DOUBLE THEN 'dev' ELSE 'test' END AS split FROM r""")
def frame_dataset(spark, sf):
    """Rare frames are left out; splits are by frame."""
    k = read(spark, sf, "embeddings").agg(F.max("label")).first()[0] + 1
    chains = placed(spark, sf).join(_roles(spark, sf), "chain_id")
    articles = read(spark, sf, "documents").select("doc_id", "text", _frame().alias("primary_frame"))
    out = mo.frame_dataset(chains, articles, k, "guncontrol", ("frame 3", "frame 4"))
    return out.select("doc_id", "frame_label", F.aggregate("cluster_feats_frequency", F.lit(0).cast("long"), lambda s, x: s + x).alias("chains"), "split")


# Samples


@query(f"""WITH {PLACED}, one AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {md5('chain_id', '42')}, chain_id) AS r FROM placed WHERE chain_id % 3 <> 0)
SELECT doc_id, chain_id FROM one WHERE r = 1 ORDER BY {md5('doc_id', '42')}, doc_id LIMIT 20""")
def annotation_sample(spark, sf):
    rows = placed(spark, sf).withColumn("annotation", F.when(F.col("chain_id") % 3 != 0, "known"))
    return ev.annotation_sample(rows, 20).select("doc_id", "chain_id")


@query(f"""WITH {CENTERS}, m AS (SELECT cluster, avg(sqrt(d2)) AS md FROM dist GROUP BY 1), r AS (SELECT cluster, row_number() OVER (ORDER BY md, cluster) - 1 AS rk, count(*) OVER () AS k FROM m WHERE cluster % 5 <> 0),
s AS (SELECT cluster, CASE WHEN rk < k // 4 THEN 'high' WHEN rk >= 3 * k // 4 THEN 'low' ELSE 'medium' END AS stratum FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {md5('cluster', '42')}, cluster) AS n FROM s), c AS (SELECT cluster, stratum FROM p WHERE n <= CASE stratum WHEN 'medium' THEN 2 ELSE 1 END),
x AS (SELECT vec_id AS id, cluster, stratum, row_number() OVER (PARTITION BY cluster ORDER BY {md5('vec_id', '42')}, vec_id) AS n FROM embeddings JOIN c ON cluster = label) SELECT id, cluster, stratum FROM x WHERE n <= 25""")
def theme_sample(spark, sf):
    p, centers = _with_centers(spark, sf)
    themes = centers.select("cluster", (F.col("cluster") % 5 != 0).alias("framing_pattern_detected"))
    return ev.theme_sample(p, centers, themes, {"high": 1, "medium": 2, "low": 1}).select("id", "cluster", "stratum")


# The model-backed chain. The rules answer from the prompt alone, so that SQL can say what they answer.


def _client(reply):
    return lambda: plugs.RuleLLM(reply)


def _echo(system, user, schema=None):
    return f"<think>It says so.</think>{user}"


def _verdict(system, user, schema=None):
    """causal for events of one verb; no valid answer for events of one object."""
    a, b = (x.strip("()").split(", ") for x in user.split("\n")[-2:])
    return json.dumps({"prediction": "maybe" if a[1] == b[1] else "causal" if a[0] == b[0] else "none"})


def _judged(spark, sf):
    texts = read(spark, sf, "documents").select("doc_id", "text")
    pairs = _pairs(spark, sf).withColumn("pair_id", F.col("e1.event_id") * 1_000_000 + F.col("e2.event_id"))
    return en.classify_pairs(pairs, texts, _client(_echo), _client(_verdict))


@query(f"WITH {PAIRS} SELECT e1 * 1000000 + e2 AS pair_id, 'It says so.' AS reason, CASE WHEN o1 = o2 THEN NULL WHEN regexp_replace(v1, '_-?[0-9]+$', '') = regexp_replace(v2, '_-?[0-9]+$', '') THEN 'causal' ELSE 'none' END AS relation FROM pairs JOIN documents USING (doc_id)")
def classify_pairs(spark, sf):
    return _judged(spark, sf).select("pair_id", "reason", "relation")


def _told(system, user, schema=None):
    return json.dumps({"sentence": "It happened that " + user.split("\n")[-1]})


CHAINS = """c AS (SELECT doc_id, e1, e2, '((' || split_part(v1, '_', 1) || ', ' || o1 || '), CAUSAL, (' || split_part(v2, '_', 1) || ', ' || o2 || '))' AS event_chain FROM pairs JOIN documents USING (doc_id)
  WHERE o1 <> o2 AND regexp_replace(v1, '_-?[0-9]+$', '') = regexp_replace(v2, '_-?[0-9]+$', ''))"""


def _verbalized(spark, sf):
    events = mentions(spark, sf).select("doc_id", F.col("position").alias("event_id"), "verb_sense", "obj_head")
    texts = read(spark, sf, "documents").select("doc_id", "text")
    rows = doc.causal_chains(doc.relations(_judged(spark, sf)), events).join(texts, "doc_id")
    rows = rows.withColumns({"chain_id": F.col("e1") * 1_000_000 + F.col("e2"), "excerpt": F.lit(None).cast("string")})
    return en.verbalize(rows, _client(_echo), _client(_told))


@query(f"WITH {PAIRS}, {CHAINS} SELECT e1 * 1000000 + e2 AS chain_id, 'It happened that ' || event_chain AS chain_text FROM c")
def verbalize(spark, sf):
    return _verbalized(spark, sf).select("chain_id", "chain_text")


def _cast_of(system, user, schema=None):
    """The first verb's subject has a group by its length, and a chain of clicks no valid answer."""
    verb = user.split("((")[-1].split(",")[0]
    groups = {"view": "Judiciary", "error": "Government", "signup": "Politicians", "click": "Nobody"}
    one = {"entity": verb, "character_group": groups.get(verb, "Other"), "role": "Hero"}
    return json.dumps({"characters": [one], "stance": "Pro" if len(verb) > 5 else "Neutral"})


@query(f"""WITH {PAIRS}, {CHAINS}, v AS (SELECT e1 * 1000000 + e2 AS chain_id, split_part(split_part(event_chain, '((', 2), ',', 1) AS verb FROM c)
SELECT chain_id, CASE WHEN verb <> 'click' THEN verb END AS entity, CASE verb WHEN 'view' THEN 'Judiciary' WHEN 'error' THEN 'Government' WHEN 'signup' THEN 'Politicians' WHEN 'click' THEN NULL ELSE 'Other' END AS grp,
CASE WHEN verb = 'click' THEN NULL WHEN length(verb) > 5 THEN 'Pro' ELSE 'Neutral' END AS stance FROM v""")
def annotate_characters(spark, sf):
    got = en.annotate_characters(_verbalized(spark, sf), "guncontrol", _client(_echo), _client(_cast_of))
    first = F.get("annotation.characters", F.lit(0))
    return got.select("chain_id", first["entity"].alias("entity"), first["character_group"].alias("grp"), F.col("annotation.stance").alias("stance"))


def _theme(system, user, schema=None):
    n = len(user.split("\n"))
    return json.dumps({"framing_pattern_detected": n % 2 == 0, "theme": f"{n} lines", "framing_elements": {"issue": "lines", "evaluation": None, "resolution": None}})


@query(f"""WITH {CENTERS}, n AS (SELECT cluster, least(25, greatest(1, CAST(floor(count(*) * 0.5) AS BIGINT))) AS n FROM dist GROUP BY 1)
SELECT cluster, n % 2 = 0 AS framing_pattern_detected, CAST(n AS VARCHAR) || ' lines' AS theme, 'lines' AS issue FROM n""")
def cluster_themes(spark, sf):
    p, centers = _with_centers(spark, sf)
    chains = p.select("cluster", "vector", "id", F.col("id").alias("chain_id"), (F.col("id") % 50).alias("doc_id"), F.concat(F.lit("chain "), F.col("id").cast("string")).alias("chain_text"))
    got = en.cluster_themes(chains, _client(_echo), _client(_theme), centers=centers)
    return got.select("cluster", "framing_pattern_detected", "theme", F.col("framing_elements.issue").alias("issue"))


# Fits without SQL: tests check what must hold of them.


@query()
def reseeded(spark, sf):
    p = points(spark, sf)
    rows = p.join(_roles(spark, sf).select(F.col("chain_id").alias("id"), "keys", "signature"), "id", "left")
    bad = ch.violations(p.select(F.col("id").alias("chain_id"), "cluster"), _roles(spark, sf))
    return cl.reseeded(rows, qu.centroids(p), bad).select("cluster", "center")


@query()
def coefficients(spark, sf):
    rows = points(spark, sf).select(F.col("id").alias("doc_id"), "vector", F.concat(F.lit("c"), F.col("cluster").cast("string")).alias("frame"))
    model = mo.fit_frames(rows, "frame", "vector")
    names = [f"v{i}" for i in range(len(rows.first().vector))]
    return spark.createDataFrame(mo.coefficients(model, names), "label string, feature string, coefficient double")
