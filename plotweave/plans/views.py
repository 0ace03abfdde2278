"""Views of the driver's tables in the shapes that the operators take. All rows of the tables take part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ROLE = "CASE k % 4 WHEN 0 THEN 'Hero' WHEN 1 THEN 'Victim' WHEN 2 THEN 'Threat' ELSE 'Neutral' END"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark, sf_dir) -> DataFrame:
    """Events as predicate-object mentions: a user is a document, fifty event ids a sentence."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = read(spark, sf_dir, "events").select("*", k.alias("k"))
    return rows.select(F.col("user_id").alias("doc_id"), F.floor(F.col("event_id") / 50).cast("long").alias("sent_id"), F.col("event_id").alias("position"), F.concat("event_type", F.lit("_"), (F.col("k") % 3).cast("string")).alias("verb_sense"), F.concat(F.lit("o"), F.col("k").cast("string")).alias("obj_head"), "k", "ts", "value")


MENTIONS = """SELECT user_id AS doc_id, event_id // 50 AS sent_id, event_id AS position, event_type || '_' || CAST(k % 3 AS VARCHAR) AS verb_sense,
  'o' || CAST(k AS VARCHAR) AS obj_head, k, ts, value FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"""


def characters(spark, sf_dir) -> DataFrame:
    """Events as annotated characters: three event ids a chain, the type a group, the property a role."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = read(spark, sf_dir, "events").select("*", k.alias("k"))
    return rows.select(F.floor(F.col("event_id") / 3).cast("long").alias("chain_id"), F.col("event_type").alias("grp"), F.expr(ROLE).alias("role"), F.col("event_id").alias("pos"))


CHARACTERS = f"SELECT event_id // 3 AS chain_id, event_type AS grp, {ROLE} AS role, event_id AS pos FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"

VOTES = f"""votes AS (SELECT chain_id, grp, role, n, min(p) OVER (PARTITION BY chain_id, grp) AS first_pos, row_number() OVER (PARTITION BY chain_id, grp ORDER BY n DESC, role) AS rn FROM
  (SELECT chain_id, grp, role, count(*) AS n, min(pos) AS p FROM ({CHARACTERS}) WHERE role <> 'Neutral' AND grp <> 'Other' GROUP BY ALL)),
roles AS (SELECT chain_id, string_agg(grp, '|' ORDER BY grp) AS keys, string_agg(grp || '=' || role, '|' ORDER BY grp) AS signature, count(*) AS strength
  FROM votes WHERE rn = 1 GROUP BY chain_id)"""


def points(spark, sf_dir) -> DataFrame:
    """id, cluster, vector: the embeddings with their labels."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("vector"))


def placed(spark, sf_dir) -> DataFrame:
    """chain_id, doc_id, cluster: chains take the cluster of an embedding in turn, and fifty documents."""
    rows, n = characters(spark, sf_dir).select("chain_id").distinct(), read(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))
    vec = rows.crossJoin(F.broadcast(n)).select("chain_id", (F.col("chain_id") % 50).alias("doc_id"), (F.col("chain_id") % F.col("n")).alias("vec_id"))  # n is one row
    return vec.join(read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("cluster")), "vec_id").select("chain_id", "doc_id", "cluster")


PLACED = f"""placed AS (SELECT c.chain_id, c.chain_id % 50 AS doc_id, e.label AS cluster FROM (SELECT DISTINCT chain_id FROM ({CHARACTERS})) c
  JOIN embeddings e ON e.vec_id = c.chain_id % (SELECT count(*) FROM embeddings))"""

CENTERS = """pos AS (SELECT vec_id AS id, label AS cluster, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
cen AS (SELECT cluster, i, avg(x) AS c FROM pos GROUP BY ALL),
dist AS (SELECT id, pos.cluster, sum((x - c) * (x - c)) AS d2 FROM pos JOIN cen USING (cluster, i) GROUP BY ALL)"""
