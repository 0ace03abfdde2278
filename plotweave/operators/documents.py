"""Articles, sentences and events: filters, splits and joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.columns import causal_event, strip_verb_sense
from ..functions.words import ABBREVIATIONS
from ..sources.tables import numbered, ready
from .spans import first_places


def labelled(articles: DataFrame, label: str = "primary_frame") -> DataFrame:
    return articles.where(F.col(label).isNotNull())


def split_lines(articles: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no, text: the non-empty lines, stripped; line_no counts kept lines from 0."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r\x0b\f"))), lambda x: x != "")
    return articles.select("doc_id", F.posexplode(lines).alias("line_no", "text"))


def number_sentences(lines: DataFrame) -> DataFrame:
    """Adds sent_id, running from 0 over all documents."""
    return numbered(lines, "doc_id", "line_no", name="sent_id")


ELLIPSIS, NUMBER_DOT, INNER_DOT = "\ue000", "\ue001", "\ue002"


def protect(text: Column) -> Column:
    """White space collapsed; dots that end no sentence replaced: ellipses, dots after numbers, those of abbreviations."""
    out = F.btrim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
    out = F.regexp_replace(out, r"[“\"](.+?)[”\"]", '"$1"')
    out = F.regexp_replace(out, r"\.{3,}", f" {ELLIPSIS} ")
    out = F.regexp_replace(out, r"([0-9]+)\.(?![0-9])", f"$1{NUMBER_DOT}")
    inner = [a for a in ABBREVIATIONS if "." in a]
    names = "|".join(a.replace(".", r"\.") for a in sorted(inner, key=len, reverse=True))
    mark = F.regexp_replace(out, rf"\b(?:{names})(?= )", f"$0{INNER_DOT}")
    return mark


def restore(sentence: Column) -> Column:
    out = F.replace(F.replace(sentence, F.lit(ELLIPSIS), F.lit("...")), F.lit(NUMBER_DOT), F.lit("."))
    return F.btrim(F.replace(out, F.lit(INNER_DOT), F.lit("")))


def split_sentences(articles: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no, text: sentences end with . ! ? and perhaps quotes, before white space.

    Unlike a trained splitter this follows rules only; abbreviations are matched with their dots, so they do count.
    """
    cut = F.split(F.regexp_replace(protect(F.col(text)), r"([.!?][\"')\]]*) (?=\S)", "$1\n"), "\n", -1)
    sentences = F.filter(F.transform(cut, restore), lambda x: x != "")
    return articles.select("doc_id", F.posexplode(sentences).alias("line_no", "text"))


def with_spans(sentences: DataFrame, articles: DataFrame) -> DataFrame:
    """Adds span, the first place of each sentence in its article, null where there is none. An article moves once, and all its
    sentences are found in one pass over it."""
    ready(sentences.sparkSession)
    listed = sentences.groupBy("doc_id").agg(F.collect_list(F.struct(*sentences.columns)).alias("_s"))
    met = listed.join(articles.select("doc_id", F.col("text").alias("_article")), "doc_id").select("_s", "_article")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts, article = batch["_s"][i].values.field("text").to_pylist(), batch["_article"][i].as_py()
                places = first_places(article, texts) if article is not None else [None] * len(texts)
                spans = [None if p is None else {"start": p, "end": p + len(t)} for p, t in zip(places, texts)]
                yield pa.RecordBatch.from_arrays([batch["_s"].slice(i, 1), pa.array([spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["_s", "_spans"])

    span = StructType().add("start", "integer").add("end", "integer")
    found = met.mapInArrow(find, StructType([met.schema["_s"]]).add("_spans", ArrayType(span)))
    both = found.select(F.explode(F.arrays_zip("_s", "_spans")).alias("_x"))
    return both.select(*[F.col("_x._s")[c].alias(c) for c in sentences.columns], F.col("_x._spans").alias("span"))


def number_events(po: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Repeated events of a sentence go; event_id counts a document's events from 0 by sentence and tuple."""
    distinct = po.dropDuplicates([doc, "sent_id", "verb_sense", "obj_head"])
    order = W.partitionBy(doc).orderBy("sent_id", "verb_sense", "obj_head")
    return distinct.withColumn("event_id", F.row_number().over(order) - 1)


def sentence_events(sentences: DataFrame, events: DataFrame) -> DataFrame:
    """Each sentence with its events in an array by event_id, empty if it has none or no span."""
    listed = events.groupBy("doc_id", "sent_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "verb_sense", "obj_head"))).alias("events"))
    none = F.array().cast(listed.schema["events"].dataType)
    kept = F.coalesce("events", none)
    if "span" in sentences.columns:
        kept = F.when(F.col("span").isNotNull(), kept).otherwise(none)
    return sentences.join(listed, ["doc_id", "sent_id"], "left").withColumn("events", kept)


def overlapping(sentences: DataFrame, annotations: DataFrame, width: int = 1024) -> DataFrame:
    """Annotations (doc_id, start, end, …) and the sentences that they touch, ends included.

    Both are dealt to bins of so many characters, and meet in the first bin that they share: an equi-join in which a long
    document is many keys.
    """
    bins = lambda a, b: (F.floor(F.least(a, b) / width), F.floor(F.greatest(a, b) / width))
    s = sentences.where("span IS NOT NULL").select("doc_id", "sent_id", "span")
    first, last = bins(F.col("span.start"), F.col("span.end"))
    s = s.withColumns({"_s": first, "_bin": F.explode(F.sequence(first, last))})
    first, last = bins(F.col("start"), F.col("end"))
    a = annotations.withColumns({"_a": first, "_bin": F.explode(F.sequence(first, last))})
    met = a.join(s, ["doc_id", "_bin"]).where((F.col("_bin") == F.greatest("_a", "_s")) & F.expr("start <= span.end AND end >= span.start"))
    return met.drop("_bin", "_a", "_s")


def phrase_events(phrases: DataFrame, events: DataFrame) -> DataFrame:
    """Events whose verb and object both occur among a phrase's lemmas (doc_id, lemmas).

    Phrases are listed under each of their lemmas. An event looks under its verb or its object, whichever fewer phrases of its
    document have, and only there; the other one is checked.
    """
    verb = F.split_part("verb_sense", F.lit("_"), F.lit(1))
    listed = phrases.withColumn("_lemma", F.explode(F.array_distinct("lemmas")))
    counts = listed.groupBy("doc_id", "_lemma").agg(F.count("*").alias("_n"))
    of = lambda name, n: counts.select("doc_id", F.col("_lemma").alias(name), F.col("_n").alias(n))
    asked = events.withColumns({"_verb": verb, "_object": F.col("obj_head")}).join(of("_verb", "_nv"), ["doc_id", "_verb"]).join(of("_object", "_no"), ["doc_id", "_object"])
    rarer = F.col("_nv") <= F.col("_no")
    asked = asked.withColumns({"_lemma": F.when(rarer, F.col("_verb")).otherwise(F.col("_object")), "_other": F.when(rarer, F.col("_object")).otherwise(F.col("_verb"))})
    met = listed.join(asked, ["doc_id", "_lemma"]).where(F.array_contains("lemmas", F.col("_other")))
    return met.drop("_lemma", "_other", "_verb", "_object", "_nv", "_no")


def event_pairs(events: DataFrame, window: int = 2, order: str = "event_id") -> DataFrame:
    """doc_id, e1, e2: each unordered pair of a document's events at most window sentences apart, the earlier first.

    Sentences are dealt to blocks of window + 1. An event meets those of its own block and of the next, so the join is an
    equi-join on (doc_id, block) and long documents don't make a quadratic group.
    """
    event = F.struct(F.col(order).alias("event_id"), strip_verb_sense("verb_sense").alias("verb"), F.col("obj_head").alias("object"), F.col("sent_id").alias("sentence_id"))
    rows = events.select("doc_id", "sent_id", F.col(order).alias("_at"), event.alias("e"), F.floor(F.col("sent_id") / (window + 1)).alias("block"))
    a = rows.select("doc_id", F.explode(F.array("block", F.col("block") + 1)).alias("block"), F.col("sent_id").alias("s1"), F.col("_at").alias("a1"), F.col("e").alias("e1"))
    b = rows.select("doc_id", "block", F.col("sent_id").alias("s2"), F.col("_at").alias("a2"), F.col("e").alias("e2"))
    near = (F.col("s2") - F.col("s1") <= window) & ((F.col("s2") > F.col("s1")) | (F.col("s2") == F.col("s1")) & (F.col("a1") < F.col("a2")))
    return a.join(b, ["doc_id", "block"]).where(near).select("doc_id", "e1", "e2")


def pair_totals(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: documents, with_pairs, pairs, mean_pairs (of documents that have pairs)."""
    n = pairs.groupBy("doc_id").agg(F.count("*").alias("n"))
    found = n.agg(F.count("*").alias("with_pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.avg("n").alias("mean_pairs"))
    return docs.agg(F.count("*").alias("documents")).crossJoin(found)  # one row each


def relations(pairs: DataFrame) -> DataFrame:
    """Pairs that were judged causal as edges: doc_id, e1, e2, label."""
    return pairs.where("relation = 'causal'").select("doc_id", F.col("e1.event_id").cast("long").alias("e1"), F.col("e2.event_id").cast("long").alias("e2"), F.col("relation").alias("label"))


def causal_chains(edges: DataFrame, events: DataFrame, cap: int | None = None) -> DataFrame:
    """doc_id, chain_no, e1, e2, event_chain: causal edges by first event, as text; at most cap for each document."""
    ev = events.select("doc_id", "event_id", "verb_sense", "obj_head")
    one = ev.select("doc_id", F.col("event_id").alias("e1"), F.col("verb_sense").alias("v1"), F.col("obj_head").alias("o1"))
    two = ev.select("doc_id", F.col("event_id").alias("e2"), F.col("verb_sense").alias("v2"), F.col("obj_head").alias("o2"))
    rows = edges.where("label = 'causal'").join(one, ["doc_id", "e1"]).join(two, ["doc_id", "e2"])
    rows = rows.withColumn("chain_no", F.row_number().over(W.partitionBy("doc_id").orderBy("e1", "e2")) - 1)
    if cap is not None:
        rows = rows.where(F.col("chain_no") < cap)
    return rows.select("doc_id", "chain_no", "e1", "e2", causal_event("v1", "o1", "v2", "o2").alias("event_chain"))


def excerpt_bounds(s1: Column, s2: Column, first: Column, last: Column, n: int) -> Column:
    """struct(first, last) of an excerpt: n sentences on either side of two events' sentences; what one side lacks the other
    gives. Null if it would have more than 2n + 3 sentences."""
    low, high = F.least(s1, s2), F.greatest(s1, s2)
    before, after = low - first, last - high
    got_before, got_after = F.least(F.lit(n), before), F.least(F.lit(n), after)
    more_after = F.least(n - got_before, after - got_after)
    more_before = F.least(n - got_after, before - got_before)
    a, b = low - got_before - more_before, high + got_after + more_after
    return F.when(b - a + 1 <= 2 * n + 3, F.struct(a.alias("first"), b.alias("last")))


def excerpts(chains: DataFrame, sentences: DataFrame, n: int = 2) -> DataFrame:
    """Adds excerpt to chains (doc_id, s1, s2, …): the text of the sentences within the bounds. Chains beyond them go.

    Each chain has its own text; none starts with another's.
    """
    ends = sentences.groupBy("doc_id").agg(F.min("sent_id").alias("_first"), F.max("sent_id").alias("_last"))
    bounds = chains.join(ends, "doc_id").withColumn("_b", excerpt_bounds(F.col("s1"), F.col("s2"), F.col("_first"), F.col("_last"), n)).where("_b IS NOT NULL")
    bounds = bounds.withColumn("_sent", F.explode(F.sequence("_b.first", "_b.last")))
    texts = sentences.select("doc_id", F.col("sent_id").alias("_sent"), F.col("text").alias("_text"))
    joined = bounds.join(texts, ["doc_id", "_sent"])
    parts = F.sort_array(F.collect_list(F.struct("_sent", "_text")))
    return joined.groupBy(*[c for c in chains.columns]).agg(F.concat_ws(" ", F.transform(parts, lambda x: x["_text"])).alias("excerpt"))


def majority_frame(spans: DataFrame) -> DataFrame:
    """doc_id, sent_id, frame: the most frequent frame of the annotations that touch a sentence, ties by name."""
    counts = spans.groupBy("doc_id", "sent_id", "frame").count()
    return counts.groupBy("doc_id", "sent_id").agg(F.min_by("frame", F.struct(-F.col("count"), "frame")).alias("frame"))
