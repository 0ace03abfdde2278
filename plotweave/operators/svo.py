"""Subject-verb-object triples from dependency parses."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import ready

TOKENS = "ARRAY<STRUCT<i:INT,text:STRING,lemma:STRING,pos:STRING,dep:STRING,head:INT>>"
_PHRASE = "STRUCT<text:STRING,idx:ARRAY<INT>>"
TRIPLES = f"ARRAY<STRUCT<subj:{_PHRASE},verb:STRUCT<lemma:STRING,idx:INT,negated:BOOLEAN>,obj:{_PHRASE}>>"

# Dependency labels and words that mark parts of a sentence.
SUBJECT = {"nsubj", "nsubjpass", "csubj", "csubjpass", "agent", "expl"}
OBJECT = {"dobj", "dative", "attr", "oprd"}
PHRASE_END = {"CCONJ", "VERB"}
NEGATION = {"no", "not", "n't", "never", "none"}
JOINING = {"and", "or", "nor", "but", "yet", "so", "for"}


class Sentence:
    """A parsed sentence; tokens are numbers."""

    def __init__(self, tokens: list[dict]):
        self.text = [t["text"] for t in tokens]
        self.low = [t["text"].lower() for t in tokens]
        self.lemma = [t["lemma"] for t in tokens]
        self.pos = [t["pos"] for t in tokens]
        self.dep = [t["dep"] for t in tokens]
        at = {t["i"]: n for n, t in enumerate(tokens)}
        self.number = [t["i"] for t in tokens]
        self.head = [at.get(t["head"], n) for n, t in enumerate(tokens)]
        none: list[int] = []  # of all words without any
        self.left, self.right = [none] * len(tokens), [none] * len(tokens)
        for n, h in enumerate(self.head):
            if n != h:
                side = self.left if n < h else self.right
                if side[h] is none:
                    side[h] = [n]
                else:
                    side[h].append(n)
        self.seen: set[int] = set()

    def main(self, t: int) -> bool:
        return self.pos[t] == "VERB" and self.dep[t] not in ("aux", "auxpass")

    def negated(self, t: int) -> bool:
        return any(self.low[c] in NEGATION for c in self.left[t] + self.right[t])

    def conjuncts(self, heads: list[int], starts, wanted) -> list[int]:
        """Each wanted word that conjunctions lead to, once: from heads, and from what has been found, to the right of a word
        that has a conjunction there."""
        found: list[int] = []
        for word in chain(heads, found):
            if any(map(starts, self.right[word])):
                found += [r for r in self.right[word] if wanted(r) and r not in found]
        return found

    def joins(self, t: int) -> bool:
        return self.low[t] in JOINING

    def subjects(self, verb: int) -> tuple[list[int], bool]:
        """Subjects, and whether the verb is negated."""
        own = [t for t in self.left[verb] if self.dep[t] in SUBJECT and self.pos[t] != "DET"]
        if own:
            more = self.conjuncts(own, lambda r: self.joins(r) or self.dep[r] == "conj", lambda r: self.dep[r] in {*SUBJECT, "conj"} or self.pos[r] == "NOUN")
            return own + more, self.negated(verb)
        # A noun above is the subject. A verb above only leads further up.
        t = verb
        while True:
            h = self.head[t]
            while self.pos[h] not in ("VERB", "NOUN") and self.head[h] != h:
                h = self.head[h]
            if self.pos[h] == "NOUN":
                return [h], self.negated(t)
            if self.pos[h] != "VERB" or self.head[h] == h:
                return [], False
            t = h

    def prepositional(self, after: list[int], passive: bool) -> list[int]:
        """Objects of the prepositions among after; in a passive, of its agent, too."""
        links = {"prep", "agent"} if passive else {"prep"}
        labels = OBJECT | {"pobj"} if passive else OBJECT
        below = chain.from_iterable(self.right[p] for p in after if self.pos[p] == "ADP" and self.dep[p] in links)
        return [t for t in below if self.dep[t] in labels or (self.pos[t], self.low[t]) == ("PRON", "me")]

    def objects(self, verb: int, passive: bool) -> tuple[int, list[int]]:
        """The verb whose objects these are (an open complement may replace it), and the objects."""
        after = self.right[verb]
        found = [t for t in after if self.dep[t] in OBJECT or passive and self.dep[t] == "pobj"] + self.prepositional(after, passive)
        for x in after:
            if self.pos[x] == "VERB" and self.dep[x] == "xcomp":
                below = [t for t in self.right[x] if self.dep[t] in OBJECT] + self.prepositional(self.right[x], passive)
                if below:
                    verb, found = x, found + below
                    break
        return verb, found + self.conjuncts(found, self.joins, lambda r: self.dep[r] in OBJECT or self.pos[r] == "NOUN")

    def phrase(self, t: int) -> list[int]:
        """A word with its neighbours in the tree."""
        if self.low[t] == "that":
            t = next((self.head[k] for k in range(len(self.text)) if any(self.text[c] == "that" for c in self.left[k])), t)
        out: list[int] = []
        for side in (self.left[t], [t], self.right[t]):
            for c in side:
                if c != t and self.pos[c] in PHRASE_END:
                    break
                if c == t or self.low[c] not in NEGATION:
                    out.append(c)
        follow = self.right[out[-1]][:1]
        if follow and self.pos[follow[0]] in ("DET", "NOUN") and follow[0] not in self.seen:
            self.seen.add(follow[0])
            out += self.phrase(follow[0])
        return out

    def triples(self) -> list[dict]:
        n = range(len(self.text))
        out: list[dict] = []

        def shown(t: int | None) -> dict | None:
            if t is None:
                return None
            ts = self.phrase(t)
            return {"text": " ".join(self.text[k] for k in ts), "idx": [self.number[k] for k in ts]}

        for v in [t for t in n if self.main(t)] or [t for t in n if self.pos[t] in ("VERB", "AUX")]:
            passive = any(self.dep[c] == "auxpass" for c in self.left[v] + self.right[v])
            subjects, negated = self.subjects(v)
            after = self.right[v]
            second = next((t for t in after[1:] if self.main(t)), None) if len(after) > 1 and self.pos[after[0]] == "CCONJ" else None
            other, objects = self.objects(v if second is None else second, passive)
            verbs = [other] if second is None else [v, other]
            if not objects:
                if second is not None:
                    continue
                objects = [None] if subjects else []
            for s in subjects or [None]:
                for o in objects:
                    no = negated or o is not None and self.negated(o)
                    first, last = shown(s), shown(o)
                    if passive:
                        first, last = last, first
                    out += [{"subj": first, "verb": {"lemma": "!" * no + self.lemma[x], "idx": self.number[x], "negated": no}, "obj": last} for x in verbs]
        return out


def listed_triples(keys: pa.Array, parsed: list[list[dict] | None]) -> pa.RecordBatch:
    """sent_id, svos: each sentence's triples in an array."""
    phrase = pa.struct([("text", pa.string()), ("idx", pa.list_(pa.int32()))])
    kind = pa.list_(pa.struct([("subj", phrase), ("verb", pa.struct([("lemma", pa.string()), ("idx", pa.int32()), ("negated", pa.bool_())])), ("obj", phrase)]))
    return pa.RecordBatch.from_arrays([keys, pa.array([Sentence(x or []).triples() for x in parsed], kind)], ["sent_id", "svos"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from plotweave.operators.svo import listed_triples

    for batch in batches:
        yield listed_triples(batch["sent_id"], batch["tokens"].to_pylist())


def each_triple(rows: DataFrame) -> DataFrame:
    return rows.select("sent_id", F.posexplode("svos").alias("svo_id", "x")).select("sent_id", "svo_id", "x.subj", "x.verb", "x.obj")


def extract_svos(parsed: DataFrame) -> DataFrame:
    """sent_id, svo_id, subj, verb, obj from (sent_id, tokens). Sentences without triples have no rows."""
    ready(parsed.sparkSession)
    kind = dict(parsed.dtypes)["sent_id"]
    return each_triple(parsed.select("sent_id", F.col("tokens").cast(TOKENS).alias("tokens")).mapInArrow(_extract, f"sent_id {kind}, svos {TRIPLES}"))


def object_heads(svos: DataFrame, heads: DataFrame) -> DataFrame:
    """Adds obj_head and obj_head_index to triples from (text, lemma, at), a parse's root of each distinct object text.

    Objects with irregular spacing are skipped: their words wouldn't be the parse's.
    """
    regular = F.col("obj.text").isNotNull() & ~F.col("obj.text").rlike("(^ | $|  )")
    known = heads.select(F.col("text").alias("_t"), F.col("lemma").alias("obj_head"), F.col("at").alias("_at"))
    out = svos.join(known, F.when(regular, F.col("obj.text")) == F.col("_t"), "left")
    return out.withColumn("obj_head_index", F.get("obj.idx", F.col("_at"))).drop("_t", "_at")
