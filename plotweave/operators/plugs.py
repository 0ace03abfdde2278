"""Plug points for models, and offline stand-ins for tests. The stand-ins follow simple rules; they are no trained models."""

from __future__ import annotations

import hashlib
import json
import re
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import ready
from .svo import TOKENS, TRIPLES, each_triple, listed_triples


class TextParser(Protocol):
    def parse(self, sentences: list[str]) -> list[list[dict]]:
        """Tokens (i, text, lemma, pos, dep, head) of each sentence."""


class Lemmatizer(Protocol):
    def lemmas(self, sentences: list[str]) -> list[list[str]]: ...


class SentenceSplitter(Protocol):
    def split(self, texts: list[str]) -> list[list[str]]: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def expand(self, masked: list[str], k: int) -> list[list[tuple[str, float]]]:
        """Most probable tokens for the mask of each sentence."""


class LLMClient(Protocol):
    def chat(self, system: str, user: str, schema: dict | None = None) -> str: ...


class RuleParser:
    """Words in a row: a verb is what ends like one, nouns before and after depend on it."""

    VERB = re.compile(r"(ed|ing|es|ize|ise)$")
    SMALL = {"the": "DET", "a": "DET", "an": "DET", "and": "CCONJ", "or": "CCONJ", "of": "ADP", "to": "ADP", "in": "ADP", "for": "ADP", "not": "PART"}

    KNOWN = 1 << 17

    def __init__(self):
        self.known: dict[str, tuple] = {}

    def parse(self, sentences: list[str]) -> list[list[dict]]:
        return [self._one(s) for s in sentences]

    def _word(self, w: str) -> tuple[str, str, str]:
        """(part of speech, that of a first word, lemma); of the words seen, KNOWN are remembered."""
        low = w.lower()
        first = self.SMALL.get(low) or ("PUNCT" if not w[0].isalnum() else "NOUN")
        pos = "VERB" if first == "NOUN" and self.VERB.search(low) else first
        if len(self.known) >= self.KNOWN:
            self.known.clear()
        out = self.known[w] = pos, first, re.sub(r"(ing|ed|es|s)$", "", low) or low
        return out

    def _one(self, sentence: str) -> list[dict]:
        words = re.findall(r"\w+|[^\w\s]", sentence)
        if not words:
            return []
        known = self.known
        of = [known.get(w) or self._word(w) for w in words]
        pos = [x[0] for x in of]
        pos[0] = of[0][1]
        root = pos.index("VERB") if "VERB" in pos else 0
        out = [{"i": i, "text": w, "lemma": x[2], "pos": p, "dep": "dep", "head": root} for i, (w, x, p) in enumerate(zip(words, of, pos))]
        out[root]["dep"] = "ROOT"
        subject, had_object = None, False
        for i, p in enumerate(pos):
            if p == "NOUN":
                if i < root:
                    subject, out[i]["dep"] = i, "compound"
                elif i > root and not had_object:
                    out[i]["dep"], had_object = "dobj", True
            elif p == "DET" and i + 1 < len(words):
                out[i]["head"], out[i]["dep"] = i + 1, "det"
            elif p == "PART":  # not
                out[i]["dep"] = "neg"
        if subject is not None:
            out[subject]["dep"] = "nsubj"
        return out


class SuffixLemmatizer:
    """Lower-cased words without common endings."""

    def lemmas(self, sentences: list[str]) -> list[list[str]]:
        return [[re.sub(r"(?<=\w{3})(ing|ed|es|s)$", "", w) for w in re.findall(r"\w+", s.lower())] for s in sentences]


class RegexSplitter:
    def split(self, texts: list[str]) -> list[list[str]]:
        return [[s for s in re.split(r"(?<=[.!?])\s+", t.strip()) if s] for t in texts]


class HashEmbedder:
    """Signed hashes of words, normalised; expansions are the sentence's other words."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dims)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dims] += 1 if h >> 63 else -1
            out.append((v / (np.linalg.norm(v) or 1)).tolist())
        return out

    def expand(self, masked: list[str], k: int) -> list[list[tuple[str, float]]]:
        out = []
        for s in masked:
            words = sorted({w for w in s.lower().split() if w != "[mask]"})[:k]
            out.append([(w, 1 / len(words)) for w in words])
        return out


class ChatServer:
    """LLMClient of a server that speaks the Ollama chat protocol over HTTP. The model is pulled when a client is made, if
    the server hasn't got it."""

    def __init__(self, model: str, url: str = "http://localhost:11434", *, seed: int = 42, temperature: float = 0.0, num_ctx: int = 14336, num_predict: int = 2048, timeout: float = 600.0):
        self.model, self.url, self.timeout = model, url.rstrip("/"), timeout
        self.options = {"seed": seed, "temperature": temperature, "num_ctx": num_ctx, "num_predict": num_predict}
        self._post("/api/pull", {"model": model, "stream": False})

    def _post(self, path: str, body: dict) -> dict:
        request = urllib.request.Request(self.url + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def chat(self, system: str, user: str, schema: dict | None = None) -> str:
        body = {"model": self.model, "stream": False, "options": self.options, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        return self._post("/api/chat", body | ({"format": schema} if schema else {}))["message"]["content"]


class RuleLLM:
    """Answers from a function, for tests."""

    def __init__(self, reply: Callable[[str, str, dict | None], str]):
        self.reply = reply

    def chat(self, system: str, user: str, schema: dict | None = None) -> str:
        return self.reply(system, user, schema)


def parse_sentences(sentences: DataFrame, make: Callable[[], TextParser] = RuleParser, batch: int = 256) -> DataFrame:
    """sent_id, text, tokens. make builds a parser once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = make()
        token = pa.struct([("i", pa.int32()), ("text", pa.string()), ("lemma", pa.string()), ("pos", pa.string()), ("dep", pa.string()), ("head", pa.int32())])
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                yield part.append_column("tokens", pa.array(parser.parse([x or "" for x in part["text"].to_pylist()]), pa.list_(token)))

    ready(sentences.sparkSession)
    rows = sentences.select("sent_id", "text")
    return rows.mapInArrow(run, f"sent_id {dict(rows.dtypes)['sent_id']}, text string, tokens {TOKENS}")


def sentence_svos(sentences: DataFrame, make: Callable[[], TextParser] = RuleParser, batch: int = 256) -> DataFrame:
    """extract_svos of parse_sentences, for whoever needs triples only: tokens never leave the task that parses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = make()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                yield listed_triples(part["sent_id"], parser.parse([x or "" for x in part["text"].to_pylist()]))

    ready(sentences.sparkSession)
    rows = sentences.select("sent_id", "text")
    return each_triple(rows.mapInArrow(run, f"sent_id {dict(rows.dtypes)['sent_id']}, svos {TRIPLES}"))


def lemmatize(sentences: DataFrame, key: str, make: Callable[[], Lemmatizer] = SuffixLemmatizer) -> DataFrame:
    """key, lemmas."""

    def run(batches):
        own = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b[key], pa.array(own.lemmas([x or "" for x in b["text"].to_pylist()]), pa.list_(pa.string()))], [key, "lemmas"])

    ready(sentences.sparkSession)
    rows = sentences.select(key, "text")
    return rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, lemmas array<string>")


def embed(rows: DataFrame, key: str, text: str, make: Callable[[], Embedder] = HashEmbedder, batch: int = 32) -> DataFrame:
    """key, vector. A null text has a null vector."""

    ready(rows.sparkSession)

    def run(batches):
        own = make()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = part["_text"].to_pylist()
                known = iter(own.embed([t for t in texts if t is not None]))
                yield pa.RecordBatch.from_arrays([part[key], pa.array([None if t is None else next(known) for t in texts], pa.list_(pa.float64()))], [key, "vector"])

    src = rows.select(key, F.col(text).alias("_text"))
    return src.mapInArrow(run, f"{key} {dict(src.dtypes)[key]}, vector array<double>")


def expand(rows: DataFrame, key: str, masked: str, k: int = 10, make: Callable[[], Embedder] = HashEmbedder, batch: int = 32) -> DataFrame:
    """key, expansion: the k most probable tokens for each sentence's mask."""

    ready(rows.sparkSession)

    def run(batches):
        own = make()
        kind = pa.list_(pa.struct([("tok", pa.string()), ("p", pa.float64())]))
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                found = [[{"tok": t, "p": p} for t, p in x] for x in own.expand([m or "" for m in part["_m"].to_pylist()], k)]
                yield pa.RecordBatch.from_arrays([part[key], pa.array(found, kind)], [key, "expansion"])

    src = rows.select(key, F.col(masked).alias("_m"))
    return src.mapInArrow(run, f"{key} {dict(src.dtypes)[key]}, expansion array<struct<tok:string,p:double>>")


def pooled(pieces: list[list[float]], of_word: list[int]) -> list[list[float]]:
    """A word's vector: the mean of its pieces' vectors."""
    out: dict[int, list] = {}
    for v, w in zip(pieces, of_word):
        out.setdefault(w, []).append(v)
    return [np.mean(out[w], 0).tolist() for w in sorted(out)]


def windows(n: int, size: int = 510) -> list[tuple[int, int]]:
    """Spans of at most size pieces, each half a size on, that cover n."""
    out, at = [], 0
    while True:
        out.append((at, min(n, at + size)))
        if at + size >= n:
            return out
        at += size // 2


def dump(x) -> str:
    return json.dumps(x, ensure_ascii=False, sort_keys=True)
