"""Model-backed enrichment: two calls for each row (reason, then put into a schema), validation, retries, resuming."""

from __future__ import annotations

import json
import queue
import re
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.columns import valid_json
from ..functions.words import GROUPS, RELATIONS, ROLES, STANCES
from ..sources.tables import ready, shared_folder
from .answers import AnswerLog
from .plugs import LLMClient

_THOUGHT = re.compile(r"<think>(.*?)</think>", re.S)


def split_thinking(response: str) -> tuple[str, str]:
    """(thought, answer): the first thinking section, and the response without it."""
    m = _THOUGHT.search(response)
    return (m[1].strip(), response.replace(m[0], "").strip()) if m else ("", response.strip())


@dataclass(frozen=True)
class Task:
    """A prompt pair and the schema of its answer. check says whether a parsed answer is valid."""

    system: str
    format_system: str
    schema: dict
    check: Callable[[dict], bool]
    tries: int = 5


#: Calls that a task has open at a time, and the seconds that it waits after an error, doubled from try to try.
CONCURRENCY, BACKOFF, LONGEST_WAIT = 4, 0.5, 30.0


def ask(rows: DataFrame, key: str, prompt: str, task: Task, reason: Callable[[], LLMClient], shape: Callable[[], LLMClient], *, concurrency: int = CONCURRENCY, backoff: float = BACKOFF, log: str | None = None) -> DataFrame:
    """key, reason, answer (JSON; null after all tries failed).

    Rows are spread over as many tasks as there are shuffle partitions. A task has some calls open at a time, each with
    clients of its own, made once. An error in one row is one failed try of that row, after which the call waits.

    Valid answers go to a log in the shared folder as they come, by a digest of the key and all that is asked. A task that
    runs again, or a later action on the same result, reads them there and asks only for what is missing. With log, a folder
    that all tasks can open, answers serve later runs, too; it should be one for each pair of models. In a folder that
    workers can't open themselves nothing is kept.
    """
    spark = ready(rows.sparkSession)
    kept = log or f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    asked = json.dumps([task.system, task.format_system, task.schema])
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def once(clients: queue.SimpleQueue, text: str | None) -> tuple[str | None, str | None]:
        thought = answer = None
        if text is not None:
            thinker, shaper = clients.get()
            try:
                for i in range(task.tries):
                    try:
                        thought, draft = split_thinking(thinker.chat(task.system, text))
                        parsed = json.loads(split_thinking(shaper.chat(task.format_system, draft, task.schema))[1])
                        if task.check(parsed):
                            answer = json.dumps(parsed, ensure_ascii=False)
                            break
                    except ValueError:
                        continue  # not JSON: asked again at once
                    except Exception:  # noqa: BLE001  a plug may fail in any way
                        if i + 1 < task.tries:
                            time.sleep(min(LONGEST_WAIT, backoff * 2**i))
            finally:
                clients.put((thinker, shaper))
        return thought, answer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers, clients = AnswerLog(kept), None
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, 4 * concurrency):
                    part = batch.slice(at, 4 * concurrency)
                    digests = part["_digest"].to_pylist()
                    got = [answers.get(b, d) for b, d in zip(part["_bucket"].to_pylist(), digests)]
                    open_ = [i for i, x in enumerate(got) if x is None]
                    if open_ and clients is None:
                        clients = queue.SimpleQueue()
                        for _ in range(concurrency):
                            clients.put((reason(), shape()))
                    texts = part["_prompt"].to_pylist()
                    fresh: dict[int, list[dict]] = {}
                    for i, (thought, answer) in zip(open_, pool.map(lambda i: once(clients, texts[i]), open_)):
                        got[i] = {"key": digests[i], "reason": thought, "answer": answer}
                        if answer is not None:
                            fresh.setdefault(part["_bucket"][i].as_py(), []).append(got[i])
                    for bucket, records in fresh.items():
                        answers.add(bucket, records)
                    yield pa.RecordBatch.from_arrays([part[key], pa.array([x["reason"] for x in got], pa.string()), pa.array([x["answer"] for x in got], pa.string())], [key, "reason", "answer"])

    digest = F.sha2(F.concat_ws("\x00", F.lit(asked), F.col(key).cast("string"), "_prompt"), 256)
    src = rows.select(key, F.col(prompt).alias("_prompt")).withColumn("_digest", digest)
    src = src.withColumn("_bucket", F.pmod(F.xxhash64("_digest"), F.lit(buckets)).cast("int")).repartition(buckets, "_bucket")
    return src.mapInArrow(run, f"{key} {dict(src.dtypes)[key]}, reason string, answer string")


def _enum(*values: str) -> dict:
    return {"type": "string", "enum": list(values)}


CAUSAL = Task(
    "Two events of one text are given, each a verb and an object with its sentence. Decide whether the text says that one of them brings the other about, whichever comes first. Give your reasons.",
    "Put the verdict into the schema: causal or none.",
    {"type": "object", "properties": {"prediction": _enum(*RELATIONS)}, "required": ["prediction"]},
    lambda x: x.get("prediction") in RELATIONS,
)
SENTENCE = Task(
    "A text and a causal chain of two of its events are given. Write one sentence that says what happened, using only what the text says about these events.",
    "Put the sentence into the schema.",
    {"type": "object", "properties": {"sentence": {"type": "string"}}, "required": ["sentence"]},
    lambda x: bool(isinstance(x.get("sentence"), str) and x["sentence"].strip()),
)
THEME = Task(
    "Sentences of one group are given, numbered. Say whether they share a framing pattern, and if so its central theme in one sentence, with its issue, evaluation and resolution as parts of that sentence.",
    "Put the finding into the schema.",
    {"type": "object", "properties": {"framing_pattern_detected": {"type": "boolean"}, "theme": {"type": "string"}, "framing_elements": {"type": "object", "properties": {p: {"type": ["string", "null"]} for p in ("issue", "evaluation", "resolution")}}}, "required": ["framing_pattern_detected", "theme", "framing_elements"]},
    lambda x: isinstance(x.get("framing_pattern_detected"), bool) and isinstance(x.get("theme"), str) and isinstance(x.get("framing_elements"), dict),
)


def characters_task(domain: str) -> Task:
    groups = GROUPS[domain]
    one = {"type": "object", "properties": {"entity": {"type": "string"}, "character_group": _enum(*groups), "role": _enum(*ROLES)}, "required": ["entity", "character_group", "role"]}
    good = lambda c: c.get("character_group") in groups and c.get("role") in ROLES and isinstance(c.get("entity"), str)
    return Task(
        "A sentence about two events and the text that it comes from are given. List the people and bodies that the sentence names, no places, each with its group and its most prominent role, and the sentence's stance. Groups: " + ", ".join(groups),
        "Put the findings into the schema.",
        {"type": "object", "properties": {"characters": {"type": "array", "items": one}, "stance": _enum(*STANCES)}, "required": ["characters", "stance"]},
        lambda x: x.get("stance") in STANCES and isinstance(x.get("characters"), list) and all(good(c) for c in x["characters"]),
    )


def classify_pairs(pairs: DataFrame, texts: DataFrame, reason, shape) -> DataFrame:
    """Adds reason and relation to event pairs (pair_id, doc_id, e1, e2)."""
    show = lambda e: F.concat(F.lit("("), F.col(f"{e}.verb"), F.lit(", "), F.col(f"{e}.object"), F.lit(")"))
    rows = pairs.join(texts.select("doc_id", "text"), "doc_id").withColumn("_p", F.concat_ws("\n", F.lit("Text:"), "text", F.lit("Events:"), show("e1"), show("e2")))
    got = ask(rows, "pair_id", "_p", CAUSAL, reason, shape)
    verdict = valid_json("answer", "prediction STRING", {"prediction": RELATIONS})["prediction"]
    return pairs.join(got.select("pair_id", "reason", verdict.alias("relation")), "pair_id")


def verbalize(chains: DataFrame, reason, shape) -> DataFrame:
    """Adds chain_text to chains (chain_id, event_chain, excerpt or null, text)."""
    rows = chains.withColumn("_p", F.concat_ws("\n", F.lit("Text:"), F.coalesce("excerpt", "text"), F.lit("Chain:"), "event_chain"))
    got = ask(rows, "chain_id", "_p", SENTENCE, reason, shape)
    return chains.join(got.select("chain_id", F.from_json("answer", "sentence STRING")["sentence"].alias("chain_text")), "chain_id")


ANNOTATION = "characters ARRAY<STRUCT<entity:STRING,character_group:STRING,role:STRING>>, stance STRING"


def annotate_characters(chains: DataFrame, domain: str, reason, shape) -> DataFrame:
    """Adds annotation to chains (chain_id, chain_text, excerpt or null, text); null where no try succeeded."""
    rows = chains.withColumn("_p", F.concat_ws("\n", F.lit("Text:"), F.coalesce("excerpt", "text"), F.lit("Sentence:"), "chain_text"))
    got = ask(rows, "chain_id", "_p", characters_task(domain), reason, shape)
    checked = valid_json("answer", ANNOTATION, {"stance": STANCES, "characters[].role": ROLES, "characters[].character_group": GROUPS[domain]})
    return chains.join(got.select("chain_id", checked.alias("annotation")), "chain_id")


def cluster_themes(chains: DataFrame, reason, shape, most: int = 25, seed: int = 0, centers: DataFrame | None = None, percent: float = 50.0) -> DataFrame:
    """cluster, framing_pattern_detected, theme, framing_elements from the sample of each cluster (cluster, doc_id, chain_id,
    chain_text), at most `most` chains, of different documents first. With centers, chains have id and vector, too, and
    samples are from the percent % of each cluster that lie closest to its centre."""
    from .clusters import closest_share
    from .sampling import diverse_sample

    if centers is not None:
        chains = closest_share(chains, centers, percent).drop("distance", "rank")
    sample = diverse_sample(chains, most, by="cluster", seed=seed)
    order = W.partitionBy("cluster").orderBy(F.xxhash64("chain_id", F.lit(seed)), "chain_id")
    lines = sample.withColumn("_n", F.row_number().over(order)).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("_n", "chain_text"))).alias("_l"))
    rows = lines.select("cluster", F.concat_ws("\n", F.transform("_l", lambda x: F.format_string("%d. %s", x["_n"], x["chain_text"]))).alias("_p"))
    got = ask(rows, "cluster", "_p", THEME, reason, shape)
    x = F.from_json("answer", "framing_pattern_detected BOOLEAN, theme STRING, framing_elements STRUCT<issue:STRING,evaluation:STRING,resolution:STRING>")
    return got.withColumn("x", x).select("cluster", "x.framing_pattern_detected", "x.theme", "x.framing_elements")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that have no result yet."""
    return rows.join(done.select(key), key, "left_anti")


def resume(spark: SparkSession, rows: DataFrame, key: str, path: str, work: Callable[[DataFrame], DataFrame], batches: int = 1) -> DataFrame:
    """Results of work for all rows, kept in a Parquet table at path. Rows that are there already are not worked on again.

    Each batch is appended as a whole by the commit protocol, so what an interrupted run had finished stays.
    """
    from pyspark.sql.utils import AnalysisException

    def stored() -> DataFrame | None:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    for b in range(batches):
        own = rows if batches == 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(batches)) == b)
        have = stored()
        work(own if have is None else pending(own, have, key)).write.mode("append").parquet(path)
    return stored()
