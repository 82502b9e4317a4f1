"""Prompts, and models behind small interfaces: a generator answers prompts, a judge compares answers."""

from __future__ import annotations

import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How sources stand in a prompt.
SOURCE_GAP = "\n\n---\n\n"
#: Prompts made at once; questions of one best hit that are asked in one task.
PROMPTS, OFTEN = 500, 2000

#: Instructions by version, in our own words; which one serves best is for experiments to say.
SYSTEM_PROMPTS = {
    "v1": "Answer the customer's question.",
    "v2": "Answer the customer's question from the sources only. Say so if they do not hold the answer.",
    "v3": "Answer from the numbered sources only, briefly and in the language of the question. Say so if they do not hold the answer.",
    "v4": "Answer from the numbered sources only, briefly, in the language of the question. If they do not hold the answer, say so and do not guess. "
    "End with a line 'CITED:' and the numbers of the sources used, separated by commas, or 'CITED: none'.",
}
DEFAULT_PROMPT = "v4"


@dataclass(frozen=True)
class Call:
    """How a model is asked: its instructions, limits on its reply, seconds it may take, and prompts of a task that are under way at once."""

    system: str = SYSTEM_PROMPTS[DEFAULT_PROMPT]
    max_tokens: int = 1024
    temperature: float = 0.2
    timeout: float = 120.0
    at_once: int = 8


#: How a judge is asked: it compares, so it should not vary.
JUDGE = Call(
    "Compare the candidate with the ground truth. Reply with a JSON object of reasoning (text), similarity_score (1 to 5, whole), is_refusal and is_hallucination (true or false).",
    temperature=0.0, timeout=180.0,
)


class Generator(Protocol):
    """reply: (text, prompt tokens, completion tokens) for a prompt; an exception is recorded as the row's error. Called by several threads."""

    def reply(self, id: str, prompt: str, call: Call) -> tuple[str, int, int]: ...


class EchoGenerator:
    """Deterministic stand-in for a model: the first source's first sentence, cited if the instructions ask for that."""

    def reply(self, id: str, prompt: str, call: Call) -> tuple[str, int, int]:
        body = prompt.split("\n", 1)[-1].split(". ")[0].strip()
        return f"{body}." + "\nCITED: 1" * ("CITED" in call.system), len(prompt.split()), len(body.split())


class OverlapJudge:
    """Deterministic stand-in for a judge: the share of the true answer's words that the candidate has."""

    def reply(self, id: str, prompt: str, call: Call) -> tuple[str, int, int]:
        truth, _, said = prompt.removeprefix("Ground truth:\n").partition("\n\nCandidate:\n")
        words, has = set(truth.lower().split()), set(said.lower().split())
        score = 1 + round(4 * len(words & has) / max(1, len(words)))
        return f'{{"reasoning": "words in common", "similarity_score": {score}, "is_refusal": {str(not has).lower()}, "is_hallucination": {str(score == 1).lower()}}}', len(prompt.split()), 4


def route_model(model: str, base_url: str | None = None) -> str:
    """The model's id as the client library wants it: with a base URL always of the openai kind, else only if it names no kind."""
    bare = model.removeprefix("openai/")
    return f"openai/{bare}" if base_url or "/" not in model else model


def prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, prompt): the question after its numbered sources in the order of rank; ``hits``: q_id, rank, file, page, text. A question
    without hits gets a prompt without sources. A web page's source shows its page too."""
    source = F.format_string("[%d] file: %s | page: %s\n%s", "rank", "file", F.col("page").cast("string"), "text")
    of = hits.groupBy(F.col("q_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", source.alias("s")))).alias("x"))
    joined = questions.select("id", "question").join(of, "id", "left")
    text = F.concat_ws(SOURCE_GAP, F.transform("x", lambda e: e["s"]))
    return joined.select("id", F.concat(text, F.when(F.size("x") > 0, F.lit("\n\n")).otherwise(F.lit("")), F.lit("Question: "), "question").alias("prompt"))


def judge_prompts(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, prompt) for the judge: the true answer and the candidate, without the question."""
    return questions.select("id", "ground_truth_answer").join(answers.select("id", "answer"), "id").select(
        "id", F.format_string("Ground truth:\n%s\n\nCandidate:\n%s", F.coalesce("ground_truth_answer", F.lit("")), F.coalesce("answer", F.lit(""))).alias("prompt")
    )


_REPLIES = "id string, reply string, prompt_tokens int, completion_tokens int, latency_ms double, error string"


def _asking(generator: Generator, call: Call):

    def one(i: str, prompt: str) -> tuple:
        began = time.perf_counter()
        try:
            text, n_in, n_out = generator.reply(i, prompt, call)
            took = time.perf_counter() - began
            error = f"TimeoutError: {took:.0f} s" if took > call.timeout else None
        except Exception as e:
            text, n_in, n_out, took, error = None, None, None, time.perf_counter() - began, f"{type(e).__name__}: {e}"
        return (i, None, None, None, took * 1000, error) if error else (i, text, n_in, n_out, took * 1000, None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(call.at_once) as pool:
            for b in batches:
                asked = [(i, pool.submit(one, i, p)) for i, p in zip(b.id, b.prompt, strict=True)]
                rows = []
                for i, f in asked:
                    try:  # in its turn: what waits for a free thread has its time still before it
                        rows.append(f.result(call.timeout * (1 + len(asked) / call.at_once)))
                    except TimeoutError:
                        rows.append((i, None, None, None, call.timeout * 1000, f"TimeoutError: {call.timeout:.0f} s"))
                frame = pd.DataFrame(rows, columns=["id", "reply", "prompt_tokens", "completion_tokens", "latency_ms", "error"])
                yield frame.astype({"prompt_tokens": "Int32", "completion_tokens": "Int32"})

    return run


def generate(prompts: DataFrame, generator: Generator, call: Call | None = None) -> DataFrame:
    """(id, reply, prompt_tokens, completion_tokens, latency_ms, error), several prompts of a task at once. A reply that takes too long is an
    error too. Write it before it's used twice, or the model is asked twice."""
    return prompts.select("id", "prompt").mapInPandas(_asking(generator, call or Call()), _REPLIES)


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Prompts of sorted rows (grp, role, chunk_id, file, page, text, id, question, hits), a group's records first."""
    group, held = None, {}
    for batch in batches:
        for at in range(0, batch.num_rows, PROMPTS):
            ids, made = [], []
            for grp, role, chunk, file, page, text, i, question, hits in zip(*(c.to_pylist() for c in batch.slice(at, PROMPTS).columns), strict=True):
                if grp != group:
                    group, held = grp, {}
                if not role:
                    held.setdefault(chunk, []).append(f"] file: {'null' if file is None else file} | page: {'null' if page is None else page}\n{'null' if text is None else text}")
                    continue
                sources = [f"[{rank}{s}" for rank, h in enumerate(hits or [], 1) for s in sorted(held.get(h, ()))]
                ids.append(i)
                made.append(None if question is None else SOURCE_GAP.join(sources) + "\n\n" * bool(sources) + "Question: " + question)
            if ids:
                yield pd.DataFrame({"id": ids, "prompt": made}, dtype=object)


def generate_from(questions: DataFrame, top: DataFrame, index: DataFrame, generator: Generator, call: Call | None = None) -> DataFrame:
    """What generate gives for the prompts of questions (id, question) and their hits ``top`` (q_id, rank from 1, chunk_id), of records of ``index``
    (id, file, page, text). Questions of one best hit are asked in one task, to which a record's text is sent once, not once a hit; those
    of a best hit that very many have are shared out."""
    n = int(top.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = top.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("x")).select(F.col("q_id").alias("id"), F.col("x.chunk_id").alias("hits"))
    often = top.where("rank = 1").groupBy("chunk_id").count().where(F.col("count") > OFTEN).select(F.col("chunk_id").alias("first"), F.ceil(F.col("count") / OFTEN).alias("n"))
    asked = questions.select("id", "question").join(of, "id", "left").withColumn("first", F.get("hits", F.lit(0))).join(often, "first", "left")
    key = F.xxhash64("first", F.when(F.col("first").isNull() | F.col("n").isNotNull(), F.pmod(F.xxhash64("id"), F.coalesce("n", F.lit(n)))))
    asked = asked.select(F.pmod(key, F.lit(n)).cast("int").alias("grp"), "id", "question", "hits")
    wanted = asked.select("grp", F.explode("hits").alias("chunk_id")).distinct()
    records = index.select(F.col("id").alias("chunk_id"), "file", F.col("page").cast("string").alias("page"), "text").join(wanted, "chunk_id")
    kind = top.schema["chunk_id"].dataType.simpleString()
    layout = ("grp", "role", "chunk_id", "file", "page", "text", "id", "question", "hits")
    own = records.select("grp", F.lit(0).alias("role"), "chunk_id", "file", "page", "text", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("question"), F.lit(None).cast(f"array<{kind}>").alias("hits"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("chunk_id", kind), ("file", "string"), ("page", "string"), ("text", "string"))]
    laid = own.select(*layout).unionByName(asked.select("grp", F.lit(1).alias("role"), *none, "id", "question", "hits").select(*layout))
    ask, schema = _asking(generator, call or Call()), pa.schema([("id", pa.string()), ("reply", pa.string()), ("prompt_tokens", pa.int32()), ("completion_tokens", pa.int32()), ("latency_ms", pa.float64()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in ask(_assembled(batches)):
            yield pa.RecordBatch.from_pandas(frame, schema, preserve_index=False)

    return laid.repartitionById(n, "grp").sortWithinPartitions("grp", "role").mapInArrow(run, _REPLIES)


def judge(questions: DataFrame, answers: DataFrame, judge: Generator | DataFrame, call: Call = JUDGE) -> DataFrame:
    """Verdicts (id, reply, error) on all answered questions, by a model or by recorded replies of the role "judge"."""
    asked = judge_prompts(questions, answers)
    replies = replay(asked, judge, "judge") if isinstance(judge, DataFrame) else generate(asked, judge, call)
    return replies.select("id", "reply", "error")


def replay(prompts: DataFrame, replies: DataFrame, role: str = "answer") -> DataFrame:
    """What generate gives, from recorded replies (id, role, reply, prompt_tokens, completion_tokens); a prompt without one has an error."""
    own = replies.where(F.col("role") == role).select("id", "reply", "prompt_tokens", "completion_tokens", F.lit(1).alias("known"))
    return prompts.select("id").join(own, "id", "left").select(
        "id", "reply", "prompt_tokens", "completion_tokens", F.lit(0.0).alias("latency_ms"), F.when(F.col("known").isNull(), "no recorded reply").alias("error")
    )
