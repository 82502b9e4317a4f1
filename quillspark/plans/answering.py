"""Whole runs: answering questions with or without retrieval, serving one question, resuming a submission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.lineage import cut, cut_clean, written
from quillspark.functions.text import cited_hits, round3, token_cost, without_trailer
from quillspark.operators.embed import Encoder, embed
from quillspark.operators.evaluate import evaluate, latest, pending
from quillspark.operators.generate import Call, Generator, generate, generate_from, judge, prompts, replay
from quillspark.operators.retrieve import top_k, with_records


def answers_of(replies: DataFrame, hits: DataFrame) -> DataFrame:
    """Answers (id, answer, citations, retrieved, latency_ms, tokens, endpoint_error) of replies and the hits they were given."""
    of = hits.groupBy(F.col("q_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "file", "page", "kind", "score"))).alias("hits"))
    none = F.array().cast("array<struct<rank:int,file:string,page:int,kind:string,score:double>>")
    x = replies.join(of, "id", "left").withColumn("hits", F.coalesce("hits", none))
    return x.select(
        "id", F.coalesce(without_trailer("reply"), F.lit("")).alias("answer"), F.coalesce(cited_hits("reply", F.col("hits")), F.array().cast("array<struct<file:string,page:int>>")).alias("citations"),
        F.transform("hits", lambda h: F.struct(h["file"].alias("file"), h["page"].alias("page"), round3(h["score"]).alias("score"))).alias("retrieved"),
        "latency_ms", F.struct(F.col("prompt_tokens").alias("prompt"), F.col("completion_tokens").alias("completion")).alias("tokens"), F.col("error").alias("endpoint_error"),
    )


def answer_questions(questions: DataFrame, index: DataFrame, encoder: Encoder, generator: Generator | DataFrame, k: int = 5, call: Call | None = None) -> DataFrame:
    """Answers of all questions (id, question): embed, retrieve, prompt, generate, cite. ``generator``: a model, or recorded replies.
    k = 0 asks without sources. Hits and replies are written on the way: they are read twice, and no model is asked twice."""
    if not k:
        hits = index.sparkSession.createDataFrame([], "q_id string, rank int, chunk_id string, score double, file string, page int, kind string, text string")
        asked = prompts(questions, hits)
        return answers_of(replay(asked, generator) if isinstance(generator, DataFrame) else cut(generate(asked, generator, call)), hits)
    top = written(top_k(embed(questions.select("id", F.col("question").alias("text")), encoder, "query"), index, k), "hits")
    replies = replay(questions, generator) if isinstance(generator, DataFrame) else cut_clean(generate_from(questions, top, index, generator, call))
    return answers_of(replies, with_records(top, index.select("id", "file", "page", "kind", "embedding")))


def evaluate_with(questions: DataFrame, answers: DataFrame, model: Generator | DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, summary) of evaluate, with the verdicts of a judging model or of recorded replies; of several answers of an id the last counts."""
    last = latest(answers)
    return evaluate(questions, last, judge(questions, last, model).where("reply is not null").select("id", "reply"), strict)


def health() -> dict[str, str]:
    return {"status": "ok"}


def checked_requests(requests: DataFrame) -> DataFrame:
    """``requests`` with ``problem``: null for one that can be answered. A question is needed, a session isn't."""
    return requests.withColumn("problem", F.when(F.col("question").isNull(), "question: field required"))


def responses(answers: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """(id, answer, citations, domain, confidence, latency_ms, cost_usd) as a service returns them. ``hits`` (q_id, rank, file, page, domain,
    score, text) give the citations' quotes, the domain of the best hit, and its score as the confidence, kept within its range."""
    cited = F.transform("citations", lambda c: F.struct(c["file"].alias("file"), c["page"].alias("page"), F.lit(None).cast("string").alias("quote")))
    out = answers.withColumn("cost_usd", token_cost("tokens.prompt", "tokens.completion"))
    if hits is None:
        return out.select("id", "answer", cited.alias("citations"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("confidence"), "latency_ms", "cost_usd")
    of = hits.groupBy(F.col("q_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "file", "page", "domain", "score", "text"))).alias("hits"))
    quote = lambda c: F.get(F.filter("hits", lambda h: (h["file"] == c["file"]) & (c["page"].isNull() | (h["page"] == c["page"]))), F.lit(0))["text"]
    quoted = F.transform("citations", lambda c: F.struct(c["file"].alias("file"), c["page"].alias("page"), quote(c).alias("quote")))
    first = F.get("hits", F.lit(0))
    return out.join(of, "id", "left").select(
        "id", "answer", F.coalesce(quoted, cited).alias("citations"), first["domain"].alias("domain"), F.least(F.greatest(first["score"], F.lit(0.0)), F.lit(1.0)).alias("confidence"), "latency_ms", "cost_usd"
    )


def ask(index: DataFrame, question: str, encoder: Encoder, generator: Generator, k: int = 5, session_id: str | None = None) -> DataFrame:
    """The response to one question, as one row: what a service would return; ``session_id`` comes back with it."""
    if question is None:
        raise ValueError("question: field required")
    one = index.sparkSession.createDataFrame([("ask", question)], "id string, question string")
    hits = cut(with_records(top_k(embed(one.select("id", F.col("question").alias("text")), encoder, "query"), index, k), index)) if k else None
    answers = answers_of(cut(generate(prompts(one, hits), generator)), hits) if k else answer_questions(one, index, encoder, generator, 0)
    return responses(answers, hits).withColumn("session_id", F.lit(session_id).cast("string"))


def submit(questions: DataFrame, done: DataFrame, index: DataFrame, encoder: Encoder, generator: Generator, k: int = 5, retry_failed: bool = False) -> DataFrame:
    """Answers of the questions not yet in ``done``, to be appended to it; failures are rows with an error and an empty answer."""
    return answer_questions(pending(questions, done, retry_failed), index, encoder, generator, k)
