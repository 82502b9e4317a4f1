"""Joining answers with true answers, scoring citations, and comparing runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import citation_result, parse_judgement

MISSING, UNKNOWN = "[missing]", "N/A"


def last_wins(df: DataFrame, key: str, order: str | Column) -> DataFrame:
    """The row of greatest ``order`` of each key, without gathering any key's rows."""
    return df.groupBy(F.col(key).alias("__key__")).agg(F.max_by(F.struct(*df.columns), order if isinstance(order, Column) else F.col(order)).alias("row")).select("row.*")


def latest(df: DataFrame, key: str = "id", order: str = "line") -> DataFrame:
    """One row a key: the last by ``order`` where there is such a column (of json_lines), else the greatest of all fields."""
    if order in df.columns:
        return last_wins(df, key, order)
    return last_wins(df, key, F.struct(*[c for c in df.columns if c != key]))


def pending(questions: DataFrame, done: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Questions whose id is in no answer yet; failures count as answered unless ``retry_failed``."""
    ids = done.where("endpoint_error is null") if retry_failed else done
    return questions.join(ids.select("id").distinct(), "id", "left_anti")


def citation_scores(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, is_fully_correct, score, satisfied_groups_count, details) of every question."""
    cited = questions.select("id", "ground_truth_sources").join(answers.select("id", "citations"), "id", "left")
    return cited.select("id", citation_result(F.col("citations").cast("array<struct<file:string,page:string>>"), F.col("ground_truth_sources")).alias("r")).select("id", "r.*")


def evaluate(questions: DataFrame, answers: DataFrame, verdicts: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, summary). ``verdicts`` (id, reply): the judge's replies. Of several answers or verdicts of an id the last counts (see latest). ``rows``: id, answer_score, citation_score, hallucinate, latency,
    parse_status, error; a question without answer or readable verdict has an error and no score. ``strict`` fails on the first
    error instead. A score of 1 is a hallucination. ``summary``: of summarize."""
    answers = latest(answers.select(*[c for c in ("id", "citations", "latency_ms", "line") if c in answers.columns]))
    judged = latest(verdicts.select(*[c for c in ("id", "reply", "line") if c in verdicts.columns])).select("id", parse_judgement("reply").alias("v"))
    rows = citation_scores(questions, answers).join(answers.select("id", "latency_ms", F.lit(True).alias("answered")), "id", "left").join(judged, "id", "left")
    error = F.when(F.col("answered").isNull(), "no answer").when(F.col("v").isNull() | (F.col("v.status") == "error"), "no readable verdict")
    score = F.col("v.similarity_score")
    rows = rows.select(
        "id", score.alias("answer_score"), F.col("score").alias("citation_score"), (score == 1).alias("hallucinate"), F.col("latency_ms").alias("latency"),
        F.coalesce("v.status", F.lit("error")).alias("parse_status"), error.alias("error"),
    )
    if strict:
        rows = rows.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.col("id"), F.lit(": "), F.col("error")))).otherwise(F.col("error")))
    return rows, summarize(rows)


def summarize(rows: DataFrame, *by: str) -> DataFrame:
    """count, avg_answer_score, hallucinations, hallucination_rate, avg_latency_ms; zeros for no rows. Grouped with ``by``, an extension."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    lied = F.count_if(F.col("answer_score") == 1)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), zero(F.avg("answer_score")).alias("avg_answer_score"), lied.alias("hallucinations"),
        zero(F.try_divide(lied.cast("double"), F.count(F.lit(1)))).alias("hallucination_rate"), zero(F.avg("latency")).alias("avg_latency_ms"),
    )


def report(questions: DataFrame, answers: DataFrame, evals: DataFrame) -> DataFrame:
    """(pos, id, question, expected, answer, score, citation_score, hallucinate): every question, in its place, with defaults for what's missing;
    of several answers or evaluations of an id the last counts (see latest)."""
    text = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other))
    answers, evals = latest(answers.select(*[c for c in ("id", "answer", "line") if c in answers.columns])), latest(evals.select(*[c for c in ("id", "answer_score", "citation_score", "hallucinate", "line") if c in evals.columns]))
    return questions.select("pos", "id", "question", "ground_truth_answer").join(answers.select("id", "answer"), "id", "left").join(
        evals.select("id", "answer_score", "citation_score", "hallucinate"), "id", "left"
    ).select(
        "pos", "id", "question", text("ground_truth_answer", MISSING).alias("expected"), text("answer", MISSING).alias("answer"), text("answer_score", UNKNOWN).alias("score"),
        text("citation_score", UNKNOWN).alias("citation_score"), text("hallucinate", UNKNOWN).alias("hallucinate"),
    )


# The layout of a question in the report; what stands above and below its id.
RULE = "=" * 80
LAYOUT = (
    "%1$s\nID: %2$s\n%1$s\n\nQUESTION:\n%3$s\n\nREFERENCE ANSWER:\n%4$s\n\nGENERATED ANSWER:\n%5$s\n\n"
    "SCORES:\n  answer_score:   %6$s\n  citation_score: %7$s\n  Hallucinate:    %8$s\n\n"
)


def report_lines(rows: DataFrame) -> DataFrame:
    """(pos, line): a block of text for every row of a report; a line break follows each when it is written."""
    return rows.select("pos", F.format_string(LAYOUT, F.lit(RULE), "id", "question", "expected", "answer", "score", "citation_score", "hallucinate").alias("line"))


def run_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, status, a, b): ids of one run only, and those of both whose ``hallucinate`` differs; null differs from false."""
    left, right = a.select("id", F.col("hallucinate").alias("a"), F.lit(1).alias("in_a")), b.select("id", F.col("hallucinate").alias("b"), F.lit(1).alias("in_b"))
    status = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return left.join(right, "id", "full").select("id", status.alias("status"), "a", "b").where("status is not null")
