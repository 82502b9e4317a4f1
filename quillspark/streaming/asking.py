"""Questions as a stream: answered batch by batch with exactly one answer an id, and counted by the time they were asked."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.lineage import cut
from quillspark.operators.embed import Encoder
from quillspark.operators.evaluate import pending
from quillspark.operators.generate import Generator
from quillspark.plans.answering import answer_questions


def answer_stream(questions: DataFrame, index: DataFrame, encoder: Encoder, generator: Generator, out: str, checkpoint: str, k: int = 5) -> StreamingQuery:
    """Appends answers to ``out`` as questions arrive. Each batch is written to a place of its own by its number and a repeated batch
    replaces it, so that a lost run resumes without gaps or repeats."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = cut(batch.select("id", "question").dropDuplicates(["id"]))
        try:
            done = spark.read.parquet(out).select("id", "batch").where(F.col("batch") != number)
            # Only answers of this batch's ids are looked for; the ids alone are read.
            new = pending(new, done.join(new.select("id"), "id", "left_semi"))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        answer_questions(new, index, encoder, generator, k).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return questions.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def asked_per_window(requests: DataFrame, window: str = "1 hour", late: str = "6 hours") -> DataFrame:
    """Questions asked by window, each id once; those received over ``late`` after the latest are dropped from a stream. An extension."""
    timed = requests.withColumn("asked", F.col("asked_at").cast("timestamp"))
    if requests.isStreaming:
        timed = timed.withWatermark("asked", late).dropDuplicatesWithinWatermark(["id"])
    else:
        timed = timed.groupBy("id").agg(F.min("asked").alias("asked"))
    return timed.groupBy(F.window("asked", window).alias("w")).agg(F.count(F.lit(1)).alias("asked")).select(F.col("w.start").alias("window_start"), "asked")
