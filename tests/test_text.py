"""Scalar expressions on their edge cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column).first()[0]


@pytest.mark.parametrize(("given", "wanted"), [(" a ", "a"), ("\xa0a\x1c", "a"), ("​a", "​a"), (None, None), (" \n", "")])
def test_strip(spark, given, wanted):
    assert one(spark, X.strip("v"), given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [(" /a/b/ ", "a/b"), ("a\\b", "a/b"), ("/ a /", " a "), (None, ""), ("", "")])
def test_path(spark, given, wanted):
    assert one(spark, X.normalize_path("v"), given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("32", "32"), ("32.0", "32"), (" 32 ", "32"), ("32.9", "32"), ("-3.7", "-3"), ("1e2", "100"), ("nan", "nan"), ("inf", "inf"), ("32d", "32d"), ("\xa07", "7"), (None, None), ("iv", "iv")])
def test_page(spark, given, wanted):
    assert one(spark, X.normalize_page("v"), given) == wanted


HITS = [(1, "a.pdf", 4, "pdf"), (2, "b.txt", 1, "txt"), (3, "a.pdf", 4, "pdf"), (4, "c.pdf", 2, "pdf")]


@pytest.mark.parametrize(
    ("answer", "body", "cited"),
    [
        ("x\nCITED: 1,3", "x", [("a.pdf", 4)]), ("x cited: none", "x", []), ("x", "x", []), ("x CITED:", "x CITED:", []), ("x CITED: [1]", "x CITED: [1]", []), ("x CITED: 1.", "x CITED: 1.", []),
        ("x CITED: 0,99", "x", []), ("EXCITED: 1", "EX", [("a.pdf", 4)]), ("x CITED: 4 2", "x", [("c.pdf", 2), ("b.txt", None)]), ("CITED: 1\nCITED: 2", "CITED: 1", [("b.txt", None)]), ("x CITED: ,", "x", []),
        ("x\nCITED: ٣, ۱", "x", [("a.pdf", 4)]), ("x CITED: ４", "x", [("c.pdf", 2)]), ("x CITED: 𝟐", "x", [("b.txt", None)]),
    ],
)
def test_citations(spark, answer, body, cited):
    df = spark.createDataFrame([(answer, HITS)], "a string, h array<struct<rank:int,file:string,page:int,kind:string>>")
    r = df.select(X.without_trailer("a").alias("b"), X.cited_hits("a", F.col("h")).alias("c")).first()
    assert (r.b, [tuple(c) for c in r.c]) == (body, cited)


@pytest.mark.parametrize(
    ("reply", "score", "status"),
    [
        ('{"reasoning":"ok","similarity_score":4,"is_refusal":false,"is_hallucination":true}', 4, "json"),
        ('```json\n{"similarity_score": 3}\n```', 3, "json"), ('text {"similarity_score": 2 /* c */} more', 2, "json"), ('{"similarity_score": 5 // five\n}', 5, "json"),
        ('{"reasoning":"see http://x.y","similarity_score":4}', 4, "fields"), ('{"reasoning":"a "quote" here","similarity_score":1,"is_hallucination": true}', 1, "fields"),
        ('{"similarity_score":"5"}', None, "error"), ('{"similarity_score":4.5}', 4.5, "json"), ('{"reasoning":"x"}', None, "error"), ("no braces", None, "error"), ('"similarity_score": 4', 4, "fields"), ('I say "similarity_score": 2, "is_refusal": true', 2, "fields"), ("", None, "error"), (None, None, "error"),
    ],
)
def test_judgement(spark, reply, score, status):
    r = one(spark, X.parse_judgement("v"), reply)
    assert (r.similarity_score, r.status) == (score, status)


def test_judgement_flags(spark):
    r = one(spark, X.parse_judgement("v"), '{"reasoning":"a "b" c","similarity_score":1,"is_refusal":True,"is_hallucination": true}')
    assert (r.is_refusal, r.is_hallucination, r.status) == (False, True, "fields")


def result(spark, cited, groups):
    kind = "c array<struct<file:string,page:string>>, g array<struct<any_of:array<struct<file:string,page:string>>>>"
    return spark.createDataFrame([(cited, groups)], kind).select(X.citation_result(F.col("c"), F.col("g"))).first()[0]


def test_citation_result(spark):
    group = lambda *pages: (list(pages),)
    assert result(spark, [], [group(("a", "32"))]).score == 0
    r = result(spark, [(" /a/ ", "32.0")], [group(("a", "32"))])
    assert (r.score, r.is_fully_correct, r.satisfied_groups_count, tuple(r.details[0].matched_with)) == (1.0, True, "1/1", (" /a/ ", "32.0"))
    assert result(spark, [("a", None)], [group(("a", None)), group(("b", "1"))]).score == 0.5
    assert result(spark, None, []).score == 1.0
    assert result(spark, [("a", "1")], [(None,)]).score == 0
    assert result(spark, [("b", "1"), ("a", "1")], [group(("a", "1"), ("b", "1"))]).details[0].matched_with.file == "a"


def test_numbers(spark):
    assert one(spark, X.unit("v"), [3.0, 4.0], "array<float>") == [0.6, 0.8]
    assert one(spark, X.in_confidence_range("v"), float("nan"), "double") is False
    assert X.model_prefix("my-E5-model", "query") == "query: " and X.model_prefix("other", "query") == ""


def test_round3_is_that_of_the_binary_value(spark):
    rng = random.Random(1)
    values = [0.1235, 0.0005, 0.0015, 2.5, 0.1245, -0.1235, 0.0, 1e-9, 123456.7895, 0.3125, 0.8125, 1e15, -0.0005] + [rng.randint(0, 20000) / 20000 for _ in range(500)] + [rng.random() for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.round3("v").alias("r")).collect()
    assert [(r.v, r.r) for r in rows if r.r != round(r.v, 3)] == []
