"""Sources, retrieval, whole runs, evaluation and reports."""

from __future__ import annotations

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import evaluate as E
from quillspark.operators.embed import HashingEncoder, LazyEncoder, embed, embed_cached, missing
from quillspark.operators.generate import SYSTEM_PROMPTS, Call, EchoGenerator, OverlapJudge, generate, generate_from, prompts, replay, route_model
from quillspark.operators.retrieve import index_records, top_k, with_records
from quillspark.plans.answering import answer_questions, ask, checked_requests, evaluate_with, health, submit
from quillspark.sources import tables as S


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(f"d/files/f{k}.pdf#p1.0", f"d/files/f{k}.pdf", "d", "pdf", None, 1, 0, t) for k, t in enumerate(["red apple pie. More", "green apple", "blue whale song", "tax law of the land"])]
    chunks = spark.createDataFrame(rows, S.CHUNKS)
    return index_records(chunks, embed(chunks.select("id", "text"), HashingEncoder()))


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).round(1)
    x[50:60] = x[0]
    index = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, None)], "id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(k, x[k].tolist()) for k in range(0, 300, 20)] + [(901, None)], "id long, embedding array<float>")
    for records in (40, 100_000):
        got = {(r.q_id, r["rank"]): r.chunk_id for r in top_k(q, index, 7, records=records).collect()}
        f = x.astype(np.float32).astype(float)
        u = f / np.linalg.norm(f, axis=1, keepdims=True)
        for k in range(0, 300, 20):
            s = (u @ u[k]).round(9)
            order = sorted(range(300), key=lambda i: (-s[i], i))[:7]
            assert [got[k, r + 1] for r in range(7)] == order


def test_top_k_small(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<float>")
    assert top_k(index, index, 5).count() == 1
    assert top_k(index.where("false"), index, 5).count() == 0
    assert top_k(index, index.where("false"), 5).count() == 0


def test_top_k_repeated_records(spark):
    """Rows that repeat a record take no places of others, and equal vectors go by id."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 8))
    x[40:60] = x[7] * 2
    rows = [(f"r{k:03}", v.tolist()) for k, v in enumerate(x)]
    index = spark.createDataFrame(rows + rows[7:8] * 9 + rows[50:51] * 9 + [("bad", [float("nan")] * 8)], "id string, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(k % 4, x[[7, 100, 7, 150][k % 4]].tolist()) for k in range(8)], "id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for records in (50, 100_000):
        got = {(r.q_id, r["rank"]): r.chunk_id for r in top_k(q, index, 5, records=records).collect()}
        for n, k in enumerate((7, 100, 7, 150)):
            s = (u @ u[k]).round(9)
            assert [got.get((n, r + 1)) for r in range(5)] == [f"r{i:03}" for i in sorted(range(200), key=lambda i: (-s[i], i))[:5]]


def test_prompts_of_sources_sent_once(spark, corpus, monkeypatch):
    """A model is asked the same, however the sources reach it."""

    class PromptGenerator:
        def reply(self, id, prompt, call):
            return prompt + "", 1, 1

    monkeypatch.setattr("quillspark.operators.generate.OFTEN", 2)
    asked = [(f"{k:03}", t) for k, t in enumerate(["apple pie", "whale", "tax law", "apple", None, "song"] * 3)]
    q = spark.createDataFrame([*asked, ("none", "apple")], "id string, question string")
    twice = corpus.unionByName(corpus.limit(2).withColumn("page", F.lit(None).cast("int")))
    top = top_k(embed(spark.createDataFrame(asked, "id string, text string"), HashingEncoder(), "query"), twice, 3)
    columns = ("id", "reply", "prompt_tokens", "completion_tokens", "error")
    want = generate(prompts(q, with_records(top, twice)), PromptGenerator()).select(*columns).collect()
    got = generate_from(q, top, twice, PromptGenerator()).select(*columns).collect()
    assert len(got) == 19 and sorted(map(str, got)) == sorted(map(str, want))


def test_whole_run(spark, corpus):
    q = spark.createDataFrame([("001", "apple pie"), ("002", "whale")], "id string, question string")
    rows = {r.id: r for r in answer_questions(q, corpus, HashingEncoder(), EchoGenerator(), k=2).collect()}
    assert set(rows) == {"001", "002"}
    assert rows["001"].citations[0].page == 1 and len(rows["001"].retrieved) == 2 and "CITED" not in rows["001"].answer
    assert ask(corpus, "whale", HashingEncoder(), EchoGenerator()).count() == 1
    recorded = spark.createDataFrame([("001", "answer", "said\nCITED: 1", 3, 4)], "id string, role string, reply string, prompt_tokens int, completion_tokens int")
    again = {r.id: r for r in answer_questions(q, corpus, HashingEncoder(), recorded, k=1).collect()}
    assert again["001"].answer == "said" and again["002"].endpoint_error and again["002"].answer == ""
    bare = answer_questions(q, corpus, HashingEncoder(), EchoGenerator(), k=0).collect()
    assert all(r.retrieved == [] and r.citations == [] for r in bare)
    done = spark.createDataFrame([("001", "boom")], "id string, endpoint_error string")
    assert [r.id for r in submit(q, done, corpus, HashingEncoder(), EchoGenerator()).collect()] == ["002"]
    assert submit(q, done, corpus, HashingEncoder(), EchoGenerator(), retry_failed=True).count() == 2


def test_errors_are_rows(spark):
    class Broken:
        def reply(self, id, prompt, call):
            raise OSError("down")

    p = spark.createDataFrame([("1", "x")], "id string, prompt string")
    assert generate(p, Broken()).first().error == "OSError: down"
    assert replay(p, spark.createDataFrame([], "id string, role string, reply string, prompt_tokens int, completion_tokens int")).first().error


def test_prompts_in_order(spark):
    hits = spark.createDataFrame([("a", 2, "g", None, "T2"), ("a", 1, "f", 3, "T1")], "q_id string, rank int, file string, page int, text string")
    q = spark.createDataFrame([("a", "why?"), ("b", "how?")], "id string, question string")
    rows = {r.id: r.prompt for r in prompts(q, hits).collect()}
    assert rows["a"].startswith("[1] file: f | page: 3\nT1\n\n---\n\n[2]") and rows["b"] == "Question: how?"


@pytest.mark.parametrize(("model", "url", "routed"), [("m", None, "openai/m"), ("x/m", None, "x/m"), ("m", "u", "openai/m"), ("openai/m", "u", "openai/m"), ("x/m", "u", "openai/x/m")])
def test_route(model, url, routed):
    assert route_model(model, url) == routed


def test_embedding_cache(spark):
    items = spark.createDataFrame([("1", "a b"), ("2", "c")], "id string, text string")
    enc = HashingEncoder()
    stored = embed(items.where("id = '1'"), enc)
    assert [r.id for r in missing(items, stored, enc, "passage").collect()] == ["2"]
    changed = items.withColumn("text", F.concat("text", F.lit("!")))
    assert missing(changed, stored, enc, "passage").count() == 2
    assert embed_cached(items, stored, enc).count() == 2 == embed_cached(items, stored, enc, force=True).count()


def test_an_encoder_is_made_once_a_worker(spark):
    items = spark.createDataFrame([(str(k), f"word{k}") for k in range(40)], "id string, text string").repartition(8)
    made = {r.id: list(r.embedding) for r in embed(items, LazyEncoder("hashing-64", HashingEncoder)).collect()}
    assert made == {r.id: list(r.embedding) for r in embed(items, HashingEncoder()).collect()}
    calls = []
    lazy = LazyEncoder("own", lambda: calls.append(1) or HashingEncoder())
    assert (lazy.encode(["a"]) == lazy.encode(["a"])).all() and len(calls) == 1


def test_evaluation(spark):
    groups = [([("f", "1")],)]
    q = spark.createDataFrame([(0, "1", "q", "t", groups), (1, "2", "q", None, []), (2, "3", "q", "t", None)], f"pos int, id string, question string, ground_truth_answer string, ground_truth_sources {S.SOURCES}")
    a = spark.createDataFrame([("1", "x", [("/f", "1")], 5.0), ("2", "y", [], 7.0), ("9", "z", [], 1.0)], "id string, answer string, citations array<struct<file:string,page:string>>, latency_ms double")
    v = spark.createDataFrame([("1", '{"similarity_score": 1}'), ("2", "?")], "id string, reply string")
    rows, summary = E.evaluate(q, a, v)
    got = {r.id: r for r in rows.collect()}
    assert (got["1"].answer_score, got["1"].citation_score, got["1"].hallucinate, got["1"].error) == (1, 1.0, True, None)
    assert got["2"].error == "no readable verdict" and got["3"].error == "no answer"
    s = summary.first()
    assert (s["count"], s.avg_answer_score, s.hallucinations, round(s.hallucination_rate, 3), s.avg_latency_ms) == (3, 1.0, 1, 0.333, 6.0)
    assert tuple(E.evaluate(q.where("false"), a, v)[1].first()) == (0, 0.0, 0, 0.0, 0.0)
    with pytest.raises(Exception, match="no answer|no readable"):
        E.evaluate(q, a, v, strict=True)[0].collect()
    r = {x.id: x for x in E.report(q, a, rows).collect()}
    assert (r["2"].expected, r["3"].answer, r["3"].score, r["1"].hallucinate) == ("[missing]", "[missing]", "N/A", "true")
    lines = E.report_lines(E.report(q, a, rows)).orderBy("pos").collect()
    assert len(lines) == 3 and lines[0].line.startswith("=" * 80 + "\nID: 1\n" + "=" * 80 + "\n\nQUESTION:\nq\n\nREFERENCE ANSWER:\nt\n\n") and lines[2].line.endswith("  answer_score:   N/A\n  citation_score: 1.0\n  Hallucinate:    N/A\n\n")


def test_the_last_answer_counts(spark):
    q = spark.createDataFrame([(0, "1", "q", "t", [])], f"pos int, id string, question string, ground_truth_answer string, ground_truth_sources {S.SOURCES}")
    a = spark.createDataFrame([("1", "old", [], 5.0, 1), ("1", "new", [], 9.0, 2), ("1", "older", [], 1.0, 0)], "id string, answer string, citations array<struct<file:string,page:string>>, latency_ms double, line int")
    v = spark.createDataFrame([("1", '{"similarity_score": 1}', 1), ("1", '"similarity_score": 4', 2)], "id string, reply string, line int")
    rows, summary = E.evaluate(q, a, v)
    assert [(r.answer_score, r.latency) for r in rows.collect()] == [(4.0, 9.0)] and summary.first()["count"] == 1
    assert [r.answer for r in E.report(q, a, rows).collect()] == ["new"]


def test_judge_and_service(spark, corpus):
    q = spark.createDataFrame([("1", "q", "red apple", []), ("2", "q", "tax", [])], f"id string, question string, ground_truth_answer string, ground_truth_sources {S.SOURCES}")
    a = spark.createDataFrame([("1", "a red apple", [], 1.0), ("2", "whale", [], 1.0)], "id string, answer string, citations array<struct<file:string,page:string>>, latency_ms double")
    got = {r.id: (r.answer_score, r.hallucinate) for r in evaluate_with(q, a, OverlapJudge())[0].collect()}
    assert got == {"1": (5.0, False), "2": (1.0, True)}
    assert health() == {"status": "ok"}
    assert [r.problem for r in checked_requests(spark.createDataFrame([("x",), (None,)], "question string")).collect()] == [None, "question: field required"]
    one = ask(corpus, "red apple", HashingEncoder(), EchoGenerator(), session_id="s").first()
    assert (one.domain, one.session_id) == ("d", "s") and 0 < one.confidence <= 1 and "apple" in one.citations[0].quote and one.cost_usd > 0
    assert ask(corpus, "red apple", HashingEncoder(), EchoGenerator(), k=0).first().domain is None
    with pytest.raises(ValueError, match="required"):
        ask(corpus, None, HashingEncoder(), EchoGenerator())


def test_how_a_model_is_asked(spark):
    class Shown:
        def reply(self, id, prompt, call):
            if id == "slow":
                time.sleep(1.5)
            return f"{call.system} {call.max_tokens} {call.temperature}", 1, 1

    p = spark.createDataFrame([("1", "x"), ("slow", "x")], "id string, prompt string")
    got = {r.id: r for r in generate(p, Shown(), Call("do it", 7, 0.5, timeout=1, at_once=2)).collect()}
    assert got["1"].reply == "do it 7 0.5" and got["slow"].error.startswith("TimeoutError") and got["slow"].reply is None
    assert generate(p.limit(1), Shown()).first().reply.startswith(SYSTEM_PROMPTS["v4"])


def test_diff_and_last(spark):
    a = spark.createDataFrame([("1", True), ("2", None), ("3", None)], "id string, hallucinate boolean")
    b = spark.createDataFrame([("1", True), ("2", False), ("4", True)], "id string, hallucinate boolean")
    assert {(r.id, r.status) for r in E.run_diff(a, b).collect()} == {("2", "changed"), ("3", "only_a"), ("4", "only_b")}
    rows = spark.createDataFrame([("1", 1, "x"), ("1", 2, None), ("2", 1, "y")], "id string, n int, v string")
    assert {tuple(r) for r in E.last_wins(rows, "id", "n").collect()} == {("1", 2, None), ("2", 1, "y")}


def test_sources(spark, tmp_path):
    for name, value in (("list", [{"id": "001", "question": "q"}]), ("wrapped", {"questions": [{"id": "001", "question": "q", "ground_truth_sources": [{"any_of": [{"file": "f", "page": 3}]}]}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
        r = S.questions(spark, str(tmp_path / f"{name}.json")).first()
        assert (r.pos, r.id) == (0, "001")
    assert r.ground_truth_sources[0].any_of[0].page == "3"
    (tmp_path / "a.jsonl").write_text('{"id": "001", "answer": "12"}\n\n{"id": "002"}\n')
    assert [(x.id, x.answer) for x in S.json_lines(spark, str(tmp_path / "a.jsonl"), S.ANSWERS).orderBy("line").collect()] == [("001", "12"), ("002", None)]
    (tmp_path / "bad.jsonl").write_text('{"id": \n')
    with pytest.raises(Exception):  # noqa: B017
        S.json_lines(spark, str(tmp_path / "bad.jsonl"), S.ANSWERS).collect()
    S.write_json(spark.createDataFrame([("a", None)], "f string, page int"), str(tmp_path / "out"))
    assert '"page":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    raw = tmp_path / "corpus/dental"
    (raw / "pages").mkdir(parents=True)
    (raw / "files").mkdir()
    (raw / "pages/a b.txt").write_bytes("שלום\r\nx".encode())
    (raw / "pages/bad.txt").write_bytes(b"\xff\xfe\xfa")
    (raw / "files/z.pdf").write_bytes(b"%PDF")
    (tmp_path / "manifest.json").write_text(json.dumps({"dental/pages/a b.txt": "http://u"}))
    parsers = {"txt": S.parse_text, "pdf": lambda b: [(1, "p1"), (2, "p2")]}
    docs = S.parse_corpus(spark, str(tmp_path / "corpus"), parsers, S.manifest(spark, str(tmp_path / "manifest.json"))).cache()
    got = {r.file.rsplit("/", 1)[1]: r for r in docs.collect()}
    assert got["z.pdf"].kind == "pdf" and len(got["z.pdf"].pages) == 2 and got["bad.txt"].error.startswith("UnicodeDecodeError")
    assert S.good(docs).count() == 2 and S.failed(docs).count() == 1
    assert S.parse_corpus(spark, str(tmp_path / "corpus"), {}, S.manifest(spark, None), cache=docs).count() == 3
    assert S.manifest(spark, None).count() == 0
    (raw / "pages/deeper").mkdir()
    (raw / "pages/deeper/c.txt").write_text("not a page")
    assert [r.file for r in S.in_order(S.listing(spark, str(tmp_path / "corpus"))).collect()] == ["dental/pages/a b.txt", "dental/pages/bad.txt", "dental/files/z.pdf"]
    assert S.listing(spark, str(tmp_path / "out")).count() == 0
    assert S.numbered({2: "b", 1: "a"}, "x") == [(1, "a"), (2, "b")] and S.numbered({}, "x") == [(1, "x")] and S.numbered({}, " ") == []


def test_lines_of_several_files(spark, tmp_path):
    for n, ids in (("b", ["1", "2"]), ("a", ["2", "3"])):
        (tmp_path / f"{n}.jsonl").write_text("".join(json.dumps({"id": i, "answer": n + i}) + "\n" for i in ids))
    rows = S.json_lines(spark, str(tmp_path), S.ANSWERS)
    assert [r.answer for r in rows.orderBy("line").collect()] == ["a2", "a3", "b1", "b2"]
    assert {r.answer for r in E.latest(rows).collect()} == {"b1", "b2", "a3"}


def test_stream(spark, tmp_path, corpus):
    from quillspark.streaming.asking import answer_stream

    q = spark.createDataFrame([("1", "whale"), ("1", "whale"), ("2", "tax")], "id string, question string")
    q.write.json(str(tmp_path / "in"))
    for _ in range(2):
        s = spark.readStream.schema("id string, question string").json(str(tmp_path / "in"))
        answer_stream(s, corpus, HashingEncoder(), EchoGenerator(), str(tmp_path / "out"), str(tmp_path / "ck"), 1).awaitTermination()
        q.write.mode("append").json(str(tmp_path / "in"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2"]
