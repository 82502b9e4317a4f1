from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.shared_spans import PHRASE, automaton, located, shared_spans, spans_with
from quillspark.llm.splitting import split_texts


def brute(rows, span):
    where = {}
    for k, t in rows:
        for i in range(len(t or "") - span + 1):
            where.setdefault(t[i : i + span], set()).add(k)
    out = set()
    for k, t in rows:
        shared = sorted({j for i in range(len(t or "") - span + 1) if len(where[t[i : i + span]]) > 1 for j in range(i, i + span)})
        for i, x in enumerate(shared):
            if i == 0 or shared[i - 1] != x - 1:
                start = x
            if i == len(shared) - 1 or shared[i + 1] != x + 1:
                out.add((k, start, x + 1))
    return out


@pytest.mark.parametrize(("span", "together"), [(100, 2000), (100, 1), (200, 2000)])
def test_shared_spans(spark, span, together):
    rng = random.Random(span)
    text = lambda n: "".join(rng.choice("אבגדabcd 😀") for _ in range(n))
    pool = [text(rng.randint(60, 500)) for _ in range(20)]
    rows = []
    for k in range(80):
        t = "".join(text(rng.randint(0, 80)) + (p if rng.random() < 0.5 else p[rng.randint(0, 30) :]) for p in rng.choices(pool, k=rng.randint(0, 5)))
        rows.append((k, t or None))
    rows += [(200, "a" * 700), (201, "a" * 650), (202, ""), (203, pool[0] * 8), (204, pool[0] * 8)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, same int, phrase string")
    assert {tuple(r) for r in shared_spans(df, "doc_id", span=span, together=together).collect()} == brute(rows, span)


def test_shared_spans_edges(spark):
    kind = "id long, text string"
    long = "".join(random.Random(4).choices("abcdefgh", k=300))
    df = spark.createDataFrame([(1, long), (1, long), (2, None), (3, "short")], kind)
    assert shared_spans(df, "id").count() == 0
    df = spark.createDataFrame([(1, long), (None, "x" + long)], kind)
    assert {tuple(r) for r in shared_spans(df, "id").collect()} == {(1, 0, 300), (None, 1, 301)}
    assert shared_spans(df.where("false"), "id").count() == 0
    with pytest.raises(ValueError, match="span"):
        shared_spans(df, "id", span=50)


def test_the_automaton_decides(spark):
    rng = random.Random(9)
    phrase, other = ("".join(rng.choices("abcdefgh😀", k=PHRASE)) for _ in range(2))
    texts = ["x" * 70 + phrase + "y" * 90, phrase + "z" * 50 + phrase + "w" * 30, other + "v" * 200]
    found = located(automaton({phrase: 7}), texts)
    assert [tuple(map(int, x)) for x in zip(*found, strict=True)] == [(0, 70, 7), (1, 0, 7), (1, PHRASE + 50, 7)]
    of, start, _ = spans_with(found, texts, 100)
    assert set(zip(of.tolist(), start.tolist(), strict=True)) == {(0, s) for s in range(34, 71)} | {(1, 0)} | {(1, s) for s in range(78, 109)}
    # What no match lies in is shared with nothing, however equal it is.
    assert [len(x) for x in spans_with(located(automaton({other: 7}), texts[:2] * 2), texts[:2] * 2, 100)] == [0, 0, 0]


def checked(text, pieces, limit, overlap):
    at = 0
    for n, p in enumerate(pieces):
        assert p.text == text[p.start : p.stop] and len(p.text) <= limit
        assert p.start == at if n == 0 else at - p.start == min(overlap, limit - (p.stop - at), at)
        at = p.stop
    assert at == len(text)
    runs = [m.span() for m in re.finditer(r"\S+", text)]
    for p in pieces[:-1]:
        inside = any(a < p.stop < b for a, b in runs)
        assert p.forced == inside
    assert any(p.forced for p in pieces) == any(b - a > limit for a, b in runs)


def test_split_random(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(["a", "אב", " ", ". ", "\n", "\n\n", "? ", "😀", "\xa0", "​", "\x1c", "xyz" * rng.randint(1, 12)], k=rng.randint(0, 60))) for _ in range(150)]
    df = spark.createDataFrame([(n, t, "kept") for n, t in enumerate(texts)], "n int, text string, pieces string")
    for limit, overlap in ((20, 5), (30, 0), (12, 11)):
        for r in split_texts(df, limit=limit, overlap=overlap).collect():
            checked(texts[r.n], r.pieces, limit, overlap)


def test_split_edges(spark):
    df = spark.createDataFrame([("",), (None,), ("x" * 10,), ("x" * 11,), ("y " * 40_000,)], "text string")
    rows = split_texts(df, limit=10, overlap=2, out="p").collect()
    assert [len(r.p) for r in rows[:4]] == [0, 0, 1, 2] and [x.forced for x in rows[3].p] == [True, False]
    assert "".join(x.text[-(x.stop - (rows[4].p[k - 1].stop if k else 0)) :] for k, x in enumerate(rows[4].p)) == rows[4].text
    assert split_texts(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="limit"):
        split_texts(df, limit=5, overlap=5)


def test_boundaries_by_strength(spark):
    text = "First words here. More words\n\nnext one two three. four five six seven"
    p = split_texts(spark.createDataFrame([(text,)], "text string"), limit=40, overlap=0).first().pieces
    assert p[0].text == "First words here. More words\n\n" and p[1].text.endswith(". ") or p[1].text.endswith("seven")
