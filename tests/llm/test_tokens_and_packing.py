from __future__ import annotations

import base64
import random
from collections import defaultdict

import numpy as np
import pytest

from quillspark.llm.common import TOKENIZER_DIR
from quillspark.llm.packing import pack
from quillspark.llm.tokenizing import WORDS, TrieBPE, count_tokens, encode_texts

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    lines = open(f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken", "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    out = ["", None, " ", "\n\n \n", "Hello  world", "<|endoftext|>", "שלום לכולם 123,456 ₪", "a" * 5000, "ééé 😀😀 ﬁ", "don't we'll I'm", "\x00\x1c\x85 x"]
    out += ["".join(rng.choices("abcdeinorst ABC\n.,'אבג日本😀é", k=rng.randint(1, 200))) for _ in range(300)]
    return out + ["".join(rng.choices("aabbc er", k=80)) for _ in range(300)]


def test_same_as_published(spark, reference):
    rows = [(n, t, "x") for n, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encode_texts(df).collect()}
    for n, t, _ in rows:
        assert got[n] == (reference.encode_ordinary(t) if t else [])
        if t:
            assert reference.decode(got[n]) == t
    counts = {r.doc_id: r.tokens for r in count_tokens(df).collect()}
    assert counts == {n: len(ids) for n, ids in got.items()}
    assert encode_texts(df.where("false")).count() == 0


def test_trie_shares_prefixes():
    bpe = TrieBPE(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
    words = [b"in", b"inter", b"international", b"internationalise", b"x"]
    together = bpe.encode_words(words)
    assert all(together[w] == bpe.encode_words([w])[w] for w in words)


def packed(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.container].append(r)
    for b in bins.values():
        total = sum(r.last_token - r.first_token for r in b)
        assert total <= capacity and all(r.container_tokens == total for r in b)
    return bins


def test_pack(spark):
    rng = np.random.default_rng(0)
    sizes = np.minimum(300, rng.lognormal(3.5, 1, 3000)).astype(int).tolist() + [0, 100, 101, 250, None]
    df = spark.createDataFrame([(k, s, 1) for k, s in enumerate(sizes)], "doc_id long, tokens long, piece int")
    rows = pack(df, "doc_id", "tokens", capacity=100, group=800).collect()
    bins = packed(rows, 100)
    of = defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
    for k, s in enumerate(sizes):
        spans = sorted((r.piece, r.first_token, r.last_token) for r in of[k])
        assert [p for p, _, _ in spans] == list(range(max(1, -(-(s or 0) // 100))))
        assert spans[0][1] == 0 and spans[-1][2] == (s or 0) and all(a[2] == b[1] for a, b in zip(spans, spans[1:], strict=False))
    assert len(bins) <= -(-sum(s or 0 for s in sizes) // 100) * 1.02 + 1


def test_pack_limits(spark):
    df = spark.createDataFrame([(k, 10, 5) for k in range(100)], "k int, n int, lossy int")
    bins = packed(pack(df, "k", "n", capacity=100, segments=3).collect(), 100)
    assert max(map(len, bins.values())) == 3 and len(bins) == 34
    bins = packed(pack(df, "k", "n", "lossy", capacity=100, loss_capacity=20).collect(), 100)
    assert max(map(len, bins.values())) == 4
    over = pack(spark.createDataFrame([(1, 50, 50)], "k int, n int, lossy int"), "k", "n", "lossy", capacity=100, loss_capacity=20).collect()
    assert [(r.first_token, r.last_token) for r in sorted(over, key=lambda r: r.piece)] == [(0, 20), (20, 40), (40, 50)]


def test_pack_repeats_and_nulls(spark):
    df = spark.createDataFrame([(1, 10)] * 50 + [(None, 10)] * 3 + [(None, None)], "k int, n int")
    rows = pack(df, "k", "n", capacity=25, group=10).collect()
    assert len(rows) == 54 and sum(r.k is None for r in rows) == 4
    packed(rows, 25)
    assert pack(df.where("false"), "k", "n").count() == 0
    with pytest.raises(ValueError, match="capacity"):
        pack(df, "k", "n", capacity=0)


def test_three_limits_that_bind(spark):
    rng = np.random.default_rng(2)
    said = rng.integers(5, 400, 3000)
    rows = [(k, int(n + rng.integers(5, 150)), int(n)) for k, n in enumerate(said)]
    got = pack(spark.createDataFrame(rows, "id long, tokens long, said long"), "id", "tokens", loss="said", capacity=2048, segments=8, loss_capacity=1700, group=1500).collect()
    assert sorted(r.id for r in got) == list(range(3000))
    bins = packed(got, 2048)
    assert all(len(b) <= 8 and sum(rows[r.id][2] for r in b) <= 1700 for b in bins.values())
    least = max(3000 / 8, sum(r[1] for r in rows) / 2048, sum(r[2] for r in rows) / 1700)
    assert len(bins) < 1.04 * least


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="other words"):
        TrieBPE(f"{TOKENIZER_DIR}/word_bpe_49k.json")
