"""Byte-level BPE of whole corpora with a public vocabulary, by depth-first traversal of a trie of the distinct words.

In byte-level BPE the last token of every prefix of a word is determined: it is the one token that ends the prefix and
merges with the last token of what precedes it exactly as the merge order would. A trie node therefore needs one
state, its last token, found from its ancestors' states; words sharing a prefix share that work, and a word's tokens are
read off by walking back from its leaf.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import TOKENIZER_DIR

#: Fixed value: the published pattern that cuts a text into the words of byte-level BPE.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words kept encoded by a Python worker; beyond it, the worker starts anew, so that its memory is bounded.
WORDS_KEPT = 400_000


def byte_letters() -> dict[str, int]:
    """The printable characters that vocabulary files write bytes as."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class TrieBPE:
    """Encoder of single words by the last-token states of their prefixes."""

    def __init__(self, path: str | Path):
        file = json.loads(Path(path).read_text(encoding="utf-8"))
        cut = file["pre_tokenizer"] or {}
        if file["normalizer"] or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) != ("ByteLevel", False, True):
            raise ValueError(f"{path} cuts texts into other words than byte-level BPE does")
        model = file["model"]
        letter = byte_letters()
        of = {t: bytes(letter[c] for c in t) for t in model["vocab"] if all(c in letter for c in t)}
        self.ids = {of[t]: i for t, i in model["vocab"].items() if t in of}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        n = max(self.ids.values()) + 1
        #: Place in the merge order; single bytes come before all merges.
        self.rank = [-1] * n
        self.parts: list[tuple[int, int] | None] = [None] * n
        self.pairs: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            x, y = self.ids[of[a]], self.ids[of[b]]
            z = self.ids[of[a] + of[b]]
            if self.parts[z] is None:
                self.parts[z], self.rank[z] = (x, y), r
            self.pairs[x, y] = r
        self.size = [0] * n
        by_end: dict[bytes, set[int]] = {}
        for t, i in self.ids.items():
            self.size[i] = len(t)
            if len(t) > 1:
                by_end.setdefault(t[-2:], {1}).add(len(t))
        #: Lengths, longest first, of the tokens that may end in two bytes.
        self.lengths = {k: sorted(v, reverse=True) for k, v in by_end.items()}
        self.fits: dict[tuple[int, int], bool] = {}

    def joint(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, stay apart: no merge across their border happens before both are whole.

        Undo the later of the merges that made the tokens at the border, again and again; whatever pair stood at the border
        until then must not merge earlier than that.
        """
        key = (left, right)
        known = self.fits.get(key)
        if known is not None:
            return known
        a, b, until, ok = left, right, 1 << 60, True
        while True:
            r = self.pairs.get((a, b))
            if r is not None and r < until:
                ok = False
                break
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                break
            # Among merges of equal rank the left one happens first.
            if ra > rb:
                until, a = ra, self.parts[a][1]
            else:
                until, b = rb + 1, self.parts[b][0]
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Tokens of distinct words. Sorted, they are the trie in depth-first order: the path to a word is kept, and only what
        it doesn't share with its predecessor is added."""
        out: dict[bytes, list[int]] = {}
        ids, size, joint, lengths, one = self.ids, self.size, self.joint, self.lengths.get, [1]
        path: list[int] = []
        before = b""
        for w in sorted(words):
            n, d = len(w), 0
            most = min(n, len(before))
            while d < most and w[d] == before[d]:
                d += 1
            del path[d:]
            for d in range(d + 1, n + 1):
                for k in lengths(w[d - 2 : d], one) if d > 1 else one:
                    if k <= d:
                        t = ids.get(w[d - k : d])
                        if t is not None and (k == d or joint(path[d - k - 1], t)):
                            path.append(t)
                            break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            tokens, d = [], n
            while d:
                t = path[d - 1]
                tokens.append(t)
                d -= size[t]
            out[w] = tokens[::-1]
            before = w
        return out


class Encoder:
    """Encoder of batches of texts for one Python worker."""

    def __init__(self, path: str):
        self.bpe = TrieBPE(path)
        self.words = regex.compile(WORDS).findall
        self.reset()

    def reset(self) -> None:
        self.code: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def learn(self, new: list[str]) -> None:
        found = self.bpe.encode_words([w.encode("utf-8", "surrogatepass") for w in new])
        rows = [found[w.encode("utf-8", "surrogatepass")] for w in new]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter((t for r in rows for t in r), np.int32, int(sizes.sum()))])

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word codes of all texts, and the number of words of each."""
        if len(self.code) > WORDS_KEPT:
            self.reset()
        cut = [self.words(t) if t else [] for t in texts]
        new = set().union(*cut) - self.code.keys() if cut else set()
        if new:
            self.learn(list(new))
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        get = self.code.__getitem__
        flat = np.empty(int(counts.sum()), np.int64)
        at = 0
        for ws in cut:
            flat[at : at + len(ws)] = list(map(get, ws))
            at += len(ws)
        return flat, counts

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        codes, counts = self.codes(texts)
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        take = np.repeat(self.starts[codes] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(self.flat[take]))

    def count(self, texts: list[str | None]) -> pa.Array:
        codes, counts = self.codes(texts)
        ends = np.concatenate([[0], np.cumsum(self.sizes[codes])])
        at = np.concatenate([[0], np.cumsum(counts)])
        return pa.array(ends[at[1:]] - ends[at[:-1]], pa.int64())


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """The encoder of this Python worker, which goes from one of its tasks to the next with the words it knows."""
    return Encoder(path)


def _batches(kept: list[str], path: str, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder = encoder_of(path)
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(len(kept)).to_pylist()
                made = encoder.encode(texts) if ids else encoder.count(texts)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(kept))), made], [*kept, "made"])

    return run


def _encoded(df: DataFrame, text: str, out: str, path: str, ids: bool) -> DataFrame:
    kept = [c for c in df.columns if c != out]
    names = [f"c{k}" for k in range(len(kept))]
    given = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)), F.col(f"`{text}`").alias("text"))
    kind = T.ArrayType(T.IntegerType()) if ids else T.LongType()
    schema = T.StructType([*(T.StructField(n, df.schema[c].dataType) for n, c in zip(names, kept, strict=True)), T.StructField("made", kind)])
    return given.mapInArrow(_batches(names, path, ids), schema).toDF(*kept, out)


def encode_texts(df: DataFrame, text: str = "text", out: str = "ids", name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """``df`` with the tokens of its texts in ``out`` (array<int>), without special tokens; the strings of special tokens in
    a text are ordinary text. Empty and null texts give an empty list. Repeated rows stay; other columns stay as they are,
    but one named ``out`` is replaced. No shuffle: words are encoded once per Python worker."""
    return _encoded(df, text, out, f"{directory}/{name}.json", True)


def count_tokens(df: DataFrame, text: str = "text", out: str = "tokens", name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """``df`` with the number of tokens of its texts (see encode_texts) in ``out`` (bigint), 0 for empty and null texts."""
    return _encoded(df, text, out, f"{directory}/{name}.json", False)
