"""The main body of web pages, by a recurrent labeller of their blocks.

A page is a sequence of blocks, here its lines. A block is read as a vector of its path (what kind of block it is and where in the
page's outline it stands; the text of a page has no tags left, so marks, lengths and the title play their part) and as
hashed words: all of them, and once more those it opens and ends with. A bidirectional LSTM in numpy reads the whole
sequence and labels each block with all others in view.

It is trained on a bounded sample of pages. Their labels come from what the labeller is not told: how blocks recur over all
pages of the collection. Pages that repeat their title as no heading have no main body, so whatever recurs on them is
furniture, wherever it stands on others; a line that recurs before lines of one ending, which themselves seldom stand
elsewhere, points to other pages. No word of any site or language is listed.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import cut, hash64
from quillspark.llm.eyeform import folded

#: Pages the labeller is trained on, at most; hashed words; sizes of the word vectors and of each direction's state.
SAMPLE, WORDS, WORD_DIM, STATE = 1500, 8192, 16, 24
#: Blocks in a row that the labeller is trained on at once; longer pages are parted.
STRETCH = 400
#: A sign is furniture from so many pages without a body on, if its share of them is more than this part of its share of the others.
OUTSIDE, PART = 2, 0.3
#: A sign of so many pages without a body, expected if it were furniture, is content when it has none of them.
EXPECTED = 5
#: Lines recur, and endings do, from so many pages on; shares of lines that tell endings and headings that point elsewhere.
RECURS, AFTER_HEADING, BEFORE_ENDING = 20, 0.35, 0.8

_TOKENS = re.compile(r"\w+")
_DIGITS = re.compile(r"\d+")
_BULLET = re.compile(r"^(?:[-*•·–]|\d{1,3}[.)])\s")
_END = re.compile(r"[.!?؟:][\"')\]]*$")
_MARKS = re.compile(r"([^\w\s])\1*$")
_CRUMB = re.compile(r" [>/›»] ")
#: Ends of sentences and of what goes on: they tell no kind of line from another.
_COMMON = frozenset(".!?:؟,;")


def blocks(text: str) -> list[str]:
    """The page's lines as they look, in lower case; one for every line of the text."""
    lines = [html.unescape(x).replace("\n", " ") if "&" in x else x for x in text.split("\n")]
    shown = folded("\n".join(lines)).split("\n")
    # Blank lines at the ends are lost to nothing: the form keeps every line break.
    return [x.strip().lower() for x in shown] if len(shown) == len(lines) else [folded(x).strip().lower() for x in lines]


def title_of(lines: list[str]) -> str:
    return next((x for x in lines if x), "").rsplit(" | ", 1)[0]


def ending(bare: str, words: list[str]) -> str:
    """What a line without its digits ends with: a mark, repeated or not, that doesn't end sentences, or the last two words of several."""
    m = _MARKS.search(bare[-8:])
    if m:
        return "" if m.group() in _COMMON else m.group()
    return " ".join(words[-2:]) if len(words) > 2 else ""


def signs(line: str) -> tuple[int, int, list[int]]:
    """Hashes of what may recur in a line: of the whole and of its ending (0 for none), both without digits, and of its first one, two and
    three words."""
    bare = _DIGITS.sub("", line).rstrip()
    # Of long lines, the words at either edge are enough; the whole is named by all its characters.
    first, last = (_TOKENS.findall(bare),) * 2 if len(bare) < 200 else (_TOKENS.findall(bare[:100]), _TOKENS.findall(bare[-100:]))
    end = ending(bare, last)
    name = lambda kind, x: hash64(f"{kind} {x}".encode("utf-8", "surrogatepass"))
    return name("=", bare), name("$", end) if end else 0, [name("^", " ".join(first[:k])) for k in (1, 2, 3) if len(first) >= k]


class Signs:
    """The signs of lines, remembered for short ones."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int, list[int]]] = {}

    def of(self, line: str) -> tuple[int, int, list[int]]:
        got = self.known.get(line)
        if got is None:
            got = signs(line)
            if len(line) < 160:
                if len(self.known) > 50_000:
                    self.known.clear()
                self.known[line] = got
        return got

    def page(self, text: str) -> tuple[bool, list[int], list[int], list[int]]:
        """Whether the page has a body; the signs of the lines that could be in it, or of all lines where it has none, but the title; of
        the lines in it, from the second on, the whole line before and the ending."""
        lines = [x for x in blocks(text) if x]
        head = heading(lines)
        found = [self.of(x) for x in lines[1 if head is None else head + 1 :]]
        seen = {s for whole, end, opening in found for s in (whole, end, *opening)} - {0}
        pairs = [] if head is None else list(zip(found, found[1:], strict=False))
        return head is not None, list(seen), [a[0] for a, _ in pairs], [b[1] for _, b in pairs]


def heading(lines: list[str]) -> int | None:
    """The place of the line, after the first, that repeats the title."""
    title = title_of(lines)
    return next((k for k, x in enumerate(lines) if k and x == title), None)


_N_PATH, _EDGES = 12 + 8, 2


class Reader:
    """Turns pages into vectors; what doesn't depend on the page is remembered for short lines."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[list[float], tuple[list[int], list[int]]]] = {}
        self.words: dict[str, int] = {}

    def word(self, w: str) -> int:
        got = self.words.get(w)
        if got is None:
            if len(self.words) > 200_000:
                self.words.clear()
            got = self.words[w] = hash64(w.encode("utf-8", "surrogatepass")) % WORDS
        return got

    def line(self, x: str) -> tuple[list[float], tuple[list[int], list[int]]]:
        got = self.known.get(x)
        if got is None:
            n, words = len(x), _TOKENS.findall(x)
            digits = sum(map(len, _DIGITS.findall(x)))
            path = [
                n < 12, 12 <= n < 30, 30 <= n < 70, 70 <= n < 160, n >= 160, bool(_BULLET.match(x)), bool(_END.search(x[-8:])), x.endswith("?"),
                x.count(" | ") > 1 or x.count(" · ") > 1, bool(_CRUMB.search(x)), digits * 5 > n, ":" in x,
            ]
            at = self.word
            mark = _MARKS.search(x[-8:])
            edges = [f"^{k} {w}" for k, w in enumerate(words[:3])] + [f"{w} {k}$" for k, w in enumerate(words[:-3:-1])] + [f"{mark.group()[:3]}$" if mark else "$"]
            got = ([float(v) for v in path], ([at(w) for w in dict.fromkeys(words)], [at(w) for w in edges]))
            if n < 160:
                if len(self.known) > 50_000:
                    self.known.clear()
                self.known[x] = got
        return got

    def page(self, text: str) -> tuple[list[int], np.ndarray, list[tuple[list[int], list[int]]]]:
        """Numbers of the lines that aren't blank, from 0, their path vectors, and their words and the words at their edges."""
        lines = blocks(text)
        title = title_of(lines)
        at = [k for k, x in enumerate(lines) if x]
        path, words, seen = [], [], False
        for j, k in enumerate(at):
            x = lines[k]
            own, w = self.line(x)
            words.append(w)
            head = j > 0 and x == title
            seen |= head
            path.append([*own, j == 0, head, seen, not head and title in x, j < 6, len(at) - j < 8, k > 0 and not lines[k - 1], j / len(at)])
        return at, np.array(path, np.float32).reshape(-1, _N_PATH), words


class Recurrence:
    """What the collection says of signs: ``signs`` maps one to its numbers of pages with a body, where it stands after the heading, and of
    pages without; ``bodies``, ``stubs``: all pages of either kind; ``endings``, ``headings``: those that point elsewhere."""

    def __init__(self, seen: dict[int, tuple[int, int]], bodies: int, stubs: int, endings: set[int], headings: set[int]):
        self.seen, self.bodies, self.stubs, self.endings, self.headings = seen, max(1, bodies), max(1, stubs), endings, headings

    def furniture(self, sign: int) -> bool | None:
        """Whether the sign tells that a line is furniture, or that it isn't; None if it tells neither."""
        inside, outside = self.seen.get(sign, (0, 0))
        if outside >= OUTSIDE:
            return outside * self.bodies > PART * inside * self.stubs
        return False if inside * self.stubs >= EXPECTED * self.bodies else None

    def labels(self, text: str) -> list[int]:
        """Labels of the lines that aren't blank: 1 for the heading that repeats the title and the lines after it that are no furniture."""
        lines = [x for x in blocks(text) if x]
        head = heading(lines)
        return [int(head is not None and (k == head or k > head and not self.away(x))) for k, x in enumerate(lines)]

    def away(self, line: str) -> bool:
        whole, end, opening = signs(line)
        if whole in self.headings or end in self.endings or self.furniture(whole):
            return True
        told = next((v for v in map(self.furniture, reversed(opening)) if v is not None), None)
        return bool(self.furniture(end)) if told is None else told


def _page_signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Signs()
    kinds = (pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    for batch in batches:
        rows = [known.page(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], ["body", "seen", "before", "ends"])


def recurrence(pages: DataFrame, keys: list[str], text: str, sample: list[str]) -> Recurrence:
    """What all pages say of the signs on the pages of ``sample``. Rows alike in ``keys`` and text count once. Counts are made for
    the whole collection by aggregation; only those of the sample's signs go to the driver."""
    once = pages.where(F.length(text) > 0).groupBy(*keys, F.xxhash64(text).alias("__h__")).agg(F.first(text).alias("__t__")) if keys else pages.select(F.col(text).alias("__t__"))
    each = cut(once.select("__t__").mapInArrow(_page_signs, "body boolean, seen array<long>, before array<long>, ends array<long>"))  # hashes, read four times
    own = Signs()
    wanted = {s for t in sample for x in set(blocks(t)) if x for whole, end, opening in [own.of(x)] for s in (whole, end, *opening)} - {0}
    of_sample = pages.sparkSession.createDataFrame(pa.table({"sign": pa.array(list(wanted), pa.int64())}))
    total = each.agg(F.count_if("body").alias("bodies"), F.count_if(~F.col("body")).alias("stubs")).first()
    bodies, stubs = max(1, total.bodies), max(1, total.stubs)
    stats = each.select("body", F.explode("seen").alias("sign")).groupBy("sign").agg(F.count_if("body").alias("inside"), F.count_if(~F.col("body")).alias("outside"))
    telling = stats.where((F.col("outside") >= OUTSIDE) | (F.col("inside") * stubs >= EXPECTED * bodies) | (F.col("inside") >= RECURS))
    furniture: Column = (F.col("outside") >= OUTSIDE) & (F.col("outside") * bodies > PART * F.col("inside") * stubs)
    telling = cut(telling.withColumn("furniture", furniture))
    followed = each.where("body").select(F.explode(F.arrays_zip("before", "ends")).alias("p")).groupBy(F.col("p.before").alias("before"), F.col("p.ends").alias("end")).agg(F.count(F.lit(1)).alias("n"))
    recurring = telling.where((F.col("inside") >= RECURS) & ~F.col("furniture")).select(F.col("sign").alias("before"), F.lit(1).alias("recurs"))
    followed = cut(followed.join(recurring, "before", "left"))
    endings = followed.where("end <> 0").groupBy("end").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("recurs", F.lit(0))).alias("after"))
    endings = endings.where((F.col("n") >= RECURS) & (F.col("after") > AFTER_HEADING * F.col("n"))).select("end", F.lit(1).alias("points"))
    headings = followed.where("recurs = 1").join(endings, "end", "left").groupBy("before").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("points", F.lit(0))).alias("pointing"))
    headings = headings.where(F.col("pointing") > BEFORE_ENDING * F.col("n")).select(F.col("before").alias("sign"))
    kept = lambda df: df.join(of_sample, "sign", "left_semi").toArrow()  # noqa: E731  # of the sample's signs, a bounded number
    seen = kept(telling.select("sign", "inside", "outside")).to_pydict()
    return Recurrence(
        dict(zip(seen["sign"], zip(seen["inside"], seen["outside"], strict=True), strict=True)), bodies, stubs,
        set(kept(endings.select(F.col("end").alias("sign")))["sign"].to_pylist()), set(kept(headings)["sign"].to_pylist()),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over the blocks of pages, with word vectors learned along with it."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        n_in = _N_PATH + _EDGES * WORD_DIM
        self.p = {"words": rng.normal(0, 0.1, (WORDS, WORD_DIM)).astype(np.float32), "out": np.zeros((2 * STATE, 1), np.float32), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 1 / np.sqrt(n_in), (n_in, 4 * STATE)).astype(np.float32)
            self.p[f"h{d}"] = rng.normal(0, 1 / np.sqrt(STATE), (STATE, 4 * STATE)).astype(np.float32)
            self.p[f"c{d}"] = np.repeat(np.array([1, 0, 0, 0], np.float32), STATE)
        self.p["out"] = rng.normal(0, 0.2, (2 * STATE, 1)).astype(np.float32)

    def inputs(self, pages: list[tuple[np.ndarray, list[tuple[list[int], list[int]]]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Padded blocks (page, block, input), their mask, and the words' ids and places: all words of a block have one place, those at its
        edges another."""
        most = max(len(p) for p, _ in pages)
        x = np.zeros((len(pages), most, _N_PATH + _EDGES * WORD_DIM), np.float32)
        mask = np.zeros((len(pages), most), np.float32)
        lists, at = [], []
        for i, (path, words) in enumerate(pages):
            x[i, : len(path), :_N_PATH] = path
            mask[i, : len(path)] = 1
            for both in words:
                lists += both
            at += range(_EDGES * i * most, _EDGES * (i * most + len(words)))
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(sizes.sum()))
        at = np.repeat(np.array(at, np.int64), sizes)
        share = (1 / np.repeat(sizes, sizes)).astype(np.float32)
        if len(ids):
            heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            pooled = np.zeros((x.shape[0] * most * _EDGES, WORD_DIM), np.float32)
            pooled[at[heads]] = np.add.reduceat(self.p["words"][ids] * share[:, None], heads, axis=0)
            x[:, :, _N_PATH:] = pooled.reshape(len(pages), most, -1)
        return x, mask, ids, np.stack([at.astype(np.float64), share])

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, most, _ = x.shape
        gates = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h = c = np.zeros((n, STATE), np.float32)
        out, tape = np.zeros((n, most, STATE), np.float32), []
        for t in range(most) if d == "f" else range(most - 1, -1, -1):
            z = gates[:, t] + h @ self.p[f"h{d}"]
            s = _sigmoid(z[:, : 3 * STATE])
            f, i, o, g = s[:, :STATE], s[:, STATE : 2 * STATE], s[:, 2 * STATE :], np.tanh(z[:, 3 * STATE :])
            m = mask[:, t : t + 1]
            c_new = (f * c + i * g) * m
            tc = np.tanh(c_new)
            h_new = o * tc * m
            if keep:
                tape.append((t, h, c, f, i, o, g, tc, m))
            h, c = h_new, c_new
            out[:, t] = h
        return out, tape

    def scores(self, pages: list[tuple[np.ndarray, list[tuple[list[int], list[int]]]]]) -> np.ndarray:
        x, mask, _, _ = self.inputs(pages)
        both = np.concatenate([self.run(x, mask, "f", False)[0], self.run(x, mask, "b", False)[0]], axis=2)
        return (both @ self.p["out"] + self.p["bias"])[:, :, 0]

    def fit(self, pages: list[tuple[np.ndarray, list[tuple[list[int], list[int]]]]], labels: list[list[int]], epochs: int = 6, size: int = 64, rate: float = 0.006, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        by_length = sorted(range(len(pages)), key=lambda k: len(labels[k]))
        groups = [by_length[k : k + size] for k in range(0, len(by_length), size)]
        epochs = max(epochs, -(-150 // len(groups)))  # few pages are read more often
        m1, m2, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for epoch in range(epochs):
            for g in rng.permutation(len(groups)):
                grads = self.gradients([pages[k] for k in groups[g]], [labels[k] for k in groups[g]])
                step += 1
                speed = rate * (1 - epoch / epochs) + 0.0005
                for k, v in grads.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.99 * m2[k] + 0.01 * v * v
                    self.p[k] -= (speed * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def gradients(self, pages: list, labels: list[list[int]]) -> dict[str, np.ndarray]:
        x, mask, ids, place = self.inputs(pages)
        y = np.zeros(mask.shape, np.float32)
        for i, row in enumerate(labels):
            y[i, : len(row)] = row
        runs = {d: self.run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        err = (_sigmoid((both @ self.p["out"] + self.p["bias"])[:, :, 0]) - y) * mask / max(1.0, mask.sum())
        grads = {"out": np.einsum("ntk,nt->k", both, err)[:, None], "bias": np.array([err.sum()], np.float32)}
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            d_out = err[:, :, None] * self.p["out"][k * STATE : (k + 1) * STATE, 0]
            dz_all = np.zeros((*mask.shape, 4 * STATE), np.float32)
            gh = np.zeros_like(self.p[f"h{d}"])
            dh, dc = np.zeros((len(x), STATE), np.float32), np.zeros((len(x), STATE), np.float32)
            for t, h0, c0, f, i, o, g, tc, m in reversed(runs[d][1]):
                dh = (dh + d_out[:, t]) * m
                dc = (dc + dh * o * (1 - tc * tc)) * m
                dz = np.concatenate([dc * c0 * f * (1 - f), dc * g * i * (1 - i), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                dz_all[:, t] = dz
                gh += h0.T @ dz
                dh, dc = dz @ self.p[f"h{d}"].T, dc * f
            flat = dz_all.reshape(-1, 4 * STATE)
            grads |= {f"h{d}": gh, f"x{d}": x.reshape(-1, x.shape[2]).T @ flat, f"c{d}": flat.sum(axis=0)}
            dx += dz_all @ self.p[f"x{d}"].T
        words = np.zeros_like(self.p["words"])
        if len(ids):
            np.add.at(words, ids, dx[:, :, _N_PATH:].reshape(-1, WORD_DIM)[place[0].astype(np.int64)] * place[1][:, None].astype(np.float32))
        return grads | {"words": words}


def train(texts: list[str], known: Recurrence, seed: int = 5) -> Labeller:
    """A labeller fitted to the labels that recurrence gives the texts' lines."""
    reader, labeller = Reader(), Labeller(seed)
    read = [(reader.page(t), known.labels(t)) for t in texts if t.strip()]
    parts = [(r, y, slice(a, a + STRETCH)) for r, y in read for a in range(0, len(y), STRETCH)]
    if parts:
        labeller.fit([(r[1][p], r[2][p]) for r, _, p in parts], [y[p] for _, y, p in parts])
    return labeller


def _label(kept: int, weights: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, labeller = Reader(), Labeller()
        labeller.p = weights
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                read = [reader.page(t or "") for t in part.column(kept).to_pylist()]
                found: list[list[int]] = [[] for _ in read]
                order = sorted((i for i, r in enumerate(read) if r[0]), key=lambda i: len(read[i][0]))
                while order:  # pages of like length together, long ones fewer at a time
                    most = len(read[order[-1]][0])
                    take = order[-max(1, min(128, 40_000 // most)) :]
                    del order[-len(take) :]
                    s = labeller.scores([read[i][1:] for i in take])
                    for i, row in zip(take, s, strict=True):
                        found[i] = [at + 1 for at, v in zip(read[i][0], row, strict=False) if v > 0]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(kept)), pa.array(found, pa.list_(pa.int32()))], [*part.schema.names[:kept], "lines"])

    return run


def sample_of(pages: DataFrame, keys: list[str], text: str, n: int) -> list[str]:
    """About n texts, n at most, of the pages whose keys' hashes fall into a share of their range: the same ones however the table is laid
    out, and no more than them leave the executors. Repeated rows count once."""
    some = pages.where(F.length(text) > 0)
    total, span = some.count(), 1 << 40
    share = min(span, -(-span * n * 5 // (4 * max(1, total))))
    h = F.pmod(F.xxhash64(*keys), F.lit(span))
    few = some.select(h.alias("h"), F.col(text).alias("t")).where(F.col("h") < share).limit(2 * n).collect()
    return list(dict.fromkeys(r.t for r in sorted(few, key=lambda r: (r.h, r.t))))[:n]


def main_lines(pages: DataFrame, keys: list[str], text: str, sample: int = SAMPLE) -> DataFrame:
    """(*keys, lines): the numbers, from 1, of the lines of each page's main body; none for a page without one.

    Null, empty and blank pages have no lines. Repeated rows stay; columns other than ``keys`` are dropped. An empty table gives
    an empty one. ``sample``: pages the labeller is trained on, at most; its weights, a fixed number, go to every task. What
    their labels are made from is counted over all pages.
    """
    texts = sample_of(pages, keys, text, sample)
    labeller = train(texts, recurrence(pages, keys, text, texts)) if texts else Labeller()
    schema = T.StructType([*(pages.schema[k] for k in keys), T.StructField("lines", T.ArrayType(T.IntegerType()))])
    return pages.select(*keys, F.col(text).alias("__text__")).mapInArrow(_label(len(keys), labeller.p), schema)
