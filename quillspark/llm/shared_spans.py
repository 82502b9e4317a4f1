"""Long spans that stand verbatim in several texts, exactly and without comparing pairs.

1. Every text is fingerprinted: phrases of PHRASE code points are hashed by a rolling hash, and the least hash of every span of ``span``
   code points is an anchor (winnowing), so that every shared span holds an anchor, at the same place, in every text that has it.
2. An anchor's context is all that the spans around it can reach: only there can a text share anything. Anchors met in one text only are
   dropped by an aggregate that never gathers a group; equal contexts are one class, whatever their number.
3. The contexts of recurring phrases go to shards by their phrase. Each shard compiles the texts of its phrases into an Aho-Corasick
   automaton and streams all its contexts through it from end to end; its matches, not the anchors, say where phrases stand.
   A span counts only where a match lies in it, and spans are compared under their first match. Spans of two texts are shared.
   A phrase of too many classes for one task has its contexts streamed wherever they lie, through an automaton of the text that
   one of them has for it, and its spans are counted by an aggregate.
4. The shared spans go back to all texts of their class, and overlapping ones are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, mix64

#: Code points of a phrase. Shorter ones recur by chance more often, longer ones need more anchors.
PHRASE = 64

#: Classes of one phrase that a task takes; phrases with more are counted by an aggregate.
TOGETHER = 2_000

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling hash's base, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _STEP), ("down", _BACK)):
            x = np.full(max(n, 1 << 20), base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


class Rolled:
    """Hashes of any part of a sequence of code points."""

    def __init__(self, chars: np.ndarray):
        self.n = len(chars)
        self.up, down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mix64(chars.astype(np.uint64) + np.uint64(0x5851F42D)) * down[:-1], out=self.sums[1:])

    def part(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self.up[start] + (stop - start).astype(np.uint64))


def running_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w values in a row."""
    rows = np.concatenate([x, np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - w + 1
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the place where each begins, with the end."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def anchors(texts: list[str], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every anchor: the number of its text, its place, the phrase's hash, the context's hash. Texts are of at least ``span``."""
    chars, at = points(texts)
    roll = Rolled(chars)
    start = np.arange(len(chars) - PHRASE + 1)
    phrase = roll.part(start, start + PHRASE)
    # The lower bits tell equal hashes apart: of them, the last one counts. Which one that is doesn't depend on the place in the text.
    low = np.uint64((1 << 28) - 1)
    least = running_min((phrase & ~low) | (low - start.astype(np.uint64)), span - PHRASE + 1)
    inside = np.zeros(len(least) + 1, np.int64)
    np.add.at(inside, at[:-1], 1)
    np.add.at(inside, np.minimum(at[1:] - span + 1, len(least)), -1)
    found = np.unique((low - (least[np.cumsum(inside)[:-1] > 0] & low)).astype(np.int64))
    text = np.searchsorted(at, found, side="right") - 1
    lo, hi = np.maximum(found + PHRASE - span, at[text]), np.minimum(found + span, at[text + 1])
    context = mix64(roll.part(lo, hi) + (found - lo).astype(np.uint64))
    return text, found - at[text], phrase[found].view(np.int64), context.view(np.int64)


def located(machine: ahocorasick.Automaton, contexts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All matches of the automaton's phrases in the contexts, in order: the context's number, the place, the phrase."""
    of, place, phrase = [], [], []
    for k, t in enumerate(contexts):
        for end, p in machine.iter(t):
            of.append(k)
            place.append(end - PHRASE + 1)
            phrase.append(p)
    return np.array(of, np.int64), np.array(place, np.int64), np.array(phrase, np.int64)


def spans_with(found: tuple[np.ndarray, np.ndarray, np.ndarray], contexts: list[str], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every span that a match lies in: the number of its context, its offset there, the hash of its first match's phrase and place and of
    its text."""
    of, place, phrase = found
    chars, at = points(contexts)
    roll = Rolled(chars)
    count = np.maximum(np.diff(at) - span + 1, 0)
    context = np.repeat(np.arange(len(contexts)), count)
    start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    matches = at[of] + place if len(of) else np.zeros(0, np.int64)
    begin = at[context] + start
    first = np.searchsorted(matches, begin)
    held = np.append(matches, np.iinfo(np.int64).max - PHRASE)[first] + PHRASE <= begin + span
    context, start, begin, first = context[held], start[held], begin[held], first[held]
    name = phrase.view(np.uint64)[first] + (matches[first] - begin).astype(np.uint64)
    return context, start, mix64(roll.part(begin, begin + span) ^ mix64(name)).view(np.int64)


def runs(of: np.ndarray, start: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive starts within one context, as (context, start, stop)."""
    if not len(of):
        return of, start, start
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1)])
    end = np.concatenate([new[1:], [True]])
    return of[new], start[new], start[end] + span


def _finder(span: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                text, place, phrase, context = anchors(part.column(2).to_pylist(), span)
                ids = (part.column(c).take(pa.array(text)) for c in (1, 0))
                yield pa.RecordBatch.from_arrays([pa.array(phrase), pa.array(context), *ids, pa.array(place.astype(np.int32))], ["phrase", "context", "same", "id", "place"])

    return find


def _contexts(span: int):
    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in wanted:
                    lo = max(0, w["place"] + PHRASE - span)
                    out.append((w["phrase"], w["context"], w["lo"], w["hi"], w["classes"], w["place"] - lo, text[lo : w["place"] + span]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["phrase", "context", "lo", "hi", "classes", "at", "text"])

    return cut_out


def automaton(phrases: dict[str, int]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for text, p in phrases.items():
        machine.add_word(text, p)
    machine.make_automaton()
    return machine


def _shard(span: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None

        def done(t: pa.Table) -> pa.RecordBatch:
            phrase, context, lo, hi, at = (t.column(c).to_numpy() for c in ("phrase", "context", "lo", "hi", "at"))
            texts = t.column("text").to_pylist()
            heads = np.flatnonzero(np.r_[True, phrase[1:] != phrase[:-1]])  # the contexts of a phrase are one after another
            machine = automaton({texts[k][at[k] : at[k] + PHRASE]: int(phrase[k]) for k in heads.tolist()})
            of, start, h = spans_with(located(machine, texts), texts, span)
            order = np.argsort(h, kind="stable")
            s, new = h[order], np.ones(len(h), bool)
            new[1:] = s[1:] != s[:-1]
            heads = np.flatnonzero(new)
            two = np.zeros(len(h), bool)
            if len(heads):
                least = np.minimum.reduceat(lo[of[order]], heads)
                most = np.maximum.reduceat(hi[of[order]], heads)
                two[order] = np.repeat(least != most, np.diff(np.append(heads, len(h))))
            k, first, stop = runs(of[two], start[two] - at[of[two]], span)
            return pa.RecordBatch.from_arrays([pa.array(phrase[k]), pa.array(context[k]), pa.array(first.astype(np.int32)), pa.array(stop.astype(np.int32))], ["phrase", "context", "start", "stop"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            kept = t if kept is None else pa.concat_tables([kept, t])
            last = kept.column("phrase")[-1]
            whole = int(np.searchsorted(kept.column("phrase").to_numpy(), last.as_py()))  # the last phrase may go on in the next batch
            if whole > 4000:
                yield done(kept.slice(0, whole))
                kept = kept.slice(whole).combine_chunks()
        if kept is not None and kept.num_rows:
            yield done(kept)

    return match


def _spans(span: int):
    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                phrase, context, lo, hi, at = (part.column(c).to_numpy() for c in ("phrase", "context", "lo", "hi", "at"))
                texts = part.column("text").to_pylist()
                of, place, found = located(automaton(dict(zip(part.column("its_text").to_pylist(), phrase.tolist(), strict=True))), texts)
                own = found == phrase[of] if len(of) else np.zeros(0, bool)  # other phrases of the batch differ from task to task
                of, start, h = spans_with((of[own], place[own], found[own]), texts, span)
                yield pa.RecordBatch.from_arrays([pa.array(phrase[of]), pa.array(context[of]), pa.array(lo[of]), pa.array(hi[of]), pa.array((start - at[of]).astype(np.int32)), pa.array(h)], ["phrase", "context", "lo", "hi", "start", "h"])

    return spans


def shared_spans(df: DataFrame, key: str, text: str = "text", span: int = 200, together: int = TOGETHER) -> DataFrame:
    """(key, span_start, span_end): longest runs of the code points of a text that lie in some ``span`` code points standing, exactly the
    same, in the text of a row with another key. Offsets from 0, the end exclusive; rows without such a run have none.

    Nulls, empty texts and texts under ``span`` share nothing. ``key`` should be unique: rows of one key and different texts count as
    different texts, rows alike in both as one; a null key is a key of its own. Other columns, whatever their names, are
    dropped. A text that several keys have is shared as a whole.
    """
    if span <= PHRASE:
        raise ValueError(f"span must exceed {PHRASE}")
    docs = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    long = docs.where(F.length("text") >= span).select("id", F.xxhash64("text").alias("same"), "text")

    # Texts that several keys have; only hashes and keys are shuffled.
    hashed = long.select("id", "same", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("h"), F.length("text").alias("n"))
    copied = hashed.groupBy("h", "n").agg(F.min(F.struct("id")).alias("lo"), F.max(F.struct("id")).alias("hi")).where("lo <> hi").select("h", "n")
    whole = hashed.join(copied, ["h", "n"], "left_semi").select("id", "same", F.lit(0).alias("start"), F.col("n").alias("stop"))

    found = long.mapInArrow(_finder(span), f"phrase long, context long, same long, id {kind}, place int")
    recurring = found.groupBy("phrase").agg(F.min("same").alias("lo"), F.max("same").alias("hi")).where("lo <> hi").select("phrase")
    met = cut(found.join(recurring, "phrase", "left_semi"))
    classes = met.groupBy("phrase", "context").agg(F.min("same").alias("lo"), F.max("same").alias("hi"), F.min(F.struct("same", "id", "place")).alias("one"))
    per_phrase = classes.groupBy("phrase").agg(F.count(F.lit(1)).alias("classes"))
    wanted = classes.join(per_phrase, "phrase").groupBy(F.col("one.same").alias("of"), F.col("one.id").alias("whose")).agg(
        F.collect_list(F.struct("phrase", "context", "lo", "hi", "classes", F.col("one.place").alias("place"))).alias("wanted")
    )
    context_kind = "phrase long, context long, lo long, hi long, classes long, at int, text string"
    texts = long.join(wanted, (F.col("same") == F.col("of")) & F.col("id").eqNullSafe(F.col("whose"))).select("text", "wanted").mapInArrow(_contexts(span), context_kind)
    few = texts.where(F.col("classes") <= together).repartition("phrase").sortWithinPartitions("phrase")
    by_shard = few.mapInArrow(_shard(span), "phrase long, context long, start int, stop int")
    hot = texts.where(F.col("classes") > together)
    known = hot.groupBy("phrase").agg(F.min(F.substring("text", F.col("at") + 1, F.lit(PHRASE))).alias("its_text"))  # one row for each phrase that hot
    many = hot.join(known, "phrase").mapInArrow(_spans(span), "phrase long, context long, lo long, hi long, start int, h long")
    twice = many.groupBy("phrase", "h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("phrase", "h")
    by_count = many.join(twice, ["phrase", "h"], "left_semi").select("phrase", "context", "start", (F.col("start") + span).alias("stop"))
    around = by_shard.unionByName(by_count)
    parts = met.join(around, ["phrase", "context"]).select("id", "same", (F.col("place") + F.col("start")).alias("start"), (F.col("place") + F.col("stop")).alias("stop"))

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        return F.when((F.size(acc) > 0) & (x["start"] <= last["stop"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    return whole.unionByName(parts).groupBy("id", "same").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("x")).select(
        "id", F.explode(F.aggregate("x", F.array().cast("array<struct<start:int,stop:int>>"), step)).alias("x")
    ).select(F.col("id").alias(key), F.col("x.start").cast("long").alias("span_start"), F.col("x.stop").cast("long").alias("span_end"))
