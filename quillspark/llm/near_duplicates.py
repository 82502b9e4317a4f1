"""Near-duplicate texts: pairs whose sets of word sequences are similar, by deletion-variant signatures.

A text's sketch is a row of MinHash symbols; two texts differ in a symbol as often as their sets differ. Cut into segments, few enough
that some segment of similar texts differs in at most one symbol, a sketch is indexed under every segment with each of its symbols
wiped out in turn, some segments at a time. Texts equal in such a variant are candidates. Candidates are sifted where they meet, by
one and by two bits of each symbol, and by eight bits of each, then verified exactly on the sets. Sketches are kept, with 16 bits a symbol; sets are made again for candidates.

Texts with the same set are one class, told by 128 bits; classes, not texts, are compared.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, cut_clean, hash64, mix64, release

SEGMENTS, SYMBOLS = 32, 5
#: Of 128 bits, as many may differ: at a similarity of 0.5, 32 do on average, with a deviation of 4.9.
BITS_APART = 50
#: Of all symbols, as many must be equal in two bits: at a similarity of 0.5, 100 are on average, with a deviation of 6.1. Texts of one making
#: that are not similar meet as often as their number squared, so what they would take of the disk must be little.
TWINS = 72
#: Of all symbols, as many must be equal: at a similarity of 0.5, 80 are on average, with a deviation of 6.3, and fewer than 52 once in 300,000.
EQUAL = 52
#: Members of one variant that are matched at once; those of larger ones are matched by their rarest sequences, which texts of one making share
#: with very many others.
TOGETHER = 1 << 15
#: Parts in which the segments are laid out, one after the other, at most, and as many classes as one more part is for.
PASSES, A_PASS = 16, 4000

_WORD = re.compile(r"\w+")
_SEEDS = mix64(np.arange(1, SEGMENTS * SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _hashed(n_words: int, seed: int):
    """(places, sets, classes, checks) of those of the given texts that have a sequence."""
    known: dict[str, int] = {}

    def hashes(words: list[str]) -> np.ndarray:
        for w in words:
            if w not in known:
                if len(known) > 500_000:
                    known.clear()
                known[w] = hash64(w.encode("utf-8", "surrogatepass"))
        return np.array([known.get(w) or hash64(w.encode("utf-8", "surrogatepass")) for w in words], np.int64).view(np.uint64)

    def run(texts: list[str | None]) -> tuple[list[int], list[np.ndarray], list[int], list[int]]:
        keep, sets, classes, checks = [], [], [], []
        for k, t in enumerate(texts):
            words = _WORD.findall(t.lower()) if t else []
            if len(words) < n_words:
                continue
            h, n = hashes(words), len(words) - n_words + 1
            s = np.zeros(n, np.uint64)
            for j in range(n_words):
                s = mix64(s * np.uint64(3) + h[j : j + n])
            s = np.unique(s)
            keep.append(k)
            sets.append(s.view(np.int64))
            classes.append(hash64(seed.to_bytes(8, "little") + s.tobytes()))
            checks.append(int(mix64(s * np.uint64(7) + np.uint64(seed)).sum(dtype=np.uint64).view(np.int64)))
        return keep, sets, classes, checks

    return run


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))


def _sets(n_words: int, seed: int = 0, wanted: np.ndarray | None = None):
    """``wanted``: bits; only texts whose names' bit is set are cut up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _hashed(n_words, seed)
        for batch in batches:
            if wanted is not None:
                at = text_names(batch.column(1).to_pylist()).view(np.uint64) % np.uint64(8 * len(wanted))
                batch = batch.take(pa.array(np.flatnonzero(wanted[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)))
            keep, sets, classes, checks = hashed(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(classes, pa.int64()), pa.array(checks, pa.int64()), _lists(sets)], ["id", "cls", "check", "seqs"]
            )

    return run


def text_names(texts: list[str]) -> np.ndarray:
    return np.array([hash64(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)


def _sketched(n_words: int, seed: int):
    """Names of every text's class, the text's own and the last 16 bits of every symbol; the sets themselves are not kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _hashed(n_words, seed)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = part.column(1).to_pylist()
                keep, sets, classes, checks = hashed(texts)
                rows = [r.tobytes() for r in symbols(sets).astype(np.uint16)] if sets else []
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(keep, pa.int64())), pa.array(classes, pa.int64()), pa.array(checks, pa.int64()), pa.array(text_names([texts[j] for j in keep])), pa.array(rows, pa.binary())],
                    ["id", "cls", "check", "name", "sketch"],
                )

    return run


def symbols(seqs: list[np.ndarray]) -> np.ndarray:
    """A row of MinHash symbols for every set."""
    return np.stack([mix64(s.view(np.uint64)[:, None] ^ _SEEDS).min(axis=0) for s in seqs])


def variants(rows: np.ndarray, low: int = 0, high: int = SEGMENTS) -> np.ndarray:
    """For every row, the hashes of its segments from ``low`` up to ``high`` with one symbol wiped out."""
    seg = mix64(rows.reshape(-1, SEGMENTS, SYMBOLS)[:, low:high].astype(np.uint64) + np.arange(SYMBOLS, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    seg = mix64(seg * np.uint64(5) + np.uint64(11))
    left = seg.sum(axis=2, dtype=np.uint64)[:, :, None] - seg  # a sum of mixed symbols, less the one wiped out
    place = np.arange(SEGMENTS * SYMBOLS, dtype=np.uint64).reshape(SEGMENTS, SYMBOLS)[low:high]
    return mix64(left ^ mix64(place + np.uint64(77))).reshape(len(rows), -1).view(np.int64)


def sift_bits(rows: np.ndarray) -> np.ndarray:
    """Two bits of each symbol, as five numbers a row: those of the first 128 symbols, two numbers for the one bit and two for the other,
    then those of the last 32, half a number each."""
    one, two = (np.packbits((rows >> np.uint16(k) & np.uint16(1)).astype(np.uint8), axis=1) for k in (7, 6))
    return np.ascontiguousarray(np.concatenate([one[:, :16], two[:, :16], one[:, 16:], two[:, 16:]], axis=1)).view(np.int64)


def alike_bits(bits: np.ndarray, at: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows at the given places are alike in the bits of sift_bits."""
    apart = bits[at, :2] ^ bits[other, :2]
    some = np.flatnonzero(np.bitwise_count(apart).sum(axis=1) <= BITS_APART)
    last = bits[at[some], 4] ^ bits[other[some], 4]
    first = np.bitwise_count(apart[some] | (bits[at[some], 2:4] ^ bits[other[some], 2:4])).sum(axis=1)
    unlike = first + np.bitwise_count((last | last >> np.uint64(32)) & np.uint64(0xFFFFFFFF))
    return some[unlike <= SEGMENTS * SYMBOLS - TWINS]


BITS = ("b1", "b2", "b3", "b4", "b5")


def _signed(low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                rows = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SEGMENTS * SYMBOLS)
                v, bits = variants(rows, low, high), sift_bits(rows)
                beside = (part.column(0).to_numpy(), *bits.T)
                yield pa.RecordBatch.from_arrays([pa.array(v.ravel()), *(pa.array(np.repeat(x, v.shape[1])) for x in beside)], ["sig", "cls", *BITS])

    return run


def matched(sig: np.ndarray, cls: np.ndarray, bits: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of neighbours in a sorted run of signatures, the smaller class first, each once of some at a time; with ``bits``, only
    pairs alike in them."""
    at, step, left, right, n = np.arange(len(sig)), 1, [], [], 0
    while len(at):
        at = at[at + step < len(sig)]
        at = at[sig[at + step] == sig[at]]
        near = at if bits is None else at[alike_bits(bits, at, at + step)]
        left.append(np.minimum(cls[near], cls[near + step]))
        right.append(np.maximum(cls[near], cls[near + step]))
        n += len(near)
        step += 1
        if n > 200_000 or not len(at):
            lo, hi = np.concatenate(left), np.concatenate(right)
            order = np.lexsort((hi, lo))
            lo, hi = lo[order], hi[order]
            once = (lo != hi) & np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])][: len(lo)]
            yield lo[once], hi[once]
            left, right, n = [], [], 0


def _pairs(together: int):
    """Pairs of each signature's classes; a signature of more than ``together`` gives only its classes, with a null beside each. Rows with
    bits beside the class are sifted by them."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, size = None, 0  # the run that goes on from one batch to the next; once too large it is not held
        held: tuple[np.ndarray, ...] | None = None

        def out(rows: tuple[np.ndarray, ...], large: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in matched(rows[0], rows[1], np.stack(rows[2:], axis=1).view(np.uint64) if len(rows) > 2 else None):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            large = np.unique(large)
            yield pa.RecordBatch.from_arrays([pa.array(large), pa.nulls(len(large), pa.int64())], ["a", "b"])

        for batch in batches:
            rows = tuple(c.to_numpy() for c in batch.columns)
            if not len(rows[0]):
                continue
            none = tuple(r[:0] for r in rows)
            if held is not None:
                rows = tuple(map(np.concatenate, zip(held, rows, strict=True)))
            elif size:
                cut_at = int(np.searchsorted(rows[0], last, side="right"))
                yield from out(none, rows[1][:cut_at])
                if cut_at == len(rows[0]):
                    continue
                rows = tuple(r[cut_at:] for r in rows)
            sig = rows[0]
            heads = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            sizes = np.diff(np.r_[heads, len(sig)])
            small = np.repeat(sizes <= together, sizes)
            tail = int(heads[-1])
            yield from out(tuple(r[:tail][small[:tail]] for r in rows), rows[1][:tail][~small[:tail]])
            last, size, held = sig[tail], len(sig) - tail, tuple(r[tail:] for r in rows)
            if size > together:
                yield from out(none, held[1])
                held = None
        if held is not None:
            yield from out(held, held[1][:0])

    return pair


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SEGMENTS * SYMBOLS).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["cls", "half"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SEGMENTS * SYMBOLS) for k in (2, 3))
        keep = pa.array(np.flatnonzero((x == y).sum(axis=1) >= EQUAL))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = np.zeros((batch.num_rows, 1 << 12), np.uint8)
        for row, places in zip(bits, batch.column(1), strict=True):
            at = np.asarray(places.values)
            np.bitwise_or.at(row, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in bits], pa.binary())], ["block", "bits"])


def name_bits(names: DataFrame) -> np.ndarray:
    """A filter of names: a bit for the remainder of each, of at least 16 bits a name, at most 16 MB. It lets some others through."""
    n = 1 << min(27, max(15, (16 * names.count()).bit_length()))
    at = F.col("name").bitwiseAND(F.lit(n - 1))
    blocks = names.groupBy(F.shiftright(at, 15).alias("block")).agg(F.collect_set(at.bitwiseAND(F.lit((1 << 15) - 1))).alias("at"))
    out = np.zeros((n >> 15, 1 << 12), np.uint8)
    for r in blocks.mapInArrow(_packed, "block long, bits binary").collect():
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def near_duplicates(df: DataFrame, key: str, text: str, n_words: int = 3, similarity: float = 0.5, together: int = TOGETHER) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (key, cls) of all texts with at least one sequence of ``n_words`` words, links (a, b, shared, either) of
    different classes, a < b, whose sets have at least the share ``similarity`` of their union in common.

    Words are runs of letters, digits and underscores in lower case. Nulls, empty and shorter texts belong to no class. Rows alike in
    both columns count once; a null key is a key. Signatures are laid out for a similarity of 0.5: a pair at 0.5
    is missed 1.3 times in a thousand by them and 0.2 times by the sifts, at 0.6 once in ten millions. No group is capped: members of a
    variant of more than ``together`` classes are matched by a prefix of their rarest sequences, without the sift, which misses
    none; a sequence that very many of them have is matched in blocks of ``together``, by many tasks. ``df`` is read twice.
    """
    if similarity < 0.5:
        raise ValueError("signatures are laid out for a similarity of 0.5 or more")
    kind = df.schema[key].dataType.simpleString()
    base = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.length("text") > 0)
    for seed in itertools.count():  # a second time only if two sets have one name
        made = cut_clean(base.mapInArrow(_sketched(n_words, seed), f"id {kind}, cls long, check long, name long, sketch binary"))
        classes = cut_clean(made.groupBy("cls").agg((F.min("check") != F.max("check")).alias("clash"), F.min("name").alias("name"), F.first("sketch").alias("sketch")))
        if classes.where("clash").isEmpty():
            break
        release(made)
        release(classes)
    members = cut_clean(made.select("id", "cls").distinct())
    release(made)

    # Some segments at a time, so that of all signatures only a part lies on disk at once.
    passes = min(PASSES, 1 + classes.count() // A_PASS)
    ends = [SEGMENTS * k // passes for k in range(passes + 1)]
    found = []
    for low, high in itertools.pairwise(ends):
        signed = classes.select("cls", "sketch").mapInArrow(_signed(low, high), ", ".join(f"{c} long" for c in ("sig", "cls", *BITS)))
        found.append(cut_clean(signed.repartition("sig").sortWithinPartitions("sig").mapInArrow(_pairs(together), "a long, b long").distinct()))
    matches = cut_clean(functools.reduce(DataFrame.unionByName, found).distinct())
    for part in found:
        release(part)
    large = cut_clean(matches.where("b is null").select(F.col("a").alias("cls")))
    halves = classes.select("cls", "sketch").mapInArrow(_bytes, "cls long, half binary")
    beside = matches.where("b is not null").join(halves.toDF("a", "x"), "a").join(halves.toDF("b", "y"), "b").select("a", "b", "x", "y")
    near = cut_clean(beside.mapInArrow(_alike, "a long, b long"))
    release(matches)

    # The sets of only those classes that are compared are made again, and kept.
    asked = near.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(large).distinct()
    wanted = name_bits(classes.select("cls", "name").join(asked, "cls", "left_semi").select("name"))
    again = base.mapInArrow(_sets(n_words, seed, wanted), f"id {kind}, cls long, check long, seqs array<long>")
    sets = cut_clean(again.groupBy("cls").agg(F.first("seqs").alias("seqs")))
    release(classes)
    if not large.isEmpty():
        # Members of large variants are matched by their rarest sequences instead: two sets as similar share one of the first of any common order.
        each = sets.join(large, "cls", "left_semi").select("cls", F.size("seqs").alias("n"), F.explode("seqs").alias("sig"))
        order = each.join(each.groupBy("sig").count(), "sig").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("count", "sig"))).alias("x"))
        rare = order.select("cls", F.explode(F.slice("x", F.lit(1), F.col("n") - F.ceil(F.col("n") * similarity).cast("int") + 1)).alias("e"))
        # A sequence of many classes is matched block by block of them, each two blocks in a run of their own.
        n = F.ceil(F.col("e.count") / together)
        own = F.pmod(F.xxhash64("cls"), F.col("n"))
        blocks = rare.select("cls", F.col("e.sig").alias("seq"), n.alias("n")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        runs = blocks.select(F.xxhash64("seq", F.least(own, "other"), F.greatest(own, "other")).alias("sig"), "cls")
        certain = runs.repartition("sig").sortWithinPartitions("sig").mapInArrow(_pairs(1 << 40), "a long, b long").distinct()
        near = near.unionByName(certain).distinct()  # these are not sifted, so that none is missed
    both = near.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    links = both.select("a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb") - shared).alias("either")).where(F.col("shared") >= similarity * F.col("either"))
    return members.withColumnRenamed("id", key), links


def link_pairs(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(id_a, id_b): all pairs of keys of linked classes and of one class, the smaller first. Only where pairs are asked for.

    A pair comes more than once only if one of its keys has several texts; only such pairs are gathered to be told apart."""
    named = members.where(F.col(key).isNotNull()).select(F.col("cls"), F.col(key).alias("k"))
    several = named.groupBy("k").agg((F.min("cls") != F.max("cls")).alias("s"))
    named = cut_clean(named.join(several, "k"))
    m1, m2 = named.toDF("k1", "a", "s1"), named.toDF("k2", "b", "s2")
    s = (F.col("s1") | F.col("s2")).alias("s")
    between = links.select("a", "b").join(m1, "a").join(m2, "b").where("k1 <> k2").select(F.least("k1", "k2").alias("id_a"), F.greatest("k1", "k2").alias("id_b"), s)
    copies = m1.join(m2, F.col("a") == F.col("b")).where("k1 < k2").select(F.col("k1").alias("id_a"), F.col("k2").alias("id_b"), s)
    pairs = between.unionByName(copies)
    return pairs.where("not s").drop("s").unionByName(pairs.where("s").drop("s").distinct())


def groups(members: DataFrame, links: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """(key, group, links): of every member the least class it is linked to over any number of links, and its class's links.

    Labels spread and are short-cut until none changes; only linked classes take part, and the rest are their own group.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("g"))
    for _ in range(rounds):
        near = both.join(label.select(F.col("a").alias("b"), F.col("g").alias("gb")), "b").groupBy("a").agg(F.min("gb").alias("gb"))
        spread = label.join(near, "a").select("a", F.col("g").alias("old"), F.least("g", "gb").alias("g"))
        up = label.select(F.col("a").alias("g"), F.col("g").alias("gg"))
        step = cut(spread.join(up, "g", "left").select("a", "old", F.coalesce(F.least("g", "gg"), F.col("g")).alias("g")))
        label = step.select("a", "g")
        if step.where("g <> old").isEmpty():
            break
    else:
        raise RuntimeError(f"the labels still change after {rounds} rounds")
    counted = both.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    return members.join(label.join(counted, "a").withColumnRenamed("a", "cls"), "cls", "left").select(
        key, F.coalesce("g", "cls").alias("group"), F.coalesce("links", F.lit(0)).alias("links")
    )
