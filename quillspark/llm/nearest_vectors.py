"""The k most similar vectors of every vector, by a forest of random-projection trees and exact reranking.

The trees are fitted on a bounded sample; every vector is put into one leaf of each tree. A query pops leaves of all trees from one
priority queue, best first: a node's priority is the sum of the squared margins by which the query lies on the other side of
the cuts above it. It never falls on the way down, so that of every level only as many nodes as leaves are wanted can lead to
one of them; a batch of queries goes down all trees together, level by level, with those. The vectors of the popped leaves
are ranked by their exact cosine, some groups of leaves at a time.

How many leaves that takes differs with the vectors and their number, so it is measured in each run: some queries are
compared with all vectors, and it is counted how far down their queues their neighbours are found. Where only vectors of a
least cosine are asked for, these lie far up the queue, and vectors at just that cosine are made up to measure with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import cut_clean, mix64, release

_FOUND = np.dtype([("other", "<i8"), ("cos", "<f4")])
#: Rows that are laid out at once, at least; of more, one a vector.
A_PASS = 100_000


def packed(rows: np.ndarray, heads: np.ndarray) -> pa.BinaryArray:
    """Binary values that begin at the given rows."""
    offsets = (np.r_[heads, len(rows)] * rows.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def unpacked(values: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The rows in all of the binary values, and how many are in each."""
    if not len(values):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    wide = pa.types.is_large_binary(values.type)
    at = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(kind), np.diff(at) // np.dtype(kind).itemsize


@dataclass(frozen=True)
class Search:
    """Parameters of the search. ``leaf``: vectors a leaf should have. ``recall``: share of the true neighbours that must be found; leaves
    are popped until it is met by ``asked`` queries taken by their hashes, at least ``visits`` of them. ``recall_near``: the same share of those
    at a least cosine, ``made`` of which are made up for each query. ``sample``: vectors
    the trees are fitted on, at most, with ``a_node`` of them for every lowest node; past sample / a_node * leaf vectors (26 millions)
    leaves grow. ``near``: levels of leaves that one task holds, so that a vector is sent there once. ``block``: vectors that a
    task holds at once; of more of them, each part is another task's."""

    trees: int = 6
    leaf: int = 1600
    recall: float = 0.96
    recall_near: float = 0.995
    made: int = 20
    asked: int = 200
    visits: int = 12
    sample: int = 262_144
    a_node: int = 16
    near: int = 3
    block: int = 40_000
    seed: int = 7


def fit_forest(x: np.ndarray, depth: int, trees: int, seed: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For every tree and level, the directions and thresholds of its nodes: the line through two random vectors of the node, cut at
    the median."""
    forest = []
    for t in range(trees):
        rng = np.random.default_rng((seed, t))
        nodes, levels = [np.arange(len(x))], []
        for _ in range(depth):
            ways, at, below = np.zeros((len(nodes), x.shape[1]), np.float32), np.zeros(len(nodes), np.float32), []
            for k, i in enumerate(nodes):
                way = rng.standard_normal(x.shape[1])
                if len(i) > 1:
                    a, b = x[rng.choice(i, 2, replace=False)]
                    way = a - b if (a != b).any() else way
                ways[k] = way / np.linalg.norm(way)
                p = x[i] @ ways[k]
                at[k] = np.median(p) if len(i) else 0
                below += [i[p < at[k]], i[p >= at[k]]]
            levels.append((ways, at))
            nodes = below
        forest.append(levels)
    return forest


def leaves(forest: list, x: np.ndarray) -> np.ndarray:
    """The leaf of every vector in every tree, numbered over all trees."""
    out = np.zeros((len(x), len(forest)), np.int32)
    for t, levels in enumerate(forest):
        node = np.zeros(len(x), np.int64)
        for ways, at in levels:
            node = node * 2 + (np.einsum("ij,ij->i", x, ways[node]) >= at[node])
        out[:, t] = node + t * (1 << len(levels))
    return out


def popped(forest: list, x: np.ndarray, visits: int) -> np.ndarray:
    """The leaves that a queue shared by all trees gives out first, for every query, in order."""
    depth = len(forest[0])
    node = np.zeros((len(x), len(forest)), np.int64)
    tree = np.broadcast_to(np.arange(len(forest)), node.shape)
    far = np.zeros(node.shape, np.float32)
    for level in range(depth):
        ways, at = (np.stack([t[level][k] for t in forest]) for k in (0, 1))
        if node.shape[1] * 2 < ways.shape[0] * ways.shape[1]:
            m = np.einsum("qd,qvd->qv", x, ways[tree, node]) - at[tree, node]
        else:  # most nodes are asked for: all of them in one product
            m = np.take_along_axis(x @ ways.reshape(-1, x.shape[1]).T - at.ravel(), tree * ways.shape[1] + node, axis=1)
        far = np.concatenate([far + np.square(np.maximum(m, 0)), far + np.square(np.maximum(-m, 0))], axis=1)
        node, tree = np.concatenate([node * 2, node * 2 + 1], axis=1), np.concatenate([tree, tree], axis=1)
        if far.shape[1] > visits:
            best = np.argpartition(far, visits - 1, axis=1)[:, :visits]
            far, node, tree = (np.take_along_axis(v, best, axis=1) for v in (far, node, tree))
    order = np.argsort(far, axis=1, kind="stable")
    return np.take_along_axis(node + tree * (1 << depth), order, axis=1).astype(np.int32)


def visits_for(forest: list, x: np.ndarray, near: list[np.ndarray], recall: float, least: int) -> int:
    """The number of leaves after which the queries have met the share ``recall`` of their neighbours; ``near``: of each query the
    neighbours' vectors."""
    met = []
    n = len(forest) << len(forest[0])
    for q, others in zip(x, near, strict=True):
        place = np.empty(n, np.int64)
        place[popped(forest, q[None, :], n)[0]] = np.arange(n)
        if len(others):
            met.append(place[leaves(forest, others)].min(axis=1))
    if not met:
        return min(n, least)
    met = np.sort(np.concatenate(met))
    return max(min(n, least), int(met[max(0, int(np.ceil(recall * len(met))) - 1)]) + 1)


def made_up(x: np.ndarray, cosine: float, n: int, seed: int) -> np.ndarray:
    """For each vector n others of that cosine, which lie from it in the directions in which the vectors differ."""
    rng = np.random.default_rng(seed)
    one, two = rng.integers(0, len(x), (2, len(x), n))
    way = np.where((one == two)[:, :, None], rng.standard_normal((len(x), n, x.shape[1])), x[one].astype(np.float64) - x[two])
    way = way - np.einsum("qnd,qd->qn", way, x)[:, :, None] * x[:, None, :]
    way /= np.maximum(np.linalg.norm(way, axis=2, keepdims=True), 1e-9)
    return (cosine * x[:, None, :] + np.sqrt(max(0.0, 1 - cosine * cosine)) * way).astype(np.float32)


def _exact(x: np.ndarray, names: np.ndarray, k: int):
    """Of every partition, the k nearest vectors of each of the given queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cos = [[] for _ in names], [[] for _ in names]
        for batch in batches:
            vec = batch.column(1).to_pylist()
            s = x @ np.frombuffer(b"".join(vec), np.float32).reshape(-1, x.shape[1]).T
            s[names[:, None] == batch.column(0).to_numpy()[None, :]] = -9
            for q, top in enumerate(best(s, k)):
                held[q] += [vec[j] for j in top]
                cos[q] += s[q, top].tolist()
                keep = np.argsort(-np.array(cos[q]), kind="stable")[:k]
                held[q], cos[q] = [held[q][j] for j in keep], [cos[q][j] for j in keep]
        out = [(q, c, v) for q in range(len(names)) for c, v in zip(cos[q], held[q], strict=True) if c > -2]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.float64(), pa.binary()), strict=True)], ["q", "cos", "vec"])

    return run


def _unit(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            with np.errstate(all="ignore"):
                big = np.abs(x).max(axis=1, initial=0)
                x = x / big[:, None]
                x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
            good = np.flatnonzero(np.isfinite(x).all(axis=1) & (big > 0))
            x = x[good] + np.float32(0)
            h = np.zeros(len(good), np.uint64)
            for part in x.view(np.uint32).astype(np.uint64).T:
                h = mix64(h * np.uint64(3) + part + np.uint64(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), pa.array(h.view(np.int64)), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "cls", "vec"])

    return run


def spread(own: np.ndarray, seen: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A row for every vector and group of leaves, 1 << ``near`` in a row, that it lies in or looks into: the vector, the group, the leaf in it
    where it lies (-1 for none), the leaves it looks into as bits."""
    row = np.concatenate([np.repeat(np.arange(len(own)), own.shape[1]), np.repeat(np.arange(len(seen)), seen.shape[1])])
    leaf = np.concatenate([own.ravel(), seen.ravel()]).astype(np.int64)
    inner = leaf & ((1 << near) - 1)
    is_own = np.arange(len(row)) < own.size
    key = row << 40 | leaf >> near
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    lies = np.maximum.reduceat(np.where(is_own, inner, -1)[order], heads)
    looks = np.bitwise_or.reduceat(np.where(is_own, 0, np.left_shift(1, inner))[order], heads)
    return key[heads] >> 40, (key[heads] & ((1 << 40) - 1)).astype(np.int32), lies.astype(np.int32), looks.astype(np.int32)


def route(levels: int) -> np.dtype:
    """A vector's row for one group of 1 << ``levels`` leaves: of spread, without the vector."""
    return np.dtype([("group", "<i4"), ("lies", "i1"), ("looks", "u1")] if levels <= 3 else [("group", "<i4"), ("lies", "<i4"), ("looks", "<i4")])


def _routed(forest: list, dim: int, visits: int, levels: int):
    kind = route(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                b = batch.slice(k, 2000)
                x = unpacked(b.column(1), np.float32)[0].reshape(-1, dim)
                row, group, lies, looks = spread(leaves(forest, x), popped(forest, x, visits), levels)
                out = np.empty(len(row), kind)
                out["group"], out["lies"], out["looks"] = group, lies, looks
                yield pa.RecordBatch.from_arrays([*b.columns, packed(out, np.searchsorted(row, np.arange(len(x))))], ["cls", "vec", "routes"])

    return run


def _laid_out(levels: int, parts: dict[int, int], passes: int, now: int):
    """The rows of those groups whose turn is ``now``."""
    kind = route(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                b = batch.slice(k, 2000)
                at, sizes = unpacked(b.column(2), kind)
                row = np.repeat(np.arange(len(sizes)), sizes)
                turn = np.flatnonzero(at["group"] % passes == now)
                row, group, lies, looks = row[turn], at["group"][turn], at["lies"][turn].astype(np.int32), at["looks"][turn].astype(np.int32)
                cls = b.column(0).to_numpy()
                n = np.array([parts.get(v, 1) for v in group.tolist()], np.int64) if parts else np.ones(len(group), np.int64)
                home = (mix64(cls.view(np.uint64))[row] % n.astype(np.uint64)).astype(np.int64)
                again = np.repeat(np.arange(len(row)), n)
                part = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
                lies = np.where(part == home[again], lies[again], -1).astype(np.int32)
                keep = (lies >= 0) | (looks[again] != 0)
                again, part, lies = again[keep], part[keep].astype(np.int32), lies[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[again]), pa.array(part), pa.array(lies), pa.array(looks[again]), pa.array(cls[row[again]]), b.column(1).take(pa.array(row[again]))],
                    ["grp", "part", "lies", "looks", "cls", "vec"],
                )

    return run


#: Columns whose maximum is looked at before they are.
LANE = 32


def best(sim: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest values of every row, in no order. In wide rows, these lie in the k lanes of greatest maxima."""
    n = sim.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), sim.shape)
    if n % LANE or n <= 2 * LANE * k:
        return np.argpartition(-sim, k - 1, axis=1)[:, :k]
    lanes = n // LANE
    most = sim.reshape(len(sim), LANE, lanes).max(axis=1)
    cols = (np.argpartition(-most, k - 1, axis=1)[:, :k, None] + np.arange(LANE) * lanes).reshape(len(sim), -1)
    top = np.argpartition(-np.take_along_axis(sim, cols, axis=1), k - 1, axis=1)[:, :k]
    return np.take_along_axis(cols, top, axis=1)


class Group:
    """The vectors of some leaves of a tree, and the queries that look into them. ``least``: of lesser cosines none is wanted."""

    def __init__(self, k: int, least: float = -2):
        self.k, self.least, self.rows, self.of = k, np.float32(least - 1e-6), [], {}

    def add(self, lies: np.ndarray, looks: np.ndarray, cls: np.ndarray, x: np.ndarray) -> None:
        self.rows.append((lies, looks, cls, x))

    def close(self) -> Iterator[pa.RecordBatch]:
        """All vectors are there; those that are queries too are answered."""
        if self.rows:
            lies, looks, cls, x = (np.concatenate(c) for c in zip(*self.rows, strict=True))
            self.rows = []
            for v in np.unique(lies).tolist():  # filled up to whole lanes
                own, block = cls[lies == v], x[lies == v]
                self.of[v] = np.pad(own, (0, -len(own) % LANE)), np.pad(block, ((0, -len(own) % LANE), (0, 0))), len(own)
            place = np.zeros(len(lies), np.int64)
            for v in self.of:
                place[lies == v] = np.arange(np.count_nonzero(lies == v))
            yield from self.answer(looks, cls, x, lies, place)

    def answer(self, looks: np.ndarray, cls: np.ndarray, x: np.ndarray, lies: np.ndarray | None = None, place: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """``lies``, ``place``: the leaf and place in it of queries that are vectors of the group, which are not their own neighbours."""
        for at in range(0, len(cls), 1000):
            some = slice(at, at + 1000)
            c, v, bits = cls[some], x[some], looks[some]
            of, other, cos = [], [], []
            for leaf, (ids, block, n) in self.of.items():
                q = np.flatnonzero(bits >> leaf & 1)
                if not len(q):
                    continue
                s = v[q] @ block.T
                if lies is not None:
                    own = np.flatnonzero(lies[some][q] == leaf)
                    s[own, place[some][q[own]]] = -9
                s[:, n:] = -9
                if self.least > -2:
                    some_are = np.flatnonzero(s.max(axis=1) >= self.least)
                    if not len(some_are):
                        continue
                    q, s = q[some_are], s[some_are]
                top = best(s, self.k)
                of.append(np.repeat(q, top.shape[1]))
                other.append(ids[top].ravel())
                cos.append(np.take_along_axis(s, top, axis=1).ravel())
            if not of:
                continue
            of, other, cos = np.concatenate(of), np.concatenate(other), np.concatenate(cos)
            order = np.lexsort((-cos, of))  # leaves of one tree have no vector in common
            of, other, cos = of[order], other[order], cos[order]
            first = np.r_[True, of[1:] != of[:-1]]
            rank = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
            keep = (rank < self.k) & (cos > -2) & (cos >= self.least)
            found = np.empty(int(keep.sum()), _FOUND)
            found["other"], found["cos"] = other[keep], cos[keep]
            heads = np.flatnonzero(np.r_[True, of[keep][1:] != of[keep][:-1]]) if len(found) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c[of[keep][heads]]), packed(found, heads)], ["cls", "found"])


def _ranked(dim: int, k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, closed = None, Group(k, least), True
        for batch in batches:
            grp, part, lies, looks, cls = (batch.column(c).to_numpy() for c in range(5))
            x = unpacked(batch.column(5), np.float32)[0].reshape(-1, dim)
            query = lies < 0
            cuts = np.flatnonzero((grp[1:] != grp[:-1]) | (part[1:] != part[:-1]) | (query[1:] != query[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(grp)], strict=True):
                if lo == hi:
                    continue
                if at != (grp[lo], part[lo]):
                    if not closed:
                        yield from group.close()
                    at, group, closed = (grp[lo], part[lo]), Group(k, least), False
                if not query[lo]:
                    group.add(lies[lo:hi], looks[lo:hi], cls[lo:hi], x[lo:hi])
                    continue
                if not closed:
                    yield from group.close()
                    closed = True
                yield from group.answer(looks[lo:hi], cls[lo:hi], x[lo:hi])
        if not closed:
            yield from group.close()

    return run


def merged(q: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best different rows of every query; ``q``: sorted. Equal cosines go by the last bits of the other's name."""
    q, rows = q[rows["cos"] > -2], rows[rows["cos"] > -2]
    name = np.cumsum(np.r_[False, q[1:] != q[:-1]][: len(q)]).astype(np.uint64)
    key = name << np.uint64(44) | rows["other"].view(np.uint64) & np.uint64((1 << 44) - 1)
    order = np.argsort(key)
    again = np.r_[False, key[order][1:] == key[order][:-1]][: len(q)]
    if (again & np.r_[False, rows["other"][order][1:] != rows["other"][order][:-1]][: len(q)]).any():  # two names that end alike
        order = np.lexsort((rows["other"], name))
        again = np.r_[False, (name[order][1:] == name[order][:-1]) & (rows["other"][order][1:] == rows["other"][order][:-1])][: len(q)]
    order = order[~again]
    bits = (np.float32(0) - rows["cos"][order]).view(np.uint32)
    far = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)  # in the order of the floats
    order = order[np.argsort(name[order] << np.uint64(32) | far, kind="stable")]
    name = name[order]
    heads = np.flatnonzero(np.r_[True, name[1:] != name[:-1]][: len(name)])
    rank = np.arange(len(name)) - np.repeat(heads, np.diff(np.r_[heads, len(name)]))
    return q[order][rank < k], rows[order][rank < k]


def _merged(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, rows = np.zeros(0, np.int64), np.zeros(0, _FOUND)

        def out(n: int) -> pa.RecordBatch:
            best_q, best_rows = merged(q[:n], rows[:n], k)
            heads = np.flatnonzero(np.r_[True, best_q[1:] != best_q[:-1]][: len(best_q)])
            return pa.RecordBatch.from_arrays([pa.array(best_q[heads]), packed(best_rows, heads)], ["cls", "found"])

        for batch in batches:
            more, sizes = unpacked(batch.column(1), _FOUND)
            q, rows = np.concatenate([q, np.repeat(batch.column(0).to_numpy(), sizes)]), np.concatenate([rows, more])
            whole = int(np.searchsorted(q, q[-1])) if len(q) else 0
            if whole > 200_000:
                yield out(whole)
                q, rows = q[whole:], rows[whole:]
        yield out(len(q))

    return run


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, sizes = unpacked(batch.column(1), _FOUND)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(rows["other"].copy()), pa.array(rows["cos"].copy())], ["cls", "other", "cos"])


def nearest_vectors(df: DataFrame, key: str, vector: str, k: int = 10, search: Search | None = None, at_least: float | None = None) -> DataFrame:
    """(key, rank, other, cosine): the k most similar other rows of every row, rank from 1; equal cosines in the order of keys.

    Null and all-zero vectors, vectors with null or not finite elements, and vectors of another length than most have take no part.
    Rows alike in key and vector count once; rows of one key are not each other's neighbours. Equal vectors are one class
    while searched, so copies cost nothing. With fewer than k other rows, all come. An empty table gives no rows; other columns
    are dropped. Every row is indexed and is a query. ``at_least``: only rows of that cosine or more, for which far fewer leaves are popped.
    """
    search = search or Search()
    kind = df.schema[key].dataType.simpleString()
    given = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where("v is not null and not exists(v, x -> x is null)")
    sizes = given.where("size(v) > 0").groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    dim = (sizes.orderBy(F.desc("n"), "d").first() or [0])[0]
    out_names = [key, "rank", "other", "cosine"]
    if not dim:
        return df.select(F.col(f"`{key}`").alias("id"), F.lit(0).alias("rank"), F.col(f"`{key}`").alias("other"), F.lit(0.0).alias("cosine")).where("false").toDF(*out_names)
    units = given.where(F.size("v") == dim).mapInArrow(_unit(dim), f"id {kind}, cls long, vec binary")
    members = cut_clean(units.select("id", "cls").distinct())
    vectors = cut_clean(units.groupBy("cls").agg(F.first("vec").alias("vec")))
    n = vectors.count()
    depth = max(0, min(int(np.ceil(np.log2(max(n, 1) / search.leaf))), int(np.log2(max(1, search.sample / search.a_node)))))
    span = 1 << 40

    def taken(most: int, seed: int) -> list:
        """About so many vectors, at most so many, of least mixed hashes: the same ones however the table is laid out."""
        h = F.pmod(F.xxhash64("cls", F.lit(seed)), F.lit(span))
        some = vectors.where(h < min(span, -(-span * most * 5 // (4 * max(1, n))))).select(h.alias("h"), "cls", "vec").limit(2 * most)
        return sorted(some.collect(), key=lambda r: (r.h, r.cls))[:most]

    fitted = np.frombuffer(b"".join(r.vec for r in taken(min(search.sample, max(20_000, search.a_node << depth)), search.seed)), np.float32).reshape(-1, dim)
    forest = fit_forest(fitted, depth, search.trees if depth else 1, search.seed)
    visits, levels, rows = 1, min(search.near, depth), 1.0
    if depth:
        asked = taken(search.asked, search.seed + 1)
        x, names = np.frombuffer(b"".join(r.vec for r in asked), np.float32).reshape(-1, dim), np.array([r.cls for r in asked], np.int64)
        exact = vectors.select("cls", "vec").mapInArrow(_exact(x, names, k), "q int, cos double, vec binary")
        exact = exact.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("cos"), "vec"))).where(F.col("r") <= k).select("q", "vec").collect()  # k for each asked
        near = [np.frombuffer(b"".join(r.vec for r in exact if r.q == q), np.float32).reshape(-1, dim) for q in range(len(names))]
        if at_least is not None:
            near = [np.concatenate([v[v @ q >= at_least], more]) for q, v, more in zip(x, near, made_up(x, at_least, search.made, search.seed), strict=True)]
        visits = visits_for(forest, x, near, search.recall if at_least is None else search.recall_near, search.visits)
        rows = len(spread(leaves(forest, x), popped(forest, x, visits), levels)[0]) / len(x)
    parts: dict[int, int] = {}
    if n * 2 > search.block << (depth - levels):  # only then a group may exceed a block; one row a group, of which there are few
        counted = vectors.mapInArrow(_groups_only(forest, dim, levels), "grp int").groupBy("grp").count().where(F.col("count") > search.block).collect()
        parts = {r["grp"]: -(-r["count"] // search.block) for r in counted}
    routed = cut_clean(vectors.select("cls", "vec").mapInArrow(_routed(forest, dim, visits, levels), "cls long, vec binary, routes binary"))
    release(vectors)
    # About one row a vector is laid out at once, and the best so far are kept.
    passes, best_yet = min(int(np.ceil(rows)), 1 + int(n * rows) // A_PASS), None
    for now in range(passes):
        laid = routed.mapInArrow(_laid_out(levels, parts, passes, now), "grp int, part int, lies int, looks int, cls long, vec binary")
        scored = laid.repartition("grp", "part").sortWithinPartitions("grp", "part", F.col("lies") < 0).mapInArrow(_ranked(dim, k, -2 if at_least is None else at_least), "cls long, found binary")
        both = scored if best_yet is None else scored.unionByName(best_yet)
        better = cut_clean(both.repartition("cls").sortWithinPartitions("cls").mapInArrow(_merged(k), "cls long, found binary"))
        if best_yet is not None:
            release(best_yet)
        best_yet = better
    release(routed)
    top = best_yet.mapInArrow(_each, "cls long, other long, cos float")

    firsts = members.withColumn("n", F.row_number().over(W.partitionBy("cls").orderBy("id"))).where(F.col("n") <= k + 1).select(F.col("cls").alias("other"), F.col("id").alias("oid"))
    copied = members.groupBy("cls").count().where("count > 1")  # of others, the only row is their own neighbour
    own = copied.select("cls", F.col("cls").alias("other"), F.lit(1.0).cast("float").alias("cos"))
    near = top.unionByName(own).join(firsts, "other")
    ranked = near.withColumn("r", F.row_number().over(W.partitionBy("cls").orderBy(F.desc("cos"), "oid"))).where(F.col("r") <= k + 1)
    lists = ranked.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("r", "oid", "cos"))).alias("x"))
    each = members.join(lists, "cls").select("id", F.posexplode(F.slice(F.filter("x", lambda e: ~e["oid"].eqNullSafe(F.col("id"))), 1, k)).alias("p", "e"))
    out = each.select("id", (F.col("p") + 1).alias("rank"), F.col("e.oid").alias("other"), F.col("e.cos").cast("double").alias("cosine")).toDF(*out_names)
    return out if at_least is None else out.where(F.col("cosine") >= at_least)


def _groups_only(forest: list, dim: int, near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([pa.array(leaves(forest, x).ravel() >> near)], ["grp"])

    return run
