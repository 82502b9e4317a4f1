"""Index records and the k most similar of them for each query, exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Records that a task holds at once; queries it scores at once, and records it scores them with at once.
RECORDS, QUERIES, BLOCK = 50_000, 256, 8192
#: Rows that the copies of an index have together, at most, or one copy.
COPIES = 400_000
#: Records whose greatest score is looked at before they are.
LANE = 32


def index_records(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vectors; a null url becomes "". Repeated rows count once, chunks without a vector have no record."""
    usable = vectors.where("embedding is not null").select("id", "embedding").distinct()
    return chunks.distinct().join(usable, "id").withColumn("url", F.coalesce("url", F.lit("")))


def _unit_rows(batch: pa.RecordBatch, n: int) -> np.ndarray:
    x = batch.column(n).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _once(x: np.ndarray, names: pa.Array, k: int) -> np.ndarray:
    """Rows of x without those that can't be met: repeated ones, and of equal vectors all but the k first by name."""
    rows = np.flatnonzero(np.isfinite(x).all(axis=1))
    _, same = np.unique(np.ascontiguousarray(x[rows]).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)
    order = pc.sort_indices(names, null_placement="at_start").to_numpy()
    place = np.empty(len(names), np.int64)
    place[order] = np.cumsum(np.r_[False, pc.fill_null(pc.not_equal(names.take(pa.array(order[1:])), names.take(pa.array(order[:-1]))), False).to_numpy(zero_copy_only=False)][: len(order)])
    at = np.lexsort((place[rows], same))
    rows, same = rows[at], same[at]
    new = np.r_[True, (same[1:] != same[:-1]) | (place[rows][1:] != place[rows][:-1])][: len(rows)]
    rows, same = rows[new], same[new]
    heads = np.flatnonzero(np.r_[True, same[1:] != same[:-1]][: len(same)])
    return rows[np.arange(len(rows)) - np.repeat(heads, np.diff(np.r_[heads, len(rows)])) < k]


def _best(q: np.ndarray, x: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q and x, and their product, of the k greatest of each q, with all that equal the k-th to nine places. ``near``: x in single
    precision, by which all but those that may be among them are left out."""
    single, slack = q.astype(np.float32), np.float32((q.shape[1] + 3) * 1.2e-7 + 2e-9)  # twice the greatest error, and the nine places
    least, found = np.full(len(q), -9, np.float32), []
    for at in range(0, len(near), BLOCK):
        s = single @ near[at : at + BLOCK].T
        lanes = s.shape[1] // LANE
        s[:, max(0, len(x) - at) :] = -9  # what fills up the last lanes
        s = s.reshape(len(q), LANE, lanes)
        most = s.max(axis=1)
        if lanes >= k:  # as many records at least are as near as the k-th lane's
            np.maximum(least, np.partition(most, -k, axis=1)[:, -k] - slack, out=least)
        row, lane = np.nonzero(most >= least[:, None])
        some = s[row, :, lane]
        i, j = np.nonzero(some >= least[row][:, None])
        found.append((row[i], at + j * lanes + lane[i], some[i, j]))
    row, col, s = map(np.concatenate, zip(*found, strict=True))
    keep = (s >= least[row]) & (col < len(x))
    row, col = row[keep], col[keep]
    s = np.einsum("ij,ij->i", q[row], x[col])
    order = np.lexsort((-s, row))
    row, col, s = row[order], col[order], s[order]
    heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
    sizes = np.diff(np.r_[heads, len(row)])
    keep = s >= np.repeat(s[heads + np.minimum(sizes, k) - 1], sizes) - 1.1e-9
    return row[keep], col[keep], s[keep]


def _for_all(q: np.ndarray, x: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_best, with equal queries compared once."""
    good = np.flatnonzero(np.isfinite(q).all(axis=1))
    if not len(good):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    _, first, same = np.unique(np.ascontiguousarray(q[good]).view(np.dtype((np.void, q.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    row, col, s = _best(q[good[first]], x, near, k)
    sizes = np.bincount(row, minlength=len(first))
    begins, n = (np.cumsum(sizes) - sizes)[same], sizes[same]
    at = np.repeat(begins - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.repeat(good, n), col[at], s[at]


def _scored(k: int):
    """Of sorted rows (part, role, q_id, chunk_id, v), a part's records first: the best records of the part for each query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, records, x = None, [], None
        for batch in batches:
            keys = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if lo == hi:
                    continue
                rows = batch.slice(lo, hi - lo)
                if keys[lo] >> 1 != part:
                    part, records, x = keys[lo] >> 1, [], None
                if not keys[lo] & 1:
                    records.append(rows)
                    continue
                if not records:
                    continue
                if x is None:
                    x = np.concatenate([_unit_rows(r, 4) for r in records])
                    names = pa.concat_arrays([r.column(3) for r in records])
                    kept = _once(x, names, k)
                    x, names = x[kept], names.take(pa.array(kept))
                    near = np.pad(x.astype(np.float32), ((0, -len(x) % LANE), (0, 0)))
                for at in range(0, rows.num_rows if len(x) else 0, QUERIES):
                    some = rows.slice(at, QUERIES)
                    row, col, s = _for_all(_unit_rows(some, 4), x, near, k)
                    yield pa.RecordBatch.from_arrays([some.column(2).take(pa.array(row)), names.take(pa.array(col)), pa.array(s)], ["q_id", "chunk_id", "score"])

    return run


def top_k(queries: DataFrame, index: DataFrame, k: int = 5, key: str = "id", vector: str = "embedding", records: int = RECORDS) -> DataFrame:
    """(q_id, rank, chunk_id, score): for each query (id, embedding) the k records of greatest cosine; ties by id.

    Any number of queries: they are data like the records and never gathered. The records are laid out in parts of ``records``, every part
    meets every query once, and only k rows a query and part are ranked. Vectors that are null or not finite take no part.
    """
    k_kind, q_kind = index.schema[key].dataType.simpleString(), queries.schema["id"].dataType.simpleString()
    kinds = {index.schema[vector].dataType.simpleString(), queries.schema["embedding"].dataType.simpleString()}
    kind = kinds.pop() if len(kinds) == 1 else "array<double>"
    held = index.where(F.col(vector).isNotNull()).select(F.col(key).alias("chunk_id"), F.col(vector).cast(kind).alias("v"))
    asked = queries.where("embedding is not null").select(F.col("id").alias("q_id"), F.col("embedding").cast(kind).alias("v")).distinct()
    n = held.count()
    parts = max(1, -(-n // records))
    # Few records are copied to several tasks, among which the queries are shared out, equal ones to the same.
    shares = max(1, min(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")) // parts, COPIES // max(1, n)))
    layout = ("part", "role", "q_id", "chunk_id", "v")
    part, share = F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int"), F.pmod(F.xxhash64("v"), F.lit(shares)).cast("int")
    data = held.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).select((part * shares + F.col("to")).alias("part"), F.lit(0).alias("role"), F.lit(None).cast(q_kind).alias("q_id"), "chunk_id", "v")
    meets = asked.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select((F.col("to") * shares + share).alias("part"), F.lit(1).alias("role"), "q_id", F.lit(None).cast(k_kind).alias("chunk_id"), "v")
    both = data.select(*layout).unionByName(meets.select(*layout)).repartitionById(parts * shares, "part").sortWithinPartitions("part", "role", F.xxhash64("v"))
    found = both.mapInArrow(_scored(k), f"q_id {q_kind}, chunk_id {k_kind}, score double")
    # Cosines that are equal to nine places are equal: the last ones depend on the layout.
    rank = F.row_number().over(W.partitionBy("q_id").orderBy(F.desc(F.round("score", 9)), "chunk_id"))
    return found.repartition("q_id").distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("q_id", "rank", "chunk_id", "score")


def with_records(hits: DataFrame, index: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Hits with their records' fields, without the vectors."""
    return hits.join(index.drop(vector).withColumnRenamed(key, "chunk_id"), "chunk_id")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (recall): the share of the true hits (q_id, chunk_id) that were found. An extension."""
    met = F.col("f").isNotNull().cast("double")
    return truth.join(found.select("q_id", "chunk_id", F.lit(1).alias("f")), ["q_id", "chunk_id"], "left").agg(F.coalesce(F.avg(met), F.lit(0.0)).alias("recall"))
