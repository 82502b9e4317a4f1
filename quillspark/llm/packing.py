"""Filling of fixed-capacity containers: vector bin packing with a dot-product heuristic under limits on tokens, segments and
loss-bearing tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that one task packs. Every group of items ends with at most a few containers that could be fuller, so the space lost by
#: packing groups apart is about one container in some thousand.
GROUP = 20_000


def fill(need: np.ndarray, count: np.ndarray, limits: np.ndarray) -> Iterator[list[int]]:
    """Containers, as lists of the types of the items in them, for ``count`` items of each type; ``need`` has a row of demands
    for each type, all within ``limits``.

    Demands are shares of the limits, weighted by how much of each limit all items want. A container starts with the item of
    greatest demand, then takes the fitting item whose demands, at length one, have the greatest dot product with what is left: the
    one that uses up the limits most evenly; of such items (to a fiftieth) the one of greatest demand. Where segments are plenty, a pair of
    items that fills the tokens better than that item comes first.
    """
    share = need / limits
    weight = count @ share
    weight = weight / max(weight.max(), 1e-12)
    share = share * weight
    plenty = weight[1] < 0.5
    order = np.argsort(-(share.sum(axis=1)), kind="stable")
    need, share, count = need[order], share[order], count[order].copy()
    length = np.linalg.norm(share, axis=1)
    by_size = np.argsort(need[:, 0], kind="stable")
    sizes = need[by_size, 0]
    first, left_items = 0, int(count.sum())
    while left_items:
        while not count[first]:
            first += 1
        left, kinds, k = limits.astype(np.int64).copy(), [], first
        while True:
            count[k] -= 1
            left_items -= 1
            left -= need[k]
            kinds.append(int(order[k]))
            if not left_items or (left <= 0).any() and not (need[count > 0] <= left).all(axis=1).any():
                break
            fit = np.flatnonzero((count > 0) & (need <= left).all(axis=1))
            if not len(fit):
                break
            rest = left / limits * weight
            dots = share[fit] @ rest
            along = dots / np.maximum(length[fit] * np.linalg.norm(rest), 1e-12)
            k = int(fit[np.argmax(np.round(along * 50) * 100 + dots)])
            if plenty and need[k, 0] < left[0] and len(fit) > 1:
                k = best_of_two(need, count, left, fit, k, by_size, sizes)
        yield kinds
        if left_items and 2 * np.count_nonzero(count) < len(count):  # types without items are looked at no more
            on = count > 0
            need, share, length, order, count, first = need[on], share[on], length[on], order[on], count[on], 0
            by_size = np.argsort(need[:, 0], kind="stable")
            sizes = need[by_size, 0]


def best_of_two(need: np.ndarray, count: np.ndarray, left: np.ndarray, fit: np.ndarray, k: int, by_size: np.ndarray, sizes: np.ndarray) -> int:
    """The larger item of the fitting pair that leaves fewest tokens, if it leaves fewer than ``k`` alone; else ``k``."""
    own = by_size[np.isin(by_size, fit, assume_unique=True)]
    size = need[own, 0]
    mate = np.searchsorted(size, left[0] - size, side="right") - 1
    ok = mate >= 0
    same = mate == np.arange(len(own))
    mate = np.where(same & (count[own] < 2), mate - 1, mate)
    ok &= mate >= 0
    total = np.where(ok, size + size[np.maximum(mate, 0)], -1)
    if len(left) > 1:
        total = np.where((need[own, 1:] + need[own[np.maximum(mate, 0)], 1:] <= left[1:]).all(axis=1), total, -1)
    best = int(np.argmax(total))
    if total[best] <= need[k, 0]:
        return k
    a, b = own[best], own[mate[best]]
    return int(a if need[a, 0] >= need[b, 0] else b)


def pack(items: DataFrame, key: str, tokens: str, loss: str | None = None, capacity: int = 2048, segments: int = 512, loss_capacity: int | None = None, group: int = GROUP, n_items: int | None = None) -> DataFrame:
    """(key, piece, first_token, last_token, container, container_tokens): every item's place; offsets from 0, the last one exclusive.

    ``items`` has a row per item; ``tokens`` (null counts as 0) and ``loss`` (the loss-bearing part of them, by default all) are its
    demands; every piece is one segment. An item over a capacity, and no other, is cut: into pieces that fill containers of their own
    and a rest that is packed like any item; a cut item's loss-bearing tokens are taken as spread evenly. Repeated rows are
    items of their own; other columns are dropped; a null key is a key like any other. Items of no tokens get a
    container too. Containers have names unique over all groups. No row is dropped; an empty table gives no rows.

    Groups of about ``group`` items are packed in parallel; a group is a hash of an item and of its number among equal rows, so
    that a row repeated very often spreads over all groups. ``n_items``: the number of rows, where it is known; else
    they are counted.
    """
    if capacity < 1 or segments < 1 or group < 1:
        raise ValueError("capacity, segments and group must be at least 1")
    loss_limit = loss_capacity or capacity
    equal = items.select(
        F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{tokens}`"), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.col(f"`{loss or tokens}`"), F.lit(0)).cast("long").alias("loss"),
    ).groupBy("key", "size", "loss").agg(F.count(F.lit(1)).alias("n"))
    named = equal.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
    # Most tokens a piece may have, so that neither limit is passed.
    most = F.when(F.col("loss") > loss_limit, F.greatest(F.lit(1), F.least(F.lit(capacity), F.floor(F.col("size") * loss_limit / F.col("loss"))))).otherwise(F.lit(capacity)).cast("long")
    pieces = named.withColumn("most", most).withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / F.col("most")) - 1)))).select(
        "key", "copy", F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.col("most")).alias("first_token"),
        F.least(F.col("size"), (F.col("piece") + 1) * F.col("most")).alias("last_token"),
        F.when(F.col("size") > 0, F.ceil(F.col("loss") * F.least(F.col("most"), F.col("size") - F.col("piece") * F.col("most")) / F.col("size"))).otherwise(0).cast("long").alias("loss"),
    )
    groups = max(1, -(-(items.count() if n_items is None else n_items) // group))
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("key", "copy", "piece", "last_token"), F.lit(groups)).cast("int"))
    limits = np.array([capacity, segments, loss_limit], np.int64)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "copy", "piece"], kind="stable").reset_index(drop=True)
        demand = np.stack([(pdf.last_token - pdf.first_token).to_numpy(), np.ones(len(pdf), np.int64), np.minimum(pdf.loss.to_numpy(), loss_limit)], axis=1)
        kinds, kind_of = np.unique(demand, axis=0, return_inverse=True)
        members = np.split(np.argsort(kind_of.ravel(), kind="stable"), np.cumsum(np.bincount(kind_of.ravel()))[:-1])
        at = [0] * len(kinds)
        where, full = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
        for c, bin_kinds in enumerate(fill(kinds, np.bincount(kind_of.ravel()), limits)):
            total = int(kinds[bin_kinds, 0].sum())
            for k in bin_kinds:
                row = members[k][at[k]]
                at[k] += 1
                where[row], full[row] = c, total
        names = pdf.part.astype(str) + "-" + pd.Series(where).astype(str)
        return pdf[["key", "piece", "first_token", "last_token"]].assign(container=names, container_tokens=full)

    def place_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        for _, of in pd.concat(held).groupby("part") if held else ():
            yield place(of)

    kind = items.schema[key].dataType.simpleString()
    # Groups go to tasks by their number, so that no task gets two of them while another has none.
    out = salted.repartitionById(groups, "part").mapInPandas(place_all, f"key {kind}, piece int, first_token long, last_token long, container string, container_tokens long")
    return out.withColumnRenamed("key", key)
