"""Splitting of oversized texts at natural boundaries, as one bounded-quantifier regular expression and array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Python's str.isspace has it: the Unicode property and the four separator controls.
WS = r"[\s\x1c-\x1f]"
NOT_WS = r"[^\s\x1c-\x1f]"


def boundary_pattern(limit: int, overlap: int) -> str:
    """Alternatives ordered by the strength of the boundary they end at, each taking as much as fits.

    New text of a piece is at most ``limit - overlap``; a blank-free run longer than that but within the limit is one piece
    with less overlap. Boundaries stronger than white space are taken from the second half of the window only, so that no
    piece gets tiny. The last alternative, a cut at any character, is reached only inside a run longer than ``limit``.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("needs limit >= 1 and 0 <= overlap < limit")
    n = limit - overlap
    low = max(1, n // 2)
    strong = [] if n < 8 else [
        rf".{{{low},{n - 2}}}\n\n",
        rf".{{{low},{n - 1}}}\n",
        rf".{{{low},{n - 3}}}[.!?؟…][\"')\]»]?{WS}",
    ]
    run = [rf"{NOT_WS}{{{n + 1},{limit}}}(?={WS}|\z)"] if overlap else []
    return "(?sU)" + "|".join([rf".{{1,{n}}}\z", *strong, rf".{{0,{n - 1}}}{WS}", *run, rf".{{1,{n}}}"])


def split_texts(df: DataFrame, text: str = "text", limit: int = 1500, overlap: int = 200, out: str = "pieces") -> DataFrame:
    """``df`` with array<struct<start,stop,forced,text>> of the pieces of its texts in ``out``: offsets in code points, from 0; ``forced``
    marks a piece whose end lies inside a run without white space.

    A text within the limit is one piece; an empty or null text gives an empty array. Pieces without their overlap, one after
    another, are the text again. Other columns, their nulls and repeated rows stay as they are; an empty table stays empty;
    ``out`` replaces a column of that name. The work grows with the length of a text, times the logarithm of its number of pieces.
    """
    pattern = boundary_pattern(limit, overlap)
    given = F.col(f"`{text}`")
    whole = F.when(F.length(given) <= limit, F.array(given)).otherwise(F.regexp_extract_all(given, F.lit(pattern), F.lit(0)))
    # Generators of one row each, past which the optimizer doesn't copy an expression into every use of it.
    cut_up = df.select("*", F.explode(F.array(F.when(F.length(given) > 0, whole).otherwise(F.array().cast("array<string>")))).alias("__parts__"))
    parts = F.col("__parts__")
    # Running sums by doubling: after each step, an entry holds the sum of twice as many lengths.
    steps = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda s: s < F.size(parts))
    ends = F.aggregate(steps, F.transform(parts, F.length), lambda acc, s: F.transform(acc, lambda x, i: x + F.coalesce(F.when(i >= s, F.get(acc, i - s)), F.lit(0))))
    # Any two parts in a row have at least limit - overlap code points, so that so many hold the overlap.
    before = 2 * -(-overlap // (limit - overlap)) + 1

    def piece(p: Column, i: Column) -> Column:
        head = F.array_join(F.slice(parts, F.greatest(i + 1 - before, F.lit(1)), F.least(i, F.lit(before))), "")
        back = F.least(F.lit(overlap), F.lit(limit) - F.length(p), F.length(head))
        stop = F.get("__ends__", i)
        return F.struct(
            (stop - F.length(p) - back).alias("start"), stop.alias("stop"),
            (~p.rlike(rf"(?U){WS}\z") & F.coalesce(F.get(parts, i + 1).rlike(rf"(?U)\A{NOT_WS}"), F.lit(False))).alias("forced"),
            F.concat(F.right(head, back), p).alias("text"),
        )

    return cut_up.select("*", F.explode(F.array(ends)).alias("__ends__")).withColumn(out, F.transform(parts, piece)).drop("__parts__", "__ends__")
