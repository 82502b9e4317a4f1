"""Scalar expressions: paths, pages, citations, judge replies, vectors, fingerprints, costs."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blank characters as Python's str.strip has them: the Unicode property and the four separator controls.
_WS = r"[\s\x1c-\x1f]"
#: Unit and field separator of fingerprints.
_UNIT = "\x1f"
#: Estimated price in USD of a million tokens.
PRICE_IN, PRICE_OUT = 0.5, 2.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without blanks, of Unicode too, at both ends; zero-width characters stay."""
    return F.regexp_replace(_col(c), rf"(?U)\A{_WS}+|{_WS}+\z", "")


def normalize_path(c: Column | str) -> Column:
    """Slashes forward, blanks stripped, then slashes stripped; null gives an empty path."""
    return F.coalesce(F.regexp_replace(strip(F.replace(_col(c), F.lit("\\"), F.lit("/"))), r"\A/+|/+\z", ""), F.lit(""))


def normalize_page(c: Column | str) -> Column:
    """The page as text: whole numbers without sign of a fraction, cut towards zero; other texts stripped; null stays null."""
    text = strip(_col(c).cast("string"))
    number = text.rlike(r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z")
    return F.when(number, F.coalesce(text.try_cast("double").try_cast("bigint").cast("string"), text)).otherwise(text)


_TRAILER = rf"(?iU){_WS}*CITED:{_WS}*(none|[\d,\s\x1c-\x1f]+)\z"


#: Decimal digits of all scripts but ASCII's own, and what they stand for.
_DIGITS = {chr(c): str(unicodedata.digit(chr(c))) for c in range(128, sys.maxunicode) if unicodedata.category(chr(c)) == "Nd"}


def cited_numbers(answer: Column | str) -> Column:
    """Numbers of the citation trailer at the answer's end, in digits of any script, in their order; none without a trailer."""
    body = F.translate(F.regexp_extract(strip(answer), _TRAILER, 1), "".join(_DIGITS), "".join(_DIGITS.values()))
    return F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def without_trailer(answer: Column | str) -> Column:
    """The stripped answer without its citation trailer."""
    return strip(F.regexp_replace(strip(answer), _TRAILER, ""))


def cited_hits(answer: Column | str, hits: Column) -> Column:
    """Citations {file, page} of a trailer's numbers among ``hits`` (array of rank, file, page, kind in the order of rank): out of range
    and 0 are dropped, each page stands once, where it came first; only booklets ("pdf") have pages."""
    return F.array_distinct(F.transform(
        F.filter(cited_numbers(answer), lambda n: (n >= 1) & (n <= F.size(hits))),
        lambda n: F.struct(F.get(hits, n - 1)["file"].alias("file"), F.when(F.get(hits, n - 1)["kind"] == "pdf", F.get(hits, n - 1)["page"]).alias("page")),
    ))


def parse_judgement(reply: Column | str) -> Column:
    """struct<reasoning, similarity_score, is_refusal, is_hallucination, status> of a judge's reply.

    A fence around it, text around the outermost braces and comments are dropped; if the rest is no JSON, the fields are read one by
    one from what stands within the braces, or from the whole reply where there are none. ``status``: json, fields, or error if there is no score. A score that is
    no number stays null.
    """
    text = strip(reply)
    text = F.when(text.rlike(r"(?s)\A```.*```\z"), F.regexp_replace(text, r"\A```[A-Za-z]*\s*|\s*```\z", "")).otherwise(text)
    braced = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    inner = F.when(braced == "", text).otherwise(braced)
    plain = F.regexp_replace(F.regexp_replace(inner, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")
    as_json = F.try_parse_json(plain)
    get = lambda path, kind: F.try_variant_get(as_json, f"$.{path}", kind)
    # How the fields of a reply are written.
    flag = lambda name: F.coalesce(F.regexp_extract(inner, rf'"{name}"\s*:\s*(true|false)', 1) == "true", F.lit(False))
    score = F.regexp_extract(inner, r'"similarity_score"\s*:\s*(\d+)', 1).try_cast("double")
    of_json = as_json.isNotNull() & plain.rlike(r"\A\s*\{")  # a text that only begins with a value parses too
    text_score = get("similarity_score", "string")
    json_score = F.when(plain.rlike(r'"similarity_score"\s*:\s*"'), F.lit(None)).otherwise(text_score.try_cast("double"))
    pick = lambda a, b: F.when(of_json, a).otherwise(b)
    value = pick(json_score, score)
    return F.struct(
        pick(get("reasoning", "string"), F.nullif(F.regexp_extract(inner, r'"reasoning"\s*:\s*"([^"]*)"', 1), F.lit(""))).alias("reasoning"), value.alias("similarity_score"),
        pick(F.coalesce(get("is_refusal", "boolean"), F.lit(False)), flag("is_refusal")).alias("is_refusal"),
        pick(F.coalesce(get("is_hallucination", "boolean"), F.lit(False)), flag("is_hallucination")).alias("is_hallucination"),
        F.when(value.isNull(), "error").when(of_json, "json").otherwise("fields").alias("status"),
    )


def citation_result(candidates: Column, groups: Column) -> Column:
    """struct<is_fully_correct, score, satisfied_groups_count, details> of cited pages against groups, each of which any of its pages
    satisfies; ``details`` names each group's first match in the order of its options, then of the candidates."""
    empty = F.array().cast("array<struct<file:string,page:string>>")
    named = lambda e: F.struct(normalize_path(e["file"]).alias("file"), normalize_page(e["page"]).alias("page"))
    # Normal forms are made once for each citation and option, not for each pair of them.
    cited = F.transform(F.coalesce(candidates, empty), lambda c: F.struct(c.alias("own"), named(c).alias("name")))

    def judged(g: Column, i: Column) -> Column:
        options = F.coalesce(g["any_of"], empty)
        wanted = F.transform(options, named)
        matches = F.flatten(F.transform(wanted, lambda o: F.transform(F.filter(cited, lambda c: c["name"].eqNullSafe(o)), lambda c: c["own"])))
        return F.struct(i.cast("int").alias("group_index"), (F.size(matches) > 0).alias("satisfied"), F.get(matches, F.lit(0)).alias("matched_with"), options.alias("options"))

    details = F.transform(F.coalesce(groups, F.array().cast("array<struct<any_of:array<struct<file:string,page:string>>>>")), judged)
    n, met = F.size(details), F.size(F.filter(details, lambda x: x["satisfied"]))
    return F.struct(
        (n == met).alias("is_fully_correct"), F.when(n == 0, F.lit(1.0)).otherwise(met / n).alias("score"),
        F.concat_ws("/", met.cast("string"), n.cast("string")).alias("satisfied_groups_count"), details.alias("details"),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column | str) -> Column:
    """The vector at length one; all-zero vectors give null."""
    v = _col(v)
    return F.transform(v, lambda x: x.cast("double") / F.nullif(F.sqrt(dot(v, v)), F.lit(0.0)))


def round3(x: Column | str) -> Column:
    """To three places as the exact binary value demands, ties to even; the product with 1000 is taken without error, in two parts."""
    x = _col(x).cast("double")
    high = x * 134217729.0
    high = high - (high - x)
    product = x * 1000.0
    rest = (high * 1000.0 - product) + (x - high) * 1000.0
    whole = F.floor(product).cast("double")
    over = (product - whole - 0.5) + rest
    up = (over > 0) | (over == 0) & (F.pmod(whole, F.lit(2.0)) == 1)
    return F.when(F.abs(x) < 1e12, (whole + up.cast("double")) / 1000.0).otherwise(x)


def model_prefix(model: str, kind: str) -> str:
    """What models of the E5 family want before a "query" or a "passage"."""
    return f"{kind}: " if "e5" in model.lower() else ""


def fingerprint(model: str, kind: str, key: Column | str, text: Column | str) -> Column:
    """What the embedding of a row depends on."""
    return F.sha2(F.concat_ws(_UNIT, F.lit(model), F.lit(model_prefix(model, kind)), _col(key), _col(text)), 256)


def token_cost(prompt: Column | str, completion: Column | str) -> Column:
    """Estimated USD."""
    return (_col(prompt) * PRICE_IN + _col(completion) * PRICE_OUT) / 1_000_000


def in_confidence_range(c: Column | str) -> Column:
    """Null is allowed; NaN isn't."""
    return _col(c).isNull() | ((_col(c) >= 0) & (_col(c) <= 1) & ~F.isnan(_col(c)))
