"""Defects of prompt and response pairs: empty, truncated, refusing, copying and wrong-language responses.

Copies, languages and endings are seen in the pair itself. Refusals are not: what they say differs by model and language. The
sentences of responses become templates: their words in order, the prompt's own and numbers masked. A template that recurs across
unrelated prompts and, wherever it stands, stands with other such templates only, gives no content: it refuses. Templates too rare for
that, of other words or about something else, are clustered with these by verified MinHash. No phrase of any language is listed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, hash64, mix64
from quillspark.llm.eyeform import folded

# What systems write for no answer at all.
PLACEHOLDERS = {"null", "none", "nil", "nan", "na", "n a", "missing", "undefined", "empty", "tbd", "אין", "нет ответа", "לא זמין", "غير متوفر"}

_TRAILER = re.compile(r"\s*^\s*CITED:[^\n]*\s*\Z", re.I | re.M)
_LINK = re.compile(r"\s*https?://\S+\s*\Z")
_ANY_LINK = re.compile(r"https?://\S+")
_WORD = re.compile(r"\w+")
_SPLIT = re.compile(r"(?<=[.!?؟])\s+|\n+")
_TOTAL = re.compile(r"[^\W\d_][^:.!?\n]{0,40}:\s*[^\w\s]?\s*\d[\d.,]*\s*(?:[^\w\s]|[^\W\d_]+)?\Z")
_END = re.compile(r"[.!?؟][\"'”»)\]]*\Z")
_DOTS = re.compile(r"(?:\.\.|…)[\"'”»)\]]*\Z")
_SCRIPTS = {"latin": "A-Za-zÀ-ɏ", "hebrew": "֐-׿", "cyrillic": "Ѐ-ӿ", "arabic": "؀-ۿ"}
_OF = {s: re.compile(rf"[{r}]+") for s, r in _SCRIPTS.items()}
_LATIN_LOW = re.compile(r"(?<![A-Za-zÀ-ɏ])[a-zß-ÿ][A-Za-zÀ-ɏ]*")

#: Words a prompt may be led in by in a response that only gives it back.
LEAD_IN = 6


def body(answer: str | None) -> str:
    """The answer without its citation trailer."""
    return _TRAILER.sub("", answer or "").strip()


def language(text: str) -> str:
    """The script most letters are of."""
    n = Counter({s: sum(map(len, p.findall(text))) for s, p in _OF.items()})
    (top, most), (_, second) = n.most_common(2)
    return top if most > second else ""


def other_language(prompt: str, answer: str) -> bool:
    """Whether the answer, links and names aside, is in another script than the prompt."""
    wanted = language(prompt)
    answer = _ANY_LINK.sub(" ", answer)
    if not wanted:
        return False
    own = len(_LATIN_LOW.findall(answer)) if wanted == "latin" else len(_OF[wanted].findall(answer))
    other = sum(len(_LATIN_LOW.findall(answer) if s == "latin" else p.findall(answer)) for s, p in _OF.items() if s != wanted)
    if wanted != "latin" and not other and not own:
        return bool(_OF["latin"].search(answer))
    return other > 0 and own * 4 < other


def copies(prompt: list[str], answer: list[str]) -> bool:
    """Whether the answer's words are the prompt's, once or more, after a few words that lead in."""
    n = len(prompt)
    if not n or len(answer) < n:
        return False
    for lead in range(min(LEAD_IN, len(answer) - n) + 1):
        k = len(answer) - lead
        if k % n == 0 and answer[lead:] == prompt * (k // n):
            return True
    return False


def look(prompt: str | None, answer: str | None) -> tuple[str | None, bool, bool, list[str]]:
    """The defect the pair shows by itself, if any; whether the answer's end is open, and stands in a line of its own; the templates of all
    its sentences."""
    said = body(answer)
    text = folded(said)
    words = _WORD.findall(text.casefold().replace("_", " "))
    if not words or " ".join(words) in PLACEHOLDERS:
        return "empty", False, False, []
    asked = folded(prompt or "")
    asked_words = _WORD.findall(asked.casefold())
    if copies(asked_words, words):
        return "copy", False, False, []
    text = _LINK.sub("", text)
    sentences = [s for s in _SPLIT.split(text) if s.strip()]
    defect = "wrong_language" if other_language(asked, text) else None
    last = sentences[-1].strip() if sentences else ""
    opened = bool(last) and not (_TOTAL.match(last) or _END.search(last)) or bool(_DOTS.search(text))
    masked = set(asked_words)
    return defect, opened, last == text.rsplit("\n", 1)[-1].strip(), [template(s, masked) for s in sentences]


def template(sentence: str, masked: set[str]) -> str:
    """The sentence's words in order, numbers replaced by one sign, and runs of the prompt's words by another, but for single short
    words: these are more often common ones than what the prompt is about."""
    out: list[str] = []
    run: list[str] = []
    for w in [*_WORD.findall(sentence.casefold()), ""]:
        if w in masked:
            run.append(w)
            continue
        out += ["_"] if len(run) > 1 or run and len(run[0]) > 3 else run
        run = []
        out.append("0" if w.isdigit() else w)
    return " ".join(out[:-1])


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    named = lambda t: hash64(t.encode("utf-8", "surrogatepass"))
    for batch in batches:
        questions, answers = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        rows = [look(q, a) for q, a in zip(questions, answers, strict=True)]
        defect, opened, own, templates = zip(*rows, strict=True) if rows else ([], [], [], [])
        asked = pa.array([named(q) if q is not None else 0 for q in questions], pa.int64())
        names = pa.array([[named(t) for t in ts] for ts in templates], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), asked, pa.array(defect, pa.string()), pa.array(opened, pa.bool_()), pa.array(own, pa.bool_()), names, pa.array(templates, pa.list_(pa.string()))],
            ["id", "asked", "defect", "opened", "own_line", "named", "templates"],
        )


#: Bands of two MinHashes each; templates of a similarity of 0.6 share one of them in 93 of 100 cases, of 0.8 in 998 of 1000.
BANDS = 6
#: Bands of refusing templates that are sent to all tasks, at most; more of them are joined by a shuffle.
BROADCAST = 20_000
_SEEDS = mix64(np.arange(1, 2 * BANDS + 1, dtype=np.uint64))


def bands(templates: list[str]) -> np.ndarray:
    """A row of band hashes over the words of every template."""
    words = [sorted(set(t.split()) - {"_", "0"}) or [""] for t in templates]
    code = {w: k for k, w in enumerate({w for ws in words for w in ws})}
    hashed = mix64(np.array([hash64(w.encode("utf-8", "surrogatepass")) for w in code], np.int64).view(np.uint64)[:, None] ^ _SEEDS)
    starts = np.concatenate([[0], np.cumsum([len(ws) for ws in words])])[:-1]
    least = np.minimum.reduceat(hashed[[code[w] for ws in words for w in ws]], starts, axis=0).reshape(len(words), BANDS, 2)
    return mix64(least[:, :, 0] ^ mix64(least[:, :, 1] + np.arange(BANDS, dtype=np.uint64))).view(np.int64)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 5000):
            part = batch.slice(k, 5000)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.FixedSizeListArray.from_arrays(pa.array(bands(part.column(1).to_pylist()).ravel()), BANDS).cast(pa.list_(pa.int64()))], ["name", "template", "bands"])


def words_of(t: Column) -> Column:
    return F.array_except(F.array_distinct(F.split(t, " ")), F.array(F.lit("_"), F.lit("0")))


def similar(templates: DataFrame, heads: DataFrame, similarity: float) -> DataFrame:
    """(name) of the ``templates`` (name, template) that share a band with one of ``heads`` and are as similar to it in words."""
    kind = "name long, template string, bands array<long>"
    of_heads = cut(heads.mapInArrow(_banded, kind).select(F.explode("bands").alias("band"), F.col("template").alias("head")).distinct())
    few = of_heads.limit(BROADCAST + 1).count() <= BROADCAST
    of_all = templates.mapInArrow(_banded, kind).select("name", "template", F.explode("bands").alias("band"))
    both, either = F.size(F.array_intersect(words_of(F.col("template")), words_of(F.col("head")))), F.size(F.array_union(words_of(F.col("template")), words_of(F.col("head"))))
    return of_all.join(F.broadcast(of_heads) if few else of_heads, "band").where(both >= similarity * either).select("name").distinct()


def pair_defects(requests: DataFrame, responses: DataFrame, key: str = "id", prompt: str = "question", answer: str = "answer", recurs: int = 5, share: float = 5e-5, similarity: float = 0.6) -> DataFrame:
    """(key, defect) of each defective pair; ``defect`` is empty, copy, refusal, truncated or wrong_language, the first that holds.

    Pairs are joined by ``key``; a null key, a prompt without response and a response without prompt are no pairs. Repeated rows count
    once; of different texts for one key the least counts. A null prompt can still have an empty, truncated or refusing
    response. A template recurs if it stands in answers to at least ``recurs`` prompts and to ``share`` of all pairs; templates
    of ``similarity`` in words, to a refusing one that recurs, refuse too. Other columns are dropped.
    """
    asked = requests.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(prompt).alias("prompt"))
    said = responses.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(answer).alias("answer"))
    kind = requests.schema[key].dataType.simpleString()
    seen = asked.join(said, "id").select("id", "prompt", "answer").mapInArrow(
        _look, f"id {kind}, asked long, defect string, opened boolean, own_line boolean, named array<long>, templates array<string>"
    )
    seen = cut(seen)
    least = F.greatest(F.lit(recurs), F.ceil(F.lit(seen.count() * share)))
    telling = seen.where("defect is null or defect = 'wrong_language'")
    each = telling.select("id", "asked", F.explode(F.array_distinct("named")).alias("name"))
    known = cut(each.select("name", "asked").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("prompts")).where(F.col("prompts") >= least).select("name"))
    marked = each.join(known.withColumn("known", F.lit(True)), "name", "left").select("id", "name", "known")
    per_answer = marked.groupBy("id").agg(F.count_if(F.col("known").isNull()).alias("content"), F.collect_set(F.when(F.col("known"), F.col("name"))).alias("names"))
    alone = per_answer.select(F.explode("names").alias("name"), (F.col("content") == 0).cast("int").alias("alone")).groupBy("name").agg(F.avg("alone").alias("alone")).where("alone >= 0.9").select("name")
    texts = telling.select(F.explode(F.arrays_zip(F.col("named").alias("name"), F.col("templates").alias("template"))).alias("x")).select("x.name", "x.template")
    refusing = cut(texts.join(alone, "name", "left_semi").groupBy("name").agg(F.first("template").alias("template")).where(F.size(words_of(F.col("template"))) >= 5))
    alike = similar(texts, refusing, similarity).unionByName(refusing.select("name")).distinct()
    # Answers all of whose templates recur or refuse, one of them at least the latter.
    told = each.select("id", "name").join(known.withColumn("known", F.lit(True)), "name", "left").join(alike.withColumn("refuses", F.lit(True)), "name", "left")
    refused = told.groupBy("id").agg(F.count_if(F.col("known").isNull() & F.col("refuses").isNull()).alias("content"), F.max("refuses").alias("refused")).where("content = 0 and refused").select("id", "refused")
    # Ends without a mark that are whole lines known from elsewhere: closings, brief answers.
    ends = seen.where("opened and own_line and size(named) > 0").select("id", F.element_at("named", -1).alias("name")).join(known, "name", "left_semi").select("id").withColumn("closed", F.lit(True))
    out = seen.select("id", "defect", "opened").join(refused, "id", "left").join(ends, "id", "left")
    defect = (
        F.when(F.col("defect").isin("empty", "copy"), F.col("defect")).when(F.col("refused"), F.lit("refusal"))
        .when(F.col("opened") & F.col("closed").isNull(), F.lit("truncated")).otherwise(F.col("defect"))
    )
    return out.select(F.col("id").alias(key), defect.alias("defect")).where("defect is not null")
