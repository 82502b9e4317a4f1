"""One form for texts that look the same.

Invisible characters go, compatibility forms and composed letters are normalised, blanks in a row become one. Look-alike letters
are repaired by script: a word's dominant script is that of its letters that resemble no other script's; only words that mix
scripts, and words made of look-alikes alone in a line of another script (Latin counts as the script of a line without one), are touched, and only if the repaired word is found
in the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import INVISIBLE, cut

# Letters that look alike in Latin, Cyrillic and Greek, in this order; a dot where a script has none.
LOOK_ALIKE = """
AАΑ BВΒ CСϹ EЕΕ HНΗ IІΙ JЈͿ KКΚ MМΜ N.Ν OОΟ PРΡ SЅ. TТΤ XХΧ YУΥ Z.Ζ
aаα cсϲ eе. hһ. iіι jјϳ oоο pрρ sѕ. u.υ v.ν xхχ yуγ ËЁ. ëё. ÏЇΪ ïїϊ
""".split()
# Persian letters and the Arabic ones they look like; the last has two, the second of them at a word's end only.
PERSIAN = {"ک": "ك", "ی": "يى"}
# Marks that look like a mark of another script.
MARKS = {"׳": "'", "״": '"', "‐": "-", "‑": "-", "־": "-"}
# Cyrillic letters of few languages that look like one letter wherever they stand.
RARE_LETTERS = {"Ӏ": "І", "ԁ": "d", "ԛ": "q", "ԝ": "w", "Ԛ": "Q", "Ԝ": "W"}

_GONE = re.compile(f"[{INVISIBLE}]")
_BLANKS = re.compile(r"[^\S\n]{2,}|[^\S\n ]")
_EDGES = re.compile(r" \n ?|\n ")
_PLAIN = re.compile(r"[\n -~א-תء-غف-يЀ-ҁҊ-ҿӁ-ӿ₪©·«»•–—؟،]*").fullmatch
# Texts of these characters only need no repair but of blanks, unless Latin and Cyrillic letters meet in them or a line is of UNTOLD.
ORDINARY = r"\A[\n -~À-ÖØ-öø-ÿא-תء-غف-يЀ-ҁҊ-ҿӁ-ӿ₪©·«»•–—؟،]*\z"
_SCRIPTS = {"L": "A-Za-zÀ-ɏ", "C": "Ѐ-ӿ", "G": "Ͱ-Ͽ"}
_HAS = {s: re.compile(f"[{r}]").search for s, r in _SCRIPTS.items()}
_SCRIPT = {s: re.compile(f"[{r}]").match for s, r in _SCRIPTS.items()}
_WORD = re.compile("[A-Za-zÀ-ɏЀ-ӿͰ-Ͽ][A-Za-zÀ-ɏЀ-ӿͰ-Ͽ̀-ͯ]*")
_ARABIC = re.compile(r"[ء-ۓ]+")
_PERSIAN = re.compile("[کی]")
_EITHER = re.compile(f"{_WORD.pattern}|{_ARABIC.pattern}")
# Texts without these hold at most one of the scripts that have look-alikes.
_RARE = re.compile("[Ͱ-ӿکی]").search
_TO = {s: {c: row[k] for row in LOOK_ALIKE for c in row if c != "." and row[k] != "." and c != row[k]} for k, s in enumerate("LCG")}
_ALIKE = {c for row in LOOK_ALIKE for c in row if c != "."}
# A line with Cyrillic or Greek letters, all of which look like another script's.
_OWN = "".join(r[0] + "-" + r[-1] for r in re.findall(f"[^{''.join(sorted(_ALIKE))}]+", "".join(map(chr, range(0x370, 0x500)))))
UNTOLD = rf"(?m)^[^{_OWN}\n]*[Ͱ-ӿ][^{_OWN}\n]*$"
_UNTOLD = re.compile(UNTOLD).search
# The script of look-alikes where the line has none of the three; only for repairs that the corpus must know.
FIXED = "L"


def plain(text: str) -> str:
    """``text`` without differences of single characters that need no context."""
    if not _PLAIN(text):
        text = unicodedata.normalize("NFKC", _GONE.sub("", text))
        for mark, same in (MARKS | RARE_LETTERS).items():
            text = text.replace(mark, same)
    elif "  " not in text and "\n " not in text and " \n" not in text:
        return text.strip(" ")
    return _EDGES.sub("\n", _BLANKS.sub(" ", text)).strip(" ")


def script_of(letter: str) -> str:
    return next((s for s, m in _SCRIPT.items() if m(letter)), "")


def dominant(text: str) -> str:
    """The script of most of the letters that look like no other script's; "" if there is none, or a tie."""
    n = Counter(script_of(c) for c in text if c not in _ALIKE)
    n.pop("", None)
    top = n.most_common(2)
    return top[0][0] if top and (len(top) == 1 or top[0][1] > top[1][1]) else ""


def in_script(word: str, script: str) -> str:
    """The word with its look-alikes in the script."""
    to = _TO[script]
    return unicodedata.normalize("NFC", "".join(to.get(c, c) for c in unicodedata.normalize("NFD", word)) if any("̀" <= c <= "ͯ" for c in word) else "".join(to.get(c, c) for c in word))


def candidates(word: str, line_script: str) -> list[str]:
    """Repaired forms of the word, best first; none for a word that is in order."""
    scripts = {script_of(c) for c in word} - {""}
    if len(scripts) > 1:
        script = dominant(word) or line_script
    elif line_script and scripts and line_script not in scripts and all(c in _ALIKE for c in word):
        script = line_script
    else:
        return []
    if not script:
        return []
    made = in_script(word, script)
    return [made] if made != word and {script_of(c) for c in made} - {""} == {script} else []


def arabic_candidates(word: str) -> list[str]:
    if not _PERSIAN.search(word):
        return []
    made = word.replace("ک", PERSIAN["ک"]).replace("ی", PERSIAN["ی"][0])
    return [made, made[:-1] + PERSIAN["ی"][1]] if word.endswith("ی") else [made]


def pieces(text: str, words: set[str] | None = None, fixed: str = FIXED) -> tuple[list[str], list[tuple[str, list[str]]]]:
    """The plain text, cut so that each word with candidates stands alone, and these words with their candidates. ``words``: gets the
    words in order, of the scripts that look-alikes belong to. ``fixed``: taken for the script of lines without a dominant one."""
    text = plain(text)
    if not _RARE(text):
        if words is not None:
            words.update(_EITHER.findall(text))
        return [text], []
    foreign = sum(bool(has(text)) for has in _HAS.values())
    persian = _PERSIAN.search(text)
    if foreign < 2 and not persian and not (fixed and _UNTOLD(text)):
        if words is not None:
            words.update(_WORD.findall(text) if foreign else (), _ARABIC.findall(text))
        return [text], []
    out, odd, at, base = [], [], 0, 0
    for line in text.splitlines(keepends=True):
        if sum(bool(has(line)) for has in _HAS.values()) < 2 and not _PERSIAN.search(line) and not (fixed and _UNTOLD(line)):
            if words is not None:
                words.update(_WORD.findall(line), _ARABIC.findall(line))
            base += len(line)
            continue
        script = None
        for m in _WORD.finditer(line):
            w = m.group()
            if script is None:
                script = dominant(line) or fixed
            made = candidates(w, script)
            if made:
                odd.append((base + m.start(), w, made))
            elif words is not None:
                words.add(w)
        for m in _ARABIC.finditer(line):
            made = arabic_candidates(m.group())
            if made:
                odd.append((base + m.start(), m.group(), made))
            elif words is not None:
                words.add(m.group())
        base += len(line)
    odd.sort()
    for start, w, _ in odd:
        out += [text[at:start], w]
        at = start + len(w)
    out.append(text[at:])
    return out, [(w, made) for _, w, made in odd]


def folded(text: str) -> str:
    """The plain text with look-alikes in the dominant script of their word or line, whether or not the corpus knows the word."""
    parts, odd = pieces(text, fixed="")
    if not odd:
        return parts[0]
    fixed = {w: made[0] for w, made in odd}
    return "".join(fixed.get(p, p) if k % 2 else p for k, p in enumerate(parts))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words: set[str] = set()
        rows: set[tuple[str, str | None, int]] = set()
        for t in batch.column(0).to_pylist():
            if t:
                for w, made in pieces(t, words)[1]:
                    rows.update((m, w, k) for k, m in enumerate(made))
        rows.update((w, None, 0) for w in words)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32()), strict=True)], ["word", "source", "place"])


def _pieces(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(None, None) if t is None else pieces(t) for t in batch.column(n).to_pylist()]
            parts = pa.array([m[0] for m in made], pa.list_(pa.string()))
            odd = pa.array([m[1] and list(dict.fromkeys(w for w, _ in m[1])) for m in made], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), parts, odd], [*batch.schema.names[:n], "parts", "odd"])

    return run


def known_repairs(*texts: DataFrame) -> DataFrame:
    """(source, word): the repair of every word that has one. ``texts``: one column each, which together are the corpus.

    A repair must be found in the corpus: as a word in order, or as the repair of another form of the word too.
    """
    found = None
    for t in texts:
        one = t.toDF("text").mapInArrow(_words, "word string, source string, place int")
        found = one if found is None else found.union(one)
    found = cut(found.distinct())
    good = found.groupBy("word").agg(F.max(F.col("source").isNull()).alias("clean"), F.min("source").alias("lo"), F.max("source").alias("hi")).where("clean or lo <> hi").select("word")
    return found.where("source is not null").join(good, "word").groupBy("source").agg(F.min(F.struct("place", "word"))["word"].alias("word"))


def eye_forms(df: DataFrame, text: str, repairs: DataFrame, out: str = "form") -> DataFrame:
    """``df`` with the consistent form of its texts in ``out``: texts equal to the eye have equal forms.

    A null text has a null form, an empty or invisible one an empty form. Repeated rows stay; other columns stay as they are,
    but one named ``out`` is replaced. Case, digits, visible accents and line breaks stay. ``repairs``: of known_repairs.
    """
    kept = [c for c in df.columns if c != out]
    names = [f"c{k}" for k in range(len(kept))]
    fields = [T.StructField(n, df.schema[c].dataType) for n, c in zip(names, kept, strict=True)]
    words = T.ArrayType(T.StringType())
    given = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)), F.col(f"`{text}`").alias("text"))
    ordinary = F.coalesce(F.col("text").rlike(ORDINARY) & ~(F.col("text").rlike("[A-Za-zÀ-ÿ]") & F.col("text").rlike("[Ѐ-ӿ]")) & ~(F.col("text").rlike("[Ѐ-ӿ]") & F.col("text").rlike(UNTOLD)), F.lit(True))
    blanks = F.trim(F.regexp_replace(F.regexp_replace("text", " {2,}", " "), " ?\n ?", "\n"))
    fine = given.where(ordinary).select(*names, blanks.alias("form"))
    cut_up = cut(given.where(~ordinary).mapInArrow(_pieces(len(names)), T.StructType([*fields, T.StructField("parts", words), T.StructField("odd", words)])))  # read twice
    fine = fine.unionByName(cut_up.where("size(odd) = 0").select(*names, F.concat_ws("", "parts").alias("form")))
    each = cut_up.where("size(odd) > 0").withColumn("row", F.monotonically_increasing_id()).select("*", F.posexplode("odd").alias("k", "source"))
    each = each.select("row", "source", F.when(F.col("k") == 0, F.struct(*names, "parts")).alias("whole"))
    mended = each.join(repairs, "source", "left").groupBy("row").agg(
        F.first("whole", ignorenulls=True).alias("whole"), F.map_from_entries(F.collect_list(F.struct("source", F.coalesce("word", "source").alias("word")))).alias("to")
    ).select(*(F.col(f"whole.{n}").alias(n) for n in names), F.array_join(F.transform("whole.parts", lambda p: F.coalesce(F.try_element_at("to", p), p)), "").alias("form"))
    return fine.unionByName(mended).toDF(*kept, out)


def look_alike_pairs(forms: DataFrame, group: list[str], key: str, text: str, form: str = "form") -> DataFrame:
    """(*group, key_a, key_b): pairs of keys whose texts have one form but differ; the smaller key comes first.

    Rows of one key and text count once; nulls have no pairs. Copies of one text are no pairs, so a text repeated very often gives
    pairs only with its variants: different texts of one form are matched first, then each side brings its keys.
    """
    rows = cut(forms.where(F.col(form).isNotNull() & F.col(key).isNotNull()).select(
        *group, F.col(key).alias("key"), F.unhex(F.md5(F.col(form))).alias("same"), F.xxhash64(text).alias("raw")
    ).distinct())
    by = [*group, "same"]
    several = rows.groupBy(*by).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select(*by)
    rows = rows.join(several, by, "left_semi")
    texts = rows.select(*by, "raw").distinct()
    apart = texts.join(texts.withColumnRenamed("raw", "raw2"), by).where("raw < raw2")
    sides = apart.join(rows, [*by, "raw"]).join(rows.select(*by, F.col("raw").alias("raw2"), F.col("key").alias("key2")), [*by, "raw2"])
    return sides.where("key <> key2").select(*group, F.least("key", "key2").alias("key_a"), F.greatest("key", "key2").alias("key_b")).distinct()
