"""Readers with explicit schemas, and writers. Ids stay strings whatever they look like; nulls are written."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quillspark.functions.text import strip

PAGES = "array<struct<page:int,text:string>>"
PARSED = f"file string, domain string, kind string, url string, pages {PAGES}, error string"
SOURCES = "array<struct<any_of:array<struct<file:string,page:string>>>>"
QUESTIONS = f"id string, question string, ground_truth_answer string, ground_truth_sources {SOURCES}, difficulty string"
ANSWERS = (
    "id string, answer string, citations array<struct<file:string,page:string>>, retrieved array<struct<file:string,page:int,score:double>>, latency_ms double, "
    "tokens struct<prompt:int,completion:int>, endpoint_error string, domain string, confidence double, cost_usd double"
)
CHUNKS = "id string, file string, domain string, kind string, url string, page int, chunk_index int, text string"
EVALS = "id string, answer_score double, citation_score double, hallucinate boolean, latency double"
VECTORS = "id string, embedding array<float>, fingerprint string"

def parsed_docs(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents, one JSON record a file, in any depth of folders."""
    return spark.read.schema(PARSED).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)


def good(docs: DataFrame) -> DataFrame:
    return docs.where("error is null").drop("error")


def failed(docs: DataFrame) -> DataFrame:
    return docs.where("error is not null").select("file", "error")


# Where a corpus keeps its pages and its booklets.
PLACES = ("*/pages/*.txt", "*/files/*.pdf")


def _files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the files of the raw corpus, at these places exactly; nothing else under root is opened."""
    found = spark.createDataFrame([], "path string, content binary")
    for place in PLACES:
        try:
            found = found.unionByName(spark.read.format("binaryFile").load(f"{root}/{place}").select("path", "content"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(file, domain, kind, path) of the raw corpus: ``<domain>/pages/*.txt`` and ``<domain>/files/*.pdf`` right under root."""
    return described(_files(spark, root).select("path", F.regexp_extract("path", r"([^/]+/(?:pages|files)/[^/]+)$", 1).alias("file")))


def in_order(files: DataFrame) -> DataFrame:
    """A listing for people: pages before booklets, each sorted part by part of their paths."""
    return files.orderBy(F.col("kind") != "txt", F.split("file", "/"))


def described(files: DataFrame) -> DataFrame:
    """Adds domain (first part of the path) and kind (extension)."""
    return files.withColumn("domain", F.split_part("file", F.lit("/"), F.lit(1))).withColumn("kind", F.regexp_extract("file", r"\.([^./]+)$", 1))


def manifest(spark: SparkSession, path: str | None) -> DataFrame:
    """(file, url) of a JSON object; empty without one."""
    if path is None:
        return spark.createDataFrame([], "file string, url string")
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("file", "url"))


Parser = Callable[[bytes], list[tuple[int, str]]]


def parse_text(data: bytes) -> list[tuple[int, str]]:
    """One page; line ends are folded."""
    return [(1, data.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n"))]


def numbered(pages: dict[int, str], whole: str) -> list[tuple[int, str]]:
    """What a booklet's parser should return: its pages by number; without any, the whole text as page 1, or nothing if that is blank."""
    return sorted(pages.items()) if pages else [(1, whole)] if whole.strip() else []


def parse_corpus(spark: SparkSession, root: str, parsers: dict[str, Parser], urls: DataFrame, cache: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Parsed documents of the raw corpus: those in ``cache``, errors too, are kept unless ``force``; the rest are parsed, each kind by its
    parser. A file that fails becomes a row with an error."""
    todo = listing(spark, root)
    if cache is not None and not force:
        todo = todo.join(cache.select("file"), "file", "left_anti")
    data = _files(spark, root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pages, errors = [], []
            for kind, content in zip(b.kind, b.content, strict=True):
                try:
                    pages.append([{"page": n, "text": t} for n, t in parsers[kind](bytes(content))])
                    errors.append(None)
                except Exception as e:  # a bad file is a row, not the end of the run
                    pages.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield b[["file", "domain", "kind"]].assign(pages=pages, error=errors)

    new = todo.join(data, "path").select("file", "domain", "kind", "content").mapInPandas(run, f"file string, domain string, kind string, pages {PAGES}, error string")
    new = new.join(urls, "file", "left").select("file", "domain", "kind", "url", "pages", "error")
    return new if cache is None or force else cache.select(new.columns).unionByName(new)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a bare list or of {"questions": [...]}, with their place ``pos`` in it."""
    text = spark.read.text(path, wholetext=True).select(strip("value").alias("v"))
    items = f"array<struct<{QUESTIONS.replace(' string', ':string').replace(' array', ':array')}>>"
    listed = F.when(F.col("v").startswith("["), F.from_json("v", items)).otherwise(F.from_json("v", f"struct<questions:{items}>")["questions"])
    return text.select(F.posexplode(listed).alias("pos", "q")).select("pos", "q.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines with their place ``line``, which orders by file name and place in the file; blank lines are skipped, a malformed
    one fails."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    # A part of a file is one task's, in which ids rise.
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", at.alias("line"))


def vectors(spark: SparkSession, path: str, fingerprints: DataFrame | None = None) -> DataFrame:
    """Stored vectors; with ``fingerprints`` (id, fingerprint) only those still valid."""
    v = spark.read.schema(VECTORS).parquet(path)
    return v if fingerprints is None else v.join(fingerprints, ["id", "fingerprint"], "left_semi")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_by_domain(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by domain, so that a domain's readers read only its files."""
    df.write.mode(mode).partitionBy("domain").parquet(path)


def write_report(lines: DataFrame, path: str) -> None:
    """``lines`` (pos, line) as one text in order; a report for people, of as many lines as there are questions."""
    lines.coalesce(1).sortWithinPartitions("pos").select("line").write.mode("overwrite").text(path)
