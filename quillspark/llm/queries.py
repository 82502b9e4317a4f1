"""The queries of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import cut, pages, table
from quillspark.llm.eyeform import eye_forms, known_repairs, look_alike_pairs
from quillspark.llm.main_content import main_lines
from quillspark.llm.near_duplicates import groups, link_pairs, near_duplicates
from quillspark.llm.nearest_vectors import nearest_vectors
from quillspark.llm.packing import pack
from quillspark.llm.pair_defects import pair_defects
from quillspark.llm.repeated_lines import repeated_lines, without_lines
from quillspark.llm.shared_spans import shared_spans
from quillspark.llm.splitting import split_texts
from quillspark.llm.tokenizing import count_tokens, encode_texts
from quillspark.operators.retrieve import recall, top_k


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines(pages(table(spark, d, "parsed_docs")), "domain", "file", "page", "text", "fetched_at").select("file", "page", "line_no")


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every page without its repeated lines; lines met in copies of few documents only are an article's and stay."""
    p = pages(table(spark, d, "parsed_docs"))
    lines = repeated_lines(p, "domain", "file", "page", "text", "fetched_at", clusters=3, dates=2)
    return without_lines(p.select("file", "page", "text"), lines, "file", "page", "text").select("file", "page", "clean").distinct()


def all_texts(spark: SparkSession, d: str) -> DataFrame:
    """(tab, key, page, kind, text) of all questions and of all pages of web pages and booklets."""
    asked = table(spark, d, "ask_requests").select(F.lit("ask_requests").alias("tab"), F.col("id").alias("key"), F.lit(1).alias("page"), F.lit("question").alias("kind"), F.col("question").alias("text"))
    return asked.unionByName(pages(table(spark, d, "parsed_docs")).select(F.lit("parsed_docs").alias("tab"), F.col("file").alias("key"), "page", "kind", "text"))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """All questions and pages in their consistent form."""
    texts = all_texts(spark, d)
    return eye_forms(texts, "text", known_repairs(texts.select("text"))).select("tab", "key", "page", "form").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Of questions and of first pages of web pages; the words that repairs must be found among are those of all texts."""
    texts = all_texts(spark, d)
    asked = texts.where("kind = 'question' or kind = 'txt' and page = 1")
    return look_alike_pairs(eye_forms(asked, "text", known_repairs(texts.select("text"))), ["tab"], "key", "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects(table(spark, d, "ask_requests"), table(spark, d, "ask_responses"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = near_duplicates(table(spark, d, "chunks"), "id", "text")
    return link_pairs(members, links, "id")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk's group of near-duplicates and the number of different texts it is linked to."""
    members, links = near_duplicates(table(spark, d, "chunks"), "id", "text")
    return groups(members, cut(links), "id").select("id", "group", "links")


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return nearest_vectors(table(spark, d, "chunk_vectors"), "id", "embedding")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = nearest_vectors(table(spark, d, "chunk_vectors"), "id", "embedding", at_least=0.9)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    """One row (recall, asked): of the ten nearest others of one vector in twenty, by comparison with all, the share that the forest finds."""
    v = table(spark, d, "chunk_vectors").where("embedding is not null and exists(embedding, x -> x <> 0)").select("id", "embedding").distinct()
    asked = v.where(F.pmod(F.xxhash64("id"), F.lit(20)) == 0)
    truth = top_k(asked, v, 11).where("q_id <> chunk_id").withColumn("n", F.row_number().over(W.partitionBy("q_id").orderBy("rank"))).where("n <= 10").select("q_id", "chunk_id")
    found = nearest_vectors(v, "id", "embedding").select(F.col("id").alias("q_id"), F.col("other").alias("chunk_id"))
    return recall(found, cut(truth)).crossJoin(asked.agg(F.count(F.lit(1)).alias("asked")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    web = pages(table(spark, d, "parsed_docs"), "txt")
    return main_lines(web, ["file", "page"], "text").select("file", "page", F.explode("lines").alias("line_no")).distinct()


def p6_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The main body of every web page as text."""
    web = pages(table(spark, d, "parsed_docs"), "txt").select("file", "page", "text").distinct()
    lines = main_lines(web, ["file", "page", "text"], "text")
    return lines.select("file", "page", F.array_join(F.transform("lines", lambda n: F.split("text", "\n")[n - 1]), "\n").alias("body"))


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of every page; forced: 1 if the piece ends inside a run without white space."""
    p = split_texts(pages(table(spark, d, "parsed_docs")))
    return p.select("file", "page", F.posexplode("pieces").alias("piece_no", "p")).select(
        "file", "page", "piece_no", F.col("p.start").alias("span_start"), F.col("p.stop").alias("span_end"),
        F.col("p.forced").cast("int").alias("forced"), F.col("p.text").alias("text"),
    ).distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    p = split_texts(pages(table(spark, d, "parsed_docs")).where(F.length("text") > 1500))
    return p.select("file", "page", F.exists("pieces", lambda x: x["forced"]).cast("int").alias("forced")).distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return pack(count_tokens(docs), "doc_id", "tokens", n_items=docs.count())


def p9_instructions(spark: SparkSession, d: str) -> DataFrame:
    """Prompts with their responses, the tokens of which bear the loss, in containers of which all three limits bind: a pair has some 240
    tokens, 170 of them in the response."""
    asked = table(spark, d, "ask_requests").where("id is not null").groupBy("id").agg(F.min("question").alias("question"))
    said = table(spark, d, "ask_responses").where("id is not null").groupBy("id").agg(F.min("answer").alias("answer"))
    sized = count_tokens(count_tokens(asked.join(said, "id"), "question", "asked").drop("question"), "answer", "said").select("id", (F.col("asked") + F.col("said")).alias("tokens"), "said")
    return pack(cut(sized), "id", "tokens", loss="said", capacity=2048, segments=8, loss_capacity=1400, group=4000)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(table(spark, d, "documents"), "doc_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document is shared with others."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars")).distinct()
    shared = shared_spans(table(spark, d, "documents"), "doc_id").groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"))
    return docs.join(shared, "doc_id", "left").select("doc_id", "chars", F.coalesce("shared", F.lit(0)).alias("shared_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_forms, p3_found, p4_found, p4_groups, p5_found, p5_neighbours, p5_recall, p6_found, p6_bodies, p7_pieces, p7_found, p8_ids, p9_containers, p9_instructions, p10_found, p10_shares)}


#: Runs of code points that lie in some 200 in a row which stand in another text too.
_SHARED = """w AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
    s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)), m AS (SELECT DISTINCT doc_id, i FROM w WHERE h IN (SELECT h FROM s)),
    g AS (SELECT doc_id, i, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS b FROM m)),
    spans AS (SELECT doc_id, min(i) - 1 AS span_start, max(i) + 199 AS span_end FROM g GROUP BY doc_id, g)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p10_found": f"WITH {_SHARED} SELECT * FROM spans",
        "p10_shares": f"""WITH {_SHARED} SELECT d.doc_id, d.chars, coalesce(CAST(sum(span_end - span_start) AS BIGINT), 0) AS shared_chars
            FROM (SELECT DISTINCT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS chars FROM documents) d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY ALL""",
        "p4_found": r"""
            WITH w AS (SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM (SELECT DISTINCT id, text FROM chunks WHERE text IS NOT NULL)),
            s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
            n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
            p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
            SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 2 * k >= x.n + y.n - k""",
        "p5_found": r"""
            WITH v AS (SELECT DISTINCT id, embedding::DOUBLE[] AS e FROM chunk_vectors WHERE embedding IS NOT NULL), u AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0),
            s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS c FROM u a, u b WHERE a.id <> b.id),
            r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS n FROM s)
            SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE n <= 10 AND c >= 0.9""",
        "p7_found": r"""
            SELECT DISTINCT file, p.page AS page, CAST(regexp_matches(regexp_replace(p.text, '[\s\x1c-\x1f\x{85}\p{Z}]', ' ', 'g'), '[^ ]{751}[^ ]{750}') AS INTEGER) AS forced
            FROM (SELECT file, unnest(pages) AS p FROM parsed_docs) WHERE length(p.text) > 1500""",
    }
