"""The core's queries over the test tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.lineage import new_folder, written
from quillspark.operators.chunking import chunk, length_summary, parts, split_oversized
from quillspark.operators.embed import HashingEncoder, embed, embed_cached, missing
from quillspark.operators.evaluate import citation_scores, evaluate, last_wins, latest, pending, report, report_lines, run_diff, summarize
from quillspark.operators.generate import EchoGenerator, OverlapJudge, judge_prompts, prompts
from quillspark.operators.retrieve import index_records, recall, top_k
from quillspark.plans.answering import answer_questions, answers_of, checked_requests, evaluate_with, responses
from quillspark.sources import tables as S
from quillspark.sources.tables import described, failed, good
from quillspark.streaming.asking import asked_per_window

SOURCES = "array<struct<any_of:array<struct<file:string,page:string>>>>"


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """The query set: every vector whose id is divisible by 20."""
    return t(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), "embedding")


def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    index = t(spark, d, "embeddings")
    hits = top_k(vector_queries(spark, d), index, 5, key="vec_id")
    return hits.join(index.select(F.col("vec_id").alias("chunk_id"), "label"), "chunk_id").select("q_id", "rank", "chunk_id", "label", F.round("score", 6).alias("score"))


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Of the five nearest, those that are also the five nearest by vectors of one decimal place."""
    index = t(spark, d, "embeddings")
    coarse = index.withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double"), 1)))
    asked = vector_queries(spark, d)
    found = top_k(asked.withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double"), 1))), coarse, 5, key="vec_id")
    return recall(found, top_k(asked, index, 5, key="vec_id")).select(F.round("recall", 6).alias("recall"))


def page_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = described(good(t(spark, d, "parsed_docs")).drop("domain", "kind"))
    return docs.select("file", "domain", "kind", F.explode("pages").alias("p")).select("file", "domain", "kind", F.col("p.page").alias("page"), F.length("p.text").cast("bigint").alias("chars")).distinct()


def parse_failures(spark: SparkSession, d: str) -> DataFrame:
    return failed(t(spark, d, "parsed_docs")).distinct()


def page_totals(spark: SparkSession, d: str) -> DataFrame:
    return good(t(spark, d, "parsed_docs")).groupBy("domain").agg(F.sum(F.size("pages")).cast("bigint").alias("pages"), F.count(F.lit(1)).alias("docs"))


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunk(good(t(spark, d, "parsed_docs"))).distinct()


def chunk_split(spark: SparkSession, d: str) -> DataFrame:
    made = parts(t(spark, d, "documents"), ["doc_id"], "text", lambda x: split_oversized(x.strip(), 1500))
    return made.select("doc_id", F.posexplode("parts").alias("part", "text"))


def chunk_length_stats(spark: SparkSession, d: str) -> DataFrame:
    s = length_summary(t(spark, d, "chunks").distinct())
    return s.select(F.col("n").cast("bigint").alias("n"), F.col("median").cast("bigint").alias("median"), F.col("longest").cast("bigint").alias("longest"))


def index_rows(spark: SparkSession, d: str) -> DataFrame:
    r = index_records(t(spark, d, "chunks"), t(spark, d, "chunk_vectors"))
    return r.select("id", "file", "page", "url", "chunk_index", F.md5(F.col("text").cast("binary")).alias("text"), F.round(X.dot(F.col("embedding"), F.sequence(F.lit(1), F.size("embedding"))), 4).alias("vector"))


def fingerprint_rows(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").where("text is not null").select("doc_id", X.fingerprint("multilingual-e5-large", "passage", F.col("doc_id").cast("string"), "text").alias("fingerprint"))


def embedding_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Chunks for which a store, of the chunks of even length and of some that have changed since, has no vector of this encoder."""
    items = t(spark, d, "chunks").where("text is not null").select("id", "text").distinct()
    kept = items.where("length(text) % 2 = 0").withColumn("text", F.when(F.expr("length(text) % 6 = 0"), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    stored = kept.select("id", X.fingerprint("hashing-64", "passage", "id", "text").alias("fingerprint"))
    return missing(items, stored, HashingEncoder(), "passage").select("id", "fingerprint")


def embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all chunks by the offline encoder; of each the signs of its elements."""
    made = embed(t(spark, d, "chunks").where("text is not null").select("id", "text").distinct(), HashingEncoder())
    signs = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "+").when(x < 0, "-").otherwise("0")), "")
    return made.select("id", signs.alias("signs"), F.round(X.dot(F.col("embedding"), F.col("embedding")), 4).alias("length"), "fingerprint")


def vector_store(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written to a store, read again and completed: those of changed texts and new chunks are made anew."""
    items = t(spark, d, "chunks").where("text is not null").select("id", "text").distinct()
    path = new_folder(spark, "vectors")
    embed(items.where("length(text) % 2 = 0").withColumn("text", F.when(F.expr("length(text) % 6 = 0"), F.concat("text", F.lit("!"))).otherwise(F.col("text"))), HashingEncoder()).write.parquet(path)
    stored = S.vectors(spark, path)
    valid = S.vectors(spark, path, items.select("id", X.fingerprint("hashing-64", "passage", "id", "text").alias("fingerprint")))
    made = embed_cached(items, stored, HashingEncoder())
    return made.join(valid.select("id", F.lit(True).alias("kept")), "id", "left").select("id", "fingerprint", F.coalesce("kept", F.lit(False)).alias("kept"))


def parsed_files(spark: SparkSession, d: str) -> DataFrame:
    """Parsed documents written as JSON records, nulls too, and read again."""
    path = new_folder(spark, "parsed")
    S.write_json(t(spark, d, "parsed_docs").select("file", "domain", "kind", "url", "pages", "error"), path)
    docs = S.parsed_docs(spark, path)
    return docs.select("file", "domain", "kind", "url", F.size("pages").alias("n"), F.md5(F.array_join(F.transform("pages", lambda p: F.concat_ws(":", p["page"].cast("string"), p["text"])), "|").cast("binary")).alias("pages"), "error").distinct()


def domain_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents written by domain and read again: a domain's readers read its files only."""
    path = new_folder(spark, "domains")
    S.write_by_domain(good(t(spark, d, "parsed_docs")).where("domain is not null").select("file", "domain"), path)
    return spark.read.parquet(path).where("domain = 'vehicle'").select("file", "domain").distinct()


def answer_lines(spark: SparkSession, d: str) -> DataFrame:
    """Answers appended to JSON lines in two runs, read again, the last one of an id counting."""
    path = new_folder(spark, "answers")
    a = _answers(spark, d)
    for run, some in ((1, a), (2, a.where("length(id) % 2 = 0 or confidence < 0.5"))):
        some = some.select("id", F.concat_ws(" ", F.lit(f"run {run}"), "answer").alias("answer"), "citations", "latency_ms", "domain", "confidence")
        S.write_json(some.coalesce(1), f"{path}/run={run}", "append")
    rows = S.json_lines(spark, f"{path}/*", S.ANSWERS)
    return latest(rows).select("id", F.md5(F.col("answer").cast("binary")).alias("answer"), F.size("citations").cast("bigint").alias("cited"), "latency_ms", "confidence")


def question_files(spark: SparkSession, d: str) -> DataFrame:
    """The questions, a list of the fixed domains here, in both layouts of a file."""
    listed = t(spark, d, "domains").select(F.col("domain").alias("id"), F.col("title").alias("question"), F.array(F.struct(F.array(F.struct(F.col("host").alias("file"), F.lit(3).alias("page"))).alias("any_of"))).alias("ground_truth_sources"))
    one = listed.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*listed.columns)))).alias("v"))  # a dozen rows
    out = None
    for layout, text in (("list", F.col("v")), ("wrapped", F.concat(F.lit('{"questions": '), "v", F.lit("}")))):
        path = new_folder(spark, "questions")
        one.select(text).write.text(path)
        q = S.questions(spark, path).select(F.lit(layout).alias("layout"), F.col("pos").cast("bigint").alias("pos"), "id", "question", F.col("ground_truth_sources")[0]["any_of"][0]["page"].alias("page"))
        out = q if out is None else out.unionByName(q)
    return out


def manifest_file(spark: SparkSession, d: str) -> DataFrame:
    """Urls of files by a manifest, which lists some domains' files only: its entries are those of the fixed domains here."""
    path = new_folder(spark, "manifest")
    t(spark, d, "domains").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat("domain", F.lit("/pages/index.txt")), "host")))).alias("v")).write.text(path)
    files = good(t(spark, d, "parsed_docs")).select("domain").distinct().select(F.concat("domain", F.lit("/pages/index.txt")).alias("file"))
    return files.join(S.manifest(spark, path), "file", "left")


def raw_corpus(spark: SparkSession, d: str) -> DataFrame:
    """A raw corpus of a page and a booklet for three domains, listed and parsed: line ends folded, a broken page an error, a cache kept."""
    root = new_folder(spark, "corpus")
    for k, name in enumerate(("dental", "home", "trip")):
        for sub, ext, text in (("pages", "txt", f"{name} first\r\nline\rlast"), ("files", "pdf", f"{name} booklet"), ("other", "txt", "not part of it")):
            spark.range(1).select(F.lit(text)).coalesce(1).write.option("lineSep", "#").text(f"{root}/{name}/{sub}/x")
            _rename(spark, f"{root}/{name}/{sub}", f"{sub}{k}.{ext}")
    parsers = {"txt": S.parse_text, "pdf": lambda data: S.numbered({2: "two", 1: data.decode()}, "")}
    urls = spark.createDataFrame([("home/pages/pages1.txt", "http://home")], "file string, url string")
    first = S.parse_corpus(spark, root, parsers, urls)
    cached = S.parse_corpus(spark, root, {}, urls, cache=first.where("kind = 'txt'"))  # without parsers, what isn't cached fails
    return cached.select("file", "domain", "kind", "url", F.array_join(F.transform("pages", lambda p: F.concat_ws(":", p["page"].cast("string"), p["text"])), "|").alias("pages"), F.col("error").isNotNull().alias("failed"))


def _rename(spark: SparkSession, folder: str, name: str) -> None:
    """Moves the one file that Spark wrote to folder/x to folder/name."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(path(f"{folder}/x")) if f.getPath().getName().startswith("part-"))
    fs.rename(part, path(f"{folder}/{name}"))
    fs.delete(path(f"{folder}/x"), True)


def report_text(spark: SparkSession, d: str) -> DataFrame:
    """The report as it is written for people: its lines by number."""
    q = _questions(spark, d).withColumn("pos", F.col("id").cast("bigint"))
    e = evaluate(_questions(spark, d), _answers(spark, d), _verdicts(spark, d))[0].withColumn("answer_score", F.col("answer_score").cast("int")).withColumn("citation_score", (F.col("citation_score") * 100).cast("int"))
    path = new_folder(spark, "report")
    S.write_report(report_lines(report(q, _answers(spark, d), e)), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("times"))


def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    done = t(spark, d, "ask_responses").withColumn("endpoint_error", F.lit(None).cast("string"))
    return pending(t(spark, d, "ask_requests").select("id").distinct(), done)


def last_answers(spark: SparkSession, d: str) -> DataFrame:
    last = last_wins(t(spark, d, "ask_responses").where("answered_at is not null"), "id", "answered_at")
    return last.select("id", F.date_format("answered_at", "yyyy-MM-dd HH:mm:ss").alias("answered_at"), "domain")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """One answer an id, with the citations' pages as text."""
    r = t(spark, d, "ask_responses").groupBy("id").agg(
        F.min("answer").alias("answer"), F.min("confidence").alias("confidence"), F.min("latency_ms").alias("latency_ms"), F.min("domain").alias("domain"), F.max("citations").alias("citations")
    )
    return r.withColumn("citations", F.transform("citations", lambda c: F.struct(c["file"].alias("file"), c["page"].cast("string").alias("page"))))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """One question an id; the true sources are, of the answer's citations, every second one a page off."""
    q = t(spark, d, "ask_requests").groupBy("id").agg(F.min("question").alias("question"))
    shifted = lambda c, i: F.struct(F.array(F.struct(F.ltrim(c["file"], F.lit("/")).alias("file"), (c["page"].cast("int") + F.pmod(i, F.lit(2))).cast("string").alias("page"))).alias("any_of"))
    a = _answers(spark, d)
    return q.join(a.select("id", F.col("answer").alias("ground_truth_answer"), F.transform("citations", shifted).cast(SOURCES).alias("ground_truth_sources")), "id", "left")


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Judge replies of several shapes, made from the answers' confidence."""
    score = (1 + F.floor(F.coalesce("confidence", F.lit(0.0)) * 4)).cast("int")
    shape = F.length("id") + F.length(F.coalesce("answer", F.lit("")))
    clean = F.format_string('{"reasoning": "r %s", "similarity_score": %d, "is_refusal": false, "is_hallucination": %s}', "id", score, F.when(score == 1, "true").otherwise("false"))
    noisy = F.format_string('Here: {"reasoning": "see "x" for %s", "similarity_score": %d, "is_refusal": false /* no */} // end', "id", score)
    reply = F.when(shape % 4 == 0, clean).when(shape % 4 == 1, F.concat(F.lit("```json\n"), clean, F.lit("\n```"))).when(shape % 4 == 2, noisy).otherwise(F.lit("no verdict"))
    return _answers(spark, d).select("id", reply.alias("reply"))


def judge_parse(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d).select("id", X.parse_judgement("reply").alias("v")).select("id", "v.similarity_score", "v.is_hallucination", "v.status")


def judge_messages(spark: SparkSession, d: str) -> DataFrame:
    return judge_prompts(_questions(spark, d), _answers(spark, d)).select("id", F.md5(F.col("prompt").cast("binary")).alias("prompt"))


def judge_fields(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts whose braces got lost: the fields are read from the whole reply."""
    a = _answers(spark, d).withColumn("made", (1 + F.length("id") + F.coalesce(F.length("answer"), F.lit(0)) % 5).cast("int"))
    reply = F.format_string('"reasoning": "r", "similarity_score": %d, "is_refusal": %s', "made", F.when(F.col("made") % 2 == 0, "true").otherwise("False"))
    return a.select("id", X.parse_judgement(reply).alias("v")).select("id", "v.similarity_score", "v.is_refusal", "v.status")


def judged_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers judged against the next answer's text as the truth, by the offline judge: prompts, replies, verdicts, scores."""
    a = _answers(spark, d).where("answer is not null")
    q = a.select("id", F.lit("q").alias("question"), F.substring("answer", 1, 60).alias("ground_truth_answer"), F.array().cast(SOURCES).alias("ground_truth_sources"))
    return evaluate_with(q, a.withColumn("answer", F.concat_ws(" ", F.substring("answer", 20, 60), "domain")), OverlapJudge())[0].select("id", "answer_score", "hallucinate", "error")


def eval_rows(spark: SparkSession, d: str) -> DataFrame:
    return evaluate(_questions(spark, d), _answers(spark, d), _verdicts(spark, d))[0].select("id", "answer_score", F.round("citation_score", 6).alias("citation_score"), "hallucinate", "error")


def _rounded(s: DataFrame) -> DataFrame:
    return s.select(*[c for c in s.columns if c == "domain"], "count", F.round("avg_answer_score", 6).alias("avg_answer_score"), "hallucinations", F.round("hallucination_rate", 6).alias("hallucination_rate"), F.round("avg_latency_ms", 1).alias("avg_latency_ms"))


def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluate(_questions(spark, d), _answers(spark, d), _verdicts(spark, d))[1])


def eval_by_domain(spark: SparkSession, d: str) -> DataFrame:
    """An extension: the summary for each domain."""
    rows = evaluate(_questions(spark, d), _answers(spark, d), _verdicts(spark, d))[0]
    return _rounded(summarize(rows.join(_answers(spark, d).select("id", "domain"), "id", "left"), "domain"))


def citation_score(spark: SparkSession, d: str) -> DataFrame:
    s = citation_scores(_questions(spark, d), _answers(spark, d))
    return s.select("id", "is_fully_correct", F.round("score", 6).alias("score"), "satisfied_groups_count")


def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d).where("answer is not null")
    return a.select("id", F.md5(X.without_trailer("answer").cast("binary")).alias("body"), F.concat_ws(",", F.transform(X.cited_numbers("answer"), lambda n: n.cast("string"))).alias("numbers"))


def citation_digits(spark: SparkSession, d: str) -> DataFrame:
    """Trailers in Arabic digits are read like any others."""
    a = _answers(spark, d).where("answer is not null").select("id", F.translate("answer", "0123456789", "٠١٢٣٤٥٦٧٨٩").alias("answer"))
    return a.select("id", F.concat_ws(",", F.transform(X.cited_numbers("answer"), lambda n: n.cast("string"))).alias("numbers"))


def display_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores to three places, by their exact binary values: many of these lie near the middle between two."""
    r = t(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return r.select("vec_id", "pos", X.round3(F.round(F.col("x").cast("double"), 4) + 0.0005).alias("score"))


def distinct_citations(spark: SparkSession, d: str) -> DataFrame:
    c = _answers(spark, d).select("id", F.array_distinct(F.transform("citations", lambda c: F.struct(X.normalize_path(c["file"]).alias("file"), X.normalize_page(c["page"]).alias("page")))).alias("c"))
    return c.select("id", F.posexplode("c").alias("pos", "c")).select("id", F.col("pos").cast("bigint").alias("pos"), "c.file", "c.page")


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    q = _questions(spark, d).withColumn("pos", F.col("id").cast("bigint"))
    e = evaluate(_questions(spark, d), _answers(spark, d), _verdicts(spark, d))[0].withColumn("answer_score", F.col("answer_score").cast("int"))
    md5 = lambda c: F.md5(F.col(c).cast("binary")).alias(c)
    return report(q, _answers(spark, d), e).select("pos", "id", md5("expected"), md5("answer"), "score", "hallucinate")


def run_differences(spark: SparkSession, d: str) -> DataFrame:
    """Two runs: one of the ids asked, one of the ids answered, flagged by different columns."""
    a = _questions(spark, d).join(_answers(spark, d).select("id", "confidence"), "id", "left").select("id", (F.col("confidence") < 0.5).alias("hallucinate"))
    b = _answers(spark, d).select("id", (F.col("latency_ms") > 1000).alias("hallucinate"))
    return run_diff(a, b)


def token_costs(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").groupBy("source").agg(F.round(F.sum(X.token_cost(F.coalesce("n_chars", F.lit(0)), F.lit(100))), 6).alias("cost"))


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    u = t(spark, d, "chunk_vectors").where("embedding is not null").select("id", X.unit("embedding").alias("u")).distinct()
    return u.select("id", F.round(F.element_at("u", 1), 5).alias("first"), F.round(X.dot(F.col("u"), F.sequence(F.lit(1), F.size("u"))), 4).alias("whole"))


def prompt_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of the vector queries, whose hits show the documents of the same numbers."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("source", F.lit("")).alias("file"), F.lit(1).alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    hits = top_k(vector_queries(spark, d), t(spark, d, "embeddings"), 5, key="vec_id").join(docs, "chunk_id")
    q = vector_queries(spark, d).select("id", F.format_string("question %d", "id").alias("question"))
    return prompts(q, hits).select("id", F.md5(F.col("prompt").cast("binary")).alias("prompt"))


def confidence_check(spark: SparkSession, d: str) -> DataFrame:
    r = t(spark, d, "ask_responses").select("id", "confidence").distinct()
    return r.groupBy(X.in_confidence_range("confidence").alias("valid")).agg(F.count(F.lit(1)).alias("n"))


def manifest_urls(spark: SparkSession, d: str) -> DataFrame:
    """Urls of chunks by their file's entry."""
    urls = t(spark, d, "parsed_docs").where("url is not null").groupBy("file").agg(F.min("url").alias("listed"))
    return t(spark, d, "chunks").select("id", "file").distinct().join(urls, "file", "left").select("id", "listed")


def cited_pages(spark: SparkSession, d: str) -> DataFrame:
    """Answers of recorded replies whose hits are the pages the service cited: trailers resolved, only booklets with pages."""
    a = _answers(spark, d).where("answer is not null")
    given = a.select("id", F.col("answer").alias("reply"), F.lit(0.0).alias("latency_ms"), F.lit(1).alias("prompt_tokens"), F.lit(1).alias("completion_tokens"), F.lit(None).cast("string").alias("error"))
    shown = a.select(F.col("id").alias("q_id"), F.posexplode("citations").alias("p", "c")).select(
        "q_id", (F.col("p") + 1).alias("rank"), F.col("c.file").alias("file"), F.col("c.page").cast("int").alias("page"), F.when(F.col("c.file").endswith(".pdf"), "pdf").otherwise("txt").alias("kind"), F.lit(0.5).alias("score")
    )
    return answers_of(given, shown).select("id", F.size("retrieved").cast("bigint").alias("hits"), F.posexplode_outer("citations").alias("pos", "c")).select("id", "hits", F.col("pos").cast("bigint").alias("pos"), "c.file", "c.page")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "ask_requests").where("question is not null and id is not null").groupBy("id").agg(F.min("question").alias("question"))


def rag_answers(spark: SparkSession, d: str) -> DataFrame:
    """A whole run over all questions, with the offline encoder and generator, against an index that is written first."""
    chunks = t(spark, d, "chunks").where("text is not null").distinct()
    index = written(index_records(chunks, embed(chunks.select("id", "text"), HashingEncoder())), "index")
    made = answer_questions(_asked(spark, d), index, HashingEncoder(), EchoGenerator())
    cited = F.array_join(F.transform("citations", lambda c: F.concat_ws("#", c["file"], c["page"].cast("string"))), ",")
    found = F.array_join(F.transform("retrieved", lambda c: F.concat_ws("#", c["file"], c["page"].cast("string"))), ",")
    return made.select("id", F.md5(F.col("answer").cast("binary")).alias("answer"), cited.alias("citations"), found.alias("retrieved"))


def baseline_answers(spark: SparkSession, d: str) -> DataFrame:
    """All questions without sources."""
    made = answer_questions(_asked(spark, d), spark.createDataFrame([], "id string"), HashingEncoder(), EchoGenerator(), k=0)
    return made.select("id", F.md5(F.col("answer").cast("binary")).alias("answer"), F.size("retrieved").cast("bigint").alias("retrieved"))


def service_responses(spark: SparkSession, d: str) -> DataFrame:
    """What a service returns for recorded answers; requests without a question are turned away."""
    valid = checked_requests(t(spark, d, "ask_requests").select("id", "question").distinct()).where("problem is null").select("id").distinct()
    a = _answers(spark, d).where("answer is not null").select("id", "answer", "citations", "latency_ms", F.struct(F.length("answer").alias("prompt"), F.lit(100).alias("completion")).alias("tokens"))
    return responses(a.join(valid, "id", "left_semi")).select("id", F.size("citations").cast("bigint").alias("cited"), "domain", "latency_ms", F.round("cost_usd", 8).alias("cost_usd"))


def asked_by_hour(spark: SparkSession, d: str) -> DataFrame:
    """An extension: ids by the hour they were first asked in."""
    w = asked_per_window(t(spark, d, "ask_requests").where("asked_at is not null"))
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "asked")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_of = (
        topk_cosine, recall_at_k, page_rows, parse_failures, page_totals, chunk_documents, chunk_split, chunk_length_stats, index_rows, fingerprint_rows, embedding_cache_misses, embedded_chunks,
        resume_pending, last_answers, judge_parse, judge_messages, eval_rows, eval_summary, eval_by_domain, citation_score, citation_extract, distinct_citations, report_rows, run_differences,
        vector_store, parsed_files, domain_files, answer_lines, question_files, manifest_file, raw_corpus, report_text, judge_fields, judged_answers, citation_digits, display_scores, baseline_answers, service_responses,
        token_costs, unit_vectors, prompt_assembly, confidence_check, manifest_urls, cited_pages, rag_answers, asked_by_hour,
    )
    return {f.__name__: f for f in all_of}


_TOPK = """hits AS (SELECT * FROM (SELECT q.vec_id AS q_id, v.vec_id AS chunk_id, v.label, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS rank
    FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) WHERE rank <= 5)"""

_ANSWERS = """ans AS (SELECT id, min(answer) AS answer, min(confidence) AS confidence, min(latency_ms) AS latency_ms, min(domain) AS domain, max(citations) AS citations FROM ask_responses GROUP BY id)"""

_STRIP = r"'^[\s\x1c-\x1f\x{85}\p{Z}]+|[\s\x1c-\x1f\x{85}\p{Z}]+$', '', 'g'"
_TRAILER = r"'(?i)[\s\x1c-\x1f\x{85}\p{Z}]*CITED:[\s\x1c-\x1f\x{85}\p{Z}]*(none|[\d,\s\x1c-\x1f\x{85}\p{Z}]+)$'"

_EVALS = _ANSWERS + """, qs AS (SELECT id, min(question) AS question FROM ask_requests GROUP BY id),
    shaped AS (SELECT *, (length(id) + length(coalesce(answer, ''))) % 4 AS shape, CAST(1 + floor(coalesce(confidence, 0) * 4) AS DOUBLE) AS made FROM ans),
    cites AS (SELECT id, count(*) AS n, sum(CAST(ok AS INT)) AS met FROM (
        SELECT id, g, bool_or(file = gfile AND page IS NOT DISTINCT FROM gpage + off) AS ok FROM (
            SELECT a.id, i AS g, (i - 1) % 2 AS off, trim(replace(a.citations[i].file, '\\', '/'), '/') AS gfile, a.citations[i].page AS gpage, trim(replace(c.file, '\\', '/'), '/') AS file, c.page AS page
            FROM ans a, (SELECT unnest(range(1, 50)) AS i), unnest(a.citations) AS u(c) WHERE i <= len(a.citations)) GROUP BY id, g) GROUP BY id),
    evals AS (SELECT q.id, CASE WHEN s.shape < 3 THEN s.made END AS answer_score, coalesce(c.met / c.n, 1.0) AS citation_score, CASE WHEN s.shape < 3 THEN s.made = 1 END AS hallucinate,
        s.latency_ms AS latency, CASE WHEN s.id IS NULL THEN 'no answer' WHEN s.shape = 3 THEN 'no readable verdict' END AS error, s.domain
        FROM qs q LEFT JOIN shaped s ON q.id = s.id LEFT JOIN cites c ON q.id = c.id)"""

_SUMMARY = """count(*) AS count, round(coalesce(avg(answer_score), 0), 6) AS avg_answer_score, count(*) FILTER (answer_score = 1) AS hallucinations,
    round(count(*) FILTER (answer_score = 1) / count(*), 6) AS hallucination_rate, round(coalesce(avg(latency), 0), 1) AS avg_latency_ms"""


_BLANK = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _parts(size: int) -> str:
    """Parts of ``source`` (key, text stripped): cut after the last stop of each window, or at its end if that lies in the first half."""
    cut_at = f"""CASE WHEN length(regexp_extract(left(rest, {size}), '(?s)^(.*)(?:\\. |\\? |! |\n)', 1)) < {size // 2} THEN {size}
        ELSE length(regexp_extract(left(rest, {size}), '(?s)^(.*)(?:\\. |\\? |! |\n)', 1)) + 1 END"""
    return f"""cuts AS (SELECT key, 0 AS n, NULL::VARCHAR AS part, text AS rest FROM source
        UNION ALL SELECT key, n + 1, {_stripped(f'left(rest, {cut_at})')}, regexp_replace(substr(rest, {cut_at} + 1), '^{_BLANK}+', '') FROM cuts WHERE length(rest) > {size}),
    parts AS (SELECT key, n, part FROM cuts WHERE part <> '' UNION ALL SELECT key, n + 1, rest FROM cuts WHERE length(rest) <= {size} AND rest <> '')"""


#: Hashed words as the offline encoder has them: of ``texts`` (id, text) the vector before it is brought to length one.
_ENCODED = f"""words AS (SELECT id, unnest(string_split_regex(lower(text), '{_BLANK}+')) AS w FROM texts),
    placed AS (SELECT id, CAST('0x' || substr(md5(w), 1, 4) AS INT) % 64 AS p, CASE WHEN substr(md5(w), 5, 1) >= '8' THEN 1 ELSE -1 END AS s FROM words WHERE w <> ''),
    summed AS (SELECT id, p, sum(s) AS v FROM placed GROUP BY ALL),
    vecs AS (SELECT t.id, list(coalesce(v, 0)::DOUBLE ORDER BY g) AS e FROM (SELECT DISTINCT id FROM texts) t CROSS JOIN range(64) r(g) LEFT JOIN summed s ON s.id = t.id AND s.p = g GROUP BY t.id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "chunk_split": f"""WITH RECURSIVE source AS (SELECT doc_id AS key, {_stripped('text')} AS text FROM documents WHERE text IS NOT NULL), {_parts(1500)}
            SELECT key AS doc_id, CAST(row_number() OVER (PARTITION BY key ORDER BY n) - 1 AS INT) AS part, part AS text FROM parts""",
        "chunk_documents": f"""WITH RECURSIVE docs AS (SELECT DISTINCT file, domain, kind, url, p.page AS page, p.text AS text FROM (SELECT file, domain, kind, url, unnest(pages) AS p FROM parsed_docs WHERE error IS NULL)),
            paras AS (SELECT file, page, url, unnest(string_split(text, chr(10) || chr(10))) AS t, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS j FROM docs WHERE text IS NOT NULL),
            source AS (SELECT {{'file': file, 'page': page, 'url': url, 'j': j}} AS key, {_stripped('t')} AS text FROM paras), {_parts(1500)},
            units AS (SELECT key.file AS file, key.page AS page, key.url AS url, part AS u, row_number() OVER (PARTITION BY key.file, key.page, key.url ORDER BY key.j, n) AS i FROM parts),
            packing AS (
                SELECT file, page, url, i, [u] AS held, length(u) + 2 AS weight, NULL::VARCHAR AS chunk FROM units WHERE i = 1
                UNION ALL SELECT file, page, url, i, list_append(kept, u), CASE WHEN flush THEN coalesce(list_sum(list_transform(kept, lambda x: length(x))), 0) ELSE weight END + length(u) + 2, CASE WHEN flush THEN array_to_string(held, chr(10) || chr(10)) END
                FROM (SELECT *, CASE WHEN NOT flush THEN held WHEN fit > 0 THEN held[len(held) - fit + 1:] WHEN strpos(tail, '. ') BETWEEN 1 AND 100 THEN [substr(tail, strpos(tail, '. ') + 2)]
                        ELSE [substr(tail, strpos(tail, ' ') + 1)] END AS kept
                    FROM (SELECT s.file, s.page, s.url, w.i, w.u, s.held, s.weight, s.weight + length(w.u) > 1500 AS flush, right(s.held[len(s.held)], 200) AS tail,
                        len(list_filter(range(1, len(s.held) + 1), lambda k: list_sum(list_transform(s.held[len(s.held) - k + 1:], lambda x: length(x))) <= 200)) AS fit
                        FROM packing s JOIN units w ON w.file = s.file AND w.page = s.page AND w.url IS NOT DISTINCT FROM s.url AND w.i = s.i + 1))),
            chunked AS (SELECT file, page, url, i, chunk FROM packing WHERE chunk IS NOT NULL
                UNION ALL SELECT file, page, url, i + 1, array_to_string(held, chr(10) || chr(10)) FROM packing p WHERE i = (SELECT max(i) FROM units u WHERE u.file = p.file AND u.page = p.page AND u.url IS NOT DISTINCT FROM p.url)),
            numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY file, page, url ORDER BY i) - 1 AS INT) AS chunk_index FROM chunked)
            SELECT DISTINCT n.file || '#p' || n.page || '.' || chunk_index AS id, n.file, domain, kind, n.url, n.page, chunk_index, chunk AS text FROM numbered n JOIN docs d ON d.file = n.file AND d.page = n.page AND d.url IS NOT DISTINCT FROM n.url""",
        "embedded_chunks": f"""WITH texts AS (SELECT DISTINCT id, text FROM chunks WHERE text IS NOT NULL), {_ENCODED}
            SELECT t.id, array_to_string(list_transform(e, lambda x: CASE WHEN x > 0 THEN '+' WHEN x < 0 THEN '-' ELSE '0' END), '') AS signs, CASE WHEN list_sum(list_transform(e, lambda x: x * x)) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS length,
            sha256(concat_ws(chr(31), 'hashing-64', '', t.id, text)) AS fingerprint FROM texts t JOIN vecs v ON v.id = t.id""",
        "vector_store": "SELECT DISTINCT id, sha256(concat_ws(chr(31), 'hashing-64', '', id, text)) AS fingerprint, length(text) % 2 = 0 AND length(text) % 6 <> 0 AS kept FROM chunks WHERE text IS NOT NULL",
        "parsed_files": "SELECT DISTINCT file, domain, kind, url, CAST(CASE WHEN pages IS NULL THEN NULL ELSE len(pages) END AS INT) AS n, md5(array_to_string(list_transform(pages, lambda p: concat_ws(':', p.page, p.text)), '|')) AS pages, error FROM parsed_docs",
        "domain_files": "SELECT DISTINCT file, domain FROM parsed_docs WHERE domain = 'vehicle' AND error IS NULL",
        "answer_lines": f"""WITH {_ANSWERS} SELECT id, md5(concat_ws(' ', CASE WHEN length(id) % 2 = 0 OR confidence < 0.5 THEN 'run 2' ELSE 'run 1' END, answer)) AS answer, len(citations) AS cited, latency_ms, confidence FROM ans""",
        "question_files": "SELECT layout, row_number() OVER (PARTITION BY layout ORDER BY domain) - 1 AS pos, domain AS id, title AS question, '3' AS page FROM domains, (VALUES ('list'), ('wrapped')) AS l(layout)",
        "manifest_file": "SELECT p.domain || '/pages/index.txt' AS file, host AS url FROM (SELECT DISTINCT domain FROM parsed_docs WHERE error IS NULL) p LEFT JOIN domains d ON p.domain = d.domain",
        "raw_corpus": """SELECT n || '/pages/pages' || k || '.txt' AS file, n AS domain, 'txt' AS kind, CASE n WHEN 'home' THEN 'http://home' END AS url, '1:' || n || ' first' || chr(10) || 'line' || chr(10) || 'last#' AS pages, false AS failed FROM (VALUES ('dental', 0), ('home', 1), ('trip', 2)) AS v(n, k)
            UNION ALL SELECT n || '/files/files' || k || '.pdf', n, 'pdf', NULL, NULL, true FROM (VALUES ('dental', 0), ('home', 1), ('trip', 2)) AS v(n, k)""",
        "report_text": f"""WITH {_EVALS}, told AS (SELECT e.id, q.question, coalesce(a.answer, '[missing]') AS answer, coalesce(CAST(CAST(answer_score AS INT) AS VARCHAR), 'N/A') AS score, coalesce(CAST(CAST(trunc(citation_score * 100) AS INT) AS VARCHAR), 'N/A') AS cited, coalesce(CAST(hallucinate AS VARCHAR), 'N/A') AS lied
                FROM evals e JOIN qs q ON q.id = e.id LEFT JOIN ans a ON e.id = a.id),
            texts AS (SELECT repeat('=', 80) || chr(10) || 'ID: ' || id || chr(10) || repeat('=', 80) || chr(10) || chr(10) || 'QUESTION:' || chr(10) || coalesce(question, 'null') || chr(10) || chr(10) || 'REFERENCE ANSWER:' || chr(10) || answer || chr(10) || chr(10)
                || 'GENERATED ANSWER:' || chr(10) || answer || chr(10) || chr(10) || 'SCORES:' || chr(10) || '  answer_score:   ' || score || chr(10) || '  citation_score: ' || cited || chr(10) || '  Hallucinate:    ' || lied || chr(10) || chr(10) AS t FROM told)
            SELECT line, count(*) AS times FROM (SELECT unnest(string_split_regex(t, '\r\n|\r|\n')) AS line FROM texts) GROUP BY line""",
        "judge_fields": f"WITH {_ANSWERS} SELECT id, CAST(1 + length(id) + coalesce(length(answer), 0) % 5 AS DOUBLE) AS similarity_score, (1 + length(id) + coalesce(length(answer), 0) % 5) % 2 = 0 AS is_refusal, 'fields' AS status FROM ans",
        "judged_answers": f"""WITH {_ANSWERS}, w AS (SELECT id, list_distinct(list_filter(string_split_regex(lower(substr(answer, 1, 60)), '{_BLANK}+'), lambda x: x <> '')) AS truth, list_distinct(list_filter(string_split_regex(lower(concat_ws(' ', substr(answer, 20, 60), domain)), '{_BLANK}+'), lambda x: x <> '')) AS said FROM ans WHERE answer IS NOT NULL),
            s AS (SELECT id, CAST(1 + round_even(4.0::DOUBLE * len(list_intersect(truth, said)) / greatest(1, len(truth)), 0) AS DOUBLE) AS answer_score FROM w) SELECT id, answer_score, answer_score = 1 AS hallucinate, NULL::VARCHAR AS error FROM s""",
        "citation_digits": f"""WITH {_ANSWERS}, s AS (SELECT id, regexp_replace(answer, {_STRIP}) AS a FROM ans WHERE answer IS NOT NULL)
            SELECT id, array_to_string(list_transform(regexp_extract_all(regexp_extract(a, {_TRAILER}, 1), '\\d+'), lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ',') AS numbers FROM s""",
        "display_scores": "SELECT vec_id, CAST(i - 1 AS INT) AS pos, CAST(printf('%.3f', round(embedding[i]::DOUBLE, 4) + 0.0005) AS DOUBLE) AS score FROM embeddings, range(1, 65) r(i)",
        "cited_pages": f"""WITH {_ANSWERS}, s AS (SELECT id, regexp_replace(answer, {_STRIP}) AS a, coalesce(citations, []) AS h FROM ans WHERE answer IS NOT NULL),
            n AS (SELECT id, h, list_transform(regexp_extract_all(regexp_extract(a, {_TRAILER}, 1), '\\d+'), lambda x: CAST(x AS INT)) AS ns FROM s),
            c AS (SELECT id, len(h) AS hits, unnest(ns) AS k, generate_subscripts(ns, 1) AS j, h FROM n),
            named AS (SELECT id, j, h[k].file AS file, CASE WHEN h[k].file LIKE '%.pdf' THEN h[k].page END AS page FROM c WHERE k BETWEEN 1 AND len(h)),
            firsts AS (SELECT id, file, page, min(j) AS j FROM named GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY j) - 1 AS pos FROM firsts)
            SELECT n.id, len(n.h) AS hits, pos, file, CAST(page AS INT) AS page FROM n LEFT JOIN ranked r ON r.id = n.id""",
        "rag_answers": f"""WITH asked AS (SELECT id, min(question) AS question FROM ask_requests WHERE question IS NOT NULL AND id IS NOT NULL GROUP BY id),
            held AS (SELECT DISTINCT id, file, page, kind, text FROM chunks WHERE text IS NOT NULL), texts AS (SELECT 'q' || id AS id, question AS text FROM asked UNION ALL SELECT DISTINCT 'c' || id, text FROM held), {_ENCODED},
            units AS (SELECT id, list_transform(e, lambda x: (x / n)::FLOAT::DOUBLE) AS e FROM (SELECT id, e, greatest(sqrt(list_sum(list_transform(e, lambda x: x * x))), 1e-12) AS n FROM vecs)),
            lengths AS (SELECT id, e, greatest(sqrt(list_sum(list_transform(e, lambda x: x * x))), 1e-12) AS n FROM units),
            scored AS (SELECT q.id AS q, c.id AS c, round(list_dot_product(q.e, c.e) / (q.n * c.n), 9) AS s FROM lengths q, lengths c WHERE q.id LIKE 'q%' AND c.id LIKE 'c%'),
            ranked AS (SELECT * FROM (SELECT substr(q, 2) AS q, substr(c, 2) AS c, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS r FROM scored) WHERE r <= 5),
            hits AS (SELECT q, r, file, page, kind, text FROM ranked JOIN held ON held.id = c),
            shown AS (SELECT q, string_agg('[' || r || '] file: ' || file || ' | page: ' || page || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r) AS x, string_agg(file || '#' || page, ',' ORDER BY r) AS retrieved, string_agg(CASE WHEN r = 1 THEN file || CASE WHEN kind = 'pdf' THEN '#' || page ELSE '' END END, ',') AS citations FROM hits GROUP BY q),
            told AS (SELECT id, x || chr(10) || chr(10) || 'Question: ' || question AS prompt, citations, retrieved FROM asked JOIN shown ON q = id)
            SELECT id, md5({_stripped("split_part(substr(prompt, strpos(prompt, chr(10)) + 1), '. ', 1)")} || '.') AS answer, citations, retrieved FROM told""",
        "baseline_answers": f"""WITH asked AS (SELECT id, 'Question: ' || min(question) AS p FROM ask_requests WHERE question IS NOT NULL AND id IS NOT NULL GROUP BY id)
            SELECT id, md5({_stripped("split_part(substr(p, strpos(p, chr(10)) + 1), '. ', 1)")} || '.') AS answer, 0::BIGINT AS retrieved FROM asked""",
        "service_responses": f"""WITH {_ANSWERS} SELECT id, len(citations) AS cited, NULL::VARCHAR AS domain, latency_ms, round((length(answer) * 0.5 + 200) / 1000000, 8) AS cost_usd FROM ans WHERE answer IS NOT NULL AND id IN (SELECT id FROM ask_requests WHERE question IS NOT NULL)""",
        "topk_cosine": f"WITH {_TOPK} SELECT q_id, CAST(rank AS INT) AS rank, chunk_id, label, round(score, 6) AS score FROM hits",
        "recall_at_k": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_transform(embedding::DOUBLE[], lambda x: round(x, 1)) AS c FROM embeddings),
            s AS (SELECT q.vec_id AS q, v.vec_id AS i, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, v.e), 9) DESC, v.vec_id) AS r, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.c, v.c), 9) DESC, v.vec_id) AS rc FROM v q, v WHERE q.vec_id % 20 = 0)
            SELECT round(avg(CAST(rc <= 5 AS DOUBLE)), 6) AS recall FROM s WHERE r <= 5""",
        "page_rows": "SELECT DISTINCT file, split_part(file, '/', 1) AS domain, regexp_extract(file, '\\.([^./]+)$', 1) AS kind, p.page AS page, length(p.text) AS chars FROM (SELECT file, unnest(pages) AS p FROM parsed_docs WHERE error IS NULL)",
        "parse_failures": "SELECT DISTINCT file, error FROM parsed_docs WHERE error IS NOT NULL",
        "page_totals": "SELECT domain, CAST(sum(len(pages)) AS BIGINT) AS pages, count(*) AS docs FROM parsed_docs WHERE error IS NULL GROUP BY domain",
        "chunk_length_stats": "SELECT count(*) AS n, (list_sort(list(length(text))))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median, max(length(text)) AS longest FROM (SELECT DISTINCT * FROM chunks) WHERE text IS NOT NULL",
        "index_rows": "SELECT c.id, file, page, coalesce(url, '') AS url, chunk_index, md5(text) AS text, round(list_dot_product(embedding::DOUBLE[], range(1, 65)::DOUBLE[]), 4) AS vector FROM (SELECT DISTINCT * FROM chunks) c JOIN (SELECT DISTINCT id, embedding FROM chunk_vectors WHERE embedding IS NOT NULL) v ON c.id = v.id",
        "fingerprint_rows": "SELECT doc_id, sha256(concat_ws(chr(31), 'multilingual-e5-large', 'passage: ', CAST(doc_id AS VARCHAR), text)) AS fingerprint FROM documents WHERE text IS NOT NULL",
        "embedding_cache_misses": "SELECT DISTINCT id, sha256(concat_ws(chr(31), 'hashing-64', '', id, text)) AS fingerprint FROM chunks WHERE text IS NOT NULL AND (length(text) % 2 = 1 OR length(text) % 6 = 0)",
        "resume_pending": "SELECT DISTINCT id FROM ask_requests WHERE id NOT IN (SELECT id FROM ask_responses WHERE id IS NOT NULL)",
        "last_answers": "SELECT id, strftime(max(answered_at), '%Y-%m-%d %H:%M:%S') AS answered_at, arg_max(domain, answered_at) AS domain FROM (SELECT * FROM ask_responses WHERE answered_at IS NOT NULL) GROUP BY id",
        "judge_parse": f"WITH {_EVALS} SELECT id, CASE WHEN shape < 3 THEN made END AS similarity_score, shape < 2 AND made = 1 AS is_hallucination, CASE shape WHEN 3 THEN 'error' WHEN 2 THEN 'fields' ELSE 'json' END AS status FROM shaped",
        "judge_messages": f"WITH {_ANSWERS} SELECT a.id, md5('Ground truth:' || chr(10) || coalesce(answer, '') || chr(10) || chr(10) || 'Candidate:' || chr(10) || coalesce(answer, '')) AS prompt FROM ans a WHERE a.id IN (SELECT id FROM ask_requests)",
        "eval_rows": f"WITH {_EVALS} SELECT id, answer_score, round(citation_score, 6) AS citation_score, hallucinate, error FROM evals",
        "eval_summary": f"WITH {_EVALS} SELECT {_SUMMARY} FROM evals",
        "eval_by_domain": f"WITH {_EVALS} SELECT domain, {_SUMMARY} FROM evals GROUP BY domain",
        "citation_score": f"WITH {_EVALS} SELECT q.id, coalesce(met = n, true) AS is_fully_correct, round(coalesce(met / n, 1.0), 6) AS score, coalesce(CAST(met AS VARCHAR) || '/' || CAST(n AS VARCHAR), '0/0') AS satisfied_groups_count FROM qs q LEFT JOIN cites c ON q.id = c.id",
        "citation_extract": f"""WITH {_ANSWERS}, s AS (SELECT id, regexp_replace(answer, {_STRIP}) AS a FROM ans WHERE answer IS NOT NULL)
            SELECT id, md5(regexp_replace(regexp_replace(a, {_TRAILER}, ''), {_STRIP})) AS body, array_to_string(list_transform(regexp_extract_all(regexp_extract(a, {_TRAILER}, 1), '\\d+'), lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ',') AS numbers FROM s""",
        "distinct_citations": f"""WITH {_ANSWERS}, e AS (SELECT id, i, trim(replace(citations[i].file, '\\', '/'), '/') AS file, citations[i].page AS page FROM ans, (SELECT unnest(range(1, 50)) AS i) WHERE i <= len(citations)),
            f AS (SELECT id, coalesce(file, '') AS file, page, min(i) AS i FROM e GROUP BY ALL) SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS pos, file, CAST(page AS VARCHAR) AS page FROM f""",
        "report_rows": f"""WITH {_EVALS} SELECT CAST(e.id AS BIGINT) AS pos, e.id, md5(coalesce(a.answer, '[missing]')) AS expected, md5(coalesce(a.answer, '[missing]')) AS answer,
            coalesce(CAST(CAST(answer_score AS INT) AS VARCHAR), 'N/A') AS score, coalesce(CAST(hallucinate AS VARCHAR), 'N/A') AS hallucinate FROM evals e LEFT JOIN ans a ON e.id = a.id""",
        "run_differences": f"""WITH {_ANSWERS}, a AS (SELECT q.id, confidence < 0.5 AS h FROM (SELECT DISTINCT id FROM ask_requests) q LEFT JOIN ans ON q.id = ans.id), b AS (SELECT id, latency_ms > 1000 AS h FROM ans)
            SELECT * FROM (SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'only_a' WHEN a.id IS NULL THEN 'only_b' WHEN a.h IS DISTINCT FROM b.h THEN 'changed' END AS status, a.h AS a, b.h AS b FROM a FULL JOIN b ON a.id = b.id) WHERE status IS NOT NULL""",
        "token_costs": "SELECT source, round(sum((coalesce(n_chars, 0) * 0.5 + 100 * 2.0) / 1000000), 6) AS cost FROM documents GROUP BY source",
        "unit_vectors": "SELECT DISTINCT id, round(e[1] / nullif(n, 0), 5) AS first, round(list_dot_product(e, range(1, 65)::DOUBLE[]) / nullif(n, 0), 4) AS whole FROM (SELECT id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM chunk_vectors WHERE embedding IS NOT NULL)",
        "prompt_assembly": f"""WITH {_TOPK}, s AS (SELECT q_id, string_agg('[' || rank || '] file: ' || coalesce(source, '') || ' | page: 1' || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS x FROM hits JOIN documents ON doc_id = chunk_id GROUP BY q_id)
            SELECT vec_id AS id, md5(coalesce(x || chr(10) || chr(10), '') || 'Question: question ' || vec_id) AS prompt FROM embeddings LEFT JOIN s ON vec_id = q_id WHERE vec_id % 20 = 0""",
        "confidence_check": "SELECT confidence IS NULL OR (confidence >= 0 AND confidence <= 1) AS valid, count(*) AS n FROM (SELECT DISTINCT id, confidence FROM ask_responses) GROUP BY 1",
        "manifest_urls": "SELECT c.id, listed FROM (SELECT DISTINCT id, file FROM chunks) c LEFT JOIN (SELECT file, min(url) AS listed FROM parsed_docs WHERE url IS NOT NULL GROUP BY file) u ON c.file = u.file",
        "asked_by_hour": "SELECT strftime(date_trunc('hour', a), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS asked FROM (SELECT id, min(asked_at) AS a FROM ask_requests WHERE asked_at IS NOT NULL GROUP BY id) GROUP BY 1",
    }
