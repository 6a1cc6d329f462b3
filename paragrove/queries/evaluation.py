"""Queries of evaluation runs, prompts and first-generation retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paragrove.functions import text
from paragrove.operators import evalrun, lexical, prompt
from paragrove.queries.text import C, FIG, KIND, chunks, figures
from paragrove.runtime import table
from paragrove.sources import files


def runs(spark, sf):
    return table(spark, sf, "runs").dropDuplicates(["record_id"])


def bench_plan(spark, sf):
    return evalrun.plan(table(spark, sf, "models"), table(spark, sf, "questions"), 2).select("model_alias", "replicate", "question_id", "question_index")


def bench_resume(spark, sf):
    planned = evalrun.plan(table(spark, sf, "models"), table(spark, sf, "questions"), 2)
    return evalrun.resume(planned, runs(spark, sf)).select("model_alias", "replicate", "question_id")


def bench_validate(spark, sf):
    return evalrun.validation(runs(spark, sf))


def bench_effective(spark, sf):
    return evalrun.effective(runs(spark, sf)).select(*evalrun.KEYS, "record_id")


def bench_unresolved(spark, sf):
    r = runs(spark, sf)
    return r.where("status = 'error'").select(*evalrun.KEYS).distinct().join(r.where("status = 'ok'").select(*evalrun.KEYS).distinct(), evalrun.KEYS, "left_anti")


def bench_progress(spark, sf):
    return runs(spark, sf).groupBy("run_id").agg(F.count("*").alias("n"), F.sum((F.col("status") == "ok").cast("bigint")).alias("ok"), F.sum((F.col("status") == "error").cast("bigint")).alias("errors"), F.max("completed_at").alias("last_completed"))


def bench_leak_guard(spark, sf):
    """Keys that must not reach a model: columns of tables, and keys of question rows (here rows with two such keys put in)."""
    found = [(t, c) for t in ("questions", "chunks", "vec_chunks") for c in evalrun.leaked(table(spark, sf, t))]
    columns = spark.createDataFrame(found, "source string, leaked string")
    row = F.to_json(F.struct("question_id", "question", F.lit("x").alias("gold_answer"), F.array(F.lit("2B.01")).alias("Sections")))
    return columns.unionByName(evalrun.leaked_rows(table(spark, sf, "questions").select(row.alias("row")), "row").select(F.lit("rows").alias("source"), F.col("key").alias("leaked")).distinct())


def ablation_matrix(spark, sf):
    """Ablations by questions, with their changed settings."""
    rows = [(name, {k: str(v).lower() for k, v in changed.items()}) for name, changed in evalrun.ABLATIONS.items()]
    a = spark.createDataFrame(rows, "ablation string, changed map<string, string>")
    return table(spark, sf, "questions").select("question_id").join(F.broadcast(a), F.lit(True)).select("question_id", "ablation", F.array_join(F.array_sort(F.map_keys("changed")), ",").alias("changed"))


def ablation_counts(spark, sf):
    return runs(spark, sf).groupBy("prompt_style", "model_alias").agg(F.count("*").alias("total"), F.sum(F.col("error").isNull().cast("bigint")).alias("without_error"), F.countDistinct("question_id").alias("questions"))


def problem_ids(spark, sf):
    """Records that need another run: failed, empty, heading only, error text, or cut by the token limit."""
    a = F.coalesce("answer", F.lit(""))
    bad = (F.col("status") != "ok") | (F.trim(a) == "") | F.ltrim(a).startswith("### ") | evalrun.error_text(a)
    cut = F.coalesce(F.col("error").contains("length"), F.lit(False))
    r = runs(spark, sf).select("question_id", "record_id", bad.alias("invalid"), cut.alias("cut")).where("invalid OR cut")
    return r.select("record_id", "question_id", "invalid", "cut", F.regexp_extract("question_id", r"^([A-Za-z]+)(\d+)$", 1).alias("prefix"), F.regexp_extract("question_id", r"^([A-Za-z]+)(\d+)$", 2).cast("int").alias("number"))


def answer_extract(spark, sf):
    """Extraction from the output that every record came from: its answer as it is, under its heading again if it has none of its own."""
    a, method = F.coalesce("answer", F.lit("")), F.col("answer_extraction_method")
    md = F.when(a.rlike(r"(?i)(?:^|\n)\s*#{2,4}\s*Answer\s*(?:\n|\z)"), a).otherwise(F.concat(F.lit("### Answer\n"), a, F.lit("\n### Debug\nx")))
    out = F.when(a.rlike(r"(?i)(?:^|\n)\s*(?:answer|final answer)\s*[:\n]"), a).otherwise(F.concat(F.lit("log\nAnswer: "), a, F.lit("\ndebug: x")))
    x = evalrun.extract_answer(F.when(method == "markdown_section", md), F.when(method == "return_key", a), F.when(method == "stdout", out))
    return runs(spark, sf).select("record_id", x.alias("x")).select("record_id", F.col("x.method").alias("method"), F.length("x.answer").alias("n_chars"))


def usage_extract(spark, sf):
    """Token counts read from JSON, whatever their name."""
    raw = F.to_json(F.struct(F.col("usage.input_tokens").alias("prompt_tokens"), F.col("usage.output_tokens").alias("output_tokens")))
    got = lambda a, b: F.coalesce(F.get_json_object("raw", f"$.{a}"), F.get_json_object("raw", f"$.{b}")).cast("bigint")
    return runs(spark, sf).select("record_id", raw.alias("raw")).select("record_id", got("input_tokens", "prompt_tokens").alias("input_tokens"), got("output_tokens", "completion_tokens").alias("output_tokens"))


def filter_response_parse(spark, sf):
    """Replies of an image filter, with and without words around the list."""
    reply = F.when(F.col("record_id") % 3 == 0, F.concat(F.lit("Keep ["), F.col("replicate").cast("string"), F.lit(", 3]"))).when(F.col("record_id") % 3 == 1, F.concat(F.lit("[0, "), F.col("attempts").cast("string"), F.lit("]"))).otherwise("none of them")
    return runs(spark, sf).select("record_id", evalrun.filter_reply(reply).alias("kept"))


def figure_evidence(spark, sf):
    """Figures written as image lines and read again; a title over several lines is one line."""
    title = F.coalesce(F.regexp_replace("title", r"[\s\x{85}\x{2028}\x{2029}]+", " "), F.lit("untitled"))
    md = figures(spark, sf).select("figure_key", F.concat(F.lit("**[Image "), F.coalesce("sheet", F.lit(1)).cast("string"), F.lit("]** "), F.col("figure_id"), F.lit(" (p."), F.col("page_pdf").cast("string"), F.lit(") — "), title).alias("md"))
    return evalrun.figure_evidence(md, "figure_key", "md")


def latency_by_model(spark, sf):
    return runs(spark, sf).groupBy("model_alias").agg(F.count("latency_ms").alias("n"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"), F.round(F.avg("latency_ms"), 4).alias("mean_ms"))


def upsert_last_wins(spark, sf):
    """The chunk vectors put into an empty table by id."""
    v = table(spark, sf, "vec_chunks").select("id", F.col("payload.chunk_id").alias("chunk_id"), "upserted_at")
    return files.merge_upsert(v.limit(0), v, "id", "upserted_at")


def incremental_missing(spark, sf):
    """Chunks without a usable vector, to be encoded."""
    have = table(spark, sf, "vec_chunks").where("size(dense) = 64").select(F.col("payload.chunk_id").alias("chunk_id")).distinct()
    return chunks(spark, sf).select("chunk_id").join(have, "chunk_id", "left_anti")


def embedding_join(spark, sf):
    """Figure vectors with their live figure's metadata, by stable id."""
    from paragrove.functions.ids import stable_id

    f = figures(spark, sf).groupBy("manual", "figure_id").agg(F.min("page_pdf").alias("page"), F.count("*").alias("n_crops")).withColumn("id", stable_id(F.concat_ws(":", "manual", "figure_id")))
    return table(spark, sf, "vec_figures").select("id").distinct().join(f, "id", "left").select("id", "figure_id", "page", "n_crops")


def _hits(spark, sf):
    kind = F.coalesce(text.content_type(F.col("content_type")), F.lit("Support"))
    c = chunks(spark, sf).select(F.concat_ws("/", "manual", "section_id").alias("qid"), "chunk_id", kind.alias("kind"), "section_id", "section_title", "ordinal", "page_printed", "text")
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("ordinal", "chunk_id"))).where("rank <= 6")


def evidence_blocks(spark, sf):
    """The six first provisions of every section, as the evidence of a query."""
    return prompt.evidence(_hits(spark, sf)).select("qid", F.sha2("evidence", 256).alias("evidence_sha"), F.length("evidence").alias("n_chars"))


def citation_whitelist(spark, sf):
    return prompt.whitelist(_hits(spark, sf))


def visual_lines(spark, sf):
    f = figures(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("manual", "page_pdf").orderBy("figure_key")))
    return f.select("figure_key", prompt.visual_line(F.col("n"), F.col("figure_id"), F.col("page_printed"), F.col("caption")).alias("line"))


def prompts(spark, sf):
    """The prompts of all styles."""
    h = _hits(spark, sf)
    both = prompt.evidence(h).join(prompt.whitelist(h), "qid")
    styles = F.explode(F.array(*[F.struct(F.lit(s).alias("style"), prompt.assemble(s, F.concat(F.lit("What holds in "), "qid", F.lit("?")), F.col("evidence"), F.col("allowed")).alias("p")) for s in prompt.STYLES]))
    return both.select("qid", styles.alias("x")).select("qid", F.col("x.style").alias("style"), F.sha2("x.p", 256).alias("prompt_sha"))


def page_records(spark, sf):
    return lexical.page_records(chunks(spark, sf), figures(spark, sf))


def query_types(spark, sf):
    q = F.col("question")
    return table(spark, sf, "questions").select("question_id", lexical.has_any(q, lexical.VISUAL_TERMS).alias("visual"), F.when(lexical.has_any(q, lexical.SCENE_TERMS), "VISUAL_SCENARIO").otherwise("TEXTUAL").alias("kind"), lexical.explicit_page(q).alias("page"))


def _lexical_hits(spark, sf):
    """Sections by the words that they share with the question, joined on words."""
    word = lambda c: F.explode(F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: F.length(w) >= 5)))
    q = table(spark, sf, "questions").select(F.col("question_id").alias("qid"), word(F.col("question")).alias("w"))
    s = chunks(spark, sf).groupBy("section_id").agg(F.min("section_title").alias("title"), F.min("page_pdf").alias("page"))
    t = s.select("section_id", "page", word(F.col("title")).alias("w"))
    return q.join(t, "w").groupBy("qid", "section_id", "page").agg(F.count("*").cast("double").alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "section_id")))


def lexical_boost_topk(spark, sf):
    """The five best sections by shared words, then boosted where the title has a word pair of the question, and sorted again."""
    q = table(spark, sf, "questions").select(F.col("question_id").alias("qid"), F.regexp_extract(F.lower("question"), r"\b([a-z]+ (?:sign|panel|line|marker|plaque|beacon))\b", 1).alias("term"))
    s = chunks(spark, sf).groupBy("section_id").agg(F.min("section_title").alias("title"))
    hits = _lexical_hits(spark, sf).where("rank <= 5").join(q, "qid").join(s, "section_id")
    score = F.col("score") + lexical.section_boost(F.col("term"), F.col("title"), F.lit(""))
    w = Window.partitionBy("qid").orderBy(F.col("s").desc(), "section_id")
    return hits.withColumn("s", score).withColumn("rank", F.row_number().over(w)).select("qid", "section_id", "rank", F.round("s", 6).alias("score"))


def fuse_pages(spark, sf):
    hits = _lexical_hits(spark, sf)
    q = table(spark, sf, "questions").select(F.col("question_id").alias("qid"), F.concat("question", F.when(F.substring("question_id", -1, 1) == "0", F.lit(" (page 120)")).otherwise("")).alias("query"))
    pages = hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("page").desc(), "section_id")))
    return lexical.fuse_pages(q, hits, pages).select("qid", "page", "rank", F.round("score", 6).alias("score"))


def context_filter(spark, sf):
    hits = _lexical_hits(spark, sf).join(chunks(spark, sf).groupBy("section_id").agg(F.min("section_title").alias("title")), "section_id")
    return lexical.keep_context(hits, F.array(F.lit("sign"), F.lit("use")), "title", 2).select("qid", "section_id", "rank")


def fallback_answer(spark, sf):
    """Up to five distinct sentences of a section that share the most words with its title, joined in order of score."""
    c = chunks(spark, sf)
    s = c.select("manual", "section_id", "section_title", F.explode(F.slice(text.sentences(F.col("text")), 1, 8)).alias("s")).distinct()
    words = lambda x: F.array_distinct(F.split(F.lower(x), "[^a-z]+"))
    scored = s.withColumn("score", F.size(F.array_intersect(words(F.coalesce("section_title", F.lit(""))), words(F.col("s")))))
    w = Window.partitionBy("manual", "section_id").orderBy(F.col("score").desc(), "s")
    best = scored.withColumn("rn", F.row_number().over(w)).where("rn <= 5").groupBy("manual", "section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "s"))), lambda x: x["s"]), " ").alias("a"))
    return best.select("manual", "section_id", F.sha2("a", 256).alias("answer_sha"))


QUERIES = {f.__name__: f for f in (bench_plan, bench_resume, bench_validate, bench_effective, bench_unresolved, bench_progress, bench_leak_guard, ablation_matrix, ablation_counts, problem_ids, answer_extract, usage_extract, filter_response_parse, figure_evidence, latency_by_model, upsert_last_wins, incremental_missing, embedding_join, evidence_blocks, citation_whitelist, visual_lines, prompts, page_records, query_types, lexical_boost_topk, fuse_pages, context_filter, fallback_answer)}

R = "r AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY started_at) = 1)"
_KEYS = "model_alias, question_id, replicate"
_PLAN = "p AS (SELECT alias AS model_alias, replicate, question_id, question_index FROM models CROSS JOIN (SELECT unnest(range(1, 3))::INT AS replicate) CROSS JOIN (SELECT question_id, row_number() OVER (ORDER BY question_id) AS question_index FROM questions) WHERE enabled)"
_any = lambda c, ts: "(" + " OR ".join(f"contains(lower({c}), '{t}')" for t in ts) + ")"
_CITE = "'Section ' || coalesce(section_id, '?') || ' ' || kind || ' §' || coalesce(ordinal::VARCHAR, '?') || ' (p.' || coalesce(nullif(page_printed, ''), '?') || ')'"
_PROV = "'[Section ' || coalesce(section_id, '?') || ' §' || coalesce(ordinal::VARCHAR, '?') || ' — ' || coalesce(section_title, '') || ' (p.' || coalesce(nullif(page_printed, ''), '?') || ')]' || chr(10) || coalesce(text, '')"
_HITS = f"{C}, h AS (SELECT manual || '/' || section_id AS qid, *, {KIND} AS kind, row_number() OVER (PARTITION BY manual, section_id ORDER BY ordinal NULLS FIRST, chunk_id) AS rank FROM c QUALIFY rank <= 6)"
_EV = f"""{_HITS}, bl AS (SELECT qid, CASE kind WHEN 'Standard' THEN 1 WHEN 'Guidance' THEN 2 WHEN 'Option' THEN 3 WHEN 'Support' THEN 4 ELSE 9 END AS o, '=== ' || kind || ' provisions ===' || chr(10) || string_agg({_PROV}, chr(10) ORDER BY rank) || chr(10) AS b FROM h GROUP BY qid, kind), ev AS (SELECT qid, string_agg(b, chr(10) ORDER BY o, b) AS evidence FROM bl GROUP BY qid), wl AS (SELECT qid, list({_CITE} ORDER BY rank) AS allowed FROM h GROUP BY qid)"""
_q = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _assembled(style: str) -> str:
    parts = [_q(prompt.INTRO)]
    if style in ("oneshot", "fewshot"):
        parts.append(_q(prompt.examples(1 if style == "oneshot" else 3)))
    if style == "cot":
        parts.append(_q(prompt.REASON))
    parts += ["evidence", "'Allowed citations:' || chr(10) || '- ' || array_to_string(allowed, chr(10) || '- ')", _q(prompt.RULES), "'Question: What holds in ' || qid || '?'"]
    return " || chr(10) || chr(10) || ".join(parts)


_LEX = f"""{C}, sec AS (SELECT section_id, min(section_title) AS title, min(page_pdf) AS page FROM c GROUP BY 1), qw AS (SELECT question_id AS qid, unnest(list_distinct(list_filter(string_split_regex(lower(question), '[^a-z]+'), lambda w: length(w) >= 5))) AS w FROM questions), sw AS (SELECT section_id, page, unnest(list_distinct(list_filter(string_split_regex(lower(title), '[^a-z]+'), lambda w: length(w) >= 5))) AS w FROM sec),
lex AS (SELECT qid, section_id, page, count(*)::DOUBLE AS score, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, section_id) AS rank FROM qw JOIN sw USING (w) GROUP BY qid, section_id, page)"""
_SENT = r"list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '[\r\n]', ' ', 'g'), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: length(s) > 20)"
ORACLE = {
    "bench_plan": f"WITH {_PLAN} SELECT * FROM p",
    "bench_resume": f"WITH {_PLAN}, {R} SELECT model_alias, replicate, question_id FROM p ANTI JOIN (SELECT * FROM r WHERE status = 'ok') USING (model_alias, replicate, question_id)",
    "bench_validate": f"WITH {R}, k AS (SELECT run_id, {_KEYS}, count(*) AS n, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS err FROM r GROUP BY ALL) SELECT run_id, sum(n)::BIGINT AS raw_rows, count(*) FILTER (ok > 0) AS effective_ok, sum(greatest(0, ok - 1))::BIGINT AS surplus_ok, count(*) FILTER (err > 0 AND ok = 0) AS unresolved, count(DISTINCT model_alias) AS models, count(DISTINCT question_id) AS questions FROM k GROUP BY run_id",
    "bench_effective": f"WITH {R} SELECT {_KEYS}, record_id FROM r WHERE status = 'ok' QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY completed_at DESC NULLS LAST, record_id DESC) = 1",
    "bench_unresolved": f"WITH {R} SELECT {_KEYS} FROM r WHERE status = 'error' EXCEPT SELECT {_KEYS} FROM r WHERE status = 'ok'",
    "bench_progress": f"WITH {R} SELECT run_id, count(*) AS n, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS errors, max(completed_at) AS last_completed FROM r GROUP BY 1",
    "bench_leak_guard": "SELECT table_name AS source, lower(column_name) AS leaked FROM information_schema.columns WHERE table_name IN ('questions', 'chunks', 'vec_chunks') AND lower(column_name) IN ('gold_answer', 'acceptable_answer_variants', 'required_answer_elements', 'source_pdf_page', 'source_pdf_pages', 'printed_manual_page', 'printed_manual_pages', 'section', 'sections', 'paragraph', 'paragraphs', 'figure_or_table_id', 'required_evidence', 'critical_error_conditions', 'scoring_method', 'answerable', 'normative_type') UNION ALL SELECT 'rows', k FROM (SELECT DISTINCT unnest(['gold_answer', 'sections']) AS k FROM questions)",
    "ablation_matrix": "SELECT question_id, ablation, changed FROM questions CROSS JOIN (VALUES ('baseline', ''), ('A1_no_router', 'use_router'), ('A2_no_vlm_filter', 'use_filter'), ('A3_no_graph', 'w_graph'), ('A4_no_rule_type', 'w_ruletype'), ('A5_no_hierarchy', 'w_hierarchy'), ('A6_no_reranker', 'rerank')) a(ablation, changed)",
    "ablation_counts": f"WITH {R} SELECT prompt_style, model_alias, count(*) AS total, count(*) FILTER (error IS NULL) AS without_error, count(DISTINCT question_id) AS questions FROM r GROUP BY 1, 2",
    "problem_ids": f"WITH {R}, x AS (SELECT *, status <> 'ok' OR trim(coalesce(answer, ''), ' ') = '' OR starts_with(ltrim(coalesce(answer, ''), ' '), '### ') OR starts_with(lower(ltrim(coalesce(answer, ''), ' ')), '(vlm error:') OR starts_with(lower(ltrim(coalesce(answer, ''), ' ')), 'vlm error:') AS invalid, coalesce(contains(error, 'length'), false) AS cut FROM r) SELECT record_id, question_id, invalid, cut, regexp_extract(question_id, '^([A-Za-z]+)(\\d+)$', 1) AS prefix, regexp_extract(question_id, '^([A-Za-z]+)(\\d+)$', 2)::INT AS number FROM x WHERE invalid OR cut",
    "usage_extract": f"WITH {R} SELECT record_id, usage.input_tokens::BIGINT AS input_tokens, usage.output_tokens::BIGINT AS output_tokens FROM r",
    "filter_response_parse": f"WITH {R} SELECT record_id, CASE record_id % 3 WHEN 0 THEN [replicate, 3] WHEN 1 THEN [0, attempts] ELSE [] END AS kept FROM r",
    "figure_evidence": f"WITH {FIG}, t AS (SELECT *, coalesce(regexp_replace(title, '[\\s\\x{{85}}\\x{{2028}}\\x{{2029}}]+', ' ', 'g'), 'untitled') AS tt FROM f) SELECT figure_key, coalesce(sheet, 1) AS image_no, figure_id AS label, page_pdf AS page, trim(tt, ' ') AS description FROM t",
    "latency_by_model": f"WITH {R} SELECT model_alias, count(latency_ms) AS n, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, round(avg(latency_ms), 4) AS mean_ms FROM r GROUP BY 1",
    "upsert_last_wins": "SELECT id, payload.chunk_id AS chunk_id, upserted_at FROM vec_chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY upserted_at DESC) = 1",
    "incremental_missing": f"WITH {C} SELECT chunk_id FROM c WHERE chunk_id NOT IN (SELECT payload.chunk_id FROM vec_chunks WHERE len(dense) = 64 AND payload.chunk_id IS NOT NULL)",
    "embedding_join": f"WITH {FIG}, g AS (SELECT CAST(CAST('0x' || substr(sha1(manual || ':' || figure_id), 1, 16) AS UBIGINT) >> 1 AS BIGINT) AS id, figure_id, min(page_pdf) AS page, count(*) AS n_crops FROM f GROUP BY manual, figure_id) SELECT v.id, figure_id, page, n_crops FROM (SELECT DISTINCT id FROM vec_figures) v LEFT JOIN g USING (id)",
    "evidence_blocks": f"WITH {_EV} SELECT qid, sha256(evidence) AS evidence_sha, length(evidence)::INT AS n_chars FROM ev",
    "citation_whitelist": f"WITH {_EV} SELECT * FROM wl",
    "visual_lines": f"WITH {FIG} SELECT figure_key, '[Image ' || row_number() OVER (PARTITION BY manual, page_pdf ORDER BY figure_key) || '] ' || coalesce(figure_id, '?') || ' (p.' || coalesce(nullif(page_printed, ''), '?') || '): ' || substr(coalesce(caption, ''), 1, 160) AS line FROM f",
    "prompts": f"WITH {_EV} " + " UNION ALL ".join(f"SELECT qid, '{s}' AS style, sha256({_assembled(s)}) AS prompt_sha FROM ev JOIN wl USING (qid)" for s in prompt.STYLES),
    "page_records": f"WITH {C}, {FIG}, a AS (SELECT manual, page_pdf AS page, sum(length(text))::BIGINT AS n_chars, list_sort(list_distinct(flatten(list(coalesce(sign_codes, [])))))[1:50] AS sign_codes FROM c GROUP BY 1, 2), b AS (SELECT manual, page_pdf AS page, list_sort(list_distinct(list(caption) FILTER (kind = 'Figure')))[1:3] AS figure_captions, list_sort(list_distinct(list(caption) FILTER (kind = 'Table')))[1:3] AS table_titles FROM f GROUP BY 1, 2) SELECT manual, page, n_chars, sign_codes, coalesce(figure_captions, []) AS figure_captions, coalesce(table_titles, []) AS table_titles FROM a LEFT JOIN b USING (manual, page)",
    "query_types": f"SELECT question_id, {_any('question', lexical.VISUAL_TERMS)} AS visual, CASE WHEN {_any('question', lexical.SCENE_TERMS)} THEN 'VISUAL_SCENARIO' ELSE 'TEXTUAL' END AS kind, TRY_CAST(nullif(regexp_extract(question, '(?i)\\bpage\\s+(\\d{{1,4}})\\b', 1), '') AS INT) AS page FROM questions",
    "lexical_boost_topk": f"""WITH {_LEX}, q AS (SELECT question_id AS qid, regexp_extract(lower(question), '\\b([a-z]+ (?:sign|panel|line|marker|plaque|beacon))\\b', 1) AS term FROM questions), x AS (SELECT qid, section_id, score + CASE WHEN term <> '' AND contains(lower(title), term) THEN 0.20::DOUBLE ELSE 0 END AS s FROM lex JOIN q USING (qid) JOIN sec USING (section_id) WHERE rank <= 5)
SELECT qid, section_id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, section_id) AS rank, round(s, 6) AS score FROM x""",
    "fuse_pages": f"""WITH {_LEX}, q AS (SELECT question_id AS qid, question || CASE WHEN question_id LIKE '%0' THEN ' (page 120)' ELSE '' END AS query FROM questions), v AS (SELECT qid, TRY_CAST(nullif(regexp_extract(query, '(?i)\\bpage\\s+(\\d{{1,4}})\\b', 1), '') AS INT) AS p, {_any('query', lexical.VISUAL_TERMS)} AS visual FROM q),
u AS (SELECT qid, p AS page, 999.0::DOUBLE AS score, 0 AS tier, 0 AS seq FROM v WHERE p IS NOT NULL UNION ALL SELECT qid, p - 1, 997.0, 0, 1 FROM v WHERE p > 1 UNION ALL SELECT qid, p + 1, 997.0, 0, 2 FROM v WHERE p IS NOT NULL
UNION ALL SELECT qid, page, score, 1, rank FROM lex JOIN v USING (qid) WHERE rank <= 3 AND NOT visual UNION ALL SELECT qid, page, score, 2, row_number() OVER (PARTITION BY qid ORDER BY score DESC, page DESC, section_id) FROM lex),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY qid, page ORDER BY tier, seq) = 1) SELECT qid, page, row_number() OVER (PARTITION BY qid ORDER BY tier, seq) AS rank, round(score, 6) AS score FROM f QUALIFY rank <= 4""",
    "context_filter": f"WITH {_LEX}, x AS (SELECT qid, section_id, rank, contains(lower(title), 'sign') AND contains(lower(title), 'use') AS ok FROM lex JOIN sec USING (section_id)), y AS (SELECT *, bool_or(ok) OVER (PARTITION BY qid) AS any_ok FROM x) SELECT qid, section_id, rank FROM y WHERE ok OR (NOT any_ok AND rank <= 2)",
    "fallback_answer": f"""WITH {C}, s AS (SELECT DISTINCT manual, section_id, section_title, unnest(({_SENT})[1:8]) AS s FROM c), x AS (SELECT *, len(list_intersect(list_distinct(string_split_regex(lower(coalesce(section_title, '')), '[^a-z]+')), list_distinct(string_split_regex(lower(s), '[^a-z]+')))) AS score FROM s), y AS (SELECT *, row_number() OVER (PARTITION BY manual, section_id ORDER BY score DESC, s) AS rn FROM x QUALIFY rn <= 5)
SELECT manual, section_id, sha256(string_agg(s, ' ' ORDER BY rn)) AS answer_sha FROM y GROUP BY 1, 2""",
}
