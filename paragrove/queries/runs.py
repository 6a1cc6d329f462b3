"""Queries of benchmark runs, ablation sweeps, model replies and payloads. The model is a stub that the SQL can repeat."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paragrove.operators import content, evalrun
from paragrove.plans import runner
from paragrove.queries.text import FIG, figures
from paragrove.runtime import Shelf, table


def _models(spark, sf):
    """The model table, one row per model of the registry."""
    return tuple(r.asDict() for r in table(spark, sf, "models").select("alias", "selector", "provider", "enabled").orderBy("alias").collect())


def first_try(selector, question):
    n = len(selector) + len(question)
    if n % 7 == 0:
        raise RuntimeError("stopped with finish_reason=length")
    return " " if n % 11 == 0 else f"{selector} reads {len(question)} characters"


def second_try(selector, question):
    n = len(selector) + len(question)
    return f"{selector} again" if n % 2 == 0 else first_try(selector, question)


def bench_run(spark, sf):
    """Every record of a run of all models and questions, twice each, and of its resumption, which asks what failed again."""
    root, q = Shelf(spark).root, table(spark, sf, "questions")
    config = runner.RunConfig("run-1", _models(spark, sf), replicates=2, max_attempts=2)
    runner.run(q, config, first_try, root)
    out = runner.run(q, config, second_try, root)
    return out.select("model_alias", "replicate", "question_id", "status", "attempts", "answer", "error_type")


def bench_retry(spark, sf):
    """The records of a run over the questions that another run had problems with, under an id of its own."""
    root, q = Shelf(spark).root, table(spark, sf, "questions")
    config = runner.RunConfig("run-1", _models(spark, sf)[:1], max_attempts=1)
    runner.run(q, config, first_try, root)
    return runner.retry(q, config, "run-2", second_try, root).select("run_id", "question_id", "status", "answer")


def bench_throughput(spark, sf):
    r = table(spark, sf, "runs").dropDuplicates(["record_id"])
    planned = evalrun.plan(table(spark, sf, "models"), table(spark, sf, "questions"), 1)
    t = runner.throughput(r.withColumn("completed_at", F.col("completed_at").cast("timestamp")), planned)
    return t.select("run_id", "done", "left", F.round("per_minute", 6).alias("per_minute"), F.round("minutes_left", 4).alias("minutes_left"))


def run_problems(spark, sf):
    return runner.problems(table(spark, sf, "runs").dropDuplicates(["record_id"]))


def under_settings(settings, question):
    if len(question) % 13 == 0 and not settings.rerank:
        raise ValueError("no order")
    return f"{settings.use_router}|{settings.w_graph}|{settings.w_ruletype}|{settings.w_hierarchy}|{settings.use_filter}|{len(question)}"


def ablation_run(spark, sf):
    """Every question answered under every ablation's settings."""
    return runner.sweep(table(spark, sf, "questions"), under_settings, Shelf(spark).root).select("ablation", "question_id", "status", "answer", "error")


def ablation_package(spark, sf):
    return runner.package(runner.sweep(table(spark, sf, "questions"), under_settings, Shelf(spark).root)).drop("sha")


def figure_filter(spark, sf):
    """The figures of every manual's page, numbered, filtered by a reply."""
    f = figures(spark, sf).select(F.concat_ws("/", "manual", "page_pdf").alias("qid"), "figure_key", ((F.coalesce("image_path", F.lit("")) != "") & (F.col("figure_key") % 5 != 0)).alias("usable"))
    f = f.withColumn("pos", (F.row_number().over(Window.partitionBy("qid").orderBy("figure_key")) - 1).cast("int"))
    reply = F.when(F.length("qid") % 3 == 0, "[2, 0, 2, 9]").when(F.length("qid") % 3 == 1, "I keep [1] for you").otherwise("none")
    replies = f.select("qid").distinct().withColumn("reply", reply)
    return evalrun.usable_replies(f, replies, 2)


def response_errors(spark, sf):
    """What is wrong with every record's reply, by its answer and by its error text."""
    r = table(spark, sf, "runs").dropDuplicates(["record_id"])
    stop = F.when(F.col("record_id") % 10 == 0, "max_tokens").when(F.col("record_id") % 10 == 1, "refusal")
    return r.select("record_id", evalrun.response_error(F.col("answer"), stop).alias("reply"), evalrun.error_type(F.col("error")).alias("error_type"))


def nested_content(spark, sf):
    """Answers wrapped in contents of blocks, read again; a thinking block, a nested one and a bare string."""
    r = table(spark, sf, "runs").dropDuplicates(["record_id"]).select("record_id", F.trim(F.regexp_replace(F.coalesce("answer", F.lit("")), r"^\s+|\s+$", "")).alias("a"))
    think, plain = F.struct(F.lit("thinking").alias("type"), F.lit("hm").alias("text")), F.struct(F.lit("text").alias("type"), F.col("a").alias("text"))
    deep = F.struct(F.lit("output").alias("type"), F.array(F.struct(F.struct(F.col("a").alias("value")).alias("text"))).alias("content"))
    three = F.col("record_id") % 3
    c = F.when(three == 0, F.to_json(F.array(think, plain))).when(three == 1, F.to_json(deep)).otherwise(F.to_json(F.struct(F.struct(F.col("a").alias("Final_Answer")).alias("result"))))
    r = r.withColumn("c", c)
    got = F.when(three == 2, content.value_under(F.col("c"), ("answer", "final_answer"))).otherwise(content.text_of(F.col("c")))
    return r.select("record_id", F.sha2(got, 256).alias("sha"), content.block_types(F.col("c")).alias("types"))


def payload_sizes(spark, sf):
    """Bytes of a request per page with its images (their sizes are made up from the keys), and their media types."""
    f = figures(spark, sf).select("manual", "page_pdf", "figure_key", "image_path", (F.col("figure_key") % 1000).alias("bytes"))
    per = f.groupBy("manual", "page_pdf").agg(F.collect_list("bytes").alias("sizes"), F.min("image_path").alias("first_path"))  # the images of one page
    return per.select("manual", "page_pdf", content.payload_bytes(F.col("manual"), F.col("sizes")).alias("n_bytes"), content.media_type(F.col("first_path")).alias("media_type"))


def display_dedup(spark, sf):
    """Display outputs are the answers of a question in a run, in order of their record ids; repeated ones are dropped."""
    r = table(spark, sf, "runs").dropDuplicates(["record_id"])
    return content.distinct_displays(r, ["run_id", "question_id"], "record_id", "answer").select("run_id", "question_id", "record_id")


QUERIES = {f.__name__: f for f in (bench_run, bench_retry, bench_throughput, run_problems, ablation_run, ablation_package, figure_filter, response_errors, nested_content, payload_sizes, display_dedup)}

_R = "r AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY started_at) = 1)"
_CALLS = "c AS (SELECT alias AS model_alias, selector, question_id, question, length(selector) + length(question) AS n FROM (SELECT alias, coalesce(selector, alias) AS selector FROM models WHERE enabled) CROSS JOIN questions)"
_FIRST = "CASE WHEN n % 7 = 0 THEN 'truncated' WHEN n % 11 = 0 THEN 'empty' END"
_TYPE = r"CASE WHEN error IS NULL THEN NULL WHEN regexp_matches(error, '(?i)empty|no text|no completion') THEN 'empty' WHEN regexp_matches(error, '(?i)max_tokens|finish_reason=.?length|stop_reason=.?length|context_window|truncat|token limit') THEN 'truncated' WHEN regexp_matches(error, '(?i)refus|declin|content.?filter|safety|blocked') THEN 'refusal' WHEN regexp_matches(error, '(?i)time[d ]?.?out') THEN 'timeout' WHEN regexp_matches(error, '(?i)rate.?limit|quota|429') THEN 'rate_limit' ELSE 'other' END"
_BAD = "status <> 'ok' OR trim(coalesce(answer, ''), ' ') = '' OR starts_with(ltrim(coalesce(answer, ''), ' '), '### ') OR starts_with(lower(ltrim(coalesce(answer, ''), ' ')), '(vlm error:') OR starts_with(lower(ltrim(coalesce(answer, ''), ' ')), 'vlm error:')"
_SWEEP = """a(ablation, r, g, t, h, f, k) AS (VALUES ('baseline', 'True', '0.4', '0.3', '0.2', 'True', true), ('A1_no_router', 'False', '0.4', '0.3', '0.2', 'True', true), ('A2_no_vlm_filter', 'True', '0.4', '0.3', '0.2', 'False', true), ('A3_no_graph', 'True', '0.0', '0.3', '0.2', 'True', true), ('A4_no_rule_type', 'True', '0.4', '0.0', '0.2', 'True', true), ('A5_no_hierarchy', 'True', '0.4', '0.3', '0.0', 'True', true), ('A6_no_reranker', 'True', '0.4', '0.3', '0.2', 'True', false)),
w AS (SELECT ablation, question_id, NOT (length(question) % 13 = 0 AND NOT k) AS ok, r || '|' || g || '|' || t || '|' || h || '|' || f || '|' || length(question) AS answer FROM questions CROSS JOIN a)"""
ORACLE = {
    "bench_run": f"""WITH {_CALLS}, x AS (SELECT *, {_FIRST} AS bad FROM c), u AS (SELECT model_alias, question_id, CASE WHEN bad IS NULL THEN 'ok' ELSE 'error' END AS status, CASE WHEN bad IS NULL THEN 1 ELSE 2 END AS attempts, CASE WHEN bad IS NULL THEN selector || ' reads ' || length(question) || ' characters' END AS answer, bad AS error_type FROM x
UNION ALL SELECT model_alias, question_id, CASE WHEN n % 2 = 0 THEN 'ok' ELSE 'error' END, CASE WHEN n % 2 = 0 THEN 1 ELSE 2 END, CASE WHEN n % 2 = 0 THEN selector || ' again' END, CASE WHEN n % 2 = 1 THEN bad END FROM x WHERE bad IS NOT NULL) SELECT model_alias, replicate, question_id, status, attempts, answer, error_type FROM u CROSS JOIN (SELECT unnest([1, 2]) AS replicate)""",
    "bench_retry": f"""WITH {_CALLS}, x AS (SELECT *, {_FIRST} AS bad FROM c WHERE model_alias = (SELECT min(alias) FROM models)) SELECT 'run-2' AS run_id, question_id, CASE WHEN n % 2 = 0 THEN 'ok' ELSE 'error' END AS status, CASE WHEN n % 2 = 0 THEN selector || ' again' END AS answer FROM x WHERE bad IS NOT NULL""",
    "bench_throughput": f"""WITH {_R}, p AS (SELECT (SELECT count(*) FROM models WHERE enabled) * (SELECT count(*) FROM questions) AS n), t AS (SELECT run_id, count(DISTINCT (model_alias, question_id, replicate)) AS done, epoch(max(completed_at)) - epoch(min(completed_at)) AS s FROM r GROUP BY 1)
SELECT run_id, done, greatest(0, n - done) AS left, round(CASE WHEN s > 0 THEN done / s * 60 END, 6) AS per_minute, round(greatest(0, n - done) / CASE WHEN s > 0 THEN done / s * 60 END, 4) AS minutes_left FROM t, p""",
    "run_problems": f"WITH {_R}, k AS (SELECT model_alias, question_id, replicate, bool_or({_BAD}) AS invalid, bool_or(coalesce({_TYPE} = 'truncated', false)) AS cut, bool_and(status <> 'ok') AS unresolved FROM r GROUP BY 1, 2, 3), g AS (SELECT question_id, bool_or(invalid) AS invalid, bool_or(cut) AS cut, bool_or(unresolved) AS unresolved FROM k GROUP BY 1) SELECT * FROM g WHERE invalid OR cut OR unresolved",
    "ablation_run": f"WITH {_SWEEP} SELECT ablation, question_id, CASE WHEN ok THEN 'ok' ELSE 'error' END AS status, CASE WHEN ok THEN answer END AS answer, CASE WHEN NOT ok THEN 'ValueError: no order' END AS error FROM w",
    "ablation_package": f"WITH {_SWEEP} SELECT ablation, count(*) AS total, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS errors, coalesce(sum(length(answer)) FILTER (ok), 0)::BIGINT AS answer_chars FROM w GROUP BY 1",
    "figure_filter": f"""WITH {FIG}, k AS (SELECT manual || '/' || page_pdf AS qid, coalesce(image_path, '') <> '' AND figure_key % 5 <> 0 AS usable, (row_number() OVER (PARTITION BY manual, page_pdf ORDER BY figure_key) - 1)::INT AS pos FROM f), u AS (SELECT qid, pos, count(*) OVER (PARTITION BY qid) AS n, CASE length(qid) % 3 WHEN 0 THEN [2, 0, 9] WHEN 1 THEN [1] ELSE [] END AS reply FROM k WHERE usable),
v AS (SELECT *, nullif(list_position(reply, pos), 0) AS spot FROM u), w AS (SELECT *, bool_or(spot IS NOT NULL) OVER (PARTITION BY qid) AS named FROM v) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN n <= 2 OR spot IS NULL THEN pos ELSE spot END, pos) AS rank, pos FROM w WHERE n <= 2 OR NOT named OR spot IS NOT NULL QUALIFY rank <= 2""",
    "response_errors": f"WITH {_R} SELECT record_id, CASE WHEN record_id % 10 = 0 THEN 'truncated' WHEN record_id % 10 = 1 THEN 'refusal' WHEN trim(coalesce(answer, ''), ' ') = '' THEN 'empty' END AS reply, {_TYPE} AS error_type FROM r",
    "nested_content": f"WITH {_R}, t AS (SELECT record_id, regexp_replace(coalesce(answer, ''), '^\\s+|\\s+$', '', 'g') AS a FROM r) SELECT record_id, sha256(CASE WHEN record_id % 3 < 2 THEN regexp_replace(a, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g') ELSE a END) AS sha, CASE record_id % 3 WHEN 0 THEN ['thinking', 'text'] ELSE ['string'] END AS types FROM t",
    "payload_sizes": f"WITH {FIG} SELECT manual, page_pdf, strlen(manual) + sum(4 * ((figure_key % 1000 + 2) // 3))::BIGINT AS n_bytes, CASE WHEN lower(min(image_path)) LIKE '%.jpg' OR lower(min(image_path)) LIKE '%.jpeg' THEN 'image/jpeg' WHEN lower(min(image_path)) LIKE '%.webp' THEN 'image/webp' WHEN lower(min(image_path)) LIKE '%.gif' THEN 'image/gif' ELSE 'image/png' END AS media_type FROM f GROUP BY 1, 2",
    "display_dedup": f"WITH {_R} SELECT run_id, question_id, min(record_id) AS record_id FROM r GROUP BY run_id, question_id, answer",
}
