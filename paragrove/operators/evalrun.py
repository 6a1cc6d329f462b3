"""Evaluation runs: planning, resuming, validating and comparing sets of keyed answer records."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paragrove.runtime import broadcast_if_small

KEYS = ["model_alias", "question_id", "replicate"]
#: Keys that hold expected answers and must not reach a run.
LEAK_KEYS = (
    "gold_answer", "acceptable_answer_variants", "required_answer_elements", "source_pdf_page", "source_pdf_pages", "printed_manual_page", "printed_manual_pages", "section", "sections",
    "paragraph", "paragraphs", "figure_or_table_id", "required_evidence", "critical_error_conditions", "scoring_method", "answerable", "normative_type")
#: An Answer section of rendered Markdown, one on standard output, and how the ways to an answer are called.
ANSWER_SECTION = r"(?is)(?:^|\n)\s*#{2,4}\s*Answer\s*\n(.*?)(?=\n\s*#{2,4}\s*(?:Figures?|Retrieved|Debug|Context|Evidence)\b|\z)"
STDOUT_SECTION = r"(?is)(?:^|\n)\s*(?:answer|final answer)\s*[:\n]\s*(.*?)(?=\n\s*(?:retrieval|debug|figures?|context)\s*[:\n]|\z)"
METHODS = ("display_markdown_answer_section", "return_string", "nested_return_key", "stdout_answer_section", "not_found")
REQUIRED = ("run_id", "model_alias", "model_id", "question_id", "question", "replicate", "status", "answer")


@dataclass(frozen=True)
class Settings:
    """What an ablation may change; a new value, never a shared mutable one."""

    use_router: bool = True
    use_filter: bool = True
    w_graph: float = 0.4
    w_ruletype: float = 0.3
    w_hierarchy: float = 0.2
    rerank: bool = True
    extra: dict = field(default_factory=dict)


#: Ablations: name -> changed settings.
ABLATIONS = {"baseline": {}, "A1_no_router": {"use_router": False}, "A2_no_vlm_filter": {"use_filter": False}, "A3_no_graph": {"w_graph": 0.0}, "A4_no_rule_type": {"w_ruletype": 0.0}, "A5_no_hierarchy": {"w_hierarchy": 0.0}, "A6_no_reranker": {"rerank": False}}


def ablated(base: Settings, name: str) -> Settings:
    """The settings of an ablation; an unknown name raises KeyError."""
    return replace(base, **ABLATIONS[name])


def plan(models: DataFrame, questions: DataFrame, replicates: int = 1) -> DataFrame:
    """The calls of a run: every enabled model, replicate and question, with its position in the selected set.

    This product is the definition of a run and grows with the number of calls, not with the data.
    """
    picked = questions.withColumn("question_index", F.row_number().over(Window.orderBy("question_id")))
    m = models.where("enabled").select(F.col("alias").alias("model_alias"), "selector", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    return m.join(broadcast_if_small(picked.select("question_id", "question", "question_index")), F.lit(True))


def resume(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Planned calls without a successful record; errors do not complete a key."""
    return planned.join(done.where("status = 'ok'").select(*KEYS).distinct(), KEYS, "left_anti")


def effective(records: DataFrame) -> DataFrame:
    """The latest successful record of every key."""
    w = Window.partitionBy(*KEYS).orderBy(F.col("completed_at").desc_nulls_last(), F.col("record_id").desc())
    return records.where("status = 'ok'").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def validation(records: DataFrame) -> DataFrame:
    """One row per run: raw rows, keys with success, surplus successes, errors without success, models, questions."""
    key = records.groupBy("run_id", *KEYS).agg(F.count("*").alias("n"), F.sum((F.col("status") == "ok").cast("bigint")).alias("ok"), F.sum((F.col("status") == "error").cast("bigint")).alias("err"))
    return key.groupBy("run_id").agg(
        F.sum("n").alias("raw_rows"), F.sum((F.col("ok") > 0).cast("bigint")).alias("effective_ok"), F.sum(F.greatest(F.lit(0), F.col("ok") - 1)).alias("surplus_ok"),
        F.sum(((F.col("err") > 0) & (F.col("ok") == 0)).cast("bigint")).alias("unresolved"), F.countDistinct("model_alias").alias("models"), F.countDistinct("question_id").alias("questions"))


def missing_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> list[str]:
    """Required columns that a table lacks."""
    return [c for c in required if c not in df.columns]


def leaked(df: DataFrame, allowed: tuple[str, ...] = ()) -> list[str]:
    """Columns of a question table that would leak expected answers."""
    return sorted({c.lower() for c in df.columns} & set(LEAK_KEYS) - set(allowed))


def leaked_rows(rows: DataFrame, column: str) -> DataFrame:
    """rows with key for every top-level key of a JSON object that would leak expected answers; rows without one are left out."""
    keys = F.transform(F.json_object_keys(column), lambda k: F.lower(k))
    return rows.withColumn("key", F.explode(F.array_distinct(F.array_intersect(keys, F.array(*[F.lit(k) for k in LEAK_KEYS])))))


def error_text(answer: Column) -> Column:
    """Whether an answer is the error string of the model layer."""
    low = F.lower(F.ltrim(answer))
    return low.startswith("(vlm error:") | low.startswith("vlm error:")


def answer_section(markdown: Column) -> Column:
    """The text under an Answer heading of rendered Markdown; null if there is none."""
    hit = F.regexp_extract(markdown, ANSWER_SECTION, 1)
    return F.nullif(F.trim(hit), F.lit(""))


def extract_answer(markdown: Column, returned: Column, stdout: Column, nested: Column | None = None) -> Column:
    """struct(answer, method): the Answer section, else the returned string, else a nested value, else an answer heading on stdout, else empty."""
    printed = F.regexp_extract(stdout, STDOUT_SECTION, 1)
    ways = [F.nullif(F.trim(c), F.lit("")) for c in (answer_section(markdown), returned, F.lit(None).cast("string") if nested is None else nested, printed)]
    method = F.lit(METHODS[-1])
    for way, name in reversed(list(zip(ways, METHODS))):
        method = F.when(way.isNotNull(), name).otherwise(method)
    return F.struct(F.coalesce(*ways, F.lit("")).alias("answer"), method.alias("method"))


def filter_reply(reply: Column) -> Column:
    """The indices of a filter reply: a JSON list, else the first bracketed list of numbers, else none."""
    whole = F.from_json(F.trim(reply), "array<double>")
    part = F.from_json(F.regexp_extract(reply, r"\[[\s\d,]*\]", 0), "array<double>")
    return F.transform(F.filter(F.coalesce(whole, part, F.array().cast("array<double>")), lambda x: x.isNotNull()), lambda x: x.cast("int"))


def figure_evidence(markdown: DataFrame, key: str, column: str) -> DataFrame:
    """key, image_no, label, page, description of every '**[Image n]** label (p.N) — text' line."""
    line = r"^\s*\*\*\[Image\s+(\d+)\]\*\*\s*(.*)$"
    rows = markdown.select(key, F.explode(F.split(column, "\n")).alias("line")).where(F.col("line").rlike("(?i)" + line))
    part = lambda i: F.trim(F.regexp_extract("line", "(?i)" + line, i))
    cut = r"^(.*?)\s+(?:—|–|-)\s+(.*)$"
    rows = rows.select(key, part(1).cast("int").alias("image_no"), part(2).alias("rest"))
    left = F.when(F.col("rest").rlike(cut), F.regexp_extract("rest", cut, 1)).otherwise(F.col("rest"))
    rows = rows.withColumns({"left": left, "description": F.when(F.col("rest").rlike(cut), F.regexp_extract("rest", cut, 2)).otherwise("")})
    page = r"(?i)\s*\(p\.\s*(\d+)\)\s*$"
    return rows.select(key, "image_no", F.trim(F.regexp_replace("left", page, "")).alias("label"), F.nullif(F.regexp_extract("left", page, 1), F.lit("")).cast("int").alias("page"), F.trim("description").alias("description"))


#: Why a model stops at a limit.
STOPPED = ("length", "max_tokens", "model_context_window_exceeded")
#: What an error is, by what its text contains; the first that holds.
ERROR_TYPES = {"empty": r"(?i)empty|no text|no completion", "truncated": r"(?i)max_tokens|finish_reason=.?length|stop_reason=.?length|context_window|truncat|token limit", "refusal": r"(?i)refus|declin|content.?filter|safety|blocked", "timeout": r"(?i)time[d ]?.?out", "rate_limit": r"(?i)rate.?limit|quota|429"}


def error_type(error: Column) -> Column:
    """The type of an error by its text: one of ERROR_TYPES, else 'other'; null without an error."""
    out = F.when(error.isNull(), F.lit(None).cast("string"))
    for name, pattern in ERROR_TYPES.items():
        out = out.when(error.rlike(pattern), name)
    return out.otherwise("other")


def response_error(text: Column, stop_reason: Column) -> Column:
    """What is wrong with a model's reply: 'truncated' where it stopped at a limit, 'refusal', 'empty' without text, null if nothing."""
    why = F.lower(F.trim(F.coalesce(stop_reason, F.lit(""))))
    return F.when(why.isin(*STOPPED), "truncated").when(why == "refusal", "refusal").when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty")


def backoff(base: float, attempt: int, spread: float) -> float:
    """Seconds before the next attempt: doubled every time, plus a part of a second."""
    return base * 2 ** (attempt - 1) + spread


def answer_all(calls: DataFrame, ask: Callable[[str, str], str], attempts: int = 3, base_delay: float = 0.0, pace: float = 0.0, seed: int = 0) -> DataFrame:
    """calls with answer, status, attempts and error: the pluggable model stage, with retries, backoff and pacing in the task.

    ask(selector, question) returns the answer or raises; an empty answer counts as a failure. pace: seconds between the calls
    of one task. seed: of the jitter of the backoff.
    """
    schema = T.StructType([*calls.schema.fields, T.StructField("answer", T.StringType()), T.StructField("status", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("error", T.StringType())])

    def run(batches):
        jitter = random.Random(seed)
        for b in batches:
            out = {"answer": [], "status": [], "attempts": [], "error": []}
            for selector, question in zip(b.column("selector").to_pylist(), b.column("question").to_pylist()):
                answer, error, n = None, None, 0
                for n in range(1, attempts + 1):
                    try:
                        answer = ask(selector, question)
                        if answer and answer.strip():
                            error = None
                            break
                        error = "empty answer"
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                    if base_delay and n < attempts:
                        time.sleep(backoff(base_delay, n, jitter.random()))
                if pace:
                    time.sleep(pace)
                for k, v in zip(out, (None if error else answer, "error" if error else "ok", n, error)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out["answer"], pa.string()), pa.array(out["status"], pa.string()), pa.array(out["attempts"], pa.int32()), pa.array(out["error"], pa.string())], names=[*b.schema.names, *out])

    return calls.mapInArrow(run, schema)


def usable_replies(candidates: DataFrame, replies: DataFrame, most: int = 4) -> DataFrame:
    """qid, rank, pos: the figures that a filter keeps, at most `most` of each query.

    candidates: qid, pos (as numbered in the filter's prompt), usable (whether there is an image); replies: qid, reply. Up to
    `most` usable candidates are all kept in order; else the reply's indices that are usable, in its order, first mention only;
    a query whose reply names none keeps its first ones.
    """
    use = candidates.where("usable").select("qid", "pos")
    n = use.groupBy("qid").agg(F.count("*").alias("n"))
    named = replies.select("qid", F.posexplode(filter_reply(F.col("reply"))).alias("at", "pos")).groupBy("qid", "pos").agg(F.min("at").alias("at"))
    chosen = use.join(n, "qid").join(named, ["qid", "pos"], "left").withColumn("any", F.max(F.col("at").isNotNull()).over(Window.partitionBy("qid")))
    chosen = chosen.where((F.col("n") <= most) | ~F.col("any") | F.col("at").isNotNull())
    order = F.when((F.col("n") <= most) | F.col("at").isNull(), F.col("pos")).otherwise(F.col("at"))
    return chosen.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(order, "pos"))).where(F.col("rank") <= most).select("qid", "rank", "pos")
