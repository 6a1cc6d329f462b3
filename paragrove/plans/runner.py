"""Benchmark runs and ablation sweeps: planned calls, an append-only log, resuming, retries and reports.

A run is a set of keyed calls. Calls without a successful record are answered in parallel tasks and appended to one Parquet log,
successes and errors alike; what holds of a run is read from the log. Configurations are values; nothing is a global.
"""

from __future__ import annotations

import platform
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paragrove.operators import evalrun
from paragrove.operators.evalrun import ABLATIONS, Settings
from paragrove.sources import files

RUN_ID = re.compile(r"[A-Za-z0-9._-]+")
LOG = "run_id string, model_alias string, selector string, replicate int, question_id string, question string, question_index int, prompt_style string, seed bigint, answer string, status string, attempts int, error string, error_type string, answer_sha256 string, completed_at timestamp"


@dataclass(frozen=True)
class Model:
    """One model of a run."""

    alias: str
    selector: str
    provider: str | None = None
    enabled: bool = True
    metadata: dict = field(default_factory=dict)


def model_of(value) -> Model:
    """A Model from a name or a mapping (selector, else model_id, else alias); ValueError without any, TypeError for other values."""
    if isinstance(value, Model):
        return value
    if isinstance(value, str):
        value = {"alias": value}
    if not isinstance(value, Mapping):
        raise TypeError(f"no model: {type(value).__name__}")
    names = [str(value.get(k) or "").strip() for k in ("selector", "model_id", "alias")]
    selector = next((n for n in names if n), "")
    if not selector:
        raise ValueError("a model needs a selector, model_id or alias")
    return Model(names[2] or selector, selector, value.get("provider"), bool(value.get("enabled", True)), dict(value.get("metadata") or {}))


@dataclass(frozen=True)
class RunConfig:
    """What a run does; checked when it is made."""

    run_id: str
    models: tuple = ()
    prompt_style: str = "fewshot"
    replicates: int = 1
    max_questions: int | None = None
    question_ids: tuple[str, ...] | None = None
    max_attempts: int = 3
    retry_base_seconds: float = 0.0
    inter_request_seconds: float = 0.0
    seed: int = 20260710
    resume: bool = True
    rerun_errors: bool = True

    def __post_init__(self):
        object.__setattr__(self, "models", tuple(model_of(m) for m in self.models))
        wrong = [
            (not RUN_ID.fullmatch(self.run_id or ""), "run_id may have letters, digits, '.', '_' and '-' alone"), (self.replicates < 1, "replicates must be at least 1"),
            (self.max_attempts < 1, "max_attempts must be at least 1"), (self.max_questions is not None and self.max_questions < 1, "max_questions must be positive"), (not self.models, "no models"),
            (min(self.retry_base_seconds, self.inter_request_seconds) < 0, "seconds must not be negative")]
        for bad, why in wrong:
            if bad:
                raise ValueError(why)


def read_config(text: str) -> dict:
    """Flat 'name: value' lines as values: numbers, true and false, null, else strings; blank lines and comments are skipped."""
    words = {"true": True, "false": False, "null": None, "~": None, "": None}
    out = {}
    for line in text.splitlines():
        name, mark, value = re.sub(r"(?:^|\s)#.*$", "", line).strip().partition(":")
        if mark:
            value = value.strip().strip("'\"")
            out[name.strip()] = words[value.lower()] if value.lower() in words else float(value) if re.fullmatch(r"-?\d*\.\d+", value) else int(value) if re.fullmatch(r"-?\d+", value) else value
    return out


def pick(questions: DataFrame, ids: tuple[str, ...] | None = None, most: int | None = None) -> DataFrame:
    """The questions of the given ids, the first `most` by id; ValueError names ids that do not exist."""
    if ids is not None:
        wanted = questions.sparkSession.createDataFrame([(i,) for i in sorted(set(ids))], "question_id string")
        unknown = [r.question_id for r in wanted.join(questions.select("question_id"), "question_id", "left_anti").collect()]
        if unknown:
            raise ValueError(f"unknown question ids: {', '.join(sorted(unknown))}")
        questions = questions.join(F.broadcast(wanted), "question_id", "left_semi")
    return questions if most is None else questions.orderBy("question_id").limit(most)


def calls(questions: DataFrame, config: RunConfig) -> DataFrame:
    """The calls of a run: model_alias, selector, replicate, question_id, question, question_index."""
    models = [(m.alias, m.selector, True) for m in config.models if m.enabled]
    df = questions.sparkSession.createDataFrame(models, "alias string, selector string, enabled boolean")
    return evalrun.plan(df, pick(questions, config.question_ids, config.max_questions), config.replicates)


def log(spark: SparkSession, root: str) -> DataFrame:
    """All records of all runs; empty where nothing was run yet."""
    return files.table_or_empty(spark, f"{root}/records", LOG)


def run(questions: DataFrame, config: RunConfig, ask: Callable[[str, str], str], root: str) -> DataFrame:
    """The records of the run after answering what it lacks: ask(selector, question) in tasks, with retries; appended to the log under root.

    With resume, calls with a successful record are not asked again, and those with an error only if rerun_errors; without it
    all are. Questions with keys that would leak expected answers raise a ValueError.
    """
    spark = questions.sparkSession
    leaks = evalrun.leaked(questions)
    if leaks:
        raise ValueError(f"question columns would leak answers: {', '.join(leaks)}")
    todo = calls(questions, config)
    old = log(spark, root).where(F.col("run_id") == config.run_id)
    if config.resume:
        done = old if not config.rerun_errors else old.where("status = 'ok'")
        todo = todo.join(done.select(*evalrun.KEYS).distinct(), evalrun.KEYS, "left_anti")
    answered = evalrun.answer_all(todo, ask, config.max_attempts, config.retry_base_seconds, config.inter_request_seconds, config.seed)
    kind = evalrun.error_type(F.col("error"))
    rows = answered.select(F.lit(config.run_id).alias("run_id"), "model_alias", "selector", F.col("replicate").cast("int").alias("replicate"), "question_id", "question", F.col("question_index").cast("int").alias("question_index"), F.lit(config.prompt_style).alias("prompt_style"),
                           F.lit(config.seed).cast("bigint").alias("seed"), "answer", "status", "attempts", "error", kind.alias("error_type"), F.sha2("answer", 256).alias("answer_sha256"), F.current_timestamp().alias("completed_at"))
    rows.write.mode("append").option("compression", "zstd").parquet(f"{root}/records")
    return log(spark, root).where(F.col("run_id") == config.run_id)


def keep_successful(spark: SparkSession, root: str) -> None:
    """Rewrite the log without error records: written beside it, then put in its place."""
    kept = log(spark, root).where("status = 'ok'")
    kept.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/records.new")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path(f"{root}/records"), True)
    fs.rename(path(f"{root}/records.new"), path(f"{root}/records"))
    spark.catalog.refreshByPath(f"{root}/records")


def problems(records: DataFrame) -> DataFrame:
    """question_id, invalid, cut, unresolved of the questions of a run that need another try, in natural order of their ids (letters, then number).

    invalid: a record failed, is empty, a bare heading or an error text. cut: a record stopped at a token limit. unresolved: a
    call has errors and no success.
    """
    a = F.coalesce("answer", F.lit(""))
    bad = (F.col("status") != "ok") | (F.trim(a) == "") | F.ltrim(a).startswith("### ") | evalrun.error_text(a)
    call = records.groupBy(*evalrun.KEYS).agg(F.bool_or(bad).alias("invalid"), F.bool_or(F.coalesce(evalrun.error_type(F.col("error")) == "truncated", F.lit(False))).alias("cut"), (F.bool_and(F.col("status") != "ok")).alias("unresolved"))
    out = call.groupBy("question_id").agg(*[F.bool_or(c).alias(c) for c in ("invalid", "cut", "unresolved")]).where("invalid OR cut OR unresolved")
    return out.orderBy(F.regexp_extract("question_id", r"^([A-Za-z]*)", 1), F.regexp_extract("question_id", r"(\d+)", 1).try_cast("bigint"), "question_id")


def retry(questions: DataFrame, config: RunConfig, new_id: str, ask, root: str) -> DataFrame:
    """A run under a new id over the questions of an old one that need another try; its records. None left gives no records."""
    bad = tuple(r.question_id for r in problems(log(questions.sparkSession, root).where(F.col("run_id") == config.run_id)).select("question_id").collect())  # at most the question set
    again = replace(config, run_id=new_id, question_ids=bad, max_questions=None)
    return run(questions, again, ask, root) if bad else log(questions.sparkSession, root).limit(0)


def manifest(records: DataFrame, config: RunConfig) -> dict:
    """What a run was and how far it is, as one document."""
    n = records.agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("errors"), F.countDistinct("question_id").alias("questions")).head()
    shown = {f.name: getattr(config, f.name) for f in fields(config) if f.name != "models"}
    return {**shown, "models": [m.alias for m in config.models], "counts": n.asDict(), "runtime": runtime()}


def runtime() -> dict:
    """Versions of what runs."""
    import numpy
    import pyarrow
    import pyspark

    return {"python": platform.python_version(), "spark": pyspark.__version__, "arrow": pyarrow.__version__, "numpy": numpy.__version__, "system": platform.system()}


def throughput(records: DataFrame, planned: DataFrame) -> DataFrame:
    """run_id, done, left, seconds, per_minute, minutes_left; null rates where all records have one time."""
    n = planned.count()
    t = records.groupBy("run_id").agg(F.countDistinct(*evalrun.KEYS).alias("done"), (F.max("completed_at").cast("double") - F.min("completed_at").cast("double")).alias("seconds"))
    rate = F.when(F.col("seconds") > 0, F.col("done") / F.col("seconds") * 60)
    left = F.greatest(F.lit(0), F.lit(n) - F.col("done"))
    return t.select("run_id", "done", left.alias("left"), "seconds", rate.alias("per_minute"), (left / rate).alias("minutes_left"))


SWEEP = "ablation string, question_id string, question string, prompt_style string, answer string, status string, attempts int, error string, retrieval_only boolean"


def verified(name: str, base: Settings = Settings()) -> Settings:
    """The settings of an ablation, checked to differ from the base in what it changes and in nothing else."""
    out, changed = evalrun.ablated(base, name), ABLATIONS[name]
    for f in fields(out):
        if getattr(out, f.name) != changed.get(f.name, getattr(base, f.name)):
            raise RuntimeError(f"{name}: {f.name} is not as the ablation sets it")
    return out


def sweep(questions: DataFrame, ask: Callable[[Settings, str], str], root: str, ablations: tuple[str, ...] = tuple(ABLATIONS), prompt_style: str = "fewshot", limit: int | None = None, attempts: int = 1, retrieval_only: bool = False) -> DataFrame:
    """Every question under every ablation, once successfully: the records of the sweep, appended to one log under root.

    ask(settings, question) runs in tasks. Pairs with a success are not asked again, so finished ablations are skipped; errors
    are tried again and their old records dropped from what is returned. An unknown ablation raises KeyError. limit: as a
    sweep's option, the first so many questions. retrieval_only: ask's result is no answer but a description of the retrieval.
    """
    spark = questions.sparkSession
    settings = {a: verified(a) for a in ablations}
    names = spark.createDataFrame([(a,) for a in ablations], "selector string")
    old = files.table_or_empty(spark, f"{root}/sweep", SWEEP)
    planned = pick(questions, None, limit).select("question_id", "question").join(F.broadcast(names), F.lit(True))  # ablations, a handful
    todo = planned.join(old.where("status = 'ok'").select(F.col("ablation").alias("selector"), "question_id").distinct(), ["selector", "question_id"], "left_anti")
    answered = evalrun.answer_all(todo.select("selector", "question_id", "question"), lambda a, q: ask(settings[a], q), attempts)
    rows = answered.select(F.col("selector").alias("ablation"), "question_id", "question", F.lit(prompt_style).alias("prompt_style"), "answer", "status", "attempts", "error", F.lit(retrieval_only).alias("retrieval_only"))
    rows.write.mode("append").option("compression", "zstd").parquet(f"{root}/sweep")
    every = files.table_or_empty(spark, f"{root}/sweep", SWEEP)
    w = Window.partitionBy("ablation", "question_id").orderBy((F.col("status") == "ok").desc(), F.col("attempts").desc())
    return every.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def unfinished(records: DataFrame, questions: DataFrame, ablations: tuple[str, ...] = tuple(ABLATIONS)) -> list[str]:
    """The ablations that lack a success for some question, in their order."""
    n = questions.select("question_id").distinct().count()
    done = {r.ablation for r in records.where("status = 'ok'").groupBy("ablation").agg(F.countDistinct("question_id").alias("n")).where(F.col("n") >= n).collect()}  # a handful
    return [a for a in ablations if a not in done]


def package(records: DataFrame) -> DataFrame:
    """ablation, total, ok, errors, answer_chars, sha: what a package of a sweep states; sha is over the sorted answers' hashes."""
    one = F.sha2(F.concat_ws("|", "question_id", F.coalesce("answer", F.lit(""))), 256)
    return records.groupBy("ablation").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("errors"), F.coalesce(F.sum(F.length("answer")), F.lit(0)).alias("answer_chars"),
                                          F.sha2(F.array_join(F.array_sort(F.collect_list(one)), ""), 256).alias("sha"))  # as many as questions
