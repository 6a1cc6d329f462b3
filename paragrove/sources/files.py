"""Sources and sinks: JSON lines with contracts and evolving schemas, XML lines, page texts, checked files, keyed tables."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "chunk_id string, part string, chapter string, section_id string, section_title string, content_type string, ordinal int, page_pdf int, page_printed string, text string, figure_refs array<string>, table_refs array<string>, section_refs array<string>, sign_codes array<string>, modal_verbs array<string>"
FIGURE = "figure_id string, kind string, canonical_id string, sheet int, sheet_of int, page_pdf int, page_printed string, caption string, title string, image_path string, bbox array<double>, dpi int, chapter string, extraction_method string, sign_codes_depicted array<string>, anchor_section string"
QUESTION = "question_id string, question string, benchmark_version string"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines of a fixed schema; strict reading fails on malformed lines, the other keeps them in _corrupt_record. Blank lines are skipped."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; mode 'append' for logs."""
    df.write.mode(mode).json(path)


def read_figures(spark: SparkSession, path: str) -> DataFrame:
    """Figures of either generation: fields that the first lacks get defaults, a field that the second dropped is not read."""
    return evolve_figures(spark.read.schema(FIGURE).json(path))


def evolve_figures(raw: DataFrame) -> DataFrame:
    """Defaults for the fields that first-generation figures lack."""
    fields = T._parse_datatype_string(FIGURE)
    have = raw.select(*[F.col(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    cid = F.coalesce("canonical_id", F.upper(F.regexp_extract("figure_id", r"([0-9]+[A-Za-z]{0,2}-\d+)", 1)))
    return have.withColumns({"canonical_id": cid, "extraction_method": F.coalesce("extraction_method", F.lit("caption_above_v1")), "chapter": F.coalesce("chapter", F.split_part(cid, F.lit("-"), F.lit(1))), "anchor_section": F.coalesce("anchor_section", F.lit("")), "sign_codes_depicted": F.coalesce("sign_codes_depicted", F.array().cast("array<string>"))})


def code_map(registry: DataFrame, entries: int = 100_000) -> DataFrame:
    """JSON objects keyed by code, keys sorted, of about `entries` codes each: one object for a small registry."""
    n = max(1, -(-registry.count() // entries))
    entry = F.struct("code", F.struct(*[c for c in registry.columns if c != "code"]).alias("value"))
    return registry.groupBy(F.pmod(F.xxhash64("code"), F.lit(n)).alias("part")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("json")).select("json")


def read_code_map(df: DataFrame, value: str) -> DataFrame:
    """The rows of JSON objects keyed by code."""
    return df.select(F.explode(F.from_json("json", f"map<string, struct<{value}>>")).alias("code", "value")).select("code", "value.*")


def xml_lines(spark: SparkSession, path: str, row_tag: str = "line") -> DataFrame:
    """Lines of a layout XML file: y from yMin and yMax, words joined by x."""
    word = "array<struct<_VALUE: string, _xMin: double, _xMax: double, _yMin: double, _yMax: double>>"
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(f"_xMin double, _yMin double, _xMax double, _yMax double, word {word}").load(path)
    words = F.array_sort(F.transform("word", lambda w: F.struct(w["_xMin"].alias("x"), w["_VALUE"].alias("w"))))
    return rows.select(F.col("_yMin").alias("y_top"), F.col("_yMax").alias("y_bot"), F.col("_xMin").alias("x_left"), F.array_join(F.transform(words, lambda w: w["w"]), " ").alias("line"))


def rebuild_lines(words: DataFrame) -> DataFrame:
    """page, block_no, line_no, y_top, y_bot, x_left, line from words (page, block_no, line_no, x0, y0, y1, text): a line has few words."""
    return words.groupBy("page", "block_no", "line_no").agg(F.min("y0").alias("y_top"), F.max("y1").alias("y_bot"), F.min("x0").alias("x_left"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("line"))


def block_lines(blocks: DataFrame) -> DataFrame:
    """page, pos, line of text blocks in reading order (top, then left)."""
    w = Window.partitionBy("page").orderBy("y0", "x0", "block_no")
    rows = blocks.where("block_type = 0").withColumn("b", F.row_number().over(w))
    return rows.select("page", F.posexplode(F.split("text", "\n")).alias("at", "line"), "b").select("page", (F.col("b") * 1_000_000 + F.col("at")).alias("pos"), F.trim("line").alias("line")).where("line <> ''")


def pages_of(texts: DataFrame) -> DataFrame:
    """doc, page (from 1), text, label of form-feed separated pages; the label is that of a 'Page N' line."""
    p = texts.select("doc", F.posexplode(F.split("text", "\f")).alias("at", "text"))
    return p.select("doc", (F.col("at") + 1).alias("page"), "text", F.nullif(F.regexp_extract("text", r"(?m)^\s*Page\s+(\d{1,4})\s*$", 1), F.lit("")).alias("label"))


def candidate_pages(pages: DataFrame) -> DataFrame:
    """Pages with a caption-shaped token anywhere, for pruning the expensive extraction."""
    return pages.where(F.col("text").rlike(r"(?i)(Figure|Table)\s*[0-9]+[A-Z]{0,2}\s*-\s*\d+\s*\.")).select("doc", "page")


def checked_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of every file under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


@dataclass(frozen=True)
class Contract:
    """What a question file must be."""

    rows: int | None = None
    sha256: str | None = None
    version: str | None = None


class ContractError(ValueError):
    """An input breaks its contract."""


def load_questions(spark: SparkSession, path: str, contract: Contract = Contract(), leak_keys: tuple[str, ...] = ()) -> DataFrame:
    """The questions of a JSON-lines file; raises ContractError on a wrong hash, malformed, leaking, incomplete, duplicate or miscounted rows, or another version."""
    if contract.sha256 and [r.sha256 for r in checked_files(spark, path).collect()] != [contract.sha256]:
        raise ContractError("hash differs")
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select("value", F.from_json("value", "map<string, string>", {"mode": "PERMISSIVE"}).alias("m"))
    keys = F.transform(F.map_keys("m"), lambda k: F.lower(k))
    bad = {
        "malformed": F.col("m").isNull() | ~F.trim("value").startswith("{"),
        "leaking": F.size(F.array_intersect(keys, F.array(*[F.lit(k.lower()) for k in leak_keys]).cast("array<string>"))) > 0,
        "incomplete": F.coalesce(F.trim(F.try_element_at("m", F.lit("question_id"))), F.lit("")).eqNullSafe("") | F.coalesce(F.trim(F.try_element_at("m", F.lit("question"))), F.lit("")).eqNullSafe(""),
        "another version": F.lit(False) if contract.version is None else ~F.coalesce(F.try_element_at("m", F.lit("benchmark_version")), F.lit(contract.version)).eqNullSafe(contract.version)}
    counts = parsed.agg(F.count("*").alias("n"), F.countDistinct(F.try_element_at("m", F.lit("question_id"))).alias("ids"), *[F.sum(F.coalesce(c, F.lit(False)).cast("int")).alias(k) for k, c in bad.items()]).head()
    for k in bad:
        if counts[k]:
            raise ContractError(f"{counts[k]} {k} rows")
    if counts.ids != counts.n:
        raise ContractError("duplicate question ids")
    if contract.rows is not None and counts.n != contract.rows:
        raise ContractError(f"{counts.n} rows instead of {contract.rows}")
    return parsed.select(*[F.try_element_at("m", F.lit(c)).alias(c) for c in ("question_id", "question", "benchmark_version")])


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Sections of the first generation from a JSON list: section, title, page_num, text, image_path; missing texts are empty, a missing path is that of the page."""
    raw = spark.read.schema("section string, title string, page_num int, text string, image_path string").option("multiLine", "true").json(path)
    default = F.concat(F.lit("pages/page_"), F.lpad(F.coalesce("page_num", F.lit(0)).cast("string"), 4, "0"), F.lit(".png"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return raw.select(blank("section").alias("section"), blank("title").alias("title"), "page_num", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.nullif(F.trim("image_path"), F.lit("")), default).alias("image_path"))


def whole_text(pages: DataFrame, by: str, page: str, text: str) -> DataFrame:
    """by, text: the pages of every document joined by form feeds, in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(text, F.lit("")).alias("t"))))  # one document
    return pages.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\f").alias("text"))


def merge_upsert(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """old with new rows by key; the latest `at` wins."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last())
    return old.unionByName(new, allowMissingColumns=True).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Rows of wanted whose key is not there yet."""
    return wanted.join(have.select(key).distinct(), key, "left_anti")


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one where the path does not exist."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_manifest(path: str, manifest: dict) -> None:
    """One JSON document on the driver, replaced atomically."""
    import os

    with open(f"{path}.tmp", "w", encoding="utf-8") as fh:
        json.dump(manifest, fh, ensure_ascii=False, sort_keys=True, indent=1)
    os.replace(f"{path}.tmp", path)
