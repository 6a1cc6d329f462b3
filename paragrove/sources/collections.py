"""Vector collections: their schemas, creation, upserts, a cache of encodings keyed by content, and readiness.

A collection is a Parquet folder. Encodings are kept with the hash of what was encoded, so a changed text is encoded again and
nothing depends on row positions.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paragrove.sources.files import merge_upsert, table_or_empty

#: The four collections: text chunks and captions with one vector, pages and crops with one per patch.
COLLECTIONS = {
    "chunks": "id bigint, dense array<float>, sparse map<int, float>, payload struct<chunk_id: string, section_id: string, content_type: string, page_pdf: int>, upserted_at timestamp_ntz",
    "figures": "id bigint, dense array<float>, payload struct<manual: string, figure_id: string, kind: string, page_pdf: int>, upserted_at timestamp_ntz",
    "pages": "id bigint, vectors array<array<float>>, bits array<array<bigint>>, payload struct<manual: string, page_pdf: int, image_path: string>, upserted_at timestamp_ntz",
    "figures_visual": "id bigint, vectors array<array<float>>, payload struct<manual: string, figure_id: string, image_path: string>, upserted_at timestamp_ntz"}
TOKEN = re.compile(r"\w+", re.UNICODE)


def create(spark: SparkSession, root: str, names: tuple[str, ...] = tuple(COLLECTIONS)) -> None:
    """Empty collections under root; what is there is replaced. An unknown name raises KeyError."""
    for name in names:
        spark.createDataFrame([], COLLECTIONS[name]).write.mode("overwrite").parquet(f"{root}/{name}")


def upsert(spark: SparkSession, root: str, name: str, rows: DataFrame) -> None:
    """Put rows into a collection by id, the latest wins: written beside it, then put in its place."""
    schema = COLLECTIONS[name]
    merged = merge_upsert(table_or_empty(spark, f"{root}/{name}", schema), rows, "id", "upserted_at")
    merged.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}.new")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path(f"{root}/{name}"), True)
    fs.rename(path(f"{root}/{name}.new"), path(f"{root}/{name}"))
    spark.catalog.refreshByPath(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A collection; empty where it was never created."""
    return table_or_empty(spark, f"{root}/{name}", COLLECTIONS[name])


def readiness(spark: SparkSession, root: str, needed: dict[str, str]) -> dict[str, bool]:
    """Whether each collection exists and has a row that meets a condition (SQL), as 'figures': 'payload.figure_id IS NOT NULL'."""
    return {name: not read(spark, root, name).where(condition).limit(1).isEmpty() for name, condition in needed.items()}


def encode_missing(items: DataFrame, cache: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """id, content_sha, dense, sparse of all items (id, text): from the cache where id and content are the same, else encoded.

    encode gets id, text and returns id, dense, sparse. Null texts are encoded as empty ones.
    """
    keyed = items.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("content_sha", F.sha2("text", 256))
    have = cache.select("id", "content_sha", "dense", "sparse").dropDuplicates(["id", "content_sha"])
    known = keyed.drop("text").join(have, ["id", "content_sha"])
    todo = keyed.join(have.select("id", "content_sha"), ["id", "content_sha"], "left_anti")
    fresh = todo.drop("text").join(encode(todo.select("id", "text")), "id")
    return known.select("id", "content_sha", "dense", "sparse").unionByName(fresh.select("id", "content_sha", "dense", "sparse"))


def hashed_sparse(text: Column, buckets: int = 30_000) -> Column:
    """A stand-in sparse encoding: map of token bucket to count; empty for null."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    keys = F.transform(tokens, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(buckets)).cast("int"))
    count = lambda k: F.size(F.filter(keys, lambda x: x == k)).cast("float")
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(keys)), lambda k: F.struct(k, count(k))))


def hashed_encoder(dim: int = 64, sparse: bool = True) -> Callable[[DataFrame], DataFrame]:
    """A stand-in for a text encoder: signed hashes of the tokens, of length 1, and hashed counts; with sparse=False dense vectors alone, as where a model gives no lexical weights."""
    def run(batches):
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                x = np.zeros(dim)
                for w in TOKEN.findall((t or "").lower()):
                    h = zlib.crc32(w.encode())
                    x[h % dim] += 1 if h >> 16 & 1 else -1
                n = math.sqrt(float(x @ x))
                out.append((x / n if n else x).astype(np.float32).tolist())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.float32())), b.column("text")], names=["id", "dense", "text"])

    def encode(items: DataFrame) -> DataFrame:
        kind = dict(items.dtypes)["id"]
        out = items.select("id", "text").mapInArrow(run, f"id {kind}, dense array<float>, text string")
        return out.select("id", "dense", (hashed_sparse(F.col("text")) if sparse else F.lit(None).cast("map<int, float>")).alias("sparse"))

    return encode


def hashed_patches(texts: DataFrame, dim: int = 64, words: int = 8) -> DataFrame:
    """id, vec of a stand-in multivector encoding: one vector for every `words` words of a text."""
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("w") / words).cast("int") - 1, F.lit(0)))
    patches = texts.select("id", w.alias("w")).where("size(w) > 0").select("id", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("w", i * words + 1, F.lit(words)), " "))).alias("n", "text"))
    key = patches.select(F.struct("id", "n").alias("id"), "text")
    return hashed_encoder(dim, False)(key).select(F.col("id.id").alias("id"), F.col("dense").alias("vec"))


def figure_payload(figures: DataFrame, nodes: DataFrame) -> DataFrame:
    """The payload of every figure node as it is shown: 13 fields, paths of all its sheets in order."""
    from paragrove.functions.ids import reference_key
    from paragrove.functions.text import chapter_of
    from paragrove.operators.graph import node

    ref = reference_key(F.col("canonical_id"))
    target = F.when(F.col("kind") == "Figure", node("figure", "manual", ref)).otherwise(node("table", "manual", ref))
    sheet = F.struct(F.coalesce("sheet", F.lit(1)).alias("sheet"), F.coalesce("page_pdf", F.lit(-1)).alias("page"), "figure_key", "image_path", "caption", "title", "page_pdf", "page_printed", "chapter", "extraction_method", "figure_id")
    per = figures.withColumn("id", target).groupBy("id", "manual", "kind", ref.alias("canonical_id")).agg(F.array_sort(F.collect_list(sheet)).alias("s"))  # the sheets of one figure
    h = F.col("s")[0]
    return per.join(nodes.where("NOT unresolved").select("id"), "id", "left_semi").select(
        "id", "manual", "kind", "canonical_id", h["figure_id"].alias("figure_id"), h["caption"].alias("caption"), h["title"].alias("title"), h["page_pdf"].alias("page_pdf"), h["page_printed"].alias("page_printed"),
        F.coalesce(F.nullif(h["chapter"], F.lit("")), chapter_of(F.col("canonical_id"))).alias("chapter"), h["extraction_method"].alias("extraction_method"), F.transform("s", lambda x: x["image_path"]).alias("image_paths"), F.size("s").alias("n_sheets"))
