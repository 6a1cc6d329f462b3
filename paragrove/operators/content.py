"""What a model call sends and gets back: nested reply contents, payload sizes, display outputs and bounded records of values.

Contents are JSON strings. What has a fixed depth is a column expression; walks of any depth run in Arrow batches.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Block types that hold no answer, and keys that may hold the text of a block without one.
SILENT = ("thinking", "reasoning", "redacted_thinking")
TEXT_KEYS = ("content", "output_text", "value")
#: Media types by suffix; others are PNG.
MEDIA = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp", ".gif": "image/gif"}
MOST_INLINE = 18 * 1024 * 1024


def block_text(value) -> str:
    """The text of a content: a string, a list of blocks (joined by line breaks), or a block; what is no text is empty."""
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, list):
        return "\n".join(filter(None, map(block_text, value))).strip()
    if not isinstance(value, dict) or str(value.get("type") or "").strip().lower() in SILENT:
        return ""
    own = value.get("text")
    if isinstance(own, dict):
        own = own.get("value")
    if isinstance(own, str):
        return own.strip()
    return next(filter(None, (block_text(value[k]) for k in TEXT_KEYS if k in value)), "")


def find_key(value, keys: frozenset[str], deepest: int = 4, depth: int = 0):
    """The first value that is not null under one of the keys (any case): those of an object before what lies in it, down to a depth; None if there is none."""
    if depth > deepest:
        return None
    inside = list(value.items()) if isinstance(value, dict) else [(None, v) for v in value] if isinstance(value, list) else []
    here = next((v for k, v in inside if k is not None and k.lower() in keys and v is not None), None)
    if here is not None:
        return here
    return next((hit for hit in (find_key(v, keys, deepest, depth + 1) for _, v in inside) if hit is not None), None)


def bounded(value, deepest: int = 6, most: int = 200, depth: int = 0):
    """A value without what lies too deep, is too long a list, or binary (kept as size and SHA-256)."""
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, (bytes, bytearray)):
        return {"__binary__": True, "nbytes": len(value), "sha256": hashlib.sha256(bytes(value)).hexdigest()}
    if depth > deepest:
        return {"__truncated__": True, "repr": repr(value)[:2000]}
    if isinstance(value, dict):
        items, left = list(value.items()), max(0, len(value) - most)
        out = {str(k): bounded(v, deepest, most, depth + 1) for k, v in items[:most]}
        return out | ({"__remaining_items_truncated__": left} if left else {})
    if isinstance(value, (list, tuple, set, frozenset)):
        items = list(value)
        out = [bounded(v, deepest, most, depth + 1) for v in items[:most]]
        return out + ([{"__remaining_items_truncated__": len(items) - most}] if len(items) > most else [])
    return {"__type__": type(value).__name__, "repr": repr(value)[:10_000]}


def _parsed(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return text


def text_of(content: Column) -> Column:
    """block_text() of JSON contents; a text that is no JSON is itself, null is empty."""
    @F.pandas_udf("string")
    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda x: block_text(_parsed(x)) if isinstance(x, str) else "")

    return read(content)


def value_under(content: Column, keys: tuple[str, ...], deepest: int = 4) -> Column:
    """find_key() in JSON contents: strings as they are, other values as JSON; null if there is none."""
    wanted = frozenset(k.lower() for k in keys)

    def one(x):
        hit = find_key(_parsed(x), wanted, deepest) if isinstance(x, str) else None
        return hit if hit is None or isinstance(hit, str) else json.dumps(hit, ensure_ascii=False)

    @F.pandas_udf("string")
    def read(s: pd.Series) -> pd.Series:
        return s.map(one)

    return read(content)


def bounded_json(content: Column, deepest: int = 6, most: int = 200) -> Column:
    """bounded() of JSON contents, as JSON; null stays null."""
    @F.pandas_udf("string")
    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda x: json.dumps(bounded(_parsed(x), deepest, most), ensure_ascii=False) if isinstance(x, str) else None)

    return read(content)


def block_types(content: Column) -> Column:
    """The types of a JSON list of blocks, 'object' for blocks without one; ['string'] for other texts; null stays null."""
    blocks = F.from_json(content, "array<map<string, string>>")
    return F.when(content.isNotNull(), F.when(F.ltrim(content).startswith("["), F.transform(blocks, lambda b: F.coalesce(F.try_element_at(b, F.lit("type")), F.lit("object")))).otherwise(F.array(F.lit("string"))))


def media_type(path: Column) -> Column:
    """The media type of an image by its suffix."""
    low, out = F.lower(path), F.lit("image/png")
    for suffix, name in MEDIA.items():
        out = F.when(low.endswith(suffix), name).otherwise(out)
    return out


def payload_bytes(prompt: Column, sizes: Column) -> Column:
    """Bytes of a request: the prompt in UTF-8 and every image (sizes: array of bytes) in base64."""
    inline = F.aggregate(F.coalesce(sizes, F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda s, n: s + 4 * F.floor((F.coalesce(n, F.lit(0)) + 2) / 3).cast("bigint"))
    return F.octet_length(F.coalesce(prompt, F.lit(""))).cast("bigint") + inline


def image_outputs(mimes: Column) -> Column:
    """How many entries of an array of MIME maps hold an image."""
    return F.size(F.filter(mimes, lambda m: F.exists(F.map_keys(m), lambda k: k.startswith("image/"))))


def distinct_displays(displays: DataFrame, keys: list[str], order: str, content: str) -> DataFrame:
    """The display outputs of every key without repeated contents; the first by `order` stays."""
    w = Window.partitionBy(*keys, F.sha2(F.coalesce(content, F.lit("\0")), 256)).orderBy(order)
    return displays.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def debug_row(provider: Column, model_id: Column, content: Column, text: Column, stop_reason: Column, token_limit: Column, images: Column, attempt: Column) -> Column:
    """One struct of what a call was, without its texts."""
    return F.struct(provider.alias("provider"), model_id.alias("model_id"), block_types(content).alias("block_types"), F.length(F.coalesce(text, F.lit(""))).alias("text_chars"), stop_reason.alias("stop_reason"), token_limit.alias("token_limit"), images.alias("image_count"), attempt.alias("attempt"))
