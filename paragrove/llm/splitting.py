"""Splitting oversized items at natural boundaries, by bounded-quantifier regular expressions and SQL array functions.

One alternation consumes the text from the left: the rest of the text if it fits, else up to the limit to a paragraph break,
a sentence end, a line end, a blank, and at last to the limit itself. The matches tile the text without loss. Each piece is a
match preceded by a lookback into the match before it, which supplies the overlap. No Python; oversized texts pass one shuffle, by key,
so that a key that comes again counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragrove.runtime import broadcast_if_small


def normal_type(c: Column) -> Column:
    """A content type without case and outer blanks."""
    return F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))


def cut_pattern(core: Column) -> Column:
    """The alternation for matches of at most core characters; the stronger boundaries must lie in the second half of a match."""
    n, half = core.cast("string"), F.greatest(F.lit(1), F.floor(core / 2)).cast("string")
    span = F.concat(F.lit(".{"), half, F.lit(","), n, F.lit("}"))
    full = F.concat(F.lit(".{1,"), n, F.lit("}"))
    return F.concat(
        F.lit("(?s)"), full, F.lit(r"\z|"),
        span, F.lit(r"(?<=\n[ \t\r]{0,8}\n)|"),
        span, F.lit(r"(?<=[.!?…][\"'”’»)\]]{0,2}\s)|"),
        span, F.lit(r"(?<=[\n;])|"),
        full, F.lit(r"(?<=\s)|"),
        full)


def split_oversized(items: DataFrame, limits: DataFrame, key: str = "chunk_id", text: str = "text", kind: str = "content_type", order: str | None = "ingested_at") -> DataFrame:
    """key, piece_no (from 0), n_pieces, piece, start_char, n_chars for every item with more characters than its limit.

    limits: content_type, max_chars, overlap_chars; few rows. Kinds are compared without case and outer blanks; items of null
    or unknown kind, null text or within the limit give no rows. start_char counts from 0 and includes the overlap, so
    substring(text, start_char + 1, n_chars) is the piece, and a piece never exceeds max_chars. A repeated key counts once,
    with its latest row. Texts of any length are cut whole; a text without any boundary is cut at the limit. An overlap of more
    than half of max_chars raises a ValueError, as every piece would repeat most of the one before.
    """
    rule = limits.select(normal_type(F.col("content_type")).alias("_kind"), F.col("max_chars").cast("int").alias("_max"), F.greatest(F.col("overlap_chars"), F.lit(0)).cast("int").alias("_lap")).where("_kind IS NOT NULL AND _max > 0")
    rule = rule.groupBy("_kind").agg(F.min("_max").alias("_max"), F.min_by("_lap", "_max").alias("_lap")).fillna(0, ["_lap"])
    if not rule.where("_lap > _max / 2").isEmpty():
        raise ValueError("overlap_chars is more than half of max_chars")
    src = items.select(F.col(key).alias("_key"), F.col(text).alias("_text"), normal_type(F.col(kind)).alias("_kind"), (F.col(order) if order else F.lit(0)).alias("_at")).where("_text IS NOT NULL AND _key IS NOT NULL")
    big = src.join(broadcast_if_small(rule), "_kind").where(F.length("_text") > F.col("_max"))
    big = big.groupBy("_key").agg(F.max_by(F.struct("_text", "_max", "_lap"), F.struct("_at", "_text")).alias("r")).select("_key", "r.*")
    cores = F.regexp_extract_all("_text", cut_pattern(F.col("_max") - F.col("_lap")), F.lit(0))
    lap = F.col("_lap")
    # the lookback is the end of the match before, from a word start where one is in its first half
    back = lambda c: F.when(lap <= 0, "").otherwise(F.regexp_replace(F.substring(c, F.greatest(F.lit(1), F.length(c) - lap + 1), lap), F.concat(F.lit(r"(?s)^\S{1,"), F.greatest(F.lit(1), F.floor(lap / 2)).cast("string"), F.lit(r"}\s(?=.)")), F.lit("")))
    ends = F.aggregate("cores", F.array(F.lit(0)), lambda acc, c: F.array_append(acc, F.element_at(acc, -1) + F.length(c)))
    cut = big.select("_key", "_lap", cores.alias("cores")).select("_key", "cores", ends.alias("ends"), F.transform("cores", lambda c: back(c)).alias("backs"))
    out = cut.select("_key", F.size("cores").alias("n_pieces"), F.posexplode(F.arrays_zip(
        F.col("cores"), F.slice(F.col("ends"), F.lit(1), F.size("cores")).alias("at"),
        F.concat(F.array(F.lit("")), F.slice(F.col("backs"), F.lit(1), F.size("backs") - 1)).alias("back"))).alias("piece_no", "p"))
    piece = F.concat("p.back", "p.cores")
    return out.select(F.col("_key").alias(key), "piece_no", "n_pieces", piece.alias("piece"), (F.col("p.at") - F.length("p.back")).alias("start_char"), F.length(piece).alias("n_chars"))
