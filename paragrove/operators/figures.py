"""Caption geometry, the mention census and the coverage gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paragrove.functions import text
from paragrove.functions.ids import normalize_dashes, reference_key

#: Page geometry in points.
TOP, BOTTOM, SIDE, GAP_BELOW, GAP_NEXT, MIN_H, MIN_W, ROW_BAND, INSET = 46.0, 46.0, 22.0, 4.0, 6.0, 60.0, 80.0, 6.0, 0.45


def dedup_captions(captions: DataFrame, page: list[str]) -> DataFrame:
    """One caption per page, kind, id and sheet: those in the text column first, then the topmost, then the leftmost."""
    w = Window.partitionBy(*page, "kind", "canonical_id", F.coalesce("sheet", F.lit(-1))).orderBy("inset", "y_top", "x_left", "key")
    return captions.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def regions(captions: DataFrame, page: list[str], width: float = 612.0, height: float = 792.0, min_h: float = MIN_H) -> DataFrame:
    """The captions with their crop x0, y0, x1, y1.

    captions: page, key, kind, canonical_id, sheet, y_top, y_bot, x_left, inset. A region reaches down to the next caption
    strictly below, else to the bottom margin; captions in one row share the width; too small regions are dropped.
    """
    caps = dedup_captions(captions, page)
    by = ", ".join(page)
    # the captions of one page, so as long as a page has captions
    tops = F.collect_list("y_top").over(Window.partitionBy(*page))
    row = F.expr(f"collect_list(x_left) OVER (PARTITION BY {by} ORDER BY y_top RANGE BETWEEN 5.9999999D PRECEDING AND 5.9999999D FOLLOWING)")
    caps = caps.withColumns({"tops": tops, "row": row}).withColumn("below", F.array_min(F.filter("tops", lambda y: y > F.col("y_bot") + 1)))
    right = F.array_min(F.filter("row", lambda x: x > F.col("x_left")))
    left = F.exists("row", lambda x: x < F.col("x_left"))
    x0 = F.when(F.col("inset"), F.greatest(F.lit(SIDE), F.col("x_left") - 10)).otherwise(F.lit(SIDE))
    x0 = F.when(left, F.greatest(x0, F.col("x_left") - 10)).otherwise(x0)
    x1 = F.least(F.lit(width - SIDE), right - 8)
    out = caps.withColumns({"x0": x0, "y0": F.col("y_bot") + GAP_BELOW, "x1": x1, "y1": F.least(F.lit(height - BOTTOM), F.col("below") - GAP_NEXT)})
    return out.where((F.col("y1") - F.col("y0") >= min_h) & (F.col("x1") - F.col("x0") >= MIN_W)).drop("tops", "below", "row")


def census(texts: DataFrame, by: str) -> DataFrame:
    """by, kind, canonical_id of every id mentioned in the texts, and whether all its lines name an external source."""
    flat = text.canonical_spacing(normalize_dashes(F.col("text")))
    lines = texts.select(by, F.explode(F.split(flat, "\n")).alias("line"))
    hits = lines.select(by, F.col("line").rlike(text.EXTERNAL).alias("external"), F.explode(F.regexp_extract_all("line", F.lit(text.MENTION), F.lit(0))).alias("m"))
    kind = F.when(F.lower("m").startswith("figure"), "Figure").otherwise("Table")
    return hits.select(by, kind.alias("kind"), reference_key(F.col("m")).alias("canonical_id"), "external").groupBy(by, "kind", "canonical_id").agg(F.bool_and("external").alias("external"), F.count("*").alias("n_mentions"))


def coverage(mentioned: DataFrame, figures: DataFrame, by: str) -> DataFrame:
    """by, kind, mentioned, extracted, missing, extra, external, coverage (1 where nothing is mentioned)."""
    got = figures.select(by, "kind", reference_key(F.col("canonical_id")).alias("canonical_id")).distinct().withColumn("got", F.lit(1))
    both = mentioned.join(got, [by, "kind", "canonical_id"], "full_outer").fillna({"got": 0}).withColumn("own", F.coalesce(~F.col("external"), F.lit(False)).cast("int"))
    n = lambda c: F.sum(F.expr(c)).cast("bigint")
    out = both.groupBy(by, "kind").agg(n("own").alias("mentioned"), n("got").alias("extracted"), n("own * (1 - got)").alias("missing"), n("got * (1 - own)").alias("extra"), n("coalesce(cast(external as int), 0)").alias("external"))
    return out.withColumn("coverage", F.when(F.col("mentioned") > 0, F.round((F.col("mentioned") - F.col("missing")) / F.col("mentioned"), 6)).otherwise(1.0))


class CoverageError(RuntimeError):
    """The gate found too few figures."""


def gate(report: DataFrame, threshold: float = 0.98, kinds: tuple[str, ...] = ("Figure",)) -> DataFrame:
    """The rows of a coverage report below the threshold; tables are not gated by default."""
    return report.where(F.col("kind").isin(*kinds) & (F.col("coverage") < threshold))


def check(report: DataFrame, threshold: float = 0.98) -> None:
    """Raise CoverageError where the gate fails."""
    bad = gate(report, threshold).limit(1).collect()
    if bad:
        raise CoverageError(f"coverage {bad[0].coverage} of {bad[0].kind} is below {threshold}")


def rescue(mentioned: DataFrame, figures: DataFrame, pages: DataFrame, by: str) -> DataFrame:
    """by, kind, canonical_id, page of missing ids whose caption form ('Figure 2B-4.') stands on a page."""
    got = figures.select(by, "kind", reference_key(F.col("canonical_id")).alias("canonical_id")).distinct()
    missing = mentioned.where("NOT external").join(got, [by, "kind", "canonical_id"], "left_anti").select(by, "kind", "canonical_id")
    token = F.explode(F.regexp_extract_all(text.canonical_spacing(normalize_dashes(F.col("text"))), F.lit(r"(?i)((?:Figure|Table)\s+[0-9]+[A-Z]{0,2}-\d+)\."), F.lit(1)))
    seen = pages.select(by, F.col("page_pdf").alias("page"), token.alias("m"))
    kind = F.when(F.lower("m").startswith("figure"), "Figure").otherwise("Table")
    seen = seen.select(by, "page", kind.alias("kind"), reference_key(F.col("m")).alias("canonical_id")).distinct()
    return missing.join(seen, [by, "kind", "canonical_id"])


def regions_first_generation(captions: DataFrame, page: list[str], width: float = 612.0, height: float = 792.0) -> DataFrame:
    """The captions with x0, y0, x1, y1 by the older rule: a figure stands above its caption, a table below.

    captions as for regions(). A figure reaches up to the nearest caption that ends above it, a table down to the nearest that
    begins below; too small regions are dropped.
    """
    spans = F.collect_list(F.struct("y_top", "y_bot")).over(Window.partitionBy(*page))  # the captions of one page
    caps = captions.withColumn("spans", spans).withColumns({
        "above": F.array_max(F.transform(F.filter("spans", lambda s: s["y_bot"] <= F.col("y_top")), lambda s: s["y_bot"])),
        "below": F.array_min(F.transform(F.filter("spans", lambda s: s["y_top"] >= F.col("y_bot")), lambda s: s["y_top"]))})
    figure = F.col("kind") == "Figure"
    y0 = F.when(figure, F.greatest(F.lit(30.0), F.col("above") + 8)).otherwise(F.col("y_bot") + 4)
    y1 = F.when(figure, F.col("y_top") - 4).otherwise(F.least(F.lit(height - 30), F.col("below") - 8))
    out = caps.withColumns({"x0": F.lit(24.0), "y0": y0, "x1": F.lit(width - 24), "y1": y1})
    return out.where((F.col("y1") - F.col("y0") >= MIN_H) & (F.col("x1") - F.col("x0") >= MIN_W)).drop("spans", "above", "below")


#: A caption in the middle of a line, of which the id ends with a period, and an id cut by a blank.
MIDLINE = r"(?i)(Figure|Table)\s+([0-9]+[A-Z]{0,2}-\d+)\.(\s*\(Sheet\s+(\d+)\s+of\s+(\d+)\))?\s*(.*)$"
FUSED, HALF_ID, ID_END, ID_PERIOD = r"(?i)^(figure|table)([0-9].*)$", r"(?i)^[0-9]+[A-Z]{0,2}-$", r"^\d+[.,]?$", r"^[0-9]+[A-Z]{0,2}-\d+\.$"


def repaired_words(words: Column) -> Column:
    """The words (text, x0) of a line with keyword and id apart ('Figure4F-1.') and ids whole ('4F-' '1.')."""
    kind = "array<struct<text: string, x0: double>>"
    at = lambda t, x: F.struct(t.alias("text"), x.alias("x0"))
    apart = F.flatten(F.transform(words, lambda w: F.when(w["text"].rlike(FUSED), F.array(at(F.regexp_extract(w["text"], FUSED, 1), w["x0"]), at(F.regexp_extract(w["text"], FUSED, 2), w["x0"]))).otherwise(F.array(at(w["text"], w["x0"])))))

    def put(acc, w):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(at(F.concat(last["text"], w["text"]), last["x0"])))
        return F.when(F.coalesce(last["text"].rlike(HALF_ID), F.lit(False)) & w["text"].rlike(ID_END), joined).otherwise(F.concat(acc, F.array(at(w["text"], w["x0"]))))

    return F.aggregate(apart, F.array().cast(kind), put)


def midline_caption(words: Column, width: Column) -> Column:
    """struct(kind, canonical_id, sheet, sheet_of, title, x_left) of a caption within a line: the first keyword in the right part whose id ends with a period; null without one."""
    w = repaired_words(words)
    strip = lambda c: F.regexp_replace(c, r"^[ .—–:-]+|[ .—–:-]+$", "")
    number = lambda c: F.nullif(c, F.lit("")).cast("int")

    def read(ws):
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ws) - 1, F.lit(1))), lambda i: (i < F.size(ws)) & F.lower(F.element_at(ws, i)["text"]).isin("figure", "table") & F.try_element_at(ws, i + 1)["text"].rlike(ID_PERIOD) & (F.element_at(ws, i)["x0"] >= width * INSET))
        i = F.try_element_at(starts, F.lit(1))
        tail = F.array_join(F.transform(F.slice(ws, i, F.size(ws)), lambda x: x["text"]), " ")
        part = lambda n: F.regexp_extract(tail, MIDLINE, n)
        title, own = strip(part(6)), part(4) != ""
        end = lambda n: F.regexp_extract(title, text.SHEET_TAIL, n)
        return F.when(i.isNotNull() & tail.rlike(MIDLINE), F.struct(
            F.initcap(part(1)).alias("kind"), F.upper(part(2)).alias("canonical_id"), F.when(own, number(part(4))).otherwise(number(end(1))).alias("sheet"), F.when(own, number(part(5))).otherwise(number(end(2))).alias("sheet_of"),
            F.when(own, title).otherwise(strip(F.regexp_replace(title, text.SHEET_TAIL, ""))).alias("title"), F.element_at(ws, i)["x0"].alias("x_left")))

    return F.element_at(F.transform(F.array(w), read), 1)


def detect(words: DataFrame, page: list[str], whitelist: DataFrame | None = None) -> DataFrame:
    """Captions (page, key, kind, canonical_id, sheet, sheet_of, title, y_top, y_bot, x_left, inset) of pages of words.

    words: page, line_no, word_no, text, x0, y0, y1, width (of the page). A line is a caption by its start, else by its middle;
    pages with two or more rows of a table of contents have none. whitelist: pages to read; without it all.
    """
    if whitelist is not None:
        words = words.join(whitelist.select(*page).distinct(), page, "left_semi")
    row = F.struct("x0", "word_no", normalize_dashes(F.col("text")).alias("text"))
    lines = words.groupBy(*page, "line_no").agg(F.array_sort(F.collect_list(row)).alias("w"), F.min("y0").alias("y_top"), F.max("y1").alias("y_bot"), F.max("width").alias("width"))  # the words of one line
    lines = lines.withColumn("line", F.array_join(F.transform("w", lambda x: x["text"]), " "))
    listed = lines.groupBy(*page).agg(F.count_if(text.is_list_entry(F.col("line"))).alias("n")).where("n >= 2")
    lines = lines.join(listed, page, "left_anti")
    start, middle = text.caption(F.col("line")), midline_caption(F.transform("w", lambda x: F.struct(x["text"].alias("text"), x["x0"].alias("x0"))), F.col("width"))
    got = lines.withColumns({"s": start, "m": middle}).where("s IS NOT NULL OR m IS NOT NULL")
    own = F.col("s").isNotNull()
    pick = lambda f: F.when(own, F.col(f"s.{f}")).otherwise(F.col(f"m.{f}")).alias(f)
    return got.select(*page, F.col("line_no").alias("key"), *[pick(f) for f in ("kind", "canonical_id", "sheet", "sheet_of", "title")], "y_top", "y_bot", F.when(own, F.element_at("w", 1)["x0"]).otherwise(F.col("m.x_left")).alias("x_left"), "width",
                      (~own | (F.element_at("w", 1)["x0"] >= F.col("width") * INSET)).alias("inset"))


def extract(words: DataFrame, page: list[str], mentioned: DataFrame, by: str, relaxed_min_h: float = 24.0) -> DataFrame:
    """Crops of all captions, with a second pass of a smaller least height for mentioned ids that have none.

    mentioned: by (one of the page columns), kind, canonical_id, external, as census() gives it. extraction_method tells the
    passes apart; the second keeps crops of missing ids alone, from pages on which their caption stands.
    """
    found = detect(words, page)
    first = regions(found, page).withColumn("extraction_method", F.lit("caption_below_v2"))
    ids = [by, "kind", "canonical_id"]
    missing = mentioned.where("NOT external").join(first.select(*ids).distinct(), ids, "left_anti").select(*ids)
    todo = found.join(missing, ids, "left_semi").select(*page).distinct()
    second = regions(found.join(todo, page, "left_semi"), page, min_h=relaxed_min_h).join(missing, ids, "left_semi").withColumn("extraction_method", F.lit("caption_below_v2_rescued"))
    return first.unionByName(second)
