"""Ordered lines to typed paragraphs, and outlines to hierarchies, by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paragrove.functions.ids import normalize_dashes

#: The line grammar.
SECTION = r"^Section\s+([0-9A-Z]+\.[0-9]+)\s+(.+)$"
RULE = r"^(Standard|Support|Guidance|Option)\s*:\s*$"
NUMBER = r"^(\d{1,3})\s*$"
CHAPTER = r"(?i)^CHAPTER\s+([0-9A-Z]+)\."
PART = r"(?i)^PART\s+(\d+)"
NOISE = r"^Page\s+\d{1,4}\s*$|^Sect\.\s+"


def segment(lines: DataFrame, keys: list[str], footers: tuple[str, ...] = ()) -> DataFrame:
    """keys, section_id, rule, ordinal, page, text of every paragraph.

    lines: keys (the document), section_id (the section being read), pos (total order), page, line. A paragraph begins at a
    rule heading or a line with a number alone; a rule heading resets the number, so text under a heading without number is
    dropped. The section ends at the first heading of another section, chapter or part after its own. A paragraph carries the
    page being read when its end was met, which is the page of the next boundary. Blank lines, footers, page numbers and
    section ranges are skipped. The section's own heading met again resets rule and number and discards the paragraph in
    flight.
    """
    by = [*keys, "section_id"]
    s = F.trim("line")
    rows = lines.withColumn("s", s).where((F.col("s") != "") & ~F.col("s").rlike(NOISE) & (~F.col("s").isin(*footers) if footers else F.lit(True)))
    head = F.regexp_extract("s", SECTION, 1)
    own = (head != "") & (head == F.col("section_id"))
    stop = ((head != "") & (head != F.col("section_id"))) | F.col("s").rlike(CHAPTER) | F.col("s").rlike(PART)
    rows = rows.withColumns({"own": own, "stop": stop})
    section = Window.partitionBy(*by)
    rows = rows.withColumn("start_pos", F.min(F.when(F.col("own"), F.col("pos"))).over(section)).where("pos >= start_pos")
    rows = rows.withColumn("stop_pos", F.min(F.when(F.col("stop"), F.col("pos"))).over(section))
    last_page = F.max(F.struct("pos", "page")).over(section)["page"]
    rows = rows.withColumn("end_page", F.coalesce(F.min(F.when(F.col("stop"), F.struct("pos", "page"))).over(section)["page"], last_page)).where("stop_pos IS NULL OR pos < stop_pos")
    rule, number = F.nullif(F.regexp_extract("s", RULE, 1), F.lit("")), F.nullif(F.regexp_extract("s", NUMBER, 1), F.lit("")).cast("int")
    rows = rows.withColumns({"r": rule, "n": number})
    rows = rows.withColumn("bound", (F.col("own") | F.col("r").isNotNull() | F.col("n").isNotNull()).cast("int"))
    so_far = section.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = section.orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumns({
        "seg": F.sum("bound").over(so_far), "state": F.sum((F.col("own") | F.col("r").isNotNull()).cast("int")).over(so_far),
        "next": F.first(F.when(F.col("bound") == 1, F.struct("page", "own")), ignorenulls=True).over(ahead)})
    state = Window.partitionBy(*by, "state").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"rule": F.last("r", True).over(state), "ordinal": F.last("n", True).over(state)})
    body = rows.where("bound = 0 AND rule IS NOT NULL AND ordinal IS NOT NULL AND NOT coalesce(next.own, false)")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), " ")
    return body.groupBy(*by, "seg").agg(F.first("rule").alias("rule"), F.first("ordinal").alias("ordinal"), F.max_by(F.coalesce("next.page", "end_page"), "pos").alias("page"), text.alias("t")).select(
        *by, "rule", "ordinal", "page", normalize_dashes(F.trim(F.regexp_replace("t", r"\s+", " "))).alias("text"))


def title_case(c: Column) -> Column:
    """Every run of letters with a capital first and small letters after it, digits and signs as they are ('CHAPTER 2B. SIGNS' -> 'Chapter 2B. Signs')."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), lambda x: F.initcap(x)), "")


def hierarchy(outline: DataFrame, key: str) -> DataFrame:
    """key, section_id, part, chapter, start_page, end_page from outline entries (key, pos, level, title, page; pages, if known).

    Part and chapter are carried forward in title case; a section ends on the page where the next one starts (both have that
    page), the last one on the page after the document's last (`pages` of the outline; without it, it has no end).
    """
    t = F.trim("title")
    kind = F.when(t.rlike(PART), "part").when(t.rlike(CHAPTER), "chapter").when((F.col("level") == 3) & t.rlike(SECTION), "section")
    rows = outline.select(key, "pos", "page", t.alias("t"), kind.alias("kind"), (F.col("pages") if "pages" in outline.columns else F.lit(None)).cast("int").alias("pages"))
    w = Window.partitionBy(key).orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = rows.withColumns({"part": F.last(F.when(F.col("kind") == "part", title_case(F.col("t"))), True).over(so_far), "chapter": F.last(F.when(F.col("kind") == "chapter", title_case(F.col("t"))), True).over(so_far)}).where("kind = 'section'")
    return carried.select(key, F.regexp_extract("t", SECTION, 1).alias("section_id"), "part", "chapter", F.col("page").alias("start_page"), F.coalesce(F.lead("page").over(w), F.col("pages") + 1).alias("end_page"))
