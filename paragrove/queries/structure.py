"""Queries of segmentation, figures, coverage and routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paragrove.functions import text
from paragrove.functions.ids import reference_key
from paragrove.operators import figures as fig
from paragrove.operators import router, segment
from paragrove.queries.text import C, DASH, FIG, KIND, REF_KEY, _SPACED, chunks, figures
from paragrove.runtime import table


def source_lines(spark, sf):
    """The lines of every section as they stood in its manual: heading, then rule, number and text of each paragraph."""
    kind = F.coalesce(text.content_type(F.col("content_type")), F.lit("Support"))
    c = chunks(spark, sf).withColumn("kind", kind)
    w = Window.partitionBy("manual", "section_id").orderBy("page_pdf", "ordinal", "chunk_id")
    c = c.withColumn("nth", F.row_number().over(w))
    head = F.when(F.col("nth") == 1, F.array(F.concat_ws(" ", F.lit("Section"), "section_id", F.coalesce("section_title", F.lit("Untitled"))))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(head, F.array(F.concat("kind", F.lit(":")), F.format_string("%02d", "ordinal")), F.split("text", "\n"))
    return c.select("manual", "section_id", "nth", F.col("page_pdf").alias("page"), F.posexplode(lines).alias("at", "line")).select("manual", "section_id", (F.col("nth") * 1_000_000 + F.col("at")).alias("pos"), "page", "line")


def segment_paragraphs(spark, sf):
    out = segment.segment(source_lines(spark, sf), ["manual"])
    return out.select("manual", "section_id", "rule", "ordinal", "page", F.sha2("text", 256).alias("text_sha"))


def outline(spark, sf):
    c = chunks(spark, sf)
    key = lambda title, level: c.where(f"{title} IS NOT NULL").groupBy("manual", F.col(title).alias("title")).agg(F.min("page_pdf").alias("page")).withColumn("level", F.lit(level))
    sections = c.groupBy("manual", F.concat_ws(" ", F.lit("Section"), "section_id", F.coalesce("section_title", F.lit("Untitled"))).alias("title")).agg(F.min("page_pdf").alias("page")).withColumn("level", F.lit(3))
    rows = key("part", 1).unionByName(key("chapter", 2)).unionByName(sections)
    rows = rows.join(c.groupBy("manual").agg(F.max("page_pdf").alias("pages")), "manual")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("manual").orderBy("page", "level", "title")))


def outline_carry_forward(spark, sf):
    return segment.hierarchy(outline(spark, sf), "manual")


def sections_on_pages(spark, sf):
    """Pages of every section: ranges joined to pages as equal keys; a page that two sections share belongs to both."""
    h = segment.hierarchy(outline(spark, sf), "manual").where("end_page IS NOT NULL AND end_page >= start_page")
    pages = h.select("manual", "section_id", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    n = chunks(spark, sf).groupBy("manual", F.col("page_pdf").alias("page")).agg(F.count("*").alias("n_chunks"))
    return pages.join(n, ["manual", "page"]).groupBy("manual", "section_id").agg(F.count("*").alias("n_pages"), F.sum("n_chunks").alias("n_chunks"))


def toc_page_guard(spark, sf):
    """Pages with at least two dot-leader lines are lists of contents."""
    lines = source_lines(spark, sf)
    return lines.groupBy("manual", "page").agg(F.count("*").alias("n_lines"), F.sum(F.col("line").rlike(r"\.{4,}").cast("bigint")).alias("n_leaders")).withColumn("is_toc", F.col("n_leaders") >= 2)


def captions(spark, sf):
    f = figures(spark, sf).where("size(bbox) = 4")
    y = F.element_at("bbox", 2)
    return f.select("manual", "page_pdf", F.col("figure_key").alias("key"), "kind", reference_key(F.col("canonical_id")).alias("canonical_id"), "sheet", y.alias("y_top"), (y + 10 + F.col("figure_key") % 3 * 4).alias("y_bot"), F.element_at("bbox", 1).alias("x_left"), (F.element_at("bbox", 1) >= fig.INSET * 612).alias("inset"))


def figure_regions(spark, sf):
    r = fig.regions(captions(spark, sf), ["manual", "page_pdf"])
    return r.select("key", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


def figure_regions_v1(spark, sf):
    """The older geometry: figures above their captions, tables below."""
    r = fig.regions_first_generation(captions(spark, sf), ["manual", "page_pdf"])
    return r.select("key", "kind", *[F.round(c, 6).alias(c) for c in ("y0", "y1")])


def caption_dedup(spark, sf):
    return fig.dedup_captions(captions(spark, sf), ["manual", "page_pdf"]).select("key", "kind", "canonical_id", "sheet")


def page_words(spark, sf):
    """Pages of words: every live figure's caption as a line, at the start of one or, for odd keys, in its right part, with fused and split ids."""
    f = figures(spark, sf).select("manual", "page_pdf", "figure_key", "kind", reference_key(F.col("canonical_id")).alias("cid"), "sheet").where(F.col("cid").rlike(r"^[0-9]+[A-Z]{0,2}-\d+$"))
    f = f.withColumn("n", F.row_number().over(Window.partitionBy("manual", "page_pdf").orderBy("figure_key")))
    odd, three = F.col("figure_key") % 2 == 1, F.col("figure_key") % 3
    number = F.concat(F.split_part("cid", F.lit("-"), F.lit(2)), F.lit("."))
    head = F.concat(F.split_part("cid", F.lit("-"), F.lit(1)), F.lit("-"))
    named = F.when(three == 0, F.array("kind", F.concat(head, number))).when(three == 1, F.array(F.concat("kind", head), number)).otherwise(F.array("kind", F.translate(head, "-", "‑"), number))
    sheet = F.when(F.col("sheet").isNotNull(), F.array(F.lit("(Sheet"), F.col("sheet").cast("string"), F.lit("of"), F.lit("9)"))).otherwise(F.array().cast("array<string>"))
    body = F.when(odd, F.array(*[F.lit(w) for w in ("signs", "may", "be", "used", "see", "Figure", "9Z-1)")])).otherwise(F.array().cast("array<string>"))
    words = F.concat(body, named, F.array(F.lit("Layout"), F.concat(F.lit("no"), F.col("figure_key").cast("string"))), sheet)
    rows = f.select("manual", "page_pdf", F.col("figure_key").alias("line_no"), (60.0 + 34.0 * F.col("n")).alias("y0"), F.size(body).alias("lead"), F.posexplode(words).alias("word_no", "text"))
    x0 = F.when(F.col("word_no") < F.col("lead"), 40.0 + 30.0 * F.col("word_no")).otherwise(F.when(F.col("lead") > 0, 300.0).otherwise(40.0) + 30.0 * (F.col("word_no") - F.col("lead")))
    return rows.select("manual", "page_pdf", "line_no", "word_no", "text", x0.alias("x0"), "y0", (F.col("y0") + 10 + F.col("line_no") % 3 * 4).alias("y1"), F.lit(612.0).alias("width"))


def caption_detect(spark, sf):
    return fig.detect(page_words(spark, sf), ["manual", "page_pdf"]).select("key", "kind", "canonical_id", "sheet", "title", "x_left", "inset")


def extract_figures(spark, sf):
    """Crops of the captions of all pages, with the second pass for ids that the texts mention."""
    out = fig.extract(page_words(spark, sf), ["manual", "page_pdf"], fig.census(chunks(spark, sf), "manual"), "manual")
    return out.select("key", "kind", "canonical_id", "extraction_method", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


def mention_census(spark, sf):
    return fig.census(chunks(spark, sf), "manual")


def coverage_report(spark, sf):
    return fig.coverage(fig.census(chunks(spark, sf), "manual"), figures(spark, sf), "manual")


def coverage_gate(spark, sf):
    return fig.gate(coverage_report(spark, sf), 0.98).select("manual", "kind", "coverage")


def rescue_candidates(spark, sf):
    c = chunks(spark, sf)
    return fig.rescue(fig.census(c, "manual"), figures(spark, sf), c, "manual")


def figure_sheets(spark, sf):
    """Crops collapsed by id: head crop by (sheet, page, key), image paths in sheet order, number of sheets."""
    f = figures(spark, sf).withColumn("cid", reference_key(F.col("canonical_id"))).withColumn("sh", F.coalesce("sheet", F.lit(1)))
    paths = F.transform(F.array_sort(F.collect_list(F.struct("sh", "page_pdf", "figure_key", "image_path"))), lambda x: x["image_path"])
    return f.groupBy("manual", "kind", "cid").agg(F.min_by("figure_key", F.struct("sh", "page_pdf", "figure_key")).alias("head_key"), paths.alias("image_paths"), F.count("*").alias("n_crops"))


def figure_kind_counts(spark, sf):
    return figures(spark, sf).groupBy("kind").agg(F.count("*").alias("n_crops"), F.countDistinct("manual", reference_key(F.col("canonical_id"))).alias("n_ids"))


def router_decisions(spark, sf):
    """Every question with the share of its five most cited sections whose chunks cite figures."""
    runs = table(spark, sf, "runs").dropDuplicates(["record_id"])
    cited = runs.select("question_id", F.explode(F.regexp_extract_all("answer", F.lit(r"Section ([0-9A-Z]+\.[0-9]+)"), F.lit(1))).alias("section_id")).groupBy("question_id", "section_id").agg(F.count("*").alias("n"))
    top = cited.withColumn("rn", F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("n").desc(), "section_id"))).where("rn <= 5")
    cites = chunks(spark, sf).groupBy("section_id").agg(F.bool_or(F.size("figure_refs") > 0).alias("cites"))
    prior = top.join(cites, "section_id", "left").groupBy("question_id").agg(F.avg(F.coalesce("cites", F.lit(False)).cast("double")).alias("prior"))
    q = table(spark, sf, "questions").join(prior, "question_id", "left")
    return router.route(q, prior="prior").select("question_id", "needs_figures", "confidence", "max_figures", "soft_score", "rules_fired")


QUERIES = {f.__name__: f for f in (segment_paragraphs, outline_carry_forward, sections_on_pages, toc_page_guard, figure_regions, figure_regions_v1, caption_dedup, caption_detect, extract_figures, mention_census, coverage_report, coverage_gate, rescue_candidates, figure_sheets, figure_kind_counts, router_decisions)}

_LINES = f"""{C}, n AS (SELECT *, {KIND} AS kind, row_number() OVER (PARTITION BY manual, section_id ORDER BY page_pdf NULLS FIRST, ordinal NULLS FIRST, chunk_id) AS nth FROM c),
ln AS (SELECT manual, section_id, nth, page_pdf AS page, list_concat(CASE WHEN nth = 1 THEN ['Section ' || section_id || ' ' || coalesce(section_title, 'Untitled')] ELSE [] END, list_concat([kind || ':', printf('%02d', ordinal)], string_split(text, chr(10)))) AS a FROM n),
lines AS (SELECT manual, section_id, page, nth * 1000000 + generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS line FROM ln)"""
_title = lambda c: f"array_to_string(list_transform(regexp_extract_all({c}, '\\pL+|\\PL+'), lambda x: upper(x[1]) || lower(x[2:])), '')"
_OUT = f"""{C}, o0 AS (SELECT manual, part AS title, min(page_pdf) AS page, 1 AS level FROM c WHERE part IS NOT NULL GROUP BY ALL UNION ALL SELECT manual, chapter, min(page_pdf), 2 FROM c WHERE chapter IS NOT NULL GROUP BY ALL
UNION ALL SELECT manual, 'Section ' || section_id || ' ' || coalesce(section_title, 'Untitled'), min(page_pdf), 3 FROM c GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY manual ORDER BY page, level, title) AS pos, CASE WHEN regexp_matches(trim(title), '{segment.PART}') THEN 'part' WHEN regexp_matches(trim(title), '{segment.CHAPTER}') THEN 'chapter' WHEN level = 3 THEN 'section' END AS kind FROM o0),
h0 AS (SELECT *, last_value(CASE WHEN kind = 'part' THEN {_title('trim(title)')} END IGNORE NULLS) OVER w AS part, last_value(CASE WHEN kind = 'chapter' THEN {_title('trim(title)')} END IGNORE NULLS) OVER w AS chapter FROM o WINDOW w AS (PARTITION BY manual ORDER BY pos ROWS UNBOUNDED PRECEDING)),
h AS (SELECT manual, regexp_extract(title, '{segment.SECTION}', 1) AS section_id, part, chapter, page AS start_page, coalesce(lead(page) OVER (PARTITION BY manual ORDER BY pos), (SELECT max(page_pdf) + 1 FROM c WHERE c.manual = h0.manual)) AS end_page FROM h0 WHERE kind = 'section')"""
_CAPS = f"{FIG}, cap AS (SELECT manual, page_pdf, figure_key AS key, kind, {REF_KEY.format('canonical_id')} AS canonical_id, sheet, bbox[2] AS y_top, bbox[2] + 10 + figure_key % 3 * 4 AS y_bot, bbox[1] AS x_left, bbox[1] >= 0.45::DOUBLE * 612 AS inset FROM f WHERE len(bbox) = 4), k AS (SELECT * FROM cap QUALIFY row_number() OVER (PARTITION BY manual, page_pdf, kind, canonical_id, coalesce(sheet, -1) ORDER BY inset, y_top, x_left, key) = 1)"
_WORDS = f"{FIG}, cap AS (SELECT manual, page_pdf, figure_key AS key, kind, canonical_id, sheet, 'Layout no' || figure_key AS title, CASE WHEN figure_key % 2 = 1 THEN 300.0 ELSE 40.0 END::DOUBLE AS x_left, figure_key % 2 = 1 AS inset, (60.0 + 34.0 * n)::DOUBLE AS y_top, (60.0 + 34.0 * n + 10 + figure_key % 3 * 4)::DOUBLE AS y_bot FROM (SELECT *, row_number() OVER (PARTITION BY manual, page_pdf ORDER BY figure_key) AS n FROM (SELECT * EXCLUDE (canonical_id), {REF_KEY.format('canonical_id')} AS canonical_id FROM f) WHERE regexp_matches(canonical_id, '^[0-9]+[A-Z]{{0,2}}-\\d+$')))"
_CENSUS = f"""{C}, l0 AS (SELECT manual, unnest(string_split({_SPACED.format('text')}, chr(10))) AS line FROM c), m0 AS (SELECT manual, regexp_matches(line, '{text.EXTERNAL}') AS external, unnest(regexp_extract_all(line, '{text.MENTION}', 0)) AS m FROM l0),
census AS (SELECT manual, CASE WHEN lower(m) LIKE 'figure%' THEN 'Figure' ELSE 'Table' END AS kind, {REF_KEY.format('m')} AS canonical_id, bool_and(external) AS external, count(*) AS n_mentions FROM m0 GROUP BY 1, 2, 3)"""
_COV = f"""{_CENSUS}, {FIG}, got AS (SELECT DISTINCT manual, kind, {REF_KEY.format('canonical_id')} AS canonical_id FROM f),
b AS (SELECT coalesce(a.manual, g.manual) AS manual, coalesce(a.kind, g.kind) AS kind, (a.manual IS NOT NULL AND NOT external)::INT AS own, (g.manual IS NOT NULL)::INT AS got, coalesce(external::INT, 0) AS ext FROM census a FULL JOIN got g ON a.manual = g.manual AND a.kind = g.kind AND a.canonical_id = g.canonical_id),
cov AS (SELECT manual, kind, sum(own)::BIGINT AS mentioned, sum(got)::BIGINT AS extracted, sum(own * (1 - got))::BIGINT AS missing, sum(got * (1 - own))::BIGINT AS extra, sum(ext)::BIGINT AS external, CASE WHEN sum(own) > 0 THEN round((sum(own) - sum(own * (1 - got))) / sum(own), 6) ELSE 1.0::DOUBLE END AS coverage FROM b GROUP BY 1, 2)"""
_is = lambda p: f"regexp_matches(q, '{p}')"
ORACLE = {
    "segment_paragraphs": f"""WITH {_LINES}, a AS (SELECT *, trim(line, ' ') AS s FROM lines), b AS (SELECT *, regexp_extract(s, '{segment.SECTION}', 1) AS head FROM a WHERE s <> '' AND NOT regexp_matches(s, '{segment.NOISE}')),
d AS (SELECT *, head <> '' AND head = section_id AS own, (head <> '' AND head <> section_id) OR regexp_matches(s, '{segment.CHAPTER}') OR regexp_matches(s, '{segment.PART}') AS stop FROM b),
e AS (SELECT *, min(pos) FILTER (own) OVER w AS start_pos FROM d WINDOW w AS (PARTITION BY manual, section_id)), e2 AS (SELECT *, min(pos) FILTER (stop) OVER w AS stop_pos, max(row(pos, page)) OVER w AS lastp, min(row(pos, page)) FILTER (stop) OVER w AS stopp FROM e WHERE pos >= start_pos WINDOW w AS (PARTITION BY manual, section_id)),
g AS (SELECT *, nullif(regexp_extract(s, '{segment.RULE}', 1), '') AS r, TRY_CAST(nullif(regexp_extract(s, '{segment.NUMBER}', 1), '') AS INT) AS n FROM e2 WHERE stop_pos IS NULL OR pos < stop_pos),
h AS (SELECT *, (own OR r IS NOT NULL OR n IS NOT NULL)::INT AS bound, (own OR r IS NOT NULL)::INT AS reset FROM g),
i AS (SELECT *, sum(bound) OVER w AS seg, sum(reset) OVER w AS state, first_value(CASE WHEN bound = 1 THEN page END IGNORE NULLS) OVER x AS np, first_value(CASE WHEN bound = 1 THEN own END IGNORE NULLS) OVER x AS nown FROM h WINDOW w AS (PARTITION BY manual, section_id ORDER BY pos ROWS UNBOUNDED PRECEDING), x AS (PARTITION BY manual, section_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
j AS (SELECT *, last_value(r IGNORE NULLS) OVER w AS rule, last_value(n IGNORE NULLS) OVER w AS ordinal FROM i WINDOW w AS (PARTITION BY manual, section_id, state ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT manual, section_id, any_value(rule) AS rule, any_value(ordinal) AS ordinal, arg_max(coalesce(np, stopp[2], lastp[2]), pos) AS page, sha256({DASH.format("trim(regexp_replace(string_agg(s, ' ' ORDER BY pos), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ')")}) AS text_sha
FROM j WHERE bound = 0 AND rule IS NOT NULL AND ordinal IS NOT NULL AND NOT coalesce(nown, false) GROUP BY manual, section_id, seg""",
    "outline_carry_forward": f"WITH {_OUT} SELECT * FROM h",
    "sections_on_pages": f"WITH {_OUT}, p AS (SELECT manual, section_id, unnest(range(start_page, end_page + 1)) AS page FROM h WHERE end_page >= start_page), n AS (SELECT manual, page_pdf AS page, count(*) AS n FROM c GROUP BY 1, 2) SELECT manual, section_id, count(*) AS n_pages, sum(n)::BIGINT AS n_chunks FROM p JOIN n USING (manual, page) GROUP BY 1, 2",
    "toc_page_guard": f"WITH {_LINES} SELECT manual, page, count(*) AS n_lines, count(*) FILTER (regexp_matches(line, '\\.{{4,}}')) AS n_leaders, count(*) FILTER (regexp_matches(line, '\\.{{4,}}')) >= 2 AS is_toc FROM lines GROUP BY 1, 2",
    "figure_regions": f"""WITH {_CAPS}, w AS (SELECT *, list_min(list_filter(list(y_top) OVER (PARTITION BY manual, page_pdf), lambda v: v > y_bot + 1)) AS below, list(x_left) OVER (PARTITION BY manual, page_pdf ORDER BY y_top RANGE BETWEEN 5.9999999 PRECEDING AND 5.9999999 FOLLOWING) AS r FROM k),
x AS (SELECT *, CASE WHEN inset THEN greatest(22.0, x_left - 10) ELSE 22.0 END AS a0, list_min(list_filter(r, lambda v: v > x_left)) AS rt, len(list_filter(r, lambda v: v < x_left)) > 0 AS lf FROM w),
y AS (SELECT key, CASE WHEN lf THEN greatest(a0, x_left - 10) ELSE a0 END AS x0, y_bot + 4 AS y0, least(590.0, coalesce(rt - 8, 590.0)) AS x1, least(746.0, coalesce(below - 6, 746.0)) AS y1 FROM x)
SELECT key, round(x0, 6)::DOUBLE AS x0, round(y0, 6)::DOUBLE AS y0, round(x1, 6)::DOUBLE AS x1, round(y1, 6)::DOUBLE AS y1 FROM y WHERE y1 - y0 >= 60 AND x1 - x0 >= 80""",
    "figure_regions_v1": f"""WITH {_CAPS}, w AS (SELECT *, list_max(list_filter(list(y_bot) OVER (PARTITION BY manual, page_pdf), lambda v: v <= y_top)) AS above, list_min(list_filter(list(y_top) OVER (PARTITION BY manual, page_pdf), lambda v: v >= y_bot)) AS below FROM cap),
x AS (SELECT key, kind, CASE kind WHEN 'Figure' THEN greatest(30.0, coalesce(above + 8, 30.0)) ELSE y_bot + 4 END AS y0, CASE kind WHEN 'Figure' THEN y_top - 4 ELSE least(762.0, coalesce(below - 8, 762.0)) END AS y1 FROM w) SELECT key, kind, round(y0, 6)::DOUBLE AS y0, round(y1, 6)::DOUBLE AS y1 FROM x WHERE y1 - y0 >= 60""",
    "caption_dedup": f"WITH {_CAPS} SELECT key, kind, canonical_id, sheet FROM k",
    "caption_detect": f"WITH {_WORDS} SELECT key, kind, canonical_id, sheet, title, x_left, inset FROM cap",
    "extract_figures": f"""WITH {_WORDS}, {_CENSUS}, k AS (SELECT * FROM cap QUALIFY row_number() OVER (PARTITION BY manual, page_pdf, kind, canonical_id, coalesce(sheet, -1) ORDER BY inset, y_top, x_left, key) = 1),
r AS (SELECT *, least(746.0, coalesce(list_min(list_filter(list(y_top) OVER (PARTITION BY manual, page_pdf), lambda v: v > y_bot + 1)) - 6, 746.0)) AS y1, y_bot + 4 AS y0, CASE WHEN inset THEN 290.0 ELSE 22.0 END AS x0, 590.0 AS x1 FROM k),
one AS (SELECT * FROM r WHERE y1 - y0 >= 60), miss AS (SELECT manual, kind, canonical_id FROM census WHERE NOT external EXCEPT SELECT manual, kind, canonical_id FROM one), u AS (SELECT *, 'caption_below_v2' AS extraction_method FROM one UNION ALL SELECT *, 'caption_below_v2_rescued' FROM r SEMI JOIN miss USING (manual, kind, canonical_id) WHERE y1 - y0 >= 24)
SELECT key, kind, canonical_id, extraction_method, round(x0, 6)::DOUBLE AS x0, round(y0, 6)::DOUBLE AS y0, round(x1, 6)::DOUBLE AS x1, round(y1, 6)::DOUBLE AS y1 FROM u""",
    "mention_census": f"WITH {_CENSUS} SELECT * FROM census",
    "coverage_report": f"WITH {_COV} SELECT * FROM cov",
    "coverage_gate": f"WITH {_COV} SELECT manual, kind, coverage FROM cov WHERE kind = 'Figure' AND coverage < 0.98",
    "rescue_candidates": f"""WITH {_CENSUS}, {FIG}, got AS (SELECT DISTINCT manual, kind, {REF_KEY.format('canonical_id')} AS canonical_id FROM f), miss AS (SELECT manual, kind, canonical_id FROM census a WHERE NOT external AND NOT EXISTS (SELECT 1 FROM got g WHERE g.manual = a.manual AND g.kind = a.kind AND g.canonical_id = a.canonical_id)),
t AS (SELECT manual, page_pdf AS page, unnest(regexp_extract_all({_SPACED.format('text')}, '(?i)((?:Figure|Table)\\s+[0-9]+[A-Z]{{0,2}}-\\d+)\\.', 1)) AS m FROM c), s AS (SELECT DISTINCT manual, page, CASE WHEN lower(m) LIKE 'figure%' THEN 'Figure' ELSE 'Table' END AS kind, {REF_KEY.format('m')} AS canonical_id FROM t)
SELECT manual, kind, canonical_id, page FROM miss JOIN s USING (manual, kind, canonical_id)""",
    "figure_sheets": f"WITH {FIG}, g AS (SELECT *, {REF_KEY.format('canonical_id')} AS cid, coalesce(sheet, 1) AS sh FROM f) SELECT manual, kind, cid, arg_min(figure_key, row(sh, page_pdf, figure_key)) AS head_key, list(image_path ORDER BY sh, page_pdf, figure_key) AS image_paths, count(*) AS n_crops FROM g GROUP BY 1, 2, 3",
    "figure_kind_counts": f"WITH {FIG} SELECT kind, count(*) AS n_crops, count(DISTINCT (manual, {REF_KEY.format('canonical_id')})) AS n_ids FROM f GROUP BY 1",
    "router_decisions": f"""WITH {C}, r AS (SELECT DISTINCT record_id, question_id, answer FROM runs), s AS (SELECT question_id, unnest(regexp_extract_all(answer, 'Section ([0-9A-Z]+\\.[0-9]+)', 1)) AS section_id FROM r), n AS (SELECT question_id, section_id, count(*) AS n FROM s GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY count(*) DESC, section_id) <= 5),
ci AS (SELECT section_id, bool_or(coalesce(len(figure_refs), 0) > 0) AS cites FROM c GROUP BY 1), p AS (SELECT question_id, avg(coalesce(cites, false)::INT::DOUBLE) AS prior FROM n LEFT JOIN ci USING (section_id) GROUP BY 1),
x AS (SELECT question_id, trim(question) AS q, coalesce(prior, 0) AS frac FROM questions LEFT JOIN p USING (question_id)),
y AS (SELECT *, {_is(router.EXPLICIT_ID)} AS ex, {_is(router.VISUAL_VERB)} AS vb, {_is(router.SIGN_CODE)} AS cd, {_is(router.VISUAL_NOUN)} AS nn, {_is(router.TEXTUAL)} AS tx, {_is(router.PLACEMENT)} AS pl FROM x),
z AS (SELECT *, 0.45::DOUBLE * cd::INT + 0.30::DOUBLE * nn::INT - 0.35::DOUBLE * tx::INT + 0.15::DOUBLE * pl::INT + 0.35::DOUBLE * frac AS sc, tx AND NOT nn AND NOT cd AS no FROM y), v AS (SELECT *, round(sc, 6) >= 0.5 AS soft FROM z)
SELECT question_id, CASE WHEN ex OR vb THEN true WHEN no THEN false ELSE soft END AS needs_figures, round(CASE WHEN ex THEN 0.99::DOUBLE WHEN vb THEN 0.95 WHEN no THEN 0.9 ELSE least(0.9, 0.5 + abs(sc - 0.5)) END, 6) AS confidence,
CASE WHEN ex OR vb THEN 4 WHEN no THEN 0 WHEN soft THEN 3 ELSE 0 END AS max_figures, round(CASE WHEN ex OR vb OR no THEN 0.0 ELSE sc END, 6) AS soft_score,
CASE WHEN ex THEN ['hard_yes:explicit_figure_id'] WHEN vb THEN ['hard_yes:visual_verb'] WHEN no THEN ['hard_no:textual_pattern_no_visual_evidence'] ELSE list_filter([CASE WHEN cd THEN 'sign_code' END, CASE WHEN nn THEN 'visual_noun' END, CASE WHEN tx THEN 'textual_pattern' END, CASE WHEN pl THEN 'placement_verb' END, CASE WHEN frac > 0 THEN 'kg_prior' END, CASE WHEN soft THEN 'soft:yes' ELSE 'soft:no' END], lambda r: r IS NOT NULL) END AS rules_fired FROM v""",
}
