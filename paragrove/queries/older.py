"""Queries of first-generation retrieval, encoders and collections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paragrove.functions import text
from paragrove.operators import graph, lexical
from paragrove.queries.graph import G, _K, built
from paragrove.queries.text import C, FIG, chunks, figures
from paragrove.runtime import Shelf, table
from paragrove.sources import collections, files


def _pages(spark, sf):
    """Page records with their text."""
    c = chunks(spark, sf)
    t = c.groupBy("manual", F.col("page_pdf").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["text"]), " ").alias("text"))  # the chunks of one page
    return lexical.page_records(c, figures(spark, sf)).join(t, ["manual", "page"])


def _topics(spark, sf):
    """What is asked: the title of every section."""
    return chunks(spark, sf).where("section_title IS NOT NULL").select(F.col("section_title").alias("query")).distinct().withColumn("qid", F.col("query"))


def page_boosts(spark, sf):
    """Pages of every section, with what they gain for its title."""
    c = chunks(spark, sf).where("section_title IS NOT NULL").select("manual", F.col("page_pdf").alias("page"), F.col("section_title").alias("query")).distinct()
    rows = c.join(_pages(spark, sf), ["manual", "page"])
    return rows.select("manual", "page", "query", F.round(lexical.page_boost(F.col("query"), F.col("text")), 6).alias("boost"))


def hybrid_pages(spark, sf):
    """Pages of every section title's sections, five after the caption boost; the base score is the title's share of the page's chunks."""
    c = chunks(spark, sf)
    n = c.groupBy("manual", F.col("page_pdf").alias("page")).agg(F.count("*").alias("n"))
    s = c.where("section_title IS NOT NULL").groupBy(F.col("section_title").alias("qid"), "manual", F.col("page_pdf").alias("page")).agg(F.count("*").alias("m")).join(n, ["manual", "page"]).select("qid", "manual", "page", (F.col("m") / F.col("n") / 4).alias("score"))
    out = lexical.hybrid_pages(s, _topics(spark, sf), lexical.page_records(c, figures(spark, sf)), ["manual", "page"])
    return out.select("qid", "manual", "page", "rank", F.round("score", 6).alias("score"))


def joined_context(spark, sf):
    """The context of every section from its chunks."""
    c = chunks(spark, sf).where("text IS NOT NULL").withColumn("qid", F.concat_ws("/", "manual", "section_id"))
    hits = c.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("ordinal", "chunk_id"))).select("qid", "rank", "text")
    return lexical.joined_context(hits).select("qid", F.sha2("context", 256).alias("sha"))


def extractive_answers(spark, sf):
    """Every question answered by the sentences of its recorded answers, with the runs that they stand in."""
    r = table(spark, sf, "runs").where("answer IS NOT NULL")
    s = r.select(F.col("question_id").alias("qid"), F.explode(text.sentences(F.col("answer"))).alias("sentence"), F.col("run_id").alias("source")).distinct()
    q = table(spark, sf, "questions").select(F.col("question_id").alias("qid"), "question")
    return lexical.extractive_answer(q, s).select("qid", F.sha2("answer", 256).alias("sha"), "citations")


def encode_cache(spark, sf):
    """How many titles come from the cache and how many are encoded, when a third of the cached texts has changed."""
    items = chunks(spark, sf).where("section_title IS NOT NULL").select(F.concat_ws("/", "manual", "section_id").alias("id"), F.col("section_title").alias("text")).groupBy("id").agg(F.min("text").alias("text"))
    encode = collections.hashed_encoder()
    old = items.withColumn("text", F.when(F.crc32(F.col("id").cast("binary")) % 3 == 0, F.concat("text", F.lit(" (old)"))).otherwise(F.col("text")))
    cache = Shelf(spark).keep(collections.encode_missing(old, encode(old.limit(0)).withColumn("content_sha", F.lit("")), encode), "cache")
    now = collections.encode_missing(items, cache, encode)
    return now.join(cache.select("id", F.col("content_sha").alias("cached")), "id").select("id", (F.col("content_sha") == F.col("cached")).alias("from_cache"), (F.round(F.aggregate("dense", F.lit(0.0), lambda a, x: a + x * x), 4) == 1).alias("unit"), F.aggregate(F.map_values("sparse"), F.lit(0.0), lambda a, x: a + x).alias("n_tokens"))


def collection_round_trip(spark, sf):
    """The figure collection created, filled, upserted again and read."""
    root = Shelf(spark).root
    collections.create(spark, root)
    rows = table(spark, sf, "vec_figures").select("id", "dense", F.struct("payload.manual", "payload.figure_id", "payload.kind", "payload.page_pdf").alias("payload"), F.col("upserted_at").cast("timestamp_ntz").alias("upserted_at"))
    for _ in range(2):
        collections.upsert(spark, root, "figures", rows)
    ready = collections.readiness(spark, root, {"figures": "payload.figure_id IS NOT NULL", "pages": "true"})
    return collections.read(spark, root, "figures").select("id", F.size("dense").alias("n"), "upserted_at", F.lit(ready["figures"]).alias("figures_ready"), F.lit(ready["pages"]).alias("pages_ready"))


def figure_payloads(spark, sf):
    p = collections.figure_payload(figures(spark, sf), built(spark, sf).nodes)
    return p.select("id", "kind", "canonical_id", "figure_id", "page_pdf", "chapter", "image_paths", "n_sheets")


def whole_texts(spark, sf):
    """The text of every manual's pages, joined by form feeds."""
    p = _pages(spark, sf)
    return files.whole_text(p, "manual", "page", "text").select("manual", F.sha2("text", 256).alias("sha"))


def kg_lookup(spark, sf):
    """Every figure id as it is spelled in the figure table, found in the graph, with its label."""
    g = built(spark, sf)
    names = figures(spark, sf).select("manual", F.concat(F.lit("figure:"), "kind", F.lit(" "), F.lower("canonical_id")).alias("name")).where(F.col("name").rlike(r"^figure:\w+ \d+[a-z]{0,2}-\d+$")).distinct()
    return graph.lookup_figures(names, g.nodes).join(g.nodes.select("id", "kind", "title"), "id", "left").select("manual", "name", "id", graph.display_label(F.col("kind"), F.col("id"), F.col("title")).alias("label"))


def kg_citations(spark, sf):
    """Citations of any kind in the answers, and whether the graph knows them."""
    r = table(spark, sf, "runs").dropDuplicates(["record_id"]).select("record_id", F.translate("answer", "‐‑‒–—", "-----").alias("a"))
    pick = lambda kind, pattern: r.select("record_id", F.lit(kind).alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all("a", F.lit(pattern), F.lit(1)))).alias("name"))
    cited = pick("section", r"Section ([0-9]+[A-Z]\.[0-9]+)").unionByName(pick("figure", r"Figure ([0-9A-Z]+-[0-9]+)")).unionByName(pick("signcode", r"\(([A-Z]{1,3}\d{1,3}-\d{1,3}[a-z]?P?)\)"))
    return graph.known_citations(cited, built(spark, sf).nodes).groupBy("kind", "known").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (page_boosts, hybrid_pages, joined_context, extractive_answers, encode_cache, collection_round_trip, figure_payloads, whole_texts, kg_lookup, kg_citations)}

_PAGES = f"""{C}, {FIG}, a AS (SELECT manual, page_pdf AS page, string_agg(coalesce(text, ''), ' ' ORDER BY chunk_id) FILTER (text IS NOT NULL) AS text, list_sort(list_distinct(flatten(list(coalesce(sign_codes, [])))))[1:50] AS sign_codes FROM c GROUP BY 1, 2),
b AS (SELECT manual, page_pdf AS page, list_sort(list_distinct(list(caption) FILTER (kind = 'Figure')))[1:3] AS figure_captions, list_sort(list_distinct(list(caption) FILTER (kind = 'Table')))[1:3] AS table_titles FROM f GROUP BY 1, 2),
pg AS (SELECT manual, page, coalesce(text, '') AS text, sign_codes, coalesce(figure_captions, []) AS figure_captions, coalesce(table_titles, []) AS table_titles FROM a LEFT JOIN b USING (manual, page))"""
_m = lambda c: f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"
_VISUAL = "(" + " OR ".join(f"contains(lower(query), '{t}')" for t in lexical.VISUAL_TERMS) + ")"
_has = lambda c, hit, there: f"CASE WHEN contains({_m(f'array_to_string({c}, chr(32) || chr(124) || chr(32))')}, q) THEN {hit}::DOUBLE ELSE 0 END + CASE WHEN {_VISUAL} AND len({c}) > 0 THEN {there}::DOUBLE ELSE 0 END"
_SENT = r"list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(answer, '[\r\n]', ' ', 'g'), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: length(s) > 20)"
_words = lambda c: f"list_distinct(list_filter(string_split_regex(lower({c}), '[^\\pL\\pN]+'), lambda w: w <> ''))"
ORACLE = {
    "page_boosts": f"""WITH {_PAGES}, s AS (SELECT DISTINCT manual, page_pdf AS page, section_title AS query FROM c WHERE section_title IS NOT NULL), x AS (SELECT *, {_m('query')} AS q FROM s JOIN pg USING (manual, page))
SELECT manual, page, query, round(CASE WHEN q <> '' AND contains({_m('text')}, q) THEN 0.10::DOUBLE ELSE 0 END + {_has('figure_captions', 0.30, 0.08)} + {_has('table_titles', 0.25, 0.06)} + {_has('sign_codes', 0.16, 0.04)}, 6) AS boost FROM x""",
    "hybrid_pages": f"""WITH {_PAGES}, n AS (SELECT manual, page_pdf AS page, count(*) AS n FROM c GROUP BY 1, 2), s AS (SELECT section_title AS qid, manual, page_pdf AS page, count(*) AS m FROM c WHERE section_title IS NOT NULL GROUP BY 1, 2, 3),
x AS (SELECT qid, manual, page, m / n / 4 + CASE WHEN len(list_filter(string_split_regex(lower(qid), '\\s+'), lambda w: w <> '' AND contains(lower(array_to_string(figure_captions, ' ')), w))) > 0 THEN 0.3::DOUBLE ELSE 0 END AS score FROM s JOIN n USING (manual, page) JOIN pg USING (manual, page))
SELECT qid, manual, page, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, manual, page) AS rank, round(score, 6) AS score FROM x QUALIFY rank <= 5""",
    "joined_context": f"""WITH {C}, h AS (SELECT manual || '/' || section_id AS qid, row_number() OVER (PARTITION BY manual, section_id ORDER BY ordinal NULLS FIRST, chunk_id) AS rank, trim(regexp_replace(regexp_replace(text, '(Standard|Option|Guidance):?\\s*\\d*', '', 'g'), '\\s+', ' ', 'g'), ' ') AS t FROM c WHERE text IS NOT NULL),
d AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY qid, left(t, 200) ORDER BY rank) = 1), e AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= 3) SELECT qid, sha256(string_agg(t, chr(10) || chr(10) ORDER BY rank)) AS sha FROM e GROUP BY 1""",
    "extractive_answers": f"""WITH s AS (SELECT question_id AS qid, unnest({_SENT}) AS sentence, run_id FROM runs WHERE answer IS NOT NULL), o AS (SELECT qid, sentence, min(run_id) AS source FROM s GROUP BY 1, 2), x AS (SELECT qid, sentence, source, row_number() OVER (PARTITION BY qid ORDER BY len(list_intersect({_words('question')}, {_words('sentence')})) DESC, sentence) AS n FROM o JOIN questions q ON q.question_id = qid QUALIFY n <= 5),
y AS (SELECT qid, source, min(n) AS n FROM x GROUP BY 1, 2), z AS (SELECT qid, list(source ORDER BY n) AS citations FROM y GROUP BY 1) SELECT qid, sha256(string_agg(sentence, ' ' ORDER BY n)) AS sha, any_value(citations) AS citations FROM x JOIN z USING (qid) GROUP BY qid""",
    "collection_round_trip": "SELECT id, len(dense) AS n, upserted_at, true AS figures_ready, false AS pages_ready FROM vec_figures QUALIFY row_number() OVER (PARTITION BY id ORDER BY upserted_at DESC) = 1",
    "figure_payloads": f"""WITH {G}, x AS (SELECT CASE kind WHEN 'Figure' THEN 'figure:' ELSE 'table:' END || manual || '/' || {_K('canonical_id')} AS id, kind, {_K('canonical_id')} AS cid, *  EXCLUDE (kind), row(coalesce(sheet, 1), coalesce(page_pdf, -1), figure_key) AS o FROM f)
SELECT id, kind, cid AS canonical_id, arg_min(figure_id, o) AS figure_id, arg_min(row(page_pdf), o)[1] AS page_pdf, coalesce(nullif(arg_min(row(chapter), o)[1], ''), split_part(cid, '-', 1)) AS chapter, list(image_path ORDER BY o) AS image_paths, count(*)::INT AS n_sheets FROM x GROUP BY id, kind, cid""",
    "whole_texts": f"WITH {_PAGES} SELECT manual, sha256(string_agg(text, chr(12) ORDER BY page)) AS sha FROM pg GROUP BY 1",
    "kg_lookup": f"""WITH {G}, x AS (SELECT DISTINCT manual, 'figure:' || kind || ' ' || lower(canonical_id) AS name, kind, {_K('canonical_id')} AS ref FROM f WHERE regexp_matches('figure:' || kind || ' ' || lower(canonical_id), '^figure:\\w+ \\d+[a-z]{{0,2}}-\\d+$')) SELECT manual, name, CASE kind WHEN 'Figure' THEN 'figure:' ELSE 'table:' END || manual || '/' || ref AS id, kind || ' ' || ref AS label FROM x""",
    "kg_citations": f"""WITH {G}, r AS (SELECT DISTINCT record_id, translate(answer, '‐‑‒–—', '-----') AS a FROM runs), x AS (SELECT 'section' AS kind, unnest(list_distinct(regexp_extract_all(a, 'Section ([0-9]+[A-Z]\\.[0-9]+)', 1))) AS k FROM r UNION ALL SELECT 'figure', unnest(list_distinct(regexp_extract_all(a, 'Figure ([0-9A-Z]+-[0-9]+)', 1))) FROM r UNION ALL SELECT 'signcode', unnest(list_distinct(regexp_extract_all(a, '\\(([A-Z]{{1,3}}\\d{{1,3}}-\\d{{1,3}}[a-z]?P?)\\)', 1))) FROM r),
h AS (SELECT DISTINCT split_part(id, ':', 1) AS kind, CASE WHEN kind = 'SignCode' THEN upper(split_part(id, ':', 2)) ELSE split_part(id, '/', 2) END AS k FROM nodes WHERE NOT unresolved AND kind IN ('Figure', 'Table', 'Section', 'SignCode')) SELECT kind, (kind, upper(k)) IN (SELECT (kind, k) FROM h) AS known, count(*) AS n FROM x GROUP BY 1, 2""",
}
