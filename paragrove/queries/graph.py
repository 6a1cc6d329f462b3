"""Queries of the property graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paragrove.operators import graph
from paragrove.queries.text import C, CATEGORY, FIG, REF_KEY, chunks, figures
from paragrove.runtime import Shelf, table


_BUILT: dict[tuple, str] = {}


def fingerprint(spark, sf, *names) -> tuple:
    """Session, files, sizes and times of tables: the same as long as they are."""
    hadoop, out = spark._jvm.org.apache.hadoop.fs, [spark.sparkContext.applicationId]
    for name in names:
        path = hadoop.Path(f"{sf}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        out += [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in files]
    return tuple(out)


def _there(spark, root: str, name: str) -> bool:
    """Whether a table of a graph is complete."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def built(spark, sf, names=("nodes", "edges")):
    """The graph of a data directory, or one table of it, built once a session and read by every query after that, as long as its files are the same."""
    key = fingerprint(spark, sf, "chunks", "figures")
    lack = [n for n in names if (key, n) not in _BUILT or not _there(spark, _BUILT[key, n], n)]
    if lack:
        shelf = Shelf(spark)
        g = graph.build(chunks(spark, sf), figures(spark, sf))
        for n in lack:
            shelf.keep(getattr(g, n), n)
            _BUILT[key, n] = shelf.root
    return graph.Graph(*[spark.read.parquet(f"{_BUILT[key, n]}/{n}") if n in names else None for n in ("nodes", "edges")])


def kg_nodes(spark, sf):
    return built(spark, sf).nodes


def kg_edges(spark, sf):
    return built(spark, sf).edges


def kg_kind_counts(spark, sf):
    g = built(spark, sf)
    return g.nodes.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("unresolved").cast("bigint")).alias("n_unresolved"))


def kg_label_counts(spark, sf):
    return built(spark, sf).edges.groupBy("label").agg(F.count("*").alias("n"))


def kg_build_stats(spark, sf):
    g = built(spark, sf)
    n = g.nodes.agg(F.count("*").alias("nodes"), F.sum((F.col("kind").isin("Figure", "Table") & ~F.col("unresolved")).cast("bigint")).alias("resolved_figures"), F.sum(F.col("unresolved").cast("bigint")).alias("unresolved"))
    sample = g.nodes.where("unresolved").orderBy("id").limit(20).agg(F.array_sort(F.collect_list("id")).alias("unresolved_sample"))
    e = g.edges.agg(F.count("*").alias("edges"), F.sum((F.col("label") == "anchored_in").cast("bigint")).alias("anchored"))
    return n.join(F.broadcast(e)).join(F.broadcast(sample))  # three results of one row


def kg_anchor(spark, sf):
    return graph.anchors(graph.exploded_refs(chunks(spark, sf)), figures(spark, sf))


def kg_signcode_backfill(spark, sf):
    """Codes of a figure: those of chunks that cite it and of chunks on its page."""
    c = chunks(spark, sf)
    f = figures(spark, sf)
    codes = c.select("manual", "chunk_id", "page_pdf", F.explode("sign_codes").alias("code")).select("manual", "chunk_id", "page_pdf", F.upper(F.trim("code")).alias("code")).where("code <> ''")
    refs = graph.exploded_refs(c).select("manual", "chunk_id", "kind", "ref")
    have = f.select("manual", "kind", graph.reference_key(F.col("canonical_id")).alias("ref"), "page_pdf").distinct()
    citing = refs.join(have.select("manual", "kind", "ref").distinct(), ["manual", "kind", "ref"], "left_semi").join(codes.select("manual", "chunk_id", "code"), ["manual", "chunk_id"]).select("manual", "kind", "ref", "code")
    same = have.join(codes, ["manual", "page_pdf"]).select("manual", "kind", "ref", "code")
    return citing.unionByName(same).groupBy("manual", "kind", "ref").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def kg_degree_top15(spark, sf):
    g = built(spark, sf)
    d = graph.degrees(g.edges).join(g.nodes.where("kind IN ('Section', 'SignCode')"), "id")
    w = Window.partitionBy("kind").orderBy(F.col("degree").desc(), "id")
    return d.withColumn("rank", F.row_number().over(w)).where("rank <= 15").select("kind", "rank", "id", "degree")


def kg_nhop(spark, sf):
    """Two undirected hops around every section."""
    shelf = Shelf(spark)
    g = built(spark, sf)
    edges = shelf.keep(g.edges, "edges")
    seeds = g.nodes.where("kind = 'Section'").select(F.col("id").alias("qid"), "id")
    return graph.reach(edges, seeds, 2).groupBy("qid", "depth").agg(F.count("*").alias("n"))


def kg_proximity(spark, sf):
    """1 / (1 + hops) of every chunk of a manual to the nearest of that manual's figures, up to 6 hops."""
    edges = built(spark, sf, ("edges",)).edges
    ents = figures(spark, sf).where("kind = 'Figure'").select(F.col("manual").alias("qid"), graph.node("figure", "manual", graph.reference_key(F.col("canonical_id"))).alias("id")).distinct()
    cand = chunks(spark, sf).select(F.col("manual").alias("qid"), graph.node("chunk", "chunk_id").alias("id"))
    return graph.proximity(edges, ents, cand).groupBy("qid", F.round("score", 6).alias("score")).agg(F.count("*").alias("n"))


def kg_figures_for_section(spark, sf):
    e = built(spark, sf).edges.where("label IN ('anchored_in', 'cited_in')")
    tier = F.min(F.when(F.col("label") == "anchored_in", 0).otherwise(1))
    per = e.groupBy(F.col("dst").alias("section"), F.col("src").alias("figure")).agg(tier.alias("tier"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy("section").orderBy("tier", "figure")))


def kg_figures_for_chunk(spark, sf):
    g = built(spark, sf)
    return g.edges.where("label IN ('cites_figure', 'cites_table')").join(g.nodes.where("NOT unresolved").select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("chunk"), F.col("dst").alias("figure"))


def kg_chunks_for_code(spark, sf):
    return built(spark, sf).edges.where("label = 'mentions'").groupBy(F.col("dst").alias("code")).agg(F.count("*").alias("n_chunks"), F.min("src").alias("first_chunk"))


def kg_section_cites_figures(spark, sf):
    return chunks(spark, sf).groupBy("manual", "section_id").agg(F.bool_or(F.coalesce(F.size("figure_refs"), F.lit(0)) > 0).alias("cites_any_figure"))


def kg_overview(spark, sf):
    """Links from parts to chapters, weighted by the number of sections, at least 1."""
    c = chunks(spark, sf)
    return c.groupBy("manual", F.coalesce("part", F.lit("Part ?")).alias("part"), F.coalesce("chapter", F.lit("Chapter ?")).alias("chapter")).agg(F.greatest(F.lit(1), F.countDistinct("section_id")).alias("weight"))


def kg_neighborhood_trim(spark, sf):
    """One hop around every resolved figure, at most 8 nodes, and the edges among them."""
    shelf = Shelf(spark)
    g = built(spark, sf)
    nodes, edges = shelf.keep(g.nodes, "nodes"), shelf.keep(g.edges, "edges")
    seeds = nodes.where("kind = 'Figure' AND NOT unresolved").select(F.col("id").alias("qid"), "id")
    return graph.trim(graph.reach(edges, seeds, 1), nodes, 8).groupBy("qid").agg(F.count("*").alias("n_nodes"), F.sum((F.col("kind") == "Chunk").cast("bigint")).alias("n_chunks"))


def kg_subgraph(spark, sf):
    """Edges among sections, figures and tables."""
    g = built(spark, sf)
    return graph.induced(g.edges, g.nodes.where("kind IN ('Section', 'Figure', 'Table')").select("id")).groupBy("label").agg(F.count("*").alias("n"))


def query_entities(spark, sf):
    """Known entities that any answer to a question names, per question; nodes of one name are counted before the join."""
    answers = table(spark, sf, "runs").where("answer IS NOT NULL").select(F.col("question_id").alias("qid"), F.col("answer").alias("question"))
    known = graph.nameable(built(spark, sf).nodes).groupBy("tail").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return graph.named(answers).join(known, "tail").groupBy("qid").agg(F.sum("n").alias("n_entities"), F.min("first").alias("first_entity"))


def citation_valid(spark, sf):
    """Whether the section cited by an answer exists in any manual."""
    cites = table(spark, sf, "runs").dropDuplicates(["record_id"]).select("record_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"Section ([0-9A-Z]+\.[0-9]+)"), F.lit(1)))).alias("section_id"))
    known = chunks(spark, sf).select("section_id").distinct().withColumn("known", F.lit(True))
    return cites.join(known, "section_id", "left").groupBy("record_id").agg(F.count("*").alias("n_cited"), F.sum(F.coalesce("known", F.lit(False)).cast("bigint")).alias("n_known"))


QUERIES = {f.__name__: f for f in (kg_nodes, kg_edges, kg_kind_counts, kg_label_counts, kg_build_stats, kg_anchor, kg_signcode_backfill, kg_degree_top15, kg_nhop, kg_proximity, kg_figures_for_section, kg_figures_for_chunk, kg_chunks_for_code, kg_section_cites_figures, kg_overview, kg_neighborhood_trim, kg_subgraph, query_entities, citation_valid)}

_K = REF_KEY.format
_T = "CASE kind WHEN 'Figure' THEN 'figure:' ELSE 'table:' END || manual || '/' || ref"
G = f"""{C}, {FIG},
refs AS (SELECT DISTINCT * FROM (SELECT manual, section_id, chunk_id, page_pdf, 'Figure' AS kind, {_K('r')} AS ref FROM (SELECT *, unnest(figure_refs) AS r FROM c) UNION ALL SELECT manual, section_id, chunk_id, page_pdf, 'Table', {_K('r')} FROM (SELECT *, unnest(table_refs) AS r FROM c)) WHERE ref <> ''),
codes AS (SELECT DISTINCT manual, section_id, chunk_id, upper(trim(k)) AS code FROM (SELECT *, unnest(sign_codes) AS k FROM c) WHERE trim(k) <> ''),
secs AS (SELECT * FROM (SELECT DISTINCT manual, chunk_id, section_id, upper(regexp_replace(regexp_replace(r, '(?i)^\\s*sec(?:tion|t\\.?)?\\s*', ''), '\\s+', '', 'g')) AS ref FROM (SELECT *, unnest(section_refs) AS r FROM c)) WHERE ref <> '' AND ref <> section_id),
figs AS (SELECT manual, kind, {_K('canonical_id')} AS ref, page_pdf, page_printed, coalesce(title, caption) AS title, sheet, figure_key, sign_codes_depicted FROM f), ids AS (SELECT DISTINCT manual, kind, ref FROM figs),
fcodes AS (SELECT manual, kind, ref, upper(trim(k)) AS code FROM (SELECT *, unnest(sign_codes_depicted) AS k FROM figs) WHERE trim(k) <> ''),
cp AS (SELECT DISTINCT manual, page_pdf, code FROM codes JOIN (SELECT chunk_id, page_pdf FROM c) USING (chunk_id)),
depicted AS (SELECT manual, kind, ref, code FROM fcodes UNION SELECT r.manual, kind, ref, code FROM refs r SEMI JOIN ids USING (manual, kind, ref) JOIN codes USING (manual, chunk_id) UNION SELECT manual, kind, ref, code FROM figs JOIN cp USING (manual, page_pdf)),
pages AS (SELECT manual, page_pdf, arg_min(section_id, row(ordinal, chunk_id)) AS section_id FROM c GROUP BY 1, 2),
short AS (SELECT manual, upper(regexp_extract(chapter, '(?i)^Chapter\\s+([0-9A-Z]+)\\b', 1)) AS short, min(chapter) AS chapter FROM c WHERE chapter IS NOT NULL GROUP BY 1, 2 HAVING short <> ''),
anc AS (SELECT manual, kind, ref, section_id, count(*) AS n FROM refs SEMI JOIN ids USING (manual, kind, ref) GROUP BY manual, kind, ref, section_id QUALIFY row_number() OVER (PARTITION BY manual, kind, ref ORDER BY starts_with(upper(section_id), upper(split_part(ref, '-', 1)) || '.') DESC, count(*) DESC, section_id) = 1),
edges AS (SELECT DISTINCT * FROM (
SELECT 'part:' || manual || '/' || coalesce(part, 'Part ?') AS src, 'chapter:' || manual || '/' || coalesce(chapter, 'Chapter ?') AS dst, 'contains' AS label FROM c
UNION ALL SELECT 'chapter:' || manual || '/' || coalesce(chapter, 'Chapter ?'), 'section:' || manual || '/' || section_id, 'contains' FROM c
UNION ALL SELECT 'section:' || manual || '/' || section_id, 'chunk:' || chunk_id, 'contains' FROM c
UNION ALL SELECT 'chunk:' || chunk_id, {_T}, CASE kind WHEN 'Figure' THEN 'cites_figure' ELSE 'cites_table' END FROM refs
UNION ALL SELECT 'chunk:' || chunk_id, 'section:' || manual || '/' || ref, 'cites_section' FROM secs
UNION ALL SELECT 'chunk:' || chunk_id, 'signcode:' || code, 'mentions' FROM codes
UNION ALL SELECT 'signcode:' || code, 'category:' || {CATEGORY}, 'kind_of' FROM codes
UNION ALL SELECT 'section:' || manual || '/' || section_id, 'signcode:' || code, 'defines' FROM codes
UNION ALL SELECT {_T}, 'signcode:' || code, 'depicts' FROM depicted
UNION ALL SELECT {_T}, 'chapter:' || manual || '/' || chapter, 'belongs_to_chapter' FROM (SELECT *, upper(split_part(ref, '-', 1)) AS short FROM ids) JOIN short USING (manual, short)
UNION ALL SELECT {_T}, 'section:' || manual || '/' || section_id, 'on_page_of' FROM figs JOIN pages USING (manual, page_pdf)
UNION ALL SELECT {_T}, 'section:' || manual || '/' || section_id, 'cited_in' FROM refs SEMI JOIN ids USING (manual, kind, ref)
UNION ALL SELECT {_T}, 'section:' || manual || '/' || section_id, 'anchored_in' FROM anc) WHERE src IS NOT NULL AND dst IS NOT NULL),
n0 AS (SELECT 'part:' || manual || '/' || coalesce(part, 'Part ?') AS id, 'Part' AS kind, manual, false AS unresolved, coalesce(part, 'Part ?') AS title, NULL::INT AS page_pdf, NULL AS page_printed, NULL AS content_type, NULL::INT AS ordinal, NULL::BIGINT AS n_sheets, coalesce(page_pdf, -1) AS o1, coalesce(ordinal, -1) AS o2, chunk_id AS o3 FROM c
UNION ALL SELECT 'chapter:' || manual || '/' || coalesce(chapter, 'Chapter ?'), 'Chapter', manual, false, coalesce(chapter, 'Chapter ?'), NULL, NULL, NULL, NULL, NULL, coalesce(page_pdf, -1), coalesce(ordinal, -1), chunk_id FROM c
UNION ALL SELECT 'section:' || manual || '/' || section_id, 'Section', manual, false, section_title, page_pdf, page_printed, NULL, NULL, NULL, coalesce(page_pdf, -1), coalesce(ordinal, -1), chunk_id FROM c
UNION ALL SELECT 'chunk:' || chunk_id, 'Chunk', manual, false, NULL, page_pdf, page_printed, content_type, ordinal, NULL, coalesce(page_pdf, -1), coalesce(ordinal, -1), chunk_id FROM c
UNION ALL SELECT {_T}, kind, manual, false, arg_min(row(title), row(coalesce(sheet, 1), coalesce(page_pdf, -1), figure_key))[1], arg_min(row(page_pdf), row(coalesce(sheet, 1), coalesce(page_pdf, -1), figure_key))[1], arg_min(row(page_printed), row(coalesce(sheet, 1), coalesce(page_pdf, -1), figure_key))[1], NULL, NULL, count(*), -1, -1, '' FROM figs GROUP BY manual, kind, ref
UNION ALL SELECT DISTINCT 'signcode:' || code, 'SignCode', NULL, false, NULL, NULL, NULL, NULL, NULL, NULL::BIGINT, -1, -1, '' FROM (SELECT code FROM codes UNION SELECT code FROM fcodes) UNION ALL SELECT DISTINCT 'category:' || {CATEGORY}, 'Category', NULL, false, {CATEGORY}, NULL, NULL, NULL, NULL, NULL::BIGINT, -1, -1, '' FROM codes
UNION ALL SELECT DISTINCT {_T}, kind || 'Ref', manual, true, NULL, NULL, NULL, NULL, NULL, NULL::BIGINT, -1, -1, '' FROM refs UNION ALL SELECT DISTINCT 'section:' || manual || '/' || ref, 'SectionRef', manual, true, NULL, NULL, NULL, NULL, NULL, NULL::BIGINT, -1, -1, '' FROM secs),
nodes AS (SELECT * EXCLUDE (o1, o2, o3) FROM n0 WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY unresolved, kind, o1, o2, o3) = 1),
ug AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"""
_HOPS = ", ".join(f"s{i} AS (SELECT DISTINCT qid, b AS id FROM s{i - 1} JOIN ug ON id = a)" for i in range(1, 7))
_REACHED = " UNION ALL ".join(f"SELECT *, {i} AS d FROM s{i}" for i in range(7))
ORACLE = {
    "kg_nodes": f"WITH {G} SELECT * FROM nodes",
    "kg_edges": f"WITH {G} SELECT * FROM edges",
    "kg_kind_counts": f"WITH {G} SELECT kind, count(*) AS n, count(*) FILTER (unresolved) AS n_unresolved FROM nodes GROUP BY 1",
    "kg_label_counts": f"WITH {G} SELECT label, count(*) AS n FROM edges GROUP BY 1",
    "kg_build_stats": f"WITH {G} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE kind IN ('Figure', 'Table') AND NOT unresolved) AS resolved_figures, (SELECT count(*) FROM nodes WHERE unresolved) AS unresolved, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE label = 'anchored_in') AS anchored, (SELECT list(id ORDER BY id) FROM (SELECT id FROM nodes WHERE unresolved ORDER BY id LIMIT 20)) AS unresolved_sample",
    "kg_anchor": f"WITH {G} SELECT * FROM anc",
    "kg_signcode_backfill": f"WITH {G}, u AS (SELECT r.manual, kind, ref, code FROM refs r SEMI JOIN ids USING (manual, kind, ref) JOIN codes USING (manual, chunk_id) UNION SELECT manual, kind, ref, code FROM figs JOIN cp USING (manual, page_pdf)) SELECT manual, kind, ref, list_sort(list(DISTINCT code)) AS codes FROM u GROUP BY 1, 2, 3",
    "kg_degree_top15": f"WITH {G}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY degree DESC, id) AS rank, id, degree FROM d JOIN nodes USING (id) WHERE kind IN ('Section', 'SignCode') QUALIFY rank <= 15",
    "kg_nhop": f"""WITH {G}, s0 AS (SELECT id AS qid, id, 0 AS depth FROM nodes WHERE kind = 'Section'), s1 AS (SELECT DISTINCT qid, b AS id, 1 AS depth FROM s0 JOIN ug ON id = a), v1 AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 ANTI JOIN s0 USING (qid, id)),
s2 AS (SELECT DISTINCT qid, b AS id, 2 AS depth FROM (SELECT * FROM v1 WHERE depth = 1) JOIN ug ON id = a) SELECT qid, depth, count(*) AS n FROM (SELECT * FROM v1 UNION ALL SELECT * FROM s2 ANTI JOIN v1 USING (qid, id)) GROUP BY 1, 2""",
    "kg_proximity": f"""WITH {G}, s0 AS (SELECT DISTINCT manual AS qid, id FROM nodes WHERE kind = 'Figure' AND NOT unresolved), {_HOPS},
m AS (SELECT qid, id, min(d) AS d FROM ({_REACHED}) GROUP BY 1, 2), k AS (SELECT manual AS qid, 'chunk:' || chunk_id AS id FROM c) SELECT qid, round(CASE WHEN d IS NULL THEN 0.0::DOUBLE ELSE 1 / (1 + d) END, 6) AS score, count(*) AS n FROM k LEFT JOIN m USING (qid, id) GROUP BY 1, 2""",
    "kg_figures_for_section": f"WITH {G}, p AS (SELECT dst AS section, src AS figure, min(CASE label WHEN 'anchored_in' THEN 0 ELSE 1 END) AS tier FROM edges WHERE label IN ('anchored_in', 'cited_in') GROUP BY 1, 2) SELECT section, figure, tier, row_number() OVER (PARTITION BY section ORDER BY tier, figure) AS rank FROM p",
    "kg_figures_for_chunk": f"WITH {G} SELECT src AS chunk, dst AS figure FROM edges WHERE label IN ('cites_figure', 'cites_table') AND dst IN (SELECT id FROM nodes WHERE NOT unresolved)",
    "kg_chunks_for_code": f"WITH {G} SELECT dst AS code, count(*) AS n_chunks, min(src) AS first_chunk FROM edges WHERE label = 'mentions' GROUP BY 1",
    "kg_section_cites_figures": f"WITH {C} SELECT manual, section_id, bool_or(coalesce(len(figure_refs), 0) > 0) AS cites_any_figure FROM c GROUP BY 1, 2",
    "kg_overview": f"WITH {C} SELECT manual, coalesce(part, 'Part ?') AS part, coalesce(chapter, 'Chapter ?') AS chapter, greatest(1, count(DISTINCT section_id)) AS weight FROM c GROUP BY 1, 2, 3",
    "kg_neighborhood_trim": f"WITH {G}, s AS (SELECT id AS qid, id FROM nodes WHERE kind = 'Figure' AND NOT unresolved), r AS (SELECT * FROM s UNION SELECT qid, b FROM s JOIN ug ON id = a), t AS (SELECT qid, id, kind FROM r JOIN nodes USING (id) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY (kind = 'Chunk')::INT, id) <= 8) SELECT qid, count(*) AS n_nodes, count(*) FILTER (kind = 'Chunk') AS n_chunks FROM t GROUP BY 1",
    "kg_subgraph": f"WITH {G}, i AS (SELECT id FROM nodes WHERE kind IN ('Section', 'Figure', 'Table')) SELECT label, count(*) AS n FROM edges WHERE src IN (SELECT id FROM i) AND dst IN (SELECT id FROM i) GROUP BY 1",
    "query_entities": f"""WITH {G}, q AS (SELECT question_id AS qid, translate(answer, '‐‑‒–—', '-----') AS t FROM runs WHERE answer IS NOT NULL),
x AS (SELECT qid, 'figure/' || {_K('v')} AS tail FROM (SELECT qid, unnest(regexp_extract_all(t, '(?i)\\b(Figure\\s+[0-9A-Z]+-[0-9]+[A-Za-z0-9]*)\\b', 1)) AS v FROM q) UNION SELECT qid, 'table/' || {_K('v')} FROM (SELECT qid, unnest(regexp_extract_all(t, '(?i)\\b(Table\\s+[0-9A-Z]+-[0-9]+[A-Za-z0-9]*)\\b', 1)) AS v FROM q)
UNION SELECT qid, 'section/' || unnest(regexp_extract_all(t, '\\b(?:Section\\s+)?([0-9]+[A-Z]\\.[0-9]+)\\b', 1)) FROM q UNION SELECT qid, 'signcode/' || upper(unnest(regexp_extract_all(t, '\\b([RWDIMOE][A-Z]?\\d{{1,3}}(?:-\\d{{1,3}})?[a-zA-Z]?P?)\\b', 1))) FROM q),
k AS (SELECT id, split_part(id, ':', 1) || '/' || list_last(string_split_regex(id, '[:/]')) AS tail FROM nodes WHERE NOT unresolved AND kind IN ('Figure', 'Table', 'Section', 'SignCode')) SELECT qid, count(*) AS n_entities, min(id) AS first_entity FROM x JOIN k USING (tail) GROUP BY 1""",
    "citation_valid": f"WITH {C}, r AS (SELECT DISTINCT record_id, answer FROM runs), x AS (SELECT record_id, unnest(list_distinct(regexp_extract_all(answer, 'Section ([0-9A-Z]+\\.[0-9]+)', 1))) AS section_id FROM r) SELECT record_id, count(*) AS n_cited, count(*) FILTER (section_id IN (SELECT section_id FROM c)) AS n_known FROM x GROUP BY 1",
}
