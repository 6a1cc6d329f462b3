"""Queries of streams, sources and the whole retrieval plan."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from paragrove.functions.ids import reference_key
from paragrove.operators import search
from paragrove.plans import ask
from paragrove.queries.graph import G, _K, built
from paragrove.queries.search import vec_chunks
from paragrove.queries.text import FIG, chunks, figures
from paragrove.runtime import Shelf, table
from paragrove.sources import files
from paragrove.streaming import progress


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    path = f"{sf}/{name}.parquet"
    return progress.log(spark, path if os.path.isdir(path) else f"{sf}/{name}*.parquet", schema)


def stream_dedup(spark, sf):
    s = _stream(spark, sf, "runs").select("record_id", "run_id", "model_alias", "question_id", "status")
    return progress.run_append(progress.dedup(s, ["record_id"]), "dedup")


def stream_progress(spark, sf):
    return progress.run_complete(progress.progress(_stream(spark, sf, "runs"), "run_id"), "progress")


def stream_windows(spark, sf):
    """Extension: daily windows over the events."""
    s = _stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("at"), "event_type", "value")
    out = progress.run_complete(progress.windows(s, "at", "event_type", "1 day"), "windows")
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n", F.round("total", 4).alias("total"))


def session_counts(spark, sf):
    """Extension: sessions of every user, ended by thirty minutes without an event."""
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("at"), "user_id")
    s = e.groupBy(F.session_window("at", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


def figures_schema_evolution(spark, sf):
    """First-generation figures, without the later fields, read as the second generation."""
    old = figures(spark, sf).select("figure_key", "figure_id", "kind", "page_pdf", "caption", "title")
    return files.evolve_figures(old).select("figure_id", "kind", "canonical_id", "chapter", "extraction_method", "page_pdf").distinct()


def code_map_round_trip(spark, sf):
    """The code registry as one JSON object, and back."""
    c = chunks(spark, sf).select(F.explode("sign_codes").alias("code"), "section_id").groupBy("code").agg(F.min("section_id").alias("first_section"), F.count("*").alias("n"))
    return files.read_code_map(files.code_map(c), "first_section: string, n: bigint")


def vectors(spark, sf, *columns):
    """The chunk vectors of a data directory, kept: id, vec, chunk_id, page, and further columns."""
    v = vec_chunks(spark, sf).select("id", "vec", *columns, F.col("payload.chunk_id").alias("chunk_id"), F.col("payload.page_pdf").alias("page"))
    return Shelf(spark).keep(v, "vectors")


def patches(v):
    """Pages whose patches are the vectors of their chunks."""
    return v.where("page IS NOT NULL").select(F.col("page").cast("bigint").alias("id"), "vec")


def corpus(spark, sf):
    """The corpus of a data directory: chunk vectors, figure vectors as crops of one patch, and pages whose patches are the vectors of their chunks."""
    v = vectors(spark, sf, "sparse")
    t = table(spark, sf, "vec_figures")
    f = t.groupBy("id").agg(F.max_by(F.struct("dense", "payload"), "upserted_at").alias("r")).select("id", F.col("r.dense").alias("vec"), F.col("r.payload").alias("p"))
    kind = F.when(F.col("p.kind") == "Table", "table").otherwise("figure")
    node = F.concat(kind, F.lit(":"), "p.manual", F.lit("/"), reference_key(F.col("p.figure_id")))
    return ask.Corpus(chunks(spark, sf), figures(spark, sf), built(spark, sf), v, Shelf(spark).keep(f.select("id", "vec", node.alias("figure")), "figure-vectors"), patches(v))


def asked(spark, sf, c):
    """Every vector whose id is divisible by 20 asks with its chunk's first words."""
    words = F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 12), " ")
    v = c.vectors.where("id % 20 = 0").join(c.chunks.select("chunk_id", words.alias("words")), "chunk_id", "left")
    return v.select(F.col("id").alias("qid"), F.coalesce("words", F.lit("")).alias("question"), "vec", "sparse")


def ask_plan(spark, sf):
    """The whole plan: chunks, figures by three ways, pages and a prompt for every query."""
    c = corpus(spark, sf)
    out = ask.Pipeline(c, captions=True).ask(asked(spark, sf, c))
    return out.select("qid", "needs_figures", F.size("chunks").alias("n_chunks"), F.size("figures").alias("n_figures"), F.size("pages").alias("n_pages"), F.length("prompt").alias("prompt_chars"))


def ask_pages(spark, sf):
    """The four best pages of every query; vectors alone decide, so neither chunks nor the graph are read."""
    v = vectors(spark, sf)
    q = v.where("id % 20 = 0").select(F.col("id").alias("qid"), "vec")
    got = search.maxsim(q.where("vec IS NOT NULL"), patches(v), ask.MOST_PAGES)
    return got.select("qid", "rank", F.col("id").alias("page"))


def ask_figures(spark, sf):
    """The figures of every query by the three ways: those that the query's own chunk cites, those that look alike, those of near captions; at most ten looked at and four shown."""
    c = corpus(spark, sf)
    q = asked(spark, sf, c)
    own = c.vectors.where("id % 20 = 0 AND chunk_id IS NOT NULL").select(F.col("id").alias("qid"), F.lit(1).alias("rank"), "chunk_id")
    decided = q.select("qid", F.lit(True).alias("needs_figures"), F.lit(4).alias("max_figures"))
    return ask.figures_for(own, c, decided, q, captions=True)


QUERIES = {f.__name__: f for f in (stream_dedup, stream_progress, stream_windows, session_counts, figures_schema_evolution, code_map_round_trip, ask_plan, ask_pages, ask_figures)}
ORACLE = {
    "stream_dedup": "SELECT DISTINCT record_id, run_id, model_alias, question_id, status FROM runs",
    "stream_progress": "SELECT run_id, count(*) AS n, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS errors FROM runs GROUP BY 1",
    "stream_windows": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "session_counts": "WITH g AS (SELECT user_id, ts, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), n AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM n GROUP BY 1",
    "figures_schema_evolution": f"WITH {FIG} SELECT DISTINCT figure_id, kind, upper(regexp_extract(figure_id, '([0-9]+[A-Za-z]{{0,2}}-\\d+)', 1)) AS canonical_id, split_part(upper(regexp_extract(figure_id, '([0-9]+[A-Za-z]{{0,2}}-\\d+)', 1)), '-', 1) AS chapter, 'caption_above_v1' AS extraction_method, page_pdf FROM f",
    "code_map_round_trip": "WITH c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at) = 1), k AS (SELECT unnest(sign_codes) AS code, section_id FROM c) SELECT code, min(section_id) AS first_section, count(*) AS n FROM k GROUP BY 1",
    "ask_pages": """WITH v AS (SELECT id, CAST(dense AS DOUBLE[]) AS vec, payload FROM vec_chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY upserted_at DESC) = 1), ok AS (SELECT * FROM v WHERE len(vec) = 64),
s AS (SELECT q.id AS qid, p.payload.page_pdf::BIGINT AS page, max(list_dot_product(q.vec, p.vec)) AS score FROM ok q, ok p WHERE q.id % 20 = 0 AND p.payload.page_pdf IS NOT NULL GROUP BY 1, 2) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, page) AS rank, page FROM s QUALIFY rank <= 4""",
    "ask_figures": f"""WITH {G}, v AS (SELECT id, CAST(dense AS DOUBLE[]) AS vec, payload.chunk_id AS chunk_id FROM vec_chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY upserted_at DESC) = 1),
fv AS (SELECT id, CAST(dense AS DOUBLE[]) AS vec, CASE payload.kind WHEN 'Table' THEN 'table:' ELSE 'figure:' END || payload.manual || '/' || {_K('payload.figure_id')} AS figure FROM vec_figures QUALIFY row_number() OVER (PARTITION BY id ORDER BY upserted_at DESC) = 1),
q AS (SELECT id AS qid, vec, chunk_id FROM v WHERE id % 20 = 0), p AS (SELECT qid, fv.id, figure, list_dot_product(q.vec, fv.vec) AS dp, list_dot_product(q.vec, q.vec) * list_dot_product(fv.vec, fv.vec) AS nn FROM q, fv WHERE len(q.vec) = 64 AND len(fv.vec) = 64),
w AS (SELECT qid, dst AS figure, 0 AS way, 1 AS at_ FROM q JOIN edges ON src = 'chunk:' || chunk_id WHERE label IN ('cites_figure', 'cites_table') AND dst IN (SELECT id FROM nodes WHERE NOT unresolved)
UNION ALL SELECT * FROM (SELECT qid, figure, 1, row_number() OVER (PARTITION BY qid ORDER BY round(dp, 9) DESC, id) AS at_ FROM p QUALIFY at_ <= 6)
UNION ALL SELECT * FROM (SELECT qid, figure, 2, row_number() OVER (PARTITION BY qid ORDER BY round(dp / sqrt(nn), 9) DESC, id) AS at_ FROM p WHERE nn > 0 QUALIFY at_ <= 10)),
ff AS (SELECT qid, figure, min(way * 100 + at_) AS o FROM w GROUP BY 1, 2) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY o, figure) AS rank, figure, CASE o // 100 WHEN 0 THEN 'kg_link' WHEN 1 THEN 'visual' ELSE 'caption' END AS path FROM ff QUALIFY rank <= 4""",
}
