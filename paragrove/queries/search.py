"""Queries of vector search, fusion, scoring and reranking. Query sets: every row whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paragrove.functions import text
from paragrove.operators import search
from paragrove.queries.text import C, KIND, WEIGHT, chunks
from paragrove.runtime import Shelf, table


def vec_chunks(spark, sf):
    t = table(spark, sf, "vec_chunks")
    return t.groupBy("id").agg(F.max_by(F.struct("dense", "sparse", "payload"), "upserted_at").alias("r")).select("id", F.col("r.dense").alias("vec"), "r.sparse", "r.payload")


def asked(df):
    return df.where(F.col("id") % 20 == 0).withColumnRenamed("id", "qid")


def _embeddings(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def dense_topk(spark, sf):
    e = _embeddings(spark, sf)
    return search.dense_topk(asked(e), e, 10).select("qid", "id", "rank", F.round("score", 6).alias("score"))


def sparse_topk(spark, sf):
    v = table(spark, sf, "vec_chunks").groupBy("id").agg(F.max_by("sparse", "upserted_at").alias("sparse"))
    v = Shelf(spark).keep(v, "sparse")
    return search.sparse_topk(asked(v), v, 10).select("qid", "id", "rank", F.round("score", 5).alias("score"))


def hybrid_rrf_topk(spark, sf):
    """Dense and sparse top 30, fused by rank, weighted by rule type, top 6 of each query."""
    v = Shelf(spark).keep(vec_chunks(spark, sf), "vectors")
    q = asked(v)
    fused = search.rrf([search.dense_topk(q, v, 30), search.sparse_topk(q, v, 30)], 30)
    kind = F.coalesce(text.content_type(F.col("payload.content_type")), F.lit("Support"))
    scored = fused.join(v.select("id", kind.alias("kind"), F.col("payload.section_id").alias("section_id")), "id")
    score = search.final_score(F.col("score"), F.lit(0.0), text.rule_weight(F.col("kind")), F.lit(0.0))
    best = search.ranked(scored.select("qid", "id", "kind", "section_id", score.alias("final")), 6, "final")
    return best.select("qid", "rank", "id", "kind", "section_id", F.round("final", 6).alias("score"))


def rrf_merge(spark, sf):
    """Fusion of two orders of the same embeddings: by all components, and by the first half of them."""
    e = _embeddings(spark, sf)
    half = e.select("id", F.slice("vec", 1, 32).alias("vec"))
    lists = [search.dense_topk(asked(e), e, 30), search.dense_topk(asked(half), half, 30, dim=32)]
    return search.rrf(lists, 10).select("qid", "id", "rank", F.round("score", 8).alias("score"))


def maxsim_pages(spark, sf):
    """Pages are the embeddings of one label; a query is the group of embeddings with the same id modulo 500 over 20."""
    e = _embeddings(spark, sf)
    q = asked(e).select((F.col("qid") % 7).alias("qid"), "vec")
    return search.maxsim(q, e.select(F.col("label").cast("bigint").alias("id"), "vec"), 5).select("qid", "id", "rank", F.round("score", 6).alias("score"))


def binary_first_pass(spark, sf):
    """Candidates by Hamming distance of sign bits, rescored exactly, and exactly continued beyond them."""
    e = _embeddings(spark, sf)
    return search.binary_topk(asked(e), e, 10).select("qid", "id", "rank", F.round("score", 6).alias("score"))


def score_formula(spark, sf):
    """The whole formula for every chunk and a question that names its part and chapter: base by the ordinal, graph by the number of figures cited, rule weight, hierarchy prior."""
    question = F.concat(F.lit("What does Part "), F.substring("section_id", 1, 1), F.lit(" say in Chapter "), F.substring("section_id", 1, 2), F.lit("?"))
    kind = F.coalesce(text.content_type(F.col("content_type")), F.lit("Support"))
    prior = search.hierarchy_prior(question, F.col("part"), F.col("chapter"))
    base, near = 1 / (60 + F.coalesce("ordinal", F.lit(0))), 1 / (1 + F.greatest(F.lit(0), F.coalesce(F.size("figure_refs"), F.lit(0))))
    return chunks(spark, sf).select("chunk_id", F.round(prior, 6).alias("hierarchy"), F.round(search.final_score(base, near, text.rule_weight(kind), prior), 6).alias("score"))


def rerank_topk(spark, sf):
    """The stand-in reranker over each question's candidate answers: top 6 by word overlap."""
    runs = table(spark, sf, "runs").dropDuplicates(["record_id"]).where("answer IS NOT NULL AND question IS NOT NULL")
    scored = runs.select(F.col("question_id").alias("qid"), F.col("record_id").alias("id"), search.overlap_score(F.col("question"), F.col("answer")).alias("score"))
    return search.ranked(scored, 6).select("qid", "id", "rank", F.round("score", 6).alias("score"))


def rerank_identity(spark, sf):
    e = _embeddings(spark, sf)
    return search.dense_topk(asked(e), e, 6).select("qid", "id", F.round(search.identity_rerank(F.col("rank")), 8).alias("score"))


def nearest_documents(spark, sf):
    """Embeddings stand for documents of the same number: dense search joined to their source."""
    e = _embeddings(spark, sf)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return search.dense_topk(asked(e), e, 5, keep_self=False).join(docs, "id", "left").select("qid", "id", "rank", "lang", "source")


QUERIES = {f.__name__: f for f in (dense_topk, sparse_topk, hybrid_rrf_topk, rrf_merge, maxsim_pages, binary_first_pass, score_formula, rerank_topk, rerank_identity, nearest_documents)}

E = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"
_D = lambda k, extra="": f"d AS (SELECT q.id AS qid, e.id, list_cosine_similarity(q.vec, e.vec) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.vec, e.vec), 9) DESC, e.id) AS rank FROM e q, e WHERE q.id % 20 = 0 {extra} QUALIFY rank <= {k})"
V = """v AS (SELECT id, CAST(dense AS DOUBLE[]) AS vec, sparse, payload FROM vec_chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY upserted_at DESC) = 1),
ok AS (SELECT * FROM v WHERE len(vec) = 64 AND list_dot_product(vec, vec) > 0),
t AS (SELECT id, unnest(map_keys(sparse)) AS token, CAST(unnest(map_values(sparse)) AS DOUBLE) AS w FROM v)"""
_S = lambda k: f"s AS (SELECT q.id AS qid, d.id, sum(q.w * d.w) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(sum(q.w * d.w), 9) DESC, d.id) AS rank FROM t q JOIN t d ON q.token = d.token WHERE q.id % 20 = 0 GROUP BY 1, 2 HAVING sum(q.w * d.w) <> 0 QUALIFY rank <= {k})"
_words = lambda c: f"list_distinct(list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: length(w) > 0))"
ORACLE = {
    "dense_topk": f"WITH {E}, {_D(10)} SELECT qid, id, rank, round(score, 6) AS score FROM d",
    "sparse_topk": f"WITH {V}, {_S(10)} SELECT qid, id, rank, round(score, 5) AS score FROM s",
    "hybrid_rrf_topk": f"""WITH {V}, dd AS (SELECT q.id AS qid, e.id, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.vec, e.vec), 9) DESC, e.id) AS rank FROM ok q, ok e WHERE q.id % 20 = 0 QUALIFY rank <= 30), {_S(30)},
u AS (SELECT qid, id, 1.0::DOUBLE / (60 + rank) AS x, 0 AS list, rank FROM dd UNION ALL SELECT qid, id, 1.0::DOUBLE / (60 + rank), 1, rank FROM s),
f AS (SELECT qid, id, sum(x) AS score FROM u GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(sum(x), 12) DESC, min(list), arg_min(rank, list), id) <= 30),
g AS (SELECT qid, f.id, {KIND.replace('content_type', 'payload.content_type')} AS kind, payload.section_id AS section_id, score FROM f JOIN v ON f.id = v.id),
h AS (SELECT *, score + 0.3 * ({WEIGHT.format('kind')} - 1.0) AS final FROM g)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(final, 9) DESC, id) AS rank, id, kind, section_id, round(final, 6) AS score FROM h QUALIFY rank <= 6""",
    "rrf_merge": f"""WITH {E}, {_D(30)}, l AS (SELECT q.id AS qid, e.id, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.vec[1:32], e.vec[1:32]), 9) DESC, e.id) AS rank FROM e q, e WHERE q.id % 20 = 0 QUALIFY rank <= 30),
u AS (SELECT qid, id, 1.0::DOUBLE / (60 + rank) AS x, 0 AS list, rank FROM d UNION ALL SELECT qid, id, 1.0::DOUBLE / (60 + rank), 1, rank FROM l)
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(sum(x), 12) DESC, min(list), arg_min(u.rank, list), id) AS rank, round(sum(x), 8) AS score FROM u GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(sum(x), 12) DESC, min(list), arg_min(u.rank, list), id) <= 10""",
    "maxsim_pages": f"""WITH {E}, m AS (SELECT q.id % 7 AS qid, q.id AS token, e.label::BIGINT AS id, max(list_dot_product(q.vec, e.vec)) AS s FROM e q, e WHERE q.id % 20 = 0 GROUP BY 1, 2, 3), t AS (SELECT qid, id, sum(s) AS score FROM m GROUP BY 1, 2)
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank, round(score, 6) AS score FROM t QUALIFY rank <= 5""",
    "binary_first_pass": f"""WITH {E}, n AS (SELECT q.id AS qid, e.id, list_dot_product(q.vec, e.vec) AS score FROM e q, e WHERE q.id % 20 = 0)
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank, round(score, 6) AS score FROM n QUALIFY rank <= 10""",
    "score_formula": f"""WITH {C}, p AS (SELECT chunk_id, 1.0::DOUBLE / (60 + coalesce(ordinal, 0)) AS base, 1.0::DOUBLE / (1 + coalesce(len(figure_refs), 0)) AS near, {WEIGHT.format(KIND)} AS w, CASE WHEN contains(lower(coalesce(part, '')), 'part ' || left(section_id, 1)) AND regexp_matches(left(section_id, 1), '^\\d$') THEN 0.6::DOUBLE ELSE 0.0 END + CASE WHEN contains(lower(coalesce(chapter, '')), lower(left(section_id, 2))) THEN 0.6::DOUBLE ELSE 0.0 END AS h FROM c)
SELECT chunk_id, round(h, 6) AS hierarchy, round(base + 0.4::DOUBLE * near + 0.3::DOUBLE * (w - 1.0) + 0.2::DOUBLE * h, 6) AS score FROM p""",
    "rerank_topk": f"""WITH r AS (SELECT DISTINCT record_id, question_id, question, answer FROM runs WHERE answer IS NOT NULL AND question IS NOT NULL), w AS (SELECT question_id AS qid, record_id AS id, {_words('question')} AS q, {_words('answer')} AS a FROM r), s AS (SELECT qid, id, len(list_intersect(q, a)) / greatest(len(q), 1) AS score FROM w)
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 6""",
    "rerank_identity": f"WITH {E}, {_D(6)} SELECT qid, id, round(1 - (rank - 1) * 1e-6::DOUBLE, 8) AS score FROM d",
    "nearest_documents": f"WITH {E}, {_D(5, 'AND q.id <> e.id')} SELECT qid, d.id, rank, lang, source FROM d LEFT JOIN documents o ON o.doc_id = d.id",
}
