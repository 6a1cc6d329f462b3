"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from paragrove.llm import mixing, neighbours, packing, pairs, repetition, scannoise, splitting, truncation
from paragrove.runtime import table

QUERIES, ORACLE = {}, {}


def query(run):
    QUERIES[run.__name__] = run
    return run


COLLECTIONS = ("vec_chunks", "vec_figures")


@query
def p1_found(spark, sf):
    parts = [neighbours.similar_pairs(table(spark, sf, t), 0.9, name=t).select(F.lit(t).alias("collection"), "id_a", "id_b") for t in COLLECTIONS]
    return parts[0].unionByName(parts[1])


@query
def p1_nearest(spark, sf):
    """The 10 nearest of every row whose id is divisible by 20, against all rows."""
    parts = [neighbours.nearest(table(spark, sf, t), F.col("id") % 20 == 0, 10, name=t).select(F.lit(t).alias("collection"), "id_q", "rank", "id", "cosine") for t in COLLECTIONS]
    return parts[0].unionByName(parts[1])


@query
def p2_found(spark, sf):
    return splitting.split_oversized(table(spark, sf, "chunks"), table(spark, sf, "size_limits")).where("piece_no = 0").select("chunk_id")


@query
def p2_pieces(spark, sf):
    return splitting.split_oversized(table(spark, sf, "chunks"), table(spark, sf, "size_limits"))


@query
def p7_found(spark, sf):
    """Documents that the packing had to spread over more than one container."""
    return packing.pack_documents(table(spark, sf, "documents")).where("piece_no = 1 AND container IS NOT NULL").select("doc_id")


@query
def p7_containers(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"))


@query
def p8_found(spark, sf):
    """Sources of which the fitted selection holds less than the target's part though it took all they may give."""
    return mixing.Mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets")).report().where("short").select("source")


@query
def p8_selection(spark, sf):
    return mixing.Mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets")).selection()


@query
def p8_report(spark, sf):
    return mixing.Mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets")).report()


@query
def p9_found(spark, sf):
    """Documents that are repetitive by the posterior of the label model; the exact share decides among them."""
    rows = repetition.repetition(table(spark, sf, "documents"))
    return rows.where((F.col("posterior") >= 0.5) & (F.col("share") >= 0.30)).select("doc_id")


@query
def p9_shares(spark, sf):
    return repetition.repetition(table(spark, sf, "documents")).select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.round("share", 6).alias("share"))


@query
def p9_posteriors(spark, sf):
    """What the label model says of every document, with the rules' values."""
    return repetition.repetition(table(spark, sf, "documents")).drop("share", "n_words")


_TOKENS = r"len(regexp_extract_all(text, '[\pL\pN_]+|[^\pL\pN_\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))"
ORACLE["p2_found"] = r"""
SELECT DISTINCT chunk_id FROM chunks c JOIN size_limits l ON lower(trim(c.content_type)) = lower(trim(l.content_type)) WHERE length(text) > max_chars"""
ORACLE["p7_found"] = f"SELECT doc_id FROM documents WHERE {_TOKENS} > 1024"
ORACLE["p8_found"] = f"""
WITH d AS (SELECT nullif(lower(trim(source)), '') AS src, {_TOKENS} AS n FROM documents),
t AS (SELECT src, sum(n) AS n FROM d WHERE src IS NOT NULL GROUP BY src)
SELECT m.source FROM mix_targets m LEFT JOIN t ON lower(trim(m.source)) = t.src
WHERE coalesce(t.n, 0) * m.max_repeats < m.target_share * (SELECT sum(n) FROM t)"""

_PASSAGES = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\pL+') AS w FROM documents),
g AS (SELECT doc_id, i, list_reduce(w[i:i + 7], lambda a, b: a || ' ' || b) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
again AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY i) > 1),
marked AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, (SELECT unnest(range(0, 8)) AS j) GROUP BY 1),
shares AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0) / greatest(len(w), 1) AS share FROM w LEFT JOIN marked USING (doc_id))
"""
ORACLE["p9_found"] = _PASSAGES + "SELECT doc_id FROM shares WHERE share >= 0.30"
ORACLE["p9_shares"] = _PASSAGES + "SELECT doc_id, n_words, round(share, 6) AS share FROM shares"
_PAIRS = """{0}_v AS (SELECT id, CAST(dense AS DOUBLE[]) AS v FROM {0} WHERE len(dense) = 64 AND list_dot_product(CAST(dense AS DOUBLE[]), CAST(dense AS DOUBLE[])) > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY upserted_at DESC) = 1),
{0}_p AS (SELECT '{0}' AS collection, a.id AS id_a, b.id AS id_b FROM {0}_v a JOIN {0}_v b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.90)"""
ORACLE["p1_found"] = "WITH " + ",\n".join(_PAIRS.format(t) for t in COLLECTIONS) + " SELECT * FROM vec_chunks_p UNION ALL SELECT * FROM vec_figures_p"


def _cut(spark, sf):
    """Truncation of the answers; placeholders, failure messages and mere copies of the question are whole texts."""
    return truncation.truncated(table(spark, sf, "runs"), rules=pairs.Rules(None))


@query
def p3_found(spark, sf):
    return _cut(spark, sf).where("posterior >= 0.5").select("record_id")


@query
def p3_rates(spark, sf):
    return truncation.truncation_rates(_cut(spark, sf)).withColumnRenamed("source", "model_alias")


@query
def p6_found(spark, sf):
    return pairs.broken_pairs(table(spark, sf, "runs"), table(spark, sf, "questions")).where("defect IS NOT NULL").select("record_id", "defect")


@query
def p6_rates(spark, sf):
    """Share of every defect per model_alias."""
    per = pairs.broken_pairs(table(spark, sf, "runs"), table(spark, sf, "questions")).groupBy("model_alias").pivot("defect", list(pairs.DEFECTS)).count().fillna(0)
    return per


@query
def p4_found(spark, sf):
    return scannoise.noisy(table(spark, sf, "chunks"), table(spark, sf, "figures")).select("source_table", "record_key").distinct()


@query
def p4_repaired(spark, sf):
    return scannoise.repaired(table(spark, sf, "chunks"), table(spark, sf, "figures"))
