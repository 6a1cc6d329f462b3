"""Queries of text extraction, identifiers and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paragrove.functions import ids, text
from paragrove.runtime import broadcast_if_small, table


def chunks(spark, sf):
    """One row per chunk_id; repeated rows differ in ingested_at alone."""
    return table(spark, sf, "chunks").dropDuplicates(["chunk_id"])


def figures(spark, sf):
    """One row per figure_key that is not deleted; repeated rows are equal."""
    return table(spark, sf, "figures").where("deleted_at IS NULL").dropDuplicates(["figure_key"])


def refs_extract(spark, sf):
    c = F.col("text")
    return chunks(spark, sf).select("chunk_id", text.references(c, text.SECTION_REF).alias("section_refs"), text.references(c, text.FIGURE_REF).alias("figure_refs"), text.references(c, text.TABLE_REF).alias("table_refs"))


def section_refs_foreign(spark, sf):
    """References to sections other than the chunk's own."""
    own = F.array(F.upper("section_id"))
    return chunks(spark, sf).select("chunk_id", F.array_except(text.references(F.col("text"), text.SECTION_REF), own).alias("section_refs")).where("size(section_refs) > 0")


def modal_verbs(spark, sf):
    return chunks(spark, sf).select("chunk_id", text.modal_verbs(F.col("text")).alias("modal_verbs"))


def sign_codes(spark, sf):
    return chunks(spark, sf).select("chunk_id", text.found(F.col("text"), text.CODE_PARSER).alias("parser_codes"), text.found(F.col("text"), text.CODE_PAREN).alias("paren_codes"), text.found(F.col("text"), text.CODE_QUERY).alias("query_codes"))


def categorize_codes(spark, sf):
    codes = chunks(spark, sf).select(F.explode(text.found(F.col("text"), text.CODE_PAREN)).alias("code"))
    return codes.groupBy("code").agg(F.count("*").alias("n_chunks")).withColumn("category", text.category(F.col("code"))).where("category <> 'Unknown'")


def category_counts(spark, sf):
    codes = chunks(spark, sf).select(F.explode(text.found(F.col("text"), text.CODE_PAREN)).alias("code"))
    return codes.groupBy(text.category(F.col("code")).alias("category")).agg(F.count("*").alias("n_mentions"), F.countDistinct("code").alias("n_codes"))


def sign_code_registry(spark, sf):
    """code, category, first section by (section, page, chunk), sections that refer to it."""
    codes = chunks(spark, sf).select("manual", "section_id", "page_pdf", "chunk_id", F.explode(text.found(F.col("text"), text.CODE_PAREN)).alias("code"))
    first = F.min_by("section_id", F.struct(F.coalesce("page_pdf", F.lit(0)), "chunk_id"))
    return codes.groupBy("manual", "code").agg(first.alias("first_seen_section"), F.array_sort(F.collect_set("section_id")).alias("referenced_in_sections")).withColumn("category", text.category(F.col("code")))


def name_code_pairs(spark, sf):
    """Up to five words before every code in parentheses name it."""
    hits = chunks(spark, sf).select(F.explode(text.named_codes(F.col("text"))).alias("p"))
    return hits.groupBy("p.code", "p.name").agg(F.count("*").alias("n"))


def caption_parse(spark, sf):
    cap = text.caption(F.col("caption"))
    return figures(spark, sf).select("figure_key", cap.alias("c")).select("figure_key", F.col("c.kind").alias("kind"), F.col("c.canonical_id").alias("canonical_id"), F.col("c.sheet").alias("sheet"), F.col("c.sheet_of").alias("sheet_of"), F.col("c.title").alias("title"))


def stable_ids(spark, sf):
    return chunks(spark, sf).select("chunk_id", ids.stable_id(F.col("chunk_id")).alias("id"))


def text_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def sentence_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence")).where("sentence IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.length("sentence")).alias("longest"))


def canonicalize_ids(spark, sf):
    c = text.canonical_spacing(ids.normalize_dashes(F.col("caption")))
    return figures(spark, sf).select("figure_key", c.alias("caption"), ids.reference_key(F.col("canonical_id")).alias("canonical_id"))


def embedding_text(spark, sf):
    """The text that is embedded for a figure."""
    codes = F.when(F.size("sign_codes_depicted") > 0, F.array_join(F.array_sort("sign_codes_depicted"), ", ")).otherwise("—")
    return figures(spark, sf).select("figure_key", F.concat_ws(" | ", "figure_id", F.coalesce("title", "caption"), F.concat(F.lit("codes: "), codes)).alias("embed_text"))


def crop_names(spark, sf):
    name = F.format_string("p%04d_%s_%s_s%d", F.coalesce("page_pdf", F.lit(0)), F.lower("kind"), ids.reference_key(F.col("canonical_id")), F.coalesce("sheet", F.lit(1)))
    return figures(spark, sf).select("figure_key", name.alias("crop"), F.expr("cast(element_at(bbox, 3) * dpi / 72 as int) - cast(element_at(bbox, 1) * dpi / 72 as int)").alias("width_px"))


def rule_weights(spark, sf):
    kind = F.coalesce(text.content_type(F.col("content_type")), F.lit("Support"))
    return chunks(spark, sf).groupBy(kind.alias("kind")).agg(F.count("*").alias("n_chunks")).withColumn("weight", text.rule_weight(F.col("kind")))


def clean_context(spark, sf):
    """Rule labels removed; one text per first 200 characters and section."""
    t = text.collapse(F.regexp_replace("text", r"(Standard|Option|Guidance):?\s*\d*", ""))
    w = Window.partitionBy("section_id", F.substring("cleaned", 1, 200)).orderBy("chunk_id")
    return chunks(spark, sf).select("section_id", "chunk_id", t.alias("cleaned")).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("section_id", "chunk_id", F.sha2("cleaned", 256).alias("cleaned_sha"))


def provider_dispatch(spark, sf):
    """Alias resolution with identity as default, and the provider by prefix where none is given."""
    runs = table(spark, sf, "runs").select("model_alias").distinct()
    models = table(spark, sf, "models")
    return runs.join(broadcast_if_small(models), F.col("model_alias") == F.col("alias"), "left").select("model_alias", F.coalesce("selector", "model_alias").alias("selector"), F.coalesce("provider", text.provider_of(F.coalesce("selector", "model_alias"))).alias("provider"), F.coalesce("enabled", F.lit(True)).alias("enabled"))


def token_limits(spark, sf):
    """Limits per provider: the larger of request and configuration, then the retry limit after truncation."""
    rows = table(spark, sf, "runs").where("usage.output_tokens IS NOT NULL").select(F.coalesce("provider", F.lit("local")).alias("provider"), F.col("usage.output_tokens").alias("requested"))
    configured = F.when(F.col("provider") == "northgrid", 160).when(F.col("provider") == "tallow", 90).otherwise(64)
    limit = F.greatest("requested", configured)
    return rows.select("provider", limit.alias("lim"), F.least(configured * 4, F.greatest(limit + 1, limit * 2)).alias("retry")).groupBy("provider").agg(F.count("*").alias("n"), F.max("lim").alias("max_limit"), F.sum("retry").alias("sum_retry"))


QUERIES = {f.__name__: f for f in (refs_extract, section_refs_foreign, modal_verbs, sign_codes, categorize_codes, category_counts, sign_code_registry, name_code_pairs, caption_parse, stable_ids, text_hashes, sentence_split, canonicalize_ids, embedding_text, crop_names, rule_weights, clean_context, provider_dispatch, token_limits)}

C = "c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at) = 1)"
FIG = "f AS (SELECT * FROM figures WHERE deleted_at IS NULL QUALIFY row_number() OVER (PARTITION BY figure_key ORDER BY ingested_at) = 1)"
DASH = "translate({0}, '‐‑‒–—―−', '-------')"
_refs = lambda p: f"list_sort(list_distinct(list_transform(regexp_extract_all({DASH.format('text')}, '{p}', 1), lambda x: upper(regexp_replace(x, '\\s+', '', 'g')))))"
_found = lambda p: f"list_sort(list_distinct(regexp_extract_all(text, '{p}', 1)))"
CATEGORY = "CASE " + " ".join(f"WHEN upper(code) LIKE '{p}%' THEN '{n}'" for p, n in text.CATEGORIES.items()) + " ELSE 'Unknown' END"
_codes = f"WITH {C}, k AS (SELECT *, unnest({_found(text.CODE_PAREN)}) AS code FROM c)"
REF_KEY = r"""regexp_replace(upper(regexp_replace(translate({0}, '‐‑‒–—―−', '-------'), '[\s\x{{00a0}}\x{{2000}}-\x{{200b}}\x{{202f}}]+', '', 'g')), '^(FIGURES?|FIGS?|TABLES?|TABS?)[.:]?-?([0-9])', '\2')"""
_SPACED = r"regexp_replace(translate({0}, '‐‑‒–—―−', '-------'), '(?i)\b(figure|table)\s*([0-9]+[A-Z]{{0,2}})\s*-\s*(\d+)', '\1 \2-\3', 'g')"
KIND = "coalesce(nullif(upper(left(trim(content_type), 1)) || lower(substr(trim(content_type), 2)), ''), 'Support')"
WEIGHT = "CASE {0} WHEN 'Standard' THEN 1.2 WHEN 'Guidance' THEN 1.0 WHEN 'Option' THEN 0.9 WHEN 'Support' THEN 0.7 ELSE 1.0 END::DOUBLE"
_strip = lambda c: f"regexp_replace({c}, '^[ .—–:-]+|[ .—–:-]+$', '', 'g')"
ORACLE = {
    "refs_extract": f"WITH {C} SELECT chunk_id, {_refs(text.SECTION_REF)} AS section_refs, {_refs(text.FIGURE_REF)} AS figure_refs, {_refs(text.TABLE_REF)} AS table_refs FROM c",
    "section_refs_foreign": f"WITH {C} SELECT * FROM (SELECT chunk_id, list_filter({_refs(text.SECTION_REF)}, lambda x: x <> upper(section_id)) AS section_refs FROM c) WHERE len(section_refs) > 0",
    "modal_verbs": f"WITH {C} SELECT chunk_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '{text.MODAL}', 1), lambda x: lower(x)))) AS modal_verbs FROM c",
    "sign_codes": f"WITH {C} SELECT chunk_id, {_found(text.CODE_PARSER)} AS parser_codes, {_found(text.CODE_PAREN)} AS paren_codes, {_found(text.CODE_QUERY)} AS query_codes FROM c",
    "categorize_codes": f"{_codes} SELECT code, count(*) AS n_chunks, {CATEGORY} AS category FROM k GROUP BY code HAVING category <> 'Unknown'",
    "category_counts": f"{_codes} SELECT {CATEGORY} AS category, count(*) AS n_mentions, count(DISTINCT code) AS n_codes FROM k GROUP BY 1",
    "sign_code_registry": f"{_codes} SELECT manual, code, arg_min(section_id, row(coalesce(page_pdf, 0), chunk_id)) AS first_seen_section, list_sort(list_distinct(list(section_id))) AS referenced_in_sections, {CATEGORY} AS category FROM k GROUP BY manual, code",
    "name_code_pairs": f"""WITH {C}, t AS (SELECT chunk_id, generate_subscripts(a, 1) AS i, unnest(a) AS w FROM (SELECT chunk_id, list_filter(regexp_extract_all(text, '\\([A-Z]{{1,3}}\\d{{1,3}}(?:-\\d{{1,3}})?[a-z]?P?\\)|[A-Za-z][\\pL\\pN_]*(?:[''-]+[\\pL\\pN_]+)*|[\\pL\\pN_]+'), lambda x: regexp_matches(x, '^[A-Za-z(]')) AS a FROM c)),
s AS (SELECT *, starts_with(w, '(') AS mark, replace(replace(w, '(', ''), ')', '') AS code, regexp_matches(replace(w, '(', ''), '^[RWDIMOE][A-Z]?\\d') AS stop FROM t), g AS (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY chunk_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(stop::INT) OVER (PARTITION BY chunk_id ORDER BY i) AS upto FROM s),
p AS (SELECT m.chunk_id, m.i, m.code, v.code AS word, v.i AS vi FROM g m JOIN g v ON m.chunk_id = v.chunk_id AND v.i < m.i AND NOT v.stop AND v.upto = m.before WHERE m.mark QUALIFY row_number() OVER (PARTITION BY m.chunk_id, m.i ORDER BY v.i DESC) <= 5),
n AS (SELECT chunk_id, i, code, string_agg(word, ' ' ORDER BY vi) AS name FROM p GROUP BY 1, 2, 3) SELECT code, name, count(*) AS n FROM n WHERE {CATEGORY} <> 'Unknown' GROUP BY 1, 2""",
    "caption_parse": f"""WITH {FIG}, t AS (SELECT figure_key, caption, {_SPACED.format('caption')} AS x FROM f),
p AS (SELECT figure_key, regexp_extract(x, '{text.CAPTION}', ['k', 'i', 'm', 's', 'o', 't'], 's') AS g, length(caption) <= 150 AND regexp_matches(x, '{text.CAPTION}') AND NOT regexp_matches(x, '\\.{{4,}}') AND NOT regexp_matches(x, '\\.{{2,}}\\s*\\d{{1,4}}\\s*$') AS ok FROM t),
q AS (SELECT figure_key, ok, g, {_strip('g.t')} AS title, g.s <> '' AS own FROM p)
SELECT figure_key, CASE WHEN ok THEN upper(left(g.k, 1)) || lower(substr(g.k, 2)) END AS kind, CASE WHEN ok THEN upper(g.i) END AS canonical_id,
CASE WHEN ok THEN TRY_CAST(CASE WHEN own THEN g.s ELSE regexp_extract(title, '{text.SHEET_TAIL}', 1) END AS INT) END AS sheet,
CASE WHEN ok THEN TRY_CAST(CASE WHEN own THEN g.o ELSE regexp_extract(title, '{text.SHEET_TAIL}', 2) END AS INT) END AS sheet_of,
CASE WHEN ok THEN CASE WHEN own THEN title ELSE {_strip(f"regexp_replace(title, '{text.SHEET_TAIL}', '')")} END END AS title FROM q""",
    "stable_ids": f"WITH {C} SELECT chunk_id, CAST(CAST('0x' || substr(sha1(chunk_id), 1, 16) AS UBIGINT) >> 1 AS BIGINT) AS id FROM c",
    "text_hashes": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "sentence_split": r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(trim(regexp_replace(text, '[\r\n]', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM documents)
SELECT doc_id, count(*) AS n_sentences, CAST(max(length(trim(sentence))) AS INT) AS longest FROM s WHERE length(trim(sentence)) > 20 GROUP BY doc_id""",
    "canonicalize_ids": f"WITH {FIG} SELECT figure_key, {_SPACED.format('caption')} AS caption, {REF_KEY.format('canonical_id')} AS canonical_id FROM f",
    "embedding_text": f"WITH {FIG} SELECT figure_key, concat_ws(' | ', figure_id, coalesce(title, caption), 'codes: ' || CASE WHEN len(sign_codes_depicted) > 0 THEN array_to_string(list_sort(sign_codes_depicted), ', ') ELSE '—' END) AS embed_text FROM f",
    "crop_names": f"WITH {FIG} SELECT figure_key, printf('p%04d_%s_%s_s%d', coalesce(page_pdf, 0), lower(kind), {REF_KEY.format('canonical_id')}, coalesce(sheet, 1)) AS crop, CAST(trunc(bbox[3] * dpi / 72) AS INT) - CAST(trunc(bbox[1] * dpi / 72) AS INT) AS width_px FROM f",
    "rule_weights": f"WITH {C} SELECT {KIND} AS kind, count(*) AS n_chunks, {WEIGHT.format(KIND)} AS weight FROM c GROUP BY 1",
    "clean_context": f"""WITH {C}, t AS (SELECT section_id, chunk_id, trim(regexp_replace(regexp_replace(text, '(Standard|Option|Guidance):?\\s*\\d*', '', 'g'), '\\s+', ' ', 'g')) AS x FROM c)
SELECT section_id, chunk_id, sha256(x) AS cleaned_sha FROM t QUALIFY row_number() OVER (PARTITION BY section_id, substr(x, 1, 200) ORDER BY chunk_id) = 1""",
    "provider_dispatch": """SELECT r.model_alias, coalesce(selector, r.model_alias) AS selector, coalesce(provider, CASE WHEN lower(coalesce(selector, r.model_alias)) LIKE 'claude%' THEN 'anthropic' WHEN lower(coalesce(selector, r.model_alias)) LIKE 'gemini%' THEN 'gemini' WHEN lower(coalesce(selector, r.model_alias)) LIKE 'qwen%' THEN 'dashscope' ELSE 'local' END) AS provider, coalesce(enabled, true) AS enabled
FROM (SELECT DISTINCT model_alias FROM runs) r LEFT JOIN models m ON r.model_alias = m.alias""",
    "token_limits": """WITH r AS (SELECT coalesce(provider, 'local') AS provider, usage.output_tokens AS q, CASE coalesce(provider, 'local') WHEN 'northgrid' THEN 160 WHEN 'tallow' THEN 90 ELSE 64 END AS cf FROM runs WHERE usage.output_tokens IS NOT NULL), l AS (SELECT *, greatest(q, cf) AS lim FROM r)
SELECT provider, count(*) AS n, max(lim) AS max_limit, CAST(sum(least(cf * 4, greatest(lim + 1, lim * 2))) AS BIGINT) AS sum_retry FROM l GROUP BY provider""",
}
