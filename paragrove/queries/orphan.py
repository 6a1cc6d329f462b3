"""Queries of the reference check between tables."""

from __future__ import annotations

from paragrove.operators.orphans import orphan_references, orphan_report
from paragrove.runtime import table


def p5_found(spark, sf):
    return orphan_references(table(spark, sf, "chunks"), table(spark, sf, "figures")).select("chunk_id", "ref_kind", "ref_id", "reason")


def p5_report(spark, sf):
    return orphan_report(table(spark, sf, "chunks"), table(spark, sf, "figures"))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}

_KEY = r"""regexp_replace(upper(regexp_replace(translate({0}, '‐‑‒–—―−', '-------'), '[\s\x{{00a0}}\x{{2000}}-\x{{200b}}\x{{202f}}]+', '', 'g')), '^(FIGURES?|FIGS?|TABLES?|TABS?)[.:]?-?([0-9])', '\2')"""
_CTE = f"""
WITH raw AS (
  SELECT chunk_id, manual, ingested_at, 'Figure' AS ref_kind, unnest(figure_refs) AS raw FROM chunks
  UNION ALL SELECT chunk_id, manual, ingested_at, 'Table', unnest(table_refs) FROM chunks),
refs AS (
  SELECT chunk_id, manual, ref_kind, {_KEY.format('raw')} AS ref_id, min(ingested_at) AS ref_at
  FROM raw WHERE raw IS NOT NULL GROUP BY ALL HAVING ref_id <> ''),
tgt AS (
  SELECT manual, kind AS ref_kind, {_KEY.format('canonical_id')} AS ref_id, min(ingested_at) AS first_seen, count(*) FILTER (deleted_at IS NULL) AS live
  FROM figures GROUP BY ALL),
bad AS (
  SELECT chunk_id, r.ref_kind, r.ref_id, ref_at, CASE WHEN live IS NULL THEN 'missing' WHEN live = 0 THEN 'deleted' WHEN first_seen > ref_at THEN 'late' END AS reason
  FROM refs r LEFT JOIN tgt t ON r.manual = t.manual AND r.ref_kind = t.ref_kind AND r.ref_id = t.ref_id)
"""
ORACLE = {
    "p5_found": _CTE + "SELECT chunk_id, ref_kind, ref_id, reason FROM bad WHERE reason IS NOT NULL",
    "p5_report": _CTE + """, n AS (SELECT ref_kind, strftime(ref_at, '%Y-%m') AS month, count(*) AS n_refs FROM refs GROUP BY ALL),
b AS (SELECT ref_kind, strftime(ref_at, '%Y-%m') AS month, reason, count(*) AS n_orphans FROM bad WHERE reason IS NOT NULL GROUP BY ALL)
SELECT CASE b.ref_kind WHEN 'Figure' THEN 'figure_refs' ELSE 'table_refs' END AS field, b.month, reason, n_orphans, n_refs, round(n_orphans / n_refs, 6) AS orphan_share
FROM b JOIN n ON b.ref_kind = n.ref_kind AND b.month IS NOT DISTINCT FROM n.month""",
}
