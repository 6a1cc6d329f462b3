import pytest

from compare import connect, rows
from paragrove.llm.registry import ORACLE, QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    df = QUERIES[name](spark, SF)
    cur = connect(SF).execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cur.fetchall())


#: Queries without SQL: their columns, and a column whose values are all different.
SHAPES = {
    "p1_nearest": (["collection", "id_q", "rank", "id", "cosine"], ["collection", "id_q", "rank"]), "p2_pieces": (["chunk_id", "piece_no", "n_pieces", "piece", "start_char", "n_chars"], ["chunk_id", "piece_no"]),
    "p3_found": (["record_id"], ["record_id"]), "p3_rates": (["model_alias", "n_texts", "n_truncated", "share"], ["model_alias"]), "p4_found": (["source_table", "record_key"], ["source_table", "record_key"]),
    "p4_repaired": (["source_table", "record_key", "text", "changed"], ["source_table", "record_key"]), "p6_found": (["record_id", "defect"], ["record_id"]),
    "p6_rates": (["model_alias", "refusal", "empty", "error_text", "copies_question", "truncated", "other_language"], ["model_alias"]), "p7_containers": (["doc_id", "n_tokens", "piece_no", "piece_tokens", "container"], ["doc_id", "piece_no"]),
    "p8_selection": (["doc_id", "source", "n_tokens", "copies"], ["doc_id"]), "p8_report": (["source", "target_share", "actual_share", "selected_tokens", "selected_docs", "most_copies", "short"], ["source"]),
    "p9_posteriors": (["doc_id", "phrase_share", "sentence_share", "clause_share", "paragraph_share", "top_phrase_share", "squeeze", "posterior"], ["doc_id"])}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_shape(spark, name):
    columns, key = SHAPES[name]
    df = QUERIES[name](spark, SF).cache()
    assert df.columns == columns and df.count() > 0 and df.select(key).distinct().count() == df.count()
    assert df.where(" OR ".join(f"{k} IS NULL" for k in key if k != "model_alias") or "false").isEmpty() if key != ["model_alias"] else True
    df.unpersist()
