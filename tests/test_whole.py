"""What queries must read whole, beside the comparison of every query with its SQL."""

import pytest

from compare import connect, rows
from paragrove.queries import evaluation, graph, pipeline
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def same(df, duck, sql):
    cur = duck.execute(sql)
    columns = [d[0] for d in cur.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cur.fetchall())


def test_sign_bits_take_every_component(spark):
    from pyspark.sql import functions as F

    from paragrove.operators.search import hamming, sign_bits

    df = spark.createDataFrame([([1.0] * 70, [1.0] * 61 + [-1.0] * 9)], "a array<float>, b array<float>")
    assert df.select(hamming(sign_bits(F.col("a")), sign_bits(F.col("b")))).head()[0] == 9


def test_answer_extract_takes_every_record(spark, duck, tmp_path):
    got = evaluation.answer_extract(spark, SF)
    assert got.count() == duck.execute("SELECT count(DISTINCT record_id) FROM runs").fetchone()[0]
    cases = [("markdown_section", "### Answer\nYes.\n### Debug\nz", 4), ("markdown_section", "Yes.\n### Figures\nz", 4), ("markdown_section", "### Answer", 0), ("stdout", "log\nFinal answer: Yes.\ncontext: z", 4), ("stdout", "The answer is no.", 17), ("return_key", None, 0), ("not_found", None, 0), (None, "Yes.", 0)]
    spark.createDataFrame([(i, m, a) for i, (m, a, _) in enumerate(cases)], "record_id bigint, answer_extraction_method string, answer string").write.parquet(f"{tmp_path}/runs.parquet")
    rows_ = {r.record_id: r for r in evaluation.answer_extract(spark, str(tmp_path)).collect()}
    assert [rows_[i].n_chars for i in range(len(cases))] == [n for _, _, n in cases]
    assert [rows_[i].method == "not_found" for i in range(len(cases))] == [n == 0 for _, _, n in cases]


def test_proximity_of_every_figure_up_to_six_hops(spark, duck):
    hops = ", ".join(f"s{d} AS (SELECT DISTINCT qid, b AS id, {d} AS depth FROM s{d - 1} JOIN ug ON id = a)" for d in range(1, 7))
    seen = " UNION ALL ".join(f"SELECT * FROM s{d}" for d in range(7))
    same(graph.kg_proximity(spark, SF), duck, f"""WITH {graph.G}, s0 AS (SELECT manual AS qid, id, 0 AS depth FROM nodes WHERE kind = 'Figure' AND NOT unresolved), {hops}, m AS (SELECT qid, id, min(depth) AS d FROM ({seen}) GROUP BY 1, 2),
k AS (SELECT manual AS qid, 'chunk:' || chunk_id AS id FROM c) SELECT qid, round(CASE WHEN d IS NULL THEN 0.0::DOUBLE ELSE 1 / (1 + d) END, 6) AS score, count(*) AS n FROM k LEFT JOIN m USING (qid, id) GROUP BY 1, 2""")


def test_ask_plan_asks_with_the_chunks_words(spark, monkeypatch):
    asked, plain = [], pipeline.ask.retrieve
    monkeypatch.setattr(pipeline.ask, "retrieve", lambda q, corpus, **k: (asked.append((q, k)), plain(q, corpus, **k))[1])
    pipeline.ask_plan(spark, SF)
    q, settings = asked[0]
    assert settings.get("hops", 6) == 6 and q.select("question").distinct().count() > 1
    assert q.where("question LIKE 'What does Section %'").count() == 0
