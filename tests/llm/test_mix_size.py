import numpy as np
import pytest

from paragrove.llm import mixing


def test_selection_is_as_large_as_the_whole_table(spark):
    docs = spark.createDataFrame([(i, "a b c d", "web" if i < 20 else None) for i in range(30)], "doc_id bigint, text string, source string")
    goal = spark.createDataFrame([("web", 1.0, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.Mix(docs, goal)
    tokens = docs.count() * mix.sized.head().n_tokens
    assert mix.selection().selectExpr("sum(n_tokens * copies) AS n").head().n == tokens
    assert not mix.report().head().short


@pytest.mark.parametrize("budget, reached", [(160_000, 150_000), (300_000, 300_000), (1_000_000, 1_000_000), (1_199_999, 1_150_000)])
def test_long_documents_fill_a_budget_as_far_as_any_choice(budget, reached):
    lengths, counts = np.array([50_000, 70_000]), np.array([10, 10])
    passes, extra = mixing.fit_budget(lengths, counts, budget, 3)
    assert passes == 0 and (extra <= counts).all() and int((lengths * extra).sum()) == reached


def test_short_sources_come_from_the_fitted_selection(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join("w" * (3 + i % 5)), "Web " if i % 3 else "books") for i in range(60)], "doc_id bigint, text string, source string")
    goal = spark.createDataFrame([("web", 0.2, 3), ("books", 0.7, 1), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    assert {r.source for r in mixing.Mix(docs, goal).report().where("short").collect()} == {"books", "none"}
    total = docs.selectExpr("sum(length(text) div 2 + 1) AS n").head().n
    assert mixing.Mix(docs, goal).selection().selectExpr("sum(n_tokens * copies) AS n").head().n == total
    monkeypatch.setattr(mixing.Mix, "selection", lambda self: self.sized.limit(0).selectExpr("doc_id", "src AS source", "n_tokens", "1L AS copies"))
    assert {r.source for r in mixing.Mix(docs, goal).report().where("short").collect()} == {"none"}
