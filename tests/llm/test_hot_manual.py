import pytest

from paragrove.llm.scannoise import inspect


@pytest.mark.parametrize("head", ["TCM000130 REVISION 2", "[TCM000130 p. 7 ]", "Pg. 3 / 7"])
def test_heads_of_known_tokens_are_furniture(head):
    text = f"signs shall be placed {head} beside the road"
    known, words = set(text.split()), {w: 9 for w in "signs shall be placed beside the road".split()}
    assert inspect(text, known, words)[0] == ["furniture"]
    assert inspect("signs shall be placed beside the road", known, words) == ([], [], [])


def test_rare_readings_and_broken_rare_words_are_found_by_joins(spark, monkeypatch):
    """A word far below the share of the trie's vocabulary is still a reading, and its halves are still joined."""
    from paragrove.llm import scannoise

    monkeypatch.setattr(scannoise, "RARE", 0.05)
    common = "the sign shall be placed on the road and the sign shall be kept clean on the road"
    rows = [(f"c{i}", common + (" delineator" if i < 60 else "")) for i in range(400)] + [("misread", common + " dclineator"), ("broken", "the sign deline-\nator shall be placed on the road"), ("other", common + " zymurgy")]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string")
    figures = spark.createDataFrame([], "figure_key bigint, caption string")
    got = {(r.record_key, r.reason) for r in scannoise.noisy(chunks, figures).collect()}
    assert got == {("misread", "misread"), ("broken", "broken")}
    assert "delineator" in scannoise.confusable("dclineator") and scannoise.confusable("zzz") == set()
