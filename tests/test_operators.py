"""Worked examples and edge cases of the core operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paragrove.functions import ids, text
from paragrove.operators import evalrun, figures, graph, lexical, orphans, prompt, router, search, segment
from paragrove.runtime import Shelf
from paragrove.sources import files
from paragrove.streaming import progress

D = dt.datetime
CHUNKS = "chunk_id string, manual string, figure_refs array<string>, table_refs array<string>, ingested_at timestamp, live int, ref_id string"
FIGURES = "manual string, kind string, canonical_id string, ingested_at timestamp, deleted_at timestamp, reason string"


def value(spark, column, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(column.alias("x")).head().x


def test_orphans_of_every_reason(spark):
    early, late = D(2025, 1, 1), D(2025, 6, 1)
    chunks = spark.createDataFrame([
        ("a", "M", ["Figure 2b–1", " 2B-1", None, ""], None, early, 1, "x"), ("a", "M", ["2B-1"], [], late, 1, "x"),
        ("b", "M", ["2B-2"], ["Table 2B- 1"], early, 1, "x"), ("c", "M", ["2B-3"], ["9Z-9"], early, 1, "x"), ("d", None, ["2B-1"], None, late, 1, "x"), ("e", "M", None, None, early, 1, "x")], CHUNKS)
    figs = spark.createDataFrame([
        ("M", "Figure", "2B-1", early, None, "z"), ("M", "Figure", "2B-2", early, late, "z"), ("M", "Figure", "2b-2", early, late, "z"), ("M", "Table", "2B-1", late, None, "z"), ("M", "Figure", "2B–3", late, None, "z"), ("N", "Figure", "9Z-9", early, None, "z")], FIGURES)
    want = {("b", "Figure", "2B-2", "deleted"), ("b", "Table", "2B-1", "late"), ("c", "Figure", "2B-3", "late"), ("c", "Table", "9Z-9", "missing"), ("d", "Figure", "2B-1", "missing")}
    for heavy in (1, 3, 4_096):
        got = orphans.orphan_references(chunks, figs, heavy_cells=heavy).collect()
        assert {(r.chunk_id, r.ref_kind, r.ref_id, r.reason) for r in got} == want and len(got) == len(want)
    empty_c, empty_f = chunks.limit(0), figs.limit(0)
    assert orphans.orphan_references(empty_c, figs).count() == 0
    assert {r.reason for r in orphans.orphan_references(chunks, empty_f).collect()} == {"missing"}
    assert {r.field for r in orphans.orphan_report(chunks, figs).collect()} == {"figure_refs", "table_refs"}


def test_orphan_split_bounds_every_cell(spark):
    """A key with a third of all references is broadcast; what is left for the shuffle is below total / heavy_cells in every cell."""
    from paragrove.runtime import Shelf, heaviest, split_join

    rows = [(f"h{i}", "M", ["1A-1"], None, D(2025, 1, 1 + i % 28), 1, "x") for i in range(60)] + [(f"r{i}", f"N{i % 40}", [f"2B-{i}"], None, D(2025, 2, 1), 1, "x") for i in range(120)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    figs = spark.createDataFrame([("M", "Figure", "1A-1", D(2025, 1, 15), None, "z")], FIGURES)
    refs = orphans.references(chunks)
    cells = Shelf(spark).keep(orphans.orphan_cells(refs, figs), "cells")
    hot = {(r.manual, r.ref_id, r.month) for r in heaviest(cells, orphans.CELL, "n_refs", 3).collect()}
    assert ("M", "1A-1", "2025-01") in hot and len(hot) == 3
    left = [r.n_refs for r in cells.collect() if (r.manual, r.ref_id, r.month) not in hot]
    assert max(left) <= sum(r.n_refs for r in cells.collect()) / 3
    got = orphans.orphan_references(chunks, figs, heavy_cells=3)
    plan = got._jdf.queryExecution().toString()
    assert "LeftAnti" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" in plan and "Union" in plan
    late = [r for r in got.collect() if r.reason == "late"]
    assert {r.chunk_id for r in late} == {f"h{i}" for i in range(60) if 1 + i % 28 < 15} and got.where("reason = 'missing'").count() == 120
    report = {(r.reason): r.n_orphans for r in orphans.orphan_report(chunks, figs, heavy_cells=3).collect()}
    assert report == {"late": len(late), "missing": 120}
    none = split_join(refs.withColumn("month", F.lit(None).cast("string")), cells.limit(0), orphans.CELL, "n_refs", Shelf(spark), "none")
    assert none.count() == 0


def test_shelf_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    import os
    from types import SimpleNamespace

    from paragrove import runtime

    away = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        runtime.shared_dir(away)
    shelf = runtime.Shelf(spark)
    assert shelf.keep(spark.range(3), "a").count() == 3
    folder = shelf.root.removeprefix("file://").removeprefix("file:")
    assert os.listdir(folder)
    shelf.drop("a")
    assert not os.path.exists(f"{folder}/a")
    shelf.drop()
    assert not os.path.exists(folder)


def test_ids(spark):
    assert value(spark, ids.reference_key(F.col("a")), a="fig. 2b – 14") == "2B-14"
    assert value(spark, ids.reference_key(F.col("a")), a="Table2C-1") == "2C-1"
    import hashlib
    assert value(spark, ids.stable_id(F.col("a")), a="x:1") == int.from_bytes(hashlib.sha1(b"x:1").digest()[:8], "big") >> 1


@pytest.mark.parametrize("line, want", [
    ("Figure 9E-12. Examples of Boxes (Sheet 1 of 2)", ("Figure", "9E-12", 1, 2, "Examples of Boxes")),
    ("Table 6P-1 (Sheet 1 of 2). Title", ("Table", "6P-1", 1, 2, "Title")), ("Figure4F- 1. Lost space", ("Figure", "4F-1", None, None, "Lost space")),
    ("Table 2C-1 may be used.", None), ("Figure 9D-2 shows examples...", None), ("Figure 2B-1. Title ........ 12", None), ("Figure 2B-1. " + "x" * 150, None)])
def test_captions(spark, line, want):
    got = value(spark, text.caption(F.col("a")), a=line)
    assert (tuple(got) if got else None) == want


def test_text_functions(spark):
    assert value(spark, text.category(F.col("a")), a="OM1-1") == "ObjectMarker" and value(spark, text.category(F.col("a")), a="Z1") == "Unknown"
    assert value(spark, text.modal_verbs(F.col("a")), a="It Shall and may; shall") == ["may", "shall"]
    assert value(spark, text.sentences(F.col("a")), a="This is one long sentence. No. And here is another one!") == ["This is one long sentence.", "And here is another one!"]
    assert value(spark, text.chapter_of(F.col("a")), a="2B-14") == "2B"
    assert value(spark, text.content_text(F.col("a")), a='[{"type":"thinking","text":"hm"},{"type":"text","text":"a"},{"type":"text","text":"b"}]') == "a\nb"
    assert value(spark, text.caption(F.col("a")), a=None) is None


def test_segmentation_rules(spark):
    lines = ["Section 2B.04 Stop", "stray", "Standard:", "01", "First line", "second line", "Page 12", "02", "Next", "Guidance:", "no number", "03", "Last", "Section 2B.05 Other", "04", "Not ours"]
    df = spark.createDataFrame([("m", "2B.04", i, 10 + i // 7, s) for i, s in enumerate(lines)], "doc string, section_id string, pos long, page int, line string")
    got = sorted((r.rule, r.ordinal, r.page, r.text) for r in segment.segment(df, ["doc"]).collect())
    assert got == [("Guidance", 3, 11, "Last"), ("Standard", 1, 11, "First line second line"), ("Standard", 2, 11, "Next")]
    again = spark.createDataFrame([("m", "2B.04", i, 1, s) for i, s in enumerate(["Section 2B.04 Stop", "Standard:", "01", "Lost", "Section 2B.04 Stop", "Standard:", "02", "Kept"])], df.schema)
    assert [(r.ordinal, r.text) for r in segment.segment(again, ["doc"]).collect()] == [(2, "Kept")]
    assert segment.segment(df.limit(0), ["doc"]).count() == 0


def test_regions_share_a_row(spark):
    caps = spark.createDataFrame([("p", 1, "Table", "4C-6", None, 100.0, 112.0, 40.0, False), ("p", 2, "Table", "4C-7", None, 103.0, 115.0, 320.0, False), ("p", 3, "Figure", "4C-1", None, 400.0, 412.0, 40.0, False), ("p", 4, "Figure", "4C-1", None, 500.0, 512.0, 40.0, True), ("p", 5, "Figure", "4C-9", None, 730.0, 742.0, 40.0, False)],
                                 "page string, key long, kind string, canonical_id string, sheet int, y_top double, y_bot double, x_left double, inset boolean")
    got = {r.key: (r.x0, r.y0, r.x1, r.y1) for r in figures.regions(caps, ["page"]).collect()}
    assert got == {1: (22.0, 116.0, 312.0, 394.0), 2: (310.0, 119.0, 590.0, 394.0), 3: (22.0, 416.0, 590.0, 724.0)}


def test_census_and_gate(spark):
    texts = spark.createDataFrame([("m", "See Figure 2B-1.\n2018 AASHTO Policy, Table 3-1"), ("m", "Figure2B- 2\nand Table 3-1 of AASHTO"), ("n", None)], "manual string, text string")
    figs = spark.createDataFrame([("m", "Figure", "2B-1")], "manual string, kind string, canonical_id string")
    c = figures.census(texts, "manual")
    assert {(r.kind, r.canonical_id, r.external) for r in c.collect()} == {("Figure", "2B-1", False), ("Figure", "2B-2", False), ("Table", "3-1", True)}
    rep = {r.kind: r.coverage for r in figures.coverage(c, figs, "manual").collect()}
    assert rep == {"Figure": 0.5, "Table": 1.0}
    with pytest.raises(figures.CoverageError):
        figures.check(figures.coverage(c, figs, "manual"))


def test_router(spark):
    q = spark.createDataFrame([("Does Figure 2B-14 apply?",), ("What does shall mean here?",), ("Where should the sign be placed?",), (None,)], "question string")
    got = [(r.needs_figures, r.max_figures) for r in router.route(q).collect()]
    assert got == [(True, 4), (False, 0), (False, 0), (False, 0)]


def test_search(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "id long, vec array<float>")
    q = spark.createDataFrame([(9, [2.0, 0.1])], "qid long, vec array<float>")
    assert [(r.id, r.rank) for r in search.dense_topk(q, v, 2, dim=2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert search.dense_topk(q.limit(0), v, 2, dim=2).count() == 0
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid long, id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "qid long, id long, rank int")
    fused = [(r.id, round(r.score, 6)) for r in search.rrf([a, b], 3).orderBy("rank").collect()]
    assert fused == [(11, round(1 / 62 + 1 / 61, 6)), (10, round(1 / 61, 6)), (12, round(1 / 62, 6))]
    s = spark.createDataFrame([(1, {1: 2.0, 2: 1.0}), (2, {2: 1.0}), (3, {}), (4, None)], "id long, sparse map<int, float>")
    hits = search.sparse_topk(s.where("id = 1").withColumnRenamed("id", "qid"), s, 5)
    assert [(r.id, r.score) for r in hits.orderBy("rank").collect()] == [(1, 5.0), (2, 1.0)]


def test_graph_reach_and_proximity(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "d", "x"), ("a", "b", "x"), ("e", "f", "x")], "src string, dst string, label string")
    seeds = spark.createDataFrame([(1, "a"), (1, "a"), (2, "zz")], "qid int, id string")
    got = sorted((r.qid, r.id, r.depth) for r in graph.reach(edges, seeds, 2).collect())
    assert got == [(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "zz", 0)]
    cand = spark.createDataFrame([(1, "d"), (1, "b"), (1, "f")], "qid int, id string")
    assert {r.id: r.score for r in graph.proximity(edges, seeds, cand).collect()} == {"d": 0.25, "b": 0.5, "f": 0.0}


def test_runs(spark):
    rows = spark.createDataFrame([(1, "r", "m", "q1", 1, "ok", D(2025, 1, 1)), (2, "r", "m", "q1", 1, "ok", D(2025, 1, 2)), (3, "r", "m", "q2", 1, "error", D(2025, 1, 1))], "record_id long, run_id string, model_alias string, question_id string, replicate int, status string, completed_at timestamp")
    v = evalrun.validation(rows).head()
    assert (v.raw_rows, v.effective_ok, v.surplus_ok, v.unresolved) == (3, 1, 1, 1)
    assert [r.record_id for r in evalrun.effective(rows).collect()] == [2]
    models = spark.createDataFrame([("m", "s", True), ("off", "s", False)], "alias string, selector string, enabled boolean")
    questions = spark.createDataFrame([("q1", "a?"), ("q2", "b?")], "question_id string, question string")
    todo = evalrun.resume(evalrun.plan(models, questions), rows)
    assert [(r.model_alias, r.question_id) for r in todo.collect()] == [("m", "q2")]
    got = evalrun.answer_all(todo, lambda s, q: "" if q == "b?" else "yes", attempts=2).head()
    assert (got.status, got.attempts, got.error) == ("error", 2, "empty answer")
    assert evalrun.ablated(evalrun.Settings(), "A3_no_graph").w_graph == 0.0
    assert value(spark, evalrun.filter_reply(F.col("a")), a="Keep [0, 3, 7]") == [0, 3, 7] and value(spark, evalrun.filter_reply(F.col("a")), a="nothing") == []
    assert evalrun.missing_columns(rows) == ["model_id", "question", "answer"]


def test_prompt_and_lexical(spark):
    hits = spark.createDataFrame([(1, 1, "Option", "2B.01", 3, "T", "", "may"), (1, 2, "Standard", "2B.02", 1, None, "7", "shall")], "qid int, rank int, kind string, section_id string, ordinal int, section_title string, page_printed string, text string")
    ev = prompt.evidence(hits).head().evidence
    assert ev.index("Standard provisions") < ev.index("Option provisions") and "[Section 2B.01 §3 — T (p.?)]\nmay" in ev
    assert prompt.whitelist(hits).head().allowed == ["Section 2B.01 Option §3 (p.?)", "Section 2B.02 Standard §1 (p.7)"]
    q = spark.createDataFrame([(1, "what is on page 5")], "qid int, query string")
    none = spark.createDataFrame([], "qid int, page int, score double, rank int")
    assert [r.page for r in lexical.fuse_pages(q, none, none).orderBy("rank").collect()] == [5, 4, 6]


def test_sources(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"question_id": "a", "question": "x?"}\n\n{"question_id": "b", "question": "y?"}\n')
    path = f"file://{tmp_path}/q.jsonl"
    assert files.load_questions(spark, path, files.Contract(rows=2)).count() == 2
    for contract, keys in ((files.Contract(rows=3), ()), (files.Contract(sha256="0"), ()), (files.Contract(), ("question",))):
        with pytest.raises(files.ContractError):
            files.load_questions(spark, path, contract, keys)
    (tmp_path / "old.jsonl").write_text('{"figure_id": "Figure 2B-4", "kind": "Figure", "referenced_in_chunks": []}\n')
    old = files.read_figures(spark, f"file://{tmp_path}/old.jsonl").head()
    assert (old.canonical_id, old.chapter, old.extraction_method, old.sign_codes_depicted) == ("2B-4", "2B", "caption_above_v1", [])
    (tmp_path / "l.xml").write_text('<doc><line xMin="1" yMin="2" xMax="9" yMax="4"><word xMin="5" xMax="9" yMin="2" yMax="4">two</word><word xMin="1" xMax="4" yMin="2" yMax="4">one</word></line></doc>')
    assert files.xml_lines(spark, f"file://{tmp_path}/l.xml").head().line == "one two"
    assert files.table_or_empty(spark, f"file://{tmp_path}/none", "a int").count() == 0
    pages = files.pages_of(spark.createDataFrame([("d", "Figure 2B-1. A\nPage 3\fno caption")], "doc string, text string"))
    assert [(r.page, r.label) for r in pages.orderBy("page").collect()] == [(1, "3"), (2, None)] and files.candidate_pages(pages).count() == 1
    files.write_manifest(f"{tmp_path}/m.json", {"a": 1})
    assert (tmp_path / "m.json").read_text().strip().startswith("{")


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "r", "ok"), (1, "r", "ok"), (2, "r", "error")], "record_id long, run_id string, status string")
    df.write.parquet(f"{tmp_path}/log")
    s = lambda: progress.log(spark, f"file://{tmp_path}/log", df.schema)
    assert progress.run_append(progress.dedup(s(), ["record_id"]), "x").count() == 2
    assert tuple(progress.run_complete(progress.progress(s(), "run_id"), "y").head()) == ("r", 3, 2, 1)


def test_proximity_makes_no_row_per_node_passed(spark, monkeypatch):
    from paragrove import runtime

    links = [(f"m{i}", "hub") for i in range(90)] + [("hub", f"n{i}") for i in range(300)] + [("n0", "o"), ("o", "p"), ("p", "q"), ("q", "r"), ("x", "y"), ("y", "y")]
    edges = spark.createDataFrame([(a, b, "l") for a, b in links], "src string, dst string, label string")
    seeds = spark.createDataFrame([(f"q{i}", f"m{i}") for i in range(90)] + [("q0", "lone"), ("q0", None), (None, "hub")], "qid string, id string")
    wanted = [(f"q{i}", f"n{i}", 1 / 3) for i in range(90)] + [("q0", "r", 1 / 7), ("q1", "m1", 1.0), ("q0", "lone", 1.0), ("q2", "y", 0.0), ("q2", "nowhere", 0.0), ("other", "hub", 0.0), (None, "hub", 0.0), ("q3", None, 0.0), ("q3", "hub", 0.5), ("q3", "hub", 0.5)]
    cand = spark.createDataFrame([w[:2] for w in wanted], "qid string, id string")
    kept, keep = [], runtime.Shelf.keep
    monkeypatch.setattr(runtime.Shelf, "keep", lambda self, df, name: (t := keep(self, df, name), kept.append(t.count()))[0])
    order = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert order(graph.proximity(edges, seeds, cand).collect()) == order(wanted)
    assert order(graph.proximity(edges, seeds, cand, 5).where("id = 'r'").collect()) == order([("q0", "r", 0.0)])
    assert max(kept) <= len(links)


def test_node_numbers_that_collide_are_made_anew(spark, monkeypatch):
    hashed, calls = F.xxhash64, []
    same = lambda *c: hashed(*c) if not isinstance(c[0], str) or (calls.append(1), len(calls) > 3)[1] else F.lit(5).cast("bigint")
    monkeypatch.setattr(graph.F, "xxhash64", same)
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    pairs, number = graph.coded(edges, spark.createDataFrame([("a",), ("z",)], "id string"), Shelf(spark))
    (a, b), (b2, c) = sorted(((r.a, r.b) for r in pairs.collect()), key=lambda p: p[0] != edges.where("src = 'a'").select(number("src")).head()[0])
    assert b == b2 and len({a, b, c}) == 3 and len(calls) > 3
