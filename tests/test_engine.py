"""Search cells, graph store, captions in words, runner, contents, collections: edge cases and comparisons with brute force."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from paragrove.operators import content, evalrun, figures, graph, lexical, search, segment
from paragrove.plans import runner
from paragrove.runtime import Shelf
from paragrove.sources import collections, files


def vectors(spark, n, seed, name="id"):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(4)]) for i in range(n)] + [(1_000, None), (1_001, [0.0] * 4), (1_002, [1.0, 2.0])]
    return spark.createDataFrame(rows, f"{name} bigint, vec array<float>")


def test_dense_search_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(search, "ITEM_BLOCK", 10)
    items, queries = vectors(spark, 60, 1), vectors(spark, 11, 2, "qid")
    cells = search._cells
    monkeypatch.setattr(search, "_cells", lambda q, i, body, *a, **k: cells(q, i, body, 3, 10))
    got = {}
    for r in search.dense_topk(queries, items, 5, dim=4).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.id))
    x = np.array([r.vec for r in items.where("id < 60").orderBy("id").collect()], dtype=np.float64)
    q = np.array([r.vec for r in queries.where("qid < 60").orderBy("qid").collect()], dtype=np.float64)
    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == {i: list(np.argsort(-s[i])[:5]) for i in range(11)}
    assert search.dense_topk(queries.limit(0), items, 5, dim=4).count() == 0 == search.dense_topk(queries, items.limit(0), 5, dim=4).count()
    exact = {(r.qid, r.id) for r in search.binary_topk(queries.where("qid < 60"), items, 5, first=5, dim=4).collect()}
    assert exact == {(i, int(j)) for i in range(11) for j in np.argsort(-(q @ x.T)[i], kind="stable")[:5]}


def test_sparse_search_and_null_weights(spark):
    items = spark.createDataFrame([(1, {1: 1.0, 2: 2.0}), (2, {2: 1.0}), (3, {}), (4, None), (5, {9: None, 1: 3.0})], "id bigint, sparse map<int, float>")
    got = [(r.qid, r.id, r.score) for r in search.sparse_topk(items.withColumnRenamed("id", "qid"), items, 2).orderBy("qid", "rank").collect()]
    assert got == [(1, 1, 5.0), (1, 5, 3.0), (2, 1, 2.0), (2, 2, 1.0), (5, 5, 9.0), (5, 1, 3.0)]
    assert search.sparse_topk(items.limit(0).withColumnRenamed("id", "qid"), items, 2).count() == 0


def test_late_interaction_of_a_page_cut_over_cells(spark):
    pages = vectors(spark, 40, 3).where("id < 40").withColumn("id", F.when(F.col("id") < 30, 7).otherwise(F.col("id") % 3).cast("bigint"))
    queries = vectors(spark, 6, 4, "qid").where("qid < 6").withColumn("qid", F.col("qid") % 2)
    want = None
    for block in (8, 1_000):
        got = [(r.qid, r.id, r["rank"], round(r.score, 9)) for r in search.maxsim(queries, pages, 3, dim=4, block=block).orderBy("qid", "rank").collect()]
        want = want or got
        assert got == want and len(got) == 6


def test_graph_store_views_and_lookups(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "M", "Part 1", None, "2B.01", "Signs", 1, 5, "v", "Standard", ["2B-1", "9Z-9"], None, ["2B.02"], ["r1-1"]), ("c2", "M", None, "Chapter 2B. Signs", "2B.02", None, 2, 6, "vi", None, None, ["2B- 1"], [], None)],
                                   "chunk_id string, manual string, part string, chapter string, section_id string, section_title string, ordinal int, page_pdf int, page_printed string, content_type string, figure_refs array<string>, table_refs array<string>, section_refs array<string>, sign_codes array<string>")
    figs = spark.createDataFrame([("M", "Figure", "2b–1", 5, "v", "Layout", None, 1, 10, ["w1-1"]), ("M", "Table", "2B-1", 9, "ix", None, "Cap", None, 11, None)], "manual string, kind string, canonical_id string, page_pdf int, page_printed string, title string, caption string, sheet int, figure_key bigint, sign_codes_depicted array<string>")
    g = graph.build(chunks, figs)
    graph.write(g, str(tmp_path))
    g = graph.read(spark, str(tmp_path))
    nodes = {r.id: r for r in g.nodes.collect()}
    assert nodes["figure:M/2B-1"].title == "Layout" and nodes["table:M/2B-1"].title == "Cap" and nodes["figure:M/9Z-9"].unresolved and nodes["chapter:M/Chapter ?"].kind == "Chapter"
    edges = {(r.src, r.dst, r.label) for r in g.edges.collect()}
    assert {("figure:M/2B-1", "signcode:W1-1", "depicts"), ("figure:M/2B-1", "signcode:R1-1", "depicts"), ("figure:M/2B-1", "section:M/2B.01", "anchored_in"), ("chunk:c1", "section:M/2B.02", "cites_section")} <= edges
    names = spark.createDataFrame([("M", n) for n in ("2B-1", "figure 2b-1", "figure:Figure 2B-1", "Table2B - 1", "8X-1")], "manual string, name string")
    assert {r.name: r.id for r in graph.lookup_figures(names, g.nodes).collect()} == {"2B-1": "figure:M/2B-1", "figure 2b-1": "figure:M/2B-1", "figure:Figure 2B-1": "figure:M/2B-1", "Table2B - 1": "table:M/2B-1", "8X-1": None}
    targets = spark.createDataFrame([("a", "section", "Section 2b.01"), ("b", "signcode", "r1-1"), ("c", "question", "What is in Figure 2B-1?"), ("d", "color", "red")], "qid string, kind string, target string")
    assert {(r.qid, r.id) for r in graph.seeds_of(targets, g.nodes).collect()} == {("a", "section:M/2B.01"), ("b", "signcode:R1-1"), ("c", "figure:M/2B-1")}
    assert graph.view(g, "neighborhood", targets).where("qid = 'a' AND depth = 1").count() > 2 and graph.view(g, "overview").count() == 2
    for bad in (lambda: graph.view(g, "pie"), lambda: graph.view(g, "neighborhood")):
        with pytest.raises(ValueError):
            bad()
    empty = graph.build(chunks.limit(0), figs.limit(0))
    assert empty.nodes.count() == 0 == empty.edges.count()


def test_captions_in_words(spark):
    lines = {1: "01 Signs beside the road see Figure4F- 1. Beacons (Sheet 2 of 3)", 2: "Table 6P-1. Spacing", 3: "see Figure 9Z-1) and go", 4: "Figure 2B-1. Left one"}
    rows = [("M", 1, n, i, w, 40.0 + 40 * i, 100.0 * n, 100.0 * n + 9 + n, 612.0) for n, t in lines.items() for i, w in enumerate(t.split())]
    rows += [("M", 2, n, i, w, 40.0 + 40 * i, 50.0 * n, 50.0 * n + 10, 612.0) for n, t in enumerate(["Figure 1A-1. A .... 3", "Figure 1A-2. B .... 4", "Figure 1A-3. C"]) for i, w in enumerate(t.split())]
    words = spark.createDataFrame(rows, "manual string, page int, line_no int, word_no int, text string, x0 double, y0 double, y1 double, width double")
    got = {r.key: r for r in figures.detect(words, ["manual", "page"]).collect()}
    assert set(got) == {1, 2, 4} and (got[1].canonical_id, got[1].sheet, got[1].sheet_of, got[1].title, got[1].inset) == ("4F-1", 2, 3, "Beacons", True) and not got[2].inset
    mentioned = spark.createDataFrame([("M", "Table", "6P-1", False)], "manual string, kind string, canonical_id string, external boolean")
    out = {r.key: (r.y1, r.extraction_method) for r in figures.extract(words, ["manual", "page"], mentioned, "manual").collect()}
    assert out == {1: (194.0, "caption_below_v2"), 2: (394.0, "caption_below_v2"), 4: (746.0, "caption_below_v2")}
    page = spark.createDataFrame([("M", 9)], "manual string, page int")
    assert figures.detect(words, ["manual", "page"], page).count() == 0


def test_title_case_and_last_page(spark):
    rows = [("M", 1, 1, "PART 2 SIGNS", 1, 30), ("M", 2, 2, "CHAPTER 2B. REGULATORY SIGNS", 2, 30), ("M", 3, 3, "Section 2B.01 A", 3, 30), ("M", 4, 3, "Section 2B.02 B", 8, 30)]
    got = [tuple(r) for r in segment.hierarchy(spark.createDataFrame(rows, "manual string, pos int, level int, title string, page int, pages int"), "manual").orderBy("section_id").collect()]
    assert got == [("M", "2B.01", "Part 2 Signs", "Chapter 2B. Regulatory Signs", 3, 8), ("M", "2B.02", "Part 2 Signs", "Chapter 2B. Regulatory Signs", 8, 31)]


@pytest.mark.parametrize("wrong", [{"run_id": "a b"}, {"run_id": ""}, {"replicates": 0}, {"max_attempts": 0}, {"max_questions": 0}, {"models": ()}, {"models": ({},)}, {"inter_request_seconds": -1.0}])
def test_run_configs_are_checked(wrong):
    with pytest.raises(ValueError):
        runner.RunConfig(**{"run_id": "r", "models": ("m",), **wrong})


def test_models_and_config_files():
    assert runner.model_of({"model_id": "x", "enabled": 0}) == runner.Model("x", "x", None, False) and runner.model_of("a").selector == "a"
    with pytest.raises(TypeError):
        runner.model_of(3)
    assert runner.read_config("# run\nuse_router: false\nw_graph: 0.0  # off\nname: 'A3'\nn: 4\nnone: null\n") == {"use_router": False, "w_graph": 0.0, "name": "A3", "n": 4, "none": None}
    assert runner.verified("A3_no_graph").w_graph == 0.0
    with pytest.raises(KeyError):
        runner.verified("A9")


def test_runs_resume_and_sweeps_skip(spark):
    q = spark.createDataFrame([("q1", "one"), ("q2", "three"), ("q10", "ten")], "question_id string, question string")
    root = Shelf(spark).root
    config = runner.RunConfig("r1", ("m",), max_attempts=1)

    def fails(selector, question):
        if question == "three":
            raise RuntimeError("rate limit")
        return question.upper()

    first = runner.run(q, config, fails, root)
    assert {(r.question_id, r.status, r.error_type) for r in first.collect()} == {("q1", "ok", None), ("q10", "ok", None), ("q2", "error", "rate_limit")}
    assert [r.question_id for r in runner.problems(first).collect()] == ["q2"]
    again = runner.run(q, config, lambda s, t: "second", root)
    assert again.count() == 4 and again.where("answer = 'second'").count() == 1
    assert runner.run(q, config, fails, root).count() == 4
    runner.keep_successful(spark, root)
    assert runner.log(spark, root).count() == 3 and runner.manifest(runner.log(spark, root), config)["counts"] == {"rows": 3, "ok": 3, "errors": 0, "questions": 3}
    assert runner.retry(q, config, "r2", fails, root).count() == 0
    with pytest.raises(ValueError):
        runner.pick(q, ("q1", "q7"))
    with pytest.raises(ValueError):
        runner.run(q.withColumn("Gold_Answer", F.lit("x")), config, fails, root)
    two = ("baseline", "A6_no_reranker")
    done = runner.sweep(q, lambda s, t: f"{s.rerank}" if s.rerank else "", root, two)
    assert runner.unfinished(done, q, two) == ["A6_no_reranker"]
    done = runner.sweep(q, lambda s, t: "new", root, two)
    assert runner.unfinished(done, q, two) == [] and done.where("answer = 'new'").count() == 3 and done.count() == 6
    assert {(r.ablation, r.total, r.ok) for r in runner.package(done).collect()} == {("baseline", 3, 3), ("A6_no_reranker", 3, 3)}


def test_contents():
    blocks = [{"type": "Thinking", "text": "hm"}, {"type": "text", "text": " a "}, {"text": {"value": "b"}}, {"content": [{"output_text": "c"}]}, 3, None]
    assert content.block_text(blocks) == "a\nb\nc" and content.block_text(None) == "" and content.block_text({"x": 1}) == ""
    assert content.find_key({"a": {"Answer": "deep"}, "answer": None, "b": [{"answer": 0}]}, frozenset({"answer"})) == "deep"
    assert content.find_key({"a": {"a": {"a": {"a": {"a": {"k": 1}}}}}}, frozenset({"k"})) is None
    assert content.bounded({"a": list(range(5)), "b": b"x"}, most=3)["a"][-1] == {"__remaining_items_truncated__": 2} and content.bounded(b"x")["nbytes"] == 1
    deep = {"a": 1}
    for _ in range(9):
        deep = {"a": deep}
    assert "__truncated__" in json.dumps(content.bounded(deep))


def test_content_columns(spark):
    df = spark.createDataFrame([('[{"type": "text", "text": "x"}, {"id": 1}]', "A.JPG", [0, 1, 3, None]), ("plain", "b", []), (None, None, None)], "c string, p string, n array<bigint>")
    got = df.select(content.text_of(F.col("c")).alias("t"), content.block_types(F.col("c")).alias("b"), content.media_type(F.col("p")).alias("m"), content.payload_bytes(F.lit("é"), F.col("n")).alias("n"), content.bounded_json(F.col("c")).alias("j")).collect()
    assert [tuple(r)[:4] for r in got] == [("x", ["text", "object"], "image/jpeg", 10), ("plain", ["string"], "image/png", 2), ("", None, "image/png", 2)]
    assert got[0].j is not None and got[2].j is None
    mimes = spark.createDataFrame([([{"image/png": "x"}, {"text/plain": "y"}, {"text/html": "z", "image/jpeg": "w"}],)], "m array<map<string, string>>")
    assert mimes.select(content.image_outputs(F.col("m")).alias("n")).head().n == 2


def test_filter_replies(spark):
    cand = spark.createDataFrame([("a", i, i != 1) for i in range(5)] + [("b", 0, True)] + [("c", i, True) for i in range(3)] + [("d", 0, False)], "qid string, pos int, usable boolean")
    replies = spark.createDataFrame([("a", "[4, 1, 0, 4, 2]"), ("c", "none"), ("b", "[9]")], "qid string, reply string")
    got = {}
    for r in evalrun.usable_replies(cand, replies, 2).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.pos)
    assert got == {"a": [4, 0], "b": [0], "c": [0, 1]}


def test_collections_and_encodings(spark, tmp_path):
    root = str(tmp_path)
    collections.create(spark, root)
    assert collections.readiness(spark, root, {"chunks": "true"}) == {"chunks": False}
    row = spark.sql("SELECT 1L AS id, array(cast(1 AS float)) AS dense, map(1, cast(1 AS float)) AS sparse, named_struct('chunk_id', 'c', 'section_id', 's', 'content_type', 't', 'page_pdf', 1) AS payload, timestamp_ntz'2025-01-01' AS upserted_at")
    collections.upsert(spark, root, "chunks", row)
    collections.upsert(spark, root, "chunks", row.withColumn("dense", F.array(F.lit(2.0).cast("float"))).withColumn("upserted_at", F.expr("timestamp_ntz'2025-02-01'")))
    assert [r.dense for r in collections.read(spark, root, "chunks").collect()] == [[2.0]]
    texts = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "id bigint, text string")
    encode, asked = collections.hashed_encoder(8), []
    cache = collections.encode_missing(texts, encode(texts.limit(0)).withColumn("content_sha", F.lit("")), encode)
    cache = Shelf(spark).keep(cache, "cache")
    later = collections.encode_missing(texts.withColumn("text", F.when(F.col("id") == 1, "a b a").otherwise("new")), cache, lambda df: asked.append(df.count()) or encode(df))
    assert asked == [2] and later.count() == 3 and sum({r.id: r.sparse for r in later.collect()}[1].values()) == 3.0
    assert collections.hashed_patches(texts, 8, 2).count() == 2 and encode(texts).where("id = 2").head().sparse == {}


def test_first_generation(spark, tmp_path):
    path = tmp_path / "sections.json"
    path.write_text(json.dumps([{"section": " 1A.01 ", "page_num": 7, "text": "x"}, {"section": "1A.02", "title": "T", "page_num": 8, "text": None, "image_path": "p.png"}]))
    assert [tuple(r) for r in files.read_sections(spark, str(path)).collect()] == [("1A.01", "", 7, "x", "pages/page_0007.png"), ("1A.02", "T", 8, "", "p.png")]
    pages = spark.createDataFrame([(1, ["Stop sign"], [], ["R1-1"]), (2, [], [], [])], "page int, figure_captions array<string>, table_titles array<string>, sign_codes array<string>")
    scores = spark.createDataFrame([("q", 1, 0.1), ("q", 2, 0.3)], "qid string, page int, score double")
    asked = spark.createDataFrame([("q", "stop here")], "qid string, query string")
    assert [r.page for r in lexical.hybrid_pages(scores, asked, pages, ["page"], 1).collect()] == [1]
    boost = pages.select(lexical.page_boost(F.lit("stop sign"), F.lit("A  STOP sign stands")).alias("b")).collect()
    assert [round(r.b, 6) for r in boost] == [round(0.10 + 0.30 + 0.08 + 0.04, 6), 0.10]
    hits = spark.createDataFrame([("q", i, t) for i, t in enumerate(["Standard: 01 same text", "Guidance 02 same text", "b", "c", "d"])], "qid string, rank int, text string")
    assert lexical.joined_context(hits).head().context == "same text\n\nb\n\nc"


def test_late_interaction_against_brute_force(spark):
    rng = np.random.default_rng(5)
    page = rng.integers(0, 12, 400)
    page[:150] = 3  # a page that is cut over cells
    x, v, owner = rng.standard_normal((400, 8)), rng.standard_normal((70, 8)) * 10.0 ** rng.integers(-3, 4, 70)[:, None], np.r_[np.arange(60), np.full(10, 60)]
    x[200] = x[300] = 5 * v[0]  # one best patch of two pages
    pages = spark.createDataFrame([(int(i), a.tolist()) for i, a in zip(page, x)] + [(99, None), (98, [1.0])], "id bigint, vec array<double>")
    queries = spark.createDataFrame([(int(i), a.tolist()) for i, a in zip(owner, v)] + [(70, None)], "qid bigint, vec array<double>")
    top = np.stack([(v @ x[page == p].T).max(1) for p in range(12)], axis=1)
    score = np.stack([top[owner == q].sum(0) for q in range(61)])
    want = {(q, n + 1, int(p)) for q in range(61) for n, p in enumerate(np.lexsort((np.arange(12), -np.round(score[q], 9)))[:3])}
    for block in (40, 10_000):
        assert {(r.qid, r["rank"], r.id) for r in search.maxsim(queries, pages, 3, dim=8, block=block).collect()} == want


def test_late_interaction_multiplies_queries_together():
    rng = np.random.default_rng(6)
    v, x, start = rng.standard_normal((300, 8)), rng.standard_normal((500, 8)), np.array([0, 1, 90, 400])
    qs = np.r_[np.arange(250), 250]
    got = list(search._page_sums(v, qs, x, start))
    assert len(got) == 1 and got[0][1].shape == (251, 4)
    top = np.maximum.reduceat(v @ x.T, start, axis=1)
    exact = np.r_[top[:250], top[250:].sum(0)[None]]
    norm = np.sqrt((v * v).sum(1))
    unit = np.r_[norm[:250], norm[250:].max()][:, None] * np.sqrt((x * x).sum(1).max())
    assert (np.abs(got[0][1] * unit - exact) <= got[0][2][:, None] * unit).all()


def test_ask_pages_needs_no_graph(spark, monkeypatch):
    from paragrove.queries import pipeline

    monkeypatch.setattr(pipeline, "built", None)
    assert pipeline.ask_pages(spark, "/root/testdata/sf0.001").count() > 0


def test_best_of_rows_by_a_bound_of_stretches(monkeypatch):
    rng = np.random.default_rng(8)
    s = np.round(rng.standard_normal((20, 3_000)), 2)
    s[3], s[4], s[4, [5, 7]] = 1.0, -np.inf, [2.0, -3.0]
    sorted_, sizes, plain = np.sort(s, axis=1), [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *x, **k: (sizes.append(a.size), plain(a, *x, **k))[1])
    t = search._best(s, np.arange(20), np.arange(3_000) * 10, 4, 1e-12)
    got = sorted(zip(t["qid"].to_pylist(), t["id"].to_pylist(), t["score"].to_pylist()))
    assert got == [(i, int(j) * 10, s[i, j]) for i in range(20) for j in np.flatnonzero((s[i] >= sorted_[i, -4]) & np.isfinite(s[i]))]
    assert sum(sizes) < s.size / 50
