import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paragrove.llm import mixing, packing, pairs, repetition, scannoise, splitting, tokens, truncation

LIMITS = [("Standard ", 100, 10), ("option", 60, 6)]
ITEMS = "chunk_id string, text string, content_type string, ingested_at timestamp, piece string, _max int"


def test_splitting(spark):
    limits = spark.createDataFrame(LIMITS, "content_type string, max_chars int, overlap_chars int")
    prose = "One sentence stands here. " * 20 + "\n\n" + "Another paragraph follows it. " * 9
    rows = [("a", prose, "STANDARD", None, "x", 1), ("a", prose, "standard", None, "x", 1), ("b", "x" * 1000, " Option", None, "x", 1), ("c", "y" * 60, "option", None, "x", 1), ("d", prose, None, None, "x", 1), ("e", None, "option", None, "x", 1),
            ("f", "", "option", None, "x", 1), ("g", "é😀 " * 100, "option", None, "x", 1), ("h", prose, "unknown", None, "x", 1), ("i", ("wort " * 30_000), "standard", None, "x", 1), (None, prose, "standard", None, "x", 1)]
    df = spark.createDataFrame(rows, ITEMS)
    out = {}
    for r in splitting.split_oversized(df, limits).collect():
        out.setdefault(r.chunk_id, []).append(r)
    assert set(out) == {"a", "b", "g", "i"}
    text = {r[0]: r[1] for r in rows}
    most = {"a": 100, "b": 60, "g": 60, "i": 100}
    for key, ps in out.items():
        ps.sort(key=lambda r: r.piece_no)
        end = 0
        assert [p.piece_no for p in ps] == list(range(ps[0].n_pieces))
        for p in ps:
            assert p.piece == text[key][p.start_char:p.start_char + p.n_chars] and 0 < p.n_chars <= most[key] and p.start_char <= end
            end = p.start_char + p.n_chars
        assert end == len(text[key])
    cuts = [p.piece for p in sorted(out["a"], key=lambda r: r.piece_no)][:-1]
    assert all(re.search(r"[.]\s*$", c) for c in cuts)
    assert splitting.split_oversized(df.limit(0), limits).count() == 0 and splitting.split_oversized(df, limits.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a, b.", "x_1--y", "été ²½", "  ", "", "日本 語!", "a b​c", "\x1ca\x85b", "é"])
def test_tokens_equal_the_tokenizer(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(tokens.n_tokens(F.col("t")).alias("n")).head().n
    assert got == len(re.findall(r"\w+|[^\w\s]+", text))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=200))
def test_packing_plan(sizes):
    counts = {s: sizes.count(s) for s in set(sizes)}
    placed, opened = packing.plan(counts, 100)
    fill, seen = {}, {s: set() for s in counts}
    for size, rank, n, first in placed.tolist():
        for i in range(n):
            fill[first + i] = fill.get(first + i, 0) + size
            assert rank + i not in seen[size]
            seen[size].add(rank + i)
    assert {s: len(r) for s, r in seen.items()} == counts and all(seen[s] == set(range(n)) for s, n in counts.items())
    assert all(v <= 100 for v in fill.values()) and len(fill) == opened
    assert opened <= 1.7 * (sum(sizes) / 100) + 2


def test_packing_in_shards(spark):
    """Many shards: whole items, no container above the capacity, numbers without gaps, and hardly more containers than one shard needs."""
    import random

    rng = random.Random(5)
    rows = [(i % 700, rng.choice([0, 1, 7, 30, 90, 100, 101, 250])) for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").repartition(4)
    used = {}
    for shard_rows in (100, 10_000):
        out = packing.pack(df, 100, shard_rows=shard_rows).toPandas()
        assert len(out) == sum(max(1, -(-n // 100)) for _, n in rows) and (out.container.isna() == (out.n_tokens == 0)).all()
        fill = out.dropna().groupby("container").piece_tokens.sum()
        assert fill.max() <= 100 and sorted(fill.index) == list(range(len(fill))) and out.piece_tokens.sum() == sum(n for _, n in rows)
        used[shard_rows] = len(fill)
    assert used[100] <= 1.01 * used[10_000] and used[10_000] <= 1.05 * sum(n for _, n in rows) / 100


def test_packing(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([7, 100, 100, 100, 333, 900]), 1, 1) for i in range(600)] + [(1000, 2500, 1, 1), (1001, 2048, 1, 1), (1002, 0, 1, 1), (1003, None, 1, 1), (5, 100, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, rank int, size int")
    out = packing.pack(df, 1024).collect()
    fill = {}
    for r in out:
        if r.container is not None:
            fill[r.container] = fill.get(r.container, 0) + r.piece_tokens
    total = sum(r[1] or 0 for r in rows)
    assert max(fill.values()) <= 1024 and sum(fill.values()) == total and len(fill) <= total / 1024 * 1.03 + 2
    big = sorted(r.piece_tokens for r in out if r.doc_id == 1000)
    assert big == [452, 1024, 1024] and [r.piece_tokens for r in out if r.doc_id == 1001] == [1024, 1024]
    assert all(sum(1 for r in out if r.doc_id == k) == n for k, n in ((0, 1), (5, 2), (1002, 1), (1003, 1)))
    assert packing.pack(df.limit(0), 1024).count() == 0
    docs = spark.createDataFrame([("a", "one two"), ("b", None)], "doc_id string, text string")
    assert {r.doc_id: r.container for r in packing.pack_documents(docs, 10).collect()} == {"a": 0, "b": None}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 3)), max_size=6, unique_by=lambda x: x[0]), st.integers(0, 200))
def test_knapsack_is_optimal(items, budget):
    reach = {0}
    for length, n in items:
        reach = {r + k * length for r in reach for k in range(n + 1)}
    used = mixing.knapsack([x[0] for x in items], [x[1] for x in items], budget)
    assert all(0 <= u <= n for u, (_, n) in zip(used, items)) and sum(u * x for u, (x, _) in zip(used, items)) == max(r for r in reach if r <= budget)


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(3, 60), rng.choice(["A", " a ", "b", "B", "b", None, "zzz"]), 1, 1) for i in range(900)] + [(2000, None, "a", 1, 1), (2001, "w " * 40, "c", 1, 1), (2002, "", "  ", 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rank int, salt int")
    goal = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 2), ("c", 0.2, 2), ("d", 0.0, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.Mix(df, goal)
    plan = {r.source: r for r in mix.report().collect()}
    assert plan["c"].short and not plan["a"].short and plan["d"].selected_tokens == 0
    rep = {r.source: r for r in mix.report().collect()}
    total = sum(len(r[1] or "") // 2 for r in rows)  # of all documents
    assert abs(sum(r.selected_tokens for r in rep.values()) - total) <= 3
    assert rep["c"].selected_tokens == 80 and all(r.most_copies <= m for r, m in ((rep["a"], 3), (rep["b"], 2)))
    rest = (total - 80) / 0.8
    assert abs(rep["a"].selected_tokens - 0.5 * rest) <= 2 and abs(rep["b"].selected_tokens - 0.3 * rest) <= 2
    picked = mix.selection().collect()
    assert len({r.doc_id for r in picked}) == len(picked)
    assert mixing.Mix(df.limit(0), goal).selection().count() == 0 and mixing.Mix(df, goal.limit(0)).selection().count() == 0


def brute_share(text):
    w = [x.lower() for x in re.findall(r"[^\W\d_]+", text)]
    seen, mark = set(), [False] * len(w)
    for i in range(len(w) - 7):
        k = tuple(w[i:i + 8])
        if k in seen:
            mark[i:i + 8] = [True] * 8
        seen.add(k)
    return sum(mark) / len(w) if w else 0.0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "d e f g h i j k", "l", "1", "M.", "a b a b a b a b"]), max_size=60))
def test_repetition_share(parts):
    text = " ".join(parts)
    assert abs(repetition.measure(text)[1] - brute_share(text)) < 1e-12


def test_repetition(spark):
    unique = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    loop = "this very same sentence repeats itself over and over. " * 30
    rows = [(1, unique, 1.0), (2, loop, 1.0), (3, None, 1.0), (4, "", 1.0), (5, "12 34", 1.0), (2, loop, 1.0), (6, loop * 300, 1.0)] + [(10 + i, unique + str(i), 1.0) for i in range(30)]
    out = repetition.repetition(spark.createDataFrame(rows, "doc_id long, text string, share double")).collect()
    assert len(out) == len(rows)
    assert all((r.share >= 0.9 and r.posterior > 0.5) == (r.doc_id in (2, 6)) for r in out)
    assert repetition.repetition(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repetition_is_decided_by_the_label_model(spark, monkeypatch):
    """The posterior decides who is a candidate: without it nothing is found, and no single rule has to hold."""
    from paragrove.llm import registry

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(2_000)]
    plain = [(i, " ".join(words[i * 37 % 1_000:][:120])) for i in range(40)]
    spam = [(100 + i, ". ".join([" ".join(words[i * 11:][:12])] * 9)) for i in range(6)]
    flow = [(200, " ".join(words[:30] + words[500:510] + words[:30] + words[600:650] + words[:30]))]  # repeats without sentences
    docs = spark.createDataFrame(plain + spam + flow, "doc_id bigint, text string")
    monkeypatch.setattr(registry, "table", lambda *_: docs)
    assert {r.doc_id for r in registry.p9_found(None, None).collect()} == {*range(100, 106), 200}
    rules = {r.doc_id: r for r in registry.p9_posteriors(None, None).collect()}
    assert rules[200].sentence_share == -1 and rules[200].posterior >= 0.5 > rules[0].posterior
    monkeypatch.setattr(repetition, "expectation_maximisation", lambda p, n: (p[:, 0] * 0.0, None, 0.0))
    assert registry.p9_found(None, None).count() == 0


def test_censored_fit():
    rng = np.random.default_rng(4)
    x = np.minimum(np.maximum(1, rng.lognormal(5.5, 0.4, 20_000).astype(int)), 300)
    lengths, counts = np.unique(x, return_counts=True)
    limits = truncation.candidate_limits(lengths, counts)
    mu, sd, share = truncation.fit_censored(lengths, counts, limits)
    assert limits == {300} and abs(mu - 5.5) < 0.05 and abs(sd - 0.4) < 0.05 and share[300] > 0.98


RUNS = "record_id long, model_alias string, question_id string, question string, answer string, error string, status string, key long, rule string, other string"


def run_rows():
    rng = random.Random(5)
    words = "sign panel road marker crew field lane median shoulder taper beacon board".split()
    sentence = lambda: "The " + " ".join(rng.choice(words) for _ in range(6)) + " shall be placed on the " + rng.choice(words) + "."
    q = "Where should the panel be placed on the road?"
    rows = [(i, "m", "q", q, " ".join(sentence() for _ in range(3)), None, "ok") for i in range(400)]
    rows += [(500 + i, "m", "q", q, (" ".join(sentence() for _ in range(8)))[:200].rstrip(". "), None, "ok") for i in range(40)]
    rows += [(600, "m", "q", q, "", None, "ok"), (601, "m", "q", q, None, "read timed out", "error"), (602, "m", "q", q, None, "model declined (refusal)", "error"), (603, None, "q", q, "​ \n", None, "ok"), (604, "m", "q", q, "### Answer", None, "ok"), (605, "m", "q", q, "N/A", None, "ok"),
             (606, "m", "q", q, "I'm sorry, but I can't give advice on roads.", None, "ok"), (607, "m", "q", q, "Where should the panel be placed on the road?", None, "ok"), (608, "m", "q", q, "Die Tafel muss auf der Straße stehen und wird von der Stadt geprüft.", None, "ok"),
             (609, "m", "q", q, "HTTP 502 Bad Gateway (try 3)", None, "error"), (610, "m", "q", None, "The sign shall be placed on the road.", None, "ok"), (611, "m", "q", q, "You want to know: where should the panel be placed on the road", None, "ok"), (0, "m", "q", q, rows[0][4], None, "ok"), (612, "m", "q", q, "Agencies are not able to waive this. The sign shall be placed on the lane.", None, "ok")]
    return [(*r, 1, "x", "y") for r in rows]


QUESTIONS = [("q", "Where should the panel be placed on the road?", "en"), ("g", "Wer prüft die Tafel und wo muss sie stehen?", "de"), ("h", "Wann muss die Tafel auf der Straße von der Stadt geprüft werden?", "de"), ("e", "Who is the owner of the sign?", "en")]


def test_pairs(spark):
    df = spark.createDataFrame(run_rows(), RUNS)
    asked = spark.createDataFrame(QUESTIONS, "question_id string, question string, lang string")
    out = pairs.broken_pairs(df, asked).collect()
    got = {r.record_id: r.defect for r in out}
    assert len(out) == len(got) == 453
    want = {600: "empty", 601: "empty", 602: "refusal", 603: "empty", 604: "empty", 605: "empty", 606: "refusal", 607: "copies_question", 608: "other_language", 609: "error_text", 610: None, 611: "copies_question", 612: None}
    assert {k: got[k] for k in want} == want
    assert sum(got[i] is None for i in range(400)) >= 396 and sum(got[500 + i] == "truncated" for i in range(40)) >= 38
    assert pairs.broken_pairs(df.limit(0), asked).count() == 0 and pairs.broken_pairs(df, asked.limit(0)).where("defect = 'other_language'").isEmpty()


def test_prefixes_of_longer_answers_decide(spark, monkeypatch):
    """An answer that breaks off inside a word of a longer one is found by its sorted neighbours; without them it is not."""
    whole = [f"The crew number {chr(97 + i)}{chr(97 + j)} shall maintain the reflective panels at the ramp" for i in range(20) for j in range(10)]
    rows = [(i, "m", "q", "Who?", t, None, "ok", 1, "x", "y") for i, t in enumerate(whole)] + [(900, "m", "q", "Who?", "The crew number cc shall maintain the reflective pane", None, "ok", 1, "x", "y"), (901, "m", "q", "Who?", "Use these:\n- the reflective panels at the ramp\n- the reflective pane", None, "ok", 1, "x", "y")]
    df = spark.createDataFrame(rows, RUNS)
    found = lambda: {r.record_id: r.shortened for r in pairs.broken_pairs(df).collect()}
    got = found()
    assert got[900] and got[901] and sum(got.values()) == 2
    monkeypatch.setattr(pairs, "begins_longer", lambda parts, shelf: parts.select("part").limit(0))
    assert not any(found().values())


def test_prefix_scan_is_exact_over_partitions(spark):
    from paragrove.runtime import Shelf

    rng = random.Random(9)
    texts = sorted({"".join(rng.choice("ab -") for _ in range(rng.randint(1, 7))).strip() for _ in range(900)} | {"a" * n for n in range(1, 40)})
    texts = [t for t in texts if t]
    open_ = {t for t in texts if rng.random() < 0.5}
    want = {p for p in open_ if p[-1].isalnum() and any(t != p and t.startswith(p) and t[len(p)].isalnum() for t in texts)}
    for n in (1, 3, 16):
        df = spark.createDataFrame([(t, t in open_) for t in texts], "part string, open boolean")
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = [r.part for r in pairs.begins_longer(df, Shelf(spark)).collect()]
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert set(got) == want and len(got) == len(want)


def test_rules_read_whole_answers():
    q = "Where should the panel be placed on the road?"
    rules = pairs.Rules(None)
    late = "You ask about the panel. You ask where on the road. The panel on the road is the panel. Where should it be placed? I cannot answer that question."
    assert rules(late, q, None)[0] == "refusal"
    useful = " ".join(f"The crew must keep panel {w} clear and check it daily." for w in ("north", "south", "east", "west", "upper", "lower")) + " I cannot comment on costs."
    assert rules(useful, q, None)[0] is None
    assert rules(" ".join([q] * 6), q, None)[0] == "copies_question"
    assert rules("**" + "=" * 80 + " N/A **", q, None)[0] == "empty"


def test_truncation(spark):
    df = spark.createDataFrame(run_rows(), RUNS)
    out = truncation.truncated(df).collect()
    assert len({r.record_id for r in out}) == len(out)
    assert all(r.posterior < 0.5 for r in out if r.record_id < 400)
    rates = {r.source: r.n_truncated for r in truncation.truncation_rates(truncation.truncated(df)).collect()}
    assert rates["m"] >= 38
    assert truncation.truncated(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=6), st.sets(st.text("abc", min_size=1, max_size=6), max_size=25), st.integers(0, 2))
def test_automaton_finds_all_within_distance(word, vocabulary, edits):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    trie = scannoise.Trie({w: 1 for w in vocabulary})
    assert {w for w, _ in trie.within(word, edits)} == {w for w in vocabulary if distance(word, w) <= edits}


def test_scan_noise(spark):
    rng = random.Random(6)
    words = "the sign panel shall be placed near every road marker where crews inspect symbol guide line lanes between approaches yearly".split()
    clean = [" ".join(rng.choice(words) for _ in range(30)) + "." for _ in range(300)]
    noise = {"n1": clean[0].replace(" ", " symb-\nol ", 1), "n2": "the syrnbol shall be placed near the road.", "n3": clean[1][:40] + "\nPage 12\n" + clean[1][40:], "n4": "the g u i d e shall be placed", "n5": "the gu1de shall be placed near the road", "n6": "the sign [TCM000001 p. 3] shall be placed"}
    fine = {"f1": "See Figure2B- 1 and Figure 2B–1 near the sign (R1-3P).", "f2": "the sign\nshall be placed\n\nnear the road.", "f3": "R1-1 | 36 x 26 | 45 mph\nR1-2 | 3 x 4 | 5 mph", "f4": "", "f5": "left- and right lanes"}
    rows = [(f"c{i}", t, "x") for i, t in enumerate(clean)] + [(k, v, "x") for k, v in (noise | fine).items()] + [("n2", noise["n2"], "x"), ("z", None, "x"), (None, "a", "x"), ("long", " ".join(clean * 20), "x")]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, word string")
    figures = spark.createDataFrame([(1, "Figure 2B-1. Sign near the road"), (2, "Table 2B-1. Gui­ de line"), (2, "Table 2B-1. Gui­ de line"), (3, None)], "figure_key long, caption string")
    got = scannoise.noisy(chunks, figures).select("source_table", "record_key").distinct().collect()
    assert {tuple(r) for r in got} == {("chunks", k) for k in noise} | {("figures", "2")}
    text = {r.record_key: r.text for r in scannoise.repaired(chunks, figures).collect()}
    assert text["n2"] == "the symbol shall be placed near the road." and text["n4"] == "the guide shall be placed" and text["n5"] == "the guide shall be placed near the road" and text["n6"] == "the sign shall be placed"
    assert "Page 12" not in text["n3"] and " symbol " in text["n1"] and text["f2"] == "the sign shall be placed\n\nnear the road." and text["f3"] == fine["f3"] and text["2"] == "Table 2B-1. Guide line"
    assert "R1-3P" in text["f1"]
    assert scannoise.noisy(chunks.limit(0), figures.limit(0)).count() == 0 and scannoise.repaired(chunks.limit(0), figures.limit(0)).count() == 0
