"""The property graph as two tables, nodes (id, kind, manual, unresolved, attributes) and edges (src, dst, label), and its traversals.

Node ids carry the manual, so one build holds many manuals. Edges are distinct. reach() grows a frontier that is joined to
the edges and stripped of visited nodes, with the lineage cut by a written table after every hop; proximity() needs no list
of the nodes reached and keeps bits instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paragrove.functions import text
from paragrove.functions.ids import normalize_dashes, reference_key
from paragrove.runtime import Shelf


def node(kind: str, *parts) -> Column:
    """A node id: kind:manual/value."""
    return F.concat(F.lit(f"{kind}:"), F.concat_ws("/", *parts))


@dataclass(frozen=True)
class Graph:
    """nodes: id, kind, manual, unresolved, ATTRIBUTES; edges: src, dst, label."""

    nodes: DataFrame
    edges: DataFrame


def exploded_refs(chunks: DataFrame) -> DataFrame:
    """src (chunk node), manual, section node, kind, ref of every distinct reference of a chunk."""
    kinds = {"figure_refs": "Figure", "table_refs": "Table"}
    out = None
    for column, kind in kinds.items():
        part = chunks.select("manual", "section_id", "chunk_id", "page_pdf", F.lit(kind).alias("kind"), F.explode(column).alias("raw")).select(
            "manual", "section_id", "chunk_id", "page_pdf", "kind", reference_key(F.col("raw")).alias("ref"))
        out = part if out is None else out.unionByName(part)
    return out.where("ref <> ''").distinct()


def anchors_of(known: DataFrame) -> DataFrame:
    """manual, kind, ref, section_id, n: the section that anchors each figure of known references.

    Sections of the figure's own chapter come first, then those with the most citing chunks, then the smaller id.
    """
    counts = known.groupBy("manual", "kind", "ref", "section_id").agg(F.count("*").alias("n"))
    own = F.upper("section_id").startswith(F.concat(F.upper(text.chapter_of(F.col("ref"))), F.lit(".")))
    best = F.min_by(F.struct("section_id", "n"), F.struct((~own).cast("int"), -F.col("n"), "section_id"))
    return counts.groupBy("manual", "kind", "ref").agg(best.alias("b")).select("manual", "kind", "ref", "b.section_id", "b.n")


def anchors(refs: DataFrame, figures: DataFrame) -> DataFrame:
    """anchors_of() the references that find a figure."""
    have = figures.select("manual", "kind", reference_key(F.col("canonical_id")).alias("ref")).distinct()
    return anchors_of(refs.join(have, ["manual", "kind", "ref"], "left_semi"))


#: Attributes of a node; null where a kind has none.
ATTRIBUTES = ("title", "page_pdf", "page_printed", "content_type", "ordinal", "n_sheets")


def _node(node_id: Column, kind: Column | str, manual: Column, unresolved: bool = False, **have) -> Column:
    types = {"page_pdf": "int", "ordinal": "int", "n_sheets": "bigint"}
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(node_id.alias("id"), kind.alias("kind"), manual.alias("manual"), F.lit(unresolved).alias("unresolved"), *[have.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c) for c in ATTRIBUTES])


def _edge(src: Column, dst: Column, label: Column | str) -> Column:
    return F.struct(src.alias("src"), dst.alias("dst"), (F.lit(label) if isinstance(label, str) else label).alias("label"))


def section_key(c: Column) -> Column:
    """A section reference without kind word and blanks, upper case."""
    return F.upper(F.regexp_replace(F.regexp_replace(c, r"(?i)^\s*sec(?:tion|t\.?)?\s*", ""), r"\s+", ""))


def build(chunks: DataFrame, figures: DataFrame) -> Graph:
    """The graph of deduplicated chunks and live figures; nodes: id, kind, manual, unresolved, ATTRIBUTES; edges: src, dst, label.

    Missing parts and chapters become 'Part ?' and 'Chapter ?'. Cited but absent figures and sections become unresolved
    placeholder nodes; a node that exists anywhere is resolved. Figures with several sheets are one node, with the attributes
    of the first sheet. A section has those of its first chunk by page, ordinal and id. A figure depicts its own codes, those of
    the chunks that cite it and those of the chunks on its page. The chunks are read once, and one scan of what is kept of them gives all their nodes, one all their edges.
    """
    shelf = Shelf(chunks.sparkSession)
    m = F.col("manual")
    norm = lambda refs, key: F.filter(F.array_distinct(F.transform(F.coalesce(refs, F.array().cast("array<string>")), key)), lambda x: x.isNotNull() & (x != ""))
    c = chunks.select("manual", F.coalesce("part", F.lit("Part ?")).alias("part"), F.coalesce("chapter", F.lit("Chapter ?")).alias("chapter"), "section_id", "section_title", "chunk_id", "content_type", "ordinal", "page_pdf", "page_printed",
                      norm(F.col("figure_refs"), reference_key).alias("figs"), norm(F.col("table_refs"), reference_key).alias("tabs"), norm(F.col("sign_codes"), lambda x: F.upper(F.trim(x))).alias("codes"), norm(F.col("section_refs"), section_key).alias("secs"))
    c = shelf.keep(c, "chunks")
    part, chapter, section, chunk = node("part", "manual", "part"), node("chapter", "manual", "chapter"), node("section", "manual", "section_id"), node("chunk", "chunk_id")
    of = lambda kind, x: F.concat(F.lit(f"{kind}:"), F.concat_ws("/", m, x))
    other = F.filter("secs", lambda x: x != F.col("section_id"))
    none = F.lit(None).cast("string")
    code = lambda x: F.concat(F.lit("signcode:"), x)
    cat = lambda x: F.concat(F.lit("category:"), text.category(x))
    edges = F.concat(
        F.array(_edge(part, chapter, "contains"), _edge(chapter, section, "contains"), _edge(section, chunk, "contains")),
        F.transform("figs", lambda x: _edge(chunk, of("figure", x), "cites_figure")), F.transform("tabs", lambda x: _edge(chunk, of("table", x), "cites_table")), F.transform(other, lambda x: _edge(chunk, of("section", x), "cites_section")),
        F.transform("codes", lambda x: _edge(chunk, code(x), "mentions")), F.transform("codes", lambda x: _edge(code(x), cat(x), "kind_of")), F.transform("codes", lambda x: _edge(section, code(x), "defines")))
    order = F.struct(F.coalesce("page_pdf", F.lit(-1)), F.coalesce("ordinal", F.lit(-1)), "chunk_id")
    nodes = F.concat(
        F.array(_node(part, "Part", m, title=F.col("part")), _node(chapter, "Chapter", m, title=F.col("chapter")), _node(section, "Section", m, title=F.col("section_title"), page_pdf=F.col("page_pdf"), page_printed=F.col("page_printed")),
                _node(chunk, "Chunk", m, page_pdf=F.col("page_pdf"), page_printed=F.col("page_printed"), content_type=F.col("content_type"), ordinal=F.col("ordinal"))),
        F.transform("codes", lambda x: _node(code(x), "SignCode", none)), F.transform("codes", lambda x: _node(cat(x), "Category", none, title=text.category(x))),
        F.transform("figs", lambda x: _node(of("figure", x), "FigureRef", m, True)), F.transform("tabs", lambda x: _node(of("table", x), "TableRef", m, True)), F.transform(other, lambda x: _node(of("section", x), "SectionRef", m, True)))
    first = F.struct("unresolved", "kind", "order")
    merged = lambda df: df.groupBy("id").agg(F.min_by(F.struct("kind", "manual", *ATTRIBUTES), first).alias("r"), F.min(first).alias("first")).select("id", "r.*", "first")
    of_chunks = merged(c.select(order.alias("order"), F.explode(nodes).alias("n")).select("order", "n.*"))

    f = figures.select("manual", "kind", reference_key(F.col("canonical_id")).alias("ref"), "page_pdf", "page_printed", F.coalesce("title", "caption").alias("title"), "sheet", "figure_key", norm(F.col("sign_codes_depicted"), lambda x: F.upper(F.trim(x))).alias("codes"))
    f = shelf.keep(f, "figs")
    target = F.when(F.col("kind") == "Figure", node("figure", "manual", "ref")).otherwise(node("table", "manual", "ref"))
    head = F.struct(F.coalesce("sheet", F.lit(1)), F.coalesce("page_pdf", F.lit(-1)), "figure_key")
    ids = f.groupBy("manual", "kind", "ref").agg(F.min_by(F.struct("title", "page_pdf", "page_printed"), head).alias("h"), F.count("*").alias("n"))
    of_figures = ids.select(_node(target, F.col("kind"), m, title=F.col("h.title"), page_pdf=F.col("h.page_pdf"), page_printed=F.col("h.page_printed"), n_sheets=F.col("n")).alias("n")).select("n.*")
    drawn = f.select(F.explode("codes").alias("x")).distinct().select(_node(code(F.col("x")), "SignCode", none).alias("n")).select("n.*")
    lone = F.struct(F.lit(-1).alias("col1"), F.lit(-1).alias("col2"), F.lit("").alias("chunk_id"))
    flat = of_figures.unionByName(drawn).select("id", F.struct("kind", "manual", *ATTRIBUTES).alias("r"), F.struct("unresolved", "kind", lone.alias("order")).alias("first")).select("id", "r.*", "first")
    all_nodes = of_chunks.unionByName(flat).groupBy("id").agg(F.min_by(F.struct("kind", "manual", *ATTRIBUTES), "first").alias("r"), F.min("first").alias("first")).where("id IS NOT NULL").select("id", "r.kind", "r.manual", "first.unresolved", *[f"r.{a}" for a in ATTRIBUTES])

    refs = c.select("manual", "section_id", "chunk_id", "page_pdf", "codes", F.explode(F.concat(F.transform("figs", lambda x: F.struct(F.lit("Figure").alias("kind"), x.alias("ref"))), F.transform("tabs", lambda x: F.struct(F.lit("Table").alias("kind"), x.alias("ref"))))).alias("r")).select("manual", "section_id", "chunk_id", "page_pdf", "codes", "r.*")
    known = shelf.keep(refs.join(ids.select("manual", "kind", "ref"), ["manual", "kind", "ref"], "left_semi"), "known")
    at = F.min_by("section_id", F.struct(F.col("ordinal"), F.col("chunk_id")))
    pages = c.groupBy("manual", "page_pdf").agg(at.alias("section_id"))
    page_codes = c.select("manual", "page_pdf", F.explode("codes").alias("code")).distinct()
    short = c.select("manual", "chapter", F.upper(F.regexp_extract("chapter", r"(?i)^Chapter\s+([0-9A-Z]+)\b", 1)).alias("short")).where("short <> ''").groupBy("manual", "short").agg(F.min("chapter").alias("chapter"))
    e = lambda df, s, d, label: df.select(s.alias("src"), d.alias("dst"), F.lit(label).alias("label"))
    parts = [
        c.select(F.explode(edges).alias("e")).select("e.*"),
        e(f.withColumn("code", F.explode("codes")), target, node("signcode", "code"), "depicts"),
        e(known.withColumn("code", F.explode("codes")), target, node("signcode", "code"), "depicts"),
        e(f.join(page_codes, ["manual", "page_pdf"]), target, node("signcode", "code"), "depicts"),
        e(ids.withColumn("short", F.upper(text.chapter_of(F.col("ref")))).join(short, ["manual", "short"]), target, chapter, "belongs_to_chapter"),
        e(f.join(pages, ["manual", "page_pdf"]), target, section, "on_page_of"),
        e(known, target, section, "cited_in"),
        e(anchors_of(known), target, section, "anchored_in")]
    all_edges = parts[0]
    for x in parts[1:]:
        all_edges = all_edges.unionByName(x)
    return Graph(all_nodes, all_edges.where("src IS NOT NULL AND dst IS NOT NULL").distinct())


def write(g: Graph, path: str) -> None:
    """Nodes and edges as two Parquet tables; what is there is replaced."""
    g.nodes.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/edges")


def read(spark, path: str) -> Graph:
    """A graph as write() leaves it."""
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def aliases(nodes: DataFrame) -> DataFrame:
    """manual, alias, id of resolved figures and tables: 'FIGURE 2B-14', and '2B-14' for the first of them by kind."""
    known = nodes.where("NOT unresolved AND kind IN ('Figure', 'Table')").select("manual", "id", "kind", F.element_at(F.split("id", "[:/]"), -1).alias("ref"))
    full = known.select("manual", F.concat(F.upper("kind"), F.lit(" "), "ref").alias("alias"), "id")
    return full.unionByName(known.groupBy("manual", F.col("ref").alias("alias")).agg(F.min_by("id", "kind").alias("id")))


def figure_alias(c: Column) -> Column:
    """A figure name in the spelling of aliases(): '2B-14', 'Figure 2B-14' and 'figure:Figure 2B-14' find their node."""
    bare = F.trim(F.regexp_replace(F.trim(normalize_dashes(c)), r"(?i)^figure:", ""))
    return F.upper(F.regexp_replace(text.canonical_spacing(bare), r"\s*-\s*", "-"))


def lookup_figures(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """names (manual, name) with id; null where the manual has no such figure or table."""
    return names.withColumn("alias", figure_alias(F.col("name"))).join(aliases(nodes), ["manual", "alias"], "left").drop("alias")


def known_citations(cited: DataFrame, nodes: DataFrame) -> DataFrame:
    """cited (kind: section, figure, table or signcode; name) with known: whether any manual has such a resolved node."""
    have = nameable(nodes).select(F.split_part("tail", F.lit("/"), F.lit(1)).alias("kind"), F.split_part("tail", F.lit("/"), F.lit(2)).alias("key")).distinct().withColumn("known", F.lit(True))
    key = F.when(F.col("kind").isin("figure", "table"), reference_key(F.col("name"))).when(F.col("kind") == "signcode", F.upper(F.trim("name"))).otherwise(section_key(F.col("name")))
    return cited.withColumn("key", key).join(have, ["kind", "key"], "left").drop("key").fillna({"known": False})


def seeds_of(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """qid, id: the nodes that a target names. targets: qid, kind (section, signcode, question), target; an unknown kind names none."""
    sections = targets.where("kind = 'section'").select("qid", section_key(F.col("target")).alias("key")).join(nodes.where("kind = 'Section'").select("id", F.element_at(F.split("id", "/"), -1).alias("key")), "key").select("qid", "id")
    codes = targets.where("kind = 'signcode'").select("qid", F.concat(F.lit("signcode:"), F.upper(F.trim("target"))).alias("id")).join(nodes.select("id"), "id").select("qid", "id")
    asked = query_entities(targets.where("kind = 'question'").select("qid", F.col("target").alias("question")), nodes)
    return sections.unionByName(codes).unionByName(asked.select("qid", "id")).distinct()


VIEWS = ("overview", "kinds", "labels", "neighborhood", "subgraph")


def view(g: Graph, name: str, targets: DataFrame | None = None, hops: int = 1, most: int = 80) -> DataFrame:
    """The data of a view of the graph. An unknown view, or a neighborhood without targets, raises a ValueError.

    overview: part, chapter, n_sections; kinds and labels: counts; neighborhood: the nodes within so many hops of every
    target, at most `most`; subgraph: the edges among sections, figures and tables.
    """
    if name not in VIEWS:
        raise ValueError(f"unknown view {name!r}; there are {', '.join(VIEWS)}")
    if name == "neighborhood":
        if targets is None:
            raise ValueError("a neighborhood needs targets")
        return trim(reach(g.edges, seeds_of(targets, g.nodes), hops), g.nodes, most)
    if name == "overview":
        links = g.edges.where("label = 'contains' AND src LIKE 'part:%'").select(F.col("src").alias("part"), F.col("dst").alias("chapter"))
        inner = g.edges.where("label = 'contains' AND src LIKE 'chapter:%'").groupBy(F.col("src").alias("chapter")).agg(F.count("*").alias("n_sections"))
        return links.join(inner, "chapter", "left").select("part", "chapter", F.coalesce("n_sections", F.lit(0)).alias("n_sections"))
    if name == "subgraph":
        return induced(g.edges, g.nodes.where("kind IN ('Section', 'Figure', 'Table')").select("id"))
    return g.nodes.groupBy("kind").agg(F.count("*").alias("n")) if name == "kinds" else g.edges.groupBy("label").agg(F.count("*").alias("n"))


def display_label(kind: Column, node_id: Column, title: Column, most: int = 28) -> Column:
    """A short label: the title or the last part of the id, cut to `most` characters with an ellipsis."""
    tail = F.element_at(F.split(node_id, "[:/]"), -1)
    full = F.when(kind.isin("Part", "Chapter", "Category"), F.coalesce(title, tail)).when(kind.isin("Figure", "Table"), F.concat(kind, F.lit(" "), tail)).when(kind == "Section", F.concat(F.lit("§"), tail)).otherwise(tail)
    return F.when(F.length(full) > most, F.concat(F.substring(full, 1, most - 1), F.lit("…"))).otherwise(full)


def undirected(edges: DataFrame) -> DataFrame:
    """a, b for both directions, distinct."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


def reach(edges: DataFrame, seeds: DataFrame, hops: int, barrier: Column | None = None) -> DataFrame:
    """qid, id, depth: nodes within so many undirected hops of each query's seeds (qid, id), the seeds included at depth 0.

    Duplicate seeds count once; seeds that are no node reach themselves alone. barrier: nodes (condition on id) that are
    reached but not passed, for hubs.
    """
    shelf = Shelf(edges.sparkSession)
    both = shelf.keep(undirected(edges), "both")
    seen = shelf.keep(seeds.select("qid", "id").distinct().withColumn("depth", F.lit(0)), "hop-0")
    frontier = seen
    for d in range(1, hops + 1):
        start = frontier if barrier is None else frontier.where((F.col("depth") == 0) | ~barrier)
        step = start.select("qid", F.col("id").alias("a")).join(both, "a").select("qid", F.col("b").alias("id")).distinct()
        frontier = shelf.keep(step.join(seen.select("qid", "id"), ["qid", "id"], "left_anti").withColumn("depth", F.lit(d)), f"hop-{d}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def coded(edges: DataFrame, ids: DataFrame, shelf: Shelf, tries: int = 8) -> tuple[DataFrame, Callable[[Column], Column]]:
    """a, b: the ends of the edges as numbers, distinct for distinct ids, those of ids (id) included; and the numbers of a column.

    Numbers are hashes. That no two ids share one is checked by a second hash of each; where two do, other hashes are taken.
    """
    for seed in range(tries):
        number = lambda c, seed=seed: F.xxhash64(c, F.lit(seed))
        other = lambda c: F.xxhash64(F.lit(-1), c)
        pairs = shelf.keep(edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(number("src").alias("a"), number("dst").alias("b"), other("src").alias("ca"), other("dst").alias("cb")), "pairs")
        every = pairs.select("a", "ca").union(pairs.select("b", "cb")).union(ids.select(number("id"), other("id")))
        if every.groupBy("a").agg((F.min("ca") < F.max("ca")).alias("two")).where("two").isEmpty():
            return pairs.select("a", "b"), number
    raise RuntimeError(f"no hash of {tries} tells all nodes apart")


def _neighbours(first: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the neighbours of nodes stand in a list that has those of node i from first[i] to first[i + 1], and how many each node has."""
    n = first[nodes + 1] - first[nodes]
    return np.repeat(first[nodes] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()), n


def _depths(first: np.ndarray, other: np.ndarray, seeds: tuple[np.ndarray, np.ndarray], wanted: tuple[np.ndarray, np.ndarray], hops: int) -> np.ndarray:
    """The hops of every wanted (node, query) from its query's seeds, -1 beyond `hops`; for 64 queries, numbered from 0, that are bits of a word per node."""
    bit = lambda q: np.left_shift(np.uint64(1), q.astype(np.uint64))
    node, ask = wanted[0], bit(wanted[1])
    seen, depth = np.zeros(len(first) - 1, np.uint64), np.full(len(node), -1)
    np.bitwise_or.at(seen, seeds[0], bit(seeds[1]))
    front, open_, linked = seen.copy(), np.arange(len(node)), np.flatnonzero(np.diff(first))
    for d in range(hops + 1):
        if d:
            step, live = np.zeros_like(seen), np.flatnonzero(front)
            few = np.unique(node[open_]) if d == hops else live  # after the last hop only the wanted nodes matter
            few = few[first[few + 1] > first[few]]
            at, n = _neighbours(first, few) if (first[few + 1] - first[few]).sum() * 4 < len(other) else (None, None)
            if at is None:
                step[linked] = np.bitwise_or.reduceat(front[other], first[linked]) if len(linked) else 0
            elif d == hops:
                step[few] = np.bitwise_or.reduceat(front[other[at]], np.r_[0, np.cumsum(n)[:-1]]) if len(few) else 0
            else:
                np.bitwise_or.at(step, other[at], np.repeat(front[few], n))
            front = step & ~seen & np.bitwise_or.reduce(ask[open_])  # a query ends once all its wanted nodes are reached
            seen |= front
        hit = (seen[node[open_]] & ask[open_]) != 0
        depth[open_[hit]] = d
        open_ = open_[~hit]
        if not len(open_) or not front.any():
            break
    return depth


def proximity(edges: DataFrame, entities: DataFrame, chunks: DataFrame, hops: int = 6) -> DataFrame:
    """qid, id, score of candidate nodes: 1 / (1 + hops to the nearest entity of the query), 0 beyond `hops`.

    entities: qid, id; chunks: qid, id (the candidates of each query). Queries are spread over the cores, each with all edges
    as pairs of numbers (coded()), and walk the graph 64 at a time as the bits of one word per node, so that no row is made for a node
    that a query passes: through codes and categories it passes most nodes of all manuals.
    """
    shelf, kind = Shelf(edges.sparkSession), chunks.schema["qid"].dataType
    entities = shelf.keep(entities.select(F.col("qid").cast(kind).alias("qid"), "id").where("qid IS NOT NULL AND id IS NOT NULL"), "entities")
    chunks = shelf.keep(chunks.select("qid", "id"), "candidates")
    pairs, number = coded(edges, entities.select("id").unionByName(chunks.select("id").where("id IS NOT NULL")), shelf)
    asked = entities.agg(F.count_distinct("qid")).head()[0]
    cells = max(1, min(edges.sparkSession.sparkContext.defaultParallelism, -(-asked // 64)))

    def pack(batches):
        for t in batches:
            if t.num_rows:
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t[c]) for c in ("a", "b")], ["a", "b"])

    def walk(links: pa.Table, rows: pa.Table) -> pa.Table:
        query = np.asarray(pc.fill_null(pc.dictionary_encode(rows["qid"].combine_chunks()).indices, -1)) if len(rows) else np.zeros(0, np.int32)
        code, seed = np.asarray(rows["n"]), np.asarray(rows["seed"])
        depth = np.full(len(rows), -1)
        wanted = np.flatnonzero(~seed & (query >= 0) & np.asarray(rows["id"].is_valid()) & np.isin(query, query[seed]))
        queries = np.unique(query[wanted])
        if len(queries):
            a, b = (np.concatenate([np.zeros(0, np.int64), *(np.asarray(x.flatten()) for x in links[c].chunks)]) for c in ("a", "b"))
            codes, node = np.unique(np.concatenate([a, b, code]), return_inverse=True)
            node = node.astype(np.int32)
            a, b, node = node[:len(a)], node[len(a):2 * len(a)], node[2 * len(a):]
            a, b = np.r_[a, b], np.r_[b, a]
            other, first = b[np.argsort(a, kind="stable")], np.r_[0, np.cumsum(np.bincount(a, minlength=len(codes)))]
            seeds = np.flatnonzero(seed & np.isin(query, queries))
            place = lambda at: np.searchsorted(queries, query[at])
            s, w = place(seeds), place(wanted)
            for lo in range(0, len(queries), 64):
                x, y = (s >= lo) & (s < lo + 64), (w >= lo) & (w < lo + 64)
                depth[wanted[y]] = _depths(first, other, (node[seeds[x]], s[x] - lo), (node[wanted[y]], w[y] - lo), hops)
        out = rows.filter(pa.array(~seed))
        return out.select(["qid", "id"]).append_column("score", pa.array(np.where(depth < 0, 0.0, 1 / (1 + np.maximum(depth, 0)))[~seed]))

    own = F.pmod(F.xxhash64("qid"), F.lit(cells)).cast("int").alias("cell")
    rows = entities.withColumn("seed", F.lit(True)).unionByName(chunks.withColumn("seed", F.lit(False))).select(own, "qid", "id", number("id").alias("n"), "seed")
    packed = shelf.keep(pairs.mapInArrow(pack, "a array<bigint>, b array<bigint>"), "packed")
    shelf.drop("pairs")
    every = packed.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), "a", "b")
    return every.groupBy("cell").cogroup(rows.groupBy("cell")).applyInArrow(walk, f"qid {kind.simpleString()}, id string, score double")


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree over both directions."""
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with both ends among the ids."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def trim(reached: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """At most `most` nodes per query: all that are no chunks first, then chunks by id."""
    w = Window.partitionBy("qid").orderBy((F.col("kind") == "Chunk").cast("int"), "id")
    return reached.join(nodes.select("id", "kind"), "id").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


def named(questions: DataFrame) -> DataFrame:
    """qid, tail: the figures, tables, sections and codes that texts name, as kind/reference; distinct over all rows of a qid."""
    q = F.translate("question", "‐‑‒–—", "-----")
    pick = lambda pattern, f: questions.select("qid", F.explode(F.regexp_extract_all(q, F.lit(pattern), F.lit(1))).alias("x")).select("qid", f(F.col("x")).alias("tail"))
    named = pick(r"(?i)\b(Figure\s+[0-9A-Z]+-[0-9]+[A-Za-z0-9]*)\b", lambda x: F.concat(F.lit("figure/"), reference_key(x)))
    named = named.unionByName(pick(r"(?i)\b(Table\s+[0-9A-Z]+-[0-9]+[A-Za-z0-9]*)\b", lambda x: F.concat(F.lit("table/"), reference_key(x))))
    named = named.unionByName(pick(r"\b(?:Section\s+)?([0-9]+[A-Z]\.[0-9]+)\b", lambda x: F.concat(F.lit("section/"), x)))
    named = named.unionByName(pick(r"\b([RWDIMOE][A-Z]?\d{1,3}(?:-\d{1,3})?[a-zA-Z]?P?)\b", lambda x: F.concat(F.lit("signcode/"), F.upper(x))))
    return named.distinct()


def nameable(nodes: DataFrame) -> DataFrame:
    """id, tail of the resolved nodes that a text can name."""
    tail = F.concat_ws("/", F.split_part("id", F.lit(":"), F.lit(1)), F.element_at(F.split("id", "[:/]"), -1))
    return nodes.where("NOT unresolved AND kind IN ('Figure', 'Table', 'Section', 'SignCode')").select("id", tail.alias("tail"))


def query_entities(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """qid, id: the figures, tables, sections and codes that a question names and the graph knows (of any manual)."""
    return named(questions).join(nameable(nodes), "tail").select("qid", "id")
