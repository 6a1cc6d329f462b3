"""Retrieval end to end: many questions through entities, fusion, scoring, reranking, routing, figures and prompts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paragrove.functions import text
from paragrove.operators import graph, prompt, router, search
from paragrove.operators.evalrun import Settings, answer_all
from paragrove.runtime import Shelf


#: How many figures are looked at, how many of them by look, how many are shown, and how many pages.
MOST_FIGURES, MOST_VISUAL, MOST_SHOWN, MOST_PAGES = 10, 6, 4, 4


@dataclass(frozen=True)
class Corpus:
    """The tables that retrieval reads.

    chunks and figures: deduplicated; graph: theirs; vectors: id, vec, sparse, chunk_id. figure_vectors: id, vec, figure (a node
    id), one row per patch; pages: id, vec, one row per patch. Without the last two there are no figures by look and no pages.
    """

    chunks: DataFrame
    figures: DataFrame
    graph: graph.Graph
    vectors: DataFrame
    figure_vectors: DataFrame | None = None
    pages: DataFrame | None = None


def retrieve(queries: DataFrame, corpus: Corpus, settings: Settings = Settings(), hops: int = 6, top: int = 30, keep: int = 6, rerank: Callable[[Column, Column], Column] = search.overlap_score) -> DataFrame:
    """qid, rank, chunk_id, score: the chunks of every query (qid, question, vec, sparse).

    Dense and sparse lists are fused by rank; the score adds graph proximity to the query's entities, rule weight and
    hierarchy; rerank(question, text), a column expression or a pandas function of two columns, orders the best.
    """
    v = corpus.vectors
    fused = search.rrf([search.dense_topk(queries, v.select("id", "vec"), top), search.sparse_topk(queries, v, top)], top)
    kind = F.coalesce(text.content_type(F.col("content_type")), F.lit("Support"))
    hits = fused.join(v.select("id", "chunk_id"), "id").join(corpus.chunks.select("chunk_id", "part", "chapter", kind.alias("kind"), "text"), "chunk_id").join(queries.select("qid", "question"), "qid")
    hits = Shelf(queries.sparkSession).keep(hits, "fused")
    entities = graph.query_entities(queries.select("qid", "question"), corpus.graph.nodes)
    cand = hits.select("qid", graph.node("chunk", "chunk_id").alias("id"))
    near = graph.proximity(corpus.graph.edges, entities, cand, hops).withColumnRenamed("score", "near") if settings.w_graph else cand.withColumn("near", F.lit(0.0))
    scored = hits.join(near.select("qid", F.substring_index("id", "chunk:", -1).alias("chunk_id"), "near"), ["qid", "chunk_id"], "left")
    final = F.col("score") + settings.w_graph * F.coalesce("near", F.lit(0.0)) + settings.w_ruletype * (text.rule_weight(F.col("kind")) - 1.0) + settings.w_hierarchy * search.hierarchy_prior(F.col("question"), F.col("part"), F.col("chapter"))
    first = search.ranked(scored.withColumn("s", final), 40, "s")
    order = rerank(F.col("question"), F.substring("text", 1, 1500)) if settings.rerank else search.identity_rerank(F.col("rank"))
    w = Window.partitionBy("qid").orderBy(F.round("r", 9).desc(), "rank")
    return first.withColumn("r", order).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).select("qid", "rank", "chunk_id", F.col("r").alias("score"))


def visual_hits(queries: DataFrame, corpus: Corpus, most: int) -> DataFrame:
    """qid, figure, rank: the figures whose crops look most like the query, by late interaction."""
    known = corpus.figure_vectors.groupBy("id").agg(F.min("figure").alias("figure"))
    return search.maxsim(queries.select("qid", "vec").where("vec IS NOT NULL"), corpus.figure_vectors.select("id", "vec"), most).join(known, "id").select("qid", "figure", "rank")


def caption_hits(queries: DataFrame, corpus: Corpus, most: int) -> DataFrame:
    """qid, figure, rank: the figures whose vectors are nearest to the query's."""
    known = corpus.figure_vectors.groupBy("id").agg(F.min("figure").alias("figure"))
    return search.dense_topk(queries.select("qid", "vec"), corpus.figure_vectors.select("id", "vec"), most).join(known, "id").select("qid", "figure", "rank")


def figures_for(hits: DataFrame, corpus: Corpus, decisions: DataFrame, queries: DataFrame | None = None, captions: bool = False, candidates: int = MOST_FIGURES) -> DataFrame:
    """qid, rank, figure, path: at most `candidates` figures of every query, then as many of them as the router allows.

    Three ways in this order, first occurrence only: 'kg_link', figures that the retrieved chunks cite, in the chunks' order;
    'visual', those that look like the query; 'caption', by caption vectors, if asked for. The last two need queries (qid, vec)
    and figure vectors.
    """
    cited = corpus.graph.edges.where("label IN ('cites_figure', 'cites_table')").join(corpus.graph.nodes.where("NOT unresolved").select(F.col("id").alias("dst")), "dst", "left_semi")
    ways = hits.select("qid", "rank", graph.node("chunk", "chunk_id").alias("src")).join(cited, "src").select("qid", F.col("dst").alias("figure"), F.lit(0).alias("way"), F.col("rank").alias("at"))
    if queries is not None and corpus.figure_vectors is not None:
        ways = ways.unionByName(visual_hits(queries, corpus, MOST_VISUAL).select("qid", "figure", F.lit(1).alias("way"), F.col("rank").alias("at")))
        if captions:
            ways = ways.unionByName(caption_hits(queries, corpus, candidates).select("qid", "figure", F.lit(2).alias("way"), F.col("rank").alias("at")))
    first = ways.groupBy("qid", "figure").agg(F.min(F.struct("way", "at")).alias("f"))
    w = Window.partitionBy("qid").orderBy("f.way", "f.at", "figure")
    ranked = first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= candidates)
    path = F.element_at(F.array(F.lit("kg_link"), F.lit("visual"), F.lit("caption")), F.col("f.way") + 1)
    return ranked.join(decisions.where("needs_figures").select("qid", "max_figures"), "qid").where(F.col("rank") <= F.least(F.col("max_figures"), F.lit(MOST_SHOWN))).select("qid", "rank", "figure", path.alias("path"))


def pages_for(queries: DataFrame, corpus: Corpus, decisions: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """qid, rank, page, shown: the pages of every query by late interaction; they are shown only where the router wants figures."""
    got = search.maxsim(queries.select("qid", "vec").where("vec IS NOT NULL"), corpus.pages.select("id", "vec"), most)
    return got.join(decisions.select("qid", "needs_figures"), "qid").select("qid", "rank", F.col("id").alias("page"), F.col("needs_figures").alias("shown"))


def prompts(queries: DataFrame, hits: DataFrame, corpus: Corpus, style: str = "zeroshot") -> DataFrame:
    """qid, prompt of every query with hits."""
    kind = F.coalesce(text.content_type(F.col("content_type")), F.lit("Support"))
    full = hits.join(corpus.chunks.select("chunk_id", kind.alias("kind"), "section_id", "section_title", "ordinal", "page_printed", "text"), "chunk_id")
    return prompt.evidence(full).join(prompt.whitelist(full), "qid").join(queries.select("qid", "question"), "qid").select("qid", prompt.assemble(style, F.col("question"), F.col("evidence"), F.col("allowed")).alias("prompt"))


def decide(queries: DataFrame, hits: DataFrame, corpus: Corpus, settings: Settings = Settings()) -> DataFrame:
    """The router's decision of every query, with the figure-citing share of its first five sections as prior."""
    if not settings.use_router:
        return queries.select("qid", F.lit(True).alias("needs_figures"), F.lit(4).alias("max_figures"))
    cites = corpus.chunks.groupBy("manual", "section_id").agg(F.bool_or(F.size("figure_refs") > 0).alias("cites"))
    prior = hits.where("rank <= 5").join(corpus.chunks.select("chunk_id", "manual", "section_id"), "chunk_id").join(cites, ["manual", "section_id"]).groupBy("qid").agg(F.avg(F.coalesce("cites", F.lit(False)).cast("double")).alias("prior"))
    return router.route(queries.select("qid", "question").join(prior, "qid", "left"), prior="prior")


@dataclass(frozen=True)
class Pipeline:
    """A corpus with its settings and models, made once and passed on: rerank(question, text) and answer(selector, prompt)."""

    corpus: Corpus
    settings: Settings = Settings()
    style: str = "zeroshot"
    rerank: Callable[[Column, Column], Column] = search.overlap_score
    answer: Callable[[str, str], str] | None = None
    captions: bool = False

    def ask(self, queries: DataFrame, selector: str = "local") -> DataFrame:
        """qid, question, needs_figures, chunks, figures, pages, prompt, and with an answer function answer, status, error.

        queries: qid, question, vec, sparse. chunks, figures and pages are arrays in rank order, pages empty where the router
        wants no figures. A query without hits has a prompt of null and no answer.
        """
        shelf = Shelf(queries.sparkSession)
        q = shelf.keep(queries, "queries")
        hits = shelf.keep(retrieve(q, self.corpus, settings=self.settings, rerank=self.rerank), "hits")
        decisions = shelf.keep(decide(q, hits, self.corpus, self.settings), "decisions")
        listed = lambda df, c: df.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c]).alias(f"{c}s"))
        out = q.select("qid", "question").join(decisions.select("qid", "needs_figures"), "qid", "left").join(listed(hits, "chunk_id"), "qid", "left")
        out = out.join(listed(figures_for(hits, self.corpus, decisions, q, self.captions), "figure"), "qid", "left")
        if self.corpus.pages is not None:
            out = out.join(listed(pages_for(q, self.corpus, decisions).where("shown"), "page"), "qid", "left")
        else:
            out = out.withColumn("pages", F.lit(None).cast("array<bigint>"))
        out = out.join(prompts(q, hits, self.corpus, self.style), "qid", "left").select("qid", "question", F.coalesce("needs_figures", F.lit(False)).alias("needs_figures"), *[F.coalesce(c, F.array()).alias(n) for c, n in (("chunk_ids", "chunks"), ("figures", "figures"), ("pages", "pages"))], "prompt")
        if self.answer is None:
            return out
        asked = answer_all(out.where("prompt IS NOT NULL").select("qid", F.lit(selector).alias("selector"), F.col("prompt").alias("question")), self.answer)
        return out.join(asked.select("qid", "answer", "status", "error"), "qid", "left")


def display(answered: DataFrame) -> DataFrame:
    """qid, markdown: the answer with its figures and sources, as it is shown."""
    lines = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n\n### {head}\n- "), F.array_join(F.col(c).cast("array<string>"), "\n- "))).otherwise("")
    return answered.select("qid", F.concat(F.lit("### Answer\n"), F.coalesce("answer", F.lit("(no answer)")), lines("Figures", "figures"), lines("Evidence", "chunks"), lines("Pages", "pages")).alias("markdown"))
