"""First-generation retrieval: lexical boosts, page fusion and the extractive answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that make a query visual, and those that make it a scene.
VISUAL_TERMS = ("figure", "fig", "diagram", "table", "chart", "image", "images", "show me", "what does this page show", "page ", "sign", "signs", "plaque", "plaques", "symbol", "symbols", "label", "labels", "caption", "captions", "plate", "plates", "drawing", "drawings")
SCENE_TERMS = ("figure", "diagram", "layout", "placement", "example", "intersection", "roundabout", "circular", "typical application", "lane closure", "marking", "sign placement")


def has_any(c: Column, terms: tuple[str, ...]) -> Column:
    """Whether a text contains any of the terms."""
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(c), t))


def explicit_page(c: Column) -> Column:
    """The page that a query names; null if none."""
    return F.nullif(F.regexp_extract(c, r"(?i)\bpage\s+(\d{1,4})\b", 1), F.lit("")).cast("int")


def section_boost(query: Column, title: Column, text: Column) -> Column:
    """0.20 where the title contains the query, 0.12 where the text does."""
    q = F.lower(query)
    return F.when((q != "") & F.contains(F.lower(title), q), 0.20).otherwise(0.0) + F.when((q != "") & F.contains(F.lower(text), q), 0.12).otherwise(0.0)


def page_records(chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """manual, page, at most three captions, at most three table titles, at most 50 sorted codes, characters of text."""
    codes = chunks.select("manual", F.col("page_pdf").alias("page"), F.explode("sign_codes").alias("code")).distinct().groupBy("manual", "page").agg(F.slice(F.array_sort(F.collect_list("code")), 1, 50).alias("sign_codes"))
    c = chunks.groupBy("manual", F.col("page_pdf").alias("page")).agg(F.sum(F.length("text")).alias("n_chars")).join(codes, ["manual", "page"], "left")
    first = lambda kind: F.slice(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("caption")))), 1, 3)
    f = figures.groupBy("manual", F.col("page_pdf").alias("page")).agg(first("Figure").alias("figure_captions"), first("Table").alias("table_titles"))
    return c.join(f, ["manual", "page"], "left").withColumns({n: F.coalesce(n, F.array().cast("array<string>")) for n in ("figure_captions", "table_titles", "sign_codes")})


def fuse_pages(queries: DataFrame, text_hits: DataFrame, page_hits: DataFrame, most: int = 4, texts: int = 3) -> DataFrame:
    """qid, page, score, rank: the named page first (999), its neighbours (997), then pages of a visual query, or pages of the best texts before them.

    queries: qid, query; text_hits and page_hits: qid, page, score, rank.
    """
    q = queries.select("qid", explicit_page(F.col("query")).alias("p"), has_any(F.col("query"), VISUAL_TERMS).alias("visual"))
    named = q.where("p IS NOT NULL").select("qid", F.explode(F.array(F.struct(F.col("p").alias("page"), F.lit(999.0).alias("score"), F.lit(0).alias("tier"), F.lit(0).alias("at")), F.struct((F.col("p") - 1).alias("page"), F.lit(997.0).alias("score"), F.lit(0).alias("tier"), F.lit(1).alias("at")), F.struct((F.col("p") + 1).alias("page"), F.lit(997.0).alias("score"), F.lit(0).alias("tier"), F.lit(2).alias("at")))).alias("x")).select("qid", "x.*").where("page >= 1")
    by_text = text_hits.where(F.col("rank") <= texts).join(q.where("NOT visual"), "qid").select("qid", "page", "score", F.lit(1).alias("tier"), F.col("rank").alias("at"))
    by_page = page_hits.select("qid", "page", "score", F.lit(2).alias("tier"), F.col("rank").alias("at"))
    united = named.unionByName(by_text).unionByName(by_page)
    first = Window.partitionBy("qid", "page").orderBy("tier", "at")
    order = Window.partitionBy("qid").orderBy("tier", "at")
    return united.withColumn("rn", F.row_number().over(first)).where("rn = 1").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("qid", "page", "score", "rank")


def keep_context(hits: DataFrame, terms: Column, text: str, least: int) -> DataFrame:
    """Hits whose text has all terms of their query; the first `least` hits of queries that would lose all."""
    ok = F.forall(terms, lambda t: F.contains(F.lower(text), t))
    marked = hits.withColumn("ok", ok).withColumn("any", F.max("ok").over(Window.partitionBy("qid")))
    return marked.where("ok OR (NOT any AND rank <= %d)" % least).drop("ok", "any")


#: What a page gains where its captions, tables, codes or text contain the query, and, for a visual query, where it has any of the first three.
PAGE_BOOSTS = {"figure_captions": (0.30, 0.08), "table_titles": (0.25, 0.06), "sign_codes": (0.16, 0.04)}
TEXT_BOOST, CAPTION_WORD_BOOST = 0.10, 0.30


def match_text(c: Column) -> Column:
    """Lower case, one blank for every run of white space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def page_boost(query: Column, text: Column) -> Column:
    """What a page record (figure_captions, table_titles, sign_codes) with a text gains for a query."""
    q = match_text(query)
    visual, out = has_any(query, VISUAL_TERMS), F.when((q != "") & F.contains(match_text(text), q), TEXT_BOOST).otherwise(0.0)
    for column, (hit, there) in PAGE_BOOSTS.items():
        out = out + F.when((q != "") & F.contains(match_text(F.array_join(column, " | ")), q), hit).otherwise(0.0) + F.when(visual & (F.size(column) > 0), there).otherwise(0.0)
    return out


def caption_word_boost(query: Column) -> Column:
    """What a page gains before the best are taken, if any word of the query stands in its captions."""
    captions = F.lower(F.array_join("figure_captions", " "))
    return F.when(F.exists(F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != ""), lambda w: F.contains(captions, w)), CAPTION_WORD_BOOST).otherwise(0.0)


def hybrid_pages(scores: DataFrame, queries: DataFrame, pages: DataFrame, key: list[str], k: int = 5) -> DataFrame:
    """qid, page key, score, rank: the k best pages after the boost of their captions, so that a boost can bring a page in.

    scores: qid, key, score; queries: qid, query; pages: key, figure_captions.
    """
    rows = scores.join(queries.select("qid", "query"), "qid").join(pages.select(*key, "figure_captions"), key)
    rows = rows.withColumn("score", F.col("score") + caption_word_boost(F.col("query")))
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), *key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", *key, "score", "rank")


def joined_context(hits: DataFrame, keep: int = 3, same: int = 200) -> DataFrame:
    """qid, context: the texts of a query's hits (qid, rank, text) without rule labels, those of equal beginnings once, the first `keep` joined."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("text", r"(Standard|Option|Guidance):?\s*\d*", ""), r"\s+", " "))
    rows = hits.select("qid", "rank", clean.alias("t")).withColumn("rn", F.row_number().over(Window.partitionBy("qid", F.substring("t", 1, same)).orderBy("rank"))).where("rn = 1")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("n") <= keep)
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "\n\n").alias("context"))


def extractive_answer(queries: DataFrame, sentences: DataFrame, k: int = 5) -> DataFrame:
    """qid, answer, citations: the k best distinct sentences by word overlap, and their distinct sources in that order.

    queries: qid, question; sentences: qid, sentence, source (candidates of each query).
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    one = sentences.groupBy("qid", "sentence").agg(F.min("source").alias("source"))
    rows = one.join(queries.select("qid", words(F.col("question")).alias("q")), "qid").withColumn("score", F.size(F.array_intersect("q", words(F.col("sentence")))))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "sentence"))).where(F.col("n") <= k)
    listed = F.array_sort(F.collect_list(F.struct("n", "sentence", "source")))
    return rows.groupBy("qid").agg(listed.alias("s")).select("qid", F.array_join(F.transform("s", lambda x: x["sentence"]), " ").alias("answer"), F.array_distinct(F.transform("s", lambda x: x["source"])).alias("citations"))
