"""Vector search and ranking over many queries at once.

Queries and items are spread over a grid of cells, a bounded block of queries by a bounded block of items each, and every cell
keeps the k best of each of its queries; the partial lists are merged per query. So neither side is collected or broadcast, no
pair is materialised, and a hot key makes no hot cell, as blocks are cut by hash. Dense products are matrix products, sparse
ones join the tokens of the cell's two sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paragrove.runtime import Shelf

QUERY_BLOCK = 8_192   # queries of a cell, about
ITEM_BLOCK = 32_768   # items of a cell, about
HOT_PART = 20         # a token of more than one in so many of a cell's items is hot
PAGE_QUERIES = 32_768   # query vectors of a cell of late interaction, about
PAGE_PATCHES = 131_072  # patches of a cell of late interaction, about
LEAST_BLOCK = 2_048   # items that a cell should have at least, before more cores share the work


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row per key, that of the latest `at` (last write wins); ties go to any, null times lose."""
    body = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(body, F.coalesce(at, F.lit("0001-01-01").cast("timestamp_ntz"))).alias("r")).select(key, "r.*")


def _matrix(column: pa.Array, dim: int, unit: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors of a column as rows (of length 1), and their positions."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.flatnonzero(np.asarray(pc.fill_null(pc.list_value_length(column), -1)) == dim)
    if not len(at):
        return np.zeros((0, dim)), at
    flat = column.take(pa.array(at)).flatten()
    x = np.asarray(flat.fill_null(float("nan")) if flat.null_count else flat, dtype=np.float64).reshape(-1, dim)
    norm = np.sqrt((x * x).sum(1))
    ok = np.isfinite(norm) & ((norm > 0) | (not unit))
    return (x[ok] / norm[ok, None] if unit else x[ok]), at[ok]


def _cells(queries: DataFrame, items: DataFrame, body: list[str], q_block: int = QUERY_BLOCK, i_block: int = ITEM_BLOCK, part: Column | None = None):
    """Rows of both sides, grouped by cell: asks (whether it is a query), id, body. part: what keeps items of one value in one block; by default the id."""
    cores = items.sparkSession.sparkContext.defaultParallelism
    n, m = queries.count(), items.count()
    qn, im = max(1, -(-n // q_block)), max(1, -(-m // i_block), min(cores, m // LEAST_BLOCK))
    cut = lambda c, k, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    q = queries.select(F.lit(True).alias("asks"), F.col("qid").cast("bigint").alias("id"), *body, cut(F.col("qid"), qn, 1).alias("qb"), every(im).alias("ib"))
    i = items.select(F.lit(False).alias("asks"), F.col("id").cast("bigint").alias("id"), *body, cut(F.col("id") if part is None else part, im, 2).alias("ib"), every(qn).alias("qb"))
    return q.unionByName(i).groupBy("qb", "ib")


def _best(s: np.ndarray, qid: np.ndarray, ids: np.ndarray, k: int, slack: float) -> pa.Table:
    """qid, id, score of the k largest finite values of every row, and of those that tie with the last."""
    if not s.size:
        return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    top, few = min(k, s.shape[1]), s
    if s.shape[1] >= 256 * k:  # the k-th of the maxima of stretches is a lower bound
        few = np.maximum.reduceat(s, np.arange(0, s.shape[1], 64), axis=1)
    cut = np.partition(few, -top, axis=1)[:, -top]
    i, j = np.nonzero(s >= np.maximum(cut - slack, -np.finfo(s.dtype).max)[:, None])
    score = s[i, j]
    ok = np.isfinite(score)
    if few is not s:
        order = np.lexsort((-score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, i, side="left")
        n = np.searchsorted(i, i, side="right") - first
        ok = np.isfinite(score) & (score >= score[first + np.minimum(n, top) - 1] - slack)
    i, j, score = i[ok], j[ok], score[ok]
    return pa.table({"qid": qid[i], "id": ids[j], "score": score})


HITS = "qid bigint, id bigint, score double"


def dense_topk(queries: DataFrame, items: DataFrame, k: int, dim: int = 64, keep_self: bool = True) -> DataFrame:
    """qid, id, score, rank of the k items with the largest cosine to each query.

    queries: qid, vec; items: id, vec. Null, wrongly sized and zero vectors take no part on either side. Ties go to the
    smaller id. An empty side gives no rows.
    """
    def score(t: pa.Table) -> pa.Table:
        ask, base = t.filter(t["asks"]), t.filter(pc.invert(t["asks"]))
        (q, qa), (x, xa) = _matrix(ask["vec"], dim), _matrix(base["vec"], dim)
        qid, ids, out = np.asarray(ask["id"])[qa], np.asarray(base["id"])[xa], []
        for lo in range(0, len(q), 256):
            s = q[lo:lo + 256] @ x.T
            if not keep_self:
                s[qid[lo:lo + 256, None] == ids[None]] = -np.inf
            out.append(_best(s, qid[lo:lo + 256], ids, k, 1e-12))
        return pa.concat_tables(out) if out else _best(np.zeros((0, 0)), qid, ids, k, 0)

    return ranked(_cells(queries.select("qid", "vec"), items.select("id", "vec"), ["vec"]).applyInArrow(score, HITS), k)


def ranked(hits: DataFrame, k: int, score: str = "score", digits: int = 9) -> DataFrame:
    """The k best rows of each qid with their rank; scores that agree to `digits` places are ties, which go to the smaller id."""
    w = Window.partitionBy("qid").orderBy(F.round(score, digits).desc(), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sparse_topk(queries: DataFrame, items: DataFrame, k: int, step: int = 1_024) -> DataFrame:
    """qid, id, score, rank by the dot product of sparse vectors (map of token to weight).

    In a cell hot tokens give a matrix product and the other tokens of both sides are joined; products are added up per pair for `step` queries at a time, and the k best
    of each query are kept. Pairs without a common token, and those whose product is 0, are no hits; empty and null maps have
    none, null weights count as 0.
    """
    def flat(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        tokens, weights = t["t"].combine_chunks(), t["w"].combine_chunks()
        n = np.asarray(pc.list_value_length(tokens))
        return np.asarray(t["id"]), np.repeat(np.arange(len(n)), n), np.asarray(tokens.flatten()).astype(np.int64), np.nan_to_num(np.asarray(weights.flatten().cast(pa.float64()).fill_null(0.0)))

    def score(t: pa.Table) -> pa.Table:
        (qid, q, qt, qw), (ids, d, dt, dw) = flat(t.filter(t["asks"])), flat(t.filter(pc.invert(t["asks"])))
        # tokens of many items are columns of a matrix product, the others are joined
        seen, times = np.unique(dt, return_counts=True)
        hot = seen[times * HOT_PART > len(ids)]

        def columns(row, token, weight, n):
            at = np.minimum(np.searchsorted(hot, token), max(0, len(hot) - 1))
            is_hot = hot[at] == token if len(hot) else np.zeros(len(token), bool)
            x = np.zeros((n, len(hot)))
            x[row[is_hot], at[is_hot]] = weight[is_hot]
            return x, row[~is_hot], token[~is_hot], weight[~is_hot]

        x, d, dt, dw = columns(d, dt, dw, len(ids))
        v, q, qt, qw = columns(q, qt, qw, len(qid))
        order = np.argsort(dt, kind="stable")
        d, dt, dw, out = d[order], dt[order], dw[order], []
        width = max(1, min(step, 8_000_000 // max(1, len(ids))))
        for lo in range(0, len(qid) if len(ids) else 0, width):
            own = np.flatnonzero((q >= lo) & (q < lo + width))
            first, last = np.searchsorted(dt, qt[own], side="left"), np.searchsorted(dt, qt[own], side="right")
            m, n = len(qid[lo:lo + width]), last - first
            s, at = (v[lo:lo + width] @ x.T).ravel(), 0
            ends = np.cumsum(n)
            while at < len(own):  # a bounded number of products at a time
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2_000_000, side="right")))
                c = n[at:to]
                j = np.repeat(first[at:to] - np.r_[0, np.cumsum(c)[:-1]], c) + np.arange(c.sum())
                s += np.bincount(np.repeat(q[own[at:to]] - lo, c) * len(ids) + d[j], weights=np.repeat(qw[own[at:to]], c) * dw[j], minlength=len(s))
                at = to
            s = s.reshape(m, len(ids))
            out.append(_best(np.where(s == 0, -np.inf, s), qid[lo:lo + width], ids, k, 1e-9))
        return pa.concat_tables(out) if out else _best(np.zeros((0, 0)), qid, ids, k, 0)

    body = [F.map_keys("sparse").alias("t"), F.map_values("sparse").alias("w")]
    q, i = queries.where("size(sparse) > 0").select("qid", *body), items.where("size(sparse) > 0").select("id", *body)
    return ranked(_cells(q, i, ["t", "w"]).applyInArrow(score, HITS), k)


def rrf(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (qid, id, rank): qid, id, score, rank. Ties keep the order of the first list, then of its ranks."""
    united = None
    for i, df in enumerate(lists):
        part = df.select("qid", "id", (1.0 / (constant + F.col("rank"))).alias("s"), F.lit(i).alias("list"), F.col("rank").alias("r"))
        united = part if united is None else united.unionByName(part)
    fused = united.groupBy("qid", "id").agg(F.sum("s").alias("score"), F.min(F.struct("list", "r")).alias("first"))
    w = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), "first.list", "first.r", "id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "id", "score", "rank")


def final_score(base: Column, graph: Column, weight: Column, hierarchy: Column) -> Column:
    """The scoring formula: base + 0.4 graph + 0.3 (rule weight - 1) + 0.2 hierarchy."""
    return base + 0.4 * graph + 0.3 * (weight - 1.0) + 0.2 * hierarchy


def hierarchy_prior(query: Column, part: Column, chapter: Column) -> Column:
    """0.6 where the query names the item's part, and 0.6 for its chapter (by substring)."""
    q, p, c = F.lower(query), F.lower(F.coalesce(part, F.lit(""))), F.lower(F.coalesce(chapter, F.lit("")))
    mp, mc = F.regexp_extract(q, r"\bpart\s+(\d+)\b", 1), F.regexp_extract(q, r"\bchapter\s+([0-9a-z]+)\b", 1)
    return F.when((mp != "") & p.contains(F.concat(F.lit("part "), mp)), 0.6).otherwise(0.0) + F.when((mc != "") & c.contains(mc), 0.6).otherwise(0.0)


def _page_sums(v: np.ndarray, qs: np.ndarray, x: np.ndarray, start: np.ndarray):
    """Yields, for some whole queries at a time, the number of the first, their float32 scores of all pages, and how far off two of these may be against each other; both in units of the query.

    v: the vectors of queries that begin at qs; x: the patches of pages that begin at start. The patches of a page lie in
    `deep` layers, the last repeated to fill them, so that most maxima are taken of whole products.
    """
    norm = np.sqrt((v * v).sum(1))
    tokens, scale = np.diff(np.r_[qs, len(v)]), np.maximum.reduceat(norm, qs)
    scale[scale == 0] = 1
    most = np.sqrt((x * x).sum(1).max()) or 1.0
    n = np.diff(np.r_[start, len(x)])
    deep = int(max(1, min(16, n.mean() // 4)))
    groups = -(-n // deep)
    head = np.r_[0, np.cumsum(groups)[:-1]]
    page = np.repeat(np.arange(len(n)), groups)
    at = (np.arange(len(page)) - head[page]) * deep
    layers = [(x[start[page] + np.minimum(at + i, n[page] - 1)] / most).astype(np.float32) for i in range(deep)]
    v = (v / np.repeat(scale, tokens)[:, None]).astype(np.float32)
    ends, lo, width = np.r_[qs, len(v)], 0, max(1, min(512, 16_000_000 // len(page)))
    while lo < len(qs):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + width, side="right")) - 1)
        q, s = v[ends[lo]:ends[hi]], np.empty((ends[hi] - ends[lo], len(page)), np.float32)
        for g in range(0, len(page), 1_024):
            top = q @ layers[0][g:g + 1_024].T
            for layer in layers[1:]:
                np.maximum(top, q @ layer[g:g + 1_024].T, out=top)
            s[:, g:g + 1_024] = top
        s = s if len(page) == len(start) else np.maximum.reduceat(s, head, axis=1)
        s = s if len(q) == hi - lo else np.add.reduceat(s, qs[lo:hi] - qs[lo], axis=0)
        t = tokens[lo:hi]
        yield lo, s, t * (v.shape[1] + 8 + t) * 1.5e-7 + 2e-9 / (scale[lo:hi] * most)
        lo = hi


def _page_scores(v: np.ndarray, qs: np.ndarray, x: np.ndarray, start: np.ndarray, q: np.ndarray, p: np.ndarray, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """q, p, the exact score of pairs of a query and a page; if not whole, the token and p of every part of a score, and the part."""
    ends, stop, out = np.r_[qs, len(v)], np.r_[start, len(x)], []
    order = np.argsort(p, kind="stable")
    q, p = q[order], p[order]
    cuts = np.flatnonzero(np.r_[True, np.diff(p) != 0]) if len(p) else p
    for a, z in zip(cuts, np.r_[cuts[1:], len(p)]):
        patches = x[start[p[a]]:stop[p[a] + 1]].T
        while a < z:
            n = ends[q[a:z] + 1] - ends[q[a:z]]
            m = max(1, int(np.searchsorted(np.cumsum(n), 4_000_000 // patches.shape[1], side="right")))
            n, own = n[:m], q[a:a + m]
            tokens = np.repeat(ends[own] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            s = (v[tokens] @ patches).max(1)
            out.append((own, np.add.reduceat(s, np.r_[0, np.cumsum(n)[:-1]]) if len(s) > m else s) if whole else (tokens, s))
            out[-1] = (out[-1][0], np.full(len(out[-1][0]), p[a]), out[-1][1])
            a += m
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (q, p, np.zeros(0))


def maxsim(queries: DataFrame, pages: DataFrame, k: int, dim: int = 64, block: int = PAGE_PATCHES) -> DataFrame:
    """qid, id, score, rank of late interaction: the sum over a query's vectors of the largest dot product with a page's.

    queries: qid, vec (one row per query vector); pages: id, vec (one row per patch). The vectors of a query share a block, and
    so do the patches of a page, so a cell has whole scores and keeps the k best pages of each query: products in single precision
    show which may be among them, those are scored exactly. Pages of more than `block` patches are cut over cells; their maxima
    per query vector are merged and summed after that, for queries of one vector only where they are among the k best of the cell.
    """
    shelf = Shelf(pages.sparkSession)
    q = shelf.keep(queries.select("qid", "vec", F.monotonically_increasing_id().alias("token")), "tokens")
    sizes = pages.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > block)
    big = shelf.keep(sizes.select("id", F.ceil(F.col("n") / block).cast("int").alias("cuts")), "big")  # fewer than patches / block
    p = pages.join(F.broadcast(big), "id", "left").withColumn("token", F.when(F.col("cuts").isNotNull(), F.floor(F.rand(7) * F.col("cuts")).cast("bigint")))

    def best(t: pa.Table) -> pa.Table:
        ask, base = t.filter(t["asks"]), t.filter(pc.invert(t["asks"]))
        (v, va), (x, xa) = _matrix(ask["vec"], dim, False), _matrix(base["vec"], dim, False)
        qid, token, ids = np.asarray(ask["id"])[va], np.asarray(ask["token"])[va], np.asarray(base["id"])[xa]
        part = np.asarray(base["token"].is_valid())[xa]
        out = [pa.table({"qid": pa.array([], pa.int64()), "token": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})]
        if len(v) and len(x):
            order = np.argsort(ids, kind="stable")
            x, ids, part = x[order], ids[order], part[order]
            start = np.flatnonzero(np.r_[True, np.diff(ids) != 0])
            page, cut = ids[start], part[start]
            vo = np.argsort(qid, kind="stable")
            v, qid, token = v[vo], qid[vo], token[vo]
            qs = np.flatnonzero(np.r_[True, np.diff(qid) != 0])
            one, pairs = np.diff(np.r_[qs, len(v)]) == 1, []
            for lo, s, slack in _page_sums(v, qs, x, start):
                if cut.any():
                    s = np.where(cut[None] & ~one[lo:lo + len(s), None], -np.inf, s)
                least = np.partition(s, -min(k, len(page)), axis=1)[:, -min(k, len(page))]
                i, j = np.nonzero((s >= (least - slack)[:, None]) & np.isfinite(s))
                pairs.append((i + lo, j))
            i, j, s = _page_scores(v, qs, x, start, *(np.concatenate(c) for c in zip(*pairs)))
            order = np.lexsort((-s, i))
            i, j, s = i[order], j[order], s[order]
            first = np.searchsorted(i, i, side="left")
            n = np.searchsorted(i, i, side="right") - first
            ok = s >= s[first + np.minimum(n, k) - 1] - 1e-9
            i, j, s = i[ok], j[ok], s[ok]
            out.append(pa.table({"qid": qid[qs[i]], "token": pa.array(token[qs[i]], mask=~cut[j]), "id": page[j], "s": s}))
            many, parts = np.flatnonzero(~one), np.flatnonzero(cut)
            if len(many) and len(parts):
                i, j, s = _page_scores(v, qs, x, start, np.tile(many, len(parts)), np.repeat(parts, len(many)), False)
                out.append(pa.table({"qid": qid[i], "token": token[i], "id": page[j], "s": s}))
        return pa.concat_tables(out)

    tops = _cells(q, p, ["vec", "token"], q_block=PAGE_QUERIES, i_block=block, part=F.struct("id", "token")).applyInArrow(best, "qid bigint, token bigint, id bigint, s double")
    tops = shelf.keep(tops, "tops")
    merged = tops.where("token IS NOT NULL").groupBy("qid", "token", "id").agg(F.max("s").alias("s")).groupBy("qid", "id").agg(F.sum("s").alias("score"))
    return ranked(tops.where("token IS NULL").select("qid", "id", F.col("s").alias("score")).unionByName(merged), k)


def sign_bits(vec: Column) -> Column:
    """The signs of all components of a vector (binary quantisation), as bigints of 64 bits each."""
    word = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR((x > 0).cast("bigint")))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(vec) - 1) / 64).cast("int")), lambda i: word(F.slice(vec, i * 64 + 1, F.lit(64))))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def binary_topk(queries: DataFrame, items: DataFrame, k: int, first: int = 40, dim: int = 64) -> DataFrame:
    """qid, id, score, rank of the k items with the largest dot product: candidates by sign bits, then exactly beyond them.

    In every cell the `first` nearest items by Hamming distance are scored and give a bound per query. Every other item whose
    sign bits leave room for a product of that size, at most its norm times the norm of the query's components of equal sign,
    is scored too, so the result is that of brute force. queries: qid, vec; items: id, vec. Null and wrongly sized vectors take
    no part.
    """
    def score(t: pa.Table) -> pa.Table:
        ask, base = t.filter(t["asks"]), t.filter(pc.invert(t["asks"]))
        (q, qa), (x, xa) = _matrix(ask["vec"], dim, False), _matrix(base["vec"], dim, False)
        qid, ids, out = np.asarray(ask["id"])[qa], np.asarray(base["id"])[xa], []
        plus, norm = (x > 0).astype(np.float64), np.sqrt((x * x).sum(1))
        for lo in range(0, len(q) if len(x) else 0, 512):
            v = q[lo:lo + 512]
            up = (v > 0).astype(np.float64)
            differ = up.sum(1)[:, None] + plus.sum(1)[None] - 2 * (up @ plus.T)
            n = min(max(first, k), len(x))
            near = np.argpartition(differ, n - 1, axis=1)[:, :n]
            known = np.einsum("qd,qnd->qn", v, x[near])
            least = np.partition(known, -min(k, n), axis=1)[:, -min(k, n)] if n >= k else np.full(len(v), -np.inf)
            room = norm[None] * np.sqrt((v * v * up) @ plus.T + (v * v * (1 - up)) @ (1 - plus).T)
            i, j = np.nonzero(room >= least[:, None] - 1e-9)
            s = np.full((len(v), len(x)), -np.inf)
            s[i, j] = np.einsum("nd,nd->n", v[i], x[j])
            out.append(_best(s, qid[lo:lo + 512], ids, k, 1e-9))
        return pa.concat_tables(out) if out else _best(np.zeros((0, 0)), qid, ids, k, 0)

    return ranked(_cells(queries.select("qid", "vec"), items.select("id", "vec"), ["vec"], i_block=8_192).applyInArrow(score, HITS), k)


def overlap_score(query: Column, text: Column) -> Column:
    """The stand-in reranker: the share of the query's distinct words that the text has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: F.length(w) > 0))
    q = words(query)
    return F.size(F.array_intersect(q, words(text))) / F.greatest(F.size(q), F.lit(1))


def identity_rerank(rank: Column) -> Column:
    """Order kept: 1 - position * 1e-6, positions from 0."""
    return 1 - (rank - 1) * F.lit(1e-6)
