"""Most similar vectors for every vector, by an adaptive dimension scan over inverted lists.

Vectors are normalised and rotated by a random orthogonal matrix, and stored in lists of near vectors. The lists have two
levels of spherical k-means: groups, fitted on a bounded sample, and the lists of each group, fitted in the group's task; a
vector looks into its nearest groups alone, so the work per vector does not grow with the number of lists. Every vector is
indexed. Within a probed list, columns are read in blocks: after each block the
partial squared distance of a pair, scaled to all dimensions, is tested against the bound that the pair must keep
(hypothesis: the true distance is within the bound), and rejected pairs are abandoned. List blocks and query blocks are
bounded, so a hot list becomes a grid of bounded tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragrove.runtime import Shelf, broadcast_if_small, spread

LIST_ROWS = 512        # rows that a list holds on average
GROUP_LISTS = 64       # lists of a group on average
GROUPS = 6             # nearest groups that a vector looks into, at least
MOST_LISTS = 524_288   # bound on the centroids, 64 MB in half precision: lists of 512 rows up to 268 million vectors, longer ones beyond
FIT_ROWS_PER_LIST = 24  # sampled rows per list for fitting
FIT_ROWS = 65_536      # rows that one k-means is fitted on, at most
BASE_BLOCK = 4_096     # rows of one list in one task
QUERY_BLOCK = 16_384   # queries of one list in one task
BLOCKS = (16, 32, 48)  # column boundaries that a pair is tested at
EPS = 2.1              # width of the test: P(abandon a pair within the bound) is below 1e-4 at every block
SLACK = 0.002          # half-precision error allowed in candidates before the exact check
EXPAND_COPIES = 64     # classes of identical vectors up to this size are listed as all pairs, by default


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors of a list column as unit rows, and their positions; others (null, other length, zero, not finite) take no part."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    at = np.flatnonzero(sizes == dim)
    if not len(at):
        return np.zeros((0, dim), np.float32), at
    flat = column.take(pa.array(at)).flatten()
    x = np.asarray(flat.fill_null(float("nan")) if flat.null_count else flat, dtype=np.float64).reshape(-1, dim)
    norm = np.sqrt((x * x).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return (x[ok] / norm[ok, None]).astype(np.float32), at[ok]


def fit_centroids(x: np.ndarray, lists: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; empty lists keep their last centre."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[i:i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        order = np.argsort(home, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(home[order]) > 0])
        sums = np.add.reduceat(x[order], first)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres[home[order][first]] = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres[home[order][first]])
    return centres


def adaptive_scan(q: np.ndarray, c: np.ndarray, tau2: np.ndarray, blocks=BLOCKS, eps: float = EPS):
    """Pairs (i, j, squared distance) with distance of q[i] and c[j] within tau2[i]; pairs are abandoned after column blocks."""
    dim = q.shape[1]
    ends = [b for b in blocks if b < dim] + [dim]
    s = ends[0]
    part = (q[:, :s] ** 2).sum(1)[:, None] + (c[:, :s] ** 2).sum(1)[None] - 2 * (q[:, :s] @ c[:, :s].T)
    bound = lambda d: d / dim * (1 + eps / math.sqrt(d)) ** 2 if d < dim else 1.0
    keep = part <= (bound(s) * tau2)[:, None]
    for b, e in zip(ends, ends[1:]):
        if keep.mean() < 0.1:
            break
        # the block abandons too few pairs here: go on with the whole grid
        part += (q[:, b:e] ** 2).sum(1)[:, None] + (c[:, b:e] ** 2).sum(1)[None] - 2 * (q[:, b:e] @ c[:, b:e].T)
        keep = part <= (bound(e) * tau2)[:, None]
        s = e
    i, j = np.nonzero(keep)
    left = part[i, j]
    for b, e in zip(ends, ends[1:]):
        if e <= s:
            continue
        left = left + ((q[i, b:e] - c[j, b:e]) ** 2).sum(1)
        ok = left <= bound(e) * tau2[i]
        i, j, left = i[ok], j[ok], left[ok]
    return i, j, np.maximum(left, 0)


def best_of(i: np.ndarray, j: np.ndarray, d2: np.ndarray, ids: np.ndarray, k: int):
    """The k smallest distances of each i; ties go to the smaller id."""
    order = np.lexsort((ids[j], d2, i))
    i, j, d2 = i[order], j[order], d2[order]
    start = np.r_[0, np.flatnonzero(np.diff(i)) + 1] if len(i) else np.zeros(0, int)
    rank = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
    return i[rank < k], j[rank < k], d2[rank < k]


def halves(table: pa.Table, dim: int) -> np.ndarray:
    """The half-precision codes of a table as float32 rows."""
    return np.frombuffer(b"".join(table["code"].to_pylist()), np.float16).reshape(-1, dim).astype(np.float32)


def nearest_lists(r: np.ndarray, coarse: np.ndarray, centres: np.ndarray, bounds: np.ndarray, m: int, look: int) -> np.ndarray:
    """The m nearest lists of every row, best first, among those of its `look` nearest groups; -1 where these have fewer.

    bounds: where the lists of each group begin in centres.
    """
    near = r @ coarse.T
    groups = np.argpartition(-near, look - 1, axis=1)[:, :look] if look < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(r), 1))
    best, at = np.full((len(r), m), -np.inf, np.float32), np.full((len(r), m), -1, np.int32)
    asks = np.argsort(groups.ravel(), kind="stable")
    rows, of = asks // groups.shape[1], groups.ravel()[asks]
    start = np.r_[0, np.flatnonzero(np.diff(of)) + 1, len(of)]
    for a, z in zip(start[:-1], start[1:]):
        lo, hi = bounds[of[a]], bounds[of[a] + 1]
        if hi == lo:
            continue
        i = rows[a:z]
        s = np.concatenate([best[i], r[i] @ centres[lo:hi].T], axis=1)
        ids = np.concatenate([at[i], np.broadcast_to(np.arange(lo, hi, dtype=np.int32), (len(i), hi - lo))], axis=1)
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        best[i], at[i] = np.take_along_axis(s, top, 1), np.take_along_axis(ids, top, 1)
    order = np.argsort(-best, axis=1, kind="stable")
    return np.take_along_axis(at, order, 1)


class Index:
    """Lists over one table of vectors.

    encoded: id, h1, h2 (hash of the unit vector), home, probes, code (rotated unit vector in half precision); one row per
    id, that of the latest seq_col. Null ids and unusable vectors take no part; extra columns are not read.
    """

    def __init__(self, df: DataFrame, probes: int, id_col: str = "id", vec_col: str = "dense", seq_col: str | None = "upserted_at", dim: int = 64, seed: int = 7, shelf: Shelf | None = None, name: str = "v"):
        spark = df.sparkSession
        self.dim, self.name, self.shelf, self.grids = dim, name, shelf or Shelf(spark), 0
        src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"), *([F.col(seq_col).cast("timestamp").alias("seq")] if seq_col else [])).where("id IS NOT NULL AND vec IS NOT NULL")
        n = max(1, df.count())
        lists = int(min(MOST_LISTS, max(1, round(n / LIST_ROWS))))
        groups = max(1, lists // GROUP_LISTS)
        turn = rotation(dim, seed)
        want = min(FIT_ROWS, max(16_384, groups * FIT_ROWS_PER_LIST))
        sample = src.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, n // want))) == 0).select("vec").limit(2 * want).toArrow()
        x, _ = unit_rows(sample["vec"].combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.float32())), dim)
        x = x @ turn
        self.empty = not len(x)
        coarse = fit_centroids(x, groups, seed) if len(x) else np.zeros((1, dim), np.float32)
        first = spark.sparkContext.broadcast((turn, coarse))

        def grouped(batches):
            turn, coarse = first.value
            for batch in batches:
                unit, _ = unit_rows(batch.column("vec"), dim)
                r = unit @ turn
                at = np.concatenate([(r[i:i + 4_096] @ coarse.T).argmax(1) for i in range(0, len(r), 4_096)]) if len(r) else np.zeros(0, int)
                yield pa.RecordBatch.from_pydict({"grp": pa.array(at.astype(np.int32)), "code": pa.array([c.tobytes() for c in r.astype(np.float16)], pa.binary())})

        def fitted(t: pa.Table) -> pa.Table:
            rows = halves(t, dim)
            k = max(1, round(len(rows) * bucket / max(LIST_ROWS, n / MOST_LISTS)))
            rows = rows[np.random.default_rng(seed).permutation(len(rows))[:FIT_ROWS]]
            c = fit_centroids(rows, min(k, max(1, len(rows) // 4)), seed)
            return pa.table({"grp": pa.array(np.full(len(c), t["grp"][0].as_py(), np.int32)), "code": pa.array([v.tobytes() for v in c.astype(np.float16)], pa.binary())})

        bucket = max(1, n // max(16_384, lists * FIT_ROWS_PER_LIST))
        fine = src.where(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(bucket)) == 0).mapInArrow(grouped, "grp int, code binary").groupBy("grp").applyInArrow(fitted, "grp int, code binary").toArrow()  # the centroids
        fine = fine.sort_by([("grp", "ascending"), ("code", "ascending")]) if len(fine) else pa.table({"grp": pa.array([0], pa.int32()), "code": pa.array([np.zeros(dim, np.float16).tobytes()], pa.binary())})
        centres, of = halves(fine, dim).astype(np.float16), np.asarray(fine["grp"])
        bounds = np.searchsorted(of, np.arange(len(coarse) + 1))
        self.n_lists = len(centres)
        m = min(probes, self.n_lists)
        look = min(len(coarse), max(GROUPS, -(-2 * m // GROUP_LISTS) + 2))
        model = spark.sparkContext.broadcast((turn, coarse, centres, bounds))
        self.reference = spark.sparkContext.broadcast(x[:8_192])

        def encode(batches):
            import hashlib

            turn, coarse, centres, bounds = model.value
            centres = centres.astype(np.float32)
            for batch in batches:
                unit, at = unit_rows(batch.column("vec"), dim)
                for lo in range(0, len(unit), 8_192):
                    u, a = unit[lo:lo + 8_192], at[lo:lo + 8_192]
                    r = u @ turn
                    top = nearest_lists(r, coarse, centres, bounds, m, look)
                    marks = np.frombuffer(b"".join(hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in u), np.int64).reshape(-1, 2)
                    code = r.astype(np.float16)
                    took = batch.take(pa.array(a))
                    out = {"id": took.column("id"), "h1": pa.array(marks[:, 0]), "h2": pa.array(marks[:, 1]), "home": pa.array(top[:, 0]),
                           "probes": pa.ListArray.from_arrays(pa.array(np.arange(0, m * len(r) + 1, m, dtype=np.int32)), pa.array(top.ravel())),
                           "code": pa.array([c.tobytes() for c in code], pa.binary())}
                    if seq_col:
                        out["seq"] = took.column("seq")
                    yield pa.RecordBatch.from_pydict(out)

        schema = "id bigint, h1 bigint, h2 bigint, home int, probes array<int>, code binary" + (", seq timestamp" if seq_col else "")
        coded = spread(src).mapInArrow(encode, schema)
        if seq_col:
            body = F.struct("h1", "h2", "home", "probes", "code")
            # null seq counts as the earliest; ties go to the larger hash, so the choice is fixed
            coded = coded.groupBy("id").agg(F.max_by(body, F.struct(F.coalesce("seq", F.lit("0001-01-01").cast("timestamp")), "h1", "h2")).alias("b")).select("id", "b.*")
        else:
            body = F.struct("h1", "h2", "home", "probes", "code")
            coded = coded.groupBy("id").agg(F.min_by(body, F.struct("h1", "h2")).alias("b")).select("id", "b.*")
        self.encoded = self.shelf.keep(coded, f"{name}-coded")

    def classes(self) -> DataFrame:
        """rep, n, h1, h2 of every class of at least two ids with identical unit vectors."""
        return self.encoded.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")

    def grid(self, base: DataFrame, queries: DataFrame) -> DataFrame:
        """Base rows and query copies, united and keyed by bounded blocks (task) of lists."""
        ask = queries.select("id", F.explode("probes").alias("list"), "code", "tau2").where("list >= 0")
        nb = base.groupBy(F.col("home").alias("list")).agg(F.count("*").alias("b"))
        nq = queries.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count("*").alias("q"))
        blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(F.coalesce(n, F.lit(0)) / size)).cast("int")
        self.grids += 1
        lists = self.shelf.keep(nb.join(nq, "list", "left").select("list", blocks("b", BASE_BLOCK).alias("nb"), blocks("q", QUERY_BLOCK).alias("nq")), f"{self.name}-lists-{self.grids}")
        lists = F.broadcast(lists)  # at most MOST_LISTS rows
        own = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        b = base.withColumnRenamed("home", "list").join(lists, "list").withColumns({"bb": own("nb", 1)}).select("id", "code", "list", "bb", every("nq").alias("qb"), F.lit(None).cast("float").alias("tau2"))
        q = ask.join(lists, "list").withColumn("qb", own("nq", 2)).select("id", "code", "list", every("nb").alias("bb"), "qb", "tau2")
        return b.unionByName(q)

    def scan(self, grid: DataFrame, k: int | None) -> DataFrame:
        """id_q, id, d2: pairs within tau2 of the query, at most k of each query and cell where k is given."""
        dim = self.dim

        def run(t: pa.Table) -> pa.Table:
            tau = t["tau2"]
            base, ask = t.filter(pc.is_null(tau)), t.filter(pc.is_valid(tau))
            out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]
            if base.num_rows and ask.num_rows:
                c, cid = halves(base, dim), np.asarray(base["id"])
                q, qid, tau2 = halves(ask, dim), np.asarray(ask["id"]), np.asarray(ask["tau2"]).astype(np.float32)
                parts = []
                for lo in range(0, len(q), 1_024):
                    i, j, d2 = adaptive_scan(q[lo:lo + 1_024], c, tau2[lo:lo + 1_024])
                    other = qid[lo + i] != cid[j]
                    i, j, d2 = i[other], j[other], d2[other]
                    if k is not None:
                        i, j, d2 = best_of(i, j, d2, cid, k)
                    parts.append((qid[lo + i], cid[j], d2.astype(np.float32)))
                out = [np.concatenate(x) for x in zip(*parts)]
            return pa.table({"id_q": out[0], "id": out[1], "d2": out[2]})

        return grid.groupBy("list", "bb", "qb").applyInArrow(run, "id_q bigint, id bigint, d2 float")


def exact_cosines(pairs: DataFrame, df: DataFrame, id_col: str, vec_col: str, seq_col: str | None) -> DataFrame:
    """pairs (id_a, id_b) with the cosine of the source vectors in double precision."""
    ids = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"), (F.col(seq_col) if seq_col else F.lit(0)).alias("seq")).where("vec IS NOT NULL")
    vec = src.join(broadcast_if_small(ids), "id", "left_semi").groupBy("id").agg(F.max_by("vec", "seq").alias("vec"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    joined = pairs.join(vec.select(F.col("id").alias("id_a"), F.col("vec").alias("va")), "id_a").join(vec.select(F.col("id").alias("id_b"), F.col("vec").alias("vb")), "id_b")
    return joined.select("id_a", "id_b", (dot(F.col("va"), F.col("vb")) / F.sqrt(dot(F.col("va"), F.col("va")) * dot(F.col("vb"), F.col("vb")))).alias("cosine"))


def similar_pairs(df: DataFrame, threshold: float = 0.9, probes: int = 6, id_col: str = "id", vec_col: str = "dense", seq_col: str | None = "upserted_at", dim: int = 64, seed: int = 7, name: str = "v", expand_copies: int | None = EXPAND_COPIES) -> DataFrame:
    """id_a < id_b of different ids whose vectors have a cosine of at least threshold.

    A pair is found if either vector's list is among the probed lists of the other. Identical unit vectors form classes: the
    scan works on one representative of each; classes of up to expand_copies ids are listed as all pairs (None: all classes),
    larger ones as links from every copy to the representative, which alone carries the class's links to other vectors. An id upserted
    again counts once with its latest vector. Null, zero, not finite and wrongly sized vectors take no part; an empty table
    gives no pairs.
    """
    index = Index(df, probes, id_col, vec_col, seq_col, dim, seed, name=name)
    cls = index.shelf.keep(index.classes(), f"{name}-classes")
    members = index.encoded.select("id", "h1", "h2").join(broadcast_if_small(cls), ["h1", "h2"]).select("id", "rep", "n")
    members = index.shelf.keep(members, f"{name}-members")
    copies = members.where("id <> rep").select("id")
    base = index.encoded.join(broadcast_if_small(copies), "id", "left_anti")
    tau2 = 2 - 2 * (threshold - SLACK)
    grid = index.grid(base.select("id", "home", "code"), base.select("id", "probes", "code", F.lit(tau2).cast("float").alias("tau2")))
    found = index.scan(grid, None).select(F.least("id_q", "id").alias("id_a"), F.greatest("id_q", "id").alias("id_b"), (1 - F.col("d2") / 2).alias("cosine"))
    found = index.shelf.keep(found.groupBy("id_a", "id_b").agg(F.min("cosine").alias("cosine")), f"{name}-found")
    sure = found.where(F.col("cosine") >= threshold + SLACK).select("id_a", "id_b")
    edge = found.where(F.col("cosine") < threshold + SLACK)
    if not edge.isEmpty():
        sure = sure.unionByName(exact_cosines(edge, df, id_col, vec_col, seq_col).where(F.col("cosine") >= threshold).select("id_a", "id_b"))
    if members.isEmpty():
        return sure
    few = members if expand_copies is None else members.where(F.col("n") <= expand_copies)
    left = few.select(F.col("rep").alias("id_a"), F.col("id").alias("a"))
    right = few.select(F.col("rep").alias("id_b"), F.col("id").alias("b"))
    wide = sure.join(left, "id_a", "left").join(right, "id_b", "left").select(F.coalesce("a", "id_a").alias("a"), F.coalesce("b", "id_b").alias("b"))
    inner = left.join(right, left.id_a == right.id_b).where("a < b").select("a", "b")
    star = members.where((F.lit(False) if expand_copies is None else F.col("n") > expand_copies) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("a"), F.col("id").alias("b"))
    return wide.unionByName(inner).unionByName(star).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def nearest(df: DataFrame, queries=None, k: int = 10, probes: int | None = None, id_col: str = "id", vec_col: str = "dense", seq_col: str | None = "upserted_at", dim: int = 64, seed: int = 7, name: str = "v") -> DataFrame:
    """id_q, rank, id, cosine: the k nearest other ids of every query id (a Column condition on id; all ids without it).

    The scan's bound of a query is the k-th best distance to a bounded part of the collection, so no member of the true
    list is beyond it. Rows are kept whole: fewer than k come out only where fewer usable vectors are in the probed lists.
    Ties go to the smaller id. Null ids and unusable vectors take no part.
    """
    rows = max(1, df.count())
    wide = probes or max(24, math.ceil(1.8 * math.sqrt(rows / LIST_ROWS)))
    index = Index(df, wide, id_col, vec_col, seq_col, dim, seed, name=name)
    ask = index.encoded if queries is None else index.encoded.where(queries)
    reference = index.reference

    def bound(batches):
        ref = reference.value.astype(np.float32)
        for batch in batches:
            q = halves(pa.Table.from_batches([batch]), dim) if batch.num_rows else np.zeros((0, dim), np.float32)
            tau = np.full(len(q), 4.0, np.float32)
            for lo in range(0, len(q), 512):
                near = q[lo:lo + 512] @ ref.T if len(ref) > k + 1 else np.zeros((len(q[lo:lo + 512]), 0))
                if near.shape[1]:
                    # the query itself may be in the reference, so one rank further
                    tau[lo:lo + 512] = 2 - 2 * np.partition(near, -(k + 1), axis=1)[:, -(k + 1)] + 2 * SLACK
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "probes": batch.column("probes"), "code": batch.column("code"), "tau2": pa.array(tau)})

    asked = ask.select("id", "probes", "code").mapInArrow(bound, "id bigint, probes array<int>, code binary, tau2 float")
    asked = index.shelf.keep(asked, f"{name}-asked")
    hits = index.scan(index.grid(index.encoded.select("id", "home", "code"), asked), k)
    best = hits.groupBy("id_q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "id"))), 1, k).alias("top"))
    return best.select("id_q", F.posexplode("top").alias("pos", "t")).select("id_q", (F.col("pos") + 1).alias("rank"), F.col("t.id").alias("id"), F.round(1 - F.col("t.d2").cast("double") / 2, 3).alias("cosine"))
