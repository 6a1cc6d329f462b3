"""Repetition inside a single document, by weak supervision.

Rules measure repeated short phrases, sentences, clauses and paragraphs, the most frequent phrase and compressibility of the
whole text; each votes "repetitive", "not repetitive", or abstains. Expectation-maximisation over the counts of vote patterns
estimates each rule's accuracy and the prior, and every pattern's posterior probability ranks its documents; no rule must
pass. The share of words in repeated passages of eight words is measured beside the rules and has no vote.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragrove.runtime import Shelf, spread

GRAM = 8
LEAST_PARTS = 4  # a text of fewer sentences, clauses or paragraphs says nothing about their repetition
WORDS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"(?<=[.!?…;])\s+|\n+")
CLAUSE = re.compile(r"[,.;:!?…\n]+")
#: rule: votes "not" up to the first value (never where it is None), "repetitive" from the second, abstains between
RULES = {"phrase_share": (0.15, 0.30), "sentence_share": (0.0, 0.30), "clause_share": (0.0, 0.25), "paragraph_share": (None, 0.25), "top_phrase_share": (None, 0.20), "squeeze": (0.50, 0.65)}
MEASURES = ["n_words", "share", *RULES]


def gram_keys(codes: np.ndarray, gram: int) -> np.ndarray:
    """One 64-bit key per window of `gram` words; equal windows have equal keys, different ones hardly ever."""
    n = max(0, len(codes) - gram + 1)
    keys = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + codes[k:k + n]
            keys ^= keys >> np.uint64(29)
    return keys


def passage_share(codes: np.ndarray, gram: int = GRAM) -> float:
    """The share of words in passages of at least gram words that began earlier too.

    A window of gram words that equals an earlier one marks its words.
    """
    keys = gram_keys(codes, gram)
    n = len(keys)
    if n < 2:
        return 0.0
    order = np.argsort(keys, kind="stable")
    again = np.zeros(n, bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    # ends of marked windows, as running coverage
    mark = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(again)
    mark[at] += 1
    mark[at + gram] -= 1
    return float((np.cumsum(mark[:-1]) > 0).sum() / len(codes))


def repeated(parts: list[str], least: int) -> float:
    """The share of characters in parts of at least so many characters that occurred before; -1 where there are too few parts to tell."""
    if len(parts) < LEAST_PARTS:
        return -1.0
    seen, again, total = set(), 0, 0
    for p in parts:
        p = p.strip().lower()
        total += len(p)
        if len(p) >= least and p in seen:
            again += len(p)
        seen.add(p)
    return again / total if total else 0.0


def measure(text: str) -> list[float]:
    """n_words and the value of every rule; a text without words has zeros."""
    words = WORDS.findall(text.lower())
    if not words:
        return [0.0] * len(MEASURES)
    ids: dict[str, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.uint64) + np.uint64(1)
    top = 0.0
    if len(words) >= 24:
        n = np.unique(gram_keys(codes, 4), return_counts=True)[1].max()
        top = min(1.0, 4 * float(n) / len(words)) if n > 1 else 0.0
    raw = text.encode("utf-8", "replace")
    squeeze = 1 - len(zlib.compress(raw, 1)) / len(raw) if len(raw) > 200 else 0.0
    return [float(len(words)), passage_share(codes), passage_share(codes, 5), repeated(SENTENCE.split(text), 20), repeated(CLAUSE.split(text), 25), repeated(re.split(r"\n\s*\n", text), 40), top, max(0.0, squeeze)]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of every vote pattern, the accuracy of every rule, and the prior, by EM.

    patterns: votes 1 (repetitive), 0 (not), -1 (abstains). Each rule has a true-positive and a true-negative rate, both held
    above one half, so that the classes keep their meaning.
    """
    if not len(patterns):
        return np.zeros(0), np.zeros((0, 2)), 0.0
    yes, no = (patterns == 1), (patterns == 0)
    prior, acc = 0.1, np.full((patterns.shape[1], 2), 0.85)
    weight = counts.astype(float)
    for _ in range(rounds):
        one = np.log(prior) + yes @ np.log(acc[:, 0]) + no @ np.log(1 - acc[:, 0])
        zero = np.log(1 - prior) + no @ np.log(acc[:, 1]) + yes @ np.log(1 - acc[:, 1])
        post = 1 / (1 + np.exp(np.clip(zero - one, -500, 500)))
        p, q = weight * post, weight * (1 - post)
        before = acc.copy()
        acc[:, 0] = (yes.T @ p + 2) / ((yes | no).T @ p + 2.5)
        acc[:, 1] = (no.T @ q + 2) / ((yes | no).T @ q + 2.5)
        acc = np.clip(acc, 0.55, 0.999)
        prior = float(np.clip(p.sum() / weight.sum(), 1e-4, 0.9))
        if np.abs(acc - before).max() < 1e-6:
            break
    return post, acc, prior


def measured(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words and the rules' values of every document, whole texts; a null text counts as empty."""
    src = documents.select(F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            found = [measure(t) for t in b.column("text").to_pylist()]
            columns = list(zip(*found)) if found else [[]] * len(MEASURES)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")} | {m: pa.array(c, pa.float64()) for m, c in zip(MEASURES, columns)})

    kind = dict(src.dtypes)["doc_id"]
    return spread(src).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} double" for m in MEASURES))


def repetition(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, the rules' values, posterior (of being repetitive) for every row.

    share is the share of words in passages of eight or more words that began earlier in the text; words are runs of letters
    without regard to case. Null and empty texts have share 0. Repeated rows are measured one by one. An empty table gives an
    empty result.
    """
    spark = documents.sparkSession
    shelf = Shelf(spark)
    vote = lambda r: F.when(F.col(r) >= RULES[r][1], 1).when((F.col(r) >= 0) & (F.col(r) <= F.lit(RULES[r][0])), 0).otherwise(-1)
    votes = shelf.keep(measured(documents, key, text).withColumns({f"v_{r}": vote(r) for r in RULES}), "votes")
    names = [f"v_{r}" for r in RULES]
    seen = votes.groupBy(*names).count().collect()  # at most 3 to the power of the number of rules
    post, _, _ = expectation_maximisation(np.array([[r[n] for n in names] for r in seen]).reshape(-1, len(names)), np.array([r["count"] for r in seen]))
    table = spark.createDataFrame([(*[r[n] for n in names], float(p)) for r, p in zip(seen, post)] or [(*[0] * len(names), 0.0)], ", ".join(f"{n} int" for n in names) + ", posterior double")
    return votes.join(F.broadcast(table), names).select("doc_id", *MEASURES, F.round("posterior", 6).alias("posterior"))
