"""Text cut off by field limits.

Each source's lengths are modelled by a log-normal distribution, fitted by maximum likelihood with the values at candidate
limits right-censored (expectation-maximisation). The surplus over the expected count at a limit gives the posterior that a
value there was censored. It is combined with ending evidence: how often the text's last words end an item or a text
elsewhere in the whole corpus, against how often they go on.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragrove.runtime import Shelf, broadcast_if_small, split_join, spread

BASE_RATE = 0.05   # prior of a cut away from any limit (a transfer that ended)
MARKED_RATE = 0.8   # prior where the text itself shows a cut
MOST_CENSORED = 0.98  # a text may be as long as the limit and whole

#: a full stop, question or exclamation mark, perhaps closed by quotes, brackets or emphasis
TERMINAL = r"[.!?。][\"'”’»)\]*_]*(?:\s*(?:\[[^\]]*\]|\([^()]*\)))?\s*$"
#: a cut that the text itself shows: an ellipsis at the end, perhaps with a note in brackets, a note of continuation, or half a character
CUT_MARK = r"(?i)(?:(?:…|\.\.\.)\s*(?:[\[(][^\])]{0,30}[\])]?)?|[\[(](?:cont|truncated|more)[^\])]{0,20}[\])]?|�)\s*$"
SENTENCE = re.compile(r"(?<=[.!?])\s+")
BULLET = re.compile(r"\s*(?:[-*•–]|0[.)])\s+")
LISTED = re.compile(r"^\s*(?:[-*•–]|0[.)])\s")
DIGITS = re.compile(r"\d+")
CODE = re.compile(r"[^\W_]*0[^\W_]*(?:[-‑–.][^\W_]+)*")
CUT, END = re.compile(CUT_MARK), re.compile(TERMINAL)


def _phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def fit_censored(lengths: np.ndarray, counts: np.ndarray, limits: set[int], rounds: int = 60) -> tuple[float, float, dict[int, float]]:
    """Mean and deviation of log length, and the censored share at each limit, by EM; the limits' surplus is right-censored."""
    x, n = np.log(lengths.astype(float)), counts.astype(float)
    at = np.array([int(v) in limits for v in lengths])
    share = {int(v): 0.9 for v in lengths[at]}
    mu = float(np.average(x, weights=n))
    sd = max(0.05, float(np.sqrt(np.average((x - mu) ** 2, weights=n))))
    for _ in range(rounds):
        w, first, second = n.copy(), x.copy(), x * x
        for i in np.flatnonzero(at):
            r = share[int(lengths[i])]
            a = (x[i] - mu) / sd
            tail = max(1e-12, 1 - _phi(a))
            lam = math.exp(-a * a / 2) / math.sqrt(2 * math.pi) / tail
            m1 = mu + sd * lam
            m2 = mu * mu + sd * sd + sd * lam * (x[i] + mu)
            first[i], second[i] = (1 - r) * x[i] + r * m1, (1 - r) * x[i] * x[i] + r * m2
        new = float((w * first).sum() / w.sum())
        sd2 = max(0.05, math.sqrt(max(1e-6, float((w * second).sum() / w.sum()) - new * new)))
        total = float(n.sum())
        for i in np.flatnonzero(at):
            expected = total * (_phi((math.log(lengths[i] + 0.5) - new) / sd2) - _phi((math.log(lengths[i] - 0.5) - new) / sd2))
            share[int(lengths[i])] = float(np.clip(1 - expected / n[i], 0.0, 0.999))
        done = abs(new - mu) < 1e-6 and abs(sd2 - sd) < 1e-6
        mu, sd = new, sd2
        if done:
            break
    return mu, sd, share


def candidate_limits(lengths: np.ndarray, counts: np.ndarray, least: int = 8, times: float = 5.0, reach: int = 15) -> set[int]:
    """Lengths far more frequent than those around them."""
    have = dict(zip(lengths.tolist(), counts.tolist()))
    out = set()
    for v, n in have.items():
        near = sorted(have.get(u, 0) for u in range(v - reach, v + reach + 1) if u != v)
        usual = near[len(near) // 2]
        if n >= least and n > times * max(usual, 1) + 3 * math.sqrt(usual):
            out.add(int(v))
    return out


def limit_posteriors(lengths: DataFrame) -> DataFrame:
    """source, length, censored, expected: the posterior of being cut at every candidate limit of every source.

    lengths: source, length, n (a histogram, so a hot source is as small as its number of different lengths).
    """
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        by = pdf.sort_values("length")
        x, n = by.length.to_numpy(), by.n.to_numpy()
        limits = candidate_limits(x, n)
        out = [(pdf.source.iloc[0], v, r) for v, r in (fit_censored(x, n, limits)[2].items() if limits else ())]
        return pd.DataFrame(out, columns=["source", "length", "censored"])

    return lengths.where("length > 0").groupBy("source").applyInPandas(fit, "source string, length int, censored double")


def _code(token: str) -> str:
    """A token with digits: the code or number in it as 0, so that endings of one form are counted together."""
    return CODE.sub("0", token)


def last_words(text: str) -> tuple[list[tuple[str, list[str]]], bool, bool]:
    """Every line that has words, lower case and digits as 0, with its tokens (those of list lines marked); whether the text shows a cut; whether it ends a sentence."""
    bare = CUT.sub("", text, count=1)
    lines = []
    for line in DIGITS.sub("0", bare.lower()).splitlines():
        words = line.split()
        if words:
            if "0" in line:
                words = [_code(w) if "0" in w else w for w in words]
            lines.append((line, ["•" + w for w in words] if LISTED.match(line) else words))
    return lines, len(bare) < len(text.rstrip()) or "�" in text[-2:], END.search(bare) is not None


def parts_of(lines: list[tuple[str, list[str]]], terminal: bool) -> tuple[list[str], str | None]:
    """The sentences and items of a text that stand whole, and the last one where the text ends without ending a sentence."""
    parts = [p for line, _ in lines for p in SENTENCE.split(BULLET.sub("", line, count=1).strip())]
    return (parts, None) if terminal else (parts[:-1], parts[-1])


#: Columns of a record row of passage(), then those of a count, then those of a part.
RECORD = "record_id bigint, source string, whole boolean, length int, marked boolean, terminal boolean, listed boolean, w1 string, w2 string, w3 string, rule string, other boolean, answer_lang string, question_lang string, fragment string"
COUNT = "go_on bigint, stop bigint, final bigint, part string, inner bigint"


def passage(texts: DataFrame, rules=None, parts: bool = False, flush: int = 300_000) -> DataFrame:
    """One pass over the texts (record_id, source, text, whole, question, error), with three kinds of rows.

    A record: source, whole, length, marked, terminal, listed, the last words w1, w2, w3 (w1 the last; null where the text has
    none), and what rules(text, question, error) says: rule, answer_lang, question_lang, other; a record with a rule is whole.
    fragment: the last sentence or item where the text does not end a sentence. A count (record_id null): how often w2
    followed by w1 goes on in its line, ends a line within a text, ends a text. With parts, a part: how often a sentence or
    item stands whole. Counts and parts are added up per task before the shuffle.
    """
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches):
        go_on, stop, final, inner = Counter(), Counter(), Counter(), Counter()

        def counts():
            keys, n = [*{**go_on, **stop, **final}], len(inner)
            have = {"w2": [k[0] for k in keys] + [None] * n, "w1": [k[1] for k in keys] + [None] * n, "part": [None] * len(keys) + [*inner], "inner": [None] * len(keys) + [*inner.values()]}
            have |= {name: [c[k] for k in keys] + [None] * n for name, c in (("go_on", go_on), ("stop", stop), ("final", final))}
            out = pa.RecordBatch.from_arrays([pa.array(have[f.name], f.type) if f.name in have else pa.nulls(len(keys) + n, f.type) for f in schema], schema=schema)
            go_on.clear(), stop.clear(), final.clear(), inner.clear()
            return out

        for b in batches:
            rows = []
            for key, source, text, whole, question, error in zip(*(b.column(n).to_pylist() for n in ("record_id", "source", "text", "whole", "question", "error"))):
                found = rules(text, question, error) if rules else (None, None, None, False)
                lines, marked, terminal = last_words(text) if text else ((), False, False)
                fragment, tail = None, (None, None, None)
                if lines:
                    for at, (_, words) in enumerate(lines):
                        before = ["^", *words[:-1]]
                        go_on.update(zip(before[:-1], before[1:]))
                        (final if at == len(lines) - 1 else stop)[before[-1], words[-1]] += 1
                    last = ["^", "^", *words[-3:]]
                    tail = last[-1], last[-2], last[-3]
                    if parts and found[0] is None:
                        complete, fragment = parts_of(lines, terminal)
                        inner.update(complete)
                rows.append((key, source, whole or found[0] is not None, len(text or ""), marked, terminal, bool(lines) and words[-1].startswith("•"), *tail, found[0], found[3], found[1], found[2], fragment))
            columns = dict(zip(names, zip(*rows))) if rows else {}
            yield pa.RecordBatch.from_pydict({f.name: pa.array(columns.get(f.name, [None] * len(rows)), f.type) for f in schema}, schema=schema)
            if len(go_on) + len(inner) > flush:
                yield counts()
        yield counts()

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in f"{RECORD}, {COUNT}".split(", ")])
    return spread(texts).mapInArrow(run, f"{RECORD}, {COUNT}")


def continuation_counts(rows: DataFrame) -> DataFrame:
    """key, go_on, stop, final for every last word and pair of words; keys are hashes."""
    sums = [F.sum(c).alias(c) for c in ("go_on", "stop", "final")]
    two = rows.groupBy("w2", "w1").agg(*sums)
    one = two.groupBy(F.xxhash64("w1").alias("key")).agg(*sums)
    return two.select(F.xxhash64("w2", "w1").alias("key"), "go_on", "stop", "final").unionByName(one)


def ending_probability(ends: DataFrame, counts: DataFrame, shelf: Shelf) -> DataFrame:
    """ending, n, natural: the probability that the last words (an ending: k1, k2, k3, kp1, kp2, listed) end a text of this form naturally, leaving the record itself out.

    Endings are distinct and carry the number of their records, so a last word that holds a third of all records is one row;
    endings that share a hot key meet its counts by the split of the heaviest keys.
    """
    which = ("k1", "k2", "kp1", "kp2")
    long = shelf.keep(ends.select("ending", F.explode(F.array(*[F.struct(F.lit(n).alias("which"), F.col(n).alias("key")) for n in which])).alias("x")).select("ending", "x.*"), "keys")
    used = long.groupBy("key").agg(F.count("*").alias("n")).join(counts.hint("merge"), "key", "left").fillna(0, ["go_on", "stop", "final"])
    got = split_join(long, shelf.keep(used, "used"), ["key"], "n", shelf, "hot-keys")
    pick = lambda k, c: F.max(F.when(F.col("which") == k, F.col(c))).alias(f"{k}_{c}")
    wide = got.groupBy("ending").agg(*[pick(w, c) for w in which for c in ("go_on", "stop", "final")])
    three = shelf.keep(ends.groupBy("k3").agg(F.sum("n").alias("final3"), F.count("*").alias("n")), "thirds")
    ended = split_join(ends.select("ending", "listed", "n", "k3"), three, ["k3"], "n", shelf, "hot-thirds")
    wide = wide.join(ended.select("ending", "listed", "n", "final3").hint("merge"), "ending")  # one row each
    one_out = lambda c: F.greatest(F.col(c) - 1, F.lit(0))
    prior = F.when(F.col("listed"), 0.5).otherwise(0.05)
    p1 = (F.col("k1_stop") + one_out("k1_final") + prior) / (F.col("k1_stop") + one_out("k1_final") + F.col("k1_go_on") + 1)
    p2 = (F.col("k2_stop") + one_out("k2_final") + 2 * p1) / (F.col("k2_stop") + one_out("k2_final") + F.col("k2_go_on") + 2)
    # a last word that occurs at ends alone is half a word, unless it is what usually follows the words before
    share = lambda final, before: (one_out(final) + 0.02) / (one_out(before) + 1)
    usual = F.greatest(share("k2_final", "kp1_go_on"), share("final3", "kp2_go_on"))
    lonely = F.col("k1_go_on") + F.col("k1_stop") <= 0.02 * F.col("k1_final")
    return wide.select("ending", "n", F.when(lonely, F.least(usual, F.lit(0.98))).otherwise(p2).alias("natural"))


#: What a record keeps of passage() besides its ending.
KEPT = ("source", "whole", "length", "marked", "terminal", "rule", "other", "answer_lang", "question_lang", "fragment")


def scored(records: DataFrame, shelf: Shelf, key: str = "record_id", text: str = "answer", source: str = "model_alias", rules=None, parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records with their posterior (record_id, KEPT, has_text, censored, natural, odds), and the parts table of passage().

    Repeated keys count once, by their longest text. Null keys are left out. rules, parts: see passage().
    """
    column = lambda c: F.col(c).cast("string") if c in records.columns else F.lit(None).cast("string")
    src = records.select(F.col(key).cast("bigint").alias("record_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"), F.lit(False).alias("whole"), column("question").alias("question"), column("error").alias("error")).where("record_id IS NOT NULL")
    both = shelf.keep(passage(src if rules else src.where("text IS NOT NULL"), rules, parts), "passage")
    counts = shelf.keep(continuation_counts(both.where("record_id IS NULL AND part IS NULL")), "counts")
    words = {"k1": F.xxhash64("w1"), "k2": F.xxhash64("w2", "w1"), "k3": F.xxhash64("w3", "w2", "w1"), "kp1": F.xxhash64("w2"), "kp2": F.xxhash64("w3", "w2")}
    form = F.when(F.col("w1").isNotNull() & ~F.col("terminal"), F.xxhash64("w1", "w2", "w3", "listed"))
    ends = both.where("record_id IS NOT NULL").select("record_id", *KEPT, F.col("w1").isNotNull().alias("has_text"), "listed", form.alias("ending"), *[e.alias(n) for n, e in words.items()])
    body = F.struct(*[c for c in ends.columns if c != "record_id"])
    rows = shelf.keep(ends.groupBy("record_id").agg(F.max_by(body, F.struct("length", "k2")).alias("r")).select("record_id", "r.*"), "endings")
    limits = limit_posteriors(rows.where("has_text AND NOT whole").groupBy("source", "length").agg(F.count("*").alias("n")))
    forms = shelf.keep(rows.where("ending IS NOT NULL").groupBy("ending", "listed", *words).agg(F.count("*").alias("n")), "forms")
    natural = shelf.keep(ending_probability(forms, counts, shelf), "natural")
    shelf.drop("keys", "used", "hot-keys", "thirds", "hot-thirds", "counts", "forms", *([] if parts else ["passage"]))
    slim = rows.drop("listed", *words)
    met = split_join(slim.where("ending IS NOT NULL"), natural, ["ending"], "n", shelf, "hot-endings").unionByName(slim.where("ending IS NULL").withColumn("natural", F.lit(None).cast("double")))
    joined = met.join(broadcast_if_small(limits), ["source", "length"], "left").fillna({"censored": 0.0})
    p = F.when(F.col("terminal") & ~F.col("marked"), F.lit(0.995)).when(F.col("terminal"), F.lit(0.3)).otherwise(F.coalesce("natural", F.lit(0.5)))
    p = F.greatest(F.least(F.when(F.col("marked"), p * 0.3).otherwise(p), F.lit(0.999)), F.lit(0.001))
    prior = F.greatest(F.least("censored", F.lit(MOST_CENSORED)), F.when(F.col("marked"), F.lit(MARKED_RATE)).otherwise(F.lit(BASE_RATE)))
    out = joined.select("record_id", *KEPT, "has_text", "censored", p.alias("natural"), (prior / (1 - prior) * (1 - p) / p).alias("odds"))
    return out, both.where("part IS NOT NULL").select("part", "inner")  # without parts there is nothing to read


def truncated(records: DataFrame, key: str = "record_id", text: str = "answer", source: str = "model_alias", rules=None) -> DataFrame:
    """record_id, source, length, censored, natural, posterior for every text that is neither null nor blank.

    posterior is the probability that the text was cut. rules(text, question, error): texts for which its first value is not
    None are known to be whole (they count in the statistics, and get posterior 0). Repeated keys count once, by their longest
    text. A null source is a source of its own. An empty table gives an empty result.
    """
    rows, _ = scored(records, Shelf(records.sparkSession), key, text, source, rules)
    posterior = F.when(F.col("whole"), 0.0).otherwise(F.col("odds") / (1 + F.col("odds")))
    return rows.where("has_text").select("record_id", "source", "length", "censored", "natural", posterior.alias("posterior"))


def truncation_rates(scored: DataFrame) -> DataFrame:
    """source, n_texts, n_truncated, share: how often each source truncates."""
    return scored.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum((F.col("posterior") >= 0.5).cast("bigint")).alias("n_truncated")).withColumn("share", F.round(F.col("n_truncated") / F.col("n_texts"), 6))
