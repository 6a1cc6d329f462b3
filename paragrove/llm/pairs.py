"""Broken prompt and response pairs.

The sentences and items of all responses are range-sorted by text, and neighbours' common prefixes show which response ends
in the beginning of a longer one. That is the first evidence of a cut; length-limit spikes and the last words add to its odds
(the truncation model). Copy, refusal, placeholder, failure-message and language rules do the rest, in the Arrow pass that
reads the responses. Languages are told apart by word likelihoods fitted on labelled rows. A pair gets at most one defect, the
first that holds in the order of DEFECTS.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragrove.llm.truncation import scored
from paragrove.runtime import Shelf, broadcast_if_small

DEFECTS = ("refusal", "empty", "error_text", "copies_question", "truncated", "other_language")

#: Words that stand for no answer, and headings that announce one.
PLACEHOLDERS = "na|none|null|nil|nan|nichts|ninguno|aucun|todo|tbd|undefined|answer|antwort|réponse|reponse|respuesta|response|output|final answer|the answer"
DECLINED = r"(?iu)refus|declin|safety|content_filter|content filter|blocked by|policy"
FAILURE = (
    r"(?isu)^\W*(?:\(?\s*vlm error\b|traceback \(most recent call last\)|https? \d{3}\b|error \d{3}\b|\d{3} (?:bad gateway|service unavailable|internal server error|gateway time)"
    r"|<!?(?:doctype )?html|connection (?:reset|refused|aborted|timed out)|(?:[a-z_]+\.)*[a-z]*(?:error|exception)\s*:|\{\s*\"error\"|upstream |request timed out|cuda out of memory|segmentation fault|fatal:|panic:)")
#: How an answer declines, in the four languages of the questions.
REFUSAL = r"(?iu)(?:" + "|".join((
    r"\bi(?:['’]m| am)? (?:can(?:['’]t|not)|won['’]t be able to|will not|won['’]t|(?:am )?not able to|(?:am )?unable to|have to decline|must decline(?: to)?|decline to|['’]d rather not|would rather not|prefer not to)\s*(?:help|assist|answer|comment|give (?:advice|guidance)|offer|provide|respond|discuss|questions?\b)",
    r"\bi (?:have to|must) decline\b", r"\bi['’]d rather not answer\b", r"\bno (?:answer|response|reply|advice) (?:will|can|may) (?:come|be)\b", r"\bi won['’]t be able to\b",
    r"\bfalls outside what i am (?:permitted|allowed)", r"\b(?:would go|goes) against my (?:usage |content )?(?:policy|guidelines|rules)", r"\bas an? (?:ai|language model)[^.]{0,40}(?:decline|cannot|can['’]t|unable)", r"\bmy (?:guidelines|rules|instructions|policies) (?:do not|don['’]t|prevent|forbid)",
    r"\bmis (?:normas|reglas|instrucciones|pautas) (?:me )?(?:impiden|prohíben|no)", r"\bmes (?:consignes|règles|instructions) (?:m['’]interdisent|m['’]empêchent|ne)", r"\bmeine (?:vorgaben|regeln|richtlinien|anweisungen) (?:lassen|erlauben|verbieten|untersagen|gestatten)",
    r"\bno (?:puedo|voy a|debo|quiero|podré) (?:ayudar|dar consejos|responder|contestar|opinar|comentar)", r"\bno me es posible (?:responder|contestar|ayudar)", r"\bprefiero no (?:responder|contestar|opinar)", r"\b(?:debo|tengo que) (?:rechazar|declinar)",
    r"\bje (?:préfère|prefere) ne pas répondre", r"\bje ne (?:peux|puis|dois|vais|saurais) pas (?:y )?(?:répondre|aider|vous aider|donner|commenter|traiter)", r"\bje ne (?:peux|puis|saurais) répondre", r"\bje ne donne pas d['’](?:avis|conseil)", r"\bje (?:dois |me vois (?:contraint|obligé) de )?(?:refuse|décline|refuser|décliner)\b", r"\bil m['’]est impossible de (?:répondre|traiter|vous aider|commenter)",
    r"\b(?:kann|darf|werde|möchte|will) ich (?:leider )?(?:dabei |dazu |das |hierzu |darauf )?(?:nicht|keine)", r"\bich (?:kann|darf|werde|möchte|will) (?:dazu|dabei|hierzu|das|darauf|diese frage|leider|hier)?\s?(?:nicht|keine) (?:helfen|beantworten|antworten|auskunft|auskünfte|ratschläge)", r"\bgebe ich (?:dazu )?keine auskunft", r"\blehne ich\b", r"\bich lehne\b", r"\bich gebe (?:dazu )?keine auskunft", r"\bmuss ich (?:leider )?ablehnen",
)) + ")"
LABELLED_ROWS = 4_096     # labelled answers that the languages are fitted on, about; a sample by hash
LABELLED_WORDS = 50_000   # words that the fitted model keeps, at most, the most frequent first
LABELLED_PRIOR = 1_000    # words of the average language that every language is given besides its own
MARGIN = 4.0              # log likelihood by which another language must win, and
MARGIN_WORD = 0.25        # for every word that the model knows
PREFIX_ODDS = 20.0        # how much likelier a cut text ends in the beginning of a longer sentence or item, inside a word
PREFIX_LENGTH = 6         # a shorter ending begins other ones by chance

#: Signs that stripping removes besides white space.
INVISIBLE = "".join(map(chr, (*range(0x20), 0x7F, 0x85, 0xA0, 0xAD, 0x1680, *range(0x2000, 0x2010), *range(0x2028, 0x2030), 0x205F, *range(0x2060, 0x2065), 0x2800, 0x3000, 0x3164, 0xFEFF))) + " "
#: Words of which a refusal has at least one.
TRIGGERS = frozenset("i i'm i’m i'd i’d i've my no prefiero debo tengo mis je j'ai il mes ich meine lehne gebe muss kann darf werde möchte outside against permitted policy model".split())
#: Words that frame a restated question.
FRAME = frozenset("q question pregunta frage you want to know asked is the ask asks vous demandez voulez savoir usted quiere saber sie möchten wissen fragen".split())
HEADING = re.compile(r"#{1,6}\s*[^\n.!?]{0,40}|\*{0,2}[^\W\d_]+(?: [^\W\d_]+){0,3}:\*{0,2}:?")
FAILED, REFUSED, NO_ANSWER = re.compile(FAILURE), re.compile(REFUSAL), re.compile(DECLINED)
SENTENCE = re.compile(r"(?<=[.!?])\s+")
WORD = re.compile(r"[^\W_]+")
NAMES = frozenset(PLACEHOLDERS.split("|"))


def is_empty(text: str) -> bool:
    """Nothing, blanks, invisible signs, marks without any letter or digit, a placeholder or a bare heading."""
    v = text.strip(INVISIBLE)
    if not any(map(str.isalnum, v)):
        return True
    return len(v) <= 200 and (" ".join(WORD.findall(v.lower().replace("/", ""))) in NAMES or HEADING.fullmatch(v) is not None)  # no name or heading is longer


def is_failure(text: str, error: str) -> bool:
    """A failure message of software: of a known form, or the record's own error."""
    v = text.strip(INVISIBLE)
    return FAILED.match(v) is not None or len(error.strip()) > 10 and v.lower() == error.strip(INVISIBLE).lower()


def is_refusal(text: str, tokens: list[str], question: str) -> bool:
    """A declining phrase in the first three sentences, or later on in a text that says little else that the question does not."""
    if TRIGGERS.isdisjoint(tokens):
        return False
    at = REFUSED.search(text)
    if at is None:
        return False
    parts = SENTENCE.split(text.strip(INVISIBLE))
    if REFUSED.search(" ".join(parts[:3])):
        return True
    asked = question_words(question)
    content = [w for s in parts if not REFUSED.search(s) for w in WORD.findall(s.lower())]
    return sum(w not in asked for w in content) <= 0.5 * len(tokens)


@lru_cache(100_000)
def question_words(question: str) -> frozenset[str]:
    return frozenset(WORD.findall(question.lower().replace("'", "").replace("’", "")))


def is_copy(answer: str, tokens: list[str], question: str) -> bool:
    """The answer only restates the question: nearly all its words are the question's, and it covers most of them."""
    q = question_words(question)
    most = (len(q) + len(FRAME)) / 9  # a tenth of the words may be others
    if len(q) < 3 or sum(w.isalnum() and w not in q and w not in FRAME for w in set(tokens)) > most:
        return False
    a = set(WORD.findall(answer.lower().replace("'", "").replace("’", "")))
    return bool(a) and len(a - q - FRAME) <= len(a) // 10 and len(a & q) >= 0.6 * len(q)


class Languages:
    """Word likelihoods per language: languages, and for every word its log likelihoods above those of an average language."""

    def __init__(self, rows: list[tuple[str, str]]):
        counts: dict[str, Counter] = {}
        for text, lang in rows:
            counts.setdefault(lang, Counter()).update(set(w for w in text.lower().split() if not w.isdigit()))
        self.names = sorted(counts)
        total, words = {lang: sum(c.values()) for lang, c in counts.items()}, Counter()
        for c in counts.values():
            words.update(c)
        kept = [w for w, n in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:LABELLED_WORDS] if n >= 2]
        self.words, every = {}, sum(words.values())
        for w in kept:
            # a language with few labelled words keeps near the average of all
            share = LABELLED_PRIOR * words[w] / every
            logs = [math.log((counts[lang][w] + share) / (total[lang] + LABELLED_PRIOR)) for lang in self.names]
            mean = sum(logs) / len(logs)
            self.words[w] = tuple(x - mean for x in logs)

    def scores(self, tokens) -> tuple[list[float], int]:
        """The log likelihood of every language, and how many words the model knows."""
        found = [x for x in map(self.words.get, tokens) if x is not None]
        return [sum(c) for c in zip(*found)] or [0.0] * len(self.names), len(found)

    def of(self, tokens) -> str | None:
        """The likeliest language; None where no word is known."""
        s, n = self.scores(tokens)
        return self.names[max(range(len(s)), key=s.__getitem__)] if n else None

    def differs(self, tokens, asked: str | None) -> tuple[str | None, bool]:
        """The likeliest language of a text, and whether it wins clearly over the one asked for."""
        s, n = self.scores(tokens)
        if not n:
            return None, False
        best = max(range(len(s)), key=s.__getitem__)
        if asked not in self.names or self.names[best] == asked:
            return self.names[best], False
        lead = s[best] - s[self.names.index(asked)]
        return self.names[best], lead >= MARGIN + MARGIN_WORD * n


def labelled_rows(runs: DataFrame, questions: DataFrame) -> list[tuple[str, str]]:
    """text, language: the questions with their language, and about LABELLED_ROWS answers, chosen by hash, with the language of their question."""
    q = questions.where("lang IS NOT NULL AND question IS NOT NULL").select("question_id", "question", F.lower(F.trim("lang")).alias("lang"))
    part = lambda df, c: df.where(F.pmod(F.xxhash64(c), F.lit(max(1, df.count() // LABELLED_ROWS))) == 0)
    answers = part(runs.select("record_id", "question_id", "answer"), "record_id").where("answer IS NOT NULL").join(broadcast_if_small(q.select("question_id", "lang").distinct()), "question_id")
    return [(r[0], r[1]) for df in (part(q, "question_id").select("question", "lang"), answers.select("answer", "lang")) for r in df.collect()]


class Rules:
    """(rule or None, language of the answer, language of the question, whether they differ clearly) of an answer, question and error."""

    def __init__(self, languages: Languages | None):
        self.languages = languages
        self.asked = lru_cache(100_000)(lambda q: languages.of(q.lower().split()))

    def __reduce__(self):
        return Rules, (self.languages,)

    def __call__(self, answer: str | None, question: str | None, error: str | None):
        answer, question, error = answer or "", question or "", error or ""
        if is_empty(answer):
            return ("refusal" if NO_ANSWER.search(error) else "empty"), None, None, False
        if is_failure(answer, error):
            return "error_text", None, None, False
        tokens = answer.lower().split()
        if is_refusal(answer, tokens, question):
            return "refusal", None, None, False
        if is_copy(answer, tokens, question):
            return "copies_question", None, None, False
        if self.languages is None:
            return None, None, None, False
        asked = self.asked(question)
        found, other = self.languages.differs(tokens, asked)
        return None, found, asked, other


def begins_longer(parts: DataFrame, shelf: Shelf) -> DataFrame:
    """part of every unfinished part that is the beginning of another one which goes on inside the word.

    parts: part, open (whether it is the unfinished end of a text); distinct. They are range-sorted; a scan keeps the chain of
    open parts that the current one begins with. Chains that reach the end of a partition meet the head of the next ones on the
    driver: one row per partition, with its first part and where others branch off from it.
    """
    ordered = parts.repartitionByRange("part").sortWithinPartitions("part")

    def run(batches):
        from pyspark import TaskContext

        where = TaskContext.get().partitionId()
        chain: list[str] = []       # open parts, each the beginning of the next and of the last part read
        hit: set[str] = set()       # those of the chain that go on inside a word
        head, shared, branches = None, 0, set()
        for b in batches:
            out = []
            for part, open_ in zip(b.column("part").to_pylist(), b.column("open").to_pylist()):
                if head is None:
                    head, shared = part, len(part)
                elif shared:
                    shared = len(os.path.commonprefix((head[:shared], part)))
                    if len(part) > shared and part[shared].isalnum():
                        branches.add(shared)
                while chain and not part.startswith(chain[-1]):
                    gone = chain.pop()
                    if gone in hit:
                        out.append(gone)
                        hit.discard(gone)
                for p in chain:
                    if part[len(p)].isalnum() and p[-1].isalnum():
                        hit.add(p)
                if open_:
                    chain.append(part)
            yield pa.RecordBatch.from_pydict({"part": pa.array(out, pa.string()), "at": pa.array([None] * len(out), pa.int32()), "head": pa.array([None] * len(out), pa.string()), "shared": pa.array([None] * len(out), pa.int32()),
                                              "branches": pa.array([None] * len(out), pa.list_(pa.int32())), "chain": pa.array([None] * len(out), pa.list_(pa.string()))})
        if head is not None:
            out = list(hit)
            yield pa.RecordBatch.from_pydict({"part": pa.array([*out, None], pa.string()), "at": pa.array([None] * len(out) + [where], pa.int32()), "head": pa.array([None] * len(out) + [head], pa.string()), "shared": pa.array([None] * len(out) + [shared], pa.int32()),
                                              "branches": pa.array([None] * len(out) + [sorted(branches)], pa.list_(pa.int32())), "chain": pa.array([None] * len(out) + [[p for p in chain if p not in hit]], pa.list_(pa.string()))})

    found = shelf.keep(ordered.mapInArrow(run, "part string, at int, head string, shared int, branches array<int>, chain array<string>"), "begins")
    edges = found.where("at IS NOT NULL").orderBy("at").collect()  # one row per partition
    across, waiting = [], []
    for e in edges:
        still = []
        for p in waiting:
            if not e.head.startswith(p) or not p:
                continue
            n = len(p)
            if p[-1].isalnum() and (len(e.head) > n and e.head[n].isalnum() or n in e.branches):
                across.append((p,))
            elif e.shared >= n:
                still.append(p)  # the whole partition begins with it, so the next may too
        waiting = still + list(e.chain)
    return found.where("part IS NOT NULL").select("part").unionByName(parts.sparkSession.createDataFrame(across, "part string")).distinct()


def broken_pairs(runs: DataFrame, questions: DataFrame | None = None, least_posterior: float = 0.5) -> DataFrame:
    """record_id, model_alias, defect (null if none), truncation (posterior), shortened, answer_lang, question_lang for every record.

    questions: question_id, question, lang, from which the languages are fitted; without it no language is told. A null answer
    is a refusal where error says that the model declined or was blocked, else empty. A null question has neither copies nor a
    language. Repeated record_ids count once, null ones are left out. An empty table gives an empty result.
    """
    shelf = Shelf(runs.sparkSession)
    languages = Languages(labelled_rows(runs, questions)) if questions is not None else None
    rows, inner = scored(runs, shelf, rules=Rules(languages), parts=True)
    rows = shelf.keep(rows, "scored")
    standing = inner.groupBy("part").agg(F.sum("inner").alias("inner"))
    ends = rows.where(f"fragment IS NOT NULL AND NOT whole AND length(fragment) >= {PREFIX_LENGTH}")
    every = standing.select("part", "inner", F.lit(False).alias("open")).unionByName(ends.groupBy(F.col("fragment").alias("part")).agg(F.lit(0).cast("bigint").alias("inner"), F.lit(True).alias("open")))
    # an ending that also stands whole inside another text is no beginning
    parts = every.groupBy("part").agg((F.max("open") & (F.sum("inner") == 0)).alias("open")).where("part <> ''")
    short = begins_longer(parts, shelf).select(F.col("part").alias("fragment"), F.lit(True).alias("shortened"))
    # an ending may be that of many records: those found are distinct, and rows without one keep out of the join
    some, none = rows.where("fragment IS NOT NULL"), rows.where("fragment IS NULL").withColumn("shortened", F.lit(False))
    joined = some.join(broadcast_if_small(short), "fragment", "left").fillna({"shortened": False}).unionByName(none)
    odds = F.col("odds") * F.when(F.col("shortened"), PREFIX_ODDS).otherwise(1.0)
    posterior = F.when(F.col("whole") | ~F.col("has_text"), 0.0).otherwise(odds / (1 + odds))
    defect = F.coalesce("rule", F.when(posterior >= least_posterior, "truncated").when(F.col("other"), "other_language"))
    return joined.select("record_id", F.nullif("source", F.lit("")).alias("model_alias"), defect.alias("defect"), posterior.alias("truncation"), "shortened", "answer_lang", "question_lang")
