"""Noise in text from scanned pages.

The vocabulary has two parts. The frequent words, at least RARE of all tokens and so at most 1 / RARE of them however large
the corpus is, are shared as a trie: for a word outside, the channel model of scanner confusions runs along it as a weighted
automaton, which retrieves every frequent word of an accepted cost. All rarer words stay a table: they are joined by what a
word and its reading have in common, which leaves out none of them, and so are the halves of broken words. RARE decides how a
reading is searched, not whether it is found. All readings are ranked by cost, by frequency and by their neighbours in the
text. Page furniture is removed,
broken words are joined where the joined word is known, and lines are reflowed into paragraphs. Ids, codes and numbers are
left as they are.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragrove.runtime import Shelf, broadcast_if_small, spread

RARE = 1e-5         # least share of all tokens of a vocabulary word
LEAST_COUNT = 4     # least count of a vocabulary word in a small corpus
RATIO = 20          # a misread word's reading must be so many times as frequent
MOST_COST = 1.3     # of any reading: one other letter and a known confusion, or four known confusions

#: What scanners read (left) for what was printed (right).
CONFUSIONS = (
    ("rri", "m"), ("rn", "m"), ("ri", "n"), ("nn", "m"), ("ii", "u"), ("ll", "u"), ("cl", "d"), ("li", "h"), ("vv", "w"), ("iii", "m"), ("in", "m"), ("ln", "m"), ("tl", "d"), ("ni", "m"),
    ("1", "l"), ("1", "i"), ("i", "l"), ("l", "i"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("j", "i"), ("0", "o"), ("o", "c"), ("c", "o"), ("5", "s"), ("$", "s"), ("9", "g"), ("q", "g"), ("8", "b"), ("6", "b"), ("3", "e"), ("2", "z"), ("@", "a"), ("4", "a"), ("7", "t"),
    ("c", "e"), ("e", "c"), ("o", "e"), ("e", "o"), ("a", "o"), ("o", "a"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("r", "n"), ("n", "r"), ("u", "n"), ("n", "u"), ("v", "u"), ("u", "v"), ("v", "y"), ("y", "v"), ("h", "n"), ("n", "h"), ("m", "rn"), ("d", "cl"), ("t", "l"), ("l", "t"), ("g", "q"), ("s", "5"))
SWAPPED: dict[str, tuple[str, ...]] = {}
PRINTED: dict[str, tuple[str, ...]] = {}  # the other way round, for words of letters
for _seen, _meant in CONFUSIONS:
    SWAPPED[_seen] = (*SWAPPED.get(_seen, ()), _meant)
    if _seen.isalpha() and _meant.isalpha():
        PRINTED[_meant] = (*PRINTED.get(_meant, ()), _seen)
#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans("асеорхуіјѕгԁһνοιτκρυΑВЕЅІЈКМНОРСТХΒΕΗΙΚΜΝΟΡΤΧΖ", "aceopxyijsrdhvoitkpuABESIJKMHOPCTXBEHIKMNOPTXZ")
SYMBOLS = str.maketrans({"@": "a", "!": "i", "|": "l", "$": "s", "0": "o", "1": "l", "5": "s", "9": "g", "8": "b", "6": "b", "3": "e", "2": "z", "4": "a", "7": "t"})

EDGE = re.compile(r"^[^\w]+|[^\w]+$")
LETTERS = re.compile(r"^[^\W\d_]+$")
WORDLIKE = re.compile(r"^[^\W\d_]+(?:['’-][^\W\d_]+)*$")
#: an id, code, number, or measure: never touched
CODE = re.compile(r"^(?:[A-Z]{1,3}\d+[\-‐‑‒–—]\d+[A-Za-z]{0,2}|\d+[A-Za-z]{0,2}[.\-‐‑‒–—]\d*[A-Za-z]?|[\d.,:/%°$€£-]+|\d+(?:st|nd|rd|th|mm|cm|m|km|ft|in|h|x)?|[A-Z]{2,}\d{3,}|[A-Z]?\d+[A-Z]?)$")
MIXED = re.compile(r"[^\W\d_]")
BAD_NUMBER = re.compile(r"^(?=.*\d)\d*[OoIlZSBQ|]+\d*$")

STUCK = re.compile(r"^([^\W\d_]{3,})(\d+[A-Z]{1,2}|\d+[A-Za-z]{0,2}[.\-‐‑‒–—]\d+[A-Za-z]?)$")

BREAK = r"(?:[­¬][^\S\n]*\r?\n?[^\S\n]*|-[^\S\n]*\r?\n\s*|-[ \t]+)"
HYPHEN = re.compile(r"([^\W\d_]+)" + BREAK + r"(?=([^\W\d_]+))")
SOFT = re.compile(r"[^\W\d_][­¬]\s*[^\W\d_]")
SPACED = re.compile(r"(?<![^\s(\[“\"'«])(?:[^\W\d_]\s){3,}[^\W\d_](?![^\s.,;:)\]”\"'»?!])")
MANUAL = r"[A-Z]{2,}\d{3,}"
MANUAL_ID = re.compile(MANUAL)
FURNITURE = re.compile(
    r"\f[^\S\n]*(?:[A-Z][\w’'-]*[^\S\n]+|[A-Z][\w’'-]*\n(?=[A-Z]))*?(?:[A-Z][\w’'-]*\s{2,})?\d{1,4}[^\S\n]*(?=\n|$)"
    r"|\f"
    r"|\[\s*" + MANUAL + r"\s+p\.\s*\d+\s*\]"
    r"|(?<!\S)(?:\d{1,4}\s+)?" + MANUAL + r"\s+(?:Edition|EDITION|Revision|REVISION|Rev\.|Ed\.|Vol\.|Volume)\s*\d+(?!\S)"
    r"|(?<!\S)Pg\.\s*\d+\s*/\s*\d+(?!\S)"
    r"|(?<!\S)Sect\.\s*\w+\.\d+\s+to\s+\w+\.\d+(?!\S)"
    r"|(?<!\S)(?:CHAPTER|PART|SECTION)\s+\d+[A-Z]?\.(?:\s+[A-Z][A-Z’'&-]+){1,8}(?:\s*\n\s*\d{1,4}(?=\s*(?:\n|$)))?"
    r"|(?:^|(?<=\n))[^\S\n]*(?:Page\s+\d{1,4}|-\s*\d{1,4}\s*-)[^\S\n]*(?=\n|$)")
NUMBER_LINE = re.compile(r"(?:(?<=\n)|^)[^\S\n]*(\d{1,4})[^\S\n]*(?=\n|$)")
#: a number whose last digit reads as a letter, and the word before it; after these words it is a chapter
NUMBER_READ = re.compile(r"(\S+)(\s+)(\d+[ZOIQSB])(?![\w‐-–-])")
HEADS = frozenset("chapter chapters part parts section sections figure table and or to through".split())


def number_lines(text: str) -> list[tuple[int, int]]:
    """Spans of lines with a page number alone: a wrapped line would have taken the next word too."""
    if "\n" not in text:
        return []
    lines = re.split(r"[\n\f]", text)
    width = max(map(len, lines))
    out = []
    for m in NUMBER_LINE.finditer(text):
        rest = text[m.end() + 1:].split(None, 1)
        before = text[:m.start()].rstrip("\n").rsplit("\n", 1)[-1]
        fits = not rest or len(m[1]) + 1 + len(rest[0]) <= width
        fits_before = not before.strip() or len(before) + 1 + len(m[1]) <= width
        if (fits or fits_before) and width > 12 and "|" not in text:
            out.append(m.span())
    return out


def core(token: str) -> str:
    """A token without the punctuation around it."""
    return EDGE.sub("", token)


class Automaton:
    """The words within `edits` of one word: bit i of state e means that i letters of the word are matched with e edits."""

    def __init__(self, word: str, edits: int):
        self.final, self.full = 1 << len(word), (1 << (len(word) + 1)) - 1
        self.letters: dict[str, int] = {}
        for i, c in enumerate(word):
            self.letters[c] = self.letters.get(c, 0) | 1 << i
        self.start = tuple((1 << (e + 1)) - 1 & self.full for e in range(edits + 1))

    def step(self, state: tuple[int, ...], letter: str) -> tuple[int, ...]:
        hit, out, below = self.letters.get(letter, 0), [], 0
        for e, s in enumerate(state):
            now = (s & hit) << 1
            if e:
                now |= state[e - 1] << 1 | state[e - 1] | out[e - 1] << 1
            out.append(now & self.full)
        return tuple(out)

    def accepts(self, state: tuple[int, ...]) -> bool:
        return any(s & self.final for s in state)


class Trie:
    """A vocabulary with counts."""

    def __init__(self, words: dict[str, int]):
        self.root: dict = {}
        for w, n in words.items():
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = (w, n)

    def within(self, word: str, edits: int) -> list[tuple[str, int]]:
        """Every word of the vocabulary within so many edits, with its count: the intersection of automaton and trie."""
        auto = Automaton(word, edits)
        found, stack = [], [(self.root, auto.start)]
        while stack:
            node, state = stack.pop()
            for letter, child in node.items():
                if letter == "":
                    if auto.accepts(state):
                        found.append(child)
                    continue
                after = auto.step(state, letter)
                if any(after):
                    stack.append((child, after))
        return found

    def meant(self, word: str) -> list[tuple[str, int, float]]:
        """Every word of the vocabulary that `word` may be read for at MOST_COST at most, with its count and channel_cost."""
        moves = [[(word[i], i + 1, 0.0), *((t, i + a, 0.3) for a in (1, 2, 3) if i + a <= len(word) for t in SWAPPED.get(word[i:i + a], ()))] for i in range(len(word))]
        found: dict[str, tuple[str, int, float]] = {}
        stack = [(self.root, 0, 0.0)]
        while stack:
            node, i, cost = stack.pop()
            if i == len(word):
                if "" in node and cost < found.get(node[""][0], ("", 0, math.inf))[2]:
                    found[node[""][0]] = (*node[""], cost)
                continue
            for letters, j, more in moves[i]:
                child = node if cost + more <= MOST_COST else None
                for c in letters:
                    child = child and child.get(c)
                if child:
                    stack.append((child, j, cost + more))
            if cost + 1 <= MOST_COST:
                stack += [(child, i + 1, cost + 1) for letter, child in node.items() if letter]
        return list(found.values())


def channel_cost(seen: str, meant: str) -> float:
    """Least cost of reading `seen` for `meant`: 0.3 for a known confusion, 1 for another letter, 1.5 for a letter lost or added."""
    inf, n, m = math.inf, len(seen), len(meant)
    best = [[inf] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            b = best[i][j]
            if b == inf:
                continue
            if i < n and j < m:
                c = b + (0 if seen[i] == meant[j] else 1)
                best[i + 1][j + 1] = min(best[i + 1][j + 1], c)
            if i < n:
                best[i + 1][j] = min(best[i + 1][j], b + 1.5)
            if j < m:
                best[i][j + 1] = min(best[i][j + 1], b + 1.5)
            for a in (1, 2, 3):
                for t in SWAPPED.get(seen[i:i + a], ()) if i + a <= n else ():
                    if meant.startswith(t, j):
                        best[i + a][j + len(t)] = min(best[i + a][j + len(t)], b + 0.3)
    return best[n][m]


def accepted(word: str, count: int, reading: str, n: int, cost: float) -> bool:
    """Whether a word seen `count` times is misread for `reading`, seen n times: by known confusions alone, or with one other letter against a very frequent word.

    Short words bear fewer confusions: one letter of up to three, two parts of four letters; longer ones three.
    """
    if word == reading or n < RATIO * count:
        return False
    if len(word) <= 3:
        return cost <= 0.3 and len(reading) == len(word)
    return cost <= (0.6 if len(word) == 4 else 0.9) or (cost <= MOST_COST and n >= 10 * RATIO * count and len(word) >= 5)


def readings(word: str, count: int, trie: Trie) -> list[tuple[float, int, str]]:
    """(cost, count, reading) of all words of the vocabulary that `word` may have been printed as."""
    return [(c, n, w) for w, n, c in trie.meant(word) if accepted(word, count, w, n, c)]


def plain(token: str) -> str:
    """Homoglyphs and ligatures as Latin letters."""
    return unicodedata.normalize("NFKC", token).translate(HOMOGLYPHS)


def confusable(word: str, most: int = 2, swaps: dict[str, tuple[str, ...]] = SWAPPED) -> set[str]:
    """The words that `word` may stand for by up to `most` known confusions; with PRINTED, the words that may stand for it."""
    out, edge = set(), {("", word)}  # what is done and the rest: no part is read twice
    for _ in range(most):
        edge = {(done + rest[:i] + t, rest[i + n:]) for done, rest in edge for i in range(len(rest)) for n in (1, 2, 3) if i + n <= len(rest) for t in swaps.get(rest[i:i + n], ())}
        out |= {done + rest for done, rest in edge}
    return {w for w in out if w != word and LETTERS.match(w)}


#: Four confusions, each in two neighbouring parts at most, leave one of nine parts as it is. It moves by the letters that confusions before it add or take.
PART, PARTS = 4, 9
LONG, MOVED = PART * PARTS, range(-8, 5)


def masked(word: str) -> set[str]:
    """The word with any one letter hidden."""
    return {word[:i] + "*" + word[i + 1:] for i in range(len(word))}


def seen_keys(word: str, count: int) -> set[str]:
    """Of a word as it was read; one of them is among printed_keys of every accepted reading."""
    if len(word) >= LONG:
        return {f"{i} {word[i * PART:(i + 1) * PART]}" for i in range(PARTS)}
    return {word} | confusable(word, 1) | (masked(word) if len(word) >= 5 else set())


def printed_keys(word: str, count: int) -> set[str]:
    """Of a word of the vocabulary: up to three confusions, as seen_keys has the fourth, or one and another letter. Of long words, the parts that stay."""
    out: set[str] = set()
    often = count >= 10 * RATIO
    if len(word) < LONG + MOVED[-1]:
        out = {word} | confusable(word, 3 if often else 2, PRINTED)
        if often:
            out |= {m for w in {word} | confusable(word, 1, PRINTED) for m in masked(w)}
    if len(word) >= LONG + MOVED[0]:
        out |= {f"{i} {word[i * PART + d:(i + 1) * PART + d]}" for i in range(PARTS) for d in MOVED if i * PART + d >= 0}
    return out


def inspect(text: str, known: set[str], words: dict[str, int]) -> tuple[list[str], list[str], list[str]]:
    """Reasons that the text is noisy by its form, the words outside the vocabulary, and words joined from halves that are none."""
    tokens = text.split()
    odd = set(tokens).difference(known)
    lines, soft = "\n" in text or "\r" in text, "\xad" in text or "¬" in text
    hyphen = soft or "- " in text or "-\n" in text or "-\r" in text
    single = sum(len(t) == 1 for t in tokens) > 3
    # the patterns of page furniture are only tried where a part of one stands; its tokens may all be known ones
    part = lines or any(h in text for h in ("\f", "Pg.", "Sect.", "CHAPTER", "PART", "SECTION", "Page ")) or MANUAL_ID.search(text) is not None
    if not odd and not (hyphen or single or part):
        return [], [], []
    reasons = []
    if part and (FURNITURE.search(text) or number_lines(text)):
        reasons.append("furniture")
        text = strip_furniture(text)
        odd = set(text.split()).difference(known)
    spaced = [m[0] for m in SPACED.finditer(text) if re.search("[a-z]", m[0])] if single else []
    if spaced or soft and SOFT.search(text):
        reasons.append("broken")
    joined = []
    if hyphen:
        for m in HYPHEN.finditer(text):
            left, right = m[1].lower(), m[2].lower()
            if left + right in words:
                reasons.append("broken")
            elif left not in words and right not in words:
                joined.append(left + right)
        text = HYPHEN.sub(lambda m: m[1] if (m[1] + m[2]).lower() in words or not (m[1].lower() in words or m[2].lower() in words) else m[1] + " ", text)
    if spaced or hyphen:
        odd = set((SPACED.sub(" ", text) if spaced else text).split()).difference(known)
    out = []
    for token in odd:
        c = core(token)
        if not c or CODE.match(c) and not BAD_NUMBER.match(c):
            continue
        stuck = STUCK.match(c)
        if stuck and (stuck[1].lower() in words or stuck[1].lower() in HEADS) and CODE.match(stuck[2]):
            continue  # an id without its blank
        flat = plain(c)
        if flat != c and MIXED.search(flat) and c.translate(HOMOGLYPHS) != c and re.search(r"[A-Za-z]", c):
            reasons.append("misread")
        elif flat != c and re.search("[ﬀ-ﬆ]", c):
            reasons.append("misread")
        elif BAD_NUMBER.match(c) and len(c) > 1 and not re.match(r"^\d+[A-Z]$", c):
            reasons.append("misread")
        elif re.match(r"^\d+[ZOIQSB]$", c) and any(m[3] == c and m[1].lower() not in HEADS for m in NUMBER_READ.finditer(text)):
            reasons.append("misread")
        elif LETTERS.match(c):
            low = c.lower()
            if low not in words:
                out.append(low)
            elif re.search(r"[a-z]I{1,2}|[a-z][A-Z]{1,2}$", c) and c.lower().replace("i", "l") != c.lower():
                out.append(low)
        elif WORDLIKE.match(c):
            out += [p for p in re.split(r"['’-]", c.lower()) if len(p) > 2 and p not in words]
        else:
            # letters with digits or signs inside: noise if the letters meant make a known word, else a candidate
            parts = [p for p in re.split(r"[/,;:()\[\]]+", c) if not CODE.match(p)]
            for part in [q for p in parts for q in re.split(r"[-‑–—]+", p)]:
                if CODE.match(part) or not re.search(r"[^\W\d_]", part) or LETTERS.match(part):
                    if LETTERS.match(part) and len(part) > 2 and part.lower() not in words:
                        out.append(part.lower())
                    continue
                meant = plain(part).translate(SYMBOLS).lower()
                if LETTERS.match(meant) and len(meant) >= 2 and re.search(r"[a-z]", part):
                    reasons.append("misread") if meant in words or sum(x.isalpha() for x in part) >= 3 else out.append(meant)
    return list(dict.fromkeys(reasons)), list(dict.fromkeys(out)), list(dict.fromkeys(joined))


def strip_furniture(text: str) -> str:
    """The text without page heads, feet and numbers."""
    for a, b in reversed(number_lines(text)):
        text = text[:a] + "\0" + text[b:]
    text = FURNITURE.sub(lambda m: "\n\0" if m[0].startswith("\f") else "\0", text)
    # a paragraph break beside the furniture stays only after the end of a sentence
    return re.sub(r"(?:\s*\0)+\s*", lambda m: ("\n\n" if m[0].count("\n") > 2 and re.search(r"[.!?:]$", text[:m.start()]) else "\n" if "\n" in m[0] else " "), text).strip("\n")


class Lexicon:
    """Token statistics of a corpus: table (text, any keys) -> vocabulary, known raw tokens, counts of every word."""

    def __init__(self, texts: DataFrame, shelf: Shelf):
        spark = texts.sparkSession
        raw = texts.select(F.explode(F.split("text", r"\s+")).alias("t")).where("t <> ''").groupBy("t").agg(F.count("*").alias("n"))
        raw = shelf.keep(raw, "tokens")
        total = raw.agg(F.sum("n")).head()[0] or 0
        least = max(LEAST_COUNT, math.ceil(total * RARE))
        # halves of broken words are no words; parts of compounds are
        whole = raw.where(~F.col("t").rlike(r"\p{L}[-\x{ad}¬]$"))
        word = F.explode(F.split(F.lower(F.regexp_replace("t", r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")), r"(?<=\p{L})['’-](?=\p{L})"))
        self.words = shelf.keep(whole.select(word.alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n")), "words")
        # at most total / least rows each
        frequent = {r.word: r.n for r in self.words.where((F.col("n") >= least) & F.col("word").rlike(r"^\p{L}+$")).collect()}
        tokens = [r.t for r in raw.where(F.col("n") >= least).select("t").collect()]
        shared = spark.sparkContext.broadcast(frequent)

        def impostors(batches):
            trie = Trie(shared.value)
            for b in batches:
                rows = [w for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()) if any(c <= 0.6 and m >= 3 * RATIO * n for c, m, _ in readings(w, n, trie))]
                yield pa.RecordBatch.from_pydict({"word": pa.array(rows, pa.string())})

        listed = spark.createDataFrame(list(frequent.items()) or [("", 0)], "word string, n bigint").repartition(spark.sparkContext.defaultParallelism)
        # frequent misreadings of far more frequent words are no vocabulary
        for r in listed.mapInArrow(impostors, "word string").collect():
            frequent.pop(r.word, None)
        for w in [w for w in frequent if plain(w) != w and plain(w) in frequent]:
            del frequent[w]
        self.vocabulary = frequent
        keep = set()
        for t in tokens:
            c = core(t)
            if (CODE.match(c) and not BAD_NUMBER.match(c)) or not c or (WORDLIKE.match(c) and not re.search(r"[a-z][A-Z]", c) and plain(c) == c and all(p in frequent for p in re.split(r"['’-]", c.lower()))):
                keep.add(t)
        self.known = keep
        shelf.drop("tokens")


def sources(chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """source_table, record_key, text of both tables."""
    a = chunks.select(F.lit("chunks").alias("source_table"), F.col("chunk_id").alias("record_key"), "text")
    b = figures.select(F.lit("figures").alias("source_table"), F.col("figure_key").cast("string").alias("record_key"), F.col("caption").alias("text"))
    return a.unionByName(b).where("text IS NOT NULL AND record_key IS NOT NULL")


def evidence(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """source_table, record_key, reason, word, whole: noise by form (word null), and words outside the vocabulary (reason null), whole where they are joined from two halves."""
    shared = texts.sparkSession.sparkContext.broadcast((lexicon.known, lexicon.vocabulary))

    def run(batches):
        known, words = shared.value
        for b in batches:
            out = []
            for s, k, t in zip(b.column("source_table").to_pylist(), b.column("record_key").to_pylist(), b.column("text").to_pylist()):
                reasons, odd, joined = inspect(t, known, words)
                out += [(s, k, r, None, False) for r in reasons] + [(s, k, None, w, False) for w in odd] + [(s, k, None, w, True) for w in joined]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    schema = pa.schema([*[(c, pa.string()) for c in ("source_table", "record_key", "reason", "word")], ("whole", pa.bool_())])
    return spread(texts).mapInArrow(run, "source_table string, record_key string, reason string, word string, whole boolean")


def keyed(words: DataFrame, keys, word: str, count: str) -> DataFrame:
    """key, word, count: a row for every key of a word (columns word, n)."""
    schema = pa.schema([("key", pa.string()), (word, pa.string()), (count, pa.int64())])

    def run(batches):
        for b in batches:
            out = [], [], []
            for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
                mine = keys(w, n)
                for column, values in zip(out, (mine, [w] * len(mine), [n] * len(mine))):
                    column.extend(values)
                if len(out[0]) >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                    out = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    # a word costs a search: spread them, however few bytes they are
    return words.select("word", "n").repartition(words.sparkSession.sparkContext.defaultParallelism, "word").mapInArrow(run, f"key string, {word} string, {count} bigint")


def corrections(odd: DataFrame, lexicon: Lexicon, shelf: Shelf) -> DataFrame:
    """word, options (array of cost, n, reading) for every distinct word that has a reading: all of them, best first.

    Frequent readings come from the trie. Every rarer word that is accepted as a reading shares a key with the word read, and
    the pairs of a key are checked by their cost. Readings that are themselves misread for far more frequent words count only
    where a word has no other.
    """
    spark = odd.sparkSession
    shared, cores = spark.sparkContext.broadcast(lexicon.vocabulary), spark.sparkContext.defaultParallelism
    counted = shelf.keep(odd.select("word").distinct().join(lexicon.words, "word", "left").select("word", F.coalesce("n", F.lit(1)).alias("n")), "odd-words")
    schema = pa.schema([("word", pa.string()), ("seen", pa.int64()), ("cost", pa.float64()), ("n", pa.int64()), ("reading", pa.string())])
    ddl = "word string, seen bigint, cost double, n bigint, reading string"

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 5, schema)], schema=schema)

    def search(batches):
        trie = None
        for b in batches:
            trie = trie or Trie(shared.value)
            yield batch([(w, n, *r) for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()) for r in readings(w, n, trie)])

    def check(batches):
        for b in batches:
            rows = ((w, k, channel_cost(w, r), n, r) for w, k, r, n in zip(*(b.column(c).to_pylist() for c in ("word", "seen", "reading", "n"))))
            yield batch([(w, k, c, n, r) for w, k, c, n, r in rows if accepted(w, k, r, n, c)])

    frequent = counted.repartition(cores, "word").mapInArrow(search, ddl)
    listed = spark.createDataFrame([(w,) for w in lexicon.vocabulary] or [("",)], "word string")  # at most 1 / RARE
    rarer = lexicon.words.where((F.col("n") >= RATIO) & F.col("word").rlike(r"^\p{L}+$")).join(F.broadcast(listed), "word", "left_anti")
    pairs = keyed(counted, seen_keys, "word", "seen").join(keyed(rarer, printed_keys, "reading", "n").hint("merge"), "key")
    pairs = pairs.where((F.col("n") >= RATIO * F.col("seen")) & (F.col("word") != F.col("reading"))).select("word", "seen", "reading", "n").distinct()
    found = shelf.keep(frequent.unionByName(pairs.mapInArrow(check, ddl)), "readings")
    # as Lexicon leaves them out of the frequent words
    misread = found.where((F.col("cost") <= 0.6) & (F.col("n") >= 3 * RATIO * F.col("seen"))).select(F.col("word").alias("reading"), F.lit(True).alias("misread")).distinct()
    rank = F.struct(F.coalesce("misread", F.lit(False)).alias("misread"), (F.col("cost") - 0.05 * F.log("n")).alias("rank"), "reading", "cost", "n")
    # at most as many as the channel allows for the word
    ranked = found.join(misread.hint("merge"), "reading", "left").groupBy("word").agg(F.array_sort(F.collect_list(rank)).alias("o"))
    kept = F.filter("o", lambda x: x["misread"] == F.col("o")[0]["misread"])
    return ranked.select("word", F.transform(kept, lambda x: F.struct(x["cost"].alias("cost"), x["n"].alias("n"), x["reading"].alias("reading"))).alias("options"))


def noisy(chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """source_table, record_key, reason ('broken', 'misread', 'furniture') for every noisy chunk text and caption.

    Repeated rows of a key count once. Null texts and keys are left out; blank texts are clean; empty tables give an empty
    result. Spelling of ids, paragraph breaks and table rows alone are no noise.
    """
    shelf = Shelf(chunks.sparkSession)
    texts = sources(chunks, figures)
    lexicon = Lexicon(texts, shelf)
    seen = shelf.keep(evidence(texts, lexicon), "evidence")
    odd = seen.where("word IS NOT NULL")
    fixes = shelf.keep(corrections(odd, lexicon, shelf), "fixes")
    shelf.drop("odd-words", "readings")
    record = ["source_table", "record_key"]
    misread = odd.join(broadcast_if_small(fixes.select("word")), "word", "left_semi").select(*record, F.lit("misread").alias("reason"))
    broken = odd.where("whole").join(lexicon.words.where(F.col("n") >= LEAST_COUNT).select("word").hint("merge"), "word", "left_semi").select(*record, F.lit("broken").alias("reason"))
    return seen.where("reason IS NOT NULL").select(*record, "reason").unionByName(misread).unionByName(broken).distinct()


LETTER_FOR_DIGIT = str.maketrans({"O": "0", "o": "0", "Q": "0", "I": "1", "l": "1", "|": "1", "Z": "2", "S": "5", "B": "8"})
TABLE_OR_LIST = re.compile(r"^\s*(?:[-*•–]\s|\d+[.)]\s)|\|")


def _cased(like: str, word: str) -> str:
    if like.isupper() and len(like) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def repair_token(token: str, words: dict[str, int], fixes: dict[str, str]) -> str:
    """A token with its misread letters replaced; ids, codes and unknown words stay."""
    c = core(token)
    if not c or (CODE.match(c) and not BAD_NUMBER.match(c)):
        return token
    stuck = STUCK.match(c)
    if stuck and (stuck[1].lower() in words or stuck[1].lower() in HEADS) and CODE.match(stuck[2]):
        return token.replace(c, f"{stuck[1]} {stuck[2]}", 1)
    out = c
    if re.match(r"^\d*[OIlZSBQ|]+\d+$|^\d+[lo|]+\d*$", c):
        out = c.translate(LETTER_FOR_DIGIT)
    else:
        flat = plain(c)
        for meant in (flat, flat.translate(SYMBOLS), flat.translate(str.maketrans("1!|0", "iiio"))):
            low = meant.lower()
            if low in words or low in fixes:
                out = _cased(flat if flat[:1].isalpha() else meant, low if low in words else fixes[low])
                break
        else:
            if re.search(r"['’-]", c) and WORDLIKE.match(flat):
                out = re.sub(r"[^\W\d_]+", lambda m: _cased(m[0], fixes.get(m[0].lower(), m[0].lower())) if m[0].lower() in fixes else m[0], flat)
    return token.replace(c, out, 1)


def repair_text(text: str, known: set[str], words: dict[str, int], fixes: dict[str, str]) -> str:
    """The text without page furniture, with broken words joined, misread words replaced, and lines reflowed into paragraphs.

    Paragraph breaks, table rows and list lines stay lines of their own.
    """
    text = strip_furniture(text.replace("\r\n", "\n").replace("\r", "\n"))
    text = re.sub(r"(?<=[^\W\d_])[­¬]\s*(?=[^\W\d_])", "", text)

    def joined(m):
        left, right = m[1].lower(), m[2].lower()
        if left + right in words or left + right in fixes or not (left in words or right in words):
            return m[1]
        return m[1] + "-" if "\n" in m[0] else m[0]

    text = HYPHEN.sub(joined, text)
    text = NUMBER_READ.sub(lambda m: m[0] if m[1].lower() in HEADS else m[1] + m[2] + m[3].translate(LETTER_FOR_DIGIT), text)
    text = SPACED.sub(lambda m: re.sub(r"\s", "", m[0]) if re.search("[a-z]", m[0]) else m[0], text)
    out = []
    for paragraph in re.split(r"\n[^\S\n]*\n\s*", text):
        lines: list[str] = []
        for line in paragraph.split("\n"):
            fixed = " ".join(t if t in known else repair_token(t, words, fixes) for t in line.split())
            if not fixed:
                continue
            if lines and not TABLE_OR_LIST.search(line) and not ("|" in lines[-1]):
                lines[-1] += " " + fixed
            else:
                lines.append(fixed)
        if lines:
            out.append("\n".join(lines))
    return "\n\n".join(out)


def _neighbours(text: str, wanted: set[str]) -> list[tuple[str, str, str]]:
    tokens = [core(t).lower() for t in text.split()]
    return [(w, tokens[i - 1] if i else "^", tokens[i + 1] if i + 1 < len(tokens) else "$") for i, w in enumerate(tokens) if w in wanted]


def chosen(texts: DataFrame, seen: DataFrame, fixes: DataFrame, shelf: Shelf) -> DataFrame:
    """source_table, record_key, word, reading: the reading of every word outside the vocabulary, ranked with its neighbours.

    A word of which another reading costs about the same as the best takes the one that stands more often between the same
    neighbours in the corpus; other words take the best reading.
    """
    close = F.size(F.filter("options", lambda o: o["cost"] - F.col("options")[0]["cost"] <= 0.35)) > 1
    plain_fix = fixes.where(~close).select("word", F.col("options")[0]["reading"].alias("reading"))
    odd = seen.where("word IS NOT NULL").select("source_table", "record_key", "word").distinct()
    sure = odd.join(broadcast_if_small(plain_fix), "word")
    unsure = shelf.keep(odd.join(broadcast_if_small(fixes.where(close)), "word"), "unsure")
    rows = unsure.groupBy("source_table", "record_key").agg(F.collect_set("word").alias("wanted")).join(texts, ["source_table", "record_key"])

    def around(batches):
        for b in batches:
            out = [(s, k, *n) for s, k, w, t in zip(*(b.column(c).to_pylist() for c in ("source_table", "record_key", "wanted", "text"))) for n in _neighbours(t, set(w))]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=pa.schema([(n, pa.string()) for n in names]))

    names = ("source_table", "record_key", "word", "before", "after")
    spots = rows.mapInArrow(around, ", ".join(f"{n} string" for n in names)).dropDuplicates(["source_table", "record_key", "word"])
    options = unsure.join(spots, ["source_table", "record_key", "word"], "left").select("source_table", "record_key", "word", F.coalesce("before", F.lit("^")).alias("before"), F.coalesce("after", F.lit("$")).alias("after"), F.explode("options").alias("o"))
    options = shelf.keep(options.select("source_table", "record_key", "word", "o.*", F.xxhash64("before", "o.reading").alias("kb"), F.xxhash64("o.reading", "after").alias("ka")), "options")
    need = options.select(F.explode(F.array("kb", "ka")).alias("key")).distinct()
    tokens = F.transform(F.split("text", r"\s+"), lambda t: F.lower(F.regexp_replace(t, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")))
    pairs = texts.select(tokens.alias("t")).where("size(t) > 1").select(F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.xxhash64(F.col("t")[i - 1], F.col("t")[i]))).alias("key"))
    counts = pairs.join(broadcast_if_small(need), "key", "left_semi").groupBy("key").agg(F.count("*").alias("c"))
    counts = shelf.keep(counts, "bigrams")
    ranked = options.join(broadcast_if_small(counts.select(F.col("key").alias("kb"), F.col("c").alias("cb"))), "kb", "left").join(broadcast_if_small(counts.select(F.col("key").alias("ka"), F.col("c").alias("ca"))), "ka", "left")
    score = -3 * F.col("cost") + 0.2 * F.log("n") + F.log1p(F.coalesce("cb", F.lit(0))) + F.log1p(F.coalesce("ca", F.lit(0)))
    best = ranked.groupBy("source_table", "record_key", "word").agg(F.max_by("reading", F.struct(score.alias("s"), "reading")).alias("reading"))
    return sure.select("source_table", "record_key", "word", "reading").unionByName(best)


def repaired(chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """source_table, record_key, text (readable), changed for every chunk and figure with a text.

    A key that comes again is repaired once, by its greatest text. Null texts are left out, blank ones stay blank.
    """
    shelf = Shelf(chunks.sparkSession)
    texts = shelf.keep(sources(chunks, figures).groupBy("source_table", "record_key").agg(F.max("text").alias("text")), "texts")
    lexicon = Lexicon(texts, shelf)
    seen = shelf.keep(evidence(texts, lexicon), "evidence")
    fixes = shelf.keep(corrections(seen.where("word IS NOT NULL"), lexicon, shelf), "fixes")
    picks = chosen(texts, seen, fixes, shelf).groupBy("source_table", "record_key").agg(F.map_from_entries(F.collect_list(F.struct("word", "reading"))).alias("fixes"))  # one entry per odd word of one text
    shared = chunks.sparkSession.sparkContext.broadcast((lexicon.known, lexicon.vocabulary))

    def run(batches):
        known, words = shared.value
        for b in batches:
            old = b.column("text").to_pylist()
            new = [repair_text(t, known, words, dict(f or ())) for t, f in zip(old, b.column("fixes").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("source_table"), b.column("record_key"), pa.array(new, pa.string()), pa.array([x != y for x, y in zip(old, new)], pa.bool_())], names=["source_table", "record_key", "text", "changed"])

    return texts.join(picks, ["source_table", "record_key"], "left").mapInArrow(run, "source_table string, record_key string, text string, changed boolean")
