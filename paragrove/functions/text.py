"""Text expressions: references, codes, captions, modal verbs, templates. All are SQL functions inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paragrove.functions.ids import normalize_dashes

#: The grammar of references and codes.
SECTION_REF = r"(?i)\bSection\s+([0-9A-Z]+\.[0-9]+)\b"
FIGURE_REF = r"(?i)\bFigure\s+([0-9A-Z]+-[0-9]+(?:\([A-Za-z0-9]+\))?[A-Za-z]?)\b"
TABLE_REF = r"(?i)\bTable\s+([0-9A-Z]+-[0-9]+(?:\([A-Za-z0-9]+\))?[A-Za-z]?)\b"
MODAL = r"(?i)\b(shall|should|may|must)\b"
CODE_PARSER = r"\b((?:EM|OM|RM|D|I|M|R|W)-?\d{1,3}(?:-\d{1,3})?[a-z]?P?)\b"
CODE_QUERY = r"\b([RWDIMOE][A-Z]?\d{1,3}(?:-\d{1,3})?[a-zA-Z]?P?)\b"
CODE_PAREN = r"\(([A-Z]{1,3}\d{1,3}(?:-\d{1,3})?[a-z]?P?)\)"
MENTION = r"(?i)\b(?:Figure|Table)\s+[0-9]+[A-Z]{0,2}-\d+\b"
EXTERNAL = r"AASHTO|CFR|ISO\s|ANSI|AREMA"
CAPTION = r"(?i)^\s*(Figure|Table)\s+([0-9]+[A-Z]{0,2}-\d+)\s*(\(Sheet\s+(\d+)\s+of\s+(\d+)\))?\s*[.:]\s*(.*)$"
SHEET_TAIL = r"(?i)\(Sheet\s+(\d+)\s+of\s+(\d+)\)\s*$"
ID_SPACING = r"(?i)\b(figure|table)\s*([0-9]+[A-Z]{0,2})\s*-\s*(\d+)"
MAX_CAPTION = 150
#: Code prefix -> category; two-letter prefixes come first.
CATEGORIES = {"EM": "Emergency", "OM": "ObjectMarker", "RM": "RoadMarker", "D": "Guide", "I": "Information", "M": "Marker", "R": "Regulatory", "W": "Warning"}
#: Weight of a rule type; unknown types weigh 1.
RULE_WEIGHTS = {"Standard": 1.2, "Guidance": 1.0, "Option": 0.9, "Support": 0.7}


def collapse(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """Sorted distinct matches; null text gives null."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(group))))


def references(c: Column, pattern: str) -> Column:
    """Upper-case references of one kind in a text, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(normalize_dashes(c), F.lit(pattern), F.lit(1)), lambda x: F.upper(F.regexp_replace(x, r"\s+", "")))))


def modal_verbs(c: Column) -> Column:
    """Lower-case modal verbs, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(MODAL), F.lit(1)), lambda x: F.lower(x))))


def canonical_spacing(c: Column) -> Column:
    """'Figure4F- 1' as 'Figure 4F-1'."""
    return F.regexp_replace(c, ID_SPACING, "$1 $2-$3")


def category(code: Column) -> Column:
    """The category of a code by its longest known prefix, else 'Unknown'."""
    out = None
    for prefix, name in CATEGORIES.items():
        hit = F.upper(code).startswith(prefix)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Unknown")


def content_type(c: Column) -> Column:
    """A rule type in its usual spelling; null for null and blank."""
    return F.nullif(F.initcap(F.trim(c)), F.lit(""))


def rule_weight(kind: Column) -> Column:
    """The weight of a rule type, 1.0 where it is unknown or null."""
    out = None
    for name, w in RULE_WEIGHTS.items():
        out = F.when(kind == name, w) if out is None else out.when(kind == name, w)
    return out.otherwise(1.0)


def is_list_entry(c: Column) -> Column:
    """A row of a table of contents: dot leaders, or dots and a page number."""
    return c.rlike(r"\.{4,}") | c.rlike(r"\.{2,}\s*\d{1,4}\s*$")


def chapter_of(canonical_id: Column) -> Column:
    """'2B-14' -> '2B'."""
    return F.split_part(canonical_id, F.lit("-"), F.lit(1))


def caption(line: Column) -> Column:
    """struct(kind, canonical_id, sheet, sheet_of, title) of a caption line; null where the line is none."""
    text = canonical_spacing(normalize_dashes(line))
    part = lambda i: F.regexp_extract(text, CAPTION, i)
    strip = lambda c: F.regexp_replace(c, r"^[ .—–:-]+|[ .—–:-]+$", "")
    title = strip(part(6))
    tail = lambda i: F.regexp_extract(title, SHEET_TAIL, i)
    number = lambda c: F.nullif(c, F.lit("")).cast("int")
    own = part(4) != ""
    ok = (F.length(line) <= MAX_CAPTION) & text.rlike(CAPTION) & ~is_list_entry(text)
    return F.when(ok, F.struct(
        F.initcap(part(1)).alias("kind"), F.upper(part(2)).alias("canonical_id"),
        F.when(own, number(part(4))).otherwise(number(tail(1))).alias("sheet"), F.when(own, number(part(5))).otherwise(number(tail(2))).alias("sheet_of"),
        F.when(own, title).otherwise(strip(F.regexp_replace(title, SHEET_TAIL, ""))).alias("title")))


def sentences(c: Column, least: int = 20) -> Column:
    """Sentences of more than `least` characters, in order."""
    return F.filter(F.transform(F.split(F.trim(F.regexp_replace(c, r"[\r\n]", " ")), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > least)


def slug(c: Column) -> Column:
    """A file name part."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "-")


def provider_of(model_id: Column) -> Column:
    """The provider by the id's prefix."""
    low = F.lower(model_id)
    return F.when(low.startswith("claude"), "anthropic").when(low.startswith("gemini"), "gemini").when(low.startswith("qwen"), "dashscope").otherwise("local")


#: What a word before a code in parentheses may look like (a code ends the name), and how many words a name has.
NAME_TOKENS = r"\([A-Z]{1,3}\d{1,3}(?:-\d{1,3})?[a-z]?P?\)|[A-Za-z][\p{L}\p{N}_]*(?:['-]+[\p{L}\p{N}_]+)*|[\p{L}\p{N}_]+"
CODE_LIKE, NAME_WORDS = r"^[RWDIMOE][A-Z]?\d", 5


def named_codes(c: Column) -> Column:
    """array of struct(name, code): up to five words before every known code in parentheses, back to the last word that looks like a code."""
    tokens = F.filter(F.regexp_extract_all(c, F.lit(NAME_TOKENS), F.lit(0)), lambda w: w.rlike(r"^[A-Za-z(]"))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<struct<name: string, code: string>>").alias("out"))

    def read(acc, token):
        mark = token.startswith("(")
        word = F.regexp_replace(token, r"[()]", "")
        kept, name = acc["kept"], F.array_join(acc["kept"], " ")
        out = F.when(mark & (name != "") & (category(word) != "Unknown"), F.array_append(acc["out"], F.struct(name.alias("name"), word.alias("code")))).otherwise(acc["out"])
        longer = F.array_append(kept, word)
        after = F.when(word.rlike(CODE_LIKE), F.array().cast("array<string>")).otherwise(F.slice(longer, F.greatest(F.lit(1), F.size(longer) - NAME_WORDS + 1), F.lit(NAME_WORDS)))
        return F.struct(after.alias("kept"), out.alias("out"))

    return F.when(c.rlike(CODE_PAREN), F.aggregate(tokens, start, read, lambda acc: acc["out"]))


def content_text(v: Column) -> Column:
    """Line breaks between the text parts of a JSON content list, without thinking and reasoning parts."""
    parts = F.from_json(v, "array<struct<type: string, text: string>>")
    return F.array_join(F.transform(F.filter(parts, lambda p: ~F.coalesce(p["type"], F.lit("text")).isin("thinking", "redacted_thinking", "reasoning") & p["text"].isNotNull()), lambda p: p["text"]), "\n")
