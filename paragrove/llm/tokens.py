"""Token counts of the public WordPunct tokenizer, as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: `\w+|[^\w\s]+` with Unicode classes, spelled out for java.util.regex, whose own classes differ.
_SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORDPUNCT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + _SPACE + "]+"


def n_tokens(text: Column) -> Column:
    """The number of tokens; 0 for null and for white space alone."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDPUNCT)), F.lit(0)).cast("bigint")
