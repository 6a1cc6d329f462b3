"""Identifier and hashing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The dashes that scanned and typeset ids use for '-'.
DASHES = "‐‑‒–—―−"


def normalize_dashes(c: Column) -> Column:
    """Every typographic dash as '-'; null stays null."""
    return F.translate(c, DASHES, "-" * len(DASHES))


def normalize_id(c: Column) -> Column:
    """Upper case without any white space; null stays null."""
    return F.upper(F.regexp_replace(c, r"[\s  -​ ]+", ""))


def reference_key(c: Column) -> Column:
    """The spelling-free form of a figure or table id: upper case, '-' for every dash, neither blanks nor a leading kind word."""
    bare = normalize_id(normalize_dashes(c))
    return F.regexp_replace(bare, r"^(FIGURES?|FIGS?|TABLES?|TABS?)[.:]?-?(?=[0-9])", "")


def stable_id(c: Column) -> Column:
    """The first 8 bytes of SHA-1, shifted right by one: a non-negative bigint."""
    return F.shiftrightunsigned(F.conv(F.substring(F.sha1(c.cast("binary")), 1, 16), 16, -10).cast("bigint"), 1)
