"""Shared text conventions: words are runs of anything but space and TAB..CR."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Regular expressions that read alike in Java and RE2.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body) -> Column:
    """``body`` over ``value`` evaluated once: a lambda variable is not inlined again and again."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of ``text``; no words for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; only texts with a capital pay for it."""
    return F.when(text.rlike("[A-Z]"), F.translate(text, UPPER, UPPER.lower())).otherwise(text)


def code_point_order(text: Column) -> Column:
    """A sort key that orders strings by code point (UTF-8 bytes sort alike)."""
    return F.encode(text, "UTF-8")
