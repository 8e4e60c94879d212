"""Which characters a text is made of: what grammars of names and urls ask, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER = "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + LOWER.upper()
DIGITS = "0123456789"
ALNUM = LETTERS + DIGITS


def only(text: Column, allowed: str) -> Column:
    """Whether a text holds no other character than these; an empty one holds none."""
    return F.coalesce(F.translate(text, allowed, "") == "", F.lit(False))


def first(text: Column) -> Column:
    return F.substring(text, 1, 1)


def begins_with(text: Column, allowed: str) -> Column:
    """Whether a text has a first character and that is one of these."""
    return F.coalesce(F.instr(F.lit(allowed), first(text)) * F.length(text) > 0, F.lit(False))


def identifier(text: Column, more: str = "_") -> Column:
    """Letters, digits and `more`, no digit first."""
    return only(text, ALNUM + more) & begins_with(text, LETTERS + more)


def blank(text: Column) -> Column:
    """Whether there is white space in it."""
    return text.rlike(r"\s")


def scheme(url: Column) -> Column:
    """What stands before the first colon, if it can be a url's scheme: a letter, then letters, digits, plus, minus and dots. Else null."""
    before = F.substring_index(url, ":", 1)
    return F.when(url.contains(":") & begins_with(before, LETTERS) & only(before, ALNUM + "+-."), before)
