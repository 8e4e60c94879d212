"""Column expressions over texts: cleaning, redaction, hidden characters, labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import characters as C
from . import values as V
from .names import let

MASK = "[REDACTED]"


def clean_single_line(text: Column, most: int) -> Column:
    """Control characters go, white space becomes one space; cut with an ellipsis at `most` characters."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", ""), r"\s+", " "))
    return truncate(flat, most)


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def first_line(text: Column) -> Column:
    return F.substring_index(F.regexp_replace(text, "\r\n?", "\n"), "\n", 1)


def normalize_iso_date(text: Column) -> Column:
    """An ISO-8601 date in UTC with milliseconds; null if it is none, empty or longer than 64 characters. The session's zone is UTC."""
    return F.date_format(F.when(F.length(text).between(1, 64), F.try_to_timestamp(text)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def normalize_signature(text: Column, most: int = 160) -> Column:
    return truncate(F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("")), most)


def redact_secrets(text: Column, literals: Sequence[str] = ()) -> Column:
    """Access tokens, authorization headers, parameters that carry credentials and passwords in urls are masked, and every literal of eight characters or more."""
    for literal in literals:
        if len(literal.strip()) >= 8:
            text = F.replace(text, F.lit(literal.strip()), F.lit(MASK))
    # each step's text is bound, as the next names it many times
    some = lambda t: F.when(F.exists(F.array(*map(F.lit, V.TOKEN_PREFIXES)), t.contains), F.regexp_replace(t, rf"\b(?:{'|'.join(V.TOKEN_PREFIXES)})\w+", MASK)).otherwise(t)
    for step in (some, _without_authorization, _without_parameters, _without_url_passwords):
        text = let(text, step)
    return text


def _runs(text: Column, separators: str) -> Column:
    """The text cut between its separators and the rest; each separator is a run of its own."""
    return F.regexp_extract_all(text, F.lit(f"([{separators}]|[^{separators}]+)"), 1)


def _last_word(text: Column) -> Column:
    """The letters, digits and underscores that a text ends in, in lower case."""
    return F.lower(F.regexp_extract(text, r"(\w*)$", 1))


def _without_authorization(text: Column) -> Column:
    """What follows the name of an authorization scheme and white space is masked, up to a blank, comma, semicolon or quote."""
    words = F.regexp_extract_all(text, F.lit(r"(\s+|\S+)"), 1)

    def shown(word: Column, before: Column) -> Column:
        credential = F.substring_index(F.translate(word, ";\"'", ",,,"), ",", 1)
        ends = F.lower(F.right(before, F.lit(max(map(len, V.AUTHORIZATION_SCHEMES)))))
        likely = reduce(Column.__or__, [ends.endswith(w) for w in V.AUTHORIZATION_SCHEMES])
        named = likely & _last_word(before).isin(*V.AUTHORIZATION_SCHEMES) & (F.trim(word) != "")
        return F.when(named & (credential != ""), F.concat(F.lit(MASK), F.substr(word, F.length(credential) + 1))).otherwise(word)

    none = F.lit(None).cast("string")
    found = F.array_join(F.zip_with(words, F.concat(F.array(none, none), words), lambda w, b: F.when(w.isNotNull(), shown(w, b))), "")
    return F.when(_mentions(text, V.AUTHORIZATION_SCHEMES), found).otherwise(text)


def _without_parameters(text: Column) -> Column:
    """Of a run without blanks, quotes, & and #, what follows the first credential's name and an equals sign is masked."""
    runs = _runs(text, r"\s&#\"'")

    def shown(run: Column) -> Column:
        parts = F.split(run, "=")
        at = F.array_position(F.transform(parts, lambda p, i: _last_word(p).isin(*V.SECRET_PARAMETERS) & (i < F.size(parts) - 1)), True).cast("int")
        value = F.array_join(F.slice(parts, at + 1, F.size(parts)), "=")
        return F.when(run.contains("=") & (at > 0) & (value != ""), F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(at, F.lit(0))), "="), F.lit("=" + MASK))).otherwise(run)

    return F.when(text.contains("=") & _mentions(text, V.SECRET_PARAMETERS), F.array_join(F.transform(runs, shown), "")).otherwise(text)


def _without_url_passwords(text: Column) -> Column:
    """A url's authority that names a user and a password before its at sign loses both."""
    pieces = F.split(text, "://")

    def shown(piece: Column, before: Column) -> Column:
        authority = F.regexp_extract(piece, r"^[^\s/]*", 0)
        user = F.substring_index(authority, ":", 1)
        secret = F.substring_index(F.substr(authority, F.length(user) + 2), "@", 1)
        named = C.begins_with(F.right(before, F.lit(1)), C.ALNUM + "+-.")
        given = authority.contains("@") & (user != "") & ~user.contains("@") & (secret != "") & (F.length(user) + F.length(secret) + 1 < F.length(authority))
        return F.when(named & given, F.concat(F.lit(MASK), F.substr(piece, F.length(user) + F.length(secret) + 2))).otherwise(piece)

    return F.when(text.contains("://"), F.array_join(F.zip_with(pieces, F.concat(F.array(F.lit(None).cast("string")), pieces), lambda p, b: F.when(p.isNotNull(), shown(p, b))), "://")).otherwise(text)


def _mentions(text: Column, words: Sequence[str]) -> Column:
    return let(F.lower(text), lambda low: reduce(Column.__or__, [low.contains(w) for w in words]))


def is_sensitive_key(key: Column) -> Column:
    low = F.lower(key)
    ends = [low.endswith(e) for e in V.SENSITIVE_ENDINGS]
    within = [low.contains(e) for e in V.SENSITIVE_PARTS]
    found = low.isin(*V.SENSITIVE_KEYS)
    for c in [*ends, *within]:
        found = found | c
    return found


def redact_map(props: Column) -> Column:
    """Values under keys that name credentials are masked; numbers, booleans and nulls stay, other texts lose what looks like a secret."""
    plain = lambda v: v.rlike(r"^(-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?|true|false)$")
    return F.transform_values(props, lambda k, v: F.when(v.isNull() | plain(v), v).when(is_sensitive_key(k), MASK).otherwise(redact_secrets(v)))


def initials(name: Column) -> Column:
    words = F.filter(F.split(F.trim(name), r"[\s._-]+"), lambda x: x != "")
    first, last = F.get(words, F.lit(0)), F.element_at(words, -1)
    return F.when(F.size(words) == 0, "?").when(F.size(words) == 1, F.upper(F.substring(first, 1, 2))).otherwise(F.upper(F.concat(F.substring(first, 1, 1), F.substring(last, 1, 1))))


def _round(x: Column) -> Column:
    """To whole numbers, halves up."""
    return F.floor(x + 0.5)


def _short(x: Column) -> Column:
    """One decimal, none if it is 0."""
    return F.regexp_replace(F.format_string("%.1f", x), r"\.0$", "")


def format_compact(value: Column) -> Column:
    """Three digits and one decimal with K, M, B or T."""
    text = None
    for power, unit in reversed(list(enumerate(("", "K", "M", "B", "T")))):
        scaled = _round(value / float(1000**power) * 10) / 10
        own = F.concat(_short(scaled), F.lit(unit))
        text = own if text is None else F.when(scaled < 1000, own).otherwise(text)
    return text


def format_integer(value: Column) -> Column:
    return F.format_number(_round(value), 0)


def format_percent(share: Column) -> Column:
    return F.when((share > 0) & (share < 0.01), "<1%").otherwise(F.concat(_round(share * 100), F.lit("%")))


def format_bytes(size: Column) -> Column:
    """From 10 of a unit on whole numbers, below with one decimal."""
    text = None
    for power, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")):
        scaled = size / float(1 << (10 * power))
        own = F.concat(F.when(scaled >= 10, _round(scaled).cast("string")).otherwise(F.format_string("%.1f", scaled)), F.lit(" " + unit))
        text = own if text is None else F.when(size < 1 << (10 * (power + 1)), own).otherwise(text)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(text)


def pluralize(count: Column, singular: str, plural: str | None = None) -> Column:
    return F.concat(format_integer(count), F.when(count == 1, f" {singular}").otherwise(f" {plural or singular + 's'}"))


def format_relative_time(at: Column, now: Column) -> Column:
    """How long ago, or how far ahead, in the largest unit that fits: `3 days ago`, `yesterday`, `next month`."""
    seconds = _round((F.unix_millis(at) - F.unix_millis(now)) / 1000)
    size, out = F.abs(seconds), None
    for limit, length, unit in reversed(V.TIME_UNITS):
        n = _round(seconds / float(length))
        named = V.NAMED_TIMES.get(unit, {})
        count = F.concat(F.abs(n), F.lit(f" {unit}"), F.when(F.abs(n) == 1, "").otherwise("s"))
        own = F.when(n < 0, F.concat(count, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), count))
        for value, name in named.items():
            own = F.when(n == value, name).otherwise(own)
        out = own if out is None else F.when(size < limit, own).otherwise(out)
    return F.when(at.isNull(), "unknown").otherwise(out)


def format_date(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "MMM d, yyyy"), F.lit("unknown"))


def line_range_label(start: Column, end: Column) -> Column:
    return F.when(end > start, F.concat(F.lit("lines "), format_integer(start), F.lit("–"), format_integer(end))).otherwise(F.concat(F.lit("line "), format_integer(start)))


def symbol_title(name: Column, kind: Column) -> Column:
    return F.when(kind.isin("function", "method"), F.concat(name, F.lit("()"))).otherwise(name)


def kind_labels(kind: Column) -> tuple[Column, Column, Column]:
    """(singular, plural, place in the display order) of a symbol kind."""
    place = F.array_position(F.array(*map(F.lit, V.KIND_LABELS)), kind)
    plural = F.get(F.array(*map(F.lit, V.KIND_LABELS.values())), (place - 1).cast("int"))
    return F.when(place > 0, kind), F.when(place > 0, plural), F.when(place > 0, place)


def prepare_query(query: Column) -> Column:
    """White space goes, backslashes become slashes, at most 64 characters, lower case."""
    return F.lower(original_query(query))


def original_query(query: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(query, r"\s+", ""), r"\\", "/"), 1, 64)


# --- hidden characters ---------------------------------------------------------------------------------------------------

_LETTER = r"[\p{M}[\p{L}&&[^\p{IsLatin}]]]"
_EMOJI = r"[\x{a9}\x{ae}\x{203c}\x{2049}\x{2122}\x{2139}\x{2190}-\x{21ff}\x{2300}-\x{23ff}\x{2600}-\x{27bf}\x{2b00}-\x{2bff}\x{3030}\x{303d}\x{3297}\x{3299}" "\U0001f000-\U0001f3fa\U0001f400-\U0001faff]"  # written out above U+FFFF, or Java looks behind by one unit only
_ANY = "[" + "".join(f"\\x{{{c:04x}}}" for c in (*V.BIDI, *V.INVISIBLE)) + "]"
#: Joiners between letters of joining scripts, and zero-width joiners inside an emoji, are ordinary text.
HIDDEN = (
    rf"(?!(?<={_LETTER})[\x{{200c}}\x{{200d}}](?={_LETTER}))"
    rf"(?!(?<=[{_EMOJI}\x{{1f3fb}}-\x{{1f3ff}}\x{{fe00}}-\x{{fe0f}}])\x{{200d}}(?={_EMOJI})){_ANY}"
)


def hidden_characters(text: Column) -> Column:
    """(place from 0 in code points, code point, kind: bidi or invisible) of each character that hides, in order."""
    found, runs = F.regexp_extract_all(text, F.lit(f"({HIDDEN})"), 1), F.split(text, HIDDEN, -1)
    ends = F.aggregate(runs, F.array().cast("array<int>"), lambda at, run: F.concat(at, F.array(F.coalesce(F.element_at(F.when(F.size(at) > 0, at), -1) + 1, F.lit(0)) + F.length(run))))
    bidi = F.array(*[F.lit(chr(c)) for c in V.BIDI])
    one = lambda c, at: F.struct(at.alias("place"), F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0")).alias("code_point"), F.when(F.array_contains(bidi, c), "bidi").otherwise("invisible").alias("kind"))
    return F.zip_with(found, F.slice(ends, F.lit(1), F.size(found)), one)


def escape_hidden(text: Column) -> Column:
    """Every hidden character as its code point in brackets: [U+202E]."""
    out = text
    for c in (*V.BIDI, *V.INVISIBLE):
        if c not in (0x200C, 0x200D):
            out = F.replace(out, F.lit(chr(c)), F.lit(f"[U+{c:04X}]"))
    for c in (0x200C, 0x200D):
        out = F.regexp_replace(out, HIDDEN.replace(_ANY, rf"\x{{{c:04x}}}"), f"[U+{c:04X}]")
    return out


# --- lines ---------------------------------------------------------------------------------------------------------------


def source_lines(text: Column) -> Column:
    """The lines of a text without a byte order mark; ends are LF, CRLF or CR, and one at the end opens no further line."""
    plain = F.regexp_replace(text, "^﻿", "")
    lines = F.split(plain, "\r\n|\r|\n", -1)
    lines = F.when((F.size(lines) > 1) & (F.element_at(lines, -1) == ""), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(lines)


def visual_width(line: Column, tab: int = 4) -> Column:
    """Columns a line takes: each tab goes on to the next stop."""
    pieces = F.split(line, "\t", -1)
    stop = lambda at: at + tab - at % tab
    before = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.lit(0), lambda at, p: stop(at + F.length(p)))
    return before + F.length(F.element_at(pieces, -1))


def max_visual_width(text: Column, most: int = 3000) -> Column:
    widths = F.transform(source_lines(text), lambda x: F.least(F.lit(most), visual_width(F.substring(x, 1, most))))
    return F.coalesce(F.array_max(widths), F.lit(0))


def parse_eligible(text: Column, most: int) -> Column:
    """Whether a text has at most `most` bytes in UTF-8."""
    return F.octet_length(text) <= most


def has_flow_pragma(text: Column) -> Column:
    """Whether a comment before the first statement, in the first 4 Ki characters, holds @flow or @noflow."""
    head = F.substring(text, 1, 4096)
    comments = F.regexp_extract(head, r"^(?:#![^\n]*\n)?((?:\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/|$))*+)", 1)
    return comments.rlike(r"@(no)?flow\b")
