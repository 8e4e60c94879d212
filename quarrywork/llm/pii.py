"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

The four base kinds (email, ip, card, phone) are kept whenever their own check holds. Further kinds need more: an IBAN its mod-97
checksum, a social security number, an address written out ("name at host dot com") and a long random-looking token a word nearby that speaks for them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, schema, ship, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "written_email", "secret")
#: Words near a span that speak for its kind, and how far away they count, in characters.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write"), "ip": ("ip", "address", "server", "host"),
    "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"), "ssn": ("ssn", "social", "security"), "written_email": ("mail", "email", "e-mail", "contact", "write"),
    "secret": ("token", "key", "apikey", "api-key", "secret", "password", "passwd", "credential", "credentials"),
}
NEAR = 40
#: A kind's score before and after its checksum or range check, and what a word nearby adds; spans under LEAST are dropped.
PRIOR, CHECKED, NEARBY, LEAST = 0.3, 0.8, 0.2, 0.5

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN_REST = re.compile(r"(?: ?[A-Z0-9]){11,30}")
_TOKEN_END = re.compile(r"[A-Z0-9](?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WRITTEN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{2,32} ?[(\[]at[)\]] ?[A-Za-z0-9-]{2,32} ?[(\[]dot[)\]] ?[a-z]{2,8}(?![A-Za-z0-9])")
#: A token of an access key: 20 characters or more, letters and digits by turns.
_SECRET = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,128}(?![A-Za-z0-9_])")
_DIGIT = re.compile(r"[0-9]")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = (ord(d) - 48) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ibans(text: str):
    """At each start the end of a token that makes the checksum hold: first those of the country's length, then, between these, the last one. 64 characters are looked at."""
    tried, exact, done = [], [], 0
    for start in _IBAN_START.finditer(text):
        at = start.start()
        if rest := _IBAN_REST.match(text, start.end()):
            ends = [m.end() for m in _TOKEN_END.finditer(text, start.end(), rest.end() + 1) if m.end() <= rest.end()]
            sized = [(e, n) for e in reversed(ends) if (n := e - at - text.count(" ", at, e)) >= 15]
            tried.append((at, sized))
            end = next((e for e, n in sized if n == IBAN_LENGTHS.get(start[0][:2])), None)
            if at >= done and end and mod97(text[at:end]):
                exact.append((at, end))
                done = end
    found, bounds = list(exact), [*exact, (len(text), len(text))]
    done = i = 0
    for at, sized in tried:
        while bounds[i][1] <= at and bounds[i][0] < len(text):
            done = max(done, bounds[i][1])
            i += 1
        if at >= done and at < bounds[i][0] and (end := next((e for e, _ in sized if e <= bounds[i][0] and mod97(text[at:e])), None)):
            found.append((at, end))
            done = end
    yield from sorted(found)


def _emails(text: str):
    """The pattern's matches, found from each @ so that long runs without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _addresses(text: str):
    """Four numbers at a time of each dotted chain."""
    for chain in _CHAIN.finditer(text):
        if chain[0].count(".") < 3:
            continue
        parts = list(_PART.finditer(text, *chain.span()))
        for i in range(0, len(parts) - 3, 4):
            if all(len(p[0].lstrip("0")) <= 3 and int(p[0].lstrip("0") or "0") <= 255 for p in parts[i : i + 4]):
                yield parts[i].start(), parts[i + 3].end()


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def random_looking(token: str) -> bool:
    """At least five times from a letter to a digit or back, and ten different characters."""
    digit = [c.isdigit() for c in token]
    return sum(a != b for a, b in zip(digit, digit[1:])) >= 5 and len(set(token)) >= 10


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", *s) for s in _emails(text)]
    if not _DIGIT.search(text):
        return found
    found += [("ip", *s) for s in _addresses(text)]
    for m in _CARD.finditer(text):
        if len(m[0]) >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as in KINDS, then by start; ends exclusive. More kinds never replace a base span; they may overlap one, but not lie within it."""
    found = [(k, s, e, CHECKED) for k, s, e in base_spans(text)]
    more = []
    if _DIGIT.search(text):
        more += [("iban", *s, CHECKED) for s in _ibans(text)]
        more += [("ssn", *m.span(), PRIOR + 0.1 * (m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00")) for m in _SSN.finditer(text)]
        more += [("secret", *m.span(), PRIOR) for m in _SECRET.finditer(text) if random_looking(m[0])]
    if "at" in text and "dot" in text:
        more += [("written_email", *m.span(), PRIOR) for m in _WRITTEN.finditer(text)]
    taken = sorted((s, e) for _, s, e, _ in found)
    starts, reach = [s for s, _ in taken], [0, *accumulate((e for _, e in taken), max)]  # how far the spans go that start up to here
    found += [x for x in more if reach[bisect_right(starts, x[1])] < x[2]]
    scored = []
    for kind, start, end, score in found:
        around = re.findall(r"[a-z-]+", text[max(0, start - NEAR) : start].lower() + " " + text[end : end + NEAR].lower())
        score = min(1.0, score + NEARBY * any(w in CONTEXT[kind] for w in around)) if score else 0.0
        if kind in BASE or score >= LEAST:
            scored.append((kind, start, end, score))
    return sorted(scored, key=lambda x: (KINDS.index(x[0]), x[1]))


def mask(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """Every span as [KIND]; spans that overlap are masked as one, under the first one's kind."""
    out, at, end = [], 0, 0
    for kind, s, e, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[at:s], f"[{kind.upper()}]"]
        end = at = max(end, e)
    return "".join(out) + text[at:] if out else text


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _found(batches):
    for batch in parts(batches):
        spans = [[dict(zip(("kind", "start", "end", "score"), x)) for x in find_spans(t or "")] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], ["doc_id", "spans"])


def _masked(batches):
    for batch in parts(batches):
        at = batch.schema.get_field_index("text")
        texts = [t and mask(t, find_spans(t)) for t in batch.column(at).to_pylist()]
        yield batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, spans (kind, start, end, score; code points, end exclusive) for every row of docs(doc_id, text).

    Null and empty texts have no spans. Repeated rows give repeated results, no rows none. Other columns are ignored.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_found, schema("doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>"))


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """The same rows and columns, every span in text replaced by its kind in brackets; null stays null."""
    ship(docs.sparkSession)
    return docs.mapInArrow(_masked, docs.schema)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scores: those of the spans, in the same order, after checksums and words nearby."""
    found = personal_data(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",")
    base = joined(F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    return found.select("doc_id", *map(of, BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores.alias("scores"))
