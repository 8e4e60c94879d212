"""TOML manifests as rows: one for each value, with the path of its keys. A line that cannot be read costs itself and not the document.

A document is cut in statements (a table's header or a key with its value, over as many lines as its brackets and strings take); each is read by itself
and put in its place. Manifests are short, and each is read where its row is.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines that one statement may take.
LINES = 2000
VALUE = "repo_id string, path string, keys array<string>, value string"


def _statements(lines: list[str]) -> Iterator[tuple[bool, object]]:
    """(whether it is a header, what was read): a header gives (its keys, whether of a list), None if it is broken; a key its keys and value."""
    at = 0
    while at < len(lines):
        line = lines[at].strip()
        if not line or line.startswith("#"):
            at += 1
            continue
        header, most = line.startswith("["), LINES if any(q in line for q in ("[", "{", '"""', "'''")) else 1
        read, took = None, 1
        for n in range(1, 2 if header else min(most, len(lines) - at) + 1):
            try:
                read = tomllib.loads("\n".join(lines[at : at + n]))
                took = n
                break
            except tomllib.TOMLDecodeError:
                continue
        at += took
        if header:
            keys = []
            listed = False
            while isinstance(read, dict) and read or isinstance(read, list):
                if isinstance(read, list):
                    listed, read = True, read[0]
                    continue
                name, read = next(iter(read.items()))
                keys.append(name)
            yield True, (keys, listed) if keys else None
        elif read:
            yield False, read


def _descend(table: dict, keys: list[str]) -> dict | None:
    for k in keys:
        table = table.setdefault(k, {})
        if isinstance(table, list) and table:
            table = table[-1]
        if not isinstance(table, dict):
            return None
    return table


def _merge(into: dict, more: dict) -> None:
    """What is there already stays."""
    for k, v in more.items():
        if isinstance(v, dict) and isinstance(into.get(k), dict):
            _merge(into[k], v)
        elif k not in into:
            into[k] = v


def document(text: str | None) -> dict:
    root: dict = {}
    current: dict | None = root
    for header, read in _statements((text or "").removeprefix("\ufeff").replace("\r\n", "\n").split("\n")):
        if not header:
            if current is not None:
                _merge(current, read)
        elif read is None:
            current = None
        elif read[1]:
            above = _descend(root, read[0][:-1])
            rows = above.setdefault(read[0][-1], []) if above is not None else None
            current = {} if isinstance(rows, list) else None
            if current is not None:
                rows.append(current)
        else:
            current = _descend(root, read[0])
    return root


def leaves(table: dict, above: tuple[str, ...] = ()) -> Iterator[tuple[list[str], str]]:
    """(keys, value as JSON); lists are values, tables are gone into. An empty table gives nothing."""
    for k, v in table.items():
        if isinstance(v, dict):
            yield from leaves(v, (*above, k))
        else:
            yield [*above, k], json.dumps(v, default=str, ensure_ascii=False)


def toml_values(manifests: DataFrame) -> DataFrame:
    """manifests (repo_id, path, text) -> repo_id, path, keys, value (JSON): every value of every document."""

    def run(batches):
        for batch in batches:
            rows = [(r, p, keys, value) for r, p, t in zip(*(c.to_pylist() for c in batch.columns)) for keys, value in leaves(document(t))]
            columns = zip(*rows) if rows else ((), (), (), ())
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["repo_id", "path", "keys", "value"])

    return manifests.select(F.col("repo_id").cast("string"), "path", "text").mapInArrow(run, T._parse_datatype_string(VALUE))


def keyed(*keys: str) -> Column:
    """Whether a value stands under these keys."""
    return F.col("keys") == F.array(*map(F.lit, keys))


def text_value() -> Column:
    """The value, if it is a text."""
    return F.when(F.col("value").startswith('"'), F.get(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>"), F.lit(0)))
