"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, so that both engines give one schema."""
    return df.select(*[F.col(c).cast("long").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(c) for c, kind in df.dtypes])


def query(name: str, sql: str | None = None, *tables: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: plain(f(lambda view_name: view(spark, sf_dir, view_name)))
        if sql:
            ORACLES[name] = duck(sql, *tables)
        return f

    return add


def quoted(x) -> str:
    return "CAST(NULL AS VARCHAR)" if x is None else "'" + str(x).replace("'", "''") + "'"


def typed(results: Sequence, key: str) -> str:
    """SQL: the typed result whose number is key modulo their number."""
    return f"CASE {key} % {len(results)} " + " ".join(f"WHEN {i} THEN {quoted(r)}" for i, r in enumerate(results)) + " END"


def given(inputs: Sequence, key: str) -> Column:
    """The typed input whose number is key modulo their number."""
    return F.element_at(F.array(*map(F.lit, inputs)), (F.col(key) % len(inputs) + 1).cast("int"))


def by_example(name: str, cases: Sequence[tuple[str, object]], f: Callable[[Column], Column], source: str = "fx_docs", key: str = "doc_id", around: bool = False) -> None:
    """Registers f over a column in which the typed inputs take turns; its SQL holds the results, typed too, not the rule. Results are compared as text.

    around: the input stands behind the row's own text, and a hash of all is compared.
    """
    inputs, results = [c[0] for c in cases], [c[1] for c in cases]
    if around:
        query(name, f"SELECT {key}, md5(concat(text, ' ', {typed(results, key)})) AS result FROM {source}")(
            lambda v: v(source).select(key, F.md5(f(F.concat("text", F.lit(" "), given(inputs, key)))).alias("result")))
    else:
        query(name, f"SELECT {key}, {typed(results, key)} AS result FROM {source}")(lambda v: v(source).select(key, f(given(inputs, key)).cast("string").alias("result")))
