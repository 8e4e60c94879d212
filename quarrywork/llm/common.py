"""Helpers that the training-data operators share: shared storage, bounded cuts, joins on hot keys."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..shared import settle

#: ASCII white space; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes that Python works on at a time, so that what it makes of a batch of long texts stays small.
PART_ROWS, PART_BYTES = 512, 16 << 20
#: A side with at most this many short rows may be broadcast.
FEW = 200_000
#: At most this many words, each with the marks of 64 rows that stand side by side, are broadcast: 32 million rows and about 32 MB.
MARKS = 500_000
#: A key is hot from this share of all rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Before Python runs on rows in a local run: this package is on the workers' path. A cluster gets it by --py-files or an installed package."""
    if spark.sparkContext.master.startswith("local["):
        spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most PART_ROWS rows and, but for a single longer row, about PART_BYTES bytes.

    After the last one the worker, which lives on, gives back what memory is free.
    """
    for batch in batches:
        rows = max(1, min(PART_ROWS, batch.num_rows * PART_BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        batch = None
    give_back()


def give_back() -> None:
    """Returns free memory of Arrow and, where the C library can do it, of Python to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def keyed_rows(docs: DataFrame, label: str) -> tuple[DataFrame, dict[str, str]]:
    """docs, written, under names by position, with two columns more: _row, a number of its own for every row, and _hash, of all columns; and the new name of each column.

    Ids can be null or repeated; stages that join rows with what they found about them do it by _row. Rows of the same id are told apart by
    _hash, so results do not depend on the numbers, which follow the files. No name of the caller's can clash with one of ours.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    rows = settle(plain.withColumns({"_row": F.monotonically_increasing_id(), "_hash": F.xxhash64(*plain.columns)}), label)
    return rows, dict(zip(docs.columns, plain.columns, strict=True))


def take_rows(rows: DataFrame, taken: DataFrame, most: int, label: str, marks: int = MARKS) -> DataFrame:
    """rows of keyed_rows, each as often as taken(_row, passes) says, 0 to `most` times; those that taken lacks go. taken has a row number at most once.

    Rows hold texts and stay where they are: a bit a pass marks each row, 64 rows make a word, and the words are broadcast. Beyond `marks` words
    rows and numbers meet in a shuffle.
    """
    taken = settle(taken.select("_row", "passes"), label)
    place = (F.col("_row").bitwiseAND(63)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    bits = [F.bit_or(F.when(F.col("passes") > p, bit).otherwise(F.lit(0).cast("long"))).alias(f"_bits{p}") for p in range(most)]
    words = settle(taken.filter("passes > 0").groupBy(F.shiftright("_row", 6).alias("_word")).agg(*bits), f"{label}-marks")
    if words.count() <= marks:
        passes = sum((F.getbit(f"_bits{p}", place).cast("int") for p in range(most)), F.lit(0))
        found = rows.join(F.broadcast(words), F.shiftright("_row", 6) == F.col("_word")).withColumn("passes", passes).filter("passes > 0").drop(*words.columns)
    else:
        found = rows.join(taken.filter("passes > 0"), "_row")
    if most > 1:
        found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("passes")))).drop("_copy")
    return found.drop("passes")


def hot_join(left: DataFrame, right: DataFrame, key: str, count: str, how: str = "left", written: bool = False) -> DataFrame:
    """Equi-join of a large left side with a right side that has one row for each key and the key's left rows in `count`.

    Keys with at least HOT_SHARE of all left rows, at most 1 / HOT_SHARE of them, are broadcast; only the rest is
    shuffled, so no key of the shuffle holds more than that share. Rows with a null key match nothing. `how`: left or inner. The right side is
    written, unless it is already, so that counting does not compute it again and plans stay short.
    """
    right = right if written else settle(right, "join-side")
    total, most = right.agg(F.sum(count), F.max(count)).first()
    least = max((total or 0) * HOT_SHARE, 1000.0)
    if not most or most < least:
        return left.join(right.drop(count), key, how)
    hot, cold = right.filter(F.col(count) >= least).drop(count), right.filter(F.col(count) < least).drop(count)
    flagged = left.join(F.broadcast(hot.select(F.col(key).alias("_k"), F.lit(True).alias("_is_hot"))), F.col(key) == F.col("_k"), "left").drop("_k")
    return (
        flagged.filter("_is_hot").drop("_is_hot").join(F.broadcast(hot), key, how)
        .unionByName(flagged.filter("_is_hot IS NULL").drop("_is_hot").join(cold, key, how))
    )


def cut_at(df: DataFrame, key: str, ties: list[str], weight: str, budget: float, bins: int = 4096, last: int = 10_000) -> tuple | None:
    """Where a global sort by the double `key` and then `ties` is truncated: the values of the last row whose running weight is within the budget.

    The sort is by ranges: each pass sums `bins` equal ranges of the key and goes on with the one that holds the cut, until at
    most `last` rows, or the rows that share one key, are left; equal ones are summed, the rest is sorted. Weights are not negative; df is read again in
    each pass, so settle it first. (key, *ties): up to this row. (key,): the rows below this key. None: no row.
    """
    low, high, n = df.agg(F.min(key), F.max(key), F.count("*")).first()
    before = 0
    while n > last and low < high:
        part = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(high - low) * bins), F.lit(bins - 1))
        for p in (parts := df.groupBy(part.alias("bin")).agg(F.sum(weight).alias("w"), F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n")).orderBy("bin").collect()):
            if before + p["w"] > budget or p is parts[-1]:
                break
            before += p["w"]
        low, high, n = p["low"], p["high"], p["n"]
        df = df.filter(F.col(key).between(low, high))
    df = df.groupBy(key, *ties).agg(F.sum(weight).alias(weight))
    order = [F.col(key), *map(F.col, ties)]
    running = F.sum(weight).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + F.lit(before)
    found = df.withColumn("_running", running).filter(F.col("_running") <= budget).orderBy(F.desc("_running"), *[c.desc() for c in order]).select(key, *ties).first()
    return tuple(found) if found else (low,) if before else None


def up_to(cut: tuple | None, key: str, ties: list[str]) -> Column:
    """Whether a row is on the kept side of cut_at's cut."""
    if cut is None:
        return F.lit(False)
    at = F.col(key) < F.lit(cut[0])
    if len(cut) > 1:
        at |= (F.col(key) == F.lit(cut[0])) & (F.struct(*ties) <= F.struct(*[F.lit(x).alias(t) for x, t in zip(cut[1:], ties, strict=True)]))
    return at


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)
