"""The corpus pipeline: quality, near-duplicates, personal data, mixing, packing. Each stage works on all that the one before kept.

A stage writes its result to the shared folder and deletes the steps that led to it, so stages can be chained as they are or read and written in between,
and several pipelines can run side by side. A result stands at least as long as the DataFrame that the stage returned, and while the next stage reads it;
results that nothing holds any more go when the same thread calls a stage again.
"""

from __future__ import annotations

import threading
import weakref
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrywork.llm.common import table
from quarrywork.llm.mixing import apply_mix
from quarrywork.llm.near_dup import PIPELINE_PERCENT, drop_near_duplicates
from quarrywork.llm.packing import pack_documents
from quarrywork.llm.pii import mask_personal_data
from quarrywork.llm.quality import Sampler, quality_labels
from quarrywork.shared import Steps, settle

#: The results of this thread's stages: what was returned, and its files.
_RESULTS = threading.local()


def _sweep(docs: DataFrame) -> None:
    """Deletes the results of former stages that are neither held nor read by docs."""
    read = {part for f in docs.inputFiles() for part in f.split("/")}
    held = []
    for found, result in getattr(_RESULTS, "kept", []):
        if found() is not None or any(p.rsplit("/", 1)[-1] in read for p in result.paths):
            held.append((found, result))
        else:
            result.close()
    _RESULTS.kept = held


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _sweep(docs)
        work, result = Steps(spark), Steps(spark)
        try:
            with work:
                found = f(spark, docs, sf_dir)
            with result:
                found = settle(found, f"pipeline-{f.__name__}")
        finally:
            work.close()
        _RESULTS.kept.append((weakref.ref(found), result))
        return found

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return Sampler(docs, quality_labels(spark, sf_dir)).kept_rows()


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are linked from a similarity of 0.8 on."""
    return drop_near_duplicates(docs, PIPELINE_PERCENT)


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are masked; n_chars follows the text."""
    return mask_personal_data(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands as often as the mix takes it: not at all, once, or up to three times."""
    return apply_mix(docs)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality", quality), ("near duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mixing), ("packing", packing)]

#: The quality stage learns a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, apply in STAGES:
        docs = apply(spark, docs, sf_dir)
    _sweep(docs)
    return docs
