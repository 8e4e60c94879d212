"""Results that several jobs read, in the folder that all executors share."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that Spark hands to Python at a time while a step is written, so that two tasks of an executor stay small beside its heap.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
#: What holds while a step is written. Its shuffle files go when it stands, not when the driver happens to collect its garbage: later jobs read the step.
SETTINGS = BATCHES | {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: The piece of work that notes the steps now being made, in this thread.
_WORK: ContextVar[Steps | None] = ContextVar("work", default=None)
_LOCK = threading.Lock()
#: For each session that writes steps: how many are being written, and its own settings.
_WRITING: dict[int, tuple[int, dict[str, str]]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, one in the warehouse; a warehouse on one machine's disk will do for a local run only."""
    if at := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        return at
    at = f"{spark.conf.get('spark.sql.warehouse.dir')}/_steps"
    if at.split(":")[0] in (at, "file") and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"executors do not share {at}: set spark.checkpoint.dir to a folder that they do")
    return at


@contextmanager
def _step_settings(spark: SparkSession) -> Iterator[None]:
    """For the jobs started inside; the session's own settings stand again once no thread of it writes a step."""
    with _LOCK:
        n, before = _WRITING.get(id(spark), (0, {}))
        if not n:
            before = {k: spark.conf.get(k) for k in SETTINGS}
            for k, v in SETTINGS.items():
                spark.conf.set(k, v)
        _WRITING[id(spark)] = n + 1, before
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITING.pop(id(spark))
            if n > 1:
                _WRITING[id(spark)] = n - 1, before
            else:
                for k, v in before.items():
                    spark.conf.set(k, v)


class Steps:
    """The folders that one piece of work writes: those settled inside `with`. close() deletes them, once no result is read from them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self._tokens = spark, [], []

    def __enter__(self) -> Steps:
        self._tokens.append(_WORK.set(self))
        return self

    def __exit__(self, *failure) -> None:
        _WORK.reset(self._tokens.pop())

    def close(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        while self.paths:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(conf).delete(path, True)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and reread it: later jobs neither recompute it nor depend on executors.

    The files stay, as results may still be read from them; `Steps` notes them and takes them away when the work is done.
    """
    at = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if (work := _WORK.get()) is not None:
        work.paths.append(at)
    with _step_settings(df.sparkSession):
        df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
