"""Writing the tables of an analysis, all or none of them.

A run writes every table under a version of its own and names the version in the manifest last, for the keys (repository and commit) that it replaces. Readers go
by the manifest, so they see a key's former rows in all tables until that one small file stands, and its new ones in all tables from then on; a run that dies
before leaves nothing that is read.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["repo_id", "commit_sha"]
MANIFEST = "repo_id string, commit_sha string, version string, at long"


def write_graph(tables: dict[str, DataFrame], path: str, keys: DataFrame | None = None) -> str:
    """Writes the tables (each with repo_id and commit_sha) and switches their keys over to them; gives the version. keys: what is replaced, if not just what has rows."""
    version = uuid.uuid4().hex
    for name, table in tables.items():
        table.write.partitionBy(*KEY).parquet(f"{path}/{name}/version={version}")
    spark = next(iter(tables.values())).sparkSession
    if keys is None:
        keys = reduce(DataFrame.union, [_version(spark, path, name, version, t.schema).select(*KEY) for name, t in tables.items()])
    named = keys.select(*KEY).distinct().select(*[F.col(k).cast("string").alias(k) for k in KEY], F.lit(version).alias("version"), F.lit(time.time_ns()).alias("at"))
    named.coalesce(1).write.mode("append").parquet(f"{path}/_manifest")
    return version


def _version(spark: SparkSession, path: str, name: str, version: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}/version={version}")


def current(spark: SparkSession, path: str) -> DataFrame:
    """repo_id, commit_sha, version: the last version of each key. Of runs at once for a key the later switch wins."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")
    return manifest.groupBy(*KEY).agg(F.max_by("version", F.struct("at", "version")).alias("version"))


def read_graph(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of a table that are current. Version and key are folders, so what has been replaced is not opened."""
    rows = spark.read.parquet(f"{path}/{name}")
    return rows.join(current(spark, path), [*KEY, "version"], "left_semi").drop("version")


def remove_replaced(spark: SparkSession, path: str, names: list[str]) -> int:
    """Deletes the versions that no key points to any more, once no reader is on them; gives their number."""
    all_of, now = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest").select("version").distinct(), current(spark, path).select("version").distinct()
    old = [r.version for r in all_of.join(now, "version", "left_anti").collect()]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for version in old:
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/version={version}")
            at.getFileSystem(conf).delete(at, True)
    return len(old)
