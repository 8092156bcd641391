"""Writing results: versions of Parquet tables, the current one named by a list."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VERSIONS = "name string, version string, written_ns long"


def _list_path(root: str, name: str) -> str:
    return f"{root}/_versions/{name}"


def current_path(spark: SparkSession, root: str, name: str) -> str:
    """Folder of the table's newest version; the plain folder if it has no versions."""
    try:
        listed = spark.read.schema(_VERSIONS).parquet(_list_path(root, name))
        newest = listed.agg(F.max(F.struct("written_ns", "version")).alias("v")).first()["v"]
    except AnalysisException:
        newest = None
    return f"{root}/{name}" if newest is None else f"{root}/{name}/{newest['version']}"


def materialize(df: DataFrame, root: str, name: str, skip_empty: bool = True) -> bool:
    """Replace table ``name`` by ``df``; an empty result leaves the old table in place.

    Every call writes a folder of its own. When it is complete, one row is appended to the
    table's list of versions, and readers take the newest listed one. A run that fails before
    leaves the old version current; nothing is ever renamed or deleted, so older versions can be
    removed by whoever owns the store.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    path = f"{root}/{name}/{version}"
    df.write.parquet(path)
    if skip_empty and spark.read.schema(df.schema).parquet(path).isEmpty():
        return False
    row = spark.createDataFrame([(name, version, time.time_ns())], _VERSIONS)
    row.coalesce(1).write.mode("append").parquet(_list_path(root, name))
    return True
