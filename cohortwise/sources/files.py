"""Reading the eight tables from CSV files or from a folder of Parquet tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.operators.cleaning import (
    drop_if_present, enrich_students, null_outside, to_number, to_timestamp_ntz,
)
from cohortwise.schemas import DIRTY_NUMBERS, DIRTY_TIMES, SCHEMAS
from cohortwise.sources.sinks import current_path
from cohortwise.sources.tables import TABLES, CohortTables

# File names, texts read as missing, index columns left by exports,
# and the longest plausible event in seconds.
FILES = {
    "courses": "courses_clean.csv",
    "groups": "groups_clean.csv",
    "students": "students_clean.csv",
    "grades": "grades_clean.csv",
    "attendance": "attendance_clean.csv",
    "concepts": "concepts_performance_clean.csv",
    "engagement": "engagement_events_clean.csv",
    "submissions": "assignment_submissions_clean.csv",
}
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
STRAY_COLUMNS = ["Unnamed: 0", "_c0", "_id"]
MAX_EVENT_SECONDS = 7200


def read_csv(spark: SparkSession, folder: str, table: str, multi_line: bool = True) -> DataFrame:
    """One CSV table with typed columns.

    Columns are matched by header name. Cells may hold quotes written twice and, unless
    ``multi_line`` is off, line breaks inside quotes; each file is then read by one task,
    so cut large tables into several files or turn it off for files without such cells.
    Columns beyond the declared ones stay as text; declared ones that the file
    lacks are NULL.
    """
    text = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(f"{folder}/{FILES[table]}")
    )
    text = drop_if_present(text, STRAY_COLUMNS)
    text = text.withColumns(
        {c: F.when(~F.col(f"`{c}`").isin(MISSING_TEXTS), F.col(f"`{c}`")) for c in text.columns}
    )
    text = to_number(text, DIRTY_NUMBERS.get(table, []))
    text = to_timestamp_ntz(text, DIRTY_TIMES.get(table, []))
    return _typed(text, SCHEMAS[table])


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    def column(field: T.StructField) -> Column:
        if field.name not in df.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        value = F.col(field.name)
        if isinstance(field.dataType, T.IntegerType):  # "52.0" is a whole number too
            value = value.try_cast("double")
        return value.try_cast(field.dataType).alias(field.name)

    extra = [F.col(f"`{c}`") for c in df.columns if c not in schema.names]
    return df.select(*[column(field) for field in schema.fields], *extra)


def load_files(spark: SparkSession, folder: str) -> CohortTables:
    """The eight CSV tables, cleaned, with students enriched from their groups."""
    frames = {name: read_csv(spark, folder, name) for name in TABLES}
    frames["engagement"] = null_outside(
        frames["engagement"], "duration_seconds", 0, MAX_EVENT_SECONDS
    )
    frames["students"] = enrich_students(frames["students"], frames["groups"], frames["courses"])
    return CohortTables.from_frames(frames)


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table, without the surrogate id column other stores may add."""
    return drop_if_present(spark.read.parquet(current_path(spark, root, name)), ["_id"])


def load_store(spark: SparkSession, root: str) -> CohortTables | None:
    """The stored raw tables, or None unless all are there, with their columns and rows."""
    frames = {}
    for name in TABLES:
        try:
            frames[name] = load_table(spark, root, f"raw_{name}")
        except AnalysisException:
            return None
        if not set(SCHEMAS[name].names) <= set(frames[name].columns):
            return None
        frames[name] = to_number(frames[name], DIRTY_NUMBERS.get(name, []))
        frames[name] = to_timestamp_ntz(frames[name], DIRTY_TIMES.get(name, []))
    if frames["attendance"].isEmpty():
        return None
    return CohortTables.from_frames(frames)


def load_all(spark: SparkSession, folder: str, root: str | None = None) -> CohortTables:
    """Stored tables where complete, CSV files otherwise."""
    stored = load_store(spark, root) if root else None
    return stored or load_files(spark, folder)
