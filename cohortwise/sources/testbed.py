"""The eight tables derived from a star schema of orders, line items and events.

region -> courses, nation -> groups, customer -> students, orders -> grades,
lineitem -> attendance, concept results and submissions, events -> engagement.
Look-ups are left joins on unique keys, so a look-up whose columns are not
requested can be left out without changing a row. Orders meet customers before
line items, so the line items are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.operators.cleaning import null_outside
from cohortwise.sources.tables import CohortTables

# Event names of the star schema and what they stand for.
EVENT_NAMES = {
    "click": "login",
    "view": "video_watch",
    "purchase": "resource_download",
    "signup": "forum_post",
}

# Prices reach about 500,000; a prime scale keeps mean scores off rounding ties.
SCORE_SCALE = 5003
BONUS = 200.0


# Declared, so that opening a table starts no job to read file footers.
STAR_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_brand STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_returnflag STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE",
}


def read_star(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


class _Testbed:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return read_star(self.spark, self.folder, name)

    def courses(self, columns=()) -> DataFrame:
        key, name = F.col("r_regionkey"), F.col("r_name")
        modules = F.transform(F.sequence(F.lit(1), key + 2), lambda i: F.concat(name, F.lit(' "'), i, F.lit('"')))
        return self.read("region").select(
            key.alias("course_id"), name.alias("course_name"), F.to_json(modules).alias("modules")
        )

    def groups(self, columns=()) -> DataFrame:
        key = F.col("n_nationkey")
        return self.read("nation").select(
            key.alias("group_id"),
            F.col("n_name").alias("group_name"),
            F.col("n_regionkey").alias("course_id"),
            (key * 4 + 50).alias("stated_num_students"),
            F.concat(F.lit("I"), (key % 4).cast("string")).alias("instructor"),
        )

    def students(self, columns=()) -> DataFrame:
        key = F.col("c_custkey")
        df = self.read("customer").select(
            key.alias("student_id"),
            F.col("c_name").alias("full_name"),
            (key % 20 + 17).cast("double").alias("age"),
            F.col("c_mktsegment").alias("city"),
            F.col("c_nationkey").alias("group_id"),
        )
        wanted = set(columns)
        if wanted & {"group_name", "course_id", "instructor", "course_name"}:
            df = df.join(self.groups().drop("stated_num_students"), "group_id", "left")
        if "course_name" in wanted:
            df = df.join(self.courses().drop("modules"), "course_id", "left")
        return df

    def _owners(self, columns: set[str]) -> DataFrame:
        """Orders with the student who placed them, and their group and course."""
        df = self.read("orders").select(
            F.col("o_orderkey").alias("assessment_id"),
            F.col("o_custkey").alias("student_id"),
            F.col("o_totalprice"),
            F.col("o_orderdate"),
            F.col("o_orderpriority"),
        )
        if columns & {"group_id", "course_id"}:
            member = self.students(("student_id", "group_id")).select("student_id", "group_id")
            df = df.join(member, "student_id", "left")
        if "course_id" in columns:
            df = df.join(self.groups().select("group_id", "course_id"), "group_id", "left")
        return df

    def grades(self, columns=()) -> DataFrame:
        # Some scores are far above 100, so that outliers and overflow bins are met.
        bonus = F.when(F.col("assessment_id") % 500 == 0, BONUS).otherwise(0.0)
        return self._owners(set(columns)).select(
            "*",
            (F.col("o_totalprice") / SCORE_SCALE + bonus).alias("score"),
            F.col("o_orderdate").alias("date"),
            F.col("o_orderpriority").alias("type"),
        )

    def _lines(self, wanted: set[str], owned: set[str]) -> DataFrame:
        df = self.read("lineitem").withColumnRenamed("l_orderkey", "assessment_id")
        if wanted & owned:
            df = df.join(self._owners(wanted), "assessment_id", "left")
        return df

    def attendance(self, columns=()) -> DataFrame:
        wanted = set(columns)
        return self._lines(wanted, {"student_id", "group_id"}).select(
            "*",
            F.when(F.col("l_returnflag") == "R", "absent").otherwise("attended").alias("status"),
            F.col("l_shipdate").alias("session_datetime"),
        )

    def concepts(self, columns=()) -> DataFrame:
        wanted = set(columns)
        quantity = F.col("l_quantity")
        df = self._lines(wanted, {"student_id", "course_id"})
        if "concept_name" in wanted:
            brands = self.read("part").select(
                F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("concept_name")
            )
            df = df.join(brands, "l_partkey", "left")
        return df.select(
            "*",
            (quantity * 2).alias("score_pct"),
            F.when(quantity < 20, "failed")
            .when(quantity < 45, "passed")
            .otherwise("in_progress")
            .alias("mastery_status"),
            F.col("l_shipdate").alias("timestamp"),
        )

    def engagement(self, columns=()) -> DataFrame:
        kind = F.col("event_type")
        named = kind
        for source, target in EVENT_NAMES.items():
            named = F.when(kind == source, target).otherwise(named)
        df = self.read("events").select(
            F.col("user_id").alias("student_id"),
            named.alias("event_type"),
            F.col("ts").alias("event_datetime"),
            (F.col("value") * 30).alias("duration_seconds"),
        )
        return null_outside(df, "duration_seconds", 0, 7200)

    def submissions(self, columns=()) -> DataFrame:
        wanted = set(columns)
        late_by = (F.col("l_partkey") * 7 + F.col("l_linenumber")) % 601 - 300
        submitted = F.timestamp_add("HOUR", late_by.cast("int"), F.col("o_orderdate"))
        df = self._lines(wanted, {"student_id", "deadline", "submitted_at"}).withColumn(
            "is_late", late_by > 0
        )
        if "o_orderdate" in df.columns:
            df = df.withColumns({"deadline": F.col("o_orderdate"), "submitted_at": submitted})
        return df


COLUMNS = {
    "courses": ["course_id", "course_name"],
    "groups": ["group_id", "group_name", "course_id", "stated_num_students", "instructor"],
    "students": [
        "student_id", "full_name", "age", "city", "group_id",
        "course_id", "instructor", "group_name", "course_name",
    ],
    "grades": [
        "assessment_id", "student_id", "group_id", "course_id", "type", "score", "date",
    ],
    "attendance": ["student_id", "group_id", "status", "session_datetime"],
    "concepts": [
        "student_id", "course_id", "concept_name", "mastery_status", "score_pct", "timestamp",
    ],
    "engagement": ["student_id", "event_type", "event_datetime", "duration_seconds"],
    "submissions": ["assessment_id", "student_id", "deadline", "submitted_at", "is_late"],
}


def open_testbed(spark: SparkSession, folder: str) -> CohortTables:
    bed = _Testbed(spark, folder)

    def provider(name: str):
        def provide(columns: tuple[str, ...]) -> DataFrame:
            chosen = columns or tuple(COLUMNS[name])
            return getattr(bed, name)(chosen).select(*chosen)

        return provide

    return CohortTables({name: provider(name) for name in COLUMNS})
