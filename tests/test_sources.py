"""CSV and Parquet inputs, replace-table writes, and the full refresh."""

import pytest

from cohortwise.plans.refresh import refresh_all
from cohortwise.sources import files
from cohortwise.sources.sinks import materialize


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """CSV files with quoted JSON, stray columns, reordered headers and bad cells."""
    from school import school

    path = tmp_path_factory.mktemp("csv")
    frames = school()
    frames["courses"]["modules"] = '["Joins & Merges", "Say \\"hi\\", twice"]'
    frames["courses"]["is_active"] = True
    frames["groups"]["stated_num_students"] = ["40.0", "30", "25", "0", "many"]
    frames["engagement"].loc[0, "duration_seconds"] = 7201
    frames["engagement"].loc[1, "duration_seconds"] = "n/a"
    frames["grades"].loc[0, "score"] = "absent"
    frames["attendance"].loc[0, "session_datetime"] = "01/02/2025"
    frames["attendance"] = frames["attendance"][["status", "student_id", "session_datetime", "group_id"]]
    frames["concepts"]["note"] = "kept"
    frames["submissions"].index.name = None
    for name, pdf in frames.items():
        target = path / files.FILES[name]
        if name == "submissions":
            pdf.reset_index(names="Unnamed: 0").to_csv(target, index=False)
        elif name == "grades":
            pdf.to_csv(target)  # unnamed index column first
        else:
            pdf.to_csv(target, index=False)
    return str(path), frames


def test_csv_cells_and_types(spark, folder):
    path, frames = folder
    courses = files.read_csv(spark, path, "courses").collect()
    assert courses[0]["modules"] == frames["courses"]["modules"][0] and courses[0]["is_active"] is True
    groups = {r["group_id"]: r for r in files.read_csv(spark, path, "groups").collect()}
    assert groups["G0"]["stated_num_students"] == 40 and groups["G4"]["stated_num_students"] is None
    assert groups["G0"]["session_day"] is None
    grades = files.read_csv(spark, path, "grades")
    assert "_c0" not in grades.columns
    assert grades.where("score is null").count() == frames["grades"]["score"].isna().sum() + 1
    subs = files.read_csv(spark, path, "submissions")
    assert "Unnamed: 0" not in subs.columns and dict(subs.dtypes)["is_late"] == "boolean"
    assert dict(subs.dtypes)["deadline"] == "timestamp_ntz"
    assert files.read_csv(spark, path, "concepts").select("note").first()[0] == "kept"
    attendance = files.read_csv(spark, path, "attendance")
    assert attendance.columns == ["student_id", "group_id", "status", "session_datetime"]
    missing = frames["attendance"]["session_datetime"].isna().sum() + 1
    assert attendance.where("session_datetime is null").count() == missing


def test_loaded_tables_are_cleaned_and_enriched(spark, folder):
    path, _ = folder
    t = files.load_files(spark, path)
    assert t.get("engagement").where("duration_seconds > 7200").count() == 0
    assert {"course_id", "instructor", "group_name", "course_name"} <= set(t.get("students").columns)
    assert t.get("students").count() == 80


def test_empty_result_keeps_the_old_table(spark, tmp_path):
    root = str(tmp_path)
    full = spark.range(3)
    assert materialize(full, root, "r") and files.load_table(spark, root, "r").count() == 3
    assert not materialize(full.where("id < 0"), root, "r")
    assert files.load_table(spark, root, "r").count() == 3
    assert materialize(full.where("id < 0"), root, "r", skip_empty=False)
    assert files.load_table(spark, root, "r").count() == 0
    with_id = full.selectExpr("id", "id as _id")
    materialize(with_id, root, "s")
    assert files.load_table(spark, root, "s").columns == ["id"]


def test_a_failed_write_keeps_the_old_table(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from cohortwise.sources import sinks

    root = str(tmp_path)
    materialize(spark.range(3), root, "r")
    broken = spark.range(4).withColumn("id", F.when(F.col("id") == 3, F.raise_error(F.lit("halfway")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="halfway"):
        materialize(broken, root, "r")
    assert files.load_table(spark, root, "r").count() == 3

    def crash():
        raise OSError("after the write")

    monkeypatch.setattr(sinks.time, "time_ns", crash)
    with pytest.raises(OSError, match="after the write"):
        materialize(spark.range(5), root, "r")
    monkeypatch.undo()
    assert files.load_table(spark, root, "r").count() == 3
    assert materialize(spark.range(5), root, "r") and files.load_table(spark, root, "r").count() == 5


def test_csv_line_breaks_and_missing_texts(spark, tmp_path):
    lines = ["course_id,course_name,short_description"]
    lines += ['C1,First,"two\nlines, ""quoted"""', "C2,Second,one line"]
    lines += [f"M{i},{text},x" for i, text in enumerate(files.MISSING_TEXTS)]
    (tmp_path / files.FILES["courses"]).write_text("\n".join(lines) + "\n")
    rows = {r["course_id"]: r for r in files.read_csv(spark, str(tmp_path), "courses").collect()}
    assert len(rows) == 2 + len(files.MISSING_TEXTS)
    assert rows["C1"]["short_description"] == 'two\nlines, "quoted"'
    assert all(rows[f"M{i}"]["course_name"] is None for i in range(len(files.MISSING_TEXTS)))


def test_modules_of_a_course(spark, folder):
    from cohortwise.plans.overview import course_modules

    path, _ = folder
    found = [tuple(r) for r in course_modules(files.load_files(spark, path)).collect()]
    assert sorted(found) == sorted(
        (f"C{i}", n, m) for i in range(3) for n, m in ((1, "Joins & Merges"), (2, 'Say "hi", twice'))
    )


def test_refresh_writes_every_table_and_store_is_preferred(spark, folder, tmp_path):
    path, _ = folder
    root = str(tmp_path / "store")
    assert files.load_store(spark, root) is None
    done = refresh_all(spark, files.load_all(spark, path, root), root)
    assert len(done) == 8 + 9 + 24
    assert [n for n, ok in done.items() if not ok] == ["agg_q_q13_sim"]  # smallest group is empty
    stored = files.load_all(spark, path, root)
    assert stored.get("students").count() == 80
    risk = files.load_table(spark, root, "agg_student_risk")
    assert risk.count() == 80
    trend = files.load_table(spark, root, "agg_q_q15_trend")
    assert trend.columns == ["group_id", "group_name", "seq", "score"]


def test_incomplete_store_falls_back_to_files(spark, folder, tmp_path):
    path, _ = folder
    root = str(tmp_path / "part")
    t = files.load_files(spark, path)
    for name in files.TABLES:
        df = t.get(name)
        df = df.drop("status") if name == "attendance" else df
        materialize(df, root, f"raw_{name}")
    assert files.load_store(spark, root) is None
