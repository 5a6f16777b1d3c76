"""Small inputs with known results, typed in as rows."""

import pytest
from pyspark.sql import functions as F

from daygrid.functions import recode as R
from daygrid.operators import profile, quality
from daygrid.plans.preprocess import process_series, standardize_static, validate_and_process, validate_series
from daygrid.session import durable
from daygrid.sources import readers, writers

# An invented table: every value and its standard form were worked out by hand.
RAW = """\
ID,Years,Gender,Group,Load,Marrow,Mass,Outside,Stage,Lines,Earlier,Again,Molecule,Kind,Day,Grade,Late grade
1,31,female,xALL,12.5,活跃,有,0,II,1,无,否,CD28,CD7 single target,2023/1/2 0:00,1.0,NA
2,64,male,other,0,极度减低,无,5,NA,2,自体,是,41BB,CD19+CD22,2023-11-30,0,2
3,50,male,,NA,明显活跃,无,1,IV,7,异体,否,41BB+CD28,single target cocktail,2023/12/31 8:05:09,5,3.0
"""
RECODING = {
    "Gender": lambda c: R.recode(c, R.SEX), "Group": R.disease_group, "Marrow": lambda c: R.recode(c, R.CELLULARITY),
    "Mass": lambda c: R.recode(c, R.PRESENT), "Outside": R.extranodal_level, "Stage": lambda c: R.recode(c, R.STAGE),
    "Lines": R.therapy_line_level, "Earlier": lambda c: R.recode(c, R.PRIOR_HSCT), "Again": lambda c: R.recode(c, R.YES_NO),
    "Molecule": lambda c: R.recode(c, R.COSTIMULATORY), "Kind": lambda c: R.recode(c, R.CONSTRUCT),
    "Day": R.normalize_date, "Grade": R.grade_to_int, "Late grade": R.grade_to_int,
}
NAMES = {"Group": "Disease", "Load": "L"}
INTEGERS = ["ID", "Years", "Gender", "Marrow", "Mass", "Outside", "Stage", "Lines", "Again", "Grade", "Late_grade"]
STANDARD = [
    (1, 31, 1, "ALL", 12.5, 2, 1, 0, 2, 1, "HSCT_No_Prior", 0, "CD28", "Single", "2023-01-02", 1, None),
    (2, 64, 0, "B-NHL", 0.0, 0, 0, 2, None, 2, "HSCT_Autologous", 1, "41BB", "Tandem", "2023-11-30", 0, 2),
    (3, 50, 0, None, None, 3, 0, 1, 4, 4, "HSCT_Allogeneic", 0, "41BB+CD28", "Cocktail", "2023-12-31", 5, 3),
]
RULES = [
    quality.Rule("ID", "integer", 1, 10), quality.Rule("Years", "integer", 0, 120, usual=(18, 60)),
    quality.Rule("Gender", "category", categories=("male", "female")), quality.Rule("Load", "float", 0, 100),
    quality.Rule("Stage", "category", categories=("NA", "I", "II", "III", "IV")),
    quality.Rule("Grade", "number_category", categories=("0", "1", "2", "3", "4")), quality.Rule("Day", "date"),
]


@pytest.fixture()
def raw_static(spark, tmp_path):
    (tmp_path / "static.csv").write_text(RAW, encoding="utf-8")
    return readers.read_static_raw(spark, str(tmp_path / "static.csv"))


def standard(raw):
    return standardize_static(raw, RECODING, NAMES, INTEGERS, ["L"])


def test_static_chain(raw_static):
    out = standard(raw_static).orderBy("ID")
    assert out.columns[3:6] == ["Disease", "L", "Marrow"] and out.columns[-1] == "Late_grade"
    assert [tuple(r) for r in out.collect()] == STANDARD


def test_static_rules(raw_static):
    found = {(r["row_id"], r["column"], r["issue"]) for r in quality.check_rules(raw_static, RULES, "ID").collect()}
    assert found == {("2", "Years", "range_warning"), ("3", "Grade", "categorical_error"), ("3", "Load", "type_error")} or \
        found == {("2", "Years", "range_warning"), ("3", "Grade", "categorical_error")}
    assert quality.check_id_continuity(raw_static, "ID").count() == 0


def test_description(raw_static):
    got = {r["variable"]: r for r in profile.describe(standard(raw_static), ["Years", "L"]).collect()}
    assert round(got["Years"]["mean"], 3) == 48.333 and got["Years"]["median"] == 50.0
    assert got["L"]["mean"] == 6.25 and round(got["L"]["std"], 4) == 8.8388


def test_partition_integrity(spark, raw_static):
    table = standard(raw_static)
    series = spark.createDataFrame([(1,), (2,), (2,)], "ID long")
    rows = quality.check_partition_integrity(table, series, "Disease", ["ALL", "B-NHL"], "ID").collect()
    assert {tuple(r) for r in rows} == {("ALL", 1, 1, 0), ("B-NHL", 1, 1, 0), ("other", 1, 0, 1)}
    missing = quality.with_series_flag(table, series, "ID").where("not has_series")
    assert [r["ID"] for r in missing.collect()] == [3]


def test_unknown_group_counts_as_other(spark):
    table = spark.createDataFrame([(1, "ALL"), (2, "AML")], "ID int, Disease string")
    series = spark.createDataFrame([(2,)], "ID int")
    rows = quality.check_partition_integrity(table, series, "Disease", ["ALL"], "ID").collect()
    assert {tuple(r) for r in rows} == {("ALL", 1, 0, 1), ("other", 1, 1, 0)}


def series_folder(tmp_path):
    folder = tmp_path / "series"
    folder.mkdir()
    (folder / "1.csv").write_bytes(b'"",A001,B001\r\n-1,1.5,NA\r\n0,NA,7\r\n1,2.5,bad\r\n')
    # lacks a column: a positional schema would shift its values
    (folder / "2.csv").write_bytes(b"day,B001\n-1,7\n0,8\nx,9\n")
    (folder / "notes.csv").write_bytes(b"day,A001\n-1,99\n")
    return str(folder)


def test_series_files_bind_by_header(spark, tmp_path):
    rows = readers.read_series_dir(spark, series_folder(tmp_path)).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(
        [(1, -1, "A001", 1.5), (1, -1, "B001", None), (1, 0, "A001", None), (1, 0, "B001", 7.0),
         (1, 1, "A001", 2.5), (1, 1, "B001", None), (2, -1, "B001", 7.0), (2, 0, "B001", 8.0)], key=repr,
    )


def test_series_validation(spark, tmp_path):
    lines = durable(readers.read_series_lines(spark, series_folder(tmp_path)))
    report = validate_series(lines, ["A001", "B001"], -1, 1)
    name = F.regexp_extract("file", r"(\d+)\.csv$", 1).alias("f")
    assert [(r["f"], r["kind"], r["column"]) for r in report.column_findings.select(name, "*").collect()] == [
        ("2", "missing_column", "A001")
    ]
    assert [(r["channel"], r["raw"]) for r in report.bad_cells.collect()] == [("B001", "bad")]
    assert {(r["f"], r["rule"], r["expected"], r["actual"]) for r in report.count_findings.select(name, "*").collect()} == {
        ("2", "column_count", 2, 1)
    }
    assert [r["f"] for r in report.day_findings.select(name).collect()] == ["2"]
    assert {r["f"]: r["valid"] for r in report.verdicts.select(name, "valid").collect()} == {"1": False, "2": False}
    assert not quality.any_valid(report.verdicts)


def test_gate_and_day_order(spark, tmp_path):
    folder = tmp_path / "g"
    folder.mkdir()
    (folder / "1.csv").write_text("day,A001\n0,1\n1,2\n2,3\n")
    (folder / "2.csv").write_text("day,A001\n1,4\n0,5\n2,6\n")
    (folder / "3.csv").write_text("day,A001\n0,7\n1,bad\n2,9\n")
    report, series = validate_and_process(spark, str(folder), ["A001"], 0, 2)
    name = F.regexp_extract("file", r"(\d+)\.csv$", 1).alias("f")
    assert [(r["f"], r["n_misplaced"]) for r in report.day_findings.select(name, "*").collect()] == [("2", 2)]
    assert {r["entity_id"] for r in series.collect()} == {1, 2}  # a warning does not stop a file
    (folder / "1.csv").write_text("day,A001\n0,bad\n")
    (folder / "2.csv").write_text("day,A001\n0,bad\n")
    with pytest.raises(ValueError, match="no valid"):
        validate_and_process(spark, str(folder), ["A001"], 0, 2)


def test_dropped_and_renumbered_channels(spark, tmp_path):
    folder = tmp_path / "s"
    folder.mkdir()
    (folder / "7.csv").write_text("day,CBC001,CBC002,CBC003,VCN001,CBCx\n0,1,2,3,4,5\n")
    out = process_series(spark, str(folder), {"CBC": [1], "VCN": [1]}, ["CBC"])
    assert {(r["channel"], r["value"]) for r in out.collect()} == {("CBC001", 2.0), ("CBC002", 3.0), ("CBCx", 5.0)}


def test_availability_fractions(spark):
    rows = [(1, -9, "CBC001", 1.0), (2, -6, "CBC002", 1.0), (1, -6, "CBC001", 2.0), (1, -6, "CBC003", 2.0),
            (2, -6, "Coagulation001", 3.0), (1, -6, "Coagulation002", 3.0), (1, -5, "CBC001", None)]
    series = spark.createDataFrame(rows, "entity_id int, day int, channel string, value double")
    groups = {g: [f"{g}{i:03d}" for i in range(1, n + 1)] for g, n in quality.CHANNEL_GROUPS.items()}
    long = profile.availability(series, groups, -15, 30, 2)
    assert long.count() == 8 * 46
    got = {(r["group"], r["day"]): (r["fraction"], r["missing_pct"]) for r in long.where("fraction > 0").collect()}
    assert got == {("CBC", -9): (0.5, 50), ("CBC", -6): (1.0, 0), ("Coagulation", -6): (1.0, 0)}
    matrix = profile.availability_matrix(long, -15, 30)
    assert len(matrix.columns) == 47 and matrix.count() == 8


def test_static_reader_binds_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,ID,a\nNA,1,x\n2.5,2,\njunk,3,z\n")
    df = readers.read_static(spark, str(tmp_path / "t.csv"), "ID int, a string, b double, c int")
    assert [tuple(r) for r in df.orderBy("ID").collect()] == [(1, "x", None, None), (2, None, 2.5, None), (3, "z", None, None)]


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x"), (2, 2.0, None)], "id int, v double, s string")
    writers.write_table(df, str(tmp_path / "out"))
    back = readers.read_static(spark, str(tmp_path / "out"), "id int, v double, s string")
    assert sorted(map(tuple, back.collect())) == [(1, None, "x"), (2, 2.0, None)]
