"""Series files: written by many tasks however small they are, and read once."""

import glob
import os

from daygrid.plans.preprocess import validate_and_process
from daygrid.sources import readers, writers

DAYS = range(-1, 3)


def folder(spark, tmp_path):
    path = str(tmp_path / "series")
    rows = [(e, d, float(e + d), None if d == 0 else 1.5) for e in range(40) for d in DAYS]
    writers.write_series_files(spark.createDataFrame(rows, "entity_id long, day int, a double, b double"), path)
    return path


def test_files_are_written_by_many_tasks(spark, tmp_path):
    files = glob.glob(f"{folder(spark, tmp_path)}/entity_id=*/*.csv")
    assert len(files) == 40
    assert len({os.path.basename(f).split("-")[1] for f in files}) > 3


def test_validated_files_are_read_once(spark, tmp_path):
    path = folder(spark, tmp_path)
    _, series = validate_and_process(spark, path, ["a", "b"], -1, 2, entity="folder")
    assert not [f for f in series.inputFiles() if f"{path}/" in f]
    assert not [f for f in readers.read_series_dir(spark, path, "folder").inputFiles() if f"{path}/" in f]
    got = {(r["entity_id"], r["day"], r["channel"]): r["value"] for r in series.collect()}
    assert got == {(e, d, c): v for e in range(40) for d in DAYS for c, v in (("a", float(e + d)), ("b", None if d == 0 else 1.5))}
