"""Reports as files: committed as a whole, or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from textquarry.sources.report_files import file_of, folder_of, write_reports


def files(path):
    return {os.path.relpath(os.path.join(at, f), path) for at, _, names in os.walk(path) for f in names}


def test_one_file_a_report_in_bounded_folders(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = spark.range(60).select(F.concat(F.lit("app/"), "id").alias("name"), F.concat(F.lit("täxt "), "id").alias("content")).repartition(5)
    write_reports(rows, path, folders=3)
    want = {f"{folder_of(f'app/{k}', 3)}/app_{k}.md" for k in range(60)}
    assert files(f"{tmp_path}/out") == want
    assert {x.split("/")[0] for x in want} <= {"0000", "0001", "0002"}
    one = f"{folder_of('app/7', 3)}/app_7.md"
    assert (tmp_path / "out" / one).read_text() == "täxt 7"
    write_reports(rows.filter("name = 'app/7'").withColumn("content", F.lit(None).cast("string")), path, folders=3)
    assert files(f"{tmp_path}/out") == {one} and (tmp_path / "out" / one).read_text() == ""
    write_reports(rows.limit(0), path)
    assert files(f"{tmp_path}/out") == set()


def test_an_aborted_job_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = spark.range(40).select(F.col("id").cast("string").alias("name"), F.lit("x").alias("content")).repartition(4)
    write_reports(rows, path, folders=2)
    before = files(f"{tmp_path}/out")
    broken = rows.withColumn("content", F.when(F.col("name") == "17", F.raise_error(F.lit("no report"))).otherwise("y"))
    with pytest.raises(Exception, match="no report"):
        write_reports(broken, path, folders=2)
    assert files(f"{tmp_path}/out") == before
    assert (tmp_path / "out" / folder_of("3", 2) / "3.md").read_text() == "x"


def test_names_stay_in_their_folder():
    assert [file_of(x) for x in ("../../etc", "..", "", "a b-c_d.e", "é漢")] == ["_.._etc", "_", "_", "a b-c_d.e", "é漢"]
