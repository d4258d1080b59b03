"""Files in and out: classifier CSV, deployment sheets, table replacement, file listing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trapline.operators import imports as I
from trapline.sources import detections as N
from trapline.sources import sheets as H
from trapline.sources import tables as W

CSV = (
    "﻿filename,date,predictionbase,scorebase,count\n"
    "C:\\cards\\A.JPG,2024:05:01 10:00:00,Fox,0.9,2.0\n"
    "/x/a.jpg,2024:05:01 10:00:00,WOLF,,x\n"
    ",2024:05:01 10:00:00,fox,0.1,1\n"
    "b.jpg,01.05.2024,fox,0.1,1\n"
)


def test_classifier_file(spark, tmp_path):
    (tmp_path / "r.csv").write_text(CSV, encoding="utf-8")
    raw = N.read_raw_detections(spark, str(tmp_path / "r.csv"))
    rows = N.parse_detections(raw).orderBy("line_no").collect()
    assert [(r.original_filename, r.base_label, r.base_score, r.animal_count) for r in rows] == [("A.JPG", "fox", 0.9, 2), ("a.jpg", "wolf", None, None)]
    assert rows[0].captured_at == dt.datetime(2024, 5, 1, 10) and rows[0].human_count is None
    assert [r.bad_date for r in N.rejected_detections(raw).collect()] == ["01.05.2024"]
    # both rows name the same photo; the later one counts
    index = spark.createDataFrame([(7, "a.jpg", dt.datetime(2024, 5, 1, 10), 70, 700)], "location_id int, file_key string, second timestamp_ntz, photo_id long, observation_id long")
    matched = I.match_detections(N.parse_detections(raw).withColumn("location_id", F.lit(7)), index)
    assert [(r.photo_id, r.base_label) for r in I.last_per_photo(matched).collect()] == [(70, "wolf")]


def test_missing_columns_are_named(spark, tmp_path):
    (tmp_path / "r.csv").write_text("filename,date\na,b\n")
    with pytest.raises(ValueError, match="predictionbase, scorebase"):
        N.read_raw_detections(spark, str(tmp_path / "r.csv"))


def test_sheets_of_different_headers(spark, tmp_path):
    (tmp_path / "one.csv").write_text("Deployment_ID,data_usable,latitude,longitude,comment\nA,yes,1.0,2.0,first\nB,no,,,\n")
    (tmp_path / "two.csv").write_text("deployment_id,qc_data_usable,Latitude,Longitude,problem_comment,odd\nA,,1.0,2.0,second,1\n")
    paths = {"one": str(tmp_path / "one.csv"), "two": str(tmp_path / "two.csv")}
    rows = H.read_sheets(spark, paths)
    locations = spark.createDataFrame([(5, "spot", 1.0, 2.0)], "id int, name string, latitude double, longitude double")
    stored = spark.createDataFrame([("A", 9, True)], "name string, location_id int, qc_data_not_usable boolean")
    resolved = I.resolve_deployments(rows, locations)
    merged = {r["name"]: r for r in I.upsert_deployments(stored, resolved).collect()}
    assert (merged["A"].location_id, merged["A"].qc_data_not_usable, merged["A"].qc_comment, merged["A"].change) == (5, False, "second", "updated")
    assert (merged["B"].location_id, merged["B"].qc_data_not_usable, merged["B"].change) == (None, True, "added")
    sheet = spark.read.option("header", True).csv(paths["two"])
    assert H.unmapped_headers(sheet) == ["odd"]


def test_dynamic_replacement_keeps_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 2020), (2, 2021)], "v int, year int")
    W.replace_table(rows, path, "year")
    W.replace_table(rows.where("year = 2021").withColumn("v", F.lit(3)), path, "year")
    assert sorted((r.v, r.year) for r in spark.read.parquet(path).collect()) == [(1, 2020), (3, 2021)]


def test_stored_table_has_the_declared_schema(spark, survey, tmp_path):
    W.replace_table(survey.species, str(tmp_path / "species"))
    stored = W.read_table(spark, str(tmp_path), "species")
    assert stored.schema["scientific_name"].dataType.simpleString() == "string"
    assert stored.select("scientific_name").exceptAll(survey.species.select("scientific_name")).isEmpty()


def test_declared_schemas_parse():
    for name in W.TABLES:
        assert W.table_schema(name).fields


def test_file_listing(spark, tmp_path):
    for name in ("raw/a.jpg", "thumbnails/a.jpg", "raw/b.png"):
        target = tmp_path / name
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(b"12345")
    listed = W.list_files(spark, str(tmp_path), "*.jpg")
    assert sorted((r.name, r.length) for r in listed.collect()) == [("a.jpg", 5), ("a.jpg", 5)]
    assert "content" not in listed.columns


def test_versions_are_whole_or_not_there(spark, tmp_path, monkeypatch):
    path, columns = str(tmp_path / "facts"), "year INT, v INT"
    rows = spark.createDataFrame([(2020, 1), (2021, 1), (2021, 2), (None, 7)], "year int, v int")
    read = lambda **of: sorted(map(tuple, W.committed_table(spark, path, columns, **of).collect()), key=repr)
    assert read() == []
    W.commit_table(rows, path, "year")
    first = sorted([(2020, 1), (2021, 1), (2021, 2), (None, 7)], key=repr)
    assert read() == first
    newer = rows.where("year = 2021").withColumn("v", F.lit(9))
    with monkeypatch.context() as stopped:  # the run ends between the rows and the commit
        stopped.setattr(W, "committed_versions", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            W.commit_table(newer, path, "year")
    assert read() == first
    assert W.commit_table(newer, path, "year") == 1
    second = sorted([(2020, 1), (2021, 9), (2021, 9), (None, 7)], key=repr)
    assert read() == second and read(version=0) == first
    with monkeypatch.context() as slow:  # another writer has taken the number meanwhile
        slow.setattr(W, "committed_versions", lambda *a: [0])
        with pytest.raises(Exception, match="exist"):
            W.commit_table(newer, path, "year")
    assert read() == second
    W.drop_old_versions(spark, path, keep=1)
    assert read() == second and len([p for p in (tmp_path / "facts").iterdir() if p.name.startswith("rows-")]) == 2
    W.commit_table(rows.where("v = 2"), path)
    assert read() == [(2021, 2)]
