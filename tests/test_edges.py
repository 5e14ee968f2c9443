"""Files and streams."""

import json

import pytest

from marginalia.sources import files
from marginalia.streaming import jobs
from pyspark.sql import functions as F


def test_word_list(spark, tmp_path):
    (tmp_path / "w.txt").write_text("﻿; comment\nHill: 44,884\n\nhill\nA\nRoad 66\nBrook\r\n", encoding="utf-8")
    got = {r["term"]: (r["count"], r["risky"]) for r in files.read_word_list(spark, str(tmp_path / "w.txt")).collect()}
    assert got == {"Hill": (44884, False), "A": (None, True), "Road 66": (None, True), "Brook": (None, False)}


def test_keyed_reader_rejects_repeats(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a"}\n{"id": "a"}\n')
    with pytest.raises(Exception, match="repeated key"):
        files.read_keyed(spark, str(tmp_path / "x.jsonl"), "id string", "id").collect()


def test_incremental_annotation_is_once(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "1.json").write_text(json.dumps({"pid": 1, "text": "Hill"}) + "\n")
    annotate = lambda df: df.select("pid", F.length("text").alias("n"))
    for more in (None, 2):
        if more:
            (source / "2.json").write_text(json.dumps({"pid": more, "text": "Brook"}) + "\n")
        q = jobs.annotate_incrementally(spark, str(source), "pid int, text string", annotate, str(sink), str(tmp_path / "ck"))
        q.awaitTermination(60)
    got = sorted((r["pid"], r["n"]) for r in spark.read.schema("pid int, n int").json(f"{sink}/*").collect())
    assert got == [(1, 4), (2, 5)]


def test_csv_columns_and_digest(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "id int, t string")
    files.write_csv(rows, str(tmp_path / "c"), ["t", "gone", "id"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["t", "gone", "id"]
    assert files.digest(rows, "id").first()["sha256"] == files.digest(rows.orderBy("id"), "id").first()["sha256"]
