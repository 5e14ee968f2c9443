"""Selections, relabelling, generated records, look-ups, edit logs and gates, by values worked out by hand."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from marginalia.operators import evaluate as E, workbench as W
from marginalia.sources import files


def test_relabelling(spark):
    spans = spark.createDataFrame([(1, 0, 4, "GPE"), (1, 0, 4, "LOC"), (1, 5, 9, "ORG"), (2, 0, 1, None)], "pid int, start int, end int, label string")
    assert sorted(map(tuple, W.harmonised(spans, {"GPE": "TOPONYM", "LOC": "TOPONYM"}).collect())) == [(1, 0, 4, "TOPONYM", "GPE"), (1, 0, 4, "TOPONYM", "LOC")]
    assert W.harmonised(spans, {}).count() == 0
    assert W.collapsed(spans).count() == 3
    assert W.in_gold(spans, spans.filter("pid = 1")).count() == 3
    made = W.mapped(spans, "label", {" gpe": "place"}, "unknown").orderBy("pid", "start").collect()
    assert sorted(r["label"] for r in made) == ["place", "unknown", "unknown", "unknown"]


def test_selections_and_records(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None)], "d string, t string")
    got = W.selections(rows, {"all": {}, "ax": {"d": "a", "t": "x"}, "y": {"t": "y"}}).collect()
    assert sorted((r["selection"], r["d"], r["t"] or "") for r in got) == [("all", "a", "x"), ("all", "a", "y"), ("all", "b", ""), ("ax", "a", "x"), ("y", "a", "y")]
    made = [r["text"] for r in W.templated(spark, 5, "{a}-{b}", a=["p", "q"], b=["1", "2"]).orderBy("id").collect()]
    assert made == ["p-1", "p-2", "q-1", "q-2", "p-1"]


def test_exact_lookup(spark):
    asked = spark.createDataFrame([(1, "t", "live"), (2, "t", None), (3, "t", None), (4, None, None)], "id int, text string, v string")
    held = spark.createDataFrame([(1, "t", "old"), (2, "t", "b"), (2, "t", "a"), (3, "t ", "c"), (4, None, "d")], "id int, text string, v string")
    got = {r["id"]: (r["v"], r["origin"]) for r in W.exact_lookup(asked, held, "id", "v").collect()}
    assert got == {1: ("live", "live"), 2: ("a", "cached"), 3: (None, "none"), 4: (None, "none")}


def test_edit_log(spark):
    steps = [("add", "a"), ("undo", None), ("undo", None), ("add", "b"), ("add", "c"), ("undo", None), ("add", "d")]
    rows = [("s", i, a, x) for i, (a, x) in enumerate(steps)] + [("t", 0, "add", "z"), ("t", 1, "clear", None)]
    made = spark.createDataFrame(rows, "s string, k int, action string, item string").repartition(3)
    assert {r["s"]: r["kept"] for r in W.surviving(made, "s", "k").collect()} == {"s": ["b", "d"], "t": []}


def test_formal_run(spark):
    rows = spark.createDataFrame([(1, "final"), (2, None)], "id int, status string")
    assert W.formal(rows, F.col("status"), "c", "c", "abc").count() == 2
    for bad in ({"checksum": "d"}, {"commit": ""}, {"subset": True}):
        with pytest.raises(ValueError, match="formal"):
            W.formal(rows, F.col("status"), **({"checksum": "c", "expected": "c", "commit": "abc"} | bad))
    with pytest.raises(Exception, match="not final"):
        W.formal(rows.withColumn("status", F.lit("PROVISIONAL-2")), F.col("status"), "c", "c", "abc").collect()


def test_objects_and_sinks(spark, tmp_path):
    texts = spark.createDataFrame([(1, "Über"), (2, None)], "pid int, text string")
    spans = spark.createDataFrame([(1, 2, 3, "B"), (1, 0, 1, "A")], "pid int, start int, end int, label string")
    got = {r["pid"]: json.loads(r["json"]) for r in W.as_objects(texts, spans).collect()}
    assert [s["label"] for s in got[1]["spans"]] == ["A", "B"] and got[1]["text_sha256"] == hashlib.sha256("Über".encode()).hexdigest()
    assert got[2]["spans"] == []
    W.write_gazetteer(spark.createDataFrame([("b", "Y"), ("A", "Y"), ("c", "X")], "text string, label string").coalesce(1), str(tmp_path / "g"))
    assert [r["text"] for r in spark.read.csv(str(tmp_path / "g"), header=True).collect()] == ["c", "A", "b"]
    W.write_sample(texts, str(tmp_path / "s"), 5)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "s")).collect()] == ["Über"]


def test_digest_is_of_the_sorted_lines(spark):
    rows = spark.createDataFrame([(2, "b"), (1, "ä"), (1, "a")], "id int, t string").repartition(3)
    want = hashlib.sha256('{"id":1,"t":"a"}\n{"id":1,"t":"ä"}\n{"id":2,"t":"b"}'.encode()).hexdigest()
    assert files.digest(rows, "id").first()["sha256"] == want
    assert files.digest(rows.limit(0), "id").first()["sha256"] == hashlib.sha256(b"").hexdigest()


def test_holdout_split_of_a_large_category(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, null, 'k') as k", "cast(id * 7 % 3000 as double) as o").repartition(5)
    got = E.holdout_split(rows, "k", "o").collect()
    assert len(got) == 3000 and set(got[0].asDict()) == {"id", "k", "o", "split"}
    for k in (None, "k"):
        own = sorted((r for r in got if r["k"] == k), key=lambda r: r["o"])
        assert [r["split"] for r in own] == ["dev" if i % 15 >= 12 else "train" for i in range(len(own))]
    assert E.holdout_split(rows.withColumn("o", F.col("o").cast("string")), "k", "o").count() == 3000
    assert E.holdout_split(rows.limit(0), "k", "o").count() == 0
