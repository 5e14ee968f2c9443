"""Evaluation, panel and catalogue operators on small cases with known answers."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import annotators as A, evaluate as E, votes as V
from marginalia.sources import catalogue as C


def test_micro_macro_empty_is_one(spark):
    rows = spark.createDataFrame([("a", 1, 1, 0), ("a", 0, 0, 0), ("b", 0, 0, 0)], "m string, tp long, fp long, fn long")
    got = {r["m"]: r for r in E.micro_macro(rows, "m").collect()}
    assert got["a"]["micro_precision"] == 0.5 and got["a"]["macro_precision"] == 0.75 and got["b"]["micro_f1"] == 1.0


def test_majority_needs_half_of_all_voters(spark):
    votes = spark.createDataFrame([(1, "a", "X"), (1, "b", "X"), (2, "a", "X")], "item int, voter string, label string")
    gold = spark.createDataFrame([(1, "X"), (2, "REJECT")], "item int, gold string")
    assert E.majority_accuracy(votes, gold, 3).first()["accuracy"] == 1.0


def test_extremes_of_ties_and_of_nothing(spark):
    pairs = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.5), ("b", "c", 0.25)], "voter_a string, voter_b string, agreement double")
    got = {r["kind"]: (r["voter_a"], r["voter_b"], r["agreement"]) for r in E.extremes(pairs).collect()}
    assert got == {"most": ("a", "b", 0.5), "least": ("b", "c", 0.25)}
    assert E.extremes(pairs.filter("false")).count() == 0


def test_prediction_status_and_gate(spark):
    records = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, text string")
    made = spark.createDataFrame([(1, hashlib.sha256(b"x").hexdigest()), (2, "0"), (9, "0")], "id int, source_sha256 string")
    assert {r["id"]: r["status"] for r in E.prediction_status(records, made).collect()} == {1: "ok", 2: "changed", 3: "missing", 9: "unknown"}
    assert E.gate(records, F.col("text") == "none", "provisional rows").count() == 3
    with pytest.raises(Exception, match="provisional rows"):
        E.gate(records, F.col("text") == "y", "provisional rows").collect()


def test_usage_keeps_null(spark):
    rows = spark.createDataFrame([(1000000, 500000), (None, 5)], "i long, o long")
    assert [r[0] for r in rows.select(E.token_cost(F.col("i"), F.col("o"), 4.0, 20.0)).collect()] == [14.0, None]


def test_panel_resumes_and_records_faults(spark):
    passages = spark.createDataFrame([(1, "ab"), (2, None), (3, "boom")], "pid long, text string")

    def first(text):
        if text == "boom":
            raise ValueError("no")
        return [{"start": 0, "end": 1, "label": "L"}]

    done = spark.createDataFrame([(1, "far")], "pid long, voter string")
    got = {(r["pid"], r["voter"]): (len(r["spans"]), r["error"]) for r in A.run_panel(passages, {"first": first, "far": lambda t: [{"start": 0, "end": 99, "label": "L"}]}, done).collect()}
    assert got[1, "first"] == (1, None) and got[3, "first"] == (0, "ValueError: no") and (1, "far") not in got
    assert got[2, "first"][1] == "ValueError: offsets outside the text" and got[3, "far"][0] == 0 and len(got) == 5


def test_parsed_answers_and_loading():
    assert A.parsed('```json\n{"spans": [{"start": 1}]}\n```') == [{"start": 1}] and A.parsed("[]") == []
    assert A.load("marginalia.operators.annotators:parsed") is A.parsed
    with pytest.raises(ValueError):
        A.parsed("not json")


def test_interval_operators(spark):
    rows = lambda x: spark.createDataFrame(x, "pid int, start int, end int")
    spans, taken = rows([(1, 0, 5), (1, 5, 9), (2, 0, 5)]), rows([(1, 4, 5), (1, 4, 5)])
    assert sorted(map(tuple, A.suppressed(spans, taken).collect())) == [(1, 5, 9), (2, 0, 5)]
    assert sorted(map(tuple, A.gold_label(spans, taken).collect())) == [(1, 0, 5, "PLACE"), (1, 5, 9, "REJECT"), (2, 0, 5, "REJECT")]


def test_snap_tokens_and_phrases(spark):
    row = spark.createDataFrame([("über Zürich, now", 6, 8), ("a b", 0, 1)], "text string, s int, e int")
    start, end = A.snapped(F.col("text"), F.col("s"), F.col("e"))
    assert [tuple(r) for r in row.select(start, end).collect()] == [(5, 11), (0, 1)]
    tokens = spark.createDataFrame([(1, 0, 0, 3, "The"), (1, 1, 4, 9, "Lake,")], "pid int, pos int, start int, end int, word string")
    assert tuple(A.span_of_tokens(tokens, F.lit(1), F.lit(0)).first()) == (1, 0, 8)
    passages = spark.createDataFrame([(1, "é lake lake")], "pid int, text string")
    phrases = spark.createDataFrame([(1, "lake", "L"), (1, "sea", "L"), (1, "", "L")], "pid int, phrase string, label string")
    assert {r["phrase"]: (r["start"], r["end"]) for r in A.find_phrases(passages, phrases).collect()} == {"lake": (2, 6), "sea": (None, None), "": (None, None)}


def test_systems_of_a_passage(spark):
    spans = spark.createDataFrame([(1, "b", 4, 6, "L"), (1, "b", 0, 2, "L"), (1, "a", 0, 2, "L")], "pid int, voter string, start int, end int, label string")
    got = A.by_system(spans).first()["systems"]
    assert [s["start"] for s in got["b"]] == [0, 4] and list(got) == ["a", "b"]


@pytest.mark.parametrize(
    ("quote", "passage", "reason"),
    [
        ("", "x", "empty"), (None, "x", "empty"), ("lake", "the lake", "present_but_exhausted"), ("so", "ſo", "long_s_normalised"), ("The “Lake”", 'the "lake"', "other_normalisation"),
        ("'lake';", "the lake side", "whitespace_or_punctuation"), ("side lake", "lake by the side", "words_present_reordered_or_gapped"), ("sea", "lake", "not_in_passage_at_all"),
        ("lake, side", "lakeside", "not_in_passage_at_all"), ("cafe", "the Café", "other_normalisation"), ("a\u2012b", "x a-b", "other_normalisation"), ("houſe  of", "the house of", "other_normalisation"),
    ],
)
def test_miss_reason(spark, quote, passage, reason):
    row = spark.createDataFrame([(quote, passage)], "q string, p string")
    assert row.select(T.miss_reason(F.col("q"), F.col("p"))).first()[0] == reason


def test_text_checks(spark):
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]
    flagged = ("The end", "a Forêt", "The Keswick", "two lakes", "three miles", "an hours walk", "flakes", "12 feet", "valleys")
    assert [one(x, T.is_positive) for x in flagged] == [False, False, True, True, True, True, False, False, False]
    assert one("hé\n", T.git_blob_id) == hashlib.sha1(b"blob 4\0h\xc3\xa9\n").hexdigest()
    assert one("  On  Foot ", lambda t: T.match_key(t, {"on foot": "foot"})) == "foot" and one(" ", T.match_key) is None
    assert [one(x, lambda t: T.transient(t, ["timeout", "503"])) for x in ("HTTP 503", "bad key", None)] == [True, False, False]
    terms = ("sea", "Plumber", "boatman", "harbour", "chamber", "cloister", "old boatman", "gatekeeper")
    assert [one(x, T.risky_term) for x in terms] == ["short", "denied", "person", None, None, None, None, "person"]


def test_catalogue(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿Filename, Author\na.txt, A B \nb.txt,\n", encoding="utf-8")
    manifest = C.read_manifest(spark, str(tmp_path / "m.csv"))
    passages = spark.createDataFrame([("a",), ("b",), ("c",)], "stem string")
    got = {r["stem"]: (r["Author"], r["in_manifest"]) for r in C.with_manifest(passages, manifest, {"Author": "unknown"}).collect()}
    assert got == {"a": ("A B", True), "b": ("unknown", True), "c": ("unknown", False)}
    (tmp_path / "y.csv").write_text("id,year\na,1800\nb,n/a\nc,1,2\n")
    assert {r["key"]: r["value"] for r in C.read_pairs(spark, str(tmp_path / "y.csv"), "int").collect()} == {"a": 1800, "b": None, "c": None}
    assert C.load_specs('{"voters": [{"name": "a", "revision": "1", "_note": "x"}]}') == [{"name": "a", "revision": "1"}]
    off = {"name": "a", "revision": "", "enabled": False}
    assert C.load_specs(f"[{json.dumps(off)}]") == [off]
    for bad in ('[{"name": "a", "revision": "todo: pin it"}]', '[{"name": "a", "revision": "fill in"}]', '[{"name": "a", "revision": ""}]', '[{"name": "a", "revision": "TODO"}]', '[{"name": "a", "revision": "1"}, {"name": "a", "revision": "2"}]', '[{"revision": "1"}]'):
        with pytest.raises(ValueError):
            C.load_specs(bad)
    assert C.redacted({"api_key": "x", "n": {"token": "y", "k": 1}}) == {"api_key": "<redacted>", "n": {"token": "<redacted>", "k": 1}}
    pages = spark.createDataFrame([("<p>One <b>two</b></p><P class=x> three\n</P>",)], "html string")
    assert [tuple(r) for r in pages.select(F.inline(C.paragraphs(F.col("html")))).collect()] == [(1, "One two"), (2, "three")]


def test_holdout_and_queue(spark):
    rows = spark.createDataFrame([("c", k) for k in range(16)], "k string, id int")
    assert {r["id"] for r in E.holdout_split(rows, "k", "id").collect() if r["split"] == "dev"} == {12, 13, 14}
    items = spark.createDataFrame([(k, k % 4 != 0) for k in range(40)], "item int, u boolean")
    got = [r["stratum"] for r in E.queue(items, "item", "u", 5).collect()]
    assert got.count("A") == 5 and got.count("B") == 10


def test_by_facet_names_null_and_leaves_small_facets_out(spark):
    rows = spark.createDataFrame([("a", 9, 1, 6), ("a", 0, 0, 1), ("b", 1, 0, 0), (None, 15, 0, 0)], "period string, tp int, fp int, fn int")
    got = {r["period"]: (r["tp"], r["fn"], r["recall"]) for r in E.by_facet(rows, "period").collect()}
    assert got == {"a": (9, 7, 0.5625), "unknown": (15, 0, 1.0)}
    assert E.by_facet(rows.limit(0), "period").count() == 0


def test_multilabel_sets(spark):
    rows = spark.createDataFrame([(["x", "y"], ["y", "x", "x"]), (["x"], None), (None, []), (["x"], ["z"])], "r array<string>, p array<string>")
    r = E.multilabel(rows, "r", "p").first()
    assert (r["n"], r["exact_set"], r["tp"], r["fp"], r["fn"], r["micro_f1"]) == (4, 0.5, 2, 1, 2, round(4 / 7, 6))


def test_reliability_keeps_accuracy_and_coverage_apart(spark):
    posteriors = spark.createDataFrame([(k, x, float(x == "AB"[k % 2])) for k in range(8) for x in ("A", "B", "REJECT")], "item int, latent string, posterior double")
    votes = [(k, "good", "AB"[k % 2]) for k in range(8)] + [(0, "rare", "A"), (1, "rare", "B"), (2, "rare", "other")] + [(k, "half", "A") for k in range(8)] + [(0, "mute", "other")]
    got = {r["voter"]: (r["accuracy"], r["coverage"]) for r in V.reliability(spark.createDataFrame(votes, "item int, voter string, label string"), posteriors, ["A", "B"]).collect()}
    assert got == {"good": (1.0, 1.0), "rare": (1.0, 0.25), "half": (0.5, 1.0), "mute": (None, 0.0)}
