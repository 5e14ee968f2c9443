"""Journeys, panels, resources and offset maps on small cases."""

from pyspark.sql import functions as F

from marginalia.operators import affectpanel as P, journeys as J, narrative as N, resources as X
from marginalia.sources import markup as M

JOURNEY = "pid int, {0} int, start_location string, end_location string, transport_mode string, date string, journey_reason string, evidence_start int, evidence_end int, evidence_quote string"


def test_journeys_are_matched_best_first(spark):
    reference = spark.createDataFrame([(1, 0, "Penrith", "Keswick", "on foot", None, None, 0, 40, "a"), (1, 1, None, "Shap", "train", None, None, 50, 90, "b"), (2, 0, "Ambleside", "Kendal", None, None, None, 0, 9, "c")], JOURNEY.format("r"))
    predicted = spark.createDataFrame([(1, 0, "penrith ", "KESWICK", "walking", None, None, 0, 30, "a"), (1, 1, "Penrith", "Keswick", "ship", None, None, 0, 40, "a"), (1, 2, "Kendal", "Shap", "rail", None, None, 60, 90, "x"), (2, 0, "Elsewhere", "Grasmere", None, None, None, 0, 9, "c")], JOURNEY.format("p"))
    pairs = J.matched(predicted, reference)
    assert sorted((r["pid"], r["p"], r["r"]) for r in pairs.collect()) == [(1, 1, 0), (1, 2, 1)]
    assert {r["pid"]: (r["tp"], r["fp"], r["fn"]) for r in J.counts(predicted, reference, pairs).collect()} == {1: (2, 1, 0), 2: (0, 1, 1)}
    fields = {r["field"]: r for r in J.fields_of(predicted, reference, pairs).collect()}
    assert fields["start_location"]["unsupported_prediction"] == 1 and fields["transport_mode"]["correct"] == 1 and fields["transport_mode"]["mismatch"] == 1 and fields["date"]["both_missing"] == 2


def test_records_are_checked_against_their_text(spark):
    passages = spark.createDataFrame([(1, "We went on and on.")], "pid int, text string")
    rows = [(1, "on", 1.4, {"date": "explicit"}), (1, "off", 0.2, {"date": "explicit"}), (1, "", -1.0, {"date": "sure"}), (9, "on", 0.5, {"date": "contextual_inference"})]
    got = J.checked(spark.createDataFrame(rows, "pid int, evidence_quote string, confidence double, statuses map<string,string>"), passages).collect()
    found = {(r["pid"], r["evidence_quote"]): (r["evidence_match_count"], r["evidence_start"], r["confidence"], r["requires_review"]) for r in got}
    assert found == {(1, "on"): (2, 8, 1.0, False), (1, "off"): (0, None, 0.2, True), (1, ""): (0, None, 0.0, True), (9, "on"): (0, None, 0.5, True)}


def test_panel_of_segments(spark):
    votes = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, "a", "y")], "item int, voter string, label string")
    full = {(r["item"], r["voter"]): r["label"] for r in P.with_abstentions(votes, ["a", "b"]).collect()}
    assert full == {(1, "a"): "x", (1, "b"): "x", (2, "a"): "y", (2, "b"): "NONE"}
    assert [(r["label"], r["n"], r["rank"]) for r in P.distribution(votes).orderBy("rank").collect()] == [("x", 2, 1), ("y", 1, 2)]
    pairs = spark.createDataFrame([("p", "p"), ("n", "p"), ("n", None)], "reference string, predicted string")
    assert P.sentiment_scores(pairs, ["p", "n", "m"]).first()["macro_f1"] == round((2 / 3) / 3, 6)
    scored = spark.createDataFrame([("a", 0.5, 0.4, 0.6), ("b", 0.7, 0.65, 0.8), ("c", 0.6, 0.5, 0.66)], "voter string, f1 double, low double, high double")
    assert tuple(P.leading(scored).first()) == ("b", "c", True) and P.leading(scored.limit(1)).count() == 0


def test_bootstrap_of_a_mean_does_not_depend_on_partitions(spark):
    rows = spark.range(400).select(F.col("id"), (F.col("id") % 2).cast("string").alias("g"), (F.col("id") % 10).cast("double").alias("v"))
    one, two = (P.bootstrap_mean(rows.repartition(n), "g", "id", "v", 300).orderBy("g").collect() for n in (1, 5))
    assert [[round(x, 9) for x in r[1:]] for r in one] == [[round(x, 9) for x in r[1:]] for r in two]
    assert all(r["low"] < r["mean"] < r["high"] and r["high"] - r["low"] < 1.2 for r in one)


def test_resources(spark):
    terms = spark.createDataFrame([("n", "Lake", "GEONOUN", True, 1), ("n", "lake ", "GEONOUN", True, 2), ("n", "lakes", "GEONOUN", True, 3), ("n", "gatekeeper", "GEONOUN", True, 4), ("n", " ", "GEONOUN", True, 5)], "layer string, term string, label string, any_case boolean, at int")
    layers = X.build_layers(terms)
    assert {(r["term"], r["generated"], r["risk"]) for r in layers.collect()} == {("Lake", False, None), ("lakes", False, None), ("gatekeeper", False, "person"), ("gatekeepers", True, None), ("lakeses", True, None)}
    assert tuple(X.layer_stats(layers, terms).first()) == ("n", 3, 2, 1, 2)
    tokens = spark.createDataFrame([(1, 0, 0, 3, "the"), (1, 1, 4, 8, "Lake"), (1, 2, 9, 17, "District")], "pid int, pos int, start int, end int, word string")
    spans = spark.createDataFrame([(1, 4, 17, "PLACE")], "pid int, start int, end int, label string")
    assert [r["role"] for r in X.bio(tokens, spans).orderBy("pos").collect()] == ["O", "B-PLACE", "I-PLACE"]
    assert X.fingerprint("p", {"a": 1}) == X.fingerprint("p", {"a": 1}) != X.fingerprint("q", {"a": 1})


def test_offset_maps():
    raw = "<p>saw  <b>Keswick</b> , and <note>x</note>left</p>"
    clean, places = M.clean_with_offsets(raw)
    assert clean == " saw Keswick, and left " and len(places) == len(clean)
    at = clean.index("Keswick")
    assert raw[places[at] : places[at + 6] + 1] == "Keswick"
    assert M.rebased("  the  Lake\n District ", [(7, 21)]) == ("the Lake District", [(4, 17, "Lake District")])


def test_segments_may_overlap(spark):
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(["aaaa", "bb", "cccc", "dddddddddddd", "e"])], "pid int, ord int, text string")
    assert [r["text"] for r in N.segments(rows, 9).orderBy("seg").collect()] == ["aaaa bb", "cccc", "dddddddddddd", "e"]
    assert [r["text"] for r in N.segments(rows, 9, 3).orderBy("seg").collect()] == ["aaaa bb", "bb cccc", "dddddddddddd", "e"]
