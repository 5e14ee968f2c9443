"""Markup, journeys, affect, places, relations, segments, checks."""

import json

from marginalia.operators import narrative as N
from marginalia.operators import spans as S
from marginalia.sources.markup import clean_with_spans, parse_markup
from pyspark.sql import functions as F


def test_markup_offsets(spark):
    raw = "<p>We  reached <place>High &amp; Low\n Fell</place> , then <note>no <place>x</place></note><place>Ford</place>.<!-- c --></p>"
    clean, spans = clean_with_spans(raw, "place", frozenset(["note"]))
    assert clean == "We reached High & Low Fell, then Ford."
    assert [s["text"] for s in spans] == ["High & Low Fell", "Ford"] and all(clean[s["start"] : s["end"]] == s["text"] for s in spans)
    assert raw[spans[0]["raw_start"] : spans[0]["raw_end"]] == "High &amp; Low\n Fell"
    rows = spark.createDataFrame([(1, raw), (2, None)], "pid int, raw string").select("pid", parse_markup(F.col("raw"), "place", ("note",)).alias("m"))
    got = {r["pid"]: r["m"] for r in rows.collect()}
    assert got[1]["clean"] == clean and len(got[1]["spans"]) == 2 and got[2]["clean"] is None


def test_journeys_inherit_and_guard(spark):
    rows = [("p", 0, "I walked from Keld to Muker in the rain."), ("p", 1, "We rode to Reeth by train."), ("p", 2, "I never went to York."), ("p", 3, "It rained.")]
    got = {r["ord"]: r for r in N.journeys(spark.createDataFrame(rows, "pid string, ord int, text string")).collect()}
    assert set(got) == {0, 1}
    assert (got[0]["start_location"], got[0]["end_location"], got[0]["transport_mode"], got[0]["requires_review"]) == ("Keld", "Muker", "foot", False)
    assert (got[1]["start_location"], got[1]["end_location"], got[1]["transport_mode"], got[1]["requires_review"]) == ("Muker", "Reeth", "train", True)


def test_affect_negation(spark):
    words = S.tokens(spark.createDataFrame([(1, "a lovely, calm day"), (2, "not a happy place"), (3, "stones"), (4, "happy yet sad")], "pid int, text string"))
    lexicon = spark.createDataFrame([("lovely", "positive"), ("calm", "positive"), ("happy", "positive"), ("sad", "negative")], "term string, polarity string")
    got = {r["pid"]: r["sentiment"] for r in N.affect_by_lexicon(words, lexicon).collect()}
    assert got == {1: "positive", 2: "negative", 3: "neutral", 4: "mixed"}


def test_places_and_features(spark):
    places = spark.createDataFrame([("Ford", "GB", 55.0, -2.0, False), ("Perth", "GB", 56.4, -3.4, False), ("Perth", "AU", -31.9, 115.9, False), ("Mercia", "GB", 52.0, -2.0, True)], "name string, country string, lat double, lon double, historical boolean")
    mentions = spark.createDataFrame([(1, "Ford"), (2, "Perth"), (3, "Mercia"), (4, "Nowhere")], "mention_id int, name string")
    resolved = N.resolve_places(mentions, places, prefer="AU")
    got = {r["mention_id"]: (r["status"], r["country"], r["lat"]) for r in resolved.collect()}
    assert got == {1: ("resolved", "GB", 55.0), 2: ("ambiguous", "AU", None), 3: ("unresolved", "GB", None), 4: ("unresolved", None, None)}
    made = {r["mention_id"]: (r["feature"], r["audit"]) for r in N.features(resolved).collect()}
    assert json.loads(made[1][0])["geometry"]["coordinates"] == [-2.0, 55.0] and made[2] == (None, "ambiguous")


def test_relations_segments_violations(spark):
    gold = spark.createDataFrame([(1, "near", "a", "b"), (1, "in", "a", "c")], "pid int, type string, source string, target string")
    pred = spark.createDataFrame([(1, "near", "a", "b"), (1, "near", "a", "b"), (1, "near", "b", "a")], gold.schema)
    assert tuple(N.relation_counts(pred, gold).first()) == (1, 1, 1, 1)
    rows = spark.createDataFrame([(1, 0, "aaa"), (1, 1, "bbb"), (1, 2, "cccccccccc"), (1, 3, "d")], "pid int, ord int, text string")
    assert [r["text"] for r in N.segments(rows, 8).orderBy("seg").collect()] == ["aaa bbb", "cccccccccc", "d"]
    spans = spark.createDataFrame([(1, 0, 3, "abc"), (1, 1, 3, "xx"), (9, 0, 1, "a")], "pid int, start int, end int, text string")
    bad = {(r["pid"], r["start"], r["why"]) for r in N.violations(spans, spark.createDataFrame([(1, "abcd")], "pid int, text string")).collect()}
    assert bad == {(1, 1, "text/offset mismatch"), (9, 0, "no passage")}
