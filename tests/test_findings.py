"""What the findings of round 2 were about, on small cases; each failed before."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import affectpanel as P, annotators as A, cuts, journeys as J, narrative as N, spans as S
from marginalia.plans import registry
from marginalia.sources import markup

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_f3_snapping_ends_at_a_line_break(spark):
    start, end = A.snapped(F.col("t"), F.lit(5), F.lit(7))
    row = spark.createDataFrame([("abcd\nefgh",)], "t string").select(start, end).first()
    assert tuple(row) == (5, 9)


def test_f4_places_take_four_bytes(spark):
    text, places = markup.clean_with_offsets("<p>a  b</p>")
    assert text == " a b " and memoryview(places).itemsize == 4 and list(places) == [2, 3, 4, 6, 10]
    got = spark.createDataFrame([("<p>a  b</p>",), (None,), ("",)], "h string").select(markup.offsets_of(F.col("h")).alias("x")).select("x.*").collect()
    assert [(r["clean"], r["places"]) for r in got] == [(text, [2, 3, 4, 6, 10]), (None, None), ("", [])]


def test_f7_spans_of_both_sides_in_one_pass(spark):
    made = plan(registry.QUERIES["prf_by_language"](spark, DATA))
    assert made.count("MapInArrow") == 1
    rows = [(1, 0, 1, 0), (1, 0, 0, 1), (1, 5, 1, 1), (2, 0, 1, 0), (2, 3, 0, 1), (2, 3, 0, 1)]
    got = S.match_marked(spark.createDataFrame(rows, "pid int, start int, p int, g int"), ["pid", "start"], ["pid"])
    assert sorted(map(tuple, got.collect())) == [(1, 2, 0, 0), (2, 0, 1, 2)]


def test_f8_pairs_are_read_once(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None)], "reference string, predicted string")
    got = P.sentiment_scores(pairs, ["a", "b", "c"])
    assert tuple(got.first()) == (3, 0.333333, 0.222222) and plan(got).count("Scan") == 1


def test_f9_partitions_follow_the_number_of_rows(spark):
    rows = spark.range(1000).withColumnRenamed("id", "pid")
    assert J.dealt(rows, rows=100).rdd.getNumPartitions() == 10


@pytest.mark.parametrize("before", [0, 2])
def test_f10_f13_negators_are_seen_in_the_row(spark, before):
    docs = spark.createDataFrame([(1, "Not very good, bad"), (2, "no x x good"), (3, "x")], "pid int, text string")
    lexicon = spark.createDataFrame([("good", "positive"), ("bad", "negative")], "term string, polarity string")
    made = N.affect_by_lexicon(S.tokens(docs, before=before), lexicon)
    assert {r["pid"]: (r["positive"], r["negative"], r["matched"]) for r in made.collect()} == {1: (0, 2, ["bad", "good"]), 2: (1, 0, ["good"]), 3: (0, 0, [])}
    assert before == 0 or "Window" not in plan(made)


def test_f12_f14_words_are_single_within_their_row(spark):
    docs = spark.createDataFrame([(1, "A a b A a b"), (2, None)], "pid int, text string")
    assert sorted(map(tuple, cuts.terms(docs).collect())) == [(1, "a"), (1, "b")]
    assert sorted(r["shingle"] for r in cuts.runs_of_words(docs, "pid", 3).collect()) == ["A a b", "a b A", "b A a"]


def test_f11_words_are_counted_in_the_worker(spark, monkeypatch):
    """Texts are added up whatever a worker holds; only those of shared ids, or of letters whose case is doubtful, stay apart."""
    rows = [(i, "One one two") for i in range(50)] + [(50, "ΟΔΟΣ οδος İl i̇l"), (60, "One x"), (60, "one y"), (None, "two"), (61, None)]
    docs = spark.createDataFrame(rows, "pid int, text string").coalesce(1)
    assert cuts.term_counts(docs.filter("pid < 50")).count() == 2
    for held in (1, 1 << 19):
        monkeypatch.setattr(cuts, "HELD", held)
        got = {r["term"]: r["df"] for r in S.gazetteer_of_texts(docs, least=1).collect()}
        assert got == {"one": 51, "two": 50, "x": 1, "y": 1, "i̇l": 1, **{r["w"]: 1 for r in spark.sql("select lower(w) w from values 'ΟΔΟΣ', 'οδος' t(w)").collect()}}


def test_f11_lower_case_is_the_same_in_the_worker(spark):
    sure = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]) if not cuts.DOUBTFUL.search(c)]
    got = spark.createDataFrame([(c,) for c in sure], "c string").select("c", F.lower("c").alias("low")).collect()
    assert len(got) > 50000 and all(r["low"] == r["c"].lower() and len(r["low"]) == 1 for r in got)


@pytest.mark.parametrize("size", [1, 1 << 21])
def test_f6_pieces_that_are_equal_in_lower_case_share_their_bit(size, monkeypatch):
    """A sum over the slice's code points gives them, wherever they stand; no listed piece is kept back."""
    monkeypatch.setattr(cuts, "SLICE", size)
    words = ["ab", "AB", "ba", "", "ΟΔΟΣ", "οδος", "οδοσ", "İl", "é😀", "É😀", "a b", "x" * 5000, "X" * 5000, "ab"]
    listed = [w.replace("İ", "i̇") for w in words]
    bits = np.zeros(cuts.BITS // 8, np.uint8)

    def edges(texts):
        sizes = np.array([len(t) for t in texts])
        return np.cumsum(sizes) - sizes, np.cumsum(sizes)

    spots = cuts.Pieces("".join(listed)).spots(*edges(listed)).tolist()
    fold = [w.lower().replace("ς", "σ") for w in words]
    assert all((a == b) == (fold[i] == fold[j]) for i, a in enumerate(spots) for j, b in enumerate(spots))
    for s in spots:
        bits[s >> 3] |= 1 << (s & 7)
    text = ["zz", *words[::-1], "i̇l", "bb"]
    got = cuts.Pieces("".join(text)).let_through(*edges(text), bits).tolist()
    assert got == [False, *[True] * len(words), True, False]


def test_f6_a_find_that_stands_alone_is_not_folded(spark):
    rows = [(1, "the red house, a Red house"), (2, "house"), (3, None)]
    listed = spark.createDataFrame([("red house", "A", False), ("house", "B", True)], "surface string, label string, any_case boolean")
    got = S.gazetteer_spans(spark.createDataFrame(rows, "pid int, text string"), listed)
    assert sorted(map(tuple, got.collect())) == [(1, 4, 13, "red house", "A"), (1, 21, 26, "house", "B"), (2, 0, 5, "house", "B")]
    assert "if ((size(all" in plan(got).lower()
