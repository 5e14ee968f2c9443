"""Span, vote and record operators against plain Python on small cases."""

import random
import re

import numpy as np
import pytest

from marginalia.functions import affect, geo, text as T
from marginalia.operators import records as R, spans as S, votes as V
from pyspark.sql import functions as F


def greedy(pred, gold, regime):
    used, tp = set(), 0
    for s, e in sorted(pred):
        best = None
        for k, (a, b) in enumerate(sorted(gold)):
            gain = int((s, e) == (a, b)) if regime == "exact" else max(0, min(e, b) - max(s, a))
            if k not in used and gain > 0 and (best is None or gain > best[0]):
                best = (gain, k)
        if best:
            used.add(best[1])
            tp += 1
    return tp, len(pred) - tp, len(gold) - len(used)


@pytest.mark.parametrize("regime", ["exact", "overlap"])
def test_match_equals_greedy(spark, regime):
    rng = random.Random(3)
    side = lambda: [(s, s + rng.randint(1, 6)) for s in rng.sample(range(20), rng.randint(0, 6))]
    cases = {k: (side(), side()) for k in range(150)}
    rows = lambda at: spark.createDataFrame([(k, *x) for k, v in cases.items() for x in v[at]], "pid int, start int, end int")
    got = {r["pid"]: (r["tp"], r["fp"], r["fn"]) for r in S.match(rows(0), rows(1), regime).collect()}
    for k, (p, g) in cases.items():
        if p or g:
            assert got[k] == greedy(p, g, regime)


def first_fit(spans):
    groups = []
    for x in sorted(spans):
        def same(m):
            shared = max(0, min(m[1], x[1]) - max(m[0], x[0]))
            union = (m[1] - m[0]) + (x[1] - x[0]) - shared
            return shared > 0 and (shared >= 0.5 * union or shared >= 0.8 * min(m[1] - m[0], x[1] - x[0]))

        for g in groups:
            if any(same(m) for m in g):
                g.append(x)
                break
        else:
            groups.append([x])
    return sorted((min(m[0] for m in g), max(m[1] for m in g), len(g)) for g in groups)


def test_pool_equals_first_fit(spark):
    rng = random.Random(5)
    cases = {k: [(s, s + rng.randint(2, 8), f"v{rng.randint(0, 4)}", "L") for s in rng.sample(range(25), rng.randint(1, 8))] for k in range(100)}
    rows = spark.createDataFrame([(k, *x) for k, v in cases.items() for x in v], "pid int, start int, end int, voter string, label string")
    got = {}
    for r in S.pool(rows).collect():
        got.setdefault(r["pid"], []).append((r["start"], r["end"], len(r["members"])))
    assert {k: sorted(v) for k, v in got.items()} == {k: first_fit(v) for k, v in cases.items()}


def test_ground_repeats_and_failures(spark):
    passages = spark.createDataFrame([("p", "a.b x a.b a😀b a.b")], "pid string, text string")
    quotes = [("p", "v", k, q) for k, q in enumerate(["a.b", "a.b", "a.b", "a.b", "zz", "", "a😀b", "b x"])]
    got = S.ground(spark.createDataFrame(quotes, "pid string, voter string, ord int, quote string"), passages)
    rows = {r["ord"]: (r["status"], r["start"], r["end"]) for r in got.collect()}
    assert rows[0] == ("grounded", 0, 3) and rows[1] == ("grounded", 6, 9) and rows[2] == ("grounded", 14, 17)
    assert rows[3][0] == "repeated_and_exhausted" and rows[4][0] == "not_in_passage" and rows[5][0] == "empty_quote"
    assert rows[6] == ("grounded", 10, 13) and rows[7] == ("grounded", 2, 5)


def test_longest_first(spark):
    rows = spark.createDataFrame([("p", 0, 5, 2), ("p", 3, 8, 1), ("p", 9, 11, 3), ("p", 8, 12, 3)], "pid string, start int, end int, rank int")
    got = sorted((r["start"], r["end"]) for r in S.longest_first(rows).collect())
    assert got == [(3, 8), (8, 12)]


def test_krippendorff_known(spark):
    rows = [("i1", "a", "x"), ("i1", "b", "x"), ("i2", "a", "y"), ("i2", "b", "y"), ("i3", "a", "x"), ("i3", "b", "y"), ("i4", "a", "x")]
    got = V.krippendorff(spark.createDataFrame(rows, "item string, voter string, label string")).first()
    # n = 6, margins x 3, y 3: observed 2/6, expected 1 - 12/30.
    assert got["n_labels"] == 6 and got["alpha"] == pytest.approx(1 - (2 / 6) / (1 - 12 / 30), abs=1e-6)


def test_dawid_skene_beats_noise(spark):
    rng = random.Random(7)
    truth = {i: rng.choice(["A", "B"]) for i in range(300)}
    accuracy = {"v0": 0.95, "v1": 0.9, "v2": 0.9, "v3": 0.55, "v4": 0.5}
    rows = [(i, v, t if rng.random() < q else {"A": "B", "B": "A"}[t]) for i, t in truth.items() for v, q in accuracy.items()]
    post = V.dawid_skene(spark.createDataFrame(rows, "item long, voter string, label string"), ["A", "B"], list(accuracy))
    best = post.groupBy("item").agg(F.max_by("latent", "posterior").alias("l"), F.sum("posterior").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in best)
    assert sum(truth[r["item"]] == r["l"] for r in best) / 300 > 0.93


def test_stratified_sample_sizes(spark):
    rows = spark.createDataFrame([(k, "abc"[0 if k < 70 else 1 if k < 95 else 2]) for k in range(100)], "id long, s string")
    got = {r["s"]: r["count"] for r in R.stratified_sample(rows, "s", "id", 20).groupBy("s").count().collect()}
    assert sum(got.values()) == 20 and got == {"a": 14, "b": 5, "c": 1}


def test_review_fold_and_strict_sum(spark):
    rows = spark.createDataFrame([(1, 1, "edit", "x"), (1, 2, "accept", None), (2, 1, "edit", "a"), (2, 2, "edit", "b")], "id int, t int, action string, value string")
    got = {r["id"]: (r["status"], r["value"], r["edits"]) for r in R.review_fold(rows, "id", "t", "action", "value").collect()}
    assert got == {1: ("accept", "x", 1), 2: ("edit", "b", 2)}
    sums = spark.createDataFrame([(1, 2), (1, None), (2, 3)], "k int, x int").groupBy("k").agg(R.strict_sum(F.col("x")).alias("s"))
    assert {r["k"]: r["s"] for r in sums.collect()} == {1: None, 2: 3}


def test_scalar_functions(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first()["x"]
    assert pick(T.dedupe_key(F.lit("É, ſo_1!"))) == "éſo_1"
    assert pick(T.year_in(F.lit("in 1845 and 1790, not 21845"))) == 1790
    assert pick(T.harmonise(F.lit("gpe"), ["TOPONYM"], {"GPE": "TOPONYM"})) == "TOPONYM"
    assert pick(T.plural(F.lit("valley"))) == "valleys" and pick(T.plural(F.lit("city"))) == "cities" and pick(T.plural(F.lit("church"))) == "churches"
    assert pick(T.unfenced(F.lit("```json\n{}\n```"))) == "{}"
    assert pick(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(20015.115, abs=0.01)
    assert pick(affect.sentiment(F.lit(0.4), F.lit(0.35), F.lit(0.25))) == "mixed"


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "pid int, start int, end int, voter string, label string")
    assert S.match(empty, empty).count() == 0 and S.pool(empty).count() == 0
    assert S.tokens(spark.createDataFrame([(1, ""), (2, None)], "pid int, text string")).count() == 0


def test_tokens_are_runs_of_anything_but_space(spark):
    docs = spark.createDataFrame([(1, "one\ttwo\nthree four"), (2, " \u00a0a😀b  c "), (3, " "), (4, "x" * 3000 + " " + "y " * 2000)], "pid int, text string")
    got = sorted(map(tuple, S.tokens(docs).collect()))
    assert [r[4] for r in got if r[0] == 1] == ["one", "two", "three", "four"]
    assert [r[1:] for r in got if r[0] == 2] == [(0, 2, 5, "a😀b"), (1, 7, 8, "c")] and not [r for r in got if r[0] == 3]
    assert [r[2] for r in got if r[0] == 4] == [0, *range(3001, 7001, 2)]
    assert "Exchange" not in S.tokens(docs)._jdf.queryExecution().executedPlan().toString()


def test_long_passages_are_matched_and_pooled(spark):
    spans = spark.range(20_000).select(F.lit(1).alias("pid"), (F.col("id") * 3).cast("int").alias("start"), (F.col("id") * 3 + 2 + F.col("id") % 3).cast("int").alias("end"), F.lit("v").alias("voter"), F.lit("L").alias("label"))
    other = spans.withColumn("start", F.col("start") + 1).withColumn("voter", F.lit("w"))
    assert S.match(spans, other).first()["tp"] > 19_000 and S.match(spans, spans).first()["tp"] == 20_000
    assert S.pool(spans.unionByName(other)).count() > 0 and S.longest_first(spans.withColumn("rank", F.lit(0))).count() > 0


def in_order(pred, gold):
    used, tp = set(), 0
    for s, e, label in sorted(pred):
        for k, (a, b, other) in enumerate(sorted(gold)):
            if k not in used and label == other and s < b and a < e:
                used.add(k)
                tp += 1
                break
    return tp, len(pred) - tp, len(gold) - len(used)


def test_first_overlap_of_equal_label(spark):
    rng = random.Random(4)
    side = lambda: [(s, s + rng.randint(1, 6), rng.choice("AB")) for s in rng.sample(range(20), rng.randint(0, 6))]
    cases = {k: (side(), side()) for k in range(100)}
    rows = lambda at: spark.createDataFrame([(k, *x) for k, v in cases.items() for x in v[at]], "pid int, start int, end int, label string")
    got = {r["pid"]: (r["tp"], r["fp"], r["fn"]) for r in S.match(rows(0), rows(1), "any", label=True).collect()}
    assert got == {k: in_order(p, g) for k, (p, g) in cases.items() if p or g}


def test_gazetteer_layers(spark):
    text = "by Lake Windermere, today; saw Keswick, and left PENRITH. March on the Inn at Grasmere, New York city"
    passages = spark.createDataFrame([(1, text), (2, None)], "pid int, text string")
    listed = [("Lake Windermere", "TOPONYM", False), ("Windermere", "TOPONYM", False), ("Keswick", "TOPONYM", False), ("march", "TOPONYM", False), ("inn", "GEONOUN", True), ("lake", "GEONOUN", True), ("New York", "TOPONYM", False), ("york city", "GEONOUN", True), ("penrith", "", True), ("St.", "X", False)]
    gazetteer = spark.createDataFrame(listed, "surface string, label string, any_case boolean")
    got = sorted((r["start"], r["surface"], r["label"]) for r in S.gazetteer_spans(passages, gazetteer).collect())
    want = [("Lake Windermere", "TOPONYM"), ("Keswick", "TOPONYM"), ("Inn", "GEONOUN"), ("New York", "TOPONYM")]
    assert got == [(text.index(surface), surface, label) for surface, label in want]
    plain = spark.createDataFrame([("road", "GEONOUN"), ("road bridge", "GEONOUN"), ("the road", "X")], "surface string, label string")
    found = S.longest_surfaces(spark.createDataFrame([(1, "the road bridge and the road")], "pid int, text string"), plain)
    assert sorted((r["start"], r["surface"]) for r in found.collect()) == [(4, "road bridge"), (20, "the road")]
    assert S.gazetteer_spans(passages, gazetteer.limit(0)).count() == 0


def test_ground_takes_quotes_literally(spark):
    passages = spark.createDataFrame([(1, r"a \E b \Q c. (x) a\ a\E"), (2, "x")], "pid int, text string")
    quotes = spark.createDataFrame([(1, "v", k, q) for k, q in enumerate([r"\E", r"\E", r"\E b \Q", "(x)", "a\\", "c.", r"\Q(x)\E"])], "pid int, voter string, ord int, quote string")
    got = {r["ord"]: (r["status"], r["start"]) for r in S.ground(quotes, passages).collect()}
    text = r"a \E b \Q c. (x) a\ a\E"
    assert got[0] == ("grounded", 2) and got[1] == ("grounded", len(text) - 2) and got[2] == ("grounded", 2) and got[3] == ("grounded", text.index("(x)"))
    assert got[4] == ("grounded", text.index("a\\")) and got[5] == ("grounded", text.index("c.")) and got[6][0] == "not_in_passage"


def test_pooled_votes(spark):
    rows = [(1, 0, 6, "a", "P"), (1, 0, 13, "b", "P"), (1, 0, 13, "c", "Q"), (1, 20, 25, "a", "P"), (1, 20, 25, "b", "P"), (1, 20, 25, "c", "P"), (2, 0, 2, "c", "Q"), (2, 0, 2, "b", "P")]
    items = S.pool(spark.createDataFrame(rows, "pid int, start int, end int, voter string, label string"))
    got = {(r["pid"], r["item"]): (r["n_proposing"], r["modal_label"], r["agreement"], r["unanimous"], r["extent_disagreement"], r["stratum"]) for r in S.pooled_votes(items, ["a", "b", "c"]).collect()}
    assert got == {(1, 0): (3, "P", 2, False, True, "B_contested"), (1, 1): (3, "P", 3, True, False, "A_unanimous"), (2, 0): (2, "P", 1, False, False, "B_contested")}


def by_units(sizes, want):
    total = sum(sizes.values())
    want = min(want, total)
    quota = {k: max(1, round(want * n / total)) for k, n in sizes.items()}
    while sum(quota.values()) > want:
        quota[max(quota, key=lambda k: quota[k])] -= 1
    while sum(quota.values()) < want:
        quota[max(sizes, key=lambda k: sizes[k] - quota[k])] += 1
    return quota


@pytest.mark.parametrize("seed", range(8))
def test_allocate_equals_one_unit_at_a_time(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k:02}": rng.choice([1, 2, 3, 10, rng.randint(1, 400)]) for k in range(rng.randint(1, 25))}
    want = rng.randint(1, 120)
    got = {r["stratum"]: r["quota"] for r in R.allocate(spark.createDataFrame(list(sizes.items()), "stratum string, size long"), want).collect()}
    assert got == by_units(sizes, want)


def test_samples_with_a_negative_share(spark):
    rows = spark.createDataFrame([(k, "ab"[k % 2], k % 5 != 0, k) for k in range(200)], "id long, s string, good boolean, rank long")
    got = R.stratified_sample(rows, "s", "id", 40, positive=F.col("good"), negative_share=0.25).collect()
    assert len(got) == 40 and sum(not r["good"] for r in got) == 10 and all(r["rank"] == r["id"] for r in got)
    few = R.stratified_sample(rows.filter("good or id < 20"), "s", "id", 40, positive=F.col("good"), negative_share=0.25).collect()
    assert len(few) == 40 and sum(not r["good"] for r in few) == 4
    simple = R.simple_sample(rows, "s", "id", 40, F.col("good"), 0.25).collect()
    assert len(simple) == 40 and sum(not r["good"] for r in simple) == 10 and len({r["id"] for r in simple}) == 40
    huge = R.allocate(spark.createDataFrame([("a", 1 << 33), ("b", 5)], "stratum string, size long"), 1 << 32)
    assert huge.agg(F.sum("quota")).first()[0] == 1 << 32


def test_sentences_have_offsets(spark):
    text = 'Mr. Gray went. He said "go." ␞ And left! (Then) x.'
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "pid int, text string")
    loose = T.sentences(docs, ["pid"]).collect()
    assert all(text[r["start"] : r["end"]] == r["sentence"] for r in loose) and {r["pid"] for r in loose} == {1}
    assert [r["sentence"] for r in loose] == ["Mr. ", "Gray went. ", 'He said "go." ␞ And left! ', "(Then) x."]
    strict = T.sentences(docs, ["pid"], strict=True).collect()
    assert [r["sentence"] for r in strict] == ["Mr. Gray went.", 'He said "go." ␞ And left!', "(Then) x."]
    quoted = T.sentences(spark.createDataFrame([(1, 'He said "go." And left.')], "pid int, text string"), ["pid"]).collect()
    assert [r["sentence"] for r in quoted] == ['He said "go."', "And left."]


def test_dawid_skene_without_votes(spark):
    assert V.dawid_skene(spark.createDataFrame([], "item long, voter string, label string"), ["A"], ["v"]).count() == 0


def test_dawid_skene_without_patterns_on_the_driver(spark):
    rng = np.random.default_rng(8)
    rows = [(i, f"v{k}", str(rng.choice(["A", "B", "C", "other"], p=[0.5, 0.3, 0.1, 0.1]))) for i in range(300) for k in range(4) if rng.random() < 0.8]
    votes = spark.createDataFrame(rows, "item long, voter string, label string").repartition(3)
    own = [f"v{k}" for k in range(4)]
    a, b = (V.dawid_skene(votes, ["A", "B", "C"], own, rounds=8, tolerance=0.0, most=m) for m in (1000, 5))
    a, b = ({(r["item"], r["latent"]): r["posterior"] for r in x.collect()} for x in (a, b))
    assert a.keys() == b.keys() and len(a) == 4 * len({r[0] for r in rows}) and max(abs(a[k] - b[k]) for k in a) < 1e-9
    for i in {r[0] for r in rows}:
        assert abs(sum(a[i, x] for x in ("A", "B", "C", "REJECT")) - 1) < 1e-9


def test_words_in_batches(spark, monkeypatch):
    """Cutting does not depend on slices, and words are those of Python at odd characters."""
    from marginalia.operators import cuts

    texts = ["", "a  b İ c", "é😀 x\x85y", " ", "Σας ΟΔΟΣ z", "d", "　", "end e_1-f"]
    for size in (1, 8, 1 << 20):
        monkeypatch.setattr(cuts, "SLICE", size)
        got, rows = [], 0
        for first, part in cuts.slices(cuts.pa.array([*texts[:3], None, *texts[3:]])):
            whole, row, starts, ends, firsts = cuts.cut(part, letters=False)
            got += [(first + r, a - f, w) for r, a, f, w in zip(row.tolist(), starts.tolist(), firsts[row].tolist(), cuts.strings(whole, starts, ends).to_pylist(), strict=True)]
            rows += len(part)
        assert rows == len(texts) + 1
        assert got == [(k + (k > 2), m.start(), m[0]) for k, t in enumerate(texts) for m in re.finditer(r"\S+", t)]


def test_surfaces_are_found_whatever_the_filter_makes_of_their_case(spark):
    text = "İl ve ΟΔΟΣ, the straße a b a b"
    passages = spark.createDataFrame([(1, text)], "pid int, text string")
    listed = spark.createDataFrame([("i̇l", True), ("οδος", True), ("STRASSE", True), ("a b", False), ("A B", False)], "surface string, any_case boolean")
    assert sorted((r["start"], r["surface"]) for r in S.surface_hits(passages, listed).collect()) == [(0, "İl"), (6, "ΟΔΟΣ"), (23, "a b"), (27, "a b")]


def test_word_counts_of_whole_texts(spark):
    """Passages that share an id count once, a null one not at all, and neither is shuffled by word where ids are single."""
    docs = spark.createDataFrame([(1, "One one two"), (1, "two three"), (2, "ONE two"), (None, "one"), (3, None)], "pid int, text string")
    got = {r["term"]: r["df"] for r in S.gazetteer_of_texts(docs, least=1).collect()}
    assert got == {"one": 2, "two": 2, "three": 1}
    single = docs.filter("text <> 'two three'")
    plan = S.gazetteer_of_texts(single, least=1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and {r["term"]: r["df"] for r in S.gazetteer_of_texts(single, least=1).collect()} == {"one": 2, "two": 2}
