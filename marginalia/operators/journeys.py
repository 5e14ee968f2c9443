"""Journeys: checking a model's records, matching them to references, scoring fields, drawing them.

A journey: pid, start_location, end_location, transport_mode, date,
journey_reason, evidence_start, evidence_end, evidence_quote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import spans as S
from marginalia.functions.text import match_key
from marginalia.operators.records import field_scores, match_records

FIELDS = ("start_location", "end_location", "transport_mode", "date", "journey_reason")
STATUSES = ("explicit", "contextual_inference", "not_stated")
#: Names of one means of transport (lexical, not semantic).
TRANSPORT = {
    "walking": "foot", "walk": "foot", "walked": "foot", "on foot": "foot", "by foot": "foot", "plane": "air", "flight": "air", "by air": "air", "by plane": "air",
    "railway": "train", "rail": "train", "by train": "train", "by rail": "train", "boat": "ship", "by ship": "ship", "by boat": "ship", "on horseback": "horse", "horseback": "horse",
}


def checked(records: DataFrame, passages: DataFrame, pid: str = "pid") -> DataFrame:
    """A model's records held against their text.

    records: pid, evidence_quote, confidence, statuses map<field, status> and
    others, which stay; passages: pid, text.  Adds evidence_match_count,
    evidence_grounded, evidence_start and evidence_end (of the first place), and
    requires_review; confidence is put within 0 and 1, a status that is not one
    becomes null.  An empty or null quote, or a passage that is not there,
    grounds nothing.
    """
    met = records.join(passages.select(pid, F.col("text").alias("__text")), pid, "left")
    quote = F.col("evidence_quote")
    asked = F.coalesce(F.length(quote), F.lit(0)) > 0
    pieces = (F.length("__text") - F.length(F.replace(F.col("__text"), quote, F.lit("")))) / F.length(quote)
    count = F.when(asked & F.col("__text").isNotNull(), pieces).otherwise(0).cast("int")
    known = F.transform_values("statuses", lambda k, v: F.when(v.isin(*STATUSES), v))
    bad = F.exists(F.map_values("statuses"), lambda v: v.isNull() | ~v.isin(*STATUSES))
    inferred = F.exists(F.map_values("statuses"), lambda v: v == "contextual_inference")
    at = F.expr("position(evidence_quote, __text)") - 1
    rows = met.withColumn("evidence_match_count", count).withColumn("evidence_grounded", F.col("evidence_match_count") > 0)
    start = F.when(F.col("evidence_grounded"), at)
    review = F.coalesce(bad, F.lit(False)) | F.coalesce(inferred, F.lit(False)) | ~F.col("evidence_grounded")
    rows = rows.withColumn("evidence_start", start).withColumn("evidence_end", F.col("evidence_start") + F.length(quote)).withColumn("requires_review", review)
    return rows.withColumn("confidence", F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0))).withColumn("statuses", known).drop("__text")


def dealt(passages: DataFrame, pid: str = "pid", rows: int = 100_000) -> DataFrame:
    """The passages in so many partitions by ``pid`` that each has about ``rows`` of them, whatever their number.

    What follows by ``pid`` stays in these partitions, so a task's sorts do not grow with the table.
    """
    least = int(passages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return passages.repartition(max(least, -(-passages.count() // rows)), pid)


def keyed(journeys: DataFrame, transport: dict[str, str] = TRANSPORT) -> DataFrame:
    """Every field folded for comparison: white space, case, names of transport."""
    return journeys.withColumns({f: match_key(F.col(f), transport if f == "transport_mode" else None) for f in FIELDS if f in journeys.columns})


def candidates(predicted: DataFrame, reference: DataFrame, least_iou: float = 0.5, pid: str = "pid") -> DataFrame:
    """pid, p, r, score of the pairs that may match; predicted carries ``p``, reference ``r``, their number in the passage.

    A pair may match where every stated endpoint of the reference is met (one at
    the least), or where the evidence overlaps by ``least_iou`` and one is.  The
    score is the number of endpoints met, plus the overlap, plus a hundredth
    where the quotes are equal.
    """
    ends = ("start_location", "end_location")
    cols = [*ends, "evidence_start", "evidence_end", "evidence_quote"]
    a = keyed(predicted).select(pid, "p", *[F.col(c).alias(f"p_{c}") for c in cols])
    b = keyed(reference).select(pid, "r", *[F.col(c).alias(f"r_{c}") for c in cols])
    met = a.join(b, pid)
    hit = [F.coalesce(F.col(f"r_{e}") == F.col(f"p_{e}"), F.lit(False)) for e in ends]
    stated = [F.col(f"r_{e}").isNotNull() for e in ends]
    n: Column = sum((h.cast("int") for h in hit[1:]), hit[0].cast("int"))
    every = (n > 0) & (n == sum((s.cast("int") for s in stated[1:]), stated[0].cast("int")))
    iou = F.coalesce(S.iou(*[F.col(f"{s}_evidence_{e}") for s in "pr" for e in ("start", "end")]), F.lit(0.0))
    equal = F.coalesce(F.col("p_evidence_quote") == F.col("r_evidence_quote"), F.lit(False)).cast("int")
    able = met.withColumn("__n", n).withColumn("__iou", iou).filter(every | ((F.col("__iou") >= least_iou) & (F.col("__n") > 0)))
    return able.select(pid, "p", "r", (F.col("__n") + F.col("__iou") + equal * 0.01).alias("score"))


def matched(predicted: DataFrame, reference: DataFrame, pid: str = "pid") -> DataFrame:
    """pid, p, r, score: the best pairs first, each record once; ties to the lesser numbers."""
    return match_records(candidates(predicted, reference, pid=pid), pid)


def counts(predicted: DataFrame, reference: DataFrame, pairs: DataFrame, pid: str = "pid") -> DataFrame:
    """pid, tp, fp, fn of every passage of either side."""
    rows = predicted.select(pid, F.lit(1).alias("p"), F.lit(0).alias("r"), F.lit(0).alias("m"))
    rows = rows.unionByName(reference.select(pid, F.lit(0).alias("p"), F.lit(1).alias("r"), F.lit(0).alias("m"))).unionByName(pairs.select(pid, F.lit(0).alias("p"), F.lit(0).alias("r"), F.lit(1).alias("m")))
    sums = rows.groupBy(pid).agg(*[F.sum(c).alias(c) for c in "prm"])
    return sums.select(pid, F.col("m").alias("tp"), (F.col("p") - F.col("m")).alias("fp"), (F.col("r") - F.col("m")).alias("fn"))


def fields_of(predicted: DataFrame, reference: DataFrame, pairs: DataFrame, fields: tuple[str, ...] = FIELDS, pid: str = "pid") -> DataFrame:
    """Field counts and rates over the matched pairs."""
    a = keyed(predicted).select(pid, "p", *[F.col(f).alias(f"pred_{f}") for f in fields])
    b = keyed(reference).select(pid, "r", *[F.col(f).alias(f"ref_{f}") for f in fields])
    return field_scores(pairs.join(a, [pid, "p"]).join(b, [pid, "r"]), list(fields))


def lines(journeys: DataFrame, places: DataFrame, key: str, allow_ambiguous: bool = False) -> DataFrame:
    """key, feature (a GeoJSON line as text), audit (why there is none).

    places: name, status (resolved, ambiguous, unresolved), lat, lon, a row a
    name.  Both ends must be resolved, or ambiguous where ``allow_ambiguous``.
    """
    ends = {}
    rows = journeys
    for end in ("start", "end"):
        own = places.select(F.lower("name").alias(f"__{end}"), F.struct("status", "lat", "lon").alias(end))
        rows = rows.join(own, F.lower(f"{end}_location") == F.col(f"__{end}"), "left").drop(f"__{end}")
        good = F.col(f"{end}.status").isin("resolved", *["ambiguous"] * allow_ambiguous) & F.col(f"{end}.lat").isNotNull() & F.col(f"{end}.lon").isNotNull()
        ends[end] = F.coalesce(good, F.lit(False))
    point = lambda end: F.array(f"{end}.lon", f"{end}.lat")
    line = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("LineString").alias("type"), F.array(point("start"), point("end")).alias("coordinates")).alias("geometry"),
            F.struct("start_location", "end_location").alias("properties"),
        )
    )
    why = F.concat_ws("; ", *[F.when(~ends[e], F.concat(F.lit(f"{e}: "), F.when(F.col(f"{e}_location").isNull(), "not stated").otherwise(F.coalesce(F.col(f"{e}.status"), F.lit("unresolved"))))) for e in ends])
    both = ends["start"] & ends["end"]
    return rows.select(key, F.when(both, line).alias("feature"), F.when(~both, why).alias("audit"))


def narrator_events(sentences: DataFrame, verbs: str, text: str = "text") -> DataFrame:
    """The sentences whose narrator moves: I or we before a verb of movement, with ``subject`` and ``verb``."""
    pattern = rf"(?i)\b(I|we)\b(?: \w+){{0,2}}? ({verbs})\b"
    found = sentences.withColumn("subject", F.lower(F.regexp_extract(text, pattern, 1))).withColumn("verb", F.lower(F.regexp_extract(text, pattern, 2)))
    return found.filter(F.col("verb") != "")
