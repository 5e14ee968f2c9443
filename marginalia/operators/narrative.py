"""Rule layers over sentences: places, journeys, affect, relations, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACE = r"((?:\p{Lu}[\p{L}'-]+)(?: \p{Lu}[\p{L}'-]+)*)"
VERBS = "walked|went|travelled|rode|sailed|drove|returned|came|set out|journeyed|marched|flew"
CANCELLED = r"(?i)\b(?:never|not|did not|didn't|cancelled|would have|planned to|hoped to)\b"
MODES = {"walked": "foot", "marched": "foot", "rode": "horse", "sailed": "ship", "drove": "carriage", "flew": "air"}


def journeys(sentences: DataFrame) -> DataFrame:
    """pid, ord, start_location, end_location, transport_mode, evidence, inherited of movement sentences.

    sentences: pid, ord, text.  A movement verb with ``from``/``to`` places, not
    negated or cancelled; a missing origin is inherited from the last place
    reached in the passage, and then asks for review.
    """
    text = F.col("text")
    moved = sentences.filter(text.rlike(rf"(?i)\b(?:{VERBS})\b") & ~text.rlike(CANCELLED))
    pick = lambda word: F.nullif(F.regexp_extract(text, rf"\b{word} (?:the )?{PLACE}", 1), F.lit(""))
    verb = F.lower(F.regexp_extract(text, rf"(?i)\b({VERBS})\b", 1))
    by = F.nullif(F.lower(F.regexp_extract(text, r"(?i)\b(?:by|on) (foot|horse|train|coach|boat|ship|rail|carriage|air)\b", 1)), F.lit(""))
    mode = F.coalesce(by, F.element_at(F.create_map(*[F.lit(x) for kv in MODES.items() for x in kv]), verb))
    rows = moved.select("pid", "ord", pick("from").alias("stated"), F.coalesce(pick("to"), pick("at"), pick("into")).alias("end_location"), mode.alias("transport_mode"), text.alias("evidence"))
    past = Window.partitionBy("pid").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("last", F.last("end_location", ignorenulls=True).over(past)).filter(F.col("stated").isNotNull() | F.col("end_location").isNotNull())
    inherited = F.col("stated").isNull() & F.col("last").isNotNull()
    return rows.select("pid", "ord", F.coalesce("stated", "last").alias("start_location"), "end_location", "transport_mode", "evidence", inherited.alias("requires_review"))


def affect_by_lexicon(words: DataFrame, lexicon: DataFrame, negators: tuple[str, ...] = ("no", "not", "never", "without")) -> DataFrame:
    """pid, sentiment, positive, negative, matched: lexicon hits with the two words before as scope of a negator.

    words: pid, pos, word, and perhaps ``before1`` and ``before2``, the words
    before each, without which a passage's words are sorted; lexicon: term,
    polarity (positive, negative).  A passage's hits are counted where they are
    found, by term, and only those counts are shuffled.
    """
    folded = lambda c: F.lower(F.regexp_replace(c, r"^[^\p{L}]+|[^\p{L}]+$", ""))
    if "before1" not in words.columns:
        order = Window.partitionBy("pid").orderBy("pos")
        words = words.withColumns({f"before{k}": F.lag("word", k).over(order) for k in (1, 2)})
    rows = words.withColumn("term", folded("word")).join(lexicon, "term", "left")
    near = F.coalesce(folded("before1").isin(*negators), F.lit(False)) | F.coalesce(folded("before2").isin(*negators), F.lit(False))
    known = F.col("polarity").isNotNull()
    positive = ((F.col("polarity") == "positive") & ~near) | ((F.col("polarity") == "negative") & near)
    hits = rows.select("pid", F.when(known, F.col("term")).alias("term"), F.when(known, positive).alias("positive"))
    counted = hits.groupBy("pid", "term", "positive").agg(F.count("*").alias("n"))
    sums = counted.groupBy("pid").agg(
        F.coalesce(F.sum(F.when(F.col("positive"), F.col("n"))), F.lit(0)).alias("positive"),
        F.coalesce(F.sum(F.when(~F.col("positive"), F.col("n"))), F.lit(0)).alias("negative"),
        F.array_sort(F.collect_set("term")).alias("matched"),
    )
    p, n = F.col("positive"), F.col("negative")
    label = F.when((p > 0) & (p == n), "mixed").when(p > n, "positive").when(n > p, "negative").otherwise("neutral")
    return sums.withColumn("sentiment", label)


def resolve_places(mentions: DataFrame, places: DataFrame, prefer: str | None = None) -> DataFrame:
    """Each mention's best place: status resolved, ambiguous or unresolved, and the number of candidates.

    mentions: mention_id, name; places: name, country, lat, lon, historical.
    ``prefer`` a country orders candidates, it removes none; a historical polity
    is never given coordinates.
    """
    met = mentions.join(places.withColumnRenamed("name", "place_name"), F.lower("name") == F.lower("place_name"), "left")
    rank = F.struct((F.col("country") != F.lit(prefer)).cast("int") if prefer else F.lit(0), "country", "lat", "lon")
    best = met.groupBy("mention_id", "name").agg(
        F.count("place_name").alias("candidates"), F.min_by(F.struct("country", "lat", "lon", "historical"), rank).alias("top")
    )
    gone = F.coalesce(F.col("top.historical"), F.lit(False))
    status = F.when(F.col("candidates") == 0, "unresolved").when(gone, "unresolved").when(F.col("candidates") > 1, "ambiguous").otherwise("resolved")
    sure = status == "resolved"
    return best.select("mention_id", "name", "candidates", status.alias("status"), "top.country", F.when(sure, F.col("top.lat")).alias("lat"), F.when(sure, F.col("top.lon")).alias("lon"))


def features(resolved: DataFrame) -> DataFrame:
    """mention_id, feature (GeoJSON text, null unless resolved), audit (why there is none)."""
    point = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
            F.struct("name", "country").alias("properties"),
        )
    )
    good = (F.col("status") == "resolved") & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return resolved.select("mention_id", F.when(good, point).alias("feature"), F.when(good, None).otherwise(F.col("status")).alias("audit"))


def relation_counts(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """pid, tp, fp, fn of relations that agree in type and both ends; copies count once."""
    keys = ["pid", "type", "source", "target"]
    p, g = predicted.select(*keys).distinct().withColumn("p", F.lit(1)), gold.select(*keys).distinct().withColumn("g", F.lit(1))
    both = p.join(g, keys, "full")
    hit = F.col("p").isNotNull() & F.col("g").isNotNull()
    return both.groupBy("pid").agg(F.count_if(hit).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


def segments(sentences: DataFrame, budget: int, overlap: int = 0) -> DataFrame:
    """pid, seg, text: whole sentences put together up to ``budget`` characters; a longer one stands alone.

    A new segment begins with the last sentences of the one before, as many as
    ``overlap`` characters hold, unless its first own sentence then has no room.
    A fold over a passage's own sentences.
    """
    rows = sentences.groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("all"))
    joined = lambda x: f"array_join({x}, ' ')"
    kept = f"filter(transform(sequence(1, size(a.now)), i -> slice(a.now, i, size(a.now))), x -> length({joined('x')}) <= {int(overlap)})"
    carry = f"coalesce(get({kept}, 0), slice(a.now, 1, 0))"
    fold = f"""aggregate(all, named_struct('done', cast(array() as array<string>), 'now', cast(array() as array<string>)), (a, s) ->
      if(size(a.now) = 0, named_struct('done', a.done, 'now', array(s)),
      if(length({joined("a.now")}) + 1 + length(s) <= {int(budget)}, named_struct('done', a.done, 'now', array_append(a.now, s)),
        named_struct('done', array_append(a.done, {joined("a.now")}),
          'now', if(length({joined(carry)}) + 1 + length(s) <= {int(budget)}, array_append({carry}, s), array(s))))),
      a -> if(size(a.now) = 0, a.done, array_append(a.done, {joined("a.now")})))"""
    return rows.select("pid", F.posexplode(F.expr(fold)).alias("seg", "text"))


def violations(spans: DataFrame, passages: DataFrame) -> DataFrame:
    """span rows whose offsets do not give their text, or whose passage is not there."""
    met = spans.join(passages.select("pid", F.col("text").alias("passage")), "pid", "left")
    found = F.substring("passage", F.col("start") + 1, F.col("end") - F.col("start"))
    why: Column = F.when(F.col("passage").isNull(), "no passage").when(~found.eqNullSafe(F.col("text")), "text/offset mismatch")
    return met.withColumn("why", why).filter(F.col("why").isNotNull()).drop("passage")
