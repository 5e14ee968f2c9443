"""Registered queries of method runs, journeys, affect panels, resources and checks of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import affectpanel as P, evaluate as E, journeys as J, narrative as N, resources as X, spans as S
from marginalia.plans.evaluation import PRF, TRIPS, rule_affect, trips
from marginalia.plans.registry import EVERY_VOTER, ORACLES, SQL_VOTES, TOKENS, VOTERS, gazetteer, query, turns, voters, votes
from marginalia.scratch import materialize
from marginalia.sources.markup import offsets_of
from marginalia.tables import table


def phrases_and_gold(spark: SparkSession, d: str) -> DataFrame:
    """What the layered gazetteer finds in documents (``p`` is 1), and long words as references of the same two labels (``g``)."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pid"), "text")
    listed = materialize(gazetteer(spark, d), "gazetteer")
    label = F.when(F.length("word") % 2 == 0, "TERM").otherwise("PHRASE")
    # A word that is no surface is no find: it is counted where it stands, under keys that are null.
    keys = [F.when(F.col("listed"), F.col(c)).alias(c) for c in ("pid", "start", "end")]
    gold = S.tokens_listed(docs, listed).filter(F.length("word") >= 6).select(*keys, label.alias("label"), F.lit(0).alias("p"), F.lit(1).alias("g"))
    found = S.gazetteer_spans(docs, listed).select("pid", "start", "end", "label", F.lit(1).alias("p"), F.lit(0).alias("g"))
    return found.unionByName(gold)


FOUND = ORACLES["gazetteer_match"].replace("SELECT *, 'PHRASE' AS label FROM pick", ", found AS (SELECT *, 'PHRASE' AS label FROM pick", 1) + "), gold AS (SELECT pid, start, \"end\", CASE WHEN length(word) % 2 = 0 THEN 'TERM' ELSE 'PHRASE' END AS label FROM tk WHERE length(word) >= 6)"


@query(FOUND + """, j AS (SELECT label, 1 AS p, 0 AS g, pid, start, "end" FROM found UNION ALL SELECT label, 0, 1, pid, start, "end" FROM gold), k AS (SELECT label, pid, start, "end", sum(p) AS p, sum(g) AS g FROM j GROUP BY ALL),
s AS (SELECT label, CAST(sum(least(p, g)) AS BIGINT) AS tp, CAST(sum(p - least(p, g)) AS BIGINT) AS fp, CAST(sum(g - least(p, g)) AS BIGINT) AS fn FROM k GROUP BY 1) SELECT *, """ + PRF + " FROM s")
def rules_by_label(spark, d):
    """The gazetteer run as a method, scored by label."""
    counts = S.match_marked(phrases_and_gold(spark, d), ["pid", "start", "end", "label"], ["label"])
    return S.scores(counts, "label")


@query(FOUND + """, a AS (SELECT pid, start, "end" FROM found WHERE label = 'TERM'), b AS (SELECT pid, start, "end" FROM gold WHERE label = 'TERM'), s AS (SELECT (SELECT count(*) FROM a JOIN b USING (pid, start, "end")) AS tp, (SELECT count(*) FROM a) AS n, (SELECT count(*) FROM b) AS m)
SELECT tp, fp, fn, """ + PRF + " FROM (SELECT tp, n - tp AS fp, m - tp AS fn FROM s)")
def rules_one_label(spark, d):
    """One label alone, over the references of that label."""
    return S.scores(S.match_marked(phrases_and_gold(spark, d).filter("label = 'TERM'"), ["pid", "start", "end"], []))


@query("""WITH r AS (SELECT lang, doc_id % 7 AS grp, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic = 1) AS fn, count(*) FILTER (quality = 1) / CAST(count(*) AS DOUBLE) AS coverage FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)
SELECT lang, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(coalesce(2.0 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 1), 6) AS micro_f1, round(avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 1)), 6) AS macro_f1, round(avg(coverage), 6) AS coverage FROM r GROUP BY 1""")
def comparison_rows(spark, d):
    """Rows of a method comparison, summed and averaged, with the mean share of references that it could give."""
    both = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    q, t = F.col("quality"), F.col("toxic")
    rows = both.groupBy("lang", (F.col("doc_id") % 7).alias("grp")).agg(
        F.count_if((q == 1) & (t == 1)).alias("tp"), F.count_if((q == 1) & (t == 0)).alias("fp"), F.count_if((q == 0) & (t == 1)).alias("fn"), F.avg(F.coalesce(q == 1, F.lit(False)).cast("double")).alias("coverage")
    )
    covered = rows.groupBy("lang").agg(F.round(F.avg("coverage"), 6).alias("coverage"))
    return E.micro_macro(rows.drop("coverage"), "lang").join(covered, "lang").select("lang", "tp", "fp", "fn", "micro_f1", "macro_f1", "coverage")


def journey_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Journeys that rules read from one-sentence passages, and what the sentences were made from."""
    made = J.dealt(trips(spark, d).withColumn("pid", F.col("ord")))
    k = F.col("pid")
    absent = F.lit(None).cast("string")
    whole = [F.lit(0).alias("evidence_start"), F.length("text").alias("evidence_end")]
    found = N.journeys(made).select("pid", F.lit(0).alias("p"), "start_location", "end_location", "transport_mode", absent.alias("date"), absent.alias("journey_reason"), F.lit(0).alias("evidence_start"), F.length("evidence").alias("evidence_end"), F.col("evidence").alias("evidence_quote"))
    customers = table(spark, d, "orders").select(F.col("o_orderkey").cast("int").alias("pid"), "o_custkey")
    a = F.concat(F.lit("TOWN"), F.substring(F.lit("ABCDEFGHIJ"), (F.col("o_custkey") % 10 + 1).cast("int"), F.lit(1)))
    b = F.concat(F.lit(" New  "), F.upper(F.substring(F.lit("klmnopqrst"), (k % 10 + 1).cast("int"), F.lit(1))), F.lit("ford"))
    mode = F.when(k % 4 == 0, "by train").when(k % 3 == 0, "walking").when(k % 3 == 1, "boat")
    truth = made.join(customers, "pid").select("pid", F.lit(0).alias("r"), a.alias("start_location"), b.alias("end_location"), mode.alias("transport_mode"), absent.alias("date"), absent.alias("journey_reason"), *whole, F.col("text").alias("evidence_quote"))
    return found, truth


@query("WITH " + TRIPS + " SELECT CAST(count(*) FILTER (NOT never) AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp, CAST(count(*) FILTER (never) AS BIGINT) AS fn FROM trip")
def journey_counts(spark, d):
    found, truth = journey_sides(spark, d)
    return J.counts(found, truth, J.matched(found, truth)).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])


@query("WITH " + TRIPS + """, l AS (SELECT 'start_location' AS field, a AS r, CASE WHEN says_from THEN a END AS p FROM trip WHERE NOT never UNION ALL SELECT 'end_location', b, b FROM trip WHERE NOT never
 UNION ALL SELECT 'transport_mode', CASE WHEN by_train THEN 'train' WHEN verb = 'walked' THEN 'foot' WHEN verb = 'sailed' THEN 'ship' END, CASE WHEN by_train THEN 'train' WHEN verb = 'walked' THEN 'foot' WHEN verb = 'sailed' THEN 'ship' END FROM trip WHERE NOT never)
SELECT field, CAST(count(*) FILTER (r = p) AS BIGINT) AS correct, CAST(count(*) FILTER (r IS NOT NULL AND p IS NULL) AS BIGINT) AS missing_prediction, CAST(count(*) FILTER (r <> p) AS BIGINT) AS mismatch, CAST(count(*) FILTER (r IS NULL AND p IS NULL) AS BIGINT) AS both_missing FROM l GROUP BY 1""")
def journey_fields(spark, d):
    found, truth = journey_sides(spark, d)
    scored = J.fields_of(found, truth, J.matched(found, truth), ("start_location", "end_location", "transport_mode"))
    return scored.select("field", "correct", "missing_prediction", "mismatch", "both_missing")


@query("""WITH q AS (SELECT conv_id * 1000 + turn AS pid, text, CASE turn % 3 WHEN 0 THEN substr(text, 4, 9) WHEN 1 THEN 'zq' || text ELSE text END AS quote, CASE WHEN turn % 4 = 0 THEN 1.4 ELSE 0.5 END AS confidence, turn % 5 = 0 AS odd, turn % 2 = 0 AS inferred FROM conversations)
SELECT pid, least(confidence, 1.0) AS confidence, CASE WHEN length(quote) > 0 THEN CAST((length(text) - length(replace(text, quote, ''))) / length(quote) AS INTEGER) ELSE 0 END AS evidence_match_count, CASE WHEN length(quote) > 0 AND contains(text, quote) THEN CAST(strpos(text, quote) - 1 AS INTEGER) ELSE -1 END AS evidence_start,
 odd OR inferred OR NOT (length(quote) > 0 AND contains(text, quote)) AS requires_review FROM q""")
def checked_records(spark, d):
    passages = turns(spark, d)
    t = F.col("turn")
    quote = F.when(t % 3 == 0, F.substring("text", 4, 9)).when(t % 3 == 1, F.concat(F.lit("zq"), "text")).otherwise(F.col("text"))
    statuses = F.create_map(F.lit("date"), F.when(t % 5 == 0, "certain").otherwise("explicit"), F.lit("start_location"), F.when(t % 2 == 0, "contextual_inference").otherwise("not_stated"))
    records = passages.select("pid", quote.alias("evidence_quote"), F.when(t % 4 == 0, 1.4).otherwise(0.5).alias("confidence"), statuses.alias("statuses"))
    return J.checked(records, passages).select("pid", "confidence", "evidence_match_count", F.coalesce("evidence_start", F.lit(-1)).alias("evidence_start"), "requires_review")


@query("""WITH n AS (SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_regionkey = 4 THEN 'unresolved' WHEN n_regionkey = 3 THEN 'ambiguous' ELSE 'resolved' END AS status, n_nationkey * 7.0 - 80 AS lon FROM nation)
SELECT a.k AS k, CASE WHEN a.status = 'resolved' AND b.status = 'resolved' THEN a.lon END AS lon, CASE WHEN a.status = 'resolved' AND b.status = 'resolved' THEN b.lon END AS lon2,
 nullif(array_to_string(list_filter([CASE WHEN a.status <> 'resolved' THEN 'start: ' || a.status END, CASE WHEN b.k IS NULL THEN 'end: unresolved' WHEN b.status <> 'resolved' THEN 'end: ' || b.status END], lambda x: x IS NOT NULL), '; '), '') AS audit FROM n a LEFT JOIN n b ON b.k = a.k + 1""")
def journey_lines(spark, d):
    n = table(spark, d, "nation")
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    status = F.when(r == 4, "unresolved").when(r == 3, "ambiguous").otherwise("resolved")
    places = n.select(F.col("n_name").alias("name"), status.alias("status"), (k * 3.0 - 30).alias("lat"), (k * 7.0 - 80).alias("lon"))
    following = n.select((k - 1).alias("k"), F.lower("n_name").alias("end_location"))
    journeys = n.select(k.alias("k"), F.lower("n_name").alias("start_location")).join(following, "k", "left").withColumn("end_location", F.coalesce("end_location", F.lit("nowhere")))
    made = J.lines(journeys, places, "k")
    at = F.from_json("feature", "geometry struct<coordinates: array<array<double>>>")["geometry"]["coordinates"]
    return made.select("k", F.get(F.get(at, F.lit(0)), F.lit(0)).alias("lon"), F.get(F.get(at, F.lit(1)), F.lit(0)).alias("lon2"), "audit")


AFFECT = ORACLES["rule_affect"].replace("SELECT *, CASE WHEN positive > 0 AND positive = negative", ", e AS (SELECT *, CASE WHEN positive > 0 AND positive = negative", 1) + ")"
SENTIMENTS = ["positive", "negative", "neutral", "mixed"]


@query(AFFECT + """, r AS (SELECT sentiment AS p, CASE WHEN quality = 1 THEN 'positive' WHEN toxic = 1 THEN 'negative' ELSE 'neutral' END AS r FROM e JOIN labels ON doc_id = pid), l AS (SELECT unnest(['positive', 'negative', 'neutral', 'mixed']) AS label),
sc AS (SELECT label, CAST(count(*) FILTER (r = label AND p = label) AS BIGINT) AS tp, CAST(count(*) FILTER (p = label AND r <> label) AS BIGINT) AS fp, CAST(count(*) FILTER (r = label AND p <> label) AS BIGINT) AS fn FROM r, l GROUP BY 1)
SELECT *, """ + PRF.replace(", 4)", ", 6)") + " FROM sc")
def affect_by_label(spark, d):
    """The lexicon run as a method, scored by sentiment."""
    return P.label_scores(affect_pairs(spark, d), SENTIMENTS)


@query(AFFECT + """, r AS (SELECT sentiment AS p, CASE WHEN quality = 1 THEN 'positive' WHEN toxic = 1 THEN 'negative' ELSE 'neutral' END AS r FROM e JOIN labels ON doc_id = pid), l AS (SELECT unnest(['positive', 'negative', 'neutral', 'mixed']) AS label),
sc AS (SELECT label, round(coalesce(2.0 * count(*) FILTER (r = label AND p = label) / nullif(count(*) FILTER (p = label) + count(*) FILTER (r = label), 0), 0), 6) AS f1 FROM r, l GROUP BY 1)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM r) AS n, (SELECT round(avg(CAST(p = r AS DOUBLE)), 6) FROM r) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM sc""")
def affect_macro(spark, d):
    return P.sentiment_scores(affect_pairs(spark, d), SENTIMENTS)


def affect_pairs(spark: SparkSession, d: str) -> DataFrame:
    truth = F.when(F.col("quality") == 1, "positive").when(F.col("toxic") == 1, "negative").otherwise("neutral")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("pid"), truth.alias("reference"))
    return rule_affect(spark, d).join(labels, "pid").select("reference", F.col("sentiment").alias("predicted"))


@query(SQL_VOTES + ", w AS (SELECT unnest(range(7)) AS voter), i AS (SELECT DISTINCT item FROM v) SELECT w.voter AS voter, coalesce(label, 'NONE') AS label, CAST(count(*) AS BIGINT) AS n FROM i CROSS JOIN w LEFT JOIN v USING (item, voter) GROUP BY 1, 2")
def votes_and_abstentions(spark, d):
    full = P.with_abstentions(votes(spark, d).withColumn("voter", F.col("voter").cast("string")), [str(k) for k in range(7)])
    return full.groupBy(F.col("voter").cast("long").alias("voter"), "label").agg(F.count("*").alias("n"))


@query(SQL_VOTES + ", c AS (SELECT label, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY 1) SELECT label, n, CAST(row_number() OVER (ORDER BY n DESC, label) AS INTEGER) AS rank FROM c")
def vote_distribution(spark, d):
    return P.distribution(votes(spark, d))


@query()
def panel_report(spark, d):
    v = votes(spark, d).withColumn("voter", F.concat(F.lit("u"), F.col("voter")))
    return P.report(v, ["click", "view", "purchase"], [f"u{k}" for k in range(7)])


@query("""SELECT user_id, event_id, CAST(row_number() OVER w - 1 AS INTEGER) AS step, value, round(avg(value) OVER w, 9) AS so_far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def affect_trajectory(spark, d):
    return P.trajectory(table(spark, d, "events"), "user_id", "event_id", F.col("value"))


@query("""WITH s AS (SELECT event_type AS voter, round(avg(value), 6) AS f1, round(avg(value), 6) - count(*) % 7 AS low, round(avg(value), 6) + count(*) % 5 AS high FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY f1 DESC, voter) AS k FROM s)
SELECT a.voter AS first, b.voter AS second, a.low <= b.high AS overlapping FROM r a, r b WHERE a.k = 1 AND b.k = 2""")
def leading_two(spark, d):
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("voter")).agg(F.round(F.avg("value"), 6).alias("f1"), F.count("*").alias("n"))
    return P.leading(s.select("voter", "f1", (F.col("f1") - F.col("n") % 7).alias("low"), (F.col("f1") + F.col("n") % 5).alias("high")))


@query()
def bootstrap_mean(spark, d):
    return P.bootstrap_mean(table(spark, d, "events"), "event_type", "event_id", "value")


WORD_LISTS = """l AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'brands' ELSE 'types' END AS layer, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE lower(p_type) END AS term, CASE WHEN p_partkey % 2 = 0 THEN 'TOPONYM' ELSE 'GEONOUN' END AS label, p_partkey % 2 = 1 AS any_case, p_partkey AS nth FROM part),
f AS (SELECT layer, lower(trim(term)) AS key, arg_min(trim(term), nth) AS term, arg_min(label, nth) AS label, arg_min(any_case, nth) AS any_case FROM l GROUP BY 1, 2),
pl AS (SELECT DISTINCT layer, CASE WHEN regexp_matches(key, '[^aeiou]y$') THEN regexp_replace(key, 'y$', '') || 'ies' WHEN regexp_matches(key, '(s|x|z|ch|sh)$') THEN key || 'es' ELSE key || 's' END AS key, label, any_case FROM f),
b AS (SELECT layer, term, label, any_case, false AS generated, CASE WHEN label = 'GEONOUN' THEN CASE WHEN length(term) <= 3 THEN 'short' WHEN NOT contains(term, ' ') AND regexp_matches(lower(term), '(keeper|wright|smith|monger|maker|ist|man|men)$') THEN 'person' END END AS risk FROM f
 UNION ALL SELECT layer, key, label, any_case, true, NULL FROM pl WHERE (layer, key) NOT IN (SELECT layer, key FROM f))"""


def word_lists(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("p_partkey") % 2 == 0
    term = F.when(even, F.col("p_brand")).otherwise(F.lower("p_type"))
    return table(spark, d, "part").select(F.when(even, "brands").otherwise("types").alias("layer"), term.alias("term"), F.when(even, "TOPONYM").otherwise("GEONOUN").alias("label"), (~even).alias("any_case"), F.col("p_partkey").alias("at"))


@query("WITH " + WORD_LISTS + " SELECT * FROM b")
def gazetteer_layers(spark, d):
    return X.build_layers(word_lists(spark, d))


@query("WITH " + WORD_LISTS + """ SELECT layer, CAST(count(*) FILTER (NOT generated) AS BIGINT) AS terms, CAST(count(*) FILTER (generated) AS BIGINT) AS generated, CAST(count(risk) AS BIGINT) AS needs_review,
 (SELECT count(*) FROM l WHERE l.layer = b.layer) - CAST(count(*) FILTER (NOT generated) AS BIGINT) AS dropped FROM b GROUP BY 1""")
def gazetteer_layer_stats(spark, d):
    lists = word_lists(spark, d)
    return X.layer_stats(X.build_layers(lists), lists)


@query(VOTERS + """, m AS (SELECT tk.pid, tk.pos, arg_min({'s': a.start, 'l': a.label}, {'s': a.start, 'e': a."end", 'l': a.label}) AS g FROM tk JOIN a ON a.pid = tk.pid AND a.start < tk."end" AND tk.start < a."end" GROUP BY 1, 2)
SELECT tk.pid, tk.pos, CASE WHEN g IS NULL THEN 'O' WHEN g.s >= tk.start THEN 'B-' || g.l ELSE 'I-' || g.l END AS role FROM tk LEFT JOIN m USING (pid, pos)""")
def bio_roles(spark, d):
    words = S.tokens(turns(spark, d)).withColumn("pos", F.col("pos").cast("long"))
    return X.bio(words, voters(spark, d)["capital"]).select("pid", "pos", "role")


@query(EVERY_VOTER + """ SELECT voter, CAST(count(*) AS BIGINT) AS emitted, CAST(count(*) FILTER (label = 'PLACE') AS BIGINT) AS scored, CAST(count(*) FILTER (label <> 'PLACE') AS BIGINT) AS dropped FROM u GROUP BY 1""")
def scored_labels(spark, d):
    a, b, c = voters(spark, d).values()
    return X.scored_labels(a.unionByName(b).unionByName(c), ["PLACE"], "voter")


@query(EVERY_VOTER + " SELECT label, CAST(count(*) AS BIGINT) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM u GROUP BY 1")
def label_inventory(spark, d):
    a, b, c = voters(spark, d).values()
    return X.label_inventory(a.unionByName(b).unionByName(c))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type) FILTER (event_type NOT IN ('click', 'view'))), ',') AS unexpected FROM events GROUP BY 1 HAVING count(*) FILTER (event_type NOT IN ('click', 'view')) > 0")
def unexpected_labels(spark, d):
    found = X.outside(table(spark, d, "events").withColumnRenamed("event_type", "label"), ["click", "view"], "user_id")
    return found.withColumn("unexpected", F.array_join("unexpected", ","))


@query("WITH w AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS f FROM lineitem), h AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS f FROM lineitem WHERE l_linenumber = 1) SELECT k, CAST(count(*) AS BIGINT) AS expected, CAST(count(*) FILTER ((k, f) NOT IN (SELECT k, f FROM h)) AS BIGINT) AS missing FROM w GROUP BY 1")
def expected_found(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("f"), "l_linenumber")
    return X.expected_found(rows.filter("l_linenumber = 1"), rows, "k", "f")


@query("SELECT source, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(lang = 'fr' AS DOUBLE)), 6) AS share, avg(CAST(lang = 'fr' AS DOUBLE)) < 0.15 AS low FROM documents GROUP BY 1")
def stratum_shares(spark, d):
    return X.shares(table(spark, d, "documents"), "source", F.col("lang") == "fr")


@query("SELECT round(avg(n_nationkey * 3.0 - 30), 6) AS lat, round(avg(n_nationkey * 7.0 - 80), 6) AS lon FROM nation WHERE n_regionkey <> 4")
def map_centre(spark, d):
    k = F.col("n_nationkey")
    return X.centre(table(spark, d, "nation").select(F.when(F.col("n_regionkey") != 4, k * 3.0 - 30).alias("lat"), (k * 7.0 - 80).alias("lon")))


@query(VOTERS + """ SELECT a.pid, start, "end", substr(text, start + 1, "end" - start) AS text, substr(text, greatest(0, start - 60) + 1, "end" + 60 - greatest(0, start - 60)) AS context FROM a JOIN p ON p.pid = a.pid""")
def queue_context(spark, d):
    return X.queue_with_context(voters(spark, d)["capital"].select("pid", "start", "end"), turns(spark, d))


@query(r"""WITH r AS (SELECT page_id, regexp_extract_all(html, '(?s)<[^>]*(?:>|$)|\s+|[^<\s]+') AS x FROM pages) SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), ' ([,.;:!?)\]}’”])', '\1', 'g')) AS n FROM r JOIN pages USING (page_id)""")
def offset_map(spark, d):
    made = offsets_of(F.col("html"))
    return table(spark, d, "pages").select("page_id", made.alias("x")).select("page_id", F.length("x.clean").cast("long").alias("n")).filter("n is not null")


@query()
def harvested(spark, d):
    return X.harvest(table(spark, d, "documents").select("doc_id", "text"), "doc_id", prefix="d-")
