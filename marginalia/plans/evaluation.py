"""Registered queries of evaluation, panels, text checks and rule layers."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import annotators as A, cuts, evaluate as E, narrative as N, records as R, spans as S, votes as V
from marginalia.plans.registry import CAPITAL, DOC_TOKENS, EVERY_VOTER, SQL_SENTENCES, SQL_VOTES, TOKENS, VOTERS, query, turns, voters, votes
from marginalia.sources import catalogue as C
from marginalia.tables import table

MEETS = 'x.pid = y.pid AND x.start < y."end" AND y.start < x."end"'


@query(VOTERS + f' SELECT pid, start, "end" FROM b x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE {MEETS})')
def suppressed_spans(spark, d):
    v = voters(spark, d)
    return A.suppressed(v["long"], v["comma"]).select("pid", "start", "end")


@query(VOTERS + f""" SELECT pid, start, "end", CASE WHEN EXISTS (SELECT 1 FROM b y WHERE {MEETS}) THEN 'PLACE' ELSE 'REJECT' END AS gold FROM a x""")
def cluster_gold(spark, d):
    v = voters(spark, d)
    return A.gold_label(v["capital"].select("pid", "start", "end"), v["long"])


@query(EVERY_VOTER + """ SELECT voter, CAST(count(*) AS BIGINT) AS n FROM u WHERE NOT (voter = 'capital' AND pid IN (SELECT pid FROM p WHERE turn = 0)) GROUP BY 1""")
def excluded_pairs(spark, d):
    v = voters(spark, d)
    seen = turns(spark, d).filter("turn = 0").select("pid", F.lit("capital").alias("voter"))
    return A.without(v["capital"].unionByName(v["long"]).unionByName(v["comma"]), seen).groupBy("voter").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT lang, source, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic = 1) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2),
s AS (SELECT lang, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(avg(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 1)), 6) AS macro_precision, round(avg(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 1)), 6) AS macro_recall, round(avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 1)), 6) AS macro_f1 FROM r GROUP BY 1)
SELECT *, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 1), 6) AS micro_precision, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 1), 6) AS micro_recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 1), 6) AS micro_f1 FROM s""")
def micro_macro(spark, d):
    both = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")
    q, t = F.col("quality"), F.col("toxic")
    rows = both.groupBy("lang", "source").agg(F.count_if((q == 1) & (t == 1)).alias("tp"), F.count_if((q == 1) & (t == 0)).alias("fp"), F.count_if((q == 0) & (t == 1)).alias("fn"))
    return E.micro_macro(rows, "lang")


@query(SQL_VOTES + """, c AS (SELECT item, label, count(*) AS n FROM v GROUP BY 1, 2), b AS (SELECT item, max(n) AS n, arg_max(label, n) AS label FROM c GROUP BY 1),
g AS (SELECT CAST(floor(event_id / 20.0) AS BIGINT) AS item, arg_min(event_type, event_id) AS gold FROM events GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS items, round(avg(CAST(CASE WHEN n > 3.5 THEN label ELSE 'REJECT' END = gold AS DOUBLE)), 6) AS accuracy FROM b JOIN g USING (item)""")
def majority_accuracy(spark, d):
    gold = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 20).alias("item")).agg(F.min_by("event_type", "event_id").alias("gold"))
    return E.majority_accuracy(votes(spark, d), gold, 7)


@query(SQL_VOTES + """, w AS (SELECT a.voter AS voter_a, b.voter AS voter_b, avg(CAST(a.label = b.label AS DOUBLE)) AS agreement FROM v a JOIN v b ON a.item = b.item AND a.voter < b.voter GROUP BY 1, 2)
(SELECT 'most' AS kind, * FROM w ORDER BY agreement DESC, voter_a, voter_b LIMIT 1) UNION ALL (SELECT 'least', * FROM w ORDER BY agreement, voter_a, voter_b LIMIT 1)""")
def agreement_extremes(spark, d):
    return E.extremes(V.pairwise(votes(spark, d)))


@query("""SELECT user_id, CAST(count(*) AS BIGINT) AS reference_total, CAST(count(*) FILTER (event_type IN ('click', 'purchase')) AS BIGINT) AS supported,
round(count(*) FILTER (event_type IN ('click', 'purchase')) / CAST(count(*) AS DOUBLE), 6) AS ceiling FROM events GROUP BY 1""")
def ontology_ceiling(spark, d):
    return E.supported(table(spark, d, "events"), "user_id", "event_type", ["click", "purchase"])


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(coalesce(value > 50, false) AS DOUBLE)), 6) AS large_rate, round(avg(CAST(coalesce(value < 5, false) AS DOUBLE)), 6) AS small_rate FROM events GROUP BY 1")
def audit_rates(spark, d):
    return E.audit_rates(table(spark, d, "events"), "event_type", {"large": F.col("value") > 50, "small": F.col("value") < 5})


@query("""WITH e AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'accept' WHEN 'view' THEN 'edit' WHEN 'purchase' THEN 'reject' END AS action FROM events),
r AS (SELECT user_id, coalesce(bool_or(action IN ('accept', 'edit', 'reject')), false) AS seen, coalesce(bool_or(action IN ('edit', 'reject')), false) AS changed FROM e GROUP BY 1)
SELECT CAST(count(*) FILTER (seen) AS BIGINT) AS records_reviewed, CAST(count(*) FILTER (changed) AS BIGINT) AS records_corrected FROM r""")
def correction_burden(spark, d):
    kinds = F.create_map(*[F.lit(x) for x in ("click", "accept", "view", "edit", "purchase", "reject")])
    return E.correction_burden(table(spark, d, "events").select("user_id", F.element_at(kinds, F.col("event_type")).alias("action")), "user_id", "action")


@query("""WITH s AS (SELECT conv_id, CAST(coalesce(sum(length(text)) FILTER (role = 'user'), 0) AS BIGINT) AS i, CAST(coalesce(sum(length(text)) FILTER (role <> 'user'), 0) AS BIGINT) AS o FROM conversations GROUP BY 1)
SELECT conv_id, i AS chars_in, o AS chars_out, round(i * CAST(4e-6 AS DOUBLE) + o * CAST(2e-5 AS DOUBLE), 6) AS cost FROM s""")
def usage_cost(spark, d):
    size, user = F.length("text"), F.col("role") == "user"
    sums = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.coalesce(F.sum(F.when(user, size)), F.lit(0)).alias("chars_in"), F.coalesce(F.sum(F.when(~user, size)), F.lit(0)).alias("chars_out")
    )
    return sums.withColumn("cost", E.token_cost(F.col("chars_in"), F.col("chars_out"), 4.0, 20.0))


@query(TOKENS + r""", r AS (SELECT regexp_matches(word, '^\p{Lu}\p{Ll}') AS g, length(word) >= 9 AS p FROM tk), s AS (SELECT CAST(count(*) FILTER (g AND p) AS BIGINT) AS tp, CAST(count(*) FILTER (p AND NOT g) AS BIGINT) AS fp, CAST(count(*) FILTER (g AND NOT p) AS BIGINT) AS fn FROM r)
SELECT *, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 1), 6) AS precision, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 1), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 1), 6) AS f1 FROM s""")
def token_roles(spark, d):
    role = lambda c: F.when(c, "PLACE").otherwise("O")
    words = S.tokens(turns(spark, d)).select(role(F.col("word").rlike(CAPITAL)).alias("g"), role(F.length("word") >= 9).alias("p"))
    return E.token_role_scores(words, "g", "p")


@query("""WITH p AS (SELECT l.doc_id, sha256(CASE WHEN quality = 1 THEN text ELSE lower(text) END) AS h FROM labels l LEFT JOIN documents d USING (doc_id))
SELECT coalesce(d.doc_id, p.doc_id) AS doc_id, CASE WHEN p.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'unknown' WHEN sha256(d.text) IS NOT DISTINCT FROM p.h THEN 'ok' ELSE 'changed' END AS status FROM documents d FULL JOIN p ON d.doc_id = p.doc_id""")
def prediction_status(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    made = table(spark, d, "labels").join(docs, "doc_id", "left").select("doc_id", F.sha2(F.when(F.col("quality") == 1, F.col("text")).otherwise(F.lower("text")), 256).alias("source_sha256"))
    return E.prediction_status(docs, made, "doc_id")


@query("SELECT doc_id, source, CASE WHEN (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 15 >= 12 THEN 'dev' ELSE 'train' END AS split FROM documents")
def holdout_split(spark, d):
    return E.holdout_split(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")


@query(SQL_VOTES + """, m AS (SELECT item, count(DISTINCT label) = 1 AS u FROM v GROUP BY 1)
(SELECT item, 'A' AS stratum FROM m WHERE u ORDER BY md5('2026:' || CAST(item AS VARCHAR)), item LIMIT 40) UNION ALL SELECT item, 'B' FROM m WHERE NOT u""")
def adjudication_queue(spark, d):
    return E.queue(V.profile(votes(spark, d)), "item", "unanimous")


def fold_sql(x: str) -> str:
    """Long s, accents, quotes and dashes folded, white space collapsed, lower case."""
    quotes = "".join(map(chr, [0x2018, 0x2019, 0x201C, 0x201D, *range(0x2010, 0x2016)]))
    plain = "'" * 4 + '""------'
    return f"lower(trim(regexp_replace(translate(strip_accents(replace({x}, 'ſ', 's')), '{quotes}', '{plain}'), '[{T.SPACE}]+', ' ', 'g'), ' '))"


@query("WITH " + SQL_SENTENCES + rf""", e AS (SELECT doc_id, trim(regexp_replace(sentence, '[{T.SPACE}]+', ' ', 'g'), ' ') AS s FROM sentences QUALIFY ord = 0 OR ord = max(ord) OVER (PARTITION BY doc_id)),
q AS (SELECT doc_id, unnest([s, replace(s, ' ', '  '), replace(s, ' ', ''), array_to_string(list_reverse(string_split(s, ' ')), ' '), s || '!', 'zq ' || s, translate(s, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '']) AS quote FROM e),
n AS (SELECT doc_id, quote, text, contains({fold_sql('text')}, {fold_sql('quote')}) AS folded, trim(quote, ' .,;:''"') AS bare, list_filter(regexp_split_to_array(quote, '[{T.SPACE}]+'), lambda w: length(w) > 0) AS ws FROM q JOIN documents USING (doc_id)),
r AS (SELECT doc_id, CASE WHEN length(coalesce(quote, '')) = 0 THEN 'empty' WHEN contains(text, quote) THEN 'present_but_exhausted' WHEN folded AND contains(text, 'ſ') AND contains(translate(text, 'ſ', 's'), translate(quote, 'ſ', 's')) THEN 'long_s_normalised'
  WHEN folded THEN 'other_normalisation' WHEN length(bare) > 0 AND contains(text, bare) THEN 'whitespace_or_punctuation' WHEN len(ws) > 0 AND len(list_filter(ws, lambda w: NOT contains(text, w))) = 0 THEN 'words_present_reordered_or_gapped' ELSE 'not_in_passage_at_all' END AS reason FROM n)
SELECT doc_id, reason, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2""")
def miss_reasons(spark, d):
    """The first and the last sentence of each document, changed in seven ways, looked for in the whole text."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    each = T.sentences(docs, ["doc_id"])
    ends = each.groupBy("doc_id").agg(F.max("ord").alias("last"))
    s = F.trim(F.regexp_replace("sentence", f"[{T.SPACE}]+", " "))
    picked = each.join(ends, "doc_id").filter((F.col("ord") == 0) | (F.col("ord") == F.col("last"))).select("doc_id", s.alias("s"))
    x = F.col("s")
    made = F.array(x, F.replace(x, F.lit(" "), F.lit("  ")), F.replace(x, F.lit(" "), F.lit("")), F.array_join(F.reverse(F.split(x, " ")), " "), F.concat(x, F.lit("!")), F.concat(F.lit("zq "), x), F.translate(x, string.ascii_lowercase, string.ascii_uppercase), F.lit(""))
    quotes = picked.select("doc_id", F.explode(made).alias("quote")).join(docs, "doc_id")
    return quotes.groupBy("doc_id", T.miss_reason(F.col("quote"), F.col("text")).alias("reason")).agg(F.count("*").alias("n"))


@query(DOC_TOKENS + r""", g AS (SELECT DISTINCT lower(word) AS term FROM tk)
SELECT term, CASE WHEN length(term) <= 3 THEN 'short' WHEN term IN ('roofer', 'broom', 'cathouse', 'second-floor', 'plumber', 'glazier', 'joiner', 'mason', 'carpenter', 'tiler') THEN 'denied'
 WHEN regexp_matches(term, '(keeper|wright|smith|monger|maker|ist|man|men)$') AND NOT contains(term, ' ') THEN 'person' END AS risk FROM g""")
def risky_terms(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pid"), "text")
    terms = cuts.term_counts(docs).select("term").distinct()
    return terms.select("term", T.risky_term(F.col("term")).alias("risk"))


@query("SELECT doc_id, sha1(encode('blob ' || CAST(strlen(text) AS VARCHAR)) || '\\x00'::BLOB || encode(text)) AS blob_id FROM documents")
def git_blob_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", T.git_blob_id(F.col("text")).alias("blob_id"))


@query(r"""WITH m AS (SELECT doc_id, text, length(text) // 2 AS s, least(length(text), length(text) // 2 + 10) AS e FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(CASE WHEN regexp_matches(substr(text, s + 1, 1), '[\p{L}\p{N}]') THEN s - length(regexp_extract(substr(text, 1, s), '[\p{L}\p{N}]*$')) ELSE s END AS INTEGER) AS start,
CAST(CASE WHEN regexp_matches(substr(text, e, 1), '[\p{L}\p{N}]') THEN e + length(regexp_extract(substr(text, e + 1), '^[\p{L}\p{N}]*')) ELSE e END AS INTEGER) AS "end" FROM m""")
def snapped_spans(spark, d):
    """Ten characters from the middle of each text."""
    docs = table(spark, d, "documents").filter(F.length("text") > 0).withColumn("s", F.floor(F.length("text") / 2).cast("int")).withColumn("e", F.least(F.length("text"), F.col("s") + 10))
    start, end = A.snapped(F.col("text"), F.col("s"), F.col("e"))
    return docs.select("doc_id", start.cast("int").alias("start"), end.cast("int").alias("end"))


@query(r"""WITH r AS (SELECT page_id, regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>', 1) AS x FROM pages), u AS (SELECT page_id, unnest(x) AS t, generate_subscripts(x, 1) AS ord FROM r)
SELECT page_id, CAST(ord AS INTEGER) AS ord, trim(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'), ' ') AS text FROM u""")
def page_paragraphs(spark, d):
    return table(spark, d, "pages").select("page_id", F.inline(C.paragraphs(F.col("html")))).select("page_id", "ord", "text")


@query(r"""SELECT lower(tag) AS tag, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([A-Za-z][\w:.-]*)', 1)) AS tag FROM pages) GROUP BY 1 ORDER BY n DESC, tag LIMIT 12""")
def tag_profile(spark, d):
    return C.tag_profile(table(spark, d, "pages"), "html")


EDGE = r"(^|$|[^\p{L}\p{N}_])"


@query(rf"""SELECT doc_id, len(list_filter(regexp_extract_all(regexp_replace(text, '[^\p{{L}}\p{{N}}_]', '  ', 'g'), '(?:^| )([A-Z][a-z]{{2,}})(?:$| )', 1), lambda w: w NOT IN ('The', 'This', 'That', 'There', 'These', 'Those', 'When', 'What'))) > 0
 OR regexp_matches(text, '(?i){EDGE}(roads?|lakes?|hills?|fells?|rivers?|valley|vale|bridge|mountains?|village|town|church|inn|path|track|shore|coast|woods?|camp|ghetto|station|border|street|fields?|stream|beck){EDGE}')
 OR regexp_matches(text, '(?i){EDGE}(miles?|leagues?|yards?|hours?\s+(walk|ride|journey)){EDGE}') AS positive FROM documents""")
def positive_flag(spark, d):
    return table(spark, d, "documents").select("doc_id", T.is_positive(F.col("text")).alias("positive"))


def _commas(text: str) -> list[dict]:
    return [{"start": k, "end": k + 1, "label": "COMMA"} for k, c in enumerate(text) if c == ","]


def _failing(text: str) -> list[dict]:
    if "," in text:
        raise RuntimeError("unreadable")
    return []


@query("WITH p AS (SELECT conv_id * 1000 + turn AS pid, length(text) - length(replace(text, ',', '')) AS n FROM conversations) SELECT pid, 'commas' AS voter, CAST(n AS INTEGER) AS n, NULL AS error FROM p UNION ALL SELECT pid, 'failing', 0, CASE WHEN n > 0 THEN 'RuntimeError: unreadable' END FROM p")
def panel_run(spark, d):
    ran = A.run_panel(turns(spark, d).select("pid", "text"), {"commas": _commas, "failing": _failing})
    return ran.select("pid", "voter", F.size("spans").alias("n"), "error")


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return T.sentences(table(spark, d, "documents"), ["doc_id"]).select(F.col("doc_id").alias("pid"), "ord", F.col("sentence").alias("text"))


#: Sentences made of the tables, so that what a reader should find in them is known.
TRIPS = """trip AS (SELECT o_custkey AS pid, CAST(o_orderkey AS INTEGER) AS ord, CASE o_orderkey % 3 WHEN 0 THEN 'walked' WHEN 1 THEN 'sailed' ELSE 'travelled' END AS verb, o_orderkey % 5 <> 0 AS says_from, o_orderkey % 7 = 0 AS never,
  'Town' || substr('abcdefghij', 1 + CAST(o_custkey % 10 AS INTEGER), 1) AS a, 'New ' || upper(substr('klmnopqrst', 1 + CAST(o_orderkey % 10 AS INTEGER), 1)) || 'ford' AS b, o_orderkey % 4 = 0 AS by_train FROM orders)"""


def trips(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    verb = F.when(k % 3 == 0, "walked").when(k % 3 == 1, "sailed").otherwise("travelled")
    a = F.concat(F.lit("Town"), F.substring(F.lit("abcdefghij"), (c % 10 + 1).cast("int"), F.lit(1)))
    b = F.concat(F.lit("New "), F.upper(F.substring(F.lit("klmnopqrst"), (k % 10 + 1).cast("int"), F.lit(1))), F.lit("ford"))
    text = F.concat(F.when(k % 7 == 0, "She never ").otherwise("She "), verb, F.when(k % 5 != 0, F.concat(F.lit(" from "), a)).otherwise(""), F.lit(" to "), b, F.when(k % 4 == 0, " by train.").otherwise("."))
    return table(spark, d, "orders").select(c.alias("pid"), k.cast("int").alias("ord"), text.alias("text"))


@query("WITH " + TRIPS + """, m AS (SELECT *, lag(b) OVER (PARTITION BY pid ORDER BY ord) AS before FROM trip WHERE NOT never)
SELECT pid, ord, CASE WHEN says_from THEN a ELSE before END AS start_location, b AS end_location, CASE WHEN by_train THEN 'train' WHEN verb = 'walked' THEN 'foot' WHEN verb = 'sailed' THEN 'ship' END AS transport_mode, NOT says_from AND before IS NOT NULL AS requires_review FROM m""")
def rule_journeys(spark, d):
    return N.journeys(trips(spark, d)).drop("evidence")


LEXICON = [("the", "positive"), ("la", "positive"), ("die", "positive"), ("of", "negative"), ("le", "negative"), ("und", "negative")]


@query(DOC_TOKENS + r""", t AS (SELECT pid, pos, lower(regexp_replace(regexp_replace(word, '^[^\p{L}]+', ''), '[^\p{L}]+$', '')) AS term FROM tk),
n AS (SELECT *, coalesce(lag(term, 1) OVER w IN ('in', 'de', 'no', 'der'), false) OR coalesce(lag(term, 2) OVER w IN ('in', 'de', 'no', 'der'), false) AS neg FROM t WINDOW w AS (PARTITION BY pid ORDER BY pos)),
h AS (SELECT pid, term, CASE WHEN term IN ('the', 'la', 'die') THEN 1 WHEN term IN ('of', 'le', 'und') THEN -1 ELSE 0 END * CASE WHEN neg THEN -1 ELSE 1 END AS p FROM n),
s AS (SELECT pid, CAST(count(*) FILTER (p > 0) AS BIGINT) AS positive, CAST(count(*) FILTER (p < 0) AS BIGINT) AS negative, array_to_string(list_sort(coalesce(list(DISTINCT term) FILTER (p <> 0), [])), ',') AS matched FROM h GROUP BY 1)
SELECT *, CASE WHEN positive > 0 AND positive = negative THEN 'mixed' WHEN positive > negative THEN 'positive' WHEN negative > positive THEN 'negative' ELSE 'neutral' END AS sentiment FROM s""")
def rule_affect(spark, d):
    """Frequent words stand in for a lexicon, others for its negators."""
    lexicon = spark.createDataFrame(LEXICON, "term string, polarity string")
    words = S.tokens(table(spark, d, "documents").select(F.col("doc_id").alias("pid"), "text"), before=2)
    return N.affect_by_lexicon(words, lexicon, ("in", "de", "no", "der")).withColumn("matched", F.array_join("matched", ","))


@query("""SELECT n_nationkey AS mention_id, CASE WHEN n_regionkey = 4 THEN 'unresolved' END AS audit, CASE WHEN n_regionkey <> 4 THEN n_nationkey * 7.0 - 80 END AS lon, CASE WHEN n_regionkey <> 4 THEN n_nationkey * 3.0 - 30 END AS lat FROM nation""")
def place_features(spark, d):
    n = table(spark, d, "nation")
    places = n.select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("country"), (F.col("n_nationkey") * 3.0 - 30).alias("lat"), (F.col("n_nationkey") * 7.0 - 80).alias("lon"), (F.col("n_regionkey") == 4).alias("historical"))
    made = N.features(N.resolve_places(n.select(F.col("n_nationkey").alias("mention_id"), F.lower("n_name").alias("name")), places))
    at = F.from_json("feature", "geometry struct<coordinates: array<double>>")["geometry"]["coordinates"]
    return made.select("mention_id", "audit", F.get(at, F.lit(0)).alias("lon"), F.get(at, F.lit(1)).alias("lat"))


@query("WITH RECURSIVE " + SQL_SENTENCES + """, o AS (SELECT doc_id AS pid, sentence AS t, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM sentences),
f AS (SELECT pid, n, 0 AS seg, t FROM o WHERE n = 1 UNION ALL SELECT o.pid, o.n, CASE WHEN length(f.t) + 1 + length(o.t) <= 400 THEN seg ELSE seg + 1 END, CASE WHEN length(f.t) + 1 + length(o.t) <= 400 THEN f.t || ' ' || o.t ELSE o.t END FROM f JOIN o ON o.pid = f.pid AND o.n = f.n + 1)
SELECT pid, seg, arg_max(t, n) AS text FROM f GROUP BY 1, 2""")
def text_segments(spark, d):
    return N.segments(_sentences(spark, d), 400)


PRF = "round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1"


@query(VOTERS + f""", u AS (SELECT 'capital' AS voter, pid, start, "end" FROM a UNION ALL SELECT 'comma', pid, start, "end" FROM c), v AS (SELECT DISTINCT voter FROM u),
m AS (SELECT voter, pid, start, "end" FROM v, b), j AS (SELECT voter, u.pid IS NOT NULL AS p, m.pid IS NOT NULL AS g FROM (SELECT *, 1 AS k FROM u) u FULL JOIN m USING (voter, pid, start, "end")),
s AS (SELECT voter, CAST(count(*) FILTER (p AND g) AS BIGINT) AS tp, CAST(count(*) FILTER (p AND NOT g) AS BIGINT) AS fp, CAST(count(*) FILTER (g AND NOT p) AS BIGINT) AS fn FROM j GROUP BY 1)
SELECT *, {PRF} FROM s""")
def prf_by_voter(spark, d):
    v = voters(spark, d)
    counts = [S.match(v[name], v["long"], "exact").withColumn("voter", F.lit(name)) for name in ("capital", "comma")]
    return S.scores(counts[0].unionByName(counts[1]), "voter")


@query(f"""WITH s AS (SELECT coalesce(source, 'unknown') AS source, CAST(count(*) FILTER (quality = 1 AND toxic = 0) AS BIGINT) AS tp, CAST(count(*) FILTER (quality = 0 AND toxic = 0) AS BIGINT) AS fp, CAST(count(*) FILTER (quality = 1 AND toxic = 1) AS BIGINT) AS fn
FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT *, {PRF} FROM s WHERE tp + fn >= 15""")
def prf_by_facet(spark, d):
    """What is not toxic taken for good, held against what is, by source."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    q, t = F.col("quality"), F.col("toxic")
    return E.by_facet(rows.select("source", ((q == 1) & (t == 0)).cast("int").alias("tp"), ((q == 0) & (t == 0)).cast("int").alias("fp"), ((q == 1) & (t == 1)).cast("int").alias("fn")), "source")


@query("""WITH r AS (SELECT lang, coalesce(quality = 1, false) AS rq, coalesce(toxic = 1, false) AS rt, coalesce(n_chars >= 500, false) AS pq, coalesce(contains(text, '!'), false) AS pt FROM documents JOIN labels USING (doc_id)),
s AS (SELECT lang, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(rq = pq AND rt = pt AS DOUBLE)), 6) AS exact_set, CAST(sum(CAST(rq AND pq AS INTEGER) + CAST(rt AND pt AS INTEGER)) AS BIGINT) AS tp,
CAST(sum(CAST(pq AND NOT rq AS INTEGER) + CAST(pt AND NOT rt AS INTEGER)) AS BIGINT) AS fp, CAST(sum(CAST(rq AND NOT pq AS INTEGER) + CAST(rt AND NOT pt AS INTEGER)) AS BIGINT) AS fn FROM r GROUP BY 1)
SELECT *, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS micro_f1 FROM s""")
def exact_set(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "text", "n_chars").join(table(spark, d, "labels"), "doc_id")

    def of(good, bad):
        return F.array_compact(F.array(F.when(good, "quality"), F.when(bad, "toxic")))

    sets = rows.select("lang", of(F.col("quality") == 1, F.col("toxic") == 1).alias("r"), of(F.col("n_chars") >= 500, F.contains("text", F.lit("!"))).alias("p"))
    return E.multilabel(sets, "r", "p", "lang")


@query("""SELECT user_id, CAST(count(*) AS BIGINT) AS calls, CAST(sum(event_id % 100) AS BIGINT) AS tokens_in, CASE WHEN count(*) = count(nullif(event_id % 50, 0)) THEN CAST(sum(nullif(event_id % 50, 0)) AS DOUBLE) / 4 END AS cost FROM events GROUP BY 1""")
def strict_usage(spark, d):
    price = F.nullif(F.col("event_id") % 50, F.lit(0)) / 4
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("calls"), R.strict_sum(F.col("event_id") % 100).alias("tokens_in"), R.strict_sum(price).alias("cost"))


@query()
def voter_reliability(spark, d):
    labels = ["click", "view", "purchase"]
    v = votes(spark, d).withColumn("voter", F.concat(F.lit("u"), F.col("voter")))
    return V.reliability(v, V.dawid_skene(v, labels, [f"u{k}" for k in range(7)]), labels)
