"""Every registered query by name, with its SQL counterpart where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import geo, text as T
from marginalia.operators import cuts, records as R, spans as S, votes as V
from marginalia.streaming import jobs
from marginalia.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "prf_by_language"


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as passages."""
    rows = table(spark, d, "conversations")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pid"), "conv_id", "turn", "role", "text")


SQL_TURNS = "p AS (SELECT conv_id * 1000 + turn AS pid, conv_id, turn, role, text FROM conversations)"
SQL_TOKENS = (
    r"""tok AS (
  SELECT pid, i, run, CAST(coalesce(sum(length(run)) OVER (PARTITION BY pid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start
  FROM (SELECT pid, unnest(r) AS run, generate_subscripts(r, 1) - 1 AS i FROM (SELECT pid, regexp_extract_all(text, '[SPACE]+|[^SPACE]+') AS r FROM {source}))
), tk AS (SELECT pid, CAST(floor(i / 2) AS BIGINT) AS pos, start, CAST(start + length(run) AS INTEGER) AS "end", run AS word FROM tok WHERE NOT regexp_matches(run, '^[SPACE]'))"""
).replace("SPACE", T.SPACE.replace("{", "{{").replace("}", "}}"))
TOKENS = "WITH " + SQL_TURNS + ", " + SQL_TOKENS.format(source="p")
DOC_TOKENS = "WITH p AS (SELECT doc_id AS pid, lang, text FROM documents), " + SQL_TOKENS.format(source="p")
CAPITAL = r"^\p{Lu}\p{Ll}"


def voters(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Three simple annotators over turns: capitalised words with the word behind, long words, words before a comma without it.

    Their spans overlap in part, and their labels (by the word's length) are the same two.
    """
    words = S.tokens(turns(spark, d))
    following = F.coalesce(F.lead("end").over(Window.partitionBy("pid").orderBy("pos")), F.col("end"))
    label = F.when(F.length("word") % 2 == 0, "PLACE").otherwise("THING")
    words = words.select("pid", "start", "end", "word", following.alias("next"), label.alias("label"))
    comma = F.col("word").endswith(",") & (F.length("word") > 1)
    rules = {"capital": (F.col("word").rlike(CAPITAL), F.col("next")), "long": (F.length("word") >= 9, F.col("end")), "comma": (comma, F.col("end") - 1)}
    return {name: words.filter(rule).select("pid", "start", end.alias("end"), F.lit(name).alias("voter"), "label") for name, (rule, end) in rules.items()}


VOTERS = TOKENS + r""", w AS (SELECT *, coalesce(lead("end") OVER (PARTITION BY pid ORDER BY pos), "end") AS nxt, CASE WHEN length(word) % 2 = 0 THEN 'PLACE' ELSE 'THING' END AS label FROM tk),
 a AS (SELECT pid, start, nxt AS "end", label FROM w WHERE regexp_matches(word, '^\p{Lu}\p{Ll}')),
 b AS (SELECT pid, start, "end", label FROM w WHERE length(word) >= 9), c AS (SELECT pid, start, CAST("end" - 1 AS INTEGER) AS "end", label FROM w WHERE word LIKE '%,' AND length(word) > 1)"""
EVERY_VOTER = VOTERS + ", u AS (SELECT *, 'capital' AS voter FROM a UNION ALL SELECT *, 'long' FROM b UNION ALL SELECT *, 'comma' FROM c)"


@query(TOKENS + ' SELECT pid, pos, start, "end", word FROM tk')
def tokens_offsets(spark, d):
    return S.tokens(turns(spark, d)).withColumn("pos", F.col("pos").cast("long"))


@query("""SELECT doc_id, lang, text FROM (SELECT *, row_number() OVER (PARTITION BY md5(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '', 'g')) ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def dedupe_normalized(spark, d):
    return R.dedupe_texts(table(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id")


@query(r"""SELECT doc_id, length(trim(text, ' ')) BETWEEN 45 AND 420 AND length(regexp_replace(text, '[^\p{L}]+', '', 'g')) / CAST(nullif(length(text), 0) AS DOUBLE) >= 0.6 AS ok FROM documents""")
def passage_quality_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", T.passage_ok(F.col("text")).alias("ok"))


SQL_SENTENCES = r"""cut AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])(["'')\]]?[\t-\r ]+)([A-Z"''(\[])', '\1\x{E000}\2\x{E001}\3', 'g'), '\x{E001}') AS parts FROM documents),
each AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS ord FROM cut),
placed AS (SELECT doc_id, ord, string_split(part, '\x{E000}') AS x, sum(length(replace(part, '\x{E000}', ''))) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM each),
sentence AS (SELECT doc_id, CAST(ord AS INTEGER) AS ord, CAST(coalesce(before, 0) AS INTEGER) AS start, x[1] || coalesce(substr(x[2], 1, 1), '') AS sentence FROM placed),
sentences AS (SELECT doc_id, ord, start, CAST(start + length(sentence) AS INTEGER) AS "end", sentence FROM sentence WHERE length(sentence) > 0)""".replace(r"\x{E000}", "\ue000").replace(r"\x{E001}", "\ue001")


@query("WITH " + SQL_SENTENCES + " SELECT * FROM sentences")
def sentence_split(spark, d):
    return T.sentences(table(spark, d, "documents"), ["doc_id"])


@query(r"""SELECT page_id, regexp_replace(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'), ' '), ' ([,.;:!?)\]])', '\1', 'g') AS clean FROM pages""")
def html_clean(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_markup(F.col("html")).alias("clean"))


@query("SELECT doc_id, 'd-' || substr(sha1(source || ':' || CAST(doc_id AS VARCHAR) || ':' || text), 1, 10) AS passage_id FROM documents")
def passage_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", T.passage_id(F.col("source"), F.col("doc_id"), F.col("text"), "d-").alias("passage_id"))


@query(r"""SELECT doc_id, coalesce(y, -1) AS year, CASE WHEN y IS NULL THEN 'unknown' WHEN y BETWEEN 1600 AND 1799 THEN 'early' WHEN y BETWEEN 1800 AND 1899 THEN 'middle' WHEN y BETWEEN 1900 AND 1999 THEN 'late' ELSE 'outside_range' END AS period
FROM (SELECT doc_id, list_min(list_transform(regexp_extract_all(text, '\b(1[6-9][0-9][0-9])\b', 1), lambda x: CAST(x AS INTEGER))) AS y FROM documents)""")
def year_period(spark, d):
    year = T.year_in(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(year, F.lit(-1)).alias("year"), T.period_of(year, [("early", 1600, 1799), ("middle", 1800, 1899), ("late", 1900, 1999)]).alias("period"))


@query("SELECT doc_id FROM documents ORDER BY md5('2026:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 40")
def hash_sample_queue(spark, d):
    return R.hash_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 40)


#: One unit at a time, as the rule says.
ALLOCATE = """l AS (SELECT list(stratum ORDER BY stratum) AS st, list(size ORDER BY stratum) AS sz, CAST(sum(size) AS BIGINT) AS tot, least({want}, CAST(sum(size) AS BIGINT)) AS want FROM s),
al AS (SELECT 0 AS step, st, sz, want, list_transform(sz, lambda z: CAST(greatest(1, round_even(want * z / tot, 0)) AS BIGINT)) AS q FROM l
  UNION ALL SELECT step + 1, st, sz, want, CASE WHEN list_sum(q) > want THEN list_transform(q, lambda x, i: x - CASE WHEN i = list_position(q, list_max(q)) THEN 1 ELSE 0 END)
    ELSE list_transform(q, lambda x, i: x + CASE WHEN i = list_position(list_transform(list_zip(sz, q), lambda z: z[1] - z[2]), list_max(list_transform(list_zip(sz, q), lambda z: z[1] - z[2]))) THEN 1 ELSE 0 END) END
  FROM al WHERE list_sum(q) <> want),
quotas AS (SELECT unnest(st) AS stratum, unnest(q) AS quota FROM al WHERE list_sum(q) = want)"""


@query("WITH RECURSIVE d AS (SELECT doc_id, concat_ws('/', lang, source) AS stratum FROM documents), s AS (SELECT stratum, count(*) AS size FROM d GROUP BY 1), " + ALLOCATE.format(want=200) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('2026:' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM d) SELECT doc_id, stratum FROM r JOIN quotas USING (stratum) WHERE k <= quota""")
def stratified_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("stratum"))
    return R.stratified_sample(docs, "stratum", "doc_id", 200)


@query("WITH RECURSIVE s AS (SELECT concat_ws('/', lang, source) AS stratum, count(*) AS size FROM documents GROUP BY 1), " + ALLOCATE.format(want=37) + " SELECT stratum, quota FROM quotas")
def stratum_quotas(spark, d):
    """More strata than rows are wanted: quotas fall to none."""
    strata = table(spark, d, "documents").groupBy(F.concat_ws("/", "lang", "source").alias("stratum")).agg(F.count("*").alias("size"))
    return R.allocate(strata, 37).select("stratum", "quota")


@query(DOC_TOKENS + " SELECT lower(word) AS term, CAST(count(DISTINCT pid) AS BIGINT) AS df FROM tk GROUP BY 1 HAVING count(DISTINCT pid) >= 3")
def gazetteer_build(spark, d):
    return S.gazetteer_of_texts(table(spark, d, "documents").select(F.col("doc_id").alias("pid"), "text"))


def gazetteer(spark: SparkSession, d: str) -> DataFrame:
    """Surfaces of two layers: the first two words of benchmark items as they are written, rare words of documents in any case."""
    items = table(spark, d, "benchmark").select(F.regexp_extract("text", rf"[{T.LETTER}]+ [{T.LETTER}]+", 0).alias("surface")).filter(F.length("surface") > 0).distinct()
    rare = S.gazetteer_of_texts(table(spark, d, "documents").select(F.col("doc_id").alias("pid"), "text"), least=20, most=60).filter(F.col("term").rlike(rf"^[{T.LETTER}]+$")).select(F.col("term").alias("surface"), F.lit("TERM").alias("label"), F.lit(True).alias("any_case"))
    return items.select("surface", F.lit("PHRASE").alias("label"), F.lit(False).alias("any_case")).unionByName(rare)


#: Every place of a phrase by literal search; from left to right, each behind the one before; then the terms that overlap none.
@query("WITH RECURSIVE " + DOC_TOKENS[5:] + r""", ph AS (SELECT DISTINCT regexp_extract(text, '[\p{L}\p{N}_]+ [\p{L}\p{N}_]+') AS surface FROM benchmark),
tm AS (SELECT lower(word) AS term FROM tk GROUP BY 1 HAVING count(DISTINCT pid) BETWEEN 20 AND 60 AND regexp_matches(lower(word), '^[\p{L}\p{N}_]+$')),
cut AS (SELECT pid, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS r FROM p), un AS (SELECT pid, unnest(r) AS run, generate_subscripts(r, 1) AS i FROM cut),
wd AS (SELECT pid, i, run, CAST(coalesce(sum(length(run)) OVER w - length(run), 0) AS INTEGER) AS start, lead(run, 1) OVER w2 AS gap, lead(run, 2) OVER w2 AS nxt FROM un
  WINDOW w AS (PARTITION BY pid ORDER BY i ROWS UNBOUNDED PRECEDING), w2 AS (PARTITION BY pid ORDER BY i)),
h1 AS (SELECT pid, start, CAST(start + length(run || gap || nxt) AS INTEGER) AS "end", run || gap || nxt AS surface FROM wd JOIN ph ON run || gap || nxt = ph.surface),
pick AS (SELECT pid, min(start) AS start, arg_min("end", start) AS "end", arg_min(surface, start) AS surface FROM h1 GROUP BY 1
  UNION ALL SELECT h1.pid, min(h1.start), arg_min(h1."end", h1.start), arg_min(h1.surface, h1.start) FROM pick JOIN h1 ON h1.pid = pick.pid AND h1.start >= pick."end" GROUP BY h1.pid),
h2 AS (SELECT pid, start, CAST(start + length(run) AS INTEGER) AS "end", run AS surface FROM wd JOIN tm ON lower(run) = term)
SELECT *, 'PHRASE' AS label FROM pick UNION ALL SELECT *, 'TERM' FROM h2 x WHERE NOT EXISTS (SELECT 1 FROM pick y WHERE y.pid = x.pid AND y.start < x."end" AND x.start < y."end")""")
def gazetteer_match(spark, d):
    return S.gazetteer_spans(table(spark, d, "documents").select(F.col("doc_id").alias("pid"), "text"), gazetteer(spark, d))


@query("""WITH q AS (SELECT doc_id AS pid, text, unnest([text, string_split(text, ' ')[1], string_split(text, ' ')[1], string_split(text, ' ')[1], 'zq ' || text, '', string_split(text, ' ')[-1]]) AS quote, unnest(range(7)) AS ord FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY pid, quote ORDER BY ord) AS k, CASE WHEN length(quote) > 0 THEN string_split(text, quote) END AS x FROM q),
r AS (SELECT pid, CAST(ord AS INTEGER) AS ord, quote, k, CASE WHEN coalesce(length(quote), 0) = 0 THEN 'empty_quote' WHEN k < len(x) THEN 'grounded' WHEN len(x) = 1 THEN 'not_in_passage' ELSE 'repeated_and_exhausted' END AS status, x FROM k)
SELECT pid, ord, status, CASE WHEN status = 'grounded' THEN CAST(list_sum(list_transform(x[1:k], lambda z: length(z))) + (k - 1) * length(quote) AS INTEGER) ELSE -1 END AS start FROM r""")
def ground_quotes(spark, d):
    """Of each document the whole text, its first word three times, what it does not hold, nothing, and its last word."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pid"), "text")
    words = F.split("text", " ")
    asked = F.array("text", *[F.get(words, F.lit(0))] * 3, F.concat(F.lit("zq "), "text"), F.lit(""), F.element_at(words, -1))
    quotes = docs.select("pid", F.lit("v").alias("voter"), F.posexplode(asked).alias("ord", "quote"))
    return S.ground(quotes, docs).select("pid", "ord", "status", F.coalesce("start", F.lit(-1)).alias("start"))


@query(VOTERS + """, e AS (SELECT a.pid, count(*) AS tp FROM a JOIN b USING (pid, start, "end") GROUP BY 1), na AS (SELECT pid, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT pid, count(*) AS n FROM b GROUP BY 1)
SELECT pid, coalesce(tp, 0) AS tp, coalesce(na.n, 0) - coalesce(tp, 0) AS fp, coalesce(nb.n, 0) - coalesce(tp, 0) AS fn FROM na FULL JOIN nb USING (pid) LEFT JOIN e USING (pid)""")
def match_exact(spark, d):
    v = voters(spark, d)
    return S.match(v["capital"], v["long"], "exact")


#: One prediction at a time, each taking the free gold span that it shares most with.
@query("WITH RECURSIVE " + VOTERS[5:] + """, pn AS (SELECT pid, start AS s, "end" AS e, row_number() OVER (PARTITION BY pid ORDER BY start, "end") AS n FROM a), gl AS (SELECT pid, list({'s': start, 'e': "end"} ORDER BY start, "end") AS gs FROM b GROUP BY 1),
r AS (SELECT pid, CAST(0 AS BIGINT) AS n, gs, CAST([] AS BIGINT[]) AS used FROM gl
  UNION ALL SELECT pn.pid, pn.n, gs, list_concat(used, list_transform(list_filter([list_max(list_transform(list_filter(range(1, len(gs) + 1), lambda i: NOT list_contains(used, i) AND least(gs[i].e, pn.e) > greatest(gs[i].s, pn.s)),
    lambda i: {'o': least(gs[i].e, pn.e) - greatest(gs[i].s, pn.s), 'k': -i}))], lambda m: m IS NOT NULL), lambda m: -m.k)) FROM r JOIN pn ON pn.pid = r.pid AND pn.n = r.n + 1),
t AS (SELECT pid, CAST(max(len(used)) AS BIGINT) AS tp FROM r GROUP BY 1), na AS (SELECT pid, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT pid, count(*) AS n FROM b GROUP BY 1)
SELECT pid, coalesce(tp, 0) AS tp, coalesce(na.n, 0) - coalesce(tp, 0) AS fp, coalesce(nb.n, 0) - coalesce(tp, 0) AS fn FROM na FULL JOIN nb USING (pid) LEFT JOIN t USING (pid)""")
def match_overlap(spark, d):
    v = voters(spark, d)
    return S.match(v["capital"], v["long"], "overlap")


@query(DOC_TOKENS + r""", a AS (SELECT pid, start FROM tk WHERE regexp_matches(word, '^\p{Lu}\p{Ll}')), b AS (SELECT pid, start FROM tk WHERE length(word) >= 9),
c AS (SELECT pid, a.start IS NOT NULL AND b.start IS NOT NULL AS hit, a.start IS NOT NULL AS ia, b.start IS NOT NULL AS ib FROM a FULL JOIN b USING (pid, start)),
s AS (SELECT lang, CAST(count(*) FILTER (hit) AS BIGINT) AS tp, CAST(count(*) FILTER (ia AND NOT ib) AS BIGINT) AS fp, CAST(count(*) FILTER (ib AND NOT ia) AS BIGINT) AS fn FROM c JOIN p USING (pid) GROUP BY lang)
SELECT lang, tp, fp, fn, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM s""")
def prf_by_language(spark, d):
    """Two annotators over documents, one scored against the other, by language."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pid"), "lang", "text")
    marks = {"p": F.col("word").rlike(CAPITAL).cast("int"), "g": (F.length("word") >= 9).cast("int")}
    words = S.tokens(docs).select("pid", "start", "end", *[m.alias(c) for c, m in marks.items()]).filter("p + g > 0")
    counts = S.match_marked(words.repartition("pid"), ["pid", "start", "end"], ["pid"])
    return S.scores(counts.join(docs.select("pid", "lang"), "pid"), "lang")


@query("""WITH c AS (SELECT source, lang, CAST(count(*) FILTER (quality = 1 AND toxic = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (quality = 1 AND toxic = 0) AS BIGINT) AS fp, CAST(count(*) FILTER (quality = 0 AND toxic = 1) AS BIGINT) AS fn
FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((source), (lang), ()))
SELECT source, lang, tp, fp, fn, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 4) AS recall FROM c""")
def prf_grouping_sets(spark, d):
    from marginalia.functions import spans as E

    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    q, t = F.col("quality"), F.col("toxic")
    sets = rows.groupingSets([["source"], ["lang"], []], "source", "lang").agg(F.count_if((q == 1) & (t == 1)).alias("tp"), F.count_if((q == 1) & (t == 0)).alias("fp"), F.count_if((q == 0) & (t == 1)).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sets.select("source", "lang", "tp", "fp", "fn", F.round(E.precision(tp, fp), 4).alias("precision"), F.round(E.recall(tp, fn), 4).alias("recall"))


@query(VOTERS + """ SELECT pid, a.start AS s1, a."end" AS e1, c.start AS s2, c."end" AS e2, CAST(least(a."end", c."end") - greatest(a.start, c.start) AS INTEGER) AS shared,
round(CAST(least(a."end", c."end") - greatest(a.start, c.start) AS DOUBLE) / ((a."end" - a.start) + (c."end" - c.start) - (least(a."end", c."end") - greatest(a.start, c.start))), 6) AS iou FROM a JOIN c USING (pid) WHERE a.start < c."end" AND c.start < a."end" """)
def overlap_pairs(spark, d):
    v = voters(spark, d)
    return S.overlap_pairs(v["capital"], v["comma"])


#: One span at a time, each joining the first item with a member that marks the same thing.
POOL = "WITH RECURSIVE " + EVERY_VOTER[5:] + """, o AS (SELECT pid, {'s': start, 'e': "end", 'v': voter, 'l': label} AS x, row_number() OVER (PARTITION BY pid ORDER BY start, "end", voter, label) AS n FROM u),
g AS (SELECT pid, n, [{'x': x, 'g': n}] AS ms FROM o WHERE n = 1
  UNION ALL SELECT o.pid, o.n, list_append(ms, {'x': o.x, 'g': coalesce(list_min(list_transform(list_filter(ms, lambda m: least(m.x.e, o.x.e) > greatest(m.x.s, o.x.s)
    AND (least(m.x.e, o.x.e) - greatest(m.x.s, o.x.s) >= 0.5 * (greatest(m.x.e, o.x.e) - least(m.x.s, o.x.s)) OR least(m.x.e, o.x.e) - greatest(m.x.s, o.x.s) >= 0.8 * least(m.x.e - m.x.s, o.x.e - o.x.s))), lambda m: m.g)), o.n)}) FROM g JOIN o ON o.pid = g.pid AND o.n = g.n + 1),
z AS (SELECT pid, unnest(arg_max(ms, n)) AS m FROM g GROUP BY 1), item AS (SELECT pid, m.g AS g, m.x AS x FROM z),
first AS (SELECT pid, g, x.v AS v, arg_min(x.l, {'s': x.s, 'e': x.e, 'l': x.l}) AS l FROM item GROUP BY ALL)"""


@query(POOL + " SELECT pid, min(x.s) AS start, max(x.e) AS \"end\", CAST(count(DISTINCT x.v) AS INTEGER) AS n_votes, CAST(count(*) AS INTEGER) AS n_members FROM item GROUP BY pid, g")
def pool_spans(spark, d):
    a, b, c = voters(spark, d).values()
    return S.pool(a.unionByName(b).unionByName(c)).select("pid", "start", "end", F.size("votes").alias("n_votes"), F.size("members").alias("n_members"))


@query(POOL + """, lab AS (SELECT pid, g, l, count(*) AS n, min(CASE v WHEN 'capital' THEN 0 WHEN 'long' THEN 1 ELSE 2 END) AS k FROM first GROUP BY ALL),
best AS (SELECT pid, g, arg_max(l, {'n': n, 'k': -k}) AS modal_label, CAST(max(n) AS INTEGER) AS agreement, CAST(sum(n) AS INTEGER) AS n_proposing FROM lab GROUP BY ALL),
ext AS (SELECT pid, g, min(x.s) AS start, count(DISTINCT [x.s, x.e]) > 1 AS extent_disagreement FROM item GROUP BY ALL)
SELECT pid, start, n_proposing, modal_label, agreement, agreement = 3 AS unanimous, extent_disagreement, CASE WHEN agreement = 3 AND NOT extent_disagreement THEN 'A_unanimous' ELSE 'B_contested' END AS stratum FROM best JOIN ext USING (pid, g)""")
def pooled_profile(spark, d):
    a, b, c = voters(spark, d).values()
    items = S.pool(a.unionByName(b).unionByName(c))
    found = S.pooled_votes(items, ["capital", "long", "comma"])
    return found.join(items.select("pid", "item", "start"), ["pid", "item"]).drop("item")


@query(EVERY_VOTER + """ SELECT pid, start, "end", label, count(DISTINCT voter) AS vote_count, count(DISTINCT voter) / 3.0 AS vote_ratio, count(DISTINCT voter) / 3.0 < 0.5 AS requires_review FROM u GROUP BY pid, start, "end", label""")
def entity_vote(spark, d):
    a, b, c = voters(spark, d).values()
    return V.entity_vote(a.unionByName(b).unionByName(c), 3)


@query(VOTERS + """, j AS (SELECT pid, start, "end", label, 1 AS n FROM a UNION ALL SELECT pid, start, "end", label, -1 FROM b) SELECT CASE WHEN sum(n) > 0 THEN 'spurious' ELSE 'missed' END AS side, pid, start, "end", label FROM j GROUP BY pid, start, "end", label HAVING sum(n) <> 0""")
def unmatched_spans(spark, d):
    v = voters(spark, d)
    return S.unmatched(v["capital"], v["long"])


@query(VOTERS + """, e AS (SELECT a.pid, count(*) AS tp FROM a JOIN b USING (pid, start, "end", label) GROUP BY 1), na AS (SELECT pid, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT pid, count(*) AS n FROM b GROUP BY 1)
SELECT pid, coalesce(tp, 0) AS tp, coalesce(na.n, 0) - coalesce(tp, 0) AS fp, coalesce(nb.n, 0) - coalesce(tp, 0) AS fn FROM na FULL JOIN nb USING (pid) LEFT JOIN e USING (pid)""")
def match_labels(spark, d):
    v = voters(spark, d)
    return S.match(v["capital"], v["long"], "exact", label=True)


#: Each prediction, in order, takes the first free gold span that it meets.
@query("WITH RECURSIVE " + VOTERS[5:] + """, pn AS (SELECT pid, start AS s, "end" AS e, label AS l, row_number() OVER (PARTITION BY pid ORDER BY start, "end", label) AS n FROM a), gl AS (SELECT pid, list({'s': start, 'e': "end", 'l': label} ORDER BY start, "end", label) AS gs FROM b GROUP BY 1),
r AS (SELECT pid, CAST(0 AS BIGINT) AS n, gs, CAST([] AS BIGINT[]) AS used FROM gl
  UNION ALL SELECT pn.pid, pn.n, gs, list_concat(used, list_filter(range(1, len(gs) + 1), lambda i: NOT list_contains(used, i) AND gs[i].l = pn.l AND least(gs[i].e, pn.e) > greatest(gs[i].s, pn.s))[1:1]) FROM r JOIN pn ON pn.pid = r.pid AND pn.n = r.n + 1),
t AS (SELECT pid, CAST(max(len(used)) AS BIGINT) AS tp FROM r GROUP BY 1), na AS (SELECT pid, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT pid, count(*) AS n FROM b GROUP BY 1)
SELECT pid, coalesce(tp, 0) AS tp, coalesce(na.n, 0) - coalesce(tp, 0) AS fp, coalesce(nb.n, 0) - coalesce(tp, 0) AS fn FROM na FULL JOIN nb USING (pid) LEFT JOIN t USING (pid)""")
def match_first_overlap(spark, d):
    v = voters(spark, d)
    return S.match(v["capital"], v["long"], "any", label=True)


def votes(spark: SparkSession, d: str) -> DataFrame:
    """Events as votes: 20 events are an item, the user's number mod 7 the voter, the first type the label."""
    rows = table(spark, d, "events").withColumn("item", F.floor(F.col("event_id") / 20)).withColumn("voter", F.col("user_id") % 7)
    return rows.groupBy("item", "voter").agg(F.min_by("event_type", "event_id").alias("label"))


SQL_VOTES = "WITH v AS (SELECT CAST(floor(event_id / 20.0) AS BIGINT) AS item, user_id % 7 AS voter, arg_min(event_type, event_id) AS label FROM events GROUP BY 1, 2)"


@query(SQL_VOTES + """, c AS (SELECT item, label, count(*) AS n FROM v GROUP BY 1, 2), m AS (SELECT item, sum(n) AS n_votes, count(*) AS n_labels, max(n) AS agreement FROM c GROUP BY 1)
SELECT item, CAST(n_votes AS BIGINT) AS n_votes, n_labels, min(label) AS modal_label, agreement, n_labels = 1 AS unanimous FROM c JOIN m USING (item) WHERE n = agreement GROUP BY item, n_votes, n_labels, agreement""")
def agreement_profile(spark, d):
    return V.profile(votes(spark, d))


@query(SQL_VOTES + ", c AS (SELECT item, label, count(*) AS n FROM v GROUP BY 1, 2), m AS (SELECT item, max(n) AS agreement FROM c GROUP BY 1) SELECT agreement, CAST(count(*) AS BIGINT) AS items FROM m GROUP BY 1")
def agreement_hist(spark, d):
    return V.profile(votes(spark, d)).groupBy("agreement").agg(F.count("*").alias("items"))


@query(SQL_VOTES + " SELECT a.voter AS voter_a, b.voter AS voter_b, CAST(count(*) AS BIGINT) AS shared, avg(CAST(a.label = b.label AS DOUBLE)) AS agreement FROM v a JOIN v b ON a.item = b.item AND a.voter < b.voter GROUP BY 1, 2")
def pairwise_agreement(spark, d):
    return V.pairwise(votes(spark, d))


@query(SQL_VOTES + ", i AS (SELECT item, count(DISTINCT voter) AS n, count(DISTINCT label) AS k FROM v GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS items, avg(CAST(k = 1 AS DOUBLE)) AS rate FROM i WHERE n = (SELECT count(DISTINCT voter) FROM v)")
def unanimity(spark, d):
    return V.unanimity(votes(spark, d))


@query(SQL_VOTES + """, c AS (SELECT item, label, count(*) AS n FROM v GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY item) AS m FROM c), k AS (SELECT * FROM w WHERE m > 1),
a AS (SELECT sum(n * (n - 1) / CAST(m - 1 AS DOUBLE)) AS agree, sum(n) AS total FROM k), b AS (SELECT sum(c * (c - 1)) AS chance FROM (SELECT label, sum(n) AS c FROM k GROUP BY 1))
SELECT CAST(total AS BIGINT) AS n_labels, round(1 - (1 - agree / total) / (1 - chance / CAST(total * (total - 1) AS DOUBLE)), 6) AS alpha FROM a, b""")
def krippendorff(spark, d):
    return V.krippendorff(votes(spark, d))


@query(SQL_VOTES + """, c AS (SELECT item, label, count(*) AS n FROM v GROUP BY 1, 2), m AS (SELECT item, max(n) AS agreement, arg_max(label, n) AS x FROM c GROUP BY 1), j AS (SELECT agreement, item % 3 = 0 AS good FROM m), k AS (SELECT unnest(range(1, 8)) AS k)
SELECT CAST(k AS INTEGER) AS k, CAST(count(*) FILTER (agreement >= k) AS BIGINT) AS n_auto, round(CAST(count(*) FILTER (agreement >= k AND good) AS DOUBLE) / nullif(count(*) FILTER (agreement >= k), 0), 6) AS precision,
round(CAST(count(*) FILTER (agreement >= k) AS DOUBLE) / count(*), 6) AS coverage, CAST(count(*) - count(*) FILTER (agreement >= k) AS BIGINT) AS burden FROM j, k GROUP BY k""")
def calibration_curve(spark, d):
    return V.calibration(V.profile(votes(spark, d)).select("agreement", (F.col("item") % 3 == 0).alias("correct")), 7)


@query()
def dawid_skene(spark, d):
    v = votes(spark, d).withColumn("voter", F.concat(F.lit("u"), F.col("voter")))
    return V.dawid_skene(v, ["click", "view", "purchase"], [f"u{k}" for k in range(7)])


@query()
def bootstrap_ci(spark, d):
    v = voters(spark, d)
    return V.bootstrap_f1(S.match(v["capital"], v["long"], "exact").withColumn("voter", F.lit("capital")), "voter")


@query("""SELECT user_id, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS click, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS view, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS error FROM events GROUP BY 1""")
def emitted_crosstab(spark, d):
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view", "error"]).count().na.fill(0)


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, count(DISTINCT event_type) > 1 AS drift FROM events GROUP BY 1")
def config_drift(spark, d):
    kinds = F.array_sort(F.collect_set("event_type"))
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(kinds, ",").alias("kinds"), (F.size(kinds) > 1).alias("drift"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS latency_mean, round(sum(value), 2) AS latency_total, CASE WHEN count(*) = count(nullif(user_id % 5, 0)) THEN CAST(sum(nullif(user_id % 5, 0)) AS BIGINT) END AS strict FROM events GROUP BY 1")
def telemetry_summary(spark, d):
    used = F.nullif(F.col("user_id") % 5, F.lit(0))
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("latency_mean"), F.round(F.sum("value"), 2).alias("latency_total"), R.strict_sum(used).alias("strict"))


@query("""WITH e AS (SELECT *, CASE event_type WHEN 'click' THEN 'accept' WHEN 'view' THEN 'edit' ELSE 'reject' END AS action FROM events)
SELECT user_id, arg_max(action, event_id) AS status, arg_max(props, event_id) FILTER (action = 'edit') AS value, CAST(count(*) FILTER (action = 'edit') AS BIGINT) AS edits FROM e GROUP BY 1""")
def review_fold(spark, d):
    action = F.when(F.col("event_type") == "click", "accept").when(F.col("event_type") == "view", "edit").otherwise("reject")
    return R.review_fold(table(spark, d, "events").withColumn("action", action), "user_id", "event_id", "action", "props")


@query("""WITH t AS (SELECT *, sum(CAST(role = 'user' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn) AS pair FROM conversations)
SELECT conv_id, CAST(pair AS BIGINT) AS pair, min(turn) FILTER (role = 'user') AS question, coalesce(min(turn) FILTER (role = 'assistant'), -1) AS answer FROM t WHERE pair > 0 GROUP BY 1, 2""")
def qa_pairs(spark, d):
    return R.qa_pairs(table(spark, d, "conversations")).withColumn("answer", F.coalesce("answer", F.lit(-1)))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inherited FROM events""")
def carry_forward(spark, d):
    rows = table(spark, d, "events").withColumn("stated", F.when(F.col("event_type") == "purchase", F.col("value")))
    return R.carry_forward(rows, "user_id", ["ts", "event_id"], "stated").select("event_id", "inherited")


@query(r"""WITH c AS (SELECT conv_id, turn, len(regexp_extract_all(text, '\p{Lu}')) AS n FROM conversations)
SELECT * FROM (SELECT conv_id, coalesce(min(turn) FILTER (n >= 2), min(turn) FILTER (n >= 1)) AS chosen FROM c GROUP BY 1) WHERE chosen IS NOT NULL""")
def first_eligible(spark, d):
    return R.first_eligible(table(spark, d, "conversations"), "conv_id", "turn", F.regexp_count("text", F.lit(r"\p{Lu}")))


@query("""WITH p AS (SELECT o_orderkey, CAST(o_orderstatus AS VARCHAR) AS r1, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS p1, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS r2, o_orderpriority AS p2 FROM orders),
l AS (SELECT 'status' AS field, r1 AS r, p1 AS p FROM p UNION ALL SELECT 'priority', r2, p2 FROM p),
k AS (SELECT field, CAST(count(*) FILTER (r = p) AS BIGINT) AS correct, CAST(count(*) FILTER (r IS NOT NULL AND p IS NULL) AS BIGINT) AS missing_prediction, CAST(count(*) FILTER (r IS NULL AND p IS NOT NULL) AS BIGINT) AS unsupported_prediction, CAST(count(*) FILTER (r <> p) AS BIGINT) AS mismatch, CAST(count(*) FILTER (r IS NULL AND p IS NULL) AS BIGINT) AS both_missing FROM l GROUP BY 1)
SELECT *, round(CAST(correct AS DOUBLE) / nullif(correct + unsupported_prediction + mismatch, 0), 6) AS precision, round(CAST(correct AS DOUBLE) / nullif(correct + missing_prediction + mismatch, 0), 6) AS recall, round(CAST(unsupported_prediction + mismatch AS DOUBLE) / nullif(correct + unsupported_prediction + mismatch, 0), 6) AS unsupported_rate FROM k""")
def field_scoring(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("ref_status"),
        F.when(k % 5 == 0, None).when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("pred_status"),
        F.when(k % 11 == 0, None).otherwise(F.col("o_orderpriority")).alias("ref_priority"),
        F.col("o_orderpriority").alias("pred_priority"),
    )
    return R.field_scores(rows, ["status", "priority"])


#: Candidates from the best to the worst, each taken where both its ends are free.
@query("""WITH RECURSIVE o AS (SELECT o_custkey AS cust, o_orderkey AS k, month(o_orderdate) AS m FROM orders),
c AS (SELECT p.cust, p.k AS p, r.k AS r, 2 - abs(p.m - r.m) / 12.0 AS score FROM o p JOIN o r ON p.cust = r.cust AND p.k % 2 = 0 AND r.k % 2 = 1),
n AS (SELECT cust, {'p': p, 'r': r, 'score': score} AS x, row_number() OVER (PARTITION BY cust ORDER BY score DESC, p, r) AS n FROM c),
f AS (SELECT cust, n, [x] AS ms FROM n WHERE n = 1 UNION ALL SELECT n.cust, n.n, CASE WHEN len(list_filter(ms, lambda m: m.p = n.x.p OR m.r = n.x.r)) > 0 THEN ms ELSE list_append(ms, n.x) END FROM f JOIN n ON n.cust = f.cust AND n.n = f.n + 1),
z AS (SELECT cust, unnest(arg_max(ms, n)) AS m FROM f GROUP BY 1) SELECT cust, m.p AS p, m.r AS r, m.score AS score FROM z""")
def journey_match(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.month("o_orderdate").alias("m"))
    p, r = o.filter(F.col("o_orderkey") % 2 == 0).alias("p"), o.filter(F.col("o_orderkey") % 2 == 1).alias("r")
    met = p.join(r, F.col("p.o_custkey") == F.col("r.o_custkey"))
    score = (2 - F.abs(F.col("p.m") - F.col("r.m")) / 12.0).alias("score")
    return R.match_records(met.select(F.col("p.o_custkey").alias("cust"), F.col("p.o_orderkey").alias("p"), F.col("r.o_orderkey").alias("r"), score), "cust")


@query(TOKENS + r""", t AS (SELECT DISTINCT pid, word AS term FROM tk WHERE regexp_matches(word, '^\p{Lu}\p{Ll}+$'))
SELECT a.term AS source, b.term AS target, CAST(count(*) AS BIGINT) AS weight FROM t a JOIN t b ON a.pid = b.pid AND a.term < b.term GROUP BY 1, 2""")
def cooccurrence(spark, d):
    words = S.tokens(turns(spark, d)).filter(F.col("word").rlike(r"^\p{Lu}\p{Ll}+$"))
    return R.cooccurrence(words.select("pid", F.col("word").alias("term")))


@query(DOC_TOKENS + """, ws AS (SELECT pid, list(word ORDER BY pos) AS w FROM tk GROUP BY 1), sh AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM ws WHERE len(w) >= 5),
bt AS (SELECT item_id, regexp_extract_all(text, '[^SPACE]+') AS w FROM benchmark), bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM bt WHERE len(w) >= 5)
SELECT item_id, CAST(count(*) AS BIGINT) AS shingles, CAST(count(sh.s) AS BIGINT) AS found FROM bs LEFT JOIN sh USING (s) GROUP BY 1 HAVING count(sh.s) >= 0.8 * count(*)""".replace("SPACE", T.SPACE))
def leakage_check(spark, d):
    """Benchmark items of whose five-word runs four in five stand in some document."""
    items = R.shingles(table(spark, d, "benchmark").select("item_id", "text"), "item_id")
    held = cuts.runs_of_words(table(spark, d, "documents").select("doc_id", "text"), "doc_id", 5).select("shingle")
    return R.contained(items, held, "item_id")


@query("SELECT doc_id, 'unlabelled' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unknown' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def id_set_diff(spark, d):
    docs, labels = (table(spark, d, t).select("doc_id") for t in ("documents", "labels"))
    return docs.join(labels, "doc_id", "left_anti").withColumn("side", F.lit("unlabelled")).unionByName(labels.join(docs, "doc_id", "left_anti").withColumn("side", F.lit("unknown")))


@query("""WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r, n_nationkey * 3.0 - 30 AS lat, n_nationkey * 7.0 - 80 AS lon FROM nation)
SELECT a.k AS a, b.k AS b, round(2 * 6371.0088 * atan2(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)),
sqrt(1 - (pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 3) AS km FROM n a JOIN n b ON a.r = b.r AND a.k < b.k""")
def haversine_pairs(spark, d):
    k = F.col("n_nationkey")
    n = table(spark, d, "nation").select(k.alias("k"), F.col("n_regionkey").alias("r"), (k * 3.0 - 30).alias("lat"), (k * 7.0 - 80).alias("lon"))
    met = n.alias("a").join(n.alias("b"), (F.col("a.r") == F.col("b.r")) & (F.col("a.k") < F.col("b.k")))
    return met.select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.round(geo.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")), 3).alias("km"))


@query("SELECT doc_id AS pid, v AS voter FROM documents, (SELECT unnest(['rules', 'model']) AS v) WHERE NOT (v = 'rules' AND doc_id IN (SELECT doc_id FROM labels))")
def resume_antijoin(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pid"))
    done = table(spark, d, "labels").select(F.col("doc_id").alias("pid"), F.lit("rules").alias("voter"))
    return R.pending(docs, spark.createDataFrame([("rules",), ("model",)], "voter string"), done)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return jobs.tumbling(table(spark, d, "events")).withColumn("total", F.round("total", 2))


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, sid""")
def events_session(spark, d):
    return jobs.sessions(table(spark, d, "events"))


@query("""SELECT CAST(count(*) FILTER (quality = 1 AND toxic = 1) AS BIGINT) AS both_labels, round(avg(CAST(quality = toxic AS DOUBLE)), 6) AS exact_share, round(2.0 * count(*) FILTER (quality = 1 AND toxic = 1) / nullif(2 * count(*) FILTER (quality = 1 AND toxic = 1) + count(*) FILTER (quality <> toxic), 0), 6) AS micro_f1 FROM labels""")
def multilabel_f1(spark, d):
    q, t = F.col("quality"), F.col("toxic")
    both, off = F.count_if((q == 1) & (t == 1)), F.count_if(q != t)
    return table(spark, d, "labels").agg(both.alias("both_labels"), F.round(F.avg((q == t).cast("double")), 6).alias("exact_share"), F.round(F.try_divide(2.0 * both, 2 * both + off), 6).alias("micro_f1"))
