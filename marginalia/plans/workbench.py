"""Registered queries of selections, relabelling, generated records and look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import workbench as W
from marginalia.plans.registry import EVERY_VOTER, VOTERS, query, turns, voters
from marginalia.tables import table

MODES = {"click": "POINT", "view": "LOOK"}
PLACES, VERBS = ["Kendal", "Ambleside", "Penrith"], ["walked to", "rode to"]


@query(VOTERS + ", g AS (SELECT DISTINCT pid FROM a WHERE label = 'PLACE') SELECT pid, start, \"end\", label FROM c WHERE pid IN (SELECT pid FROM g)")
def panel_in_gold(spark, d):
    """One annotator's spans in the passages that references exist for."""
    held = voters(spark, d)
    return W.in_gold(held["comma"].drop("voter"), held["capital"].filter("label = 'PLACE'"))


@query(EVERY_VOTER + " SELECT DISTINCT pid, start, \"end\", 'PLACE' AS label FROM u")
def collapsed_labels(spark, d):
    a, b, c = (x.drop("voter") for x in voters(spark, d).values())
    return W.collapsed(a.unionByName(b).unionByName(c))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'POINT' ELSE 'LOOK' END AS label, event_type AS model_label FROM events WHERE event_type IN ('click', 'view')")
def harmonised_labels(spark, d):
    return W.harmonised(table(spark, d, "events").select("event_id", F.col("event_type").alias("label")), MODES)


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'english' WHEN lang = 'fr' THEN 'french' ELSE 'other' END AS lang FROM documents")
def mapped_values(spark, d):
    return W.mapped(table(spark, d, "documents").select("doc_id", "lang"), "lang", {" EN": "english", "fr": "french"}, "other")


@query("""SELECT l_orderkey, l_linenumber, 'returned' AS selection FROM lineitem WHERE l_returnflag = 'R' UNION ALL
SELECT l_orderkey, l_linenumber, 'open' FROM lineitem WHERE l_linestatus = 'O' UNION ALL
SELECT l_orderkey, l_linenumber, 'filled, not returned' FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'F'""")
def named_selections(spark, d):
    wanted = {"returned": {"l_returnflag": "R"}, "open": {"l_linestatus": "O"}, "filled, not returned": {"l_returnflag": "N", "l_linestatus": "F"}}
    return W.selections(table(spark, d, "lineitem"), wanted).select("l_orderkey", "l_linenumber", "selection")


@query("SELECT conv_id, turn, text FROM conversations ORDER BY conv_id, turn LIMIT 25")
def first_examples(spark, d):
    return W.first_rows(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"], 25)


@query("SELECT id, ['Kendal', 'Ambleside', 'Penrith'][id // 2 % 3 + 1] AS place, ['walked to', 'rode to'][id % 2 + 1] AS verb, 'We ' || ['walked to', 'rode to'][id % 2 + 1] || ' ' || ['Kendal', 'Ambleside', 'Penrith'][id // 2 % 3 + 1] || '.' AS text FROM (SELECT unnest(range(180)) AS id)")
def templated_records(spark, d):
    return W.templated(spark, 180, "We {verb} {place}.", place=PLACES, verb=VERBS)


@query("""WITH r AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN lang END AS lang FROM documents),
c AS (SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN text ELSE text || '.' END) AS s, min(source) AS source FROM documents GROUP BY ALL)
SELECT r.doc_id, coalesce(r.lang, c.source) AS lang, CASE WHEN r.lang IS NOT NULL THEN 'live' WHEN c.source IS NOT NULL THEN 'cached' ELSE 'none' END AS origin FROM r LEFT JOIN c ON c.doc_id = r.doc_id AND c.s = sha256(r.text)""")
def cached_answers(spark, d):
    """Answers of a run, and where it gave none those kept for the very same text."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    asked = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.col("lang"))).drop("source")
    cached = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("."))).alias("text"), F.col("source").alias("lang"))
    return W.exact_lookup(asked, cached, "doc_id", "lang").select("doc_id", "lang", "origin")


@query("""WITH r AS (SELECT *, turn % 4 <> 3 AND coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) % 4 <> 3, true) AS stays FROM conversations)
SELECT conv_id, CAST(count(*) FILTER (stays) AS BIGINT) AS kept, max(turn) FILTER (stays) AS last FROM r GROUP BY 1""")
def edit_log(spark, d):
    """Turns as an edit log: every fourth takes the last one back."""
    turn = F.col("turn")
    log = turns(spark, d).select("conv_id", "turn", F.when(turn % 4 == 3, "undo").otherwise("add").alias("action"), F.col("turn").alias("item"))
    return W.surviving(log, "conv_id", "turn").select("conv_id", F.size("kept").cast("long").alias("kept"), F.try_element_at("kept", F.lit(-1)).alias("last"))
