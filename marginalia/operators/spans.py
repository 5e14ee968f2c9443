"""Span operators: tokens, gazetteers, grounding, matching, pooling.

Long form throughout: one row a span, with ``pid`` (passage), ``start``, ``end``.
Spans that no other span reaches need not be compared: a passage's spans, in
order of start, fall into islands (runs in which each begins before an earlier
one ends), and every fold runs within an island, however long the passage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import spans as S
from marginalia.functions.text import LETTER
from marginalia.operators import cuts
from marginalia.scratch import materialize


def tokens(passages: DataFrame, pid: str = "pid", text: str = "text", before: int = 0) -> DataFrame:
    """pid, pos, start, end, word: runs of anything but white space, with code-point offsets.

    Offsets are found within the row: no shuffle.  A null or empty text has no
    token.  ``before``: so many of the words that precede each, as columns
    ``before1`` (the nearest) and on.
    """
    return cuts.tokens(passages, pid, text, before)


def tokens_listed(passages: DataFrame, surfaces: DataFrame, pid: str = "pid", text: str = "text") -> DataFrame:
    """Tokens with ``listed``: false only for words that are, in any case, no value of column ``surface``."""
    return cuts.tokens(passages, pid, text, bits=cuts.listed_bits(surfaces))


def build_gazetteer(words: DataFrame, pid: str = "pid", least: int = 3, most: int | None = None) -> DataFrame:
    """term, df: words by the number of passages that hold them; a null passage counts as none."""
    return _frequent(words.select(pid, F.lower("word").alias("term")).distinct(), pid, least, most)


def gazetteer_of_texts(passages: DataFrame, pid: str = "pid", text: str = "text", least: int = 3, most: int | None = None) -> DataFrame:
    """The same of whole texts: a word is made single within its row and counted in the worker, so only counts are shuffled.

    Of passages that share an id (a filter of fixed size has these ids) the (id, word) pairs are made single by a shuffle.
    """
    named = passages.filter(F.col(pid).isNotNull())
    shared = cuts.id_bits(named.groupBy(pid).count().filter("count > 1"), pid)
    counts = cuts.term_counts(named, pid, text, shared)
    if shared is not None:
        counts = counts.groupBy(pid, "term").agg(F.sum("n").alias("n")).withColumn("n", F.when(F.col(pid).isNull(), F.col("n")).otherwise(1))
    return _at_least(counts.groupBy("term").agg(F.sum("n").alias("df")), least, most)


def _frequent(once: DataFrame, pid: str, least: int, most: int | None) -> DataFrame:
    return _at_least(once.groupBy("term").agg(F.count(pid).alias("df")), least, most)


def _at_least(counted: DataFrame, least: int, most: int | None) -> DataFrame:
    kept = counted.filter(F.col("df") >= least)
    return kept if most is None else kept.filter(F.col("df") <= most)


def by_island(pid: str, **sides: DataFrame) -> DataFrame:
    """pid, island and, for each side, the array of its spans there in order of (start, end, other columns).

    One shuffle by passage; grouping by island needs no other.
    """
    structs = {n: F.struct("start", "end", *[c for c in df.columns if c not in (pid, "start", "end")]) for n, df in sides.items()}
    kinds = {n: df.select(structs[n].alias("x")).schema["x"].dataType for n, df in sides.items()}
    union = None
    for name, df in sides.items():
        own = [structs[n].alias(n) if n == name else F.lit(None).cast(kinds[n]).alias(n) for n in sides]
        part = df.select(F.col(pid), F.col("start").cast("int").alias("__s"), F.col("end").cast("int").alias("__e"), *own)
        union = part if union is None else union.unionByName(part)
    order = Window.partitionBy(pid).orderBy("__s", "__e")
    reach = F.max("__e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("__s") >= reach), 1).otherwise(0)
    marked = union.withColumn("__fresh", fresh).withColumn("island", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(pid, "island").agg(*[F.array_sort(F.collect_list(n)).alias(n) for n in sides])


def surface_hits(passages: DataFrame, gazetteer: DataFrame, pid: str = "pid", text: str = "text") -> DataFrame:
    """pid, start, end, surface and the gazetteer's other columns of every place where a surface stands, overlaps included.

    gazetteer: ``surface`` and, where it is there, ``any_case``.  A surface is
    one or more words with what stands between them; it matches literally, or in
    any case where ``any_case``, from a word's start to a word's end, so it must
    begin and end with a letter, digit or underscore (others match nothing).
    Runs of as many words as the surfaces have are joined to them by equality,
    after a filter of fixed size has left out nearly all that match nothing.
    """
    listed = gazetteer if "any_case" in gazetteer.columns else gazetteer.withColumn("any_case", F.lit(False))
    listed = materialize(listed.filter(F.col("surface").rlike(f"^[{LETTER}]") & F.col("surface").rlike(rf"[{LETTER}]\z")), "surfaces")
    widths = sorted(r["k"] for r in listed.select(F.regexp_count("surface", F.lit(f"[{LETTER}]+")).alias("k")).distinct().collect())
    each = cuts.places(passages, cuts.listed_bits(listed), widths, pid, text).withColumnRenamed("gram", "__gram")
    met = each.join(listed, (F.lower("__gram") == F.lower("surface")) & (F.col("any_case") | (F.col("__gram") == F.col("surface"))))
    return met.withColumn("end", F.col("start") + F.length("__gram")).withColumn("surface", F.col("__gram")).drop("__gram")


def gazetteer_spans(passages: DataFrame, gazetteer: DataFrame, pid: str = "pid", text: str = "text") -> DataFrame:
    """pid, start, end, surface, label: the annotation that a layered gazetteer gives.

    gazetteer: surface, label and perhaps any_case.  Each layer (as written,
    then in any case) is read from left to right, the longest surface first, and
    goes on behind what it found; a find of the second layer that overlaps one
    of the first is left out.  A null or empty label annotates nothing.
    """
    found = surface_hits(passages, gazetteer.filter(F.length("label") > 0), pid, text)
    layered = found.select(pid, "start", "end", F.col("any_case").cast("int").alias("layer"), "surface", "label")
    rows = by_island(pid, all=layered)
    fold = """
      if(size(all) = 1, all, aggregate(array_sort(all, (x, y) -> case when x.layer <> y.layer then x.layer - y.layer when x.start <> y.start then x.start - y.start
          when x.`end` <> y.`end` then y.`end` - x.`end` when x.label < y.label then -1 when x.label > y.label then 1 else 0 end),
        named_struct('out', slice(all, 1, 0), 'one', 0, 'two', 0),
        (a, s) -> if(s.start < if(s.layer = 0, a.one, a.two), a, named_struct(
          'out', if(exists(a.out, t -> t.layer < s.layer and t.start < s.`end` and s.start < t.`end`), a.out, array_append(a.out, s)),
          'one', if(s.layer = 0, s.`end`, a.one), 'two', if(s.layer = 1, s.`end`, a.two))),
        a -> a.out))"""
    return rows.select(pid, F.inline(F.expr(fold))).select(pid, "start", "end", "surface", "label")


def longest_surfaces(passages: DataFrame, gazetteer: DataFrame, pid: str = "pid", text: str = "text") -> DataFrame:
    """pid, start, end, surface, label of a plain gazetteer: the longest surface anywhere first, then what it leaves free."""
    found = surface_hits(passages, gazetteer, pid, text).withColumn("__rank", -F.length("surface"))
    return longest_first(found.select(pid, "start", "end", "surface", "label", "__rank"), pid, "__rank").drop("__rank")


def longest_first(spans: DataFrame, pid: str = "pid", rank: str = "rank") -> DataFrame:
    """Non-overlapping spans of each passage: by ``rank``, then start, then the longer; a fold over the spans of an island."""
    ordered = spans.withColumn("__order", F.struct(F.col(rank).alias("k1"), F.col("start").alias("k2"), (-F.col("end")).alias("k3")))
    rows = by_island(pid, all=ordered)
    fold = """
      aggregate(transform(array_sort(transform(all, x -> struct(x.__order as k, x as v))), x -> x.v), slice(all, 1, 0),
        (acc, s) -> if(exists(acc, t -> t.start < s.`end` and s.start < t.`end`), acc, array_append(acc, s)))"""
    return rows.select(pid, F.inline(F.expr(fold))).select(pid, *[c for c in spans.columns if c != pid])


def ground(quotes: DataFrame, passages: DataFrame, pid: str = "pid") -> DataFrame:
    """Exact quotes to offsets: the k-th repeat of a quote takes its k-th occurrence.

    quotes: pid, voter, ord, quote.  Adds occurrence, start, end and status
    (``grounded``, ``empty_quote``, ``not_in_passage``, ``repeated_and_exhausted``).
    Occurrences are literal and do not overlap; different quotes never block
    each other.
    """
    turn = Window.partitionBy(pid, "voter", "quote").orderBy("ord")
    rows = quotes.withColumn("occurrence", F.row_number().over(turn)).join(passages.select(pid, F.col("text").alias("passage")), pid)
    # Between \Q and \E all is literal; a quote's own \E ends that and begins it anew.
    literal = F.concat(F.lit("\\Q"), F.replace(F.col("quote"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    rows = rows.withColumn("pieces", F.when(F.length("quote") > 0, F.split("passage", literal, -1)))
    hit = F.col("occurrence") < F.size("pieces")
    before = F.slice("pieces", 1, F.col("occurrence"))
    start = F.aggregate(before, F.lit(0), lambda n, s: n + F.length(s)) + (F.col("occurrence") - 1) * F.length("quote")
    status = (
        F.when(F.coalesce(F.length("quote"), F.lit(0)) == 0, "empty_quote")
        .when(hit, "grounded")
        .when(F.size("pieces") == 1, "not_in_passage")
        .otherwise("repeated_and_exhausted")
    )
    out = rows.withColumn("status", status).withColumn("start", F.when(F.col("status") == "grounded", start))
    return out.withColumn("end", F.col("start") + F.length("quote")).drop("pieces", "passage")


def match(predictions: DataFrame, gold: DataFrame, regime: str = "overlap", pid: str = "pid", label: bool = False) -> DataFrame:
    """pid, tp, fp, fn by greedy one-to-one matching, predictions in order of start.

    ``exact``: equal offsets, each gold span once; ``overlap``: the unused gold
    span of largest overlap, the first on ties; ``any``: the first unused gold
    span that overlaps.  ``label``: labels must be equal too.  Passages of
    either side.
    """
    named = ["label"] if label else []
    if regime == "exact":
        keys = [pid, "start", "end", *named]
        both = predictions.select(*keys, F.lit(1).alias("p"), F.lit(0).alias("g")).unionByName(gold.select(*keys, F.lit(0).alias("p"), F.lit(1).alias("g")))
        return match_marked(both, keys, [pid])
    rows = by_island(pid, p=predictions.select(pid, "start", "end", *named), g=gold.select(pid, "start", "end", *named))
    shared = "greatest(0, least(g[i].`end`, x.`end`) - greatest(g[i].start, x.start))"
    score = shared if regime == "overlap" else f"least(1, {shared})"
    free = f"filter(sequence(0, size(g) - 1), i -> not array_contains(used, i) and {score} > 0{' and g[i].label <=> x.label' if label else ''})"
    best = f"array_max(transform({free}, i -> struct({score} as o, -i as k)))"
    fold = f"""
      aggregate(p, cast(array() as array<int>), (used, x) ->
        if(size(g) = 0, used, aggregate(array({best}), used, (u, b) -> if(b is null, u, array_append(u, -b.k)))))
    """
    found = rows.select(pid, F.size(F.expr(fold)).cast("long").alias("tp"), F.size("p").alias("p"), F.size("g").alias("g"))
    sums = found.groupBy(pid).agg(*[F.sum(c).alias(c) for c in ("tp", "p", "g")])
    return sums.select(pid, "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))


def match_marked(spans: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``by``, tp, fp, fn by equality of ``keys``; spans carry ``p`` and ``g``, 1 where the prediction or the reference has them, else 0."""
    same = spans.groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("g").alias("g")).withColumn("tp", F.least("p", "g"))
    sums = same.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "p", "g")])
    return sums.select(*by, "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))


def unmatched(predictions: DataFrame, gold: DataFrame, pid: str = "pid", label: bool = True) -> DataFrame:
    """side (``missed`` or ``spurious``), pid, start, end, label of spans without a partner of equal offsets (and label).

    Of repeated spans as many remain as the other side lacks.
    """
    keys = [pid, "start", "end", *(["label"] if label else [])]
    both = predictions.select(*keys, F.lit(1).alias("n")).unionByName(gold.select(*keys, F.lit(-1).alias("n")))
    left = both.groupBy(*keys).agg(F.sum("n").cast("int").alias("n")).filter(F.col("n") != 0)
    side = F.when(F.col("n") > 0, "spurious").otherwise("missed")
    return left.select(side.alias("side"), *keys, F.explode(F.sequence(F.lit(1), F.abs("n"))).alias("copy")).drop("copy")


def scores(counts: DataFrame, *by: str) -> DataFrame:
    """Micro precision, recall and F1 over groups of (tp, fp, fn)."""
    sums = counts.groupBy(*by).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return sums.select(*by, "tp", "fp", "fn", *[F.round(x, 4).alias(n) for x, n in ((S.precision(tp, fp), "precision"), (S.recall(tp, fn), "recall"), (S.f1(tp, fp, fn), "f1"))])


def pool(spans: DataFrame, pid: str = "pid", least_iou: float = 0.5, containment: float = 0.8) -> DataFrame:
    """Overlapping spans of many voters as decision items.

    Spans of a passage go by (start, end, voter) and join the first item that
    has a member marking the same thing, else open one.  One row an item:
    pid, item, start, end, votes map<voter, label> (a voter's first span wins),
    members.
    """
    rows = by_island(pid, all=spans.select(pid, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "voter", "label"))
    shared = "greatest(0, least(m.`end`, s.`end`) - greatest(m.start, s.start))"
    same = f"""{shared} > 0 and ({shared} >= {least_iou} * ((m.`end` - m.start) + (s.`end` - s.start) - {shared})
      or {shared} >= {containment} * least(m.`end` - m.start, s.`end` - s.start))"""
    kind = "array<array<struct<start:int,end:int,voter:string,label:string>>>"
    fold = f"""
      aggregate(all, cast(array() as {kind}), (gs, s) ->
        aggregate(array(coalesce(array_position(transform(gs, g -> exists(g, m -> {same})), true), 0)), gs, (x, k) ->
          if(k = 0, concat(x, array(array(s))), transform(x, (g, i) -> if(i + 1 = k, concat(g, array(s)), g)))))
    """
    items = rows.select(pid, "island", F.posexplode(F.expr(fold)).alias("nth", "members"))
    number = F.row_number().over(Window.partitionBy(pid).orderBy("island", "nth")) - 1
    first = F.expr("map_from_entries(filter(transform(members, (m, i) -> struct(m.voter, m.label)), (m, i) -> not exists(slice(members, 1, i), p -> p.voter = m.voter)))")
    return items.select(
        pid,
        number.alias("item"),
        F.array_min(F.transform("members", lambda m: m["start"])).alias("start"),
        F.array_max(F.transform("members", lambda m: m["end"])).alias("end"),
        first.alias("votes"),
        "members",
    )


def pooled_votes(items: DataFrame, voters: list[str], pid: str = "pid", abstain: str = "NONE") -> DataFrame:
    """pid, item, n_proposing, modal_label, agreement, unanimous, extent_disagreement, stratum of pooled items.

    A voter without a span in an item abstains.  The modal label is the one most
    voters gave, on ties that of the voter who comes first in ``voters``; an
    item is unanimous where all voters, none abstaining, gave it.
    """
    names = F.array(*[F.lit(v) for v in voters])
    given = F.filter(F.transform(names, lambda v: F.try_element_at("votes", v)), lambda x: x.isNotNull() & (x != abstain))
    rows = items.select(pid, "item", "members", given.alias("given"))
    counted = rows.withColumn("best", F.expr("array_max(transform(given, (x, i) -> struct(size(filter(given, y -> y = x)) as n, -i as k, x as label)))"))
    extents = F.size(F.array_distinct(F.transform("members", lambda m: F.struct(m["start"], m["end"])))) > 1
    agreement = F.coalesce("best.n", F.lit(0))
    every = (agreement == len(voters)).alias("unanimous")
    out = counted.select(pid, "item", F.size("given").alias("n_proposing"), F.coalesce("best.label", F.lit(abstain)).alias("modal_label"), agreement.alias("agreement"), every, extents.alias("extent_disagreement"))
    return out.withColumn("stratum", F.when(F.col("unanimous") & ~F.col("extent_disagreement"), "A_unanimous").otherwise("B_contested"))


def overlap_pairs(a: DataFrame, b: DataFrame, pid: str = "pid") -> DataFrame:
    """Span pairs of a passage that overlap; only spans of one island meet."""
    rows = by_island(pid, a=a.select(pid, "start", "end"), b=b.select(pid, "start", "end"))
    one = rows.select(pid, "b", F.inline("a")).withColumnsRenamed({"start": "s1", "end": "e1"})
    met = one.select(pid, "s1", "e1", F.inline("b")).withColumnsRenamed({"start": "s2", "end": "e2"})
    met = met.filter((F.col("s1") < F.col("e2")) & (F.col("s2") < F.col("e1")))
    cols = [F.col(c) for c in ("s1", "e1", "s2", "e2")]
    return met.select(pid, "s1", "e1", "s2", "e2", S.overlap(*cols).cast("int").alias("shared"), F.round(S.iou(*cols), 6).alias("iou"))


def split_by_overlap(spans: DataFrame, taken: DataFrame, pid: str = "pid") -> DataFrame:
    """``spans`` with ``__met``: whether any span of ``taken`` overlaps."""
    rows = by_island(pid, s=spans, t=taken.select(pid, "start", "end"))
    marked = F.expr("transform(s, x -> struct(x as v, exists(t, y -> y.start < x.`end` and x.start < y.`end`) as met))")
    return rows.select(pid, F.inline(marked)).select(pid, "v.*", F.col("met").alias("__met")).select(*spans.columns, "__met")
