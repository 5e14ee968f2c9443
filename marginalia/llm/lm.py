"""Language-model scores of whole texts from subword lattices.

The vocabulary is an existing subword vocabulary, its unigram scores re-estimated
on the training words by expectation-maximisation over lattices, and every word
of the training texts as one more piece, whose score is its discounted count.  The
forward recursion sums over all segmentations of a word, the word itself among
them, so known and unknown words have a probability alike:

    P(w) = (c - d) / N + d * V / N * (sum over segmentations into pieces)

(the first term only where c > 0); an end has documents / N.  A text is its words
and an end, and as no piece holds a space, its marginal over all segmentations is
their product.

Where training texts name their language, each language of ``LEAST_SHARE`` of
them or more discounts towards P in the same way, and a text's probability is
marginal over languages too.  The language of a text is not read to score it.

Words are counted once for all texts, in narrow rows of (word, language); a
bounded table of the most frequent is given to every task, the rest are looked
up by a join on the word.  A row's number is written once, with its id, and
carried from there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from marginalia.llm.columns import gathered, held_out, record_batch, require
from marginalia.llm.lattice import NEVER, HashTable, Lattice, Pieces
from marginalia.llm.textblocks import LOWER, blocks, words
from marginalia.scratch import materialize

#: Words of the table that every task holds (about 60 bytes each).
HEAD = 1 << 18
#: Languages of a smaller share of the training texts are left to the model of all (so there are 1 / LEAST_SHARE at most).
LEAST_SHARE = 1e-3
LN10 = float(np.log(10))


def _gather(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte strings [start, end) as one Arrow array."""
    length = end - start
    offsets = np.concatenate([[0], np.cumsum(length)])
    index = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw[index])])


def word_counts(docs: DataFrame, train: Column, languages: list[str]) -> DataFrame:
    """h, word, n (in all texts), c (in training texts), kinds and counts (of its languages) of every distinct word, lower-cased."""
    schema = pa.schema([("h", pa.int64()), ("word", pa.binary()), ("kind", pa.int32()), ("n", pa.int64()), ("c", pa.int64())])
    kind = F.lit(-1)
    if languages:
        kind = F.coalesce(F.when(train, F.array_position(F.lit(languages), F.col("lang")) - 1), kind)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learn = batch.column(1).to_numpy(zero_copy_only=False)
            which = batch.column(2).to_numpy()
            for lo, _, raw, offsets in blocks(batch.column(0)):
                w = words(raw, offsets)
                if not len(w.hashes):
                    continue
                of = which[lo + w.row]
                order = np.lexsort((of, w.hashes))
                h, of = w.hashes[order], of[order]
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])))
                seen = np.add.reduceat(learn[lo + w.row[order]].astype(np.int64), first)
                at = order[first]
                n = np.diff(np.append(first, len(h)))
                yield record_batch(schema, [h[first].astype(np.int64), _gather(LOWER[raw], w.start[at], w.end[at]), of[first].astype(np.int32), n, seen])

    made = docs.select("text", train.alias("train"), kind.cast("int").alias("kind")).mapInArrow(count, "h long, word binary, kind int, n long, c long")
    each = made.groupBy("h", "word", "kind").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    # A word has a row a language at most here.
    own = F.array_sort(F.collect_list(F.when(F.col("kind") >= 0, F.struct("kind", "c"))))
    whole = each.groupBy("h", "word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), own.alias("own"))
    return whole.select("h", "word", "n", "c", F.col("own.kind").alias("kinds"), F.col("own.c").alias("counts"))


def _spelled(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    edges = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)[edges[0] : edges[-1]] if len(column) else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    return raw, edges[:-1], edges[1:]


def learn(types: DataFrame, pieces: Pieces, rounds: int = 2) -> Lattice:
    """Expectation-maximisation over all distinct training words; a number a piece comes to the driver.

    A word counts once, however often it occurs: the spelling speaks for words
    that have no count, and those are like the rare ones.
    """
    lattice = Lattice.initial(pieces)
    seen = types.filter(F.col("c") > 0).select("word")
    n_start, n_cont = len(pieces.start) + 1, len(pieces.cont)
    schema = pa.schema([("k", pa.int32()), ("v", pa.float64())])
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], model: Lattice = lattice) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n_start + n_cont + 1)
            for batch in gathered(batches, size=2 << 20):
                start, cont, w = model.expected(*_spelled(batch.column(0)), np.ones(batch.num_rows))
                total += np.concatenate([start, cont, [w]])
            some = np.flatnonzero(total)
            yield record_batch(schema, [some.astype(np.int32), total[some]])

        got = seen.mapInArrow(expect, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        total = np.zeros(n_start + n_cont + 1)
        total[got["k"].to_numpy(np.int64)] = got["v"].to_numpy()
        lattice = lattice.refit(total[:n_start], total[n_start:-1], float(total[-1]))
    return lattice


@dataclass
class Counted:
    """What a model discounts with: words and ends counted, distinct words, and the cut of a count."""

    total: int
    kinds: int
    cut: float

    @classmethod
    def of(cls, words: int, ends: int, kinds: int, once: int, twice: int) -> Counted:
        return cls(words + ends, kinds, float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.95)))

    def free(self) -> float:
        """Natural log of what is left to other segmentations; half where nothing was counted."""
        return float(np.log(self.cut * self.kinds / self.total)) if self.kinds else float(np.log(0.5))

    def whole(self, c: np.ndarray) -> np.ndarray:
        """Natural log of a counted word's own arc."""
        return np.where(c > 0, np.log(np.maximum(c - self.cut, 1e-300) / max(self.total, 1)), NEVER)


def _facts(types: DataFrame) -> tuple[Row, dict[int, Row]]:
    """Sums over words and, by language, over (word, language)."""
    sums = lambda c: [F.sum(c).alias("n"), F.count_if(F.col(c) > 0).alias("v"), F.count_if(F.col(c) == 1).alias("one"), F.count_if(F.col(c) == 2).alias("two")]
    entries = types.select(F.explode(F.arrays_zip("kinds", "counts")).alias("x")).select(F.col("x.kinds").alias("kind"), F.col("x.counts").alias("c"))
    return types.agg(*sums("c")).first(), {r["kind"]: r for r in entries.groupBy("kind").agg(*sums("c")).collect()}


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and row offsets of an Arrow list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]] if len(column) else np.zeros(0), (offsets - offsets[0]).astype(np.int64)


def score(docs: DataFrame, train: Column, id_column: str = "doc_id", vocabulary_file: str | None = None) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of every row; log10 throughout.

    A null text is an empty one and has the end alone.  Repeated rows are scored
    each, and rows of one id or of a null id keep their own scores.  Without
    training rows no token is known and words are as likely as their spelling.
    A very long word costs time linear in its bytes.  Other columns of the input
    are not read, but for ``lang`` of the training rows.
    """
    require(docs, id_column, "text")
    pieces = Pieces.load(vocabulary_file)
    trained = docs.filter(train)
    documents, shares = trained.count(), {}
    if "lang" in docs.columns:
        common = trained.filter(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("k")).filter(F.col("k") >= LEAST_SHARE * documents)
        shares = {r["lang"]: r["k"] for r in sorted(common.collect(), key=lambda r: str(r["lang"]))}
    types = materialize(word_counts(docs, train, list(shares)), "lm-words")
    facts, by_kind = _facts(types)
    every = Counted.of(int(facts["n"] or 0), documents, facts["v"], facts["one"], facts["two"])
    none = {"n": 0, "v": 0, "one": 0, "two": 0}
    owns = [Counted.of(int(r["n"]), ends, r["v"], r["one"], r["two"]) for r, ends in ((by_kind.get(k, none), e) for k, e in enumerate(shares.values()))]
    lattice = learn(types, pieces)
    total = every.total
    base = float(total + every.kinds + (documents > 0) + 1)
    value_schema = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("known", pa.bool_()), ("base", pa.float64()), ("own", pa.float64()), ("kinds", pa.list_(pa.int32())), ("gains", pa.list_(pa.float64()))])

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """log10 of P(w), and for its languages by how much their models give it more than they would uncounted."""
        for batch in gathered(batches, size=2 << 20):
            c = batch.column("c").to_numpy().astype(np.float64)
            own = lattice.log10(*_spelled(batch.column("word")), every.whole(c), every.free())
            kinds, offsets = _flat(batch.column("kinds"))
            counts, _ = _flat(batch.column("counts"))
            row = np.repeat(np.arange(len(c)), np.diff(offsets))
            gains = np.empty(len(kinds))
            for k in np.unique(kinds):
                at = np.flatnonzero(kinds == k)
                uncounted = owns[k].free() + own[row[at]] * LN10
                gains[at] = (np.logaddexp(owns[k].whole(counts[at]), uncounted) - uncounted) / LN10
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, t)) for x, t in ((kinds, pa.int32()), (gains, pa.float64()))]
            yield record_batch(value_schema, [batch.column("h"), batch.column("n"), c > 0, np.log10((c + 1) / base), own, *lists])

    valued = materialize(types.mapInArrow(value, "h long, n long, known boolean, base double, own double, kinds array<int>, gains array<double>"), "lm-values")
    level = F.floor(F.log2("n"))
    sizes = sorted(((r["l"], r["k"]) for r in valued.groupBy(level.alias("l")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, held = 1 << 62, 0
    for at, k in sizes:
        if held + k > HEAD:
            break
        least, held = 1 << int(at), held + k
    frequent = valued.filter(F.col("n") >= least).drop("n").toArrow()  # HEAD rows at most
    kinds, offsets = _flat(frequent.column("kinds"))
    gains, _ = _flat(frequent.column("gains"))
    shared = docs.sparkSession.sparkContext.broadcast(
        (frequent.column("h").to_numpy().astype(np.uint64), frequent.column("known").to_numpy(), frequent.column("base").to_numpy(), frequent.column("own").to_numpy(), kinds, gains, offsets)
    )
    del frequent
    # Shares of the models: those of the training texts; what no language has goes to the model of all.
    rest = max(documents - sum(shares.values()), 1)
    share = np.log10(np.array([rest, *shares.values()]) / (rest + sum(shares.values())))
    ends = [np.log10(e / m.total) if e else np.log10(0.5) for e, m in zip([documents, *shares.values()], [every, *owns], strict=True)]
    # Of the model of all and of each language: what a text has once, and what it has for each word.
    once = np.array(ends) + share
    each = np.array([0.0, *[m.free() / LN10 for m in owns]])
    end_base = float(np.log10((documents + 1) / base))
    id_type = docs.schema[id_column].dataType.simpleString()
    part_names = ["rid", "id", "h", "n", "known", "base", "by"]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a text, with all that the frequent words give; a row an other word, with its hash."""
        keys, is_known, bases, own_of, kinds, gains, offsets = shared.value
        head = HashTable(keys, 20)
        for batch in batches:
            rid = batch.column(0)
            ids = batch.column(1)
            for lo, hi, raw, starts in blocks(batch.column(2)):
                w = words(raw, starts)
                m = hi - lo
                at = head.find(w.hashes)
                hit = at >= 0
                row, place = w.row[hit], at[hit].astype(np.int64)
                known = np.bincount(row, is_known[place], minlength=m) + (documents > 0)
                tokens = np.bincount(w.row, minlength=m)
                sums = once[None] + tokens[:, None] * each[None] + np.bincount(row, own_of[place], minlength=m)[:, None]
                width = offsets[place + 1] - offsets[place]
                if width.sum():
                    entry = np.repeat(offsets[place] - (np.cumsum(width) - width), width) + np.arange(width.sum())
                    cell = np.repeat(row, width) * len(once) + kinds[entry] + 1
                    sums += np.bincount(cell, gains[entry], minlength=m * len(once)).reshape(m, -1)
                by = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * len(once), pa.int32()), pa.array(sums.ravel()))
                own = rid.slice(lo, m)
                arrays = [own, ids.slice(lo, m), pa.nulls(m, pa.int64()), pa.array(tokens + 1, pa.int64()), pa.array(known.astype(np.int64)), pa.array(np.bincount(row, bases[place], minlength=m) + end_base), by]
                yield pa.RecordBatch.from_arrays(arrays, names=part_names)
                other = np.flatnonzero(~hit)
                if len(other):
                    k = len(other)
                    arrays = [own.take(pa.array(w.row[other])), pa.nulls(k, ids.type), pa.array(w.hashes[other].astype(np.int64)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(arrays, names=part_names)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_column).alias("id"), "text")
    made = materialize(rows.mapInArrow(parts, f"rid long, id {id_type}, h long, n long, known long, base double, by array<double>"), "lm-parts")
    looked = made.filter(F.col("h").isNotNull()).select("rid", "h").join(valued.filter(F.col("n") < least).drop("n"), "h")
    # Kind -1 has what every model is given, the others what their language adds.
    common_entry = F.struct(F.lit(-1).alias("kind"), F.col("own").alias("x"), F.col("known").cast("long").alias("known"), F.col("base").alias("base"))
    kind_entries = F.transform(F.arrays_zip("kinds", "gains"), lambda z: F.struct(z["kinds"].alias("kind"), z["gains"].alias("x"), F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base")))
    summed = looked.select("rid", F.explode(F.concat(F.array(common_entry), kind_entries)).alias("e")).select("rid", "e.*")
    summed = summed.groupBy("rid", "kind").agg(F.sum("x").alias("x"), F.sum("known").alias("known"), F.sum("base").alias("base"))
    # A text has a row a language at most here.
    more = summed.groupBy("rid").agg(
        F.map_from_entries(F.collect_list(F.struct("kind", "x"))).alias("more"), F.sum("known").alias("known_more"), F.sum("base").alias("base_more")
    )
    whole = made.filter(F.col("h").isNull()).drop("h").join(more, "rid", "left")
    plus = lambda x: F.col(x) + F.coalesce(F.col(f"{x}_more"), F.lit(0))
    added = lambda k: F.coalesce(F.try_element_at("more", k), F.lit(0.0))
    logs = F.transform("by", lambda x, k: x + added(F.lit(-1)) + F.when(k > 0, added((k - 1).cast("int"))).otherwise(0.0))
    named = whole.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    marginal = F.col("top") + F.log10(F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.pow(F.lit(10.0), x - F.col("top"))))
    return named.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_tokens"),
        plus("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        plus("base").alias("base_score"),
        marginal.alias("score"),
    )


def op8_lm(docs: DataFrame) -> DataFrame:
    """Scores of all documents; crc32(doc_id) mod 7 = 2 is held out of training."""
    out = held_out(F.col("doc_id"), 7, 2)
    scored = score(docs, ~out)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
