"""The corpus pipeline: documents through quality, language, near copies, mixture and packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import langid, mixing, neardedup, packing, quality
from marginalia.llm.columns import TEXTS, batches_of, held_out, set_aside
from marginalia.scratch import materialize
from marginalia.tables import table


def _begin(spark: SparkSession) -> None:
    """What a stage starts with: batches for texts, and a driver that has given up the stage behind it.

    Spark's own cleaner collects every half hour for the same end, so that
    broadcasts and shuffles of finished jobs go; stages of minutes don't wait for it.
    """
    batches_of(spark, TEXTS)
    spark.sparkContext._jvm.System.gc()


#: A language is told where the model is surer of it than not.
SURE = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more, learned from labels of the rows not held out.

    A null text is scored as an empty one, a null id trains nothing; repeated rows
    are scored each; without labels or with one kind of label alone every row
    gets the same score; an empty table stays empty.  The caller's columns come
    out as they were, one named ``score`` among them.
    """
    _begin(spark)
    rows, back = set_aside(docs, "score")
    model = quality.fit(rows, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4, 2))
    return quality.score(rows, model).filter(F.col("score") >= 0.7).drop("score").withColumnsRenamed(back).select(*docs.columns)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells with a score of ``SURE`` or more.

    Without a letter, with a null or empty text, or where no row names a
    language to learn from, none can be told and the row goes.  Repeated rows
    go or stay together; an empty table stays empty.  The caller's columns come
    out as they were, ``lang_pred`` and ``score`` among them.
    """
    _begin(spark)
    rows, back = set_aside(docs, "lang_pred", "score")
    found = langid.identify(rows, langid.fit(rows, ~held_out(F.col("doc_id"), 3, 1)))
    told = found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= SURE))
    return told.drop("lang_pred", "score").withColumnsRenamed(back).select(*docs.columns)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8), the least id; rows of one id and one text are one document.

    Texts without words (null, empty, white space) are copies of nothing and
    stay; an empty table stays empty; other columns are not read.

    Where ids repeat or are null, rows are told apart by id and text: each stays
    or goes by its own text, and a row without an id goes only where a row that
    stays, with an id if there is one, is its near copy.
    """
    _begin(spark)
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).filter((F.col("rows") > 1) | F.col("doc_id").isNull())
    if repeated.isEmpty():
        found = materialize(neardedup.near_duplicates(docs), "kept-copies")
        gone = found.filter(~F.col("kept")).select("doc_id")
        return docs.join(F.broadcast(gone) if gone.count() <= neardedup.FEW_IDS else gone, "doc_id", "left_anti").select(*docs.columns)
    row = F.struct(
        F.col("doc_id").isNull().alias("none"),
        F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("id"),
        F.xxhash64("text", F.col("text").isNull()).alias("text"),
    )
    found = materialize(neardedup.near_duplicates(docs.select(row.alias("row"), "text"), id_column="row"), "kept-copies")
    gone = found.filter(~F.col("kept")).select("row").distinct()
    # Rows without words are copies of nothing; only those of one id are one document.
    again = found.filter(F.col("kept") & ((F.col("n_shingles") > 0) | ~F.col("row.none"))).groupBy("row").agg(F.count("*").alias("rows"))
    again = again.filter(F.col("rows") > 1).select("row")
    gone, again = (F.broadcast(x) if x.count() <= neardedup.FEW_IDS else x for x in (gone, again))
    kept = docs.withColumn("row", row).join(gone, "row", "left_anti")
    whole = F.struct(*docs.columns)
    merged = kept.join(again, "row", "left_semi").groupBy("row").agg(F.min(whole).alias("whole")).select("whole.*")
    return kept.join(again, "row", "left_anti").select(*docs.columns).unionByName(merged)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source, each document as often as it is taken, up to three times.

    A null source is a source, the last; a null or empty text has no word and is
    taken at its source's rate; rows without an id share one draw.
    """
    _begin(spark)
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens over the mix; a null or empty text is its end alone, each copy is packed."""
    _begin(spark)
    return packing.op5_packing(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_language),
    ("MinHash near-dedup", keep_first_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifiers are no SQL; tests hold the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
