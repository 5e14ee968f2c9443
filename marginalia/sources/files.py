"""Readers and sinks at the edges: JSON lines, word lists, CSV, panel output."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SPAN = "struct<start:int,end:int,label:string,text:string>"
PANEL = f"voter string, kind string, revision string, passage_id string, elapsed_s double, prompt_fingerprint string, served map<string,string>, spans array<{SPAN}>, n_failed_quotes int"
GAZETTEER = "text string, label string, conceptual_level string, note string"


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines with a fixed schema; malformed lines fail, blank ones are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_keyed(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines whose key must be there and unique; a breach fails when the rows are read."""
    rows = read_jsonl(spark, path, schema)
    n = F.count("*").over(Window.partitionBy(key))
    bad = F.col(key).isNull() | (F.col("__n") > 1)
    checked = rows.withColumn("__n", n).withColumn("__ok", F.when(bad, F.raise_error(F.concat(F.lit("missing or repeated key: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.lit(True)))
    return checked.filter("__ok").drop("__n", "__ok")


def panel_spans(panel: DataFrame) -> DataFrame:
    """voter, pid, start, end, label, text: one row a span of panel output."""
    return panel.select("voter", F.col("passage_id").alias("pid"), F.inline("spans"))


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """term, count, risky of a word list: comments (;) and blanks out, ``TERM: 44,884`` read, first of equal terms kept."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.trim(F.regexp_replace("value", "^\\ufeff|\\r$", "")).alias("line"))
    kept = lines.filter((F.length("line") > 0) & ~F.col("line").startswith(";"))
    parsed = kept.select("at", F.trim(F.regexp_replace("line", r":\s*[0-9][0-9,]*$", "")).alias("term"), F.regexp_replace(F.regexp_extract("line", r":\s*([0-9][0-9,]*)$", 1), ",", "").alias("n"))
    first = parsed.groupBy(F.lower("term").alias("key")).agg(F.min_by("term", "at").alias("term"), F.min_by("n", "at").alias("n"))
    return first.select("term", F.expr("try_cast(nullif(n, '') as long)").alias("count"), ((F.length("term") < 2) | F.col("term").rlike("[0-9]")).alias("risky"))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path, text of every .txt below a folder."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed column order; a column that the rows lack is empty."""
    rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.csv(path, header=True)


def digest(rows: DataFrame, key: str) -> DataFrame:
    """sha256 of the rows' canonical JSON lines in order of ``key``, joined by line feeds.

    One running hash over sorted lines that come partition by partition: neither
    a task nor the driver ever holds the table.  Equal keys go by their lines.
    """
    lines = rows.select(F.col(key).alias("k"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("line")).orderBy("k", "line")
    total = hashlib.sha256()
    for n, row in enumerate(lines.select("line").toLocalIterator()):
        total.update((b"\n" if n else b"") + row["line"].encode())
    return rows.sparkSession.createDataFrame([(total.hexdigest(),)], "sha256 string")
