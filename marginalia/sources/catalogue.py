"""Small side tables and configuration: manifests, mappings, annotator lists, profiles of a folder."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_manifest(spark: SparkSession, path: str, key: str = "Filename") -> DataFrame:
    """A CSV with header (and perhaps a byte-order mark): names and values trimmed, empty is null, ``stem`` of the file's name."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.lstrip("﻿").strip()) for c in rows.columns])
    return rows.withColumn("stem", F.regexp_replace(key, r"\.[^.]*$", ""))


def read_pairs(spark: SparkSession, path: str, value_type: str = "string") -> DataFrame:
    """key, value of a CSV of two columns under a header; split at the first comma, values that do not cast are null."""
    rows = spark.read.option("header", False).text(path).select(F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "^﻿|\\r$", "").alias("line"))
    first = rows.agg(F.min("at").alias("head"))
    kept = rows.join(F.broadcast(first), F.col("at") > F.col("head")).filter(F.contains("line", F.lit(",")))
    return kept.select(F.trim(F.substring_index("line", ",", 1)).alias("key"), F.expr(f"try_cast(trim(substring(line, position(',', line) + 1)) as {value_type})").alias("value"))


def with_manifest(passages: DataFrame, manifest: DataFrame, defaults: dict[str, str], stem: str = "stem") -> DataFrame:
    """passages with the manifest's columns of ``defaults``, the default where it has no row or no value; ``in_manifest`` says which."""
    known = manifest.dropDuplicates([stem]).select(stem, *defaults, F.lit(True).alias("__known"))
    met = passages.join(known, stem, "left")
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}
    return met.withColumns(filled | {"in_manifest": F.coalesce("__known", F.lit(False))}).drop("__known")


#: What a revision that nobody filled in holds (fixed values).
PLACEHOLDERS = ("fill in", "todo", "tbd", "xxx", "changeme", "?")


def load_specs(text: str) -> list[dict]:
    """Annotator specifications of a JSON list or of {"voters": [...]}; keys that begin with _ are comments.

    Fails without a name, with a name twice, or where an annotator that is not
    switched off (``enabled``: false) has no revision or one that holds a placeholder.
    """
    found = json.loads(text)
    specs = [{k: v for k, v in s.items() if not k.startswith("_")} for s in (found["voters"] if isinstance(found, dict) else found)]
    names = [s.get("name") for s in specs]
    if not all(names) or len(set(names)) < len(names):
        raise ValueError("names must be there and differ")
    revision = lambda s: str(s.get("revision") or "").strip().lower()
    unset = [s["name"] for s in specs if s.get("enabled", True) and (not revision(s) or any(p in revision(s) for p in PLACEHOLDERS))]
    if unset:
        raise ValueError(f"no revision: {', '.join(unset)}")
    return specs


def redacted(config: dict) -> dict:
    """The configuration without what must not be written down."""
    secret = ("api_key", "token", "secret", "password")
    return {k: redacted(v) if isinstance(v, dict) else "<redacted>" if any(s in k.lower() for s in secret) and v else v for k, v in config.items()}


def tag_profile(texts: DataFrame, text: str = "text", top: int = 12) -> DataFrame:
    """tag, n of the commonest opening tags over all texts: a report of ``top`` rows."""
    tags = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"<([A-Za-z][\w:.-]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(top)


def paragraphs(html: Column) -> Column:
    """An array of ord (from 1), text of the <p> elements in document order, without their tags."""
    raw = F.regexp_extract_all(html, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>"), F.lit(1))
    clean = F.transform(raw, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"<[^>]*>", " "), r"[ \t\r\n]+", " ")))
    return F.transform(clean, lambda p, k: F.struct((k + 1).alias("ord"), p.alias("text")))
