"""Small helpers on columns and batches that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id, written as text, leaves ``remainder``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def hash_rate(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the id and a seed, the same on every run and engine.

    The first 13 hexadecimal digits of an md5, over 2**52: exact as a double.
    """
    text = F.coalesce(doc_id.cast("string"), F.lit("null"))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema
    )


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 15, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches: joined until there are ``rows`` of them or ``size`` bytes."""
    held, n, b = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, b = n + batch.num_rows, b + batch.nbytes
        if n >= rows or b >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, b = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def require(df: DataFrame, *names: str) -> None:
    """Fail early, and by name, where a needed column is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with more fields behind it, given as DDL."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


#: Rows of an Arrow batch: whole texts are held in the JVM and in the worker at once, vectors are small.
TEXTS, VECTORS = 1000, 10000


def batches_of(spark, rows: int) -> None:
    """Size of the batches that go to Python, for the query that is made next, whatever ran before.

    A session whose setting is neither of ours keeps its own.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) in (str(TEXTS), str(VECTORS)):
        spark.conf.set(name, str(rows))


def set_aside(df: DataFrame, *taken: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns of these names renamed, and how to name them back with ``withColumnsRenamed``."""
    names = {c: f"__own_{c}" for c in df.columns if c in taken}
    return df.withColumnsRenamed(names), {v: k for k, v in names.items()}


def small_batches(spark) -> None:
    batches_of(spark, TEXTS)
