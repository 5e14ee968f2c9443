"""A bounded, repeatable training sample per label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.columns import hash_rate


#: Labels whose rates may be broadcast.
FEW_LABELS = 10_000


def per_label(rows: DataFrame, label: str, id_column: str, cap: int, seed: str) -> DataFrame:
    """About ``cap`` rows a label at most, chosen by a hash of the id; rows without a label are left out.

    One count per label (map-side combined) gives the rates; the sample is then
    a filter, so no label is sorted or gathered, and none comes to the driver.
    """
    rates = rows.groupBy(F.col(label).alias("__label")).agg(F.least(F.lit(1.0), F.lit(float(cap)) / F.count("*")).alias("__rate"))
    if rates.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        rates = F.broadcast(rates)
    kept = rows.join(rates, F.col(label) == F.col("__label")).filter(hash_rate(F.col(id_column), seed) < F.col("__rate"))
    return kept.drop("__label", "__rate")
