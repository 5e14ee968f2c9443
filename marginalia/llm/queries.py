"""The registered queries of this package and their SQL counterparts."""

from __future__ import annotations

from marginalia.llm import covertree, htmltext, langid, lm, mixing, neardedup, packing, quality, topk, toxicity
from marginalia.llm.columns import TEXTS, VECTORS, batches_of
from marginalia.tables import table as plain_table


def table(spark, sf_dir, name):
    batches_of(spark, VECTORS if name == "embeddings" else TEXTS)
    return plain_table(spark, sf_dir, name)


QUERIES = {
    "op1_langid": lambda spark, d: langid.op1_langid(table(spark, d, "documents")),
    "op2_topk": lambda spark, d: topk.op2_topk(table(spark, d, "embeddings")),
    "op3_neardedup": lambda spark, d: neardedup.op3_neardedup(table(spark, d, "documents")),
    "op4_mixing": lambda spark, d: mixing.op4_mixing(table(spark, d, "documents")),
    "op5_packing": lambda spark, d: packing.op5_packing(table(spark, d, "documents")),
    "op7_htmltext": lambda spark, d: htmltext.op7_htmltext(table(spark, d, "pages")),
    "op8_lm": lambda spark, d: lm.op8_lm(table(spark, d, "documents")),
    "op9_covertree": lambda spark, d: covertree.op9_covertree(table(spark, d, "embeddings")),
    "op10_toxicity": lambda spark, d: toxicity.op10_toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "op6_quality": lambda spark, d: quality.op6_quality(table(spark, d, "documents"), table(spark, d, "labels")),
}

ORACLES: dict[str, str] = {
    "op2_topk": topk.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op9_covertree": covertree.ORACLE,
}
