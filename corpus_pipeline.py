"""From documents to packed sequences: clean, drop near copies, cut repeats, mix, pack.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns
the columns of documents, with others that came along; the last returns the pieces of
sequences with their token ids.

Null and empty texts go with the quality rules. Of repeated rows and of copies one row stays,
with or without an id. Very long texts go through whole. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import mixing, ngram_join, packing, quality, repeats
from strandline.llm.common import stored, table

STAGES = [
    ("quality_rules", quality.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("suffix_array_dedup", repeats.stage),
    ("mix_sources", mixing.stage),
    ("packing", packing.stage),
]

#: SQL can't express tokenizing and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
