"""Corpus pipeline: toxicity filter, exact dedup, near-duplicate dedup, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
``documents``. ``run`` writes each stage's rows to the shared folder and reads them back as the next one's.

Defined cases, in every stage: a null text counts as empty (the suffix stage returns it as empty); columns other than those of ``documents``
are dropped, whatever their names; null lang, source and n_chars pass through; an empty table gives an empty result. Toxicity keeps documents in which no term matches, whatever
the labels. Exact dedup keeps one row of equal texts, that with the smallest id (ids that are null come last). The Jaccard stage keeps every row whose id is the smallest of its component, every row without an
id and every row without words. The suffix stage keeps all rows, also those that it empties. Packing gives every row at least one piece, for its end id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.llm import exact_dedup, jaccard_join, packing, suffix_dedup, toxicity
from meshlake.llm.queries import table, tokenizer_path
from meshlake.llm.store import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents outside the held-out fold; rows that score 0.5 or more go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs.select(*COLUMNS), model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    rest = [c for c in COLUMNS if c != "doc_id"]
    return exact_dedup.exact_dedup(docs, carry=tuple(rest)).where("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by five-word shingles at a similarity of 0.8 or more, the smallest id stays."""
    return jaccard_join.without_near_duplicates(docs).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 200 bytes that start elsewhere too are cut; n_chars is counted anew."""
    left = suffix_dedup.remove_repeats(docs, carry=("lang", "source"))
    return suffix_dedup.with_kept_text(left).select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, with their ids (little-endian unsigned 32-bit)."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies), ("suffix_dedup", cut_repeats), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
