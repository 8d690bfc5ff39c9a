"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after each run of the six ASCII white-space characters becomes one space.

1. All rows: the normalised length in bytes; lengths that occur once are settled.
2. Rows of shared lengths: a 64-bit hash of the first ``prefix`` characters; pairs (length, hash) that occur once are settled.
3. Only for rows of the surviving pairs is the whole content hashed (SHA-256) and grouped.

Each stage reads the texts where they lie and moves a few integers a row, pre-aggregated before the shuffle, so a text that makes up a third of the
table is one row a task there. The lengths and pairs that a stage leaves are attached to the next scan by a broadcast whose row count has been
checked, or else by a shuffled join. The groups of stage 3 are joined back to rows by ``store.join_keyed``: hot groups, whose number is bounded, are
broadcast, and no other group has more than a small share of the rows.

Defined cases: a null text counts as empty; a null id is larger than all others; of rows with equal text and equal id
exactly one is kept; an empty table gives an empty result; columns not named in ``carry`` are ignored, so clashing
names do no harm. Python is used nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import HOT_KEYS, join_bounded, join_keyed, written

BROADCAST_ROWS = 500_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), prefix: int = 128, broadcast_rows: int = BROADCAST_ROWS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, n_bytes, prefix_hash and full_hash (null where a
    stage before settled the row), then the columns named in ``carry``."""
    base = docs.select(
        F.col(id_col).alias("__id"), F.monotonically_increasing_id().alias("__row"), normalised(F.col(text_col)).alias("__norm"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)]
    )
    sized = base.withColumn("__len", F.octet_length("__norm").cast("long"))
    lengths = sized.groupBy("__len").agg(F.count("*").alias("__n")).where("__n > 1").select("__len", F.lit(True).alias("__shared"))
    lengths = written(lengths, "exact-lengths")
    signed = join_bounded(sized, lengths, "__len", "left", lengths.count(), broadcast_rows)
    signed = signed.withColumn("__pre", F.when(F.col("__shared"), F.xxhash64(F.substring("__norm", 1, prefix))))
    survivors = signed.where("__shared").groupBy("__len", "__pre").agg(F.count("*").alias("__n")).where("__n > 1").select("__len", "__pre", F.lit(True).alias("__s"))
    survivors = written(survivors, "exact-survivors")
    flagged = join_bounded(signed, survivors, ["__len", "__pre"], "left", survivors.count(), broadcast_rows)
    full = F.when(F.col("__s"), F.sha2("__norm", 256))
    rows = flagged.select("__id", "__row", "__len", "__pre", full.alias("__full"), *[f"__c{i}" for i in range(len(carry))])
    rows = written(rows, "exact-rows")
    order = F.struct(F.col("__id").isNull().alias("absent"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    hashed = rows.where("__full IS NOT NULL")
    groups = written(hashed.groupBy("__full").agg(F.min(order).alias("__first"), F.count("*").alias("__size")), "exact-groups")
    total = groups.agg(F.sum("__size")).first()[0] or 0
    carried = [F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)]
    read = [F.col("__len").alias("n_bytes"), F.col("__pre").alias("prefix_hash"), F.col("__full").alias("full_hash"), *carried]
    settled = rows.where("__full IS NULL").select(F.col("__id").alias("doc_id"), F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *read)
    grouped = join_keyed(hashed, groups, ["__full"], "__size", total, hot_keys).select(
        F.col("__id").alias("doc_id"), F.col("__first.id").alias("keep_id"), F.col("__size").alias("group_size"), (F.col("__row") == F.col("__first.row")).alias("kept"), *read
    )
    return settled.unionByName(grouped)
