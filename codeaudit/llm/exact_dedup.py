"""Exact deduplication whose hot groups are combined in three steps.

Texts are equal when they are identical after lower-casing A-Z; a null text
counts as empty.  Of equal texts the row with the largest doc_id stays.

1. Digests that occur more than once are found by a count that is combined in
   every task first.  Rows with any other digest have no twin and never move.
2. The texts of the remaining rows are deduplicated inside each task, then per
   salt, then over the salts.  All three steps group by digest *and* text, so a
   digest collision never joins two texts.
3. Rows find their winner by digest; where one digest has several texts, by the
   text as well.

Defined results: rows with a null doc_id sort below all others, so they stay
only in a group without any id.  Rows repeated with the same doc_id count one
by one in `group_size`, and exactly one of them is `kept`.  An empty table gives
an empty result.  Other columns are carried inside a struct, so their names
cannot clash with those made here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit.llm.common import SALTS, ascii_lower, join_checked, stored


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def dedup_groups(docs: DataFrame, salts: int = SALTS, carry: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (and `row` with all columns)."""
    text = normalised(docs["text"])
    rows = docs.select(
        docs["doc_id"], text.alias("norm"), F.sha2(text.cast("binary"), 256).alias("text_sha256"),
        *([F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if carry else []))
    kept_columns = ["row"] if carry else []

    digests = rows.groupBy("text_sha256").agg(F.count("*").alias("n")).filter("n > 1").select(
        "text_sha256", F.lit(True).alias("twin"))
    flagged = join_checked(rows, stored(digests), ["text_sha256"], "left")
    single = flagged.filter("twin IS NULL").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256", *kept_columns)

    # The tag tells repeated rows of one doc_id apart; stored, so that it is drawn once.
    twins = stored(flagged.filter("twin").select(
        "doc_id", "norm", "text_sha256", F.monotonically_increasing_id().alias("tag"), *kept_columns))
    largest = F.max(F.struct("doc_id", "tag")).alias("best")
    by_salt = (twins.withColumn("salt", F.pmod("tag", F.lit(salts)))
               .groupBy("text_sha256", "norm", "salt").agg(largest, F.count("*").alias("n")))
    winners = stored(by_salt.groupBy("text_sha256", "norm").agg(
        F.max("best").alias("best"), F.sum("n").alias("group_size")))

    clash = winners.groupBy("text_sha256").agg(F.count("*").alias("n")).filter("n > 1")
    keys = ["text_sha256"] if clash.isEmpty() else ["text_sha256", "norm"]
    side = winners.select(*keys, F.col("best.doc_id").alias("keep_id"), F.col("best.tag").alias("keep_tag"), "group_size")
    members = twins.select("doc_id", "tag", *keys, *kept_columns)
    grouped = join_checked(members, side, keys).select(
        "doc_id", "keep_id", "group_size", (F.col("tag") == F.col("keep_tag")).alias("kept"), "text_sha256", *kept_columns)
    return single.unionByName(grouped)


def drop_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    return dedup_groups(docs, salts, carry=True).filter("kept").select("row.*")
