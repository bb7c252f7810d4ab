"""Exact duplicates by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.shared import SPACE, broadcast_if_small, text_or_empty
from tidemark.sources.workspace import through_table

#: A surviving group is a long and a flag; so many of them are at most some 40 MB when broadcast.
MOST_BROADCAST_GROUPS = 1_000_000
#: Bits of a filter: it is broadcast as at most 2^20 words of 64 bits, whatever the input's size.
FILTER_BITS = 26


def _filtered(rows: DataFrame, key: Column, wanted: DataFrame, flag: str) -> DataFrame:
    """``rows`` with ``flag``: false only if ``key`` is not among ``wanted`` (one column of longs).

    The filter is a bit array of fixed size, one bit for the hash of each wanted value. It may
    let others pass, more of them the fuller it is, so what passes is a superset.
    """
    slot = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - FILTER_BITS)
    bit = F.expr("shiftleft(1L, CAST(_slot % 64 AS INT))")
    bits = wanted.select(slot(F.col(wanted.columns[0])).alias("_slot"))
    bits = bits.groupBy(F.shiftright("_slot", 6).alias("_at")).agg(F.bit_or(bit).alias("_bits"))
    bits = F.broadcast(through_table(bits, "dedup-filter"))
    slotted = rows.withColumn("_slot", slot(key)).withColumn("_at", F.shiftright("_slot", 6))
    passes = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return slotted.join(bits, "_at", "left").withColumn(flag, passes).drop("_slot", "_at", "_bits")


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 64,
    digest_all: bool = False,
) -> DataFrame:
    """Group documents whose texts agree after each run of white space became one blank.

    Rows are grouped by normalised length, those of lengths that occur twice by a hash of the
    first ``prefix_chars`` characters, and only rows of the groups that are left get a SHA-256
    of the full text. Each level is told to the next pass over the texts by a filter of fixed
    size, so texts are never shuffled, at any size: a fuller filter only makes more rows be
    hashed, and which of them survived is then settled on hashes.

    Returns one row per input row: ``id_col``, ``keep_id`` (the smallest id of the group),
    ``group_size``, ``kept`` and ``text_sha256`` (null where the text is unique by length or
    prefix, unless ``digest_all``). A null text counts as empty; a very long one is normalised
    and hashed whole within its row. Rows that repeat an id with the same text are one document
    and share its decision. A null id is never preferred; a group of null ids only stays whole.
    An empty table gives no rows; other columns are not looked at. Ids may be structs, which
    are compared field by field.
    """
    text = F.regexp_replace(text_or_empty(text_col), f"{SPACE}+", " ")
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_length", F.length("_text").cast("long"))

    lengths = base.groupBy("_length").agg(F.count("*").alias("_n")).where("_n > 1").select("_length")
    lengths = through_table(lengths, "dedup-lengths")

    group = F.xxhash64("_length", F.xxhash64(F.substring("_text", 1, prefix_chars)))
    grouped = _filtered(base, F.col("_length"), lengths, "_near").where("_near").select(group.alias("_group"))
    groups = grouped.groupBy("_group").agg(F.count("*").alias("_rows")).where("_rows > 1").select("_group")
    groups = through_table(groups, "dedup-groups")

    passed = _filtered(base.withColumn("_group", group), F.col("_group"), groups, "_near")
    wanted = F.lit(True) if digest_all else F.col("_near")
    hashed = passed.select("_id", "_near", "_group", F.when(wanted, F.sha2("_text", 256)).alias("_full"))
    hashed = through_table(hashed, "dedup-hashes")

    small, _ = broadcast_if_small(groups, MOST_BROADCAST_GROUPS)
    near = hashed.where("_near").join(small.withColumn("_survives", F.lit(True)), "_group", "left")
    copies = (
        near.where("_survives")
        .groupBy("_full")
        .agg(F.min("_id").alias("_keep"), F.count("*").alias("_n"))
        .where("_n > 1")
    )
    copies = through_table(copies, "dedup-copies")
    one = F.lit(1).cast("long").alias("_n")
    shown = F.col("_full") if digest_all else F.lit(None).cast("string")
    alone = hashed.where("NOT _near").unionByName(near.where("_survives IS NULL").drop("_survives")).select(
        "_id", shown.alias("_full"), F.col("_id").alias("_keep"), one
    )
    together = (
        near.where("_survives")
        .join(copies, "_full", "left")
        .select(
            "_id", "_full",
            F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("_keep"),
            F.coalesce("_n", F.lit(1)).cast("long").alias("_n"),
        )
    )
    return alone.unionByName(together).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_full").alias("text_sha256"),
    )
