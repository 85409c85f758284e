"""Exact duplicates by a tree-merge of sorted digest runs, in DataFrame functions only.

Texts are equal when they are identical after lower-casing A to Z and nothing else. Every partition makes a run of its
texts' digests, sorted, with equal ones folded to one entry: how many rows there are and which of them stays. Then
FAN partitions at a time exchange their runs, which are merged and folded again, and so on in rounds (log2(FAN) binomial
ones at once) until one block is left: a digest never has more entries in a merge than FAN, however many rows share it.
Entries of equal 64-bit digests are folded only if all 256 bits and the lengths agree as well, at every level.

The order in which identifiers are compared is a parameter: the smallest stays, or the largest. Null texts count as empty;
null doc_ids come before all others; of rows that are alike in doc_id and text exactly one stays; an empty table gives an
empty one; other columns are ignored. Of a text only its digest is kept, so its length doesn't matter.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, texts

#: Runs that are merged at a time.
FAN = 16


def normalised(text: Column) -> Column:
    """text with A to Z in lower case and all else as it is."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def runs(docs: DataFrame, largest: bool) -> DataFrame:
    """A row for each of docs, written out: doc_id, digest (64 bits), sha and length of its text, block (its partition)
    and what orders it: the largest rank stays, and row decides between rows of one doc_id."""
    rows = texts(docs).select("doc_id", normalised(F.col("text")).alias("text"))
    sha = F.unhex(F.sha2("text", 256))
    rows = rows.select("doc_id", sha.alias("sha"), F.octet_length("text").cast("long").alias("length"), F.spark_partition_id().cast("long").alias("block"), F.monotonically_increasing_id().alias("row"))
    rank = F.col("doc_id") if largest else -F.col("doc_id")
    return cut(rows.withColumn("digest", F.xxhash64("sha")).withColumn("best", F.struct(rank.alias("rank"), "row", "doc_id")))


def merged(level: DataFrame) -> DataFrame:
    """One entry for each block and text. The maximum of a struct has Spark sort each run, fold it, exchange it, and merge
    the sorted runs that a task gets."""
    return level.groupBy("block", "digest", "sha", "length").agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def groups(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """digest, sha, length, best and n: one row for each different text of runs()."""
    blocks = 1 + rows.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    level = rows.withColumn("n", F.lit(1).cast("long"))
    while True:
        # What partition a row is from says nothing of its text, so the first level needs no round of its own.
        blocks = -(-blocks // fan)
        level = merged(level.withColumn("block", F.floor(F.col("block") / fan).cast("long")))
        if blocks == 1:
            return level.drop("block")


def duplicates(docs: DataFrame, largest: bool = True, fan: int = FAN) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of docs."""
    rows = runs(docs, largest)
    found = groups(rows, fan).select("digest", "sha", "length", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("n").alias("group_size"), "n")
    met = join_counted(rows.select("doc_id", "digest", "sha", "length", "row"), found, ["digest", "sha", "length"], "n")
    return met.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
