"""A corpus pipeline: five stages over documents, each one operator, each written as Parquet and read again.

language (rejected documents go), near_copies (one document of each group stays), decontamination (documents that
overlap a benchmark item go), pseudonyms (personal data in texts is replaced), mixing (copies of each document, by
target weights of the sources). All stages but the last return the columns of documents; the last returns those of
documents of which the mix takes a copy at least, and how many copies and words it takes (instead of columns of these
names).

Null texts count as empty and go with the first stage, as they have no language; rows of null or repeated doc_ids are
judged one by one by their texts; repeated rows are near copies; empty tables pass through; other columns stay, whatever
their names; the length of texts isn't bounded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flumen.llm import decontaminate, language, mixing, near, pii
from flumen.llm.common import checkpoint_dir, cut, read, unused


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs)


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.one_of_each(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def _pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(docs).withColumn("n_chars", F.length("text").cast("long"))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Rows of null or repeated doc_ids are documents of their own; rows that are alike in all columns are one another's
    # equals, and as many of them stay as are taken.
    docs = docs.drop("copies", "taken")
    # Spark hashes no maps, so columns that hold any are hashed as text.
    whole = lambda c, kind: F.to_json(F.struct(f"`{c}`")) if "map<" in kind or "variant" in kind else F.col(f"`{c}`")
    row, taken_row = F.xxhash64(*(whole(c, kind) for c, kind in docs.dtypes)), unused(docs, "taken_row")
    taken = mixing.mix(docs.withColumn("doc_id", row)).filter("copies > 0").select(F.col("doc_id").alias(taken_row), "copies", "taken")
    taken = cut(taken)
    if not taken.groupBy(taken_row).count().filter("count > 1").isEmpty():
        kept = unused(docs, "kept_row")
        docs = docs.withColumn(kept, row).dropDuplicates([kept])
        return docs.join(taken, F.col(kept) == F.col(taken_row)).drop(kept, taken_row)
    return docs.join(taken, row == F.col(taken_row)).drop(taken_row)


STAGES = [("language", _language), ("near_copies", _near_copies), ("decontamination", _decontamination), ("pseudonyms", _pseudonyms), ("mixing", _mixing)]

#: No stage can be expressed in SQL alone: trained models, fingerprints and keyed hashes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, with their results in the shared checkpoint folder. A stage's result goes once
    the next one is written; the last stays, as it is what is returned."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        before = path
    return docs
