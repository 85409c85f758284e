"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from ..plans.lineage import checkpoint_dir, cut
from ..plans.order import running, unused

__all__ = ["WORD", "checkpoint_dir", "cut", "if_small", "join_counted", "n_bytes", "partitions", "read", "running", "texts", "unused"]

#: Java pattern of a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator works on; a null text counts as an empty one, other columns are left out."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


#: Tables of up to so many bytes are broadcast; larger ones are joined by a shuffle.
SMALL = 8 << 20
#: Keys that are dealt with apart, at most; none of the others then has more than this part of the rows.
HOT = 100_000


def _width(c: Column, kind: DataType) -> Column:
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType)):
            return F.aggregate(F.coalesce(c, F.array()), F.lit(16).cast("long"), lambda s, x: s + _width(x, kind.elementType))
        fields = len(kind.elementType.fields) if isinstance(kind.elementType, StructType) else 1
        return F.coalesce(F.size(c), F.lit(0)) * (16 * fields) + 16
    return F.lit(16)


def n_bytes(df: DataFrame) -> int:
    """About how many bytes df has."""
    widths = [_width(F.col(f"`{f.name}`"), f.dataType).cast("long") for f in df.schema.fields]
    return df.agg(F.coalesce(F.sum(sum(widths[1:], widths[0])), F.lit(0))).first()[0]


def if_small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, written out and measured, with a broadcast hint if it is small."""
    df = cut(df)
    return F.broadcast(df) if n_bytes(df) <= most else df


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """left joined with right (inner or left), whose column count, left out of the result, says how many rows of left a
    row of right meets. A small right side is broadcast. Of a larger one the rows are that meet more than 1 / HOT of all
    that meet, of which there can't be more than HOT; the others are joined by a shuffle in which no key is large."""
    right = cut(right)
    if n_bytes(right) <= SMALL:
        return left.join(F.broadcast(right.drop(count)), on, how)
    bound = right.agg(F.sum(count)).first()[0] / HOT
    hot, rest = F.broadcast(right.filter(F.col(count) > bound).drop(count)), right.filter(F.col(count) <= bound).drop(count)
    # Rows without a key meet nothing and need no shuffle.
    keyed = F.lit(True)
    for c in on:
        keyed = keyed & F.col(c).isNotNull()
    met = left.join(hot, on).unionByName(left.filter(keyed).join(hot, on, "left_anti").join(rest, on, how))
    return met.unionByName(left.filter(~keyed), allowMissingColumns=True) if how == "left" else met
