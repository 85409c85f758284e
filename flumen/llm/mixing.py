"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every source gets a target number of words: its weight's share of all words, at most max_copies times its own, the
excess reshared by weight among the others. A source's documents then all start with the same fractional number of
copies. The whole part is taken outright; the fractions are rounded together: two documents meet, words move at random
from one to the other (the expectation of both stays) until one of them is at none or all of its words, and the other
goes on. Sums are kept exactly, so at the end one document of a source at most is still open, and a last draw settles
it. Documents meet in blocks of about FAN; what a block leaves open goes on to the next level, where FAN blocks meet: a
reduction tree over hashed blocks, whatever share of the rows one source has.

Draws are hashes of seed, doc_ids, sizes and numbers, so reruns agree. Null texts have no words and are never taken;
documents of null source form one source, the last; rows of null and repeated doc_ids are rounded one by one, in blocks
like any others; an empty table gives an empty one; other columns are ignored. Of a text only its number of words is
kept, so its length doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, join_counted, running

WEIGHTS = (5.0, 2.0, 1.0)
FAN = 64
#: Rows that are alike are dealt out in runs of so many.
RUN = 100_000


def sizes(docs: DataFrame) -> DataFrame:
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", words.alias("size"), "source")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: float = 3.0) -> DataFrame:
    """source, source_size, n (documents with words), target: one row for each source."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    by = running(by, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    by = by.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int")))
    by = by.withColumn("cap", max_copies * F.col("source_size"))
    total, weight = by.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    # Sources reach their caps in the order of cap by weight; the level at which the rest share what is left comes
    # from running sums in that order.
    by = running(by, [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()], {"caps": F.col("cap"), "weights": F.col("weight")})
    by = by.withColumn("level", (total - F.col("caps")) / (weight - F.col("weights")))
    level = by.agg(F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))).first()[0]
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight")) if level is not None else F.col("cap")
    return by.select("source", "source_size", "n", target.alias("target"))


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but its parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _settled(x: Column) -> Column:
    return (x["mass"] <= 1e-9 * x["size"]) | (x["mass"] >= (1 - 1e-9) * x["size"])


def _meet(acc: Column, x: Column, seed: int) -> Column:
    """acc: open (a struct or null) and done (an array). The next document meets the open one."""
    a = acc["open"]
    up, down = F.least(a["size"] - a["mass"], x["mass"]), F.least(a["mass"], x["size"] - x["mass"])
    moved = F.when(_draw(F.lit(seed), a["doc_id"], x["doc_id"], x["key"]) * (up + down) < down, up).otherwise(-down)
    pair = F.array(a.withField("mass", a["mass"] + moved), x.withField("mass", x["mass"] - moved))
    pair = F.when(a.isNull(), F.array(x)).otherwise(pair)
    both = F.struct(pair.alias("pair"), acc["done"].alias("done"))
    # One element, so that the pair is computed once however often it is named.
    return F.get(
        F.transform(
            F.array(both),
            lambda b: F.struct(F.get(F.filter(b["pair"], lambda y: ~_settled(y)), F.lit(0)).alias("open"), F.concat(b["done"], F.filter(b["pair"], _settled)).alias("done")),
        ),
        F.lit(0),
    )


ITEM = "struct<key:bigint,doc_id:bigint,size:bigint,mass:double>"


def _round(level: DataFrame, seed: int) -> DataFrame:
    """s (the source), block, what it leaves open, what is done; level has s, block and item."""
    start = F.struct(F.lit(None).cast(ITEM).alias("open"), F.array().cast(f"array<{ITEM}>").alias("done"))
    items = F.array_sort(F.collect_list("item"))
    folded = level.groupBy("s", "block").agg(items.alias("items")).withColumn("r", F.aggregate("items", start, lambda acc, x: _meet(acc, x, seed)))
    return folded.select("s", "block", "r.open", "r.done")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: float = 3.0, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken for each document."""
    # Rows that are alike in all that counts are counted, and dealt out again with a number each.
    alike = cut(sizes(docs).groupBy("source", "doc_id", "size").agg(F.count("*").alias("n_alike")))
    sized = alike.select("source", "doc_id", "size", "n_alike", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_alike") - 1) / RUN))).alias("run"))
    last = F.least(F.col("n_alike") - F.col("run") * RUN, F.lit(RUN)) - 1
    sized = sized.select("source", "doc_id", "size", F.explode(F.sequence(F.col("run") * RUN, F.col("run") * RUN + last)).alias("number"))
    dims = targets(sized, weights, max_copies).withColumn("rate", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))).withColumn("whole", F.floor("rate").cast("long")).withColumn("part", F.col("rate") - F.col("whole"))
    dims = cut(dims.withColumn("s", F.coalesce(F.xxhash64("source"), F.lit(0))).withColumn("rows", F.col("n")))
    most = dims.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    with_rate = join_counted(sized.withColumn("s", F.coalesce(F.xxhash64("source"), F.lit(0))), dims.drop("source"), ["s"], "rows")

    is_open = (F.col("size") > 0) & (F.col("part") > 0)
    key = F.xxhash64(F.lit(seed), "doc_id", "size", "number")
    item = F.struct(key.alias("key"), "doc_id", "size", (F.col("size") * F.col("part")).alias("mass"))
    block = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size", "number"), F.ceil(F.col("n") / FAN).cast("long"))
    level = with_rate.filter(is_open).select("s", block.alias("block"), item.alias("item"))
    done = []
    while True:
        rounded = cut(_round(level, seed))
        done.append(rounded.select("s", F.explode("done").alias("item")))
        left = rounded.filter("open is not null")
        if most <= FAN:
            break
        most = -(-most // FAN)
        level = left.select("s", F.floor(F.col("block") / FAN).alias("block"), F.col("open").alias("item"))
    last = F.col("open").withField("mass", F.when(_draw(F.lit(seed + 2), F.col("open.doc_id")) * F.col("open.size") < F.col("open.mass"), F.col("open.size").cast("double")).otherwise(0.0))
    done.append(left.select("s", last.alias("item")))
    rounded = done[0]
    for more in done[1:]:
        rounded = rounded.unionByName(more)
    extra = (F.col("item.mass") * 2 > F.col("item.size")).cast("long").alias("extra")
    rounded = join_counted(rounded.select("s", "item.doc_id", "item.size", extra), dims.drop("source"), ["s"], "rows")
    rest = with_rate.filter(~is_open).withColumn("extra", F.lit(0).cast("long"))
    cols = ["doc_id", "size", "source_size", "target", "whole", "extra"]
    out = rounded.select(*cols).unionByName(rest.select(*cols))
    copies = F.col("whole") + F.col("extra")
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
