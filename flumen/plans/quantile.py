"""Exact order statistics of groups of any size, without a group in one buffer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.validity import finite
from .lineage import cut

#: Values of a group that are sorted in one buffer, and ranges that a group is cut into in each round.
MOST, RANGES = 10_000, 256


def _with(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the state of their key; a small state is broadcast, so that a key with very many rows stays spread out."""
    state = F.broadcast(state) if state.limit(100_001).count() <= 100_000 else state
    return rows.join(state, keys) if keys else rows.crossJoin(state)  # a row for each rank


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """state (keys, rank, low, high, below, n: the value of this rank lies between low and high, without them, and below
    values aren't over low) after a round: either value is known, or the range is a few RANGES-th of what it was."""
    by = [*keys, "rank"]
    # Ranks that share a range share its sketch and counts: rows are looked at once for each range, not for each rank.
    within = [*keys, "low", "high"]
    inside = lambda s, of: _with(rows, s.select(*of).distinct(), keys).filter((F.col("_v") > F.col("low")) & (F.col("_v") < F.col("high"))).groupBy(*of)
    marks = F.array(*(F.lit(i / RANGES) for i in range(RANGES + 1)))
    edges = inside(state, within).agg(F.percentile_approx("_v", marks, F.lit(40 * RANGES)).alias("_e"))
    at = F.floor((F.col("rank") - F.col("below")) / F.greatest(F.col("n") - 1, F.lit(1)) * RANGES).cast("int")
    edge = lambda i: F.get("_e", F.greatest(F.lit(0), F.least(F.lit(RANGES), i)))
    state = cut(state.join(edges, within).withColumns({"_l": edge(at - 1), "_h": edge(at + 2)}).drop("_e"))
    v, low, high = F.col("_v"), F.col("_l"), F.col("_h")
    # Counts decide, not the sketch: a rank that lies elsewhere keeps the range on that side.
    parts = [*within, "_l", "_h"]
    counts = inside(state, parts).agg(*(F.count_if(c).alias(n) for n, c in {"_a": v < low, "_b": v <= low, "_c": v < high, "_d": v <= high}.items()))
    r = F.col("rank") - F.col("below")
    place = F.when(r < F.col("_a"), 0).when(r < F.col("_b"), 1).when(r < F.col("_c"), 2).when(r < F.col("_d"), 3).otherwise(4)
    now = state.join(counts, parts).withColumn("_p", place)
    pick = lambda *of: F.element_at(F.array(*of), F.col("_p") + 1)
    none = F.lit(None).cast("double")
    return cut(now.select(
        *by, pick(F.col("low"), low, low, high, high).alias("low"), pick(low, low, high, high, F.col("high")).alias("high"),
        (F.col("below") + pick(F.lit(0), F.col("_a"), F.col("_b"), F.col("_c"), F.col("_d"))).alias("below"),
        pick(F.col("_a"), F.col("_b") - F.col("_a"), F.col("_c") - F.col("_b"), F.col("_d") - F.col("_c"), F.col("n") - F.col("_d")).alias("n"), pick(none, low, none, high, none).alias("value"),
    ))


def quantiles(table: DataFrame, keys: list[str], value: str | Column, at: list[float], name: str = "q", most: int = MOST) -> DataFrame:
    """keys and an array: the values at the given parts (0 to 1) of each group's finite values, linearly between ranks, as
    `percentile` has them. A group of up to `most` values is sorted at once. Of larger ones the range of each wanted rank
    is narrowed in rounds, by a sketch whose choice exact counts correct, until it has that few values; a value that very
    many rows share is found as the end of a range, not collected."""
    # Written out, as it is read at least twice and may be dear to make.
    rows = cut(table.select(*keys, (F.col(value) if isinstance(value, str) else value).cast("double").alias("_v")).filter(finite(F.col("_v"))))
    sizes = cut(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).filter("n > 0"))
    large = sizes.filter(F.col("n") > most)
    if large.isEmpty():
        return rows.groupBy(*keys).agg(F.percentile("_v", [float(p) for p in at]).alias(name))
    small = _with(rows, sizes.filter(F.col("n") <= most).select(*keys), keys).groupBy(*keys).agg(F.percentile("_v", [float(p) for p in at]).alias(name)) if keys else None
    # Ends first, so that ranges can be open.
    ends = _with(rows, large, keys).groupBy(*keys).agg(F.count_if(F.col("_v") == F.col("low")).alias("_first"), F.count_if(F.col("_v") == F.col("high")).alias("_last"))
    large = large.join(ends, keys) if keys else large.crossJoin(F.broadcast(ends))  # a row each
    place = [(F.col("n") - 1) * F.lit(float(p)) for p in at]
    wanted = F.explode(F.array_distinct(F.flatten(F.array(*(F.array(F.floor(x).cast("long"), F.ceil(x).cast("long")) for x in place))))).alias("rank")
    start = large.select(*keys, "low", "high", "n", "_first", "_last", wanted)
    known = F.when(F.col("rank") < F.col("_first"), F.col("low")).when(F.col("rank") >= F.col("n") - F.col("_last"), F.col("high"))
    state = cut(start.select(*keys, "rank", "low", "high", F.col("_first").alias("below"), (F.col("n") - F.col("_first") - F.col("_last")).alias("n"), known.alias("value")))
    found = []
    while True:
        found.append(state.filter("value is not null").select(*keys, "rank", "value"))
        found.append(state.filter((F.col("value").isNull()) & (F.col("n") <= most)))
        state = state.filter(F.col("value").isNull() & (F.col("n") > most)).drop("value")
        if state.isEmpty():
            break
        state = _narrowed(rows, state, keys)
    done, rest = found[0], found[1]
    for a, b in zip(found[2::2], found[3::2]):
        done, rest = done.unionByName(a), rest.unionByName(b)
    few_left = _with(rows, rest.drop("value"), keys).filter((F.col("_v") > F.col("low")) & (F.col("_v") < F.col("high")))
    sorted_ = few_left.groupBy(*keys, "rank").agg(F.sort_array(F.collect_list("_v")).alias("_s"), F.first("below").alias("below"))
    done = done.unionByName(sorted_.select(*keys, "rank", F.get("_s", (F.col("rank") - F.col("below")).cast("int")).alias("value")))
    ranks = done.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_m"))
    both = large.join(ranks, keys) if keys else large.crossJoin(F.broadcast(ranks))
    of = lambda x: F.element_at("_m", x.cast("long"))
    between = [of(F.floor(x)) + (of(F.ceil(x)) - of(F.floor(x))) * (x - F.floor(x)) for x in place]
    out = both.select(*keys, F.array(*between).alias(name))
    return out.unionByName(small) if small is not None else out


def with_quantiles(groups: DataFrame, table: DataFrame, keys: list[str], value: str | Column, at: list[float], name: str = "q") -> DataFrame:
    """groups (a row for each key) with the quantiles of table; null for a key without finite values."""
    found = quantiles(table, keys, value, at, name)
    return groups.join(found, keys, "left") if keys else groups.crossJoin(found)
