"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits. Two fingerprints that differ in at most three bits differ in at most one bit in one of
their 32-bit halves, so each half is looked up with its Hamming ball of radius one (33 keys) in a table of exact
halves, and only what the table returns is compared in full.

Equal fingerprints are one node of the link graph. Where many different fingerprints share a half (a large family of
near copies), their pairs would grow with the square of the family; such a half is searched through the ball centres
of its other half instead, whose number is linear in the family and which links exactly the same fingerprints.

Null texts count as empty; a text without words has fingerprint zero and links like any other; repeated doc_ids give
one row for each input row; an empty table gives an empty one; other columns are ignored. A very long text is hashed as
a whole, its bits counted in slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, texts
from .graph import components

#: Shingle hashes held as bits at a time, for very long texts.
SLICE = 1 << 16


def fingerprint(text: bytes, words: int, seed: int = 42) -> int:
    """The SimHash of one text as an unsigned number: a bit is set if it is set in over half the shingle hashes."""
    w = text.lower().split()
    if not w:
        return 0
    line, k = b" ".join(w), min(words, len(w))
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(w) - k + 1].tolist()
    h = np.fromiter((xxhash.xxh64_intdigest(line[s:e], seed) for s, e in zip(starts, ends[k - 1 :].tolist())), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), SLICE):
        part = h[i : i + SLICE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_buffer().to_pybytes(), words) for x in b.column("text").cast(pa.binary())], np.uint64)
            yield pa.record_batch([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def _half(fp: str | Column, t: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if t else F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF))


def _ball(half: Column, radius: int) -> Column:
    """All 32-bit values within the radius (0, 1 or 2) of a half."""
    bits = [1 << i for i in range(32)]
    masks = [0] + bits * (radius >= 1) + [a | b for i, a in enumerate(bits) for b in bits[:i]] * (radius >= 2)
    return F.transform(F.array(*map(F.lit, map(int, masks))).cast("array<long>"), lambda m: half.bitwiseXOR(m))


#: A half shared by more different fingerprints than this is searched through ball centres.
CROWDED = 256


def _crowded_links(nodes: DataFrame, crowded: DataFrame) -> DataFrame:
    """Links through crowded halves. Rows grow with the number of fingerprints, not of their pairs.

    With equal halves, two other halves are within three bits if and only if some value lies within one bit of the
    one and two bits of the other. With halves one bit apart, they must be within two bits, so some value lies within
    one bit of both. Everything that meets at such a value is linked to the smallest fingerprint next to it.
    """
    halves = nodes.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("t"))
    halves = halves.select("fp", "t", F.when(F.col("t") == 1, _half("fp", 1)).otherwise(_half("fp", 0)).alias("half"), F.when(F.col("t") == 1, _half("fp", 0)).otherwise(_half("fp", 1)).alias("rest"))
    members = halves.join(crowded, ["t", "half"])
    same = members.select("t", "half", F.lit(0).cast("long").alias("step"), "fp", "rest", F.explode(_ball(F.col("rest"), 2)).alias("z"))
    steps = F.array(*(F.lit(1 << i).cast("long") for i in range(32)))
    ours = members.select("t", "half", F.explode(steps).alias("step"), "fp", "rest")
    theirs = halves.select("t", "fp", "rest", F.explode(steps).alias("step"), "half")
    theirs = theirs.withColumn("half", F.col("half").bitwiseXOR(F.col("step"))).join(crowded, ["t", "half"]).select("t", "half", "step", "fp", "rest")
    apart = ours.unionByName(theirs).withColumn("z", F.explode(_ball(F.col("rest"), 1)))
    met = same.unionByName(apart).withColumn("near", F.bit_count(F.col("rest").bitwiseXOR(F.col("z"))) <= 1)
    key = ["t", "half", "step", "z"]
    centre = met.filter("near").groupBy(*key).agg(F.min("fp").alias("v"), F.count("*").alias("n"))
    return met.join(centre, key).filter("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) between different fingerprints (a column fp, all distinct) that connect all within three bits."""
    table = nodes.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("t"), _half("fp", 0).alias("half")), F.struct(F.lit(1).alias("t"), _half("fp", 1).alias("half")))).alias("x")).select("fp", "x.*")
    crowded = cut(table.groupBy("t", "half").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED).select("t", "half"))
    # Of two halves one bit apart, the one with the bit unset finds the other.
    masks = F.array(*(F.lit(m).cast("long") for m in [0, *(1 << i for i in range(32))]))
    probes = table.select(F.col("fp").alias("u"), "t", F.explode(F.filter(masks, lambda m: F.col("half").bitwiseAND(m) == 0)).alias("m"), "half")
    probes = probes.select("u", "t", F.col("half").bitwiseOR(F.col("m")).alias("half"), (F.col("m") == 0).alias("same"))
    any_crowded = not crowded.isEmpty()
    rows = table.join(crowded, ["t", "half"], "left_anti") if any_crowded else table
    found = probes.join(rows.withColumnRenamed("fp", "v"), ["t", "half"])
    found = found.filter((~F.col("same") | (F.col("u") < F.col("v"))) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 3)).select("u", "v")
    return found.unionByName(_crowded_links(nodes, crowded)) if any_crowded else found


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links of at most three bits."""
    fps = cut(fingerprints(docs, words))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    comp = components(links(nodes.select("fp")))
    roots = nodes.join(comp, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first", "n")
    low = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(low, "root").select("fp", "component_id", "n")
    return join_counted(fps, named, ["fp"], "n").select("doc_id", "fp", "component_id")


def hexed(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
