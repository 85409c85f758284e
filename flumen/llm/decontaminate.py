"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Fixed masks pick some of the tokens of a window and ignore the others. The picked tokens of every window of every
document are hashed and joined with those of the benchmark items; a hit holds however the ignored tokens were
substituted. Each different alignment of a document with an item that has a hit is then verified token by token: it
counts if some WINDOW aligned tokens in a row agree in at least SHARE of them, that is in 10 of 13. The masks are chosen
so that none is lost: whichever three of 13 tokens are substituted, some mask fits somewhere among the others. An item
of fewer tokens is found where all its tokens follow each other; its seed is its whole sequence.

Tokens are runs of other than ASCII white space, lower-cased. Items of fewer than SHORTEST tokens are said by chance and
never found; empty and null texts have no tokens; rows of null or repeated ids are looked at one by one, and reported
together under their id; repeated rows count once; without documents or items there are no overlaps; other columns are
ignored, whatever their names. A document's tokens, three numbers for each and its alignments are in one task's memory,
so a very long text needs memory of some ten times its size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, if_small, join_counted, unused

#: Each mask looks at two neighbouring tokens, at one token x after the first, and at two neighbours y after the first.
MASKS = ((2, 4), (6, 8), (3, 4))
WINDOW, SHARE, SHORTEST = 13, 0.75, 5
#: Bytes of benchmark seeds up to which they are broadcast; more are joined by a shuffle.
SEEDS = 32 << 20


def tokens(text: str) -> Column:
    return F.split(F.lower(F.btrim(F.col(text), F.lit(" \t\n\x0b\f\r"))), r"[\x20\x09-\x0D]+")


def _both(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _shifted(c: Column, by: int) -> Column:
    return F.slice(c, by + 1, F.greatest(F.size(c) - by, F.lit(0))) if by else c


def _seed_rows(table: DataFrame, key: str, lengths: list[int]) -> DataFrame:
    """key, n (its number of tokens), kind, at, seed: for each token the seeds of the windows that start there, one for
    each mask (kind 0) and one for each of some lengths (kind), over all tokens in a row.

    Arrays are shifted against each other and zipped, which is far quicker than picking elements by index. They are
    padded to the number of tokens; what overlaps a text's end has a seed that no whole window has.
    """
    rows = table.select(key, F.transform(tokens("text"), lambda w: F.xxhash64(w)).alias("r1"))
    runs = [1]  # r2, r4, ...: hashes of so many tokens in a row
    while runs[-1] < max([2, *lengths]):
        k = runs[-1]
        rows = rows.withColumn(f"r{2 * k}", F.zip_with(f"r{k}", _shifted(F.col(f"r{k}"), k), _both))
        runs.append(2 * k)
    seeds = [F.zip_with(F.zip_with("r2", _shifted(F.col("r1"), x), _both), _shifted(F.col("r2"), y), _both) for x, y in MASKS]
    for n in lengths:
        k = max(r for r in runs if r <= n)
        seeds.append(F.zip_with(f"r{k}", _shifted(F.col(f"r{k}"), n - k), _both))
    # All is computed before the arrays are dealt out, so that a row for a seed carries the key and n only. The outer
    # form, as for the inner one Spark infers a filter that computes the arrays a second time.
    rows = rows.select(key, F.size("r1").alias("n"), F.concat(*seeds).alias("seeds"))
    rows = rows.select(key, "n", F.posexplode_outer("seeds").alias("place", "seed"))
    kind = F.floor(F.col("place") / F.col("n")).cast("int")
    of = F.get(F.array(*map(F.lit, [0] * len(MASKS) + lengths)), kind) if lengths else F.lit(0)
    return rows.select(key, "n", of.alias("kind"), F.pmod("place", "n").alias("at"), "seed")


def _rows(table: DataFrame, key: str, row: str) -> DataFrame:
    """key, text and row, which tells rows of null and repeated keys apart."""
    return table.filter("text is not null").select(key, "text", F.xxhash64(key, "text").alias(row))


def _overlaps(docs: DataFrame, items: DataFrame, window: int, share: float) -> DataFrame:
    """doc_row, doc_id, item_id, n_equal, n_tokens, best, at of each alignment that counts, from tables with rows."""
    items = items.select("item_row", "item_id", tokens("text").alias("item")).filter(F.size("item") >= SHORTEST)
    items = cut(items.dropDuplicates(["item_row", "item_id"]).withColumn("text", F.array_join("item", " ")))
    lengths = sorted(r["n"] for r in items.select(F.size("item").alias("n")).filter(F.col("n") < WINDOW).distinct().collect())  # up to WINDOW numbers
    ours = _seed_rows(items, "item_row", lengths).filter(F.when(F.col("n") < WINDOW, (F.col("kind") == F.col("n")) & (F.col("at") == 0)).otherwise(F.col("kind") == 0))
    ours = if_small(ours.select("item_row", "n", F.col("at").alias("item_at"), "seed"), SEEDS)
    hits = _seed_rows(docs, "doc_row", lengths).select("doc_row", "at", "seed").join(ours, "seed")
    hits = cut(hits.select("doc_row", "item_row", "n", (F.col("at") - F.col("item_at")).alias("at")).distinct())

    # A document is split into tokens once; each alignment takes along its part of them.
    by_doc = hits.groupBy("doc_row").agg(F.collect_list(F.struct("item_row", "n", "at")).alias("hits"))
    # Always by a shuffle of the documents, once, as chance hits grow with them; a join that is a broadcast only while
    # there are few would say nothing of the disk that more documents need.
    met = docs.join(by_doc.hint("shuffle_hash"), "doc_row").select("doc_row", "doc_id", tokens("text").alias("words"), "hits")
    before = lambda at: F.greatest(-at, F.lit(0))
    part = lambda words: F.transform("hits", lambda h: F.struct(h["item_row"].alias("item_row"), h["at"].alias("at"), F.slice(words, F.greatest(h["at"], F.lit(0)) + 1, F.greatest(h["n"] - before(h["at"]), F.lit(0))).alias("part")))
    # The one-element array keeps the words from being split anew for each alignment.
    parts = F.get(F.transform(F.array("words"), part), F.lit(0))
    alone = met.select("doc_row", "doc_id", F.explode(parts).alias("x")).select("doc_row", "doc_id", "x.*")

    counted = items.join(hits.groupBy("item_row").agg(F.count("*").alias("n_hits")), "item_row").select("item_row", "item_id", "item", "n_hits")
    lined = join_counted(alone, counted, ["item_row"], "n_hits")
    equal = F.transform("item", lambda w, i: F.when((i >= before(F.col("at"))) & F.get("part", F.greatest(i - before(F.col("at")), F.lit(0))).eqNullSafe(w), 1).otherwise(0))
    lined = lined.select("doc_row", "doc_id", "item_id", "at", equal.alias("equal"))
    width = F.least(F.size("equal"), F.lit(window))
    in_window = F.transform(F.sequence(F.lit(1), F.size("equal") - width + 1), lambda i: F.aggregate(F.slice("equal", i, width), F.lit(0), lambda s, x: s + x))
    lined = lined.select("doc_row", "doc_id", "item_id", "at", F.aggregate("equal", F.lit(0), lambda s, x: s + x).alias("n_equal"), F.size("equal").alias("n_tokens"), F.array_max(in_window).alias("best"))
    return lined.filter(F.col("best") >= F.when(F.col("n_tokens") < window, F.col("n_tokens")).otherwise(math.ceil(share * window)))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_equal, n_tokens, best, at: for each document and each item it overlaps, of its alignments with
    the most equal tokens (then the first) the number of them, the item's number of tokens, the most equal tokens in a
    window, and the document's token at which the item would start.
    """
    sure = _overlaps(_rows(docs, "doc_id", "doc_row"), _rows(benchmark, "item_id", "item_row"), window, share)
    pick = F.max_by(F.struct("n_equal", "n_tokens", "best", "at"), F.struct("n_equal", "best", -F.col("at")))
    return sure.groupBy("doc_id", "item_id").agg(pick.alias("x")).select("doc_id", "item_id", *(F.col(f"x.{c}").cast("long").alias(c) for c in ("n_equal", "n_tokens", "best", "at")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that overlap an item."""
    row = unused(docs, "doc_row")
    found = _overlaps(_rows(docs, "doc_id", "doc_row"), _rows(benchmark, "item_id", "item_row"), WINDOW, SHARE).select(F.col("doc_row").alias(row)).distinct()
    return docs.join(if_small(found), F.xxhash64("doc_id", "text") == F.col(row), "left_anti").select([f"`{c}`" for c in docs.columns])
