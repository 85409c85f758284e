"""Near copies of a given similarity: SimHash with multi-index hashing, bands of minima, and exact comparison.

The similarity of two texts is that of their sets of word shingles (Jaccard). Texts of one set are one node, whatever
their ids. Sets whose SimHash fingerprints are within three bits meet by multi-index hashing (see simhash). That is near
0.95 and above: fingerprints of a pair of 0.8 differ in about 10 bits, and to find 0.99 of such pairs by multi-index
hashing takes 74 segments of 28 bits with radius one, 2,146 keys a text. So the rest of the candidates come from BANDS
bands of ROWS minima of the set under hash functions, 20 keys a text: a pair of similarity s meets in a band with
probability s^ROWS, however the texts differ and however short they are, so that a pair of 0.8 meets in one at least with
0.9996, of 0.85 with 0.99999.

What meets is compared by the whole sets, block by block, and only enough links to hold each group together leave the
task. Keys with more than TILE members, or BLOCK shingles, are split into tiles, so that no task gets more than two. Each
tile is compared in itself; then every member with one of each large part that is linked by then, which suffices for
large families; and only the keys that are in parts after that have all pairs of their tiles compared. Bands with the
same members are compared once.

Null texts count as empty, and all texts without words are copies of each other; repeated rows are copies; an empty
table gives an empty one; other columns are ignored, whatever their names. A very long text's shingles, 8 bytes for each
word, are in one task's memory. 64-bit hashes stand for shingles, sets and texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, join_counted, partitions, unused
from .graph import components
from .hashing import mixed

BANDS, ROWS = 20, 5
TILE = 4096
#: Of a key of several tiles, parts of at least this part of the key have a centre each.
CENTRES = 64
#: Shingles that a tile and that a task's call compare, about.
BLOCK, BUCKET = 1 << 19, 1 << 21
STREAMS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted hashes of the different shingles of k words; of all words together where they are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(x) + 1 for x in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[s:e], 42) for s, e in zip(starts, ends[k - 1 :].tolist())), np.uint64, len(starts)))


def band_keys(h: np.ndarray) -> np.ndarray:
    """One key for each band of minima."""
    low = np.full(len(STREAMS), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(h), 1024):
        low = np.minimum(low, mixed(h[at : at + 1024] ^ STREAMS[:, None]).min(1))
    low = low.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + low[:, r])
    return key.view(np.int64)


def _simhash(h: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes, as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def _print(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63)


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _own(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key, node (a hash of the set), size of the set, its SimHash (fp) and keys for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_buffer().to_pybytes(), words) for x in b.column("text").cast(pa.binary())]
            cols = [pa.array([_print(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array([_simhash(h) for h in sets], pa.int64()), pa.array([band_keys(h) for h in sets], pa.list_(pa.int64()))]
            yield pa.record_batch([b.column("doc_id"), b.column("text_key"), *cols], ["doc_id", "text_key", "node", "size", "fp", "keys"])

    return _own(docs).mapInArrow(run, "doc_id long, text_key long, node long, size long, fp long, keys array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """node and set (its hashes as bytes) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_buffer().to_pybytes(), words) for x in b.column("text").cast(pa.binary())]
            yield pa.record_batch([pa.array([_print(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], ["node", "set"])

    return docs.select("text").mapInArrow(run, "node long, set binary")


#: In groups of more than so many sets, those that are linked leave the arrays.
FEW = 32


def _near_in_group(ids: np.ndarray, sizes: np.ndarray, mark: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Enough pairs of near copies to hold together those of a group; ids are those of each set after the other's."""
    place = np.arange(len(sizes))
    left = np.ones(len(sizes), bool)
    ends = np.cumsum(sizes)
    own = [ids[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
    size, starts = sizes, ends - sizes
    while left.any():
        todo = [int(np.flatnonzero(left)[0])]
        left[todo[0]] = False
        while todo and left.any():
            if len(place) > FEW and 2 * left.sum() < len(place):
                place = np.flatnonzero(left)
                ids, size = np.concatenate([own[p] for p in place.tolist()]), sizes[place]
                starts = np.cumsum(size) - size
            i = todo.pop()
            mark[own[i]] = True
            both = np.add.reduceat(mark[ids], starts, dtype=np.int64)
            mark[own[i]] = False
            near = place[left[place] & (both >= similarity * (size + sizes[i] - both) - 1e-9)].tolist()
            left[near] = False
            todo += near
            yield from ((i, j) for j in near)


def _forest(similarity: float):
    """Links that hold together the near copies under some key of a bucket, without those that close rings."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "i", "j", "node"], kind="stable")
        node = frame["node"].to_numpy()
        whole = frame[["key", "i", "j"]].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], (whole[1:] != whole[:-1]).any(1))))
        sizes = np.array([len(x) // 8 for x in frame["set"]], np.int64)
        ids = np.unique(np.frombuffer(b"".join(frame["set"]), np.uint64), return_inverse=True)[1].astype(np.int32)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        mark = np.zeros(len(ids), bool)
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        links = []
        for s, e in zip(first.tolist(), [*first[1:].tolist(), len(node)]):
            for a, b in _near_in_group(ids[ends[s] : ends[e]], sizes[s:e], mark, similarity):
                x, y = int(node[s + a]), int(node[s + b])
                rx, ry = root(x), root(y)
                if rx != ry:
                    up[max(rx, ry)] = min(rx, ry)
                    links.append((x, y))
        return pd.DataFrame(links, columns=["u", "v"])

    return run


def _links(docs: DataFrame, nodes: DataFrame, members: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links among the members (key, i, j, node, size) of each key and tiles. Only texts that met another are looked at
    again."""
    met = members.select("node").distinct().join(nodes.select("node", "low.*"), "node").select(F.col("id").alias("met_id"), F.col("text").alias("met_text"))
    again = _own(docs).join(met, F.col("doc_id").eqNullSafe(F.col("met_id")) & (F.col("text_key") == F.col("met_text")), "left_semi")
    sets = _sets(again, words).groupBy("node").agg(F.first("set").alias("set"))
    total = members.agg(F.sum("size")).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-total // BUCKET))
    bucket = F.pmod(F.xxhash64("key", "i", "j"), F.lit(buckets)).alias("bucket")
    met_sets = members.join(sets, "node").select(bucket, "key", "i", "j", "node", "set")
    return cut(met_sets.groupBy("bucket").applyInPandas(_forest(similarity), "u long, v long"))


def _apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members of the keys that the links don't hold together yet, each with the root of its part."""
    rooted = members.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("key").agg(F.count("*").alias("n"), (F.min("root") != F.max("root")).alias("several")).filter("several").withColumn("of", F.col("n"))
    return cut(join_counted(rooted, several.drop("several"), ["key"], "n"))


def _crowded_links(docs: DataFrame, nodes: DataFrame, members: DataFrame, links: DataFrame, words: int, similarity: float) -> DataFrame:
    """links and what is needed besides to hold together the near copies among the members (key, node, size, tiles, tile)
    of keys of several tiles, each tile of which has been compared in itself.

    Most of such keys are large families, whose tiles are linked by comparing every member with one of each large part.
    Only of keys that are still in parts are all pairs of tiles compared."""
    open_ = _apart(members, links)
    if open_.isEmpty():
        return links
    parts = open_.groupBy("key", "root").agg(F.count("*").alias("n"), F.max("of").alias("of"), F.max("tiles").alias("tiles"), F.min(F.struct("node", "size")).alias("centre"))
    centres = parts.filter(F.col("n") * CENTRES >= F.col("of")).select("key", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("i"), "centre.node", "centre.size")
    star = open_.select("key", F.col("tile").alias("i"), "node", "size").unionByName(centres).distinct().withColumn("j", F.lit(-1))
    links = cut(links.unionByName(_links(docs, nodes, cut(star), words, similarity)))
    open_ = _apart(members.join(open_.select("key").distinct(), "key", "left_semi"), links)
    if open_.isEmpty():
        return links
    pairs = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).filter("tile <> other")
    pairs = cut(pairs.select("key", "node", "size", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")))
    return links.unionByName(_links(docs, nodes, pairs, words, similarity))


def _near_fingerprints(nodes: DataFrame) -> DataFrame:
    """node, size and key, one key for each two fingerprints that multi-index hashing links, with a set of each."""
    fps = cut(nodes.groupBy("fp").agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("x")))
    pairs = cut(simhash.links(fps.select("fp"))).withColumn("key", F.xxhash64("u", "v"))
    ends = pairs.select("key", F.explode(F.array("u", "v")).alias("fp"))
    met = ends.groupBy("fp").agg(F.count("*").alias("n_met"))
    return join_counted(ends, fps.select("fp", "x").join(met, "fp"), ["fp"], "n_met").select("x.node", "x.size", "key")


def _groups(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, text_key and first for each row of docs: the first is (without, id, text), whether the smallest row of
    its group has no doc_id, its doc_id and its text_key."""
    fps = cut(fingerprints(docs, words))
    low = F.min(F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("id"), F.col("text_key").alias("text")))
    nodes = cut(fps.groupBy("node").agg(low.alias("low"), F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("keys").alias("keys"), F.count("*").alias("rows")))
    table = nodes.filter("size > 0").select("node", "size", F.explode(F.array_append("keys", F.xxhash64("fp"))).alias("key")).unionByName(_near_fingerprints(nodes.filter("size > 0")))
    same = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")), F.min("node"), F.max("node")).alias("same")
    shared = table.groupBy("key").agg(same, F.sum("size").alias("total")).filter("same.n > 1")
    tiles = F.ceil(F.greatest(F.col("same.n") / TILE, F.col("total") / BLOCK)).cast("int").alias("tiles")
    shared = shared.groupBy("same", "total").agg(F.min("key").alias("key")).select("key", "same.n", tiles)
    members = join_counted(table, shared, ["key"], "n").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    members = cut(members.withColumns({"i": F.col("tile"), "j": F.col("tile")}))
    links = _links(docs, nodes, members, words, similarity)
    links = _crowded_links(docs, nodes, members.filter("tiles > 1").drop("i", "j"), links, words, similarity)
    comp = components(links)
    rooted = nodes.join(comp, "node", "left").select("node", "low", "rows", F.coalesce("root", "node").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("low").alias("first"))
    named = rooted.join(firsts, "root").select("node", "first", "rows")
    return join_counted(fps, named, ["node"], "rows").select("doc_id", "text_key", "first")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id, the smallest doc_id that can be reached over near copies, for each row of docs."""
    return _groups(docs, words, similarity).select("doc_id", F.col("first.id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near copies, that of the smallest doc_id; rows with null or repeated doc_ids
    are documents of their own, and null ones come last."""
    groups = cut(_groups(docs, words, similarity))
    first_id, first_text = unused(docs, "first_id"), unused(docs, "first_text")
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.text"))).groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    first = cut(first.select(F.col("doc_id").alias(first_id), F.col("text_key").alias(first_text), "n"))
    kept = docs.join(first.select(first_id, first_text), F.col("doc_id").eqNullSafe(F.col(first_id)) & (text_key() == F.col(first_text)), "left_semi")
    if first.filter("n > 1").isEmpty():
        return kept
    return kept.withColumn(first_text, text_key()).dropDuplicates(["doc_id", first_text]).drop(first_text)
