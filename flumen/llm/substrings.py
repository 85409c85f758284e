"""Substring deduplication with fixed-block anchors.

A passage of WINDOW words that starts in two documents holds, in the one, a whole block of BLOCK words that begins at a
multiple of BLOCK (any 2 * BLOCK - 1 words in a row do), and the same words at some place of the other. So the blocks
of all documents are indexed, not overlapping, and probed with every rolling window of BLOCK words. Where a probe hits a
block of another document, it is extended: of the windows of WINDOW words around the hit, hashes of their whole word
sequences tell in which document, and where in it, each starts first; windows that follow each other both here and there
are one maximal exact repeat, however long. The words of repeats that start in an earlier document are removed.

Blocks are compared by 32 bits of their hash within a bucket of the hash space, which lets a few false hits through;
windows by 64 bits, whose chance of one false match among n windows is about n^2 / 2^65.

Words are runs of other than ASCII white space, unchanged. Null and empty texts have no words. Of rows with one doc_id
none counts as earlier than the other; a null doc_id counts as earlier than all others. An empty table gives an empty
one; other columns are ignored. A very long text is worked on as a whole, in memory of some fifty times its size.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .hashing import Spans
from .mail import NULL_ID, Message, Texts, answer, answered, ask, ask_again, bucket_of, by_bucket, deal, finish, pack, unpack

WINDOW, BLOCK = 13, 7
BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
OWN, ASKED = 0, 1


class Words:
    """Hashes of the words of a group, its rolling windows and blocks."""

    def __init__(self, texts: Texts) -> None:
        hashes, docs = [], []
        for a, b in texts.parts():
            data = texts.data[texts.starts[a] : texts.starts[b]]
            blank = BLANK[data]
            edge = np.flatnonzero(np.diff(blank, prepend=True))
            starts, ends = edge[::2], edge[1::2]
            hashes.append(Spans(data)(starts, ends))
            docs.append(np.searchsorted(texts.starts[a : b + 1] - texts.starts[a], starts, "right") - 1 + a)
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.doc, np.arange(len(texts.raw) + 1))
        self.rank = texts.rank[self.doc] if len(words) else np.zeros(0, np.int64)
        spans = Spans(words)
        self.probe, self.window = spans.rolling(BLOCK), spans.rolling(WINDOW)

    def inside(self, k: int) -> np.ndarray:
        """Whether k words from each on are of one document."""
        n = len(self.doc) - k + 1
        return self.doc[:n] == self.doc[k - 1 :] if n > 0 else np.zeros(0, bool)

    def keys(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where probes start, their keys (bucket, then the lower half of the hash), and which are blocks."""
        at = np.flatnonzero(self.inside(BLOCK))
        h = self.probe[at]
        key = bucket_of(h, buckets).astype(np.uint64) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
        return at, key, (at - self.first[self.doc[at]]) % BLOCK == 0


def _ask_blocks(buckets: int):
    def question(grp: int, texts: Texts) -> list[Message]:
        _, key, block = Words(texts).keys(buckets)
        asked, out = np.unique(key), []
        has = np.zeros(len(asked), np.uint8)
        has[np.searchsorted(asked, key[block])] = 1
        of = (asked >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(of)]):
            out.append((int(of[s]), ASKED, _packed(asked[s:e].astype(np.uint32), has[s:e])))
        return out

    return question


def _packed(low: np.ndarray, groups: np.ndarray) -> bytes:
    """Sorted keys, and how many groups (0, 1, more) have each as a block."""
    return pack(np.diff(low, prepend=np.uint32(0)), np.packbits(groups > 0), np.packbits(groups > 1))


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, one, more = unpack(payload)
    return np.cumsum(steps, dtype=np.uint32), np.unpackbits(one, count=len(steps)) + np.unpackbits(more, count=len(steps))


def _all_groups(read: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys of several messages, how many groups have each, and which of them each key asked for is."""
    keys, to = np.unique(np.concatenate([low for low, _ in read]), return_inverse=True)
    return keys, np.minimum(np.bincount(to, np.concatenate([n for _, n in read])), 2).astype(np.uint8), to


def _replies(n: np.ndarray, sizes: list[int]) -> list[bytes]:
    """For each message how many groups have a block, key by key."""
    return [pack(np.packbits(x > 0), np.packbits(x > 1), np.array([len(x)], np.uint32)) for x in np.split(n, np.cumsum(sizes)[:-1])]


def _answer_blocks(messages: list[Message]) -> list[Message]:
    """How many groups (0, 1, more) have each probe as a block."""
    read = [_unpacked(p) for *_, p in messages]
    _, n, to = _all_groups(read)
    return [(grp, ASKED, p) for (grp, _, _), p in zip(messages, _replies(n[to], [len(low) for low, _ in read]))]


def _merge_blocks(kind: int, payloads: list[bytes]) -> bytes:
    keys, n, _ = _all_groups([_unpacked(p) for p in payloads])
    return _packed(keys, n)


def _share_blocks(kind: int, payload: bytes, payloads: list[bytes]) -> list[bytes]:
    read = [_unpacked(p) for p in payloads]
    one, more, n = unpack(payload)
    found = np.unpackbits(one, count=int(n[0])) + np.unpackbits(more, count=int(n[0]))
    return _replies(found[_all_groups(read)[2]], [len(low) for low, _ in read])


def _bits(answers: pa.Table, kind: int, which: int = 0) -> np.ndarray:
    parts = [np.unpackbits(x[which], count=int(x[-1][0])).astype(bool) for x in answered(answers, kind)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _candidates(words: Words, buckets: int, answers: pa.Table) -> np.ndarray:
    """Whether a window starts at each word that has a hit in it: in another group's block or another document's here."""
    at, key, block = words.keys(buckets)
    asked, to = np.unique(key, return_inverse=True)
    mine_too = np.zeros(len(asked), np.uint8)
    mine_too[to[block]] = 1
    groups = _bits(answers, ASKED).astype(np.uint8) + _bits(answers, ASKED, 1)
    hit = (groups > mine_too)[to] if len(key) else np.zeros(0, bool)
    own, doc = to[block], words.rank[at[block]]
    low, high = np.full(len(asked), np.iinfo(np.int64).max), np.full(len(asked), np.iinfo(np.int64).min)
    np.minimum.at(low, own, doc)
    np.maximum.at(high, own, doc)
    mine = words.rank[at]
    hit |= (low[to] <= high[to]) & ((low[to] != mine) | (high[to] != mine))
    sums = np.zeros(len(words.doc) + 1, np.int64)
    sums[at[hit] + 1] = 1
    sums = np.cumsum(sums)
    inside = words.inside(WINDOW)
    n, reach = len(inside), WINDOW - BLOCK + 1
    return inside & (sums[reach : reach + n] > sums[:n])


def _earliest(words: Words, candidate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The candidates' places, their different hashes, which each has, and for each hash the first document here that has
    it and the word at which it starts there."""
    at = np.flatnonzero(candidate)
    hashes, to = np.unique(words.window[at], return_inverse=True)
    place = at - words.first[words.doc[at]]
    order = np.lexsort((place, words.rank[at], to))
    first = order[np.flatnonzero(np.diff(to[order], prepend=-1))]
    return at, hashes, to, words.rank[at][first], place[first]


def _ask_windows(buckets: int):
    def question(grp: int, texts: Texts, answers: pa.Table) -> list[Message]:
        words = Words(texts)
        candidate = _candidates(words, buckets, answers)
        _, hashes, _, first, place = _earliest(words, candidate)
        own = (grp % buckets, OWN, pack(np.packbits(candidate), np.array([len(candidate)], np.uint32)))
        return [own, *((b, ASKED, pack(hashes[s], first[s], place[s])) for b, s in by_bucket(hashes, buckets))]

    return question


def _all_windows(read: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different windows of several messages, the first document and word of each, and which of them each is."""
    hashes, to = np.unique(np.concatenate([x[0] for x in read]), return_inverse=True)
    ranks, places = (np.concatenate([x[i] for x in read]) for i in (1, 2))
    order = np.lexsort((places, ranks, to))
    first = order[np.flatnonzero(np.diff(to[order], prepend=-1))]
    return hashes, ranks[first], places[first], to


def _earlier(read: list[list[np.ndarray]], rank: np.ndarray, place: np.ndarray) -> list[bytes]:
    """For each message a bit for each window, whether it starts in an earlier document than any of its own, and of those
    that do the first document and word."""
    out, at = [], 0
    for h, own, _ in read:
        s = slice(at, at + len(h))
        earlier = rank[s] < own
        out.append(pack(np.packbits(earlier), rank[s][earlier], place[s][earlier], np.array([len(h)], np.uint32)))
        at += len(h)
    return out


def _answer_windows(messages: list[Message]) -> list[Message]:
    out = [(g, k, p) for g, k, p in messages if k == OWN]
    asked = [(g, unpack(p)) for g, k, p in messages if k == ASKED]
    if asked:
        read = [x for _, x in asked]
        _, rank, place, to = _all_windows(read)
        out += [(g, ASKED, p) for (g, _), p in zip(asked, _earlier(read, rank[to], place[to]))]
    return out


def _merge_windows(kind: int, payloads: list[bytes]) -> bytes:
    return pack(*_all_windows([unpack(p) for p in payloads])[:3])


def _share_windows(kind: int, payload: bytes, payloads: list[bytes]) -> list[bytes]:
    read = [unpack(p) for p in payloads]
    _, rank, place, to = _all_windows(read)
    bits, ranks, places, n = unpack(payload)
    earlier = np.unpackbits(bits, count=int(n[0])).astype(bool)
    rank[earlier], place[earlier] = ranks, places
    return _earlier(read, rank[to], place[to])


def _extended(words: Words, at: np.ndarray, rank: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal exact repeats: windows that follow each other here and in the same earlier document are one. Document
    (its row here), first word, number of words, the earlier document's rank and the first word there."""
    doc = words.doc[at]
    goes_on = np.zeros(len(at), bool)
    goes_on[1:] = (np.diff(at) == 1) & (np.diff(doc) == 0) & (np.diff(rank) == 0) & (np.diff(place) == 1)
    first = np.flatnonzero(~goes_on)
    length = np.diff(np.append(first, len(at))) + WINDOW - 1
    return doc[first], at[first] - words.first[doc[first]], length, rank[first], place[first]


def _remove(texts: Texts, answers: pa.Table) -> pa.Table:
    words = Words(texts)
    candidate = _bits(answers, OWN)
    at, hashes, to, rank, place = _earliest(words, candidate)
    parts = answered(answers, ASKED)
    earlier = _bits(answers, ASKED) if parts else np.zeros(len(hashes), bool)
    rank, place = rank.copy(), place.copy()
    if parts:
        rank[earlier], place[earlier] = (np.concatenate([x[i] for x in parts]) for i in (1, 2))
    of, of_place = rank[to], place[to]
    again = of < words.rank[at]
    repeated = at[again]
    doc, start, length, others, other_start = _extended(words, repeated, of[again], of_place[again])
    cover = np.zeros(len(words.doc) + 1, np.int64)
    cover[repeated] += 1
    np.subtract.at(cover, repeated + WINDOW, 1)
    removed = np.cumsum(cover)[:-1] > 0
    n_words, n_removed, kept = [], [], []
    for i, raw in enumerate(texts.raw):
        gone = removed[words.first[i] : words.first[i + 1]]
        own = raw.split()
        n_words.append(len(own))
        n_removed.append(int(gone.sum()))
        kept.append(b" ".join(compress(own, ~gone) if n_removed[-1] else own))
    others = pa.array(others, pa.int64(), mask=others == NULL_ID)
    repeats = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(length, pa.int64()), others, pa.array(other_start, pa.int64())], ["start", "n_words", "of", "of_start"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(texts.raw) + 1)), pa.int32()), repeats)
    return pa.table({"doc_id": texts.ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "text": pa.array(kept, pa.binary()).cast(pa.string()), "repeats": lists})


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, text (the words kept, joined by blanks) and repeats for each row of docs: the maximal
    exact repeats that were removed, each with its first word, its number of words, and the first document and word
    where it starts. They may overlap."""
    dealt, groups, buckets = deal(docs)
    blocks = answer(ask(dealt, _ask_blocks(buckets)), groups, _answer_blocks, _merge_blocks, _share_blocks, (ASKED,))
    windows = answer(ask_again(dealt, blocks, _ask_windows(buckets)), groups, _answer_windows, _merge_windows, _share_windows, (ASKED,))
    return finish(dealt, windows, _remove, "doc_id long, n_words long, n_removed long, text string, repeats array<struct<start: long, n_words: long, of: long, of_start: long>>")
