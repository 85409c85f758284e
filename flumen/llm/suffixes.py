"""Exact substring deduplication over bytes with an enhanced suffix array and its common-prefix intervals.

A string of LENGTH bytes that starts in two places has, in both, the same smallest hash among its GRAM-byte grams, at
the same offset: its anchor. So each document is cut into the ranges of starts that share an anchor, and only ranges
whose anchors hold the same gram can have strings in common. For each gram there is a suffix array of all its
occurrences: the suffixes from the anchor on, in order, with the lengths of their common prefixes. Occurrences with equal
surroundings are one entry of it, with their number.

A scan with a stack visits the intervals of the array, each a set of entries with a common prefix of some depth. The
entries of an interval are then ordered by what stands to the left of the anchor, and the intervals of that order are
visited alike: each is a set of entries with a common left part, whose left extensions are diverse. Of these sets, those
that don't agree any further to the right either are the maximal repeat groups; those whose left part and depth reach
LENGTH are reported, with every occurrence, however many lie between two of them in the array. Every byte that a
reported repeat covers is removed.

A gram with more than CROWDED different surroundings (a passage in a large part of all documents) would make an array
that one task can't hold. Its strings of LENGTH bytes are compared by hash instead, spread over all buckets; what is
removed is the same. Only there do 64-bit hashes stand for the bytes; elsewhere two hashes of 64 bits, of gram and
surroundings, must agree.

Null and empty texts have no bytes; texts shorter than LENGTH have no strings and stay; matches never cross documents;
repeated rows are repeats of each other; an empty table gives an empty one; other columns are ignored. A very long text
is worked on as a whole, in memory of some fifty times its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted
from .hashing import Spans, mixed
from .mail import Message, Texts, answer, answered, ask, ask_again, by_bucket, deal, finish, pack, unpack

LENGTH, GRAM = 200, 48
#: Starts of one string's grams: the widest range that an anchor can have.
REACH = LENGTH - GRAM + 1
CROWDED = 1_000
OWN, CLASSES, SEGMENTS, STRINGS = range(4)
REPEATED, APART, MANY = 1, 2, 4


def _sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The minimum of every k values in a row."""
    n = len(x) - k + 1
    whole = np.full(-(-len(x) // k) * k, np.iinfo(x.dtype).max, x.dtype)
    whole[: len(x)] = x
    blocks = whole.reshape(-1, k)
    after = np.minimum.accumulate(blocks, 1).ravel()
    before = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(before[:n], after[k - 1 : k - 1 + n])


class Anchors:
    """The anchors of a group: place, gram, first and last start of its range, and a hash of range and surroundings."""

    def __init__(self, texts: Texts) -> None:
        place, gram, low, high, around = [], [], [], [], []
        for a, b in texts.parts():
            base = int(texts.starts[a])
            data = texts.data[base : texts.starts[b]]
            if len(data) <= LENGTH:
                continue
            spans = Spans(data)
            grams = spans.rolling(GRAM)
            keys = grams & np.uint64(0xFFFFFFFF00000000) | np.arange(len(grams), dtype=np.uint64)
            at = (_sliding_min(keys, REACH) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            # Starts whose string lies within one document (a blank follows each).
            inside = np.zeros(len(at) + 1, np.int8)
            for s, e in zip(texts.starts[a:b] - base, texts.starts[a + 1 : b + 1] - base - 1):
                if e - s >= LENGTH:
                    inside[s] += 1
                    inside[e - LENGTH + 1] -= 1
            at = np.where(np.cumsum(inside, dtype=np.int8)[:-1] > 0, at, -1)
            change = np.flatnonzero(np.diff(at, prepend=-2) != 0)
            first, last = change, np.concatenate((change[1:], [len(at)])) - 1
            real = at[first] >= 0
            first, last = first[real], last[real]
            q = at[first]
            place.append(q + base)
            # The smallest hashes fill a small part of their space; mixed again they spread over all buckets.
            gram.append(mixed(grams[q]))
            low.append(first + base)
            high.append(last + base)
            around.append(mixed(spans(first, last + LENGTH) + (q - first).astype(np.uint64)))
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.place, self.low, self.high = (join(x, np.int64) for x in (place, low, high))
        gram, around = join(gram, np.uint64), join(around, np.uint64)
        # Classes of anchors with the same gram and surroundings, in order of gram.
        order = np.lexsort((around, gram))
        g, r = gram[order], around[order]
        new = np.ones(len(order), bool)
        new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        self.of = np.zeros(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.gram, self.around = g[new], r[new]
        self.count = np.diff(np.append(np.flatnonzero(new), len(order)))
        self.sample = order[new]


def _ask_classes(buckets: int):
    def question(grp: int, texts: Texts) -> list[Message]:
        a = Anchors(texts)
        return [(b, CLASSES, pack(a.gram[s], a.around[s], np.packbits(a.count[s] > 1))) for b, s in by_bucket(a.gram, buckets)]

    return question


def _classes_of(gram: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """In order of gram and surroundings: the order, and for each place in it the number of its class and of its gram,
    and whether it is the first of its class."""
    order = np.lexsort((around, gram))
    g, r = gram[order], around[order]
    new_gram = np.diff(g, prepend=g[:1] + np.uint64(1)) != 0
    new = new_gram | (np.diff(r, prepend=r[:1] + np.uint64(1)) != 0)
    return order, np.cumsum(new) - 1, np.cumsum(new_gram) - 1, new


def _read_classes(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    read = [unpack(p) for p in payloads]
    sizes = [len(x[0]) for x in read]
    twice = np.concatenate([np.unpackbits(x[2], count=n) for x, n in zip(read, sizes)]).astype(np.int64)
    return np.concatenate([x[0] for x in read]), np.concatenate([x[1] for x in read]), twice, sizes


def _answer_classes(messages: list[Message]) -> list[Message]:
    """For each class: is it repeated, are there other classes of its gram to compare with, are there many."""
    gram, around, twice, sizes = _read_classes([p for *_, p in messages])
    order, of_class, of_gram, new = _classes_of(gram, around)
    repeated = np.bincount(of_class, 1 + twice[order])[of_class] > 1
    classes = np.bincount(of_gram[new])[of_gram]
    # One group sends a class to the array of its gram, if there are others; alone it is an array of one entry, and
    # whether it is repeated says all.
    code = repeated * REPEATED + ((classes > 1) & new) * APART + ((classes > CROWDED) & new) * MANY
    codes = np.zeros(len(order), np.uint8)
    codes[order] = code
    return [(grp, CLASSES, pack(c)) for (grp, _, _), c in zip(messages, np.split(codes, np.cumsum(sizes)[:-1]))]


def _merge(kind: int, payloads: list[bytes]) -> bytes:
    """One message of the different classes or strings in several."""
    if kind == CLASSES:
        gram, around, twice, _ = _read_classes(payloads)
        order, of_class, _, new = _classes_of(gram, around)
        return pack(gram[order][new], around[order][new], np.packbits(np.bincount(of_class, 1 + twice[order]) > 1))
    read = [unpack(p) for p in payloads]
    hashes, to = np.unique(np.concatenate([h for h, _ in read]), return_inverse=True)
    twice = np.concatenate([np.unpackbits(b, count=len(h)) for h, b in read])
    return pack(hashes, np.packbits(np.bincount(to, 1.0 + twice) > 1))


def _share(kind: int, payload: bytes, payloads: list[bytes]) -> list[bytes]:
    """The answer to a merged message, for each of those it was merged from. A class is asked for from the first of them
    only, as from one of all."""
    if kind == CLASSES:
        gram, around, _, sizes = _read_classes(payloads)
        order, of_class, _, new = _classes_of(gram, around)
        codes = np.zeros(len(order), np.uint8)
        codes[order] = np.where(new, 255, REPEATED).astype(np.uint8) & unpack(payload)[0][of_class]
        return [pack(c) for c in np.split(codes, np.cumsum(sizes)[:-1])]
    own = [unpack(p)[0] for p in payloads]
    _, to = np.unique(np.concatenate(own), return_inverse=True)
    bits, n = unpack(payload)
    repeated = np.unpackbits(bits, count=int(n[0])).astype(bool)[to]
    return [pack(np.packbits(r), np.array([len(r)], np.uint32)) for r in np.split(repeated, np.cumsum([len(h) for h in own])[:-1])]


def _strings(texts: Texts, a: Anchors, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All strings of LENGTH bytes in the ranges of some classes' samples: hash and start."""
    hashes, starts = [], []
    for i in a.sample[which].tolist():
        low, high = int(a.low[i]), int(a.high[i])
        hashes.append(Spans(texts.data[low : high + LENGTH]).rolling(LENGTH))
        starts.append(np.arange(low, high + 1))
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _ask_segments(buckets: int):
    def question(grp: int, texts: Texts, answers: pa.Table) -> list[Message]:
        a = Anchors(texts)
        codes = [x[0] for x in answered(answers, CLASSES)]
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint8)
        out = [(grp % buckets, OWN, pack(code))]
        send = np.flatnonzero((code & APART > 0) & (code & MANY == 0))
        i = a.sample[send]
        for b, s in by_bucket(a.gram[send], buckets):
            own = i[s]
            text = np.concatenate([texts.data[x : y + LENGTH] for x, y in zip(a.low[own].tolist(), a.high[own].tolist())])
            out.append((b, SEGMENTS, pack(a.gram[send][s], a.around[send][s], (a.place[own] - a.low[own]).astype(np.uint8), (a.high[own] - a.low[own]).astype(np.uint8), text)))
        hashes, _ = _strings(texts, a, np.flatnonzero(code & MANY > 0))
        hashes, n = np.unique(hashes, return_counts=True)
        return out + [(b, STRINGS, pack(hashes[s], np.packbits(n[s] > 1))) for b, s in by_bucket(hashes, buckets)]

    return question


def intervals(depths: list[int]) -> Iterator[tuple[int, int, int]]:
    """The intervals of common prefixes of a suffix array: depth, first and last suffix. depths[i] is the length of the
    common prefix of suffixes i and i + 1. A stack holds the open intervals, the deepest on top."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*depths, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def _common(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows."""
    differ = a != b
    return np.minimum(np.where(differ.any(1), differ.argmax(1), a.shape[1]), np.minimum(len_a, len_b))


def repeat_groups(grams: np.ndarray, right: np.ndarray, n_right: np.ndarray, left: np.ndarray, n_left: np.ndarray, least: int = LENGTH) -> Iterator[tuple[int, int, np.ndarray]]:
    """Maximal repeat groups of the same grams, of least bytes: how far they reach to the left of the anchor and from the
    anchor on, and the members (indices). right and left hold, row by row, the bytes from the anchor on and those before
    it (nearest first), zeros after their lengths."""
    as_text = lambda x: np.ascontiguousarray(x).view(f"S{x.shape[1]}").ravel()
    by_left = np.lexsort((n_left, as_text(left)))  # a shorter part before those it begins
    left_rank = np.empty(len(by_left), np.int64)
    left_rank[by_left] = np.arange(len(by_left))
    order = np.lexsort((n_right, as_text(right), grams))
    depth = _common(right[order[:-1]], right[order[1:]], n_right[order[:-1]], n_right[order[1:]])
    bounds = [0, *(np.flatnonzero(np.diff(grams[order])) + 1).tolist(), len(order)]
    depth_list = depth.tolist()
    found: list[tuple[int, int, int]] = []
    for s, e in zip(bounds, bounds[1:]):
        found += [(d, s + i, s + j + 1) for d, i, j in intervals(depth_list[s : e - 1])]
    if not found:
        return
    # The members of all intervals, each interval's in the order of their left parts, and what neighbours share there.
    sizes = np.array([e - s for _, s, e in found])
    ends = np.cumsum(sizes)
    place = np.concatenate([np.arange(s, e) for _, s, e in found])
    place = place[np.lexsort((left_rank[order[place]], np.repeat(np.arange(len(found)), sizes)))]
    shared = np.full(len(place), -1, np.int64)
    for at in range(0, len(place) - 1, 1 << 17):
        x, y = order[place[at : at + (1 << 17)]], order[place[at + 1 : at + 1 + (1 << 17)]]
        shared[at : at + len(y)] = _common(left[x[: len(y)]], left[y], n_left[x[: len(y)]], n_left[y])
    shared[ends - 1] = -1
    reach = shared + np.repeat([d for d, _, _ in found], sizes) >= least
    some = np.add.reduceat(reach, ends - sizes)
    for k in np.flatnonzero(some).tolist():
        d, at = found[k][0], int(ends[k] - sizes[k])
        # Only neighbours that share enough; between them the order by left parts falls into pieces.
        enough = np.flatnonzero(reach[at : ends[k]])
        for piece in np.split(enough, np.flatnonzero(np.diff(enough) > 1) + 1):
            first = at + int(piece[0])
            for common, i, j in intervals(shared[first : first + len(piece)].tolist()):
                members = place[first + i : first + j + 1]
                # They agree further to the right if they lie within one deeper interval, which has them as well.
                if depth[members.min() : members.max()].min() == d:
                    yield common, d, order[members]


def _groups(segments: list[list[np.ndarray]]) -> list[tuple[int, int, np.ndarray]]:
    """The repeat groups of what some groups of documents sent to a bucket; members count through all of it."""
    grams, before, wide, text = (np.concatenate([x[i] for x in segments]) for i in (0, 2, 3, 4))
    before, wide = before.astype(np.int64), wide.astype(np.int64)
    start = np.cumsum(wide + LENGTH) - wide - LENGTH
    n_right = wide + LENGTH - before
    right = np.zeros((len(grams), LENGTH), np.uint8)
    left = np.zeros((len(grams), REACH), np.uint8)
    for at in range(0, len(grams), 1 << 15):
        s = slice(at, at + (1 << 15))
        i = np.arange(LENGTH)
        right[s] = np.where(i < n_right[s, None], text[np.minimum((start + before)[s, None] + i, len(text) - 1)], 0)
        i = np.arange(REACH)
        left[s] = np.where(i < before[s, None], text[np.maximum((start + before)[s, None] - 1 - i, 0)], 0)
    return list(repeat_groups(grams, right, n_right, left, before))


def _answer_segments(messages: list[Message]) -> list[Message]:
    out = [(g, k, p) for g, k, p in messages if k == OWN]
    segments = [(g, unpack(p)) for g, k, p in messages if k == SEGMENTS]
    if segments:
        found = _groups([x for _, x in segments])
        n = [len(members) for _, _, members in found]
        of = np.concatenate([members for _, _, members in found]) if found else np.zeros(0, np.int64)
        low, high = (np.repeat(np.array([x[i] for x in found], np.int64), n) for i in (0, 1))
        order = np.argsort(of, kind="stable")
        of, low, high = of[order], low[order], high[order]
        at = 0
        for g, (own, *_) in segments:
            s, e = np.searchsorted(of, (at, at + len(own)))
            out.append((g, SEGMENTS, pack((of[s:e] - at).astype(np.uint32), low[s:e].astype(np.uint8), high[s:e].astype(np.uint8), np.array([len(own)], np.uint32))))
            at += len(own)
    strings = [(g, *unpack(p)) for g, k, p in messages if k == STRINGS]
    if strings:
        hashes = np.concatenate([x[1] for x in strings])
        twice = np.concatenate([np.unpackbits(x[2], count=len(x[1])) for x in strings]).astype(np.int64)
        _, to = np.unique(hashes, return_inverse=True)
        repeated, at = np.bincount(to, 1 + twice)[to] > 1, 0
        for g, own, _ in strings:
            out.append((g, STRINGS, pack(np.packbits(repeated[at : at + len(own)]), np.array([len(own)], np.uint32))))
            at += len(own)
    return out


def _remove(texts: Texts, answers: pa.Table) -> pa.Table:
    a = Anchors(texts)
    own = answered(answers, OWN)
    code = own[0][0] if own else np.zeros(0, np.uint8)
    edge = np.zeros(len(texts.data) + 1, np.int64)
    # Whole ranges of repeated classes, at each of their places.
    whole = (code[a.of] & REPEATED > 0) if len(code) else np.zeros(0, bool)
    np.add.at(edge, a.low[whole], 1)
    np.subtract.at(edge, a.high[whole] + LENGTH, 1)
    # What the suffix arrays found beyond that. A repeated class is removed as a whole; another one has one place.
    send = a.sample[np.flatnonzero((code & APART > 0) & (code & MANY == 0))] if len(code) else np.zeros(0, np.int64)
    at = 0
    for of, low, high, n in answered(answers, SEGMENTS):
        place = a.place[send[at + of.astype(np.int64)]]
        np.add.at(edge, place - low.astype(np.int64), 1)
        np.subtract.at(edge, place + high.astype(np.int64), 1)
        at += int(n[0])
    hashes, starts = _strings(texts, a, np.flatnonzero(code & MANY > 0))
    if len(hashes):
        _, to = np.unique(hashes, return_inverse=True)
        bits = np.concatenate([np.unpackbits(b, count=int(n[0])) for b, n in answered(answers, STRINGS)]).astype(bool)
        starts = starts[bits[to]]
        np.add.at(edge, starts, 1)
        np.subtract.at(edge, starts + LENGTH, 1)
    gone = np.cumsum(edge)[:-1] > 0
    n_removed, n_spans, spans, kept = [], [], [], []
    for raw, s in zip(texts.raw, texts.starts.tolist()):
        g = gone[s : s + len(raw)]
        n_removed.append(int(g.sum()))
        spans.append(np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0)))
        n_spans.append(len(spans[-1]) // 2)
        kept.append(np.frombuffer(raw, np.uint8)[~g].tobytes() if n_removed[-1] else raw)
    ends = np.concatenate([np.zeros(0, np.int64), *spans])
    pairs = pa.StructArray.from_arrays([pa.array(ends[::2]), pa.array(ends[1::2])], ["start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_spans))), pa.int32()), pairs)
    counts = {"n_bytes": [len(x) for x in texts.raw], "n_removed": n_removed, "n_spans": n_spans}
    return pa.table({"doc_id": texts.ids, **{k: pa.array(v, pa.int64()) for k, v in counts.items()}, "kept": pa.array(kept, pa.binary()), "spans": lists})


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that remain) and spans (what was removed, as byte offsets of
    the text) for each row of docs."""
    dealt, groups, buckets = deal(docs)
    classes = answer(ask(dealt, _ask_classes(buckets)), groups, _answer_classes, _merge, _share, (CLASSES,))
    found = answer(ask_again(dealt, classes, _ask_segments(buckets)), groups, _answer_segments, _merge, _share, (STRINGS,))
    return finish(dealt, found, _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start: long, end: long>>")


def _class_groups(key: tuple, table: pa.Table) -> pa.Table:
    """gram, around, repeat_id, low, high of each member of the repeat groups of a bucket."""
    payloads = sorted((g, p) for g, k, p in zip(*(table.column(c).to_pylist() for c in ("grp", "kind", "payload"))) if k == SEGMENTS)
    segments = [unpack(p) for _, p in payloads]
    found = _groups(segments) if segments else []
    n = [len(members) for _, _, members in found]
    of = np.concatenate([members for _, _, members in found]) if found else np.zeros(0, np.int64)
    gram, around = (np.concatenate([x[i] for x in segments])[of] if segments else np.zeros(0, np.uint64) for i in (0, 1))
    ids = np.array([key[0].as_py() << 32 | i for i in range(len(found))], np.int64)
    columns = (gram.view(np.int64), around.view(np.int64), np.repeat(ids, n), *(np.repeat(np.array([x[i] for x in found], np.int32), n) for i in (0, 1)))
    return pa.table(dict(zip(("gram", "around", "repeat_id", "low", "high"), map(pa.array, columns))))


def _occurrences(key: tuple, table: pa.Table) -> pa.Table:
    """gram, around, doc_id, place (of the anchor in its document), before and after (how far its range reaches)."""
    texts = Texts(table)
    a = Anchors(texts)
    doc = np.searchsorted(texts.starts, a.place, "right") - 1
    columns = (a.gram[a.of].view(np.int64), a.around[a.of].view(np.int64), a.place - texts.starts[doc], a.place - a.low, a.high + LENGTH - a.place)
    return pa.table({**dict(zip(("gram", "around", "place", "before", "after"), map(pa.array, columns))), "doc_id": texts.ids.take(pa.array(doc))})


def repeats(docs: DataFrame) -> DataFrame:
    """repeat_id, doc_id, start and n_bytes of every occurrence of every maximal repeat group of LENGTH bytes and more.
    Groups are maximal within the surroundings of their anchor, that is up to 2 * LENGTH - GRAM bytes; a longer repeat
    comes as a chain of groups. Grams with more than CROWDED surroundings have the groups of equal surroundings only."""
    dealt, n_groups, buckets = deal(docs)
    classes = answer(ask(dealt, _ask_classes(buckets)), n_groups, _answer_classes, _merge, _share, (CLASSES,))
    groups = ask_again(dealt, classes, _ask_segments(buckets)).groupBy("bucket").applyInArrow(_class_groups, "gram long, around long, repeat_id long, low int, high int")
    found = cut(dealt.groupBy("grp").applyInArrow(_occurrences, "gram long, around long, place long, before long, after long, doc_id long"))
    counts = cut(found.groupBy("gram", "around").agg(F.count("*").alias("n"), F.first("before").alias("low"), F.first("after").alias("high")))
    own = counts.filter("n > 1").withColumn("repeat_id", F.xxhash64("gram", "around"))
    every = own.unionByName(groups.join(counts.select("gram", "around", "n"), ["gram", "around"]), allowMissingColumns=True)
    met = join_counted(found, every, ["gram", "around"], "n")
    return met.select("repeat_id", "doc_id", (F.col("place") - F.col("low")).alias("start"), (F.col("low") + F.col("high")).cast("long").alias("n_bytes")).distinct()
