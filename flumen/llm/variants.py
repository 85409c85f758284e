"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

An edit changes few letter counts: a replaced letter takes one from a count and adds one to another (two words of equal
length, L1 distance two), a deleted one takes one from a count (lengths L and L - 1, distance one). So words of each
length have a k-d tree over their letter counts, and a word looks for its partners in two of them: among the words of its
own length, and among those one letter shorter. It goes down both sides of a split only where the counts it may still
take and add reach over it: a box whose nearest corner needs two letters more, or two less, is pruned. Of what is left the
letters' order is verified.

Top levels of the trees are fitted on a bounded sample of the words (SAMPLE), and their leaves, of about LEAF words each,
are groups that Spark deals out: a word is in one leaf, and visits the others that its boxes reach. All words are indexed
and visit, and the deeper levels of a leaf's tree are built where the leaf is, so nothing is missed. Words of equal counts
can't be told apart by splits; many of them (BRUTE and more) are verified by looking the edited word up instead of pair
by pair. Numbers of near words and the best of each leaf are summed there before they are shuffled.

Null texts have no words, null doc_ids count as empty in the hash; repeated rows count as often as they are there; an empty
table gives an empty one; other columns are ignored. Very long texts are read in pieces that end between words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, texts

#: Words that trees are fitted on, words of a leaf that Spark deals out, and words of a leaf that are compared one by one.
SAMPLE, LEAF, BRUTE = 200_000, 8_000, 48
#: Pairs that are compared at a time, characters of a text read at a time, different words counted at a time.
PAIRS, PIECE, MANY = 1 << 20, 1 << 20, 500_000
#: One in so many words loses a letter.
SPOILT = 199
#: Letters of words: lower-case a to z, and U+00C0 to U+00FF.
LETTERS = 26 + 64


def _pieces(text: str, run: re.Pattern) -> Iterator[list[str]]:
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text) and (more := run.match(text, end - 1)):
            end = more.end()
        yield run.findall(text, at, end)
        at = end


def counted(docs: DataFrame, length: int = 6, least: int = 5) -> DataFrame:
    """word and n: words of so many letters with so many occurrences at least, after one in SPOILT lost a letter."""
    # Whole runs of fewer letters can't become long enough.
    run = re.compile(rf"[a-zÀ-ÿ]{{{length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for words in _pieces(text.as_buffer().to_pybytes().lower().decode(), run):  # bytes know no case but that of A to Z
                    for w, n in Counter(words).items():
                        h = zlib.crc32(w.encode(), start)
                        if h % SPOILT == 0:
                            i = h % len(w)
                            w = w[:i] + w[i + 1 :]
                        found[w] += n
                    if len(found) > MANY:
                        yield out()
                        found.clear()
        if found:
            yield out()

    each = texts(docs).mapInArrow(count, "word string, n long").filter(F.char_length("word") >= length)
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def letters(words: list[bytes]) -> np.ndarray:
    """How often each word (in Latin-1, all of one length) has each letter, 127 at most."""
    chars = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
    column = np.where(chars >= 0xC0, chars.astype(np.int16) - 0xC0 + 26, chars.astype(np.int16) - ord("a"))
    out = np.zeros((len(words), LETTERS), np.uint8)
    for k in range(column.shape[1]):
        at = (np.arange(len(words)), column[:, k])
        out[at] = np.minimum(out[at], 126) + 1
    return out


class Tree:
    """Splits of a k-d tree over count vectors; leaves are numbered from 0 in order."""

    def __init__(self, counts: np.ndarray, leaf: int) -> None:
        self.nodes: list[tuple[int, int, int, int]] = []  # letter, most on the left, left, right; a leaf has letter -1 and its number
        self.leaves: list[np.ndarray] = []
        self._build(counts, np.arange(len(counts)), leaf)

    def _build(self, counts: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, 0, 0, 0))
        if len(rows) > leaf:
            own = counts[rows]
            # The letter whose best split is the evenest.
            low = np.median(own, axis=0).astype(np.uint8)
            left = np.stack(((own <= low).sum(0), (own < low).sum(0)))
            uneven = np.abs(2 * left - len(rows))
            kind, letter = np.unravel_index(int(np.argmin(uneven)), uneven.shape)
            if 0 < left[kind, letter] < len(rows):
                most = int(low[letter]) - int(kind)
                side = own[:, letter] <= most
                del own
                self.nodes[me] = (int(letter), most, self._build(counts, rows[side], leaf), self._build(counts, rows[~side], leaf))
                return me
        self.nodes[me] = (-1, len(self.leaves), 0, 0)
        self.leaves.append(rows)
        return me

    def reached(self, counts: np.ndarray, rows: np.ndarray, up: bool, down: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of counts): the leaves in whose boxes a word may lie that has one letter more than the row's (if up)
        and one less (if down)."""
        free = np.full(len(rows), -1, np.int16)
        todo = [(0, rows, free if up else free - 1, free if down else free - 1)]
        while todo:
            at, rows, more, less = todo.pop()  # more, less: the letter that is taken or added on the way; -1 none yet, -2 none may be
            letter, most, left, right = self.nodes[at]
            if letter < 0:
                yield most, rows
                continue
            x = counts[rows, letter].astype(np.int16)
            for child, over, by in ((left, x > most, "less"), (right, x <= most, "more")):
                used = less if by == "less" else more
                near = (x == most + 1) if by == "less" else (x == most)
                keep = np.flatnonzero(~over | near & ((used == -1) | (used == letter)))
                if len(keep):
                    spent = np.where(over[keep], letter, used[keep]).astype(np.int16)
                    todo.append((child, rows[keep], more[keep] if by == "less" else spent, spent if by == "less" else less[keep]))


class Words:
    """Words of one length as letters, counts, and bits that differ no more than the counts do."""

    def __init__(self, words: list[str], n: np.ndarray) -> None:
        self.latin = [w.encode("latin-1") for w in words]
        self.words, self.n = np.array(words, object), n
        self.chars = np.frombuffer(b"".join(self.latin), np.uint8).reshape(len(words), -1)
        self.counts = letters(self.latin)
        first, weights = self.counts[:, :26], 1 << np.arange(26, dtype=np.uint64)
        self.plain = (first > 0) @ weights | ((first > 1) @ weights) << np.uint64(26)
        self.other = (self.counts[:, 26:] > 0) @ (np.uint64(1) << np.arange(64, dtype=np.uint64))


def _one_edit(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether a's words i become b's words j by one replaced letter or, if those are shorter, one deleted."""
    x, y = a.chars[i], b.chars[j]
    if x.shape[1] == y.shape[1]:
        return (x != y).sum(1) == 1
    same_first, same_last = np.cumprod(x[:, :-1] == y, axis=1, dtype=np.uint8).sum(1, dtype=int), np.cumprod((x[:, 1:] == y)[:, ::-1], axis=1, dtype=np.uint8).sum(1, dtype=int)
    return same_first + same_last >= y.shape[1]


def _edited(a: Words, i: int, b: Words, place: dict[bytes, int]) -> Iterator[int]:
    """The words of place, all of equal counts, that a's word i becomes by the edit that the counts ask for."""
    word = a.latin[i]
    apart = a.counts[i].astype(np.int16) - b.counts[next(iter(place.values()))]
    less, more = np.flatnonzero(apart > 0), np.flatnonzero(apart < 0)
    if len(less) != 1 or len(more) != len(word) - b.chars.shape[1] ^ 1 or np.abs(apart).sum() != len(less) + len(more):
        return
    code = lambda c: bytes([int(c) + ord("a") if c < 26 else int(c) - 26 + 0xC0])
    new = b"".join(code(c) for c in more)
    at = word.find(code(less[0]))
    seen = set()
    while at >= 0:
        j = place.get(word[:at] + new + word[at + 1 :])
        if j is not None and j not in seen:
            seen.add(j)
            yield j
        at = word.find(code(less[0]), at + 1)


def near_pairs(a: Words, b: Words, tree: Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of a's and b's words that are one edit apart; tree is b's, whose words are as long or one letter shorter."""
    same = a.chars.shape[1] == b.chars.shape[1]
    for leaf, rows in tree.reached(a.counts, np.arange(len(a.latin)), same, True):
        own = tree.leaves[leaf]
        if len(own) > BRUTE:
            place = {b.latin[j]: j for j in own.tolist()}
            met = [(i, j) for i in rows.tolist() for j in _edited(a, i, b, place)]
            if met:
                i, j = np.array(met).T
                yield i, j
            continue
        step = max(1, PAIRS // len(own))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            apart = np.bitwise_count(a.plain[part][:, None] ^ b.plain[own][None]) + np.bitwise_count(a.other[part][:, None] ^ b.other[own][None])
            i, j = np.nonzero(apart <= (2 if same else 1))
            if len(i):
                i, j = part[i], own[j]
                ok = _one_edit(a, i, b, j)
                yield i[ok], j[ok]


def _best(words: Words, at: np.ndarray, other: Words, met: np.ndarray) -> pd.DataFrame:
    """For each of words that met others: how many, and the one of largest n (ties: smallest in code points)."""
    links = pd.DataFrame({"word": words.words[at], "near": other.words[met], "near_n": other.n[met]})
    links = links.sort_values(["word", "near_n", "near"], ascending=[True, False, True])
    first = links.drop_duplicates("word")
    return first.assign(n_near=first["word"].map(links["word"].value_counts()).astype("int64"))


def _leaf(group: pd.DataFrame) -> pd.DataFrame:
    """Near words between a leaf's own words and its own and visiting ones, summed by word."""
    length = group["word"].str.len()
    own_length = length[group["own"]].iloc[0] if group["own"].any() else 0
    make = lambda g: Words(g["word"].tolist(), g["n"].to_numpy()) if len(g) else None
    own = make(group[group["own"]])
    out = [pd.DataFrame({"word": pd.Series([], dtype=object), "near": pd.Series([], dtype=object), "near_n": pd.Series([], dtype="int64"), "n_near": pd.Series([], dtype="int64")})]
    if own is not None:
        tree = Tree(own.counts, BRUTE)
        for visitors in (own, make(group[~group["own"] & (length == own_length)]), make(group[length == own_length + 1])):
            found = list(near_pairs(visitors, own, tree)) if visitors is not None else []
            if found:
                i, j = (np.concatenate(x) for x in zip(*found))
                if len(i):
                    out.append(_best(visitors, i, own, j))
                    if visitors is not own:  # which has both ways already
                        out.append(_best(own, j, visitors, i))
    return pd.concat(out)


def leaves(words: DataFrame, sample: int = SAMPLE, leaf: int = LEAF) -> dict[int, tuple[Tree, int]]:
    """For each length its tree, fitted on the sample, and the number of its first leaf. There are as many leaves as all
    the words need, as long as each has some words of the sample."""
    total = words.count()
    drawn = words.select("word", F.xxhash64("word").alias("h"))
    if total > sample:
        # So few by hash that a count of all words bounds them; then the first by hash.
        drawn = drawn.filter(F.col("h") < -(1 << 63) + int((1 << 64) * min(1.0, 1.2 * sample / total))).orderBy("h").limit(sample)
    by: dict[int, list[bytes]] = {}
    for r in drawn.collect():
        by.setdefault(len(r["word"]), []).append(r["word"].encode("latin-1"))
    out, first = {}, 0
    for length in sorted(by):
        part = min(1.0, sample / total)
        out[length] = Tree(letters(by[length]), max(8, int(leaf * part))), first
        first += len(out[length][0].leaves)
    # Lengths that the sample has no word of have few; each is one leaf.
    return out | {-1: (None, first)}


def links(words: DataFrame, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """word, n_near, near and near_n: how many near words each word with any has, and the largest of them."""
    fitted = leaves(words, sample, leaf)
    rest = fitted[-1][1]

    def of(length: int, counts: np.ndarray, up: bool, down: bool) -> Iterator[tuple[int, np.ndarray]]:
        rows = np.arange(len(counts))
        if length not in fitted:
            yield rest + length, rows
            return
        tree, first = fitted[length]
        for at, reached in tree.reached(counts, rows, up, down):
            yield first + at, reached

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_words, all_n = np.array(b.column("word").to_pylist(), object), b.column("n").to_numpy()
            length = np.array([len(w) for w in all_words])
            for k in np.unique(length).tolist():
                at = np.flatnonzero(length == k)
                counts = letters([w.encode("latin-1") for w in all_words[at]])
                home = np.zeros(len(at), np.int64)
                for leaf_, rows in of(k, counts, False, False):
                    home[rows] = leaf_
                dealt = [(home, np.arange(len(at)), True)]
                # Of two leaves of a length the one of the larger number is visited.
                dealt += [(np.full(len(r), l), r, False) for l, rows in of(k, counts, True, True) if len(r := rows[home[rows] < l])]
                dealt += [(np.full(len(rows), l), rows, False) for l, rows in of(k - 1, counts, False, True)]
                for leaf_, rows, own in dealt:
                    yield pa.record_batch([pa.array(leaf_.astype(np.int64)), pa.array(all_words[at[rows]], pa.string()), pa.array(all_n[at[rows]]), pa.array(np.full(len(rows), own))], ["leaf", "word", "n", "own"])

    dealt = words.mapInArrow(deal, "leaf long, word string, n long, own boolean")
    met = dealt.groupBy("leaf").applyInPandas(_leaf, "word string, near string, near_n long, n_near long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def grouped(docs: DataFrame, ratio: int = 5, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """word, form, root, n, n_near and form_n for each word of docs."""
    words = cut(counted(docs))
    near = words.join(links(words, sample, leaf), "word", "left")
    is_form = F.col("near_n") >= ratio * F.col("n")
    near = cut(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")))
    # Each round doubles the steps that a word has gone; n grows by the ratio at least with each, so rounds are few.
    gone = near.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        gone = cut(gone)
        ahead = gone.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        if gone.join(ahead, "root", "left_semi").isEmpty():
            break
        gone = gone.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"))
    return near.join(gone, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
