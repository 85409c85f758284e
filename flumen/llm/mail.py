"""Questions and answers between groups of documents and buckets of hashes.

Documents are dealt into groups of bounded size by a hash of doc_id and text. A group asks about all its hashes at once: sorted,
without repeats, one packed message for each bucket of the hash space. A bucket sees the messages of all groups side by
side and answers each of them. As a group names a hash once however often it has it, a hash that a third of all rows
share costs a bucket one entry for each group; where groups are many, runs of them are merged on the way, so that no task
gets more than FAN messages.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Bytes of text in a group and in a bucket's share, about.
GROUP_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
MAIL = "grp int, bucket int, kind int, payload binary"
#: Rank of a null doc_id: before all others.
NULL_ID = np.iinfo(np.int64).min


def deal(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """doc_id, text and grp for each row (a null text counts as empty), the number of groups, and that of buckets for
    their hashes."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    least = partitions(docs.sparkSession)
    groups, buckets = max(least, -(-total // GROUP_BYTES)), max(least, -(-total // BUCKET_BYTES))
    grp = F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("grp")
    return docs.select(grp, "doc_id", F.coalesce("text", F.lit("")).alias("text")), groups, buckets


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, those of equal significance side by side, which compresses better."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        out += [struct.pack("<3sQ", a.dtype.str.encode(), len(a)), a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    at, out = 0, []
    while at < len(data):
        code, n = struct.unpack_from("<3sQ", data, at)
        dtype = np.dtype(code.decode())
        at += 11
        flat = np.frombuffer(data, np.uint8, n * dtype.itemsize, at)
        out.append(flat.reshape(dtype.itemsize, n).T.copy().view(dtype).reshape(n) if n else np.zeros(0, dtype))
        at += n * dtype.itemsize
    return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets follow the order of the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The part of a sorted array of hashes that belongs to each bucket."""
    of = bucket_of(hashes, buckets)
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(of)]):
        yield int(of[s]), slice(s, e)


def mail(grp: int, rows: list[tuple[int, int, bytes]]) -> pa.Table:
    """rows: bucket, kind and payload."""
    b, k, p = zip(*rows) if rows else ((), (), ())
    return pa.table({"grp": pa.array([grp] * len(b), pa.int32()), "bucket": pa.array(b, pa.int32()), "kind": pa.array(k, pa.int32()), "payload": pa.array(p, pa.binary())})


class Texts:
    """A group's documents in a fixed order, their bytes one after another with a blank after each."""

    def __init__(self, table: pa.Table) -> None:
        ids = table.column("doc_id").combine_chunks()
        self.rank = ids.fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)
        raw = [x.as_buffer().to_pybytes() for x in table.column("text").cast(pa.binary()).combine_chunks()] if len(table) else []
        order = sorted(range(len(raw)), key=lambda i: (self.rank[i], raw[i]))
        self.raw = [raw[i] for i in order]
        self.rank = self.rank[order] if order else np.zeros(0, np.int64)
        self.ids = ids.take(pa.array(order, pa.int64()))
        self.data = np.frombuffer(b"".join(x + b" " for x in self.raw), np.uint8)
        self.starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in self.raw]))).astype(np.int64)

    def parts(self, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
        """Runs of documents of up to so many bytes, or of one longer document."""
        at = 0
        while at < len(self.raw):
            to = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + most, "right")) - 1)
            yield at, min(to, len(self.raw))
            at = to


def answered(answers: pa.Table, kind: int) -> list[list[np.ndarray]]:
    """The unpacked payloads of one kind in the order of buckets."""
    rows = sorted((b, p) for b, k, p in zip(*(answers.column(c).to_pylist() for c in ("bucket", "kind", "payload"))) if k == kind)
    return [unpack(p) for _, p in rows]


def ask(dealt: DataFrame, question: Callable[[int, Texts], list[tuple[int, int, bytes]]]) -> DataFrame:
    """Messages of each group."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return mail(key[0].as_py(), question(key[0].as_py(), Texts(table)))

    return dealt.groupBy("grp").applyInArrow(run, MAIL)


def ask_again(dealt: DataFrame, answers: DataFrame, question: Callable[[int, Texts, pa.Table], list[tuple[int, int, bytes]]]) -> DataFrame:
    """Messages of each group that has its answers at hand."""

    def run(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        return mail(key[0].as_py(), question(key[0].as_py(), Texts(table), got))

    return dealt.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(run, MAIL)


def finish(dealt: DataFrame, answers: DataFrame, result: Callable[[Texts, pa.Table], pa.Table], schema: str) -> DataFrame:
    def run(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        return result(Texts(table), got)

    return dealt.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(run, schema)


#: Messages to one bucket that a task takes. Of more groups than so many, each run of them is merged into one message
#: first, and what that is answered is shared out: a tree whose depth grows with the logarithm of the corpus.
FAN = 4096

Message = tuple[int, int, bytes]
#: From the payloads of one kind to one payload; and from that one's answer and the payloads to an answer for each.
Merge = Callable[[int, list[bytes]], bytes]
Share = Callable[[int, bytes, list[bytes]], list[bytes]]


def _table(bucket: int, out: list[Message]) -> pa.Table:
    g, k, p = zip(*out) if out else ((), (), ())
    return pa.table({"grp": pa.array(g, pa.int32()), "bucket": pa.array([bucket] * len(g), pa.int32()), "kind": pa.array(k, pa.int32()), "payload": pa.array(p, pa.binary())})


def _sorted(table: pa.Table) -> list[Message]:
    return sorted(zip(*(table.column(c).to_pylist() for c in ("grp", "kind", "payload"))))


def answer(messages: DataFrame, groups: int, reply: Callable[[list[Message]], list[Message]], merge: Merge, share: Share, merged: tuple[int, ...]) -> DataFrame:
    """reply: from the messages to a bucket (grp, kind, payload) to its answers (grp, kind, payload). Messages of the
    kinds in merged, which any number of groups may send to a bucket, go there in runs of groups if there are many."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return _table(key[0].as_py(), reply(_sorted(table)))

    if groups <= FAN:
        return messages.groupBy("bucket").applyInArrow(run, MAIL)

    def join(key: tuple, table: pa.Table) -> pa.Table:
        rows, out = _sorted(table), []
        for kind in sorted({k for _, k, _ in rows}):
            out.append((key[1].as_py(), kind, merge(kind, [p for _, k, p in rows if k == kind])))
        return _table(key[0].as_py(), out)

    def deal_out(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        rows, out = _sorted(table), []
        for _, kind, payload in _sorted(got):
            own = [(g, p) for g, k, p in rows if k == kind]
            out += [(g, kind, p) for (g, _), p in zip(own, share(kind, payload, [p for _, p in own]))]
        return _table(key[0].as_py(), out)

    # Runs have numbers below 0, another for each level.
    of_run = F.when(F.col("grp") >= 0, -1 - F.floor(F.col("grp") / FAN)).otherwise(-1 - F.floor((-1 - F.col("grp")) / FAN)).cast("int").alias("run")
    many, few = messages.filter(F.col("kind").isin(*merged)), messages.filter(~F.col("kind").isin(*merged))
    runs = many.groupBy("bucket", of_run).applyInArrow(join, MAIL)
    answers = answer(runs.unionByName(few), -(-groups // FAN), reply, merge, share, merged)
    shared = many.groupBy("bucket", of_run).cogroup(answers.filter("grp < 0").groupBy("bucket", F.col("grp").alias("run"))).applyInArrow(deal_out, MAIL)
    return shared.unionByName(answers.filter("grp >= 0"))
