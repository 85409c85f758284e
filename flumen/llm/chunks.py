"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes is taken at every byte; a chunk ends where its masked bits are zero. As in normalised
chunking, a chunk shorter than the normal size needs more zero bits than a longer one, so sizes gather round the
normal size; none is under MIN or over MAX bytes but the last. A cut depends on the bytes just before it, so an edit
changes the chunks around it and no others.

The fingerprint of a text is the set of its chunks' digests, each with the chunk's length as weight. The likeness of a
text to another is the share of its own weight that the other's set contains: 1 for a text within the other (and for
two empty ones), 0 where nothing is common or one of them is empty.

Null texts count as empty. Order is by doc_id (nulls first), then a hash of the text; repeated rows follow each other and
are in one run. An empty table gives an empty one; other columns are ignored. A very long text is a run of its own.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, running, texts
from .hashing import mixed

MIN, NORMAL, MAX = 32, 128, 512
#: Bytes of text in a run, and in the part of it whose fingerprints are taken at a time.
RUN, PART = 32 << 20, 4 << 20
#: A value for each byte, from a fixed rule.
GEAR = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
#: Zero bits asked for below and above the normal size.
STRICT, LOOSE = np.uint32(0xFF << 24), np.uint32(0x3F << 26)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum over the last 32 bytes of their values, shifted by their distance."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        older = h[:-step] << np.uint32(step)
        h[step:] += older
    return h


def cuts(data: bytes, bounds: list[int]) -> Iterator[list[int]]:
    """The chunks' ends in each of the texts that lie one after another in data, as offsets in data.

    No chunk ends within MIN bytes of its start, so no hash that is looked at reaches back into the text before.
    """
    h = gear(np.frombuffer(data, np.uint8))
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = (loose[(h[loose] & STRICT) == 0] + 1).tolist()
    loose = (loose + 1).tolist()
    for at, n in zip(bounds, bounds[1:]):
        ends = []
        i, j = bisect_left(strict, at), bisect_left(loose, at)
        while n - at > MIN:
            i = bisect_left(strict, at + MIN, i)
            end = strict[i] if i < len(strict) else n
            if end > at + NORMAL:
                j = bisect_left(loose, at + NORMAL, j)
                end = min(loose[j] if j < len(loose) else n, at + MAX)
            at = min(end, n)
            ends.append(at)
        if at < n:
            ends.append(n)
        yield ends


def fingerprints(all_texts: list[bytes]) -> list[dict[str, int]]:
    """For each text, digest and length of each different chunk."""
    data, out = b"".join(all_texts), []
    bounds = [0, *np.cumsum([len(t) for t in all_texts]).tolist()]
    for start, ends in zip(bounds, cuts(data, bounds)):
        fp = {}
        for end in ends:
            fp[hashlib.blake2b(data[start:end], digest_size=8).hexdigest()] = end - start
            start = end
        out.append(fp)
    return out


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    if not a or not b:
        return float(not a and not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def written(fp: dict[str, int]) -> str:
    return ",".join(f"{d}:{n}" for d, n in sorted(fp.items()))


def edited(text: str, following: str) -> str:
    """The last quarter of the text's code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def in_runs(docs: DataFrame, size: int = RUN) -> DataFrame:
    """doc_id, hash, text, run, lead: rows dealt into runs of about so many bytes, consecutive in the order of doc_id and a
    hash of the text. The first row of a run is there once more in the run before (lead; the very first row in the last
    run), so that each row finds its successor in its own run.

    The order comes from a table of two numbers a row; the driver and each task hold the first row's two numbers for
    each run, that is half a megabyte for each terabyte of text.
    """
    docs = texts(docs).withColumn("hash", F.xxhash64("text"))
    sizes = docs.select("doc_id", "hash", F.octet_length("text").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = max(1, min(size, -(-total // (8 * partitions(docs.sparkSession)))))
    placed = running(sizes, [F.col("doc_id").asc_nulls_first(), F.col("hash")], {"before": F.col("n")})
    order = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "hash")
    least = placed.groupBy(F.floor(F.col("before") / size).alias("run")).agg(F.min(order).alias("first")).select("first.*").distinct().orderBy("some", "doc_id", "hash").collect()
    bounds = [(r["some"], r["doc_id"] or 0, r["hash"]) for r in least]
    places = {key: i for i, key in enumerate(bounds)}
    nulls = sum(not some for some, _, _ in bounds)
    ids = np.array([doc for some, doc, _ in bounds if some], np.int64)

    def deal_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some, doc, of = b.column("doc_id").is_valid().to_numpy(zero_copy_only=False), b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), b.column("hash").to_numpy(zero_copy_only=False)
            at = np.searchsorted(ids, doc, "right")
            run = (nulls + at - 1).astype(np.int32)
            leads = {}
            # Rows without an id or with that of some run's first row: the hash decides.
            for i in np.flatnonzero(~some | ((at > 0) & (ids[np.maximum(at - 1, 0)] == doc)) if len(ids) else ~some).tolist():
                key = (bool(some[i]), int(doc[i]), int(of[i]))
                run[i] = bisect_right(bounds, key) - 1
                if key in places:
                    leads[key] = i
            text = b.column("text").cast(pa.string())
            before = np.array([(places[key] - 1) % len(bounds) for key in leads], np.int32)
            for rows, to, lead in ((np.arange(len(run)), run, False), (np.array([*leads.values()], np.int64), before, True)):
                if len(rows):
                    take = pa.array(rows)
                    yield pa.record_batch([b.column("doc_id").take(take), b.column("hash").take(take), text.take(take), pa.array(to), pa.array([lead] * len(rows))], ["doc_id", "hash", "text", "run", "lead"])

    return docs.mapInArrow(deal_out, "doc_id long, hash long, text string, run int, lead boolean")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _part(doc_ids: pa.Array, every: list[str]) -> pa.Table:
    """The rows of some texts in order, each but the last with its successor."""
    n = len(every) - 1
    changed = [edited(a, b) for a, b in zip(every, every[1:])]
    raw = [t.encode() for t in [*every, *changed]]
    fps = fingerprints(raw)
    plain, after = fps[: n + 1], fps[n + 1 :]
    return pa.table(
        {
            "doc_id": doc_ids, "n_chars": pa.array([len(t) for t in every[:n]], pa.int64()), "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in raw[n + 1 :]], pa.string()),
            "fingerprint": pa.array([written(f) for f in plain[:n]], pa.string()), "edited_fingerprint": pa.array([written(f) for f in after], pa.string()),
            "near_edited": pa.array([likeness(a, b) for a, b in zip(plain, after)], pa.float64()), "near_next": pa.array([likeness(a, b) for a, b in zip(plain, plain[1:])], pa.float64()),
        }
    )


def _run(table: pa.Table) -> pa.Table:
    # A row that is there as a lead more than once (repeated rows) leads but once.
    lead = table.filter(table.column("lead")).slice(0, 1)
    own = table.filter(pc.invert(table.column("lead")))
    own = own.take(pc.sort_indices(own, [("doc_id", "ascending"), ("hash", "ascending")], null_placement="at_start"))
    rows = pa.concat_tables([own.select(["doc_id", "text"]), lead.select(["doc_id", "text"])]).combine_chunks()
    ends, parts, at = np.cumsum(pc.binary_length(rows.column("text")).to_numpy()), [], 0
    n = len(own) if len(lead) else len(own) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right"))))
        parts.append(_part(rows.column("doc_id").combine_chunks()[at:to], rows.column("text")[at : to + 1].to_pylist()))
        at = to
    if not len(lead) and len(own):
        raise ValueError("a run without the row after it")
    return pa.concat_tables(parts) if parts else pa.table({c: pa.array([], t) for c, t in (("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()))})


def neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; see edited() and likeness()."""
    return in_runs(docs).groupBy("run").applyInArrow(_run, SCHEMA)


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_bytes: a row for each different chunk of each text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = fingerprints([t.encode() for t in frame["text"]])
            rows = [(i, d, n) for i, f in zip(frame["doc_id"], fps) for d, n in f.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "digest", "n_bytes"])

    return texts(docs).mapInPandas(run, "doc_id long, digest string, n_bytes long")
