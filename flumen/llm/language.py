"""Language identification by Bayesian fusion of evidence.

For each text the posterior over languages combines four kinds of evidence:

 - the text: naive Bayes over hashed letter trigrams, trained on a bounded sample of labelled rows. All trigrams of a
   text are counted; as they depend on each other, together they weigh as much as EVIDENCE independent ones at most.
 - the declared language (markup or metadata) and the suffix of the address: how often each value goes with each
   language, over all rows.
 - the host: its languages over all rows but the one at hand, smoothed towards those of its site, and these towards
   those of all rows.

Counts come from grouped aggregation over languages by the text alone. Besides the languages of the sample there is
"und", a flat model of trigrams that no language explains; a text without letters is und as well. A row is rejected if
und wins or no language reaches LEAST of the posterior. Null texts count as empty; null evidence counts as none;
repeated rows get equal results; without labelled rows everything is und; an empty table gives an empty one; a very long
text is counted in parts. Labels are languages, of which there are some hundred: the model has a column for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, if_small, join_counted, unused

#: Labelled rows to train on, at most about this many, chosen by a hash of the text.
SAMPLE = 8_000
BUCKETS = 1 << 16
EVIDENCE = 60
LEAST = 0.5
#: Weight of what lies above in the smoothing of hosts and sites, in rows; added counts of evidence values.
SMOOTH, ADDED = 5.0, 1.0
UND = "und"

_letters: list[np.ndarray] = []


def trigrams(text: str) -> np.ndarray:
    """Hashed letter trigrams; anything else than letters separates words, and words have an edge on both sides."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x30000)), bool, 0x30000))
    cp = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.where(_letters[0][np.minimum(cp, 0x2FFFF)], cp, 32).astype(np.uint32)
    gap = x == 32
    x = x[np.concatenate(([True], ~(gap[1:] & gap[:-1])))]
    if len(x) < 3:
        return np.zeros(0, np.uint32)
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)


def train(rows: DataFrame, sample: int = SAMPLE, added: float = 0.1) -> tuple[list[str], np.ndarray]:
    """Languages, and the log-likelihood of each trigram bucket in each of them and in und (the last column)."""
    labelled = rows.filter("label is not null")
    n = labelled.count()
    some = labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(n, 1))))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for frame in frames:
            for text, label in zip(frame["text"], frame["label"]):
                counts[label] = counts.get(label, 0) + np.bincount(trigrams(text), minlength=BUCKETS)
        for label, c in counts.items():
            b = c.nonzero()[0]
            yield pd.DataFrame({"label": label, "bucket": b, "n": c[b]})

    found = some.select("text", "label").mapInPandas(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["label"].unique())
    p = np.full((BUCKETS, len(langs) + 1), added)
    for i, lang in enumerate(langs):
        own = found[found["label"] == lang]
        p[own["bucket"], i] += own["n"]
    p[:, -1] = 1.0
    return langs, np.log(p / p.sum(0)).astype(np.float32)


def scored(rows: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """rows with `text` replaced by `like` (the weighed log-likelihoods, und last) and `top` (the best one's index)."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            like = np.zeros((b.num_rows, len(langs) + 1))
            for i, text in enumerate(b.column("text").to_pylist()):
                t = trigrams(text)
                if len(t):
                    like[i] = np.add.reduce([model[t[k : k + 4096]].sum(0, dtype=np.float64) for k in range(0, len(t), 4096)]) * min(1.0, EVIDENCE / len(t))
                else:
                    like[i, :-1] = -1e6
            yield pa.record_batch([*(b.column(c) for c in kept), pa.array(list(like), pa.list_(pa.float64())), pa.array(like.argmax(1).astype(np.int32))], [*kept, "like", "top"])

    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", like array<double>, top int"
    return rows.select(*kept, "text").mapInArrow(run, schema)


def _counts(n: int) -> Column:
    return F.array(*(F.count_if(F.col("top") == i).cast("double") for i in range(n)))


def _once(value: Column, use) -> Column:
    """use(value), with value computed once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _shares(a: Column) -> Column:
    return _once(F.struct(a.alias("a"), _total(a).alias("t")), lambda s: F.transform(s["a"], lambda x: x / s["t"]))


def _value_table(rows: DataFrame, column: str, n: int) -> DataFrame:
    """Log-likelihood of each value of an evidence column in each language, over all rows."""
    by = cut(rows.filter(F.col(column).isNotNull()).groupBy(column).agg(_counts(n).alias("c")))
    *totals, values = by.agg(*(F.coalesce(F.sum(F.get("c", F.lit(i))), F.lit(0.0)) for i in range(n)), F.count("*")).first()
    below = F.array(*(F.lit(t + ADDED * (values + 1)) for t in totals))
    return by.select(column, F.zip_with("c", below, lambda c, t: F.ln((c + ADDED) / t)).alias(f"{column}_like"), _total(F.col("c")).alias("rows"))


def identify(rows: DataFrame, sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """rows needs text, label (for training; may be null), declared, suffix, site and host. Returns rows without text,
    and language, posterior, text_language and rejected."""
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    langs, model = train(rows, sample)
    n = len(langs) + 1
    found = cut(scored(rows.drop("label"), langs, model))

    hosts = found.filter("host is not null").groupBy("host").agg(F.max("site").alias("site"), _counts(n).alias("host_n"))
    sites = hosts.filter("site is not null").groupBy("site").agg(F.array(*(F.sum(F.get("host_n", F.lit(i))) for i in range(n))).alias("site_n"))
    every = found.agg(*(F.count_if(F.col("top") == i) for i in range(n))).first()
    share = F.array(*(F.lit((c + ADDED) / (sum(every) + ADDED * n)) for c in every))
    # A host of no known site is a site of its own.
    priors = hosts.join(sites, "site", "left").select("host", "host_n", F.coalesce("site_n", "host_n").alias("site_n"), _total(F.col("host_n")).alias("rows"))

    name = F.array(*(F.lit(x) for x in [*langs, UND]))
    flat = F.array(*(F.lit(0.0) for _ in range(n)))

    def smooth(c: Column, above: Column) -> Column:
        """Counts of all rows but the one at hand, as shares, drawn towards those above."""
        others = F.transform(c, lambda x, i: x - (i == F.col("top")).cast("double"))
        return _once(F.struct(others.alias("o"), _total(others).alias("t")), lambda s: F.zip_with(s["o"], above, lambda x, p: (x + SMOOTH * p) / (s["t"] + SMOOTH)))

    out = join_counted(found, priors, ["host"], "rows", "left")
    for column in ("declared", "suffix"):
        out = join_counted(out, _value_table(found, column, n), [column], "rows", "left")
    out = out.withColumn("prior", F.when(F.col("site_n").isNotNull(), smooth(F.col("site_n"), share)).otherwise(share))
    out = out.withColumn("prior", F.when(F.col("host_n").isNotNull(), smooth(F.col("host_n"), F.col("prior"))).otherwise(F.col("prior")))
    log = F.zip_with("like", "prior", lambda a, p: a + F.ln(p + 1e-9))
    for column in ("declared_like", "suffix_like"):
        log = F.zip_with(log, F.coalesce(column, flat), lambda a, b: a + b)
    out = out.withColumn("log", _once(F.struct(log.alias("a"), F.array_max(log).alias("m")), lambda s: _shares(F.transform(s["a"], lambda x: F.exp(x - s["m"])))))
    best = F.array_max("log")
    out = out.withColumn("posterior", best).withColumn("language", F.get(name, F.array_position("log", best).cast("int") - 1)).withColumn("text_language", F.get(name, F.col("top")))
    kept = [c for c in rows.columns if c not in ("text", "label")]
    return out.select(*kept, "language", "posterior", "text_language", ((F.col("language") == UND) | (F.col("posterior") < least)).alias("rejected"))


def of_documents(docs: DataFrame) -> DataFrame:
    """The evidence that documents bring: the language they declare, and their source as host."""
    none = F.lit(None).cast("string")
    return docs.select("doc_id", "text", F.col("lang").alias("label"), _tag(F.col("lang")).alias("declared"), none.alias("suffix"), none.alias("site"), F.col("source").alias("host"))


def of_pages(pages: DataFrame) -> DataFrame:
    """The evidence that pages bring: markup language, and host, site and suffix of the address."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    plain = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = _tag(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1))
    blank = lambda c: F.when(c != "", c)
    return pages.select("page_id", plain.alias("text"), F.lit(None).cast("string").alias("label"), declared.alias("declared"), blank(F.regexp_extract(host, r"\.([a-z]+)$", 1)).alias("suffix"), blank(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("site"), blank(host).alias("host"))


def _tag(c: Column) -> Column:
    """The primary part of a language tag."""
    tag = F.lower(F.regexp_extract(F.trim(c), r"^([A-Za-z]+)", 1))
    return F.when(tag != "", tag)


def accepted(docs: DataFrame) -> DataFrame:
    """docs without those that are rejected; of rows with one doc_id each is judged by its own text."""
    mark, bad_id, bad_mark = (unused(docs, n) for n in ("mark", "bad_id", "bad_mark"))
    rows = of_documents(docs).withColumn(mark, F.xxhash64("text", "label", "host"))
    bad = if_small(identify(rows).filter("rejected").select(F.col("doc_id").alias(bad_id), F.col(mark).alias(bad_mark)).distinct())
    same = F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.xxhash64("text", "lang", "source") == F.col(bad_mark))
    return docs.join(bad, same, "left_anti")
