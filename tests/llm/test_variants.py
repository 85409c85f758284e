"""Spelling variants, whitening and exact duplicates against plain versions."""

from __future__ import annotations

import hashlib
import random
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flumen.llm import exact, queries, variants, whiten

NAMES = ["word", "n", "h", "leaf", "own", "near", "best", "root", "form", "x", "i", "s", "w", "at", "digest", "sha", "block", "row", "rank", "length", "kept", "keep_id"]


def with_names(df):
    return df.select("*", *(F.lit(f"{n} of the user").alias(n) for n in NAMES if n not in df.columns))


# exact duplicates


def lowered(text):
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def plain_groups(rows, largest=True):
    by = {}
    for doc_id, text in rows:
        by.setdefault(lowered(text), []).append(doc_id)
    order = (lambda i: (i is not None, i or 0)) if largest else (lambda i: (i is not None, -(i or 0)))
    return Counter((doc_id, max(by[lowered(t)], key=order), len(by[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for doc_id, t in rows)


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("fan", [2, 16])
def test_exact_agrees_with_grouping(spark, documents, largest, fan):
    r = random.Random(3)
    pool = ["Abc d", "aBC D", "abc d", "É x", "é x", "", None, "İI", "ii", "K", "k", "x" * 300_000, "X" * 300_000]
    rows = [(i, r.choice(pool)) for i in range(300)] + [(7, "abc d"), (7, "ABC D"), (None, "abc d"), (None, "only here")]
    docs = documents(rows).repartition(23)
    got = exact.duplicates(with_names(docs), largest, fan).collect()
    assert Counter((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got) == plain_groups(rows, largest)
    kept = Counter(x.text_sha256 for x in got if x.kept)
    assert set(kept.values()) == {1} and set(kept) == {x.text_sha256 for x in got} and all(x.doc_id == x.keep_id for x in got if x.kept)


def test_exact_on_no_rows(documents):
    assert exact.duplicates(documents([(1, "a")]).limit(0)).count() == 0


def test_a_hot_text_never_has_more_entries_in_a_merge_than_runs(spark, documents):
    docs = documents([(i, "the same") for i in range(400)]).repartition(20)
    rows = exact.runs(docs, True)
    first = exact.merged(rows.withColumn("n", F.lit(1).cast("long")))
    assert first.count() == 20
    assert exact.groups(rows, 4).first().n == 400


def test_exact_is_native(spark, documents):
    plan = exact.duplicates(documents([(1, "a"), (2, "A")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# spelling variants


def plain_words(rows, length=6, least=5):
    import re

    out = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lowered(w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= length and n >= least}


def one_apart(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(words):
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def spelled(seed, n_words=60, alphabet="aeinrsté", most=9):
    """Words of few letters in which edits, anagrams and chains of forms are frequent."""
    r = random.Random(seed)
    base = ["".join(r.choice(alphabet) for _ in range(r.randint(6, most))) for _ in range(n_words)]
    out = []
    for w in base:
        out += [w] * r.choice([5, 6, 30, 200])
        for _ in range(r.randint(0, 6)):
            i = r.randrange(len(w))
            out += [r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(alphabet) + w[i + 1 :], w[:i] + r.choice(alphabet) + w[i:], "".join(r.sample(w, len(w)))])] * r.choice([5, 5, 40])
    r.shuffle(out)
    return [(i, " ".join(out[i::40])) for i in range(40)]


@pytest.mark.parametrize(("sample", "leaf"), [(200_000, 8_000), (200_000, 16), (60, 16), (1, 4)])
def test_variants_agree_with_all_pairs(documents, sample, leaf):
    rows = [*spelled(sample + leaf), (None, "Straße STRASSE straßen×÷ " * 6), (3, None), (4, "")]
    words = plain_words(rows)
    got = variants.grouped(with_names(documents(rows)), sample=sample, leaf=leaf).collect()
    want = plain_variants(words)
    assert {(x.word, x.form, x.root, x.n, x.n_near, x.form_n) for x in got} == want and len(got) == len(want)
    assert sum(f is not None for _, f, *_ in want) > 20


def test_many_anagrams_are_looked_up(monkeypatch):
    """Leaves of equal counts give the same pairs by look-up as pair by pair."""
    r = random.Random(5)
    anagrams = {"".join(r.sample("aabbcdefg", 9)) for _ in range(400)}
    words = sorted(anagrams | {w.replace("g", "h") for w in anagrams} | {"".join(r.sample("aabbcdefh", 9)) for _ in range(400)})
    shorter = sorted({"".join(r.sample("aabcdefg", 8)) for _ in range(400)} | {w.replace('b', '', 1) for w in words[:300]})
    for others in (words, shorter):
        a, b = variants.Words(words, np.ones(len(words), int)), variants.Words(others, np.ones(len(others), int))
        want = {(x, y) for x in words for y in others if one_apart(x, y)}
        tree = variants.Tree(b.counts, variants.BRUTE)
        assert max(map(len, tree.leaves)) > variants.BRUTE  # anagrams can't be split
        got = [(words[i], others[j]) for p in variants.near_pairs(a, b, tree) for i, j in zip(*p)]
        assert set(got) == want and len(got) == len(want) > 100


@pytest.mark.parametrize(("up", "down"), [(True, True), (False, True), (False, False)])
def test_boxes_lose_no_word_within_reach(up, down):
    r = np.random.default_rng(2)
    counts = r.integers(0, 4, (3000, variants.LETTERS)).astype(np.uint8)
    tree = variants.Tree(counts, 20)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(3000)) and len(tree.leaves) > 100
    leaf_of = {j: k for k, rows in enumerate(tree.leaves) for j in rows.tolist()}
    queries_, want = [], []
    for j in range(0, 3000, 30):
        q = counts[j].astype(int)
        if up:
            q[r.choice(np.flatnonzero(q))] -= 1
        if down:
            q[r.integers(variants.LETTERS)] += 1
        queries_.append(q)
        want.append(leaf_of[j])
    reached = [set() for _ in want]
    for k, rows in tree.reached(np.array(queries_, np.uint8), np.arange(len(want)), up, down):
        for i in rows.tolist():
            reached[i].add(k)
    assert all(w in got for w, got in zip(want, reached))
    assert sum(map(len, reached)) < 0.5 * len(want) * len(tree.leaves)


def test_long_texts_are_read_in_pieces(documents, monkeypatch):
    text = " ".join(f"{a}{b}{c}tion" for a in "bcdfg" for b in "aeiou" for c in "klmn") + " "
    rows = [(1, text * 12), (2, "x" * 50_000 + " aeiouae" * 7)]
    want = plain_variants(plain_words(rows))
    monkeypatch.setattr(variants, "PIECE", 97)
    got = variants.grouped(documents(rows)).collect()
    assert {(x.word, x.form, x.root, x.n, x.n_near, x.form_n) for x in got} == want


def test_variants_on_no_rows(documents):
    assert variants.grouped(documents([(1, "a")]).limit(0)).count() == 0 and variants.grouped(documents([(1, "short words")])).count() == 0


# whitening


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def plain_whitening(rows):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in good], np.float32).astype(float)).astype(int) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    z = fit - s / n
    e, c = np.linalg.eigh(z.T @ z / n)
    e, c = e[::-1], c[:, ::-1]
    deviation = ((n * x.astype(object) - s.astype(object)) ** 2).sum(1)
    return [i for i, _ in good], n, deviation, ((x - s / n) @ c) / np.sqrt(np.maximum(e, 1e-300)), e / e.sum()


def test_whitening_agrees_with_an_eigendecomposition(spark):
    r = np.random.default_rng(4)
    v = (r.normal(size=(300, 24)) * np.geomspace(1, 0.02, 24)) @ r.normal(size=(24, 24))
    rows = [(i, [float(c) for c in np.float32(v[i])]) for i in range(300)] + [(i, [float(c) for c in np.float32(v[0])]) for i in range(900, 1200)]
    rows += [(5000, None), (5001, [None] + [0.0] * 23), (5002, [float("nan")] * 24), (5003, [float("inf")] + [0.0] * 23), (None, [1.0] * 24)]
    got = whiten.whitened(with_names(table(spark, [(*x, 0) for x in rows]).withColumnRenamed("label", "component"))).collect()
    ids, n, deviation, w, explained = plain_whitening(rows)
    assert len(got) == 16 * len(ids) and {x.n for x in got} == {n} and got[0].identity_error < 1e-10
    by = {(x.vec_id, x.component): x for x in got}
    at = {i: k for k, i in enumerate(ids)}
    for c in range(16):
        signs = {np.sign(by[i, c + 1].whitened * w[at[i], c]) for i in ids if abs(w[at[i], c]) > 1e-3}
        assert len(signs) == 1
        assert np.allclose([abs(by[i, c + 1].whitened) for i in ids], np.abs(w[:, c]), atol=1e-8)
        assert {by[i, c + 1].explained for i in ids} == {by[ids[0], c + 1].explained} and np.isclose(by[ids[0], c + 1].explained, explained[c], rtol=1e-9)
    assert all(int(by[i, 1].deviation) == deviation[at[i]] for i in ids)


def test_small_eigenvalues_keep_their_precision():
    r = np.random.default_rng(0)
    q, _ = np.linalg.qr(r.normal(size=(12, 12)))
    d = np.geomspace(1, 1e-9, 12)
    got, c = whiten.decomposed((q * d) @ q.T)
    assert np.allclose(got, d, rtol=1e-6) and np.allclose(c.T @ c, np.eye(12), atol=1e-12)
    order, low = whiten.cholesky((q * d) @ q.T)
    assert np.allclose(low @ low.T, ((q * d) @ q.T)[np.ix_(order, order)], atol=1e-14) and np.all(np.triu(low, 1) == 0)


def test_constant_columns_and_few_vectors_have_fewer_components(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0], 0) for i in range(4)]
    got = whiten.whitened(table(spark, rows)).collect()
    assert {x.component for x in got} == {1} and len(got) == 4 and abs(got[0].explained - 1) < 1e-12
    assert whiten.whitened(table(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).count() == 0  # no variance at all


def test_vectors_of_other_lengths_have_no_place(spark):
    rows = [(i, [float(i), float(i * i)], 0) for i in range(5)] + [(9, [1.0], 0), (10, [], 0), (11, [1.0, 2.0, 3.0], 0)]
    assert {x.vec_id for x in whiten.whitened(table(spark, rows)).collect()} == set(range(5))
    assert whiten.whitened(table(spark, rows).limit(0)).count() == 0


def test_deviations_beyond_longs_are_exact(spark):
    rows = [(0, [1e15, 0.0], 0), (1, [-1e15, 1.0], 0), (2, [3e8, 7.0], 0)]
    got = {x.vec_id: int(x.deviation) for x in whiten.whitened(table(spark, rows).withColumn("embedding", F.col("embedding").cast("array<double>"))).filter("component = 1").collect()}
    x = [[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for _, v, _ in rows]
    s = [sum(c) for c in zip(*x)]
    assert got == {i: sum((3 * c - t) ** 2 for c, t in zip(v, s)) for i, v in enumerate(x)}


def test_queries_are_registered():
    assert {"op11_variants", "op12_whitening", "op13_exact"} <= set(queries.queries())
