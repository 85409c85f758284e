from __future__ import annotations

import random

import pytest

WORDS = [a + b for a in "ba be bi bo da de di do fa fe fi fo ga ge gi go".split() for b in "la le li lo ra re ri ro na ne ni no".split()]


@pytest.fixture
def prose():
    """Random sentences of so many words."""

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture
def documents(spark):
    """documents from texts, or from (doc_id, text) pairs, with extra columns whose names clash."""

    def make(texts, lang="en", source="s"):
        rows = [(x if isinstance(x, tuple) else (i, x)) for i, x in enumerate(texts)]
        return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), 1, "x", 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp int, component_id string, grp int")

    return make
