"""Every operator and every stage on rows that are easily got wrong: columns of any name, nulls, repeats, no rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flumen.llm import chunks, decontaminate, language, mixing, near, pages, pii, secrets, simhash, substrings, suffixes

NAMES = ["_found", "found", "_mark", "mark", "bad_id", "first_id", "first_text", "copies", "taken", "taken_id", "doc_row", "item_row", "fp", "node", "key", "row", "n", "at", "size", "s", "count", "hash", "run", "lead", "grp", "part", "place", "turned", "page", "host", "rows"]


def with_names(df):
    """All those columns beside its own, of another type than the operators' own columns of these names."""
    return df.select("*", *(F.lit(f"{n} of the user").alias(n) for n in NAMES if n not in df.columns))


@pytest.fixture
def corpus(spark, prose):
    a = prose(60, 1)
    rows = [(1, a, "en", "s0"), (2, a, "en", "s0"), (2, a, "en", "s0"), (None, prose(40, 2), "en", None), (None, prose(40, 3), None, "s1"), (7, prose(50, 4), "en", "s1"), (7, prose(50, 5), "en", "s2"), (8, "", "en", "s0"), (9, None, None, None), (10, f"{prose(30, 6)} {prose(30, 7)}", "en", "s1"), (11, "x", "en", "s0")]
    rows += [(20 + i, prose(80, 50 + i), "en", f"s{i % 3}") for i in range(12)]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def bench(spark, prose):
    return spark.createDataFrame([(1, prose(30, 7)), (None, prose(20, 900)), (3, None), (3, "")], "item_id long, text string")


def operators(bench):
    return {
        "language": lambda d: language.identify(language.of_documents(d)),
        "suffixes": suffixes.deduplicated,
        "pii": lambda d: pii.pseudonymised(d, counts=True).drop(*NAMES),
        "simhash": simhash.near_duplicates,
        "decontaminate": lambda d: decontaminate.overlaps(d, bench),
        "substrings": substrings.deduplicated,
        "secrets": secrets.find_secrets,
        "mixing": mixing.mix,
        "chunks": chunks.neighbours,
        "near": near.near_copies,
    }


OPERATORS = list(operators(None))


def rows_of(df):
    return sorted(map(repr, (r.asDict() for r in df.select(sorted(df.columns)).collect())))


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_ignore_other_columns(corpus, bench, name):
    f = operators(bench)[name]
    plain = rows_of(f(corpus))
    assert plain == rows_of(f(with_names(corpus))) and (name == "decontaminate" or len(plain) == corpus.count())


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_on_no_rows(corpus, bench, name):
    assert operators(bench)[name](with_names(corpus).limit(0)).count() == 0


def test_pages_ignore_other_columns(spark):
    p = spark.createDataFrame([(1, "http://a.example", "<p>x"), (1, "http://a.example", "<p>x"), (None, None, None), (2, "", "")], "page_id long, url string, html string")
    assert rows_of(pages.extract(p)) == rows_of(pages.extract(with_names(p))) and pages.extract(with_names(p)).count() == 4
    assert pages.extract(with_names(p).limit(0)).count() == 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_keep_the_columns_of_the_user(corpus, bench, tmp_path, stage):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = with_names(corpus)
    out = dict(corpus_pipeline.STAGES)[stage](corpus.sparkSession, docs, str(tmp_path))
    own = [n for n in NAMES if not (stage == "mixing" and n in ("copies", "taken"))]
    got = out.collect()
    assert got and all(r[n] == f"{n} of the user" for r in got for n in own)
    if stage == "mixing":
        assert [c for c in out.columns if c not in docs.columns] == [] and all(r.copies >= 1 for r in got)
    else:
        assert out.columns == docs.columns
        plain = dict(corpus_pipeline.STAGES)[stage](corpus.sparkSession, corpus, str(tmp_path))
        assert rows_of(out.select(plain.columns)) == rows_of(plain)
    assert dict(corpus_pipeline.STAGES)[stage](corpus.sparkSession, docs.limit(0), str(tmp_path)).count() == 0


def test_stages_lose_no_text_of_repeated_or_null_ids(corpus, bench, tmp_path, prose):
    """Only the near copies go in their stage, only the overlap in the next; every other text stays, whatever its id."""
    texts = lambda df: {r.text or "" for r in df.collect()}
    assert texts(near.one_of_each(corpus)) == texts(corpus)
    assert near.one_of_each(corpus).count() == len(texts(corpus))
    assert texts(corpus) - texts(decontaminate.clean(corpus, bench)) == {f"{prose(30, 6)} {prose(30, 7)}"}
