"""Every operator and stage on awkward and on empty tables, with clashing extra columns."""

from __future__ import annotations

import pytest

import corpus_pipeline
from playlens.llm import fingerprints, html, jaccard, lines, lm, mixing, packing, quality, simhash, tokens, urls
from tests.llm import frames

ON_DOCUMENTS = {
    "quality": quality.digest, "jaccard": jaccard.digest, "lines": lines.digest, "fingerprints": fingerprints.digest,
    "mixing": mixing.digest, "tokens": tokens.digest, "lm": lm.digest, "simhash": simhash.digest,
}
ON_PAGES = {"html": html.digest, "urls": urls.digest}


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_one_row_per_document(spark, name):
    docs = frames.documents(spark)
    rows = ON_DOCUMENTS[name](docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in frames.texts())
    assert all(value is not None for r in rows for key, value in r.asDict().items() if key not in ("doc_id", "class_id", "component_id", "text"))


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_no_document(spark, name):
    assert ON_DOCUMENTS[name](frames.no_documents(spark)).count() == 0


@pytest.mark.parametrize("name", ON_PAGES)
def test_pages(spark, name):
    assert ON_PAGES[name](frames.pages(spark)).count() == frames.pages(spark).count()
    assert ON_PAGES[name](frames.no_pages(spark)).count() == 0


def test_packing_of_no_document(spark):
    assert packing.pack(frames.no_documents(spark)).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_the_columns(spark, name, stage):
    docs = frames.documents(spark)
    kept = stage(spark, docs, None)
    assert kept.dtypes == docs.dtypes
    assert stage(spark, frames.no_documents(spark), None).dtypes == docs.dtypes
    assert stage(spark, frames.no_documents(spark), None).count() == 0
    given = {(r["doc_id"], r["source"], r["N_WORDS"]) for r in docs.collect()}
    rows = [(r["doc_id"], r["source"], r["N_WORDS"]) for r in kept.collect()]
    assert rows and set(rows) <= given
    assert name == "mixing sources" or len(rows) == len(set(rows))


def test_repeated_rows_get_equal_results(spark):
    docs = frames.documents(spark).where("doc_id = 17")
    for name in ("quality", "fingerprints", "tokens", "lm"):
        rows = [tuple(r) for r in ON_DOCUMENTS[name](docs).drop(
            "edited_sha256", "edited_fingerprint", "near_edited", "near_next").collect()]
        assert len(rows) == 3 and len(set(rows)) == 2
