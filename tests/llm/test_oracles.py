"""Queries that SQL can express, against DuckDB; the awkward table as well."""

from __future__ import annotations

import duckdb
import pytest

from checks.compare import compare, connect
from playlens.llm import mixing, quality, urls
from playlens.llm.oracles import oracles
from playlens.llm.queries import queries
from tests.conftest import DATA
from tests.llm import frames


@pytest.mark.parametrize("name", sorted(oracles()))
def test_on_the_given_tables(spark, name):
    problems, rows = compare(queries()[name](spark, str(DATA)), connect(str(DATA)), oracles()[name])
    assert not problems and rows > 0


@pytest.mark.parametrize("name, digest", [("op1_quality_rules", quality.digest), ("op6_pareto_mixing", mixing.digest)])
def test_on_awkward_documents(spark, name, digest):
    docs = frames.documents(spark)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    problems, rows = compare(digest(docs), con, oracles()[name])
    assert not problems and rows == len(frames.texts())


def test_on_awkward_pages(spark):
    pages = frames.pages(spark)
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    problems, rows = compare(urls.digest(pages), con, oracles()["op10_url_filters"])
    assert not problems and rows == pages.count()
