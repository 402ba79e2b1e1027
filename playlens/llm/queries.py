"""The registered queries of this subpackage: name -> callable(spark, data folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from playlens.llm import (
    codes, fingerprints, html, jaccard, lines, lm, mixing, negatives, packing, quality, simhash, tokens, urls,
)
from playlens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def on(name: str, digest: Callable[[DataFrame], DataFrame]) -> Query:
    """A query that applies `digest` to one whole table."""
    return lambda spark, folder: digest(table(spark, folder, name))


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": on("documents", quality.digest),
        "op2_ngram_jaccard_join": on("documents", jaccard.digest),
        "op3_line_dedup": on("documents", lines.digest),
        "op4_html_extraction": on("pages", html.digest),
        "op5_document_fingerprints": on("documents", fingerprints.digest),
        "op6_pareto_mixing": on("documents", mixing.digest),
        "op7_token_counts": on("documents", tokens.digest),
        "op8_best_fit_packing": on("documents", packing.pack),
        "op9_hmm_scoring": on("documents", lm.digest),
        "op10_url_filters": on("pages", urls.digest),
        "url_filters_shared_addresses": on("pages", urls.shared_addresses),
        "op11_simhash_near_dedup": on("documents", simhash.digest),
        "op12_vector_codes": on("embeddings", codes.digest),
        "op13_hard_negatives": on("embeddings", negatives.digest),
    }
