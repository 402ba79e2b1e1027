"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, data folder) and works on all that its predecessor kept. All but
the last return the columns of documents. `run` writes every stage's rows as Parquet in the shared
folder and reads them back for the next, so a lost executor repeats part of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from playlens.llm import jaccard, lines, mixing, packing, quality
from playlens.llm.common import save, table


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the quality policy."""
    return quality.kept(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents without their later repeated runs of lines; one with nothing left goes."""
    return lines.cleaned(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The first document of each group of copies and near copies."""
    return jaccard.one_of_each(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, also not at all."""
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources", mixing_sources),
    ("best-fit packing", best_fit_packing),
]

#: Tokens are beyond SQL, so a brute-force version checks the rows instead.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the last stage, starting from the documents in `folder`."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, folder), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, folder)
