"""What the operators share: input tables, saved intermediate tables, words."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from playlens.session import remove, workspace

#: A word is a run of anything but ASCII white space, which is also what bytes.split() takes.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\r\x0b\x0c"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An input table in Parquet."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def save(df: DataFrame, purpose: str) -> DataFrame:
    """`df` written as a Parquet table in the shared folder, and read back.

    Cuts the lineage: what follows starts from files that outlive any executor, and Spark
    knows their size, by which it decides between a broadcast and a shuffle.
    """
    path = workspace(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete saved tables once nothing reads them any more, so that storage doesn't grow with the steps."""
    for df in tables:
        files = df.inputFiles()
        if files:
            remove(df.sparkSession, files[0].rsplit("/", 1)[0])


def spread(df: DataFrame, *keys: Column) -> DataFrame:
    """`df` dealt by `keys` over the session's number of shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_hash(text: str = "text") -> Column:
    """128 bits that stand for a text, null apart from empty, as a string."""
    return F.when(F.col(text).isNull(), F.lit("null")).otherwise(F.md5(F.col(text).cast("binary")))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file `name` lies on this machine."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
