"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

#: A run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def slices(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """Batches cut into few rows each, so that what a task makes of whole texts at once stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at:at + rows]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's text, modulo `divisor`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def bounded_labels(labels: DataFrame, label: str, max_rows: int, positive_share: float = 0.4) -> tuple[DataFrame, dict[int, int]]:
    """At most `max_rows` labelled ids, `positive_share` of them of class 1 where there are enough, in the order of a
    hash of the id, and the number of rows of each class before that bound.

    Null ids and null labels take no part; of labels that contradict each other for one id the smallest counts.
    """
    known = single_labels(labels, label)
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    ones = max(int(max_rows * positive_share), max_rows - counts.get(0, 0))
    part = lambda y, n: known.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    return cut_lineage(part(1, ones).unionAll(part(0, max_rows - min(ones, counts.get(1, 0))))), counts


def single_labels(labels: DataFrame, label: str) -> DataFrame:
    """`doc_id` and `_y`, one row an id with a label of 0 or 1."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("_y"))
    return known.where(F.col("_y").isin(0, 1))
