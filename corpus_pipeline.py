"""A training corpus from raw documents: five stages, each over all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm.common import table
from hirelake.llm.decontaminate import remove_contaminated
from hirelake.llm.line_dedup import dedup_lines
from hirelake.llm.mixing import mix_sources
from hirelake.llm.queries import held_out
from hirelake.llm.simhash import keep_one_each
from hirelake.llm.toxicity import toxicity_score, train_toxicity
from hirelake.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half, by a model of the labelled rows that one may learn from."""
    model = train_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out(5, 0)))
    return docs.where(toxicity_score(model, F.col("text")) < 0.5)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier place holds in equal or near form."""
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near fingerprints join."""
    return keep_one_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mix_sources(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("near-duplicates", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix)]

#: Trained models and hashes decide rows, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, from the documents of `sf_dir` to the mix; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
