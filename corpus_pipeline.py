"""A corpus pipeline of five stages over ``documents``, each written as Parquet and read again by the next.

Toxicity and quality drop what they reject, the n-gram join keeps the smallest id of each component, decontamination drops documents
with an occurrence of a benchmark window, and mixing draws the rest to target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import decontaminate, mixing, ngram_join, quality, toxicity
from seqloom.llm.shared import materialise, release, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity reaches the threshold go; null and empty texts are judged by the bias, null ids and repeats row by row."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality is below the threshold go; null counts as empty; without labels of both classes all stay."""
    return quality.clean(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component stays with all its rows, as do rows with a null id and texts without words."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with an occurrence of a benchmark window go, null ids among them; null texts have none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def draw(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn by their cell's probability, with topic, tokens and probability; equal ids fall alike within a cell."""
    return mixing.sample(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("ngram_join", keep_one_of_each), ("decontamination", drop_contaminated), ("mixing", draw)]

#: Classifiers are part of it, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Tables of earlier stages are removed once the next one is written; those of the last are read lazily."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            kept.append(after := materialise(stage(spark, docs, sf_dir), f"stage-{name}"))
        release(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
