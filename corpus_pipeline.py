"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination and mixing, in this order."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockledger.llm.common import documents, stored
from dockledger.llm.decontaminate import decontaminate
from dockledger.llm.line_templates import drop_templates
from dockledger.llm.mixing import mix_sources
from dockledger.llm.repetition import quality_rules
from dockledger.llm.simhash import near_duplicates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def on_plain_names(step: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Stage:
    """The step with further columns of docs under names that no operator uses; they come back as they were."""

    @functools.wraps(step)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: f"further_{i}_column" for i, c in enumerate(docs.columns) if c not in COLUMNS}
        back = {new: c for c, new in aside.items()}
        out = step(spark, docs.select(*(docs[c].alias(aside.get(c, c)) for c in docs.columns)), sf_dir)
        return out.select(*(out[c].alias(back.get(c, c)) for c in out.columns))

    return stage


@on_plain_names
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, keep=docs.columns).filter("kept").select(*docs.columns)


@on_plain_names
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of recurring templates; n_chars is that of the text that is left."""
    kept, _, dropped = drop_templates(docs)
    chars = F.when(F.col(dropped) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", chars).select(*docs.columns)


@on_plain_names
def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates."""
    return near_duplicates(docs, docs.columns, length=3, bits=2).filter("keeper").select(*docs.columns)


@on_plain_names
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, items, docs.columns).filter(~F.col("contaminated")).select(*docs.columns)


@on_plain_names
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document as often as it has copies, numbered from 1; with its source's target."""
    mixed = mix_sources(docs, weights=(1.0, 2.0, 3.0), most=3.0).filter("copies > 0")
    number = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return mixed.select(*docs.columns, "target", "copies", number)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_good),
    ("line dedup", drop_lines),
    ("simhash near-dedup", keep_one_of_near),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix),
]

#: Rates come from Newton steps and fingerprints from a hash that SQL does not have.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; each one's rows are stored before the next reads them."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{i}-{name.replace(' ', '-')}")
    return docs
