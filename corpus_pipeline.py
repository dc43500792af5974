"""A corpus pipeline of five stages over documents: each works on all that the one before kept.

toxicity: documents scored toxic (0.5 or more) go. near duplicates: of each component of texts linked at five-word
shingle similarity 0.8 the row of the smallest doc_id stays (one row of it: of several texts that of the least hash; a
doc_id's other texts are judged each by its own component; a null doc_id comes after all others; rows without words are no
copies of anything and stay). decontamination: documents that hold a benchmark window go. secrets:
spans are masked in the text. mixing: each document is repeated as often as the mix to the target weights takes it.
An empty table leaves every stage empty; columns may have any names and come back as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from candlewright.llm.decontaminate import clean_documents
from candlewright.llm.jaccard import near_duplicate_survivors
from candlewright.llm.mixing import mixed_documents
from candlewright.llm.runtime import Scratch
from candlewright.llm.secrets import redact_secrets
from candlewright.llm.toxicity import acceptable_documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return acceptable_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicate_survivors(docs, 5, 80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix),
]

#: Trees, probabilities and null-space moves are not SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; what a stage keeps is written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
