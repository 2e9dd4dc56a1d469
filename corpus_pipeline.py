"""The corpus pipeline: documents are screened, deduplicated, decontaminated and packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; what it returns is
written as Parquet and read again as the next stage's docs. All but the last return rows of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsql.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from docsql.llm.common import drop_since, materialize, written
from docsql.llm.queries import tokenizer_path
from docsql.shipping import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network predicts 1 go; it is fitted on the labelled rows of docs."""
    ship(spark)
    return toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remove=True)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    ship(spark)
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of any benchmark item go."""
    ship(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=1, remove=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands: bin and offset, in ids of op3's tokenizer."""
    ship(spark)
    return packing.pack(docs, tokenizer=tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: Neither a trained network nor a greedy packing is SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = written()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.split(" ")[0].lower())
        drop_since(spark, mark, but=(docs,))
    return docs
