"""The corpus pipeline: documents in, a mixed training corpus out.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept, reread from
Parquet, and returns the documents it keeps with their columns; the last one returns the mix,
in which a document stands as often as it is taken.

In every stage an empty table gives an empty table, columns besides doc_id, text, lang and
source are carried along whatever their names, and rows with a null id are judged by their text
like others; what each does with null texts and repeated rows stands below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm import decontaminate, language_id, mixing, near_dedup, toxicity
from arborlake.plans.stage import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null texts among them), or too far from every known language,
    go.  Repeated rows are judged alike; a null lang teaches nothing."""
    model = language_id.fit(docs)
    return docs.where(~language_id.predictor(spark, model)(F.col("text").cast("string"))["rejected"])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go.  A null or wordless text has the share of toxic labels as
    its score; repeated rows are judged alike; a document with several labels is toxic if one
    says so."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.scorer(spark, model)(F.col("text").cast("string")) < model.params.threshold)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, of repeated rows one; null and
    wordless texts are duplicates of nothing."""
    return near_dedup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item go; null texts hold none; repeated rows are
    judged alike."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out by their source's target weight; a null source is a
    source of its own; a null text has no words, so it does not count; repeated rows are taken
    equally often."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The models and the alignment have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
