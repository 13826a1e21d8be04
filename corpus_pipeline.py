"""A corpus pipeline of the operators in pointfield.llm, each stage written as Parquet and read again.

In every stage null ids and sources are values like others, repeated rows are rows of their own, whole texts count whatever their
length, all columns come back as they are whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointfield.llm import decontamination, language_id, mixing, ngram_join, token_files
from pointfield.llm.common import documents, drop, materialize, passing

#: A document is rejected if no language is found or if its words speak for the found one with less than this mean probability.
MIN_SCORE = 0.3


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with columns named by number, which no operator's own columns are, and the name of the text among them."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), f"c{docs.columns.index('text')}"


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows. Null and empty texts and those without letters go, as all do where nothing can be
    learned: without any labelled row."""
    rows, text = _numbered(docs)
    found = language_id.predict(rows, language_id.trained(docs), text)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*rows.columns).toDF(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, Jaccard similarity of 0.8 or more. Of a group the least id
    stays, of its repeated rows one. Documents without words are no copies and stay."""
    return ngram_join.one_of_each(docs, shingle=5, num=80, den=100)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Documents without words have none and stay."""
    rows, text = _numbered(docs)
    found = decontamination.find(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text_col=text)
    return found.where("size(spans) = 0").select(*rows.columns).toDF(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Those without words are in no mix."""
    return mixing.mixed(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and where each lies in them. A null text has its end alone; null ids come first."""
    return token_files.write_and_read(docs, fold=True)


STAGES = [
    ("language_id", identified),
    ("ngram_join", deduplicated),
    ("decontamination", decontaminated),
    ("source_mixing", mixed),
    ("token_files", tokenized),
]

#: No SQL: a trained model and a tokenizer take part. tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        before = docs
        if k < len(STAGES) - 1:
            with passing(spark) as keep:  # what only this stage needed goes with its end
                docs = keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        else:
            docs = stage(spark, docs, sf_dir)
        drop(before)
    return docs
