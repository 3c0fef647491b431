"""The corpus pipeline: five stages, each a table of documents made from the one before.

All stages but the last return the columns of documents, and any others that the input has,
whatever their names. SQL can't express the first and the last stage (a trained model, token
ids), so ORACLE_SQL is None and tests/llm holds each stage against a plain version of its rule.

Rows are judged and kept as rows, not by id: rows of one id with different texts are judged
apart, and repeated rows and rows without id follow the rules of each stage. Null and empty
texts, very long texts and empty tables pass all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from diffusio.llm import decontaminate, neardup, packing, secrets, toxicity
from diffusio.llm.queries import tokenizer_path
from diffusio.session import written


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that docs don't have."""
    while name in map(str.lower, docs.columns):
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity is below the threshold; the model is learnt from all labels of docs.

    Null and empty texts have the score of the model's bias; without labels every row stays;
    repeated rows stay or go together; an empty table stays empty.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = _unused(docs, "toxicity")
    return toxicity.score(docs, model, name).where(F.col(name) < toxicity.THRESHOLD).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: that of the least id, rows without id last.

    Repeated rows are copies, of which one stays; null texts and texts without words link with
    nothing, and all such rows stay; an empty table stays empty.
    """
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't contaminated by the benchmark.

    Null and empty texts have no words and stay, and so does all if the benchmark is empty;
    repeated rows stay or go together; an empty table stays empty.
    """
    name = _unused(docs, "contamination")
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name)
    return found.where(~F.col(name)["contaminated"]).drop(name)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets replaced and n_chars set to the new length.

    Null texts stay null, empty ones and rows without secrets stay as they are; an empty table
    stays empty.
    """
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences of 2048 tokens.

    A null or empty text is one piece of one id; rows without id and repeated rows are packed
    each; an empty table gives no pieces.
    """
    return packing.pack_documents(docs, tokenizer_path(), capacity=2048, end=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again. An empty table gives no pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
