"""A training-corpus pipeline: five stages, each applying one of the operators to all that the last one kept.

toxicity          documents that the classifier rejects go
ngram_jaccard     of each group of near duplicates the document of lowest id stays
decontamination   documents that hold a benchmark item go
mixing            documents repeat so that quality domains reach their target shares; none is lost
token_blocks      the corpus as Huffman-coded token blocks and their code book

Every stage but the last returns the columns of documents. Stages handle nulls,
empty texts, repeated rows, empty tables and extra columns as their operators say.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeplan.llm import decontam, mixing, ngramjoin, tokenio, toxicity
from lakeplan.llm.common import table
from lakeplan.shared import shared_dir

#: Target shares of tokens by quality, reached by repeating documents only.
QUALITY = {"high": "quality = 1", "low": "quality = 0"}
SHARES = {"high": 0.88, "low": 0.12}


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngramjoin.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, decontam.prepared(table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = mixing.train(docs, table(spark, sf_dir, "labels"), QUALITY)
    scored = mixing.posteriors(docs, model, whole=True)
    return mixing.apply_rates(scored, mixing.fit_rates(scored, model.names, SHARES, budget="grow", floor=1.0))


def token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenio.huffman_blocks(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_blocks", token_blocks),
]

#: Trained classifiers, alignment and entropy coding are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
