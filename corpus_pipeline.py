"""The corpus pipeline: toxic documents go, one document of each group of near copies stays, contaminated documents
go, personal data become surrogates, and what is left is mixed by source.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read as the next one's docs; all
but the last return the columns of docs. Stages on shingles take five words and a similarity of 0.8.

Defined cases: null and empty texts are neither toxic nor near copies nor contaminated, have no personal data and give
the mix no words; rows with a null doc_id are kept; of a row that is met again the near-dedup stage keeps one; an empty
table gives an empty result; other columns, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, mixing, near_dedup, pii, toxicity
from tessera.llm.common import Scratch, documents, labels


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold of a lexicon learned from the labels of documents."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near copies."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item to the threshold."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in their texts."""
    return pii.without_pii(docs, pii.session_key(spark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.taken_words(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("mixing", mix),
]

#: Learned weights and MinHash components have no SQL; tests hold run() and its stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
