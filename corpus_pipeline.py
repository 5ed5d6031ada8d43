"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

Toxic documents go; one document of each group of near duplicates stays; documents that hold benchmark
passages go; secrets are replaced in the text; and what is left is encoded in pieces and decoded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesieve.llm.base import held_out, spare, table
from sitesieve.llm.dartminhash import one_of_each
from sitesieve.llm.decontaminate import without_contaminated
from sitesieve.llm.pieces import recode
from sitesieve.llm.queries import model_path
from sitesieve.llm.secrets import BlobLedger, redact_documents
from sitesieve.llm.toxicity import fit_toxicity, toxicity
from sitesieve.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    score = spare("score", docs)
    return docs.withColumn(score, toxicity(F.col("text"), model)).filter(F.col(score) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without enough benchmark text to count as contaminated."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in the text replaced by a mark."""
    return redact_documents(docs, BlobLedger(spark))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text beside the columns of documents; the text is what the ids decode to."""
    both, ids, number = spare("both", docs), spare("ids", docs), spare("n_ids", docs)
    coded = docs.withColumn(both, recode(F.col("text"), model_path("piece_bpe_32k.model")))
    coded = coded.withColumn("text", F.col(f"{both}.decoded")).withColumn(ids, F.col(f"{both}.ids")).drop(both)
    return coded.withColumn(number, F.size(ids).cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", replace_secrets),
    ("pieces", encode_pieces),
]

# A classifier learned from the rows has no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
