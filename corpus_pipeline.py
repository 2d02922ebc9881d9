"""The corpus pipeline: STAGES are applied to the documents one after the other, each over what the one before it kept.

Toxicity judges each row by itself. The two stages after it name what goes by id: there a row with a null doc_id is never dropped, since it can't be told
from others, and rows that share an id are dropped together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from streamatlas.llm import decontaminate, minhash_dedup, packing, pii, toxicity
from streamatlas.llm.frames import materialise
from streamatlas.llm.queries import table, tokenizer_file


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents whose id isn't among the dropped ones."""
    ids = dropped.where("doc_id is not null").select(F.col("doc_id").alias("dropped_id")).distinct()
    return docs.join(ids, docs["doc_id"] == ids["dropped_id"], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return _without(docs, minhash_dedup.near_duplicates(docs).where("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return _without(docs, decontaminate.benchmark_passages(docs, table(spark, sf_dir, "benchmark")))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that give it away, are replaced by their kind; no document goes."""
    return pii.sanitise(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into sequences."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", hide_personal_data),
    ("best-fit packing", pack_sequences),
]

# SQL can neither tokenize nor train; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
