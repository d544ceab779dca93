"""Corpus pipeline: from raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; between stages the documents are
written as Parquet and read again. All stages but the last return the columns of documents, further ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import decontaminate, jaccard_join, langid, mixing, tokenfile
from quillgraph.llm.common import materialise, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose language no learned one fits."""
    return langid.with_known_language(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each class of near duplicates; of rows alike in doc_id one stays.

    A row without a doc_id stays where no document with one has its text or one similar to it.
    """
    return jaccard_join.first_of_class(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that their tokens meet the target shares of sources, languages and topics."""
    return mixing.mix_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files; a row for each document in them."""
    return tokenfile.encode_documents(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_benchmark),
    ("mixing sources", mix_sources),
    ("token output", write_tokens),
]

#: SQL can't express kernels, SimHash and the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
