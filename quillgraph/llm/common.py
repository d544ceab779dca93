"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.state import shared_folder, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


materialise = written


def whole_text(column: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def input_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column; one number, to size partitions with."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Texts and files differ much in size: Arrow batches of few rows bound what a Python worker holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
