"""State between the rounds of an iteration, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folder of each running application.
_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, or below the warehouse where that is unset and, if local, the session too; it goes when the application ends."""
    context = spark.sparkContext
    if context.applicationId not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_state"
            if base.startswith(("file:", "/")) and not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
        _FOLDERS[context.applicationId] = folder
    return _FOLDERS[context.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written and read back: its lineage ends there, and any executor can read it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
