"""Cutting lineage: checkpoints in the shared folder that the session names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_path(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset one of our own, on a single machine only: on a cluster no local folder would do, so that is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Bytes of an Arrow batch of texts.
BATCH = 4 << 20


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after its session's Arrow batches are held to ``BATCH`` bytes: rows of texts differ in size by far, and both ends of the pipe hold a batch whole."""
    conf = docs.sparkSession.conf
    if int(docs.sparkSession._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return docs


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to Parquet in that folder and read again: compressed, read by the columns that are asked for, and of a known size, so that small ones are broadcast."""
    path = f"{checkpoint_path(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in that folder."""
    checkpoint_path(df.sparkSession)
    return df.checkpoint()
