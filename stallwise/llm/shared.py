"""What the training-data operators share: reading tables and cutting lineage."""

from __future__ import annotations

import ctypes
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bound_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of a batch that goes to a Python worker; texts can be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def bound_batches(spark: SparkSession, most_bytes: int = 8 << 20) -> SparkSession:
    """The session, with its Arrow batches no larger than BATCH (nor than most_bytes): what a worker holds must not grow with the
    texts."""
    for key, most in (BATCH | {"spark.sql.execution.arrow.maxBytesPerBatch": str(most_bytes)}).items():
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= int(most):
            spark.conf.set(key, most)
    return spark


def give_back() -> None:
    """At the end of a task: what its worker has freed goes back to the machine. The worker lives on, beside those of later
    stages, and what it keeps of its largest batches counts for all of them."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; one of our own only where it names none, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
