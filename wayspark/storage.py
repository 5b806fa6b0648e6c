"""Tables in the folder that all executors share, which cut the lineage of iterative operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own in local mode, and an error on a cluster, as no other
    folder is known to be shared."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not at:
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="wayspark-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        at = "file://" + _local[app]
    return at.rstrip("/")


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: it survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/wayspark-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
