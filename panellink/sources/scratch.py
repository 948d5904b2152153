"""Scratch tables in the shared folder that ``spark.checkpoint.dir`` names: they cut the lineage of iterations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def scratch_root(spark) -> str:
    root = spark.conf.get("spark.checkpoint.dir", "")
    if root:
        return root
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="panellink-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """Write and reread ``df``: later plans start from files that survive lost executors."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
