"""Waves as a stream: each micro-batch is linked to the state so far and appended to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from panellink.plans.incremental import link_incremental
from panellink.plans.link import link_panel


def wave_sink(state_path: str, **link_args) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the stamped rows of batch n become ``<state_path>/wave=n``.

    A batch that runs again after a failure overwrites its own folder and reads only earlier ones, so the state stays
    the same whatever is retried.  The first batch is linked by itself.
    """

    def link(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        target = f"{state_path}/wave={n:09d}"
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state_path)
        fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        earlier = []
        if fs.exists(jpath):
            earlier = sorted(s.getPath().toString() for s in fs.listStatus(jpath) if s.getPath().getName().startswith("wave=") and s.getPath().getName() < f"wave={n:09d}")
        if earlier:
            existing = spark.read.parquet(*earlier)
            out = link_incremental(existing, batch, **link_args).new_stamped
        else:
            known = {"link_threshold": "threshold"} | {k: k for k in ("cols", "weights", "method", "prob_threshold")}
            out = link_panel(batch, **{known[k]: v for k, v in link_args.items() if k in known}).panel.drop("EMP_N_RECORDS", "EMP_N_YEARS", "EMP_LINK_CONF")
        out.write.mode("overwrite").parquet(target)

    return link


def link_stream(records: DataFrame, state_path: str, checkpoint: str, **link_args) -> StreamingQuery:
    """Link a stream of panel records; all that is available is processed, then the query ends."""
    return records.writeStream.foreachBatch(wave_sink(state_path, **link_args)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_state(spark, state_path: str) -> DataFrame:
    return spark.read.parquet(f"{state_path}/wave=*")
