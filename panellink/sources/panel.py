"""Panels: the column map, partitioned Parquet stores and CSV."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panellink.functions.ids import batch_id, batch_method, person_year_id
from panellink.functions.normalize import as_year, column, pick

FEATURES = ("salutation", "first_name", "middle_name", "last_name", "suffix", "gender", "title_standard")


@dataclass(frozen=True)
class PanelCols:
    """Logical roles to physical column names; names may use dots or underscores."""

    org_id: str = "ein"
    org_name: str = "org_name"
    year: str = "taxyr"
    name: str = "name"
    object_id: str = "OBJECTID"
    table_id: str = "TABLE_ID"
    features: tuple[str, ...] = FEATURES

    def found(self, df: DataFrame) -> PanelCols:
        """The map with the object and table ids spelled as in ``df``."""
        def spelled(*names: str) -> str:
            return next((p for p in (pick(df, n) for n in names) if p), names[0])

        return replace(self, object_id=spelled(self.object_id, "object_id"), table_id=spelled(self.table_id, "table_id"))

    def check(self, df: DataFrame) -> list[str]:
        """The features that ``df`` has; missing required columns are an error, missing features a warning."""
        missing = [c for c in (self.org_id, self.year, self.name) if pick(df, c) is None]
        if missing:
            raise ValueError(f"missing required column(s): {', '.join(missing)}")
        dropped = [f for f in self.features if pick(df, f) is None]
        if dropped:
            warnings.warn(f"ignoring feature(s) not in the data: {', '.join(dropped)}", stacklevel=3)
        return [f for f in self.features if f not in dropped]


def read_panel(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet files as one panel; partition values stay text, so that batch 07 isn't 7."""
    session = spark.newSession()  # the setting holds for this read alone
    session.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    schema = session.read.option("mergeSchema", "true").parquet(*paths).schema
    df = spark.read.schema(schema).parquet(*paths)
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def read_csv(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(list(paths))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def batch_summary(df: DataFrame, org: str = "ein", batch: str = "batch") -> DataFrame:
    """(batch, records, orgs, max_org, cost): cost is the sum of squared records of an organization."""
    per_org = df.groupBy(batch, F.col(f"`{org}`").cast("string").alias("o")).agg(F.count(F.lit(1)).alias("n"))
    return per_org.groupBy(batch).agg(
        F.sum("n").alias("records"), F.count(F.lit(1)).alias("orgs"), F.max("n").alias("max_org"), F.sum(F.col("n").cast("double") * F.col("n")).alias("cost")
    )


def batch_panel(df: DataFrame, path: str, n_batches: int = 100, cols: PanelCols | None = None, by: str | None = None, method: str = "auto", id_col: str = "PERSON_YEAR_ID", prefix: str = "batch", overwrite: bool = False) -> DataFrame:
    """Write whole organizations to ``<prefix>=NN`` folders, sorted by organization and year; returns the summary.

    Overwriting replaces all folders, stale ones too.  Ids must be unique; where the panel has none they are made from
    the native keys.
    """
    cols = (cols or PanelCols()).found(df)
    by = pick(df, by or cols.org_id)
    if by is None:
        raise ValueError("batch_panel: no column to batch by")
    if id_col not in df.columns:
        if cols.object_id not in df.columns or cols.table_id not in df.columns:
            raise ValueError(f"batch_panel: no {id_col!r}, and no native keys to make it from")
        df = df.withColumn(id_col, person_year_id(F.col(cols.object_id), F.col(cols.table_id)))
    if df.groupBy(id_col).count().where("count > 1").limit(1).count():
        raise ValueError(f"batch_panel: {id_col!r} is not unique")
    settled = batch_method(df, by, n_batches, method)
    out = df.withColumn(prefix, batch_id(F.col(f"`{by}`"), n_batches, settled))
    order = [F.col(f"`{pick(df, cols.org_id)}`")] + ([as_year(column(df, cols.year).cast("string"))] if pick(df, cols.year) else [])
    writer = out.repartition(prefix).sortWithinPartitions(prefix, *order).write.partitionBy(prefix)
    writer.option("partitionOverwriteMode", "static").mode("overwrite" if overwrite else "errorifexists").parquet(path)
    return batch_summary(out, pick(df, cols.org_id), prefix)
