"""Scratch tables in the shared folder, size-checked broadcasts and distributed row numbering."""

from __future__ import annotations

import math
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_WRITTEN: list[str] = []
#: A key of more rows than this, and than 1/HOT_KEYS of all rows, is joined by broadcast: there are HOT_KEYS such keys at most.
HOT_ROWS, HOT_KEYS = 50_000, 10_000


def col_of(df: DataFrame, name: str) -> Column:
    """A column by its whole name, which may hold dots."""
    return df["`" + name.replace("`", "``") + "`"]


def carried(df: DataFrame, carry: tuple[str, ...]) -> list[Column]:
    """The columns that come along, under names that can't clash: c_0, c_1, ..."""
    return [col_of(df, c).alias(f"c_{k}") for k, c in enumerate(carry)]


def held(carry: tuple[str, ...]) -> list[str]:
    return [f"c_{k}" for k in range(len(carry))]


def returned(carry: tuple[str, ...]) -> list[Column]:
    return [F.col(f"c_{k}").alias(f"carry_{c}") for k, c in enumerate(carry)]


def scratch_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and the master is local (tests), a temporary folder that is then set.

    On a cluster executors don't share local folders, so there an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", "")
    if root:
        return root
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="panellink-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_of(paths: list[str]):
    """Add the scratch tables that are written inside to ``paths``."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        paths += _WRITTEN[before:]


def clear_scratch(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete the scratch tables in ``paths``, or every one that this process wrote.  Results that read them must have been written before."""
    jvm = spark.sparkContext._jvm
    paths = _WRITTEN if paths is None else paths
    while paths:
        name = paths.pop()
        if name in _WRITTEN:
            _WRITTEN.remove(name)
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only where a count (that stops at the bound) proves at most ``max_rows`` rows; else Spark decides."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_hash(c: Column, text: Column) -> Column:
    """Hex digest of an id of any type and a text; nulls hash like empty strings.  Rows that share an id are told apart by their texts."""
    none = F.lit("")
    return F.md5(F.concat(F.coalesce(c.cast("string"), none), F.lit("\x00"), F.md5(F.coalesce(text, none).cast("binary"))).cast("binary"))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n_rows: int, n: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` joined ('inner' or 'left') with ``groups``, which has one row for each key and in ``n`` how many of the ``n_rows`` rows have it.

    Keys of a great share of the rows would each land in one task; they are few by their share, so they are joined by
    broadcast, and the rest by shuffle.  ``groups`` should be a stored table; its column ``n`` doesn't come along.
    """
    hot = max(HOT_ROWS, n_rows // HOT_KEYS)
    heavy = groups.where(F.col(n) > hot).drop(n)
    if heavy.limit(1).count() == 0:
        return rows.join(groups.drop(n), key, how)
    heavy = F.broadcast(heavy)  # HOT_KEYS rows at most
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(groups.where(F.col(n) <= hot).drop(n), key, how)
    return rows.join(heavy, key).unionByName(rest)


def numbered(df: DataFrame, keys: list[str], digest: str, ties: list[str], n_rows: int, out: str, extra: DataFrame | None = None) -> DataFrame:
    """Number the rows of each key from 0 in the order of (``digest``, ``ties``) without bringing a key into one task.

    ``keys`` are columns without nulls, ``digest`` is a hex string column.  Rows are cut into cells of (key, first k digits
    of the digest), with k growing with ``n_rows`` so that a cell of even a key with all rows stays small.  A cell's
    offset is a prefix sum over the counts of the cells before it; a row's number is that offset plus its rank within the
    cell.  ``extra`` has one row for each key; its columns come along.  Rows are shuffled once.
    """
    digits = max(1, math.ceil(math.log(max(1, n_rows / 200_000), 16)))
    df = df.withColumn("_cell", F.substring(digest, 1, digits))
    counts = df.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    offsets = offsets if extra is None else offsets.join(extra, keys)
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys, "_cell").orderBy(digest, *ties)))
    more = [c for c in offsets.columns if c not in (*keys, "_cell", "_off")]
    kept = [c for c in df.columns if c != "_cell"]
    return ranked.join(offsets, [*keys, "_cell"]).select(*kept, *more, (F.col("_off") + F.col("_rank") - 1).alias(out))
