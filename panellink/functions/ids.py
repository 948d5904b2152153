"""Ids: readable record keys, native-key ids, anchored person ids and batch ids, all from MD5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panellink.functions.normalize import as_year, column, pick, trimmed


def _part(c: Column) -> Column:
    return F.upper(F.regexp_replace(trimmed(F.coalesce(c.cast("string"), F.lit(""))), r"\s+", "-"))


def with_record_key(df: DataFrame, org: str, year: str, name: str, title: str | None, out: str = "_uid", object_id: str | None = None, table_id: str | None = None) -> DataFrame:
    """Add a readable unique key: EIN-..-Y-..-NAME-..-TITLE-.., with -Dk for the k-th record of a key.

    Records of a key are counted in the order of their native keys and then of a digest of the row, so equal rows
    are interchangeable and nothing depends on partitioning.
    """
    year_text = F.coalesce(column(df, year).cast("string"), F.lit(""))
    base = F.concat(F.lit("EIN-"), _part(column(df, org)), F.lit("-Y-"), year_text, F.lit("-NAME-"), _part(column(df, name)), F.lit("-TITLE-"), _part(column(df, title)))
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    keyed = df.withColumn("_base", base).withColumn("_order", F.struct(column(df, object_id).alias("o"), column(df, table_id).alias("t"), row.alias("r")))
    nth = F.row_number().over(W.partitionBy("_base").orderBy("_order"))
    return keyed.withColumn(out, F.when(nth > 1, F.concat("_base", F.lit("-D"), nth.cast("string"))).otherwise(F.col("_base"))).drop("_base", "_order")


def build_id_string(df: DataFrame, org_id: str = "ein", year: str = "taxyr", name: str = "name", title: str = "title_standard", out: str = "id_string") -> DataFrame:
    missing = [c for c in (org_id, year, name) if pick(df, c) is None]
    if missing:
        raise ValueError(f"build_id_string: missing column(s) {', '.join(missing)}")
    return with_record_key(df, org_id, year, name, title, out, "object_id", "table_id")


def _pasted(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("NA"))


def person_year_id(object_id: Column, table_id: Column, keyspec: str = "v1") -> Column:
    key = F.concat(F.lit(keyspec + "|"), _pasted(object_id), F.lit("|"), _pasted(table_id))
    return F.concat(F.lit("PYID-"), F.md5(key.cast("binary")))


def create_emp_ids(key: Column) -> Column:
    """EMP- and eight groups of four hex digits."""
    return F.concat(F.lit("EMP-"), F.regexp_replace(F.upper(F.md5(key.cast("binary"))), r"(.{4})(?!$)", "$1-"))


def anchor_emp_id(anchor: Column, keyspec: str = "v1") -> Column:
    return create_emp_ids(F.concat(F.lit(f"ANCHOR|{keyspec}|"), anchor))


def anchor_xorg_id(emp_id: Column, keyspec: str = "v1") -> Column:
    digest = F.md5(F.concat(F.lit(f"XANCHOR|{keyspec}|"), emp_id).cast("binary"))
    return F.concat(F.lit("XORG-"), F.upper(F.substring(digest, 1, 12)))


def anchor_order(year: Column, object_id: Column, table_id: Column, uid: Column) -> Column:
    """Structs whose minimum is the anchor record of a cluster: by year, native keys and record key, nulls last."""
    y, o, t = as_year(year.cast("string")), object_id.cast("string"), table_id.cast("string")
    return F.struct(y.isNull().alias("ny"), y.alias("y"), o.isNull().alias("no"), o.alias("o"), t.isNull().alias("nt"), t.alias("t"), uid.alias("u"))


def anchor_key(least: Column, keyspec: str = "v1") -> Column:
    """The anchor key of the record that ``anchor_order`` put first: its native-key id, or its record key."""
    native = (F.coalesce(least["o"], F.lit("")) != "") & (F.coalesce(least["t"], F.lit("")) != "")
    return F.when(native, person_year_id(least["o"], least["t"], keyspec)).otherwise(least["u"])


def batch_id(key: Column, n_batches: int = 100, method: str = "hash") -> Column:
    """'digits': the last digits of the key (``n_batches`` a power of ten); 'hash': 28 bits of MD5 modulo ``n_batches``."""
    if n_batches < 1:
        raise ValueError("batch_id: n_batches must be a positive integer")
    width = len(str(n_batches - 1))
    text = key.cast("string")
    if method == "digits":
        if 10 ** (len(str(n_batches)) - 1) != n_batches or n_batches == 1:
            raise ValueError("batch_id: method 'digits' needs a power of ten")
        return F.substring(text, -width, width)
    return F.lpad((F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long") % n_batches).cast("string"), width, "0")


def batch_method(df: DataFrame, key: str, n_batches: int, method: str = "auto") -> str:
    """Check keys and settle 'auto': 'digits' if ``n_batches`` is a power of ten and all keys end in enough digits."""
    k = len(str(n_batches)) - 1
    power = n_batches > 1 and 10**k == n_batches
    text = F.col(f"`{key}`").cast("string")
    bad, ends = df.agg(
        F.count(F.when(text.isNull() | (text == ""), 1)), F.bool_and(F.coalesce(text.rlike(f"[0-9]{{{max(k, 1)}}}$"), F.lit(False)))
    ).first()
    if bad:
        raise ValueError("batch_id: key has missing or empty values")
    if method == "digits" and not (power and ends):
        raise ValueError("batch_id: method 'digits' needs a power of ten and keys that end in digits")
    return ("digits" if power and ends else "hash") if method == "auto" else method
