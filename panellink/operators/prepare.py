"""From a raw panel to the working frame of the linker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panellink.functions.ids import with_record_key
from panellink.functions.normalize import as_year, column, feature, pick, trimmed
from panellink.sources.panel import PanelCols

_NONE = "\x00"


def surname_weight(df: DataFrame, org_id: str = "ein", name: str = "name", last_name: str = "last_name", out: str = "surname_w") -> DataFrame:
    """Add how telling a record's surname is in its organization: log(names / names with it) / log(names), within 0 and 1.

    Names are distinct upper-case full names; organizations of one name weigh 1.  Missing values are a value.
    """
    key = lambda c: F.coalesce(c, F.lit(_NONE))
    d = df.withColumn("_o", key(column(df, org_id).cast("string"))).withColumn("_l", key(F.upper(trimmed(column(df, last_name)))))
    names = d.select("_o", "_l", key(F.upper(trimmed(column(df, name)))).alias("_n"))
    per_org = names.groupBy("_o").agg(F.countDistinct("_n").alias("dp"))
    per_last = names.groupBy("_o", "_l").agg(F.countDistinct("_n").alias("cnt"))
    share = F.ln(F.col("dp") / F.col("cnt")) / F.ln("dp")
    weight = F.when(F.col("dp") <= 1, F.lit(1.0)).otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))
    weights = per_last.join(per_org, "_o").select("_o", "_l", weight.alias(out))
    return d.join(weights, ["_o", "_l"]).drop("_o", "_l")


def population_surname_weight(profiles: DataFrame, last_name: str = "last_name") -> DataFrame:
    """(last_name, weight): log(N / n) / log(N) over persons with a surname, within 0 and 1; 1 if there is one person."""
    s = profiles.select(feature(column(profiles, last_name)).alias("last_name")).where("last_name IS NOT NULL")
    n = s.groupBy("last_name").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("persons"))
    weight = F.when(F.col("persons") <= 1, F.lit(1.0)).otherwise(F.least(F.greatest(F.ln(F.col("persons") / F.col("n")) / F.ln("persons"), F.lit(0.0)), F.lit(1.0)))
    return n.crossJoin(F.broadcast(total)).select("last_name", weight.alias("weight"))  # total is one row


def prepare_panel(df: DataFrame, cols: PanelCols | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(the panel with its record key _uid, the working frame, the features).

    The working frame has uid, org, year, name, object_id, table_id, surname_w and the features in upper case with
    blanks as null; gender U and UNKNOWN are null.
    """
    cols = (cols or PanelCols()).found(df)
    feats = cols.check(df)
    title = "title_standard" if pick(df, "title_standard") else cols.name
    keyed = with_record_key(df, cols.org_id, cols.year, cols.name, title, "_uid", pick(df, cols.object_id), pick(df, cols.table_id))
    work = keyed.select(
        F.col("_uid").alias("uid"), column(df, cols.org_id).cast("string").alias("org"), as_year(column(df, cols.year).cast("string")).alias("year"),
        F.upper(trimmed(column(df, cols.name))).alias("name"), *[feature(column(df, f)).alias(f.replace(".", "_")) for f in feats],
        column(df, pick(df, cols.object_id)).cast("string").alias("object_id"), column(df, pick(df, cols.table_id)).cast("string").alias("table_id"),
    )
    names = [f.replace(".", "_") for f in feats]
    if "gender" in names:
        work = work.withColumn("gender", F.when(~F.col("gender").isin("U", "UNKNOWN"), F.col("gender")))
    work = surname_weight(work, "org", "name", "last_name" if "last_name" in names else "name")
    return keyed, work, names
