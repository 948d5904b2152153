"""Filings to panels: authoritative filings, primary titles, places, membership classes and samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panellink.functions.normalize import column

#: What counts as a checked box.
YES = ("TRUE", "T", "1", "X", "Y", "YES")


def checked(c: Column) -> Column:
    return F.coalesce(F.upper(F.btrim(c.cast("string"))).isin(list(YES)), F.lit(False))


def resolve_filings(df: DataFrame, org: str = "ein", year: str = "taxyr", timestamp: str = "RETURN_TIME_STAMP", amended: str | None = "RETURN_AMENDED_X", object_id: str = "OBJECTID") -> DataFrame:
    """The rows of the one filing that counts for an organization and year: the latest, amended ones first, then by id."""
    f = df.select(column(df, org).alias("o"), column(df, year).alias("y"), F.coalesce(column(df, timestamp).cast("string"), F.lit("")).alias("t"), checked(column(df, amended)).alias("a"), column(df, object_id).alias("i")).where("i IS NOT NULL")
    winners = f.groupBy("o", "y").agg(F.max(F.struct("t", "a", "i"))["i"].alias("winner")).select("winner").distinct()
    return df.join(winners, column(df, object_id) == F.col("winner"), "left_semi")


def primary_titles(df: DataFrame, object_id: str = "OBJECTID", table_id: str = "TABLE_ID", order: str = "title_order", title: str = "title_standard") -> DataFrame:
    """One row for each person line of a filing: that of the first title (missing order: 1)."""
    rank = W.partitionBy(column(df, object_id), column(df, table_id)).orderBy(F.coalesce(column(df, order).cast("string").try_cast("double"), F.lit(1.0)), column(df, title))
    return df.withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_n")


def map_distinct(df: DataFrame, name: str, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Join what ``parse`` adds to the distinct values of a column back to its rows: each value is parsed once."""
    values = parse(df.select(name).distinct())
    return df.join(values.withColumnRenamed(name, "_value"), F.col(name).eqNullSafe(F.col("_value")), "left").drop("_value")


def zip_places(zip_county: DataFrame, county_place: DataFrame) -> DataFrame:
    """(zip, cbsa, share) over counties: shares of a ZIP that reaches a place through several counties add up."""
    code = lambda c: F.lpad(F.regexp_replace(c.cast("string"), "[^0-9]", ""), 5, "0")
    a = zip_county.select("zip", code(F.col("county")).alias("county"), F.col("share").cast("string").try_cast("double").alias("share"))
    b = county_place.select(code(F.col("county")).alias("county"), "cbsa").where("county IS NOT NULL").distinct()
    return a.join(b, "county").groupBy("zip", "cbsa").agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("share"))


def normalize_places(pairs: DataFrame, min_share: float = 0.5, drop: tuple[str, ...] = ("99999",)) -> DataFrame:
    """(zip, cbsa, share): five-digit codes, the largest share of each pair, at least ``min_share``."""
    pad = lambda c: F.lpad(F.nullif(F.regexp_replace(c.cast("string"), "[^0-9]", ""), F.lit("")), 5, "0")
    x = pairs.select(pad(F.col("zip")).alias("zip"), pad(F.col("cbsa")).alias("cbsa"), F.coalesce(F.col("share").cast("string").try_cast("double"), F.lit(0.0)).alias("share"))
    x = x.where(F.col("zip").isNotNull() & F.col("cbsa").isNotNull() & ~F.col("cbsa").isin(list(drop)))
    return x.groupBy("zip", "cbsa").agg(F.max("share").alias("share")).where(F.col("share") >= min_share)


def filing_place(filings: DataFrame, places: DataFrame, object_id: str = "OBJECTID") -> DataFrame:
    """(object id, org_cbsa): the place of the largest share of a filing's ZIP, ties by the lower code."""
    j = filings.select(object_id, "zip").join(places, "zip")
    return j.groupBy(object_id).agg(F.min(F.struct((-F.col("share")).alias("s"), F.col("cbsa").alias("c")))["c"].alias("org_cbsa"))


def membership_classes(filings: DataFrame, org: str = "ein", year: str = "taxyr", form: str | None = None) -> DataFrame:
    """One row for each organization: first and last year, spells, gaps, and its class in the panel's window.

    persistent, entrant, exit or transient by whether the first and last panel years are filed; seamless without gaps,
    else segmented; form_mix is 990, 990EZ or switcher where a form column is named.
    """
    d = filings.select(column(filings, org).cast("string").alias("org"), column(filings, year).cast("int").alias("y"), column(filings, form).cast("string").alias("form")).where("org IS NOT NULL AND y IS NOT NULL")
    ends = d.agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    years = d.select("org", "y").distinct().withColumn("d", F.lead("y").over(W.partitionBy("org").orderBy("y")) - F.col("y"))
    g = years.groupBy("org").agg(F.min("y").alias("panel_year_first"), F.max("y").alias("panel_year_last"), F.count(F.lit(1)).cast("int").alias("panel_year_count"), F.count(F.when(F.col("d") > 1, 1)).cast("int").alias("panel_gap_count"), F.coalesce(F.max(F.when(F.col("d") > 1, F.col("d") - 1)), F.lit(0)).alias("panel_gap_size_max"))
    if form:
        ez, full = F.count(F.when(F.col("form") == "990EZ", 1)), F.count(F.when(F.col("form") == "990", 1))
        g = g.join(d.groupBy("org").agg(F.when(ez == 0, "990").when(full == 0, "990EZ").otherwise("switcher").alias("form_mix")), "org")
    span = F.col("panel_year_last") - F.col("panel_year_first") + 1
    lo, hi = F.col("panel_year_first") == F.col("lo"), F.col("panel_year_last") == F.col("hi")
    out = g.crossJoin(F.broadcast(ends)).withColumns({
        "panel_type": F.when(lo & hi, "persistent").when(hi, "entrant").when(lo, "exit").otherwise("transient"), "span": span,
        "panel_spell": F.when(span == F.col("panel_year_count"), "seamless").otherwise("segmented"), "panel_gap_years": span - F.col("panel_year_count"),
    })
    return out.drop("lo", "hi")


def org_table(records: DataFrame, filings: DataFrame | None = None, org: str = "ein", year: str = "taxyr", name: str = "org_name", group: str | None = None) -> DataFrame:
    """One row for each organization: years, records, the latest name, and its share of linkage cost (records squared)."""
    per = records.groupBy(org, year).agg(F.count(F.lit(1)).alias("n"), F.max(column(records, name)).alias("nm"))
    g = per.groupBy(org).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count(F.lit(1)).alias("n_years"), F.sum("n").alias("n_records"), F.max("n").alias("max_records_year"), F.max_by("nm", year).alias("org_name"))
    if filings is not None and group:
        yes = checked(column(filings, group))
        g = g.join(filings.groupBy(org).agg(F.max(yes).alias("group_return"), F.sum(yes.cast("int")).alias("group_return_years"), F.min(yes).alias("group_return_all")), org, "left")
    cost = F.col("n_records").cast("double") * F.col("n_records")
    total = g.agg(F.sum(cost).alias("_total"))
    return g.withColumn("cost", cost).crossJoin(F.broadcast(total)).withColumn("cost_share", F.col("cost") / F.col("_total")).drop("_total")  # one row


def ntile_batches(df: DataFrame, n: int, org: str = "ein") -> DataFrame:
    """(organization, batch): whole organizations in ``n`` batches of near equal numbers, in the order of their ids.

    The order is over organizations, not records; their ids alone meet in one task.
    """
    return df.select(org).distinct().withColumn("batch", F.ntile(n).over(W.partitionBy(F.lit(1)).orderBy(org)))


def size_bin(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Left-closed bins: labels[0] below edges[0], then one more label for each edge; missing values are 'missing'."""
    out = F.lit(labels[0])
    for edge, label in zip(edges, labels[1:]):
        out = F.when(c >= edge, label).otherwise(out)
    return F.when(c.isNull(), "missing").otherwise(out)


def stratified_sample(df: DataFrame, strata: list[str], size: int, floor: int = 25, key: str = "ein", seed: str = "s") -> DataFrame:
    """A sample with about ``size`` rows, allocated by the square root of the strata's counts, at least ``floor`` each.

    Rows are drawn in the order of a keyed digest; ``weight`` is the stratum's rows over those drawn.
    """
    n = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_pop"))
    total = n.agg(F.sum(F.sqrt("_pop")).alias("_roots"))
    take = F.least(F.col("_pop"), F.greatest(F.lit(floor), F.round(F.lit(size) * F.sqrt("_pop") / F.col("_roots")).cast("long")))
    n = n.crossJoin(F.broadcast(total)).withColumn("_take", take).drop("_roots")  # one row
    on = [F.col(f"d.{s}").eqNullSafe(F.col(f"n.{s}")) for s in strata]
    j = df.alias("d").join(n.alias("n"), on).select("d.*", "n._pop", "n._take")
    draw = F.md5(F.concat_ws("\x00", F.lit(seed), F.col(key).cast("string")).cast("binary"))
    j = j.withColumn("_n", F.row_number().over(W.partitionBy(*strata).orderBy(draw, key)))
    return j.where("_n <= _take").withColumn("weight", F.col("_pop") / F.col("_take")).drop("_n", "_pop", "_take")


def person_groups(df: DataFrame, keys: list[str], any_of: dict[str, Column], sets: dict[str, str], sep: str = " | ") -> DataFrame:
    """Rows at person grain: whether any row has each mark, and the distinct values of ``sets`` (name to column), sorted."""
    return df.groupBy(*keys).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in any_of.items()], *[F.array_join(F.array_sort(F.collect_set(c)), sep).alias(n) for n, c in sets.items()])


def top_values(df: DataFrame, name: str, n: int = 20) -> DataFrame:
    """The ``n`` most frequent values of a column."""
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(n)
