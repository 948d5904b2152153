"""Longitudinal analytics of a linked panel: position transitions, churn and promotions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panellink.functions.normalize import as_year, column, pick, squished
from panellink.functions.roles import classify_title_role, match_position, role_rank
from panellink.functions.similarity import best_similarity, similarity
from panellink.sources.panel import PanelCols


def _rows(df: DataFrame, cols: PanelCols, emp_id: str, title: str) -> DataFrame:
    if emp_id not in df.columns:
        raise ValueError(f"no column {emp_id!r}; link the panel first")
    if pick(df, title) is None or pick(df, cols.year) is None:
        raise ValueError(f"the panel needs {title!r} and {cols.year!r}")
    text = lambda c: column(df, c).cast("string")
    return df.select(text(cols.org_id).alias("org"), as_year(text(cols.year)).alias("yr"), F.col(emp_id).cast("string").alias("id"), text(cols.name).alias("name"), text(title).alias("title"))


def flag_position_transitions(df: DataFrame, position=None, role=None, cols: PanelCols | None = None, emp_id: str = "EMP_ID", title: str = "title_standard", match: str = "exact", min_sim: float = 0.90, gap_tolerant: bool = False, overrides=None) -> DataFrame:
    """One row for each holder of a position in an organization and year.

    The year before is the organization's last filing year, or, ``gap_tolerant``, the last year in which the position was
    held.  ``incoming`` holders weren't there in it; ``transition`` marks those who come to a position that was held,
    with the ids that left as ``predecessor`` (sorted, joined by ;).
    """
    cols = cols or PanelCols()
    d = _rows(df, cols, emp_id, title)
    held = d.where(match_position(F.col("title"), position, role, match, min_sim, overrides)).where("org IS NOT NULL AND yr IS NOT NULL AND id IS NOT NULL")
    first = W.partitionBy("org", "yr", "id").orderBy("title", "name")
    held = held.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    seats = held.groupBy("org", "yr").agg(F.collect_set("id").alias("ids"))  # the holders of one position in one year
    timeline = seats.select("org", "yr") if gap_tolerant else d.where("org IS NOT NULL AND yr IS NOT NULL").select("org", "yr").distinct()
    before = timeline.withColumn("prev_year", F.lag("yr").over(W.partitionBy("org").orderBy("yr")))
    earlier = seats.select(F.col("org"), F.col("yr").alias("prev_year"), F.col("ids").alias("prev"))
    s = seats.join(before, ["org", "yr"]).join(earlier, ["org", "prev_year"], "left").withColumn("prev", F.coalesce("prev", F.array().cast("array<string>")))
    j = held.join(s, ["org", "yr"])
    incoming = ~F.array_contains("prev", F.col("id"))
    transition = incoming & (F.size("prev") > 0)
    gone = F.array_join(F.array_sort(F.array_except("prev", "ids")), ";")
    return j.select(
        F.col("org").alias(cols.org_id), F.col("yr").alias(cols.year), F.col("id").alias("EMP_ID"), "name", "title", "prev_year", (F.col("yr") - F.col("prev_year")).alias("years_since_prev"),
        F.size("ids").alias("n_holders"), F.size("prev").alias("n_prev_holders"), incoming.alias("incoming"), (~incoming).alias("continuing"), transition.alias("transition"),
        F.when(transition, F.nullif(gone, F.lit(""))).alias("predecessor"),
    ).orderBy(cols.org_id, cols.year, "EMP_ID")


def transitions_report(t: DataFrame, org: str = "ein") -> DataFrame:
    return t.agg(F.countDistinct(org).alias("n_orgs"), F.count(F.lit(1)).alias("n_holder_rows"), F.count(F.when(F.col("incoming"), 1)).alias("n_incoming"), F.count(F.when(F.col("transition"), 1)).alias("n_transitions"))


def position_churn(df: DataFrame, position=None, role=None, cols: PanelCols | None = None, id: str = "EMP_ID", title: str = "title_standard", by_org: bool = True, match: str = "exact", min_sim: float = 0.90, overrides=None) -> DataFrame:
    """Holders, arrivals, departures and rates of each group and year, from the first year in which the position is held.

    The group is the organization or, without ``by_org``, the panel.  Years are all years in which the group appears; the first row
    has no comparison, and later years without holders stay.  Pooled, holders are compared by one join on ids, not by
    sets, which would be as large as the panel.
    """
    cols = cols or PanelCols()
    d = _rows(df, cols, id, title).withColumn("grp", F.col("org") if by_org else F.lit("ALL")).where("grp IS NOT NULL AND yr IS NOT NULL AND id IS NOT NULL")
    years = d.select("grp", "yr").distinct().withColumn("next", F.lead("yr").over(W.partitionBy("grp").orderBy("yr")))
    held = d.where(match_position(F.col("title"), position, role, match, min_sim, overrides)).select("grp", "yr", "id").distinct()
    # each holding counts in its year, and is carried to the group's next year
    marks = held.join(years, ["grp", "yr"]).select("grp", "id", F.explode(F.array(F.struct(F.col("yr").alias("y"), F.lit(1).alias("now"), F.lit(0).alias("was")), F.struct(F.col("next").alias("y"), F.lit(0).alias("now"), F.lit(1).alias("was")))).alias("m"))
    marks = marks.select("grp", "id", "m.*").where("y IS NOT NULL").groupBy("grp", "y", "id").agg(F.max("now").alias("now"), F.max("was").alias("was"))
    n = marks.groupBy("grp", F.col("y").alias("yr")).agg(
        F.sum("now").cast("int").alias("n_current"), F.sum("was").cast("int").alias("n_prev"), F.sum(F.col("now") * F.col("was")).cast("int").alias("n_stable")
    )
    starts = held.groupBy("grp").agg(F.min("yr").alias("start"))
    j = years.join(starts, "grp").where("yr >= start").join(n, ["grp", "yr"], "left").na.fill(0, ["n_current", "n_prev", "n_stable"])
    later = F.col("yr") > F.col("start")
    only = lambda c: F.when(later, c)
    prev, stable, current = F.col("n_prev"), F.col("n_stable"), F.col("n_current")
    out = j.select(
        F.col("grp").alias(cols.org_id), F.col("yr").alias(cols.year), "n_current", only(current - stable).alias("n_new"), only(prev - stable).alias("n_left"), only(stable).alias("n_stable"),
        only(prev).alias("n_prev"), F.when(later & (prev > 0), stable / prev).alias("retention"), F.when(later & (current > 0), (current - stable) / current).alias("turnover"),
    )
    return out.orderBy(cols.org_id, cols.year) if by_org else out.drop(cols.org_id).orderBy(cols.year)


def churn_report(c: DataFrame, org: str | None = "ein") -> DataFrame:
    groups = F.countDistinct(org) if org else F.lit(1)
    return c.agg(F.count(F.lit(1)).alias("n_rows"), groups.alias("n_groups"), F.sum("n_new").alias("total_new"), F.sum("n_left").alias("total_left"))


def flag_promotions(df: DataFrame, cols: PanelCols | None = None, emp_id: str = "EMP_ID", title_standard: str = "title_standard", title_raw: str | None = "title_raw", comp: str | None = "tot_comp", min_sim: float = 0.85, comp_delta: float = 0.10, overrides=None) -> DataFrame:
    """One row for each change of a person's standard title between records of consecutive filed years.

    change_type is relabel (the titles are much alike), else oscillation (the new title was held before the prior year),
    else transient (the next year reverts), else real.  Real changes have a direction by pay (``comp_delta`` up or down), else by
    role rank, else lateral.  One record a year counts, the best paid.
    """
    cols = cols or PanelCols()
    d = _rows(df, cols, emp_id, title_standard)
    has_comp = pick(df, comp) is not None
    d = df.select(
        F.col(emp_id).cast("string").alias("id"), column(df, cols.org_id).cast("string").alias("org"), column(df, cols.name).cast("string").alias("name"), as_year(column(df, cols.year).cast("string")).alias("yr"),
        column(df, title_standard).cast("string").alias("std"), column(df, title_raw).cast("string").alias("raw"), column(df, comp).cast("string").try_cast("double").alias("comp"),
    )
    d = d.withColumns({"t": squished(F.col("std")), "r": squished(F.col("raw")), "role": classify_title_role(F.col("std"), overrides)}).where("id IS NOT NULL AND yr IS NOT NULL AND t IS NOT NULL")
    best = W.partitionBy("id", "yr").orderBy(F.desc_nulls_last("comp"), "std", "raw", "org", "name")
    one = d.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    line = W.partitionBy("id").orderBy("yr")
    prior = F.lag(F.struct("yr", "std", "raw", "comp", "role", "t", "r")).over(line)
    one = one.withColumns({"p": prior, "nxt": F.lead("t").over(line), "older": F.collect_list("t").over(line.rowsBetween(W.unboundedPreceding, -2))})
    c = one.where("p IS NOT NULL AND t <> p.t").withColumns({
        "sim_standard": similarity("jaro", F.col("p.t"), F.col("t")), "sim_raw": similarity("jaro", F.col("p.r"), F.col("r")), "up": best_similarity("jaro", F.col("older"), F.array("t")),
        "back": similarity("jaro", F.col("nxt"), F.col("p.t")), "on": similarity("jaro", F.col("nxt"), F.col("t")),
    })
    over = lambda name: F.coalesce(F.col(name), F.lit(-1.0)) >= min_sim
    kind = F.when(over("sim_standard") | over("sim_raw"), "relabel").when(over("up"), "oscillation").when(over("back") & ~over("on"), "transient").otherwise("real")
    change = F.col("comp") - F.col("p.comp")
    pct = F.when(F.col("p.comp") > 0, change / F.col("p.comp"))
    old, new = role_rank(F.col("p.role")), role_rank(F.col("role"))
    by_role = old.isNotNull() & new.isNotNull() & (old != new)
    real = F.col("change_type") == "real"
    direction = (
        F.when(pct >= comp_delta, "promotion").when(pct <= -comp_delta, "demotion").when(pct.isNotNull(), "lateral")
        .when(by_role & (new > old), "promotion").when(by_role, "demotion").otherwise("lateral")
    )
    basis = F.when(pct.isNotNull(), "comp").when(by_role, "role").otherwise("none")
    c = c.withColumn("change_type", kind)
    out = c.select(
        F.col("id").alias("EMP_ID"), F.col("org").alias(cols.org_id), "name", F.col("p.yr").alias("from_year"), F.col("yr").alias("to_year"), F.col("p.std").alias("from_title"), F.col("std").alias("to_title"),
        F.col("p.raw").alias("from_title_raw"), F.col("raw").alias("to_title_raw"), F.col("p.role").alias("from_role"), F.col("role").alias("to_role"), "sim_standard", "sim_raw",
        *([F.col("p.comp").alias("from_comp"), F.col("comp").alias("to_comp"), change.alias("comp_change"), pct.alias("comp_pct")] if has_comp else []),
        "change_type", F.when(real, direction).alias("direction"), F.when(real, basis).otherwise("none").alias("basis"),
    )
    return out.orderBy("EMP_ID", "to_year")


def promotions_report(p: DataFrame) -> DataFrame:
    """Counts by change_type and direction."""
    return p.groupBy("change_type", "direction").agg(F.count(F.lit(1)).alias("n")).orderBy("change_type", "direction")
