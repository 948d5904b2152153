"""Within-organization linkage across years: EMP_ID on every record."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panellink.functions.constants import LINK_THRESHOLD, PROB_THRESHOLD
from panellink.functions.ids import anchor_emp_id, anchor_key, anchor_order
from panellink.functions.normalize import as_year, column, pick
from panellink.operators.candidates import default_weights, score_pairs
from panellink.operators.closure import resolve_within
from panellink.operators.matching import counted_pairs, match_signatures, rounded, signatures, split_features, stored_pairs, weighed
from panellink.operators.prepare import prepare_panel
from panellink.plans.model import AGREE_CUTOFF, agreement, fit_match_model, late_evidence, log_odds, match_evidence
from panellink.sources.panel import PanelCols
from panellink.sources.scratch import settled

STAMPS = ("EMP_ID", "EMP_ANCHOR", "EMP_N_RECORDS", "EMP_N_YEARS", "EMP_LINK_CONF")


@dataclass
class LinkResult:
    """The stamped panel, the accepted edges, a one-row report and the fitted model, if any."""

    panel: DataFrame
    edges: DataFrame
    report: DataFrame
    model: Any = None

    def __str__(self) -> str:
        r = self.report.first().asDict()
        compression = 100 * (1 - r["n_clusters"] / r["n_records"]) if r["n_records"] else 0.0
        lines = [("records", r["n_records"]), ("organizations", r["n_orgs"]), ("years", ", ".join(map(str, r["years"]))), ("person clusters", r["n_clusters"]), ("  multi-year", r["n_multi_year"]), ("  singletons", r["n_singletons"]), ("accepted links", r["n_links"]), ("collisions blocked", r["rejected_edges"]), ("method", f"{r['method']} (>= {r['threshold']:g})"), ("panel compression", f"{compression:.1f}%")]
        return "linkage report\n" + "\n".join(f"{k:<19}: {v}" for k, v in lines)


def assign_emp_ids(members: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, EMP_ID, EMP_ANCHOR, EMP_N_RECORDS, EMP_N_YEARS) from rows with uid, year, object_id, table_id."""
    least = F.min(anchor_order(F.col("year"), F.col("object_id"), F.col("table_id"), F.col("uid")))
    years = F.countDistinct(F.coalesce(F.col("year").cast("string"), F.lit("NA")))
    g = members.groupBy(cluster).agg(least.alias("least"), F.count(F.lit(1)).cast("int").alias("EMP_N_RECORDS"), years.cast("int").alias("EMP_N_YEARS"))
    g = g.withColumn("EMP_ANCHOR", anchor_key(F.col("least")))
    return g.select(cluster, anchor_emp_id(F.col("EMP_ANCHOR")).alias("EMP_ID"), "EMP_ANCHOR", "EMP_N_RECORDS", "EMP_N_YEARS")


def link_panel(df: DataFrame, cols: PanelCols | None = None, weights: dict[str, float] | None = None, threshold: float = LINK_THRESHOLD, method: str = "weighted", prob_threshold: float = PROB_THRESHOLD) -> LinkResult:
    """Link the records of each organization across years.

    'weighted' accepts pairs that score ``threshold`` or more, 'em' pairs whose posterior under a fitted
    Fellegi-Sunter model is ``prob_threshold`` or more (and adds EMP_LINK_CONF, the least posterior inside a cluster).  Pairs
    never cross organizations; a cluster never has two records of one organization and year.  Records without organization or
    year stay single.
    """
    if method not in ("weighted", "em"):
        raise ValueError(f"unknown method {method!r}")
    cols = cols or PanelCols()
    weights = weights or default_weights()
    keyed, work, feats = prepare_panel(df, cols)
    model = None
    used = [f for f in weights if f in work.columns] if method == "weighted" else feats
    stable, late = split_features(used)
    records, pairs = signatures(work, used)
    if method == "weighted":
        weight = weights[late] if late else 0.0
        base = score_pairs({f: F.col(f) for f in stable}, weights, F.col("surname_w_x"), F.col("surname_w_y"))
        near = pairs.withColumn("base", base).where(F.col("base") >= threshold - abs(weight) - 1e-9)
        matched = match_signatures(records, stored_pairs(near, "base"), weighed(weight), rounded, threshold)
    else:
        held = stored_pairs(pairs, *stable)
        agree = held.select("org", "s_x", "s_y", *[(F.col(f) >= AGREE_CUTOFF).cast("double").alias(f) for f in stable])
        counts = settled(counted_pairs(records, agree, stable, late or "_late", agreement(AGREE_CUTOFF)), "agreement")
        model = fit_match_model(counts, "em", agree_cutoff=AGREE_CUTOFF, feats=feats, weight="n")
        part = late_evidence(model, late)
        near = held.withColumn("base", match_evidence(model, stable)).where(F.col("base") >= log_odds(prob_threshold) - part(np.array([1.0, 0.0, np.nan])).max() - 1e-6)
        matched = match_signatures(records, near, part, lambda odds: rounded(1 / (1 + np.exp(-odds))), prob_threshold)
    resolved = settled(resolve_within(matched), "resolved")
    edges = resolved.where("uid IS NULL").select("row_x", "row_y", "score", "yr_x", "yr_y", "org")
    clusters = resolved.where("uid IS NOT NULL").select("uid", "cluster")
    members = work.select("uid", "org", "year", "object_id", "table_id").join(clusters, "uid", "left").withColumn("cluster", F.coalesce("cluster", "uid"))
    ids = assign_emp_ids(members)
    stamps = members.select("uid", "cluster").join(ids, "cluster")
    if method == "em":
        inside = edges.join(clusters.select(F.col("uid").alias("row_x"), F.col("cluster").alias("cx")), "row_x").join(clusters.select(F.col("uid").alias("row_y"), F.col("cluster").alias("cy")), "row_y")
        confidence = inside.where("cx = cy").groupBy(F.col("cx").alias("cluster")).agg(F.min("score").alias("EMP_LINK_CONF"))
        stamps = stamps.join(confidence, "cluster", "left")
    stamps = settled(stamps.drop("cluster"), "stamps")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in STAMPS]
    names = [c for c in STAMPS if c in stamps.columns]
    panel = keyed.join(stamps, keyed["_uid"] == stamps["uid"]).select(*kept, *[stamps[c] for c in names])

    n = work.agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("org").alias("n_orgs"), F.countDistinct("year").alias("n_years"), F.array_sort(F.collect_set("year")).alias("years"))
    c = ids.agg(
        F.count(F.lit(1)).alias("n_clusters"), F.coalesce(F.sum((F.col("EMP_N_RECORDS") == 1).cast("long")), F.lit(0)).alias("n_singletons"),
        F.coalesce(F.sum((F.col("EMP_N_RECORDS") > 1).cast("long")), F.lit(0)).alias("n_multi_year"),
    )
    links = resolved.agg(F.count(F.when(F.col("uid").isNull(), 1)).alias("n_links"), F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected_edges"))
    report = n.crossJoin(c).crossJoin(links)  # one row each
    report = report.withColumns({"method": F.lit(method), "threshold": F.lit(float(threshold if method == "weighted" else prob_threshold)), "compression": 1 - F.col("n_clusters") / F.col("n_records")})
    return LinkResult(panel, edges, report, model)


def remint_anchored(df: DataFrame, cols: PanelCols | None = None, emp_id: str = "EMP_ID") -> tuple[DataFrame, DataFrame]:
    """(the panel with anchored ids for its existing clusters, crosswalk of old_emp_id, new_emp_id, emp_anchor)."""
    cols = (cols or PanelCols()).found(df)
    if emp_id not in df.columns:
        raise ValueError(f"remint_anchored: no column {emp_id!r}")
    title = "title_standard" if pick(df, "title_standard") else cols.name
    from panellink.functions.ids import with_record_key

    keyed = with_record_key(df, cols.org_id, cols.year, cols.name, title, "_uid", pick(df, cols.object_id), pick(df, cols.table_id))
    order = anchor_order(as_year(column(df, cols.year).cast("string")), column(df, pick(df, cols.object_id)), column(df, pick(df, cols.table_id)), F.col("_uid"))
    least = keyed.groupBy(F.col(emp_id).alias("old_emp_id")).agg(F.min(order).alias("least")).withColumn("emp_anchor", anchor_key(F.col("least")))
    walk = least.select("old_emp_id", anchor_emp_id(F.col("emp_anchor")).alias("new_emp_id"), "emp_anchor")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (emp_id, "EMP_ANCHOR")]
    panel = df.join(walk, df[emp_id].eqNullSafe(walk["old_emp_id"])).select(*kept, F.col("new_emp_id").alias(emp_id), F.col("emp_anchor").alias("EMP_ANCHOR"))
    return panel, walk
