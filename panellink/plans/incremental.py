"""Waves: new records linked to persons whose ids are frozen."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panellink.functions.constants import LINK_THRESHOLD, PROB_THRESHOLD
from panellink.functions.normalize import pick
from panellink.operators.blocking import same_org_candidate_pairs
from panellink.operators.closure import greedy_within
from panellink.operators.prepare import population_surname_weight
from panellink.operators.profile import build_person_profile
from panellink.plans.link import STAMPS, link_panel
from panellink.plans.xorg import comparable, scored_pairs
from panellink.sources.panel import PanelCols
from panellink.sources.scratch import settled


@dataclass
class WaveMatch:
    matched: DataFrame
    review: DataFrame
    unmatched: DataFrame
    report: DataFrame


@dataclass
class WaveResult:
    new_stamped: DataFrame
    review: DataFrame
    unmatched: DataFrame
    wave_id_map: DataFrame
    report: DataFrame


def match_to_profiles(wave: DataFrame, existing: DataFrame, weights: dict[str, float] | None = None, threshold: float = LINK_THRESHOLD, surname_weight: DataFrame | None = None, max_block_size: int | None = None) -> WaveMatch:
    """Match a wave's profiles to existing ones of the same organization, one to one, best score first.

    Pairs whose persons filed in the same year can't be one person: they go to review as invariant_collision, and legal pairs
    that lost their ends to a better one as ambiguous.  Surnames weigh by the population of both.
    """
    if "EMP_ID" not in wave.columns or "EMP_ID" not in existing.columns:
        raise ValueError("match_to_profiles: both sides need EMP_ID")
    if wave.select("EMP_ID").join(existing.select("EMP_ID"), "EMP_ID", "left_semi").limit(1).count():
        raise ValueError("match_to_profiles: ids of the wave and of the existing persons overlap; link the wave by itself")
    both = existing.unionByName(wave, allowMissingColumns=True)
    sw = population_surname_weight(both) if surname_weight is None else surname_weight
    p, sims, ready = comparable(both, sw)
    pairs, _ = same_org_candidate_pairs(existing, wave, max_block_size, p.join(both.select("EMP_ID", "years"), "EMP_ID"))
    scored = scored_pairs(ready(pairs), sims, weights, ["emp_a", "emp_b", "org", "years_a", "years_b"])
    above = settled(scored.where(F.col("score") >= threshold).select("org", "emp_a", "emp_b", "score", F.arrays_overlap("years_a", "years_b").alias("collides")), "wave-above")
    legal = above.where("NOT coalesce(collides, false)").select("org", "emp_a", "emp_b", "score")
    accepted = greedy_within(legal)
    anchors = existing.select(F.col("EMP_ID").alias("emp_a"), (F.col("EMP_ANCHOR") if "EMP_ANCHOR" in existing.columns else F.lit(None).cast("string")).alias("existing_emp_anchor"))
    matched = settled(accepted.join(anchors, "emp_a").select(F.col("emp_b").alias("wave_emp_id"), F.col("emp_a").alias("existing_emp_id"), "existing_emp_anchor", "score"), "wave-matched")
    taken = matched.select(F.col("existing_emp_id").alias("emp_a"), F.col("wave_emp_id").alias("emp_b"))
    reviewed = lambda d, reason: d.select(F.col("emp_b").alias("wave_emp_id"), F.col("emp_a").alias("existing_emp_id"), "score", F.lit(reason).alias("reason"))
    review = reviewed(legal.join(taken, ["emp_a", "emp_b"], "left_anti"), "ambiguous").unionByName(reviewed(above.where("collides"), "invariant_collision"))
    unmatched = wave.select("EMP_ID").join(matched.select(F.col("wave_emp_id").alias("EMP_ID")), "EMP_ID", "left_anti")
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    report = n(wave, "n_wave_persons").crossJoin(n(existing, "n_existing_persons")).crossJoin(n(pairs, "n_candidate_pairs")).crossJoin(n(matched, "n_matched")).crossJoin(n(unmatched, "n_new_persons"))
    report = report.crossJoin(n(above.where("collides"), "n_invariant_collisions")).crossJoin(n(review.where("reason = 'ambiguous'"), "n_ambiguous"))
    return WaveMatch(matched, review.orderBy(F.desc("score"), "wave_emp_id", "existing_emp_id"), unmatched, report)


def without_reloads(existing: DataFrame, new: DataFrame, cols: PanelCols) -> tuple[DataFrame, int]:
    """The rows of ``new`` whose native key isn't in ``existing`` (missing keys are equal), and how many were dropped."""
    keys = [c for c in (cols.object_id, cols.table_id)]
    spelled = [(pick(existing, k), pick(new, k)) for k in keys]
    if any(None in s for s in spelled):
        return new, 0
    e = existing.select(*[F.col(f"`{a}`").cast("string").alias(f"_k{k}") for k, (a, _) in enumerate(spelled)]).distinct()
    on = [F.col(f"`{b}`").cast("string").eqNullSafe(F.col(f"_k{k}")) for k, (_, b) in enumerate(spelled)]
    n = new.join(e, on, "left_semi").count()
    if n:
        warnings.warn(f"{n} wave row(s) repeat a native key of the existing panel and are dropped", stacklevel=3)
    return new.join(e, on, "left_anti"), n


def link_incremental(existing: DataFrame, new: DataFrame, cols: PanelCols | None = None, weights: dict[str, float] | None = None, method: str = "weighted", link_threshold: float = LINK_THRESHOLD, match_threshold: float = LINK_THRESHOLD, prob_threshold: float = PROB_THRESHOLD, surname_weight: DataFrame | None = None, max_block_size: int | None = None) -> WaveResult:
    """Stamp a wave of records: returning persons inherit their id and anchor, first-time persons keep their new ones.

    Existing ids never change.  Reloaded rows are dropped; the rest is linked by itself, profiled and matched.
    """
    for c in ("EMP_ID", "EMP_ANCHOR"):
        if c not in existing.columns:
            raise ValueError(f"link_incremental: the existing panel lacks {c}")
    cols = (cols or PanelCols()).found(existing)
    fresh, n_reload = without_reloads(existing, new, cols)
    linked = settled(link_panel(fresh.drop(*STAMPS), cols, weights, link_threshold, method, prob_threshold).panel, "wave-linked")
    old, own = settled(build_person_profile(existing, cols), "wave-existing"), settled(build_person_profile(linked, cols), "wave-profiles")
    m = match_to_profiles(own, old, weights, match_threshold, surname_weight, max_block_size)
    ids = own.select(F.col("EMP_ID").alias("wave"), "EMP_ANCHOR").join(m.matched, F.col("wave") == F.col("wave_emp_id"), "left")
    hit = F.col("existing_emp_id").isNotNull()
    ids = ids.select("wave", F.coalesce("existing_emp_id", "wave").alias("final_id"), F.when(hit, F.col("existing_emp_anchor")).otherwise(F.col("EMP_ANCHOR")).alias("final_anchor"), hit.alias("matched"))
    kept = [F.col(f"`{c}`") for c in fresh.columns if c not in STAMPS]
    joined = linked.join(ids, linked["EMP_ID"] == ids["wave"])
    stamped = joined.select(*kept, F.col("final_id").alias("EMP_ID"), F.col("final_anchor").alias("EMP_ANCHOR"))
    rows = joined.agg(F.count(F.lit(1)).alias("n_new_rows"), F.count(F.when(F.col("matched"), 1)).alias("n_rows_returning"), F.count(F.when(~F.col("matched"), 1)).alias("n_rows_first_time"))
    report = m.report.crossJoin(rows).withColumns({"n_reload_rows_dropped": F.lit(n_reload), "link_method": F.lit(method)})
    return WaveResult(stamped, m.review, m.unmatched, ids, report)
