"""Evaluation of linkage: sweeps, scorecards, record checks, name relations and review evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window as W

from panellink.functions.constants import GENERATIONS, LINK_THRESHOLD, SURNAME_PARTICLES, nickname_table
from panellink.functions.normalize import as_year, column, feature
from panellink.functions.similarity import jaro, osa_distance, similarity
from panellink.operators.candidates import default_weights, score_pairs
from panellink.operators.matching import counted_pairs, rounded, signatures, split_features, stored_pairs, weighed
from panellink.operators.prepare import population_surname_weight, prepare_panel
from panellink.operators.profile import first_name_roots, modal, surname_blocking_keys
from panellink.operators.review import flag_anomalies, flag_links
from panellink.plans.xorg import score_candidate_pairs
from panellink.sources.panel import PanelCols
from panellink.sources.scratch import settled

# --- fixed values ---------------------------------------------------------------------------------------------------

#: Words of a title that say nothing about who holds it.
GENERIC_TITLE_WORDS = (
    "BOARD MEMBER MEMBERS DIRECTOR DIRECTORS TRUSTEE TRUSTEES AT LARGE EX OFFICIO VOTING GOVERNOR GOVERNORS COUNCIL COMMITTEE ADVISORY OF THE"
).split()
CORE_PARTICLES = [*SURNAME_PARTICLES, "SAINT", "O"]
WINKLER, WINKLER_MIN = 0.1, 0.9

#: Category, label and meaning of the hard-case library.
HARD_CASES = """
co_present_homonym|expected_different|same name, two people of one organization in the same years
suffix_conflict|expected_different|matched pair with different generational suffixes
corroborated_surname_variant|expected_same|different surnames, two or more other shared board members
married_name_change|likely_same|a record ends and one with the same first name, title and pay and a new surname starts
within_org_two_surnames|likely_different|one record with two established surnames that aren't variants
cross_org_surname_different|likely_different|matched pair with two established surnames
cross_org_first_name_different|likely_different|matched pair with two established first names
middle_initial_conflict|likely_different|matched pair with different middle initials
first_initial_only|uncertain|one side gives only an initial
suffix_jr_vs_ii|uncertain|JR on one side, II on the other
pooled_variant_only|uncertain|match found only through a pooled name variant
within_org_suffix_conflict|expected_different|one record with two generational suffixes
within_org_two_first_names|likely_different|one record with two established first names
within_org_gender_mixed|likely_different|one record with rows of both genders
within_org_two_rows_one_year|likely_different|two rows in one year with different names or titles
particle_variant|likely_same|surnames differ by a particle or MAC and MC
rare_name_match|likely_same|identical rare name and agreeing middle initial
same_first_name_succession|likely_different|a seat passes to another person of the same first name
"""


def hard_case_categories() -> list[tuple[str, str, str]]:
    return [tuple(line.split("|")) for line in HARD_CASES.strip().splitlines()]


def hard_cases(cases: DataFrame, profiles: DataFrame, category: str, basis: str, region: str = "") -> DataFrame:
    """Rows (emp_a[, emp_b, score, detail]) in the library's layout, with both sides' forms, organizations and years."""
    label = {c: lab for c, lab, _ in hard_case_categories()}[category]
    for c, t in (("emp_b", "string"), ("score", "double"), ("detail", "string")):
        cases = cases if c in cases.columns else cases.withColumn(c, F.lit(None).cast(t))
    years = F.when(F.size("years") > 0, F.concat_ws("-", F.array_min("years").cast("string"), F.array_max("years").cast("string")))
    p = profiles.select("EMP_ID", F.array_join("name_variants", " / ").alias("forms"), F.get("orgs", F.lit(0)).alias("ein"), years.alias("years"))
    side = lambda s: p.select(F.col("EMP_ID").alias(f"emp_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("forms", "ein", "years")])
    j = cases.join(side("a"), "emp_a", "left").join(side("b"), "emp_b", "left")
    case = F.concat_ws("-", F.lit(category), F.lit(region), F.substring(F.md5(F.concat_ws("|", "emp_a", "emp_b").cast("binary")), 1, 10))
    return j.select(case.alias("case_id"), F.lit(category).alias("category"), F.lit(label).alias("label"), F.lit(basis).alias("label_basis"), "emp_a", "emp_b", F.round("score", 2).alias("score"), "forms_a", "ein_a", "years_a", "forms_b", "ein_b", "years_b", "detail")


# --- sweeps ------------------------------------------------------------------------------------------------------------


def silver_labels(scores: DataFrame) -> DataFrame:
    """Add last_sim, first_rel and label (1, 0 or null for unsure) to candidate scores, from their raw names alone."""
    text = lambda c: F.coalesce(F.upper(F.btrim(F.col(c))), F.lit("")) if c in scores.columns else F.lit("")
    fx, fy, lx, ly, sx, sy = (text(c) for c in ("first_name_x", "first_name_y", "last_name_x", "last_name_y", "suffix_x", "suffix_y"))
    root = F.arrays_overlap(first_name_roots(F.array(fx)), first_name_roots(F.array(fy))) & (fx != fy)
    d = scores.withColumns({"last_sim": similarity("jaro", lx, ly), "_fs": similarity("jaro", fx, fy)})
    initial = ((F.length(fx) == 1) | (F.length(fy) == 1)) & (F.substring(fx, 1, 1) == F.substring(fy, 1, 1))
    rel = F.when(initial, "maybe").when(((fx == fy) & (fx != "")) | root | (F.col("_fs") >= 0.90), "yes").when(F.col("_fs") < 0.70, "no").otherwise("maybe")
    d = d.withColumn("first_rel", rel)
    near, far = F.col("last_sim") >= 0.90, F.col("last_sim") < 0.80
    label = F.when((sx != "") & (sy != "") & (sx != sy), 0).when((near | far) & (F.col("first_rel") == "no"), 0).when(near & (F.col("first_rel") == "yes"), 1)
    return d.withColumn("label", label).drop("_fs")


def silver_score_counts(df: DataFrame, cols: PanelCols | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(label, score, n): the candidate pairs of a panel counted by silver label and score.

    Labels speak of names alone, so a pair of signatures has one; scores are counted for classes, without a row for each pair.
    """
    _, work, _ = prepare_panel(df, cols)
    weights = weights or default_weights()
    feats = [f for f in weights if f in work.columns]
    stable, late = split_features(feats)
    records, pairs = signatures(work, feats)
    base = score_pairs({f: F.col(f) for f in stable}, weights, F.col("surname_w_x"), F.col("surname_w_y"))
    held = stored_pairs(silver_labels(pairs.withColumn("base", base)), "base", F.col("label").cast("double").alias("label"))
    part = weighed(weights[late] if late else 0.0)
    counts = counted_pairs(records, held, ["label"], "score", lambda c, sim: rounded(c["base"] + part(sim)))
    return settled(counts.select(F.col("label").cast("int").alias("label"), "score", "n"), "score-counts")


def threshold_sweep(scored: DataFrame, label: str = "label", score: str = "score", step: float = 0.25, weight: str | None = None) -> DataFrame:
    """(threshold, TP, FP, FN, TN, precision, recall, f1) on a grid over the scores.

    Scores are counted by grid cell first, so the grid meets at most as many cells as it has steps.  ``weight`` names how many pairs a row stands for.
    """
    k = F.col(weight) if weight else F.lit(1)
    cell = F.floor(F.col(score) / step).cast("long")
    n = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(cell.alias("cell")).agg(F.sum((F.col(label) == 1).cast("long") * k).alias("pos"), F.sum((F.col(label) == 0).cast("long") * k).alias("neg"))
    after = W.partitionBy(F.lit(1)).orderBy(F.desc("cell"))  # one row for each grid cell
    every = W.partitionBy(F.lit(1))
    c = n.select("cell", F.sum("pos").over(after).alias("TP"), F.sum("neg").over(after).alias("FP"), F.sum("pos").over(every).alias("P"), F.sum("neg").over(every).alias("N"))
    c = c.select((F.col("cell") * step).alias("threshold"), "TP", "FP", (F.col("P") - F.col("TP")).alias("FN"), (F.col("N") - F.col("FP")).alias("TN"))
    p, r = F.try_divide(F.col("TP"), F.col("TP") + F.col("FP")), F.try_divide(F.col("TP"), F.col("TP") + F.col("FN"))
    return c.withColumns({"precision": p, "recall": r}).withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_thresholds(sweep: DataFrame, least_precision: float = 0.99) -> DataFrame:
    """One row: the threshold of the greatest f1 (ties: the lowest) and the lowest one with the precision asked for."""
    return sweep.agg(F.min_by("threshold", F.struct(-F.col("f1"), "threshold")).alias("best_f1"), F.max("f1").alias("f1"), F.min(F.when(F.col("precision") >= least_precision, F.col("threshold"))).alias("high_precision"))


def score_quantiles(scored: DataFrame, label: str = "label", score: str = "score", at: tuple[float, ...] = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99), weight: str | None = None) -> DataFrame:
    """Quantiles of scores by label; ``weight`` names how many pairs a row stands for."""
    return scored.where(F.col(label).isNotNull()).groupBy(label).agg(*[F.percentile(score, q, F.col(weight) if weight else 1).alias(f"q{round(100 * q):02d}") for q in at])


def pair_quality(panel: DataFrame, truth: str, emp_id: str = "EMP_ID", org: str = "ein") -> DataFrame:
    """One row: pairwise precision and recall of ids against a truth column, within organizations, from counts alone."""
    d = panel.groupBy(column(panel, org).alias("o"), F.col(emp_id).alias("e"), F.col(truth).alias("t")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    two = lambda c: c * (c - 1) / 2
    both = d.agg(F.sum(two(F.col("n"))).alias("both"))
    linked = d.groupBy("o", "e").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("linked"))
    true = d.groupBy("o", "t").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("true"))
    j = both.crossJoin(linked).crossJoin(true)  # one row each
    return j.select("both", "linked", "true", F.try_divide("both", "linked").alias("precision"), F.try_divide("both", "true").alias("recall"))


# --- scorecard -----------------------------------------------------------------------------------------------------------


def linkage_summary(panel: DataFrame, emp_id: str = "EMP_ID", org: str = "ein", year: str = "taxyr", by: Column | None = None) -> DataFrame:
    """Section A: records, persons, compression, persons in several years and their median years, organizations; by group."""
    grp = (by if by is not None else F.lit("all")).alias("grp")
    d = panel.select(grp, F.col(emp_id).alias("e"), column(panel, org).alias("o"), as_year(column(panel, year).cast("string")).alias("y"))
    p = d.groupBy("grp", "e").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("y").alias("years"))
    per_year = d.groupBy("grp", "e", "y").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.avg((F.col("n") > 1).cast("double")).alias("share_repeated_in_year"))
    s = p.groupBy("grp").agg(
        F.sum("n").alias("records"), F.count(F.lit(1)).alias("persons"), F.avg((F.col("years") > 1).cast("double")).alias("share_multi_year"), F.median(F.when(F.col("years") > 1, F.col("years"))).alias("median_years")
    )
    orgs = d.groupBy("grp").agg(F.countDistinct("o").alias("orgs"))
    return s.withColumn("compression", 1 - F.col("persons") / F.col("records")).join(orgs, "grp").join(per_year, "grp")


def same_next_year(panel: DataFrame, mark: Column, emp_id: str = "EMP_ID", org: str = "ein", year: str = "taxyr") -> DataFrame:
    """Section D: organizations and years with a marked holder in the next year too, and the share that keeps one."""
    d = panel.where(mark).select(column(panel, org).alias("o"), as_year(column(panel, year).cast("string")).alias("y"), F.col(emp_id).alias("e")).distinct()
    s = d.groupBy("o", "y").agg(F.collect_set("e").alias("es"))
    nxt = s.select("o", (F.col("y") - 1).alias("y"), F.col("es").alias("after"))
    return s.join(nxt, ["o", "y"]).agg(F.count(F.lit(1)).alias("n"), F.avg(F.arrays_overlap("es", "after").cast("double")).alias("kept"))


def linkage_accuracy(holders: DataFrame, org: str = "ein", year: str = "taxyr") -> DataFrame:
    """Section B: named officers (org, year, EMP_ID, first, last): how often the same name next year has the same id, and how often another has."""
    d = holders.select(F.col(org).alias("o"), F.col(year).alias("y"), "EMP_ID", "first", "last")
    n = d.select("o", (F.col("y") - 1).alias("y"), F.col("EMP_ID").alias("e1"), F.col("first").alias("f1"), F.col("last").alias("l1"))
    j = d.join(n, ["o", "y"])
    same = (F.col("first") == F.col("f1")) & (F.col("last") == F.col("l1"))
    other = (F.col("last") != F.col("l1")) & (F.substring("first", 1, 1) != F.substring("f1", 1, 1))
    one = (F.col("EMP_ID") == F.col("e1")).cast("double")
    return j.agg(F.count(F.when(same, 1)).alias("n_same"), F.avg(F.when(same, one)).alias("recall"), F.count(F.when(other, 1)).alias("n_different"), F.avg(F.when(other, one)).alias("false_merge"))


def board_size_check(panel: DataFrame, seats: Column, reported: DataFrame, filing: str = "OBJECTID") -> DataFrame:
    """Section C: filings whose seats equal the reported voting members (filing, vote), are within two, and the median difference."""
    b = panel.groupBy(filing).agg(F.sum(F.coalesce(seats, F.lit(False)).cast("int")).alias("seats")).join(reported, filing).where("vote IS NOT NULL")
    d = F.col("seats") - F.col("vote")
    return b.agg(F.count(F.lit(1)).alias("n"), F.avg((d == 0).cast("double")).alias("equal"), F.avg((F.abs(d) <= 2).cast("double")).alias("within_2"), F.median(d).alias("median_difference"))


def review_counts(panel: DataFrame, **names) -> DataFrame:
    """Section E: persons by review category of both scans."""
    a = flag_links(panel, **names).where("category IS NOT NULL").select(F.lit("flag_links").alias("source"), "category", "emp_id")
    b = flag_anomalies(panel, **names).where("category IS NOT NULL").select(F.lit("flag_anomalies").alias("source"), "category", "emp_id")
    return a.unionByName(b).groupBy("source", "category").agg(F.countDistinct("emp_id").alias("persons"))


# --- record checks -------------------------------------------------------------------------------------------------------


def record_checks(panel: DataFrame, emp_id: str = "EMP_ID", org: str = "ein", year: str = "taxyr", title: str = "title_standard") -> DataFrame:
    """(check, records): persons whose record holds two rows in a year, two generational suffixes, or both genders."""
    text = lambda c: feature(column(panel, c))
    d = panel.select(F.col(emp_id).alias("e"), column(panel, org).alias("o"), as_year(column(panel, year).cast("string")).alias("y"), F.concat_ws("|", *[F.coalesce(text(c), F.lit("")) for c in ("first_name", "middle_name", "last_name", "suffix")]).alias("nm"), F.coalesce(text(title), F.lit("")).alias("t"), text("suffix").alias("sx"), text("gender").alias("g"))
    y = d.groupBy("e", "o", "y").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("nm").alias("nms"), F.countDistinct("t").alias("ts")).where("n > 1")
    twice = y.select("e", F.when((F.col("nms") == 1) & (F.col("ts") == 1), "two rows in one year: duplicate").otherwise("two rows in one year: differing").alias("check")).distinct()
    p = d.groupBy("e").agg(F.collect_set(F.when(F.col("sx").isin(GENERATIONS), F.col("sx"))).alias("sxs"), F.collect_set("g").alias("gs"))
    both = F.size(F.array_except("sxs", F.array(F.lit("JR"), F.lit("II")))) > 0
    found = p.select("e", F.explode(F.array(F.when((F.size("sxs") > 1) & both, F.lit("suffix conflict")), F.when(F.size("gs") > 1, F.lit("gender mixed")))).alias("check")).where("check IS NOT NULL")
    return twice.unionByName(found).groupBy("check").agg(F.countDistinct("e").alias("records"))


def first_name_conflicts(panel: DataFrame, emp_id: str = "EMP_ID", least: int = 5) -> DataFrame:
    """(EMP_ID, a, b): two established given names (``least`` persons each) of one record that aren't forms of one another."""
    d = panel.select(F.col(emp_id).alias("e"), feature(column(panel, "first_name")).alias("f")).where(F.length("f") > 1).distinct()
    common = d.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("f")
    d = d.join(common, "f")
    p = d.alias("a").join(d.alias("b"), F.expr("a.e = b.e AND a.f < b.f")).select(F.col("a.e").alias("EMP_ID"), F.col("a.f").alias("a"), F.col("b.f").alias("b"))
    p = p.withColumns({"r": first_relation(F.col("a"), F.col("b")), "s": similarity("first", F.col("a"), F.col("b"))})
    return p.where("r IN ('different', 'unrelated') AND s < 0.8").select("EMP_ID", "a", "b")


def surname_switches(panel: DataFrame, emp_id: str = "EMP_ID", year: str = "taxyr") -> DataFrame:
    """(EMP_ID, old, new): records with two surnames, one used only before the other, that aren't spellings of one."""
    d = panel.select(F.col(emp_id).alias("e"), feature(column(panel, "last_name")).alias("l"), as_year(column(panel, year).cast("string")).alias("y")).where("l IS NOT NULL AND y IS NOT NULL")
    n = d.groupBy("e", "l").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    two = n.groupBy("e").agg(F.count(F.lit(1)).alias("k"), F.sort_array(F.collect_list(F.struct("lo", "hi", "l"))).alias("s")).where("k = 2 AND s[0].hi < s[1].lo")
    p = two.select(F.col("e").alias("EMP_ID"), F.col("s")[0]["l"].alias("old"), F.col("s")[1]["l"].alias("new"))
    return p.where(~surname_relation(F.col("old"), F.col("new")).isin("same", "spelling"))


def surname_successions(panel: DataFrame, emp_id: str = "EMP_ID", org: str = "ein", year: str = "taxyr", title: str = "title_standard", comp: str = "tot_comp") -> DataFrame:
    """Pairs of records of one organization and given name: one ends one or two years before the other, of another surname, starts.

    ``strength`` weighs a stable title, pay, a kept maiden name and the middle initial.
    """
    text = lambda c: feature(column(panel, c))
    d = panel.select(F.col(emp_id).alias("e"), column(panel, org).alias("o"), as_year(column(panel, year).cast("string")).alias("y"), text("first_name").alias("f"), text("last_name").alias("l"), text("middle_name").alias("m"), text("gender").alias("g"), text(title).alias("t"), column(panel, comp).cast("double").alias("c"))
    ends = d.groupBy("e").agg(
        F.min("o").alias("o"), modal(F.collect_list("f")).alias("f"), modal(F.collect_list("l")).alias("l"), modal(F.collect_list("m")).alias("m"), modal(F.collect_list("g")).alias("g"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.min_by("t", "y").alias("t0"), F.max_by("t", "y").alias("t1"), F.min_by("c", "y").alias("c0"), F.max_by("c", "y").alias("c1"),
    ).where(F.length("f") > 1)
    a, b = ends.alias("a"), ends.alias("b")
    j = a.join(b, F.expr("a.o = b.o AND a.f = b.f AND a.e <> b.e AND b.y0 - a.y1 BETWEEN 1 AND 2 AND a.l <> b.l"))
    p = j.select(
        F.col("a.o").alias("org"), F.col("a.f").alias("first_name"), F.col("a.e").alias("emp_a"), F.col("b.e").alias("emp_b"), F.col("a.l").alias("last_a"), F.col("b.l").alias("last_b"), F.col("a.y1").alias("end_a"), F.col("b.y0").alias("start_b"),
        F.coalesce("b.g", "a.g").alias("gender"), F.coalesce(F.col("a.t1") == F.col("b.t0"), F.lit(False)).alias("title_stable"), F.col("b.t0").alias("_t"), F.col("a.c1").alias("_ca"), F.col("b.c0").alias("_cb"), F.col("a.m").alias("_ma"), F.col("b.m").alias("_mb"),
    )
    p = p.where(~surname_relation(F.col("last_a"), F.col("last_b")).isin("same", "spelling"))
    kept = F.coalesce(F.col("_mb") == F.col("last_a"), F.lit(False)) | F.array_contains(F.split("last_b", "[- ]"), F.col("last_a"))
    ratio = F.try_divide(F.col("_cb"), F.col("_ca"))
    pay = F.when(F.col("_ca").isNull() | F.col("_cb").isNull(), "unknown").when((F.col("_ca") == 0) & (F.col("_cb") == 0), "both unpaid").when(ratio.between(0.75, 1.33), "stable").otherwise("changed")
    words = F.filter(F.split(F.coalesce("_t", F.lit("")), "[^A-Z]+"), lambda w: w != "")
    generic = F.size(F.array_except(words, F.array(*map(F.lit, GENERIC_TITLE_WORDS)))) == 0
    middle = F.coalesce(F.substring("_ma", 1, 1) == F.substring("_mb", 1, 1), F.lit(False))
    p = p.withColumns({"pay": pay, "maiden_kept": kept, "generic_title": generic, "same_middle": middle})
    strength = F.when(F.col("title_stable") & ((F.col("pay") == "stable") | F.col("maiden_kept") | F.col("same_middle")), "strong").when(F.col("title_stable") & ~F.col("generic_title") & (F.col("pay") != "changed"), "distinctive title").when(F.col("title_stable") & F.col("generic_title"), "generic title").otherwise("title changed")
    return p.withColumn("strength", strength).drop("_t", "_ca", "_cb", "_ma", "_mb")


def surname_change_rates(found: DataFrame, records: DataFrame) -> DataFrame:
    """(strength, female, male, expected_by_chance, estimated): women's cases beyond what men's rate predicts.

    ``records`` has one row for each record with its gender.
    """
    n = records.agg(F.sum((F.col("gender") == "F").cast("double")).alias("fw"), F.sum((F.col("gender") == "M").cast("double")).alias("mw"))
    t = found.groupBy("strength").agg(F.sum((F.col("gender") == "F").cast("double")).alias("female"), F.sum((F.col("gender") == "M").cast("double")).alias("male"))
    chance = F.round(F.try_divide(F.col("male") * F.col("fw"), F.col("mw")), 1)
    return t.crossJoin(F.broadcast(n)).select("strength", "female", "male", chance.alias("expected_by_chance"), F.greatest(F.lit(0.0), F.round(F.col("female") - F.coalesce(chance, F.lit(0.0)))).alias("estimated"))  # one row


# --- relations between names ------------------------------------------------------------------------------------------------


def _letters(name: str) -> str:
    return "".join(c for c in name.upper() if "A" <= c <= "Z")


def _parts(name: str) -> list[str]:
    return [p for p in ("".join(c if "A" <= c <= "Z" else " " for c in name.upper())).split() if p]


def _mc(name: str) -> str:
    return "MC" + name[3:] if name.startswith("MAC") else name


def _core(name: str) -> str:
    parts = _parts(name)
    kept = [p for p in parts if p not in CORE_PARTICLES] or parts
    return _mc("".join(kept))


def _spelled(a: str, b: str) -> bool:
    return abs(len(a) - len(b)) <= 2 and osa_distance(a, b) <= (1 if max(len(a), len(b)) <= 6 else 2)


def _winkler(a: str, b: str) -> float:
    s = float(jaro([a], [b])[0])
    shared = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return s + shared * WINKLER * (1 - s)


def surname_ladder(a: str | None, b: str | None, established: Callable[[str], bool] = lambda _: False) -> str:
    """missing, same, particle, compound, spelling, different (both established) or unrelated: the first that fits."""
    if not (a or "").strip() or not (b or "").strip():
        return "missing"
    na, nb, ca, cb = _letters(a), _letters(b), _core(a), _core(b)
    if na == nb:
        return "same"
    if ca == cb or _mc(na) == _mc(nb):
        return "particle"
    ta, tb = ([p for p in _parts(x) if p not in CORE_PARTICLES] for x in (a, b))
    several = len(ta) > 1 or len(tb) > 1
    if several and {p for p in ta if len(p) > 1} & {p for p in tb if len(p) > 1}:
        return "compound"
    if _spelled(na, nb) or _spelled(ca, cb) or _winkler(na, nb) >= WINKLER_MIN:
        return "spelling"
    if several and any(_spelled(x, y) for x in ta if len(x) > 3 for y in tb if len(y) > 3):
        return "compound"
    known = [established(_letters(x)) or any(map(established, t)) for x, t in ((a, ta), (b, tb))]
    return "different" if all(known) else "unrelated"


def first_ladder(a: str | None, b: str | None, established: Callable[[str], bool] = lambda _: False) -> str:
    """missing, same, nickname, initial, spelling, different or unrelated: the first that fits."""
    a, b = (a or "").strip().upper(), (b or "").strip().upper()
    if not a or not b:
        return "missing"
    if a == b:
        return "same"
    roots = lambda x: {c for c, vs in nickname_table().items() if x == c or x in vs} or {x}
    if roots(a) & roots(b):
        return "nickname"
    if len(a) == 1 or len(b) == 1:
        return "initial" if a[0] == b[0] else "different"
    if _spelled(a, b):
        return "spelling"
    if a.startswith(b) or b.startswith(a):
        return "nickname"
    return "different" if established(a) and established(b) else "unrelated"


def _relation(ladder: Callable, established: set[str] | None):
    known = established or set()

    @pandas_udf("string")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        memo: dict[tuple, str] = {}
        for xs, ys in batches:
            if len(memo) > 200_000:
                memo.clear()
            out = []
            for p in zip(xs, ys):
                if p not in memo:
                    memo[p] = ladder(*p, known.__contains__)
                out.append(memo[p])
            yield pd.Series(out)

    return of


def surname_relation(a: Column, b: Column, established: set[str] | None = None) -> Column:
    """The relation of two surnames; ``established`` is a bounded list of names that the caller holds."""
    return _relation(surname_ladder, established)(a, b)


def first_relation(a: Column, b: Column, established: set[str] | None = None) -> Column:
    return _relation(first_ladder, established)(a, b)


def suffix_relation(a: Column, b: Column) -> Column:
    """none, one side only, agree, JR vs II (compatible) or conflict, of two arrays of suffixes."""
    gen = F.array(*map(F.lit, GENERATIONS))
    x, y = F.array_intersect(a, gen), F.array_intersect(b, gen)
    alike = F.size(F.array_except(F.concat(x, y), F.array(F.lit("JR"), F.lit("II")))) == 0
    return F.when((F.size(x) == 0) & (F.size(y) == 0), "none").when((F.size(x) == 0) | (F.size(y) == 0), "one side only").when(F.arrays_overlap(x, y), "agree").when(alike, "JR vs II (compatible)").otherwise("conflict")


# --- review evidence ------------------------------------------------------------------------------------------------------


def pair_evidence(pairs: DataFrame, profiles: DataFrame, seats: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """What speaks for and against pairs (emp_a, emp_b, ...): name relations, years, shared board members and a priority.

    ``seats`` has (org, person); ``names`` has (org, org_name).  Conflicts and two risks without corroboration are high.
    """
    cols = ["first_name", "first_name_variants", "first_name_roots", "last_name", "middle_initials", "suffixes", "gender", "years"]
    p = profiles.select("EMP_ID", *cols, F.get("orgs", F.lit(0)).alias("org"))
    side = lambda s: p.select(F.col("EMP_ID").alias(f"emp_{s}"), *[F.col(c).alias(f"_{c}_{s}") for c in (*cols, "org")])
    j = pairs.join(side("a"), "emp_a").join(side("b"), "emp_b")
    x = lambda c: (F.col(f"_{c}_a"), F.col(f"_{c}_b"))
    fa, fb = x("first_name_variants")
    ra, rb = x("first_name_roots")
    na, nb = x("first_name")
    first = F.when((F.size(fa) == 0) | (F.size(fb) == 0), "missing").when(F.arrays_overlap(fa, fb), "exact").when(F.arrays_overlap(ra, rb), "nickname").when(((F.length(na) == 1) | (F.length(nb) == 1)) & (F.substring(na, 1, 1) == F.substring(nb, 1, 1)), "initial only").otherwise("different")
    ma, mb = x("middle_initials")
    middle = F.when((F.size(ma) == 0) & (F.size(mb) == 0), "both missing").when((F.size(ma) == 0) | (F.size(mb) == 0), "one missing").when(F.arrays_overlap(ma, mb), "agree").otherwise("conflict")
    la, lb = x("last_name")
    last = F.when(la.isNull() | lb.isNull(), "missing").when(la == lb, "exact").when(la.contains(lb) | lb.contains(la), "compound or partial").otherwise("spelling")
    ya, yb = x("years")
    overlap = F.size(F.array_intersect(ya, yb))
    gap = F.array_min(F.flatten(F.transform(ya, lambda a: F.transform(yb, lambda b: F.abs(a - b)))))
    ga, gb = x("gender")
    j = j.withColumns({
        "first_name_relation": first, "middle_initials": middle, "generational_suffix": suffix_relation(*x("suffixes")), "gender_conflict": F.coalesce(ga != gb, F.lit(False)), "surname_relation": last,
        "years_overlap": overlap, "years_gap": F.when(overlap > 0, F.lit(0)).otherwise(F.coalesce(gap, F.lit(0))),
    })
    if seats is not None:
        # the members that two boards share are counted once for the boards; a pair takes itself off
        s = seats.select("org", "person").distinct()
        common = settled(s.toDF("_org_a", "m").join(s.toDF("_org_b", "m"), "m"), "common-members").join(j.select("_org_a", "_org_b").distinct(), ["_org_a", "_org_b"], "left_semi")
        boards = common.groupBy("_org_a", "_org_b").agg(F.count(F.lit(1)).alias("_shared"))
        itself = lambda s: common.select("_org_a", "_org_b", F.col("m").alias(f"emp_{s}"), F.lit(1).alias(f"_self_{s}"))
        j = j.join(boards, ["_org_a", "_org_b"], "left").join(itself("a"), ["_org_a", "_org_b", "emp_a"], "left").join(itself("b"), ["_org_a", "_org_b", "emp_b"], "left")
        own = F.coalesce("_self_a", F.lit(0)) + F.when(F.col("emp_a") != F.col("emp_b"), F.coalesce("_self_b", F.lit(0))).otherwise(F.lit(0))
        j = j.withColumn("shared_board_members", F.coalesce("_shared", F.lit(0)) - own).drop("_shared", "_self_a", "_self_b")
    else:
        j = j.withColumn("shared_board_members", F.lit(0))
    if names is not None:
        n = names.select(F.col("org").alias("_o"), F.upper("org_name").alias("_on")).dropDuplicates(["_o"])
        j = j.join(n.toDF("_org_a", "_on_a"), "_org_a", "left").join(n.toDF("_org_b", "_on_b"), "_org_b", "left")
        held = lambda name, s: F.coalesce(F.array_contains(F.split(F.col(f"_on_{s}"), "[^A-Z0-9]+"), name), F.lit(False))
        j = j.withColumn("family_name_in_org", (F.length(la) >= 3) & (held(la, "a") | held(lb, "b")))
    else:
        j = j.withColumn("family_name_in_org", F.lit(False))
    conflict = (F.col("middle_initials") == "conflict") | (F.col("generational_suffix") == "conflict") | F.col("gender_conflict") | (F.col("first_name_relation") == "different")
    backed = (F.col("shared_board_members") >= 1) | (F.col("middle_initials") == "agree")
    risks = F.coalesce(F.col("family_name_in_org"), F.lit(False)).cast("int") + (F.col("years_gap") >= 10).cast("int") + (F.col("middle_initials") == "one missing").cast("int")
    j = j.withColumns({"conflict": conflict, "corroborated": backed, "risk_flags": risks})
    high = F.col("conflict") | ((F.col("risk_flags") >= 2) & ~F.col("corroborated"))
    priority = F.when(high, "high").when((F.col("risk_flags") == 1) & ~F.col("corroborated"), "medium").otherwise("low")
    return j.withColumn("review_priority", priority).drop(*[f"_{c}_{s}" for c in (*cols, "org", "on") for s in "ab"])


def single_forms(profiles: DataFrame) -> DataFrame:
    """Profiles cut to one form: the canonical names and the first initial and suffix."""
    one = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    return profiles.withColumns({"last_name_variants": one("last_name"), "first_name_variants": one("first_name"), "middle_initials": F.slice("middle_initials", 1, 1), "suffixes": F.slice("suffixes", 1, 1), "last_name_keys": surname_blocking_keys(one("last_name"))})


_FORM = ("last_name", "last_name_variants", "first_name_variants", "middle_initials", "suffixes", "gender")


def forms(profiles: DataFrame) -> DataFrame:
    """(EMP_ID, form): persons of one form, the digest of what scores and surname keys are made of, are alike to any pair."""
    return profiles.select("EMP_ID", F.md5(F.to_json(F.struct(*_FORM, "last_name_keys"), {"ignoreNullFields": "false"}).cast("binary")).alias("form"))


def _formed(profiles: DataFrame, mark: str) -> tuple[DataFrame, DataFrame]:
    """((EMP_ID, form), one profile for each form, its EMP_ID the form), with a mark before the digests."""
    d = settled(profiles.select(*_FORM, "last_name_keys", "EMP_ID").join(forms(profiles).withColumn("form", F.concat(F.lit(mark), "form")), "EMP_ID"), "forms")
    return d.select("EMP_ID", "form"), d.select(F.col("form").alias("EMP_ID"), *_FORM, "last_name_keys").dropDuplicates(["EMP_ID"])


def variant_test(scored: DataFrame, profiles: DataFrame, threshold: float = LINK_THRESHOLD, surname_weight: DataFrame | None = None) -> DataFrame:
    """(outcome, pairs): what single-form profiles keep, lose by blocking or score, or gain against pooled ones.

    Pairs are counted by the single forms of both sides, and forms are scored once.  ``scored`` may bring them (form_a, form_b: ``forms`` of
    ``single_forms``).
    """
    single = single_forms(profiles)
    of, one = _formed(single, "")
    was = F.col("score") >= threshold
    d = scored.select("emp_a", "emp_b", was.alias("was"), *[c for c in ("form_a", "form_b") if c in scored.columns])
    for s in "ab":
        d = d if f"form_{s}" in d.columns else d.join(of.toDF(f"emp_{s}", f"form_{s}"), f"emp_{s}")
    n = settled(d.groupBy(F.col("form_a").alias("emp_a"), F.col("form_b").alias("emp_b"), "was").agg(F.count(F.lit(1)).alias("n")), "counted-forms")
    again = score_candidate_pairs(n, one, surname_weight=population_surname_weight(single) if surname_weight is None else surname_weight)
    keys = one.select("EMP_ID", "last_name_keys")
    j = again.join(keys.toDF("emp_a", "ka"), "emp_a").join(keys.toDF("emp_b", "kb"), "emp_b")
    blocked = ~F.coalesce(F.arrays_overlap("ka", "kb"), F.lit(False))
    was, now = F.col("was"), F.col("score") >= threshold
    outcome = F.when(was & blocked, "lost: no shared surname key").when(was & ~F.coalesce(now, F.lit(False)), "lost: score falls").when(was, "kept").when(now & ~blocked, "gained")
    return j.groupBy(outcome.alias("outcome")).agg(F.sum("n").alias("pairs")).where("outcome IS NOT NULL")


def perturbations() -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Named changes of profiles for the seeded test; letters are drawn from a digest of the id, so reruns agree."""
    digest = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), "EMP_ID").cast("binary")), 1, 7), 16, 10).cast("int")

    def typo(name: str, first_too: bool) -> Column:
        low = 1 if first_too else 2
        at = F.lit(1) if first_too else low + digest("at") % (F.length(name) - 1)
        old = F.ascii(F.substring(F.col(name), at, F.lit(1))) - 65
        new = F.chr(65 + F.pmod(old + 1 + digest("letter") % 25, F.lit(26)))
        return F.when(F.length(name) >= 3, F.concat(F.substring(F.col(name), F.lit(1), at - 1), new, F.substring(F.col(name), at + 1, F.length(name))))

    def set_name(kind: str, value: Column) -> Callable[[DataFrame], DataFrame]:
        return lambda p: p.withColumn(f"{kind}_name", value).where(F.col(f"{kind}_name").isNotNull()).withColumn(f"{kind}_name_variants", F.array(f"{kind}_name"))

    table = F.create_map(*[x for c, v in nickname_table().items() for x in (F.lit(c), F.lit(v[0]))])
    none = F.array().cast("array<string>")
    return {
        "control": lambda p: p, "drop_middle": lambda p: p.where(F.size("middle_initials") > 0).withColumn("middle_initials", none),
        "middle_differs": lambda p: p.where(F.size("middle_initials") > 0).withColumn("middle_initials", F.array(F.chr(65 + F.pmod(F.ascii(F.get("middle_initials", F.lit(0))) - 64, F.lit(26))))),
        "nickname": set_name("first", F.try_element_at(table, F.col("first_name"))), "first_initial_only": set_name("first", F.substring("first_name", 1, 1)), "first_typo": set_name("first", typo("first_name", False)),
        "surname_typo": set_name("last", typo("last_name", False)), "surname_typo_first": set_name("last", typo("last_name", True)), "surname_hyphenated": set_name("last", F.concat(F.lit("SMITH-"), F.col("last_name"))),
        "surname_replaced": set_name("last", F.when(F.col("last_name") == "SMITH", "JONES").otherwise(F.lit("SMITH"))),
        "names_swapped": lambda p: p.select(*[c for c in p.columns if c not in ("first_name", "last_name", "first_name_variants", "last_name_variants")], F.col("first_name").alias("last_name"), F.col("last_name").alias("first_name"), F.array("first_name").alias("last_name_variants"), F.array("last_name").alias("first_name_variants")),
    }


def seeded_test(seeds: DataFrame, profiles: DataFrame, threshold: float = LINK_THRESHOLD, surname_weight: DataFrame | None = None) -> DataFrame:
    """(test, n, recall): how many sure pairs (emp_a, emp_b) still score the threshold when side b's name is changed.

    Pairs are counted by the form of side a and the changed form of side b, and forms are scored once.
    """
    out = None
    ids = settled(seeds.select(F.col("emp_b").alias("EMP_ID")).distinct(), "seeded")
    of, left = _formed(profiles, "a")
    counted = settled(seeds.join(of.toDF("emp_a", "form_a"), "emp_a").groupBy("form_a", "emp_b").agg(F.count(F.lit(1)).alias("n")), "seeds-by-form")
    for name, change in perturbations().items():
        b = change(profiles.join(ids, "EMP_ID", "left_semi"))
        sw = population_surname_weight(profiles.select("last_name").unionByName(b.select("last_name"))) if surname_weight is None else surname_weight
        of_b, right = _formed(b, "b")
        pairs = counted.join(of_b.toDF("emp_b", "form_b"), "emp_b").groupBy(F.col("form_a").alias("emp_a"), F.col("form_b").alias("emp_b")).agg(F.sum("n").alias("n"))
        s = score_candidate_pairs(pairs, left.unionByName(right), surname_weight=sw)
        hit = F.coalesce("score", F.lit(-1e9)) >= threshold
        row = s.agg(F.lit(name).alias("test"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n")).alias("recall"))
        out = row if out is None else out.unionByName(row)
    return out


def blocking_variants(scored: DataFrame, profiles: DataFrame, variants: dict[str, Column], threshold: float = LINK_THRESHOLD) -> DataFrame:
    """(variant, pairs, edges, interlockers, org_ties, mean_degree): one scored superset of pairs under several blocking rules.

    ``variants`` maps a name to a condition over the pairs' columns.  Ties are pairs of organizations with an accepted edge.
    ``scored`` may bring org_a and org_b.  Names of persons are stored of accepted pairs alone.
    """
    j = scored
    if "org_a" not in scored.columns:
        org = profiles.select("EMP_ID", F.get("orgs", F.lit(0)).alias("org"))
        j = scored.join(org.toDF("emp_a", "org_a"), "emp_a").join(org.toDF("emp_b", "org_b"), "emp_b")
    held = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in variants.items()]), lambda v: v.isNotNull())
    edge = F.coalesce(F.col("score") >= threshold, F.lit(False))
    # what is stored of the other pairs is that they are there
    rows = j.select(held.alias("held"), edge.alias("edge"), F.when(edge, F.col("emp_a")).alias("emp_a"), F.when(edge, F.col("emp_b")).alias("emp_b"), F.when(edge, F.col("org_a")).alias("org_a"), F.when(edge, F.col("org_b")).alias("org_b"))
    v = settled(rows, "variants").withColumn("variant", F.explode("held"))
    n = v.groupBy("variant").agg(F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.col("edge"), 1)).alias("edges"))
    e = v.where("edge")
    people = e.select("variant", F.explode(F.array("emp_a", "emp_b")).alias("e")).groupBy("variant").agg(F.countDistinct("e").alias("interlockers"))
    ties = e.select("variant", F.least("org_a", "org_b").alias("u1"), F.greatest("org_a", "org_b").alias("u2")).distinct()
    deg = ties.select("variant", F.explode(F.array("u1", "u2")).alias("u")).groupBy("variant").agg(F.countDistinct("u").alias("k"))
    t = ties.groupBy("variant").agg(F.count(F.lit(1)).alias("org_ties")).join(deg, "variant").select("variant", "org_ties", (2 * F.col("org_ties") / F.col("k")).alias("mean_degree"))
    return n.join(people, "variant", "left").join(t, "variant", "left").na.fill(0, ["interlockers", "org_ties"])


def wave_quality(matched: DataFrame, wave: DataFrame, existing: DataFrame, truth: str = "truth_id") -> DataFrame:
    """One row: precision and recall of wave matches against a truth column carried by both linked panels."""
    t = lambda d, c: d.select(F.col("EMP_ID").alias(c), F.col(truth).alias(f"t_{c}")).distinct()
    hit = matched.join(t(wave, "wave_emp_id"), "wave_emp_id").join(t(existing, "existing_emp_id"), "existing_emp_id")
    right = hit.agg(F.countDistinct("wave_emp_id").alias("n"), F.countDistinct(F.when(F.col("t_wave_emp_id") == F.col("t_existing_emp_id"), F.col("wave_emp_id"))).alias("right"))
    due = t(wave, "w").join(t(existing, "e"), F.col("t_w") == F.col("t_e")).agg(F.countDistinct("w").alias("due"))
    return right.crossJoin(due).select("n", "right", "due", F.try_divide("right", "n").alias("precision"), F.try_divide("right", "due").alias("recall"))

