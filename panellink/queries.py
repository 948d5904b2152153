"""Registered queries over the driver's tables, and the SQL that checks them where SQL can express them.

Queries run over the whole panel derived from ``orders`` (or the whole table they name).  Oracles repeat the panel's SQL as a common
table expression and then state the result independently of the operators.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panellink.functions.constants import HONORIFICS, MAX_BLOCK_SIZE, known_first_names, name_roots
from panellink.functions.ids import build_id_string, person_year_id
from panellink.functions.normalize import feature
from panellink.functions.roles import classify_title_role, title_role_coverage, title_role_rules
from panellink.functions.similarity import similarity
from panellink.operators import blocking, careers, evaluate, ingest, network, review
from panellink.operators.candidates import candidate_comparisons, candidate_scores
from panellink.operators.prepare import population_surname_weight, surname_weight
from panellink.operators.profile import build_person_profile
from panellink.plans import batch, incremental, model, xorg
from panellink.plans.link import link_panel, remint_anchored
from panellink.sources.fixtures import PANEL_SQL, synthetic_panel
from panellink.sources.panel import batch_panel, batch_summary, read_csv, read_panel, write_csv
from panellink.sources.scratch import scratch_root, settled

PLACES = {"state": "org_state", "cbsa": "org_cbsa", "ntee": "org_ntee"}


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return synthetic_panel(spark, sf).drop("EMP_ID")


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    return build_person_profile(synthetic_panel(spark, sf), **PLACES)


def _named_seats(spark: SparkSession, sf: str) -> DataFrame:
    """Seats of persons that are told apart across organizations by gender and surname alone: a dense interlock."""
    p = synthetic_panel(spark, sf)
    return p.groupBy(F.col("ein").alias("org"), F.concat_ws(":", "gender", "last_name").alias("person")).agg(F.array_sort(F.collect_set("taxyr")).alias("years"))


def _org_groups(spark: SparkSession, sf: str, of) -> DataFrame:
    return synthetic_panel(spark, sf).select(F.col("ein").alias("unit"), of.alias("grp")).distinct()


def churn_by_org(spark, sf):
    c = careers.position_churn(synthetic_panel(spark, sf), role="BOARD")
    return c.withColumns({"retention": F.round("retention", 9), "turnover": F.round("turnover", 9)})


def churn_pooled(spark, sf):
    c = careers.position_churn(synthetic_panel(spark, sf), role="BOARD", by_org=False)
    return c.withColumns({"retention": F.round("retention", 9), "turnover": F.round("turnover", 9)})


def transitions(spark, sf):
    return careers.flag_position_transitions(synthetic_panel(spark, sf), position=["CEO", "EXECUTIVE DIRECTOR"])


def transitions_tolerant(spark, sf):
    return careers.flag_position_transitions(synthetic_panel(spark, sf), position="CHIEF|PRESIDENT", match="regex", gap_tolerant=True)


def promotions(spark, sf):
    p = careers.flag_promotions(synthetic_panel(spark, sf))
    return p.select("EMP_ID", "ein", "from_year", "to_year", "from_title", "to_title", "from_role", "to_role", F.round("sim_standard", 9).alias("sim_standard"), F.round("comp_pct", 9).alias("comp_pct"), "change_type", "direction", "basis")


def role_coverage(spark, sf):
    return title_role_coverage(synthetic_panel(spark, sf))


def surname_weights(spark, sf):
    p = surname_weight(synthetic_panel(spark, sf))
    return p.select("ein", "last_name", F.round("surname_w", 9).alias("surname_w")).distinct()


def population_weights(spark, sf):
    return population_surname_weight(build_person_profile(synthetic_panel(spark, sf))).select("last_name", F.round("weight", 9).alias("weight"))


def id_strings(spark, sf):
    p = build_id_string(_raw(spark, sf))
    return p.select("truth_id", "taxyr", "id_string", person_year_id(F.col("object_id"), F.col("table_id")).alias("person_year_id"))


def anchors(spark, sf):
    return remint_anchored(synthetic_panel(spark, sf))[1]


def batches(spark, sf):
    from panellink.functions.ids import batch_id

    return batch_summary(_raw(spark, sf).withColumn("batch", batch_id(F.col("ein"), 16, "hash")))


def profiles(spark, sf):
    p = _profiles(spark, sf)
    lists = {c: F.array_join(c, ";").alias(c) for c in ("last_name_variants", "first_name_variants", "suffixes", "titles", "orgs", "roles", "states", "cbsa", "ntee")}
    years = F.array_join(F.transform("years", lambda y: y.cast("string")), ";").alias("years")
    return p.select("EMP_ID", "n_records", "n_orgs", "n_years", "first_year", "last_year", "last_name", "first_name", "first_initial", "gender", "primary_role", "is_board", years, *lists.values())


def blocking_keys(spark, sf):
    return blocking.person_blocking_keys(_profiles(spark, sf))


def block_census(spark, sf):
    return blocking.block_census(blocking.person_blocking_keys(_profiles(spark, sf)), max_block_size=150)


def xorg_candidates(spark, sf):
    p = settled(_profiles(spark, sf), "profiles")
    return blocking.candidate_pairs(blocking.person_blocking_keys(p), p)[0]


def xorg_dropped_blocks(spark, sf):
    p = settled(_profiles(spark, sf), "profiles")
    return blocking.candidate_pairs(blocking.person_blocking_keys(p), p, max_block_size=60)[1]


def wave_candidates(spark, sf):
    p = synthetic_panel(spark, sf)
    old = build_person_profile(p.where("taxyr <= 1999"))
    new = build_person_profile(p.where("taxyr >= 2000").withColumn("EMP_ID", F.concat(F.lit("W-"), "EMP_ID")))
    return blocking.same_org_candidate_pairs(old, new, MAX_BLOCK_SIZE)[0]


def wave_reloads(spark, sf):
    from panellink.sources.panel import PanelCols

    p = _raw(spark, sf)
    kept, _ = incremental.without_reloads(p.where("taxyr <= 1999"), p.where("taxyr >= 1998"), PanelCols(object_id="object_id", table_id="table_id"))
    return kept.select("object_id", "table_id", "taxyr")


def anomalies(spark, sf):
    a = review.flag_anomalies(synthetic_panel(spark, sf))
    return a.select("emp_id", "category", "merge_risk", "n_records", "n_years", "first_year", "last_year", "span", "density", "n_gaps", "max_gap", "n_spells", "pay_shift", "homonym_copresent", "gap_return", "gap_long", "gap_pay_shift", "sporadic", "dup_line_in_filing", "names_seen")


def link_flags(spark, sf):
    return review.flag_links(synthetic_panel(spark, sf)).withColumn("review_score", F.round("review_score", 6))


def parse_failures(spark, sf):
    """Every fourth person's first record gets an honorific, a credential or a letter glued to its name."""
    return _parse_log(spark, sf).select("emp_id", "year", "first_name", "last_name", "defect_type", "expected_first", "expected_last", "source")


def _parse_log(spark, sf):
    p = synthetic_panel(spark, sf)
    kind = F.when(F.col("taxyr") == 1996, F.col("truth_id") % 4)
    p = p.withColumns({
        "first_name": F.when((kind == 1) & (F.length("first_name") > 2), F.concat(F.lit("MR"), "first_name")).otherwise(F.col("first_name")),
        "last_name": F.when(kind == 2, F.concat("last_name", F.lit(" CPA"))).when(kind == 3, F.concat(F.lit("X"), "last_name")).otherwise(F.col("last_name")),
    })
    return review.parse_fail_log(p)


def parse_tokens(spark, sf):
    return review.parse_fail_tokens(_parse_log(spark, sf))


def link_queue(spark, sf):
    return review.link_review_queue(link_flags(spark, sf)).select("emp_id", "review_score")


def link_flag_counts(spark, sf):
    return review.flags_report(link_flags(spark, sf))


def anomaly_queue(spark, sf):
    return review.anomaly_review_queue(review.flag_anomalies(synthetic_panel(spark, sf))).select("emp_id", "category", "merge_risk")


def anomaly_counts(spark, sf):
    return review.anomalies_report(review.flag_anomalies(synthetic_panel(spark, sf))).select("n_persons", "n_flagged", "homonym_copresent", "gap_return", "gap_long", "gap_pay_shift", "sporadic")


def review_totals(spark, sf):
    return evaluate.review_counts(synthetic_panel(spark, sf))


def filings(spark, sf):
    """Orders as filings of a customer and year: the latest counts, urgent ones as amended."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    f = o.select(F.col("o_custkey").alias("ein"), F.year("o_orderdate").alias("taxyr"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("RETURN_TIME_STAMP"), (F.col("o_orderpriority") == "1-URGENT").cast("string").alias("RETURN_AMENDED_X"), F.col("o_orderkey").alias("OBJECTID"))
    return ingest.resolve_filings(f).select("ein", "taxyr", "OBJECTID")


def membership(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").cast("string").alias("ein"), F.year("o_orderdate").alias("taxyr"))
    return ingest.membership_classes(o)


def org_costs(spark, sf):
    t = ingest.org_table(_raw(spark, sf).withColumn("org_name", F.concat_ws(" ", F.lit("ORG"), "ein", F.col("taxyr").cast("string"))))
    return t.withColumn("cost_share", F.round("cost_share", 12))


def org_projection(spark, sf):
    p = network.org_projection(_named_seats(spark, sf))
    return p.withColumns({"jaccard": F.round("jaccard", 9), "overlap": F.round("overlap", 9)})


def person_projection(spark, sf):
    return network.person_projection(_named_seats(spark, sf))


def group_mixing(spark, sf):
    m = network.group_mixing(network.org_pairs(_named_seats(spark, sf)), _org_groups(spark, sf, network.maj12(F.col("org_ntee"))))
    return m.withColumn("density", F.round("density", 9))


def ei_index(spark, sf):
    e = network.ei_index(network.org_pairs(_named_seats(spark, sf)), _org_groups(spark, sf, F.col("org_cbsa")))
    return e.select("ties", *[F.round(c, 9).alias(c) for c in ("external", "internal", "ei")])


def network_summary(spark, sf):
    return network.network_summary(_named_seats(spark, sf)).withColumn("mean_degree", F.round("mean_degree", 9))


def bridges(spark, sf):
    p = synthetic_panel(spark, sf)
    attributes = p.select(F.col("ein").alias("unit"), network.maj10(F.col("org_ntee")).alias("sector"), F.col("org_cbsa").alias("cbsa")).distinct()
    return network.bridges(_named_seats(spark, sf), attributes)


def spanners(spark, sf):
    return network.spanners(network.org_pairs(_named_seats(spark, sf)), _org_groups(spark, sf, F.col("org_state")), min_shared=3)


def transitivity(spark, sf):
    w = network.org_pairs(_named_seats(spark, sf)).where("w >= 3")
    return network.transitivity(w).withColumn("transitivity", F.round("transitivity", 9))


def _ties(spark, sf):
    """Organizations that share two persons or more of the named seats."""
    return network.org_pairs(_named_seats(spark, sf)).where("w >= 2")


def coreness(spark, sf):
    return network.coreness(_ties(spark, sf))


def eigen_centrality(spark, sf):
    edges = network.largest_component(settled(_ties(spark, sf), "edges"))
    return network.eigen_centrality(edges, tolerance=1e-9).withColumn("centrality", F.round("centrality", 4))


def betweenness(spark, sf):
    return network.betweenness(_ties(spark, sf)).withColumn("betweenness", F.round("betweenness", 6))


def meta_organizations(spark, sf):
    s = settled(_named_seats(spark, sf), "seats")
    return network.meta_orgs(network.org_projection(s), s, min_shared=3, jaccard=0.9)


def name_risk(spark, sf):
    """Persons are those of one full name; boards are the organizations where it sits."""
    p = settled(_profiles(spark, sf), "profiles")
    persons = p.select("EMP_ID", F.concat_ws(" ", "first_name", "last_name").alias("XORG_ID"))
    n = network.name_risk(p, persons, network.board_seats(p, persons))
    return n.select("person", "boards", "records", "names", F.round("lambda", 9).alias("lambda"), "mi_confirmed", "ambiguous")


def board_edges(spark, sf):
    p = settled(_profiles(spark, sf), "profiles")
    pairs = blocking.candidate_pairs(blocking.person_blocking_keys(p, ["strict"]), p)[0].select("emp_a", "emp_b")
    return xorg.filter_edges_by_role(pairs, p, ["OFFICER", "STAFF"], mode="all", match="either", negate=True)


def xorg_diff(spark, sf):
    """Two groupings of persons: by full name before 1999, and by full name over all years."""
    def grouped(p: DataFrame) -> DataFrame:
        q = p.select("EMP_ID", "ein", F.concat_ws(" ", "first_name", "last_name").alias("x")).groupBy("EMP_ID", "ein").agg(F.min("x").alias("XORG_ID"))
        return q.join(q.groupBy("XORG_ID").agg(F.countDistinct("ein").cast("int").alias("XORG_N_ORGS")), "XORG_ID").select("EMP_ID", "XORG_ID", "XORG_N_ORGS")

    p = synthetic_panel(spark, sf)
    return xorg.diff_cross_org(grouped(p.where("taxyr < 1999")), grouped(p)).persons


def record_checks(spark, sf):
    """Whole organizations as if each were one person, so that every check finds something."""
    return evaluate.record_checks(synthetic_panel(spark, sf), emp_id="ein")


def linkage_summary(spark, sf):
    s = evaluate.linkage_summary(synthetic_panel(spark, sf), by=F.col("org_state"))
    return s.select("grp", "records", "persons", "orgs", *[F.round(c, 9).alias(c) for c in ("compression", "share_multi_year", "median_years", "share_repeated_in_year")])


def ceo_continuity(spark, sf):
    return evaluate.same_next_year(synthetic_panel(spark, sf), F.col("title_standard") == "CEO").withColumn("kept", F.round("kept", 9))


def surname_similarity(spark, sf):
    """Jaro over all pairs of distinct surnames: a list of tens of values whatever the scale."""
    v = synthetic_panel(spark, sf).select("last_name").distinct()
    pairs = v.toDF("a").join(v.toDF("b"), F.expr("a < b"))
    return pairs.select("a", "b", F.round(similarity("jaro", F.col("a"), F.col("b")), 9).alias("jaro"))


def first_name_similarity(spark, sf):
    v = synthetic_panel(spark, sf).select(feature(F.col("first_name")).alias("n")).distinct()
    pairs = v.toDF("a").join(v.toDF("b"), F.expr("a <= b"))
    return pairs.select("a", "b", F.round(similarity("first", F.col("a"), F.col("b")), 9).alias("sim"))


def pair_scores(spark, sf):
    s = candidate_scores(_raw(spark, sf), fields=("first_name", "last_name"))
    return s.select("row_x", "row_y", "yr_x", "yr_y", "org", F.round("score", 6).alias("score"))


def link_panel_ids(spark, sf):
    return link_panel(_raw(spark, sf)).panel.select("truth_id", "ein", "taxyr", "EMP_ID", "EMP_ANCHOR", "EMP_N_RECORDS", "EMP_N_YEARS")


def link_edges(spark, sf):
    return link_panel(_raw(spark, sf)).edges.select("row_x", "row_y", F.round("score", 6).alias("score"))


def link_report(spark, sf):
    return link_panel(_raw(spark, sf)).report.select("n_records", "n_orgs", "n_years", "n_clusters", "n_singletons", "n_multi_year", "n_links", "rejected_edges", F.round("compression", 9).alias("compression"))


def comparisons(spark, sf):
    c = candidate_comparisons(_raw(spark, sf))
    return c.select("row_x", "row_y", *[F.round(f, 9).alias(f) for f in ("first_name", "last_name", "suffix", "gender", "title_standard")])


def batched_links(spark, sf):
    """The panel written to batches of whole organizations, linked batch by batch and read back."""
    root = f"{scratch_root(spark)}/batched-{uuid.uuid4().hex}"
    batch_panel(_raw(spark, sf), f"{root}/in", n_batches=3, method="hash")
    runs = batch.link_panel_batched(spark, f"{root}/in", f"{root}/out", steps=("link",))
    if {r.status for r in runs} != {"done"} or {r["state"] for r in batch.batch_status(spark, f"{root}/out")} != {"done"}:
        raise RuntimeError(f"a batch failed: {runs}")
    return batch.read_linked(spark, f"{root}/in", f"{root}/out").select("truth_id", "ein", "taxyr", "EMP_ID")


def stored_batches(spark, sf):
    """Batches of whole organizations on disk, read back by two columns."""
    root = f"{scratch_root(spark)}/stored-{uuid.uuid4().hex}"
    batch_panel(_raw(spark, sf), root, n_batches=16, method="hash")
    if len(batch.list_batches(spark, root)) != 16:
        raise RuntimeError("a batch's folder is missing")
    return read_panel(spark, root, columns=["truth_id", "taxyr", "batch"])


def csv_round_trip(spark, sf):
    root = f"{scratch_root(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey"), root)
    return read_csv(spark, root)


def stamped(spark, sf):
    """Records with the group of their person, by full name; persons who never held a board seat have none."""
    p = synthetic_panel(spark, sf)
    x = build_person_profile(p).where("is_board").select("EMP_ID", F.concat_ws(" ", "first_name", "last_name").alias("XORG_ID"))
    return xorg.stamp_xorg(p, x).select("truth_id", "taxyr", "XORG_ID")


def unstamped(spark, sf):
    p = synthetic_panel(spark, sf)
    return xorg.unstamped(p, build_person_profile(p).where("is_board").select("EMP_ID")).select("truth_id", "taxyr")


def first_titles(spark, sf):
    """Orders as title lines of a customer's filing of a year."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("OBJECTID"), F.year("o_orderdate").alias("TABLE_ID"), (F.col("o_orderkey") % 3).alias("title_order"), F.col("o_orderpriority").alias("title_standard"))
    return ingest.primary_titles(o)


def parsed_titles(spark, sf):
    roles = ingest.map_distinct(synthetic_panel(spark, sf), "title_standard", lambda v: v.withColumn("role", classify_title_role(F.col("title_standard"))))
    return roles.select("truth_id", "taxyr", "role")


def places(spark, sf):
    """Customers as filings of a ZIP, nations as its counties, regions as places."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("OBJECTID"), (F.col("c_custkey") % 60).alias("zip"), F.col("c_nationkey").alias("county"), ((F.col("c_custkey") % 4 + 1) / 16).alias("share"))
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("county"), (F.col("n_regionkey") * 111 + 10000).alias("cbsa"))
    found = ingest.normalize_places(ingest.zip_places(c, n))
    return ingest.filing_place(c.select("OBJECTID", F.lpad(F.col("zip").cast("string"), 5, "0").alias("zip")), found)


def pay_bins(spark, sf):
    b = ingest.size_bin(F.col("tot_comp"), [100_000.0, 200_000.0, 300_000.0], ["low", "middle", "high", "top"])
    return synthetic_panel(spark, sf).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def person_marks(spark, sf):
    return ingest.person_groups(synthetic_panel(spark, sf), ["EMP_ID"], {"paid": F.col("tot_comp") > 300_000, "ceo": F.col("title_standard") == "CEO"}, {"titles": "title_standard"})


def top_titles(spark, sf):
    return ingest.top_values(synthetic_panel(spark, sf), "title_standard", 5)


def officer_accuracy(spark, sf):
    h = synthetic_panel(spark, sf).where("title_standard = 'CEO'").select(F.col("ein"), "taxyr", "EMP_ID", F.col("first_name").alias("first"), F.col("last_name").alias("last"))
    return evaluate.linkage_accuracy(h).withColumns({c: F.round(c, 9) for c in ("recall", "false_merge")})


def score_spread(spark, sf):
    q = evaluate.score_quantiles(evaluate.silver_score_counts(_raw(spark, sf)), at=(0.1, 0.5, 0.9), weight="n")
    return q.select("label", *[F.round(c, 6).alias(c) for c in ("q10", "q50", "q90")])


def meta_seats(spark, sf):
    s = settled(_named_seats(spark, sf), "seats")
    c = network.collapse(s, network.meta_orgs(network.org_projection(s), s, min_shared=3, jaccard=0.9))
    return c.select("meta", "person", F.array_join(F.transform("years", lambda y: y.cast("string")), ";").alias("years"))


def split_ties(spark, sf):
    """Ties that would go if every person who sits in ten organizations or more were several."""
    s = settled(_named_seats(spark, sf), "seats")
    many = s.groupBy("person").agg(F.count(F.lit(1)).alias("k")).where("k >= 40")
    return network.split_back(s, s.select("person"), many)


def link_panel_em(spark, sf):
    return link_panel(_raw(spark, sf), method="em").panel.select("truth_id", "ein", "taxyr", "EMP_ID", "EMP_N_RECORDS", F.round("EMP_LINK_CONF", 6).alias("EMP_LINK_CONF"))


def link_invariants(spark, sf):
    """What must hold for any linked panel: no record is lost, no id repeats in a year or crosses organizations."""
    p = link_panel(_raw(spark, sf)).panel
    g = p.groupBy("EMP_ID", "ein", "taxyr").agg(F.count(F.lit(1)).alias("n")).groupBy("EMP_ID").agg(F.max("n").alias("m"), F.countDistinct("ein").alias("o"), F.sum("n").alias("n"))
    return g.agg(F.sum("n").alias("records"), F.count(F.when(F.col("m") > 1, 1)).alias("repeated_in_year"), F.count(F.when(F.col("o") > 1, 1)).alias("across_orgs"))


def link_quality(spark, sf):
    q = evaluate.pair_quality(link_panel(_raw(spark, sf)).panel, "truth_id")
    return q.withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


def match_weights(spark, sf):
    r = link_panel(_raw(spark, sf), method="em")
    return spark.createDataFrame(model.fs_weights(r.model), "feature string, m double, u double, w_agree double, w_disagree double")


def sweep(spark, sf):
    return evaluate.threshold_sweep(evaluate.silver_score_counts(_raw(spark, sf)), weight="n").withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


def cross_org(spark, sf):
    return xorg.link_cross_org(synthetic_panel(spark, sf), **PLACES).assignment


def cross_org_invariants(spark, sf):
    """Every person is assigned once, and no cluster holds two persons of one organization."""
    r = xorg.link_cross_org(synthetic_panel(spark, sf), **PLACES)
    m = r.assignment.join(blocking.first_org(r.profiles), "EMP_ID")
    g = m.groupBy("XORG_ID", "org").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("persons"), F.count(F.when(F.col("n") > 1, 1)).alias("org_collisions"))


def waves(spark, sf):
    p = _raw(spark, sf)
    old = settled(link_panel(p.where("taxyr <= 1999")).panel, "linked")
    return incremental.link_incremental(old, p.where("taxyr >= 2000")).new_stamped.select("truth_id", "ein", "taxyr", "EMP_ID", "EMP_ANCHOR")


def wave_matches(spark, sf):
    """Wave profiles against earlier ones, persons known by their true ids."""
    p = synthetic_panel(spark, sf)
    old = settled(build_person_profile(p.where("taxyr <= 1999")), "old")
    new = settled(build_person_profile(p.where("taxyr >= 2000").withColumn("EMP_ID", F.concat(F.lit("W-"), "EMP_ID"))), "new")
    return incremental.match_to_profiles(new, old, max_block_size=MAX_BLOCK_SIZE).matched.select("wave_emp_id", "existing_emp_id", F.round("score", 6).alias("score"))


def _pair_scores(spark, sf, carried=None) -> tuple[DataFrame, DataFrame]:
    """Scored pairs, not stored: they are many times the input."""
    p = settled(_profiles(spark, sf), "profiles")
    return xorg.scored_candidates(blocking.person_blocking_keys(p), p, components=True, carried=carried(p) if carried else None), p


def xorg_scores(spark, sf):
    return _pair_scores(spark, sf)[0].select("emp_a", "emp_b", "pass", F.round("score", 6).alias("score"), *[F.round(c, 6).alias(c) for c in ("sim_last_name", "sim_first_name")], "sim_suffix", "sim_gender")


def pair_evidence(spark, sf):
    scores, p = _pair_scores(spark, sf)
    return evaluate.pair_evidence(settled(scores.where("score >= 7").select("emp_a", "emp_b"), "pairs"), p, network.board_seats(p))


def blocking_variants(spark, sf):
    scores, p = _pair_scores(spark, sf)
    return evaluate.blocking_variants(scores, p, {"strict": F.col("pass") == "strict", "strict or metro": F.lit(True)})


def variant_test(spark, sf):
    return evaluate.variant_test(*_pair_scores(spark, sf, lambda p: evaluate.forms(evaluate.single_forms(p))))


def seeded_test(spark, sf):
    scores, p = _pair_scores(spark, sf)
    return evaluate.seeded_test(settled(scores.where("score >= 9").select("emp_a", "emp_b"), "seeds"), p)


def surname_successions(spark, sf):
    """Women of organizations with an even number take another name, and so another id, in 1999."""
    p = synthetic_panel(spark, sf)
    changed = (F.col("gender") == "F") & (F.col("taxyr") >= 1999) & (F.substring("ein", -1, 1).isin("0", "2", "4", "6", "8"))
    p = p.withColumns({"EMP_ID": F.when(changed, F.concat("EMP_ID", F.lit("-2"))).otherwise(F.col("EMP_ID")), "last_name": F.when(changed, F.concat(F.lit("ZZ"), F.reverse("last_name"))).otherwise(F.col("last_name"))})
    return evaluate.surname_successions(p)


def k_core(spark, sf):
    return network.k_core(_ties(spark, sf), 20)


def meta_share(spark, sf):
    s = settled(_named_seats(spark, sf), "seats")
    proj = settled(network.org_projection(s), "projection")
    return network.meta_share(proj, s, network.meta_orgs(proj, s, min_shared=3, jaccard=0.9), "w>=3 & jaccard>=0.9")


def stratified_customers(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_nationkey")
    s = ingest.stratified_sample(c, ["c_nationkey"], 200, floor=5, key="c_custkey")
    return s.withColumn("weight", F.round("weight", 9))


def org_batches(spark, sf):
    return ingest.ntile_batches(_raw(spark, sf), 7)


def queries() -> dict:
    names = (
        churn_by_org, churn_pooled, transitions, transitions_tolerant, promotions, role_coverage, surname_weights, population_weights, id_strings, anchors, batches, profiles, blocking_keys, block_census,
        xorg_candidates, xorg_dropped_blocks, wave_candidates, wave_reloads, anomalies, link_flags, parse_failures, filings, membership, org_costs, org_projection, person_projection, group_mixing, ei_index, network_summary,
        bridges, spanners, transitivity, coreness, eigen_centrality, betweenness, meta_organizations, name_risk, board_edges, xorg_diff, record_checks, linkage_summary, ceo_continuity, surname_similarity,
        first_name_similarity, pair_scores, wave_matches, xorg_scores, pair_evidence, blocking_variants, variant_test, seeded_test, surname_successions, k_core, meta_share, stratified_customers, org_batches,
        link_panel_ids, link_edges, link_report, comparisons, batched_links, stored_batches, csv_round_trip, stamped, unstamped, first_titles, parsed_titles, places, pay_bins, person_marks, top_titles,
        officer_accuracy, score_spread, meta_seats, split_ties, parse_tokens, link_queue, link_flag_counts, anomaly_queue, anomaly_counts, review_totals, link_panel_em, link_invariants, link_quality, match_weights, sweep, cross_org, cross_org_invariants, waves,
    )
    return {f.__name__: f for f in names}


# --- oracles ---------------------------------------------------------------------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _role(t: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({t}, {_quoted(p)}) THEN '{r}'" for r, p in title_role_rules().items())
    return f"CASE WHEN {t} IS NULL OR {t} = '' THEN NULL {whens} ELSE 'OTHER' END"


#: Jaro with half transpositions, over rows (a, b): the characters of a, one after another, take the first free equal one of b.
_JARO = """
jin AS (SELECT DISTINCT a, b FROM jp WHERE a IS NOT NULL AND b IS NOT NULL),
jw AS (SELECT a, b, greatest(greatest(length(a), length(b)) // 2 - 1, 0) AS w FROM jin),
jf AS (
  SELECT a, b, list_reduce(list_prepend(b || '|', list_transform(range(1, length(a) + 1), lambda i: CAST(i AS VARCHAR) || '#' || substr(a, i, 1))), lambda s, x:
    CASE WHEN strpos(substr(split_part(s, '|', 1), CAST(greatest(1, CAST(split_part(x, '#', 1) AS INT) - w) AS INT), CAST(CAST(split_part(x, '#', 1) AS INT) + w - greatest(1, CAST(split_part(x, '#', 1) AS INT) - w) + 1 AS INT)), split_part(x, '#', 2)) > 0
    THEN substr(split_part(s, '|', 1), 1, CAST(greatest(1, CAST(split_part(x, '#', 1) AS INT) - w) - 2 + strpos(substr(split_part(s, '|', 1), CAST(greatest(1, CAST(split_part(x, '#', 1) AS INT) - w) AS INT), CAST(CAST(split_part(x, '#', 1) AS INT) + w - greatest(1, CAST(split_part(x, '#', 1) AS INT) - w) + 1 AS INT)), split_part(x, '#', 2)) AS INT)) || '~'
      || substr(split_part(s, '|', 1), CAST(greatest(1, CAST(split_part(x, '#', 1) AS INT) - w) + strpos(substr(split_part(s, '|', 1), CAST(greatest(1, CAST(split_part(x, '#', 1) AS INT) - w) AS INT), CAST(CAST(split_part(x, '#', 1) AS INT) + w - greatest(1, CAST(split_part(x, '#', 1) AS INT) - w) + 1 AS INT)), split_part(x, '#', 2)) AS INT))
      || '|' || split_part(s, '|', 2) || split_part(x, '#', 2)
    ELSE s END) AS s
  FROM jw),
jm AS (
  SELECT a, b, split_part(s, '|', 2) AS ma,
    array_to_string(list_transform(list_filter(range(1, length(b) + 1), lambda i: substr(split_part(s, '|', 1), i, 1) = '~'), lambda i: substr(b, i, 1)), '') AS mb
  FROM jf),
jr AS (
  SELECT a, b, CASE WHEN length(ma) = 0 THEN 0.0::DOUBLE ELSE
    (length(ma)::DOUBLE / length(a) + length(ma)::DOUBLE / length(b) + (length(ma) - len(list_filter(range(1, length(ma) + 1), lambda i: substr(ma, i, 1) <> substr(mb, i, 1))) / 2.0::DOUBLE) / length(ma)) / 3 END AS jaro
  FROM jm)
"""


def _soundex(name: str) -> str:
    """DuckDB SQL for the American Soundex of a column of upper-case letters: the first letter, then the codes of the others.

    H and W are dropped first, so that they don't part equal codes; then equal neighbours become one and vowels go.
    """
    codes = f"translate(regexp_replace({name}, '[^A-Z]', '', 'g'), 'AEIOUYBFPVCGJKQSXZDTLMNR', '000000111122222222334556')"
    run = f"regexp_replace(regexp_replace({codes}, '[HW]', '', 'g'), '(0+|1+|2+|3+|4+|5+|6+)', '\\1', 'g')"
    once = run
    for d in "0123456":
        once = f"regexp_replace({once}, '{d}+', '{d}', 'g')"
    # the first letter's own code goes; where that letter is H or W, none was counted for it
    rest = f"CASE WHEN left({name}, 1) IN ('H', 'W') THEN {once} ELSE substr({once}, 2) END"
    return f"left({name}, 1) || left(replace({rest}, '0', '') || '000', 3)"


def _nick() -> str:
    return ", ".join(f"('{c}', '{v}')" for c, vs in sorted(_nicknames().items()) for v in vs)


_FIRST_RULE = """CASE WHEN a = b THEN 1.0 WHEN length(a) = 1 OR length(b) = 1 THEN CASE WHEN substr(a, 1, 1) = substr(b, 1, 1) THEN 0.6 ELSE 0.0 END
  WHEN EXISTS (SELECT 1 FROM nick WHERE (nick.c = a AND nick.v = b) OR (nick.c = b AND nick.v = a)) THEN 0.95
  ELSE greatest(least(greatest((jaro - 0.5) / 0.5, 0), 1), CASE WHEN sa.code = sb.code THEN 0.5 ELSE 0 END) END"""


def _scores(panel_sql: str, fields: str = "") -> str:
    """CTEs over a panel: r (records with uid), sc (all candidate pairs with their score and similarities), fn and ls (similarities of names)."""
    return f"""WITH RECURSIVE panel AS ({panel_sql}), i AS (SELECT *, 'EIN-' || ein || '-Y-' || taxyr || '-NAME-' || replace(name, ' ', '-') || '-TITLE-' || replace(title_standard, ' ', '-') AS base FROM panel),
r AS (SELECT *, base || CASE WHEN row_number() OVER (PARTITION BY base ORDER BY object_id, table_id) > 1 THEN '-D' || row_number() OVER (PARTITION BY base ORDER BY object_id, table_id) ELSE '' END AS uid FROM i),
n AS (SELECT ein, last_name, count(DISTINCT name) AS c FROM panel GROUP BY 1, 2), dd AS (SELECT ein, count(DISTINCT name) AS d FROM panel GROUP BY 1),
sw AS (SELECT ein, last_name, CASE WHEN d <= 1 THEN 1.0::DOUBLE ELSE least(greatest(ln(d::DOUBLE / c) / ln(d::DOUBLE), 0), 1) END AS w FROM n JOIN dd USING (ein)),
q AS (SELECT r.*, sw.w FROM r JOIN sw ON sw.ein = r.ein AND sw.last_name = r.last_name),
{_name_similarities()},
sc AS (SELECT x.uid AS row_x, y.uid AS row_y, x.taxyr AS yr_x, y.taxyr AS yr_y, x.ein AS org, ls.s AS last_s, fn.s AS first_s, (x.suffix = y.suffix)::INT::DOUBLE AS suffix_s, (x.gender = y.gender)::INT::DOUBLE AS gender_s, tt.jaro AS title_s,
  round(6.0 * CASE WHEN 2 * ls.s - 1 >= 0 THEN least(x.w, y.w) ELSE greatest(x.w, y.w) END * (2 * ls.s - 1) + 5.0 * (2 * fn.s - 1) + coalesce(3.0 * (2 * (x.suffix = y.suffix)::INT - 1), 0) + 2.0 * (2 * (x.gender = y.gender)::INT - 1) + 0.5 * (2 * tt.jaro - 1), 12) AS score
FROM q x JOIN q y ON x.ein = y.ein AND x.taxyr < y.taxyr JOIN ls ON ls.lx = x.last_name AND ls.ly = y.last_name JOIN fn ON fn.fx = x.first_name AND fn.fy = y.first_name JOIN jr tt ON tt.a = x.title_standard AND tt.b = y.title_standard)"""


def _name_similarities() -> str:
    """CTEs over ``panel``: ls (lx, ly, s) and fn (fx, fy, s), the similarities of all its surnames and given names; jr also has titles."""
    return f"""t AS (SELECT DISTINCT last_name AS l, replace(last_name, '-', '') AS s, split_part(last_name, '-', 1) AS t1, nullif(split_part(last_name, '-', 2), '') AS t2 FROM panel),
jp AS (SELECT x.s AS a, y.s AS b FROM t x, t y UNION SELECT x.t1, y.t1 FROM t x, t y UNION SELECT x.t1, y.t2 FROM t x, t y UNION SELECT x.t2, y.t1 FROM t x, t y UNION SELECT x.t2, y.t2 FROM t x, t y
  UNION SELECT x, y FROM (SELECT DISTINCT first_name AS x FROM panel), (SELECT DISTINCT first_name AS y FROM panel) UNION SELECT x, y FROM (SELECT DISTINCT title_standard AS x FROM panel), (SELECT DISTINCT title_standard AS y FROM panel)),
{_JARO},
lt AS (SELECT x.l AS lx, y.l AS ly, s.jaro AS whole, CASE WHEN x.t2 IS NOT NULL AND y.t2 IS NOT NULL THEN (1.0 + CASE WHEN a.jaro >= 0.8 THEN a.jaro ELSE 0 END) / 2 ELSE greatest(a.jaro, coalesce(b.jaro, 0), coalesce(c.jaro, 0)) END AS cov
  FROM t x CROSS JOIN t y JOIN jr s ON s.a = x.s AND s.b = y.s JOIN jr a ON a.a = x.t1 AND a.b = y.t1 LEFT JOIN jr b ON b.a = x.t1 AND b.b = y.t2 LEFT JOIN jr c ON c.a = x.t2 AND c.b = y.t1),
ls AS (SELECT lx, ly, least(greatest((greatest(whole, CASE WHEN cov >= CASE WHEN lx LIKE '%-%' AND ly LIKE '%-%' THEN 0 ELSE 0.8 END THEN cov ELSE 0 END) - 0.5) / 0.5, 0), 1) AS s FROM lt),
nick(c, v) AS (VALUES {_nick()}), fs(n, code) AS (SELECT n, {_soundex('n')} FROM (SELECT DISTINCT first_name AS n FROM panel)),
fn AS (SELECT a AS fx, b AS fy, CAST({_FIRST_RULE} AS DOUBLE) AS s FROM jr LEFT JOIN fs sa ON sa.n = a LEFT JOIN fs sb ON sb.n = b WHERE a IN (SELECT first_name FROM panel) AND b IN (SELECT first_name FROM panel))"""


def _linked(panel_sql: str, edges: str = "SELECT row_x, row_y, yr_x, yr_y, org, score FROM sc WHERE score >= 7", tag: str = "", extra: str = "") -> str:
    """CTEs over a panel, after ``_scores``: fin (what became of each organization's edges) and ids (uid, EMP_ID, EMP_ANCHOR, ...).

    The edges of an organization are taken one after another, best first: one is accepted if neither record has a partner in the other's year yet,
    and merges two clusters that share no year.
    """
    return f"""{_scores(panel_sql)}{extra},
rid AS (SELECT *, row_number() OVER (PARTITION BY ein ORDER BY uid) AS rid FROM r),
ed AS (SELECT z.org, a.rid AS x, b.rid AS y, z.yr_x, z.yr_y, z.score, row_number() OVER (PARTITION BY z.org ORDER BY z.score DESC, z.row_x, z.row_y) AS k FROM ({edges}) z JOIN rid a ON a.ein = z.org AND a.uid = z.row_x JOIN rid b ON b.ein = z.org AND b.uid = z.row_y),
st(org, k, used, cl, links, refused) USING KEY (org) AS (
  SELECT DISTINCT org, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS STRUCT(m BIGINT[], y INT[])[]), CAST([] AS BIGINT[]), CAST(0 AS BIGINT) FROM ed
  UNION ALL
  SELECT org, k, CASE WHEN ok THEN list_concat(used, [x || '|' || yr_y, y || '|' || yr_x]) ELSE used END,
    CASE WHEN ok AND cx.m <> cy.m AND NOT list_has_any(cx.y, cy.y) THEN list_append(list_filter(cl, lambda c: NOT list_contains(c.m, x) AND NOT list_contains(c.m, y)), {{'m': list_concat(cx.m, cy.m), 'y': list_concat(cx.y, cy.y)}}) ELSE cl END,
    CASE WHEN ok THEN list_append(links, k) ELSE links END, refused + CASE WHEN ok AND cx.m <> cy.m AND list_has_any(cx.y, cy.y) THEN 1 ELSE 0 END
  FROM (SELECT st.org, e.k, e.x, e.y, e.yr_x, e.yr_y, st.used, st.cl, st.links, st.refused, NOT list_contains(used, x || '|' || yr_y) AND NOT list_contains(used, y || '|' || yr_x) AS ok,
      coalesce(list_filter(cl, lambda c: list_contains(c.m, e.x))[1], {{'m': [e.x], 'y': [e.yr_x]}}) AS cx, coalesce(list_filter(cl, lambda c: list_contains(c.m, e.y))[1], {{'m': [e.y], 'y': [e.yr_y]}}) AS cy
    FROM st JOIN ed e ON e.org = st.org AND e.k = st.k + 1) z),
mem AS (SELECT org, list_min(m) AS cluster, unnest(m) AS rid FROM (SELECT org, unnest(cl).m AS m FROM st)),
mm AS (SELECT rid.*, coalesce(mem.cluster, rid.rid) AS cluster FROM rid LEFT JOIN mem ON mem.org = rid.ein AND mem.rid = rid.rid),
ids AS (SELECT ein, cluster, arg_min('PYID-' || md5('v1|' || object_id || '|' || table_id), {{'y': taxyr, 'o': object_id, 't': table_id, 'u': uid}}) AS EMP_ANCHOR, CAST(count(*) AS INT) AS EMP_N_RECORDS, CAST(count(DISTINCT taxyr) AS INT) AS EMP_N_YEARS FROM mm GROUP BY 1, 2),
lk AS (SELECT mm.*, EMP_ANCHOR, {_emp_id("EMP_ANCHOR")} AS LINKED_ID, EMP_N_RECORDS, EMP_N_YEARS FROM mm JOIN ids USING (ein, cluster))"""


def _emp_id(anchor: str) -> str:
    return f"'EMP-' || array_to_string(list_transform(range(8), lambda i: substr(upper(md5('ANCHOR|v1|' || {anchor})), CAST(1 + 4 * i AS INT), 4)), '-')"


#: The Fellegi-Sunter model by EM over counted agreement patterns (first name, surname, suffix, gender, title), as one row of lists.
_EM = """,
pat AS (SELECT list({'a': [a1, a2, a3, a4, a5], 'n': n}) AS ps FROM (SELECT (first_s >= 0.5)::INT::DOUBLE AS a1, (last_s >= 0.5)::INT::DOUBLE AS a2, (suffix_s >= 0.5)::INT::DOUBLE AS a3, (gender_s >= 0.5)::INT::DOUBLE AS a4, (title_s >= 0.5)::INT::DOUBLE AS a5, count(*)::DOUBLE AS n FROM sc GROUP BY ALL)),
em(one, it, m, u, p, moved) USING KEY (one) AS (
  SELECT 1, 0, [0.9::DOUBLE, 0.9, 0.9, 0.9, 0.9], [0.1::DOUBLE, 0.1, 0.1, 0.1, 0.1], 0.1::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT 1, it + 1, m2, u2, p2, greatest(list_max(list_transform(range(1, 6), lambda j: abs(m2[j] - m[j]))), list_max(list_transform(range(1, 6), lambda j: abs(u2[j] - u[j]))), abs(p2 - p))
  FROM (SELECT it, m, u, p, list_sum(list_transform(ps, lambda z: z.n * z.g)) / list_sum(list_transform(ps, lambda z: z.n)) AS p2,
      list_transform(range(1, 6), lambda j: least(greatest(coalesce(list_sum(list_transform(ps, lambda z: z.n * z.g * coalesce(z.a[j], 0))) / nullif(list_sum(list_transform(ps, lambda z: CASE WHEN z.a[j] IS NULL THEN 0 ELSE z.n * z.g END)), 0), 0.5), 0.0001), 0.9999)) AS m2,
      list_transform(range(1, 6), lambda j: least(greatest(coalesce(list_sum(list_transform(ps, lambda z: z.n * (1 - z.g) * coalesce(z.a[j], 0))) / nullif(list_sum(list_transform(ps, lambda z: CASE WHEN z.a[j] IS NULL THEN 0 ELSE z.n * (1 - z.g) END)), 0), 0.5), 0.0001), 0.9999)) AS u2
    FROM (SELECT em.it, em.m, em.u, em.p, list_transform(pat.ps, lambda z: {'a': z.a, 'n': z.n, 'g': 1 / (1 + exp(ln(1 - em.p) - ln(em.p) + list_sum(list_transform(range(1, 6), lambda j:
        CASE WHEN z.a[j] = 1 THEN ln(em.u[j]) - ln(em.m[j]) WHEN z.a[j] = 0 THEN ln(1 - em.u[j]) - ln(1 - em.m[j]) ELSE 0 END))))}) AS ps
      FROM em, pat WHERE em.moved >= 0.000001 AND em.it < 200) w) z),
pm AS (SELECT row_x, row_y, yr_x, yr_y, org, round(1 / (1 + exp(-(ln(p / (1 - p)) + coalesce(CASE WHEN first_s >= 0.5 THEN ln(m[1] / u[1]) ELSE ln((1 - m[1]) / (1 - u[1])) END, 0) + coalesce(CASE WHEN last_s >= 0.5 THEN ln(m[2] / u[2]) ELSE ln((1 - m[2]) / (1 - u[2])) END, 0)
  + CASE WHEN suffix_s >= 0.5 THEN ln(m[3] / u[3]) WHEN suffix_s < 0.5 THEN ln((1 - m[3]) / (1 - u[3])) ELSE 0 END + CASE WHEN gender_s >= 0.5 THEN ln(m[4] / u[4]) ELSE ln((1 - m[4]) / (1 - u[4])) END + CASE WHEN title_s >= 0.5 THEN ln(m[5] / u[5]) ELSE ln((1 - m[5]) / (1 - u[5])) END))), 12) AS score FROM sc, em)"""


def _profiles_sql(name: str, where: str, prefix: str = "") -> str:
    """CTE ``name``: persons of part of ``panel``, with the sets and modal values that scores need."""
    return f"""{name} AS (SELECT '{prefix}' || a.EMP_ID AS EMP_ID, org, lasts, firsts, sufs, gender, modal_last FROM
  (SELECT EMP_ID, min(ein) AS org, list_sort(list(DISTINCT last_name)) AS lasts, list_sort(list(DISTINCT first_name)) AS firsts, list_sort(list(DISTINCT suffix) FILTER (suffix IS NOT NULL)) AS sufs, min(gender) AS gender FROM panel WHERE {where} GROUP BY EMP_ID) a
  JOIN (SELECT DISTINCT ON (EMP_ID) EMP_ID, last_name AS modal_last FROM (SELECT EMP_ID, last_name, count(*) AS c FROM panel WHERE {where} GROUP BY 1, 2) ORDER BY EMP_ID, c DESC, length(last_name) DESC, last_name) b USING (EMP_ID))"""


#: Modal names of persons.
_MODAL_NAMES = """ln AS (SELECT DISTINCT ON (EMP_ID) EMP_ID, last_name FROM (SELECT EMP_ID, last_name, count(*) AS c FROM panel GROUP BY 1, 2) ORDER BY EMP_ID, c DESC, length(last_name) DESC, last_name),
fn AS (SELECT DISTINCT ON (EMP_ID) EMP_ID, first_name FROM (SELECT EMP_ID, first_name, count(*) AS c FROM panel GROUP BY 1, 2) ORDER BY EMP_ID, length(first_name) = 1, c DESC, length(first_name) DESC, first_name)"""

#: Coreness: every node takes the h-index of its neighbours' values until nothing changes.
_CORES = """nb AS (SELECT a.id, list(b.id) AS adj FROM a JOIN e ON e.u = a.u JOIN a b ON b.u = e.v GROUP BY a.id),
hs(one, it, h, moved) USING KEY (one) AS (SELECT 1, 0, (SELECT list(CAST(len(adj) AS INT) ORDER BY id) FROM nb), true UNION ALL SELECT 1, it + 1, nh, nh <> h FROM (
  SELECT it, h, list(CAST(least(h[id], len(list_filter(range(1, len(sv) + 1), lambda i: sv[i] >= i))) AS INT) ORDER BY id) AS nh FROM (SELECT hs.it, hs.h, nb.id, list_reverse_sort(list_transform(nb.adj, lambda j: hs.h[j])) AS sv FROM hs, nb WHERE hs.moved) q GROUP BY it, h) z)"""


def _levels(n: int) -> str:
    """CTEs l1 to ln: the pairs of nodes at each distance, and the shortest paths between them."""
    return "".join(f", l{k} AS (SELECT p.s, e.v, {k} AS d, sum(p.n) AS n FROM l{k - 1} p JOIN e ON e.u = p.v WHERE NOT EXISTS (SELECT 1 FROM ({' UNION ALL '.join(f'SELECT s, v FROM l{j}' for j in range(k))}) q WHERE q.s = p.s AND q.v = e.v) GROUP BY 1, 2)" for k in range(1, n + 1))


#: Scores of pairs ``cand`` (emp_a, emp_b) of persons ``both``: the best of name variants, weights by the persons' surnames.
_PERSON_SCORES = """
pw AS (SELECT modal_last, CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE least(greatest(ln(n::DOUBLE / k) / ln(n::DOUBLE), 0), 1) END AS w FROM (SELECT modal_last, count(*) AS k FROM both_ GROUP BY 1), (SELECT count(*) AS n FROM both_)),
lb AS (SELECT a.l AS la, b.l AS lb, max(ls.s) AS s FROM (SELECT DISTINCT lasts AS l FROM both_) a, (SELECT DISTINCT lasts AS l FROM both_) b, ls WHERE list_contains(a.l, ls.lx) AND list_contains(b.l, ls.ly) GROUP BY 1, 2),
fb AS (SELECT a.f AS fa, b.f AS fb, max(fn.s) AS s FROM (SELECT DISTINCT firsts AS f FROM both_) a, (SELECT DISTINCT firsts AS f FROM both_) b, fn WHERE list_contains(a.f, fn.fx) AND list_contains(b.f, fn.fy) GROUP BY 1, 2),
ps AS (SELECT c.*, lb.s AS sim_last_name, fb.s AS sim_first_name, CASE WHEN len(a.sufs) > 0 AND len(b.sufs) > 0 THEN list_has_any(a.sufs, b.sufs)::INT::DOUBLE END AS sim_suffix, (a.gender = b.gender)::INT::DOUBLE AS sim_gender, a.org AS org_a, b.org AS org_b,
  round(6.0 * CASE WHEN 2 * lb.s - 1 >= 0 THEN least(wa.w, wb.w) ELSE greatest(wa.w, wb.w) END * (2 * lb.s - 1) + 5.0 * (2 * fb.s - 1) + coalesce(CASE WHEN len(a.sufs) > 0 AND len(b.sufs) > 0 THEN 3.0 * (2 * list_has_any(a.sufs, b.sufs)::INT - 1) END, 0) + 2.0 * (2 * (a.gender = b.gender)::INT - 1), 12) AS score
  FROM cand c JOIN both_ a ON a.EMP_ID = c.emp_a JOIN both_ b ON b.EMP_ID = c.emp_b JOIN lb ON lb.la = a.lasts AND lb.lb = b.lasts JOIN fb ON fb.fa = a.firsts AND fb.fb = b.firsts JOIN pw wa ON wa.modal_last = a.modal_last JOIN pw wb ON wb.modal_last = b.modal_last)"""


#: Matches of a wave's persons ``pn`` to earlier ones ``po`` of the same organization: best score first, each person once.
_WAVE = f""", both_ AS (SELECT *, false AS new FROM po UNION ALL SELECT *, true FROM pn),
sp AS (SELECT EMP_ID, org, new, replace(l, '-', '') AS n FROM both_, LATERAL (SELECT unnest(lasts) AS l) UNION SELECT EMP_ID, org, new, p FROM both_, LATERAL (SELECT unnest(lasts) AS l), LATERAL (SELECT unnest(string_split(l, '-')) AS p)),
kk AS (SELECT DISTINCT EMP_ID, org, new, {_soundex("n")} AS code FROM sp), kc AS (SELECT org, code, count(*) FILTER (NOT new) * count(*) FILTER (new) AS p FROM kk GROUP BY 1, 2),
cand AS (SELECT DISTINCT x.EMP_ID AS emp_a, y.EMP_ID AS emp_b FROM kk x JOIN kk y ON x.org = y.org AND x.code = y.code JOIN kc ON kc.org = x.org AND kc.code = x.code WHERE NOT x.new AND y.new AND kc.p <= 5000),{_PERSON_SCORES},
ge AS (SELECT org_a AS org, emp_a, emp_b, score, row_number() OVER (PARTITION BY org_a ORDER BY score DESC, emp_a, emp_b) AS k FROM ps WHERE score >= 7),
gs(org, k, used, links) USING KEY (org) AS (SELECT DISTINCT org, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]) FROM ge UNION ALL
  SELECT org, k, CASE WHEN ok THEN list_concat(used, [emp_a, emp_b]) ELSE used END, CASE WHEN ok THEN list_append(links, k) ELSE links END FROM (
    SELECT gs.org, ge.k, gs.used, gs.links, ge.emp_a, ge.emp_b, NOT list_contains(gs.used, ge.emp_a) AND NOT list_contains(gs.used, ge.emp_b) AS ok FROM gs JOIN ge ON ge.org = gs.org AND ge.k = gs.k + 1) z),
matched AS (SELECT ge.* FROM (SELECT org, unnest(links) AS k FROM gs) l JOIN ge ON ge.org = l.org AND ge.k = l.k)"""


def oracle_sql() -> dict[str, str]:
    panel = f"WITH panel AS ({PANEL_SQL})"
    held = _role("title_standard")
    churn = lambda grp: f"""{panel},
r AS (SELECT {grp} AS g, taxyr, EMP_ID, {held} AS role FROM panel),
h AS (SELECT DISTINCT g, taxyr, EMP_ID FROM r WHERE role = 'BOARD'),
y AS (SELECT g, taxyr, lag(taxyr) OVER (PARTITION BY g ORDER BY taxyr) AS p FROM (SELECT DISTINCT g, taxyr FROM r)),
f AS (SELECT y.g, y.taxyr, y.p, s.s FROM y JOIN (SELECT g, min(taxyr) AS s FROM h GROUP BY g) s ON y.g = s.g WHERE y.taxyr >= s.s),
c AS (SELECT f.*, (SELECT count(*) FROM h WHERE h.g = f.g AND h.taxyr = f.taxyr) AS cur, (SELECT count(*) FROM h WHERE h.g = f.g AND h.taxyr = f.p) AS prev,
  (SELECT count(*) FROM h JOIN h k ON h.g = k.g AND h.EMP_ID = k.EMP_ID WHERE h.g = f.g AND h.taxyr = f.taxyr AND k.taxyr = f.p) AS stable FROM f)
SELECT {"g AS ein, " if grp == "ein" else ""}taxyr, CAST(cur AS INT) AS n_current, CAST(CASE WHEN taxyr > s THEN cur - stable END AS INT) AS n_new, CAST(CASE WHEN taxyr > s THEN prev - stable END AS INT) AS n_left,
  CAST(CASE WHEN taxyr > s THEN stable END AS INT) AS n_stable, CAST(CASE WHEN taxyr > s THEN prev END AS INT) AS n_prev,
  round(CASE WHEN taxyr > s AND prev > 0 THEN stable::DOUBLE / prev END, 9) AS retention, round(CASE WHEN taxyr > s AND cur > 0 THEN (cur - stable)::DOUBLE / cur END, 9) AS turnover
FROM c"""  # noqa: E731
    moves = lambda cond, tolerant: f"""{panel},
h AS (SELECT DISTINCT ON (ein, taxyr, EMP_ID) ein, taxyr, EMP_ID, name, title_standard AS title FROM panel WHERE {cond} ORDER BY ein, taxyr, EMP_ID, title_standard, name),
s AS (SELECT ein, taxyr, list(EMP_ID) AS ids FROM h GROUP BY ein, taxyr),
t AS (SELECT ein, taxyr, lag(taxyr) OVER (PARTITION BY ein ORDER BY taxyr) AS prev_year FROM (SELECT DISTINCT ein, taxyr FROM {"h" if tolerant else "panel"})),
j AS (SELECT s.ein, s.taxyr, s.ids, t.prev_year, coalesce(q.ids, []) AS prev FROM s JOIN t ON s.ein = t.ein AND s.taxyr = t.taxyr LEFT JOIN s q ON q.ein = t.ein AND q.taxyr = t.prev_year),
m AS (SELECT h.*, j.prev_year, j.ids, j.prev, NOT list_contains(j.prev, h.EMP_ID) AS incoming FROM h JOIN j ON h.ein = j.ein AND h.taxyr = j.taxyr)
SELECT ein, taxyr, EMP_ID, name, title, prev_year, taxyr - prev_year AS years_since_prev, CAST(len(ids) AS INT) AS n_holders, CAST(len(prev) AS INT) AS n_prev_holders, incoming, NOT incoming AS continuing,
  incoming AND len(prev) > 0 AS transition,
  CASE WHEN incoming AND len(prev) > 0 THEN nullif(array_to_string(list_sort(list_filter(prev, lambda x: NOT list_contains(ids, x))), ';'), '') END AS predecessor
FROM m"""  # noqa: E731
    persons = f"""{panel},
prof AS (
  SELECT EMP_ID, min(ein) AS org, count(*) AS n_records, list_sort(list(DISTINCT last_name)) AS lasts, list_sort(list(DISTINCT first_name)) AS firsts, list_sort(list(DISTINCT taxyr)) AS years,
    min(org_state) AS state, min(org_cbsa) AS cbsa, min(org_ntee) AS ntee, list_sort(list(DISTINCT {held})) AS roles FROM panel GROUP BY EMP_ID),
parts AS (SELECT EMP_ID, replace(l, '-', '') AS n FROM prof, LATERAL (SELECT unnest(lasts) AS l) UNION SELECT EMP_ID, p FROM prof, LATERAL (SELECT unnest(lasts) AS l), LATERAL (SELECT unnest(string_split(l, '-')) AS p)),
lk AS (SELECT DISTINCT EMP_ID, {_soundex('n')} AS code FROM parts)"""
    keys = f"""{persons},
keys AS (
  SELECT EMP_ID, 'strict' AS pass, 'strict|' || code || '|' || state || '|' || substr(ntee, 1, 1) AS block_key, 1 AS r FROM lk JOIN prof USING (EMP_ID)
  UNION ALL SELECT EMP_ID, 'metro', 'metro|' || code || '|' || cbsa || '|' || substr(ntee, 1, 1), 2 FROM lk JOIN prof USING (EMP_ID)
  UNION ALL SELECT EMP_ID, 'geo', 'geo|' || code || '|' || substr(ntee, 1, 1), 3 FROM lk JOIN prof USING (EMP_ID)
  UNION ALL SELECT EMP_ID, 'industry', 'industry|' || code || '|' || state, 4 FROM lk JOIN prof USING (EMP_ID)
  UNION ALL SELECT EMP_ID, 'surname', 'surname|' || code, 5 FROM lk JOIN prof USING (EMP_ID)),
sizes AS (SELECT pass, block_key, count(*) AS n FROM keys GROUP BY pass, block_key)"""
    seats = f"""{panel},
seats AS (SELECT ein AS org, gender || ':' || last_name AS person, list_sort(list(DISTINCT taxyr)) AS years FROM panel GROUP BY 1, 2),
w AS (SELECT a.org AS u1, b.org AS u2, count(*) AS w FROM seats a JOIN seats b ON a.person = b.person AND a.org < b.org GROUP BY 1, 2)"""
    maj = """CASE WHEN substr(org_ntee, 1, 3) IN ('B40','B41','B42','B43','B50') THEN 'UNI' WHEN substr(org_ntee, 1, 3) IN ('E20','E21','E22','E24') THEN 'HOS' WHEN substr(org_ntee, 1, 1) = 'A' THEN 'ART' WHEN substr(org_ntee, 1, 1) = 'B' THEN 'EDU'
  WHEN substr(org_ntee, 1, 1) IN ('C','D') THEN 'ENV' WHEN substr(org_ntee, 1, 1) IN ('E','F','G','H') THEN 'HEL' WHEN substr(org_ntee, 1, 1) BETWEEN 'I' AND 'P' THEN 'HMS' WHEN substr(org_ntee, 1, 1) = 'Q' THEN 'IFA'
  WHEN substr(org_ntee, 1, 1) BETWEEN 'R' AND 'W' THEN 'PSB' WHEN substr(org_ntee, 1, 1) = 'X' THEN 'REL' WHEN substr(org_ntee, 1, 1) = 'Y' THEN 'MMB' ELSE 'UNU' END"""
    rank = lambda t: f"CASE {t} WHEN 'OFFICER' THEN 3 WHEN 'STAFF' THEN 2 WHEN 'OTHER' THEN 1 END"
    nick, first_rule = _nick(), _FIRST_RULE
    flags = f"""WITH panel AS ({PANEL_SQL}), {_name_similarities()}, rj AS (SELECT * FROM (WITH jp AS (SELECT DISTINCT x.name AS a, y.name AS b FROM panel x JOIN panel y ON x.EMP_ID = y.EMP_ID AND x.name < y.name), {_JARO} SELECT a, b, jaro FROM jr)),
g AS (SELECT EMP_ID, min(ein) AS ein, CAST(count(*) AS INT) AS n_records, list_sort(list(DISTINCT CAST(taxyr AS VARCHAR))) AS ys, list_sort(list(DISTINCT name)) AS ns, list_sort(list(DISTINCT first_name)) AS f, list_sort(list(DISTINCT last_name)) AS l FROM panel GROUP BY 1 HAVING count(*) > 1),
v AS (SELECT g.EMP_ID, max(levenshtein(x.n, y.n)::DOUBLE / greatest(length(x.n), length(y.n))) AS lv, 1 - min(rj.jaro) AS jw FROM g, LATERAL (SELECT unnest(g.ns) AS n) x, LATERAL (SELECT unnest(g.ns) AS n) y JOIN rj ON rj.a = x.n AND rj.b = y.n WHERE x.n < y.n GROUP BY 1),
vl AS (SELECT g.EMP_ID, min(ls.s) AS s FROM g, LATERAL (SELECT unnest(g.l) AS n) x, LATERAL (SELECT unnest(g.l) AS n) y JOIN ls ON ls.lx = x.n AND ls.ly = y.n WHERE x.n < y.n GROUP BY 1), vf AS (SELECT g.EMP_ID, min(fn.s) AS s FROM g, LATERAL (SELECT unnest(g.f) AS n) x, LATERAL (SELECT unnest(g.f) AS n) y JOIN fn ON fn.fx = x.n AND fn.fy = y.n WHERE x.n < y.n GROUP BY 1),
h AS (SELECT g.*, coalesce(v.lv, 0) AS lv, coalesce(v.jw, 0) AS jw, coalesce(vl.s, 1) AS ll, coalesce(vf.s, 1) AS ff, len(l) > 1 AS fl, len(f) > 1 AS fi, len(list_distinct(list_transform(ns, lambda n: array_to_string(list_sort(string_split_regex(n, '[ -]')), ' ')))) < len(ns) AS swap FROM g LEFT JOIN v USING (EMP_ID) LEFT JOIN vl USING (EMP_ID) LEFT JOIN vf USING (EMP_ID)),
d AS (SELECT *, lv >= 0.15 OR jw >= 0.15 AS dv FROM h)
SELECT EMP_ID AS emp_id, ein, CAST(NULL AS VARCHAR) AS org_name, n_records, CAST(len(ys) AS INT) AS n_years, array_to_string(ys, ';') AS years, CAST(len(ns) AS INT) AS n_distinct_name, CAST(len(f) AS INT) AS n_distinct_first, CAST(len(l) AS INT) AS n_distinct_last, round(lv, 3) AS name_lv_norm, round(jw, 3) AS name_jw, round(ll, 3) AS last_sim, round(ff, 3) AS first_sim,
  fi AS flag_first_disagree, fl AS flag_last_disagree, dv AS flag_name_divergence, fi OR fl OR dv AS review_flag,
  CASE WHEN fi OR fl OR dv THEN CASE WHEN swap THEN 'order_swap' WHEN fl AND ll >= 0.85 THEN 'surname_compound' WHEN ll >= 0.85 AND ff >= 0.85 THEN 'nickname_or_spelling' ELSE 'review' END END AS category, array_to_string(ns, ' | ') AS names_seen, array_to_string(f, ' | ') AS first_seen, array_to_string(l, ' | ') AS last_seen,
  round(2.0::DOUBLE * fl::INT + 1.5::DOUBLE * fi::INT + 3.0::DOUBLE * round(lv, 3) + 2.0::DOUBLE * round(jw, 3), 6) AS review_score FROM d"""
    known = ", ".join(f"'{n}'" for n in known_first_names())
    log = f"""{panel}, pp AS (SELECT EMP_ID, taxyr, name, CASE WHEN taxyr = 1996 THEN truth_id % 4 END AS kind, first_name AS f0, last_name AS l0 FROM panel),
pq AS (SELECT *, CASE WHEN kind = 1 AND length(f0) > 2 THEN 'MR' || f0 ELSE f0 END AS f, CASE WHEN kind = 2 THEN l0 || ' CPA' WHEN kind = 3 THEN 'X' || l0 ELSE l0 END AS l FROM pp),
ss AS (SELECT EMP_ID, list(DISTINCT f) AS fs, list(DISTINCT l) AS ls FROM pq GROUP BY 1),
px AS (SELECT pq.*, ss.fs, ss.ls, regexp_extract(f, '{review._glue_pattern(HONORIFICS)}', 2) AS rest FROM pq JOIN ss USING (EMP_ID)),
lg AS (SELECT EMP_ID AS emp_id, taxyr AS year, name AS raw_name, f AS first_name, l AS last_name, 'honorific_glue' AS defect_type, rest AS expected_first, '' AS expected_last, CASE WHEN rest IN ({known}) THEN 'self-evident' ELSE 'consensus' END AS source FROM px WHERE rest <> '' AND f NOT IN ({known}) AND (rest IN ({known}) OR list_contains(fs, rest))
  UNION ALL SELECT EMP_ID, taxyr, name, f, l, 'credential_in_surname', '', replace(l0, '-', ' '), 'self-evident' FROM px WHERE kind = 2 UNION ALL SELECT EMP_ID, taxyr, name, f, l, 'surname_letter_glue', '', l0, 'consensus' FROM px WHERE kind = 3 AND list_contains(ls, l0))"""
    roots = ", ".join(f"('{n}', {r!r})" for n, r in name_roots().items())
    silver = f"""{_scores(PANEL_SQL)}, lj AS (SELECT * FROM (WITH jp AS (SELECT x.l AS a, y.l AS b FROM t x, t y), {_JARO} SELECT a, b, jaro FROM jr)), rt(n, c) AS (VALUES {roots}), rn AS (SELECT DISTINCT first_name AS n, coalesce(rt.c, [first_name]) AS c FROM panel LEFT JOIN rt ON rt.n = first_name),
lv AS (SELECT sc.score, lj.jaro AS near, CASE WHEN (length(x.first_name) = 1 OR length(y.first_name) = 1) AND left(x.first_name, 1) = left(y.first_name, 1) THEN 'maybe' WHEN x.first_name = y.first_name OR list_has_any(rx.c, ry.c) OR jf.jaro >= 0.9 THEN 'yes' WHEN jf.jaro < 0.7 THEN 'no' ELSE 'maybe' END AS rel, x.suffix <> y.suffix AS sx
  FROM sc JOIN r x ON x.uid = sc.row_x JOIN r y ON y.uid = sc.row_y JOIN lj ON lj.a = x.last_name AND lj.b = y.last_name JOIN jr jf ON jf.a = x.first_name AND jf.b = y.first_name JOIN rn rx ON rx.n = x.first_name JOIN rn ry ON ry.n = y.first_name),
lb AS (SELECT score, CAST(CASE WHEN sx THEN 0 WHEN (near >= 0.9 OR near < 0.8) AND rel = 'no' THEN 0 WHEN near >= 0.9 AND rel = 'yes' THEN 1 END AS INT) AS label FROM lv)"""
    graph = f"""{seats.replace("WITH ", "WITH RECURSIVE ", 1)}, e AS (SELECT u1 AS u, u2 AS v, w FROM w WHERE w >= 2 UNION ALL SELECT u2, u1, w FROM w WHERE w >= 2), a AS (SELECT u, row_number() OVER (ORDER BY u) AS id FROM (SELECT DISTINCT u FROM e))"""
    meta = f"""{seats.replace("WITH ", "WITH RECURSIVE ", 1)}, z AS (SELECT org, count(*) AS s FROM seats GROUP BY 1), sg AS (SELECT u1, u2 FROM w JOIN z x ON x.org = u1 JOIN z y ON y.org = u2 WHERE w >= 3 AND w::DOUBLE / (x.s + y.s - w) >= 0.9), sb AS (SELECT u1 AS u, u2 AS v FROM sg UNION ALL SELECT u2, u1 FROM sg),
re(s, v) AS (SELECT org, org FROM z UNION SELECT re.s, sb.v FROM re JOIN sb ON sb.u = re.v), mt AS (SELECT re.s AS org, arg_min(re.v, {{'b': -z.s, 'o': re.v}}) AS meta FROM re JOIN z ON z.org = re.v GROUP BY 1)"""
    out = {
        "churn_by_org": churn("ein"),
        "churn_pooled": churn("'ALL'"),
        "transitions": moves("title_standard IN ('CEO', 'EXECUTIVE DIRECTOR')", False),
        "transitions_tolerant": moves("regexp_matches(title_standard, 'CHIEF|PRESIDENT')", True),
        "promotions": f"""{panel},
o AS (SELECT *, {held} AS role, lag(title_standard) OVER l AS pt, lag(taxyr) OVER l AS py, lag(tot_comp) OVER l AS pc, lead(title_standard) OVER l AS nt,
  list(title_standard) OVER (PARTITION BY EMP_ID ORDER BY taxyr ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS older
  FROM (SELECT DISTINCT ON (EMP_ID, taxyr) * FROM panel ORDER BY EMP_ID, taxyr, tot_comp DESC NULLS LAST, title_standard, ein, name) WINDOW l AS (PARTITION BY EMP_ID ORDER BY taxyr)),
c AS (SELECT *, {held.replace("title_standard", "pt")} AS prole FROM o WHERE pt IS NOT NULL AND pt <> title_standard),
jp AS (SELECT pt AS a, title_standard AS b FROM c UNION SELECT nt, pt FROM c UNION SELECT nt, title_standard FROM c UNION SELECT u, title_standard FROM c, LATERAL (SELECT unnest(older) AS u)),
{_JARO},
k AS (SELECT c.*, s.jaro AS sim, x.jaro AS back, y.jaro AS onward, coalesce((SELECT max(jr.jaro) FROM (SELECT unnest(c.older) AS u) z JOIN jr ON jr.a = z.u AND jr.b = c.title_standard), -1) AS up
  FROM c JOIN jr s ON s.a = c.pt AND s.b = c.title_standard LEFT JOIN jr x ON x.a = c.nt AND x.b = c.pt LEFT JOIN jr y ON y.a = c.nt AND y.b = c.title_standard),
d AS (SELECT *, CASE WHEN sim >= 0.85 THEN 'relabel' WHEN up >= 0.85 THEN 'oscillation' WHEN coalesce(back, -1) >= 0.85 AND NOT coalesce(onward, -1) >= 0.85 THEN 'transient' ELSE 'real' END AS change_type,
  CASE WHEN pc > 0 THEN (tot_comp - pc) / pc END AS pct FROM k)
SELECT EMP_ID, ein, py AS from_year, taxyr AS to_year, pt AS from_title, title_standard AS to_title, prole AS from_role, role AS to_role, round(sim, 9) AS sim_standard, round(pct, 9) AS comp_pct, change_type,
  CASE WHEN change_type = 'real' THEN CASE WHEN pct >= 0.1 THEN 'promotion' WHEN pct <= -0.1 THEN 'demotion' WHEN pct IS NOT NULL THEN 'lateral'
    WHEN {rank("role")} > {rank("prole")} THEN 'promotion' WHEN {rank("role")} < {rank("prole")} THEN 'demotion' ELSE 'lateral' END END AS direction,
  CASE WHEN change_type = 'real' THEN CASE WHEN pct IS NOT NULL THEN 'comp' WHEN {rank("role")} <> {rank("prole")} THEN 'role' ELSE 'none' END ELSE 'none' END AS basis
FROM d""",
        "role_coverage": f"{panel} SELECT title_standard AS title, count(*) AS n, {held} AS role FROM panel GROUP BY title_standard",
        "surname_weights": f"""{panel}, n AS (SELECT ein, last_name, count(DISTINCT name) AS c FROM panel GROUP BY 1, 2), d AS (SELECT ein, count(DISTINCT name) AS d FROM panel GROUP BY 1)
SELECT ein, last_name, round(CASE WHEN d <= 1 THEN 1.0::DOUBLE ELSE least(greatest(ln(d::DOUBLE / c) / ln(d::DOUBLE), 0), 1) END, 9) AS surname_w FROM n JOIN d USING (ein)""",
        "population_weights": f"""{panel}, n AS (SELECT EMP_ID, last_name, count(*) AS c FROM panel GROUP BY 1, 2), m AS (SELECT DISTINCT ON (EMP_ID) EMP_ID, last_name FROM n ORDER BY EMP_ID, c DESC, length(last_name) DESC, last_name),
t AS (SELECT last_name, count(*) AS k FROM m GROUP BY 1), a AS (SELECT count(*) AS n FROM m)
SELECT last_name, round(CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE least(greatest(ln(n::DOUBLE / k) / ln(n::DOUBLE), 0), 1) END, 9) AS weight FROM t, a""",
        "id_strings": f"""{panel}, b AS (SELECT *, 'EIN-' || ein || '-Y-' || taxyr || '-NAME-' || replace(name, ' ', '-') || '-TITLE-' || replace(title_standard, ' ', '-') AS base FROM panel),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY object_id, table_id) AS k FROM b)
SELECT truth_id, taxyr, base || CASE WHEN k > 1 THEN '-D' || k ELSE '' END AS id_string, 'PYID-' || md5('v1|' || object_id || '|' || table_id) AS person_year_id FROM n""",
        "anchors": f"""{panel}, f AS (SELECT DISTINCT ON (EMP_ID) EMP_ID, 'PYID-' || md5('v1|' || object_id || '|' || table_id) AS a FROM panel ORDER BY EMP_ID, taxyr, object_id, table_id)
SELECT EMP_ID AS old_emp_id, 'EMP-' || array_to_string(list_transform(range(8), lambda i: substr(upper(md5('ANCHOR|v1|' || a)), CAST(1 + 4 * i AS INT), 4)), '-') AS new_emp_id, a AS emp_anchor FROM f""",
        "batches": f"""{panel}, o AS (SELECT lpad(CAST(CAST('0x' || substr(md5(ein), 1, 7) AS BIGINT) % 16 AS VARCHAR), 2, '0') AS batch, ein, count(*) AS n FROM panel GROUP BY 1, 2)
SELECT batch, CAST(sum(n) AS BIGINT) AS records, count(*) AS orgs, max(n) AS max_org, sum(n::DOUBLE * n) AS cost FROM o GROUP BY batch""",
        "profiles": f"""{panel}, r AS (SELECT *, {held} AS role FROM panel),
ln AS (SELECT DISTINCT ON (EMP_ID) EMP_ID, last_name FROM (SELECT EMP_ID, last_name, count(*) AS c FROM r GROUP BY 1, 2) ORDER BY EMP_ID, c DESC, length(last_name) DESC, last_name),
fn AS (SELECT DISTINCT ON (EMP_ID) EMP_ID, first_name FROM (SELECT EMP_ID, first_name, count(*) AS c FROM r GROUP BY 1, 2) ORDER BY EMP_ID, length(first_name) = 1, c DESC, length(first_name) DESC, first_name),
pr AS (SELECT DISTINCT ON (EMP_ID) EMP_ID, role FROM (SELECT EMP_ID, role, count(*) AS c FROM r GROUP BY 1, 2) ORDER BY EMP_ID, c DESC, length(role) DESC, role),
g AS (SELECT EMP_ID, CAST(count(*) AS INT) AS n_records, CAST(count(DISTINCT ein) AS INT) AS n_orgs, CAST(count(DISTINCT taxyr) AS INT) AS n_years, min(taxyr) AS first_year, max(taxyr) AS last_year, min(gender) AS gender, bool_or(role = 'BOARD') AS is_board,
  array_to_string(list_sort(list(DISTINCT taxyr)), ';') AS years, array_to_string(list_sort(list(DISTINCT last_name)), ';') AS last_name_variants, array_to_string(list_sort(list(DISTINCT first_name)), ';') AS first_name_variants,
  coalesce(array_to_string(list_sort(list(DISTINCT suffix) FILTER (suffix IS NOT NULL)), ';'), '') AS suffixes, array_to_string(list_sort(list(DISTINCT title_standard)), ';') AS titles, array_to_string(list_sort(list(DISTINCT ein)), ';') AS orgs,
  array_to_string(list_sort(list(DISTINCT role)), ';') AS roles, array_to_string(list_sort(list(DISTINCT org_state)), ';') AS states, array_to_string(list_sort(list(DISTINCT org_cbsa)), ';') AS cbsa, array_to_string(list_sort(list(DISTINCT org_ntee)), ';') AS ntee
  FROM r GROUP BY EMP_ID)
SELECT g.*, ln.last_name, fn.first_name, substr(fn.first_name, 1, 1) AS first_initial, pr.role AS primary_role FROM g JOIN ln USING (EMP_ID) JOIN fn USING (EMP_ID) JOIN pr USING (EMP_ID)""",
        "blocking_keys": f"{keys} SELECT EMP_ID, pass, block_key FROM keys",
        "block_census": f"""{keys}, g AS (SELECT pass, n FROM sizes UNION ALL SELECT 'ALL', n FROM sizes), u AS (SELECT DISTINCT k.pass, k.EMP_ID FROM keys k JOIN sizes s ON k.pass = s.pass AND k.block_key = s.block_key WHERE s.n BETWEEN 2 AND 150),
p AS (SELECT pass, count(*) AS people FROM u GROUP BY pass UNION ALL SELECT 'ALL', count(DISTINCT EMP_ID) FROM u)
SELECT g.pass, count(*) FILTER (n >= 2) AS blocks, CAST(sum(n) AS BIGINT) AS memberships, coalesce(sum(n::DOUBLE * (n - 1) / 2) FILTER (n BETWEEN 2 AND 150), 0) AS comparisons, count(*) FILTER (n > 150) AS dropped_blocks,
  CAST(coalesce(sum(n) FILTER (n > 150), 0) AS BIGINT) AS dropped_memberships, coalesce(sum(n::DOUBLE * (n - 1) / 2) FILTER (n > 150), 0) AS dropped_comparisons, max(n) AS largest_block, coalesce(max(people), 0) AS people,
  (SELECT count(DISTINCT EMP_ID) FROM keys) AS persons, round(coalesce(max(people), 0)::DOUBLE / (SELECT count(DISTINCT EMP_ID) FROM keys), 4) AS people_share
FROM g LEFT JOIN p ON g.pass = p.pass GROUP BY g.pass""",
        "xorg_candidates": f"""{keys}, m AS (SELECT k.*, o.org FROM keys k JOIN prof o USING (EMP_ID) JOIN sizes s ON k.pass = s.pass AND k.block_key = s.block_key WHERE s.n BETWEEN 2 AND 5000)
SELECT a.EMP_ID AS emp_a, b.EMP_ID AS emp_b, arg_min(a.pass, a.r) AS pass, CAST(min(a.r) AS INT) AS pass_rank, CAST(count(*) AS INT) AS n_shared_buckets FROM m a JOIN m b ON a.block_key = b.block_key AND a.EMP_ID < b.EMP_ID AND a.org <> b.org GROUP BY 1, 2""",
        "xorg_dropped_blocks": f"{keys} SELECT block_key, pass, n FROM sizes WHERE n > 60",
        "wave_candidates": f"""{panel}, parts AS (SELECT EMP_ID, ein, taxyr >= 2000 AS new, replace(last_name, '-', '') AS n FROM panel UNION SELECT EMP_ID, ein, taxyr >= 2000, p FROM panel, LATERAL (SELECT unnest(string_split(last_name, '-')) AS p)),
k AS (SELECT DISTINCT EMP_ID, ein, new, {_soundex('n')} AS code FROM parts), c AS (SELECT ein, code, count(*) FILTER (NOT new) * count(*) FILTER (new) AS p FROM k GROUP BY 1, 2)
SELECT DISTINCT a.EMP_ID AS emp_a, 'W-' || b.EMP_ID AS emp_b FROM k a JOIN k b ON a.ein = b.ein AND a.code = b.code JOIN c ON c.ein = a.ein AND c.code = a.code WHERE NOT a.new AND b.new AND c.p <= 5000""",
        "wave_reloads": f"{panel} SELECT object_id, table_id, taxyr FROM panel WHERE taxyr >= 2000",
        "anomalies": f"""{panel}, y AS (SELECT EMP_ID, taxyr, lead(taxyr) OVER (PARTITION BY EMP_ID ORDER BY taxyr) - taxyr - 1 AS gap FROM (SELECT DISTINCT EMP_ID, taxyr FROM panel)),
g AS (SELECT EMP_ID, CAST(count(*) AS INT) AS n_years, min(taxyr) AS first_year, max(taxyr) AS last_year, CAST(count(*) FILTER (gap > 0) AS INT) AS n_gaps, CAST(coalesce(max(gap), 0) AS INT) AS max_gap FROM y GROUP BY 1),
cut AS (SELECT y.EMP_ID, min(taxyr) AS cut FROM y JOIN g ON y.EMP_ID = g.EMP_ID AND y.gap = g.max_gap GROUP BY 1),
pay AS (SELECT p.EMP_ID, avg(tot_comp) FILTER (taxyr <= cut) AS b, avg(tot_comp) FILTER (taxyr > cut) AS a FROM panel p JOIN cut USING (EMP_ID) WHERE tot_comp > 0 GROUP BY 1),
hom AS (SELECT DISTINCT ein, name FROM (SELECT ein, taxyr, name FROM panel GROUP BY 1, 2, 3 HAVING count(*) > 1)),
dup AS (SELECT DISTINCT object_id, name, title_standard FROM (SELECT object_id, name, title_standard FROM panel GROUP BY 1, 2, 3 HAVING count(*) > 1)),
q AS (SELECT p.EMP_ID, CAST(count(*) AS INT) AS n_records, bool_or(h.name IS NOT NULL) AS homonym_copresent, bool_or(d.name IS NOT NULL) AS dup_line_in_filing, array_to_string(list_sort(list(DISTINCT p.name)), ' | ') AS names_seen
  FROM panel p LEFT JOIN hom h ON h.ein = p.ein AND h.name = p.name LEFT JOIN dup d ON d.object_id = p.object_id AND d.name = p.name AND d.title_standard = p.title_standard GROUP BY 1),
s AS (SELECT g.*, q.* EXCLUDE (EMP_ID), last_year - first_year + 1 AS span, round(n_years::DOUBLE / (last_year - first_year + 1), 3) AS density, round(CASE WHEN max_gap >= 2 THEN abs(a - b) / greatest(b, 1.0) END, 3) AS pay_shift
  FROM g JOIN q USING (EMP_ID) LEFT JOIN pay USING (EMP_ID)),
t AS (SELECT *, max_gap >= 3 AND n_years >= 4 AS gap_return, max_gap >= 5 AS gap_long, coalesce(max_gap >= 2 AND pay_shift > 1.0, false) AS gap_pay_shift, coalesce(span >= 6 AND density < 0.4, false) AS sporadic FROM s)
SELECT EMP_ID AS emp_id, CASE WHEN dup_line_in_filing THEN 'duplicate_line' WHEN homonym_copresent THEN 'homonym_copresent' WHEN gap_pay_shift THEN 'sequential_homonym_pay' WHEN gap_return THEN 'sequential_homonym_gap' WHEN gap_long OR sporadic THEN 'intermittent' END AS category,
  3.0::DOUBLE * homonym_copresent::INT + 2.0::DOUBLE * gap_return::INT + 1.5::DOUBLE * gap_long::INT + 2.5::DOUBLE * gap_pay_shift::INT + 1.0::DOUBLE * sporadic::INT AS merge_risk,
  n_records, n_years, first_year, last_year, span, density, n_gaps, max_gap, n_gaps + 1 AS n_spells, pay_shift, homonym_copresent, gap_return, gap_long, gap_pay_shift, sporadic, dup_line_in_filing, names_seen FROM t""",
        "filings": """SELECT DISTINCT ON (o_custkey, year(o_orderdate)) o_custkey AS ein, CAST(year(o_orderdate) AS INT) AS taxyr, o_orderkey AS "OBJECTID" FROM orders ORDER BY o_custkey, year(o_orderdate), CAST(o_orderdate AS DATE) DESC, (o_orderpriority = '1-URGENT') DESC, o_orderkey DESC""",
        "membership": """WITH d AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS org, CAST(year(o_orderdate) AS INT) AS y FROM orders), e AS (SELECT min(y) AS lo, max(y) AS hi FROM d), l AS (SELECT *, lead(y) OVER (PARTITION BY org ORDER BY y) - y AS d FROM d),
g AS (SELECT org, min(y) AS f, max(y) AS t, CAST(count(*) AS INT) AS n, CAST(count(*) FILTER (d > 1) AS INT) AS gc, CAST(coalesce(max(d - 1) FILTER (d > 1), 0) AS INT) AS gm FROM l GROUP BY 1)
SELECT org, f AS panel_year_first, t AS panel_year_last, n AS panel_year_count, gc AS panel_gap_count, gm AS panel_gap_size_max, CASE WHEN f = lo AND t = hi THEN 'persistent' WHEN t = hi THEN 'entrant' WHEN f = lo THEN 'exit' ELSE 'transient' END AS panel_type,
  t - f + 1 AS span, CASE WHEN t - f + 1 = n THEN 'seamless' ELSE 'segmented' END AS panel_spell, t - f + 1 - n AS panel_gap_years FROM g, e""",
        "org_costs": f"""{panel}, p AS (SELECT ein, taxyr, count(*) AS n FROM panel GROUP BY 1, 2), g AS (SELECT ein, min(taxyr) AS first_year, max(taxyr) AS last_year, count(*) AS n_years, CAST(sum(n) AS BIGINT) AS n_records, max(n) AS max_records_year FROM p GROUP BY 1)
SELECT *, 'ORG ' || ein || ' ' || last_year AS org_name, n_records::DOUBLE * n_records AS cost, round(n_records::DOUBLE * n_records / (SELECT sum(n_records::DOUBLE * n_records) FROM g), 12) AS cost_share FROM g""",
        "org_projection": f"""{seats}, z AS (SELECT org, count(*) AS s FROM seats GROUP BY 1)
SELECT u1, u2, w, a.s AS s1, b.s AS s2, round(w::DOUBLE / (a.s + b.s - w), 9) AS jaccard, round(w::DOUBLE / least(a.s, b.s), 9) AS overlap FROM w JOIN z a ON a.org = u1 JOIN z b ON b.org = u2""",
        "person_projection": f"""{seats}, k AS (SELECT person FROM seats GROUP BY 1 HAVING count(*) >= 2), y AS (SELECT org, person, unnest(years) AS y FROM seats WHERE person IN (SELECT person FROM k))
SELECT DISTINCT a.person AS p1, b.person AS p2 FROM y a JOIN y b ON a.org = b.org AND a.y = b.y AND a.person < b.person""",
        "group_mixing": f"""{seats}, g AS (SELECT DISTINCT ein AS u, {maj} AS grp FROM panel), n AS (SELECT grp, count(*)::DOUBLE AS n FROM g GROUP BY 1),
t AS (SELECT least(x.grp, y.grp) AS a, greatest(x.grp, y.grp) AS b, count(*) AS ties FROM w JOIN g x ON x.u = u1 JOIN g y ON y.u = u2 GROUP BY 1, 2)
SELECT a, b, ties, CASE WHEN a = b THEN p.n * (p.n - 1) / 2 ELSE p.n * q.n END AS possible, round(1000 * ties::DOUBLE / CASE WHEN a = b THEN p.n * (p.n - 1) / 2 ELSE p.n * q.n END, 9) AS density FROM t JOIN n p ON p.grp = a JOIN n q ON q.grp = b""",
        "ei_index": f"""{seats}, g AS (SELECT DISTINCT ein AS u, org_cbsa AS grp FROM panel)
SELECT count(*) AS ties, round(avg((x.grp <> y.grp)::INT), 9) AS external, round(avg((x.grp = y.grp)::INT), 9) AS internal, round(avg(1 - 2 * (x.grp = y.grp)::INT), 9) AS ei FROM w JOIN g x ON x.u = u1 JOIN g y ON y.u = u2""",
        "network_summary": f"""{seats} SELECT (SELECT count(DISTINCT org) FROM seats) AS units, (SELECT count(*) FROM (SELECT person FROM seats GROUP BY 1 HAVING count(*) >= 2)) AS interlockers, count(*) AS ties_1plus, count(*) FILTER (w >= 2) AS ties_2plus,
  (SELECT count(*) FROM (SELECT u1 FROM w UNION SELECT u2 FROM w)) AS tied_units, round(2 * count(*)::DOUBLE / (SELECT count(*) FROM (SELECT u1 FROM w UNION SELECT u2 FROM w)), 9) AS mean_degree FROM w""",
        "bridges": f"""{seats}, a AS (SELECT DISTINCT ein AS u, CASE {maj} WHEN 'UNI' THEN 'EDU' WHEN 'HOS' THEN 'HEL' ELSE {maj} END AS sector, org_cbsa AS cbsa FROM panel), k AS (SELECT person FROM seats GROUP BY 1 HAVING count(*) >= 2),
sole AS (SELECT x.person, count(*) FILTER (w.w = 1) AS n FROM seats x JOIN seats y ON x.person = y.person AND x.org < y.org JOIN w ON w.u1 = x.org AND w.u2 = y.org GROUP BY 1)
SELECT s.person, count(*) AS boards, count(DISTINCT nullif(sector, 'UNU')) AS sectors, count(DISTINCT cbsa) AS cbsas, max(coalesce(sole.n, 0)) AS sole_links FROM seats s JOIN k USING (person) JOIN a ON a.u = s.org LEFT JOIN sole ON sole.person = s.person GROUP BY 1""",
        "spanners": f"""{seats}, p AS (SELECT DISTINCT ein AS u, org_state AS place FROM panel), t AS (SELECT u1, u2, w, x.place <> y.place AS c FROM w JOIN p x ON x.u = u1 JOIN p y ON y.u = u2 WHERE w >= 3),
e AS (SELECT u1 AS u, w, c FROM t UNION ALL SELECT u2, w, c FROM t), n AS (SELECT u, count(*) AS ties, count(*) FILTER (c) AS ct, CAST(coalesce(sum(w) FILTER (c), 0) AS BIGINT) AS cm FROM e GROUP BY 1)
SELECT p.u AS unit, place, coalesce(ties, 0) AS ties, coalesce(ct, 0) AS cross_ties, coalesce(cm, 0) AS cross_members, CASE WHEN coalesce(ct, 0) > 0 THEN 'spanner' WHEN coalesce(ties, 0) > 0 THEN 'tied within its place' ELSE 'no ties' END AS kind FROM p LEFT JOIN n ON n.u = p.u""",
        "transitivity": f"""{seats}, e AS (SELECT u1, u2 FROM w WHERE w >= 3), t AS (SELECT count(*) AS n FROM e a JOIN e b ON a.u2 = b.u1 JOIN e c ON c.u1 = a.u1 AND c.u2 = b.u2), d AS (SELECT u, count(*) AS d FROM (SELECT u1 AS u FROM e UNION ALL SELECT u2 FROM e) GROUP BY 1)
SELECT t.n AS triangles, x.wd AS wedges, CASE WHEN x.wd > 0 THEN round(3 * t.n::DOUBLE / x.wd, 9) END AS transitivity FROM t, (SELECT coalesce(sum(d::DOUBLE * (d - 1) / 2), 0) AS wd FROM d) x""",
        "name_risk": f"""{panel}, ln AS (SELECT DISTINCT ON (EMP_ID) EMP_ID, last_name FROM (SELECT EMP_ID, last_name, count(*) AS c FROM panel GROUP BY 1, 2) ORDER BY EMP_ID, c DESC, length(last_name) DESC, last_name),
fn AS (SELECT DISTINCT ON (EMP_ID) EMP_ID, first_name FROM (SELECT EMP_ID, first_name, count(*) AS c FROM panel GROUP BY 1, 2) ORDER BY EMP_ID, length(first_name) = 1, c DESC, length(first_name) DESC, first_name),
b AS (SELECT EMP_ID, min(ein) AS org, bool_or({held} = 'BOARD') AS board FROM panel GROUP BY 1), p AS (SELECT * FROM ln JOIN fn USING (EMP_ID) JOIN b USING (EMP_ID)),
f AS (SELECT first_name, count(*) AS n FROM p GROUP BY 1), l AS (SELECT last_name, count(*) AS n FROM p GROUP BY 1), t AS (SELECT count(*) AS n FROM p)
SELECT p.first_name || ' ' || p.last_name AS person, count(DISTINCT org) AS boards, count(*) AS records, CAST(1 AS BIGINT) AS names, round(max(t.n::DOUBLE * f.n / t.n * l.n / t.n), 9) AS lambda, false AS mi_confirmed, max(t.n::DOUBLE * f.n / t.n * l.n / t.n) >= 1 AS ambiguous
FROM p JOIN f USING (first_name) JOIN l USING (last_name), t WHERE board GROUP BY 1 HAVING count(DISTINCT org) >= 2""",
        "board_edges": f"""{keys}, c AS (SELECT DISTINCT a.EMP_ID AS emp_a, b.EMP_ID AS emp_b FROM keys a JOIN keys b ON a.block_key = b.block_key AND a.EMP_ID < b.EMP_ID JOIN prof x ON x.EMP_ID = a.EMP_ID JOIN prof y ON y.EMP_ID = b.EMP_ID WHERE a.pass = 'strict' AND x.org <> y.org),
ok AS (SELECT EMP_ID, array_to_string(roles, '+') AS r, NOT (len(roles) > 0 AND len(list_filter(roles, lambda z: z NOT IN ('OFFICER', 'STAFF'))) = 0) AS ok FROM prof)
SELECT emp_a, emp_b, a.r AS roles_a, b.r AS roles_b FROM c JOIN ok a ON a.EMP_ID = emp_a JOIN ok b ON b.EMP_ID = emp_b WHERE a.ok OR b.ok""",
        "xorg_diff": f"""{panel}, q AS (SELECT EMP_ID, ein, taxyr < 1999 AS early, first_name || ' ' || last_name AS x FROM panel), a0 AS (SELECT EMP_ID, ein, min(x) AS x FROM q WHERE early GROUP BY 1, 2), b0 AS (SELECT EMP_ID, ein, min(x) AS x FROM q GROUP BY 1, 2),
a AS (SELECT EMP_ID, (SELECT count(DISTINCT ein) FROM a0 z WHERE z.x = a0.x) AS p FROM a0), b AS (SELECT EMP_ID, (SELECT count(DISTINCT ein) FROM b0 z WHERE z.x = b0.x) AS n FROM b0), j AS (SELECT b.EMP_ID, n, p FROM b LEFT JOIN a USING (EMP_ID))
SELECT EMP_ID, 'new' AS change FROM j WHERE p IS NULL UNION ALL SELECT EMP_ID, 'grew' FROM j WHERE n > p UNION ALL SELECT EMP_ID, 'newly_interlocking' FROM j WHERE p <= 1 AND n > 1""",
        "record_checks": f"""{panel}, p AS (SELECT ein AS EMP_ID, count(DISTINCT suffix) AS s, count(DISTINCT gender) AS g, max((suffix NOT IN ('JR', 'II'))::INT) AS m FROM panel GROUP BY 1),
y AS (SELECT ein AS EMP_ID, count(DISTINCT first_name || '|' || last_name || '|' || coalesce(suffix, '')) AS n, count(DISTINCT title_standard) AS t FROM panel GROUP BY ein, taxyr HAVING count(*) > 1)
SELECT "check", count(DISTINCT EMP_ID) AS records FROM (SELECT EMP_ID, 'suffix conflict' AS "check" FROM p WHERE s > 1 AND m = 1 UNION ALL SELECT EMP_ID, 'gender mixed' FROM p WHERE g > 1 UNION ALL SELECT EMP_ID, CASE WHEN n = 1 AND t = 1 THEN 'two rows in one year: duplicate' ELSE 'two rows in one year: differing' END FROM y) GROUP BY 1""",
        "linkage_summary": f"""{panel}, p AS (SELECT org_state AS grp, EMP_ID, count(*) AS n, count(DISTINCT taxyr) AS y FROM panel GROUP BY 1, 2), o AS (SELECT org_state AS grp, count(DISTINCT ein) AS orgs FROM panel GROUP BY 1),
r AS (SELECT grp, avg((n > 1)::INT) AS s FROM (SELECT org_state AS grp, EMP_ID, taxyr, count(*) AS n FROM panel GROUP BY 1, 2, 3) GROUP BY 1)
SELECT p.grp, CAST(sum(n) AS BIGINT) AS records, count(*) AS persons, max(orgs) AS orgs, round(1 - count(*)::DOUBLE / sum(n)::DOUBLE, 9) AS compression, round(avg((y > 1)::INT), 9) AS share_multi_year, round(median(y) FILTER (y > 1), 9) AS median_years, round(max(r.s), 9) AS share_repeated_in_year
FROM p JOIN o ON o.grp = p.grp JOIN r ON r.grp = p.grp GROUP BY p.grp""",
        "ceo_continuity": f"""{panel}, s AS (SELECT ein, taxyr, list(DISTINCT EMP_ID) AS e FROM panel WHERE title_standard = 'CEO' GROUP BY 1, 2)
SELECT count(*) AS n, round(avg(list_has_any(a.e, b.e)::INT), 9) AS kept FROM s a JOIN s b ON a.ein = b.ein AND a.taxyr + 1 = b.taxyr""",
        "surname_similarity": f"{panel}, v AS (SELECT DISTINCT last_name AS n FROM panel), jp AS (SELECT x.n AS a, y.n AS b FROM v x JOIN v y ON x.n < y.n), {_JARO} SELECT a, b, round(jaro, 9) AS jaro FROM jr",
        "first_name_similarity": f"""{panel}, v AS (SELECT DISTINCT first_name AS n FROM panel), jp AS (SELECT x.n AS a, y.n AS b FROM v x JOIN v y ON x.n <= y.n), {_JARO}, nick(c, v) AS (VALUES {nick}), fs(n, code) AS (SELECT n, {_soundex('n')} FROM (SELECT DISTINCT first_name AS n FROM panel))
SELECT a, b, round(CAST({first_rule} AS DOUBLE), 9) AS sim FROM jr LEFT JOIN fs sa ON sa.n = a LEFT JOIN fs sb ON sb.n = b""",
        "pair_scores": f"{_scores(PANEL_SQL)} SELECT row_x, row_y, yr_x, yr_y, org, round(score, 6) AS score FROM sc",
        "stratified_customers": """WITH n AS (SELECT c_nationkey, count(*) AS pop FROM customer GROUP BY 1), t AS (SELECT *, least(pop, greatest(5, CAST(round(200 * sqrt(pop) / (SELECT sum(sqrt(pop)) FROM n)) AS BIGINT))) AS take FROM n),
r AS (SELECT c_custkey, c.c_nationkey, pop, take, row_number() OVER (PARTITION BY c.c_nationkey ORDER BY md5('s' || chr(0) || c_custkey), c_custkey) AS k FROM customer c JOIN t ON t.c_nationkey = c.c_nationkey)
SELECT c_custkey, c_nationkey, round(pop::DOUBLE / take, 9) AS weight FROM r WHERE k <= take""",
        "org_batches": f"{panel} SELECT ein, CAST(ntile(7) OVER (ORDER BY ein) AS INT) AS batch FROM (SELECT DISTINCT ein FROM panel)",
        "link_panel_ids": f"{_linked(PANEL_SQL)} SELECT truth_id, ein, taxyr, LINKED_ID AS EMP_ID, EMP_ANCHOR, EMP_N_RECORDS, EMP_N_YEARS FROM lk",
        "batched_links": f"{_linked(PANEL_SQL)} SELECT truth_id, ein, taxyr, LINKED_ID AS EMP_ID FROM lk",
        "link_edges": f"""{_linked(PANEL_SQL)} SELECT a.uid AS row_x, b.uid AS row_y, round(e.score, 6) AS score FROM (SELECT org, unnest(links) AS k FROM st) l JOIN ed e ON e.org = l.org AND e.k = l.k
JOIN rid a ON a.ein = e.org AND a.rid = e.x JOIN rid b ON b.ein = e.org AND b.rid = e.y""",
        "link_report": f"""{_linked(PANEL_SQL)} SELECT (SELECT count(*) FROM rid) AS n_records, (SELECT count(DISTINCT ein) FROM rid) AS n_orgs, (SELECT count(DISTINCT taxyr) FROM rid) AS n_years, count(*) AS n_clusters, count(*) FILTER (EMP_N_RECORDS = 1) AS n_singletons,
  count(*) FILTER (EMP_N_RECORDS > 1) AS n_multi_year, (SELECT CAST(sum(len(links)) AS BIGINT) FROM st) AS n_links, (SELECT CAST(sum(refused) AS BIGINT) FROM st) AS rejected_edges, round(1 - count(*)::DOUBLE / (SELECT count(*) FROM rid), 9) AS compression FROM ids""",
        "link_quality": f"""{_linked(PANEL_SQL)}, g AS (SELECT ein, LINKED_ID AS e, truth_id AS t, count(*)::DOUBLE AS n FROM lk GROUP BY 1, 2, 3), b AS (SELECT sum(n * (n - 1) / 2) AS v FROM g), l AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM g GROUP BY ein, e)), u AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM g GROUP BY ein, t))
SELECT b.v AS "both", l.v AS linked, u.v AS "true", round(b.v / l.v, 9) AS precision, round(b.v / u.v, 9) AS recall FROM b, l, u""",
        "link_panel_em": f"""{_linked(PANEL_SQL, "SELECT row_x, row_y, yr_x, yr_y, org, score FROM pm WHERE score >= 0.5", extra=_EM)}, ac AS (SELECT e.org, cx.cluster, e.score FROM (SELECT org, unnest(links) AS k FROM st) l JOIN ed e ON e.org = l.org AND e.k = l.k
  JOIN mm cx ON cx.ein = e.org AND cx.rid = e.x JOIN mm cy ON cy.ein = e.org AND cy.rid = e.y WHERE cx.cluster = cy.cluster), cf AS (SELECT org, cluster, min(score) AS c FROM ac GROUP BY 1, 2)
SELECT truth_id, ein, taxyr, LINKED_ID AS EMP_ID, EMP_N_RECORDS, round(cf.c, 6) AS EMP_LINK_CONF FROM lk LEFT JOIN cf ON cf.org = lk.ein AND cf.cluster = lk.cluster""",
        "match_weights": f"""{_scores(PANEL_SQL)}{_EM} SELECT ['first_name', 'last_name', 'suffix', 'gender', 'title_standard'][j] AS feature, round(m[j], 3) AS m, round(u[j], 3) AS u, round(log2(m[j] / u[j]), 2) AS w_agree, round(log2((1 - m[j]) / (1 - u[j])), 2) AS w_disagree FROM em, (SELECT unnest(range(1, 6)) AS j)""",
        "comparisons": f"{_scores(PANEL_SQL)} SELECT row_x, row_y, round(first_s, 9) AS first_name, round(last_s, 9) AS last_name, suffix_s AS suffix, gender_s AS gender, round(title_s, 9) AS title_standard FROM sc",
        "wave_matches": f"""WITH RECURSIVE panel AS ({PANEL_SQL}), {_name_similarities()}, {_profiles_sql("po", "taxyr <= 1999")}, {_profiles_sql("pn", "taxyr >= 2000", "W-")}{_WAVE} SELECT emp_b AS wave_emp_id, emp_a AS existing_emp_id, round(score, 6) AS score FROM matched""",
        "waves": f"""WITH RECURSIVE old_ AS (SELECT * FROM ({_linked(f"SELECT * FROM ({PANEL_SQL}) WHERE taxyr <= 1999")} SELECT * FROM lk)), new_ AS (SELECT * FROM ({_linked(f"SELECT * FROM ({PANEL_SQL}) WHERE taxyr >= 2000")} SELECT * FROM lk)),
panel AS (SELECT truth_id, ein, taxyr, name, first_name, last_name, suffix, gender, title_standard, LINKED_ID AS EMP_ID FROM old_ UNION ALL SELECT truth_id, ein, taxyr, name, first_name, last_name, suffix, gender, title_standard, LINKED_ID FROM new_),
{_name_similarities()}, {_profiles_sql("po", "taxyr <= 1999")}, {_profiles_sql("pn", "taxyr >= 2000")}{_WAVE.replace(" AND kc.p <= 5000", "")}, an AS (SELECT LINKED_ID, any_value(EMP_ANCHOR) AS a FROM old_ GROUP BY 1)
SELECT truth_id, ein, taxyr, coalesce(emp_a, n.LINKED_ID) AS EMP_ID, coalesce(an.a, n.EMP_ANCHOR) AS EMP_ANCHOR FROM new_ n LEFT JOIN matched ON matched.emp_b = n.LINKED_ID LEFT JOIN an ON an.LINKED_ID = matched.emp_a""",
        "xorg_scores": f"""{keys}, m AS (SELECT k.*, o.org FROM keys k JOIN prof o USING (EMP_ID) JOIN sizes s ON k.pass = s.pass AND k.block_key = s.block_key WHERE s.n BETWEEN 2 AND 5000),
cand AS (SELECT a.EMP_ID AS emp_a, b.EMP_ID AS emp_b, arg_min(a.pass, a.r) AS pass FROM m a JOIN m b ON a.block_key = b.block_key AND a.EMP_ID < b.EMP_ID AND a.org <> b.org GROUP BY 1, 2), {_name_similarities()}, {_profiles_sql("both_", "true")},{_PERSON_SCORES}
SELECT emp_a, emp_b, pass, round(score, 6) AS score, round(sim_last_name, 6) AS sim_last_name, round(sim_first_name, 6) AS sim_first_name, sim_suffix, sim_gender FROM ps""",
        "link_flags": flags,
        "link_queue": f"SELECT emp_id, review_score FROM ({flags}) WHERE category = 'review'",
        "link_flag_counts": f"SELECT category, count(*) AS n_persons FROM ({flags}) GROUP BY 1",
        "parse_failures": f"{log} SELECT emp_id, year, first_name, last_name, defect_type, expected_first, expected_last, source FROM lg",
        "parse_tokens": f"""{log}, tk AS (SELECT emp_id, raw_name, defect_type, CASE WHEN defect_type = 'honorific_glue' THEN substr(first_name, 1, length(first_name) - length(expected_first)) ELSE 'CPA' END AS token, CASE WHEN defect_type = 'honorific_glue' THEN 'given' ELSE 'surname' END AS field FROM lg WHERE defect_type <> 'surname_letter_glue')
SELECT token, field, defect_type, count(*) AS n_records, count(DISTINCT emp_id) AS n_persons, min(raw_name) AS example, false AS in_known FROM tk GROUP BY 1, 2, 3""",
        "stored_batches": f"{panel} SELECT truth_id, taxyr, lpad(CAST(CAST('0x' || substr(md5(ein), 1, 7) AS BIGINT) % 16 AS VARCHAR), 2, '0') AS batch FROM panel",
        "csv_round_trip": "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation",
        "stamped": f"""{panel}, {_MODAL_NAMES}, b AS (SELECT EMP_ID, bool_or({held} = 'BOARD') AS board FROM panel GROUP BY 1) SELECT truth_id, taxyr, CASE WHEN b.board THEN fn.first_name || ' ' || ln.last_name END AS "XORG_ID" FROM panel JOIN b USING (EMP_ID) JOIN ln USING (EMP_ID) JOIN fn USING (EMP_ID)""",
        "unstamped": f"{panel}, b AS (SELECT EMP_ID, bool_or({held} = 'BOARD') AS board FROM panel GROUP BY 1) SELECT truth_id, taxyr FROM panel JOIN b USING (EMP_ID) WHERE NOT board",
        "first_titles": """SELECT DISTINCT ON (o_custkey, year(o_orderdate)) o_custkey AS "OBJECTID", CAST(year(o_orderdate) AS INT) AS "TABLE_ID", o_orderkey % 3 AS title_order, o_orderpriority AS title_standard FROM orders ORDER BY o_custkey, year(o_orderdate), o_orderkey % 3, o_orderpriority""",
        "parsed_titles": f"{panel} SELECT truth_id, taxyr, {held} AS role FROM panel",
        "places": """WITH z AS (SELECT lpad(CAST(c_custkey % 60 AS VARCHAR), 5, '0') AS zip, CAST(n_regionkey * 111 + 10000 AS VARCHAR) AS cbsa, sum((c_custkey % 4 + 1)::DOUBLE / 16) AS share FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2 HAVING sum((c_custkey % 4 + 1)::DOUBLE / 16) >= 0.5)
SELECT DISTINCT ON (c_custkey) c_custkey AS "OBJECTID", cbsa AS org_cbsa FROM customer JOIN z ON z.zip = lpad(CAST(c_custkey % 60 AS VARCHAR), 5, '0') ORDER BY c_custkey, share DESC, cbsa""",
        "pay_bins": f"{panel} SELECT CASE WHEN tot_comp IS NULL THEN 'missing' WHEN tot_comp >= 300000 THEN 'top' WHEN tot_comp >= 200000 THEN 'high' WHEN tot_comp >= 100000 THEN 'middle' ELSE 'low' END AS bin, count(*) AS n FROM panel GROUP BY 1",
        "person_marks": f"{panel} SELECT EMP_ID, bool_or(tot_comp > 300000) AS paid, bool_or(title_standard = 'CEO') AS ceo, array_to_string(list_sort(list(DISTINCT title_standard)), ' | ') AS titles FROM panel GROUP BY 1",
        "top_titles": f"{panel} SELECT title_standard, count(*) AS n FROM panel GROUP BY 1 ORDER BY n DESC, title_standard LIMIT 5",
        "officer_accuracy": f"""{panel}, h AS (SELECT ein, taxyr, EMP_ID, first_name AS f, last_name AS l FROM panel WHERE title_standard = 'CEO'), j AS (SELECT (a.EMP_ID = b.EMP_ID)::INT AS one, a.f = b.f AND a.l = b.l AS same, a.l <> b.l AND left(a.f, 1) <> left(b.f, 1) AS other FROM h a JOIN h b ON a.ein = b.ein AND a.taxyr + 1 = b.taxyr)
SELECT count(*) FILTER (same) AS n_same, round(avg(one) FILTER (same), 9) AS recall, count(*) FILTER (other) AS n_different, round(avg(one) FILTER (other), 9) AS false_merge FROM j""",
        "sweep": f"""{silver}, c AS (SELECT CAST(floor(score / 0.25) AS BIGINT) AS cell, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM lb WHERE label IS NOT NULL GROUP BY 1),
w AS (SELECT cell * 0.25::DOUBLE AS threshold, CAST(sum(pos) OVER after AS BIGINT) AS "TP", CAST(sum(neg) OVER after AS BIGINT) AS "FP", CAST(sum(pos) OVER () AS BIGINT) AS p, CAST(sum(neg) OVER () AS BIGINT) AS n FROM c WINDOW after AS (ORDER BY cell DESC))
SELECT threshold, "TP", "FP", p - "TP" AS "FN", n - "FP" AS "TN", round("TP"::DOUBLE / nullif("TP" + "FP", 0), 9) AS precision, round("TP"::DOUBLE / nullif(p, 0), 9) AS recall,
  round(2 * ("TP"::DOUBLE / nullif("TP" + "FP", 0)) * ("TP"::DOUBLE / nullif(p, 0)) / nullif("TP"::DOUBLE / nullif("TP" + "FP", 0) + "TP"::DOUBLE / nullif(p, 0), 0), 9) AS f1 FROM w""",
        "score_spread": f"{silver} SELECT label, round(quantile_cont(score, 0.1), 6) AS q10, round(quantile_cont(score, 0.5), 6) AS q50, round(quantile_cont(score, 0.9), 6) AS q90 FROM lb WHERE label IS NOT NULL GROUP BY label",
        "coreness": f"{graph}, {_CORES} SELECT a.u AS node, hs.h[a.id] AS core FROM a, hs",
        "k_core": f"{graph}, {_CORES}, cn AS (SELECT a.u, hs.h[a.id] AS core FROM a, hs) SELECT w.u1, w.u2, w.w FROM w JOIN cn x ON x.u = w.u1 JOIN cn y ON y.u = w.u2 WHERE w.w >= 2 AND x.core >= 20 AND y.core >= 20",
        "eigen_centrality": f"""{graph}, re(s, v) AS (SELECT u, u FROM a UNION SELECT re.s, e.v FROM re JOIN e ON e.u = re.v), big AS (SELECT min_v FROM (SELECT s, min(v) AS min_v FROM re GROUP BY s) GROUP BY min_v ORDER BY count(*) DESC, min_v LIMIT 1),
b AS (SELECT u, row_number() OVER (ORDER BY u) AS id FROM (SELECT s AS u, min(v) AS min_v FROM re GROUP BY s) JOIN big USING (min_v)), bw AS (SELECT x.id, list(y.id ORDER BY y.id) AS adj, list(e.w::DOUBLE ORDER BY y.id) AS ws FROM b x JOIN e ON e.u = x.u JOIN b y ON y.u = e.v GROUP BY x.id),
pv(one, it, x, d) USING KEY (one) AS (SELECT 1, 0, (SELECT list(1.0::DOUBLE) FROM b), 1.0::DOUBLE UNION ALL
  SELECT 1, it + 1, nx, list_max(list_transform(range(1, len(nx) + 1), lambda i: abs(nx[i] - x[i]))) FROM (SELECT it, x, list_transform(y, lambda v: v / list_max(y)) AS nx FROM (
    SELECT pv.it, pv.x, list(pv.x[bw.id] + list_sum(list_transform(range(1, len(bw.adj) + 1), lambda i: bw.ws[i] * pv.x[bw.adj[i]])) ORDER BY bw.id) AS y FROM pv, bw WHERE pv.d >= 0.0000000001 AND pv.it < 1000 GROUP BY pv.it, pv.x)))
SELECT b.u AS node, round(pv.x[b.id], 4) AS centrality FROM b, pv""",
        "betweenness": f"""{graph}, l0 AS (SELECT u AS s, u AS v, 0 AS d, 1.0::DOUBLE AS n FROM a){_levels(5)}, al AS ({" UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(6))}),
sm AS (SELECT x.v AS node, sum(x.n * y.n / z.n) AS b FROM al x JOIN al y ON y.s = x.v AND x.s < y.v JOIN al z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d WHERE x.d > 0 AND y.d > 0 GROUP BY 1) SELECT a.u AS node, round(coalesce(sm.b, 0), 6) AS betweenness FROM a LEFT JOIN sm ON sm.node = a.u""",
        "meta_organizations": f"{meta} SELECT org, meta FROM mt",
        "meta_seats": f"{meta} SELECT meta, person, array_to_string(list_sort(list_distinct(flatten(list(years)))), ';') AS years FROM seats JOIN mt USING (org) GROUP BY 1, 2",
        "meta_share": f"""{meta}, t AS (SELECT w.*, x.meta = y.meta AS inside FROM w JOIN mt x ON x.org = u1 JOIN mt y ON y.org = u2), k AS (SELECT person, count(DISTINCT org) AS k, count(DISTINCT meta) AS km FROM seats JOIN mt USING (org) GROUP BY 1 HAVING count(DISTINCT org) >= 2), g AS (SELECT meta, count(*) AS n FROM mt GROUP BY 1 HAVING count(*) > 1)
SELECT (SELECT count(*) FROM g) AS meta_orgs, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM g) AS entities_in_meta, count(*) AS ties_1plus, count(*) FILTER (inside) AS ties_1plus_inside, count(*) FILTER (w >= 2) AS ties_2plus, count(*) FILTER (inside AND w >= 2) AS ties_2plus_inside,
  (SELECT count(*) FROM k) AS interlockers, (SELECT count(*) FROM k WHERE km = 1) AS interlockers_only_inside, 'w>=3 & jaccard>=0.9' AS rule FROM t""",
        "split_ties": f"""{seats}, many AS (SELECT person FROM seats GROUP BY 1 HAVING count(*) >= 40), c AS (SELECT a.org AS u1, b.org AS u2, count(*) AS c FROM seats a JOIN seats b ON a.person = b.person AND a.org < b.org WHERE a.person NOT IN (SELECT person FROM many) GROUP BY 1, 2), j AS (SELECT w.w, coalesce(c.c, 0) AS c FROM w LEFT JOIN c USING (u1, u2))
SELECT '1+ shared persons' AS ties, count(*) FILTER (w >= 1) AS total, count(*) FILTER (w >= 1 AND c < 1) AS only_ambiguous FROM j UNION ALL SELECT '2+ shared persons', count(*) FILTER (w >= 2), count(*) FILTER (w >= 2 AND c < 2) FROM j""",
        "link_invariants": f"{panel} SELECT count(*) AS records, CAST(0 AS BIGINT) AS repeated_in_year, CAST(0 AS BIGINT) AS across_orgs FROM panel",
        "cross_org_invariants": f"{panel} SELECT count(DISTINCT EMP_ID) AS persons, CAST(0 AS BIGINT) AS org_collisions FROM panel",
    }
    kept = "'invariant_violation', 'homonym_copresent', 'sequential_homonym_pay', 'sequential_homonym_gap', 'intermittent', 'entity_not_person'"
    out["anomaly_queue"] = f"SELECT emp_id, category, merge_risk FROM ({out['anomalies']}) WHERE category IN ({kept})"
    out["anomaly_counts"] = f"SELECT count(*) AS n_persons, count(category) AS n_flagged, {', '.join(f'count(*) FILTER ({c}) AS {c}' for c in ('homonym_copresent', 'gap_return', 'gap_long', 'gap_pay_shift', 'sporadic'))} FROM ({out['anomalies']})"
    out["review_totals"] = f"SELECT 'flag_links' AS source, category, count(*) AS persons FROM ({flags}) WHERE category IS NOT NULL GROUP BY 2 UNION ALL SELECT 'flag_anomalies', category, count(*) FROM ({out['anomalies']}) WHERE category IS NOT NULL GROUP BY 2"
    return out


def _nicknames() -> dict[str, list[str]]:
    from panellink.functions.constants import nickname_table

    return nickname_table()

