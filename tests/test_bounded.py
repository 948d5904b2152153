"""Steps that must not grow faster than their input, nor send pairs through Python or shuffles."""

import pytest
from pyspark.sql import functions as F

from panellink.functions import similarity as kernels
from panellink.operators import blocking, evaluate
from panellink.operators.blocking import candidate_pairs, person_blocking_keys
from panellink.operators.profile import build_person_profile
from panellink.plans import xorg
from panellink.sources.fixtures import synthetic_panel

PLACES = {"state": "org_state", "cbsa": "org_cbsa", "ntee": "org_ntee"}


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def persons(spark):
    return build_person_profile(synthetic_panel(spark, "/root/testdata/sf0.001"), **PLACES).cache()


def test_pairs_across_organizations_are_neither_shuffled_nor_sent_to_python(spark, persons):
    scored = xorg.scored_candidates(person_blocking_keys(persons), persons)
    last = plan(scored).split("== Physical Plan ==")[1]
    assert "hashpartitioning(emp_a" not in last and "ArrowEvalPython" not in last


def test_pairs_across_organizations_match_brute_force_in_parts_and_without_tables(spark, persons, monkeypatch):
    keys = person_blocking_keys(persons).distinct()
    org = persons.select("EMP_ID", F.get("orgs", F.lit(0)).alias("org"))
    small = keys.groupBy("block_key").agg(F.count(F.lit(1)).alias("n")).where("n <= 20").select("block_key")
    k = keys.join(small, "block_key").join(org, "EMP_ID").alias("a")
    want = k.join(k.alias("b"), F.expr("a.block_key = b.block_key AND a.EMP_ID < b.EMP_ID AND a.org <> b.org")).groupBy("a.EMP_ID", "b.EMP_ID").agg(F.count(F.lit(1)).alias("n")).collect()
    monkeypatch.setattr(blocking, "BLOCK_ROWS", 3)
    pairs = candidate_pairs(keys, persons, max_block_size=20)[0].cache()
    got = [(r[0], r[1], r["n_shared_buckets"]) for r in pairs.collect()]
    assert len(got) > 50 and sorted(got) == sorted(map(tuple, want))
    looked_up = xorg.score_candidate_pairs(pairs.select("emp_a", "emp_b"), persons).collect()
    monkeypatch.setattr(kernels, "TABLE_VALUES", 1)
    assert sorted(xorg.score_candidate_pairs(pairs.select("emp_a", "emp_b"), persons).collect()) == sorted(looked_up)


def test_shared_board_members_are_counted_once_for_two_boards(spark, persons):
    ids = [r[0] for r in persons.select("EMP_ID").orderBy("EMP_ID").limit(3).collect()]
    orgs = {r[0]: r[1] for r in persons.select("EMP_ID", F.get("orgs", F.lit(0))).where(F.col("EMP_ID").isin(ids)).collect()}
    a, b = ids[0], next(i for i in ids if orgs[i] != orgs[ids[0]])
    seats = [(orgs[a], a), (orgs[b], a), (orgs[a], "p"), (orgs[b], "p"), (orgs[a], "q"), (orgs[b], b)]
    found = evaluate.pair_evidence(spark.createDataFrame([(a, b)], "emp_a string, emp_b string"), persons, spark.createDataFrame(seats, "org string, person string"))
    assert found.first()["shared_board_members"] == 1  # p; a takes itself off
    assert "pa#" not in plan(found)  # members aren't joined to pairs


def test_variants_and_seeds_are_scored_by_form(spark, persons):
    pairs = candidate_pairs(person_blocking_keys(persons, ["surname"]), persons)[0]
    scored = xorg.score_candidate_pairs(pairs, persons).cache()
    single = evaluate.single_forms(persons)
    again = xorg.score_candidate_pairs(scored.select("emp_a", "emp_b", F.col("score").alias("pooled")), single)
    kept = again.where("pooled >= 7 AND score >= 7").join(single.selectExpr("EMP_ID AS emp_a", "last_name_keys AS ka"), "emp_a").join(single.selectExpr("EMP_ID AS emp_b", "last_name_keys AS kb"), "emp_b").where("arrays_overlap(ka, kb)").count()
    got = {r["outcome"]: r["pairs"] for r in evaluate.variant_test(scored, persons).collect()}
    assert kept > 0 and got["kept"] == kept
    seeds = scored.where("score >= 9").select("emp_a", "emp_b")
    control = {r["test"]: r for r in evaluate.seeded_test(seeds, persons).collect()}["control"]
    assert control["n"] == seeds.count() and control["recall"] == 1.0


def test_classes_are_matched_as_by_scanning_all_pairs():
    import numpy as np

    from panellink.operators.closure import greedy_rows
    from panellink.operators.matching import match_classes

    rng = np.random.default_rng(3)
    for _ in range(60):
        cx, cy = rng.integers(0, 7, 40), rng.integers(0, 6, 30)
        s = rng.integers(0, 4, (7, 6)).astype(float)  # many ties
        a, b = np.nonzero(s)
        xs, ys = [np.flatnonzero(cx == k).tolist() for k in range(7)], [np.flatnonzero(cy == k).tolist() for k in range(6)]
        pairs = sorted((-s[cx[x], cy[y]], x, y) for x in range(40) for y in range(30) if s[cx[x], cy[y]])
        want = [pairs[k] for k in greedy_rows([(x, y) for _, x, y in pairs])]
        assert sorted((-v, x, y) for x, y, v in match_classes(s[a, b], a, b, xs, ys)) == sorted(want)


def test_linkage_makes_no_pairs_of_records(spark, monkeypatch):
    """The same edges as from all scored pairs, in chunks and with a task for each pair of years, and no stored table of candidates."""
    from panellink.operators import matching
    from panellink.operators.candidates import default_weights, scored
    from panellink.operators.closure import resolve_within
    from panellink.operators.prepare import prepare_panel
    from panellink.plans import link

    raw = synthetic_panel(spark, "/root/testdata/sf0.001").drop("EMP_ID")
    raw = raw.withColumn("ein", F.concat(F.lit("E"), (F.col("truth_id") % 3).cast("string"))).cache()  # three large organizations
    _, work, _ = prepare_panel(raw)
    every = scored(work, default_weights()).where("score >= 7").select("org", "yr_x", "yr_y", "row_x", "row_y", "score")
    want = sorted((r["row_x"], r["row_y"], round(r["score"], 9)) for r in resolve_within(every).where("uid IS NULL").collect())
    monkeypatch.setattr(matching, "CHUNK", 50)
    monkeypatch.setattr(matching, "TASK_RECORDS", 100)
    offered = []
    monkeypatch.setattr(link, "resolve_within", lambda candidates: offered.append(candidates.count()) or resolve_within(candidates))
    got = sorted((r["row_x"], r["row_y"], round(r["score"], 9)) for r in link.link_panel(raw).edges.collect())
    assert got == want and len(got) > 100
    assert offered == [len(got)] and every.count() > len(got)


def test_counts_of_pairs_are_those_of_all_pairs(spark):
    from panellink.operators.candidates import compared
    from panellink.operators.matching import counted_pairs, signatures
    from panellink.operators.prepare import prepare_panel
    from panellink.plans.model import agreement

    _, work, feats = prepare_panel(synthetic_panel(spark, "/root/testdata/sf0.001").drop("EMP_ID").withColumn("ein", F.lit("E")))
    agree = lambda d, fs: d.withColumns({f: (F.col(f) >= 0.5).cast("double") for f in fs})
    want = agree(compared(work, feats), feats).groupBy(*feats).agg(F.count(F.lit(1)).alias("n")).collect()
    stable = [f for f in feats if f != "title_standard"]
    records, pairs = signatures(work, feats)
    got = counted_pairs(records, agree(pairs, stable).select("org", "s_x", "s_y", *stable), stable, "title_standard", agreement(0.5)).where("n > 0").select(*feats, "n").collect()
    assert len(got) > 4 and sorted(map(str, got)) == sorted(map(str, want))


def test_sweeps_count_scores_of_signatures(spark):
    from panellink.operators.candidates import candidate_scores

    raw = synthetic_panel(spark, "/root/testdata/sf0.001").drop("EMP_ID").withColumn("ein", F.concat(F.lit("E"), (F.col("truth_id") % 2).cast("string"))).cache()
    every, counted = evaluate.silver_labels(candidate_scores(raw)).cache(), evaluate.silver_score_counts(raw).cache()
    assert counted.agg(F.sum("n")).first()[0] == every.count()
    flat = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.na.fill(-1.0).collect())
    assert flat(evaluate.threshold_sweep(counted, weight="n")) == flat(evaluate.threshold_sweep(every))
    assert flat(evaluate.score_quantiles(counted, weight="n")) == flat(evaluate.score_quantiles(every))


def test_no_bucket_of_a_wave_is_dropped(spark, monkeypatch):
    """80 existing and 80 new persons of one organization and surname make 6,400 pairs."""
    from panellink.operators.blocking import same_org_candidate_pairs
    from panellink.plans.incremental import match_to_profiles

    def persons_of(mark, year):
        d = spark.range(80).select(F.concat(F.lit(mark), F.lpad(F.col("id").cast("string"), 2, "0")).alias("EMP_ID"), F.lit("1").alias("ein"), F.lit(year).alias("taxyr"), F.lit("ANN SMITH-LEE").alias("name"), F.lit("ANN").alias("first_name"), F.lit("SMITH-LEE").alias("last_name"), F.lit("F").alias("gender"), F.lit("CEO").alias("title_standard"))
        return build_person_profile(d).cache()

    old, new = persons_of("A", 2000), persons_of("B", 2001)
    monkeypatch.setattr(blocking, "BLOCK_ROWS", 30)
    pairs, dropped = same_org_candidate_pairs(old, new)
    assert pairs.count() == pairs.distinct().count() == 6400 and dropped.count() == 0
    assert same_org_candidate_pairs(old, new, 5000)[0].count() == 0  # where a caller asks for it
    weight = spark.createDataFrame([("SMITH-LEE", 1.0)], "last_name string, weight double")
    found = {(r["existing_emp_id"], r["wave_emp_id"]) for r in match_to_profiles(new, old, surname_weight=weight).matched.collect()}
    assert found == {(f"A{k:02d}", f"B{k:02d}") for k in range(80)}
