"""Linkage within organizations, match models, waves and cross-organization links."""

import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from panellink.operators import closure
from panellink.operators.blocking import block_census, blocking_passes, candidate_pairs, person_blocking_keys
from panellink.operators.candidates import candidate_comparisons, candidate_scores
from panellink.operators.prepare import surname_weight
from panellink.operators.profile import build_person_profile
from panellink.plans import incremental, model, xorg
from panellink.plans.link import link_panel, remint_anchored

SCHEMA = "ein string, taxyr int, name string, salutation string, first_name string, middle_name string, last_name string, suffix string, gender string, title_standard string, OBJECTID string, TABLE_ID string"


def record(ein, yr, first, last, suffix="", gender="M", title="CEO", k=None):
    name = " ".join(x for x in (first, last, suffix) if x)
    return (ein, yr, name, None, first, None, last, suffix, gender, title, f"O-{ein}-{yr}", k or f"T-{first}-{suffix}")


FAMILY = [
    *[record("100", y, "JOHN", "SMITH", "SR") for y in (2019, 2020, 2021)], *[record("100", y, "JOHN", "SMITH", "JR", title="TREASURER") for y in (2019, 2020, 2021)],
    *[record("100", y, "ANN", "JONES", "", "F", "SECRETARY") for y in (2019, 2020)], *[record("200", y, "JOHN", "SMITH", "SR", title="PRESIDENT") for y in (2019, 2020)],
]


def panel(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def linked(spark):
    return link_panel(panel(spark, FAMILY))


def ids(df):
    return {(r["ein"], r["taxyr"], r["name"]): r["EMP_ID"] for r in df.collect()}


def test_family_board(linked):
    got = ids(linked.panel)
    sr, jr, ann, other = (got["100", 2019, n] for n in ("JOHN SMITH SR", "JOHN SMITH JR", "ANN JONES", "JOHN SMITH SR"))
    assert len(got) == 10 and sr != jr and len(set(got.values())) == 4
    assert all(got["100", y, "JOHN SMITH SR"] == sr and got["100", y, "JOHN SMITH JR"] == jr for y in (2020, 2021)) and got["100", 2020, "ANN JONES"] == ann
    assert got["200", 2020, "JOHN SMITH SR"] == got["200", 2019, "JOHN SMITH SR"] != other
    r = linked.report.first()
    assert (r["n_records"], r["n_orgs"], r["n_clusters"], r["n_singletons"], r["n_multi_year"], r["n_links"]) == (10, 2, 4, 0, 4, 8)
    assert "panel compression" in str(linked)


def test_linkage_doesnt_depend_on_order_or_partitions(spark, linked):
    rows = FAMILY[:]
    random.Random(3).shuffle(rows)
    again = link_panel(panel(spark, rows).repartition(7))
    assert ids(again.panel) == ids(linked.panel)


def test_edge_cases(spark):
    assert link_panel(panel(spark, [])).panel.count() == 0
    rows = [record("1", 2019, "A", "B"), record("1", None, "A", "B"), record(None, 2020, "A", "B"), record("1", 2019, "A", "B")]
    r = link_panel(panel(spark, rows))
    assert r.panel.count() == 4 and r.panel.select("EMP_ID").distinct().count() >= 2
    with pytest.raises(ValueError):
        link_panel(panel(spark, rows).drop("name"))
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        link_panel(panel(spark, FAMILY).drop("salutation"))
    assert any("salutation" in str(x.message) for x in w)
    dotted = panel(spark, FAMILY).withColumnRenamed("title_standard", "title.standard")
    assert link_panel(dotted).panel.columns[:10][-1] == "title.standard"


def test_surname_weight_golden(spark):
    d = spark.createDataFrame([("1", "A SMITH", "SMITH"), ("1", "B SMITH", "SMITH"), ("1", "C JONES", "JONES")], "ein string, name string, last_name string")
    got = sorted(round(r["surname_w"], 7) for r in surname_weight(d).collect())
    assert got == [0.3690702, 0.3690702, 1.0]


def test_scores_golden(spark):
    """The seven-record panel of the methodology article: nine pairs."""
    rows = [record("1", y, "JOHN", "SMITH", title=None) for y in (2019, 2020, 2021)] + [record("1", y, "MARY", "GARCIA", gender="F", title=None) for y in (2019, 2020)]
    s = candidate_scores(panel(spark, rows))
    same = s.where("first_name_x = first_name_y").agg(F.min("score"), F.count("*")).first()
    assert same[1] == 4 and same[0] == 13.0 and s.where("first_name_x <> first_name_y AND score > 0").count() == 0


def test_greedy_equals_mutual_best(spark):
    rng = random.Random(2)
    for n in (0, 1, 60):
        edges = [(f"x{rng.randrange(12)}", f"y{rng.randrange(12)}", float(rng.randrange(5))) for _ in range(n)]
        edges = list({(a, b): (a, b, s) for a, b, s in edges}.values())
        order = sorted(edges, key=lambda e: (-e[2], e[0], e[1]))
        want = {order[k] for k in closure.greedy_rows((a, b) for a, b, _ in order)}
        got = {tuple(r) for r in closure.greedy_one_to_one(spark.createDataFrame(edges, "row_x string, row_y string, score double")).collect()}
        assert got == want


def test_constrained_union_by_component_equals_the_global_one(spark):
    rng = random.Random(5)
    nodes = {f"n{k:02d}": rng.randrange(4) for k in range(40)}
    edges = sorted({(a, b, rng.randrange(10)) for a, b in (sorted(rng.sample(sorted(nodes), 2)) for _ in range(35))}, key=lambda e: (-e[2], e))
    whole, refused = closure.constrained_union(((a, b) for a, b, _ in edges), nodes)
    parts = {r["node"]: r["component"] for r in closure.connected_components(spark.createDataFrame([(a, b) for a, b, _ in edges], "a string, b string")).collect()}
    split, total = {}, 0
    for p in set(parts.values()):
        own = {n: m for n, m in nodes.items() if parts.get(n) == p}
        c, r = closure.constrained_union(((a, b) for a, b, _ in edges if parts[a] == p), own)
        split |= c
        total += r
    assert total == refused and {n: split.get(n, n) for n in nodes} == whole
    for n, root in whole.items():
        members = [m for m in nodes if whole[m] == root]
        assert root == min(members) and len({nodes[m] for m in members}) == len(members)


def test_large_organizations_are_resolved_alike(spark, monkeypatch):
    """Rounds of best edges and components give what one task for the whole organization gives."""
    rng = random.Random(8)
    rows = []
    for org in ("a", "b"):
        for yr_x in range(4):
            for yr_y in range(yr_x + 1, 4):
                rows += [(org, yr_x, yr_y, f"{org}{yr_x}-{i}", f"{org}{yr_y}-{j}", float(rng.randrange(6))) for i in range(6) for j in range(6) if rng.random() < 0.4]
    edges = spark.createDataFrame(rows, closure.EDGE)
    plain = lambda df: sorted((r["row_x"], r["row_y"], r["score"]) for r in df.where("uid IS NULL").collect())
    clusters = lambda df: sorted((r["uid"], r["cluster"]) for r in df.where("uid IS NOT NULL").collect())
    whole = closure.resolve_within(edges).cache()
    monkeypatch.setattr(closure, "TASK_EDGES", 1)
    split = closure.resolve_within(edges).cache()
    assert plain(whole) == plain(split) and clusters(whole) == clusters(split) and len(plain(whole)) > 20
    assert whole.agg(F.sum("rejected")).first()[0] == split.agg(F.sum("rejected")).first()[0] > 0


def test_unfinished_rounds_are_errors(spark):
    from panellink.operators import network

    path = spark.createDataFrame([(f"n{k:02d}", f"n{k + 1:02d}", 1) for k in range(12)], "u1 string, u2 string, w int")
    chain = spark.createDataFrame([(f"x{k}", f"y{k}", 10.0 - 2 * k) for k in range(5)] + [(f"x{k + 1}", f"y{k}", 9.0 - 2 * k) for k in range(4)], "row_x string, row_y string, score double")
    for call in (lambda: network.coreness(path, max_rounds=1), lambda: network.eigen_centrality(path, rounds=2), lambda: closure.greedy_one_to_one(chain, max_rounds=1)):
        with pytest.raises(RuntimeError):
            call()


# --- models -------------------------------------------------------------------------------------------------------


def similarities(spark, labelled=False):
    rng = np.random.default_rng(42)
    rows = [tuple(map(float, np.clip(rng.normal(0.95, 0.1, 3), 0, 1))) + (1,) for _ in range(80)] + [tuple(map(float, np.clip(rng.normal(0.2, 0.2, 3), 0, 1))) + (0,) for _ in range(300)]
    rows = [(a, b, None if k % 7 == 0 else c, y) for k, (a, b, c, y) in enumerate(rows)]
    d = spark.createDataFrame(rows, "last_name double, first_name double, gender double, y int")
    return d if labelled else d.drop("y")


def test_em_recovers_matches(spark):
    m = model.fit_match_model(similarities(spark))
    assert all(m.m[f] > m.u[f] for f in m.feats) and m.p == pytest.approx(80 / 380, abs=0.05)
    w = model.fs_weights(m)
    assert all(x["w_agree"] > 0 > x["w_disagree"] for x in w)
    d = similarities(spark, True).withColumn("p", model.predict_match(m))
    assert d.where("y = 1 AND p < 0.5 OR y = 0 AND p > 0.5").count() < 15
    empty = spark.createDataFrame([(None, None, None)], "last_name double, first_name double, gender double").select(model.predict_match(m)).first()[0]
    assert empty == pytest.approx(m.p)


def test_em_on_patterns_is_em_on_pairs():
    rng = np.random.default_rng(1)
    g = (rng.random((400, 3)) < 0.4).astype(float)
    g[rng.random(g.shape) < 0.1] = np.nan
    patterns, counts = np.unique(g, axis=0, return_counts=True)
    a, b = model.em_fellegi_sunter(patterns, counts.astype(float)), model.em_fellegi_sunter(g, np.ones(len(g)))
    assert np.allclose(a[0], b[0], atol=1e-5) and np.allclose(a[1], b[1], atol=1e-5) and a[2] == pytest.approx(b[2], abs=1e-5)


def test_em_on_signatures_is_em_on_records(spark):
    """Counted pairs of signatures stand for all pairs of records, whatever repeats."""
    from panellink.operators.candidates import compared, compared_signatures, record_pairs
    from panellink.operators.prepare import prepare_panel

    rows = FAMILY + [record("100", y, "JON", "SMYTH", "SR", title="TRUSTEE", k=f"k{n}") for n, y in enumerate((2019, 2020, 2021, 2021))] + [record("200", 2021, "ANN", "JONES", "", "F")]
    _, work, feats = prepare_panel(panel(spark, rows))
    records = compared(work, feats)
    signed, pairs = compared_signatures(work, feats)
    assert pairs.agg(F.sum("n")).first()[0] == records.count()
    a, b = model.fit_match_model(records, feats=feats), model.fit_match_model(pairs, feats=feats, weight="n")
    assert a.m == pytest.approx(b.m) and a.u == pytest.approx(b.u) and a.p == pytest.approx(b.p) and a.iters == b.iters
    want = {(r["row_x"], r["row_y"]): r["s"] for r in records.withColumn("s", model.predict_match(a)).collect()}
    got = {(r["row_x"], r["row_y"]): r["score"] for r in record_pairs(signed, pairs.withColumn("score", model.predict_match(b))).collect()}
    assert got == pytest.approx(want)


def test_logistic(spark):
    d = similarities(spark, True)
    noisy = d.withColumn("y", F.when(F.rand(1) < 0.1, 1 - F.col("y")).otherwise(F.col("y")))
    m = model.fit_match_model(noisy, "logistic", labels="y")
    assert m.coefficients["last_name"] > 0 and "gender_na" in m.coefficients
    assert d.withColumn("p", model.predict_match(m)).where("y = 1 AND p < 0.5 OR y = 0 AND p > 0.5").count() < 20
    with pytest.raises(ValueError):
        model.fit_match_model(d.drop("y"), "logistic", labels="y")
    with pytest.raises(ValueError):
        model.fs_weights(m)


def test_em_linkage_has_confidence(spark):
    r = link_panel(panel(spark, FAMILY), method="em")
    c = candidate_comparisons(panel(spark, FAMILY))
    assert "EMP_LINK_CONF" in r.panel.columns and r.model.method == "em" and c.count() == 14 + 3 * 0 + (c.count() - 14)
    assert r.panel.groupBy("EMP_ID", "ein", "taxyr").count().where("count > 1").count() == 0


# --- anchors and waves ------------------------------------------------------------------------------------------------


def test_ids_survive_a_later_wave_and_move_on_backfill(spark, linked):
    old = ids(linked.panel)
    later = ids(link_panel(panel(spark, [*FAMILY, record("100", 2022, "JOHN", "SMITH", "SR")])).panel)
    assert all(later[k] == v for k, v in old.items()) and later["100", 2022, "JOHN SMITH SR"] == old["100", 2021, "JOHN SMITH SR"]
    earlier = ids(link_panel(panel(spark, [*FAMILY, record("100", 2018, "JOHN", "SMITH", "SR")])).panel)
    assert earlier["100", 2019, "JOHN SMITH SR"] != old["100", 2019, "JOHN SMITH SR"]


def test_remint(spark, linked):
    p = linked.panel
    renamed = p.withColumn("EMP_ID", F.concat(F.lit("old-"), "EMP_ID")).drop("EMP_ANCHOR")
    got, walk = remint_anchored(renamed)
    assert ids(got) == ids(p) and walk.where("concat('old-', new_emp_id) = old_emp_id").count() == 4


def test_wave_inherits_ids(spark, linked):
    wave = [record("100", 2022, "JOHN", "SMITH", "SR"), record("100", 2022, "ZOE", "QUARTZ", gender="F"), record("300", 2022, "JOHN", "SMITH", "SR")]
    r = incremental.link_incremental(linked.panel, panel(spark, wave))
    got, old = ids(r.new_stamped), ids(linked.panel)
    assert got["100", 2022, "JOHN SMITH SR"] == old["100", 2021, "JOHN SMITH SR"]
    assert got["100", 2022, "ZOE QUARTZ"] not in old.values() and got["300", 2022, "JOHN SMITH SR"] not in old.values()
    rep = r.report.first()
    assert rep["n_matched"] == 1 and rep["n_rows_first_time"] == 2 and r.unmatched.count() == 2
    anchor = linked.panel.where("name = 'JOHN SMITH SR' AND ein = '100'").select("EMP_ANCHOR").first()[0]
    assert r.new_stamped.where("ein = '100' AND last_name = 'SMITH'").first()["EMP_ANCHOR"] == anchor


def test_wave_collisions_ambiguity_and_reloads(spark, linked):
    clash = incremental.link_incremental(linked.panel, panel(spark, [record("100", 2020, "JOHN", "SMITH", "SR", k="T-new")]))
    assert clash.review.first()["reason"] == "invariant_collision" and clash.report.first()["n_matched"] == 0
    two = incremental.link_incremental(linked.panel, panel(spark, [record("200", 2022, "JOHN", "SMITH", "SR", k="a"), record("200", 2022, "JOHN", "SMITH", "", k="b")]))
    assert two.report.first()["n_matched"] == 1 and two.review.where("reason = 'ambiguous'").count() == 1
    with pytest.warns(UserWarning, match="native key"):
        again = incremental.link_incremental(linked.panel, panel(spark, FAMILY[:1]))
    assert again.new_stamped.count() == 0 and again.report.first()["n_reload_rows_dropped"] == 1
    with pytest.raises(ValueError):
        incremental.link_incremental(linked.panel.drop("EMP_ANCHOR"), panel(spark, FAMILY))
    p = build_person_profile(linked.panel)
    with pytest.raises(ValueError, match="overlap"):
        incremental.match_to_profiles(p, p)


def test_first_wave_of_a_stream_takes_the_threshold(spark, tmp_path):
    from panellink.streaming.waves import read_state, wave_sink

    for threshold, persons in ((7.0, 4), (1e9, 10)):
        state = str(tmp_path / f"s{persons}")
        wave_sink(state, link_threshold=threshold)(panel(spark, FAMILY), 0)
        assert read_state(spark, state).select("EMP_ID").distinct().count() == persons


def test_stream_of_waves(spark, tmp_path):
    from panellink.streaming.waves import link_stream, read_state

    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    panel(spark, [r for r in FAMILY if r[1] < 2021]).coalesce(1).write.parquet(src)
    run = lambda: link_stream(spark.readStream.schema(SCHEMA).parquet(src), state, str(tmp_path / "cp")).awaitTermination()
    run()
    first = ids(read_state(spark, state))
    panel(spark, [r for r in FAMILY if r[1] == 2021]).coalesce(1).write.mode("append").parquet(src)
    run()
    got = ids(read_state(spark, state))
    assert len(got) == 10 and all(got[k] == v for k, v in first.items()) and got["100", 2021, "JOHN SMITH SR"] == got["100", 2019, "JOHN SMITH SR"]


# --- cross organizations -------------------------------------------------------------------------------------------------

PERSONS = "EMP_ID string, ein string, taxyr int, name string, first_name string, last_name string, suffix string, gender string, title_standard string, st string, cb string, nt string"


def person(emp, ein, yr, first, last, st="NY", cb="35620", nt="B25", title="TRUSTEE"):
    return (emp, ein, yr, f"{first} {last}", first, last, None, "M", title, st, cb, nt)


SMITHS = [person("E1", "1", 2019, "JOHN", "SMITH"), person("E2", "2", 2019, "JOHN", "SMITH", "NJ"), person("E3", "3", 2019, "JOHN", "SMITH", "CA", "41860"), person("E4", "4", 2019, "JOHN", "SMITH", "NY", "35620", "X20")]


def profiles(spark, rows):
    return build_person_profile(spark.createDataFrame(rows, PERSONS), state="st", cbsa="cb", ntee="nt")


def test_blocking_ladder(spark):
    assert list(blocking_passes()) == ["strict", "metro", "geo", "industry", "surname"]
    p = profiles(spark, SMITHS)
    keys = {tuple(r) for r in person_blocking_keys(p).collect()}
    assert ("E1", "strict", "strict|S530|NY|B") in keys and ("E2", "metro", "metro|S530|35620|B") in keys and ("E4", "surname", "surname|S530") in keys
    pairs = {(r["emp_a"], r["emp_b"]): (r["pass"], r["n_shared_buckets"]) for r in candidate_pairs(person_blocking_keys(p), p)[0].collect()}
    assert pairs["E1", "E2"][0] == "metro" and pairs["E1", "E3"][0] == "geo" and pairs["E1", "E4"][0] == "industry" and pairs["E3", "E4"] == ("surname", 1)
    none, dropped = candidate_pairs(person_blocking_keys(p, ["surname"]), p, max_block_size=3)
    assert none.count() == 0 and dropped.first()["n"] == 4
    bare = build_person_profile(spark.createDataFrame(SMITHS, PERSONS))
    assert {r["pass"] for r in person_blocking_keys(bare).collect()} == {"surname"}
    with pytest.raises(ValueError):
        person_blocking_keys(p, ["none"])
    census = {r["pass"]: r for r in block_census(person_blocking_keys(p)).collect()}
    assert census["surname"]["comparisons"] == 6 and census["ALL"]["people"] == 4


def test_compound_surnames_and_several_metros(spark):
    rows = [person("A", "1", 2019, "ANN", "COHEN-WEINER"), person("B", "2", 2019, "ANN", "WEINER"), person("C", "3", 2019, "ANN", "REED"), person("C", "3", 2020, "ANN", "REED", cb="10580")]
    p = profiles(spark, rows)
    keys = {(r["EMP_ID"], r["block_key"]) for r in person_blocking_keys(p, ["surname", "metro"]).collect()}
    assert ("A", "surname|W560") in keys and ("B", "surname|W560") in keys
    assert ("C", "metro|R300|35620|B") in keys and ("C", "metro|R300|10580|B") in keys


def test_cross_org_and_refresh(spark):
    rows = [person("G1", "1", 2018, "ANN", "GANTSOUDES"), person("G2", "2", 2019, "ANN", "GANTSOUDES"), person("N", "2", 2019, "BOB", "NGUYEN"), *[person(f"F{k}", f"{k}", 2019, f, last) for k, (f, last) in enumerate([("AL", "REED"), ("CY", "BERG"), ("DEB", "HOEY")], 5)]]
    df = spark.createDataFrame(rows, PERSONS)
    r = xorg.link_cross_org(df)
    a = {x["EMP_ID"]: x for x in r.assignment.collect()}
    assert a["G1"]["XORG_ID"] == a["G2"]["XORG_ID"] and a["G1"]["XORG_N_ORGS"] == 2 and a["G1"]["XORG_N_YEARS"] == 2 and a["N"]["XORG_N_ORGS"] == 1
    assert r.report.first()["n_interlocking_persons"] == 2 and r.report.first()["n_cross_org_clusters"] == 1
    stamped = xorg.stamp_xorg(df, r)
    assert stamped.where("XORG_N_RECORDS = 2").count() == 2 and xorg.unstamped(df, r).count() == 0
    more = spark.createDataFrame([*rows, person("G3", "9", 2021, "ANN", "GANTSOUDES")], PERSONS)
    new, changes = xorg.refresh_cross_org(more, r)
    b = {x["EMP_ID"]: x for x in new.assignment.collect()}
    assert b["G3"]["XORG_ID"] == a["G1"]["XORG_ID"] and b["G1"]["XORG_N_ORGS"] == 3
    assert {tuple(x) for x in changes.persons.collect()} == {("G3", "new"), ("G1", "grew"), ("G2", "grew")} and changes.report.first()["n_new_persons"] == 1
    edges, p = r.edges.where("score >= 7"), r.profiles
    assert xorg.board_only_edges(edges, p).count() == 1 and xorg.non_board_edges(edges, p).count() == 0
    assert xorg.board_only_edges(edges, p).first()["roles_a"] == "BOARD"
    ghost = spark.createDataFrame([("G1", "?", 9.0)], "emp_a string, emp_b string, score double")
    assert xorg.board_only_edges(ghost, p, match="either").count() == 1 and xorg.filter_edges_by_role(ghost, p, negate=True, match="either").count() == 1


def test_one_person_an_organization(spark):
    rows = [person("A", "1", 2019, "ANN", "GANTSOUDES"), person("B", "1", 2019, "ANN", "GANTSOUDES"), person("C", "2", 2019, "ANN", "GANTSOUDES"), *[person(f"F{k}", f"{k}", 2019, "X", last) for k, last in enumerate(["REED", "BERG", "HOEY", "VANCE"], 5)]]
    r = xorg.link_cross_org(spark.createDataFrame(rows, PERSONS))
    a = {x["EMP_ID"]: x["XORG_ID"] for x in r.assignment.collect()}
    assert a["A"] != a["B"] and a["C"] == a["A"] and r.report.first()["n_rejected_org_collision"] == 1


def test_profile(spark):
    rows = [person("P", "1", 2019, "BOB", "HOEY"), person("P", "1", 2021, "ROBERT", "HOEY"), person("P", "1", 2020, "R", "HOEY-LEE", title="CEO"), person("Q", "2", None, None, None)]
    p = {r["EMP_ID"]: r for r in profiles(spark, rows).collect()}
    q = p["P"]
    assert (q["first_name"], q["last_name"], q["n_years"], q["first_year"], q["primary_role"], q["is_board"]) == ("ROBERT", "HOEY", 3, 2019, "BOARD", True)
    assert q["first_name_variants"] == ["BOB", "R", "ROBERT"] and q["first_name_roots"] == ["R", "ROBERT"] and q["roles"] == ["BOARD", "OFFICER"] and q["middle_initials"] == []
    assert p["Q"]["first_name"] is None and p["Q"]["last_name_keys"] == [] and p["Q"]["first_year"] is None and p["Q"]["years"] == []
