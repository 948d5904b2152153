"""Careers, review, networks, ingest, role cascade and evaluation."""

import random

import pytest
from pyspark.sql import functions as F

from panellink.operators import careers, cascade, evaluate, ingest, network, review
from panellink.operators.profile import build_person_profile

P = "EMP_ID string, ein string, taxyr int, name string, title_standard string, title_raw string, tot_comp double"


def rows(spark, data, schema=P):
    return spark.createDataFrame([(*r, *[None] * (len(schema.split(",")) - len(r))) for r in data], schema)


# --- careers ----------------------------------------------------------------------------------------------------------------


def test_transitions(spark):
    d = rows(spark, [("A", "1", 2018, "ANN", "ED"), ("A", "1", 2019, "ANN", "ED"), ("B", "1", 2020, "BOB", "ED"), ("Z", "1", 2021, "ZOE", "CLERK"), ("C", "1", 2022, "CY", "ED")])
    strict = {r["taxyr"]: r for r in careers.flag_position_transitions(d, position="ed").collect()}
    assert strict[2018]["prev_year"] is None and not strict[2018]["transition"] and strict[2018]["incoming"]
    assert strict[2019]["continuing"] and strict[2020]["transition"] and strict[2020]["predecessor"] == "A"
    assert not strict[2022]["transition"] and strict[2022]["prev_year"] == 2021
    loose = {r["taxyr"]: r for r in careers.flag_position_transitions(d, position="ED", gap_tolerant=True).collect()}
    assert loose[2022]["transition"] and loose[2022]["predecessor"] == "B" and loose[2022]["years_since_prev"] == 2
    t = careers.flag_position_transitions(d, position="ED")
    assert careers.transitions_report(t).first().asDict() == {"n_orgs": 1, "n_holder_rows": 4, "n_incoming": 3, "n_transitions": 1}
    assert careers.flag_position_transitions(d, position="NONE").count() == 0
    with pytest.raises(ValueError):
        careers.flag_position_transitions(d.drop("EMP_ID"), position="ED")


def test_churn(spark):
    board = [(p, "1", y, p, "TRUSTEE") for y, ps in ((2019, "PQR"), (2020, "PQS"), (2021, "PQS")) for p in ps] + [("C", "1", 2022, "C", "CLERK"), ("C", "1", 2018, "C", "CLERK")]
    got = {r["taxyr"]: r for r in careers.position_churn(rows(spark, board), role="BOARD").collect()}
    assert 2018 not in got and got[2019]["n_new"] is None and got[2019]["n_current"] == 3
    assert (got[2020]["n_new"], got[2020]["n_left"], got[2020]["n_stable"]) == (1, 1, 2) and got[2020]["retention"] == pytest.approx(2 / 3)
    assert got[2021]["turnover"] == 0 and (got[2022]["n_current"], got[2022]["n_left"], got[2022]["turnover"]) == (0, 3, None)
    pooled = careers.position_churn(rows(spark, board), role="BOARD", by_org=False)
    assert "ein" not in pooled.columns and pooled.count() == 4 and careers.churn_report(pooled, None).first()["total_new"] == 1


def test_promotions(spark):
    d = rows(spark, [
        ("U", "1", 2019, "U", "ANALYST", None, 100.0), ("U", "1", 2020, "U", "CEO", None, 200.0), ("D", "1", 2019, "D", "CEO", None, 200.0), ("D", "1", 2020, "D", "ANALYST", None, 100.0),
        ("L", "1", 2019, "L", "EXECUTIVE DIRECTOR", None, 1.0), ("L", "1", 2020, "L", "EXECUTIVE DIRECTORS", None, 1.0), ("R", "1", 2019, "R", "ANALYST"), ("R", "1", 2020, "R", "CEO"),
        ("T", "1", 2018, "T", "CEO"), ("T", "1", 2019, "T", "ANALYST"), ("T", "1", 2020, "T", "CEO"), ("S", "1", 2018, "S", "CEO"), ("S", "1", 2018, "S", "CEO"), ("B", "1", 2019, "B", "CEO"), ("B", "1", 2020, "B", "TRUSTEE"),
    ])
    got = {(r["EMP_ID"], r["to_year"]): (r["change_type"], r["direction"], r["basis"]) for r in careers.flag_promotions(d).collect()}
    assert got["U", 2020] == ("real", "promotion", "comp") and got["D", 2020] == ("real", "demotion", "comp") and got["L", 2020] == ("relabel", None, "none")
    assert got["R", 2020] == ("real", "promotion", "role") and got["T", 2019][0] == "transient" and got["T", 2020][0] == "oscillation" and got["B", 2020] == ("real", "lateral", "none")
    assert len(got) == 7 and "from_comp" not in careers.flag_promotions(d.drop("tot_comp")).columns and careers.promotions_report(careers.flag_promotions(d)).count() >= 4


# --- review -----------------------------------------------------------------------------------------------------------------

FLAGS = "EMP_ID string, ein string, org_name string, taxyr int, name_raw string, first_name string, last_name string"
FLAG_ROWS = [
    ("P1", "10", "A", 2019, "Bob Hoey", "BOB", "HOEY"), ("P1", "10", "A", 2020, "Robert Hoey", "ROBERT", "HOEY"), ("P2", "11", "B", 2019, "BRAD SMITH", "BRAD", "SMITH"), ("P2", "11", "B", 2020, "SMITH BRAD", "BRAD", "SMITH"),
    ("P3", "12", "C", 2019, "William Woolfolk", "WILLIAM", "WOOLFOLK"), ("P3", "12", "C", 2020, "MRWILLIAM Woolfolk", "MRWILLIAM", "WOOLFOLK"), ("P4", "13", "D", 2019, "Dawn McNeil", "DAWN", "MCNEIL"),
    ("P4", "13", "D", 2020, "Dawn McNeil RTR RDMS CRA", "DAWN", "RTR RDMS CRA MCNEIL"), ("P5", "14", "E", 2019, "Paul Kipps", "PAUL", "KIPPS"), ("P5", "14", "E", 2020, "Paul Kennedy Kipps", "PAUL", "KENNEDY-KIPPS"),
    ("P6", "15", "F", 2019, "Nick Stevens", "NICK", "STEVENS"), ("P6", "15", "F", 2020, "Nicholas Stephens", "NICHOLAS", "STEPHENS"), ("P7", "16", "G", 2019, "Robert Martin", "ROBERT", "MARTIN"),
    ("P7", "16", "G", 2020, "Robert CMartin", "ROBERT", "CMARTIN"), ("P8", "17", "H", 2019, "Jane Roe", "JANE", "ROE"), ("Q", "1", "Z", 2019, "Frank Maddox", "FRANK", "MADDOX"), ("Q", "1", "Z", 2020, "Frank Madero", "FRANK", "MADERO"),
    ("S", "2", "Z", 2019, "Ann Lee", "ANN", "LEE"), ("S", "2", "Z", 2020, "Ann Lee", "ANN", "LEE"), ("F", "3", "Z", 2019, "Freddie X", "FREDDIE", "X"), ("F", "3", "Z", 2020, "Fred X", "FRED", "X"),
]


def test_link_flags(spark):
    f = review.flag_links(rows(spark, FLAG_ROWS, FLAGS))
    got = {r["emp_id"]: r["category"] for r in f.collect()}
    assert "P8" not in got and got == {"P1": "nickname_or_spelling", "P2": "order_swap", "P3": "parser_honorific_glue", "P4": "surname_credential", "P5": "surname_compound", "P6": "review", "P7": "parser_honorific_glue", "Q": "review", "S": None, "F": got["F"]}
    assert got["F"] != "parser_honorific_glue"
    assert [r["emp_id"] for r in review.link_review_queue(f).collect()][0] in ("P6", "Q") and review.flags_report(f).count() >= 6
    assert review.flag_links(rows(spark, [], FLAGS)).count() == 0
    with pytest.raises(ValueError):
        review.flag_links(rows(spark, FLAG_ROWS, FLAGS).drop("last_name"))


def test_parse_failures(spark, tmp_path):
    log = review.parse_fail_log(rows(spark, FLAG_ROWS, FLAGS), path=str(tmp_path / "log"))
    got = {r["emp_id"]: r for r in log.collect()}
    assert set(got) == {"P3", "P4", "P7"} and got["P3"]["expected_first"] == "WILLIAM" and got["P3"]["source"] == "self-evident"
    assert got["P4"]["expected_last"] == "MCNEIL" and "RTR" in got["P4"]["evidence"] and got["P4"]["expected_first"] == ""
    assert got["P7"]["expected_last"] == "MARTIN" and got["P7"]["source"] == "consensus" and got["P7"]["evidence"].startswith("leading 'C'")
    toks = {r["token"]: r for r in review.parse_fail_tokens(log, known=["MR"]).collect()}
    assert set(toks) == {"MR", "RTR", "RDMS", "CRA"} and toks["MR"]["in_known"] and toks["RTR"]["field"] == "surname" and toks["MR"]["field"] == "given"
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 3


ANOM = "EMP_ID string, ein string, taxyr int, name string, name_raw string, title_standard string, tot_comp double, OBJECTID string"


def anomaly(emp, ein, yr, name, raw="=", title="BOARD MEMBER", comp=0.0):
    return (emp, ein, yr, name, name if raw == "=" else raw, title, comp, f"O-{ein}-{yr}")


ANOMALIES = [
    *[anomaly("C1", "10", y, "ANN JONES") for y in range(2015, 2019)], *[anomaly(e, "11", y, "JOHN SMITH", title=t) for y in (2015, 2016) for e, t in (("H1", "CEO"), ("H2", "TREASURER"))],
    *[anomaly("G1", "12", y, "PAT REED", comp=c) for y, c in zip((2010, 2011, 2012, 2013, 2019, 2020, 2021, 2022), (4e4, 4.1e4, 4.2e4, 4.3e4, 4e5, 4.1e5, 4.2e5, 4.3e5))], *[anomaly("S1", "13", y, "LEE VANCE") for y in (2010, 2013, 2018)],
    anomaly("O1", "14", 2015, "REGIONS BANK", ""), anomaly("O1", "14", 2016, "REGIONS BANK", ""), anomaly("O2", "15", 2015, "SUSAN MCCOY", ""), anomaly("P1", "16", 2015, "VACANT"), anomaly("T1", "17", 2015, "MADONNA"),
    anomaly("D1", "18", 2015, "RAY FOX", title="DIRECTOR"), anomaly("D2", "18", 2015, "RAY FOX", title="DIRECTOR"), anomaly("I1", "19", 2015, "AL ROE"), anomaly("I1", "20", 2016, "AL ROE"), anomaly("N1", "21", None, None),
]


def test_anomalies(spark):
    d = rows(spark, ANOMALIES, ANOM)
    f = review.flag_anomalies(d)
    got = {r["emp_id"]: r for r in f.collect()}
    want = {"C1": None, "H1": "homonym_copresent", "H2": "homonym_copresent", "G1": "sequential_homonym_pay", "S1": "intermittent", "O1": "entity_not_person", "O2": "org_field_name", "P1": "entity_not_person", "T1": "name_shape", "D1": "duplicate_line", "D2": "duplicate_line", "I1": "invariant_violation", "N1": None}
    assert {k: v["category"] for k, v in got.items()} == want
    assert (got["G1"]["max_gap"], got["G1"]["n_spells"], got["G1"]["gap_return"], got["G1"]["gap_long"], got["G1"]["merge_risk"]) == (5, 2, True, True, 6.0)
    assert got["S1"]["density"] == pytest.approx(0.333) and got["S1"]["pay_shift"] is None
    assert review.anomaly_review_queue(f).count() == 7 and review.anomaly_review_queue(f, include_entity=False).count() == 5
    bare = {r["emp_id"]: r for r in review.flag_anomalies(d.drop("name_raw", "tot_comp", "OBJECTID")).collect()}
    assert bare["O1"]["category"] == "entity_not_person" and bare["O2"]["category"] is None and bare["O2"]["name_from_org_field"] is None and not bare["D1"]["dup_line_in_filing"]
    assert review.anomalies_report(f).first()["n_persons"] == 13 and review.flag_anomalies(rows(spark, [], ANOM)).count() == 0


# --- networks ------------------------------------------------------------------------------------------------------------------


def edges(spark, pairs, w=1):
    return spark.createDataFrame([(*sorted(p), w) for p in pairs], "u1 string, u2 string, w long")


def test_projections_and_meta_orgs(spark):
    seats = spark.createDataFrame([(o, p, [2019 + (p == "d")]) for o, ps in {"1": "abcx", "2": "abcd", "3": "d", "4": "z"}.items() for p in ps], "org string, person string, years array<int>")
    proj = {(r["u1"], r["u2"]): r for r in network.org_projection(seats).collect()}
    assert proj["1", "2"]["w"] == 3 and proj["1", "2"]["jaccard"] == pytest.approx(3 / 5) and proj["2", "3"]["overlap"] == 1 and len(proj) == 2
    meta = network.meta_orgs(network.org_projection(seats), seats)
    assert {r["org"]: r["meta"] for r in meta.collect()} == {"1": "1", "2": "1", "3": "3", "4": "4"}
    share = network.meta_share(network.org_projection(seats), seats, meta, "used").first()
    assert (share["meta_orgs"], share["entities_in_meta"], share["ties_1plus"], share["ties_1plus_inside"], share["interlockers"], share["interlockers_only_inside"]) == (1, 2, 2, 1, 4, 3)
    assert network.collapse(seats, meta).count() == 7 and {tuple(r) for r in network.person_projection(seats).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    groups = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "B"), ("4", "A")], "unit string, grp string")
    mix = {(r["a"], r["b"]): (r["ties"], r["possible"]) for r in network.group_mixing(network.org_pairs(seats), groups).collect()}
    assert mix == {("A", "B"): (1, 4.0), ("B", "B"): (1, 1.0)} and network.ei_index(network.org_pairs(seats), groups).first()["ei"] == 0
    attributes = spark.createDataFrame([("1", "EDU", "x"), ("2", "UNU", "x"), ("3", "HEL", "y"), ("4", None, None)], "unit string, sector string, cbsa string")
    b = {r["person"]: r for r in network.bridges(seats, attributes, brokerage=True).collect()}
    assert b["d"]["sole_links"] == 1 and b["d"]["sectors"] == 1 and b["d"]["cbsas"] == 2 and b["d"]["brokerage"] > b["a"]["brokerage"]
    s = {r["unit"]: r["kind"] for r in network.spanners(network.org_pairs(seats), spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "y"), ("4", "y")], "unit string, place string")).collect()}
    assert s == {"1": "spanner", "2": "spanner", "3": "no ties", "4": "no ties"} and network.network_summary(seats).first()["mean_degree"] == pytest.approx(4 / 3)


def test_graph_measures_match_brute_force(spark):
    rng = random.Random(7)
    nodes = [f"n{k}" for k in range(14)]
    pairs = {tuple(sorted(rng.sample(nodes, 2))) for _ in range(26)}
    e = edges(spark, pairs)
    links = {n: {x for p in pairs if n in p for x in p if x != n} for n in nodes}
    core = {}
    for k in range(1, 10):
        kept = {n for n in nodes if links[n]}
        while bad := {n for n in kept if len(links[n] & kept) < k}:
            kept -= bad
        core |= {n: k for n in kept}
    assert {r["node"]: r["core"] for r in network.coreness(e).collect()} == core
    top = max(core.values())
    assert {x for r in network.k_core(e, top).collect() for x in (r["u1"], r["u2"])} == {n for n in core if core[n] >= top}
    tri = sum(1 for a in nodes for b in links[a] for c in links[a] if a < b < c and c in links[b] and b > a)
    wedges = sum(len(v) * (len(v) - 1) / 2 for v in links.values())
    t = network.transitivity(e).first()
    assert t["triangles"] == tri and t["wedges"] == wedges
    # betweenness by enumerating shortest paths
    def paths(a, b):
        level = [[a]]
        while level:
            hit = [p for p in level if p[-1] == b]
            if hit:
                return hit
            level = [p + [x] for p in level for x in links[p[-1]] if x not in p]
        return []
    want = dict.fromkeys((n for n in nodes if links[n]), 0.0)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            ps = paths(a, b)
            for p in ps:
                for x in p[1:-1]:
                    want[x] += 1 / len(ps)
    got = {r["node"]: r["betweenness"] for r in network.betweenness(e).collect()}
    assert got == pytest.approx(want) and [r["node"] for r in network.top_brokers(e, 2).collect()] == sorted(want, key=lambda n: (-round(want[n], 9), n))[:2]
    assert {r["node"]: r["degree"] for r in network.degrees(e).collect()} == {n: len(v) for n, v in links.items() if v}


def test_eigen_centrality(spark):
    import numpy as np

    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    m = np.zeros((4, 4))
    for x, y in pairs:
        m["abcd".index(x), "abcd".index(y)] = m["abcd".index(y), "abcd".index(x)] = 1
    v = np.abs(np.linalg.eigh(m)[1][:, -1])
    got = {r["node"]: r["centrality"] for r in network.eigen_centrality(edges(spark, pairs), tolerance=1e-5).collect()}
    assert got == pytest.approx(dict(zip("abcd", v / v.max())), abs=1e-3)
    two = edges(spark, [*pairs, ("x", "y")])
    assert network.largest_component(two).count() == 4


def test_sector_groups(spark):
    d = spark.createDataFrame([("B25",), ("B43",), ("E20",), ("P20",), ("UND",), (None,), ("Z99",), ("W1",)], "n string")
    assert [r[0] for r in d.select(network.maj12(F.col("n"))).collect()] == ["EDU", "UNI", "HOS", "HMS", "UNU", "UNU", "UNU", "PSB"]
    assert [r[0] for r in d.select(network.maj10(F.col("n"))).collect()][1:3] == ["EDU", "HEL"]


def test_name_risk_and_splits(spark):
    schema = "EMP_ID string, ein string, taxyr int, name string, first_name string, middle_name string, last_name string, title_standard string"
    data = [("E1", "1", 2019, "JO SMITH", "JO", None, "SMITH", "TRUSTEE"), ("E2", "2", 2019, "JO SMITH", "JO", None, "SMITH", "TRUSTEE"), ("E3", "1", 2019, "AL ROE", "AL", "B", "ROE", "TRUSTEE"), ("E4", "2", 2019, "AL ROE", "AL", "B", "ROE", "TRUSTEE")]
    p = build_person_profile(spark.createDataFrame(data, schema))
    persons = p.select("EMP_ID", F.col("last_name").alias("XORG_ID"))
    seats = network.board_seats(p, persons)
    r = {x["person"]: x for x in network.name_risk(p, persons, seats).collect()}
    assert r["SMITH"]["ambiguous"] and r["SMITH"]["lambda"] == 1.0 and r["ROE"]["mi_confirmed"] and not r["ROE"]["ambiguous"]
    ties = {x["ties"]: (x["total"], x["only_ambiguous"]) for x in network.split_back(seats, persons, network.name_risk(p, persons, seats).where("ambiguous")).collect()}
    assert ties == {"1+ shared persons": (1, 0), "2+ shared persons": (1, 1)} and network.org_attributes(p).count() == 2


# --- ingest --------------------------------------------------------------------------------------------------------------------


def test_filings_titles_and_places(spark):
    f = spark.createDataFrame([("1", 2019, "2020-01", "", "a"), ("1", 2019, "2020-02", None, "b"), ("1", 2019, "2020-02", "X", "c"), ("1", 2020, None, None, "d")], "ein string, taxyr int, RETURN_TIME_STAMP string, RETURN_AMENDED_X string, OBJECTID string")
    assert sorted(r["OBJECTID"] for r in ingest.resolve_filings(f).collect()) == ["c", "d"]
    t = spark.createDataFrame([("a", "1", "2", "B"), ("a", "1", "1", "C"), ("a", "2", None, "D")], "OBJECTID string, TABLE_ID string, title_order string, title_standard string")
    assert sorted(r["title_standard"] for r in ingest.primary_titles(t).collect()) == ["C", "D"]
    z = spark.createDataFrame([("02138", "17", 0.4), ("02138", "00021", 0.6)], "zip string, county string, share double")
    c = spark.createDataFrame([("17", "14460"), ("21", "14460")], "county string, cbsa string")
    x = ingest.normalize_places(ingest.zip_places(z, c))
    assert [tuple(r) for r in x.collect()] == [("02138", "14460", 1.0)]
    tie = spark.createDataFrame([("z", "2", 0.5), ("z", "1", 0.5)], "zip string, cbsa string, share double")
    assert ingest.filing_place(spark.createDataFrame([("o", "z")], "OBJECTID string, zip string"), tie).first()["org_cbsa"] == "1"
    once = ingest.map_distinct(spark.createDataFrame([("a",), ("a",), (None,)], "n string"), "n", lambda v: v.withColumn("u", F.upper("n")))
    assert sorted(str(r["u"]) for r in once.collect()) == ["A", "A", "None"]


def test_membership_and_samples(spark):
    f = spark.createDataFrame([("p", y, "990") for y in range(2015, 2020)] + [("e", 2017, "990EZ"), ("e", 2019, "990")] + [("x", 2015, "990EZ")] + [("t", 2016, "990")], "ein string, taxyr int, form string")
    m = {r["org"]: r for r in ingest.membership_classes(f, form="form").collect()}
    assert {k: v["panel_type"] for k, v in m.items()} == {"p": "persistent", "e": "entrant", "x": "exit", "t": "transient"}
    assert m["e"]["panel_spell"] == "segmented" and m["e"]["panel_gap_size_max"] == 1 and m["e"]["form_mix"] == "switcher"
    d = spark.range(1000).select(F.col("id").cast("string").alias("ein"), (F.col("id") % 10 == 0).alias("s"))
    s = ingest.stratified_sample(d, ["s"], 100, floor=30)
    n = {r["s"]: (r["n"], r["w"]) for r in s.groupBy("s").agg(F.count("*").alias("n"), F.first("weight").alias("w")).collect()}
    assert n[False] == (75, 12.0) and n[True] == (30, pytest.approx(100 / 30)) and s.exceptAll(ingest.stratified_sample(d.repartition(9), ["s"], 100, floor=30)).count() == 0
    b = spark.createDataFrame([(0.0,), (5.0,), (None,)], "x double").select(ingest.size_bin(F.col("x"), [0.5, 10.0], ["0", "low", "high"]))
    assert [r[0] for r in b.collect()] == ["0", "low", "missing"] and ingest.top_values(d, "s", 1).first()["n"] == 900
    g = ingest.person_groups(d, ["s"], {"any": F.col("ein") == "10"}, {"names": "ein"})
    assert {r["s"]: r["any"] for r in g.collect()} == {True: True, False: False}


# --- cascade -------------------------------------------------------------------------------------------------------------------

C = "OBJECTID string, person_id string, title_raw string, title_standard string, paid boolean, comp double, hrs double, cb_tru boolean, cb_off boolean, cb_key boolean, f_dirvp boolean"
CASCADE = [
    ("1", "a", "ceo/president", "CEO", True, 100.0, 40.0, False, True, False, False), ("1", "a", "ceo/president", "PRESIDENT", True, 100.0, 40.0, False, True, False, False), ("1", "b", "CFO", "CFO", True, 90.0, 40.0, False, True, False, False),
    ("1", "c", "", "BOARD CHAIR", False, 0.0, 1.0, True, False, False, False), ("1", "d", "", "PROGRAM DIRECTOR", True, 80.0, 40.0, False, False, True, True), ("2", "a", "", "TREASURER", True, 50.0, 40.0, False, True, False, False),
    ("2", "b", "", "SECRETARY", True, 50.0, 40.0, False, True, False, False), ("3", "a", "", "PRESIDENT", True, 10.0, 5.0, True, True, False, False), ("4", "a", "", "TRUSTEE", False, 0.0, 1.0, True, False, False, False),
    ("5", "a", "", "NURSE", True, 5.0, 40.0, False, False, False, False), ("6", "a", "acting", "CEO", True, 9.0, 9.0, False, True, False, False), ("7", "a", "", "CEO", True, 9.0, 9.0, False, True, False, False), ("7", "b", "", "CEO", True, 8.0, 9.0, False, True, False, False),
]


def test_cascade(spark):
    d = rows(spark, CASCADE, C)
    p = {(r["OBJECTID"], r["person_id"]): r for r in cascade.role_cascade(d).collect()}
    assert len(p) == 12 and p["1", "a"]["func"] == "ceo" and p["1", "a"]["func_src"] == "title" and p["1", "b"]["func"] == "cfo" and p["1", "c"]["func"] == "board" and p["1", "d"]["func"] == "staff"
    assert p["2", "a"]["func"] == p["2", "b"]["func"] == "ceo" and p["2", "a"]["func_src"] == "top-paid-officer"
    refined = cascade.role_refine(d.join(d.groupBy("OBJECTID", "person_id").agg(F.max("f_dirvp").alias("_f")), ["OBJECTID", "person_id"]).drop("_f"))
    r = {(x["OBJECTID"], x["person_id"]): x for x in refined.collect()}
    assert r["1", "a"]["leader_type"] == "ceo_designated" and r["6", "a"]["leader_type"] == "interim_ceo" and r["7", "a"]["leader_type"] == "co_ceo"
    assert r["3", "a"]["leader_type"] is None and r["3", "a"]["org_leadership"] == "board_governed" and r["4", "a"]["org_leadership"] == "no_paid"
    assert r["1", "c"]["board_officer_role"] == "president/chair" and r["1", "c"]["board_officer_concurrency"] == "single" and r["1", "c"]["role_coarse"] == "BOARD" and r["1", "d"]["role_coarse"] == "MANAGER"
    two = cascade.unravel_directors(cascade.add_role_coarse(cascade.role_cascade(d)).withColumn("f_dirvp", F.col("person_id") == "d"))
    assert {x["dirvp_disposition"] for x in two.collect()} == {None, "down:manager"}
    c = {(x["OBJECTID"], x["person_id"]): x["corrob"] for x in cascade.corroborate(cascade.role_cascade(d)).collect()}
    assert c["1", "c"] == "both" and c["3", "a"] == "box-only" and c["5", "a"] == "neither"
    g = cascade.gold_sample(cascade.role_cascade(d), {"ceo": (F.col("func") == "ceo", 2), "board": (F.col("is_board"), 10)})
    assert {x["bucket"]: x["n"] for x in g.groupBy("bucket").agg(F.count("*").alias("n")).collect()} == {"ceo": 2, "board": 3}


def test_crosswalk_gaps(spark):
    schema = "title_v7 string, title_raw string, board boolean, cb_tru boolean, cb_off boolean, full990 boolean, paid boolean, OBJECTID string, person_id string"
    data = [("ELDER", "elder", False, True, False, True, False, "1", "a"), ("ELDER", "Elder", None, True, False, True, False, "2", "a"), ("WARDEN", "w", False, False, True, True, True, "3", "a"), ("TRUSTEE AND ELDER", "x", False, True, False, True, False, "4", "a"), ("CHAIRMAN OF BOARD", "x", False, True, False, True, False, "5", "a"), ("TRUSTEE", "t", True, True, False, True, False, "6", "a")]
    got = {r["title_variant"]: (r["decision"], r["n_persons"]) for r in cascade.crosswalk_gaps(spark.createDataFrame(data, schema)).collect()}
    assert got == {"ELDER": ("AUTO", 2), "WARDEN": ("REVIEW-officer/paid", 1), "TRUSTEE AND ELDER": ("REVIEW-conjunction/truncated", 1)}


# --- evaluation ----------------------------------------------------------------------------------------------------------------


def test_sweep_matches_brute_force(spark):
    rng = random.Random(3)
    data = [(rng.choice([0, 1, None]), rng.uniform(-5, 16)) for _ in range(500)]
    for r in evaluate.threshold_sweep(spark.createDataFrame(data, "label int, score double")).collect():
        want = [sum(1 for y, s in data if y == k and (s >= r["threshold"]) == up) for k, up in ((1, True), (0, True), (1, False), (0, False))]
        assert [r["TP"], r["FP"], r["FN"], r["TN"]] == want
    best = evaluate.best_thresholds(evaluate.threshold_sweep(spark.createDataFrame([(1, 9.0), (1, 8.0), (0, 3.0)], "label int, score double"))).first()
    assert best["best_f1"] == 8.0 and best["f1"] == 1.0 and best["high_precision"] == 8.0
    assert evaluate.score_quantiles(spark.createDataFrame(data, "label int, score double")).count() == 2


def test_silver_labels(spark):
    d = spark.createDataFrame([("BOB", "ROBERT", "ROE", "ROE", "", ""), ("ANN", "ZEKE", "ROE", "ROE", "", ""), ("ANN", "ANN", "ROE", "ROE", "SR", "JR"), ("A", "ANN", "ROE", "ROE", "", ""), ("ANN", "ANN", "ROE", "QUICK", "", "")], "first_name_x string, first_name_y string, last_name_x string, last_name_y string, suffix_x string, suffix_y string")
    assert [r["label"] for r in evaluate.silver_labels(d).collect()] == [1, 0, 0, None, None]


def test_name_ladders():
    s, f = evaluate.surname_ladder, evaluate.first_ladder
    both = {"SMITH", "JONES"}.__contains__
    assert [s("VAN DEUSEN", "DEUSEN"), s("MACLEAN", "MCLEAN"), s("SMITH-JONES", "JONES"), s("KLEIN", "KLIEN"), s("SMITH", "JONES", both), s("SMITH", "JONES"), s("", "X"), s("O'NEIL", "ONEIL")] == ["particle", "particle", "compound", "spelling", "different", "unrelated", "missing", "same"]
    assert [f("BOB", "ROBERT"), f("R", "ROBERT"), f("R", "BOB"), f("KRIS", "KRISTINA"), f("DANIEL", "DANEIL"), f("ANN", "ANN"), f("DAVID", "MARK", {"DAVID", "MARK"}.__contains__)] == ["nickname", "initial", "different", "nickname", "spelling", "same", "different"]


def test_checks_and_changes(spark):
    schema = "EMP_ID string, ein string, taxyr int, first_name string, middle_name string, last_name string, suffix string, gender string, title_standard string, tot_comp double"
    data = [
        ("A", "1", 2019, "MARY", None, "ROE", None, "F", "TREASURER", 10.0), ("B", "1", 2020, "MARY", "ROE", "QUICK", None, "F", "TREASURER", 10.0), ("C", "1", 2019, "JO", None, "SMITH", "SR", "M", "CEO", 1.0), ("C", "1", 2020, "JO", None, "SMITH", "JR", "F", "CEO", 1.0),
        ("D", "2", 2019, "AL", None, "X", None, None, "CEO", 1.0), ("D", "2", 2019, "AL", None, "X", None, None, "CEO", 1.0), ("E", "2", 2018, "SUE", None, "BERG", None, "F", "CEO", 1.0), ("E", "2", 2019, "SUE", None, "VANCE", None, "F", "CEO", 1.0),
    ]
    d = spark.createDataFrame(data, schema)
    assert {r["check"]: r["records"] for r in evaluate.record_checks(d).collect()} == {"two rows in one year: duplicate": 1, "suffix conflict": 1, "gender mixed": 1}
    found = evaluate.surname_successions(d)
    r = found.first()
    assert found.count() == 1 and (r["emp_a"], r["emp_b"], r["strength"], r["maiden_kept"]) == ("A", "B", "strong", True)
    assert evaluate.surname_change_rates(found, d).first()["female"] == 1 and [tuple(x) for x in evaluate.surname_switches(d).collect()] == [("E", "BERG", "VANCE")]
    names = spark.createDataFrame([(f"p{k}", n) for k in range(5) for n in ("DAVID", "MARK")] + [("q", "BOB"), ("q", "ROBERT")], "EMP_ID string, first_name string")
    assert evaluate.first_name_conflicts(names).count() == 5
    assert evaluate.linkage_summary(d).first()["persons"] == 5 and evaluate.same_next_year(d, F.col("title_standard") == "CEO").first()["n"] == 2
    q = evaluate.pair_quality(d.withColumn("t", F.when(F.col("EMP_ID") == "B", "A").otherwise(F.col("EMP_ID"))), "t").first()
    assert q["precision"] == 1.0 and q["recall"] == pytest.approx(3 / 4)
    h = spark.createDataFrame([("1", 2019, "A", "X", "Y"), ("1", 2020, "A", "X", "Y"), ("2", 2019, "B", "X", "Y"), ("2", 2020, "C", "Q", "R")], "ein string, taxyr int, EMP_ID string, first string, last string")
    assert evaluate.linkage_accuracy(h).first()[:] == (1, 1.0, 1, 0.0)
    vote = spark.createDataFrame([("o", 2)], "OBJECTID string, vote int")
    assert evaluate.board_size_check(spark.createDataFrame([("o", True), ("o", True), ("o", False)], "OBJECTID string, b boolean"), F.col("b"), vote).first()[:] == (1, 1.0, 1.0, 0)


def test_review_evidence_and_seeds(spark):
    schema = "EMP_ID string, ein string, taxyr int, name string, first_name string, middle_name string, last_name string, suffix string, gender string, title_standard string"
    data = [("A", "1", 2019, "BOB HOEY", "BOB", "Q", "HOEY", "SR", "M", "TRUSTEE"), ("B", "2", 2005, "ROBERT HOEY", "ROBERT", "Q", "HOEY", "JR", "M", "TRUSTEE"), ("C", "3", 2019, "ROBERT HOEY", "ROBERT", None, "HOEY", None, "M", "TRUSTEE"), *[(f"F{k}", f"9{k}", 2019, f"X {n}", "X", None, n, None, "M", "CLERK") for k, n in enumerate("REED BERG LOPEZ VANCE COHEN".split())]]
    p = build_person_profile(spark.createDataFrame(data, schema))
    pairs = spark.createDataFrame([("A", "B"), ("B", "C")], "emp_a string, emp_b string")
    seats = spark.createDataFrame([("1", "z"), ("2", "z")], "org string, person string")
    e = {(r["emp_a"], r["emp_b"]): r for r in evaluate.pair_evidence(pairs, p, seats, spark.createDataFrame([("2", "THE HOEY FUND")], "org string, org_name string")).collect()}
    ab = e["A", "B"]
    assert (ab["first_name_relation"], ab["middle_initials"], ab["generational_suffix"], ab["years_gap"], ab["shared_board_members"], ab["family_name_in_org"], ab["review_priority"]) == ("nickname", "agree", "conflict", 14, 1, True, "high")
    cases = evaluate.hard_cases(pairs.limit(1), p, "suffix_conflict", "test")
    assert cases.first()["label"] == "expected_different" and cases.first()["forms_a"] == "BOB HOEY" and len(evaluate.hard_case_categories()) == 18
    seeds = spark.createDataFrame([("B", "C")], "emp_a string, emp_b string")
    t = {r["test"]: r["recall"] for r in evaluate.seeded_test(seeds, p).collect()}
    assert t["control"] == 1 and t["nickname"] == 1 and t["surname_replaced"] == 0 and t["names_swapped"] == 0
    from panellink.plans.xorg import score_candidate_pairs

    v = {r["outcome"]: r["pairs"] for r in evaluate.variant_test(score_candidate_pairs(seeds, p), p).collect()}
    assert v == {"kept": 1}
    sx = spark.createDataFrame([(["JR"], ["II"]), (["SR"], ["SR"]), ([], []), (["SR"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in sx.select(evaluate.suffix_relation(F.col("a"), F.col("b"))).collect()] == ["JR vs II (compatible)", "agree", "none", "one side only"]


def test_blocking_variants_and_ntiles(spark):
    p = spark.createDataFrame([(e, [o]) for e, o in (("A", "1"), ("B", "2"), ("C", "3"))], "EMP_ID string, orgs array<string>")
    s = spark.createDataFrame([("A", "B", "strict", 9.0), ("A", "C", "metro", 8.0), ("B", "C", "metro", 1.0)], "emp_a string, emp_b string, pass string, score double")
    got = {r["variant"]: tuple(r)[1:] for r in evaluate.blocking_variants(s, p, {"strict": F.col("pass") == "strict", "all": F.lit(True), "none": F.col("score") < 2}).collect()}
    assert got == {"strict": (1, 1, 2, 1, 1.0), "all": (3, 2, 3, 2, pytest.approx(4 / 3)), "none": (1, 0, 0, 0, None)}
    b = ingest.ntile_batches(spark.createDataFrame([(str(k), k) for k in range(7)] * 2, "ein string, y long"), 3)
    assert sorted(r["batch"] for r in b.collect()) == [1, 1, 1, 2, 2, 3, 3]
