"""Names, ids, roles and the synthetic panel: golden values and properties."""

import random

import pytest
from pyspark.sql import functions as F

from panellink.functions import similarity as S
from panellink.functions.constants import nickname_table
from panellink.functions.ids import batch_id, batch_method, build_id_string, create_emp_ids, person_year_id
from panellink.functions.normalize import name_tokens
from panellink.functions.roles import classify_title_role, match_position, title_role_coverage
from panellink.operators.profile import first_name_roots, surname_blocking_keys
from panellink.sources.fixtures import synthetic_panel


def plain_jaro(a, b):
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    w = max(max(len(a), len(b)) // 2 - 1, 0)
    free, left, right = [True] * len(b), [], [""] * len(b)
    for i, c in enumerate(a):
        for j in range(max(0, i - w), min(len(b), i + w + 1)):
            if free[j] and b[j] == c:
                free[j], right[j] = False, c
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(left, [c for c in right if c])) / 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def test_jaro_matches_a_plain_one():
    rng = random.Random(1)
    a, b = ([("".join(rng.choice("ABCDEFGH") for _ in range(rng.randrange(0, 12)))) for _ in range(6000)] for _ in "xy")
    got = S.jaro(a, b)
    assert max(abs(x - plain_jaro(p, q)) for x, p, q in zip(got, a, b)) < 1e-12


def test_golden_similarities():
    last = lambda x, y: S.compare_last([x], [y])[0]
    first = lambda x, y: S.compare_first([x], [y])[0]
    assert last("MCLANE", "MC-LANE") == 1 and last("SMITH", "SMYTHE") == pytest.approx(0.6444444, abs=1e-7)
    assert last("ANDREWS-MCLANE", "MCLANE") == 1 and last("WEINER-COHEN", "COHEN-GANTSOUDES") == pytest.approx(0.06868687, abs=1e-8)
    assert first("BOB", "ROBERT") == 0.95 and first("ALEXIS", "MARCELLA") == pytest.approx(0.05555556, abs=1e-8)
    assert first("JON", "JONATHAN") == 0.95 and first("LISA", "BETH") == 0 and first("J", "JIM") == 0.6 and first("J", "BOB") == 0
    assert last(None, "A") is None and last(" - ", "A") is None and first("", "A") is None and first(" bob ", "BOB") == 1
    assert S.soundex("ASHCRAFT") == "A261" and S.osa_distance("KLEIN", "KLIEN") == 1


def test_surname_grid_is_symmetric_where_it_must_be():
    names = "SMITH SMYTHE SMITH-JONES JONES VAN-DER-BERG BERG O'NEIL ONEIL DE-LA-CRUZ CRUZ MC-LANE MCLANE LEE A".split()
    for x in names:
        for y in names:
            s = S.compare_last([x], [y])[0]
            assert 0 <= s <= 1 and (x != y or s == 1)


def test_columns_equal_kernels(spark):
    rng = random.Random(4)
    pool = ["SMITH", "SMYTHE", "COHEN-LEE", "LEE", None, "", "GARCIA", "LOPEZ-GARCIA", "BOB", "ROBERT", "J"]
    rows = [(rng.choice(pool), rng.choice(pool)) for _ in range(300)]
    d = spark.createDataFrame(rows, "a string, b string").repartition(3)
    for kind, kernel in S.KERNELS.items():
        got = {(r["a"], r["b"]): r["s"] for r in d.withColumn("s", S.similarity(kind, F.col("a"), F.col("b"))).collect()}
        assert got == {(a, b): kernel([a], [b])[0] for a, b in rows}
    sets = spark.createDataFrame([(["BOB", "X"], ["ROBERT"]), ([], ["A"]), (None, ["A"])], "a array<string>, b array<string>")
    assert [r[0] for r in sets.select(S.best_similarity("first", F.col("a"), F.col("b"))).collect()] == [0.95, None, None]
    S.register_functions(spark)
    assert spark.sql("SELECT compare_first_names('BOB', 'ROBERT'), jaro('SMITH', 'SMITH'), compare_last_names('A', NULL)").first()[:] == (0.95, 1.0, None)


def test_names(spark):
    d = spark.createDataFrame([("GARCIA-LOPEZ",), ("VAN DER BERG",), ("MC-LANE",)], "n string")
    keys = [r[0] for r in d.select(surname_blocking_keys(F.array("n"))).collect()]
    assert keys == [["G620", "G624", "L120"], ["B620", "V536"], ["L500", "M245"]]
    both = spark.range(1).select(surname_blocking_keys(F.array(F.lit("COHEN"), F.lit("WEINER"))), first_name_roots(F.array(F.lit("KATE"), F.lit("ZED"))), name_tokens(F.lit(" Mc-Lane  jr ")))
    assert both.first()[:] == (["C500", "W560"], ["CATHERINE", "KATHERINE", "ZED"], ["MC", "LANE", "JR"])
    assert len(nickname_table()) == 70 or len(nickname_table()) > 60
    pairs = spark.createDataFrame([("BOB", "ROBERT"), ("BOB", "ROB"), ("ANN", "ANN"), (None, "BOB")], "a string, b string")
    assert [r[0] for r in pairs.select(S.nickname_equivalent(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_roles(spark):
    titles = ["PRESIDENT", "2ND VICE PRESIDENT", "board   chair", "CEO", "EXECUTIVE DIRECTOR", "VICE PRESIDENT", "VP OF FINANCE", "PROGRAM DIRECTOR", "CHAPLAIN", None, " ", "CO-CHAIR", "CHAIRMAN OF THE BOARD"]
    d = spark.createDataFrame([(t,) for t in titles], "t string")
    got = [r[0] for r in d.select(classify_title_role(F.col("t"))).collect()]
    assert got == ["BOARD", "BOARD", "BOARD", "OFFICER", "OFFICER", "BOARD", "STAFF", "STAFF", "OTHER", None, None, "OTHER", "BOARD"]
    assert d.select(classify_title_role(F.col("t"), {"Chaplain": "staff"})).collect()[8][0] == "STAFF"
    with pytest.raises(ValueError):
        classify_title_role(F.col("t"), {"X": "BOSS"})
    assert [r["n"] for r in title_role_coverage(d, "t").collect()] == [1] * 11
    hold = lambda **k: [r[0] for r in d.select(match_position(F.col("t"), **k)).collect()]
    assert hold(position="ceo")[3] and sum(hold(position="PRESIDENT", match="regex")) == 3 and hold(role="BOARD")[12]
    assert hold(position="EXECUTIVE DIRECTORS", match="fuzzy", min_sim=0.95)[4] and not any(hold(position="nobody"))
    with pytest.raises(ValueError):
        match_position(F.col("t"))


def test_ids(spark):
    d = spark.createDataFrame([("11", 2019, "Jane  Roe", "CEO")] * 3 + [(None, None, None, None)], "ein string, taxyr int, name string, title_standard string")
    got = sorted(r["id_string"] for r in build_id_string(d).collect())
    base = "EIN-11-Y-2019-NAME-JANE-ROE-TITLE-CEO"
    assert got == ["EIN--Y--NAME--TITLE-", base, f"{base}-D2", f"{base}-D3"]
    one = spark.range(1).select(person_year_id(F.lit("o"), F.lit("t")).alias("a"), person_year_id(F.lit("o"), F.lit("t"), "v2").alias("b"), create_emp_ids(F.lit("x")).alias("c")).first()
    assert one["a"].startswith("PYID-") and one["a"] != one["b"] and len(one["c"]) == 4 + 32 + 7
    with pytest.raises(ValueError):
        build_id_string(d.drop("name"))


def test_batches(spark):
    d = spark.createDataFrame([("EIN-0000112",), ("EIN-0000007",)], "ein string")
    assert batch_method(d, "ein", 100) == "digits" and batch_method(d, "ein", 7) == "hash"
    assert [r[0] for r in d.select(batch_id(F.col("ein"), 100, "digits")).collect()] == ["12", "07"]
    assert all(0 <= int(r[0]) < 7 for r in d.select(batch_id(F.col("ein"), 7)).collect())
    with pytest.raises(ValueError):
        batch_method(d.union(spark.createDataFrame([("",)], "ein string")), "ein", 10)
    with pytest.raises(ValueError):
        batch_id(F.col("ein"), 7, "digits")


def test_fixture_is_the_same_in_duckdb(spark):
    import duckdb

    from panellink.sources.fixtures import PANEL_SQL

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{sf}/orders.parquet')")
    want = sorted(map(str, con.sql(PANEL_SQL).fetchall()))
    got = sorted(str(tuple(r)) for r in synthetic_panel(spark, sf).collect())
    assert len(got) == len(want) > 0 and [g.split(",")[:6] for g in got] == [w.split(",")[:6] for w in want]
