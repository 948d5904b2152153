"""Roles of persons in a filing: the cascade from boxes, pay and titles, and the passes that refine it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# --- fixed values: patterns -----------------------------------------------------------------------------------------

CEO_TITLE = r"\bCEO\b|CHIEF EXEC|EXECUTIVE DIRECTOR|\bEXEC DIR"
COO_TITLE = r"CHIEF OPERATING|\bCOO\b"
CFO_TITLE = r"CHIEF FINANC|\bCFO\b"
BOARD_TITLE = "BOARD|TRUSTEE|DIRECTOR|CHAIR|COMMITTEE|COUNCIL|ELDER|DEACON|REGENT|WARDEN"
LEAD_TITLE = r"\bCEO\b|CHIEF|EXECUTIVE|PRESIDENT|\bDIRECTOR\b|MANAGER|ADMINISTRATOR|SUPERINTENDENT|PRINCIPAL|\bDEAN\b|\bHEAD\b|OFFICER"
MANAGER_TITLE = r"MANAGER|DIRECTOR OF|PROGRAM DIRECTOR|SUPERVISOR|COORDINAT|ADMINISTRATOR|\bDEAN\b|PRINCIPAL|SUPERINTENDENT|\bHEAD\b|CHIEF"
OUTGOING = "FORMER|OUTGOING|PAST|RETIR|RESIGN|EMERIT|THROUGH|UNTIL"
INCOMING = r"ELECT|INCOMING|EFFECTIVE|AS OF|FUTURE|\bNEW\b|BEGIN"
CHIEF_TITLE = r"CHIEF|\bC[EFIOMTA]O\b|GENERAL COUNSEL"
SENIOR_VP = r"EXECUTIVE VICE|SENIOR VICE|\bEVP\b|\bSVP\b|VICE PRESIDENT OF (FINANCE|OPERAT|ADMINIST|DEVELOP|PROGRAM|EXTERNAL|BUSINESS|MARKET|STRATEG)"
BOARD_WORD = r"\bBOARD\b|\bTRUSTEE\b|CHAIR|COUNCIL|DELEGATE|\bREGENT\b|\bELDER\b|DEACON|VESTRY|OVERSEER"
GOVERNANCE_WORD = r"\bTRUSTEE\b|BOARD OF|\bBOARD\b|COUNCIL(OR|LOR|MAN|WOMAN|MEMBER)?\b|\bDELEGATE\b|\bREGENT\b|\bELDER\b|DEACON|VESTRY|\bWARDEN\b|OVERSEER|PRESBYTER"
OFFICER_WORD = r"\bCEO\b|CHIEF|EXECUTIVE|PRESIDENT|\bVICE|\bVP\b|SECRETARY|TREASURER|\bCHAIR|MANAGER|ADMINISTRATOR|SUPERINTENDENT|\bDEAN\b|PHYSICIAN|COUNSEL|DIRECTOR OF"
CONJUNCTION = " AND |/| & |,| - |CO-CHAIR"
POSITION_RANK = {"officer": 1, "board_officer": 2, "board": 3, "staff": 4, "unknown": 5}


def _said(*names: str) -> Column:
    return F.upper(F.concat_ws(" ", *names))


def _has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def _ranked(position: Column) -> Column:
    out = F.lit(9)
    for name, rank in POSITION_RANK.items():
        out = F.when(position == name, rank).otherwise(out)
    return out


def assign_positions(df: DataFrame) -> DataFrame:
    """Add title marks, position and pos_source to rows with paid, cb_tru, cb_off, cb_key, title_raw and title_standard."""
    t = _said("title_raw", "title_standard")
    d = df.withColumns({"t_all": t, "ceo_title": _has(t, CEO_TITLE), "coo_title": _has(t, COO_TITLE), "cfo_title": _has(t, CFO_TITLE), "board_title": _has(t, BOARD_TITLE)})
    d = d.withColumn("exec_title", F.col("ceo_title") | F.col("coo_title") | F.col("cfo_title"))
    x = F.col
    position = (
        F.when(x("exec_title") & x("paid"), F.when(x("cb_tru"), "board_officer").otherwise("officer")).when(x("cb_off"), F.when(x("cb_tru"), "board_officer").otherwise("officer"))
        .when(x("cb_tru"), "board").when(x("cb_key"), "staff").when(x("board_title") & ~x("paid"), "board").when(x("paid"), "staff").otherwise("unknown")
    )
    source = F.when(x("exec_title") & x("paid"), "title+pay").when(x("cb_off") | x("cb_tru") | x("cb_key"), "checkbox").otherwise("title")
    return d.withColumns({"position": position, "pos_source": source})


def role_cascade(df: DataFrame, filing: str = "OBJECTID", person: str = "person_id") -> DataFrame:
    """One row for each person of a filing: position (the most senior of its rows), func and func_src.

    A filing's CEO is its paid officers with a CEO title; else its best paid officers; else its best paid working
    presidents or chairs; else its best paid board members.  Ties share the seat.
    """
    d = assign_positions(df)
    p = d.groupBy(filing, person).agg(
        *[F.max(c).alias(c) for c in ("paid", "comp", "hrs", "cb_tru", "cb_off", "cb_key", "ceo_title", "coo_title", "cfo_title")], F.array_join(F.array_sort(F.collect_set("t_all")), " ").alias("t_all"),
        F.min_by("position", _ranked(F.col("position"))).alias("position"), F.min_by("pos_source", _ranked(F.col("position"))).alias("pos_source"),
    )
    x = F.col
    p = p.withColumns({"is_officer": x("position").isin("officer", "board_officer"), "is_board": x("position").isin("board", "board_officer")})
    org = W.partitionBy(filing)
    # candidates of each rung, from the first that has any
    rungs = [
        ("title", x("is_officer") & x("paid") & x("ceo_title")), ("top-paid-officer", x("is_officer") & x("paid")),
        ("working-board", (x("position") == "board_officer") & x("paid") & _has(x("t_all"), "PRESIDENT|CHAIR")), ("de-facto-leader", x("is_board") & x("paid")),
    ]
    ceo, src, open_ = F.lit(False), F.lit(None).cast("string"), F.lit(True)
    for name, mark in rungs:
        top = mark if name == "title" else mark & (x("comp") == F.max(F.when(mark, x("comp"))).over(org))
        ceo = ceo | (open_ & F.coalesce(top, F.lit(False)))
        src = F.when(open_ & F.coalesce(top, F.lit(False)), name).otherwise(src)
        open_ = open_ & ~F.max(mark).over(org)
    base = F.when(x("is_board") & ~x("is_officer"), "board").when(x("position") == "staff", "staff").otherwise("officer")
    func = F.when(ceo, "ceo").when(x("is_officer") & x("cfo_title"), "cfo").when(x("is_officer") & x("coo_title"), "coo").otherwise(base)
    return p.withColumns({"func": func, "func_src": F.when(ceo, src).otherwise("position")})


def resolve_leadership(persons: DataFrame, filing: str = "OBJECTID", person: str = "person_id") -> DataFrame:
    """Pass 1: leader_type of persons and org_leadership of filings; imputed leaders exclude paid board chairs of few hours."""
    x = F.col
    org = W.partitionBy(filing)
    t = x("t_all")
    designated = (x("func") == "ceo") & (x("func_src") == "title")
    chair = x("cb_tru") & (x("hrs") < 25) & _has(t, "PRESIDENT|CHAIR") & ~_has(t, "VICE")
    d = persons.withColumns({"designated": designated, "n_designated": F.sum(designated.cast("int")).over(org), "any_paid": F.max("paid").over(org)})
    eligible = x("paid") & ~chair & (x("cb_off") | _has(t, LEAD_TITLE)) & (x("n_designated") == 0)
    pick = W.partitionBy(filing, eligible).orderBy(F.desc("comp"), person)
    d = d.withColumn("eligible", eligible).withColumn("imputed", F.col("eligible") & (F.row_number().over(pick) == 1))
    interim = _has(t, r"INTERIM|ACTING|\bTEMP\b")
    kind = F.when(x("designated"), F.when(interim, "interim_ceo").when(x("n_designated") >= 2, "co_ceo").otherwise("ceo_designated")).when(x("imputed"), "chief_staff_imputed")
    demoted = F.when(x("is_board"), "board").when(x("paid"), "staff").otherwise("board")
    func = F.when(x("imputed"), "ceo").when((x("func") == "ceo") & ~x("designated"), demoted).otherwise(x("func"))
    lead = F.when(x("n_designated") > 0, "designated").when(F.max("imputed").over(org), "chief_staff_imputed").when(x("any_paid"), "board_governed").otherwise("no_paid")
    return d.withColumns({"leader_type": kind, "org_leadership": lead, "func": func}).drop("designated", "n_designated", "any_paid", "eligible", "imputed")


def annotate_board_officers(persons: DataFrame, filing: str = "OBJECTID") -> DataFrame:
    """Pass 2: board_officer_role, its status, and whether several current persons share it."""
    x = F.col
    t = x("t_all")
    role = F.when(x("is_board") & _has(t, r"BOARD PRESIDENT|BOARD CHAIR|CHAIRMAN|\bCHAIR\b"), "president/chair").when(x("is_board") & _has(t, "BOARD SECRETARY"), "secretary").when(x("is_board") & _has(t, "BOARD TREASURER"), "treasurer")
    status = F.when(_has(t, OUTGOING), "outgoing").when(_has(t, INCOMING), "incoming").when(_has(t, "INTERIM|ACTING"), "interim").otherwise("current")
    d = persons.withColumn("board_officer_role", role).withColumn("board_officer_status", F.when(F.col("board_officer_role").isNotNull(), status))
    current = F.sum((x("board_officer_status") == "current").cast("int")).over(W.partitionBy(filing, "board_officer_role"))
    shared = F.when(x("board_officer_status") != "current", "transition").when(current > 1, "shared/concurrent").otherwise("single")
    return d.withColumn("board_officer_concurrency", F.when(F.col("board_officer_role").isNotNull(), shared))


def add_role_coarse(persons: DataFrame) -> DataFrame:
    x = F.col
    manager = _has(x("t_all"), MANAGER_TITLE)
    coarse = (
        F.when(x("func") == "ceo", "CEO").when(x("is_board"), "BOARD").when(x("func").isin("cfo", "coo", "officer"), "OFFICER").when(x("paid") & x("cb_key"), F.when(manager, "MANAGER").otherwise("KEY"))
        .when(x("paid") & manager, "MANAGER").otherwise("STAFF")
    )
    return persons.withColumn("role_coarse", coarse)


def unravel_directors(persons: DataFrame, mark: str = "f_dirvp", pay: float = 100_000.0) -> DataFrame:
    """Pass 3: persons marked director or vice president go to the board, up to officers or down to managers."""
    if mark not in persons.columns:
        return persons.withColumn("dirvp_disposition", F.lit(None).cast("string"))
    x = F.col
    up = _has(x("t_all"), CHIEF_TITLE) | _has(x("t_all"), SENIOR_VP) | (x("cb_off") & (x("comp") >= pay)) | x("func").isin("cfo", "coo", "officer")
    way = F.when(F.coalesce(x(mark), F.lit(False)), F.when(x("is_board"), "board").when(up, "up:officer/c-level").otherwise("down:manager"))
    d = persons.withColumn("dirvp_disposition", way)
    free = ~x("role_coarse").isin("CEO", "BOARD")
    coarse = F.when((x("dirvp_disposition") == "down:manager") & free, "MANAGER").when((x("dirvp_disposition") == "up:officer/c-level") & free, "OFFICER").otherwise(x("role_coarse"))
    return d.withColumn("role_coarse", coarse)


def role_refine(df: DataFrame, filing: str = "OBJECTID", person: str = "person_id") -> DataFrame:
    """The cascade and its passes."""
    p = annotate_board_officers(resolve_leadership(role_cascade(df, filing, person), filing, person), filing)
    return unravel_directors(add_role_coarse(p))


def corroborate(persons: DataFrame) -> DataFrame:
    """Add corrob: whether the trustee box, a board title, both or neither speak for a board seat."""
    said = _has(F.col("t_all"), BOARD_WORD)
    box = F.col("cb_tru")
    return persons.withColumn("corrob", F.when(box & said, "both").when(box, "box-only").when(said, "title-only").otherwise("neither"))


def gold_sample(rows: DataFrame, buckets: dict[str, tuple[Column, int]], key: str = "person_id", seed: str = "gold") -> DataFrame:
    """Up to n rows of each bucket (name to condition and n), drawn in the order of a keyed digest."""
    marks = F.array(*[F.when(cond, F.struct(F.lit(name).alias("bucket"), F.lit(n).alias("n"))) for name, (cond, n) in buckets.items()])
    d = rows.withColumn("_b", F.explode(F.filter(marks, lambda b: b.isNotNull())))
    draw = F.md5(F.concat_ws("\x00", F.lit(seed), F.col("_b.bucket"), F.col(key).cast("string")).cast("binary"))
    d = d.withColumn("_n", F.row_number().over(W.partitionBy("_b.bucket").orderBy(draw, key)))
    return d.where("_n <= _b.n").withColumn("bucket", F.col("_b.bucket")).drop("_b", "_n")


def crosswalk_gaps(df: DataFrame, title: str = "title_v7", board: str = "board") -> DataFrame:
    """Titles that speak of governance but aren't mapped to the board, with the evidence of boxes and pay and a decision."""
    d = df.withColumn("v", F.upper(F.btrim(F.col(title)))).where((F.col("v") != "") & ~F.coalesce(F.col(board), F.lit(False)) & _has(F.col("v"), GOVERNANCE_WORD) & ~_has(F.col("v"), OFFICER_WORD))
    share = lambda c: F.round(F.avg(F.when(F.col("full990"), c.cast("double"))), 2)
    raw = d.groupBy("v", "title_raw").agg(F.count(F.lit(1)).alias("n")).groupBy("v").agg(F.min(F.struct((-F.col("n")).alias("n"), "title_raw"))["title_raw"].alias("ex_raw"))
    g = d.groupBy("v").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("OBJECTID", "person_id").alias("n_persons"), share(F.col("cb_tru")).alias("pct_trustee_box"), F.round(F.avg((~F.col("paid")).cast("double")), 2).alias("pct_unpaid"),
        share(F.col("cb_off")).alias("pct_officer_box"), F.max(_has(F.col("v"), CONJUNCTION) | (F.length("v") >= 24)).alias("needs_review"),
    ).join(raw, "v")
    x = F.col
    evidence = (x("pct_trustee_box") >= 0.5) | (x("pct_trustee_box").isNull() & (x("pct_unpaid") >= 0.8))
    officer = F.coalesce(x("pct_officer_box") >= 0.5, F.lit(False)) | (x("pct_unpaid") <= 0.3)
    decision = F.when(x("needs_review"), "REVIEW-conjunction/truncated").when(officer, "REVIEW-officer/paid").when(evidence, "AUTO").otherwise("REVIEW-lowconf")
    level = F.when(x("pct_trustee_box") >= 0.6, "high").when(x("pct_trustee_box") >= 0.3, "medium").otherwise("low")
    return g.withColumnRenamed("v", "title_variant").withColumns({"decision": decision, "confidence": level}).orderBy("decision", F.desc("n_persons"), "title_variant")
