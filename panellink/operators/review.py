"""Review of a linked panel: link flags, parse failures and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panellink.functions import constants as K
from panellink.functions.normalize import as_year, column, known, name_tokens, pick, raw_key, trimmed
from panellink.functions.similarity import extreme_similarity


def honorific_tokens() -> list[str]:
    return list(K.HONORIFICS)


def credential_tokens() -> list[str]:
    return list(K.CREDENTIALS)


def corporate_tokens() -> list[str]:
    return list(K.CORPORATE_TOKENS)


def placeholder_names() -> list[str]:
    return list(K.PLACEHOLDER_NAMES)


def _constant(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _distinct(values: Column) -> Column:
    """Sorted distinct non-empty strings of an array."""
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))))


def _glue_pattern(hon) -> str:
    """The longest honorific that leaves three letters."""
    return f"^({'|'.join(sorted(hon, key=lambda h: (-len(h), h)))})([A-Z]{{3,}})$"


def _known_name(name: Column) -> Column:
    return name.isin(K.known_first_names())


def _letter_glue(names: Column) -> Column:
    """(glued, clean) pairs of an array of surnames: one is another with one letter before it."""
    pairs = F.flatten(F.transform(names, lambda a: F.transform(F.filter(names, lambda b: (F.length(a) == F.length(b) + 1) & (F.substring(a, F.lit(2), F.length(a)) == b)), lambda b: F.struct(a.alias("glued"), b.alias("clean")))))
    return pairs


def _require(df: DataFrame, what: str, *names: str) -> None:
    missing = [n for n in names if pick(df, n) is None]
    if missing:
        raise ValueError(f"{what}: missing required column(s): {', '.join(missing)}")


def flag_links(df: DataFrame, emp_id: str = "EMP_ID", org_id: str = "ein", org_name: str = "org_name", year: str = "taxyr", raw_name: str = "name_raw", first: str = "first_name", last: str = "last_name", divergence_lv: float = 0.15, divergence_jw: float = 0.15, last_sim_floor: float = 0.85, first_sim_floor: float = 0.85, hon=None, cred=None) -> DataFrame:
    """One row for each person with several records: how much the names disagree, and the likeliest reason.

    A person's records are few and gathered once; the comparisons are expressions over that array.  Without a raw name
    column the display name is used.  Names seen are sorted.
    """
    raw = pick(df, raw_name) or pick(df, "name") or raw_name
    _require(df, "flag_links", emp_id, org_id, year, raw, first, last)
    hon, cred = list(hon or K.HONORIFICS), list(cred or K.CREDENTIALS)
    part = lambda c: F.coalesce(F.upper(trimmed(column(df, c))), F.lit(""))
    d = df.select(
        column(df, emp_id).cast("string").alias("emp_id"), column(df, org_id).cast("string").alias("ein"), column(df, org_name).cast("string").alias("org_name"), column(df, year).cast("string").alias("year"),
        raw_key(column(df, raw)).alias("raw"), column(df, raw).cast("string").alias("shown"), part(first).alias("f"), part(last).alias("l"),
    )
    g = d.groupBy("emp_id").agg(
        F.min("ein").alias("ein"), F.min("org_name").alias("org_name"), F.count(F.lit(1)).cast("int").alias("n_records"), F.collect_set("year").alias("ys"), F.max(F.col("year").isNull()).alias("no_year"),
        *[F.collect_set(c).alias(c) for c in ("raw", "shown", "f", "l")],
    ).where("n_records > 1")
    g = g.withColumns({c: _distinct(F.col(c)) for c in ("raw", "shown", "f", "l")})
    apart = F.transform("raw", lambda a: F.array_max(F.transform("raw", lambda b: F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))))
    g = g.withColumns({"last_sim": extreme_similarity("last", F.col("l")), "first_sim": extreme_similarity("first", F.col("f")), "least_jaro": extreme_similarity("jaro", F.col("raw"))})
    several = lambda c: F.size(c) > 1
    g = g.withColumns({
        "last_sim": F.when(several("l"), F.col("last_sim")).otherwise(F.lit(1.0)), "first_sim": F.when(several("f"), F.col("first_sim")).otherwise(F.lit(1.0)),
        "lv": F.when(several("raw"), F.array_max(apart)).otherwise(F.lit(0.0)), "jw": F.when(several("raw"), 1 - F.col("least_jaro")).otherwise(F.lit(0.0)),
    })
    diverges = (F.col("lv") >= divergence_lv) | (F.col("jw") >= divergence_jw)
    flagged = several("f") | several("l") | diverges
    orders = F.filter(F.transform("raw", lambda n: F.array_join(F.array_sort(name_tokens(n)), " ")), lambda t: t != "")
    swap = F.size(orders) > F.size(F.array_distinct(orders))
    rest = lambda n: F.regexp_extract(n, _glue_pattern(hon), 2)
    glued = F.exists("f", lambda n: (rest(n) != "") & ~_known_name(n) & (_known_name(rest(n)) | F.array_contains("f", rest(n))))
    letter = F.size(_letter_glue(F.col("l"))) > 0
    credential = several("l") & F.exists("l", lambda n: F.arrays_overlap(F.split(n, "[ -]"), _constant(cred)))
    near = lambda c, floor: F.coalesce(F.col(c) >= floor, F.lit(False))
    category = (
        F.when(swap, "order_swap").when(glued | letter, "parser_honorific_glue").when(credential, "surname_credential")
        .when(several("l") & near("last_sim", last_sim_floor), "surname_compound").when(near("last_sim", last_sim_floor) & near("first_sim", first_sim_floor), "nickname_or_spelling").otherwise("review")
    )
    out = g.select(
        "emp_id", "ein", "org_name", "n_records", (F.size("ys") + F.col("no_year").cast("int")).alias("n_years"), F.array_join(F.array_sort("ys"), ";").alias("years"),
        F.size("raw").alias("n_distinct_name"), F.size("f").alias("n_distinct_first"), F.size("l").alias("n_distinct_last"), F.round("lv", 3).alias("name_lv_norm"), F.round("jw", 3).alias("name_jw"),
        F.round("last_sim", 3).alias("last_sim"), F.round("first_sim", 3).alias("first_sim"), several("f").alias("flag_first_disagree"), several("l").alias("flag_last_disagree"), diverges.alias("flag_name_divergence"),
        flagged.alias("review_flag"), F.when(flagged, category).alias("category"), F.array_join("shown", " | ").alias("names_seen"), F.array_join("f", " | ").alias("first_seen"), F.array_join("l", " | ").alias("last_seen"),
    )
    score = 2.0 * F.col("flag_last_disagree").cast("double") + 1.5 * F.col("flag_first_disagree").cast("double") + 3.0 * F.col("name_lv_norm") + 2.0 * F.col("name_jw")
    rank = F.array_position(_constant(K.LINK_CATEGORIES), F.col("category"))
    return out.withColumn("review_score", score).orderBy(F.col("category").isNull(), rank, F.desc("review_score"), "emp_id")


def flags_report(flags: DataFrame) -> DataFrame:
    """Persons of each category; null is those that aren't flagged."""
    return flags.groupBy("category").agg(F.count(F.lit(1)).alias("n_persons")).orderBy(F.desc("n_persons"), "category")


def link_review_queue(flags: DataFrame) -> DataFrame:
    return flags.where("category = 'review'").orderBy(F.desc("review_score"), "emp_id")


def parse_fail_log(df: DataFrame, emp_id: str = "EMP_ID", org_id: str = "ein", org_name: str = "org_name", year: str = "taxyr", raw_name: str = "name_raw", first: str = "first_name", last: str = "last_name", middle: str = "middle_name", suffix: str = "suffix", salutation: str = "salutation", object_id: str = "OBJECTID", table_id: str = "TABLE_ID", hon=None, cred=None, path: str | None = None) -> DataFrame:
    """One row for each record whose name was split wrongly, with the expected parts.

    Three defects: an honorific glued to a given name (the rest is a known name, or a name of the same person), credentials in a
    surname, and a letter glued to a surname that the person also has without it.  Several defects of a record are joined by '; '.
    """
    raw = pick(df, raw_name) or pick(df, "name") or raw_name
    _require(df, "parse_fail_log", emp_id, org_id, year, raw, first, last)
    hon, cred = list(hon or K.HONORIFICS), list(cred or K.CREDENTIALS)
    if pick(df, object_id) is None:
        object_id, table_id = "object_id", "table_id"
    text = lambda c: column(df, c).cast("string")
    d = df.select(
        text(object_id).alias("object_id"), text(table_id).alias("table_id"), text(emp_id).alias("emp_id"), text(org_id).alias("ein"), text(org_name).alias("org_name"), column(df, year).alias("year"),
        text(raw).alias("raw_name"), text(salutation).alias("salutation"), text(first).alias("first_name"), text(middle).alias("middle_name"), text(last).alias("last_name"), text(suffix).alias("suffix"),
    )
    d = d.withColumns({"_f": F.coalesce(F.upper(trimmed(F.col("first_name"))), F.lit("")), "_l": F.coalesce(F.upper(trimmed(F.col("last_name"))), F.lit(""))})
    person = d.groupBy(F.col("emp_id").alias("_e")).agg(_distinct(F.collect_set("_f")).alias("_fs"), _distinct(F.collect_set("_l")).alias("_ls"))
    d = d.join(person, F.col("emp_id").eqNullSafe(F.col("_e")))
    h, rest = F.regexp_extract("_f", _glue_pattern(hon), 1), F.regexp_extract("_f", _glue_pattern(hon), 2)
    glue = (rest != "") & ~_known_name(F.col("_f")) & (_known_name(rest) | F.array_contains("_fs", rest))
    tokens = F.split("_l", "[ -]")
    creds = F.filter(tokens, lambda t: t.isin(cred))
    others = F.filter(tokens, lambda t: ~t.isin(cred) & (t != ""))
    none = F.lit(None).cast("string")

    def defect(kind: Column, evidence: Column, exp_first: Column, exp_last: Column, source: Column) -> Column:
        return F.struct(kind.alias("defect_type"), evidence.alias("evidence"), exp_first.alias("expected_first"), exp_last.alias("expected_last"), source.alias("source"))

    mine = F.filter(_letter_glue(F.col("_ls")), lambda p: p["glued"] == F.col("_l"))
    found = F.concat(
        F.when(glue, F.array(defect(F.lit("honorific_glue"), F.concat(F.lit("honorific '"), h, F.lit("' fused onto given name")), rest, none, F.when(_known_name(rest), "self-evident").otherwise("consensus")))).otherwise(F.array()),
        F.when((F.size(creds) > 0) & (F.size(others) > 0), F.array(defect(F.lit("credential_in_surname"), F.concat(F.lit("credential token(s) in surname: "), F.array_join(creds, " ")), none, F.array_join(others, " "), F.lit("self-evident")))).otherwise(F.array()),
        F.transform(mine, lambda p: defect(F.lit("surname_letter_glue"), F.concat(F.lit("leading '"), F.substring(p["glued"], 1, 1), F.lit("' glued onto surname")), none, p["clean"], F.lit("consensus"))),
    )
    join = lambda c: F.array_join(F.array_distinct(F.filter(F.transform("_d", lambda x: x[c]), lambda v: v.isNotNull() & (v != ""))), "; ")
    out = d.withColumn("_d", found).where(F.size("_d") > 0).withColumns({c: join(c) for c in ("defect_type", "evidence", "expected_first", "expected_last", "source")})
    out = out.drop("_f", "_l", "_e", "_fs", "_ls", "_d").orderBy("emp_id", "year")
    if path:
        from panellink.sources.panel import write_csv

        write_csv(out, path)
    return out


def parse_fail_tokens(log: DataFrame, known=()) -> DataFrame:
    """(token, field, defect_type, n_records, n_persons, example, in_known): the tokens to add to a parser's lists.

    Credentials are the tokens of the surname that the expected one lacks; honorifics are what the given name has more than the
    expected one.  The example is the first in order.
    """
    toks = lambda c: F.filter(F.split(F.upper(F.coalesce(F.col(c), F.lit(""))), "[ -]"), lambda t: t != "")
    first, expected = F.upper(F.coalesce("first_name", F.lit(""))), F.upper(F.coalesce("expected_first", F.lit("")))
    lead = F.when((expected != "") & first.endswith(expected) & (F.length(first) > F.length(expected)), F.substring(first, F.lit(1), F.length(first) - F.length(expected)))
    lack = lambda: F.array_except(toks("last_name"), toks("expected_last"))
    rows = log.select("emp_id", F.explode(F.concat(
        F.when(F.col("defect_type").contains("credential_in_surname"), F.transform(lack(), lambda t: F.struct(t.alias("token"), F.lit("surname").alias("field"), F.lit("credential_in_surname").alias("defect_type"), F.col("raw_name").alias("example")))).otherwise(F.array()),
        F.when(F.col("defect_type").contains("honorific_glue") & lead.isNotNull(), F.array(F.struct(lead.alias("token"), F.lit("given").alias("field"), F.lit("honorific_glue").alias("defect_type"), F.col("raw_name").alias("example")))).otherwise(F.array()),
    )).alias("r")).select("emp_id", "r.*")
    out = rows.groupBy("token", "field", "defect_type").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("emp_id").alias("n_persons"), F.min("example").alias("example"))
    out = out.withColumn("in_known", F.array_contains(_constant([k.upper() for k in known]), F.col("token")) if known else F.lit(False))
    return out.orderBy("in_known", F.desc("n_records"), "token")


def flag_anomalies(df: DataFrame, emp_id: str = "EMP_ID", org_id: str = "ein", org_name: str = "org_name", year: str = "taxyr", name: str = "name", raw_name: str = "name_raw", title: str = "title_standard", comp: str = "tot_comp", object_id: str = "OBJECTID", gap_return_min: int = 3, gap_long_min: int = 5, pay_shift_min: float = 1.0, sporadic_span_min: int = 6, sporadic_density_max: float = 0.4, corporate=None, placeholder=None) -> DataFrame:
    """One row for each person: twelve flags of false merges and of entities that aren't persons, a weighted risk and a category.

    Record defects are counts by key; tenure comes from the sorted years of a person; pay is compared across the first of the largest gaps,
    over positive pay.  Without a raw name column, name_from_org_field is null and corporate words alone make an
    organization; without an object id, dup_line_in_filing is false.  Names and titles seen are sorted.
    """
    _require(df, "flag_anomalies", emp_id, org_id, year, name)
    corporate, placeholder = list(corporate or K.CORPORATE_TOKENS), [p.upper() for p in (placeholder or K.PLACEHOLDER_NAMES)]
    has_raw = pick(df, raw_name) is not None
    oid = pick(df, object_id) or pick(df, "object_id")
    d = df.select(
        column(df, emp_id).cast("string").alias("emp_id"), column(df, org_id).cast("string").alias("ein"), column(df, org_name).cast("string").alias("org_name"), as_year(column(df, year).cast("string")).alias("year"),
        known(column(df, name)).alias("nm"), known(column(df, title)).alias("title"), column(df, oid).cast("string").alias("oid"), column(df, comp).cast("string").try_cast("double").alias("comp"),
        (known(column(df, raw_name)).isNull() & known(column(df, name)).isNotNull() if has_raw else F.lit(None).cast("boolean")).alias("from_org"),
    )
    toks = F.filter(F.split(F.coalesce("nm", F.lit("")), "[ ,.-]+"), lambda t: t != "")
    corp = F.arrays_overlap(toks, _constant(corporate))
    twice = lambda *by: F.count(F.lit(1)).over(W.partitionBy(*by)) > 1
    d = d.withColumns({
        "org_as": F.coalesce((F.col("from_org") & corp) if has_raw else corp, F.lit(False)), "place": F.coalesce(F.col("nm").isin(placeholder), F.lit(False)), "one": F.size(toks) == 1,
        "hom": twice("ein", "year", "nm") & F.col("nm").isNotNull(), "dup_line": F.col("oid").isNotNull() & twice("oid", "nm", "title"), "dup_id": twice("emp_id", "ein", "year"),
    })
    homonyms = d.where("hom").select(F.col("ein").alias("_ein"), F.col("nm").alias("_nm")).distinct()
    d = d.join(homonyms, F.col("ein").eqNullSafe(F.col("_ein")) & (F.col("nm") == F.col("_nm")), "left").withColumn("hom", F.col("_nm").isNotNull())
    g = d.groupBy("emp_id").agg(
        F.min("ein").alias("ein"), F.min("org_name").alias("org_name"), F.count(F.lit(1)).cast("int").alias("n_records"), F.array_sort(F.collect_set("year")).alias("yy"), F.collect_set("nm").alias("nms"), F.collect_set("title").alias("ts"),
        F.countDistinct(F.coalesce("ein", F.lit("NA"))).alias("n_orgs"), F.collect_list(F.when(F.col("comp") > 0, F.struct("year", "comp"))).alias("pay"),
        F.max("dup_id").alias("dup_id_in_year"), F.max("hom").alias("homonym_copresent"), (F.coalesce(F.max("from_org"), F.lit(False)) if has_raw else F.lit(None).cast("boolean")).alias("name_from_org_field"),
        F.max("org_as").alias("org_as_person"), F.max("place").alias("placeholder_name"), F.max("one").alias("single_token_name"), F.max("dup_line").alias("dup_line_in_filing"),
    )
    n = F.size("yy")
    gaps = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.get("yy", k) - F.get("yy", k - 1) - 1)).otherwise(F.array().cast("array<int>"))
    g = g.withColumn("gaps", gaps).withColumns({"n_years": n, "first_year": F.array_min("yy"), "last_year": F.array_max("yy"), "max_gap": F.coalesce(F.array_max("gaps"), F.lit(0)), "n_gaps": F.size(F.filter("gaps", lambda x: x > 0))})
    g = g.withColumn("span", F.col("last_year") - F.col("first_year") + 1).withColumn("cut", F.get("yy", (F.array_position("gaps", F.col("max_gap")) - 1).cast("int")))
    pays = lambda keep: F.transform(F.filter("pay", keep), lambda p: p["comp"])
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))
    before, after = mean(pays(lambda p: p["year"] <= F.col("cut"))), mean(pays(lambda p: p["year"] > F.col("cut")))
    shift = F.when(F.col("max_gap") >= 2, F.abs(after - before) / F.greatest(before, F.lit(1.0)))
    g = g.withColumns({"density": F.round(F.col("n_years") / F.col("span"), 3), "pay_shift": F.round(shift, 3)})
    g = g.withColumns({
        "id_spans_orgs": F.col("n_orgs") > 1, "gap_return": (F.col("max_gap") >= gap_return_min) & (F.col("n_years") >= 4), "gap_long": F.col("max_gap") >= gap_long_min,
        "gap_pay_shift": F.coalesce((F.col("max_gap") >= 2) & (F.col("pay_shift") > pay_shift_min), F.lit(False)), "sporadic": F.coalesce((F.col("span") >= sporadic_span_min) & (F.col("density") < sporadic_density_max), F.lit(False)),
    })
    risk = F.lit(0.0)
    for flag, w in K.MERGE_WEIGHTS.items():
        risk = risk + F.lit(w) * F.col(flag).cast("double")
    is_ = F.col
    category = (
        F.when(is_("dup_id_in_year") | is_("id_spans_orgs"), "invariant_violation").when(is_("org_as_person") | is_("placeholder_name"), "entity_not_person").when(is_("dup_line_in_filing"), "duplicate_line")
        .when(is_("homonym_copresent"), "homonym_copresent").when(is_("gap_pay_shift"), "sequential_homonym_pay").when(is_("gap_return"), "sequential_homonym_gap").when(is_("gap_long") | is_("sporadic"), "intermittent")
        .when(F.coalesce("name_from_org_field", F.lit(False)), "org_field_name").when(is_("single_token_name"), "name_shape")
    )
    g = g.withColumns({"merge_risk": risk, "category": category})
    merge = ["dup_id_in_year", "id_spans_orgs", "homonym_copresent", "gap_return", "gap_long", "gap_pay_shift", "sporadic"]
    entity = ["org_as_person", "placeholder_name", "single_token_name", "name_from_org_field", "dup_line_in_filing"]
    out = g.select(
        "emp_id", "ein", "org_name", "category", F.col("category").isNotNull().alias("review_flag"), "merge_risk", "n_records", "n_years", "first_year", "last_year", "span", "density", "n_gaps", "max_gap",
        (F.col("n_gaps") + 1).alias("n_spells"), "pay_shift", *merge, *entity, F.array_join(F.array_sort("nms"), " | ").alias("names_seen"), F.array_join(F.array_sort("ts"), " | ").alias("titles_seen"),
    )
    rank = F.array_position(_constant(K.ANOMALY_CATEGORIES), F.col("category"))
    return out.orderBy(F.col("category").isNull(), rank, F.desc("merge_risk"), "emp_id")


def anomalies_report(flags: DataFrame) -> DataFrame:
    """One row: persons, flagged persons, and how many have each flag."""
    names = [*K.MERGE_WEIGHTS, "org_as_person", "placeholder_name", "single_token_name", "name_from_org_field", "dup_line_in_filing"]
    return flags.agg(F.count(F.lit(1)).alias("n_persons"), F.count(F.when(F.col("review_flag"), 1)).alias("n_flagged"), F.coalesce(F.sum("n_records"), F.lit(0)).alias("n_records"), *[F.count(F.when(F.col(n), 1)).alias(n) for n in names])


def anomaly_review_queue(flags: DataFrame, include_entity: bool = True) -> DataFrame:
    kept = ["invariant_violation", "homonym_copresent", "sequential_homonym_pay", "sequential_homonym_gap", "intermittent"] + (["entity_not_person"] if include_entity else [])
    rank = F.array_position(_constant(K.ANOMALY_CATEGORIES), F.col("category"))
    return flags.where(F.col("category").isin(kept)).orderBy(rank, F.desc("merge_risk"), "emp_id")
