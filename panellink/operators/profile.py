"""Person profiles: one row for each EMP_ID, with canonical values and the sets of variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panellink.functions.constants import SURNAME_PARTICLES, name_roots
from panellink.functions.normalize import as_year, column, known, letters, name_tokens, pick
from panellink.functions.roles import classify_title_role
from panellink.sources.panel import PanelCols


def as_set(values: Column) -> Column:
    """Sorted distinct non-empty values; empty, not null, where there are none."""
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))))


def modal(values: Column) -> Column:
    """The most frequent value of an array of strings; ties go to the longest, then to the first in order."""
    ranked = F.transform(F.array_distinct(values), lambda v: F.struct((-F.size(F.filter(values, lambda w: w == v))).alias("n"), (-F.length(v)).alias("l"), v.alias("v")))
    return F.array_min(ranked)["v"]


def formal_first(values: Column) -> Column:
    """The modal given name over those of more than one letter, over all if there are none."""
    full = F.filter(values, lambda v: F.length(v) > 1)
    return modal(F.when(F.size(full) > 0, full).otherwise(values))


def surname_blocking_keys(names: Column, particles: list[str] = SURNAME_PARTICLES, min_token: int = 2) -> Column:
    """Soundex codes of each whole surname and of its parts of ``min_token`` letters or more that aren't particles."""
    code = lambda v: F.when(v != "", F.soundex(v))
    whole = F.transform(names, lambda n: code(letters(n)))
    parts = F.filter(F.flatten(F.transform(names, name_tokens)), lambda t: (F.length(letters(t)) >= min_token) & ~t.isin(list(particles)))
    return as_set(F.concat(whole, F.transform(parts, lambda t: code(letters(t)))))


def first_name_roots(names: Column) -> Column:
    """The canonicals that an array of given names stand for; unknown names stand for themselves."""
    table = F.create_map(*[x for n, r in name_roots().items() for x in (F.lit(n), F.array(*map(F.lit, r)))])
    return as_set(F.flatten(F.transform(names, lambda n: F.coalesce(F.try_element_at(table, n), F.array(n)))))


def build_person_profile(df: DataFrame, cols: PanelCols | None = None, emp_id: str = "EMP_ID", title: str | None = "title_standard", state: str | None = None, cbsa: str | None = None, ntee: str | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """One row for each person.  A single aggregation gathers a person's records, which are few; the rest are expressions.

    Arrays are sorted and distinct; places appear only if their columns are named.  Where the panel has no
    surname column, the full name stands in.
    """
    cols = cols or PanelCols()
    if emp_id not in df.columns:
        raise ValueError(f"build_person_profile: no column {emp_id!r}; link the panel first")
    full = known(column(df, cols.name))
    has_title = pick(df, title) is not None
    values = {
        "last": known(column(df, "last_name")) if pick(df, "last_name") else full,
        "first": known(column(df, "first_name")),
        "middle": F.substring(known(column(df, "middle_name")), 1, 1),
        "suffix": known(column(df, "suffix")),
        "gender": known(column(df, "gender")),
        "full": full,
        "title": known(column(df, title)),
        "role": classify_title_role(column(df, title), overrides) if has_title else F.lit(None).cast("string"),
    }
    places = {k: c for k, c in {"states": state, "cbsa": cbsa, "ntee": ntee}.items() if c and pick(df, c)}
    values |= {f"p_{k}": known(column(df, c)) for k, c in places.items()}
    org = column(df, cols.org_id).cast("string")
    year = as_year(column(df, cols.year).cast("string"))
    anchored = "EMP_ANCHOR" in df.columns
    d = df.select(F.col(emp_id).cast("string").alias("EMP_ID"), org.alias("org"), year.alias("year"), *([F.col("EMP_ANCHOR")] if anchored else []), *[c.alias(f"v_{k}") for k, c in values.items()])
    g = d.groupBy("EMP_ID").agg(
        *([F.min("EMP_ANCHOR").alias("EMP_ANCHOR")] if anchored else []),
        F.count(F.lit(1)).cast("int").alias("n_records"), F.countDistinct(F.coalesce("org", F.lit("NA"))).cast("int").alias("n_orgs"),
        F.collect_set("org").alias("orgs"), F.collect_set("year").alias("years"), *[F.collect_list(f"v_{k}").alias(f"v_{k}") for k in values],
    )
    v = lambda k: F.filter(f"v_{k}", lambda x: x != "")
    lasts, firsts = as_set(F.col("v_last")), as_set(F.col("v_first"))
    columns = {
        "n_records": F.col("n_records"), "n_orgs": F.col("n_orgs"), "n_years": F.size("years"), "first_year": F.array_min("years"), "last_year": F.array_max("years"),
        "last_name": modal(v("last")), "last_name_variants": lasts, "last_name_keys": surname_blocking_keys(lasts),
        "first_name": formal_first(v("first")), "first_name_variants": firsts, "first_name_roots": first_name_roots(firsts), "first_initial": F.substring(formal_first(v("first")), 1, 1),
        "middle_initials": as_set(F.col("v_middle")), "suffixes": as_set(F.col("v_suffix")), "gender": modal(v("gender")), "name_variants": as_set(F.col("v_full")),
        "primary_role": modal(v("role")), "roles": as_set(F.col("v_role")), "is_board": F.array_contains("v_role", "BOARD") if has_title else F.lit(None).cast("boolean"),
        "titles": as_set(F.col("v_title")), "orgs": as_set(F.col("orgs")), "years": F.array_sort("years"), **{k: as_set(F.col(f"v_p_{k}")) for k in places},
    }
    return g.select("EMP_ID", *(["EMP_ANCHOR"] if anchored else []), *[c.alias(k) for k, c in columns.items()])
