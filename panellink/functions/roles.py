"""Coarse roles of titles and the position predicate."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panellink.functions import constants as K
from panellink.functions.normalize import column, squished
from panellink.functions.similarity import best_similarity


def title_role_rules() -> dict[str, str]:
    """Regular expressions of the roles, in the order in which they are tried."""
    bases = K.GOVERNANCE_BASES.replace("-", r"\-")
    return {"BOARD": f"^(({K.GOVERNANCE_MODIFIERS}) )*({bases})$", "OFFICER": K.OFFICER_PATTERN, "STAFF": K.STAFF_PATTERN}


def classify_title_role(title: Column, overrides: dict[str, str] | None = None) -> Column:
    """BOARD, OFFICER, STAFF or OTHER; null for a missing title.  ``overrides`` (title to role) go first."""
    norm = squished(title)
    out = F.lit("OTHER")
    for role, pattern in reversed(title_role_rules().items()):
        out = F.when(norm.rlike(pattern), F.lit(role)).otherwise(out)
    for name, role in (overrides or {}).items():
        if role.upper() not in K.ROLES:
            raise ValueError(f"override role not in {'/'.join(K.ROLES)}: {role}")
        out = F.when(norm == re.sub(r"\s+", " ", name.strip().upper()), F.lit(role.upper())).otherwise(out)
    return F.when(norm.isNotNull(), out)


def role_rank(role: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in K.ROLE_RANKS.items():
        out = F.when(role == name, F.lit(rank)).otherwise(out)
    return out


def title_role_coverage(df: DataFrame, title: str = "title_standard", overrides: dict[str, str] | None = None) -> DataFrame:
    """(title, n, role) for each distinct normalised title, most frequent first."""
    t = df.select(squished(column(df, title)).alias("title")).where("title IS NOT NULL").groupBy("title").agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("role", classify_title_role(F.col("title"), overrides)).orderBy(F.desc("n"), "title")


def match_position(title: Column, position: list[str] | str | None = None, role: list[str] | str | None = None, match: str = "exact", min_sim: float = 0.90, overrides: dict[str, str] | None = None) -> Column:
    """True where the title is one of ``position`` ('exact', 'regex' or 'fuzzy') or its role one of ``role``."""
    positions = [position] if isinstance(position, str) else list(position or [])
    roles = [role] if isinstance(role, str) else list(role or [])
    if not positions and not roles:
        raise ValueError("give a position and/or a role")
    norm = squished(title)
    out = F.lit(False)
    if roles:
        out = out | F.coalesce(classify_title_role(title, overrides).isin([r.strip().upper() for r in roles]), F.lit(False))
    wanted = [p for p in (re.sub(r"\s+", " ", p.strip().upper()) for p in positions) if p]
    if wanted and match == "exact":
        out = out | norm.isin(wanted)
    elif wanted and match == "regex":
        out = out | norm.rlike("|".join(wanted))
    elif wanted and match == "fuzzy":
        out = out | (F.coalesce(best_similarity("jaro", F.array(norm), F.array(*map(F.lit, wanted))), F.lit(0.0)) >= min_sim)
    elif match not in ("exact", "regex", "fuzzy"):
        raise ValueError(f"unknown match {match!r}")
    return F.coalesce(norm.isNotNull() & out, F.lit(False))
