"""Candidate pairs within organizations, their field similarities and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panellink.functions.constants import DEFAULT_WEIGHTS
from panellink.functions.similarity import similarity
from panellink.operators.prepare import prepare_panel
from panellink.sources.panel import PanelCols
from panellink.sources.scratch import settled

EXACT = ("gender", "suffix", "salutation")
#: Features that vary between records of one name: compared only where the rest could reach the threshold.
VOLATILE = ("title_standard",)
#: Rows of an organization's left side in one part of its pairs.
SALT_ROWS = 1000
KEYS = ("row_x", "row_y", "yr_x", "yr_y", "org", "surname_w_x", "surname_w_y")


def default_weights() -> dict[str, float]:
    return dict(DEFAULT_WEIGHTS)


def cmp_exact(x: Column, y: Column) -> Column:
    return (x == y).cast("double")


def match_comparators(feats: list[str], first_name_comparator: bool = True) -> dict:
    """A column function for each feature; without ``first_name_comparator`` given names are compared by Jaro."""
    named = {"last_name": "last"} | ({"first_name": "first"} if first_name_comparator else {})
    return {f: cmp_exact if f in EXACT else (lambda x, y, k=named.get(f, "jaro"): similarity(k, x, y)) for f in feats}


def spread_by_org(df: DataFrame) -> DataFrame:
    """Add ``salts``: into how many parts an organization's pairs are cut, one for each SALT_ROWS of its rows."""
    n = df.groupBy(F.col("org").alias("_org")).agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    return df.join(n, F.col("org") == F.col("_org")).drop("_org")  # rows without an organization pair with none


def within_orgs(x: DataFrame, y: DataFrame, condition: str) -> DataFrame:
    """Join two frames with org and ``salts`` (columns otherwise distinct) on the organization and a condition.

    The left rows of an organization are dealt to its parts and the right ones are in all of them, so a huge
    organization is many tasks.  Partitions are set by number: the few bytes that go in would be gathered into one or two tasks,
    while their pairs are many.
    """
    spark = x.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    left = x.withColumn("salt", F.pmod(F.xxhash64(*[c for c in x.columns if c not in ("org", "salts")]), F.col("salts"))).drop("salts")
    right = y.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts").withColumnRenamed("org", "_org")
    joined = left.repartition(n, "org", "salt").join(right.repartition(n, "_org", "_salt"), F.expr(f"org = _org AND salt = _salt AND ({condition})"))
    return joined.drop("salt", "_salt", "_org")


def pairs_across_years(work: DataFrame, columns: list[str]) -> DataFrame:
    """All pairs of records of one organization from an earlier and a later year: one equi-join for all year pairs."""
    w = spread_by_org(work.select("org", "uid", "year", "surname_w", *columns))
    side = lambda s: w.select("org", "salts", *[F.col(c).alias(f"{c}_{s}") for c in ("uid", "year", "surname_w", *columns)])
    return within_orgs(side("x"), side("y"), "year_x < year_y")


def compared(work: DataFrame, feats: list[str], fields: list[str] = (), comparators: dict | None = None) -> DataFrame:
    """KEYS, one similarity for each feature and the raw ``fields`` of both sides."""
    comparators = comparators or match_comparators(feats)
    p = pairs_across_years(work, list(dict.fromkeys([*feats, *fields])))
    keys = [F.col("uid_x").alias("row_x"), F.col("uid_y").alias("row_y"), F.col("year_x").alias("yr_x"), F.col("year_y").alias("yr_y"), "org", "surname_w_x", "surname_w_y"]
    return p.select(*keys, *[comparators[f](F.col(f"{f}_x"), F.col(f"{f}_y")).alias(f) for f in feats], *[f"{f}_{s}" for f in fields for s in "xy"])


def score_pairs(sims: dict[str, Column], weights: dict[str, float], sw_x: Column, sw_y: Column, last_field: str = "last_name") -> Column:
    """Sum over features of weight * (2 * similarity - 1), missing ones 0.

    The surname's part is multiplied by the lesser weight of the two surnames where it speaks for a match, by the greater where
    it speaks against one.
    """
    total = F.lit(0.0)
    for f, w in weights.items():
        if f in sims:
            strength = 2 * sims[f] - 1
            part = F.lit(float(w)) * strength
            if f == last_field:
                part = F.lit(float(w)) * F.when(strength >= 0, F.least(sw_x, sw_y)).otherwise(F.greatest(sw_x, sw_y)) * strength
            total = total + F.coalesce(part, F.lit(0.0))
    return total


def scored(work: DataFrame, weights: dict[str, float], fields: list[str] = ()) -> DataFrame:
    """Candidates with their similarities and ``score``, rounded so that the noise of sums can't break ties."""
    feats = [f for f in weights if f in work.columns]
    c = compared(work, feats, fields)
    score = score_pairs({f: F.col(f) for f in feats}, weights, F.col("surname_w_x"), F.col("surname_w_y"))
    return c.withColumn("score", F.round(score, 12))


def _signed(work: DataFrame, feats: list[str], stable: list[str]) -> DataFrame:
    """Records with ``sid``, the digest of their organization and stable features: their signature."""
    sid = F.md5(F.concat_ws("\x00", *[F.coalesce(F.col(c), F.lit("\x01")) for c in ("org", *stable)]).cast("binary"))
    return work.where("org IS NOT NULL AND year IS NOT NULL").select(sid.alias("sid"), "org", "uid", "year", "surname_w", *feats)


def _signature_pairs(signed: DataFrame, stable: list[str], comparators: dict) -> DataFrame:
    """(org, sid_x, sid_y, surname_w_x, surname_w_y, similarities): pairs of signatures, a signature with itself too, of which x may be earlier."""
    sigs = spread_by_org(signed.groupBy("sid").agg(F.first("org").alias("org"), F.first("surname_w").alias("surname_w"), F.min("year").alias("y0"), F.max("year").alias("y1"), *[F.first(f).alias(f) for f in stable]))
    side = lambda s: sigs.select("org", "salts", *[F.col(c).alias(f"{c}_{s}") for c in ("sid", "surname_w", "y0", "y1", *stable)])
    p = within_orgs(side("x"), side("y"), "y0_x < y1_y")
    return p.select("org", "sid_x", "sid_y", "surname_w_x", "surname_w_y", *[comparators[f](F.col(f"{f}_x"), F.col(f"{f}_y")).alias(f) for f in stable])


def _records(signed: DataFrame, side: str, late: list[str] = ()) -> DataFrame:
    return signed.select(F.col("sid").alias(f"sid_{side}"), F.col("uid").alias(f"row_{side}"), F.col("year").alias(f"yr_{side}"), *[F.col(f).alias(f"{f}_{side}") for f in late])


def compared_signatures(work: DataFrame, feats: list[str]) -> tuple[DataFrame, DataFrame]:
    """(signed records, stored pairs of signatures with their similarities and ``n``, the pairs of records that they stand for).

    The counts are what a model of agreement patterns is fitted on: no pair of records is made for it.
    """
    signed = settled(_signed(work, feats, feats), "signed")
    pairs = settled(_signature_pairs(signed, feats, match_comparators(feats)), "signature-pairs")
    years = signed.groupBy("sid", "year").agg(F.count(F.lit(1)).alias("n"))
    side = lambda s: years.select(F.col("sid").alias(f"sid_{s}"), F.col("year").alias(f"yr_{s}"), F.col("n").alias(f"n_{s}"))
    n = pairs.select("sid_x", "sid_y").join(side("x"), "sid_x").join(side("y"), "sid_y").where("yr_x < yr_y").groupBy("sid_x", "sid_y").agg(F.sum(F.col("n_x") * F.col("n_y")).alias("n"))
    return signed, settled(pairs.join(n, ["sid_x", "sid_y"]), "counted-pairs")


def record_pairs(signed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(org, yr_x, yr_y, row_x, row_y, score): pairs of signatures with a score turned back into pairs of records."""
    r = pairs.select("org", "sid_x", "sid_y", "score").join(_records(signed, "x"), "sid_x").join(_records(signed, "y"), "sid_y").where("yr_x < yr_y")
    return r.select("org", "yr_x", "yr_y", "row_x", "row_y", "score")


def scored_above(work: DataFrame, weights: dict[str, float], threshold: float) -> DataFrame:
    """The candidates of ``scored`` that reach the threshold, without comparing every pair of records.

    Records of one organization with equal stable features form a signature; signatures are compared once.  Those
    whose score, with all that the volatile features could add, reaches the threshold are turned back into pairs of records,
    for which the volatile features are compared.
    """
    feats = [f for f in weights if f in work.columns]
    stable = [f for f in feats if f not in VOLATILE]
    late = [f for f in feats if f in VOLATILE]
    comparators = match_comparators(feats)
    work = _signed(work, feats, stable)
    p = _signature_pairs(work, stable, comparators)
    sw = (F.col("surname_w_x"), F.col("surname_w_y"))
    room = sum(abs(weights[f]) for f in late) + 1e-9
    p = p.where(score_pairs({f: F.col(f) for f in stable}, weights, *sw) >= threshold - room)
    r = p.join(_records(work, "x", late), "sid_x").join(_records(work, "y", late), "sid_y").where("yr_x < yr_y")
    r = r.withColumns({f: comparators[f](F.col(f"{f}_x"), F.col(f"{f}_y")) for f in late}) if late else r
    r = r.withColumn("score", F.round(score_pairs({f: F.col(f) for f in feats}, weights, *sw), 12))
    return r.where(F.col("score") >= threshold).select("org", "yr_x", "yr_y", "row_x", "row_y", "score")


def candidate_scores(df: DataFrame, cols: PanelCols | None = None, weights: dict[str, float] | None = None, fields: tuple[str, ...] = ("name", "first_name", "middle_name", "last_name", "suffix", "gender")) -> DataFrame:
    """Every candidate pair with its score and the raw fields of both sides, without a threshold."""
    _, work, _ = prepare_panel(df, cols)
    kept = [f for f in fields if f in work.columns]
    return scored(work, weights or default_weights(), kept).select("row_x", "row_y", "yr_x", "yr_y", "org", "score", "surname_w_x", "surname_w_y", *[f"{f}_{s}" for f in kept for s in "xy"])


def candidate_comparisons(df: DataFrame, cols: PanelCols | None = None, features: list[str] | None = None) -> DataFrame:
    """Every candidate pair with one similarity for each feature."""
    _, work, feats = prepare_panel(df, cols)
    return compared(work, [f for f in features if f in work.columns] if features else feats)
