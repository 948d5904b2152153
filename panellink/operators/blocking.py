"""Blocking of persons across organizations: an inverted index of relaxing keys, and its pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panellink.functions.constants import BLOCKING_PASSES, MAX_BLOCK_SIZE
from panellink.sources.scratch import settled

#: Rows of a block's left side in one part of its pairs.
BLOCK_ROWS = 1000
_SETS = {"last": "last_name_keys", "state": "states", "cbsa": "cbsa", "ntee": "ntee"}


def blocking_passes() -> dict[str, tuple[str, ...]]:
    return dict(BLOCKING_PASSES)


def pass_rank(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, p in enumerate(BLOCKING_PASSES, 1):
        out = F.when(name == p, F.lit(k)).otherwise(out)
    return out


def person_blocking_keys(profiles: DataFrame, passes: list[str] | None = None, ntee_digits: int = 1) -> DataFrame:
    """(EMP_ID, pass, block_key): for each pass, all combinations of the sets that it names; an empty set gives no key."""
    passes = list(passes or BLOCKING_PASSES)
    bad = [p for p in passes if p not in BLOCKING_PASSES]
    if bad:
        raise ValueError(f"person_blocking_keys: unknown pass(es): {', '.join(bad)}")

    def members(part: str) -> Column:
        if _SETS[part] not in profiles.columns:
            return F.array().cast("array<string>")
        found = F.filter(_SETS[part], lambda x: x.isNotNull() & (x != ""))
        return F.array_distinct(F.transform(found, lambda x: F.substring(x, 1, ntee_digits))) if part == "ntee" else found

    def crossed(grid: Column, values: Column) -> Column:
        return F.flatten(F.transform(grid, lambda g: F.transform(values, lambda x: F.concat(g, F.lit("|"), x))))

    def keys(name: str) -> Column:
        grid = F.array(F.lit(name))
        for part in BLOCKING_PASSES[name]:
            grid = crossed(grid, members(part))
        return F.transform(grid, lambda k: F.struct(F.lit(name).alias("pass"), k.alias("block_key")))

    every = F.array_distinct(F.concat(*map(keys, passes)))
    return profiles.select("EMP_ID", F.explode(every).alias("k")).select("EMP_ID", "k.pass", "k.block_key")


def block_sizes(keys: DataFrame) -> DataFrame:
    """(pass, block_key, n): distinct persons of each block."""
    return keys.groupBy("pass", "block_key").agg(F.countDistinct("EMP_ID").alias("n"))


def first_org(profiles: DataFrame) -> DataFrame:
    return profiles.select("EMP_ID", F.get("orgs", F.lit(0)).alias("org"))


def candidate_pairs(keys: DataFrame, profiles: DataFrame, max_block_size: int = MAX_BLOCK_SIZE, carried: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, dropped blocks).  Pairs of different organizations that share a block of 2 to ``max_block_size`` persons.

    Pairs have emp_a < emp_b, their tightest pass and the number of blocks they share.  Blocks over the limit, which is
    the caller's, are returned with their sizes and give no pairs.  Block sizes are counted before anything is joined.

    A pair is made in each block that it shares, and kept in the first of them: pairs are never shuffled.  ``carried`` has an EMP_ID
    and columns that both sides of a pair take along (``<column>_a``, ``<column>_b``), so that nothing has to be joined to pairs.
    """
    sizes = block_sizes(keys)
    # numbers of blocks that order them by pass
    number = F.shiftleft(pass_rank(F.col("pass")).cast("long"), 56) + F.monotonically_increasing_id()
    blocks = settled(sizes.where(F.col("n").between(2, max_block_size)).select("pass", "block_key", number.alias("block"), F.ceil(F.col("n") / BLOCK_ROWS).cast("long").alias("salts")), "blocks")
    m = keys.distinct().join(blocks, ["pass", "block_key"]).groupBy("EMP_ID").agg(F.sort_array(F.collect_list(F.struct("block", "salts"))).alias("held"))
    m = m.join(first_org(profiles).where("org IS NOT NULL"), "EMP_ID")
    taken = [c for c in carried.columns if c != "EMP_ID"] if carried is not None else []
    m = m.join(carried, "EMP_ID") if carried is not None else m
    m = settled(m, "blocked")
    # by number, not by bytes: the pairs of a block are many more than its keys
    n = max(int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * m.sparkSession.sparkContext.defaultParallelism)
    side = lambda s: m.select(F.col("EMP_ID").alias(f"emp_{s}"), F.col("org").alias(f"org_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in taken], F.col("held.block").alias(f"held_{s}"), F.explode("held").alias("b")).select("*", F.col("b.block").alias(f"block_{s}"), "b.salts").drop("b")
    a = side("a").withColumn("salt_a", F.pmod(F.xxhash64("emp_a"), F.col("salts"))).drop("salts").repartition(n, "block_a", "salt_a")
    b = side("b").withColumn("salt_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts").repartition(n, "block_b", "salt_b")
    j = a.join(b, F.expr("block_a = block_b AND salt_a = salt_b AND emp_a < emp_b AND org_a <> org_b"))
    j = j.withColumn("shared", F.array_intersect("held_a", "held_b")).where(F.get("shared", F.lit(0)) == F.col("block_a"))
    rank = F.shiftright("block_a", 56).cast("int")
    named = reduce(lambda out, kv: F.when(rank == kv[0], F.lit(kv[1])).otherwise(out), enumerate(BLOCKING_PASSES, 1), F.lit(None).cast("string"))
    dropped = sizes.where(F.col("n") > max_block_size).select("block_key", "pass", "n")
    along = [f"{c}_{s}" for c in (["org", *taken] if taken else []) for s in "ab"]
    return j.select("emp_a", "emp_b", named.alias("pass"), rank.alias("pass_rank"), F.size("shared").alias("n_shared_buckets"), *along), dropped


def block_census(keys: DataFrame, max_block_size: int = MAX_BLOCK_SIZE) -> DataFrame:
    """Blocks, memberships, comparisons, dropped blocks and persons reached, for each pass and for all (pass ALL)."""
    pairs = F.col("n").cast("double") * (F.col("n") - 1) / 2
    over = F.col("n") > max_block_size
    usable = F.col("n").between(2, max_block_size)
    sizes = block_sizes(keys)
    s = sizes.rollup("pass").agg(
        F.sum((F.col("n") >= 2).cast("long")).alias("blocks"), F.sum("n").alias("memberships"), F.coalesce(F.sum(F.when(usable, pairs)), F.lit(0.0)).alias("comparisons"),
        F.sum(over.cast("long")).alias("dropped_blocks"), F.coalesce(F.sum(F.when(over, F.col("n"))), F.lit(0)).alias("dropped_memberships"),
        F.coalesce(F.sum(F.when(over, pairs)), F.lit(0.0)).alias("dropped_comparisons"), F.max("n").alias("largest_block"),
    )
    reached = keys.join(sizes.where(usable).drop("n"), ["pass", "block_key"]).select("pass", "EMP_ID").distinct()
    people = reached.rollup("pass").agg(F.countDistinct("EMP_ID").alias("people"))
    persons = keys.agg(F.countDistinct("EMP_ID").alias("persons"))
    name = F.coalesce("pass", F.lit("ALL")).alias("pass")
    out = s.select(name, *s.columns[1:]).join(people.select(name, "people"), "pass", "left").crossJoin(persons)  # one row
    return out.withColumn("people", F.coalesce("people", F.lit(0))).withColumn("people_share", F.round(F.col("people") / F.col("persons"), 4))


def same_org_candidate_pairs(existing: DataFrame, wave: DataFrame, max_block_size: int | None = None, carried: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs emp_a of ``existing`` and emp_b of ``wave``, dropped buckets): they share an organization and a surname code.

    All pairs, unless the caller sets a limit: then a bucket is dropped if the product of its sides is over it.  A pair is kept in the first bucket that
    it shares; ``carried`` has columns by EMP_ID that both sides take along, with the organization.
    """
    def buckets(p: DataFrame, emp: str) -> DataFrame:
        d = p.select(F.col("EMP_ID").alias(emp), F.get("orgs", F.lit(0)).alias("org"), F.explode(F.filter("last_name_keys", lambda k: k != "")).alias("key"))
        return d.where("org IS NOT NULL").withColumn("bucket", F.concat_ws("|", "org", "key")).distinct()

    e, w = buckets(existing, "emp_a"), buckets(wave, "emp_b")
    n = e.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_existing")).join(w.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_wave")), "bucket")
    fits = F.lit(True) if max_block_size is None else F.col("n_existing") * F.col("n_wave") <= max_block_size
    used = settled(n.where(fits).select("bucket", F.ceil(F.col("n_existing") / BLOCK_ROWS).cast("long").alias("salts")), "buckets")
    taken = [c for c in carried.columns if c != "EMP_ID"] if carried is not None else []

    def side(d: DataFrame, s: str) -> DataFrame:
        held = d.join(used, "bucket").groupBy(f"emp_{s}", "org").agg(F.sort_array(F.collect_list(F.struct("bucket", "salts"))).alias("held"))
        held = held.join(carried.withColumnRenamed("EMP_ID", f"emp_{s}"), f"emp_{s}") if carried is not None else held
        x = held.select(f"emp_{s}", F.col("org").alias(f"org_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in taken], F.col("held.bucket").alias(f"held_{s}"), F.explode("held").alias("k"))
        return x.select("*", F.col("k.bucket").alias(f"bucket_{s}"), "k.salts").drop("k")

    spark = existing.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    a = side(e, "a").withColumn("salt_a", F.pmod(F.xxhash64("emp_a"), F.col("salts"))).drop("salts").repartition(parts, "bucket_a", "salt_a")
    b = side(w, "b").withColumn("salt_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts").repartition(parts, "bucket_b", "salt_b")
    j = a.join(b, F.expr("bucket_a = bucket_b AND salt_a = salt_b")).where(F.get(F.array_intersect("held_a", "held_b"), F.lit(0)) == F.col("bucket_a"))
    along = [F.col("org_a").alias("org"), *[f"{c}_{s}" for c in taken for s in "ab"]] if taken else []
    return j.select("emp_a", "emp_b", *along), n.where(~fits)
