"""Mix sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panellink.llm.common import carried, col_of, numbered, returned, row_hash, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Offsets that a source can have, and how many of them are tried in each of two rounds.
OFFSETS, STEP = 4096, 64


def cyclic_weight(rank: Column) -> Column:
    """Weights 5, 2, 1, repeating with the 0-based rank of a source."""
    return F.element_at(F.array(F.lit(5.0), F.lit(2.0), F.lit(1.0)), (rank % 3 + 1).cast("int"))


def source_targets(sizes: DataFrame, weight=cyclic_weight, max_repeats: float = 3.0, budget: float = 1.0) -> DataFrame:
    """Targets of sources: weight shares of ``budget`` times all sizes, none above ``max_repeats`` times its source.

    ``sizes`` has (source, source_size), one row for each source.  Sources are ranked by code point, null last.
    What a capped source can't take is reshared by weight: with sources in the order of cap / weight, the shared
    level is (rest of the budget) / (rest of the weight) at the first source whose cap isn't below it.
    """
    one = W.partitionBy(F.lit(1))  # one row for each source
    order = one.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("w", weight(F.row_number().over(order) - 1))
    ratio = F.lit(max_repeats) * F.col("source_size") / F.col("w")
    passed = one.orderBy(ratio, F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    size = F.col("source_size").cast("double")
    levels = (
        ranked.withColumn("ratio", ratio)
        .withColumn("left_w", F.sum("w").over(one) - F.coalesce(F.sum("w").over(passed), F.lit(0.0)))
        .withColumn("left_size", F.lit(budget) * F.sum(size).over(one) - F.lit(max_repeats) * F.coalesce(F.sum(size).over(passed), F.lit(0.0)))
        .withColumn("level", F.col("left_size") / F.col("left_w"))
        .withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(one)["level"])
    )
    cap = F.lit(max_repeats) * size
    return levels.select("source", "source_size", F.least(cap, F.coalesce(F.col("level") * F.col("w"), cap)).alias("target"))


def _crossed(prior: Column, rate: Column, offset: Column) -> Column:
    """Integers up to the running sum of expected copies after ``prior`` documents of a source."""
    return F.floor(prior * rate + offset)


def nearest_offsets(cells: DataFrame) -> DataFrame:
    """(s, none, k): for each source, the offset (k + jitter) / OFFSETS whose mix comes nearest to the target.

    ``cells`` has (s, none, size, before, n, rate, target, jitter): the documents of one size, and how many larger ones stand before
    them.  As larger documents come first, a source's words grow with its offset, so the last offset that doesn't pass
    the target is found in two rounds of STEP offsets, and it or the next one is taken.
    """
    key = ["s", "none"]

    def words(c: DataFrame) -> DataFrame:
        u = (F.col("k") + F.col("jitter")) / OFFSETS
        copies = _crossed(F.col("before") + F.col("n"), F.col("rate"), u) - _crossed(F.col("before"), F.col("rate"), u)
        return c.groupBy(*key, "target", "k").agg(F.sum(copies * F.col("size")).alias("words"))

    below = F.col("words") <= F.col("target")
    coarse = words(cells.withColumn("k", F.explode(F.expr(f"sequence(0, {OFFSETS - STEP}, {STEP})"))))
    coarse = coarse.groupBy(*key).agg(F.coalesce(F.max(F.when(below, F.col("k"))), F.lit(0)).alias("from"))
    fine = words(cells.join(coarse, key).withColumn("k", F.explode(F.expr(f"sequence(from, least(from + {STEP}, {OFFSETS - 1}))"))))
    ends = fine.groupBy(*key, "target").agg(F.max(F.when(below, F.col("k"))).alias("low"), F.max(F.when(below, F.col("words"))).alias("low_words"), F.min(F.when(~below, F.col("words"))).alias("high_words"))
    higher = F.col("high_words") - F.col("target") < F.col("target") - F.col("low_words")
    return ends.select(*key, F.when(F.col("low").isNull(), 0).when(F.coalesce(higher, F.lit(False)), F.col("low") + 1).otherwise(F.col("low")).alias("k"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weight=cyclic_weight,
    max_repeats: float = 3.0, budget: float = 1.0, seed: str = "mix", carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each document: doc_id, source, size (words), source_size, target, expected, copies, taken, ``carry``.

    Within a source, documents are ordered by size (largest first) and then by a digest of their id and text.  A document's
    expected copies are target / source_size; it is emitted once for each integer that the running sum of
    expected copies, plus one offset for the source, crosses.  So copies are the floor or the ceiling of the expectation.  The
    offset is drawn with a jitter from ``seed`` and the source, from those (one in OFFSETS) whose mix comes nearest to the target;
    what then misses it is at most one step between neighbouring sizes, or a document of a source that has few.

    Null text has size 0; null sources are one source, last.  Documents of a source without words are not taken.
    Repeated rows are documents of their own; equal ones are interchangeable.  Empty input gives an empty result.  Other columns
    don't matter, whatever their names, unless named in ``carry``.
    """
    doc_id, text = col_of(docs, id_col), col_of(docs, text_col)
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select(doc_id.alias("doc_id"), col_of(docs, source_col).cast("string").alias("source"), size.alias("size"), row_hash(doc_id, text).alias("h"), *carried(docs, carry))
    d = d.withColumns({"s": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()})
    if not carry:
        d = stored(d, "mix-sizes")
    cells = stored(d.groupBy("s", "none", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")  # a row for each source and size
    n_rows = cells.agg(F.sum("n")).first()[0] or 0
    targets = source_targets(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weight, max_repeats, budget)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(max_repeats))).otherwise(F.lit(0.0))
    jitter = F.conv(F.substring(F.md5(F.concat_ws("\x00", F.lit(seed), "s").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    targets = targets.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), "source_size", "target").withColumns({"rate": rate, "jitter": jitter})
    larger = W.partitionBy("s", "none").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    per = cells.select("s", "none", "size", "n", F.coalesce(F.sum("n").over(larger), F.lit(0)).alias("before")).join(targets, ["s", "none"])
    per = stored(per, "mix-expected")
    per = per.join(nearest_offsets(per), ["s", "none"]).withColumn("u", (F.col("k") + F.col("jitter")) / OFFSETS).drop("n", "k", "jitter")
    rows = numbered(d, ["s", "none", "size"], "h", ["doc_id"], n_rows, "at", stored(per, "mix-offsets"))
    prior = F.col("before") + F.col("at")
    copies = (_crossed(prior + 1, F.col("rate"), F.col("u")) - _crossed(prior, F.col("rate"), F.col("u"))).cast("long")
    return rows.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", F.col("rate").alias("expected"), "copies", (F.col("copies") * F.col("size")).alias("taken"), *returned(carry))


def op1_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


#: The same mix in one process: prefix sums by plain windows, all offsets tried.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(0) || md5(coalesce(text, ''))) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM s),
o AS (
  SELECT *, 3.0::DOUBLE * source_size / w AS ratio,
    (SELECT sum(w) FROM w) - coalesce(sum(w) OVER prior, 0) AS left_w,
    (SELECT sum(source_size)::DOUBLE FROM w) - 3.0::DOUBLE * coalesce(sum(source_size::DOUBLE) OVER prior, 0) AS left_size
  FROM w WINDOW prior AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(left_size / left_w, ratio) AS level FROM o WHERE ratio >= left_size / left_w),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, coalesce(level * w, 3.0::DOUBLE * source_size)) AS target FROM w, l),
p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0 END AS e,
    CAST('0x' || substr(md5('mix' || chr(0) || coalesce(d.source, '')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS j,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.h, d.doc_id) - 1 AS r
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT source, size, any_value(target) AS target, any_value(e) AS e, any_value(j) AS j, min(r) AS r0, max(r) + 1 AS r1 FROM p GROUP BY source, size),
k AS (
  SELECT source, any_value(target) AS target, k, sum(size * CAST(floor(r1 * e + (k + j) / 4096) - floor(r0 * e + (k + j) / 4096) AS BIGINT)) AS words
  FROM c, LATERAL (SELECT unnest(range(0, 4096)) AS k) GROUP BY source, k),
b AS (SELECT source, any_value(target) AS target, max(k) FILTER (words <= target) AS low, max(words) FILTER (words <= target) AS lw, min(words) FILTER (words > target) AS hw FROM k GROUP BY source),
u AS (SELECT source, CASE WHEN low IS NULL THEN 0 WHEN coalesce(hw - target < target - lw, false) THEN low + 1 ELSE low END AS k FROM b),
q AS (SELECT p.*, (u.k + p.j) / 4096 AS u FROM p JOIN u ON p.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target,
  CAST(floor((r + 1) * e + u) - floor(r * e + u) AS BIGINT) * size AS taken,
  CAST(floor((r + 1) * e + u) - floor(r * e + u) AS BIGINT) AS copies
FROM q
"""
