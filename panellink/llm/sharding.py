"""Shards of near equal bytes by a minimax contiguous partition of text groups."""

from __future__ import annotations

import bisect
from functools import reduce
from itertools import accumulate
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panellink.llm.common import carried, col_of, numbered, returned, stored

#: Hex digits of the first units' digest prefixes, and by how many a unit's prefix grows where a cut may fall inside it.
UNIT_DIGITS, FINER = 4, 2


def feasible_cuts(ends: list[int], shards: int, capacity: int) -> list[int] | None:
    """Greedy check: ends of at most ``shards`` runs of units that each sum to ``capacity`` or less, or None."""
    cuts, at, start = [], 0, 0
    for _ in range(shards):
        at = bisect.bisect_right(ends, start + capacity, lo=at)
        cuts.append(at)
        if at == len(ends):
            return cuts + [at] * (shards - len(cuts))
        start = ends[at - 1] if at else 0
    return None


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity of ``shards`` contiguous runs over ``sizes``, and the run ends at it."""
    ends = list(accumulate(sizes))
    low, high = max(max(sizes, default=0), -(-(ends[-1] if ends else 0) // shards)), ends[-1] if ends else 0
    while low < high:
        mid = (low + high) // 2
        if feasible_cuts(ends, shards, mid) is None:
            low = mid + 1
        else:
            high = mid
    return low, feasible_cuts(ends, shards, low) or [0] * shards


def _reach(ends: list[int], single: list[bool], shards: int, capacity: int) -> list[int]:
    """Positions of greedy cuts if units of several groups could be cut anywhere: none is before the cut over the groups themselves."""
    out, at = [], 0
    for _ in range(shards):
        at = min(at + capacity, ends[-1])
        i = bisect.bisect_right(ends, at)
        if i < len(ends) and single[i]:
            at = ends[i - 1] if i else 0
        out.append(at)
    return out


def open_units(sizes: list[int], single: list[bool], shards: int, largest: int) -> list[int]:
    """Units of several groups inside which a cut at the smallest capacity over the groups may fall.

    That capacity lies between the smallest one if units of several groups could be cut anywhere (``low``) and the one if none
    could (``high``); each cut lies between greedy cuts of whole units at ``low`` and ``_reach`` at ``high``.
    """
    ends = list(accumulate(sizes))
    if not ends:
        return []
    high, _ = minimax_cuts(sizes, shards)
    low, up = max(largest, -(-ends[-1] // shards)), high
    while low < up:
        mid = (low + up) // 2
        if _reach(ends, single, shards, mid)[-1] < ends[-1]:
            low = mid + 1
        else:
            up = mid
    found, first = set(), 0
    for last in _reach(ends, single, shards, high):
        i = bisect.bisect_right(ends, first + low)
        first = ends[i - 1] if i and ends[i - 1] > first else first
        for j in range(bisect.bisect_right(ends, first), len(ends)):
            if ends[j] - sizes[j] >= last:
                break
            if not single[j]:
                found.add(j)
    return sorted(found)


def cut_digests(groups: DataFrame, shards: int) -> list[str | None]:
    """The digest prefixes with which the second and later shards start, None where no text is left.

    ``groups`` has (g, bytes), one row for each text digest.  The driver starts from the units of one prefix of UNIT_DIGITS hex digits
    (65,536 at most) and replaces only those that a cut may fall into by finer ones, until all such are single groups: then the
    cuts are those of the smallest capacity over the groups themselves.  Some hundred units are refined in a round, by 256 each,
    and rounds are as many as the logarithm of the groups, so what the driver holds is bounded at any scale.
    """
    unit = lambda n: F.substring("g", 1, n)
    totals = [F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("largest")]
    digits = UNIT_DIGITS
    units = {r["u"]: r for r in groups.groupBy(unit(digits).alias("u")).agg(*totals).collect()}  # 16 ** UNIT_DIGITS rows at most
    largest = max((r["largest"] for r in units.values()), default=0)
    while True:
        names = sorted(units)
        sizes, single = [units[u]["bytes"] for u in names], [units[u]["n"] == 1 for u in names]
        wide = [names[j] for j in open_units(sizes, single, shards, largest)]
        if not wide:
            break
        for length in sorted({len(u) for u in wide}):
            part = groups.sparkSession.createDataFrame([(u,) for u in wide if len(u) == length], "w string")
            inside = groups.join(F.broadcast(part), unit(length) == F.col("w"), "left_semi")  # some hundred rows
            finer = inside.groupBy(unit(length + FINER).alias("u")).agg(*totals).collect()  # 16 ** FINER for each of them at most
            units = {u: r for u, r in units.items() if u not in wide or len(u) != length} | {r["u"]: r for r in finer}
    _, cuts = minimax_cuts(sizes, shards)
    return [names[c] if c < len(names) else None for c in cuts[:-1]]


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shards: int = 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law 'bytes', shard, slot, grown_shard, ``carry``.

    Equal texts form groups, the atomic units; groups are ordered by the digest of their text.  The smallest capacity at which greedy
    filling needs no more than ``shards`` shards is binary-searched, and the order is cut there (``cut_digests``).  No group is
    ever cut.  Slots number the rows of a shard from 0 without gaps, in the order of a digest of id and text.

    Size is UTF-8 bytes plus 1; null text counts as empty (size 1, CRC 0, grouped with empty texts).  Repeated rows
    get slots of their own.  An empty table gives an empty result.  Other columns don't matter unless carried.
    """
    doc_id, text = col_of(docs, id_col), F.coalesce(col_of(docs, text_col), F.lit("")).cast("binary")
    crc = F.crc32(text)
    h = F.md5(F.concat_ws("\x00", F.coalesce(doc_id.cast("string"), F.lit("")), crc.cast("string")).cast("binary"))
    d = docs.select(doc_id.alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), crc.alias("text_crc32"), F.md5(text).alias("g"), h.alias("h"), *carried(docs, carry))
    if not carry:
        d = stored(d, "shard-rows")
    groups = stored(d.groupBy("g").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "shard-groups")
    n_rows = groups.agg(F.sum("rows")).first()[0] or 0
    after = [(F.col("g") >= F.lit(c)).cast("int") for c in cut_digests(groups, shards) if c is not None]
    placed = d.withColumn("shard", reduce(add, after, F.lit(0)))
    rows = numbered(placed, ["shard"], "h", ["doc_id", "size", "text_crc32"], n_rows, "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *returned(carry))


def op7_shard(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
