"""Pairs of records by signature: matched and counted an organization at a time, without a row for each pair.

Records of one organization with equal stable features have one signature; of these, those with one volatile value are a class, and any two
records of two classes score alike.  Work and memory follow classes that can match, not pairs of records.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panellink.functions.similarity import KERNELS
from panellink.operators.candidates import VOLATILE, _signed, match_comparators, spread_by_org, within_orgs
from panellink.operators.closure import EDGE
from panellink.sources.scratch import settled

#: Pairs of classes held at once; values of a volatile feature whose pairs are held as a matrix.
CHUNK, MATRIX = 1_000_000, 1500
#: Records of an organization from which each pair of years is a task of its own.
TASK_RECORDS = 200_000


def split_features(feats: list[str]) -> tuple[list[str], str | None]:
    """(stable features, the volatile one)."""
    return [f for f in feats if f not in VOLATILE], next((f for f in feats if f in VOLATILE), None)


def signatures(work: DataFrame, feats: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records: org, s, year, uid, v; pairs: org, s_x, s_y, surname weights, raw stable features and their similarities).

    ``s`` numbers the signatures of an organization, ``v`` is the volatile value.  Pairs are ordered, a signature with itself too, where x may be earlier.
    """
    stable, late = split_features(feats)
    signed = settled(_signed(work, feats, stable), "signed")
    sigs = signed.groupBy("sid").agg(F.first("org").alias("org"), F.first("surname_w").alias("surname_w"), F.min("year").alias("y0"), F.max("year").alias("y1"), *[F.first(f).alias(f) for f in stable])
    sigs = settled(sigs.withColumn("s", F.row_number().over(W.partitionBy("org").orderBy("sid"))), "signatures")
    v = F.col(late) if late else F.lit(None).cast("string")
    records = signed.select("sid", "org", "year", "uid", v.alias("v")).join(sigs.select("sid", "s"), "sid").drop("sid")
    spread = spread_by_org(sigs)
    side = lambda s: spread.select("org", "salts", *[F.col(c).alias(f"{c}_{s}") for c in ("s", "surname_w", "y0", "y1", *stable)])
    comparators = match_comparators(stable)
    p = within_orgs(side("x"), side("y"), "y0_x < y1_y")
    sims = [comparators[f](F.col(f"{f}_x"), F.col(f"{f}_y")).alias(f) for f in stable]
    return records, p.select("org", "s_x", "s_y", "surname_w_x", "surname_w_y", *[f"{f}_{s}" for f in stable for s in "xy"], *sims)


class _Late:
    """Similarities of pairs of values, each computed once."""

    def __init__(self, values: list):
        self.values, self.kernel = values, KERNELS["jaro"]
        k = len(values)
        self.held = np.full((k, k), -1.0) if k <= MATRIX else None

    def _compare(self, codes: np.ndarray) -> np.ndarray:
        i, j = np.divmod(codes, len(self.values))
        found = self.kernel([self.values[k] for k in i], [self.values[k] for k in j])
        return np.array([np.nan if s is None else s for s in found], float)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.held is None:
            codes, at = np.unique(x.astype(np.int64) * len(self.values) + y, return_inverse=True)
            return self._compare(codes)[at]
        out = self.held[x, y]
        new = np.flatnonzero(out == -1.0)
        if len(new):
            codes = np.unique(x[new].astype(np.int64) * len(self.values) + y[new])
            self.held.flat[codes] = self._compare(codes)
            out = self.held[x, y]
        return out


def _classes(s: np.ndarray, v: np.ndarray, n_s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class of each row, value of each class, first class and number of classes of each signature); classes are in order of s, v."""
    key, of = np.unique(np.stack([s, v]), axis=1, return_inverse=True)
    count = np.bincount(key[0], minlength=n_s)
    return of.ravel(), key[1], np.concatenate([[0], np.cumsum(count)[:-1]]), count


def _expanded(px: np.ndarray, py: np.ndarray, x, y) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, class x, class y) of all pairs of classes of the pairs of signatures, some CHUNK at a time."""
    (_, _, x0, nx), (_, _, y0, ny) = x, y
    size = nx[px] * ny[py]
    live = np.flatnonzero(size)
    ends = np.cumsum(size[live])
    at = 0
    while at < len(live):
        done = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, done + CHUNK, "right")), at + 1)
        part = live[at:to]
        k = size[part]
        p = np.repeat(part, k)
        off = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        i, j = np.divmod(off, ny[py[p]])
        yield p, x0[px[p]] + i, y0[py[p]] + j
        at = to


def match_classes(score: np.ndarray, a: np.ndarray, b: np.ndarray, xs: list, ys: list) -> list[tuple[int, int, float]]:
    """Greedy one-to-one matching of records, best score first, ties by x, then y.

    ``a`` and ``b`` are the classes of the scores, ``xs`` and ``ys`` their records in order.  A class gives its records in order, so a place in each is all that is kept.
    """
    order = np.argsort(-score, kind="stable")
    score, a, b = score[order], a[order], b[order]
    left, right = np.array([len(r) for r in xs]), np.array([len(r) for r in ys])
    at_x, at_y = [0] * len(xs), [0] * len(ys)
    out: list[tuple[int, int, float]] = []

    def take(i: int, j: int, s: float, n: int) -> None:
        p, q = at_x[i], at_y[j]
        out.extend((x, y, s) for x, y in zip(xs[i][p : p + n], ys[j][q : q + n]))
        at_x[i], at_y[j] = p + n, q + n
        left[i] -= n
        right[j] -= n

    at = 0
    while at < len(score):
        to = min(at + 8192, len(score))
        to = int(np.searchsorted(-score, -score[to - 1], "right"))  # whole levels
        live = at + np.flatnonzero((left[a[at:to]] > 0) & (right[b[at:to]] > 0))
        at = to
        starts = np.flatnonzero(np.diff(score[live], prepend=np.inf)).tolist() + [len(live)]
        pa, pb, ps = a[live].tolist(), b[live].tolist(), score[live].tolist()
        for lo, hi in zip(starts, starts[1:]):
            if hi - lo == 1:
                n = min(int(left[pa[lo]]), int(right[pb[lo]]))
                if n:
                    take(pa[lo], pb[lo], ps[lo], n)
                continue
            partners: dict[int, list[int]] = {}
            for k in range(lo, hi):
                if left[pa[k]] and right[pb[k]]:
                    partners.setdefault(pa[k], []).append(pb[k])
            heap = [(xs[i][at_x[i]], i) for i in partners]
            heapq.heapify(heap)
            while heap:
                _, i = heapq.heappop(heap)
                free = [j for j in partners[i] if right[j]]
                if free:
                    partners[i] = free
                    take(i, min(free, key=lambda j: ys[j][at_y[j]]), ps[lo], 1)
                    if left[i]:
                        heapq.heappush(heap, (xs[i][at_x[i]], i))
    return out


def match_signatures(records: DataFrame, pairs: DataFrame, part: Callable[[np.ndarray], np.ndarray], finish: Callable[[np.ndarray], np.ndarray], threshold: float) -> DataFrame:
    """The edges that a greedy scan accepts in each organization and pair of years: one partner for a record and a year.

    ``pairs`` has org, s_x, s_y and ``base``, with all that can reach the threshold; a pair of records scores finish(base + part(similarity of
    the volatile values)).  The same edges as by scoring and sorting all pairs of records.
    """

    def match(key: tuple, r: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values("uid", kind="stable")
        uid, year, s = r["uid"].to_numpy(), r["year"].to_numpy(), r["s"].to_numpy()
        v, values = pd.factorize(r["v"], use_na_sentinel=False)
        late = _Late([None if x is None or x != x else x for x in values])
        px, py, base = p["s_x"].to_numpy(), p["s_y"].to_numpy(), p["base"].to_numpy()
        n_s = int(max(s.max(initial=0), px.max(initial=0), py.max(initial=0))) + 1
        of = {y: np.flatnonzero(year == y) for y in sorted(set(year.tolist()))}
        classes = {y: _classes(s[at], v[at], n_s) for y, at in of.items()}
        members = {y: np.split(at[np.argsort(c[0], kind="stable")], np.cumsum(np.bincount(c[0]))[:-1]) for (y, at), c in zip(of.items(), classes.values())}
        found = []
        for yx in of:
            for yy in of:
                if yx >= yy or key[1] not in ("", f"{yx}>{yy}"):
                    continue
                x, y = classes[yx], classes[yy]
                kept = []
                for q, i, j in _expanded(px, py, x, y):
                    score = finish(base[q] + part(late(x[1][i], y[1][j])))
                    ok = score >= threshold
                    kept.append((score[ok], i[ok], j[ok]))
                if kept:
                    score, i, j = map(np.concatenate, zip(*kept))
                    found += [(yx, yy, *e) for e in match_classes(score, i, j, [m.tolist() for m in members[yx]], [m.tolist() for m in members[yy]])]
        e = pd.DataFrame(found, columns=["yr_x", "yr_y", "x", "y", "score"])
        rows = lambda c: pd.Series(uid[e[c].to_numpy(int)] if len(e) else [], dtype=object)
        out = pd.DataFrame({"org": key[0], "yr_x": e["yr_x"], "yr_y": e["yr_y"], "row_x": rows("x"), "row_y": rows("y"), "score": e["score"].astype(float)})
        return out.astype({"yr_x": "int32", "yr_y": "int32"})

    sizes = records.groupBy("org").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("year")).alias("ys"))
    every = F.flatten(F.transform("ys", lambda x: F.transform(F.filter("ys", lambda y: y > x), lambda y: F.concat_ws(">", x.cast("string"), y.cast("string")))))
    parts = settled(sizes.select("org", F.explode(F.when(F.col("n") > TASK_RECORDS, every).otherwise(F.array(F.lit("")))).alias("part")), "parts")
    mine = (F.col("part") == "") | F.array_contains(F.split("part", ">"), F.col("year").cast("string"))
    n = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * records.sparkSession.sparkContext.defaultParallelism)
    left = records.join(parts, "org").where(mine).repartition(n, "org", "part")
    right = pairs.select("org", "s_x", "s_y", "base").join(parts, "org").toDF("_org", "s_x", "s_y", "base", "_part").repartition(n, "_org", "_part")
    return left.groupBy("org", "part").cogroup(right.groupBy("_org", "_part")).applyInPandas(match, EDGE)


def counted_pairs(records: DataFrame, pairs: DataFrame, by: list[str], late: str, of: Callable[[dict, np.ndarray], np.ndarray]) -> DataFrame:
    """(*by, ``late``, n): the pairs of records from an earlier and a later year, counted by columns of their pair of signatures and a value of(columns, similarity of the volatile values)."""
    sums = records.groupBy("org", "s", "v", "year").agg(F.count(F.lit(1)).alias("n"))
    numbers = [c for c in pairs.columns if c not in ("org", "s_x", "s_y")]

    def count(r: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        v, values = pd.factorize(r["v"], use_na_sentinel=False)
        lates = _Late([None if x is None or x != x else x for x in values])
        px, py = p["s_x"].to_numpy(), p["s_y"].to_numpy()
        s = r["s"].to_numpy()
        n_s = int(max(s.max(initial=0), px.max(initial=0), py.max(initial=0))) + 1
        c = _classes(s, v, n_s)
        y, years = pd.factorize(r["year"], sort=True)
        n = np.zeros((len(c[1]), len(years)))
        np.add.at(n, (c[0], y), r["n"].to_numpy())
        before = np.cumsum(n, axis=1) - n
        columns = {k: p[k].to_numpy(float) for k in numbers}
        totals: list[pd.DataFrame] = []
        for q, i, j in _expanded(px, py, c, c) if len(r) else ():
            held = np.einsum("ij,ij->i", before[i], n[j])
            ok = held > 0
            q, i, j = q[ok], i[ok], j[ok]
            at = {k: x[q] for k, x in columns.items()}
            d = pd.DataFrame({**{k: at[k] for k in by}, late: of(at, lates(c[1][i], c[1][j])), "n": held[ok]})
            totals.append(d.groupby([*by, late], dropna=False, as_index=False, sort=False)["n"].sum())
        if not totals:
            return pd.DataFrame({k: pd.Series(dtype=float) for k in (*by, late, "n")}).astype({"n": "int64"})
        return pd.concat(totals).groupby([*by, late], dropna=False, as_index=False, sort=False)["n"].sum().astype({"n": "int64"})

    n = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * records.sparkSession.sparkContext.defaultParallelism)
    right = pairs.select(F.col("org").alias("_org"), *[F.col(c).alias(c) for c in pairs.columns if c != "org"])
    grouped = sums.repartition(n, "org").groupBy("org").cogroup(right.repartition(n, "_org").groupBy("_org"))
    found = grouped.applyInPandas(count, ", ".join(f"{c} double" for c in (*by, late)) + ", n long")
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in (*by, late)]
    return found.select(*clean, "n").groupBy(*by, late).agg(F.sum("n").alias("n"))


def rounded(score: np.ndarray) -> np.ndarray:
    """To 12 digits, so that the noise of sums can't break ties."""
    return np.round(score, 12)


def weighed(weight: float) -> Callable[[np.ndarray], np.ndarray]:
    """A volatile feature's part of a score; missing values 0."""
    return lambda sim: np.nan_to_num(weight * (2 * sim - 1), nan=0.0)


def stored_pairs(pairs: DataFrame, *columns: Column | str) -> DataFrame:
    return settled(pairs.select("org", "s_x", "s_y", *columns), "signature-pairs")
