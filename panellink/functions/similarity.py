"""Name similarity: vectorised kernels, and columns that call them through Arrow with memos.

Kernels take lists of distinct pairs.  The column functions hand a kernel each pair of values once for each task's
memo, so repeated pairs, which dominate blocked candidates, cost a dictionary lookup.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from panellink.functions.constants import nickname_table
from panellink.sources.scratch import settled

#: Pairs compared in one block of arrays; pairs that a task's memo holds.
BLOCK, MEMO = 4096, 500_000
#: Distinct values of a field of which all pairs are compared beforehand.
TABLE_VALUES = 500
FLOOR, RESCALE = 0.80, 0.5

_SOUNDEX = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230127022455012623017202"))
_NICKNAMES = {(c, v) for c, variants in nickname_table().items() for v in variants}


def jaro(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Jaro similarities, with half transpositions counted as such; two empty strings are alike.

    Block by block, character i of all left strings takes the first free equal character of its window at once.
    """
    out = np.empty(len(a))
    order = sorted(range(len(a)), key=lambda k: max(len(a[k]), len(b[k])))
    for k in range(0, len(a), BLOCK):
        at = order[k : k + BLOCK]
        out[at] = _jaro_block([a[i] for i in at], [b[i] for i in at])
    return out


def _codes(texts: list[str]) -> np.ndarray:
    width = max(1, max(map(len, texts)))
    return np.array(texts, f"U{width}").view(np.uint32).reshape(len(texts), width)


def _jaro_block(a: list[str], b: list[str]) -> np.ndarray:
    left, right = _codes(a), _codes(b)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[:, None]
    rows, place = np.arange(len(a)), np.arange(right.shape[1])
    free = place < lb[:, None]
    taken = np.zeros(left.shape, bool)
    for i in range(left.shape[1]):
        fits = free & (right == left[:, i : i + 1]) & (place >= i - window) & (place <= i + window) & (i < la)[:, None]
        j = fits.argmax(axis=1)
        hit = fits[rows, j]
        free[rows[hit], j[hit]] = False
        taken[hit, i] = True
    used = (place < lb[:, None]) & ~free
    m = taken.sum(axis=1)
    first = np.take_along_axis(left, np.argsort(~taken, axis=1, kind="stable"), axis=1)
    second = np.take_along_axis(right, np.argsort(~used, axis=1, kind="stable"), axis=1)
    k = min(first.shape[1], second.shape[1])
    t = ((first[:, :k] != second[:, :k]) & (np.arange(k) < m[:, None])).sum(axis=1) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = (m / la + m / lb + (m - t) / m) / 3
    return np.where((la == 0) & (lb == 0), 1.0, np.where(m == 0, 0.0, sim))


def _jaro_of(pairs: Iterable[tuple[str, str]]) -> dict[tuple[str, str], float]:
    """Jaro of distinct pairs; equal strings are 1 without a comparison."""
    out, rest = {}, []
    for p in dict.fromkeys(pairs):
        if p[0] == p[1]:
            out[p] = 1.0
        else:
            rest.append(p)
    return out | dict(zip(rest, jaro([p[0] for p in rest], [p[1] for p in rest]).tolist())) if rest else out


def name_parts(name: str | None) -> list[str]:
    return [t for t in re.split("[ -]", (name or "").strip(" \t\r\n").upper()) if t]


def _bare(name: str) -> str:
    return re.sub("[^A-Z0-9]", "", name.upper())


def compare_last(a: Sequence[str | None], b: Sequence[str | None], floor: float = FLOOR, rescale: float = RESCALE) -> list[float | None]:
    """Surname similarities: the better of whole-string Jaro and the coverage of the shorter name by token pairs.

    Token pairs are matched one to one, best first, down to ``floor``; the result is rescaled so that ``rescale`` is 0.  A side without
    tokens gives None.
    """
    parts = [(name_parts(x), name_parts(y)) for x, y in zip(a, b)]
    live = [k for k, (x, y) in enumerate(parts) if x and y]
    whole = {k: (_bare(a[k]), _bare(b[k])) for k in live}
    sims = _jaro_of([*whole.values(), *((x, y) for k in live for x in parts[k][0] for y in parts[k][1])])
    out: list[float | None] = [None] * len(parts)
    for k in live:
        xs, ys = parts[k]
        # best pairs first; ties go to the earlier token of the second name, then of the first
        pairs = sorted((-sims[x, y], j, i) for i, x in enumerate(xs) for j, y in enumerate(ys) if sims[x, y] >= floor)
        rows, cols, total = set(), set(), 0.0
        for s, j, i in pairs:
            if i not in rows and j not in cols:
                rows.add(i)
                cols.add(j)
                total -= s
        value = max(sims[whole[k]], total / min(len(xs), len(ys)))
        out[k] = min(max((value - rescale) / (1 - rescale), 0.0), 1.0)
    return out


def soundex(letters: str) -> str:
    """American Soundex of upper-case letters: H and W don't part equal codes, vowels do."""
    if not letters:
        return ""
    code, last = letters[0], _SOUNDEX[letters[0]]
    for c in letters[1:]:
        d = _SOUNDEX[c]
        if d == "7":
            continue
        if d not in ("0", last):
            code += d
        last = d
    return (code + "000")[:4]


def nickname_pair(a: str, b: str) -> bool:
    """One is the canonical of the other; two nicknames of one canonical are not."""
    return a != b and ((a, b) in _NICKNAMES or (b, a) in _NICKNAMES)


def compare_first(a: Sequence[str | None], b: Sequence[str | None], floor: float = 0.5) -> list[float | None]:
    """Given-name similarities by the first rule that applies.

    Missing: None.  Equal: 1.  An initial: 0.6 if the first letters agree, else 0.  Canonical and nickname: 0.95.
    Else Jaro rescaled from ``floor``, at least 0.5 where Soundex agrees.
    """
    clean = [((x or "").strip(" \t\r\n").upper(), (y or "").strip(" \t\r\n").upper()) for x, y in zip(a, b)]
    out: list[float | None] = [None] * len(clean)
    rest = []
    for k, (x, y) in enumerate(clean):
        if not x or not y:
            continue
        if x == y:
            out[k] = 1.0
        elif len(x) == 1 or len(y) == 1:
            out[k] = 0.6 if x[0] == y[0] else 0.0
        elif nickname_pair(x, y):
            out[k] = 0.95
        else:
            rest.append(k)
    sims = _jaro_of(clean[k] for k in rest)
    for k in rest:
        value = min(max((sims[clean[k]] - floor) / (1 - floor), 0.0), 1.0)
        x, y = (re.sub("[^A-Z]", "", s) for s in clean[k])
        if x and y and soundex(x) == soundex(y):
            value = max(value, 0.5)
        out[k] = value
    return out


def jaro_or_none(a: Sequence[str | None], b: Sequence[str | None]) -> list[float | None]:
    held = [(x, y) for x, y in zip(a, b) if x is not None and y is not None]
    sims = _jaro_of(held)
    return [None if x is None or y is None else sims[x, y] for x, y in zip(a, b)]


def osa_distance(a: str, b: str) -> int:
    """Edits with swaps of neighbours (each substring edited once)."""
    rows = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def osa_or_none(a: Sequence[str | None], b: Sequence[str | None]) -> list[float | None]:
    return [None if x is None or y is None else float(osa_distance(x, y)) for x, y in zip(a, b)]


KERNELS: dict[str, Callable] = {"jaro": jaro_or_none, "last": compare_last, "first": compare_first, "osa": osa_or_none}


class _Memo(dict):
    """Pair of values to similarity, at most MEMO pairs."""

    def __init__(self, kernel: Callable):
        super().__init__()
        self.kernel = kernel

    def learn(self, pairs: Iterable[tuple]) -> None:
        pairs = list(dict.fromkeys(pairs))
        new = [p for p in pairs if p not in self]
        if len(self) + len(new) > MEMO:
            self.clear()
            new = pairs
        self.update(zip(new, self.kernel([p[0] for p in new], [p[1] for p in new])))


def _value_udf(kind: str):
    kernel = KERNELS[kind]

    @pandas_udf("double")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        memo = _Memo(kernel)
        for xs, ys in batches:
            pairs = list(zip(xs, ys))
            memo.learn(pairs)
            yield pd.Series([memo[p] for p in pairs], dtype="float64")

    return of


def _set_udf(kind: str):
    kernel = KERNELS[kind]

    @pandas_udf("double")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        memo = _Memo(kernel)
        for xs, ys in batches:
            grids = [[(x, y) for x in a for y in b] if a is not None and b is not None else [] for a, b in zip(xs, ys)]
            memo.learn(p for g in grids for p in g)
            best = (max((s for s in map(memo.__getitem__, g) if s is not None), default=None) for g in grids)
            yield pd.Series(list(best), dtype="float64")

    return of


def _spread_udf(kind: str, least: bool):
    kernel = KERNELS[kind]

    @pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = _Memo(kernel)
        for sets in batches:
            grids = [[(x, y) for k, x in enumerate(s) for y in s[k + 1 :]] for s in (list(v) if v is not None else [] for v in sets)]
            memo.learn(p for g in grids for p in g)
            found = ([memo[p] for p in g] for g in grids)
            yield pd.Series([None if not f or None in f else (min(f) if least else max(f)) for f in found], dtype="float64")

    return of


def similarity(kind: str, x: Column, y: Column) -> Column:
    """'jaro', 'last', 'first' or 'osa' of two strings; null where the comparison has no value."""
    return _value_udf(kind)(x, y)


def best_similarity(kind: str, xs: Column, ys: Column) -> Column:
    """The greatest similarity over the cross product of two arrays; null if none has a value."""
    return _set_udf(kind)(xs, ys)


def similarity_table(d: DataFrame, field: str, compare: Callable[[Column, Column], Column]) -> tuple[DataFrame, DataFrame, int] | None:
    """(value, code; pair, sim; the number of codes) of a field of at most TABLE_VALUES distinct values, else None.

    ``pair`` is code x * codes + code y.  Both tables are small by count, so pairs meet them in broadcasts and no pair goes to Python.
    """
    spark = d.sparkSession
    values = [r[0] for r in d.select(field).distinct().limit(TABLE_VALUES + 1).collect()]
    if len(values) > TABLE_VALUES:
        return None
    values.sort(key=repr)
    codes = spark.createDataFrame([(v, k) for k, v in enumerate(values)], T.StructType([T.StructField("value", d.schema[field].dataType), T.StructField("code", T.LongType())]))
    every = codes.select(F.col("value").alias("x"), F.col("code").alias("i")).crossJoin(F.broadcast(codes.select(F.col("value").alias("y"), F.col("code").alias("j"))))
    sims = every.select((F.col("i") * len(values) + F.col("j")).alias("pair"), compare(F.col("x"), F.col("y")).alias("sim"))
    return codes, settled(sims, "similarities"), len(values)


def extreme_similarity(kind: str, values: Column, least: bool = True) -> Column:
    """The least (or greatest) similarity over the pairs of an array; null for fewer than two values."""
    return _spread_udf(kind, least)(values)


def nicknames_map() -> Column:
    """A constant map from canonical given name to nicknames."""
    table = nickname_table()
    return F.create_map(*[x for c, v in table.items() for x in (F.lit(c), F.array(*map(F.lit, v)))])


def nickname_equivalent(a: Column, b: Column) -> Column:
    table = nicknames_map()
    direct = F.coalesce(F.array_contains(F.try_element_at(table, a), b), F.lit(False)) | F.coalesce(F.array_contains(F.try_element_at(table, b), a), F.lit(False))
    return (F.coalesce(a, F.lit("")) != F.coalesce(b, F.lit(""))) & direct


def register_functions(spark: SparkSession) -> None:
    """Make jaro, compare_last_names, compare_first_names and osa usable from SQL."""
    for name, kind in (("jaro", "jaro"), ("compare_last_names", "last"), ("compare_two_names", "last"), ("compare_first_names", "first"), ("osa_distance", "osa")):
        spark.udf.register(name, _value_udf(kind))
