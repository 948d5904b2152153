"""Toxic passages: maximum-scoring segments over token log-odds, aggregated by extreme-value calibration."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from panellink.llm.common import carried, col_of, returned, stored

TOKEN = re.compile(r"[^\W_]+")
#: Labelled rows that the classifier is fitted on, at most (those with the smallest digests of their id).
MAX_LABELLED = 8_000
#: Units must stand in this many contexts; their log-odds must be over 0.5 and this many standard errors over 0.
MIN_CONTEXTS, MIN_Z = 5, 3.0
#: A token without a score of its own has that of its longest scored stem of these lengths.
STEMS = (6, 5, 4)
#: Tokens whose scores a worker keeps.
KEPT_TOKENS = 300_000
#: Weight of the Dirichlet prior, whose frequencies are those of all labelled rows, as a share of their tokens.
PRIOR = 0.05
#: Parts of the labelled rows: each part's segments, for the calibration, are scored by the tokens of the others.
FOLDS = 4


@dataclass(frozen=True)
class ToxicityModel:
    scores: dict[str, float]  #: log-odds of the significant tokens, and of stems as ``stem*``
    drift: float  #: score of every other token, below 0
    lam: float  #: extreme-value law of the best segment in clean text: P(S <= x) = exp(-k n exp(-lam x))
    k: float
    bias: float  #: logistic calibration of (normalized maximum, significant sum)
    slopes: tuple[float, float]


class _Scores(dict):
    """Token to log-odds or None, filled as tokens come, at most KEPT_TOKENS."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores

    def __missing__(self, token: str) -> float | None:
        found = self.scores.get(token)
        for n in STEMS:
            if found is None and len(token) > n:
                found = self.scores.get(token[:n] + "*")
        if len(self) >= KEPT_TOKENS:
            self.clear()
        self[token] = found
        return found


def unit_scores(counts: list[tuple[str, int, int]], n1: int, n0: int) -> dict[str, float]:
    """Log-odds of (unit, toxic contexts, clean contexts) under an informative Dirichlet prior, where significant.

    ``n1`` and ``n0`` are the contexts of all tokens; the prior has the background frequencies.
    """
    out, prior = {}, PRIOR * (n1 + n0)
    for unit, y1, y0 in counts:
        a = PRIOR * (y1 + y0)
        delta = math.log((y1 + a) / (n1 + prior - y1 - a)) - math.log((y0 + a) / (n0 + prior - y0 - a))
        if delta > 0.5 and delta / math.sqrt(1 / (y1 + a) + 1 / (y0 + a)) >= MIN_Z:
            out[unit] = delta
    return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of ``scores``, in one left-to-right pass of linear time.

    Each positive score opens a candidate (its left and right cumulative sums); a candidate is merged with the nearest
    one to its left whose left sum is smaller, as long as that one's right sum is smaller too.  Every candidate keeps a pointer to that
    nearest one, so the search skips those it has passed once; a candidate whose left sum is a new minimum settles all before it.
    """
    total = np.cumsum(scores)
    done: list[tuple[int, int, float]] = []
    held: list[tuple[int, int, float, float, int]] = []
    at = np.flatnonzero(scores > 0)
    for k, left, right in zip(at.tolist(), (total[at] - scores[at]).tolist(), total[at].tolist()):
        new = (k, k + 1, left, right)
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j = held[j][4]
            if j < 0:
                done += [(x[0], x[1], x[3] - x[2]) for x in held]
                held = [(*new, -1)]
                break
            if held[j][3] >= new[3]:
                held.append((*new, j))
                break
            new = (held[j][0], new[1], held[j][2], new[3])
            del held[j:]
    return done + [(x[0], x[1], x[3] - x[2]) for x in held]


def passages(text: str | None, model: ToxicityModel, scores: _Scores) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens, and maximal segments as (first token, end token, score)."""
    tokens = TOKEN.findall((text or "").lower())
    held = [(i, s) for i, s in enumerate(map(scores.__getitem__, tokens)) if s is not None]
    if not held:
        return len(tokens), []
    # runs of other tokens are one step of drift each
    at = np.fromiter((i for i, _ in held), np.int64, len(held))
    steps = np.empty(2 * len(held))
    steps[0::2] = model.drift * np.diff(at, prepend=-1) - model.drift
    steps[1::2] = [s for _, s in held]
    return len(tokens), [(int(at[a // 2]), int(at[(b - 1) // 2]) + 1, s) for a, b, s in maximal_segments(steps)]


def _aggregated(segments: list[float], n: int, model: ToxicityModel) -> tuple[float, float]:
    """Extreme-value features of segment scores: the Gumbel tail of the best one, and the sum over those above clean text's level."""
    if not segments:
        return 0.0, 0.0
    level = math.log(max(model.k * n, 1e-9))
    normalized = [model.lam * s - level for s in segments]
    best = max(normalized)
    # the chance that clean text of this length has a segment as good
    tail = -math.log(-math.expm1(-math.exp(-best))) if best < 30 else best
    return tail, math.log1p(sum(x for x in normalized if x > 0))


def features(text: str | None, model: ToxicityModel, scores: _Scores) -> tuple[float, float]:
    n, found = passages(text, model, scores)
    return _aggregated([s for _, _, s in found], n, model)


def gumbel_parameters(maxima: list[tuple[float, int]]) -> tuple[float, float]:
    """(lam, K) of the law P(best score <= x) = exp(-K n exp(-lam x)) of a clean text of n tokens, by maximum likelihood.

    ``maxima`` has (best segment score, tokens) of clean texts; texts without a positive score are known to be at 0 or below.
    For each lam the likeliest K is the number of positive maxima over the sum of n exp(-lam x); lam is where the slope of the
    likelihood is 0, found by bisection.  With fewer than two different maxima there is nothing to fit: (1, 1e-3).
    """
    x, n = np.array([s for s, _ in maxima], float), np.array([max(m, 1) for _, m in maxima], float)
    up = x > 0
    if len(np.unique(x[up])) < 2:
        return 1.0, 1e-3

    def weights(lam: float) -> np.ndarray:
        return n * np.where(up, np.exp(-lam * np.maximum(x, 0)), 1.0)

    def slope(lam: float) -> float:
        w = weights(lam)
        return up.sum() / lam - x[up].sum() + up.sum() * float((w * np.maximum(x, 0)).sum() / w.sum())

    low, high = 1e-3, 1.0
    while slope(high) > 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    return low, max(float(up.sum() / weights(low).sum()), 1e-9)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps of a logistic regression with a small ridge; the bias comes first."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * np.r_[0, w[1:]]
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.diag(np.r_[1e-9, np.ones(len(w) - 1)])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, label_id: str = "doc_id", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Learn from labelled rows whose crc32(id as text) mod 5 is not 0, ``max_labelled`` of them at most.

    Token scores come from all of them; the extreme-value law and the logistic calibration are fitted on segments that each
    of FOLDS parts gets from the token scores of the others, so no row is calibrated on scores that it made itself.

    A row labelled more than once has its greatest label; null labels and null texts teach nothing.  Without both labels, the
    model scores everything with the share of toxic rows.
    """
    text_id = col_of(labels, label_id).cast("string")
    label = col_of(labels, label_col)
    usable = labels.where(label.isNotNull() & (F.crc32(text_id.cast("binary")) % 5 != 0))
    chosen = usable.groupBy(text_id.alias("id")).agg(F.max(label.cast("int")).alias("label")).orderBy(F.md5("id"), "id").limit(max_labelled)
    fold = (F.conv(F.substring(F.md5("id"), 25, 8), 16, 10).cast("long") % FOLDS).cast("int")
    chosen = chosen.withColumn("fold", fold)
    d = docs.select(col_of(docs, id_col).cast("string").alias("id"), col_of(docs, text_col).alias("text")).where("text IS NOT NULL")
    sample = stored(d.join(F.broadcast(chosen), "id").select("label", "fold", "text"), "toxicity-sample")  # max_labelled ids at most
    # a token counts once for each pair of neighbours, so copies and near copies of a passage count once
    words = sample.select("label", "fold", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w"))
    zipped = F.explode(F.arrays_zip("w", F.concat(F.array(F.lit("")), "w").alias("before"), F.expr("slice(w, 2, greatest(size(w), 1))").alias("after")))
    contexts = words.where(F.size("w") > 0).select("label", "fold", zipped.alias("z")).select("label", "fold", F.col("z.w").alias("t"), F.xxhash64("z.before", "z.after").alias("c")).where("t IS NOT NULL")
    contexts = contexts.groupBy("label", "t", "c").agg(F.bit_or(F.expr("shiftleft(1, fold)")).alias("folds"))
    # counts over all folds, and over all but each one
    left = [F.lit(True), *[F.col("folds").bitwiseAND(F.lit(((1 << FOLDS) - 1) ^ (1 << k))) != 0 for k in range(FOLDS)]]
    counts = [c for k, kept in enumerate(left) for c in (F.sum(F.when(kept & (F.col("label") == 1), 1).otherwise(0)).alias(f"y1_{k}"), F.sum(F.when(kept & (F.col("label") == 0), 1).otherwise(0)).alias(f"y0_{k}"))]
    names = [f"y{y}_{k}" for k in range(FOLDS + 1) for y in (1, 0)]
    tokens = stored(contexts.groupBy("t").agg(*counts), "toxicity-tokens")
    units = [F.col("t"), *[F.when(F.length("t") > n, F.concat(F.substring("t", 1, n), F.lit("*"))) for n in STEMS]]
    grouped = tokens.select(F.explode(F.array(*units)).alias("u"), *names).where("u IS NOT NULL").groupBy("u").agg(*[F.sum(c).alias(c) for c in names])
    totals = [int(x or 0) for x in tokens.agg(*[F.sum(c) for c in names]).first()]
    units_held = grouped.where(f"y1_0 >= {MIN_CONTEXTS}").orderBy("u").collect()  # units of max_labelled rows

    def scored(k: int) -> ToxicityModel:
        """The token scores without fold k - 1, or of all folds; the rest isn't fitted yet."""
        n1, n0 = totals[2 * k : 2 * k + 2]
        found = [(r["u"], int(r[f"y1_{k}"]), int(r[f"y0_{k}"])) for r in units_held if r[f"y1_{k}"] >= MIN_CONTEXTS]
        scores = unit_scores(found, n1, n0) if n1 and n0 else {}
        # each token falls by the drift, at least by twice what clean text gains a token
        own = _Scores(scores)
        gains = sum(own[t] * y0 for t, _, y0 in found if not t.endswith("*") and y0 and own[t] is not None)
        return ToxicityModel(scores, -max(0.05, 2 * gains / max(n0, 1)), 1.0, 1e-3, 0.0, (0.0, 0.0))

    full, others = scored(0), [scored(k + 1) for k in range(FOLDS)]
    # the calibration is fitted on segments that were scored by the other folds' tokens alone
    seen = [(r["label"], r["best"], r["tokens"], r["segments"]) for r in sample.select("label", _segments(others)("text", "fold").alias("s")).select("label", "s.*").collect()]  # max_labelled rows
    lam, k = gumbel_parameters([(best, n) for label, best, n, _ in seen if label == 0])
    full = replace(full, lam=lam, k=k)
    if not seen:
        return full
    y = np.array([label for label, *_ in seen], float)
    if y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return replace(full, bias=math.log(rate / (1 - rate)))
    w = fit_logistic(np.array([_aggregated(list(segments), n, full) for *_, n, segments in seen]), y)
    return replace(full, bias=float(w[0]), slopes=(float(w[1]), float(w[2])))


def _segments(models: list[ToxicityModel]):
    """A column function of text and fold: tokens, the best segment's score (0 if there is none) and all segments' scores."""

    @pandas_udf("tokens int, best double, segments array<double>")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        scores = [_Scores(m.scores) for m in models]
        for texts, folds in batches:
            rows = []
            for t, f in zip(texts, folds):
                n, found = passages(t, models[f], scores[f])
                own = [s for _, _, s in found]
                rows.append((n, max(own, default=0.0), own))
            yield pd.DataFrame(rows, columns=["tokens", "best", "segments"])

    return of


def _features(model: ToxicityModel):
    @pandas_udf("tail double, mass double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scores = _Scores(model.scores)
        for texts in batches:
            yield pd.DataFrame([features(t, model, scores) for t in texts], columns=["tail", "mass"])

    return of


def toxic_passages(model: ToxicityModel):
    """A column function: text to its significant passages, as (first token, end token, score)."""

    @pandas_udf("array<struct<start:int, end:int, score:double>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = _Scores(model.scores)
        for texts in batches:
            rows = []
            for t in texts:
                n, found = passages(t, model, scores)
                rows.append([{"start": a, "end": b, "score": s} for a, b, s in found if model.lam * s > math.log(max(model.k * n, 1e-9))])
            yield pd.Series(rows)

    return of


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score (0 to 1), predicted, ``carry``: only the text is an input of a score.

    Null and empty texts have no segment and score the calibrated base value.  Very long texts are scored whole, in time linear in their
    words.  Repeated rows score alike; an empty table gives an empty result.
    """
    d = docs.select(col_of(docs, id_col).alias("doc_id"), _features(model)(col_of(docs, text_col)).alias("f"), *carried(docs, carry))
    z = F.lit(model.bias) + F.lit(model.slopes[0]) * F.col("f.tail") + F.lit(model.slopes[1]) * F.col("f.mass")
    score = F.round(1 / (1 + F.exp(-z)), 6)
    return d.select("doc_id", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), *returned(carry))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
