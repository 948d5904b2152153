"""Learned match models: Fellegi-Sunter by EM over agreement patterns, and logistic regression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panellink.operators.candidates import KEYS

#: Start and bounds of the probabilities, stopping rule.
AGREE_CUTOFF = 0.5
START_M, START_U, START_P, BOUND, TOLERANCE, MAX_ITERATIONS = 0.9, 0.1, 0.1, 1e-4, 1e-6, 200


@dataclass
class MatchModel:
    method: str
    feats: list[str]
    agree_cutoff: float = 0.5
    m: dict[str, float] = field(default_factory=dict)
    u: dict[str, float] = field(default_factory=dict)
    p: float = 0.0
    iters: int = 0
    intercept: float = 0.0
    coefficients: dict[str, float] = field(default_factory=dict)


def model_features(comparisons: DataFrame) -> list[str]:
    return [c for c in comparisons.columns if c not in KEYS]


def em_fellegi_sunter(patterns: np.ndarray, counts: np.ndarray, tol: float = TOLERANCE, max_iter: int = MAX_ITERATIONS) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(m, u, p, iterations) from distinct agreement patterns (1, 0 or NaN for each field) and their counts.

    Pairs of one pattern have one posterior, so EM over counted patterns is EM over all pairs.  Unobserved fields are no evidence.
    """
    seen = ~np.isnan(patterns)
    agree = np.where(seen, patterns, 0.0)
    k = patterns.shape[1]
    m, u, p, it = np.full(k, START_M), np.full(k, START_U), START_P, 0
    n = counts[:, None]

    def evidence(prob: np.ndarray) -> np.ndarray:
        return agree @ np.log(prob) + (seen * (1 - agree)) @ np.log(1 - prob)

    for it in range(1, max_iter + 1):
        with np.errstate(over="ignore", divide="ignore"):
            g = 1 / (1 + np.exp(np.log(1 - p) + evidence(u) - np.log(p) - evidence(m)))
        shares = []
        for w in (g[:, None], 1 - g[:, None]):
            held = (n * w * seen).sum(axis=0)
            share = np.divide((n * w * agree).sum(axis=0), held, out=np.full(k, 0.5), where=held > 0)
            shares.append(np.clip(share, BOUND, 1 - BOUND))
        p_new = float((counts * g).sum() / counts.sum())
        moved = max(np.abs(shares[0] - m).max(), np.abs(shares[1] - u).max(), abs(p_new - p))
        m, u, p = *shares, p_new
        if moved < tol:
            break
    return m, u, p, it


def fit_match_model(comparisons: DataFrame, method: str = "em", labels: str | None = None, agree_cutoff: float = 0.5, feats: list[str] | None = None, weight: str | None = None) -> MatchModel:
    """'em': unsupervised, from at most 3 ** features counted patterns.  'logistic': from the 0/1 column ``labels``.

    The logistic model is fitted without a penalty on the similarities, missing ones as 0.5 with an indicator for fields
    that miss any; on separable labels its weights grow until the optimizer stops.  ``weight`` names how many pairs a row stands for.
    """
    feats = feats or [c for c in model_features(comparisons) if c not in (labels, weight)]
    if method == "em":
        agree = [(F.col(f) >= agree_cutoff).cast("double").alias(f) for f in feats]
        held = comparisons.select(*agree, (F.col(weight) if weight else F.lit(1)).alias("_n")).groupBy(*feats).agg(F.sum("_n").alias("n")).collect()  # 3 ** len(feats) at most
        if not held:
            raise ValueError("fit_match_model: no comparisons")
        patterns = np.array([[np.nan if r[f] is None else r[f] for f in feats] for r in held], float)
        m, u, p, iters = em_fellegi_sunter(patterns, np.array([r["n"] for r in held], float))
        return MatchModel("em", feats, agree_cutoff, dict(zip(feats, m.tolist())), dict(zip(feats, u.tolist())), p, iters)
    if method != "logistic":
        raise ValueError(f"unknown method {method!r}")
    if labels is None or labels not in comparisons.columns:
        raise ValueError("fit_match_model: method 'logistic' needs a column of labels")
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    kept = comparisons.where(F.col(labels).isNotNull())
    gaps = kept.agg(*[F.count(F.when(F.col(f).isNull(), 1)).alias(f) for f in feats]).first()
    terms = {f: F.coalesce(F.col(f), F.lit(0.5)) for f in feats} | {f"{f}_na": F.col(f).isNull().cast("double") for f in feats if gaps[f]}
    data = kept.select(F.col(labels).cast("double").alias("label"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"), *[c.alias(t) for t, c in terms.items()])
    data = VectorAssembler(inputCols=list(terms), outputCol="features").transform(data)
    fit = LogisticRegression(weightCol="weight", regParam=0.0, maxIter=200, tol=1e-9, standardization=True).fit(data)
    return MatchModel("logistic", feats, agree_cutoff, intercept=float(fit.intercept), coefficients=dict(zip(terms, map(float, fit.coefficients))))


def fs_weights(model: MatchModel) -> list[dict]:
    """feature, m, u (3 digits), w_agree and w_disagree (log2 ratios, 2 digits) of an EM model."""
    if model.method != "em":
        raise ValueError("fs_weights: only for EM models")
    return [
        {
            "feature": f, "m": round(model.m[f], 3), "u": round(model.u[f], 3),
            "w_agree": round(float(np.log2(model.m[f] / model.u[f])), 2), "w_disagree": round(float(np.log2((1 - model.m[f]) / (1 - model.u[f]))), 2),
        }
        for f in model.feats
    ]


def _evidence(model: MatchModel, f: str) -> tuple[float, float]:
    return float(np.log(model.m[f] / model.u[f])), float(np.log((1 - model.m[f]) / (1 - model.u[f])))


def match_evidence(model: MatchModel, feats: list[str]) -> Column:
    """The log odds of a match from some features of an EM model."""
    odds = F.lit(log_odds(model.p))
    for f in feats:
        agree, differ = _evidence(model, f)
        odds = odds + F.when(F.col(f) >= model.agree_cutoff, F.lit(agree)).when(F.col(f) < model.agree_cutoff, F.lit(differ)).otherwise(F.lit(0.0))
    return odds


def late_evidence(model: MatchModel, feat: str | None) -> Callable[[np.ndarray], np.ndarray]:
    """What similarities of one more feature add to the log odds; missing ones 0."""
    agree, differ = _evidence(model, feat) if feat else (0.0, 0.0)
    cutoff = model.agree_cutoff
    return lambda sim: np.where(np.isnan(sim), 0.0, np.where(sim >= cutoff, agree, differ))


def agreement(cutoff: float) -> Callable[[dict, np.ndarray], np.ndarray]:
    """1, 0 or NaN for similarities."""
    return lambda _, sim: np.where(np.isnan(sim), np.nan, (sim >= cutoff).astype(float))


def log_odds(p: float) -> float:
    with np.errstate(divide="ignore"):
        return float(np.log(p / (1 - p))) if p < 1 else float("inf")


def predict_match(model: MatchModel) -> Column:
    """The match probability of a row of comparisons, as a column expression."""
    if model.method == "em":
        return 1 / (1 + F.exp(-match_evidence(model, model.feats)))
    odds = F.lit(model.intercept)
    for t, w in model.coefficients.items():
        value = F.col(t.removesuffix("_na")).isNull().cast("double") if t.endswith("_na") else F.coalesce(F.col(t), F.lit(0.5))
        odds = odds + F.lit(w) * value
    return 1 / (1 + F.exp(-odds))
