"""Distances of vectors from their own history, and residuals of one component from the others. One ordered series of vectors a key."""

from __future__ import annotations

import math
from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ordered(df: DataFrame, keys: list[str], order: str, roots: list[str], of, columns: list[str]) -> DataFrame:
    """One fold for each key over its rows in order; of(matrix) gives the new columns."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def fold(pdf):
        pdf = pdf.sort_values(order)
        out = of(pdf[roots].to_numpy(float))
        made = pdf[[*keys, order]].copy()
        for c, v in zip(columns, out, strict=True):
            made[c] = [x if math.isfinite(x) else None for x in v]
        return made

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, order]) + "".join(f", {c} double" for c in columns)
    return df.select(*keys, order, *roots).groupBy(*keys).applyInPandas(fold, schema)


def conditioned(cov: np.ndarray, ridge: float) -> np.ndarray:
    """Covariances (the last two axes) with `ridge` times their mean variance on the diagonal, or ridge itself where that isn't a positive number."""
    k = cov.shape[-1]
    mean = np.einsum("...ii->...", cov) / k
    weight = np.where((mean > 0) & np.isfinite(mean), mean, 1.0) * ridge
    return cov + weight[..., None, None] * np.eye(k)


def distances_of(d: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Mahalanobis lengths of the rows of d, each by its own covariance."""
    return np.sqrt(np.maximum(0.0, np.einsum("ni,nij,nj->n", d, np.linalg.pinv(cov, hermitian=True), d)))


def decayed(start: np.ndarray, steps: np.ndarray, keep: float, chunk: int = 256) -> np.ndarray:
    """y[0] = start, y[t + 1] = keep * y[t] + steps[t], for all t: an affine map, so chunks are triangular products that only their first value links."""
    flat, out = steps.reshape(len(steps), start.size), [start.reshape(1, -1)]
    for a in range(0, len(flat), chunk):
        part = flat[a : a + chunk]
        age = np.arange(len(part))
        powers = np.tril(keep ** np.maximum(age[:, None] - age[None, :], 0))
        out.append(keep ** (age + 1.0)[:, None] * out[-1][-1:] + powers @ part)
    return np.concatenate(out).reshape(len(steps) + 1, *start.shape)


def rolling_mahalanobis(df: DataFrame, keys: list[str], order: str, roots: list[str], window: int | None, least: int, ridge: float = 1e-6) -> DataFrame:
    """distance of each vector from the `window` vectors before it (None: all), which leave the vector itself out. Moments are carried along, so a row costs the same at any window."""

    def of(x):
        k = x.shape[1]
        n, s, ss, held, out = 0, np.zeros(k), np.zeros((k, k)), deque(), []
        shift = x[np.isfinite(x).all(1)][:1].sum(0) if len(x) else 0
        for row in x - shift:
            fine = np.isfinite(row).all()
            if fine and n >= max(least, 2):
                cov = (ss - np.outer(s, s) / n) / (n - 1)
                out.append(distances_of((row - s / n)[None], conditioned(cov, ridge)[None])[0])
            else:
                out.append(math.nan)
            held.append(row if fine else None)
            if fine:
                n, s, ss = n + 1, s + row, ss + np.outer(row, row)
            if window and len(held) > window and (old := held.popleft()) is not None:
                n, s, ss = n - 1, s - old, ss - np.outer(old, old)
        return (out,)

    return _ordered(df, keys, order, roots, of, ["distance"])


def ewma_moments(x: np.ndarray, half_life: float, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Exponentially weighted means and covariances as they were before each row of x but the first, which they begin with."""
    keep = 0.5 ** (1 / max(half_life, 1))
    mean = decayed(x[0], (1 - keep) * x[1:], keep)[:-1]
    d = x[1:] - mean
    return mean, decayed(ridge * np.eye(x.shape[1]), (1 - keep) * d[:, :, None] * d[:, None, :], keep)[:-1]


def ewma_mahalanobis(df: DataFrame, keys: list[str], order: str, roots: list[str], half_life: float, least: int, ridge: float = 1e-6) -> DataFrame:
    """distance of each vector from exponentially weighted moments as they were before it; rows with a missing component are passed over."""

    def of(x):
        out, fine = np.full(len(x), math.nan), np.flatnonzero(np.isfinite(x).all(1))
        if len(fine) > 1:
            mean, cov = ewma_moments(x[fine], half_life, ridge)
            late = max(least, 1)
            out[fine[late:]] = distances_of((x[fine][1:] - mean)[late - 1 :], conditioned(cov, ridge)[late - 1 :])
        return (out,)

    return _ordered(df, keys, order, roots, of, ["distance"])


def ewma_residual(df: DataFrame, keys: list[str], order: str, roots: list[str], half_life: float, least: int, ridge: float = 1e-6) -> DataFrame:
    """residual_<root>: each component less what the others lead to expect of it, by exponentially weighted moments as they were before the row.

    The expectation is the conditional mean: the component's mean and its covariances
    with the others through the inverse of theirs, which has the ridge.
    """

    def of(x):
        k = x.shape[1]
        out, fine = [np.full(len(x), math.nan) for _ in range(k)], np.flatnonzero(np.isfinite(x).all(1))
        if len(fine) > 1:
            mean, cov = ewma_moments(x[fine], half_life, ridge)
            late = max(least, 1)
            d, cov = (x[fine][1:] - mean)[late - 1 :], cov[late - 1 :]
            for j in range(k):
                rest = [i for i in range(k) if i != j]
                inner = np.linalg.pinv(conditioned(cov[:, rest][:, :, rest], ridge), hermitian=True)
                out[j][fine[late:]] = d[:, j] - np.einsum("ni,nij,nj->n", cov[:, j][:, rest], inner, d[:, rest])
        return out

    return _ordered(df, keys, order, roots, of, [f"residual_{r}" for r in roots])


def rolling_ridge_residual(df: DataFrame, keys: list[str], order: str, roots: list[str], window: int, least: int, alpha: float = 1.0) -> DataFrame:
    """residual_<root>: each component less its ridge prediction from the others over the window before it; the intercept isn't penalised."""

    def of(x):
        k = x.shape[1]
        z = np.column_stack([np.ones(len(x)), x])
        n, ss, held = 0, np.zeros((k + 1, k + 1)), deque()
        out = [[] for _ in range(k)]
        for row in z:
            fine = np.isfinite(row).all()
            for j in range(k):
                if fine and n >= least:
                    use = [0, *[i + 1 for i in range(k) if i != j]]
                    penalty = alpha * np.eye(k)
                    penalty[0, 0] = 0
                    coef = np.linalg.lstsq(ss[np.ix_(use, use)] + penalty, ss[use, j + 1], rcond=None)[0]
                    out[j].append(row[j + 1] - row[use] @ coef)
                else:
                    out[j].append(math.nan)
            held.append(row if fine else None)
            if fine:
                n, ss = n + 1, ss + np.outer(row, row)
            if len(held) > window and (old := held.popleft()) is not None:
                n, ss = n - 1, ss - np.outer(old, old)
        return out

    return _ordered(df, keys, order, roots, of, [f"residual_{r}" for r in roots])


def chi2_quantile(p: float, k: int) -> float:
    """Where the chi-square distribution of k degrees reaches p, by bisection of the incomplete gamma function's series."""

    def below(x):
        term = total = 1 / math.gamma(k / 2 + 1)
        n = k / 2
        while term > 1e-17 * total:
            n += 1
            term *= x / 2 / n
            total += term
        return total * (x / 2) ** (k / 2) * math.exp(-x / 2)

    low, high = 0.0, 20.0 + 10 * k
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return low


def _concentrate(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Moments of the h rows of x nearest to the given ones."""
    d = x - mean
    near = x[np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.pinv(cov), d), kind="stable")[:h]]
    return near.mean(0), np.cov(near, rowvar=False, bias=True).reshape(x.shape[1], x.shape[1])


def _starts(x: np.ndarray, share: float, seed: int, tries: int, finalists: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Moments of the least determinants that concentration reaches in x from random subsets of one row more than columns."""
    rng, h, k, found = np.random.default_rng(seed), max(x.shape[1] + 1, int(share * len(x))), x.shape[1], []
    for _ in range(tries):
        part = x[rng.choice(len(x), min(len(x), k + 1), replace=False)]
        at = part.mean(0), np.cov(part, rowvar=False, bias=True).reshape(k, k)
        for _ in range(2):
            at = _concentrate(x, *at, h)
        found.append(at)
    found.sort(key=lambda m: np.linalg.det(m[1]))
    return found[:finalists]


def robust_distance(df: DataFrame, roots: list[str], share: float = 0.9, least: int = 100, ridge: float = 1e-6, seed: int = 7, sample: int = 1500, tries: int = 200, finalists: int = 3, steps: int = 30) -> DataFrame:
    """df with distance: of each vector from the minimum-covariance-determinant moments of all.

    FAST-MCD (Rousseeuw and Van Driessen, 1999): random starts are concentrated on a
    bounded sample of `sample` rows, the best `finalists` then on all rows until the
    determinant stops falling. A step is an aggregate over df; the bound of the
    nearest `share` is a quantile sketch, exact up to a million rows. The moments are
    made consistent at the median and taken anew from the rows within the 97.5 %
    bound. Rows with a missing component have no distance; with fewer than `least`
    others no row has one.
    """
    k, x = len(roots), [F.col(r).cast("double") for r in roots]
    fine = F.lit(True)
    for c in x:
        fine = fine & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    fine = F.coalesce(fine, F.lit(False))
    valid = df.where(fine).select(*[c.alias(f"x{i}") for i, c in enumerate(x)])
    n = valid.count()
    if n < max(least, k + 2):
        return df.withColumn("distance", F.lit(None).cast("double"))

    def square(columns, mean, cov):
        inverse, d = np.linalg.pinv(cov), [c - float(m) for c, m in zip(columns, mean, strict=True)]
        terms = [d[i] * d[j] * float(inverse[i, j]) for i in range(k) for j in range(k)]
        return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))

    names = [F.col(f"x{i}") for i in range(k)]

    def moments(rows):
        r = rows.agg(*[F.avg(c) for c in names], *[F.covar_pop(names[i], names[j]) for i in range(k) for j in range(k)]).first()
        return np.array(r[:k]), np.array(r[k:]).reshape(k, k)

    def reach(at, part):
        return valid.agg(F.percentile_approx(square(names, *at), part, 1_000_000)).first()[0]

    some = np.array(valid.orderBy(F.xxhash64(F.lit(seed), *names), *names).limit(sample).collect(), float)
    best = None
    for at in _starts(some, share, seed, tries, finalists):
        det = math.inf
        for _ in range(steps):
            new = moments(valid.where(square(names, *at) <= reach(at, int(share * n) / n)))
            fell, det, at = np.linalg.det(new[1]) < det * (1 - 1e-12), np.linalg.det(new[1]), new
            if not fell:
                break
        if best is None or det < best[0]:
            best = det, at
    at = best[1]
    scale = reach(at, 0.5) / chi2_quantile(0.5, k)
    if scale > 0:
        at = moments(valid.where(square(names, *at) / scale < chi2_quantile(0.975, k)))
    return df.withColumn("distance", F.when(fine, F.sqrt(square(x, at[0], conditioned(at[1], ridge)))))


def quantile_flags(df: DataFrame, x: str, quantiles: tuple[float, ...] = (0.9, 0.95, 0.99)) -> DataFrame:
    """df with a flag for each quantile of the whole sample that x reaches; missing x is false. The thresholds are one row."""
    limits = df.agg(F.percentile(x, F.array(*[F.lit(q) for q in quantiles])).alias("__q"))
    out = df.join(F.broadcast(limits))
    for i, q in enumerate(quantiles):
        out = out.withColumn(f"{x}_q{round(q * 100)}", F.coalesce(F.col(x) >= F.element_at("__q", i + 1), F.lit(False)))
    return out.drop("__q")


def entry_masks(df: DataFrame, keys: list[str], x: str, quantile: float) -> DataFrame:
    """df with entry: whether x reaches the quantile of its own series over the whole sample; missing x is false."""
    limits = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.percentile(x, F.lit(quantile)).alias("__q"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = df.join(limits, cond, "left").withColumn("entry", F.coalesce(F.col(x) >= F.col("__q"), F.lit(False)))
    return out.drop("__q", *[f"__{k}" for k in keys])


def anomaly_frame(df: DataFrame, keys: list[str], order: str, roots: list[str], window: int, least: int, half_life: float) -> DataFrame:
    """The rolling, expanding, weighted and robust distances of each vector side by side, with the quantile flags of the rolling one."""
    at = [*keys, order]
    out = rolling_mahalanobis(df, keys, order, roots, window, least).withColumnRenamed("distance", "rolling")
    out = out.join(rolling_mahalanobis(df, keys, order, roots, None, least).withColumnRenamed("distance", "expanding"), at)
    out = out.join(ewma_mahalanobis(df, keys, order, roots, half_life, least).withColumnRenamed("distance", "weighted"), at)
    out = out.join(robust_distance(df, roots).select(*at, F.col("distance").alias("robust")), at)
    return quantile_flags(out, "rolling")
