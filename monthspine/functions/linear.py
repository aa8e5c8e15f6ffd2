"""Dense algebra on one moment matrix of size (1 + predictors + targets).

A moment matrix sums z z' over the training months for z = (1, predictors, targets). Means,
covariances, principal components and every linear fit below follow from it alone, so no
training row reaches Python.
"""

from __future__ import annotations

import numpy as np

# Penalty grids, mixing grid, iteration limit.
LASSO_GRID = np.logspace(-5, 1, 30)
RIDGE_GRID = np.logspace(-5, 5, 30)
MIX_GRID = np.array([0.1, 0.3, 0.5, 0.7, 0.9])
MAX_ITER = 20000


def unpack(packed: np.ndarray, size: int) -> np.ndarray:
    """Symmetric matrix from its upper triangle, row by row."""
    s = np.zeros((size, size))
    s[np.triu_indices(size)] = packed
    return s + np.triu(s, 1).T


def mean_cov(s: np.ndarray, cols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    n = s[0, 0]
    mu = s[0, cols] / n
    return mu, s[np.ix_(cols, cols)] / n - np.outer(mu, mu)


def spread(cov: np.ndarray) -> np.ndarray:
    """Standard deviations; one for a constant column."""
    var = np.clip(np.diag(cov), 0.0, None)
    scale = np.maximum(var.max(initial=0.0), 1e-300)
    return np.where(var > 1e-14 * scale, np.sqrt(var), 1.0)


def least_squares(cov: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Least-norm slopes from covariances."""
    return np.linalg.pinv(cov, rcond=1e-12, hermitian=True) @ cross


def resolved(steps: list[tuple], target: int) -> list[tuple]:
    """Steps with the fit's own target where a regressed factor names none."""
    return [(*step[:2], target) if step[0] == "cp" and step[2] is None else step for step in steps]


def feature_rows(s: np.ndarray, steps: list[tuple], width: int) -> np.ndarray:
    """Rows that map (1, predictors) to features, following ``steps``:

    ``("raw", cols)`` the columns themselves, ``("pca", cols, k, scaled)`` principal component
    scores, ``("cp", cols, target)`` the fitted value of a target regressed on the columns (``resolved`` puts in a
    fit's own target for None).
    """
    rows = []
    for step in steps:
        kind, cols = step[0], step[1]
        if kind == "raw":
            rows += [np.eye(width)[c] for c in cols]
            continue
        mu, cov = mean_cov(s, cols)
        if kind == "cp":
            t = step[2]
            b = least_squares(cov, s[cols, t] / s[0, 0] - mu * s[0, t] / s[0, 0])
            r = np.zeros(width)
            r[cols], r[0] = b, s[0, t] / s[0, 0] - b @ mu
            rows.append(r)
            continue
        sd = spread(cov) if step[3] else np.ones(len(cols))
        values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
        for v in vectors.T[::-1][: step[2]]:
            r = np.zeros(width)
            r[cols], r[0] = v / sd, -(v / sd) @ mu
            rows.append(r)
    return np.array(rows)


def descend(corr: np.ndarray, cross: np.ndarray, l1: np.ndarray, l2: np.ndarray, tol: float = 1e-5) -> np.ndarray:
    """Coordinate descent for many penalties at once: minimise b'Cb/2 - b'c + l1|b| + l2 b'b/2.

    A penalty stops when a sweep moves no slope by more than ``tol`` of its largest one.
    """
    out = np.zeros((len(cross), len(l1)))
    live = np.arange(len(l1))
    b = out.copy()
    for _ in range(MAX_ITER):
        before = b.copy()
        for j in range(len(cross)):
            rho = cross[j] - corr[j] @ b + corr[j, j] * b[j]
            b[j] = np.sign(rho) * np.maximum(np.abs(rho) - l1[live], 0.0) / (corr[j, j] + l2[live])
        going = np.abs(b - before).max(axis=0) > tol * np.abs(b).max(axis=0)
        out[:, live] = b
        if not going.any():
            break
        live, b = live[going], b[:, going]
    return out


def penalised(corr: np.ndarray, cross: np.ndarray, n: float, kind: str, alphas: np.ndarray, mix: np.ndarray) -> np.ndarray:
    """Slopes on standardised features, one column per (alpha, mix)."""
    if kind == "ridge":
        values, vectors = np.linalg.eigh(corr)
        return vectors @ ((vectors.T @ cross)[:, None] / (np.clip(values, 0, None)[:, None] + alphas[None, :] / n))
    return descend(corr, cross, alphas * mix, alphas * (1.0 - mix))


def standard_moments(s: np.ndarray, f: np.ndarray, target: int) -> tuple:
    """Feature means, deviations, correlations, cross moments and the target's mean."""
    width = f.shape[1]
    n = s[0, 0]
    mu = f @ s[:width, 0] / n
    second = f @ s[:width, :width] @ f.T / n - np.outer(mu, mu)
    sd = spread(second)
    ym = s[0, target] / n
    cross = (f @ s[:width, target] / n - mu * ym) / sd
    return n, mu, sd, second / np.outer(sd, sd), cross, ym


def fit(s: np.ndarray, steps: list[tuple], width: int, target: int, kind: str = "ols", alpha: float = 0.0, mix: float = 1.0) -> np.ndarray:
    """Intercept and slopes on the raw predictors."""
    f = feature_rows(s, resolved(steps, target), width)
    n, mu, sd, corr, cross, ym = standard_moments(s, f, target)
    b = least_squares(corr, cross) if kind == "ols" else penalised(corr, cross, n, kind, np.array([alpha]), np.array([mix]))[:, 0]
    b = b / sd
    out = f.T @ b
    out[0] += ym - b @ mu
    return out


def grid_of(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All (alpha, mix) pairs tried for a kind of model, in trial order."""
    if kind == "ridge":
        return RIDGE_GRID, np.zeros(len(RIDGE_GRID))
    if kind == "lasso":
        return LASSO_GRID, np.ones(len(LASSO_GRID))
    return np.repeat(LASSO_GRID, len(MIX_GRID)), np.tile(MIX_GRID, len(LASSO_GRID))


def default_penalty(kind: str) -> tuple[float, float]:
    a = RIDGE_GRID if kind == "ridge" else LASSO_GRID
    return float(np.median(a)), {"ridge": 0.0, "lasso": 1.0}.get(kind, float(np.median(MIX_GRID)))


def tune(train: np.ndarray, whole: np.ndarray, steps: list[tuple], width: int, target: int, kind: str) -> tuple[float, float]:
    """Penalty with the least error on the held-out months, features built on the training part.

    The held-out error follows from the difference of the two moment matrices.
    """
    n_train, n_val = train[0, 0], whole[0, 0] - train[0, 0]
    if n_train < 10 or n_val < 3:
        return default_penalty(kind)
    alphas, mixes = grid_of(kind)
    f = feature_rows(train, resolved(steps, target), width)
    n, mu, sd, corr, cross, ym = standard_moments(train, f, target)
    b = penalised(corr, cross, n, kind, alphas, mixes) / sd[:, None]
    coef = f.T @ b
    coef[0] += ym - mu @ b
    held = whole - train
    sse = held[target, target] - 2.0 * coef.T @ held[:width, target] + np.einsum("ik,ij,jk->k", coef, held[:width, :width], coef)
    best = int(np.argmin(sse))
    return float(alphas[best]), float(mixes[best])


def held_out_error(coef: np.ndarray, held: np.ndarray, width: int, target: int) -> np.ndarray:
    """Sums of squared errors of coefficient columns on the months whose moments are ``held``."""
    return held[target, target] - 2.0 * coef.T @ held[:width, target] + np.einsum("ik,ij,jk->k", coef, held[:width, :width], coef)


def fit_grid(s: np.ndarray, steps: list[tuple], width: int, target: int, alphas: np.ndarray | None) -> np.ndarray:
    """Intercept and slopes on the raw predictors, a column per penalty of the lasso; one column without penalties."""
    f = feature_rows(s, resolved(steps, target), width)
    n, mu, sd, corr, cross, ym = standard_moments(s, f, target)
    b = least_squares(corr, cross)[:, None] if alphas is None else descend(corr, cross, alphas, np.zeros(len(alphas)))
    b = b / sd[:, None]
    out = f.T @ b
    out[0] += ym - mu @ b
    return out


def choose(train: np.ndarray, whole: np.ndarray, variants: list[list[tuple]], width: int, target: int, alphas: np.ndarray | None) -> tuple[int, int, float | None]:
    """Numbers of the variant of features and of the penalty with the least held-out error, and its mean.

    Of equal errors the first in trial order wins: penalties outermost. Without months to judge by it is the first of both.
    """
    n_val = whole[0, 0] - train[0, 0]
    if train[0, 0] < 2 or n_val < 1:
        return 0, 0, None
    held = whole - train
    sse = np.array([held_out_error(fit_grid(train, v, width, target, alphas), held, width, target) for v in variants]).T
    at, variant = np.unravel_index(int(np.argmin(sse)), sse.shape)
    return int(variant), int(at), float(sse[at, variant] / n_val)
