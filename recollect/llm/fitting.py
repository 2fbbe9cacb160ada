"""Small numpy models shared by the classifiers: fitted on the driver on samples of a stated bound, or in tasks on parts of all examples."""

from __future__ import annotations

import numpy as np


def softmax_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, rounds: int = 400, ridge: float = 1e-3):
    """Multinomial logistic regression by gradient descent on standardized columns: (mean, scale, coefficients)."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    b = np.zeros((z.shape[1], classes))
    target = np.eye(classes)[y]
    for _ in range(rounds):
        s = z @ b
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        b -= z.T @ ((p - target) * weight[:, None]) / weight.sum() + ridge * b
    return mean, scale, b


def softmax_classes(model, x: np.ndarray) -> np.ndarray:
    mean, scale, b = model
    return (np.c_[(x - mean) / scale, np.ones(len(x))] @ b).argmax(1)


def logistic_fit(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, width: int, weight: np.ndarray | None = None, rounds: int = 150, ridge: float = 1.0, also: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression on hashed binary features given as (row, column) pairs.

    Accelerated gradient descent, each coordinate scaled by a bound of its curvature; ``ridge`` counts as so many examples.
    ``also``: a further feature, given as a number of each row, that is fitted but not returned.
    """
    n = len(y)
    weight = np.ones(n) if weight is None else weight
    also = np.zeros(n) if also is None else also.astype(float)
    size = np.bincount(rows, minlength=n)
    order = np.argsort(size, kind="stable")  # rows of so many features each stand together, to be added feature by feature
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    y, weight, also = y[order], weight[order], also[order]
    used = np.flatnonzero(np.bincount(columns, minlength=width))
    number = np.zeros(width, np.int64)
    number[used] = np.arange(len(used))
    at, rows_of = number[columns], place[rows]
    curvature = np.append(np.bincount(at, weight[rows_of], len(used)), np.sum(weight * also))
    step = 1 / ((size[order] + also).max() * (0.25 * curvature + ridge))
    first = np.cumsum(size) - size
    by = np.argsort(rows, kind="stable")
    blocks, by_row = [], []
    for k in np.unique(size[size > 0]):
        low, high = np.searchsorted(size[order], (k, k + 1))
        blocks.append((slice(low, high), slice(sum(map(len, by_row)), sum(map(len, by_row)) + k * (high - low)), k))
        by_row.append(at[by[first[order[low:high]] + np.arange(k)[:, None]]].ravel())
    by_row = np.concatenate(by_row)
    by = np.argsort(at.astype(np.uint16) if len(used) <= 1 << 16 else at, kind="stable")  # two bytes are sorted by radix
    by_column, column_starts = rows_of[by], np.searchsorted(at[by], np.arange(len(used)))
    score, w, g, buffer = np.zeros(n), np.zeros(len(step)), np.zeros(len(step)), np.zeros(len(at))
    ahead, t = w, 1.0
    for _ in range(rounds):
        ahead.take(by_row, out=buffer, mode="clip")
        for those, part, k in blocks:
            np.add.reduce(buffer[part].reshape(k, -1), axis=0, out=score[those])
        err = (1 / (1 + np.exp(-np.clip(score + ahead[-1] * also, -30, 30))) - y) * weight
        g[:-1] = np.add.reduceat(err.take(by_column, out=buffer, mode="clip"), column_starts)
        g[-1] = np.sum(err * also)
        g += ridge * ahead
        new = ahead - step * g
        following = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / following * (new - w)
        if g @ (new - w) > 0:  # uphill: start over from here
            ahead, following = new, 1.0
        w, t = new, following
    out = np.zeros(width)
    out[used] = w[:-1]
    return out


def logistic_scores(rows: np.ndarray, columns: np.ndarray, n: int, w: np.ndarray) -> np.ndarray:
    """The log-odds of each of n rows."""
    return np.bincount(rows, w[columns], n)
