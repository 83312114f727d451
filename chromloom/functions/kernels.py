"""Small numeric helpers that run inside tasks on one bounded group."""

from __future__ import annotations

import math

import numpy as np


def reflect_index(n: int, half: int) -> np.ndarray:
    """Source index of each padded position; the mirror repeats the edge sample."""
    k = np.arange(-half, n + half) % (2 * n)
    return np.where(k >= n, 2 * n - 1 - k, k)


def gaussian_blur(image: np.ndarray, sigma: float, truncate: float) -> np.ndarray:
    """Separable Gaussian blur with mirrored borders."""
    half = int(truncate * sigma + 0.5)
    x = np.arange(-half, half + 1)
    kernel = np.exp(-0.5 * (x / sigma) ** 2)
    kernel /= kernel.sum()
    out = image
    for axis in (0, 1):
        padded = np.take(out, reflect_index(out.shape[axis], half), axis=axis)
        windows = np.lib.stride_tricks.sliding_window_view(padded, len(kernel), axis=axis)
        out = windows @ kernel
    return out


def local_maxima(image: np.ndarray) -> np.ndarray:
    """Cells equal to the largest value of the 5x5 neighbourhood without its corners.

    Cells outside the image or NaN never win.
    """
    low = np.where(np.isnan(image), -np.inf, image)
    padded = np.pad(low, 2, constant_values=-np.inf)
    best = np.full(image.shape, -np.inf)
    for dr in range(5):
        for dc in range(5):
            if dr in (0, 4) and dc in (0, 4):
                continue
            best = np.maximum(best, padded[dr:dr + image.shape[0], dc:dc + image.shape[1]])
    return np.isfinite(low) & (low == best)


def _betacf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b), elementwise."""
    a, b, x = np.broadcast_arrays(*[np.asarray(v, dtype=float) for v in (a, b, x)])
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(
        _lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner)
    )
    swap = inner > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - inner, inner)
    part = front * _betacf(p, q, z) / p
    out = np.where(swap, 1.0 - part, part)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def student_two_sided(t, df) -> np.ndarray:
    """Two-sided p-value of a t statistic; NaN where t or df is NaN."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)
    safe_t, safe_df = np.where(ok, t, 0.0), np.where(ok, df, 1.0)
    return np.where(ok, betainc(safe_df / 2.0, 0.5, safe_df / (safe_df + safe_t**2)), np.nan)


def mann_whitney_counts(nx: int, ny: int) -> np.ndarray:
    """Number of arrangements giving each U = 0..nx*ny without ties."""
    nx, ny = min(nx, ny), max(nx, ny)
    counts = np.zeros(nx * ny + 1)
    counts[0] = 1.0
    # generating function of the Gaussian binomial: multiply by (1-q^(ny+k)), divide by (1-q^k)
    for k in range(1, nx + 1):
        counts[ny + k:] = counts[ny + k:] - counts[:max(len(counts) - ny - k, 0)].copy()
        for r in range(k):
            counts[r::k] = np.cumsum(counts[r::k])
    return counts


def mann_whitney_p(u: float, nx: int, ny: int, ties: np.ndarray) -> float:
    """Two-sided p of U: exact for untied samples with a side of at most eight values, else the
    normal approximation with tie and continuity corrections."""
    hi = max(u, nx * ny - u)
    if not len(ties) and min(nx, ny) <= 8:
        counts = mann_whitney_counts(nx, ny)
        return float(min(1.0, 2.0 * counts[int(math.ceil(hi)):].sum() / counts.sum()))
    n = nx + ny
    tie_sum = float(np.sum(ties.astype(float) ** 3 - ties)) if len(ties) else 0.0
    sd = math.sqrt(nx * ny / 12.0 * ((n + 1) - tie_sum / (n * (n - 1))))
    if sd == 0:
        return 1.0
    z = (hi - nx * ny / 2.0 - 0.5) / sd
    return float(min(1.0, math.erfc(z / math.sqrt(2.0))))
