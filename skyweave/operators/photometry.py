"""Pixel photometry of cut-outs: one grouped map a frame, vectorised over its targets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SUBPIXELS = 5
OUTPUT = "frame_id string, target_id string, flux double, flux_unc double, area double, background double, background_unc double, n_bad long, flags long, status string"


def circle_weights(size: int, x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
    """Share of each pixel inside a circle, by SUBPIXELS^2 points a pixel; (targets, size, size)."""
    step = (np.arange(SUBPIXELS) + 0.5) / SUBPIXELS - 0.5
    at = np.arange(size)[:, None] + step[None, :]
    dx = (at[None] - x[:, None, None]) ** 2
    dy = (at[None] - y[:, None, None]) ** 2
    inside = dy[:, :, :, None, None] + dx[:, None, None, :, :] <= radius * radius
    return inside.mean(axis=(2, 4))


def sigma_clip(values: np.ndarray, sigmas: float = 3.0, rounds: int = 5) -> np.ndarray:
    for _ in range(rounds):
        if len(values) == 0:
            break
        mid, sd = np.median(values), values.std()
        kept = values[np.abs(values - mid) <= sigmas * sd] if sd > 0 else values
        if len(kept) == len(values):
            break
        values = kept
    return values


def bilinear(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values between pixel centres; NaN outside."""
    h, w = image.shape
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    good = (x0 >= 0) & (y0 >= 0) & (x0 + 1 < w) & (y0 + 1 < h)
    a, b = np.clip(x0, 0, w - 2), np.clip(y0, 0, h - 2)
    fx, fy = x - x0, y - y0
    out = image[b, a] * (1 - fx) * (1 - fy) + image[b, a + 1] * fx * (1 - fy) + image[b + 1, a] * (1 - fx) * fy + image[b + 1, a + 1] * fx * fy
    return np.where(good, out, np.nan)


def aperture_photometry(frames: DataFrame, targets: DataFrame, radius: float = 2.0, inner: float = 4.0, outer: float = 7.0, fatal_mask: int = 0) -> DataFrame:
    """``frames`` (frame_id, image array<array<double>>, variance, flags), ``targets`` (frame_id,
    target_id, x, y). Background is the clipped median of an annulus."""

    def frame(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        cols = [c.split()[0] for c in OUTPUT.split(", ")]
        if not len(a) or not len(b):
            return pd.DataFrame(columns=cols)
        image, variance, flags = (np.array([list(r) for r in a.iloc[0][c]]) for c in ("image", "variance", "flags"))
        size = image.shape[0]
        x, y = b["x"].to_numpy(float), b["y"].to_numpy(float)
        weights = circle_weights(size, x, y, radius)
        yy, xx = np.mgrid[:size, :size]
        bad = (flags.astype(np.int64) & fatal_mask) != 0
        rows = []
        for k, target in enumerate(b["target_id"]):
            if min(x[k], y[k], size - 1 - x[k], size - 1 - y[k]) < outer:
                rows.append((a.iloc[0]["frame_id"], target, None, None, None, None, None, 0, 0, "outside_or_edge"))
                continue
            r = np.hypot(xx - x[k], yy - y[k])
            ring = sigma_clip(image[(r >= inner) & (r <= outer) & ~bad])
            w = weights[k]
            area = float(w.sum())
            level = float(np.median(ring)) if len(ring) else 0.0
            spread = float(ring.std()) if len(ring) else 0.0
            flux = float((w * image).sum() - area * level)
            noise = float(np.sqrt((w * w * variance).sum() + area * area * spread * spread / max(1, len(ring))))
            used = w > 0
            rows.append((a.iloc[0]["frame_id"], target, flux, noise, area, level, spread, int((bad & used).sum()), int(np.bitwise_or.reduce(flags[used].astype(np.int64))), "ok"))
        return pd.DataFrame(rows, columns=cols)

    return frames.groupBy("frame_id").cogroup(targets.groupBy("frame_id")).applyInPandas(frame, OUTPUT)


def psf_fit(image: np.ndarray, variance: np.ndarray, psf: np.ndarray) -> tuple[float, float, float, float]:
    """(flux, its deviation, background, chi square) of a weighted fit of PSF plus constant."""
    w = 1.0 / np.maximum(variance, 1e-12)
    pp, p1, one, pd_, d1 = (w * psf * psf).sum(), (w * psf).sum(), w.sum(), (w * psf * image).sum(), (w * image).sum()
    det = pp * one - p1 * p1
    if det <= 0:
        return float("nan"), float("nan"), float("nan"), float("nan")
    flux, back = (one * pd_ - p1 * d1) / det, (pp * d1 - p1 * pd_) / det
    return float(flux), float(np.sqrt(one / det)), float(back), float((w * (image - flux * psf - back) ** 2).sum())


def gaussian_psf(size: int, x: float, y: float, sigma: float) -> np.ndarray:
    yy, xx = np.mgrid[:size, :size]
    g = np.exp(-0.5 * ((xx - x) ** 2 + (yy - y) ** 2) / sigma**2)
    return g / g.sum()


def psf_photometry(cutouts: DataFrame, sigma: float = 1.2, reach: float = 1.0, step: float = 0.5) -> DataFrame:
    """``cutouts`` (target_id, image, variance, x, y): best fit over a grid of centre offsets."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offsets = np.arange(-reach, reach + step / 2, step)
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                image, variance = np.array([list(v) for v in r.image]), np.array([list(v) for v in r.variance])
                best = None
                for dy in offsets:
                    for dx in offsets:
                        got = psf_fit(image, variance, gaussian_psf(len(image), r.x + dx, r.y + dy, sigma))
                        if np.isfinite(got[0]) and (best is None or got[3] < best[3]):
                            best = (*got, dx, dy)
                rows.append((r.target_id, *(best or (None,) * 6)))
            yield pd.DataFrame(rows, columns=["target_id", "psf_flux", "psf_flux_unc", "psf_background", "chi2", "dx", "dy"])

    return cutouts.select("target_id", "image", "variance", "x", "y").mapInPandas(fit, "target_id string, psf_flux double, psf_flux_unc double, psf_background double, chi2 double, dx double, dy double")
