"""Features of images in NumPy, and the same over columns of pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of red, green and blue in gray, and the thresholds of an edge.
GRAY = (0.299, 0.587, 0.114)
LOW, HIGH = 40, 100
FEATURES = 4 * 4 * 3 + 3 * 3 + 10 + 1


def area_weights(n: int, m: int) -> np.ndarray:
    """(m, n): which part of each of n cells goes into each of m, rows sum to 1."""
    edges = np.arange(m + 1) * (n / m)
    lo, hi = edges[:-1, None], edges[1:, None]
    cells = np.arange(n)[None, :]
    part = np.clip(np.minimum(hi, cells + 1) - np.maximum(lo, cells), 0, None)
    return part / part.sum(axis=1, keepdims=True)


def resize_area(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Means of the area that each pixel of the new image covers, rounded as the image's type needs."""
    if image.shape[:2] == (height, width):
        return image
    out = np.einsum("yh,hwc,xw->yxc", area_weights(image.shape[0], height), image.reshape(*image.shape[:2], -1).astype(float), area_weights(image.shape[1], width))
    out = out.reshape(height, width, *image.shape[2:])
    return np.clip(np.rint(out), 0, 255).astype("u1") if image.dtype == np.uint8 else out


def pad_resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image at its own proportions in the middle of a black one."""
    scale = min(width / image.shape[1], height / image.shape[0])
    w, h = max(1, round(image.shape[1] * scale)), max(1, round(image.shape[0] * scale))
    small = resize_area(image, min(w, width), min(h, height)) if scale <= 1 else image.repeat(-(-h // image.shape[0]), 0).repeat(-(-w // image.shape[1]), 1)[:h, :w]
    out = np.zeros((height, width, *image.shape[2:]), image.dtype)
    y, x = (height - small.shape[0]) // 2, (width - small.shape[1]) // 2
    out[y : y + small.shape[0], x : x + small.shape[1]] = small
    return out


def to_bytes(image: np.ndarray) -> np.ndarray:
    """Floats from 0 to 1 as bytes; bytes as they are."""
    return image if image.dtype == np.uint8 else np.clip(image * 255, 0, 255).astype("u1")


def gray(image: np.ndarray) -> np.ndarray:
    """Gray bytes of an RGB image of bytes."""
    return np.clip(np.rint(image.astype(float) @ np.array(GRAY)), 0, 255).astype("u1")


def edges(image: np.ndarray, low: int = LOW, high: int = HIGH) -> np.ndarray:
    """Where a gray image has edges: ridges of the gradient of at least `high`, and of at least `low` where they touch such."""
    p = np.pad(image.astype(int), 1, mode="edge")
    rows, cols = p[:-2] + 2 * p[1:-1] + p[2:], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    gx, gy = rows[:, 2:] - rows[:, :-2], cols[2:] - cols[:-2]
    size = np.abs(gx) + np.abs(gy)
    around = np.pad(size, 1)
    at = lambda dy, dx: around[1 + dy : 1 + dy + size.shape[0], 1 + dx : 1 + dx + size.shape[1]]
    flat, steep = np.abs(gy) < np.tan(np.pi / 8) * np.abs(gx), np.abs(gy) > np.tan(3 * np.pi / 8) * np.abs(gx)
    falls = (gx < 0) != (gy < 0)
    first = np.select([flat, steep, falls], [at(0, -1), at(-1, 0), at(-1, 1)], at(-1, -1))
    second = np.select([flat, steep, falls], [at(0, 1), at(1, 0), at(1, -1)], at(1, 1))
    ridge = (size > first) & (size >= second) & (size > low)
    found = ridge & (size > high)
    while True:
        wide = np.pad(found, 1)
        near = np.zeros_like(found)
        for dy in range(3):
            for dx in range(3):
                near |= wide[dy : dy + found.shape[0], dx : dx + found.shape[1]]
        more = ridge & near
        if (more == found).all():
            return found
        found = more


def frame_feature(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """68 numbers of an RGB image: means of a 4 x 4 grid, mean and deviation of each colour, mean of the middle, 10 parts of gray, part of edges."""
    rgb = resize_area(image, width, height).astype(float) / 255
    grid = rgb.reshape(4, height // 4, 4, width // 4, 3).mean(axis=(1, 3)).reshape(-1)
    middle = rgb[height // 4 : 3 * height // 4, width // 4 : 3 * width // 4].mean(axis=(0, 1))
    shade = rgb @ np.array(GRAY)
    parts = np.histogram(shade, bins=10, range=(0.0, 1.0))[0]
    edge = edges((shade * 255).astype("u1")).mean()
    return np.concatenate([grid, rgb.mean(axis=(0, 1)), rgb.std(axis=(0, 1)), middle, parts / max(parts.sum(), 1), [edge]])


def motion(a: np.ndarray, b: np.ndarray) -> float:
    """Mean difference of two gray images."""
    return float(np.abs(a.astype(int) - b.astype(int)).mean())


def _image(raw: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(raw, "u1").reshape(height, width, 3)


def features_of(pixels: Column, width: Column, height: Column, size: tuple[int, int]) -> Column:
    """frame_feature of RGB pixels (binary, row by row), resized to size (width, height, both divisible by 4)."""

    @F.pandas_udf("array<double>")
    def run(p: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([frame_feature(_image(x, a, b), *size).tolist() for x, a, b in zip(p, w, h, strict=True)])

    return run(pixels, width, height)


def gray_of(pixels: Column, width: Column, height: Column, size: tuple[int, int]) -> Column:
    """The gray bytes of RGB pixels resized to size."""

    @F.pandas_udf("binary")
    def run(p: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([gray(resize_area(_image(x, a, b), *size)).tobytes() for x, a, b in zip(p, w, h, strict=True)])

    return run(pixels, width, height)


def motion_between(a: Column, b: Column) -> Column:
    """motion of two columns of gray bytes; 0 where the second is null."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([0.0 if q is None else motion(np.frombuffer(p, "u1"), np.frombuffer(q, "u1")) for p, q in zip(x, y, strict=True)], dtype=float)

    return run(a, b)
