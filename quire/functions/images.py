"""Kernels over page images: grey pixels as bytes with width and height. numpy within Arrow functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def array(pixels: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(height, width)


def crop(image: np.ndarray, box) -> np.ndarray:
    h, w = image.shape
    x0, y0, x1, y1 = (int(round(v)) for v in box)
    return image[max(0, y0) : max(0, min(h, y1)), max(0, x0) : max(0, min(w, x1))]


def ink(image: np.ndarray, box, threshold: int = 246) -> float:
    """Share of dark pixels; 0 for an empty box."""
    c = crop(image, box)
    return float((c < threshold).mean()) if c.size else 0.0


def runs(line: np.ndarray, gap: int = 2) -> list[tuple[int, int]]:
    """Spans of true values, of which those with at most `gap` between them are one."""
    at = np.flatnonzero(line)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > gap + 1)
    return list(zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + 1).tolist()))


def components(image: np.ndarray, box, threshold: int = 246, least: float = 0.0, gap: int = 2) -> list[tuple[int, int, int, int]]:
    """Boxes of ink from projections, first by rows, then by columns, then tight by rows again."""
    c = crop(image, box) < threshold
    ox, oy = max(0, int(round(box[0]))), max(0, int(round(box[1])))
    out = []
    for y0, y1 in runs(c.any(1), gap):
        for x0, x1 in runs(c[y0:y1].any(0), gap):
            rows = np.flatnonzero(c[y0:y1, x0:x1].any(1))
            b = (ox + x0, oy + y0 + int(rows[0]), ox + x1, oy + y0 + int(rows[-1]) + 1)
            if (b[2] - b[0]) * (b[3] - b[1]) >= least:
                out.append(b)
    return out


def connected(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """8-connected components of a mask: x0, y0, x1, y1, pixels; by spans of rows that touch."""
    boxes: dict[int, list[int]] = {}
    low: dict[int, int] = {}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    above, n = [], 0
    for y in range(mask.shape[0]):
        here = []
        for x0, x1 in runs(mask[y], 0):
            touching = [i for a, b, i in above if a <= x1 and x0 <= b]
            n += 1
            low[n] = n
            boxes[n] = [x0, y, x1, y + 1, x1 - x0]
            for t in touching:
                p, q = sorted((find(t), find(n)))
                if p != q:
                    low[q] = p
                    a, b = boxes[p], boxes.pop(q)
                    boxes[p] = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), a[4] + b[4]]
            here.append((x0, x1, n))
        above = here
    return sorted(tuple(b) for b in boxes.values())


def valley(image: np.ndarray, box, axis: int, threshold: int = 246, density: float = 0.015) -> tuple[int, int] | None:
    """The widest run of lines across the box with hardly any ink, neither first nor last. axis 1: columns."""
    c = crop(image, box) < threshold
    if not c.size:
        return None
    share = c.mean(0 if axis == 1 else 1)
    found = [(a, b) for a, b in runs(share <= density, 0) if a > 0 and b < len(share)]
    if not found:
        return None
    a, b = max(found, key=lambda s: (s[1] - s[0], -s[0]))
    base = max(0, int(round(box[0] if axis == 1 else box[1])))
    return base + a, base + b


def bridge(mask: np.ndarray, a, b) -> float:
    """Most foreground in a line of the corridor between two boxes; 0 if they meet."""
    if a[2] <= b[0] or b[2] <= a[0]:
        x0, x1 = sorted((a[2], b[0])) if a[2] <= b[0] else sorted((b[2], a[0]))
        part = mask[max(a[1], b[1]) : min(a[3], b[3]), x0:x1]
        return float(part.mean(0).max()) if part.size else 0.0
    if a[3] <= b[1] or b[3] <= a[1]:
        y0, y1 = (a[3], b[1]) if a[3] <= b[1] else (b[3], a[1])
        part = mask[y0:y1, max(a[0], b[0]) : min(a[2], b[2])]
        return float(part.mean(1).max()) if part.size else 0.0
    return 0.0


@F.pandas_udf(T.DoubleType())
def ink_ratio(pixels: pd.Series, width: pd.Series, height: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    return pd.Series([ink(array(p, w, h), b) for p, w, h, *b in zip(pixels, width, height, x0, y0, x1, y1)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("x0", "y0", "x1", "y1")])))
def ink_components(pixels: pd.Series, width: pd.Series, height: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("x0", "y0", "x1", "y1"), c)) for c in components(array(p, w, h), b)] for p, w, h, *b in zip(pixels, width, height, x0, y0, x1, y1)])
