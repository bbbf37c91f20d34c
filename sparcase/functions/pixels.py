"""Figures of images that are read pixel by pixel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: The smoothing kernel's deviation for five places, and the figures that count as full contrast and sharpness.
SIGMA, FULL_CONTRAST, FULL_SHARPNESS = 1.1, 127.5, 50.0
METRICS = ("blur", "noise", "contrast", "sharpness", "spread", "roughness", "edges")
#: Slopes over which a pixel may be on an edge, and over which it is.
WEAK_EDGE, STRONG_EDGE = 100, 200


def grey(content: bytes) -> np.ndarray | None:
    """The grey values of a binary portable graymap or pixmap of one byte a value; None for anything else."""
    if content[:2] not in (b"P5", b"P6"):
        return None
    fields, at = [], 2
    while len(fields) < 3:
        while at < len(content) and content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.find(b"\n", at) + 1
            if not at:
                return None
            continue
        end = at
        while end < len(content) and content[end : end + 1].isdigit():
            end += 1
        if end == at:
            return None
        fields.append(int(content[at:end]))
        at = end
    width, height, most = fields
    planes = 1 if content[:2] == b"P5" else 3
    data = np.frombuffer(content, np.uint8, offset=at + 1) if at + 1 <= len(content) else np.zeros(0, np.uint8)
    if most > 255 or not width * height or len(data) < width * height * planes:
        return None
    data = data[: width * height * planes].reshape(height, width, planes).astype(np.float64)
    return data[:, :, 0] if planes == 1 else np.rint(data @ [0.299, 0.587, 0.114])


def _filtered(image: np.ndarray, kernel: np.ndarray, mirrored: bool = True) -> np.ndarray:
    """Each pixel's neighbourhood weighted; beyond the border the image is mirrored, the border itself not repeated, or
    else the border goes on."""
    r, c = kernel.shape[0] // 2, kernel.shape[1] // 2
    pad = lambda n, k: "reflect" if mirrored and n > k else "edge"
    wide = np.pad(np.pad(image, ((r, r), (0, 0)), pad(image.shape[0], r)), ((0, 0), (c, c)), pad(image.shape[1], c))
    out = np.zeros(image.shape)
    for i in range(kernel.shape[0]):
        for j in range(kernel.shape[1]):
            if kernel[i, j]:
                out += kernel[i, j] * wide[i : i + image.shape[0], j : j + image.shape[1]]
    return out


LAPLACE = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], dtype=np.float64)
SOBEL = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], dtype=np.float64)


def edge_pixels(image: np.ndarray, weak: float = WEAK_EDGE, strong: float = STRONG_EDGE) -> np.ndarray:
    """Canny's edges: pixels steeper than both neighbours along the slope, that are strong or joined to strong ones by weak
    ones. Steepness is the sum of both slopes; directions are the four of the pixel grid."""
    x, y = _filtered(image, SOBEL, False), _filtered(image, SOBEL.T, False)
    steep = np.abs(x) + np.abs(y)
    wide = np.pad(steep, 1)
    at = lambda i, j: wide[1 + i : 1 + i + steep.shape[0], 1 + j : 1 + j + steep.shape[1]]
    flat = np.tan(np.pi / 8)
    across, down = np.abs(y) < flat * np.abs(x), np.abs(y) * flat > np.abs(x)
    falling = (x < 0) == (y < 0)
    first = np.select([across, down, falling], [at(0, -1), at(-1, 0), at(-1, -1)], at(-1, 1))
    second = np.select([across, down, falling], [at(0, 1), at(1, 0), at(1, 1)], at(1, -1))
    crest = (steep > weak) & (steep > first) & np.where(across | down, steep >= second, steep > second)
    found = crest & (steep > strong)
    while True:
        around = np.pad(found, 1)
        grown = crest & np.logical_or.reduce([around[1 + i : 1 + i + found.shape[0], 1 + j : 1 + j + found.shape[1]] for i in (-1, 0, 1) for j in (-1, 0, 1)])
        if (grown == found).all():
            return found
        found = grown


def metrics(image: np.ndarray) -> tuple[float, ...]:
    """The variance of the Laplacian; the deviation of what smoothing takes away; contrast and sharpness from 0 to 1; the
    deviation of the grey values; the mean absolute Laplacian; the share of pixels on edges."""
    edges = _filtered(image, LAPLACE)
    line = np.exp(-np.arange(-2.0, 3.0) ** 2 / (2 * SIGMA**2))
    smooth = np.rint(_filtered(image, np.outer(line, line) / line.sum() ** 2))
    slope = np.hypot(_filtered(image, SOBEL), _filtered(image, SOBEL.T))
    clamp = lambda x: float(min(1.0, max(0.0, x)))
    return float(edges.var()), float(np.abs(image - smooth).std()), clamp(image.std() / FULL_CONTRAST), clamp(slope.mean() / FULL_SHARPNESS), float(image.std()), float(np.abs(edges).mean()), float(edge_pixels(image).mean())


@pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType()), *(StructField(m, DoubleType()) for m in METRICS)]))
def pixel_metrics(contents: pd.Series) -> pd.DataFrame:
    """Size and metrics of each image; nulls for null and for what grey can't read."""
    rows = []
    for c in contents:
        image = None if c is None else grey(bytes(c))
        rows.append((None,) * (2 + len(METRICS)) if image is None else (image.shape[1], image.shape[0], *metrics(image)))
    out = pd.DataFrame(rows, columns=["width", "height", *METRICS])
    return out.astype({"width": "Int32", "height": "Int32", **dict.fromkeys(METRICS, "Float64")})
