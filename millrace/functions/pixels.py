"""Features of decoded frames: Arrow-batched, as no built-in function reads pixels.

Everything is plain array work on stacks of frames of one size: most of a small frame's time would else be calls.  Arrays
are ``(..., height, width)``; what is said of a frame has the shape of the leading axes.  Faces need a trained detector and come in through a port, as a function of one
grey picture.  Edges are Canny's: Sobel gradients, thinning along the gradient, hysteresis between two limits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

FEATURES = "grayscale double, black_border double, color double"
ALL_FEATURES = f"{FEATURES}, text double, edges double, bright double, face boolean"
# Limits of a grey pixel's channel spread, a dark one's light, a coloured one's saturation and value.
GREY_SPREAD, DARK, SATURATED, LIT = 25, 15, 50, 50
LIGHT_WEIGHTS = (0.299, 0.587, 0.114)
# Gradient limits for text and for edges; how far edges of a text grow; a text block's least width over
# height and area and its most height; a bright pixel's light and a bright block's least share.
TEXT_EDGES, EDGES = (100, 200), (50, 150)
GROW_WIDTH, GROW_HEIGHT = 15, 3
TEXT_ASPECT, TEXT_AREA, TEXT_HEIGHT = 2.0, 200, 0.1
BRIGHT, BRIGHT_SHARE = 200, 0.05
# Pixels of a stack, which bound its memory; a larger frame is a stack of its own.
STACK_PIXELS = 1 << 16


def light(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb.astype(np.float64) @ np.array(LIGHT_WEIGHTS))


def frame_features(rgb: np.ndarray) -> tuple[np.ndarray, ...]:
    """Shares of frames (..., height, width, 3): grey, near-black and coloured pixels."""
    return _shares(rgb, light(rgb))


def _shares(rgb: np.ndarray, grey: np.ndarray) -> tuple[np.ndarray, ...]:
    r, g, b = (rgb[..., k] for k in range(3))
    top = np.maximum(np.maximum(r, g), b)
    spread = top - np.minimum(np.minimum(r, g), b)
    saturation = np.rint(255 * spread.astype(np.float64) / np.maximum(top, 1))
    masks = spread < GREY_SPREAD, grey < DARK, (saturation > SATURATED) & (top > LIT)
    return tuple(m.mean(axis=(-2, -1)) for m in masks)


def _runs(masks: np.ndarray, diagonal: bool) -> tuple[np.ndarray, ...]:
    """Runs of the rows of a stack of masks: start, stop and part (from 0, in the order of their first runs).

    Places count on one line through all rows, each with an empty place at both ends, and an empty row behind each picture.
    """
    line, reach = masks.shape[2] + 2, int(diagonal)
    flat = np.pad(masks, ((0, 0), (0, 1), (1, 1))).ravel()
    turns = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    start, stop = turns[::2], turns[1::2]
    # A run's neighbours in the next row lie side by side
    first = np.searchsorted(stop, start + (line - reach), side="right")
    behind = np.searchsorted(start, stop + (line + reach), side="left")
    many = np.maximum(behind - first, 0)
    x = np.repeat(np.arange(len(start)), many)
    y = np.arange(len(x)) + np.repeat(first - (np.cumsum(many) - many), many)
    # Roots hook to the least root that they touch until none touches another
    own = np.arange(len(start))
    parent = own.copy()
    while len(x):
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        x, y = parent[x], parent[y]
        x, y = x[x != y], y[x != y]
    return start, stop, (np.cumsum(parent == own) - 1)[parent]


def _places(start: np.ndarray, height: int, width: int) -> tuple[np.ndarray, ...]:
    """Picture, row and column of places on the line of ``_runs``."""
    row, column = np.divmod(start, width + 2)
    return *np.divmod(row, height + 1), column - 1


def components(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Numbers from 1 of the connected parts of masks, and how many there are in all: runs of rows, joined where they touch."""
    start, stop, part = _runs(mask.reshape(-1, *mask.shape[-2:]), diagonal)
    out = np.zeros(mask.shape, np.int64)
    out[mask] = np.repeat(part + 1, stop - start)
    return out, int(part.max(initial=-1)) + 1


def _gradients(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of gradients, and where they are the largest along themselves."""
    height, width = grey.shape[-2:]
    around = lambda a, **how: np.pad(a, [(0, 0)] * (a.ndim - 2) + [(1, 1)] * 2, **how)
    g = around(grey.astype(np.float64), mode="reflect" if min(height, width) > 1 else "edge")
    cut = lambda i, j: g[..., i : i + height, j : j + width]
    dx = cut(0, 2) + 2 * cut(1, 2) + cut(2, 2) - cut(0, 0) - 2 * cut(1, 0) - cut(2, 0)
    dy = cut(2, 0) + 2 * cut(2, 1) + cut(2, 2) - cut(0, 0) - 2 * cut(0, 1) - cut(0, 2)
    x, y, slope = np.abs(dx), np.abs(dy), np.tan(np.pi / 8)
    size = x + y
    m = around(size)
    near = lambda i, j: m[..., 1 + i : 1 + i + height, 1 + j : 1 + j + width]
    flat, steep, rising = y < x * slope, y * slope > x, dx * dy > 0
    before = np.select([flat, steep, rising], [near(0, -1), near(-1, 0), near(-1, -1)], near(-1, 1))
    behind = np.select([flat, steep, rising], [near(0, 1), near(1, 0), near(1, 1)], near(1, -1))
    return size, (size > before) & (size >= behind)


def _edges(size: np.ndarray, peak: np.ndarray, low: float, high: float) -> np.ndarray:
    thin = peak & (size > low)
    number, n = components(thin)
    strong = np.zeros(n + 1, bool)
    strong[number[thin & (size > high)]] = True
    strong[0] = False
    return strong[number]


def canny(grey: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edge pixels."""
    return _edges(*_gradients(grey), low, high)


def grown(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    """The mask spread over a box around each pixel."""
    for axis, reach in ((-1, width // 2), (-2, height // 2)):
        n = mask.shape[axis]
        sums = np.cumsum(np.pad(mask.astype(np.int64), [(1, 0) if a == mask.ndim + axis else (0, 0) for a in range(mask.ndim)]), axis=axis)
        at = np.arange(n)
        mask = np.take(sums, np.minimum(at + reach + 1, n), axis=axis) - np.take(sums, np.maximum(at - reach, 0), axis=axis) > 0
    return mask


def text_score(grey: np.ndarray) -> np.ndarray:
    """Share of boxes around wide, low blocks of edges, which text makes."""
    return _text_score(canny(grey, *TEXT_EDGES))


def _text_score(edges: np.ndarray) -> np.ndarray:
    height, width = edges.shape[-2:]
    stack = grown(edges, GROW_WIDTH, GROW_HEIGHT).reshape(-1, height, width)
    start, stop, part = _runs(stack, True)
    picture, row, column = _places(start, height, width)
    n = part.max(initial=-1) + 1
    low, high, of = np.full((2, n), max(height, width)), np.full((2, n), -1), np.zeros(n, np.int64)
    for k, (a, b) in enumerate(((row, row), (column, column + stop - start - 1))):
        np.minimum.at(low[k], part, a)
        np.maximum.at(high[k], part, b)
    of[part] = picture
    h, w = high - low + 1
    text = (w / h > TEXT_ASPECT) & (w * h > TEXT_AREA) & (h < height * TEXT_HEIGHT)
    area = np.bincount(of[text], (w * h)[text], minlength=len(stack))
    return np.minimum(area / (height * width), 1.0).reshape(edges.shape[:-2])[()]


def outline_area(mask: np.ndarray) -> np.ndarray:
    """Area of the outline through a part's outer pixels, holes filled: inner points and half the outer ones, less one."""
    around = lambda a: np.pad(a, [(0, 0)] * (a.ndim - 2) + [(1, 1)] * 2)
    holes, _ = components(~around(mask), diagonal=False)
    filled = (holes != holes[..., :1, :1])[..., 1:-1, 1:-1]
    inner = around(filled)
    inside = filled & inner[..., :-2, 1:-1] & inner[..., 2:, 1:-1] & inner[..., 1:-1, :-2] & inner[..., 1:-1, 2:]
    inside, whole = inside.sum(axis=(-2, -1)), filled.sum(axis=(-2, -1))
    return np.maximum(0.0, inside + (whole - inside) / 2 - 1)


def bright_blocks(grey: np.ndarray) -> np.ndarray:
    """Share of large even bright areas, as slides have them."""
    height, width = grey.shape[-2:]
    stack, size = grey.reshape(-1, height, width), height * width
    least, lit = size * BRIGHT_SHARE, stack > BRIGHT
    start, stop, part = _runs(lit, True)
    pixels = np.bincount(part, stop - start)
    of, number = np.zeros(len(pixels), np.int64), np.full(stack.shape, -1)
    of[part], number[lit] = _places(start, height, width)[0], np.repeat(part, stop - start)
    parts = np.flatnonzero(pixels > least)
    of = of[parts]
    step, area = max(1, STACK_PIXELS // size), np.zeros(len(parts))
    for k in range(0, len(parts), step):
        some = slice(k, k + step)
        area[some] = outline_area(number[of[some]] == parts[some, None, None])
    whole = np.bincount(of, np.where(area > least, area, 0.0), minlength=len(stack))
    return np.minimum(whole / size, 1.0).reshape(grey.shape[:-2])[()]


def all_features(rgb: np.ndarray, face: Callable[[np.ndarray], bool] | None = None) -> tuple[np.ndarray, ...]:
    """All seven features of a stack of frames; no faces are seen without a detector."""
    grey = light(rgb)
    gradients = _gradients(grey)
    more = _text_score(_edges(*gradients, *TEXT_EDGES)), _edges(*gradients, *EDGES).mean(axis=(-2, -1)), bright_blocks(grey)
    return (*_shares(rgb, grey), *more, np.array([bool(face(g)) if face else False for g in grey]))


def _of(pixels, height, width, shape: str, stacked: Callable[[np.ndarray], tuple[np.ndarray, ...]]):
    names = [f.split()[0] for f in shape.split(", ")]

    @F.pandas_udf(shape)
    def run(raw: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
        frames, sizes = raw.to_list(), defaultdict(list)
        for k, (b, i, j) in enumerate(zip(frames, h, w, strict=True)):
            if b is not None and i > 0 and j > 0 and len(b) == int(i) * int(j) * 3:
                sizes[int(i), int(j)].append(k)
        out = {n: np.full(len(frames), None, object) for n in names}
        for (i, j), rows in sizes.items():
            step = max(1, STACK_PIXELS // (i * j))
            for some in (rows[k : k + step] for k in range(0, len(rows), step)):
                found = stacked(np.frombuffer(b"".join([frames[k] for k in some]), np.uint8).reshape(-1, i, j, 3))
                for n, values in zip(names, found, strict=True):
                    out[n][some] = values.tolist() if n == "face" else [round(x, 4) for x in values.tolist()]
        return pd.DataFrame(out).astype({n: "boolean" if n == "face" else "float64" for n in names})

    return run(pixels, height, width)


def features(pixels, height, width):
    """``struct(grayscale, black_border, color)`` of raw RGB bytes; nulls for null or ill-sized ones."""
    return _of(pixels, height, width, FEATURES, frame_features)


def frame_row(pixels, height, width, face: Callable[[np.ndarray], bool] | None = None):
    """All seven features of raw RGB bytes, to 4 places; nulls for null or ill-sized ones."""
    return _of(pixels, height, width, ALL_FEATURES, lambda rgb: all_features(rgb, face))
