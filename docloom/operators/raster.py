"""Page rasters: ink masks, components, lines, rules, boxes, skew, columns, warping and comparison, as numpy
kernels; ``per_page`` applies one to a frame of pages, one Arrow batch at a time.

A page is 8-bit luminance or RGB of shape (height, width[, 3]). Masks are boolean, True for ink.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def luma(image: np.ndarray) -> np.ndarray:
    """Luminance with the weights 299, 587 and 114."""
    if image.ndim == 2:
        return image.astype(np.float64)
    return (image[..., :3].astype(np.int64) @ np.array([299, 587, 114])) / 1000


def otsu(gray: np.ndarray, low: int = 160, high: int = 205) -> int:
    """The level of the largest between-class variance, the lowest on ties, kept within bounds."""
    n = np.bincount(gray.astype(np.int64).ravel().clip(0, 255), minlength=256).astype(float)
    levels = np.arange(256)
    n0, s0 = np.cumsum(n), np.cumsum(n * levels)
    n1, s1 = n.sum() - n0, (n * levels).sum() - s0
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.where((n0 > 0) & (n1 > 0), n0 * n1 * (s0 / n0 - s1 / n1) ** 2, -1)
    return int(np.clip(np.argmax(np.round(v, 3)), low, high))


def ink(image: np.ndarray, threshold: int | None = None, tiles: int = 0) -> np.ndarray:
    """Pixels darker than a threshold; with tiles, each tile has its own within 25 levels of the page's."""
    gray = luma(image)
    t = otsu(gray) if threshold is None else threshold
    if not tiles:
        return gray < t
    out = np.zeros(gray.shape, bool)
    for rows in np.array_split(np.arange(gray.shape[0]), tiles):
        for cols in np.array_split(np.arange(gray.shape[1]), tiles):
            if len(rows) and len(cols):
                part = gray[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1]
                out[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1] = part < np.clip(otsu(part, 0, 255), t - 25, t + 25)
    return out


def spans(row: np.ndarray, gap: int = 0) -> np.ndarray:
    """[start, end) of the runs of True; runs parted by at most ``gap`` are joined."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]]))).reshape(-1, 2)
    if gap and len(edges):
        keep = np.append(True, edges[1:, 0] - edges[:-1, 1] > gap)
        edges = np.stack([edges[keep, 0], edges[np.append(keep[1:], True), 1]], axis=1)
    return edges


def components(mask: np.ndarray, least: int = 1, eight: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(x0, y0, x1, y1, pixels) of connected areas: runs of a row are joined to those they touch in the row above."""
    parent: list[int] = []
    boxes: list[list[int]] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    for y in range(mask.shape[0]):
        here = []
        k = 0
        for a, b in spans(mask[y]):
            me = len(parent)
            parent.append(me)
            boxes.append([int(a), y, int(b) - 1, y, int(b - a)])
            reach = int(eight)
            while k < len(above) and above[k][1] + reach <= a:
                k += 1
            j = k
            while j < len(above) and above[j][0] < b + reach:
                p, q = find(above[j][2]), find(me)
                if p != q:
                    p, q = min(p, q), max(p, q)
                    parent[q] = p
                    u, v = boxes[p], boxes[q]
                    boxes[p] = [min(u[0], v[0]), min(u[1], v[1]), max(u[2], v[2]), max(u[3], v[3]), u[4] + v[4]]
                j += 1
            here.append((int(a), int(b), me))
        above = here
    return sorted(tuple(boxes[i]) for i in range(len(parent)) if find(i) == i and boxes[i][4] >= least)


def clean(mask: np.ndarray, least: int) -> np.ndarray:
    """Without specks of fewer pixels and without areas that touch the border."""
    out = mask.copy()
    h, w = mask.shape
    for x0, y0, x1, y1, n in components(mask, eight=False):
        if n < least or x0 == 0 or y0 == 0 or x1 == w - 1 or y1 == h - 1:
            out[y0 : y1 + 1, x0 : x1 + 1] &= False
    return out


def lines(mask: np.ndarray, least: int = 2) -> list[tuple[int, int]]:
    """Text lines as row ranges; bands under a third of the upper median height join the nearer neighbour."""
    bands = [(int(a), int(b)) for a, b in spans(mask.any(axis=1)) if b - a >= least]
    if len(bands) < 3:
        return bands
    heights = sorted(b - a for a, b in bands)
    small = heights[len(heights) // 2] / 3
    out: list[list[int]] = []
    for i, (a, b) in enumerate(bands):
        before = a - out[-1][1] if out else 1 << 30
        after = bands[i + 1][0] - b if i + 1 < len(bands) else 1 << 30
        if b - a < small and out and before <= after:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def column_lines(mask: np.ndarray, gutter: int) -> list[tuple[int, int, int, int]]:
    """Text lines of each column; columns are parted by empty stripes of ``gutter`` pixels or more."""
    return [(int(a), y0, int(b), y1) for a, b in spans(mask.any(axis=0), gutter - 1) for y0, y1 in lines(mask[:, a:b])]


def horizontal_rules(mask: np.ndarray, share: float = 0.8, gap: int = 0) -> list[tuple[int, int]]:
    """Row ranges in which one run (broken by at most ``gap``) covers a share of the width."""
    long = np.array([max((b - a for a, b in spans(r, gap)), default=0) >= share * mask.shape[1] for r in mask], bool)
    return [(int(a), int(b)) for a, b in spans(long)]


def vertical_rules(mask: np.ndarray, share: float = 0.8, gap: int = 0) -> list[tuple[int, int]]:
    return horizontal_rules(mask.T, share, gap)


def frames(mask: np.ndarray, least: int = 20) -> list[tuple[int, int, int, int]]:
    """Rectangles: components whose four sides are inked for 90 % or more."""
    out = []
    for x0, y0, x1, y1, _ in components(mask, least):
        if x1 - x0 >= least and y1 - y0 >= least:
            sides = (mask[y0 : y0 + 3, x0 : x1 + 1].any(0), mask[y1 - 2 : y1 + 1, x0 : x1 + 1].any(0), mask[y0 : y1 + 1, x0 : x0 + 3].any(1), mask[y0 : y1 + 1, x1 - 2 : x1 + 1].any(1))
            if min(s.mean() for s in sides) >= 0.9:
                out.append((x0, y0, x1, y1))
    return out


def page_frame(mask: np.ndarray) -> str:
    """none, single or double: frames that span 80 % of the page either way."""
    h, w = mask.shape
    n = sum(1 for x0, y0, x1, y1 in frames(mask) if x1 - x0 >= 0.8 * w and y1 - y0 >= 0.8 * h)
    return ("none", "single", "double")[min(n, 2)]


def digit_boxes(mask: np.ndarray, least: int = 3) -> list[list[tuple[int, int, int, int]]]:
    """Rows of small boxes of like size that stand side by side."""
    boxes = sorted((f for f in frames(mask, 8) if f[2] - f[0] < 80 and 0.6 <= (f[2] - f[0]) / (f[3] - f[1]) <= 1.6), key=lambda f: (f[1], f[0]))
    rows: list[list] = []
    for b in boxes:
        row = next((r for r in rows if abs(r[-1][1] - b[1]) <= 4 and abs((r[-1][3] - r[-1][1]) - (b[3] - b[1])) <= 4), None)
        if row:
            row.append(b)
        else:
            rows.append([b])
    return [r for r in rows if len(r) >= least]


def grid(mask: np.ndarray, share: float = 0.5) -> list[list[tuple[int, int, int, int]]]:
    """Cells between the rules of a table, row by row."""
    mid = lambda rs: [(a + b) // 2 for a, b in rs]
    ys, xs = mid(horizontal_rules(mask, share)), mid(vertical_rules(mask, share))
    return [[(x0, y0, x1, y1) for x0, x1 in zip(xs, xs[1:], strict=False)] for y0, y1 in zip(ys, ys[1:], strict=False)]


def rows_in_bands(estimates: list[int], inked: list[int], blank: list[bool]) -> list[int]:
    """For each row in order the band it belongs to: counts of lines fit best, blank rows go to bands without ink."""
    n, m = len(estimates), len(inked)
    best = np.full((m + 1, n + 1), np.inf)
    back = np.zeros((m + 1, n + 1), int)
    best[0, 0] = 0
    for b in range(m):
        for j in range(n + 1):
            for i in range(j + 1):
                rows = range(i, j)
                cost = abs(sum(estimates[r] for r in rows if not blank[r]) - inked[b]) + 0.5 * sum(blank[r] for r in rows) * (inked[b] > 0) + (2 if inked[b] and i == j else 0)
                if best[b, i] + cost < best[b + 1, j]:
                    best[b + 1, j], back[b + 1, j] = best[b, i] + cost, i
    out, j = [0] * n, n
    for b in range(m, 0, -1):
        i = back[b, j]
        out[i:j] = [b - 1] * (j - i)
        j = i
    return out


def aligned(a: list[tuple[int, int]], b: list[tuple[int, int]], height: int, reach: float = 0.08) -> list[tuple[int, int]]:
    """Order-preserving pairs of bands whose middles are at most a share of the height apart: most pairs, then least distance."""
    mid = lambda x: (x[0] + x[1]) / 2
    n, m = len(a), len(b)
    best = [[(0, 0.0)] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1])
            d = abs(mid(a[i]) - mid(b[j]))
            if d <= reach * height:
                k, s = best[i + 1][j + 1]
                best[i][j] = max(best[i][j], (k + 1, s - d))
    out, i, j = [], 0, 0
    while i < n and j < m:
        d = abs(mid(a[i]) - mid(b[j]))
        k, s = best[i + 1][j + 1]
        if d <= reach * height and best[i][j] == (k + 1, s - d):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def shifted_rows(mask: np.ndarray, degrees: float) -> np.ndarray:
    """Ink per row after shearing by an angle."""
    y, x = np.nonzero(mask)
    rows = np.round(y - (x - mask.shape[1] / 2) * np.tan(np.radians(degrees))).astype(int)
    return np.bincount(rows - rows.min(), minlength=1) if len(rows) else np.zeros(1, int)


def skew(mask: np.ndarray, reach: float = 8.0, step: float = 0.25) -> float:
    """The angle, of steps within reach, at which rows vary most; the smallest turn on ties."""
    angles = np.arange(-reach, reach + step / 2, step)
    scores = [np.sum(shifted_rows(mask, a).astype(float) ** 2) for a in angles]
    top = max(scores)
    return float(min((a for a, s in zip(angles, scores, strict=True) if s >= top * (1 - 1e-9)), key=abs))


def orientation(mask: np.ndarray) -> int:
    """By how many degrees to turn a page clockwise: 0, or 90 or 270 if its text lies on its side.

    Text lies on its side if columns vary more than rows. The dense stroke of a line is in its upper part, so its side
    tells where the top is; else the straighter margin is the left one. What tells neither stays.
    """
    rows, cols = mask.mean(axis=1), mask.mean(axis=0)
    if not cols.var() > 1.3 * rows.var():
        return 0
    h = mask.shape[0]
    ink_at = np.convolve(np.pad(mask[int(0.15 * h) : int(0.85 * h)].sum(axis=0).astype(float), 1, mode="edge"), np.ones(3) / 3, "valid")
    peaks = [np.argmax(ink_at[x0:x1]) / (x1 - x0 - 1) for x0, x1 in spans(ink_at > 0.35 * ink_at.mean()) if 6 <= x1 - x0 <= 80]
    upper, lower = sum(p <= 0.42 for p in peaks), sum(p >= 0.58 for p in peaks)
    if abs(upper - lower) >= 2:
        return 90 if upper > lower else 270
    lined = mask[:, mask.sum(axis=0) >= max(3, round(0.02 * h))]
    if lined.shape[1] < 3:
        return 0
    first, last = np.argmax(lined, axis=0).var(), np.argmax(lined[::-1], axis=0).var()
    return 90 if last < 0.8 * first else 270 if first < 0.8 * last else 0


def spread(mask: np.ndarray) -> int | None:
    """Where a spread of two pages parts: the emptiest stripe near the middle of a wide page."""
    h, w = mask.shape
    if w < 1.2 * h:
        return None
    lo, hi = int(0.4 * w), int(0.6 * w)
    density = np.convolve(mask.mean(axis=0), np.ones(9) / 9, "same")[lo:hi]
    return lo + int(np.argmin(density)) if density.min() < 0.25 * mask.mean() else None


def content_box(mask: np.ndarray, margin: float = 0.03) -> tuple[int, int, int, int]:
    """The extent of the ink, widened by a share of the page."""
    h, w = mask.shape
    y, x = np.nonzero(mask)
    if not len(y):
        return 0, 0, w - 1, h - 1
    return max(0, x.min() - int(margin * w)), max(0, y.min() - int(margin * h)), min(w - 1, x.max() + int(margin * w)), min(h - 1, y.max() + int(margin * h))


def background(image: np.ndarray, sample: int = 7) -> float:
    """Paper brightness: the upper middle of the brighter half of a sample."""
    v = np.sort(luma(image)[::sample, ::sample].ravel())
    v = v[len(v) // 2 :]
    return float(v[len(v) // 2])


def shade(image: np.ndarray, box: tuple[int, int, int, int]) -> float | None:
    """How much darker than the paper a block's ground is; none under 6 levels."""
    x0, y0, x1, y1 = box
    d = background(image) - background(image[y0 : y1 + 1, x0 : x1 + 1], 1)
    return d if d >= 6 else None


def dark_band(image: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """Ink of light text on a dark ground: the inverse mask inside the box."""
    x0, y0, x1, y1 = box
    out = np.zeros(image.shape[:2], bool)
    part = luma(image)[y0 : y1 + 1, x0 : x1 + 1]
    if np.median(part) < 110:
        out[y0 : y1 + 1, x0 : x1 + 1] = part > otsu(part, 60, 200)
    return out


def grown(mask: np.ndarray, box: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """A crop grown or shrunk to the whole components of which half or more lie in it."""
    x0, y0, x1, y1 = box
    inside = [c for c in components(mask) if max(0, min(x1, c[2]) - max(x0, c[0]) + 1) * max(0, min(y1, c[3]) - max(y0, c[1]) + 1) >= 0.5 * (c[2] - c[0] + 1) * (c[3] - c[1] + 1)]
    return (min(c[0] for c in inside), min(c[1] for c in inside), max(c[2] for c in inside), max(c[3] for c in inside)) if inside else box


def whitened(image: np.ndarray) -> np.ndarray:
    """The paper stretched to white, ink kept."""
    return np.clip(image.astype(float) * 255 / max(1.0, background(image)), 0, 255).astype(np.uint8)


def equalized(gray: np.ndarray, size: int = 25, target: float = 235.0) -> np.ndarray:
    """Uneven light divided out by a box blur."""
    pad = np.pad(gray.astype(float), size, mode="edge")
    total = np.pad(pad.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n = 2 * size + 1
    h, w = gray.shape
    blur = (total[n : n + h, n : n + w] - total[:h, n : n + w] - total[n : n + h, :w] + total[:h, :w]) / (n * n)
    return np.clip(gray / np.maximum(blur, 1) * target, 0, 255).astype(np.uint8)


def blur_of(gray: np.ndarray) -> dict:
    """Laplacian variance and mean brightness with a verdict."""
    g = gray.astype(float)
    lap = g[1:-1, :-2] + g[1:-1, 2:] + g[:-2, 1:-1] + g[2:, 1:-1] - 4 * g[1:-1, 1:-1]
    v, m = float(lap.var()) if lap.size else 0.0, float(g.mean())
    return {"sharpness": v, "brightness": m, "verdict": "dark" if m < 70 else "blurred" if v < 60 else "good"}


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The projective map of four points to four others: an 8 by 8 system solved with partial pivoting."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def warped(image: np.ndarray, corners: np.ndarray, width: int, height: int) -> np.ndarray:
    """The quadrilateral of four corners (clockwise from top left) as an upright picture, bilinear."""
    h = homography(np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]]), np.asarray(corners, float))
    y, x = np.mgrid[0:height, 0:width]
    p = h @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    u, v = np.clip(p[0] / p[2], 0, image.shape[1] - 1.001), np.clip(p[1] / p[2], 0, image.shape[0] - 1.001)
    i, j = v.astype(int), u.astype(int)
    a, b = v - i, u - j
    if image.ndim == 3:
        a, b = a[:, None], b[:, None]
    f = image.astype(float)
    out = f[i, j] * (1 - a) * (1 - b) + f[i + 1, j] * a * (1 - b) + f[i, j + 1] * (1 - a) * b + f[i + 1, j + 1] * a * b
    return np.round(out).astype(np.uint8).reshape(height, width, *image.shape[2:])


def corners(mask: np.ndarray) -> np.ndarray | None:
    """The corners of the largest bright area: extremes of x + y and x - y of the page mask."""
    y, x = np.nonzero(mask)
    if len(y) < 0.2 * mask.size:
        return None
    s, d = x + y, x - y
    return np.array([[x[k], y[k]] for k in (np.argmin(s), np.argmax(d), np.argmax(s), np.argmin(d))])


def reliable(quad: np.ndarray, width: int, height: int) -> bool:
    """Convex, at least a quarter of the picture, no side under a tenth of its opposite."""
    q = np.asarray(quad, float)
    e = np.roll(q, -1, axis=0) - q
    cross = e[:, 0] * np.roll(e[:, 1], -1) - e[:, 1] * np.roll(e[:, 0], -1)
    area = abs(np.sum(q[:, 0] * np.roll(q[:, 1], -1) - q[:, 1] * np.roll(q[:, 0], -1))) / 2
    n = np.linalg.norm(e, axis=1)
    return bool((np.all(cross > 0) or np.all(cross < 0)) and area >= 0.25 * width * height and min(n[0] / n[2], n[2] / n[0], n[1] / n[3], n[3] / n[1]) >= 0.1)


def levelled(image: np.ndarray, degrees: float) -> np.ndarray:
    """The picture turned about its middle so that lines that fall by an angle are level; white where nothing was."""
    h, w = image.shape[:2]
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    x, y = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float).T - np.array([[(w - 1) / 2], [(h - 1) / 2]])
    pad = int(np.ceil(np.hypot(h, w) / 2))
    wide = np.pad(image, [(pad, pad), (pad, pad), *[(0, 0)] * (image.ndim - 2)], constant_values=255)
    return warped(wide, np.stack([pad + (w - 1) / 2 + x * c - y * s, pad + (h - 1) / 2 + x * s + y * c], axis=1), w, h)


def sheet(image: np.ndarray) -> np.ndarray | None:
    """The sheet of a photo made rectangular; none if the picture is all paper, or its sides are no safe cut."""
    gray = luma(image)
    h, w = gray.shape
    border = np.concatenate([gray[0], gray[-1], gray[:, 0], gray[:, -1]]).mean()
    if border > 180 or gray[h // 4 : 3 * h // 4, w // 4 : 3 * w // 4].mean() - border < 25:
        return None
    bright = ~ink(image)
    quad = corners(bright)
    if quad is None or not reliable(quad, w, h):
        return None
    inner = quad + 0.015 * (quad.mean(axis=0) - quad)
    for (x0, y0), (x1, y1) in zip(inner, np.roll(inner, -1, axis=0), strict=True):
        t = np.linspace(0, 1, int(np.hypot(x1 - x0, y1 - y0)) + 1)
        # ink along a side, a little inside: it would cut text
        if (~bright[np.round(y0 + t * (y1 - y0)).astype(int), np.round(x0 + t * (x1 - x0)).astype(int)]).mean() > 0.02:
            return None
    n = np.linalg.norm(np.roll(quad, -1, axis=0) - quad, axis=1)
    return warped(image, quad, round(max(n[0], n[2])) + 1, round(max(n[1], n[3])) + 1)


def prepared(image: np.ndarray) -> list[np.ndarray]:
    """A photo as pages: turned upright, parted at a spread, each made rectangular or else level and cropped to its content, light evened."""
    image = np.rot90(image, -orientation(ink(image)) // 90)
    at = spread(ink(image))
    out = []
    for part in [image] if at is None else [image[:, :at], image[:, at:]]:
        page = sheet(part)
        if page is None:
            angle = skew(ink(part))
            page = levelled(part, angle) if abs(angle) >= 0.4 else part
            x0, y0, x1, y1 = content_box(ink(page))
            page = page[y0 : y1 + 1, x0 : x1 + 1]
        out.append(equalized(luma(page)))
    return out


def skeleton(mask: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning."""
    m = np.pad(mask, 1).astype(np.uint8)
    while True:
        changed = False
        for odd in (0, 1):
            p = [m[:-2, 1:-1], m[:-2, 2:], m[1:-1, 2:], m[2:, 2:], m[2:, 1:-1], m[2:, :-2], m[1:-1, :-2], m[:-2, :-2]]
            b = sum(x.astype(int) for x in p)
            a = sum(((p[k] == 0) & (p[(k + 1) % 8] == 1)).astype(int) for k in range(8))
            c = (p[0] * p[2] * p[4], p[2] * p[4] * p[6]) if not odd else (p[0] * p[2] * p[6], p[0] * p[4] * p[6])
            gone = (m[1:-1, 1:-1] == 1) & (b >= 2) & (b <= 6) & (a == 1) & (c[0] == 0) & (c[1] == 0)
            if gone.any():
                m[1:-1, 1:-1][gone] = 0
                changed = True
        if not changed:
            return m[1:-1, 1:-1].astype(bool)


def dilated(mask: np.ndarray, r: int) -> np.ndarray:
    out = mask.copy()
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            src = mask[max(0, -dy) : mask.shape[0] - max(0, dy), max(0, -dx) : mask.shape[1] - max(0, dx)]
            out[max(0, dy) : mask.shape[0] - max(0, -dy), max(0, dx) : mask.shape[1] - max(0, -dx)] |= src
    return out


def ink_f1(a: np.ndarray, b: np.ndarray, r: int) -> float:
    """F1 of two masks where a pixel counts as met within r pixels; 1 for two blank pages."""
    if not a.any() and not b.any():
        return 1.0
    precision = (a & dilated(b, r)).sum() / max(1, a.sum())
    recall = (b & dilated(a, r)).sum() / max(1, b.sum())
    return float(2 * precision * recall / (precision + recall)) if precision + recall else 0.0


def shift_correlation(a: np.ndarray, b: np.ndarray, reach: int) -> tuple[int, float]:
    """The shift of b within reach of the largest correlation with a, and that correlation."""
    best = (0, -1.0)
    for s in sorted(range(-reach, reach + 1), key=lambda s: (abs(s), s)):
        x, y = (a[s:], b[: len(b) - s]) if s >= 0 else (a[:s], b[-s:])
        n = min(len(x), len(y))
        if n > 1 and x[:n].std() and y[:n].std():
            c = float(np.corrcoef(x[:n], y[:n])[0, 1])
            if c > best[1] + 1e-12:
                best = (s, c)
    return best


def block_metrics(mask: np.ndarray, box: tuple[int, int, int, int], dpi: float) -> dict:
    """Lines, font size, pitch, indents and alignment of a block."""
    x0, y0, x1, y1 = box
    part = mask[y0 : y1 + 1, x0 : x1 + 1]
    rows = lines(part)
    if not rows:
        return {"lines": 0, "font_pt": None, "pitch_pt": None, "align": None, "indent": None}
    edges = [(int(np.flatnonzero(part[a:b].any(0))[0]), int(np.flatnonzero(part[a:b].any(0))[-1])) for a, b in rows]
    left, right = np.array([e[0] for e in edges]), part.shape[1] - 1 - np.array([e[1] for e in edges])
    middles = [(a + b) / 2 for a, b in rows]
    pitch = float(np.sort(np.diff(middles))[(len(middles) - 1) // 2]) * 72 / dpi if len(middles) > 1 else None
    height = sorted(b - a for a, b in rows)[len(rows) // 2] * 72 / dpi
    size = pitch / 1.15 if pitch else height / 0.98
    tight = 0.04 * part.shape[1]
    body = slice(1, None) if len(rows) > 2 else slice(None)
    align = "center" if np.all(np.abs(left - right) <= tight) and left.max() > tight else "justify" if len(rows) > 2 and np.ptp(left[body]) <= tight and np.ptp(right[:-1]) <= tight else "right" if np.ptp(right) <= tight < np.ptp(left) else "left"
    return {"lines": len(rows), "font_pt": float(np.clip(np.floor(size * 2 + 0.5) / 2, 6, 48)), "pitch_pt": pitch, "align": align, "indent": float(left[0] - np.min(left)) * 72 / dpi}


def per_page(pages: DataFrame, kernel: Callable[[np.ndarray], list[dict]], schema: str) -> DataFrame:
    """kernel(page) for frames (page_id, w, h, gray): its rows with the page's id before them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", *(c.split()[0] for c in schema.split(", "))]
        for df in batches:
            rows = []
            for page, w, h, gray in zip(df["page_id"], df["w"], df["h"], df["gray"], strict=True):
                rows += [(page, *r.values()) for r in kernel(np.frombuffer(gray, np.uint8).reshape(h, w))]
            yield pd.DataFrame(rows, columns=names)

    return pages.select("page_id", "w", "h", "gray").mapInPandas(run, f"page_id long, {schema}")


def figures(image: np.ndarray, boxes: list[tuple[float, float, float, float]]) -> list[np.ndarray]:
    """Crops of boxes (y0, x0, y1, x1) of 0..1000, each grown or shrunk to the ink that lies in it for the most part; a box of the whole page stays."""
    h, w = image.shape[:2]
    mask = ink(image)
    out = []
    for y0, x0, y1, x1 in boxes:
        box = int(x0 * w / 1000), int(y0 * h / 1000), min(w, int(np.ceil(x1 * w / 1000))) - 1, min(h, int(np.ceil(y1 * h / 1000))) - 1
        a, b, c, d = box if box == (0, 0, w - 1, h - 1) else grown(mask, box)
        out.append(image[b : d + 1, a : c + 1])
    return out
