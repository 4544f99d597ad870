"""Geometry of quadrilaterals and rectangles as Column expressions.

A quad is array<struct<x: double, y: double>> of four points (top left, top right, bottom right, bottom left);
a rectangle is struct<left, top, right, bottom>. Everything stays within generated code; a null point or a quad
of another length gives null.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------------------------------
MIN_AREA_RATIO, MIN_EDGE, OOB_TOLERANCE, OOB_SUM_MAX, ASPECT_MAX = 0.06, 24.0, 8.0, 40.0, 6.0
TILT_BAD, SHIFT_OK, SCALE_BACK, SCALE_CLOSER, MODEL_HEIGHT = 0.10, 0.12, 1.20, 0.85, 0.70
HARD_PENALTY, AGREEMENT, MASK_MARGIN, IMPLAUSIBLE = 1e5, 32.0, 50.0, 1e4
# ----------------------------------------------------------------------------------------------------------------


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def quad(*coordinates: Column) -> Column:
    """A quad of x1, y1, ..., x4, y4."""
    return F.array(*(point(x, y) for x, y in zip(coordinates[::2], coordinates[1::2], strict=True)))


def _p(q: Column, i: int) -> tuple[Column, Column]:
    p = F.get(q, F.lit(i % 4))
    return p["x"], p["y"]


def let(values: Column, use) -> Column:
    """use(values) with values computed once per row, so that what is built on it stays small."""
    return F.get(F.transform(F.array(values), use), F.lit(0))


def _distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))


def edges(q: Column) -> list[Column]:
    return [_distance(_p(q, i), _p(q, i + 1)) for i in range(4)]


def signed_area(q: Column) -> Column:
    terms = [_p(q, i)[0] * _p(q, i + 1)[1] - _p(q, i + 1)[0] * _p(q, i)[1] for i in range(4)]
    return (terms[0] + terms[1] + terms[2] + terms[3]) / 2


def area(q: Column) -> Column:
    return F.abs(signed_area(q))


def perimeter(q: Column) -> Column:
    e = edges(q)
    return e[0] + e[1] + e[2] + e[3]


def shortest_edge(q: Column) -> Column:
    return F.least(*edges(q))


def longest_edge(q: Column) -> Column:
    return F.greatest(*edges(q))


def edge_ratio(q: Column) -> Column:
    return longest_edge(q) / F.greatest(shortest_edge(q), F.lit(1e-9))


def _cross(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column]) -> Column:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def turns(q: Column) -> list[Column]:
    """Cross products of successive edges."""
    return [(_p(q, i + 1)[0] - _p(q, i)[0]) * (_p(q, i + 2)[1] - _p(q, i + 1)[1]) - (_p(q, i + 1)[1] - _p(q, i)[1]) * (_p(q, i + 2)[0] - _p(q, i + 1)[0]) for i in range(4)]


def is_convex(q: Column, eps: float = 1e-6) -> Column:
    """No two turns in different directions; turns below eps don't count."""
    t = turns(q)
    return ~((F.greatest(*t) >= eps) & (F.least(*t) <= -eps))


def is_strictly_convex(q: Column) -> Column:
    t = turns(q)
    return (F.least(*t) > 0) | (F.greatest(*t) < 0)


def _segments_cross(a, b, c, d) -> Column:
    """Proper crossing of two segments."""
    return (_cross(a, b, c) * _cross(a, b, d) < 0) & (_cross(c, d, a) * _cross(c, d, b) < 0)


def crosses_itself(q: Column) -> Column:
    a, b, c, d = (_p(q, i) for i in range(4))
    return _segments_cross(a, b, c, d) | _segments_cross(b, c, d, a)


def _beyond(q: Column, w: Column, h: Column, tolerance: float) -> list[Column]:
    zero = F.lit(0.0)
    return [F.greatest(zero, -tolerance - v, v - size - tolerance) for i in range(4) for v, size in zip(_p(q, i), (w, h), strict=True)]


def oob_sum(q: Column, w: Column, h: Column, tolerance: float = OOB_TOLERANCE) -> Column:
    """How far the points lie beyond the image and the tolerance, summed."""
    out = _beyond(q, w, h, tolerance)
    return sum(out[1:], out[0])


def oob_max(q: Column, w: Column, h: Column, tolerance: float = OOB_TOLERANCE) -> Column:
    return F.greatest(*_beyond(q, w, h, tolerance))


def aspect(q: Column) -> Column:
    """Mean width over mean height or its inverse, at least 1; the largest double for a side below 1."""
    e = edges(q)
    width, height = (e[0] + e[2]) / 2, (e[1] + e[3]) / 2
    return F.when((width < 1) | (height < 1), F.lit(1.7976931348623157e308)).otherwise(F.greatest(width / height, height / width))


def plausibility(q: Column, w: Column, h: Column) -> Column:
    """struct of the five conditions of a plausible page, their conjunction and what they measure."""
    ratio = area(q) / (w * h)
    checks = {
        "convex": is_convex(q),
        "simple": ~crosses_itself(q),
        "large": (ratio >= MIN_AREA_RATIO) & (shortest_edge(q) >= MIN_EDGE),
        "inside": oob_sum(q, w, h) <= OOB_SUM_MAX,
        "aspect_ok": aspect(q) <= ASPECT_MAX,
    }
    good = checks["convex"] & checks["simple"] & checks["large"] & checks["inside"] & checks["aspect_ok"]
    sized = q.isNotNull() & (F.size(q) == 4) & (w > 0) & (h > 0)
    no = F.lit(False)
    return F.struct(*(F.coalesce(sized & c, no).alias(k) for k, c in checks.items()), F.coalesce(sized & good, no).alias("plausible"), ratio.alias("area_ratio"), oob_sum(q, w, h).alias("oob_sum"))


def framing(q: Column, w: Column, h: Column, model_height: Column | None = None) -> Column:
    """struct<quality, dx, dy, scale, tilt_h, tilt_v, hint, has_doc>: where a page lies in the image and what to do about it.

    Tilt comes before shift, and shift before scale; quality is 1 / (1 + the worst deviation).
    """
    target = model_height if model_height is not None else F.greatest(F.lit(1.0), MODEL_HEIGHT * h)
    clamp = lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))
    centre = lambda k: (_p(q, 0)[k] + _p(q, 1)[k] + _p(q, 2)[k] + _p(q, 3)[k]) / 4
    top, right, bottom, left = edges(q)
    sides = F.struct(top.alias("top"), right.alias("right"), bottom.alias("bottom"), left.alias("left"), clamp((centre(0) - w / 2) / w * 2).alias("dx"), clamp((centre(1) - h / 2) / h * 2).alias("dy"), target.alias("target"))
    apart = lambda a, b: F.when(a + b <= 0, 0.0).otherwise(F.abs(a - b) / ((a + b) / 2))

    def measures(s: Column) -> Column:
        return F.struct(
            s["dx"].alias("dx"), s["dy"].alias("dy"), F.when(s["target"] > 1, (s["left"] + s["right"]) / 2 / s["target"]).otherwise(1.0).alias("scale"),
            apart(s["left"], s["right"]).alias("tilt_h"), apart(s["top"], s["bottom"]).alias("tilt_v"), (s["left"] > s["right"]).alias("lefty"), (s["top"] > s["bottom"]).alias("toppy"),
        )

    def result(m: Column) -> Column:
        dx, dy, scale = m["dx"], m["dy"], m["scale"]
        shift = F.greatest(F.abs(dx), F.abs(dy))
        hint = (
            F.when(m["tilt_h"] > TILT_BAD, F.when(m["lefty"], "TILT_LEFT").otherwise("TILT_RIGHT"))
            .when(m["tilt_v"] > TILT_BAD, F.when(m["toppy"], "TILT_FORWARD").otherwise("TILT_BACK"))
            .when((shift > SHIFT_OK) & (F.abs(dx) >= F.abs(dy)), F.when(dx < 0, "MOVE_LEFT").otherwise("MOVE_RIGHT"))
            .when(shift > SHIFT_OK, F.when(dy < 0, "MOVE_UP").otherwise("MOVE_DOWN"))
            .when(scale > SCALE_BACK, "MOVE_BACK")
            .when(scale < SCALE_CLOSER, "MOVE_CLOSER")
            .otherwise("OK")
        )
        off = F.when(scale > 1, scale / SCALE_BACK).otherwise(SCALE_CLOSER / F.greatest(F.lit(1e-4), scale))
        worst = F.greatest(F.lit(0.0), F.greatest(m["tilt_h"], m["tilt_v"]) / TILT_BAD, shift / SHIFT_OK, off)
        values = {"quality": 1 / (1 + worst), "dx": dx, "dy": dy, "scale": scale, "tilt_h": m["tilt_h"], "tilt_v": m["tilt_v"], "hint": hint, "has_doc": F.lit(True)}
        return F.named_struct(*(x for k, v in values.items() for x in (F.lit(k), v)))

    none = {"quality": 0.0, "dx": 0.0, "dy": 0.0, "scale": 1.0, "tilt_h": 0.0, "tilt_v": 0.0, "hint": "MOVE_CLOSER", "has_doc": False}
    missing = F.named_struct(*(x for k, v in none.items() for x in (F.lit(k), F.lit(v))))
    return F.when(q.isNotNull() & (F.size(q) == 4), let(let(sides, measures), result)).otherwise(missing)


def penalty(q: Column, side: float = 256.0) -> Column:
    """Geometry penalty of a quad in a square: out of bounds, crossing, not convex, degenerate, short or uneven edges."""
    w = F.lit(side)
    soft, far = oob_sum(q, w, w, 2.0), oob_max(q, w, w, 2.0)
    short, ratio = shortest_edge(q), edge_ratio(q)
    terms = [
        soft * 10.0,
        F.when(far > 16.0, HARD_PENALTY + (far - 16.0) * 1000.0).otherwise(0.0),
        F.when(crosses_itself(q), 1e6).otherwise(0.0),
        F.when(is_convex(q, 1e-9), 0.0).otherwise(1e6),
        F.when(area(q) > 1.0, 0.0).otherwise(1e6),
        F.when(short < 8.0, (8.0 - short) * 1000.0).otherwise(0.0),
        F.when(ratio > 25.0, (ratio - 25.0) * 100.0).otherwise(0.0),
    ]
    finite = F.forall(q, lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < math.inf) & (F.abs(p["y"]) < math.inf))
    return F.when(q.isNull() | (F.size(q) != 4) | ~F.coalesce(finite, F.lit(False)), 1e6).otherwise(sum(terms[1:], terms[0]))


def contains(q: Column, x: Column, y: Column) -> Column:
    """Whether a point is in the quad or on its edge, by crossings of a ray."""
    on, odd = F.lit(False), F.lit(False)
    for i in range(4):
        (ax, ay), (bx, by) = _p(q, i), _p(q, i + 1)
        flat = F.abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) <= 1e-9
        within = (x >= F.least(ax, bx) - 1e-9) & (x <= F.greatest(ax, bx) + 1e-9) & (y >= F.least(ay, by) - 1e-9) & (y <= F.greatest(ay, by) + 1e-9)
        on = on | (flat & within)
        hit = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.when(by == ay, 1.0).otherwise(by - ay) + ax)
        odd = odd != hit
    return on | odd


def largest_distance(a: Column, b: Column) -> Column:
    return F.greatest(*(_distance(_p(a, i), _p(b, i)) for i in range(4)))


def mean_distance(a: Column, b: Column) -> Column:
    d = [_distance(_p(a, i), _p(b, i)) for i in range(4)]
    return (d[0] + d[1] + d[2] + d[3]) / 4


def choose_path(corners: Column, from_mask: Column, mask_is_fallback: Column) -> Column:
    """CORNERS or MASK: the mask's quad only if the corners' is broken, or if both agree and it is better by a margin."""
    quads = F.struct(corners.alias("a"), from_mask.alias("b"))
    # both quads, their penalties and their distance are computed once a row
    measured = let(quads, lambda q: F.struct(penalty(q["a"]).alias("a"), penalty(q["b"]).alias("b"), largest_distance(q["a"], q["b"]).alias("apart")))

    def chosen(m: Column) -> Column:
        return (
            F.when((m["a"] >= HARD_PENALTY) & (m["b"] < HARD_PENALTY), "MASK")
            .when((m["b"] >= HARD_PENALTY) | (m["apart"] > AGREEMENT), "CORNERS")
            .when(m["b"] < m["a"] - MASK_MARGIN, "MASK")
            .otherwise("CORNERS")
        )

    return F.when(mask_is_fallback, "CORNERS").otherwise(let(measured, chosen))


def clockwise(q: Column) -> Column:
    """The points by angle around their centre, the one with the least x + y first."""
    cx = F.aggregate(q, F.lit(0.0), lambda a, p: a + p["x"]) / F.size(q)
    cy = F.aggregate(q, F.lit(0.0), lambda a, p: a + p["y"]) / F.size(q)
    keyed = F.transform(q, lambda p: F.named_struct(F.lit("angle"), F.atan2(p["y"] - cy, p["x"] - cx), F.lit("x"), p["x"], F.lit("y"), p["y"]))
    ring = F.transform(F.array_sort(keyed), lambda s: F.named_struct(F.lit("x"), s["x"], F.lit("y"), s["y"]))
    sums = F.transform(ring, lambda p: p["x"] + p["y"])
    at = F.array_position(sums, F.array_min(sums)).cast("int")
    return F.concat(F.slice(ring, at, F.size(ring)), F.slice(ring, F.lit(1), at - 1))


def flipped(q: Column, horizontal: bool, vertical: bool = False) -> Column:
    """Corner order after a mirror image, so that the names stay."""
    order = [0, 1, 2, 3]
    if horizontal:
        order = [order[k] for k in (1, 0, 3, 2)]
    if vertical:
        order = [order[k] for k in (3, 2, 1, 0)]
    return F.array(*(q[k] for k in order))


def letterbox(src_w: Column, src_h: Column, dst_w: float = 256.0, dst_h: float = 256.0) -> Column:
    """struct<scale, dx, dy> that fits an image into a frame."""
    scale = F.least(dst_w / src_w, dst_h / src_h)
    return F.struct(scale.alias("scale"), ((dst_w - src_w * scale) / 2).alias("dx"), ((dst_h - src_h * scale) / 2).alias("dy"))


def to_frame(q: Column, box: Column) -> Column:
    return F.transform(q, lambda p: F.named_struct(F.lit("x"), p["x"] * box["scale"] + box["dx"], F.lit("y"), p["y"] * box["scale"] + box["dy"]))


def from_frame(q: Column, box: Column) -> Column:
    return F.transform(q, lambda p: F.named_struct(F.lit("x"), (p["x"] - box["dx"]) / box["scale"], F.lit("y"), (p["y"] - box["dy"]) / box["scale"]))


def strips(q: Column, parts: Column) -> Column:
    """The quad cut into `parts` equal upright strips."""

    def cut(k: Column) -> Column:
        u0, u1 = k / parts, (k + 1) / parts
        on = lambda a, b, u: point(q[a]["x"] + (q[b]["x"] - q[a]["x"]) * u, q[a]["y"] + (q[b]["y"] - q[a]["y"]) * u)
        return F.array(on(0, 1, u0), on(0, 1, u1), on(3, 2, u1), on(3, 2, u0))

    return F.transform(F.sequence(F.lit(0), parts - 1), cut)


def rect(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """A rectangle with its sides in order."""
    return F.struct(F.least(left, right).alias("left"), F.least(top, bottom).alias("top"), F.greatest(left, right).alias("right"), F.greatest(top, bottom).alias("bottom"))


def rect_area(r: Column) -> Column:
    return (r["right"] - r["left"]) * (r["bottom"] - r["top"])


def rect_contains(r: Column, x: Column, y: Column) -> Column:
    """Half open: left and top belong to it."""
    return (x >= r["left"]) & (x < r["right"]) & (y >= r["top"]) & (y < r["bottom"])


def rects_meet(a: Column, b: Column) -> Column:
    return (a["left"] < b["right"]) & (b["left"] < a["right"]) & (a["top"] < b["bottom"]) & (b["top"] < a["bottom"])


def rect_moved(r: Column, sx: Column, sy: Column, dx: Column, dy: Column) -> Column:
    return F.struct((r["left"] * sx + dx).alias("left"), (r["top"] * sy + dy).alias("top"), (r["right"] * sx + dx).alias("right"), (r["bottom"] * sy + dy).alias("bottom"))


def rect_clipped(r: Column, w: Column, h: Column) -> Column:
    clip = lambda v, m: F.greatest(F.lit(0.0), F.least(v, m))
    return F.struct(clip(r["left"], w).alias("left"), clip(r["top"], h).alias("top"), clip(r["right"], w).alias("right"), clip(r["bottom"], h).alias("bottom"))


def on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """struct<t, x, y, distance> of the nearest point of a segment."""
    n = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.when(n <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / n)))
    x, y = ax + t * (bx - ax), ay + t * (by - ay)
    return F.struct(t.alias("t"), x.alias("x"), y.alias("y"), _distance((px, py), (x, y)).alias("distance"))


def nearest_edge(q: Column, x: Column, y: Column, radius: float, deadzone: float = 0.0) -> Column:
    """Number of the edge nearest to a point, nearer than radius, its ends by deadzone excluded; -1 for none."""
    hits = [on_segment(x, y, *_p(q, i), *_p(q, i + 1)) for i in range(4)]
    ok = [F.when((s["distance"] < radius) & (s["t"] > deadzone) & (s["t"] < 1 - deadzone), F.struct(s["distance"].alias("d"), F.lit(i).alias("i"))) for i, s in enumerate(hits)]
    return F.coalesce(F.array_min(F.array_compact(F.array(*ok)))["i"], F.lit(-1))


def lines_meet(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """The point where the lines ab and cd meet; null for parallel ones."""
    n = (a[0] - b[0]) * (c[1] - d[1]) - (a[1] - b[1]) * (c[0] - d[0])
    u, v = a[0] * b[1] - a[1] * b[0], c[0] * d[1] - c[1] * d[0]
    return F.when(F.abs(n) > 1e-9, point((u * (c[0] - d[0]) - (a[0] - b[0]) * v) / n, (u * (c[1] - d[1]) - (a[1] - b[1]) * v) / n))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def confidence01(c: Column) -> Column:
    """Null or NaN to 0, values above 1 divided by 100, then within 0 and 1."""
    v = F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(v > 1, v / 100).otherwise(v)))


def focus_segments(score: Column, parts: int = 5) -> Column:
    return F.when(F.isnan(score) | (score <= 0), 0).when(score >= 1, parts).otherwise(F.greatest(F.lit(1), F.least(F.lit(parts), F.ceil(score * parts)))).cast("int")


def focus_band(segments: Column) -> Column:
    return F.when(segments <= 2, "LOW").when(segments <= 4, "GOOD").otherwise("EXCELLENT")


def fit_into(w: Column, h: Column, most_w: Column, most_h: Column) -> Column:
    """struct<w, h>: the size scaled down or up to fit, whole pixels, at least 1."""
    scale = F.least(most_w / w, most_h / h)
    return F.struct(F.greatest(F.lit(1), F.floor(w * scale + 0.5)).cast("int").alias("w"), F.greatest(F.lit(1), F.floor(h * scale + 0.5)).cast("int").alias("h"))


def degrees360(d: Column) -> Column:
    return F.pmod(d, F.lit(360))


def mm_to_pixels(mm: Column, dpi: Column) -> Column:
    return F.floor(mm / 25.4 * dpi + 0.5).cast("int")


def polygon_cells(q: np.ndarray, size: int = 64, scale: float = 4.0) -> np.ndarray:
    """(quads, size * size) of 0 and 1: polygon_mask() of rows of x1, y1, ..., y4; a missing coordinate lies at the frame's far end."""
    far = size * scale - 1
    c = np.maximum(0.0, np.minimum(far, np.where(np.isnan(q), far, q))) / scale
    cells = np.arange(size * size)
    return _inside(c, (cells % size + 0.5)[None, :], (cells // size + 0.5)[None, :], 1e-9).astype(np.int32)


def polygon_mask(q: Column, size: int = 64, scale: float = 4.0) -> Column:
    """Row-major array of 0 and 1: cells whose centre lies in the quad, clipped to the frame and scaled down; in numpy batches, null for a null quad."""

    @F.pandas_udf("array<int>")
    def mask(p: pd.Series) -> pd.Series:
        out = np.full(len(p), None, object)
        good = np.flatnonzero([x is not None and len(x) == 8 for x in p])
        some = max(1, (1 << 18) // (size * size))
        for k in range(0, len(good), some):
            rows = good[k : k + some]
            for r, cells in zip(rows, polygon_cells(np.stack(p.iloc[rows].to_list()).astype(float), size, scale), strict=True):
                out[r] = cells
        return pd.Series(out)

    return mask(F.flatten(F.transform(q, lambda s: F.array(s["x"], s["y"]))))


def _inside(q: np.ndarray, x: np.ndarray, y: np.ndarray, slack: float = 0.0) -> np.ndarray:
    """Cells (columns) whose centre lies in each quad (rows of x1, y1, ..., y4) or on its edge, whose ends reach further by slack."""
    odd, on = np.zeros((len(q), x.shape[1]), bool), np.zeros((len(q), x.shape[1]), bool)
    for i in range(4):
        ax, ay, bx, by = (q[:, [k]] for k in (2 * i, 2 * i + 1, (2 * i + 2) % 8, (2 * i + 3) % 8))
        on |= (np.abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) <= 1e-9) & (x >= np.minimum(ax, bx) - slack) & (x <= np.maximum(ax, bx) + slack) & (y >= np.minimum(ay, by) - slack) & (y <= np.maximum(ay, by) + slack)
        odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / np.where(by == ay, 1, by - ay) + ax)
    return odd | on


def _crossings(q: np.ndarray, w: np.ndarray, h: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Four arrays (quads, rows) in ascending order: cells of each row left of the edges, 0 if an edge isn't met; which rows (quads, rows) have an edge near a cell's centre."""
    y = (np.arange(size) + 0.5)[None, :] / size * h[:, None]
    cells, near = [], np.zeros((len(q), size), bool)
    for i in range(4):
        ax, ay, bx, by = (q[:, [k % 8]] for k in range(2 * i, 2 * i + 4))
        place = ((bx - ax) * (y - ay) / np.where(by == ay, 1, by - ay) + ax) / w[:, None] * size - 0.5
        beside = (np.minimum(ay, by) - 1e-3 <= y) & (y <= np.maximum(ay, by) + 1e-3) & ((np.abs(place - np.rint(place)) < 1e-6) | (np.abs(by - ay) < 1e-2))
        near |= beside
        cells.append(np.where((ay > y) != (by > y), np.clip(np.ceil(place), 0, size), 0.0))
    for i, j in ((0, 1), (2, 3), (0, 2), (1, 3), (1, 2)):
        cells[i], cells[j] = np.minimum(cells[i], cells[j]), np.maximum(cells[i], cells[j])
    return cells, near


def _overlap(p: np.ndarray, q: np.ndarray, w: np.ndarray, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells in both quads, and in any: by rows of cells, or cell by cell for rows in which an edge passes near a cell's centre."""
    (a, near), (b, near_b) = _crossings(p, w, h, size), _crossings(q, w, h, size)
    # a row of a quad is the cells from the first edge to the second and from the third to the fourth
    spans = [(i, j) for i in (0, 2) for j in (0, 2)]
    both = sum(np.maximum(0.0, np.minimum(a[i + 1], b[j + 1]) - np.maximum(a[i], b[j])) for i, j in spans)
    any_ = sum(c[k + 1] - c[k] for c in (a, b) for k in (0, 2)) - both
    k, row = np.nonzero(near | near_b)
    cells = (np.arange(size) + 0.5)[None, :] / size
    for s in (slice(n, n + 1_024) for n in range(0, len(k), 1_024)):
        x, y = cells * w[k[s], None], ((row[s] + 0.5) / size * h[k[s]])[:, None]
        i, j = _inside(p[k[s]], x, y), _inside(q[k[s]], x, y)
        both[k[s], row[s]], any_[k[s], row[s]] = (i & j).sum(axis=1), (i | j).sum(axis=1)
    return both.sum(axis=1), any_.sum(axis=1)


def raster_iou(a: Column, b: Column, w: Column, h: Column, size: int = 256) -> Column:
    """Intersection over union on a grid of size by size cells over the image, in numpy batches; null for a null quad."""

    @F.pandas_udf("double")
    def iou(p: pd.Series, q: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        out = np.full(len(p), np.nan)
        good = np.flatnonzero(p.notna() & q.notna())
        for k in range(0, len(good), 256):
            rows = good[k : k + 256]
            both, any_ = _overlap(*(np.stack(s.iloc[rows].to_list()).astype(float) for s in (p, q)), width.to_numpy()[rows], height.to_numpy()[rows], size)
            out[rows] = np.where(any_ > 0, both / np.maximum(any_, 1), 0.0)
        return pd.Series(out).where(np.isin(np.arange(len(p)), good))

    flat = lambda c: F.flatten(F.transform(c, lambda s: F.array(s["x"], s["y"])))
    return iou(flat(a), flat(b), w.cast("double"), h.cast("double"))
