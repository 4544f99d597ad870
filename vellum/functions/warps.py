"""Edits and scores of crop quads as Column expressions: moved edges, warped sizes, scores, and what speaks against a detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import policies as P
from vellum.functions import quads as G

# Fixed values -------------------------------------------------------------------------------------------------
SOFT, SHORTEST = 0.25, 1.0
CORNER_LOW, CORNER_HIGH, CORNER_POINTS = 60.0, 120.0, 30.0
BEST_AREA, BEST_COVER, WEIGHTS = 0.60, 0.70, (0.35, 0.30, 0.20, 0.15)
GRID, DISAGREEMENT, FAR = 8, 10.0, 64.0
DIFFUSE_MEAN, DIFFUSE_AREA, LEAST_SHARE = 0.4, 100, 0.008
PAGES = {"A4": (595.27563, 841.8898), "US_LETTER": (612.0, 792.0), "LEGAL": (612.0, 1008.0)}
# ----------------------------------------------------------------------------------------------------------------


def outward_normal(q: Column, edge: int) -> Column:
    """struct<x, y>: the unit normal of an edge (0 is the top one) that points away from the opposite one; zero for a point."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = (G._p(q, edge + k) for k in range(4))
    ex, ey = bx - ax, by - ay
    length = F.sqrt(ex * ex + ey * ey)
    away = -ey * (ax + bx - cx - dx) + ex * (ay + by - cy - dy)
    sign = F.when(away >= 0, 1.0).otherwise(-1.0)
    part = lambda v: F.when(length < 1e-6, 0.0).otherwise(sign * v / F.when(length < 1e-6, 1.0).otherwise(length))
    return F.struct(part(-ey).alias("x"), part(ex).alias("y"))


def is_simple_quad(q: Column) -> Column:
    """No edge below a pixel, and all turns in one direction."""
    return (G.shortest_edge(q) >= SHORTEST) & G.is_strictly_convex(q)


def move_edge(q: Column, edge: int, normal: Column, x0: Column, y0: Column, x: Column, y: Column) -> Column:
    """struct<q, moved, dx, dy>: an edge dragged from (x0, y0) to (x, y), along its normal only.

    A move that would collapse, cross or turn over the quad leaves it as it was.
    """
    ends, zero = (edge % 4, (edge + 1) % 4), F.lit(0.0)
    drag = G.let(normal, lambda n: G.let((x - x0) * n["x"] + (y - y0) * n["y"], lambda d: F.struct((d * n["x"]).alias("x"), (d * n["y"]).alias("y"))))

    def moved(s: Column) -> Column:
        """s: struct<q, x, y> of the quad and what its edge moves by."""
        return F.array(*(G.point(px + s["x"], py + s["y"]) if k in ends else G.point(px, py) for k in range(4) for px, py in [G._p(s["q"], k)]))

    def checked(s: Column) -> Column:
        ok = F.coalesce(is_simple_quad(s["new"]) & (G.signed_area(s["new"]) * G.signed_area(s["q"]) > 0), F.lit(False))
        return F.struct(s["q"].alias("q"), s["new"].alias("new"), ok.alias("ok"), s["x"].alias("x"), s["y"].alias("y"))

    def result(s: Column) -> Column:
        return F.struct(F.when(s["ok"], s["new"]).otherwise(s["q"]).alias("q"), s["ok"].alias("moved"), F.when(s["ok"], s["x"]).otherwise(zero).alias("dx"), F.when(s["ok"], s["y"]).otherwise(zero).alias("dy"))

    both = G.let(F.struct(q.alias("q"), drag.alias("d")), lambda s: F.struct(s["q"].alias("q"), s["d"]["x"].alias("x"), s["d"]["y"].alias("y")))
    new = G.let(both, lambda s: F.struct(s["q"].alias("q"), s["x"].alias("x"), s["y"].alias("y"), moved(s).alias("new")))
    return G.let(G.let(new, checked), result)


def soft_clamp(x: Column, y: Column, w: Column, h: Column, slack: float = SOFT) -> Column:
    """struct<x, y> within the image and `slack` of it around."""
    clip = lambda v, size: F.greatest(-slack * size, F.least(size + slack * size, v))
    return F.struct(clip(x, w).alias("x"), clip(y, h).alias("y"))


def projective_ratio(q: Column, w: Column, h: Column) -> Column:
    """Width over height of the rectangle that is seen as the quad, the principal point in the image's middle; null where the view doesn't tell.

    Without a positive focal length the longer side of the image stands in for it.
    """
    p = [(x - w * 0.5, y - h * 0.5) for x, y in (G._p(q, k) for k in range(4))]
    det = lambda a, b, c: a[0] * (b[1] - c[1]) - a[1] * (b[0] - c[0]) + (b[0] * c[1] - c[0] * b[1])
    below2, below3 = det(p[1], p[3], p[2]), det(p[3], p[1], p[2])
    k2, k3 = F.try_divide(det(p[0], p[3], p[2]), below2), F.try_divide(det(p[0], p[1], p[2]), below3)
    a = (k2 * p[1][0] - p[0][0], k2 * p[1][1] - p[0][1], k2 - 1.0)
    b = (k3 * p[3][0] - p[0][0], k3 * p[3][1] - p[0][1], k3 - 1.0)
    focal = -F.try_divide(a[0] * b[0] + a[1] * b[1], a[2] * b[2])
    square = F.when(focal > 0, focal).otherwise(F.greatest(w, h) * F.greatest(w, h))
    size = lambda n: n[0] * n[0] + n[1] * n[1] + n[2] * n[2] * square
    ratio = F.try_divide(size(a), size(b))
    bad = (F.abs(below2) < 1e-9) | (F.abs(below3) < 1e-9) | (F.abs(a[2]) < 1e-6) | (F.abs(b[2]) < 1e-6) | (size(b) < 1e-12)
    return F.when(~bad & (w > 0) & (h > 0) & (ratio > 0), F.sqrt(ratio))


def fixed_ratio_size(q: Column, short_over_long: Column) -> Column:
    """struct<w, h>: pixels of a warped page of a fixed ratio, the longest edge kept; 1 x 1 for a quad or a ratio that gives none."""
    e = G.edges(q)
    longest = F.greatest(*e)
    whole = lambda v: (F.greatest(F.lit(1), F.floor(v + 0.5)) + 1).cast("int")
    wide = e[0] + e[2] >= e[1] + e[3]
    ok = F.coalesce((longest >= 1) & (short_over_long > 0) & (short_over_long <= 1), F.lit(False))
    one = F.lit(1)
    side = lambda flag: F.when(ok, F.when(flag, whole(longest)).otherwise(whole(longest * short_over_long))).otherwise(one)
    return F.struct(side(wide).alias("w"), side(~wide).alias("h"))


def _angle(q: Column, k: int, soft: float) -> Column:
    """Degrees at a corner; soft is added to the lengths' product, 0 for a corner without a length."""
    (px, py), (x, y), (nx, ny) = G._p(q, k + 3), G._p(q, k), G._p(q, k + 1)
    ux, uy, vx, vy = px - x, py - y, nx - x, ny - y
    lengths = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy) + soft
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / F.when(lengths == 0, 1.0).otherwise(lengths)))
    return F.when(lengths == 0, 0.0).otherwise(F.degrees(F.acos(cos)))


def rectangularity(q: Column) -> Column:
    """Up to 30 points a corner by its nearness to a right angle; -1 with a corner beyond 60 to 120 degrees."""
    angles = [_angle(q, k, 1e-9) for k in range(4)]
    points = [F.greatest(F.lit(0.0), CORNER_POINTS - F.abs(a - 90)) for a in angles]
    bad = reduce(lambda a, b: a | b, [(a < CORNER_LOW) | (a > CORNER_HIGH) | F.isnan(a) for a in angles])
    return F.when(q.isNull() | (F.size(q) != 4) | bad, -1.0).otherwise(points[0] + points[1] + points[2] + points[3])


def image_score(q: Column, w: Column, h: Column) -> Column:
    """0 to 1 by area, worst corner, balance of opposite sides and bounding box; minus infinity for a quad that is no crop of the image."""
    near = lambda v, best, span: 1 - F.least(F.lit(1.0), F.abs(v - best) / span)
    e = G.edges(q)
    balance = lambda a, b: F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(0.0)
    corner = F.least(F.lit(1.0), *(near(_angle(q, k, 0.0), 90.0, 90.0) for k in range(4)))
    xs, ys = ([G._p(q, k)[c] for k in range(4)] for c in (0, 1))
    cover = (F.greatest(*xs) - F.least(*xs)) * (F.greatest(*ys) - F.least(*ys)) / (w * h)
    parts = (near(G.area(q) / (w * h), BEST_AREA, BEST_AREA), corner, (balance(e[0], e[2]) + balance(e[3], e[1])) / 2, near(cover, BEST_COVER, BEST_COVER))
    score = parts[0] * WEIGHTS[0] + parts[1] * WEIGHTS[1] + parts[2] * WEIGHTS[2] + parts[3] * WEIGHTS[3]
    return F.when(P.is_image_quad(q, w, h), score).otherwise(F.lit(float("-inf")))


def better_crop(a: Column, b: Column, w: Column, h: Column) -> Column:
    """The quad with the higher image score, the first of equal ones; null if neither is a crop."""
    x, y = image_score(a, w, h), image_score(b, w, h)
    return F.when((x == float("-inf")) & (y == float("-inf")), F.lit(None)).when(y > x, b).otherwise(a)


def mask_disagreement(q: Column, logits: Column, side: int = 64, scale: float = 4.0) -> Column:
    """10 for each of 8 x 8 places that lie in the quad but not in the mask, or the other way round."""
    small = F.transform(q, lambda p: F.named_struct(F.lit("x"), p["x"] / scale, F.lit("y"), p["y"] / scale))
    step = side // GRID
    places = F.transform(F.sequence(F.lit(0), F.lit(GRID * GRID - 1)), lambda k: F.named_struct(F.lit("x"), k % GRID * step, F.lit("y"), F.floor(k / GRID) * step))
    wrong = lambda c: F.filter(places, lambda p: G.contains(c, p["x"] + 0.5, p["y"] + 0.5) != (F.get(logits, (p["y"] * side + p["x"]).cast("int")) > 0))
    return G.let(small, lambda c: F.size(wrong(c)) * DISAGREEMENT)


def suspicion(low_peak: Column, mask_mean: Column, mask_area: Column, fallback: Column, corners: Column, from_mask: Column, chosen: Column, corner_penalty: Column, mask_penalty: Column) -> Column:
    """The first reason to distrust a detection, or null."""
    penalty = F.when(chosen == "MASK", mask_penalty).otherwise(corner_penalty)
    return F.coalesce(
        F.when(low_peak, "LOW_PEAK_MARGIN"),
        F.when((mask_mean > DIFFUSE_MEAN) & (mask_area < DIFFUSE_AREA), "MASK_DIFFUSE"),
        F.when(fallback & (corner_penalty > G.IMPLAUSIBLE), "MASK_FALLBACK_AND_PCORNER"),
        F.when(~fallback & (chosen == "CORNERS") & (G.largest_distance(corners, from_mask) > FAR), "DISAGREE_64PX"),
        F.when(penalty >= G.IMPLAUSIBLE, "GEOMETRY_IMPLAUSIBLE"),
    )


def page_size(name: Column, w: Column, h: Column) -> Column:
    """struct<w, h> in points: a named page, or one as long as A4 with the image's shape; A4 for any other name."""
    longest = max(PAGES["A4"])
    ratio = w / h
    pick = lambda k, fit: F.when(name == "FIT_TO_IMAGE", fit).when(name == "US_LETTER", PAGES["US_LETTER"][k]).when(name == "LEGAL", PAGES["LEGAL"][k]).otherwise(PAGES["A4"][k])
    return F.struct(pick(0, F.when(ratio >= 1, longest).otherwise(longest * ratio)).alias("w"), pick(1, F.when(ratio >= 1, longest / ratio).otherwise(longest)).alias("h"))


def grid_corners(xs: Column, ys: Column) -> Column:
    """The quad of a grid's corner cells; xs and ys are arrays of rows."""
    cell = lambda row, col: G.point(F.element_at(F.element_at(xs, row), col), F.element_at(F.element_at(ys, row), col))
    return F.array(cell(1, 1), cell(1, -1), cell(-1, -1), cell(-1, 1))


def synthetic_corners(seed: Column, doc_w: Column, doc_h: Column, w: Column, h: Column, least: float = 0.3, most: float = 0.7, strength: float = 0.15, margin: int = 20, turn: float = 15.0) -> Column:
    """A random perspective of a page on a canvas, clipped to it: scale, place, turn and shifts of the corners by hashes of seed."""
    draw = lambda n: F.pmod(F.xxhash64(seed, F.lit(n)), F.lit(1 << 30)) / float(1 << 30)
    scale = least + (most - least) * draw(0)
    sw, sh = F.floor(doc_w * scale), F.floor(doc_h * scale)
    fit = F.least(F.lit(1.0), (w - 2 * margin) / sw, (h - 2 * margin) / sh)
    sw, sh = F.floor(sw * fit), F.floor(sh * fit)
    place = lambda n, size, whole: margin + F.floor(size / 2) + F.floor(draw(n) * (whole - 2 * margin - 2 * F.floor(size / 2) + 1))
    cx, cy, angle = place(1, sw, w), place(2, sh, h), F.radians(2 * turn * draw(3) - turn)

    def corner(k: int, sx: int, sy: int) -> Column:
        x, y = sx * sw / 2, sy * sh / 2
        shift = lambda n, size: (2 * draw(n) - 1) * strength * size
        px = x * F.cos(angle) - y * F.sin(angle) + shift(4 + 2 * k, sw) + cx
        py = x * F.sin(angle) + y * F.cos(angle) + shift(5 + 2 * k, sh) + cy
        return G.point(F.greatest(F.lit(1.0), F.least(w - 2, px)), F.greatest(F.lit(1.0), F.least(h - 2, py)))

    return F.array(*(corner(k, *s) for k, s in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)))))


def quad_confidence(q: Column, w: Column, h: Column) -> Column:
    """0 to 1 from a quad's share of the image, its right angles and the likeness of its opposite sides; 0 for no quad or too small a one.

    The corners may come in any order. A quad with a corner beyond 60 to 120 degrees counts -1 of 120 points for its angles.
    """

    def rated(p: Column) -> Column:
        area = G.area(p) / (w * h)
        top, right, bottom, left = G.edges(p)
        apart = (F.abs(top - bottom) + F.abs(right - left)) / (top + right + bottom + left) + 1e-6
        score = 0.5 * area + 0.3 * rectangularity(p) / 120.0 + 0.2 * (1 - F.least(F.lit(1.0), apart))
        return F.when(area < LEAST_SHARE, 0.0).otherwise(score)

    return F.when(q.isNull() | (F.size(q) != 4), 0.0).otherwise(G.let(G.clockwise(q), rated))
