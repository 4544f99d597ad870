"""Queries of the quad functions on quads derived from events, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import quads as G
from vellum.plans import model as M

COORDINATES = ["e % 40 - 5", "e * 7 % 30", "150 + e * 3 % 60", "e * 11 % 25", "160 + e * 5 % 70", "180 + e * 13 % 50", "e * 17 % 35 - 10", "170 + e * 19 % 60"]
W_, H_ = 200.0, 220.0


def frames(spark, sf):
    """event_id, user_id, ts_ms and a quad."""
    e = M.spread(M.table(spark, sf, "events").select("event_id", "user_id", "ts", "value")).select("event_id", "user_id", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ts_ms"), "value", F.col("event_id").alias("e"))
    return e.select("event_id", "user_id", "ts_ms", "value", G.quad(*(F.expr(c) for c in COORDINATES)).alias("q"))


def quad_scores(spark, sf):
    q = F.col("q")
    w, h = F.lit(W_), F.lit(H_)
    values = {
        "area": G.area(q), "signed": G.signed_area(q), "perimeter": G.perimeter(q), "short": G.shortest_edge(q), "long": G.longest_edge(q), "ratio": G.edge_ratio(q),
        "oob_sum": G.oob_sum(q, w, h, 2.0), "oob_max": G.oob_max(q, w, h, 2.0), "aspect": G.aspect(q),
    }
    return frames(spark, sf).select("event_id", *(F.round(v, 6).alias(k) for k, v in values.items()), G.is_convex(q).alias("convex"), G.crosses_itself(q).alias("crossing"))


def quad_plausibility(spark, sf):
    p = G.plausibility(F.col("q"), F.lit(W_), F.lit(H_))
    return frames(spark, sf).select("event_id", p.alias("p")).select("event_id", "p.convex", "p.simple", "p.large", "p.inside", "p.aspect_ok", "p.plausible")


def quad_penalty(spark, sf):
    return frames(spark, sf).select("event_id", F.round(G.penalty(F.col("q"), 180.0), 4).alias("penalty"))


def framing_hints(spark, sf):
    f = G.framing(F.col("q"), F.lit(W_), F.lit(H_))
    return frames(spark, sf).select("event_id", f.alias("f")).select("event_id", "f.hint", F.round("f.quality", 6).alias("quality"), F.round("f.dx", 6).alias("dx"), F.round("f.scale", 6).alias("scale"))


def quad_letterbox(spark, sf):
    box = G.letterbox(F.lit(W_), F.lit(H_))
    there = G.to_frame(F.col("q"), box)
    back = G.from_frame(there, box)
    return frames(spark, sf).select("event_id", F.round(there[2]["x"], 6).alias("x"), F.round(there[2]["y"], 6).alias("y"), F.round(back[2]["x"], 6).alias("bx"))


def quad_order(spark, sf):
    """Corners put in order again after a shuffle."""
    q = F.col("q")
    mixed = F.array(q[2], q[0], q[3], q[1])
    o = G.clockwise(mixed)
    return frames(spark, sf).select("event_id", *(F.round(o[i][c], 6).alias(f"{c}{i}") for i in range(4) for c in "xy"))


def rect_overlaps(spark, sf):
    """Words of a document whose boxes meet the document's first box scaled by ten; a theta condition on an equi-join."""
    w = M.words(spark, sf)
    box = lambda a: G.rect(*(F.col(f"{a}.{c}") for c in ("left", "top", "right", "bottom")))
    first = w.where("pos = 0").alias("f")
    large = G.rect_moved(box("f"), F.lit(10.0), F.lit(10.0), F.lit(5.0), F.lit(0.0))
    met = w.alias("w").join(first, F.col("w.doc_id") == F.col("f.doc_id")).where(G.rects_meet(box("w"), large))
    return met.groupBy(F.col("w.doc_id").alias("doc_id")).agg(F.count("*").alias("n"), F.sum(G.rect_area(box("w"))).alias("area"))


def confidence_scale(spark, sf):
    return M.table(spark, sf, "events").select("event_id", G.confidence01(F.col("value")).alias("conf"), G.focus_segments(F.col("value") / 100).alias("segments"), G.focus_band(G.focus_segments(F.col("value") / 100)).alias("band"))


QUERIES = {f.__name__: f for f in (quad_scores, quad_plausibility, quad_penalty, framing_hints, quad_letterbox, quad_order, rect_overlaps, confidence_scale)}

NAMES = "x0 y0 x1 y1 x2 y2 x3 y3".split()
FRAMES = "f AS (SELECT event_id, " + ", ".join(f"CAST({c.replace('e ', 'event_id ')} AS DOUBLE) AS {n}" for c, n in zip(COORDINATES, NAMES, strict=True)) + " FROM events)"


def _d(i, j):
    return f"sqrt((x{i} - x{j}) * (x{i} - x{j}) + (y{i} - y{j}) * (y{i} - y{j}))"


def _beyond(w, h, t):
    return [f"greatest(0, {-t} - {c}{i}, {c}{i} - {s} - {t})" for i in range(4) for c, s in (("x", w), ("y", h))]


def _turn(i):
    j, k = (i + 1) % 4, (i + 2) % 4
    return f"((x{j} - x{i}) * (y{k} - y{j}) - (y{j} - y{i}) * (x{k} - x{j}))"


def _cross(a, b, c):
    return f"((x{b} - x{a}) * (y{c} - y{a}) - (y{b} - y{a}) * (x{c} - x{a}))"


def _seg(a, b, c, d):
    return f"({_cross(a, b, c)} * {_cross(a, b, d)} < 0 AND {_cross(c, d, a)} * {_cross(c, d, b)} < 0)"


E_ = [_d(0, 1), _d(1, 2), _d(2, 3), _d(3, 0)]
AREA = "(" + " + ".join(f"(x{i} * y{(i + 1) % 4} - x{(i + 1) % 4} * y{i})" for i in range(4)) + ") / 2"
SHORT, LONG = f"least({', '.join(E_)})", f"greatest({', '.join(E_)})"
TURNS = ", ".join(_turn(i) for i in range(4))


def _convex(eps):
    return f"NOT (greatest({TURNS}) >= {eps} AND least({TURNS}) <= {-eps})"


CROSSING = f"({_seg(0, 1, 2, 3)} OR {_seg(1, 2, 3, 0)})"
MEANS = f"(({E_[0]} + {E_[2]}) / 2) AS mw, (({E_[1]} + {E_[3]}) / 2) AS mh"
W = M.with_
ORACLE_SQL = {
    "quad_scores": W(FRAMES) + f"""SELECT event_id, round(abs({AREA}), 6) AS area, round({AREA}, 6) AS signed, round({' + '.join(E_)}, 6) AS perimeter, round({SHORT}, 6) AS short, round({LONG}, 6) AS long,
        round({LONG} / greatest({SHORT}, 1e-9), 6) AS ratio, round({' + '.join(_beyond(W_, H_, 2.0))}, 6) AS oob_sum, round(greatest({', '.join(_beyond(W_, H_, 2.0))}), 6) AS oob_max,
        round(greatest(mw / mh, mh / mw), 6) AS aspect, {_convex(1e-6)} AS convex, {CROSSING} AS crossing FROM (SELECT *, {MEANS} FROM f) AS g""",
    "quad_plausibility": W(FRAMES, f"""p AS (SELECT event_id, {_convex(1e-6)} AS convex, NOT {CROSSING} AS simple, (abs({AREA}) / {W_ * H_} >= 0.06 AND {SHORT} >= 24) AS large,
        ({' + '.join(_beyond(W_, H_, 8.0))} <= 40) AS inside, greatest(mw / mh, mh / mw) <= 6 AS aspect_ok FROM (SELECT *, {MEANS} FROM f) AS g)""") + "SELECT *, convex AND simple AND large AND inside AND aspect_ok AS plausible FROM p",
    "quad_penalty": W(FRAMES, f"s AS (SELECT event_id, {' + '.join(_beyond(180.0, 180.0, 2.0))} AS soft, greatest({', '.join(_beyond(180.0, 180.0, 2.0))}) AS far, {CROSSING} AS crossing, {_convex(1e-9)} AS convex, abs({AREA}) AS area, {SHORT} AS short, {LONG} / greatest({SHORT}, 1e-9) AS ratio FROM f)")
    + """SELECT event_id, round(soft * 10 + CASE WHEN far > 16 THEN 1e5 + (far - 16) * 1000 ELSE 0 END + CASE WHEN crossing THEN 1e6 ELSE 0 END + CASE WHEN convex THEN 0 ELSE 1e6 END + CASE WHEN area > 1 THEN 0 ELSE 1e6 END
        + CASE WHEN short < 8 THEN (8 - short) * 1000 ELSE 0 END + CASE WHEN ratio > 25 THEN (ratio - 25) * 100 ELSE 0 END, 4) AS penalty FROM s""",
    "framing_hints": W(FRAMES, f"""m AS (SELECT event_id, {E_[0]} AS t, {E_[1]} AS r, {E_[2]} AS b, {E_[3]} AS l, greatest(-1, least(1, ((x0 + x1 + x2 + x3) / 4 - {W_ / 2}) / {W_} * 2)) AS dx, greatest(-1, least(1, ((y0 + y1 + y2 + y3) / 4 - {H_ / 2}) / {H_} * 2)) AS dy FROM f)""",
        f"n AS (SELECT *, abs(l - r) / ((l + r) / 2) AS th, abs(t - b) / ((t + b) / 2) AS tv, (l + r) / 2 / {0.7 * H_} AS scale, greatest(abs(dx), abs(dy)) AS shift FROM m)") + """SELECT event_id,
        CASE WHEN th > 0.1 THEN CASE WHEN l > r THEN 'TILT_LEFT' ELSE 'TILT_RIGHT' END WHEN tv > 0.1 THEN CASE WHEN t > b THEN 'TILT_FORWARD' ELSE 'TILT_BACK' END
        WHEN shift > 0.12 AND abs(dx) >= abs(dy) THEN CASE WHEN dx < 0 THEN 'MOVE_LEFT' ELSE 'MOVE_RIGHT' END WHEN shift > 0.12 THEN CASE WHEN dy < 0 THEN 'MOVE_UP' ELSE 'MOVE_DOWN' END
        WHEN scale > 1.2 THEN 'MOVE_BACK' WHEN scale < 0.85 THEN 'MOVE_CLOSER' ELSE 'OK' END AS hint,
        round(1 / (1 + greatest(0, greatest(th, tv) / 0.1, shift / 0.12, CASE WHEN scale > 1 THEN scale / 1.2 ELSE 0.85 / greatest(0.0001, scale) END)), 6) AS quality, round(dx, 6) AS dx, round(scale, 6) AS scale FROM n""",
    "quad_letterbox": W(FRAMES, f"s AS (SELECT *, least(256 / {W_}, 256 / {H_}) AS k FROM f)") + f"SELECT event_id, round(x2 * k + (256 - {W_} * k) / 2, 6) AS x, round(y2 * k + (256 - {H_} * k) / 2, 6) AS y, round(x2, 6) AS bx FROM s",
    "quad_order": W(FRAMES) + "SELECT event_id, " + ", ".join(f"round({n}, 6) AS {n[0]}{n[1]}" for n in NAMES) + " FROM f",
    "rect_overlaps": W(M.WORDS, 'f0 AS (SELECT doc_id, "left" * 10 + 5 AS l, top * 10 AS t, "right" * 10 + 5 AS r, bottom * 10 AS b FROM words WHERE pos = 0)') + 'SELECT w.doc_id, count(*) AS n, sum(("right" - "left") * (bottom - top)) AS area FROM words w JOIN f0 ON w.doc_id = f0.doc_id WHERE "left" < r AND l < "right" AND top < b AND t < bottom GROUP BY w.doc_id',
    "confidence_scale": "SELECT event_id, greatest(0, least(1, CASE WHEN value > 1 THEN value / 100 ELSE value END)) AS conf, s AS segments, CASE WHEN s <= 2 THEN 'LOW' WHEN s <= 4 THEN 'GOOD' ELSE 'EXCELLENT' END AS band FROM (SELECT *, CAST(CASE WHEN value <= 0 THEN 0 WHEN value >= 100 THEN 5 ELSE greatest(1, least(5, ceil(value / 100 * 5))) END AS INTEGER) AS s FROM events) AS x",
}
