"""Queries of crop edits, page assembly and rules without a query elsewhere, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import policies as P
from vellum.functions import quads as G
from vellum.functions import tensors as N
from vellum.functions import warps as R
from vellum.operators import assembly as A
from vellum.operators import datasets as D
from vellum.operators import layout as Y
from vellum.operators import pages as Q
from vellum.plans import analysis_queries as AQ
from vellum.plans import geometry_queries as GQ
from vellum.plans import model as M
from vellum.sources import documents as S

W = M.with_


def _six(**columns):
    return [F.round(v, 6).alias(k) for k, v in columns.items()]


# ---- crop quads


def crop_edges(spark, sf):
    """The right edge dragged to a point that differs by event."""
    q = F.col("q")
    n = R.outward_normal(q, 1)
    m = R.move_edge(q, 1, F.col("n"), (q[1]["x"] + q[2]["x"]) / 2, (q[1]["y"] + q[2]["y"]) / 2, F.col("event_id") % 400 - 100.0, F.col("event_id") % 300 * 1.0)
    f = GQ.frames(spark, sf).withColumn("n", n).select("event_id", "n", m.alias("m"))
    return f.select("event_id", "m.moved", *_six(nx=F.col("n.x"), ny=F.col("n.y"), dx=F.col("m.dx"), dy=F.col("m.dy"), x2=F.col("m.q")[2]["x"], y2=F.col("m.q")[2]["y"]))


def crop_scores(spark, sf):
    q = F.col("q")
    score = R.image_score(q, F.lit(GQ.W_), F.lit(GQ.H_))
    size = R.fixed_ratio_size(q, F.lit(0.7071))
    return GQ.frames(spark, sf).select("event_id", F.when(score > float("-inf"), F.round(score, 6)).alias("score"), F.round(R.rectangularity(q), 6).alias("corners"), size["w"].alias("w"), size["h"].alias("h"))


def projective_ratios(spark, sf):
    return GQ.frames(spark, sf).select("event_id", F.round(R.projective_ratio(F.col("q"), F.lit(GQ.W_), F.lit(GQ.H_)), 5).alias("ratio"))


def clamped_points(spark, sf):
    p = R.soft_clamp(F.col("q")[0]["x"] * 9 - 60, F.col("q")[0]["y"] * 11 - 70, F.lit(GQ.W_), F.lit(GQ.H_))
    return GQ.frames(spark, sf).select("event_id", *_six(x=p["x"], y=p["y"]))


def mask_disagreements(spark, sf):
    """Each 8 x 8 map against a fixed quad."""
    q = G.quad(*map(F.lit, (1.0, 0.0, 6.5, 1.5, 7.5, 7.0, 0.5, 6.0)))
    return AQ._maps(spark, sf).select("vec_id", R.mask_disagreement(q, F.col("a"), 8, 1.0).alias("penalty"))


def suspicions(spark, sf):
    e, q = F.col("event_id"), F.col("q")
    far = F.transform("q", lambda p: F.named_struct(F.lit("x"), p["x"] + F.col("event_id") % 90, F.lit("y"), p["y"]))
    why = R.suspicion(e % 11 == 0, e % 10 / 10, e % 7 * 30, e % 3 == 0, q, far, F.when(e % 2 == 0, "MASK").otherwise("CORNERS"), e % 13 * 1000.0, e % 17 * 1000.0)
    return GQ.frames(spark, sf).select("event_id", why.alias("reason"))


def page_sizes(spark, sf):
    e = M.table(spark, sf, "events").select("event_id", F.element_at(F.array(*map(F.lit, ("A4", "US_LETTER", "LEGAL", "FIT_TO_IMAGE", "other"))), (F.col("event_id") % 5 + 1).cast("int")).alias("name"))
    s = R.page_size(F.col("name"), F.col("event_id") % 70 + 30.0, F.col("event_id") % 50 + 30.0)
    return e.select("event_id", "name", F.round(s["w"], 4).alias("w"), F.round(s["h"], 4).alias("h"))


def quad_points(spark, sf):
    """A point against each quad: within it, its nearest edge, and where the diagonals meet."""
    q, x, y = F.col("q"), F.col("event_id") % 230 - 10.0, F.col("event_id") * 7 % 250 - 10.0
    p = [G._p(q, k) for k in range(4)]
    c = G.lines_meet(p[0], p[2], p[1], p[3])
    return GQ.frames(spark, sf).select("event_id", G.contains(q, x, y).alias("within"), G.nearest_edge(q, x, y, 24.0, 0.15).alias("edge"), *_six(cx=c["x"], cy=c["y"]))


def quad_strips(spark, sf):
    s = F.explode(G.strips(F.col("q"), F.lit(3)))
    return GQ.frames(spark, sf).select("event_id", s.alias("s")).select("event_id", *_six(x0=F.col("s")[0]["x"], x1=F.col("s")[1]["x"], y2=F.col("s")[2]["y"], y3=F.col("s")[3]["y"]))


def quad_flips(spark, sf):
    a, b = G.flipped(F.col("q"), True), G.flipped(F.col("q"), False, True)
    path = G.choose_path(F.col("q"), F.transform("q", lambda p: F.named_struct(F.lit("x"), p["x"] + F.col("event_id") % 50, F.lit("y"), p["y"])), F.col("event_id") % 9 == 0)
    return GQ.frames(spark, sf).select("event_id", *_six(ax=a[0]["x"], ay=a[2]["y"], bx=b[0]["x"], by=b[2]["y"]), path.alias("chosen"))


def polygon_masks(spark, sf):
    """Cells of an 8 x 8 grid over each quad, and a heat map's sum around its first corner."""
    q = F.col("q")
    mask = G.polygon_mask(q, 8, 28.0)
    heat = N.gaussian_map(q[2]["x"], q[2]["y"], 1.5, 8, 28.0)
    return GQ.frames(spark, sf).select("event_id", F.aggregate(mask, F.lit(0), lambda s, v: s + v).alias("cells"), F.round(N.total(heat), 6).alias("heat"))


def sizes(spark, sf):
    e = F.col("event_id")
    s = G.fit_into(e % 900 + 1, e % 700 + 1, F.lit(400), F.lit(300))
    return M.table(spark, sf, "events").select("event_id", s["w"].alias("w"), s["h"].alias("h"), G.degrees360(e - 500).alias("turn"), G.mm_to_pixels(e % 300 * 1.0, F.lit(150)).alias("pixels"), F.round(G.sigmoid(F.col("value") / 50), 6).alias("p"), F.round(P.density(e % 40 * 1.0, e % 8 * 10.0), 6).alias("density"))


def rect_edits(spark, sf):
    """Words' boxes clipped to a page, and whether they hold a point."""
    w = M.words(spark, sf)
    r = G.rect_clipped(G.rect(F.col("left"), F.col("top"), F.col("right"), F.col("bottom")), F.lit(333.0), F.lit(222.0))
    return w.select("doc_id", "pos", r.alias("r")).groupBy("doc_id").agg(F.count_if(G.rect_contains(F.col("r"), F.lit(120.0), F.lit(60.0))).alias("hits"), *(F.sum(F.col("r")[c]).alias(c) for c in ("left", "top", "right", "bottom")))


# ---- policies


def region_modes(spark, sf):
    kinds = "HEADER BODY FOOTER TABLE CAPTION SIDEBAR MARGIN_NOTE COLUMN FIGURE".split()
    e = M.table(spark, sf, "events").select("event_id", F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 9 + 1).cast("int")).alias("kind"))
    turn = P.turns_for_export(F.col("event_id") % 2 == 0, F.element_at(F.array(F.lit("Metadata"), F.lit("pixels"), F.lit(None)), (F.col("event_id") % 3 + 1).cast("int")), F.col("event_id") % 5 * 90 - 180)
    return e.select("event_id", P.reading_mode(F.col("kind")).alias("mode"), turn.alias("turn"))


def default_rectangles(spark, sf):
    """Rectangles a few pixels off the one that stands in for none."""
    e, w, h = F.col("event_id"), F.col("event_id") % 500 + 100.0, F.col("event_id") % 300 + 150.0
    m = F.greatest(F.lit(20), F.floor(F.least(w, h) / 10)) + e % 7 - 3
    q = G.quad(m, m, w - m, m, w - m, h - m, m, h - m)
    return M.table(spark, sf, "events").select("event_id", P.is_default_rectangle(q, w, h).alias("stand_in"))


def dated_names(spark, sf):
    ts = F.col("ts")
    return M.table(spark, sf, "events").select("event_id", P.date_name(F.lit("scan {date} at {time}"), ts).alias("name"), P.document_name(ts).alias("document"))


def shared_characters(spark, sf):
    e = F.col("event_id")
    s = N.share_characters(F.array(e % 5 + 1.0, e % 3 + 1.0, e % 7 + 1.0), (e % 9).cast("int"))
    return M.table(spark, sf, "events").select("event_id", F.array_join(F.transform(s, lambda x: F.concat_ws("-", x["start"], x["end"])), " ").alias("ranges"))


def model_choices(spark, sf):
    spec = F.concat(F.lit("xx; "), F.upper("lang"), F.when(F.col("doc_id") % 3 == 0, F.lit("+rus")).otherwise(F.lit(",tlh")))
    d = M.table(spark, sf, "documents").select("doc_id", A.model_of(spec).alias("model"))
    return d.select("doc_id", "model", A.model_file(F.col("model")).alias("file"))


def table_grids(spark, sf):
    xs, ys = F.array(F.lit(0), F.col("event_id") % 50 + 10, F.lit(100)), F.array(F.lit(5), F.col("event_id") % 30 + 20, F.lit(80))
    cells = M.table(spark, sf, "events").select("event_id", F.round(Y.table_confidence(F.col("event_id") % 9, F.col("event_id") % 4), 6).alias("conf"), F.inline(Y.table_cells(xs, ys)))
    return cells.select("event_id", "conf", "row", "col", "left", "top", "right", "bottom")


# ---- assembly


def numbered_words(spark, sf):
    n = A.numbered(M.words(spark, sf), "doc_id", "pos")
    return n.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), *(F.sum(F.col("b")[k]).alias(f"b{k}") for k in range(4)), F.round(F.sum("c"), 4).alias("c"))


def words_in_reading_order(spark, sf):
    w = M.words(spark, sf).select("doc_id", F.col("pos").alias("id"), F.col("w").alias("t"), F.col("left").cast("int").alias("left"), F.col("top").cast("int").alias("top"))
    lines = w.groupBy("doc_id", F.expr("id div 7").alias("nth")).agg(F.min("top").alias("top"), F.collect_list("id").alias("ids"))
    return A.words_for_reading(lines, w, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("place") * (F.col("id") + 1)).alias("mark"))


def retries(spark, sf):
    c = M.table(spark, sf, "conversations")
    one = lambda text, k: F.struct(text.alias("text"), (F.col("conv_id") * k % 100).cast("double").alias("conf"), F.size(F.split(text, " ")).alias("words"))
    base, again = one(F.col("text"), 31), one(F.substring("text", 3, 400), 37)
    return c.groupBy("conv_id").agg(F.count_if(A.retry_choice(base, again)).alias("taken"), F.count("*").alias("n"))


def region_pages(spark, sf):
    r = AQ._regions(spark, sf).withColumn("type", F.when(F.col("id") % 6 == 0, "FIGURE").otherwise(F.col("type"))).withColumns({"right": F.col("left") + F.col("id") % 90, "bottom": F.col("top") + 70, "text": F.when(F.col("id") % 4 > 0, F.concat(F.lit("t"), F.col("id"))), "conf": (F.col("id") % 97).cast("int")})
    return A.region_texts(r, "page", "id").select("page", F.md5("text").alias("md5"), "conf", "n")


def page_bands(spark, sf):
    """Headers and footers of documents read as pages of 6 columns."""
    chars = M.table(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "")).alias("k", "c"))
    return A.bands(chars.where("c <> ''").select("page", (F.col("k") % 6).alias("x"), F.floor(F.col("k") / 6).alias("y"), F.when(F.col("c").rlike("[aeiou]"), 1).otherwise(0).alias("px"))).select("page", "type", "top", "bottom", F.round("conf", 6).alias("conf"))


def _sheets(spark, sf):
    """Documents as sheets of 120 places with a gap in the middle."""
    d = M.table(spark, sf, "documents").where("length(text) > 0").select("doc_id", F.col("text").alias("t"))
    ink = F.transform(F.split(F.rpad("t", F.expr("cast(ceil(length(t) / 120) AS int) * 120"), F.lit(" ")), ""), lambda c, i: (c.rlike("[a-z]") & ~(i % 120).between(54, 64)).cast("int"))
    return d.select("doc_id", F.slice(ink, F.lit(1), F.expr("cast(ceil(length(t) / 120) AS int) * 120")).alias("a"), F.lit(120).alias("w"))


def sheet_regions(spark, sf):
    return Q.analyze(_sheets(spark, sf), "doc_id", "a", "w")


def letter_heights(spark, sf):
    return Q.median_height(_sheets(spark, sf), "doc_id", "a", "w")


def map_text_boxes(spark, sf):
    maps = AQ._maps(spark, sf).select("vec_id", F.transform("a", lambda v: G.sigmoid(v * 3)).alias("p"), F.lit(8).alias("w"))
    return Q.text_boxes(maps, "vec_id", "p", "w").select("vec_id", "nth", *(F.round(c, 6).alias(c) for c in ("left", "top", "right", "bottom", "score")))


def layout_summaries(spark, sf):
    r = AQ._regions(spark, sf).withColumn("type", F.when(F.col("id") % 13 == 0, "TABLE").when(F.col("id") % 2 == 0, "COLUMN").otherwise(F.col("type"))).where("id % 3 > 0 OR page % 2 = 0")
    return A.layout_summary(r, "page")


def narrow_parts(spark, sf):
    p = M.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("name"), (F.col("p_size") * 3).alias("height"), (F.col("p_partkey") % 17 + 5).alias("width"))
    top, stats = A.narrow_pages(p)
    return top.select(F.lit("top").alias("kind"), "name", F.round("aspect", 6).alias("value")).unionByName(stats.select(F.lit("mean").alias("kind"), F.lit(None).cast("string").alias("name"), F.round("mean", 6).alias("value"))).unionByName(stats.select(F.lit("narrow").alias("kind"), F.lit(None).cast("string").alias("name"), F.col("narrow").cast("double").alias("value")))


def trainable_labels(spark, sf):
    """Labels made of events' quads with their corners in another order, some without an image."""
    f = GQ.frames(spark, sf)
    q = F.col("q")
    labels = f.select(F.col("event_id").cast("string").alias("image"), F.lit(220).alias("width"), F.lit(240).alias("height"), F.when(F.col("event_id") % 3 == 0, F.array(q[2], q[0], q[3], q[1])).otherwise(q).alias("q"))
    t = D.trainable(labels, f.where("event_id % 11 > 0").select(F.col("event_id").cast("string").alias("name")))
    return t.select("image", "reordered", F.array_join("reasons", ",").alias("reasons"), "valid")


def region_trees(spark, sf):
    """Regions whose parent is an earlier one of the page, some of them tables."""
    r = AQ._regions(spark, sf).withColumn("type", F.when(F.col("id") % 4 == 0, "TABLE").otherwise("BODY"))
    first = F.min("id").over(Window.partitionBy("page"))
    r = r.withColumn("parent", F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(first))
    return Y.tree_order(r, "page")


def sharpness(spark, sf):
    return AQ._maps(spark, sf).select("vec_id", F.round(N.laplacian_variance(F.col("a"), F.lit(8)), 5).alias("variance"))


def model_languages(spark, sf):
    d = M.table(spark, sf, "documents").select(F.concat("lang", F.when(F.col("doc_id") % 2 == 0, ".traineddata").otherwise(".txt")).alias("name"), "source")
    return S.listed_languages(d.select("name"), d.select(F.concat("source", F.lit(".traineddata")).alias("name")))


def outdated_files(spark, sf):
    f = M.table(spark, sf, "events").select(F.concat(F.when(F.col("event_id") % 2 == 0, "Scan_").otherwise("x_"), "event_id", F.when(F.col("event_id") % 3 == 0, ".png").otherwise(".jpg")).alias("name"), F.col("ts").alias("modified"))
    now = F.lit("2024-01-15 00:00:00").cast(f.schema["modified"].dataType)
    return S.outdated(f, now, 24, "Scan_", ".jpg").select("name")


def event_report(spark, sf):
    """A report as one JSON text, and the same rows read back from its array."""
    by = M.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    rows = F.from_json("value", "array<struct<event_type: string, n: bigint, mean: double>>")
    return S.report(by, 4).select(F.inline(rows))


QUERIES = {f.__name__: f for f in (
    crop_edges, crop_scores, projective_ratios, clamped_points, mask_disagreements, suspicions, page_sizes, quad_points, quad_strips, quad_flips, polygon_masks, sizes, rect_edits,
    region_modes, default_rectangles, dated_names, shared_characters, model_choices, table_grids,
    numbered_words, words_in_reading_order, retries, region_pages, page_bands, layout_summaries, narrow_parts,
    trainable_labels, region_trees, sharpness, model_languages, outdated_files, event_report, sheet_regions, letter_heights, map_text_boxes,
)}


def _corner(k, soft):
    """Degrees at corner k."""
    p, n = (k + 3) % 4, (k + 1) % 4
    dot = f"((x{p} - x{k}) * (x{n} - x{k}) + (y{p} - y{k}) * (y{n} - y{k}))"
    return f"degrees(acos(greatest(-1, least(1, {dot} / ({GQ._d(p, k)} * {GQ._d(n, k)} + {soft})))))"


def _near(v, best, span):
    return f"(1 - least(1, abs({v} - {best}) / {span}))"


def _det(a, b, c):
    x, y = (lambda k: f"(x{k} - {GQ.W_ / 2})"), (lambda k: f"(y{k} - {GQ.H_ / 2})")
    return f"({x(a)} * ({y(b)} - {y(c)}) - {y(a)} * ({x(b)} - {x(c)}) + ({x(b)} * {y(c)} - {x(c)} * {y(b)}))"


def _within(x, y, names=GQ.NAMES):
    """A point in the quad of these columns or on its edge."""
    on, odd = [], []
    for i in range(4):
        j = (i + 1) % 4
        ax, ay, bx, by = names[2 * i], names[2 * i + 1], names[2 * j], names[2 * j + 1]
        on.append(f"(abs(({bx} - {ax}) * ({y} - {ay}) - ({by} - {ay}) * ({x} - {ax})) <= 1e-9 AND {x} BETWEEN least({ax}, {bx}) - 1e-9 AND greatest({ax}, {bx}) + 1e-9 AND {y} BETWEEN least({ay}, {by}) - 1e-9 AND greatest({ay}, {by}) + 1e-9)")
        odd.append(f"CASE WHEN ({ay} > {y}) <> ({by} > {y}) AND {x} < ({bx} - {ax}) * ({y} - {ay}) / CASE WHEN {by} = {ay} THEN 1 ELSE {by} - {ay} END + {ax} THEN 1 ELSE 0 END")
    return f"({' OR '.join(on)} OR ({' + '.join(odd)}) % 2 = 1)"


def _edge(i):
    j = (i + 1) % 4
    n = f"((x{j} - x{i}) * (x{j} - x{i}) + (y{j} - y{i}) * (y{j} - y{i}))"
    t = f"greatest(0, least(1, ((px - x{i}) * (x{j} - x{i}) + (py - y{i}) * (y{j} - y{i})) / {n}))"
    return f"SELECT event_id, {i} AS i, {t} AS t, sqrt(pow(px - (x{i} + {t} * (x{j} - x{i})), 2) + pow(py - (y{i} + {t} * (y{j} - y{i})), 2)) AS d FROM p"


HEAD = f"f AS (SELECT *, {AQ.GQ._d(1, 2)} AS len FROM raw)"
RAW = GQ.FRAMES.replace("f AS", "raw AS", 1)
MOVED = [n if n[1] in "03" else f"({n} + d * n{n[0]})" for n in GQ.NAMES]


def _renamed(sql, names):
    for k, n in enumerate(GQ.NAMES):
        sql = sql.replace(n, f"@{k}@")
    for k, n in enumerate(names):
        sql = sql.replace(f"@{k}@", n)
    return sql


IMAGE = f"least({', '.join(GQ.NAMES)}) >= 0 AND greatest({', '.join(GQ.NAMES[::2])}) <= {GQ.W_} AND greatest({', '.join(GQ.NAMES[1::2])}) <= {GQ.H_} AND abs({GQ.AREA}) >= 0.02 * {GQ.W_ * GQ.H_} AND (least({GQ.TURNS}) > 0 OR greatest({GQ.TURNS}) < 0)"
BALANCE = lambda i, j: f"(CASE WHEN greatest({GQ.E_[i]}, {GQ.E_[j]}) > 0 THEN least({GQ.E_[i]}, {GQ.E_[j]}) / greatest({GQ.E_[i]}, {GQ.E_[j]}) ELSE 0 END)"
COVER = f"((greatest({', '.join(GQ.NAMES[::2])}) - least({', '.join(GQ.NAMES[::2])})) * (greatest({', '.join(GQ.NAMES[1::2])}) - least({', '.join(GQ.NAMES[1::2])})) / {GQ.W_ * GQ.H_})"
ANGLES = [_corner(k, "1e-9") for k in range(4)]
FIXED = dict(zip(GQ.NAMES, ("1.0", "0.0", "6.5", "1.5", "7.5", "7.0", "0.5", "6.0"), strict=True))
SMALL = [f"(greatest(0, least(223, {n})) / 28)" for n in GQ.NAMES]
ORACLE_SQL = {
    "crop_edges": W(RAW, HEAD, "a AS (SELECT *, CASE WHEN -(y2 - y1) * (x1 + x2 - x3 - x0) + (x2 - x1) * (y1 + y2 - y3 - y0) >= 0 THEN 1 ELSE -1 END / len AS s FROM f)", "b AS (SELECT *, -(y2 - y1) * s AS nx, (x2 - x1) * s AS ny FROM a)",
        "c AS (SELECT *, (event_id % 400 - 100 - (x1 + x2) / 2) * nx + (event_id % 300 - (y1 + y2) / 2) * ny AS d FROM b)",
        f"g AS (SELECT *, {_renamed(GQ.SHORT, MOVED)} >= 1 AND (least({_renamed(GQ.TURNS, MOVED)}) > 0 OR greatest({_renamed(GQ.TURNS, MOVED)}) < 0) AND ({_renamed(GQ.AREA, MOVED)}) * ({GQ.AREA}) > 0 AS moved FROM c)")
    + "SELECT event_id, moved, round(nx, 6) + 0 AS nx, round(ny, 6) + 0 AS ny, round(CASE WHEN moved THEN d * nx ELSE 0 END, 6) + 0 AS dx, round(CASE WHEN moved THEN d * ny ELSE 0 END, 6) + 0 AS dy, round(CASE WHEN moved THEN x2 + d * nx ELSE x2 END, 6) AS x2, round(CASE WHEN moved THEN y2 + d * ny ELSE y2 END, 6) AS y2 FROM g",
    "crop_scores": W(GQ.FRAMES, f"s AS (SELECT *, {GQ.LONG} AS long_, {GQ.E_[0]} + {GQ.E_[2]} >= {GQ.E_[1]} + {GQ.E_[3]} AS wide FROM f)")
    + f"""SELECT event_id, CASE WHEN {IMAGE} THEN round(0.35 * {_near(f'abs({GQ.AREA}) / {GQ.W_ * GQ.H_}', 0.6, 0.6)} + 0.3 * least(1, {', '.join(_near(_corner(k, 0), 90, 90) for k in range(4))}) + 0.2 * ({BALANCE(0, 2)} + {BALANCE(3, 1)}) / 2 + 0.15 * {_near(COVER, 0.7, 0.7)}, 6) END AS score,
        CASE WHEN least({', '.join(ANGLES)}) < 60 OR greatest({', '.join(ANGLES)}) > 120 THEN -1 ELSE round({' + '.join(f'greatest(0, 30 - abs({a} - 90))' for a in ANGLES)}, 6) END AS corners,
        CAST(greatest(1, floor(CASE WHEN wide THEN long_ ELSE long_ * 0.7071 END + 0.5)) + 1 AS INTEGER) AS w, CAST(greatest(1, floor(CASE WHEN wide THEN long_ * 0.7071 ELSE long_ END + 0.5)) + 1 AS INTEGER) AS h FROM s""",
    "projective_ratios": W(GQ.FRAMES, f"k AS (SELECT *, {_det(1, 3, 2)} AS b2, {_det(3, 1, 2)} AS b3, {_det(0, 3, 2)} / nullif({_det(1, 3, 2)}, 0) AS k2, {_det(0, 1, 2)} / nullif({_det(3, 1, 2)}, 0) AS k3 FROM f)",
        f"n AS (SELECT event_id, b2, b3, k2 * (x1 - {GQ.W_ / 2}) - (x0 - {GQ.W_ / 2}) AS ax, k2 * (y1 - {GQ.H_ / 2}) - (y0 - {GQ.H_ / 2}) AS ay, k2 - 1 AS az, k3 * (x3 - {GQ.W_ / 2}) - (x0 - {GQ.W_ / 2}) AS bx, k3 * (y3 - {GQ.H_ / 2}) - (y0 - {GQ.H_ / 2}) AS by_, k3 - 1 AS bz FROM k)",
        f"g AS (SELECT *, CASE WHEN -(ax * bx + ay * by_) / nullif(az * bz, 0) > 0 THEN -(ax * bx + ay * by_) / (az * bz) ELSE {max(GQ.W_, GQ.H_) ** 2} END AS ff FROM n)", "r AS (SELECT *, bx * bx + by_ * by_ + bz * bz * ff AS den, (ax * ax + ay * ay + az * az * ff) / nullif(bx * bx + by_ * by_ + bz * bz * ff, 0) AS ratio FROM g)")
    + "SELECT event_id, CASE WHEN abs(b2) >= 1e-9 AND abs(b3) >= 1e-9 AND abs(az) >= 1e-6 AND abs(bz) >= 1e-6 AND den >= 1e-12 AND ratio > 0 THEN round(sqrt(ratio), 5) END AS ratio FROM r",
    "clamped_points": W(GQ.FRAMES) + f"SELECT event_id, round(greatest({-0.25 * GQ.W_}, least({1.25 * GQ.W_}, x0 * 9 - 60)), 6) AS x, round(greatest({-0.25 * GQ.H_}, least({1.25 * GQ.H_}, y0 * 11 - 70)), 6) AS y FROM f",
    "mask_disagreements": W(AQ.CELLS) + f"SELECT vec_id, 10.0::DOUBLE * count(*) FILTER (WHERE {_within('(i % 8 + 0.5)', '(i // 8 + 0.5)', [FIXED[n] for n in GQ.NAMES])} <> (v > 0)) AS penalty FROM cells GROUP BY vec_id",
    "suspicions": "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'LOW_PEAK_MARGIN' WHEN event_id % 10 / 10 > 0.4 AND event_id % 7 * 30 < 100 THEN 'MASK_DIFFUSE' WHEN event_id % 3 = 0 AND event_id % 13 * 1000 > 10000 THEN 'MASK_FALLBACK_AND_PCORNER' WHEN event_id % 3 <> 0 AND event_id % 2 <> 0 AND event_id % 90 > 64 THEN 'DISAGREE_64PX' WHEN CASE WHEN event_id % 2 = 0 THEN event_id % 17 ELSE event_id % 13 END * 1000 >= 10000 THEN 'GEOMETRY_IMPLAUSIBLE' END AS reason FROM events",
    "page_sizes": """WITH e AS (SELECT event_id, list_extract(['A4', 'US_LETTER', 'LEGAL', 'FIT_TO_IMAGE', 'other'], event_id % 5 + 1) AS name, (event_id % 70 + 30) / (event_id % 50 + 30) AS r FROM events)
        SELECT event_id, name, round(CASE name WHEN 'FIT_TO_IMAGE' THEN CASE WHEN r >= 1 THEN 841.8898 ELSE 841.8898 * r END WHEN 'US_LETTER' THEN 612 WHEN 'LEGAL' THEN 612 ELSE 595.27563 END, 4) AS w,
        round(CASE name WHEN 'FIT_TO_IMAGE' THEN CASE WHEN r >= 1 THEN 841.8898 / r ELSE 841.8898 END WHEN 'US_LETTER' THEN 792 WHEN 'LEGAL' THEN 1008 ELSE 841.8898 END, 4) AS h FROM e""",
    "quad_points": W(GQ.FRAMES, "p AS (SELECT *, event_id % 230 - 10.0::DOUBLE AS px, event_id * 7 % 250 - 10.0::DOUBLE AS py FROM f)", "s AS (" + " UNION ALL ".join(_edge(i) for i in range(4)) + ")", "h AS (SELECT event_id, arg_min(i, d * 1000 + i * 1e-9) AS i FROM s WHERE d < 24 AND t > 0.15 AND t < 0.85 GROUP BY event_id)",
        "n AS (SELECT *, (x0 - x2) * (y1 - y3) - (y0 - y2) * (x1 - x3) AS n, x0 * y2 - y0 * x2 AS u, x1 * y3 - y1 * x3 AS v FROM p)")
    + f"SELECT n.event_id, {_within('px', 'py')} AS within, CAST(coalesce(i, -1) AS INTEGER) AS edge, CASE WHEN abs(n) > 1e-9 THEN round((u * (x1 - x3) - (x0 - x2) * v) / n, 6) END AS cx, CASE WHEN abs(n) > 1e-9 THEN round((u * (y1 - y3) - (y0 - y2) * v) / n, 6) END AS cy FROM n LEFT JOIN h ON n.event_id = h.event_id",
    "quad_strips": W(GQ.FRAMES) + "SELECT event_id, round(x0 + (x1 - x0) * k / 3, 6) AS x0, round(x0 + (x1 - x0) * (k + 1) / 3, 6) AS x1, round(y3 + (y2 - y3) * (k + 1) / 3, 6) AS y2, round(y3 + (y2 - y3) * k / 3, 6) AS y3 FROM f, range(3) AS r(k)",
    "quad_flips": W(GQ.FRAMES, "both_ AS (SELECT 0 AS side, * FROM f UNION ALL SELECT 1, event_id, " + ", ".join(f"{n} + event_id % 50" if n[0] == "x" else n for n in GQ.NAMES) + " FROM f)",
        f"s AS (SELECT event_id, side, {' + '.join(GQ._beyond(256.0, 256.0, 2.0))} AS soft, greatest({', '.join(GQ._beyond(256.0, 256.0, 2.0))}) AS far, {GQ.CROSSING} AS crossing, {GQ._convex(1e-9)} AS convex, abs({GQ.AREA}) AS area, {GQ.SHORT} AS short, {GQ.LONG} / greatest({GQ.SHORT}, 1e-9) AS ratio FROM both_)",
        """p AS (SELECT event_id, side, soft * 10 + CASE WHEN far > 16 THEN 1e5 + (far - 16) * 1000 ELSE 0 END + CASE WHEN crossing THEN 1e6 ELSE 0 END + CASE WHEN convex THEN 0 ELSE 1e6 END + CASE WHEN area > 1 THEN 0 ELSE 1e6 END
            + CASE WHEN short < 8 THEN (8 - short) * 1000 ELSE 0 END + CASE WHEN ratio > 25 THEN (ratio - 25) * 100 ELSE 0 END AS penalty FROM s)""",
        "c AS (SELECT event_id, max(penalty) FILTER (side = 0) AS a, max(penalty) FILTER (side = 1) AS b FROM p GROUP BY event_id)")
    + """SELECT f.event_id, x1 AS ax, y3 AS ay, x3 AS bx, y1 AS by, CASE WHEN f.event_id % 9 = 0 THEN 'CORNERS' WHEN a >= 1e5 AND b < 1e5 THEN 'MASK' WHEN b >= 1e5 OR f.event_id % 50 > 32 THEN 'CORNERS' WHEN b < a - 50 THEN 'MASK' ELSE 'CORNERS' END AS chosen
        FROM f JOIN c ON f.event_id = c.event_id""",
    "polygon_masks": W(GQ.FRAMES, "g AS (SELECT f.*, c % 8 + 0.5 AS gx, c // 8 + 0.5 AS gy FROM f, range(64) AS r(c))")
    + f"SELECT event_id, CAST(count(*) FILTER (WHERE {_within('gx', 'gy', SMALL)}) AS INTEGER) AS cells, round(sum(exp(-(pow(gx - {SMALL[4]}, 2) + pow(gy - {SMALL[5]}, 2)) / 4.5)), 6) AS heat FROM g GROUP BY event_id",
    "sizes": """WITH s AS (SELECT *, event_id % 900 + 1 AS w_, event_id % 700 + 1 AS h_, least(400 / (event_id % 900 + 1), 300 / (event_id % 700 + 1)) AS k FROM events)
        SELECT event_id, CAST(greatest(1, floor(w_ * k + 0.5)) AS INTEGER) AS w, CAST(greatest(1, floor(h_ * k + 0.5)) AS INTEGER) AS h, ((event_id - 500) % 360 + 360) % 360 AS turn, CAST(floor(event_id % 300 / 25.4 * 150 + 0.5) AS INTEGER) AS pixels,
        round(1 / (1 + exp(-value / 50)), 6) AS p, round(CASE WHEN event_id % 8 = 0 THEN 0 ELSE event_id % 40 / (event_id % 8 * 10) END, 6) AS density FROM s""",
    "rect_edits": W(M.WORDS, 'r AS (SELECT doc_id, least("left", 333) AS l, least(top, 222) AS t, least("right", 333) AS r, least(bottom, 222) AS b FROM words)')
    + 'SELECT doc_id, count(*) FILTER (WHERE 120 >= l AND 120 < r AND 60 >= t AND 60 < b) AS hits, sum(l) AS "left", sum(t) AS top, sum(r) AS "right", sum(b) AS bottom FROM r GROUP BY doc_id',
    "region_modes": "SELECT event_id, list_extract([6, 3, 7, 6, 7, 6, 6, 4, 3], event_id % 9 + 1) AS mode, event_id % 5 <> 2 AND (event_id % 2 <> 0 OR event_id % 3 = 0) AS turn FROM events",
    "default_rectangles": "SELECT event_id, abs(event_id % 7 - 3) <= 2.5 AS stand_in FROM events",
    "dated_names": "SELECT event_id, concat('scan ', strftime(ts, '%Y-%m-%d'), ' at ', strftime(ts, '%H%M%S')) AS name, concat('DOC_', strftime(ts, '%Y%m%d_%H%M%S')) AS document FROM events",
    "shared_characters": """WITH s AS (SELECT event_id, event_id % 9 AS n, event_id % 5 + 1 AS a, event_id % 3 + 1 AS b, event_id % 7 + 1 AS c FROM events), e AS (SELECT *, least(n, greatest(floor(a * n / (a + b + c) + 0.5), 1)) AS e1 FROM s), g AS (SELECT *, least(n, greatest(floor((a + b) * n / (a + b + c) + 0.5), e1 + 1)) AS e2 FROM e)
        SELECT event_id, concat(0, '-', CAST(e1 AS INTEGER), ' ', CAST(e1 AS INTEGER), '-', CAST(e2 AS INTEGER), ' ', CAST(e2 AS INTEGER), '-', CAST(least(n, greatest(n, e2 + 1)) AS INTEGER)) AS ranges FROM g""",
    "model_choices": "SELECT doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'latin' END AS model, concat(CASE WHEN lang = 'en' THEN 'en' ELSE 'latin' END, '_PP-OCRv5_mobile_rec') AS file FROM documents",
    "table_grids": """WITH x AS (SELECT event_id, c, CASE c WHEN 0 THEN 0 ELSE event_id % 50 + 10 END AS l, CASE c WHEN 0 THEN event_id % 50 + 10 ELSE 100 END AS r FROM events, range(2) AS k(c)), y AS (SELECT event_id, w, CASE w WHEN 0 THEN 5 ELSE event_id % 30 + 20 END AS t, CASE w WHEN 0 THEN event_id % 30 + 20 ELSE 80 END AS b FROM events, range(2) AS k(w))
        SELECT x.event_id, round((least(1, (x.event_id % 9 + x.event_id % 4) / 10) + 0.8) / 2, 6) AS conf, CAST(w AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, l AS "left", t AS top, r AS "right", b AS bottom FROM x JOIN y ON x.event_id = y.event_id""",
    "numbered_words": W(M.WORDS) + 'SELECT doc_id, count(*) AS n, CAST(sum(pos + 1) AS BIGINT) AS ids, CAST(sum(floor("left" + 0.5)) AS BIGINT) AS b0, CAST(sum(floor(top + 0.5)) AS BIGINT) AS b1, CAST(sum(floor("right" - "left" + 0.5)) AS BIGINT) AS b2, CAST(sum(floor(bottom - top + 0.5)) AS BIGINT) AS b3, round(sum(CASE WHEN conf > 1 THEN conf / 100 ELSE conf END), 4) AS c FROM words GROUP BY doc_id',
    "words_in_reading_order": W(M.WORDS, "l AS (SELECT *, min(top) OVER (PARTITION BY doc_id, pos // 7) AS lt FROM words)", 'p AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY lt, pos // 7, "left", top, pos) - 1 AS place FROM l)')
    + "SELECT doc_id, count(*) AS n, CAST(sum(place * (pos + 1)) AS BIGINT) AS mark FROM p GROUP BY doc_id",
    "retries": """WITH r AS (SELECT conv_id, text AS a, substr(text, 3, 400) AS b, conv_id * 31 % 100 AS ca, conv_id * 37 % 100 AS cb FROM conversations), s AS (SELECT *, len(string_split(a, ' ')) AS na, len(string_split(b, ' ')) AS nb FROM r)
        SELECT conv_id, count(*) FILTER (WHERE ca < 50 AND (cb > ca + 10 OR (abs(cb - ca) <= 10 AND (nb > na OR length(b) > length(a))))) AS taken, count(*) AS n FROM s GROUP BY conv_id""",
    "region_pages": W(AQ.REGIONS, "k AS (SELECT page, concat('t', id) AS t, id FROM regions WHERE id % 6 <> 0 AND id % 90 >= 64 AND id % 4 > 0)", "a AS (SELECT page, string_agg(t, concat(chr(10), chr(10)) ORDER BY id) AS text, CAST(sum(id % 97) // count(*) AS INTEGER) AS conf, count(*) AS n FROM k GROUP BY page)")
    + "SELECT p.page, md5(coalesce(text, '')) AS md5, conf, coalesce(n, 0) AS n FROM (SELECT DISTINCT page FROM regions) p LEFT JOIN a ON p.page = a.page",
    "page_bands": """WITH c AS (SELECT doc_id AS page, k % 6 AS x, k // 6 AS y, regexp_matches(c, '[aeiou]') AS ink FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS k FROM documents) AS a WHERE c <> ''),
        s AS (SELECT *, max(x) OVER (PARTITION BY page) + 1 AS w, max(y) OVER (PARTITION BY page) + 1 AS h FROM c),
        b AS (SELECT *, 'HEADER' AS type, 0 AS top, floor(h * 0.12) AS bottom, floor(h * 0.12) AS high FROM s UNION ALL SELECT *, 'FOOTER', h - floor(h * 0.08), h, floor(h * 0.08) FROM s),
        d AS (SELECT page, type, top, bottom, count(*) FILTER (WHERE ink) / max(w * high) AS d FROM b WHERE high >= 20 AND y >= top AND y < bottom GROUP BY page, type, top, bottom)
        SELECT page, type, CAST(top AS INTEGER) AS top, CAST(bottom AS INTEGER) AS bottom, round(least(1, d * 10), 6) AS conf FROM d WHERE d > 0.01 AND d < 0.5""",
    "trainable_labels": W(GQ.FRAMES) + f"""SELECT image, reordered, array_to_string(r, ',') AS reasons, len(r) = 0 AS valid FROM (SELECT CAST(event_id AS VARCHAR) AS image, event_id % 3 = 0 AS reordered, list_filter([CASE WHEN event_id % 11 = 0 THEN 'missing_image_file' END, CASE WHEN least({', '.join(GQ.NAMES)}) < 0 OR greatest({', '.join(GQ.NAMES[::2])}) > 219 OR greatest({', '.join(GQ.NAMES[1::2])}) > 239 THEN 'bounds_error' END,
        CASE WHEN NOT {GQ.AREA} > 0 THEN 'area_non_positive' WHEN {GQ.AREA} / 52800 < 0.05 THEN 'area_fraction_lt_0.05' END, CASE WHEN {GQ.CROSSING} THEN 'self_intersection' END, CASE WHEN least({', '.join(f'abs({GQ._turn(i)})' for i in range(4))}) <= 1e-9 THEN 'degenerate' END, CASE WHEN NOT ({GQ._convex(1e-9)}) THEN 'not_convex' END], lambda x: x IS NOT NULL) AS r FROM f) AS a""",
    "region_trees": AQ.R(AQ.REGIONS, "o AS (SELECT *, min(id) OVER (PARTITION BY page) AS first FROM regions)", "m AS (SELECT o.*, CASE WHEN id % 5 = 0 THEN -1 ELSE first END AS parent, id % 5 <> 0 AND first % 4 = 0 AS cell FROM o)", "u AS (SELECT * FROM m WHERE NOT cell)", *AQ._bands("u", "parent"))
    + "SELECT page, parent, id, CAST(row_number() OVER (PARTITION BY page, parent ORDER BY row_index, col_index * side, id) - 1 AS INTEGER) AS reading_order FROM m WHERE cell UNION ALL SELECT u.page, u.parent, u.id, CAST(row_number() OVER (PARTITION BY u.page, u.parent ORDER BY band, l * side, t, u.id) - 1 AS INTEGER) FROM u JOIN bands b ON u.page = b.page AND u.id = b.id",
    "sharpness": W(AQ.CELLS, "g AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, v FROM cells)", "e AS (SELECT c.vec_id, c.x, c.y, sum(n.v) - 4 * max(c.v) AS e FROM g c, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS d(dx, dy), g n WHERE n.vec_id = c.vec_id AND n.x = CASE WHEN c.x + dx < 0 THEN 1 WHEN c.x + dx > 7 THEN 6 ELSE c.x + dx END AND n.y = CASE WHEN c.y + dy < 0 THEN 1 WHEN c.y + dy > 7 THEN 6 ELSE c.y + dy END GROUP BY c.vec_id, c.x, c.y)")
    + "SELECT vec_id, round(avg(e * e) - avg(e) * avg(e), 5) AS variance FROM e GROUP BY vec_id",
    "model_languages": "SELECT DISTINCT language FROM (SELECT lang AS language FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT source FROM documents) AS l WHERE language IS NOT NULL",
    "outdated_files": "SELECT concat('Scan_', event_id, '.jpg') AS name FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0 AND ts < TIMESTAMP '2024-01-14 00:00:00'",
    "event_report": "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY event_type",
    "layout_summaries": W(AQ.REGIONS, "k AS (SELECT page, column_index, CASE WHEN id % 13 = 0 THEN 'TABLE' WHEN id % 2 = 0 THEN 'COLUMN' ELSE type END AS type FROM regions WHERE id % 3 > 0 OR page % 2 = 0)", "a AS (SELECT page, greatest(1, coalesce(max(CASE WHEN type = 'COLUMN' THEN column_index + 1 END), 1)) AS columns, bool_or(type = 'TABLE') AS has_table, bool_or(type = 'HEADER') AS has_header, bool_or(type = 'FOOTER') AS has_footer FROM k GROUP BY page)")
    + "SELECT *, columns > 1 OR has_table AS complex FROM a",
    "narrow_parts": """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS name, p_size * 3 / (p_partkey % 17 + 5) AS aspect FROM part) SELECT * FROM (SELECT 'top' AS kind, name, round(aspect, 6) AS value FROM p ORDER BY aspect DESC, name LIMIT 20) AS t
        UNION ALL SELECT 'mean', NULL, round(avg(aspect), 6) FROM p UNION ALL SELECT 'narrow', NULL, CAST(count(*) FILTER (WHERE aspect >= 2) AS DOUBLE) FROM p""",
}
