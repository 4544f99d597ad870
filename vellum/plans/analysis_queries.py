"""Queries of reading order, tensors, evaluation, dataset preparation, sources and stream filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import policies as P
from vellum.functions import quads as G
from vellum.functions import tensors as N
from vellum.functions import text as T
from vellum.operators import datasets as D
from vellum.operators import evaluation as E
from vellum.operators import layout as Y
from vellum.operators import review as V
from vellum.plans import geometry_queries as GQ
from vellum.plans import model as M
from vellum.sources import documents as S
from vellum.streaming import filters as X

W = M.with_


def R(*parts):
    """W with parts that may refer to themselves."""
    return W(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


# ---- reading order


def _lined(spark, sf, rule):
    p = Y.pages(M.words(spark, sf)).withColumn("line", rule(F.col("words")))
    return p.select("doc_id", F.size("words").alias("words"), F.array_max("line").alias("last"), F.md5(F.array_join(F.transform("line", lambda x: x.cast("string")), ",")).alias("lines"))


def lines_fixed_anchor(spark, sf):
    return _lined(spark, sf, Y.fixed_anchor_lines)


def lines_integer_fit(spark, sf):
    return _lined(spark, sf, Y.integer_first_fit_lines)


def lines_decimal_fit(spark, sf):
    return _lined(spark, sf, Y.decimal_first_fit_lines)


def lines_running_mean(spark, sf):
    p = Y.pages(M.words(spark, sf)).withColumn("l", Y.running_mean_lines(F.col("words")))
    return p.select("doc_id", F.array_max(F.transform("l", lambda x: x["line"])).alias("last"), F.md5(F.array_join(F.transform(F.array_sort("l"), lambda x: F.concat_ws(":", x["pos"], x["line"])), ",")).alias("lines"))


def words_to_text(spark, sf):
    return Y.words_to_text(M.words(spark, sf)).select("doc_id", F.length("text").alias("n"), F.md5("text").alias("md5"))


def _regions(spark, sf):
    return M.table(spark, sf, "events").selectExpr(
        "user_id AS page", "event_id AS id", "cast(event_id * 37 % 600 AS int) AS left", "cast(event_id * 91 % 900 AS int) AS top", "cast(event_id * 37 % 600 + 50 AS int) AS right",
        "cast(event_id * 91 % 900 + 20 + event_id % 15 AS int) AS bottom", "cast(event_id % 4 - 1 AS int) AS column_index",
        "CASE event_id % 11 WHEN 0 THEN 'HEADER' WHEN 1 THEN 'FOOTER' ELSE 'BODY' END AS type", "CASE WHEN user_id % 3 = 0 THEN 'RTL' ELSE 'LTR' END AS direction",
        "1000 AS page_height", "cast(event_id % 7 AS int) AS row_index", "cast(event_id % 5 AS int) AS col_index",
    )


REGIONS = """regions AS (SELECT user_id AS page, event_id AS id, CAST(event_id * 37 % 600 AS INTEGER) AS l, CAST(event_id * 37 % 600 + 50 AS INTEGER) AS r, CAST(event_id * 91 % 900 AS INTEGER) AS t, CAST(event_id * 91 % 900 + 20 + event_id % 15 AS INTEGER) AS b,
    CAST(event_id % 4 - 1 AS INTEGER) AS column_index, CASE event_id % 11 WHEN 0 THEN 'HEADER' WHEN 1 THEN 'FOOTER' ELSE 'BODY' END AS type, CASE WHEN user_id % 3 = 0 THEN -1 ELSE 1 END AS side,
    CAST(event_id % 7 AS INTEGER) AS row_index, CAST(event_id % 5 AS INTEGER) AS col_index FROM events)"""


def regions_banded(spark, sf):
    return Y.banded_order(_regions(spark, sf), "page", F.col("direction"))


def regions_by_column(spark, sf):
    return Y.column_order(_regions(spark, sf), "page")


def regions_table(spark, sf):
    return Y.table_order(_regions(spark, sf), "page").select("page", "id", "reading_order")


def region_zones(spark, sf):
    return Y.zones(_regions(spark, sf)).groupBy("page", "type").agg(F.count("*").alias("n"))


def zone_kendall(spark, sf):
    a = Y.column_order(_regions(spark, sf), "page").withColumnRenamed("reading_order", "place")
    b = Y.table_order(_regions(spark, sf), "page").withColumnRenamed("reading_order", "place")
    return Y.kendall(a, b, "page", "id").select("page", "discordant", "pairs", F.round("accuracy", 6).alias("accuracy"))


def _profile(spark, sf):
    """Ink by column: letters at each place of a document's lines of 60, as a page of 60 columns (the last ones may be missing)."""
    chars = M.table(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "")).alias("k", "c"))
    return Y.vertical_projection(chars.select("page", (F.col("k") % 60).alias("x"), F.floor(F.col("k") / 60).alias("y"), F.when(F.col("c").rlike("[a-z]") & ~((F.col("k") % 60).between(28, 31)), 1).otherwise(0).alias("px")))


PROFILE = "profile AS (SELECT page, CAST(k % 60 AS INTEGER) AS x, CAST(count(*) FILTER (WHERE regexp_matches(c, '[a-z]') AND NOT k % 60 BETWEEN 28 AND 31) AS INTEGER) AS v FROM (SELECT doc_id AS page, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS k FROM documents) AS a GROUP BY page, k % 60)"


def ink_profile(spark, sf):
    return _profile(spark, sf)


def ink_smoothed(spark, sf):
    return Y.smoothed(_profile(spark, sf), 5)


def ink_valleys(spark, sf):
    return Y.valleys(_profile(spark, sf)).select("page", "start", "end", "least")


def ink_columns(spark, sf):
    v = Y.valleys(_profile(spark, sf))
    p = _profile(spark, sf).groupBy("page").agg(F.count("*").cast("int").alias("width"))
    return Y.columns(p, Y.best_valley(v))


def ink_detected(spark, sf):
    """Columns of documents read as pages of 120 places with a gap that differs by document."""
    chars = M.table(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "")).alias("k", "c"))
    gap = F.col("k") % 120
    ink = F.col("c").rlike("[a-z]") & ~(gap.between(50 + F.col("page") % 17, 50 + F.col("page") % 17 + F.col("page") % 9) & (F.floor(F.col("k") / 120) % 3 < F.col("page") % 4))
    return Y.detect_columns(Y.vertical_projection(chars.select("page", gap.alias("x"), F.floor(F.col("k") / 120).alias("y"), F.when(ink, 1).otherwise(0).alias("px"))))


# ---- tensors


def _maps(spark, sf):
    """Embeddings as 8 x 8 maps."""
    return M.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a"))


def map_peaks(spark, sf):
    p = N.peak(F.col("a"), 8, 1.0)
    return _maps(spark, sf).select("vec_id", N.argmax(F.col("a")).alias("k"), p["x"].alias("x"), p["y"].alias("y"), N.has_low_peak(F.col("a")).alias("low"))


def map_refined(spark, sf):
    r, q = N.refined_peak(F.col("a"), 8, 1.0), N.quadratic_peak(F.col("a"), 8, 1.0)
    return _maps(spark, sf).select("vec_id", *(F.round(p[c], 6).alias(f"{k}{c}") for k, p in (("r", r), ("q", q)) for c in "xy"))


def map_masks(spark, sf):
    s = N.mask_stats(F.col("a"))
    return _maps(spark, sf).select("vec_id", s["area"].alias("area"), F.round(s["mean"], 6).alias("mean"))


def map_boxes(spark, sf):
    q = N.oriented_box(F.col("a"), 8, 1.0)
    return _maps(spark, sf).select("vec_id", F.round(G.area(q), 4).alias("area"), F.round(G.perimeter(q), 4).alias("perimeter"))


def map_iou(spark, sf):
    """Each map against the next one's."""
    a = _maps(spark, sf)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(N.mask_iou(F.col("a"), F.col("b")), 6).alias("iou"))


def map_deviation(spark, sf):
    a = _maps(spark, sf)
    b = a.select("vec_id", F.transform("a", lambda x: F.round(x, 2)).alias("a"))
    return E.deviation(a, b, "vec_id", "a").select(F.round("largest", 6).alias("largest"), F.round("mean", 6).alias("mean"), "rows")


def ctc_texts(spark, sf):
    """Maps read as 8 frames of 8 entries."""
    frames = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("a", i * 8 + 1, F.lit(8)))
    c = N.ctc(frames, F.array(*map(F.lit, ["", "a", "b", " ", "c", "d", "e", "f"])))
    return _maps(spark, sf).select("vec_id", c["text"].alias("text"), F.round(c["conf"], 6).alias("conf"), F.array_join(F.transform(c["tokens"], lambda t: t["text"]), "|").alias("tokens"))


# ---- evaluation


def latency_percentiles(spark, sf):
    return M.table(spark, sf, "events").groupBy("event_type").agg(E.nearest_rank("value", 0.5).alias("p50"), E.nearest_rank("value", 0.95).alias("p95"), F.count("*").alias("n"))


def eval_report(spark, sf):
    t = F.col("text")
    s = M.table(spark, sf, "conversations").select(t.alias("truth"), F.replace(t, F.lit("a"), F.lit("o")).alias("text"), (F.col("turn") % 10 / 10).alias("conf"), (F.col("conv_id") * 7 % 100).alias("latency_ms"))
    r = E.report(s)
    return r.select(*(F.round(c, 6).alias(c) for c in ("cer", "wer", "conf")), "p50", "p95", "n")


def _results(spark, sf):
    f = GQ.frames(spark, sf)
    moved = lambda d: F.transform("q", lambda p: F.named_struct(F.lit("x"), p["x"] + d, F.lit("y"), p["y"] - d / 2))
    rows = lambda m, d: f.select(F.col("event_id").alias("name"), F.lit(m).alias("model"), F.col("q").alias("truth"), moved(d).alias("predicted"), F.lit(220).alias("w"), F.lit(240).alias("h"))
    return E.corner_results(rows("a", F.col("event_id") % 7).unionByName(rows("b", F.col("event_id") % 5)))


def corner_summary(spark, sf):
    s = E.summary(_results(spark, sf))
    return s.select("model", "n", *(F.round(c, 6).alias(c) for c in s.columns if c not in ("model", "n")))


def corner_comparison(spark, sf):
    return E.compare(_results(spark, sf), "a", "b")


def corner_errors(spark, sf):
    r = _results(spark, sf)
    return r.select("name", "model", "reason", F.round("mae", 6).alias("mae"))


# ---- datasets


def paired_labels(spark, sf):
    labels = M.table(spark, sf, "labels").dropDuplicates(["doc_id"])
    docs = M.table(spark, sf, "documents").join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "source")
    return D.pair(docs, labels, "doc_id")


def name_seeds(spark, sf):
    return M.table(spark, sf, "documents").select("doc_id", D.seed_of(F.concat(F.col("doc_id").cast("string"), F.lit("_a.png")), 7).alias("seed"), D.sequence_of(F.concat(F.lit("background0"), F.col("doc_id") % 5, F.lit("_"), F.lit("page"), F.col("doc_id") % 9, F.lit("_frame_"), F.col("doc_id"), F.lit(".jpg"))).alias("sequence"))


def group_split(spark, sf):
    return D.split_groups(M.table(spark, sf, "documents").select("doc_id", "source"), "source", (0.7, 0.2), 5)


def row_split(spark, sf):
    return D.split_rows(M.table(spark, sf, "documents").select("doc_id"), "doc_id", 0.1, 5)


def evenly_spaced(spark, sf):
    return D.subsample(M.table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 7)


def mixed_sets(spark, sf):
    docs = M.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), "lang")
    return D.mix({"en": docs.where("lang = 'en'").select("name"), "de": docs.where("lang = 'de'").select("name")}, {"en": 3, "de": 1}, 1500, "name", 3)


def label_checks(spark, sf):
    pts = F.array(*(F.array(F.col("event_id") * a % 250.0 - 5, F.col("event_id") * b % 230.0) for a, b in ((3, 5), (7, 11), (13, 17), (19, 23))))
    c = M.table(spark, sf, "events").select(F.when(F.col("event_id") % 10 == 0, F.slice(pts, 1, 3)).when(F.col("event_id") % 17 > 0, pts).alias("c"), "event_id")
    return D.error_histogram(c.select(D.label_errors(F.col("c"), F.lit(240), F.lit(230)).alias("errors")))


def area_routes(spark, sf):
    f = GQ.frames(spark, sf)
    return D.route(f, G.area(F.col("q")) / (200.0 * 220.0), 0.5).groupBy("split").agg(F.count("*").alias("n"))


# ---- sources


def tolerant_words(spark, sf):
    """Words of JSON in five shapes made from events."""
    e = M.table(spark, sf, "events")
    n = lambda a, b: (F.col("event_id") % a + b).cast("string")
    shapes = [
        F.concat(F.lit('[{"text":"a&amp;b","left":'), n(7, 1), F.lit(',"top":1,"right":"40","bottom":9,"confidence":85}]')),
        F.concat(F.lit('{"words":[{"text":"c","bbox":{"l":'), n(7, 1), F.lit(',"t":2,"r":30,"b":8},"confidence":0.5},{"text":"none"}]}')),
        F.concat(F.lit('{"data":[{"text":"d","bbox":['), n(7, 1), F.lit(',2,'), n(20, 1), F.lit(',9],"confidence":true}]}')),
        F.concat(F.lit('{"items":[{"text":"e","x":1,"y":2,"width":'), n(7, 1), F.lit(',"height":4}]}')),
        F.lit("not json"),
    ]
    texts = e.select("event_id", F.element_at(F.array(*shapes), (F.col("event_id") % 5 + 1).cast("int")).alias("text"))
    return S.parse_words(texts).select("event_id", "pos", "w", "left", "top", "right", "bottom", "conf01")


def hocr_words(spark, sf):
    w = M.words(spark, sf).withColumn("s", F.concat(F.lit("<span class='ocrx_word' title='bbox "), F.concat_ws(" ", *(F.col(c).cast("int") for c in ("left", "top", "right", "bottom"))), F.lit("; x_wconf "), F.col("conf").cast("int"), F.lit("'>"), F.replace(F.replace(F.replace("w", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</span>")))
    page = w.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), "\n").alias("text"))
    return S.parse_hocr(page).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("conf").alias("conf"), F.sum("right").alias("right"))


def page_sources(spark, sf):
    """The first source with text of each document."""
    docs = M.table(spark, sf, "documents")
    one = lambda p, f, t: docs.select("doc_id", F.lit(p).alias("priority"), F.lit(f).alias("format"), t.alias("text"))
    c = one(1, "page", F.when(F.col("doc_id") % 3 == 0, F.lit(" reviewed"))).unionByName(one(2, "words", F.when(F.col("doc_id") % 3 == 1, F.lit(" \n ")))).unionByName(one(3, "text", F.col("source")))
    return S.first_text(c, "doc_id")


def conversation_texts(spark, sf):
    return S.joined_pages(M.table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", F.md5("text").alias("md5"))


# ---- stream filters, replayed


def _events(spark, sf):
    return GQ.frames(spark, sf).select("event_id", "user_id", "ts_ms", "value", "q")


def throttled(spark, sf):
    return X.replay(_events(spark, sf).select("event_id", "user_id", "ts_ms", "value"), "user_id", X.throttle(3_600_000), "value double, fresh boolean", ("ts_ms", "event_id"))


def focus_scores(spark, sf):
    return X.replay(_events(spark, sf).select("event_id", "user_id", "ts_ms", "value"), "user_id", X.focus, "score double", ("ts_ms", "event_id"))


def smoothed_corners(spark, sf):
    flat = F.flatten(F.transform("q", lambda p: F.array(p["x"], p["y"])))
    f = _events(spark, sf).select("event_id", "user_id", "ts_ms", flat.alias("corners"), F.lit(200).alias("image_w"), F.lit(220).alias("image_h"))
    r = X.replay(f, "user_id", X.one_euro(), "corners array<double>", ("ts_ms", "event_id"))
    return r.select("user_id", "ts_ms", F.round(F.get("corners", F.lit(0)), 6).alias("x0"), F.round(F.get("corners", F.lit(5)), 6).alias("y2"))


def guidance_events(spark, sf):
    f = GQ.frames(spark, sf).select("event_id", "user_id", "ts_ms", G.framing(F.col("q"), F.lit(200.0), F.lit(220.0)).alias("f"), G.plausibility(F.col("q"), F.lit(200.0), F.lit(220.0)).alias("p"))
    small = F.col("p.convex") & F.col("p.simple") & ~F.col("p.large") & F.col("p.inside")
    f = f.select("event_id", "user_id", "ts_ms", F.col("p.plausible").alias("plausible"), (F.col("f.quality") * 2).alias("quality"), F.col("f.hint").alias("hint"), F.lit(True).alias("has_quad"), small.alias("too_small"), F.lit(0.0).alias("diopters"), F.lit(None).cast("string").alias("event"))
    return X.replay(f, "user_id", X.guidance, "state string, event string", ("ts_ms", "event_id"))


def spoken(spark, sf):
    f = GQ.frames(spark, sf).select("event_id", "user_id", "ts_ms", G.framing(F.col("q"), F.lit(200.0), F.lit(220.0))["hint"].alias("hint"))
    return X.replay(f, "user_id", X.spoken_hints(), "hint string", ("ts_ms", "event_id"))


# ---- policies and review


def ocr_policies(spark, sf):
    w = M.words(spark, sf).groupBy("doc_id").agg(F.floor(F.avg("conf")).cast("int").alias("conf"), F.count("*").alias("words"), F.sum(F.length("w") + 1).alias("length"))
    return w.select("doc_id", P.may_stop(F.col("conf"), F.col("words"), F.col("length")).alias("stop"), P.needs_whole_page(F.col("words"), F.col("conf")).alias("whole"))


def quad_validity(spark, sf):
    w, h, q = F.lit(GQ.W_), F.lit(GQ.H_), F.col("q")
    return GQ.frames(spark, sf).select("event_id", P.is_usable_quad(q, w, h).alias("usable"), P.is_image_quad(q, w, h).alias("image"), F.round(P.axis_angle(q[0]["x"], q[0]["y"], q[1]["x"], q[1]["y"]), 6).alias("angle"))


def lighting(spark, sf):
    """Lighting of documents read as 60 columns of character codes."""
    # texts are dealt by page before they are cut, so that no characters are shuffled
    chars = M.table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "")).alias("k", "c"))
    d = P.half_differences(chars.where("c <> ''").select("page", (F.col("k") % 60).alias("x"), F.floor(F.col("k") / 60).alias("y"), F.ascii("c").alias("v")))
    return d.select("page", F.round("difference", 6).alias("difference"), "uneven")


def unique_file_names(spark, sf):
    d = M.table(spark, sf, "documents").select("doc_id", "lang", F.col("source").alias("base"), F.lit("pdf").alias("ext"))
    return P.unique_names(d, "lang", "base", "ext", "doc_id").select("doc_id", "name")


def words_merged(spark, sf):
    m = V.merge_with_next(M.words(spark, sf), F.col("pos") % 5 == 2)
    return m.groupBy("doc_id").agg(F.count("*").alias("words"), F.count_if("edited").alias("edited"), F.sum("right").alias("right"), F.sum(F.length("w")).alias("chars"), F.round(F.sum("conf"), 3).alias("conf"))


def words_split(spark, sf):
    m = V.split_in_middle(M.words(spark, sf), F.col("pos") % 5 == 2)
    return m.groupBy("doc_id").agg(F.count("*").alias("words"), F.count_if(F.col("part") == 1).alias("cut"), F.round(F.sum(F.col("right") - F.col("left")), 3).alias("width"))


def best_attempts(spark, sf):
    c = M.table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("nth"), "text", (F.col("conv_id") * 31 % (F.col("turn") + 7) / 100).alias("conf"), F.size(F.split("text", " ")).alias("words"))
    return V.best_attempt(c, "conv_id").select("conv_id", "nth", "conf", "words")


def regions_beside(spark, sf):
    r = _regions(spark, sf)
    return V.beside(r.where("type = 'BODY'").select("page", "id", "left", "top", "right", "bottom"), r.where("type = 'HEADER'")).select("page", "id")


def ink_lines(spark, sf):
    return V.line_positions(_profile(spark, sf), F.lit(5))


def ink_end(spark, sf):
    return V.content_end(_profile(spark, sf), F.lit(300), least=3)


def ink_centre(spark, sf):
    return V.centre_valley(_profile(spark, sf))


def line_words(spark, sf):
    return V.lines_as_words(M.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", 600.0, 800.0).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("w")).alias("chars"), *(F.round(F.sum(c), 4).alias(c) for c in ("left", "top", "right", "bottom", "conf")))


QUERIES = {f.__name__: f for f in (
    lines_fixed_anchor, lines_integer_fit, lines_decimal_fit, lines_running_mean, words_to_text, regions_banded, regions_by_column, regions_table, region_zones, zone_kendall,
    ink_profile, ink_smoothed, ink_valleys, ink_columns, ink_detected, map_peaks, map_refined, map_masks, map_boxes, map_iou, map_deviation, ctc_texts, latency_percentiles, eval_report,
    corner_summary, corner_comparison, corner_errors, paired_labels, name_seeds, group_split, row_split, evenly_spaced, mixed_sets, label_checks, area_routes,
    tolerant_words, hocr_words, page_sources, conversation_texts, throttled, focus_scores, smoothed_corners, guidance_events, spoken,
    ocr_policies, quad_validity, lighting, unique_file_names, words_merged, words_split, best_attempts, regions_beside, ink_lines, ink_end, ink_centre, line_words,
)}

CELLS = "cells AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings)"
PLACED = "(SELECT z.page, z.id, row_number() OVER (PARTITION BY z.page ORDER BY z.zone, CASE WHEN z.zone = 2 THEN column_index * side ELSE 0 END, CASE WHEN z.zone % 2 = 1 THEN band ELSE z.t END, CASE WHEN z.zone % 2 = 1 THEN l * side ELSE 0 END, z.t, z.id) - 1 AS reading_order, z.zone FROM zoned z LEFT JOIN bands b ON z.page = b.page AND z.id = b.id)"


def _bands(source, zone):
    """Bands of a table (page, id, l, t, b, r) and of each zone: a region joins while its top is within half the mean height of the band's first."""
    return (f"ranked AS (SELECT page, id, {zone} AS zone, t, floor(floor(avg(b - t) OVER (PARTITION BY page, {zone})) * 0.5) AS tol, row_number() OVER (PARTITION BY page, {zone} ORDER BY t, l, b, r, id) AS n FROM {source})",
        "folded AS (SELECT page, id, zone, n, 0 AS band, t AS anchor FROM ranked WHERE n = 1 UNION ALL SELECT r.page, r.id, r.zone, r.n, CASE WHEN abs(r.t - f.anchor) <= tol THEN f.band ELSE f.band + 1 END, CASE WHEN abs(r.t - f.anchor) <= tol THEN f.anchor ELSE r.t END FROM folded f JOIN ranked r ON r.page = f.page AND r.zone = f.zone AND r.n = f.n + 1)",
        "bands AS (SELECT page, id, band FROM folded)")


ZONED = """edges AS (SELECT *, column_index >= 0 AND type = 'BODY' AS inside, min(CASE WHEN column_index >= 0 AND type = 'BODY' THEN t END) OVER (PARTITION BY page) AS f, max(CASE WHEN column_index >= 0 AND type = 'BODY' THEN b END) OVER (PARTITION BY page) AS e FROM regions),
zoned AS (SELECT *, CASE WHEN type = 'HEADER' THEN 0 WHEN type = 'FOOTER' THEN 4 WHEN inside THEN 2 WHEN coalesce(b <= f OR (t < e AND (t + b) // 2 < f), true) THEN 1 ELSE 3 END AS zone FROM edges)"""
TABLED = "(SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY row_index, col_index * side, id) - 1 AS reading_order FROM regions)"
MARGINS = "sized AS (SELECT page, count(*) AS width FROM profile GROUP BY page), most AS (SELECT p.page, width, max(CASE WHEN x >= floor(width * 0.05) AND x < width - floor(width * 0.05) THEN v END) AS most FROM profile p JOIN sized s ON p.page = s.page GROUP BY p.page, width), "
VALLEYS = MARGINS + """kept AS (SELECT p.page, x, v, width, v < floor(most * 0.35) AS ok FROM profile p JOIN most m ON p.page = m.page WHERE most > 0 AND x >= floor(width * 0.15) AND x < width - floor(width * 0.15)),
islands AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x) - row_number() OVER (PARTITION BY page, ok ORDER BY x) AS g FROM kept),
valleys AS (SELECT page, min(x) AS s, max(x) + 1 AS e, min(v) AS least, max(width) AS width FROM islands WHERE ok GROUP BY page, g HAVING count(*) >= floor(max(width) * 0.015))"""
ORACLE_SQL = {
    "regions_banded": R(REGIONS, *_bands("regions", "0")) + "SELECT r.page, r.id, CAST(row_number() OVER (PARTITION BY r.page ORDER BY band, l * side, t, r.id) - 1 AS INTEGER) AS reading_order FROM regions r JOIN bands b ON r.page = b.page AND r.id = b.id",
    "regions_by_column": R(REGIONS, ZONED, *_bands("zoned", "zone")) + f"SELECT page, id, CAST(zone AS INTEGER) AS zone, CAST(reading_order AS INTEGER) AS reading_order FROM {PLACED} AS x",
    "regions_table": W(REGIONS) + f"SELECT page, id, CAST(reading_order AS INTEGER) AS reading_order FROM {TABLED} AS x",
    "region_zones": W(REGIONS) + "SELECT page, CASE WHEN b <= 120 THEN 'HEADER' WHEN t >= 920 THEN 'FOOTER' ELSE 'BODY' END AS type, count(*) AS n FROM regions GROUP BY 1, 2",
    "zone_kendall": R(REGIONS, ZONED, *_bands("zoned", "zone"), f"a AS {PLACED}", f"b AS {TABLED}", "m AS (SELECT a.page, a.id, a.reading_order AS p, b.reading_order AS q FROM a JOIN b ON a.page = b.page AND a.id = b.id)", "n AS (SELECT page, count(*) * (count(*) - 1) // 2 AS pairs FROM m GROUP BY page)",
        "d AS (SELECT x.page, count(*) AS discordant FROM m x JOIN m y ON x.page = y.page AND x.p < y.p AND x.q > y.q GROUP BY x.page)") + "SELECT n.page, coalesce(discordant, 0) AS discordant, pairs, round(CASE WHEN pairs = 0 THEN 1 ELSE 1 - coalesce(discordant, 0) / pairs END, 6) AS accuracy FROM n LEFT JOIN d ON n.page = d.page",
    "ink_profile": W(PROFILE) + "SELECT * FROM profile",
    "ink_smoothed": W(PROFILE) + "SELECT page, x, CAST(sum(v) OVER w // count(v) OVER w AS INTEGER) AS v FROM profile WINDOW w AS (PARTITION BY page ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "ink_valleys": W(PROFILE, VALLEYS) + 'SELECT page, s AS start, e AS "end", least FROM valleys',
    "ink_columns": W(PROFILE, VALLEYS, """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY 0.3 / (1 + least) + 0.2 * (e - s) / width + 0.5 * (1 - abs((s + e) // 2 - width // 2) / width) DESC, s) AS r FROM valleys) AS a WHERE r = 1)""",
        "cuts AS (SELECT page, 0 AS x FROM sized UNION ALL SELECT page, (s + e) // 2 FROM best WHERE (s + e) // 2 > 0 UNION ALL SELECT page, width FROM sized)", "parts AS (SELECT page, x AS l, lead(x) OVER (PARTITION BY page ORDER BY x) AS r, count(*) OVER (PARTITION BY page) - 1 AS n FROM cuts)",
        "wide AS (SELECT p.page, l, r, width FROM parts p JOIN sized s ON p.page = s.page WHERE r IS NOT NULL AND (n = 1 OR r - l >= floor(width * 0.15)))", "every AS (SELECT page, l, r FROM wide UNION ALL SELECT page, 0, width FROM sized WHERE page NOT IN (SELECT page FROM wide))")
    + 'SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY l) - 1 AS INTEGER) AS column_index, CAST(l AS INTEGER) AS "left", CAST(r AS INTEGER) AS "right" FROM every',
    "map_peaks": W(CELLS, "r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM cells)", "m AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS sd, max(v) AS top FROM cells GROUP BY vec_id)") + "SELECT r.vec_id, CAST(i AS INTEGER) AS k, i % 8 + 0.5 AS x, i // 8 + 0.5 AS y, sd > 1e-6 AND (top - m) / sd < 5 AS low FROM r JOIN m ON r.vec_id = m.vec_id WHERE k = 1",
    "map_masks": W(CELLS) + "SELECT vec_id, CAST(count(*) FILTER (WHERE v > 0) AS INTEGER) AS area, round(avg(1 / (1 + exp(-v))), 6) AS mean FROM cells GROUP BY vec_id",
    "map_iou": W(CELLS) + "SELECT a.vec_id, round(CASE WHEN count(*) FILTER (WHERE a.v > 0 OR b.v > 0) = 0 THEN 1 ELSE count(*) FILTER (WHERE a.v > 0 AND b.v > 0) / count(*) FILTER (WHERE a.v > 0 OR b.v > 0) END, 6) AS iou FROM cells a JOIN cells b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY a.vec_id",
    "latency_percentiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY event_type",
    "corner_errors": W(GQ.FRAMES, "m AS (SELECT 'a' AS model, event_id AS name, event_id % 7 AS d, * FROM f UNION ALL SELECT 'b', event_id, event_id % 5, * FROM f)", "p AS (SELECT model, name, d, " + ", ".join(f"x{i} + d AS x{i}, y{i} - d / 2 AS y{i}" for i in range(4)) + " FROM m)")
    + f"""SELECT name, model, CASE WHEN least({', '.join(GQ.NAMES)}) < 0 OR greatest({', '.join(GQ.NAMES[::2])}) > 219 OR greatest({', '.join(GQ.NAMES[1::2])}) > 239 THEN 'oob' WHEN {GQ.CROSSING} THEN 'self_intersecting' WHEN NOT ({GQ._convex(1e-6)}) THEN 'non_convex'
        WHEN abs({GQ.AREA}) < 0.05 * 220 * 240 THEN 'degenerate_area' WHEN {GQ.SHORT} < 5 OR abs({GQ.AREA}) < 100 THEN 'degenerate' END AS reason, round(sqrt(d * d + d / 2 * (d / 2)), 6) AS mae FROM p""",
    "paired_labels": "SELECT d.doc_id, source, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "name_seeds": "SELECT doc_id, CAST(concat('0x', substr(sha256(concat('7_', doc_id, '_a.png')), 1, 8)) AS BIGINT) AS seed, concat('background0', doc_id % 5, '_page', doc_id % 9) AS sequence FROM documents",
    "evenly_spaced": "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id FROM r WHERE n <= 7 OR r IN (0, n // 7, 2 * n // 7, 3 * n // 7, 4 * n // 7, 5 * n // 7, 6 * n // 7)",
    "area_routes": W(GQ.FRAMES) + f"SELECT CASE WHEN abs({GQ.AREA}) / (200.0 * 220.0) < 0.5 THEN 'HARD' ELSE 'CORE' END AS split, count(*) AS n FROM f GROUP BY 1",
    "hocr_words": W(M.WORDS) + 'SELECT doc_id, count(*) AS n, CAST(sum(CAST(conf AS INTEGER)) AS BIGINT) AS conf, sum("right") AS "right" FROM words GROUP BY doc_id',
    "page_sources": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'page' ELSE 'text' END AS format, CASE WHEN doc_id % 3 = 0 THEN 'reviewed' ELSE source END AS text FROM documents",
    "ocr_policies": W(M.WORDS, "s AS (SELECT doc_id, floor(avg(conf)) AS conf, count(*) AS words, sum(length(w) + 1) AS length FROM words GROUP BY doc_id)") + "SELECT doc_id, conf >= 70 AND words >= 30 AND length >= 200 AS stop, words < 20 OR conf < 50 AS whole FROM s",
    "quad_validity": W(GQ.FRAMES) + f"""SELECT event_id, least({', '.join(f'x{i}' for i in range(4))}) >= -0.25 * {GQ.W_} AND greatest({', '.join(f'x{i}' for i in range(4))}) <= 1.25 * {GQ.W_} AND least({', '.join(f'y{i}' for i in range(4))}) >= -0.25 * {GQ.H_}
        AND greatest({', '.join(f'y{i}' for i in range(4))}) <= 1.25 * {GQ.H_} AND least({GQ.TURNS}) > 0 AS usable, least({', '.join(GQ.NAMES)}) >= 0 AND greatest({', '.join(f'x{i}' for i in range(4))}) <= {GQ.W_} AND greatest({', '.join(f'y{i}' for i in range(4))}) <= {GQ.H_}
        AND abs({GQ.AREA}) >= 0.02 * {GQ.W_ * GQ.H_} AND (least({GQ.TURNS}) > 0 OR greatest({GQ.TURNS}) < 0) AS image,
        round(least(abs(degrees(atan2(y1 - y0, x1 - x0))), abs(abs(degrees(atan2(y1 - y0, x1 - x0))) - 90), abs(abs(degrees(atan2(y1 - y0, x1 - x0))) - 180)), 6) AS angle FROM f""",
    "unique_file_names": "SELECT doc_id, concat(source, CASE WHEN r > 1 THEN concat('_', r) ELSE '' END, '.pdf') AS name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents) AS x",
    "words_merged": W(M.WORDS, """n AS (SELECT *, pos % 5 = 2 AND lead(w) OVER o IS NOT NULL AS m, lag(pos) OVER o % 5 = 2 AS gone, lead(w) OVER o AS w2, lead("right") OVER o AS r2, lead("left") OVER o AS l2, lead(top) OVER o AS t2, lead(bottom) OVER o AS b2, lead(conf) OVER o AS c2
        FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos))""", """a AS (SELECT *, (greatest("right", r2) - least("left", l2)) * (greatest(bottom, b2) - least(top, t2)) AS a1, (r2 - l2) * (b2 - t2) AS a2 FROM n WHERE NOT coalesce(gone, false))""")
    + """SELECT doc_id, count(*) AS words, count(*) FILTER (WHERE m) AS edited, sum(CASE WHEN m THEN greatest("right", r2) ELSE "right" END) AS "right", CAST(sum(CASE WHEN m THEN length(w) + 1 + length(w2) ELSE length(w) END) AS BIGINT) AS chars,
        round(sum(CASE WHEN m THEN (conf * a1 + c2 * a2) / greatest(1, a1 + a2) ELSE conf END), 3) AS conf FROM a GROUP BY doc_id""",
    "regions_beside": W(REGIONS) + "SELECT page, id FROM regions x WHERE type = 'BODY' AND NOT EXISTS (SELECT 1 FROM regions y WHERE y.type = 'HEADER' AND x.page = y.page AND x.l < y.r AND y.l < x.r AND x.t < y.b AND y.t < x.b)",
    "ink_lines": W(PROFILE, "m AS (SELECT page, x, v > 5 AS ok, row_number() OVER (PARTITION BY page ORDER BY x) - row_number() OVER (PARTITION BY page, v > 5 ORDER BY x) AS g FROM profile)", "mids AS (SELECT page, (min(x) + max(x) + 1) // 2 AS x FROM m WHERE ok GROUP BY page, g)",
        "size AS (SELECT p.page, n, lo, hi FROM (SELECT page, max(x) + 1 AS n FROM profile GROUP BY page) p LEFT JOIN (SELECT page, min(x) AS lo, max(x) AS hi FROM mids GROUP BY page) a ON p.page = a.page)")
    + "SELECT page, CAST(x AS INTEGER) AS x FROM mids UNION ALL SELECT page, 0 FROM size WHERE lo IS NULL OR lo > 5 UNION ALL SELECT page, n FROM size WHERE hi IS NULL OR hi < n - 5",
    "ink_end": W(PROFILE, "m AS (SELECT page, x, v < 3 AS ok, row_number() OVER (PARTITION BY page ORDER BY x) - row_number() OVER (PARTITION BY page, v < 3 ORDER BY x) AS g, count(*) OVER (PARTITION BY page) AS n FROM profile)", "e AS (SELECT page, max(e) AS e FROM (SELECT page, max(x) + 1 AS e FROM m WHERE ok GROUP BY page, g HAVING count(*) >= greatest(3, floor(max(n) * 0.02))) AS a GROUP BY page)")
    + "SELECT p.page, CAST(coalesce(e, n) AS INTEGER) AS x FROM (SELECT page, count(*) AS n FROM profile GROUP BY page) p LEFT JOIN e ON p.page = e.page",
    "ink_centre": W(PROFILE, "s AS (SELECT *, count(*) OVER (PARTITION BY page) AS n, floor(count(*) OVER (PARTITION BY page) * 0.05) AS m FROM profile)", "l AS (SELECT page, arg_min(x, v * 1000 + x) AS lx, min(v) AS lv FROM s WHERE x >= n // 3 AND x < 2 * n // 3 GROUP BY page)",
        "h AS (SELECT s.page, avg(CASE WHEN x < lx - n * 0.05 THEN v END) AS a, avg(CASE WHEN x >= lx + floor(n * 0.05) THEN v END) AS z, max(n) AS n, max(lx) AS lx, max(lv) AS lv FROM s JOIN l ON s.page = l.page WHERE x >= m AND x < n - m GROUP BY s.page)",
        "c AS (SELECT s.page, x, lx, h.n, x = lx OR (v < least(a, z) * 0.6 AND x >= m AND x < s.n - m) AS ok FROM s JOIN h ON s.page = h.page WHERE a > 0 AND z > 0 AND lv < least(a, z) * 0.5)",
        "g AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x) - row_number() OVER (PARTITION BY page, ok ORDER BY x) AS g FROM c)")
    + 'SELECT page, CAST(min(x) AS INTEGER) AS start, CAST(max(x) AS INTEGER) AS "end" FROM g WHERE ok GROUP BY page, g HAVING bool_or(x = lx) AND max(x) - min(x) >= floor(max(n) * 0.015)',
    "line_words": """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[\r\n]+'), lambda x: regexp_replace(x, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')), lambda x: x <> '') AS ws FROM documents),
        r AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos, greatest(24, 640 / len(ws)) AS h FROM l WHERE len(ws) > 0), t AS (SELECT *, least(799, 80 + pos * h) AS top FROM r)
        SELECT doc_id, count(*) AS n, CAST(sum(length(w)) AS BIGINT) AS chars, round(sum(48.0::DOUBLE), 4) AS "left", round(sum(top::DOUBLE), 4) AS top, round(sum(552.0::DOUBLE), 4) AS "right", round(sum(least(800, top + greatest(16, h * 0.7))::DOUBLE), 4) AS bottom, 0.0::DOUBLE AS conf FROM t GROUP BY doc_id""",
    "best_attempts": """WITH RECURSIVE a AS (SELECT conv_id, turn AS nth, conv_id * 31 % (turn + 7) / 100 AS conf, len(string_split(text, ' ')) AS words, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r FROM conversations),
        f AS (SELECT conv_id, r, nth, conf, words, n FROM a WHERE r = 1 UNION ALL SELECT a.conv_id, a.r, CASE WHEN better THEN a.nth ELSE b.nth END, CASE WHEN better THEN a.conf ELSE b.conf END, CASE WHEN better THEN a.words ELSE b.words END, CASE WHEN better THEN a.n ELSE b.n END
            FROM (SELECT f.*, CASE WHEN x.conf > f.conf + 0.01 THEN true WHEN abs(x.conf - f.conf) > 0.01 THEN false WHEN x.words <> f.words THEN x.words > f.words ELSE x.n > f.n END AS better FROM f JOIN a x ON x.conv_id = f.conv_id AND x.r = f.r + 1) b JOIN a ON a.conv_id = b.conv_id AND a.r = b.r + 1)
        SELECT conv_id, nth, conf, CAST(words AS INTEGER) AS words FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY r DESC) AS last FROM f) AS x WHERE last = 1""",
    "map_refined": W(CELLS, "k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS n FROM cells) AS a WHERE n = 1)",
        "d AS (SELECT k.vec_id, k.i % 8 AS px, k.i // 8 AS py, k.v AS c, x.i % 8 AS x, x.i // 8 AS y, x.v AS v FROM k JOIN cells x ON x.vec_id = k.vec_id)",
        "g AS (SELECT vec_id, max(px) AS px, max(py) AS py, max(c) AS c, sum(exp(v - c) * (x + 0.5)) FILTER (WHERE abs(x - px) <= 1 AND abs(y - py) <= 1) / sum(exp(v - c)) FILTER (WHERE abs(x - px) <= 1 AND abs(y - py) <= 1) AS rx, sum(exp(v - c) * (y + 0.5)) FILTER (WHERE abs(x - px) <= 1 AND abs(y - py) <= 1) / sum(exp(v - c)) FILTER (WHERE abs(x - px) <= 1 AND abs(y - py) <= 1) AS ry, "
        "sum(exp(v - c) * (x + 0.5)) FILTER (WHERE abs(x - px) <= 2 AND abs(y - py) <= 2) / sum(exp(v - c)) FILTER (WHERE abs(x - px) <= 2 AND abs(y - py) <= 2) AS sx, sum(exp(v - c) * (y + 0.5)) FILTER (WHERE abs(x - px) <= 2 AND abs(y - py) <= 2) / sum(exp(v - c)) FILTER (WHERE abs(x - px) <= 2 AND abs(y - py) <= 2) AS sy, "
        "max(v) FILTER (WHERE x = px - 1 AND y = py) AS l, max(v) FILTER (WHERE x = px + 1 AND y = py) AS r, max(v) FILTER (WHERE x = px AND y = py - 1) AS t, max(v) FILTER (WHERE x = px AND y = py + 1) AS b FROM d GROUP BY vec_id)",
        "o AS (SELECT *, CASE WHEN l - 2 * c + r < -1e-12 THEN greatest(-0.5, least(0.5, 0.5 * (l - r) / (l - 2 * c + r))) END AS dx, CASE WHEN t - 2 * c + b < -1e-12 THEN greatest(-0.5, least(0.5, 0.5 * (t - b) / (t - 2 * c + b))) END AS dy FROM g)")
    + "SELECT vec_id, round(rx, 6) AS rx, round(ry, 6) AS ry, round(CASE WHEN dx IS NULL AND dy IS NULL THEN sx ELSE px + 0.5 + coalesce(dx, 0) END, 6) AS qx, round(CASE WHEN dx IS NULL AND dy IS NULL THEN sy ELSE py + 0.5 + coalesce(dy, 0) END, 6) AS qy FROM o",
    "map_boxes": W(CELLS, "p AS (SELECT vec_id, i % 8 + 0.5 AS x, i // 8 + 0.5 AS y, 1 / (1 + exp(-v)) AS w FROM cells WHERE 1 / (1 + exp(-v)) > 0.5)", "m AS (SELECT vec_id, count(*) AS n, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy, sum(w * x * x) / sum(w) AS xx, sum(w * y * y) / sum(w) AS yy, sum(w * x * y) / sum(w) AS xy FROM p GROUP BY vec_id)",
        "a AS (SELECT *, 0.5 * atan2(2 * (xy - cx * cy), (xx - cx * cx) - (yy - cy * cy)) AS t FROM m)", "e AS (SELECT p.vec_id, max(n) AS n, max((x - cx) * cos(t) + (y - cy) * sin(t)) - min((x - cx) * cos(t) + (y - cy) * sin(t)) AS u, max((y - cy) * cos(t) - (x - cx) * sin(t)) - min((y - cy) * cos(t) - (x - cx) * sin(t)) AS v FROM p JOIN a ON p.vec_id = a.vec_id GROUP BY p.vec_id)")
    + "SELECT s.vec_id, CASE WHEN n >= 3 THEN round(u * v, 4) END AS area, CASE WHEN n >= 3 THEN round(2 * (u + v), 4) END AS perimeter FROM (SELECT DISTINCT vec_id FROM cells) s LEFT JOIN e ON s.vec_id = e.vec_id",
    "ctc_texts": W(CELLS, "b AS (SELECT vec_id, i // 8 AS t, arg_max(i % 8, v * 1.0 - (i % 8) * 1e-15) AS k, max(v) AS p FROM cells GROUP BY vec_id, i // 8)", "f AS (SELECT *, lag(k) OVER (PARTITION BY vec_id ORDER BY t) AS before FROM b)",
        "c AS (SELECT vec_id, t, p, list_extract(['', 'a', 'b', ' ', 'c', 'd', 'e', 'f'], CAST(k + 1 AS BIGINT)) AS ch FROM f WHERE k <> 0 AND (before IS NULL OR before <> k))", "s AS (SELECT vec_id, string_agg(ch, '' ORDER BY t) AS text, avg(p) AS conf FROM c GROUP BY vec_id)")
    + "SELECT x.vec_id, coalesce(text, '') AS text, round(coalesce(conf, 0), 6) AS conf, coalesce(array_to_string(list_filter(string_split(text, ' '), lambda z: z <> ''), '|'), '') AS tokens FROM (SELECT DISTINCT vec_id FROM cells) x LEFT JOIN s ON x.vec_id = s.vec_id",
    "lighting": """WITH p AS (SELECT doc_id AS page, k % 60 AS x, k // 60 AS y, unicode(c) AS v FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS k FROM documents) AS a WHERE c <> ''),
        s AS (SELECT *, max(x) OVER (PARTITION BY page) + 1 AS w, max(y) OVER (PARTITION BY page) + 1 AS h FROM p),
        d AS (SELECT page, greatest(abs(avg(v) FILTER (WHERE y < h // 2) - avg(v) FILTER (WHERE NOT y < h // 2)), abs(avg(v) FILTER (WHERE x < w // 2) - avg(v) FILTER (WHERE NOT x < w // 2))) AS d FROM s GROUP BY page)
        SELECT page, round(d, 6) AS difference, d > 28 AS uneven FROM d""",
    "conversation_texts": "SELECT conv_id, md5(string_agg(text, concat(chr(10), chr(10)) ORDER BY turn)) AS md5 FROM conversations GROUP BY conv_id",
}
