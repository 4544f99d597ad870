"""Layout of page images given as row-major masks or maps: components, header, footer, columns, footers below columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.quads import let

# names and no modules, as what runs on executors is pickled by value
from vellum.operators.assembly import DENSE, FOOTER_SHARE, HEADER_SHARE, LEAST_BAND, THIN
from vellum.operators.layout import detect_columns, runs
from vellum.operators.review import content_end
from vellum.sources.tables import stored

# Fixed values -------------------------------------------------------------------------------------------------
INK, BOX, UNCLIP, LEAST_AREA, LEAST_SIDE, LONGEST, LEAST_VARIANCE = 0.3, 0.5, 1.6, 16, 3, 40.0, 0.05
WIDE_SCAN, WIDE, GAP_SHARE, GAP_INK, WIDE_FOOTER = 0.20, 0.6, 0.02, 0.05, (0.01, 0.15)
LOW_SCAN, LEFT_SHARE, LOW_WIDTH, LOW_ROWS, LOW_FOOTER = 0.10, 0.10, 0.3, 3, (0.01, 0.12)
REST_FOOTER, SMALLEST = (0.03, 0.15), 100
# ----------------------------------------------------------------------------------------------------------------


def labelled(ink: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Component of each cell of a mask, by its first cell in reading order; -1 where there is no ink."""
    h, w = ink.shape
    out = np.full(h * w, -1)
    edge = np.diff(np.pad(ink.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, start), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    # runs of ink in reading order; those of the row above that a run touches are neighbours in it
    wide, slant, above = w + 2, int(diagonal), (row - 1) * (w + 2)
    first = np.searchsorted(row * wide + end, above + start - slant, "right")
    n = np.maximum(0, np.searchsorted(row * wide + start, above + end + slant) - first)
    below = np.repeat(np.arange(len(row)), n)
    over = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    label = np.arange(len(row))
    while True:
        a, b = label[over], label[below]
        if np.array_equal(a, b):
            break
        least = np.minimum(a, b)
        for at in (a, b):
            np.minimum.at(label, at, least)
        # each run takes the label of the run that its label names
        while not np.array_equal(named := label[label], label):
            label = named
    out[ink.ravel()] = np.repeat((row * w + start)[label], end - start)
    return out.reshape(h, w)


def cells_of(label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of each component's cells, in the order of their first cells."""
    flat = label.ravel()
    order = np.argsort(flat, kind="stable")
    order = order[np.searchsorted(flat[order], 0) :]
    for part in np.split(order, np.flatnonzero(np.diff(flat[order])) + 1) if len(order) else ():
        yield part // label.shape[1], part % label.shape[1]


def boxes_of(prob: np.ndarray) -> list[dict]:
    """Text boxes of a probability map: components above a threshold that are sure, large and (if very long) uneven enough, grown by their size."""
    out = []
    for y, x in cells_of(labelled(prob >= INK)):
        left, right, top, bottom = int(x.min()), int(x.max()) + 1, int(y.min()), int(y.max()) + 1
        w, h, score = right - left, bottom - top, float(prob[y, x].mean())
        if score < BOX or len(x) < LEAST_AREA or min(w, h) < LEAST_SIDE:
            continue
        rows = np.bincount(y - top, minlength=h)
        # a long even bar is a rule, not text
        if w / h > LONGEST and rows.var() / rows.mean() ** 2 < LEAST_VARIANCE:
            continue
        grow = w * h * (UNCLIP - 1) / (2 * (w + h))
        out.append({"left": left - grow, "top": top - grow, "right": right + grow, "bottom": bottom + grow, "score": score})
    return out


def text_boxes(maps: DataFrame, key: str, values: str, width: str) -> DataFrame:
    """key, nth, left, top, right, bottom, score of the text boxes of row-major probability maps; a map is bounded."""

    @F.pandas_udf("array<struct<left: double, top: double, right: double, bottom: double, score: double>>")
    def found(flat: pd.Series, widths: pd.Series) -> pd.Series:
        return pd.Series([boxes_of(np.asarray(a, float).reshape(-1, int(w))) if a is not None and len(a) else [] for a, w in zip(flat, widths, strict=True)])

    return maps.select(key, F.posexplode(found(F.col(values).cast("array<double>"), F.col(width))).alias("nth", "b")).select(key, "nth", "b.*")


def median_height(maps: DataFrame, key: str, values: str, width: str) -> DataFrame:
    """key, height: the upper median height of a mask's components (diagonals count) that may be letters; -1 for none."""

    @F.pandas_udf("int")
    def found(flat: pd.Series, widths: pd.Series) -> pd.Series:
        def one(a, w: int) -> int:
            ink = np.asarray(a).reshape(-1, w) != 0
            rows, cols = ink.shape
            least = max(12, rows * cols // 20_000)
            most = max(least + 1, rows * cols // 5)
            heights = []
            for y, x in cells_of(labelled(ink, True)):
                h, wide = int(np.ptp(y)) + 1, int(np.ptp(x)) + 1
                if least <= len(y) <= most and 3 <= h <= rows * 0.6 and 2 <= wide <= cols * 0.6:
                    heights.append(h)
            return sorted(heights)[len(heights) // 2] if heights else -1

        return pd.Series([one(a, int(w)) for a, w in zip(flat, widths, strict=True)])

    return maps.select(key, found(F.col(values), F.col(width)).alias("height"))


def ink_rows(pages_: DataFrame, key: str, values: str, width: str) -> DataFrame:
    """key, w, h, y, xs: every row of row-major masks with the places that hold ink, from the left; null and empty masks have no rows."""

    def cut(a: Column) -> Column:
        h = F.floor(F.size(a) / F.col("w")).cast("int")
        places = lambda y: F.array_compact(F.transform(F.slice(a, y * F.col("w") + 1, F.col("w")), lambda v, x: F.when(v != 0, x)))
        return F.when((F.col("w") > 0) & (F.size(a) >= F.col("w")), F.transform(F.sequence(F.lit(0), h - 1), lambda y: F.struct(h.alias("h"), y.alias("y"), places(y).alias("xs"))))

    # a mask is read once: its rows leave it as places of ink, never as copies of cells
    rows = pages_.withColumn("w", F.col(width).cast("int")).select(key, "w", F.explode(let(F.col(values), cut)).alias("row"))
    return rows.select(key, "w", "row.h", "row.y", "row.xs")


def bodies(rows: DataFrame, key: str) -> DataFrame:
    """key, w, h, header, footer, top, bottom of ink_rows(): where a header ends and a footer begins (null for none), and what lies between."""
    end, begin = (F.floor(F.col("h") * HEADER_SHARE).cast("int"), (F.col("h") - F.floor(F.col("h") * FOOTER_SHARE)).cast("int"))
    n = F.size("xs")
    band = lambda inside: F.coalesce(F.sum(F.when(inside, n)), F.lit(0))
    found = rows.groupBy(key, "w", "h").agg(band(F.col("y") < end).alias("above"), band(F.col("y") >= begin).alias("below"))
    some = lambda ink, high: (high >= LEAST_BAND) & F.try_divide(ink, F.col("w") * high).between(THIN, DENSE) & ~F.try_divide(ink, F.col("w") * high).isin(THIN, DENSE)
    found = found.withColumn("header", F.when(some(F.col("above"), end), end)).withColumn("footer", F.when(some(F.col("below"), F.col("h") - begin), begin))
    return found.select(key, "w", "h", "header", "footer", F.coalesce("header", F.lit(0)).alias("top"), F.coalesce("footer", "h").alias("bottom"))


def body_columns(rows: DataFrame, sheets: DataFrame, key: str) -> DataFrame:
    """key, column_index, left, right: the columns of the bodies() of pages; one where the body has less than 100 pixels a side."""
    body = sheets.where("bottom > top")
    large = F.least(F.col("bottom") - F.col("top"), F.col("w")) >= SMALLEST
    # rows of ink are stored in a fraction of their size, by which Spark would broadcast them: they are merged
    ink = rows.hint("merge").join(body.where(large).select(key, "top", "bottom"), key).where("y >= top AND y < bottom")
    counts = ink.select(key, F.explode("xs").alias("x")).groupBy(key, "x").agg(F.count("*").cast("int").alias("v"))
    places = body.where(large).select(key, F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    profile = stored(places.join(counts.hint("merge"), [key, "x"], "left").select(key, "x", F.coalesce("v", F.lit(0)).alias("v")), "ink-columns")
    one = body.where(~large).select(key, F.lit(0).alias("column_index"), F.lit(0).alias("left"), F.col("w").alias("right"))
    return detect_columns(profile, key).unionByName(one)


def footers_below(rows: DataFrame, sheets: DataFrame, columns_: DataFrame, key: str) -> DataFrame:
    """key, cut: the top of a footer below the columns of pages that have several and no other footer.

    Lines as wide as the page or across the gap between its columns come first, then lines from the left margin across that gap,
    then what follows the columns' ends; the first that is as high as its kind of footer may be and neither empty nor solid counts.
    """
    met = columns_.join(sheets.where("footer IS NULL").select(key, "w"), key)
    half = F.floor(F.col("w") / 2)
    gap = met.groupBy(key).agg(
        F.count("*").alias("parts"),
        F.coalesce(F.max(F.when(F.col("left") < half, F.col("right"))), F.lit(0)).alias("gap_from"),
        F.coalesce(F.min(F.when(F.col("right") > half, F.col("left"))), F.max("w")).alias("gap_to"),
    )
    several = sheets.join(gap.where("parts > 1"), key).select(key, "top", "bottom", "gap_from", "gap_to")
    inside = rows.hint("merge").join(several, key).where("y >= top AND y < bottom")
    n, room = F.size("xs"), F.col("gap_to") - F.col("gap_from")
    first, last = F.get("xs", F.lit(0)), F.get("xs", n - 1)
    crossed = F.size(F.filter("xs", lambda x: (x >= F.col("gap_from")) & (x < F.col("gap_to"))))
    wide = (n > 0) & ((last - first > F.col("w") * WIDE) | (room > F.col("w") * GAP_SHARE) & (crossed > room * GAP_INK))
    low = (n > 0) & (first < F.floor(F.col("w") * LEFT_SHARE)) & (last > F.col("gap_from")) & (last - first > F.col("w") * LOW_WIDTH)
    lines = inside.where(F.col("y") >= F.col("bottom") - F.floor(F.col("h") * max(WIDE_SCAN, LOW_SCAN)))
    lines = lines.select(key, "h", "bottom", F.col("y").alias("x"), n.alias("v"), F.when(n > 0, wide).alias("wide"), F.when(n > 0, low).alias("low"))

    def lowest(kind: str, scan: float, least: int) -> DataFrame:
        found = runs(lines.where(F.col("x") >= F.col("bottom") - F.floor(F.col("h") * scan)), F.col(kind), key)
        return found.where(F.col("n") >= least).groupBy(key).agg(F.max("start").alias(f"{kind}_at"))

    part = inside.hint("merge").join(columns_, key).select(
        F.struct(key, "column_index").alias("part"),
        (F.col("y") - F.col("top")).alias("x"),
        F.size(F.filter("xs", lambda x: (x >= F.col("left")) & (x < F.col("right")))).alias("v"),
        (F.col("right") - F.col("left")).alias("width"),
    )
    ends = content_end(part, F.col("width"), "part").groupBy(F.col(f"part.{key}").alias(key)).agg(F.min("x").alias("rest"))
    at = several.join(lowest("wide", WIDE_SCAN, 1), key, "left").join(lowest("low", LOW_SCAN, LOW_ROWS), key, "left").join(ends, key, "left")
    at = at.select(key, "bottom", "wide_at", "low_at", (F.col("top") + F.col("rest")).alias("rest_at"))
    kinds = {"wide_at": WIDE_FOOTER, "low_at": LOW_FOOTER, "rest_at": REST_FOOTER}
    weighed = rows.hint("merge").join(at, key).where("y < bottom").groupBy(key, "w", "h", "bottom", *kinds).agg(*(F.coalesce(F.sum(F.when(F.col("y") >= F.col(k), n)), F.lit(0)).alias(f"{k}_ink") for k in kinds))

    def fits(k: str, least: float, most: float) -> Column:
        high = F.col("bottom") - F.col(k)
        density = F.try_divide(F.col(f"{k}_ink"), F.col("w") * high)
        sized = (F.col(k) > 0) & (high > 0) & (high >= F.floor(F.col("h") * least)) & (high <= F.floor(F.col("h") * most))
        return F.when(sized & (density > THIN) & (density < DENSE), F.col(k))

    return weighed.select(key, F.coalesce(*(fits(k, *sizes) for k, sizes in kinds.items())).alias("cut")).where("cut IS NOT NULL")


def analyze(pages_: DataFrame, key: str, values: str, width: str) -> DataFrame:
    """key, type, column_index, left, top, right, bottom: the regions of pages given as row-major masks, key being unique.

    Columns are looked for between header and footer. Where there are several and no footer was found, one is looked for below
    them, and the columns end at it. The rows' ink and what is found of each page are written to the shared folder, as several steps read them.
    """
    rows = stored(ink_rows(pages_, key, values, width), "ink-rows")
    sheets = stored(bodies(rows, key), "bodies")
    columns_ = stored(body_columns(rows, sheets, key), "body-columns")
    ends = stored(sheets.join(footers_below(rows, sheets, columns_, key), key, "left"), "page-ends")
    region = lambda df, kind, nth, left, top, right, bottom: df.select(key, F.lit(kind).alias("type"), nth.alias("column_index"), left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))
    none, zero, w = F.lit(-1), F.lit(0), F.col("w")
    header = region(ends.where("header IS NOT NULL"), "HEADER", none, zero, zero, w, F.col("header"))
    footer = region(ends.where("footer IS NOT NULL"), "FOOTER", none, zero, F.col("footer"), w, F.col("h"))
    found = region(ends.where("cut IS NOT NULL"), "FOOTER", none, zero, F.col("cut"), w, F.col("bottom"))
    body = region(ends.join(columns_, key), "COLUMN", F.col("column_index"), F.col("left"), F.col("top"), F.col("right"), F.coalesce("cut", "bottom"))
    return header.unionByName(footer).unionByName(found).unionByName(body)


def column_counts(regions: DataFrame, key: str = "page") -> DataFrame:
    """key, columns (1 at least), several."""
    n = F.greatest(F.lit(1), F.count_if(F.col("type") == "COLUMN"))
    return regions.groupBy(key).agg(n.alias("columns")).withColumn("several", F.col("columns") > 1)
