"""Figures and ruled tables of page masks: outer boxes of components, and rules on boxes, profiles and cells as Columns.

A page's mask (row-major, any non-zero is ink) is bounded and looked at once in an Arrow batch, which gives boxes and ink profiles;
what is a figure or a table, its lines and its cells are expressions and joins on these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.quads import let
from vellum.operators.pages import labelled
from vellum.sources.tables import stored

# Fixed values -------------------------------------------------------------------------------------------------
LEAST_FIGURE, MOST_FIGURE, NARROWEST, WIDEST, SOLID = 0.02, 0.5, 0.2, 5.0, 0.5
LEAST_TABLE, LEAST_LINES, LINE_PART, LEAST_OPENING, LINE_SHARE, EDGE, REGULAR = 0.01, 2, 30, 10, 10, 5, 0.8
# ----------------------------------------------------------------------------------------------------------------

CELL = 64


def outer_boxes(ink: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """left, top, right, bottom (ends exclusive) of the components, diagonals counted, that no other component encloses; by their first cells in reading order."""
    padded = np.pad(ink, 1)
    # what can be reached from beyond the page without crossing ink
    ground = labelled(~padded)
    outside = ground == ground[0, 0]
    beside = np.zeros_like(padded)
    beside[1:] |= outside[:-1]
    beside[:-1] |= outside[1:]
    beside[:, 1:] |= outside[:, :-1]
    beside[:, :-1] |= outside[:, 1:]
    label = labelled(padded, True)
    free = np.unique(label[padded & beside])
    y, x = np.nonzero(padded)
    own = np.searchsorted(free, label[y, x])
    met = (own < len(free)) & (free[np.minimum(own, len(free) - 1)] == label[y, x]) if len(free) else np.zeros(len(y), bool)
    y, x, own = y[met] - 1, x[met] - 1, own[met]
    left, top = np.full(len(free), ink.shape[1]), np.full(len(free), ink.shape[0])
    right, bottom = np.zeros(len(free), int), np.zeros(len(free), int)
    for at, put, v in ((left, np.minimum, x), (top, np.minimum, y), (right, np.maximum, x + 1), (bottom, np.maximum, y + 1)):
        put.at(at, own, v)
    yield from zip(left.tolist(), top.tolist(), right.tolist(), bottom.tolist(), strict=True)


def opened(ink: np.ndarray, n: int) -> np.ndarray:
    """ink along rows without runs shorter than n, as an opening by a segment whose anchor is place n // 2: what lies beyond the page wears nothing off and adds nothing."""
    w, a = ink.shape[1], n // 2
    low, high = np.clip(np.arange(w) - a, 0, w), np.clip(np.arange(w) - a + n, 0, w)
    count = lambda m: np.concatenate([np.zeros((len(m), 1), int), np.cumsum(m, axis=1)], axis=1)
    sums = count(ink)
    eroded = sums[:, high] - sums[:, low] == high - low
    sums = count(eroded)
    return sums[:, high] > sums[:, low]


def components(pages: DataFrame, key: str = "page", values: str = "mask", width: str = "w") -> DataFrame:
    """key, nth, left, top, right, bottom, density (share of ink within the box), page_width, page_height of the outer components of pages."""

    @F.pandas_udf("array<struct<left: int, top: int, right: int, bottom: int, density: double, page_width: int, page_height: int>>")
    def found(masks: pd.Series, widths: pd.Series) -> pd.Series:
        def one(a, w: int) -> list[dict]:
            ink = np.asarray(a).reshape(-1, w) != 0
            names = ("left", "top", "right", "bottom", "density", "page_width", "page_height")
            return [dict(zip(names, (x0, y0, x1, y1, float(ink[y0:y1, x0:x1].mean()), w, len(ink)), strict=True)) for x0, y0, x1, y1 in outer_boxes(ink)]

        return pd.Series([one(a, int(w)) if a is not None and len(a) else [] for a, w in zip(masks, widths, strict=True)])

    return pages.select(key, F.posexplode(found(F.col(values), F.col(width))).alias("nth", "c")).select(key, "nth", "c.*")


def apart(boxes: DataFrame, blockers: DataFrame, key: str = "page", cell: int = CELL) -> DataFrame:
    """Boxes (key, nth, left, top, right, bottom) that share no area with any of the page's blockers (key, left, top, right, bottom).

    Both sides go to the cells of a grid that they cover and meet there, so a page of many small boxes costs its cells and not its
    pairs. Boxes without area meet nothing; a null side meets nothing.
    """
    def cells(df: DataFrame, *columns: str) -> DataFrame:
        real = df.where((F.col("right") > F.col("left")) & (F.col("bottom") > F.col("top")))
        over = lambda low, high: F.sequence(F.floor(F.col(low) / cell), F.floor((F.col(high) - 1e-9) / cell))
        across = real.select(*columns, "left", "top", "right", "bottom", F.explode(over("left", "right")).alias("gx"))
        return across.select("*", F.explode(over("top", "bottom")).alias("gy"))

    b, o = cells(boxes, key, "nth").alias("b"), cells(blockers, key).alias("o")
    same = (F.col(f"b.{key}") == F.col(f"o.{key}")) & (F.col("b.gx") == F.col("o.gx")) & (F.col("b.gy") == F.col("o.gy"))
    meet = (F.col("b.left") < F.col("o.right")) & (F.col("o.left") < F.col("b.right")) & (F.col("b.top") < F.col("o.bottom")) & (F.col("o.top") < F.col("b.bottom"))
    met = b.join(o, same & meet, "left_semi").select(key, "nth").distinct()
    return boxes.join(met, [key, "nth"], "left_anti")


def figures(found: DataFrame, regions: DataFrame, key: str = "page") -> DataFrame:
    """key, nth, left, top, right, bottom, conf: components (see there) that are figures and meet no region of their page.

    A figure's box covers 2 % to half of the page, is neither five times as wide as high nor the reverse, and more than half of it
    is ink, which is its confidence.
    """
    wide, high = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    page = F.col("page_width") * F.col("page_height")
    fit = found.where((wide * high >= page * LEAST_FIGURE) & (wide * high <= page * MOST_FIGURE) & (wide / high > NARROWEST) & (wide / high < WIDEST) & (F.col("density") > SOLID))
    # two steps of apart() read what is found; without this the masks are searched for each
    return apart(stored(fit, "figures"), regions, key).select(key, "nth", "left", "top", "right", "bottom", F.col("density").alias("conf"))


def ruled_boxes(pages: DataFrame, key: str, values: str = "mask", width: str = "w", region: str | None = None) -> DataFrame:
    """key, nth, left, top, right, bottom, across, down, area: outer boxes of the page's straight lines, with the lines' ink by row and by column.

    Lines are ink that lies on a run of a 30th of the page (10 at least) across or down. region (struct<left, top, right, bottom>)
    names the part to look at; sizes are then its own and boxes are moved back to the page. A region that leaves the page
    gives nothing. area is that of the part looked at; across has the horizontal lines' ink by row, down the others' by column.
    """

    @F.pandas_udf("array<struct<left: int, top: int, right: int, bottom: int, across: array<int>, down: array<int>, area: long>>")
    def found(masks: pd.Series, widths: pd.Series, lefts: pd.Series, tops: pd.Series, rights: pd.Series, bottoms: pd.Series) -> pd.Series:
        def one(a, w, *region) -> list[dict]:
            if a is None or not len(a):
                return []
            ink = np.asarray(a).reshape(-1, int(w)) != 0
            x0, y0, x1, y1 = (0, 0, ink.shape[1], len(ink)) if region[0] != region[0] or region[0] is None else map(int, region)
            if not (0 <= x0 < x1 <= ink.shape[1] and 0 <= y0 < y1 <= len(ink)):
                return []
            part = ink[y0:y1, x0:x1]
            across = opened(part, max(part.shape[1] // LINE_PART, LEAST_OPENING))
            down = opened(part.T, max(len(part) // LINE_PART, LEAST_OPENING)).T
            names = ("left", "top", "right", "bottom", "across", "down", "area")
            return [
                dict(zip(names, (l + x0, t + y0, r + x0, b + y0, across[t:b, l:r].sum(axis=1).tolist(), down[t:b, l:r].sum(axis=0).tolist(), part.size), strict=True))
                for l, t, r, b in outer_boxes(across | down)
            ]

        return pd.Series([one(*x) for x in zip(masks, widths, lefts, tops, rights, bottoms, strict=True)])

    side = lambda s: F.col(f"{region}.{s}").cast("double") if region else F.lit(None).cast("double")
    boxes = found(F.col(values), F.col(width), *map(side, ("left", "top", "right", "bottom")))
    kept = [c for c in pages.columns if c not in (values, width)]
    return pages.select(*kept, F.posexplode(boxes).alias("nth", "b_")).select(*kept, "nth", "b_.*")


def line_runs(profile: Column, above: Column) -> Column:
    """array<struct<start, end>>: runs of places with more than `above`, ends exclusive."""

    def found(p: Column) -> Column:
        over = lambda i: F.coalesce(F.get(p, i) > above, F.lit(False))
        places = F.sequence(F.lit(0), F.size(p) - 1)
        starts = F.filter(places, lambda i: over(i) & ~over(i - 1))
        ends = F.filter(places, lambda i: over(i) & ~over(i + 1))
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e + 1).alias("end")))

    return let(profile, found)


def line_places(runs: Column, size: Column) -> Column:
    """Middles of runs of lines, with an end of the box where the outermost line is more than 5 away from it."""

    def ends(m: Column) -> Column:
        first = F.when(F.coalesce(F.get(m, F.lit(0)) > EDGE, F.lit(True)), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        last = F.when(F.coalesce(F.get(m, F.size(m) - 1) < size - EDGE, F.lit(True)), F.array(size)).otherwise(F.array().cast("array<int>"))
        return F.array_sort(F.concat(first, m, last))

    return let(F.transform(runs, lambda r: F.floor((r["start"] + r["end"]) / 2).cast("int")), ends)


def tables(boxes: DataFrame) -> DataFrame:
    """Ruled boxes that are tables: their columns without the profiles, n_rows, n_cols, conf, header, and xs and ys, the places of their lines.

    A table covers 1 % of what was looked at and has two lines or more each way; a line is a run of rows (columns) in which more than a
    tenth of the box's width (height) is ink. header: there is more than one row of cells.
    """
    wide, high = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    tenth = lambda v: F.floor(v / LINE_SHARE)
    lined = boxes.where(wide * high / F.col("area") >= LEAST_TABLE).withColumns({"h_": line_runs(F.col("across"), tenth(wide)), "v_": line_runs(F.col("down"), tenth(high))})
    kept = lined.where((F.size("h_") >= LEAST_LINES) & (F.size("v_") >= LEAST_LINES))
    placed = kept.withColumns(
        {
            "n_rows": F.size("h_") - 1, "n_cols": F.size("v_") - 1, "conf": (F.least(F.lit(1.0), (F.size("h_") + F.size("v_")) / 10) + REGULAR) / 2,
            "ys": F.transform(line_places(F.col("h_"), high), lambda y: y + F.col("top")), "xs": F.transform(line_places(F.col("v_"), wide), lambda x: x + F.col("left")),
        }
    )
    return placed.withColumn("header", F.size("ys") > 2).drop("across", "down", "area", "h_", "v_")


def cells(found: DataFrame) -> DataFrame:
    """The cells of tables: their columns but xs and ys, with row, col and the cell's cell_left, cell_top, cell_right, cell_bottom."""
    kept = [F.col(c) for c in found.columns if c not in ("xs", "ys")]
    rows = found.select(*kept, "xs", "ys", F.explode(F.sequence(F.lit(0), F.size("ys") - 2)).alias("row"))
    both = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("xs") - 2)).alias("col"))
    at = lambda a, i: F.get(F.col(a), i)
    return both.select(
        *kept, "row", "col", at("xs", F.col("col")).alias("cell_left"), at("ys", F.col("row")).alias("cell_top"), at("xs", F.col("col") + 1).alias("cell_right"), at("ys", F.col("row") + 1).alias("cell_bottom")
    )


def region_tables(pages: DataFrame, regions: DataFrame, key: str = "page") -> DataFrame:
    """key, id, left, top, right, bottom, n_rows, n_cols, conf, header, xs, ys: the table looked for again within each TABLE region (key, id, type, left, ...).

    Of several the one whose first cell comes last in reading order is taken, which a contour finder that puts what it finds in front
    names first. Regions of other types and those without a table have no row.
    """
    asked = regions.where(F.col("type") == "TABLE").select(key, "id", F.struct("left", "top", "right", "bottom").alias("region"))
    found = tables(ruled_boxes(pages.join(asked, key), key, region="region"))
    names = ["left", "top", "right", "bottom", "n_rows", "n_cols", "conf", "header", "xs", "ys"]
    last = F.max_by(F.struct(*names), "nth").alias("t")
    return found.groupBy(key, "id").agg(last).select(key, "id", "t.*")
