"""Reading order: words to lines and paragraphs, regions to an order, ink projections to columns.

A page is bounded, so its words travel as one array per page; groupings into lines are one pass over such arrays in
pandas UDFs, as aggregate() copies what it has found so far at every step. Profiles
(page, x, v) stay rows and use windows within a page.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from vellum.functions import text as T
from vellum.functions.quads import let

WORD = "struct<pos: int, w: string, left: double, top: double, right: double, bottom: double>"


def pages(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and words: the page's words by top, left, bottom, right."""
    one = F.struct("top", "left", "bottom", "right", "pos", "w")
    return words.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("words"))


def _of_page(*fields: str):
    """Makes a rule on a page's fields (arrays of doubles), which gives whole numbers, a Column of the page's sorted words; in Arrow batches, one pass a page."""

    def made(rule: Callable[..., list]):
        @F.pandas_udf(ArrayType(IntegerType()))
        def pages_(*columns: pd.Series) -> pd.Series:
            return pd.Series([None if any(x is None for x in own) else rule(*own) for own in zip(*columns, strict=True)])

        def column(words: Column) -> Column:
            field = lambda name: F.transform(words, lambda w: w[name].cast("double"))
            return pages_(*map(field, fields))

        column.__doc__, column.__name__, column.rule = rule.__doc__, rule.__name__, rule
        return column

    return made


@_of_page("top", "bottom")
def fixed_anchor_lines(top, bottom):
    """Line number of each word of a sorted array: a word joins while its middle is within 0.6 of the largest height in the line of the first word's middle."""
    line, anchor, tolerance, out = -1, 0.0, -1.0, []
    for t, b in zip(top.tolist(), bottom.tolist(), strict=True):
        middle, wide = (t + b) / 2, (b - t) * 0.6
        if abs(middle - anchor) <= tolerance:
            tolerance = max(tolerance, wide)
        else:
            line, anchor, tolerance = line + 1, middle, wide
        out.append(line)
    return out


def upper_median(values: Column) -> Column:
    """The middle of an array of numbers, the upper one of two."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


@_of_page("top", "bottom", "left", "right", "pos")
def _running_mean(top, bottom, left, right, pos):
    middle, n = (top + bottom) / 2, len(top)
    tolerance = 0.6 * float(np.sort(np.maximum(1.0, bottom - top))[n // 2]) if n else 0.0
    line, mean, count, out = -1, 0.0, 0, np.zeros(n, np.int64)
    for k in np.lexsort((pos, (left + right) / 2, middle)).tolist():
        m = float(middle[k])
        if count and abs(m - mean) <= tolerance:
            count += 1
            mean = (mean * (count - 1) + m) / count
        else:
            line, mean, count = line + 1, m, 1
        out[k] = line
    return out


def running_mean_lines(words: Column) -> Column:
    """array<struct<pos, line>>, in the order of middle and centre: a word joins within 0.6 of the page's upper median height of the line's mean middle."""
    return F.zip_with(words, _running_mean(words), lambda w, line: F.struct(w["pos"].alias("pos"), line.alias("line")))


def first_fit(middles: list[float], tolerance: float, whole: bool = False) -> list[int]:
    """Line number of each middle in turn: the first line, of all so far, whose mean (cut to a whole number) is within tolerance."""
    sums, counts, means = np.zeros(len(middles)), np.zeros(len(middles)), np.zeros(len(middles))
    out, n = [], 0
    for m in middles:
        near = np.abs(means[:n] - m) <= tolerance
        k = int(near.argmax()) if n and near.any() else n
        n += k == n
        sums[k] += m
        counts[k] += 1
        mean = sums[k] / counts[k]
        means[k] = int(mean) if whole else mean
        out.append(k)
    return out


def _in_place(order: np.ndarray, lines: list[int]) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = lines
    return out


@_of_page("top", "bottom", "left", "pos")
def integer_first_fit_lines(top, bottom, left, pos):
    """Line number of each word: whole-number middles by middle and left; tolerance the upper median height, 6 at least."""
    top, bottom, left = (np.trunc(x).astype(np.int64) for x in (top, bottom, left))
    heights = np.sort(np.maximum(0, bottom - top))
    middle = (top + bottom) // 2
    order = np.lexsort((pos, left, middle))
    return _in_place(order, first_fit(middle[order].tolist(), max(6, int(heights[len(heights) // 2])) if len(heights) else 6, True))


@_of_page("top", "bottom", "left", "pos")
def decimal_first_fit_lines(top, bottom, left, pos):
    """Line number of each word: middles by top and left; tolerance 0.45 of the true median height, 4 at least."""
    middle = (top + bottom) / 2
    order = np.lexsort((pos, middle, left, top))
    return _in_place(order, first_fit(middle[order].tolist(), max(4.0, 0.45 * float(np.median(bottom - top)) if len(top) else 0.0)))


def words_to_text(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and text: lines by the fixed-anchor rule, words from left to right (right to left in RTL lines), a blank line after large gaps.

    A gap is large if it is above 1.5 of the page's mean word height.
    """
    lined = pages(words, key).select(key, F.explode(F.arrays_zip("words", fixed_anchor_lines(F.col("words")).alias("line"))).alias("z")).select(key, "z.words.*", "z.line")
    heights = Window.partitionBy(key)
    lined = lined.withColumn("mean_height", F.avg(F.col("bottom") - F.col("top")).over(heights))
    entry = F.struct("left", "top", "bottom", "right", "pos", "w")
    by_line = lined.groupBy(key, "line").agg(
        F.array_sort(F.collect_list(entry)).alias("ltr"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.first("mean_height").alias("mean_height"), F.concat_ws(" ", F.collect_list("w")).alias("all_")
    )
    ordered = F.when(T.is_rtl(F.col("all_")), F.reverse("ltr")).otherwise(F.col("ltr"))
    before = F.lag("bottom").over(Window.partitionBy(key).orderBy("line"))
    text = by_line.withColumn("gap", F.col("top") - before).select(
        key, "line", F.concat(F.when(F.col("gap") > 1.5 * F.col("mean_height"), "\n").otherwise(""), T.decode_named(F.array_join(F.transform(ordered, lambda x: x["w"]), " "))).alias("text")
    )
    return text.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))


@_of_page("top", "tolerance")
def _bands(top, tolerance):
    band, anchor, out = -1, 0.0, []
    for t, wide in zip(top.tolist(), tolerance.tolist(), strict=True):
        if band < 0 or abs(t - anchor) > wide:
            band, anchor = band + 1, t
        out.append(band)
    return out


def banded_order(regions: DataFrame, key: str | list[str], direction: Column) -> DataFrame:
    """Regions (key, id, left, top, right, bottom) in bands of rows, and within a band from the reading side.

    A region joins the band if its top is within half the page's mean height, in whole numbers, of the band's first top.
    """
    keys = [key] if isinstance(key, str) else key
    mean = F.avg(F.col("bottom") - F.col("top")).over(Window.partitionBy(*keys))
    one = F.struct("top", "left", "bottom", "right", "id", "tolerance")
    page = regions.withColumn("tolerance", F.floor(F.floor(mean) * 0.5)).groupBy(*keys, direction.alias("direction")).agg(F.array_sort(F.collect_list(one)).alias("r"))
    bands = page.withColumn("bands", _bands(F.col("r"))).select(*keys, "direction", F.explode(F.arrays_zip("r", "bands")).alias("z"))
    rows = bands.select(*keys, "z.r.id", "z.bands", "z.r.top", F.when(F.col("direction") == "RTL", -F.col("z.r.left")).otherwise(F.col("z.r.left")).alias("side"))
    return rows.withColumn("reading_order", F.row_number().over(Window.partitionBy(*keys).orderBy("bands", "side", "top", "id")) - 1).select(*keys, "id", "reading_order")


def column_order(regions: DataFrame, key: str) -> DataFrame:
    """Headers, what lies above the columns, the columns in turn, what lies below, footers.

    regions: key, id, type, column_index (-1 for none), direction, left, top, right, bottom. A region in no column lies
    above if it ends above the columns' top or its middle does, else below; both parts are in banded order. All
    others go by their tops, ties by id.
    """
    page = Window.partitionBy(key)
    in_column = (F.col("column_index") >= 0) & ~F.col("type").isin("HEADER", "FOOTER")
    first = F.min(F.when(in_column, F.col("top"))).over(page)
    last = F.max(F.when(in_column, F.col("bottom"))).over(page)
    middle = F.floor((F.col("top") + F.col("bottom")) / 2)
    above = (F.col("bottom") <= F.col("first")) | ((F.col("top") < F.col("last")) & (middle < F.col("first")))
    zone = F.when(F.col("type") == "HEADER", 0).when(F.col("type") == "FOOTER", 4).when(in_column, 2).when(F.coalesce(above, F.lit(True)), 1).otherwise(3)
    ranked = regions.withColumn("first", first).withColumn("last", last).withColumn("zone", zone)
    side = F.when(F.col("direction") == "RTL", -1).otherwise(1)
    column = F.when(F.col("zone") == 2, F.col("column_index") * side).otherwise(0)
    listed = ranked.where("zone % 2 = 0").select(key, "id", "zone", F.row_number().over(Window.partitionBy(key, "zone").orderBy(column, "top", "id")).alias("place"))
    banded = banded_order(ranked.where("zone % 2 = 1"), [key, "zone"], F.col("direction")).select(key, "id", "zone", F.col("reading_order").alias("place"))
    order = F.row_number().over(Window.partitionBy(key).orderBy("zone", "place")) - 1
    return listed.unionByName(banded).select(key, "id", "zone", order.alias("reading_order"))


def table_order(cells: DataFrame, key: str) -> DataFrame:
    """Cells by row, then column from the reading side."""
    side = F.when(F.col("direction") == "RTL", -F.col("col_index")).otherwise(F.col("col_index"))
    return cells.withColumn("reading_order", F.row_number().over(Window.partitionBy(key).orderBy("row_index", side, "id")) - 1)


def tree_order(regions: DataFrame, key: str) -> DataFrame:
    """Regions (key, id, parent, type, direction, left, top, right, bottom, row_index, col_index) with reading_order among their siblings.

    Cells of a table go by row and column, all other regions in bands of rows. parent is null at the top. A tree is a table of
    edges, so every level is ordered at once.
    """
    kinds = regions.select(key, F.col("id").alias("parent"), F.col("type").alias("parent_type"))
    met = regions.join(kinds, [key, "parent"], "left").withColumn("parent", F.coalesce("parent", F.lit(-1)))
    cell = F.coalesce(F.col("parent_type") == "TABLE", F.lit(False))
    side = F.when(F.col("direction") == "RTL", -F.col("col_index")).otherwise(F.col("col_index"))
    place = F.row_number().over(Window.partitionBy(key, "parent").orderBy("row_index", side, "id")) - 1
    cells = met.where(cell).select(key, "parent", "id", place.alias("reading_order"))
    return cells.unionByName(banded_order(met.where(~cell), [key, "parent"], F.col("direction")).select(key, "parent", "id", "reading_order"))


def zones(regions: DataFrame, header_at: float = 0.12, footer_at: float = 0.92) -> DataFrame:
    """type of each region by where it lies on its page (column page_height)."""
    return regions.withColumn("type", F.when(F.col("bottom") <= F.col("page_height") * header_at, "HEADER").when(F.col("top") >= F.col("page_height") * footer_at, "FOOTER").otherwise("BODY"))


def vertical_projection(pixels: DataFrame, key: str = "page") -> DataFrame:
    """key, x, v: set pixels in each column of (key, x, y, px)."""
    return pixels.groupBy(key, "x").agg(F.count_if(F.col("px") != 0).cast("int").alias("v"))


def smoothed(profile: DataFrame, width: int, key: str = "page") -> DataFrame:
    """The centred mean of `width` neighbours, cut at the edges, in whole numbers."""
    w = Window.partitionBy(key).orderBy("x").rowsBetween(-(width // 2), width // 2)
    return profile.withColumn("v", F.floor(F.sum("v").over(w) / F.count("v").over(w)).cast("int"))


def page_smoothed(profile: DataFrame, key: str = "page") -> DataFrame:
    """smoothed() over a hundredth of the page's width, 5 at least; a page's profile is bounded and travels as one array."""
    pages_ = profile.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda c: c["v"]).alias("p"))
    half = F.floor(F.greatest(F.lit(5), F.floor(F.size("p") / 100)) / 2).cast("int")

    def mean(_, i: Column) -> Column:
        low, high = F.greatest(F.lit(0), i - F.col("half")), F.least(F.size("p") - 1, i + F.col("half"))
        return F.floor(F.aggregate(F.slice("p", low + 1, high - low + 1), F.lit(0).cast("long"), lambda s, v: s + v) / (high - low + 1)).cast("int")

    return pages_.withColumn("half", half).select(key, F.posexplode(F.transform("p", mean)).alias("x", "v"))


def runs(profile: DataFrame, condition: Column, key: str = "page") -> DataFrame:
    """key, start, end (exclusive), least, n: the runs of x in which the condition holds."""
    order = Window.partitionBy(key).orderBy("x")
    marked = profile.withColumn("ok", F.coalesce(condition, F.lit(False)))
    island = F.row_number().over(order) - F.row_number().over(Window.partitionBy(key, "ok").orderBy("x"))
    return marked.withColumn("island", island).where("ok").groupBy(key, "island").agg(F.min("x").alias("start"), (F.max("x") + 1).alias("end"), F.min("v").alias("least"), F.count("*").alias("n")).drop("island")


#: A valley's depth and width, margins that hold neither its depth nor the valley itself, and a local valley's depths and extent.
LOW, NARROWEST, MARGIN, INNER, COLUMN = 0.35, 0.015, 0.05, 0.15, 0.15
DIP, MEAN_DIP, EXTENT, REACH = 0.5, 0.8, 0.7, 5


def valleys(profile: DataFrame, key: str = "page", low: float = LOW, narrowest: float = NARROWEST, margin: float = MARGIN, inner: float = INNER) -> DataFrame:
    """key, start, end (exclusive), least, width: runs below `low` of the largest value, `narrowest` of the width at least, away from the margins."""
    page = Window.partitionBy(key)
    width = F.count("*").over(page)
    p = profile.withColumn("width", width)
    inside = (F.col("x") >= F.floor(F.col("width") * margin)) & (F.col("x") < F.col("width") - F.floor(F.col("width") * margin))
    p = p.withColumn("most", F.max(F.when(inside, F.col("v"))).over(page))
    kept = (F.col("x") >= F.floor(F.col("width") * inner)) & (F.col("x") < F.col("width") - F.floor(F.col("width") * inner))
    found = runs(p.where(kept & (F.col("most") > 0)), F.col("v") < F.floor(F.col("most") * low), key)
    size = p.groupBy(key).agg(F.max("width").alias("width"))
    return found.join(size, key).where(F.col("n") >= F.floor(F.col("width") * narrowest)).select(key, "start", "end", "least", "width")


def dips_of(p: list[float]) -> list[tuple[int, int]]:
    """From the left, dips far below their neighbourhood, each with its extent (both ends within); the next one begins well after it.

    A dip is no higher than its REACH neighbours, below DIP of the mean of both sides' means and below MEAN_DIP of the page's.
    """
    n = len(p)
    outer, inner, window, narrow = int(n * MARGIN), int(n * INNER), int(n * 0.1), int(n * NARROWEST)
    if n <= 2 * outer or window < 2:
        return []
    mean, sample = sum(p[outer : n - outer]) / (n - 2 * outer), window // 2
    found, i = [], inner + window
    while i < n - inner - window:
        v = p[i]
        if min(p[max(inner, i - REACH) : min(i + REACH + 1, n - inner)]) == v:
            left = sum(p[max(inner, i - sample - sample + 1) : i - sample + 1])
            right = sum(p[i + sample : min(n - inner, i + sample + sample)])
            around = (left / sample + right / sample) / 2
            if v < around * DIP and v < mean * MEAN_DIP:
                start = end = i
                while start > inner and p[start - 1] < around * EXTENT:
                    start -= 1
                while end < n - inner - 1 and p[end + 1] < around * EXTENT:
                    end += 1
                if end - start >= narrow:
                    found.append((start, end))
                    i = end + window
        i += 1
    return found


def local_valleys(profile: DataFrame, key: str = "page") -> DataFrame:
    """key, start, end (both within) of dips_of(); a page's profile is bounded and travels as one array."""

    @F.pandas_udf("array<struct<start: int, end: int>>")
    def dips(profiles: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e} for s, e in dips_of(list(p))] for p in profiles])

    pages_ = profile.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda c: c["v"].cast("double")).alias("p"))
    return pages_.select(key, F.inline(dips("p")))


def detect_columns(profile: DataFrame, key: str = "page") -> DataFrame:
    """key, column_index, left, right: the smoothed profile cut at the best deep valley, else at the dips, else at the centre's valley; else one column.

    Profiles of fewer than 100 places are one column.
    """
    from vellum.operators.review import centre_valley

    page = Window.partitionBy(key)
    smooth = page_smoothed(profile.withColumn("n", F.count("*").over(page)).where("n >= 100").drop("n"), key)
    first = best_valley(valleys(smooth, key), key).select(key, "start", "end", F.lit(1).alias("strategy"))
    second = local_valleys(smooth, key).select(key, "start", "end", F.lit(2).alias("strategy"))
    third = centre_valley(smooth, key).select(key, "start", "end", F.lit(3).alias("strategy"))
    every = first.unionByName(second).unionByName(third)
    chosen = every.withColumn("best", F.min("strategy").over(page)).where("strategy = best")
    return columns(profile.groupBy(key).agg(F.count("*").cast("int").alias("width")), chosen, key)


def best_valley(found: DataFrame, key: str = "page") -> DataFrame:
    """The valley with the best of 0.3 depth, 0.2 width and 0.5 nearness to the centre; the first of equal ones."""
    centre = F.floor((F.col("start") + F.col("end")) / 2)
    off = F.abs(centre - F.floor(F.col("width") / 2)) / F.col("width")
    score = 0.3 / (1 + F.col("least")) + 0.2 * (F.col("end") - F.col("start")) / F.col("width") + 0.5 * (1 - off)
    order = Window.partitionBy(key).orderBy(F.desc("score"), "start")
    return found.withColumn("score", score).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def columns(pages_: DataFrame, cuts: DataFrame, key: str = "page", narrowest: float = COLUMN) -> DataFrame:
    """key, column_index, left, right: pages (key, width) cut in the middle of each valley, narrow columns dropped; the whole page if none is left."""
    at = cuts.select(key, F.floor((F.col("start") + F.col("end")) / 2).cast("int").alias("x")).where("x > 0")
    edges = pages_.select(key, F.lit(0).alias("x")).unionByName(at).unionByName(pages_.select(key, F.col("width").cast("int").alias("x")))
    order = Window.partitionBy(key).orderBy("x")
    cut = edges.withColumn("right", F.lead("x").over(order)).where("right IS NOT NULL AND right > x").withColumnRenamed("x", "left")
    every = cut.join(pages_.select(key, "width"), key).withColumn("parts", F.count("*").over(Window.partitionBy(key)))
    wide = every.withColumn("wide", (F.col("parts") == 1) | (F.col("right") - F.col("left") >= F.floor(F.col("width") * narrowest)))
    kept = wide.withColumn("some", F.max("wide").over(Window.partitionBy(key))).where("wide OR NOT some")
    whole = ~F.col("some")
    kept = kept.select(key, F.when(whole, 0).otherwise(F.col("left")).alias("left"), F.when(whole, F.col("width").cast("int")).otherwise(F.col("right")).alias("right")).distinct()
    return kept.withColumn("column_index", F.row_number().over(Window.partitionBy(key).orderBy("left")) - 1).select(key, "column_index", "left", "right")


def table_confidence(h_lines: Column, v_lines: Column) -> Column:
    return (F.least(F.lit(1.0), (h_lines + v_lines) / 10.0) + 0.8) / 2


def table_cells(xs: Column, ys: Column) -> Column:
    """Cells between neighbouring line positions, row by row."""
    spans = lambda a: F.arrays_zip(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))).alias("a"), F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))).alias("b"))
    one = lambda y, r: F.transform(spans(xs), lambda x, c: F.named_struct(F.lit("row"), r, F.lit("col"), c, F.lit("left"), x["a"], F.lit("top"), y["a"], F.lit("right"), x["b"], F.lit("bottom"), y["b"]))
    return F.flatten(F.transform(spans(ys), one))


def kendall(expected: DataFrame, actual: DataFrame, key: str, item: str) -> DataFrame:
    """key, discordant, pairs, accuracy (1 - discordant / pairs): pairs of items in both lists that are the other way round.

    Both have key, item and place. Lists are pages' zones, so pairs within a key stay few.
    """
    both = expected.select(key, item, F.col("place").alias("p")).join(actual.select(key, item, F.col("place").alias("q")), [key, item])
    b = both.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("p", "q"))).alias("l"))
    wrong = F.aggregate(F.transform("l", lambda x, i: F.size(F.filter(F.slice(F.col("l"), i + 2, F.size("l")), lambda y: y["q"] < x["q"]))), F.lit(0), lambda a, n: a + n)
    n = F.size("l")
    pairs = F.floor(n * (n - 1) / 2)
    return b.select(key, wrong.cast("long").alias("discordant"), pairs.alias("pairs"), F.when(pairs == 0, 1.0).otherwise(1 - wrong / pairs).alias("accuracy"))
