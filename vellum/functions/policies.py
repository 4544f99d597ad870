"""Decision rules as Column expressions: when to stop, retry or fall back, and how to name what is made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import quads as G

# Fixed values -------------------------------------------------------------------------------------------------
EXIT_CONF, EXIT_WORDS, EXIT_LENGTH = 70, 30, 200
FALLBACK_WORDS, FALLBACK_CONF = 20, 50
UNEVEN = 28.0
#: Segmentation mode of each region type; 3 for all others.
MODES = {"HEADER": 6, "BODY": 3, "FOOTER": 7, "TABLE": 6, "CAPTION": 7, "SIDEBAR": 6, "MARGIN_NOTE": 6, "COLUMN": 4}
FALLBACK_MARGIN, FALLBACK_TOLERANCE = 20, 2.5
# ----------------------------------------------------------------------------------------------------------------


def may_stop(conf: Column, words: Column, length: Column) -> Column:
    """A result is good enough to try no further."""
    return (conf >= EXIT_CONF) & (words >= EXIT_WORDS) & (length >= EXIT_LENGTH)


def needs_whole_page(words: Column, conf: Column) -> Column:
    return (words < FALLBACK_WORDS) | (conf < FALLBACK_CONF)


def half_differences(pixels: DataFrame, key: str = "page") -> DataFrame:
    """key, difference, uneven: the larger difference of mean luminance between halves of (key, x, y, v)."""
    page = Window.partitionBy(key)
    p = pixels.withColumn("w", F.max("x").over(page) + 1).withColumn("h", F.max("y").over(page) + 1)
    mean = lambda c: F.avg(F.when(c, F.col("v")))
    top, left = F.col("y") < F.floor(F.col("h") / 2), F.col("x") < F.floor(F.col("w") / 2)
    halves = p.groupBy(key).agg(mean(top).alias("t"), mean(~top).alias("b"), mean(left).alias("l"), mean(~left).alias("r"))
    d = F.greatest(F.abs(F.col("t") - F.col("b")), F.abs(F.col("l") - F.col("r")))
    return halves.select(key, d.alias("difference"), (d > UNEVEN).alias("uneven"))


def density(set_pixels: Column, all_pixels: Column) -> Column:
    return F.coalesce(F.try_divide(set_pixels, all_pixels), F.lit(0.0))


def is_usable_quad(q: Column, w: Column, h: Column, slack: float = 0.25) -> Column:
    """Finite, within the image and a quarter of it around, and strictly convex in the order top left, top right, bottom right, bottom left."""
    inside = lambda v, size: (v >= -slack * size) & (v <= size * (1 + slack))
    points = F.forall(q, lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & inside(p["x"], w) & inside(p["y"], h))
    return F.coalesce((F.size(q) == 4) & points & (F.least(*G.turns(q)) > 0), F.lit(False))


def is_default_rectangle(q: Column, w: Column, h: Column) -> Column:
    """The quad is the rectangle that stands in for none: a tenth of the shorter side, at least 20 pixels, off all four sides."""
    m = F.greatest(F.lit(FALLBACK_MARGIN), F.floor(F.least(w, h) / 10))
    want = ((m, m), (w - m, m), (w - m, h - m), (m, h - m))
    near = [F.abs(F.get(q, F.lit(i))[c] - v) <= FALLBACK_TOLERANCE for i, p in enumerate(want) for c, v in zip("xy", p, strict=True)]
    all_ = near[0]
    for x in near[1:]:
        all_ = all_ & x
    return F.coalesce((F.size(q) == 4) & all_, F.lit(False))


def is_image_quad(q: Column, w: Column, h: Column, least: float = 0.02) -> Column:
    """In bounds, 2 % of the image at least, strictly convex."""
    inside = F.forall(q, lambda p: (p["x"] >= 0) & (p["x"] <= w) & (p["y"] >= 0) & (p["y"] <= h))
    return F.coalesce(inside & (G.area(q) >= least * w * h) & G.is_strictly_convex(q), F.lit(False))


def axis_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between a line and the nearer axis; NaN for a single point."""
    a = F.abs(F.degrees(F.atan2(by - ay, bx - ax)))
    return F.when((ax == bx) & (ay == by), F.lit(float("nan"))).otherwise(F.least(F.abs(a), F.abs(a - 90), F.abs(a - 180)))


def turns_for_export(from_file: Column, mode: Column, degrees: Column) -> Column:
    """A page in memory is turned by any angle but 0; one from a file only if its turn is stored apart from the pixels."""
    stored = F.coalesce(F.lower(mode) == "metadata", F.lit(False))
    return (F.pmod(degrees, F.lit(360)) != 0) & (~from_file | stored)


def date_name(template: Column, ts: Column) -> Column:
    """A file name's {date} and {time} filled in."""
    return F.replace(F.replace(template, F.lit("{date}"), F.date_format(ts, "yyyy-MM-dd")), F.lit("{time}"), F.date_format(ts, "HHmmss"))


def document_name(ts: Column) -> Column:
    return F.concat(F.lit("DOC_"), F.date_format(ts, "yyyyMMdd_HHmmss"))


def unique_names(df: DataFrame, folder: str, base: str, extension: str, order: str) -> DataFrame:
    """Adds name: base.ext for the first of a folder's equal names, base_2.ext and on for the others."""
    nth = F.row_number().over(Window.partitionBy(folder, base, extension).orderBy(order))
    return df.withColumn("name", F.concat(F.col(base), F.when(nth > 1, F.concat(F.lit("_"), nth.cast("string"))).otherwise(""), F.lit("."), F.col(extension)))


def reading_mode(kind: Column) -> Column:
    """Segmentation mode for a region's type."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, v in MODES.items() for x in (k, v))), kind), F.lit(3))
