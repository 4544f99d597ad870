"""Samples to train and test with: made pages with their targets, and labels of pages photographed with a grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from vellum.functions import quads as G
from vellum.functions import warps as K

# names and no modules, as what runs on executors is pickled by value
from vellum.functions.quads import polygon_cells
from vellum.functions.tensors import heat_maps
from vellum.sources.tables import fresh

# Sizes of made pages, margins, brightness of ground and page, spread of the noise ------------------
SIZE, MARGIN, GROUND, PAGE, NOISE = (320, 1100), (0.10, 0.25), (0.05, 0.20), (0.80, 0.95), 0.01
#: Samples drawn together, so that a task holds few images.
BATCH = 16
# ----------------------------------------------------------------------------------------------------------------


def draw(name: Column, nth: int, low: float = 0.0, high: float = 1.0) -> Column:
    """A number in [low, high) from the first four bytes of md5('<name>:<nth>'), big-endian."""
    share = F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{nth}"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return low + (high - low) * share


def hashed(value: int, seed: np.ndarray) -> np.ndarray:
    """XXH64 of a whole number of 32 bits for each seed, as xxhash64() chains it."""
    p = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
    value = np.asarray(value, np.uint64)
    h = seed.astype(np.uint64) + p[4] + np.uint64(4) ^ value * p[0]
    h = (h << np.uint64(23) | h >> np.uint64(41)) * p[1] + p[2]
    h = (h ^ h >> np.uint64(33)) * p[1]
    h = (h ^ h >> np.uint64(29)) * p[2]
    return h ^ h >> np.uint64(32)


def noise(name: np.ndarray, size: int) -> np.ndarray:
    """(names, size): normally distributed numbers from two hashes of a name (given as its xxhash64) and a place."""
    at = hashed(np.arange(size), name[:, None])
    share = lambda salt: ((hashed(salt, at) & np.uint64((1 << 40) - 1)).astype(float) + 1) / float(1 << 40)
    return np.sqrt(-2 * np.log(share(0))) * np.cos(2 * np.pi * share(1))


def _lists(values: np.ndarray) -> pa.Array:
    """An array of lists of an axis less for each further axis."""
    out = pa.array(values.ravel())
    for n in values.shape[:0:-1]:
        out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, n, dtype=np.int32)), out)
    return out


def synthetic(ids: DataFrame, name: str, seed: int = 0, sigma: float = 2.0) -> DataFrame:
    """ids with src_w, src_h, corners (in the source), q (in the frame of 256), heat (four maps of 64 x 64), mask (64 x 64) and image (256 x 256).

    A made page is an upright rectangle with margins, bright on dark with some noise. Everything is a hash of seed and name, so a
    sample is the same on any partitioning and in any table; a null name has null values.
    """
    key = F.concat(F.lit(f"{seed}:"), F.col(name).cast("string"))
    size = lambda n: F.floor(draw(key, n, *SIZE)).cast("int")
    near = lambda n, side: draw(key, n, *MARGIN) * (F.col(side) - 1)
    far = lambda n, side: (1 - draw(key, n, *MARGIN)) * (F.col(side) - 1)
    sized = ids.withColumns({"src_w": size(0), "src_h": size(1)})
    corners = G.let(
        F.struct(near(2, "src_w").alias("l"), near(3, "src_h").alias("t"), far(4, "src_w").alias("r"), far(5, "src_h").alias("b")),
        lambda s: G.quad(s["l"], s["t"], s["r"], s["t"], s["r"], s["b"], s["l"], s["b"]),
    )
    framed = sized.withColumn("corners", F.when(F.col(name).isNotNull(), corners))
    framed = framed.withColumn("q", G.let(G.letterbox(F.col("src_w"), F.col("src_h")), lambda box: G.to_frame(F.col("corners"), box)))
    flat = F.flatten(F.transform("q", lambda p: F.array(p["x"], p["y"])))
    drawn = F.struct(flat.alias("q"), draw(key, 6, *GROUND).alias("low"), draw(key, 7, *PAGE).alias("high"), F.xxhash64(key).alias("key"))
    (parts,) = fresh(framed, "parts")
    names = [*framed.columns, "heat", "mask", "image"]
    doubles = ArrayType(DoubleType())
    schema = StructType(framed.schema.fields).add("heat", ArrayType(doubles)).add("mask", ArrayType(IntegerType())).add("image", doubles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column(b.num_columns - 1)
            some = given.is_valid().to_numpy(zero_copy_only=False)
            # rows without a name have no values, and others are drawn in runs between them
            edges = sorted({0, b.num_rows, *(np.flatnonzero(np.diff(some)) + 1).tolist()})
            for begin, end in ((k, min(k + BATCH, e)) for s, e in zip(edges, edges[1:], strict=False) for k in range(s, e, BATCH)):
                rest = [b.column(k).slice(begin, end - begin) for k in range(b.num_columns - 1)]
                if some[begin]:
                    own = pa.StructArray.from_arrays(given.slice(begin, end - begin).flatten(), fields=list(given.type))
                    q = np.array(own.field("q").to_pylist(), float)
                    low, high = (own.field(n).to_numpy(zero_copy_only=False)[:, None] for n in ("low", "high"))
                    mask = polygon_cells(q)
                    inside = mask.reshape(-1, 64, 64).repeat(4, axis=1).repeat(4, axis=2).reshape(len(q), -1)
                    image = np.clip(low + (high - low) * inside + NOISE * noise(own.field("key").to_numpy(zero_copy_only=False).view(np.uint64), 256 * 256), 0.0, 1.0)
                    made = [_lists(heat_maps(q.reshape(-1, 2), sigma).reshape(len(q), 4, -1)), _lists(mask), _lists(image)]
                else:
                    made = [pa.nulls(end - begin, t) for t in (pa.list_(pa.list_(pa.float64())), pa.list_(pa.int32()), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*rest, *made], names=names)

    return framed.select("*", F.when(F.col("q").isNotNull(), drawn).alias(parts)).mapInArrow(run, schema)


#: Deformations that a kind of sample must have, and those that it must not have; whether it needs a known geometry.
KINDS = {
    "perspective": (("perspective",), ("curved", "folded", "crumpled"), False),
    "curved": (("curved",), ("folded", "crumpled"), False),
    "folded": (("folded",), (), True),
    "crumpled": (("crumpled",), (), True),
}


def corners_by_sums(q: Column) -> Column:
    """Corners from the upper left one on: the least sum of x and y first, the largest third, of the other two the one with the larger x second."""
    sums = F.transform(q, lambda p: p["x"] + p["y"])
    first, third = (F.array_position(sums, end(sums)).cast("int") - 1 for end in (F.array_min, F.array_max))

    def ordered(s: Column) -> Column:
        rest = F.filter(q, lambda _, i: (i != s["a"]) & (i != s["c"]))
        a, b = F.get(rest, F.lit(0)), F.get(rest, F.lit(1))
        swap = a["x"] > b["x"]
        return F.array(F.get(q, s["a"]), F.when(swap, a).otherwise(b), F.get(q, s["c"]), F.when(swap, b).otherwise(a))

    return G.let(F.struct(first.alias("a"), third.alias("c")), ordered)


def grid_labels(samples: DataFrame, geometries: DataFrame, grids: DataFrame, images: DataFrame, kind: str | None = None) -> DataFrame:
    """sample_id, image, corners, status of samples (sample_id, geom_name) by the corner cells of their grids.

    geometries: geom_name, perspective, curved, folded, crumpled; grids: geom_name, xs, ys; images: name. The status is skipped (not of
    the kind asked for), no_image, no_grid (none, or one without numbers in its corners) or labelled; only the last has an image and corners. A sample of
    unknown geometry counts as perspective or curved, but not as folded or crumpled. Names are unique in each table.
    """
    flags = ("perspective", "curved", "folded", "crumpled")
    known = geometries.select("geom_name", *flags, F.lit(True).alias("known"))
    quads = grids.select("geom_name", K.grid_corners(F.col("xs"), F.col("ys")).alias("q"))
    there = images.select(F.regexp_extract("name", r"^(.*)\.png$", 1).alias("sample_id"), F.lit(True).alias("there")).where("sample_id <> ''")
    met = samples.select(F.col("sample_id").cast("string"), "geom_name").join(known, "geom_name", "left").join(quads, "geom_name", "left").join(there, "sample_id", "left")
    skipped = F.lit(False)
    if kind is not None:
        must, never, strict = KINDS[kind]
        flag = lambda c: F.coalesce(F.col(c), F.lit(False))
        fits = F.lit(True)
        for c in must:
            fits = fits & flag(c)
        for c in never:
            fits = fits & ~flag(c)
        skipped = ~F.when(F.col("known"), fits).otherwise(not strict)
    whole = F.coalesce(F.forall("q", lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"])), F.lit(False))
    status = F.when(skipped, "skipped").when(F.col("there").isNull(), "no_image").when(~whole, "no_grid").otherwise("labelled")
    labelled = F.col("status") == "labelled"
    image = F.when(labelled, F.concat(F.lit("uvdoc_"), "sample_id", F.lit(".png")))
    return met.withColumn("status", status).select("sample_id", image.alias("image"), F.when(labelled, corners_by_sums(F.col("q"))).alias("corners"), "status")
