"""Dataset preparation: strict pairing, validation, group-wise splits, seeded samples and mixes.

Seeded choices order by a hash of seed and name, so that they are the same on any cluster. Cuts take the smallest
hashes by ranges of the hash, so that no task ranks a whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import quads as G
from vellum.sources.tables import stored


def seed_of(name: Column, seed: int) -> Column:
    """The first four bytes of sha256('<seed>_<name>'), big-endian."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}_"), name), 256), 1, 8), 16, 10).cast("long")


def pair(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined to right one to one; a key that is missing on a side, or there twice, fails the job."""
    n = left.groupBy(key).agg(F.count("*").alias("a")).join(right.groupBy(key).agg(F.count("*").alias("b")), key, "full_outer")
    wrong = n.where("coalesce(a, 0) <> 1 OR coalesce(b, 0) <> 1").orderBy(key).limit(5).collect()
    if wrong:
        raise ValueError(f"pairing: not one to one: {[tuple(r) for r in wrong]}")
    return left.join(right, key)


#: Fixed value: the pattern of a frame's name.
FRAME = r"^(background\d+_[a-zA-Z]+\d+)_frame_\d+\.\w+$"


def sequence_of(name: Column) -> Column:
    """The sequence that a frame belongs to, or null."""
    return F.nullif(F.regexp_extract(name, FRAME, 1), F.lit(""))


def smallest(df: DataFrame, order: Column, name: str, count: int, parts: int = 4096) -> DataFrame:
    """The `count` rows with the least order (a 64-bit hash), ties by name.

    The hash's ranges are counted first; whole ranges are taken and only the one that the cut falls in is sorted.
    """
    if count <= 0:
        return df.limit(0)
    tagged = df.withColumn("order_", order).withColumn("part_", F.shiftrightunsigned(F.col("order_").bitwiseXOR(F.lit(-(1 << 63))), 64 - (parts - 1).bit_length()))
    left = count
    for r in sorted(tagged.groupBy("part_").count().collect(), key=lambda r: r["part_"]):
        if r["count"] > left:
            cut = tagged.where(F.col("part_") == r["part_"]).orderBy("order_", name).limit(left)
            return tagged.where(F.col("part_") < r["part_"]).unionByName(cut).select(*df.columns)
        left -= r["count"]
    return df


def split_groups(df: DataFrame, group: str, shares: Sequence[float], seed: int) -> DataFrame:
    """Adds split (train, val, test): groups in hash order, whole groups only; train and val sizes are rounded down."""
    order = F.xxhash64(F.col(group), F.lit(seed))
    groups = df.select(group).distinct()
    n = groups.count()
    train, val = int(n * shares[0]), int(n * shares[1])
    first = smallest(groups, order, group, train)
    second = smallest(groups, order, group, train + val).join(first, group, "left_anti")
    named = first.withColumn("split", F.lit("train")).unionByName(second.withColumn("split", F.lit("val")))
    return df.join(named, group, "left").withColumn("split", F.coalesce("split", F.lit("test")))


def split_rows(df: DataFrame, name: str, val_share: float, seed: int) -> DataFrame:
    """Adds split: round(n * val_share) rows, one at least, are val."""
    n = df.count()
    size = max(1, round(n * val_share)) if n else 0
    val = smallest(df.select(name), F.xxhash64(F.col(name), F.lit(seed)), name, size).withColumn("split", F.lit("val"))
    return df.join(val, name, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def subsample(df: DataFrame, group: str, name: str, k: int) -> DataFrame:
    """k evenly spaced rows of each group by name: those at int(i * n / k); all rows of a group of k or fewer.

    Rows are numbered in two levels, so that no task sorts a whole group: the sorted ranges of (group, name) are written once to the
    shared folder, the rows of a group in earlier ranges are counted, and a row's place in its own range is added.
    """
    ranges = df.select(group, name).repartitionByRange(group, name).sortWithinPartitions(group, name)
    rows = stored(ranges.select(group, name, F.spark_partition_id().alias("part_"), F.monotonically_increasing_id().alias("at_")), "ranges")
    counts = rows.groupBy(F.col(group).alias("group_"), F.col("part_").alias("of_")).agg(F.min("at_").alias("first_"), F.count("*").alias("own_"))
    w = Window.partitionBy("group_")
    counts = counts.withColumns({"before_": F.sum("own_").over(w.orderBy("of_")) - F.col("own_"), "n_": F.sum("own_").over(w)})
    met = rows.join(counts, (F.col("part_") == F.col("of_")) & F.col(group).eqNullSafe(F.col("group_")))
    place = met.withColumn("r_", F.col("before_") + F.col("at_") - F.col("first_"))
    # the only i with i * n div k == r can be the least one with i * n >= r * k
    return place.withColumn("i_", F.expr(f"(r_ * {k} + n_ - 1) div n_")).where(f"n_ <= {k} OR (i_ < {k} AND i_ * n_ div {k} = r_)").select(group, name)


def sample(df: DataFrame, name: str, count: int, seed: int) -> DataFrame:
    """count rows in hash order, nth from 0; with more than there are, rounds of all rows."""
    n = df.count()
    if not n or count <= 0:
        return df.limit(0).withColumn("round", F.lit(0))
    rounds, rest = divmod(count, n)
    whole = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))) if rounds else df.limit(0).withColumn("round", F.lit(0))
    part = smallest(df, F.xxhash64(F.col(name), F.lit(seed), F.lit(rounds)), name, rest).withColumn("round", F.lit(rounds))
    return whole.unionByName(part)


def mix(datasets: dict[str, DataFrame], ratios: dict[str, float], size: int, name: str, seed: int) -> DataFrame:
    """size rows from the datasets by ratio, renamed to <dataset>_<number>_<name>."""
    total = sum(ratios.values())
    out = None
    for key, df in datasets.items():
        part = sample(df, name, round(size * ratios[key] / total), seed)
        renamed = part.withColumn(name, F.concat(F.lit(f"{key}_"), F.lpad(F.col("round").cast("string"), 6, "0"), F.lit("_"), F.col(name))).withColumn("dataset", F.lit(key)).drop("round")
        out = renamed if out is None else out.unionByName(renamed)
    return out


def ratios(text: str) -> dict[str, float]:
    """name=value,...; values are positive."""
    out = {k.strip(): float(v) for k, _, v in (p.partition("=") for p in text.split(",") if p.strip())}
    if not out or min(out.values()) <= 0:
        raise ValueError(f"ratios: {text!r}")
    return out


def label_errors(corners: Column, w: Column, h: Column) -> Column:
    """Error codes of a label's corners (array<array<double>>)."""
    points = F.coalesce(F.forall(corners, lambda p: F.size(p) == 2), F.lit(False))
    inside = F.forall(corners, lambda p: (F.get(p, F.lit(0)) >= 0) & (F.get(p, F.lit(0)) <= w) & (F.get(p, F.lit(1)) >= 0) & (F.get(p, F.lit(1)) <= h))
    return F.array_compact(
        F.array(
            F.when(corners.isNull(), "missing_corners"),
            F.when(corners.isNotNull() & (F.size(corners) != 4), "corner_count"),
            F.when(corners.isNotNull() & ~points, "corner_shape"),
            F.when(points & ~F.coalesce(inside, F.lit(False)), "out_of_bounds"),
            F.when(F.coalesce((w <= 0) | (h <= 0), F.lit(True)), "image_size"),
        )
    )


def error_histogram(df: DataFrame, errors: str = "errors", most: int | None = None) -> DataFrame:
    """error, n by -n and name."""
    out = df.select(F.explode(errors).alias("error")).groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error")
    return out.limit(most) if most else out


def route(df: DataFrame, fraction: Column, threshold: float) -> DataFrame:
    """Adds split: CORE or HARD by a fraction, with a reason where it is unknown."""
    return df.withColumn("split", F.when(fraction.isNull(), None).when(fraction < threshold, "HARD").otherwise("CORE")).withColumn("skipped", F.when(fraction.isNull(), "no_area"))


def label_reasons(q: Column, w: Column, h: Column, known: Column, least: float = 0.05) -> Column:
    """All reasons against a label whose quad is in canonical order; known: its image is there."""
    area = G.signed_area(q)
    beyond = F.exists(q, lambda p: (p["x"] < 0) | (p["x"] > w - 1) | (p["y"] < 0) | (p["y"] > h - 1))
    flat = F.least(*(F.abs(t) for t in G.turns(q))) <= 1e-9
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(known, F.lit(False)), "missing_image_file"),
            F.when(beyond, "bounds_error"),
            F.when(~(area > 0), "area_non_positive").when(area / (w * h) < least, "area_fraction_lt_0.05"),
            F.when(G.crosses_itself(q), "self_intersection"),
            F.when(flat, "degenerate"),
            F.when(~G.is_convex(q, 1e-9), "not_convex"),
        )
    )


def trainable(labels: DataFrame, images: DataFrame) -> DataFrame:
    """labels (image, width, height, q) with q in canonical order, reordered, reasons and valid; images: the names that exist.

    A reordered label is one whose corners came in another order; the rows without reasons are those to train on.
    """
    there = images.select(F.col("name").alias("image"), F.lit(True).alias("known_")).distinct()
    ordered = labels.withColumn("canonical", G.clockwise(F.col("q")))
    met = ordered.join(there, "image", "left")
    reasons = label_reasons(F.col("canonical"), F.col("width"), F.col("height"), F.col("known_"))
    out = met.withColumn("reasons", reasons).withColumn("reordered", F.col("canonical") != F.col("q"))
    return out.select(*(c for c in labels.columns if c != "q"), F.col("canonical").alias("q"), "reordered", "reasons", (F.size("reasons") == 0).alias("valid"))


def parsed_labels(files: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """name, image, width, height, corners_px, reasons, usable of label files given as text; usable ones can be checked further.

    A file that is no JSON, no object or lacks keys says so and nothing else (invalid_json, invalid_schema, missing_key_<key>); then
    image_invalid, width_invalid and height_invalid may come together with the first fault of the corners
    (corners_px_not_list, corners_not_4, corner_<k>_not_pair, corner_<k>_non_numeric), which makes a file unusable.
    """
    keys = ("image", "width", "height", "corners_px")
    v = F.try_parse_json(value)
    rows = files.withColumn("v_", v).withColumns({f"{k}_v": F.try_variant_get("v_", f"$.{k}", "variant") for k in keys})
    kind = lambda c: F.coalesce(F.schema_of_variant(c), F.lit(""))
    whole = lambda c: F.coalesce(F.try_variant_get(c, "$", "long") > 0, F.lit(False)) & kind(c).isin("BIGINT", "BOOLEAN")
    number = lambda c: kind(c).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    rows = rows.withColumn("points_", F.when(kind("corners_px_v").startswith("ARRAY"), F.try_variant_get("corners_px_v", "$", "array<variant>")))
    rows = rows.withColumn("pairs_", F.transform("points_", lambda p: F.struct(kind(p).startswith("ARRAY").alias("list"), F.try_variant_get(p, "$", "array<variant>").alias("xy"))))

    def fault(p: Column, k: Column) -> Column:
        pair = p["list"] & (F.size(p["xy"]) == 2)
        numeric = F.forall(p["xy"], number)
        return F.when(~F.coalesce(pair, F.lit(False)), F.concat(F.lit("corner_"), k.cast("string"), F.lit("_not_pair"))).when(~numeric, F.concat(F.lit("corner_"), k.cast("string"), F.lit("_non_numeric")))

    faults = F.array_compact(F.transform("pairs_", fault))
    of_corners = F.when(F.col("points_").isNull(), "corners_px_not_list").when(F.size("points_") != 4, "corners_not_4").otherwise(F.get(faults, F.lit(0)))
    missing = F.array_compact(F.array(*(F.when(F.col(f"{k}_v").isNull(), f"missing_key_{k}") for k in keys)))
    image = F.when(kind("image_v") == "STRING", F.try_variant_get("image_v", "$", "string"))
    fields = F.array_compact(F.array(F.when(F.coalesce(image, F.lit("")) == "", "image_invalid"), *(F.when(~whole(F.col(f"{k}_v")), f"{k}_invalid") for k in ("width", "height")), F.col("fault_")))
    reasons = F.when(F.col("v_").isNull(), F.array(F.lit("invalid_json"))).when(~kind("v_").startswith("OBJECT"), F.array(F.lit("invalid_schema"))).when(F.size("missing_") > 0, F.col("missing_")).otherwise(fields)
    rows = rows.withColumns({"fault_": of_corners, "missing_": missing}).withColumn("reasons", reasons)
    usable = F.col("v_").isNotNull() & kind("v_").startswith("OBJECT") & (F.size("missing_") == 0) & F.col("fault_").isNull()
    corners = F.when(usable, F.transform("pairs_", lambda p: F.transform(p["xy"], lambda c: F.try_variant_get(c, "$", "double"))))
    size = lambda k: F.when(usable & whole(F.col(f"{k}_v")), F.try_variant_get(f"{k}_v", "$", "int"))
    return rows.select(name, F.when(usable, image).alias("image"), size("width").alias("width"), size("height").alias("height"), corners.alias("corners_px"), "reasons", usable.alias("usable"))
