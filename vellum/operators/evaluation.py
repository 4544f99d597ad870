"""Evaluation metrics: error rates, nearest-rank percentiles, corner errors and model comparison."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import quads as G
from vellum.functions import text as T


def report(samples: DataFrame) -> DataFrame:
    """One row over samples (truth, text, conf, latency_ms): mean error rates, mean confidence, latency percentiles."""
    scored = samples.select(T.cer(T.eval_text(F.col("truth")), T.eval_text(F.col("text"))).alias("cer"), T.wer(T.eval_text(F.col("truth")), T.eval_text(F.col("text"))).alias("wer"), "conf", "latency_ms")
    return scored.agg(F.avg("cer").alias("cer"), F.avg("wer").alias("wer"), F.avg("conf").alias("conf"), nearest_rank("latency_ms", 0.5).alias("p50"), nearest_rank("latency_ms", 0.95).alias("p95"), F.count("*").alias("n"))


def nearest_rank(column: str, p: float) -> Column:
    """The value at place ceil(p * n)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def failure(q: Column, w: Column, h: Column, min_area: float = 0.05, bounds: bool = True, geometry: bool = True, degenerate: bool = True) -> Column:
    """First reason for which a predicted quad fails, or null; the flags switch groups of reasons off."""
    beyond = F.exists(q, lambda p: (p["x"] < 0) | (p["x"] > w - 1) | (p["y"] < 0) | (p["y"] > h - 1))
    tests = [F.when(q.isNull(), "missing")]
    if bounds:
        tests.append(F.when(beyond, "oob"))
    if geometry:
        tests += [F.when(G.crosses_itself(q), "self_intersecting"), F.when(~G.is_convex(q), "non_convex")]
    if degenerate:
        tests += [F.when(G.area(q) < min_area * w * h, "degenerate_area"), F.when((G.area(q) < 100.0) | (G.shortest_edge(q) < 5.0), "degenerate")]
    return F.coalesce(*tests)


def corner_results(samples: DataFrame, min_area: float = 0.05, cells: int = 256) -> DataFrame:
    """name, model, reason, iou, mae, mae_rel of samples (name, model, predicted, truth, w, h)."""
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    mae = G.mean_distance(F.col("predicted"), F.col("truth"))
    return samples.select("name", "model", failure(F.col("predicted"), w, h, min_area).alias("reason"), G.raster_iou(F.col("predicted"), F.col("truth"), w, h, cells).alias("iou"), mae.alias("mae"), (mae / F.sqrt(w * w + h * h)).alias("mae_rel"))


def summary(results: DataFrame, iou_at: float = 0.9, mae_at: float = 8.0) -> DataFrame:
    """For each model: n, fail rate, and mean, median and share within the bound of both measures, over what didn't fail."""
    ok = F.col("reason").isNull()
    of = lambda c: F.when(ok, F.col(c))
    return results.groupBy("model").agg(
        F.count("*").alias("n"), F.avg((~ok).cast("int")).alias("fail_rate"), F.avg(of("iou")).alias("iou_mean"), F.median(of("iou")).alias("iou_median"),
        F.avg((of("iou") >= iou_at).cast("int")).alias("iou_share"), F.avg(of("mae")).alias("mae_mean"), F.median(of("mae")).alias("mae_median"), F.avg((of("mae") <= mae_at).cast("int")).alias("mae_share"),
    )


def reasons(results: DataFrame) -> DataFrame:
    return results.where("reason IS NOT NULL").groupBy("model", "reason").count()


#: How much better a model's overlap and its error in pixels must be to count.
IOU_MARGIN, MAE_MARGIN = 0.01, 0.5


def compare(results: DataFrame, a: str, b: str) -> DataFrame:
    """Wins of each model on common samples: one that fails loses to one that doesn't; of two that don't, the better overlap and the smaller error give a point each."""
    x, y = (results.where(F.col("model") == m).select("name", F.col("reason").isNull().alias(f"ok_{k}"), F.col("iou").alias(f"iou_{k}"), F.col("mae").alias(f"mae_{k}")) for k, m in (("a", a), ("b", b)))

    def score(p: str, q: str) -> Column:
        iou = F.when(F.col(f"iou_{p}") > F.col(f"iou_{q}") + IOU_MARGIN, 1).otherwise(0)
        mae = F.when(F.col(f"mae_{p}") < F.col(f"mae_{q}") - MAE_MARGIN, 1).otherwise(0)
        return F.when(F.col(f"ok_{p}") & F.col(f"ok_{q}"), iou + mae).when(F.col(f"ok_{p}"), 2).otherwise(0)

    winner = F.when(score("a", "b") > score("b", "a"), "a").when(score("b", "a") > score("a", "b"), "b").otherwise("tie")
    return x.join(y, "name").groupBy(winner.alias("winner")).agg(F.count("*").alias("n"))


def pairwise(results: DataFrame) -> DataFrame:
    """model_a, model_b, name, winner (a, b or tie) of every unordered pair of models on the samples that both have.

    One self-join on the sample, in which each pair meets once with the smaller model first; scored as in compare().
    """
    side = lambda k: results.select("name", F.col("model").alias(f"model_{k}"), F.col("reason").isNull().alias(f"ok_{k}"), F.col("iou").alias(f"iou_{k}"), F.col("mae").alias(f"mae_{k}"))
    met = side("a").join(side("b"), "name").where("model_a < model_b")

    def score(p: str, q: str) -> Column:
        iou = F.when(F.col(f"iou_{p}") > F.col(f"iou_{q}") + IOU_MARGIN, 1).otherwise(0)
        mae = F.when(F.col(f"mae_{p}") < F.col(f"mae_{q}") - MAE_MARGIN, 1).otherwise(0)
        return F.when(F.col(f"ok_{p}") & F.col(f"ok_{q}"), iou + mae).when(F.col(f"ok_{p}"), 2).otherwise(0)

    winner = F.when(score("a", "b") > score("b", "a"), "a").when(score("b", "a") > score("a", "b"), "b").otherwise("tie")
    return met.select("model_a", "model_b", "name", winner.alias("winner"))


def comparisons(results: DataFrame) -> DataFrame:
    """model_a, model_b, wins_a, wins_b, ties of every pair of models."""
    won = lambda w: F.count_if(F.col("winner") == w)
    return pairwise(results).groupBy("model_a", "model_b").agg(won("a").alias("wins_a"), won("b").alias("wins_b"), won("tie").alias("ties"))


def worse_cases(results: DataFrame) -> DataFrame:
    """model, other, name: the samples on which a model does worse than another, a row each."""
    lost = pairwise(results).where("winner <> 'tie'")
    first, second = F.col("winner") == "b", F.col("winner") == "a"
    model = F.when(first, F.col("model_a")).when(second, F.col("model_b"))
    return lost.select(model.alias("model"), F.when(first, F.col("model_b")).otherwise(F.col("model_a")).alias("other"), "name")


def write_report(results: DataFrame, path: str, meta: dict[str, object], iou_at: float = 0.9, mae_at: float = 8.0) -> None:
    """Writes the nested report: sections meta, models, samples, pairwise and worse_cases as JSON lines, partitioned by section.

    A model's and a pair's line are bounded; samples and worse cases are a line each, so nothing gathers in one task however many
    samples there are. Numbers are rounded half to even at six places; absent ones are left out.
    """
    spark = results.sparkSession
    six = lambda c: F.bround(c, 6)
    ok = F.col("reason").isNull()
    of = lambda c: F.when(ok, F.col(c))
    reason = results.where(~ok).groupBy("model", "reason").count().groupBy("model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "count")))).alias("by_reason"))
    models = results.groupBy("model").agg(
        F.count("*").alias("num_samples"),
        F.struct(F.count_if(~ok).alias("count"), six(F.avg((~ok).cast("int"))).alias("rate")).alias("fail_"),
        F.struct(six(F.avg(of("iou"))).alias("mean"), six(F.median(of("iou"))).alias("median"), six(F.avg((of("iou") >= iou_at).cast("int"))).alias("pct_ge_thresh")).alias("iou"),
        F.struct(six(F.avg(of("mae"))).alias("mean"), six(F.median(of("mae"))).alias("median"), six(F.avg((of("mae") <= mae_at).cast("int"))).alias("pct_le_max")).alias("corner_mae_px"),
        F.struct(six(F.avg(of("mae_rel"))).alias("mean"), six(F.median(of("mae_rel"))).alias("median")).alias("corner_mae_rel"),
    )
    models = models.join(reason, "model", "left").select(
        "model", "num_samples", F.struct("fail_.count", "fail_.rate", F.coalesce("by_reason", F.create_map().cast("map<string, bigint>")).alias("by_reason")).alias("fail"), "iou", "corner_mae_px", "corner_mae_rel"
    )
    samples = results.select("model", F.col("name").alias("image"), (~ok).alias("fail"), F.col("reason").alias("fail_reason"), six("iou").alias("iou"), six("mae").alias("corner_mae_px"))
    pairs = comparisons(results).select("model_a", "model_b", F.struct(F.col("wins_a").alias("a"), F.col("wins_b").alias("b")).alias("wins"), "ties")
    about = spark.range(1).select(F.lit(json.dumps(meta)).alias("value"), F.lit("meta").alias("section"))
    line = lambda df, section: df.select(F.to_json(F.struct(*df.columns)).alias("value"), F.lit(section).alias("section"))
    parts = [about, line(models, "models"), line(samples, "samples"), line(pairs, "pairwise"), line(worse_cases(results), "worse_cases")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out.write.mode("overwrite").partitionBy("section").text(path)


def deviation(a: DataFrame, b: DataFrame, key: str, values: str) -> DataFrame:
    """Largest and mean absolute difference of two models' output arrays, joined by key."""
    d = F.zip_with(F.col("a"), F.col("b"), lambda x, y: F.abs(x - y))
    met = a.select(key, F.col(values).alias("a")).join(b.select(key, F.col(values).alias("b")), key)
    return met.select(F.array_max(d).alias("most"), F.aggregate(d, F.lit(0.0), lambda s, x: s + x).alias("sum"), F.size(d).alias("n")).agg(F.max("most").alias("largest"), (F.sum("sum") / F.sum("n")).alias("mean"), F.count("*").alias("rows"))
