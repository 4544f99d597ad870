"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words is trained with numpy from confirmed toxic documents and unlabelled
ones. Its risk is prior * R(toxic as 1) + max(0, R(unlabelled as 0) - prior * R(toxic as 0)): the share of
toxic text among the unlabelled is taken out of their risk, and where that would make it negative, the step
goes the other way. The prior is the share of toxic rows among the labelled training rows, or given: labelled
and unlabelled rows are taken to come from the same text.

Null text counts as empty and gets the score of the bias alone. Labels that are null are ignored; of several
labels of a document the highest counts. Without a toxic training row every score is 0. Rows that repeat are
kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a task remembers; only bounds memory.
REMEMBER = 500_000


def _table() -> bytes:
    """A-Z to lower case; ASCII bytes other than letters and digits to a space."""
    keep = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
    return bytes(b + 32 if 65 <= b <= 90 else b if b in keep else 32 for b in range(256))


TABLE = _table()


@dataclass
class Settings:
    """positives, unlabelled: most rows of the training sample, chosen by the hash of their ids.

    decay: squared weights cost so much, divided by the number of toxic rows.
    """

    positives: int = 4_000
    unlabelled: int = 12_000
    bits: int = 22
    least_positives: int = 3
    least_lift: float = 2.0
    deviations: float = 5.0
    steps: int = 1_000
    rate: float = 0.05
    decay: float = 0.12


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float
    mask: int

    def by_feature(self) -> dict[int, float]:
        return dict(zip(self.features.tolist(), self.weights.tolist(), strict=True))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 0 at division by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _unlike(sets: list[np.ndarray], least: float = 0.8, bands: int = 12, rows: int = 3) -> list[np.ndarray]:
    """The rows without near copies, which would pass for evidence: a row goes if its Jaccard similarity to one that stays is `least` or more.

    Bands of min-hashes only name the rows to compare (of pairs at 0.8 all but about 0.02 % meet); the sets decide.
    """
    odd = np.random.default_rng(11).integers(1, 1 << 63, bands * rows, np.uint64) | np.uint64(1)
    found: dict[tuple, list[int]] = {}
    kept: list[np.ndarray] = []
    for x in sets:
        if not len(x):
            kept.append(x)
            continue
        signature = ((x.astype(np.uint64) + np.uint64(1))[:, None] * odd).min(axis=0).reshape(bands, rows)
        keys = [(b, *signature[b].tolist()) for b in range(bands)]
        near = {k for key in keys for k in found.get(key, ())}
        shared = ((k, len(np.intersect1d(x, kept[k], assume_unique=True))) for k in near)
        if any(n >= least * (len(x) + len(kept[k]) - n) for k, n in shared):
            continue
        for key in keys:
            found.setdefault(key, []).append(len(kept))
        kept.append(x)
    return kept


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, s: Settings) -> Model:
    """Trains on rows of hashed features, one of each group of near copies."""
    positive, unlabelled = _unlike(positive), _unlike(unlabelled)
    n_p, n_u = len(positive), len(unlabelled)
    if not n_p or not n_u:
        return Model(np.empty(0, np.int64), np.empty(0), -40.0, (1 << s.bits) - 1)
    in_p, count_p = np.unique(np.concatenate(positive), return_counts=True)
    in_u, count_u = np.unique(np.concatenate(unlabelled), return_counts=True)
    at = np.minimum(np.searchsorted(in_u, in_p), max(0, len(in_u) - 1))
    share_u = np.where(in_u[at] == in_p, count_u[at], 0) / n_u if len(in_u) else np.zeros(len(in_p))
    # a word counts if it is in many more toxic rows than chance would put it there
    chance = np.maximum(share_u, 0.5 / n_u) * n_p
    used = in_p[(count_p >= s.least_positives) & (count_p >= s.least_lift * chance) & (count_p - chance >= s.deviations * np.sqrt(chance))]

    def rows(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        k = np.minimum(np.searchsorted(used, flat), max(0, len(used) - 1))
        ok = used[k] == flat if len(used) else np.zeros(len(flat), bool)
        return row[ok], k[ok]

    (row_p, col_p), (row_u, col_u) = rows(positive), rows(unlabelled)
    w, bias, m, v = np.zeros(len(used)), float(np.log(prior / (1 - prior))), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, s.steps + 1):
        out_p = bias + np.bincount(row_p, w[col_p], n_p)
        out_u = bias + np.bincount(row_u, w[col_u], n_u)
        soft_p, soft_u = _sigmoid(out_p), _sigmoid(out_u)
        # logistic loss: softplus(-x) as class 1, softplus(x) as class 0
        as_0 = np.logaddexp(0, out_u).mean() - prior * np.logaddexp(0, out_p).mean()
        grad_p, grad_u = -prior * (1 - soft_p) / n_p, np.zeros(n_u)
        if as_0 >= 0:
            grad_u = soft_u / n_u
            grad_p = grad_p - prior * soft_p / n_p
        else:
            grad_u = -soft_u / n_u
            grad_p = prior * soft_p / n_p
        g = np.append(np.bincount(col_p, grad_p[row_p], len(used)) + np.bincount(col_u, grad_u[row_u], len(used)) + s.decay / n_p * w, grad_p.sum() + grad_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(used, w, bias, (1 << s.bits) - 1)


def _features(df: DataFrame, mask: int, text: str) -> DataFrame:
    """The columns with text replaced by features: the distinct hashed words."""
    kept = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [sorted({crc32(w) & mask for w in t.as_py().translate(TABLE).split()}) for t in b.column(text)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sets, pa.list_(pa.int32()))], names=[*kept, "features"])

    types = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.mapInArrow(run, f"{types}, features array<int>")


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, prior: float | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on rows outside the held-out fold, at most settings.positives and settings.unlabelled of them."""
    s = settings or Settings()
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg((F.max(label_col) > 0).alias("toxic"))
    if prior is None:
        prior = known.agg(F.avg(F.col("toxic").cast("int"))).first()[0] or 0.0
    prior = min(max(prior, 1e-4), 0.9)
    order = F.xxhash64(id_col), F.col(id_col)
    toxic = known.where("toxic").select(id_col)
    sample = toxic.orderBy(*order).limit(s.positives).withColumn("positive", F.lit(True))
    rest = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(id_col).join(toxic, id_col, "left_anti").distinct()
    sample = sample.unionByName(rest.orderBy(*order).limit(s.unlabelled).withColumn("positive", F.lit(False)))
    # at most positives + unlabelled rows of one id each: bounded
    chosen = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text")).join(F.broadcast(sample), id_col)
    rows = _features(chosen, (1 << s.bits) - 1, "__text").groupBy(id_col, "positive").agg(F.min("features").alias("features")).orderBy(id_col).toArrow().combine_chunks()
    lists, flags = rows["features"].combine_chunks(), rows["positive"].to_numpy()
    sets = np.split(lists.flatten().to_numpy(), lists.offsets.to_numpy()[1:-1]) if len(lists) else []
    return fit([x for x, f in zip(sets, flags, strict=True) if f], [x for x, f in zip(sets, flags, strict=True) if not f], prior, s)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """The rows with out_col (0 to 1) added: the sigmoid of the summed weights of each text's distinct words."""
    shared = docs.sparkSession.sparkContext.broadcast((model.by_feature(), model.bias, model.mask))

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias, mask = shared.value
        known: dict[bytes, float] = {}
        for texts in batches:
            out = np.empty(len(texts))
            for k, t in enumerate(texts):
                total = bias
                if len(known) > REMEMBER:
                    known.clear()
                for w in set(bytes(t).translate(TABLE).split()):
                    x = known.get(w)
                    if x is None:
                        x = known[w] = weights.get(crc32(w) & mask, 0.0)
                    if x:
                        total += x
                out[k] = total
            yield pd.Series(_sigmoid(out))

    return docs.withColumn(out_col, toxicity(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def predictions(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    model = train(docs, labels, settings, id_col=id_col, text_col=text_col)
    scored = score(docs.select(id_col, text_col), model, text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
