"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the nearest
vertex of the cross-polytope, that is its largest coordinate and that one's sign. A table's bucket is named by
several such hashes. Besides its own bucket a vector visits some more, those of the next nearest vertices.
Visitors and residents of a bucket are compared by cosine in double precision. A pair counts in the first table,
and there in the lower of the two buckets, in which it meets, so that links are counted where they are found
and never gathered as pairs. A bucket of more than TILE rows is cut into slices that meet two by two.

Equal vectors are one node. Vectors that are null, zero or hold null or non-finite components link with
nothing; vectors of different length don't either. Rows that repeat are kept, and are each other's links unless
they link with nothing. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import shuffle_width, spread_join, stored
from vellum.llm.components import components

#: Rows of a bucket that meet in one step; rows compared with these at once.
TILE, CHUNK = 4_096, 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    half = 1
    while half < d:
        y = x.reshape(n, d // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        half *= 2
    return x / np.sqrt(d)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """The rows in double precision, scaled to length 1."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codes(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """(rows, tables, 1 + probes): the own bucket of each vector in each table, and the next ones that it visits."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    padded = np.zeros((len(x), d))
    padded[:, : x.shape[1]] = x
    rng = np.random.default_rng([seed, d])
    out = np.empty((len(x), tables, 1 + probes), np.int32)
    rows = np.arange(len(x))
    depth = min(2, 2 * d)
    for t in range(tables):
        own, other, cost = [], [], []
        for _ in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            both = np.concatenate([y, -y], axis=1)
            top = np.argpartition(-both, depth, axis=1)[:, : depth + 1] if 2 * d > depth + 1 else np.argsort(-both, axis=1)[:, : depth + 1]
            order = np.argsort(-np.take_along_axis(both, top, 1), axis=1, kind="stable")
            top = np.take_along_axis(top, order, 1)
            near = np.take_along_axis(both, top, 1)
            own.append(top[:, 0])
            for k in range(1, top.shape[1]):
                other.append((len(own) - 1, top[:, k]))
                cost.append(near[:, 0] - near[:, k])
        name = lambda parts: sum(p.astype(np.int64) * (2 * d) ** k for k, p in enumerate(parts))
        out[:, t, 0] = _fold(name(own))
        rank = np.argsort(np.stack(cost, axis=1), axis=1, kind="stable")
        swapped = np.stack([_fold(name([c if k == j else o for k, o in enumerate(own)])) for j, c in other], axis=1)
        for p in range(probes):
            out[:, t, 1 + p] = swapped[rows, rank[:, min(p, rank.shape[1] - 1)]]
    return out


def _fold(x: np.ndarray) -> np.ndarray:
    """64-bit numbers to 31 bits."""
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int32)


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the components (labels: least member) of each a and b, in place."""
    while True:
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            return
        np.minimum.at(labels, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while not np.array_equal(labels, labels[labels]):
            labels[:] = labels[labels]


def _meet(unit: np.ndarray, code: np.ndarray, slot: np.ndarray, table: int, bucket: int, weight: np.ndarray, least: float, slices: np.ndarray, cross: bool):
    """Links first found in this bucket: weights of each row's partners, and a label of each row's component.

    slot: 0 for a resident, else the row is a visitor. cross: only rows of different slices meet.
    """
    n, total, labels = len(unit), np.zeros(len(unit), np.int64), np.arange(len(unit))
    home = np.flatnonzero(slot == 0)
    for k in range(0, n, CHUNK):
        i, j = np.nonzero(unit[k : k + CHUNK] @ unit[home].T >= least)
        i, j = i + k, home[j]
        keep = (i != j) & ((slot[i] > 0) | (i < j))
        if cross:
            keep &= slices[i] != slices[j]
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        first = np.ones(len(i), bool)
        for t in range(table + 1):
            i_at_j = (code[i, t] == code[j, t, :1]).any(axis=1)
            j_at_i = (code[j, t] == code[i, t, :1]).any(axis=1)
            if t < table:
                first &= ~(i_at_j | j_at_i)
            else:  # met in both own buckets: the lower one counts
                first &= ~(i_at_j & j_at_i & (code[i, t, 0] < bucket))
        i, j = i[first], j[first]
        total += np.bincount(i, weight[j], n).astype(np.int64) + np.bincount(j, weight[i], n).astype(np.int64)
        _join(labels, i, j)
    return total, labels


def near_duplicates(
    df: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 8, hashes: int | None = None, probes: int = 2, seed: int = 5, tile: int = TILE
) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    hashes: cross-polytope hashes in a bucket's name; by default 2, and one more for each 256-fold of the rows
    beyond some millions, with 1.7 times the tables.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.expr("v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    nodes = stored(rows.where("good").groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    if hashes is None:
        count = nodes.count()
        hashes = 2 + max(0, (count // 4_000_000).bit_length() + 7) // 8
        tables = round(tables * 1.7 ** (hashes - 2))
    element = df.schema[vector_col].dataType.elementType
    packed_type = "<f4" if isinstance(element, T.FloatType) else "<f8"
    entry = "node long, n long, slot int, tab int, bucket int, size int, v binary, code binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                for part in np.array_split(own, -(-len(own) // 2_000)):
                    raw = flat[starts[part][:, None] + np.arange(d)]
                    code = codes(unit_rows(raw), tables, hashes, probes, seed)
                    vectors, packed = [r.tobytes() for r in raw.astype(packed_type)], [r.tobytes() for r in code]
                    m, per = len(part), tables * (1 + probes)
                    again = np.repeat(np.arange(m), per)
                    # a probe may lead to the own bucket again, or twice to one
                    seen = code.reshape(m * tables, 1 + probes)
                    fresh = np.ones_like(seen, bool)
                    for k in range(1, 1 + probes):
                        fresh[:, k] = ~(seen[:, :k] == seen[:, k : k + 1]).any(axis=1)
                    keep = np.flatnonzero(fresh.ravel())
                    again = again[keep]
                    node, n = b.column("node").to_numpy()[part], b.column("n").to_numpy()[part]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(node[again]), pa.array(n[again]), pa.array((keep % (1 + probes)).astype(np.int32)), pa.array(((keep // (1 + probes)) % tables).astype(np.int32)),
                            pa.array(code.ravel()[keep]), pa.array(np.full(len(keep), d, np.int32)), pa.array([vectors[k] for k in again], pa.binary()), pa.array([packed[k] for k in again], pa.binary()),
                        ],
                        names=["node", "n", "slot", "tab", "bucket", "size", "v", "code"],
                    )

    dealt = nodes.select("node", "n", "v").mapInArrow(deal, entry)
    keys = ["tab", "bucket", "size"]
    # written, so that Spark knows its size: few keys, joined without shuffling the other side while they stay few
    large = stored(dealt.groupBy(*keys).count().where(F.col("count") > tile).select(*keys, F.expr(f"cast(ceil(count / {tile}) AS int)").alias("slices")), "large-buckets")
    sliced = dealt.join(large, keys, "left").withColumn("own", F.expr("cast(pmod(xxhash64(node, 3), coalesce(slices, 1)) AS int)"))
    pairs = F.expr("CASE WHEN slices IS NULL THEN array(-1L) ELSE transform(sequence(0, slices - 1), t -> least(t, own) * 1000000L + greatest(t, own)) END")
    tiles = sliced.withColumn("pair", F.explode(pairs)).drop("slices")
    by = [*keys, "pair"]
    shape = (tables, 1 + probes)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(key, parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            t = pa.Table.from_batches(parts)
            slot = t["slot"].to_numpy()
            if len(slot) < 2 or not (slot == 0).any():
                return None
            unit = unit_rows(np.frombuffer(b"".join(t["v"].to_pylist()), packed_type).reshape(len(slot), -1))
            code = np.frombuffer(b"".join(t["code"].to_pylist()), np.int32).reshape(len(slot), *shape)
            node, slices, pair = t["node"].to_numpy(), t["own"].to_numpy(), key[3]
            total, labels = _meet(unit, code, slot, key[0], key[1], t["n"].to_numpy(), least, slices, pair >= 0 and pair // 1_000_000 != pair % 1_000_000)
            some = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[labels[some]]), pa.array(total[some])], names=["a", "b", "n"]) if len(some) else None

        key, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(k).to_numpy(zero_copy_only=False) for k in by]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            edges = [0, *cuts.tolist(), b.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                now = tuple(int(c[s]) for c in columns)
                if now != key and held:
                    if (out := met(key, held)) is not None:
                        yield out
                    held = []
                key = now
                held.append(b.slice(s, e - s))
        if held and (out := met(key, held)) is not None:
            yield out

    found = tiles.repartition(shuffle_width(spark), *by).sortWithinPartitions(*by).mapInArrow(compare, "a long, b long, n long")
    found = stored(found, "vector-links")
    label = components(found.select("a", "b"))
    counts = found.groupBy("a").agg(F.sum("n").alias("more"))
    named = nodes.join(counts, nodes["node"] == counts["a"], "left").join(label.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left")
    named = named.select("v", "least", "n", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("label", "node").alias("label"))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = stored(named.join(ids, "label").select("v", "n", "n_links", "component_id"), "vector-components")
    good_rows = rows.where("good").select("id", "v")
    linked = spread_join(good_rows, of, "v", "n", good_rows.count()).select("id", "n_links", "component_id")
    alone = rows.where("NOT good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    long = lambda c: F.col(c).cast(df.schema[id_col].dataType if not isinstance(df.schema[id_col].dataType, T.NullType) else "long")
    return out.select(long("id").alias(id_col), "n_links", long("component_id").alias("component_id"), F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
