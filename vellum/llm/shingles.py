"""Near-duplicates by SimHash fingerprints in BK-trees and the Jaccard similarity of word shingles, for the corpus pipeline.

Equal shingle sets are one node, with the SimHash of its shingles. Nodes are dealt into shards, the buckets of 16 bands of 4
min-hashes: a pair with a similarity of 0.8 meets with a probability of 0.9998, a closer one more surely. A shard has a
BK-tree of its fingerprints, as in simhash; of a pair of similarity 0.8 some 10 bits differ, and RADIUS is 4 standard deviations
and more above that. Nodes that no other is within the radius of end there. Of all others the sets themselves are compared, so that a
link is exact; a shard gives a spanning star of each of its components, never all pairs. A bucket with more than SHARD nodes is cut into
slices, and every pair of slices is a shard. Agreeing blocks of bits, as simhash has them, would not thin out at this radius.

A text of fewer words than a shingle has one shingle; null text and text without words have none and are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import simhash
from vellum.llm.common import shuffle_width, stored
from vellum.llm.components import components

BANDS, BAND, SHARD, SHINGLES, RADIUS = 16, 4, 1_024, 1 << 14, 26
_RANDOM = np.random.default_rng(20).integers(1, 1 << 63, (2, BANDS * BAND)).astype(np.uint64)
MASKS, FACTORS = _RANDOM[0], _RANDOM[1] | np.uint64(1)


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """The sorted XXH64 of the text's different word shingles."""
    words = text.translate(simhash.LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[k : k + size]), 42) for k in range(len(words) - size + 1)], np.uint64))


def fingerprint(own: np.ndarray) -> int:
    """SimHash of a shingle set: a bit is set if it is in over half of the shingles."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(own), SHINGLES):
        counts += np.unpackbits(own[k : k + SHINGLES].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(own)).tobytes(), "big")


def near(codes: np.ndarray, radius: int = RADIUS) -> list[np.ndarray]:
    """The places of each component with others, of the links of fingerprints within the radius, by a BK-tree."""
    found = simhash.BKTree(codes).stars(radius)
    return [np.sort(np.append(others, centre)) for centre, others in found]


def bands(own: np.ndarray) -> np.ndarray:
    """A hash of each band of min-hashes."""
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), SHINGLES):
        np.minimum(least, ((own[k : k + SHINGLES, None] ^ MASKS) * FACTORS).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, BAND))], np.uint64).view(np.int64)


def stars(sets: list[np.ndarray], similar: float = 0.8) -> list[tuple[int, np.ndarray]]:
    """(centre, others) of each component, with others, of the links of similar sets."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    at = np.searchsorted(flat, np.concatenate(sets))
    last = np.searchsorted(flat, np.concatenate(sets), "right")
    left, out = np.ones(len(sets), bool), []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed] = False
        front, members = [seed], []
        while front:
            one = front.pop()
            if not left.any():
                break
            span = slice(ends[one] - sizes[one], ends[one])
            shared = np.zeros(len(sets), np.int64)
            begin, n = at[span], last[span] - at[span]
            places = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shared += np.bincount(owner[places], minlength=len(sets))
            near = np.flatnonzero(left & (shared >= similar * (sizes + sizes[one] - shared) - 1e-9))
            left[near] = False
            members += near.tolist()
            front += near.tolist()
        if members:
            out.append((seed, np.array(members)))
    return out


def links(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], similar: float = 0.8, shard: int = SHARD) -> DataFrame:
    """a, b: spanning stars of the links among nodes (fp, code: SimHash, key: array of bands), whose sets (fp, set) sets() makes of those (fp) that are near another."""
    met = nodes.select("fp", "code", F.explode("key").alias("key"))
    buckets = met.groupBy("key").agg(F.count("*").alias("n"), F.expr("sum(cast(xxhash64(fp) AS decimal(38, 0)))").alias("who")).where("n > 1")
    buckets = stored(buckets.groupBy("n", "who").agg(F.min("key").alias("key")).select("key", F.expr(f"cast(ceil(n / {shard}) AS int)").alias("slices")), "buckets")
    sliced = met.join(buckets, "key").withColumn("own", F.expr("cast(pmod(xxhash64(fp, 11), slices) AS int)"))
    pair = "transform(filter(sequence(0, slices - 1), t -> t <> own), t -> least(t, own) * 1000000L + greatest(t, own))"
    tiles = sliced.select("key", F.explode(F.expr(f"CASE WHEN slices = 1 THEN array(-1L) ELSE {pair} END")).alias("pair"), "fp", "code")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each shard the nodes that a BK-tree links with another, with the place of their component."""

        def found(key: tuple, fps: list[int], codes: list[int]) -> Iterator[pa.RecordBatch]:
            own = np.array(fps, np.int64)
            for part, at in enumerate(near(np.array(codes, np.int64).view(np.uint64)) if len(fps) > 1 else []):
                columns = [np.full(len(at), x, np.int64) for x in (*key, part)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, own[at])], names=["key", "pair", "part", "fp"])

        key, fps, codes = None, [], []
        for b in batches:
            for k, p, fp, code in zip(*(b.column(j).to_pylist() for j in range(4)), strict=True):
                if (k, p) != key:
                    if key is not None:
                        yield from found(key, fps, codes)
                    key, fps, codes = (k, p), [], []
                fps.append(fp)
                codes.append(code)
        if key is not None:
            yield from found(key, fps, codes)

    width = shuffle_width(nodes.sparkSession)
    sharded = tiles.repartition(width, "key", "pair").sortWithinPartitions("key", "pair")
    tiles = stored(sharded.mapInArrow(candidates, "key long, pair long, part long, fp long"), "tiles")
    of = sets(tiles.select("fp").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(fps: list[int], own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(own) > 1 and (linked := stars(own, similar)):
                a = np.concatenate([np.full(len(m), fps[c], np.int64) for c, m in linked])
                b = np.concatenate([np.array(fps, np.int64)[m] for _, m in linked])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        key, fps, own = None, [], []
        for b in batches:
            for k, p, n, fp, data in zip(*(b.column(j).to_pylist() for j in range(4)), b.column(4), strict=True):
                if (k, p, n) != key:
                    yield from found(fps, own)
                    key, fps, own = (k, p, n), [], []
                fps.append(fp)
                own.append(np.frombuffer(data.as_buffer(), np.uint64))
        yield from found(fps, own)

    joined = tiles.join(of, "fp").select("key", "pair", "part", "fp", "set")
    return joined.repartition(width, "key", "pair", "part").sortWithinPartitions("key", "pair", "part").mapInArrow(run, "a long, b long").distinct()


def labelled(docs: DataFrame, size: int = 5, similar: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[DataFrame, DataFrame]:
    """(id, fp, key) of each row, and fp, least (id), label (least fp of the component) of each set."""
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    name = lambda own: xxhash.xxh64_intdigest(own.tobytes())
    signed = lambda found: pa.array(np.array(found, np.uint64).view(np.int64))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingle_set(t.as_py(), size) for t in b.column(1)]
            key = [bands(s).tolist() if len(s) else [] for s in own]
            codes = signed([fingerprint(s) for s in own])
            yield pa.RecordBatch.from_arrays([b.column(0), signed([name(s) for s in own]), codes, pa.array(key, pa.list_(pa.int64()))], names=["id", "fp", "code", "key"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingle_set(t.as_py(), size) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in own], pa.binary())], names=["fp", "set"])

    rows = stored(texts.mapInArrow(keys, f"id {id_type}, fp long, code long, key array<long>"), "shingle-keys")
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("least"), F.first("code").alias("code"), F.first("key").alias("key")), "shingle-nodes")

    def sets(of: DataFrame) -> DataFrame:
        least = nodes.join(of, "fp").select("fp", "least", F.xxhash64("least").alias("h"))
        found = texts.withColumn("h", F.xxhash64("id")).join(least, "h").where(F.col("id").eqNullSafe(F.col("least")))
        return found.select("fp", "text").dropDuplicates(["fp"]).mapInArrow(again, "fp long, set binary")

    label = components(links(nodes.select("fp", "code", "key"), sets, similar, **options))
    return rows, nodes.join(label, nodes["fp"] == label["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without near-duplicates; which row of a component stays is as in simhash.keep_one()."""
    return simhash.keep_one(docs, id_col=id_col, text_col=text_col, labelled=lambda rows: labelled(rows, id_col="row", **options))
