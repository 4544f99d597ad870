"""SimHash near-duplicates, found with BK-trees.

Equal fingerprints are one node. Two fingerprints within the radius agree on some blocks of their bits, so
the nodes are dealt into shards by each choice of blocks and the bits there; each shard has its own BK-tree,
whose children are keyed by their integer Hamming distance to the parent, and a query follows only the edges
within the radius. The trees are built where their shard lies rather than broadcast: together they grow with
the input. A shard with more than SHARD nodes is cut into slices, and every pair of slices is a shard. A
shard gives a spanning star of each of its components, never all pairs.

Null text and text without words have fingerprint zero. Rows that repeat are kept. A null doc_id is no
component's id unless all ids in the component are null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import fresh, shuffle_width, spread_join, stored
from vellum.llm.components import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Nodes of a shard; nodes under a leaf of a tree; queries that go down a tree together; shingles hashed together.
SHARD, LEAF, QUERIES, SHINGLES = 16_384, 256, 512, 1 << 16


def fingerprint(text: bytes, size: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles: a bit is set if it is in over half of the shingles' XXH64."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.append(0, ends[:-1] + 1)
    size = min(size, len(words))
    begins, ends = begins[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(begins), SHINGLES):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(begins[k : k + SHINGLES], ends[k : k + SHINGLES], strict=True)], ">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(begins)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """id, fp: the fingerprint of each row, its 64 bits as a long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), size) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).mapInArrow(run, f"id {id_type}, fp long")


class BKTree:
    """BK-tree over distinct 64-bit codes, built and searched in numpy; nodes can be removed."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.present = codes, np.ones(len(codes), bool)
        self.root: list = []
        todo = [(np.arange(len(codes)), self.root)]
        while todo:
            own, node = todo.pop()
            if len(own) <= LEAF:
                node += [None, own, {}]
                continue
            far = np.bitwise_count(codes[own[1:]] ^ codes[own[0]])
            node += [own[0], None, {}]
            for d in np.unique(far).tolist():
                todo.append((own[1:][far == d], node[2].setdefault(d, [])))

    def search(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of present nodes within radius of each asked node, and which nodes these are (as a mask)."""
        hits, found = np.zeros(len(asked), np.int64), np.zeros(len(self.codes), bool)
        todo = [(self.root, np.arange(len(asked)))]
        while todo:
            (pivot, leaf, edges), q = todo.pop()
            if leaf is not None:
                own = leaf[self.present[leaf]]
                near = np.bitwise_count(self.codes[asked[q]][:, None] ^ self.codes[own][None, :]) <= radius
                hits[q] += near.sum(axis=1)
                found[own] |= near.any(axis=0)
                continue
            far = np.bitwise_count(self.codes[asked[q]] ^ self.codes[pivot]).astype(np.int64)
            if self.present[pivot]:
                hits[q] += far <= radius
                found[pivot] |= bool((far <= radius).any())
            for d, child in edges.items():
                go = q[np.abs(far - d) <= radius]
                if len(go):
                    todo.append((child, go))
        return hits, found

    def stars(self, radius: int) -> list[tuple[int, np.ndarray]]:
        """(centre, others) of each component with others. A component that is complete leaves the tree."""
        out = []
        for k in range(0, len(self.codes), QUERIES):
            asked = np.arange(k, min(k + QUERIES, len(self.codes)))
            asked = asked[self.present[asked]]
            if not len(asked):
                continue
            hits, _ = self.search(asked, radius)
            self.present[asked[hits == 1]] = False
            for seed in asked[hits > 1].tolist():
                if not self.present[seed]:
                    continue
                self.present[seed] = False
                members, front = [], np.array([seed])
                while len(front):
                    new = np.zeros(len(self.codes), bool)
                    for j in range(0, len(front), QUERIES):
                        new |= self.search(front[j : j + QUERIES], radius)[1]
                    front = np.flatnonzero(new)
                    self.present[front] = False
                    members.append(front)
                out.append((seed, np.concatenate(members)))
        return out


def _blocks(radius: int, agree: int) -> list[list[tuple[int, int]]]:
    """Choices of `agree` blocks of bits, as (shift, width): codes within radius agree on all blocks of some choice."""
    n = radius + agree
    cuts = [64 * k // n for k in range(n + 1)]
    return [list(c) for c in combinations([(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)], agree)]


def links(codes: DataFrame, radius: int = 4, agree: int | None = None, shard: int = SHARD) -> DataFrame:
    """a, b: spanning stars of the links among distinct codes (fp: long) within radius bits.

    agree: blocks that a shard's codes share; by default so many that shards have some thousands of codes.
    """
    if agree is None:
        n = codes.count()
        agree = next(k for k in (1, 2, 3, 4) if k == 4 or n >> (64 * k // (radius + k)) <= 4_096)
    choices = _blocks(radius, agree)
    bits = lambda choice: F.xxhash64(*(F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in choice))
    dealt = codes.select("fp", F.posexplode(F.array(*map(bits, choices))).alias("choice", "bits"))
    # written, so that Spark knows its size: few keys, joined without shuffling the other side while they stay few
    large = stored(dealt.groupBy("choice", "bits").count().where(F.col("count") > shard).select("choice", "bits", F.expr(f"cast(ceil(count / {shard}) AS int)").alias("slices")), "large-shards")
    sliced = dealt.join(large, ["choice", "bits"], "left").withColumn("own", F.expr("cast(pmod(xxhash64(fp, 11), coalesce(slices, 1)) AS int)"))
    pair = "transform(filter(sequence(0, slices - 1), t -> t <> own), t -> least(t, own) * 1000000L + greatest(t, own))"
    tiles = sliced.withColumn("pair", F.explode(F.expr(f"CASE WHEN slices IS NULL THEN array(-1L) ELSE {pair} END"))).select("choice", "bits", "pair", "fp")
    keys = ["choice", "bits", "pair"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(own: np.ndarray) -> pa.RecordBatch | None:
            if len(own) < 2:
                return None
            found = BKTree(own.view(np.uint64)).stars(radius)
            if not found:
                return None
            a = np.concatenate([np.full(len(m), own[c]) for c, m in found])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.concatenate([own[m] for _, m in found]))], names=["a", "b"])

        key, held = None, []
        for b in batches:
            columns = [b.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if not b.num_rows:
                continue
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1
            edges = [0, *cuts.tolist(), b.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                now = tuple(c[s] for c in columns[:3])
                if now != key and held:
                    if out := stars(np.concatenate(held)):
                        yield out
                    held = []
                key = now
                held.append(columns[3][s:e])
        if held and (out := stars(np.concatenate(held))):
            yield out

    return tiles.repartition(shuffle_width(codes.sparkSession), *keys).sortWithinPartitions(*keys, "fp").mapInArrow(run, "a long, b long").distinct()


def _labelled(docs: DataFrame, radius: int, size: int, id_col: str, text_col: str, options: dict) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of each row, and fp, least (doc_id), label (least fp of the component) of each fingerprint."""
    fps = stored(fingerprints(docs, id_col, text_col, size), "fingerprints")
    codes = stored(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "codes")
    label = components(links(codes.select("fp"), radius, **options))
    return fps, codes.join(label, codes["fp"] == label["node"], "left").select("fp", "least", "n", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, radius: int = 4, size: int = 4, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable) for each row."""
    fps, named = _labelled(docs, radius, size, id_col, text_col, options)
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = stored(named.join(least, "label").select("fp", "n", "component_id"), "components")
    return spread_join(fps, of, "fp", "n", fps.count()).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4, size: int = 4, id_col: str = "doc_id", text_col: str = "text", labelled: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None, **options) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the least doc_id stays (null last).

    labelled: gives other components, from rows (row, text), in place of those of the fingerprints. Rows that share that id: the one whose text has the least hash; of equal rows one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    id_, hash_ = fresh(docs, "__id", "__hash")
    tagged = docs.withColumns({id_: F.coalesce(F.col(id_col).cast("string"), F.lit("null")), hash_: F.xxhash64(text)})
    rows = tagged.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(hash_).alias("hash")).alias("row"), text.alias("text"))
    _, named = labelled(rows) if labelled else _labelled(rows, radius, size, "row", "text", options)
    first = named.groupBy("label").agg(F.min("least").alias("row"))
    stay = first.select(F.coalesce(F.col("row.id").cast("string"), F.lit("null")).alias(id_), F.col("row.hash").alias(hash_))
    out = tagged.join(stay, [id_, hash_], "left_semi")
    if tagged.groupBy(id_, hash_).count().where("count > 1").limit(1).count():
        out = out.dropDuplicates([id_, hash_])
    return out.drop(id_, hash_)
