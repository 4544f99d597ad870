"""Language-model scores from a hashed maximum-entropy model.

The probability of a token is a product of softmaxes along its path in a tree of classes of at most 32 members:
two levels for the most frequent tokens, three for the next, and up to three for all others, which lie in leaves by
their hash. Each softmax has the logits of its unigram masses plus the weights of hashed context features: the token
before (an n-gram), the last character before and, in the root's softmax, the token before the last (a skip).
Context and class together name a row of 32 weights. Within a leaf the smoothed unigram holds; a token that was never counted has the smoothed
unigram's share, so that the model is a distribution over any text and equals the unigram while all weights are zero.

Weights are trained by rounds of distributed gradient updates. The training documents of a round are dealt by hash
to shards of about SHARD tokens; each shard goes on from the common weights, and the changes are averaged row by
row, weighted by how often a shard used the row. Shards and the order within them depend on the rows alone, so
another cluster gives the same scores.

Counts cover all training documents. The most frequent tokens, `frequent` at most (a fixed bound), are broadcast with
their counts; all rarer ones meet their counts in a join. Rows of weights grow with the training tokens to 2^MOST_BITS, and
leaves with the counted tokens to 4 * 32^2; these are bounds of a task's memory. Beyond them contexts and tokens share.

Null text counts as empty: one token, the end. Documents of fold 1 (crc32 of the id as text, modulo 5) are held
out; a null id counts as empty text. Rows that repeat are kept. Other columns are ignored. With no training
document the unigram is that of an empty corpus (N and V are zero).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import discard, shuffle_width, stored

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The end of a text as a token; no word holds white space.
END = b"\n"
#: Tokens that are worked on together, tokens of an update, entries of a task's counter: these bound memory. Tokens of a training shard, about.
BLOCK, UPDATE, COUNTER, SHARD = 250_000, 8_192, 400_000, 8_000_000
#: Members of a class; the root's children that hold frequent tokens (one more level), medium ones (two more) and all others.
WIDTH, SHORT, MEDIUM, LONG = 32, 16, 12, 4
N_SHORT, N_MEDIUM = SHORT * WIDTH, MEDIUM * WIDTH * WIDTH
#: Bits of the number of rows, least and most. Rows that travel together. Bits of a token's hash.
LEAST_BITS, MOST_BITS, PACK, HASH = 12, 18, 1 << 11, 22
#: Features of the root's softmax, and of all others.
FEATURES, DEEP = 3, 2
NEVER = -40.0
ONES = np.ones(WIDTH, np.float32)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


class Codes(dict):
    """Token to code: 1 and up by frequency; any other token gets a code above all of these, of its hash and its last byte."""

    def __init__(self, tokens: list[bytes]):
        super().__init__((w, k + 1) for k, w in enumerate(tokens))
        self.top = len(tokens)
        self.last_bytes = np.array([0, *(w[-1] for w in tokens)], np.int64)
        self.hashes = np.array([0, *(crc32(w) & ((1 << HASH) - 1) for w in tokens)], np.int64)

    def __missing__(self, token: bytes) -> int:
        return self.top + 1 + ((crc32(token) & ((1 << HASH) - 1)) << 8 | token[-1])

    def parts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and last byte of each code's token."""
        known = np.minimum(codes, self.top)
        rest = np.maximum(codes - self.top - 1, 0)
        return np.where(codes > self.top, rest >> 8, self.hashes[known]), np.where(codes > self.top, rest & 255, self.last_bytes[known])

    def __reduce__(self):
        return Codes, (list(self),)


class Model:
    """Unigram masses as logits of each class (node), and the rows of weights."""

    def __init__(self, counts: np.ndarray, total: int, distinct: int, leaves: np.ndarray | None = None, rows: int | None = None):
        """counts: of the most frequent tokens, in the order of their codes. leaves: masses (c + 0.5) of the leaves of all others."""
        self.total, self.head = int(total), min(len(counts), N_SHORT + N_MEDIUM)
        self.mass = total + 0.5 * (distinct + 1)
        own = np.zeros(N_SHORT + N_MEDIUM)
        own[: self.head] = np.asarray(counts[: self.head], np.float64) + 0.5
        leaves = np.zeros(LONG) if leaves is None else leaves
        self.levels = 0
        while LONG * WIDTH**self.levels < len(leaves):
            self.levels += 1
        self.leaf_logs = np.log(np.maximum(leaves, 0.5))
        # nodes: root; short classes; medium classes and theirs; long classes and theirs
        levels = [own[:N_SHORT].reshape(SHORT, WIDTH), own[N_SHORT:].reshape(-1, WIDTH)]
        levels.insert(1, levels[1].sum(axis=1).reshape(MEDIUM, WIDTH))
        tail = [leaves]
        while len(tail[0]) > LONG:
            tail.insert(0, tail[0].reshape(-1, WIDTH).sum(axis=1))
        root = np.concatenate([levels[0].sum(axis=1), levels[1].sum(axis=1), tail[0]])
        nodes = [root[None], *levels, *(t.reshape(-1, WIDTH) for t in tail[1:])]
        self.first = np.cumsum([0, *map(len, nodes)])
        with np.errstate(divide="ignore", invalid="ignore"):
            self.bias = np.concatenate([np.log(n / n.sum(axis=1, keepdims=True)) for n in nodes])
        self.bias = np.maximum(np.nan_to_num(self.bias, nan=NEVER, neginf=NEVER), NEVER).astype(np.float32)
        self.counted = float(np.log((self.mass - 0.5) / self.mass)) if distinct else 0.0
        self.bits = rows.bit_length() - 1 if rows else min(max(LEAST_BITS, int(total // 16).bit_length()), MOST_BITS)
        self.weights = np.zeros((1 << self.bits, WIDTH), np.float32)

    @staticmethod
    def leaf_count(head: int, distinct: int) -> int:
        """Leaves for the tokens beyond the head: about one each."""
        n = LONG
        while n < distinct - head and n < LONG * WIDTH**2:
            n *= WIDTH
        return n

    @staticmethod
    def leaf_of(hashes: np.ndarray, leaves: int) -> np.ndarray:
        return hashes >> (HASH - (leaves.bit_length() - 1))

    def contexts(self, codes: np.ndarray, starts: np.ndarray, last_bytes: np.ndarray) -> np.ndarray:
        """(FEATURES, tokens): hashes of each token's context features."""

        def before(x: np.ndarray) -> np.ndarray:
            out = np.empty(len(x), np.int64)
            out[1:], out[0] = x[:-1], 0
            out[starts] = 0
            return out

        one = before(codes)
        mixed = np.stack([one, before(last_bytes), before(one)]).astype(np.uint64)
        salt = np.arange(1, FEATURES + 1, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed + salt) * np.uint64(0x9E3779B97F4A7C15)
        return mixed ^ (mixed >> np.uint64(29))

    def path(self, codes: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray | slice, np.ndarray, np.ndarray]]:
        """For each level: the tokens whose path has it, their node and which member of it they take."""
        short, medium = (codes >= 1) & (codes <= min(self.head, N_SHORT)), (codes > N_SHORT) & (codes <= self.head)
        leaf = self.leaf_of(hashes, len(self.leaf_logs))
        rank = codes - 1
        place = np.where(medium, rank - N_SHORT, 0)
        depth = WIDTH**self.levels
        yield slice(None), np.zeros(len(codes), np.int64), np.where(short, rank // WIDTH, np.where(medium, SHORT + place // WIDTH**2, SHORT + MEDIUM + leaf // depth))
        some = np.flatnonzero(short | medium) if not self.levels else slice(None)
        below = depth // WIDTH if self.levels else 1
        node = np.where(short, self.first[1] + rank // WIDTH, np.where(medium, self.first[2] + place // WIDTH**2, self.first[4 if self.levels else 0] + leaf // depth))
        yield some, node[some], np.where(short, rank % WIDTH, np.where(medium, place // WIDTH % WIDTH, leaf // below % WIDTH))[some]
        own = np.flatnonzero(medium)
        yield own, self.first[3] + place[own] // WIDTH, place[own] % WIDTH
        own = np.flatnonzero(~(short | medium))
        for k in range(1, self.levels):
            depth, below = below, below // WIDTH
            yield own, self.first[4 + k] + leaf[own] // depth, leaf[own] // below % WIDTH

    def rows(self, contexts: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Rows of weights of tokens that are all at the root (node 0) or all below it."""
        contexts = contexts[:DEEP] if len(node) and node[0] else contexts
        mixed = (contexts ^ (node.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def exponentials(self, rows: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, their exponentials and the sums of these."""
        logits = self.bias.take(node, axis=0, mode="clip")
        part = np.empty_like(logits)
        for r in rows:
            logits += self.weights.take(r, axis=0, out=part, mode="clip")
        np.minimum(logits, 60, out=logits)
        np.exp(logits, out=part)
        return logits, part, np.maximum(part @ ONES, 1e-30)

    def logs(self, codes: np.ndarray, hashes: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Natural log-probability of each token, for the long ones that of their leaf over its mass. All taken as counted."""
        out = np.full(len(codes), self.counted)
        for k in range(0, len(codes), UPDATE):
            part = slice(k, k + UPDATE)
            sums = out[part]
            for own, node, member in self.path(codes[part], hashes[part]):
                logits, _, total = self.exponentials(self.rows(contexts[:, part][:, own], node), node)
                sums[own] += logits[np.arange(len(node)), member] - np.log(total)
        long = (codes > self.head) | (codes < 1)
        out[long] -= self.leaf_logs[self.leaf_of(hashes[long], len(self.leaf_logs))]
        return out


class Updates:
    """A shard's gradient updates (Adagrad with one square a row) of a copy of the common weights."""

    def __init__(self, model: Model, rate: float):
        self.model, self.rate, self.common = model, rate, model.weights
        model.weights = model.weights.copy()
        self.squares, self.used = np.full(len(model.weights), 1.0, np.float32), np.zeros(len(model.weights), np.int64)

    def learn(self, codes: np.ndarray, starts: np.ndarray, hashes: np.ndarray, last_bytes: np.ndarray) -> None:
        m = self.model
        contexts = m.contexts(codes, starts, last_bytes)
        for k in range(0, len(codes), UPDATE):
            part = slice(k, k + UPDATE)
            for own, node, member in m.path(codes[part], hashes[part]):
                n = len(node)
                if not n:
                    continue
                rows = m.rows(contexts[:, part][:, own], node)
                _, grad, total = m.exponentials(rows, node)
                grad /= total[:, None]
                grad[np.arange(n), member] -= 1
                # rows and their tokens in order, as one number each
                places = np.sort((rows << 16 | np.arange(n)).ravel())
                rows, token = places >> 16, places & 0xFFFF
                heads = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                uses = np.diff(np.append(heads, len(rows)))
                once = uses == 1
                self._apply(rows[heads[once]], grad.take(token[heads[once]], axis=0, mode="clip"), 1)
                if not once.all():
                    shared = uses[~once]
                    step = np.add.reduceat(grad.take(token[np.repeat(~once, uses)], axis=0, mode="clip"), np.cumsum(shared) - shared, axis=0)
                    self._apply(rows[heads[~once]], step / np.sqrt(shared)[:, None].astype(np.float32), shared)

    def _apply(self, rows: np.ndarray, step: np.ndarray, uses: np.ndarray | int) -> None:
        squares = self.squares[rows] + np.einsum("ij,ij->i", step, step)
        self.squares[rows] = squares
        step *= (self.rate / np.sqrt(squares))[:, None]
        self.model.weights[rows] = self.model.weights.take(rows, axis=0, mode="clip") - step
        self.used[rows] += uses

    def changes(self) -> Iterator[tuple[int, bytes]]:
        """(pack, its rows' uses and changes) for each pack that was used."""
        for k in range(0, len(self.used), PACK):
            part = slice(k, k + PACK)
            if self.used[part].any():
                yield k // PACK, self.used[part].astype(np.float32).tobytes() + (self.model.weights[part] - self.common[part]).astype(np.float16).tobytes()


def encoded(batches: Iterator[pa.RecordBatch], codes: Codes) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray, np.ndarray]]:
    """Slices of the batches of about BLOCK tokens: the tokens of all texts (the last column), their codes and where each text ends."""
    get = codes.__getitem__
    for b in batches:
        flat: list[bytes] = []
        ends: list[int] = []
        begin = 0
        for k, text in enumerate(b.column(b.num_columns - 1)):
            flat += text.as_py().translate(LOWER).split()
            flat.append(END)
            ends.append(len(flat))
            if len(flat) >= BLOCK or k == b.num_rows - 1:
                yield b.slice(begin, k + 1 - begin), flat, np.fromiter(map(get, flat), np.int32, len(flat)), np.array(ends)
                flat, ends, begin = [], [], k + 1


def counts(training: DataFrame) -> DataFrame:
    """token (binary), c: counts over all texts (binary column text), ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["token", "c"])

        for b in batches:
            for text in b.column(0):
                found.update(text.as_py().translate(LOWER).split())
                if len(found) > COUNTER:
                    yield out()
                    found.clear()
            found[END] += b.num_rows
        if found:
            yield out()

    return training.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def most_frequent(vocabulary: DataFrame, frequent: int) -> tuple[Codes, np.ndarray]:
    """Codes and counts of the tokens above the least count that no more than `frequent` tokens exceed.

    The counts' histogram (a few rows to the power of two) gives that count, so nothing is sorted as a whole.
    """
    step = F.floor(F.log2(F.col("c")) * 32)
    left, cut = frequent, None
    for r in sorted(vocabulary.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        left -= r["count"]
        if left < 0:
            break
        cut = r["step"]
    top = vocabulary.where(step >= cut if cut is not None else F.lit(False)).toArrow()
    found = top["c"].to_numpy()
    tokens = top["token"].to_pylist()
    order = sorted(range(len(tokens)), key=lambda k: (-found[k], tokens[k]))
    return Codes([tokens[k] for k in order]), found[order]


def train(training: DataFrame, codes: Codes, model: Model, rounds: int, rate: float, shard: int = SHARD) -> Model:
    """Distributed gradient updates; the rounds divide the documents (columns h: a hash, codes: int32 array as binary) among them."""
    spark = training.sparkSession
    shards = max(1, -(-model.total // (rounds * shard)))
    deal = F.pmod(F.col("h"), F.lit(rounds * shards))

    def blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, n = [], 0
        for t in texts:
            held.append(np.frombuffer(t, np.int32))
            n += len(held[-1])
            if n >= BLOCK:
                yield _joined(held)
                held, n = [], 0
        if held:
            yield _joined(held)

    for k in range(rounds):
        shared = spark.sparkContext.broadcast((codes, model))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own_codes, own_model = shared.value
            common, updates, last = own_model.weights, None, None

            def done() -> Iterator[pa.RecordBatch]:
                for pack, data in updates.changes():
                    yield pa.RecordBatch.from_arrays([pa.array([pack], pa.int32()), pa.array([last], pa.int64()), pa.array([data], pa.binary())], names=["pack", "shard", "data"])

            for b in batches:
                if not b.num_rows:
                    continue
                names = b.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), b.num_rows]
                for s, e in zip(edges, edges[1:], strict=False):
                    if names[s] != last:
                        if updates:
                            yield from done()
                        own_model.weights = common
                        updates, last = Updates(own_model, rate), int(names[s])
                    for numbers, starts in blocks(b.column(1).slice(s, e - s).to_pylist()):
                        updates.learn(numbers, starts, *own_codes.parts(numbers))
            if updates:
                yield from done()
                own_model.weights = common

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list[np.ndarray]] = {}
            for b in batches:
                for pack, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                    used = np.frombuffer(data, np.float32, PACK).astype(np.float64)
                    change = np.frombuffer(data, np.float16, offset=4 * PACK).reshape(PACK, WIDTH) * used[:, None]
                    if pack in sums:
                        sums[pack][0] += used
                        sums[pack][1] += change
                    else:
                        sums[pack] = [used, change]
            for pack, (used, change) in sums.items():
                data = (change / np.maximum(used, 1)[:, None]).astype(np.float32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([pack], pa.int32()), pa.array([data], pa.binary())], names=["pack", "data"])

        # so many partitions that few shards meet in one
        dealt = training.where(deal % rounds == k).select(F.floor(deal / rounds).alias("shard"), "codes", "h")
        changes = dealt.repartition(shards * 8 if shards < 64 else shards, "shard").sortWithinPartitions("shard", "h", "codes").select("shard", "codes").mapInArrow(learn, "pack int, shard long, data binary")
        packs = len(model.weights) // PACK
        found = changes.repartition(min(shuffle_width(spark), packs), "pack").sortWithinPartitions("pack", "shard").mapInArrow(merge, "pack int, data binary").collect()
        for r in found:
            model.weights[r["pack"] * PACK : (r["pack"] + 1) * PACK] += np.frombuffer(bytes(r["data"]), np.float32).reshape(PACK, WIDTH)
        shared.destroy()
        del found
    return model


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, and where each text starts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.concatenate(texts).astype(np.int64), np.cumsum(sizes) - sizes


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = 150_000, rounds: int = 2, rate: float = 1.0, shard: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.xxhash64(id_col, text).alias("h"), text)
    vocabulary = stored(counts(rows.where("NOT held_out")), "vocabulary")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    codes, top_counts = most_frequent(vocabulary, frequent)
    head = min(len(top_counts), N_SHORT + N_MEDIUM)
    leaves = np.zeros(Model.leaf_count(head, distinct))
    leaf = F.shiftright(F.crc32("token").bitwiseAND(F.lit((1 << HASH) - 1)), HASH - (len(leaves).bit_length() - 1)).alias("leaf")
    found = vocabulary.groupBy(leaf).agg(F.sum(F.col("c") + 0.5).alias("mass")).toArrow()
    leaves[found["leaf"].to_numpy()] = found["mass"].to_numpy()
    np.subtract.at(leaves, Model.leaf_of(codes.hashes[1 : head + 1], len(leaves)), top_counts[:head] + 0.5)
    names = spark.sparkContext.broadcast(codes)
    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = names.value
        for b, tokens, numbers, ends in encoded(batches, own):
            places = np.flatnonzero(numbers > own.top)
            offsets = lambda x: np.append(0, x).astype(np.int32)
            texts = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets(ends * 4).tobytes()), pa.py_buffer(numbers.tobytes())])
            rare = pa.ListArray.from_arrays(pa.array(offsets(np.searchsorted(places, ends))), pa.array([tokens[p] for p in places.tolist()], pa.binary()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], texts, rare], names=["id", "held_out", "h", "codes", "rare"])

    texts = stored(rows.mapInArrow(encode, f"id {id_type}, held_out boolean, h long, codes binary, rare array<binary>"), "codes")
    names.destroy()
    model = train(texts.where("NOT held_out").select("h", "codes"), codes, Model(top_counts, total, distinct, leaves), rounds, rate, shard)
    log_counts = np.append(np.nan, np.log10(top_counts + 0.5))
    shared = spark.sparkContext.broadcast((codes, model, log_counts))
    columns = ["id", "held_out", "n_tokens", "n_known", "logs", "model", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_codes, own_model, logs10 = shared.value
        for b in batches:
            sizes = np.array([len(c.as_buffer()) // 4 for c in b.column(2)], np.int64)
            cuts = np.searchsorted(np.cumsum(sizes), np.arange(BLOCK, int(sizes.sum()), BLOCK)) + 1
            edges = np.unique([0, *cuts.tolist(), b.num_rows]).tolist()
            for s, e in zip(edges, edges[1:], strict=False):
                part = b.slice(s, e - s)
                numbers, starts = _joined([np.frombuffer(c.as_buffer(), np.int32) for c in part.column(2)])
                n, doc = e - s, np.repeat(np.arange(e - s), sizes[s:e])
                known = numbers <= own_codes.top
                hashes, last = own_codes.parts(numbers)
                paths = own_model.logs(numbers, hashes, own_model.contexts(numbers, starts, last)) / np.log(10)
                logs = np.where(known, logs10[np.minimum(numbers, own_codes.top)], 0.0)
                # counted tokens beyond the head take their share of their leaf
                full = np.where(known, paths + np.where(numbers > own_model.head, logs, 0.0), 0.0)
                lists = part.column(3)
                flat = lists.flatten()
                ends = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
                rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([flat, pa.array(paths[~known].astype(np.float32))], names=["token", "path"]))
                sums = lambda x: pa.array(np.bincount(doc, x, n))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes[s:e]), pa.array(np.bincount(doc, known, n).astype(np.int64)), sums(logs), sums(full), rare], names=columns)

    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, logs double, model double, rare array<struct<token: binary, path: float>>"
    scored = stored(texts.select("id", "held_out", "codes", "rare").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    discard(texts)
    met = scored.select("row", F.inline("rare")).join(vocabulary, "token", "left")
    c = F.coalesce("c", F.lit(0))
    mass = float(model.mass)
    rare = met.groupBy("row").agg(F.sum(F.log10(c + 0.5)).alias("rare_logs"), F.sum(F.when(c > 0, F.log10(c + 0.5) + F.col("path")).otherwise(F.lit(float(np.log10(0.5 / mass))))).alias("rare_paths"), F.count_if(c > 0).alias("rare_known"))
    zero = lambda name: F.coalesce(name, F.lit(0))
    return scored.drop("rare").join(rare, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("rare_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + zero("rare_logs") - F.col("n_tokens") * F.lit(float(np.log10(mass)))).alias("base_score"),
        (F.col("model") + zero("rare_paths")).alias("score"),
    )
