"""Benchmark decontamination with a stored positional inverted index of the documents.

The index is a table: for each shard of documents, about SHARD_WORDS words, and each term in it the sorted list of
the term's word positions in the shard. A search reads the lists of the benchmark's terms alone and brings those of a
shard together. A window of a benchmark item begins with the list of the term that is rarest in the shard, moved
back by the term's offset in the window, and is intersected with the lists of the other terms, rarest first, each
moved by its own offset. Proximity matches intersect the lists of an item's rarest terms within a number of words.

Only windows travel to the shards (as a broadcast of about BLOCK_WORDS words; a larger benchmark is searched in several
such blocks, one after the other, on the same index). Which terms are an item's rarest is found over all items.

Null text and text without words match nothing. Items without words have no windows; a null item_id counts
as the id "null"; items that repeat an id count as one. Rows that repeat are kept. Other columns are ignored, and
kept by clean() whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import fresh, shuffle_width, stored

#: Most words of the benchmark in one broadcast; words of a shard that are indexed together; candidates held at once.
BLOCK_WORDS, SHARD_WORDS, CANDIDATES = 500_000, 250_000, 2_000_000
#: Terms that no word can be: the ends of a shard's documents, and the numbers of their rows.
END, ROWS = b"\n", b"\r"


def _table() -> bytes:
    """A-Z to lower case; ASCII bytes that are in no word to a space."""
    keep = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
    return bytes(b + 32 if 65 <= b <= 90 else b if b in keep else 32 for b in range(256))


TABLE = _table()


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Windows:
    """The distinct windows of some benchmark items: term ids (-1 where a window is shorter) and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], width: int | None):
        self.vocab: dict[bytes, int] = {}
        at: dict[tuple[int, ...], set[int]] = {}
        self.items = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.items)}
        for name, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            for k in range(max(1, len(ids) - width + 1) if ids and width else 0):
                at.setdefault(tuple(ids[k : k + width]), set()).add(number[name])
        self.terms = np.full((len(at), width or 0), -1, np.int32)
        self.sizes = np.array([len(t) for t in at], np.int64)
        for k, t in enumerate(at):
            self.terms[k, : len(t)] = t
        self.owners = np.array([i for s in at.values() for i in sorted(s)], np.int64)
        self.owner_ends = np.cumsum([len(s) for s in at.values()], dtype=np.int64)


class Shard:
    """The posting lists of some terms (by number, from 1) in a shard of documents that end at the positions `ends`."""

    def __init__(self, lists: dict[int, np.ndarray], ends: np.ndarray, n_terms: int):
        self.ends, self.length = ends, int(ends[-1]) + 1
        order = sorted(lists)
        self.counts = np.zeros(n_terms + 1, np.int64)
        self.counts[order] = [len(lists[t]) for t in order]
        self.begin = np.cumsum(self.counts) - self.counts
        self.at = np.concatenate([lists[t] for t in order]).astype(np.int64) if order else np.empty(0, np.int64)
        #: (term, position) of each posting as one number, in order.
        self.keys = np.repeat(np.arange(n_terms + 1), self.counts) * self.length + self.at

    def holds(self, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the positions are in the terms' lists."""
        want = terms * self.length + at
        k = np.minimum(np.searchsorted(self.keys, want), max(0, len(self.keys) - 1))
        return (self.keys[k] == want) & (at >= 0) & (at < self.length)

    def phrases(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(window, start position) of each occurrence."""
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        if not len(windows.terms) or not len(self.at):
            return none
        freq = np.where(windows.terms < 0, np.iinfo(np.int64).max, self.counts[windows.terms])
        alive = np.flatnonzero(freq.min(axis=1) > 0)
        if not len(alive):
            return none
        order = np.argsort(freq[alive], axis=1, kind="stable")
        rarest = windows.terms[alive, order[:, 0]]
        n = self.counts[rarest]
        ends = np.cumsum(n)
        out, done = [], 0
        while done < len(alive):
            base = ends[done - 1] if done else 0
            upto = max(done + 1, int(np.searchsorted(ends, base + CANDIDATES, side="right")))
            k = np.repeat(np.arange(done, upto), n[done:upto])
            nth = np.arange(len(k)) - np.repeat(ends[done:upto] - n[done:upto] - base, n[done:upto])
            start = self.at[self.begin[rarest[k]] + nth] - order[k, 0]
            for step in range(1, order.shape[1]):
                offset = order[k, step]
                term = windows.terms[alive[k], offset]
                both = term < 0
                both[~both] = self.holds(term[~both].astype(np.int64), (start + offset)[~both])
                k, start = k[both], start[both]
            out.append((alive[k], start))
            done = upto
        return np.concatenate([w for w, _ in out]), np.concatenate([s for _, s in out])

    def near(self, terms: list[int], slop: int) -> np.ndarray:
        """Positions of terms[0] that have each other term within slop words in the same document."""
        lists = [self.at[self.begin[t] : self.begin[t] + self.counts[t]] for t in terms]
        at = lists[0]
        doc = np.searchsorted(self.ends, at)
        low, high = np.append(0, self.ends[:-1] + 1)[doc], self.ends[doc]
        for own in lists[1:]:
            first = np.searchsorted(own, np.maximum(low, at - slop), side="left")
            after = np.searchsorted(own, np.minimum(high, at + slop + 1), side="left")
            ok = after > first
            at, low, high = at[ok], low[ok], high[ok]
        return at


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of the batches of about SHARD_WORDS words, with the words of each text (the last column)."""
    for b in batches:
        held, begin, n = [], 0, 0
        for k, text in enumerate(b.column(b.num_columns - 1)):
            held.append(words(text.as_py() or b""))
            n += len(held[-1])
            if n >= SHARD_WORDS or k == b.num_rows - 1:
                yield b.slice(begin, k + 1 - begin), held
                held, begin, n = [], k + 1, 0


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> list[Callable[[], list[tuple[str, bytes]]]]:
    """Functions that fetch the items, about block_words words each."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    n = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-n // (4 * block_words)))
    fetch = lambda part: [(r["item"], bytes(r["text"])) for r in part.collect()]
    return [lambda k=k: fetch(rows if count == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)) for k in range(count)]


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: postings (shard, term, at: int32 positions as binary) and, where n_words is not null, a row (row, id, n_words) of each document."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["shard", "term", "at", "row", "id", "n_words"]
    types = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("at", pa.binary()), ("row", pa.int64()), ("n_words", pa.int64())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _shards(batches):
            rows = b.column(1).to_numpy()
            sizes = np.array([len(t) for t in texts], np.int64)
            blank = lambda n, kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([blank(len(rows), types.field("shard").type), *(blank(len(rows), pa.binary()) for _ in range(2)), b.column(1), b.column(0), pa.array(sizes)], names=names)
            flat = pa.array([w for t in texts for w in (*t, END)], pa.binary()).dictionary_encode()
            numbers = flat.indices.to_numpy()
            order = np.argsort(numbers, kind="stable").astype(np.int32)
            ends = np.append(0, np.cumsum(np.bincount(numbers, minlength=len(flat.dictionary)))).astype(np.int32) * 4
            lists = pa.Array.from_buffers(pa.binary(), len(flat.dictionary), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(order.tobytes())])
            for terms, at in ((flat.dictionary, lists), (pa.array([ROWS], pa.binary()), pa.array([rows.tobytes()], pa.binary()))):
                n = len(terms)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, rows[0])), terms, at, blank(n, pa.int64()), blank(n, b.column(0).type), blank(n, pa.int64())], names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return stored(rows.mapInArrow(build, f"shard long, term binary, at binary, row long, id {id_type}, n_words long"), "postings")


def rarest_terms(benchmark: DataFrame, terms: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, term (binary), nth: the `terms` words of each item that the fewest items hold, ties by their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [sorted(set(words(t.as_py()))) for t in b.column(1)]
            item = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), [len(w) for w in own]), pa.int64()))
            yield pa.RecordBatch.from_arrays([item, pa.array([w for x in own for w in x], pa.binary())], names=["item", "term"])

    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    held = rows.mapInArrow(run, "item string, term binary").distinct()
    n = held.groupBy("term").count()
    nth = F.row_number().over(Window.partitionBy("item").orderBy("count", "term"))
    return held.join(n, "term").select("item", "term", nth.alias("nth")).where(F.col("nth") <= terms)


def search(
    postings: DataFrame,
    benchmark: DataFrame,
    width: int | None = 10,
    terms: int = 0,
    slop: int = 20,
    item_col: str = "item_id",
    text_col: str = "text",
    block_words: int = BLOCK_WORDS,
    places: bool = True,
) -> DataFrame:
    """row, spans (covered word ranges [start, end), merged), items (ids with an occurring window), near (item and position), n_near of the documents with a match.

    width: words of a window; None for no phrases. terms: rarest terms of an item that make a proximity match; 0 for none.
    places: whether near lists the proximity matches; there may be as many as items times words. n_near counts them in any case.
    """
    spark = postings.sparkSession
    state = "spans array<struct<start: long, end: long>>, items array<string>, near array<struct<item: string, position: long>>, n_near long"
    rarest = stored(rarest_terms(benchmark, terms, item_col, text_col), "rarest-terms") if terms else None

    def look(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows, wanted = shared.value
            vocab = windows.vocab
            last, lists, ends, rows = None, {}, None, None

            def found() -> Iterator[pa.RecordBatch]:
                shard = Shard(lists, ends, len(vocab))
                w, start = shard.phrases(windows)
                cover = np.zeros(shard.length + 1, np.int32)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + windows.sizes[w], -1)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]])))
                begins = np.append(0, ends[:-1] + 1)
                out: dict[int, tuple[list, set, list]] = {}
                counts = np.zeros(len(ends), np.int64)
                of = lambda at: np.searchsorted(ends, at)
                spans = edges.reshape(-1, 2)
                for d, s, e in zip(of(spans[:, 0]).tolist(), *spans.T.tolist(), strict=True):
                    out.setdefault(d, ([], set(), []))[0].append((s - int(begins[d]), e - int(begins[d])))
                n = np.diff(windows.owner_ends, prepend=0)[w]
                owner = windows.owners[np.repeat(windows.owner_ends[w] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] if len(w) else np.empty(0, np.int64)
                for d, i in zip(np.repeat(of(start), n).tolist(), owner.tolist(), strict=True):
                    out[d][1].add(windows.items[i])
                for item, ids in wanted:
                    at = shard.near(ids, slop)
                    own = of(at)
                    np.add.at(counts, own, 1)
                    for d, p in zip(own.tolist(), at.tolist(), strict=True) if places else ():
                        out.setdefault(d, ([], set(), []))[2].append((item, p - int(begins[d])))
                for d in np.flatnonzero(counts).tolist():
                    out.setdefault(d, ([], set(), []))
                if out:
                    own = sorted(out)
                    fields = lambda k, names: [[dict(zip(names, x, strict=True)) for x in out[d][k]] for d in own]
                    yield pa.RecordBatch.from_pydict({"row": rows[own], "spans": fields(0, ("start", "end")), "items": [sorted(out[d][1]) for d in own], "near": fields(2, ("item", "position")), "n_near": counts[own]}, SPANS)

            for b in batches:
                for shard, term, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    if shard != last:
                        if last is not None:
                            yield from found()
                        last, lists, ends, rows = shard, {}, None, None
                    if term == ROWS:
                        rows = np.frombuffer(at.as_buffer(), np.int64)
                    elif term == END:
                        ends = np.frombuffer(at.as_buffer(), np.int32).astype(np.int64)
                    else:
                        lists[vocab[term]] = np.frombuffer(at.as_buffer(), np.int32)
            if last is not None:
                yield from found()

        return run

    results = []
    blocks = _blocks(benchmark, item_col, text_col, block_words)
    for fetch in blocks:
        items = fetch()
        windows = Windows(items, width)
        wanted: list[tuple[str, list[int]]] = []
        if terms:
            names = spark.createDataFrame([(x,) for x in windows.items], "item string")
            own: dict[str, list] = {}
            for r in rarest.join(F.broadcast(names), "item", "left_semi").collect():
                own.setdefault(r["item"], []).append((r["nth"], bytes(r["term"])))
            wanted = [(item, [windows.vocab.setdefault(t, len(windows.vocab) + 1) for _, t in sorted(x)]) for item, x in sorted(own.items())]
        if not windows.vocab:
            continue
        # the terms of one block: at most BLOCK_WORDS or so
        table = spark.createDataFrame([(bytearray(t),) for t in (*windows.vocab, END, ROWS)], "term binary")
        lists = postings.where("n_words IS NULL").select("shard", "term", "at").join(F.broadcast(table), "term", "left_semi")
        shared = spark.sparkContext.broadcast((windows, wanted))
        hits = lists.repartition(shuffle_width(spark), "shard").sortWithinPartitions("shard").select("shard", "term", "at").mapInArrow(look(shared), f"row long, {state}")
        if len(blocks) > 1:
            hits = stored(hits, "decontam")
            shared.destroy()
        results.append(hits)
    if not results:
        return spark.createDataFrame([], f"row long, {state}")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    if len(results) > 1:

        def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                spans = [[{"start": s, "end": e} for s, e in merged([(x["start"], x["end"]) for x in own])] for own in b.column(1).to_pylist()]
                yield b.set_column(1, "spans", pa.array(spans, b.schema.field(1).type))

        # one row a block of each document, so a group is as large as there are blocks
        whole = lambda c: F.flatten(F.collect_list(c)).alias(c)
        out = out.groupBy("row").agg(whole("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), whole("near"), F.sum("n_near").alias("n_near")).mapInArrow(unite, f"row long, {state}")
    return out


SPANS = pa.schema(
    [
        ("row", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
        ("near", pa.list_(pa.struct([("item", pa.string()), ("position", pa.int64())]))),
        ("n_near", pa.int64()),
    ]
)


def phrase_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int | None = 10,
    terms: int = 0,
    slop: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    block_words: int = BLOCK_WORDS,
    places: bool = True,
) -> DataFrame:
    """id, n_words, spans (covered word ranges [start, end), merged), items (ids with an occurring window), near (item and position) and n_near for each row; see search()."""
    postings = index(docs, id_col, text_col)
    hits = search(postings, benchmark, width, terms, slop, item_col, "text", block_words, places)
    # a row for each document with a match; those are no more than the documents, and keys are unique
    rows = postings.where("n_words IS NOT NULL").select("row", F.col("id").alias(id_col), "n_words")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(hits.schema[c].dataType)).alias(c)
    return rows.join(hits, "row", "left").select(id_col, "n_words", empty("spans"), empty("items"), empty("near"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, terms: int = 3, slop: int = 20, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (proximity matches) for each row."""
    found = phrase_matches(docs, benchmark, width, terms, slop, id_col, places=False, **options)
    hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    return found.select(
        id_col,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        "n_near",
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, with all columns, in which no window of a benchmark item occurs.

    Rows are told apart by their id and a hash of their text, as rows that agree in both match alike.
    """
    id_, hash_ = fresh(docs, "own_id", "text_hash")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.xxhash64(text).alias("hash"))
    postings = index(docs.select(key.alias("id"), text.alias("text")), "id", "text")
    hits = search(postings, benchmark, width, 0, 0, item_col, "text", block_words).select("row")
    rows = postings.where("n_words IS NOT NULL").select("row", "id").join(hits, "row", "left_semi")
    bad = stored(rows.select(F.col("id.id").alias(id_), F.col("id.hash").alias(hash_)).distinct(), "contaminated")
    tagged = docs.withColumns({id_: F.coalesce(F.col(id_col).cast("string"), F.lit("null")), hash_: F.xxhash64(text)})
    return tagged.join(bad, [id_, hash_], "left_anti").select(*docs.columns)


def proximity_matches(
    docs: DataFrame, benchmark: DataFrame, terms: int = 3, slop: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """doc_id, item_id, position: places (word numbers) where an item's rarest term has its next rarest within slop words.

    Rarest by the number of items that hold them, ties by the terms' bytes; the `terms` rarest of each item, or all that it has.
    """
    found = phrase_matches(docs, benchmark, None, terms, slop, id_col, text_col, item_col, block_words)
    return found.select(id_col, F.explode("near").alias("near")).select(id_col, F.col("near.item").alias(item_col), "near.position")
