"""Removal of repeated byte strings with sharded suffix arrays.

A string of `least` bytes that occurs twice has the same smallest hashed gram at the same place in both, so
the places of such grams (anchors, about 3 % of all) say which stretches of text can share a string: those
around anchors with equal grams. Of equal stretches only the first can hold a first occurrence; the others
are removed at once, within a batch before anything is shuffled. Stretches that differ but share their gram
meet in a shard, where a suffix array is built by two-stage sorting: only the suffixes smaller than their
successors are sorted directly, the rest is induced by scanning the buckets; adjacent common prefixes of
`least` bytes then give the equal strings, of which the first occurrence stays.
A gram with more than CROWD different stretches is split by its strings instead, so that no shard grows.

Null text counts as empty. Documents are ordered by id, of any type that has an order (null first); rows that share an id are ordered by a hash
of their text, and equal rows count as one document and get equal results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from vellum.llm.common import shuffle_width, stored

#: Bytes of a gram; bytes hashed together; strings of a stretch at most; stretches of a gram that meet in one shard; bytes of a suffix array.
GRAM, SEGMENT, RUN, CROWD, ARRAY = 40, 1 << 20, 256, 20_000, 2 << 20
ODD = 0x9E3779B97F4A7C15


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each `width` neighbours."""
    done = 1
    while done * 2 <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return pick(x[:-rest], x[rest:]) if rest else x


def stretches(text: bytes, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end, gram and flag of the stretches of text whose strings of `least` bytes share their smallest gram.

    A stretch holds every string of one run of such strings, RUN at most. The flag tells that the gram is in it
    twice, so that it may repeat itself.
    """
    span = least - GRAM + 1
    parts: list[tuple] = []
    with np.errstate(over="ignore"):
        for at in range(0, max(0, len(text) - least + 1), SEGMENT):
            a = np.frombuffer(text[at : at + SEGMENT + least - 1], np.uint8).astype(np.uint64) + np.uint64(1)
            n = len(a)
            power = np.full(n, ODD, np.uint64)
            power[0] = 1
            np.multiply.accumulate(power, out=power)
            inverse = np.full(n, pow(ODD, -1, 1 << 64), np.uint64)
            inverse[0] = 1
            np.multiply.accumulate(inverse, out=inverse)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(a * power)])
            h = (sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            low = _slide(h, span, np.minimum)
            edge = np.zeros(span - 1, np.uint64)
            anchor = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), span, np.maximum) == h)
            run = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
            size = np.diff(np.append(run, len(low)))
            cuts = -(-size // RUN)
            nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            begin = np.repeat(run, cuts) + nth * RUN
            last = np.minimum(begin + RUN, np.repeat(run + size, cuts)) - 1
            gram = low[begin]
            # anchors of the same gram inside the stretch
            names = np.unique(gram)
            rank = lambda x: np.searchsorted(names, x).astype(np.int64) << 32
            keys = np.sort(rank(h[anchor]) + anchor)
            twice = np.searchsorted(keys, rank(gram) + last + span) - np.searchsorted(keys, rank(gram) + begin) > 1
            parts.append((begin + at, last + at + least, gram, twice))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def suffix_array(text: np.ndarray, depth: int, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes' first `depth` symbols at least, and packed words of 8 symbols.

    text: uint8 that ends with a 0. asked: a mask of the places to sort; those from there to the next suffix
    that is smaller than its successor are sorted as well, as the others are induced from them.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)]).astype(np.uint64)
    words = np.zeros(n + depth + 8, np.uint64)
    for k in range(8):
        words |= padded[k : k + len(words)] << np.uint64(56 - 8 * k)
    # suffixes smaller than their successor; a run of one symbol goes by what follows it, the last is larger
    change = np.flatnonzero(text[1:] != text[:-1])
    up = np.append(text[change] < text[change + 1], False)
    smaller = up[np.searchsorted(change, np.arange(n), side="left")]
    if asked is None:
        asked = np.ones(n, bool)
    else:
        # the last asked place before each place, and whether a directly sorted one lies between
        reach = np.maximum.accumulate(np.where(asked, np.arange(n), -1))
        direct_before = np.concatenate([[0], np.cumsum(smaller)])
        asked = asked | (reach >= 0) & (direct_before[np.arange(n)] - direct_before[np.maximum(reach, 0)] == 0)
    own = np.flatnonzero(smaller & asked)
    own = own[np.argsort(words[own], kind="stable")]
    fresh = np.append(True, words[own][1:] != words[own][:-1]) if len(own) else np.empty(0, bool)
    for d in range(8, depth, 8):
        group = np.cumsum(fresh) - 1
        tied = ~(fresh & np.append(fresh[1:], True))
        at = np.flatnonzero(tied)
        if not len(at):
            break
        key = words[own[at] + d]
        order = np.lexsort((key, group[at]))
        own[at] = own[at][order]
        key = key[order]
        fresh[at[1:]] |= (key[1:] != key[:-1]) & (group[at[1:]] == group[at[:-1]])
    # buckets by first symbol: induced suffixes in front, sorted ones behind
    out = np.empty(int(asked.sum()), np.int64)
    sizes = np.bincount(text[asked], minlength=256)
    begin = np.cumsum(sizes) - sizes
    direct = np.bincount(text[own], minlength=256)
    behind = begin + sizes - direct
    split = np.cumsum(direct) - direct
    front = begin.copy()
    induced = ~smaller & asked
    if asked[-1]:
        out[front[0]] = n - 1
        front[0] += 1
    scanned = begin.copy()
    for c in range(256):
        if not sizes[c]:
            continue
        out[behind[c] : behind[c] + direct[c]] = own[split[c] : split[c] + direct[c]]
        while scanned[c] < begin[c] + sizes[c]:
            upto = front[c] if scanned[c] < front[c] else begin[c] + sizes[c]
            before = out[scanned[c] : upto] - 1
            scanned[c] = upto
            before = before[before >= 0]
            before = before[induced[before]]
            symbols = text[before]
            order = np.argsort(symbols, kind="stable")
            before, symbols = before[order], symbols[order]
            found, counts = np.unique(symbols, return_counts=True)
            done = 0
            for s, k in zip(found.tolist(), counts.tolist(), strict=True):
                out[front[s] : front[s] + k] = before[done : done + k]
                front[s] += k
                done += k
    return out, words


def common_prefixes(order: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in order (0 for the first), up to most."""
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for d in range(0, most, 8):
        x = words[order[live] + d] ^ words[order[live - 1] + d]
        same = x == 0
        part = x[~same]
        zeros = np.zeros(len(part), np.int64)
        for k in range(1, 8):
            zeros += part < (np.uint64(1) << np.uint64(64 - 8 * k))
        out[live[~same]] = d + zeros
        live = live[same]
        out[live] = d + 8
    return np.minimum(out, most)


def repeats(stretches: list[bytes], owner: np.ndarray, start: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(stretch, begin, end) of the bytes in strings of `least` bytes that also start earlier, by (owner, start)."""
    sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
    raw = np.frombuffer(b"\0".join(stretches) + b"\0", np.uint8)
    # a symbol 0 ends each stretch; zero bytes inside of one share its symbol with 1, told apart at the end
    ends = np.cumsum(sizes + 1) - 1
    text = np.maximum(raw, 1)
    text[ends] = 0
    holder = np.repeat(np.arange(len(ends)), sizes + 1)
    asked = np.arange(len(text)) + least <= ends[holder]
    order, words = suffix_array(text, least, asked)
    order = order[asked[order]]
    stretch = holder[order]
    lcp = common_prefixes(order, words, least)
    if (raw == 0).sum() > len(ends):
        lcp = _told_apart(raw, order, lcp, least)
        order, stretch, lcp = order[lcp[1]], stretch[lcp[1]], lcp[0]
    group = np.cumsum(lcp < least)
    first_at = start[stretch] + order - (ends - sizes)[stretch]
    by = np.lexsort((first_at, owner[stretch], group))
    head = np.append(True, group[by][1:] != group[by][:-1])
    lead = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
    later = by[(owner[stretch[by]] != owner[stretch[lead]]) | (first_at[by] != first_at[lead])]
    places = np.sort(order[later])
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) != 1) + 1
    out = []
    for run in np.split(places, cut):
        k = int(np.searchsorted(ends, run[0], side="left"))
        base = int(ends[k] - sizes[k])
        out.append((k, int(run[0]) - base, int(run[-1]) - base + least))
    return out


def _told_apart(raw: np.ndarray, order: np.ndarray, lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Common prefixes again, and the order within equal strings, where bytes 0 and 1 were one symbol."""
    group = np.cumsum(lcp < least)
    names = [raw[p : p + least].tobytes() for p in order.tolist()]
    by = np.array(sorted(range(len(order)), key=lambda k: (group[k], names[k])), np.int64)
    same = np.array([False, *(names[a] == names[b] for a, b in zip(by[:-1], by[1:], strict=True))])
    return np.where(same, least, 0), by


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    """Which rows begin a run of equal values."""
    return np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)) if len(columns[0]) else np.empty(0, bool)


def removals(docs: DataFrame, least: int = 100, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(texts: id, key, alike, text (binary)) and (spans: key, alike, start, end): bytes to remove, overlapping."""
    again = docs.groupBy(id_col).count().where("count > 1").limit(1).count() > 0
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.xxhash64(text) if again else F.lit(0).cast("long")).alias("alike"), text.alias("text"))
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        keyed = rows.withColumn("key", F.col("id").cast("long"))
    else:
        keyed = rows.join(_ranks(rows), "id", "left")
    texts = keyed.select("id", F.coalesce("key", F.lit(-(1 << 63))).alias("key"), "alike", "text")
    return texts, _spans(texts, least, crowd)


def _ranks(rows: DataFrame) -> DataFrame:
    """id, key: whole numbers in the order of the ids, which may be of any type that has an order; null has none.

    Ranges of ids are sorted side by side, and the range's number leads each key, so nothing passes one task.
    """
    ids = rows.where("id IS NOT NULL").select("id").distinct()
    ordered = ids.repartitionByRange(shuffle_width(rows.sparkSession), "id").sortWithinPartitions("id")
    return stored(ordered.select("id", F.monotonically_increasing_id().alias("key")), "id-ranks")


def _spans(texts: DataFrame, least: int, crowd: int) -> DataFrame:
    spark = texts.sparkSession
    names = ["gram", "stretch", "key", "alike", "start", "size", "kind"]
    anchor_schema = "gram long, stretch long, key long, alike long, start long, size int, kind int"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            keys, alikes = b.column(0).to_numpy(), b.column(1).to_numpy()
            parts: list[list[np.ndarray]] = [[] for _ in range(5)]
            which, held = [], 0

            def out() -> pa.RecordBatch:
                gram, stretch, start, size, twice = (np.concatenate(p) for p in parts)
                doc = np.concatenate(which)
                key, alike = keys[doc], alikes[doc]
                order = np.lexsort((start, alike, key, stretch, gram))
                gram, stretch, key, alike, start, size, twice = (x[order] for x in (gram, stretch, key, alike, start, size, twice))
                whole = _runs([gram, stretch, key, alike, start])
                gram, stretch, key, alike, start, size = (x[whole] for x in (gram, stretch, key, alike, start, size))
                first = _runs([gram, stretch])
                # later copies in the batch are decided; they are dealt out by their place rather than their gram
                place = key * 1_000_003 + start
                kind = np.where(first, np.where(twice[whole], 2, 0), 1).astype(np.int32)
                return pa.RecordBatch.from_arrays([pa.array(np.where(first, gram, place)), pa.array(stretch), pa.array(key), pa.array(alike), pa.array(start), pa.array(size.astype(np.int32)), pa.array(kind)], names=names)

            for k, cell in enumerate(b.column(2)):
                t = cell.as_py()
                begin, end, gram, twice = stretches(t, least)
                if not len(begin):
                    continue
                parts[0].append(gram.view(np.int64))
                parts[1].append(np.fromiter((digest(t[s:e]) for s, e in zip(begin.tolist(), end.tolist(), strict=True)), np.uint64, len(begin)).view(np.int64))
                parts[2].append(begin)
                parts[3].append(end - begin)
                parts[4].append(twice)
                which.append(np.full(len(begin), k))
                held += len(begin)
                if held > 2_000_000:
                    yield out()
                    parts, which, held = [[] for _ in range(5)], [], 0
            if held:
                yield out()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 1: later copies, removed. Kinds 2 and 3: first copies whose gram is twice in them, or has other stretches, few or many."""
        last_gram = last_stretch = last_place = None
        waiting: list[list[np.ndarray]] = []
        count, many = 0, False

        def row(kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(np.full(len(columns[0]), kind, np.int32))], names=["gram", "key", "alike", "start", "size", "kind"])

        def close() -> Iterator[pa.RecordBatch]:
            if waiting and not many:
                columns = [np.concatenate(c) for c in zip(*waiting, strict=True)]
                take = np.full(len(columns[0]), count > 1) | (columns[5] == 2)
                if take.any():
                    yield row(2, [c[take] for c in columns[:5]])

        for b in batches:
            if not b.num_rows:
                continue
            gram, stretch, key, alike, start, size, kind = (b.column(k).to_numpy() for k in range(7))
            passed = kind == 1
            if passed.any():
                yield row(1, [x[passed] for x in (gram, key, alike, start, size)])
                gram, stretch, key, alike, start, size, kind = (x[~passed] for x in (gram, stretch, key, alike, start, size, kind))
                if not len(gram):
                    continue
            first = _runs([gram, stretch])
            first[0] = (gram[0], stretch[0]) != (last_gram, last_stretch)
            # a row at the place of its run's first is that one again, from a row that repeats
            lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
            same = np.all([x == x[lead] for x in (key, alike, start)], axis=0)
            carried = np.cumsum(first) == 0
            if carried.any():
                same[carried] = np.all([x[carried] == y for x, y in zip((key, alike, start), last_place, strict=True)], axis=0)
            if not (first | same).all():
                yield row(1, [x[~(first | same)] for x in (gram, key, alike, start, size)])
            if first.any():
                k = int(np.flatnonzero(first)[-1])
                last_place = key[k], alike[k], start[k]
            own = [x[first] for x in (gram, key, alike, start, size, kind)]
            if not len(own[0]):
                continue
            heads = np.flatnonzero(_runs([own[0]]))
            tails = np.append(heads[1:], len(own[0]))
            begin_new = 0
            if own[0][0] == last_gram:
                begin_new = 1
                piece = [x[: tails[0]] for x in own]
                count += len(piece[0])
                if many:
                    yield row(3, piece[:5])
                else:
                    waiting.append(piece)
            if begin_new < len(heads):
                yield from close()
                # groups that end in this batch: only those with two stretches or more matter
                inner = slice(begin_new, len(heads) - 1)
                n = tails[inner] - heads[inner]
                part = [x[heads[begin_new] : heads[-1]] for x in own]
                big = np.repeat(n > crowd, n)
                take = np.repeat(n > 1, n) | (part[5] == 2)
                for flag, k in ((big, 3), (~big & take, 2)):
                    if flag.any():
                        yield row(k, [x[flag] for x in part[:5]])
                waiting, many = [[x[heads[-1] :] for x in own]], False
                count = len(waiting[0][0])
            if count > crowd and not many:
                many = True
                yield row(3, [np.concatenate(c) for c in zip(*waiting, strict=True)][:5])
                waiting = []
            last_gram, last_stretch = gram[-1], stretch[-1]
        yield from close()

    width = shuffle_width(spark)
    found = texts.select("key", "alike", "text").mapInArrow(find, anchor_schema)
    dealt = found.repartition(width, "gram").sortWithinPartitions("gram", "stretch", "key", "alike", "start")
    marked = stored(dealt.mapInArrow(scan, "gram long, key long, alike long, start long, size int, kind int"), "stretches")
    copies = marked.where("kind = 1").select("key", "alike", "start", (F.col("start") + F.col("size")).alias("end"))
    wanted = marked.where("kind > 1").groupBy("key", "alike").agg(F.collect_list(F.struct("gram", "start", "size", "kind")).alias("wanted"))
    piece_schema = "gram long, key long, alike long, start long, bytes binary, size int"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            seen: dict[bytes, tuple] = {}
            done = []
            keys, alikes = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k in sorted(range(b.num_rows), key=lambda k: (keys[k], alikes[k])):
                t = b.column(2)[k].as_py()
                for w in sorted(b.column(3)[k].as_py(), key=lambda w: w["start"]):
                    s, e = w["start"], w["start"] + w["size"]
                    if w["kind"] == 2:
                        rows.append((w["gram"], keys[k], alikes[k], s, t[s:e]))
                        continue
                    for p in range(s, e - least + 1):
                        string = t[p : p + least]
                        place = (keys[k], alikes[k], p)
                        if seen.setdefault(string, place) == place:
                            rows.append((xxhash.xxh3_64_intdigest(string) - (1 << 63), *place, string))
                        else:
                            done.append((0, *place, None))
                if len(rows) + len(done) > 100_000:
                    yield table(rows + done)
                    rows, done, seen = [], [], {}
            if rows or done:
                yield table(rows + done)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary()), pa.array([least] * len(rows), pa.int32())], names=["gram", "key", "alike", "start", "bytes", "size"])

    # wanted is the smaller side by far: a list of places for some documents
    pieces = texts.select("key", "alike", "text").join(wanted.hint("shuffle_hash"), ["key", "alike"]).mapInArrow(cut, piece_schema)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        texts_: list[bytes] = []
        n, last = 0, None

        def out() -> Iterator[pa.RecordBatch]:
            key, alike, start = (np.concatenate(x) for x in zip(*held, strict=True))
            _, owner = np.unique(np.stack([key, alike], axis=1), axis=0, return_inverse=True)
            spans = repeats(texts_, owner.ravel(), start, least)
            if spans:
                k, s, e = (np.array(x) for x in zip(*spans, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(key[k]), pa.array(alike[k]), pa.array(start[k] + s), pa.array(start[k] + e)], names=["key", "alike", "start", "end"])

        for b in batches:
            gram, key, alike, start = (b.column(k).to_numpy() for k in range(4))
            known = b.column(4).is_null().to_numpy(zero_copy_only=False)
            if known.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[known]), pa.array(alike[known]), pa.array(start[known]), pa.array(start[known] + least)], names=["key", "alike", "start", "end"])
            live = np.flatnonzero(~known)
            if not len(live):
                continue
            heads = live[_runs([gram[live]])]
            for s, e in zip(heads.tolist(), [*heads.tolist()[1:], len(gram)], strict=True):
                if n >= ARRAY and gram[s] != last:
                    yield from out()
                    held, texts_, n = [], [], 0
                at = np.arange(s, e)
                at = at[~known[at]]
                strings = b.column(4).take(pa.array(at)).to_pylist()
                held.append((key[at], alike[at], start[at]))
                texts_ += strings
                n += sum(map(len, strings))
                last = gram[s]
        if texts_:
            yield from out()

    strings = pieces.repartition(width, "gram").sortWithinPartitions("gram").mapInArrow(sort, "key long, alike long, start long, end long")
    return copies.unionByName(strings)


def deduplicate(docs: DataFrame, least: int = 100, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), spans (removed, merged) and kept_sha256 for each row."""
    texts, spans = removals(docs, least, id_col, text_col, crowd)
    id_type = docs.schema[id_col].dataType.simpleString()
    lists = spans.groupBy("key", "alike").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    met = texts.join(lists.hint("shuffle_hash"), ["key", "alike"], "left").select("id", "text", "spans")

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, found in zip(b.column(1), b.column(2), strict=True):
                t = t.as_py()
                if not found.is_valid:
                    rows.append((len(t), 0, 0, hashlib.sha256(t).hexdigest(), t, []))
                    continue
                s = found.values
                starts, ends = s.field(0).to_numpy(), s.field(1).to_numpy()
                order = np.argsort(starts, kind="stable")
                starts, reach = starts[order], np.maximum.accumulate(ends[order])
                head = np.append(True, starts[1:] > reach[:-1])
                begin, end = starts[head], reach[np.append(np.flatnonzero(head)[1:] - 1, len(reach) - 1)]
                edges = [0, *np.stack([begin, end], axis=1).ravel().tolist(), len(t)]
                kept = b"".join(t[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(t), len(t) - len(kept), len(begin), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": z} for a, z in zip(begin.tolist(), end.tolist(), strict=True)]))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, types, strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    out = met.mapInArrow(take_out, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: long, end: long>>")
    return out.withColumnRenamed("id", id_col)
