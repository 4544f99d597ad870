"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found by hashes of deletions.

Two words differ by one code point just when they agree after one deletion: in each at the same place (replaced), or in the
longer one alone (inserted). Every word gives one integer key for each of its deletions and one for itself, put together in
numpy from polynomial hashes of its prefixes and suffixes. Keys are dealt out by their low bits and sorted; neighbours with
equal keys are compared as strings, so that a collision links nothing.

A group of equal deletions at one place has no more words than the alphabet has letters, whatever the input. Within it a word
gets a count and the best of the others, never all pairs. Each near pair is counted once: a replacement has one place, and of
an insertion into a run of equal letters only the run's first place counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import fresh, shuffle_width, spread_join, stored

#: An odd number below 2^64, the base of the polynomial hashes modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Rows, or bytes of them, that are looked at together at least, if there are so many.
ROWS, BYTES = 100_000, 64 << 20
#: Words of more code points don't travel with each of their keys.
LONG = 64


def ascii_lower(c: Column) -> Column:
    """c with only A-Z lower-cased; the quick form where there is no other letter."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def document_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", every: int = 97) -> DataFrame:
    """word: the lower-cased runs of letters of whole texts, one row for each occurrence.

    Where `every` divides the crc32 of <id>:<run>, the run's code point number crc32 % length is left out. A null text has no
    words; a null id is hashed as an empty one.
    """
    (run,) = fresh(docs.select(id_col), "run")
    runs = docs.select(F.col(id_col), F.explode(F.regexp_extract_all(F.col(text_col), F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))).alias(run))
    low = runs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), ascii_lower(F.col(run)).alias("run"))
    h = low.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return h.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, *, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word, n: distinct words of at least so many code points and occurrences; counted before the shuffle."""
    kept = words.where(F.char_length("word") >= least_length)
    return kept.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the low bits' weakness of hashes modulo 2^64 over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each deletion of each word: the word's number, the place, whether the letter before differs, the key; place -1: the word itself."""
    length = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    longest = int(length.max(initial=0))
    # rows of equal length side by side: one column a place
    grid = np.zeros((len(words), longest), np.uint64)
    row = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(codes)) - np.repeat(start, length)
    grid[row, place] = codes
    power = np.ones(longest + 1, np.uint64)
    prefix = np.zeros((len(words), longest + 1), np.uint64)
    suffix = np.zeros((len(words), longest + 2), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(longest):
            power[i + 1] = power[i] * BASE
            prefix[:, i + 1] = prefix[:, i] * BASE + grid[:, i] * (i < length)
        for i in range(longest - 1, -1, -1):
            # value of w[i:]: its first letter weighs BASE^(rest)
            rest = np.maximum(length - i - 1, 0)
            suffix[:, i] = np.where(i < length, grid[:, i] * power[rest] + suffix[:, i + 1], 0)
        deleted = prefix[row, place] * power[length[row] - place - 1] + suffix[row, place + 1]
        whole = suffix[:, 0]
        # the length of the string hashed goes in, as leading zeros would not show
        key = _mixed(np.concatenate([deleted, whole]) + BASE * np.concatenate([length[row] - 1, length]).astype(np.uint64))
    first = np.concatenate([[True], codes[1:] != codes[:-1]]) | (place == 0) if len(codes) else np.zeros(0, bool)
    return np.concatenate([row, np.arange(len(words))]), np.concatenate([place, np.full(len(words), -1)]), np.concatenate([first, np.zeros(len(words), bool)]), key.view(np.int64)


def _emit_keys(*carried: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """key, place, first and the carried columns for each deletion of the column word."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("word").to_pylist()
            # a very long word must not widen the grid of all others
            by_length: dict[int, list[int]] = {}
            for k, w in enumerate(words):
                by_length.setdefault(len(w).bit_length(), []).append(k)
            for members in by_length.values():
                step = max(1, 500_000 // max(1, *(len(words[k]) for k in members)))
                for lo in range(0, len(members), step):
                    part = np.array(members[lo : lo + step])
                    of, place, first, key = deletion_keys([words[k] for k in part])
                    rows = pa.array(part[of])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(place.astype(np.int32)), pa.array(first), *(b.column(c).take(rows) for c in carried)], names=["key", "place", "first", *carried]
                    )

    return emit


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of rows with equal values begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _near(key: np.ndarray, place: np.ndarray, first: np.ndarray, words: np.ndarray, n: np.ndarray) -> pa.RecordBatch | None:
    """word, count, the best near word and its n, for whole groups of equal keys, sorted by key."""
    starts = _runs(key)
    sizes = np.diff(np.append(starts, len(key)))
    many = np.repeat(sizes > 1, sizes)
    if not many.any():
        return None
    key, place, first, words, n = (x[many] for x in (key, place, first, words, n))
    left = np.array([w if p < 0 else w[:p] + w[p + 1 :] for w, p in zip(words, place.tolist(), strict=True)], object)
    starts = _runs(key)
    own = np.repeat(starts, np.diff(np.append(starts, len(key))))
    kind = np.zeros(len(key), np.int64)
    if (left != left[own]).any():  # a collision of keys: the strings tell the groups apart
        kind = np.unique(left.astype(str), return_inverse=True)[1]
    # the order of preference: larger n first, then the smaller word
    rank = np.empty(len(key), np.int64)
    rank[pc.sort_indices(pa.table({"n": n, "w": pa.array(words, pa.string())}), [("n", "descending"), ("w", "ascending")]).to_numpy()] = np.arange(len(key))
    order = np.lexsort((rank, place, kind, key))
    key, kind, place, first, words, n, rank = (x[order] for x in (key, kind, place, first, words, n, rank))
    row = np.arange(len(key))
    of, count, best = [], [], []

    # replaced: the others at the same place of the same group; the first row is the best, for itself the second
    starts = _runs(key, kind, place)
    sizes = np.diff(np.append(starts, len(key)))
    size, start = np.repeat(sizes, sizes), np.repeat(starts, sizes)
    use = (size > 1) & (place >= 0)
    of.append(row[use])
    count.append(size[use] - 1)
    best.append(np.where(row == start, start + 1, start)[use])

    # inserted: the group's whole word, which sorts first, and those that become it
    starts = _runs(key, kind)
    sizes = np.diff(np.append(starts, len(key)))
    start = np.repeat(starts, sizes)
    longer = (place[start] < 0) & (row != start) & first
    of.append(row[longer])
    count.append(np.ones(longer.sum(), np.int64))
    best.append(start[longer])
    if longer.any():
        at = np.flatnonzero(longer)
        heads = _runs(start[at])
        lowest = np.minimum.reduceat(rank[at], heads)
        back = np.empty(len(rank), np.int64)
        back[rank] = row
        of.append(start[at[heads]])
        count.append(np.diff(np.append(heads, len(at))))
        best.append(back[lowest])
    of, count, best = np.concatenate(of), np.concatenate(count), np.concatenate(best)
    return pa.RecordBatch.from_arrays([pa.array(words[of], pa.string()), pa.array(count), pa.array(words[best], pa.string()), pa.array(n[best])], names=["word", "n_near", "best", "best_n"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key; the last, perhaps unfinished group of a batch waits for the next."""

    def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        c = [rows.column(k).to_numpy() for k in ("key", "place", "first")]
        found = _near(*c, np.array(rows.column("word").to_pylist(), object), rows.column("n").to_numpy())
        if found is not None:
            yield found

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < ROWS and sum(x.nbytes for x in held) < BYTES:
            continue
        rows = pa.Table.from_batches(held)
        key = rows.column("key").to_numpy()
        end = int(np.searchsorted(key, key[-1]))
        if end:
            yield from out(rows.slice(0, end))
        held = rows.slice(end).to_batches()
    if held:
        yield from out(pa.Table.from_batches(held))


def _long_keys(vocab: DataFrame) -> DataFrame:
    """The rows (key, place, first, word, n) of pairs whose longer word is longer than LONG; none without a partner.

    Keys are first met with the words' SHA-256, so that a word of a million letters is not sent a million times; only rows
    that share a key and, as the case is, the place get their word.
    """
    named = stored(vocab.where(F.char_length("word") >= LONG).select("word", "n", F.unhex(F.sha2("word", 256)).alias("ref")), "long-words")
    keys = named.mapInArrow(_emit_keys("ref"), "key long, place int, first boolean, ref binary")
    # words of just LONG letters are here for the longer ones only
    brief = named.where(F.char_length("word") == LONG).select("ref")
    keys = stored(keys.join(brief, "ref", "left_anti").unionByName(keys.where("place < 0").join(brief, "ref", "left_semi")), "long-keys")
    replaced = keys.where("place >= 0").groupBy("key", "place").agg(F.min("ref").alias("a"), F.max("ref").alias("b")).where("a <> b").select("key", "place")
    ends = keys.where("place < 0 OR first")
    inserted = ends.groupBy("key").agg(F.min("place").alias("least"), F.max("place").alias("most")).where("least < 0 AND most >= 0").select("key")
    used = keys.join(replaced, ["key", "place"], "left_semi").unionByName(ends.join(inserted, "key", "left_semi")).distinct()
    return used.join(named, "ref").select("key", "place", "first", "word", "n")


def near_words(vocab: DataFrame, bits: int = 16) -> DataFrame:
    """word, n_near, best, best_n: how many words of vocab(word, n) are near, and the one of largest n, ties to the smallest word.

    Words without near ones have no row. Any distinct strings will do, the empty one and very long ones included.
    """
    keys = vocab.where(F.char_length("word") <= LONG).select("word", "n").mapInArrow(_emit_keys("word", "n"), "key long, place int, first boolean, word string, n long")
    if vocab.where(F.char_length("word") > LONG).head(1):
        keys = keys.unionByName(_long_keys(vocab))
    radix = F.col("key").bitwiseAND((1 << bits) - 1)
    sorted_keys = keys.repartition(shuffle_width(vocab.sparkSession), radix).sortWithinPartitions("key")
    found = sorted_keys.mapInArrow(_compare, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms(word, form): forms are followed to the end by doubling, log2 of the longest chain rounds.

    Many words may share a form: such forms are met by broadcast of a bounded number. Forms that go round in circles are an error.
    """
    jumps = stored(forms.select("word", F.col("form").alias("root")), "roots")
    total = jumps.count()
    for _ in range(64):
        asked = jumps.groupBy("root").agg(F.count("*").alias("asked"))
        onward = asked.join(jumps.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left")
        onward = onward.select("root", "asked", F.coalesce("further", "root").alias("further"), F.col("further").isNotNull().alias("moved"))
        jumps = stored(spread_join(jumps.select("word", "root"), onward, "root", "asked", total).select("word", F.col("further").alias("root"), "moved"), "roots")
        if not jumps.where("moved").head(1):
            return jumps.select("word", "root")
    raise ValueError("roots: forms go round in circles")


def variants(words: DataFrame, *, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for words(word), one row an occurrence.

    form: the near word of largest n (ties: the smallest in code-point order), if its n is at least ratio times the word's;
    root: where forms lead to. Null words count nothing; an empty table gives an empty one.
    """
    vocab = stored(vocabulary(words, least_length=least_length, least_count=least_count), "words")
    near = near_words(vocab)
    is_form = F.col("best_n") >= ratio * F.col("n")
    full = vocab.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    full = stored(full, "variants")
    ends = roots(full.where("form IS NOT NULL"))
    return full.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
