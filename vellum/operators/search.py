"""Full-text search: tokens, a positional inverted index as a table, BM25 ranking, snippets and dictionary suggestions.

The index is three tables: postings (term, scan_id, page_index, tf, positions), the pages' lengths and the corpus
totals. A query reads only the postings whose term begins with one of its words (of a saved index, only the pages of
its files that may hold such terms), and ranks with a top-k.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _folds() -> tuple[str, str]:
    """Letters with diacritics and their base letters, by decomposition."""
    pairs = {}
    for n in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = [c for c in unicodedata.normalize("NFD", chr(n)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(n):
            pairs[chr(n)] = base[0]
    return "".join(pairs), "".join(pairs.values())


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits without diacritics; ASCII texts need no folding."""
    plain = F.regexp_replace(F.translate(F.lower(c), *_folds()), r"\p{Mn}", "")
    folded = F.when(c.rlike(r"\A[\x00-\x7F]*\z"), F.lower(c)).otherwise(plain)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


POSTINGS = "term string, scan_id string, page_index int, tf bigint, positions array<int>"


def index(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of pages (scan_id, page_index, text): one shuffle of the texts by page, none for the lengths.

    A page's words are sorted where its text lies, in Arrow batches, and are never rows of their own.
    """
    texts = pages.select(F.col("scan_id").cast("string"), F.col("page_index").cast("int"), "text").groupBy("scan_id", "page_index").agg(F.collect_list("text").alias("texts"))

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            ids, numbers, lists = batch.columns
            # a page has one text, or more where it is listed more often
            words = pc.list_flatten(lists)
            text = pc.list_parent_indices(words).to_numpy()
            if not len(text):
                continue
            begin = words.offsets.to_numpy()
            at, row = np.arange(len(text)) - (begin[:-1] - begin[0])[text], pc.list_parent_indices(lists).to_numpy()[text]
            coded = pc.dictionary_encode(pc.list_flatten(words))
            code = coded.indices.to_numpy()
            order = np.lexsort((at, code, row))
            row, code = row[order], code[order]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])])
            ends = np.r_[first, len(row)].astype(np.int32)
            page = pa.array(row[first])
            columns = [coded.dictionary.take(pa.array(code[first])), ids.take(page), numbers.take(page), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(at[order].astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "scan_id", "page_index", "tf", "positions"])

    return texts.select("scan_id", "page_index", F.transform("texts", tokens).alias("words")).mapInArrow(cut, POSTINGS), lengths(pages)


def lengths(pages: DataFrame) -> DataFrame:
    """scan_id, page_index, length of pages: their numbers of tokens."""
    return pages.select("scan_id", "page_index", F.size(tokens(F.col("text"))).alias("length"))


def save(pages: DataFrame, folder: str) -> None:
    """Writes the index of pages: a segment of postings for each part of the pages, sorted by term, and the lengths.

    A search reads of each segment only the pages of Parquet that may hold its prefixes. No posting is shuffled, and however
    frequent a term is, a task has its postings of one part only.
    """
    postings, lengths_ = index(pages)
    postings.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/postings")
    lengths_.write.mode("overwrite").parquet(f"{folder}/lengths")


def load(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of a saved index."""
    return spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/lengths")


def query_terms(query: str) -> list[str]:
    """Words of a query: marks dropped, operators dropped, lower case without diacritics."""
    out = []
    for word in query.replace(" ", " ").split():
        kept = "".join(c for c in word if c in "_-" or unicodedata.category(c)[0] in "LN")
        if kept and kept.upper() not in ("AND", "OR", "NOT"):
            out.append("".join(c for c in unicodedata.normalize("NFD", kept.lower()) if not unicodedata.combining(c)))
    return list(dict.fromkeys(out))


def search(postings: DataFrame, lengths: DataFrame, query: str, limit: int = 50, ranked: bool = True) -> DataFrame:
    """scan_id, page_index, rank of pages that hold a term with each of the query's words as prefix; best first.

    rank is the negated BM25, as smaller is better; without ranking it is 0. A hyphenated word matches nothing,
    since no term holds a hyphen. The caller adds further sort keys and the limit with top().
    """
    terms = query_terms(query)
    total, length = lengths.agg(F.count("*"), F.avg("length")).first() if terms else (0, 0.0)
    if not terms or not total:
        return postings.select("scan_id", "page_index", F.lit(0.0).alias("rank")).where("false")
    # whether a term begins with a word is tested on the postings as they are read
    which = F.array_compact(F.array(*(F.when(F.startswith("term", F.lit(t)), F.lit(k)) for k, t in enumerate(terms))))
    hits = postings.where(_any([F.startswith("term", F.lit(t)) for t in terms])).select("scan_id", "page_index", "tf", F.explode(which).alias("word"))
    by_page = hits.groupBy("scan_id", "page_index", "word").agg(F.sum("tf").alias("tf"))
    pages_with = {r["word"]: r["n"] for r in by_page.groupBy("word").agg(F.count("*").alias("n")).collect()}
    idf = {k: math.log((total - n + 0.5) / (n + 0.5)) for k, n in pages_with.items()}
    idf = {k: v if v > 0 else LEAST_IDF for k, v in idf.items()}
    weight = F.element_at(F.array(*(F.lit(idf.get(k, 0.0)) for k in range(len(terms)))), F.col("word") + 1)
    score = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(length))))
    met = by_page.join(lengths, ["scan_id", "page_index"]).groupBy("scan_id", "page_index").agg(F.count("*").alias("words"), (-F.sum(score)).alias("rank"))
    found = met.where(F.col("words") == len(terms))
    return found.select("scan_id", "page_index", F.col("rank") if ranked else F.lit(0.0).alias("rank"))


def _any(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def top(found: DataFrame, scans: DataFrame, limit: int = 50) -> DataFrame:
    """Hits with their scans: best rank, newest, then id and page; at least one row is asked for."""
    met = found.join(scans, found["scan_id"] == scans["id"])
    return met.select("scan_id", "title", "created_at", "cover_path", "page_index", "rank").orderBy("rank", F.desc("created_at"), "scan_id", "page_index").limit(max(1, limit))


def first_hits(found: DataFrame) -> DataFrame:
    """The best hit of each scan."""
    best = F.min_by(F.struct("page_index", "rank"), F.struct("rank", F.negative("created_at"), "page_index"))
    return found.groupBy("scan_id").agg(best.alias("b")).select("scan_id", "b.page_index", "b.rank")


def snippet(c: Column, terms: Sequence[str], size: int = 12, mark: tuple[str, str, str] = ("“", "”", "…")) -> Column:
    """The first `size` white-space words that begin at the first hit, or at the start if all fit; hits are marked."""
    words = T.tokens(c)
    hit = lambda w: F.coalesce(F.exists(tokens(w), lambda t: _any([F.startswith(t, F.lit(x)) for x in terms])), F.lit(False))
    places = F.filter(F.transform(words, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull())
    n = F.size(words)
    begin = F.when(n <= size, F.lit(0)).otherwise(F.least(F.coalesce(F.get(places, F.lit(0)), F.lit(0)), F.greatest(n - size, F.lit(0))))
    shown = F.transform(F.slice(words, begin + 1, F.lit(size)), lambda w: F.when(hit(w), F.concat(F.lit(mark[0]), w, F.lit(mark[1]))).otherwise(w))
    return F.concat(F.when(begin > 0, mark[2]).otherwise(""), F.array_join(shown, " "), F.when(begin + size < n, mark[2]).otherwise(""))


def search_state(scans: DataFrame, pages: DataFrame) -> DataFrame:
    """scan_id and state: indexed, empty (no text) or error (no page text at all)."""
    text = pages.groupBy("scan_id").agg(F.max(F.length(T.normalize_spaces(F.coalesce("text", F.lit(""))))).alias("n"))
    met = scans.select(F.col("id").alias("scan_id")).join(text, "scan_id", "left")
    return met.select("scan_id", F.when(F.col("n").isNull(), "error").when(F.col("n") == 0, "empty").otherwise("indexed").alias("state"))


def dictionary(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """word, language (null): the distinct tokens of a text column."""
    return texts.select(F.explode(tokens(F.col(text_col))).alias("word")).distinct()


def load_dictionary(spark, path: str) -> DataFrame:
    """Words of a plain or gzipped list: trimmed, lower case, without blank and # lines."""
    lines = spark.read.text(path).select(F.lower(T.jtrim(F.col("value"))).alias("word"))
    return lines.where((F.col("word") != "") & ~F.startswith("word", F.lit("#"))).distinct()


def unknown_words(words: DataFrame, known: DataFrame) -> DataFrame:
    """Words (column w) whose cleaned lower-case form has two characters or more and is not in the dictionary (word)."""
    cleaned = words.withColumn("word", F.lower(T.clean_word(F.col("w")))).where(F.length("word") >= 2)
    return cleaned.join(known, "word", "left_anti")


def corrections(words: DataFrame, known: DataFrame) -> DataFrame:
    """w and corrected for distinct words outside the dictionary that one substitution or pair brings into it.

    The candidates of each word are looked up with one join, and the first in order wins.
    """
    unknown = unknown_words(words.select("w").distinct(), known).select("w", T.clean_word(F.col("w")).alias("clean"))
    tried = unknown.select("w", "clean", F.posexplode(T.candidates(F.col("clean"))).alias("nth", "candidate"))
    found = tried.withColumn("word", F.lower("candidate")).join(known, "word", "left_semi")
    best = found.groupBy("w", "clean").agg(F.min_by("candidate", "nth").alias("candidate"))
    return best.select("w", T.put_back(F.col("w"), F.col("clean"), F.col("candidate")).alias("corrected"))


def correct_words(words: DataFrame, known: DataFrame) -> DataFrame:
    """words (w, conf on 0..100) with column corrected: gated standard rules, then the dictionary."""
    fixed = words.withColumn("standard", T.fix_word(F.col("w"), F.col("conf")))
    gated = fixed.where("conf < 85").select(F.col("standard").alias("w"))
    looked_up = corrections(gated, known).select(F.col("w").alias("standard"), F.col("corrected").alias("looked_up"))
    return fixed.join(looked_up, "standard", "left").withColumn("corrected", F.when(F.col("conf") >= 85, F.col("w")).otherwise(F.coalesce("looked_up", "standard"))).drop("standard", "looked_up")


def suggestions(words: DataFrame, known: DataFrame, most: int = 5, least: float = 0.6, span: int = 2) -> DataFrame:
    """w, suggestion, score, place: the most similar dictionary words of each distinct word, at most `most`.

    Words as similar as that differ by d = (1 - least) * length at most, so one of d + 1 pieces of the dictionary word
    is in the other word, moved by no more than the differences before and after it allow: the join is on both
    lengths and such a piece, and loses nothing. Only pairs that share a piece are measured, each once.
    """
    keyed = words.select("w").distinct().select("w", T.suggestion_key(F.col("w")).alias("key")).where("key <> ''")
    theirs = known.select("word", T.suggestion_key(F.col("word")).alias("other")).where("other <> ''").groupBy("other").agg(F.min("word").alias("word"))
    lengths = lambda c: F.explode(F.sequence(F.greatest(F.length(c) - span, F.lit(1)), F.length(c) + span))
    left = keyed.select("key").distinct().select("key", F.length("key").alias("n"), lengths("key").alias("m"))
    right = theirs.select("other", F.length("other").alias("m"), lengths("other").alias("n"))
    may, moved = _pieces(least)
    left = left.select("key", "n", "m", F.explode(F.flatten(F.transform(may, lambda p: F.transform(moved(p), lambda at: F.struct(p["i"].alias("i"), F.substr("key", at + 1, p["size"]).alias("piece")))))).alias("p"))
    right = right.select("other", "n", "m", F.explode(F.transform(may, lambda p: F.struct(p["i"].alias("i"), F.substr("other", p["start"] + 1, p["size"]).alias("piece")))).alias("p"))
    met = left.join(right, ["n", "m", "p"]).where(F.col("key") != F.col("other")).select("key", "other").distinct()
    longest = F.greatest(F.length("key"), F.length("other"))
    distance = F.expr(f"levenshtein(key, other, cast(ceil({1 - least} * greatest(length(key), length(other))) AS int))")
    near = met.withColumn("distance", distance).where("distance >= 0").withColumn("score", 1 - F.col("distance") / longest).where(F.col("score") >= least)
    scored = near.join(theirs, "other").select("key", "word", "score")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.abs(F.length("word") - F.length("key")), "word")
    ranked = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return keyed.join(ranked, "key").select("w", F.col("word").alias("suggestion"), "score", "place")


def _pieces(least: float) -> tuple[Column, Callable[[Column], Column]]:
    """For words of n and m characters (columns): the pieces (i, start, size) of the latter, and where a piece may begin in the former."""
    n, m = F.col("n"), F.col("m")
    d = F.floor(F.greatest(n, m) * F.lit(1 - least) + 1e-9).cast("int")
    small = F.floor(m / (d + 1)).cast("int")
    # the last `more` pieces have one character more than the others
    more = m - small * (d + 1)
    plain = d + 1 - more
    one = lambda i: F.struct(i.alias("i"), (i * small + F.greatest(i - plain, F.lit(0))).alias("start"), (small + (i >= plain).cast("int")).alias("size"))
    pieces = F.transform(F.sequence(F.lit(0), d), one)

    def moved(p: Column) -> Column:
        low = F.greatest(-p["i"], n - m - (d - p["i"]), -p["start"])
        high = F.least(p["i"], n - m + (d - p["i"]), n - p["size"] - p["start"])
        return F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda k: p["start"] + k)).otherwise(F.array().cast("array<int>"))

    return pieces, moved


def has_table(spark, name: str) -> bool:
    """Whether the catalog has a search table of that name."""
    return spark.catalog.tableExists(name)


def update_index(postings: DataFrame, lengths: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index with the pages of changed (scan_id, page_index, text) put in place of what they had; a null text takes a page out."""
    keys = ["scan_id", "page_index"]
    new_postings, new_lengths = index(changed.where("text IS NOT NULL"))
    gone = changed.select(*keys).distinct()
    return postings.join(gone, keys, "left_anti").select(*postings.columns).unionByName(new_postings), lengths.join(gone, keys, "left_anti").select(*lengths.columns).unionByName(new_lengths)


def has_dictionary(spec: Column, languages: Sequence[str]) -> Column:
    """Some language of a+b has a dictionary."""
    return F.exists(F.split(spec, "[+]"), lambda x: F.trim(x).isin(*languages))


def valid_words(words: DataFrame, known: DataFrame) -> DataFrame:
    """Adds valid: the word (column w) is in its language's dictionary (lang, word), or that has none."""
    there = known.select("lang").distinct().withColumn("has", F.lit(True))
    listed = known.select("lang", "word").distinct().withColumn("hit", F.lit(True))
    met = words.withColumn("word", F.lower("w")).join(there, "lang", "left").join(listed, ["lang", "word"], "left")
    return met.withColumn("valid", F.col("has").isNull() | F.coalesce("hit", F.lit(False))).drop("word", "has", "hit")
