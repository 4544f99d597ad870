"""Secret scan: fixed patterns, and character Markov models for strings that no pattern names.

Two first-order Markov chains over characters are trained from labelled samples, one from random strings and
one from ordinary identifiers and words; a long run of key characters is a secret if the log-likelihood ratio
of the two is above a threshold, which samples kept out of the training set: at most `wrong` of the ordinary ones
are above it. Everything is built-in DataFrame functions: a text is split at a pattern's matches, and running sums of
the lengths of the pieces give the matches' places in code points.

A run is scored whole, also where a base span covers a part of it; one that lies within a base span adds nothing.
Null text counts as empty and has no spans. Rows that repeat are kept. Other columns are ignored by scan() and
kept by redact(), whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import fresh

KINDS = ("assign", "access", "hex", "markov")
#: Pattern of each base kind, the group whose length counts, and the least length.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: A run of 16 characters at least that neither begins nor ends with a dot.
CANDIDATE = r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_=.-]{14,}[A-Za-z0-9+/_=-]"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
WORDS = "get set user name file path index count value config request response session account order item list page text image token key data type state update create delete read write load save parse format check test build cache queue event time date size width height color field table column row".split()


@dataclass
class Ratios:
    """pairs: log-likelihood ratio, random over ordinary, of each pair of adjacent characters. recall, wrong: shares of the random and
    of the ordinary samples kept out of the training whose summed ratio is above the threshold."""

    pairs: list[float]
    threshold: float
    recall: float = 0.0
    wrong: float = 0.0


def _code(char: str) -> str:
    """SQL: number of a character in ALPHABET, from 0."""
    codes = [max(0, ALPHABET.find(chr(c))) for c in range(128)]
    return f"element_at(from_json('{json.dumps(codes)}', 'array<int>'), ascii({char}) + 1)"


def _pairs(text: str) -> str:
    """SQL: numbers of a string's adjacent character pairs, from 1."""
    codes = f"transform(split({text}, ''), c -> {_code('c')})"
    return f"zip_with(slice({codes}, 1, length({text}) - 1), slice({codes}, 2, length({text}) - 1), (a, b) -> a * {len(ALPHABET)} + b + 1)"


def labelled_samples(docs: DataFrame, text_col: str = "text", documents: int = 2_000, strings: int = 4_000) -> DataFrame:
    """sample, random: `strings` made strings of each label, and the words of `documents` documents as ordinary ones.

    The sample is bounded by these two parameters; documents are chosen by the hash of their text.
    """
    spark = docs.sparkSession
    digest = "sha2(cast(concat('vellum', id) AS binary), 512)"
    random = spark.range(strings, numPartitions=1).selectExpr(
        f"""translate(CASE id % 4 WHEN 0 THEN substr({digest}, 1, 20 + cast(id % 45 AS int))
                WHEN 1 THEN substr(base64(unhex({digest})), 1, 20 + cast(id % 60 AS int))
                WHEN 2 THEN substr(replace(upper(base64(unhex({digest}))), '/', ''), 1, 20)
                ELSE concat(substr('key_sk_pk_', 1 + 3 * cast(id % 3 AS int), 3), substr(translate(base64(unhex({digest})), '+/=', ''), 1, 32)) END, chr(10), '') AS sample""",
        "true AS random",
    )
    stock = f"split('{' '.join(WORDS)}', ' ')"
    pick = lambda k: f"element_at({stock}, 1 + cast(pmod(xxhash64(id, {k}), {len(WORDS)}) AS int))"
    ordinary = spark.range(strings, numPartitions=1).selectExpr(
        f"""CASE id % 8 WHEN 0 THEN concat_ws('_', {pick(1)}, {pick(2)}, {pick(3)}) WHEN 1 THEN concat({pick(1)}, initcap({pick(2)}), initcap({pick(3)}))
                WHEN 2 THEN upper(concat_ws('_', {pick(1)}, {pick(2)}, {pick(3)})) WHEN 3 THEN concat_ws('/', {pick(1)}, {pick(2)}, concat({pick(3)}, CASE WHEN id % 2 = 0 THEN '-' ELSE '.' END, pmod(xxhash64(id), 100)))
                WHEN 4 THEN concat_ws('.', {pick(1)}, {pick(2)}, {pick(3)}, {pick(4)})
                WHEN 5 THEN concat_ws('-', {pick(1)}, {pick(2)}, {pick(3)}, {pick(4)})
                WHEN 6 THEN repeat(substr('+/_=-.', 1 + cast(pmod(xxhash64(id, 5), 6) AS int), 1), 16 + cast(id % 45 AS int))
                ELSE concat_ws('-', 2000 + id % 30, lpad(1 + id % 12, 2, '0'), lpad(1 + id % 28, 2, '0'), {pick(1)}) END AS sample""",
        "false AS random",
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = docs.select(F.xxhash64(text).alias("h"), text.alias("t"))
    # the hashes alone are compared; only texts below the last one that is taken are moved, and of copies one
    last = hashed.select("h").distinct().orderBy("h").limit(documents).agg(F.max("h")).first()[0]
    chosen = hashed.where(F.col("h") <= F.lit(last).cast("long")).groupBy("h").agg(F.min("t").alias("t"))
    words = chosen.select(F.explode(F.regexp_extract_all("t", F.lit(r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z_-]{3,}(?![A-Za-z0-9])"), F.lit(0))).alias("sample"), F.lit(False).alias("random"))
    return random.unionByName(ordinary).unionByName(words)


def train(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratio, random over ordinary, of each pair of adjacent characters.

    A pair that neither label has seen counts as even.
    """
    n = len(ALPHABET)
    counts = {True: [0] * n * n, False: [0] * n * n}
    for r in samples.where(F.length("sample") > 1).select("random", F.explode(F.expr(_pairs("sample"))).alias("pair")).groupBy("random", "pair").count().collect():
        counts[r["random"]][r["pair"] - 1] = r["count"]
    logs = {}
    for label, c in counts.items():
        rows = [sum(c[a * n : a * n + n]) for a in range(n)]
        logs[label] = [math.log((c[k] + smooth) / (rows[k // n] + smooth * n)) for k in range(n * n)]
    return [round(a - b, 3) for a, b in zip(logs[True], logs[False], strict=True)]


def _running(array: str, op: str = "a + b") -> str:
    """SQL: sums (or another op) of an array of whole numbers up to each place, by doubling the span that each place covers."""
    step = "shiftleft(1, k)"
    return f"aggregate(sequence(0, cast(log2(size({array})) AS int)), {array}, (s, k) -> zip_with(s, slice(concat(array_repeat(0, {step}), s), 1, size(s)), (a, b) -> {op}))"


def _found(text: str, pattern: str, kind: str, group: int = 0, least: int = 1, above: tuple[list[float], float] | None = None) -> Column:
    """array<struct<start, rank, end, kind, at, to>> of a pattern's matches whose group has `least` characters; at and to are bytes.

    above: ratios of the pairs, and what a match's sum must exceed.
    """
    quoted = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    lengths = lambda array, of: f"transform({array}, x -> {of}(x))"
    places = f"m -> struct(m.hit AS hit, {lengths('m.own', 'length')} AS own, {lengths('m.hit', 'length')} AS n, {lengths('m.hit', 'octet_length')} AS b, {lengths('m.gap', 'length')} AS gap, {lengths('m.gap', 'octet_length')} AS gap_b)"
    found = f"struct(regexp_extract_all({text}, {quoted}, 0) AS hit, regexp_extract_all({text}, {quoted}, {group}) AS own, slice(split({text}, {quoted}, -1), 1, greatest(1, size(split({text}, {quoted}, -1)) - 1)) AS gap)"
    if not group:
        found = found.replace(f"regexp_extract_all({text}, {quoted}, 0) AS own, ", "")
        places = places.replace("m.own", "m.hit")
    ends = lambda n, gap: _running(f"zip_with(m.{n}, m.{gap}, (h, g) -> h + g)")
    high = f" AND {_ratio('m.hit[i]', above[0])} > {above[1]}" if above else ""
    span = f"struct(p.e[i] - m.n[i] AS start, {KINDS.index(kind)} AS rank, p.e[i] AS end, '{kind}' AS kind, p.eb[i] - m.b[i] AS at, p.eb[i] AS to)"
    spans = f"transform(filter(sequence(0, size(m.n) - 1), i -> m.own[i] >= {least}{high}), i -> {span})"
    none = "cast(array() AS array<struct<start: int, rank: int, end: int, kind: string, at: int, to: int>>)"
    once = lambda value, then: f"element_at(transform(array({value}), {then}), 1)"
    whole = once(once(found, places), "m -> " + once(f"struct({ends('n', 'gap')} AS e, {ends('b', 'gap_b')} AS eb)", f"p -> {spans}"))
    return F.expr(f"CASE WHEN {text} RLIKE {quoted} THEN {whole} ELSE {none} END")


def with_spans(df: DataFrame, ratios: Ratios, text: str, base: str, more: str) -> DataFrame:
    """Adds columns base and more: spans (start, rank, end, kind, at, to) of the patterns and of the Markov models, by start.

    text: name of a string column without nulls. No Markov span lies within a base span.
    """
    found = [_found(text, p, kind, group, least) for kind, (p, group, least) in BASE.items()]
    markov = _found(text, CANDIDATE, "markov", above=(ratios.pairs, ratios.threshold))
    out = df.withColumn(base, F.array_sort(F.concat(*found))).withColumn(more, markov)
    return out.withColumn(more, F.expr(f"filter({more}, s -> NOT exists({base}, b -> b.start <= s.start AND s.end <= b.end))"))


def _ratio(string: str, pairs: list[float]) -> str:
    """SQL: summed log-likelihood ratio of a string."""
    table = f"from_json('{json.dumps(pairs)}', 'array<double>')"
    return f"element_at(transform(array({string}), t -> aggregate({_pairs('t')}, 0D, (a, p) -> a + element_at({table}, p))), 1)"


def scan(df: DataFrame, ratios: Ratios, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, added: arrays of struct<start, end, kind> in code points."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("whole"))
    plain = lambda c: F.expr(f"transform({c}, s -> struct(s.start AS start, s.end AS end, s.kind AS kind))")
    return with_spans(rows, ratios, "whole", "base", "more").select(id_col, plain("base").alias("base"), plain("more").alias("added"))


def digests(df: DataFrame, ratios: Ratios, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("whole"))
    found = with_spans(rows, ratios, "whole", "base", "more")
    n = lambda kind: F.expr(f"size(filter(base, s -> s.kind = '{kind}'))").cast("long").alias(f"n_{kind}")
    joined = lambda spans: f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    return found.select(
        id_col, n("assign"), n("access"), n("hex"), F.sha2(F.expr(joined("base")), 256).alias("base_sha256"), F.expr(joined("array_sort(concat(base, more))")).alias("spans")
    )


def redact(df: DataFrame, ratios: Ratios, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows with each span of the text replaced by mark (overlapping spans by one); null text stays null."""
    whole, base, more, spans = fresh(df, "whole", "base", "more", "spans")
    found = with_spans(df.withColumn(whole, F.coalesce(F.col(text_col), F.lit(""))), ratios, whole, base, more)
    found = found.withColumn(spans, F.array_sort(F.concat(base, more)))
    # a span opens a mark if it begins at or after the ends of all before it; the text up to it follows the furthest of these (in bytes, as
    # places of characters in a long text are slow to find)
    before = "coalesce(get(x.ends, i - 1), 0)"
    gap = lambda since, upto: f"cast(substring(x.bytes, {since} + 1, {upto}) AS string)"
    pieces = f"transform({spans}, (s, i) -> CASE WHEN i > 0 AND s.at < {before} THEN '' ELSE concat({gap(before, f's.at - {before}')}, '{mark}') END)"
    held = f"struct({_running(f'transform({spans}, s -> s.to)', 'greatest(a, b)')} AS ends, cast({whole} AS binary) AS bytes)"
    clean = f"element_at(transform(array({held}), x -> concat(array_join({pieces}, ''), {gap('element_at(x.ends, -1)', f'octet_length({whole})')})), 1)"
    return found.withColumn(text_col, F.when(F.size(spans) > 0, F.expr(clean)).otherwise(F.col(text_col))).drop(whole, base, more, spans)


def trained(docs: DataFrame, text_col: str = "text", wrong: float = 0.0005, least: float = 16.0) -> Ratios:
    """Trains on four fifths of the samples; the rest, where long enough to be candidates, gives the threshold, `least` at least."""
    samples = labelled_samples(docs, text_col).withColumn("out", F.pmod(F.xxhash64("sample", F.lit(3)), F.lit(5)) == 0)
    pairs = train(samples.where("NOT out"))
    held = samples.where("out").where(F.col("sample").rlike(f"^{CANDIDATE}$")).select("random", F.expr(_ratio("sample", pairs)).alias("r"))
    at = held.where("NOT random").agg(F.percentile("r", 1 - wrong)).first()[0]
    threshold = round(max(least, at or 0.0), 3)
    found = dict(held.groupBy("random").agg(F.avg((F.col("r") > threshold).cast("int"))).collect())
    return Ratios(pairs, threshold, found.get(True, 0.0), found.get(False, 0.0))
