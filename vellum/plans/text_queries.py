"""Queries of the text functions with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.plans import model as M

FOLD = f"translate({{}}, '{T.LATIN[:26]}', '{T.LATIN[26:]}')"
JTRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
NORMAL = r"trim(regexp_replace(replace({}, chr(160), ' '), '[ \t\n\r\f\v]+', ' ', 'g'))"
DISTINCT = "d AS (SELECT DISTINCT w FROM words)"


def _distinct(spark: SparkSession, sf: str) -> DataFrame:
    return M.words(spark, sf).select("w").distinct()


def _apply(f):
    def query(spark, sf):
        return _distinct(spark, sf).select("w", f(F.col("w")).alias("result"))

    return query


def text_normalize_hash(spark, sf):
    t = T.normalize_spaces(F.col("text"))
    return M.table(spark, sf, "documents").select("doc_id", F.length(t).alias("n"), F.sha2(t, 256).alias("sha"))


def fts_sanitize(spark, sf):
    return M.table(spark, sf, "benchmark").select("item_id", T.fts_query(F.concat(F.lit("  Foo AND b@r "), "text", F.lit(" NOT or\tbaz_1-x "))).alias("query"))


def like_search(spark, sf):
    """Scans whose text holds a pattern, A-Z folded, newest first, 50 at most."""
    pattern = T.ascii_fold(T.like_pattern(F.lit("  THE   of ")))
    hit = M.page_text(spark, sf).where(F.like(T.ascii_fold(F.col("text")), pattern, F.lit("\\")))
    s = M.scans(spark, sf)
    return hit.join(s, hit["scan_id"] == s["id"]).select("scan_id", "title", "created_at", "page_index", F.lit(0.0).alias("rank")).orderBy(F.desc("created_at"), "scan_id").limit(50)


def words_fixed(spark, sf):
    """Confidence-gated correction of every word, as counts by document."""
    w = M.words(spark, sf).withColumn("fixed", T.fix_word(F.col("w"), F.col("conf")))
    return w.groupBy("doc_id").agg(F.count("*").alias("words"), F.count_if(F.col("w") != F.col("fixed")).alias("changed"), F.sum(F.length("fixed")).alias("chars"))


def quality_stats(spark, sf):
    """Mean, upper median, share below 70 and the first 20 such words of each document."""
    w = M.words(spark, sf)
    low = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("conf") < 70, F.struct("pos", "w")))), 1, 20), lambda x: x["w"])
    all_ = F.array_sort(F.collect_list("conf"))
    return w.groupBy("doc_id").agg(
        F.round(F.avg("conf"), 6).alias("mean"), F.get(all_, F.floor(F.size(all_) / 2).cast("int")).alias("median"), F.count_if(F.col("conf") < 70).alias("low"),
        F.count("*").alias("words"), F.round(F.count_if(F.col("conf") < 70) / F.count("*"), 6).alias("low_ratio"), F.array_join(low, " ").alias("suspicious"),
    )


def case_patterns(spark, sf):
    words = _distinct(spark, sf).select("w", F.reverse("w").alias("r"), F.upper("w").alias("u"), F.initcap("w").alias("i"))
    return words.select("w", *(T.case_like(F.col(c), F.col("r")).alias(f"as_{c}") for c in ("w", "u", "i")))


def candidate_counts(spark, sf):
    c = T.candidates(T.clean_word(F.col("w")))
    return _distinct(spark, sf).select("w", F.size(c).alias("n"), F.sha2(F.array_join(c, "/"), 256).alias("sha"))


def whitelist_filter(spark, sf):
    return M.table(spark, sf, "documents").select("doc_id", *(F.length(T.keep_listed(F.col("text"), T.whitelist(s))).alias(k) for k, s in (("eng", "eng"), ("deu_fra", "deu+fra"), ("all_", None))))


def strip_tags(spark, sf):
    return M.table(spark, sf, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


def entities(spark, sf):
    t = F.concat(F.lit("&lt;b&gt; &amp;lt; &quot;x&apos;&nbsp;"), "html")
    return M.table(spark, sf, "pages").select("page_id", T.decode_named(t).alias("decoded"))


def entities_numeric(spark, sf):
    t = F.concat(F.lit("&#39;&#x41;&#128512; "), F.col("page_id").cast("string"))
    return M.table(spark, sf, "pages").select("page_id", T.decode_entities(t).alias("narrow"), T.decode_numeric_wide(t).alias("wide"))


def directions(spark, sf):
    docs = M.table(spark, sf, "documents")
    t = F.concat("text", F.when(F.col("doc_id") % 2 == 0, F.repeat(F.lit("שלום עולם عربي "), 100)).otherwise(F.lit("")))
    return docs.select("doc_id", T.is_rtl(t).alias("rtl"), T.direction_of(F.element_at(F.array(*map(F.lit, ["AR", "heb", "en", "de"])), (F.col("doc_id") % 4 + 1).cast("int"))).alias("direction"), F.reverse(t).alias("reversed"))


def safe_texts(spark, sf):
    return M.table(spark, sf, "conversations").select("conv_id", "turn", T.safe_text(F.concat(F.lit("\x01a\tb\x7f\r\n"), "text")).alias("safe"), T.eval_text(F.concat(F.lit(" \r\na\rb\r\n"), "text", F.lit("\n "))).alias("eval"))


def file_names(spark, sf):
    p = M.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "([^/]*)$", 1).alias("name"))
    return p.select("page_id", T.without_extension(F.col("name")).alias("stem"), T.needs_extension(F.col("name"), F.lit(".HTML")).alias("needs"))


def language_maps(spark, sf):
    langs = M.table(spark, sf, "documents").select("lang").distinct()
    more = spark.createDataFrame([(x,) for x in ("nb", "ZH", "xx", "tr")], "lang string")
    l = F.col("lang")
    spec = F.concat(l, F.lit("+tha+ +x"))
    return langs.union(more).distinct().select("lang", T.dictionary_language(l).alias("dictionary"), T.effective_language(F.lit(" "), l).alias("effective"), T.is_word_based(spec).alias("word_based"), F.array_join(T.first_languages(spec), ",").alias("first"))


def cer_scores(spark, sf):
    """Character error rate of each conversation turn against its lower-cased form."""
    return M.spread(M.table(spark, sf, "conversations")).select("conv_id", "turn", F.round(T.cer(F.col("text"), F.lower("text")), 6).alias("cer"))


def wer_scores(spark, sf):
    c = M.spread(M.table(spark, sf, "conversations"))
    return c.select("conv_id", "turn", F.round(T.wer(F.col("text"), F.lower("text")), 6).alias("wer"))


QUERIES = {
    "text_normalize_hash": text_normalize_hash, "fts_sanitize": fts_sanitize, "like_search": like_search, "ligatures": _apply(T.fix_ligatures), "context_fix": _apply(T.fix_in_context),
    "numeric_sequence": _apply(T.is_numeric_sequence), "clean_words": _apply(T.clean_word), "german_fix": _apply(lambda c: T.fix_german(F.concat(c, F.lit("aBc")))), "words_fixed": words_fixed,
    "quality_stats": quality_stats, "case_patterns": case_patterns, "candidate_counts": candidate_counts, "whitelist_filter": whitelist_filter, "strip_tags": strip_tags, "entities": entities,
    "entities_numeric": entities_numeric, "directions": directions, "safe_texts": safe_texts, "file_names": file_names, "language_maps": language_maps, "cer_scores": cer_scores, "wer_scores": wer_scores,
}

LIG = "CASE WHEN length(w) >= 3 AND regexp_matches(w, '[a-zA-Z]') THEN " + "replace(" * 6 + "w" + "".join(f", '{a}', '{b}')" for a, b in T.LIGATURES) + " ELSE w END"
DIG, LET = r"coalesce(regexp_matches({}, '^\p{{Nd}}$'), false)", r"coalesce(regexp_matches({}, '^\p{{L}}$'), false)"
NUMERIC = r"(len(regexp_extract_all(w, '\p{Nd}')) > 2 * len(regexp_extract_all(w, '\p{L}')) AND len(regexp_extract_all(w, '\p{Nd}')) >= 2)"
# the word's characters with their neighbours, by joins of rows rather than by a lambda over positions; every rule needs a digit somewhere
CONTEXT = f"""digits AS MATERIALIZED (SELECT w, {NUMERIC} AS numeric FROM src WHERE length(w) >= 2 AND regexp_matches(w, '\\p{{Nd}}')),
chars AS (SELECT w, numeric, unnest(string_split(w, '')) AS c, unnest(range(length(w))) AS i FROM digits),
near AS (SELECT *, lag(c) OVER (PARTITION BY w ORDER BY i) AS p, lead(c) OVER (PARTITION BY w ORDER BY i) AS n FROM chars),
fixed AS (SELECT w, string_agg(CASE WHEN {DIG.format('p')} AND {DIG.format('n')} THEN translate(c, '{T.LETTER_AS_DIGIT[0]}', '{T.LETTER_AS_DIGIT[1]}')
    WHEN {LET.format('p')} AND {LET.format('n')} THEN translate(c, '{T.DIGIT_AS_LETTER[0]}', '{T.DIGIT_AS_LETTER[1]}')
    WHEN ((i = 0 AND {DIG.format('n')}) OR (i = length(w) - 1 AND {DIG.format('p')})) AND NOT {DIG.format('c')} AND numeric THEN translate(c, '{T.LETTER_AS_DIGIT[0]}', '{T.LETTER_AS_DIGIT[1]}')
    ELSE c END, '' ORDER BY i) AS result FROM near GROUP BY w)"""
CASED = "CASE WHEN {s} = '' OR r = '' THEN r WHEN {s} = upper({s}) THEN upper(r) WHEN {s} = lower({s}) THEN lower(r) WHEN regexp_matches({s}, '^\\p{{Lu}}') THEN concat(upper(left(r, 1)), lower(substr(r, 2))) ELSE lower(r) END"
W = M.with_
ORACLE_SQL = {
    "text_normalize_hash": f"SELECT doc_id, CAST(length(t) AS INTEGER) AS n, sha256(t) AS sha FROM (SELECT doc_id, {NORMAL.format('text')} AS t FROM documents) AS x",
    "fts_sanitize": r"""SELECT item_id, array_to_string(list_transform(list_filter(list_transform(string_split(trim(regexp_replace(concat('  Foo AND b@r ', text, ' NOT or', chr(9), 'baz_1-x '), '[ \t\n\r]+', ' ', 'g')), ' '),
        lambda t: regexp_replace(t, '[^\p{L}\p{N}_-]', '', 'g')), lambda t: t <> '' AND upper(t) NOT IN ('AND', 'OR', 'NOT')), lambda t: concat(t, '*')), ' ') AS query FROM benchmark""",
    "like_search": W(M.SCANS, M.PAGE_TEXT) + f"SELECT scan_id, title, created_at, page_index, CAST(0 AS DOUBLE) AS rank FROM page_text JOIN scans ON scan_id = id WHERE {FOLD.format('text')} LIKE '%the of%' ORDER BY created_at DESC, scan_id LIMIT 50",
    "ligatures": W(M.WORDS, DISTINCT) + f"SELECT w, {LIG} AS result FROM d",
    "context_fix": W(M.WORDS, "src AS (SELECT DISTINCT w FROM words)", CONTEXT) + "SELECT src.w, coalesce(result, src.w) AS result FROM src LEFT JOIN fixed ON src.w = fixed.w",
    "numeric_sequence": W(M.WORDS, DISTINCT) + f"SELECT w, {NUMERIC} AS result FROM d",
    "clean_words": W(M.WORDS, DISTINCT) + r"SELECT w, regexp_replace(w, '^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$', '', 'g') AS result FROM d",
    "words_fixed": W(M.WORDS, f"lig AS (SELECT *, {LIG} AS l FROM words)", "src AS (SELECT DISTINCT l AS w FROM lig)", CONTEXT) + """SELECT doc_id, count(*) AS words, count(*) FILTER (WHERE w <> f) AS changed, CAST(sum(length(f)) AS BIGINT) AS chars FROM
        (SELECT doc_id, lig.w, CASE WHEN conf >= 85 THEN lig.w WHEN conf >= 70 THEN l ELSE coalesce(result, l) END AS f FROM lig LEFT JOIN fixed ON l = fixed.w) AS x GROUP BY doc_id""",
    "quality_stats": W(M.WORDS, "ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY conf) AS r, count(*) OVER (PARTITION BY doc_id) AS n, sum(CASE WHEN conf < 70 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM words)") + """SELECT doc_id, round(avg(conf), 6) AS mean,
        max(CASE WHEN r = n // 2 + 1 THEN conf END) AS median, count(*) FILTER (WHERE conf < 70) AS low, count(*) AS words, round(count(*) FILTER (WHERE conf < 70) / count(*), 6) AS low_ratio,
        coalesce(string_agg(CASE WHEN conf < 70 AND k <= 20 THEN w END, ' ' ORDER BY pos), '') AS suspicious FROM ranked GROUP BY doc_id""",
    "whitelist_filter": "SELECT doc_id, " + ", ".join("CAST(length(regexp_replace(text, '[^\\s" + "".join(f"\\x{{{ord(c):X}}}" for c in T.whitelist(s)) + f"]', '', 'g')) AS INTEGER) AS {k}" for k, s in (("eng", "eng"), ("deu_fra", "deu+fra"), ("all_", None))) + " FROM documents",
    "entities": "SELECT page_id, replace(replace(replace(replace(replace(replace(concat('&lt;b&gt; &amp;lt; &quot;x&apos;&nbsp;', html), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' ') AS decoded FROM pages",
    "entities_numeric": "SELECT page_id, concat('''A', chr(62976), ' ', page_id) AS narrow, concat('''A', chr(128512), ' ', page_id) AS wide FROM pages",
    "safe_texts": r"SELECT conv_id, turn, regexp_replace(concat(chr(1), 'a', chr(9), 'b', chr(127), chr(13), chr(10), text), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', ' ', 'g') AS safe, " + JTRIM.format(r"regexp_replace(concat(' ', chr(13), chr(10), 'a', chr(13), 'b', chr(13), chr(10), text, chr(10), ' '), '\r\n?', chr(10), 'g')") + " AS eval FROM conversations",
    "file_names": r"SELECT page_id, CASE WHEN length(name) > 1 AND regexp_matches(substr(name, 2), '[.][^.]+$') THEN concat(left(name, 1), regexp_replace(substr(name, 2), '[.][^.]+$', '')) ELSE name END AS stem, NOT ends_with(lower(name), '.html') AS needs FROM (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages) AS x",
    "language_maps": "WITH l AS (SELECT DISTINCT lang FROM documents UNION SELECT * FROM (VALUES ('nb'), ('ZH'), ('xx'), ('tr')) AS v(lang)), m AS (SELECT lang, CASE lower(lang) WHEN 'zh' THEN 'chi_sim' " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items()) + " ELSE 'eng' END AS dictionary FROM l) SELECT lang, dictionary, dictionary AS effective, true AS word_based, concat(lang, ',tha') AS first FROM m",
    "cer_scores": f"SELECT conv_id, turn, round(CASE WHEN length(text) = 0 THEN 0 ELSE levenshtein({M.BYTES.format('text')}, {M.BYTES.format('lower(text)')}) / length(text) END, 6) AS cer FROM conversations",
    "case_patterns": W(M.WORDS, DISTINCT, "v AS (SELECT w, reverse(w) AS r, upper(w) AS u FROM d)") + "SELECT w, " + ", ".join(f"{CASED.format(s=s)} AS as_{s}" for s in ("w", "u")) + " FROM v",
}
del ORACLE_SQL["case_patterns"]  # initcap has no equal there; tested on goldens
