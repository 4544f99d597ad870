"""Tables written in a format of the library and read back, an index kept up to date, and words checked by language; with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vellum.operators import search as S
from vellum.plans import model as M
from vellum.plans import search_queries as SQ
from vellum.sources import documents as R
from vellum.sources import tables

W = M.with_


def _folder(spark, name):
    return f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def word_lists(spark, sf):
    """The documents' words as JSON lists, written, read back and parsed."""
    path = _folder(spark, "word-lists")
    # small groups of rows, as a reader holds a whole one of long texts in memory
    R.words_json(M.words(spark, sf), "doc_id").write.option("compression", "zstd").option("parquet.block.size", 4 << 20).parquet(path)
    # a document is one row from its list on, so no words are shuffled
    read = R.parse_word_lists(spark.read.parquet(path), "json")
    total = lambda c: F.aggregate(F.col("words")[c], F.lit(0.0), lambda s, v: s + v)
    n = F.size("words")
    found = F.struct(n.cast("long").alias("n"), *(total(c).alias(f"{c}s") for c in ("left", "bottom")), F.round(total("conf01") / n, 4).alias("conf"), F.md5(F.array_join(F.col("words")["w"], " ")).alias("words"))
    return read.select("doc_id", F.inline_outer(F.when(n > 0, F.array(found)))).where("n IS NOT NULL")


def label_lines(spark, sf):
    """Corner labels of the events as JSON lines with broken lines among them, read back: what parses, with its corners in their order."""
    path = _folder(spark, "label-lines")
    x, y = F.col("event_id") % 100, F.col("event_id") % 70
    corner = lambda a, b: F.array((x + a).cast("double"), (y + b).cast("double"))
    rows = M.table(spark, sf, "events").select(F.concat(F.lit("i"), F.col("event_id").cast("string")).alias("image"), F.array(corner(0, 0), corner(10, 0), corner(10, 10), corner(0, 10)).alias("corners_px"), F.when(F.col("event_id") % 5 > 0, "ok").alias("note"))
    R.write_lines(rows, f"{path}/good")
    R.write_texts(rows.where("note IS NULL").select(F.concat(F.lit('{"image": "'), F.col("image")).alias("text")), f"{path}/broken")
    read = R.read_labels(spark, f"{path}/*", "image string, corners_px array<array<double>>, note string")
    return read.select("image", F.size("corners_px").alias("n"), F.col("corners_px")[2][0].alias("right"), F.col("corners_px")[2][1].alias("bottom"), "note")


def frame_labels(spark, sf):
    """Labels of the events' frames in a gzipped CSV, read back: the corners in another order, every third frame of two backgrounds."""
    path = _folder(spark, "frame-labels")
    e = M.table(spark, sf, "events").where("event_id IS NOT NULL")
    at = {"tl": (0, 0), "bl": (0, 9), "br": (9, 9), "tr": (9, 0)}
    corners = [(F.col("event_id") % 50 + d + 0.5).alias(f"{p}_{c}") for p, xy in at.items() for c, d in zip("xy", xy, strict=True)]
    names = [F.concat(F.lit("background0"), (F.col("event_id") % 3).cast("string")).alias("bg_name"), F.lit("paper").alias("model_name"), F.col("event_id").cast("int").alias("frame_index"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("image_path")]
    e.select(*names, *corners).write.option("header", True).option("compression", "gzip").csv(path)
    read = R.smartdoc_labels(spark, path, ["background00", "background02"], 3)
    return read.select("image", *(F.col("corners_px")[k][c].alias(f"{n}{k}") for k in range(4) for c, n in ((0, "x"), (1, "y"))))


def index_updates(spark, sf):
    """The documents' index after every tenth document got another text and every tenth lost its own: terms and occurrences of each document."""
    pages = M.page_text(spark, sf).select("scan_id", "page_index", "text")
    k = F.col("scan_id").cast("long") % 10
    changed = pages.where(k.isin(3, 4)).withColumn("text", F.when(k == 3, F.concat(F.lit("New words now "), F.substring("text", 1, 40))))
    postings, lengths = S.update_index(*S.index(pages), changed)
    by_page = postings.groupBy("scan_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("n"), F.max(F.array_max("positions")).alias("last"))
    return by_page.join(lengths.select("scan_id", "length"), "scan_id")


def language_words(spark, sf):
    """Words of each document that its language's dictionary, made of the conversations, has; languages without one pass all."""
    texts = M.table(spark, sf, "documents").select("doc_id", "lang", "text").repartition("doc_id")
    words = texts.select("doc_id", "lang", F.explode(F.filter(F.split("text", r"[ \t\r\n]+"), lambda w: w != "")).alias("w"))
    # a word meets the dictionary once for each document, however often it has it
    docs = words.groupBy("doc_id", "lang", F.lower("w").alias("w")).agg(F.count("*").alias("times"))
    known = M.table(spark, sf, "conversations").select(F.when(F.col("conv_id") % 2 == 0, "en").otherwise("de").alias("lang"), F.explode(F.split(F.lower("text"), r"[ \t\r\n]+")).alias("word"))
    times = F.col("times")
    return S.valid_words(docs, known).groupBy("doc_id", "lang").agg(F.sum(F.when(F.col("valid"), times).otherwise(0)).alias("valid"), F.sum(times).alias("n"))


QUERIES = {f.__name__: f for f in (word_lists, label_lines, frame_labels, index_updates, language_words)}

ORACLE_SQL = {
    "word_lists": W(M.WORDS) + """SELECT doc_id, count(*) AS n, sum("left") AS lefts, sum(bottom) AS bottoms, round(avg(CASE WHEN conf > 1 THEN conf / 100 ELSE conf END), 4) AS conf, md5(string_agg(w, ' ' ORDER BY pos)) AS words FROM words GROUP BY doc_id""",
    "label_lines": "SELECT concat('i', event_id) AS image, 4 AS n, CAST(event_id % 100 + 10 AS DOUBLE) AS \"right\", CAST(event_id % 70 + 10 AS DOUBLE) AS bottom, CASE WHEN event_id % 5 > 0 THEN 'ok' END AS note FROM events",
    "frame_labels": """SELECT concat('f', event_id) AS image, x + 0.5 AS x0, x + 0.5 AS y0, x + 9.5 AS x1, x + 0.5 AS y1, x + 9.5 AS x2, x + 9.5 AS y2, x + 0.5 AS x3, x + 9.5 AS y3
        FROM (SELECT event_id, CAST(event_id % 50 AS DOUBLE) AS x, row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) AS nth FROM events WHERE event_id % 3 <> 1) AS e WHERE (nth - 1) % 3 = 0""",
    "index_updates": f"""WITH t AS (SELECT doc_id, CASE doc_id % 10 WHEN 3 THEN concat('New words now ', substr(text, 1, 40)) ELSE text END AS text FROM documents WHERE doc_id % 10 <> 4), w AS (SELECT doc_id, {SQ.TOKENS} AS ts FROM t),
        u AS (SELECT doc_id, unnest(ts) AS term, unnest(range(len(ts))) AS p FROM w)
        SELECT CAST(doc_id AS VARCHAR) AS scan_id, count(DISTINCT term) AS terms, count(*) AS n, max(p) AS last, count(*) AS length FROM u GROUP BY doc_id""",
    "language_words": """WITH w AS (SELECT doc_id, lang, unnest(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda w: w <> '')) AS w FROM documents),
        k AS (SELECT DISTINCT CASE WHEN conv_id % 2 = 0 THEN 'en' ELSE 'de' END AS lang, unnest(string_split_regex(lower(text), '[ \\t\\r\\n]+')) AS word FROM conversations)
        SELECT doc_id, w.lang AS lang, count(*) FILTER (w.lang NOT IN ('en', 'de') OR k.word IS NOT NULL) AS valid, count(*) AS n FROM w LEFT JOIN k ON w.lang = k.lang AND lower(w.w) = k.word GROUP BY doc_id, w.lang""",
}
