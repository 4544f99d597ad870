"""Readers and writers of the library's files: word lists, reviewed pages, hOCR, registries, labels and texts.

Readers are tolerant as their formats ask: what cannot be read gives no rows or defaults, never a failed job. All of
them go through Spark's own readers, so any store that Spark reaches will do.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import quads as G
from vellum.functions import text as T
from vellum.sources import tables

BOX = "struct<left: double, top: double, right: double, bottom: double>"
PAGE_SCHEMA = """struct<schema: int, imageSize: struct<w: int, h: int>,
    words: array<struct<id: int, t: string, b: array<int>, c: double, e: boolean, l: int, k: int, lang: string>>,
    lines: array<struct<id: int, w: array<int>, b: array<int>>>, blocks: array<struct<id: int, l: array<int>, b: array<int>>>>"""
REGISTRY_ITEM = """struct<id: string, filePath: string, rotationDeg: int, ocrTextPath: string, ocrFormat: string, thumbPath: string,
    createdAt: bigint, widthPx: int, heightPx: int, schemaVersion: int, orientationMode: string>"""
CONTAINERS = ("words", "data", "items", "list", "result")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text (UTF-8) of each file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


# ---- word lists in JSON of several shapes


def _number(v: str, path: str) -> str:
    """SQL: a number, numeric string or boolean of a variant as double, or null."""
    return f"coalesce(try_variant_get({v}, '{path}', 'double'), try_cast(try_variant_get({v}, '{path}', 'string') AS double), cast(cast(try_variant_get({v}, '{path}', 'boolean') AS int) AS double))"


def _box(v: str, names: list[tuple[str, str, str, str]], sized: list[bool]) -> list[str]:
    """SQL: a box for each naming of its sides; sized ones have width and height."""
    out = []
    for (a, b, c, d), wh in zip(names, sized, strict=True):
        x, y, p, q = (_number(v, k) for k in (a, b, c, d))
        right, bottom = (f"{x} + {p}", f"{y} + {q}") if wh else (p, q)
        out.append(f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL AND {p} IS NOT NULL AND {q} IS NOT NULL THEN named_struct('left', {x}, 'top', {y}, 'right', {right}, 'bottom', {bottom}) END")
    return out


def _array_box(v: str, path: str) -> str:
    """SQL: four numbers as left, top, right, bottom if they grow, else as x, y, width, height."""
    a = f"try_variant_get({v}, '{path}', 'array<double>')"
    at = lambda k: f"get({a}, {k})"
    corners = f"named_struct('left', {at(0)}, 'top', {at(1)}, 'right', {at(2)}, 'bottom', {at(3)})"
    sized = f"named_struct('left', {at(0)}, 'top', {at(1)}, 'right', {at(0)} + {at(2)}, 'bottom', {at(1)} + {at(3)})"
    return f"CASE WHEN size({a}) >= 4 AND {at(2)} > {at(0)} AND {at(3)} > {at(1)} THEN {corners} WHEN size({a}) >= 4 THEN {sized} END"


#: Words of the usual shape.
USUAL = "array<struct<text: string, left: double, top: double, right: double, bottom: double, confidence: double>>"
#: In a text of which Spark's reader of JSON and a variant may say different things of a word's text: one that is no string, and keys that may be written with escapes.
UNUSUAL = r'"text"\s*:\s*[^"\s]|\\u'


def parse_word_lists(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Puts words in the place of a JSON text: array<struct<pos, w, left, top, right, bottom, conf01>>, one pass a text and no rows for words; null if the text is no JSON.

    The words are the root array, or the first array under words, data, items, list or result. Boxes come in five
    shapes, tried in order; a word without one is skipped. Entities are decoded, confidence is brought to 0..1.
    A root array whose words all have the usual shape is read at once, any other list word by word.
    """
    boxes = [
        *_box("x", [("$.left", "$.top", "$.right", "$.bottom")], [False]),
        *_box("x", [("$.bbox.left", "$.bbox.top", "$.bbox.right", "$.bbox.bottom"), ("$.bbox.l", "$.bbox.t", "$.bbox.r", "$.bbox.b")], [False, False]),
        *_box("x", [("$.bbox.x", "$.bbox.y", "$.bbox.w", "$.bbox.h"), ("$.bbox.x", "$.bbox.y", "$.bbox.width", "$.bbox.height")], [True, True]),
        _array_box("x", "$.bbox"),
        *_box("x", [("$.x", "$.y", "$.w", "$.h"), ("$.x", "$.y", "$.width", "$.height")], [True, True]),
        *_box("x", [("$.xmin", "$.ymin", "$.xmax", "$.ymax")], [False]),
    ]
    listed = ", ".join(f"try_variant_get(v, '{p}', 'array<variant>')" for p in ("$", *(f"$.{k}" for k in CONTAINERS)))
    # + 0 as a variant has no -0.0
    sides = [f"'{c}', {{0}}.{c} + 0D" for c in ("left", "top", "right", "bottom")]
    one = lambda text, box, conf: f"named_struct('pos', i, 'w', coalesce({text}, ''), {', '.join(sides).format(box)}, 'conf', {conf})"
    usual = f"transform(t, (x, i) -> {one('x.text', 'x', 'x.confidence')})"
    whole = " AND ".join(f"x.{c} IS NOT NULL" for c in ("left", "top", "right", "bottom", "confidence"))
    fit = f"`{text_col}` LIKE '[%' AND NOT `{text_col}` RLIKE r'{UNUSUAL}'"
    any_conf = f"coalesce({_number('x', '$.confidence')}, {_number('x', '$.conf')})"
    boxed = f"get(transform(array(coalesce({', '.join(boxes)})), b -> {one("try_variant_get(x, '$.text', 'string')", 'b', any_conf)}), 0)"
    any_shape = f"filter(transform(coalesce({listed}), (x, i) -> {boxed}), w -> w.left IS NOT NULL)"
    at_once = f"CASE WHEN {fit} THEN from_json(`{text_col}`, '{USUAL}') END"
    # what is no JSON for a variant, as with a key that comes twice, has no words
    parsed = f"get(transform(array(try_parse_json(`{text_col}`)), v -> CASE WHEN v IS NOT NULL THEN get(transform(array({at_once}), t -> CASE WHEN forall(t, x -> {whole}) THEN {usual} ELSE {any_shape} END), 0) END), 0)"
    others, (raw,) = [c for c in df.columns if c != text_col], tables.fresh(df, "raw")
    rows = df.select(*others, F.expr(parsed).alias(raw))
    texts = F.col(raw)["w"]
    decoded = T.decode_numeric_lists(F.when(F.exists(texts, lambda w: w.contains("&#")), texts))

    def word(x: Column, text: Column) -> Column:
        named = F.when(text.contains("&"), T.decode_named(text)).otherwise(text)
        return F.struct(x["pos"].alias("pos"), named.alias("w"), *(x[c].alias(c) for c in ("left", "top", "right", "bottom")), G.confidence01(x["conf"]).alias("conf01"))

    return rows.select(*others, F.zip_with(raw, F.coalesce(decoded, texts), word).alias("words"))


def parse_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The words of parse_word_lists() as rows: pos, w, left, top, right, bottom and conf01; text that is no JSON has none."""
    (words,) = tables.fresh(df, "words")
    parsed = parse_word_lists(df.withColumnsRenamed({"words": words} if "words" != text_col else {}), text_col)
    # outer, as Spark moves a filter on whether there are words to below the parser, which then runs twice
    rows = parsed.select(*(c for c in parsed.columns if c != "words"), F.inline_outer("words")).where("pos IS NOT NULL")
    return rows.withColumnsRenamed({words: "words"})


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return parse_words(whole_files(spark, path))


def _six(c: Column) -> Column:
    """A number with six decimals; most are written without a format to interpret, to the same digits."""
    v = c.cast("double")
    decimals = F.when(v == v.cast("long"), F.concat(v.cast("long").cast("string"), F.lit(".000000"))).otherwise(v.cast("decimal(20,6)").cast("string"))
    return F.when((v >= 0) & (v < 1e12), decimals).otherwise(F.format_string("%.6f", v))


def _quoted(c: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.when(c.rlike(r'["\\\x00-\x1f]'), F.substring(listed, F.lit(2), F.length(listed) - 2)).otherwise(F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null")))


def words_json(words: DataFrame, key: str) -> DataFrame:
    """key and json: the words (pos, w, left, top, right, bottom, conf) as a JSON array, numbers with six decimals."""
    body = F.concat(F.lit('{"text":'), _quoted(F.col("w")), *(x for k, c in (("left", "left"), ("top", "top"), ("right", "right"), ("bottom", "bottom"), ("confidence", "conf")) for x in (F.lit(f',"{k}":'), _six(F.col(c)))), F.lit("}"))
    one = F.sort_array(F.collect_list(F.struct("pos", body.alias("j"))))
    return words.groupBy(key).agg(F.concat(F.lit("["), F.array_join(F.transform(one, lambda x: x["j"]), ","), F.lit("]")).alias("json"))


# ---- reviewed pages


def parse_pages(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds doc, a page with defaults for what is missing; an id that is missing is the place from 1."""
    doc = F.from_json(F.col(text_col), PAGE_SCHEMA)
    word = lambda w, i: F.named_struct(
        F.lit("id"), F.coalesce(w["id"], i + 1), F.lit("t"), F.coalesce(w["t"], F.lit("")), F.lit("b"), F.coalesce(w["b"], F.array(*[F.lit(0)] * 4)), F.lit("c"), F.coalesce(w["c"], F.lit(0.0)),
        F.lit("e"), F.coalesce(w["e"], F.lit(False)), F.lit("l"), F.coalesce(w["l"], F.lit(-1)), F.lit("k"), F.coalesce(w["k"], F.lit(-1)), F.lit("lang"), w["lang"],
    )
    return df.withColumn("raw", doc).withColumn("doc", F.named_struct(
        F.lit("schema"), F.coalesce("raw.schema", F.lit(1)), F.lit("imageSize"), F.col("raw.imageSize"), F.lit("words"), F.transform(F.coalesce("raw.words", F.from_json(F.lit("[]"), "array<struct<id: int, t: string, b: array<int>, c: double, e: boolean, l: int, k: int, lang: string>>")), word),
        F.lit("lines"), F.col("raw.lines"), F.lit("blocks"), F.col("raw.blocks"),
    )).drop("raw")


def page_words(pages: DataFrame, key: str) -> DataFrame:
    """Words of doc in reading order: those with text and a box of two pixels or more; by block and line where there are such."""
    w = pages.select(key, F.explode("doc.words").alias("x")).select(key, T.decode_entities(T.jtrim(F.col("x.t"))).alias("w"), *(F.get("x.b", F.lit(i)).cast("double").alias(c) for i, c in enumerate(("left", "top", "right", "bottom"))), "x.c", "x.l", "x.k", F.col("x.id").alias("word_id"))
    kept = w.where("w <> '' AND right - left >= 2 AND bottom - top >= 2")
    placed = F.max(F.greatest(F.col("l"), F.col("k"))).over(Window.partitionBy(key)) >= 0
    ranked = kept.withColumn("placed", placed)
    order = [F.when(F.col("placed"), F.col("k")), F.when(F.col("placed"), F.col("l")), "top", "left", "word_id"]
    return ranked.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).drop("placed")


def page_json(pages: DataFrame, key: str) -> DataFrame:
    """key and json of doc; a null language is left out."""
    return pages.select(key, F.to_json("doc", {"ignoreNullFields": "true"}).alias("json"))


# ---- hOCR


def parse_hocr(df: DataFrame, text_col: str = "text", default_conf: int = 0, whitelist: str | None = None) -> DataFrame:
    """Adds pos, w, left, top, right, bottom, conf of each word element with a box."""
    span = r"""<span[^>]*class=['"]ocrx_word['"][^>]*>.*?</span>"""
    inner = F.regexp_replace(F.col("s"), r"^<span[^>]*>|</span>$", "")
    number = lambda k: F.regexp_extract("s", r"bbox\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)", k).try_cast("double")
    rows = df.select(*(c for c in df.columns if c != text_col), F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(f"(?s){span}"), F.lit(0))).alias("pos", "s"))
    words = T.strip_tags(inner)
    words = T.keep_listed(words, whitelist) if whitelist else words
    found = rows.select(*(c for c in rows.columns if c != "s"), words.alias("w"), *(number(i + 1).alias(c) for i, c in enumerate(("left", "top", "right", "bottom"))), F.coalesce(F.regexp_extract("s", r"x_wconf\s+(\d+)", 1).try_cast("int"), F.lit(default_conf)).alias("conf"))
    return found.where("left IS NOT NULL AND w <> ''")


# ---- registries, labels, lists


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Entries of registry files with defaults, newest first; a file that cannot be read has none."""
    doc = F.from_json("text", f"struct<version: int, items: array<{REGISTRY_ITEM}>>")
    items = whole_files(spark, path).select(F.explode(F.coalesce(doc["items"], F.from_json(F.lit("[]"), f"array<{REGISTRY_ITEM}>"))).alias("i")).select("i.*")
    return (
        items.where("id IS NOT NULL")
        .withColumns({"schemaVersion": F.when(F.coalesce("schemaVersion", F.lit(0)) <= 0, 1).otherwise(F.col("schemaVersion")), "orientationMode": F.coalesce(F.nullif("orientationMode", F.lit("")), F.lit("baked"))})
        .orderBy(F.desc("createdAt"), "id")
    )


def registry_json(entries: DataFrame, version: int = 1) -> DataFrame:
    """One row: the entries as a registry file. For registries of bounded size; write_registry() takes any."""
    return entries.agg(F.to_json(F.struct(F.lit(version).alias("version"), F.sort_array(F.collect_list(F.struct(*entries.columns))).alias("items"))).alias("json"))


def write_registry(entries: DataFrame, path: str, version: int = 1, block: int = 10_000) -> None:
    """Registry files of about `block` entries each, dealt by a hash of the id; read_registry() reads all of them as one."""
    blocks = max(1, -(-entries.count() // block))
    dealt = entries.withColumn("block_", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    items = F.sort_array(F.collect_list(F.struct(*entries.columns)))
    files = dealt.groupBy("block_").agg(F.to_json(F.struct(F.lit(version).alias("version"), items.alias("items"))).alias("text"))
    files.select("text").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def read_labels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a declared schema; lines that don't parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that aren't empty."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def vocabulary(lines: Column) -> Column:
    """Entries of a recognition vocabulary: a blank first, empty lines left out, nothing trimmed."""
    return F.concat(F.array(F.lit("")), F.filter(lines, lambda x: x != ""))


def smartdoc_labels(spark: SparkSession, path: str, backgrounds: list[str] | None = None, every: int = 1) -> DataFrame:
    """Corner labels of a gzipped CSV: corners put in the order tl, tr, br, bl; each `every`-th frame of a background."""
    names = [f"{p}_{c}" for p in ("tl", "bl", "br", "tr") for c in "xy"]
    schema = "bg_name string, model_name string, frame_index int, image_path string, " + ", ".join(f"{n} double" for n in names)
    rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    rows = rows.where(F.col("bg_name").isin(backgrounds)) if backgrounds else rows
    nth = F.row_number().over(Window.partitionBy("bg_name", "model_name").orderBy("frame_index")) - 1
    rows = rows.withColumn("nth", nth).where(F.col("nth") % every == 0)
    return rows.select(F.col("image_path").alias("image"), F.array(*(F.array(f"{p}_x", f"{p}_y") for p in ("tl", "tr", "br", "bl"))).alias("corners_px"))


def first_text(candidates: DataFrame, key: str) -> DataFrame:
    """key, format and text: of candidates (key, priority, format, text) the first by priority whose text isn't blank."""
    filled = candidates.withColumn("text", T.normalize_spaces(F.coalesce("text", F.lit("")))).where("text <> ''")
    return filled.groupBy(key).agg(F.min_by(F.struct("format", "text"), F.struct("priority", "format", "text")).alias("b")).select(key, "b.*")


def joined_pages(pages: DataFrame, key: str, page: str = "page_index", separator: str = "\n\n") -> DataFrame:
    """key and text: the pages' texts in order."""
    one = F.array_sort(F.collect_list(F.struct(page, F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(one, lambda x: x["text"]), separator).alias("text"))


def write_texts(df: DataFrame, path: str) -> None:
    """One text per row, as UTF-8."""
    df.select("text").write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One row per file that is a single JSON object; a file that is none fails the job."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def labels_with_sizes(labels: DataFrame, images: DataFrame) -> DataFrame:
    """image, width, height, corners_px of labels (image, corners) whose image is known (name, width, height)."""
    named = labels.where("image <> '' AND size(corners) > 0")
    return named.join(images.select(F.col("name").alias("image"), "width", "height"), "image").select("image", "width", "height", F.col("corners").alias("corners_px"))


def listed_languages(*folders: DataFrame, extension: str = ".traineddata") -> DataFrame:
    """language: the names of the model files (column name) of all folders, each once."""
    out = None
    for files in folders:
        own = files.where(F.endswith("name", F.lit(extension))).select(F.regexp_replace("name", r"\Q" + extension + r"\E$", "").alias("language"))
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def outdated(files: DataFrame, now: Column, hours: int, prefix: str, extension: str) -> DataFrame:
    """Files (name, modified) of a kind that were last changed more than `hours` ago."""
    return files.where(F.startswith("name", F.lit(prefix)) & F.endswith("name", F.lit(extension)) & (F.col("modified") < now - F.make_interval(hours=F.lit(hours))))


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines with nulls written; Spark's commit puts the files in place at once."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def report(df: DataFrame, digits: int = 6) -> DataFrame:
    """One row, column value: the rows as one JSON array in order, decimals rounded. For reports of bounded size."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rounded = [F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns]
    rows = df.select(F.struct(*rounded).alias("r"))
    return rows.agg(F.to_json(F.array_sort(F.collect_list("r")), {"ignoreNullFields": "false"}).alias("value"))


def write_report(df: DataFrame, path: str, digits: int = 6) -> None:
    report(df, digits).coalesce(1).write.mode("overwrite").text(path)


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """geom_name, xs, ys of grid files (.npy, an array of 2 x rows x columns); a file that holds no such array has nulls, one of no bytes no row."""

    @F.pandas_udf("struct<xs: array<array<double>>, ys: array<array<double>>>")
    def read(files: pd.Series) -> pd.DataFrame:
        def one(content: bytes) -> tuple:
            try:
                a = np.load(io.BytesIO(content), allow_pickle=False)
            except (ValueError, EOFError, OSError):
                return None, None
            if not isinstance(a, np.ndarray) or a.ndim != 3 or a.shape[0] != 2 or not a.size or a.dtype.kind not in "iuf":
                return None, None
            return tuple(a.astype(float).tolist())

        return pd.DataFrame([one(c) for c in files], columns=["xs", "ys"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    name = F.regexp_extract("path", r"([^/]+)\.npy$", 1)
    return files.select(name.alias("geom_name"), read("content").alias("g")).select("geom_name", "g.xs", "g.ys")
