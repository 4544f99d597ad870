"""The library's relations, derived from the driver's tables, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources import tables

DAY_MS = 86_400_000
#: Bytes of Parquet whose texts one task cuts: their words, some 40 times as many bytes as rows, fit into its memory.
CUT = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files have fewer splits than there are cores; large inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _parts(spark: SparkSession, sf_dir: str) -> list[int]:
    """The number of parts that texts to be cut are dealt into; none for small tables, for which Spark's own number will do."""
    n = -(-tables.size(spark, f"{sf_dir}/documents.parquet") // CUT)
    return [max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))] if n > spark.sparkContext.defaultParallelism else []


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "cast(doc_id AS string) AS id",
        "source AS title",
        f"doc_id * {DAY_MS} AS created_at",
        "cast(n_chars div 2000 + 1 AS int) AS page_count",
        "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('cover/', doc_id, '.jpg') END AS cover_path",
        """CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('["file:///out/', doc_id, '.pdf"]') END AS export_paths_json""",
        """CASE WHEN doc_id % 4 = 0 THEN '{"kind":"CompletedScanEntry"}' END AS source_meta_json""",
    )


SCANS = f"""scans AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS title, doc_id * {DAY_MS} AS created_at,
    CAST(n_chars // 2000 + 1 AS INTEGER) AS page_count,
    CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('cover/', doc_id, '.jpg') END AS cover_path,
    CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('["file:///out/', doc_id, '.pdf"]') END AS export_paths_json,
    CASE WHEN doc_id % 4 = 0 THEN '{{"kind":"CompletedScanEntry"}}' END AS source_meta_json FROM documents)"""


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names = docs.select(F.col("lang").alias("id")).union(docs.select("source")).distinct()
    extra = spark.createDataFrame([("default",), ("empty",)], "id string")
    return names.union(extra).selectExpr("id", "concat('Col ', upper(id)) AS name", "length(id) AS sort_order", "cast(0 AS long) AS created_at")


COLLECTIONS = """collections AS (SELECT id, concat('Col ', upper(id)) AS name, CAST(length(id) AS INTEGER) AS sort_order, CAST(0 AS BIGINT) AS created_at
    FROM (SELECT lang AS id FROM documents UNION SELECT source FROM documents UNION SELECT 'default' UNION SELECT 'empty') AS names)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    by = lambda c: docs.selectExpr("cast(doc_id AS string) AS scan_id", f"{c} AS collection_id", "doc_id AS added_at")
    return by("lang").unionByName(by("source"))


EDGES = """edges AS (SELECT CAST(doc_id AS VARCHAR) AS scan_id, lang AS collection_id, doc_id AS added_at FROM documents
    UNION ALL SELECT CAST(doc_id AS VARCHAR), source, doc_id FROM documents)"""


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages dealt by scan, in parts of bounded size: terms and postings of a scan are grouped where its text lies, and never shuffled one by one."""
    return table(spark, sf_dir, "documents").selectExpr("cast(doc_id AS string) AS scan_id", "text").repartition(*_parts(spark, sf_dir), "scan_id").selectExpr("scan_id", "0 AS page_index", "text")


PAGE_TEXT = "page_text AS (SELECT CAST(doc_id AS VARCHAR) AS scan_id, 0 AS page_index, text FROM documents)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned words: doc_id, pos, w (some misread on purpose), conf (0 to 99), left, top, right, bottom.

    The texts are dealt by document before they are cut, so that what groups words by document shuffles no words, and into parts
    whose words fit into a task's memory, so that it spills none either.
    """
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "text")
        .repartition(*_parts(spark, sf_dir), "doc_id")
        .selectExpr("doc_id", r"posexplode(filter(split(text, '[ \\t\\r\\n]+'), w -> w <> '')) AS (pos, raw)")
        .selectExpr(
            "doc_id",
            "pos",
            """CASE pos % 7 WHEN 0 THEN replace(raw, 'o', '0') WHEN 1 THEN replace(raw, 'm', 'rn') WHEN 2 THEN replace(raw, 'd', 'cl')
                WHEN 3 THEN concat('(', replace(raw, 'l', '1'), ',') WHEN 4 THEN concat('1', raw, '23') WHEN 5 THEN concat(raw, '.') ELSE raw END AS w""",
            "cast((pos * 37 + doc_id) % 100 AS double) AS conf",
            "cast(pos % 10 * 60 AS double) AS left",
            "cast(pos div 10 * 30 + (pos * 7 + doc_id) % 5 AS double) AS top",
            "cast(pos % 10 * 60 + 50 AS double) AS right",
            "cast(pos div 10 * 30 + (pos * 7 + doc_id) % 5 + 20 + pos % 3 AS double) AS bottom",
        )
    )


WORDS = r"""words AS (SELECT doc_id, pos, CASE pos % 7 WHEN 0 THEN replace(raw, 'o', '0') WHEN 1 THEN replace(raw, 'm', 'rn') WHEN 2 THEN replace(raw, 'd', 'cl')
        WHEN 3 THEN concat('(', replace(raw, 'l', '1'), ',') WHEN 4 THEN concat('1', raw, '23') WHEN 5 THEN concat(raw, '.') ELSE raw END AS w,
        CAST((pos * 37 + doc_id) % 100 AS DOUBLE) AS conf, CAST(pos % 10 * 60 AS DOUBLE) AS "left", CAST(pos // 10 * 30 + (pos * 7 + doc_id) % 5 AS DOUBLE) AS top,
        CAST(pos % 10 * 60 + 50 AS DOUBLE) AS "right", CAST(pos // 10 * 30 + (pos * 7 + doc_id) % 5 + 20 + pos % 3 AS DOUBLE) AS bottom
    FROM (SELECT doc_id, unnest(ws) AS raw, unnest(range(len(ws))) AS pos FROM
        (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda w: w <> '') AS ws FROM documents) AS a) AS b)"""

#: SQL for a text with the tables' letters beyond ASCII as one byte each, for SQL's levenshtein, which counts bytes.
BEYOND = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
BYTES = "translate({0}, '" + BEYOND + "', concat(" + ", ".join(f"chr({k})" for k in [*range(1, 9), *range(14, 14 + len(BEYOND) - 8)]) + "))"
