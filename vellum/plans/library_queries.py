"""Queries of the scan library (lookups, joins, counts, keyed writes, retention) with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import library as L
from vellum.plans import model as M

NOW = 1_000 * L.DAY_MS
SCAN_COLUMNS = "id, title, created_at, page_count, cover_path, export_paths_json, source_meta_json"


def _incoming(spark: SparkSession, sf: str) -> DataFrame:
    """New versions of every third scan, and as many rows that are not there yet."""
    s = M.scans(spark, sf).where("cast(id AS long) % 3 = 0")
    changed = s.withColumns({"title": F.when(F.expr("cast(id AS long) % 2 = 0"), F.concat(F.lit("new "), "title")), "page_count": F.expr("page_count + cast(cast(id AS long) % 5 AS int) - 2")})
    return changed.unionByName(changed.withColumn("id", F.concat(F.lit("x"), "id")))


INCOMING = """changed AS (SELECT id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN concat('new ', title) END AS title, created_at,
        CAST(page_count + CAST(id AS BIGINT) % 5 - 2 AS INTEGER) AS page_count, cover_path, export_paths_json, source_meta_json
    FROM scans WHERE CAST(id AS BIGINT) % 3 = 0),
incoming AS (SELECT * FROM changed UNION ALL SELECT concat('x', id), title, created_at, page_count, cover_path, export_paths_json, source_meta_json FROM changed)"""


def scans_newest(spark, sf):
    return L.newest_first(M.scans(spark, sf))


def collections_ordered(spark, sf):
    return L.ordered_collections(M.collections(spark, sf))


def collection_listing(spark, sf):
    return L.in_collection(M.scans(spark, sf), M.edges(spark, sf), "en")


def collection_counts(spark, sf):
    return L.collection_counts(M.collections(spark, sf), M.edges(spark, sf))


def collections_for_scan(spark, sf):
    return L.memberships(M.edges(spark, sf), M.collections(spark, sf)).select("scan_id", F.array_join("names", "|").alias("names"))


def scan_lookup(spark, sf):
    one = lambda df, k: df.withColumn("lookup", F.lit(k))
    s, c, e = M.scans(spark, sf), M.collections(spark, sf), M.edges(spark, sf)
    parts = [
        one(L.by_key(s, "id", "7", "id"), "scan by id"),
        one(L.by_key(c, "id", "de", "id"), "collection by id"),
        one(L.by_key(c, "name", "Col EN", "id").orderBy("id").limit(1), "collection by name"),
        one(L.by_key(c, "name", "col en", "id"), "collection by name, other case"),
        one(L.by_key(e, "collection_id", "de", F.col("scan_id").alias("id")), "scans of collection"),
        one(L.by_key(e, "scan_id", "7", F.col("collection_id").alias("id")), "collections of scan"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_insert_abort(spark, sf):
    new = _incoming(spark, sf).where("id LIKE 'x%'")
    return L.insert_or_abort(M.scans(spark, sf), new, ["id"])


def write_insert_ignore(spark, sf):
    return L.insert_or_ignore(M.scans(spark, sf), _incoming(spark, sf), ["id"])


def write_insert_replace(spark, sf):
    return L.insert_or_replace(M.scans(spark, sf), _incoming(spark, sf), ["id"])


def write_update(spark, sf):
    return L.update_rows(M.scans(spark, sf), _incoming(spark, sf), ["id"])


def write_delete(spark, sf):
    return L.delete_rows(M.edges(spark, sf), M.edges(spark, sf).where("added_at % 4 = 1 AND collection_id <> 'en'"), ["scan_id", "collection_id"])


def write_point_update(spark, sf):
    s = M.scans(spark, sf)
    return L.set_where(L.set_where(s, "title", "renamed", F.col("id") == "7"), "export_paths_json", "[]", F.col("id") == "8")


def export_merge(spark, sf):
    old = M.scans(spark, sf).withColumn("created_at", F.expr("CASE WHEN cast(id AS long) % 6 = 0 THEN 0L ELSE created_at END"))
    return L.merge_exported(old, _incoming(spark, sf).withColumn("created_at", F.col("created_at") + 5))


def cascade_delete(spark, sf):
    s, e, p = L.cascade_delete(M.scans(spark, sf).where("title = 'src3'"), M.scans(spark, sf), M.edges(spark, sf), M.page_text(spark, sf))
    row = lambda df, name: df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("relation"), "rows")
    return row(s, "scans").unionByName(row(e, "edges")).unionByName(row(p, "page_text"))


def assign_guarded(spark, sf):
    wanted = M.scans(spark, sf).select(F.col("id").alias("scan_id"), F.explode(F.array(F.lit("default"), F.lit("en"))).alias("collection_id"), F.lit(5).cast("long").alias("added_at"))
    return L.assign(M.edges(spark, sf), M.scans(spark, sf), wanted)


def deletable_collections(spark, sf):
    return L.deletable(M.collections(spark, sf), M.edges(spark, sf))


def visible_filter(spark, sf):
    s = M.scans(spark, sf)
    hits = s.where("cast(id AS long) % 50 = 3").select(F.col("id").alias("scan_id"))
    hidden = s.where(~L.is_registry_row())
    return L.matching(hidden, L.memberships(M.edges(spark, sf), M.collections(spark, sf)), hits, "SRC1").select("id", "title", "created_at")


def retention_age(spark, sf):
    return L.too_old(M.scans(spark, sf), 900, NOW)


def retention_count(spark, sf):
    return L.beyond_count(M.scans(spark, sf), 100)


def _sizes(spark, sf):
    return M.table(spark, sf, "documents").where("doc_id % 10 <> 9").selectExpr("cast(doc_id AS string) AS id", "n_chars AS size")


def retention_storage(spark, sf):
    return L.beyond_storage(M.scans(spark, sf), _sizes(spark, sf), 300_000)


def retention_combined(spark, sf):
    return L.clean_up(M.scans(spark, sf), _sizes(spark, sf), "COMBINED", NOW, 900, 80, 100_000).select("id")


def scan_entry_sizes(spark, sf):
    return M.table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("files"))


def _registry(spark, sf, which="doc_id % 2 = 0"):
    """Of the documents that `which` names, so that either side has rows without a partner."""
    return M.table(spark, sf, "documents").where(which).selectExpr(
        "cast(doc_id AS string) AS id",
        "CASE WHEN doc_id % 8 = 0 THEN NULL WHEN doc_id % 8 = 2 THEN concat('/data/', doc_id, '/page.jpg') WHEN doc_id % 8 = 5 THEN '/data/IMG/Page.jpg' ELSE concat('/data/', doc_id, '/Report ', doc_id, '.v2.pdf') END AS file_path",
        "CASE WHEN doc_id % 16 = 0 THEN NULL ELSE concat('/t/cover-', doc_id, '.png') END AS thumb_path",
        "doc_id * 1000 AS created_at",
    )


REGISTRY = """registry AS (SELECT CAST(doc_id AS VARCHAR) AS id,
    CASE WHEN doc_id % 8 = 0 THEN NULL WHEN doc_id % 8 = 2 THEN concat('/data/', doc_id, '/page.jpg') WHEN doc_id % 8 = 5 THEN '/data/IMG/Page.jpg' ELSE concat('/data/', doc_id, '/Report ', doc_id, '.v2.pdf') END AS file_path,
    CASE WHEN doc_id % 16 = 0 THEN NULL ELSE concat('/t/cover-', doc_id, '.png') END AS thumb_path, doc_id * 1000 AS created_at FROM documents WHERE doc_id % 2 = 0)"""
GENERIC = "IN ('page', 'thumb', 'image', 'img')"
OWN, FOLDER, COVER = (r"regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '[.][^.]+$', '')", r"regexp_extract(file_path, '([^/]+)/[^/]*$', 1)", r"regexp_replace(regexp_extract(thumb_path, '([^/]*)$', 1), '[.][^.]+$', '')")
TITLE = f"""CASE WHEN file_path IS NULL THEN id WHEN lower({OWN}) NOT {GENERIC} THEN {OWN} WHEN lower({FOLDER}) NOT {GENERIC} THEN {FOLDER}
    WHEN thumb_path IS NOT NULL AND lower({COVER}) NOT {GENERIC} THEN {COVER} ELSE id END"""


def registry_titles(spark, sf):
    r = _registry(spark, sf, "true")
    return r.select("id", L.derived_title(F.col("file_path"), F.col("thumb_path"), F.col("id")).alias("title"), L.file_uri_json(F.col("file_path")).alias("uris"), L.first_uri(L.file_uri_json(F.col("file_path"))).alias("first"))


def registry_load(spark, sf):
    old = M.scans(spark, sf).where("cast(id AS long) % 3 <> 0").withColumn("title", F.expr("CASE WHEN cast(id AS long) % 4 = 0 THEN 'Page' ELSE title END"))
    return L.load_registry(old, _registry(spark, sf)).select("id", "title", "created_at", "page_count", "cover_path", F.col("export_paths_json").isNotNull().alias("has_export"), "source_meta_json")


def registry_orphans(spark, sf):
    files = M.table(spark, sf, "documents").where("doc_id % 3 = 0").selectExpr("cast(doc_id AS string) AS id")
    a, b = L.orphans(_registry(spark, sf), files)
    gone = L.not_in_registry(M.scans(spark, sf), _registry(spark, sf))
    mark = lambda df, k: df.withColumn("kind", F.lit(k))
    return mark(a, "row without files").unionByName(mark(b, "files without row")).unionByName(mark(gone, "library row without registry"))


def schema_migration(spark, sf):
    return L.migrate(M.scans(spark, sf).select("id", "title", "created_at", "page_count"), M.scans(spark, sf))


def session_positions(spark, sf):
    items = M.table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat_ws(":", x["turn"], x["role"])).alias("a"))
    joined = lambda c: F.array_join(c, ",")
    a = F.col("a")
    return items.select("conv_id", joined(L.move(a, 0, 1)).alias("moved"), joined(L.remove_at(a, 1)).alias("removed"), joined(L.update_at(a, 0, F.lit("z"))).alias("updated"))


QUERIES = {f.__name__: f for f in (
    scans_newest, collections_ordered, collection_listing, collection_counts, collections_for_scan, scan_lookup, write_insert_abort, write_insert_ignore, write_insert_replace,
    write_update, write_delete, write_point_update, export_merge, cascade_delete, assign_guarded, deletable_collections, visible_filter, retention_age, retention_count,
    retention_storage, retention_combined, scan_entry_sizes, registry_titles, registry_load, registry_orphans, schema_migration, session_positions,
)}

W = M.with_
STORAGE = "sizes AS (SELECT CAST(doc_id AS VARCHAR) AS id, n_chars AS size FROM documents WHERE doc_id % 10 <> 9)"
ORACLE_SQL = {
    "scans_newest": W(M.SCANS) + "SELECT * FROM scans ORDER BY created_at DESC, id",
    "collections_ordered": W(M.COLLECTIONS) + "SELECT * FROM collections ORDER BY sort_order, created_at, id",
    "collection_listing": W(M.SCANS, M.EDGES) + "SELECT s.* FROM scans s JOIN edges e ON s.id = e.scan_id WHERE e.collection_id = 'en' ORDER BY created_at DESC",
    "collection_counts": W(M.COLLECTIONS, M.EDGES) + "SELECT c.id, c.name, count(e.scan_id) AS items FROM collections c LEFT JOIN edges e ON c.id = e.collection_id GROUP BY c.id, c.name",
    "collections_for_scan": W(M.COLLECTIONS, M.EDGES) + "SELECT scan_id, string_agg(name, '|' ORDER BY sort_order, lower(name), name) AS names FROM edges JOIN collections c ON c.id = collection_id GROUP BY scan_id",
    "scan_lookup": W(M.SCANS, M.COLLECTIONS, M.EDGES) + """SELECT id, 'scan by id' AS lookup FROM scans WHERE id = '7' UNION ALL SELECT id, 'collection by id' FROM collections WHERE id = 'de'
        UNION ALL SELECT id, 'collection by name' FROM collections WHERE name = 'Col EN' UNION ALL SELECT scan_id, 'scans of collection' FROM edges WHERE collection_id = 'de'
        UNION ALL SELECT collection_id, 'collections of scan' FROM edges WHERE scan_id = '7'""",
    "write_insert_abort": W(M.SCANS, INCOMING) + "SELECT * FROM scans UNION ALL SELECT * FROM incoming WHERE id LIKE 'x%'",
    "write_insert_ignore": W(M.SCANS, INCOMING) + "SELECT * FROM scans UNION ALL SELECT * FROM incoming WHERE id NOT IN (SELECT id FROM scans)",
    "write_insert_replace": W(M.SCANS, INCOMING) + "SELECT * FROM scans WHERE id NOT IN (SELECT id FROM incoming) UNION ALL SELECT * FROM incoming",
    "write_update": W(M.SCANS, INCOMING) + "SELECT * FROM scans WHERE id NOT IN (SELECT id FROM incoming) UNION ALL SELECT * FROM incoming WHERE id IN (SELECT id FROM scans)",
    "write_delete": W(M.EDGES) + "SELECT * FROM edges WHERE NOT (added_at % 4 = 1 AND collection_id <> 'en')",
    "write_point_update": W(M.SCANS) + "SELECT id, CASE WHEN id = '7' THEN 'renamed' ELSE title END AS title, created_at, page_count, cover_path, CASE WHEN id = '8' THEN '[]' ELSE export_paths_json END AS export_paths_json, source_meta_json FROM scans",
    "export_merge": W(M.SCANS, INCOMING) + """SELECT coalesce(n.id, o.id) AS id, coalesce(n.title, o.title) AS title,
        CASE WHEN n.id IS NULL THEN o.created_at WHEN o.id IS NULL OR o.created_at = 0 THEN n.created_at + 5 ELSE o.created_at END AS created_at,
        greatest(o.page_count, n.page_count) AS page_count, coalesce(n.cover_path, o.cover_path) AS cover_path, coalesce(n.export_paths_json, o.export_paths_json) AS export_paths_json,
        coalesce(n.source_meta_json, o.source_meta_json) AS source_meta_json
        FROM (SELECT * REPLACE (CASE WHEN CAST(id AS BIGINT) % 6 = 0 THEN 0 ELSE created_at END AS created_at) FROM scans) o FULL JOIN incoming n ON o.id = n.id""",
    "cascade_delete": W(M.SCANS, M.EDGES, M.PAGE_TEXT) + """SELECT 'scans' AS relation, count(*) AS rows FROM scans WHERE title <> 'src3'
        UNION ALL SELECT 'edges', count(*) FROM edges WHERE scan_id NOT IN (SELECT id FROM scans WHERE title = 'src3')
        UNION ALL SELECT 'page_text', count(*) FROM page_text WHERE scan_id NOT IN (SELECT id FROM scans WHERE title = 'src3')""",
    "assign_guarded": W(M.SCANS, M.EDGES) + """SELECT * FROM edges UNION ALL SELECT id, 'default', 5 FROM scans WHERE source_meta_json IS NOT NULL
        UNION ALL SELECT id, 'en', 5 FROM scans WHERE id NOT IN (SELECT scan_id FROM edges WHERE collection_id = 'en')""",
    "deletable_collections": W(M.COLLECTIONS, M.EDGES) + "SELECT * FROM collections WHERE id <> 'default' AND id NOT IN (SELECT collection_id FROM edges)",
    "visible_filter": W(M.SCANS) + "SELECT id, title, created_at FROM scans WHERE source_meta_json IS NULL AND (CAST(id AS BIGINT) % 50 = 3 OR lower(title) LIKE '%src1%' OR lower(id) LIKE '%src1%')",
    "retention_age": W(M.SCANS) + f"SELECT id FROM scans WHERE created_at < {NOW - 900 * L.DAY_MS}",
    "retention_count": W(M.SCANS) + "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS r FROM scans) AS x WHERE r > 100",
    "retention_storage": W(M.SCANS, STORAGE) + """SELECT id FROM (SELECT s.id, sum(coalesce(size, 0)) OVER () - coalesce(sum(coalesce(size, 0)) OVER (ORDER BY created_at, s.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_
        FROM scans s LEFT JOIN sizes z ON s.id = z.id) AS x WHERE left_ > 300000""",
    "retention_combined": W(M.SCANS, STORAGE, f"a AS (SELECT * FROM scans WHERE NOT created_at < {NOW - 900 * L.DAY_MS})", "b AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS r FROM a) AS x WHERE r <= 80)") + """SELECT id FROM (SELECT b.id, sum(coalesce(size, 0)) OVER () - coalesce(sum(coalesce(size, 0)) OVER (ORDER BY created_at, b.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_
        FROM b LEFT JOIN sizes z ON b.id = z.id) AS y WHERE NOT left_ > 100000""",
    "scan_entry_sizes": "SELECT conv_id, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, count(*) AS files FROM conversations GROUP BY conv_id",
    "registry_titles": W(REGISTRY.replace(" WHERE doc_id % 2 = 0", "")) + f"SELECT id, {TITLE} AS title, CASE WHEN file_path IS NOT NULL THEN concat('[\"file://', file_path, '\"]') END AS uris, CASE WHEN file_path IS NOT NULL THEN concat('file://', file_path) END AS first FROM registry",
    "registry_load": W(M.SCANS, REGISTRY, "old AS (SELECT * REPLACE (CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 'Page' ELSE title END AS title) FROM scans WHERE CAST(id AS BIGINT) % 3 <> 0)", f"derived AS (SELECT *, {TITLE} AS t FROM registry)") + """SELECT coalesce(o.id, r.id) AS id,
        CASE WHEN r.id IS NOT NULL AND (title IS NULL OR title = 'Page') THEN t ELSE title END AS title, coalesce(o.created_at, r.created_at) AS created_at, coalesce(page_count, 1) AS page_count,
        coalesce(cover_path, thumb_path) AS cover_path, CASE WHEN r.id IS NOT NULL THEN export_paths_json IS NOT NULL OR file_path IS NOT NULL ELSE export_paths_json IS NOT NULL END AS has_export,
        CASE WHEN r.id IS NOT NULL THEN '{"kind":"CompletedScanEntry"}' ELSE source_meta_json END AS source_meta_json FROM old o FULL JOIN derived r ON o.id = r.id""",
    "registry_orphans": W(M.SCANS, REGISTRY, "files AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 3 = 0)") + """SELECT id, 'row without files' AS kind FROM registry WHERE id NOT IN (SELECT id FROM files)
        UNION ALL SELECT id, 'files without row' FROM files WHERE id NOT IN (SELECT id FROM registry)
        UNION ALL SELECT id, 'library row without registry' FROM scans WHERE source_meta_json IS NOT NULL AND id NOT IN (SELECT id FROM registry)""",
    "schema_migration": W(M.SCANS) + "SELECT id, title, created_at, page_count, CAST(NULL AS VARCHAR) AS cover_path, CAST(NULL AS VARCHAR) AS export_paths_json, CAST(NULL AS VARCHAR) AS source_meta_json FROM scans",
    "session_positions": """WITH a AS (SELECT conv_id, concat(turn, ':', role) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
        SELECT conv_id, string_agg(x, ',' ORDER BY CASE WHEN n > 1 AND r = 1 THEN 2 WHEN n > 1 AND r = 2 THEN 1 ELSE r END) AS moved,
        coalesce(string_agg(CASE WHEN r <> 2 THEN x END, ',' ORDER BY r), '') AS removed, string_agg(CASE WHEN r = 1 THEN 'z' ELSE x END, ',' ORDER BY r) AS updated FROM a GROUP BY conv_id""",
}
