"""Relational operators of the scan library: lookups, keyed writes, cascades, retention and registry repair.

Writes are whole-relation transformations by key (an anti-join and a union), so that each is one shuffle on
the key, or none where the small side is broadcast by Spark's own size check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def newest_first(scans: DataFrame) -> DataFrame:
    """Rows with an id, newest first, ties by id."""
    return scans.where("id IS NOT NULL").orderBy(F.desc("created_at"), "id")


def ordered_collections(collections: DataFrame) -> DataFrame:
    return collections.orderBy("sort_order", "created_at", "id")


def by_key(df: DataFrame, key: str, value: object, *columns: str) -> DataFrame:
    """Point lookup or one-column projection; equality is case-sensitive."""
    found = df.where(F.col(key) == F.lit(value))
    return found.select(*columns) if columns else found


def in_collection(scans: DataFrame, edges: DataFrame, collection_id: str) -> DataFrame:
    """Scans of one collection, newest first."""
    members = edges.where(F.col("collection_id") == collection_id).select(F.col("scan_id").alias("id"))
    return newest_first(scans.join(members, "id"))


def collection_counts(collections: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of scans in each collection, zero where it has none."""
    n = edges.groupBy("collection_id").agg(F.count("scan_id").alias("items"))
    return collections.join(n, collections["id"] == n["collection_id"], "left").select("id", "name", F.coalesce("items", F.lit(0)).alias("items"))


def memberships(edges: DataFrame, collections: DataFrame) -> DataFrame:
    """Names of each scan's collections by sort order, then name without regard to case."""
    met = edges.join(collections, edges["collection_id"] == collections["id"])
    order = F.struct("sort_order", F.lower("name").alias("folded"), "name")
    return met.groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["name"]).alias("names"))


def insert_or_abort(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Appends new; a key that is there already, or twice in new, fails the job."""
    both = old.select(*keys, F.lit(1).alias("n")).unionByName(new.select(*keys, F.lit(1).alias("n")))
    clash = both.groupBy(*keys).count().where("count > 1").limit(1)
    guard = clash.agg(F.count("*").alias("clashes")).select(F.assert_true(F.col("clashes") == 0, F.lit("insert: key exists")).alias("ok"))
    if guard.first() is None:  # the check runs here
        raise RuntimeError("insert: no answer")
    return old.unionByName(new)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows win."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def insert_or_replace(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows win."""
    return old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(new)


def update_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with a key of new are replaced; keys that are only in new are ignored."""
    known = new.join(old.select(*keys), list(keys), "left_semi")
    return insert_or_replace(old, known, keys)


def delete_rows(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(gone.select(*keys), list(keys), "left_anti").select(*old.columns)


def set_where(df: DataFrame, column: str, value: object, condition: Column) -> DataFrame:
    """Point update of one column."""
    return df.withColumn(column, F.when(condition, F.lit(value)).otherwise(F.col(column)))


def merge_exported(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or field-wise merge: title new else old; created_at old unless 0; page_count the larger; the rest new else old."""
    o, n = old.alias("o"), new.alias("n")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    created = F.when(F.col("o.id").isNull() | (F.col("o.created_at") == 0), F.col("n.created_at")).otherwise(F.col("o.created_at"))
    return o.join(n, F.col("o.id") == F.col("n.id"), "full_outer").select(
        pick("id"),
        pick("title"),
        F.when(F.col("n.id").isNull(), F.col("o.created_at")).otherwise(created).alias("created_at"),
        F.greatest("o.page_count", "n.page_count").alias("page_count"),
        *(pick(c) for c in ("cover_path", "export_paths_json", "source_meta_json")),
    )


def cascade_delete(gone: DataFrame, scans: DataFrame, edges: DataFrame, page_text: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three relations without the scans named in gone (id)."""
    ids = gone.select(F.col("id").alias("scan_id")).distinct()
    return scans.join(ids, scans["id"] == ids["scan_id"], "left_anti"), edges.join(ids, "scan_id", "left_anti"), page_text.join(ids, "scan_id", "left_anti")


def is_registry_row() -> Column:
    return F.coalesce(F.col("source_meta_json"), F.lit("")).contains('"CompletedScanEntry"')


def assign(edges: DataFrame, scans: DataFrame, wanted: DataFrame, default_id: str = "default") -> DataFrame:
    """Adds wanted (scan_id, collection_id, added_at) edges; only registry rows may join the default collection."""
    allowed = scans.where(is_registry_row()).select(F.col("id").alias("scan_id"))
    to_default = wanted.where(F.col("collection_id") == default_id).join(allowed, "scan_id", "left_semi")
    rest = wanted.where(F.col("collection_id") != default_id)
    return insert_or_ignore(edges, to_default.unionByName(rest), ["scan_id", "collection_id"])


def deletable(collections: DataFrame, edges: DataFrame, default_id: str = "default") -> DataFrame:
    """Collections that may be deleted: empty ones, never the default."""
    return collections.where(F.col("id") != default_id).join(edges, collections["id"] == edges["collection_id"], "left_anti")


def matching(scans: DataFrame, names: DataFrame, hits: DataFrame, query: str) -> DataFrame:
    """Scans that search hits name, or whose title, id or a collection's name holds the query; newest first."""
    if not query.strip():
        return newest_first(scans)
    q = query.strip().lower()
    holds = lambda c: F.coalesce(F.lower(c).contains(q), F.lit(False))
    ids = hits.select(F.col("scan_id").alias("id"), F.lit(True).alias("hit")).distinct()
    met = scans.join(names, scans["id"] == names["scan_id"], "left").drop("scan_id").join(ids, "id", "left")
    found = met.where(F.coalesce("hit", F.lit(False)) | holds(F.col("title")) | holds(F.col("id")) | F.coalesce(F.exists("names", holds), F.lit(False)))
    return newest_first(found.select(*scans.columns))


def too_old(scans: DataFrame, days: int, now_ms: int) -> DataFrame:
    return scans.where(F.col("created_at") < F.lit(now_ms - days * DAY_MS)).select("id")


def beyond_count(scans: DataFrame, most: int) -> DataFrame:
    """All but the newest `most` rows: a top-k and an anti-join, so that no task sorts the whole table."""
    kept = scans.orderBy(F.desc("created_at"), "id").limit(max(0, most)).select("id")
    return scans.select("id").join(kept, "id", "left_anti")


def beyond_storage(scans: DataFrame, sizes: DataFrame, most: int, buckets: int = 1024) -> DataFrame:
    """Oldest rows whose removal brings the total to `most`; an unknown size counts as 0.

    A row goes if what is left before it is still above `most`. Running sums have two levels: ranges of
    created_at first, then the rows of a range.
    """
    sized = scans.select("id", "created_at").join(sizes, "id", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    low, high, total = sized.agg(F.min("created_at"), F.max("created_at"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if low is None or total <= most:
        return sized.where("false").select("id")
    width = max(1, -(-(high - low + 1) // buckets))
    part = sized.withColumn("part", F.expr(f"(created_at - {low}L) div {width}L"))
    before = part.groupBy("part").agg(F.sum("size").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("part").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1))
    return part.join(before, "part").withColumn("gone", F.col("before") + F.coalesce(inside, F.lit(0))).where(F.lit(total) - F.col("gone") > most).select("id")


def clean_up(scans: DataFrame, sizes: DataFrame, policy: str, now_ms: int, days: int = 30, most_rows: int = 100, most_bytes: int = 0) -> DataFrame:
    """Rows that stay under AGE, COUNT, STORAGE or COMBINED; COMBINED applies all three in that order to what is left."""
    left = scans
    if policy in ("AGE", "COMBINED"):
        left = delete_rows(left, too_old(left, days, now_ms), ["id"])
    if policy in ("COUNT", "COMBINED"):
        left = delete_rows(left, beyond_count(left, most_rows), ["id"])
    if policy in ("STORAGE", "COMBINED"):
        left = delete_rows(left, beyond_storage(left, sizes, most_bytes), ["id"])
    return left


def orphans(registry: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry rows without a directory, and directories without a row (both by id)."""
    return registry.join(files, "id", "left_anti").select("id"), files.join(registry, "id", "left_anti").select("id")


def migrate(old: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows of an older schema with the missing columns of a newer one added as nulls."""
    return columns.limit(0).unionByName(old, allowMissingColumns=True)


def generic_name(name: Column) -> Column:
    return F.lower(F.trim(name)).isin("page", "thumb", "image", "img")


def stem(path: Column) -> Column:
    """File name without directories and its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)[.][^.]*$", "")


def derived_title(file_path: Column, thumb_path: Column, id_: Column) -> Column:
    """The file's stem; where that is a placeholder its directory, else the thumbnail's stem; else, or without a file, the id, or 'scan'."""
    directory = F.regexp_extract(file_path, r"([^/]+)/[^/]*$", 1)
    good = lambda c: F.when((F.trim(F.coalesce(c, F.lit(""))) != "") & ~generic_name(c), c)
    own = stem(file_path)
    of_file = F.when(generic_name(own), F.coalesce(good(directory), good(stem(thumb_path)))).otherwise(good(own))
    return F.coalesce(F.when(F.coalesce(file_path, F.lit("")) != "", of_file), F.when(id_ != "", id_), F.lit("scan"))


def file_uri_json(path: Column) -> Column:
    """A path as a JSON array of one URI; null for none."""
    return F.when(F.coalesce(path, F.lit("")) != "", F.to_json(F.array(F.concat(F.lit("file://"), path))))


def first_uri(json: Column) -> Column:
    return F.get_json_object(json, "$[0]")


def load_registry(scans: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows (id, file_path, thumb_path, created_at) into the library: new rows are added, old ones repaired.

    A missing or placeholder title is derived unless that gives a placeholder again, a missing export path is set, and the row is
    marked as the registry's unless it is.
    """
    r = registry.select("id", "file_path", "thumb_path", F.col("created_at").alias("r_created"))
    met = scans.withColumn("known", F.lit(True)).join(r, "id", "full_outer")
    from_registry = F.col("r_created").isNotNull()
    title = derived_title(F.col("file_path"), F.col("thumb_path"), F.col("id"))
    bad = F.col("title").isNull() | (F.trim("title") == "") | generic_name(F.col("title"))
    better = F.col("known").isNull() | ((F.trim(title) != "") & ~generic_name(title))
    marked = F.coalesce(F.contains("source_meta_json", F.lit('"CompletedScanEntry"')), F.lit(False))
    export = F.when(F.col("export_paths_json") != "", F.col("export_paths_json"))
    return met.select(
        "id",
        F.when(from_registry & bad & better, title).otherwise(F.col("title")).alias("title"),
        F.coalesce("created_at", "r_created").alias("created_at"),
        F.coalesce("page_count", F.lit(1)).alias("page_count"),
        F.coalesce("cover_path", "thumb_path").alias("cover_path"),
        F.when(from_registry, F.coalesce(export, file_uri_json(F.col("file_path")), "export_paths_json")).otherwise(F.col("export_paths_json")).alias("export_paths_json"),
        F.when(from_registry & ~marked, F.lit('{"kind":"CompletedScanEntry"}')).otherwise(F.col("source_meta_json")).alias("source_meta_json"),
    )


def not_in_registry(scans: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry-marked library rows that the registry no longer has."""
    return scans.where(is_registry_row()).join(registry, "id", "left_anti").select("id")


def move(items: Column, from_: int, to: int) -> Column:
    """An array with the element at from_ moved to to (from 0); out of range leaves it as it is."""
    one = F.slice(items, from_ + 1, 1)
    rest = F.concat(F.slice(items, 1, from_), F.slice(items, from_ + 2, 1_000_000_000))
    moved = F.concat(F.slice(rest, 1, to), one, F.slice(rest, to + 1, 1_000_000_000))
    inside = (F.size(items) > from_) & (F.size(items) > to) if min(from_, to) >= 0 else F.lit(False)
    return F.when(inside, moved).otherwise(items)


def remove_at(items: Column, at: int) -> Column:
    return F.filter(items, lambda _, i: i != at)


def update_at(items: Column, at: int, value: Column) -> Column:
    return F.transform(items, lambda x, i: F.when(i == at, value).otherwise(x))
