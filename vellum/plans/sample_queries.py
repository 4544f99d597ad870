"""Made samples, labels of grids and registry files, with their DuckDB SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import quads as G
from vellum.functions import tensors as N
from vellum.operators import pages as Q
from vellum.operators import samples as Z
from vellum.plans import model as M
from vellum.sources import documents as R
from vellum.sources import tables


def synthetic_samples(spark, sf):
    """A made page of each supplier: its size, two corners in the frame, cells of its mask, bright cells of its image, peaks of two heat maps."""
    s = Z.synthetic(M.spread(M.table(spark, sf, "supplier").select("s_suppkey")), "s_suppkey", seed=7)
    count = lambda c, ok: F.aggregate(c, F.lit(0), lambda n, v: n + F.when(ok(v), 1).otherwise(0))
    corner = lambda k, axis: F.round(F.col("q")[k][axis], 5)
    return s.select(
        "s_suppkey", "src_w", "src_h", corner(0, "x").alias("x0"), corner(0, "y").alias("y0"), corner(2, "x").alias("x2"), corner(2, "y").alias("y2"),
        count(F.col("mask"), lambda v: v == 1).alias("cells"), count(F.col("image"), lambda v: v > 0.5).alias("bright"),
        N.argmax(F.col("heat")[0]).alias("first"), N.argmax(F.col("heat")[2]).alias("third"),
    )


def grid_labels(spark, sf):
    """Labels of the parts' photographs for each kind of sample: a part's geometry goes by its brand and size, and some images, grids and geometries are missing."""
    part = M.table(spark, sf, "part").select("p_partkey", F.concat("p_brand", F.lit("-"), "p_size").alias("geom_name"), F.col("p_size").cast("int").alias("g"))
    geoms = part.select("geom_name", "g").distinct()
    flag = lambda m: F.col("g") % m == 0
    known = geoms.where("g % 11 > 0").select("geom_name", flag(2).alias("perspective"), flag(3).alias("curved"), flag(5).alias("folded"), flag(7).alias("crumpled"))
    at = lambda a, b, c: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (r * a + k * b + c).cast("double")))
    g = F.col("g")
    grids = geoms.where("g % 13 > 0").select("geom_name", at(g % 5, F.lit(40), g).alias("xs"), at(F.lit(30), F.when(g % 4 == 0, -9).otherwise(2), g + 50).alias("ys"))
    images = part.where("p_partkey % 17 > 0").select(F.concat("p_partkey", F.lit(".png")).alias("name"))
    samples = part.select(F.col("p_partkey").alias("sample_id"), "geom_name")
    point = lambda k: [F.col("corners")[k][c].alias(f"{c}{k}") for c in "xy"]
    one = lambda kind: Z.grid_labels(samples, known, grids, images, kind).select(F.lit(kind or "any").alias("kind"), "sample_id", "image", "status", *point(0), *point(1), *point(2), *point(3))
    return reduce(DataFrame.unionByName, (one(k) for k in (None, *Z.KINDS)))


def sheet_layouts(spark, sf):
    """Header, columns and footers of a made page of each supplier: lines in one or two columns, some with a line above, and below them a wide line, one from the left, a short one or none."""
    k = F.col("s_suppkey").cast("int")
    w, h = 120 + k % 3 * 20, 200 + k % 4 * 40
    two = k % 5 < 3
    sized = M.spread(M.table(spark, sf, "supplier").select("s_suppkey")).select(k.alias("page"), w.alias("w"), h.alias("h"), two.alias("two"), (k % 4 == 0).alias("head"), (k % 7).alias("foot"))

    w, h, foot = F.col("w"), F.col("h"), F.col("foot")
    cells = lambda ink: F.transform(F.sequence(F.lit(0), w - 1), lambda x: F.coalesce(ink(x), F.lit(False)).cast("int"))
    end = F.when(foot == 1, w * 0.9).when(foot.isin(2, 3), w * 0.55).when(foot == 4, w * 0.3)
    # a row of a page is one of four
    text = cells(lambda x: ~(F.col("two") & (x >= w / 2 - 6) & (x < w / 2 + 6)) & (x % 3 > 0))
    rows = F.struct(text.alias("text"), cells(lambda x: (x >= 20) & (x < 100)).alias("head"), cells(lambda x: (x >= 4) & (x < end)).alias("low"), cells(lambda x: x < 0).alias("none"))

    def line(r, y):
        kind = F.when((y >= h * 0.15) & (y < h * 0.85) & (y % 4 < 2), r["text"]).when(F.col("head") & (y >= 2) & (y < 6), r["head"])
        return kind.when((y >= h * 0.93) & (y < h * 0.93 + F.when(foot == 3, 4).otherwise(2)), r["low"]).otherwise(r["none"])

    mask = G.let(rows, lambda r: F.flatten(F.transform(F.sequence(F.lit(0), h - 1), lambda y: line(r, y))))
    return Q.analyze(sized.select("page", "w", mask.alias("a")), "page", "a", "w")


def registry_files(spark, sf):
    """The documents as registry files of 100 entries or so, read back as one registry."""
    path = f"{tables.shared_folder(spark)}/registry-{uuid.uuid4().hex}"
    k = F.col("doc_id")
    entries = M.table(spark, sf, "documents").select(
        k.cast("string").alias("id"), F.concat(F.lit("/scans/"), "source", F.lit("/"), k, F.lit(".jpg")).alias("filePath"), (k % 4 * 90).cast("int").alias("rotationDeg"),
        F.col("n_chars").cast("long").alias("createdAt"), F.when(k % 3 == 0, 2).alias("schemaVersion"), F.when(k % 5 == 0, "metadata").alias("orientationMode"),
    )
    R.write_registry(entries, path, block=100)
    return R.read_registry(spark, path).select("id", "filePath", "rotationDeg", "createdAt", "schemaVersion", "orientationMode")


QUERIES = {f.__name__: f for f in (synthetic_samples, grid_labels, registry_files, sheet_layouts)}

ORACLE_SQL = {
    "synthetic_samples": """WITH n AS (SELECT s_suppkey, list_transform(range(6), lambda i: CAST('0x' || substr(md5('7:' || s_suppkey || ':' || i), 1, 8) AS BIGINT) / 4294967296.0) AS u FROM supplier),
        s AS (SELECT s_suppkey, CAST(floor(320 + 780 * u[1]) AS INT) AS src_w, CAST(floor(320 + 780 * u[2]) AS INT) AS src_h, u FROM n),
        c AS (SELECT *, least(256.0::DOUBLE / src_w, 256.0::DOUBLE / src_h) AS f, (0.1::DOUBLE + (0.25::DOUBLE - 0.1::DOUBLE) * u[3]) * (src_w - 1) AS l, (0.1::DOUBLE + (0.25::DOUBLE - 0.1::DOUBLE) * u[4]) * (src_h - 1) AS t,
            (1 - (0.1::DOUBLE + (0.25::DOUBLE - 0.1::DOUBLE) * u[5])) * (src_w - 1) AS r, (1 - (0.1::DOUBLE + (0.25::DOUBLE - 0.1::DOUBLE) * u[6])) * (src_h - 1) AS b FROM s),
        q AS (SELECT s_suppkey, src_w, src_h, l * f + (256 - src_w * f) / 2 AS x0, t * f + (256 - src_h * f) / 2 AS y0, r * f + (256 - src_w * f) / 2 AS x2, b * f + (256 - src_h * f) / 2 AS y2 FROM c),
        m AS (SELECT *, CAST((floor(x2 / 4 - 0.5) - ceil(x0 / 4 - 0.5) + 1) * (floor(y2 / 4 - 0.5) - ceil(y0 / 4 - 0.5) + 1) AS INT) AS cells FROM q)
        SELECT s_suppkey, src_w, src_h, round(x0, 5) AS x0, round(y0, 5) AS y0, round(x2, 5) AS x2, round(y2, 5) AS y2, cells, 16 * cells AS bright,
            CAST(floor(y0 / 4) * 64 + floor(x0 / 4) AS INT) AS first, CAST(floor(y2 / 4) * 64 + floor(x2 / 4) AS INT) AS third FROM m""",
    "grid_labels": """WITH p AS (SELECT p_partkey, CAST(p_size AS INT) AS g FROM part), k AS (SELECT unnest(['any', 'perspective', 'curved', 'folded', 'crumpled']) AS kind),
        s AS (SELECT kind, p_partkey, g, CASE kind WHEN 'any' THEN true WHEN 'perspective' THEN g % 11 = 0 OR (g % 2 = 0 AND g % 3 > 0 AND g % 5 > 0 AND g % 7 > 0)
            WHEN 'curved' THEN g % 11 = 0 OR (g % 3 = 0 AND g % 5 > 0 AND g % 7 > 0) WHEN 'folded' THEN g % 11 > 0 AND g % 5 = 0 ELSE g % 11 > 0 AND g % 7 = 0 END AS fits FROM p, k),
        t AS (SELECT *, CASE WHEN NOT fits THEN 'skipped' WHEN p_partkey % 17 = 0 THEN 'no_image' WHEN g % 13 = 0 THEN 'no_grid' ELSE 'labelled' END AS status FROM s),
        c AS (SELECT *, g % 5 AS a, CASE WHEN g % 4 = 0 THEN -9 ELSE 2 END AS d FROM t)
        SELECT kind, CAST(p_partkey AS VARCHAR) AS sample_id, status, CASE WHEN ok THEN concat('uvdoc_', p_partkey, '.png') END AS image,
            CASE WHEN ok THEN CAST(g AS DOUBLE) END AS x0, CASE WHEN ok THEN CAST(g + 50 AS DOUBLE) END AS y0, CASE WHEN ok THEN CAST(g + 120 AS DOUBLE) END AS x1, CASE WHEN ok THEN CAST(g + 50 + 3 * d AS DOUBLE) END AS y1,
            CASE WHEN ok THEN CAST(g + 120 + 2 * a AS DOUBLE) END AS x2, CASE WHEN ok THEN CAST(g + 110 + 3 * d AS DOUBLE) END AS y2, CASE WHEN ok THEN CAST(g + 2 * a AS DOUBLE) END AS x3, CASE WHEN ok THEN CAST(g + 110 AS DOUBLE) END AS y3
        FROM (SELECT *, status = 'labelled' AS ok FROM c) AS c""",
    "registry_files": """SELECT CAST(doc_id AS VARCHAR) AS id, concat('/scans/', source, '/', doc_id, '.jpg') AS filePath, CAST(doc_id % 4 * 90 AS INT) AS rotationDeg, n_chars AS createdAt,
        CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS schemaVersion, CASE WHEN doc_id % 5 = 0 THEN 'metadata' ELSE 'baked' END AS orientationMode FROM documents""",
    # a page's only deep valley is the gap between its two columns, so the SQL looks for runs below a third of the largest place
    "sheet_layouts": """WITH s AS (SELECT CAST(s_suppkey AS INT) AS page, CAST(120 + s_suppkey % 3 * 20 AS INT) AS w, CAST(200 + s_suppkey % 4 * 40 AS INT) AS h, s_suppkey % 5 < 3 AS two, s_suppkey % 4 = 0 AS head, s_suppkey % 7 AS foot FROM supplier),
        i AS (SELECT *, unnest(range(h)) AS y FROM s), j AS (SELECT *, unnest(range(w)) AS x FROM i),
        ink AS (SELECT page, w, h, x, y FROM j WHERE (y >= h * 0.15 AND y < h * 0.85 AND y % 4 < 2 AND NOT (two AND x >= w / 2 - 6 AND x < w / 2 + 6) AND x % 3 > 0) OR (head AND y BETWEEN 2 AND 5 AND x BETWEEN 20 AND 99)
            OR (y >= h * 0.93 AND y < h * 0.93 + CASE foot WHEN 3 THEN 4 ELSE 2 END AND x >= 4 AND x < CASE foot WHEN 1 THEN w * 0.9 WHEN 2 THEN w * 0.55 WHEN 3 THEN w * 0.55 WHEN 4 THEN w * 0.3 END)),
        e AS (SELECT page, w, h, CAST(floor(h * 0.12) AS INT) AS up, CAST(h - floor(h * 0.08) AS INT) AS low FROM s),
        d AS (SELECT e.*, (SELECT count(*) FROM ink WHERE ink.page = e.page AND y < up) / (w * up) AS above, (SELECT count(*) FROM ink WHERE ink.page = e.page AND y >= low) / (w * (h - low)) AS below FROM e),
        b AS (SELECT page, w, h, CASE WHEN up >= 20 AND above > 0.01 AND above < 0.5 THEN up END AS header, CASE WHEN h - low >= 20 AND below > 0.01 AND below < 0.5 THEN low END AS footer FROM d),
        body AS (SELECT *, coalesce(header, 0) AS top, coalesce(footer, h) AS bottom FROM b),
        line AS (SELECT page, y, count(*) AS n, min(x) AS x0, max(x) AS x1 FROM ink GROUP BY page, y),
        prof AS (SELECT p.page, p.x, p.w, count(k.x) AS v FROM (SELECT page, w, top, bottom, unnest(range(w)) AS x FROM body) AS p LEFT JOIN ink AS k ON k.page = p.page AND k.x = p.x AND k.y >= p.top AND k.y < p.bottom GROUP BY p.page, p.x, p.w),
        smooth AS (SELECT page, x, w, floor(sum(v) OVER z / count(*) OVER z) AS v FROM prof WINDOW z AS (PARTITION BY page ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
        most AS (SELECT page, max(v) AS m FROM smooth WHERE x >= floor(w * 0.05) AND x < w - floor(w * 0.05) GROUP BY page),
        valley AS (SELECT page, (min(x) + max(x) + 1) // 2 AS cut, count(*) AS n, any_value(w) AS w FROM (SELECT smooth.page, x, w, x - row_number() OVER (PARTITION BY smooth.page ORDER BY x) AS run FROM smooth JOIN most USING (page)
            WHERE x >= floor(w * 0.15) AND x < w - floor(w * 0.15) AND v < floor(m * 0.35)) AS r GROUP BY page, run HAVING count(*) >= floor(any_value(w) * 0.015)),
        cols AS (SELECT body.page, unnest(CASE WHEN cut IS NULL THEN [{'k': 0, 'l': 0, 'r': body.w}] ELSE [{'k': 0, 'l': 0, 'r': cut}, {'k': 1, 'l': cut, 'r': body.w}] END) AS c FROM body LEFT JOIN valley ON valley.page = body.page),
        part AS (SELECT o.page, o.c.k AS k, o.c.l AS l, o.c.r AS r, body.top, body.bottom, unnest(range(body.top, body.bottom)) AS y FROM cols AS o JOIN body ON o.page = body.page),
        fill AS (SELECT part.page, part.k, part.y, part.top, part.bottom, part.l, part.r, count(ink.x) AS n FROM part LEFT JOIN ink ON ink.page = part.page AND ink.y = part.y AND ink.x >= part.l AND ink.x < part.r GROUP BY ALL),
        hole AS (SELECT page, k, max(y) + 1 AS edge FROM (SELECT *, y - row_number() OVER (PARTITION BY page, k ORDER BY y) AS run FROM fill WHERE n < floor((r - l) * 0.01)) AS f
            GROUP BY page, k, run, top, bottom HAVING count(*) >= greatest(5, floor((bottom - top) * 0.02))),
        rest AS (SELECT page, min(edge) AS place FROM (SELECT o.page, o.c.k, coalesce(max(hole.edge), any_value(body.bottom)) AS edge FROM cols AS o JOIN body ON body.page = o.page LEFT JOIN hole ON hole.page = o.page AND hole.k = o.c.k GROUP BY o.page, o.c.k) AS q GROUP BY page),
        run AS (SELECT page, kind, min(y) AS place, count(*) AS n FROM (SELECT page, kind, y, y - row_number() OVER (PARTITION BY page, kind ORDER BY y) AS run FROM (
                SELECT line.page, y, 'wide' AS kind FROM line JOIN body ON body.page = line.page WHERE y < bottom AND y >= bottom - floor(h * 0.2) AND x1 - x0 > w * 0.6
                UNION ALL SELECT line.page, y, 'low' FROM line JOIN body ON body.page = line.page JOIN valley ON valley.page = line.page WHERE y < bottom AND y >= bottom - floor(h * 0.1) AND x0 < floor(body.w * 0.1) AND x1 > CASE WHEN cut < body.w // 2 THEN body.w ELSE cut END AND x1 - x0 > body.w * 0.3) AS u) AS t GROUP BY page, kind, run),
        cand AS (SELECT page, 1 AS nth, max(place) AS place, 0.01 AS lo, 0.15 AS hi FROM run WHERE kind = 'wide' GROUP BY page UNION ALL SELECT page, 2, max(place), 0.01, 0.12 FROM run WHERE kind = 'low' AND n >= 3 GROUP BY page UNION ALL SELECT page, 3, place, 0.03, 0.15 FROM rest),
        fits AS (SELECT cand.page, min(struct_pack(nth := nth, place := place)) AS f FROM cand JOIN body ON body.page = cand.page JOIN valley ON valley.page = cand.page WHERE footer IS NULL AND place > 0 AND place < bottom AND bottom - place >= floor(h * lo) AND bottom - place <= floor(h * hi)
            AND (SELECT coalesce(sum(n), 0) FROM line WHERE line.page = cand.page AND y >= place AND y < bottom) / (body.w * (bottom - place)) BETWEEN 0.0100001 AND 0.4999999 GROUP BY cand.page)
        SELECT page, 'HEADER' AS type, -1 AS column_index, 0 AS "left", 0 AS top, w AS "right", header AS bottom FROM body WHERE header IS NOT NULL
        UNION ALL SELECT page, 'FOOTER', -1, 0, footer, w, h FROM body WHERE footer IS NOT NULL
        UNION ALL SELECT body.page, 'FOOTER', -1, 0, f.place, w, bottom FROM fits JOIN body ON body.page = fits.page
        UNION ALL SELECT o.page, 'COLUMN', o.c.k, o.c.l, body.top, o.c.r, coalesce(fits.f.place, body.bottom) FROM cols AS o JOIN body ON body.page = o.page LEFT JOIN fits ON fits.page = o.page""",
}
