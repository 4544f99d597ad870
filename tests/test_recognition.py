"""Pages of recognised quads, figures, tables, reports, files put in place at once, schedules, images and the saved index."""

import json
import math
import os
import random
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vellum.functions import warps as K
from vellum.operators import assembly as A
from vellum.operators import evaluation as E
from vellum.operators import figures as U
from vellum.operators import recognition as R
from vellum.plans import search_queries
from vellum.sources import files, images
from vellum.streaming import filters as X
from vellum.streaming import schedules

QUAD = "array<struct<x: double, y: double>>"
RECOGNISED = f"page long, nth int, quad {QUAD}, text string, conf double, tokens array<struct<text: string, conf: double, first: int, last: int>>, frames int, scaled double, padded double, profile array<int>, width int, height int"


def box(left, top, right, bottom):
    return [(float(left), float(top)), (float(right), float(top)), (float(right), float(bottom)), (float(left), float(bottom))]


def ink(*runs, width=40, height=10):
    return [255 * height if any(a <= x <= b for a, b in runs) else 0 for x in range(width)]


def read(spark, rows):
    quads = spark.createDataFrame(rows, RECOGNISED).repartition(3)
    return {r.page: r for r in R.read_pages(R.recognised(quads)).collect()}


def quad(page, nth, at, text, conf=0.5, tokens=None, frames=None, scaled=None, padded=None, profile=None, width=None, height=None):
    return (page, nth, box(*at), text, conf, tokens, frames, scaled, padded, profile, width, height)


def test_page_of_quads(spark):
    got = read(spark, [
        quad(1, 0, (200, 0, 240, 20), "world", 0.9), quad(1, 1, (0, 2, 40, 22), "hello", 0.8),
        quad(1, 2, (0, 50, 40, 70), "שלום", 0.6), quad(1, 3, (100, 51, 140, 71), "אבג", 0.7), quad(1, 4, (200, 50, 240, 70), "ab", 0.5),
        quad(1, 5, (0, 100, 100, 120), "one two", 0.4, [("one", 0.2, 0, 3), ("two", 0.6, 5, 9)], 10, 80.0, 100.0),
        quad(1, 6, (0, 150, 40, 170), "", 0.1), quad(1, 7, (60, 150, 100, 170), None, None),
        quad(2, 0, (0, 0, 40, 10), "", 0.0),
    ])
    page = got[1]
    # the second line reads from its right side: the last quad first, every text turned around
    assert page.text == "hello world\nba גבא םולש\none two\n"
    assert [w.text for w in page.words] == ["hello", "world", "םולש", "גבא", "ab", "one", "two"]
    assert page.conf == math.floor((80 + 90 + 60 + 70 + 50 + 20 + 60) / 7 + 0.5)
    assert (page.words[5].box.left, page.words[5].box.right) == (0.0, 50.0) and page.words[6].box.left == 62.5
    assert page.lines == 4
    assert (got[2].text, got[2].conf, got[2].words) == ("", None, [])


def test_token_over_ink(spark):
    two, three = ink((0, 14), (25, 39)), ink((0, 9), (15, 24), (30, 39))
    cases = {
        "abcdef": (two, ["abc", "def"]), "abcdefg": (three, ["ab", "cde", "fg"]), "ab": (three, ["a", "b"]), "a": (two, ["a"]), "a b": (two, ["a b"]),
        "שלוםםם": (two, ["שלוםםם"]), "whole": (ink((0, 39)), ["whole"]), "none": (None, ["none"]), "  trim ": (two, ["tr", "im"]),
    }
    got = read(spark, [quad(k, 0, (0, 0, 80, 20), t, profile=p, width=40, height=10) for k, (t, (p, _)) in enumerate(cases.items())])
    for k, (text, (_, words)) in enumerate(cases.items()):
        said = [w.text for w in got[k].words]
        assert said == ([text[::-1]] if text[0] == "ש" else words), text
    assert got[0].text == "abc def" and [(w.box.left, w.box.right) for w in got[0].words] == [(0.0, 30.0), (50.0, 80.0)]
    assert not read(spark, [quad(0, 0, (0, 0, 80, 20), "abcd", profile=two, width=7, height=10)])[0].words[1:]


def plain_split(text, widths):
    cursor, seen, out = 0, 0, []
    for i, w in enumerate(widths):
        seen += w
        end = len(text) if i == len(widths) - 1 else math.floor(seen * len(text) / sum(widths) + 0.5)
        end = min(len(text), max(end, cursor + 1))
        out.append(text[cursor:end])
        cursor = end
    return [t for t in out if t]


def test_split_equals_plain(spark):
    r = random.Random(3)
    rows = []
    for k in range(120):
        cuts = sorted(r.sample(range(1, 60), 2 * r.randint(2, 5)))
        rows.append((k, "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))), [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]))
    df = spark.createDataFrame(rows, "k int, t string, s array<struct<start: int, end: int>>")
    q = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in box(0, 0, 60, 10)))
    for row in df.select("k", R.split_words(q, F.col("t"), F.lit(50.0), F.col("s"), F.lit(60), F.lit(10)).alias("w")).collect():
        _, text, segs = rows[row.k]
        want = plain_split(text, [b - a + 1 for a, b in segs])
        assert (row.w is None) == (len(want) < 2)
        if row.w is None:
            continue
        assert [w.text for w in row.w] == want
        assert all(w.box.left == pytest.approx(a) and w.box.right == pytest.approx(b + 1) for w, (a, b) in zip(row.w, segs, strict=False))


def test_maps_to_pages(spark):
    m = np.zeros((40, 60))
    m[5:15, 5:25] = 0.9
    maps = spark.createDataFrame([(1, m.ravel().tolist(), 60), (2, [0.0] * 2400, 60)], "page long, p array<double>, w int")
    frames = [[0.1, 0.8, 0.1], [0.9, 0.05, 0.05], [0.1, 0.2, 0.7]]
    crops = spark.createDataFrame([(1, 0, frames, 48.0, 48.0, None, None, None)], "page long, nth int, frames array<array<double>>, scaled double, padded double, profile array<int>, width int, height int")
    got = {r.page: r for r in R.read_maps(maps, crops, F.array(F.lit(""), F.lit("h"), F.lit("i"))).collect()}
    assert (got[1].text, got[1].conf, len(got[1].words)) == ("hi", 75, 1)
    assert (got[2].text, got[2].conf, got[2].words, got[2].lines) == ("", None, [], 0)


@pytest.mark.parametrize(
    ("rows", "bands"),
    [
        ([0] * 2 + [9] * 8 + [0] * 4 + [9] * 8 + [0] * 2, [(2, 9), (14, 21)]),
        ([9] * 5 + [0] * 1 + [9] * 2 + [0] * 5 + [9] * 6, [(0, 7), (13, 18)]),  # a thin band joins the one above it
        ([9] * 5 + [0] * 4 + [9] * 2 + [0] * 5 + [9] * 6, [(0, 4), (16, 21)]),  # too far away: left out
        ([9] * 20, None), ([0] * 20, None), ([9] * 7, None), ([0, 9, 9, 9, 9, 9, 0, 0, 0], None),
    ],
)
def test_bands(spark, rows, bands):
    got = spark.range(1).select(R.bands_of(F.array(*map(F.lit, rows))).alias("b")).first().b
    assert (None if got is None else [(b.start, b.end) for b in got]) == bands


def plain_outer(a):
    """Outer components by flood fills."""
    h, w = a.shape
    big = np.pad(a, 1)

    def fill(seen, y, x, ok, steps):
        todo, out = [(y, x)], []
        seen[y, x] = True
        while todo:
            y, x = todo.pop()
            out.append((y, x))
            for dy, dx in steps:
                v, u = y + dy, x + dx
                if 0 <= v < h + 2 and 0 <= u < w + 2 and ok[v, u] and not seen[v, u]:
                    seen[v, u] = True
                    todo.append((v, u))
        return out

    four = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    ground = np.zeros_like(big, bool)
    fill(ground, 0, 0, big == 0, four)
    seen, boxes = np.zeros_like(big, bool), []
    for y, x in zip(*np.nonzero(big), strict=True):
        if not seen[y, x]:
            cells = fill(seen, y, x, big != 0, [*four, (1, 1), (1, -1), (-1, 1), (-1, -1)])
            if any(ground[v + dy, u + dx] for v, u in cells for dy, dx in four):
                boxes.append((min(u for _, u in cells) - 1, min(v for v, _ in cells) - 1, max(u for _, u in cells), max(v for v, _ in cells)))
    return boxes


def test_outer_boxes():
    r = np.random.default_rng(5)
    for k in range(40):
        a = (r.random((r.integers(1, 14), r.integers(1, 14))) < 0.2 + 0.015 * k).astype(int)
        assert sorted(U.outer_boxes(a != 0)) == sorted(plain_outer(a))


def test_opening():
    a = np.array([[1, 1, 1, 0, 1, 1, 0, 1]], bool)
    assert U.opened(a, 3).astype(int).tolist() == [[1, 1, 1, 0, 0, 0, 0, 0]]
    # beyond the page nothing is worn off: runs at the edge last with half a length
    assert U.opened(np.array([[1, 1, 0, 0, 0, 0, 1]], bool), 3).astype(int).tolist() == [[1, 1, 0, 0, 0, 0, 0]]
    assert U.opened(np.ones((2, 5), bool), 10).all() and not U.opened(np.zeros((2, 5), bool), 3).any()


def test_boxes_apart(spark):
    r = random.Random(8)
    some = lambda n: [(p, k, x, y, x + r.randint(0, 90), y + r.randint(0, 90)) for k in range(n) for p, x, y in [(r.randint(0, 2), r.randint(-50, 900), r.randint(-50, 900))]]
    a, b = some(300), some(80)
    schema = "page int, nth int, left int, top int, right int, bottom int"
    got = {(x.page, x.nth) for x in U.apart(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
    meet = lambda x, y: x[0] == y[0] and x[2] < y[4] and y[2] < x[4] and x[3] < y[5] and y[3] < x[5] and min(x[4] - x[2], x[5] - x[3], y[4] - y[2], y[5] - y[3]) > 0
    assert got == {x[:2] for x in a if not any(meet(x, y) for y in b)}
    assert 0 < len(got) < len(a)


def test_table_within_a_column(spark):
    m = np.zeros((200, 300), int)
    m[:, 5:8] = 1  # a rule down the page that is no part of the column
    m[40:121:40, 100:261] = 1
    m[40:121, 100:261:80] = 1
    pages = spark.createDataFrame([(1, m.ravel().tolist(), 300)], "page long, mask array<int>, w int")
    areas = [(1, 1, "TABLE", 80, 20, 290, 150), (1, 2, "COLUMN", 80, 20, 290, 150), (1, 3, "TABLE", 10, 0, 90, 200), (1, 4, "TABLE", 80, 20, 400, 150)]
    found = U.region_tables(pages, spark.createDataFrame(areas, "page long, id int, type string, left int, top int, right int, bottom int"))
    row = found.collect()
    assert len(row) == 1 and (row[0].id, row[0].n_rows, row[0].n_cols, row[0].header) == (1, 2, 2, True)
    assert row[0].conf == pytest.approx((0.6 + 0.8) / 2)
    assert [(c.row, c.col, c.cell_left, c.cell_top) for c in U.cells(found).orderBy("row", "col").collect()] == [(0, 0, 100, 40), (0, 1, 180, 40), (1, 0, 100, 80), (1, 1, 180, 80)]


def test_report_is_nested(spark, tmp_path):
    rows = [("s1", "a", None, 0.95, 2.0, 0.01), ("s1", "b", None, 0.90, 2.1, 0.01), ("s1", "c", "oob", None, 9.0, 0.1), ("s2", "a", "oob", 0.5, 1.0, 0.1), ("s2", "b", None, 0.7, 5.0, 0.1), ("s2", "c", "oob", 0.7, 5.0, 0.1)]
    results = spark.createDataFrame(rows, "name string, model string, reason string, iou double, mae double, mae_rel double")
    E.write_report(results, str(tmp_path / "r"), {"device": "cpu"})
    parts = {}
    for r in spark.read.text(str(tmp_path / "r")).collect():
        parts.setdefault(r.section, []).append(json.loads(r.value))
    assert parts["meta"] == [{"device": "cpu"}]
    a = next(m for m in parts["models"] if m["model"] == "a")
    assert a["fail"] == {"count": 1, "rate": 0.5, "by_reason": {"oob": 1}} and a["iou"]["mean"] == 0.95
    assert sorted((p["model_a"], p["model_b"], p["wins"]["a"], p["wins"]["b"], p["ties"]) for p in parts["pairwise"]) == [("a", "b", 1, 1, 0), ("a", "c", 1, 0, 1), ("b", "c", 2, 0, 0)]
    assert sorted((w["model"], w["other"], w["name"]) for w in parts["worse_cases"]) == [("a", "b", "s2"), ("b", "a", "s1"), ("c", "a", "s1"), ("c", "b", "s1"), ("c", "b", "s2")]
    assert len(parts["samples"]) == 6 and {"model": "c", "image": "s1", "fail": True, "fail_reason": "oob", "corner_mae_px": 9.0} in parts["samples"]
    for x, y in (("a", "b"), ("b", "c")):
        wins = {r.winner: r.n for r in E.compare(results, x, y).collect()}
        pair = next(p for p in parts["pairwise"] if (p["model_a"], p["model_b"]) == (x, y))
        assert (wins.get("a", 0), wins.get("b", 0), wins.get("tie", 0)) == (pair["wins"]["a"], pair["wins"]["b"], pair["ties"])


def test_replace_and_run_once(spark, tmp_path):
    path = str(tmp_path / "registry.json")
    files.replace(spark, path, "one")
    files.replace(spark, path, "two ä")
    assert open(path, encoding="utf-8").read() == "two ä"
    assert [n for n in os.listdir(tmp_path) if n.endswith(".tmp")] == []
    assert files.create_absent(spark, f"{path}.mark", "x") and not files.create_absent(spark, f"{path}.mark", "y")
    assert open(f"{path}.mark").read() == "x"
    calls = []

    def job():
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("half-way")
        return 7

    marker = str(tmp_path / "done")
    with pytest.raises(RuntimeError):
        files.run_once(spark, marker, job)
    assert files.run_once(spark, marker, job) == 7 and files.run_once(spark, marker, job) == 0
    assert len(calls) == 2


def test_batches_are_whole_and_once(spark, tmp_path):
    source, target, tries = str(tmp_path / "in"), str(tmp_path / "out"), []
    spark.range(5).write.parquet(source)

    def put(df, path):
        tries.append(1)
        if len(tries) == 1:  # dies after a part of the batch is written
            df.limit(2).write.parquet(path)
            raise RuntimeError("half-way")
        df.write.parquet(path)

    def run(check):
        stream = spark.readStream.schema("id long").parquet(source)
        q = stream.writeStream.foreachBatch(files.commit_batch(target, put)).option("checkpointLocation", str(tmp_path / check)).trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="half-way"):
        run("c")
    assert not os.path.isdir(f"{target}/batch=0")
    run("c")
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [0, 1, 2, 3, 4]
    run("d")  # a lost checkpoint: the same batch once more
    assert spark.read.parquet(target).count() == 5 and len(tries) == 2


def test_scheduled_clean_up(spark, tmp_path):
    folder, log = tmp_path / "files", str(tmp_path / "log")
    folder.mkdir()
    for name, age in (("Scan_a.jpg", 30), ("Scan_b.jpg", 1), ("other.jpg", 30), ("Scan_c.png", 30)):
        (folder / name).write_bytes(b"x")
        os.utime(folder / name, (time.time() - age * 3600,) * 2)
    start = lambda: schedules.scheduled_clean_up(spark, str(folder), 24, "Scan_", ".jpg", "1 second", str(tmp_path / "c"), log)
    q = start()
    try:
        for _ in range(120):
            if os.path.isdir(log) and len([n for n in os.listdir(log) if not n.startswith(".")]) >= 2:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    runs = {int(n): open(f"{log}/{n}").read() for n in os.listdir(log) if not n.startswith(".")}
    assert runs[0] == "1" and runs[1] == "0"
    assert sorted(n for n in os.listdir(folder) if not n.startswith(".")) == ["Scan_b.jpg", "Scan_c.png", "other.jpg"]
    q = start()
    try:
        for _ in range(60):
            if len([n for n in os.listdir(log) if not n.startswith(".")]) > len(runs):
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert open(f"{log}/0").read() == "1"  # the restart repeated nothing


SQUARE = [0.0, 0.0, 100.0, 0.0, 100.0, 100.0, 0.0, 100.0]


def drag(*places, index=1, corners=SQUARE):
    state, out = None, []
    for x, y in places:
        state, got = X.snap()(state, {"ts_ms": 0, "corners": corners, "index": index, "x": x, "y": y})
        out.append((got["x"], got["y"], got["prev"], got["next"]))
    return out


def test_snap():
    tan = lambda d: 100 * math.tan(math.radians(d))
    # far from the neighbour below, so that only the edge to the left can hold: enter at 1.5 degrees, hold to 3
    at = [(100.0 + 40, -1.4 * tan(d)) for d in (2.0, 1.4, 2.9, 3.1, 2.0)]
    assert [r[2] for r in drag(*at)] == [False, True, True, False, False]
    assert drag(*at)[1][:2] == (140.0, 0.0) and drag(*at)[3][:2] == at[3]
    # both edges, one along each axis
    assert drag((101.0, 1.0)) == [(100.0, 0.0, True, True)]
    # both on the same axis: the nearer one holds
    flat = [0.0, 0.0, 50.0, 1.0, 100.0, 1.0, 50.0, 100.0]
    assert drag((50.0, 0.5), corners=flat) == [(50.0, 0.0, True, False)]
    # the nearer axis, y = 1, would put three corners in a row or bend the quad in: given up
    assert drag((60.0, 0.9), corners=flat) == [(60.0, 0.9, False, False)]
    # a drawn place that makes the quad flat is given up
    assert drag((50.0, 0.5), corners=[0.0, 0.0, 50.0, 10.0, 100.0, 0.0, 50.0, 100.0]) == [(50.0, 0.5, False, False)]
    assert drag((100.0, 1.0), index=5)[0][2:] == (False, False) and drag((1.0, 1.0), corners=None) == [(1.0, 1.0, False, False)]


def test_quad_confidence(spark):
    q = lambda *p: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p))
    of = lambda c: spark.range(1).select(K.quad_confidence(c, F.lit(200.0), F.lit(100.0)).alias("v")).first().v
    square = [(0, 0), (100, 0), (100, 100), (0, 100)]
    assert of(q(*square)) == pytest.approx(0.5 * 0.5 + 0.3 + 0.2 * (1 - 1e-6))
    assert of(q(*(square[k] for k in (2, 0, 3, 1)))) == pytest.approx(of(q(*square)))
    assert of(q((0, 0), (10, 0), (10, 10), (0, 10))) == 0.0
    assert of(F.lit(None).cast("array<struct<x: double, y: double>>")) == 0.0
    sharp = of(q((0, 0), (100, 0), (190, 90), (90, 90)))
    assert sharp == pytest.approx(0.5 * 9000 / 20000 - 0.3 / 120 + 0.2 * (1 - 1e-6))


def tiff(orientation, order=">"):
    return (b"MM" if order == ">" else b"II") + struct.pack(order + "HIHHHIHH", 42, 8, 1, 0x0112, 3, 1, orientation, 0) + b"\0\0\0\0"


def jpeg(width, height, orientation=None, order=">"):
    exif = b""
    if orientation is not None:
        body = b"Exif\0\0" + tiff(orientation, order)
        exif = b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + exif + b"\xff\xdb\x00\x04ab" + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\x01\x11\x00" + b"\xff\xd9"


def png(a, colour=0, kind=0, orientation=None):
    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    h, w = a.shape[:2]
    per = {0: 1, 2: 3, 6: 4}[colour]
    raw, above = b"", np.zeros(w * per, int)
    for row in a.reshape(h, w * per).astype(int):
        left = np.concatenate([np.zeros(per, int), row[:-per]])
        corner = np.concatenate([np.zeros(per, int), above[:-per]])
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        raw += bytes([kind]) + ((row - {0: 0 * row, 1: left, 2: above, 3: (left + above) // 2, 4: near}[kind]) & 255).astype(np.uint8).tobytes()
        above = row
    exif = chunk(b"eXIf", tiff(orientation)) if orientation else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + exif + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_headers(spark, tmp_path):
    for k in range(1, 9):
        (tmp_path / f"o{k}.jpg").write_bytes(jpeg(40 + k, 30, k, "><"[k % 2]))
    (tmp_path / "plain.jpg").write_bytes(jpeg(7, 9))
    (tmp_path / "cut.jpg").write_bytes(jpeg(7, 9)[:8])
    (tmp_path / "text.png").write_bytes(b"no image")
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "left.txt").write_bytes(b"")
    got = {os.path.basename(r.path): tuple(r)[1:] for r in images.headers(images.read(spark, str(tmp_path))).collect()}
    assert {f"o{k}.jpg": ("jpeg", 40 + k, 30, k) for k in range(1, 9)}.items() <= got.items()
    assert got["plain.jpg"] == ("jpeg", 7, 9, 1)
    assert [got[n] for n in ("cut.jpg", "text.png")] == [(None,) * 4] * 2 and not {"empty.png", "left.txt"} & set(got)
    turned = spark.createDataFrame([(k,) for k in range(0, 10)], "o int").select("o", images.rotation(F.col("o")).alias("d"), *(c.alias(n) for n, c in zip("wh", images.upright_size(F.lit(4), F.lit(3), F.col("o")), strict=True)))
    assert {r.o: (r.d, r.w, r.h) for r in turned.collect()} == {k: {3: (180, 4, 3), 6: (90, 3, 4), 8: (270, 3, 4)}.get(k, (0, 4, 3)) for k in range(10)}


def test_image_pixels(spark, tmp_path):
    r = np.random.default_rng(2)
    grey, colour = r.integers(0, 256, (9, 14)), r.integers(0, 256, (9, 14, 3))
    for kind in range(5):
        (tmp_path / f"g{kind}.png").write_bytes(png(grey, 0, kind))
        (tmp_path / f"c{kind}.png").write_bytes(png(colour, 2, kind, 6))
    (tmp_path / "cut.png").write_bytes(png(grey)[:60])
    (tmp_path / "photo.jpg").write_bytes(jpeg(14, 9, 1))
    luma = colour @ [299, 587, 114] // 1000
    of = lambda most: {os.path.basename(x.path): x for x in images.pixels(images.read(spark, str(tmp_path)), most).collect()}
    for name, x in of(4096).items():
        want = None if name in ("cut.png", "photo.jpg") else grey if name[0] == "g" else np.rot90(luma, -1)
        assert (x.luma, x.width) == (None, None) if want is None else (x.height, x.width, list(x.luma)) == (*want.shape, want.ravel().tolist())
    small = of(4)["g0.png"]
    assert (small.sample, small.width, small.height) == (2, 7, 5)
    assert list(small.luma) == [int(grey[y : y + 2, x : x + 2].mean()) for y in range(0, 9, 2) for x in range(0, 14, 2)]


def test_search_after_a_change(spark, tmp_path):
    table = lambda words: spark.createDataFrame([Row(doc_id=k, text=w, lang="en", source="s", n_chars=5) for k, w in enumerate(words)]).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    terms = lambda: {r.term for r in search_queries.search_index(spark, str(tmp_path)).collect()}
    table(["alpha", "beta"])
    assert terms() == {"alpha", "beta"} == terms()
    table(["gamma", "delta"])
    assert terms() == {"gamma", "delta"}


def test_figures_are_looked_for_once(spark, monkeypatch):
    """Both steps of apart() read what components() found, not the masks again."""
    pages = spark.createDataFrame([(1, [0] * 30 + ([0] * 2 + [1] * 4 + [0] * 4) * 4 + [0] * 30, 10)], "page long, mask array<int>, w int")
    none = spark.createDataFrame([], "page long, left int, top int, right int, bottom int")
    found = U.figures(U.components(pages), none)
    assert [tuple(r) for r in found.select("left", "top", "right", "bottom").collect()] == [(2, 3, 6, 7)]
    assert "PythonUDF" not in found._jdf.queryExecution().optimizedPlan().toString() and "pandas" not in found._jdf.queryExecution().executedPlan().toString().lower()


def test_events_and_pages_are_spread_over_the_cores(spark):
    from vellum.plans import geometry_queries as GQ
    from vellum.plans import recognition_queries as RQ

    folder = "/root/testdata/sf0.001"
    cores = spark.sparkContext.defaultParallelism
    for df in (GQ.frames(spark, folder), RQ.figure_pages(spark, folder), RQ.ruled_pages(spark, folder)):
        assert df.rdd.getNumPartitions() >= cores


def test_tokens_are_split_in_batches(spark):
    """The words of split tokens, made for a whole batch at once, are those of split_words() on the segments of each line; odd lines among them."""
    rng = random.Random(5)
    rows = []
    for k in range(400):
        n = rng.choice([0, 1, 7, 40, 90])
        ink = None if k % 29 == 0 else [v for _ in range(n) for v in [rng.choice([0, 0, 5000])] * rng.choice([1, 3, 9])]
        x, y = rng.random() * 50, rng.random() * 50
        quad = [(x, y), (x + 80.5, y + rng.random()), (x + 81, y + 12), (x - 1, y + 11.25)]
        text = rng.choice(["", "a", " ab\t", "two words", "\x00wörd😀s\x1f", "long" * 6, "שלום", "x" * 3, None])
        rows.append((k, quad, text, rng.choice([None, 0.3, 1.7, -1.0]), ink, rng.choice([None, 7, 40, len(ink or [])]), rng.choice([None, 3, 4, 10, 30])))
    df = spark.createDataFrame(rows, "k int, quad array<struct<x: double, y: double>>, text string, conf double, profile array<int>, width int, height int").withColumns(
        {"tokens": F.lit(None).cast("array<struct<text: string, conf: double, first: int, last: int>>"), "frames": F.lit(0), "scaled": F.lit(1.0), "padded": F.lit(1.0)}
    )
    got = {r.k: r for r in R.recognised(df.repartition(3)).collect()}
    found = {k: [] if ink is None or high is None or text == "שלום" else A.segments_of(ink, high) for k, _, text, _, ink, _, high in rows}
    segments = spark.createDataFrame(list(found.items()), "k int, found array<struct<start: int, end: int>>")
    conf = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("conf", F.lit(0.0)) * 100))
    plain = df.join(segments, "k").select("k", R.split_words(F.col("quad"), F.coalesce("text", F.lit("")), conf, F.col("found"), F.col("width"), F.col("height")).alias("w")).collect()
    split = [r for r in plain if r.w is not None]
    assert len(split) > 20 and all(got[r.k].words == r.w and got[r.k].emitted == " ".join(w.text for w in r.w) for r in split)
    assert all(len(got[r.k].words) < 2 and got[r.k].emitted == (got[r.k].text or "") for r in plain if r.w is None)
    assert "split_batch" in R.recognised(df)._jdf.queryExecution().executedPlan().toString()


def test_pages_of_quads_are_split_as_quads_are(spark, monkeypatch):
    """Pages put together before their tokens are split are those of quads split one by one, in pieces of any number of quads."""
    import pyarrow as pa

    rng = random.Random(9)
    rows = []
    for page in range(40):
        for k in range(rng.choice([1, 2, 12])):
            n = rng.choice([0, 7, 40, 90])
            runs = None if rng.random() < 0.1 else [v for _ in range(n) for v in [rng.choice([0, 0, 5000])] * rng.choice([1, 3, 9])]
            x, y = rng.random() * 500, rng.choice([0, 30, 60]) + rng.random() * 9
            tokens = rng.choice([None, None, [], [("q", 0.5, 0, 2)], [("a", 0.2, 0, 3), ("שם", 0.6, 5, 9)], [("", 0.2, 0, 3), (None, 0.6, 5, 9)]])
            text = rng.choice(["", "a", " ab\t", "two words", "wörd😀s", "long" * 6, "שלום", "שלוםab", None])
            rows.append((page or None, k, [(x, y), (x + 80.5, y + 1), (x + 81, y + 12), (x - 1, y + 11.25)], text, rng.choice([None, 0.3, 1.7, -1.0]), tokens, rng.choice([None, 10]), 80.0, 100.0, runs, rng.choice([None, 7, 40, n]), rng.choice([None, 3, 10, 30])))
    quads = spark.createDataFrame(rows, RECOGNISED).repartition(3)
    plain, whole = (sorted(map(repr, f(quads).collect())) for f in (lambda q: R.read_pages(R.recognised(q)), R.read_recognised))
    assert plain == whole and len(plain) == 40
    fields = ("profile", "text", "conf", "corners", "width", "height")
    one = lambda r: dict(zip(fields, (r[9], r[3] or "", r[4] or 0.0, [{"x": a, "y": b} for a, b in r[2]], r[10], r[11]), strict=True))
    kind = pa.list_(pa.struct(list(zip(fields, (pa.list_(pa.int32()), pa.string(), pa.float64(), pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])), pa.int32(), pa.int32()), strict=True))))
    pages = pa.array([[one(r) for r in rows if (r[0] or 0) == k] for k in range(40)] + [[]], kind)
    at_once = R.split_pages.func(pages)
    monkeypatch.setattr(R, "AT_ONCE", 3)
    assert R.split_pages.func(pages).equals(at_once) and any(w for p in at_once.to_pylist() for w in p) and R.split_pages.func(pages[40:]).to_pylist() == [[]]
