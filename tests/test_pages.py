"""Page layout as DataFrame steps against a plain search of each page's array."""

import random

import numpy as np

from vellum.operators import pages as Q
from vellum.operators.assembly import DENSE, FOOTER_SHARE, HEADER_SHARE, LEAST_BAND, THIN
from vellum.operators.layout import COLUMN, INNER, LOW, MARGIN, NARROWEST, dips_of
from vellum.operators.pages import (
    GAP_INK,
    GAP_SHARE,
    LEFT_SHARE,
    LOW_FOOTER,
    LOW_ROWS,
    LOW_SCAN,
    LOW_WIDTH,
    REST_FOOTER,
    SMALLEST,
    WIDE,
    WIDE_FOOTER,
    WIDE_SCAN,
)


def stretches(ok: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true places, ends exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], ok.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def valleys_of(p: np.ndarray) -> list[tuple[int, int]]:
    """The best deep valley of a smoothed profile, else its dips, else the valley around its centre's lowest place."""
    n = len(p)
    outer, inner, narrow = int(n * MARGIN), int(n * INNER), int(n * NARROWEST)
    most = int(p[outer : n - outer].max())
    if not most:
        return []
    deep = [(s + inner, e + inner) for s, e in stretches(p[inner : n - inner] < int(most * LOW)) if e - s >= narrow]
    if deep:
        rate = lambda v: 0.3 / (1 + int(p[v[0] : v[1]].min())) + 0.2 * (v[1] - v[0]) / n + 0.5 * (1 - abs((v[0] + v[1]) // 2 - n // 2) / n)
        return [max(deep, key=rate)]
    if dips := dips_of(p.tolist()):
        return dips
    low = n // 3 + int(p[n // 3 : 2 * n // 3].argmin())
    places = np.arange(n)
    within = (places >= outer) & (places < n - outer)
    left, right = p[within & (places < low - n * 0.05)], p[within & (places >= low + int(n * 0.05))]
    side = min(left.mean(), right.mean()) if len(left) and len(right) else 0.0
    if not side or p[low] >= side * 0.5:
        return []
    around = [(s, e - 1) for s, e in stretches(within & (p < side * 0.6) | (places == low)) if s <= low < e]
    return [v for v in around if v[1] - v[0] >= narrow]


def columns_of(ink: np.ndarray) -> list[tuple[int, int]]:
    """Left and right ends of a page part's columns; one for parts below 100 pixels a side."""
    h, n = ink.shape
    if min(h, n) < SMALLEST:
        return [(0, n)]
    half, sums = max(5, n // 100) // 2, np.append(0, np.cumsum(ink.sum(axis=0)))
    low, high = np.maximum(0, np.arange(n) - half), np.minimum(n, np.arange(n) + half + 1)
    cuts = sorted({(s + e) // 2 for s, e in valleys_of((sums[high] - sums[low]) // (high - low))} - {0})
    parts = list(zip([0, *cuts], [*cuts, n], strict=True))
    wide = [c for c in parts if c[1] - c[0] >= int(n * COLUMN)]
    return parts if len(parts) == 1 else wide or [(0, n)]


def content_end_of(ink: np.ndarray) -> int:
    """Where a column's content ends: the lower edge of the lowest stretch of nearly empty rows that is long enough."""
    h, w = ink.shape
    gaps = [e for s, e in stretches(ink.sum(axis=1) < int(w * 0.01)) if e - s >= max(5, int(h * 0.02))]
    return gaps[-1] if gaps else h


def footer_below(ink: np.ndarray, columns: list[tuple[int, int]], top: int, bottom: int) -> int | None:
    """Top of a footer between a page's columns and `bottom`: lines as wide as the page, else lines from the left margin across the gap, else what follows the columns' ends."""
    h, w = ink.shape
    full = ink.any(axis=1)
    first, last = np.where(full, ink.argmax(axis=1), w), np.where(full, w - 1 - ink[:, ::-1].argmax(axis=1), -1)
    gap_from, gap_to = max((r for l, r in columns if l < w // 2), default=0), min((l for l, r in columns if r > w // 2), default=w)
    room = gap_to - gap_from
    wide = full & (last - first > w * WIDE)
    if room > w * GAP_SHARE:
        wide |= full & (ink[:, gap_from:gap_to].sum(axis=1) > room * GAP_INK)
    low = full & (first < int(w * LEFT_SHARE)) & (last > gap_from) & (last - first > w * LOW_WIDTH)

    def lowest(ok: np.ndarray, scan: float, least: int) -> int:
        begin = max(0, bottom - int(h * scan))
        runs = [s + begin for s, e in stretches(ok[begin:bottom]) if e - s >= least]
        return runs[-1] if runs else 0

    ends = min(top + content_end_of(ink[top:bottom, l:r]) for l, r in columns)
    for at, (least, most) in ((lowest(wide, WIDE_SCAN, 1), WIDE_FOOTER), (lowest(low, LOW_SCAN, LOW_ROWS), LOW_FOOTER), (ends, REST_FOOTER)):
        if 0 < at < bottom and int(h * least) <= bottom - at <= int(h * most) and THIN < ink[at:bottom].mean() < DENSE:
            return at
    return None


def regions_of(ink: np.ndarray) -> list[tuple[str, int, int, int, int, int]]:
    """type, column_index, left, top, right, bottom: header, footer and columns of a page; one BODY if there are none."""
    h, w = ink.shape
    out, top, bottom, closed = [], 0, h, False
    for kind, begin, end in (("HEADER", 0, int(h * HEADER_SHARE)), ("FOOTER", h - int(h * FOOTER_SHARE), h)):
        if end - begin >= LEAST_BAND and THIN < ink[begin:end].mean() < DENSE:
            out.append((kind, -1, 0, begin, w, end))
            top, bottom, closed = (end, bottom, closed) if kind == "HEADER" else (top, begin, True)
    if bottom > top:
        columns = columns_of(ink[top:bottom])
        cut = footer_below(ink, columns, top, bottom) if len(columns) > 1 and not closed else None
        if cut is not None:
            out.append(("FOOTER", -1, 0, cut, w, bottom))
        out += [("COLUMN", k, l, top, r, bottom if cut is None else min(bottom, cut)) for k, (l, r) in enumerate(columns)]
    return out or [("BODY", -1, 0, 0, w, h)]


def made(seed: int) -> np.ndarray:
    """A page of lines in one to three columns, some with a header, a footer of any kind, specks or nothing at all."""
    r = random.Random(seed)
    w, h = r.choice([(80, 120), (140, 90), (160, 260), (200, 330), (260, 420)])
    ink = np.zeros((h, w), bool)
    n, gap, begin, end = r.choice([1, 2, 2, 2, 3]), r.randint(4, 14), int(h * r.choice([0.02, 0.15])), int(h * r.choice([0.8, 0.88, 0.97]))
    wide = (w - gap * (n - 1)) // n
    noise = np.random.default_rng(seed)
    for k in range(n):
        left, stop = k * (wide + gap), end - r.randint(0, h // 12)
        for y in range(begin, stop, 4):
            ink[y : y + 2, left : left + wide] = noise.random((min(2, h - y), min(wide, w - left))) < 0.7
    if r.random() < 0.4:
        ink[3 : 3 + int(h * 0.06) : 3, w // 4 : 3 * w // 4] = True
    for _ in range(r.choice([0, 1, 1, 2])):
        low = end + r.randint(1, max(2, h - end - 4))
        left, right = r.choice([(0, int(w * 0.9)), (int(w * 0.03), int(w * 0.62)), (int(w * 0.3), int(w * 0.7))])
        ink[low : low + r.randint(1, 4), left:right] = noise.random((min(4, h - low), right - left))[: ink[low : low + 4].shape[0]][:1] < 0.6
    if r.random() < 0.2:
        ink |= noise.random((h, w)) < 0.01
    return ink if r.random() > 0.05 else np.zeros((h, w), bool)


def regions(spark, sheets):
    rows = [(k, None if s is None else s.astype(int).ravel().tolist(), 1 if s is None else s.shape[1]) for k, s in sheets.items()]
    df = spark.createDataFrame(rows, "page int, a array<int>, w int")
    got: dict = {}
    for r in Q.analyze(df, "page", "a", "w").collect():
        got.setdefault(r["page"], []).append(tuple(r)[1:])
    return {k: sorted(v) for k, v in got.items()}


def test_regions_equal_a_plain_search(spark):
    sheets = {k: made(k) for k in range(160)}
    want = {k: sorted(regions_of(s)) for k, s in sheets.items()}
    kinds = {tuple(sorted({r[0] for r in v})) for v in want.values()}
    # pages with a footer of the lower band and such with one found below several columns are both among them
    bands = [k for k, v in want.items() if any(r[0] == "FOOTER" and r[3] == sheets[k].shape[0] - int(sheets[k].shape[0] * FOOTER_SHARE) for r in v)]
    found = [k for k, v in want.items() if any(r[0] == "FOOTER" for r in v) and k not in bands]
    assert len(kinds) >= 4 and bands and found
    assert regions(spark, sheets) == want


def test_pages_without_ink_or_cells(spark):
    sheets = {1: None, 2: np.zeros((0, 1), bool), 3: np.zeros((120, 110), bool), 4: np.ones((1, 1), bool), 5: np.ones((300, 200), bool)}
    assert regions(spark, sheets) == {3: [("COLUMN", 0, 0, 0, 110, 120)], 4: [("COLUMN", 0, 0, 0, 1, 1)], 5: [("COLUMN", 0, 0, 0, 200, 300)]}


def test_rows_of_ink_are_not_broadcast(spark):
    """Their files are a fraction of their size, so Spark's own choice would collect them on the driver."""
    from vellum.operators import pages as Q

    rows = spark.createDataFrame([(1, 120, 200, y, [3, 4, 5]) for y in range(200)], "page long, w int, h int, y int, xs array<int>")
    sheets = spark.createDataFrame([(1, 120, 200, None, None, 0, 200)], "page long, w int, h int, header int, footer int, top int, bottom int")
    columns = spark.createDataFrame([(1, 0, 0, 60), (1, 1, 60, 120)], "page long, column_index int, left int, right int")
    plan = Q.footers_below(rows, sheets, columns, "page")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in "".join(x for x in plan.splitlines() if "xs" in x) and plan.count("SortMergeJoin") >= 3
