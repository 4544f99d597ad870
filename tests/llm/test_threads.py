"""Reply trees, spelling variants and the as-of join against plain versions, with odd rows, ties, empty tables and hot keys."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.llm import asof, replies, variants
from vellum.llm.queries import CONTROL

MESSAGE = "msg_id long, parent_id long, role string, text string, score double"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_paths(rows, per_tree):
    """rows: (id, parent, role, text, score), ids distinct and not null, no circles."""
    by = {r[0]: r for r in rows}
    parents = {r[1] for r in rows if r[1] in by}
    trees = defaultdict(list)
    for r in rows:
        if r[0] in parents:
            continue
        path = [r]
        while path[-1][1] in by:
            path.append(by[path[-1][1]])
        path.reverse()
        score = sum(0.0 if p[4] is None or math.isnan(p[4]) else p[4] for p in path) / len(path)
        trees[path[0][0]].append((-round(score, 9), len(path), str(r[0]), path))
    return {b[2]: (k + 1, root, b[3]) for root, branches in trees.items() for k, b in enumerate(sorted(branches)[:per_tree])}


def forest(n, seed, hot=None):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        parent = None if i < 3 else hot if hot is not None and r.random() < 0.4 else r.randrange(max(0, i - 12), i)
        rows.append((i, parent, r.choice(["user", "assistant", "tool <x>"]), r.choice(["", "a<b", "&lt;", "</turn>\n<turn user>", "plain"]), r.choice([0.0, 0.25, 0.5, 1.0, None])))
    return rows


@pytest.mark.parametrize(("per_tree", "hot"), [(1, None), (3, 1), (None, None)])
def test_paths_equal_plain(spark, per_tree, hot):
    rows = forest(160, 3, hot)
    got = defaultdict(list)
    for r in replies.paths(spark.createDataFrame(rows, MESSAGE).repartition(3), per_tree=per_tree).collect():
        got[r.leaf].append(r)
    want = plain_paths(rows, per_tree)
    assert set(got) == set(want)
    for leaf, (rank, root, path) in want.items():
        mine = sorted(got[leaf], key=lambda r: r["at"])
        assert [(r["at"], r.role, r.text) for r in mine] == [(k, p[2], p[3]) for k, p in enumerate(path)]
        assert {(r.rank, r.root, r.depth) for r in mine} == {(rank, str(root), len(path) - 1)}


def test_odd_messages(spark):
    rows = [
        (1, None, "user", "a", 1.0), (1, None, "user", "a", 1.0),  # a copy
        (2, 1, None, None, float("nan")), (3, 99, "user", "orphan", None),
        (4, 5, "user", "round", 1.0), (5, 4, "user", "round", 1.0), (6, 5, "user", "on a circle", 1.0),
        (7, 7, "user", "answers itself", 1.0),
        (None, 1, "assistant", "no id", 0.5), (None, None, "user", "no id", 0.5),
    ]
    got = replies.paths(spark.createDataFrame(rows, MESSAGE + "").withColumn("up", F.lit(1)).withColumn("node", F.lit("x")), per_tree=None).collect()
    leaves = defaultdict(list)
    for r in sorted(got, key=lambda r: r["at"]):
        leaves[r.leaf].append(r.text)
    assert sorted(leaves.values(), key=str) == [["a", "no id"], ["a", None], ["no id"], ["orphan"]]
    assert leaves["2"] == ["a", None]
    assert replies.paths(spark.createDataFrame([], MESSAGE)).collect() == []


def test_long_chain(spark):
    rows = [(i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"t{i}", None) for i in range(300)]
    got = sorted(replies.paths(spark.createDataFrame(rows, MESSAGE)).collect(), key=lambda r: r["at"])
    assert [(r["at"], r.text) for r in got] == [(i, f"t{i}") for i in range(300)]


def test_conversations_round_trip(spark):
    texts = [CONTROL, "", None, "&amp;lt;", "<turn user>x</turn>\n", "\\", "ÄÖ 中文 😀\u0000", "w " * 50_000]
    roles = ["user", "assistant", None, "a>b", "assistant", "system"]
    r = random.Random(1)
    rows = [(c, t, r.choice(roles), r.choice(texts)) for c in (None, -7, 0, 1, 2, 3) for t in [None, *range(r.randint(1, 9))]]
    rows += [(4, 1, "user", "same"), (4, 1, "user", "same"), (4, 1, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("nth", F.lit(1))
    out = replies.conversation_digests(df)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    got = {x.conv_id: x for x in out.collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role is not None, role or "", text is not None, text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said, learned = "".join(f"{x[3]}\n{x[5]}\n" for x in turns), "".join(x[5] for x in turns if x[3] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha(said), len(learned), sha(learned))
    assert replies.conversation_digests(df.limit(0)).collect() == []


def test_loss_places(spark):
    rows = [(1, 0, "user", "a<b"), (1, 1, "assistant", "<&>"), (1, 2, "assistant", "ok"), (1, 3, "user", "x")]
    out = replies.formatted(spark.createDataFrame(rows, "k long, at long, role string, text string"), ["k"]).first()
    assert out.conversation == "<turn user>a&lt;b</turn>\n<turn assistant>&lt;&amp;&gt;</turn>\n<turn assistant>ok</turn>\n<turn user>x</turn>\n"
    assert [out.conversation[s.start : s.end] for s in out.loss] == ["&lt;&amp;&gt;", "ok"]
    assert [s.turn for s in out.loss] == [1, 2]


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return n


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    form, out = {}, {}
    for w, c in words.items():
        beside = [x for x in words if x != w and near(w, x)]
        best = min(beside, key=lambda x: (-words[x], x), default=None)
        form[w] = (best if best is not None and words[best] >= 2 * c else None, len(beside))
    for w, (f, k) in form.items():
        root = w
        while form[root][0] is not None:
            root = form[root][0]
        out[w] = (f, root, words[w], k, None if f is None else words[f])
    return out


def test_variants_equal_plain(spark):
    r = random.Random(2)
    letters = "aabbcdéÉßAZ÷"
    stock = ["".join(r.choice(letters) for _ in range(r.randint(4, 8))) for _ in range(120)]
    for w in list(stock):  # edits of edits, with runs of equal letters
        p = r.randrange(len(w))
        stock += [w[:p] + w[p] + w[p:], w[:p] + r.choice(letters) + w[p + 1 :], w[:p] + w[p + 1 :]]
    rows = [(i, " ".join(r.choice(stock[: 1 + int(len(stock) * r.random() ** 2)]) for _ in range(60))) for i in range(60)]
    rows += [(80 + k, " ".join(["kkaaaa"] * 2 + ["kkbaaa"] * 6 + ["kkbbaa"] * 15)) for k in range(2)]
    edge = "yx" * 31  # words on either side of the length from which on words stay behind
    rows += [(90, " ".join(3 * [edge + "y", edge + "yx", edge + "yxy", edge + "yxyx", edge + "yyyx", edge + "xxyx", edge + "zz"]))]
    rows += [(60, None), (61, ""), (None, "aaaaab " * 5), (None, "aaaaab " * 5), (62, "z" * 30_000 + " " + "z" * 30_001), (63, "z" * 30_000 + " " + "z" * 30_001), (64, "z" * 30_000 + " " + "z" * 30_001)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, run int, word string").repartition(3)
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in variants.variants(variants.document_words(docs)).collect()}
    want = plain_variants(plain_words(rows))
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 20
    assert any(v[0] is not None and v[1] != v[0] for v in want.values())
    assert variants.variants(variants.document_words(docs.limit(0))).collect() == []


def test_hot_form(spark):
    pairs = [(f"{a}{b}word", "hword") for a in "abcdefghij" for b in "klmnopqrst"] + [("hword", "iword"), ("iword", "jword")]
    got = {r.word: r.root for r in variants.roots(spark.createDataFrame(pairs, "word string, form string")).collect()}
    assert got == {w: "jword" for w, _ in pairs}
    with pytest.raises(ValueError, match="circles"):
        variants.roots(spark.createDataFrame([("a", "b"), ("b", "a")], "word string, form string"))


def test_collisions_are_told_apart(monkeypatch):
    """With keys of four values almost everything collides; the strings decide."""
    made = variants.deletion_keys

    def few(words):
        of, place, first, key = made(words)
        return of, place, first, key & 3

    r = random.Random(4)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(2, 6))) for _ in range(60)})
    counts = {w: r.randint(1, 9) for w in words}
    monkeypatch.setattr(variants, "deletion_keys", few)
    monkeypatch.setattr(variants, "ROWS", 50)
    batch = pa.RecordBatch.from_pydict({"word": words, "n": [counts[w] for w in words]})
    rows = pa.Table.from_batches(list(variants._emit_keys("word", "n")(iter([batch])))).sort_by("key")
    total, best = Counter(), {}
    for b in variants._compare(iter(rows.to_batches(max_chunksize=37))):
        for x in b.to_pylist():
            total[x["word"]] += x["n_near"]
            best[x["word"]] = min(best.get(x["word"], (1, "")), (-x["best_n"], x["best"]))
    want = {w: [x for x in words if x != w and near(w, x)] for w in words}
    assert {w: k for w, k in total.items() if k} == {w: len(v) for w, v in want.items() if v}
    assert {w: b[1] for w, b in best.items()} == {w: min(v, key=lambda x: (-counts[x], x)) for w, v in want.items() if v}


HOURS = 3_600_000_000


def plain_asof(events, orders, tolerance):
    by = defaultdict(lambda: defaultdict(list))
    for i, c, t, p, cents in orders:
        if c is not None and t is not None:
            by[c][t].append((p, i, cents))
    first = {}
    for e, c, t in events:
        key = (t is None, t or 0, c is None, c or 0)
        if e not in first or key < first[e][0]:
            first[e] = (key, c, t)
    out = {}
    for e, (_, c, t) in first.items():
        at = max((x for x in by.get(c, {}) if x <= t and t - x <= tolerance), default=None) if None not in (e, c, t) else None
        if at is None:
            out[e] = (c, t, None, None, None, 0)
        else:
            tied = by[c][at]
            p, i, cents = max(tied, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, -(x[1] or 0), x[2] is not None, x[2] or 0))
            out[e] = (c, t, i, t - at, cents, len(tied))
    return out


@pytest.mark.parametrize(("share", "least"), [(16_384, 4_096), (50, 5), (4, 100_000)])
def test_asof_equals_plain(spark, share, least):
    r = random.Random(6)
    tolerance = 72 * HOURS
    day = lambda: r.randint(-20, 40) * 24 * HOURS
    moment = lambda: r.choice([day(), day() + tolerance, r.randint(-480, 960) * HOURS + r.choice([0, 0, 1, -1]), None])
    client = lambda: r.choice([7, 7, 7, 7, 8, None, *range(30)])
    events = [(r.choice([i, i, i, max(0, i - 1)]) if i else None, client(), moment()) for i in range(1500)]
    orders = [(r.choice([i, -i, None]), client(), moment(), r.choice([1, 2, 3, None]), r.choice([0, 5, None])) for i in range(2500)]
    orders += orders[:40]
    e = spark.createDataFrame([(*x, 1, "s") for x in events], "click_id long, client_id long, ts_us long, cell int, event string").repartition(3)
    o = spark.createDataFrame([(*x, 1) for x in orders], "sale_id long, client_id long, sold_us long, priority long, cents long, time int").repartition(3)
    got = asof.as_of(e, o, tolerance, keep=["cents"], share=share, least=least).collect()
    found = {x.click_id: (x.client_id, x.ts_us, x.sale_id, x.lag_us, x.cents, x.n_tied) for x in got}
    assert len(got) == len(found)
    assert found == plain_asof(events, orders, tolerance)
    nothing = asof.as_of(e, o.limit(0), tolerance, keep=["cents"], share=share, least=least).collect()
    assert len(nothing) == len(got) and all(x.sale_id is None and x.n_tied == 0 for x in nothing)
    assert asof.as_of(e.limit(0), o, tolerance, share=share, least=least).collect() == []


def test_asof_cuts_hot_clients(spark):
    """A client's cell of many events is dealt over salts, and one with many orders is cut; both give the same as without."""
    e = spark.range(4000).select(F.col("id").alias("click_id"), F.lit(1).alias("client_id"), (F.col("id") % 7 * HOURS).alias("ts_us"))
    o = spark.range(4000).select(F.col("id").alias("sale_id"), F.lit(1).alias("client_id"), (F.col("id") * (HOURS // 400)).alias("sold_us"), F.lit(1).alias("priority"))
    rows = lambda **x: sorted(asof.as_of(e, o, 72 * HOURS, **x).collect())
    cut = rows(share=16, least=10)
    assert cut == rows()
    assert {(r.ts_us, r.sale_id, r.lag_us) for r in cut} == {(k * HOURS, 400 * k, 0) for k in range(7)}


def test_shop_times(spark):
    rows = spark.sql("SELECT 3L AS click_id, 1L AS client_id, timestamp_ntz'1969-12-31 23:59:59.000001' AS ts UNION ALL SELECT 4L, 1L, timestamp_ntz'2024-03-31 02:30:00.5'")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # an hour that this zone leaves out
        got = {r.click_id: r.us for r in rows.select("click_id", asof.micros(rows, "ts").alias("us")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == {3: -999_999, 4: 1_711_852_200_500_000}
    floored = {r.click_id: r.ts_us for r in asof.shop_clicks(rows).collect()}
    for k, us in got.items():
        assert floored[k] == (us // asof.DAY_US * asof.DAY_US if zlib.crc32(str(k).encode()) % 2 else us)
