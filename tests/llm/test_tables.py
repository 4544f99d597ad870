"""Toxicity, mixing, archives and embeddings against brute force, and odd tables for every operator."""

import base64
import hashlib
import math
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import bpe, common, crosspoly, decontam, maxent, mixing, queries, secrets, simhash, suffix, toxicity, warc


# ---- toxicity


def test_toxicity_finds_held_out_toxic_text(spark):
    r = random.Random(6)
    stock = ["".join(r.choice("aeioustnrl") for _ in range(5)) for _ in range(300)]
    bad = ["vilefool", "rottenscum", "nastyworm"]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 7 == 0
        words = [r.choice(stock) for _ in range(r.randint(10, 60))]
        if toxic:
            words[r.randrange(len(words))] = r.choice(bad)
        docs.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    l = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.predictions(d, l).collect()
    assert len(got) == 900 and all(g["held_out"] == (crc32(str(g["doc_id"]).encode()) % 5 == 0) for g in got)
    out = [g for g in got if g["held_out"]]
    assert np.mean([g["predicted"] == (g["doc_id"] % 7 == 0) for g in out]) > 0.97
    assert all(0 <= g["score"] <= 1 for g in got)


def test_negative_risk_turns_around():
    """A prior above the true share makes the unlabelled risk negative; training still ends with finite weights of the right sign."""
    positive = [np.array([1, 100 + k]) for k in range(40)]
    unlabelled = [np.array([200 + k, 300 + k]) for k in range(60)] + [np.array([1, 9])]
    model = toxicity.fit(positive, unlabelled, 0.6, toxicity.Settings(steps=300))
    assert set(model.by_feature()) == {1} and model.weights[0] > 0 and np.isfinite(model.bias)


def test_only_near_copies_leave_the_training_rows():
    rng = np.random.default_rng(9)
    common = rng.choice(1 << 22, 40, replace=False)
    sets = [np.unique(np.concatenate([rng.choice(common, 12, replace=False), rng.choice(1 << 22, rng.integers(1, 40))])) for _ in range(400)]
    sets += [np.sort(rng.permutation(s)[: len(s) - 1]) for s in sets[:50]] + sets[:20] + [np.empty(0, np.int64)] * 2
    kept = toxicity._unlike(sets)
    same = lambda a, b: len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b)))
    names = {tuple(x) for x in kept}
    for x in sets:
        near = max((same(x, y) for y in kept if len(y)), default=0.0)
        assert tuple(x) in names or near >= 0.8
    assert len(kept) <= 402 and sum(len(x) == 0 for x in kept) == 2


# ---- mixing


def test_targets_are_capped_and_whole():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == pytest.approx([5, 10, 15])
    t = mixing.targets([1, 1000, 10], [1, 2, 3])
    assert t[0] == 3 and t[2] == 30 and sum(t) == pytest.approx(1011)


def test_mix(docs, rows):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    by = defaultdict(lambda: [0, 0, 0.0])
    for g in got:
        text = next(t for i, t, *_ in rows if i == g["doc_id"])
        assert g["size"] == len((text or "").encode().split()) and 0 <= g["taken"] <= 3 * g["size"]
        by[g["source"]][0] += g["size"]
        by[g["source"]][1] += g["taken"]
        by[g["source"]][2] = g["target"]
    names = sorted((s for s in by if s is not None)) + [None]
    want = mixing.targets([by[s][0] for s in names], [1 + k % 3 for k in range(len(names))])
    for s, t in zip(names, want, strict=True):
        assert by[s][2] == pytest.approx(t) and abs(by[s][1] - t) <= max(8, 0.01 * t)


@pytest.mark.parametrize("block", [1, 7, mixing.BLOCK])
def test_mix_equals_a_plain_schedule(spark, docs, rows, block):
    """Slot by slot in plain Python: source, block, words of each document; mix() adds them up."""
    from pyspark.sql import functions as F

    key = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(7)).alias("h")).collect()}
    size = {i: len((t or "").encode().split()) for i, t, *_ in rows}
    names = sorted({s for _, _, _, s, _ in rows if s is not None}) + [None]
    bits = max(0, (len(rows) // mixing.BUCKET_ROWS).bit_length())
    bucket = lambda h: (h % 2**64) >> (64 - bits) if bits else 0
    laid = {s: sorted((i for i, _, _, x, _ in rows if x == s and size[i]), key=lambda i: (bucket(key[i]), key[i], i)) for s in names}
    total = sum(size.values())
    goal = mixing.targets([sum(size[i] for i in laid[s]) for s in names], [1 + k % 3 for k in range(len(names))])
    bounds = np.cumsum([g / total for g in goal])[:-1]
    b = max(1, min(block, -(-total // mixing.LEAST_SLOTS)))
    shares, ranks, want = defaultdict(lambda: [0, None]), defaultdict(int), set()
    words = {s: [(i, k) for i in laid[s] for k in range(size[i])] * 3 for s in names}
    for slot in range(-(-total // b)):
        point = (slot * mixing.GOLDEN + (mixing.GOLDEN >> 1)) % 2**64 / 2**64
        s = names[int(np.searchsorted(bounds, point, side="right"))]
        for i, _ in words[s][ranks[s] * b : (ranks[s] + 1) * b]:
            shares[i][0] += 1
            shares[i][1] = slot if shares[i][1] is None else shares[i][1]
        ranks[s] += 1
    got = {g["doc_id"]: (g["taken"], g["first_slot"]) for g in mixing.mix(docs, block_words=block).collect()}
    assert {i: t for i, (t, _) in got.items()} == {i: shares[i][0] for i in size}
    assert {i: f for i, (_, f) in got.items()} == {i: shares[i][1] for i in size}
    order = mixing.sequence(docs, block_words=block).orderBy("slot", "place").collect()
    assert sum(r["words"] for r in order) == sum(t for t, _ in got.values())
    assert [r["slot"] for r in order] == sorted(r["slot"] for r in order) and all(0 <= r["from"] and r["from"] + r["words"] <= size[r["doc_id"]] for r in order)


def test_mix_of_ties_and_repeats(spark):
    """Rows with one id are documents of their own; equal sizes and ids share the mix."""
    df = spark.createDataFrame([(1, "a b", "s")] * 3 + [(1, "a b", "t"), (2, "", "t"), (None, None, None)], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == 6 and sum(g["taken"] for g in got) == 8 and all(g["taken"] <= 3 * g["size"] for g in got)


def test_schedule_ranks_and_spread(spark):
    got = sorted(map(tuple, mixing.schedule(spark, [0.5, 0.3, 0.2], 20_000).collect()))
    seen: dict = defaultdict(int)
    for slot, sid, rank in got:
        assert rank == seen[sid]
        seen[sid] += 1
        if slot > 500:
            assert abs(seen[sid] - [0.5, 0.3, 0.2][sid] * slot) < 12


# ---- archives


def test_warc(spark, tmp_path):
    r = random.Random(7)
    htmls = [None, "", "<p>a</p>", "x\r\n\r\nWARC/1.1\r\n\r\ny", "é中" * 500]
    pages = [(k, f"http://x/{k}\r\nEvil: 1", htmls[r.randrange(5)] if k % 3 else f"own {k}", "clash") for k in range(90)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload string").repartition(4)
    first: dict = {}
    for k, _, h, _ in pages:
        first.setdefault((h or "").encode(), k)
    for least in (0, 5):
        path = str(tmp_path / f"w{least}")
        got = {g["page_id"]: g for g in warc.archive(df, path, least).collect()}
        assert len(got) == 90
        for k, _, h, _ in pages:
            b = (h or "").encode()
            to = first[b] if first[b] != k and len(b) >= least else None
            assert tuple(got[k])[1:] == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to is None else "revisit", to)


def test_warc_of_odd_rows(spark, tmp_path):
    """Null, repeated and strange ids, payloads that end in or hold line breaks, one large page; every record of its own is valid."""
    import gzip

    big = "x\r\n\r\n" * 400_000
    data = [("null", "u", "a"), (None, "u", "a"), (None, "v", None), (" s p+%", None, "a\r\n"), ("", "w", "\r\n\r\n"), ("r", "1", "one"), ("r", "2", "two"), ("r", "2", "two"), ("z", "u", "\r"), ("big", "u", big), ("zbig", "u", big), ("é\n", "u", "a\r\n")]
    df = spark.createDataFrame(data, "page_id string, url string, html string").coalesce(1)
    path = str(tmp_path / "odd")
    got = sorted(map(tuple, warc.archive(df, path).collect()), key=str)
    ids = lambda h: sorted(i for i, _, x in data if (x or "") == h and i is not None)
    want = []
    for i, _, h in data:
        b = (h or "").encode()
        first = (ids(h or "") or [None])[0]
        to = first if i != first else None
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if to is not None else "response", to))
    assert got == sorted(want, key=str)
    records = [x for f in (tmp_path / "odd").glob("*.gz") for x in warc.parse(gzip.decompress(f.read_bytes()))]
    names = [f["warc-record-id"] for f, _ in records]
    assert len(records) == len(data) and len(set(names)) == len(data) - 1
    for f, block in records:
        assert block.startswith(b"HTTP/1.1 200 OK\r\n") and f["content-type"] == warc.HTTP_TYPE and f["warc-date"] > "2025"
        if f["warc-type"] == "revisit":
            assert f["warc-refers-to"] in names
    # piece by piece the same records are read
    parser, whole = warc.Parser(), gzip.decompress(next((tmp_path / "odd").glob("*.gz")).read_bytes())[:4000]
    assert list(warc.parse(whole)) == [x for k in range(0, len(whole), 7) for x in parser.feed(whole[k : k + 7])]


# ---- embeddings


def brute(vectors, least=0.95):
    ids = [i for i, _ in vectors]
    good = [k for k, (_, v) in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, parent = defaultdict(int), {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in good:
        for b in good:
            u, w = np.array(vectors[a][1], np.float32).astype(float), np.array(vectors[b][1], np.float32).astype(float)
            if a != b and len(u) == len(w) and u @ w / np.sqrt((u @ u) * (w @ w)) >= least:
                n[ids[a]] += 1
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: (n[i], find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("tile", [crosspoly.TILE, 20])
def test_embeddings(spark, tile):
    rng = np.random.default_rng(8)
    vectors = []
    for _ in range(12):
        centre = rng.normal(size=24)
        vectors += [(centre + rng.normal(size=24) * rng.choice([0, 0.1, 0.25])).tolist() for _ in range(9)]
    vectors += [vectors[0]] * 30 + [(np.array(vectors[0]) * 4).tolist(), None, [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [float("inf")] * 24, [1.0, 2.0], [2.0, 4.0]]
    rows = list(enumerate(vectors))
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, node int").repartition(3)
    got = {g["vec_id"]: (g["n_links"], g["component_id"], g["kept"]) for g in crosspoly.near_duplicates(df, tile=tile).collect()}
    want = brute(rows)
    found, all_ = sum(min(got[i][0], want[i][0]) for i in want), sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.99 * all_
    assert got == want


@pytest.mark.parametrize("hashes,tables", [(2, 8), (3, 14), (4, 23)])
@pytest.mark.parametrize("size", [16, 64, 768])
def test_recall_of_buckets(hashes, tables, size):
    """Pairs at a cosine of 0.951 meet in some bucket, with the settings for few, many and very many vectors."""
    rng = np.random.default_rng([hashes, size])
    x, y = (crosspoly.unit_rows(rng.normal(size=(300, size))) for _ in range(2))
    y = crosspoly.unit_rows(y - (x * y).sum(axis=1, keepdims=True) * x)
    near = 0.951 * x + np.sqrt(1 - 0.951**2) * y
    a, b = (crosspoly.codes(v, tables, hashes, 2, 5) for v in (x, near))
    met = ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).any(axis=1)
    assert met.mean() >= 0.95


def test_embeddings_of_odd_rows(spark):
    """Null, repeated and empty: rows that share an id or a vector are rows of their own."""
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, []), (3, None), (4, [0.0, 2.0]), (5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in crosspoly.near_duplicates(df).collect()), key=str)
    assert len(got) == 7 and [r[1] for r in got if r[0] == 1] == [2, 2] and [r[1:3] for r in got if r[0] in (4, 5)] == [(1, 4), (1, 4)]
    assert [r[1:] for r in got if r[0] in (2, 3)] == [(0, 2, True), (0, 3, True)]


def test_full_documents_beside_empty_tables(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    n = docs.count()
    scored = toxicity.predictions(docs, labels).collect()
    assert len(scored) == n and not any(r["predicted"] for r in scored)
    found = decontam.contamination(docs, items).collect()
    assert len(found) == n and not any(r["contaminated"] or r["n_near"] for r in found) and decontam.clean(docs, items).count() == n


def test_hot_keys_are_joined_like_others(spark):
    rows = spark.createDataFrame([(k % 3 if k < 900 else k, k) for k in range(1000)], "u long, v long")
    keyed = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    want = sorted((u, v, min(x for y, x in ((k % 3 if k < 900 else k, k) for k in range(1000)) if y == u)) for u, v in ((k % 3 if k < 900 else k, k) for k in range(1000)))
    for most in (1, 10, 100_000):
        got = sorted(tuple(r) for r in common.spread_join(rows, keyed, "u", "n", 1000, most).select("u", "v", "m").collect())
        assert got == want


def test_plans_of_components_stay_small_with_a_hot_centre(spark, monkeypatch):
    """A driver keeps the plans and the metrics of all their stages: no table of a round may hold the one before over and over."""
    from vellum.llm import components

    r = random.Random(3)
    pairs = [(1_000, k) for k in range(300)] + [(k, k + 1) for k in range(2_000, 2_040)] + [(k, k + 40) for k in range(3_000, 3_100)] + [(299, 2_000), (7, 7)]
    pairs = [p if r.random() < 0.5 else p[::-1] for p in pairs + pairs[:50]]
    exchanges = []

    def stored(df, name):
        exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return common.stored(df, name)

    monkeypatch.setattr(components, "stored", stored)
    got = {x["node"]: x["label"] for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in want:
        before = dict(want)
        for a, b in pairs:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
        if want == before:
            break
    assert got == want
    assert max(exchanges) <= 8


# ---- odd tables


def test_every_operator_takes_odd_rows(spark, odd):
    n = odd.count()
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "same text here for all"), (None, None)], "item_id long, text string")
    ratios = secrets.trained(odd)
    results = [suffix.deduplicate(odd), simhash.near_duplicates(odd), secrets.digests(odd, ratios), decontam.contamination(odd, items), maxent.scores(odd), mixing.mix(odd), toxicity.predictions(odd, labels)]
    P = pytest.importorskip("public_tokenizers")
    results.append(bpe.token_counts(odd, P.path("byte_bpe_50k.json")))
    for df in results:
        assert df.count() == n
    assert set(odd.columns) == set(secrets.redact(odd, ratios).columns) == set(simhash.keep_one(odd).columns) == set(decontam.clean(odd, items).columns)
    by_id = lambda df: df.where("doc_id = 4").first()
    assert by_id(results[0])["n_removed"] == 540_000 and by_id(results[1])["component_id"] == 3
    assert sum(1 for r in simhash.keep_one(odd).collect() if r["text"] == "same text here for all") == 1


def test_every_operator_takes_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    P = pytest.importorskip("public_tokenizers")
    for df in (
        suffix.deduplicate(nothing), simhash.near_duplicates(nothing), simhash.keep_one(nothing), secrets.digests(nothing, secrets.trained(nothing)), decontam.contamination(nothing, items), decontam.clean(nothing, items),
        maxent.scores(nothing), mixing.mix(nothing), toxicity.predictions(nothing, labels), bpe.token_counts(nothing, P.path("byte_bpe_50k.json")), warc.archive(pages), crosspoly.near_duplicates(vectors),
    ):
        assert df.count() == 0


def test_clashing_names(spark):
    """Columns with the names that operators might use inside come out as they went in."""
    names = ["__text", "__id", "__hash", "__base", "__more", "__toxicity", "toxicity_score", "words_of", "whole", "base", "more", "spans", "Text_"]
    data = [(1, "token = abcdefabcdefabcdef", "en", "s", 1, *names), (2, "plain words and no more of them", "en", "s", 1, *names)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([(1, "other words")], "item_id long, text string")
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from vellum.llm import shingles

    for out in (decontam.clean(docs, items), secrets.redact(docs, secrets.trained(docs)), simhash.keep_one(docs), shingles.keep_one(docs), corpus_pipeline.STAGES[2][1](spark, docs, "/root/testdata/sf0.001"), corpus_pipeline.STAGES[0][1](spark, docs, "/root/testdata/sf0.001")):
        assert out.columns == docs.columns
        assert [tuple(r[n] for n in names) for r in out.collect()] == [tuple(names)] * 2


def test_queries_are_all_there():
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n.split("_")[0][2:]))] == [f"op{k}" for k in range(1, 11)]


def test_shared_folder(spark):
    df = common.stored(spark.range(3), "t")
    assert df.count() == 3 and df.inputFiles()[0].startswith(f"file://{common.own_dir(spark)}")
    assert common.own_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def plain_training(positive, unlabelled, prior, s):
    """The same learning in plain Python, feature by feature, over whole sets of words."""
    n_p, n_u = len(positive), len(unlabelled)
    count = lambda sets: {w: sum(w in x for x in sets) for x in sets for w in x}
    in_p, in_u = count(positive), count(unlabelled)
    chance = {w: max(in_u.get(w, 0) / n_u, 0.5 / n_u) * n_p for w in in_p}
    used = sorted(w for w, n in in_p.items() if n >= s.least_positives and n >= s.least_lift * chance[w] and n - chance[w] >= s.deviations * math.sqrt(chance[w]))
    names = [*used, None]  # None: the bias
    w = dict.fromkeys(names, 0.0)
    w[None] = math.log(prior / (1 - prior))
    m, v = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
    out = lambda x: w[None] + sum(w[k] for k in x if k in w)
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    softplus = lambda z: max(z, 0) + math.log1p(math.exp(-abs(z)))
    for step in range(1, s.steps + 1):
        grad = {k: s.decay / n_p * w[k] if k is not None else 0.0 for k in names}
        risk = sum(softplus(out(x)) for x in unlabelled) / n_u - prior * sum(softplus(out(x)) for x in positive) / n_p
        for sets, n, own in ((positive, n_p, True), (unlabelled, n_u, False)):
            for x in sets:
                p = sigmoid(out(x))
                if own:
                    g = (-prior * (1 - p) - prior * p if risk >= 0 else prior * p) / n
                else:
                    g = (p if risk >= 0 else -p) / n
                for k in [*(k for k in x if k in w), None]:
                    grad[k] += g
        for k in names:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
        for k in names:
            w[k] -= s.rate * (m[k] / (1 - 0.9**step)) / (math.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w


def test_toxicity_equals_plain_training(spark):
    """Scores of all rows against plain Python, on rows without near copies; the risk of the unlabelled also turns negative on the way."""
    r = random.Random(12)
    stock = [f"w{k}" for k in range(60)]
    bad = [f"vile{k}" for k in range(4)]
    rows = [(k, " ".join(r.sample(stock, 9) + (r.sample(bad, 2) if k % 4 == 0 else []))) for k in range(120)]
    labels = [(k, int(k % 4 == 0)) for k in range(120) if k % 3]
    held = lambda k: crc32(str(k).encode()) % 5 == 0
    s = toxicity.Settings(steps=60, rate=0.2)
    known = {k: t for k, t in labels if not held(k)}
    prior = min(max(sum(known.values()) / len(known), 1e-4), 0.9)
    words = {k: frozenset(t.split()) for k, t in rows}
    toxic = [words[k] for k, t in known.items() if t]
    rest = [words[k] for k in words if not held(k) and not known.get(k)]
    w = plain_training(toxic, rest, prior, s)
    assert len(w) > 3
    docs = spark.createDataFrame([(k, t.upper() if k % 3 == 0 else t) for k, t in rows], "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.score for x in toxicity.predictions(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), s).collect()}
    for k, x in words.items():
        want = 1 / (1 + math.exp(-(w[None] + sum(w[f] for f in x if f in w))))
        assert got[k] == pytest.approx(want, abs=1e-6)
