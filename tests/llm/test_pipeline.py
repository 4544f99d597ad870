"""The pipeline's stages, one after the other, on a small folder of tables."""

import random
from zlib import crc32

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    r = random.Random(9)
    path = str(tmp_path_factory.mktemp("tables"))
    docs = list(rows)
    toxic = {}
    for k in range(400):
        i = 5000 + k
        words = [r.choice("lorem ipsum dolor sit amet consectetur elit sed do".split()) + str(r.randrange(60)) for _ in range(30)]
        if k % 5 == 0:
            words[r.randrange(30)] = r.choice(["vilefool", "rottenscum"])
        docs.append((i, " ".join(words), "en", "src9", 1))
        toxic[i] = int(k % 5 == 0)
    leak = "nine brown foxes and seven blue whales sing under the pale winter moon tonight"
    docs += [(9000, f"intro words here {leak} and more", "en", "src1", 1), (9001, "my token = 'abcdef0123456789ABCDEF' stays secret in this little text", "en", "src1", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*((i, 1, t) for i, t in toxic.items()), *((i, 1, 0) for i, *_ in rows)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, toxic


def test_stages(spark, folder, tmp_path):
    path, rows, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
    ids = {name: {r["doc_id"] for r in df.collect()} for name, df in seen.items()}
    held = [i for i in toxic if crc32(str(i).encode()) % 5 == 0]
    assert sum((i in ids["toxicity"]) == (not toxic[i]) for i in held) >= 0.95 * len(held)
    assert {9000, 9001} <= ids["toxicity"] and 9000 in ids["near_dedup"] and 9000 not in ids["decontamination"]
    assert ids["secrets"] == ids["decontamination"] == ids["mixing"]
    clean = seen["secrets"].where("doc_id = 9001").first()
    assert "[SECRET]" in clean["text"] and "abcdef0123456789" not in clean["text"] and clean["n_chars"] == len(clean["text"])
    assert len({r["text"] for r in seen["near_dedup"].collect()}) == seen["near_dedup"].count()


def test_run_equals_the_stages(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert sorted(map(str, corpus_pipeline.run(spark, path).collect())) == sorted(map(str, docs.collect()))


def test_near_dedup_links_edited_copies(spark):
    """The stage equals brute force on five-word shingles at 0.8; edited copies go, looser ones stay."""
    r = random.Random(4)
    texts = []
    for _ in range(40):
        words = ["".join(r.choice("aeioustnrl") for _ in range(5)) for _ in range(150)]
        texts.append(" ".join(words))
        for edits in (1, 2, 3, 4, 6):
            own = list(words)
            for p in r.sample(range(150), edits):
                own[p] = "edited"
            texts.append(" ".join(own))
    texts += ["short text", "short text", "", None]
    sets = [{tuple((t or "").split()[k : k + 5]) for k in range(max(len((t or "").split()) - 4, 1))} for t in texts]
    least = list(range(len(texts)))
    for _ in range(4):
        for i, a in enumerate(sets):
            for j in range(i):
                if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = sorted(i for i, k in enumerate(least) if i == k)
    assert sorted(x["doc_id"] for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == want
    from vellum.llm import shingles

    assert sorted(x["doc_id"] for x in shingles.keep_one(docs, shard=2).collect()) == want


def test_near_duplicates_meet_by_fingerprints(spark, monkeypatch):
    """The stage's links come out of BK-trees of fingerprints: sets with a similarity of 0.8 are within the radius, and without trees there are none."""
    import numpy as np

    from vellum.llm import shingles, simhash

    r = np.random.default_rng(7)
    for n in (5, 6, 9, 20, 90, 1000):
        for _ in range(100):
            a = r.integers(0, 1 << 63, n).astype(np.uint64)
            # as many others in place as a similarity of 0.8 allows
            b = np.concatenate([a[: n - n // 9], r.integers(0, 1 << 63, n // 9).astype(np.uint64)])
            assert (shingles.fingerprint(np.unique(a)) ^ shingles.fingerprint(np.unique(b))).bit_count() <= shingles.RADIUS
            assert (shingles.fingerprint(np.unique(a)) ^ shingles.fingerprint(np.unique(a[: -(-n * 4 // 5)]))).bit_count() <= shingles.RADIUS
    codes = np.array([0, 1, (1 << 64) - 1, 3], np.uint64)
    assert [x.tolist() for x in shingles.near(codes)] == [[0, 1, 3]]
    searched = []
    monkeypatch.setattr(simhash.BKTree, "stars", lambda self, radius: searched.append(radius) or [])
    assert shingles.near(codes) == [] and searched == [shingles.RADIUS]
