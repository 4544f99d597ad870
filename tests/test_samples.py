"""Made samples, grid files and labels, evenly spaced rows and registry files against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import datasets as D
from vellum.operators import samples as Z
from vellum.sources import documents as R


def test_samples_do_not_depend_on_partitions(spark):
    ids = spark.range(40).withColumn("id", F.when(F.col("id") < 39, F.col("id")))
    make = lambda df: sorted((r["id"] is None, r["id"], r["src_w"], r["sum"], r["q"]) for r in Z.synthetic(df, "id", 3).select("id", "src_w", "q", F.hash("image", "heat", "mask").alias("sum")).collect() if r["id"] is not None)
    assert make(ids.repartition(7)) == make(ids.coalesce(1)) and len(make(ids)) == 39
    none = Z.synthetic(ids.where("id IS NULL"), "id").first()
    assert none["image"] is None and none["mask"] is None and none["heat"] is None and none["q"] is None


def test_a_sample_against_a_plain_one(spark):
    for r in Z.synthetic(spark.range(6), "id", 5).collect():
        w, h = r["src_w"], r["src_h"]
        assert 320 <= w < 1100 and 320 <= h < 1100
        scale = min(256 / w, 256 / h)
        (l, t), (rr, b) = ((r["corners"][k]["x"], r["corners"][k]["y"]) for k in (0, 2))
        for low, high in ((l / (w - 1), 1 - rr / (w - 1)), (t / (h - 1), 1 - b / (h - 1))):
            assert 0.1 <= low < 0.25 and 0.1 <= high < 0.2500001
        q = np.array([[p["x"], p["y"]] for p in r["q"]])
        assert q == pytest.approx(np.array([[p["x"], p["y"]] for p in r["corners"]]) * scale + [(256 - w * scale) / 2, (256 - h * scale) / 2])
        x = y = np.arange(64) + 0.5
        c = np.clip(q, 0, 255) / 4
        inside = ((x >= c[0, 0]) & (x <= c[2, 0]))[None, :] & ((y >= c[0, 1]) & (y <= c[2, 1]))[:, None]
        mask = np.array(r["mask"]).reshape(64, 64)
        assert (mask == inside).all()
        for k in range(4):
            want = np.exp(-((x[None, :] - c[k, 0]) ** 2 + (y[:, None] - c[k, 1]) ** 2) / 8)
            assert np.array(r["heat"][k]).reshape(64, 64) == pytest.approx(want)
        image = np.array(r["image"]).reshape(256, 256)
        page, ground = image[np.kron(mask, np.ones((4, 4))) > 0], image[np.kron(mask, np.ones((4, 4))) == 0]
        assert 0.8 <= page.mean() <= 0.95 and 0.05 <= ground.mean() <= 0.2 and page.std() == pytest.approx(0.01, rel=0.1) and ground.std() == pytest.approx(0.01, rel=0.1)


def test_grids_of_files(spark, tmp_path):
    a = np.arange(24.0).reshape(2, 3, 4).astype("float32")
    np.save(tmp_path / "good.npy", a)
    np.save(tmp_path / "flat.npy", a[0])
    np.save(tmp_path / "words.npy", np.array([[["a"]], [["b"]]]))
    (tmp_path / "broken.npy").write_bytes(b"\x93NUMPY")
    (tmp_path / "empty.npy").write_bytes(b"")
    (tmp_path / "other.txt").write_text("x")
    got = {r["geom_name"]: r for r in R.read_grids(spark, str(tmp_path)).collect()}
    assert set(got) == {"good", "flat", "words", "broken"} and all(got[k]["xs"] is None for k in got if k != "good")
    assert got["good"]["xs"] == a[0].tolist() and got["good"]["ys"] == a[1].tolist()
    grids = R.read_grids(spark, str(tmp_path))
    samples = spark.createDataFrame([("1", "good"), ("2", "broken"), ("3", "good"), ("4", None)], "sample_id string, geom_name string")
    geometries = spark.createDataFrame([("good", True, True, False, None)], "geom_name string, perspective boolean, curved boolean, folded boolean, crumpled boolean")
    images = spark.createDataFrame([("1.png",), ("2.png",), ("3.jpg",), ("4.png",)], "name string")
    status = lambda kind: [r["status"] for r in Z.grid_labels(samples, geometries, grids, images, kind).orderBy("sample_id").collect()]
    assert status(None) == ["labelled", "no_grid", "no_image", "no_grid"]
    assert status("perspective") == ["skipped", "no_grid", "skipped", "no_grid"] and status("curved") == status(None) and status("folded") == ["skipped"] * 4
    label = Z.grid_labels(samples, geometries, grids, images).where("status = 'labelled'").first()
    assert label["image"] == "uvdoc_1.png" and [tuple(p) for p in label["corners"]] == [(0, 12), (8, 20), (11, 23), (3, 15)]


def test_evenly_spaced_rows_of_a_hot_group(spark):
    sizes = {"hot": 5000, "a": 6, "b": 7, "c": 8, None: 20, "d": 1}
    df = spark.createDataFrame([(g, f"{g}-{i:05d}") for g, n in sizes.items() for i in range(n)], "g string, name string").repartition(9)
    got: dict = {}
    for r in D.subsample(df, "g", "name", 7).collect():
        got.setdefault(r["g"], []).append(int(r["name"][-5:]))
    assert {g: sorted(v) for g, v in got.items()} == {g: (list(range(n)) if n <= 7 else [i * n // 7 for i in range(7)]) for g, n in sizes.items()}
    assert D.subsample(df.where("false"), "g", "name", 7).count() == 0


def test_registry_files(spark, tmp_path):
    entries = spark.createDataFrame([(f"s{k}", k) for k in range(57)], "id string, createdAt long")
    R.write_registry(entries, str(tmp_path / "r"), block=10)
    files = [f for f in (tmp_path / "r").iterdir() if f.name.startswith("part-")]
    assert len(files) >= 4
    assert [(r["id"], r["createdAt"], r["schemaVersion"]) for r in R.read_registry(spark, str(tmp_path / "r")).collect()] == [(f"s{k}", k, 1) for k in range(56, -1, -1)]
    R.write_registry(entries.where("false"), str(tmp_path / "none"))
    assert R.read_registry(spark, str(tmp_path / "none")).count() == 0
