"""Stream filters: their rules, and the same results from a stream and from a replayed batch."""

import math

import pytest
from pyspark.sql import functions as F

from vellum.operators import review as V
from vellum.operators import search as S
from vellum.streaming import filters as X


def feed(step, frames):
    state, out = None, []
    for f in frames:
        state, result = step(state, f)
        out.append(result)
    return out


def test_throttle():
    frames = [{"ts_ms": t, "value": t} for t in (0, 100, 250, 260, 600)]
    assert [r["value"] if r else None for r in feed(X.throttle(250), frames)] == [0, None, 250, None, 600]
    assert [(r["value"], r["fresh"]) for r in feed(X.throttle(250, repeat=True), frames)][1] == (0, False)


def frame(t, *c):
    return {"ts_ms": t, "corners": list(c) or None, "image_w": 100, "image_h": 100}


def test_one_euro():
    out = feed(X.one_euro(), [frame(0, 0, 0, 10, 10), frame(100, 1, 0, 10, 10), frame(100, 5, 5, 5, 5), frame(200, 90, 0, 10, 10), frame(300), frame(400, 3, 3, 3, 3)])
    assert out[0]["corners"] == [0, 0, 10, 10] and 0 < out[1]["corners"][0] < 1
    assert out[2]["corners"] == out[1]["corners"] and out[3]["corners"] == [90, 0, 10, 10]
    assert out[4]["corners"] is None and out[5]["corners"] == [3, 3, 3, 3]
    assert X.alpha(10, 1) == pytest.approx(1 / (1 + 10 / (2 * math.pi)))


def test_focus():
    out = feed(X.focus, [{"ts_ms": 0, "value": 50.0}, {"ts_ms": 10_000, "value": 25.0}, {"ts_ms": 500_000, "value": 2.5}])
    assert out[0]["score"] == 1.0 and out[1]["score"] == pytest.approx(1.0)
    assert out[2]["score"] == pytest.approx(0.35 * 0.5 + 0.65)


def look(t, hint="OK", quality=0.9, plausible=True, **more):
    return {"ts_ms": t, "plausible": plausible, "quality": quality, "hint": hint, "has_quad": True, "too_small": False, "diopters": 0.0, "event": None} | more


def test_guidance_states():
    out = feed(X.guidance, [look(10_000 + 200 * k) for k in range(14)])
    states = [r["state"] for r in out]
    assert states[:3] == ["NO_DOC", "DOC_UNSTABLE", "DOC_ALIGNING"] and states[7] == "READY" and out[7]["event"] == "READY_ENTER"
    bad = feed(X.guidance, [look(10_000 + 200 * k) for k in range(9)] + [look(20_000 + 200 * k, plausible=False, quality=0.1) for k in range(3)])
    assert [r["state"] for r in bad[-3:]] == ["READY", "READY", "NO_DOC"]
    far = feed(X.guidance, [look(0), look(2000), look(4000), look(6000, "MOVE_LEFT", 0.3), look(8000, "MOVE_LEFT", 0.3), look(8100, "MOVE_LEFT", 0.3), look(10_500, "MOVE_LEFT", 0.3)])
    assert [r["event"] for r in far[3:]] == ["HOLD_STILL", "MOVE_LEFT", None, "MOVE_LEFT"]


def test_system_events_pass_the_limit():
    out = feed(X.guidance, [look(5000), look(5200), look(5300, event="LOW_LIGHT"), look(5400, event="TOO_FAR")])
    assert [r["event"] for r in out] == [None, "HOLD_STILL", "LOW_LIGHT", None]


def test_spoken_hints():
    frames = [{"ts_ms": 10_000 + 700 * k, "hint": "MOVE_UP"} for k in range(7)]
    said = [k for k, r in enumerate(feed(X.spoken_hints(), frames)) if r]
    assert said == [1, 5]


def test_stream_equals_replay(spark, tmp_path):
    rows = [(k % 3, 1000 * k, float(k * 7 % 40)) for k in range(60)]
    df = spark.createDataFrame(rows, "device long, ts_ms long, value double")
    for part in range(3):
        df.where(F.floor(F.col("ts_ms") / 20_000) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = X.stream(source, "device", X.focus, "score double").writeStream.format("memory").queryName("focus").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    streamed = sorted(map(tuple, spark.table("focus").collect()))
    assert streamed == sorted(map(tuple, X.replay(df, "device", X.focus, "score double").collect())) and len(streamed) == 60


def test_in_flight(spark):
    r = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "page_id string, n int")
    assert {x["page_id"] for x in X.in_flight(r, spark.createDataFrame([("b",)], "page_id string")).collect()} == {"a"}


def test_words_split_and_merged(spark):
    df = spark.createDataFrame([(1, 0, "ab cd efgh", 0.0, 0.0, 90.0, 10.0, 50.0), (1, 1, "x", 100.0, 0.0, 110.0, 10.0, 100.0)], "doc_id long, pos int, w string, left double, top double, right double, bottom double, conf double")
    got = [(r["w"], r["left"], r["right"]) for r in V.split_in_middle(df, F.col("pos") == 0).orderBy("pos", "part").collect()]
    assert got == [("ab cd", 0.0, 50.0), ("efgh", 50.0, 90.0), ("x", 100.0, 110.0)]
    one = V.merge_with_next(df, F.col("pos") == 0).collect()
    assert len(one) == 1 and (one[0]["w"], one[0]["right"], one[0]["conf"]) == ("ab cd efgh x", 110.0, pytest.approx((50 * 1100 + 100 * 100) / 1200))


def test_index_updates_equal_a_rebuild(spark):
    pages = spark.createDataFrame([("a", 0, "one two"), ("b", 0, "two three"), ("c", 0, "four")], "scan_id string, page_index int, text string")
    changed = spark.createDataFrame([("b", 0, "five one"), ("c", 0, None)], "scan_id string, page_index int, text string")
    rows = lambda df: sorted(map(str, df.collect()))
    now = S.update_index(*S.index(pages), changed)
    want = S.index(pages.where("scan_id = 'a'").unionByName(changed.where("text IS NOT NULL")))
    assert [rows(x) for x in now] == [rows(x) for x in want]


def test_valid_words(spark):
    words = spark.createDataFrame([("en", "Cat"), ("en", "xx"), ("fr", "zz")], "lang string, w string")
    got = {r["w"]: r["valid"] for r in S.valid_words(words, spark.createDataFrame([("en", "cat")], "lang string, word string")).collect()}
    assert got == {"Cat": True, "xx": False, "zz": True}
