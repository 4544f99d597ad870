"""Hand-checked values of the text, layout, geometry, tensor, evaluation and data-set functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import policies as P
from vellum.functions import quads as G
from vellum.functions import tensors as N
from vellum.functions import text as T
from vellum.functions import warps as K
from vellum.operators import assembly as A
from vellum.operators import datasets as D
from vellum.operators import evaluation as E
from vellum.operators import layout as Y
from vellum.operators import library as L
from vellum.operators import pages as Q
from vellum.operators import review as V
from vellum.operators import search as S
from vellum.sources import documents as R


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("word,want", [("cornputer", "computer"), ("aclvance", "advance"), ("follovving", "following"), ("rn", "rn"), ("123456", "123456"), ("1O3", "103"), ("h0use", "hOuse")])
def test_fix_text(spark, word, want):
    assert one(spark, T.fix_text(F.lit(word))) == want


def test_confidence_gates(spark):
    fixed = lambda c: one(spark, T.fix_word(F.lit("c0rner"), F.lit(c)))
    assert (fixed(85.0), fixed(70.0), fixed(69.0)) == ("c0rner", "c0mer", "cOmer")


@pytest.mark.parametrize("word,want", [("Hello,", "Hello"), ('"Hello"', "Hello"), ("...test...", "test"), ("...", "")])
def test_clean_word(spark, word, want):
    assert one(spark, T.clean_word(F.lit(word))) == want


@pytest.mark.parametrize("source,target,want", [("WORLD", "hello", "HELLO"), ("world", "HELLO", "hello"), ("World", "hello", "Hello"), ("wOrLd", "HELLO", "hello")])
def test_case_like(spark, source, target, want):
    assert one(spark, T.case_like(F.lit(source), F.lit(target))) == want


def test_dictionary_corrections(spark):
    known = spark.createDataFrame([("hello",), ("summer",), ("hammer",)], "word string")
    words = ["hell0", "he1lo", "surnmer", "harnmer", "HELL0", "Hell0", "hell0,", "hello", "zzz"]
    got = {r["w"]: r["corrected"] for r in S.corrections(spark.createDataFrame([(w,) for w in words], "w string"), known).collect()}
    assert got == {"hell0": "hello", "he1lo": "hello", "surnmer": "summer", "harnmer": "hammer", "HELL0": "HELLO", "Hell0": "Hello", "hell0,": "hello,"}


@pytest.mark.parametrize("word,want", [("café", "cafe"), ("naïve", "naive"), ('"Café!"', "cafe"), ("(RÉSUMÉ)", "resume")])
def test_suggestion_key(spark, word, want):
    assert spark.createDataFrame([(word,)], "w string").select(T.suggestion_key(F.col("w")).alias("v")).first()["v"] == want


def test_suggestions_are_those_of_all_pairs(spark):
    words, known = ["helo", "sumer", "a", "abcdefgh", "zzzz", "lleho"], ["hello", "help", "summer", "abcdxfgh", "ab", "hell", "yell"]
    got = {(r["w"], r["suggestion"]) for r in S.suggestions(spark.createDataFrame([(w,) for w in words], "w string"), spark.createDataFrame([(w,) for w in known], "word string")).collect()}

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            d = _row(d, i, x, b)
        return d[-1]

    def _row(before, i, x, b):
        row = [i + 1]
        for j, y in enumerate(b):
            row.append(min(before[j] + (x != y), before[j + 1] + 1, row[j] + 1))
        return row

    want = {(w, k) for w in words for k in known if w != k and abs(len(w) - len(k)) <= 2 and 1 - distance(w, k) / max(len(w), len(k)) >= 0.6}
    assert got == want


@pytest.mark.parametrize("a,b,want", [("hi", "hia", 0.5), ("cats", "cat", 0.25), ("abc", "abd", 1 / 3), ("café", "cafe", 0.25), ("", "abc", 1.0), ("", "", 0.0), ("a😀b", "ab", 1 / 3)])
def test_cer(spark, a, b, want):
    assert one(spark, T.cer(F.lit(a), F.lit(b))) == pytest.approx(want)


@pytest.mark.parametrize("a,b,want", [("foo bar baz", "foo bar quux", 1 / 3), ("a b", "a x b", 0.5), ("a b", "a b", 0.0), ("", "", 0.0), ("", "x", 1.0)])
def test_wer(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(T.wer(F.col("a"), F.col("b")).alias("v")).first()["v"] == pytest.approx(want)


def test_strings(spark):
    assert one(spark, T.fts_query(F.lit("  Foo AND b@r  NOT baz_1 "))) == "Foo* br* baz_1*"
    assert one(spark, T.jtrim(F.lit("\t a\n"))) == "a" and one(spark, T.like_pattern(F.lit("a_%\\"))) == "%a\\_\\%\\\\%"
    assert one(spark, T.fix_german(F.lit("StraBe BaB"))) == "Straße BaB"
    assert one(spark, T.put_back(F.lit('"Hell0!"'), F.lit("Hell0"), F.lit("hello"))) == '"Hello!"'
    assert one(spark, T.is_rtl(F.lit("שלום abc"))) is True and one(spark, T.is_rtl(F.lit("abc ש"))) is False
    assert T.whitelist("deu+eng")[:3] == "ABC" and len(set(T.whitelist(None))) == len(T.whitelist(None))


def test_entities(spark):
    df = spark.createDataFrame([("&#39;&#x41;&lt;&amp;lt; &#128512;",), (None,)], "t string")
    got = [r["v"] for r in df.select(T.decode_numeric_wide(F.col("t")).alias("v")).collect()]
    assert got == ["'A&lt;&amp;lt; 😀", None]


def quad(*p):
    return G.quad(*map(F.lit, map(float, p)))


SQUARE = (0, 0, 10, 0, 10, 10, 0, 10)


def test_quads(spark):
    q = quad(*SQUARE)
    bow = quad(0, 0, 10, 10, 10, 0, 0, 10)
    dent = quad(0, 0, 10, 0, 2, 2, 0, 10)
    assert one(spark, G.area(q)) == 100 and one(spark, G.perimeter(q)) == 40 and one(spark, G.aspect(q)) == 1
    assert [one(spark, G.is_convex(x)) for x in (q, bow, dent)] == [True, False, False]
    assert [one(spark, G.crosses_itself(x)) for x in (q, bow, dent)] == [False, True, False]
    assert one(spark, G.oob_sum(quad(-3, 0, 10, 0, 10, 14, 0, 10), F.lit(10.0), F.lit(10.0), 1.0)) == 5
    assert one(spark, G.penalty(q)) == 0 and one(spark, G.penalty(bow)) >= 2e6 and one(spark, G.penalty(F.lit(None).cast("array<struct<x: double, y: double>>"))) == 1e6
    assert [one(spark, G.contains(q, F.lit(x), F.lit(5.0))) for x in (5.0, 0.0, 10.0, 11.0)] == [True, True, True, False]
    ring = one(spark, G.clockwise(F.array(q[2], q[0], q[3], q[1])))
    assert [tuple(p) for p in ring] == [(0, 0), (10, 0), (10, 10), (0, 10)]
    assert one(spark, G.choose_path(bow, q, F.lit(False))) == "MASK" and one(spark, G.choose_path(q, q, F.lit(True))) == "CORNERS"
    assert one(spark, G.confidence01(F.lit(85.0))) == 0.85 and one(spark, G.confidence01(F.lit(float("nan")))) == 0
    assert one(spark, G.nearest_edge(q, F.lit(5.0), F.lit(1.0), 3.0)) == 0 and one(spark, G.nearest_edge(q, F.lit(5.0), F.lit(5.0), 3.0)) == -1


def test_framing(spark):
    hint = lambda *p: one(spark, G.framing(quad(*p), F.lit(100.0), F.lit(100.0)))["hint"]
    assert hint(15, 15, 85, 15, 85, 85, 15, 85) == "OK"
    assert hint(45, 15, 100, 15, 100, 85, 45, 85) == "MOVE_RIGHT" and hint(30, 30, 70, 30, 70, 70, 30, 70) == "MOVE_CLOSER"
    assert hint(15, 10, 85, 25, 85, 75, 15, 90) == "TILT_LEFT"
    assert one(spark, G.framing(F.lit(None).cast("array<struct<x: double, y: double>>"), F.lit(9.0), F.lit(9.0)))["has_doc"] is False


def test_iou(spark):
    df = spark.createDataFrame([(1,)], "x int")
    v = df.select(G.raster_iou(quad(*SQUARE), quad(5, 0, 15, 0, 15, 10, 5, 10), F.lit(20.0), F.lit(20.0), 64).alias("v")).first()["v"]
    assert v == pytest.approx(1 / 3, abs=0.03)


def vocabulary():
    return F.array(*map(F.lit, ["", "a", "b", " "]))


@pytest.mark.parametrize("picks,text,tokens", [([1, 1, 0, 2], "ab", [("ab", 0, 3)]), ([0, 0], "", []), ([1, 0, 1], "aa", [("aa", 0, 2)]), ([1, 2, 3, 1], "ab a", [("ab", 0, 1), ("a", 3, 3)])])
def test_ctc(spark, picks, text, tokens):
    frames = F.array(*(F.array(*(F.lit(0.9 if k == p else 0.1) for k in range(4))) for p in picks))
    got = one(spark, N.ctc(frames, vocabulary()))
    assert got["text"] == text and [(t["text"], t["first"], t["last"]) for t in got["tokens"]] == tokens
    assert got["conf"] == pytest.approx(0.9 if text else 0.0)


def test_tensors(spark):
    a = F.array(*(F.lit(float(v)) for v in [0, 0, 0, 0, 9, 9, 0, 0, 0]))
    assert one(spark, N.argmax(a)) == 4 and tuple(one(spark, N.peak(a, 3, 2.0))) == (3.0, 3.0)
    box = one(spark, G.area(N.oriented_box(F.array(*(F.lit(5.0 if 2 <= k % 8 < 6 and 2 <= k // 8 < 4 else -5.0) for k in range(64))), 8, 1.0)))
    assert box == pytest.approx(3.0, abs=0.2)
    assert one(spark, N.mask_iou(a, a)) == 1
    assert [tuple(s) for s in one(spark, N.share_characters(F.array(F.lit(10.0), F.lit(10.0)), F.lit(5)))] == [(0, 3), (3, 5)]


def boxes(spark, *rows):
    words = [(1, i, f"w{i}", float(x), float(y), float(x + 10), float(y + h)) for i, (x, y, h) in enumerate(rows)]
    return spark.createDataFrame(words, "doc_id long, pos int, w string, left double, top double, right double, bottom double")


def test_line_rules(spark):
    df = boxes(spark, (0, 0, 10), (20, 5, 10), (40, 9, 20), (0, 30, 10))
    lines = lambda rule: Y.pages(df).select(rule(F.col("words")).alias("v")).first()["v"]
    assert lines(Y.fixed_anchor_lines) == [0, 0, 1, 2]
    assert [x["line"] for x in lines(Y.running_mean_lines)] == [0, 0, 1, 2]
    assert lines(Y.integer_first_fit_lines) == [0, 0, 1, 2] and lines(Y.decimal_first_fit_lines) == [0, 1, 2, 3]
    assert one(spark, Y.upper_median(F.array(*(F.lit(v) for v in (1, 2, 3, 4))))) == 3


def test_words_to_text(spark):
    df = boxes(spark, (20, 0, 10), (0, 1, 10), (0, 12, 10), (0, 60, 10))
    assert Y.words_to_text(df).first()["text"] == "w1 w0\nw2\n\nw3"


def test_percentiles(spark):
    df = spark.createDataFrame([(v,) for v in (10, 20, 30, 40)], "v long")
    assert tuple(df.agg(E.nearest_rank("v", 0.5), E.nearest_rank("v", 0.95)).first()) == (20, 40)


DAY = L.DAY_MS


def test_retention(spark):
    now = 100 * DAY
    scans = spark.createDataFrame([(k, now - d * DAY) for k, d in (("a", 5), ("b", 30), ("c", 31), ("d", 60))], "id string, created_at long")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(L.too_old(scans, 30, now)) == ["c", "d"] and ids(L.beyond_count(scans, 1)) == ["b", "c", "d"]
    sizes = lambda **s: spark.createDataFrame(list(s.items()), "id string, size long")
    three = scans.where("id <> 'd'")
    assert ids(L.beyond_storage(three, sizes(a=300, b=200, c=100), 400)) == ["b", "c"]
    assert ids(L.beyond_storage(three.where("id <> 'c'"), sizes(a=300, b=300), 350)) == ["b"] and ids(L.beyond_storage(three, sizes(a=100), 100)) == []


def test_insert_or_abort_fails_on_a_key(spark):
    old = spark.createDataFrame([(1, "a")], "id long, v string")
    with pytest.raises(Exception, match="key exists"):
        L.insert_or_abort(old, old, ["id"])


def test_pairing_is_strict(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("x",)], "k string")
    with pytest.raises(ValueError, match="one to one"):
        D.pair(a, b, "k")


def test_datasets(spark):
    assert one(spark, D.seed_of(F.lit("a.png"), 7)) == 1130080299
    df = spark.createDataFrame([(f"g{k % 10}", k) for k in range(100)], "g string, k long")
    got = {r["split"]: r["n"] for r in D.split_groups(df, "g", (0.7, 0.2), 1).groupBy("split").agg(F.countDistinct("g").alias("n")).collect()}
    assert got == {"train": 7, "val": 2, "test": 1}
    assert D.sample(df, "k", 250, 3).count() == 250 and D.ratios("a=3, b=1") == {"a": 3.0, "b": 1.0}
    assert [r["k"] for r in D.subsample(df.where("g = 'g0'"), "g", "k", 3).orderBy("k").collect()] == [0, 30, 60]


def test_tolerant_json(spark):
    texts = ['{"result":[{"text":"a&lt;","xmin":1,"ymin":2,"xmax":3,"ymax":4,"confidence":"85"}]}', '[{"text":"b","bbox":[1,2,10,4]},{"text":"c","bbox":[5,6,2,3],"confidence":null}]', "{", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [tuple(r) for r in R.parse_words(df).orderBy("id", "pos").collect()]
    assert got == [(0, 0, "a<", 1.0, 2.0, 3.0, 4.0, 0.85), (1, 0, "b", 1.0, 2.0, 10.0, 4.0, 0.0), (1, 1, "c", 5.0, 6.0, 7.0, 9.0, 0.0)]


def test_word_lists_at_once_and_word_by_word(spark):
    """A root array of usual words is read at once; what differs from it in anything gives what its words give one by one."""
    word = '{"text":"a&#66;&lt;","left":1,"top":2.5,"right":3,"bottom":4,"confidence":85}'
    texts = {
        0: f"[{word},{word}]", 1: f' [{word},{{"text":"none"}},{{"text":"c","bbox":[5,6,2,3],"confidence":"50"}}]', 2: word, 3: f"[{word}", 4: '[{"text":1.50,"left":-0.0,"top":"2","right":3,"bottom":4,"confidence":0.5}]',
        5: word.replace('"top"', '"left":7,"top"').join("[]"), 6: word.replace('"confidence"', '"conf"').join("[]"), 7: "[]", 8: "[null]", 9: word.replace("text", "te\\u0078t").join("[]"), 10: f'{{"left":1,"words":[{word}]}}', 11: None,
    }
    usual = lambda pos, conf=0.85: (pos, "aB<", 1.0, 2.5, 3.0, 4.0, conf)
    want = {0: [usual(0), usual(1)], 1: [usual(0), (2, "c", 5.0, 6.0, 7.0, 9.0, 0.5)], 4: [(0, "1.5", 0.0, 2.0, 3.0, 4.0, 0.5)], 6: [usual(0)], 7: [], 8: [], 9: [usual(0)], 10: [usual(0)]}
    df = spark.createDataFrame(list(texts.items()), "words long, text string").repartition(2)
    rows = R.parse_words(df).orderBy("words", "pos").collect()
    assert [tuple(r) for r in rows] == [(k, *w) for k in sorted(want) for w in want[k]]
    lists = R.parse_word_lists(df.withColumnRenamed("words", "k"), "text").collect()
    assert {r.k: r.words and [tuple(w) for w in r.words] for r in lists} == {k: want.get(k) for k in texts}


def test_files(spark, tmp_path):
    (tmp_path / "words.txt").write_text(" Apple \n#note\n\nbee\napple\n")
    assert sorted(r["word"] for r in S.load_dictionary(spark, str(tmp_path / "words.txt")).collect()) == ["apple", "bee"]
    (tmp_path / "reg.json").write_text('{"version":1,"items":[{"id":"a","createdAt":1},{"id":"b","createdAt":2,"schemaVersion":0,"orientationMode":"x"},{"createdAt":3}]}')
    got = [(r["id"], r["schemaVersion"], r["orientationMode"]) for r in R.read_registry(spark, str(tmp_path / "reg.json")).collect()]
    assert got == [("b", 1, "x"), ("a", 1, "baked")]
    (tmp_path / "bad.json").write_text("{")
    assert R.read_registry(spark, str(tmp_path / "bad.json")).count() == 0
    page = '{"schema":1,"words":[{"t":" x ","b":[0,0,9,9]},{"id":7,"t":"y","b":[20,0,29,9]},{"t":"","b":[0,0,9,9]},{"t":"z","b":[0,0,1,9]}]}'
    df = R.parse_pages(spark.createDataFrame([(1, page)], "id long, text string"))
    assert [r["w"] for r in R.page_words(df, "id").orderBy("pos").collect()] == ["x", "y"]
    assert '"id":7' in R.page_json(df, "id").first()["json"] and '"id":1' in R.page_json(df, "id").first()["json"]
    words = spark.createDataFrame([(1, 0, 'a"b', 1.0, 2.0, 3.0, 4.0, 85.0)], "id long, pos int, w string, left double, top double, right double, bottom double, conf double")
    assert R.words_json(words, "id").first()["json"] == '[{"text":"a\\"b","left":1.000000,"top":2.000000,"right":3.000000,"bottom":4.000000,"confidence":85.000000}]'
    assert math.isclose(R.parse_words(R.words_json(words, "id").withColumnRenamed("json", "text")).first()["conf01"], 0.85)


def test_corner_queries_measure_on_the_256_grid(spark, monkeypatch):
    """The registered results are those of 256 by 256 cells, as in the reference."""
    import os

    from vellum.plans import analysis_queries as Q

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    got = {(r["name"], r["model"]): r["iou"] for r in Q._results(spark, folder).where("name < 60").select("name", "model", "iou").collect()}
    monkeypatch.setattr(Q.E, "corner_results", lambda samples, **_: samples)
    fine = G.raster_iou(F.col("predicted"), F.col("truth"), F.col("w"), F.col("h"), 256)
    want = {(r["name"], r["model"]): r["iou"] for r in Q._results(spark, folder).where("name < 60").select("name", "model", fine.alias("iou")).collect()}
    assert len(got) > 20 and got == want


def test_overlap_by_rows_equals_cell_by_cell():
    import numpy as np

    rng = np.random.default_rng(8)
    p = np.concatenate([rng.uniform(-20, 240, (60, 8)), rng.integers(0, 24, (60, 8)) * 10.0])
    q = p + rng.integers(-6, 7, p.shape)
    w, h = np.full(len(p), 220.0), np.full(len(p), 240.0)
    cells = np.arange(64 * 64)
    x, y = (cells % 64 + 0.5)[None, :] / 64 * 220.0, (cells // 64 + 0.5)[None, :] / 64 * 240.0
    i, j = (np.concatenate([G._inside(c[[k]], x, y) for k in range(len(c))]) for c in (p, q))
    both, any_ = G._overlap(p, q, w, h, 64)
    assert both.tolist() == (i & j).sum(axis=1).tolist() and any_.tolist() == (i | j).sum(axis=1).tolist()


def test_eval_report_scores_texts_as_they_are(spark, monkeypatch, tmp_path):
    from vellum.plans import analysis_queries as Q

    spark.createDataFrame([(1, 1, "ÄÖ ab")], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    seen, report = [], E.report
    monkeypatch.setattr(Q.E, "report", lambda samples: seen.append(samples) or report(samples))
    assert Q.eval_report(spark, str(tmp_path)).first()["n"] == 1
    assert tuple(seen[0].select("truth", "text").first()) == ("ÄÖ ab", "ÄÖ ob")


def test_reading_modes(spark):
    kinds = "HEADER BODY FOOTER TABLE CAPTION SIDEBAR MARGIN_NOTE COLUMN FIGURE".split()
    assert [one(spark, P.reading_mode(F.lit(k))) for k in kinds] == [6, 3, 7, 6, 7, 6, 6, 4, 3]


def test_default_rectangle(spark):
    is_default = lambda w, h, *p: one(spark, P.is_default_rectangle(quad(*p), F.lit(w), F.lit(h)))
    assert is_default(300.0, 500.0, 30, 30, 270, 30, 270, 470, 30, 470)
    assert is_default(100.0, 150.0, 20, 20, 80, 20, 80, 130, 22.5, 130)
    assert not is_default(100.0, 150.0, 20, 20, 80, 20, 80, 130, 22.6, 130)
    assert not is_default(300.0, 500.0, 0, 0, 300, 0, 300, 500, 0, 500)


def test_usable_quads(spark):
    usable = lambda *p: one(spark, P.is_usable_quad(quad(*p), F.lit(100.0), F.lit(100.0)))
    assert usable(-25, 0, 125, 0, 100, 100, 0, 100)
    assert not usable(-25.1, 0, 125, 0, 100, 100, 0, 100)
    assert not usable(100, 0, 0, 0, 0, 100, 100, 100) and not usable(0, 0, 50, 0, 100, 0, 0, 100)


def test_export_turns(spark):
    turn = lambda f, m, d: one(spark, P.turns_for_export(F.lit(f), F.lit(m), F.lit(d)))
    assert [turn(False, None, 90), turn(False, "pixels", 360), turn(True, "MetaData", -90), turn(True, "pixels", 90), turn(True, None, 90)] == [True, False, True, False, False]


def test_failure_reasons(spark):
    reason = lambda *p, **k: one(spark, E.failure(quad(*p), F.lit(100.0), F.lit(100.0), **k))
    assert reason(0, 0, 99, 0, 99, 99, 0, 99) is None
    assert reason(0, 0, 99.5, 0, 99, 99, 0, 99) == "oob" and reason(0, 0, 99.5, 0, 99, 99, 0, 99, bounds=False) is None
    assert reason(0, 0, 90, 90, 90, 0, 0, 90) == "self_intersecting" and reason(0, 0, 90, 0, 20, 20, 0, 90) == "non_convex"
    assert reason(0, 0, 20, 0, 20, 20, 0, 20) == "degenerate_area" and reason(0, 0, 4, 0, 4, 99, 0, 99, min_area=0.01) == "degenerate"
    assert reason(0, 0, 4, 0, 4, 99, 0, 99, degenerate=False) is None


def test_model_comparison(spark):
    rows = [("f", "x", 0.9, 1.0, None, 0.1, 9.0), ("tie", None, 0.9, 5.0, None, 0.905, 5.4), ("iou", None, 0.92, 5.0, None, 0.9, 5.0), ("split", None, 0.95, 6.0, None, 0.9, 5.0), ("mae", None, 0.9, 4.4, None, 0.9, 5.0), ("both", "x", None, None, "y", None, None)]
    flat = [(n, "a", r, i, m) for n, r, i, m, *_ in rows] + [(n, "b", r, i, m) for n, _, _, _, r, i, m in rows]
    got = dict(map(tuple, E.compare(spark.createDataFrame(flat, "name string, model string, reason string, iou double, mae double"), "a", "b").collect()))
    assert got == {"a": 2, "b": 1, "tie": 3}


def test_best_attempt(spark):
    best = lambda *rows: V.best_attempt(spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "k int, nth int, text string, conf double, words int"), "k").first()["nth"]
    assert best((" \n", 0.9, 0), ("x", None, 0)) == 1 and best(("", 0.2, 3), ("xyz", 0.1, 0)) == 0
    assert best(("a", None, 1), ("b", 0.02, 0)) == 1 and best(("a", 0.5, 1), ("b", 0.505, 2)) == 1 and best(("a", 0.5, 1), ("b", 0.492, 9)) == 1
    assert best(("a", 0.5, 1), ("bb", 0.5, 1)) == 1 and best(("a", 0.5, 1), ("b", 0.5, 1)) == 0


def profile(spark, values):
    return spark.createDataFrame([(1, x, v) for x, v in enumerate(values)], "page int, x int, v int")


def test_content_end_and_lines(spark):
    end = lambda values, width=1000, **k: V.content_end(profile(spark, values), F.lit(width), **k).first()["x"]
    assert end([50] * 20 + [0] * 6 + [50] * 4 + [9] * 5) == 35 and end([50] * 20 + [0] * 6 + [50] * 4 + [9] * 4) == 26
    assert end([50] * 20 + [10] * 10) == 30 and end([0] * 40) == 40
    lines = lambda values: sorted(r["x"] for r in V.line_positions(profile(spark, values), F.lit(5)).collect())
    assert lines([0] * 8 + [6, 6, 6] + [5] * 9) == [0, 9, 20] and lines([9] * 4 + [0] * 10 + [9] * 2) == [2, 15] and lines([0] * 7) == [0, 7]


def plain_columns(p):
    """Columns of a profile, step by step."""
    n = len(p)
    if n < 100:
        return [(0, n)]
    half = max(5, n // 100) // 2
    p = [sum(p[max(0, i - half) : i + half + 1]) // len(p[max(0, i - half) : i + half + 1]) for i in range(n)]
    margin, inner, narrow, window = int(n * 0.05), int(n * 0.15), int(n * 0.015), int(n * 0.1)
    most = max(p[margin : n - margin])
    found = []
    if most:
        low, i = int(most * 0.35), inner
        while i < n - inner:
            if p[i] < low:
                j = i
                while j < n - inner and p[j] < low:
                    j += 1
                if j - i >= narrow:
                    found.append((i, j))
                i = j
            i += 1
        score = lambda v: 0.3 / (1 + min(p[v[0] : v[1]])) + 0.2 * (v[1] - v[0]) / n + 0.5 * (1 - abs((v[0] + v[1]) // 2 - n // 2) / n)
        found = [max(found, key=score)] if found else []
        mean = sum(p[margin : n - margin]) / (n - 2 * margin)
        if not found:
            i, size = inner + window, window // 2
            while i < n - inner - window:
                near = [p[j] for j in range(i - 5, i + 6) if inner <= j < n - inner]
                if min(near) >= p[i]:
                    left = sum(p[i - size - j] for j in range(size) if i - size - j >= inner) / size
                    right = sum(p[i + size + j] for j in range(size) if i + size + j < n - inner) / size
                    around = (left + right) / 2
                    if p[i] < around * 0.5 and p[i] < mean * 0.8:
                        a = b = i
                        while a > inner and p[a - 1] < around * 0.7:
                            a -= 1
                        while b < n - inner - 1 and p[b + 1] < around * 0.7:
                            b += 1
                        if b - a >= narrow:
                            found.append((a, b))
                            i = b + window
                i += 1
        if not found:
            at = min(range(n // 3, 2 * n // 3), key=lambda i: (p[i], i))
            left, right = [p[i] for i in range(margin, n) if i < at - n * 0.05], p[at + int(n * 0.05) : n - margin]
            if left and right:
                side = min(sum(left) / len(left), sum(right) / len(right))
                if side > 0 and p[at] < side * 0.5:
                    a = b = at
                    while a > margin and p[a - 1] < side * 0.6:
                        a -= 1
                    while b < n - margin - 1 and p[b + 1] < side * 0.6:
                        b += 1
                    if b - a >= narrow:
                        found.append((a, b))
    cuts = [0, *sorted(c for c in {(a + b) // 2 for a, b in found} if c > 0), n]
    parts = list(zip(cuts, cuts[1:], strict=False))
    return ([c for c in parts if c[1] - c[0] >= int(n * 0.15)] or [(0, n)]) if len(parts) > 1 else parts


def test_detected_columns_equal_a_plain_search(spark):
    import random

    r = random.Random(1)
    pages = []
    for k in range(120):
        n = r.choice([60, 120, 200, 300])
        deep, dents = r.choice([0, 3, 6, 12, 16]), r.choice([1, 1, 2, 3])
        values = [r.randint(14, 24) for _ in range(n)]
        for _ in range(dents):
            at, wide = r.randint(n // 6, 5 * n // 6), r.randint(4, n // 6)
            for x in range(at, min(n, at + wide)):
                values[x] = min(values[x], deep + r.randint(0, 2))
        pages.append(values)
    df = spark.createDataFrame([(k, x, v) for k, p in enumerate(pages) for x, v in enumerate(p)], "page int, x int, v int")
    got: dict = {}
    for row in Y.detect_columns(df).collect():
        got.setdefault(row["page"], []).append((row["left"], row["right"]))
    want = {k: plain_columns(p) for k, p in enumerate(pages)}
    assert {k: sorted(v) for k, v in got.items()} == want and len({len(v) for v in want.values()}) > 1


def test_quadratic_peak_of_a_flat_top(spark):
    flat = F.array(*(F.lit(1.0) for _ in range(25)))
    assert tuple(one(spark, N.quadratic_peak(flat, 5, 1.0))) == pytest.approx((1.5, 1.5))


def test_shares_of_characters(spark):
    share = lambda widths, n: [tuple(s) for s in one(spark, N.share_characters(F.array(*map(F.lit, map(float, widths))), F.lit(n)))]
    assert share([9, 1], 2) == [(0, 2), (2, 2)] and share([1, 9], 2) == [(0, 1), (1, 2)] and share([1, 1, 1], 2) == [(0, 1), (1, 2), (2, 2)] and share([5], 4) == [(0, 4)]


def test_tags_and_entities(spark):
    assert one(spark, T.strip_tags(F.lit(" <b>a&amp;#39;b</b>&nbsp;&nbsp;c &#x41;&lt;i&gt; "))) == "a'b c A<i>"


def test_lines_as_words(spark):
    df = spark.createDataFrame([(1, " a \r\r b\n\n"), (2, " \n")], "k int, text string")
    got = [tuple(round(x, 3) if isinstance(x, float) else x for x in r) for r in V.lines_as_words(df, "k", 100.0, 200.0).collect()]
    assert got == [(1, 0, "a", 8.0, 20.0, 92.0, 76.0, 0.0), (1, 1, "b", 8.0, 100.0, 92.0, 156.0, 0.0)]


def test_titles_of_registry_rows(spark):
    title = lambda f, t, i: one(spark, L.derived_title(F.lit(f).cast("string"), F.lit(t).cast("string"), F.lit(i).cast("string")))
    assert title("/d/Report.v2.pdf", None, "1") == "Report.v2" and title("/d/ PAGE .jpg", "/t/c.png", "1") == "d" and title("/img/page.jpg", "/t/c.png", "1") == "c"
    assert title("/img/page.jpg", "/t/Thumb.png", "7") == "7" and title(None, "/t/c.png", "page") == "page" and title("", None, "") == "scan"


def test_words_merge_by_the_united_area(spark):
    rows = [(1, 0, "a", 0.0, 0.0, 10.0, 10.0, 50.0), (1, 1, "b", 20.0, 0.0, 30.0, 10.0, 90.0)]
    df = spark.createDataFrame(rows, "doc_id int, pos int, w string, left double, top double, right double, bottom double, conf double")
    got = V.merge_with_next(df, F.col("pos") == 0).first()
    assert got["w"] == "a b" and got["conf"] == pytest.approx((50 * 300 + 90 * 100) / 400)


def test_edges_and_scores(spark):
    q = quad(*SQUARE)
    assert [tuple(one(spark, K.outward_normal(q, k))) for k in range(4)] == [(0, -1), (1, 0), (0, 1), (-1, 0)]
    move = lambda x, y: one(spark, K.move_edge(q, 1, K.outward_normal(q, 1), F.lit(10.0), F.lit(5.0), F.lit(x), F.lit(y)))
    out = move(13.0, 9.0)
    assert out["moved"] and (out["dx"], out["dy"]) == (3, 0) and [tuple(p) for p in out["q"]] == [(0, 0), (13, 0), (13, 10), (0, 10)]
    assert not move(-1.0, 5.0)["moved"] and not move(0.5, 5.0)["moved"] and [tuple(p) for p in move(-1.0, 5.0)["q"]] == [(0, 0), (10, 0), (10, 10), (0, 10)]
    assert one(spark, K.rectangularity(q)) == pytest.approx(120, abs=1e-3) and one(spark, K.rectangularity(quad(0, 0, 10, 0, 20, 10, 0, 10))) == -1
    assert one(spark, K.image_score(quad(-1, 0, 10, 0, 10, 10, 0, 10), F.lit(10.0), F.lit(10.0))) == float("-inf")
    better = one(spark, K.better_crop(quad(0, 0, 3, 0, 3, 3, 0, 3), quad(1, 1, 9, 1, 9, 9, 1, 9), F.lit(10.0), F.lit(10.0)))
    assert better[0]["x"] == 1
    assert one(spark, K.projective_ratio(q, F.lit(20.0), F.lit(20.0))) is None
    assert tuple(one(spark, K.fixed_ratio_size(quad(0, 0, 100, 0, 100, 40, 0, 40), F.lit(0.5)))) == (101, 51) and tuple(one(spark, K.fixed_ratio_size(q, F.lit(2.0)))) == (1, 1)
    edge = lambda x, y, r: one(spark, G.nearest_edge(q, F.lit(x), F.lit(y), r, 0.2))
    assert [edge(5.0, 3.0, 3.0), edge(5.0, 2.9, 3.0), edge(2.0, 1.0, 3.0), edge(2.1, 1.0, 3.0)] == [-1, 0, -1, 0]


def test_grid_and_synthetic_corners(spark):
    xs, ys = F.array(*(F.array(*(F.lit(float(c)) for c in range(3))) for _ in range(2))), F.array(*(F.array(*(F.lit(float(r)) for _ in range(3))) for r in range(2)))
    assert [tuple(p) for p in one(spark, K.grid_corners(xs, ys))] == [(0, 0), (2, 0), (2, 1), (0, 1)]
    df = spark.range(300).select(K.synthetic_corners(F.col("id"), F.lit(210.0), F.lit(297.0), F.lit(640.0), F.lit(480.0)).alias("q"))
    rows = [[tuple(p) for p in r["q"]] for r in df.collect()]
    assert rows == [[tuple(p) for p in r["q"]] for r in df.collect()] and len({r[0] for r in rows}) > 250
    assert all(1 <= x <= 638 and 1 <= y <= 478 for r in rows for x, y in r)
    assert df.where(G.area("q") > 100).count() == 300


def test_segments(spark):
    ink = lambda *runs: [v for n, x in runs for v in [x] * n]
    assert A.segments_of(ink((10, 0), (5, 9000)), 20) == []
    # letters two apart, a word gap of nine
    line = ink((2, 0), (4, 9000), (2, 0), (4, 9000), (9, 0), (4, 9000), (2, 0), (5, 9000), (1, 0))
    assert A.segments_of(line, 20) == [(2, 11), (21, 31)]
    assert A.segments_of(ink((6, 9000), (10, 0), (2, 9000)), 20) == [] and A.segments_of(ink((6, 9000), (10, 0), (6, 204), (4, 0), (6, 205)), 20) == [(0, 5), (26, 31)]
    df = spark.createDataFrame([(1, x, v, 20) for x, v in enumerate(line)], "line int, x int, v int, h int")
    assert [tuple(r) for r in A.ink_segments(df, "line", "h").orderBy("nth").collect()] == [(1, 0, 2, 11), (1, 1, 21, 31)]
    back = lambda scale, width, *s: [tuple(x) for x in one(spark, A.unscaled(F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in s)), F.lit(scale), F.lit(width)))]
    assert back(2.0, 10, (0, 5), (6, 30)) == [(0, 3), (4, 9)] and back(1.0, 10, (0, 50)) == [(0, 50)] and back(2.0, 4, (0, 9), (9, 9)) == [(0, 3), (4, 4)]


def test_word_boxes(spark):
    token = lambda t, c, a, b: F.struct(F.lit(t).alias("text"), F.lit(c).alias("conf"), F.lit(a).alias("first"), F.lit(b).alias("last"))
    boxes = lambda tokens, frames=10: [(w["text"], round(w["conf"], 3), *(round(x, 3) for x in w["box"])) for w in one(spark, A.word_boxes(quad(0, 0, 100, 0, 100, 20, 0, 20), F.lit("a b"), F.lit(0.5), F.array(*tokens), F.lit(frames), F.lit(80.0), F.lit(160.0)))]
    assert boxes([token("a", 0.9, 0, 1), token("b", 1.5, 3, 9)]) == [("a", 90, 0, 0, 40, 20), ("b", 100, 60, 0, 100, 20)]
    assert boxes([token("a", 0.9, 0, 1)]) == [("a", 90, 0, 0, 100, 20)] and boxes([token("a", 0.9, 0, 1), token("b", 1.0, 3, 9)], 0) == [("a b", 50, 0, 0, 100, 20)]
    assert boxes([token("", 0.9, 0, 1), token("", 1.0, 3, 9)]) == [("a b", 50, 0, 0, 100, 20)]


def test_order_accuracy(spark):
    ids = lambda t: F.array(*map(F.lit, t))
    texts = F.create_map(*(F.lit(x) for pair in (("a", "A"), ("b", "B"), ("c", ""), ("d", "B")) for x in pair))
    share = lambda x, y: one(spark, A.order_accuracy(ids(x), ids(y), texts))
    assert [share("abc", "ab"), share("ab", "ad"), share("ab", "ba"), share("ab", "a"), share("cc", "ab")] == [1, 1, 0, 0.5, 1]


def test_right_to_left_words_and_models(spark):
    assert one(spark, A.any_rtl(F.array(F.lit("a"), F.lit(None), F.lit("שלום")))) is True and one(spark, A.any_rtl(F.array(F.lit("a")))) is False
    assert [one(spark, A.model_of(F.lit(x))) for x in ("xx", "chi_sim;tha", "zh+rus+deu", " ENG ")] == [None, "th", "latin", "en"]
    lines = spark.createDataFrame([(1, 0, 9, [1, 2]), (1, 1, 3, [3, 4, 7])], "p int, nth int, top int, ids array<int>")
    words = spark.createDataFrame([(1, 1, "של", 5, 9), (1, 2, "ום", 20, 9), (1, 3, "b", 20, 3), (1, 4, "a", 5, 3)], "p int, id int, t string, left int, top int")
    got = A.words_for_reading(lines, words, "p").orderBy("place").collect()
    assert [r["id"] for r in got] == [4, 3, 2, 1]


def test_reading_order_of_odd_lines(spark):
    """Ids without a word, words on no line, ids listed twice, words of one id and nulls: as a join by page and id has them."""
    lines = spark.createDataFrame([(1, 0, 5, [2, 9, 2]), (1, 1, 5, [1, None]), (1, 2, None, [4]), (2, 0, 1, []), (2, 1, 1, None), (3, 0, 1, [1]), (None, 0, 1, [1])], "p int, nth int, top int, ids array<int>").repartition(3)
    rows = [(1, 1, "a", 5, 9), (1, 2, "b", 7, 9), (1, 2, "של", 3, 8), (1, 3, "no", 0, 0), (1, 4, None, 1, 1), (1, None, "n", 1, 1), (2, 1, "x", 1, 1), (4, 1, "y", 1, 1), (None, 1, "z", 1, 1)]
    words = spark.createDataFrame(rows, "p int, id long, t string, left int, top int").repartition(2)
    got = A.words_for_reading(lines, words, "p")
    assert [tuple(r) for r in got.orderBy("p", "place").collect()] == [(1, 0, 4, None), (1, 1, 2, "b"), (1, 2, 2, "b"), (1, 3, 2, "של"), (1, 4, 2, "של"), (1, 5, 1, "a")]


def test_words_cut_in_two(spark):
    rows = [(1, 0, "ab cd", 0.0, 7.0), (1, 1, "abc", 0.0, 2.0), (1, 2, " x", 0.0, 9.0), (1, 3, "שלום", 10.0, 20.0)]
    df = spark.createDataFrame([(d, p, w, a, 0.0, b, 5.0) for d, p, w, a, b in rows], "doc_id int, pos int, w string, left double, top double, right double, bottom double")
    got = [(r["pos"], r["part"], r["w"], r["left"], r["right"]) for r in V.split_in_middle(df, F.lit(True)).orderBy("pos", "part").collect()]
    assert got == [(0, 0, "ab", 0, 4), (0, 1, "cd", 4, 7), (1, 0, "a", 0, 1), (1, 1, "bc", 1, 2), (2, 0, " x", 0, 9), (3, 0, "של", 15, 20), (3, 1, "ום", 10, 15)]


def test_numeric_entities_go_decimal_first(spark):
    assert one(spark, T.decode_entities(F.lit("&#38;#x27;&#39; &#x41; &#4294967296; &amp;#39;"))) == "'' A &#4294967296; &#39;"


def test_reports_and_labels(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.23456789, None), ("a", 2.0, 3)], "name string, v double, n int")
    R.write_report(df, str(tmp_path / "report"))
    text = next((tmp_path / "report").glob("part-*")).read_text().strip()
    assert text == '[{"name":"a","v":2.0,"n":3},{"name":"b","v":1.234568,"n":null}]'
    R.write_lines(df, str(tmp_path / "lines"))
    assert sorted(tuple(r) for r in spark.read.schema("name string, v double, n int").json(str(tmp_path / "lines")).collect()) == sorted(tuple(r) for r in df.collect())
    (tmp_path / "one.json").write_text('{\n "image": "a.jpg",\n "corners": [[1, 2]]\n}')
    labels = R.read_json(spark, str(tmp_path / "one.json"), "image string, corners array<array<double>>")
    images = spark.createDataFrame([("a.jpg", 10, 20)], "name string, width int, height int")
    assert [tuple(r) for r in R.labels_with_sizes(labels, images).collect()] == [("a.jpg", 10, 20, [[1.0, 2.0]])]
    assert R.labels_with_sizes(labels, images.where("width > 10")).count() == 0
    (tmp_path / "bad.json").write_text("{not json")
    with pytest.raises(Exception):
        R.read_json(spark, str(tmp_path / "bad.json"), "image string").collect()


def test_catalog_and_sharpness(spark):
    assert not S.has_table(spark, "no_such_table_here")
    image = F.array(*(F.lit(float(v)) for v in (0, 0, 0, 0, 9, 0, 0, 0, 0)))
    lap = [0, 18, 0, 18, -36, 18, 0, 18, 0]
    assert one(spark, N.laplacian_variance(image, F.lit(3))) == pytest.approx(sum(x * x for x in lap) / 9 - (sum(lap) / 9) ** 2)
    assert one(spark, N.laplacian_variance(F.array(F.lit(5.0)), F.lit(1))) == 0 and one(spark, N.laplacian_variance(F.array().cast("array<double>"), F.lit(1))) == -1


def plain_boxes(prob):
    """Components by a flood over the four neighbours."""
    h, w = len(prob), len(prob[0])
    seen, out = set(), []
    for y0 in range(h):
        for x0 in range(w):
            if (y0, x0) in seen or prob[y0][x0] < 0.3:
                continue
            todo, own = [(y0, x0)], []
            seen.add((y0, x0))
            while todo:
                y, x = todo.pop()
                own.append((y, x))
                for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if 0 <= p[0] < h and 0 <= p[1] < w and p not in seen and prob[p[0]][p[1]] >= 0.3:
                        seen.add(p)
                        todo.append(p)
            ys, xs = [p[0] for p in own], [p[1] for p in own]
            bw, bh, mean = max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, sum(prob[y][x] for y, x in own) / len(own)
            if mean >= 0.5 and len(own) >= 16 and min(bw, bh) >= 3:
                d = bw * bh * 0.6 / (2 * (bw + bh))
                out.append((min(xs) - d, min(ys) - d, max(xs) + 1 + d, max(ys) + 1 + d, mean))
    return out


def test_text_boxes(spark):
    import random

    r = random.Random(3)
    maps = []
    for k in range(12):
        m = [[r.random() * 0.35 for _ in range(30)] for _ in range(20)]
        for _ in range(4):
            x, y = r.randrange(25), r.randrange(16)
            for yy in range(y, min(20, y + r.randint(2, 6))):
                for xx in range(x, min(30, x + r.randint(4, 9))):
                    m[yy][xx] = 0.6 + r.random() * 0.4
        maps.append(m)
    df = spark.createDataFrame([(k, [v for row in m for v in row], 30) for k, m in enumerate(maps)], "k int, a array<double>, w int")
    got: dict = {}
    for b in Q.text_boxes(df, "k", "a", "w").orderBy("k", "nth").collect():
        got.setdefault(b["k"], []).append(pytest.approx(tuple(b)[2:]))
    assert sum(map(len, got.values())) > 8
    for k, m in enumerate(maps):
        assert plain_boxes(m) == got.get(k, [])
    letters = [1 if (y // 6) % 2 == 0 and (x // 4) % 2 == 0 and y % 6 < 5 else 0 for y in range(48) for x in range(40)]
    df = spark.createDataFrame([(1, letters, 40), (2, [0] * 400, 20)], "k int, a array<int>, w int")
    assert dict(map(tuple, Q.median_height(df, "k", "a", "w").collect())) == {1: 5, 2: -1}


def test_page_analysis(spark):
    """Pages of 120 x 300: two columns, with a header, with a footnote as wide as the page, with one from the left, and an empty page."""
    w, h = 120, 300

    def page(header, note, columns=True):
        m = [[0] * w for _ in range(h)]
        if columns:
            for y in range(45, 250):
                for x in [*range(8, 52), *range(68, 112)]:
                    m[y][x] = int(y % 4 < 2)
        if header:
            for y in range(5, 12):
                for x in range(10, 110):
                    m[y][x] = x % 3 > 0
        for y in range(*note[:2]) if note else ():
            for x in range(note[2], note[3]):
                m[y][x] = x % 2
        return m

    pages = [page(True, None), page(False, (262, 270, 5, 115)), page(False, None), page(False, None, False), page(True, (290, 296, 4, 116))]
    df = spark.createDataFrame([(k, [int(v) for row in m for v in row], w) for k, m in enumerate(pages)], "page int, a array<int>, w int")
    found = Q.analyze(df, "page", "a", "w")
    got = {}
    for r in found.collect():
        got.setdefault(r["page"], []).append((r["type"], r["column_index"], r["left"], r["top"], r["right"], r["bottom"]))
    want = {
        0: [("COLUMN", 0, 0, 36, 60, 300), ("COLUMN", 1, 60, 36, 120, 300), ("HEADER", -1, 0, 0, 120, 36)],
        1: [("COLUMN", 0, 0, 0, 60, 262), ("COLUMN", 1, 60, 0, 120, 262), ("FOOTER", -1, 0, 262, 120, 300)],
        2: [("COLUMN", 0, 0, 0, 60, 300), ("COLUMN", 1, 60, 0, 120, 300)],
        3: [("COLUMN", 0, 0, 0, 120, 300)],
        4: [("COLUMN", 0, 0, 36, 60, 276), ("COLUMN", 1, 60, 36, 120, 276), ("FOOTER", -1, 0, 276, 120, 300), ("HEADER", -1, 0, 0, 120, 36)],
    }
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert dict((r["page"], (r["columns"], r["several"])) for r in Q.column_counts(found).collect()) == {0: (2, True), 1: (2, True), 2: (2, True), 3: (1, False), 4: (2, True)}


def test_a_path_is_chosen_with_its_quads_computed_once(spark):
    """What gives the mask's quad is in the plan twice at most, not once for each use of a corner."""
    q = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (90, 0), (90, 90), (0, 90))))
    far = F.transform(q, lambda p: F.struct((p["x"] + F.col("id")).alias("x"), p["y"].alias("y")))
    df = spark.range(3).select(G.choose_path(q, far, F.col("id") > 5).alias("path"))
    assert df._jdf.queryExecution().analyzed().toString().count("+ cast(id") <= 2 and {r[0] for r in df.collect()} == {"CORNERS"}


def test_overlap_by_rows_against_cells():
    """Rows of cells that an edge passes near are counted cell by cell, all others from edge to edge; the same as every cell."""
    import numpy as np

    r = np.random.default_rng(3)
    p = np.concatenate([r.random((20, 8)) * 40, np.round(r.random((20, 8)) * 16) * 2 + 1, np.tile([4.0, 4.0, 20.0, 4.0, 20.0, 20.0, 4.0, 20.0], (4, 1))])
    q = p + r.integers(-2, 3, p.shape)
    w = h = np.full(len(p), 32.0)
    cells = np.arange(16 * 16)
    x, y = (cells % 16 + 0.5)[None, :] * 2, (cells // 16 + 0.5)[None, :] * 2
    a, b = G._inside(p, x, y), G._inside(q, x, y)
    both, any_ = G._overlap(p, q, w, h, 16)
    assert (both == (a & b).sum(axis=1)).all() and (any_ == (a | b).sum(axis=1)).all()


def test_edit_distance_of_long_texts(spark):
    """As Spark's levenshtein, over letters beyond ASCII and the BMP, nulls and empty texts; two texts of 12,000 code points take no table of all cells."""
    import random

    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abcdéß😀") for _ in range(n))
    pairs = [(some(rng.randrange(90)), some(rng.randrange(90))) for _ in range(200)] + [(a, a[:k] + some(3) + a[k + 2 :]) for a in (some(150),) for k in range(0, 150, 9)] + [("", ""), ("", "ab"), (None, "a"), ("a", None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.where(~T.edit_distance("a", "b").eqNullSafe(F.levenshtein("a", "b"))).count() == 0
    plan = df.select(T.cer(F.col("a"), F.col("b")).alias("cer"))._jdf.queryExecution().executedPlan().toString()
    assert "levenshtein" not in plan and "edit_distance" in plan
    long = "aB" * 6000
    assert spark.createDataFrame([(long, long.lower())], "a string, b string").select(T.cer(F.col("a"), F.col("b"))).first()[0] == 0.5
