"""Review edits: joining and splitting words, the best of several attempts, regions beside others, profile runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.layout import runs


def merge_with_next(words: DataFrame, which: Column, key: str = "doc_id") -> DataFrame:
    """The words with each one that `which` names joined with its successor: texts by a space, boxes united, confidence by area.

    The first word's confidence weighs with the area of the united box, the second's with that of its own. A named word whose
    predecessor is named is itself taken up by that one and joins nothing.
    """
    order = Window.partitionBy(key).orderBy("pos")
    marked = words.withColumn("named", F.coalesce(which, F.lit(False))).withColumn("more", F.lead(F.struct("w", "left", "top", "right", "bottom", "conf")).over(order))
    marked = marked.withColumn("merged", F.col("named") & F.col("more").isNotNull() & ~F.coalesce(F.lag("named").over(order), F.lit(False)))
    marked = marked.withColumn("gone", F.coalesce(F.lag("merged").over(order), F.lit(False)))
    united = {"left": F.least("left", "more.left"), "top": F.least("top", "more.top"), "right": F.greatest("right", "more.right"), "bottom": F.greatest("bottom", "more.bottom")}
    a = F.greatest(F.lit(0.0), united["right"] - united["left"]) * F.greatest(F.lit(0.0), united["bottom"] - united["top"])
    b = F.greatest(F.lit(0.0), F.col("more.right") - F.col("more.left")) * F.greatest(F.lit(0.0), F.col("more.bottom") - F.col("more.top"))
    pick = lambda merged, own: F.when(F.col("merged"), merged).otherwise(F.col(own)).alias(own)
    return marked.where("NOT gone").select(
        key,
        "pos",
        pick(T.jtrim(F.concat_ws(" ", T.jtrim(F.col("w")), T.jtrim(F.col("more.w")))), "w"),
        *(pick(v, k) for k, v in united.items()),
        pick((F.col("conf") * a + F.col("more.conf") * b) / F.greatest(F.lit(1.0), a + b), "conf"),
        F.col("merged").alias("edited"),
    )


def split_in_middle(words: DataFrame, which: Column, key: str = "doc_id") -> DataFrame:
    """The words with each one that `which` names cut in two: at the last space up to the middle, else the next one, else in the middle.

    The width is shared by length, in whole pixels of at least one; of right-to-left words the first part lies on the right.
    A word that would leave an empty part stays whole. part is 0 or 1.
    """
    w = F.col("w")
    n = F.length(w)
    middle = F.floor(n / 2).cast("int")
    before = F.length(F.regexp_extract(F.substr(w, F.lit(1), middle + 1), r"(?s)^(.*) ", 1))
    after = F.position(F.lit(" "), F.substr(w, middle + 1))
    at = F.when(before > 0, before).when(after > 0, middle + after - 1).otherwise(middle).cast("int")
    marked = words.withColumn("at", at).withColumn("first", T.jtrim(F.substr(w, F.lit(1), F.col("at")))).withColumn("rest", T.jtrim(F.substr(w, F.col("at") + 1)))
    cut = marked.withColumn("cut", F.coalesce(which, F.lit(False)) & (n >= 2) & (F.col("first") != "") & (F.col("rest") != "")).withColumn("rtl", T.is_rtl(w))
    parts = cut.withColumn("part", F.explode(F.when(F.col("cut"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    width = F.col("right") - F.col("left")
    own = F.greatest(F.lit(1), F.floor(width * F.length("first") / F.greatest(F.lit(1), F.length("first") + F.length("rest")) + 0.5))
    other = F.greatest(F.lit(1), width - own)
    left = F.when(F.col("part") == 0, F.when(F.col("rtl"), F.col("left") + other).otherwise(F.col("left"))).otherwise(F.when(F.col("rtl"), F.col("left")).otherwise(F.col("left") + own))
    return parts.select(
        key,
        "pos",
        "part",
        F.when(~F.col("cut"), w).when(F.col("part") == 0, F.col("first")).otherwise(F.col("rest")).alias("w"),
        F.when(F.col("cut"), left).otherwise(F.col("left")).alias("left"),
        "top",
        F.when(F.col("cut"), left + F.when(F.col("part") == 0, own).otherwise(other)).otherwise(F.col("right")).alias("right"),
        "bottom",
    )


def best_attempt(attempts: DataFrame, key: str, band: float = 0.01) -> DataFrame:
    """Of each key's attempts (nth, text, conf, words) the one left by comparing in turn: content, confidence beyond the band, words, length.

    Content is a word or text beyond white space; a missing confidence is 0.
    """
    text = F.coalesce("text", F.lit(""))
    content = (F.coalesce("words", F.lit(0)) > 0) | (T.jtrim(text) != "")
    one = F.struct("nth", "text", "conf", "words", F.length(text).alias("length"), content.alias("content"), F.coalesce("conf", F.lit(0.0)).alias("c"), F.coalesce("words", F.lit(0)).alias("n"))
    ordered = attempts.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("a"))

    def better(b: Column, x: Column) -> Column:
        return (
            F.when(x["content"] != b["content"], x["content"])
            .when(x["c"] > b["c"] + band, True)
            .when(F.abs(x["c"] - b["c"]) > band, False)
            .when(x["n"] != b["n"], x["n"] > b["n"])
            .otherwise(x["length"] > b["length"])
        )

    best = F.aggregate(F.slice("a", F.lit(2), F.size("a")), F.get("a", F.lit(0)), lambda b, x: F.when(better(b, x), x).otherwise(b))
    return ordered.select(key, best.alias("b")).select(key, "b.nth", "b.text", "b.conf", "b.words")


def beside(regions: DataFrame, blockers: DataFrame, key: str = "page") -> DataFrame:
    """Regions that meet none of the page's blockers; the boxes are compared within a page only."""
    r, b = regions.alias("r"), blockers.select(key, "left", "top", "right", "bottom").alias("b")
    meet = (F.col("r.left") < F.col("b.right")) & (F.col("b.left") < F.col("r.right")) & (F.col("r.top") < F.col("b.bottom")) & (F.col("b.top") < F.col("r.bottom"))
    return r.join(b, (F.col(f"r.{key}") == F.col(f"b.{key}")) & meet, "left_anti")


def line_positions(profile: DataFrame, above: Column, key: str = "page", edge: int = 5) -> DataFrame:
    """key and x: middles of the runs above `above`, and an end of the page that is more than `edge` away from the outermost one."""
    found = runs(profile, F.col("v") > above, key).select(key, F.floor((F.col("start") + F.col("end")) / 2).cast("int").alias("x"))
    size = profile.groupBy(key).agg((F.max("x") + 1).cast("int").alias("n")).join(found.groupBy(key).agg(F.min("x").alias("lo"), F.max("x").alias("hi")), key, "left")
    first = size.where(F.coalesce(F.col("lo") > edge, F.lit(True))).select(key, F.lit(0).alias("x"))
    last = size.where(F.coalesce(F.col("hi") < F.col("n") - edge, F.lit(True))).select(key, F.col("n").alias("x"))
    return found.unionByName(first).unionByName(last)


def content_end(profile: DataFrame, width: Column, key: str = "page", empty: float = 0.01, share: float = 0.02, least: int = 5) -> DataFrame:
    """key and x: from below, the lower edge of the first stretch of enough places that hold less than `empty` of the width; else the end.

    profile: rows (key, x, v) from above; width: an expression of its columns.
    """
    size = profile.groupBy(key).agg(F.count("*").alias("n"))
    need = F.greatest(F.lit(least), F.floor(F.col("n") * share))
    gaps = runs(profile, F.col("v") < F.floor(width * empty), key).withColumnRenamed("n", "gap").join(size, key).where(F.col("gap") >= need)
    last = gaps.groupBy(key).agg(F.max("end").alias("end"))
    return size.join(last, key, "left").select(key, F.coalesce("end", "n").cast("int").alias("x"))


def centre_valley(profile: DataFrame, key: str = "page", ratio: float = 0.5, gap: float = 0.6, away: float = 0.05, narrowest: float = 0.015, margin: float = 0.05) -> DataFrame:
    """key, start, end (both within): around the first lowest place of the middle third, if it lies well below the means of both sides.

    The means and the stretch leave out the margins.
    """
    page = Window.partitionBy(key)
    p = profile.withColumn("n", F.count("*").over(page)).withColumn("m", F.floor(F.col("n") * margin))
    third = (F.col("x") >= F.floor(F.col("n") / 3)) & (F.col("x") < F.floor(2 * F.col("n") / 3))
    p = p.withColumn("low", F.min(F.when(third, F.struct("v", "x"))).over(page))
    inner = (F.col("x") >= F.col("m")) & (F.col("x") < F.col("n") - F.col("m"))
    left, right = inner & (F.col("x") < F.col("low.x") - F.col("n") * away), inner & (F.col("x") >= F.col("low.x") + F.floor(F.col("n") * away))
    mean = lambda c: F.avg(F.when(c, F.col("v"))).over(page)
    p = p.withColumn("side", F.when(mean(left).isNotNull() & mean(right).isNotNull(), F.least(mean(left), mean(right))))
    # the stretch holds its lowest place whatever that place's value
    below = (F.col("v") < F.col("side") * gap) & inner
    found = runs(p.where((F.col("side") > 0) & (F.col("low.v") < F.col("side") * ratio)), below | (F.col("x") == F.col("low.x")), key)
    at = p.groupBy(key).agg(F.first("low.x").alias("x"), F.first("n").alias("width"))
    found = found.withColumn("end", F.col("end") - 1).join(at, key).where((F.col("start") <= F.col("x")) & (F.col("x") <= F.col("end")))
    return found.where(F.col("end") - F.col("start") >= F.floor(F.col("width") * narrowest)).select(key, "start", "end")


#: Margins at the sides and above, usable height, height of a line and of its box at least, the box's share of the line.
SIDE, ABOVE, USABLE, LEAST_LINE, LEAST_BOX, BOX = 0.08, 0.10, 0.80, 24.0, 16.0, 0.70


def lines_as_words(texts: DataFrame, key: str, width: float, height: float) -> DataFrame:
    """One word per line that isn't blank, in a box of its own with confidence 0: for pages whose words are unknown."""
    lines = F.filter(F.transform(F.split("text", r"[\r\n]+"), T.jtrim), lambda x: x != "")
    rows = texts.withColumn("n", F.size(lines)).select(key, "n", F.posexplode(lines).alias("pos", "w"))
    line = F.greatest(F.lit(LEAST_LINE), F.lit(height * USABLE) / F.greatest(F.col("n"), F.lit(1)))
    top = F.least(F.lit(height - 1.0), F.lit(height * ABOVE) + F.col("pos") * line)
    bottom = F.least(F.lit(height), top + F.greatest(F.lit(LEAST_BOX), line * BOX))
    return rows.select(key, "pos", "w", F.lit(width * SIDE).alias("left"), top.alias("top"), F.lit(width - width * SIDE).alias("right"), bottom.alias("bottom"), F.lit(0.0).alias("conf"))
