"""Tolerant as-of join: to each event of a client the client's latest order at or before it, within a tolerance.

An equi-join on the client and on a cell of time, with a time-range predicate; max_by on a struct that settles ties; a left
join back to all events.

- Orders of one client and one time are summed up before the shuffle: the best by the tie struct, and how many there are.
- Cells are at least as wide as the tolerance, so an event meets the orders of its own cell and the last one of the cell
  before. Within a cell each order knows its successor and serves only the events before that, so a join gives an event
  three rows at most, however many orders a client has.
- The coarse cells of a client with many orders are cut into finer ones, about as many as a fine cell has orders; only the
  last order of a fine cell stands in the coarse one. Its events look into both.
- Where many events of a hot client fall into one cell, they are dealt over salts, and the cell's few orders are replicated
  to each of them.

The lists of hot clients and hot cells hold only what has more than a 16,384th of the rows, so their size has a bound
whatever the input, and only they are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import stored

#: A client or cell is hot if it has more than this share of the rows ...
SHARE = 16_384
#: ... and more rows than this.
LEAST = 4_096


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970; a timestamp without a zone is taken as UTC, whatever the session's zone."""
    c = F.col(name)
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(c)
    second = (F.expr(f"extract(SECOND FROM `{name}`)") * 1_000_000).cast("long")
    return F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + second


def _cell(at: str | Column, width: Column) -> Column:
    at = F.col(at) if isinstance(at, str) else at
    rest = F.pmod(at, width)
    return F.floor((at - rest) / width)


def _hot_clients(events: DataFrame, orders: DataFrame, share: int, least: int) -> DataFrame:
    """client, parts: clients with many events or orders and into how many fine cells a coarse one of theirs is cut."""
    both = events.select("client", F.lit(1).alias("e"), F.lit(0).alias("o")).unionByName(orders.select("client", F.lit(0).alias("e"), F.lit(1).alias("o")))
    n = both.agg(F.sum("e").alias("e"), F.sum("o").alias("o")).first()
    bound = [max(least, (x or 0) // share) for x in n]
    counts = both.groupBy("client").agg(F.sum("e").alias("e"), F.sum("o").alias("o")).where((F.col("e") > bound[0]) | (F.col("o") > bound[1]))
    power = F.least(F.lit(16), F.greatest(F.lit(0), F.floor(F.log2(F.sqrt(F.greatest("o", F.lit(1))) / 8))))
    return stored(counts.select("client", F.pow(F.lit(2), power).cast("long").alias("parts")), "asof-clients")


def as_of(
    events: DataFrame,
    orders: DataFrame,
    tolerance_us: int,
    *,
    event: str = "click_id",
    client: str = "client_id",
    at: str = "ts_us",
    order: str = "sale_id",
    order_at: str = "sold_us",
    rank: str = "priority",
    keep: Sequence[str] = (),
    share: int = SHARE,
    least: int = LEAST,
) -> DataFrame:
    """event, client, at, the matched order's id, lag_us, keep columns and n_tied, one row per event id.

    Times are long microseconds. Of orders at the same time the one with the larger rank wins, then the one with the smaller
    id, then that with the larger keep columns; nulls lose. n_tied counts all the client's orders at the matched time, 0
    without a match. Copies of an event id count once (of copies that differ, the one with the smallest time, then client;
    null times last); rows with a null event id are copies of each other and match nothing. A null client or time never
    matches. Order rows are never merged: repeated rows are as many orders. Order ids and ranks are integers; keep columns are orderable. Other
    columns of either table are ignored, whatever their names; an empty table of orders leaves all events unmatched.
    """
    own = events.select(F.col(event).alias("event"), F.col(client).alias("client"), F.col(at).cast("long").alias("at"))
    first = F.struct(F.col("at").isNull(), "at", F.col("client").isNull(), "client")
    own = own.groupBy("event").agg(F.min(first).alias("first")).select("event", "first.client", "first.at")
    tie = F.struct(F.col(rank).alias("rank"), F.bitwise_not(F.col(order)).alias("not_id"), *(F.col(c).alias(f"keep{k}") for k, c in enumerate(keep)))
    sold = orders.select(F.col(client).alias("client"), F.col(order_at).cast("long").alias("time"), tie.alias("tie")).where("client IS NOT NULL AND time IS NOT NULL")
    timed = events.select(F.col(client).alias("client"), F.col(at).cast("long").alias("at")).where("client IS NOT NULL AND at IS NOT NULL")

    wide = -(-max(1, tolerance_us) // (1 << 16)) << 16  # so that any number of parts cuts it evenly
    width = F.lit(wide).cast("long")
    hot = _hot_clients(timed, sold, share, least)
    some = bool(hot.head(1))

    def parted(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(hot), "client", "left") if some else df.withColumn("parts", F.lit(None).cast("long"))

    def looks(df: DataFrame) -> DataFrame:
        """The cells that an event looks into: its coarse one, and its fine one where there are such."""
        coarse = F.struct(F.lit(0).alias("level"), _cell("at", width).alias("cell"))
        fine = F.struct(F.lit(1).alias("level"), _cell("at", F.expr(f"{wide}L div parts")).alias("cell"))
        cells = F.when(F.col("parts") > 1, F.array(coarse, fine)).otherwise(F.array(coarse))
        return df.select("*", F.inline(cells))

    # each order serves the events up to the next one in its cell
    moments = parted(sold.groupBy("client", "time").agg(F.max("tie").alias("tie"), F.count("*").alias("n_tied")))
    fine_width = F.expr(f"{wide}L div coalesce(parts, 1L)")
    moments = moments.withColumn("cell", _cell("time", fine_width)).withColumn("next", F.lead("time").over(Window.partitionBy("client", "cell").orderBy("time")))
    coarse = _cell("time", width)
    here = F.struct(F.lit(0).alias("level"), coarse.alias("cell"))
    after = F.struct(F.lit(0).alias("level"), (coarse + 1).alias("cell"))
    here_after = F.when(F.col("next").isNull(), F.array(here, after)).otherwise(F.array(here))
    columns = ["client", "time", "tie", "n_tied", "next"]
    if not some:
        serving = moments.select(*columns, F.inline(here_after))
        asking = looks(parted(own.where("client IS NOT NULL AND at IS NOT NULL")))
        salt_of_event = serving_salt = None
    else:
        finest = F.when(F.col("parts") > 1, F.array(F.struct(F.lit(1).alias("level"), F.col("cell").alias("cell")))).otherwise(here_after)
        serving = moments.select(*columns, F.inline(finest))
        lasts = moments.where("parts > 1 AND next IS NULL").withColumn("next", F.lead("time").over(Window.partitionBy("client", coarse).orderBy("time")))
        serving = serving.unionByName(lasts.select(*columns, F.inline(here_after)))
        asking = looks(parted(own.where("client IS NOT NULL AND at IS NOT NULL")))
        # the events of all other clients are one group, which is left out afterwards
        of_hot = [F.when(F.col("parts").isNotNull(), F.col(k)).alias(k) for k in ("client", "level", "cell")]
        counted = looks(parted(timed)).select(*of_hot).groupBy("client", "level", "cell").agg(F.count("*").alias("n"))
        bound = max(least, timed.count() // share)
        crowded = counted.where(F.col("n") > bound).select("client", "level", "cell", F.ceil(F.col("n") / bound).cast("int").alias("salts"))
        crowded = stored(crowded, "asof-cells").where("client IS NOT NULL")
        asking = asking.join(F.broadcast(crowded), ["client", "level", "cell"], "left")
        serving = serving.join(F.broadcast(crowded), ["client", "level", "cell"], "left")
        salt_of_event = F.pmod(F.xxhash64("event"), F.coalesce("salts", F.lit(1))).cast("int")
        serving_salt = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    keys = ["client", "level", "cell"]
    if some:
        asking, serving, keys = asking.withColumn("salt", salt_of_event), serving.withColumn("salt", serving_salt), [*keys, "salt"]
    asking = asking.select("event", "at", *keys)
    serving = serving.select(*columns, *(k for k in keys if k != "client"))

    within = (F.col("time") <= F.col("at")) & (F.col("at") - F.col("time") <= tolerance_us) & (F.col("next").isNull() | (F.col("at") < F.col("next")))
    found = asking.alias("a").join(serving.alias("s"), [*(F.col(f"a.{k}") == F.col(f"s.{k}") for k in keys), within])
    best = found.groupBy("event").agg(F.max_by(F.struct("time", "tie", "n_tied"), F.struct("time", "tie")).alias("best"))
    joined = own.alias("o").join(best.alias("b"), F.col("o.event") == F.col("b.event"), "left")
    return joined.select(
        F.col("o.event").alias(event),
        F.col("o.client").alias(client),
        F.col("o.at").alias(at),
        F.bitwise_not("best.tie.not_id").alias(order),
        (F.col("o.at") - F.col("best.time")).alias("lag_us"),
        *(F.col(f"best.tie.keep{k}").alias(c) for k, c in enumerate(keep)),
        F.coalesce("best.n_tied", F.lit(0)).cast("long").alias("n_tied"),
    )


DAY_US = 86_400_000_000


def _odd(name: str) -> Column:
    return F.crc32(F.col(name).cast("string")) % 2 == 1


def shop_clicks(clicks: DataFrame) -> DataFrame:
    """click_id, client_id, ts_us of the clicks; where the id's crc32 is odd, the time is floored to its day."""
    us = micros(clicks, "ts")
    return clicks.select("click_id", "client_id", F.when(_odd("click_id"), us - F.pmod(us, F.lit(DAY_US))).otherwise(us).alias("ts_us"))


def shop_orders(sales: DataFrame) -> DataFrame:
    """sale_id, client_id, sold_us, priority, total_cents: each sale, and its second order where crc32 % 3 is not 0."""
    us = micros(sales, "sold_at")
    h = F.crc32(F.col("sale_id").cast("string"))
    sale = F.struct(F.col("sale_id").cast("long").alias("sale_id"), F.col("priority").cast("long").alias("priority"))
    twin = F.struct((-1 - F.col("sale_id").cast("long")).alias("sale_id"), (6 - F.col("priority").cast("long")).alias("priority"))
    return sales.select(
        "client_id",
        F.when(_odd("sale_id"), us - F.pmod(us, F.lit(DAY_US))).otherwise(us).alias("sold_us"),
        F.floor(100 * F.col("total") + 0.5).cast("long").alias("total_cents"),
        F.inline(F.when(h % 3 != 0, F.array(sale, twin)).otherwise(F.array(sale))),
    )


def matches(clicks: DataFrame, sales: DataFrame) -> DataFrame:
    """One row per click_id with the latest order at most 72 hours before it."""
    out = as_of(shop_clicks(clicks), shop_orders(sales), 72 * 3_600_000_000, keep=["total_cents"])
    return out.select("click_id", "client_id", "ts_us", "sale_id", "lag_us", "total_cents", "n_tied")
