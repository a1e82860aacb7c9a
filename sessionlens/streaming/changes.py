"""Change coalescing per key: debounce (quiet or waiting too long) and leading-edge throttle.

Both are batch forms over whole tables, and no step sees more of a key than a stretch of time: a hot key's one endless burst is many small
groups. Events are first cut at quiet gaps, which are final whatever came before. Within a burst the next hand-over follows from the last one
alone: it is the first event some time after it. So every event gets its successor (from its own time cell and the rim of the next), and
the ones that are reached from the burst's first event are found by pointer doubling, in as many rounds as the logarithm of the hand-overs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sessionlens import constants as K
from sessionlens.session import stage


def bursts(events: DataFrame, gap_micros: int, cell_micros: int | None = None) -> DataFrame:
    """Distinct ``(key, at)`` instants (microseconds) with the burst they belong to.

    A burst starts where more than ``gap_micros`` passed since the key's previous event, and is named
    by its first instant. Rows only meet rows of their own time cell; cells are linked through one
    summary row each.
    """
    cell = F.floor(F.col("at") / F.lit(cell_micros or gap_micros * 4096))
    distinct = events.select("key", F.unix_micros("ts").alias("at")).distinct().withColumn("cell", cell)
    inside = W.partitionBy("key", "cell").orderBy("at")
    cut = F.when(F.col("at") - F.lag("at").over(inside) > gap_micros, F.col("at"))
    rows = distinct.withColumn("start", cut)
    cells = rows.groupBy("key", "cell").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.max("start").alias("inner"))
    along = W.partitionBy("key").orderBy("cell")
    opens = F.col("carried").isNull() | (F.col("first") - F.col("carried") > gap_micros)
    linked = (
        cells.withColumn("carried", F.lag("last").over(along))
        .withColumn("own", F.when(opens, F.col("first")))
        .withColumn("inherited", F.last(F.coalesce("inner", "own"), ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)))
        .select("key", "cell", F.coalesce("own", "inherited").alias("head"))
    )
    so_far = F.last("start", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("inner", so_far).join(linked, ["key", "cell"]).select("key", "at", F.coalesce("inner", "head").alias("burst"))


def successors(events: DataFrame, delay: int, gap: int) -> DataFrame:
    """``(key, burst, at)`` with ``next``, the burst's first event at least ``delay`` after it (null without one).

    No gap within a burst is longer than ``gap``, so the next event is at most ``delay + gap`` away, and a cell of four times that needs
    the rim of the cell behind it only."""
    reach = delay + gap
    cell = F.floor(F.col("at") / F.lit(4 * reach))
    own = events.select("key", "burst", "at", cell.alias("cell"))
    rim = own.where(F.col("at") < F.col("cell") * F.lit(4 * reach) + F.lit(reach + 1)).withColumn("cell", F.col("cell") - 1)
    seen = own.unionByName(rim).select("key", "burst", "cell", F.col("at").alias("place"), F.lit(False).alias("asks"), F.col("at").alias("event"))
    asks = own.select("key", "burst", "cell", (F.col("at") + delay).alias("place"), F.lit(True).alias("asks"), F.lit(None).cast("bigint").alias("event"))
    # From the end back, the last event that was met is the first one at or behind a place: one running value, whatever the cell holds.
    back = W.partitionBy("key", "burst", "cell").orderBy(F.col("place").desc(), "asks").rowsBetween(W.unboundedPreceding, W.currentRow)
    met = seen.unionByName(asks).withColumn("next", F.last("event", ignorenulls=True).over(back)).where("asks")
    return met.select("key", "burst", (F.col("place") - delay).alias("at"), "next")


def reached(starts: DataFrame, hops: DataFrame) -> DataFrame:
    """``(key, burst, at)`` of all events that following ``hops`` (key, burst, at, next) leads to from ``starts``, these included.

    Round k adds what is 2**k hops further, and doubles the hops; it ends when no chain is that long."""
    found = stage(starts.select("key", "burst", "at"), "reached")
    hops = stage(hops.where("next is not null").select("key", "burst", "at", "next"), "hops")
    while hops.limit(1).count():
        found = stage(found.unionByName(found.join(hops, ["key", "burst", "at"]).select("key", "burst", F.col("next").alias("at"))), "reached")
        further = hops.select("key", "burst", F.col("at").alias("next"), F.col("next").alias("further"))
        hops = stage(hops.join(further, ["key", "burst", "next"]).select("key", "burst", "at", F.col("further").alias("next")), "hops")
    return found


def debounce(events: DataFrame, settle_seconds: float = K.SETTLE_SECONDS, max_wait_seconds: float = K.MAX_WAIT_SECONDS) -> DataFrame:
    """``(key, ts)`` changes to the moments each key is handed over.

    A key is ready once it was quiet longer than ``settle`` or has been pending longer than
    ``max_wait``; a change after that starts over.
    """
    settle, longest = int(settle_seconds * 1e6), int(max_wait_seconds * 1e6)
    cut = stage(bursts(events, settle), "bursts")
    spans = cut.groupBy("key", "burst").agg(F.max("at").alias("last"), F.count("*").alias("changes"))
    short = spans.where(F.col("last") - F.col("burst") <= longest).select(
        "key", F.col("burst").alias("first"), "last", "changes")
    # Bursts that fit into one wait are done; only longer ones are handed over in between.
    heads = spans.where(F.col("last") - F.col("burst") > longest).select("key", "burst")
    long = stage(cut.join(heads, ["key", "burst"]), "long-bursts")
    firsts = reached(heads.select("key", "burst", F.col("burst").alias("at")), successors(long, longest + 1, settle))
    # A burst's first events lie more than ``longest`` apart, so a cell of that width holds one at most, and an event's own is in its cell or the
    # one before. Those of two bursts may share a cell.
    cell = lambda c: F.floor(F.col(c) / F.lit(longest + 1))
    first = lambda name: firsts.select("key", "burst", F.col("at").alias(name), cell("at").alias("cell"))
    placed = long.select("key", "burst", "at", cell("at").alias("cell")).join(first("here"), ["key", "burst", "cell"], "left")
    placed = placed.join(first("before").withColumn("cell", F.col("cell") + 1), ["key", "burst", "cell"], "left")
    own = F.when(F.col("here") <= F.col("at"), F.col("here")).otherwise(F.col("before"))
    folded = placed.groupBy("key", own.alias("first")).agg(F.max("at").alias("last"), F.count("*").alias("changes"))
    handed = F.least(F.col("last") + settle, F.col("first") + longest)
    return short.unionByName(folded).select(
        "key", F.timestamp_micros("first").alias("first_seen"), F.timestamp_micros("last").alias("last_seen"),
        "changes", F.timestamp_micros(handed).alias("ready_at"))


def throttle(events: DataFrame, interval_seconds: float) -> DataFrame:
    """``(key, ts)`` to the events that pass: none passed within the interval before."""
    interval = int(interval_seconds * 1e6)
    # A gap of a whole interval always lets the next event pass.
    cut = stage(bursts(events, interval - 1), "bursts")
    spans = cut.groupBy("key", "burst").agg(F.max("at").alias("last"))
    long = cut.join(spans.where(F.col("last") - F.col("burst") >= interval).select("key", "burst"), ["key", "burst"])
    passed = reached(spans.select("key", "burst", F.col("burst").alias("at")), successors(long, interval, interval - 1))
    return passed.select("key", F.timestamp_micros("at").alias("ts"))
