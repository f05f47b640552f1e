"""Sessions of activity divided by inactivity, by pointer doubling (problem 4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crowdsignal.session import staged

#: Time is cut into slices of a day, or of the gap if that is longer.
SLICE_S = 86_400


def resolve_roots(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """Pointer doubling: of (key, node, parent, ...), each node having one parent at most, the (key, node, root, ...) of each node.

    Every round replaces each pointer by that of the node it points to, and so halves the way to the root; a chain of n links
    takes about log2(n) rounds. A pointer has arrived when it points to a node without a parent. Pointers that have arrived leave
    the rounds: they are looked up but neither moved nor written again. What a round moves is written to the shared folder.
    Joins are on (key, node), so no key is gathered in one task. Other columns of ``links`` are carried along. A cycle is an error.
    """
    carried = [c for c in links.columns if c not in ("key", "node", "parent")]
    going = staged(links.select("key", "node", F.col("parent").alias("root"), *carried), "pointers")
    arrived: list[DataFrame] = []
    for _ in range(most_rounds):
        known = reduce(DataFrame.unionByName, [x.select("key", F.col("node").alias("root"), F.col("root").alias("further"), F.lit(x is not going).alias("final")) for x in (*arrived, going)])
        moved = staged(
            going.join(known, ["key", "root"], "left").select("key", "node", F.coalesce("further", "root").alias("root"), *carried, (F.col("further").isNull() | F.col("final")).alias("there")), "pointers"
        )
        arrived.append(moved.where("there").drop("there"))
        going = moved.where("NOT there").drop("there")
        if going.isEmpty():
            return reduce(DataFrame.unionByName, arrived)
    raise ValueError("the links hold a cycle")


def event_links(moments: DataFrame, gap: int) -> DataFrame:
    """(key, t, n, parent) of (key, t, n): every moment with the one before it, if that is within ``gap`` seconds; else null.

    Time is cut into slices no shorter than the gap, so that the moment before lies in the same slice or is the last of the slice
    before. In a slice, which has at most as many distinct seconds as it is long whatever the key's share of all rows, it is found by a
    window; only the first moments of slices that lie within the gap of its start are joined to the last ones.
    """
    slice_s = max(int(gap), SLICE_S)
    ordered = W.partitionBy("key", "slice").orderBy("t")
    cut = moments.withColumn("slice", F.floor(F.col("t") / slice_s))
    laid = staged(cut.select("*", F.lag("t").over(ordered).alias("before"), F.lead("t").over(ordered).isNull().alias("last")), "moments")
    start = F.col("slice") * slice_s
    early = laid.where(F.col("before").isNull() & (F.col("t") - start < gap))
    late = laid.where(F.col("last") & (start + slice_s - F.col("t") <= gap)).select("key", (F.col("slice") + 1).alias("slice"), F.col("t").alias("parent"))
    across = early.join(late, ["key", "slice"], "left").select("key", "t", "n", F.when(F.col("t") - F.col("parent") <= gap, F.col("parent")).alias("parent"))
    within = laid.where(F.col("before").isNotNull() | (F.col("t") - start >= gap)).select("key", "t", "n", F.when(F.col("t") - F.col("before") <= gap, F.col("before")).alias("parent"))
    return within.unionByName(across)


def activity_sessions(events: DataFrame, key: str, seconds: str, gap: int = 1800) -> DataFrame:
    """Sessions of ``events`` (one row per event; ``seconds`` a whole number of seconds): (key, start, end, n_events).

    A gap of more than ``gap`` seconds begins a new session. Rows with a null key or time are left out; events at the
    same time belong together; an empty table gives an empty one.

    Events of one key and second are counted first. Each of these moments is linked to the one before it within the gap, pointer
    doubling finds the first moment of every chain, and sessions are aggregated by it; partial sums keep a long session out of one task.
    """
    moments = (
        events.select(events[key].alias("key"), events[seconds].cast("long").alias("t"))
        .where("key IS NOT NULL AND t IS NOT NULL")
        .groupBy("key", "t").agg(F.count(F.lit(1)).alias("n"))
    )
    linked = event_links(moments, gap)
    first = linked.where("parent IS NULL").select("key", F.col("t").alias("node"), F.col("t").alias("root"), "n")
    rest = resolve_roots(linked.where("parent IS NOT NULL").select("key", F.col("t").alias("node"), "parent", "n"))
    return (
        first.unionByName(rest.select("key", "node", "root", "n"))
        .groupBy("key", F.col("root").alias("start")).agg(F.max("node").alias("end"), F.sum("n").alias("n_events"))
    )
