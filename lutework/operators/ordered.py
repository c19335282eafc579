"""Ordered analytics: latest rows, runs, scopes, as-of lookups and top-k, by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.folders import written


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last in the order: one aggregation, pre-aggregated before its shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, "__row.*")


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def event_ordinals(df: DataFrame, keys: list[str], order: list[str], structural: Column) -> DataFrame:
    """A dense ordinal over rows that aren't structural; null on those that are."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.when(structural, 0).otherwise(1)).over(w) - 1
    return df.withColumn("event_index", F.when(~structural, n))


def valid_prefix(df: DataFrame, keys: list[str], order: list[str], valid: Column) -> DataFrame:
    """The rows before the first invalid one of each key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__ok", F.min(valid.cast("int")).over(w)).where("__ok = 1").drop("__ok")


def runs(df: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """Maximal runs of equal values: keys, value, first and last order value and length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("__v", value)
    new = (~F.col("__v").eqNullSafe(F.lag("__v").over(w))) | F.row_number().over(w).eqNullSafe(1)
    marked = marked.withColumn("__new", new.cast("int"))
    marked = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__run").agg(
        F.first("__v").alias("value"), F.min(order[0]).alias("start"), F.max(order[0]).alias("stop"), F.count("*").alias("length")
    ).drop("__run")


def trailing_run(df: DataFrame, keys: list[str], order: list[str], blank: Column) -> DataFrame:
    """Of each key: rows, blank rows and the length of the run of blanks at its end."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    tail = df.withColumn("__blank", blank).withColumn("__tail", F.min(F.col("__blank").cast("int")).over(w))
    return tail.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count_if("__blank").alias("n_blank"), F.sum("__tail").cast("long").alias("trailing_blank")
    )


def filled_forward(value: Column, w: WindowSpec) -> Column:
    return F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def scope_open(marker: Column, opens: str, w: WindowSpec) -> Column:
    """Whether the last marker at or before the row opens a scope."""
    return F.coalesce(filled_forward(marker, w) == opens, F.lit(False))


def nearest_before(df: DataFrame, keys: list[str], order: list[str], is_anchor: Column, value: Column) -> Column:
    """The value of the nearest anchor strictly before the row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(is_anchor, value), ignorenulls=True).over(w)


def split_ranges(limit: int, slack: int):
    """A fold over a score's rows (sounding, is_bar, section) in order, by which phrases end: before a stated section other than the phrase's, at the next
    bar once more than limit sounding rows are in, or at the row with which limit + slack are. Takes an ordered array of structs (idx, sounding, is_bar, section)."""

    def fold(rows: Column) -> Column:
        empty = F.struct(
            F.array().cast("array<struct<start:int,stop:int,n:int>>").alias("out"), F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("section"), F.lit(0).alias("at")
        )

        def step(s: Column, r: Column) -> Column:
            changed = (s["at"] > s["start"]) & r["section"].isNotNull() & ~r["section"].eqNullSafe(s["section"])
            done = F.struct(s["start"].alias("start"), s["at"].alias("stop"), s["n"].alias("n"))
            out = F.when(changed, F.concat(s["out"], F.array(done))).otherwise(s["out"])
            start = F.when(changed, s["at"]).otherwise(s["start"])
            n = F.when(changed, F.lit(0)).otherwise(s["n"]) + r["sounding"].cast("int")
            full = ((n > limit) & r["is_bar"]) | (r["sounding"] & (n >= limit + slack))
            ended = F.struct(start.alias("start"), (s["at"] + 1).alias("stop"), n.alias("n"))
            return F.struct(
                F.when(full, F.concat(out, F.array(ended))).otherwise(out).alias("out"),
                F.when(full, s["at"] + 1).otherwise(start).alias("start"),
                F.when(full, F.lit(0)).otherwise(n).alias("n"),
                F.when(~full, F.coalesce(r["section"], F.when(~changed, s["section"]))).alias("section"),
                (s["at"] + 1).alias("at"),
            )

        def finish(s: Column) -> Column:
            rest = F.struct(s["start"].alias("start"), s["at"].alias("stop"), s["n"].alias("n"))
            return F.when(s["at"] > s["start"], F.concat(s["out"], F.array(rest))).otherwise(s["out"])

        return F.aggregate(rows, empty, step, finish)

    return fold


# The markers of repeats, as a pattern with the longest first, and those that name an anchor.
REPEAT_MARKERS, ANCHORS = "(从头再作|从ㄱ再作|再作三声|再作二声|再[作做](?:标记|起点)ㄱ?|再作)", "标记|起点"


def repeats(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """rows with omitted, marker and anchor (the order value of the nearest anchor at or before the marker): what a repeat leaves out. A marker of a copy
    leaves out the blank rows after it, and its own row where it isn't the plain one; a return to an anchor needs one."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = F.regexp_extract_all(F.col(text), F.lit(REPEAT_MARKERS), F.lit(1))
    marked = rows.withColumn("__m", found)
    is_anchor = F.exists("__m", lambda x: x.rlike(ANCHORS))
    marked = marked.withColumn("anchor", F.last(F.when(is_anchor, F.col(order)), ignorenulls=True).over(w))
    copies = F.filter("__m", lambda x: ~x.rlike(ANCHORS) & ((x != "从ㄱ再作") | F.col("anchor").isNotNull()))
    wide = F.filter(copies, lambda x: x != "再作")
    filled = F.trim(F.coalesce(F.col(text), F.lit(""))) != ""
    last = lambda c: F.when(F.size(c) > 0, F.get(c, F.size(c) - 1))
    state = F.struct(last(copies).alias("marker"), F.col("anchor").alias("anchor"))
    marked = marked.withColumn("__own", last(wide)).withColumn("__b", F.last(F.when(filled, state), ignorenulls=True).over(w))
    marker = F.when(filled, F.col("__own")).otherwise(F.col("__b.marker"))
    out = marked.withColumn("marker", marker).withColumn("anchor", F.when(F.col("marker").isNotNull(), F.when(filled, F.col("anchor")).otherwise(F.col("__b.anchor"))))
    return out.withColumn("omitted", F.col("marker").isNotNull()).drop("__m", "__own", "__b")


def ancestor_sums(parents: DataFrame) -> DataFrame:
    """Of a lineage (node, up), one row for each node that has a parent, numbers without cycles: node, n_ancestors and ancestor_sum, the
    number and sum of all nodes above. Self-joins, doubled: after the k-th a row stands for 2^k ancestors, or for all there are;
    up is the last one of them, null where no more is above. Written after each step; no row per node and ancestor is made."""
    one = F.lit(1).cast("long").alias("n_ancestors")
    hops = written(parents.select("node", "up", one, F.col("up").cast("long").alias("ancestor_sum")), "ancestors")
    while True:
        above = hops.select(F.col("node").alias("m"), F.col("up").alias("up2"), F.col("n_ancestors").alias("n2"), F.col("ancestor_sum").alias("sum2"))
        more = lambda name: F.coalesce(name, F.lit(0))
        hops = written(
            hops.join(above, hops["up"] == above["m"], "left").select(
                "node", F.col("up2").alias("up"), (F.col("n_ancestors") + more("n2")).alias("n_ancestors"), (F.col("ancestor_sum") + more("sum2")).alias("ancestor_sum")
            ),
            "ancestors",
        )
        if hops.where("up IS NOT NULL").isEmpty():
            return hops.drop("up")


def lineage(edges: DataFrame) -> DataFrame:
    """Of edges (node, up) of a lineage, in which a node may have several parents, every pair (node, up) of a node and one above it, until no pair is new.
    Steps are doubled: one frame holds the pairs that fewer than 2^k steps make, another those of just 2^k. A pair of many steps is so made of the greatest power
    of two in them and the rest, not of every two parts that they can be cut into. Each is written."""
    closed = written(edges.select("node", "up").distinct(), "lineage")
    joined = lambda a, b: a.join(b.select(F.col("node").alias("up"), F.col("up").alias("over")), "up").select("node", F.col("over").alias("up"))
    hops, n = closed, closed.count()  # one step
    while True:
        hops = written(joined(hops, hops).distinct(), "lineage")
        if hops.isEmpty():
            return closed
        closed = written(closed.unionByName(hops).unionByName(joined(closed, hops)).distinct(), "lineage")
        if (now := closed.count()) == n:  # a lineage that leads back to itself has steps without end
            return closed
        n = now


def in_ranges(df: DataFrame, order: list) -> DataFrame:
    """df, dealt to ranges of the order and written: adds __range, whose numbers ascend with it. What is counted by range can be carried over from one range to
    the next, a row each, so that no task orders all rows."""
    return written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, order: list, number: str = "number") -> DataFrame:
    """df with the number of each row, from 0, in the order."""
    ranged = in_ranges(df, order)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    base = ranged.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranged.join(F.broadcast(base), "__range").withColumn(number, F.col("__base") + own).drop("__range", "__base")


def undominated_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """The rows that no other one matches in a and b and beats in one of them: by a running maximum over the values of a, range by range."""
    front = df.groupBy(a).agg(F.max(b).alias("__top"))
    ranged = in_ranges(front, [F.desc(a)])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    base = ranged.groupBy("__range").agg(F.max("__top").alias("__m")).select("__range", F.max("__m").over(before).alias("__above"))
    own = F.max("__top").over(Window.partitionBy("__range").orderBy(F.desc(a)).rowsBetween(Window.unboundedPreceding, -1))
    beaten = ranged.join(F.broadcast(base), "__range").withColumn("__beaten", F.greatest("__above", own))
    kept = beaten.where("__beaten IS NULL OR __top > __beaten").select(a, "__top")
    return df.join(kept, a).where(F.col(b) == F.col("__top")).drop("__top")
