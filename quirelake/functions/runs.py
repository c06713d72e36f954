"""Run-length functions: arrays of flags or values inside a row, and islands over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import col


def longest_run(flags: Column | str) -> Column:
    """Length of the longest run of true in an array of booleans."""
    state = F.aggregate(
        col(flags),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda s, f: F.struct(
            F.when(f, s["now"] + 1).otherwise(0).alias("now"),
            F.greatest(s["best"], F.when(f, s["now"] + 1).otherwise(0)).alias("best"),
        ),
    )
    return state["best"]


def true_runs(flags: Column | str) -> Column:
    """Half-open runs (start, end) of true in an array of booleans."""
    f = F.transform(col(flags), lambda x: F.coalesce(x, F.lit(False)))
    n = F.size(f)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(f, i) & ~F.coalesce(F.get(f, i - 1), F.lit(False)))
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.get(f, i - 1) & ~F.coalesce(F.get(f, i), F.lit(False)))
    return F.when(n > 0, F.arrays_zip(starts.alias("start"), ends.alias("end")))


def islands(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Maximal runs of equal value along an order: keys, run, value, first, last, n."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    marked = df.withColumn("__new", new.cast("int")).withColumn("run", F.sum("__new").over(w).cast("long"))
    return marked.groupBy(*keys, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def gap_groups(df: DataFrame, keys: list[str], order: str, gap: Column) -> DataFrame:
    """df with ``grp``: a new group (from 0) where the step from the row before exceeds ``gap``."""
    w = Window.partitionBy(*keys).orderBy(order)
    jump = (F.col(order) - F.lag(order).over(w) > gap).cast("int")
    return df.withColumn("__jump", F.coalesce(jump, F.lit(0))).withColumn("grp", F.sum("__jump").over(w).cast("long")).drop("__jump")


def prefix_cuts(df: DataFrame, keys: list[str], order: str, advance: str, parts: int) -> DataFrame:
    """df with ``part``: which k-th of the total advance a row's end falls in (0 .. parts - 1)."""
    w = Window.partitionBy(*keys)
    run = F.sum(advance).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    before = run - F.col(advance)
    total = F.sum(advance).over(w)
    return df.withColumn("part", F.least(F.floor(before * parts / total), F.lit(parts - 1)).cast("long"))


def running_mean_segments(values: Column | str, far: float) -> Column:
    """Segments (start, n, mean): a value further than ``far`` from the running mean starts a new one."""
    # only the open segment changes from step to step; closed ones are put aside
    seg = "struct<start:int,n:int,sum:double>"
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.array().cast(f"array<{seg}>").alias("done"))
    open_ = lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"), s["sum"].alias("sum"))

    def step(s: Column, x: Column) -> Column:
        near = (s["n"] > 0) & (F.abs(x - s["sum"] / s["n"]) <= far)
        pick = lambda yes, no: F.when(near, yes).otherwise(no)
        done = F.when(near | (s["n"] == 0), s["done"]).otherwise(F.concat(s["done"], F.array(open_(s))))
        return F.struct((s["i"] + 1).alias("i"), pick(s["start"], s["i"]).alias("start"), pick(s["n"] + 1, F.lit(1)).alias("n"), pick(s["sum"] + x, x).alias("sum"), done.alias("done"))

    out = F.aggregate(F.transform(col(values), lambda x: x.cast("double")), zero, step, lambda s: F.when(s["n"] > 0, F.concat(s["done"], F.array(open_(s)))).otherwise(s["done"]))
    return F.transform(out, lambda e: F.struct(e["start"], e["n"], (e["sum"] / e["n"]).alias("mean")))


def first_gap_stop(lefts: Column | str, rights: Column | str, gap: Column) -> Column:
    """How many boxes come before the first gap wider than ``gap``."""
    a, b = col(lefts), col(rights)
    breaks = F.filter(F.sequence(F.lit(1), F.greatest(F.size(a) - 1, F.lit(1))), lambda i: F.get(a, i) - F.get(b, i - 1) > gap)
    return F.coalesce(F.array_min(breaks), F.size(a))


def colour_runs(colours: Column | str, join: float = 45, split: float = 60) -> Column:
    """Runs (n, rgb) of an array of nullable colours, or null where the line is of one colour.

    A colour joins a run when either is null or no channel is further than ``join`` from the run's
    first colour. A run of one between two like neighbours is absorbed. Null unless there are two
    runs and two colours are ``split`` apart; runs without a colour take the first one.
    """
    kind = "array<struct<n:int,rgb:struct<r:int,g:int,b:int>>>"
    far = lambda x, y: F.greatest(*[F.abs(x[c] - y[c]) for c in "rgb"])
    seg = lambda n, rgb: F.struct(n.cast("int").alias("n"), rgb.alias("rgb"))

    none = F.lit(None).cast("struct<r:int,g:int,b:int>")

    def add(s: Column, x: Column) -> Column:
        joins = (s["n"] > 0) & (x.isNull() | s["rgb"].isNull() | (far(x, s["rgb"]) <= join))
        done = F.when(joins | (s["n"] == 0), s["done"]).otherwise(F.concat(s["done"], F.array(seg(s["n"], s["rgb"]))))
        return F.struct(F.when(joins, s["n"] + 1).otherwise(1).alias("n"), F.when(joins, F.coalesce(s["rgb"], x)).otherwise(x).alias("rgb"), done.alias("done"))

    def absorb(s: Column, x: Column) -> Column:
        # the last two of s and x: if the middle one is single and both sides alike, they are one
        mid, prev = F.try_element_at(s, F.lit(-1)), F.try_element_at(s, F.lit(-2))
        like = prev.isNotNull() & (mid["n"] == 1) & prev["rgb"].isNotNull() & x["rgb"].isNotNull() & (far(prev["rgb"], x["rgb"]) <= join)
        one = F.concat(F.slice(s, F.lit(1), F.size(s) - 2), F.array(seg(prev["n"] + 1 + x["n"], prev["rgb"])))
        return F.when(like, one).otherwise(F.concat(s, F.array(seg(x["n"], x["rgb"]))))

    empty = F.array().cast(kind)
    first = F.struct(F.lit(0).alias("n"), none.alias("rgb"), empty.alias("done"))
    opened = F.aggregate(col(colours), first, add, lambda s: F.when(s["n"] > 0, F.concat(s["done"], F.array(seg(s["n"], s["rgb"])))).otherwise(s["done"]))
    runs = F.aggregate(opened, empty, absorb)
    real = F.filter(runs, lambda r: r["rgb"].isNotNull())
    spread = F.array_max(F.flatten(F.transform(real, lambda a: F.transform(real, lambda b: far(a["rgb"], b["rgb"])))))
    filled = F.transform(runs, lambda r: seg(r["n"], F.coalesce(r["rgb"], real[0]["rgb"])))
    return F.when((F.size(runs) >= 2) & (F.size(real) > 0) & (spread >= split), filled)
