"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

The documents of a source are put in a seeded pseudo-random order and cut into blocks of
``block_rows``. Block k (from 1) of a source with weight w is released at slot
floor((k-1)/w) and due at slot ceil(k/w); each slot takes the released block with the
earliest deadline. For weights that sum to one this keeps every source, after any number
of slots, less than one block from its target share.

Weights are exact ratios, so the schedule repeats after as many slots as their whole shares
sum to, and one period is planned (for equal weights one slot of each source). Where a period
is longer than its phase, the slots of the phase are planned one by one. When a source has
no block left, a new phase begins: the weights of the others are scaled up to one. What
the plan holds is bounded by the period and by the number of blocks in each phase, whichever
is less; all work on documents is one shuffle by (source, run of the order), and the sizes of
runs are summed up in two levels, so no task holds a source.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import gcd, lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

MAX_SOURCES = 1000
BLOCK_ROWS = 16
RESOLUTION = 1000  # a weight that equals a ratio with no larger denominator is that ratio
RUN_ROWS = 500  # rows that one sort of a source's order holds, on average
RUNS = 4096  # runs whose sizes are summed up together

_PHASES = "array<struct<k:string,first:bigint,past:bigint,slot0:bigint,q:bigint,n:bigint,base:bigint,slots:array<bigint>,released:array<bigint>,due:array<bigint>>>"
ADDED = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position")


def shares_of(weights: list[float], resolution: int) -> list[int]:
    """Whole shares in the exact proportion of the weights, without a common factor.

    A weight stands for the ratio of a denominator up to ``resolution`` that equals it as a
    float, as 1/3 does, else for the decimal number it is written as.
    """
    near = [Fraction(w).limit_denominator(resolution) for w in weights]
    exact = [x if float(x) == w else Fraction(repr(float(w))) for x, w in zip(near, weights, strict=True)]
    q = lcm(*[x.denominator for x in exact])
    out = [int(x * q) for x in exact]
    g = gcd(*out)
    return [x // g for x in out]


def pfair(shares: list[int]) -> Iterator[tuple[int, int, int]]:
    """Of each slot, without end: source index, release and deadline, by earliest deadline among released blocks."""
    q = sum(shares)
    waiting = [(0, -(-q // n), s, 1) for s, n in enumerate(shares)]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            released, due, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, k, released))
        due, s, k, released = heapq.heappop(ready)
        yield s, released, due
        n = shares[s]
        heapq.heappush(waiting, (k * q // n, -(-(k + 1) * q // n), s, k + 1))
        slot += 1


def pfair_period(shares: list[int]) -> list[int]:
    """The source index of each slot of one period."""
    return [s for s, _, _ in islice(pfair(shares), sum(shares))]


def plan_phases(blocks: dict[str, int], weights: dict[str, float], resolution: int) -> list[dict]:
    """For each phase and source: its block range, first slot, period, and slots, releases and deadlines in a period."""
    left = {k: n for k, n in sorted(blocks.items()) if n > 0}
    done = dict.fromkeys(left, 0)
    slot0, out = 0, []
    while left:
        active = [k for k in left if weights.get(k, 0) > 0]
        w = [weights[k] for k in active]
        if not active:  # sources without a weight come last, evenly
            active, w = list(left), [1.0] * len(left)
        shares = shares_of(w, resolution)
        q = sum(shares)
        whole = min(left[k] // n for k, n in zip(active, shares, strict=True))
        rest = {k: left[k] - whole * n for k, n in zip(active, shares, strict=True)}
        planned: list[list[tuple[int, int, int]]] = [[] for _ in active]
        cut = t = 0
        for s, released, due in pfair(shares):
            if all(rest.values()):
                rest[active[s]] -= 1
                cut += 1
            elif not whole or t == q:
                break
            planned[s].append((t, released, due))
            t += 1
        for k, mine in zip(active, planned, strict=True):
            used = left[k] - rest[k]
            slots, released, due = zip(*mine, strict=True) if mine else ((), (), ())
            # without a whole period no block needs q
            out.append({"k": k, "first": done[k], "past": done[k] + used, "slot0": slot0, "q": q if whole else 0, "n": max(1, len(mine)), "base": done[k], "slots": slots, "released": released, "due": due})
            done[k] += used
            left[k] = rest[k]
        left = {k: n for k, n in left.items() if n}
        slot0 += whole * q + cut
    return out


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    source_col: str = "source",
    id_col: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
    resolution: int = RESOLUTION,
    seed: int = 0,
) -> DataFrame:
    """Documents with their place in the mixture: mix_block (of the source, from 1), mix_release,
    mix_deadline (slots since the phase began), mix_slot and mix_position (order of the mixture).

    ``weights`` maps sources to weights; None weighs all sources alike. Defined cases: a null
    source is a source of its own (never weighted by name); sources without a positive weight
    follow after all others; weighted sources without documents are ignored; rows are never
    dropped or repeated; the order of a source is that of a hash of the id and all columns, so
    only rows that are equal in every column stand side by side; input columns with the names
    above are replaced. More than ``MAX_SOURCES`` sources raise ValueError.
    """
    spark = docs.sparkSession
    docs = docs.drop(*ADDED)
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    counted = docs.groupBy(key.alias("k")).count().limit(MAX_SOURCES + 1).collect()
    if len(counted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them before mixing")
    rows = {r["k"]: r["count"] for r in counted}
    given = dict.fromkeys(rows, 1.0) if weights is None else {f"s{k}": float(w) for k, w in weights.items() if w and w > 0}
    phases = plan_phases({k: -(-n // block_rows) for k, n in rows.items()}, given, resolution)

    # the place of a row in its source: short runs of the order key, and the rows before each run
    runs = max(1, -(-sum(rows.values()) // RUN_ROWS))
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00"))
    known = F.concat_ws("\x1f", F.lit(str(seed)), text(id_col), *[text(c) for c in plain])
    order = F.conv(F.substring(F.md5(known), 1, 12), 16, 10).cast("long")
    keyed = docs.withColumn("__k", key).withColumn("__r", order)
    keyed = keyed.withColumn("__run", F.floor(F.col("__r") / F.lit(2.0**48) * runs).cast("long"))
    sizes = keyed.groupBy("__k", "__run").agg(F.count(F.lit(1)).alias("__n")).withColumn("__part", F.floor(F.col("__run") / RUNS))
    ahead = lambda by, at, n: F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("__k", "__part").agg(F.sum("__n").alias("__m"))
    parts = parts.select("__k", "__part", ahead(["__k"], "__part", "__m").alias("__whole"))
    sizes = sizes.withColumn("__some", ahead(["__k", "__part"], "__run", "__n")).join(parts, ["__k", "__part"])
    sizes = sizes.select("__k", "__run", (F.col("__whole") + F.col("__some")).alias("__before"))
    local = Window.partitionBy("__k", "__run").orderBy("__r")
    placed = keyed.withColumn("__at", F.row_number().over(local)).join(sizes, ["__k", "__run"])
    placed = placed.withColumn("__pos", F.col("__before") + F.col("__at") - 1)
    placed = placed.withColumn("__block", F.floor(F.col("__pos") / block_rows))

    plan = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(phases)), T._parse_datatype_string(_PHASES))))
    p = lambda c: F.col(f"__p_{c}")
    plan = F.broadcast(plan.select(*[F.col(c).alias(f"__p_{c}") for c in plan.columns]))  # one period, or fewer slots, of each phase
    j = F.col("__block") - p("base")
    of = lambda c: F.floor(j / p("n")) * p("q") + F.element_at(p(c), (j % p("n") + 1).cast("int"))
    slot = p("slot0") + of("slots")
    mixed = placed.join(plan, (F.col("__k") == p("k")) & (F.col("__block") >= p("first")) & (F.col("__block") < p("past")))
    return mixed.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        (F.col("__block") + 1).alias("mix_block"),
        of("released").alias("mix_release"),
        of("due").alias("mix_deadline"),
        slot.alias("mix_slot"),
        (slot * block_rows + F.col("__pos") % block_rows).alias("mix_position"),
    )
