"""Connected lines of a page, and what a group of them agrees on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import text as T
from . import pages as P


def _least_labels(key: tuple[pa.Scalar, ...], edges: pa.Table) -> pa.Table:
    """Union by least node, over the edges of one page."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(edges.column("i").to_pylist(), edges.column("j").to_pylist(), strict=True):
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    nodes = np.array(sorted(parent), np.int64)
    return pa.table([pa.array([key[0].as_py()] * len(nodes), pa.int64()), pa.array(nodes), pa.array([root(int(x)) for x in nodes], pa.int64())], ["page", "pos", "cc"])


def components(edges: DataFrame) -> DataFrame:
    """Components of edges(page, i, j): (page, pos, cc), cc the least pos. A page is small, so its
    edges are joined in one pass instead of rounds of joins over all pages."""
    return edges.groupBy("page").applyInArrow(_least_labels, "page bigint, pos bigint, cc bigint")


def grouped(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """lines with cc; a line without edges is a group of its own."""
    cc = components(edges)
    return lines.join(cc, ["page", "pos"], "left").withColumn("cc", F.coalesce("cc", "pos"))


def unify_sizes(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """One size for each group of wrapped lines: page, pos, cc, font_pt, bold.

    A strict regular majority strips marginal bolds. Groups whose sizes are adjacent ladder steps
    take the most frequent size, or the snapped median estimate where several lead; a width
    ceiling (max_fit_pt, clamp_pt, where the lines have them) lowers it.
    """
    for c in ("max_fit_pt", "clamp_pt"):
        if c not in lines.columns:
            lines = lines.withColumn(c, F.lit(None).cast("double"))
    # one exchange by page serves the join and every window
    held = grouped(lines, edges)
    w = Window.partitionBy("page", "cc")
    n, bold = F.count(F.lit(1)).over(w), F.sum(F.col("bold").cast("int")).over(w)
    stripped = (bold > 0) & (bold * 2 < n) & P.marginal_bold()
    c = F.count(F.lit(1)).over(Window.partitionBy("page", "cc", "font_pt"))
    held = held.withColumn("bold", F.when(stripped, False).otherwise(F.col("bold"))).withColumn("__c", c).withColumn("__step", G.ladder_step("font_pt"))
    held = held.withColumn("__lead", F.when(F.col("__c") == F.max("__c").over(w), F.col("font_pt")))
    kinds, leaders = F.size(F.collect_set("font_pt").over(w)), F.size(F.collect_set("__lead").over(w))
    lo, hi = F.min("__step").over(w), F.max("__step").over(w)
    target = F.when(leaders == 1, F.min("__lead").over(w)).otherwise(G.snap_font_size(F.percentile("est_pt", 0.5).over(w)))
    held = held.withColumn("__t", F.when((kinds > 1) & (lo > 0) & (hi - lo <= kinds - 1), target))
    held = held.withColumn("__top", F.min(F.least("max_fit_pt", "clamp_pt")).over(w))
    fit = F.array_max(F.filter(F.array(*[F.lit(float(s)) for s in G.C.FONT_LADDER]), lambda s: s <= F.col("__top")))
    goal = F.when(F.col("__t") > F.col("__top"), F.coalesce(fit, "__t")).otherwise(F.col("__t"))
    return held.select("page", "pos", "cc", F.coalesce(goal, "font_pt").alias("font_pt"), "bold")


def median_fill(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """One fill for each chip: page, pos, cc, bg_rgb, the median of each channel, cut to whole numbers."""
    held = grouped(lines.where(F.col("bg_rgb").isNotNull()), edges)
    w = Window.partitionBy("page", "cc")
    mid = F.struct(*[F.percentile(f"bg_rgb.{c}", 0.5).over(w).cast("int").alias(c) for c in "rgb"])
    fill = F.when(F.count(F.lit(1)).over(w) > 1, mid).otherwise(F.struct("bg_rgb.r", "bg_rgb.g", "bg_rgb.b"))
    return held.select("page", "pos", "cc", fill.alias("bg_rgb"))


def merge_titles(lines: DataFrame, edges: DataFrame, cjk: Column | None = None, spaced=T.pangu_spacing) -> DataFrame:
    """One line for each group of title fragments, in order of their left edge: page, cc, n, text,
    x0, y0, x1, y1, score, font_pt. A fragment that overlaps what is before it and starts with the
    mark that ends it loses that mark; the size is that of the fragment with most CJK text, then
    of the widest, then of the first."""
    wide = T.cjk_count("text") if cjk is None else cjk
    part = F.struct("x0", "pos", "text", "x1")
    held = grouped(lines, edges).withColumn("__cjk", wide)
    best = F.max(F.struct("__cjk", (F.col("x1") - F.col("x0")).alias("w"), (-F.col("x0")).alias("first"), (-F.col("pos")).alias("p"), "font_pt"))
    out = held.groupBy("page", "cc").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(part)).alias("parts"), F.min("x0").alias("x0"), F.min("y0").alias("y0"),
        F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("score").alias("score"), best["font_pt"].alias("font_pt"),
    )

    def add(s: Column, p: Column) -> Column:
        again = (F.length(p["text"]) > 0) & (F.length(s["text"]) > 0) & (p["x0"] < s["x1"]) & (T.fold_punct(F.left(p["text"], F.lit(1))) == T.fold_punct(F.right(s["text"], F.lit(1))))
        more = F.when(again, F.substr(p["text"], F.lit(2))).otherwise(p["text"])
        return F.struct(F.concat(s["text"], more).alias("text"), F.greatest(s["x1"], p["x1"]).alias("x1"))

    first = F.struct(F.col("parts")[0]["text"].alias("text"), F.col("parts")[0]["x1"].alias("x1"))
    text = F.aggregate(F.slice("parts", 2, F.size("parts")), first, add)["text"]
    merged = F.when(F.col("n") > 1, T.strip(spaced(text))).otherwise(text)
    return out.select("page", "cc", "n", merged.alias("text"), "x0", "y0", "x1", "y1", "score", "font_pt")


def alignment(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """left, center or right by the least population variance of the lines' edges; one line is left.
    Variances that are equal to six places are equal."""
    spread = lambda c: F.round(F.var_pop(c), 6)
    held = blocks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), spread(F.col("x0")).alias("l"), spread((F.col("x0") + F.col("x1")) / 2).alias("c"), spread(F.col("x1")).alias("r")
    )
    choice = lambda v, k, name: F.struct(F.col(v).alias("v"), F.lit(k).alias("k"), F.lit(name).alias("name"))
    best = F.array_min(F.array(choice("l", 0, "left"), choice("c", 1, "center"), choice("r", 2, "right")))["name"]
    return held.select(*keys, "n", F.when(F.col("n") < 2, "left").otherwise(best).alias("align"))
