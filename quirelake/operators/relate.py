"""Joins between the lines of one page.

Every join has the page as equi-key, so geometry is a residual condition of a hash or
sort-merge join and never a Cartesian product. Lines are compared as a (left) and b (right).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import geometry as G
from ..functions import text as T
from . import pages as P

PAGE = "page"


def pairs(lines: DataFrame, on: Column, ordered: bool = True, how: str = "inner") -> DataFrame:
    """a and b of one page for which ``on`` holds; ``ordered`` takes each pair once."""
    once = F.col("a.pos") < F.col("b.pos") if ordered else F.col("a.pos") != F.col("b.pos")
    return lines.alias("a").join(lines.alias("b"), (F.col("a.page") == F.col("b.page")) & once & on, how)


def ids(joined: DataFrame) -> DataFrame:
    return joined.select(F.col("a.page").alias("page"), F.col("a.pos").alias("i"), F.col("b.pos").alias("j"))


def overlapping(lines: DataFrame, share: float = 0.3) -> DataFrame:
    return ids(pairs(lines, G.boxes_overlap("a", "b", share)))


def near(lines: DataFrame) -> DataFrame:
    """(i, j) where j meets i's box padded by two of its heights; not symmetric."""
    pad = G.height("a") * 2
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    meets = (b("x0") < a("x1") + pad) & (b("x1") > a("x0") - pad) & (b("y0") < a("y1") + pad) & (b("y1") > a("y0") - pad)
    return ids(pairs(lines, meets, ordered=False))


def twins(lines: DataFrame) -> DataFrame:
    """Lines of one size, of like height, stacked in a column."""
    hi, lo = F.greatest(G.height("a"), G.height("b")), F.abs(G.height("a") - G.height("b"))
    like = (F.col("a.font_pt") == F.col("b.font_pt")) & (lo <= 0.3 * hi) & (G.x_overlap("a", "b") >= 0.6 * F.least(G.width("a"), G.width("b"))) & (-G.y_overlap("a", "b") <= 0.8 * hi)
    return ids(pairs(lines, like))


def rotated_pairs(lines: DataFrame, min_angle: float = 15) -> DataFrame:
    """Steeply turned lines without CJK whose turned boxes meet; lines have angle, cx, cy, w, h."""
    t = F.radians("a.angle")
    dx, dy = F.col("b.cx") - F.col("a.cx"), F.col("b.cy") - F.col("a.cy")
    u, v = dx * F.cos(t) + dy * F.sin(t), dy * F.cos(t) - dx * F.sin(t)
    steep = lines.where((F.abs("angle") >= min_angle) & ~T.has_cjk("text"))
    return ids(pairs(steep, (F.abs(u) < (F.col("a.w") + F.col("b.w")) / 2) & (F.abs(v) < (F.col("a.h") + F.col("b.h")) / 2)))


def right_neighbours(lines: DataFrame) -> DataFrame:
    """For each line the nearest line of its row that starts behind its end: page, pos, nb, nb_x0."""
    row = (F.col("b.x0") > F.col("a.x1")) & (G.y_overlap("a", "b") >= 0.5 * F.least(G.height("a"), G.height("b")))
    joined = pairs(lines, row, ordered=False).groupBy(F.col("a.page").alias("page"), F.col("a.pos").alias("pos"))
    best = joined.agg(F.min(F.struct(F.col("b.x0").alias("x0"), F.col("b.pos").alias("pos"))).alias("m"))
    return best.select("page", "pos", F.col("m.pos").alias("nb"), F.col("m.x0").alias("nb_x0"))


def above_and_below(kept: DataFrame, dropped: DataFrame) -> DataFrame:
    """For each dropped line the nearest kept lines of its column above and below: page, pos, above, below."""
    column = (F.col("a.page") == F.col("b.page")) & (G.x_overlap("a", "b") >= 0.3 * F.greatest(F.lit(1.0), G.width("a")))
    h = F.greatest(F.lit(1.0), G.height("a"))
    joined = dropped.alias("a").join(kept.alias("b"), column, "left")
    over = F.col("b.y1") <= F.col("a.y0") + 0.3 * h
    under = ~over & (F.col("b.y0") >= F.col("a.y1") - 0.3 * h)
    return joined.groupBy(F.col("a.page").alias("page"), F.col("a.pos").alias("pos")).agg(
        F.min(F.when(over, F.struct(-F.col("b.y1"), F.col("b.pos").alias("p"))))["p"].alias("above"),
        F.min(F.when(under, F.struct(F.col("b.y0"), F.col("b.pos").alias("p"))))["p"].alias("below"),
    )


def propagate_arcs(lines: DataFrame) -> DataFrame:
    """Flat tall lines that overlap an arc take its sagitta, scaled by the square of the widths; of
    several arcs the first in order counts. lines have ``arc`` (0: flat)."""
    tall = (F.col("a.arc") == 0) & (F.col("b.arc") != 0) & (G.height("a") >= C.ARC_BOX_H)
    over = (G.x_overlap("a", "b") > 0.6 * F.least(G.width("a"), G.width("b"))) & (G.y_overlap("a", "b") > 0)
    scale = F.pow(G.width("a") / G.width("b"), 2)
    joined = pairs(lines, tall & over, ordered=False).groupBy(F.col("a.page").alias("page"), F.col("a.pos").alias("pos"))
    return joined.agg(F.min(F.struct(F.col("b.pos").alias("p"), (F.col("b.arc") * scale).alias("arc")))["arc"].alias("arc"))


def free_bands(lines: DataFrame, short: Column, page_h: Column) -> DataFrame:
    """Bands just below and above short lines that no line of the page covers: page, pos, band, y0, y1."""
    h = F.col("y1") - F.col("y0")
    band = lambda name, lo, hi: F.struct(F.lit(name).alias("band"), lo.alias("y0"), hi.alias("y1"))
    below, above = band("below", F.col("y1") - 0.1 * h, F.col("y1") + 1.1 * h), band("above", F.col("y0") - 1.1 * h, F.col("y0") + 0.1 * h)
    bands = lines.where(short & (h <= 90)).select("page", "pos", (F.col("x0") - 0.2 * h).alias("x0"), (F.col("x1") + 0.2 * h).alias("x1"), page_h.alias("__h"), F.inline(F.array(below, above)))
    bands = bands.where((F.col("y0") >= 0) & (F.col("y1") <= F.col("__h"))).drop("__h")
    other = lines.select("page", "x0", "y0", "x1", "y1")
    return bands.alias("a").join(other.alias("b"), (F.col("a.page") == F.col("b.page")) & G.boxes_overlap("a", "b", 0.3), "left_anti").select("page", "pos", "band", "y0", "y1")


def code_siblings(lines: DataFrame, wide: Column | None = None, marks: str = "_`") -> DataFrame:
    """Sizes of code lines (flat, no wide text, with an underscore or a backtick) that stand by a smaller
    line with CJK text: page, pos, font_pt.

    Writers hold no CJK and sources do, so no row reads what another wrote; of several sources the
    first in order counts.
    """
    h = F.least(G.height("a"), G.height("b"))
    close = (F.abs(F.col("a.x0") - F.col("b.x0")) <= 0.5 * h) & (-G.y_overlap("a", "b") <= 0.6 * h)
    like = G.colours_near("a", "b", "bg_rgb", 25) & G.colours_near("a", "b", "text_rgb", 45)
    wide = T.has_cjk("text") if wide is None else wide
    code = P.is_flat() & ~wide & T.is_pure_latin("text") & F.col("text").rlike(f"[{marks}]")
    marked = lines.withColumn("__latin", code).withColumn("__wide", wide)
    on = F.col("a.__latin") & F.col("b.__wide") & (F.col("b.font_pt") < F.col("a.font_pt")) & close & like
    joined = pairs(marked, on, ordered=False).groupBy(F.col("a.page").alias("page"), F.col("a.pos").alias("pos"))
    return joined.agg(F.min(F.struct(F.col("b.pos").alias("p"), F.col("b.font_pt").alias("font_pt")))["font_pt"].alias("font_pt"))


def title_edges(lines: DataFrame) -> DataFrame:
    """Fragments of one title, side by side in a row."""
    h = F.least(G.height("a"), G.height("b"))
    gap = F.when(F.col("a.x0") <= F.col("b.x0"), F.col("b.x0") - F.col("a.x1")).otherwise(F.col("a.x0") - F.col("b.x1"))
    same = (F.col("a.font_pt") >= C.TITLE_PT) & (F.col("b.font_pt") >= C.TITLE_PT) & (F.col("a.bold") == F.col("b.bold"))
    back = F.col("a.bg_rgb").isNull() == F.col("b.bg_rgb").isNull()
    flat = lines.where(P.is_flat())
    return ids(pairs(flat, same & (G.y_overlap("a", "b") >= 0.6 * h) & (gap <= 0.8 * h) & G.colours_near("a", "b", "text_rgb", 45) & back))


def wrap_edges(lines: DataFrame) -> DataFrame:
    """Neighbouring lines of one paragraph. For lines of equal top either may be the upper one."""
    marked = lines.where((F.col("est_pt") > 0) & P.is_flat()).withColumn("__weak", P.marginal_bold() | P.auto_bold_only())
    h = F.least(G.height("a"), G.height("b"))
    gap = F.col("b.y0") - F.col("a.y1")
    weight = (F.col("a.bold") == F.col("b.bold")) | F.when(F.col("a.bold"), F.col("a.__weak")).otherwise(F.col("b.__weak"))
    size = F.abs(F.col("a.est_pt") - F.col("b.est_pt")) <= 0.14 * F.greatest("a.est_pt", "b.est_pt")
    on = (
        (F.col("a.y0") <= F.col("b.y0")) & (gap > -0.6 * h) & (gap < 0.45 * h)
        & (G.x_overlap("a", "b") >= 0.4 * F.least(G.width("a"), G.width("b"))) & weight & size
        & G.colours_near("a", "b", "bg_rgb", 25) & G.colours_near("a", "b", "text_rgb", 45)
    )
    return ids(pairs(marked, on, ordered=False))


def chip_edges(lines: DataFrame) -> DataFrame:
    """Stacked lines on one chip; lines of several fills are of none."""
    filled = lines.where(F.col("bg_rgb").isNotNull() & P.is_flat())
    if "bg_segments" in lines.columns:
        filled = filled.where(F.coalesce(F.size("bg_segments"), F.lit(0)) < 2)
    h = F.least(G.height("a"), G.height("b"))
    on = (
        (-G.y_overlap("a", "b") <= 0.6 * h) & (G.x_overlap("a", "b") >= 0.5 * F.least(G.width("a"), G.width("b")))
        & G.colours_near("a", "b", "text_rgb", 25) & G.colours_near("a", "b", "bg_rgb", 40)
    )
    return ids(pairs(filled, on))
