"""Numeric and geometric functions of lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .text import col


def _ladder() -> Column:
    return F.array(*[F.lit(float(s)) for s in C.FONT_LADDER])


def nearest_on_ladder(pt: Column | str) -> Column:
    """The ladder size nearest to pt, the smaller of two that are equally near."""
    x = col(pt)
    return F.array_min(F.transform(_ladder(), lambda s: F.struct(F.abs(s - x).alias("d"), s.alias("s"))))["s"]


def snap_font_size(pt: Column | str, max_pt: Column | str | None = None, tol: float = 1.10) -> Column:
    """Nearest ladder size; above a ceiling, the largest size within it, if there is one."""
    best = nearest_on_ladder(pt)
    if max_pt is None:
        return best
    limit = col(max_pt) * F.lit(tol)
    fit = F.array_max(F.filter(_ladder(), lambda s: s <= limit))
    return F.when(limit.isNotNull() & (best > limit), F.coalesce(fit, best)).otherwise(best)


def ladder_step(pt: Column | str) -> Column:
    """Position on the ladder from 1; 0 off it."""
    return F.array_position(_ladder(), col(pt).cast("double"))


def width_tolerance(em: Column | str) -> Column:
    x = col(em)
    return F.when(x <= 8, 1.12).when(x >= 12, 1.03).otherwise(F.lit(1.12) - (x - 8) * F.lit(0.09 / 4))


def px_to_emu(px: Column | str, img_w: Column | str) -> Column:
    """Half-even rounding to the slide's units."""
    return F.rint(col(px) * F.lit(C.SLIDE_EMU) / col(img_w)).cast("long")


def quad_bounds(quad: Column | str) -> Column:
    """(x0, x1, y0, y1) of an array of points; null unless it has points of two numbers."""
    q = col(quad)
    xs, ys = F.transform(q, lambda p: F.get(p, F.lit(0))), F.transform(q, lambda p: F.get(p, F.lit(1)))
    ok = (F.size(q) > 0) & F.forall(q, lambda p: F.size(p) >= 2)
    return F.when(ok, F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1")))


def tilt(quad: Column | str) -> Column:
    """Angle in degrees of a quad's summed top and bottom edges; 0 below 5 and above 45 degrees;
    with the mean lengths of opposite edges and the centre."""
    q = col(quad)
    p = lambda i, k: q[i][k]
    dx = (p(1, 0) - p(0, 0)) + (p(2, 0) - p(3, 0))
    dy = (p(1, 1) - p(0, 1)) + (p(2, 1) - p(3, 1))
    raw = F.degrees(F.atan2(dy, dx))
    side = lambda a, b: F.hypot(p(b, 0) - p(a, 0), p(b, 1) - p(a, 1))
    mean = lambda k: (p(0, k) + p(1, k) + p(2, k) + p(3, k)) / 4
    return F.struct(
        F.when((F.abs(raw) < 5) | (F.abs(raw) > 45), 0.0).otherwise(raw).alias("angle"),
        ((side(0, 1) + side(3, 2)) / 2).alias("w"),
        ((side(0, 3) + side(1, 2)) / 2).alias("h"),
        mean(0).alias("cx"),
        mean(1).alias("cy"),
    )


def arc_sagitta(fragments: Column | str, box_h: Column | str) -> Column:
    """Sagitta of text fragments (x, y) along an arc: mean of both ends less the middle; 0 unless
    three or more span four box heights and it is 12 px or more."""
    f = F.array_sort(col(fragments))
    n = F.size(f)
    rise = (f[0]["y"] + F.element_at(f, -1)["y"]) / 2 - F.get(f, F.floor(n / 2).cast("int"))["y"]
    wide = (F.element_at(f, -1)["x"] - f[0]["x"]) >= 4 * col(box_h)
    return F.when((n >= 3) & wide & (F.abs(rise) >= C.ARC_MIN_SAGITTA), rise).otherwise(0.0)


def x_overlap(a: str, b: str) -> Column:
    return F.least(f"{a}.x1", f"{b}.x1") - F.greatest(f"{a}.x0", f"{b}.x0")


def y_overlap(a: str, b: str) -> Column:
    return F.least(f"{a}.y1", f"{b}.y1") - F.greatest(f"{a}.y0", f"{b}.y0")


def width(a: str) -> Column:
    return F.col(f"{a}.x1") - F.col(f"{a}.x0")


def height(a: str) -> Column:
    return F.col(f"{a}.y1") - F.col(f"{a}.y0")


def boxes_overlap(a: str, b: str, share: float) -> Column:
    """Common area above a share of the smaller box; touching boxes don't overlap."""
    ox, oy = x_overlap(a, b), y_overlap(a, b)
    area = F.greatest(F.lit(1.0), F.least(width(a) * height(a), width(b) * height(b)))
    return (ox > 0) & (oy > 0) & (ox * oy > share * area)


def colours_near(a: str, b: str, name: str, most: float) -> Column:
    """Both null, or both set and no channel further apart than ``most``."""
    x, y = F.col(f"{a}.{name}"), F.col(f"{b}.{name}")
    far = F.greatest(*[F.abs(x[c] - y[c]) for c in "rgb"])
    return (x.isNull() & y.isNull()) | (x.isNotNull() & y.isNotNull() & (far <= most))


def watermark_box(h: Column) -> Column:
    """The box of a watermark with the logo before it."""
    return F.struct((F.col("x0") - h * 1.8).alias("x0"), (F.col("y0") - h * 0.3).alias("y0"), (F.col("x1") + h * 0.3).alias("x1"), (F.col("y1") + h * 0.3).alias("y1"))


def ink_height_to_pt(ink_h: Column | str, px_to_pt: Column | float, ratio: Column | str) -> Column:
    """Points of an ink band: blur off, but never more than 40 %, over the ink ratio."""
    h = col(ink_h)
    scale = F.lit(px_to_pt) if isinstance(px_to_pt, float) else px_to_pt
    return F.greatest(h - C.BLUR_PX, h * 0.6) * scale / col(ratio)
