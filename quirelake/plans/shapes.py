"""Lowering of styled blocks to a table of output shapes, in slide units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T

COVER_PAD_PX = 3.0
LEADING = 0.20
ARC_STRIPS = 12


def slide_height(page_w_pt: Column | str, page_h_pt: Column | str) -> Column:
    return F.rint(F.lit(C.SLIDE_EMU) * T.col(page_h_pt) / T.col(page_w_pt)).cast("long")


def _emu(px: Column, size: Column, of: Column) -> Column:
    return F.rint(px * size / of).cast("long")


def text_shapes(blocks: DataFrame, cover: bool = True) -> DataFrame:
    """Rows (page, block, kind, name, left, top, width, height, rotation, fill, margin_top, wrap, vertical,
    align) of single-line blocks: a text shape each, and a cover of its own where the leading above
    the text would paint over the row before it.

    blocks has page, block, x0, y0, x1, y1, font_pt, align, bg_rgb, angle, cx, cy, w, h (of a turned
    box), ink_top_px, ink_bottom_px, cover_x0_px, cover_x1_px, highlight_removed, vertical, img_w,
    img_h, slide_h.
    """
    wide, high = F.lit(C.SLIDE_EMU), F.col("slide_h")
    ex, ey = (lambda px: _emu(px, wide, F.col("img_w"))), (lambda px: _emu(px, high, F.col("img_h")))
    nudge = F.when(F.col("vertical"), 0).otherwise(F.rint(F.col("font_pt") * F.lit(LEADING) * C.EMU_PER_PT)).cast("long")
    tilted = (F.col("angle") != 0) & F.col("cx").isNotNull() & F.col("w").isNotNull()
    x0, x1 = F.greatest("x0", "cover_x0_px"), F.least("x1", "cover_x1_px")
    over = F.greatest(F.lit(8.0), (F.col("y1") - F.col("y0")) * 0.12)
    has_ink = F.coalesce(F.col("ink_bottom_px") > 0, F.lit(False))
    pad = F.greatest(F.lit(4.0), (F.col("ink_bottom_px") - F.col("ink_top_px")) * 0.08)
    cov0 = F.when(F.col("highlight_removed"), F.col("y0") - over).when(has_ink, F.col("ink_top_px") - pad).otherwise(F.col("y0") - COVER_PAD_PX)
    cov1 = F.when(F.col("highlight_removed"), F.col("y1") + over).when(has_ink, F.col("ink_bottom_px") + pad).otherwise(F.col("y1") + COVER_PAD_PX)
    d = blocks.withColumns(
        {
            "__tilted": F.coalesce(tilted, F.lit(False)), "__left": ex(x0 - COVER_PAD_PX), "__right": ex(x1 + COVER_PAD_PX), "__cov0": ey(cov0), "__cov1": ey(cov1),
            "__text": ey(F.coalesce("ink_top_px", F.lit(0.0))) - nudge, "__nudge": nudge, "__tw": ex(F.col("w") + 2 * COVER_PAD_PX), "__th": ey(F.col("h") + 2 * COVER_PAD_PX),
            "__fill": F.when(F.lit(cover), F.col("bg_rgb")),
        }
    )
    own = ~F.col("__tilted") & F.col("__fill").isNotNull() & (F.col("__text") < F.col("__cov0"))
    top = F.when(F.col("__tilted"), ey(F.col("cy")) - F.floor(F.col("__th") / 2) - F.col("__nudge")).when(own, F.col("__text")).otherwise(F.least("__text", "__cov0"))
    left = F.when(F.col("__tilted"), ex(F.col("cx")) - F.floor(F.col("__tw") / 2)).otherwise(F.col("__left"))
    box = lambda kind, tail, l, t, w, h, rot, fill, margin: F.struct(
        F.lit(kind).alias("kind"), F.concat(F.lit("Text "), F.col("block").cast("string"), F.lit(tail)).alias("name"), F.greatest(F.lit(0), l).cast("long").alias("left"),
        F.greatest(F.lit(0), t).cast("long").alias("top"), w.cast("long").alias("width"), h.cast("long").alias("height"), rot.cast("double").alias("rotation"),
        fill.alias("fill"), margin.cast("long").alias("margin_top"),
    )
    no_fill = F.lit(None).cast(blocks.schema["bg_rgb"].dataType)
    cover_box = box("cover", " bg", F.col("__left"), F.col("__cov0"), F.col("__right") - F.col("__left"), F.col("__cov1") - F.col("__cov0"), F.lit(0.0), F.col("__fill"), F.lit(0))
    text_box = box(
        "text", "", left, top, F.when(F.col("__tilted"), F.col("__tw")).otherwise(F.col("__right") - F.col("__left")),
        F.when(F.col("__tilted"), F.col("__th") + F.col("__nudge")).otherwise(F.col("__cov1") - top), F.when(F.col("__tilted"), F.col("angle")).otherwise(0.0),
        F.when(own, no_fill).otherwise(F.col("__fill")), F.when(own | F.col("__tilted") | F.col("vertical"), 0).otherwise(F.greatest(F.lit(0), F.col("__text") - top)),
    )
    shapes = F.when(own, F.array(cover_box, text_box)).otherwise(F.array(text_box))
    align = F.when(F.col("vertical"), "center").otherwise(F.col("align"))
    return d.select("page", "block", F.posexplode(shapes).alias("z", "s"), align.alias("align"), "vertical").select("page", "block", "z", "s.*", F.lit(False).alias("wrap"), "vertical", "align")


def wipe_shapes(wipes: DataFrame) -> DataFrame:
    """Cover rectangles without text: page, i, left, top, width, height, fill; wipes has page, i, box
    x0..y1, fill, img_w, img_h, slide_h."""
    ex = lambda c: _emu(F.col(c), F.lit(C.SLIDE_EMU), F.col("img_w"))
    ey = lambda c: _emu(F.col(c), F.col("slide_h"), F.col("img_h"))
    zero = F.lit(0).cast("long")
    return wipes.select("page", "i", F.greatest(zero, ex("x0")).alias("left"), F.greatest(zero, ey("y0")).alias("top"), (ex("x1") - ex("x0")).alias("width"), (ey("y1") - ey("y0")).alias("height"), "fill")


def banner_covers(blocks: DataFrame) -> DataFrame:
    """Covers of two-tone banners, in painting order: a base over the whole width in the last fill,
    then each earlier segment. blocks has page, block, x0, x1, bg_segments (x0, x1, rgb), img_w."""
    ex = lambda px: _emu(px, F.lit(C.SLIDE_EMU), F.col("img_w"))
    s = F.col("bg_segments")
    part = lambda l, r, rgb: F.struct(l.alias("left"), r.alias("right"), rgb.alias("fill"))
    base = part(ex(F.col("x0") - COVER_PAD_PX), ex(F.col("x1") + COVER_PAD_PX), F.element_at(s, -1)["rgb"])
    rest = F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda e, i: part(F.when(i == 0, ex(e["x0"] - COVER_PAD_PX)).otherwise(ex(e["x0"])), ex(e["x1"]), e["rgb"]))
    return blocks.where(F.size(s) >= 2).select("page", "block", F.posexplode(F.concat(F.array(base), rest)).alias("z", "c")).select("page", "block", "z", "c.*")


def arc_strips(arcs: DataFrame) -> DataFrame:
    """Tangent cover strips along the parabola of each arc: page, block, k, cx, cy, w, h, rotation (px).
    arcs has page, block, x0, x1, y_mid, y_edge, glyph_h."""
    half = (F.col("x1") - F.col("x0")) / 2
    t = (F.col("k") + 0.5) / ARC_STRIPS * 2 - 1
    bend = F.col("y_edge") - F.col("y_mid")
    d = arcs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(ARC_STRIPS - 1)))).withColumn("t", t)
    slope = bend * 2 * F.col("t") / half
    return d.select(
        "page", "block", "k", ((F.col("x0") + F.col("x1")) / 2 + half * F.col("t")).alias("cx"), (F.col("y_mid") + bend * F.col("t") * F.col("t")).alias("cy"),
        (half * 2 / ARC_STRIPS * F.sqrt(slope * slope + 1)).alias("w"), (F.col("glyph_h") * 1.5).alias("h"), F.degrees(F.atan(slope)).alias("rotation"),
    )


def run_pieces(lines: DataFrame) -> DataFrame:
    """Text runs of lines: page, block, k, text, rgb, raised, size_pt. lines has page, block, text,
    text_rgb, runs, superscript_tail, font_pt; without usable runs a line is one piece."""
    one = F.array(F.struct(F.col("text").alias("text"), F.col("text_rgb").alias("rgb")))
    pieces = F.coalesce(F.when(F.size("runs") > 0, T.split_text_runs("text", "runs")), one)
    marked = T.mark_superscript(pieces, F.coalesce("superscript_tail", F.lit(0)))
    out = lines.select("page", "block", "font_pt", F.posexplode(marked).alias("k", "p")).select("page", "block", "k", "p.*", "font_pt")
    return out.withColumn("size_pt", F.col("font_pt") * F.when(F.col("raised"), 0.65).otherwise(1.0)).drop("font_pt")
