"""Page selection and row-wise filters of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config as C
from ..functions import geometry as G
from ..functions import text as T


def page_selection(spark: SparkSession, spec: str, page_count: Column | int) -> DataFrame:
    """(ord, page_no) of a list such as '1-5,8': zero-based, in the given order, repeats kept, numbers
    outside the deck dropped. A part that is no number fails when it is read."""
    count = F.lit(page_count) if isinstance(page_count, int) else page_count
    parts = spark.range(1).select(F.posexplode(F.split(F.lit(spec), ",")).alias("part", "s"))
    ends = F.split(F.trim("s"), "-", 2)
    first = F.trim(ends[0]).cast("int")
    last = F.when(F.size(ends) > 1, F.trim(F.get(ends, F.lit(1))).cast("int")).otherwise(first)
    last = F.least(last, count)  # before the sequence is built
    pages = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    rows = parts.select("part", F.posexplode(pages).alias("k", "n")).where((F.col("n") >= 1) & (F.col("n") <= count))
    return rows.select(F.row_number().over(Window.orderBy("part", "k")).alias("ord"), (F.col("n") - 1).cast("long").alias("page_no"))


def keep_confident(lines: DataFrame, min_score: float = 0.5) -> DataFrame:
    return lines.where((T.strip("text") != "") & (F.col("score") >= min_score))


def is_watermark(suffix: str, img_w: Column, img_h: Column, most: int | None = 16) -> Column:
    """Text of at most ``most`` characters that ends with a mark, in the lower right on a known fill."""
    bare = T.no_spaces("text")
    short = F.lit(True) if most is None else F.length(bare) <= most
    return bare.endswith(suffix) & short & (F.col("y0") > img_h * 0.85) & (F.col("x1") > img_w * 0.65) & F.col("bg_rgb").isNotNull()


def is_illegible() -> Column:
    bare = T.no_spaces("text")
    n, cjk = F.length(bare), T.cjk_count(bare)
    clean = (cjk == n) & (n >= 2) & (n <= 4) & (F.col("score") >= C.TINY_CJK_KEEP)
    tiny = ~clean & (F.col("score") < C.TINY_LATIN_KEEP)
    small = (F.col("font_pt") <= C.SMALL_PT) & (F.col("score") < C.SMALL_MIN_SCORE)
    soup = (cjk == 0) & (n <= 3) & (F.col("score") < C.GLYPH_MIN_SCORE)
    return F.when(F.col("font_pt") <= C.TINY_PT, tiny).otherwise(small | soup)


def is_weak() -> Column:
    bare = T.no_spaces("text")
    return (F.col("font_pt") <= C.TINY_PT) | ((F.col("font_pt") <= 20) & (F.length(bare) <= 2) & ~T.has_cjk(bare))


def is_markup_strikethrough() -> Column:
    return F.contains("text", F.lit("==")) & F.contains("text", F.lit("×"))


def is_axis_label(has_cjk: Column | None = None) -> Column:
    """Far taller than wide, upright by the detector, neither an arc nor typeset vertically."""
    cjk = T.has_cjk("text") if has_cjk is None else has_cjk
    return (F.col("y1") - F.col("y0") > 2.5 * (F.col("x1") - F.col("x0"))) & cjk & is_flat() & ~F.coalesce("vertical", F.lit(False))


def is_flat() -> Column:
    """Neither turned nor an arc."""
    return (F.coalesce("angle", F.lit(0.0)) == 0) & (F.coalesce("arc", F.lit(0.0)) == 0)


def is_vertical_cjk() -> Column:
    n = F.length("text")
    h, w = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    cell = h / n / w
    return (n >= 2) & ~F.col("text").rlike(r"[\x{0}-\x{2E7F}]") & (h >= 1.5 * w) & (cell >= 0.55) & (cell <= 1.7)


def marginal_bold() -> Column:
    return F.coalesce(F.col("bold") & (F.col("font_pt") >= C.TPL_MIN_PT) & (F.col("bold_r") < C.MARGINAL_R), F.lit(False))


def auto_bold_only() -> Column:
    return F.col("bold") & F.col("bold_r").isNull() & (F.col("stroke_rel") == 0) & (F.col("font_pt") >= C.AUTO_BOLD_PT)


def small_line() -> Column:
    return (F.col("font_pt") <= 14.0) | (F.col("score") < 0.8)


def decorative_icons(lines: DataFrame, min_pt: float = 28, icon: Column | None = None) -> DataFrame:
    """Single letters (or what ``icon`` says) of title size with no other line in their row."""
    letter = T.strip("text").rlike("^[A-Za-z]$") if icon is None else icon
    icon = lines.where(letter & (F.col("font_pt") >= min_pt)).alias("a")
    other = lines.select("page", "pos", "y0", "y1").alias("b")
    h = F.greatest(F.lit(1.0), G.height("a"))
    row = (F.col("a.page") == F.col("b.page")) & (F.col("a.pos") != F.col("b.pos")) & (G.y_overlap("a", "b") > 0.3 * h)
    return icon.join(other, row, "left_anti")


def reevaluate_bold(lines: DataFrame) -> DataFrame:
    """Weight of bold lines below the automatic size, from what was measured."""
    rgb, bg = F.col("text_rgb"), F.col("bg_rgb")
    total = lambda c: c["r"] + c["g"] + c["b"]
    chroma = F.greatest(*[rgb[c] for c in "rgb"]) - F.least(*[rgb[c] for c in "rgb"])
    dark = (chroma > C.CHROMA_MAX) & bg.isNotNull() & (total(rgb) < total(bg))
    by_template = F.col("bold_r").isNotNull() & (F.col("font_pt") >= C.TPL_MIN_PT) & ~F.coalesce(dark, F.lit(False))
    judged = F.when(by_template, F.col("bold_r") >= C.BOLD_R).otherwise((F.col("stroke_rel") > 0) & (F.col("stroke_rel") >= C.STROKE_BOLD))
    return lines.withColumn("bold", F.when(F.col("bold") & (F.col("font_pt") < C.AUTO_BOLD_PT), judged).otherwise(F.col("bold")))


def vote_bold(lines: DataFrame) -> DataFrame:
    """Weight by a vote of the page's lines of one size, with ``vote``: promote, demote, lone or none.

    All votes are counted before any weight changes, so a window over the cohort is exact.
    """
    votes = (F.col("stroke_rel") > 0) & (F.col("font_pt") < C.AUTO_BOLD_PT)
    w = Window.partitionBy("page", "font_pt")
    n = F.sum(votes.cast("int")).over(w)
    bold = F.sum((votes & F.col("bold")).cast("int")).over(w)
    kind = (
        F.when(~votes | (n < 3), "none")
        .when(bold * 3 >= n * 2, "promote")
        .when(bold * 5 <= n, "demote")
        .when((n <= 4) & (bold == 1), "lone")
        .otherwise("none")
    )
    template = F.col("bold_r").isNotNull() & (F.col("font_pt") >= C.TPL_MIN_PT)
    up = F.when(template, F.col("bold_r") >= -0.05).otherwise(F.col("stroke_rel") >= 0.115)
    down = F.when(template, F.col("bold_r") < C.MARGINAL_R).when(F.col("bold_r") >= 0.28, False).otherwise(F.col("stroke_rel") <= 0.15)
    vote = F.col("vote")
    flipped = (
        F.when((vote == "promote") & up, True)
        .when((vote == "demote") & down, False)
        .when((vote == "lone") & marginal_bold(), False)
        .otherwise(F.col("bold"))
    )
    return lines.withColumn("vote", kind).withColumn("bold", flipped)
