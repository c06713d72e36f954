"""Queries of the layout operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import runs as R
from ..functions import text as T
from ..operators import compare, groups, passes, relate, style, vocab
from ..operators import pages as P
from ..sources.lines import read_lines
from . import shapes

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}

LETTERS = "a-z"
ACCENTS = "à-öø-ÿ"
SAMPLES = (
    "用AI寫Code好", "第3章", "A  B", "（AI）", "完成°", "25°", "°", "abc °", "反椎規則", "雨份", "幹擾", "·項目", "· 項目", "•項目", "•", "-x",
    "：，。；（）", "café", "A。", "AI 用", "noun", "Format", "gap", "Z-Library", "佐證[1]", "",
)


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_ALL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _samples(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(s) for s in SAMPLES])).alias("k", "text"))


def _columns(lines: DataFrame, by: int = 10) -> DataFrame:
    """Lines moved together into columns, with two sizes only, so that stacks form."""
    w = F.col("x1") - F.col("x0")
    out = lines.withColumn("x1", F.col("x0") / by + w).withColumn("x0", F.col("x0") / by)
    return out.withColumn("font_pt", F.when(F.col("font_pt") < 20, 14.0).otherwise(F.when(F.col("pos") % 2 == 0, 24.0).otherwise(28.0))).withColumn("est_pt", F.col("font_pt") + (F.col("pos") % 7 - 3) * F.lit(0.25))


# ---------------------------------------------------------------- scans and filters


@query
def scan_lines(spark, sf_dir):
    return read_lines(spark, sf_dir).select("page", "pos", "text", "n", "x0", "y0", "x1", "y1", "score", "font_pt", "est_pt", "bold", "stroke_rel", "bold_r", F.col("text_rgb.r").alias("text_r"), F.col("bg_rgb.r").alias("bg_r"), "angle", "arc", "vertical")


@query
def page_select(spark, sf_dir):
    chosen = P.page_selection(spark, "1-5, 8,12,12,3-1,99999999", 1_000_000)
    counts = read_lines(spark, sf_dir).groupBy(F.col("page").alias("page_no")).agg(F.count(F.lit(1)).alias("n_lines"))
    return F.broadcast(chosen).join(counts, "page_no", "left").select("ord", "page_no", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query
def min_score_filter(spark, sf_dir):
    return P.keep_confident(read_lines(spark, sf_dir)).select("page", "pos", "score", "text")


@query
def watermark_split(spark, sf_dir):
    """Lines that end like a watermark in the lower right, and their cover boxes."""
    h = F.col("y1") - F.col("y0")
    mark = P.is_watermark("n.", F.lit(800.0), F.lit(300.0), most=None)
    return read_lines(spark, sf_dir).where(mark).select("page", "pos", G.watermark_box(h).alias("w")).select("page", "pos", "w.*")


@query
def illegible_filter(spark, sf_dir):
    return read_lines(spark, sf_dir).select("page", "pos", P.is_illegible().alias("illegible"), P.is_weak().alias("weak"))


@query
def decorative_icon_anti(spark, sf_dir):
    """Lines without a comma taken as icons, as no line is a single letter."""
    return P.decorative_icons(read_lines(spark, sf_dir), icon=~F.contains("text", F.lit(","))).select("page", "pos", "text", "font_pt")


@query
def markup_strike(spark, sf_dir):
    marked = read_lines(spark, sf_dir).withColumn("text", F.when(F.col("pos") % 5 == 0, F.concat(F.lit("=="), "text", F.lit("×"))).otherwise(F.col("text")))
    return marked.where(P.is_markup_strikethrough()).select("page", "pos")


@query
def axis_label(spark, sf_dir):
    lines = read_lines(spark, sf_dir).withColumn("x1", F.col("x0") + (F.col("x1") - F.col("x0")) / 40)
    return lines.where(P.is_axis_label(F.col("text").rlike(f"[{ACCENTS}]"))).select("page", "pos", "x0", "x1")


@query
def small_line_report(spark, sf_dir):
    lines = read_lines(spark, sf_dir)
    small = F.sum(P.small_line().cast("int"))
    return lines.groupBy("page").agg(small.cast("long").alias("n_small"), F.count(F.lit(1)).alias("n_lines")).where("n_small > 0")


# ---------------------------------------------------------------- text


@query
def text_chain_samples(spark, sf_dir):
    """Every text function over fixed CJK samples."""
    x = "text"
    return _samples(spark).select(
        "k", "text", T.pangu_spacing(x).alias("pangu"), T.fix_trailing_degree(x).alias("degree"), T.fix_confusions(x).alias("confusions"),
        T.normalize_bullet(x).alias("bullet"), T.fold_punct(x).alias("folded"), T.is_pure_latin(x).alias("latin"), F.round(T.text_width_em(x), 6).alias("em"),
        F.round(T.latin_ink_ratio(x), 6).alias("ink"), T.cjk_count(x).alias("cjk"), T.renderable_text(x).alias("drawn"), T.has_superscript_mark(x).alias("raised"),
    )


@query
def pangu_spacing(spark, sf_dir):
    lines = read_lines(spark, sf_dir)
    return lines.select("page", "pos", T.pangu_spacing("text", cjk=ACCENTS).alias("spaced"))


@query
def trailing_degree(spark, sf_dir):
    return read_lines(spark, sf_dir).select("page", "pos", T.fix_trailing_degree("text", mark=".", full_stop="。").alias("text"))


@query
def bullet_normalize(spark, sf_dir):
    return read_lines(spark, sf_dir).select("page", "pos", T.normalize_bullet(F.concat(F.when(F.col("pos") % 3 == 0, "·").when(F.col("pos") % 3 == 1, "•").otherwise(""), "text")).alias("text"))


@query
def text_measures(spark, sf_dir):
    em = T.text_width_em("text")
    return read_lines(spark, sf_dir).select(
        "page", "pos", F.round(em, 6).alias("em"), F.round(T.latin_ink_ratio("text"), 6).alias("ink"), F.round(G.width_tolerance(em), 6).alias("tolerance"),
        T.is_pure_latin("text").alias("latin"), T.latin_font("font_pt").alias("face"),
    )


@query
def page_vocab(spark, sf_dir):
    return vocab.page_vocab(read_lines(spark, sf_dir), LETTERS)


def _words(lines: DataFrame, *more: str) -> DataFrame:
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)), lambda w: F.length(w).between(2, 4))
    return lines.select("page", *more, F.posexplode(words).alias("k", "w")) if more else lines.select("page", "score", F.explode(words).alias("w"))


@query
def vocab_match(spark, sf_dir):
    """Short words of uncertain lines, corrected by the short words of confident ones."""
    by = _words(read_lines(spark, sf_dir)).groupBy("page", "w").agg(F.count_if(F.col("score") >= 0.8).alias("cnt"), F.max(F.col("score") < 0.8).alias("doubt"))
    unsure = by.where("doubt AND cnt = 0").select("page", F.col("w").alias("cand"))
    return vocab.vocab_match(unsure, by.where("cnt > 0").select("page", F.col("w").alias("token"), "cnt"))


@query
def vocab_correct(spark, sf_dir):
    """Every short word of a page as a line of its own, uncertain ones corrected by the page's words."""
    words = _words(read_lines(spark, sf_dir), "pos", "score").withColumnRenamed("w", "text")
    known = words.where("score >= 0.8").groupBy("page", F.col("text").alias("token")).agg(F.count(F.lit(1)).alias("cnt"))
    return vocab.correct_lines(words, known, LETTERS).select("page", "pos", "k", "text")


# ---------------------------------------------------------------- numbers


@query
def snap_font_size(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem")
    return items.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n")).select("l_quantity", "n", G.snap_font_size(F.col("l_quantity") * 1.3).alias("snapped"))


@query
def snap_with_ceiling(spark, sf_dir):
    lines = read_lines(spark, sf_dir)
    return lines.select("page", "pos", G.snap_font_size("est_pt").alias("free"), G.snap_font_size("est_pt", F.col("font_pt") - 2.0, 1.0).alias("tight"), G.snap_font_size("est_pt", F.col("font_pt") - 2.0).alias("loose"))


@query
def px_to_emu(spark, sf_dir):
    lines = read_lines(spark, sf_dir)
    return lines.select("page", "pos", *[G.px_to_emu(c, F.lit(1728.0)).alias(f"{c}_emu") for c in ("x0", "y0", "x1", "y1")])


# ---------------------------------------------------------------- relations


@query
def overlap_pairs(spark, sf_dir):
    return relate.overlapping(read_lines(spark, sf_dir), 0.3)


@query
def near_pairs(spark, sf_dir):
    return relate.near(read_lines(spark, sf_dir))


@query
def twin_pairs(spark, sf_dir):
    return relate.twins(_columns(read_lines(spark, sf_dir)))


@query
def rotated_pairs(spark, sf_dir):
    lines = read_lines(spark, sf_dir)
    turned = lines.select(
        "page", "pos", "text", (F.col("pos") % 3 * 20).cast("double").alias("angle"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"),
        (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0") + 40).alias("h"),
    )
    return relate.rotated_pairs(turned)


@query
def right_neighbor(spark, sf_dir):
    return relate.right_neighbours(read_lines(spark, sf_dir))


@query
def nearest_above_below(spark, sf_dir):
    lines = read_lines(spark, sf_dir)
    return relate.above_and_below(lines.where("pos % 4 <> 2"), lines.where("pos % 4 = 2"))


@query
def arc_propagate(spark, sf_dir):
    lines = read_lines(spark, sf_dir).withColumn("y1", F.col("y1") + 60).withColumn("arc", F.when(F.col("pos") % 5 == 0, F.lit(16.0)).otherwise(0.0))
    return relate.propagate_arcs(lines)


@query
def sibling_band_anti(spark, sf_dir):
    return relate.free_bands(read_lines(spark, sf_dir), F.col("n") <= 60, F.lit(3000.0))


@query
def code_block_siblings(spark, sf_dir):
    """Lines with q or z taken as code, lines with accents as CJK."""
    return relate.code_siblings(_columns(read_lines(spark, sf_dir), 40), F.col("text").rlike(f"[{ACCENTS}]"), "qz")


@query
def wrap_groups(spark, sf_dir):
    lines = _columns(read_lines(spark, sf_dir))
    return groups.unify_sizes(lines, relate.wrap_edges(lines))


@query
def chip_median_bg(spark, sf_dir):
    lines = _columns(read_lines(spark, sf_dir))
    out = groups.median_fill(lines, relate.chip_edges(lines))
    return out.select("page", "pos", "cc", F.col("bg_rgb.r").alias("bg_r"))


@query
def row_title_merge(spark, sf_dir):
    lines = read_lines(spark, sf_dir).withColumn("font_pt", F.col("font_pt") + 20)
    return groups.merge_titles(lines, relate.title_edges(lines), cjk=F.length(F.regexp_replace("text", f"[^{ACCENTS}]", "")))


@query
def bold_cohort_vote(spark, sf_dir):
    return P.vote_bold(read_lines(spark, sf_dir)).select("page", "pos", "font_pt", "vote", "bold")


@query
def page_bold_summary(spark, sf_dir):
    """Per page: lines, bold before, and what the vote promotes and demotes."""
    before = read_lines(spark, sf_dir).withColumn("was", F.col("bold"))
    voted = P.vote_bold(before)
    count = lambda c: F.sum(c.cast("int")).cast("long")
    return voted.groupBy("page").agg(
        F.count(F.lit(1)).alias("n_lines"), count(F.col("was")).alias("n_bold"), count(F.col("bold") & ~F.col("was")).alias("promoted"), count(F.col("was") & ~F.col("bold")).alias("demoted")
    )


@query
def reeval_clamped_bold(spark, sf_dir):
    return P.reevaluate_bold(read_lines(spark, sf_dir)).select("page", "pos", "bold")


@query
def detect_align(spark, sf_dir):
    return groups.alignment(read_lines(spark, sf_dir), ["page", "font_pt"])


# ---------------------------------------------------------------- orders and runs


@query
def reading_order(spark, sf_dir):
    w = Window.partitionBy("page").orderBy("y0", "x0", "pos")
    return read_lines(spark, sf_dir).select("page", "pos", F.row_number().over(w).alias("ord"))


@query
def x_order(spark, sf_dir):
    w = Window.partitionBy("page").orderBy("x0", "pos")
    return read_lines(spark, sf_dir).select("page", "pos", F.row_number().over(w).alias("ord"))


@query
def longest_run(spark, sf_dir):
    """Longest run of positive components of each vector."""
    vectors = _table(spark, sf_dir, "embeddings")
    flags = F.transform("embedding", lambda x: x > 0)
    return vectors.select("vec_id", R.longest_run(flags).cast("long").alias("longest"), F.size(R.true_runs(flags)).cast("long").alias("n_runs"))


@query
def role_runs(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "system", "user").otherwise(F.col("role")).alias("role"))
    return R.islands(turns, ["conv_id"], "turn", "role")


@query
def gap_split(spark, sf_dir):
    """A user's events in groups, split where an hour passes between two of them."""
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    by = events.groupBy("user_id", "us").agg(F.count(F.lit(1)).alias("n"))
    held = R.gap_groups(by, ["user_id"], "us", F.lit(3_600_000_000))
    return held.groupBy("user_id", "grp").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.sum("n").alias("n"))


@query
def prefix_cuts(spark, sf_dir):
    """Lines of a page dealt into four parts of equal text length."""
    return R.prefix_cuts(read_lines(spark, sf_dir), ["page"], "pos", "n", 4).select("page", "pos", "part")


@query
def color_runs(spark, sf_dir):
    """Colour runs along the lines of a page."""
    by = read_lines(spark, sf_dir).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "text_rgb"))).alias("l"))
    runs = R.colour_runs(F.transform("l", lambda e: F.when(e["pos"] % 6 != 5, e["text_rgb"])))
    return by.select("page", F.posexplode(runs).alias("k", "run")).select("page", "k", F.col("run.n").alias("n"), F.col("run.rgb.r").alias("r"))


@query
def mean_segments(spark, sf_dir):
    """Segments of line widths by their running mean."""
    by = read_lines(spark, sf_dir).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("l"))
    segments = R.running_mean_segments(F.transform("l", lambda e: e["n"]), 26.0)
    return by.select("page", F.posexplode(segments).alias("k", "s")).select("page", "k", "s.start", "s.n", F.round("s.mean", 6).alias("mean"))


@query
def quantized_mode(spark, sf_dir):
    """The most frequent of 16 levels of a vector's components, the lowest of equals."""
    vectors = _table(spark, sf_dir, "embeddings")
    level = F.floor((F.col("x").cast("double") + 1) * 8).cast("long")
    by = vectors.select("vec_id", F.explode("embedding").alias("x")).groupBy("vec_id", level.alias("level")).agg(F.count(F.lit(1)).alias("c"))
    best = F.max(F.struct("c", (-F.col("level")).alias("l")))
    return by.groupBy("vec_id").agg(best.alias("m")).select("vec_id", (-F.col("m.l")).alias("level"), F.col("m.c").alias("c"))


@query
def split_text_runs(spark, sf_dir):
    """Pieces of a line for two colour runs, the last three characters raised."""
    lines = read_lines(spark, sf_dir).select("page", "pos", F.col("text").alias("t"), "text_rgb", "bg_rgb")
    bare = F.length(T.no_spaces("t"))
    part = lambda n, c: F.struct(n.cast("int").alias("n"), F.col(c).alias("rgb"))
    pieces = T.split_text_runs("t", F.array(part(F.floor(bare / 2), "text_rgb"), part(bare - F.floor(bare / 2), "bg_rgb")))
    return lines.select("page", "pos", F.posexplode(T.mark_superscript(pieces, 3)).alias("k", "p")).select("page", "pos", "k", F.col("p.text").alias("text"), F.col("p.raised").alias("raised"))


@query
def debug_json(spark, sf_dir):
    """A page's lines as one JSON text, as the debug sink writes it."""
    from ..sources.sinks import debug_rows

    return debug_rows(read_lines(spark, sf_dir))


@query
def style_sizes(spark, sf_dir):
    """Sizes, ceilings and weights of lines whose ink is a function of their place."""
    i, p = F.col("page"), F.col("pos")
    real = lambda c: c.cast("double")
    tall = F.col("y1") - F.col("y0") - real(p % 5)
    seen = read_lines(spark, sf_dir).withColumns(
        {
            "img_w": F.lit(1728.0), "ink_h_px": tall, "ink_h_font_px": tall - real(i % 3), "ink_w_px": F.when(p % 13 != 7, F.col("x1") - F.col("x0") - real(p % 7)),
            "room_px": F.when(p % 3 == 1, F.lit(float("inf"))).when(p % 3 == 2, real(p % 50) * 2), "stroke_px": F.when(p % 11 != 3, real((i * 5 + p) % 9) / 2), "column_px": real(p % 9) + 20,
            "look_x0": F.col("x0"), "em_regular": F.when(p % 17 == 2, real(F.col("n")) / 2), "em_narrow": F.when(p % 17 == 2, real(F.col("n")) / 3),
        }
    )
    return style.estimate(seen).select("page", "pos", *[F.round(c, 6).alias(c) for c in ("est_pt", "clamp_pt", "max_fit_pt", "stroke_rel")], "font_pt", "bold_r", "bold")


# ---------------------------------------------------------------- shapes


@query
def wipe_rows(spark, sf_dir):
    """Cover rectangles, in slide units, of the watermarks of ``watermark_split``."""
    marks = watermark_split(spark, sf_dir).withColumnRenamed("pos", "i")
    sized = marks.withColumns({"fill": F.lit(0), "img_w": F.lit(1728.0), "img_h": F.lit(972.0), "slide_h": F.lit(6858000)})
    return shapes.wipe_shapes(sized).drop("fill")


@query
def arc_cover_strips(spark, sf_dir):
    """Tangent strips of lines taken as arcs between their upper and lower edge."""
    arcs = read_lines(spark, sf_dir).select("page", F.col("pos").alias("block"), "x0", "x1", (F.col("y0") + 10).alias("y_mid"), (F.col("y1") + 10).alias("y_edge"), (F.col("y1") - F.col("y0")).alias("glyph_h"))
    out = shapes.arc_strips(arcs)
    return out.select("page", "block", "k", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h", "rotation")])


@query
def shape_rows(spark, sf_dir):
    """Text shapes and covers of single-line blocks; every ninth is turned."""
    lines = read_lines(spark, sf_dir)
    none = F.lit(None).cast("double")
    turned = F.col("pos") % 9 == 8
    blocks = lines.select(
        "page", F.col("pos").cast("int").alias("block"), "x0", "y0", "x1", "y1", "font_pt", F.lit("left").alias("align"), F.when(F.col("pos") % 5 != 4, F.col("bg_rgb")).alias("bg_rgb"),
        F.when(turned, 12.0).otherwise(0.0).alias("angle"), F.when(turned, (F.col("x0") + F.col("x1")) / 2).alias("cx"), F.when(turned, (F.col("y0") + F.col("y1")) / 2).alias("cy"),
        F.when(turned, F.col("x1") - F.col("x0")).alias("w"), F.when(turned, F.col("y1") - F.col("y0")).alias("h"), (F.col("y0") + 4).alias("ink_top_px"), (F.col("y1") - 4).alias("ink_bottom_px"),
        none.alias("cover_x0_px"), none.alias("cover_x1_px"), (F.col("pos") % 11 == 3).alias("highlight_removed"), F.lit(False).alias("vertical"), F.lit(1728.0).alias("img_w"), F.lit(972.0).alias("img_h"), F.lit(6858000).alias("slide_h"),
    )
    return shapes.text_shapes(blocks).select("page", "block", "z", "kind", "name", "left", "top", "width", "height", "rotation", F.col("fill.r").alias("fill_r"), "margin_top")


# ---------------------------------------------------------------- pages in sequence


def _for_passes(lines: DataFrame) -> DataFrame:
    rgb = lambda c: F.array(*[F.col(c)[k] for k in "rgb"])
    none = F.lit(None).cast("double")
    return lines.withColumns(
        {
            "max_fit_pt": none, "clamp_pt": F.when(F.col("pos") % 4 == 1, F.col("font_pt") + 1.0),
            "ink_top_px": none, "ink_bottom_px": none, "text_rgb": rgb("text_rgb"), "bg_rgb": F.when(F.col("pos") % 5 != 4, rgb("bg_rgb")),
        }
    )


@query
def junk_flood(spark, sf_dir):
    return passes.flood(_for_passes(_columns(read_lines(spark, sf_dir)).withColumn("font_pt", F.when(F.col("pos") % 3 == 0, 9.0).otherwise(F.col("font_pt")))))


def _laid(out: DataFrame) -> DataFrame:
    return out.drop("src", "angle", "arc", "ink_top_px", "ink_bottom_px")


@query
def ordered_passes(spark, sf_dir):
    return _laid(passes.run_passes(_for_passes(_columns(read_lines(spark, sf_dir)))))


@query
def merged_blocks(spark, sf_dir):
    from ..config import Options

    return _laid(passes.run_passes(_for_passes(_columns(read_lines(spark, sf_dir))), Options(merge_lines=True, keep_tiny_text=True)))


@query
def fuzzy_recall(spark, sf_dir):
    """Benchmark items found again among themselves, where every third has lost a letter throughout."""
    items = _table(spark, sf_dir, "benchmark").select((F.col("item_id") % 20).cast("int").alias("slide"), F.col("item_id").cast("int").alias("shape_idx"), "text")
    gen = items.withColumn("text", F.when(F.col("shape_idx") % 3 == 0, F.replace("text", F.lit("e"), F.lit(""))).otherwise(F.col("text")))
    return compare.recall(compare.matches(gen, items))
