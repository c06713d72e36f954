"""From documents to decks: the whole conversion as one plan of DataFrames.

Pages are rendered and recognised by providers; lines get a style from pixels, watermarks
become wipes, a page's passes run once with its image at hand, and what is left is lowered to
shapes and written, one file a deck.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from types import FunctionType

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config as C
from ..functions import geometry as G
from ..operators import pages as P
from ..operators import passes, pixels, repair, style
from ..sources import pptx, providers, sinks
from ..sources.staging import staging
from . import shapes

_LAID = (
    "page bigint, kind string, block int, k int, pos bigint, src bigint, text string, x0 double, y0 double, x1 double, y1 double, cx double, cy double, w double, h double, angle double,"
    " font_pt double, bold boolean, align string, ink_top_px double, ink_bottom_px double, text_rgb array<int>, bg_rgb array<int>"
)
_NAMES = [c.strip().split()[0] for c in _LAID.split(", ")]


@dataclass(frozen=True)
class Providers:
    """What a conversion needs from outside; None where it is missing. ``ocr`` and ``reader`` may be
    functions of lang, fast and device instead, which are called once in each worker."""

    renderer: providers.PageRenderer | None = None
    ocr: providers.OcrProvider | None = None
    reader: object | None = None
    metrics: style.FontMetrics | None = None
    to_traditional: Callable[[str], str] | None = None
    to_simplified: Callable[[str], str] | None = None


def engine(given, options: C.Options):
    """A recogniser as it is, or made by its function for the options of a run."""
    if given is None or not isinstance(given, FunctionType | type):
        return given
    return providers.Lazy(given, lang=options.lang, fast=options.fast, device=providers.resolve_device(options.device))


def selected(spec: str | None, count: int) -> list[int] | None:
    """Zero-based pages of a list such as '1-5,8' in its order, each once; None for all."""
    if spec is None:
        return None
    ends = [[int(n) for n in part.split("-", 1)] for part in spec.split(",")]
    out = [n - 1 for e in ends for n in range(e[0], min(e[-1], count) + 1) if n >= 1]
    if not out:
        raise ValueError("no pages selected")
    return list(dict.fromkeys(out))


# ---------------------------------------------------------------- stages


def styled_lines(pages: DataFrame, lines: DataFrame, options: C.Options, metrics: style.FontMetrics | None = None) -> DataFrame:
    """Lines with all fields of a style."""
    return style.estimate(style.measure(pages, lines, metrics), options.bold_mode)


def split_watermarks(lines: DataFrame, options: C.Options) -> tuple[DataFrame, DataFrame]:
    """Lines that stay, and boxes (page, i, x0..y1, fill) that are painted over."""
    mark = P.is_watermark(options.watermark_suffix, F.col("img_w"), F.col("img_h"))
    mark = F.lit(False) if options.keep_watermark else F.coalesce(mark, F.lit(False))
    wipe = lines.where(mark).select("page", F.col("pos").alias("i"), G.watermark_box(F.col("y1") - F.col("y0")).alias("b"), F.col("bg_rgb").alias("fill")).select("page", "i", "b.*", "fill")
    return lines.where(~mark), wipe


def _tell(page: int, r: passes.Row, kind: str, block: int, k: int, side: str, **other) -> dict:
    own = {"x0": r.x0, "y0": r.y0, "x1": r.x1, "y1": r.y1, "cx": r.cx, "cy": r.cy, "w": r.bw, "h": r.bh, "angle": r.angle, "font_pt": r.font_pt, "bold": r.bold, "text": r.text}
    rgb = {"text_rgb": list(r.text_rgb), "bg_rgb": None if r.bg_rgb is None else list(r.bg_rgb)}
    ink = {"ink_top_px": r.ink_top_px, "ink_bottom_px": r.ink_bottom_px}
    return {"page": page, "kind": kind, "block": block, "k": k, "pos": r.pos, "src": r.pos if r.src is None else r.src, "align": side} | own | rgb | ink | other


def arc_rows(page: int, r: passes.Row, block: int, px_per_pt: float, img: np.ndarray | None) -> list[dict]:
    """Cover strips and text chords along the parabola of an arc line."""
    box = (r.x0, r.y0, r.x1, r.y1)
    glyph, mid, edge = pixels.arc_geometry(box, r.arc > 0, r.font_pt, px_per_pt, img, r.text_rgb)
    out, half, bend = [], (r.x1 - r.x0) / 2, edge - mid
    if r.bg_rgb is not None:
        fill = r.bg_rgb if img is None else pixels.ribbon_fill(pixels.crop(img, *box), r.bg_rgb)
        n, high = shapes.ARC_STRIPS, 1.5 * glyph
        for k in range(n):
            t = (k + 0.5) / n * 2 - 1
            at, y, slope = r.x0 + half * (t + 1), mid + bend * t * t, 2 * bend * t / half
            top, bottom = y - high / 2, y + high / 2
            if img is not None:
                top, bottom = pixels.ribbon_limits(img, at - half / n, at + half / n, y, slope, top, bottom, fill, glyph)
            # strips turn about their middles: wider by the wedge that would open between two
            wide = 2 * half / n * min(2.0, float(np.hypot(1, slope))) * 1.04 + high * abs(2 * bend / half) * (2 * half / n) / half
            out.append(_tell(page, r, "strip", block, k, "left", cx=at, cy=(top + bottom) / 2, w=wide, h=bottom - top, angle=float(np.degrees(np.arctan(slope))), bg_rgb=list(fill), text=None))
    for k, s in enumerate(repair.arc_segments(r, mid, edge, glyph, px_per_pt)):
        out.append(_tell(page, r, "chord", block, k, "center", cx=s["cx"], cy=s["cy"], w=s["width_pt"] * px_per_pt, h=glyph, angle=s["rotation"], text=s["text"], bg_rgb=None))
    return out


def lay_out_page(page: int, rows: list[passes.Row], options: C.Options, px_to_pt: float, img: np.ndarray | None) -> list[dict]:
    """All passes of a page, its blocks trimmed by its image, and its arcs in pieces."""
    out, blocks = [], passes.process(rows, options, px_to_pt)
    boxes = []
    for g in blocks:
        first = g[0]
        hull = {"x0": min(r.x0 for r in g), "y0": min(r.y0 for r in g), "x1": max(r.x1 for r in g), "y1": max(r.y1 for r in g)}
        boxes.append(passes.replace(first, **hull))
    if img is not None:
        repair.trim_rows(boxes, img)
        repair.trim_stacks(boxes, img)
    for k, (g, box) in enumerate(zip(blocks, boxes, strict=True)):
        side = passes.align(g)
        if box.arc:
            out += arc_rows(page, box, k, 1 / px_to_pt, img)
            continue
        out.append(_tell(page, box, "block", k, 0, side))
        out += [_tell(page, r, "line", k, i, side) for i, r in enumerate(g)]
    return out


def lay_out(pages: DataFrame, lines: DataFrame, options: C.Options) -> DataFrame:
    """Blocks, their lines, and the strips and chords of arcs, of styled lines; a page is one group,
    its lines beside its image."""
    rgb = lambda c: F.when(F.col(c).isNotNull(), F.array(*[F.col(c)[k] for k in "rgb"])).alias(c)
    held = passes.whole(lines.withColumns({"text_rgb": rgb("text_rgb"), "bg_rgb": rgb("bg_rgb")}))

    def page(key: tuple, some: pd.DataFrame, image: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(some) and len(image):
            p = image.iloc[0]
            img = None if p["rgb"] is None else np.frombuffer(p["rgb"], np.uint8).reshape(int(p["img_h"]), int(p["img_w"]), 3)
            out = lay_out_page(int(key[0]), passes.rows_of(some), options, C.SLIDE_PT / float(p["img_w"]), img)
        return pd.DataFrame(out, columns=_NAMES)

    images = pages.select("page", "rgb", "img_w", "img_h")
    return held.groupBy("page").cogroup(images.groupBy("page")).applyInPandas(page, _LAID)


def _rgb_struct(c: str):
    return F.when(F.col(c).isNotNull(), F.struct(*[F.col(c)[i].alias(k) for i, k in enumerate("rgb")]))


def slide_shapes(pages: DataFrame, laid: DataFrame, lines: DataFrame, wipes: DataFrame, options: C.Options) -> DataFrame:
    """Shapes of all slides: page, z1, z2, z3 (painting order), shape (struct with its runs)."""
    size = pages.select("page", "img_w", "img_h", "slide_h")
    sheet = laid.join(size, "page").withColumns({"bg_rgb": _rgb_struct("bg_rgb"), "text_rgb": _rgb_struct("text_rgb")})
    extra = lines.select("page", F.col("pos").alias("src"), "cover_x0_px", "cover_x1_px", "highlight_removed", "vertical", "strikethrough", "superscript_tail", "runs", "bg_segments")
    blocks = sheet.where("kind = 'block'").join(extra, ["page", "src"])
    banner = F.coalesce(F.size("bg_segments"), F.lit(0)) >= 2
    boxes = shapes.text_shapes(blocks.withColumn("bg_rgb", F.when(~banner, F.col("bg_rgb"))), options.cover)
    empty = F.array().cast("array<struct<para:int,text:string,rgb:struct<r:int,g:int,b:int>,raised:boolean,size_pt:double,font_pt:double,bold:boolean,strike:boolean>>")
    blank = {"rotation": F.lit(0.0), "margin_top": F.lit(0).cast("long"), "vertical": F.lit(False), "wrap": F.lit(False), "align": F.lit("left"), "runs": empty}

    # the runs of a block: its lines are paragraphs
    said = sheet.where("kind = 'line'").join(extra, ["page", "src"])
    whole = F.col("pos") == F.col("src")  # a merged title has no runs of its own
    said = said.withColumns({"runs": F.when(whole, F.col("runs")), "superscript_tail": F.when(whole, F.col("superscript_tail"))})
    said = said.withColumns({"line_no": F.col("k"), "bold_": F.col("bold"), "strike_": F.col("strikethrough"), "pt_": F.col("font_pt")})
    pieces = shapes.run_pieces(said.withColumn("block", F.struct("block", "line_no", "bold_", "strike_", "pt_"))).select("page", "block.*", "k", "text", "rgb", "raised", "size_pt")
    piece = F.struct("line_no", "k", "text", "rgb", "raised", "size_pt", F.col("pt_").alias("font_pt"), F.col("bold_").alias("bold"), F.col("strike_").alias("strike"))
    runs = pieces.groupBy("page", "block").agg(F.array_sort(F.collect_list(piece)).alias("runs"))
    told = F.transform("runs", lambda r: F.struct(r["line_no"].cast("int").alias("para"), r["text"].alias("text"), r["rgb"].alias("rgb"), r["raised"].alias("raised"), r["size_pt"].alias("size_pt"), r["font_pt"].alias("font_pt"), r["bold"].alias("bold"), r["strike"].alias("strike")))
    boxes = boxes.join(runs.select("page", "block", told.alias("runs")), ["page", "block"], "left")
    boxes = boxes.withColumn("runs", F.when(F.col("kind") == "text", F.coalesce("runs", empty)).otherwise(empty))
    multi = said.groupBy("page", "block").agg((F.count(F.lit(1)) > 1).alias("many"))
    boxes = boxes.join(multi, ["page", "block"], "left").withColumn("wrap", F.coalesce("many", F.lit(False)))

    ex, ey = (lambda c: shapes._emu(c, F.lit(C.SLIDE_EMU), F.col("img_w"))), (lambda c: shapes._emu(c, F.col("slide_h"), F.col("img_h")))
    zero = F.lit(0).cast("long")
    turned = sheet.where("kind IN ('strip', 'chord')").withColumns({"width": ex(F.col("w")), "height": ey(F.col("h"))})
    if not options.cover:
        turned = turned.where("kind = 'chord'")
    chord = F.col("kind") == "chord"
    run = F.struct(F.lit(0).alias("para"), "text", F.col("text_rgb").alias("rgb"), F.lit(False).alias("raised"), F.col("font_pt").alias("size_pt"), "font_pt", "bold", F.lit(False).alias("strike"))
    turned = turned.withColumns(blank | {"left": F.greatest(zero, ex(F.col("cx")) - F.floor(F.col("width") / 2)), "top": F.greatest(zero, ey(F.col("cy")) - F.floor(F.col("height") / 2)), "rotation": F.col("angle"), "fill": F.col("bg_rgb")})
    turned = turned.withColumns({"name": F.concat(F.lit("Text "), F.col("block").cast("string"), F.when(chord, ".").otherwise(" cover "), F.col("k").cast("string")), "runs": F.when(chord, F.array(run)).otherwise(empty), "align": F.when(chord, "center").otherwise("left")})

    covers = shapes.banner_covers(blocks.where(F.lit(options.cover))).join(blocks.select("page", "block", "ink_top_px", "ink_bottom_px", "y0", "y1", "img_w", "img_h", "slide_h"), ["page", "block"])
    top, foot = F.coalesce("ink_top_px", "y0") - 4, F.coalesce("ink_bottom_px", "y1") + 4
    covers = covers.withColumns(blank | {"name": F.concat(F.lit("Text "), F.col("block").cast("string"), F.lit(" band "), F.col("z").cast("string")), "top": F.greatest(zero, ey(top)), "width": F.col("right") - F.col("left"), "height": ey(foot) - ey(top)})
    covers = covers.withColumn("left", F.greatest(zero, "left"))
    wiped = shapes.wipe_shapes(wipes.join(size, "page")).withColumns(blank | {"name": F.concat(F.lit("Wipe "), F.col("i").cast("string"))})

    fields = ("name", "left", "top", "width", "height", "rotation", "fill", "margin_top", "vertical", "wrap", "align", "runs")
    told = lambda frame, z1, z2, z3: frame.select("page", F.lit(z1).alias("z1"), z2.cast("long").alias("z2"), z3.cast("long").alias("z3"), F.struct(*fields).alias("shape"))
    arcs = turned.withColumn("z1", F.when(chord, 2).otherwise(1))
    arcs = arcs.select("page", "z1", F.col("block").cast("long").alias("z2"), F.col("k").cast("long").alias("z3"), F.struct(*fields).alias("shape"))
    return told(wiped, 0, F.col("i"), F.lit(0)).unionByName(arcs).unionByName(told(covers, 2, F.col("block"), F.col("z") - 100)).unionByName(told(boxes, 2, F.col("block"), F.col("z")))


def statistics(pages: DataFrame, styled: DataFrame, laid: DataFrame, wipes: DataFrame) -> DataFrame:
    """By page: lines, shapes, lines left in the picture, watermarks wiped."""
    count = lambda frame, name: frame.groupBy("page").agg(F.count(F.lit(1)).alias(name))
    kept = laid.where("kind IN ('line') OR (kind = 'chord' AND k = 0)")
    out = pages.select("deck_id", "page_no", "page")
    parts = (count(styled, "n_all"), count(kept, "n_lines"), count(laid.where("kind = 'block' OR (kind = 'chord' AND k = 0)"), "n_shapes"), count(wipes, "n_wiped"))
    for part in parts:
        out = out.join(part, "page", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    left = F.greatest(F.lit(0), none("n_all") - none("n_lines") - none("n_wiped"))
    return out.select("deck_id", "page_no", none("n_lines").alias("n_lines"), none("n_shapes").alias("n_shapes"), left.alias("left_as_image"), none("n_wiped").alias("n_wiped"))


# ---------------------------------------------------------------- driver


Keep = Callable[[DataFrame, str], DataFrame]


def convert_pages(pages: DataFrame, options: C.Options, given: Providers, lines: DataFrame | None = None, keep: Keep = lambda df, name: df) -> dict[str, DataFrame]:
    """All relations of a conversion by name: lines, styled, laid, shapes, decks, statistics.

    ``keep`` may write a relation that later ones read several times; pixels are looked at twice, by
    the styles and by the passes of a page.

    pages has page, deck_id, page_no, img_w, img_h, page_w_pt, page_h_pt, rgb and png; ``lines`` are
    recognised from it unless they are given. A deck's slides have the size of its first page.
    """
    converters = (given.to_traditional, given.to_simplified) if options.s2t else (None, None)
    if lines is None:
        lines = providers.recognise(pages, engine(given.ocr, options), options.min_score, engine(given.reader, options), *converters)
        lines = keep(lines, "lines")
    first = pages.groupBy("deck_id").agg(F.min_by(F.struct("page_w_pt", "page_h_pt"), "page_no").alias("f"))
    pages = pages.join(first, "deck_id").withColumn("slide_h", shapes.slide_height(F.col("f.page_w_pt"), F.col("f.page_h_pt")))
    styled = keep(styled_lines(pages, lines, options, given.metrics), "styled")
    kept, wipes = split_watermarks(styled, options)
    laid = keep(lay_out(pages, kept, options), "laid")
    out = slide_shapes(pages, laid, kept, wipes, options)
    order = F.row_number().over(Window.partitionBy("page").orderBy("z1", "z2", "z3"))
    sheets = pages.select("deck_id", F.col("page_no").alias("no"), "page", "slide_h", "png").join(out.withColumn("z", order), "page", "left")
    # the picture of a page travels with its first shape alone
    sheets = sheets.select("deck_id", F.col("no").alias("page"), F.coalesce("z", F.lit(0)).alias("z"), "slide_h", F.when(F.coalesce("z", F.lit(1)) == 1, F.col("png")).alias("png"), "shape")
    return {"lines": lines, "styled": styled, "laid": laid, "shapes": out, "decks": pptx.build_decks(sheets, options.font), "statistics": statistics(pages, styled, laid, wipes)}


def convert(spark: SparkSession, source: str, target: str, options: C.Options | None = None, given: Providers | None = None, page_count: int = 10_000) -> DataFrame:
    """Convert the documents under ``source`` to presentation files under ``target``.

    Returns ``statistics``, a row a page, from a table that stands beside the files. Pages are rendered, recognised and measured once:
    each stage is a written table, which lost executors don't replay. With ``debug`` the dumps of all
    decks stand beside them, in a folder of their own.
    """
    options, given = options or C.Options(), given or Providers()
    with staging(spark, target) as keep:
        pages = keep(providers.render_pages(spark, source, given.renderer, options.dpi, selected(options.pages, page_count)), "pages")
        made = convert_pages(pages, options, given, keep=keep)
        pptx.write_decks(made["decks"], target)
        if options.debug:
            dump = made["styled"].join(pages.select("page", "deck_id", F.col("page_no").alias("no")), "page").drop("page")
            sinks.write_debug_json(dump.withColumn("page", F.col("no") + 1), f"{target.rstrip('/')}-debug")
        counts = f"{target.rstrip('/')}-statistics"
        made["statistics"].write.mode("overwrite").parquet(counts)
    return spark.read.parquet(counts)
