"""Style of lines from the pixels of their page.

The pixels of a page are needed once: its lines travel with it as an array, an Arrow UDF
looks at each line, and the scalar rules after that (sizes, ceilings, weights) are column
expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions import geometry as G
from ..functions import text as X
from ..schema import RGB, RUN, SEGMENT
from . import pixels as P

MARK = re.compile(r"\[\^?\d+\]$")
UNDRAWABLE = re.compile("[^\x20-\x7e⺀-鿿＀-￯]")
MIN_CONTRAST = 75.0

_NUMBERS = (
    "ink_top_px", "ink_bottom_px", "ink_h_px", "ink_h_font_px", "ink_w_px", "column_px", "room_px", "stroke_px", "bold_r", "em_regular", "em_narrow", "cover_x0_px", "cover_x1_px",
    "look_x0", "glyph_iou",
)
_LOOK = T.StructType(
    [
        T.StructField("bg_rgb", RGB), T.StructField("text_rgb", RGB), *[T.StructField(c, T.DoubleType()) for c in _NUMBERS], T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("bg_segments", T.ArrayType(SEGMENT)), T.StructField("highlight_removed", T.BooleanType()), T.StructField("vertical", T.BooleanType()),
        T.StructField("strikethrough", T.BooleanType()), T.StructField("superscript_tail", T.IntegerType()), T.StructField("shifted", T.BooleanType()),
    ]
)
_RGB = pa.struct([("r", pa.int32()), ("g", pa.int32()), ("b", pa.int32())])
_ARROW = pa.struct(
    [
        ("bg_rgb", _RGB), ("text_rgb", _RGB), *[(c, pa.float64()) for c in _NUMBERS], ("runs", pa.list_(pa.struct([("n", pa.int32()), ("rgb", _RGB)]))),
        ("bg_segments", pa.list_(pa.struct([("x0", pa.float64()), ("x1", pa.float64()), ("rgb", _RGB)]))), ("highlight_removed", pa.bool_()), ("vertical", pa.bool_()),
        ("strikethrough", pa.bool_()), ("superscript_tail", pa.int32()), ("shifted", pa.bool_()),
    ]
)
#: What a line may have besides page, pos, text and its box.
OPTIONAL = {"score": "double", "angle": "double", "arc": "double", "cx": "double", "cy": "double", "w": "double", "h": "double", "char_boxes": "array<struct<ch:string,l:double,t:double,r:double,b:double>>"}


class FontMetrics(Protocol):
    """Faces that texts are measured and drawn with; None where a face is missing."""

    def width_em(self, text: str, narrow: bool) -> float | None: ...

    def draw(self, text: str, em: int, bold: bool) -> np.ndarray | None:
        """Grey image, dark on white."""


def _rgb(v) -> dict | None:
    return None if v is None else dict(zip("rgb", map(int, v), strict=True))


def is_vertical(text: str, box: tuple[float, float, float, float], flat: bool) -> bool:
    """Square wide characters stacked in a narrow box."""
    t = text.strip().replace(" ", "")
    w, h = box[2] - box[0], box[3] - box[1]
    return flat and len(t) >= 2 and all(ord(c) >= 0x2E80 for c in t) and w > 0 and h >= 1.5 * w and 0.55 <= h / len(t) / w <= 1.7


@dataclass
class View:
    """A line as it is looked at: whole pixels, turned upright, of an arc the flat middle."""

    text: str
    box: tuple[int, int, int, int]
    flat: bool
    part: np.ndarray
    ring: np.ndarray
    chars: list[tuple[float, float, float, float]]


def view(img: np.ndarray, line: dict) -> View:
    """``line`` has text, x0, y0, x1, y1 and the columns of ``OPTIONAL``."""
    x0, y0, x1, y1 = (round(line[k]) for k in ("x0", "y0", "x1", "y1"))
    arc, angle = line.get("arc") or 0.0, line.get("angle") or 0.0
    if arc:
        third, half = (x1 - x0) // 3, round(0.5 * (y1 - y0))
        x0, x1 = x0 + third, x1 - third
        y0, y1 = (y1 - half, y1) if arc < 0 else (y0, y0 + half)
    if angle and line.get("cx") is not None and line.get("w") is not None:
        outer = P.rectify(img, (line["cx"], line["cy"]), (line["w"], line["h"]), angle, P.RING_PX)
        part = outer[P.RING_PX : -P.RING_PX, P.RING_PX : -P.RING_PX]
    else:
        outer = P.crop(img, x0 - P.RING_PX, y0 - P.RING_PX, x1 + P.RING_PX, y1 + P.RING_PX)
        part = P.crop(img, x0, y0, x1, y1)
    chars = [(c["l"], c["t"], c["r"], c["b"]) for c in line.get("char_boxes") or ()]
    return View(line["text"] or "", (x0, y0, x1, y1), not arc and not angle, part, P.ring_of(outer), chars)


def look_at_column(v: View) -> dict:
    """A column of stacked characters: its width is that of a glyph, and all of the box is covered."""
    colour, share = P.dominant_colour(v.ring)
    ink = P.distance(v.part, colour) > P.INK
    cols = np.flatnonzero(ink.sum(axis=0) >= P.ROW_MIN)
    return {
        "vertical": True, "bg_rgb": _rgb(colour) if share >= P.RING_SHARE else None, "text_rgb": _rgb(P.core_colour(v.part, ink, colour) if ink.sum() >= 10 else (0, 0, 0)),
        "column_px": float(cols[-1] - cols[0] + 1) if len(cols) else float(v.box[2] - v.box[0]), "ink_top_px": float(v.box[1]), "ink_bottom_px": float(v.box[3]), "look_x0": float(v.box[0]),
    }


def plain_colour(part: np.ndarray, ink: np.ndarray, ref: np.ndarray) -> tuple[int, ...]:
    """Text colour of the strokes' cores; of the darkest tenth of the box where there is no ink."""
    if ink.sum() >= 10:
        return P.core_colour(part, ink, ref)
    px = part.reshape(-1, 3).astype(int)
    dark = px[(px @ np.array([0.299, 0.587, 0.114])).argsort()[: max(1, len(px) // 10)]]
    return tuple(int(c) for c in dark.mean(axis=0).round())


def raised_mark(v: View, ink: np.ndarray) -> int:
    """Characters of a footnote mark that ends the line and stands raised."""
    t = v.text.strip()
    mark, solid = MARK.search(t), t.replace(" ", "")
    n = len(mark.group()) if mark else 0
    if not v.flat or not 0 < n < len(solid) or len(v.chars) != len(solid):
        return 0
    return n if P.raised_tail(ink, int(v.chars[-n][0]) - v.box[0]) else 0


def runs_of(colours: list) -> list[tuple[int, tuple[int, ...]]] | None:
    """Colour runs (length, colour) of the characters of a line; None for one colour.

    A character without colour joins what is open; another colour than the run's first one opens a
    new run, and a run of one between two like ones belongs to them.
    """
    open_: list[list] = []
    for c in colours:
        if open_ and (c is None or open_[-1][1] is None or P.distance(np.array(c), np.array(open_[-1][1])) <= P.JOIN):
            open_[-1] = [open_[-1][0] + 1, open_[-1][1] or c]
        else:
            open_.append([1, c])
    out: list[list] = []
    for n, c in open_:
        if len(out) > 1 and out[-1][0] == 1 and c and out[-2][1] and P.distance(np.array(out[-2][1]), np.array(c)) <= P.JOIN:
            out[-2:] = [[out[-2][0] + 1 + n, out[-2][1]]]
        else:
            out.append([n, c])
    real = [c for _, c in out if c is not None]
    if len(out) < 2 or not real or np.ptp(np.array(real), axis=0).max() < P.SPLIT:
        return None
    return [(n, c or real[0]) for n, c in out]


def fills(img: np.ndarray, v: View, ref: np.ndarray, bg_rgb: tuple[int, ...] | None) -> dict:
    """Colour runs of the characters, and the fills under a line that needs several.

    Where the text changes its colour with the fill, the fills are told; where it doesn't, they are
    highlights, and the one nearest to what the line stands on covers it.
    """
    told = lambda runs: None if runs is None else [{"n": n, "rgb": _rgb(c)} for n, c in runs]
    of = lambda back: runs_of(P.char_colours(img, v.chars, back)) if v.chars and v.flat else None
    out = {"runs": told(of(ref)), "bg_segments": None, "highlight_removed": False, "bg_rgb": _rgb(bg_rgb)}
    parts = P.background_segments(v.part) if bg_rgb is not None and v.flat else None
    if parts is None:
        return out
    left = float(max(0, v.box[0]))
    spans = [(left + a, left + b, c) for a, b, c in parts[:-1]] + [(left + parts[-1][0], float(v.box[2]), parts[-1][2])]
    runs = of(lambda x: P.segment_fill(spans, x))
    if runs is None:
        base = min(parts, key=lambda s: float(P.distance(np.array(s[2]), ref)))[2]
        return out | {"highlight_removed": True, "bg_rgb": _rgb(base)}
    return out | {"runs": told(runs), "bg_segments": [{"x0": a, "x1": b, "rgb": _rgb(c)} for a, b, c in spans], "bg_rgb": _rgb(spans[-1][2])}


def look_at(img: np.ndarray, line: dict, metrics: FontMetrics | None = None) -> dict | None:
    """What the pixels of a page say about one line; None for a box outside of the page."""
    v = view(img, line)
    if not v.part.size:
        return None
    own = (line["x0"], line["y0"], line["x1"], line["y1"])
    alone = len(v.text.strip()) == 1 and metrics is not None
    seen = {
        "em_regular": metrics.width_em(v.text, False) if metrics else None, "em_narrow": metrics.width_em(v.text, True) if metrics else None,
        "shifted": P.has_baseline_shift(img, own, v.text), "glyph_iou": P.glyph_overlap(img, own, metrics.draw(v.text.strip(), 200, False)) if alone else None,
    }
    if is_vertical(v.text, own, v.flat):
        return seen | look_at_column(v)
    surface, ink = P.surface_of(v.part, v.ring)
    icon = P.leading_icon(ink, max(0, round(min(c[0] for c in v.chars)) - v.box[0]), min(ink.shape[1], round(max(c[2] for c in v.chars)) - v.box[0])) if len(v.chars) >= 2 and v.flat else None
    if icon is not None:
        ink[:, : max(0, icon - 1)] = False
    rows = P.glyph_rows(ink)
    body = np.zeros_like(ink)
    if len(rows):
        body[rows[0] : rows[-1] + 1] = ink[rows[0] : rows[-1] + 1]
    band = body[rows[0] : rows[-1] + 1] if len(rows) else ink
    colour = surface.text or plain_colour(v.part, ink, surface.ref)
    ref = surface.ref
    if not surface.fill and body.sum() >= 30:  # glyphs on a picture may still stand on one colour
        near = P.halo_colour(v.part, body)
        if near is not None and near[1] >= 0.65:
            surface = P.Surface(near[0], text=surface.text)
    if surface.fill and surface.text is None:  # the ring may lie on another band than the glyphs
        near = P.halo_colour(v.part, ink)
        if near is not None and near[1] >= P.RING_SHARE and P.distance(near[0], surface.ref) >= 20:
            surface = P.Surface(near[0])
    height = float(rows[-1] - rows[0] + 1) if len(rows) else float(v.box[3] - v.box[1])
    deep = any(c in C.DESCENDERS for c in v.text)
    mixed = any(ord(c) >= 0x2E80 for c in v.text) and (deep or any(c.isascii() and c.isalnum() for c in v.text))
    by_cjk = P.cjk_band_height(ink, v.text, 1 if deep else 2) if mixed and len(rows) and not line.get("arc") else None
    cols = np.flatnonzero(band.any(axis=0))
    room = None
    if surface.fill and len(rows):
        room = P.room_to_the_right(img, v.box[2], v.box[1] + int(rows[0]), v.box[1] + int(rows[-1]) + 1, height, surface.ref)
    weight = P.stroke_px(band) if len(rows) else None
    contrast = float(P.distance(np.array(colour), ref))
    judged = metrics is not None and weight is not None and surface.fill and not line.get("arc") and contrast >= MIN_CONTRAST
    vivid = max(colour) - min(colour) > 60
    ends = (None, None)
    if v.flat and len(rows) and v.text and not vivid:
        ends = P.vivid_edges(v.part[rows[0] : rows[-1] + 1], band)
        wordy = lambda c: c.isalnum() or ord(c) >= 0x2E80
        ends = (ends[0] if wordy(v.text[0]) else None, ends[1] if wordy(v.text[-1]) else None)
    start = ends[0] if ends[0] is not None else max(0, icon - 2) if icon is not None else None
    return seen | {
        "vertical": False, "text_rgb": _rgb(colour), "ink_top_px": float(v.box[1] + rows[0]) if len(rows) else float(v.box[1]), "ink_bottom_px": float(v.box[1] + rows[-1] + 1) if len(rows) else float(v.box[3]),
        "ink_h_px": height, "ink_h_font_px": min(height, by_cjk) if by_cjk else height, "ink_w_px": float(cols[-1] - cols[0] + 1) if len(cols) else None, "room_px": room,
        "stroke_px": weight[0] if weight else None, "bold_r": P.template_weight(metrics.draw, UNDRAWABLE.sub("", v.text).strip(), height, weight[0], contrast) if judged else None,
        "look_x0": float(v.box[0]), "cover_x0_px": None if start is None else float(v.box[0] + start), "cover_x1_px": None if ends[1] is None else float(v.box[0] + ends[1]),
        "strikethrough": v.flat and P.is_struck_through(ink, rows, v.text), "superscript_tail": raised_mark(v, ink) if len(rows) else 0,
    } | fills(img, v, ref, surface.bg_rgb)


def _looker(metrics: FontMetrics | None):
    @F.arrow_udf(T.ArrayType(_LOOK))
    def looks(rgb: pa.Array, w: pa.Array, h: pa.Array, lines: pa.Array) -> pa.Array:
        out = []
        for data, width, height, some in zip(rgb, w.to_pylist(), h.to_pylist(), lines, strict=True):
            raw = data.as_py()
            img = np.frombuffer(raw, np.uint8).reshape(height, width, 3) if raw else None
            out.append([None if img is None else look_at(img, line, metrics) for line in some.as_py() or ()])
        return pa.array(out, pa.list_(_ARROW))

    return looks


def measure(pages: DataFrame, lines: DataFrame, metrics: FontMetrics | None = None) -> DataFrame:
    """lines(page, pos, text, x0, y0, x1, y1, and what there is of ``OPTIONAL``) with what their page's
    pixels show. pages(page, rgb, img_w, img_h); lines of a page without pixels, and boxes outside of
    it, get nulls; columns of the lines that are measured are replaced."""
    lines = lines.drop(*[f.name for f in _LOOK.fields], "img_w", "img_h")
    columns = [F.col(c) for c in lines.columns if c != "page"]
    held = lines.groupBy("page").agg(F.collect_list(F.struct(*columns)).alias("ls")).join(pages.select("page", "rgb", "img_w", "img_h"), "page", "left")
    given = lambda e: [e[c].alias(c) for c in ("text", "x0", "y0", "x1", "y1")] + [(e[c] if c in lines.columns else F.lit(None)).cast(t).alias(c) for c, t in OPTIONAL.items()]
    asked = F.transform("ls", lambda e: F.struct(*given(e)))
    held = held.withColumn("ms", _looker(metrics)("rgb", "img_w", "img_h", asked)).select("page", "img_w", "img_h", F.inline(F.arrays_zip("ls", "ms")))
    return held.select("page", "img_w", "img_h", "ls.*", "ms.*")


def _zero(c: str, frame: DataFrame) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0)) if c in frame.columns else F.lit(0.0)


def estimate(measured: DataFrame, bold_mode: str = "auto") -> DataFrame:
    """Sizes and weights of measured lines: est_pt, font_pt, clamp_pt, max_fit_pt, stroke_rel, bold.

    The ink height gives the size. An arc must fit its chord; where an obstacle stands behind a line
    its room is a hard limit; where the background is unknown the width of the ink is a soft one; the
    slide's edge limits every flat line.
    """
    k = F.lit(float(C.SLIDE_PT)) / F.col("img_w")
    arc, angle = _zero("arc", measured) != 0, _zero("angle", measured) != 0
    flat, stacked = ~arc & ~angle, F.coalesce("vertical", F.lit(False))
    ratio = F.when(X.is_pure_latin("text"), X.latin_ink_ratio("text")).otherwise(C.CJK_INK)
    box_h = F.rint("y1") - F.rint("y0")
    tall = G.ink_height_to_pt(F.coalesce("ink_h_font_px", box_h), k, ratio)
    out = measured.withColumn("__pt", F.when(stacked, G.ink_height_to_pt(F.col("column_px"), k, F.lit(C.CJK_INK))).otherwise(tall))
    known = F.when(F.col("__pt") >= C.NARROW_PT, F.col("em_narrow")).otherwise(F.col("em_regular"))
    em = F.when(known > 0, known).otherwise(X.text_width_em("text"))
    out = out.withColumn("__em", F.when(~stacked & (em > 0), em))
    em, room, ink_w = F.col("__em"), F.col("room_px"), F.col("ink_w_px") * k
    wide = F.rint("x1") - F.rint("x0")
    obstacle = ~arc & ink_w.isNotNull() & room.isNotNull() & (room != float("inf"))
    clamp = F.when(obstacle, ((wide + room) * k - 3) / em)
    soft = F.when(arc, wide * k / em * 0.85).when(ink_w.isNotNull() & room.isNull(), ink_w / em * G.width_tolerance(em))
    edge = F.when(flat, (F.lit(float(C.SLIDE_PT)) - F.coalesce("look_x0", F.rint("x0")) * k - 3) / em)
    out = out.withColumns({"clamp_pt": clamp, "__soft": soft, "max_fit_pt": edge, "__ink": ink_w})
    out = out.withColumn("__limit", F.least("clamp_pt", "__soft", "max_fit_pt"))
    limit = F.when(F.col("__limit") != 0, F.col("__limit"))
    out = out.withColumn("est_pt", F.least("__pt", limit))
    out = out.withColumn("__size", F.when(limit.isNull(), G.nearest_on_ladder("est_pt")).otherwise(G.snap_font_size("est_pt", limit, 1.0)))
    out = out.withColumn("__size", _kept_from_cliff(F.col("__size")))
    out = out.withColumn("font_pt", F.when(flat & ~stacked, _footprint(F.col("__size"))).otherwise(F.col("__size")))
    rel = F.when(F.col("stroke_px").isNotNull() & F.lit(bold_mode == "auto"), F.col("stroke_px") / F.greatest(F.lit(1.0), "ink_h_px"))
    out = out.withColumn("stroke_rel", F.coalesce(rel, F.lit(0.0)))
    out = out.withColumn("bold_r", F.when((F.col("font_pt") >= C.TPL_COMPUTE_PT) & F.lit(bold_mode == "auto"), F.col("bold_r")))
    return out.withColumn("bold", _weight(bold_mode)).drop("__pt", "__em", "__soft", "__limit", "__ink", "__size")


def _kept_from_cliff(size: Column) -> Column:
    """Ladder steps are far apart: a size that exceeds a soft limit by little, and by no more than three
    points of width, stays where the fallback would lose a tenth."""
    best, soft = G.nearest_on_ladder("est_pt"), F.col("__soft")
    near = (best <= soft * 1.03) & ((best - soft) * F.col("__em") <= 3.0) & F.coalesce(best <= F.col("max_fit_pt"), F.lit(True))
    return F.when((best > size) & (size < best * 0.9) & near, best).otherwise(size)


def _footprint(size: Column) -> Column:
    """Long texts that would be drawn clearly wider than their ink take one step less, if that still
    covers nine tenths of it."""
    em, ink = F.col("__em"), F.col("__ink")
    over = size * em > ink * F.when(size >= C.NARROW_PT, 1.07).otherwise(1.13)
    less = F.array_max(F.filter(F.array(*[F.lit(float(s)) for s in C.FONT_LADDER]), lambda s: s < size))
    return F.when((em >= 10) & over & (less * em >= ink * 0.90), less).otherwise(size)


def _weight(mode: str) -> Column:
    if mode != "auto":
        return F.lit(mode == "always")
    rgb, bg = F.col("text_rgb"), F.col("bg_rgb")
    tint = F.greatest(*[rgb[c] for c in "rgb"]) - F.least(*[rgb[c] for c in "rgb"])
    dark = F.coalesce((tint > C.CHROMA_MAX) & (rgb["r"] + rgb["g"] + rgb["b"] < bg["r"] + bg["g"] + bg["b"]), F.lit(False))
    drawn = F.col("bold_r").isNotNull() & (F.col("font_pt") >= C.TPL_MIN_PT) & ~dark
    large = F.col("font_pt") >= C.AUTO_BOLD_PT
    measured = F.when(drawn, F.col("bold_r") >= C.BOLD_R).otherwise(F.col("stroke_rel") >= C.STROKE_BOLD)
    return F.when(F.coalesce("vertical", F.lit(False)), large).otherwise(large | measured)
