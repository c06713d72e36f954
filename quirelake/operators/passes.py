"""Order-dependent passes over the lines of one page.

These rules read what earlier steps of the same pass wrote, so a set formulation would give
other results. A page crosses into Python once and all its passes run there in sequence;
pages are independent groups. What boxes and colours alone decide about a pair of lines is
tested on arrays, for a block of lines against all others at a time, so a page of n lines takes
n * n of the cheapest operations and memory for ``CELLS`` pairs; rules run on the pairs left.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field, replace
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C

LADDER = tuple(float(s) for s in C.FONT_LADDER)
CELLS = 1 << 18
COLUMNS = (
    "page", "pos", "text", "x0", "y0", "x1", "y1", "score", "angle", "arc", "font_pt", "est_pt", "bold", "stroke_rel", "bold_r",
    "text_rgb", "bg_rgb", "max_fit_pt", "clamp_pt", "ink_top_px", "ink_bottom_px",
)
#: Columns that may be missing, which is as if they were null.
MAYBE = {
    "cx": "double", "cy": "double", "w": "double", "h": "double", "vertical": "boolean", "shifted": "boolean", "glyph_iou": "double",
    "bg_segments": "array<struct<x0:double,x1:double,rgb:struct<r:int,g:int,b:int>>>",
}
SCHEMA = (
    "page bigint, pos bigint, ord int, text string, x0 double, y0 double, x1 double, y1 double, score double, font_pt double, bold boolean,"
    " text_rgb array<int>, bg_rgb array<int>, block int, align string, src bigint, angle double, arc double, ink_top_px double, ink_bottom_px double"
)


CJK = re.compile("[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
WIDE = re.compile("[\u2e80-\U0010ffff]")


def wide(text: str) -> bool:
    """Whether any character is of full width."""
    return WIDE.search(text) is not None


def is_cjk(text: str) -> bool:
    """Whether any character is an ideograph."""
    return CJK.search(text) is not None


def em_width(text: str) -> float:
    full, space = len(WIDE.findall(text)), text.count(" ")
    return full * C.EM_WIDE + space * C.EM_SPACE + (len(text) - full - space) * C.EM_LATIN


def snap(pt: float) -> float:
    k = bisect_left(LADDER, pt)
    near = LADDER[max(0, k - 1) : k + 1] or LADDER[-1:]
    return min(near, key=lambda s: (abs(s - pt), s))


def step(pt: float) -> int | None:
    k = bisect_left(LADDER, pt)
    return k if k < len(LADDER) and LADDER[k] == pt else None


@dataclass
class Row:
    pos: int
    text: str
    x0: float
    y0: float
    x1: float
    y1: float
    score: float
    font_pt: float
    est_pt: float
    bold: bool
    stroke_rel: float
    bold_r: float | None
    text_rgb: tuple
    bg_rgb: tuple | None
    angle: float = 0.0
    arc: float = 0.0
    max_fit_pt: float | None = None
    clamp_pt: float | None = None
    ink_top_px: float | None = None
    ink_bottom_px: float | None = None
    cx: float | None = None
    cy: float | None = None
    bw: float | None = None
    bh: float | None = None
    vertical: bool = False
    shifted: bool = False
    glyph_iou: float | None = None
    segments: bool = False
    src: int | None = None  # the line whose style it has, where that is another one
    members: list[int] = field(default_factory=list)

    @property
    def h(self) -> float:
        return self.y1 - self.y0

    @property
    def w(self) -> float:
        return self.x1 - self.x0

    @property
    def flat(self) -> bool:
        return not self.angle and not self.arc

    @property
    def band(self) -> float:
        ink = (self.ink_bottom_px or 0) - (self.ink_top_px or 0)
        return ink if ink > 0 else self.h


def xov(a: Row, b: Row) -> float:
    return min(a.x1, b.x1) - max(a.x0, b.x0)


def yov(a: Row, b: Row) -> float:
    return min(a.y1, b.y1) - max(a.y0, b.y0)


def far(a: tuple, b: tuple) -> float:
    return max(abs(p - q) for p, q in zip(a, b, strict=True))


def same_fill(a: Row, b: Row, most: float) -> bool:
    if a.bg_rgb is None or b.bg_rgb is None:
        return a.bg_rgb is b.bg_rgb
    return far(a.bg_rgb, b.bg_rgb) <= most


def marginal(r: Row) -> bool:
    return r.bold and r.bold_r is not None and r.font_pt >= C.TPL_MIN_PT and r.bold_r < C.MARGINAL_R


def columns_of(rows: list[Row], *names: str) -> list[np.ndarray]:
    return [np.array([getattr(r, n) for r in rows], float) for n in names]


def pairs_where(rows: list[Row], test) -> list[tuple[int, int]]:
    """Pairs i <> j, in the order of i and then j, for which ``test(a, b)`` holds; a and b give boxes
    (x0, y0, x1, y1, w, h) as arrays that broadcast."""
    n = len(rows)
    boxes = dict(zip(("x0", "y0", "x1", "y1", "w", "h"), columns_of(rows, "x0", "y0", "x1", "y1", "w", "h"), strict=True))
    out = []
    step = max(1, CELLS // max(1, n))
    for k in range(0, n, step):
        a = {c: v[k : k + step, None] for c, v in boxes.items()}
        hit = test(a, boxes)
        i, j = np.nonzero(hit)
        some = i + k != j
        out += zip((i[some] + k).tolist(), j[some].tolist(), strict=True)
    return out


def over(a: dict, b: dict, axis: str) -> np.ndarray:
    return np.minimum(a[f"{axis}1"], b[f"{axis}1"]) - np.maximum(a[f"{axis}0"], b[f"{axis}0"])


def groups_by(n: int, links) -> list[list[int]]:
    """Groups of 0..n-1 joined by pairs, in order of their first member."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in links:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    out: dict[int, list[int]] = {}
    for i in range(n):
        out.setdefault(root(i), []).append(i)
    return list(out.values())


# ---------------------------------------------------------------- drops


def illegible(r: Row) -> bool:
    bare = r.text.replace(" ", "")
    cjk = len(CJK.findall(bare))
    if r.font_pt <= C.TINY_PT:
        chip = cjk == len(bare) and 2 <= len(bare) <= 4 and r.score >= C.TINY_CJK_KEEP
        return not chip and r.score < C.TINY_LATIN_KEEP
    blurred = r.font_pt <= C.SMALL_PT and r.score < C.SMALL_MIN_SCORE
    return blurred or (cjk == 0 and len(bare) <= 3 and r.score < C.GLYPH_MIN_SCORE)


def weak(r: Row) -> bool:
    bare = r.text.replace(" ", "")
    return r.font_pt <= C.TINY_PT or (r.font_pt <= 20 and len(bare) <= 2 and not is_cjk(bare))


def near(a: dict, b: dict) -> np.ndarray:
    """b meets a's box padded by two of a's heights."""
    pad = 2 * a["h"]
    return (b["x0"] < a["x1"] + pad) & (b["x1"] > a["x0"] - pad) & (b["y0"] < a["y1"] + pad) & (b["y1"] > a["y0"] - pad)


def stacked_alike(a: dict, b: dict) -> np.ndarray:
    tall = np.maximum(a["h"], b["h"])
    return (np.abs(a["h"] - b["h"]) <= 0.3 * tall) & (over(a, b, "x") >= 0.6 * np.minimum(a["w"], b["w"])) & (-over(a, b, "y") <= 0.8 * tall)


def crossing(a: Row, b: Row) -> bool:
    """Steeply turned lines without CJK text whose turned boxes meet: decoration."""
    if any(abs(r.angle) < C.DECOR_ANGLE or r.cx is None or r.bw is None or is_cjk(r.text) for r in (a, b)):
        return False
    t = np.radians(a.angle)
    dx, dy = b.cx - a.cx, b.cy - a.cy
    return abs(dx * np.cos(t) + dy * np.sin(t)) < (a.bw + b.bw) / 2 and abs(dy * np.cos(t) - dx * np.sin(t)) < (a.bh + b.bh) / 2


def junk(rows: list[Row]) -> set[int]:
    """Indices of rows that are illegible or cross each other turned, and of those that stand with them.

    A weak row by dropped ones, with no strong kept row by it, goes; so does a small row with a
    dropped twin. Both tests only become truer as rows go, so the outcome has no order.
    """
    out = {i for i, r in enumerate(rows) if illegible(r)}
    turned = [i for i, r in enumerate(rows) if abs(r.angle) >= C.DECOR_ANGLE]
    for k, i in enumerate(turned):
        for j in turned[k + 1 :]:
            if crossing(rows[i], rows[j]):
                out |= {i, j}
    frail = [weak(r) for r in rows]
    around: dict[int, list[int]] = {}
    mates: dict[int, list[int]] = {}
    for i, j in pairs_where(rows, near):
        if frail[i]:
            around.setdefault(i, []).append(j)
    for i, j in pairs_where(rows, stacked_alike):
        if rows[i].font_pt <= C.SMALL_PT and rows[i].font_pt == rows[j].font_pt:
            mates.setdefault(i, []).append(j)
    while True:
        flooded = {i for i, js in around.items() if i not in out and any(j in out for j in js) and all(j in out or frail[j] for j in js)}
        more = flooded | {i for i, js in mates.items() if i not in out and any(j in out for j in js)}
        if not more:
            return out
        out |= more


def unreproducible(rows: list[Row]) -> set[int]:
    """Indices of rows whose raster must stay; every row is judged against all."""

    def icon(i: int, r: Row) -> bool:
        t = r.text.strip()
        if len(t) != 1 or not (t.isascii() and t.isalpha()) or r.font_pt < 28:
            return False
        return all(j == i or yov(r, o) <= 0.3 * max(1.0, r.h) for j, o in enumerate(rows))

    def axis(r: Row) -> bool:
        return r.h > 2.5 * r.w and not r.vertical and r.flat and is_cjk(r.text)

    def misread(r: Row) -> bool:
        t = r.text.strip()
        return len(t) == 1 and is_cjk(t) and r.score < C.MISREAD_SCORE and r.glyph_iou is not None and r.glyph_iou < C.MISREAD_IOU

    return {i for i, r in enumerate(rows) if icon(i, r) or ("==" in r.text and "×" in r.text) or axis(r) or misread(r) or r.shifted}


# ---------------------------------------------------------------- titles


def same_title(a: Row, b: Row) -> bool:
    h = min(a.h, b.h)
    left, right = (a, b) if a.x0 <= b.x0 else (b, a)
    return (
        a.flat and b.flat and min(a.font_pt, b.font_pt) >= C.TITLE_PT and a.bold == b.bold and yov(a, b) >= 0.6 * h
        and right.x0 - left.x1 <= 0.8 * h and far(a.text_rgb, b.text_rgb) <= 45 and (a.bg_rgb is None) == (b.bg_rgb is None)
    )


def pangu(text: str) -> str:
    latin = lambda c: c.isascii() and c.isalnum()
    out = ""
    for c in text:
        if out and ((is_cjk(out[-1]) and latin(c)) or (latin(out[-1]) and is_cjk(c))):
            out += " "
        if not (c == " " and out.endswith(" ")):
            out += c
    return out


def merge_titles(rows: list[Row]) -> list[Row]:
    """Rows by their left edge, the fragments of a title made one row at the size of the fragment
    with most CJK text, then of the widest."""
    rows = sorted(rows, key=lambda r: r.x0)
    fold = str.maketrans(C.FOLD_FROM, C.FOLD_TO)
    out = []
    side = pairs_where(rows, lambda a, b: over(a, b, "y") >= 0.6 * np.minimum(a["h"], b["h"]))
    for group in groups_by(len(rows), ((i, j) for i, j in side if i < j and same_title(rows[i], rows[j]))):
        parts = [rows[i] for i in group]
        if len(parts) == 1:
            out.append(parts[0])
            continue
        text, end = parts[0].text, parts[0].x1
        for p in parts[1:]:
            again = p.text and text and p.x0 < end and p.text[0].translate(fold) == text[-1].translate(fold)
            text += p.text[1:] if again else p.text
            end = max(end, p.x1)
        best = max(parts, key=lambda p: (len(CJK.findall(p.text)), p.w))
        out.append(
            replace(
                best, pos=parts[0].pos, text=pangu(text).strip(), x0=parts[0].x0, y0=min(p.y0 for p in parts), x1=end, y1=max(p.y1 for p in parts),
                score=min(p.score for p in parts), angle=0.0, arc=0.0, members=[p.pos for p in parts], src=best.pos if best.src is None else best.src,
            )
        )
    return out


# ---------------------------------------------------------------- sizes


def level_stacks(rows: list[Row]) -> None:
    """Overlapping or adjacent rows of one card take the smaller size."""
    for i, j in pairs_where(rows, lambda a, b: over(a, b, "x") >= 0.4 * np.minimum(a["w"], b["w"])):
        a, b = rows[i], rows[j]
        if i > j or a.font_pt == b.font_pt or a.bold != b.bold or step(a.font_pt) is None or step(b.font_pt) is None:
            continue
        if far(a.text_rgb, b.text_rgb) > 45 or not same_fill(a, b, 30):
            continue
        h = min(a.h, b.h)
        beside = min(abs(a.y1 - b.y0), abs(b.y1 - a.y0)) <= 0.5 * h
        alike = min(a.band, b.band) > 0 and abs(a.band - b.band) <= 0.15 * max(a.band, b.band)
        small = a if a.font_pt < b.font_pt else b
        if yov(a, b) > 0.12 * h or (beside and alike and small.font_pt < snap(small.est_pt)):
            a.font_pt = b.font_pt = small.font_pt


def wrapped(a: Row, b: Row) -> bool:
    """b may continue a."""
    h, gap = min(a.h, b.h), b.y0 - a.y1
    if not (a.y0 <= b.y0 and -0.6 * h < gap < 0.45 * h) or xov(a, b) < 0.4 * min(a.w, b.w):
        return False
    if a.bold != b.bold:
        heavy = a if a.bold else b
        sized = heavy.bold_r is None and heavy.stroke_rel == 0 and heavy.font_pt >= C.AUTO_BOLD_PT
        if not (marginal(heavy) or sized):
            return False
    return same_fill(a, b, 25) and far(a.text_rgb, b.text_rgb) <= 45 and abs(a.est_pt - b.est_pt) <= 0.14 * max(a.est_pt, b.est_pt)


def unify_wraps(rows: list[Row]) -> None:
    some = [r for r in rows if r.flat and r.est_pt > 0]
    below = lambda a, b: (b["y0"] >= a["y0"]) & (b["y0"] - a["y1"] < 0.45 * np.minimum(a["h"], b["h"])) & (over(a, b, "x") >= 0.4 * np.minimum(a["w"], b["w"]))
    for group in groups_by(len(some), [(i, j) for i, j in pairs_where(some, below) if wrapped(some[i], some[j])]):
        g = [some[i] for i in group]
        if 0 < 2 * sum(r.bold for r in g) < len(g):
            for r in [r for r in g if marginal(r)]:
                r.bold = False
        sizes = sorted({r.font_pt for r in g})
        steps = [step(s) for s in sizes]
        if len(sizes) < 2 or None in steps or steps[-1] - steps[0] > len(sizes) - 1:
            continue
        count = {s: sum(r.font_pt == s for r in g) for s in sizes}
        lead = [s for s in sizes if count[s] == max(count.values())]
        goal = lead[0] if len(lead) == 1 else snap(median(r.est_pt for r in g))
        limits = [c for r in g for c in (r.max_fit_pt, r.clamp_pt) if c is not None]
        if limits and goal > min(limits):
            k = bisect_right(LADDER, min(limits))
            goal = LADDER[k - 1] if k else goal
        for r in g:
            r.font_pt = goal


def follow_cjk(rows: list[Row]) -> None:
    """Code lines take the size of the first smaller CJK line that they are stacked with."""
    for a in rows:
        t = a.text.strip()
        if not a.flat or wide(t) or not ("_" in t or "`" in t):
            continue
        for b in rows:
            h = min(a.h, b.h)
            if (
                b is not a and is_cjk(b.text) and b.font_pt < a.font_pt and abs(a.x0 - b.x0) <= 0.5 * h and -yov(a, b) <= 0.6 * h
                and same_fill(a, b, 25) and far(a.text_rgb, b.text_rgb) <= 45
            ):
                a.font_pt = b.font_pt
                break


def one_below(r: Row) -> float | None:
    """The natural size of a row that stands exactly one step below it."""
    now, natural = step(r.font_pt), snap(r.est_pt)
    return natural if r.est_pt > 0 and now is not None and step(natural) - now == 1 else None


def sync_twins(rows: list[Row]) -> None:
    """A bold row one step below its natural size takes its like along."""
    for a in rows:
        natural = one_below(a) if a.bold else None
        if natural is None:
            continue
        ea = em_width(a.text)
        for b in rows:
            if b is a or not b.bold or b.font_pt != natural or b.est_pt <= 0 or abs(a.est_pt - b.est_pt) > 0.1 * max(a.est_pt, b.est_pt):
                continue
            eb = em_width(b.text)
            if far(a.text_rgb, b.text_rgb) <= 45 and same_fill(a, b, 25) and not (ea and eb and not 0.6 <= ea / eb <= 1.6):
                b.font_pt = a.font_pt


def spread_clamp(rows: list[Row]) -> None:
    """A row held back by an obstacle takes its column along, in size and weight."""
    for a in rows:
        natural = one_below(a) if a.clamp_pt is not None and a.flat else None
        if natural is None:
            continue
        for b in rows:
            if b is a or not b.flat or b.est_pt <= 0 or b.font_pt != natural or snap(b.est_pt) != natural:
                continue
            if abs(a.x0 - b.x0) <= 0.5 * min(a.h, b.h) and far(a.text_rgb, b.text_rgb) <= 45 and same_fill(a, b, 25):
                b.font_pt, b.bold = a.font_pt, a.bold


# ---------------------------------------------------------------- weights


def remeasure(rows: list[Row]) -> None:
    for r in rows:
        if r.bold and r.font_pt < C.AUTO_BOLD_PT:
            tinted = max(r.text_rgb) - min(r.text_rgb) > C.CHROMA_MAX and r.bg_rgb is not None and sum(r.text_rgb) < sum(r.bg_rgb)
            if r.bold_r is not None and r.font_pt >= C.TPL_MIN_PT and not tinted:
                r.bold = r.bold_r >= C.BOLD_R
            else:
                r.bold = r.stroke_rel > 0 and r.stroke_rel >= C.STROKE_BOLD


def vote(rows: list[Row]) -> None:
    cohorts: dict[float, list[Row]] = {}
    for r in rows:
        if r.stroke_rel > 0 and r.font_pt < C.AUTO_BOLD_PT:
            cohorts.setdefault(r.font_pt, []).append(r)
    for g in cohorts.values():
        n, b = len(g), sum(r.bold for r in g)
        if n < 3:
            continue
        for r in g:
            judged = r.bold_r is not None and r.font_pt >= C.TPL_MIN_PT
            if b * 3 >= n * 2:
                r.bold = r.bold or (r.bold_r >= -0.05 if judged else r.stroke_rel >= 0.115)
            elif b * 5 <= n:
                thin = r.bold_r < C.MARGINAL_R if judged else not (r.bold_r is not None and r.bold_r >= 0.28) and r.stroke_rel <= 0.15
                r.bold = r.bold and not thin
            elif n <= 4 and b == 1:
                r.bold = r.bold and not marginal(r)


# ---------------------------------------------------------------- late passes


def bridge(rows: list[Row], dropped: list[Row]) -> None:
    """Rows above and below a dropped one, of one column, take the upper one's size and weight."""
    for d in dropped:
        w, h = max(1.0, d.w), max(1.0, d.h)
        column = [r for r in rows if r.flat and xov(r, d) >= 0.3 * w]
        upper = [r for r in column if r.y1 <= d.y0 + 0.3 * h]
        lower = [r for r in column if r.y1 > d.y0 + 0.3 * h and r.y0 >= d.y1 - 0.3 * h]
        if not upper or not lower:
            continue
        a, b = max(upper, key=lambda r: r.y1), min(lower, key=lambda r: r.y0)
        apart = a.est_pt > 0 and b.est_pt > 0 and abs(a.est_pt - b.est_pt) > 0.2 * max(a.est_pt, b.est_pt)
        if abs(a.x0 - b.x0) <= 0.6 * min(a.h, b.h) and same_fill(a, b, 25) and far(a.text_rgb, b.text_rgb) <= 45 and not apart:
            b.font_pt, b.bold = a.font_pt, a.bold


def clamp_to_neighbour(rows: list[Row], px_to_pt: float) -> None:
    """From left to right, a row's text must end before the next one in its row."""
    order = sorted(rows, key=lambda r: r.x0)
    for k, a in enumerate(order):
        if not a.flat:
            continue
        beside = [b for b in order[k + 1 :] if b.flat and b.x0 > a.x1 and yov(a, b) >= 0.5 * min(a.h, b.h)]
        em = em_width(a.text)
        if not beside or em <= 0:
            continue
        b = min(beside, key=lambda r: r.x0)
        room = (b.x0 - a.x0) * px_to_pt * 1.02
        fit = [s for s in LADDER if s * em <= room]
        if a.font_pt * em <= room or not fit:
            continue
        old, a.font_pt = a.font_pt, fit[-1]
        if b.font_pt == old and b.bold == a.bold and (b.x0 - a.x1) * px_to_pt < 0.5 * old and far(a.text_rgb, b.text_rgb) <= 45:
            b.font_pt = a.font_pt


def unify_chips(rows: list[Row]) -> None:
    some = [r for r in rows if r.flat and r.bg_rgb is not None and not r.segments]
    stacked = lambda a, b: (-over(a, b, "y") <= 0.6 * np.minimum(a["h"], b["h"])) & (over(a, b, "x") >= 0.5 * np.minimum(a["w"], b["w"]))
    alike = lambda a, b: far(a.text_rgb, b.text_rgb) <= 25 and far(a.bg_rgb, b.bg_rgb) <= 40
    for group in groups_by(len(some), [(i, j) for i, j in pairs_where(some, stacked) if i < j and alike(some[i], some[j])]):
        if len(group) > 1:
            mid = tuple(int(median(some[i].bg_rgb[c] for i in group)) for c in range(3))
            for i in group:
                some[i].bg_rgb = mid


# ---------------------------------------------------------------- blocks


def belongs(a: Row, b: Row) -> bool:
    """b continues a; there is no lower bound on the gap, so a box far above does too."""
    h = min(a.h, b.h)
    if a.angle or b.angle or not 0.75 <= b.h / max(a.h, 1e-6) <= 1.33 or b.y0 - a.y1 >= 0.7 * h or xov(a, b) < 0:
        return False
    return abs(a.x0 - b.x0) < h or abs((a.x0 + a.x1) - (b.x0 + b.x1)) / 2 < h


def blocks(rows: list[Row], merge: bool) -> list[list[Row]]:
    if not merge:
        return [[r] for r in rows]
    out: list[list[Row]] = []
    for r in rows:
        for g in out:
            if belongs(g[-1], r) and g[-1].font_pt == r.font_pt:
                g.append(r)
                break
        else:
            out.append([r])
    return out


def align(rows: list[Row]) -> str:
    if len(rows) < 2:
        return "left"

    def spread(xs: list[float]) -> float:
        mean = sum(xs) / len(xs)
        return round(sum((x - mean) ** 2 for x in xs) / len(xs), 6)

    edges = {"left": [r.x0 for r in rows], "center": [(r.x0 + r.x1) / 2 for r in rows], "right": [r.x1 for r in rows]}
    return min(edges, key=lambda k: spread(edges[k]))


def process(rows: list[Row], options: C.Options, px_to_pt: float) -> list[list[Row]]:
    """All passes of one page, in their order; sizes come before the votes that they define."""
    lost = unreproducible(rows)
    kept = [r for i, r in enumerate(rows) if i not in lost]
    if not options.keep_tiny_text:
        gone = junk(kept)
        kept = [r for i, r in enumerate(kept) if i not in gone]
    left = {id(r) for r in kept}
    dropped = [r for r in rows if id(r) not in left]
    kept = merge_titles(kept)
    for f in (level_stacks, unify_wraps, follow_cjk, sync_twins, spread_clamp):
        f(kept)
    if options.bold_mode == "auto":
        remeasure(kept)
        vote(kept)
    bridge(kept, dropped)
    clamp_to_neighbour(kept, px_to_pt)
    unify_chips(kept)
    return blocks(kept, options.merge_lines)


def rows_of(page: pd.DataFrame) -> list[Row]:
    null = lambda v: None if v is None or v != v else float(v)
    rgb = lambda v: None if v is None else tuple(int(x) for x in v)
    out = []
    for r in page.sort_values("pos").to_dict("records"):
        own = {k: null(r[c]) for k, c in (("cx", "cx"), ("cy", "cy"), ("bw", "w"), ("bh", "h"), ("glyph_iou", "glyph_iou"))}
        segments = r["bg_segments"] is not None and len(r["bg_segments"]) > 1
        out.append(
            Row(
                int(r["pos"]), r["text"] or "", r["x0"], r["y0"], r["x1"], r["y1"], r["score"], r["font_pt"], r["est_pt"], bool(r["bold"]), r["stroke_rel"], null(r["bold_r"]),
                rgb(r["text_rgb"]) or (0, 0, 0), rgb(r["bg_rgb"]), null(r["angle"]) or 0.0, null(r["arc"]) or 0.0, null(r["max_fit_pt"]), null(r["clamp_pt"]), null(r["ink_top_px"]), null(r["ink_bottom_px"]),
                **own, vertical=r["vertical"] is True, shifted=r["shifted"] is True, segments=segments,
            )
        )
    return out


def whole(lines: DataFrame) -> DataFrame:
    """The columns that the passes read, with nulls for what is missing."""
    return lines.select(*COLUMNS, *[(F.col(c) if c in lines.columns else F.lit(None)).cast(t).alias(c) for c, t in MAYBE.items()])


def told(page: int, r: Row, ord_: int, block: int, side: str) -> tuple:
    """A row of ``SCHEMA``."""
    return (
        page, r.pos, ord_, r.text, r.x0, r.y0, r.x1, r.y1, r.score, r.font_pt, r.bold, list(r.text_rgb), None if r.bg_rgb is None else list(r.bg_rgb), block, side,
        r.pos if r.src is None else r.src, r.angle, r.arc, r.ink_top_px, r.ink_bottom_px,
    )


def run_passes(lines: DataFrame, options: C.Options | None = None, px_to_pt: float = 0.5) -> DataFrame:
    """Lines after all passes, with the block each belongs to and its alignment.

    lines has the columns of ``COLUMNS`` and what there is of ``MAYBE``, colours as arrays of three. A
    page of no lines gives none.
    """
    options = options or C.Options()

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, g in enumerate(process(rows_of(pdf), options, px_to_pt)):
            side = align(g)
            out += [told(int(pdf["page"].iloc[0]), r, len(out) + i, k, side) for i, r in enumerate(g)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return whole(lines).groupBy("page").applyInPandas(page, SCHEMA)


def flood(lines: DataFrame) -> DataFrame:
    """(page, pos, dropped) by ``junk``."""

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = rows_of(pdf)
        gone = junk(rows)
        return pd.DataFrame({"page": int(pdf["page"].iloc[0]), "pos": [r.pos for r in rows], "dropped": [i in gone for i in range(len(rows))]})

    return whole(lines).groupBy("page").applyInPandas(page, "page bigint, pos bigint, dropped boolean")
