"""Each page pass against a plain restatement of its rule: loops over all pairs, one rule at a time."""

import copy
import random
import statistics

import pytest

from quirelake import config as C
from quirelake.config import Options
from quirelake.operators import passes

SIZES = [float(s) for s in C.FONT_LADDER]


def make(rng, n=14):
    rows = []
    texts = ["標題", "：內文", "a_b", "abc def", "資訊架構", "Q", "x==y×", "一行很長的文字內容", ":tail", "`code`"]
    for k in range(n):
        x, y = rng.choice([0, 10, 40, 120, 200]), rng.choice([0, 6, 20, 30, 44, 60, 90])
        h = rng.choice([16, 20, 24, 30])
        pt = rng.choice([9.0, 14.0, 16.0, 18.0, 20.0, 24.0, 28.0, 32.0])
        shade = rng.choice([0, 20, 40, 90])
        fill = rng.choice([None, 200, 215, 250])
        rows.append(
            passes.Row(
                k, rng.choice(texts), float(x), float(y), float(x + rng.choice([30, 60, 100, 150])), float(y + h), rng.choice([0.7, 0.8, 0.95]), pt, pt + rng.choice([-1.5, -0.4, 0.0, 0.6, 1.7, 3.0]), rng.random() < 0.4,
                rng.choice([0.0, 0.1, 0.12, 0.14, 0.16]), rng.choice([None, -0.1, 0.1, 0.2, 0.3]), (shade, shade // 2, 0), None if fill is None else (fill, fill, fill),
                angle=rng.choice([0.0, 0.0, 0.0, 0.0, 20.0]), arc=rng.choice([0.0, 0.0, 0.0, 0.0, 0.0, 16.0]), max_fit_pt=rng.choice([None, 15.0, 23.0]), clamp_pt=rng.choice([None, None, 17.0]),
                ink_top_px=rng.choice([None, y + 3.0]), ink_bottom_px=rng.choice([None, y + h - 3.0]), cx=x + 50.0, cy=y + h / 2.0, bw=100.0, bh=float(h), vertical=rng.random() < 0.1, segments=rng.random() < 0.1,
            )
        )
    return rows


def xo(a, b):
    return min(a.x1, b.x1) - max(a.x0, b.x0)


def yo(a, b):
    return min(a.y1, b.y1) - max(a.y0, b.y0)


def apart(p, q):
    return max(abs(i - j) for i, j in zip(p, q))


def fills(a, b, most):
    if (a.bg_rgb is None) != (b.bg_rgb is None):
        return False
    return a.bg_rgb is None or apart(a.bg_rgb, b.bg_rgb) <= most


def wide_letters(t):
    return [c for c in t if 0x3400 <= ord(c) <= 0x4DBF or 0x4E00 <= ord(c) <= 0x9FFF or 0xF900 <= ord(c) <= 0xFAFF]


def em(t):
    return sum(1.0 if ord(c) >= 0x2E80 else 0.33 if c == " " else 0.52 for c in t)


def nearest(pt):
    best = SIZES[0]
    for s in SIZES:
        if abs(s - pt) < abs(best - pt):
            best = s
    return best


def plain(r):
    return r.angle == 0 and r.arc == 0


def components(n, linked):
    label = list(range(n))
    moved = True
    while moved:
        moved = False
        for i in range(n):
            for j in range(n):
                if i != j and (linked(i, j) or linked(j, i)) and label[i] != label[j]:
                    low = min(label[i], label[j])
                    moved = True
                    label[i] = label[j] = low
    return [[i for i in range(n) if label[i] == k] for k in sorted(set(label))]


def stacks(rows):
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            a, b = rows[i], rows[j]
            h = min(a.h, b.h)
            if a.font_pt == b.font_pt or a.bold != b.bold or xo(a, b) < 0.4 * min(a.w, b.w) or apart(a.text_rgb, b.text_rgb) > 45 or not fills(a, b, 30):
                continue
            small = min((a, b), key=lambda r: r.font_pt)
            ba, bb = ((r.ink_bottom_px or 0) - (r.ink_top_px or 0) for r in (a, b))
            ba, bb = ba if ba > 0 else a.h, bb if bb > 0 else b.h
            touching = min(abs(a.y1 - b.y0), abs(b.y1 - a.y0)) <= 0.5 * h
            if yo(a, b) > 0.12 * h or (touching and abs(ba - bb) <= 0.15 * max(ba, bb) and small.font_pt < nearest(small.est_pt)):
                a.font_pt = b.font_pt = small.font_pt


def marginal(r):
    return r.bold and r.bold_r is not None and r.font_pt >= 16 and r.bold_r < 0.22


def wraps(rows):
    some = [r for r in rows if plain(r) and r.est_pt > 0]

    def link(i, j):
        a, b = some[i], some[j]
        h, gap = min(a.h, b.h), b.y0 - a.y1
        if b.y0 < a.y0 or not -0.6 * h < gap < 0.45 * h or xo(a, b) < 0.4 * min(a.w, b.w):
            return False
        if a.bold != b.bold:
            heavy = a if a.bold else b
            if not marginal(heavy) and not (heavy.bold_r is None and heavy.stroke_rel == 0 and heavy.font_pt >= 24):
                return False
        return fills(a, b, 25) and apart(a.text_rgb, b.text_rgb) <= 45 and abs(a.est_pt - b.est_pt) <= 0.14 * max(a.est_pt, b.est_pt)

    for group in components(len(some), link):
        g = [some[i] for i in group]
        heavy = [r for r in g if r.bold]
        if heavy and len(heavy) < len(g) - len(heavy):
            for r in g:
                if marginal(r):
                    r.bold = False
        used = sorted({r.font_pt for r in g})
        if len(used) < 2 or SIZES.index(used[-1]) - SIZES.index(used[0]) != len(used) - 1:
            continue
        count = {s: [r.font_pt for r in g].count(s) for s in used}
        lead = [s for s in used if count[s] == max(count.values())]
        goal = lead[0] if len(lead) == 1 else nearest(statistics.median(r.est_pt for r in g))
        caps = [c for r in g for c in (r.max_fit_pt, r.clamp_pt) if c is not None]
        if caps and goal > min(caps):
            fit = [s for s in SIZES if s <= min(caps)]
            goal = fit[-1] if fit else goal
        for r in g:
            r.font_pt = goal


def code(rows):
    for a in rows:
        if plain(a) and all(ord(c) < 0x2E80 for c in a.text) and ("_" in a.text or "`" in a.text):
            for b in rows:
                h = min(a.h, b.h)
                if b is not a and wide_letters(b.text) and b.font_pt < a.font_pt and abs(a.x0 - b.x0) <= 0.5 * h and -yo(a, b) <= 0.6 * h and fills(a, b, 25) and apart(a.text_rgb, b.text_rgb) <= 45:
                    a.font_pt = b.font_pt
                    break


def next_up(r):
    natural = nearest(r.est_pt)
    return natural if r.est_pt > 0 and SIZES.index(natural) == SIZES.index(r.font_pt) + 1 else None


def twins(rows):
    for a in rows:
        natural = next_up(a) if a.bold else None
        for b in rows if natural else ():
            if b is a or not b.bold or b.font_pt != natural or b.est_pt <= 0 or abs(a.est_pt - b.est_pt) > 0.1 * max(a.est_pt, b.est_pt):
                continue
            ratio = em(a.text) / em(b.text) if em(a.text) and em(b.text) else 1
            if apart(a.text_rgb, b.text_rgb) <= 45 and fills(a, b, 25) and 0.6 <= ratio <= 1.6:
                b.font_pt = a.font_pt


def column(rows):
    for a in rows:
        natural = next_up(a) if a.clamp_pt is not None and plain(a) else None
        for b in rows if natural else ():
            if b is not a and plain(b) and b.est_pt > 0 and b.font_pt == natural == nearest(b.est_pt) and abs(a.x0 - b.x0) <= 0.5 * min(a.h, b.h) and apart(a.text_rgb, b.text_rgb) <= 45 and fills(a, b, 25):
                b.font_pt, b.bold = a.font_pt, a.bold


def weights(rows):
    for r in rows:
        if r.bold and r.font_pt < 24:
            dark = max(r.text_rgb) - min(r.text_rgb) > 15 and r.bg_rgb is not None and sum(r.text_rgb) < sum(r.bg_rgb)
            r.bold = r.bold_r >= 0.13 if r.bold_r is not None and r.font_pt >= 16 and not dark else r.stroke_rel >= 0.13


def voting(rows):
    for pt in {r.font_pt for r in rows}:
        g = [r for r in rows if r.font_pt == pt and r.stroke_rel > 0 and pt < 24]
        n, b = len(g), sum(r.bold for r in g)
        for r in g if n >= 3 else ():
            drawn = r.bold_r is not None and pt >= 16
            if 3 * b >= 2 * n:
                if not r.bold:
                    r.bold = r.bold_r >= -0.05 if drawn else r.stroke_rel >= 0.115
            elif 5 * b <= n:
                if r.bold and (r.bold_r < 0.22 if drawn else (r.bold_r is None or r.bold_r < 0.28) and r.stroke_rel <= 0.15):
                    r.bold = False
            elif n <= 4 and b == 1 and marginal(r):
                r.bold = False


def bridging(rows, dropped):
    for d in dropped:
        h, above, below = max(1.0, d.h), None, None
        for r in rows:
            if not plain(r) or xo(r, d) < 0.3 * max(1.0, d.w):
                continue
            if r.y1 <= d.y0 + 0.3 * h:
                above = r if above is None or r.y1 > above.y1 else above
            elif r.y0 >= d.y1 - 0.3 * h:
                below = r if below is None or r.y0 < below.y0 else below
        if above is None or below is None or abs(above.x0 - below.x0) > 0.6 * min(above.h, below.h):
            continue
        if above.est_pt > 0 and below.est_pt > 0 and abs(above.est_pt - below.est_pt) > 0.2 * max(above.est_pt, below.est_pt):
            continue
        if fills(above, below, 25) and apart(above.text_rgb, below.text_rgb) <= 45:
            below.font_pt, below.bold = above.font_pt, above.bold


def clamping(rows, k):
    for a in sorted(rows, key=lambda r: r.x0):
        next_ = [b for b in sorted(rows, key=lambda r: r.x0) if b is not a and plain(b) and b.x0 > a.x1 and yo(a, b) >= 0.5 * min(a.h, b.h)]
        if not plain(a) or not next_ or em(a.text) <= 0:
            continue
        b, width = next_[0], em(a.text)
        most = (b.x0 - a.x0) * k * 1.02
        fit = [s for s in SIZES if s * width <= most]
        if a.font_pt * width > most and fit:
            old, a.font_pt = a.font_pt, fit[-1]
            if b.font_pt == old and b.bold == a.bold and (b.x0 - a.x1) * k < 0.5 * old and apart(a.text_rgb, b.text_rgb) <= 45:
                b.font_pt = a.font_pt


def chips(rows):
    some = [r for r in rows if plain(r) and r.bg_rgb is not None and not r.segments]

    def link(i, j):
        a, b = some[i], some[j]
        return -yo(a, b) <= 0.6 * min(a.h, b.h) and xo(a, b) >= 0.5 * min(a.w, b.w) and apart(a.text_rgb, b.text_rgb) <= 25 and before[i] is not None and apart(before[i], before[j]) <= 40

    before = [r.bg_rgb for r in some]
    for group in components(len(some), link):
        if len(group) > 1:
            middle = tuple(int(statistics.median(before[i][c] for i in group)) for c in range(3))
            for i in group:
                some[i].bg_rgb = middle


def titles(rows):
    rows = sorted(rows, key=lambda r: r.x0)

    def link(i, j):
        a, b = (rows[i], rows[j]) if rows[i].x0 <= rows[j].x0 else (rows[j], rows[i])
        h = min(a.h, b.h)
        return plain(a) and plain(b) and a.font_pt >= 28 and b.font_pt >= 28 and a.bold == b.bold and yo(a, b) >= 0.6 * h and b.x0 - a.x1 <= 0.8 * h and apart(a.text_rgb, b.text_rgb) <= 45 and (a.bg_rgb is None) == (b.bg_rgb is None)

    out = []
    for group in components(len(rows), link):
        g = [rows[i] for i in group]
        text, end = g[0].text, g[0].x1
        for p in g[1:]:
            fold = dict(zip("：，。；（）", ":,.;()"))
            twice = p.x0 < end and p.text and text and fold.get(p.text[0], p.text[0]) == fold.get(text[-1], text[-1])
            text, end = text + p.text[bool(twice) :], max(end, p.x1)
        out.append((passes.pangu(text).strip() if len(g) > 1 else text, g[0].x0, min(p.y0 for p in g), end, max(p.y1 for p in g), max(g, key=lambda p: (len(wide_letters(p.text)), p.w)).font_pt, min(p.score for p in g)))
    return out


def lost(rows):
    out = set()
    for i, r in enumerate(rows):
        t = r.text.strip()
        letter = len(t) == 1 and t.isascii() and t.isalpha() and r.font_pt >= 28
        if letter and not any(j != i and yo(r, o) > 0.3 * max(1.0, r.h) for j, o in enumerate(rows)):
            out.add(i)
        if ("==" in t and "×" in t) or (r.h > 2.5 * r.w and not r.vertical and plain(r) and wide_letters(t)) or r.shifted:
            out.add(i)
    return out


def grouped(rows):
    out = []
    for r in rows:
        for g in out:
            a = g[-1]
            h = min(a.h, r.h)
            aligned = abs(a.x0 - r.x0) < h or abs((a.x0 + a.x1) / 2 - (r.x0 + r.x1) / 2) < h
            if a.font_pt == r.font_pt and not a.angle and not r.angle and 0.75 <= r.h / a.h <= 1.33 and r.y0 - a.y1 < 0.7 * h and xo(a, r) >= 0 and aligned:
                g.append(r)
                break
        else:
            out.append([r])
    return out


def state(rows):
    return [(r.pos, r.font_pt, r.bold, r.bg_rgb) for r in rows]


ONE = [(passes.level_stacks, stacks), (passes.unify_wraps, wraps), (passes.follow_cjk, code), (passes.sync_twins, twins), (passes.spread_clamp, column), (passes.remeasure, weights), (passes.vote, voting), (passes.unify_chips, chips)]


@pytest.mark.parametrize("mine,rule", ONE, ids=[f.__name__ for f, _ in ONE])
def test_one_pass(mine, rule):
    changed = 0
    for seed in range(150):
        rows = make(random.Random(seed))
        a, b = copy.deepcopy(rows), copy.deepcopy(rows)
        mine(a)
        rule(b)
        assert state(a) == state(b), seed
        changed += state(a) != state(rows)
    assert changed > 2


def test_passes_with_more_arguments():
    changed = [0, 0]
    for seed in range(150):
        rng = random.Random(seed)
        rows, dropped = make(rng), make(rng, 4)
        a, b = copy.deepcopy(rows), copy.deepcopy(rows)
        passes.bridge(a, dropped)
        bridging(b, dropped)
        assert state(a) == state(b)
        changed[0] += state(a) != state(rows)
        a, b = copy.deepcopy(rows), copy.deepcopy(rows)
        passes.clamp_to_neighbour(a, 0.5)
        clamping(b, 0.5)
        assert state(a) == state(b)
        changed[1] += state(a) != state(rows)
    assert min(changed) > 2


def test_titles_and_blocks():
    merged = 0
    for seed in range(150):
        rows = make(random.Random(seed))
        got = [(r.text, r.x0, r.y0, r.x1, r.y1, r.font_pt, r.score) for r in passes.merge_titles(copy.deepcopy(rows))]
        assert got == titles(copy.deepcopy(rows))
        merged += len(got) < len(rows)
        assert [[r.pos for r in g] for g in passes.blocks(rows, True)] == [[r.pos for r in g] for g in grouped(rows)]
        assert passes.unreproducible(rows) == lost(rows)
    assert merged > 2


def test_the_whole_sequence():
    """All passes in their order, as plain rules; titles are merged by the pass that is tested above."""
    for seed in range(100):
        for options in (Options(), Options(merge_lines=True, keep_tiny_text=True), Options(bold_mode="never")):
            rows = make(random.Random(seed))
            got = passes.process(copy.deepcopy(rows), options, 0.5)
            gone = lost(rows)
            kept = [r for i, r in enumerate(rows) if i not in gone]
            if not options.keep_tiny_text:
                junk = passes.junk(kept)
                kept = [r for i, r in enumerate(kept) if i not in junk]
            dropped = [r for r in rows if not any(r is k for k in kept)]
            kept = passes.merge_titles(kept)
            for rule in (stacks, wraps, code, twins, column):
                rule(kept)
            if options.bold_mode == "auto":
                weights(kept)
                voting(kept)
            bridging(kept, dropped)
            clamping(kept, 0.5)
            chips(kept)
            want = grouped(kept) if options.merge_lines else [[r] for r in kept]
            assert [state(g) for g in got] == [state(g) for g in want], seed


def test_junk_by_its_definition():
    """The flood as a fixpoint of single steps, in any order."""
    for seed in range(100):
        rng = random.Random(seed)
        rows = make(rng, 18)
        gone = {i for i, r in enumerate(rows) if passes.illegible(r)}
        for i, a in enumerate(rows):
            for j in range(i + 1, len(rows)):
                if passes.crossing(a, rows[j]):
                    gone |= {i, j}
        order = list(range(len(rows)))
        again = True
        while again:
            again = False
            rng.shuffle(order)
            for i in order:
                if i in gone:
                    continue
                a = rows[i]
                pad = 2 * a.h
                by = [j for j, b in enumerate(rows) if j != i and b.x0 < a.x1 + pad and b.x1 > a.x0 - pad and b.y0 < a.y1 + pad and b.y1 > a.y0 - pad]
                mates = [j for j, b in enumerate(rows) if j != i and a.font_pt == b.font_pt and abs(a.h - b.h) <= 0.3 * max(a.h, b.h) and xo(a, b) >= 0.6 * min(a.w, b.w) and -yo(a, b) <= 0.8 * max(a.h, b.h)]
                flooded = passes.weak(a) and any(j in gone for j in by) and not any(j not in gone and not passes.weak(rows[j]) for j in by)
                if flooded or (a.font_pt <= 14 and any(j in gone for j in mates)):
                    gone.add(i)
                    again = True
        assert passes.junk(rows) == gone
