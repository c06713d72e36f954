import numpy as np

from quirelake.operators import pixels as P
from quirelake.operators import style


def flat(h, w, c):
    return np.full((h, w, 3), c, np.uint8)


def test_surfaces():
    page = flat(40, 120, 245)
    page[12:28, 10:110:12] = 10
    page[12:28, 11:110:12] = 10
    plain, ink = P.surface_of(page, flat(4, 50, 245))
    assert plain.bg_rgb == (245, 245, 245) and plain.text is None and ink.sum() == (page[..., 0] == 10).sum()
    mixed = np.concatenate((flat(4, 50, 245), flat(4, 50, 30)), axis=0)
    chip = flat(40, 120, 0)
    chip[:] = (170, 30, 30)
    chip[14:26, 10:110:8] = 250
    chip[14:26, 11:110:8] = 250
    chip[14:26, 12:110:8] = 250
    found, _ = P.surface_of(chip, mixed)
    assert found.bg_rgb == (170, 30, 30) and min(found.text) > 200
    pill = flat(60, 160, 245)
    pill[4:56, 4:156] = (20, 60, 140)
    for x in range(20, 140, 14):
        pill[20:40, x : x + 4] = 240
    spilled, ink = P.surface_of(pill, flat(4, 50, 245))
    assert spilled.bg_rgb == (20, 60, 140) and min(spilled.text) > 200 and ink[30, 20] and not ink[10, 60]
    dark = flat(40, 120, 250)
    dark[8:32, 10:110:6] = 15
    dark[8:32, 11:110:6] = 15
    lit, _ = P.surface_of(dark, np.concatenate((flat(4, 50, 250), flat(4, 40, 190)), axis=1).repeat(1, 0)[:, 20:70])
    assert lit.bg_rgb is not None and min(lit.bg_rgb) > 200
    noise = np.random.default_rng(1).integers(0, 256, (40, 120, 3)).astype(np.uint8)
    assert P.surface_of(noise, noise)[0].bg_rgb is None


def test_strike_and_raised():
    ink = np.zeros((60, 200), bool)
    ink[5:55, 5:195:20] = True
    ink[5:55, 6:195:20] = True
    rows = np.arange(5, 55)
    assert not P.is_struck_through(ink, rows, "作廢")
    struck = ink.copy()
    struck[29:32] = True
    assert P.is_struck_through(struck, rows, "作廢") and not P.is_struck_through(struck, rows, "作")
    mark = ink.copy()
    mark[:, 150:] = False
    mark[5:25, 160:190] = True
    assert P.raised_tail(mark, 150) and not P.raised_tail(ink, 150) and not P.raised_tail(ink, 0)


def test_bands():
    ink = np.zeros((80, 200), bool)
    for k in range(4):
        ink[10:60, 50 * k + 12 : 50 * k + 38] = True
    ink[70:80, 62:88] = True  # junk below one character
    assert P.cjk_band_height(ink, "資訊架構") == 50.0
    assert P.cjk_band_height(ink, "abcd") is None and P.cjk_band_height(ink, "") is None and P.cjk_band_height(ink, "資訊", 3) is None
    img = flat(200, 60, 250)
    img[10:190, 20:41] = 10
    seen = style.look_at(img, {"text": "直排文字", "x0": 15, "y0": 5, "x1": 55, "y1": 195})
    assert seen["vertical"] and seen["column_px"] == 21.0 and (seen["ink_top_px"], seen["ink_bottom_px"]) == (5, 195) and seen["bg_rgb"] == {"r": 250, "g": 250, "b": 250}


def test_glyph_rows_bridge_solid_rows():
    ink = np.zeros((80, 100), bool)
    ink[10:50, 10:60] = True
    ink[25:28] = True  # nearly solid rows inside one band
    ink[65:70, 10:30] = True
    rows = P.glyph_rows(ink)
    assert (rows[0], rows[-1]) == (10, 49) and 26 not in rows and P.band_height(ink) == 60 and not len(P.glyph_rows(ink[:5]))


def test_icons_beside_text():
    ink = np.zeros((60, 200), bool)
    ink[20:40, 60:180:8] = True
    ink[2:58, 5:40] = True  # a tall graphic
    assert P.leading_icon(ink, 61, 180) == 60 and P.leading_icon(ink, 64, 180) == 64
    assert P.leading_icon(ink[:, 50:], 12, 130) is None and P.leading_icon(ink, 2, 180) is None
    part = flat(40, 200, 250)
    part[10:30, 5:25] = (220, 20, 20)
    part[10:30, 60:150:6] = 10
    mask = P.distance(part, np.array([250] * 3)) > P.INK
    assert P.vivid_edges(part, mask) == (60, None)
    assert P.vivid_edges(part[:, 30:], mask[:, 30:]) == (None, None) and P.vivid_edges(part[:5], mask[:5]) == (None, None)


def test_rectify_and_rotate():
    img = flat(200, 200, 250)
    yy, xx = np.mgrid[:200, :200] + 0.5
    t = np.radians(20)
    u, v = (xx - 100) * np.cos(t) + (yy - 100) * np.sin(t), -(xx - 100) * np.sin(t) + (yy - 100) * np.cos(t)
    img[(abs(u) < 60) & (abs(v) < 10)] = 10
    flatly = P.rectify(img, (100, 100), (120, 20), 20, 6)
    assert flatly.shape == (32, 132, 3) and flatly[16, 20:112].max() < 40 and flatly[1].min() > 220
    assert (P.rectify(img, (100, 100), (40, 10), 0, 0) == img[95:105, 80:120]).all()
    turned = P.rotate(img, 20, (250, 250, 250))
    dark = np.flatnonzero((turned < 100).all(axis=2).any(axis=1))
    assert dark[-1] - dark[0] < 26 and (P.rotate(img, 0, (0, 0, 0)) == img).all()


def test_bridged_runs_and_walks():
    flags = np.zeros(60, bool)
    flags[5:10] = flags[15:20] = flags[40:50] = True
    assert P.bridged_runs(flags).tolist() == [[5, 20], [40, 50]] and P.bridged_runs(flags[:4]).tolist() == []
    assert P._reach(flags, np.full(60, 5)) == 19 and P._reach(flags, np.full(60, 30)) == 49 and P._reach(flags[:4], np.full(4, 9)) is None


def test_arc_geometry_from_ink():
    img = flat(300, 600, 230)
    x = np.arange(50, 550)
    t = (x - 300) / 250
    y = (80 + 90 * t * t).astype(int)
    for a, b in zip(x, y):
        img[b - 18 : b + 18, a] = 20
    glyph, mid, edge = P.arc_geometry((50, 40, 550, 210), True, 20.0, 1.5, img, (20, 20, 20))
    assert glyph == 36.0 and abs(mid - 80) < 3 and abs(edge - 170) < 12
    assert P.arc_geometry((50, 40, 550, 210), False, 20.0, 1.5) == (36.0, 192.0, 58.0)
    ribbon = flat(200, 200, 250)
    ribbon[60:120] = (40, 90, 160)
    top, bottom = P.ribbon_limits(ribbon, 50, 100, 90, 0.0, 40, 140, (40, 90, 160), 20)
    assert 56 <= top <= 60 and 119 <= bottom <= 122
    assert P.ribbon_limits(ribbon, 50, 100, 90, 0.0, 70, 110, (40, 90, 160), 20) == (70, 110)  # never grows
    assert P.ribbon_fill(ribbon, (50, 95, 150)) == (40, 90, 160) and P.ribbon_fill(ribbon[:2], (50, 95, 150)) == (50, 95, 150)


def drawn(text, em, bold):
    """A stand-in for a face: upright strokes, thicker where bold."""
    grey = np.full((em + 20, 20 + em * len(text)), 255, np.uint8)
    for k in range(len(text)):
        for x in range(10 + k * em, 10 + k * em + em - 6, 12):
            grey[10 : 10 + em, x : x + (8 if bold else 4)] = 0
    return grey


def test_templates():
    regular, bold = (P.template_stroke(drawn, "資訊", 40, b, 128.0) for b in (False, True))
    assert 3 < regular < bold
    assert abs(P.template_weight(drawn, "資訊", 40, regular, 120.0) - 0) < 0.35 and P.template_weight(drawn, "資訊", 40, bold, 120.0) > 0.6
    assert P.template_weight(drawn, "資", 40, 5.0, 120.0) is None and P.template_weight(lambda *a: None, "資訊", 40, 5.0, 120.0) is None
    assert P.template_weight(drawn, "資訊", 40, 0.5, 120.0) is None
    assert P.tight(np.zeros((3, 3), bool)) is None and P.tight(np.eye(5, dtype=bool)[:, 1:4]).shape == (3, 3)
    img = flat(60, 60, 250)
    img[10:50, 14:20] = img[10:50, 30:36] = 10
    same = np.full((60, 60), 255)
    same[10:50, 14:20] = same[10:50, 30:36] = 0
    assert P.glyph_overlap(img, (5, 5, 55, 55), same) == 1.0
    other = np.full((60, 60), 255)
    other[10:14, 10:50] = other[46:50, 10:50] = 0
    assert P.glyph_overlap(img, (5, 5, 55, 55), other) < 0.3 and P.glyph_overlap(img, (0, 0, 5, 5), same) is None and P.glyph_overlap(img, (0, 0, 50, 50), None) is None


def strokes(img, x0, y0, n, size, colour, gap=4, stroke=5):
    for k in range(n):
        left = x0 + k * (size + gap)
        for x in range(left, left + size - stroke, 11):
            img[y0 : y0 + size, x : x + stroke] = colour
        img[y0 + size - 4 : y0 + size, left : left + size - 4] = colour
    return [{"ch": "字", "l": x0 + k * (size + gap), "t": y0, "r": x0 + k * (size + gap) + size, "b": y0 + size} for k in range(n)]


def test_look_at_two_fills():
    """Text that changes its colour with the fill keeps both; a highlight under one colour goes."""
    img = flat(120, 400, 245)
    img[20:100, 200:] = (20, 40, 120)
    boxes = strokes(img, 24, 44, 6, 24, 10) + strokes(img, 220, 44, 6, 24, 250)
    line = {"text": "字" * 12, "x0": 16, "y0": 30, "x1": 392, "y1": 82, "char_boxes": boxes}
    seen = style.look_at(img, line)
    assert [r["n"] for r in seen["runs"]] == [6, 6] and len(seen["bg_segments"]) == 2 and not seen["highlight_removed"]
    assert seen["bg_rgb"] == seen["bg_segments"][1]["rgb"] and abs(seen["bg_segments"][0]["x1"] - 200) < 8
    marked = flat(120, 400, 245)
    marked[30:82, 180:300] = (250, 235, 120)
    boxes = strokes(marked, 24, 44, 13, 24, 10)
    seen = style.look_at(marked, line | {"text": "字" * 13, "char_boxes": boxes})
    assert seen["highlight_removed"] and seen["bg_segments"] is None and seen["bg_rgb"] == {"r": 245, "g": 245, "b": 245}


def test_look_at_tilted_arc_and_icon():
    img = flat(120, 400, 245)
    boxes = strokes(img, 60, 44, 8, 24, 10)
    img[30:90, 12:44] = (10, 10, 10)
    line = {"text": "字" * 8, "x0": 8, "y0": 28, "x1": 290, "y1": 92, "char_boxes": boxes}
    seen = style.look_at(img, line)
    assert seen["ink_h_px"] == 24 and 50 < seen["cover_x0_px"] <= 60  # the icon counts neither in height nor in cover
    arc = style.look_at(img, line | {"arc": 20.0, "char_boxes": None})
    assert arc["look_x0"] == 102 and arc["runs"] is None
    flat_ = style.look_at(img, {"text": "字字", "x0": 100, "y0": 30, "x1": 200, "y1": 90, "angle": 10.0, "cx": 150.0, "cy": 56.0, "w": 80.0, "h": 30.0})
    assert flat_["bg_rgb"] == {"r": 245, "g": 245, "b": 245} and flat_["bg_segments"] is None
    assert style.look_at(img, line | {"x0": 500, "x1": 600, "char_boxes": None}) is None


def test_look_at_with_faces():
    class Faces:
        def width_em(self, text, narrow):
            return len(text) * (0.8 if narrow else 1.0)

        def draw(self, text, em, bold):
            return drawn(text, em, bold)

    img = flat(120, 400, 245)
    strokes(img, 24, 40, 6, 40, 10, stroke=8)
    heavy = style.look_at(img, {"text": "字" * 6, "x0": 16, "y0": 30, "x1": 300, "y1": 90}, Faces())
    strokes(img2 := flat(120, 400, 245), 24, 40, 6, 40, 10, stroke=4)
    light = style.look_at(img2, {"text": "字" * 6, "x0": 16, "y0": 30, "x1": 300, "y1": 90}, Faces())
    assert heavy["em_regular"] == 6 and abs(heavy["em_narrow"] - 4.8) < 1e-9 and heavy["bold_r"] > 0.5 > light["bold_r"]
    one = style.look_at(img, {"text": "字", "x0": 20, "y0": 36, "x1": 66, "y1": 84}, Faces())
    assert 0 <= one["glyph_iou"] <= 1 and heavy["glyph_iou"] is None


def test_runs_of_colours():
    red, blue = (200, 0, 0), (0, 0, 200)
    assert style.runs_of([red, red, blue]) == [(2, red), (1, blue)] and style.runs_of([red, blue, red]) is None
    assert style.runs_of([None, red, None, blue, blue]) == [(3, red), (2, blue)] and style.runs_of([]) is None and style.runs_of([None]) is None
