import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.config import Options
from quirelake.functions import geometry as G
from quirelake.functions import runs as R
from quirelake.functions import text as T
from quirelake.operators import compare, groups, passes, pages, pixels, style, vocab
from quirelake.plans import oracles, queries, shapes
from quirelake.sources import pptx, providers

SF = "/root/testdata/sf0.001"


def values(spark, rows, column, f):
    df = spark.createDataFrame([(k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(rows)], column)
    return [r["o"] for r in df.select("k", f.alias("o")).orderBy("k").collect()]


def test_golden_text(spark):
    t = lambda rows, f: values(spark, rows, "k int, t string", f("t"))
    assert t(["用AI寫Code好", "第3章", "A  B", "（AI）"], T.pangu_spacing) == ["用 AI 寫 Code 好", "第 3 章", "A B", "（AI）"]
    assert t(["完成°", "25°", "°", "abc °"], T.fix_trailing_degree) == ["完成。", "25°", "°", "abc。"]
    assert t(["反椎規則", "雨份", "幹擾"], T.fix_confusions) == ["反推規則", "兩份", "干擾"]
    assert t(["·項目", "· 項目", "•項目", "•", "-x"], T.normalize_bullet) == ["• 項目", "• 項目", "• 項目", "•", "-x"]
    assert t(["：，。；（）"], T.fold_punct) == [":,.;()"]
    assert t(["", "café", "A。"], T.is_pure_latin) == [True, True, False]
    assert np.allclose(t(["AI 用"], T.text_width_em), [2.37])
    assert np.allclose(t(["noun", "Format", "gap", "Z-Library"], T.latin_ink_ratio), [0.52, 0.74, 0.72, 0.94])
    assert sorted(t(["資訊架構"], T.ngrams)[0]) == sorted(["資訊", "訊架", "架構", "資訊架", "訊架構", "資訊架構"])
    assert compare.normal("Ａ B　c") == "ABc"


def test_golden_numbers(spark):
    assert values(spark, [22.0, 15.0, 13.0, 10.25, 23.6, 7.0, 100.0], "k int, t double", G.snap_font_size("t")) == [20, 14, 12, 10, 24, 8, 60]
    ceiling = lambda tol: G.snap_font_size("t", "m", tol)
    assert values(spark, [(24.0, 20.0), (9.0, 5.0)], "k int, t double, m double", ceiling(1.0)) == [20, 9]
    assert values(spark, [(24.0, 23.0)], "k int, t double, m double", ceiling(1.10)) == [24]
    assert np.allclose(values(spark, [8.0, 10.0, 12.0], "k int, t double", G.width_tolerance("t")), [1.12, 1.075, 1.03])
    got = [r["page_no"] for r in pages.page_selection(spark, "1-5,8", 10).orderBy("ord").collect()]
    assert got == [0, 1, 2, 3, 4, 7]
    assert [r["page_no"] for r in pages.page_selection(spark, "2,2,1", 3).orderBy("ord").collect()] == [1, 1, 0]
    assert pages.page_selection(spark, "0,4", 3).count() == pages.page_selection(spark, "3-1", 5).count() == 0
    quad = [[0.0, 0.0], [10.0, 2.0], [9.0, 7.0], [-1.0, 5.0]]
    row = spark.createDataFrame([(quad,)], "q array<array<double>>").select(G.quad_bounds("q").alias("b"), G.tilt("q").alias("t")).first()
    assert tuple(row["b"]) == (-1, 10, 0, 7) and 11 < row["t"]["angle"] < 12 and row["t"]["cx"] == 4.5


def test_runs(spark):
    rng = np.random.default_rng(1)
    rows = [(rng.random(n) < 0.6).tolist() for n in (0, 1, 5, 30)]
    longest = values(spark, rows, "k int, f array<boolean>", R.longest_run("f"))
    found = values(spark, rows, "k int, f array<boolean>", R.true_runs("f"))
    for flags, best, some in zip(rows, longest, found, strict=True):
        want = pixels.runs(np.array(flags, bool))
        assert best == pixels.longest(np.array(flags, bool)) and [tuple(r) for r in some or []] == [tuple(r) for r in want.tolist()]
    red, blue = (200, 0, 0), (0, 0, 200)
    colours = [[red, red, blue], [red, blue, red], [None, red, None, blue, blue], [red, red], [None, None], []]
    got = values(spark, colours, "k int, c array<struct<r:int,g:int,b:int>>", R.colour_runs("c"))
    plain = [None if x is None else [(e["n"], tuple(e["rgb"])) for e in x] for x in got]
    assert plain == [[(2, red), (1, blue)], None, [(3, red), (2, blue)], None, None, None]
    means = values(spark, [[1.0, 2.0, 50.0, 52.0, 1.0], []], "k int, v array<double>", R.running_mean_segments("v", 26.0))
    assert [(e["start"], e["n"], e["mean"]) for e in means[0]] == [(0, 2, 1.5), (2, 2, 51.0), (4, 1, 1.0)] and means[1] == []


def test_small_functions(spark):
    t = lambda rows, f: values(spark, rows, "k int, t string", f("t"))
    assert t(["a", "Z", "7", "é", "字", "-", "ab"], T.is_latin_alnum) == [True, True, True, False, False, False, False]
    assert t(["a", "é", "7", "字", "。", "-", " "], T.is_word_char) == [True, True, True, True, True, False, False]
    boxes = spark.createDataFrame([([0.0, 10.0, 40.0], [8.0, 18.0, 50.0]), ([0.0], [8.0]), ([0.0, 9.0], [8.0, 18.0])], "l array<double>, r array<double>")
    assert [r["o"] for r in boxes.select(R.first_gap_stop("l", "r", F.lit(5.0)).alias("o")).collect()] == [2, 1, 2]
    bow = [(200.0, 40.0), (0.0, 40.0), (100.0, 20.0)]
    frags = spark.createDataFrame([([{"x": x, "y": y} for x, y in bow], 30.0), ([{"x": x, "y": y} for x, y in bow], 60.0), ([{"x": 0.0, "y": 1.0}], 1.0)], "f array<struct<x:double,y:double>>, h double")
    assert [r["o"] for r in frags.select(G.arc_sagitta("f", F.col("h")).alias("o")).collect()] == [20.0, 0.0, 0.0]
    tall = spark.createDataFrame([("純寫作", 0.0, 0.0, 30.0, 90.0), ("純A作", 0.0, 0.0, 30.0, 90.0), ("純寫作", 0.0, 0.0, 90.0, 90.0), ("純", 0.0, 0.0, 30.0, 90.0)], "text string, x0 double, y0 double, x1 double, y1 double")
    assert [r["o"] for r in tall.select(pages.is_vertical_cjk().alias("o")).collect()] == [True, False, False, False]
    assert [style.is_vertical(r["text"], (r["x0"], r["y0"], r["x1"], r["y1"]), True) for r in tall.collect()] == [True, False, False, False]
    assert spark.range(1).select(shapes.slide_height(F.lit(960.0), F.lit(540.0)).alias("h")).first()["h"] == 6858000
    swap = lambda a, b: lambda t: t.replace(a, b)
    assert providers.strip_simplified("执規", swap("执", "執"), swap("規", "规")) == "執規" and providers.strip_simplified("执", swap("执", "執"), swap("規", "规")) == "执"


def test_axis_labels_that_stay(spark):
    """Upright narrow CJK lines go, unless they are typeset vertically, turned or bent."""
    rows = [(k, "直排文字", 0.0, 0.0, 20.0, 90.0, a, c, v) for k, (a, c, v) in enumerate([(0.0, 0.0, False), (0.0, 0.0, True), (12.0, 0.0, False), (0.0, 9.0, False), (None, None, None)])]
    df = spark.createDataFrame(rows, "k int, text string, x0 double, y0 double, x1 double, y1 double, angle double, arc double, vertical boolean")
    assert [r["k"] for r in df.where(pages.is_axis_label()).orderBy("k").collect()] == [0, 4]


def test_colour_runs_of_a_line(spark):
    rng = np.random.default_rng(2)
    pool = [None, (0, 0, 0), (30, 30, 30), (200, 0, 0), (0, 0, 200)]
    rows = [[pool[i] for i in rng.integers(0, 5, rng.integers(0, 12))] for _ in range(60)]
    got = values(spark, rows, "k int, c array<struct<r:int,g:int,b:int>>", R.colour_runs("c"))
    assert [None if x is None else [(e["n"], tuple(e["rgb"])) for e in x] for x in got] == [style.runs_of(r) for r in rows]


def test_text_runs(spark):
    rgb = {"r": 1, "g": 2, "b": 3}
    rows = [("AB CD", [(2, rgb), (2, rgb)], 0), ("ABC。", [(1, rgb), (2, rgb)], 0), ("A", [(1, rgb), (1, rgb)], 0), ("佐證[1]", [(5, rgb)], 3), ("a b", [(2, rgb)], 9)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, r array<struct<n:int,rgb:struct<r:int,g:int,b:int>>>, tail int")
    pieces = T.split_text_runs("t", "r")
    out = df.select("k", pieces.alias("p"), T.mark_superscript(pieces, F.col("tail")).alias("m")).orderBy("k").collect()
    assert [None if r["p"] is None else [p["text"] for p in r["p"]] for r in out] == [["AB ", "CD"], ["A", "BC。"], None, ["佐證[1]"], ["a b"]]
    assert [(p["text"], p["raised"]) for p in out[3]["m"]] == [("佐證", False), ("[1]", True)] and [(p["text"], p["raised"]) for p in out[4]["m"]] == [("a b", True)]


def test_split_text_runs_takes_whole_lines(spark, tmp_path):
    """The query against brute force, on lines far beyond a few words."""
    texts = ["ab  cd", "x", " two words of a line that goes on for more than twenty-four characters ", "é漢😀 " * 40 + "end[1]", "a b" * 3000]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in queries.queries()["split_text_runs"](spark, str(tmp_path)).orderBy("page", "k").collect():
        got.setdefault(r["page"], []).append((r["text"], r["raised"]))
    want = {}
    for k, t in enumerate(texts):
        solid = [i for i, c in enumerate(t) if c != " "]
        half = solid[len(solid) // 2] if len(solid) > 1 else 0
        tail = max(0, len(t) - 3)
        cuts = sorted({0, half, tail, len(t)})
        want[k] = [(t[a:b], a >= tail) for a, b in zip(cuts, cuts[1:])]
    assert got == want


def test_vocab(spark):
    lines = spark.createDataFrame([(1, 0, "資訊架構", 0.9), (1, 1, "資訊", 0.85), (1, 2, " 黃訊 ", 0.6), (2, 0, "資訊黃金", 0.9), (2, 1, "黃訊", 0.6), (3, 0, "資訊", 0.79)], "page long, pos long, text string, score double")
    counted = vocab.page_vocab(lines)
    assert counted.where("page = 3").count() == 0 and counted.where("token = '資訊' AND page = 1").first()["cnt"] == 2
    fixed = {(r["page"], r["pos"]): r["text"] for r in vocab.correct_lines(lines, counted).collect()}
    assert fixed[(1, 2)] == "資訊" and fixed[(2, 1)] == "黃訊"  # on page 2 two words are as near


def line(pos, text, x0, y0, x1, y1, pt=20.0, **more):
    base = {"score": 0.99, "est_pt": pt, "bold": False, "stroke_rel": 0.1, "bold_r": None, "text_rgb": (0, 0, 0), "bg_rgb": (250, 250, 250)}
    return passes.Row(pos, text, x0, y0, x1, y1, font_pt=pt, **(base | more))


def test_passes():
    a, b = line(0, "「方言」：", 0, 0, 100, 40, 36.0), line(1, ":的規格體系", 95, 2, 300, 42, 28.0)
    (merged,) = passes.merge_titles([b, a])
    assert merged.text == "「方言」：的規格體系" and merged.font_pt == 28.0 and (merged.x0, merged.x1) == (0, 300)
    wraps = [line(0, "x" * 20, 0, 0, 300, 30, 14.0), line(1, "x" * 20, 0, 32, 300, 62, 14.0, est_pt=14.4), line(2, "x" * 9, 0, 64, 200, 94, 16.0, est_pt=15.1)]
    passes.unify_wraps(wraps)
    assert [r.font_pt for r in wraps] == [14.0] * 3
    pair = [line(0, "x", 0, 0, 300, 30, 14.0, est_pt=14.1), line(1, "x", 0, 32, 300, 62, 16.0, est_pt=15.2)]
    passes.unify_wraps(pair)
    assert [r.font_pt for r in pair] == [14.0, 14.0]
    apart = [line(0, "x", 0, 0, 300, 30, 14.0), line(1, "x", 0, 32, 300, 62, 18.0, est_pt=14.5)]
    passes.unify_wraps(apart)
    assert [r.font_pt for r in apart] == [14.0, 18.0]  # not adjacent on the ladder
    for score, text, pt, gone in ((0.85, "基礎", 9, 0), (0.84, "基礎", 9, 1), (0.94, "12:30", 9, 0), (0.93, "12:30", 9, 1), (0.71, "abcd", 14, 1), (0.72, "abcd", 14, 0), (0.74, "di", 20, 1), (0.75, "di", 20, 0)):
        assert passes.illegible(line(0, text, 0, 0, 9, 9, float(pt), score=score)) == bool(gone)
    cohort = lambda bolds: [line(k, "x", 0, 0, 9, 9, 20.0, bold=b, stroke_rel=0.13) for k, b in enumerate(bolds)]
    for bolds, want in (([1, 1, 0], 3), ([1, 0, 0, 0, 0], 0), ([1, 0, 0, 0], 1), ([1, 0], 1)):
        rows = cohort(map(bool, bolds))
        passes.vote(rows)
        assert sum(r.bold for r in rows) == want
    far_above = [line(0, "x", 0, 500, 100, 530), line(1, "x", 0, 0, 100, 30)]
    assert len(passes.blocks(far_above, True)) == 1 and len(passes.blocks(far_above, False)) == 2
    assert passes.align([line(0, "x", 0, 0, 10, 9), line(1, "x", 0, 0, 20, 9)]) == "left"
    assert passes.process([], Options(), 0.5) == []


def test_flood_has_no_order():
    rng = np.random.default_rng(3)
    for _ in range(30):
        rows = [line(k, "ab"[: rng.integers(1, 3)], *(p := rng.integers(0, 200, 2).astype(float)), p[0] + 20, p[1] + 12, float(rng.choice([8, 9, 14, 20, 24])), score=float(rng.random())) for k in range(25)]
        gone = {rows[i].pos for i in passes.junk(rows)}
        order = rng.permutation(25)
        assert {rows[order[i]].pos for i in passes.junk([rows[j] for j in order])} == gone


def test_merge_titles_in_sets_as_in_sequence(spark):
    from quirelake.operators import relate

    lines = spark.createDataFrame(
        [(1, 0, "標題：", 0.0, 0.0, 100.0, 40.0, 0.9, 36.0), (1, 1, ":二 A", 90.0, 2.0, 200.0, 41.0, 0.8, 28.0), (1, 2, "遠", 600.0, 0.0, 640.0, 40.0, 0.9, 36.0)],
        "page long, pos long, text string, x0 double, y0 double, x1 double, y1 double, score double, font_pt double",
    ).withColumns({"angle": F.lit(0.0), "arc": F.lit(0.0), "bold": F.lit(True), "text_rgb": F.struct(F.lit(0).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b")), "bg_rgb": F.lit(None).cast("struct<r:int,g:int,b:int>")})
    out = {r["cc"]: (r["text"], r["n"], r["font_pt"], r["score"]) for r in groups.merge_titles(lines, relate.title_edges(lines)).collect()}
    assert out == {0: ("標題：二 A", 2, 36.0, 0.8), 2: ("遠", 1, 36.0, 0.9)}


def page_image():
    img = np.full((120, 400, 3), 240, np.uint8)
    for x in range(40, 200, 16):
        img[40:70, x : x + 5] = 20  # strokes
    img[30:80, 300:303] = 20  # an obstacle
    return img


def test_pixels():
    img = page_image()
    band = style.look_at(img, {"text": "標題", "x0": 36, "y0": 34, "x1": 204, "y1": 76})
    assert band["bg_rgb"] == dict.fromkeys("rgb", 240) and band["text_rgb"] == dict.fromkeys("rgb", 20) and (band["ink_top_px"], band["ink_bottom_px"]) == (40, 70)
    assert pixels.room_to_the_right(img, 204, 40, 70, 80, (240, 240, 240)) == 96
    assert pixels.room_to_the_right(img, 310, 40, 70, 30, (240, 240, 240)) == float("inf") and pixels.room_to_the_right(img, 400, 0, 9, 9, (0, 0, 0)) == 0
    assert pixels.gap_is_blank(img, 205, 240, 40, 70) and not pixels.gap_is_blank(img, 40, 100, 40, 70)
    mask = np.zeros((9, 9), bool)
    mask[2:7, 2:7] = True
    assert pixels.erode(mask).sum() == 9 and pixels.dilate(mask, 1).sum() == 45 and pixels.survival(mask) == 1 / 25
    wrap = np.zeros((4, 4), bool)
    wrap[0, 0] = True
    assert pixels.dilate(wrap, 1)[3, 0]  # borders see the opposite side
    colour, share = pixels.dominant_colour(img)
    assert colour.tolist() == [240] * 3 and share > 0.8
    assert [c.tolist() for c, _ in pixels.top_clusters(img)] == [[240] * 3, [20] * 3]
    banner = np.full((40, 200, 3), 30, np.uint8)
    banner[:, 120:] = 220
    (a, b) = pixels.background_segments(banner)
    assert a[2] == (30,) * 3 and b[2] == (220,) * 3 and abs(a[1] - 120) <= 3 and b[1] == 200
    assert pixels.background_segments(banner[:, :100]) is None and pixels.segment_fill([a, b], 130) == b[2]
    bars = np.full((60, 200, 3), 255, np.uint8)
    for x in (10, 100):
        bars[15:45, x : x + 30] = 0
    bars[14:46, 68:71] = 0
    boxes = [(10, 15, 40, 45), (100, 15, 130, 45), (135, 15, 165, 45)]
    assert pixels.pipe_gaps(boxes, bars) == [0] and pixels.pipe_gaps(boxes[:2], bars) == []
    icon = np.full((40, 40, 3), 255, np.uint8)
    icon[5:35, 5:35] = (0, 160, 60)
    icon[5:35, 5:16] = (30, 30, 30)
    assert pixels.is_filled_icon(icon, (0, 0, 40, 40)) and not pixels.is_filled_icon(page_image(), (36, 34, 204, 76))
    sign = np.full((30, 30, 3), 255, np.uint8)
    sign[4:24, 14:16] = 0
    sign[20:26, 3:27] = 0
    assert pixels.is_warning_icon(sign, (0, 0, 30, 30))
    raised = np.full((40, 60, 3), 255, np.uint8)
    for x, y in ((5, 5), (25, 22), (45, 5)):
        raised[y : y + 12, x : x + 8] = 0
    assert pixels.has_baseline_shift(raised, (0, 0, 60, 40), "H2O") and not pixels.has_baseline_shift(raised, (0, 0, 60, 40), "HzO")
    assert pixels.char_colours(img, [(40, 40, 45, 70), (46, 40, 55, 70), (0, 0, 2, 2)], (240, 240, 240)) == [(20, 20, 20), None, None]


def test_style_from_pixels(spark):
    img = page_image()
    pages_df = spark.createDataFrame([(1, bytearray(img.tobytes()), 400, 120), (2, None, 400, 120)], "page long, rgb binary, img_w int, img_h int")
    lines = spark.createDataFrame([(1, 0, "標題文字", 36.0, 34.0, 204.0, 76.0), (1, 1, "空", 210.0, 5.0, 280.0, 25.0), (2, 0, "無", 0.0, 0.0, 9.0, 9.0)], "page long, pos long, text string, x0 double, y0 double, x1 double, y1 double")
    out = {(r["page"], r["pos"]): r for r in style.estimate(style.measure(pages_df, lines)).collect()}
    head = out[(1, 0)]
    assert head["ink_top_px"] == 40 and head["room_px"] == float("inf") and head["font_pt"] == 60 and head["bold"]
    assert out[(1, 1)]["ink_top_px"] == 5 and out[(1, 1)]["stroke_rel"] == 0 and out[(2, 0)]["ink_top_px"] is None and out[(2, 0)]["text_rgb"] is None


def test_shapes_and_files(spark, tmp_path):
    rgb = {"r": 9, "g": 9, "b": 9}
    cols = "page long, block int, x0 double, y0 double, x1 double, y1 double, font_pt double, align string, bg_rgb struct<r:int,g:int,b:int>, angle double, cx double, cy double, w double, h double, ink_top_px double, ink_bottom_px double, cover_x0_px double, cover_x1_px double, highlight_removed boolean, vertical boolean, img_w int, img_h int, slide_h long"
    plain = (1, 0, 100.0, 100.0, 300.0, 140.0, 24.0, "left", rgb, 0.0, None, None, None, None, 105.0, 135.0, None, None, False, False, 1000, 500, 6096000)
    turned = (1, 1, 0.0, 0.0, 50.0, 50.0, 24.0, "left", rgb, 12.0, 25.0, 25.0, 40.0, 10.0, 5.0, 45.0, None, None, False, False, 1000, 500, 6096000)
    got = {(r["block"], r["kind"]): r for r in shapes.text_shapes(spark.createDataFrame([plain, turned], cols)).collect()}
    assert set(got) == {(0, "cover"), (0, "text"), (1, "text")}
    assert got[(0, "cover")]["top"] == round((105 - 4) * 6096000 / 500) and got[(0, "text")]["fill"] is None and got[(1, "text")]["rotation"] == 12.0
    banner = spark.createDataFrame([(1, 0, 10.0, 90.0, [(10.0, 40.0, rgb), (40.0, 90.0, rgb)], 1000)], "page long, block int, x0 double, x1 double, bg_segments array<struct<x0:double,x1:double,rgb:struct<r:int,g:int,b:int>>>, img_w int")
    assert shapes.banner_covers(banner).count() == 2
    strips = shapes.arc_strips(spark.createDataFrame([(1, 0, 0.0, 120.0, 50.0, 80.0, 20.0)], "page long, block int, x0 double, x1 double, y_mid double, y_edge double, glyph_h double")).orderBy("k").collect()
    assert len(strips) == 12 and strips[0]["rotation"] < 0 < strips[11]["rotation"] and abs(sum(s["cx"] for s in strips) / 12 - 60) < 1e-9
    run = {"text": "A & <b>", "rgb": (1, 2, 3), "font_pt": 24.0, "size_pt": 24.0, "bold": True, "raised": False}
    shape = {"name": "Text 0", "left": 0, "top": 0, "width": 9, "height": 9, "rotation": 12.0, "fill": None, "runs": [run, run | {"text": "1", "raised": True}], "align": "center"}
    data = pptx.deck_bytes([{"png": b"\x89PNG", "shapes": [shape, {"name": "Wipe 0", "left": 1, "top": 1, "width": 1, "height": 1, "fill": (1, 1, 1)}]}, {"png": None, "shapes": [shape]}], 6096000)
    assert list(pptx.texts_of(data)) == [(1, 0, "A & <b>1"), (2, 0, "A & <b>1")]
    assert "ppt/media/image1.png" in zipfile.ZipFile(io.BytesIO(data)).namelist()
    (tmp_path / "a.pptx").write_bytes(data)
    (tmp_path / "b.pptx").write_bytes(b"no presentation")
    assert sorted(tuple(r) for r in pptx.read_texts(spark, str(tmp_path)).collect()) == [("gen", 1, 0, "A & <b>1"), ("gen", 2, 0, "A & <b>1")]
    with pytest.raises(RuntimeError):
        providers.render_pages(spark, str(tmp_path), None)


def test_recall(spark):
    gen = spark.createDataFrame([(1, 0, "abcd efgh"), (1, 1, "zzz"), (2, 0, "")], "slide int, shape_idx int, text string")
    ref = spark.createDataFrame([(1, 0, "abcdefgh"), (1, 1, "qqqq"), (2, 0, "alone"), (3, 0, "behind the end")], "slide int, shape_idx int, text string")
    found = compare.matches(gen, ref)
    assert {(r["slide"], r["shape_idx"]): (round(r["score"], 3), r["near"]) for r in found.collect()} == {(1, 0): (1.0, "abcdefgh"), (1, 1): (0.0, ""), (2, 0): (0.0, "")}
    assert {r["slide"]: (r["matched"], r["total"]) for r in compare.recall(found).collect()} == {1: (1, 2), 2: (0, 1), None: (1, 3)}


def test_queries_against_sql(spark):
    import os

    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations", "events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = oracles.oracle_sql()
    for name, f in queries.queries().items():
        df = f(spark, SF)
        cols = sorted(df.columns)
        mine = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
        if name in sql:
            r = con.execute(sql[name])
            at = [d[0] for d in r.description]
            assert mine == sorted(repr(tuple(x[at.index(c)] for c in cols)) for x in r.fetchall()), name
        else:
            assert mine, name
