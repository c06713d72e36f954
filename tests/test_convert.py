"""A deck from pixels to a file, with stand-ins for renderer and recogniser."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.config import Options
from quirelake.plans import convert
from quirelake.sources import pptx, providers, sinks

BACK, INK = (240, 240, 240), (20, 20, 20)


def draw(img, x0, y0, n, size, colour=INK, gap=4, stroke=5):
    """n square glyphs of upright strokes and a foot."""
    for k in range(n):
        left = x0 + k * (size + gap)
        for x in range(left, left + size - stroke, 11):
            img[y0 : y0 + size, x : x + stroke] = colour
        img[y0 + size - 4 : y0 + size, left : left + size - 4] = colour


def slide():
    img = np.full((540, 960, 3), BACK, np.uint8)
    draw(img, 60, 40, 6, 44)
    draw(img, 60, 130, 10, 22)
    draw(img, 60, 200, 10, 22)
    img[300:360, 60:400] = (30, 60, 140)
    draw(img, 80, 316, 8, 24, (250, 250, 250))
    draw(img, 840, 510, 10, 9)
    return img


class Renderer:
    def pages(self, pdf, dpi):
        img = slide()
        for no in range(2):
            yield {"page_no": no, "img_w": 960, "img_h": 540, "page_w_pt": 960.0, "page_h_pt": 540.0, "rgb": img.tobytes(), "png": sinks.png_bytes(img)}


class Ocr:
    def lines(self, rgb, w, h):
        box = lambda x0, y0, x1, y1: [[x0, y0], [x1, y0], [x1, y1], [x0, y1]]
        yield {"quad": box(56, 34, 350, 90), "text": "標題文字內容", "score": 0.98}
        yield {"quad": box(56, 126, 322, 156), "text": "第一行的內文文字共十", "score": 0.95}
        yield {"quad": box(56, 196, 322, 226), "text": "第二行的內文文字共十", "score": 0.95}
        yield {"quad": box(76, 310, 304, 346), "text": "深色底上的白字", "score": 0.95}
        yield {"quad": box(838, 506, 958, 522), "text": "NotebookLM", "score": 0.9}
        yield {"quad": box(500, 500, 510, 506), "text": "zz", "score": 0.6}


def make_ocr(lang, fast, device):
    assert (lang, fast, device) == ("ch", False, "cpu")
    return Ocr()


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    folder = tmp_path_factory.mktemp("pdf")
    for name in ("one", "two"):
        (folder / f"{name}.pdf").write_bytes(b"%PDF " + name.encode())
    return str(folder)


def test_from_pixels_to_files(spark, source, tmp_path):
    given = convert.Providers(Renderer(), make_ocr)
    target = str(tmp_path / "out")
    stats = convert.convert(spark, source, target, Options(debug=True, pages="1-2", device="cpu"), given).collect()
    assert {tuple(r)[1:] for r in stats} == {(0, 4, 4, 1, 1), (1, 4, 4, 1, 1)} and len(stats) == 4
    texts = pptx.read_texts(spark, target).collect()
    assert len(texts) == 16 and {r["text"] for r in texts} == {"標題文字內容", "第一行的內文文字共十", "第二行的內文文字共十", "深色底上的白字"}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["one.pptx", "two.pptx"]  # nothing else is left
    dump = sinks.read_debug_json(spark, f"{target}-debug")
    assert dump.count() == 2 * 2 * 6 and {r["page"] for r in dump.collect()} == {1, 2}
    body = next((tmp_path / "out-debug").glob("deck_id=*/part-*")).read_text()
    assert [p["page"] for p in json.loads(body)] == [1, 2]
    small = sinks.small_lines(dump).where("page = 1").collect()
    assert {r["n_lines"] for r in small} == {12} and all(len(r["text"]) <= 46 for r in small)


def test_relations_of_a_conversion(spark, source):
    given = convert.Providers(Renderer(), Ocr())
    pages = providers.render_pages(spark, source, given.renderer, 200, [0])
    assert pages.count() == 2
    made = convert.convert_pages(pages, Options(), given)
    styled = {r["text"]: r for r in made["styled"].collect()}
    title, body, light = styled["標題文字內容"], styled["第一行的內文文字共十"], styled["深色底上的白字"]
    assert tuple(title["bg_rgb"]) == BACK and tuple(title["text_rgb"]) == INK and (title["ink_top_px"], title["ink_bottom_px"]) == (40, 84)
    assert title["font_pt"] > body["font_pt"] and title["bold"] and body["est_pt"] <= title["est_pt"]
    assert tuple(light["bg_rgb"]) == (30, 60, 140) and min(light["text_rgb"]) > 200
    shapes = made["shapes"].orderBy("page", "z1", "z2", "z3").select("shape.*").collect()
    names = [r["name"] for r in shapes[: len(shapes) // 2]]
    assert names[0] == "Wipe 5" and [n for n in names if n.startswith("Text")] and sum(bool(r["runs"]) for r in shapes) == 8
    plain = convert.convert_pages(pages, Options(cover=False, keep_watermark=True, bold_mode="never"), given)
    bare = plain["shapes"].select("shape.*").collect()
    assert all(r["fill"] is None for r in bare if r["name"].startswith("Text")) and not any(r["name"].startswith("Wipe") for r in bare)
    assert not any(x["bold"] for r in bare for x in r["runs"])
    merged = convert.convert_pages(pages, Options(merge_lines=True), given)["decks"].collect()
    assert len(merged) == 2 and all(list(pptx.texts_of(bytes(r["pptx"]))) for r in merged)


def test_options_and_missing_providers(spark, source):
    assert convert.selected(None, 9) is None and convert.selected("1-3, 8,2", 9) == [0, 1, 2, 7] and convert.selected("2-99999999", 4) == [1, 2, 3]
    for spec in ("0", "9", "3-1"):
        with pytest.raises(ValueError):
            convert.selected(spec, 5)
    with pytest.raises(RuntimeError):
        convert.convert(spark, source, "/nowhere")
    assert providers.resolve_device("cuda") == "cuda" and providers.resolve_device("auto", ["CUDAExecutionProvider", "DmlExecutionProvider"]) == "dml"
    assert providers.resolve_device("auto", ["CPUExecutionProvider"]) == "cpu"


def test_arcs_become_strips_and_chords():
    from quirelake.operators.passes import Row

    img = np.full((200, 400, 3), (200, 220, 200), np.uint8)
    row = Row(0, "弧線上的文字共九字", 20, 40, 380, 140, 0.9, 20.0, 20.0, True, 0.1, None, (10, 10, 10), (200, 220, 200), arc=40.0)
    out = convert.lay_out_page(7, [row], Options(), 0.5, img)
    strips, chords = [r for r in out if r["kind"] == "strip"], [r for r in out if r["kind"] == "chord"]
    assert len(strips) == 12 and 3 <= len(chords) <= 6 and "".join(r["text"] for r in chords) == row.text
    assert strips[0]["angle"] < 0 < strips[-1]["angle"] and strips[0]["cy"] > strips[6]["cy"] and len(out) == len(strips) + len(chords)
    assert all(r["bg_rgb"] == [200, 220, 200] for r in strips)


def test_pictures():
    img = slide()[:20, :30]
    data = sinks.png_bytes(img)
    import zlib

    size, raw = int.from_bytes(data[16:20], "big"), data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8]
    rows = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(20, 91)
    assert size == 30 and (rows[:, 1:].reshape(20, 30, 3) == img).all()
    framed = sinks.overlay(img, [(5, 5, 15, 12)])
    assert (framed[5, 5:16] == sinks.RED).all() and (framed[8, 8] == img[8, 8]).all() and (img[5, 5] == BACK).all()
    both = sinks.side_by_side(img, img[:, :10])
    assert both.shape == (48, 30, 3) and (both[20:28] == sinks.RED).all() and (both[30, 20] == 255).all()


def test_overlays(spark):
    img = slide()
    pages = spark.createDataFrame([(1, bytearray(img.tobytes()), 960, 540), (2, None, 960, 540)], "page long, rgb binary, img_w int, img_h int")
    lines = spark.createDataFrame([(1, 5.0, 5.0, 50.0, 50.0)], "page long, x0 double, y0 double, x1 double, y1 double")
    (r,) = sinks.overlays(pages, lines).collect()
    assert r["page"] == 1 and bytes(r["png"]) == sinks.png_bytes(sinks.overlay(img, [(5, 5, 50, 50)]))
    assert sinks.debug_decks(lines.limit(0).withColumns({"deck_id": F.lit("d"), "pos": F.lit(1), "text": F.lit(""), "score": F.lit(1.0), "font_pt": F.lit(1.0), "bold": F.lit(True), "stroke_rel": F.lit(0.0), "est_pt": F.lit(1.0), "bold_r": F.lit(0.1), "text_rgb": F.lit(None).cast("struct<r:int,g:int,b:int>"), "bg_rgb": F.lit(None).cast("struct<r:int,g:int,b:int>")})).count() == 0


def test_command_line():
    from quirelake.__main__ import options_of, parser

    read = lambda *argv: options_of(parser().parse_args(["in", *argv]))
    assert read() == Options()
    assert read("--dpi", "150", "--pages", "1-3", "--no-s2t", "--no-cover", "--force-bold", "--merge-lines", "--keep-tiny-text", "--keep-watermark", "--fast", "--device", "cpu", "--min-score", "0.7", "--font", "F", "--debug", "--lang", "en") == Options(
        150, "en", True, "cpu", False, "1-3", 0.7, False, True, True, True, "always", "F", True
    )
    assert read("--no-bold").bold_mode == "never"
    with pytest.raises(SystemExit):
        read("--no-bold", "--force-bold")


def test_engines_are_made_once():
    made = []

    def factory(lang):
        made.append(lang)
        return Ocr()

    a, b = providers.Lazy(factory, lang="x"), providers.Lazy(factory, lang="x")
    assert not made and len(list(a.lines(None, 1, 1))) == len(list(b.lines(None, 1, 1))) == 6 and made == ["x"]
