"""Sinks of the layout relations, and the scan of what they write."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pages import small_line

RED = (255, 0, 0)


def debug_rows(lines: DataFrame, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """(keys, json): the lines of each page with rounded measures, in order."""
    rgb = lambda c: F.when(F.col(c).isNotNull(), F.array(*[F.col(c)[k] for k in "rgb"]))
    row = F.struct(
        "pos", "text", F.array("x0", "y0", "x1", "y1").alias("bbox"), "score", "font_pt", "bold", F.round("stroke_rel", 4).alias("stroke_rel"),
        F.round("est_pt", 2).alias("est_pt"), F.round("bold_r", 4).alias("bold_r"), rgb("text_rgb").alias("text_rgb"), rgb("bg_rgb").alias("bg_rgb"),
    )
    by = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("lines"))
    return by.select(*keys, F.to_json(F.struct(keys[-1], "lines"), {"ignoreNullFields": "false"}).alias("json"))


def debug_decks(lines: DataFrame, deck: str = "deck_id") -> DataFrame:
    """(deck, json): one array of a deck's pages, in order, as the dump of a deck is one file."""
    pages = debug_rows(lines, (deck, "page")).groupBy(deck).agg(F.array_sort(F.collect_list(F.struct("page", "json"))).alias("p"))
    return pages.select(deck, F.concat(F.lit("["), F.array_join(F.transform("p", lambda e: e["json"]), ","), F.lit("]")).alias("json"))


def write_debug_json(lines: DataFrame, path: str, deck: str = "deck_id") -> None:
    """One array a deck; a line of text is a whole deck, and decks go to files of their own."""
    out = debug_decks(lines, deck)
    out.select(F.col(deck), "json").repartition(deck).write.partitionBy(deck).mode("overwrite").text(path)


def read_debug_json(spark: SparkSession, path: str) -> DataFrame:
    """Lines of dumps: page and the fields of a line."""
    kind = (
        "array<struct<page:bigint,lines:array<struct<pos:bigint,text:string,bbox:array<double>,score:double,font_pt:double,bold:boolean,stroke_rel:double,est_pt:double,bold_r:double,"
        "text_rgb:array<int>,bg_rgb:array<int>>>>>"
    )
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    pages = files.select(F.inline(F.from_json("value", kind)))
    return pages.select("page", F.inline("lines"))


def small_lines(lines: DataFrame, shown: int = 46) -> DataFrame:
    """Small or doubtful lines of a dump with the beginning of their text, and by page how many there are."""
    by = lines.groupBy("page").agg(F.count_if(small_line()).alias("n_small"), F.count(F.lit(1)).alias("n_lines"))
    return lines.where(small_line()).join(by, "page").select("page", "n_small", "n_lines", "pos", "font_pt", "score", F.left("text", F.lit(shown)).alias("text"))


# ---------------------------------------------------------------- pictures


def png_bytes(img: np.ndarray) -> bytes:
    """A colour image (height, width, 3) as PNG."""
    h, w = img.shape[:2]
    rows = np.concatenate((np.zeros((h, 1), np.uint8), img.reshape(h, w * 3)), axis=1)  # no row filter
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def overlay(img: np.ndarray, boxes: list[tuple[float, float, float, float]], width: int = 2) -> np.ndarray:
    """The image with a red frame around each box."""
    out = img.copy()
    h, w = img.shape[:2]
    for x0, y0, x1, y1 in boxes:
        a, b, c, d = max(0, int(x0)), max(0, int(y0)), min(w, int(x1) + 1), min(h, int(y1) + 1)
        for part in (out[b : b + width, a:c], out[max(b, d - width) : d, a:c], out[b:d, a : a + width], out[b:d, max(a, c - width) : c]):
            part[:] = RED
    return out


def side_by_side(above: np.ndarray, below: np.ndarray, gap: int = 8) -> np.ndarray:
    """Two images above each other with a red bar between them; the narrower one stands on white."""
    width = max(above.shape[1], below.shape[1])
    wide = lambda i: np.pad(i, ((0, 0), (0, width - i.shape[1]), (0, 0)), constant_values=255)
    return np.concatenate((wide(above), np.full((gap, width, 3), RED, np.uint8), wide(below)))


def overlays(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(page, png) of pages(page, rgb, img_w, img_h) with the boxes of their lines."""

    def draw(pdf):
        import pandas as pd

        out = []
        for r in pdf.itertuples():
            img = np.frombuffer(r.rgb, np.uint8).reshape(r.img_h, r.img_w, 3)
            out.append((r.page, png_bytes(overlay(img, [tuple(b) for b in r.boxes] if r.boxes is not None else []))))
        return pd.DataFrame(out, columns=["page", "png"])

    boxes = lines.groupBy("page").agg(F.collect_list(F.array("x0", "y0", "x1", "y1")).alias("boxes"))
    held = pages.where("rgb IS NOT NULL").select("page", "rgb", "img_w", "img_h").join(boxes, "page", "left")
    return held.mapInPandas(lambda batches: map(draw, batches), "page bigint, png binary")
