"""Pluggable providers of what needs software that may be absent.

Defaults degrade as the layout rules allow: no renderer and no recogniser (inputs are lines
already), widths by em tables, script conversion as identity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.recognition import recognise_page
from ..schema import LAYOUT_PAGE


class PageRenderer(Protocol):
    def pages(self, pdf: bytes, dpi: int) -> Iterator[dict]:
        """page_no, img_w, img_h, page_w_pt, page_h_pt, rgb, png of every page."""


class OcrProvider(Protocol):
    def lines(self, rgb: bytes, img_w: int, img_h: int) -> Iterator[dict]:
        """quad, text, score and words of every recognised line."""


class ScriptConverter(Protocol):
    def convert(self, text: str) -> str: ...


def identity(text: str) -> str:
    return text


def strip_simplified(text: str, to_traditional: Callable[[str], str] = identity, to_simplified: Callable[[str], str] = identity) -> str:
    """Traditional form of a text that mixes both scripts; other texts stay."""
    traditional = to_traditional(text)
    return traditional if traditional != text and to_simplified(text) != text else text


def render_pages(spark: SparkSession, path: str, renderer: PageRenderer | None, dpi: int = 200, pages: list[int] | None = None) -> DataFrame:
    """Pages of the documents under a path, the selected ones only (zero-based; None: all), each with a
    key ``page`` of 64 bits (among 10^8 pages, two are alike with a probability of 3 in 10,000)."""
    if renderer is None:
        raise RuntimeError("no page renderer is installed; pass one, or start from lines")
    wanted = None if pages is None else set(pages)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = [{"deck_id": name, **p} for p in renderer.pages(data, dpi) if wanted is None or p["page_no"] in wanted]
                yield pd.DataFrame(rows, columns=[f.name for f in LAYOUT_PAGE])

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(scan, LAYOUT_PAGE)
    return out.withColumn("page", F.xxhash64("deck_id", "page_no"))


def resolve_device(device: str = "auto", available: list[str] | None = None) -> str:
    """Where models run: what is asked for, else the best there is. ``available`` has the names of the
    inference runtime's execution providers; without one, the processor."""
    if device != "auto":
        return device
    if available is None:
        try:
            import onnxruntime
        except ImportError:
            return "cpu"
        available = onnxruntime.get_available_providers()
    known = {"DmlExecutionProvider": "dml", "CUDAExecutionProvider": "cuda"}
    return next((name for key, name in known.items() if key in available), "cpu")


_ENGINES: dict[tuple, object] = {}


class Lazy:
    """A provider that is made where it is first used, once in each worker: models don't travel.

    ``factory(**settings)`` makes it; only the factory and the settings are sent.
    """

    def __init__(self, factory: Callable, **settings):
        self.factory, self.settings = factory, settings

    def _engine(self):
        key = (self.factory.__module__, self.factory.__qualname__, *sorted(self.settings.items()))
        if key not in _ENGINES:
            _ENGINES[key] = self.factory(**self.settings)
        return _ENGINES[key]

    def __getattr__(self, name: str):
        if name.startswith("__") or name in ("factory", "settings"):
            raise AttributeError(name)
        return getattr(self._engine(), name)


_BOX = "array<struct<ch:string,l:double,t:double,r:double,b:double>>"
READ = f"page bigint, pos bigint, text string, x0 double, y0 double, x1 double, y1 double, score double, angle double, arc double, cx double, cy double, w double, h double, char_boxes {_BOX}"


def recognise(pages: DataFrame, ocr: OcrProvider | None, min_score: float = 0.5, reader=None, to_traditional: Callable[[str], str] | None = None, to_simplified: Callable[[str], str] | None = None) -> DataFrame:
    """Lines of pages(page, rgb, img_w, img_h) in reading order, repaired as ``recognise_page`` does it.

    ``ocr.lines`` gives a quad, a text, a score and words (text, box or null) a line; ``reader`` reads
    parts of a page again, and the converters put simplified strays right; without them those rules
    are left out. A page without pixels has no lines.
    """
    if ocr is None:
        raise RuntimeError("no recogniser is installed; pass one, or start from lines")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf.itertuples():
                if p.rgb is None:
                    continue
                img = np.frombuffer(p.rgb, np.uint8).reshape(p.img_h, p.img_w, 3)
                found = [(x["quad"], x["text"], x["score"], [(w, b if b is None else tuple(b)) for w, b in x.get("words") or ()]) for x in ocr.lines(p.rgb, p.img_w, p.img_h)]
                read = recognise_page(img, found, min_score, reader, to_traditional, to_simplified)
                rows = [
                    (p.page, k, r.text, *r.box, r.score, r.angle, r.arc, r.cx, r.cy, r.w, r.h, None if r.char_boxes is None else [dict(zip("ch l t r b".split(), (b[0], *map(float, b[1:])), strict=True)) for b in r.char_boxes])
                    for k, r in enumerate(read)
                ]
                yield pd.DataFrame(rows, columns=[c.strip().split()[0] for c in READ.removesuffix(_BOX).split(", ")])

    return pages.select("page", "img_w", "img_h", "rgb").mapInPandas(scan, READ)
