"""Presentation files: a writer of shapes and a reader of texts, on zip and XML alone."""

from __future__ import annotations

import io
import os
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .. import config as C
from ..schema import DECK_TEXT

_A = "http://schemas.openxmlformats.org/drawingml/2006/main"
_P = "http://schemas.openxmlformats.org/presentationml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_REL = "http://schemas.openxmlformats.org/package/2006/relationships"
_CT = "http://schemas.openxmlformats.org/package/2006/content-types"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_NS = f'xmlns:a="{_A}" xmlns:r="{_R}" xmlns:p="{_P}"'
_KIND = "application/vnd.openxmlformats-officedocument.presentationml."
_TREE = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'
_ALIGN = {"left": "l", "center": "ctr", "right": "r"}


def _fill(rgb) -> str:
    rgb = tuple(rgb.values()) if isinstance(rgb, dict) else rgb
    return "<a:noFill/>" if rgb is None else '<a:solidFill><a:srgbClr val="{:02X}{:02X}{:02X}"/></a:solidFill>'.format(*rgb)


def _run(r: dict, font: str) -> str:
    face = "Arial Narrow" if r["font_pt"] >= C.NARROW_PT else "Arial"
    marks = f' sz="{round(r["size_pt"] * 100)}" b="{int(bool(r["bold"]))}"' + (' strike="sngStrike"' if r.get("strike") else "") + (' baseline="55000"' if r.get("raised") else "")
    props = f"<a:rPr{marks}>{_fill(r['rgb'])}<a:latin typeface={quoteattr(face)}/><a:ea typeface={quoteattr(font)}/></a:rPr>"
    return f"<a:r>{props}<a:t>{escape(r['text'])}</a:t></a:r>"


def _shape(k: int, s: dict, font: str) -> str:
    turn = f' rot="{round((s.get("rotation") or 0) * 60000)}"' if s.get("rotation") else ""
    place = f'<a:xfrm{turn}><a:off x="{s["left"]}" y="{s["top"]}"/><a:ext cx="{max(0, s["width"])}" cy="{max(0, s["height"])}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom>'
    body = ""
    if s.get("runs"):
        frame = f'<a:bodyPr wrap="{"square" if s.get("wrap") else "none"}" lIns="0" rIns="0" bIns="0" tIns="{s.get("margin_top") or 0}" anchor="{"ctr" if s.get("vertical") else "t"}"' + (' vert="eaVert"/>' if s.get("vertical") else "/>")
        side = f'<a:pPr algn="{_ALIGN.get(s.get("align"), "l")}"/>'
        paragraphs = groupby(s["runs"], key=lambda r: r.get("para") or 0)
        body = f'<p:txBody>{frame}<a:lstStyle/>{"".join(f"<a:p>{side}{''.join(_run(r, font) for r in some)}</a:p>" for _, some in paragraphs)}</p:txBody>'
    return (
        f'<p:sp><p:nvSpPr><p:cNvPr id="{k}" name={quoteattr(s["name"])}/><p:cNvSpPr/><p:nvPr/></p:nvSpPr>'
        f"<p:spPr>{place}{_fill(s.get('fill'))}<a:ln><a:noFill/></a:ln></p:spPr>{body}</p:sp>"
    )


def _picture(w: int, h: int) -> str:
    return (
        '<p:pic><p:nvPicPr><p:cNvPr id="2" name="Image 0"/><p:cNvPicPr/><p:nvPr/></p:nvPicPr><p:blipFill><a:blip r:embed="rId2"/><a:stretch><a:fillRect/></a:stretch></p:blipFill>'
        f'<p:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{w}" cy="{h}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr></p:pic>'
    )


def _relations(rows: list[tuple[str, str, str]]) -> str:
    return f'{_HEAD}<Relationships xmlns="{_REL}">' + "".join(f'<Relationship Id="{i}" Type="{_R}/{t}" Target="{to}"/>' for i, t, to in rows) + "</Relationships>"


def deck_bytes(slides: list[dict], slide_h: int, font: str = "Microsoft YaHei") -> bytes:
    """A presentation of slides, each {"png": bytes or None, "shapes": [...]}, in their order."""
    n = len(slides)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = [("/ppt/presentation.xml", "presentation.main"), ("/ppt/slideMasters/slideMaster1.xml", "slideMaster"), ("/ppt/slideLayouts/slideLayout1.xml", "slideLayout")]
        parts += [(f"/ppt/slides/slide{k}.xml", "slide") for k in range(1, n + 1)]
        kinds = "".join(f'<Override PartName="{p}" ContentType="{_KIND}{k}+xml"/>' for p, k in parts)
        defaults = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/>'
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_CT}">{defaults}{kinds}</Types>')
        z.writestr("_rels/.rels", _relations([("rId1", "officeDocument", "ppt/presentation.xml")]))
        ids = "".join(f'<p:sldId id="{255 + k}" r:id="rId{k + 1}"/>' for k in range(1, n + 1))
        z.writestr("ppt/presentation.xml", f'{_HEAD}<p:presentation {_NS}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId1"/></p:sldMasterIdLst><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="{C.SLIDE_EMU}" cy="{slide_h}"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", _relations([("rId1", "slideMaster", "slideMasters/slideMaster1.xml"), *[(f"rId{k + 1}", "slide", f"slides/slide{k}.xml") for k in range(1, n + 1)]]))
        colours = 'bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" accent1="accent1" accent2="accent2" accent3="accent3" accent4="accent4" accent5="accent5" accent6="accent6" hlink="hlink" folHlink="folHlink"'
        z.writestr("ppt/slideMasters/slideMaster1.xml", f'{_HEAD}<p:sldMaster {_NS}><p:cSld><p:spTree>{_TREE}</p:spTree></p:cSld><p:clrMap {colours}/><p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="rId1"/></p:sldLayoutIdLst></p:sldMaster>')
        z.writestr("ppt/slideMasters/_rels/slideMaster1.xml.rels", _relations([("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml")]))
        z.writestr("ppt/slideLayouts/slideLayout1.xml", f'{_HEAD}<p:sldLayout {_NS} type="blank"><p:cSld><p:spTree>{_TREE}</p:spTree></p:cSld></p:sldLayout>')
        z.writestr("ppt/slideLayouts/_rels/slideLayout1.xml.rels", _relations([("rId1", "slideMaster", "../slideMasters/slideMaster1.xml")]))
        for k, s in enumerate(slides, 1):
            png = s.get("png")
            shapes = (_picture(C.SLIDE_EMU, slide_h) if png else "") + "".join(_shape(i, x, font) for i, x in enumerate(s["shapes"], 3))
            z.writestr(f"ppt/slides/slide{k}.xml", f"{_HEAD}<p:sld {_NS}><p:cSld><p:spTree>{_TREE}{shapes}</p:spTree></p:cSld></p:sld>")
            rows = [("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml")]
            if png:
                z.writestr(f"ppt/media/image{k}.png", png)
                rows.append(("rId2", "image", f"../media/image{k}.png"))
            z.writestr(f"ppt/slides/_rels/slide{k}.xml.rels", _relations(rows))
    return out.getvalue()


def texts_of(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(slide, shape, text) of the shapes with text, slides in the order of the presentation."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        target = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
        deck = ElementTree.fromstring(z.read("ppt/presentation.xml"))
        for n, entry in enumerate(deck.iter(f"{{{_P}}}sldId"), 1):
            name = target[entry.get(f"{{{_R}}}id")].lstrip("/")
            slide = ElementTree.fromstring(z.read(name if name.startswith("ppt/") else f"ppt/{name}"))
            shapes = [s for s in slide.iter(f"{{{_P}}}sp") if s.find(f"{{{_P}}}txBody") is not None]
            for k, s in enumerate(shapes):
                lines = ["".join(t.text or "" for t in p.iter(f"{{{_A}}}t")) for p in s.iter(f"{{{_A}}}p")]
                yield n, k, "\n".join(lines)


def read_texts(spark: SparkSession, path: str, side: str = "gen") -> DataFrame:
    """Texts of presentation files: side, slide, shape_idx, text. Files that are none give no rows."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                try:
                    rows = list(texts_of(data))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    rows = []
                yield pd.DataFrame([(side, *r) for r in rows], columns=[f.name for f in DECK_TEXT])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(scan, DECK_TEXT)


def build_decks(shapes: DataFrame, font: str = "Microsoft YaHei") -> DataFrame:
    """(deck_id, pptx) of shapes(deck_id, page, z, slide_h, png, shape struct with runs): a deck is one
    group, as it is one file."""

    def deck(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        slides: dict[int, dict] = {}
        for r in sorted(rows.to_pylist(), key=lambda r: (r["page"], r["z"])):
            slide = slides.setdefault(r["page"], {"png": None, "shapes": []})
            slide["png"] = slide["png"] or r["png"]
            slide["shapes"] += [r["shape"]] if r["shape"] else []
        data = deck_bytes(list(slides.values()), rows.column("slide_h")[0].as_py(), font)
        return pa.table({"deck_id": [key[0].as_py()], "pptx": pa.array([data], pa.binary())})

    return shapes.groupBy("deck_id").applyInArrow(deck, "deck_id string, pptx binary")


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _DeckWriter(DataSourceWriter):
    """Each task writes under a name of its own; only what the committed tasks wrote gets its name."""

    def __init__(self, path: str):
        self.path = path
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else os.path.abspath(self.path))

    def write(self, iterator) -> _Written:
        store, base = self._open()
        store.create_dir(posixpath.join(base, self.staging), recursive=True)
        files = []
        for row in iterator:
            name = posixpath.splitext(posixpath.basename(row["deck_id"]))[0] + ".pptx"
            part = posixpath.join(self.staging, uuid.uuid4().hex)
            with store.open_output_stream(posixpath.join(base, part)) as out:
                out.write(bytes(row["pptx"]))
            files.append((part, name))
        return _Written(files)

    def commit(self, messages: list) -> None:
        store, base = self._open()
        for part, name in sorted(f for m in messages if m is not None for f in m.files):
            store.move(posixpath.join(base, part), posixpath.join(base, name))
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, base = self._open()
        if store.get_file_info(posixpath.join(base, self.staging)).type != fs.FileType.NotFound:
            store.delete_dir(posixpath.join(base, self.staging))


class DeckFiles(DataSource):
    """Sink of (deck_id, pptx): one file a deck, by the name of the deck's source."""

    @classmethod
    def name(cls) -> str:
        return "deck_files"

    def schema(self) -> str:
        return "deck_id string, pptx binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _DeckWriter(self.options["path"])


def write_decks(decks: DataFrame, path: str) -> None:
    """Presentation files of (deck_id, pptx) under a path that all executors reach."""
    decks.sparkSession.dataSource.register(DeckFiles)
    decks.select("deck_id", "pptx").write.format("deck_files").mode("append").save(path)
