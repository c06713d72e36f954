"""Fixed values of the layout operators, and the options of a run."""

from __future__ import annotations

from dataclasses import dataclass

# They decide results and must stay as they are.
FONT_LADDER = (8, 9, 10, 10.5, 11, 12, 14, 16, 18, 20, 24, 28, 32, 36, 40, 44, 48, 54, 60)
CJK_CLASS = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
VOCAB_CLASS = r"\x{4E00}-\x{9FFF}"
WIDE_CLASS = r"\x{2E80}-\x{10FFFF}"
CONFUSIONS = (("反椎", "反推"), ("雨份", "兩份"), ("幹擾", "干擾"))
BULLETS = "·‧・∙"
FOLD_FROM, FOLD_TO = "：，。；（）", ":,.;()"
TRAILING_MARKS = "。．.，,、；;：:！!？?）)」』】%…"
ASCENDERS = "bdfhklt/()[]{}|!?'\"$"
DESCENDERS = "gjpqy()[]{}|/$;,"
EM_WIDE, EM_LATIN, EM_SPACE = 1.0, 0.52, 0.33
CJK_INK, LATIN_BASE, LATIN_ASC, LATIN_DESC = 0.875, 0.52, 0.22, 0.20
BLUR_PX = 6.0
TINY_PT, TINY_CJK_KEEP, TINY_LATIN_KEEP = 9, 0.85, 0.94
SMALL_PT, SMALL_MIN_SCORE, GLYPH_MIN_SCORE = 14, 0.72, 0.75
TPL_COMPUTE_PT = 14
TPL_MIN_PT, MARGINAL_R, BOLD_R, CHROMA_MAX, STROKE_BOLD, AUTO_BOLD_PT = 16, 0.22, 0.13, 15, 0.13, 24
VOCAB_MIN_SCORE = 0.8
TITLE_PT = 28
DECOR_ANGLE, MISREAD_SCORE, MISREAD_IOU = 15, 0.92, 0.30
ARC_BOX_H, ARC_MIN_SAGITTA = 80, 12
SLIDE_EMU, EMU_PER_PT, SLIDE_PT = 12192000, 12700, 960
NARROW_PT = 28
MATCH_RATIO = 0.85


@dataclass(frozen=True)
class Options:
    """Options of a conversion; the names are those of the command line."""

    dpi: int = 200
    lang: str = "ch"
    fast: bool = False
    device: str = "auto"
    s2t: bool = True
    pages: str | None = None
    min_score: float = 0.5
    cover: bool = True
    keep_watermark: bool = False
    keep_tiny_text: bool = False
    merge_lines: bool = False
    bold_mode: str = "auto"  # auto, never or always
    font: str = "Microsoft YaHei"
    debug: bool = False
    watermark_suffix: str = "NotebookLM"
