"""Schemas of the layout relations."""

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


RGB = _struct(r=IntegerType(), g=IntegerType(), b=IntegerType())
BBOX = _struct(x0=DoubleType(), y0=DoubleType(), x1=DoubleType(), y1=DoubleType())
CHAR_BOX = _struct(ch=StringType(), l=DoubleType(), t=DoubleType(), r=DoubleType(), b=DoubleType())
RUN = _struct(n=IntegerType(), rgb=RGB)
SEGMENT = _struct(x0=DoubleType(), x1=DoubleType(), rgb=RGB)
STYLE = _struct(
    font_pt=DoubleType(), bold=BooleanType(), text_rgb=RGB, bg_rgb=RGB, est_pt=DoubleType(), stroke_rel=DoubleType(),
    bold_r=DoubleType(), max_fit_pt=DoubleType(), clamp_pt=DoubleType(), ink_top_px=DoubleType(), ink_bottom_px=DoubleType(),
    cover_x0_px=DoubleType(), cover_x1_px=DoubleType(), runs=ArrayType(RUN), bg_segments=ArrayType(SEGMENT),
    highlight_removed=BooleanType(), vertical=BooleanType(), strikethrough=BooleanType(), superscript_tail=IntegerType(),
)
LINE = _struct(
    deck_id=StringType(), page_no=IntegerType(), line_id=LongType(), pos=IntegerType(), text=StringType(), bbox=BBOX, score=DoubleType(),
    angle=DoubleType(), center=_struct(x=DoubleType(), y=DoubleType()), size=_struct(w=DoubleType(), h=DoubleType()),
    char_boxes=ArrayType(CHAR_BOX), arc_sagitta=DoubleType(), style=STYLE,
)
LAYOUT_PAGE = _struct(
    deck_id=StringType(), page_no=IntegerType(), img_w=IntegerType(), img_h=IntegerType(), page_w_pt=DoubleType(), page_h_pt=DoubleType(), rgb=BinaryType(), png=BinaryType()
)
DECK_TEXT = _struct(side=StringType(), slide=IntegerType(), shape_idx=IntegerType(), text=StringType())
