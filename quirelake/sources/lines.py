"""Page lines derived from documents: a document is a page, a text line is a recognised line.

Geometry and style are integer functions of the ids, so any engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C


def raw_lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def page_lines(docs: DataFrame) -> DataFrame:
    """Columns page, pos, text, n, x0, y0, x1, y1, score, font_pt, est_pt, bold, stroke_rel, bold_r,
    text_rgb, bg_rgb (only the first channel varies), angle, arc (0 for most), vertical, and the centre
    and size of the turned box: cx, cy, w, h. Blank lines are left out."""
    i, p, n = F.col("doc_id"), F.col("pos"), F.length("line")
    x0 = ((i * 7 + p * 13) % 40 * 20).cast("double")
    y0 = (p * 30 + (i + p) % 3 * 5).cast("double")
    ladder = F.array(*[F.lit(float(s)) for s in C.FONT_LADDER])
    pt = F.get(ladder, ((i * 5 + p * 3) % 19).cast("int"))
    grey = lambda v: F.struct(v.cast("int").alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    turned = F.when((i * 17 + p * 11) % 23 == 5, 20.0).when((i * 17 + p * 11) % 23 == 9, -18.0).otherwise(0.0)
    lines = raw_lines(docs).where(F.length(F.trim(F.translate("line", "\t\r", "  "))) > 0)
    out = lines.select(
        i.alias("page"),
        p.cast("long").alias("pos"),
        F.col("line").alias("text"),
        n.alias("n"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + F.least(n, F.lit(60)) * 8).alias("x1"),
        (y0 + 20 + (i * 3 + p) % 5 * 4).alias("y1"),
        (((i + p * 7) % 21).cast("double") / 20).alias("score"),
        pt.alias("font_pt"),
        (pt + (p % 7 - 3).cast("double") * F.lit(0.3)).alias("est_pt"),
        ((i + p) % 4 == 0).alias("bold"),
        (((i * 11 + p * 5) % 20).cast("double") / 100).alias("stroke_rel"),
        F.when(p % 3 != 0, ((i * 13 + p * 7) % 60 - 20).cast("double") / 100).alias("bold_r"),
        grey((i * 3 + p) % 4 * 40).alias("text_rgb"),
        grey((i * 5 + p) % 4 * 20).alias("bg_rgb"),
        turned.alias("angle"),
        F.when((turned == 0) & ((i * 3 + p * 7) % 29 == 4), 16.0).otherwise(0.0).alias("arc"),
        ((i + p * 5) % 31 == 6).alias("vertical"),
    )
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    return out.withColumns({"cx": mid("x0", "x1"), "cy": mid("y0", "y1"), "w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0")})


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
