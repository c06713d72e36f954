"""Fuzzy recall of one deck's texts in another's."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C


def normal(text: str | None) -> str:
    """Compatibility form without any Unicode blank."""
    return "".join(unicodedata.normalize("NFKC", text or "").split())


@F.arrow_udf(T.StringType())
def normalized(text: pa.Array) -> pa.Array:
    return pa.array([normal(t.as_py()) for t in text], pa.string())


@F.arrow_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("text", T.StringType())]))
def best_match(needle: pa.Array, hay: pa.Array) -> pa.Array:
    """The first text of ``hay`` with the highest ratio above 0; (0, '') where there is none."""
    out = []
    for n, texts in zip(needle.to_pylist(), hay.to_pylist(), strict=True):
        top, name = 0.0, ""
        for t in texts or ():
            m = SequenceMatcher(None, n, t)
            # the cheap bounds never lie below the ratio
            if m.real_quick_ratio() > top and m.quick_ratio() > top and (r := m.ratio()) > top:
                top, name = r, t
        out.append({"score": top, "text": name})
    return pa.array(out, pa.struct([("score", pa.float64()), ("text", pa.string())]))


def matches(gen: DataFrame, ref: DataFrame) -> DataFrame:
    """For each reference text the best generated text of its slide: slide, shape_idx, text, score, near.

    Both have slide, shape_idx, text; empty texts take no part, and a slide that lacks generated
    texts leaves its reference texts without a match. The texts of one slide stand in one array beside
    each of its reference texts, so work and memory are bounded by the shapes of a slide. Slides behind the end of the shorter deck
    don't count.
    """
    clean = lambda d: d.withColumn("text", normalized("text")).where("text <> ''")
    hay = clean(gen).groupBy("slide").agg(F.transform(F.array_sort(F.collect_list(F.struct("shape_idx", "text"))), lambda e: e["text"]).alias("hay"))
    last = gen.agg(F.max("slide").alias("__last"))
    some = clean(ref).join(F.broadcast(last), F.col("slide") <= F.col("__last")).drop("__last")  # one row
    found = some.join(hay, "slide", "left").withColumn("m", best_match("text", "hay"))
    return found.select("slide", "shape_idx", "text", F.col("m.score").alias("score"), F.col("m.text").alias("near"))


def recall(found: DataFrame, threshold: float = C.MATCH_RATIO) -> DataFrame:
    """Matched and all texts by slide, and of all slides (slide null)."""
    hit = (F.col("score") >= threshold).cast("int")
    out = found.rollup("slide").agg(F.count(F.lit(1)).alias("total"), F.sum(hit).cast("long").alias("matched"))
    return out.withColumn("recall", F.col("matched") / F.greatest(F.lit(1), "total"))
