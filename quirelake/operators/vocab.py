"""Page vocabulary and the correction of one misread character."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config as C
from ..functions import text as T


def page_vocab(lines: DataFrame, run_class: str = C.VOCAB_CLASS) -> DataFrame:
    """(page, token, cnt): n-grams of two to four characters of confident lines."""
    sure = lines.where(F.col("score") >= C.VOCAB_MIN_SCORE)
    return sure.select("page", F.explode(T.ngrams("text", run_class=run_class)).alias("token")).groupBy("page", "token").agg(F.count(F.lit(1)).alias("cnt"))


def _masked(df: DataFrame, token: str) -> DataFrame:
    """A row for each character of a token, with that character masked."""
    mask = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.concat(F.left(F.col(token), i - 1), F.lit("\u0001"), F.substr(F.col(token), i + 1)))
    return df.withColumn("__m", F.explode(mask))


def vocab_match(cands: DataFrame, vocab: DataFrame) -> DataFrame:
    """(page, cand, fixed): the token of equal length that differs in one character and is more
    frequent than all others that do; no row where none leads.

    Words that differ in one character share a mask, so this is an equi-join.
    """
    left = _masked(cands.select("page", "cand").where("length(cand) > 0").distinct(), "cand")
    right = _masked(vocab.where("length(token) > 0"), "token")
    hits = left.join(right, ["page", "__m"]).where("cand <> token")
    w = Window.partitionBy("page", "cand")
    best = hits.withColumn("k", F.rank().over(w.orderBy(F.desc("cnt")))).where("k = 1").withColumn("leaders", F.count(F.lit(1)).over(w))
    return best.where("leaders = 1").select("page", "cand", F.col("token").alias("fixed"))


def correct_lines(lines: DataFrame, vocab: DataFrame, run_class: str = C.VOCAB_CLASS) -> DataFrame:
    """lines with uncertain short words replaced by the match of the page's vocabulary."""
    bare = T.strip("text")
    short = (F.col("score") < C.VOCAB_MIN_SCORE) & bare.rlike(f"^[{run_class}]{{2,4}}$")
    held = lines.withColumn("cand", F.when(short, bare))
    unknown = held.where("cand IS NOT NULL").select("page", "cand").distinct().join(vocab.withColumnRenamed("token", "cand"), ["page", "cand"], "left_anti")
    fixed = vocab_match(unknown, vocab)
    return held.join(fixed, ["page", "cand"], "left").withColumn("text", F.coalesce("fixed", "text")).drop("cand", "fixed")
