"""Digest queries of the corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, line_dedup, lm_scoring, mixing, near_dedup, neighbours, quality, substring_dedup, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Target weights of the sources; sources that are not named follow after all others.
TARGETS = {f"src{k}": w for k, w in enumerate((8, 1, 2, 3, 1, 2, 4, 1, 2, 3, 1, 2, 6, 1, 2, 3, 1, 2, 4, 1))}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return mixing.mix(docs, TARGETS)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: Schemas that the calls of ``with_calls`` are held against.
TOOLS = (
    ("search", '{"properties":{"q":{"type":"string"},"top":{"type":"integer","enum":[1,2,3]}},"required":["q"],"additionalProperties":false}'),
    ("count", '{"properties":{"n":{"type":"integer"},"unit":{"type":"string"}},"required":["n","unit"]}'),
)


def with_calls(messages: DataFrame) -> DataFrame:
    """The turns of conversations, which hold no calls, told as conversations with tools.

    Of an assistant's turn t (t mod 4 = 1) become two calls, s<t> to search for the whole text and
    c<t> to count its characters, s after c, and c after the s of four turns before, up to four in a
    row; every seventh conversation has both after each other, every fifth calls its searches s alike, every third
    names no unit, every eleventh calls an unknown tool. The next turn, a user's, becomes the result
    of s<t>, of every sixth conversation one that no call waits for. All other turns stay.
    """
    c, t = F.col("conv_id"), F.col("turn")
    every = lambda n, k: c % n == k
    number = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    search = lambda n: F.when(every(5, 2), "s").otherwise(number("s", n))
    count = number("c", t)
    none = F.array().cast("array<string>")
    calls = F.array(
        F.struct(
            search(t).alias("id"), F.when(every(11, 4), "find").otherwise("search").alias("name"),
            F.to_json(F.struct((t % 5).alias("top"), F.coalesce("text", F.lit("")).alias("q"))).alias("arguments"), F.array(count).alias("depends_on"),
        ),
        F.struct(
            count.alias("id"), F.lit("count").alias("name"),
            F.to_json(F.struct(F.when(~every(3, 1), "char").alias("unit"), F.length(F.coalesce("text", F.lit(""))).alias("n"))).alias("arguments"),
            F.when(every(7, 3), F.array(search(t))).when(F.floor(t / 4) % 4 != 0, F.array(search(t - 4))).otherwise(none).alias("depends_on"),
        ),
    )
    calling, answering = (F.col("role") == "assistant") & (t % 4 == 1), (F.col("role") == "user") & (t % 4 == 2)
    answer = F.struct(F.when(every(6, 5), "lost").otherwise(search(t - 1)).alias("tool_call_id"), F.coalesce("text", F.lit("")).alias("content"))
    text = F.when(calling, F.to_json(F.struct(calls.alias("tool_calls")))).when(answering, F.to_json(answer)).otherwise(F.col("text"))
    return messages.select("conv_id", "turn", F.when(answering, "tool").otherwise(F.col("role")).alias("role"), text.alias("text"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("parameters")) for n, p in TOOLS])))
    return chat.format_chats(with_calls(_table(spark, sf_dir, "conversations")), tools)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_mixing, op2_decontaminate, op3_substring_dedup, op4_quality, op5_chat, op6_line_dedup, op7_neighbours, op8_toxicity, op9_near_dedup, op10_lm_scoring)}
