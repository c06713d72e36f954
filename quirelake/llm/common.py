"""Shared pieces: staging tables, word splitting, window hashes, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MASK_TABLE = bytes(
    (b + 32) if 65 <= b <= 90 else (b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32)
    for b in range(256)
)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- staging


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Where that is unset, a temporary folder is made and recorded in the session if all runs on
    one machine, as in tests; on a cluster, whose executors could not see it, this raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quirelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


class Stage:
    """Written tables of one operator run, in the shared folder.

    ``cut`` writes a DataFrame and reads it back, which ends its lineage: a lost
    executor never replays what stands before it. ``drop`` removes tables that no
    later step reads; whatever is left goes at interpreter exit.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quirelake-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, self.root)

    def cut(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", codec).parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def cut_buckets(self, df: DataFrame, name: str, key: str, n: int) -> DataFrame:
        """A table bucketed by ``key``, so later groupings by it need no shuffle.

        The catalog is needed to name the buckets only: what is returned has the files and their
        buckets in its plan, and the name is dropped at once (the files are external to it).
        """
        table = f"quirelake_{uuid.uuid4().hex}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            (
                df.write.format("parquet")
                .mode("overwrite")
                .option("compression", "zstd")
                .option("path", f"{self.root}/{name}")
                .bucketBy(n, key)
                .saveAsTable(table)
            )
        finally:
            self.spark.conf.set(_CLEANUP, before)
        held = self.spark.table(table)
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        return held

    def drop(self, name: str) -> None:
        _remove(self.spark, f"{self.root}/{name}")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A DataFrame without rows that needs no Python worker."""
    fields = T._parse_datatype_string(schema).fields
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def bound_batches(spark: SparkSession) -> None:
    """Keep what crosses to Python at once small, also where texts are very long.

    Results are lazy, so the two settings must still hold when they are computed: they stay in
    the session, where they bound the Arrow batches of other queries too.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def text_bytes(df: DataFrame, text_col: str) -> tuple[int, int]:
    """Rows and bytes of text, by a scan of that one column."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text_col))).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0)


# ---------------------------------------------------------------- words


def space_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text; None has none."""
    return text.split() if text else []


def lower_space_words(text: bytes | None) -> list[bytes]:
    """As ``space_words`` with A-Z lower-cased and nothing else."""
    return text.lower().split() if text else []


def item_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased."""
    return text.translate(_MASK_TABLE).split() if text else []


_h64 = xxhash.xxh3_64_intdigest


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_h64, words), dtype=np.uint64, count=len(words))


def _stir(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash per window of ``width`` consecutive word hashes.

    Windows are put together from windows of 1, 2, 4, ... words, so the work is a few
    array operations per word for any width.
    """
    n = len(h)
    if n < width:
        return np.zeros(0, np.uint64)
    whole, whole_len, part, part_len = None, 0, h, 1
    while True:
        if width & part_len:
            if whole is None:
                whole, whole_len = part, part_len
            else:
                m = n - whole_len - part_len + 1
                whole = _stir(whole[:m] * _MUL + part[whole_len : whole_len + m])
                whole_len += part_len
        if part_len * 2 > width:
            return whole[: n - width + 1].copy() if whole_len == 1 else whole
        m = n - 2 * part_len + 1
        part = _stir(part[:m] * _MUL + part[part_len : part_len + m])
        part_len *= 2


def cover(starts: np.ndarray, width: int | np.ndarray, n: int) -> np.ndarray:
    """Boolean mask of n words that lie in ``[start, start + width)`` of any start."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(np.asarray(starts) + width, n), -1)
    return np.cumsum(delta[:n]) > 0


def in_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Membership of x in a sorted array."""
    if not len(table) or not len(x):
        return np.zeros(len(x), bool)
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x


# ---------------------------------------------------------------- components


def components(stage: Stage, edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges(a, b): rows (node, component), component the least node.

    Every round hooks each vertex to its least neighbour, jumps pointers twice and
    contracts the edge list, so rounds grow with the logarithm of a component's diameter.
    Minima are aggregated before the shuffle; a vertex of many edges is one row per task.
    """
    spark = stage.spark
    e = stage.cut(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        f"{name}-e0",
    )
    labels = None
    step = 0
    while not e.isEmpty():
        both = e.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(
            e.select(F.col("b").alias("v"), F.col("a").alias("w"))
        )
        parent = stage.cut(
            both.groupBy("v").agg(F.min("w").alias("p")).select("v", F.least("v", "p").alias("p")),
            f"{name}-p{step}",
        )
        for k in range(2):
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p"))
        parent = stage.cut(parent, f"{name}-q{step}")
        if labels is None:
            labels = parent.select(F.col("v").alias("node"), F.col("p").alias("component"))
        else:
            up = parent.select(F.col("v").alias("component"), F.col("p").alias("pp"))
            labels = labels.join(up, "component", "left").select(
                "node", F.coalesce("pp", "component").alias("component")
            )
        labels = stage.cut(labels, f"{name}-l{step}")
        pa = parent.select(F.col("v").alias("a"), F.col("p").alias("x"))
        pb = parent.select(F.col("v").alias("b"), F.col("p").alias("y"))
        e = stage.cut(
            e.join(pa, "a").join(pb, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            f"{name}-e{step + 1}",
        )
        step += 1
    if labels is None:
        return empty(spark, f"node {dict(edges.dtypes)['a']}, component {dict(edges.dtypes)['a']}")
    return labels
