"""MinHash near-dedup with SetSketch registers.

A document's set is its distinct five-word shingles. Its sketch has ``M`` registers
floor(1 - log_b(min of exponential hash values)), cut off to 8 bits: exponentially spaced,
truncated minima, which merge by maximum and agree between similar sets. Five registers
make a band; documents that share a band are candidates, a joint likelihood over the
registers that are equal, greater and less estimates their similarity, and candidates that
pass are verified on full shingle sets.

At a similarity of 0.75 all 60 bands miss with probability (1 - 0.75^5)^60 = 9e-8, and the
estimate has a deviation of 0.025 against a margin of 0.13.

Groups of copies stay linear: equal sets are one class from the start; in each bucket of a
band, members are compared with a centre. Members that are
then still in another component than others of their bucket are compared with all of those,
register by register in blocks of about ``BLOCK`` rows and ``BLOCK_SHINGLES`` shingles, and only
links come out. Nothing is collected to the driver, and no bucket is gathered into one task.

A class has a number of its own, so rows that share an id but not their text are classes of
their own too. Sets are equal if a 128-bit hash of their sorted 64-bit shingle hashes is: among
10^11 different sets, two agree by chance with a probability of 10^-5 by the shingle hashes and
less by the other; links of unequal sets are confirmed on the words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Stage, bound_batches, components, in_sorted, lower_space_words, window_hashes, word_hashes

SHINGLE = 5
PERCENT = 75
M, BAND = 300, 5
BASE, RATE = 1.085, 20.0
ESTIMATE = 0.62
EQUAL = 181  # registers; of 226 expected at 0.75, six deviations less
ROUNDS = 1
BLOCK = 1024
BLOCK_SHINGLES = 2_000_000
SMALL = 8  # buckets up to this size are compared pair by pair

_rng = np.random.default_rng(20240613)
_MULT = _rng.integers(0, 2**31, M, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, M, dtype=np.uint64).astype(np.uint32)


def shingle_hashes(words: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(width, len(words))))


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers, uint8[M]."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(M, 0xFFFFFFFF, np.uint32)
    buffer = np.empty((64, M), np.uint32)  # stays in the processor's cache
    for k in range(0, len(x), 64):
        block = buffer[: min(64, len(x) - k)]
        np.multiply(x[k : k + 64, None], _MULT, out=block)
        block += _ADD
        np.minimum(least, block.min(axis=0), out=least)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, 255).astype(np.uint8)


_GRID = np.linspace(0, 1, 41)


def joint_estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of each pair, from registers (rows) and set sizes."""
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.minimum(_GRID[None, :] * 1.0, np.minimum(u / v, v / u))
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - v * j), p(v - u * j)
    same = np.clip(1 - more - less, 1e-12, 1)
    up, down = (ra > rb).sum(1)[:, None], (ra < rb).sum(1)[:, None]
    like = up * np.log(more) + down * np.log(less) + (M - up - down) * np.log(same)
    return j[np.arange(len(j)), like.argmax(1)]


_SKETCH = T.StructType([T.StructField("n", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("regs", T.BinaryType())])
_SKETCH_ARROW = pa.struct([("n", pa.int64()), ("fp", pa.binary()), ("regs", pa.binary())])


@F.arrow_udf(_SKETCH)
def _sketch(text: pa.Array) -> pa.Array:
    out = []
    for t in text:
        h = shingle_hashes(lower_space_words(t.as_py()))
        out.append({"n": len(h), "fp": xxhash.xxh3_128_digest(h.tobytes()), "regs": registers(h).tobytes() if len(h) else None})
    return pa.array(out, _SKETCH_ARROW)


@F.arrow_udf(T.DoubleType())
def _estimate(ra: pa.Array, rb: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
    stack = lambda r: np.frombuffer(b"".join(r.to_pylist()), np.uint8).reshape(len(r), M)
    size = lambda n: n.to_numpy(zero_copy_only=False).astype(np.float64)
    return pa.array(joint_estimate(stack(ra), stack(rb), size(na), size(nb)), pa.float64()) if len(ra) else pa.array([], pa.float64())


def exact_shingles(text: bytes | None, width: int = SHINGLE) -> set:
    words = lower_space_words(text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width)), strict=False))


def similar(a: set, b: set) -> bool:
    both = len(a & b)
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


@F.arrow_udf(T.BooleanType())
def _linked(a: pa.Array, b: pa.Array) -> pa.Array:
    out, last, held = [], None, set()
    for x, y in zip(a, b, strict=True):
        x = x.as_py()
        if x != last:
            last, held = x, exact_shingles(x)
        out.append(similar(held, exact_shingles(y.as_py())))
    return pa.array(out, pa.bool_())


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, stage: Stage, name: str) -> DataFrame:
    """Of pairs(a, b), those that are linked: sizes, then the joint estimate, then full sets."""
    side = lambda s: classes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("regs").alias(f"r{s}"))
    held = pairs.join(side("a"), "a").join(side("b"), "b")
    held = held.where("100 * least(na, nb) >= 75 * greatest(na, nb)")
    held = held.where(_estimate("ra", "rb", "na", "nb") >= ESTIMATE).select("a", "b")
    held = stage.cut(held, f"{name}-likely")
    text = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias(f"t{s}"))
    both = held.join(text("a"), "a").join(text("b"), "b")
    return stage.cut(both.where(_linked("ta", "tb")).select("a", "b"), f"{name}-links")


_LIKELY = "gid bigint, i int, j int, node bigint, partners array<bigint>"
_LIKELY_ARROW = pa.schema([("gid", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("node", pa.int64()), ("partners", pa.list_(pa.int64()))])


def _compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Likely partners, within one block, of the rows that stand out (side 0): a row for each that
    has some, and a row without partners for each partner."""
    nodes, comp = rows.column("node").to_pylist(), rows.column("comp").to_numpy()
    regs = np.frombuffer(b"".join(rows.column("regs").to_pylist()), np.uint8).reshape(len(nodes), M)
    n, side = rows.column("n").to_numpy().astype(np.float64), rows.column("side").to_numpy()
    left, partners, met = np.flatnonzero(side == 0), {}, set()
    for k in range(0, len(left), 16):
        some = left[k : k + 16]
        same = (regs[some][:, None, :] == regs[None, :, :]).sum(2, dtype=np.int16) >= EQUAL
        same &= comp[some][:, None] != comp[None, :]
        same &= 4 * np.minimum(n[some][:, None], n) >= 3 * np.maximum(n[some][:, None], n)
        same &= (side == 1) | (np.arange(len(nodes)) < some[:, None])  # two that stand out meet once
        i, y = np.nonzero(same)
        x = some[i]
        if len(x):
            keep = joint_estimate(regs[x], regs[y], n[x], n[y]) >= ESTIMATE
            for a, b in zip(x[keep].tolist(), y[keep].tolist(), strict=True):
                partners.setdefault(a, []).append(b)
                met.add(b)
    out = [(nodes[a], [nodes[b] for b in bs]) for a, bs in partners.items()] + [(nodes[b], []) for b in met - partners.keys()]
    gid, i, j = (k.as_py() for k in key)
    columns = [[gid] * len(out), [i] * len(out), [j] * len(out), [a for a, _ in out], [b for _, b in out]]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _LIKELY_ARROW, strict=True)], schema=_LIKELY_ARROW)


def _confirm(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Links among likely partners of a block: counted on full hashed sets, then on the words."""
    nodes = rows.column("node").to_pylist()
    at = {r: k for k, r in enumerate(nodes)}
    text, x, y = rows.column("text"), [], []
    sets = [shingle_hashes(lower_space_words(t.as_py())) for t in text]
    for k, some in enumerate(rows.column("partners").to_pylist()):
        if not some:
            continue
        other = [at[b] for b in some]
        size = np.array([len(sets[b]) for b in other])
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        both = np.add.reduceat(in_sorted(np.concatenate([sets[b] for b in other]), sets[k]), start, dtype=np.int64)
        mine = None
        for m in np.flatnonzero(100 * both >= PERCENT * (size + len(sets[k]) - both)).tolist():
            mine = exact_shingles(text[k].as_py()) if mine is None else mine
            if similar(mine, exact_shingles(text[other[m]].as_py())):
                x.append(nodes[k])
                y.append(nodes[other[m]])
    return pa.table([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])


def _linked_in_blocks(placed: DataFrame, open_keys: DataFrame, classes: DataFrame, texts: DataFrame, stage: Stage) -> DataFrame:
    """Links (a, b) between members of one bucket that are of different components.

    Buckets whose largest component holds a quarter of them are taken together by that component,
    which spares comparing the same members once a band; other buckets stand alone. Members
    outside the largest component stand out. They and the others are dealt into blocks, and each
    block of the former meets each block of either; texts come only to likely partners.
    """
    gid = F.when(F.col("most") * 4 >= F.col("all"), F.xxhash64(F.lit(1), "main")).otherwise(F.col("key"))
    rows = placed.join(open_keys, "key").select(gid.alias("gid"), "node", "comp", (F.col("comp") != F.col("main")).alias("out"))
    rows = rows.groupBy("gid", "node", "comp").agg(F.max("out").alias("out")).join(classes.select("node", "n", "regs"), "node")
    rows = stage.cut(rows, "blocks")
    sum_of = lambda c, x: F.sum(F.when(c, x).otherwise(0))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(sum_of(c, F.lit(1)) / BLOCK), F.ceil(sum_of(c, F.col("n")) / BLOCK_SHINGLES)).cast("int")
    sizes = rows.groupBy("gid").agg(blocks(F.col("out")).alias("few"), blocks(~F.col("out")).alias("rest"))
    rows = rows.join(stage.cut(sizes, "block-sizes"), "gid")  # a table, so a large group's side of the join can be split
    at = F.when(F.col("out"), F.pmod(F.xxhash64("node"), "few")).otherwise(F.col("few") + F.pmod(F.xxhash64("node"), "rest"))
    rows = rows.withColumn("at", at.cast("int"))
    # groups (i, j): i a block of those that stand out, j >= i any block
    as_left = F.transform(F.sequence(F.col("at"), F.col("few") + F.col("rest") - 1), lambda j: F.struct(F.col("at").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    top = F.least(F.col("at"), F.col("few")) - 1
    as_right = F.when(top >= 0, F.transform(F.sequence(F.lit(0), top), lambda i: F.struct(i.alias("i"), F.col("at").alias("j"), F.lit(1).alias("side")))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    places = F.when(F.col("out"), F.concat(as_left, as_right)).otherwise(as_right)
    dealt = rows.select("gid", "node", "comp", "n", "regs", F.inline(places))
    likely = stage.cut(dealt.groupBy("gid", "i", "j").applyInArrow(_compare, _LIKELY), "likely-blocks")
    held = likely.join(texts, "node")
    return stage.cut(held.groupBy("gid", "i", "j").applyInArrow(_confirm, "a bigint, b bigint").distinct(), "links-blocks")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id reachable), kept.

    Documents are linked when 100 * intersection >= 75 * union of their shingle sets. Defined
    cases: null, empty and blank texts have no shingles and are linked with nothing; rows that
    share an id are one document in several parts, so what any of them is linked with is one
    component; a null id stays alone with a null component and is kept; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    stage = Stage(spark)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = stage.cut(
        base.select("id", F.xxhash64("text").alias("th"), _sketch(F.col("text").cast("binary")).alias("s")).select("id", "th", "s.*"), "sketch"
    )
    known = sketched.where("id IS NOT NULL")
    classes = known.where("n > 0").groupBy("fp").agg(F.min(F.struct("id", "th", "n", "regs")).alias("m"))
    # the numbers are written with the classes, so they hold for all that follows
    classes = stage.cut(classes.select(F.monotonically_increasing_id().alias("node"), "fp", "m.*"), "classes")
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("regs", BAND * i + 1, BAND)) for i in range(M // BAND)])
    bands = classes.select("node", F.explode(keys).alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    members = stage.cut(bands.join(shared, "key"), "members")
    nodes = stage.cut(members.select("node").distinct(), "nodes")
    wanted = classes.join(nodes, "node", "left_semi").select("id", "th", "node")
    # equal rows of one id and text give the same text
    texts = stage.cut(
        base.withColumn("th", F.xxhash64("text")).join(wanted, ["id", "th"]).select("node", F.col("text").cast("binary").alias("text")).dropDuplicates(["node"]),
        "texts",
        "zstd",
    )

    # an id with several texts joins their classes
    parts = known.where("n > 0").select("id", "fp").join(classes.select("fp", "node"), "fp").select("id", "node")
    several = parts.groupBy("id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("id", "lo")
    links = stage.cut(parts.join(several, "id").select(F.col("lo").alias("a"), F.col("node").alias("b")).where("a <> b").distinct(), "parts")
    labels = components(stage, links, "cc-parts")
    checked = None
    for step in range(ROUNDS + 1):
        placed = members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
        placed = stage.cut(placed, f"placed{step}")
        stage.drop(f"placed{step - 1}")
        by_comp = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
        by_key = stage.cut(
            by_comp.groupBy("key").agg(F.sum("c").alias("all"), F.max(F.struct("c", "comp")).alias("m")).where(F.col("m.c") < F.col("all")).select("key", "all", F.col("m.c").alias("most"), F.col("m.comp").alias("main")),
            f"open{step}",
        )
        if by_key.isEmpty():
            break
        if step == ROUNDS:
            few = placed.join(by_key.where(F.col("all") <= SMALL).select("key"), "key")
            other = few.select("key", F.col("node").alias("y"), F.col("comp").alias("cy"))
            pairs = few.join(other, "key").where("node < y AND comp <> cy").select(F.col("node").alias("a"), F.col("y").alias("b")).distinct()
            if checked is not None:
                pairs = pairs.join(checked, ["a", "b"], "left_anti")
            found = _verified(stage.cut(pairs, "pairs-small"), classes, texts, stage, "small")
            found = found.unionByName(_linked_in_blocks(placed, by_key.where(F.col("all") > SMALL), classes, texts, stage))
        else:
            centre = placed.groupBy("key").agg(F.min(F.struct((F.xxhash64("node", F.lit(step)) if step else F.col("node")).alias("o"), "node", "comp")).alias("m"))
            centre = centre.select("key", F.col("m.node").alias("y"), F.col("m.comp").alias("cy"))
            pairs = placed.join(by_key.select("key"), "key", "left_semi").join(centre, "key").where("comp <> cy").select(F.col("node").alias("x"), "y")
            pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
            pairs = stage.cut(pairs if checked is None else pairs.join(checked, ["a", "b"], "left_anti"), f"pairs{step}")
            checked = pairs if checked is None else checked.unionByName(pairs)
            found = _verified(pairs, classes, texts, stage, f"v{step}")
        if found.isEmpty():
            continue
        links = links.unionByName(found)
        labels = components(stage, links, f"cc{step}")
    # the least id of a component, over all its classes
    placed = classes.select("node", "fp", "id").join(labels, "node", "left").select("fp", "id", F.coalesce("component", "node").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("id").alias("least"))
    named = placed.join(least, "comp").select("fp", "least")
    out = sketched.join(named, "fp", "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("least")), "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), comp.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without the later members of each component.

    Rows of one id (or without id) and equal text become one, of several the one whose columns have
    the least hash; rows of one id and different texts are one document in several parts and stay
    or go together.
    """
    gone = near_duplicates(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct()
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    same = Window.partitionBy(id_col, "__h1", "__h2").orderBy(F.xxhash64(*plain))
    left = docs.join(gone, id_col, "left_anti").withColumns({"__h1": F.xxhash64(text_col), "__h2": F.xxhash64(F.lit(1), text_col)})
    return left.withColumn("__k", F.row_number().over(same)).where("__k = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
