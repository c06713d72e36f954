"""Benchmark decontamination: broadcast hash set of normalised test n-grams.

Every benchmark item becomes windows of ``width`` consecutive normalised words (an item
of fewer words, but not none, is one window). Their hashes go to all executors; each
document is scanned once with rolling window hashes, hash hits are verified word by word,
and the words of verified hits are marked. Documents are never shuffled.

What is broadcast is bounded: items are streamed through the driver into slices of at most
``slice_windows`` windows (a longer item is split), each of some 40 bytes a window in packed
arrays, and a slice is one pass over the documents. One pass is enough for any usual
benchmark; more are cut from each other by a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stage, bound_batches, cover, in_sorted, item_words, window_hashes, word_hashes

WIDTH = 10
SLICE_WINDOWS = 2_000_000

_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_FOUND_ARROW = pa.struct(
    [("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]
)

Piece = tuple[str, list[bytes]]


class Grams:
    """Windows of one slice of items, packed: all words in one text, and by window length the
    sorted hashes, the different windows behind each, and the items that hold each window."""

    def __init__(self, pieces: list[Piece], width: int):
        self.names = sorted({item for item, _ in pieces})
        number = {item: k for k, item in enumerate(self.names)}
        words = [w for _, ws in pieces for w in ws]
        self.text = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.start = np.concatenate(([0], np.cumsum(size)))  # of each word, and one past the last
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        at = 0
        for item, ws in pieces:
            n = min(width, len(ws))
            if n:
                h = window_hashes(word_hashes(ws), n)
                found.setdefault(n, []).append((h, at + np.arange(len(h)), np.full(len(h), number[item])))
            at += len(ws)
        self.by_size = {n: self._table(n, *map(np.concatenate, zip(*some, strict=True))) for n, some in found.items()}

    def window(self, place: int, size: int) -> bytes:
        return self.text[self.start[place] : self.start[place + size] - 1]

    def _table(self, size: int, h: np.ndarray, place: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hashes; of each the first of its groups; of each group, of equal words, a place and the
        first of its items; the items of all groups."""
        order = np.lexsort((item, h))
        h, place, item = h[order], place[order], item[order]
        group = np.concatenate(([True], h[1:] != h[:-1]))
        for k in np.flatnonzero(~group):  # equal hashes are equal words but for chance
            group[k] = self.window(place[k], size) != self.window(place[k - 1], size)
        of = np.cumsum(group) - 1
        new = np.concatenate(([True], (of[1:] != of[:-1]) | (item[1:] != item[:-1])))
        first = np.flatnonzero(group)
        hashes, at = np.unique(h[first], return_index=True)
        items = np.concatenate(([0], np.cumsum(np.bincount(of[new], minlength=len(first)))))
        return hashes, np.append(at, len(first)).astype(np.int32), place[first].astype(np.int32), items.astype(np.int32), item[new].astype(np.int32)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged half-open word spans of verified windows, and the items they come from."""
        mask, items, h = None, set(), word_hashes(words)
        for size, (hashes, groups, place, first, owner) in self.by_size.items():
            rolled, hit = window_hashes(h, size), set()
            starts = np.flatnonzero(in_sorted(rolled, hashes))
            for at, k in zip(starts.tolist(), np.searchsorted(hashes, rolled[starts]).tolist(), strict=True):
                here = b" ".join(words[at : at + size])
                for g in range(groups[k], groups[k + 1]):
                    if self.window(place[g], size) == here:
                        mask = np.zeros(len(words), bool) if mask is None else mask
                        mask[at : at + size] = True
                        hit.add(g)
            for g in hit:
                items.update(owner[first[g] : first[g + 1]].tolist())
        return spans_of(mask) if mask is not None else [], {self.names[k] for k in items}


def pieces_of(items: DataFrame, width: int, most: int) -> Iterator[Piece]:
    """Items (i, t) as words, one after the other; an item of more than ``most`` windows in pieces
    that share the words of the windows between them."""
    for r in items.toLocalIterator():
        words = item_words(bytes(r["t"]))
        for at in range(0, max(1, len(words) - width + 1), most):
            yield r["i"], words[at : at + most + width - 1]


def slices_of(pieces: Iterator[Piece], width: int, most: int) -> Iterator[Grams]:
    """At least one slice; none has more than ``most`` windows."""
    held: list[Piece] = []
    n, empty = 0, True
    for item, words in pieces:
        more = max(1, len(words) - width + 1)
        if held and n + more > most:
            yield Grams(held, width)
            held, n, empty = [], 0, False
        held.append((item, words))
        n += more
    if held or empty:
        yield Grams(held, width)


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _finder(shared) -> Column:
    """Arrow UDF (text) -> found struct, for the grams in the broadcast ``shared``."""

    @F.arrow_udf(_FOUND)
    def found(text: pa.Array) -> pa.Array:
        grams, out = shared.value, []
        for value in text:
            words = item_words(value.as_py())
            spans, items = grams.find(words)
            out.append({"n_words": len(words), "starts": [s for s, _ in spans], "ends": [e for _, e in spans], "items": sorted(items)})
        return pa.array(out, _FOUND_ARROW)

    return found.asNondeterministic()


def _merge_spans(starts: list[int], ends: list[int], n: int) -> list[tuple[int, int]]:
    starts = np.asarray(starts, np.int64)
    return spans_of(cover(starts, np.asarray(ends, np.int64) - starts, n)) if len(starts) else []


@F.arrow_udf(_FOUND)
def _merged(both: pa.Array) -> pa.Array:
    out = []
    for x in both.to_pylist():
        a, b = x["a"], x["b"]
        spans = _merge_spans(a["starts"] + b["starts"], a["ends"] + b["ends"], b["n_words"])
        out.append({"n_words": b["n_words"], "starts": [s for s, _ in spans], "ends": [e for _, e in spans], "items": sorted({*a["items"], *b["items"]})})
    return pa.array(out, _FOUND_ARROW)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    slice_windows: int = SLICE_WINDOWS,
    out_col: str = "found",
) -> DataFrame:
    """Documents as they are, with a struct column ``out_col`` added.

    It has n_words, the starts and ends of the merged half-open word spans that benchmark
    windows cover, and the items (as strings, sorted) that have such windows. Defined cases:
    null or empty text has no words and no hits; a null item id or text takes no part; repeated
    items count once; an empty benchmark finds nothing; rows and all other columns are kept, and
    an input column named ``out_col`` is replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).cast("binary").alias("t")).dropna()
    docs = docs.drop(out_col)
    stage = None
    for k, grams in enumerate(slices_of(pieces_of(items, width, slice_windows), width, slice_windows)):
        now = _finder(spark.sparkContext.broadcast(grams))(F.col(text_col).cast("binary"))
        if k == 0:
            docs = docs.withColumn(out_col, now)
            continue
        stage = stage or Stage(spark)
        docs = stage.cut(docs, f"slice{k}").withColumn(out_col, _merged(F.struct(F.col(out_col).alias("a"), now.alias("b"))))
    return docs


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Drop every document with at least one verified benchmark window; all columns are kept."""
    return find_contamination(docs, benchmark, **options | {"out_col": "__found"}).where(F.size("__found.items") == 0).drop("__found")


def digest(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(docs.select(id_col, options.get("text_col", "text")), benchmark, **options)
    n_hit = F.aggregate(F.zip_with("found.starts", "found.ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        F.col(id_col).alias("doc_id"),
        F.col("found.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.size("found.items") > 0).alias("contaminated"),
    )
