"""Substring dedup by fixed-block anchors.

A window is ``width`` consecutive words of one document. Every document is cut into
non-overlapping blocks of (width + 1) // 2 words: each window holds one whole block, so a
window that occurs twice shares an indexed block with a rolling probe of its other place.

1. Documents are dealt into chunks by ranges of their order and written once, bucketed by
   chunk, so no later step shuffles text.
2. Index and probe: each chunk sends its distinct block-wide hashes, marked where they are
   indexed blocks, to hash-range buckets; a bucket answers which occur twice or more, one of
   them as an indexed block.
3. Extend: around these anchors each chunk forms the full windows, which is what joins hits to
   maximal exact repeats, and sends their distinct 96-bit hashes; a bucket answers every
   chunk but the first that holds one.
4. A chunk marks windows seen in earlier chunks or earlier in itself, and removes their words.

Windows are equal if their 64-bit hashes and 32 bits of a second hash are: among 10^13 windows,
two different ones agree by chance with a probability of 10^-3.

A chunk sends a hash once however often it holds it, so the largest group of copies costs a
bucket one entry per chunk. Messages are packed binaries of hashes in ranges.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, bound_batches, cover, empty, in_sorted, space_words, text_bytes, window_hashes, word_hashes

WIDTH = 20
CHUNK_BYTES = (8 << 20, 256 << 20)
BUCKET_WINDOWS = 3_000_000
_MESSAGE = "bucket int, chunk int, n int, payload binary"
_MESSAGE_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), ("payload", pa.binary())])
_SECOND = np.uint64(0xA0761D6478BD642F)


def _bucket(h32: np.ndarray, buckets: int) -> np.ndarray:
    """Range bucket of the upper 32 bits of a hash."""
    return (h32 * np.uint64(buckets)) >> np.uint64(32)


def _slices(bucket: np.ndarray, buckets: int):
    edge = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    return [(b, int(edge[b]), int(edge[b + 1])) for b in np.flatnonzero(np.diff(edge)).tolist()]


def _pack48(h: np.ndarray) -> bytes:
    return h.astype("<u4").tobytes() + (h >> np.uint64(32)).astype("<u2").tobytes()


def _unpack48(data: bytes, n: int) -> np.ndarray:
    low = np.frombuffer(data, "<u4", n).astype(np.uint64)
    return low | (np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32))


def _table(rows: list[tuple], schema: pa.Schema = _MESSAGE_ARROW) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _texts(table: pa.Table):
    for t in table.column("text"):
        yield space_words(t.as_py())


def _send_blocks(block: int, buckets: int):
    def send(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        hashes, aligned = [], []
        for words in _texts(docs):
            a = window_hashes(word_hashes(words), block) >> np.uint64(16)
            hashes.append(a)
            aligned.append(np.arange(len(a)) % block == 0)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        if not len(h):
            return _table([])
        order = np.argsort(h)
        h, marked = h[order], np.concatenate(aligned)[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        marked = np.logical_or.reduceat(marked, first)
        many = np.diff(np.append(first, len(h))) > 1
        h = h[first]
        rows = []
        for b, lo, hi in _slices(_bucket(h >> np.uint64(16), buckets), buckets):
            rows.append((b, chunk, hi - lo, _pack48(h[lo:hi]) + np.packbits(marked[lo:hi]).tobytes() + np.packbits(many[lo:hi]).tobytes()))
        return _table(rows)

    return send


def _find_anchors(key: tuple[pa.Scalar, ...], messages: pa.Table) -> pa.Table:
    """Per chunk, its hashes that occur twice or more and once at least as an indexed block."""
    chunks, sizes = messages.column("chunk").to_pylist(), messages.column("n").to_pylist()
    h, marked, many = [], [], []
    for data, n in zip(messages.column("payload"), sizes, strict=True):
        data = data.as_py()
        bits = np.frombuffer(data, np.uint8, offset=6 * n)
        half = -(-n // 8)
        h.append(_unpack48(data, n))
        marked.append(np.unpackbits(bits[:half], count=n))
        many.append(np.unpackbits(bits[half:], count=n))
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    h = np.concatenate(h)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    marked, many = np.concatenate(marked)[order], np.concatenate(many)[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    size = np.diff(np.append(first, len(h)))
    hit = (np.maximum.reduceat(marked, first) > 0) & ((size > 1) | (np.maximum.reduceat(many, first) > 0))
    keep = np.repeat(hit, size)
    return _answers(key[0].as_py(), chunks, owner[keep], _pack48, h[keep])


def _pack96(one: np.ndarray, two: np.ndarray) -> bytes:
    return one.astype("<u8").tobytes() + two.astype("<u4").tobytes()


def _answers(bucket: int, chunks: list[int], owner: np.ndarray, pack, *hashes: np.ndarray) -> pa.Table:
    """Hashes given back to the chunks they came from."""
    order = np.argsort(owner, kind="stable")
    owner, hashes = owner[order], [h[order] for h in hashes]
    edge = np.searchsorted(owner, np.arange(len(chunks) + 1))
    return _table([(bucket, c, int(edge[k + 1] - edge[k]), pack(*[h[edge[k] : edge[k + 1]] for h in hashes])) for k, c in enumerate(chunks) if edge[k + 1] > edge[k]])


def _received(replies: pa.Table, unpack) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(unpack(d.as_py(), n) for d, n in zip(replies.column("payload"), replies.column("n").to_pylist(), strict=True))])


def _send_windows(width: int, block: int, buckets: int):
    def send(key: tuple[pa.Scalar, ...], docs: pa.Table, replies: pa.Table) -> pa.Table:
        anchors = np.sort(_received(replies, _unpack48))
        if not len(anchors) or not docs.num_rows:
            return _table([])
        chunk = key[0].as_py()
        one, two = [], []
        for words in _texts(docs):
            if len(words) < width:
                continue
            h = word_hashes(words)
            hit = in_sorted(window_hashes(h, block) >> np.uint64(16), anchors)
            if not hit.any():
                continue
            # windows that hold an anchor: one starts at one of their first places
            run = np.concatenate(([0], np.cumsum(hit)))
            near = run[width - block + 1 :] > run[: len(run) - (width - block + 1)]
            one.append(window_hashes(h, width)[near])
            two.append((window_hashes(h ^ _SECOND, width) >> np.uint64(32))[near].astype(np.uint32))
        if not one:
            return _table([])
        one, two = np.concatenate(one), np.concatenate(two)
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        one, two = one[new], two[new]
        rows = []
        for b, lo, hi in _slices(_bucket(one >> np.uint64(32), buckets), buckets):
            rows.append((b, chunk, hi - lo, _pack96(one[lo:hi], two[lo:hi])))
        return _table(rows)

    return send


def _find_later(key: tuple[pa.Scalar, ...], messages: pa.Table) -> pa.Table:
    """Per chunk, its windows that an earlier chunk holds too."""
    chunks, sizes = messages.column("chunk").to_pylist(), messages.column("n").to_pylist()
    data = [d.as_py() for d in messages.column("payload")]
    one = np.concatenate([np.frombuffer(d, "<u8", n) for d, n in zip(data, sizes, strict=True)])
    two = np.concatenate([np.frombuffer(d, "<u4", n, 8 * n) for d, n in zip(data, sizes, strict=True)])
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    rank = np.asarray(chunks, np.int32)[owner]
    order = np.lexsort((rank, two, one))
    one, two, owner = one[order], two[order], owner[order]
    later = np.concatenate(([False], (one[1:] == one[:-1]) & (two[1:] == two[:-1])))
    return _answers(key[0].as_py(), chunks, owner[later], _pack96, one[later], two[later])


def _second(words: list[bytes], width: int) -> np.ndarray:
    return (window_hashes(word_hashes(words) ^ _SECOND, width) >> np.uint64(32)).astype(np.uint32)


def _starts_earlier(rolled: list[np.ndarray], texts, seen: tuple[np.ndarray, np.ndarray], width: int) -> np.ndarray:
    """Of all windows of a chunk in order, which are in ``seen`` or stand earlier in the chunk; ``texts``
    gives the words of each text again, and the second hash is made where the first one agrees."""
    flat = np.concatenate([np.zeros(0, np.uint64), *rolled])
    order = np.argsort(flat, kind="stable")
    same = flat[order][1:] == flat[order][:-1]
    known = in_sorted(flat, np.unique(seen[0]))
    maybe = known.copy()
    maybe[order[1:]] |= same
    maybe[order[:-1]] |= same
    two, at = np.zeros(len(flat), np.uint32), 0
    for r, words in zip(rolled, texts, strict=True):
        if maybe[at : at + len(r)].any():
            two[at : at + len(r)] = _second(words, width)
        at += len(r)
    place = np.flatnonzero(maybe)
    # what is in earlier chunks stands before all of this chunk
    one = np.concatenate((seen[0], flat[place]))
    both = np.concatenate((seen[1], two[place]))
    rank = np.concatenate((np.full(len(seen[0]), -1), place))
    order = np.lexsort((rank, both, one))
    one, both, rank = one[order], both[order], rank[order]
    again = np.concatenate(([False], (one[1:] == one[:-1]) & (both[1:] == both[:-1])))
    out = np.zeros(len(flat), bool)
    out[rank[again & (rank >= 0)]] = True
    return out


def _remove(width: int, with_text: bool, schema: pa.Schema):
    def remove(key: tuple[pa.Scalar, ...], docs: pa.Table, replies: pa.Table) -> pa.Table:
        unpack = lambda k, kind: _received(replies, lambda d, n: np.frombuffer(d, kind, n, 8 * n * k))
        seen = unpack(0, "<u8").astype(np.uint64), unpack(1, "<u4").astype(np.uint32)
        docs = docs.take(pc.sort_indices(docs, [("id", "ascending"), ("th", "ascending"), ("text", "ascending")], null_placement="at_start"))
        words = list(_texts(docs)) if docs.nbytes < (32 << 20) else None
        each = lambda: words if words is not None else _texts(docs)
        rolled = [window_hashes(word_hashes(w), width) for w in each()]
        gone = _starts_earlier(rolled, each(), seen, width)
        rows, at = [], 0
        for i, w, r in zip(docs.column("id"), each(), rolled, strict=True):
            starts = np.flatnonzero(gone[at : at + len(r)])
            at += len(r)
            out = cover(starts, width, len(w)) if len(starts) else None
            kept = b" ".join(w if out is None else compress(w, (~out).tolist()))
            rows.append((i.as_py(), len(w), 0 if out is None else int(out.sum()), kept.decode() if with_text else hashlib.sha256(kept).hexdigest()))
        return _table(rows, schema)

    return remove


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, and kept_text (kept words joined by one
    space), or kept_sha256 of it where ``with_text`` is false.

    Words are runs without ASCII blanks, unchanged. A word goes if a window of ``width`` words
    covers it whose words also start earlier: in a row of smaller id, or earlier in the same row.
    Defined cases: null and empty texts have no words; texts shorter than a window lose nothing;
    a null id comes before all others; rows that share an id are ordered by a hash of their text,
    so of equal rows one stays; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    stage = Stage(spark)
    block = (width + 1) // 2
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    id_type = base.schema["id"].dataType.simpleString()
    kept = "kept_text" if with_text else "kept_sha256"
    out_schema = f"doc_id {id_type}, n_words bigint, n_removed bigint, {kept} string"
    n, size = text_bytes(base, "text")
    if not n:
        return empty(spark, out_schema)
    chunk_bytes = min(max(CHUNK_BYTES[0], size // 2000), CHUNK_BYTES[1])
    chunks = max(1, -(-size // chunk_bytes))
    buckets = max(1, -(-size // 6 // BUCKET_WINDOWS))
    ranged = base.withColumn("th", F.xxhash64("text")).repartitionByRange(chunks, F.asc_nulls_first("id"), F.asc_nulls_first("th"))
    staged = stage.cut_buckets(ranged.withColumn("chunk", F.spark_partition_id()), "docs", "chunk", min(max(1, chunks // 4), 50_000))

    by_chunk = lambda df: df.groupBy("chunk")
    blocks = by_chunk(staged.select("chunk", "text")).applyInArrow(_send_blocks(block, buckets), _MESSAGE)
    anchors = stage.cut(blocks.groupBy("bucket").applyInArrow(_find_anchors, _MESSAGE), "anchors")
    windows = by_chunk(staged.select("chunk", "text")).cogroup(by_chunk(anchors)).applyInArrow(_send_windows(width, block, buckets), _MESSAGE)
    later = stage.cut(windows.groupBy("bucket").applyInArrow(_find_later, _MESSAGE), "later")
    stage.drop("anchors")
    text_type = pa.int64() if id_type == "bigint" else None
    schema = pa.schema([("doc_id", text_type or _arrow_type(base)), ("n_words", pa.int64()), ("n_removed", pa.int64()), (kept, pa.string())])
    out = by_chunk(staged).cogroup(by_chunk(later)).applyInArrow(_remove(width, with_text, schema), out_schema)
    return out


def _arrow_type(base: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(base.schema["id"].dataType)


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, with_text=False)
