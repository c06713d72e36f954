"""LM scoring with Brown class-based bigrams.

p(w_i | w_{i-1}) = p(class_i | class_{i-1}) * p(w_i | class_i). The ``CLUSTERED`` most frequent
words are assigned to classes by exchange clustering, which moves one word at a time to the
class that raises the likelihood of the class bigrams most. All other words first go with one of
``TAIL`` groups by their ending, which are exchanged like words. Then every other word of the
training corpus, however rare, is exchanged by its own transitions: one sweep in which all of
them are judged against the same class bigrams. Only words that never occurred in training stay
with the class of their group. Transitions are counted again over the final classes and smoothed
with class frequencies; a word's share of its class is smoothed by adding ``DELTA``, with room
for one unknown word of each group.

All counts cover the whole training corpus. Tables that are broadcast or collected are bounded by
``HEAD``, ``CLUSTERED``, ``TAIL`` and ``CLASSES``; counts and classes of all other words are
tables that are joined by shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stage, bound_batches, lower_space_words

HEAD = 200_000
CLUSTERED = 1000
CLASSES = 96
TAIL = 384
SWEEPS = 6
ALPHA = 2.0
BETA = 0.1
DELTA = 0.5
END = b"\n"  # never a word
FLUSH = 400_000
HELD = 2_000_000  # transitions of one flush
PARTS = 512  # of the tasks whose bigrams are summed up first
ENTRIES = 20_000  # transitions judged at a time
_MARKS = b".,;:!?)\"'"


def tail_group(word: bytes) -> int:
    """Group of a word outside the clustered ones: by its last three bytes before final marks."""
    bare = word.rstrip(_MARKS)
    return xxhash.xxh3_64_intdigest(bare[-3:] + b" " * (len(bare) < len(word))) % TAIL


# ---------------------------------------------------------------- counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
    for batch in batches:
        for t in batch.column(0):
            seen.update(lower_space_words(t.as_py()))
            seen[END] += 1
            if len(seen) > FLUSH:
                yield flush()
                seen = Counter()
    if seen:
        yield flush()


@dataclass
class Units:
    """Ids of the broadcast words: rank in the head, and the bigram unit of each."""

    rank: dict[bytes, int]
    unit: np.ndarray  # of a head word: 0 is END, then the clustered words, then the groups
    clustered: int

    @property
    def size(self) -> int:
        return 1 + self.clustered + TAIL

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Head rank (-1 outside) and unit of each word."""
        rank = np.fromiter(map(self.rank.get, words, _minus()), np.int32, len(words))
        unit = self.unit[rank]
        for k in np.flatnonzero(rank < 0).tolist():
            unit[k] = 1 + self.clustered + tail_group(words[k])
        return rank, unit


def _minus() -> Iterator[int]:
    while True:
        yield -1


def make_units(head: list[tuple[bytes, int]], clustered: int) -> Units:
    words = [w for w, _ in head if w != END]
    rank = {END: 0} | {w: k + 1 for k, w in enumerate(words)}
    clustered = min(clustered, len(words))
    unit = np.zeros(len(words) + 2, np.int32)  # the last is for rank -1
    unit[1 : clustered + 1] = np.arange(1, clustered + 1)
    for k in range(clustered, len(words)):
        unit[k + 1] = 1 + clustered + tail_group(words[k])
    return Units(rank, unit, clustered)


def _bigrams(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units: Units = shared.value
        n, wait, held = units.size, [], 0
        total = np.zeros(n * n, np.int64)
        for batch in batches:
            for t in batch.column(0):
                _, u = units.ids(lower_space_words(t.as_py()))
                chain = np.concatenate(([0], u, [0])).astype(np.int64)
                wait.append(chain[:-1] * n + chain[1:])
                held += len(chain)
                if held > 1_000_000:
                    total += np.bincount(np.concatenate(wait), minlength=n * n)
                    wait, held = [], 0
        if wait:
            total += np.bincount(np.concatenate(wait), minlength=n * n)
        total = total.reshape(n, n)
        rows = np.flatnonzero(total.any(axis=1))
        part = TaskContext.get().partitionId() % PARTS
        load = [np.flatnonzero(total[r]).astype("<u2").tobytes() + total[r][total[r] > 0].astype("<i8").tobytes() for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(np.full(len(rows), part, np.int32)), pa.array(load, pa.binary())], ["u", "part", "load"])

    return run


def _add_rows(n: int):
    """Sum of the rows of a unit: first of one part of the tasks, then of all parts."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros(n, np.int64)
        for data in table.column("load"):
            data = data.as_py()
            k = len(data) // 10
            total[np.frombuffer(data, "<u2", k)] += np.frombuffer(data, "<i8", k, 2 * k)
        at = np.flatnonzero(total)
        load = at.astype("<u2").tobytes() + total[at].astype("<i8").tobytes()
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([load], pa.binary())], ["u", "load"])

    return run


# ---------------------------------------------------------------- classes


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit: 0 for the end, 1..classes for words and groups."""
    g = bigrams.astype(np.float64)
    n = len(g)
    classes = max(1, min(classes, n - 1))
    k = 1 + classes
    cls = np.zeros(n, np.int64)
    cls[1:] = 1 + np.arange(n - 1) % classes
    member = np.zeros((n, k))
    member[np.arange(n), cls] = 1
    to, fro = g @ member, g.T @ member  # of each unit, counts to and from each class
    b = member.T @ to
    out, into = b.sum(1), b.sum(0)
    own = np.arange(1, 1 + classes)
    for _ in range(sweeps):
        moved = 0
        for w in range(1, n):
            a, s = cls[w], g[w, w]
            r, c = to[w].copy(), fro[w].copy()
            r[a] -= s
            c[a] -= s
            b[a, :] -= r
            b[:, a] -= c
            b[a, a] -= s
            left, right = g[w].sum(), g[:, w].sum()
            out[a] -= left
            into[a] -= right
            base = _xlogx(b)
            rows = _xlogx(b[own] + r) - base[own]
            cols = _xlogx(b[:, own] + c[:, None]) - base[:, own]
            d = own - own[0]
            corner = _xlogx(b[own, own] + r[own] + c[own] + s) - base[own, own]
            gain = rows.sum(1) + cols.sum(0) - rows[d, own] - cols[own, d] + corner
            gain -= _xlogx(out[own] + left) - _xlogx(out[own]) + _xlogx(into[own] + right) - _xlogx(into[own])
            best = int(own[np.argmax(gain)])
            if gain[best - 1] <= gain[a - 1] + 1e-9:
                best = a
            b[best, :] += r
            b[:, best] += c
            b[best, best] += s
            out[best] += left
            into[best] += right
            if best != a:
                moved += 1
                cls[w] = best
                to[:, a] -= g[:, w]
                to[:, best] += g[:, w]
                fro[:, a] -= g[w]
                fro[:, best] += g[w]
        if not moved:
            break
    return cls


@dataclass
class Model:
    units: Units
    total: int
    types: int
    base: np.ndarray  # log10 of the base score of a head word
    emit: np.ndarray  # log10 p(word | class) of a head word
    cls: np.ndarray  # class of a unit
    step: np.ndarray  # log10 p(class | class)
    room: list[float]  # log10 of p(group | class) over the group's denominator
    pairs: np.ndarray  # class bigrams
    count: np.ndarray  # of a head word

    @property
    def group_cls(self) -> np.ndarray:
        return self.cls[1 + self.units.clustered :]


# ---------------------------------------------------------------- words outside the clustered ones

_ENCODED = "rid bigint, id {}, held_out boolean, chain binary, words array<binary>, groups array<int>"
_HITS = "word binary, keys binary, times binary"


def _encode(shared, id_type: pa.DataType):
    """Texts as head ranks; -1 - k stands for the k-th of the row's distinct other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units: Units = shared.value
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            chains, words, groups = [], [], []
            for t in batch.column(2):
                found = lower_space_words(t.as_py())
                chain = np.fromiter(map(units.rank.get, found, _minus()), np.int32, len(found))
                rest: dict[bytes, int] = {}
                for k in np.flatnonzero(chain < 0).tolist():
                    chain[k] = -1 - rest.setdefault(found[k], len(rest))
                chains.append(chain.astype("<i4").tobytes())
                words.append(list(rest))
                groups.append([tail_group(w) for w in rest])
            rid = pa.array(range(at, at + len(chains)), pa.int64())
            at += len(chains)
            yield pa.RecordBatch.from_arrays(
                [rid, batch.column(0).cast(id_type), batch.column(1), pa.array(chains, pa.binary()), pa.array(words, pa.list_(pa.binary())), pa.array(groups, pa.list_(pa.int32()))],
                ["rid", "id", "held_out", "chain", "words", "groups"],
            )

    return run


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary array of the values between starts."""
    ends = (np.append(starts, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])


def _transitions(shared):
    """Of each word outside the clustered ones: classes after it, and (from k on) before it, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, head_cls, group_cls, k = shared.value
        names = list(units.rank)
        head = len(names)
        rest: dict[bytes, int] = {}
        wait, held = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, n = np.unique(np.concatenate(wait), return_counts=True)
            word = key // (2 * k)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            other = list(rest)
            for i in range(0, len(starts), 20_000):
                part = starts[i : i + 20_000]
                end = starts[i + 20_000] if i + 20_000 < len(starts) else len(key)
                mine = [names[w] if w < head else other[w - head] for w in word[part].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mine, pa.binary()), _packed((key[part[0] : end] % (2 * k)).astype("<u2"), part - part[0]), _packed(n[part[0] : end].astype("<u4"), part - part[0])],
                    ["word", "keys", "times"],
                )

        for batch in batches:
            for chain, words, groups in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                rank = np.frombuffer(chain.as_py(), "<i4").astype(np.int64)
                words = words.as_py()
                cls, word = head_cls[np.maximum(rank, 0)], rank.copy()
                if words:
                    out = np.flatnonzero(rank < 0)
                    local = -1 - rank[out]
                    cls[out] = group_cls[np.array(groups.as_py())[local]]
                    word[out] = np.array([head + rest.setdefault(w, len(rest)) for w in words])[local]
                cls = np.concatenate(([0], cls, [0]))
                own = word > units.clustered
                wait += [word[own] * (2 * k) + cls[2:][own], word[own] * (2 * k) + k + cls[:-2][own]]
                held += 2 * int(own.sum())
                if held > HELD:
                    yield from flush()
                    rest.clear()
                    wait, held = [], 0
        if held:
            yield from flush()

    return run


def best_classes(pairs: np.ndarray, word: np.ndarray, key: np.ndarray, n: np.ndarray, now: np.ndarray) -> np.ndarray:
    """The class that raises the likelihood of the class bigrams most, for each word by itself.

    Transition e of word[e] (rising, every word present) goes to class key[e], or comes from class
    key[e] - k, and occurs n[e] times; ``pairs`` holds the words in the classes ``now``.
    """
    k = len(pairs)
    table = np.vstack([pairs.T, pairs]).astype(np.float64)  # of a key, the counts with each class
    level, starts = _xlogx(table), np.flatnonzero(np.diff(word, prepend=-1))
    size = np.bincount(word[key < k], n[key < k], len(now))
    a = now[word]
    e = np.arange(len(word))
    gain = _xlogx(table[key] + n[:, None]) - level[key]
    gain[e, a] = level[key, a] - _xlogx(np.maximum(table[key, a] - n, 0))
    gain = np.add.reduceat(gain, starts)
    w = np.arange(len(now))
    for side in (pairs.sum(1), pairs.sum(0)):
        loss = _xlogx(side + size[:, None]) - _xlogx(side)
        loss[w, now] = _xlogx(side)[now] - _xlogx(np.maximum(side[now] - size, 0))
        gain -= loss
    best = 1 + np.argmax(gain[:, 1:], axis=1)  # class 0 is the end alone
    return np.where(gain[w, best] > gain[w, now] + 1e-9, best, now)


def _decide(shared):
    """Count and class of each word, from its transitions in the order of words."""

    def judge(table: pa.Table) -> pa.RecordBatch:
        pairs, group_cls = shared.value
        k = len(pairs)
        words = table.column("word").combine_chunks()
        new = np.ones(len(words), bool)
        if len(words) > 1:
            new[1:] = pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)
        names = words.filter(pa.array(new)).to_pylist()
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), "<u2").astype(np.int64)
        times = np.frombuffer(b"".join(table.column("times").to_pylist()), "<u4")
        row = np.repeat(np.cumsum(new) - 1, pc.binary_length(table.column("keys")).to_numpy() // 2)
        at, back = np.unique(row * (2 * k) + keys, return_inverse=True)
        n = np.bincount(back, times)
        word, key = at // (2 * k), at % (2 * k)
        now = np.array([group_cls[tail_group(w)] for w in names], np.int64)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        cls, i = now.copy(), 0
        while i < len(names):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + ENTRIES)))
            end = starts[j] if j < len(names) else len(word)
            cls[i:j] = best_classes(pairs, word[starts[i] : end] - i, key[starts[i] : end], n[starts[i] : end], now[i:j])
            i = j
        count = np.bincount(word[key < k], n[key < k], len(names)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(count), pa.array(cls.astype(np.int32))], ["word", "c", "cls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            last = batch.column(0)[-1]
            if batch.column(0)[0] == last:
                continue  # a word that goes on
            whole = held.num_rows - pc.sum(pc.equal(batch.column(0), last)).as_py()
            yield judge(held.slice(0, whole))
            held = held.slice(whole)
        if held is not None:
            yield judge(held)

    return run


@dataclass
class Lexicon:
    """Classes of all words: of the head here, of the others in the table they were read from."""

    head_cls: np.ndarray
    room: np.ndarray  # log10 of the denominator of a word's share of its class


def exchange_words(encoded: DataFrame, model: Model, stage: Stage) -> tuple[DataFrame, Lexicon]:
    """Rows (word, c, cls) of all training words but the clustered ones and the end, and the lexicon."""
    spark, units = stage.spark, model.units
    k = len(model.pairs)
    head_cls = model.cls[units.unit[: len(model.count)]]
    shared = spark.sparkContext.broadcast((units, head_cls, model.group_cls, k))
    hits = encoded.where("NOT held_out").select("chain", "words", "groups").mapInArrow(_transitions(shared), _HITS)
    hits = hits.repartition("word").sortWithinPartitions("word")
    words = stage.cut(hits.mapInArrow(_decide(spark.sparkContext.broadcast((model.pairs, model.group_cls))), "word binary, c bigint, cls int"), "words")
    head_cls = head_cls.copy()
    if len(model.count) > units.clustered + 1:
        least = int(model.count[units.clustered + 1 :].min())
        for r in words.where(F.col("c") >= least).collect():  # the head, whose words are those of so many occurrences
            if (at := units.rank.get(bytes(r["word"]))) is not None:
                head_cls[at] = r["cls"]
    n, v = np.zeros(k), np.bincount(model.group_cls, minlength=k).astype(np.float64)
    for r in words.groupBy("cls").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n[r["cls"]] += r["n"]
        v[r["cls"]] += r["v"]
    seeds = head_cls[1 : units.clustered + 1]
    n += np.bincount(seeds, model.count[1 : units.clustered + 1], k)
    v += np.bincount(seeds, minlength=k)
    return words, Lexicon(head_cls, np.log10(np.maximum(n + DELTA * v, DELTA)))


def transition_scores(pairs: np.ndarray) -> np.ndarray:
    """log10 p(class | class), smoothed with class frequencies."""
    k = len(pairs)
    share = (pairs.sum(0) + 1) / (pairs.sum() + k)
    return np.log10((pairs + ALPHA * k * share) / (pairs.sum(1, keepdims=True) + ALPHA * k))


_FILLED = "id {}, held_out boolean, n_tokens bigint, known bigint, base double, emit double, classes binary"


def _fill(shared, id_type: pa.DataType):
    """Classes of all words of a text, and the scores that need no transition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_base, head_emit, head_cls, room, total = shared.value
        for batch in batches:
            rows = []
            for chain, cls, count in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                rank = np.frombuffer(chain.as_py(), "<i4")
                out = rank < 0
                head, local = rank[~out], -1 - rank[out]
                base, emit, known = head_base[head].sum() + head_base[0], head_emit[head].sum(), len(head) + 1
                classes = head_cls[np.maximum(rank, 0)]
                if len(local):
                    c, of = np.array(count.as_py(), np.float64), np.array(cls.as_py())
                    base += np.log10((c + 1) / total)[local].sum()
                    emit += (np.log10(c + DELTA) - room[of])[local].sum()
                    known += int((c > 0)[local].sum())
                    classes[out] = of[local]
                rows.append((len(rank) + 1, known, float(base), float(emit), classes.astype("<u2").tobytes()))
            n, known, base, emit, classes = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(id_type), batch.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(emit, pa.float64()), pa.array(classes, pa.binary())],
                ["id", "held_out", "n_tokens", "known", "base", "emit", "classes"],
            )

    return run


def _chain(classes: bytes) -> np.ndarray:
    return np.concatenate(([0], np.frombuffer(classes, "<u2"), [0])).astype(np.int64)


def _class_bigrams(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for t in batch.column(0):
                chain = _chain(t.as_py())
                np.add.at(total, chain[:-1] * k + chain[1:], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    return run


# ---------------------------------------------------------------- operator


def head_words(vocab: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words and the end token, at most ``most`` + 1, by falling count.

    Counts are put in classes of a twelfth of a doubling, of which there are a few hundred; whole
    classes are taken, so no more than the answer reaches the driver.
    """
    level = F.floor(F.log2("c") * 12).cast("int")
    sizes = vocab.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()
    taken, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["l"]):
        if taken + r["n"] > most:
            break
        taken, least = taken + r["n"], r["l"]
    wanted = (F.col("word") == F.lit(END)) | (level >= least if least is not None else F.lit(False))
    return sorted(((bytes(r["word"]), r["c"]) for r in vocab.where(wanted).collect()), key=lambda x: (-x[1], x[0]))


def train(train_texts: DataFrame, stage: Stage, head_size: int = HEAD, clustered: int = CLUSTERED, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model and the whole count table (word, c), from one binary text column."""
    spark = stage.spark
    vocab = stage.cut(train_texts.mapInArrow(_count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "vocab")
    total, types = (int(x or 0) for x in vocab.agg(F.sum("c"), F.count(F.lit(1))).first())
    head = head_words(vocab, head_size)
    units = make_units(head, clustered)
    n = units.size
    shared = spark.sparkContext.broadcast(units)
    table = train_texts.mapInArrow(_bigrams(shared), "u int, part int, load binary")
    for by in (["u", "part"], ["u"]):  # no group holds a row of every task
        table = table.groupBy(*by).applyInArrow(_add_rows(n), "u int, load binary")
    g = np.zeros((n, n), np.int64)
    for r in table.collect():  # at most n rows of n counts
        k = len(r["load"]) // 10
        g[r["u"], np.frombuffer(r["load"], "<u2", k)] = np.frombuffer(r["load"], "<i8", k, 2 * k)
    cls = exchange(g, classes)
    k = int(cls.max()) + 1
    member = np.zeros((n, k))
    member[np.arange(n), cls] = 1
    b = member.T @ g @ member
    step = transition_scores(b)

    count = np.zeros(len(units.rank), np.int64)
    for w, c in head:
        count[units.rank[w]] = c
    whole = vocab.withColumn("t", _tail_group("word")).groupBy("t").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    tail_n, tail_v = np.zeros(TAIL), np.zeros(TAIL)
    for r in whole:
        tail_n[r["t"]], tail_v[r["t"]] = r["n"], r["v"]
    for w, r in units.rank.items():  # END and the clustered words are no part of the groups
        if r <= units.clustered and count[r]:
            tail_n[tail_group(w)] -= count[r]
            tail_v[tail_group(w)] -= 1
    room = tail_n + DELTA * (tail_v + 1)
    unit = units.unit[: len(count)]
    mass = g.sum(0) + BETA
    in_class = np.log10(mass / np.bincount(cls, weights=mass, minlength=k)[cls])  # p(unit | class)
    tail = in_class[1 + units.clustered :]
    emit = in_class[unit].copy()
    mine = unit > units.clustered
    emit[mine] += np.log10((count[mine] + DELTA) / room[unit[mine] - 1 - units.clustered])
    base = np.log10((count + 1) / (total + types + 1))
    return Model(units, total, types, base, emit, cls, step, (tail - np.log10(room)).tolist(), b, count), vocab


@F.arrow_udf(T.IntegerType())
def _tail_group(word: pa.Array) -> pa.Array:
    return pa.array([tail_group(w.as_py()) for w in word], pa.int32())


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training rows are those whose crc32 of the id as text, modulo ``folds``, is not ``fold``; a
    null id trains. Defined cases: a null or empty text is its end token alone; repeated ids and
    rows give a row each; without any training row the model is the base; other columns are
    ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    stage = Stage(spark)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))
    base = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    model, _ = train(base.where("NOT held_out").select("text"), stage)
    stage.drop("vocab")
    from pyspark.sql.pandas.types import to_arrow_type

    kind = base.schema["id"].dataType
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    send = spark.sparkContext.broadcast
    encoded = stage.cut(base.mapInArrow(_encode(send(model.units), arrow), _ENCODED.format(name)), "encoded")
    words, lexicon = exchange_words(encoded, model, stage)

    rest = encoded.select("rid", F.posexplode(F.arrays_zip(F.col("words").alias("word"), F.col("groups").alias("g"))).alias("k", "w"))
    rest = rest.select("rid", "k", "w.word", "w.g").join(words, "word", "left")
    of_group = F.element_at(F.array(*[F.lit(int(c)) for c in model.group_cls]), F.col("g") + 1)
    found = F.struct("k", F.coalesce("cls", of_group).alias("cls"), F.coalesce("c", F.lit(0)).alias("c"))
    rest = rest.groupBy("rid").agg(F.array_sort(F.collect_list(found)).alias("found"))
    both = encoded.join(rest, "rid", "left").select("id", "held_out", "chain", F.col("found.cls").alias("cls"), F.col("found.c").alias("c"))
    emit = np.log10(model.count + DELTA) - lexicon.room[lexicon.head_cls]
    emit[0] = 0.0  # the end is alone in its class
    shared = send((model.base, emit, lexicon.head_cls, lexicon.room, float(model.total + model.types + 1)))
    filled = stage.cut(both.mapInArrow(_fill(shared, arrow), _FILLED.format(name)), "filled")
    stage.drop("encoded")
    stage.drop("words")

    k = len(model.pairs)
    pairs = np.zeros(k * k)
    for r in filled.where("NOT held_out").select("classes").mapInArrow(_class_bigrams(k), "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        pairs[r["at"]] = r["n"]
    step = send(transition_scores(pairs.reshape(k, k)))

    @F.arrow_udf(T.DoubleType())
    def steps(classes: pa.Array) -> pa.Array:
        chains = (_chain(t.as_py()) for t in classes)
        return pa.array([float(step.value[c[:-1], c[1:]].sum()) for c in chains], pa.float64())

    score = F.col("emit") + steps("classes") if model.total else F.col("base")
    return filled.select(
        F.col("id").alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("known") if model.total else F.lit(0)).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        score.alias("score"),
    )
