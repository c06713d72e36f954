import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirelake.llm import common, decontaminate, line_dedup, lm_scoring, near_dedup, quality, substring_dedup, toxicity

from .fixtures import SCHEMA, documents, frame

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def key(rows):
    return sorted(rows, key=repr)


def test_words_and_windows():
    for t in ("", "A b\tc\x0bd\x1ce", "Ünï-x9 漢字\x7fz", "a b c d"):
        assert [w.decode() for w in common.space_words(t.encode())] == BLANK.findall(t)
        assert [w.decode() for w in common.item_words(t.encode())] == ITEM.findall(lower(t))
    h = common.word_hashes([b"%d" % (k % 50) for k in range(400)])
    for width in (1, 2, 3, 5, 7, 10, 20, 33):
        got = common.window_hashes(h, width)
        by_words = collections.defaultdict(set)
        for k in range(len(h) - width + 1):
            by_words[tuple(h[k : k + width])].add(got[k])
        assert len(got) == len(h) - width + 1 and all(len(v) == 1 for v in by_words.values())
        assert len(set(got)) == len(by_words)


def test_staging_needs_a_shared_folder():
    class Session:
        def __init__(self, master):
            self.conf, self.sparkContext, self.master = self, self, master

        def get(self, key, default):
            return default

        def set(self, key, value):
            self.kept = value

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            common.shared_dir(Session(master))
    alone = Session("local[4]")
    assert common.shared_dir(alone) == alone.kept


def test_windows_are_told_apart_by_both_hashes():
    """Windows whose first hash agrees by chance are not taken for equal."""
    texts = [[b"a%d" % k for k in range(25)], [b"b%d" % k for k in range(25)], [b"a%d" % k for k in range(25)]]
    rolled = [common.window_hashes(common.word_hashes(t), 20) for t in texts]
    rolled[1] = rolled[0].copy()  # as if the first hashes met
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    assert substring_dedup._starts_earlier(rolled, texts, none, 20).tolist() == [False] * 12 + [True] * 6
    seen = rolled[0][:2], substring_dedup._second(texts[1], 20)[:2]  # of another window than the first text's
    assert substring_dedup._starts_earlier(rolled, texts, seen, 20).tolist() == [False] * 6 + [True] * 2 + [False] * 4 + [True] * 6
    assert substring_dedup._starts_earlier([], [], none, 20).tolist() == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 9), (5, 5), (9, 8), (3, 1), (20, 3)] + [(k, k + 1) for k in range(100, 140)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(common.Stage(spark), df, "t").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, 9: 7} | dict.fromkeys(range(100, 141), 100)
    assert common.components(common.Stage(spark), df.limit(0), "t").count() == 0


def brute_hits(text, items, width=10):
    w = ITEM.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        iw = ITEM.findall(lower(t))
        size = min(width, len(iw))
        grams = {tuple(iw[k : k + size]) for k in range(len(iw) - size + 1)} if iw else set()
        for k in range(len(w) - size + 1):
            if tuple(w[k : k + size]) in grams:
                hit.update(range(k, k + size))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("slice_windows", [1 << 20, 7])
def test_decontaminate(spark, slice_windows):
    rows = documents()
    items = [(1, " ".join(rows[3][1].split()[2:16])), (10, "ONE"), (2, "漢字"), (3, None), (4, ""), (5, rows[8][1]), (5, rows[8][1]), (None, "one"), (6, "no such words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(frame(spark, rows), bench, slice_windows=slice_windows).collect()
    known = [(i, t) for i, t in items if i is not None and t is not None]
    assert key(tuple(r) for r in got) == key((r[0], *brute_hits(r[1], known)) for r in rows)
    assert decontaminate.digest(frame(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.remove_contaminated(frame(spark, rows).limit(0), bench).count() == 0
    assert "found" in decontaminate.remove_contaminated(frame(spark, rows), bench).columns  # a column of the input


def test_grams_are_packed():
    pieces = [("a", b"x y x y x y x".split()), ("b", b"x y x".split()), ("c", [])]
    grams = decontaminate.Grams(pieces, 3)
    hashes, groups, place, first, owner = grams.by_size[3]
    assert len(hashes) == 2 and sorted(grams.window(p, 3) for p in place) == [b"x y x", b"y x y"] and sorted(owner.tolist()) == [0, 0, 1]
    assert grams.find(b"z x y x y".split()) == ([(1, 5)], {"a", "b"}) and grams.find(b"y x y".split()) == ([(0, 3)], {"a"})
    long = [("a", [b"w%d" % k for k in range(50)])]
    parts = list(decontaminate.slices_of(iter([("a", long[0][1][k : k + 9]) for k in range(0, 41, 7)]), 3, 7))
    assert all(sum(len(t[4]) for t in g.by_size.values()) <= 7 for g in parts)


def test_substring_dedup(spark):
    rows = documents()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, want = set(), []
    for i, t, *_ in order:
        w = BLANK.findall(t or "")
        gone = set()
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone.update(range(k, k + 20))
            seen.add(g)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in substring_dedup.digest(frame(spark, rows)).collect()]
    assert key(got) == key(want) and sum(r[2] for r in got) > 100
    substring_dedup.CHUNK_BYTES, before = (2000, 1 << 20), substring_dedup.CHUNK_BYTES
    substring_dedup.BUCKET_WINDOWS, windows = 500, substring_dedup.BUCKET_WINDOWS
    try:  # many chunks and buckets
        assert key(tuple(r) for r in substring_dedup.digest(frame(spark, rows)).collect()) == key(want)
    finally:
        substring_dedup.CHUNK_BYTES, substring_dedup.BUCKET_WINDOWS = before, windows
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("quirelake")]  # nothing stays in the catalog
    texts = substring_dedup.remove_repeats(frame(spark, rows)).where("doc_id = 206").first()
    assert texts["kept_text"] == "a b c d"
    assert substring_dedup.digest(frame(spark, rows).limit(0)).count() == 0


def shingles(t):
    w = BLANK.findall(lower(t))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if s and t and 100 * both >= 75 * (len(s) + len(t) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def test_near_duplicates(spark):
    rows = documents(n=80)
    comp = brute_components(rows)
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    want = [(i, len(shingles(t)), comp.get(i), i is None or comp[i] == i) for i, t, *_ in rows]
    assert key(tuple(r) for r in got) == key(want)
    assert sum(1 for i, c in comp.items() if i != c) > 8
    kept = near_dedup.keep_one(frame(spark, rows))
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, c in comp.items() if i == c) and None in ids
    assert near_dedup.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_near_duplicates_with_repeated_ids(spark):
    """An id with several texts joins what each of them is linked with, in any order of rows."""
    rng = random.Random(9)
    rows = []
    for g in range(20):
        a, b = ([f"{x}{g}_{rng.randrange(10**6)}" for _ in range(60)] for x in "ab")
        near = lambda w: " ".join([*w[:30], "edit", *w[31:]])
        rows += [(4 * g + 1, " ".join(a)), (4 * g + 1, " ".join(b)), (4 * g + 2, near(b)), (4 * g + 3, near(a))]
    rows += [(1, rows[0][1]), (1, None), (None, rows[0][1]), (None, rows[0][1])]
    for n in (1, 3, 5):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        got = {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()}
        assert got == {(i, c) for i, c in brute_components(rows).items()} | {(None, None)}
        assert {c for i, c in got if i} == {4 * g + 1 for g in range(20)}
        kept = [tuple(r) for r in near_dedup.keep_one(df).collect()]
        assert key(kept) == key({(i, t) for i, t in rows if i is None or i % 4 == 1})  # both texts of an id, once


def test_near_duplicates_dense_group(spark):
    """A group whose copies are only partly linked goes through centres, pairs and blocks."""
    import random

    rng = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 7)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    want = brute_components(rows)
    for block, shingles in ((40, 2_000_000), (1024, 4000)):  # blocks by rows, then by shingles
        before = near_dedup.BLOCK, near_dedup.BLOCK_SHINGLES
        near_dedup.BLOCK, near_dedup.BLOCK_SHINGLES = block, shingles
        try:
            got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows, clash=False)).collect()}
        finally:
            near_dedup.BLOCK, near_dedup.BLOCK_SHINGLES = before
        assert got == want


def test_set_sketch():
    a, b = np.arange(4000, dtype=np.uint64), np.arange(1000, 5000, dtype=np.uint64)
    mix = lambda x: common._stir(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77))
    a, b = mix(a), mix(b)
    ra, rb = near_dedup.registers(a), near_dedup.registers(b)
    both = near_dedup.registers(np.union1d(a, b))
    assert (np.maximum(ra, rb) == both).all()  # sketches merge by maximum
    size = np.array([4000.0])
    assert abs(near_dedup.joint_estimate(ra[None], rb[None], size, size)[0] - 0.6) < 0.12


def brute_lines(rows, least=5):
    """Kept text of each (id, text) row."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    first = {}
    for k, (i, t, *_) in enumerate(order):
        for pos, line in enumerate((t or "").split("\n")):
            p = tuple(line.split())
            if p and t is not None:
                first.setdefault(p, (k, pos))

    def near(a, b):
        if min(len(a), len(b)) < least or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = (a, b) if len(a) > len(b) else (b, a)
        return any(a[:k] + a[k + 1 :] == b for k in range(len(a)))

    names = sorted(first, key=first.get)
    gone = {b for k, b in enumerate(names) if len(b) < 2000 and any(near(a, b) for a in names[:k] if abs(len(a) - len(b)) < 2)}
    out = []
    for k, (i, t, *_) in enumerate(order):
        lines = (t or "").split("\n") if t is not None else []
        stay = [x for pos, x in enumerate(lines) if not x.split() or (first[tuple(x.split())][:1] == (k,) and first[tuple(x.split())][1] == pos and tuple(x.split()) not in gone)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def test_line_dedup(spark):
    rows = [r for r in documents() if not (r[0] == 5 and r is documents()[-2])]
    rows = rows[:-2] + rows[-1:]  # repeated rows are looked at below
    out = line_dedup.dedup_lines(frame(spark, rows))
    got = [(r["doc_id"], r["n_lines"], r["n_removed"], r["text"] or "") for r in out.collect()]
    assert key(got) == key(brute_lines(rows)) and sum(r[2] for r in got) > 20
    assert set(out.columns) >= {"found", "h1", "doc_id", "lang", "n"}
    assert out.where("doc_id = 200").first()["text"] is None
    twice = line_dedup.dedup_lines(spark.createDataFrame([(1, "a b\nc"), (1, "a b\nc"), (2, "c\n\nd")], "doc_id long, text string"))
    assert key(tuple(r) for r in twice.collect()) == key([(1, "a b\nc", 2, 0), (1, "a b\nc", 2, 0), (2, "\nd", 3, 1)])
    assert line_dedup.dedup_lines(frame(spark, rows).limit(0)).count() == 0


def labelled(seed=3, n=400):
    """Good texts of common words, junk of repeated shouting, toxic ones with an insult."""
    import random

    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [f"word{rng.randrange(200)}" for _ in range(rng.randrange(20, 120))]
        kind = rng.random()
        if kind < 0.2:
            w = [f"{x.upper()}!!" for x in w]
        elif kind < 0.4:
            w[rng.randrange(len(w))] = rng.choice(["vileone", "viletwo"])
        docs.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(kind >= 0.2), int(0.2 <= kind < 0.4)))
    return docs, labels


def test_quality(spark):
    docs, labels = labelled()
    lab = spark.createDataFrame([*labels, (None, 1, 0), (9999, None, None)], "doc_id long, quality int, toxic int")
    out = quality.digest(frame(spark, docs + documents()), lab).collect()
    assert len(out) == len(docs) + len(documents()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in out[: len(docs)] if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    plain = quality.score(frame(spark), None, out_col="score")
    assert plain.where("score <> 0.5").count() == 0
    assert quality.train(frame(spark, docs).limit(0), lab) is None and quality.train(frame(spark, docs), lab.limit(0)) is None
    risk = quality.fit_nnpu(np.array([[1.0], [1.2]] * 50), np.array([[1.1], [-1.0]] * 50), 0.5)
    assert risk.score(np.array([[1.1], [-1.0]])).round() .tolist() == [1.0, 0.0]


def test_quality_learns_the_same_from_any_storage(spark):
    docs, labels = labelled(n=200)
    lab = spark.createDataFrame([*labels, *[(3, 1, 0)] * 500], "doc_id long, quality int, toxic int")  # a repeated label counts once
    df = frame(spark, [*docs, *docs[:40]], clash=False)
    one, two = quality.train(df, lab), quality.train(df.repartition(7, "text"), lab.repartition(3))
    plain = quality.train(frame(spark, docs, clash=False), lab.dropDuplicates())
    assert (one.weight == two.weight).all() and one.bias == two.bias and (one.weight == plain.weight).all()


def test_class_prior_without_negatives():
    rng = np.random.default_rng(4)
    for prior in (0.3, 0.6, 0.9):
        p = rng.normal(2, 1, (2000, 3))
        u = np.concatenate((rng.normal(2, 1, (int(4000 * prior), 3)), rng.normal(-1, 1, (int(4000 * (1 - prior)), 3))))
        assert abs(quality.estimate_prior(p, rng.permutation(u)) - prior) < 0.06


def test_risk_step_against_brute_force():
    """Risk by its definition, its direction by differences."""
    rng = np.random.default_rng(6)
    p, u = rng.normal(1, 1, (30, 4)), rng.normal(0, 1, (50, 4))
    loss = lambda z: math.log1p(math.exp(-z))

    def parts(w, b, prior):
        good = prior * sum(loss(x @ w + b) for x in p) / len(p)
        return good, sum(loss(-(x @ w + b)) for x in u) / len(u) - prior * sum(loss(-(x @ w + b)) for x in p) / len(p)

    for w, b, prior in ((rng.normal(size=4), 0.3, 0.4), (rng.normal(size=4) + 3, 2.0, 0.95)):
        value, step = quality.risk_step(p, u, w, b, prior)
        good, bad = parts(w, b, prior)
        assert abs(value - (good + max(0, bad))) < 1e-9
        for k in range(5):
            d = np.zeros(5)
            d[k] = 1e-6
            up, down = parts(w + d[:4], b + d[4], prior), parts(w - d[:4], b - d[4], prior)
            slope = (up[1] - down[1]) / 2e-6
            want = -slope if bad < 0 else slope + (up[0] - down[0]) / 2e-6
            assert abs(step[k] - want) < 1e-5


def test_chain_learns_from_out_of_fold_predictions():
    """The later model against one fitted on log odds that are made again, fold by fold."""
    rng = np.random.default_rng(8)
    xs = [np.unique(rng.integers(0, 40, 12)).astype(np.uint64) for _ in range(160)]
    ys = np.array([[float(3 in x or 5 in x), float(3 in x and 7 in x or 9 in x)] for x in xs])
    first, second = toxicity.fit_chain(xs, ys)
    fold = np.random.default_rng(11).permutation(len(xs)) % toxicity.FOLDS
    odds = np.zeros((len(xs), 1))
    for i, x in enumerate(xs):
        rest = [j for j in range(len(xs)) if fold[j] != fold[i]]
        part = toxicity.fit_linear([xs[j] for j in rest], ys[rest, 0], np.zeros((len(rest), 0))) if i == 0 or fold[i] not in seen else seen[fold[i]]
        seen = {fold[i]: part} if i == 0 else seen | {fold[i]: part}
        odds[i, 0] = np.clip(part.margin(x, np.zeros(0)), -10, 10)
    want = toxicity.fit_linear(xs, ys[:, 1], odds)
    assert np.allclose(second.weight, want.weight) and np.allclose(second.earlier, want.earlier) and second.earlier[0] != 0
    assert not np.allclose(toxicity.fit_linear(xs, ys[:, 1], np.array([[first.margin(x, np.zeros(0))] for x in xs])).earlier, second.earlier)


def test_toxicity(spark):
    docs, labels = labelled()
    lab = spark.createDataFrame([*labels, (None, 1, 1)], "doc_id long, quality int, toxic int")
    others = [(r[0] if r[0] is None else r[0] + 1000, *r[1:]) for r in documents()]
    out = toxicity.score(frame(spark, docs + others), lab).collect()
    truth = {i: t for i, _, t in labels}
    mine = [r for r in out[: len(docs)]]
    assert np.mean([r["toxic"] == bool(truth[r["doc_id"]]) for r in mine if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]) > 0.95
    assert np.mean([r["toxic"] == bool(truth[r["doc_id"]]) for r in mine]) > 0.97
    again = toxicity.score(frame(spark, docs + others).repartition(5, "text"), lab.unionByName(lab).repartition(3)).collect()
    assert {(r["doc_id"], r["toxic_score"]) for r in again} == {(r["doc_id"], r["toxic_score"]) for r in out}
    assert not any(r["toxic"] for r in out[len(docs) :])
    assert toxicity.score(frame(spark, docs), lab.limit(0)).where("toxic").count() == 0
    assert toxicity.score(frame(spark, docs).limit(0), lab).count() == 0


def test_lm_scoring(spark):
    rows = documents()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = collections.Counter()
    for i, t, *_ in rows:
        if not held(i):
            count.update([*BLANK.findall(lower(t)), None])
    n, v = sum(count.values()), len(count)
    for head in (50, 100_000):  # most words by the join, then none
        lm_scoring.HEAD, before = head, lm_scoring.HEAD
        try:
            lm = lm_scoring.train.__defaults__
            lm_scoring.train.__defaults__ = (head, 40, 8)
            got = [tuple(r) for r in lm_scoring.score_texts(frame(spark, rows)).collect()]
        finally:
            lm_scoring.HEAD, lm_scoring.train.__defaults__ = before, lm
        want = []
        for i, t, *_ in rows:
            k = [*BLANK.findall(lower(t)), None]
            want.append((i, held(i), len(k), sum(x in count for x in k), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in k), 6)))
        assert key((*r[:5], round(r[5], 6)) for r in got) == key(want)
        assert all(r[6] < 0 and math.isfinite(r[6]) for r in got)
    assert lm_scoring.score_texts(frame(spark, rows).limit(0)).count() == 0
    alone = lm_scoring.score_texts(spark.createDataFrame([(i, "x y", "", "", 0) for i in range(40) if held(i)], SCHEMA))
    assert all(r["n_known"] == 0 and r["score"] == r["base_score"] for r in alone.collect())


def test_lm_score_against_brute_force(spark):
    """The score of every text, put together word by word from classes, counts and transitions."""
    rows = documents(n=40)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    before = lm_scoring.train.__defaults__
    lm_scoring.train.__defaults__ = (60, 30, 7)
    try:
        got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], round(r["score"], 6)) for r in lm_scoring.score_texts(frame(spark, rows, clash=False)).collect())
        docs = frame(spark, rows, clash=False).select(F.col("doc_id").alias("id"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held_out"), F.col("text").cast("binary").alias("text"))
        stage = common.Stage(spark)
        model, _ = lm_scoring.train(docs.where("NOT held_out").select("text"), stage)
        encoded = docs.mapInArrow(lm_scoring._encode(spark.sparkContext.broadcast(model.units), pa.int64()), lm_scoring._ENCODED.format("bigint"))
        words, lexicon = lm_scoring.exchange_words(stage.cut(encoded, "encoded"), model, stage)
        cls = {bytes(r["word"]): r["cls"] for r in words.collect()} | {w: int(lexicon.head_cls[r]) for w, r in model.units.rank.items() if r <= model.units.clustered}
    finally:
        lm_scoring.train.__defaults__ = before
    tokens = lambda t: [w.encode() for w in BLANK.findall(lower(t))]
    of = lambda w: cls[w] if w in cls else int(model.group_cls[lm_scoring.tail_group(w)])
    count, pairs = collections.Counter(), collections.Counter()
    for i, t, *_ in rows:
        if not held(i):
            count.update(tokens(t))
            chain = [0, *map(of, tokens(t)), 0]
            pairs.update(zip(chain, chain[1:]))
    k, total = len(model.pairs), sum(pairs.values())
    into, out = collections.Counter(), collections.Counter()
    for (a, b), n in pairs.items():
        into[b] += n
        out[a] += n
    mass = collections.Counter({c: 0.0 for c in range(k)})  # of a class: its words, and one unknown of each of its groups
    for w, n in count.items():
        mass[of(w)] += n + lm_scoring.DELTA
    for c in model.group_cls:
        mass[int(c)] += lm_scoring.DELTA
    step = lambda a, b: math.log10((pairs[a, b] + lm_scoring.ALPHA * k * (into[b] + 1) / (total + k)) / (out[a] + lm_scoring.ALPHA * k))
    want = []
    for i, t, *_ in rows:
        chain = [0, *map(of, tokens(t)), 0]
        score = sum(step(a, b) for a, b in zip(chain, chain[1:])) + sum(math.log10((count[w] + lm_scoring.DELTA) / mass[of(w)]) for w in tokens(t))
        want.append((i is not None, i or 0, len(chain) - 1, round(score, 6)))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], atol=1e-5)


def test_lm_is_a_distribution(spark):
    """Over the next word, all known words and one unknown of each group sum to one."""
    docs = spark.createDataFrame([(f"the {a} sees the {b}".encode(),) for a in ("cat", "dog", "cow") for b in ("hat", "mat", "bat")], "text binary")
    model, vocab = lm_scoring.train(docs, common.Stage(spark), 4, 2, 3)
    total = 0.0
    u = model.units
    known = {bytes(r["word"]): r["c"] for r in vocab.collect()}
    row = model.step[0]
    for w, c in known.items():
        if w in u.rank:
            total += 10 ** (row[model.cls[u.unit[u.rank[w]]]] + model.emit[u.rank[w]])
        else:
            g = lm_scoring.tail_group(w)
            total += (c + lm_scoring.DELTA) * 10 ** (row[model.cls[1 + u.clustered + g]] + model.room[g])
    for g in range(lm_scoring.TAIL):
        total += lm_scoring.DELTA * 10 ** (row[model.cls[1 + u.clustered + g]] + model.room[g])
    assert abs(total - 1) < 1e-6


def test_frames_without_rows_or_with_strange_ids(spark):
    texts = spark.createDataFrame([("b", "x y z q r"), ("a", "x y z q r"), (None, None)], "doc_id string, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(texts).collect()}
    assert got == {"a": "a", "b": "a", None: None}
    assert line_dedup.dedup_lines(texts).where(F.col("text") == "").count() == 1


def test_exchange_makes_the_best_moves():
    """A word's best class by the whole likelihood, for every class tried; no move is left at the end."""
    rng = np.random.default_rng(3)
    g = rng.integers(0, 9, (13, 13))
    g[0, 0] = 0

    def likelihood(cls):
        k = int(cls.max()) + 1
        b = np.zeros((k, k))
        np.add.at(b, (cls[:, None].repeat(13, 1), cls[None, :].repeat(13, 0)), g)
        log = lambda x: sum(v * math.log(v) for v in x.ravel() if v > 0)
        return log(b) - log(b.sum(1)) - log(b.sum(0))

    cls = lm_scoring.exchange(g, 4, sweeps=50)
    for w in range(1, 13):
        tried = []
        for c in range(1, 5):
            other = cls.copy()
            other[w] = c
            tried.append(likelihood(other))
        assert likelihood(cls) >= max(tried) - 1e-9
    pairs = np.zeros((5, 5))
    np.add.at(pairs, (cls[:, None].repeat(13, 1), cls[None, :].repeat(13, 0)), g)
    for w in range(1, 13):  # a word judged by itself, against the same likelihood
        to, fro = np.bincount(cls, g[w], 5), np.bincount(cls, g[:, w], 5)
        if g[w, w]:
            continue
        at = np.concatenate((np.flatnonzero(to), 5 + np.flatnonzero(fro)))
        n = np.concatenate((to[to > 0], fro[fro > 0]))
        assert lm_scoring.best_classes(pairs, np.zeros(len(at), int), at, n, np.array([cls[w]])) == [cls[w]]


def test_lm_exchanges_rare_words_by_their_own_transitions(spark):
    """Two rare words of one ending, hence of one group, go to the classes of their neighbours."""
    rng = random.Random(5)
    lines = []
    for i in range(400):
        lines += [f"a{rng.randrange(4)} b{rng.randrange(4)}", f"c{rng.randrange(4)} d{rng.randrange(4)}"]
    lines += ["a1 xxing", "a2 xxing", "a3 xxing", "yying d1", "yying d2", "yying d3", "yying d0"] * 2
    docs = spark.createDataFrame([(i, False, " ".join(rng.sample(lines, len(lines))).encode()) for i in range(2)], "id long, held_out boolean, text binary")
    stage = common.Stage(spark)
    model, vocab = lm_scoring.train(docs.select("text"), stage, 17, 16, 6)
    assert lm_scoring.tail_group(b"xxing") == lm_scoring.tail_group(b"yying")
    shared = spark.sparkContext.broadcast(model.units)
    encoded = docs.mapInArrow(lm_scoring._encode(shared, pa.int64()), lm_scoring._ENCODED.format("bigint"))
    words, lexicon = lm_scoring.exchange_words(encoded, model, stage)
    got = {bytes(r["word"]): (r["c"], r["cls"]) for r in words.collect()}
    counts = {bytes(r["word"]): r["c"] for r in vocab.collect()}
    seeds = {w for w, r in model.units.rank.items() if r <= model.units.clustered}
    assert {w: c for w, (c, _) in got.items()} == {w: c for w, c in counts.items() if w not in seeds}  # every other word, however rare
    of = lambda w: lexicon.head_cls[model.units.rank[w]]
    assert got[b"xxing"][1] != got[b"yying"][1]
    assert got[b"yying"][1] == of(b"c1") and got[b"xxing"][1] in {of(b"b%d" % k) for k in range(4)}
    total = np.zeros(len(model.pairs))  # the words of a class and one unknown of each of its groups sum to one
    for w, c in counts.items():
        if w != lm_scoring.END:
            cls = got[w][1] if w in got else of(w)
            total[cls] += (c + lm_scoring.DELTA) / 10 ** lexicon.room[cls]
    for cls in model.group_cls:
        total[cls] += lm_scoring.DELTA / 10 ** lexicon.room[cls]
    assert all(abs(x - 1) < 1e-9 for x in total[np.unique(model.cls[1:])])
