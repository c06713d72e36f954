import collections
import json
import math
import random

import numpy as np
import pytest

from quirelake.llm import chat, mixing, neighbours

from .fixtures import documents, frame


@pytest.mark.parametrize("weights", [[1], [1, 1, 1], [5, 3, 2], [1, 997, 2], [0.2, 0.3, 0.5], [1 / 3, 2 / 3]])
def test_pfair_keeps_every_source_within_a_block(weights):
    shares = mixing.shares_of([float(w) for w in weights], 1000)
    period = mixing.pfair_period(shares)
    q, used = sum(shares), collections.Counter()
    assert len(period) == q
    for t, s in enumerate(period, 1):
        k = used[s] + 1
        assert t - 1 >= (k - 1) * q // shares[s] and t <= math.ceil(k * q / shares[s])  # release and deadline
        used[s] += 1
        assert all(abs(used[i] - t * n / q) < 1 for i, n in enumerate(shares))


def test_mixing(spark):
    rows = documents(n=120)
    got = mixing.mix(frame(spark, rows), {"s0": 3, "s1": 1, "gone": 5}, block_rows=2).collect()
    assert len(got) == len(rows)
    slots = collections.defaultdict(set)
    for r in got:
        slots[r["mix_slot"]].add((r["source"], r["mix_block"]))
        assert r["mix_release"] < r["mix_deadline"]
    assert sorted(slots) == list(range(len(slots))) and all(len(v) == 1 for v in slots.values())
    assert len({r["mix_position"] for r in got}) == len(got)
    order = [next(iter(slots[t]))[0] for t in range(len(slots))]
    n = collections.Counter(order)
    both = min(k for k in range(len(order)) if order[:k].count("s0") == n["s0"] or order[:k].count("s1") == n["s1"])
    for t in range(1, both):
        assert abs(order[:t].count("s0") - t * 0.75) < 1
    rest = min(order.index(s) for s in order if s not in ("s0", "s1"))
    assert rest == n["s0"] + n["s1"]  # sources without a weight come last
    again = {r["mix_position"]: r["doc_id"] for r in mixing.mix(frame(spark, rows).repartition(7), {"s0": 3, "s1": 1}, block_rows=2).collect()}
    assert again == {r["mix_position"]: r["doc_id"] for r in got}
    mixing.RUN_ROWS, before = 10, mixing.RUN_ROWS
    mixing.RUNS, parts = 3, mixing.RUNS
    try:  # the same order, whatever the length of the runs
        short = {r["mix_position"]: r["doc_id"] for r in mixing.mix(frame(spark, rows), {"s0": 3, "s1": 1}, block_rows=2).collect()}
    finally:
        mixing.RUN_ROWS, mixing.RUNS = before, parts
    assert short == again
    assert mixing.mix(frame(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(spark.range(1200).selectExpr("id doc_id", "string(id) source"))


@pytest.mark.parametrize("weights", [[1, 1, 1], [1] * 7, [1] * 19, [1 / 3, 2 / 3], [0.2, 0.3, 0.5], [0.123457, 0.4, 0.076543, 0.4], [1, 2**0.5, 1e-3]])
def test_mixing_keeps_the_target_over_many_periods(spark, weights):
    """Against the weights themselves, as long as every source has blocks: less than one block off."""
    n = len(weights)
    part = [round(w / sum(weights) * 9000) for w in weights]
    docs = spark.createDataFrame([(i * 10000 + k, f"s{i}") for i in range(n) for k in range(part[i])], "doc_id long, source string")
    got = mixing.mix(docs, {f"s{i}": w for i, w in enumerate(weights)}, block_rows=1).orderBy("mix_slot").select("source", "mix_slot", "mix_release", "mix_deadline").collect()
    assert [r["mix_slot"] for r in got] == list(range(sum(part)))
    target, used = {f"s{i}": w / sum(weights) for i, w in enumerate(weights)}, collections.Counter()
    for t, r in enumerate(got, 1):
        assert r["mix_release"] <= t - 1 < r["mix_deadline"]
        used[r["source"]] += 1
        assert all(abs(used[s] - t * w) < 1 + 1e-9 for s, w in target.items())
        if any(used[f"s{i}"] == part[i] for i in range(n)):
            break
    assert t > 6000


def test_mixing_spreads_rows_without_ids(spark):
    """Rows of one id, or none, are ordered by their columns; equal rows are all kept."""
    docs = spark.createDataFrame([(None, f"t{k // 2}", "s") for k in range(2000)] + [(7, f"u{k}", "s") for k in range(500)], "doc_id long, text string, source string")
    got = mixing.mix(docs, block_rows=1).collect()
    assert sorted(r["mix_position"] for r in got) == list(range(2500))
    order = [r["text"] for r in sorted(got, key=lambda r: r["mix_position"])]
    assert collections.Counter(order) == collections.Counter(r["text"] for r in docs.collect())
    first = sum(t.startswith("u") for t in order[:1250])
    assert 190 < first < 310  # neither kind stands together


def test_hilbert_steps_to_neighbours():
    cells = np.array([[x, y] for x in range(8) for y in range(8)])
    key = neighbours.hilbert(cells, 3)
    path = cells[np.argsort(key)]
    assert sorted(key.tolist()) == list(range(64)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def brute_nearest(rows, k=10):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = set()
    for q, v in ok:
        if q % 100 == 0:
            best = sorted((float(neighbours.distances(v, c[None])[0]), i) for i, c in ok if i != q)[:k]
            out |= {(q, r, i, s) for r, (s, i) in enumerate(best, 1)}
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(450)]
    rows += [(i, rows[200][1]) for i in range(1000, 1040)]  # many ties with a query
    rows += [(600, None), (700, []), (800, [0.0] * 6), (900, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "'x' as v", "2 as c")
    got = {tuple(r) for r in neighbours.nearest(df).collect()}
    assert got == brute_nearest(rows)
    assert neighbours.nearest(df.limit(0)).count() == 0
    few = {tuple(r) for r in neighbours.nearest(df.where("vec_id in (0, 1, 2)")).collect()}
    assert few == brute_nearest(rows[:3]) and len(few) == 2


def test_neighbours_with_repeated_ids_and_lengths(spark):
    """Each length is searched by itself; of an id's vectors the nearest counts."""
    rng = np.random.default_rng(7)
    rows = [(i % 150, rng.normal(size=4 + 2 * (i % 2)).round(2).tolist()) for i in range(400)] + [(100, [1.0, 2.0, 3.0, 4.0]), (100, [0.5, 0.5, 0.5, 0.5])]
    got = {tuple(r) for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = set()
    for q in (0, 100):
        best: dict = {}
        for i, v in rows:
            for j, x in rows:
                if i == q and j != q and len(v) == len(x):
                    best[j] = min(best.get(j, math.inf), float(neighbours.distances(np.array(v), np.array(x)[None])[0]))
        want |= {(q, r, j, d) for r, (d, j) in enumerate(sorted((d, j) for j, d in best.items())[:10], 1)}
    assert got == want


def test_next_filled_blocks():
    before, behind = neighbours._beside(np.array([True, False, False, True, True]))
    assert before.tolist() == [-1, 0, 0, 0, 3] and behind.tolist() == [3, 3, 3, 4, -1]


def test_neighbours_recall_in_hot_clusters(spark):
    """Many vectors of few keys leave blocks empty; what is beside them is still found."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(5, 8))
    x = centres[rng.integers(0, 5, 3000)] + rng.normal(size=(3000, 8)) * 1e-4
    got = collections.defaultdict(set)
    for r in neighbours.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, 3000, 100):
        d = neighbours.distances(x[q], x)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits / 300 >= 0.9


def test_neighbours_recall_in_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for r in neighbours.nearest(df).collect():
        got[r["query_id"]].add(r["vec_id"])
    y = x.astype(np.float32).astype(np.float64)
    hits = 0
    for q in range(0, 6000, 100):
        d = neighbours.distances(y[q], y)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits / 600 >= 0.9


def call(c, t, r, x):
    return c, t, r, x if isinstance(x, str) or x is None else json.dumps(x)


def brute_levels(needs):
    """Level by id; ids in or behind circles are missing."""
    level = {}
    while True:
        more = {i: max([level[n] + 1 for n in ns if n in needs], default=0) for i, ns in needs.items() if i not in level and all(n in level for n in ns if n in needs)}
        if not more:
            return level
        level |= more


def test_chat(spark):
    rows = [
        call(1, 0, "user", 'hi "x"\n'),
        call(1, 1, "assistant", {"tool_calls": [{"id": "a", "name": "add", "arguments": {"y": 2, "x": 1}, "depends_on": ["b", "unknown"]}, {"id": "b", "name": "get", "arguments": '{"k":"v"}'}, {"name": "get"}]}),
        call(1, 2, "tool", {"tool_call_id": "a", "content": {"z": 1, "b": [1, 2]}}),
        call(1, 3, "tool", {"tool_call_id": "b", "content": "ok"}),
        call(1, 4, "tool", {"tool_call_id": "b", "content": "later"}),
        call(1, 5, "tool", {"tool_call_id": "zz", "content": 1}),
        call(1, 6, "assistant", {"tool_calls": [{"id": "a", "name": "add", "arguments": {"x": 1, "y": 5, "q": 0}}]}),
        call(2, 0, "assistant", {"tool_calls": [{"id": "p", "name": "add", "arguments": {"x": "s"}, "depends_on": ["q"]}, {"id": "q", "name": "nope", "depends_on": ["p"]}]}),
        call(2, 1, "assistant", "{broken"),
        call(3, 0, "assistant", {"tool_calls": [{"id": "s", "name": "get", "arguments": {"k": 5}}, {"id": "t", "name": "get", "arguments": [1]}]}),
        call(3, 1, "tool", {"content": "no id"}),
        call(None, None, None, None),
        call(4, 0, "user", "same"),
        call(4, 0, "user", "same"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as level", "'x' as json", "2 as pos")
    tools = spark.createDataFrame(
        [
            ("add", json.dumps({"properties": {"x": {"type": "integer"}, "y": {"type": "integer", "enum": [1, 2]}}, "required": ["x", "y"], "additionalProperties": False})),
            ("get", json.dumps({"properties": {"k": {"type": "string"}}})),
            (None, "{}"),
        ],
        "name string, parameters string",
    )
    out = [r.asDict() for r in chat.format_chats(df, tools).collect()]
    assert len(out) == 18
    for r in out:  # canonical: sorted keys, no blanks, exact text
        assert json.dumps(json.loads(r["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["json"]
    calls = {(r["conv_id"], r["call_id"], r["turn"]): r for r in out if r["kind"] == "call"}
    status = {k: r["status"] for k, r in calls.items()}
    assert status == {(1, "a", 1): "ok", (1, "b", 1): "ok", (1, None, 1): "no id", (1, "a", 6): "repeated id", (2, "p", 0): "circular", (2, "q", 0): "circular", (3, "s", 0): "invalid", (3, "t", 0): "invalid"}
    problems = {k: json.loads(r["json"])["problems"] for k, r in calls.items()}
    assert problems[(1, "a", 6)] == ["not in enum y", "unexpected q"]
    assert problems[(2, "p", 0)] == ["missing y", "wrong type x"] and problems[(2, "q", 0)] == ["unknown tool"]
    assert problems[(3, "s", 0)] == ["wrong type k"] and problems[(3, "t", 0)] == ["arguments are no object"]
    assert calls[(1, "a", 1)]["level"] == 1 and calls[(1, "b", 1)]["level"] == 0
    results = sorted((r["call_id"], r["status"], r["turn"], r["level"]) for r in out if r["kind"] == "result")
    assert results == [("a", "ok", 1, 1), ("b", "ok", 1, 0), ("b", "repeated", 1, 0), ("zz", "no call", 5, 0)]
    assert sum(r["kind"] == "message" for r in out) == 6
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_of_long_texts(spark):
    """Arguments and contents of a million characters go through as they are."""
    text = "漢\"x\\ " * 200_000
    rows = [call(1, 0, "assistant", {"tool_calls": [{"id": "a", "name": "get", "arguments": {"k": text}}]}), call(1, 1, "tool", {"tool_call_id": "a", "content": text}), call(1, 2, "user", text)]
    tools = spark.createDataFrame([("get", json.dumps({"properties": {"k": {"type": "string"}}}))], "name string, parameters string")
    out = {r["kind"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools).collect()}
    assert json.loads(out["call"]["json"])["arguments"]["k"] == json.loads(out["result"]["json"])["content"] == json.loads(out["message"]["json"])["content"] == text
    assert {r["status"] for r in out.values()} == {"ok"}


def test_topological_levels(spark):
    from quirelake.llm.common import Stage

    rng = random.Random(1)
    needs = {f"c{k}": [f"c{rng.randrange(40)}" for _ in range(rng.randrange(3))] for k in range(40)}
    needs |= {f"d{k}": [f"d{j}" for j in range(max(0, k - 2), k)] for k in range(9)}
    df = spark.createDataFrame([(1, i, n) for i, n in needs.items()], "conv_id long, call_id string, needs array<string>")
    got = {r["call_id"]: r["level"] for r in chat.topological_levels(df, Stage(spark)).collect()}
    assert got == {i: brute_levels(needs).get(i) for i in needs} and got["d8"] == 8
