import os

import pytest

import corpus_pipeline as cp
from quirelake.llm import line_dedup, oracles, queries

from .fixtures import documents
from .test_text_operators import brute_components, brute_hits, brute_lines, labelled

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("sf"))
    docs, labels = labelled(n=200)
    docs = [(i + 1000, t, l, f"s{i % 3}", len(t)) for i, t, l, _, _ in docs] + [r for r in documents()[:-2]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i + 1000, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    items = [(1, " ".join(docs[5][1].split()[:14])), (2, " ".join(docs[-20][1].split()[:10]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, items


def test_stages(spark, folder, tmp_path):
    base, items = folder
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{base}/documents.parquet")
    seen = {}
    for name, f in cp.STAGES:
        out = f(spark, docs, base)
        if name != "mixing":
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs, docs := spark.read.parquet(str(tmp_path / name)))
    rows = lambda d: [tuple(r) for r in d.select(COLUMNS).collect()]
    key = lambda rs: sorted(rs, key=repr)
    before, after = seen["quality"]
    assert 0 < after.count() < before.count() and set(rows(after)) <= set(rows(before))
    before, after = map(rows, seen["line_dedup"])
    want = {i: t for i, _, _, t in brute_lines(before)}
    assert key((r[0], r[1] or "") for r in after) == key(want.items()) and all(r[4] == (None if r[1] is None else len(r[1])) for r in after)
    before, after = map(rows, seen["near_dedup"])
    comp = brute_components(before)
    assert key(after) == key(r for r in before if comp[r[0]] == r[0])
    before, after = map(rows, seen["decontamination"])
    assert key(after) == key(r for r in before if not brute_hits(r[1], items)[4])
    before, after = seen["mixing"]
    assert key(rows(after)) == key(rows(before)) and after.select("mix_position").distinct().count() == after.count()
    assert cp.run(spark, base).count() == after.count()


def test_stages_keep_columns_and_awkward_rows(spark, folder):
    """Columns of the names that operators use inside, null ids, repeated rows and no rows at all."""
    base, _ = folder
    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS found", "2 AS n_lines", "3 AS n_removed", "4 AS rep", "5 AS node", "6 AS id", "7 AS k", "8 AS __at")
    empty = docs.limit(0)
    for name, f in cp.STAGES:
        out, none = f(spark, docs, base), f(spark, empty, base)
        assert none.count() == 0 and out.columns[: len(docs.columns)] == docs.columns
        if name != "mixing":
            assert out.columns == none.columns == docs.columns
        assert {tuple(r)[5:12] for r in out.collect()} <= {(1, 2, 3, 4, 5, 6, 7)}
    near = [r["doc_id"] for r in cp.drop_near_copies(spark, docs, base).collect()]
    assert near.count(5) == 1 and near.count(None) == 1


def test_digest_queries_and_sql(spark, folder):
    """Each query runs on a folder of tables; SQL agrees where there is some."""
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data here")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in oracles.oracle_sql().items():
        got = queries.queries()[name](spark, sf)
        cols = sorted(got.columns)
        mine = sorted(repr(tuple(r[c] for c in cols)) for r in got.collect())
        r = con.execute(sql)
        names = [d[0] for d in r.description]
        assert mine == sorted(repr(tuple(x[names.index(c)] for c in cols)) for x in r.fetchall()), name
    assert len(queries.queries()) == 10 and line_dedup.MIN_WORDS == 5
