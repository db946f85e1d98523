"""Queries of the training-data operators against SQL or brute force on the smallest tables."""

import os
import urllib.parse
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tessella.llm import queries


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{small}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, small, duck, name):
    df = queries.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    mine = Counter(tuple(r) for r in df.select(*columns).collect())
    assert mine == Counter(duck.sql("select " + ", ".join(columns) + f" from ({queries.SQL[name]}) q").fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() > 0


@pytest.fixture(scope="module")
def matrix(duck):
    rows = duck.sql("with " + queries._EXPRESSION.strip() + " select cell_id, gene, value from expression").fetchall()
    cells, genes = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    ci, gi = {c: i for i, c in enumerate(cells)}, {g: i for i, g in enumerate(genes)}
    x = np.zeros((len(cells), len(genes)))
    for c, g, v in rows:
        x[ci[c], gi[g]] = v
    return cells, x / np.linalg.norm(x, axis=1, keepdims=True)


def test_p1_against_brute_force(spark, small, matrix):
    cells, x = matrix
    s = x @ x.T
    np.fill_diagonal(s, -1)
    want = {tuple(sorted((cells[i], cells[j]))) for i in range(len(cells)) for j in sorted(range(len(cells)), key=lambda j: (-round(s[i, j], 9), cells[j]))[:5] if s[i, j] >= 0.995}
    got = {(r.cell_a, r.cell_b) for r in queries.p1_found(spark, small).collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got & want) >= 0.99 * len(got)


def test_p6_against_brute_force(spark, small, matrix):
    cells, x = matrix
    near = x @ x.T >= 0.8
    want = set()
    for i in range(len(cells)):
        g = np.flatnonzero(near[i])
        if len(g) >= 3 and all((near[j] == near[i]).all() for j in g):
            want.add((cells[g[0]], cells[i]))
    got = {(r.cluster_first, r.cell_id) for r in queries.p6_found(spark, small).collect()}
    assert got == want


def directory(p):
    if p is None or not p.strip():
        return None
    p = p.strip()
    if p.lower().startswith("file:"):
        p = urllib.parse.unquote(p[5:].removeprefix("//"))
    p = p.replace("\\", "/")
    p = os.path.normpath(p if p.startswith("/") else "/srv/omics/" + p)
    return os.path.dirname(p) if os.path.basename(p) == "experiment.xenium" else p


def test_p3_against_brute_force(spark, small, duck):
    rows = duck.sql("select record_id, sample_id, dataset_path from training_records").fetchall()
    parent = {}

    def root(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    names = {}
    for r, s, p in rows:
        s = s.strip().upper().replace("-", "_") if s and s.strip() else None
        names[r] = s
        for k in (("s", s), ("p", directory(p))):
            if k[1]:
                parent[root(("r", r))] = root(k)
    groups = defaultdict(list)
    for r, _, _ in rows:
        groups[root(("r", r))].append(r)
    want = {(r, min((names[q] for q in g if names[q]), default=None)) for g in groups.values() if len(g) > 1 for r in g}
    assert {tuple(r) for r in queries.p3_found(spark, small).select("record_id", "group_sample").collect()} == want
    split = {r.record_id: r.split for r in queries.p3_split(spark, small).collect()}
    assert len(split) == len(rows) and all(len({split[r] for r in g}) == 1 for g in groups.values())


def test_p7_sample_counts(spark, small):
    drawn = Counter((r.draw_id, r.type_key) for r in queries.p7_sample(spark, small).collect())
    for r in queries.p7_report(spark, small).collect():
        key = "".join(c for c in r.cell_type.lower() if c.isalnum() or c == "+")
        assert drawn.get((r.draw_id, key), 0) == r.drawn
    items = queries.p7_sample(spark, small)
    assert items.count() == items.distinct().count()


def test_p8_round_trip(spark, small, duck):
    tokenizers = pytest.importorskip("tokenizers")
    p = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    got = {r.doc_id: list(r.ids) for r in queries.p8_ids(spark, small).collect()}
    assert got == {d: t.encode(x or "", add_special_tokens=False).ids for d, x in texts.items()}


def test_p10_mixed_documents(spark, small):
    rows = queries.p10_labels(spark, small).collect()
    assert all(0 <= r.confidence <= 1.000001 and 0 < r.share <= 1.000001 for r in rows)
    per = Counter(r.doc_id for r in rows)
    assert all(per[r.doc_id] > 1 for r in rows if r.reason == "mixed") and all(per[r.doc_id] == 1 for r in rows if r.reason != "mixed")
