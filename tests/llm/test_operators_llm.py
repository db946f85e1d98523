"""Small cases of the training-data operators: nulls, ties, repeats, empty tables, hot groups."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import birch, leakage, linked_split, proportional, similar, top_n
from tessella.llm.encoding import ByteBPE, default_vocabulary, encode_texts
from tessella.llm.hnsw import FlatHNSW
from tessella.llm.language import PPM, corrected_labels, document_languages, language_code, learn, segment_languages, segments
from tessella.llm.sparse import Block, bucket_features, pack, packed_vectors

# --- top n ------------------------------------------------------------------------------------


def brute_top(rows, n):
    groups = {}
    for g, h, item, score in rows:
        if item is not None and score is not None and np.isfinite(score):
            groups.setdefault((g, h), set()).add((-score, item))
    return {(g, h, i, k + 1) for (g, h), v in groups.items() for k, (_, i) in enumerate(sorted(v)[:n])}


TOP = "g string, h int, item string, score double, k string, run binary, rank int"


@pytest.mark.parametrize("run_rows", [3, 200_000])
def test_top_n(spark, run_rows):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(40), rnd.choice([None, *"pqrstuvwxyz"]), rnd.choice([1.0, 2.0, 2.5, None, float("nan"), float("inf"), -3.0])) for _ in range(3000)]
    rows += [("hot", 1, f"i{i:04}", float(i % 7)) for i in range(3000)] * 2  # half of all rows, each twice
    df = spark.createDataFrame([(*r, "clash", b"", 0) for r in rows], TOP).repartition(5)
    got = top_n.top_n_per_group(df, ["g", "h"], "score", "item", 3, run_rows=run_rows)
    assert got.columns == ["g", "h", "item", "score", "rank"]
    assert {(r.g, r.h, r.item, r["rank"]) for r in got.collect()} == brute_top(rows, 3)
    assert top_n.top_n_per_group(df.limit(0), ["g"], "score", "item", 3).count() == 0


def test_loser_tree():
    seqs = [sorted(random.Random(i).choices(range(50), k=i * 3)) for i in range(7)]
    tree, out = top_n.LoserTree([[(x,) for x in s] for s in seqs]), []
    while (k := tree.head()) is not None:
        out.append(k[0])
        tree.advance(tree.place()[1] + 1)
    assert out == sorted(x for s in seqs for x in s)
    assert top_n.LoserTree([]).head() is None


# --- splits -----------------------------------------------------------------------------------


def test_paths(spark):
    same = ["data/xenium/a_1", "./data/xenium/a_1/", "data\\xenium\\a_1", "data//xenium/./a_1", "data/xenium/../xenium/a_1", "/srv/omics/data/xenium/a_1", "file:///srv/omics/data/xenium/a%5F1", " data/xenium/a_1/experiment.xenium ", "file:///srv/omics/data/xenium/a_1/experiment.xenium"]
    df = spark.createDataFrame([(p,) for p in [*same, "../../../x", "data/50%_done", "file:///a%zz", "", " ", None]], "p string")
    got = [r[0] for r in df.select(linked_split.path_key("p")).collect()]
    assert set(got[: len(same)]) == {"/srv/omics/data/xenium/a_1"}
    assert got[len(same) :] == ["/x", "/srv/omics/data/50%_done", "/a%zz", None, None, None]


@pytest.mark.parametrize("one_task", [4_000_000, 10])
def test_components(spark, one_task):
    """Chains, stars and a large group; with ``one_task`` of 10 the stars have to finish it."""
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(2000, 2001), (2001, 2000), (5, 5)]
    random.Random(2).shuffle(edges)
    got = {r.u: r.v for r in linked_split.components(spark.createDataFrame(edges, "u long, v long"), one_task=one_task).collect()}
    want = {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 50)} | {2001: 2000}
    assert got == want
    assert linked_split.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_deal():
    def slow(sizes, shares):
        total = sum(s * n for s, n in sizes)
        left, out = [p * total for p in shares], []
        for s, n in sorted(sizes, reverse=True):
            given = [0] * len(shares)
            for _ in range(n):
                i = max(range(len(shares)), key=lambda i: (left[i], -i))
                left[i] -= s
                given[i] += 1
            out.append((s, given))
        return out

    for sizes in ([(100, 1), (7, 3), (2, 40), (1, 5000)], [(1, 3)], [(5, 2000), (1, 1)], [(500, 1), (1, 10)]):
        fast = linked_split.deal(sizes, [0.8, 0.1, 0.1])
        assert [sum(g) for _, g in fast] == [n for _, n in sorted(sizes, reverse=True)]
        for (s, a), (_, b) in zip(fast, slow(sizes, [0.8, 0.1, 0.1]), strict=True):
            assert max(abs(x - y) for x, y in zip(a, b, strict=True)) <= 1, (s, a, b)


def test_linked_split(spark):
    rows = [("r1", "A", "p"), ("r2", "a ", "q"), ("r3", None, "q"), ("r4", None, None), ("r5", "", " "), ("r1", "A", "p"), (None, "A", "p")] + [(f"s{i}", f"S{i}", None) for i in range(94)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "id string, sample string, path string, group string, node long")
    g = linked_split.linked_groups(df, "id", [linked_split.sample_key("sample"), linked_split.path_key("path")])
    got = {r.id: r.group for r in g.collect()}
    assert len(got) == 99 and got["r1"] == got["r2"] == got["r3"] and got["r4"] != got["r5"]
    split = {r.id: r.split for r in linked_split.assign_splits(g, "id", ["train", "validation", "test"], [0.8, 0.1, 0.1]).collect()}
    assert len(split) == 99 and split["r1"] == split["r2"] == split["r3"]
    assert abs(sum(v == "train" for v in split.values()) - 79) <= 1
    assert linked_split.linked_groups(df.limit(0), "id", [linked_split.sample_key("sample")]).count() == 0


# --- samples ----------------------------------------------------------------------------------


def test_draw(spark):
    rows = spark.createDataFrame([("s", "big", f"b{i}") for i in range(5000)] + [("s", "small", f"c{i}") for i in range(3)] + [("s", None, "x")], "stratum string, category string, item string")
    t = spark.createDataFrame([(1, "s", "big", 0.5, 1, 100), (1, "s", "small", 0.0, 5, 100), (1, "s", "none", 0.1, 1, 100), (2, "s", "big", 0.333, 0, 3), (3, "s", None, 0.5, 1, 10), (4, "s", "big", None, None, None)], "draw int, stratum string, category string, share double, least long, size long")
    w = {(r.draw, r.category): (r.need, r.there) for r in proportional.wanted_and_there(t, rows).collect()}
    assert w == {(1, "big"): (50, 5000), (1, "small"): (5, 3), (1, "none"): (10, 0), (2, "big"): (1, 5000), (3, None): (5, 0), (4, "big"): (0, 5000)}
    d = proportional.draw(t, rows)
    assert {(r.draw, r.category): r["count"] for r in d.groupBy("draw", "category").count().collect()} == {(1, "big"): 50, (1, "small"): 3, (2, "big"): 1}
    r = {(x.draw, x.category): (x.need, x.drawn, x.missing) for x in proportional.report(t, rows, d).collect()}
    assert r == {(1, "big"): (50, 50, 0), (1, "small"): (5, 3, 2), (1, "none"): (10, 0, 10), (2, "big"): (1, 1, 0), (3, None): (5, 0, 5), (4, "big"): (0, 0, 0)}
    assert proportional.report(t, rows, d.limit(0)).filter("drawn = 0 and missing = need").count() == 6
    u = rows.filter("category = 'big'").withColumn("u", (F.col("item").substr(2, 9).cast("int") % 40) / 40.0).withColumn("n", F.lit(777))
    low = proportional._lowest(u, ["category"], F.col("n"), step_rows=100).collect()  # ties of u go to the smaller item
    assert {x.item for x in low} == {x for _, x in sorted((int(x[1:]) % 40, x) for x in (f"b{i}" for i in range(5000)))[:777]}
    assert proportional.draw(t, rows, sigmas=-5.0).count() == 54  # accepted far too few: filled up exactly
    assert proportional.draw(t.limit(0), rows).count() == 0 and proportional.draw(t, rows.limit(0)).count() == 0


# --- vectors ----------------------------------------------------------------------------------

VEC = "cell_id string, gene string, value double, vec string"


def planted(seed=0, groups=6, size=8, features=60):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        own = rng.choice(features, 12, replace=False)
        base = rng.uniform(3, 6, 12)
        for i in range(size):
            rows += [(f"g{g}_{i}", f"F{f}", float(v * rng.uniform(0.97, 1.03)), "clash") for f, v in zip(own, base, strict=True)]
    return rows


def test_packed_vectors(spark):
    rows = [("a", "X", 3.0, ""), ("a", "X", 3.0, ""), ("a", "Y", 4.0, ""), ("b", "X", -1.0, ""), ("c", "X", None, ""), (None, "X", 1.0, ""), ("d", "X", float("nan"), "")]
    got = packed_vectors(spark.createDataFrame(rows, VEC), "cell_id", F.col("gene"), F.col("value")).collect()
    assert [r.cell_id for r in got] == ["a"] and len(got[0].vec) == 24


def test_similar_with_copies(spark):
    rows = planted() + [(f"copy{i:02}", f"F{f}", 5.0, "") for i in range(30) for f in (1, 2, 3)]
    v = packed_vectors(spark.createDataFrame(rows, VEC), "cell_id", F.col("gene"), F.col("value")).cache()
    out = similar.similar(v, 5, min_similarity=0.9).collect()
    near = {}
    for r in out:
        near.setdefault(r.a, []).append((r["rank"], r.b))
    assert [b for _, b in sorted(near["copy00"])] == [f"copy{i:02}" for i in range(1, 6)]
    assert [b for _, b in sorted(near["copy20"])] == [f"copy{i:02}" for i in range(5)]
    assert all(len(v_) == 5 and {b.split("_")[0] for _, b in v_} == {a.split("_")[0]} for a, v_ in near.items() if a[0] == "g")
    asked = similar.similar(v, 3, queries=v.filter("cell_id = 'g1_0'").select("cell_id"), dims=None, ef=32).collect()
    assert {r.a for r in asked} == {"g1_0"} and len(asked) == 3
    assert similar.similar(v.limit(0), 3).count() == 0


def test_small_world_recall():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = FlatHNSW(x, ef=48)
    q = x[:200]
    ids, _ = g.search(q, 10, 64)
    true = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), true.tolist(), strict=True)]) >= 0.9
    for n in (1, 2, 5):
        assert FlatHNSW(x[:n]).own().shape[0] == n


def test_work_of_a_graph(monkeypatch):
    """A graph chooses from few numbers a vector, and the chosen are those of a full sort, ties or not."""
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(400, 1, 16)) + 0.2 * rng.normal(size=(400, 10, 16))).reshape(-1, 16).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    seen, select = [], np.argpartition
    monkeypatch.setattr(np, "argpartition", lambda a, *args, **more: seen.append(a.size) or select(a, *args, **more))
    g = FlatHNSW(x, ef=12, keep=24)
    assert sum(seen) < 1000 * len(x)  # 3,490 a vector when whole rows of a block and all queries of a step were gone through
    g.x[100:160] = g.x[50]
    block = np.arange(1000)
    ids, sims = g._among(block)
    own = g.x[:1000] @ g.x[:1000].T
    np.fill_diagonal(own, -2)
    assert (np.sort(sims, axis=1) == np.sort(own, axis=1)[:, -24:]).all()
    assert (np.take_along_axis(own, ids, 1) == sims).all() and all(len(set(i)) == 24 for i in ids.tolist())


def test_draws_of_some_rows():
    """Further draws of a part of a block are those of the whole block; repeated features of a packed vector count once."""
    rng = np.random.default_rng(3)
    size = rng.integers(1, 9, 200)
    packed = pack(np.r_[0, np.cumsum(size)], rng.integers(0, 12, size.sum()), rng.uniform(0.5, 2, size.sum()).astype(np.float32))
    block, some = Block(packed), np.arange(0, 200, 7)
    assert (bucket_features(block.rows(some), 2, 3) == bucket_features(block, 5)[some, 3:]).all()
    for a, b in ((np.repeat(some, 3), np.tile([5, 0, 7], len(some))), (rng.integers(0, 200, 300), rng.integers(0, 200, 300))):
        dense = block.dense().astype(np.float64)
        assert np.allclose(block.dots(a, b), (dense[a] * dense[b]).sum(axis=1))
    assert pack(np.array([0, 0, 4]), np.array([5, 2, 5, 2]), np.array([3.0, 1.0, 1.0, 4.0])) == [None, np.array([2, 5]).tobytes() + np.array([0.8, 0.6], np.float32).tobytes()]


def test_blocks_from_arrow():
    """Packed vectors of an Arrow array, whole or sliced, are those of a list; slim ones keep 16 bits of a weight."""
    rng = np.random.default_rng(5)
    size = rng.integers(1, 9, 300)
    packed = pack(np.r_[0, np.cumsum(size)], rng.integers(-(1 << 62), 1 << 62, size.sum()), rng.uniform(0.5, 2, size.sum()).astype(np.float32))
    array = pa.array(packed, pa.binary())
    for a, b in ((0, 300), (70, 200), (5, 5)):
        want, got = Block(packed[a:b]), Block(array.slice(a, b - a))
        slim = Block(got.slim(), slim=True)
        for c in ("start", "row", "feature", "weight"):
            assert (getattr(got, c) == getattr(want, c)).all() and len(getattr(got, c)) == len(getattr(want, c))
        assert (slim.start == want.start).all() and (slim.feature == want.feature.astype(np.int32)).all() and (slim.weight == want.weight.astype(np.float16)).all()


def test_small_components_share_batches():
    """Many components leave in few batches, each whole, whatever the batches are."""
    rng = np.random.default_rng(6)
    rows, cells = [], []
    for c in range(300):
        for leaf in range(c % 4 + 1):
            f = np.sort(rng.choice(50, 5, replace=False))
            w = rng.uniform(0.5, 2, 5).astype(np.float32)
            rows.append((c, f"c{leaf // 2}", 1 + leaf, 0.5, f, w))
            cells.append(pack(np.array([0, 5]), f, w)[0])
    table = pa.table({"component": pa.array([r[0] for r in rows]), "cluster": [r[1] for r in rows], "n": [r[2] for r in rows], "length": [r[3] for r in rows], "vec": pa.array(cells, pa.binary())})
    sums = {}
    for (c, cluster, n, length, f, _), vec in zip(rows, cells, strict=True):
        total = sums.setdefault((c, cluster), np.zeros(50))
        total[f] += n * length * np.frombuffer(vec, np.float32, 5, 40)
    for size in (10_000, 7):
        batches = list(birch._centroids(iter(table.to_batches(size))))
        assert len(batches) <= 1 + len(table) // size + 1
        got = {(c, x["cluster"]): x["vec"] for b in batches for c, book in zip(b["component"].to_pylist(), b["c"].to_pylist(), strict=True) for x in book}
        assert sorted(c for b in batches for c in b["component"].to_pylist()) == list(range(300)) and got.keys() == sums.keys()
        for k, vec in got.items():
            n = len(vec) // 12
            dense = np.zeros(50)
            dense[np.frombuffer(vec, np.int64, n)] = np.frombuffer(vec, np.float32, n, 8 * n)
            assert np.allclose(dense, sums[k] / np.linalg.norm(sums[k]), atol=1e-6)
        assert [len(r["component"]) for r, _ in birch._lots(iter(table.to_batches(size)), "component")] and sum(len(s) - 1 for _, s in birch._lots(iter(table.to_batches(size)), "component")) == 300


def test_clusters(spark):
    rows = planted() + [("lone", "F_alone", 5.0, "")]
    v = packed_vectors(spark.createDataFrame(rows, VEC), "cell_id", F.col("gene"), F.col("value"))
    a = birch.clusters(v).cache()
    got = {}
    for r in birch.tight_groups(a).collect():
        got.setdefault(r.cluster_first, set()).add(r.k)
    assert got == {f"g{g}_0": {f"g{g}_{i}" for i in range(8)} for g in range(6)}
    d = birch.describe(a).collect()
    assert {(r.cluster_first, r["size"]) for r in d} == {(f"g{g}_0", 8) for g in range(6)} | {("lone", 1)}
    # blocks of two give the same groups
    assert birch.tight_groups(a, block=2).count() == 48
    # groups that a cluster merged are parted again, those that clusters parted are joined
    one = a.withColumn("component", F.lit(1).cast("long"))
    for cluster in (F.lit("one"), F.col("k")):
        for block in (4096, 5):
            assert {(r.cluster_first, r.k) for r in birch.tight_groups(one.withColumn("cluster", cluster), block=block).collect()} == {(f, k) for f, ks in got.items() for k in ks}
    assert birch.clusters(v.limit(0)).count() == 0


def test_leaves_do_not_depend_on_batches(spark):
    rows = planted(groups=20)
    v = packed_vectors(spark.createDataFrame(rows, VEC), "cell_id", F.col("gene"), F.col("value")).withColumnRenamed("cell_id", "k").cache()
    own = "spark.sql.execution.arrow.maxRecordsPerBatch"
    seen = []
    for batch, parts in (("10000", 4), ("7", 4), ("31", 3)):
        spark.conf.set(own, batch)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        seen.append({tuple(sorted(r.cells)) for r in birch.cf_leaves(v.repartition(parts), chunk=9).select("cells").collect()})
    spark.conf.unset(own)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] == seen[2] and sum(map(len, seen[0])) == 160


# --- encoding ---------------------------------------------------------------------------------


def test_encoding(spark):
    pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as p

    t = tokenizers.Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rnd = random.Random(5)
    texts = ["", None, " ", "a" * 20_000, "日本語" * 3000, "<|endoftext|>", "  \r\n\t x", "they'LL 'll I'd", "​﻿", "😀👩‍🔬"]
    texts += ["".join(rnd.choice("abcdeé ß漢字\n'019.,") for _ in range(rnd.randrange(200))) for _ in range(300)]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in encode_texts(df, slice_chars=500).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert encode_texts(df.limit(0)).count() == 0
    b = ByteBPE(default_vocabulary())
    assert all(b.merge(w.encode()) == t.encode(w, add_special_tokens=False).ids for w in ("hello", "antidisestablishmentarianism", "x"))


# --- leakage ----------------------------------------------------------------------------------

ITEM = "Marker RZUR11 fades near the sclerotic fiducial but CCAD34B climbs near the calcified hinge, even though ninety cells drifted overnight. In the overstained ovarian imprint a spiral of monocytes crosses the repaired suture once both readers shrank unevenly."


def test_words():
    w = leakage.plain_words
    assert w("<b>In</b>&nbsp;the mar­gin, coll-\n> agen “Ａｎｄ” оf CAFÉ") == ["in", "the", "margin", "collagen", "and", "of", "cafe"]
    assert w(None) == w("") == w(" ​ .,") == []
    assert w("a\\nb\\u00e9 c%20d") == ["a", "be", "c", "d"] and w("細胞 x") == ["細", "胞", "x"]


def test_leaks(spark):
    words = ITEM.split()
    half = len(words) // 2
    docs = [
        (1, "Before. " + ITEM + " After."), (2, " ".join(words[half:]) + " filler words here " + " ".join(words[:half])), (3, " ".join(words[:12])),
        (4, " ".join(w if i % 9 else "other" for i, w in enumerate(words))), (5, None), (6, ""), (7, "Nothing of the kind is in here, not a word."), (8, ITEM.upper().replace("a", "а")), (9, " ".join(sorted(words))),
        (10, "x " * 50_000 + ITEM), (11, "Shared sentence that stands in every single item of this set. " + " ".join(words[:10])),
    ]
    items = [(100, ITEM), (101, None), (102, ""), (103, "too short"), (100, ITEM)] + [(200 + i, "Shared sentence that stands in every single item of this set. " + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(9)]
    d = spark.createDataFrame([(*x, 0.0, "e") for x in docs], "doc_id long, text string, held double, i string")
    i = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, d string")
    for block in (20_000, 3):
        assert {(r.doc_id, r.item_id) for r in leakage.leaked_items(d, i, block=block).collect()} == {(n, 100) for n in (1, 2, 4, 8, 10)}
    assert leakage.leaked_items(d.limit(0), i).count() == 0 and leakage.leaked_items(d, i.limit(0)).count() == 0


@pytest.mark.parametrize("many", [6, 60, 600])
def test_families_of_items(spark, many):
    """Any number of equal or nearly equal questions is found; an instruction they share is none."""
    tell = "Read the report below with care and answer in one short plain sentence for the board. "
    own = "Which {} turned pale after the seventh wash when both lamps of the north bench had failed again on Monday?"
    items = [(i, own.format("fiducial")) for i in range(many)] + [(1000 + i, own.format(f"slide{i}")) for i in range(many)]
    items += [(2000 + i, tell + " ".join(f"q{i}w{j}" for j in range(12))) for i in range(many)]
    docs = [(1, "x y z " + own.format("fiducial")), (2, tell + "Nothing else is in here."), (3, own.format("slide3"))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(n, k) for n in (1, 3) for k in [*range(many), *range(1000, 1000 + many)]}
    for block in (20_000, 50):
        if many < 600 or block > 50:
            assert {(r.doc_id, r.item_id) for r in leakage.leaked_items(d, i, block=block).collect()} == want


def test_long_markup():
    w = leakage.plain_words
    assert w("a <!-- " + "x " * 5000 + "--> b <p class='" + "y " * 5000 + "'> c <!-- open") == ["a", "b", "c", "open"]


def test_tiles_are_disjoint():
    a, b = np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, -1, -1, -1]), np.array([1, 2, 3, 4, 5, 1, 2, 3])
    assert sorted(leakage.tiles(a, b, 3)) == [(0, 0, 5), (6, 5, 3)]


# --- language ---------------------------------------------------------------------------------

EN = ["The cells were counted again after the first reader had left the room.", "Nobody could say why the signal was weaker in the second section.", "We moved the image so that the border would match the map."]
DE = ["Die Zellen wurden noch einmal gezählt, nachdem der erste Leser gegangen war.", "Niemand konnte sagen, warum das Signal im zweiten Schnitt schwächer war.", "Wir haben das Bild verschoben, damit der Rand zur Karte passt."]


def test_labels_in_any_notation(spark):
    df = spark.createDataFrame([(x,) for x in ("en-US", "ENG", " English ", "zh_Hans", "xx", "und", "", None, "de_AT")], "l string")
    assert [r[0] for r in df.select(language_code(F.col("l"))).collect()] == ["en", "en", "en", "zh", None, None, None, None, "de"]


def test_languages(spark):
    rnd = random.Random(3)
    train = [(i, " ".join(rnd.sample(EN, 3)), "en") for i in range(20)] + [(50 + i, " ".join(rnd.sample(DE, 3)), "German") for i in range(20)] + [(90, " ".join(EN), "de")]
    model = learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    texts = [(1, " ".join(EN), None), (2, " ".join(DE), "en"), (3, EN[0] + "\n\n" + DE[0], "de"), (4, " ".join(EN), "en_GB"), (5, "12 34\n56", None), (6, "", None), (7, None, None), (8, "BLANK_01 XPAZ14B 3.5", "de"), (9, EN[0] + " und aber nicht " + EN[1], "en"), (10, " ".join(EN) * 3000, "xx")]
    d = spark.createDataFrame([(*t, 0, True) for t in texts], "doc_id long, text string, lang string, segment int, sentence boolean")
    s = segment_languages(d, model, slice_chars=1000)
    out = corrected_labels(d, document_languages(s))
    assert {(r.doc_id, r.lang, r.reason) for r in out.collect()} == {(1, "en", "missing"), (2, "de", "wrong"), (3, "en", "mixed"), (3, "de", "mixed"), (10, "en", "missing")}
    seg = [(r.start, r.stop, r.lang) for r in s.filter("doc_id = 3").orderBy("segment").collect()]
    assert [x[2] for x in seg] == ["en", "de"] and seg[1][0] == len(EN[0]) + 2
    assert segment_languages(d.limit(0), model).count() == 0
    assert model.temper > 0 and s.filter("confidence < 0 or confidence > 1.000001").count() == 0
    none = learn(d.limit(0))
    assert none.languages == [] and segment_languages(d, none).count() == 0
    assert learn(d.withColumn("lang", F.lit("unknown"))).languages == []
    assert corrected_labels(d, document_languages(segment_languages(d, none))).count() == 0


def test_rare_and_repeated_labels(spark):
    """One row of a language of its own is learnt, two wrong labels are none; copies fill no places; late sentences count."""
    rnd = random.Random(4)
    train = [(" ".join(rnd.sample(EN, 3)) + f" It was seen {'again ' * i}today.", "en") for i in range(30)]
    train += [("Les cellules furent comptées encore une fois après le départ du premier lecteur. Personne ne pouvait dire pourquoi le signal était plus faible.", "fr")]
    train += [(" ".join(EN[:2]), "sv"), (" ".join(EN[1:]), "sv")]
    train += [(DE[0] + " " + DE[1], "de")] * 500 + [("9 " * 5000 + DE[i % 3] + f" Wieder wurde {'sehr ' * i}lange gezählt.", "de") for i in range(12)]
    model = learn(spark.createDataFrame(train, "text string, lang string"), per_language=40)
    assert model.languages == ["de", "en", "fr"]
    assert [model.languages[i] for i in model.judge([["wurde", "gezählt"], ["cells", "were", "counted"], ["personne", "ne", "pouvait"]])[0]] == ["de", "en", "fr"]


def test_code_length_is_a_probability():
    """Over all bytes that may follow, the probabilities of a context add up to at most 1."""
    from collections import Counter

    m = PPM(["x"], [Counter({"abab": 3, "abc": 2})])
    total = sum(2 ** -(m.bits([w])[0, 0]) for w in ("a", "b", "c", "ab", "abc", "abab", "ba"))
    assert 0 < total <= 1
    assert list(segments("One short. Dr. No!"))[0][3] is False
