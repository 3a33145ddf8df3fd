import random
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorewell.llm import manifest, negatives, topk, vectors

VECTORS = "vec_id long, embedding array<double>, label int, row string, part string, tree string, score string"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, node string, path string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", None, "x", None) for i, v, label in rows], VECTORS)


def dot(a, b):
    limit = 2**62 - 1
    return max(-limit, min(limit, sum(int(np.floor(256 * x)) * int(np.floor(256 * y)) for x, y in zip(a, b))))


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def last(i):
    return (i is None, i or 0)


def small(seed=3, n=160):
    """Half of the rows share a vector; ids are null or repeated, vectors are null, ragged, empty or not finite."""
    rng = random.Random(seed)
    hot = [0.5, -0.25, 0.125]
    rows = [(i, hot if i % 2 else [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(3)], i % 4) for i in range(n)]
    rows += [(10, [1.0, 1.0, 1.0], 1), (10, [1.0, 1.0, 1.0], 1), (None, hot, 2), (None, [1.0, 1.0, 1.0], 2), (300, [2.0], 1), (301, [], 0), (310, None, 1), (320, [1.0, None, 1.0], 1), (330, [float("nan"), 1.0, 1.0], 1), (340, [float("inf"), 1.0, 1.0], 1), (350, hot, None)]
    return rows


def brute_top(rows, k):
    rows = [r for r in rows if usable(r[1])]
    out = []
    for a, (i, v, _) in enumerate(rows):
        if i is not None and i % 10 == 0:
            scored = sorted(((-dot(v, w), *last(j), b) for b, (j, w, _) in enumerate(rows) if b != a))[:k]
            out += [(i, n + 1, None if null else j, -s) for n, (s, null, j, _) in enumerate(scored)]
    return out


def brute_negatives(rows, k, m):
    rows = [r for r in rows if usable(r[1]) and r[2] is not None]
    out = []
    for a, (i, v, label) in enumerate(rows):
        if i is None or i % 10:
            continue
        scored = sorted((-dot(v, w), *last(j), b) for b, (j, w, _) in enumerate(rows) if b != a)
        for s, null, j, b in [x for x in scored if rows[x[3]][2] == label][:k]:
            inside = [x for x in scored if rows[x[3]][2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:m]
            out += [(i, None if null else j, n + 1, None if x[1] else x[2], -s, -x[0]) for n, x in enumerate(inside)]
    return out


def by(rows):
    return sorted(rows, key=lambda r: [last(x) for x in r])


@pytest.fixture
def many_parts(monkeypatch):
    monkeypatch.setattr(vectors, "PART_ROWS", 40)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 12)
    monkeypatch.setattr(topk, "BINS", 16)
    monkeypatch.setattr(topk, "_ROWS", 4)
    monkeypatch.setattr(topk, "_COLUMNS", 7)


def test_top_k_is_brute_force_with_ties_nulls_and_ragged_vectors(spark, many_parts):
    rows = small()
    got = topk.exact_top_k(frame(spark, rows), F.col("id") % 10 == 0, k=5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert by(map(tuple, got.collect())) == by(brute_top(rows, 5))


def test_top_k_of_fewer_rows_and_of_none(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [0.5, 0.5], 1), (10, [-1.0, 0.5], 1)]
    assert by(map(tuple, topk.exact_top_k(frame(spark, rows), F.col("id") % 10 == 0, k=5).collect())) == by(brute_top(rows, 5))
    assert topk.exact_top_k(frame(spark, rows[:1]), F.col("id") % 10 == 0).count() == 0
    assert topk.exact_top_k(frame(spark, []), F.col("id") % 10 == 0).count() == 0
    assert topk.exact_top_k(frame(spark, rows[1:2]), F.col("id") % 10 == 0).count() == 0


def test_top_k_of_large_components_is_exact(spark):
    rng = random.Random(5)
    for size in (1e3, 1e6, 1e12, 1e300):
        rows = [(i, [rng.uniform(-size, size) for _ in range(4)], 0) for i in range(30)]
        got = topk.exact_top_k(frame(spark, rows), F.col("id") % 10 == 0, k=5)
        cut = [(i, [max(-(2.0**63), min(2.0**63 - 1024, 256 * x)) / 256 for x in v], 0) for i, v, _ in rows]
        assert by(map(tuple, got.collect())) == by(brute_top(cut if size == 1e300 else rows, 5))


def test_negatives_are_brute_force_with_ties_nulls_and_ragged_vectors(spark, many_parts, monkeypatch):
    monkeypatch.setattr(negatives, "TREE_ROWS", 5)
    monkeypatch.setattr(negatives, "_COLUMNS", 7)
    rows = small(seed=8)
    got = negatives.hard_negatives(frame(spark, rows), F.col("id") % 10 == 0, positives=3, negatives=4)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, 3, 4)
    assert want and by(map(tuple, got.collect())) == by(want)


def test_negatives_of_no_rows(spark):
    assert negatives.hard_negatives(frame(spark, []), F.col("id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(frame(spark, [(0, [1.0], 1), (1, [1.0], 1)]), F.col("id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(frame(spark, [(0, None, 1), (1, [1.0], None)]), F.col("id") % 10 == 0).count() == 0


def walked(rng, spread):
    """Anchors around one point, candidates anywhere."""
    middle = rng.normal(size=16)
    anchors = np.rint(2000 * (middle + spread * rng.normal(size=(40, 16)))).astype(np.int64)
    cands = np.rint(2000 * rng.normal(size=(3000, 16))).astype(np.int64)
    lists = lambda m: pa.array(m.tolist(), pa.list_(pa.int64()))
    tree = negatives._spanning_tree(pa.table({"tree": ["t"] * 40, "row": range(5000, 5040), "id": range(40), "label": [0] * 40, "v": lists(anchors)}))
    return tree, negatives.Walk(pa.table({"row": range(3000), "id": range(3000), "label": [1] * 3000, "v": lists(cands)})), cands


def test_bounds_hold_and_spare_rescoring(spark):
    rng = np.random.default_rng(2)
    for spread in (0.0, 0.01, 1.0):
        tree, walk, cands = walked(rng, spread)
        v = np.array(tree["v"].to_pylist())
        true = v @ cands.T
        least = np.sort(true, axis=1)[:, -20]

        def wanted(i, block, low, high):
            assert (low <= true[i, block]).all() and (true[i, block] <= high).all()
            return high >= least[i]

        for i, block, at, exact in walk.scores(tree, wanted):
            assert (true[i, block][at] == exact).all()
        if spread < 1:
            assert walk.rescored < 0.1 * walk.met


def test_a_spanning_tree_is_minimal():
    rng = np.random.default_rng(4)
    tree, _, _ = walked(rng, 1.0)
    v, parent, edge = np.array(tree["v"].to_pylist(), float), tree["parent"].to_numpy(), tree["edge"].to_numpy()
    assert (parent < np.arange(40)).all() and parent[0] == -1
    assert np.allclose(edge[1:], np.linalg.norm(v[1:] - v[parent[1:]], axis=1))
    groups, total = list(range(40)), 0.0
    for d, a, b in sorted((np.linalg.norm(v[a] - v[b]), a, b) for a in range(40) for b in range(a)):  # Kruskal
        if groups[a] != groups[b]:
            total += d
            groups = [groups[a] if g == groups[b] else g for g in groups]
    assert np.isclose(edge.sum(), total)


def hashed(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return hashed("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def root_of(nodes):
    while len(nodes) > 1:
        nodes = [hashed("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0]


def around(nodes, i):
    """The digests left and right of node i, level by level."""
    while len(nodes) > 1:
        first = i - i % 16
        yield "".join(nodes[first:i]), "".join(nodes[i + 1 : first + 16])
        nodes, i = [hashed("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)], i // 16


def brute_manifest(rows):
    lower = {c: c + 32 for c in range(65, 91)}
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = [sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources]
    tops = [root_of([leaf(r) for r in t]) for t in trees]
    for k, t in enumerate(trees):
        leaves = [leaf(r) for r in t]
        for i, r in enumerate(t):
            path = [*around(leaves, i), *around(tops, k)]
            node = leaves[i]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = leaf((*r[:4], r[4].translate(lower)))
            for a, b in path:
                node = hashed(a + node + b)
            yield r[0], leaves[i], tops[k], root_of(tops), hashed("".join(a + b for a, b in path)), node, node == root_of(tops)


def test_manifest_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BUCKET_ROWS", 100)
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "B", "é", None, "", "b"]), rng.choice(["en", None]), rng.choice([7, None]), rng.choice(["Text A", "lower", "", None, "Ünï \U0001f600", "X" * 3000])) for i in range(600)]
    rows += [(None, "a", "en", 1, "Null Id"), (None, None, None, None, None), (5, "a", "en", 1, "Again"), (5, "a", "en", 1, "Again"), (5, "a", "de", 1, "Again"), (9, "alone", "en", 1, "One")]
    rows += [(1000 + i, f"s{i}", "en", 2, "Of its own") for i in range(40)]
    got = manifest.merkle_manifest(spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS).repartition(5))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_manifest(rows)))
    assert {r.verified for r in got.collect()} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 16, 17, 257])
def test_manifest_of_one_source(spark, n):
    rows = [(i, "only", "en", i, f"Text {i}") for i in range(n)]
    got = manifest.merkle_manifest(spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS))
    assert sorted(map(tuple, got.collect())) == sorted(brute_manifest(rows))
