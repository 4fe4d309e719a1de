"""NN-descent near-dedup and the adaptive scan against brute force."""
import numpy as np
import pytest
from fixtures import stored

from lexkit.llm import near_vectors, neighbours
from lexkit.llm.common import components

SCHEMA = "vec_id bigint, embedding array<float>, label int, n int, u string"


def table(seed=0, d=16):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(300, d))
    v[40:70] = v[40] + rng.normal(scale=0.02, size=(30, d))       # near copies
    v[80:120] = v[80]                                             # copies
    v[130] = v[131] * 3                                           # same direction
    out = [(i, [float(x) for x in v[i].astype(np.float32)], i % 3 if i < 40 or i >= 140 else 1, 1, "x") for i in range(300)]
    bad = [(1000, None, 1), (1001, [0.0] * d, 1), (1002, [float("nan")] + [1.0] * (d - 1), 1), (1003, [None] + [1.0] * (d - 1), 1),
           (1004, [float("inf")] + [1.0] * (d - 1), 1), (1005, [1.0], 1), (1006, [1.0] * d, None)]
    return out + [(i, e, lab, 1, "x") for i, e, lab in bad]


def usable(rows, d=16):
    return [(r[0], np.array(r[1], float), r[2]) for r in rows if r[1] is not None and len(r[1]) == d
            and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]


def test_near_vectors(spark):
    rows = table()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(stored(spark, rows, SCHEMA)).collect()}
    v = [x for x in usable(rows) if x[2] is not None]
    par = {r[0]: r[0] for r in rows}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    links = dict.fromkeys(par, 0)
    for i, (a, x, la) in enumerate(v):
        for b, y, lb in v[:i]:
            if la == lb and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a] += 1
                links[b] += 1
                par[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: (links[i], find(i), find(i) == i) for i in par}


def test_large_cluster_is_counted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK_ROWS", 8)
    rows = table()
    got = {r["vec_id"]: r["n_links"] for r in near_vectors.near_vectors(stored(spark, rows, SCHEMA)).collect()}
    assert all(got[i] == 39 for i in range(80, 120)) and got[50] >= 25


def test_near_vectors_empty(spark):
    assert near_vectors.near_vectors(stored(spark, [], SCHEMA)).count() == 0
    one = near_vectors.near_vectors(stored(spark, [(7, [1.0, 0.0], 1, 1, "")], SCHEMA)).collect()
    assert [tuple(r) for r in one] == [(7, 0, 7, True)]


def test_vectors_without_id_and_of_several_lengths(spark):
    rows = [(0, [1.0, 0.0, 0.0], 1, 1, ""), (50, [1.0, 0.0, 0.0], 1, 1, ""), (1, [1.0, 1.0], 1, 1, ""), (2, [1.0, 1.0], 1, 1, ""),
            (100, [1.0, 0.9], 1, 1, ""), (None, [1.0, 1.0], 1, 1, ""), (None, None, 1, 1, ""), (3, [], 1, 1, "")]
    got = sorted((tuple(r) for r in near_vectors.near_vectors(stored(spark, rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(0, 1, 0, True), (50, 1, 0, False), (1, 2, 1, True), (2, 2, 1, False), (100, 2, 1, False), (3, 0, 3, True),
                          (None, 0, None, True), (None, 0, None, True)], key=str)
    hits = sorted((r["query_id"], r["rank"], r["id"]) for r in neighbours.nearest(stored(spark, rows, SCHEMA), 50).collect())
    assert hits == [(0, 1, 50), (50, 1, 0), (100, 1, 1), (100, 2, 2)]


@pytest.mark.parametrize("block", [neighbours.QUERY_ROWS, 3])
def test_nearest_recall_and_order(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "QUERY_ROWS", block)
    rows = table(1)
    got = {}
    for r in neighbours.nearest(stored(spark, rows, SCHEMA), 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    v = usable(rows)
    ids, x = np.array([a for a, _, _ in v]), np.stack([b for _, b, _ in v])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = total = 0
    assert set(got) == {i for i in ids if i % 10 == 0}
    for q, hits in got.items():
        hits.sort()
        s = u @ u[ids == q][0]
        s[ids == q] = -9
        kth = np.sort(s)[-5]
        assert [h[0] for h in hits] == [1, 2, 3, 4, 5] and q not in [h[1] for h in hits]
        assert [(-h[2], h[1]) for h in hits] == sorted((-h[2], h[1]) for h in hits)
        for _, i, score in hits:
            assert score == pytest.approx(s[ids == i][0], abs=1e-12)
            found += score >= kth - 1e-9
        total += 5
    assert found / total >= 0.9


def test_adaptive_scan_abandons_but_keeps_the_nearest():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:40] + rng.normal(scale=0.05, size=(40, 64))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    found = neighbours.adaptive_scan(q, x, 5)
    assert sum(len(f) for f in found) < 0.2 * 40 * 3000
    true = np.argsort(-(q @ x.T), 1)[:, :5]
    assert np.mean([t in f for f, row in zip(found, true, strict=True) for t in row]) > 0.95


def test_nearest_few_and_none(spark):
    assert neighbours.nearest(stored(spark, [], SCHEMA), 10).count() == 0
    few = neighbours.nearest(stored(spark, [(10, [1.0, 0.0], 1, 1, ""), (3, [1.0, 1.0], 1, 1, ""), (2, [1.0, 1.0], 1, 1, "")], SCHEMA), 10)
    assert [(r["id"], r["rank"]) for r in few.orderBy("rank").collect()] == [(2, 1), (3, 2)]


def test_components(spark):
    e = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (300, 200)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(e, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
