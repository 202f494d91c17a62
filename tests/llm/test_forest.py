"""op2 against all pairs."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lumenreel.llm import forest, queries
from lumenreel.llm.common import min_labels, read


def brute(rows, cosine=0.95):
    good = [k for k, (_, e) in enumerate(rows) if e and all(c is not None and np.isfinite(c) for c in e) and any(c != 0 for c in e)]
    x = np.array([rows[k][1] for k in good], np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    link = x @ x.T >= cosine
    np.fill_diagonal(link, False)
    label = min_labels(len(good), *np.nonzero(link))
    ids = np.array([rows[k][0] for k in good])
    out = {}
    for j, k in enumerate(good):
        low = int(ids[label == label[j]].min())
        out[k] = (rows[k][0], int(link[j].sum()), low, rows[k][0] == low)
    return sorted(out.get(k, (i, 0, i, True)) for k, (i, _) in enumerate(rows))


def test_recall_on_the_whole_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in read(spark, sf, "embeddings").collect()]
    want, got = brute(rows), sorted(tuple(r) for r in queries.op2_embedding_near_dedup(spark, sf).collect())
    assert [w[0] for w in want] == [g[0] for g in got]
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_hot_group_and_edge_cases(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=8)
    rows = [(k, (base + 0.02 * rng.normal(size=8)).astype(np.float32).tolist()) for k in range(300)]
    rows += [(1000 + k, rng.normal(size=8).astype(np.float32).tolist()) for k in range(200)]
    rows += [(2000 + k, rows[0][1]) for k in range(50)]
    rows += [(3000, None), (3001, [0.0] * 8), (3002, [float("nan")] + [1.0] * 7), (3003, [float("inf")] + [1.0] * 7), (3004, [None] + [1.0] * 7), (3005, [])]
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], "vec_id bigint, embedding array<float>, label int, size string")
    got = sorted(tuple(r) for r in forest.near_duplicates(df).collect())
    assert got == brute(rows)
    assert forest.near_duplicates(df.limit(0)).count() == 0


def test_split_leaves_and_many_leaves_lose_little(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(60, 16))
    rows = [(k, (centers[k % 60] + 0.05 * rng.normal(size=16)).astype(np.float32).tolist()) for k in range(1500)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    monkeypatch.setattr(forest, "BLOCK", 64)
    real = forest.Trees.fit
    monkeypatch.setattr(forest.Trees, "fit", classmethod(lambda cls, x, total, cosine: real(x, total, cosine, leaf=100)))
    want, got = brute(rows), sorted(tuple(r) for r in forest.near_duplicates(df).collect())
    assert sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def planted(n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    at = rng.permutation(n)[: n // 10].reshape(-1, 2)  # pairs just over the cosine, and closer ones
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=(len(at), d))
    off -= (off * x[at[:, 0]]).sum(axis=1, keepdims=True) * x[at[:, 0]]
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cos = rng.uniform(0.951, 0.999, size=(len(at), 1))
    x[at[:, 1]] = cos * x[at[:, 0]] + np.sqrt(1 - cos**2) * off
    return x, at


def test_recall_of_planted_pairs_at_depth(spark, tmp_path_factory):
    """At the parameters of the query, with seven levels of splits."""
    x, pairs = planted(70_000, 32, 4)
    assert forest.Trees.fit(x[:50_000], len(x), 0.95).depth >= 7
    folder = tmp_path_factory.mktemp("vectors")
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}), folder / "part.parquet")
    df = spark.read.parquet(str(folder))
    got = forest.near_duplicates(df).where("n_links > 0").select("vec_id", "component_id").toPandas()
    component = dict(zip(got.vec_id, got.component_id, strict=True))
    assert sum(component.get(a) == component.get(b) == min(a, b) for a, b in pairs) >= 0.95 * len(pairs)


def test_leaves_stay_small_beyond_the_sample():
    """Ten times the vectors: leaves as large as before, little more work a vector; and near pairs still meet."""
    x, pairs = planted(60_000, 32, 5)
    cost, largest = [], []
    for total in (6_000, 60_000):
        trees = forest.Trees.fit(x[:2000], total, 0.95, leaf=64)
        rows, leaves = trees.leaves(x[:total])
        _, size = np.unique(leaves, return_counts=True)
        cost.append((size.astype(float) ** 2).sum() / total)
        largest.append(np.percentile(size, 99))
    assert trees.depth >= 10 and trees.own == 7
    assert cost[1] < 3 * cost[0] and largest[1] < 3 * largest[0], (cost, largest)
    of = np.split(leaves, np.flatnonzero(np.diff(rows)) + 1)
    assert sum(bool(set(of[a]) & set(of[b])) for a, b in pairs) >= 0.95 * len(pairs)


def test_copies_and_leaves_stay_bounded_at_any_size():
    """By the formula for a million to a billion vectors; and as measured on trees of a billion's depth."""
    for total in (50_000, 10**6, 10**8, 10**9):
        depth, margin = forest.Trees.shape(64, total, 0.95)
        share = 2 * margin * np.sqrt(64 / (2 * np.pi))
        assert (1 + share) ** depth <= forest.SPILL * 1.001 and total * (1 + share) ** depth / 2**depth <= forest.LEAF
    trees = forest.Trees.fit(np.array(planted(forest.SAMPLE, 64, 7)[0]), 10**9, 0.95)
    x, pairs = planted(20_000, 64, 6)
    rows, leaves = trees.leaves(x)
    assert trees.depth >= 20 and len(rows) / len(x) < 1.25 * forest.TREES * forest.SPILL
    of = np.split(leaves, np.flatnonzero(np.diff(rows)) + 1)
    assert np.mean([bool(set(of[a]) & set(of[b])) for a, b in pairs]) >= 0.95


def test_hot_vectors_are_dealt_out(spark):
    """A third of all rows with one vector, null ids and repeated rows among them."""
    rows = [(k if k % 50 else None, [1.0, 0.0, float(k % 3 == 0)] if k % 3 == 0 else [float(np.sin(k)), float(np.cos(k)), 0.5 + k]) for k in range(900)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = forest.near_duplicates(df).collect()
    assert len(got) == len(rows)
    same = [r for r in got if r["vec_id"] is not None and r["vec_id"] % 3 == 0]
    assert len({r["component_id"] for r in same}) == 1 and min(r["n_links"] for r in same) >= 299


@pytest.mark.parametrize("pair", [False, True])
def test_links_of_a_leaf_against_all_its_pairs(pair):
    """Large and small groups of near copies: links, those counted in an earlier leaf left out, and groups; leaves are asked for only where there is a link."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 64))
    x = np.concatenate([centres[np.repeat(np.arange(3), (150, 40, 5))] + 0.05 * rng.normal(size=(195, 64)), centres[3:]])
    x = forest.unit(x[rng.permutation(len(x))])
    n, leaf = len(x), 500
    weight, side = rng.integers(1, 4, n), rng.integers(0, 2, n)
    sets = [np.unique(np.append(rng.choice(60, 1) + 470, leaf)) for _ in range(n)]
    asked = []
    partners, root = forest.compare(x, weight, side, pair, leaf, lambda rows: (asked.extend(rows), [sets[r] for r in rows])[1], 0.95)
    want, links = np.zeros(n, int), []
    for a in range(n):
        for b in range(a + 1, n):
            if x[a] @ x[b] >= 0.95 and (not pair or side[a] != side[b]):
                links.append((a, b))
                if not any(e < leaf and e in sets[b] for e in sets[a]):
                    want[a] += weight[b]
                    want[b] += weight[a]
    assert partners.tolist() == want.tolist() and want.sum() > 5000
    a, b = np.array(links).T
    assert root.tolist() == forest.min_labels(n, a, b).tolist()
    assert sorted(asked) == sorted({r for link in links for r in link}) and len(asked) < n
