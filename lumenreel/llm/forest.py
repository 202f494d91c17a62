"""Near-duplicate vectors through a forest of random-projection trees.

Every tree splits the unit vectors by random directions at medians; a vector close to a split goes to
both sides, within a margin that narrows as trees get deeper, so that a tree holds a vector SPILL times
at most in the mean. Vectors are compared within leaves only, all leaves of all trees, and what reaches the
cosine is a link. The trees are fitted on a bounded sample of SAMPLE vectors and are as deep as the
number of all vectors and their copies asks for: below nodes with too few sampled vectors for medians of their own, every
further level splits at the median of the last node that has them, so leaves hold about LEAF vectors at
every size of input. Every vector is put into the index. Vectors that are the same are one class that is indexed once. A pair that shares
several leaves counts in the first of them. A leaf of more than BLOCK classes is compared block by
block in tasks of its own, so nothing is left out and no task grows with it; from each comparison
only sums and the links of spanning stars go on. Links within a large group of near copies are counted by products of
matrices, not pair by pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, min_labels
from .components import connected_components

COSINE = 0.95
TREES, LEAF, SAMPLE, BLOCK = 8, 1024, 50_000, 4096
SPILL = 4.0  # copies of a vector in one tree at most, in the mean
SMALL = 1 << 20  # rows of (length, leaf, blocks) that may be broadcast, some 24 MB
HOT = 256  # classes with more than one in so many of all rows are split where rows meet classes
SALTS = 64
DENSE = 32  # linked vectors of a leaf beyond which pairs that share an earlier leaf are found by a product of matrices instead of one by one
LEAST_IN_LEAF = 8  # sampled vectors, below which a node gets no median of its own
SEED = 11


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Trees:
    """Of vectors of one length: directions (trees * depth, d), split points, and half the width of the overlap.

    splits (trees, 2 ** own) are those of the upper `own` levels by node; below (trees, depth - own, 2 ** own)
    are those of all further levels by the node of level `own` they lie under.
    """

    depth: int
    own: int
    directions: np.ndarray
    splits: np.ndarray
    below: np.ndarray
    margin: float

    @classmethod
    def fit(cls, x: np.ndarray, total: int, cosine: float, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> Trees:
        d = x.shape[1]
        depth, margin = cls.shape(d, total, cosine, leaf)
        own = min(depth, int(math.log2(max(1, len(x) / LEAST_IN_LEAF))))
        rng = np.random.default_rng((seed, d))
        directions = rng.normal(size=(trees * depth, d))
        directions /= np.sqrt((directions**2).sum(axis=1, keepdims=True))
        splits, below = np.zeros((trees, 1 << own)), np.zeros((trees, depth - own, 1 << own))
        for t in range(trees):
            node = np.ones(len(x), np.int64)
            for level in range(depth):
                p = x @ directions[t * depth + level]
                order = np.lexsort((p, node))
                ids, first, count = np.unique(node[order], return_index=True, return_counts=True)
                middle = p[order[first + count // 2]]
                if level < own:
                    splits[t, ids] = middle
                    node = 2 * node + (p >= splits[t, node])
                else:
                    below[t, level - own, :] = np.median(p)
                    below[t, level - own, ids - (1 << own)] = middle
        return cls(depth, own, directions, splits, below, margin)

    @staticmethod
    def shape(d: int, total: int, cosine: float, leaf: int = LEAF) -> tuple[int, float]:
        """(depth, margin): leaves of `leaf` vectors in the mean, copies counted, and no more than SPILL copies.

        The margin is half of how far apart the projections of two vectors at the cosine usually are, or
        less where so many levels would copy more. Of unit vectors about d ** 0.5 / (2 * pi) ** 0.5 of all lie in a
        strip of width one around the middle of a direction.
        """
        density = math.sqrt(d / (2 * math.pi))
        widest = 0.5 * math.sqrt(max(0, 2 - 2 * cosine) / d)
        depth = 0
        while True:
            share = min(2 * widest * density, SPILL ** (1 / max(depth, 1)) - 1)  # of a node's vectors that go to both sides
            if total * (1 + share) ** depth / 2**depth <= leaf:
                return depth, share / (2 * density)
            depth += 1

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, leaves): every row with each of its leaves, by row and leaf; leaves are numbered over all trees."""
        p = x @ self.directions.T
        rows_out, leaves_out = [], []
        for t in range(len(self.splits)):
            rows, node = np.arange(len(x)), np.ones(len(x), np.int64)
            for level in range(self.depth):
                split = self.splits[t, node] if level < self.own else self.below[t, level - self.own, (node >> (level - self.own)) - (1 << self.own)]
                away = p[rows, t * self.depth + level] - split
                left, right = away <= self.margin, away >= -self.margin
                rows, node = np.concatenate((rows[left], rows[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
            rows_out.append(rows)
            leaves_out.append((t << self.depth) + node - (1 << self.depth))
        rows, leaves = np.concatenate(rows_out), np.concatenate(leaves_out)
        order = np.lexsort((leaves, rows))
        return rows[order], leaves[order]


def compare(x: np.ndarray, weight: np.ndarray, side: np.ndarray, pair: bool, leaf: int, leaves_of: Callable[[np.ndarray], list[np.ndarray]], cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(partners, root) of each vector of a leaf: how many vectors it links to here for the first time, and the first row it is connected to.

    pair: only pairs of different sides are compared. `leaves_of` gives the leaves of some of the rows; only those with a link are asked for.
    """
    n = len(x)
    partners, label = np.zeros(n, np.int64), np.arange(n)
    rows, near = [], []
    for at in range(0, n, step := max(1, 2_000_000 // n)):
        hit = x[at : at + step] @ x.T >= cosine
        own = np.arange(at, at + len(hit))
        some = np.flatnonzero(np.count_nonzero(hit, axis=1) > hit[np.arange(len(hit)), own])  # more than itself
        hit, own = hit[some], own[some]
        hit &= side[own][:, None] < side if pair else own[:, None] < np.arange(n)
        some = hit.any(axis=1)
        rows.append(own[some])
        near.append(hit[some])
    rows, near = np.concatenate(rows), np.concatenate(near)
    if not len(rows):
        return partners, label
    busy = np.union1d(rows, np.flatnonzero(near.any(axis=0)))
    links = np.zeros((len(busy), len(busy)), bool)
    links[np.searchsorted(busy, rows)] = near[:, busy]
    del near
    leaves = [own[own < leaf] for own in leaves_of(busy)]  # the leaves before this one
    few: list[tuple[np.ndarray, np.ndarray]] = []
    for members in _connected(links):
        label[busy[members]] = busy[members[0]]
        if len(members) <= DENSE:
            a, b = np.nonzero(links[np.ix_(members, members)])
            few.append((members[a], members[b]))
        else:
            got = _first_time(links[np.ix_(members, members)], weight[busy[members]], [leaves[m] for m in members])
            partners[busy[members]] += got
    if few:
        a, b = (np.concatenate(c) for c in zip(*few, strict=True))
        earlier = np.full((len(busy), max(map(len, leaves))), -1, np.int64)
        for i, own in enumerate(leaves):
            earlier[i, : len(own)] = own
        for s in range(0, len(a), 1 << 16):  # shared leaves before this one: the pair was counted there
            i, j = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
            new = np.ones(len(i), bool)
            for k in range(earlier.shape[1]):
                e = earlier[i, k]
                new &= ~((e >= 0) & (earlier[j] == e[:, None]).any(axis=1))
            i, j = busy[i[new]], busy[j[new]]
            np.add.at(partners, i, weight[j])
            np.add.at(partners, j, weight[i])
    return partners, label


def _connected(links: np.ndarray) -> list[np.ndarray]:
    """The rows of each connected part of a table of links, in their order."""
    both = links | links.T
    seen, parts = np.zeros(len(both), bool), []
    for i in range(len(both)):
        if not seen[i]:
            seen[i] = True
            members, front = [np.array([i])], np.array([i])
            while len(front):
                front = np.flatnonzero(both[front].any(axis=0) & ~seen)
                seen[front] = True
                members.append(front)
            parts.append(np.sort(np.concatenate(members)))
    return parts


def _first_time(links: np.ndarray, weight: np.ndarray, leaves: list[np.ndarray]) -> np.ndarray:
    """How many vectors each row links to that it shares no earlier leaf with; which rows have which leaf is a matrix, and its product with itself says what is shared."""
    names, at = np.unique(np.concatenate(leaves), return_inverse=True)
    has = np.zeros((len(leaves), len(names)), np.float32)
    has[np.repeat(np.arange(len(leaves)), [len(own) for own in leaves]), at] = 1
    out, heavy = np.zeros(len(links)), weight.astype(np.float64)
    for s in range(0, len(links), 1024):
        new = (links[s : s + 1024] & (has[s : s + 1024] @ has.T == 0)).astype(np.float64)
        out[s : s + 1024] += new @ heavy
        out += heavy[s : s + 1024] @ new
    return out.astype(np.int64)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors` (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do
    vectors of different lengths. Each row counts as a vector of its own, repeated rows too; a null
    id never names a component that holds another id. Empty table: no rows.
    """
    v = F.col("embedding")
    good = F.coalesce(
        v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0),
        F.lit(False),
    )
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", good.alias("good"))
    alone = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = rows.where("good").select("vec_id", "embedding")
    classes = materialize(rows.groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("size")).withColumn("cid", F.monotonically_increasing_id()))
    shared = vectors.sparkSession.sparkContext.broadcast(_fit(classes, cosine, sample))

    def leaves(vectors: pa.Array):
        """(length, rows, leaf of each) for each length of the vectors."""
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))
        lengths = np.diff(np.concatenate(([0], ends)))
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            trees = shared.value.get(int(d))
            r, f = trees.leaves(unit(flat[(ends[at] - d)[:, None] + np.arange(d)])) if trees else (np.arange(len(at)), np.zeros(len(at), np.int64))
            yield int(d), at[r], f

    def deal(b: pa.RecordBatch) -> pa.RecordBatch:
        """Rows of (leaf, cid, size, embedding)."""
        take, leaf = (np.concatenate(c) for c in list(zip(*leaves(b.column(2)), strict=True))[1:])
        take = pa.array(take)
        return pa.RecordBatch.from_arrays([pa.array(leaf), *(b.column(c).take(take) for c in range(3))], ["leaf", "cid", "size", "embedding"])

    def count(b: pa.RecordBatch):
        """(d, leaf, n): how many vectors of a batch each leaf gets."""
        for d, _, leaf in leaves(b.column(0)):
            leaf, n = np.unique(leaf, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), d, np.int32)), pa.array(leaf), pa.array(n)], ["d", "leaf", "n"])

    kind = dict(classes.dtypes)["embedding"]
    dealt = classes.select("cid", "size", "embedding").mapInArrow(lambda bs: (deal(b) for b in bs if b.num_rows), f"leaf bigint, cid bigint, size bigint, embedding {kind}")
    dealt = dealt.withColumn("d", F.size("embedding"))
    counted = classes.select("embedding").mapInArrow(lambda bs: (c for b in bs if b.num_rows for c in count(b)), "d int, leaf bigint, n bigint").groupBy("d", "leaf").agg(F.sum("n").alias("n"))
    large = materialize(counted.where(F.col("n") > BLOCK).select("d", "leaf", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    few = F.broadcast(large) if large.count() <= SMALL else large
    cut = dealt.join(few, ["d", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    keyed = cut.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = keyed.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    keyed = keyed.select(F.xxhash64("d", "leaf", "i", "j").alias("grp"), "d", "leaf", "i", "j", "side", "cid", "size", "embedding")

    def link(batches):
        held: list[pa.RecordBatch] = []

        def of_group(t: pa.Table) -> pa.RecordBatch:
            col = lambda c: t.column(c).to_numpy()
            d = int(t.column("d")[0].as_py())
            x = unit(t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
            cid = col("cid")
            trees = shared.value.get(d)

            def leaves_of(some: np.ndarray) -> list[np.ndarray]:
                r, f = trees.leaves(x[some]) if trees else (np.arange(len(some)), np.zeros(len(some), np.int64))
                return np.split(f, np.flatnonzero(np.diff(r)) + 1)

            partners, label = compare(x, col("size"), col("side"), int(t.column("i")[0].as_py()) != int(t.column("j")[0].as_py()), int(t.column("leaf")[0].as_py()), leaves_of, cosine)
            some = np.flatnonzero((partners > 0) | (label != np.arange(len(cid))))
            return pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(partners[some]), pa.array(cid[label[some]])], ["cid", "partners", "root"])

        def groups(last: bool):
            nonlocal held
            t = pa.Table.from_batches(held)
            g = t.column("grp").to_numpy()
            starts = np.append(np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))), len(g))
            stop = len(starts) - 1 if last else len(starts) - 2
            for k in range(stop):
                # the hash of two groups may be the same
                part = t.slice(starts[k], starts[k + 1] - starts[k])
                names, which = np.unique(np.stack([part.column(c).to_numpy().astype(np.int64) for c in ("d", "leaf", "i", "j")], axis=1), axis=0, return_inverse=True)
                for name in range(len(names)):
                    yield of_group(part if len(names) == 1 else part.filter(pa.array(which.ravel() == name)))
            held = [] if last else t.slice(starts[stop]).combine_chunks().to_batches()

        for b in batches:
            if b.num_rows:
                held.append(b)
                if b.column(0)[0] != b.column(0)[-1] or held[0].column(0)[0] != b.column(0)[0]:
                    yield from groups(False)
        if held:
            yield from groups(True)

    found = materialize(keyed.repartition("grp").sortWithinPartitions("grp").mapInArrow(link, "cid bigint, partners bigint, root bigint"))
    counts = found.groupBy("cid").agg(F.sum("partners").alias("partners"))
    roots = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid").withColumnRenamed("component", "root")
    named = classes.select("cid", "low", "size", "embedding").join(counts, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = materialize(named)
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_vector = named.join(lows, "root").select("embedding", (F.coalesce("partners", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    linked = _with_classes(rows, by_vector, classes).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return linked.unionByName(alone)


def _with_classes(rows: DataFrame, by_vector: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with what is known of their vectors. Vectors of more than one row in HOT, fewer than HOT of them, are dealt to SALTS tasks each."""
    total = classes.agg(F.sum("size")).first()[0] or 0
    hot = [h for (h,) in classes.where(F.col("size") * HOT > total).select(F.xxhash64("embedding")).collect()]
    often = F.xxhash64("embedding").isin(hot) if hot else F.lit(False)
    salted = rows.withColumn("salt", F.when(often, F.pmod(F.xxhash64("vec_id", F.rand(SEED)), F.lit(SALTS)).cast("int")).otherwise(0))
    every = by_vector.withColumn("salt", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(every, ["embedding", "salt"])


def _fit(classes: DataFrame, cosine: float, sample: int) -> dict[int, Trees]:
    """Trees for each length of vector in the sample, which a hash picks where the rows are read; vectors of other lengths share one leaf."""
    total = classes.count()
    picked = classes.where(F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) < int(min(1.0, 1.1 * sample / max(total, 1)) * (1 << 30)) + 1)
    few = picked.orderBy(F.xxhash64("cid"), "cid").limit(sample).select("embedding").toArrow().column("embedding").to_pylist()
    by: dict[int, list] = {}
    for e in few:
        by.setdefault(len(e), []).append(e)
    return {d: Trees.fit(unit(np.array(es)), total * len(es) // len(few), cosine) for d, es in by.items()}
