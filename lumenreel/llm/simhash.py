"""SimHash near-duplicates through Gray-ordered hierarchical indexes.

Fingerprints that differ in at most k bits agree on one of k+1 bit blocks, so each distinct
fingerprint is dealt to k+1 blocks by its bits there. Within a block value the fingerprints are
sorted by Gray rank, cut into leaves, and every node of the tree above them keeps the bits that all
its fingerprints share. A pair of nodes is dropped as soon as the differences that have accumulated
on shared bits pass k, so whole groups are pruned at once. Only links of a spanning star leave a
task, so a group of any size gives fewer links than it has fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, map_arrow, materialize, min_labels, text_bytes
from .components import connected_components

SHINGLE = 3
MAX_BITS = 3
#: A block value with more distinct fingerprints than this is dealt again by blocks of the other bits.
SPLIT_OVER = 512
LEAF, FAN = 16, 8


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> list[int]:
    words = (text or b"").lower().split()  # both know ASCII only
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], 42) for s, e in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def majority_bits(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """Bits that over half of the 64-bit hashes have."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), block):
        counts += np.unpackbits(hashes[k : k + block].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_type: str = "bigint") -> DataFrame:
    """(doc_id, fp: bigint) for each row, the id as `id_type`; a text that is null or has no words has fingerprint 0."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = [majority_bits(np.array(shingle_hashes(t.as_py(), size), np.uint64)) for t in b.column(1)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast(id_type).alias("doc_id"), text_bytes(docs).alias("text")), run, f"doc_id {id_type}, fp bigint")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in Gray order."""
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def _nodes(fp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of fp[bounds[i]:bounds[i+1]]: the bits all share, as mask and pattern."""
    both, any_ = np.bitwise_and.reduceat(fp, bounds[:-1]), np.bitwise_or.reduceat(fp, bounds[:-1])
    return ~(both ^ any_), both


def index_links(fp: np.ndarray, k: int = MAX_BITS, block: int = 1 << 16) -> np.ndarray:
    """Root (a position) of each of the distinct fingerprints `fp`, linked at k or fewer differing bits."""
    n = len(fp)
    order = np.argsort(gray_rank(fp), kind="stable")
    s = fp[order]
    levels, bounds = [], np.append(np.arange(0, n, LEAF), n)
    while True:
        levels.append((bounds, *_nodes(s, bounds)))
        if len(bounds) <= 2:
            break
        bounds = np.append(bounds[:-1][::FAN], n)
    labels = np.arange(n)

    def visit(level: int, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs i <= j of nodes of a level; depth first and in blocks, so memory stays bounded."""
        nonlocal labels
        for at in range(0, len(i), block):
            x, y = i[at : at + block], j[at : at + block]
            _, mask, pattern = levels[level]
            far = np.bitwise_count((pattern[x] ^ pattern[y]) & mask[x] & mask[y])
            near = far <= k
            x, y = x[near], y[near]
            if not len(x):
                continue
            if level:
                below = len(levels[level - 1][0]) - 1
                cx, cy = (z[:, None] * FAN + np.arange(FAN) for z in (x, y))
                cx, cy = np.repeat(cx, FAN, axis=1).ravel(), np.tile(cy, (1, FAN)).ravel()
                fits = (cx <= cy) & (cy < below)
                visit(level - 1, cx[fits], cy[fits])
                continue
            for part in range(0, len(x), block // (LEAF * LEAF) * 8):
                p, q = x[part : part + block // (LEAF * LEAF) * 8], y[part : part + block // (LEAF * LEAF) * 8]
                cp, cq = (z[:, None] * LEAF + np.arange(LEAF) for z in (p, q))
                cp, cq = np.repeat(cp, LEAF, axis=1).ravel(), np.tile(cq, (1, LEAF)).ravel()
                fits = (cp < cq) & (cq < n)
                cp, cq = cp[fits], cq[fits]
                close = (labels[cp] != labels[cq]) & (np.bitwise_count(s[cp] ^ s[cq]) <= k)
                if close.any():
                    a, b = labels[cp[close]], labels[cq[close]]
                    labels = min_labels(n, a, b)[labels]

    visit(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))
    out = np.empty(n, np.int64)
    out[order] = order[labels]
    return out


def _deal(fp, bits_from: int, bits_to: int, parts: int):
    """Array of (part, value) over `parts` blocks of the bits [bits_from, bits_to)."""
    edges = [bits_from + (bits_to - bits_from) * p // parts for p in range(parts + 1)]
    return [(p, F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def fingerprint_links(distinct: DataFrame, k: int = MAX_BITS, split_over: int = SPLIT_OVER) -> DataFrame:
    """Links (a, b) of spanning stars that join the same distinct fingerprints (fp) as all pairs of k or fewer differing bits."""
    parts = k + 1
    width = 64 // parts
    fp = F.col("fp")
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), v.alias("value")) for p, v in _deal(fp, 0, 64, parts)])).alias("at")).select("fp", "at.part", "at.value")
    hot = keyed.groupBy("part", "value").count().where(F.col("count") > split_over).select("part", "value", F.lit(True).alias("hot"))
    # the other bits: rotate the block of this part away, then cut what is left into k+1 blocks again
    rest = F.lit(None).cast("bigint")
    for p, (a, b) in enumerate([(64 * q // parts, 64 * (q + 1) // parts) for q in range(parts)]):
        low = fp.bitwiseAND(F.lit((1 << a) - 1 if a else 0))
        high = F.shiftrightunsigned(fp, b) if b < 64 else F.lit(0).cast("bigint")
        rest = F.when(F.col("part") == p, low.bitwiseOR(F.shiftleft(high, a))).otherwise(rest)
    finer = F.array(*[F.struct(F.lit(p).alias("sub"), v.alias("subvalue")) for p, v in _deal(F.col("rest"), 0, 64 - width, parts)])
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("bigint").alias("subvalue")))
    grouped = (
        keyed.join(hot, ["part", "value"], "left")
        .withColumn("rest", rest)
        .select("fp", "part", "value", F.explode(F.when(F.col("hot"), finer).otherwise(whole)).alias("s"))
        .select("fp", F.xxhash64("part", "value", "s.sub", "s.subvalue").alias("grp"))
    )

    def run(batches):
        held: list[pa.RecordBatch] = []

        def link(grp: np.ndarray, fp: np.ndarray):
            """Of whole groups, sorted by grp."""
            starts = np.flatnonzero(np.concatenate(([True], grp[1:] != grp[:-1])))
            sizes = np.diff(np.append(starts, len(grp)))
            a, b = [], []
            small = sizes <= LEAF
            for shift in range(1, LEAF):  # groups of a leaf or less: all at once
                i = np.flatnonzero(grp[shift:] == grp[:-shift]) if len(grp) > shift else np.empty(0, np.int64)
                i = i[np.repeat(small, sizes)[i]]
                i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= k]
                a.append(fp[i]), b.append(fp[i + shift])
            for s, z in zip(starts[~small], sizes[~small], strict=True):
                g = np.unique(fp[s : s + z])
                root = index_links(g, k)
                moved = root != np.arange(len(g))
                a.append(g[moved]), b.append(g[root[moved]])
            a, b = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        def flush(last: bool):
            nonlocal held
            grp = np.concatenate([x.column(0).to_numpy() for x in held])
            fp = np.concatenate([x.column(1).to_numpy() for x in held]).view(np.uint64)
            cut = len(grp) if last else int(np.searchsorted(grp, grp[-1]))
            held = [] if last else [pa.RecordBatch.from_arrays([pa.array(grp[cut:]), pa.array(fp[cut:].view(np.int64))], ["grp", "fp"])]
            return link(grp[:cut], fp[:cut]) if cut else None

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(x.num_rows for x in held) >= 200_000 and (out := flush(False)) is not None:
                    yield out
        if held and (out := flush(True)) is not None:
            yield out

    return grouped.select("grp", "fp").repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "a bigint, b bigint")


def _named(fps: DataFrame, k: int) -> DataFrame:
    """(fp, low, root) of each distinct fingerprint of `fps` (doc_id, fp): its smallest id and the fingerprint that names its component."""
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = connected_components(fingerprint_links(classes.select("fp"), k))
    return materialize(classes.join(roots, classes.fp == roots.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("root")))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, k: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of `docs` (doc_id, text).

    Null and empty texts have fingerprint zero and link like any other; repeated rows come out as
    often as they came in; a row with null doc_id keeps it and never names a component unless all
    of the component's ids are null. Empty table: no rows. Extra columns are not returned.
    """
    fps = materialize(fingerprints(docs, size))
    named = _named(fps, k)
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = named.join(lows, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, size: int = SHINGLE, k: int = MAX_BITS) -> DataFrame:
    """One row of `docs` of each near-duplicate component, the first by doc_id and then text; columns as they were.

    Null ids come last, so a row of null doc_id stands for its component only if no other row there has
    an id. Ids need not be unique: a row belongs to the component of its own text.
    """
    key, one, two, root, row = (free_name(docs, f"keep_{x}") for x in ("key", "one", "two", "root", "row"))
    text = F.col("text").cast("binary")
    digests = [F.xxhash64(F.col("text").isNull(), text).alias(one), F.xxhash64(F.lit(1), text).alias(two)]  # with the id they stand for the text
    fps = materialize(fingerprints(docs.select(F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), *digests).alias("doc_id"), "text"), size, f"struct<doc_id:bigint,{one}:bigint,{two}:bigint>"))
    fps = fps.select("doc_id.*", "fp")
    named = _named(fps.select("doc_id", "fp"), k)
    lows = named.groupBy("root").agg(F.min("low").alias("lowest"))
    of = fps.join(named.join(lows, "root").select("fp", "root", "lowest"), "fp").where(F.col("doc_id").eqNullSafe(F.col("lowest")))
    none = F.lit(-(1 << 63)).cast("bigint")
    firsts = of.select(F.coalesce("doc_id", none).alias(key), one, two, F.col("root").alias(root)).distinct()
    mine = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("bigint"), none), one: digests[0], two: digests[1]})
    kept = mine.join(firsts, [key, one, two])
    # an id that is really the stand-in for null comes before null
    w = Window.partitionBy(root).orderBy(F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last())
    return kept.withColumn(row, F.row_number().over(w)).where(F.col(row) == 1).select(*docs.columns)


__all__ = ["fingerprints", "fingerprint_links", "index_links", "keep_one_of_each", "near_duplicates", "shingle_hashes"]
