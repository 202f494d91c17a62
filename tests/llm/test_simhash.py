"""op10 and the pipeline's second stage against all pairs."""

import random
import re

import numpy as np
import xxhash

from lumenreel.llm import queries, simhash
from lumenreel.llm.common import read

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                label[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return sorted(((i, f"{fps[k]:016x}", low.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_all_pairs(spark, sf):
    docs = read(spark, sf, "documents")
    assert got(queries.op10_simhash_near_dedup(spark, sf)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "  \t"), (4, "One"), (5, "one"), (6, "a b"), (7, "A B "), (8, "a b c"), (9, "x " * 5000), (9, "x " * 5000), (None, "one"), (None, "alone here now"), (10, "ÀB cd ef")]
    df = spark.createDataFrame([(i, t, 0, "c") for i, t in rows], "doc_id bigint, text string, fp int, component_id string")
    assert got(simhash.near_duplicates(df)) == brute(rows)
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == [1, 4, 6, 8, 9, 10] and ids.count(None) == 1
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.keep_one_of_each(df.limit(0)).count() == 0


def test_rows_without_an_id_of_their_own_are_kept(spark):
    long = [" ".join(f"t{k}w{j}" for j in range(40)) for k in range(6)]
    rows = [(None, long[0]), (None, long[0]), (None, long[1]), (None, long[2]), (1, long[2]), (7, long[3]), (7, long[4]), (7, long[4]), (7, long[5]), (3, long[5]), (None, None), (-(1 << 63), "")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, keep_key int").repartition(3)
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    want = [(None, long[0]), (None, long[1]), (1, long[2]), (7, long[3]), (7, long[4]), (3, long[5]), (-(1 << 63), "")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_index_and_split_groups_lose_no_link(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = set()
    for _ in range(1500):
        x = base
        for b in rng.sample(range(64), rng.randint(0, 9)):
            x ^= 1 << b
        fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    want = simhash.min_labels(len(fps), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3))
    same = lambda a: [tuple(np.flatnonzero(a == x)) for x in np.unique(a)]
    assert sorted(same(want)) == sorted(same(simhash.index_links(fps)))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    links = simhash.fingerprint_links(df, split_over=100).collect()
    at = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    label = simhash.min_labels(len(fps), np.array([at[r["a"]] for r in links]), np.array([at[r["b"]] for r in links]))
    assert sorted(same(want)) == sorted(same(label))
