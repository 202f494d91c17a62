"""op1 and op5 against counting every string of the length."""

import hashlib
import random
import re
from collections import Counter

from lumenreel.llm import queries, repeats
from lumenreel.llm.common import read

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(units_of, length, rows):
    docs = [(i, units_of((t or "").encode())) for i, t in rows]
    seen = Counter(tuple(u[s : s + length]) for _, u in docs for s in range(len(u) - length + 1))
    out = []
    for i, u in docs:
        gone = [False] * len(u)
        for s in range(len(u) - length + 1):
            if seen[tuple(u[s : s + length])] > 1:
                gone[s : s + length] = [True] * length
        out.append((i, u, gone))
    return out


def expected_bytes(rows, length):
    out = []
    for i, u, gone in brute(lambda b: b, length, rows):
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(u), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(u, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def expected_words(rows, length):
    out = []
    for i, u, gone in brute(WORD.findall, length, rows):
        out.append((i, len(u), sum(gone), hashlib.sha256(b" ".join(c for c, g in zip(u, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.drop("kept").collect()), key=repr)


def fixture(seed=1):
    rng = random.Random(seed)
    words = [rng.choice("abcdefghij") * rng.randint(1, 3) + rng.choice("xyzé") for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, other = text(90), text(60)
    rows = [(k, text(rng.randint(0, 150))) for k in range(25)]
    rows += [(100 + k, text(30) + " " + shared + " " + text(k)) for k in range(6)]
    rows += [(200, other + " " + text(3) + " " + other), (201, "ab" * 400), (202, "z" * 450), (203, "z" * 200), (204, "q" * 200)]
    rows += [(300, None), (301, None), (302, ""), (303, "  \t\n "), (304, shared[:199]), (305, shared[:200]), (None, shared), (300, "repeated id")]
    rows += [(400, text(120))] * 2
    rows.append((500, " ".join([other, other]) + "\x0b" + shared))
    return rows


def test_bytes(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, kept string").repartition(5)
    assert got(repeats.repeated_bytes(df)) == expected_bytes(rows, 200)


def test_words(spark):
    rows = fixture(2)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, ends int").repartition(5)
    assert got(repeats.repeated_words(df)) == expected_words(rows, 35)


def test_small_alphabet(spark):
    rng = random.Random(5)
    rows = [(k, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 900)))) for k in range(20)]
    kind = repeats.Kind(False, 16, 2)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(repeats.repeated_bytes(df, kind)) == expected_bytes(rows, 16)
    kind = repeats.Kind(True, 15, 3)
    assert got(repeats.repeated_words(df, kind)) == expected_words(rows, 15)


def test_first_hash_of_no_use(spark):
    """With every first hash equal, the second alone keeps different strings apart."""
    rows = fixture(7)[10:]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert got(repeats.repeated_bytes(df, repeats.Kind(False, 200, 11, bits=0))) == expected_bytes(rows, 200)
    assert got(repeats.repeated_words(df, repeats.Kind(True, 35, 3, bits=0))) == expected_words(rows, 35)


def test_a_text_longer_than_a_chunk(spark):
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefgh ", k=repeats.MOST_CHUNK + 1000))
    df = spark.createDataFrame([(1, long), (2, long[-300:]), (3, "x")], "doc_id bigint, text string")
    assert {(r["doc_id"], r["n_removed"]) for r in repeats.repeated_bytes(df).collect()} == {(1, 300), (2, 300), (3, 0)}


def test_kept_text_is_what_the_hash_says(spark):
    df = spark.createDataFrame(fixture(), "doc_id bigint, text string")
    for r in repeats.repeated_bytes(df).collect():
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert repeats.repeated_bytes(df).count() == repeats.repeated_words(df).count() == 0


def test_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in read(spark, sf, "documents").collect()]
    assert got(queries.op5_substring_dedup(spark, sf)) == expected_words(rows, 35)
    some = got(queries.op1_suffix_array_dedup(spark, sf))
    # all strings of 200 bytes, by a rolling count of hashes
    seen = Counter(hash(b[s : s + 200]) for _, t in rows for b in [(t or "").encode()] for s in range(len(b) - 199))
    for doc_id, n, removed, *_ in some:
        b = next((t or "").encode() for i, t in rows if i == doc_id)
        gone = [False] * n
        for s in range(n - 199):
            if seen[hash(b[s : s + 200])] > 1:
                gone[s : s + 200] = [True] * 200
        assert removed == sum(gone)


def test_cover_meets_every_distance():
    for q in (2, 3, 5, 7, 11):
        v, places = repeats.difference_cover(q)
        assert {(a - b) % v for a in places for b in places} == set(range(v))
