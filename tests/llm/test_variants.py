"""Spelling variants against all pairs of words, word by word."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenreel.llm import queries
from lumenreel.llm import variants as V

DOCS = "doc_id bigint, text string"


def plain_words(rows, least=5, every=199):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= 6
    return {w: n for w, n in found.items() if n >= least}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_variants(words, more=5):
    forms, out = {}, []
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        forms[w] = (len(others), best if best is not None and words[best] >= more * n else None)
    for w, n in words.items():
        root = w
        while forms[root][1] is not None:
            root = forms[root][1]
        of = forms[w][1]
        out.append((w, n, forms[w][0], of, words[of] if of else None, root))
    return sorted(out, key=repr)


def test_all_pairs_of_a_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op11_spelling_variants(spark, sf).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, got), key=repr) == plain_variants(plain_words(rows))


@settings(max_examples=3, deadline=None)
@given(st.dictionaries(st.text(alphabet="abéÿ", min_size=2, max_size=6), st.integers(1, 4000), min_size=1, max_size=120))
def test_all_pairs_of_few_letters(spark, words):
    """Words of few letters: doubled letters, many anagrams, chains of forms."""
    got = V.with_roots(V.forms(spark.createDataFrame(list(words.items()), "word string, n bigint"))).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, got), key=repr) == plain_variants(words)


def test_the_rest_behind_the_first_difference(spark, monkeypatch):
    words = ["ab", "abc", "aab", "bab", "ba", "abcd", "b", "xbc", "axbc", "éb"]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words if a != b], "a string, b string")
    monkeypatch.setattr(V, "MOST_BY_DISTANCE", 0)
    got = pairs.select("a", "b", V.one_apart(V.F.col("a"), V.F.col("b")).alias("one")).collect()
    assert [r for r in got if r.one != near(r.a, r.b)] == []


def test_long_chains_and_ties(spark):
    chain = {"aaaaaa" + "b" * k: 5 ** (k + 1) for k in range(12)} | {"zzzzzx": 50, "zzzzzy": 50, "zzzzzz": 10, "x" * 50_000: 7, "x" * 50_001: 70, "x" * 25_000 + "y" + "x" * 24_999: 2}
    got = V.with_roots(V.forms(spark.createDataFrame(list(chain.items()), "word string, n bigint"))).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = plain_variants(chain)
    assert sorted(map(tuple, got), key=repr) == want
    assert {r[5] for r in want if r[0].startswith("aaaaaa")} == {"aaaaaa" + "b" * 11}
    assert next(r[3] for r in want if r[0] == "zzzzzz") == "zzzzzx"


def test_words_of_odd_rows(spark, monkeypatch):
    text = "Wörter, WORTE wörter; wörter\nWörter×ab wörter " + "ÀÉÎ÷ØÜ " * 5 + "short"
    rows = [(1, text), (1, text), (None, text), (2, None), (3, "")] + [(k, "Wörterbuch") for k in range(400)]
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id bigint, text string, word string, n int")
    want = plain_words(rows)
    assert {r.word: r.n for r in V.count_words(docs).collect()} == want
    assert {"wörter", "wörterbuch", "ÀÉÎ÷ØÜ"} <= set(want)
    assert any(r not in ("wörterbuch",) and near(r, "wörterbuch") for r in plain_words(rows, 1))
    assert V.runs(text) == (monkeypatch.setattr(V, "PIECE", 7) or V.runs(text))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "abcdef abcdef")]])
def test_no_words(spark, rows):
    assert V.spelling_variants(spark.createDataFrame(rows, DOCS)).collect() == []


def test_letters_have_powers_of_their_own(spark):
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    rows = spark.createDataFrame([(x,) for x in letters], "x string").select("x", V.power(V.F.col("x")).alias("p")).collect()
    assert len({r.p for r in rows}) == len(letters)
    assert {r.x: r.p for r in rows}["c"] == 3**5
