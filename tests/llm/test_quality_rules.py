"""Counts against a plain reading, rules on planted data, verdicts on rows that nothing was learned from."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenreel.llm import quality_rules as Q
from lumenreel.llm import queries

DOCS = "doc_id bigint, text string"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times = Counter(windows)
    repeated = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    among = lambda pattern: len(re.findall(pattern, text))
    stutters = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return (len(words), sum(map(len, words)), among(r"[#*$%&|<>]"), len(lines) - len(set(lines)), len(repeated), len(lines), len(set(words)), stutters, among("[A-Z]"), among("[0-9]"), among("[.,;:!?]"))


ODD = ["", " ", "\n\n", "a", "é ü x", "a b c d e a b c d e", "x\nx\n x\nx ", "# $ % ^ &|<>*", "\x0b\x0c\r\n\t", "\x1c\x85 no break", "un un un un un un", "🙂 🙂🙂"]


def test_counts_of_odd_texts(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, None), (3, "again"), (3, "again")]
    got = Q.statistics(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *plain_counts(t))) for i, t in rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "é", "#", "A.", "\n", "  ", "7"]), max_size=60))
def test_counts(parts):
    text = " ".join(parts)
    assert Q.counts(text.encode()) == plain_counts(text)


def test_a_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{k % 7001}" for k in range(30_000)) + " tail\n" + "é" * 3000
    whole = Q.counts(text.encode())
    monkeypatch.setattr(Q, "PIECE", 1000)
    assert Q.counts(text.encode()) == whole == plain_counts(text)


def test_windows_whose_numbers_pass_63_bits():
    ids = np.random.default_rng(1).integers(0, 9000, 20_000)
    ids[15_000:15_030] = ids[100:130]
    want = {k + j for a, b in ((100, 15_000),) for s in (a, b) for k in range(s, s + 26) for j in range(5)}
    assert Q.repeated(ids, 9000) == len(want)
    assert Q.repeated(ids, 1 << 40) == len(want)


def planted(n=900):
    rng = np.random.default_rng(7)
    values = {"a": rng.random(n), "b": rng.random(n), "noise": rng.random(n)}
    bad = ((values["a"] > 0.6) & (values["b"] <= 0.3)) | (values["b"] > 0.95)
    return values, bad


def test_rules_find_planted_conjunctions():
    values, bad = planted()
    found = Q.learn(values, bad, np.ones(len(bad)), np.arange(len(bad)) % 3 == 0)
    covered = np.logical_or.reduce([r.holds(values) for r in found.rules])
    assert (covered == bad).mean() > 0.98
    assert all(c.name != "noise" for r in found.rules for c in r.conditions)
    assert len({c.name for c in found.rules[0].conditions}) == 2


def test_noise_teaches_nothing():
    values, _ = planted()
    bad = np.random.default_rng(3).random(900) < 0.1
    assert Q.learn(values, bad, np.ones(900), np.arange(900) % 3 == 0).rules == ()
    for one in (np.zeros(900, bool), np.ones(900, bool)):
        assert Q.learn(values, one, np.ones(900), np.arange(900) % 3 == 0).rules == ()


def test_the_column_is_the_list(spark):
    values, bad = planted(300)
    found = Q.learn(values, bad, np.ones(300), np.arange(300) % 3 == 0)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in zip(*values.values(), strict=True)], "a double, b double, noise double")
    got = rows.select("a", "b", "noise", found.column({k: F.col(k) for k in values}).alias("rule"), F.expr(str(found)).alias("said")).collect()
    for r in got:
        one = {k: np.array([r[k]]) for k in values}
        assert r.rule == r.said == next((k for k, rule in enumerate(found.rules, 1) if rule.holds(one)[0]), 0)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(None, 0, 0), (1, None, 0), (2, 5, 0)]])
def test_few_labels_and_odd_rows(spark, labels):
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = [(1, "word " * 12, 5), (1, "word " * 12, 5), (None, None, None), (2, "one two three four five six seven eight nine ten", 1)]
    got = Q.verdicts(spark.createDataFrame(rows, "doc_id bigint, text string, n_words int"), marks).collect()
    assert sorted((r.n_words, r.base_failed, r.kept) for r in got) == [(0, True, False), (10, False, True), (12, True, False), (12, True, False)]
    assert Q.verdicts(spark.createDataFrame([], DOCS), marks).collect() == []


def test_kept_rows_keep_their_columns(spark):
    good = " ".join(f"word{k}" for k in range(20))
    rows = [(1, good, 5, "x"), (2, good.replace(" ", "# "), 6, "y"), (3, None, 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, rule int, `a.b` string")
    rules = Q.DecisionList((Q.Rule((Q.Condition("symbols_a_word", True, 0.5),), 1, 0),))
    out = Q.keep_good(docs, rules)
    assert out.columns == docs.columns
    assert [tuple(r) for r in out.collect()] == [rows[0]]


def test_a_bounded_share_of_the_rows_stands_for_all(spark):
    rows = spark.range(30_000).selectExpr("id AS doc_id", "cast(id % 10 > 0 AS int) AS quality")
    some, stands_for = Q.learning_rows(rows, 2000)
    got = {r.quality: r["count"] for r in some.groupBy("quality").count().collect()}
    assert all(abs(got[q] - 2000) < 200 for q in (0, 1))
    assert stands_for == {0: 1.5, 1: 13.5}


def test_query_on_the_whole_table(spark, sf):
    got = queries.op12_quality_rules(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        want = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[:5]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed and r.rule == 0)


def test_rows_that_nothing_was_learned_from(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    judged = Q.verdicts(docs, labels.where(~held)).join(labels.where(held).select("doc_id", "quality"), "doc_id").where("not base_failed").collect()
    assert len(judged) > 80
    assert sum(r.kept == (r.quality == 1) for r in judged) >= 0.97 * len(judged)
    assert all(r.kept for r in judged if r.quality == 1)
