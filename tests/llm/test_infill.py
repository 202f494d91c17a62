"""Fill-in-the-middle forms against a plain reading of their definition."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenreel.llm import infill, queries

SCHEMA = "doc_id bigint, text string"


def plain_form(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by slicing a list of all units."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["", "a", " ", "é", "<P>", "x <S> y", "a<M", "P>b<", "zwei\nZeilen\r\n", "日本語 text 🙂🙂", "ab" * 3, "a-b-c", "\x00\x7f", "ÄÖ", "<", "S>", "word " * 50]


def test_forms_and_the_way_back(spark):
    rows = [(k, t) for k in range(40) for t in ODD] + [(None, "no id here"), (None, None), (7, None), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, SCHEMA)
    forms = infill.fill_in_middle(docs).withColumn("back", infill.restored(infill.F.col("output"), infill.F.col("form")))
    got = sorted(map(repr, (tuple(r) for r in forms.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect())))
    assert got == sorted(repr((i, *plain_form(i, t), t or "")) for i, t in rows)
    assert {r.form for r in forms.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_texts_of_many_chunks(spark):
    long = ["wort" * 60_000, "é" * 100_000 + "ab", ("x" * 65_535 + "é") * 3, "a b" * 70_000, "🙂" * 40_000]
    rows = [(k, t) for k in range(5) for t in long]
    got = infill.fill_in_middle(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got if r.form != "plain") == sorted(x for i, t in rows if (x := (i, *plain_form(i, t)))[2] != "plain")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 é日🙂\n<", max_size=60), st.integers(1, 9))
def test_chunks_of_any_size_give_every_rank(text, chunk):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    chunks = infill.Chunks(text.encode(), chunk)
    assert chunks.n == len(units)
    assert [chunks.points_before(k) for k in range(chunks.n + 1)] == [len("".join(units[:k])) for k in range(chunks.n + 1)]


def test_a_chunk_looks_back_one_byte_only():
    raw = np.frombuffer(b"ab cd", np.uint8)
    assert infill.unit_starts(raw, 1, 5).tolist() == [False, True, True, False]
    assert infill.unit_starts(raw, 0, 2).tolist() == [True, False]


@pytest.mark.parametrize("rows", [[], [(1, "ab cd", 5, "x", "y")]])
def test_clashing_columns_and_no_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `N` int, `_cut` string, `a.b` string")
    out = infill.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "_cut", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert [(r["_cut"], r["a.b"], r["n"]) for r in out.collect()] == [("x", "y", 3)] * len(rows)


def test_query_on_the_whole_table(spark, sf):
    got = {r.doc_id: r for r in queries.op13_fill_in_middle(spark, sf).collect()}
    texts = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(texts)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in texts:
        *head, output = plain_form(r.doc_id, r.text)
        assert tuple(got[r.doc_id])[1:] == (*head, sha(output), sha(r.text or ""))
