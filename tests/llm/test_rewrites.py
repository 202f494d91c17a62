"""op4, op7 and op8: round trips, an independent scan, and edge cases."""

import random
import re

import pytest

from lumenreel.llm import licenses, pieces, pseudonyms, queries
from lumenreel.llm.common import read

KEY = b"k" * 32


def test_permutation_is_one_to_one():
    for size in (1, 2, 3, 10, 97, 1000):
        assert sorted(pseudonyms.permute(n, size, KEY, "t") for n in range(size)) == list(range(size))


@pytest.mark.parametrize(
    ("kind", "value", "shape"),
    [
        ("card", "4111 1111 1111 1111", r"\d{4} \d{4} \d{4} \d{4}"),
        ("iban", "DE89 3704 0044 0532 0130 00", r"DE\d{2} \d{4} \d{4} \d{4} \d{4} \d{2}"),
        ("ip", "192.168.0.1", r"\d+\.\d+\.\d+\.\d+"),
        ("ssn", "078-05-1120", r"\d{3}-\d{2}-\d{4}"),
        ("date", "2021-02-28", r"\d{4}-\d{2}-\d{2}"),
        ("date", "28/02/2021", r"\d{2}/\d{2}/\d{4}"),
        ("phone", "+1 (555) 123-4567", r"\+1 \(\d{3}\) \d{3}-\d{4}"),
        ("email", "jo.doe@mail.org", r"[a-z]{2}\.[a-z]{3}@[a-z]{4}\.org"),
    ],
)
def test_formats_stay_and_checks_hold(kind, value, shape):
    out, kinds = pseudonyms.pseudonymise_text(f"a {value} b {value}.", KEY)
    assert kinds == [kind, kind]
    m = re.fullmatch(f"a ({shape}) b \\1\\.", out)
    assert m and m[1] != value
    again, kinds = pseudonyms.pseudonymise_text(m[1], KEY)
    assert kinds == [kind] and again != m[1]  # what comes out passes the same check
    assert pseudonyms.pseudonymise_text(value, b"o" * 32)[0] != m[1]


def test_what_fails_its_check_stays():
    text = "4111 1111 1111 1112 and 999.1.1.1 and 2021-02-30 and 000-12-3456"
    assert pseudonyms.pseudonymise_text(text, KEY) == (text, [])


@pytest.mark.parametrize(
    ("kind", "value", "behind"),
    [("card", "4111 1111 1111 1111", x) for x in (" 12/26", " 123", " 12/2026 123", " 5500 0000 0000 0004")]
    + [("card", "4111-1111-1111-1111", "-12"), ("card", "3782 822463 10005", " 1234")]
    + [("iban", "BE68 5390 0754 7034", x) for x in (" ABC", " KRED", " KREDBEBB", " 1 EUR")]
    + [("iban", "AT61 1904 3002 3457 3201", " BIC"), ("iban", "DE89370400440532013000", " BIC")],
)
def test_values_with_more_behind_them(kind, value, behind):
    key = pseudonyms._key("k")
    move = dict((k, f) for k, _, f in pseudonyms.KINDS)[kind]
    got, kinds = pseudonyms.pseudonymise_text(f"paid by {value}{behind} ok", key)
    assert got.startswith(f"paid by {move(value, key)}{behind[0]}") and kinds[0] == kind and value not in got
    ahead, _ = pseudonyms.pseudonymise_text(f"no 1205 {value}, ok", key)
    assert ahead == f"no 1205 {move(value, key)}, ok"


def test_pseudonyms_of_a_table(spark, sf):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x@y.org", "c"), (3, "x@y.org", "c"), (None, "no data", "d"), (4, "z" * 300_000 + " x@y.org", "e")], "doc_id bigint, text string, N_PII string")
    out = pseudonyms.pseudonymise(df)
    assert [c.lower() for c in out.columns] == ["doc_id", "text", "n_pii", "pii_kinds"]
    rows = {(r["doc_id"], r["n_pii"]): r["text"] for r in out.collect()}
    assert rows[1, 0] is None and rows[2, 0] == "" and rows[None, 0] == "no data"
    assert rows[3, 1] != "x@y.org" and rows[4, 1].endswith(" " + rows[3, 1])
    assert pseudonyms.pseudonymise(df.limit(0)).count() == 0
    odd = df.selectExpr("doc_id", "text", "1 as `a.b`", "2 as moved", "3 as `_lumen_moved`")
    got = pseudonyms.pseudonymise(odd, report=False)
    assert got.columns == odd.columns and {tuple(r)[2:] for r in got.collect()} == {(1, 2, 3)}
    docs = read(spark, sf, "documents")
    key = pseudonyms._key(pseudonyms.DEMONSTRATION_KEY)
    want = {r["doc_id"]: pseudonyms.pseudonymise_text(r["text"], key)[0] for r in docs.collect()}
    assert {r["doc_id"]: r["text"] for r in queries.op4_pii(spark, sf).collect()} == want


def test_pieces_are_those_of_the_library_and_come_back(spark, sf):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    docs = read(spark, sf, "documents").select("doc_id", "text")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = pieces.encode(docs)
    for r in got.collect():
        assert r["exact"] and r["n_tokens"] == len(r["ids"])
        assert list(r["ids"]) == sp.encode(rows[r["doc_id"]])
    back = {r["doc_id"]: r["text"] for r in pieces.decode(got).collect()}
    assert back == rows


def test_pieces_edge_cases(spark):
    texts = [None, "", " ", "  a  b ", "\n\n", "▁x", "é" * 5000, "\U0001f600\u0000", "a" * 100_000, " lead", "tail "]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "a", 1), (0, None, 1)], "doc_id bigint, text string, ids int")
    got = pieces.encode(df)
    assert all(r["exact"] for r in got.collect())
    back = {r["doc_id"]: r["text"] for r in pieces.decode(got).collect()}
    assert [back[k] for k in range(len(texts))] == texts
    assert pieces.encode(df.limit(0)).count() == 0


def test_streamed_search_commits_early():
    e = pieces.Encoder(pieces.Vocabulary(pieces.DEFAULT_MODEL))
    taken = 0

    def endless():
        nonlocal taken
        while taken < 1_000_000:
            taken += 1
            yield "ab"[taken % 2]

    out = e.search(endless())
    next(out)
    assert taken < 1000


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_scan(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES:
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                at.append(k), labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_base_columns(spark, sf):
    rows = {r["doc_id"]: r["text"] for r in read(spark, sf, "documents").collect()}
    for r in queries.op8_license_scan(spark, sf).collect():
        assert tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == base_scan(rows[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_license_rules(spark):
    cases = [
        ("Licensed under the Apache License, Version 2.0 (the License).", "apache-2.0"),
        ("SPDX-License-Identifier: MIT", "mit"),
        ("Released under the GNU General Public License version 3. All Rights Reserved", "gpl,gpl-3.0,reserved"),
        ("cc by CC-BY", "cc-by"),
        ("all rights reserved all rights reserved", "reserved"),
        ("all rightsé reserved", ""),
        ("CC BYE all rightss reserved", ""),
        (None, ""),
        ("", ""),
        ("İ cc by K", "cc-by"),
        ("word " * 30_000 + "cc by", "cc-by"),
    ]
    df = spark.createDataFrame([(k, t, "x") for k, (t, _) in enumerate(cases)], "doc_id bigint, text string, norm string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for k, (t, labels) in enumerate(cases):
        assert got[k]["labels"] == labels, t
        assert tuple(got[k][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == base_scan(t), t
    assert licenses.scan(df.limit(0)).count() == 0


def spelled(parsed):
    """Strings that an expression matches: each way of its alternatives and optional parts, other parts in one way."""
    out = [""]
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            new = [chr(value)]
        elif name == "IN":
            new = [chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0])]
        elif name == "ANY":
            new = ["x"]
        elif name == "BRANCH":
            new = [x for branch in value[1] for x in spelled(branch)]
        elif name == "SUBPATTERN":
            new = spelled(value[3])
        elif name == "MAX_REPEAT":
            new = [x * max(value[0], n) for x in spelled(value[2]) for n in {0, 1} if n >= min(value[0], 1)]
        else:
            assert name in ("ASSERT", "ASSERT_NOT"), name
            new = [""]
        out = [x + y for x in out for y in new]
    return out


def test_gates_let_every_match_through():
    """Every way to write a rule passes its keywords and the gate of the text, and what reaches the gate is what stands in it."""
    plain = "released under the "
    assert re.fullmatch(licenses.UNDER, plain)
    for text in spelled(re._parser.parse(licenses.UNDER)):
        assert any(g in f" {text}" for g in licenses.GATES), text
    assert len(licenses.RULES) > 200
    for priority, label, expression in licenses.RULES:
        assert licenses.gated(expression)
        for text in spelled(re._parser.parse(expression.replace("{under}", plain))):
            assert re.fullmatch(expression.replace("{under}", licenses.UNDER), text)
            assert any(k in f" {text} " for k in licenses.keywords(expression)), (label, text)
            assert any(g in f" {text} " for g in licenses.GATES), (label, priority, text)


def all_rules(text):
    """labels and score of every rule on the whole text, without gates; each pair of detections compared."""
    norm = " " + " ".join(WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) + " "
    found = []
    for priority, label, e in licenses.RULES:
        rx = f"(?<= )(?:{e.replace('{under}', licenses.UNDER)})(?= )"
        found += [(m.start(), -m.end(), -priority, label) for m in re.finditer(rx, norm)]
    found = sorted(set(found))
    kept = [d for k, d in enumerate(found) if not any(o[0] <= d[0] and -o[1] >= -d[1] and -o[2] >= -d[2] and (j < k if o[:2] == d[:2] and o[2] == d[2] else o[:3] != d[:3]) for j, o in enumerate(found))]
    base = base_scan(text)[4]
    top = max([-d[2] for d in kept], default=0)
    return ",".join(sorted({d[3] for d in kept} | set(filter(None, base.split(","))))), round(max(top, 40 if base else 0) / 100, 2)


def test_license_labels_against_all_rules(spark, sf):
    rng = random.Random(3)
    rows = [(r["doc_id"], r["text"]) for r in read(spark, sf, "documents").collect()]
    for k, (_, _, e) in enumerate(licenses.RULES):
        ways = spelled(re._parser.parse(e.replace("{under}", rng.choice(["released under the ", "governed by ", "available under the terms of the "]))))
        for j, text in enumerate(rng.sample(ways, min(3, len(ways)))):
            rows.append((100_000 + 10 * k + j, f"some words, {text.upper() if j else text}: and " + ("more of it" if j < 2 else rng.choice(ways))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(df).collect()}
    want = {i: all_rules(t) for i, t in rows}
    assert got == want, next((i, got[i], want[i]) for i in want if got[i] != want[i])


def test_licenses_without_their_old_keyword(spark):
    spdx = ["MPL-2.0", "EPL-2.0", "EUPL-1.2", "BSL-1.0", "OFL-1.1", "CDDL-1.0", "GFDL-1.3", "AFL-3.0", "ODbL-1.0"]
    rows = [(f"SPDX-License-Identifier: {x}", x.lower()) for x in spdx] + [
        ("the open data commons license", "odbl-1.0"),
        ("licensed under MS-PL", "ms-pl"),
        ("the NCSA license", "ncsa"),
        ("a Berkeley Software Distribution license", "bsd"),
        ("the Internet Systems Consortium license", "isc"),
        ("the Massachusetts Institute of Technology license", "mit"),
        ("is available under the Apache 2.0", "apache-2.0"),
        ("released under MIT", "mit"),
        ("Released under the MIT.", "mit"),
        ("Distributed under the BSD.", "bsd"),
        ("available under the terms of Apache 2.0", "apache-2.0"),
        ("the GNU LGPL license", "lgpl"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(df).collect()}
    assert all(want in got[i] for i, (_, want) in enumerate(rows)), got


def test_license_scan_runs_no_python(spark, sf):
    plan = queries.op8_license_scan(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_words_share_their_beginnings():
    """The search of one word gives the pieces of the streaming search, from what other words left behind too."""
    e = pieces.Encoder(pieces.Vocabulary(pieces.DEFAULT_MODEL))
    rng = random.Random(3)
    words = ["▁" * rng.randint(0, 2) + "".join(rng.choice("aeinorsté中\u0000'9") for _ in range(rng.randint(1, pieces.ONE_WINDOW - 2))) for _ in range(400)]
    words += [w[: rng.randint(1, len(w))] + rng.choice("aet") for w in words]
    assert [e.search_word(w) for w in words] == [list(e.search(w)) for w in words]
    assert 0 < len(e.ends) < sum(map(len, words))
