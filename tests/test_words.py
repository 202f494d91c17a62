"""Alignment of documents that are taken apart against whole documents at once."""

import difflib
import random
import re

import pyarrow as pa
import pytest

from lumenreel.operators import words
from lumenreel.plans import media
from lumenreel.plans.registry import Tables

SCRIPT, RAW = "doc string, index int, form string, language string, seconds double", "doc string, position int, form string, start double, end double"


def heard_of(rng, script):
    """What a recogniser made of a script: words lost, changed, cut, joined, repeated, and stretches out of place."""
    out = []
    for x in script:
        out += rng.choice([[x]] * 12 + [[], [x[:4]], [x + "s"], ["uh", x], [x[:2], x[2:]], [x, x]])
    for _ in range(rng.choice([0, 1, 2])):
        a = rng.randrange(len(out) + 1)
        b = min(len(out), a + rng.randint(1, 12))
        to = rng.randrange(len(out) + 1)
        out = out[:to] + out[a:b] + out[to:] if rng.random() < 0.5 else out[:a] + out[b:]
    return out


def documents(seed, n):
    rng, out = random.Random(seed), {}
    for d in range(n):
        few = rng.choice([3, 12, 400])
        forms = [f"{rng.choice(['wort', 'silence', 'a', 'the', 'mirror'])}{rng.randrange(few)}" for _ in range(rng.choice([0, 1, 5, 40, 150]))]
        heard = heard_of(rng, forms) if forms else ["x"] * rng.randint(0, 3)
        times, at = [], 0.0
        for _ in heard:
            times.append((at, at + rng.uniform(0.05, 0.5)))
            at = times[-1][1] + rng.choice([0.0, 0.2])
        out[f"d{d}"] = (forms, heard, times, rng.choice([None, at + 1]))
    return out


@pytest.mark.parametrize(("seed", "run"), [(1, 2), (2, 3), (3, 8)])
def test_equals_whole_documents(spark, seed, run, monkeypatch):
    monkeypatch.setattr(words, "PLACES", 16)
    docs = documents(seed, 60)
    script = [(d, 3 * k, x, "de", total) for d, (forms, _, _, total) in docs.items() for k, x in enumerate(forms)]
    raw = [(d, 2 * k + 5, x, *t) for d, (_, heard, times, _) in docs.items() for k, (x, t) in enumerate(zip(heard, times, strict=True))] + [("d1", -1, "", 0.0, 0.0)]
    got = {}
    for r in words.align(spark.createDataFrame(script, SCRIPT), spark.createDataFrame(raw, RAW), "doc", "language", "seconds", run).collect():
        assert (r.doc, r["index"]) not in got
        got[r.doc, r["index"]] = (r.start, r.end, r.how)
    want = {}
    for d, (forms, heard, times, total) in docs.items():
        said = [(x, *t) for x, t in zip(heard, times, strict=True) if x]
        whole = words.gap_times(forms, [x[0] for x in said], [x[1] for x in said], [x[2] for x in said], "de", float("inf") if total is None else total, None, None)
        want |= {(d, 3 * k): t for k, t in enumerate(whole)}
    assert got == want


def test_blocks_are_those_of_the_longest_match(spark):
    docs = documents(4, 40)
    flat = lambda at: [(d, k, x) for d, v in docs.items() for k, x in enumerate(v[at])]
    frame = lambda rows: spark.createDataFrame(rows, "doc string, at bigint, form string")
    pairs = lambda d, blocks: {(d, i + k, j + k) for i, j, n in blocks for k in range(n)}
    got = words.common_blocks(frame(flat(0)), frame(flat(1)), "doc", 4).collect()
    assert all(r.size >= 4 for r in got)
    ours = set().union(*(pairs(r.doc, [(r.i, r.j, r.size)]) for r in got))
    theirs = {d: difflib.SequenceMatcher(None, forms, heard, autojunk=False).get_matching_blocks() for d, (forms, heard, *_) in docs.items()}
    assert ours <= set().union(*(pairs(d, m) for d, m in theirs.items()))
    # of theirs some are two that touch
    assert len(set().union(*(pairs(d, [b for b in m if b.size >= 4]) for d, m in theirs.items())) - ours) <= 0.02 * len(ours)


def test_every_turn_of_the_table(spark, sf):
    w = media.timed_words(Tables(spark, sf))
    got = {tuple(r)[0]: tuple(r)[1:] for r in media.word_align(Tables(spark, sf)).collect()}
    turns = {}
    for r in w.orderBy("key", "index").collect():
        turns.setdefault(r["key"], []).append(r)
    for key, rows in turns.items():
        heard = [(r["form"][:4] if r["index"] % 9 == 4 else r["form"], r["start"], r["end"]) for r in rows if r["index"] % 7 != 3]
        heard = [h for h in heard if h[0]]
        how = [t[2] for t in words.gap_times([r["form"] for r in rows], [h[0] for h in heard], [h[1] for h in heard], [h[2] for h in heard], "en", float("inf"), None, None)]
        assert got[key] == (len(rows), *[how.count(x) for x in ("equal", "fuzzy", "merge", "split", "approximate")])


def test_tokens_come_in_bounded_batches():
    """Long texts, many to a batch, are handed on in pieces: no more than TOKEN_ROWS words are held as rows."""
    texts = [" ".join(f"(w{k}-a." if k % 9 == 0 else f"It\u2019s{k}" for k in range(n)) + "\n\nend!" for n in (0, 1, 30_000, 5, 50_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "body"])
    got = list(words.token_batches(iter([batch, batch.slice(0, 2)]), "doc_id"))
    assert max(b.num_rows for b in got) <= words.TOKEN_ROWS < len(texts[2].split())
    want = []
    for d, body in [*enumerate(texts), *enumerate(texts[:2])]:
        found = [m.span() for m in re.finditer(r"[^\W_]+(?:['\u2019-][^\W_]+)*", body)]
        for n, (s, e) in enumerate(found):
            before, behind = body[found[n - 1][1] if n else 0 : s].strip(), body[e : found[n + 1][0] if n + 1 < len(found) else len(body)].strip()
            breaks = body[found[0][1] : s].count("\n\n") if n else 0
            want.append((d, n, body[s:e], re.sub(r"\W+", "", body[s:e].lower()), s, e, before if before == "(" else "", behind if behind in (".", "!") else "", breaks))
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want
