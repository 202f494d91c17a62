"""Cuts of documents in blocks against a loop over the whole document."""

import random

import pytest

from lumenreel.operators import segmentation
from lumenreel.operators.segmentation import BLOCK, CAP, FAST, MOST_SECONDS, MOST_WORDS, SHORT, Breaks, Rules
from lumenreel.plans import media
from lumenreel.plans.registry import Tables

from .test_repair import WORDS, document


def plain_cut(words, language):
    """Ends of the best cut, from the last word on."""
    rules, n = Rules(language), len(words)
    shown = Breaks([w["leading"] + w["word"] + w["trailing"] for w in words], rules)
    t0, t1 = [w["start"] for w in words], [w["end"] for w in words]
    gaps = [max(0.0, t0[k] - (t1[k - 1] if k else 0.0)) for k in range(n)] + [0.0]
    begin = [max(0.0, t0[k] - min(gaps[k] / 2, CAP)) for k in range(n)]
    end = [t1[k] + min(gaps[k + 1] / 2, CAP) for k in range(n)]
    best = [None] * n + [((0, FAST, 0, 0, 0, 0, 0), n)]
    for i in range(n - 1, -1, -1):
        for j in range(i, min(n, i + MOST_WORDS)):
            length = max(end[j] - begin[i], 0.01)
            _, fits, bad, chars = shown.lines(i, j)
            beyond = length > MOST_SECONDS or chars > BLOCK or not fits
            if beyond and j > i:
                break
            rest, v = best[j + 1][0], chars / length
            bad += rules.between(words[j]["word"], words[j + 1]["word"] if j + 1 < n else "")
            cost = (rest[0] + (v > FAST), max(rest[1], v, FAST), rest[2] + round(max(0.0, v - FAST) * 1e7), rest[3] + (not rules.ends(words[j]["word"], words[j]["trailing"])), rest[4] + (length < SHORT), rest[5] + 1, rest[6] + bad)
            if best[i] is None or cost < best[i][0]:
                best[i] = (cost, j + 1)
            if beyond:
                break
    spans, i = [], 0
    while i < n:
        spans.append((i, best[i][1] - 1))
        i = best[i][1]
    return spans


def collected(df, key):
    got = {}
    for r in df.orderBy(key, "segment").collect():
        got.setdefault(r[key], []).append((r["first"], r["last"]))
        assert r["segment"] == len(got[r[key]])
    return got


def test_lines_against_all_breaks():
    rng, rules = random.Random(1), Rules("en")
    for _ in range(300):
        tokens = [rng.choice(["a", "the", "of", "mirror,", "silence.", "extraordinarily", "x" * rng.randint(1, 50)]) for _ in range(rng.randint(1, 14))]
        shown, text = Breaks(tokens, rules), " ".join(tokens)
        costs = []
        for k in range(1, len(tokens)):
            a, b = " ".join(tokens[:k]), " ".join(tokens[k:])
            costs.append((max(0, len(a) - 42) + max(0, len(b) - 42), rules.between(tokens[k - 1], tokens[k]), rules.weak(tokens[k - 1]), abs(len(a) - len(b)), k))
        cut, fits, bad, chars = shown.lines(0, len(tokens) - 1)
        if len(text) <= 42 or len(tokens) == 1:
            assert (cut, fits, chars) == (None, len(text) <= 42, len(text))
        else:
            over, x, y, _, k = min(costs)
            assert (cut, fits, bad, chars) == (k - 1, over == 0, x + y, len(text) - 1)


@pytest.mark.parametrize("places", [25, 60, 256])
def test_blocks_give_the_cut_of_whole_documents(spark, places):
    rng = random.Random(places)
    documents = {f"d{k}": document(rng, n, rng.choice(["en", "fr", "de"])) for k, n in enumerate([1, 2, 24, 25, 26, 50, 51, 75, 120, 260, 300, 600])}
    rows = [(d, k, *[w[c] for c in ("word", "leading", "trailing", "start", "end", "language")]) for d, ws in documents.items() for k, w in enumerate(ws)]
    got = collected(segmentation.best_spans(spark.createDataFrame(rows, WORDS), "doc", "language", places), "doc")
    assert got == {d: plain_cut(ws, ws[0]["language"]) for d, ws in documents.items()}


def test_no_words(spark):
    assert segmentation.segment(spark.createDataFrame([], WORDS), "doc", "language").collect() == []


def test_every_turn_of_the_table(spark, sf):
    words = media.timed_words(Tables(spark, sf))
    documents = {}
    for r in words.orderBy("key", "index").collect():
        documents.setdefault(r["key"], []).append(r.asDict())
    assert collected(segmentation.segment(words, "key", "language"), "key") == {d: plain_cut(ws, "en") for d, ws in documents.items()}


def test_lines_of_short_documents_are_looked_at_where_they_matter(monkeypatch):
    """The cut of a document of one block looks at the lines of few of its spans, and is that of all of them."""
    rng, looked = random.Random(9), [0]
    real = Breaks.lines
    monkeypatch.setattr(Breaks, "lines", lambda self, i, j: (looked.__setitem__(0, looked[0] + 1), real(self, i, j))[1])
    for n in (1, 2, 30, 120, 250):
        words = document(rng, n)
        held = [w | {"doc": "d", "index": k, "block": 0} for k, w in enumerate(words)]
        looked[0] = 0
        _, _, size, ways, to, *_ = segmentation._best_ways(held, "doc", 256)
        own = looked[0]
        assert (size, len(ways)) == (n, n)
        spans, at = [], 0
        while at < n:
            spans.append((at, to[at] - 1))
            at = to[at]
        looked[0] = 0
        assert spans == plain_cut(words, "en")
        assert own < 0.5 * looked[0] or n == 1
