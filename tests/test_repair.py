"""Repair of fast subtitles against a loop over whole documents that works everything out anew for every change."""

import copy
import itertools
import random

import pytest
from pyspark.sql import functions as F

from lumenreel.operators import repair, segmentation
from lumenreel.operators.segmentation import Breaks, Rules

WORDS = "doc string, index int, word string, leading string, trailing string, start double, end double, language string"
SPANS = "doc string, segment int, first int, last int"


def share(gap, left, right):
    if gap <= 0:
        return 0.0, 0.0
    most = min(0.75, gap)
    if left <= 0 and right <= 0:
        return min(gap / 2, most), min(gap - min(gap / 2, most), most)
    every = max(left + right, 0.0001)
    a, b = min(most, gap * left / every), min(most, gap * right / every)
    # what the cap of one leaves over goes to the other
    return min(most, max(a, gap - b)), min(most, max(b, gap - a))


def whole(words, spans, rules):
    """All segments of a document: text features, silences shared and swept twice."""
    out = []
    for a, b in spans:
        shown = Breaks([w["leading"] + w["word"] + w["trailing"] for w in words[a : b + 1]], rules)
        cut, _, bad, chars = shown.lines(0, b - a)
        lines = shown.text(0, cut, b - a).split("\n")
        bad = bad if cut is not None else 0
        if b + 1 < len(words):
            bad += rules.between(words[b]["word"], words[b + 1]["word"])
        out.append({"raw_start": words[a]["start"], "raw_end": words[b]["end"], "chars": chars, "words": b - a + 1, "lines": len(lines), "longest": max(map(len, lines)), "bad": bad})
    need = [max(0.0, s["chars"] / 18 - max(s["raw_end"] - s["raw_start"], 0.01)) for s in out]
    for s in out:
        s["start"], s["end"] = s["raw_start"], s["raw_end"]
    out[0]["start"] -= min(out[0]["start"], 0.75, need[0])
    for k in range(len(out) - 1):
        a, b = share(out[k + 1]["raw_start"] - out[k]["raw_end"], need[k], need[k + 1])
        out[k]["end"] += a
        out[k + 1]["start"] -= b
    for _ in range(2):
        for k in range(len(out) - 1):
            segmentation._better_share(out[k], out[k + 1])
    return out


def score(words, spans, rules):
    s = whole(words, spans, rules)
    took = [x["end"] - x["start"] for x in s]
    v = [x["chars"] / max(t, 0.01) for x, t in zip(s, took, strict=True)]
    return (
        sum(x["chars"] > 84 or x["lines"] > 2 or x["longest"] > 42 or t > 7 for x, t in zip(s, took, strict=True)), sum(x > 30 for x in v), sum(x > 24 for x in v),
        sum(x["words"] < 2 or x["chars"] < 10 for x in s), sum(t < 1.2 for t in took), round(max(18.0, *v), 6), sum(x > 18 for x in v),
        round(sum(max(0.0, x - 18) for x in v), 6), sum(x["bad"] for x in s), len(s),
    )


def tries(words, spans, f, rules):
    """Whole documents' spans for each change around span f, the joins apart."""
    n, out = len(spans), []
    low, high = max(0, f - 1), min(n - 1, f + 1)
    a, b = spans[low][0], spans[high][1]
    starts = [a + k for k in repair.cut_range(words[a : b + 1], words[a - 1]["end"] if a else 0.0, words[b + 1]["start"] if b + 1 < len(words) else None, words[b + 1]["word"] if b + 1 < len(words) else None, rules)]
    out.append(spans[:low] + [(x, y - 1) for x, y in zip(starts, [*starts[1:], b + 1], strict=True)] + spans[high + 1 :])

    def shifted(moves):
        new = [list(s) for s in spans]
        for border, by in moves:
            if not 0 < border < n:
                return
            giver = new[border] if by > 0 else new[border - 1]
            if giver[0] == giver[1]:
                return
            new[border - 1][1] += by
            new[border][0] += by
        out.append([tuple(s) for s in new])

    for move in ((f, 1), (f, -1), (f + 1, -1), (f + 1, 1)):
        shifted([move])
    if 0 < f < n - 1:
        for x in (-1, 0, 1):
            for y in (-1, 0, 1):
                if x or y:
                    shifted([m for m in ((f, x), (f + 1, -y)) if m[1]])
    i, j = spans[f]
    order = sorted(range(i + 1, j + 1), key=lambda p: (0 if any(m in words[p - 1]["trailing"] for m in ".?!;:") or rules.among(words[p - 1]["word"], rules.good_end) else 1, rules.between(words[p - 1]["word"], words[p]["word"]), abs(p - (i + j) / 2), p - i))
    for p in order[:6]:
        out.append(spans[:f] + [(i, p - 1), (p, j)] + spans[f + 1 :])
    joins = [spans[: k - 1] + [(spans[k - 1][0], spans[k][1])] + spans[k + 1 :] for k in (f, f + 1) if 0 < k < n]
    return [x for x in out if x != spans], joins


def plain_repair(words, spans, language):
    rules, changes = Rules(language), 0
    speeds = lambda s: [x["chars"] / max(x["end"] - x["start"], 0.01) for x in s]
    if not any(v > 18 for v in speeds(whole(words, spans, rules))):
        return spans, 1
    for _ in range(4):
        s = whole(words, spans, rules)
        v = speeds(s)
        dense = [k for k in range(len(s)) if v[k] >= 17 or s[k]["lines"] >= 2 and s[k]["chars"] >= 74]
        dense.sort(key=lambda k: (v[k] + 0.3 * (s[k]["lines"] >= 2) + s[k]["chars"] / 500, s[k]["chars"], s[k]["words"], k), reverse=True)
        for f in dense[:12]:
            best = now = (score(words, spans, rules), spans)
            for group in tries(words, spans, f, rules):
                if best is now:
                    for t in group:
                        if (new := score(words, t, rules)) < best[0]:
                            best = (new, t)
            if best is not now:
                break
        else:
            break
        spans, changes = best[1], changes + 1
    return spans, 1 + changes


VOCABULARY = ["the", "a", "of", "king", "mirror", "and", "spoke", "everybody", "chapter", "in", "silence", "l'eau", "que", "extraordinarily", "no", "to"]


def document(rng, n, language="en"):
    words, at = [], rng.choice([0.0, 0.4, 2.0])
    pace = rng.choice([0.03, 0.045, 0.06])
    for k in range(n):
        word = rng.choice(VOCABULARY)
        trailing = rng.choice(["", "", "", "", ",", ".", ";"])
        end = at + pace * (len(word) + 1) * rng.uniform(0.5, 1.6)
        words.append({"word": word, "leading": "", "trailing": trailing, "start": at, "end": end, "language": language})
        at = end + rng.choice([0.0, 0.0, 0.05, 0.3, 1.0, 2.5] if k % 4 else [0.0, 0.2])
    return words


def cut(rng, n):
    spans, at = [], 0
    while at < n:
        size = min(rng.choice([1, 2, 4, 6, 9, 12]), n - at)
        spans.append((at, at + size - 1))
        at += size
    return spans


def frames(spark, documents):
    words = [(d, k, *[w[c] for c in ("word", "leading", "trailing", "start", "end", "language")]) for d, (ws, _) in documents.items() for k, w in enumerate(ws)]
    spans = [(d, k, a, b) for d, (_, s) in documents.items() for k, (a, b) in enumerate(s, 1)]
    return spark.createDataFrame(words, WORDS), spark.createDataFrame(spans, SPANS)


def repaired(spark, documents):
    got = {}
    for r in repair.repair(*frames(spark, documents), "doc", "language").orderBy("doc", "segment").collect():
        got.setdefault(r.doc, ([], r.passes))[0].append((r.first, r.last))
        assert r.segment == len(got[r.doc][0])
    return got


def some_documents(seed, n):
    rng = random.Random(seed)
    out = {}
    for k in range(n):
        size = rng.choice([1, 3, 12, 40, 90])
        words = document(rng, size, rng.choice(["en", "fr"]))
        out[f"d{k}"] = (words, cut(rng, size))
    return out


def test_equals_a_loop_over_whole_documents(spark):
    documents = some_documents(5, 50)
    want = {d: plain_repair(w, s, w[0]["language"]) for d, (w, s) in documents.items()}
    got = repaired(spark, documents)
    assert got == want
    assert sum(p > 1 for _, p in want.values()) > 12
    assert {p for _, p in want.values()} >= {1, 5}


def test_silence_that_settles_beyond_a_window(spark, monkeypatch):
    monkeypatch.setattr(repair, "BEHIND", 1)
    documents = some_documents(11, 16)
    assert repaired(spark, documents) == {d: plain_repair(w, s, w[0]["language"]) for d, (w, s) in documents.items()}


def test_groups_of_few_neighbours(spark, monkeypatch):
    monkeypatch.setattr(repair, "GROUP", 5)
    documents = some_documents(21, 12)
    assert repaired(spark, documents) == {d: plain_repair(w, s, w[0]["language"]) for d, (w, s) in documents.items()}


def test_segments_and_scores_of_whole_documents(spark):
    documents = some_documents(8, 20)
    words, spans = frames(spark, documents)
    segments = repair.timed(repair.lay_out(words, spans, "doc", "language"), "doc")
    scored = repair.scores(segments, "doc", F.col("end") - F.col("start"), F.col("line_bad") + F.col("next_bad"))
    got = {r["doc"]: tuple(r)[1:] for r in scored.collect()}
    for d, (w, s) in documents.items():
        assert got[d] == pytest.approx(score(w, s, Rules(w[0]["language"])), abs=2e-6)


def range_cost(items, starts, before, behind, following, rules):
    n = len(items)
    ends = [*starts[1:], n]
    shown = Breaks([w["leading"] + w["word"] + w["trailing"] for w in items], rules)
    cost = [0, 0, 0, 0, 18.0, 0, 0.0, 0, 0]
    for a, b in zip(starts, ends, strict=True):
        left = items[a]["start"] - (items[a - 1]["end"] if a else before)
        right = (items[b]["start"] if b < n else behind if behind is not None else items[b - 1]["end"]) - items[b - 1]["end"]
        begin, end = max(0.0, items[a]["start"] - min(max(left, 0.0) / 2, 0.75)), items[b - 1]["end"] + min(max(right, 0.0) / 2, 0.75)
        _, fits, bad, chars = shown.lines(a, b - 1)
        if b - a > 1 and (end - begin > 7 or chars > 84 or not fits):
            return None
        length = max(end - begin, 0.01)
        v = chars / length
        bad += rules.between(items[b - 1]["word"], items[b]["word"] if b < n else following or "")
        cost = [cost[0] + (v > 30), cost[1] + (v > 24), cost[2] + (b - a < 2 or chars < 10), cost[3] + (length < 1.2), max(cost[4], v), cost[5] + (v > 18), cost[6] + max(0.0, v - 18), cost[7] + bad, cost[8] + 1]
    return tuple(cost[:4]), round(cost[4], 9), (cost[5], round(cost[6], 9), cost[7], cost[8])


@pytest.mark.parametrize("seed", range(12))
def test_a_range_against_all_its_cuts(seed):
    """The best in the parts before the top speed; where no suffix had to choose between speeds, in all parts."""
    rng, rules = random.Random(seed), Rules("en")
    items = document(rng, rng.randint(1, 12))
    before, behind, following = items[0]["start"] - 0.2, items[-1]["end"] + 0.3, "and"
    got = repair.cut_range(items, before, behind, following, rules)
    every = [[0, *c] for r in range(len(items)) for c in itertools.combinations(range(1, len(items)), r)]
    costs = {tuple(c): x for c in every if (x := range_cost(items, c, before, behind, following, rules)) is not None}
    best = min(costs.values())
    assert costs[tuple(got)][:2] == best[:2]
    if best[1] == 18.0:
        assert costs[tuple(got)] == best


def test_settle_stops_where_shares_are_as_they_were():
    """A window's shares are those of the whole document swept anew, and pairs beyond those that a change reaches are not looked at."""

    rng = random.Random(5)
    seen = every = settled = 0

    def swept(rows):
        rows = copy.deepcopy(rows)
        for k, s in enumerate(rows):
            s["start0"] = s["raw_start"] - (min(max(s["raw_start"], 0.0), repair.CAP, repair._need(s)) if k == 0 else 0.0)
            s["end0"] = s["raw_end"]
        for a, b in zip(rows, rows[1:], strict=False):
            gap = max(b["raw_start"] - a["raw_end"], 0.0)
            a["end0"], b["start0"] = a["raw_end"] + repair._allocated(gap, repair._need(a), repair._need(b)), b["raw_start"] - repair._allocated(gap, repair._need(b), repair._need(a))
        for s in rows:
            s["start"], s["end"] = s["start0"], s["end0"]
        for begin, finish in (("start1", "end1"), ("base", "base_end")):
            for a, b in zip(rows, rows[1:], strict=False):
                a["end"], b["start"] = repair.better_share((a["chars"], b["chars"]), a["raw_end"], b["raw_start"], (a["start"], a["end"]), (b["start"], b["end"]))
            for s in rows:
                s[begin], s[finish] = s["start"], s["end"]
        return rows

    for _ in range(300):
        n, at, rows = rng.randint(1, 30), rng.choice([0.0, 0.4]), []
        for k in range(n):
            end = at + rng.uniform(0.3, 3.0)
            rows.append({"segment": k, "raw_start": at, "raw_end": end, "chars": rng.randint(3, 80)})
            at = end + rng.choice([0.0, 0.1, 0.6, 1.7])
        was, f = swept(rows), rng.randrange(n)
        for s in rows[max(0, f - 1) : f + 2]:
            s["chars"] = rng.randint(3, 80)
        want = swept(rows)
        lo, hi = max(0, f - 1 - repair.BEFORE), min(n, f + 2 + repair.BEHIND)
        new_lo, new_hi = max(0, f - 1), min(n, f + 2)
        window = [dict(s) | ({"chars": rows[s["segment"]]["chars"]} if new_lo <= s["segment"] < new_hi else {}) for s in was[lo:hi]]
        shares = {}
        if repair.settle(window, new_lo - lo, new_hi - lo, lo == 0, hi == n, shares):
            settled += 1
            assert [(s["start"], s["end"]) for s in window] == [(s["start"], s["end"]) for s in want[lo:hi]]
        if n > 20 and 5 < f < n - 12:
            seen, every = seen + len(shares), every + 2 * (len(window) - 1)
    assert settled > 200
    assert seen < 0.6 * every, (seen, every)


def test_changes_that_cannot_win_are_not_worked_out(monkeypatch):
    """Most changes around a focus are left by what they can reach at best, and the change taken is that of whole documents."""
    rng, seen = random.Random(3), [0, 0]
    settle, make = repair.settle, repair.changes
    monkeypatch.setattr(repair, "settle", lambda *a: (seen.__setitem__(0, seen[0] + 1), settle(*a))[1])
    monkeypatch.setattr(repair, "changes", lambda *a: (lambda got: (seen.__setitem__(1, seen[1] + sum(map(len, got))), got)[1])(make(*a)))
    for _ in range(40):
        words, rules = document(rng, 60), Rules("en")
        spans = cut(rng, 60)
        window = segments_of(words, spans, rules)
        head = {"n_segments": len(spans), "fastest": [], **dict(zip(repair.SCORE, score(words, spans, rules), strict=True))}
        f = rng.randint(1, len(spans))
        found = repair.try_focus(window, f, head, {})
        now = score(words, spans, rules)
        best = (now, None)
        for group in tries(words, spans, f - 1, rules):
            if best[1] is None:
                for t in group:
                    if (new := score(words, t, rules)) < best[0]:
                        best = (new, t)
        if best[1] is None:
            assert found is None
        else:
            settled, w0, w1, starts = found
            kept = [s[0] for k, s in enumerate(spans, 1) if k < w0] + starts + [s[0] for k, s in enumerate(spans, 1) if k > w1]
            assert settled and kept == [s[0] for s in best[1]]
    assert seen[0] < 0.6 * seen[1], seen


def segments_of(words, spans, rules):
    """Segments of a whole document as a window of its own, with their times before, between and after the sweeps."""
    rows = []
    for k, (a, b) in enumerate(spans, 1):
        shown = Breaks([w["leading"] + w["word"] + w["trailing"] for w in words[a : b + 1]], rules)
        got, _ = segmentation.layout(shown, 0, b - a, words[b]["word"], words[b]["trailing"], words[b + 1]["word"] if b + 1 < len(words) else None, rules)
        rows.append({"segment": k, "language": "en", "first": a, "last": b, "raw_start": words[a]["start"], "raw_end": words[b]["end"], **dict(zip(segmentation.LAID_NAMES, got, strict=True)), **{c: [w[c] for w in words[a : b + 1]] for c in segmentation.ITEM_NAMES}})
    need = [repair._need(s) for s in rows]
    for k, s in enumerate(rows):
        s["start0"] = s["raw_start"] - (min(max(s["raw_start"], 0.0), repair.CAP, need[0]) if k == 0 else repair._allocated(max(0.0, s["raw_start"] - rows[k - 1]["raw_end"]), need[k], need[k - 1]))
        s["end0"] = s["raw_end"] + (repair._allocated(max(0.0, rows[k + 1]["raw_start"] - s["raw_end"]), need[k], need[k + 1]) if k + 1 < len(rows) else 0.0)
    times = [{"chars": s["chars"], "raw_start": s["raw_start"], "raw_end": s["raw_end"], "start": s["start0"], "end": s["end0"]} for s in rows]
    for begin, finish in (("start1", "end1"), ("base", "base_end")):
        for x, y in zip(times, times[1:], strict=False):
            segmentation._better_share(x, y)
        for s, t in zip(rows, times, strict=True):
            s[begin], s[finish] = t["start"], t["end"]
    return rows
