"""Repair of subtitles that read too fast: a few words moved, spans cut or joined, where the whole document reads better.

Spans of words are rows (key, segment, first, last), segments from 1. A pass looks at the densest segments
of every document, tries all changes around each of them at once, and takes the first change by rank that
improves the document's score; at most four passes, and only documents that changed go on.

No document is held: a change touches three spans, and the silence that neighbours share settles again some
segments on. So segments are dealt in groups of GROUP neighbours, and each focus of a group gets a window of them, the
totals of its document, and the fastest segments outside; what a change does is worked out in the window and taken off and
added to the totals. What no share of the silence can make better than the best change so far is not
worked out. Where the silence has not settled at the end of a window, that focus is looked at again with a longer one.
Spans that a pass does not change keep what is known of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.operators.segmentation import (
    BLOCK,
    CAP,
    FAST,
    FASTER,
    FASTEST,
    ITEM_NAMES,
    LAID_NAMES,
    LINE,
    MOST_SECONDS,
    MOST_WORDS,
    SHORT,
    SPAN_NAMES,
    Breaks,
    Rules,
    _better_share,
    best_places,
    better_share,
    dense,
    dense_order,
    lay_out,
    lay_out_items,
    layout,
    rules_of,
    share_gaps,
)
from lumenreel.tables import first_of_key, scan, shared_checkpoint

# Passes, foci of a pass, words and characters below which a segment is tiny.
PASSES, FOCI, TINY_WORDS, TINY_CHARS = 4, 12, 2, 10
#: Segments before a change that it can reach through the silence, and behind it at first; neighbours that are dealt together.
BEFORE, BEHIND, GROUP = 3, 8, 64

SCORE = ["over_limits", "over_30", "over_24", "tiny", "short", "top_speed", "over_18", "overflow", "bad", "segments"]
TOP = SCORE.index("top_speed")
TIMES = ["start", "end", "start0", "end0", "start1", "end1"]
#: What is worked out of a change: a window's segments by these columns. Shares are tried in steps that are rounded to milliseconds, so a bound of what they can reach has some slack.
SLIM = ["chars", "words", "lines", "longest", "line_bad", "next_bad", "raw_start", "raw_end", "start0", "end0", "start1", "end1", "base", "base_end"]
SLACK = 0.01


def timed(laid: DataFrame, key: str) -> DataFrame:
    """`laid` with start and end, and what they were before the first and the second sweep over the silences (start0, end0, start1, end1)."""
    shared = share_gaps(laid.select(key, "segment", "raw_start", "raw_end", "chars", F.col("raw_start").alias("start"), F.col("raw_end").alias("end")), key)
    kind = dict(shared.dtypes)
    swept = scan(shared, [key], ["segment"], lambda: [None, None], _sweep_step, f"{key} {kind[key]}, segment {kind['segment']}, " + ", ".join(f"{c} double" for c in TIMES))
    return laid.join(swept, [key, "segment"])


def _sweep_step(held: list, row: dict | None) -> list:
    """One segment at a time through both sweeps: its share of the silence before the next one. `held` has the segment that waits in each."""

    def second(s: dict) -> list:
        s["start1"], s["end1"] = s["start"], s["end"]
        before, held[1] = held[1], s
        if before is None:
            return []
        _better_share(before, s)
        return [before]

    if row is None:
        done = [*second(held[0]), held[1]]
    else:
        row["start0"], row["end0"] = row["start"], row["end"]
        before, held[0] = held[0], row
        done = []
        if before is not None:
            _better_share(before, row)
            done = second(before)
    return [tuple(s[c] for c in s if c not in ("raw_start", "raw_end", "chars")) for s in done]


def speed(chars: Column, start: Column, end: Column) -> Column:
    return chars / F.greatest(end - start, F.lit(0.01))


def parts_of_score(seconds: Column, chars: Column, words: Column, lines: Column, longest: Column, bad: Column) -> dict[str, Column]:
    """What one segment adds to each part of a score; of top_speed the largest counts."""
    v = chars / F.greatest(seconds, F.lit(0.01))
    one = lambda c: c.cast("bigint")
    return {
        "over_limits": one((chars > BLOCK) | (lines > 2) | (longest > LINE) | (seconds > MOST_SECONDS)),
        "over_30": one(v > FASTEST),
        "over_24": one(v > FASTER),
        "tiny": one((words < TINY_WORDS) | (chars < TINY_CHARS)),
        "short": one(seconds < SHORT),
        "top_speed": F.greatest(v, F.lit(FAST)),
        "over_18": one(v > FAST),
        "overflow": F.greatest(v - FAST, F.lit(0.0)),
        "bad": bad.cast("bigint"),
        "segments": F.lit(1).cast("bigint"),
    }


def scores(segments: DataFrame, key: str, seconds: Column, bad: Column, digits: int = 6) -> DataFrame:
    """(key, SCORE...) of segments (key, chars, words, lines, longest): compared from left to right, the lower the better.

    Every part is a sum or the largest value, so a document's segments may lie in any number of tasks.
    """
    parts = parts_of_score(seconds, F.col("chars"), F.col("words"), F.col("lines"), F.col("longest"), bad)
    how = {"top_speed": lambda c: F.round(F.max(c), digits), "overflow": lambda c: F.round(F.sum(c), digits)}
    return segments.groupBy(key).agg(*[how.get(n, F.sum)(c).alias(n) for n, c in parts.items()])


def cut_scores(segments: DataFrame, key: str, seconds: Column, bad: Column, open_end: Column) -> DataFrame:
    """(key, whole, cut): the seven numbers by which whole cuts are compared, null where a segment is beyond a limit (such a cut loses to all others)."""
    parts = parts_of_score(seconds, F.col("chars"), F.col("words"), F.col("lines"), F.col("longest"), bad)
    cut = F.struct(
        F.sum(parts["over_18"]).alias("over_18"), F.round(F.max(parts["top_speed"]), 6).alias("top_speed"), F.round(F.sum(parts["overflow"]), 6).alias("overflow"),
        F.sum(open_end.cast("bigint")).alias("open_ends"), F.sum(parts["short"]).alias("short"), F.count("*").alias("segments"), F.sum(parts["bad"]).alias("bad"),
    )
    return segments.groupBy(key).agg((F.sum(parts["over_limits"]) == 0).alias("whole"), cut.alias("cut")).withColumn("cut", F.when(F.col("whole"), F.col("cut")))


def cut_range(items: list[dict], before: float, behind: float | None, following: str | None, rules: Rules, shown: Breaks | None = None) -> list[int]:
    """Where the best cut of a range of words in a repair starts its spans; `before` and `behind` are the end and the start of the words around it.

    Fewest spans over 30, over 24, tiny and short ones, the lowest top speed, fewest over the limit, the least
    above it, the best breaks, the fewest spans; of equals the one that ends its first span first.
    """
    n = len(items)
    shown = shown or Breaks([w["leading"] + w["word"] + w["trailing"] for w in items], rules)
    at = [before, *(w["end"] for w in items)]
    to = [w["start"] for w in items] + [behind if behind is not None else items[-1]["end"]]
    gaps = [min(max(0.0, b - a) / 2, CAP) for a, b in zip(at, to, strict=True)]
    begin = [max(0.0, to[k] - gaps[k]) for k in range(n)]
    end = [at[k + 1] + gaps[k + 1] for k in range(n)]
    costs = [rules.costs(w["word"]) for w in items]
    next_bad = [a[0] + b for a, b in zip(costs, [*(c[1] for c in costs[1:]), rules.costs(following or "")[1]], strict=True)]
    upto = shown.upto
    best: list = [None] * n + [((0, 0, 0, 0, FAST, 0, 0.0, 0, 0), n)]
    for i in range(n - 1, -1, -1):
        least, cut = None, n
        for j in range(i, min(n, i + MOST_WORDS)):
            seconds, size = end[j] - begin[i], upto[j + 1] - 1 - upto[i]
            if j > i and (size > BLOCK + 1 or seconds > MOST_SECONDS):
                break
            length, rest, chars = max(seconds, 0.01), best[j + 1][0], size if size <= LINE or i == j else size - 1
            v = chars / length
            fastest = rest[0] + (v > FASTEST)
            if least is not None and fastest > least[0]:
                continue
            tiny = j - i + 1 < TINY_WORDS or chars < TINY_CHARS
            cost = (fastest, rest[1] + (v > FASTER), rest[2] + tiny, rest[3] + (length < SHORT), max(v, FAST, rest[4]), rest[5] + (v > FAST), rest[6] + max(0.0, v - FAST))
            # lines are looked at where they may matter; if these words don't fit, more of them don't either
            if least is not None and cost > least[:7]:
                continue
            fits, bad = (True, 0) if size <= LINE else shown.lines(i, j)[1:3]
            beyond = seconds > MOST_SECONDS or chars > BLOCK or not fits
            if beyond and j > i:
                break
            cost = (*cost, rest[7] + bad + next_bad[j], rest[8] + 1)
            if least is None or cost < least:
                least, cut = cost, j + 1
            if beyond:
                break
        best[i] = (least, cut)
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i = best[i][1]
    return starts


def moved(spans: list[tuple[int, int]], f: int, left: int, right: int) -> list[tuple[int, int]] | None:
    """`spans` with the borders before and behind span f moved by `left` and `right` words; null if that empties a span or there is no such border."""
    out = [list(s) for s in spans]
    if left == 1 and out[f][0] == out[f][1]:  # a single word is not handed on, whatever comes from the other side
        return None
    for border, by in ((f, left), (f + 1, right)):
        if by:
            if not 0 < border < len(out):
                return None
            out[border - 1][1] += by
            out[border][0] += by
    return [tuple(s) for s in out] if all(a <= b for a, b in out) else None


def changes(spans: list[tuple[int, int]], f: int, best: list[int], places: list[int]) -> tuple[list[list], list[list]]:
    """Changes of two or three neighbouring spans around number f in the order they are tried, and those tried only if none of them helps.

    `best` are the starts of the best cut of all of them, `places` where the middle one may be split.
    """
    starts = [*best, spans[-1][1] + 1]
    tried = [[(a, b - 1) for a, b in zip(starts, starts[1:], strict=False)]]
    tried += [moved(spans, f, *by) for by in ((1, 0), (-1, 0), (0, -1), (0, 1))]
    if 0 < f < len(spans) - 1:
        tried += [moved(spans, f, a, -b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    a, b = spans[f]
    tried += [[*spans[:f], (a, p - 1), (p, b), *spans[f + 1 :]] for p in places]
    joined = [[*spans[: k - 1], (spans[k - 1][0], spans[k][1]), *spans[k + 1 :]] for k in (f, f + 1) if 0 < k < len(spans)]
    return [t for t in tried if t is not None and t != spans], joined


def _allocated(gap: float, own: float, other: float) -> float:
    """What one of two neighbours gets of the silence between them at first; see share_gaps."""
    if own + other <= 0:
        return min(CAP, max(gap / 2, 0.0))
    every = max(own + other, 0.0001)
    return min(CAP, max(gap * own / every, gap - min(CAP, gap * other / every)))


def _need(s: dict) -> float:
    return max(s["chars"] / FAST - max(s["raw_end"] - s["raw_start"], 0.01), 0.0)


def settle(rows: list[dict], low: int, high: int, at_start: bool, at_end: bool, known_shares: dict) -> bool:
    """Sets start and end of a window's segments of which rows[low:high] are new; False if that reaches beyond the window.

    The others bring what they were before, between and after the sweeps. Before the new ones a window has
    all segments that they can reach, or the document's first. `known_shares` keeps what was worked out before.
    """
    for k in range(low - 1, high):
        if k == -1 and at_start and low == 0:
            first = rows[0]
            first["start0"] = first["raw_start"] - min(max(first["raw_start"], 0.0), CAP, _need(first))
        elif k + 1 < len(rows) and k >= 0:
            a, b = rows[k], rows[k + 1]
            gap = max(b["raw_start"] - a["raw_end"], 0.0)
            a["end0"], b["start0"] = a["raw_end"] + _allocated(gap, _need(a), _need(b)), b["raw_start"] - _allocated(gap, _need(b), _need(a))
    if at_end and high == len(rows):
        rows[-1]["end0"] = rows[-1]["raw_end"]
    last, known = rows[-1], high < len(rows)
    before = (last.get("start0"), last.get("start1"), last.get("base"), last.get("end0"), last.get("end1"))
    # shares change from the last segment but one before the new ones on, by the second sweep from one before that, and behind them until a segment starts where it did
    same_from = len(rows)
    for sweep, (begin, finish) in enumerate((("start1", "end1"), ("base", "base_end")), 1):
        first = max(0, low - 1 - sweep)
        if sweep == 1:
            for s in rows[first:]:
                s["start"], s["end"] = s["start0"], s["end0"]
        else:
            for s in rows[first : max(0, low - 2)]:  # what the first sweep did not look at
                s["start"], s["end"] = s["start1"], s["end1"]
        if first or not at_start:
            rows[first]["start"] = rows[first][begin]
        for s in rows[:first]:
            s["start"], s["end"] = s[begin], s[finish]
        settled_from = high if sweep == 1 else max(high, same_from)
        for k in range(first, len(rows) - 1):
            a, b = rows[k], rows[k + 1]
            pair = (a["chars"], b["chars"], a["raw_end"], b["raw_start"], a["start"], a["end"], b["start"], b["end"])
            got = known_shares.get(pair)
            if got is None:
                got = known_shares[pair] = better_share(pair[:2], pair[2], pair[3], pair[4:6], pair[6:])
            a["end"], b["start"] = got
            if k + 1 >= settled_from and got[1] == b[begin]:
                for s in rows[k + 1 :]:
                    s["start"], s["end"] = s[begin], s[finish]
                same_from = k + 1
                break
        else:
            same_from = len(rows)
            if not at_end:
                if not known or last["start"] != (before[1] if sweep == 1 else before[2]) or last["end"] != (before[3] if sweep == 1 else before[4]):
                    return False
                last["end"] = before[4] if sweep == 1 else last["base_end"]
    return True


def _score(rows: list[dict]) -> list[float]:
    """Sums of what segments add to a score, and their top speed."""
    total = [0, 0, 0, 0, 0, FAST, 0, 0.0, 0, len(rows)]
    for s in rows:
        seconds = s["end"] - s["start"]
        v = s["chars"] / max(seconds, 0.01)
        for k, x in enumerate((s["chars"] > BLOCK or s["lines"] > 2 or s["longest"] > LINE or seconds > MOST_SECONDS, v > FASTEST, v > FASTER, s["words"] < TINY_WORDS or s["chars"] < TINY_CHARS, seconds < SHORT, None, v > FAST, max(0.0, v - FAST), s["line_bad"] + s["next_bad"])):
            if x is not None:
                total[k] += x
        total[5] = max(total[5], v)
    return total


def _least(s: dict, before: float, behind: float) -> list:
    """What a segment adds to a score at the least, with all it can get of the silences before and behind it."""
    raw = s["raw_end"] - s["raw_start"]
    most = max(raw + min(max(before, 0.0), CAP) + min(max(behind, 0.0), CAP) + SLACK, 0.01)
    v = s["chars"] / most
    over = s["chars"] > BLOCK or s["lines"] > 2 or s["longest"] > LINE or raw > MOST_SECONDS + SLACK
    return [over, v > FASTEST, v > FASTER, s["words"] < TINY_WORDS or s["chars"] < TINY_CHARS, most < SHORT, v, v > FAST, max(0.0, v - FAST), s["line_bad"] + s["next_bad"], 1]


def _together(parts: list[list]) -> list:
    """What segments add to a score together; of the speeds the largest counts."""
    return [max(x) if k == TOP else sum(x) for k, x in enumerate(zip(*parts, strict=True))] if parts else [0, 0, 0, 0, 0, FAST, 0, 0.0, 0, 0]


def _rounded(score: list) -> tuple:
    return tuple(round(x, 6) if c in ("top_speed", "overflow") else x for c, x in zip(SCORE, score, strict=True))


def try_focus(window: list[dict], f: int, head: dict, known_shares: dict) -> tuple[bool, int, int, list[int]] | None:
    """(settled, segment of the first and the last span to replace, starts of the new ones) for the best change around segment f; null if none helps.

    `window` has the segments around the focus in their order; `head` the document's `n_segments`, totals and
    `fastest` segments (segment, speed); `known_shares` keeps what was worked out before.

    Changes are looked at in the order of what they can reach at best, and of equal ones the first counts; those that can't be better than the best so far are left.
    """
    n, rules = head["n_segments"], rules_of(window[0]["language"])
    first = window[0]["segment"]
    w0, w1 = max(1, f - 1), min(n, f + 1)
    low, high = w0 - first, w1 - first + 1
    spans = [(s["first"], s["last"]) for s in window[low:high]]
    items = [dict(zip(ITEM_NAMES, x, strict=True)) for s in window[low:high] for x in zip(*(s[c] for c in ITEM_NAMES), strict=True)]
    shown = Breaks([w["leading"] + w["word"] + w["trailing"] for w in items], rules)
    base = spans[0][0]
    before = window[low - 1]["raw_end"] if w0 > 1 else 0.0
    behind, following = (window[high]["raw_start"], window[high]["word"][0]) if w1 < n else (None, None)
    best = [base + k for k in cut_range(items, before, behind, following, rules, shown)]
    a, b = spans[f - w0]
    places = best_places([(p, rules.weak_behind(items[p - 1 - base]["word"], items[p - 1 - base]["trailing"]), rules.between(items[p - 1 - base]["word"], items[p - base]["word"])) for p in range(a + 1, b + 1)], a, b)
    rows_of = [{c: s[c] for c in SLIM} for s in window]
    at_start, at_end = first == 1, window[-1]["segment"] == n
    gone = _score([s | {"start": s["base"], "end": s["base_end"]} for s in rows_of])
    own = [head[c] for c in SCORE]
    now = _rounded(own)
    outside = max([FAST, *(v for s, v in head["fastest"] if not first <= s < first + len(window))])
    edges = [window[0]["raw_start"] if at_start else CAP, *(t["raw_start"] - s["raw_end"] for s, t in zip(window, window[1:], strict=False)), 0.0 if at_end else CAP]
    least = [_least(s, edges[k], edges[k + 1]) for k, s in enumerate(rows_of)]
    # of the segments before each one, and from each one on
    upto, since = [_together([])], [_together([])]
    for x, y in zip(least, reversed(least), strict=True):
        upto.append(_together([upto[-1], x]))
        since.append(_together([since[-1], y]))
    since.reverse()
    words: dict[tuple[int, int], dict] = {}

    def laid(span: tuple[int, int]) -> dict:
        if span not in words:
            i, j = span[0] - base, span[1] - base
            got, _ = layout(shown, i, j, items[j]["word"], items[j]["trailing"], items[j + 1]["word"] if j + 1 < len(items) else following, rules)
            words[span] = dict(zip(LAID_NAMES, got, strict=True)) | {"raw_start": items[i]["start"], "raw_end": items[j]["end"]}
        return dict(words[span])

    def with_window(parts: list) -> tuple:
        return _rounded([max(outside, parts[k]) if k == TOP else own[k] - gone[k] + parts[k] for k in range(len(SCORE))])

    for group in changes(spans, f - w0, best, places):
        tried = []
        for number, new in enumerate(group):
            # spans that stay at either side of the change keep what is known of them
            same = 0
            while same < min(len(spans), len(new)) and spans[same] == new[same]:
                same += 1
            tail = 0
            while tail < min(len(spans), len(new)) - same and spans[-1 - tail] == new[-1 - tail]:
                tail += 1
            made = [laid(s) for s in new[same : len(new) - tail]]
            gaps = [edges[low + same], *(t["raw_start"] - s["raw_end"] for s, t in zip(made, made[1:], strict=False)), edges[high - tail]]
            bound = with_window(_together([upto[low + same], *(_least(s, gaps[k], gaps[k + 1]) for k, s in enumerate(made)), since[high - tail]]))
            if bound < now:
                tried.append((bound, number, new, low + same, high - tail, made))
        found, open_ = None, []
        for bound, number, new, start, stop, made in sorted(tried, key=lambda x: x[:2]):
            if found and bound > found[0]:
                break
            rows = [dict(s) for s in rows_of[:start]] + [dict(s) for s in made] + [dict(s) for s in rows_of[stop:]]
            if not settle(rows, start, start + len(made), at_start, at_end, known_shares):
                open_.append(bound)
                continue
            score = with_window(_score(rows))
            if score < now and (found is None or (score, number) < found[:2]):
                found = (score, number, new)
        if any(found is None or bound <= found[0] for bound in open_):
            return False, w0, w1, []
        if found is not None:
            return True, w0, w1, [s[0] for s in found[2]]
    return None


def _best_changes(segments: DataFrame, totals: DataFrame, foci: DataFrame, key: str, behind: int) -> DataFrame:
    """(key, rank, focus, settled, w0, w1, starts, end) of foci (key, rank, focus) where a change helps, or could not be judged in a window of `behind` segments.

    Segments are dealt in groups of GROUP neighbours with those around them that windows reach; of a group's foci the first that a change helps counts, and those behind it are left.
    """
    fast = first_of_key(segments.select(key, "segment", speed(F.col("chars"), F.col("start"), F.col("end")).alias("speed")), [key], [F.col("speed").desc(), F.col("segment")], 2 * BEFORE + behind + 6)
    fastest = fast.groupBy(key).agg(F.collect_list("segment").alias("fast_segments"), F.collect_list("speed").alias("fast_speeds"))  # so many a document at most
    groups = foci.groupBy(key, F.floor((F.col("focus") - 1) / GROUP).cast("int").alias("_group")).agg(F.array_sort(F.collect_list(F.struct("rank", "focus"))).alias("_foci"))
    groups = groups.select(key, "_group", F.col("_foci.rank").alias("ranks"), F.col("_foci.focus").alias("foci"))
    groups = groups.join(totals.withColumn("n_segments", F.col("segments")), key).join(fastest, key)
    heads = [c for c in groups.columns if c not in (key, "_group")]
    at = F.col("segment")
    of_groups = F.sequence(F.greatest(F.lit(0), F.ceil((at - 1 - behind) / GROUP) - 1).cast("int"), F.floor((at + BEFORE) / GROUP).cast("int"))
    own = segments.select(key, "segment", "language", *SPAN_NAMES, "start0", "end0", "start1", "end1", F.col("start").alias("base"), F.col("end").alias("base_end"), *[F.col(f"items.{c}").alias(f"_{c}") for c in ITEM_NAMES], F.explode(of_groups).alias("_group"))
    # a group's first row has what is known of the document
    first = at == F.greatest(F.lit(1), F.col("_group") * GROUP - BEFORE)
    rows = own.join(groups, [key, "_group"]).withColumns({c: F.when(first, F.col(c)) for c in heads})
    kind = dict(segments.dtypes)

    def step(held: list, row: dict | None) -> list:
        if row is not None:
            held.append(row)
            return []
        for s in held:
            s |= {c: s.pop(f"_{c}").tolist() for c in ITEM_NAMES}
        head, at, known_shares, out = held[0], held[0]["segment"], {}, []
        head["fastest"] = list(zip(head["fast_segments"].tolist(), head["fast_speeds"].tolist(), strict=True))
        head |= {c: int(head[c]) for c in [*SCORE, "n_segments"] if c not in ("top_speed", "overflow")}
        for rank, f in zip(head["ranks"].tolist(), head["foci"].tolist(), strict=True):
            found = try_focus(held[max(0, f - 1 - BEFORE - at) : f + 2 + behind - at], f, head, known_shares)
            if found is not None:
                out.append((head[key], rank, f, *found))
                if found[0]:
                    break
        return out

    return scan(rows, [key, "_group"], ["segment"], list, step, f"{key} {kind[key]}, rank int, focus int, settled boolean, w0 int, w1 int, starts array<int>")


def recut(segments: DataFrame, foci: DataFrame, key: str) -> DataFrame:
    """(key, focus, first): where the best cut of the words of each focus (key, focus) and its neighbours starts its spans.

    `segments` as lay_out gives them. A range has the words of three spans; each is a row's work of its own, wherever its document lies.
    """
    wanted = foci.select(key, "focus", F.explode(F.sequence(F.col("focus") - 2, F.col("focus") + 2)).alias("segment"))
    near = F.abs(F.col("segment") - F.col("focus")) <= 1
    rows = segments.select(key, "segment", "language", "first", "raw_start", "raw_end", F.col("items")[0]["word"].alias("first_word"), "items")
    rows = wanted.join(rows, [key, "segment"]).withColumn("items", F.when(near, F.col("items")))
    kind = dict(segments.dtypes)

    def step(held: list, row: dict | None) -> list:
        if row is not None:
            held.append(row)
            return []
        f = held[0]["focus"]
        before, own, behind = ([r for r in held if side(r["segment"] - f)] for side in (lambda d: d < -1, lambda d: abs(d) <= 1, lambda d: d > 1))
        items = [x if isinstance(x, dict) else x.asDict() for r in own for x in r["items"]]
        starts = cut_range(items, before[0]["raw_end"] if before else 0.0, behind[0]["raw_start"] if behind else None, behind[0]["first_word"] if behind else None, rules_of(own[0]["language"]))
        return [(held[0][key], f, own[0]["first"] + k) for k in starts]

    return scan(rows, [key, "focus"], ["segment"], list, step, f"{key} {kind[key]}, focus int, first int")


def one_pass(laid: DataFrame, key: str, first: bool) -> tuple[DataFrame, DataFrame]:
    """(segments, the best change of each document that one improves: key, w0, w1, starts) of spans as lay_out gives them."""
    laid = shared_checkpoint(laid)
    segments = shared_checkpoint(timed(laid, key))
    totals = scores(segments, key, F.col("end") - F.col("start"), F.col("line_bad") + F.col("next_bad"), 15)
    reads = segments.select(key, "segment", "chars", "words", "lines", speed(F.col("chars"), F.col("start"), F.col("end")).alias("speed"))
    if first:
        reads = reads.join(totals.where("over_18 > 0").select(key), key, "left_semi")
    ranked = first_of_key(dense(reads), [key], dense_order("segment"), FOCI, "rank")
    waiting, behind, found = ranked.select(key, F.col("rank").cast("int").alias("rank"), F.col("segment").cast("int").alias("focus")), BEHIND, None
    while True:
        got = shared_checkpoint(_best_changes(segments, totals, waiting, key, behind))
        found = got.where("settled") if found is None else found.unionAll(got.where("settled"))
        waiting, behind = got.where("not settled").select(key, "rank", "focus"), 4 * behind
        if waiting.isEmpty():
            break
    taken = found.groupBy(key).agg(F.min_by(F.struct("w0", "w1", "starts"), "rank").alias("t")).select(key, "t.*")
    return segments, shared_checkpoint(taken)


def changed_spans(segments: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Spans as lay_out gives them of the documents with a change (key, w0, w1, starts), after it: new ones are laid out from the words of those that they replace, the others are moved on."""
    columns = ["language", *SPAN_NAMES, "items"]
    joined = segments.select(key, "segment", *columns).join(taken, key)
    inside = F.col("segment").between(F.col("w0"), F.col("w1"))
    longer = F.size("starts") - (F.col("w1") - F.col("w0") + 1)
    moved_on = joined.where(~inside).select(key, (F.col("segment") + F.when(F.col("segment") > F.col("w1"), longer).otherwise(0)).cast("int").alias("segment"), *columns)
    # three spans of a document at most, and the first word behind them
    around = joined.where(inside | (F.col("segment") == F.col("w1") + 1))
    each = around.groupBy(key).agg(
        F.min("w0").alias("w0"), F.min_by("language", "segment").alias("language"), F.min("first").alias("base"), F.min_by("starts", "segment").alias("starts"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("segment", "items")))), lambda s: s["items"])).alias("words"), F.max(F.when(~inside, F.col("items")[0]["word"])).alias("behind"),
    )
    each = each.select("*", F.posexplode("starts").alias("k", "start")).withColumn("stop", F.coalesce(F.get("starts", F.col("k") + 1) - F.col("base"), F.size("words")))
    new = each.select(
        key, (F.col("w0") + F.col("k")).cast("int").alias("segment"), "language", F.col("start").alias("first"), F.slice("words", F.col("start") - F.col("base") + 1, F.col("stop") - F.col("start") + F.col("base")).alias("items"),
        F.coalesce(F.get("words", F.col("stop"))["word"], F.col("behind")).alias("following"),
    )
    return moved_on.unionByName(lay_out_items(new, key).drop("text"))


def repair_laid(words: DataFrame, spans: DataFrame, key: str, language: str, passes: int = PASSES) -> DataFrame:
    """Segments, as timed gives them, of `spans` after repair, with `passes`; see repair."""
    kind = dict(spans.dtypes)[key]
    now = spans.select(F.col(key).cast(kind).alias(key), *[F.col(c).cast("int").alias(c) for c in ("segment", "first", "last")])
    laid, done = lay_out(words, now, key, language).drop("text"), None
    for k in range(passes):
        segments, taken = one_pass(laid, key, k == 0)
        stay = segments.join(taken, key, "left_anti").withColumn("passes", F.lit(k + 1))
        done = stay if done is None else done.unionByName(stay)
        if taken.isEmpty():
            return done
        laid = changed_spans(segments, taken, key)
    return done.unionByName(timed(shared_checkpoint(laid), key).withColumn("passes", F.lit(passes + 1)))


def repair(words: DataFrame, spans: DataFrame, key: str, language: str, passes: int = PASSES) -> DataFrame:
    """(key, segment, first, last, passes): `spans` (key, segment from 1, first, last) of `words` after repair; passes is one more than the changes made.

    A document that reads within the limit stays as it is. Spans have to cover a document's words from 0 without a gap.
    """
    return repair_laid(words, spans, key, language, passes).select(key, "segment", "first", "last", "passes")


def repaired_segments(words: DataFrame, spans: DataFrame, key: str, language: str) -> DataFrame:
    """(key, segment, first, last, start, end, chars, words, lines, passes) after repair, silences shared and swept."""
    return repair_laid(words, spans, key, language).select(key, "segment", "first", "last", "start", "end", "chars", "words", "lines", "passes")
