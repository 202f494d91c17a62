"""Subtitles out of timed words: the best cut of a whole document, lines, and how fast they read."""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.functions import languages as L
from lumenreel.tables import running, scan, shared_checkpoint

# Characters of a line and a block, words and seconds of a block, reading speeds, seconds of a short block, marks that end a sentence, marks cut off words, most seconds taken from a gap.
LINE, BLOCK, MOST_WORDS, MOST_SECONDS = 42, 84, 24, 7.0
FAST, FASTER, FASTEST, SHORT, CAP = 18.0, 24.0, 30.0, 1.2, 0.75
REMEMBERED = 100_000  # words of one language whose rules a task keeps
STRONG, STRIP = ".?!;:", "\"“”‘’«»()[]{}.,;:!?"


class Rules:
    """Words of one language at which lines and blocks should or should not break."""

    def __init__(self, language: str) -> None:
        self.short = frozenset(L.ABBREVIATIONS.get(language, L.ABBREVIATIONS["en"]))
        self.known: dict[str, tuple[int, int, bool]] = {}
        self.no_start, self.no_end, self.good_end = (self._ready(t.get(language, t["en"])) for t in (L.NO_START, L.NO_END, L.GOOD_END))

    @staticmethod
    def _ready(words: tuple[str, ...]) -> tuple[frozenset[str], frozenset[str], tuple[str, ...]]:
        """Words as they stand, words without anything but letters and digits, and beginnings, which end in an apostrophe."""
        return frozenset(words), frozenset(re.sub(r"\W+", "", w) for w in words if not w.endswith("'")), tuple(w for w in words if w.endswith("'"))

    def among(self, word: str, rules: tuple[frozenset[str], frozenset[str], tuple[str, ...]]) -> bool:
        w = word.strip().strip(STRIP).lower()
        return bool(w) and (w in rules[0] or re.sub(r"\W+", "", w) in rules[1] or w.startswith(rules[2]))

    def costs(self, word: str) -> tuple[int, int, bool]:
        """How bad it is to end with a word, to start with it, and whether it is good to end with; the latest words are remembered."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            bad = 3 + 2 * ("'" in word)
            got = self.known[word] = (bad * self.among(word, self.no_end), bad * self.among(word, self.no_start), self.among(word, self.good_end))
        return got

    def between(self, left: str, right: str) -> int:
        """How bad a break between two words is."""
        return self.costs(left)[0] + self.costs(right)[1]

    def weak(self, left: str) -> int:
        """1 if a line ends without a mark or a good word."""
        return 0 if left[-1:] in STRONG or self.costs(left)[2] else 1

    def weak_behind(self, word: str, trailing: str) -> int:
        """1 if a span ends behind the word without a mark or a good word."""
        return 0 if any(m in trailing for m in STRONG) or self.costs(word)[2] else 1

    def ends(self, word: str, trailing: str) -> bool:
        """Whether a sentence ends behind a word."""
        return any(m in trailing for m in STRONG) and (word + trailing).strip().lower() not in self.short


@functools.cache
def rules_of(language: str) -> Rules:
    return Rules(language)


class Breaks:
    """Tokens of a document, and what it costs to break behind each of them."""

    def __init__(self, tokens: list[str], rules: Rules) -> None:
        self.tokens = tokens
        self.upto = [0]
        for t in tokens:
            self.upto.append(self.upto[-1] + len(t) + 1)
        costs = [rules.costs(t) for t in tokens]
        self.bad = [a[0] + b[1] for a, b in zip(costs, costs[1:], strict=False)]
        self.weak = [0 if t[-1:] in STRONG or c[2] else 1 for t, c in zip(tokens, costs, strict=True)]
        self.broken = any("\n" in t for t in tokens)

    def lines(self, i: int, j: int) -> tuple[int | None, bool, int, int]:
        """(last token of the first line, whether they fit, how bad the break is, characters) of the tokens i to j in one or two lines: the first of the best breaks."""
        upto = self.upto
        begin, end = upto[i], upto[j + 1] - 1
        size = end - begin
        if size <= LINE or i == j:
            return None, size <= LINE, 0 if size <= LINE else 4, size
        # breaks that leave both lines within the limit beat all others, and lie next to each other
        low, high = max(i, bisect_left(upto, end - LINE) - 1), min(j - 1, bisect_right(upto, begin + LINE + 1) - 2)
        if low <= high:
            # the best of them by how bad it is, whether a mark or good word ends the line, evenness, place
            both = begin + end + 1
            bad, weak, _, k = min([(self.bad[k], self.weak[k], abs(2 * upto[k + 1] - both), k) for k in range(low, high + 1)])
            return k, True, bad + weak, size - 1
        best = None
        for k in range(i, j):
            a, b = upto[k + 1] - 1 - begin, end - upto[k + 1]
            cost = (max(0, a - LINE) + max(0, b - LINE), self.bad[k], self.weak[k], abs(a - b), k)
            if best is None or cost < best:
                best = cost
        over, bad, weak, _, k = best
        return k, over == 0, bad + weak, size - 1

    def text(self, i: int, k: int | None, j: int) -> str:
        first = self.tokens[i : j + 1] if k is None else self.tokens[i : k + 1]
        return " ".join(first) + ("" if k is None else "\n" + " ".join(self.tokens[k + 1 : j + 1]))

    def shape(self, i: int, k: int | None, j: int) -> tuple[int, int]:
        """How many lines the text has, and the length of the longest one."""
        if self.broken:
            lines = self.text(i, k, j).split("\n")
            return len(lines), max(map(len, lines))
        begin, end = self.upto[i], self.upto[j + 1] - 1
        return (1, end - begin) if k is None else (2, max(self.upto[k + 1] - 1 - begin, end - self.upto[k + 1]))


SPAN = "first int, last int, raw_start double, raw_end double, chars int, words int, lines int, longest int, line_bad int, next_bad int, open_end boolean"
SPAN_NAMES = [c.split()[0] for c in SPAN.split(", ")]
ITEM_NAMES = ["word", "leading", "trailing", "start", "end"]
LAID = SPAN[SPAN.index("chars") :]
LAID_NAMES = [c.split()[0] for c in LAID.split(", ")]


def layout(shown: Breaks, i: int, j: int, word: str, trailing: str, following: str | None, rules: Rules) -> tuple[tuple, int | None]:
    """(chars, words, lines, longest, line_bad, next_bad, open_end) of the tokens i to j as one span, and the last token of its first line; `word` and `trailing` are the last word's, `following` is the word behind it, null at a document's end."""
    cut, _, bad, chars = shown.lines(i, j)
    next_bad = rules.between(word, following) if following is not None else 0
    return (chars, j - i + 1, *shown.shape(i, cut, j), bad if cut is not None else 0, next_bad, not rules.ends(word, trailing)), cut


def lay_out(words: DataFrame, spans: DataFrame, key: str, language: str) -> DataFrame:
    """(key, segment, language, SPAN, text, items) of spans (key, segment, first, last) of words (key, index from 0, word, leading, trailing, start, end, language)."""
    wanted = spans.select(key, "segment", "first", "last", F.explode(F.sequence("first", F.col("last") + 1)).alias("index"))
    rows = wanted.join(words.select(key, F.col("index").cast("int").alias("index"), "word", "leading", "trailing", "start", "end", F.col(language).alias("language")), [key, "index"])
    own = F.col("index") <= F.col("last")
    item = F.struct("index", "word", "leading", "trailing", "start", "end")
    held = rows.groupBy(key, "segment").agg(
        F.min_by("language", "index").alias("language"), F.min("first").cast("int").alias("first"), F.array_sort(F.collect_list(F.when(own, item))).alias("_own"), F.max(F.when(~own, F.col("word"))).alias("following")
    ).where(F.size("_own") > 0)
    laid = held.withColumn("items", F.transform("_own", lambda x: F.struct(*[x[c].alias(c) for c in ITEM_NAMES]))).drop("_own")
    # a number of its own and a hash: see scan
    return lay_out_items(laid.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(key, "segment")), key)


def lay_out_items(spans: DataFrame, key: str) -> DataFrame:
    """(key, segment, language, SPAN, text, items) of spans (key, segment, language, first, items, following): the words of each, and the word behind them or null."""

    @F.pandas_udf(f"{LAID}, text string")
    def laid(leading: pd.Series, word: pd.Series, trailing: pd.Series, language: pd.Series, following: pd.Series) -> pd.DataFrame:
        out = []
        for before, words, behind, name, after in zip(leading, word, trailing, language, following, strict=True):
            rules, n = rules_of(name), len(words)
            shown = Breaks([a + w + b for a, w, b in zip(before, words, behind, strict=True)], rules)
            got, cut = layout(shown, 0, n - 1, words[-1], behind[-1], after, rules)
            out.append((*got, shown.text(0, cut, n - 1)))
        return pd.DataFrame(out, columns=[*LAID_NAMES, "text"])

    n = F.size("items")
    with_text = spans.withColumn("_laid", laid("items.leading", "items.word", "items.trailing", "language", "following"))
    span = {"last": F.col("first") + n - 1, "raw_start": F.col("items")[0]["start"], "raw_end": F.element_at("items", -1)["end"]} | {c: F.col("_laid")[c] for c in LAID_NAMES}
    return with_text.select(key, "segment", "language", *[span.get(c, F.col(c)).alias(c) for c in SPAN_NAMES], F.col("_laid.text").alias("text"), "items")


#: Places of a block. What a cut of a document costs, part by part: fast blocks; their top speed; speed above the limit in
#: ten-millionths; ends without a mark and short blocks; blocks and bad breaks (two counts in one number).
PLACES = 512
WEIGHTS = ["fast", "speed", "over", "open_short", "count_bad"]
_PAIR = 1 << 31
_FAR = {"speed": np.inf} | dict.fromkeys(("fast", "over", "open_short", "count_bad"), np.int64(1) << 61)


def _ready(held: list[dict], places: int) -> tuple:
    """Of a block's words and those behind it: how many are its own, the tokens, where a span may begin and end, and how bad it is to end one behind each word."""
    block = held[0]["block"]
    own = [r for r in held if r["index"] >= block * places]
    size = sum(r["index"] < (block + 1) * places for r in own)
    word, lead, trail, t0, t1 = ([r[c] for r in own] for c in ("word", "leading", "trailing", "start", "end"))
    rules, n = rules_of(own[0]["language"]), len(own)
    shown = Breaks([lead[k] + word[k] + trail[k] for k in range(n)], rules)
    before = held[0]["end"] if held[0]["index"] < block * places else 0.0
    gaps = [max(0.0, a - b) for a, b in zip(t0, [before, *t1], strict=False)] + [0.0]
    begin = [max(0.0, t0[k] - min(gaps[k] / 2, CAP)) for k in range(n)]
    end = [t1[k] + min(gaps[k + 1] / 2, CAP) for k in range(n)]
    between = [rules.between(a, b) for a, b in zip(word, [*word[1:], ""], strict=True)]
    open_end = [(not rules.ends(a, b)) * _PAIR for a, b in zip(word, trail, strict=True)]
    return size, shown, begin, end, between, open_end


def _edges(held: list[dict], key: str, places: int) -> tuple:
    """The ways from each place of a block of words: how many a place has, where each leads to from the block's first place on, and what it weighs."""
    size, shown, begin, end, between, open_end = _ready(held, places)
    n = len(begin)
    ways, to, weights = [], [], {w: [] for w in WEIGHTS}
    for i in range(size):
        for j in range(i, min(n, i + MOST_WORDS)):
            length = max(end[j] - begin[i], 0.01)
            _, fits, bad, chars = shown.lines(i, j)
            beyond = length > MOST_SECONDS or chars > BLOCK or not fits
            if beyond and j > i:
                break
            v = chars / length
            to.append(j + 1)
            for w, x in zip(WEIGHTS, (int(v > FAST), max(v, FAST), round(max(0.0, v - FAST) * 1e7), open_end[j] + (length < SHORT), _PAIR + bad + between[j]), strict=True):
                weights[w].append(x)
            if beyond:
                break
        ways.append(len(to))
    return (held[0][key], held[0]["block"], size, ways, to, *weights.values())


def _best_ways(held: list[dict], key: str, places: int) -> tuple:
    """The row of the only block of a document with the best way alone from each place: nothing passes into it, so the parts of the cost are compared together from the last word on."""
    n, shown, begin, end, between, open_end = _ready(held, places)
    upto, to = shown.upto, [0] * n
    best: list = [None] * n + [(0, FAST, 0, 0, 0)]
    for i in range(n - 1, -1, -1):
        least = None
        for j in range(i, min(n, i + MOST_WORDS)):
            size, length = upto[j + 1] - 1 - upto[i], max(end[j] - begin[i], 0.01)
            if j > i and (size > BLOCK + 1 or length > MOST_SECONDS):
                break
            rest, chars = best[j + 1], size if size <= LINE or i == j else size - 1
            v = chars / length
            fast = rest[0] + (v > FAST)
            if least is not None and fast > least[0]:
                continue
            cost = (fast, max(v, FAST, rest[1]), rest[2] + round(max(0.0, v - FAST) * 1e7), rest[3] + open_end[j] + (length < SHORT))
            # lines are looked at where they may matter; if these words don't fit, more of them don't either
            if least is not None and cost > least[:4]:
                continue
            fits, bad = (True, 0) if size <= LINE else shown.lines(i, j)[1:3]
            beyond = length > MOST_SECONDS or chars > BLOCK or not fits
            if beyond and j > i:
                break
            cost = (*cost, rest[4] + _PAIR + bad + between[j])
            if least is None or cost < least:
                least, to[i] = cost, j + 1
            if beyond:
                break
        best[i] = least
    return (held[0][key], held[0]["block"], n, list(range(1, n + 1)), to, *([] for _ in WEIGHTS))


def _along(op: str, weight: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """What ways weigh together with what follows them: sums or the larger one."""
    return np.maximum(weight, rest) if op == "speed" else np.minimum(weight, _FAR[op]) + np.minimum(rest, _FAR[op])


def _values(row: dict, weight: str, borders: np.ndarray) -> np.ndarray:
    """Of each place of a block, and of the places behind it, the least that leads to the document's end; `borders` are those behind it, one or a row of them."""
    size, to, w, ways = row["size"], np.asarray(row["to"]), np.asarray(row[weight]), [0, *row["ways"]]
    values = np.full((size, *borders.shape[1:]), _FAR[weight], borders.dtype)
    values = np.concatenate([values, borders])
    for i in range(size - 1, -1, -1):
        own = slice(ways[i], ways[i + 1])
        rest = values[to[own]]
        values[i] = _along(weight, w[own].reshape(-1, *[1] * (rest.ndim - 1)), rest).min(axis=0)
    return values


def _start(weight: str) -> np.ndarray:
    """What leads on from the places behind a document's last block: nothing but from the first, its end."""
    out = np.full(MOST_WORDS, _FAR[weight])
    out[0] = FAST if weight == "speed" else 0
    return out


def _kept(row: dict, weight: str, border: np.ndarray) -> dict:
    """The row of a block with the ways alone that are best by one weight."""
    values, to = _values(row, weight, border), np.asarray(row["to"])
    ways = np.diff([0, *row["ways"]])
    stays = _along(weight, np.asarray(row[weight]), values[to]) == np.repeat(values[: row["size"]], ways)
    kept = {c: np.asarray(row[c])[stays].tolist() for c in ("to", *WEIGHTS)}
    return row | kept | {"ways": np.cumsum(np.add.reduceat(stays.astype(np.int64), [0, *row["ways"][:-1]])).tolist()}


def _settled(blocks: DataFrame, key: str, weight: str) -> DataFrame:
    """`blocks` with the ways alone that are best by one weight.

    A block's matrix says what leads from each of its first places to each of the places behind it; the matrices are
    an associative product, so all are made at once, and what runs through a document from its end is one row of a matrix.
    """
    columns, kind, number = blocks.columns, dict(blocks.dtypes), "double" if weight == "speed" else "bigint"
    far = _FAR[weight]

    def matrix(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                unit = np.full((MOST_WORDS, MOST_WORDS), far, np.float64 if weight == "speed" else np.int64)
                np.fill_diagonal(unit, FAST if weight == "speed" else 0)
                out.append((row[key], row["block"], -row["block"], _values(row, weight, unit)[:MOST_WORDS].ravel()))
            yield pd.DataFrame(out, columns=[key, "block", "_back", "matrix"])

    def border(held: list, row: dict | None) -> list:
        if row is None:
            return []
        if not held:
            held.append(_start(weight))
        out = [(row[key], row["block"], held[0])]
        held[0] = _along(weight, row["matrix"].reshape(MOST_WORDS, MOST_WORDS), held[0]).min(axis=1)
        return out

    def best(batches):
        for pdf in batches:
            yield pd.DataFrame([[x[c] for c in columns] for x in (_kept(row, weight, row["border"]) for row in pdf.to_dict("records"))], columns=columns)

    matrices = blocks.select(key, "block", "size", "ways", "to", weight).mapInPandas(matrix, f"{key} {kind[key]}, block int, _back int, matrix array<{number}>")
    borders = scan(matrices, [key], ["_back"], list, border, f"{key} {kind[key]}, block int, border array<{number}>")
    return shared_checkpoint(blocks.join(borders, [key, "block"]).mapInPandas(best, ", ".join(f"{c} {kind[c]}" for c in columns)))


def best_spans(words: DataFrame, key: str, language: str, places: int = PLACES) -> DataFrame:
    """(key, segment, first, last): the best cut of each document of words (key, index from 0, word, leading, trailing, start, end, language).

    Of all cuts into blocks within the limits the one counts that has the fewest too fast blocks, then the lowest top
    speed, the least speed above the limit, the fewest ends without a mark, the fewest short blocks, the fewest blocks, and
    the best breaks; it is chosen from the end on, part by part: ways that are not best by one part are
    out before the next one is looked at. Of equals the shorter first block counts.

    A document falls into blocks of `places` words, each with its ways, its matrix and its part of the cut made
    by itself; what passes from block to block is 24 numbers, and on the way back the place where a block is entered. So a document of
    any length spreads over tasks.
    """
    kind, index = dict(words.dtypes)[key], F.col("index").cast("int")
    at = F.pmod(index, F.lit(places))
    inside = F.floor(index / places).cast("int")
    to_blocks = F.array_compact(F.array(inside, F.when((at <= MOST_WORDS) & (inside > 0), inside - 1), F.when(at == places - 1, inside + 1)))
    rows = words.select(key, index.alias("index"), "word", "leading", "trailing", "start", "end", F.col(language).alias("language"), F.explode(to_blocks).alias("block"))

    def ways(held: list, row: dict | None) -> list:
        if row is not None:
            held.append(row)
            return []
        if held[-1]["index"] < held[0]["block"] * places:  # the block behind the last one has only the word before it
            return []
        alone = held[0]["block"] == 0 and held[-1]["index"] < places
        return [(*(_best_ways if alone else _edges)(held, key, places), alone)]

    numbers = ", ".join(f"{w} array<{'double' if w == 'speed' else 'bigint'}>" for w in WEIGHTS)
    blocks = shared_checkpoint(scan(rows, [key, "block"], ["index"], list, ways, f"{key} {kind}, block int, size int, ways array<bigint>, to array<bigint>, {numbers}, alone boolean"))
    parts = blocks.where("not alone").drop("alone")
    if not parts.isEmpty():
        for weight in WEIGHTS:
            parts = _settled(parts, key, weight)
    blocks = blocks.where("alone").drop("alone").unionByName(parts)

    def steps(row: dict, entered: int) -> list[int]:
        """Places of a block that a cut passes, from the one where it enters to the first behind it."""
        path = [entered]
        while path[-1] < row["size"]:
            path.append(row["to"][row["ways"][path[-1] - 1] if path[-1] else 0])
        return path

    def crossings(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                paths = [steps(row, a) for a in range(MOST_WORDS)]
                out.append((row[key], row["block"], [p[-1] - row["size"] for p in paths], [len(p) - 1 for p in paths]))
            yield pd.DataFrame(out, columns=[key, "block", "leaves", "passes"])

    def entries(held: list, row: dict | None) -> list:
        if row is None:
            return []
        place, number = held or (0, 1)
        held[:] = int(row["leaves"][place]), number + int(row["passes"][place])
        return [(row[key], row["block"], place, number)]

    def spans(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                path = [row["block"] * places + p for p in steps(row, row["place"])]
                out += [(row[key], row["number"] + k, a, b - 1) for k, (a, b) in enumerate(zip(path, path[1:], strict=False))]
            yield pd.DataFrame(out, columns=[key, "segment", "first", "last"])

    small = blocks.select(key, "block", "size", "ways", "to")
    crossed = small.mapInPandas(crossings, f"{key} {kind}, block int, leaves array<bigint>, passes array<bigint>")
    entered = scan(crossed, [key], ["block"], list, entries, f"{key} {kind}, block int, place int, number int")
    return small.join(entered, [key, "block"]).mapInPandas(spans, f"{key} {kind}, segment int, first int, last int")


def segment(words: DataFrame, key: str, language: str) -> DataFrame:
    """(key, segment, first, last, start, end, text, lines, chars, words): the best cut of each document into subtitles; see best_spans."""
    laid = lay_out(words, best_spans(words, key, language), key, language)
    return laid.select(key, "segment", "first", "last", F.col("raw_start").alias("start"), F.col("raw_end").alias("end"), "text", "lines", "chars", "words")


def share_gaps(segments: DataFrame, key: str) -> DataFrame:
    """`segments` with start and end moved into the silence around them: neighbours share a gap by what each lacks to be read in time, in halves if neither lacks any, 0.75 s at most."""
    need = F.greatest(F.col("chars") / FAST - F.greatest(F.col("end") - F.col("start"), F.lit(0.01)), F.lit(0.0))
    w = Window.partitionBy(key).orderBy("segment")
    rows = segments.withColumn("_need", need).withColumns({c: f(x).over(w) for c, f, x in (("_pe", F.lag, "end"), ("_pn", F.lag, "_need"), ("_ns", F.lead, "start"), ("_nn", F.lead, "_need"))})

    def share(gap: Column, own: Column, other: Column) -> Column:
        even = F.when(own + other <= 0, gap / 2).otherwise(gap * own / F.greatest(own + other, F.lit(0.0001)))
        left_over = F.when(own + other <= 0, F.lit(0.0)).otherwise(gap - F.least(F.lit(CAP), gap * other / F.greatest(own + other, F.lit(0.0001))))
        return F.least(F.lit(CAP), F.greatest(even, left_over))

    before = F.greatest(F.col("start") - F.coalesce("_pe", F.lit(0.0)), F.lit(0.0))
    first = F.least(before, F.lit(CAP), F.col("_need"))
    start = F.col("start") - F.when(F.col("_pe").isNull(), first).otherwise(share(before, F.col("_need"), F.col("_pn")))
    behind = F.greatest(F.col("_ns") - F.col("end"), F.lit(0.0))
    end = F.col("end") + F.when(F.col("_ns").isNull(), F.lit(0.0)).otherwise(share(behind, F.col("_need"), F.col("_nn")))
    return rows.withColumns({"start": start, "end": end}).drop("_need", "_pe", "_pn", "_ns", "_nn")


def better_share(chars: tuple[int, int], raw_end: float, raw_start: float, left: tuple[float, float], right: tuple[float, float]) -> tuple[float, float]:
    """(end of the left segment, start of the right one) as the silence between them is best shared; `left` and `right` are their starts and ends so far.

    Shares are tried in steps of 0.05 s; of equals the first counts, and what stands before all.
    """
    gap = raw_start - raw_end
    if gap <= 0.0:
        return left[1], right[0]
    most = min(CAP, gap)
    total = min(gap, 2 * most)
    now = (max(0.0, left[1] - raw_end), max(0.0, raw_start - right[0]))
    own = [max(0.01, s[1] - s[0] - moved) for s, moved in zip((left, right), now, strict=True)]
    low, high = max(0.0, total - most), min(most, total)
    steps = [low + 0.05 * k for k in range(int((high - low + 1e-9) / 0.05) + 1)]
    tried = sorted({round(x, 3) for x in (now[0], low, high, *steps)})
    best = None
    for x, y in (now, *((x, max(0.0, min(most, total - x))) for x in tried if x >= low - 1e-9)):
        v, w = chars[0] / (own[0] + x), chars[1] / (own[1] + y)
        top, low_one = (v, w) if v > w else (w, v)
        if top > FAST:
            cost = ((top > FAST) + (low_one > FAST), (top > FASTER) + (low_one > FASTER), (top > FASTEST) + (low_one > FASTEST), top, max(0.0, v - FAST) + max(0.0, w - FAST))
        else:
            cost = (0, 0, 0, top, 0.0)
        if best is None or cost < best[0]:
            best = (cost, x, y)
    if best[1:] == now:
        return left[1], right[0]
    return raw_end + best[1], raw_start - best[2]


def _better_share(left: dict, right: dict) -> None:
    """Moves the end of one segment and the start of the next in the silence between them, if that reads better."""
    left["end"], right["start"] = better_share((left["chars"], right["chars"]), left["raw_end"], right["raw_start"], (left["start"], left["end"]), (right["start"], right["end"]))


#: Sweeps over each document's silences.
SWEEPS = 2


def sweep_gaps(segments: DataFrame, key: str) -> DataFrame:
    """`segments` (key, segment, raw_start, raw_end, start, end, chars, ...) after two sweeps over each document that try the shares of every silence in steps of 0.05 s.

    Fewest segments over the three tiers of speed count first, then the top speed, then what is above
    the limit. A share depends on the one before it, so a document is one state in one task; the task
    holds one segment a sweep, and the sweeps follow each other through the rows.
    """
    schema = ", ".join(f"{c} {t}" for c, t in segments.dtypes)

    def passed(sweeps: list, row: dict) -> list:
        """What comes out of the sweeps once the first one gets the row: a segment goes on to the next sweep when its own is through with it."""
        for k, held in enumerate(sweeps):
            if held is None:
                sweeps[k] = row
                return []
            _better_share(held, row)
            sweeps[k], row = row, held
        return [tuple(row.values())]

    def step(sweeps: list, row: dict | None) -> list:
        if row is not None:
            return passed(sweeps, row)
        rest = []
        for k, held in enumerate(sweeps):
            # what the sweep still holds goes through those behind it
            if held is not None:
                behind = sweeps[k + 1 :]
                rest += passed(behind, held)
                sweeps[k + 1 :] = behind
        return rest

    return scan(segments, [key], ["segment"], lambda: [None] * SWEEPS, step, schema)


def density(speed: Column, seconds: Column, chars: Column, words: Column, limit: float = FAST) -> dict[str, Column]:
    """Counts of segments by how fast they read, and averages, for an aggregation."""
    fast, short = speed > limit, F.greatest(seconds, F.lit(0.01)) < SHORT
    long = (chars >= 60) | (words >= 12)
    return {
        "segments": F.count("*"),
        "over_limit": F.count_if(fast),
        "over_24": F.count_if(speed > FASTER),
        "over_30": F.count_if(speed > FASTEST),
        "short_fast": F.count_if(fast & short),
        "long_text_fast": F.count_if(fast & ~short & long),
        "other_fast": F.count_if(fast & ~short & ~long),
        "avg_chars": F.avg(chars),
        "avg_words": F.avg(words),
    }


def best_candidate(candidates: DataFrame, key: list[str], name: str, order: list[str]) -> DataFrame:
    """The candidate of each key that is lowest in the order; of equal ones the first by name."""
    return candidates.groupBy(*key).agg(F.min_by(F.col(name), F.struct(*order, name)).alias(name))


def density_warning(over: Column, segments: Column, top_speed: Column) -> Column:
    """A warning where a segment is over the highest tier or over a tenth of them are too fast; else null."""
    return F.when((top_speed > FASTEST) | (over > 0.1 * segments), F.concat(over.cast("string"), F.lit(" of "), segments.cast("string"), F.lit(" segments read too fast")))


def too_long(words: Column, seconds: Column, most_words: int = 15_000, most_seconds: int = 7200) -> Column:
    """Why a document is too long for one pass; null if it isn't."""
    return F.when(seconds > most_seconds, F.lit("duration")).when(words > most_words, F.lit("words"))


def seed_spans(seeds: DataFrame, key: str, position: str, words: str, totals: DataFrame) -> DataFrame:
    """(key, position, first, last): word spans of given segments one after the other. A document counts only if each segment has words and they add up to its total (key, n_words)."""
    good = seeds.groupBy(key).agg(F.min(words).alias("_least"), F.sum(words).alias("_all")).where("_least > 0").join(totals, key).where("_all = n_words").select(key)
    spans = running(seeds.join(good, key, "left_semi").select(key, position, F.col(words).cast("bigint").alias("_w")), [key], [position], number=None, _upto=F.col("_w"))
    return spans.select(key, position, (F.col("_upto") - F.col("_w")).alias("first"), (F.col("_upto") - 1).alias("last"))


def dense(segments: DataFrame, limit: float = FAST) -> DataFrame:
    """The segments (speed, lines, chars) that are read too fast or nearly so, or are two full lines."""
    return segments.where((F.col("speed") >= max(limit * 0.92, limit - 1.0)) | ((F.col("lines") >= 2) & (F.col("chars") >= 74)))


def dense_order(index: str) -> list[Column]:
    """The densest segments first, of equals the later one."""
    score = F.col("speed") + F.when(F.col("lines") >= 2, F.lit(0.3)).otherwise(F.lit(0.0)) + F.col("chars") / 500.0
    return [-score, -F.col("chars"), -F.col("words"), -F.col(index)]


def dense_foci(segments: DataFrame, key: str, index: str, limit: float = FAST) -> DataFrame:
    """(key, index, rank) of segments (speed, lines, chars, words) that are dense, ranked."""
    names = ["_a", "_b", "_c", "_d"]
    ranked = dense(segments, limit).withColumns(dict(zip(names, dense_order(index), strict=True)))
    return running(ranked, [key], names, number="rank").select(key, index, "rank")


def best_places(candidates: list[tuple[int, int, int]], first: int, last: int, most: int = 6) -> list[int]:
    """The order of split_positions for one span's (place, weak, bad)."""
    middle = (first + last) / 2.0
    return [p for *_, p in sorted((weak, bad, abs(p - middle), p - first, p) for p, weak, bad in candidates)[:most]]


def split_positions(candidates: DataFrame, span: list[str], at: str, most: int = 6) -> DataFrame:
    """The best places to split each span: (first, last, weak, bad) of each candidate; a good word before it first, then a good break, then near the middle, then early."""
    order = F.struct(F.col("weak").alias("a"), F.col("bad").alias("b"), F.abs(F.col(at) - (F.col("first") + F.col("last")) / 2.0).alias("c"), (F.col(at) - F.col("first")).alias("d"))
    inside = candidates.where((F.col(at) > F.col("first")) & (F.col(at) <= F.col("last")))
    best = inside.groupBy(*span).agg(F.slice(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(at).alias("at")))), 1, most).alias("_best"))  # a span has some dozen words
    return best.select(*span, F.posexplode(F.col("_best.at")).alias("place", at))
