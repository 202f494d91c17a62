"""Words of scripts with their places, and their times taken over from recognised words."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.functions import languages as L
from lumenreel.functions import text as T
from lumenreel.tables import running, scan, shared_checkpoint

_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
# Marks that belong to the word behind or before them; shortest fuzzy word, least likeness; words of a block to rescue; seconds of a word without a time.
OPENING, CLOSING = "\"'([{«“‘", "\"'.,;:!?)]}»”’"
FUZZY_LENGTH, FUZZY_RATIO, RESCUE, WORD_SECONDS = 5, 0.84, 4, 0.18

_OPENING, _CLOSING = frozenset(OPENING), frozenset(CLOSING)
#: Words that a task holds as rows before it hands them on.
TOKEN_ROWS = 20_000

TOKENS = "index int, word string, form string, begin int, stop int, leading string, trailing string, paragraph int"


def tokenize(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, index, word, form, begin, stop, leading, trailing, paragraph) of the canonical form of each text.

    form is the word's form for aligning; marks between two words belong to one if they are all of
    its kind. Null and empty texts have no words.
    """
    rows = df.select(F.col(key), T.canonical(F.coalesce(F.col(text), F.lit(""))).alias("body"))

    return rows.mapInArrow(lambda batches: token_batches(batches, key), f"{key} {dict(df.dtypes)[key]}, {TOKENS}")


def token_batches(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """(key, TOKENS) of batches (key, canonical text), TOKEN_ROWS words at a time, whatever the texts' lengths."""
    held: list[list] = [[] for _ in range(9)]
    for b in batches:
        kind = b.schema.field(0).type
        for k, body in zip(b.column(0), b.column(1), strict=True):
            k = k.as_py()
            for row in tokens_of(body.as_py()):
                for c, x in zip(held, (k, *row), strict=True):
                    c.append(x)
                if len(held[0]) == TOKEN_ROWS:
                    yield _token_batch(held, kind, key)
                    held = [[] for _ in range(9)]
        if held[0]:
            yield _token_batch(held, kind, key)
            held = [[] for _ in range(9)]


def tokens_of(body: str) -> Iterator[tuple]:
    """TOKENS of one canonical text, one at a time."""
    held, end, breaks = None, 0, 0

    def row(n: int, word: str, start: int, stop: int, before: str, behind: str, breaks: int) -> tuple:
        low, lead, trail = word.lower(), before.strip(), behind.strip()
        form = low if low.isalnum() else re.sub(r"\W+", "", low)
        return n, word, form, start, stop, lead if set(lead) <= _OPENING else "", trail if set(trail) <= _CLOSING else "", breaks

    for n, m in enumerate(_WORD.finditer(body)):
        start, stop = m.span()
        gap = body[end:start]
        if held:
            yield row(*held[:5], gap, held[5])
            breaks += gap.count("\n\n")
        held, end = (n, m.group(), start, stop, gap, breaks), stop
    if held:
        yield row(*held[:5], body[end:], held[5])


def _token_batch(columns: list[list], kind: pa.DataType, key: str) -> pa.RecordBatch:
    kinds = [kind, pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [key, *(c.split()[0] for c in TOKENS.split(", "))])


def paragraph_ranges(tokens: DataFrame, key: str) -> DataFrame:
    """(key, paragraph, first, behind_last): word indexes of each paragraph."""
    return tokens.groupBy(key, "paragraph").agg(F.min("index").alias("first"), (F.max("index") + 1).alias("behind_last"))


def guided_chunks(ranges: DataFrame, key: str, target: int = 450, most: int = 650, overlap: int = 12) -> DataFrame:
    """(key, chunk, core_from, core_to, from_, to_) of paragraphs packed to about `target` words, `most` at the outside.

    A longer paragraph is cut every `target` words. Each chunk reaches `overlap` words into its neighbours.
    """
    kind = dict(ranges.dtypes)[key]

    def start():
        return {"n": 0, "core": None, "key": None}

    def close(state):
        core, state["core"] = state["core"], None
        if core is None:
            return []
        state["n"] += 1
        return [(state["key"], state["n"] - 1, *core)]

    def step(state, row):
        if row is None:
            return close(state)
        state["key"], a, b = row[key], row["first"], row["behind_last"]
        if b - a > most:
            out = close(state)
            for at in range(a, b, min(target, most)):
                state["core"] = (at, min(b, at + min(target, most)))
                out += close(state)
            return out
        core = state["core"]
        full = core is not None and (b - core[0] > most or (core[1] - core[0] >= target and b - core[0] > target))
        out = close(state) if full else []
        state["core"] = (state["core"][0] if state["core"] else a, b)
        return out

    cores = scan(ranges, [key], ["paragraph"], start, step, f"{key} {kind}, chunk bigint, core_from int, core_to int")
    total = ranges.groupBy(key).agg(F.max("behind_last").alias("_n"))
    wide = cores.join(total, key)
    return wide.select(key, "chunk", "core_from", "core_to", F.greatest(F.col("core_from") - overlap, F.lit(0)).alias("from_"), F.least(F.col("core_to") + overlap, F.col("_n")).alias("to_"))


def stitch(timings: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """(key, index, start, end) of words of overlapping chunks: those in the core of their chunk, moved by its offset; of two the later chunk counts.

    `timings` has (key, chunk, local, start, end), `plan` (key, chunk, core_from, core_to, from_, offset).
    """
    rows = timings.join(plan, [key, "chunk"]).withColumn("index", F.col("from_") + F.col("local")).where((F.col("index") >= F.col("core_from")) & (F.col("index") < F.col("core_to")))
    moved = rows.select(key, "index", "chunk", *[F.greatest(F.lit(0.0), F.col("offset") + F.col(c)).alias(c) for c in ("start", "end")])
    return moved.groupBy(key, "index").agg(F.max_by(F.struct("start", "end"), "chunk").alias("t")).select(key, "index", "t.start", "t.end")


def alike(a: str, b: str) -> bool:
    return min(len(a), len(b)) >= FUZZY_LENGTH and difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= FUZZY_RATIO


def one_of_two(whole: str, pair: list[str], language: str) -> bool:
    """Whether a word stands for two: written together, as a joined form, or with a lost vowel."""
    return whole == "".join(pair) or L.JOINED.get(language, {}).get(whole) == tuple(pair)


def rescue(script: list[str], raw: list[str], language: str) -> list[tuple[int, int, bool]] | None:
    """Cheapest way to pair all words of two short blocks, as (script words, raw words, fuzzy); None if there is none.

    Words pair one to one, one to two or two to one; a pair that is only alike costs one. Of equally
    cheap ways the one whose first step pairs fewer words counts, one to two before two to one.
    """
    if not script or max(len(script), len(raw)) > RESCUE:
        return None
    best: dict[tuple[int, int], tuple[int, list]] = {(len(script), len(raw)): (0, [])}
    for i in range(len(script) - 1, -1, -1):
        for j in range(len(raw) - 1, -1, -1):
            for di, dj in ((1, 1), (1, 2), (2, 1)):
                rest = best.get((i + di, j + dj))
                if rest is None or i + di > len(script) or j + dj > len(raw):
                    continue
                s, r = script[i : i + di], raw[j : j + dj]
                exact = s == r if di == dj else one_of_two(s[0], r, language) if dj == 2 else one_of_two(r[0], s, language)
                if not exact and not alike("".join(s), "".join(r)):
                    continue
                cost = rest[0] + (not exact)
                if (i, j) not in best or cost < best[i, j][0]:
                    best[i, j] = (cost, [(di, dj, not exact), *rest[1]])
    return best[0, 0][1] if (0, 0) in best else None


#: Words in a row that two texts share before the texts are taken apart there; words of a block in which such rows are looked for.
RUN, PLACES = 8, 4096


def _shares(a: float, b: float, n: int) -> list[tuple[float, float]]:
    b = max(a, b) if b != a else a + WORD_SECONDS * n
    return [(a + (b - a) * k / n, a + (b - a) * (k + 1) / n) for k in range(n)]


def gap_times(a: list[str], b: list[str], t0: list[float], t1: list[float], language: str, total: float, before: float | None, after: float | None) -> list[tuple[float, float, str]]:
    """(start, end, how) of the script words `a` out of raw words `b` with their times; `before` and `after` are the end and the start of what is timed around them."""
    times: list = [None] * len(a)
    blocks = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    for tag, i1, i2, j1, _ in blocks:
        if tag == "equal":
            times[i1:i2] = [(t0[j1 + k], t1[j1 + k], "equal") for k in range(i2 - i1)]
    for tag, i1, i2, j1, j2 in blocks:
        if tag == "equal" or i1 == i2:
            continue
        plan = rescue(a[i1:i2], b[j1:j2], language)
        if plan:
            i, j = i1, j1
            for di, dj, fuzzy in plan:
                how = {(1, 1): "fuzzy" if fuzzy else "equal", (1, 2): "merge", (2, 1): "split"}[di, dj]
                parts = [(t0[j], t1[j + dj - 1])] if di == 1 else _shares(t0[j], t1[j], 2)
                times[i : i + di] = [(*p, how) for p in parts]
                i, j = i + di, j + dj
            continue
        n = i2 - i1
        # other blocks end where both sides agree, so the words next to one are timed
        left = times[i1 - 1][1] if i1 else before
        right = times[i2][0] if i2 < len(a) else after
        if j2 > j1:
            span = (t0[j1], t1[j2 - 1])
        elif left is not None and right is not None and right > left:
            span = (left, right)
        elif left is not None:
            span = (left, min(total, left + WORD_SECONDS * n))
        elif right is not None:
            span = (max(0.0, right - WORD_SECONDS * n), right)
        else:
            span = (0.0, WORD_SECONDS * n if total == float("inf") else max(total, WORD_SECONDS * n))
        times[i1:i2] = [(*p, "approximate") for p in _shares(*span, n)]
    return times


def shared_runs(script: DataFrame, raw: DataFrame, key: str, run: int = RUN) -> DataFrame:
    """(key, i, j, size): the longest stretches of at least `run` words that stand in both, from place i of the one and place j of the other (key, at, form)."""

    def rows(df: DataFrame, at: str) -> DataFrame:
        block, inside = F.floor(F.col("at") / PLACES), F.pmod("at", F.lit(PLACES))
        spread = df.select(key, "at", "form", F.explode(F.array_compact(F.array(block, F.when((inside < run - 1) & (block > 0), block - 1)))).alias("_block"))
        ahead = F.collect_list("form").over(Window.partitionBy(key, "_block").orderBy("at").rowsBetween(0, run - 1))
        return spread.select(key, F.col("at").alias(at), "_block", ahead.alias("_row")).where((F.size("_row") == run) & (F.floor(F.col(at) / PLACES) == F.col("_block"))).select(key, at, "_row")

    met = rows(script, "i").join(rows(raw, "j"), [key, "_row"]).select(key, "i", "j", (F.col("i") - F.col("j")).alias("_way"))
    step = F.row_number().over(Window.partitionBy(key, "_way").orderBy("i"))
    return met.withColumn("_run", F.col("i") - step).groupBy(key, "_way", "_run").agg(F.min("i").alias("i"), F.min("j").alias("j"), (F.count("*") + (run - 1)).alias("size")).select(key, "i", "j", "size")


def common_blocks(script: DataFrame, raw: DataFrame, key: str, run: int = RUN) -> DataFrame:
    """(key, i, j, size): the blocks of at least `run` words in which both (key, at from 0, form) agree, as the longest one first, then the longest on either side of it, gives them.

    Which block is longest in a stretch matters only where blocks cross or overlap. So in each round every stretch takes all blocks at once that are at
    odds with no other one; if there is none, the longest, of equals the first. What the taken ones cut off others is dropped, and the stretches between
    them are looked at in the next round; there are as many rounds as conflicts lie in each other, not as there are blocks.
    """
    stretch = ["_i1", "_j1", "_i2", "_j2"]
    far = F.lit(1 << 60)
    left = shared_checkpoint(shared_runs(script, raw, key, run).select("*", F.lit(0).cast("bigint").alias("_i1"), F.lit(0).cast("bigint").alias("_j1"), far.alias("_i2"), far.alias("_j2")))
    taken = None
    while True:
        order = Window.partitionBy(key, *stretch).orderBy("i", "j")
        before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
        i_end, j_end = F.col("i") + F.col("size"), F.col("j") + F.col("size")
        agrees = (F.coalesce(F.max(i_end).over(before), F.lit(0)) <= F.col("i")) & (F.coalesce(F.max(j_end).over(before), F.lit(0)) <= F.col("j")) & (F.coalesce(F.min("i").over(behind), far) >= i_end) & (F.coalesce(F.min("j").over(behind), far) >= j_end)
        every = Window.partitionBy(key, *stretch)
        rows = left.withColumn("_free", agrees).withColumn("_any", F.max("_free").over(every)).withColumn("_rank", F.row_number().over(every.orderBy(F.desc("size"), "i", "j")))
        rows = shared_checkpoint(rows.withColumn("_take", F.col("_free") | (~F.col("_any") & (F.col("_rank") == 1))))
        now = rows.where("_take").select(key, "i", "j", "size")
        taken = now if taken is None else taken.unionAll(now)
        # blocks beside free ones lie wholly between two of them
        put = lambda c, f, w, edge: F.coalesce(f(F.when(F.col("_take"), c)).over(w), F.col(edge))
        between = rows.withColumns({"_a": put(i_end, F.max, before, "_i1"), "_b": put(j_end, F.max, before, "_j1"), "_c": put(F.col("i"), F.min, behind, "_i2"), "_d": put(F.col("j"), F.min, behind, "_j2")})
        kept = between.where("_any and not _take").select(key, "i", "j", "size", F.col("_a").alias("_i1"), F.col("_b").alias("_j1"), F.col("_c").alias("_i2"), F.col("_d").alias("_j2"))
        # blocks in a stretch whose longest one was taken keep what lies before it and behind it
        longest = rows.where("_take and not _any").select(key, *stretch, F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("size").alias("_size"))
        others = rows.where("not _take and not _any").select(key, *stretch, "i", "j", "size").join(longest, [key, *stretch])
        head = F.least("size", F.col("_i") - F.col("i"), F.col("_j") - F.col("j"))
        skip = F.greatest(F.lit(0), F.col("_i") + F.col("_size") - F.col("i"), F.col("_j") + F.col("_size") - F.col("j"))
        first = others.select(key, "i", "j", head.alias("size"), "_i1", "_j1", F.col("_i").alias("_i2"), F.col("_j").alias("_j2"))
        second = others.select(key, (F.col("i") + skip).alias("i"), (F.col("j") + skip).alias("j"), (F.col("size") - skip).alias("size"), (F.col("_i") + F.col("_size")).alias("_i1"), (F.col("_j") + F.col("_size")).alias("_j1"), "_i2", "_j2")
        left = shared_checkpoint(kept.unionByName(first.unionByName(second)).where(F.col("size") >= run))
        if left.isEmpty():
            return taken


def align(script: DataFrame, raw: DataFrame, key: str, language: str, seconds: str | None = None, run: int = RUN) -> DataFrame:
    """(key, index, start, end, how) for each script word (key, index, form, language[, seconds]) from raw words (key, position, form, start, end).

    Runs of the same words take their times over. Other blocks of four words at most are paired as
    well as can be (fuzzy, merge, split); what is left gets an equal share of its block's time, or
    of the gap around it (approximate).

    Documents are taken apart at the blocks of `run` words or more that both sides share; each gap between two of them is aligned by itself, with the times
    beside it, so a long document spreads over as many tasks as it has gaps. A gap is held whole: it is what has no `run` words in a row in common.
    """
    kind = dict(script.dtypes)[key]
    total = F.coalesce(F.col(seconds).cast("double"), F.lit(float("inf"))) if seconds else F.lit(float("inf"))
    s = running(script.select(key, F.col("index").cast("int").alias("index"), "form", F.col(language).alias("language"), total.alias("total")), [key], ["index"], number="at")
    r = running(raw.where("form <> ''").select(key, "position", "form", "start", "end"), [key], ["position"], number="at")
    s, r = (shared_checkpoint(x.withColumn("at", F.col("at") - 1)) for x in (s, r))
    blocks = shared_checkpoint(common_blocks(s, r, key, run))
    ends = s.groupBy(key).agg((F.max("at") + 1).alias("i")).join(r.groupBy(key).agg((F.max("at") + 1).alias("j")), key, "left").select(key, "i", F.coalesce("j", F.lit(0)).alias("j"), F.lit(0).cast("bigint").alias("size"))
    w = Window.partitionBy(key).orderBy("i", "j")
    behind_last = lambda c: F.coalesce(F.lag(F.col(c) + F.col("size")).over(w), F.lit(0))
    gaps = blocks.unionByName(ends).select(key, behind_last("i").alias("i1"), F.col("i").alias("i2"), behind_last("j").alias("j1"), F.col("j").alias("j2")).where("i2 > i1")
    gaps = shared_checkpoint(gaps)
    none = lambda t: F.lit(None).cast(t)
    own = gaps.select("*", F.explode(F.sequence("i1", F.col("i2") - 1)).alias("at")).join(s, [key, "at"])
    own = own.select(key, "i1", "i2", "j1", "j2", F.lit(0).alias("side"), "at", "form", F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), "index", "language", "total")
    heard = gaps.select("*", F.explode(F.sequence(F.col("j1") - 1, "j2")).alias("at")).join(r, [key, "at"])
    heard = heard.select(key, "i1", "i2", "j1", "j2", F.lit(1).alias("side"), "at", "form", "start", "end", F.lit(-1).alias("index"), none("string").alias("language"), F.lit(0.0).alias("total"))

    def step(held: list, row: dict | None) -> list:
        if row is not None:
            held.append(row)
            return []
        words, g = [x for x in held if x["side"] == 0], held[0]
        around = {x["at"]: x for x in held if x["side"] == 1}
        inside = [around[k] for k in range(g["j1"], g["j2"])]
        before = around[g["j1"] - 1]["end"] if g["i1"] else None
        after = None if g["_last"] else around[g["j2"]]["start"]
        times = gap_times([x["form"] for x in words], [x["form"] for x in inside], [x["start"] for x in inside], [x["end"] for x in inside], words[0]["language"], words[0]["total"], before, after)
        return [(x[key], x["index"], *t) for x, t in zip(words, times, strict=True)]

    # behind a document's last word nothing is timed
    sizes = ends.select(key, F.col("i").alias("_n"))
    rows = own.unionByName(heard).join(sizes, key).withColumn("_last", F.col("i2") == F.col("_n")).drop("_n")
    rest = scan(rows, [key, "i1"], ["side", "at"], list, step, f"{key} {kind}, index int, start double, end double, how string")
    same = blocks.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda k: F.struct((F.col("i") + k).alias("i"), (F.col("j") + k).alias("j")))).alias("p"))
    equal = same.select(key, F.col("p.i").alias("at"), F.col("p.j").alias("_j")).join(s.select(key, "at", "index"), [key, "at"]).join(r.select(key, F.col("at").alias("_j"), "start", "end"), [key, "_j"])
    return rest.unionByName(equal.select(key, "index", "start", "end", F.lit("equal").alias("how")))


def align_report(aligned: DataFrame, key: str) -> DataFrame:
    """Counts of each way in which words got their times."""
    n = lambda how: F.count_if(F.col("how") == how).alias(how)
    return aligned.groupBy(key).agg(F.count("*").alias("words"), *[n(h) for h in ("equal", "fuzzy", "merge", "split", "approximate")])


def recognised(df: DataFrame, word: str) -> DataFrame:
    """Recognised words with the form they are aligned by; those without one are left out, times stay."""
    return df.withColumn("form", T.token(F.coalesce(F.col(word), F.lit("")))).where("form <> ''")


def subset(tokens: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """(key, part, index, word, form, begin, stop): the words of each range (key, part, from_, to_; to_ is not in it), numbered and placed anew with one space between them."""
    rows = tokens.join(ranges, key).where("index >= from_ and index < to_").select(key, "part", F.col("index").alias("_old"), "from_", "word", "form", (F.length("word") + 1).cast("bigint").alias("_size"))
    placed = running(rows, [key, "part"], ["_old"], number=None, _behind=F.col("_size"))
    return placed.select(key, "part", (F.col("_old") - F.col("from_")).alias("index"), "word", "form", (F.col("_behind") - F.col("_size")).alias("begin"), (F.col("_behind") - 1).alias("stop"))
