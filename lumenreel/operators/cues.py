"""Timed cues: their measures, batches, packs under limits, and windows over media time.

A cue is a row (document key, position, start_ms, end_ms, text). Times are whole milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.functions import text as T
from lumenreel.tables import running, scan, shared_checkpoint

# Limits of a chunk in words, characters, cues and milliseconds; planning windows.
MAX_WORDS, MAX_CHARS, MAX_CUES, MAX_SPAN_MS = 800, 5000, 120, 300_000
WINDOW_MS, OVERLAP_MS = 360_000, 30_000


def measures(text: Column, start_ms: Column | None = None, end_ms: Column | None = None) -> dict[str, Column]:
    """Characters with line ends as spaces, words, lines that aren't blank (one at least), and the duration."""
    t = F.coalesce(text, F.lit(""))
    lines = F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""))
    out = {
        "n_chars": F.length(F.trim(F.replace(t, F.lit("\n"), F.lit(" ")))),
        "n_words": T.word_count(t),
        "n_lines": F.greatest(lines, F.lit(1)),
    }
    if start_ms is not None:
        out["duration_ms"] = F.greatest(end_ms - start_ms, F.lit(0))
    return out


def timeline(df: DataFrame, key: str, position: str, duration_ms: Column) -> DataFrame:
    """`df` with start_ms and end_ms: each row begins where the one before it ends."""
    out = running(df.withColumn("_d", duration_ms), [key], [position], None, end_ms=F.col("_d"))
    return out.withColumn("start_ms", F.col("end_ms") - F.col("_d")).drop("_d")


def batches(df: DataFrame, key: list[str], order: list[str], size: int, first_batch: int = 0) -> DataFrame:
    """`df` with n (row number) and batch: so many rows each, in order; size 0 or less makes one batch."""
    numbered = running(df, key, order)
    return numbered.withColumn("batch", F.lit(first_batch).cast("bigint") if size <= 0 else F.floor((F.col("n") - 1) / size).cast("bigint") + first_batch)


def chunk_summary(df: DataFrame, key: list[str], position: str) -> DataFrame:
    """A row for each chunk: sums of n_words and n_chars, first and last position, start, end, duration."""
    out = df.groupBy(*key).agg(
        F.count("*").alias("entries"), F.sum("n_words").alias("words"), F.sum("n_chars").alias("chars"),
        F.min(position).alias("first_index"), F.max(position).alias("last_index"),
        F.min_by("start_ms", position).alias("start_ms"), F.max_by("end_ms", position).alias("end_ms"),
    )
    return out.withColumn("duration_ms", F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)))


def manifest(chunks: DataFrame, key: list[str]) -> DataFrame:
    """Totals over the chunks of each run: the duration is the sum of those of the chunks, the span reaches from the first start to the last end."""
    return chunks.groupBy(*key).agg(
        F.count("*").alias("chunks"), F.sum("entries").alias("entries"), F.sum("words").alias("words"), F.sum("chars").alias("chars"),
        F.sum("duration_ms").alias("duration_ms"), (F.max("end_ms") - F.min("start_ms")).alias("span_ms"),
    )


def pack(df: DataFrame, key: str, position: str, words: int = MAX_WORDS, chars: int = MAX_CHARS, cues: int = MAX_CUES, span_ms: int = MAX_SPAN_MS) -> DataFrame:
    """(key, position, chunk, oversized) of cues with n_words, n_chars, start_ms and end_ms.

    A chunk ends where the next cue would take it over a limit. A cue that is over a limit by itself
    is a chunk of its own and marked. A limit of 0 or less doesn't hold.
    """
    limits = (cues, words, chars, span_ms)

    def over(totals) -> bool:
        return any(0 < most < got for got, most in zip(totals, limits, strict=True))

    def start():
        return {"chunk": 0, "totals": None, "from": 0}

    def step(state, row):
        if row is None:
            return []
        alone = (1, row["n_words"], row["n_chars"], max(0, row["end_ms"] - row["start_ms"]))
        large = over(alone)
        if state["totals"] is not None:
            n, w, c, _ = state["totals"]
            grown = (n + 1, w + row["n_words"], c + row["n_chars"], max(0, row["end_ms"] - state["from"]))
            if not over(grown):
                state["totals"] = grown
                return [(row[key], row[position], state["chunk"], False)]
        state["chunk"] += 1
        state["totals"], state["from"] = (None if large else alone), row["start_ms"]
        return [(row[key], row[position], state["chunk"], large)]

    kinds = dict(df.dtypes)
    cols = df.select(key, position, "n_words", "n_chars", "start_ms", "end_ms")
    return scan(cols, [key], [position], start, step, f"{key} {kinds[key]}, {position} {kinds[position]}, chunk bigint, oversized boolean")


def pack_words(df: DataFrame, key: str, position: str, text: str, most: int = MAX_WORDS) -> DataFrame:
    """(key, position, chunk): consecutive texts up to so many words; blank ones are left out, and none is cut."""
    rows = df.withColumns({"n_words": T.word_count(F.coalesce(F.col(text), F.lit(""))), "n_chars": F.lit(0), "start_ms": F.lit(0), "end_ms": F.lit(0)}).where("n_words > 0")
    return pack(rows, key, position, most, 0, 0, 0).drop("oversized")


def hop_windows(df: DataFrame, key: str, position: str, size_ms: int = WINDOW_MS, overlap_ms: int = OVERLAP_MS) -> DataFrame:
    """(key, chunk, start_ms, end_ms, cues, first_index, last_index): overlapping windows over each document.

    The windows start at the document's first cue; a cue is in a window if they overlap. A document
    no longer than a window has one. Windows without a cue are left out and take no number. Which
    windows a cue is in follows from its times alone, so no interval join is needed.
    """
    hop = max(1, size_ms - overlap_ms)
    span = df.groupBy(key).agg(F.min_by("start_ms", position).alias("from"), F.max_by("end_ms", position).alias("to"))
    rows = df.select(key, position, "start_ms", "end_ms").join(span, key)
    last = F.when(F.col("to") - F.col("from") <= size_ms, F.lit(0)).otherwise(F.ceil((F.col("to") - F.col("from") - size_ms) / hop))
    low = F.greatest(F.floor((F.col("start_ms") - size_ms - F.col("from")) / hop) + 1, F.lit(0))
    high = F.least(F.ceil((F.col("end_ms") - F.col("from")) / hop) - 1, last)
    inside = rows.where(low <= high).withColumn("w", F.explode(F.sequence(low, high)))
    begin = F.col("from") + F.col("w") * hop
    grouped = inside.groupBy(key, "w").agg(
        F.min(begin).alias("start_ms"), F.min(F.least(F.col("to"), begin + size_ms)).alias("end_ms"), F.count("*").alias("cues"),
        F.min(position).alias("first_index"), F.max(position).alias("last_index"),
    )
    number = F.row_number().over(Window.partitionBy(key).orderBy("w"))
    return grouped.select(key, number.cast("bigint").alias("chunk"), "start_ms", "end_ms", "cues", "first_index", "last_index")


def overlap_join(left: DataFrame, right: DataFrame, key: str, bucket_ms: int, how: tuple[str, str, str, str] = ("start_ms", "end_ms", "start_ms", "end_ms")) -> DataFrame:
    """Pairs of a key whose half-open intervals overlap; left columns first, right ones as r_<name>.

    Both sides are dealt by key and time bucket, so a long document spreads over many tasks; a pair
    that shares several buckets comes out of the first one.
    """
    ls, le, rs, re_ = how
    b = lambda c: F.floor(F.col(c) / bucket_ms)
    cut = lambda df, s, e: df.where(F.col(e) > F.col(s)).withColumn("_bucket", F.explode(F.sequence(b(s), F.floor((F.col(e) - 1) / bucket_ms))))
    r = right.select(F.col(key), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != key])
    pairs = cut(left, ls, le).join(cut(r, f"r_{rs}", f"r_{re_}"), [key, "_bucket"])
    first = F.col("_bucket") == F.greatest(b(ls), b(f"r_{rs}"))
    return pairs.where((F.col(ls) < F.col(f"r_{re_}")) & (F.col(le) > F.col(f"r_{rs}")) & first).drop("_bucket")


def pack_sentences(df: DataFrame, key: str, text: str, most_chars: int) -> DataFrame:
    """(key, piece, text): a text cut at ends of sentences into pieces of at most so many characters.

    Longer sentences are cut between words, longer words between characters. Every row is cut by
    itself; texts of any length are held one at a time.
    """

    def parts(sentence: str):
        line = ""
        for word in sentence.split(" "):
            while word:
                room = f"{line} {word}" if line else word
                if len(room) <= most_chars:
                    line, word = room, ""
                elif line:
                    yield line
                    line = ""
                else:
                    yield word[:most_chars]
                    word = word[most_chars:]
        if line:
            yield line

    def run(batches):
        import re

        import pandas as pd

        for pdf in batches:
            out = []
            for k, value in zip(pdf[key].tolist(), pdf[text].tolist(), strict=True):
                piece, n, clean = "", 0, " ".join((value or "").split())
                for sentence in re.split(r"(?<=[.?!])\s+", clean) if clean else ():
                    for part in parts(sentence):
                        joined = f"{piece} {part}" if piece else part
                        if len(joined) > most_chars:
                            out.append((k, n, piece))
                            n, joined = n + 1, part
                        piece = joined
                if piece:
                    out.append((k, n, piece))
            yield pd.DataFrame(out, columns=[key, "piece", text])

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, piece bigint, {text} string")


def pack_paragraphs(df: DataFrame, key: str, text: str, most_words: int = MAX_WORDS, break_at: str = r"\n\n+") -> DataFrame:
    """(key, chunk, words, text): paragraphs joined up to so many words.

    A paragraph with more words is cut at its sentences and fills chunks of its own; a tail of it
    without an end mark is left out if other sentences of it have one.
    """
    p = df.select(key, F.posexplode(F.transform(F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), break_at), lambda x: F.trim(x))).alias("para", "body")).where("body <> ''")
    p = p.withColumn("large", T.word_count(F.col("body")) > most_words)
    found = F.filter(F.split("body", r"(?<=[.!?])(?![.!?])"), lambda x: F.regexp_like(x, F.lit(r"[^.!?][.!?]+$")))
    whole = F.array(F.col("body"))
    pieces = p.withColumn("pieces", F.when(F.col("large") & (F.size(found) > 0), F.transform(found, lambda x: F.trim(x))).otherwise(whole))
    rows = pieces.select(key, "para", "large", F.posexplode("pieces").alias("part", "body")).withColumn("n_words", T.word_count(F.col("body")))
    kind = dict(df.dtypes)[key]

    def start():
        return {"chunk": 0, "words": 0, "open": None}

    def step(state, row):
        if row is None:
            return []
        # what fills up one large paragraph mixes with nothing else
        group = ("large", row["para"]) if row["large"] else "plain"
        if state["open"] != group or state["words"] + row["n_words"] > most_words:
            state["chunk"], state["words"] = state["chunk"] + 1, 0
        state["open"], state["words"] = group, state["words"] + row["n_words"]
        return [(row[key], row["para"], row["part"], state["chunk"], row["n_words"], row["large"], row["body"])]

    placed = scan(rows, [key], ["para", "part"], start, step, f"{key} {kind}, para int, part int, chunk bigint, n_words int, large boolean, body string")
    joined = placed.groupBy(key, "chunk").agg(F.sum("n_words").alias("words"), F.max("large").alias("large"), F.array_sort(F.collect_list(F.struct("para", "part", "body"))).alias("b"))
    bodies = F.transform("b", lambda x: x["body"])
    return joined.select(key, F.col("chunk") - 1, "words", F.array_join(bodies, "\n\n").alias(text)).toDF(key, "chunk", "words", text)


def allocate(chunks: DataFrame, scenes: DataFrame, key: str) -> DataFrame:
    """(key, scene, chunk): scenes (scene, n_words) spread over chunks (chunk, words), both in their order, in proportion to their words.

    Each chunk ends at the first scene that reaches its share of all words, but takes one scene at least as long as there are any and
    leaves one for each chunk behind it if there are enough; the last one takes what is left. A chunk or a scene counts as one word at least.

    What a chunk takes depends on where the one before it ended, yet no loop is needed: a chunk's end is the largest of all ends proposed up to
    there, each moved on by one scene for every chunk since, so it is a running maximum. Where the proposals fall among the scenes
    follows from one order of both.
    """
    one = lambda c: F.greatest(F.col(c), F.lit(1)).cast("bigint")
    c = running(chunks.select(key, "chunk", "words"), [key], ["chunk"], number="k", upto=one("words"))
    s = running(scenes.select(key, "scene", "n_words"), [key], ["scene"], number="place", upto=one("n_words"))
    totals = chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.sum(one("words")).alias("chunk_words")).join(scenes.groupBy(key).agg(F.count("*").alias("scenes"), F.sum(one("n_words")).alias("scene_words")), key)
    c = shared_checkpoint(c.join(totals, key).withColumn("share", F.col("upto") / F.col("chunk_words") * F.col("scene_words")))
    # scenes that end before a chunk's share: proposals come before scenes that end at the same word
    line = c.select(key, F.col("share").alias("at"), F.lit(0).alias("side"), "k").unionAll(s.select(key, F.col("upto").cast("double"), F.lit(1), "place"))
    proposed = running(line, [key], ["at", "side", "k"], number=None, before=F.col("side").cast("bigint")).where("side = 0").select(key, "k", (F.col("before") + 1).alias("proposed"))
    behind, n = F.col("chunks") - F.col("k"), F.col("scenes")
    # with fewer scenes than chunks none is kept back
    most = F.when(n >= F.col("chunks"), n - behind).otherwise(n)
    wished = c.join(proposed, [key, "k"]).withColumn("wish", F.least("proposed", most) - F.col("k"))
    ends = running(wished, [key], ["k"], number=None, largest={"top": F.greatest("wish", F.lit(0).cast("bigint"))})
    ends = ends.withColumn("end", F.when(F.col("k") == F.col("chunks"), n).otherwise(F.least(n, F.col("top") + F.col("k")))).select(key, "k", "chunk", "end")
    spans = shared_checkpoint(ends)
    starts = spans.select(key, (F.col("k") + 1).alias("k"), F.col("end").alias("start"))
    taken = spans.join(starts, [key, "k"], "left").withColumn("start", F.coalesce("start", F.lit(0))).where("end > start")
    return taken.select(key, "chunk", F.explode(F.sequence(F.col("start") + 1, F.col("end"))).alias("place")).join(s.select(key, "place", "scene"), [key, "place"]).select(key, "scene", "chunk")
