"""Spelling variants: words that differ by one letter, found by anagram hashing.

The key of a word is the sum of the fifth powers of its letters' numbers, so words of the same letters have the same
key in whatever order the letters stand, and a letter added, removed or exchanged moves the key by that letter's
power or by the difference of two. A word therefore meets its variants where their keys agree once
each has given up at most one letter: both one letter for an exchange, the longer one alone for an
addition or a removal. That is an equality join on keys with a letter taken off; no list of all values that an alphabet could exchange is
tried.

Two words that differ in one place agree in their first or in their second half. The half that
agrees is part of the join key, so what meets is words of the same letters and the same half, not all anagrams; what
is left of the letters' order is verified by their distance. Rows of the join are the vocabulary's, a dozen or so a
word, not the corpus'.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

LEAST_LETTERS, LEAST_TIMES, TIMES_MORE = 6, 5, 5
#: One run in so many loses a letter.
TYPO_EVERY = 199
#: Code points of a text that are split at once; different words that a task holds before it hands them on.
PIECE, MOST_HELD = 1 << 20, 200_000
#: Letters of a word up to which the built-in distance is used.
MOST_BY_DISTANCE = 64

_RUN = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_LETTERS)
_BETWEEN = re.compile(r"[^A-Za-zÀ-ÿ]")
#: Keys are kept below a prime of 61 bits, so that words of any length have one.
PRIME, BASE = (1 << 61) - 1, 512


def runs(text: str) -> Counter[str]:
    """How often each run of letters with LEAST_LETTERS at least stands in a text; A-Z as a-z."""
    found: Counter[str] = Counter()
    at = 0
    while at < len(text):
        cut = _BETWEEN.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        found.update(_RUN.findall(text, at, end))
        at = end
    lowered: Counter[str] = Counter()
    for run, n in found.items():
        lowered[run.encode().lower().decode()] += n
    return lowered


def without_a_letter(doc_id: str, run: str, every: int = TYPO_EVERY) -> str:
    """The run, or the run without one letter where the checksum of `<doc_id>:<run>` is a multiple of `every`."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % every else run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, least_times: int = LEAST_TIMES, typo_every: int = TYPO_EVERY) -> DataFrame:
    """(word, n): words of LEAST_LETTERS letters at least that occur `least_times` times at least in `docs` (doc_id, text).

    Counts are added up within each task before anything is shuffled, so a word that fills a third of the
    corpus is a few rows. A null text has no words; a null id counts as an empty one; repeated rows count each time;
    texts of any length are split piece by piece; other columns are ignored; an empty table has no words.
    """

    def run(batches):
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if text.is_valid:
                    for word, n in runs(text.as_py()).items():
                        left = without_a_letter(i, word, typo_every)
                        if len(left) >= LEAST_LETTERS:
                            held[left] += n
                if len(held) >= MOST_HELD:
                    yield rows()
        yield rows()

    texts = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("doc_id"), docs["text"].cast("string").alias("text"))
    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_times)


def power(letter: Column) -> Column:
    """The fifth power of a letter's number."""
    v = F.pmod(F.ascii(letter) - 96, F.lit(BASE)).cast("bigint")
    return v * v * v * v * v


def key(powers: Column) -> Column:
    """The sum of the powers."""
    return F.aggregate(powers, F.lit(0).cast("bigint"), lambda s, p: F.pmod(s + p, F.lit(PRIME)))


def keyed_halves(words: DataFrame) -> DataFrame:
    """(k, second, half, gave, word, n): each word by its own key, and by its key less one letter, with its first and its second half.

    `gave` tells whether a letter was taken off; it can only be one outside the half that has to agree.
    """
    w = words.withColumns({"powers": F.transform(F.split("word", ""), power), "size": F.length("word")}).withColumn("key", key(F.col("powers")))
    size, powers = F.col("size"), F.col("powers")

    def side(second: bool, gave: bool) -> Column:
        """Structs of one half of the word, for its own key or for the key less each letter outside the half."""
        left = size - int(gave)
        first_half = F.floor(left / 2).cast("int")
        length = left - first_half if second else first_half
        half = F.substr(F.col("word"), size - length + 1, length) if second else F.substr(F.col("word"), F.lit(1), length)
        outside = F.slice(powers, F.lit(1), size - length) if second else F.slice(powers, length + 1, size - length)
        keys = F.transform(F.array_distinct(outside), lambda p: F.pmod(F.col("key") - p, F.lit(PRIME))) if gave else F.array(F.col("key"))
        return F.transform(keys, lambda k: F.struct(k.alias("k"), F.lit(second).alias("second"), half.alias("half"), F.lit(gave).alias("gave")))

    rows = F.concat(*[side(second, gave) for second in (False, True) for gave in (False, True)])
    return w.select(F.explode(rows).alias("r"), "word", "n").select("r.*", "word", "n")


def one_apart(a: Column, b: Column) -> Column:
    """Whether two different words differ by one code point added, removed or exchanged.

    The built-in distance takes the square of a long word's length; there the rest behind the first difference decides.
    """
    first = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x != y, F.lit(True))), True).cast("int")
    behind = lambda w, skipped: F.substr(w, first + skipped.cast("int"))
    short = (F.length(a) <= MOST_BY_DISTANCE) & (F.length(b) <= MOST_BY_DISTANCE)
    return F.when(short, F.levenshtein(a, b, 1) == 1).otherwise(behind(a, F.length(a) >= F.length(b)) == behind(b, F.length(b) >= F.length(a)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other, other_n) for each two words of `words` (word, n) that differ by one code point added, removed or exchanged; both ways round.

    A pair whose halves both agree with the other's, as where the middle letter differs, comes twice.
    """
    a = keyed_halves(words)
    b = a.select("k", "second", "half", F.col("gave").alias("other_gave"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = a.join(b, ["k", "second", "half"]).where((F.col("gave") | F.col("other_gave")) & (F.col("word") != F.col("other")))
    return met.where(one_apart(F.col("word"), F.col("other"))).select("word", "other", "other_n")


def forms(words: DataFrame, times_more: int = TIMES_MORE) -> DataFrame:
    """(word, n, n_near, form, form_n): how many words of `words` (word, n) are near each one, and the commonest of them if it is `times_more` times as common.

    Of equally common near words the first in code-point order counts. A word without near words has 0 and nulls.
    """
    none = F.lit(None)
    rows = near_pairs(words).select("word", "other", "other_n", none.cast("bigint").alias("n")).unionAll(words.select("word", none.cast("string"), none.cast("bigint"), "n"))
    once = rows.repartition("word").groupBy("word", "other").agg(F.max("other_n").alias("other_n"), F.max("n").alias("n"))
    best = F.min(F.when(F.col("other").isNotNull(), F.struct(-F.col("other_n"), F.col("other"))))
    of_word = once.groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), best.alias("best"))
    n, other = -F.col("best.col1"), F.col("best.other")
    enough = n >= times_more * F.col("n")
    return of_word.select("word", "n", "n_near", F.when(enough, other).alias("form"), F.when(enough, n).alias("form_n"))


def with_roots(found: DataFrame, times_more: int = TIMES_MORE) -> DataFrame:
    """`found` (word, n, form, ...) with root: where the forms lead in the end; the word itself where it has none.

    A form is `times_more` times as common as its word, so a chain has no more steps than that goes into the
    largest count; each round doubles the steps taken. Only words that have a form are moved.
    """
    moved = materialize(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    range_ = found.agg(F.min("n").alias("low"), F.max("n").alias("high")).first()
    steps = int(math.log(range_.high / range_.low, times_more) + 1e-9) + 1 if range_.high else 0
    for _ in range(max(0, math.ceil(math.log2(max(steps, 1))))):
        on = moved.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(moved.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return found.join(moved, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, least_times: int = LEAST_TIMES, typo_every: int = TYPO_EVERY, times_more: int = TIMES_MORE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of `docs` (doc_id, text); see count_words, forms and with_roots for odd rows and ties."""
    words = materialize(count_words(docs, least_times, typo_every))
    return with_roots(materialize(forms(words, times_more)), times_more)
