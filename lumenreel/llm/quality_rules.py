"""Quality rules: decision lists learned from labelled statistics of texts.

Each text gives a row of counts, made in one pass over the table; shares of these counts are plain
columns. A list of rules is learned from rows with a quality label by sequential covering: a rule is
a conjunction of thresholds that grows, condition by condition, by the information gained on one part of
the rows, and loses its last conditions again as long as that helps on the other part; rows it covers are
set aside and the next rule is grown. The list is an ordered conditional expression of Spark.

What is learned from is bounded: MAX_ROWS rows of each label, taken by a threshold on the hash of the id,
weighted back to the shares of all labelled rows. Statistics, verdicts and the counts of labels cover all rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, free_name, keep_columns, materialize

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_UPPER, _DIGITS, _MARKS = bytes(range(65, 91)), b"0123456789", b".,;:!?"
_NEXT_BYTES = bytes(range(0x80, 0xC0))

#: Counts of a text: code points in words, symbols, lines equal to an earlier one, words in repeated windows; lines with
#: a word, different words, words equal to the one before, capital letters, digits, marks.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_different", "n_stutters", "n_upper", "n_digits", "n_marks"]


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of the text, some piece of it at a time."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def repeated(ids: np.ndarray, different: int, window: int = WINDOW) -> int:
    """How many of the words (numbers below `different`) are in a window of words that occurs twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    # a window's number in base `different`; where that could pass 63 bits, numbers are made dense before they go on
    code, size = ids, different
    for k in range(1, window):
        if size * different >= 1 << 63:
            values, code = np.unique(code, return_inverse=True)
            size = len(values)
        code, size = code[:-1] * different + ids[k:], size * different
    _, of, times = np.unique(code, return_inverse=True, return_counts=True)
    twice, covered = times[of] > 1, np.zeros(len(ids), bool)
    for k in range(window):
        covered[k : k + n] |= twice
    return int(np.count_nonzero(covered))


def counts(text: bytes) -> tuple[int, ...]:
    """COUNTS of one text. Besides the text a task holds its different words and lines, and one number a word."""
    index: dict[bytes, int] = defaultdict()
    index.default_factory = index.__len__
    ids = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(index.__getitem__, words), np.int64, len(words)) for words in _pieces(text))])
    among = lambda characters: len(text) - len(text.translate(None, characters))
    points = len(text) - among(_NEXT_BYTES) - among(b" \t\n\v\f\r")
    lines, seen, start = 0, set(), 0
    while start <= len(text):
        end = text.find(b"\n", start)
        line = text[start : end if end >= 0 else len(text)]
        if line.strip():
            lines += 1
            seen.add(line)
        start = end + 1 if end >= 0 else len(text) + 1
    stutters = int(np.count_nonzero(ids[1:] == ids[:-1]))
    return (len(ids), points, among(SYMBOLS), lines - len(seen), repeated(ids, len(index)), lines, len(index), stutters, among(_UPPER), among(_DIGITS), among(_MARKS))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS...) of each row of `docs` (doc_id, text): one map over the table, without a shuffle.

    A null or empty text has zero of all. Texts of any length are split piece by piece. Rows are independent, so
    repeated rows give repeated results; other columns are not returned; an empty table gives an empty one.
    """

    def run(batches):
        for b in batches:
            got = np.array([counts(t or b"") for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in got.T)], ["doc_id", *COUNTS])

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))


def shares() -> dict[str, Column]:
    """What rules look at, by name, out of COUNTS; 0 where there is nothing to divide by."""
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "words": F.col("n_words").cast("double"),
        "chars_a_word": part("word_chars", "n_words"),
        "symbols_a_word": part("n_symbols", "n_words"),
        "duplicate_lines": part("n_dup_lines", "n_lines"),
        "repeated_words": part("n_repeat_words", "n_words"),
        "words_a_line": part("n_words", "n_lines"),
        "different_words": part("n_different", "n_words"),
        "stutters": part("n_stutters", "n_words"),
        "capitals": part("n_upper", "word_chars"),
        "digits": part("n_digits", "word_chars"),
        "marks_a_word": part("n_marks", "n_words"),
    }


def base_failed() -> Column:
    """Too few words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """name > at, or name <= at."""

    name: str
    above: bool
    at: float

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.name] > self.at if self.above else values[self.name] <= self.at

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.name] > self.at if self.above else values[self.name] <= self.at

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.at!r}"


@dataclass(frozen=True)
class Rule:
    """All conditions hold: the text is dropped. Weights of the learning rows that it covers, for and against."""

    conditions: tuple[Condition, ...]
    bad: float
    good: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.holds(values) for c in self.conditions])


@dataclass(frozen=True)
class DecisionList:
    """Rules in their order; a text that none covers is kept."""

    rules: tuple[Rule, ...]

    def column(self, values: dict[str, Column]) -> Column:
        """The first rule that covers a row, from 1; 0 if none does."""
        first = None
        for k, rule in enumerate(self.rules, 1):
            every = rule.conditions[0].column(values)
            for c in rule.conditions[1:]:
                every = every & c.column(values)
            first = F.when(every, F.lit(k)) if first is None else first.when(every, F.lit(k))
        return F.lit(0) if first is None else first.otherwise(F.lit(0))

    def __str__(self) -> str:
        return "CASE " + "".join(f"WHEN {' AND '.join(map(str, r.conditions))} THEN {k} " for k, r in enumerate(self.rules, 1)) + "ELSE 0 END" if self.rules else "0"


#: Rows of each label to learn from at most; rules and conditions of a rule at most; learning rows that a rule
#: covers at least; share of bad ones among the rows that a rule covers.
MAX_ROWS, MAX_RULES, MAX_CONDITIONS, LEAST_COVER, LEAST_SHARE = 20_000, 12, 4, 3, 0.9


def best_condition(values: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray) -> Condition | None:
    """The threshold with the highest gain: weight of bad rows that stay, times the bits that their share gains. Ties: the first name, then the lowest threshold."""
    all_bad, every = float(weight[bad].sum()), float(weight.sum())
    best, found = 1e-9, None
    for name in sorted(values):
        x = values[name]
        order = np.argsort(x, kind="stable")
        v, w = x[order], weight[order]
        ends = np.flatnonzero(v[1:] > v[:-1])
        b, t = np.cumsum(w * bad[order])[ends], np.cumsum(w)[ends]
        middle = (v[ends] + v[ends + 1]) / 2
        middle = np.where(middle < v[ends + 1], middle, v[ends])  # neighbours among floats
        for above, p, q in ((False, b, t), (True, all_bad - b, every - t)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 1e-9, p * (np.log2(p / q) - math.log2(all_bad / every)), 0.0)
            if len(gain) and gain.max() > best + 1e-9:
                k = int(gain.argmax())
                best, found = float(gain[k]), Condition(name, above, float(middle[k]))
    return found


def learn(values: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray, pruning: np.ndarray) -> DecisionList:
    """Sequential covering over rows with `values`; those of `pruning` judge what the others have grown."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        inside, conditions = left & ~pruning, []
        while len(conditions) < MAX_CONDITIONS and bad[inside].any() and not bad[inside].all():
            c = best_condition({k: v[inside] for k, v in values.items()}, bad[inside], weight[inside])
            if c is None:
                break
            conditions.append(c)
            inside &= c.holds(values)
        # the beginning of the conditions that does best on rows they were not grown on; the shorter of equals
        best = None
        for n in range(1, len(conditions) + 1):
            covered = left & Rule(tuple(conditions[:n]), 0, 0).holds(values)
            judged = covered & pruning
            p, q = float(weight[judged & bad].sum()), float(weight[judged & ~bad].sum())
            worth = (p - q) / (p + q + 2)
            if best is None or worth > best[0] + 1e-12:
                best = (worth, n, covered)
        if best is None:
            break
        covered = best[2]
        p, q = float(weight[covered & bad].sum()), float(weight[covered & ~bad].sum())
        if best[0] <= 0 or np.count_nonzero(covered) < LEAST_COVER or p < LEAST_SHARE * (p + q):
            break
        rules.append(Rule(tuple(conditions[: best[1]]), p, q))
        left &= ~covered
    return DecisionList(tuple(rules))


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the rows with a quality of 0 or 1 and an id, one of each id: 0 if any says so."""
    return labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))


def learning_rows(rows: DataFrame, max_rows: int = MAX_ROWS) -> tuple[DataFrame, dict[int, float]]:
    """Rows (doc_id, quality, ...) to learn from, some `max_rows` of each label, and what one of them stands for.

    A threshold on the id's hash takes the share that is asked for wherever a row lies, so no task gathers more than
    another; the number taken differs from `max_rows` by chance only (some 1 % at 20,000).
    """
    total = {r.quality: r["count"] for r in rows.groupBy("quality").count().collect()}
    share = {q: min(1.0, max_rows / n) for q, n in total.items()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    take = F.lit(False)
    for q, s in share.items():
        take = take | ((F.col("quality") == q) & (place < s))
    return rows.where(take), {q: 1 / s for q, s in share.items()}


def fit(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DecisionList:
    """The list learned from `stats` (doc_id, COUNTS) with `labels` (doc_id, quality); rows that fail the base rules teach nothing.

    Of an id with several rows one counts. Without bad rows, or without labels, the list is empty.
    """
    values = shares()
    one = stats.where(~base_failed()).groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("s")).select("doc_id", "s.*")
    rows, stands_for = learning_rows(one.join(labelled(labels), "doc_id"), max_rows)
    got = rows.select("doc_id", "quality", *[c.alias(k) for k, c in values.items()]).orderBy("doc_id").toArrow()
    column = lambda c: got.column(c).to_numpy()
    quality = column("quality")
    weight = np.array([stands_for[q] for q in quality], float)
    return learn({k: column(k) for k in values}, quality == 0, weight, column("doc_id") % 3 == 0)


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """`stats` with base_failed, rule (the first that covers the row, from 1; 0: none) and kept."""
    return stats.withColumns({"base_failed": base_failed(), "rule": rules.column(shares())}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, COUNTS, base_failed, rule, kept) of each row of `docs` (doc_id, text), by rules learned from `labels`.

    The texts are read once: their counts are written to the shared checkpoint folder, learned from and judged.
    Null and empty texts have no words and fail the base rules; repeated rows get equal verdicts; a null id teaches nothing
    but is judged; an empty table gives an empty one; other columns of `docs` are not returned.
    """
    stats = materialize(statistics(docs))
    return judge(stats, fit(stats, labels))


def keep_good(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of `docs` (text, ...) that the base rules and the list keep, with all their columns."""
    made, text = free_name(docs, "_made"), docs["text"]
    columns = keep_columns(docs, [])
    stat = F.pandas_udf(lambda s: s.map(lambda t: counts(t or b"")).map(list), "array<bigint>")(text.cast("binary"))
    rows = docs.select(*columns_of(docs), stat.alias(made))
    numbered = rows.select(F.struct(*columns_of(rows, columns)).alias("row"), *[F.col(made)[k].alias(c) for k, c in enumerate(COUNTS)])
    return judge(numbered, rules).where("kept").select("row.*")
