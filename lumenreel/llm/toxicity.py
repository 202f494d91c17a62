"""Toxicity by class-conditional Kneser-Ney models over the bytes of words.

Each class has its own discounted counts of byte n-grams within words, an n-gram counting once a text,
and both back off to one shared Kneser-Ney model of all labelled texts: what a class has not seen more
often than the discount keeps no mass of its own, so a rare expression is judged by the shared counts
and speaks for neither side.

A text's score compares length-normalised log-likelihoods: the toxic model's minus the ordinary model's,
a word, over the whole text, and the root mean square of the likelihood ratios of its passages of a few words,
so that no text gets a higher score for its length. One logistic curve that rises in both turns them
into a probability. The curve always exists: it is fitted to labelled texts,
each measured with its own counts taken out, and drawn towards the curve that the class shares alone
give; it equals the latter where a class has no text. Of DISCOUNTS and PASSAGES those with the smallest
loss on these texts are taken.

Bounds of the fit (everything else covers all rows and whole texts): at most MAX_ROWS labelled rows of
each class by hash of the id give counts, which also bounds what is broadcast, and at most CURVE_ROWS
of their texts, by hash of the text, the curve. All n-grams of the rows count. One that no class has
more often than the discount has the shared probability in both models exactly, and is left out of the
tables for that reason alone. A class that is drawn in part has more weight in the curve by as much, so
scores are probabilities at the classes' shares of all labelled rows at every size of input.

Null and empty texts have no words and get the score of the class shares. Copies of a text are learned
from once; repeated rows get equal scores; of two marks of an id, and of copies with different marks,
the toxic one counts. Very long texts are read PIECE bytes at a time and held as one number a word (a
word is cut where it is longer than that). Empty tables give empty results, and extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, free_name, keep_columns, map_arrow, materialize, text_bytes

ORDER = 5
DISCOUNTS = (1.5, 3.0, 5.0)
PASSAGES = (1, 3)  # words
SHARED_DISCOUNT = 0.75
THRESHOLD = 0.7
MAX_ROWS = {0: 30_000, 1: 30_000}
CURVE_ROWS = 10_000
RIDGE = 0.1
PIECE = 1 << 19

_LOW = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_BYTE = np.uint64(8)


@dataclass
class Piece:
    """Words of some texts: a space before the first word of each text and one behind every word."""

    keys: np.ndarray  # the n-gram that ends at each byte, from the space before the word on; the last byte is the lowest
    begin: np.ndarray  # of each word
    end: np.ndarray  # the space behind it
    doc: np.ndarray  # the place of each word's text in the list

    def sums(self, ratio: np.ndarray) -> np.ndarray:
        """What each word's bytes add up to."""
        total = np.concatenate(([0.0], np.cumsum(ratio, dtype=np.float64)))
        return total[self.end + 1] - total[self.begin]


def pieces(texts: list[bytes | None]) -> Iterator[Piece]:
    """The words of all texts in order, some megabytes at a time."""
    held: list[tuple[int, bytes]] = []
    size = 0
    for k, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            end = len(text) if len(text) - at <= PIECE else text.rfind(b" ", at, at + PIECE) + 1 or at + PIECE
            held.append((k, text[at:end]))
            size, at = size + end - at, end
            if size >= PIECE:
                yield _piece(held)
                held, size = [], 0
    if held:
        yield _piece(held)


def _piece(held: list[tuple[int, bytes]]) -> Piece:
    b = _LOW[np.frombuffer(b"".join(b" " + t + b" " for _, t in held), np.uint8)]
    first = np.cumsum([0] + [len(t) + 2 for _, t in held[:-1]])
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    keep[first] = True
    first = np.cumsum(keep)[first] - 1
    b = b[keep]
    space = np.flatnonzero(b == 32)
    real = np.diff(space) > 1
    begin, end = space[:-1][real] + 1, space[1:][real]
    since = np.arange(len(b)) - np.repeat(np.concatenate(([0], space)), np.diff(np.concatenate(([0], space + 1, [len(b)]))))  # bytes since the space before
    keys = b.astype(np.uint64)
    for n in range(1, ORDER):
        keys[n:] |= np.where(since[n:] >= n, b[:-n].astype(np.uint64) << np.uint64(8 * n), np.uint64(0))
    return Piece(keys, begin, end, np.array([k for k, _ in held])[np.searchsorted(first, begin, "right") - 1])


def passages(doc: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts: the mean a word, and by PASSAGES the log of the root mean square of the likelihood ratios of its runs of so many consecutive words (the ratio of all words, where a text has fewer).

    A mean over all runs settles as a text gets longer, where the largest run would keep growing. The
    squares make one toxic passage stand out; a text of slightly odd words throughout does not.
    """
    out = np.zeros((n, 1 + len(PASSAGES)))
    if not len(doc):
        return out
    size = np.bincount(doc, minlength=n)
    whole = np.bincount(doc, weights=word, minlength=n)
    out[:, 0] = whole / np.maximum(size, 1)
    start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    total = np.concatenate(([0.0], np.cumsum(word)))
    for k, width in enumerate(PASSAGES, 1):
        inside = np.flatnonzero(doc[width - 1 :] == doc[: max(0, len(doc) - width + 1)])
        run, of = total[inside + width] - total[inside], doc[inside]
        top = np.full(n, -np.inf)
        np.maximum.at(top, of, run)
        mass = np.bincount(of, weights=np.exp(2 * (run - top[of])), minlength=n)
        out[:, k] = np.where(size < width, whole, top + 0.5 * np.log(np.maximum(mass, 1) / np.maximum(size - width + 1, 1)))
    return out


class Table:
    """A hash table of 64-bit keys for whole arrays: what collides goes to a next, smaller table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.parts: list[tuple[int, np.ndarray, np.ndarray]] = []
        salt = 0
        while len(keys):
            bits = max(4, int(2 * len(keys)).bit_length())
            at = self.slots(keys, salt, bits)
            _, first = np.unique(at, return_index=True)
            own, val = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64), np.zeros(1 << bits, np.float32)
            own[at[first]], val[at[first]] = keys[first], values[first]
            self.parts.append((bits, own, val))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, salt = keys[rest], values[rest], salt + 1

    @staticmethod
    def slots(keys: np.ndarray, salt: int, bits: int) -> np.ndarray:
        return ((keys + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value or 0, whether there is one)."""
        out, hit = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        todo = np.arange(len(keys))
        for salt, (bits, own, val) in enumerate(self.parts):
            at = self.slots(keys[todo], salt, bits)
            same = own[at] == keys[todo]
            out[todo[same]], hit[todo[same]] = val[at[same]], True
            todo = todo[~same]
            if not len(todo):
                break
        return out, hit


@dataclass
class Model:
    """Log-likelihood ratios of seen n-grams and, for others, of their contexts; and the curve over (mean, passage, 1)."""

    grams: Table
    contexts: Table
    weights: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0, 0.0]))
    passage: int = 0  # which of PASSAGES

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        docs, words = [np.zeros(0, np.int64)], [np.zeros(0)]
        for p in pieces(texts):
            ratio, seen = self.grams.get(p.keys)
            lost = np.flatnonzero(~seen)
            ratio[lost] = self.contexts.get(p.keys[lost] >> _BYTE)[0]
            docs.append(p.doc), words.append(p.sums(ratio))
        f = passages(np.concatenate(docs), np.concatenate(words), len(texts))[:, [0, 1 + self.passage]]
        return 1 / (1 + np.exp(-np.clip(f @ self.weights[:2] + self.weights[2], -40, 40)))


@dataclass
class Counts:
    """Counts of n-grams by class, with what follows from them; `gram` and `context` are sorted."""

    gram: np.ndarray
    count: np.ndarray  # (2, grams)
    shared: np.ndarray  # shared probability of each n-gram's last byte
    context: np.ndarray
    of: np.ndarray  # context of each n-gram
    size: np.ndarray  # (2, contexts)
    free: dict[float, np.ndarray]  # by discount: counts that are backed off, (2, contexts)

    @staticmethod
    def made(gram: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> Counts:
        count = np.stack((c0, c1)).astype(float)
        levels, g, n = [(gram, count.sum(axis=0))], gram, ORDER
        while n > 1:  # below the top, an n-gram counts by the different bytes seen before it
            n -= 1
            g, kinds = np.unique(g & np.uint64((1 << (8 * n)) - 1), return_counts=True)
            levels.append((g, kinds.astype(float)))
        levels.reverse()
        p = None
        for k, (g, c) in enumerate(levels):
            _, ctx = np.unique(g >> _BYTE, return_inverse=True)
            size, kinds = np.bincount(ctx, weights=c), np.bincount(ctx)
            lower = np.full(len(g), 1 / 256) if p is None else p[np.searchsorted(levels[k - 1][0], g & np.uint64((1 << (8 * k)) - 1))]
            p = (np.maximum(c - SHARED_DISCOUNT, 0) + SHARED_DISCOUNT * kinds[ctx] * lower) / size[ctx]
        context, of = np.unique(gram >> _BYTE, return_inverse=True)
        total = lambda values: np.stack([np.bincount(of, weights=v) for v in values])
        return Counts(gram, count, p, context, of, total(count), {d: total(np.minimum(count, d)) for d in DISCOUNTS})

    def common(self) -> Counts:
        """Without the n-grams that no class has twice; the others, and all contexts, stay as they are."""
        keep = self.count.max(axis=0) > 1
        keep[:1] = True
        return Counts(self.gram[keep], self.count[:, keep], self.shared[keep], self.context, self.of[keep], self.size, self.free)

    def tables(self, discount: float) -> tuple[Table, Table]:
        size, free = self.size, self.free[discount]
        back = np.where(size > 0, free / np.maximum(size, 1), 1)
        keep = self.count.max(axis=0) > discount
        of = self.of[keep]
        p = np.maximum(self.count[:, keep] - discount, 0) / np.maximum(size[:, of], 1) + back[:, of] * self.shared[keep]
        ratio, rest = np.log(p[1] / p[0]), np.log(back[1] / back[0])
        some = rest != 0
        return Table(self.gram[keep], ratio.astype(np.float32)), Table(self.context[some], rest[some].astype(np.float32))

    def without(self, text: bytes, toxic: int) -> np.ndarray:
        """Features of a counted text by each discount, its own counts taken out: (discounts, 1 + passages)."""
        found = list(pieces([text]))
        keys = np.concatenate([p.keys for p in found] or [np.zeros(0, np.uint64)])
        out = np.zeros((len(DISCOUNTS), 1 + len(PASSAGES)))
        if not len(keys):
            return out
        gram, inverse = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
        hit = self.gram[at] == gram
        ctx = np.minimum(np.searchsorted(self.context, gram >> _BYTE), len(self.context) - 1)
        known = self.context[ctx] == gram >> _BYTE  # all but the space before the text
        own = np.where(hit, self.count[toxic][at], 1.0)
        here, which = np.unique(ctx, return_inverse=True)
        fewer = np.bincount(which, weights=known)[which]
        for k, d in enumerate(DISCOUNTS):
            logs = []
            for c in (0, 1):
                size, free, count = self.size[c][ctx], self.free[d][c][ctx], self.count[c][at]
                if c == toxic:
                    size, count = size - fewer, count - 1
                    free = free - np.bincount(which, weights=known * (np.minimum(own, d) - np.minimum(own - 1, d)))[which]
                back = np.where((size > 0) & known, np.maximum(free, 1e-9) / np.maximum(size, 1), 1)
                logs.append(np.log(np.where(hit, np.where(size > 0, np.maximum(count - d, 0) / np.maximum(size, 1), 0) + back * self.shared[at], back)))
            ratio = (logs[1] - logs[0])[inverse]
            place, words = 0, []
            for p in found:
                words.append(p.sums(ratio[place : place + len(p.keys)]))
                place += len(p.keys)
            out[k] = passages(np.concatenate([p.doc for p in found]), np.concatenate(words), 1)[0]
        return out


def count_grams(texts: DataFrame) -> DataFrame:
    """(gram, c0, c1) of all n-grams of `texts` (text, toxic): in how many texts of each class, combined in each task before the shuffle."""

    def run(batches):
        held, size = [[], []], 0

        def out():
            u = [np.unique(np.concatenate([np.zeros(0, np.uint64), *h]), return_counts=True) for h in held]
            gram = np.union1d(u[0][0], u[1][0])
            count = [np.zeros(len(gram), np.int64) for _ in u]
            for (g, n), c in zip(u, count, strict=True):
                c[np.searchsorted(gram, g)] = n
            return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), *map(pa.array, count)], ["gram", "c0", "c1"])

        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.unique(p.keys) for p in pieces([text])]]))
                grams = grams[grams != 32]  # the space before the text
                held[y].append(grams)
                size += len(grams)
                if size > 2_000_000:
                    yield out()
                    held, size = [[], []], 0
        if size:
            yield out()

    rows = texts.select(text_bytes(texts).alias("text"), F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "gram bigint, c0 bigint, c1 bigint")
    return rows.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Weights (mean, passage, 1) of a logistic curve that falls in neither feature, drawn towards `start`."""
    x = np.column_stack((x, np.ones(len(x))))
    w = start.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (weight * (p - y)) + RIDGE * (w - start)
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(3)
        move = np.ones(3, bool)
        move[:2] = (w[:2] > 0) | (slope[:2] < 0)
        step = np.zeros(3)
        step[move] = np.clip(np.linalg.solve(bend[np.ix_(move, move)], slope[move]), -3, 3)
        new = w - step
        new[:2] = np.maximum(new[:2], 0)
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def marked_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of all rows with a toxic mark that are not held out, one of each id."""
    return labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))


def learning_rows(marked: DataFrame, of_class: dict[int, int], max_rows: dict[int, int] = MAX_ROWS) -> DataFrame:
    """(doc_id, toxic) to learn from: of `marked`, with so many rows of each class, at most max_rows of each, first by hash of the id.

    What a task sends on is thinned first: by a threshold on the hash, some standard deviations above what is taken.
    """
    place = F.xxhash64("doc_id")
    drawn = []
    for c, most in max_rows.items():
        share = min(1.0, (most + 8 * most**0.5 + 16) / max(of_class.get(c, 0), 1))
        last = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
        drawn.append(marked.where((F.col("toxic") == c) & (place <= last)).orderBy(place, "doc_id").limit(most))
    return drawn[0].unionAll(drawn[1])


def _learning_texts(docs: DataFrame, few: DataFrame) -> DataFrame:
    """(text, toxic) of the rows to learn from, each different text once."""
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("text").isNotNull()).join(F.broadcast(few), "doc_id")
    named = named.select("doc_id", "text", "toxic", F.xxhash64("text").alias("h"))
    one = named.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))  # no more rows than `few` but for repeated ids
    return named.drop("toxic").join(one, ["h", "doc_id"]).dropDuplicates(["h"]).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, max_rows: dict[int, int] = MAX_ROWS) -> Model:
    """Learn from the texts of `docs` (doc_id, text) that `labels` (doc_id, toxic) marks. Without any the score is 0.5 throughout."""
    rows = materialize(marked_rows(labels))
    marked = dict(rows.groupBy("toxic").count().collect())
    texts = materialize(_learning_texts(docs, learning_rows(rows, marked, max_rows)))
    grams = count_grams(texts).toArrow()
    if not grams.num_rows:
        return Model(*[Table(np.zeros(0, np.uint64), np.zeros(0)) for _ in range(2)])
    gram, c0, c1 = (grams.column(c).to_numpy() for c in ("gram", "c0", "c1"))
    gram = gram.astype(np.int64).view(np.uint64)
    order = np.argsort(gram)
    counts = Counts.made(gram[order], c0[order], c1[order]).common()

    drawn = np.array([max(1, marked.get(c, 0) / max_rows[c]) for c in (0, 1)])  # marked rows for each one drawn
    prior = np.log((marked.get(1, 0) + 0.5) / (marked.get(0, 0) + 0.5))
    start = np.array([0.0, 1.0, prior])
    sizes = dict(texts.groupBy("toxic").count().collect())
    measured = _measure(texts, counts, sizes)
    y = measured.column("toxic").to_numpy().astype(int)
    if len(set(y.tolist())) < 2:
        return Model(*counts.tables(DISCOUNTS[0]), weights=start)
    weight = np.array([drawn[c] * max(1, sizes[c] / CURVE_ROWS) for c in (0, 1)])[y]
    weight = weight * len(weight) / weight.sum()
    best = []
    for k, discount in enumerate(DISCOUNTS):
        for j in range(len(PASSAGES)):
            x = np.column_stack([measured.column(f"f{k}_0").to_numpy(), measured.column(f"f{k}_{1 + j}").to_numpy()])
            order = np.lexsort((y, *x.T))
            w = curve(x[order], y[order], weight[order], start)
            z = np.clip(x @ w[:2] + w[2], -40, 40)
            best.append((float((weight * np.logaddexp(0, np.where(y == 1, -z, z))).mean()), discount, j, w))
    _, discount, passage, w = min(best, key=lambda b: b[:3])
    return Model(*counts.tables(discount), weights=w, passage=passage)


def _measure(texts: DataFrame, counts: Counts, sizes: dict[int, int]) -> pa.Table:
    """toxic and the features by each discount of at most CURVE_ROWS learning texts of each class, their own counts taken out."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    names = [f"f{k}_{j}" for k in range(len(DISCOUNTS)) for j in range(1 + len(PASSAGES))]

    def measure(b: pa.RecordBatch) -> pa.RecordBatch:
        y = b.column(1)
        f = np.array([shared.value.without(t, c) for t, c in zip(b.column(0).to_pylist(), y.to_pylist(), strict=True)]).reshape(b.num_rows, len(names))
        return pa.RecordBatch.from_arrays([y, *[pa.array(f[:, k]) for k in range(len(names))]], ["toxic", *names])

    thin = F.lit(1.0)
    for c, n in sizes.items():
        thin = F.when(F.col("toxic") == c, F.lit(min(1.0, CURVE_ROWS / n))).otherwise(thin)
    some = texts.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 20)) < thin * (1 << 20))
    return map_arrow(some.select(text_bytes(some).alias("text"), "toxic"), measure, "toxic int, " + ", ".join(f"{n} double" for n in names)).toArrow()


def _scorer(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts.to_pylist()))

    return of(text_bytes(docs))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with score (double, 0 to 1) and predicted (int, 1 if score >= 0.7); they replace columns of those names.

    Only the text is looked at; null texts count as empty ones. Repeated rows get equal scores.
    """
    scored = docs.select(*columns_of(docs, keep_columns(docs, ["score", "predicted"])), _scorer(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def remove_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` that are not predicted toxic; columns as they were, those named score too."""
    name = free_name(docs, "toxicity")
    return docs.withColumn(name, _scorer(docs, model)).where(F.col(name) < THRESHOLD).drop(name)
