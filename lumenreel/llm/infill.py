"""Fill-in-the-middle forms of documents: prefix, suffix and middle in an order to learn from.

A unit is a run of ASCII letters or one other code point. Whether a unit starts at a byte depends on that
byte and the one before it alone: a unit starts at each first byte of a code point, unless the byte and
the one before it are letters both. So a text falls into chunks that overlap by one byte, each of which
counts its starts by itself. Prefix sums of these counts give the number of units and say in which chunk
the unit of any rank starts; of all chunks only the two that own a cut are read again, to find the
cuts' places. Code points are counted in the same way.

A chunk is some 64 KB, so besides the text itself a task holds only one chunk's predicates and two numbers
for each chunk. Documents are rows that do not meet each other: nothing is shuffled, and a lost executor's
rows are made again by themselves. The forms' digests read a text from end to end anyway, so the chunks of one document
stay in the task that has its row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_of, free_name, keep_columns

CHUNK = 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents so many stay as they are; of a hundred others so many get the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80


def unit_starts(raw: np.ndarray, low: int, high: int) -> np.ndarray:
    """For each byte of raw[low:high] whether a unit starts there; one byte before the chunk is looked at too."""
    letter = _LETTER[raw[max(low - 1, 0) : high]]
    if low == 0:
        letter = np.concatenate([[False], letter])
    return _FIRST_BYTE[raw[low:high]] & ~(letter[1:] & letter[:-1])


class Chunks:
    """Counts of the chunks of one text, and the places of ranks among them."""

    def __init__(self, text: bytes, chunk: int = CHUNK) -> None:
        self.raw, self.chunk = np.frombuffer(text, np.uint8), chunk
        lows = range(0, len(text), chunk)
        self.units = np.cumsum([0, *(np.count_nonzero(unit_starts(self.raw, k, min(k + chunk, len(text)))) for k in lows)])
        self.points = np.cumsum([0, *(np.count_nonzero(_FIRST_BYTE[self.raw[k : k + chunk]]) for k in lows)])

    @property
    def n(self) -> int:
        return int(self.units[-1])

    def points_before(self, rank: int) -> int:
        """Code points of the first `rank` units: the chunk that owns the next unit's start is read again."""
        if rank == self.n:
            return int(self.points[-1])
        own = int(np.searchsorted(self.units, rank, "right")) - 1
        low = own * self.chunk
        at = np.flatnonzero(unit_starts(self.raw, low, min(low + self.chunk, len(self.raw))))[rank - self.units[own]]
        return int(self.points[own]) + int(np.count_nonzero(_FIRST_BYTE[self.raw[low : low + at]]))


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "first", "second")]))
def _cuts(text: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Units of each text, and code points before the smaller and the larger of the two ranks a and b modulo n + 1."""
    out = []
    for t, x, y in zip(text, a, b, strict=True):
        chunks = Chunks(t)
        ranks = sorted((x % (chunks.n + 1), y % (chunks.n + 1)))
        out.append((chunks.n, *map(chunks.points_before, ranks)))
    return pd.DataFrame(out, columns=["n", "first", "second"])


def numbers(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2**32 for an id: the first four groups of 8 digits of the hex SHA-256 of `<seed>:<id>`. A null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text again, out of the output and its form. A text that holds a mark is plain, so each mark occurs once."""
    s, p, m = F.instr(output, SUFFIX), F.instr(output, PREFIX), F.instr(output, MIDDLE)
    part = lambda begin, end: F.substr(output, begin + 3, end - begin - 3)
    middle = F.substr(output, m + 3)
    return F.when(form == "psm", F.concat(part(p, s), middle, part(s, m))).when(form == "spm", F.concat(part(p, m), middle, part(s, p))).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """`docs` (doc_id, text, ...) with n, form, prefix_chars, middle_chars and output.

    n counts units. Two ranks from the id's hash cut a text into prefix, middle and suffix; a part may be
    empty. Form `psm` is `<P>prefix<S>suffix<M>middle`, `spm` is `<S>suffix<P>prefix<M>middle`; `plain`
    is the text as it stands, with null prefix_chars and middle_chars: texts that are empty or hold a mark, and `plain`
    of a hundred others.

    A null text counts as empty: n 0, plain, output empty. Texts of any length are read chunk by chunk.
    Rows are independent: repeated rows give repeated results, and equal ids equal ranks modulo n + 1. A null id
    counts as an empty one. An empty table gives an empty one. Other columns stay; those named like a new one are replaced.
    """
    new = ["n", "form", "prefix_chars", "middle_chars", "output"]
    t, cut, h = (free_name(docs, x) for x in ("_text", "_cut", "_h"))
    text = F.col(t)
    rows = docs.select(*columns_of(docs, keep_columns(docs, new)), F.coalesce(docs["text"], F.lit("")).alias(t), F.array(*numbers(docs["doc_id"].cast("bigint"), seed)).alias(h))
    rows = rows.withColumn(cut, _cuts(text.cast("binary"), F.col(h)[0], F.col(h)[1]))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (F.col(h)[2] % 100 >= 100 - plain), F.lit("plain")).when(F.col(h)[3] % 100 < suffix_first, F.lit("spm")).otherwise(F.lit("psm"))
    rows = rows.withColumn("form", form)
    first, second = F.col(f"{cut}.first"), F.col(f"{cut}.second")
    p, m, s = F.substr(text, F.lit(1), first.cast("int")), F.substr(text, (first + 1).cast("int"), (second - first).cast("int")), F.substr(text, (second + 1).cast("int"))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m))
        .otherwise(text)
    )
    cuts = F.col("form") != "plain"
    rows = rows.withColumns({"n": F.col(f"{cut}.n"), "prefix_chars": F.when(cuts, first), "middle_chars": F.when(cuts, second - first), "output": output})
    return rows.select(*columns_of(rows, [*keep_columns(docs, new), *new]))
