"""Exact repeats of a fixed length, found through difference covers.

A difference cover modulo v holds, for any two places, a shift under which both fall on it. So if a
string of L units stands at two places, then at one of the first v shifts both copies have an anchor,
and the L - v + 1 units from there on agree. Units are bytes or words; places are counted within
documents, and nothing crosses a document.

1. Each chunk of documents names its anchors: the hash of the L - v + 1 units from the anchor on, and
   the hash of its context, which is all that windows around the anchor can hold. Names are made
   distinct in the chunk, dealt to buckets, sorted, and neighbours compared. An anchor whose name and
   context stand elsewhere settles all windows around it; one whose name stands elsewhere with
   other contexts only leaves them open.
2. For one anchor of each context of an open name, the windows around it are named by the hash of
   their L units, dealt, sorted and compared in the same way.
3. The chunks learn by one or two bits a name what was found, and apply it.

What leaves a chunk is arrays of names, ten bytes each, with one row for a chunk and bucket; a name
that a third of the corpus holds is sent once a chunk. Names have 80 bits of hash: 48 of one hash and
32 of another with a base and units of its own, for anchors (string and context) and for windows alike.
Strings with equal names are taken as equal without a look at the units again.

Documents are chunked in the order of id and text within each partition of the input, so a task that is
run again deals the same chunks. A text longer than a chunk is a chunk of its own; a task needs some 80
bytes of memory for each byte of its chunk, so a text of 20 MB is about the longest for a 2 GB worker.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, text_bytes

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
LEAST_CHUNK, MOST_CHUNK = 1 << 20, 1 << 22
_U = np.uint64


@lru_cache
def difference_cover(q: int) -> tuple[int, np.ndarray]:
    """(v, places) of the difference set of q + 1 places modulo q * q + q + 1, q prime: the powers of a root of a cubic over GF(q) that lie in a plane."""
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, places = (1, 0, 0), []
                for i in range(v):
                    if x[2] == 0:
                        places.append(i)
                    # times the root: t^3 = a t^2 + b t + c
                    x = (c * x[2] % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
                if len(places) == q + 1 and len({(s - t) % v for s in places for t in places}) == v:
                    return v, np.array(places)
    raise ValueError(f"no difference cover for {q}")


@lru_cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and its inverse modulo 2**64, for k up to n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.ones(n + 1, _U)
        p[1:] = b
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Hashes:
    """Hashes of any stretch of an array of 64-bit units."""

    def __init__(self, units: np.ndarray, base: int = BASES[0]) -> None:
        p, self.inverse = _powers(base, 1 << max(20, len(units).bit_length()) if len(units) > MOST_CHUNK else MOST_CHUNK)
        self.sums = np.zeros(len(units) + 1, _U)
        np.cumsum(units * p[: len(units)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self.inverse[start])


_BYTE_UNITS = [mix64(np.arange(1, 257, dtype=_U) * _U(k)) | _U(1) for k in (0xD6E8FEB86659FD93, 0xA3B195354A39B70D)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Kind:
    """What is a unit, how long a repeat is, the cover, and how many of the first hash's 48 bits count (fewer in tests of the second)."""

    words: bool
    length: int
    q: int
    bits: int = 48

    @property
    def v(self) -> int:
        return difference_cover(self.q)[0]

    @property
    def least(self) -> int:
        """Units that two anchors of one repeat share at least."""
        return self.length - self.v + 1


@dataclass
class Chunk:
    """Units of some documents: their hashes, and where each document begins."""

    kind: Kind
    raw: np.ndarray
    ends: np.ndarray  # of the documents, in bytes

    def __post_init__(self) -> None:
        if not self.kind.words:
            self.bounds = np.concatenate(([0], self.ends))
            self.hashes, self.second = (Hashes(u[self.raw], b) for u, b in zip(_BYTE_UNITS, BASES, strict=True))
            return
        space = np.ones(len(self.raw) + 2, bool)
        space[1:-1] = _SPACE[self.raw]
        edges = space[1:] != space[:-1]
        # words end where documents do
        inner = self.ends[(self.ends > 0) & (self.ends < len(self.raw))]
        inner = np.unique(inner)
        joined = inner[~space[inner] & ~space[inner + 1]]
        places = np.flatnonzero(edges)
        places = np.sort(np.concatenate((places, joined, joined)))
        self.word_start, self.word_stop = places[0::2], places[1::2]
        size = (self.word_stop - self.word_start).astype(_U)
        self.hashes, self.second = (Hashes(Hashes(u[self.raw], b).of(self.word_start, self.word_stop) ^ size, b) for u, b in zip(_BYTE_UNITS, BASES, strict=True))
        self.bounds = np.searchsorted(self.word_start, np.concatenate(([0], self.ends)))

    @property
    def mask(self) -> np.uint64:
        return _U(((1 << self.kind.bits) - 1) << (64 - self.kind.bits))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, last, anchor name, context name): windows first..last hold the anchor; only anchors of which there are some."""
        k, (v, places) = self.kind, difference_cover(self.kind.q)
        at, begin, end = [], [], []
        sizes = np.diff(self.bounds)
        for s, n in zip(self.bounds[:-1][sizes >= k.length], sizes[sizes >= k.length], strict=True):
            a = (np.arange(0, n - k.least + 1, v)[:, None] + places).ravel()
            a = a[a <= n - k.least]
            at.append(a + s)
            begin.append(np.full(len(a), s))
            end.append(np.full(len(a), s + n))
        if not at:
            none = np.empty(0, np.int64)
            return none, none, none, none.astype(_U), none.astype(_U)
        at, begin, end = np.concatenate(at), np.concatenate(begin), np.concatenate(end)
        first, last = np.maximum(begin, at - v + 1), np.minimum(at, end - k.length)
        name = self.hashes.of(at, at + k.least) & self.mask
        stop = np.minimum(end, at + k.length)
        context = mix64(self.second.of(first, stop) + (at - first).astype(_U) * _U(0xA0761D6478BD642F) + (stop - at).astype(_U) * _U(0xE7037ED1A0B428DB))
        return at, first, last, name, context

    def windows(self, open_first: np.ndarray, open_last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows of all these ranges, each once, and both parts of their names."""
        mark = np.zeros(self.bounds[-1] + 2, np.int32)
        np.add.at(mark, open_first, 1)
        np.add.at(mark, open_last + 1, -1)
        start = np.flatnonzero(np.cumsum(mark) > 0)
        return start, self.hashes.of(start, start + self.kind.length) & self.mask, self.second.of(start, start + self.kind.length)

    def covered(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of each unit, whether it lies in a window that starts in one of the ranges."""
        mark = np.zeros(self.bounds[-1] + self.kind.length + 2, np.int32)
        np.add.at(mark, first, 1)
        np.add.at(mark, last + self.kind.length, -1)
        return np.cumsum(mark)[: self.bounds[-1]] > 0


def pack(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names in order, as (64 bits, 16 bits, whether there are several of it here, which of them each name is).

    The order is by the first 48 bits of `high`, then by 32 bits of `low`.
    """
    a = (high & _U(0xFFFFFFFFFFFF0000)) | (low >> _U(48))
    b = ((low >> _U(32)) & _U(0xFFFF)).astype(np.uint16)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    several = np.diff(np.append(first, len(a))) > 1
    return a[first], b[first], several, which


def bucket_edges(a: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in names sorted by their 64 bits; a name's bucket depends on the first 32 alone."""
    limits = [(k << 64) // buckets & ~0xFFFFFFFF for k in range(buckets)]
    return np.append(np.searchsorted(a, np.array(limits, _U)), len(a))


def judge(a: np.ndarray, b: np.ndarray, several: np.ndarray, contexts: bool) -> tuple[np.ndarray, np.ndarray]:
    """(settled, open) of the names of one bucket, from all chunks.

    settled: the same name stands elsewhere. open (with contexts): the first 48 bits stand elsewhere
    with another context, and this is the first of its context.
    """
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    ids = np.cumsum(new) - 1
    many = (np.bincount(ids) > 1) | (np.bincount(ids, weights=several[order]) > 0)
    settled, is_open = np.empty(len(x), bool), np.zeros(len(x), bool)
    settled[order] = many[ids]
    if contexts:
        g = x >> _U(16)
        fresh = np.ones(len(x), bool)
        fresh[1:] = g[1:] != g[:-1]
        group = np.cumsum(fresh) - 1
        kinds = np.bincount(group, weights=new)
        is_open[order] = new & (kinds[group] > 1)
    return settled, is_open


def _rows(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def _unpack(x, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)


CHUNK = "chunk bigint, ids array<bigint>, ends array<bigint>, blob binary"


def chunks(docs: DataFrame, size: int) -> DataFrame:
    """Documents (doc_id, text) in chunks of about `size` bytes, texts compressed; a longer text is a chunk of its own."""

    def run(batches):
        held, bytes_, made, part = [], 0, 0, 0

        def out():
            ends = np.cumsum([len(t) for _, t in held])
            blob = zstandard.ZstdCompressor(level=1).compress(b"".join(t for _, t in held))
            return _rows(chunk=pa.array([(part << 32) + made]), ids=pa.array([[i for i, _ in held]], pa.list_(pa.int64())), ends=pa.array([ends], pa.list_(pa.int64())), blob=pa.array([blob], pa.binary()))

        for b in batches:
            for part, i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):  # noqa: B007
                t = t or b""
                if held and bytes_ + len(t) > size:
                    yield out()
                    held, bytes_, made = [], 0, made + 1
                held.append((i, t))
                bytes_ += len(t)
        if held:
            yield out()

    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes(docs).alias("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.select(F.spark_partition_id().cast("bigint").alias("part"), "doc_id", "text").mapInArrow(run, CHUNK)


def _open(b: pa.RecordBatch, r: int, kind: Kind) -> Chunk:
    raw = zstandard.ZstdDecompressor().decompress(b.column("blob")[r].as_buffer())
    return Chunk(kind, np.frombuffer(raw, np.uint8), np.array(b.column("ends")[r].as_py(), np.int64))


NAMES = "chunk bigint, bucket int, a binary, b binary, several binary"
BITS = "chunk bigint, bucket int, settled binary, opened binary"


def _name_rows(chunk: int, a: np.ndarray, b: np.ndarray, several: np.ndarray, buckets: int):
    edges = bucket_edges(a, buckets)
    full = np.flatnonzero(np.diff(edges))
    cut = lambda x: pa.array([x[edges[k] : edges[k + 1]].tobytes() for k in full], pa.binary())
    flags = pa.array([np.packbits(several[edges[k] : edges[k + 1]]).tobytes() for k in full], pa.binary())
    return _rows(chunk=pa.array(np.full(len(full), chunk)), bucket=pa.array(full.astype(np.int32)), a=cut(a), b=cut(b), several=flags)


def _compare(names: DataFrame, contexts: bool) -> DataFrame:
    """Bits for each row of names, bucket by bucket; a task holds one bucket at a time."""

    def run(batches):
        held: list[tuple] = []

        def out():
            sizes = [len(x[2]) // 8 for x in held]
            a = np.frombuffer(b"".join(x[2] for x in held), _U)
            b = np.frombuffer(b"".join(x[3] for x in held), np.uint16)
            several = np.concatenate([_unpack(x[4], n) for x, n in zip(held, sizes, strict=True)])
            settled, opened = judge(a, b, several, contexts)
            at = np.cumsum([0, *sizes])
            bits = lambda f: pa.array([np.packbits(f[s:e]).tobytes() for s, e in zip(at, at[1:], strict=False)], pa.binary())
            return _rows(chunk=pa.array([x[0] for x in held], pa.int64()), bucket=pa.array([x[1] for x in held], pa.int32()), settled=bits(settled), opened=bits(opened))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][1] != row[1]:
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    n = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return names.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, BITS)


def _by_chunk(bits: DataFrame, name: str) -> DataFrame:
    """The bits of each chunk in one row: at most one entry for each bucket."""
    return bits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "settled", "opened")).alias(name))


def _bits(cell, a: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(settled, open) of the sorted names a of a chunk."""
    edges = bucket_edges(a, buckets)
    settled, opened = np.zeros(len(a), bool), np.zeros(len(a), bool)
    for x in cell or []:
        s, e = edges[x["bucket"]], edges[x["bucket"] + 1]
        settled[s:e], opened[s:e] = _unpack(x["settled"], e - s), _unpack(x["opened"], e - s)
    return settled, opened


def find(docs: DataFrame, kind: Kind, finish, schema: str) -> DataFrame:
    """Rows that `finish(ids, chunk, covered)` makes of each chunk of `docs` (doc_id, text), covered being a flag for each unit."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts
    size = min(MOST_CHUNK, max(LEAST_CHUNK, buckets << 13))
    base = chunks(docs, size).repartition(parts, "chunk")  # one exchange, which all three passes read

    def name_anchors(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                _, _, _, name, context = _open(batch, r, kind).anchors()
                if len(name):
                    a, b, several, _ = pack(name, context)
                    yield _name_rows(batch.column("chunk")[r].as_py(), a, b, several, buckets)

    def opened(c: Chunk, cell):
        _, first, last, name, context = c.anchors()
        a, _, _, which = pack(name, context)
        settled, is_open = _bits(cell, a, buckets)
        settled, is_open = settled[which], is_open[which]
        return first[settled], last[settled], *c.windows(first[is_open], last[is_open])

    def name_windows(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                *_, window, second = opened(_open(batch, r, kind), batch.column("anchored")[r].as_py())
                if len(window):
                    a, b, several, _ = pack(window, second)
                    yield _name_rows(batch.column("chunk")[r].as_py(), a, b, several, buckets)

    def apply(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                c = _open(batch, r, kind)
                first, last, start, window, second = opened(c, batch.column("anchored")[r].as_py())
                a, _, _, which = pack(window, second)
                start = start[_bits(batch.column("windowed")[r].as_py(), a, buckets)[0][which]]
                covered = c.covered(np.concatenate((first, start)), np.concatenate((last, start)))
                yield finish(batch.column("ids")[r].as_py(), c, covered)

    anchored = _by_chunk(_compare(base.mapInArrow(name_anchors, NAMES), True), "anchored")
    with_anchors = base.join(anchored.hint("shuffle_hash"), "chunk", "left")
    windowed = _by_chunk(_compare(with_anchors.mapInArrow(name_windows, NAMES), False), "windowed")
    return with_anchors.join(windowed.hint("shuffle_hash"), "chunk", "left").mapInArrow(apply, schema)


BYTES = Kind(False, 200, 11)
WORDS = Kind(True, 35, 3)


def repeated_bytes(docs: DataFrame, kind: Kind = BYTES) -> DataFrame:
    """Remove every byte covered by a string of `kind.length` bytes that also starts elsewhere.

    (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept: binary) for each row of `docs` (doc_id,
    text). Null texts count as empty; repeated rows and null ids are texts like all others; extra
    columns are not returned. Rows of one text are all reduced, none is kept whole. An empty table
    gives an empty one; for very long texts see the head of the module.
    """

    def finish(ids, c: Chunk, covered: np.ndarray) -> pa.RecordBatch:
        edge = np.diff(np.concatenate(([0], covered.view(np.int8))))
        edge[c.bounds[:-1][np.diff(c.bounds) > 0]] = covered[c.bounds[:-1][np.diff(c.bounds) > 0]]  # a run does not pass a document's start
        removed, spans = (np.concatenate(([0], np.cumsum(x))) for x in (covered, edge == 1))
        s, e = c.bounds[:-1], c.bounds[1:]
        gone = removed[e] - removed[s]
        kept = [c.raw[x:y].tobytes() if not g else c.raw[x:y][~covered[x:y]].tobytes() for x, y, g in zip(s, e, gone, strict=True)]
        return _rows(doc_id=pa.array(ids, pa.int64()), n_bytes=pa.array(e - s), n_removed=pa.array(gone), n_spans=pa.array(spans[e] - spans[s]), kept_sha256=pa.array([hashlib.sha256(k).hexdigest() for k in kept]), kept=pa.array(kept, pa.binary()))

    return find(docs, kind, finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def repeated_words(docs: DataFrame, kind: Kind = WORDS) -> DataFrame:
    """Remove every word covered by a window of `kind.length` words whose words also stand elsewhere.

    (doc_id, n_words, n_removed, kept_sha256, kept: binary, the kept words joined by one space) for each row of
    `docs` (doc_id, text). Null texts have no words; repeated rows and null ids are texts like all
    others; extra columns are not returned. Rows of one text are all reduced, none is kept whole. An empty table
    gives an empty one; for very long texts see the head of the module.
    """

    def finish(ids, c: Chunk, covered: np.ndarray) -> pa.RecordBatch:
        raw = c.raw.tobytes()
        begin = np.concatenate(([0], c.ends))
        removed = np.concatenate(([0], np.cumsum(covered)))
        s, e = c.bounds[:-1], c.bounds[1:]
        gone = removed[e] - removed[s]
        kept = []
        for d, g in enumerate(gone):
            words = raw[begin[d] : begin[d + 1]].split()
            if g:
                words = [words[k] for k in np.flatnonzero(~covered[s[d] : e[d]])]
            kept.append(b" ".join(words))
        return _rows(doc_id=pa.array(ids, pa.int64()), n_words=pa.array(e - s), n_removed=pa.array(gone), kept_sha256=pa.array([hashlib.sha256(k).hexdigest() for k in kept]), kept=pa.array(kept, pa.binary()))

    return find(docs, kind, finish, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept binary")
