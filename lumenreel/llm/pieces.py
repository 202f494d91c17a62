"""Encoding to and decoding from the pieces of a SentencePiece vocabulary, by streaming Viterbi.

The vocabulary is a byte-fallback BPE one. For every place of a text there is just one piece that can
end its best segmentation there: the piece whose pair with the best piece before it merges in no
other way. So the search keeps one backpointer a place, over a window no longer than the longest
piece, and commits ids as soon as the paths of all places that a later piece could start from meet
in one boundary. The ids are those that merging pair by pair over the whole text gives.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, text_bytes

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "\u2581"
#: Segmented words a worker remembers; it forgets all of them when there are more.
REMEMBERED = 400_000
_NONE: dict[str, bool] = {}
#: Characters of a word that is searched in one window and remembered.
ONE_WINDOW = 64


class _Words(dict):
    """The ids of words as bytes, looked for when they are asked for first."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder

    def __missing__(self, w: str) -> bytes:
        got = self.encoder.word(w).tobytes()
        if len(w) <= ONE_WINDOW:
            if len(self) >= REMEMBERED:
                self.clear()
            self[w] = got
        return got


class Vocabulary:
    """Pieces, scores and byte pieces of a model file; small (tens of thousands of pieces) and sent to the workers whole."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)
        self.bytes_of: list[bytes] = []
        self.scores: dict[str, tuple[float, int]] = {}
        self.byte_ids = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.scores[piece] = (sp.get_score(i), i)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        inner = [p for p in self.scores if SPACE in p.lstrip(SPACE)]
        if inner or any("\n" in p for p in self.scores):
            raise ValueError("a piece spans the start of a word")


class Encoder:
    """Streaming search over one vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.longest = max(map(len, vocabulary.scores))
        self.pairs: dict[str, dict[str, bool]] = {}
        self.known = _Words(self)
        # of each start of a piece, whether it is one that its own characters merge to
        self.starts = {p[:k]: False for p in vocabulary.scores for k in range(1, len(p) + 1)}
        self.starts |= {p: True for p in vocabulary.scores if len(p) == 1 or self.merged(p) == [p]}
        self.ends: dict[str, str | None] = {}  # the piece that ends the best path of a word's beginning, which words share
        # what can be a piece of a path: single characters of pieces too
        self.steps = {p for p, whole in self.starts.items() if whole or len(p) == 1}
        # words with the spaces before them; no piece reaches over these bounds
        self.words = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")

    def merged(self, chars: Iterable[str]) -> list[str]:
        """Merge neighbours pair by pair, best score first, of equal ones the leftmost. For short strings only."""
        parts, scores = list(chars), self.v.scores
        none = (float("-inf"), 0)
        by = [scores.get(a + b, none)[0] for a, b in zip(parts, parts[1:], strict=False)]
        while by:
            best = max(by)
            if best == none[0]:
                break
            i = by.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del by[i]
            for k in (i - 1, i):
                if 0 <= k < len(by):
                    by[k] = scores.get(parts[k] + parts[k + 1], none)[0]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether a and b stay two pieces when their characters are merged together."""
        of = self.pairs.get(a)
        if of is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            of = self.pairs[a] = {}
        got = of.get(b)
        if got is None:
            got = of[b] = self.merged(a + b) == [a, b]
        return got

    def search(self, chars: Iterable[str]) -> Iterator[str]:
        """Pieces of a stream of characters, each as soon as it is certain."""
        window = ""  # characters from the last committed boundary on
        ended: list[str | None] = [None]  # the piece that ends at each place of the window
        before: str | None = None  # the piece that ends at its start
        todo = 0  # the first place from which no piece was tried yet
        done = False
        source = iter(chars)
        starts, pairs = self.starts, self.pairs
        while not done:
            more = "".join(islice(source, self.longest))
            done = len(more) < self.longest
            window += more
            ended += [None] * len(more)
            size = len(window)
            # a piece from here on may need characters that are not read yet
            stop = size if done else max(todo, size - self.longest + 1)
            while todo < stop:
                last = ended[todo] if todo else before
                after = pairs.get(last, _NONE)
                k = todo + 1
                p = window[todo]
                whole = starts.get(p)
                if whole is None:  # a character of no piece; nothing merges with it
                    if ended[k] is None:
                        ended[k] = p
                while whole is not None:
                    if (whole or k == todo + 1) and ended[k] is None:
                        if last is None:
                            ended[k] = p
                        else:
                            fit = after.get(p)
                            if fit is None:
                                fit = self.fits(last, p)
                            if fit:
                                ended[k] = p
                    k += 1
                    if k > size:
                        break
                    p = window[todo:k]
                    whole = starts.get(p)
                todo += 1
            if not done:
                # places from `todo` on may still start a piece: where do their paths meet?
                live = {q for q in range(todo, len(window) + 1) if ended[q] is not None}
                while len(live) > 1:
                    q = max(live)
                    live.discard(q)
                    live.add(q - len(ended[q]))
                    if 0 in live:
                        break
                meet = min(live) if len(live) == 1 else 0
                if meet:
                    out = self.trace(ended, meet)
                    yield from out
                    before, window, ended, todo = out[-1], window[meet:], [None, *ended[meet + 1 :]], max(0, todo - meet)
        yield from self.trace(ended, len(window))

    def search_word(self, w: str) -> list[str]:
        """The pieces that `search` gives, of a word that one window holds: the same backpointers without anything to commit on the way."""
        ended: list[str | None] = [None]
        steps, pairs, longest, ends = self.steps, self.pairs, self.longest, self.ends
        if len(ends) >= REMEMBERED:
            ends.clear()
        for k in range(1, len(w) + 1):
            head = w[:k]
            p = ends.get(head)
            if p is None:
                for at in range(max(0, k - longest), k):  # of the pieces that end here the longest that fits
                    p = w[at:k]
                    if p in steps:
                        last = ended[at]
                        if last is None:
                            break
                        fit = pairs.get(last, _NONE).get(p)
                        if fit is None:
                            fit = self.fits(last, p)
                        if fit:
                            break
                else:
                    p = None if p in steps else p  # a character of no piece; nothing merges with it
                ends[head] = p
            ended.append(p)
        return self.trace(ended, len(w))

    @staticmethod
    def trace(ended: list[str | None], at: int) -> list[str]:
        out = []
        while at:
            out.append(ended[at])
            at -= len(out[-1])
        return out[::-1]

    def word(self, w: str) -> array:
        got = array("i")
        for p in self.search_word(w) if len(w) <= ONE_WINDOW else self.search(w):
            s = self.v.scores.get(p)
            if s:
                got.append(s[1])
            else:
                got.extend(self.v.byte_ids[b] for b in p.encode())
        return got

    def encode(self, text: str) -> array:
        """Ids (32 bits) of a text. A character of the text that is the space mark itself goes into bytes, so that decoding is exact."""
        ids = array("i")
        if not text:
            return ids
        known = self.known.__getitem__
        for k, part in enumerate(text.split(SPACE)):
            if k:
                ids.extend(self.v.byte_ids[b] for b in SPACE.encode())
            ids.frombytes(b"".join(map(known, self.words.findall((SPACE if not k else "") + part.replace(" ", SPACE)))))
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; the space put before its start goes."""
        raw = b"".join(map(self.v.bytes_of.__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", errors="replace")


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder a worker, kept between tasks."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value)
    return _encoders[key]


def encode(docs: DataFrame, model_file: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids, exact) for each row of `docs` (doc_id, text); exact: decoding gives the text back.

    Null text: null ids, 0 tokens, exact true; empty text: no ids. Rows are independent; extra
    columns are not returned.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary(model_file))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        e = _encoder(shared)
        ids, counts, exact = [], [], []
        for t in b.column(1):
            raw = t.as_py()
            if raw is None:
                ids.append(None), counts.append(0), exact.append(True)
                continue
            one = e.encode(raw.decode("utf-8", errors="replace"))
            ids.append(pa.Array.from_buffers(pa.int32(), len(one), [None, pa.py_buffer(one)]))
            counts.append(len(one))
            exact.append(b"".join(map(e.v.bytes_of.__getitem__, one)).removeprefix(b" ") == raw)
        offsets = [0]
        for c in counts:
            offsets.append(offsets[-1] + c)
        flat = pa.concat_arrays([x for x in ids if x is not None] or [pa.array([], pa.int32())])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=pa.array([x is None for x in ids]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), lists, pa.array(exact)], ["doc_id", "n_tokens", "ids", "exact"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes(docs).alias("text")), run, "doc_id bigint, n_tokens bigint, ids array<int>, exact boolean")


def decode(tokens: DataFrame, model_file: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, text) from rows of (doc_id, ids). Null ids: null text."""
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary(model_file))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        e = _encoder(shared)
        texts = [None if x.as_py() is None else e.decode(x.as_py()) for x in b.column(1)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), run, "doc_id bigint, text string")
