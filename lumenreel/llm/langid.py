"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text in both directions, gives every position the probabilities of
the languages, and the document the mean of those of its positions. It is trained here in numpy by
backpropagation through time, on a bounded sample: at most PER_LANGUAGE different snippets of each
language. Whole texts are labelled, in windows of WINDOW bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, text_bytes

HIDDEN, SNIPPET, WINDOW = 8, 96, 256
PER_LANGUAGE = 1500
BATCH, STEPS, RATE, SEED = 128, 700, 0.02, 7
PARTS = 64  # of each language, in drawing the sample
LANES = 4096  # windows that go through the network side by side; fewer beyond WIDE languages
WIDE = 32
UNKNOWN = "und"

_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Network:
    """For each direction a table of what each byte adds to the gates and the recurrent weights; one output layer."""

    languages: list[str]
    tables: list[np.ndarray]  # 2 x (3H, 256)
    recurrent: list[np.ndarray]  # 2 x (3H, H)
    out: np.ndarray  # (L, 2H)
    bias: np.ndarray  # (L,)

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, rng: np.random.Generator) -> Network:
        h, n = hidden, len(languages)
        r = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        return cls(languages, [r(3 * h, 256) for _ in "ab"], [r(3 * h, h) for _ in "ab"], r(n, 2 * h), np.zeros(n, np.float32))

    def weights(self) -> list[np.ndarray]:
        return [*self.tables, *self.recurrent, self.out, self.bias]

    def run(self, x: np.ndarray, way: int, keep: bool = False):
        """States (T, H, B) after each of the bytes x (T, B), read in one direction; with keep also what backpropagation needs."""
        t, b = x.shape
        table, u = self.tables[way], self.recurrent[way]
        h = u.shape[1]
        state, states, kept = np.zeros((h, b), np.float32), np.empty((t, h, b), np.float32), []
        for k in range(t) if not way else range(t - 1, -1, -1):
            gates = np.take(table, x[k], axis=1)
            rec = u @ state
            zr = gates[: 2 * h]
            zr += rec[: 2 * h]
            _sigmoid(zr)
            z, r = zr[:h], zr[h:]
            n = gates[2 * h :]
            n += r * rec[2 * h :]
            n *= 2
            _sigmoid(n)
            n *= 2
            n -= 1
            new = state - n
            new *= z
            new += n
            if keep:
                kept.append((k, state, z, r, n, rec[2 * h :]))
            state = states[k] = new
        return (states, kept) if keep else states

    def probabilities(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """(T, L, B)."""
        h = forward.shape[1]
        y = np.matmul(self.out[:, :h], forward) + np.matmul(self.out[:, h:], backward) + self.bias[:, None]
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        return y

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss of all positions, and its gradients by backpropagation through time."""
        runs = [self.run(x, w, True) for w in (0, 1)]
        p = self.probabilities(runs[0][0], runs[1][0])
        t, b = x.shape
        h = self.out.shape[1] // 2
        total = mask.sum()
        loss = -(np.log(np.maximum(p[:, label, np.arange(b)], 1e-9)) * mask).sum() / total
        p[:, label, np.arange(b)] -= 1
        p *= (mask / total)[:, None, :]
        both = np.concatenate((runs[0][0], runs[1][0]), axis=1)
        d_out = np.einsum("tlb,thb->lh", p, both)
        d_bias = p.sum(axis=(0, 2))
        d_tables, d_rec = [], []
        for way, (_, kept) in enumerate(runs):
            u = self.recurrent[way]
            d_states = np.matmul(self.out[:, h * way : h * way + h].T, p)
            d_u, d_gates, d = np.zeros_like(u), np.empty((t, 3 * h, b), np.float32), np.zeros((h, b), np.float32)
            for k, before, z, r, n, rec in reversed(kept):
                d = d + d_states[k]
                dn = d * (1 - z) * (1 - n * n)
                g = d_gates[k]
                g[:h] = d * (before - n) * z * (1 - z)
                g[h : 2 * h] = dn * rec * r * (1 - r)
                g[2 * h :] = dn
                inner = g.copy()
                inner[2 * h :] *= r
                d_u += inner @ before.T
                d = d * z + u.T @ inner
            by_byte = np.zeros((256, 3 * h), np.float32)
            np.add.at(by_byte, x.ravel(), d_gates.transpose(0, 2, 1).reshape(-1, 3 * h))
            d_tables.append(by_byte.T)
            d_rec.append(d_u)
        return float(loss), [*d_tables, *d_rec, d_out, d_bias]

    def label(self, texts: list[bytes]) -> np.ndarray:
        """Pooled probabilities (texts, L); an empty text has zeros."""
        out = np.zeros((len(texts), len(self.languages)))
        held: list[tuple[int, bytes]] = []

        def flush() -> None:
            held.sort(key=lambda w: len(w[1]))
            lanes = max(1, LANES * WIDE // max(WIDE, len(self.languages)))
            for at in range(0, len(held), lanes):
                part = held[at : at + lanes]
                sizes = np.array([len(w) for _, w in part])
                t = int(sizes.max())
                x = np.frombuffer(b"".join(w.ljust(t, b"\0") for _, w in part), np.uint8).reshape(len(part), t).T
                y = self.probabilities(self.run(x, 0), self.run(x, 1))
                y *= (np.arange(t)[:, None] < sizes)[:, None, :]
                np.add.at(out, [i for i, _ in part], y.sum(axis=0, dtype=np.float64).T)
            held.clear()

        for i, text in enumerate(texts):
            for at in range(0, len(text), WINDOW):
                held.append((i, text[at : at + WINDOW]))
                if len(held) == 4 * LANES:
                    flush()
        if held:
            flush()
        return out / np.maximum([[len(t)] for t in texts], 1)


def train(snippets: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = SEED) -> Network:
    """Adam over random batches; languages count alike however common they are."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    net = Network.fresh(languages, hidden, rng)
    x = np.frombuffer(b"".join(s[:SNIPPET].ljust(SNIPPET, b"\0") for s in snippets), np.uint8).reshape(-1, SNIPPET).T
    mask = (np.arange(SNIPPET)[:, None] < np.array([min(len(s), SNIPPET) for s in snippets])).astype(np.float32)
    y = np.searchsorted(languages, labels)
    of = [np.flatnonzero(y == k) for k in range(len(languages))]
    w = net.weights()
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(of[k]) for k in rng.integers(0, len(languages), BATCH)])
        _, grads = net.gradients(np.ascontiguousarray(x[:, pick]), mask[:, pick], y[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1, 2 * (1 - step / (steps + 1))) * min(1, 1 / max(norm, 1e-9))
        for a, g, ma, va in zip(w, grads, m, v, strict=True):
            ma += 0.1 * (g - ma)
            va += 0.01 * (g * g - va)
            a -= rate * (ma / (1 - 0.9**step)) / (np.sqrt(va / (1 - 0.99**step)) + 1e-6)
    return net


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, snippet) to learn from: of each language a bounded number of different ones, from any place of the texts, first by hash."""
    text = F.col("text")
    rows = docs.where(F.col("lang").isNotNull() & text.isNotNull() & (F.length(text) > 0) & ~held_out(F.col("doc_id")))
    at = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - SNIPPET, F.lit(0)) + 1) + 1
    cut = rows.select("lang", F.substring(text, at.cast("int"), F.lit(SNIPPET)).alias("snippet")).distinct().withColumn("h", F.xxhash64("snippet"))
    # first within parts of each language, so that a language of any size spreads over many tasks
    order = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("h", "snippet"))
    # and no more of a part than a language that has enough needs: few rows are left to be numbered by language
    parts = cut.withColumn("part", F.pmod(F.col("h"), F.lit(PARTS))).withColumn("n", order("lang", "part")).where(F.col("n") <= 2 * per_language // PARTS + 8)
    few = parts.withColumn("n", order("lang")).where(F.col("n") <= per_language)
    return few.select("lang", F.col("snippet").cast("binary").alias("snippet"))


def fit(docs: DataFrame) -> Network | None:
    """Learn from (doc_id, text, lang); None if nothing can be learned from."""
    got = sample(docs).orderBy("lang", "snippet").toArrow()
    if not got.num_rows:
        return None
    return train([s.as_py() for s in got.column("snippet")], got.column("lang").to_pylist())


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of `docs` (doc_id, text).

    A text that is null or has no letter is `und` with score 0. Rows are independent; ties go to the
    language that sorts first; columns but doc_id are not returned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        net = shared.value
        texts = [t or b"" for t in b.column(1).to_pylist()]
        readable = [bool(_ASCII_LETTER.search(t) or any(map(str.isalpha, t.decode("utf-8", errors="ignore")))) and net is not None for t in texts]
        if net is None:
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        else:
            p = net.label([t if ok else b"" for t, ok in zip(texts, readable, strict=True)])
            best = p.argmax(axis=1)
            langs = [net.languages[k] if ok else UNKNOWN for k, ok in zip(best, readable, strict=True)]
            scores = np.where(readable, np.clip(p[np.arange(len(p)), best], 0, 1), 0)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(langs), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes(docs).alias("text")), run, "doc_id bigint, lang_pred string, score double")
