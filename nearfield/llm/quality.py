"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages: its lines, long ones cut at ``PASSAGE`` bytes. Each passage is
encoded by its character make-up (shares of byte classes, hashed byte pairs, measures of
repetition) and a small dense layer. Gated attention, ``softmax(w . (tanh(V h) * sigmoid(U h)))``,
weighs the passages; the weighted mean of the encodings is scored by a logistic unit. Only document
labels teach the weights.

The network is fitted on about ``SAMPLE`` labelled rows, chosen by a hash of the id, and on no
more than twice that; of a training text on at most ``FIT_PASSAGES`` passages, evenly spaced. Scoring
reads every passage of every text, ``BLOCK`` of them at a time: a text's weighted sum is carried from block
to block, so memory does not grow with the number of its passages.

Defined results. Null and empty texts are one empty passage. Nothing to learn from: every score is
0.5. A document labelled several times has the mean label. Equal texts get equal scores, up to rounding. Rows
that share a doc_id get scores of their own; null doc_ids are scored and not learned from. An empty table makes
no rows. Columns other than doc_id, text and quality are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm._shared import arrow_batches, held_out

#: Bytes of a passage; labelled rows to fit on; score from which a text counts as good.
PASSAGE, SAMPLE, GOOD = 512, 3000, 0.3
#: Passages of a training text at most; passages that are encoded at once.
FIT_PASSAGES, BLOCK = 64, 1024
PAIRS, HIDDEN, GATE = 128, 24, 12
EPOCHS, RATE, DECAY, BAGS = 30, 0.01, 1e-4, 64

#: Byte classes: capital, small, digit, blank, line end, over 0x7F, then each mark on its own.
_CLASS = np.array([0 if 65 <= c <= 90 else 1 if 97 <= c <= 122 else 2 if 48 <= c <= 57 else 4 if c == 10 else 3 if c in (9, 13, 32) else 5 if c > 127 else 6 + c % 58 for c in range(256)])
_CLASSES = 64
WIDTH = _CLASSES + PAIRS + 4


_LINE = re.compile(rb"[^\n]+")


def passages(text: bytes | None) -> Iterator[bytes]:
    """The passages of a text one by one."""
    none = True
    for m in _LINE.finditer(text or b""):
        line = m.group()
        if not line.isspace():
            none = False
            for a in range(0, len(line), PASSAGE):
                yield line[a : a + PASSAGE]
    if none:
        yield b""


def spaced(text: bytes | None, most: int = FIT_PASSAGES) -> list[bytes]:
    """At most so many passages of a text, evenly spaced."""
    n = sum(1 for _ in passages(text))
    return list(islice(passages(text), 0, None, -(-n // most)))


def encode(parts: list[bytes]) -> np.ndarray:
    """A row of WIDTH features for each passage."""
    n = len(parts)
    sizes = np.array([len(p) for p in parts])
    b = np.frombuffer(b"".join(parts), np.uint8)
    own = np.repeat(np.arange(n), sizes)
    scale = np.maximum(sizes, 1)[:, None]
    shares = np.bincount(own * _CLASSES + _CLASS[b], minlength=n * _CLASSES).reshape(n, _CLASSES) / scale
    out = np.zeros((n, WIDTH), np.float32)
    out[:, :_CLASSES] = np.sqrt(shares)
    if len(b) > 1:
        inside = own[1:] == own[:-1]
        code = (b[:-1].astype(np.uint32) << 8 | b[1:]) * np.uint32(2654435761)
        row = own[1:][inside]
        wide = np.bincount(row * 512 + (code[inside] >> np.uint32(23)), minlength=n * 512).reshape(n, 512)
        pairs = wide.reshape(n, PAIRS, 512 // PAIRS).sum(2)
        out[:, _CLASSES : _CLASSES + PAIRS] = np.sqrt(pairs / scale)
        out[:, -4] = (wide > 0).sum(1) / np.sqrt(scale[:, 0])
        out[:, -3] = wide.max(1) / scale[:, 0]
    words = [p.split() for p in parts]
    out[:, -2] = [len(set(w)) / max(1, len(w)) for w in words]
    out[:, -1] = np.log1p(sizes) / 6
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def _forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        w = self.weights
        h = np.tanh(x @ w["E"] + w["e"])
        v, u = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        raw = (v * u) @ w["a"]
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        raw = np.exp(raw - np.maximum.reduceat(raw, starts)[bag])
        alpha = raw / np.add.reduceat(raw, starts)[bag]
        z = np.add.reduceat(alpha[:, None] * h, starts)
        return h, v, u, bag, alpha, z, _sigmoid(z @ w["o"] + w["b"])

    def scores(self, texts: Iterable[bytes | None]) -> list[float]:
        """The scores of texts; the softmax over a text's passages is summed up from block to block."""
        w = self.weights
        top, total, sums = [], [], []
        every = ((i, p) for i, t in enumerate(texts) for p in passages(t))
        while some := list(islice(every, BLOCK)):
            own = np.array([i for i, _ in some])
            h = np.tanh((encode([p for _, p in some]) - self.mean) / self.scale @ w["E"] + w["e"])
            raw = (np.tanh(h @ w["V"]) * _sigmoid(h @ w["U"])) @ w["a"]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            most = np.maximum.reduceat(raw, starts)
            part = np.exp(raw - np.repeat(most, np.diff(np.append(starts, len(own)))))
            for i, m, n, z in zip(own[starts].tolist(), most.tolist(), np.add.reduceat(part, starts).tolist(), np.add.reduceat(part[:, None] * h, starts), strict=True):
                if i == len(top):
                    top.append(m)
                    total.append(n)
                    sums.append(z)
                else:
                    high = max(m, top[i])
                    old, new = np.exp(top[i] - high), np.exp(m - high)
                    top[i], total[i], sums[i] = high, total[i] * old + n * new, sums[i] * old + z * new
        return _sigmoid(np.array(sums) / np.array(total)[:, None] @ w["o"] + w["b"]).tolist() if top else []

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        h, v, u, bag, alpha, z, p = self._forward(x, starts)
        d = (p - y) / len(y)
        dz = d[:, None] * w["o"]
        dalpha = (h * dz[bag]).sum(1)
        draw = alpha * (dalpha - np.add.reduceat(alpha * dalpha, starts)[bag])
        dg = draw[:, None] * w["a"]
        dv, du = dg * u * (1 - v * v), dg * v * u * (1 - u)
        dh = (alpha[:, None] * dz[bag] + dv @ w["V"].T + du @ w["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "a": (v * u).T @ draw, "o": z.T @ d, "b": np.array(d.sum())}


def train(bags: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Model | None:
    """Fits the network by Adam; None if there is nothing to learn from."""
    if not bags:
        return None
    rng = np.random.default_rng(seed)
    n = sum(map(len, bags))
    mean = sum(b.sum(0, dtype=np.float64) for b in bags) / n
    scale = np.sqrt(sum(((b - mean) ** 2).sum(0) for b in bags) / n) + 1e-3
    start = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    prior = np.clip(y.mean(), 0.01, 0.99)
    weights = {"E": start(WIDTH, HIDDEN), "e": np.zeros(HIDDEN), "V": start(HIDDEN, GATE), "U": start(HIDDEN, GATE), "a": start(GATE), "o": start(HIDDEN), "b": np.array(np.log(prior / (1 - prior)))}
    model = Model(mean, scale, weights)
    m, s, t = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2)), None, 0
    first, second = m
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for a in range(0, len(order), BAGS):
            some = order[a : a + BAGS]
            sizes = [len(bags[i]) for i in some]
            got = model.gradients((np.concatenate([bags[i] for i in some]) - mean) / scale, np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(int), y[some])
            t += 1
            for k, g in got.items():
                g = g + DECAY * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    for k in weights:
        weights[k] = weights[k].astype(np.float32)
    model.mean, model.scale = mean.astype(np.float32), scale.astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model | None:
    """Learns labels.quality from the documents of the same doc_id."""
    arrow_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("key"), "quality")
    n = known.count()
    if not n:
        return None
    some = known.where(F.pmod(F.xxhash64("key", F.lit("quality")), F.lit(1 << 20)) < min(1.0, sample / n) * (1 << 20))
    # About `sample` rows, twice that at most: small enough to broadcast.
    some = some.groupBy("key").agg(F.avg("quality").alias("quality")).orderBy(F.xxhash64("key"), "key").limit(2 * sample)
    joined = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [encode(spaced(t)).astype(np.float16).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["doc_id", "quality", "bag"])

    rows = sorted((r["doc_id"], bytes(r["bag"]), r["quality"]) for r in joined.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality double, bag binary").toLocalIterator())
    return train([np.frombuffer(b, np.float16).reshape(-1, WIDTH) for _, b, _ in rows], np.array([float(q >= 0.5) for _, _, q in rows]))


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            got = [0.5] * len(texts) if shared.value is None else shared.value.scores(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64()), pa.array([int(x >= GOOD) for x in got], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return lean.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labels that are not held out and scores all documents: the result of op8."""
    return scores(docs, fit(docs, labels.where(~held_out(F.col("doc_id")))))
