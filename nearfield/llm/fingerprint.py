"""Document fingerprints by Order MinHash.

Every k-mer of a text is numbered by its occurrence, so repeats count. A hash deals the numbered
k-mers to ``BINS`` bins and ranks them there (the one-permutation form of as many independent
orders); each bin selects its ``TUPLE`` least ones, puts them back into text order and hashes the
tuple. Moving, dropping or repeating text changes tuples, so the share of equal tuples falls with
the edit distance, not only with the set of k-mers.

A bin without enough k-mers uses those it has, and an empty one a constant; likeness is counted over
bins that are filled on either side, so short texts are compared by what they have.

Defined results. Null text is an empty one. Texts shorter than a k-mer are one k-mer. Equal texts
have equal fingerprints; two empty texts have likeness 1. Texts of any length have one rule. Null doc_ids
come first; rows that share a doc_id follow each other by their texts. The next document of a single one is
itself; an empty table makes no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm._shared import arrow_batches, id_ranges

#: Code points of a k-mer, k-mers of a tuple, tuples of a fingerprint, bytes kept of each tuple's hash.
K, TUPLE, BINS, KEPT = 16, 2, 64, 3
#: Documents of a range of ids, unless the ranges would be too many.
RANGE_ROWS = 20_000

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_POS = np.uint64(24)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def kmer_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit polynomial hash of each k-mer, by doubling the length (k is a power of two)."""
    h = _mix(points.astype(np.uint64) + np.uint64(1))
    if len(h) < k:
        h = np.concatenate((h, np.zeros(k - len(h), np.uint64)))
    span, power = 1, _A
    while span < k:
        h = h[:-span] * power + h[span:]
        with np.errstate(over="ignore"):
            power = power * power
        span *= 2
    return _mix(h)


def _occurrences(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k-mers sorted by hash then position: (occurrence-numbered hash, position)."""
    n = len(h)
    if n < 1 << 24:
        packed = np.sort((h >> _POS << _POS) | np.arange(n, dtype=np.uint64))
        at, code = packed & np.uint64((1 << 24) - 1), packed >> _POS
    else:
        at = np.argsort(h >> _POS, kind="stable").astype(np.uint64)
        code = h[at] >> _POS
    place = np.arange(n, dtype=np.uint64)
    first = np.maximum.accumulate(np.where(np.concatenate(([True], code[1:] != code[:-1])), place, 0))
    return _mix(code * _A + (place - first) * _B), at


def signature(points: np.ndarray) -> np.ndarray:
    """The fingerprint as BINS integers under 2**24; 0 for an empty bin."""
    out = np.zeros(BINS, np.uint64)
    if not len(points):
        return out
    code, at = _occurrences(kmer_hashes(points))
    # Ranked by the top 40 bits of the hash, ties by position in the table of sorted k-mers: one rule for texts of any length.
    if len(code) < 1 << 24:
        order = (np.sort((code >> _POS << _POS) | np.arange(len(code), dtype=np.uint64)) & np.uint64((1 << 24) - 1)).astype(np.int64)
    else:
        order = np.argsort(code >> _POS, kind="stable")
    # The top six bits are the bin, so the sorted k-mers are grouped by bin, least first.
    bins = (code[order] >> np.uint64(58)).astype(np.int64)
    starts = np.searchsorted(bins, np.arange(BINS + 1))
    chosen = np.minimum(starts[:-1, None] + np.arange(TUPLE)[None, :], len(order) - 1)
    valid = starts[:-1, None] + np.arange(TUPLE)[None, :] < starts[1:, None]
    picks = order[chosen]
    where = np.where(valid, at[picks].astype(np.int64), np.iinfo(np.int64).max)
    values = np.where(valid, code[picks], np.uint64(0))
    in_text = np.take_along_axis(values, np.argsort(where, axis=1, kind="stable"), 1)
    for j in range(TUPLE):
        out = _mix(out * _A + in_text[:, j] + np.uint64(j + 1))
    out = (out >> np.uint64(64 - 8 * KEPT)) | np.uint64(1)
    return np.where(valid[:, 0], out, np.uint64(0))


def encode(sig: np.ndarray) -> str:
    return base64.b64encode(sig.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEPT :].tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a != 0) | (b != 0)
    n = int(filled.sum())
    return float((a == b)[filled].sum() / n) if n else 1.0


def points_of(text: bytes | None) -> np.ndarray:
    return np.frombuffer((text or b"").decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)


def edited(text: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The text with its last quarter replaced by as much of the start of another."""
    q = len(text) // 4
    return np.concatenate((text[: len(text) - q], other[:q]))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """The documents dealt to ranges of ids, each partition in ascending order and ended by the first
    document of the next range (``ahead``); the last range ends with the table's first document.

    Only one shuffle moves texts. What it needs of the table beforehand are the ids alone: the bounds of the
    ranges and the least id in each. Null ids come first; equal ids are in the order of their texts, those of
    an id that has several parts in the order of the parts.
    """
    known = id_ranges(docs, "doc_id", rows)
    ranges = len(known.leads)
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    placed = placed.withColumn("part", known.part(F.col("doc_id"), F.col("text")))
    # A document that may be the first of its range goes to the range before as well; the last is before the first.
    leads = F.from_json(F.lit(json.dumps(known.leads)), "array<bigint>")
    copies = F.array(F.struct(F.col("part"), F.lit(False).alias("ahead")))
    before = F.pmod(F.col("part") + (ranges - 1), F.lit(ranges)).cast("int")
    ahead = F.array(F.struct(before.alias("part"), F.lit(True).alias("ahead")))
    copies = F.when(F.col("doc_id").eqNullSafe(F.get(leads, F.col("part"))), F.concat(copies, ahead)).otherwise(copies)
    dealt = placed.select("doc_id", "text", F.explode(copies).alias("c")).select("doc_id", "text", "c.part", "c.ahead")
    return dealt.repartitionById(ranges, F.col("part")).sortWithinPartitions("ahead", F.col("doc_id").asc_nulls_first(), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document, see the contract of op4."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ended = None, False
        for batch in batches:
            ids, texts, ahead = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for doc, text, is_ahead in zip(ids, texts, ahead, strict=True):
                if ended:
                    break
                points = points_of(text)
                now = (doc, points, signature(points))
                if held is not None:
                    out.append(_result(held, now))
                held, ended = now, is_ahead
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return with_next(docs).select("doc_id", "text", "ahead").mapInArrow(run, SCHEMA)


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _result(doc: tuple, after: tuple) -> dict:
    text = edited(doc[1], after[1])
    sig = signature(text)
    utf8 = text.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return {
        "doc_id": doc[0], "n_chars": len(doc[1]), "edited_sha256": hashlib.sha256(utf8).hexdigest(), "fingerprint": encode(doc[2]),
        "edited_fingerprint": encode(sig), "near_edited": likeness(doc[2], sig), "near_next": likeness(doc[2], after[2]),
    }
