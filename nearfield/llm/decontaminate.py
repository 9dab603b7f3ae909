"""Benchmark decontamination: finds and removes passages of benchmark items in documents.

A broadcast hash set holds the word n-grams of the benchmark. Documents stream past it; a rolling
hash proposes positions and the word ids of each are compared, so that no hash collision counts.

The set is broadcast only while it has at most ``MAX_WINDOWS`` windows. Beyond that a bitmap of fixed size
is, which keeps nearly all n-grams that no item has from the shuffle; the others and the windows meet in
a join on 128 hash bits.

Defined results. Null or wordless text: no words, nothing hit. Items without words have no
windows; items with a null id are left out. Several rows of one item_id are one item. Equal
document rows each get their own row, so do rows that share a doc_id or have none. An empty benchmark hits
nothing, an empty table of documents makes no rows. Texts may be of any length: time and memory are in
proportion to them. Columns of any name stay as they are in `decontaminate`; `scan` reads doc_id and text only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm._shared import arrow_batches, private, stage
from nearfield.llm.neardup import Shingler

#: Words of a window, and the windows (some 500 bytes each in a worker) that a broadcast may hold.
WINDOW, MAX_WINDOWS = 8, 200_000
#: Bits of the bitmap of windows where they are more; bytes of texts that are scanned at once.
BITMAP, SLICE = 1 << 27, 1 << 20
#: Items from which a document counts as contaminated.
MIN_ITEMS = 2

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lower-cases A-Z and blanks what no word holds; bytes over 0x7F belong to words.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)
_FOLD_TEXT = {c: c + 32 for c in range(65, 91)}
_END = b"\x01"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def windows(text: bytes | None, n: int = WINDOW) -> list[tuple[bytes, ...]]:
    w = words(text)
    return [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


class WindowSet:
    """The windows of all items as integer word ids, sorted by hash for each window length."""

    def __init__(self, items: Iterable[tuple[object, bytes | None]], n: int = WINDOW):
        owners: dict[tuple[bytes, ...], set] = {}
        for item, text in items:
            for w in windows(text, n):
                owners.setdefault(w, set()).add(item)
        self.ids: dict[bytes, int] = {}
        for w in owners:
            for x in w:
                self.ids.setdefault(x, len(self.ids) + 1)
        self.ids[_END] = 0
        self.by_length = []
        for length in sorted({len(w) for w in owners}):
            rows = [w for w in owners if len(w) == length]
            grid = np.array([[self.ids[x] for x in w] for w in rows], np.int64)
            codes = self._roll(grid.ravel(), length)[::length]
            order = np.argsort(codes, kind="stable")
            present = np.zeros(1 << 16, bool)
            present[(codes >> np.uint64(48)).astype(np.int64)] = True
            self.by_length.append((length, codes[order], grid[order], [owners[rows[i]] for i in order], present))

    @staticmethod
    def _roll(ids: np.ndarray, n: int) -> np.ndarray:
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        m = len(x) - n + 1
        out = np.zeros(max(m, 0), np.uint64)
        for k in range(n):
            out *= _MULTIPLIER
            out += x[k : k + m]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out

    def scan(self, texts: list[bytes | None]) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
        """For each text: its number of words, the hit runs [from, to) in words, the items found.

        So many texts at once as make SLICE bytes, as their words stand in memory one by one.
        """
        some, held = [], 0
        for t in texts:
            some.append(t)
            held += len(t or b"")
            if held >= SLICE:
                yield from self._scan(some)
                some, held = [], 0
        if some:
            yield from self._scan(some)

    def _scan(self, texts: list[bytes | None]) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
        joined = b" \x01 ".join((t or b"").translate(_FOLD) for t in texts) + b" \x01"
        tokens = joined.split()
        #: 0 ends a text, -1 is a word of no window.
        ids = np.fromiter(map(self.ids.get, tokens, repeat(-1)), np.int64, len(tokens))
        ends = np.flatnonzero(ids == 0)
        starts = np.concatenate(([0], ends[:-1] + 1))
        breaks = np.concatenate(([0], np.cumsum(ids <= 0)))
        cover = np.zeros(len(ids) + 1, np.int64)
        found: dict[int, set] = {}
        for length, codes, grid, owners, present in self.by_length:
            if len(ids) < length:
                continue
            whole = np.flatnonzero(breaks[length:] == breaks[:-length])
            if not len(whole):
                continue
            rolled = self._roll(ids, length)[whole]
            maybe = present[(rolled >> np.uint64(48)).astype(np.int64)]
            at, rolled = whole[maybe], rolled[maybe]
            first, last = np.searchsorted(codes, rolled, "left"), np.searchsorted(codes, rolled, "right")
            for p, a, b in zip(at[first < last], first[first < last], last[first < last], strict=True):
                for k in range(a, b):
                    if np.array_equal(grid[k], ids[p : p + length]):
                        cover[p] += 1
                        cover[p + length] -= 1
                        found.setdefault(int(np.searchsorted(ends, p)), set()).update(owners[k])
        hit = np.cumsum(cover)[:-1] > 0
        for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
            runs: list[tuple[int, int]] = []
            if i in found:
                edges = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:b].view(np.int8), [0]))))
                runs = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
            yield int(b - a), runs, found.get(i, set())


def cut(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the given runs of words; what stands between a run's words goes too."""
    spans = [m.span() for m in re.finditer(WORD, text.translate(_FOLD_TEXT))]
    out, at = [], 0
    for a, b in runs:
        out.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return "".join([*out, text[at:]])


def items_digest(items: Iterable[object]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def _n_words(text: Column) -> Column:
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.regexp_count(folded, F.lit(WORD)), F.lit(0))


def _item_texts(benchmark: DataFrame) -> DataFrame:
    return benchmark.where(F.col("item_id").isNotNull()).select("item_id", F.col("text").cast("binary").alias("text"))


def window_set(spark: SparkSession, benchmark: DataFrame, n: int, max_windows: int) -> WindowSet | None:
    """The set of windows, or None if there may be more than a broadcast should hold."""
    items = _item_texts(benchmark)
    bound = items.agg(F.sum(F.greatest(F.lit(1), _n_words(F.col("text").cast("string")) - n + 1))).first()[0] or 0
    if bound > max_windows:
        return None
    return WindowSet(((r[0], None if r[1] is None else bytes(r[1])) for r in items.collect()), n)


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first:long,after:long>>"


def scan(docs: DataFrame, benchmark: DataFrame, *, n: int = WINDOW, min_items: int = MIN_ITEMS, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """What each document shares with the benchmark: one row per document, see the contract of op1.

    ``spans`` holds the runs of hit words as half-open word ranges.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    known = window_set(spark, benchmark, n, max_windows)
    if known is None:
        return _scan_by_join(texts, benchmark, n, min_items)
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(shared.value.scan(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([w for w, _, _ in got], pa.int64()),
                    pa.array([sum(b - a for a, b in r) for _, r, _ in got], pa.int64()),
                    pa.array([len(i) for _, _, i in got], pa.int64()),
                    pa.array([items_digest(i) for _, _, i in got], pa.string()),
                    pa.array([len(i) >= min_items for _, _, i in got], pa.bool_()),
                    pa.array([[{"first": a, "after": b} for a, b in r] for _, r, _ in got], pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    return texts.mapInArrow(run, SCHEMA)


def _codes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A place in the bitmap for each n-gram, from the hashes of words."""
    out = np.full(max(0, len(hashes) - length + 1), length, np.uint64)
    for k in range(length):
        out = out * _MULTIPLIER + hashes[k : k + len(out)]
    out ^= out >> np.uint64(32)
    return (out * _MULTIPLIER) >> np.uint64(64 - (BITMAP.bit_length() - 1))


def _grams(texts: DataFrame, key: str, n: int, lengths: list[int] | None, bits: Broadcast | None = None) -> DataFrame:
    """The n-grams (key, at, length, 128-bit digest, code) of texts: an item's windows if `lengths` is None, else
    those of these lengths that have their bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        known = None if bits is None else np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            kind = batch.column(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(t)
                hashes = shingler._words(w) if w else np.zeros(0, np.uint64)
                for length in lengths if lengths is not None else [min(n, len(w))] if w else []:
                    codes = _codes(hashes, length)
                    places = np.flatnonzero(known[codes]) if known is not None else np.arange(len(codes))
                    for a in range(0, len(places), 1 << 16):
                        at = places[a : a + (1 << 16)]
                        digests = [hashlib.md5(b" ".join(w[i : i + length])).digest() for i in at.tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([k] * len(at), kind), pa.array(at, pa.int64()), pa.array([length] * len(at), pa.int64()), pa.array(digests, pa.binary()), pa.array(codes[at].astype(np.int64))],
                            names=["key", "at", "length", "digest", "code"],
                        )

    kind = dict(texts.dtypes)[key]
    return texts.select(key, "text").mapInArrow(run, f"key {kind}, at long, length long, digest binary, code long")


def _bitmap(wanted: DataFrame) -> bytes:
    """The bits of all windows' codes; the driver gets a row for each byte with a bit set, BITMAP / 8 at most."""
    out = np.zeros(BITMAP >> 3, np.uint8)
    byte, bit = F.call_function("shiftright", F.col("code"), F.lit(3)), F.call_function("shiftleft", F.lit(1), (F.col("code") % 8).cast("int"))
    rows = wanted.groupBy(byte.alias("byte")).agg(F.bit_or(bit).cast("int").alias("bits")).toArrow()
    out[rows.column("byte").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint8)
    return out.tobytes()


def _row_key() -> Column:
    """A row's id and the digest of its text, null-safe: rows that agree in both have one result."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("-")))


_SPANS = "array<struct<first:long,after:long>>"


def _merged(found: DataFrame) -> DataFrame:
    """(row, items, n_hit, spans): runs of a document's hit words, from the places and lengths of its hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, spans = [], []
            for runs in batch.column(2).to_pylist():
                first = np.array([r["at"] for r in runs])
                after = first + np.array([r["length"] for r in runs])
                order = np.argsort(first, kind="stable")
                first, reach = first[order], np.maximum.accumulate(after[order])
                begins = np.flatnonzero(np.concatenate(([True], first[1:] > reach[:-1])))
                a, b = first[begins], reach[np.append(begins[1:] - 1, len(first) - 1)]
                n_hit.append(int((b - a).sum()))
                spans.append([{"first": x, "after": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array(spans, kind)], names=["row", "items", "n_hit", "spans"])

    return found.select("row", "items", "runs").mapInArrow(run, f"row string, items array<string>, n_hit long, spans {_SPANS}")


def _hits(rows: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """(row, items, n_hit, spans) of the rows that share a window with the benchmark, by their key `row`."""
    spark = rows.sparkSession
    wanted = stage(_grams(_item_texts(benchmark), "item_id", n, None).select(F.col("key").alias("item_id"), "length", "digest", "code").distinct(), "decontaminate-windows")
    lengths = sorted(r[0] for r in wanted.select("length").distinct().collect())  # n at most
    bits = spark.sparkContext.broadcast(_bitmap(wanted.select("code").distinct()))
    grams = _grams(rows, "row", n, lengths, bits).select(F.col("key").alias("row"), "at", "length", "digest").distinct()
    met = stage(grams.join(wanted.select("length", "digest").distinct(), ["length", "digest"]), "decontaminate-hits")
    # Windows that many items hold meet documents once each, without their places.
    items = met.select("row", "length", "digest").distinct().join(wanted.select("item_id", "length", "digest"), ["length", "digest"])
    items = items.select("row", F.col("item_id").cast("string").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))  # the items of one document
    runs = met.groupBy("row").agg(F.collect_list(F.struct("at", "length")).alias("runs"))  # the places of one document
    return _merged(items.join(runs, "row"))


def _scan_by_join(texts: DataFrame, benchmark: DataFrame, n: int, min_items: int) -> DataFrame:
    """The same result for a benchmark of any size; AQE splits windows that many documents hold."""
    rows = texts.withColumn("row", _row_key())
    found = _hits(rows, benchmark, n)
    counted = rows.select("doc_id", "row", _n_words(F.col("text").cast("string")).cast("long").alias("n_words"))
    n_items = F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long")
    return counted.join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), n_items.alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", F.array().cast("array<string>")), ","), 256).alias("items_sha256"),
        (n_items >= min_items).alias("contaminated"), F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = WINDOW, min_items: int = MIN_ITEMS, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents without contaminated ones; the others lose the hit spans. Columns stay as they are.

    Where the benchmark exceeds the broadcast bound, the spans come from the join and are brought
    back to the documents by id and text, so both ways give the same rows.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    known = window_set(spark, benchmark, n, max_windows)
    at = docs.columns.index("text")
    if known is None:
        name = private(docs)
        keyed = docs.withColumn(name("row"), _row_key())
        # Rows of one key have equal texts, and so equal spans.
        found = _hits(keyed.select(F.col(name("row")).alias("row"), F.col("text").cast("binary").alias("text")), benchmark, n)
        hit = found.select(F.col("row").alias(name("of")), (F.size("items") >= min_items).alias(name("bad")), F.col("spans").alias(name("spans")))
        kept = keyed.join(hit, F.col(name("row")) == F.col(name("of")), "left").where(F.col(name("bad")).isNull() | ~F.col(name("bad")))

        def cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans = batch.column(batch.num_columns - 1).to_pylist()
                clean = [cut(t, [(x["first"], x["after"]) for x in s]) if s else t for t, s in zip(batch.column(at).to_pylist(), spans, strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))
                yield batch.select(list(range(batch.num_columns - 1)))

        return kept.select(*docs.columns, name("spans")).mapInArrow(cut_spans, docs.schema)
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep, clean = [], []
            for text, (_, runs, items) in zip(texts, shared.value.scan([t.encode() if t is not None else None for t in texts]), strict=True):
                keep.append(len(items) < min_items)
                clean.append(cut(text, runs) if runs and len(items) < min_items else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type)).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
