"""Token ids as word-aligned binary files.

Ids are packed by Simple-8b: the top four bits of each 64-bit word select how many ids of how many
bits the other sixty hold. Selector 0 is an escape for a value of over sixty bits: the word holds its
place in the block's list of raw values. Every ``BLOCK`` ids begin a new word, and a table of the
words at which blocks begin lets a reader decode any of them, or all at once.

A record has a header, the documents' ids and lengths, the block table, the escapes and the words.
Records follow each other in ascending doc_id, file by file: documents are dealt to ranges of ids,
each range is one partition and its part number is in every header.

Defined results. Null text is an empty one, so its only id is the end id. Null doc_ids come first;
equal ones are in the order of their texts, an id that fills several ranges in the order of its parts. An empty
table makes no files and no rows. Texts may be of any length: a record ends with the document that fills it.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearfield.llm._files import read_files, write_records
from nearfield.llm._shared import arrow_batches, id_ranges, new_path, stage

#: Fixed by the format: ids of a word by selector, bits of each, end mark of a record.
COUNTS = np.array([1, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
MAGIC, END = b"NF8B", "\r\nNF8E\r\n"
#: Ids of a block, ids of a record, records of a file, documents of a range of ids.
BLOCK, RECORD, FILE_RECORDS, RANGE_ROWS = 1024, 1 << 19, 16, 20_000
#: The id that ends each document, and the tokenizer file.
END_ID, TOKENIZER = 2, "byte_bpe_50k.json"

_HEADER = np.dtype([("part", "<i8"), ("before", "<i8"), ("docs", "<i8"), ("ids", "<i8"), ("blocks", "<i8"), ("escapes", "<i8"), ("words", "<i8")])


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each value, 1 at least."""
    exponent = lambda x: (x.astype(np.float64).view(np.int64) >> 52) - 1022  # noqa: E731  exact below 2**53
    if not len(ids) or ids.max() < 1 << 32:
        return np.maximum(exponent(ids), 1).astype(np.uint8)
    high = ids >> np.uint64(32)
    return np.maximum(np.where(high > 0, exponent(high) + 32, exponent(ids & np.uint64(0xFFFFFFFF))), 1).astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Simple-8b of the ids: (words, the word at which each block begins, escaped values)."""
    n = len(ids)
    ids = ids.astype(np.uint64)
    blocks = -(-n // BLOCK)
    # Behind a block stand zero-bit places, so its last word may be short and none runs into the next.
    wide = np.zeros((blocks, BLOCK + 60), np.uint8)
    flat = np.zeros(blocks * BLOCK, np.uint8)
    flat[:n] = _widths(ids)
    wide[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    best = np.where(wide[:, :BLOCK] > 60, np.uint8(0), np.uint8(15))
    # From few ids a word to many: what fits last is the best. The widest value of a window comes from two halves.
    power, widest = 1, wide
    for s in range(14, 1, -1):
        count, bits = int(COUNTS[s]), int(BITS[s])
        while power * 2 <= count:
            widest = np.maximum(widest[:, :-power], widest[:, power:])
            power *= 2
        rest = count - power
        fits = np.maximum(widest[:, :BLOCK], widest[:, rest : rest + BLOCK]) <= bits
        np.copyto(best, np.uint8(s), where=fits)
    # All blocks step from word to word together.
    steps = COUNTS[best.ravel()]
    now = np.arange(blocks) * BLOCK
    stop = np.minimum(now + BLOCK, n)
    grid = []
    while (live := now < stop).any():
        grid.append(np.where(live, now, -1))
        now = np.where(live, np.minimum(now + steps[np.minimum(now, blocks * BLOCK - 1)], stop), now)
    first = np.stack(grid, 1) if grid else np.zeros((0, 0), np.int64)
    held = (first >= 0).sum(1)
    begins = np.cumsum(held) - held
    first = first[first >= 0]
    edge = np.minimum((first // BLOCK + 1) * BLOCK, n)
    chosen = best.ravel()[first]
    words = np.zeros(len(first), np.uint64)
    escaped = ids[first[chosen == 0]]
    words[chosen == 0] = np.arange(len(escaped), dtype=np.uint64)
    padded = np.concatenate((ids, np.zeros(60, np.uint64)))
    for s in np.unique(chosen):
        if s:
            rows = np.flatnonzero(chosen == s)
            begin, end = first[rows], edge[rows]
            word = np.full(len(rows), int(s) << 60, np.uint64)
            for k in range(COUNTS[s]):
                word |= np.where(begin + k < end, padded[begin + k], np.uint64(0)) << np.uint64(k * BITS[s])
            words[rows] = word
    return words, begins.astype(np.int64), escaped


def unpack(words: np.ndarray, begins: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The n ids of all blocks."""
    out = np.zeros(n, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    block = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(words))))
    filled = np.cumsum(COUNTS[chosen]) - COUNTS[chosen]
    at = block * BLOCK + filled - (filled[begins][block] if len(words) else 0)
    edge = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        if s == 0:
            out[at[rows]] = escaped[words[rows].astype(np.int64)]
            continue
        grid = at[rows][:, None] + np.arange(COUNTS[s])
        values = (words[rows][:, None] >> (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)) & np.uint64((1 << int(BITS[s])) - 1)
        inside = grid < edge[rows][:, None]
        out[grid[inside]] = values[inside]
    return out


def record(part: int, before: int, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, begins, escaped = pack(ids)
    head = np.zeros(1, _HEADER)
    head[0] = (part, before, len(doc_ids), len(ids), len(begins), len(escaped), len(words))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join((MAGIC, head.tobytes(), known.tobytes(), numbers.tobytes(), np.array(lengths, "<i8").tobytes(), begins.astype("<i8").tobytes(), escaped.astype("<u8").tobytes(), words.astype("<u8").tobytes()))


def records_of(content: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """The records of a file: (part, ids before it in its part, doc ids, lengths, ids)."""
    at = 0
    while at < len(content):
        if content[at : at + 4] != MAGIC:
            raise ValueError(f"no record at byte {at}")
        at += 4
        head = np.frombuffer(content, _HEADER, 1, at)[0]
        at += _HEADER.itemsize
        fields = []
        for kind, n in (("u1", head["docs"]), ("<i8", head["docs"]), ("<i8", head["docs"]), ("<i8", head["blocks"]), ("<u8", head["escapes"]), ("<u8", head["words"])):
            fields.append(np.frombuffer(content, kind, int(n), at))
            at += fields[-1].nbytes
        if content[at : at + len(END)] != END.encode():
            raise ValueError(f"record without an end at byte {at}")
        at += len(END)
        known, numbers, lengths, begins, escaped, words = fields
        docs = [int(d) if k else None for d, k in zip(numbers, known, strict=True)]
        yield int(head["part"]), int(head["before"]), docs, lengths, unpack(words, begins, escaped, int(head["ids"]))


#: The byte-level splitting rule, a fixed value of this tokenizer, with its character classes (letters,
#: digits) spelt out for the texts of _PLAIN: Latin letters, marks and plain blanks.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ſ]+| ?[0-9²³¹¼½¾]+| ?[^\sA-Za-z0-9ªµºÀ-ÖØ-öø-ſ²³¹¼½¾]+|\s+(?!\S)|\s+"
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ſ]*")
#: Pre-tokens that a worker remembers, in two halves, and characters of those that it does.
_MEMO, _MEMO_CHARS = 800_000, 32


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves,
    the others for the letters from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


class _Memo(dict):
    """The ids of pre-tokens as bytes; the library's model makes those that are missing, at some 25 times the cost.

    Where a half is full it becomes the older one, whose pre-tokens come back when they are met again: only those
    that weren't met for a half's time are forgotten, so frequent ones are made once.
    """

    def __init__(self, model) -> None:
        super().__init__()
        self.model, self.letters, self.older = model, _byte_letters(), {}
        self.blank = chr(self.letters[32])

    def __missing__(self, part: str) -> bytes:
        if len(self) >= _MEMO // 2:
            self.older = dict(self)
            self.clear()
        if part in self.older:
            made = self[part] = self.older[part]
            return made
        if part.isascii() and part[-1].isalpha():  # a word, behind a blank perhaps
            spelt = part.replace(" ", self.blank)
        else:
            spelt = part.encode().decode("latin-1").translate(self.letters)
        made = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        if len(part) <= _MEMO_CHARS:
            self[part] = made
        return made


class Encoder:
    """The tokenizers library behind a memo of pre-tokens.

    Byte-level BPE never merges across pre-tokens, so a text's ids are those of its pre-tokens in
    turn. Each distinct pre-token is encoded by the library's model once. Texts with other characters,
    or with a special token in them, go through the whole library; so do all texts if the file's
    splitting rule or normalizer is another one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        rules = json.loads(self.library.to_str())
        first = rules["pre_tokenizer"] or {}
        self.known_rule = rules["model"]["type"] == "BPE" and rules["normalizer"] is None and (first.get("type"), first.get("add_prefix_space"), first.get("use_regex")) == ("ByteLevel", False, True)
        self.split = re.compile(_SPLIT).findall
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memo = _Memo(self.library.model)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if not self.known_rule or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.memo.__getitem__, self.split(text)))


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """One encoder a worker process; `name` is a file of the installed public tokenizers, or a path."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if not os.path.isabs(name):
        import public_tokenizers

        name = str(public_tokenizers.path(name))
    return Encoder(name)


def write(docs: DataFrame, path: str, *, tokenizer: str = TOKENIZER, end_id: int = END_ID, rows: int = RANGE_ROWS) -> None:
    """Encodes the texts and writes the files. Texts are shuffled once, by range of id."""
    arrow_batches(docs.sparkSession)
    ranges = id_ranges(docs, "doc_id", rows)
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), ranges.part(F.col("doc_id"), F.col("text").cast("binary")).alias("part"))
    dealt = placed.repartitionById(len(ranges.leads), F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, before = encoder(tokenizer), 0
        end = np.array([end_id], "<u4").tobytes()
        part, ids, lengths, chunks, held = 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, lengths, chunks, held, before
            made = record(part, before, ids, lengths, np.frombuffer(b"".join(chunks), "<u4"))
            before += held
            ids, lengths, chunks, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["record"])

        for batch in batches:
            numbers, texts, parts = (batch.column(i).to_pylist() for i in range(3))
            for doc, text, p in zip(numbers, texts, parts, strict=True):
                got, part = known.encode((text or b"").decode("utf-8", "replace")) + end, p
                ids.append(doc)
                chunks.append(got)
                lengths.append(len(got) // 4)
                held += len(got) // 4
                if held >= RECORD:
                    yield flush()
        if ids:
            yield flush()

    write_records(dealt.mapInArrow(run, "record binary"), "record", path, END, FILE_RECORDS)


DOC_SCHEMA = "part long, doc_id long, at long, n_tokens long, ids_crc32 long"


def read(spark, path: str, *, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: its part, place in the part, number of ids and their crc32,
    and with `with_ids` the ids themselves."""
    arrow_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                for part, before, docs, lengths, ids in records_of(content):
                    ends = np.cumsum(lengths)
                    starts = ends - lengths
                    raw = ids.astype("<u4").tobytes()
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    columns = [pa.array([part] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(starts + before, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                    names = ["part", "doc_id", "at", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(starts, ends, strict=True)], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return read_files(spark, path).select("content").mapInArrow(run, DOC_SCHEMA + ", ids array<long>" * with_ids)


def digest(docs: DataFrame) -> DataFrame:
    """Writes the files, reads them back and returns the result of op9."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write(docs, path)
    if not any(True for _ in _parts(spark, path)):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = stage(read(spark, path), "token-rows")
    # One row a part in this window, of which there are MOST_RANGES or little more at most.
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _parts(spark, path: str):
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder):
        if f.getPath().getName().startswith("part-"):
            yield f
