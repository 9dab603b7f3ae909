"""Near-duplicate documents by MinHash bands and odd sketches.

Texts of equal shingle sets form a class. Each class gets ``BANDS * ROWS`` MinHash samples; classes
that agree in all rows of a band share a bucket. Classes that share a bucket with others are folded
into odd sketches, bitmaps of parities: a class of at most ``WHOLE`` shingles from all of them (a
sample as large as the set), a larger one from ``SAMPLES`` MinHash samples. The population count of
two sketches' XOR tells how much they differ. For whole sets it is never above the size of the
symmetric difference, so no link is lost to it; for samples the limit lies six standard deviations
off. Pairs that may be linked by their sizes and sketches are confirmed on the full sets.

A bucket may hold thousands of near copies, so its pairs are not all made. First each member is paired
with one hub, and confirmed links give members the label of their hub. Pairs under one label need no
comparison; hub rounds go on while the other pairs are more than in proportion to the members and become fewer. Then the pairs of a bucket of
at most ``MEMBERS`` members under different labels are compared, sketches inside the join, so that only pairs
that pass leave it. Members of larger buckets (a template that thousands of unlike texts share) meet
by their rarest shingles instead: sets of similarity t have a shingle in common among the (1 - t) share of
theirs that comes first in any one order of all shingles, so with rare ones first the common ones never make
pairs. The place of the shingle in both bounds how many more they can have in common, which drops pairs that
are merely alike. That search is exact, so no link that a bucket holds is missed.

Two sets at a threshold of 0.85 share no band with probability (1 - 0.85**4)**20 = 4e-7; at 0.8, with 3e-5.

Defined results. Null, empty and blank texts have no shingles and are linked with nothing; neither
are rows with a null doc_id, whose component is null and which are kept. Rows that share a doc_id are
linked by their own texts and get the component of their own class. An empty table makes no rows. Texts may be
of any length: sets are compared whole. Columns of any name stay as they are in `deduplicate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm._shared import arrow_batches, drop_staged, private, stage
from nearfield.llm.components import components

#: Words of a shingle; link if 100 * intersection >= link * union, with LINK where nothing else is said (op5).
SHINGLE, LINK = 5, 85
#: Bands and rows of the buckets; shingles that are folded whole; samples of larger sets; bits of a sketch.
BANDS, ROWS, WHOLE, SAMPLES, SKETCH_BITS = 20, 4, 1024, 400, 1024


def most_bits(samples: int = SAMPLES, bits: int = SKETCH_BITS, link: int = LINK) -> int:
    """Bits that the sketches of two sampled sets at the threshold may differ in: the mean for six
    standard deviations more differing samples than expected, and four deviations of the bits."""
    share = link / 100
    different = samples * (1 - share) + 6 * (samples * share * (1 - share)) ** 0.5
    mean = bits / 2 * (1 - (1 - 2 / bits) ** (2 * different))
    return round(mean + 4 * mean**0.5)


#: Hub rounds at most; pairs an entry from which another one follows, if the last one left no more than this share of them.
MOST_ROUNDS, PAIRS, WORTH = 8, 2, 0.9
#: Buckets of a member with whose hubs it is paired in a round, the largest first.
HUBS = 4
#: Members of a bucket whose pairs are all compared, so half as many comparisons an entry at most; bits of a shingle by which its kind is counted.
MEMBERS, COUNT_BITS = 2048, 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240501))
_XOR = _rng.integers(0, 1 << 63, SAMPLES, np.uint64)[:, None]
_MULTIPLY = (_rng.integers(0, 1 << 63, SAMPLES, np.uint64) << np.uint64(1) | np.uint64(1))[:, None]
#: Words that a worker remembers, and bytes of those that it does.
_MEMO, _MEMO_BYTES = 200_000, 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Shingle sets of texts as sorted 64-bit hashes; word hashes are remembered."""

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def _words(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        try:
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(memo) > _MEMO:
                memo.clear()
            long: dict[bytes, int] = {}
            for w in set(words):
                if w not in memo:
                    (memo if len(w) <= _MEMO_BYTES else long)[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
            return np.fromiter((long[w] if len(w) > _MEMO_BYTES else memo[w] for w in words), np.uint64, len(words))

    def of(self, text: bytes | None, n: int = SHINGLE) -> np.ndarray:
        words = (text or b"").translate(_FOLD).split()
        if not words:
            return np.zeros(0, np.uint64)
        h = self._words(words)
        n = min(n, len(h))
        code = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            code = code * _M + h[k : k + len(code)]
        return np.unique(_mix(code * _M + np.uint64(n)))


def samples(shingles: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """The first n MinHash samples of a set that is not empty."""
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 1024):  # keeps the grid in cache
        np.minimum(out, ((shingles[a : a + 1024][None, :] ^ _XOR[:n]) * _MULTIPLY[:n]).min(1), out=out)
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in sample.reshape(BANDS, ROWS).T:
        key = _mix(key * _M + column)
    return key.view(np.int64)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles, or of the numbered samples of a large set, each dealt to one bit."""
    if len(shingles) > WHOLE:
        shingles = samples(shingles, SAMPLES) + np.arange(1, SAMPLES + 1, dtype=np.uint64) * _M
    bit = _mix(shingles * _M + np.uint64(1)) % np.uint64(SKETCH_BITS)
    odd = (np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


_LONGS = pa.list_(pa.int64())


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_key (digest of the set, null for an empty one), bands."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            n, keys, bands = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingler.of(text)
                n.append(len(s))
                keys.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                bands.append(band_keys(samples(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, _LONGS)], names=["doc_id", "n_shingles", "class_key", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, class_key binary, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """class_key, n, sketch and the sorted set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a in range(0, len(texts), 256):
                sets = [s for s in map(shingler.of, texts[a : a + 256]) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([odd_sketch(s) for s in sets], _LONGS), pa.array([s.view(np.int64) for s in sets], _LONGS)],
                    names=["class_key", "n", "sketch", "shingles"],
                )

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "class_key binary, n long, sketch array<long>, shingles array<long>")


def _alike(a: str, b: str, link: int) -> Column:
    """Whether two classes may be linked by their sizes and sketches: columns n and sketch with these prefixes."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    bits = sum((F.bit_count(F.col(f"{a}sketch")[i].bitwiseXOR(F.col(f"{b}sketch")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    # Linked sets of n and m elements differ in (100 - link) * (n + m) / (100 + link) at most.
    limit = F.when(F.greatest(n, m) <= WHOLE, F.floor((100 - link) * (n + m) / (100 + link))).when(F.least(n, m) > WHOLE, F.lit(most_bits(link=link))).otherwise(F.lit(SKETCH_BITS))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * link) & (bits <= limit)


def _confirmed(pairs: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets."""
    for side in ("b", "a"):
        pairs = pairs.join(sets.select(F.col("class_key").alias(f"{side}_key"), F.col("shingles").alias(f"{side}_set")), F.col(side) == F.col(f"{side}_key"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.where(both * 100 >= (F.size("a_set") + F.size("b_set") - both) * link).select("a", "b").distinct()


def _hub_pairs(entries: DataFrame, sets: DataFrame, turn: int, link: int) -> DataFrame:
    """Each member with the hubs of HUBS of its buckets, if they have different labels and may be alike.

    `entries` has bucket, node, label, members. A group's members meet in many buckets, of which a few connect them.
    """
    rank = F.xxhash64("node", F.lit(turn))
    least = F.min(F.struct(rank.alias("rank"), "node", "label"))
    hubs = stage(entries.groupBy("bucket").agg(least.alias("h")).select(F.col("bucket").alias("of"), F.col("h.node").alias("hub"), F.col("h.label").alias("hub_label")), "nd-hubs")
    met = entries.join(hubs, F.col("bucket") == F.col("of")).where("label != hub_label")
    # One row a node and hub, BANDS of them a node at most; later rounds take other buckets.
    size = F.max("members") if not turn else F.lit(0).cast("long")
    met = met.groupBy("node", "hub").agg(size.alias("members"), F.max(F.xxhash64("bucket", F.lit(turn))).alias("rank"))
    some = met.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("members", "rank", "hub")), False), 1, HUBS).alias("hubs"))
    return _sketched(some.select(F.col("node").alias("a"), F.explode("hubs").alias("h")).select("a", F.col("h.hub").alias("b")), sets, link)


def _all_pairs(entries: DataFrame, sets: DataFrame, nodes: DataFrame, link: int) -> DataFrame:
    """All pairs of a bucket's members with different labels that may be alike.

    The sketches are compared inside the join, and a pair leaves it in the first of its common buckets only.
    """
    for table in (sets.select(F.col("class_key").alias("key"), "n", "sketch"), nodes.select(F.col("class_key").alias("key"), "bands")):
        entries = entries.join(table, F.col("node") == F.col("key")).drop("key")
    full = stage(entries, "nd-open")
    a, b = (full.select(*[F.col(c).alias(f"{side}_{c}") for c in full.columns]) for side in "ab")
    differ = (F.col("a_node") < F.col("b_node")) & (F.col("a_label") != F.col("b_label"))
    once = F.element_at(F.array_intersect("a_bands", "b_bands"), 1) == F.col("a_bucket")
    met = a.join(b, (F.col("a_bucket") == F.col("b_bucket")) & differ & _alike("a_", "b_", link) & once)
    return met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def _rare_pairs(entries: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """Pairs (a, b) of members with different labels that have one of their rarest shingles in common and may be alike.

    What is rare is told by a table of fixed size, counts of shingles by their first bits; any order would be exact. Shingles
    that one member alone has go before the sketches come; these are compared inside the join.
    """
    spark = entries.sparkSession
    members = stage(entries.select("node", "label").distinct(), "nd-members")
    known = sets.join(members, F.col("class_key") == F.col("node")).select("node", "label", "n", "shingles")
    slot = F.call_function("shiftrightunsigned", F.col("shingle"), F.lit(64 - COUNT_BITS))
    rows = known.select(F.explode("shingles").alias("shingle")).select(slot.alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).toArrow()  # 2**COUNT_BITS at most
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    counts[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            values, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
            firsts = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                x = values[a:b]
                firsts.append(x[np.lexsort((x, shared.value[x >> np.uint64(64 - COUNT_BITS)]))[: len(x) - -(-len(x) * link // 100) + 1]])
            own = np.repeat(np.arange(len(firsts)), [len(f) for f in firsts])
            behind = np.concatenate([len_ - np.arange(len(f)) for f, len_ in zip(firsts, np.diff(ends).tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts).view(np.int64)), *(batch.column(i).take(pa.array(own)) for i in range(3)), pa.array(behind, pa.int64())], names=["token", "node", "label", "n", "behind"])

    # `behind` counts the shingles of the set from this one on.
    tokens = stage(known.mapInArrow(run, "token long, node binary, label binary, n long, behind long"), "nd-tokens")
    several = tokens.groupBy(F.col("token").alias("of")).agg(F.count("*").alias("times")).where("times > 1").select("of")
    tokens = stage(tokens.join(several, F.col("token") == F.col("of")).drop("of"), "nd-met")
    tokens = tokens.join(sets.select("class_key", "sketch"), F.col("node") == F.col("class_key")).drop("class_key")
    a, b = (tokens.select(*[F.col(c).alias(f"{side}_{c}") for c in tokens.columns]) for side in "ab")
    # A linked pair's first common shingle stands where so many are behind it in both sets as the pair must have in common.
    alike = F.least("a_behind", "b_behind") * (100 + link) >= (F.col("a_n") + F.col("b_n")) * link
    differ = (F.col("a_node") < F.col("b_node")) & (F.col("a_label") != F.col("b_label"))
    met = a.join(b, (F.col("a_token") == F.col("b_token")) & differ & alike & _alike("a_", "b_", link))
    return met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def _sketched(pairs: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """The pairs (a, b) that may be linked by their sizes and sketches."""
    for side in ("b", "a"):
        pairs = pairs.join(sets.select(F.col("class_key").alias(f"{side}_key"), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_sketch")), F.col(side) == F.col(f"{side}_key")).drop(f"{side}_key")
    return pairs.where(_alike("a_", "b_", link)).select("a", "b")


def _relabelled(entries: DataFrame, links: DataFrame) -> DataFrame:
    """The entries after a hub round: a label of which a member is linked with a hub becomes the hub's label.

    Labels only ever join what is linked, though they may not join all of it; components are found at the end.
    """
    of = entries.select("node", "label").distinct()
    known = links.join(of.select(F.col("node").alias("a"), F.col("label").alias("from")), "a").join(of.select(F.col("node").alias("b"), F.col("label").alias("to")), "b")
    moves = stage(known.where("to != from").groupBy("from").agg(F.min("to").alias("to")), "nd-moves")
    return entries.join(moves, F.col("label") == F.col("from"), "left").select("bucket", "node", F.coalesce("to", "label").alias("label"))


def _open(entries: DataFrame) -> tuple[DataFrame, int, int]:
    """The entries of buckets with several labels, the number of pairs under different labels, and that of entries."""
    known = stage(entries, "nd-labelled")
    sizes = known.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy(F.col("bucket").alias("of")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"), F.count("*").alias("labels")).where("labels > 1")
    sizes = stage(sizes, "nd-sizes")
    pairs, held = sizes.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return known.join(sizes.select("of", F.col("n").alias("members")), F.col("bucket") == F.col("of")).drop("of"), int(pairs), int(held)


def _links(opened: DataFrame, pairs: int, sets: DataFrame, nodes: DataFrame, link: int) -> DataFrame:
    """Links that connect all classes which the links of all buckets connect."""
    links = None
    for turn in range(MOST_ROUNDS):
        found = stage(_confirmed(_hub_pairs(opened, sets, turn, link), sets, link), "nd-links")
        links = found if links is None else links.unionByName(found)
        before, (opened, pairs, held) = pairs, _open(_relabelled(opened, found))
        if pairs <= PAIRS * held or pairs > WORTH * before:
            break
    if not pairs:
        return links
    few, many = opened.where(F.col("members") <= MEMBERS).drop("members"), opened.where(F.col("members") > MEMBERS)
    links = links.unionByName(stage(_confirmed(_all_pairs(few, sets, nodes, link), sets, link), "nd-links"))
    if not many.isEmpty():
        links = links.unionByName(stage(_confirmed(_rare_pairs(many, sets, link), sets, link), "nd-links"))
    return links


def classes(docs: DataFrame, link: int = LINK) -> tuple[DataFrame, DataFrame]:
    """The profile of each document, and (class_key, component): the least doc_id that a class is linked with."""
    profile = stage(profiles(docs), "nd-profiles")
    usable = profile.where("class_key is not null and doc_id is not null")
    nodes = stage(usable.groupBy("class_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "nd-nodes")
    entries = nodes.select(F.explode("bands").alias("bucket"), F.col("class_key").alias("node"))
    buckets = stage(entries.groupBy(F.col("bucket").alias("of")).agg(F.count("*").alias("n")).where("n > 1").select("of"), "nd-buckets")
    opened, pairs, _ = _open(entries.join(buckets, F.col("bucket") == F.col("of")).select("bucket", "node", F.col("node").alias("label")))
    known = nodes.select("class_key", "rep")
    if not pairs:
        return profile, known.select("class_key", F.col("rep").alias("component"))
    wanted = known.join(opened.select("node").distinct(), F.col("class_key") == F.col("node"), "left_semi").select(F.col("rep").alias("id"))
    texts = docs.select("doc_id", "text")
    sets = stage(shingle_sets(texts.join(wanted, F.col("doc_id") == F.col("id"), "left_semi")), "nd-sets")
    labels = stage(components(_links(opened, pairs, sets, nodes, link)), "nd-labels")
    drop_staged(sets)
    linked = known.join(labels, F.col("class_key") == F.col("node"))
    least = stage(linked.groupBy(F.col("component").alias("of")).agg(F.min("rep").alias("least")), "nd-least")
    named = linked.join(least, F.col("component") == F.col("of")).select("class_key", F.col("least").alias("component"))
    alone = known.join(labels, F.col("class_key") == F.col("node"), "left_anti").select("class_key", F.col("rep").alias("component"))
    return profile, named.unionByName(alone)


def near_duplicates(docs: DataFrame, link: int = LINK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; see the contract of op5."""
    profile, found = classes(docs, link)
    named = stage(found.select(F.col("class_key").alias("key"), "component"), "nd-classes")
    rows = profile.select("doc_id", "n_shingles", "class_key").join(named, F.col("class_key") == F.col("key"), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def deduplicate(docs: DataFrame, link: int = LINK) -> DataFrame:
    """The documents that are kept: one of each component, the one with the least doc_id."""
    of = private(docs)("of")
    gone = near_duplicates(docs, link).where("not kept").select(F.col("doc_id").alias(of)).distinct()
    return docs.join(gone, docs["doc_id"] == F.col(of), "left_anti")
