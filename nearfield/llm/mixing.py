"""Mixing sources to target weights, by DataFrame functions alone.

The words of a source are laid end to end, documents in a scattered order, and cut into blocks of one
length. The mix is a row of output shards of ``SHARD`` slots; each slot takes one block. For every shard
the numbers of slots of the sources are drawn: whole slots of a source's share are certain, and the
rest of the shard is a multinomial draw over the fractions that are left (the residual form of the
draw, whose error is a few slots a shard). So how much is taken of a source, and with it which
blocks are, depends on the draw. Slots of a source are numbered through the shards, and a pseudorandom
permutation of each source and epoch maps a slot's number to a block's index. Slots and blocks
meet in a join by source and index.

An epoch takes every block once, and no source has more than ``MOST`` epochs: slots drawn beyond the
last one stay empty. So no document is taken more often than ``MOST`` times.

Scale. A source may hold a third of all rows: running sums go over ``BUCKETS`` hash buckets of a
source first and inside a bucket then; slots are made in chunks that are dealt to a number of tasks
in proportion to them; nothing is collected but sums over the table of sources. Rows equal in
doc_id, source and text are one counted row until their places are told apart. The draw, the blocks taken and the
pieces are staged: as one query their plan took hundreds of MB of the driver, however few the rows. The unpartitioned
windows are over the table of sources, one row each. Texts are moved by `mix` only, and once.

Defined results. Null text has size 0. Null is a source of its own, the last. Documents of size 0 take
nothing. Equal rows are documents of their own. An empty table makes no rows. Reruns agree, as all
draws are hashes of numbers. Texts of any length are laid over as many blocks as they need. Columns of any
name stay as they are in `mix`; `plan` reads doc_id, text and source only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearfield.llm._shared import private, stage

WORD = r"[^\x20\x09-\x0D]+"
#: A word and the blanks before it.
_WITH_GAP = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
#: Weights of the sources in turn; how often a source may be used up; words of a block at most.
WEIGHTS, MOST, BLOCK = (5, 2, 1), 3, 512
#: Blocks that a source should have at least, so that a block is a small part of it.
LEAST_BLOCKS = 1024
#: Hash buckets of a source; slots of a shard, of a chunk, of a task; rounds of the permutation.
BUCKETS, SHARD, CHUNK, TASK_SLOTS, ROUNDS = 4096, 1 << 14, 1 << 10, 1 << 18, 16
#: Parts of a slot that shares are counted in; bins that the draws are looked up by.
UNIT, BINS = 256, 1024

_P = 2147483647


def _div(a: Column, b: Column | int) -> Column:
    """Integer division; `/` would go by way of doubles."""
    return F.call_function("div", a, F.lit(b).cast("long") if isinstance(b, int) else b)


def scatter(x: Column) -> Column:
    """A pseudorandom number under 2**31 - 1 from one that is not negative: a square between multiplications modulo this prime."""
    u = (x % _P + _div(x, _P) % _P * 40692) % _P
    v = (u * 48271 + 11) % _P
    return ((v * v + u) % _P * 69621 + 12345) % _P


def wide(x: Column) -> Column:
    """The same under 2**62."""
    return scatter(x) * F.lit(1 << 31) + scatter(x + 1013904223)


def _keys(sid: Column, epoch: Column) -> Column:
    """The key of each round of a source's and epoch's permutation."""
    rounds = F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long"))
    return F.transform(rounds, lambda i: wide(sid * 7919 + epoch * 104729 + i * 1299709))


def permuted(x: Column, n: Column, keys: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 by swap-or-not rounds.

    Each round pairs x with k - x modulo n and swaps them or not by one bit of a hash of the larger:
    a bijection for every n, so each epoch of a source takes each block once.
    """

    def step(acc: Column, key: Column) -> Column:
        other = (key % n + n - acc) % n
        bit = _div(scatter(F.greatest(acc, other) + key), 1024) % 2
        return F.when(bit == 1, other).otherwise(acc)

    return F.aggregate(keys, x, step)


def _digest(text: Column) -> Column:
    """60 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and digest of the documents."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _digest(F.col("text")).alias("digest"),
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row for each source: sid, source, source_size, target, its blocks, and its share in parts of a slot.

    `rows` has source and size, and may have a number of equal rows, `n`. Shares above `most` times a
    source's size are cut to it and the excess goes to the others by weight, until none is above: the
    sources cut are the first ones in order of size a weight.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")).cast("long")
    size = F.col("size") * F.col("n") if "n" in rows.columns else F.col("size")
    s = rows.groupBy("source").agg(F.sum(size).alias("source_size"))
    s = s.withColumn("sid", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long")).withColumn("weight", weight)
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = W.orderBy("ratio", "sid")
    s = s.withColumn("pos", F.row_number().over(order))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(0, W.unboundedFollowing)
    s = s.withColumn("left", F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("heavy", F.sum("weight").over(onward))
    s = s.withColumn("first", F.min(F.when(F.col("left") / F.col("heavy") < F.col("ratio"), F.col("pos"))).over(W.partitionBy()))
    at_first = lambda c: F.max(F.when(F.col("pos") == F.col("first"), F.col(c))).over(W.partitionBy())
    s = s.withColumn("left", at_first("left")).withColumn("heavy", at_first("heavy"))
    shared = F.col("left") * F.col("weight") / F.col("heavy")
    s = s.withColumn("target", F.when(F.col("first").isNull() | (F.col("pos") < F.col("first")), F.col("cap").cast("double")).otherwise(shared))
    block = F.greatest(F.lit(1).cast("long"), F.least(F.lit(BLOCK).cast("long"), _div(F.col("source_size"), LEAST_BLOCKS)))
    s = s.withColumn("block", block).withColumn("blocks", _div(F.col("source_size") + F.col("block") - 1, F.col("block")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    s = s.withColumn("epochs", F.least(epochs, F.lit(most).cast("long")))
    rest = F.when(F.col("epochs") >= most, F.lit(0.0)).otherwise((F.col("target") - F.col("epochs") * F.col("source_size")) / F.col("block"))
    units = F.col("epochs") * F.col("blocks") * UNIT + F.floor(rest * UNIT).cast("long")
    return s.select("sid", "source", "source_size", "target", "block", "blocks", units.alias("units"))


def _numbered(table: DataFrame, n: str, name: str, tasks: int | None = None) -> DataFrame:
    """Rows numbered 0..n-1 for each row of the table, made in chunks; `tasks` of them share the chunks, if given."""
    chunked = table.where(F.col(n) > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col(n) - 1, CHUNK))))
    if tasks:
        # Numbered, as AQE would merge the few small rows of chunks into one task.
        chunked = chunked.repartition(tasks, *table.columns, "_chunk")
    begin = F.col("_chunk") * CHUNK
    return chunked.withColumn(name, F.explode(F.sequence(begin, F.least(begin + CHUNK, F.col(n)) - 1))).drop("_chunk")


def _totals(sources: DataFrame) -> tuple[int, int]:
    """The sum of all units, and the number of slots."""
    units = sources.agg(F.coalesce(F.sum("units"), F.lit(0))).first()[0]
    return units, -(-units // UNIT)


def drawn(sources: DataFrame) -> DataFrame:
    """How many slots each source gets in each shard: sid, shard, n.

    Of the `held` slots of a shard a source with a share u of U has held * u / U: the whole part for
    certain. What remains of the shard goes to sources by draws with the fractions' probabilities.
    All arithmetic is in integers; held * U stays under 2**63 up to some 10**15 words.
    """
    spark = sources.sparkSession
    units, total = _totals(sources)
    out = spark.createDataFrame([], "sid long, shard long, n long")
    if not total:
        return out
    shards = -(-total // SHARD)
    for first, count, held in ((0, shards - 1, SHARD), (shards - 1, 1, total - (shards - 1) * SHARD)):
        if not count:
            continue
        part = sources.where("units > 0").select("sid", "units", F.lit(count).cast("long").alias("count"), _div(F.col("units") * F.lit(held), units).alias("n"), (F.col("units") * F.lit(held) % F.lit(units)).alias("fraction"))
        certain = _numbered(part.where("n > 0").select("sid", "n", "count"), "count", "shard").select("sid", (F.col("shard") + first).alias("shard"), "n")
        out = out.unionByName(certain)
        open_slots = held - part.agg(F.sum("n")).first()[0]
        if open_slots:
            whole = open_slots * units
            width = -(-whole // BINS)
            upto = F.sum("fraction").over(W.orderBy("sid"))
            ranges = part.where("fraction > 0").select("sid", (upto - F.col("fraction")).alias("low"), upto.alias("high"))
            ranges = ranges.withColumn("bin", F.explode(F.sequence(_div(F.col("low"), width), _div(F.col("high") - 1, width))))
            draws = spark.range(count * open_slots).select((_div(F.col("id"), open_slots) + first).alias("shard"), (F.col("id") % open_slots).alias("i"))
            draws = draws.withColumn("x", wide(F.col("shard") * 15485863 + F.col("i") * 32452843 + 49979687) % F.lit(whole)).withColumn("at", _div(F.col("x"), width))
            hit = draws.join(ranges, (F.col("at") == F.col("bin")) & (F.col("x") >= F.col("low")) & (F.col("x") < F.col("high")))
            out = out.unionByName(hit.groupBy("sid", "shard").agg(F.count("*").alias("n")))
    return out.groupBy("sid", "shard").agg(F.sum("n").alias("n"))


def slots(sources: DataFrame, most: int = MOST) -> DataFrame:
    """The slots of the mix: shard, sid, slot (its number in the source), index of the block taken."""
    tasks = max(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-_totals(sources)[1] // TASK_SLOTS))
    counted = stage(drawn(sources), "mix-drawn")
    # One row a shard and source here: a shard is thousands of blocks.
    begin = F.sum("n").over(W.partitionBy("sid").orderBy("shard")) - F.col("n")
    numbered = counted.withColumn("begin", begin).join(sources.select("sid", "blocks"), "sid")
    numbered = _numbered(numbered, "n", "k", tasks).withColumn("slot", F.col("begin") + F.col("k")).where(F.col("slot") < F.col("blocks") * most)
    keys = _keys(F.col("sid"), _div(F.col("slot"), F.col("blocks")))
    return numbered.select("shard", "sid", "slot", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), keys).alias("index"))


def laid_out(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """The documents, equal ones apart, with sid and the place of their first word in the source."""
    known = rows.join(sources.select("sid", F.col("source").alias("of"), "source_size", "target", "block"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    known = known.withColumn("bucket", scatter(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(_P)) + F.col("digest")) % BUCKETS)
    words = F.col("size") * F.col("n")
    sums = known.groupBy("sid", "bucket").agg(F.sum(words).alias("sum"))
    base = sums.select("sid", "bucket", (F.sum("sum").over(W.partitionBy("sid").orderBy("bucket")) - F.col("sum")).alias("base"))
    inside = F.sum(words).over(W.partitionBy("sid", "bucket").orderBy("doc_id", "size", "digest").rowsBetween(W.unboundedPreceding, 0)) - words
    placed = known.withColumn("inside", inside).join(base, ["sid", "bucket"]).withColumn("begin", F.col("base") + F.col("inside")).drop("base", "inside", "bucket")
    apart = _numbered(placed, "n", "copy")
    return apart.withColumn("begin", F.col("begin") + F.col("copy") * F.col("size")).drop("copy")


def _met(docs: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame]:
    """The places of all documents, and for each piece of one in a block that is taken: sid, begin, index, words, times."""
    rows = stage(sizes(docs).groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("n")), "mix-sizes")
    sources = stage(targets(rows, weights, most), "mix-sources")
    taken = stage(slots(sources, most).groupBy("sid", "index").agg(F.count("*").alias("times")), "mix-taken")
    placed = stage(laid_out(rows, sources), "mix-places")
    index = F.explode(F.sequence(_div(F.col("begin"), F.col("block")), _div(F.col("begin") + F.col("size") - 1, F.col("block"))))
    parts = placed.where("size > 0").withColumn("index", index)
    words = F.least(F.col("begin") + F.col("size"), (F.col("index") + 1) * F.col("block")) - F.greatest("begin", F.col("index") * F.col("block"))
    return placed, parts.select("sid", "index", "begin", words.alias("words")).join(taken, ["sid", "index"])


def plan(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """What the mix takes of each document: the result of op7, one row per document."""
    placed, met = _met(docs, weights, most)
    # A document with words is the only one that begins at its place.
    sums = met.groupBy("sid", "begin").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    zero, result = F.lit(0).cast("long"), ["doc_id", "size", "source_size", "target", "taken"]
    full = placed.where("size > 0").join(sums, ["sid", "begin"], "left").withColumn("taken", F.coalesce("taken", zero)).select(result)
    return full.unionByName(placed.where("size = 0").withColumn("taken", zero).select(result))


def pieces(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """What the mix takes of the rows of one doc_id, source and text: their digest, and pieces (first word, words, times).

    Blocks of a document that are taken as often as all of its blocks make whole copies of it; each run of
    neighbouring blocks that is taken once more is a passage. A text has no more kinds of pieces than it has
    places for them, however often it stands in the table.
    """
    placed, met = _met(docs, weights, most)
    got = met.groupBy("sid", "begin").agg(F.array_sort(F.collect_list(F.struct("index", "times"))).alias("got"))  # blocks of one document
    rows = placed.where("size > 0").join(got, ["sid", "begin"])
    all_blocks = _div(F.col("begin") + F.col("size") - 1, F.col("block")) - _div(F.col("begin"), F.col("block")) + 1
    rows = rows.withColumn("whole", F.when(F.size("got") < all_blocks, F.lit(0).cast("long")).otherwise(F.array_min(F.transform("got", lambda g: g["times"]))))
    rows = rows.withColumn("more", F.transform(F.filter("got", lambda g: g["times"] > F.col("whole")), lambda g: g["index"]))
    starts = F.filter("more", lambda x, i: (i == 0) | (F.get("more", i - 1) != x - 1))
    ends = F.filter("more", lambda x, i: (i == F.size("more") - 1) | (F.get("more", i + 1) != x + 1))
    begin, size, block = F.col("begin"), F.col("size"), F.col("block")

    def passage(a: Column, b: Column) -> Column:
        first = F.greatest(begin, a * block) - begin
        return F.struct(first.alias("first"), (F.least(begin + size, (b + 1) * block) - begin - first).alias("words"), F.lit(1).cast("long").alias("times"))

    copies = F.array(F.struct(F.lit(0).cast("long").alias("first"), size.alias("words"), F.col("whole").alias("times")))
    every = F.concat(F.filter(copies, lambda p: p["times"] > 0), F.zip_with(starts, ends, passage))
    flat = rows.select("doc_id", "source", "digest", "size", F.explode(every).alias("p")).select("doc_id", "source", "digest", "size", "p.first", "p.words", "p.times")
    flat = flat.groupBy("doc_id", "source", "digest", "size", "first", "words").agg(F.sum("times").alias("times"))
    return flat.groupBy("doc_id", "source", "digest", "size").agg(F.array_sort(F.collect_list(F.struct("first", "words", "times"))).alias("pieces"))


def _row_key(doc_id: Column, source: Column) -> Column:
    return F.xxhash64(doc_id, doc_id.isNull(), source, source.isNull())


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of the mix, with the documents' columns: the blocks that slots have taken, those of a document
    that stand side by side as one text.

    A document whose blocks are all taken comes whole, as it is; else its passages come, blanks and line ends inside
    them as they were. So the words given out are the words taken, and a source meets its target.
    Rows that agree in doc_id, source and text come with the other columns of one of them.
    """
    name = private(docs)
    wanted = pieces(docs, weights=weights, most=most)
    wanted = stage(wanted, "mix-pieces").select(F.col("digest").alias(name("d")), _row_key(F.col("doc_id"), F.col("source")).alias(name("k")), F.col("size").alias(name("size")), F.col("pieces").alias(name("pieces")))
    keyed = docs.withColumn(name("digest"), _digest(F.col("text"))).withColumn(name("key"), _row_key(F.col("doc_id").cast("long"), F.col("source").cast("string")))
    met = keyed.join(wanted, (F.col(name("digest")) == F.col(name("d"))) & (F.col(name("key")) == F.col(name("k"))))
    # The join leaves equal rows side by side, so this window moves nothing.
    one = W.partitionBy(name("digest"), name("key")).orderBy(name("digest"))
    met = met.withColumn(name("row"), F.row_number().over(one)).where(F.col(name("row")) == 1)
    size, text = F.col(name("size")), F.col("text")

    def cut(words: Column) -> Column:
        def piece(p: Column) -> Column:
            passage = F.ltrim(F.array_join(F.slice(words, (p["first"] + 1).cast("int"), p["words"].cast("int")), ""), F.lit(" \t\n\x0b\f\r"))
            return F.struct(F.when(p["words"] == size, text).otherwise(passage).alias("text"), p["times"].alias("times"))

        return F.transform(F.col(name("pieces")), piece)

    partial = F.exists(F.col(name("pieces")), lambda p: p["words"] != size)
    split = F.when(partial, F.regexp_extract_all(text, F.lit(_WITH_GAP), F.lit(0)))
    # Inside an array of one, the words of a text are found once and not for each piece.
    made = F.flatten(F.transform(F.array(split), cut))
    out = met.select(*docs.columns, F.explode(made).alias(name("made")))
    out = out.withColumn("text", F.col(f"{name('made')}.text")).withColumn(name("copy"), F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{name('made')}.times"))))
    return out.select(*docs.columns)
