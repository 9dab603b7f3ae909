"""Line dedup by an edit join over segments, with DataFrame functions alone.

Distinct lines within a number of edits of each other are linked; the shorter line's length says how many
(``RULE``). With e edits a line is split into e + 1 segments; of two linked lines, the longer one holds a
segment of the shorter one unchanged, at one of a few places that the difference of their lengths
allows. Segments are indexed by (length of the line, number, hash of the text); every line probes the
index for the lengths in reach with the substrings at those places. Index and probes meet in one
equi-join, inside which bitmaps of the lines' words, in which an edit flips three bits at most, drop
most pairs; counts of letters, which an edit changes by two at most, drop more of them where texts are at hand. What remains is verified by a banded bit-parallel edit distance: a word of 2 * e + 1 bits
slides down the diagonal, one column of the table a step.

A segment that many lines have in common (a time, a license's first words) would make all their
pairs. So the lines of each key are counted, for every input. What
stands beside the segment is within e edits too: under keys of some lines it is compared inside the join, so that only
lines whose rests are that near make a pair. Under keys of very many it is split into e + 1 segments itself, and lines
meet if they share one of those as well; so on up to ``LEVELS`` deep, where rests are compared too. No pair within the
edits is missed by it.

Linked lines form classes, and of each class the first line in order of (doc_id, position) is kept.
Classes may chain: a and c can be in one class by way of b.

What moves. Texts are not grouped: lines are known by 128 bits of hash, and what the join needs is hashed
where the line is read; copies are combined before the shuffle, so a very common line is one row a
task. Only lines of candidate pairs are looked up again: a bitmap of fixed size, which tasks get as a
broadcast, keeps nearly all others from the shuffle.

Defined results. Lines are cut at line feeds and trimmed of blanks, tabs and the like; blank lines are
always kept and have no class. Lines shorter than all lengths of ``RULE`` are linked with nothing, so only exact
copies of them are dropped. Null text has no lines; an empty table makes no rows. Null doc_ids come last of all.
Rows that share a doc_id are one document for what they keep. Equal lines inside a document are dropped like
others. Lines and texts may be of any length. Columns of any name stay as they are in `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm._shared import drop_staged, private, stage
from nearfield.llm.components import components

#: Characters of the shorter line from which linked lines may differ by one edit, by two.
RULE = (8, 16)
#: Lines under keys of that many compare what stands beside them inside the join; keys of so many are refined; levels of segments.
SHARED, HOT, LEVELS = 8, 64, 3
#: Without effect since all lines are counted, not a sample; tests set them.
SAMPLED, HOT_SAMPLE = 1, 1
#: Bits of the bitmap that picks lines to look up: 2 MB at most, as rows of 64 bits.
BITMAP = 1 << 23
#: Bits that an edit flips in the bitmap of words at most: a blank put into a word, or taken out, changes three words.
FLIPS = 3
#: Letters whose counts modulo 16 are compared where texts are at hand; an edit changes two of them by one at most.
LETTERS = "etaoinshrdlucmgb"
#: Substrings are cut from this encoding, of four bytes a character, as others would be walked through from the start.
_WIDE = "UTF-32"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Evaluates a value once for an expression that uses it several times."""
    return F.element_at(F.transform(F.array(value), then), 1)


# Segments


def segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 0): the last ones are longer by one if need be."""
    short = F.floor(length / (edits + 1)).cast("int")
    longer = F.pmod(length, F.lit(edits + 1)).cast("int")
    first_longer = F.lit(edits + 1) - longer
    start = short * i + F.greatest(F.lit(0), F.lit(i) - first_longer) + 1
    return start, short + (F.lit(i) >= first_longer).cast("int")


def moves(edits: int, d: int) -> list[tuple[int, int]]:
    """(segment, shift): how far a segment can have moved in a partner that is longer by d.

    The edits before the segment and those behind it add up to no more than `edits`.
    """
    return [(i, x) for i in range(edits + 1) for x in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1)]


def allowed(length: Column, rule: tuple[int, ...]) -> Column:
    """The edits that a pair may have whose shorter line has this length."""
    return sum(((length >= least).cast("int") for least in rule), F.lit(0))


def _shapes(rule: tuple[int, ...]) -> list[dict[str, Column]]:
    """Steps of columns that give, for a partner shorter by d, its length o<d>, its edits e<d>, and the start a<d>_<i> and size z<d>_<i> of its segments in bytes.

    Of t = segments - (length modulo segments), segments from number t on are longer by one character.
    """
    ds, shl = range(len(rule) + 1), lambda c: F.call_function("shiftleft", c, F.lit(2))
    steps: list[dict[str, Column]] = [{f"o{d}": F.col("n") - d for d in ds}, {}, {}, {}]
    for d in ds:
        other, m, short, t = (F.col(f"{c}{d}") for c in "omst")
        steps[1] |= {f"m{d}": allowed(other, rule) + 1}
        steps[2] |= {f"s{d}": F.call_function("div", other, m).cast("int"), f"t{d}": m - other % m}
        for i in range(len(rule) + 1):
            begin = short * i if i > 1 else short
            steps[3][f"z{d}_{i}"] = shl(short + (t <= i).cast("int")) if i else shl(short)
            if i:
                steps[3][f"a{d}_{i}"] = shl(begin + F.greatest(F.lit(0), i - t) if i > 1 else begin) + 1
    return steps


def _moves(rule: tuple[int, ...]) -> list[tuple[int, int, int, int]]:
    """(d, segment, shift, edits from which it is probed) for all probes; fewer edits allow a part of the moves of more."""
    most = len(rule)
    return [(d, i, x, next(e for e in range(max(1, d), most + 1) if (i, x) in moves(e, d))) for d in range(most + 1) for i, x in moves(most, d)]


def _key(wide: Column, start: Column, size: Column, length: Column, i: int) -> Column:
    return F.xxhash64(F.substring(wide, start, size), length, F.lit(i))


def _compiled_apart(rows: DataFrame) -> DataFrame:
    """The same rows; what stands before and behind is compiled to methods of its own.

    One method of all the steps is too large for the JIT, or takes it gigabytes. A coalesce to more partitions than there
    are moves nothing.
    """
    return rows.coalesce(1 << 30)


def probed(rows: DataFrame, rule: tuple[int, ...], *others: Column) -> DataFrame:
    """The other columns and the keys p0, p1, ... of all probes of a column `line`; a line's index keys are those of d = 0 without a shift.

    Done in steps, each a projection over columns.
    """
    assert all(least > edits for edits, least in enumerate(rule, 1)), "a line needs a character for each segment"
    rows = rows.select(*others, F.length("line").alias("n"), F.encode("line", _WIDE).alias("wide"))
    others = tuple(F.col(c) for c in rows.columns[: len(others)])
    rows = _compiled_apart(rows)
    for step in _shapes(rule):
        rows = rows.withColumns(step)
    start = lambda d, i, x: F.lit(1) if not i else F.col(f"a{d}_{i}") + 4 * x if x else F.col(f"a{d}_{i}")
    keys = [F.when(F.col(f"m{d}") > least, _key(F.col("wide"), start(d, i, x), F.col(f"z{d}_{i}"), F.col(f"o{d}"), i)) for d, i, x, least in _moves(rule)]
    return _compiled_apart(rows.select(*others, *[c.alias(f"p{k}") for k, c in enumerate(keys)]))


def _places(line: Column, rule: tuple[int, ...], probing: bool) -> Column:
    """The same keys with what stands beside each place: an array of (key, edits, d, rest)."""
    n, wide = F.length(line), F.encode(line, _WIDE)
    out = []
    for edits in range(1, len(rule) + 1):
        for d in range(edits + 1) if probing else [0]:
            other = n - d
            fits = (other >= rule[edits - 1]) & (other < rule[edits] if edits < len(rule) else F.lit(True))
            for i, x in moves(edits, d) if probing else [(i, 0) for i in range(edits + 1)]:
                begin, size = segment(other, i, edits)
                begin = begin + x
                rest = F.concat(F.substring(line, F.lit(1), begin - 1), F.substring(line, begin + size, n))
                place = F.struct(_key(wide, (begin - 1) * 4 + 1, size * 4, other, i).alias("key"), F.lit(edits).alias("edits"), F.lit(d).alias("d"), rest.alias("rest"))
                out.append(F.when(fits, place))
    return F.filter(F.array(*out), lambda p: p.isNotNull())


# Verification


def _common(a: Column, b: Column, from_end: bool) -> Column:
    """Characters that two lines share at their start, or end, by halving."""
    most = F.least(F.length(a), F.length(b))
    part = (lambda s, n: F.substring(s, F.length(s) - n + 1, n)) if from_end else (lambda s, n: F.substring(s, F.lit(1), n))
    bits = F.sequence(F.floor(F.log2(most + 1)).cast("int"), F.lit(0), F.lit(-1))

    def grow(n: Column, bit: Column) -> Column:
        m = n + F.call_function("shiftleft", F.lit(1), bit)
        return F.when((m <= most) & (part(a, m) == part(b, m)), m).otherwise(n)

    return F.aggregate(bits, F.lit(0), grow)


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of a to b, where b is as long as a or longer; over `edits` if it is more.

    Bit k of a word is row j - edits + k of column j. Differences down a column are held as two
    words, up and down; rows above the table count down, so that they add nothing on the diagonal. The
    distance grows along the diagonal that ends in the last cell wherever the diagonal bit is not set.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    long = lambda x: F.lit(x).cast("long")
    x, y = F.filter(F.split(a, ""), lambda c: c != ""), F.filter(F.split(b, ""), lambda c: c != "")
    shl = lambda v, n: F.call_function("shiftleft", v, F.lit(n))
    shr = lambda v, n: F.call_function("shiftright", v, F.lit(n))
    flip = lambda v: v.bitwiseXOR(long(full))

    def table(x: Column, y: Column) -> Column:
        m, n = F.size(x), F.size(y)
        last = m - n + edits  # the bit of the diagonal that ends in the last cell
        start = F.struct(long(full & ~((1 << (edits + 1)) - 1)).alias("up"), long((1 << (edits + 1)) - 1).alias("down"), (n - m).cast("long").alias("d"))

        def column(acc: Column, j: Column) -> Column:
            same = long(0)
            for k in range(width):
                i = j - edits + k
                match = F.coalesce((i >= 1) & (F.get(x, F.greatest(i - 1, F.lit(0))) == F.get(y, j - 1)), F.lit(False))
                same = same.bitwiseOR(F.when(match, long(1 << k)).otherwise(long(0)))
            up, down = shr(acc["up"], 1).bitwiseOR(long(1 << (width - 1))), shr(acc["down"], 1)
            words = F.struct(same.alias("same"), up.alias("up"), down.alias("down"))

            def diagonal(w: Column) -> Column:
                carried = ((w["same"].bitwiseAND(w["up"]) + w["up"]).bitwiseXOR(w["up"])).bitwiseOR(w["same"]).bitwiseOR(w["down"])
                return F.struct(carried.bitwiseAND(long(full)).alias("zero"), w["up"].alias("up"), w["down"].alias("down"))

            def next_words(w: Column) -> Column:
                rise = w["down"].bitwiseOR(flip(w["zero"].bitwiseOR(w["up"])))
                fall = w["zero"].bitwiseAND(w["up"])
                shifted = shl(rise, 1).bitwiseOR(long(1))
                ahead = shl(fall, 1).bitwiseOR(flip(w["zero"].bitwiseOR(shifted).bitwiseAND(long(full)))).bitwiseAND(long(full))
                behind = w["zero"].bitwiseAND(shifted)
                step = long(1) - shr(w["zero"], 0).bitwiseAND(F.call_function("shiftleft", long(1), last)).cast("boolean").cast("long")
                return F.struct(ahead.alias("up"), behind.alias("down"), (acc["d"] + step).alias("d"))

            return _let(_let(words, diagonal), next_words)

        steps = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, column)["d"]

    both = F.struct(x.alias("x"), y.alias("y"))
    found = _let(both, lambda p: table(p["x"], p["y"]))
    return F.when(F.length(b) - F.length(a) > edits, F.lit(edits + 1).cast("long")).otherwise(found)


def distance(a: Column, b: Column, edits: int) -> Column:
    """The banded distance of what two lines do not share at their ends; the shorter line first or second."""
    ordered = F.struct(F.when(F.length(a) <= F.length(b), a).otherwise(b).alias("a"), F.when(F.length(a) <= F.length(b), b).otherwise(a).alias("b"))

    def without_start(p: Column) -> Column:
        return _let(_common(p["a"], p["b"], False), lambda n: F.struct(F.substring(p["a"], n + 1, F.length(p["a"])).alias("a"), F.substring(p["b"], n + 1, F.length(p["b"])).alias("b")))

    def without_end(p: Column) -> Column:
        return _let(_common(p["a"], p["b"], True), lambda n: F.struct(F.substring(p["a"], F.lit(1), F.length(p["a"]) - n).alias("a"), F.substring(p["b"], F.lit(1), F.length(p["b"]) - n).alias("b")))

    return _let(_let(_let(ordered, without_start), without_end), lambda p: banded_distance(p["a"], p["b"], edits))


# Lines of documents


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line and its two hashes for every line that is not blank."""
    # Trimmed inside the array, lines are trimmed once; behind the explode each use would trim again.
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\f")))
    line = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(trimmed).alias("pos", "line")).where("line != ''")
    return line.select("doc_id", "pos", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _sketch(line: Column) -> Column:
    """A bitmap of 64 parities, one for the words of each hash."""
    one = F.lit(1).cast("long")
    return F.aggregate(F.split(line, " "), F.lit(0).cast("long"), lambda acc, w: acc.bitwiseXOR(F.call_function("shiftleft", one, F.hash(w))))


def _letters(line: Column) -> Column:
    packed = F.lit(0).cast("long")
    for k, c in enumerate(LETTERS):
        count = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))) % 16
        packed = packed.bitwiseOR(F.call_function("shiftleft", count.cast("long"), F.lit(4 * k)))
    return packed


def _letters_apart(a: Column, b: Column) -> Column:
    """A lower bound of twice the edits between two lines."""
    count = lambda x, k: F.call_function("shiftright", x, F.lit(4 * k)).bitwiseAND(F.lit(15).cast("long"))
    each = [F.abs(count(a, k) - count(b, k)) for k in range(len(LETTERS))]
    return sum((F.least(d, 16 - d) for d in each[1:]), F.least(each[0], 16 - each[0]))


def distinct_lines(docs: DataFrame, rule: tuple[int, ...] = RULE) -> DataFrame:
    """One row a line: its hashes, the first doc_id, the bitmap of its words, and its keys (null where it is too short)."""
    made = probed(occurrences(docs), rule, F.col("h1"), F.col("h2"), F.col("doc_id"), _sketch(F.col("line")).alias("sketch"))
    # Equal lines have equal keys, so any aggregate that is combined early serves.
    return made.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.min("sketch").alias("sketch"), *[F.min(f"p{k}").alias(f"p{k}") for k in range(len(_moves(rule)))])


def _entries(lines: DataFrame, rule: tuple[int, ...], probing: bool) -> DataFrame:
    """(key, h, sketch) of the lines' probe or index keys. A line is known by 64 bits here; verification tells apart what shares them."""
    keys = [f"p{k}" for k, (d, _, x, _) in enumerate(_moves(rule)) if probing or (d, x) == (0, 0)]
    rows = lines.select(F.col("h1").alias("h"), "sketch", F.explode(F.array_distinct(F.array(*keys))).alias("key"))
    return rows.where("key is not null").select("key", "h", "sketch")


def _meet(index: DataFrame, probe: DataFrame, most: Column, limit: int = 0) -> DataFrame:
    """Pairs (a, b) of lines that share a key and whose words, and letters and rests if they are there, are no further apart than `most` edits, `limit` at most, make them."""
    known = [c for c in ("sketch", "letters", "rest") if c in index.columns]
    a = index.select(F.col("key").alias("a_key"), F.col("h").alias("a"), *[F.col(c).alias(f"a_{c}") for c in known], *[c for c in index.columns if c == "edits"])
    b = probe.select(F.col("key").alias("b_key"), F.col("h").alias("b"), *[F.col(c).alias(f"b_{c}") for c in known])
    near = F.bit_count(F.col("a_sketch").bitwiseXOR(F.col("b_sketch"))) <= FLIPS * most
    if "letters" in known:
        near = near & (_letters_apart(F.col("a_letters"), F.col("b_letters")) <= 2 * most)
    if "rest" in known:
        # Beyond the limit levenshtein is -1, of which pmod makes more than the limit.
        near = near & (F.pmod(F.levenshtein("a_rest", "b_rest", limit), F.lit(limit + 2)) <= most)
    met = a.join(b, (F.col("a_key") == F.col("b_key")) & (F.col("a") != F.col("b")) & near)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _inside(rows: DataFrame, hot: DataFrame, most: int, probing: bool) -> DataFrame:
    """The next level of what lies beside hot keys: (key, h, sketch, letters, edits, d, rest), keys of segments of the rest."""
    rest, n = F.col("rest"), F.length("rest")
    kept = rows.join(hot.select(F.col("key").alias("hot")), F.col("key") == F.col("hot")).drop("hot")

    def places(edits: int, d: int) -> Column:
        out = []
        for i, shift in moves(edits, d) if probing else [(i, 0) for i in range(edits + 1)]:
            begin, size = segment(n - d, i, edits)
            begin = begin + shift
            beside = F.concat(F.substring(rest, F.lit(1), begin - 1), F.substring(rest, begin + size, n))
            inside = (begin >= 1) & (begin + size - 1 <= n)
            out.append(F.when(inside, F.struct(F.xxhash64("key", F.substring(rest, begin, size), F.lit(i)).alias("key"), beside.alias("rest"))))
        return F.filter(F.array(*out), lambda p: p.isNotNull())

    # An array_distinct would compare the texts; a line that probes one key twice is combined behind the join.
    made, first = F.lit(None), True
    for edits in range(1, most + 1):
        for d in range(edits + 1) if probing else [0]:
            case = (F.col("edits") == edits) & (F.col("d") == d)
            made, first = (F.when(case, places(edits, d)) if first else made.when(case, places(edits, d))), False
    return kept.select("h", "sketch", "letters", "edits", "d", F.explode(made).alias("p")).select("p.key", "h", "sketch", "letters", "edits", "d", "p.rest")


def _refined(docs: DataFrame, lines: DataFrame, shared: DataFrame, rule: tuple[int, ...]) -> DataFrame:
    """Pairs of lines that meet under shared keys (key, n): what stands beside the key is within the edits too, and under hot keys they share a segment of it."""
    most = len(rule)
    either = _entries(lines, rule, True).join(shared.select(F.col("key").alias("hot")), F.col("key") == F.col("hot"))
    wanted = stage(either.select(F.col("h").alias("h1")).distinct(), "line-hot")
    known = lines.select("h1", "h2", "sketch").join(wanted, "h1").select("h1", "h2", "sketch")
    texts = _picked(occurrences(docs), wanted).distinct().join(known, ["h1", "h2"])
    texts = stage(texts.select(F.col("h1").alias("h"), "sketch", _letters(F.col("line")).alias("letters"), "line"), "line-hot-texts")
    index, probe = (texts.select("h", "sketch", "letters", F.explode(_places(F.col("line"), rule, x)).alias("p")) for x in (False, True))
    index, probe = (x.select("p.key", "h", "sketch", "letters", "p.edits", "p.d", "p.rest") for x in (index, probe))
    warm, hot = shared.where(F.col("n") < HOT).select(F.col("key").alias("warm")), shared.where(F.col("n") >= HOT).select("key")
    under = [x.join(warm, F.col("key") == F.col("warm")).drop("warm") for x in (index, probe)]
    found = stage(_meet(*under, F.col("edits"), most).distinct(), "line-pairs")
    for level in range(1, 1 if hot.isEmpty() else LEVELS):
        index, probe = stage(_inside(index, hot, most, False), "line-index"), stage(_inside(probe, hot, most, True), "line-probe")
        cold = index
        if level < LEVELS - 1:
            hot = stage(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).select("key"), "line-hot-keys")
            if not hot.isEmpty():
                cold = index.join(hot, "key", "left_anti")
        found = found.unionByName(stage(_meet(cold, probe, F.col("edits"), most).distinct(), "line-pairs"))
        if cold is index:
            break
    return found


def candidates(docs: DataFrame, lines: DataFrame, rule: tuple[int, ...] = RULE) -> DataFrame:
    """Pairs (a, b) of lines, by the first 64 bits of their hashes, that share a segment and may be within the edits; each once."""
    index, probe = (_entries(lines, rule, x) for x in (False, True))
    most = F.lit(len(rule))
    shared = stage(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED), "line-shared-keys")
    if shared.isEmpty():
        return _meet(index, probe, most).distinct()
    cold = index.join(shared.select(F.col("key").alias("hot")), F.col("key") == F.col("hot"), "left_anti")
    return _meet(cold, probe, most).unionByName(_refined(docs, lines, shared, rule)).distinct()


def _picked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The lines whose hash has its bit set in the bitmap of the wanted ones: these, and few others."""
    bit = F.pmod(F.col("h1"), F.lit(BITMAP))
    word, mask = F.call_function("shiftright", bit, F.lit(6)), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    bitmap = wanted.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    met = rows.select("h1", "h2", "line", word.alias("at"), mask.alias("mask")).join(F.broadcast(bitmap), F.col("at") == F.col("word"))  # BITMAP / 64 rows at most
    return met.where(F.col("bits").bitwiseAND(F.col("mask")) != 0).select("h1", "h2", "line")


def links(docs: DataFrame, lines: DataFrame, rule: tuple[int, ...] = RULE) -> DataFrame:
    """The verified pairs (a, b) of line ids."""
    pairs = stage(candidates(docs, lines, rule), "line-pairs")
    wanted = stage(pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct(), "line-wanted")
    # Copies go before the shuffle of the join. A semi join would be moved below the bitmap, so this is an inner one.
    texts = _picked(occurrences(docs), wanted).distinct().join(wanted, "h1")
    texts = stage(texts.select("h1", F.struct("h1", "h2").alias("id"), _letters(F.col("line")).alias("letters"), "line"), "line-texts")
    for side, near in (("a", F.lit(True)), ("b", _letters_apart(F.col("a_letters"), F.col("b_letters")) <= 2 * len(rule))):
        named = texts.select(F.col("h1").alias(f"{side}_h"), F.col("id").alias(f"{side}_id"), F.col("letters").alias(f"{side}_letters"), F.col("line").alias(f"{side}_line"))
        pairs = pairs.join(named, (F.col(side) == F.col(f"{side}_h")) & near)
    most = allowed(F.least(F.length("a_line"), F.length("b_line")), rule)
    near = pairs.where(distance(F.col("a_line"), F.col("b_line"), len(rule)) <= most)
    return near.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


def _linked(docs: DataFrame, rule: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """The distinct lines, and of those that have links the class (label) and their number: h1, h2, label, n_links."""
    lines = stage(distinct_lines(docs, rule), "lines")
    found = stage(links(docs, lines, rule), "line-links")
    labels = components(found).select(F.col("node.h1").alias("h1"), F.col("node.h2").alias("h2"), F.col("component").alias("label"))
    degree = found.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links")).select("id.h1", "id.h2", "n_links")
    return lines, stage(labels.join(degree, ["h1", "h2"]), "line-labels")


def line_classes(docs: DataFrame, rule: tuple[int, ...] = RULE) -> DataFrame:
    """One row a distinct line: id (its hashes), first_doc, copies, class (an id), n_links."""
    lines, linked = _linked(docs, rule)
    rows = lines.select("h1", "h2", "first_doc", "copies").join(linked, ["h1", "h2"], "left")
    return rows.select(F.struct("h1", "h2").alias("id"), "first_doc", "copies", F.coalesce("label", F.struct("h1", "h2")).alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _keepers(docs: DataFrame, rule: tuple[int, ...]) -> DataFrame:
    """One row a distinct line: h1, h2, class, n_links and keeper, the least doc_id that holds a line of its class."""
    lines, linked = _linked(docs, rule)
    firsts = lines.select("h1", "h2", "first_doc")
    # Only lines with links need another line's document.
    keeper = stage(firsts.join(linked, ["h1", "h2"]).groupBy(F.col("label").alias("of")).agg(F.min("first_doc").alias("keeper")), "line-firsts")
    named = stage(linked.join(keeper, F.col("label") == F.col("of")).drop("of"), "line-named")
    rows = firsts.join(named, ["h1", "h2"], "left")
    rows = rows.select("h1", "h2", F.coalesce("label", F.struct("h1", "h2")).alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("label").isNull(), F.col("first_doc")).otherwise(F.col("keeper")).alias("keeper"))
    out = stage(rows, "line-keepers")
    drop_staged(lines)
    return out


def summary(docs: DataFrame, rule: tuple[int, ...] = RULE) -> DataFrame:
    """One row per document.

    doc_id, n_lines (line feeds and one), n_kept (lines that are the first of their class), class_id (the least
    doc_id of the documents that are connected with it by lines of one class, itself included; null for a null id),
    n_links (links of its lines, each as often as it stands there).
    """
    keepers = _keepers(docs, rule)
    kept = keepers.select("class", "keeper").distinct().groupBy("keeper").agg(F.count("*").alias("n_kept"))
    # A very common line meets one row in this join, which AQE splits.
    met = occurrences(docs).select("doc_id", "h1", "h2").join(keepers.select("h1", "h2", "n_links", F.col("keeper").alias("first")), ["h1", "h2"])
    met = stage(met.groupBy(F.col("doc_id").alias("doc"), "first").agg(F.sum("n_links").alias("n_links")), "line-held")
    # All documents of a class are connected with the one that keeps it.
    joined = stage(components(met.where("doc != first").select(F.col("doc").alias("a"), F.col("first").alias("b"))), "line-documents")
    found = met.groupBy("doc").agg(F.sum("n_links").alias("n_links"))
    found = found.join(kept, F.col("doc").eqNullSafe(F.col("keeper")), "left").drop("keeper").join(joined, F.col("doc") == F.col("node"), "left").drop("node")
    count = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(count, F.lit(0)).cast("long").alias("n_lines"))
    zero = F.lit(0).cast("long")
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("doc")), "left")
    return rows.select("doc_id", "n_lines", F.coalesce("n_kept", zero).alias("n_kept"), F.coalesce("component", "doc_id").alias("class_id"), F.coalesce("n_links", zero).alias("n_links"))


def deduplicate(docs: DataFrame, rule: tuple[int, ...] = RULE) -> DataFrame:
    """The documents with the lines that are kept, and blank ones; other columns stay.

    Rows that share a doc_id should be told apart before.
    """
    name = private(docs)
    named = _keepers(docs, rule).select("h1", "h2", "class", "keeper")
    rows = occurrences(docs).select("doc_id", "pos", "h1", "h2").join(named, ["h1", "h2"])
    # Of the class's lines in the document that keeps it, the first stays. Only lines that go are brought together.
    mine = rows.where(F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("doc_id", "class").agg(F.min("pos").alias("stays"))
    mine = mine.withColumnRenamed("doc_id", "at").withColumnRenamed("class", "of")
    marked = rows.join(mine, F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("class") == F.col("of")), "left")
    gone = marked.where(F.col("stays").isNull() | (F.col("pos") != F.col("stays")))
    gone = gone.groupBy(F.col("doc_id").alias(name("doc"))).agg(F.collect_set("pos").alias(name("gone")))  # lines of one document

    def left(parts: Column) -> Column:
        # By the set of positions, as a search of a list for each line would grow with the square of a text.
        stays = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(name("gone")))
        return F.array_join(F.transform(stays, lambda i: F.get(parts, i)), "\n")

    text = F.when(F.col(name("gone")).isNull(), F.col("text")).otherwise(_let(F.split("text", "\n"), left))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(name("doc"))), "left").withColumn("text", text).select(*docs.columns)
