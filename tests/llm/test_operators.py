"""Each operator against a brute-force version or an exact round trip, on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.llm import _shared as shared
from nearfield.llm import components, decontaminate, fingerprint, language, lines, mixing, neardup, quality, queries, tokens, unigram, warc
from tests.llm.conftest import SCHEMA, documents, words
from tests.oracle import rows, same

SF = "/root/testdata/sf0.001"


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same(queries.queries()[name](spark, SF).toPandas(), queries.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_reruns_agree(spark, name):
    first, second = (queries.queries()[name](spark, SF).toPandas() for _ in range(2))
    assert rows(first) == rows(second) and len(first)


# 1


def plain_scan(docs, items, n=8):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    fold = lambda t: re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for item, text in items:
        w = fold(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    for doc, text in docs:
        w, hit, found = fold(text), set(), set()
        for size in {len(k) for k in wins}:
            for i in range(len(w) - size + 1):
                if (owners := wins.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    found |= owners
        yield doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(found) >= 2


@pytest.mark.parametrize("bound", [decontaminate.MAX_WINDOWS, 0])
def test_decontamination(spark, odd, bound):
    items = [(1, words(12, 3)), (10, words(12, 3)), (2, "One, TWO"), (3, None), (4, "!!"), (5, "漢字 x"), (2, words(9, 99)), (None, base) if (base := words(40, 3)) else None]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(odd, bench, max_windows=bound)
    want = list(plain_scan([(r.doc_id, r.text) for r in odd.collect()], [i for i in items if i[0] is not None]))
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:6] for r in got.collect()), key=key) == sorted(want, key=key)
    clean = decontaminate.decontaminate(odd, bench, max_windows=bound)
    assert clean.schema.names == odd.schema.names
    left = {r.doc_id: r.text for r in clean.where("doc_id is not null").collect()}
    assert left[12] == left[13] == "" and left[14] == "é ß  \U0001f600 "[:-1] or left[14].startswith("é ß")
    assert 5 not in left and 7 in left and 9 in left
    assert decontaminate.scan(odd, bench.limit(0), max_windows=bound).where("n_hit > 0").count() == 0
    assert decontaminate.scan(odd.limit(0), bench, max_windows=bound).count() == 0


def test_both_bounds_clean_alike(spark):
    """Null ids and ids that rows share: the join decides by id and text, like the broadcast."""
    one, two, plain = words(12, 301), words(12, 302), words(30, 303, 3000)
    bench = spark.createDataFrame([(1, one), (2, two)], "item_id long, text string")
    bad = f"{one} . {two}"
    table = [(None, bad), (None, f"{plain} {one}"), (None, plain), (None, None), (5, bad), (5, plain), (6, f"{plain} {one} {plain}"), (6, "short"), (6, f"{two} {plain}"), (7, f"{one} end"), (7, f"{one} end"), (8, None)]
    docs = documents(spark, table)
    for name in ("_gone", "_key", "_row", "_spans", "_nf", "_nf_spans", "row", "items"):
        docs = docs.withColumn(name, F.col("n_chars"))
    key = lambda r: tuple(map(str, r))
    broadcast, joined = (sorted((tuple(r) for r in decontaminate.decontaminate(docs, bench, max_windows=bound).collect()), key=key) for bound in (decontaminate.MAX_WINDOWS, 0))
    assert broadcast == joined and len(joined) == len(table) - 2


def test_join_on_large_texts_is_linear(spark):
    """Hit words far apart in a long text, windows that all items hold, overlapping runs; against the broadcast set."""
    common = words(9, 4000)
    items = [(i, f"{common} {words(12, 600 + i)}") for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    long = " ".join(f"{words(300, 900 + i, 9000)} {items[i % 40][1] if i % 3 else common}" for i in range(200))
    docs = documents(spark, [(1, long), (2, common), (3, common), (4, words(400, 5, 9000)), (5, None)])
    got = [sorted(str(tuple(r)) for r in decontaminate.scan(docs, bench, max_windows=b).collect()) for b in (decontaminate.MAX_WINDOWS, 0)]
    assert got[0] == got[1] and "40" in got[0][0]


def test_cut_removes_runs():
    assert decontaminate.cut("Keep this, DROP: that now. End", [(2, 4)]) == "Keep this,  now. End"


# 2


def test_language(spark):
    make = {"xa": lambda s: words(40, s).replace("w", "za"), "yb": lambda s: words(40, s).replace("w", "ok"), "zc": lambda s: "été " + words(30, s).replace("w", "éà")}
    docs = documents(spark, [(i, make[lang](i), lang) for i, lang in enumerate(sorted(make) * 60)])
    got = by_id(language.identify(docs))
    want = {r.doc_id: r.lang for r in docs.collect()}
    assert sum(got[i].lang_pred == want[i] for i in got) >= 0.98 * len(got)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    assert not any(r.rejected for r in got.values())
    model = language.fit(docs)
    strange = by_id(language.classify(documents(spark, [(1, "漢字" * 50), (2, "qqjj xxkk qqjj"), (3, None), (4, "12 !"), (5, make["xa"](7))]), model))
    assert strange[1].rejected and strange[2].rejected and strange[3].lang_pred == strange[4].lang_pred == "und" and not strange[5].rejected


def test_language_rejects_what_was_left_out(spark):
    """Each language in turn is left out of training: nearly all of its texts go, hardly any of the others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("length(text) > 100 and lang is not null")
    langs = sorted(r.lang for r in docs.select("lang").distinct().collect())
    assert len(langs) > 2
    for left_out in langs:
        model = language.fit(docs.where(~language.held_out(F.col("doc_id")) & (F.col("lang") != left_out)))
        got = language.classify(docs.where(language.held_out(F.col("doc_id")) | (F.col("lang") == left_out)), model).collect()
        share = lambda rows: sum(r.rejected for r in rows) / len(rows)
        assert share([r for r in got if r.lang == left_out]) >= 0.95, left_out
        assert share([r for r in got if r.lang != left_out]) <= 0.02, left_out


def plain_trigrams(text):
    """Counts of byte trigrams by their place, from the definition."""
    folded = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in text.encode())
    padded = b" " + b" ".join(folded.split()) + b" "
    return Counter((int.from_bytes(padded[i : i + 3], "big") * 2654435761 % 2**32) >> 20 for i in range(len(padded) - 2))


def test_language_by_definition(spark, odd):
    """Frequencies, vectors, cosines and limits of single texts, over dictionaries."""
    docs = documents(spark, [(i, words(10 + i % 50, i) + (" été çà" if i % 2 else ""), "fr" if i % 2 else "en") for i in range(200)])
    model = language.fit(docs)
    table = [r.text for r in docs.collect()]
    seen = Counter(place for t in table for place in plain_trigrams(t))
    idf = {p: np.log((1 + len(table)) / (1 + n)) + 1 for p, n in seen.items()}
    assert all(model.idf[p] == pytest.approx(idf.get(p, np.log(1 + len(table)) + 1), rel=1e-5) for p in range(language.DIMS))
    for r in language.classify(docs.unionByName(odd), model).collect():
        found = plain_trigrams(r.text or "")
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0, True)
            continue
        weighed = {p: n * float(model.idf[p]) for p, n in found.items()}
        length = sum(v * v for v in weighed.values()) ** 0.5
        cosines = [sum(v * float(c[p]) for p, v in weighed.items()) / length for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert r.score == pytest.approx(max(0, cosines[best]), abs=1e-4) and (r.lang_pred == model.langs[model.owner[best]] or sorted(cosines)[-1] - sorted(cosines)[-2] < 1e-4)
        limit = model.least[model.owner[best]] * min(1, len(found) / language.ENOUGH) ** 0.5
        assert r.rejected == (r.score < limit) or abs(r.score - limit) < 1e-4


def test_language_rejects_junk(spark):
    """Keys, encoded bytes and keyboard noise go; of held-out texts hardly any."""
    import base64

    rng = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    tested = language.classify(docs.where(language.held_out(F.col("doc_id"))), model).collect()
    assert sum(r.rejected for r in tested) <= 0.01 * len(tested)
    junk = [base64.b64encode(rng.randbytes(150)).decode() for _ in range(60)] + [rng.randbytes(200).hex() for _ in range(60)] + [" ".join("".join(rng.choice("qxzjkvwpg") for _ in range(6)) for _ in range(40)) for _ in range(60)] + ["漢字仮名" * 30, "привет мир " * 20, "0x1f&&||;{}" * 20]
    got = language.classify(documents(spark, list(enumerate(junk))), model).collect()
    assert sum(r.rejected for r in got) >= 0.95 * len(got)


def test_language_odd(spark, odd):
    assert language.identify(odd).count() == odd.count()
    assert language.identify(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 3


def test_warc(spark, tmp_path):
    big = "<p>" + words(20000, 1) + "\r\n\r\n" + "é漢" * 999
    pages = [(1, "http://a b", "x\r\n\r\ny"), (2, None, big), (3, "u", None), (4, "u", ""), (9, "u", big), (5, "u", "x\r\n\r\ny"), (9, "v", big), (None, "n", "alone"), (6, "u", "a" * 16384)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.roundtrip(df).collect()
    best = {}
    for p, _, h in pages:
        best[h or ""] = max(best.get(h or "", -1), -1 if p is None else p)
    import base64

    want = [(p, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", None) if p is None or p == best[h or ""] else ("revisit", best[h or ""]))) for p, _, h in pages]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    path = str(tmp_path / "w")
    warc.write(df, path, least_revisit=10**9)
    whole = warc.read(spark, path).collect()
    assert sorted((bytes(r.payload).decode() for r in whole)) == sorted((h or "") for _, _, h in pages)
    assert warc.roundtrip(df.limit(0)).count() == 0


def test_warc_finds_damage():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    assert warc.payload_of(block) == b"abc"
    with pytest.raises(ValueError, match="chunk"):
        warc.dechunk(b"5\r\nabc\r\n0\r\n\r\n")
    with pytest.raises(ValueError, match="two line ends"):
        list(warc.parse(b"WARC/1.1\r\nWARC-Record-ID: <a>\r\nContent-Length: 1\r\n\r\nabc\r\n\r\n"))


def test_warc_segments_are_checked(spark):
    part = lambda n, total, data: ("o", n, total, "response", 1, None, None, None, data)
    schema = "origin string, segment int, total long, kind string, page_id long, url string, refers_to long, digest string, data binary"
    good = [part(2, 20, b"\r\n\r\nab"), part(1, None, b"HTTP/1.1 200 "), part(3, None, b"c")]
    assert bytes(warc._reassembled(spark.createDataFrame(good, schema)).first().data) == b"abc"
    for bad in (good[:2], [*good[:1], *good[2:]]):
        with pytest.raises(Exception, match="segments"):
            warc._reassembled(spark.createDataFrame(bad, schema)).collect()


# 4


def plain_signature(text):
    """Order MinHash by its definition over dictionaries, with the operator's hashes."""
    points = fingerprint.points_of(text.encode())
    if not len(points):
        return np.zeros(fingerprint.BINS, np.uint64)
    seen, numbered = Counter(), []
    for pos, h in enumerate(fingerprint.kmer_hashes(points).tolist()):
        code = h >> 24
        numbered.append((code, seen[code], pos))
        seen[code] += 1
    bins = {}
    for code, occ, pos in numbered:
        x = int(fingerprint._mix((np.array([code], np.uint64) * fingerprint._A + np.array([occ], np.uint64) * fingerprint._B))[0])
        bins.setdefault(x >> 58, []).append((x >> 24, pos, x))
    out = []
    for b in range(fingerprint.BINS):
        chosen = sorted(sorted(bins.get(b, []), key=lambda t: (t[0],))[: fingerprint.TUPLE], key=lambda t: t[1])
        value = np.zeros(1, np.uint64)
        for j in range(fingerprint.TUPLE):
            value = fingerprint._mix(value * fingerprint._A + np.array([chosen[j][2] if j < len(chosen) else 0], np.uint64) + np.uint64(j + 1))
        out.append(int(value[0] >> np.uint64(64 - 8 * fingerprint.KEPT)) | 1 if chosen else 0)
    return np.array(out, np.uint64)


@pytest.mark.parametrize("text", ["", "a", "abab" * 30, words(300, 2), "é漢\U0001f600" * 20])
def test_signature_by_definition(text):
    assert (fingerprint.signature(fingerprint.points_of(text.encode())) == plain_signature(text)).all()


@pytest.mark.parametrize("size", [2000, 3])
def test_fingerprints(spark, odd, monkeypatch, size):
    table = [(r.doc_id, r.text or "") for r in odd.collect()]
    table.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    docs = fingerprint.with_next(odd, size)
    monkeypatch.setattr(fingerprint, "with_next", lambda d, rows=None: docs)
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in fingerprint.fingerprints(odd).collect()]
    want = []
    for i, (doc, text) in enumerate(table):
        after = table[(i + 1) % len(table)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        a, b, c = (fingerprint.signature(fingerprint.points_of(t.encode())) for t in (text, edited, after))
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.encode(a), fingerprint.likeness(a, b), fingerprint.likeness(a, c)))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_order_matters(spark):
    """Swapping halves keeps nearly all k-mers but changes tuples; a small edit changes few."""
    text = words(400, 8)
    sig = lambda t: fingerprint.signature(fingerprint.points_of(t.encode()))
    swapped = text[len(text) // 2 :] + " " + text[: len(text) // 2]
    assert fingerprint.likeness(sig(text), sig(text[:50] + "X" + text[51:])) > 0.8 > 0.75 > fingerprint.likeness(sig(text), sig(swapped))
    empty = spark.createDataFrame([], SCHEMA)
    assert fingerprint.fingerprints(empty).count() == 0
    alone = fingerprint.fingerprints(documents(spark, [(1, "abcdefgh")])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and alone.near_next == 1


@pytest.mark.parametrize("heavy", [None, 7])
def test_ranges_of_a_heavy_id(spark, heavy):
    """An id, or null, that a third of all rows share is split by texts; files and neighbours stay in order."""
    table = [(heavy, words(5 + i % 7, i)) for i in range(200)] + [(10 + i, words(4, 500 + i)) for i in range(380)] + [(3, "same text")] * 9
    docs = documents(spark, table)
    ranges = shared.id_ranges(docs, "doc_id", 20)
    placed = docs.select("doc_id", "text", ranges.part(F.col("doc_id"), F.col("text").cast("binary")).alias("part")).collect()
    held = Counter(r.part for r in placed)
    assert set(held) == set(range(len(ranges.leads))) and max(held.values()) < 80
    assert all(ranges.leads[p] == min((r.doc_id for r in placed if r.part == p), key=lambda d: (d is None, d or 0)) for p in held)
    part = {(r.doc_id, r.text): r.part for r in placed}
    order = sorted(table, key=lambda r: (part[r], r[0] is not None, r[0] or 0, r[1].encode()))
    assert [r[0] for r in order] == [r[0] for r in sorted(order, key=lambda r: (r[0] is not None, r[0] or 0))]
    want = Counter((doc, hashlib.sha256((t[: len(t) - len(t) // 4] + order[(i + 1) % len(order)][1][: len(t) // 4]).encode()).hexdigest()) for i, (doc, t) in enumerate(order))
    dealt = fingerprint.with_next(docs, 20)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(fingerprint, "with_next", lambda d, rows=None: dealt)
        assert Counter((r.doc_id, r.edited_sha256) for r in fingerprint.fingerprints(docs).collect()) == want


# 5


def plain_components(table, link=85):
    sets = []
    for _, text in table:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(table)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(table)):
        for j in range(i):
            if table[i][0] is not None and table[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= link * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(table):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, len(sets[i]), None if doc is None else least[root(i)]) for i, (doc, _) in enumerate(table)]


def edited(text, rng, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates(spark, odd):
    rng = random.Random(4)
    table = [(r.doc_id, r.text) for r in odd.collect()]
    for base in range(6):
        text = words(rng.choice([20, 120, 1500]), 50 + base, 5000)
        table += [(100 + 40 * base + k, edited(text, rng, rng.randrange(6))) for k in range(30)]
    rng.shuffle(table)
    docs = documents(spark, table)
    got = neardup.near_duplicates(docs).collect()
    want = plain_components(table)
    assert sorted(str(tuple(r)[:3]) for r in got) == sorted(map(str, want))
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    left = neardup.deduplicate(docs)
    assert left.schema.names == docs.schema.names
    assert sorted({r.doc_id for r in left.collect() if r.doc_id is not None}) == sorted({r.doc_id for r in got if r.kept and r.doc_id is not None})
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_link_threshold_is_a_parameter(spark):
    """Pairs between 0.80 and 0.85, of few shingles and of many, are linked at 80 and not at 85."""
    table = []
    for base, n in enumerate((60, 400, 3000)):
        w = words(n, 300 + base, 90000).split()
        other = list(w)
        for k in range(n // 50):
            other[30 + 50 * k] = f"e{k}"
        table += [(10 * base, " ".join(w)), (10 * base + 1, " ".join(other))]
    docs = documents(spark, table)
    share = [len(a & b) / len(a | b) for a, b in ((set(neardup.Shingler().of(table[i][1].encode()).tolist()), set(neardup.Shingler().of(table[i + 1][1].encode()).tolist())) for i in (0, 2, 4))]
    assert all(0.8 <= x < 0.85 for x in share)
    assert sorted(r.doc_id for r in neardup.deduplicate(docs).collect()) == [0, 1, 10, 11, 20, 21]
    assert sorted(r.doc_id for r in neardup.deduplicate(docs, 80).collect()) == [0, 10, 20]
    assert neardup.most_bits(link=80) > neardup.most_bits()


def test_large_group_needs_no_pairs(spark):
    """A group of near copies becomes one component; only a hub's links and those across labels are looked at."""
    rng = random.Random(9)
    text = words(200, 77, 5000)
    docs = documents(spark, [(i, edited(text, rng, 1)) for i in range(400)])
    assert {r.component_id for r in neardup.near_duplicates(docs).collect()} == {0}


def templated(n, rng):
    """Texts that have most of their words in common, too unlike to be linked, and a near copy of every hundredth."""
    common = words(150, 4242, 5000).split()
    out = []
    for i in range(n):
        own = [f"o{rng.randrange(10**9)}" for _ in range(50)]
        text = " ".join(common + own)
        out.append((i, text))
        if i % 100 == 0:
            out.append((10**6 + i, text + " more"))
    return out


def test_template_makes_no_pairs_of_all(spark, monkeypatch):
    """Buckets of many unlike members: pairs are in proportion to documents, links those of all pairs."""
    made, rare = {}, neardup._rare_pairs
    monkeypatch.setattr(neardup, "MEMBERS", 64)

    def counting(entries, sets, link):
        pairs = shared.stage(rare(entries, sets, link), "counted")
        made[now] = pairs.count()
        return pairs

    monkeypatch.setattr(neardup, "_rare_pairs", counting)
    for now in (600, 1200):
        table = templated(now, random.Random(now))
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(spark, table)).collect()}
        assert got == {d: d % 10**6 for d, _ in table}
    assert made and all(m <= n for n, m in made.items())


@pytest.mark.parametrize("members", [0, 3])
def test_rare_shingles_miss_no_link(spark, odd, monkeypatch, members):
    """The search by rarest shingles for all buckets, or nearly all, against all pairs."""
    monkeypatch.setattr(neardup, "MEMBERS", members)
    monkeypatch.setattr(neardup, "MOST_ROUNDS", 1)
    rng = random.Random(14)
    table = []
    for base in range(5):
        text = words(rng.choice([25, 130, 1500]), 80 + base, 5000)
        table += [(100 + 40 * base + k, edited(text, rng, rng.randrange(9))) for k in range(25)]
    got = neardup.near_duplicates(documents(spark, table)).collect()
    assert sorted(str(tuple(r)[:3]) for r in got) == sorted(map(str, plain_components(table)))


def test_sampled_sketches_keep_links_of_large_sets():
    """Recall of the limit for sets of over WHOLE shingles at the threshold: no pair of these is lost."""
    rng = np.random.default_rng(8)
    for link in (80, 85):
        lost = 0
        for _ in range(60):
            n = int(rng.integers(1100, 4000))
            x = rng.integers(0, 1 << 63, n, np.uint64)
            differ = round(n * (100 - link) / (100 + link))
            y = np.concatenate((x[differ:], rng.integers(0, 1 << 63, differ, np.uint64)))
            bits = np.bitwise_count((neardup.odd_sketch(np.unique(x)) ^ neardup.odd_sketch(np.unique(y))).view(np.uint64)).sum()
            lost += bits > neardup.most_bits(link=link)
        assert lost == 0


def test_sketch_of_whole_sets_never_exceeds_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, 500, np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 63, 30, np.uint64))))
        bits = np.bitwise_count((neardup.odd_sketch(a) ^ neardup.odd_sketch(b)).view(np.uint64)).sum()
        assert 0.8 * len(np.setxor1d(a, b)) - 5 <= bits <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [(500, x) for x in range(501, 600)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in linked}


def test_components_of_few_links_take_one_task_a_step(spark):
    edges = spark.createDataFrame([(5, 1), (5, 3), (4, 3), (9, 8), (9, 2)], "a long, b long").repartition(4, "a")
    for large in (True, False):
        each, one = components._star(edges, large), components._star(edges, large, True)
        assert sorted(each.collect()) == sorted(one.collect()) and len(one.inputFiles()) == 1


# 6


def plain_lines(table):
    occ = [(doc, t) for doc, text in table for line in (text or "").split("\n") if (t := line.strip(" \t\r\x0b\x0c"))]
    first = {}
    rank = lambda d: (d is None, d or 0)
    for doc, line in occ:
        first[line] = min(first.get(line, doc), doc, key=rank)

    def near(a, b):
        most = sum(min(len(a), len(b)) >= n for n in lines.RULE)
        if not most or abs(len(a) - len(b)) > most:
            return False
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            new = [i + 1]
            for j, d in enumerate(b):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1] <= most

    all_lines = list(first)
    parent, degree = {x: x for x in first}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(all_lines):
        for b in all_lines[:i]:
            if near(a, b):
                parent[root(a)] = root(b)
                degree[a] += 1
                degree[b] += 1
    keeper = {}
    for x in first:
        keeper[root(x)] = min(keeper.get(root(x), first[x]), first[x], key=rank)
    kept = Counter(keeper.values())
    held = {}
    for doc, line in occ:
        held.setdefault(doc, []).append(line)
    group = {doc: doc for doc, _ in table}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for doc, found in held.items():
        for x in found:
            if doc is not None and (k := keeper[root(x)]) is not None and top(doc) != top(k):
                group[max(top(doc), top(k))] = min(top(doc), top(k))
    return [(doc, 0 if text is None else text.count("\n") + 1, kept[doc], top(doc), sum(degree[x] for x in held.get(doc, []))) for doc, text in table]


def test_line_dedup(spark):
    rng = random.Random(6)
    pool = [words(5, 900 + i) + " é" * (i % 3) for i in range(30)] + ["short", "tiny one", "", "eight ch", "fifteen charact", "sixteen characte"]
    table = []
    for doc in [*range(25), None]:
        text = []
        for _ in range(rng.randrange(1, 9)):
            line = rng.choice(pool)
            if line and rng.random() < 0.5:
                k = rng.randrange(len(line))
                line = rng.choice([line[:k] + line[k + 1 :], line[:k] + "z" + line[k:], line[:k] + "é" + line[k + 1 :], line[:k] + "éz" + line[k:], line[1:k] + "q" + line[k:], f" {line}\t", line])
            text.append(line)
        table.append((doc, "\n".join(text)))
    table += [(90, None), (91, ""), (92, "\n \n")]
    docs = documents(spark, table)
    want = plain_lines(table)
    assert sorted(str(tuple(r)) for r in lines.summary(docs).collect()) == sorted(map(str, want))
    clean = lines.deduplicate(docs)
    assert clean.schema.names == docs.schema.names
    kept = {r.doc_id: sum(bool(x.strip()) for x in (r.text or "").split("\n")) for r in clean.collect()}
    assert kept == {w[0]: w[2] for w in want}
    assert lines.summary(docs.limit(0)).count() == 0


def test_bit_parallel_distance(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(400):
        a = [rng.choice("abé") for _ in range(rng.randrange(14))]
        b = list(a)
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice([[], ["a"], ["b"]])
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 4):
        wrong = df.where(F.least(lines.distance(F.col("a"), F.col("b"), edits), F.lit(edits + 1)) != F.least(F.levenshtein("a", "b"), F.lit(edits + 1)))
        assert wrong.count() == 0


def near_lines(rng, n, letters="ab", lengths=(6, 26), edits=2, prefix="", suffix=""):
    """Lines and edited ones of theirs, with what they have in common before and behind."""
    out = []
    for _ in range(n):
        x = "".join(rng.choice(letters) for _ in range(rng.randrange(*lengths)))
        y = list(x)
        for _ in range(edits):
            k = rng.randrange(len(y) + 1)
            y[k : k + rng.randrange(2)] = rng.choice([[], [letters[0]], [letters[1]]])
        out += [prefix + x + suffix, prefix + "".join(y) + suffix]
    return out


def test_edits_flip_few_bits(spark):
    """Lines within an edit differ in FLIPS bits of their words' bitmaps at most; blanks are edited too."""
    rng = random.Random(12)
    pairs = []
    for _ in range(500):
        x = "".join(rng.choice("ab  é") for _ in range(20))
        k = rng.randrange(20)
        pairs.append((x, rng.choice([x[:k] + x[k + 1 :], x[:k] + rng.choice(" a") + x[k:], x[:k] + rng.choice(" b") + x[k + 1 :]])))
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.where(F.bit_count(lines._sketch(F.col("a")).bitwiseXOR(lines._sketch(F.col("b")))) > lines.FLIPS).count() == 0
    long = df.select(*[F.concat(F.repeat(F.lit("eton "), 50), c).alias(c) for c in "ab"])
    assert long.where(lines._letters_apart(lines._letters(F.col("a")), lines._letters(F.col("b"))) > 2).count() == 0


def linked_lines(spark, texts, rule):
    """The operator's links, and those of all pairs."""
    docs = documents(spark, list(enumerate(texts)))
    found = {tuple(sorted((tuple(r.a), tuple(r.b)))) for r in lines.links(docs, lines.distinct_lines(docs, rule), rule).collect()}
    every = lines.occurrences(docs).select("line", F.struct("h1", "h2").alias("id")).distinct()
    a, b = every.toDF("x", "a"), every.toDF("y", "b")
    want = a.crossJoin(b).where((F.col("a") < F.col("b")) & (F.levenshtein("x", "y") <= lines.allowed(F.least(F.length("x"), F.length("y")), rule)))
    return found, {tuple(sorted((tuple(r.a), tuple(r.b)))) for r in want.collect()}


@pytest.mark.parametrize("rule", [(16,), (8, 16), (4, 9, 14)])
def test_segments_miss_no_pair(spark, rule):
    found, want = linked_lines(spark, near_lines(random.Random(len(rule)), 60, edits=len(rule)), rule)
    assert found == want and len(want) > 10


def test_common_segments_miss_no_pair(spark, monkeypatch):
    """The same where all keys of several lines are refined, to the last level, and lines share their starts or ends."""
    for name in ("SAMPLED", "HOT_SAMPLE"):
        monkeypatch.setattr(lines, name, 1 if name == "SAMPLED" else 2)
    monkeypatch.setattr(lines, "HOT", 3)
    rng = random.Random(4)
    texts = near_lines(rng, 40) + near_lines(rng, 40, prefix="2024-01-01 12:00:00 ") + near_lines(rng, 30, suffix=" all rights reserved")
    found, want = linked_lines(spark, texts, lines.RULE)
    assert found == want and len(want) > 50


def test_common_segment_makes_no_pairs_of_all(spark):
    """Lines with one common half: candidates are in proportion to lines, of which a few are near copies."""
    rng = random.Random(2)
    other = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40))
    common, made = other(), {}
    for n in (3000, 6000):
        texts = [common + other() for _ in range(n)]
        texts += [t[:70] + "#" + t[71:] for t in texts[:20]]
        docs = documents(spark, list(enumerate(texts)))
        known = lines.distinct_lines(docs).cache()
        pairs = lines.candidates(docs, known).cache()
        made[n] = pairs.count()
        assert lines.links(docs, known).count() == 20
    assert all(20 <= m <= 2 * n for n, m in made.items())


@pytest.mark.parametrize(("shared", "hot"), [(2, 4), (2, 1000)])
def test_rests_compared_inside_the_join_miss_no_pair(spark, monkeypatch, shared, hot):
    for name, value in (("SAMPLED", 1), ("HOT_SAMPLE", 2), ("SHARED", shared), ("HOT", hot)):
        monkeypatch.setattr(lines, name, value)
    rng = random.Random(9)
    texts = near_lines(rng, 30) + near_lines(rng, 30, prefix="2024-01-01 12:00:00 ") + near_lines(rng, 30, suffix=" all rights reserved")
    found, want = linked_lines(spark, texts, lines.RULE)
    assert found == want and len(want) > 50


@pytest.mark.parametrize("size", [40, 400])
def test_near_copies_beyond_the_edits_make_no_pairs_of_all(spark, size):
    """Copies of a line with one word in other orders of its letters: by words and letters they may be two edits apart."""
    rng = random.Random(3)
    base = [words(12, i) for i in range(10 if size == 40 else 1)]
    orders = [list("abcdefgh") for _ in range(size)]
    for o in orders:
        rng.shuffle(o)
    texts = sorted({" ".join([*b.split()[:6], "".join(o), *b.split()[6:]]) for b in base for o in orders})
    docs = documents(spark, list(enumerate(texts)))
    known = lines.distinct_lines(docs).cache()
    assert lines.candidates(docs, known).count() <= 2 * len(texts)
    found, want = linked_lines(spark, texts, lines.RULE)
    assert found == want


def test_keys_of_few_lines_are_counted_whatever_the_size(spark):
    """24 such lines beside 2,000 unlike ones: too few for a sample to show."""
    rng = random.Random(8)
    orders = [list("abcdefgh") for _ in range(24)]
    for o in orders:
        rng.shuffle(o)
    base = words(12, 1).split()
    texts = sorted({" ".join([*base[:6], "".join(o), *base[6:]]) for o in orders}) + [words(9, 100 + i, 100_000) for i in range(2000)]
    docs = documents(spark, list(enumerate(texts)))
    known = lines.distinct_lines(docs).cache()
    assert lines.candidates(docs, known).count() <= 48


# 7


def test_plan_of_a_mix_is_small(spark, odd):
    """Draws and pieces in the plan of the mix took hundreds of MB of the driver."""
    assert mixing.mix(odd)._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 4


def test_mixing(spark, odd):
    got = mixing.plan(odd).collect()
    assert len(got) == odd.count()
    table = [(i, words(20 + i % 90, i), "en", f"s{min(i % 7, 3)}" if i % 11 else None) for i in range(900)] + [(9001, None, "en", "empty"), (9001, None, "en", "empty")]
    docs = documents(spark, table)
    got = mixing.plan(docs).collect()
    size = {i: len((t or "").split()) for i, t, *_ in table}
    by_source = Counter()
    for i, t, _, s in table:
        by_source[s] += len((t or "").split())
    order = [*sorted(s for s in by_source if s), None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left = {}, set(order)
    while True:  # share, cut what is above its cap, share again
        total = sum(by_source.values()) - sum(target.values())
        share = {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * by_source[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * by_source[s]
        left -= over
    name = {i: s for i, _, _, s in table}
    taken = Counter()
    for r in got:
        s = name[r.doc_id]
        assert r.target == pytest.approx(target[s]) and r.source_size == by_source[s] and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 1 for s in order)
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_mix_gives_out_what_is_taken(spark):
    """Words given out of each document are those taken of it, of long documents and short ones; passages are its own."""
    rng = random.Random(11)
    length = lambda: rng.choice([rng.randrange(20, 300), rng.randrange(2000, 4000)])
    text = {i: "\n".join(words(n, 7 * i + k, 5000) for k, n in enumerate((length(), 30))) for i in range(300)}
    docs = documents(spark, [(i, t, "en", f"s{i % 3}") for i, t in text.items()])
    for name in ("_key", "_copy", "_nf", "_nf_digest", "digest"):
        docs = docs.withColumn(name, F.col("doc_id").cast("string"))
    mixed = mixing.mix(docs)
    assert mixed.schema.names == docs.schema.names
    got, whole, part = Counter(), Counter(), 0
    for r in mixed.collect():
        got[r.doc_id] += len(r.text.split())
        assert r["_nf_digest"] == r["_key"] == r["_copy"] == str(r.doc_id) and r.text in text[r.doc_id] and r.text == r.text.strip()
        whole[r.doc_id] += r.text == text[r.doc_id]
        part += r.text != text[r.doc_id]
    shares = {r.doc_id: r for r in mixing.plan(docs).collect()}
    assert {i: r.taken for i, r in shares.items() if r.taken} == dict(got) and part and any(whole.values())
    size = Counter()
    taken, target = Counter(), {}
    for i, r in shares.items():
        size[i % 3] += r.size
        taken[i % 3] += got[i]
        target[i % 3] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in range(3)) and min(target[s] / size[s] for s in range(3)) < 0.5


def test_mix_of_odd_rows(spark, odd):
    """Repeated rows, null ids and null texts: words are those of the plan, by id and text."""
    plan, got = Counter(), Counter()
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, set()).add(r.text)
    for r in mixing.plan(odd).collect():
        plan[r.doc_id] += r.taken
    for r in mixing.mix(odd).collect():
        got[r.doc_id] += len(r.text.split())
        assert any(t and r.text in t for t in texts[r.doc_id])
    assert {k: n for k, n in plan.items() if n} == dict(got)


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 100, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), mixing._keys(F.lit(3).cast("long"), F.lit(1).cast("long"))).alias("x"))
        got = [r.x for r in df.collect()]
        assert sorted(got) == list(range(n)) and (n < 100 or got != sorted(got))


def test_permutation_beyond_31_bits(spark):
    n = 1 << 40
    df = spark.range(4000).select(mixing.permuted(F.col("id") * 1000, F.lit(n).cast("long"), mixing._keys(F.lit(3).cast("long"), F.lit(1).cast("long"))).alias("x"))
    got = np.array([r.x for r in df.collect()])
    assert len(set(got.tolist())) == 4000 and got.min() >= 0 and got.max() < n
    assert (np.histogram(got, 8, (0, n))[0] > 350).all()


def shares_table(spark, units):
    return spark.createDataFrame([(i, f"s{i}", u, 0.0, 1, 1 << 40, u) for i, u in enumerate(units)], "sid long, source string, source_size long, target double, block long, blocks long, units long")


def test_shards_are_drawn(spark, monkeypatch):
    """The whole parts are certain; the rest has the mean and the variance of a multinomial draw."""
    monkeypatch.setattr(mixing, "SHARD", 10)
    units = [u * mixing.UNIT * 25 for u in (270, 450, 155, 125)]
    got = mixing.drawn(shares_table(spark, units)).collect()
    shards = 25 * 100
    n = np.zeros((shards, 4), int)
    for r in got:
        n[r.shard, r.sid] = r.n
    assert (n.sum(1) == 10).all()
    want = 10 * np.array([0.27, 0.45, 0.155, 0.125])
    certain = np.floor(want)
    assert (n >= certain).all()
    rest, left = n - certain, 10 - certain.sum()
    p = (want - certain) / left
    assert left == 2 and np.allclose(rest.mean(0), left * p, atol=5 * np.sqrt(left * p * (1 - p) / shards))
    assert np.allclose(rest.var(0), left * p * (1 - p), rtol=0.12)
    assert np.cov(rest.T)[0, 1] == pytest.approx(-left * p[0] * p[1], rel=0.25)


def test_draw_decides_what_is_taken(spark, monkeypatch):
    """Other draws take other blocks: the slots of a source are as many as were drawn for it."""
    docs = documents(spark, [(i, words(100, i), "en", f"s{i % 7}") for i in range(350)])
    sources = mixing.targets(mixing.sizes(docs))
    drawn = {r.sid: r.n for r in mixing.drawn(sources).groupBy("sid").agg(F.sum("n").alias("n")).collect()}
    most = {r.sid: mixing.MOST * r.blocks for r in sources.collect()}
    slots = mixing.slots(sources)
    assert {r.sid: r.n for r in slots.groupBy("sid").agg(F.count_distinct("slot").alias("n")).collect()} == {s: min(n, most[s]) for s, n in drawn.items() if n}
    assert slots.groupBy("sid", "index").count().where(f"count > {mixing.MOST}").count() == 0
    before = rows(mixing.plan(docs).toPandas())
    hashed = mixing.wide
    monkeypatch.setattr(mixing, "wide", lambda x: hashed(x + 12345))
    assert rows(mixing.plan(docs).toPandas()) != before


def test_slots_are_dealt_to_tasks(spark):
    docs = documents(spark, [(i, words(100, i), "en", f"s{i % 2}") for i in range(400)])
    sources = mixing.targets(mixing.sizes(docs))
    held = [r.n for r in mixing.slots(sources).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(held) > 1


# 8


def test_quality(spark):
    good = lambda i: "\n".join(words(30, 3 * i + k).capitalize() + "." for k in range(4))
    bad = lambda i: good(i) + "\n" + " ".join(f"{w.upper()}!!" for w in words(40, i).split())
    docs = documents(spark, [(i, good(i) if i % 4 else bad(i)) for i in range(600)])
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(600)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality.classify(docs, labels))
    tested = [i for i in got if got[i].held_out]
    assert sum(got[i].predicted == int(i % 4 > 0) for i in tested) >= 0.95 * len(tested)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def plain_score(model, text):
    """One text by the definition: every passage encoded alone, one softmax over all of them."""
    parts = [line[a : a + quality.PASSAGE] for line in (text or "").encode().split(b"\n") if line.strip() for a in range(0, len(line), quality.PASSAGE)] or [b""]
    w, raw, hs = {k: np.asarray(v, np.float64) for k, v in model.weights.items()}, [], []
    for p in parts:
        h = np.tanh((quality.encode([p])[0].astype(np.float64) - model.mean) / model.scale @ w["E"] + w["e"])
        raw.append(float((np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))) @ w["a"]))
        hs.append(h)
    alpha = np.exp(np.array(raw) - max(raw))
    z = (alpha[:, None] * np.array(hs)).sum(0) / alpha.sum()
    return 1 / (1 + np.exp(-(z @ w["o"] + w["b"])))


def test_quality_by_definition(spark, odd, monkeypatch):
    """All scores against one text at a time; blocks of three passages, so that texts go over several."""
    docs = odd.unionByName(documents(spark, [(50 + i, "\n".join(words(5 + i, 9 * i + k) for k in range(1 + i % 9)), "en") for i in range(60)]))
    labels = spark.createDataFrame([(50 + i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    monkeypatch.setattr(quality, "BLOCK", 3)
    texts = [r.text for r in docs.collect()]
    few = model.scores([None if t is None else t.encode() for t in texts])
    assert np.allclose(few, [plain_score(model, t) for t in texts], atol=1e-4)
    assert np.allclose(sorted(few), sorted(r.score for r in quality.scores(docs, model).collect()), atol=1e-4)


def grown(run):
    """MB that a call adds to this process at its peak, and its seconds."""
    import time
    import tracemalloc

    tracemalloc.start()
    began = time.time()
    run()
    took, (_, most) = time.time() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    return most / 1e6, took


def test_memory_of_long_odd_texts():
    """One-character lines, an unbroken text, a large payload: memory stays bounded or in proportion."""
    rng = np.random.default_rng(1)
    model = quality.train([rng.normal(size=(3, quality.WIDTH)), rng.normal(size=(2, quality.WIDTH))], np.array([1.0, 0.0]))
    assert grown(lambda: model.scores([b"x\n" * 200_000]))[0] < 60
    counter = unigram.Counter([("<unk>", 0.0), ("a", -1.0), ("ab", -1.5), ("bab", -2.0)], False)
    text = "ab" * 200_000
    assert counter.segment(text) == (200_000, 0)
    assert grown(lambda: counter.segment(text))[0] < 20
    assert counter.count(text)[0] and not counter.memo


def test_windows_of_a_segment_miss_nothing(monkeypatch):
    rng = random.Random(5)
    vocabulary = [("<unk>", 0.0)] + [(p, float(-rng.randint(1, 4))) for p in sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(30)})]
    counter, text = unigram.Counter(vocabulary, False), "".join(rng.choice("abcd") for _ in range(5000))
    whole = counter.segment(text)
    monkeypatch.setattr(unigram, "WINDOW", 7)
    assert counter.segment(text) == whole


def test_large_payload(spark):
    """A payload of many megabytes is framed, segmented and read back in linear time."""
    import time

    took = []
    for mb in (4, 16):
        page = spark.createDataFrame([(1, "u")], "page_id long, url string").withColumn("html", F.repeat(F.lit("0123456789abcdef"), mb << 16))
        began = time.time()
        r = warc.roundtrip(page).first()
        took.append(time.time() - began)
        assert r.payload_bytes == mb << 20 and r.record_type == "response"
    assert took[1] < 5 * took[0] + 5


def test_long_words_are_not_remembered():
    s = neardup.Shingler()
    text = b"one two " + b"y" * 100 + b" three four five"
    assert len(s.of(text)) == 2 and set(s.memo) == {b"one", b"two", b"three", b"four", b"five"}
    assert (s.of(text) == neardup.Shingler().of(text)).all()
    e = tokens.encoder(tokens.TOKENIZER)
    assert e.encode("z" * 100) == e.whole("z" * 100) and "z" * 100 not in e.memo


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_other_splitting_rules_go_through_the_library(name):
    e = tokens.encoder(name)
    for text in ("It's 12 o'clock, isn't it?  Yes.\n\nNo", "plain words", "été 3.14"):
        assert e.encode(text) == e.whole(text)


def test_quality_odd(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(odd, none).collect()} == {0.5}
    one = spark.createDataFrame([(5, 1, 0), (2, 0, 0), (5, 1, 0)], none.schema)
    assert quality.classify(odd, one).count() == odd.count() and quality.classify(odd.limit(0), one).count() == 0


def test_attention_gradients():
    rng = np.random.default_rng(0)
    bags, y = [rng.normal(size=(n, quality.WIDTH)) for n in (1, 3, 2)], np.array([1.0, 0.0, 1.0])
    model = quality.train(bags, y)
    model.weights = {k: np.asarray(rng.normal(size=np.shape(v)) * 0.3) for k, v in model.weights.items()}
    x, starts = np.concatenate(bags), np.array([0, 1, 4])

    def loss():
        p = model._forward(x, starts)[-1]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = model.gradients(x, starts, y)
    for k, w in model.weights.items():
        at = tuple(0 for _ in w.shape)
        old, h = w[at].copy(), 1e-6
        w[at] = old + h
        up = loss()
        w[at] = old - h
        down = loss()
        w[at] = old
        assert grads[k][at] == pytest.approx((up - down) / (2 * h), abs=1e-5)


# 9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50257), st.integers(0, 2**64 - 1)), max_size=300), st.integers(0, 5))
def test_simple8b_roundtrip(values, repeat):
    ids = np.array(values * (1 + repeat * 3), np.uint64)
    words_, begins, escaped = tokens.pack(ids)
    assert (tokens.unpack(words_, begins, escaped, len(ids)) == ids).all()
    assert len(begins) == -(-len(ids) // tokens.BLOCK)


def test_frequent_pre_tokens_are_made_once(monkeypatch):
    monkeypatch.setattr(tokens, "_MEMO", 40)

    class Model:
        made: list[str] = []

        def tokenize(self, part):
            self.made.append(part)
            return []

    memo = tokens._Memo(Model())
    for i in range(500):
        assert memo[" the"] == memo[f"word{'x' * (i % 7)}{i}"] == b""
        assert len(memo) + len(memo.older) <= 40
    assert sum(x.endswith("the") for x in Model.made) == 1 and len(Model.made) == 501


@settings(max_examples=80, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x17F, exclude_categories=["Cs"]), st.sampled_from(" \n\t'’漢\U0001f600")), max_size=60))
def test_memo_equals_the_library(text):
    e = tokens.encoder(tokens.TOKENIZER)
    assert e.encode(text) == e.whole(text)


def test_special_tokens_in_texts():
    e = tokens.encoder(tokens.TOKENIZER)
    text = "a <|endoftext|> b it's  two\n\n  x"
    assert e.encode(text) == e.whole(text) and np.frombuffer(e.encode(text), "<u4").max() == 50256


@pytest.mark.parametrize("size", [2000, 3])
def test_token_files(spark, odd, tmp_path, size):
    path = str(tmp_path / "t")
    tokens.write(odd, path, rows=size)
    got = tokens.read(spark, path, with_ids=True).orderBy("part", "at").collect()
    table = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    e = tokens.encoder(tokens.TOKENIZER)
    want = [(doc, [*np.frombuffer(e.whole(text), "<u4").tolist(), 2]) for doc, text in table]
    assert [(r.doc_id, r.ids) for r in got] == want
    starts = np.cumsum([0] + [len(i) for _, i in want])
    full = sorted((str(tuple(r)) for r in tokens.digest(odd).collect()))
    assert full == sorted(str((doc, int(s), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))) for (doc, ids), s in zip(want, starts, strict=False))
    assert tokens.digest(odd.limit(0)).count() == 0


# 10


def library(vocabulary, fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(vocabulary, 0, fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    return t


@pytest.mark.parametrize("fallback", [False, True])
def test_counts_and_ties_equal_the_library(fallback):
    rng = random.Random(1)
    for _ in range(60):
        pieces = {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))) for _ in range(12)}
        vocabulary = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", -5.0) for b in range(256)] * fallback + [(p, float(-rng.randint(1, 3))) for p in sorted(pieces)]
        counter, known = unigram.Counter(vocabulary, fallback), library(vocabulary, fallback)
        for _ in range(15):
            text = "".join(rng.choice("abc ▁éd") for _ in range(rng.randint(0, 14)))
            assert counter.count(text)[0] == len(known.encode(text, add_special_tokens=False).ids), (text, vocabulary)


def test_token_counts(spark, odd):
    known = library(unigram.zipf_vocabulary(), True)
    got = unigram.counts(odd).collect()
    want = [(r.doc_id, len(r.text or ""), len(known.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect()]
    assert sorted(str(tuple(r)[:3]) for r in got) == sorted(map(str, want))
    assert unigram.counts(odd.limit(0)).count() == 0
