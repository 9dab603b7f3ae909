"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import decontaminate, fingerprint, language, lines, mixing, neardup, quality, tokens, unigram, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(_table(spark, sf_dir, "pages"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.summary(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digest(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.counts(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_language_id, op3_warc, op4_order_minhash, op5_near_duplicates, op6_line_dedup, op7_mixing, op8_quality, op9_token_files, op10_token_counts)}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 6))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.p, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
cover AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(s, CAST(1 + 10 * (i // 8) AS INTEGER), 10) AS BIGINT) >> CAST(5 * (7 - i % 8) AS BIGINT)) & 31) AS INTEGER) + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id = m THEN NULL ELSE m END AS refers_to FROM d
"""


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT a, b FROM met JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
link AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id, least(d.doc_id, coalesce(b, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN least_of ON d.doc_id = a
"""

#: DuckDB's levenshtein() counts bytes, so the letters over 0x7F of the test tables are single bytes in it.
_WIDE = "éóèñüçäöêßíÉÈÑÓÇÊÜÖÄÍ"
_NARROW = " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 14 + len(_WIDE) - 8)])

OP6_SQL = rf"""
WITH RECURSIVE occ AS (SELECT doc_id, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)),
d AS (SELECT l, length(l) AS n, translate(l, '{_WIDE}', {_NARROW}) AS c, min(doc_id) AS first_doc FROM occ WHERE l <> '' GROUP BY l),
half AS (SELECT a.l AS a, b.l AS b FROM (SELECT *, unnest(range(0, 3)) AS k FROM d WHERE n >= 8) a JOIN d b ON b.n = a.n + a.k WHERE (a.k > 0 OR a.l < b.l) AND a.k <= CASE WHEN a.n >= 16 THEN 2 ELSE 1 END AND levenshtein(a.c, b.c) <= CASE WHEN a.n >= 16 THEN 2 ELSE 1 END),
link AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
keeper AS (SELECT d.l, least(d.first_doc, min(e.first_doc)) AS doc, least(d.l, min(r.b)) AS class FROM d LEFT JOIN reach r ON d.l = r.a LEFT JOIN d e ON e.l = r.b GROUP BY d.l, d.first_doc),
kept AS (SELECT doc, count(DISTINCT class) AS n FROM keeper GROUP BY doc),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a),
owner AS (SELECT class, min(doc) AS doc FROM keeper GROUP BY class),
f AS (SELECT o.doc_id, w.doc AS first, coalesce(g.n, 0) AS links FROM occ o JOIN keeper k ON o.l = k.l JOIN owner w ON k.class = w.class LEFT JOIN degree g ON o.l = g.a),
shared AS (SELECT DISTINCT doc_id AS a, first AS b FROM f WHERE doc_id <> first),
paired AS (SELECT a, b FROM shared UNION SELECT b, a FROM shared),
near AS (SELECT a, b FROM paired UNION SELECT r.a, l.b FROM near r JOIN paired l ON r.b = l.a),
group_of AS (SELECT a, min(b) AS b FROM near GROUP BY a),
sums AS (SELECT doc_id, sum(links) AS links FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(length(text) - length(replace(text, chr(10), '')) + 1, 0) AS BIGINT) AS n_lines, CAST(coalesce(kept.n, 0) AS BIGINT) AS n_kept, least(d.doc_id, coalesce(group_of.b, d.doc_id)) AS class_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc LEFT JOIN group_of ON d.doc_id = group_of.a LEFT JOIN sums ON d.doc_id = sums.doc_id
"""

#: The hash, the draw, the permutation and the order of documents are the operator's, in DuckDB's terms.
def _scatter(x: str) -> str:
    """mixing.scatter() of an expression that is not negative."""
    return f"list_transform([{x}], lambda x: list_transform([(x % 2147483647 + x // 2147483647 % 2147483647 * 40692) % 2147483647], lambda u: list_transform([(u * 48271 + 11) % 2147483647], lambda v: ((v * v + u) % 2147483647 * 69621 + 12345) % 2147483647)[1])[1])[1]"


def _wide(x: str) -> str:
    return f"({_scatter(x)} * 2147483648 + {_scatter(f'{x} + 1013904223')})"


_KEY = _wide("sid * 7919 + epochs * 104729 + i * 1299709")
OP7_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS digest FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid FROM d GROUP BY source),
s1 AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM s0),
s2 AS (SELECT *, cap / weight AS ratio FROM s1),
s3 AS (SELECT *, row_number() OVER (ORDER BY ratio, sid) AS pos, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy FROM s2),
s4 AS (SELECT *, min(CASE WHEN rest / heavy < ratio THEN pos END) OVER () AS f FROM s3),
s5 AS (SELECT *, max(CASE WHEN pos = f THEN rest END) OVER () AS r1, max(CASE WHEN pos = f THEN heavy END) OVER () AS h1 FROM s4),
s6 AS (SELECT sid, source, source_size, CASE WHEN f IS NULL OR pos < f THEN CAST(cap AS DOUBLE) ELSE CAST(r1 * weight AS DOUBLE) / CAST(h1 AS DOUBLE) END AS target, greatest(1, least(512, source_size // 1024)) AS block FROM s5),
s7 AS (SELECT *, (source_size + block - 1) // block AS blocks, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS full_epochs FROM s6),
s8 AS (SELECT *, full_epochs * blocks * 256 + CASE WHEN full_epochs >= 3 THEN 0 ELSE CAST(floor((target - full_epochs * source_size) / block * 256) AS BIGINT) END AS units FROM s7),
g0 AS (SELECT CAST(sum(units) AS BIGINT) AS u, (CAST(sum(units) AS BIGINT) + 255) // 256 AS slots FROM s8),
g1 AS (SELECT *, (slots + 16383) // 16384 AS shards FROM g0 WHERE slots > 0),
kind AS (SELECT u, 0 AS first, shards - 1 AS count, 16384 AS held FROM g1 WHERE shards > 1 UNION ALL SELECT u, shards - 1, 1, slots - (shards - 1) * 16384 FROM g1),
part AS (SELECT kind.*, sid, units * held // u AS n, units * held % u AS fraction FROM kind, s8 WHERE units > 0),
part1 AS (SELECT *, CAST(sum(fraction) OVER (PARTITION BY first ORDER BY sid) AS BIGINT) AS high FROM part),
part2 AS (SELECT u, first, count, held - CAST(sum(n) AS BIGINT) AS open_slots FROM part GROUP BY u, first, count, held),
draws0 AS (SELECT *, unnest(range(0, count * open_slots)) AS id FROM part2),
draws1 AS (SELECT *, id // open_slots + first AS shard, id % open_slots AS i FROM draws0),
draws AS (SELECT first, {_wide("shard * 15485863 + i * 32452843 + 49979687")} % (open_slots * u) AS x FROM draws1),
hit AS (SELECT sid, count(*) AS n FROM draws JOIN part1 ON draws.first = part1.first AND x >= high - fraction AND x < high GROUP BY sid),
total AS (SELECT sid, CAST(sum(n) AS BIGINT) AS n FROM (SELECT sid, n * count AS n FROM part UNION ALL SELECT sid, n FROM hit) GROUP BY sid),
s9 AS (SELECT s8.*, least(3 * blocks, coalesce(n, 0)) // greatest(blocks, 1) AS epochs, least(3 * blocks, coalesce(n, 0)) % greatest(blocks, 1) AS extra_slots FROM s8 LEFT JOIN total USING (sid)),
picked AS (SELECT sid, list_reduce(list_prepend(x, list_transform(range(0, 16), lambda i: {_KEY})), lambda a, k: CASE WHEN {_scatter("greatest(a, (k % blocks + blocks - a) % blocks) + k")} // 1024 % 2 = 1 THEN (k % blocks + blocks - a) % blocks ELSE a END) AS b FROM (SELECT *, unnest(range(0, extra_slots)) AS x FROM s9)),
p0 AS (SELECT d.*, {_scatter("(coalesce(doc_id, 0) % 2147483647 + 2147483647) % 2147483647 + digest")} % 4096 AS bucket FROM d),
p AS (SELECT p0.doc_id, p0.size, s9.*, CAST(sum(p0.size) OVER (PARTITION BY sid ORDER BY bucket, doc_id NULLS FIRST, size, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS BIGINT) AS start FROM p0 JOIN s9 ON p0.source IS NOT DISTINCT FROM s9.source),
o AS (SELECT sid, start, least(start + size, (b + 1) * block) - greatest(start, b * block) AS n, b FROM (SELECT *, unnest(range(start // block, (start + size - 1) // block + 1)) AS b FROM p WHERE size > 0)),
t AS (SELECT sid, start, sum(n) AS extra FROM o JOIN picked USING (sid, b) GROUP BY ALL)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE size * epochs + coalesce(extra, 0) END AS BIGINT) AS taken FROM p LEFT JOIN t USING (sid, start)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op3_warc": OP3_SQL, "op5_near_duplicates": OP5_SQL, "op6_line_dedup": OP6_SQL, "op7_mixing": OP7_SQL}
