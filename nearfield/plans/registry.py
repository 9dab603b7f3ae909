"""The registered queries of the vector engine and the SQL that each equals.

Distances are rounded to six digits where they leave the engine, as two engines add in different
order. Every query runs over its whole tables; limits are those of top-k searches.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.errors import VectorError
from nearfield.functions.metrics import Metric, cosine, distance, norm, register, vector
from nearfield.functions.text import chunk_column, is_valid_chunk
from nearfield.operators import ann, knn
from nearfield.operators.collection import Collection, records_from
from nearfield.operators.metadata import Postings
from nearfield.operators.rag import RagEngine, chunked, prompt_column
from nearfield.plans.compile import TypedFields, VariantFields, by_set_algebra, to_column
from nearfield.plans.filters import Not, parse
from nearfield.sources.services import ApiChat, ApiEmbedder, HashingEmbedder, auto_embedder, embedding
from nearfield.sources.store import Projects, from_json, read_texts, to_json
from nearfield.streaming import search as streams
from nearfield.workers import ship

Query = Callable[[SparkSession, str], DataFrame]
_REGISTERED: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, sql: str | None, query: Query) -> None:
    _REGISTERED[name] = (query, sql)


def queries() -> dict[str, Query]:
    def shipped(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return query(spark, sf_dir)

        return run

    return {name: shipped(query) for name, (query, _) in _REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTERED.items() if sql is not None}


# Tables


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return _table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


#: The queries of batch searches: every row whose id is divisible by 20.
_ASKED = "vec_id % 20 = 0"


def _batch(spark: SparkSession, d: str, which: str = _ASKED) -> DataFrame:
    return _table(spark, d, "embeddings").where(which).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def _rich(spark: SparkSession, d: str) -> DataFrame:
    """Records with several metadata fields."""
    docs = _table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return _embeddings(spark, d).join(docs, F.col("id") == F.col("doc_id"))


def _six(distance: Column | str) -> Column:
    """Six digits, and no negative zero."""
    rounded = F.round(distance, 6)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)


def _six_sql(distance: str) -> str:
    return f"CASE WHEN round({distance}, 6) = 0 THEN 0.0 ELSE round({distance}, 6) END"


def _out(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("vec_id"), _six("distance").alias("distance"))


# Distances and exact search

_Q = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
_SQL_DISTANCE = {
    "euclidean": "list_distance({a}, {b})",
    "cosine": "CASE WHEN list_inner_product({a}, {a}) = 0 OR list_inner_product({b}, {b}) = 0 THEN 0.0 ELSE 1 - list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))) END",
    "dot": "-list_inner_product({a}, {b})",
    "manhattan": "list_sum(list_transform(list_zip({a}, {b}), lambda x: abs(x[1] - x[2])))",
    "hamming": "list_sum(list_transform(list_zip({a}, {b}), lambda x: CASE WHEN CAST(x[1] AS VARCHAR) <> CAST(x[2] AS VARCHAR) THEN 1.0 ELSE 0.0 END)) / len({a})",
}


def _d(metric: str, a: str = "CAST(embedding AS DOUBLE[])", b: str = "q") -> str:
    return _SQL_DISTANCE[metric].format(a=a, b=b)


def _knn_sql(metric: str, k: int, where: str = "TRUE", source: str = "embeddings", b: str = "q") -> str:
    return f"SELECT vec_id, {_six_sql('distance')} AS distance FROM (SELECT vec_id, {_d(metric, b=b)} AS distance FROM {source}, {_Q} WHERE {where} ORDER BY distance, vec_id LIMIT {k})"


for _m in Metric:
    _add(f"knn_{_m}", _knn_sql(_m, 10), lambda s, d, m=_m: _out(knn.nearest(_embeddings(s, d), _query_vector(s, d), 10, m)))

    def _matrix(s: SparkSession, d: str, m: str = _m) -> DataFrame:
        # The stated queries against themselves.
        a = _batch(s, d).select(F.col("query_id").alias("a_id"), F.col("query_vector").alias("a"))
        b = _batch(s, d).select(F.col("query_id").alias("b_id"), F.col("query_vector").alias("b"))
        return a.crossJoin(F.broadcast(b)).select("a_id", "b_id", _six(distance(m, F.col("a"), F.col("b"))).alias("distance"))

    _pair = _d(_m, "CAST(a.embedding AS DOUBLE[])", "CAST(b.embedding AS DOUBLE[])")
    _add(f"dist_matrix_{_m}", f"SELECT a.vec_id AS a_id, b.vec_id AS b_id, {_six_sql(_pair)} AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 = 0", _matrix)

_add("l2_norm", "SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings", lambda s, d: _embeddings(s, d).select(F.col("id").alias("vec_id"), F.round(norm(F.col("vector")), 6).alias("norm")))
_add("knn_cosine_stored_norm", _knn_sql("cosine", 10), lambda s, d: _out(knn.nearest(knn.with_norm(_embeddings(s, d)), _query_vector(s, d), 10, Metric.COSINE)))
_add("cosine_zero_vector", "SELECT vec_id, 0.0::DOUBLE AS distance FROM embeddings", lambda s, d: _embeddings(s, d).select(F.col("id").alias("vec_id"), F.round(cosine(F.col("vector"), vector([0.0] * 64)), 6).alias("distance")))
_add("knn_k_exceeds_n", _knn_sql("euclidean", 1_000_000_000), lambda s, d: _out(knn.nearest(_embeddings(s, d), _query_vector(s, d), 1_000_000_000, Metric.EUCLIDEAN)))
_add("knn_k_zero", _knn_sql("euclidean", 0), lambda s, d: _out(Collection(_embeddings(s, d)).search(_query_vector(s, d), 0, Metric.EUCLIDEAN)))


def _scaled(s: SparkSession, d: str) -> DataFrame:
    """Vectors of different lengths, so that metrics rank differently."""
    return _embeddings(s, d).withColumn("vector", F.transform(F.col("vector").cast("array<double>"), lambda x: x * (F.col("label") + 1)))


for _m in (Metric.COSINE, Metric.DOT, Metric.MANHATTAN):
    _sql = f"SELECT vec_id, {_six_sql('distance')} AS distance FROM (SELECT vec_id, {_d(_m, 'e')} AS distance FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (label + 1)) AS e FROM embeddings), {_Q} ORDER BY distance, vec_id LIMIT 10)"
    _add(f"knn_scaled_{_m}", _sql, lambda s, d, m=_m: _out(knn.nearest(_scaled(s, d), _query_vector(s, d), 10, m)))


# Batch search


def _batch_sql(metric: str, k: int = 5, which: str = _ASKED) -> str:
    pair = _d(metric, "CAST(e.embedding AS DOUBLE[])", "CAST(b.embedding AS DOUBLE[])")
    return f"SELECT query_id, vec_id, {_six_sql('distance')} AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (SELECT b.vec_id AS query_id, e.vec_id, {pair} AS distance FROM embeddings e, embeddings b WHERE b.{which})) WHERE rank <= {k}"


def _batch_out(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("id").alias("vec_id"), _six("distance").alias("distance"), F.col("rank").cast("long").alias("rank"))


for _m in Metric:
    _add(f"knn_batch_{_m}", _batch_sql(_m), lambda s, d, m=_m: _batch_out(knn.nearest_for_each(_embeddings(s, d), _batch(s, d), 5, m, method="expressions")))
    _add(f"knn_batch_blocked_{_m}", _batch_sql(_m), lambda s, d, m=_m: _batch_out(knn.nearest_for_each(_embeddings(s, d), _batch(s, d), 5, m, method="blocks")))
_add("knn_batch_100", _batch_sql("euclidean", 10), lambda s, d: _batch_out(Collection(_embeddings(s, d)).search_batch(_batch(s, d), 10, Metric.EUCLIDEAN)))
_add("knn_batch_no_queries", _batch_sql("euclidean", 10, "vec_id < 0"), lambda s, d: _batch_out(Collection(_embeddings(s, d)).search_batch(_batch(s, d, "vec_id < 0"), 10, Metric.EUCLIDEAN)))


def _largest(a: Column, b: Column) -> Column:
    """The largest difference of two vectors' elements: a distance that the engine does not know by itself."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def _knn_registered(s: SparkSession, d: str) -> DataFrame:
    register("chebyshev", _largest)
    return _out(knn.nearest(_embeddings(s, d), _query_vector(s, d), 10, "chebyshev"))


_CHEBYSHEV = "list_max(list_transform(list_zip(CAST(embedding AS DOUBLE[]), q), lambda x: abs(x[1] - x[2])))"
_add("knn_registered_metric", f"SELECT vec_id, {_six_sql('distance')} AS distance FROM (SELECT vec_id, {_CHEBYSHEV} AS distance FROM embeddings, {_Q} ORDER BY distance, vec_id LIMIT 10)", _knn_registered)


# Approximate search


def _index(s: SparkSession, d: str, **params) -> ann.IvfIndex:
    return ann.build(_embeddings(s, d), ann.Params(**params))


def _all_cells(s: SparkSession, d: str) -> DataFrame:
    return _out(_index(s, d, n_cells=16, nprobe=16).search(_query_vector(s, d), 10, Metric.EUCLIDEAN))


def _shared(s: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    import tempfile
    import uuid

    base = s.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = s.sparkContext.master.startswith("local") and "cluster" not in s.sparkContext.master
        base = tempfile.mkdtemp(prefix="nearfield-") if local else s.conf.get("spark.sql.warehouse.dir") + "/_staging"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _ivf_roundtrip(s: SparkSession, d: str) -> DataFrame:
    path = _shared(s, "ivf")
    _index(s, d, n_cells=16, nprobe=16).save(path)
    return _out(ann.load(s, path).search(_query_vector(s, d), 10, Metric.EUCLIDEAN))


_add("ivf_full_probe", _knn_sql("euclidean", 10), _all_cells)
_add("ivf_full_probe_cosine", _knn_sql("cosine", 10), lambda s, d: _out(_index(s, d, n_cells=16, nprobe=16, metric=Metric.COSINE).search(_query_vector(s, d), 10, Metric.COSINE)))
_add("ivf_full_probe_manhattan", _knn_sql("manhattan", 10), lambda s, d: _out(_index(s, d, n_cells=16, nprobe=16).search(_query_vector(s, d), 10, Metric.MANHATTAN)))
_add("ivf_batch_full_probe", _batch_sql("euclidean"), lambda s, d: _batch_out(_index(s, d, n_cells=16, nprobe=16).search_batch(_batch(s, d), 5, Metric.EUCLIDEAN)))
_add("ivf_roundtrip", _knn_sql("euclidean", 10), _ivf_roundtrip)
_add("ivf_default", None, lambda s, d: _out(_index(s, d).search(_query_vector(s, d), 10, Metric.EUCLIDEAN)))
_add("ivf_batch_default", None, lambda s, d: _batch_out(_index(s, d).search_batch(_batch(s, d), 10, Metric.EUCLIDEAN)))
_add("knn_auto_index", _knn_sql("euclidean", 10), lambda s, d: _out(Collection(_embeddings(s, d), index="auto", params=ann.Params(n_cells=16, nprobe=16)).search(_query_vector(s, d), 10, Metric.EUCLIDEAN)))


def _recall(s: SparkSession, d: str) -> DataFrame:
    """Of the stated queries: how many there are, and whether the default index finds nine tenths of their ten nearest."""
    exact = knn.nearest_for_each(_embeddings(s, d), _batch(s, d), 10, Metric.EUCLIDEAN).select("query_id", "id")
    found = _index(s, d).search_batch(_batch(s, d), 10, Metric.EUCLIDEAN).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "id"], "left").agg(F.count_distinct("query_id").alias("n_queries"), (F.coalesce(F.sum("hit"), F.lit(0)) >= 0.9 * F.count("*")).alias("enough"))


def _single_found(s: SparkSession, d: str) -> DataFrame:
    """Of one default search: whether the distances are those of the records found, in order, and the query is among them."""
    found = _index(s, d).search(_query_vector(s, d), 10, Metric.EUCLIDEAN).select(F.col("id").alias("found"), F.col("distance").alias("said"))
    right = knn.scored(_embeddings(s, d), _query_vector(s, d), Metric.EUCLIDEAN).join(found, F.col("id") == F.col("found"))
    return right.agg(F.count("*").alias("n"), (F.max(F.abs(F.col("said") - F.col("distance"))) < 1e-9).alias("exact"), F.min("distance").alias("nearest"))


def _index_changes(s: SparkSession, d: str) -> DataFrame:
    """A search of all cells after records came, went and moved, without a new fit."""
    c = Collection(_records(s, d).where("label <> 3"), index="ivf", params=ann.Params(n_cells=16, nprobe=16))
    c.ivf  # noqa: B018  fitted before the changes
    c = c.insert(_records(s, d).where("label = 3")).delete(_records(s, d).where("label = 4")).update("7", _query_vector(s, d))
    return c.search(_query_vector(s, d), 10, Metric.EUCLIDEAN).select("id", _six("distance").alias("distance"))


def _switch(s: SparkSession, d: str) -> DataFrame:
    """Around the number of records from which index="auto" is approximate."""
    said = [(n, Collection(s.range(n).select(F.col("id").cast("string").alias("id"), F.array(F.col("id").cast("float")).alias("vector")), index="auto")._uses_ivf()) for n in (999, 1000, 1001)]
    return s.createDataFrame(said, "n long, approximate boolean")


_add("ivf_recall", "SELECT count(*) AS n_queries, TRUE AS enough FROM embeddings WHERE vec_id % 20 = 0", _recall)
_add("ivf_single", "SELECT 10::BIGINT AS n, TRUE AS exact, 0.0::DOUBLE AS nearest", _single_found)
_add("ivf_changes", f"SELECT CAST(vec_id AS VARCHAR) AS id, {_six_sql('distance')} AS distance FROM (SELECT vec_id, CASE WHEN vec_id = 7 THEN 0.0 ELSE {_d('euclidean')} END AS distance FROM embeddings, {_Q} WHERE label <> 4 ORDER BY distance, CAST(vec_id AS VARCHAR) LIMIT 10)", _index_changes)
_add("auto_index_switch", "SELECT * FROM (VALUES (999::BIGINT, FALSE), (1000::BIGINT, TRUE), (1001::BIGINT, TRUE)) t(n, approximate)", _switch)


# Filters over events, documents, parts


def _filter(name: str, table: str, key: str, condition: str, sql: str, *, compat: bool = False, view: Callable[[DataFrame], DataFrame] = lambda df: df, source: str | None = None) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        df = view(_table(s, d, table))
        return df.where(to_column(parse(condition), TypedFields(df.schema), compat)).select(key)

    _add(name, f"SELECT {key} FROM {source or table} WHERE {sql}", run)


def _flags(df: DataFrame) -> DataFrame:
    return df.withColumn("good", F.when(F.col("quality").isNotNull(), F.col("quality") == 1))


_filter("filter_eq_string", "events", "event_id", 'event_type = "click"', "event_type = 'click'")
_filter("filter_eq_int", "events", "event_id", "user_id = 7", "user_id = 7")
_filter("filter_eq_float", "part", "p_partkey", "p_retailprice = 901.0", "p_retailprice = 901.0")
_filter("filter_eq_bool", "labels", "doc_id", "good = true", "quality = 1", view=_flags)
_filter("filter_eq_kind_mismatch", "events", "event_id", 'user_id = "7"', "FALSE")
_filter("filter_ne", "events", "event_id", 'event_type != "click"', "event_type <> 'click'")
_filter("filter_ne_type_mismatch", "events", "event_id", 'user_id != "7"', "user_id IS NOT NULL")
_filter("filter_ne_unknown_field", "events", "event_id", "nowhere != 1", "FALSE")
_filter("filter_lt", "events", "event_id", "value < 100", "value < 100")
_filter("filter_gt", "events", "event_id", "value > 100.5", "value > 100.5")
_filter("filter_lte", "events", "event_id", "user_id <= 50", "user_id <= 50")
_filter("filter_gte", "events", "event_id", "user_id >= 50", "user_id >= 50")
_filter("filter_range_string_literal", "events", "event_id", 'value > "much"', "value > 0")
_filter("filter_in_strings", "documents", "doc_id", 'lang IN ("de", "fr")', "lang IN ('de', 'fr')")
_filter("filter_in_mixed", "events", "event_id", 'user_id IN (1, 2.0, "3", true)', "user_id IN (1, 2)")
_filter("filter_like_prefix", "documents", "doc_id", 'source LIKE "src1%"', "starts_with(source, 'src1')")
_filter("filter_like_contains", "part", "p_partkey", 'p_name LIKE "%a%"', "contains(p_name, 'a')")
_filter("filter_like_suffix", "documents", "doc_id", 'source LIKE "%9"', "ends_with(source, '9')")
_filter("filter_like_exact", "documents", "doc_id", 'source LIKE "src1"', "source = 'src1'")
_filter("filter_like_any", "documents", "doc_id", 'source LIKE "%"', "source IS NOT NULL")
_filter("filter_like_literal_underscore", "documents", "doc_id", 'source LIKE "src_%"', "starts_with(source, 'src_')")
_filter("filter_like_suffix_compat", "documents", "doc_id", 'source LIKE "%9"', "ends_with(source, '%9')", compat=True)
_filter("filter_and", "events", "event_id", 'event_type = "click" AND value > 100', "event_type = 'click' AND value > 100")
_filter("filter_or", "events", "event_id", 'event_type = "click" OR value > 400', "event_type = 'click' OR value > 400")
_filter("filter_not", "events", "event_id", 'NOT event_type = "click"', "event_type <> 'click'")
_filter("filter_not_not", "events", "event_id", 'NOT NOT event_type = "click"', "event_type = 'click'")
_filter("filter_not_compat", "events", "event_id", 'NOT event_type = "click"', "event_type = 'click'", compat=True)
_filter("filter_not_and", "events", "event_id", 'NOT (event_type = "click" AND value > 100)', "NOT (event_type = 'click' AND value > 100)")
_filter("filter_precedence", "events", "event_id", 'event_type = "click" OR event_type = "view" AND value > 250', "event_type = 'click' OR (event_type = 'view' AND value > 250)")
_filter("filter_parens", "events", "event_id", '(event_type = "click" OR event_type = "view") AND value > 250', "(event_type = 'click' OR event_type = 'view') AND value > 250")

_SPARSE = "(SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def _sparse(condition: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        df = _table(s, d, "documents").select("doc_id").join(_table(s, d, "labels"), "doc_id", "left")
        return df.where(to_column(parse(condition), TypedFields(df.schema))).select("doc_id")

    return run


_add("filter_ne_missing_field", f"SELECT doc_id FROM {_SPARSE} WHERE quality <> 1", _sparse("quality != 1"))
_add("filter_not_missing_field", f"SELECT doc_id FROM {_SPARSE} WHERE quality IS DISTINCT FROM 1", _sparse("NOT quality = 1"))

_SETS = '(event_type = "click" OR value > 400) AND user_id != 7'


def _set_algebra(s: SparkSession, d: str) -> DataFrame:
    return by_set_algebra(_table(s, d, "events"), parse(_SETS), id_column="event_id")


_add("filter_setops", "(SELECT event_id FROM events WHERE event_type = 'click' UNION SELECT event_id FROM events WHERE value > 400) INTERSECT (SELECT event_id FROM events EXCEPT SELECT event_id FROM events WHERE user_id = 7)", _set_algebra)
_add("filter_sorted_ids", "SELECT DISTINCT user_id FROM events WHERE value > 400", lambda s, d: _ids(s, d))


def _ids(s: SparkSession, d: str) -> DataFrame:
    from nearfield.plans.compile import matching_ids

    return matching_ids(_table(s, d, "events"), parse("value > 400"), id_column="user_id")


def _variant(condition: str, negate: bool = False) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        df = _table(s, d, "events").withColumn("metadata", F.parse_json("props"))
        tree = parse(condition)
        return df.where(to_column(Not(tree) if negate else tree, VariantFields("metadata"))).select("event_id")

    return run


_add("filter_variant_number", "SELECT event_id FROM events WHERE CAST(props->>'k' AS DOUBLE) > 50", _variant("k > 50"))
_add("filter_variant_not", "SELECT event_id FROM events WHERE NOT CAST(props->>'k' AS DOUBLE) > 50", _variant("k > 50", True))
_add("filter_variant_kind_mismatch", "SELECT event_id FROM events WHERE FALSE", _variant('k = "5"'))


# Filtered search


def _knn_filtered(name: str, condition: str, sql: str) -> None:
    source = "(SELECT e.*, lang, source, n_chars FROM embeddings e JOIN documents ON vec_id = doc_id)"
    _add(name, _knn_sql("euclidean", 10, sql, source), lambda s, d: _out(Collection(_rich(s, d)).search_filtered(_query_vector(s, d), 10, condition, Metric.EUCLIDEAN)))


_knn_filtered("knn_filtered_label", "label = 3", "label = 3")
_knn_filtered("knn_filtered_and", 'lang = "en" AND n_chars > 1000', "lang = 'en' AND n_chars > 1000")
_knn_filtered("knn_filtered_or_not", 'NOT lang = "en" OR label IN (1, 2)', "lang <> 'en' OR label IN (1, 2)")
_knn_filtered("knn_filtered_like", 'source LIKE "src1%"', "starts_with(source, 'src1')")
_knn_filtered("knn_filtered_empty", 'lang = "xx"', "FALSE")
_knn_filtered("knn_filtered_tautology", "label >= 0", "TRUE")


# Posting lists


def _postings(s: SparkSession, d: str) -> Postings:
    return Postings.of(_flags(_rich(s, d).join(_table(s, d, "labels"), "doc_id", "left")).drop("vector", "doc_id"))


_RICH = "(SELECT vec_id AS id, label, lang, source, n_chars, quality, toxic, quality = 1 AS good FROM embeddings JOIN documents d ON vec_id = d.doc_id LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def _posting(name: str, sql: str, find: Callable[[Postings], DataFrame]) -> None:
    _add(name, f"SELECT id FROM {_RICH} WHERE {sql}", lambda s, d: find(_postings(s, d)))


_posting("meta_string", "lang = 'de'", lambda p: p.string("lang", "de"))
_posting("meta_string_prefix", "starts_with(source, 'src1')", lambda p: p.string_prefix("source", "src1"))
_posting("meta_string_contains", "contains(source, 'c1')", lambda p: p.string_contains("source", "c1"))
_posting("meta_string_suffix", "ends_with(source, '5')", lambda p: p.string_suffix("source", "5"))
_posting("meta_number", "label = 3", lambda p: p.number("label", 3))
_posting("meta_number_above", "n_chars > 3000", lambda p: p.number_above("n_chars", 3000))
_posting("meta_number_below", "n_chars < 500", lambda p: p.number_below("n_chars", 500))
_posting("meta_bool", "good", lambda p: p.boolean("good", True))
_posting("meta_with_field", "quality IS NOT NULL", lambda p: p.with_field("quality"))
_add(
    "meta_clear_field",
    f"SELECT field, count(*) AS entries FROM (SELECT unnest(CASE WHEN quality IS NULL THEN ['label', 'source', 'n_chars'] ELSE ['label', 'source', 'n_chars', 'quality', 'toxic', 'good'] END) AS field FROM {_RICH}) GROUP BY field",
    lambda s, d: _postings(s, d).clear_field("lang").df.groupBy("field").agg(F.count("*").alias("entries")),
)
_posting("meta_deindex", "lang = 'de' AND id >= 100", lambda p: p.deindex(p.df.where("field = 'lang' and id < 100")).string("lang", "de"))
_add("meta_field_counts", "SELECT * FROM (VALUES ('string', 2::BIGINT), ('number', 4::BIGINT), ('bool', 1::BIGINT)) t(kind, fields)", lambda s, d: _postings(s, d).field_counts())


# Records: changes, lookups, files


def _records(s: SparkSession, d: str) -> DataFrame:
    return records_from(_table(s, d, "embeddings"), id="vec_id", vector="embedding", metadata=["label"])


def _summed(df: DataFrame) -> DataFrame:
    return df.select("id", F.round(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"), "label")


_SUM = "round(list_sum(CAST(embedding AS DOUBLE[])), 6)"


def _inserted(s: SparkSession, d: str, mode: str) -> DataFrame:
    more = _records(s, d).where("label = 3").withColumn("label", F.lit(99)).withColumn("id", F.when(F.col("id").cast("long") < 100, F.col("id")).otherwise(F.concat(F.lit("n"), "id")))
    return _summed(Collection(_records(s, d)).insert(more, on_duplicate=mode).records())


_NEW = f"SELECT CASE WHEN vec_id < 100 THEN CAST(vec_id AS VARCHAR) ELSE 'n' || vec_id END AS id, {_SUM} AS total, 99 AS label FROM embeddings WHERE label = 3"
_OLD = f"SELECT CAST(vec_id AS VARCHAR) AS id, {_SUM} AS total, label FROM embeddings"
_add("crud_insert_replace", f"{_OLD} WHERE NOT (label = 3 AND vec_id < 100) UNION ALL {_NEW}", lambda s, d: _inserted(s, d, "replace"))
_add("crud_insert_append", f"{_OLD} UNION ALL {_NEW}", lambda s, d: _inserted(s, d, "append"))
_add("crud_delete", f"{_OLD} WHERE vec_id NOT IN (3, 5)", lambda s, d: _summed(Collection(_records(s, d)).delete(["3", "5", "nobody"]).records()))
_add("crud_delete_many", f"{_OLD} WHERE label <> 4", lambda s, d: _summed(Collection(_records(s, d)).delete(_records(s, d).where("label = 4")).records()))
_add("crud_update", f"SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id = 7 THEN 64.0 ELSE {_SUM} END AS total, label FROM embeddings", lambda s, d: _summed(Collection(_records(s, d)).update("7", [1.0] * 64).records()))


def _doubled(s: SparkSession, d: str) -> DataFrame:
    changes = _records(s, d).where("label = 2").withColumn("vector", F.transform("vector", lambda x: (x * 2).cast("float")))
    return _summed(Collection(_records(s, d)).update_many(changes).records())


_add("crud_update_many", f"SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN label = 2 THEN round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 2)), 6) ELSE {_SUM} END AS total, label FROM embeddings", _doubled)
_add("crud_get", f"{_OLD} WHERE vec_id = 42", lambda s, d: _summed(s.createDataFrame([r for i in ("42", "nobody") if (r := Collection(_records(s, d)).get(i))], _records(s, d).schema)))
_add("crud_len", "SELECT count(*) AS n, count(*) = 0 AS is_empty FROM embeddings", lambda s, d: s.createDataFrame([((c := Collection(_records(s, d))).count(), c.is_empty())], "n long, is_empty boolean"))


def _repeated(s: SparkSession, d: str) -> DataFrame:
    """Records appended beside others of their ids: the newest ones are moved, then deleted for some labels."""
    twice = _records(s, d).withColumn("label", F.col("label") + 100)
    c = Collection(_records(s, d)).insert(twice, on_duplicate="append")
    moved = _records(s, d).where("label = 2").withColumn("vector", F.transform("vector", lambda x: (x * 2).cast("float")))
    return _summed(c.update_many(moved).delete(_records(s, d).where("label = 4")).records())


_add("crud_repeated_ids", f"{_OLD} UNION ALL SELECT CAST(vec_id AS VARCHAR), CASE WHEN label = 2 THEN round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 2)), 6) ELSE {_SUM} END, label + 100 FROM embeddings WHERE label <> 4", _repeated)
_add("scan_snapshot", _OLD, lambda s, d: _summed(Collection(_records(s, d)).records()))
_add("semi_join_candidates", f"{_OLD} WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)", lambda s, d: _summed(Collection(_records(s, d)).candidates(_table(s, d, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("id"))).records()))
_add("json_roundtrip", _OLD, lambda s, d: _summed(from_json(to_json(_records(s, d).select("id", "vector", F.struct("label").alias("metadata")))).select("id", "vector", F.variant_get("metadata", "$.label", "int").alias("label"))))


def _store_roundtrip(s: SparkSession, d: str) -> DataFrame:
    projects = Projects(s, _shared(s, "projects"))
    projects.save("vectors", _records(s, d))
    projects.save("vectors", projects.load("vectors"))
    return _summed(projects.load("vectors"))


_add("store_roundtrip", _OLD, _store_roundtrip)
_add("store_missing_project", "SELECT CAST(NULL AS VARCHAR) AS id WHERE FALSE", lambda s, d: Projects(s, _shared(s, "none")).load("nothing").select("id"))


# Texts

_TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_VALID = f"octet_length(encode({_TRIM})) >= 40 AND length({_TRIM}) - length(translate({_TRIM}, '<>/\\', '')) <= len(regexp_extract_all({_TRIM}, '\\p{{L}}')) // 3 AND NOT contains(text, '<EOS>') AND NOT contains(text, '<pad>') AND NOT contains(text, '<unk>')"
_add("chunk_validity", f"SELECT doc_id, {_VALID} AS valid FROM documents", lambda s, d: _table(s, d, "documents").select("doc_id", is_valid_chunk(F.col("text")).alias("valid")))


def _chunk_documents(s: SparkSession, d: str) -> DataFrame:
    return chunked(_table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"), 500)


def _rag(s: SparkSession, d: str) -> RagEngine:
    engine = RagEngine(s, Projects(s, _shared(s, "rag")), HashingEmbedder(64))
    docs = _table(s, d, "benchmark").select(F.concat(F.lit("item"), "item_id").alias("path"), "text")
    engine.collection = Collection(engine.records_of(docs, 200))
    return engine


def _chunk_coverage(s: SparkSession, d: str) -> DataFrame:
    """What all chunks of a document hold but for blanks, and whether each is within the limit."""
    made = _table(s, d, "documents").select("doc_id", chunk_column(F.col("text"), 500).alias("chunks"))
    held = F.regexp_replace(F.array_join("chunks", ""), r"\s", "")
    return made.select("doc_id", F.md5(held.cast("binary")).alias("held"), F.forall("chunks", lambda c: (F.length(c) <= 500) & (F.length(c) > 0)).alias("fits"))


def _text_files(s: SparkSession, d: str, every: int = 0) -> str:
    """The benchmark's texts as files, one each; every so many of them are renamed to .pdf."""
    path = _shared(s, "files")
    _table(s, d, "benchmark").select("text").write.option("maxRecordsPerFile", 1).text(path)
    folder = s._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(s._jsc.hadoopConfiguration())
    found = sorted(f.getPath().toString() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-"))
    for i, name in enumerate(found):
        if every and i % every == 0:
            files.rename(s._jvm.org.apache.hadoop.fs.Path(name), s._jvm.org.apache.hadoop.fs.Path(f"{name}.PDF"))
    return f"{path}/part-*"


def _read_back(s: SparkSession, d: str, every: int) -> DataFrame:
    texts = read_texts(s, _text_files(s, d, every), (lambda content: "pdf " + content.decode()) if every else None)
    return texts.select(F.regexp_replace("text", r"^pdf |\n$", "").alias("text"), F.startswith("text", F.lit("pdf ")).alias("extracted")).groupBy("text").agg(F.count("*").alias("n")).select("text", "n")


def _ingested(s: SparkSession, d: str) -> DataFrame:
    """Files read, cut, embedded, saved and loaded again: the records that a second engine finds."""
    projects = Projects(s, _shared(s, "projects"))
    engine = RagEngine(s, projects, HashingEmbedder(64))
    engine.init("p")
    n = engine.ingest(_text_files(s, d), 100_000)
    engine.save("p")
    again = RagEngine(s, projects, HashingEmbedder(64)).load("p").collection
    return again.records().groupBy("text").agg(F.count("*").alias("n"), (F.max(F.size("vector")) == 64).alias("embedded")).select("text", "n", "embedded", F.lit(n == again.count()).alias("all_kept"))


def _engine_errors(s: SparkSession, d: str) -> DataFrame:
    """What loading and making projects says."""
    engine, out = RagEngine(s, Projects(s, _shared(s, "projects")), HashingEmbedder(8)), []
    for step, call in (("init", engine.init), ("init again", engine.init), ("load", engine.load)):
        try:
            call("p")
            out.append((step, "done"))
        except VectorError as e:
            out.append((step, str(e)))
    return s.createDataFrame(out, "step string, said string")


def _service(url: str, key: str, body: dict) -> dict:
    """Stands in for the services: vectors of a text's length and its letters e, answers of the prompt's last line."""
    if "messages" in body:
        return {"choices": [{"message": {"content": f"{body['model']}: " + body["messages"][1]["content"].rsplit("\n", 1)[-1]}}]}
    return {"data": [{"embedding": [float(len(t)), float(t.count("e"))]} for t in body["input"]]}


def _embed_api(s: SparkSession, d: str) -> DataFrame:
    made = _table(s, d, "benchmark").select("item_id", embedding(F.col("text"), ApiEmbedder("http://service", "key", "model", _service)).alias("v"))
    return made.select("item_id", F.col("v")[0].cast("long").alias("letters"), F.col("v")[1].cast("long").alias("es"))


def _embed_local(s: SparkSession, d: str) -> DataFrame:
    made = _table(s, d, "benchmark").select("item_id", embedding(F.col("text"), HashingEmbedder(64)).alias("v"))
    return made.select("item_id", F.round(norm(F.col("v")), 4).alias("length"), F.size("v").alias("dimension"))


def _embed_auto(s: SparkSession, d: str) -> DataFrame:
    """Which embedder the settings choose."""
    names, out = ("EMBED_API_URL", "EMBED_API_KEY", "EMBED_MODEL_NAME"), []
    before = {n: os.environ.pop(n, None) for n in names}
    try:
        out.append(("nothing", type(auto_embedder()).__name__))
        os.environ["EMBED_API_URL"] = "http://service"
        try:
            auto_embedder()
        except VectorError as e:
            out.append(("address", str(e)))
        os.environ |= {"EMBED_API_KEY": "key", "EMBED_MODEL_NAME": "model"}
        out.append(("all", type(auto_embedder()).__name__))
    finally:
        for n in names:
            os.environ.pop(n, None)
        os.environ |= {n: v for n, v in before.items() if v is not None}
    return s.createDataFrame(out, "setting string, chosen string")


def _whole(s: SparkSession, d: str, chat: ApiChat | None = None) -> RagEngine:
    """An engine whose chunks are whole texts."""
    engine = RagEngine(s, Projects(s, _shared(s, "rag")), HashingEmbedder(64), chat)
    engine.collection = Collection(engine.records_of(_table(s, d, "benchmark").select(F.concat(F.lit("item"), "item_id").alias("path"), "text"), 100_000))
    return engine


def _asked(s: SparkSession, d: str) -> list[str]:
    """The texts of the items whose id is divisible by 20, which are what the engine is asked for."""
    return [r["text"] for r in _table(s, d, "benchmark").where("item_id % 20 = 0").where(is_valid_chunk(F.col("text"))).orderBy("item_id").collect()]


def _found(s: SparkSession, d: str, condition: str | None) -> DataFrame:
    engine = _whole(s, d)
    got = [(t, (engine.query_filtered(t, condition, 1) if condition else engine.query(t, 1))[0]) for t in _asked(s, d)]
    return s.createDataFrame(got, "question string, text string")


_VALID_ITEM = _VALID.replace("doc_id", "item_id")
_ITEMS = f"SELECT text, count(*) AS n FROM benchmark WHERE {_VALID_ITEM} GROUP BY text"
_add("chunk_documents", None, _chunk_documents)
_add("chunk_coverage", r"SELECT doc_id, md5(regexp_replace(text, '\s', '', 'g')) AS held, TRUE AS fits FROM documents", _chunk_coverage)
_add("read_text_files", "SELECT text, count(*) AS n FROM benchmark GROUP BY text", lambda s, d: _read_back(s, d, 0))
_add("read_pdf_files", "SELECT text, count(*) AS n FROM benchmark GROUP BY text", lambda s, d: _read_back(s, d, 2))
_add("rag_ingest", f"SELECT text, n, TRUE AS embedded, TRUE AS all_kept FROM ({_ITEMS})", _ingested)
_add("rag_projects", "SELECT * FROM (VALUES ('init', 'done'), ('init again', 'project ''p'' already exists'), ('load', 'project ''p'' is empty. Run ''add'' first.')) t(step, said)", _engine_errors)
_add("embed_api", "SELECT item_id, length(text) AS letters, length(text) - length(replace(text, 'e', '')) AS es FROM benchmark", _embed_api)
_add("embed_local", "SELECT item_id, 1.0::DOUBLE AS length, 64 AS dimension FROM benchmark", _embed_local)
_add("embed_auto", "SELECT * FROM (VALUES ('nothing', 'HashingEmbedder'), ('address', 'EMBED_API_KEY not set'), ('all', 'ApiEmbedder')) t(setting, chosen)", _embed_auto)
_add("rag_generate", "SELECT 'model: Question: Why is that?' AS answer", lambda s, d: s.createDataFrame([(_whole(s, d, ApiChat("http://service", "key", "model", _service)).generate("Why is that?"),)], "answer string"))
_add("rag_query", f"SELECT text AS question, text FROM benchmark WHERE item_id % 20 = 0 AND {_VALID_ITEM}", lambda s, d: _found(s, d, None))
_add("rag_query_filtered", f"SELECT text AS question, text FROM benchmark WHERE item_id % 20 = 0 AND {_VALID_ITEM}", lambda s, d: _found(s, d, 'source LIKE "item%" AND NOT source = "nothing"'))


def _prompts(s: SparkSession, d: str) -> DataFrame:
    asked = _table(s, d, "conversations").where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.col("text").alias("question"))
    made = _rag(s, d).prompts(asked)
    return made.select("query_id", F.element_at(F.split("prompt", "\n\nQuestion: "), -1).alias("question"), (F.size(F.split("prompt", "\n---\n")) == 3).alias("three"))


_add("rag_prompts", "SELECT conv_id || ':' || turn AS query_id, text AS question, TRUE AS three FROM conversations WHERE role = 'user'", _prompts)


def _stream(s: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder."""
    # As a pattern, since a stream takes a plain path for a folder.
    return s.readStream.schema(_table(s, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _stream_filtered(s: SparkSession, d: str) -> DataFrame:
    path = _shared(s, "stream")
    streams.ingest(streams.filtered(_stream(s, d, "events"), 'event_type = "click" AND value > 100'), path, _shared(s, "offsets")).awaitTermination()
    return s.read.parquet(path).select("event_id")


def _stream_answered(s: SparkSession, d: str) -> DataFrame:
    path = _shared(s, "answers")
    asked = _stream(s, d, "embeddings").where(_ASKED).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    streams.answer(asked, Collection(_embeddings(s, d)), 5, Metric.EUCLIDEAN, path, _shared(s, "offsets")).awaitTermination()
    return _batch_out(s.read.parquet(path))


_add("stream_filtered", "SELECT event_id FROM events WHERE event_type = 'click' AND value > 100", _stream_filtered)
_add("stream_answered", _batch_sql("euclidean"), _stream_answered)


def _errors(s: SparkSession, d: str) -> DataFrame:
    """What the parser says about conditions that are none."""
    out = []
    for text in _BROKEN:
        try:
            parse(text)
            out.append((text, "parsed"))
        except VectorError as e:
            out.append((text, str(e).partition(":")[0]))
    return s.createDataFrame(out, "condition string, said string")


_BROKEN = ("", "price >", "price > 1 AND", "(price > 1", "price ! 1", "= 1", "price IN (", "price LIKE 5", 'name = "open')
_add("filter_errors", "SELECT condition, 'filter parse error' AS said FROM (VALUES " + ", ".join(f"('{t}')" for t in _BROKEN) + ") t(condition)", _errors)


def _rag_prompt(s: SparkSession, d: str) -> DataFrame:
    near = knn.nearest_for_each(_embeddings(s, d), _batch(s, d), 3, Metric.COSINE)
    texts = near.join(_table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    ranked = texts.groupBy("query_id").agg(F.collect_list(F.struct("rank", "text")).alias("ranked"))  # three rows a group
    return ranked.select("query_id", prompt_column(F.concat(F.lit("Which is "), F.col("query_id").cast("string"), F.lit("?")), F.col("ranked")).alias("prompt"))


_PAIR = _d("cosine", "CAST(e.embedding AS DOUBLE[])", "CAST(b.embedding AS DOUBLE[])")
_add(
    "rag_prompt",
    "SELECT query_id, 'Answer the question using only the context below.' || chr(10) || chr(10) || 'Context:' || chr(10) || string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: Which is ' || query_id || '?' AS prompt "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (SELECT b.vec_id AS query_id, e.vec_id, {_PAIR} AS distance FROM embeddings e, embeddings b WHERE b.vec_id % 20 = 0)) JOIN documents ON vec_id = doc_id WHERE rank <= 3 GROUP BY query_id",
    _rag_prompt,
)
