import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatch, EmptyVector, NotFound, Other
from nearfield.functions import metrics
from nearfield.functions.text import chunks, is_valid_chunk
from nearfield.operators import ann, knn
from nearfield.operators.collection import Collection, records_from
from nearfield.operators.metadata import Postings
from nearfield.operators.rag import SYSTEM, RagEngine
from nearfield.sources.services import ApiEmbedder, HashingEmbedder, auto_embedder
from nearfield.sources.store import Projects, from_json, read_texts, to_json, to_variant
from nearfield.streaming.search import answer, filtered, ingest


@pytest.mark.parametrize(
    ("metric", "a", "b", "want"),
    [
        ("cosine", [1, 2, 3], [4, 5, 6], 0.025368), ("cosine", [1, 0], [-1, 0], 2), ("cosine", [1, 0], [0, 1], 1), ("cosine", [0, 0], [1, 1], 0),
        ("euclidean", [0, 0], [3, 4], 5), ("dot", [1, 2, 3], [4, 5, 6], -32), ("manhattan", [-1, -2], [3, 4], 10),
        ("hamming", [0, 1, 0, 1], [0, 1, 1, 1], 0.25), ("hamming", [0.0, 1], [-0.0, 1], 0.5), ("hamming", [float("nan")], [float("nan")], 0),
    ],
)
def test_distances(spark, metric, a, b, want):
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<float>, b array<float>")
    assert df.select(metrics.distance(metric, F.col("a"), F.col("b"))).first()[0] == pytest.approx(want, abs=1e-5)
    assert knn.distances(np.array([a], float), np.array([b], float), metrics.Metric(metric))[0, 0] == pytest.approx(want, abs=1e-5)


def test_registered_distance(spark):
    metrics.register("chebyshev", lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))))
    df = spark.createDataFrame([("a", [1.0, 5.0]), ("b", [2.0, 2.0])], "id string, vector array<float>")
    assert [r.id for r in Collection(df).search([2.0, 3.0], 2, "chebyshev").collect()] == ["b", "a"]
    with pytest.raises(ValueError, match="unknown metric"):
        metrics.distance("nope", F.col("a"), F.col("b"))


@pytest.fixture
def points(spark):
    return spark.createDataFrame([("r1", [1.0, 0.0], "book", 30, "red"), ("r2", [5.0, 0.0], "book", 80, "blue"), ("r3", [9.0, 0.0], "film", 50, "red")], "id string, vector array<float>, category string, price int, color string")


def ids(df):
    return [r.id for r in df.collect()]


def test_search_and_guards(spark, points):
    c = Collection(points)
    assert ids(c.search([0.0, 0.0], 2, "euclidean")) == ["r1", "r2"]
    assert ids(c.search([0.0, 0.0], 99, "euclidean")) == ["r1", "r2", "r3"]
    assert ids(c.search([0.0], 0, "euclidean")) == []
    with pytest.raises(DimensionMismatch, match="Dimension mismatch: expected 2, got 1"):
        c.search([0.0], 1)
    empty = Collection(points.limit(0))
    assert ids(empty.search([1.0, 2.0, 3.0], 5)) == [] and empty.is_empty() and empty.dimension == 0
    q = spark.createDataFrame([(1, [1.0])], "query_id int, query_vector array<float>")
    with pytest.raises(DimensionMismatch):
        empty.search_batch(q, 1)


def test_filtered_search(points):
    c = Collection(points)
    assert ids(c.search_filtered([9.0, 0.0], 5, 'category = "book" AND price < 50', "euclidean")) == ["r1"]
    assert ids(c.search_filtered([9.0, 0.0], 1, 'color = "red"', "euclidean")) == ["r3"]
    assert ids(c.search_filtered([9.0, 0.0], 3, 'color = "none"', "euclidean")) == []
    with pytest.raises(DimensionMismatch):
        c.search_filtered([1.0], 3, "price > 0")
    assert ids(c.matching_ids("price >= 50")) == ["r2", "r3"]


def test_changes(spark, points):
    c = Collection(points)
    with pytest.raises(EmptyVector):
        c.insert(spark.createDataFrame([("x", [])], "id string, vector array<float>"))
    with pytest.raises(DimensionMismatch):
        c.insert(spark.createDataFrame([("x", [1.0]), ("y", [1.0, 2.0])], "id string, vector array<float>"))
    more = c.insert(spark.createDataFrame([("r1", [7.0, 7.0]), ("r4", [2.0, 2.0])], "id string, vector array<float>"))
    assert more.count() == 4 and more.get("r1")["vector"] == [7.0, 7.0] and more.get("r1")["category"] is None
    assert c.insert(points, on_duplicate="append").count() == 6
    assert c.delete(["r1", "nobody"]).count() == 2 and c.delete([]).count() == 3
    assert c.delete(["r1", "r2", "r3"]).dimension == 0
    moved = c.update("r2", [0.0, 0.5])
    assert moved.get("r2")["price"] == 80 and ids(moved.search([0.0, 0.0], 1, "euclidean")) == ["r2"]
    with pytest.raises(NotFound, match="Record not found: zz"):
        c.update("zz", [1.0, 1.0])
    with pytest.raises(EmptyVector):
        c.update("r1", [])
    with pytest.raises(NotFound):
        c.update_many(spark.createDataFrame([("zz", [1.0, 1.0])], "id string, vector array<float>"))
    assert ids(c.candidates(spark.createDataFrame([("r3",), ("r3",), ("q",)], "id string")).records()) == ["r3"]


def test_batch_equals_single_in_every_way(spark):
    rng = np.random.default_rng(1)
    grid = rng.normal(size=(300, 8)).round(1)
    records = spark.createDataFrame([(f"v{i:03}", r.tolist()) for i, r in enumerate(grid)], "id string, vector array<float>").repartition(3)
    queries = spark.createDataFrame([(i, grid[i * 7].tolist()) for i in range(5)], "query_id int, query_vector array<float>")
    c = Collection(records)
    for metric in metrics.Metric:
        single = {i: ids(c.search(grid[i * 7].astype(np.float32).tolist(), 6, metric)) for i in range(5)}
        for method in ("blocks", "expressions"):
            got = c.search_batch(queries, 6, metric, method=method).orderBy("query_id", "rank").collect()
            assert {i: [r.id for r in got if r.query_id == i] for i in range(5)} == single, (metric, method)
    assert c.search_batch(queries.limit(0), 3).count() == 0


def brute(grid, q, k, metric):
    """Ids of the k nearest rows, by the definition and ties by id."""
    d = {"euclidean": lambda: np.sqrt(((grid - q) ** 2).sum(1)), "dot": lambda: -(grid * q).sum(1), "cosine": lambda: 1 - (grid * q).sum(1) / (np.linalg.norm(grid, axis=1) * np.linalg.norm(q)), "manhattan": lambda: np.abs(grid - q).sum(1)}[metric]()
    return [i for _, i in sorted(zip(d.tolist(), range(len(grid)), strict=True))[:k]], d


@pytest.mark.parametrize(("scale", "spread"), [(1000.0, 1e-6), (1.0, 1e-9), (1e6, 1e-3), (0.0, 1.0)])
def test_blocks_lose_no_near_copies(spark, scale, spread):
    """Very many vectors that nearly equal the query: the neighbours are those of an exact search."""
    rng = np.random.default_rng(7)
    grid = scale + spread * rng.normal(size=(2000, 16))
    records = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(grid)], "id long, vector array<double>").repartition(2)
    queries = spark.createDataFrame([(i, grid[i].tolist()) for i in (0, 999, 1500)], "query_id long, query_vector array<double>")
    for metric in ("euclidean", "manhattan"):
        got = knn.nearest_for_each(records, queries, 10, metric, method="blocks").orderBy("query_id", "rank").collect()
        for q in (0, 999, 1500):
            assert [r.id for r in got if r.query_id == q] == brute(grid, grid[q], 10, metric)[0]
    for metric in ("dot", "cosine"):
        got = knn.nearest_for_each(records, queries, 10, metric, method="blocks").collect()
        for q in (0, 999, 1500):
            want, d = brute(grid, grid[q], 10, metric)
            mine = sorted(float(d[r.id]) for r in got if r.query_id == q)
            assert len(mine) == 10 and np.allclose(mine, np.sort(d)[:10], rtol=1e-12, atol=1e-14)


def test_vectors_of_other_lengths_and_none(spark):
    ragged = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [9.0, 9.0]), ("c", [1.0, 1.0, 1.0, 1.0])], "id string, vector array<float>").coalesce(1)
    queries = spark.createDataFrame([(1, [9.0, 9.0, 0.0])], "query_id int, query_vector array<float>")
    with pytest.raises(Exception, match="expected 3, got 2"):
        knn.nearest_for_each(ragged, queries, 2, "euclidean", method="blocks").collect()
    with pytest.raises(DimensionMismatch):
        Collection(ragged).search([1.0, 2.0, 3.0], 1)
    good = ragged.where("id = 'a'")
    nothing = spark.createDataFrame([(1, None)], queries.schema)
    for search in (lambda: knn.nearest_for_each(good, nothing, 1, "euclidean", method="blocks"), lambda: Collection(good).search_batch(nothing, 1)):
        with pytest.raises(EmptyVector):
            search()
    with pytest.raises(EmptyVector):
        Collection(good).insert(spark.createDataFrame([("n", None)], good.schema))
    part = spark.createDataFrame([("x", None), ("y", [1.0, float("nan"), 0.0]), ("z", [1.0, 1.0, 1.0])], good.schema)
    assert [r.id for r in knn.nearest_for_each(part, queries, 3, "euclidean", method="blocks").orderBy("rank").collect()] == ["z", "y"]


def test_repeated_ids(spark):
    """The newest record of an id is read, changed and deleted; older ones stay."""
    table = lambda rows: spark.createDataFrame(rows, "id string, vector array<float>, n int")
    c = Collection(table([("a", [1.0], 1), ("b", [2.0], 1)])).insert(table([("a", [5.0], 2), ("c", [3.0], 2)]), on_duplicate="append").insert(table([("a", [4.0], 3), ("a", [4.5], 4)]), on_duplicate="append", order="n")
    vectors = lambda x: sorted((r.id, r.vector[0]) for r in x.records().collect())
    assert vectors(c) == [("a", 1.0), ("a", 4.0), ("a", 4.5), ("a", 5.0), ("b", 2.0), ("c", 3.0)] and c.records().columns == ["id", "vector", "n"]
    assert c.get("a")["n"] == 4 and c.search([4.4], 1, "euclidean").columns == ["id", "vector", "n", "distance"]
    less = c.delete(["a", "nobody"])
    assert vectors(less) == [("a", 1.0), ("a", 4.0), ("a", 5.0), ("b", 2.0), ("c", 3.0)] and less.get("a")["n"] == 3
    assert less.delete(spark.createDataFrame([("a",), ("a",), ("b",)], "id string")).get("a")["n"] == 2
    assert vectors(c.delete(["a"]).delete(["a"]).delete(["a"]).delete(["a"])) == [("b", 2.0), ("c", 3.0)]
    moved = c.update("a", [9.0])
    assert vectors(moved) == [("a", 1.0), ("a", 4.0), ("a", 5.0), ("a", 9.0), ("b", 2.0), ("c", 3.0)] and moved.get("a")["n"] == 4
    batch = Collection(table([])).insert(table([("a", [1.0], 2), ("a", [7.0], 1)]), order="n")
    assert vectors(batch) == [("a", 1.0)] and vectors(Collection(table([])).insert(table([("a", [1.0], 2), ("a", [7.0], 1)]))) == [("a", 7.0)]
    many = c.update_many(spark.createDataFrame([("a", [8.0]), ("c", [8.0])], "id string, vector array<float>"))
    assert vectors(many) == [("a", 1.0), ("a", 4.0), ("a", 5.0), ("a", 8.0), ("b", 2.0), ("c", 8.0)]


def test_index_goes_with_changes(spark, monkeypatch):
    """Inserts, deletes and updates keep the centroids; a search finds what is there, by all cells exactly."""
    rng = np.random.default_rng(3)
    grid = rng.normal(size=(300, 8))
    table = lambda rows: spark.createDataFrame([(f"r{i}", v.tolist()) for i, v in rows], "id string, vector array<float>")
    c = Collection(table(enumerate(grid)), index="ivf", params=ann.Params(n_cells=10, nprobe=10))
    first = c.ivf.centroids
    monkeypatch.setattr(ann, "build", lambda *a: pytest.fail("fitted again"))
    grid = np.concatenate((grid, rng.normal(size=(50, 8))))
    c = c.insert(table([(i, grid[i]) for i in range(300, 350)])).delete(["r7", "r301"]).update("r9", grid[20].tolist())
    grid[9] = grid[20]
    grid[[7, 301]] = 1e9
    assert (c.ivf.centroids == first).all() and sum(c.ivf.sizes.values()) == c.count() == 348
    for i in (0, 20, 310, 349):
        assert ids(c.search(grid[i].astype(np.float32).tolist(), 5, "euclidean")) == [f"r{j}" for j in sorted(np.argsort(((grid.astype(np.float32) - grid[i].astype(np.float32)) ** 2).sum(1), kind="stable")[:5], key=lambda j: (((grid.astype(np.float32)[j] - grid.astype(np.float32)[i]) ** 2).sum(), f"r{j}"))]
    queries = table([(i, grid[i]) for i in (0, 20, 310)]).toDF("query_id", "query_vector")
    got = c.search_batch(queries, 3, "euclidean").collect()
    assert {r.query_id for r in got if r["rank"] == 1 and r.distance == 0} == {"r0", "r20", "r310"}


def test_probes_are_measured(spark):
    """Clustered vectors need few cells, unordered ones many; recall holds on all ids divisible by 20."""
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(20, 12)) * 20
    for grid, few in ((middles[np.arange(2000) % 20] + rng.normal(size=(2000, 12)), True), (rng.normal(size=(2000, 12)), False)):
        records = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(grid)], "id int, vector array<float>")
        index = ann.build(records)
        assert (index.nprobe <= 8) == few and 1 <= index.nprobe <= len(index.centroids)
        queries = records.where("id % 20 = 0").toDF("query_id", "query_vector")
        exact, found = ({(r.query_id, r.id) for r in x.collect()} for x in (knn.nearest_for_each(records, queries, 10, "euclidean"), index.search_batch(queries, 10, "euclidean")))
        assert len(exact & found) >= 0.9 * len(exact)


def test_large_literals(spark):
    df = spark.createDataFrame([(1, 2.0**70), (2, 5.0), (2**62, -(2.0**80))], "id long, value double")
    assert ids(Collection(df.withColumn("vector", F.array(F.lit(1.0)))).matching_ids("value < 100000000000000000000000.0")) == [1, 2, 2**62]
    assert ids(df.where(Collection(df).where("id >= 9223372036854775808.0"))) == [] and ids(df.where(Collection(df).where("value > 1000000000000000000000.0"))) == [1]


def test_save_survives_a_crash(spark, points, tmp_path, monkeypatch):
    """Whatever the step at which a save ends, the project can be loaded, old or new."""
    projects = Projects(spark, f"file://{tmp_path}")
    projects.save("a", points)
    (tmp_path / "a/records").rename(tmp_path / "a/_old")
    assert projects.exists("a") and projects.load("a").count() == 3
    projects.save("a", projects.load("a").where("price > 30"))
    assert projects.load("a").count() == 2
    projects.save("a", points)
    assert projects.load("a").count() == 3 and sorted(p.name for p in (tmp_path / "a").iterdir()) == ["records"]


def test_approximate_search(spark, tmp_path):
    rng = np.random.default_rng(5)
    grid = rng.normal(size=(1200, 16))
    records = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(grid)], "id int, vector array<float>")
    index = ann.build(records, ann.Params(n_cells=20))
    exact = [set(np.argsort(((grid - grid[i]) ** 2).sum(1))[:10].tolist()) for i in range(0, 200, 20)]
    found = [set(ids(index.search(grid[i].tolist(), 10, "euclidean"))) for i in range(0, 200, 20)]
    assert np.mean([len(a & b) / 10 for a, b in zip(exact, found, strict=True)]) >= 0.9
    full = ann.IvfIndex(index.df, index.centroids, index.sizes, ann.Params(nprobe=20))
    assert set(ids(full.search(grid[0].tolist(), 10, "euclidean"))) == exact[0]
    index.save(str(tmp_path / "ivf"))
    again = ann.load(spark, str(tmp_path / "ivf"))
    assert ids(again.search(grid[3].tolist(), 5, "euclidean")) == ids(index.search(grid[3].tolist(), 5, "euclidean"))
    spark.createDataFrame([('{"format": "other", "version": 9}',)], "head string").write.mode("overwrite").parquet(str(tmp_path / "ivf/head"))
    with pytest.raises(Other, match="not an index"):
        ann.load(spark, str(tmp_path / "ivf"))
    assert Collection(records, index="auto")._uses_ivf() and not Collection(records.limit(999), index="auto")._uses_ivf()
    with pytest.raises(Other):
        ann.build(records.limit(0))


def test_zero_vectors_are_always_probed_for_cosine(spark):
    rows = [(i, [math.cos(i), math.sin(i)]) for i in range(30)] + [(99, [0.0, 0.0])]
    index = ann.build(spark.createDataFrame(rows, "id int, vector array<float>"), ann.Params(n_cells=6, nprobe=1, budget=1, metric="cosine"))
    assert 99 in ids(index.search([1.0, 0.0], 2, "cosine"))


def test_plans(spark, points):
    plan = knn.nearest(points, [0.0, 0.0], 2, "euclidean")._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<float>")
    assert "WindowGroupLimit" in knn.nearest_for_each(points, q, 2, "euclidean", method="expressions")._jdf.queryExecution().toString()


def test_postings(spark, points):
    p = Postings.of(points.drop("vector"))
    assert sorted(ids(p.string("color", "red"))) == ["r1", "r3"]
    assert ids(p.number_above("price", 30)) == ["r3", "r2"]
    assert ids(p.string_suffix("color", "ue")) == ["r2"] and ids(p.string_prefix("category", "f")) == ["r3"] and len(ids(p.string_contains("category", "oo"))) == 2
    assert {r.kind: r.fields for r in p.field_counts().collect()} == {"string": 2, "number": 1}
    assert ids(p.clear_field("color").with_field("color")) == []
    gone = spark.createDataFrame([("r1", "color")], "id string, field string")
    assert ids(p.deindex(gone).string("color", "red")) == ["r3"]
    assert len(ids(p.index(points.drop("vector")).string("color", "blue"))) == 2


def test_projects(spark, points, tmp_path):
    projects = Projects(spark, f"file://{tmp_path}")
    assert not projects.exists("a") and projects.load("a").count() == 0 and not projects.exists("a")
    projects.save("a", points)
    projects.save("a", projects.load("a").where("price > 30"))
    assert projects.exists("a") and ids(projects.load("a").orderBy("id")) == ["r2", "r3"]
    for bad in ("..", "a/b", "", "."):
        with pytest.raises(Other):
            projects.path(bad)


def test_json_and_variant(spark, points):
    back = from_json(to_json(points.select("id", "vector", F.struct("price").alias("metadata"))))
    assert sorted((r.id, r.p) for r in back.select("id", F.variant_get("metadata", "$.price", "int").alias("p")).collect()) == [("r1", 30), ("r2", 80), ("r3", 50)]
    c = Collection(to_variant(points, ["category", "price", "color"]))
    assert ids(c.search_filtered([0.0, 0.0], 3, 'category = "book" AND price > 40', "euclidean")) == ["r2"]


def test_chunks():
    text = "One. Two words here.\n\nA new paragraph that is rather long, longer than the limit allows. End."
    for size in (1, 5, 20, 40, 1000):
        got = chunks(text, size)
        assert all(0 < len(c) <= size and c == c.strip() for c in got)
        assert "".join("".join(got).split()) == "".join(text.split())
    assert chunks("  \n ", 10) == [] and chunks("", 3) == []
    assert chunks("aaaa bbbb\n\ncccc dddd", 12) == ["aaaa bbbb", "cccc dddd"]
    assert chunks("x" * 10, 4) == ["xxxx", "xxxx", "xx"]
    assert chunks("a b\n\n\nc d\n\ne f\ng h", 11) == ["a b", "c d", "e f\ng h"]
    assert chunks("One two. Three four five", 14) == ["One two.", "Three four", "five"]
    assert chunks("e\u0301e\u0301e\u0301", 3) == ["e\u0301", "e\u0301", "e\u0301"]


def plain_chunks(text, size):
    """Every place is tried, for each strength of boundary in turn."""
    import regex

    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        if text[at].isspace():
            at += 1
            continue
        if end - at <= size:
            return [*out, text[at:end]]
        best = None
        for strength in range(7):
            for stop in range(at + size, at, -1):
                after = stop
                while after < min(len(text), at + size + 1) and text[after].isspace():
                    after += 1
                gap, before = text[stop:after], text[at:stop]
                lines = gap.count("\n")
                if strength < 4:
                    ok = lines >= 4 - strength and not before[-1].isspace()
                elif strength == 4:
                    ok = bool(gap) and regex.search(r"""[.!?…]["')\]]*$""", before) is not None
                elif strength == 5:
                    ok = bool(gap) and not before[-1].isspace()
                else:
                    ok = stop in {m.end() for m in regex.finditer(r"\X", text[: at + size + 1], pos=at)}
                if ok:
                    best = stop
                    break
            if best:
                break
        best = best or at + size
        out.append(text[at:best].rstrip())
        at = best
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab.!)é\u0301 \n\t\U0001f600\u200d"), max_size=60), st.integers(1, 20))
def test_chunks_by_brute_force(text, size):
    assert chunks(text, size) == plain_chunks(text, size)


def test_chunks_are_linear():
    import time

    took = []
    for n in (20_000, 80_000):
        text = "word. " * n
        began = time.time()
        assert sum(map(len, chunks(text, 500))) > 5 * n
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 1


def test_chunk_validity(spark):
    cases = [("a" * 39, False), ("a" * 40, True), (" " * 20 + "a" * 39, False), ("é" * 20, True), ("a" * 40 + "<" * 13, True), ("a" * 40 + "<" * 14, False), ("a" * 50 + "<pad>", False), ("1" * 45, True), (" " + "b" * 40 + " ", True)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(is_valid_chunk(F.col("t"))).collect()] == [w for _, w in cases]


def test_retrieval(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("EMBED_API_URL", raising=False)
    assert isinstance(auto_embedder(), HashingEmbedder)
    monkeypatch.setenv("EMBED_API_URL", "http://localhost:1")
    with pytest.raises(Other, match="EMBED_API_KEY not set"):
        ApiEmbedder.from_env()
    texts = tmp_path / "texts"
    texts.mkdir()
    (texts / "cats.txt").write_text("Cats sleep for most of the day and hunt at night in gardens.")
    (texts / "ships.txt").write_text("Ships carry most of the goods that are traded across the oceans.")
    asked = []
    engine = RagEngine(spark, Projects(spark, f"file://{tmp_path}/projects"), HashingEmbedder(256), lambda system, prompt: asked.append((system, prompt)) or "fine")
    assert engine.ingest(f"file://{texts}", 200) == 2
    assert engine.ingest(f"file://{texts}", 200) == 2 and engine.collection.count() == 2
    assert engine.query("cats sleep at night", 1)[0].startswith("Cats")
    assert engine.query_filtered("cats sleep", 'source LIKE "%ships.txt"', 5)[0].startswith("Ships")
    assert engine.generate("Do cats sleep?") == "fine"
    assert asked[0][0] == SYSTEM and "\n---\n" in asked[0][1] and asked[0][1].endswith("\n\nQuestion: Do cats sleep?")
    prompts = engine.prompts(spark.createDataFrame([(1, "Do cats sleep?")], "query_id int, question string")).collect()
    assert prompts[0].prompt == asked[0][1]
    engine.init("p")
    with pytest.raises(Other, match="already exists"):
        engine.init("p")
    with pytest.raises(Other, match="is empty"):
        RagEngine(spark, engine.projects, HashingEmbedder(256)).load("p")
    engine.save("p")
    assert RagEngine(spark, engine.projects, HashingEmbedder(256)).load("p").collection.count() == 2
    (texts / "x.PDF").write_bytes(b"%PDF")
    with pytest.raises(Other, match="PDF"):
        read_texts(spark, f"file://{texts}")
    assert read_texts(spark, f"file://{texts}", lambda b: b.decode()[1:]).where("text = 'PDF'").count() == 1


class Service:
    """A small HTTP service in this process: refuses every third request, and keeps what it was sent."""

    def __enter__(self):
        import json
        import threading
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

        bodies = self.bodies = []

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                bodies.append((self.headers["Authorization"], body))
                if len(bodies) % 3 == 1:
                    self.send_error(503)
                    return
                made = {"choices": [{"message": {"content": "said"}}]} if "messages" in body else {"data": [{"embedding": [float(len(t)), 1.0]} for t in body["input"]]}
                self.send_response(200)
                self.end_headers()
                self.wfile.write(json.dumps(made).encode())

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/v1"
        return self

    def __exit__(self, *error):
        self.server.shutdown()


def test_services(monkeypatch):
    from nearfield.sources import services

    monkeypatch.setattr(services, "WAIT", 0.01)
    with Service() as service:
        made = ApiEmbedder(service.url, "k", "m").embed(["x" * i for i in range(150)])
        assert [v[0] for v in made] == list(range(150))
        sent = [b for _, b in service.bodies]
        assert max(len(b["input"]) for b in sent) == services.REQUEST_TEXTS and sent[0]["model"] == "m" and service.bodies[0][0] == "Bearer k"
        assert services.ApiChat(service.url, "k", "m")("system", "prompt") == "said"
    with pytest.raises(Other):
        ApiEmbedder(service.url, "k", "m").embed(["x"])


def test_folder_embedder(spark, tmp_path, monkeypatch):
    from nearfield.sources.services import FolderEmbedder, embedding

    with pytest.raises(Other, match="model path not found"):
        FolderEmbedder(str(tmp_path / "none"))
    (tmp_path / "scale").write_text("3")

    def load(path):
        with open(f"{path}/scale") as f:
            scale = float(f.read())
        return lambda texts: [[scale * len(t), 1.0] for t in texts]

    df = spark.createDataFrame([("ab",), ("",), (None,)], "t string").select("t", embedding(F.col("t"), FolderEmbedder(str(tmp_path), load)).alias("v"))
    assert {r.t: r.v for r in df.collect()} == {"ab": [6.0, 1.0], "": [0.0, 1.0], None: [0.0, 1.0]}
    monkeypatch.delenv("EMBED_API_URL", raising=False)
    monkeypatch.setenv("NEARFIELD_MODEL_PATH", str(tmp_path))
    assert isinstance(auto_embedder(), FolderEmbedder)


def test_streams(spark, points, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    points.write.parquet(source)
    stream = spark.readStream.schema(points.schema).parquet(source)
    ingest(filtered(stream, "price > 30"), sink, str(tmp_path / "c1")).awaitTermination()
    assert sorted(ids(spark.read.parquet(sink))) == ["r2", "r3"]
    asked = str(tmp_path / "asked")
    spark.createDataFrame([(1, [9.0, 0.0])], "query_id int, query_vector array<float>").write.parquet(asked)
    queries = spark.readStream.schema("query_id int, query_vector array<float>").parquet(asked)
    answer(queries, Collection(points), 1, "euclidean", str(tmp_path / "answers"), str(tmp_path / "c2")).awaitTermination()
    assert ids(spark.read.parquet(str(tmp_path / "answers"))) == ["r3"]


def test_records_from(spark):
    got = records_from(spark.createDataFrame([(1, [1.5], "m")], "k long, v array<double>, tag string"), id="k", vector="v", metadata=["tag"]).first()
    assert got.id == "1" and got.vector == [1.5] and got.tag == "m"
