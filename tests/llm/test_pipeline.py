"""The pipeline against plain versions of its stages."""

import zlib
from collections import Counter
from pathlib import Path

import numpy as np

import corpus_pipeline
from nearfield.llm import decontaminate, mixing, tokens
from tests.llm.conftest import documents, words
from tests.llm.test_operators import edited, plain_components, plain_scan


def corpus(spark):
    import random

    rng = random.Random(8)
    rows = [(i, words(60, i, 3000).replace("w", "za" if i % 2 else "ko"), "aa" if i % 2 else "bb", f"s{i % 3}") for i in range(120)]
    rows += [(200 + i, edited(rows[i][1], rng, 1), rows[i][2], "s1") for i in range(10)]
    rows += [(300, "漢字" * 90, "aa", "s0"), (301, None, "aa", "s0"), (302, "", None, None), (303, rows[0][1] + " " + words(20, 777) + " " + words(20, 778), "bb", "s2"), (304, rows[4][1] + " " + words(20, 777), "bb", "s2")]
    return documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars"), rows


def test_stages_take_effect(spark, tmp_path):
    docs, rows = corpus(spark)
    sf = str(tmp_path)
    items = [(1, words(20, 777)), (2, words(20, 778))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    text = {r[0]: r[1] for r in rows}
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, sf)
    assert known.columns == docs.columns
    left = {r.doc_id for r in known.collect()}
    assert left == set(text) - {300, 301, 302}
    single = stages["near_dedup"](spark, known, sf)
    assert {r.doc_id for r in single.collect()} == {d for d, _, c in plain_components([(d, text[d]) for d in sorted(left)], 80) if d == c}
    clean = stages["decontamination"](spark, single, sf)
    assert clean.columns == docs.columns
    bad = {d for d, *_, c in plain_scan([(r.doc_id, r.text) for r in single.collect()], items) if c}
    assert bad == {303} and {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - bad
    assert decontaminate.scan(clean, spark.read.parquet(f"{sf}/benchmark.parquet")).where("n_hit > 0").count() == 0
    mixed = stages["mixing"](spark, clean, sf)
    assert mixed.columns == docs.columns
    want = {r.doc_id: r.taken for r in mixing.plan(clean).collect() if r.taken}
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert got == want
    out = corpus_pipeline.run(spark, sf)
    library, end = tokens.encoder(tokens.TOKENIZER), np.array([tokens.END_ID], "<u4").tobytes()
    rows_, start, want = sorted(((r.doc_id, r.text) for r in mixed.collect()), key=lambda r: (r[0], r[1].encode())), 0, []
    for doc, t in rows_:
        coded = library.whole(t) + end
        want.append((doc, start, len(coded) // 4, zlib.crc32(coded)))
        start += len(coded) // 4
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_stages_with_clashing_columns(spark, tmp_path):
    """The stages that keep the documents' columns do so whatever these are called."""
    _, rows = corpus(spark)
    docs = documents(spark, rows[:60])
    spark.createDataFrame([(1, words(20, 777))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, str(tmp_path))
        assert docs.schema.names == documents(spark, rows[:1]).schema.names, name
    assert docs.where("n = _gone and _gone = _key").count() == docs.count() > 0


def test_pipeline_leaves_its_result_only(spark, tmp_path):
    from nearfield.llm._shared import shared_dir

    docs, _ = corpus(spark)
    spark.createDataFrame([(1, words(20, 777))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before} == {"pipeline-token_files"} and out.count() > 0


def test_pipeline_on_nothing(spark, tmp_path):
    docs, _ = corpus(spark)
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
