import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n: int, seed: int = 0, pool: int = 400) -> str:
    """n words of a small invented vocabulary."""
    x, out = seed * 7919 + 17, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(f"w{(x >> 8) % pool:x}")
    return " ".join(out)


def documents(spark, rows, **extra):
    """Rows of (doc_id, text[, lang[, source]]) as a documents table, with columns that clash with those of operators."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for name in ("key", "id", "score", "component_id", "kept", "part", "size", "target", "n", "label", "_gone", "_key", "_copy", "_nf_of", "_nf_row", "_language_rejected", "line", "h1"):
        df = df.withColumn(name, df["n_chars"].cast("string"))
    return df


@pytest.fixture
def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows."""
    base = words(60, 3)
    rows = [(5, base), (2, base), (2, base), (9, None), (None, base), (None, None), (7, ""), (8, "   \n "), (11, words(30000, 5, 5000)), (12, "one two"), (13, "one two"), (14, "é ß 漢字 \U0001f600 x"), (15, base.upper()), (16, None, None, None)]
    return documents(spark, rows)
