import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from nearfield.errors import FilterParseError
from nearfield.plans.compile import TypedFields, VariantFields, by_set_algebra, matching_ids, to_column
from nearfield.plans.filters import And, Compare, In, Like, Not, Or, parse, unparse

A, B, C = Compare("a", "=", 1), Compare("b", "=", 2), Compare("c", "=", 3)


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("a = 1 OR b = 2 AND c = 3", Or(A, And(B, C))),
        ("(a = 1 OR b = 2) AND c = 3", And(Or(A, B), C)),
        ("a = 1 and b = 2 And c = 3", And(And(A, B), C)),
        ("NOT a = 1 AND b = 2", And(Not(A), B)),
        ("not not a = 1", Not(Not(A))),
        ("x >= -2.5", Compare("x", ">=", -2.5)),
        ("x < 1.", Compare("x", "<", 1.0)),
        ("x != true", Compare("x", "!=", True)),
        ("x = 'it\\'s'", Compare("x", "=", "it\\'s")),
        ('x IN ("a", 1, 2.0, FALSE)', In("x", ("a", 1, 2.0, False))),
        ('größe% LIKE "%a%"', Like("größe%", "%a%")),
    ],
)
def test_parses(text, tree):
    assert parse(text) == tree


@pytest.mark.parametrize("text", ["", "  ", "a", "a =", "= 1", "a = b", "a = 1 b", "(a = 1", "a = 1)", "a LIKE", "a LIKE 3", "a IN ()", "a IN (1", "a NOT IN (1)", "and = 1", 'a = "x', "a ! 1", "a = 9223372036854775808", "a = 1 OR", "a # 1"])
def test_rejects(text):
    with pytest.raises(FilterParseError, match="filter parse error: "):
        parse(text)


fields = st.sampled_from(["s", "n", "b"])
literals = st.one_of(st.integers(-3, 3), st.sampled_from([0.5, 1.0, -2.0]), st.booleans(), st.sampled_from(["", "x", "xy", "yx"]))
leaves = st.one_of(
    st.builds(Compare, fields, st.sampled_from(["=", "!=", "<", ">", "<=", ">="]), literals),
    st.builds(In, fields, st.lists(literals, min_size=1, max_size=3).map(tuple)),
    st.builds(Like, fields, st.sampled_from(["x", "x%", "%x", "%x%", "%", "%%"])),
)
trees = st.recursive(leaves, lambda t: st.one_of(st.builds(And, t, t), st.builds(Or, t, t), st.builds(Not, t)), max_leaves=5)


@given(trees)
def test_text_and_back(tree):
    assert parse(unparse(tree)) == tree


ROWS = [(i, s, n, b) for i, (s, n, b) in enumerate((s, n, b) for s in (None, "x", "xy", "ayx") for n in (None, -2, 0, 1, 3) for b in (None, True, False))]


def naive(tree, row) -> bool:
    """The two-valued meaning of a filter on one row."""
    values = dict(zip(("s", "n", "b"), row[1:], strict=True))

    def kind(v):
        return "b" if isinstance(v, bool) else "n" if isinstance(v, int | float) else "s"

    def equal(f, v):
        return values[f] is not None and kind(v) == f and values[f] == v

    match tree:
        case And(a, b):
            return naive(a, row) and naive(b, row)
        case Or(a, b):
            return naive(a, row) or naive(b, row)
        case Not(a):
            return not naive(a, row)
        case Compare(f, "=", v):
            return equal(f, v)
        case Compare(f, "!=", v):
            return values[f] is not None and not equal(f, v)
        case Compare(f, op, v):
            bound = v if kind(v) == "n" else 0
            return f == "n" and values[f] is not None and {"<": values[f] < bound, ">": values[f] > bound, "<=": values[f] <= bound, ">=": values[f] >= bound}[op]
        case In(f, vs):
            return any(equal(f, v) for v in vs)
        case Like("s", p) if values["s"] is not None:
            s, inner = values["s"], p.strip("%")
            return {(False, False): s == p, (True, False): s.endswith(inner), (False, True): s.startswith(inner), (True, True): inner in s}[p.startswith("%"), p.endswith("%")]
    return False


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(trees)
def test_columns_mean_what_filters_say(spark, tree):
    typed = spark.createDataFrame(ROWS, "id long, s string, n long, b boolean")
    variant = typed.selectExpr("id", "parse_json(to_json(struct(s, n, b))) AS metadata")
    want = [r[0] for r in ROWS if naive(tree, r)]
    assert [r.id for r in matching_ids(typed, tree).collect()] == want
    assert sorted(r.id for r in variant.where(to_column(tree, VariantFields("metadata"))).collect()) == want


def test_set_algebra_agrees(spark):
    typed = spark.createDataFrame(ROWS, "id long, s string, n long, b boolean")
    for text in ("s = 'x' AND NOT n > 0", "NOT (b = true OR s LIKE '%x')", "n != 1 OR s IN ('xy')"):
        assert sorted(r.id for r in by_set_algebra(typed, parse(text)).collect()) == [r[0] for r in ROWS if naive(parse(text), r)]


def test_compat_quirks(spark):
    typed = spark.createDataFrame([("a%b",), ("cb",)], "id string").withColumnRenamed("id", "s").selectExpr("s AS id", "s")
    find = lambda text: [r.id for r in matching_ids(typed, parse(text), compat=True).collect()]
    assert find('s LIKE "%b"') == ["a%b"]
    assert find('s LIKE "%"') == ["a%b"]
    assert find('NOT s = "cb"') == ["cb"]


def test_variant_types_are_strict(spark):
    df = spark.sql("""SELECT id, parse_json(j) AS metadata FROM VALUES (1, '{"p": 12}'), (2, '{"p": "12"}'), (3, '{"p": true}'), (4, '{"p": [12]}'), (5, '{"p": null}'), (6, '{}'), (7, '{"p": 12.0}') t(id, j)""")
    find = lambda text: sorted(r.id for r in df.where(to_column(parse(text), VariantFields("metadata"))).collect())
    assert find("p = 12") == [1, 7]
    assert find('p = "12"') == [2]
    assert find("p = true") == [3]
    assert find("p != 12") == [2, 3]
    assert find("NOT p = 12") == [2, 3, 4, 5, 6]


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(ROWS, "id long, s string, n long, b boolean").write.parquet(path)
    df = spark.read.parquet(path)
    plan = df.where(to_column(parse("n > 0 AND s LIKE 'x%'"), TypedFields(df.schema)))._jdf.queryExecution().toString()
    assert "GreaterThan(n" in plan and "StringStartsWith(s,x)" in plan
