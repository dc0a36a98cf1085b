import pytest
from geoloom.functions.expression import ExpressionError, compile_expression
from geoloom.functions.predicate import condition
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, 2.5, "abc", None), (-7, 0.0, "", 3), (4, None, None, 4)], "a int, b double, s string, n int")


def value(df, text):
    names = {c: F.col(c) for c in df.columns}
    return [r[0] for r in df.select(compile_expression(text, names).alias("v")).collect()]


@pytest.mark.parametrize("text, want", [
    ("a + 1", [2, -6, 5]), ("a / b", [0.4, None, None]), ("a // 2", [0, -4, 2]), ("a % 3", [1, 2, 1]), ("-a ** 2", [-1.0, -49.0, -16.0]),
    ("round(b)", [2.0, 0.0, None]), ("n == None", [True, False, False]), ("n != 3", [True, False, True]), ("1 < a < 5", [False, False, True]),
    ("a in [1, 4]", [True, False, True]), ("'b' in s", [True, False, False]), ("a if b else 0", [1, 0, 0]), ("not n", [True, False, False]), ("min(a, n)", [None, -7, 4]),
    ("sqrt(a)", [1.0, None, 2.0]), ("int('3') + int(b)", [5, 3, None]), ("len(s)", [3, 0, None]), ("coalesce(n, a)", [1, 3, 4]), ("prop('s')", ["abc", "", None]),
    ("safe_div(a, b, -1)", [0.4, -1.0, None]), ("clip(a, 0, 2)", [1, 0, 2]), ("where(a > 0, 'x', 'y')", ["x", "y", "x"]), ("is_null(s) or a > 0", [True, False, True]),
])
def test_values(df, text, want):
    assert value(df, text) == want


@pytest.mark.parametrize("text", ["zzz + 1", "__import__('os')", "a.b", "f(1)", "a ** a", "a ** 101", "[x for x in a]", "1 +", "'x' * " + "1" * 1000, "lambda: 1"])
def test_refused(df, text):
    with pytest.raises(ExpressionError):
        value(df, text)


@pytest.mark.parametrize("where, want", [
    ({"s": "ABC"}, [1]), ({"a": {"gt": 0, "lt": 3}}, [1]), ({"n": {"ne": 3}}, [1, 4]), ({"n": {"eq": None}}, [1]), ({"n": {"not_in": [3]}}, [1, 4]), ({"s": {"is_null": True}}, [4]),
    ({"zz": {"exists": True}}, []), ({"zz": {"is_null": True}}, [1, -7, 4]), ({"not": {"zz": 1}}, [1, -7, 4]), ({"or": [{"a": 1}, {"a": 4}]}, [1, 4]), ({"and": [], "or": [{"a": 1}]}, [1, -7, 4]),
    ({"a": {"between": [-8, 2]}}, [1, -7]), ({"s": {"regex": "^A.C$"}}, [1]), ({}, [1, -7, 4]), ({"b": {"gte": 0}}, [1, -7]), ({"s": {"startswith": "A"}}, [1]),
])
def test_conditions(df, where, want):
    assert [r.a for r in df.where(condition(df, where)).collect()] == want


def test_condition_errors(df):
    with pytest.raises(ValueError):
        condition(df, {"a": {"near": 1}})
    with pytest.raises(ValueError):
        condition(df, {"a": {"in": 3}})
    assert df.where(condition(df, {"s": "ABC"}, case_sensitive=True)).count() == 0
