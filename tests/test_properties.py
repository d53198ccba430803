"""Property tests: guarded parsers and bands against plain-Python references."""

import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st


from churnkit import config as C
from churnkit.functions import band, to_float, to_int, to_int_via_float
from churnkit.functions.parse import DECIMAL_PATTERN, INTEGER_PATTERN

SETTINGS = settings(max_examples=25, deadline=None)

text = st.lists(
    st.one_of(
        st.none(),
        st.text(alphabet="0123456789+-.eE ,dfNaIity", max_size=8),
        st.floats(allow_nan=False, allow_infinity=False, width=32).map(repr),
        st.integers(-(2**40), 2**40).map(str),
        st.decimals(allow_nan=False, allow_infinity=False, places=3).map(str),
    ),
    min_size=1,
    max_size=40,
)


def py_float(s):
    if s is None or not re.match(DECIMAL_PATTERN, s):
        return None
    f = float(s.strip())
    return None if math.isinf(f) else f  # beyond the double range


def py_int_via_float(s):
    f = py_float(s)
    if f is None:
        return None
    t = math.trunc(f)
    return t if -(2**31) <= t < 2**31 else None


def py_int(s):
    if s is None or not re.match(INTEGER_PATTERN, s):
        return None
    v = int(s.strip())
    return v if -(2**31) <= v < 2**31 else None


def test_overflowing_decimal_text(spark):
    df = spark.createDataFrame([("1e999",), ("-1e999",)], "s string")
    rows = df.select(to_float("s"), to_int_via_float("s")).collect()
    assert rows == [(None, None), (None, None)]


@SETTINGS
@given(text)
def test_parsers_match_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    rows = df.select(to_float("s"), to_int_via_float("s"), to_int("s")).collect()
    for v, (f, i, j) in zip(values, rows):
        assert f == py_float(v)
        assert i == py_int_via_float(v)
        assert j == py_int(v)


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.floats(-1e7, 1e7, allow_nan=False)), min_size=1, max_size=40))
def test_balance_tiers_match_python(spark, values):
    def py_band(x):
        if x is not None:
            for limit, label in C.BALANCE_TIERS:
                if x < limit:
                    return label
        return C.BALANCE_TOP  # NULL matches no comparison

    df = spark.createDataFrame([(v,) for v in values], "b double")
    got = [r[0] for r in df.select(band("b", C.BALANCE_TIERS, C.BALANCE_TOP)).collect()]
    assert got == [py_band(v) for v in values]
