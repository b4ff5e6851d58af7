"""Property test: the Spark lenient numeric cast equals an independent
scanner of PHP's leading-numeric-string rule on random inputs."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agora.functions import text as X

WS = " \t\n\r\x0b\x0c"


def php_prefix(s: str) -> float:
    """Scan: whitespace, sign, digits[.digits] or .digits, optional exponent
    (only when digits follow). No regular expression."""
    i, n = 0, len(s)
    while i < n and s[i] in WS:
        i += 1
    j = i
    if j < n and s[j] in "+-":
        j += 1
    d0 = j
    while j < n and s[j].isdigit() and s[j].isascii():
        j += 1
    int_digits = j - d0
    frac_digits = 0
    if j < n and s[j] == ".":
        k = j + 1
        while k < n and s[k].isdigit() and s[k].isascii():
            k += 1
        frac_digits = k - j - 1
        if int_digits or frac_digits:
            j = k
    if not (int_digits or frac_digits):
        return 0.0
    if j < n and s[j] in "eE":
        k = j + 1
        if k < n and s[k] in "+-":
            k += 1
        e0 = k
        while k < n and s[k].isdigit() and s[k].isascii():
            k += 1
        if k > e0:
            j = k
    try:
        return float(s[i:j])
    except (ValueError, OverflowError):
        return 0.0


ALPHABET = st.sampled_from(list("0123456789+-.eE x\t\n\x0b\x0cabc,"))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=12), min_size=300, max_size=300))
def test_php_float_matches_scanner(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(X.php_float(F.col("v"))).collect()]
    want = [php_prefix(v) for v in values]
    for v, g, w in zip(values, got, want):
        assert g == w or (g != g and w != w), (v, g, w)
