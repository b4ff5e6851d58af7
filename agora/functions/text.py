"""Form-input rules of the reference's PHP pages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters PHP's trim() strips by default, and the
# leading-numeric-string pattern PHP's (float)/(int) casts accept
# (SURVEY §2.11.13). Kept exactly as the reference's runtime defines them.
PHP_TRIM_CHARS = " \t\n\r\0\x0b"
PHP_NUMERIC_PREFIX = r"^[ \t\n\r\x0b\f]*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def php_trim(x) -> Column:
    """FN14: ``trim($v ?? '')`` — NULL (missing field) becomes ''."""
    return F.btrim(F.coalesce(_c(x), F.lit("")), F.lit(PHP_TRIM_CHARS))


def php_float(x) -> Column:
    """FN15: ``(float) $v`` — leading number kept, anything else 0."""
    num = F.regexp_extract(F.coalesce(_c(x), F.lit("")), PHP_NUMERIC_PREFIX, 1)
    return F.coalesce(F.when(num != "", num).try_cast("double"), F.lit(0.0))


def php_int(x) -> Column:
    """FN15: ``(int) $v`` — the leading number truncated toward zero."""
    return F.coalesce(php_float(x).try_cast("bigint"), F.lit(0).cast("bigint"))


def parse_date(x) -> Column:
    """A ``YYYY-MM-DD`` form date, NULL when it does not parse."""
    return F.try_to_date(php_trim(x), "yyyy-MM-dd")


# The database's text columns compare without case, accents and trailing spaces.
COLLATION = "UNICODE_CI_AI_RTRIM"


def compared(x) -> Column:
    """Text that is equal, grouped and joined as the database's collation has it.

    Comparing by a collation is dearer than comparing bytes: group by the plain
    text first, and by this over what is left."""
    return F.collate(_c(x), COLLATION)
