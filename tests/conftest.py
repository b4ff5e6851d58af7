import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from agora.config import build_session

    s = build_session("local[*]", 8, app_name="agora-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def demo_tables(spark):
    from agora.sources.fixtures import tiny

    return tiny(spark)


@pytest.fixture(scope="session")
def real_tables(spark):
    from agora.sources.fixtures import tiny

    return tiny(spark, "@example.com")


def rows(df, *cols):
    """Collect a small result as sorted tuples (tests only)."""
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())
