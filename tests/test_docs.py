"""Every registered query is documented in README.md and COVERAGE.md."""

import os
import re

import __spark_entry__ as E
from agora.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_query_is_documented():
    cov = open(os.path.join(ROOT, "COVERAGE.md")).read()
    readme = open(os.path.join(ROOT, "README.md")).read()
    names = set(re.findall(r"`([a-z_]+)`", cov))
    keys = set(catalog.queries())
    assert keys <= names, sorted(keys - names)
    assert all(k in readme for k in keys), sorted(k for k in keys if k not in readme)
