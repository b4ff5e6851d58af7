"""bench.py prints one JSON line in the driver's format."""

import json
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")
def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF, BENCH_CPUS="2", BENCH_QUERIES="scan_counts,category_sales")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=600, check=True).stdout.strip().splitlines()
    assert len(out) == 1
    d = json.loads(out[0])
    assert d["metric"] == "total_query_sec" and d["unit"] == "sec" and d["sf"] == 0.001
    assert set(d["queries"]) == {"scan_counts", "category_sales"}
    assert d["value"] == pytest.approx(d["prepare_sec"] + sum(d["queries"].values()), abs=0.01)
