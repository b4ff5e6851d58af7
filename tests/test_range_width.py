"""A table kept by id ranges has a bounded number of folders, and a rewrite writes them once."""

import os

from agora.operators import commands
from agora.sources import sinks
from agora.sources.schemas import SERVICE_REQUESTS


def test_folders_do_not_follow_the_rows(spark, monkeypatch):
    assert sinks.range_width(spark.range(0), 512) == 512
    assert sinks.range_width(spark.range(0, 512 * 256), 512) == 512
    assert sinks.range_width(spark.range(0, 512 * 256 + 1), 512) == 1024
    for rows in (1_000_000, 6_000_000):
        width = sinks.range_width(spark.range(rows), 512)
        assert width % 512 == 0 and 128 <= rows / width <= 256
    assert sinks.range_width(spark.range(5, 10**9, 999_994), 512) == sinks.RANGE_IDS  # wide ranges: their number may grow
    assert sinks.range_width(spark.range(-300, 300), 1) == 4                           # ranges are cut at multiples
    monkeypatch.setattr(sinks, "MOST_RANGES", 4)
    assert sinks.range_width(spark.range(1, 101), 10) == 40


def test_rewrite_freezes_rows_without_folders(spark, real_tables, tmp_path, monkeypatch):
    path, frozen = f"{tmp_path}/requests", f"{tmp_path}/frozen"
    row = real_tables.service_requests.where("id = 11").drop("id")
    many = spark.range(0, 100).crossJoin(row).select(*SERVICE_REQUESTS.names)
    sinks.write_ranges(many, path, ids=10)
    monkeypatch.setattr(sinks, "scratch_path", lambda s, name: frozen)
    done = spark.createDataFrame([(5,), (42,)], "request_id long")
    sinks.rewrite_ranges(spark, SERVICE_REQUESTS, path, done, lambda r: commands.completed(r, done), ids=10)
    assert not [d for d in os.listdir(frozen) if d.startswith("id_range")]
    back = sinks.read_ranges(spark, SERVICE_REQUESTS, path)
    assert sorted(map(tuple, back.drop("status").collect())) == sorted(map(tuple, many.drop("status").collect()))
    assert sorted(r.id for r in back.where("status = 'completed'").collect()) == [5, 42]
