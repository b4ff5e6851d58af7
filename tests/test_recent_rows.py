"""SO6: the dashboard's previews are rows, the first five of each provider's lists."""

from pyspark.sql import functions as F

from agora.operators import listings
from agora.plans import catalog


def test_previews_are_the_first_rows_of_each_list(real_tables):
    assert "provider_recent_rows" in catalog.queries()
    got = listings.provider_recent_rows(real_tables, k=2)
    lists = {"reviews": listings.provider_reviews(real_tables), "promotions": listings.provider_promotions(real_tables)}
    for name, whole in lists.items():
        want = sorted((r.provider_id, r["rank"], r.id, r.title) for r in whole.where("rank <= 2").collect())
        assert want and sorted((r.provider_id, r["rank"], r.id, r.title) for r in got.where(F.col("list") == name).collect()) == want
    counts = {(r.provider_id, r.list): r.shown for r in listings.provider_recent_lists(real_tables, k=2).collect()}
    assert {(r.provider_id, r.list): r["count"] for r in got.groupBy("provider_id", "list").count().collect()} == counts
