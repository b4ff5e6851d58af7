"""How often a settlement writes its commands."""

from agora.operators import settlement
from agora.sources.tables import load, load_batch

SF = "/root/testdata/sf0.001"


def test_settlement_writes_the_commands_twice(spark, monkeypatch):
    t = load(spark, SF)
    written = []
    plain = settlement.frozen
    monkeypatch.setattr(settlement, "frozen", lambda df, name: written.append(name) or plain(df, name))
    settlement.settle(t, load_batch(t, "accept_commands"))
    assert written == ["accepts", "settled"]
