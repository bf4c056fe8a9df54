"""Registered training queries train as many rounds as their settings have."""

import pytest

from faultline.operators import boosting, scoring
from faultline.plans import oracles, queries


def test_second_order_query_trains_all_rounds_of_the_settings(spark, sf, monkeypatch):
    """The reference's settings have 300 rounds; the query trains them and its SQL asks for them."""
    class Asked(Exception):
        pass

    def asked(*_, params=boosting.WEIGHTED, **__):
        raise Asked(params)

    monkeypatch.setattr(scoring, "train_second_order_weighted", asked)
    with pytest.raises(Asked) as found:
        queries.train_second_order_weighted(spark, sf)
    assert found.value.args[0] == boosting.WEIGHTED and boosting.WEIGHTED.rounds == 300
    assert "CAST(300 AS BIGINT) AS trees" in oracles.ORACLES["train_second_order_weighted"]
