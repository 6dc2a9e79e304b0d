"""Invariants of trained models hold of right models, however little the readings tell."""

from functools import partial

from gustwatch.catalogue import model_checks
from gustwatch.operators import supervised
from gustwatch.operators.boosting import TreeSettings

DATA = "/root/testdata/sf0.001"


def test_horizon_learning_does_not_need_hours_that_the_readings_tell(spark, monkeypatch):
    """A model too small to learn its rows by heart: the hours of the test tables are chance, so its error stays near the mean's."""
    small = TreeSettings(rounds=12, depth=1)
    monkeypatch.setattr(supervised, "fit_horizon_model", partial(supervised.fit_horizon_model, settings=small))
    assert model_checks.horizon_invariants(spark, DATA).first()["learned"]


def test_a_constant_has_not_learned(spark, monkeypatch):
    still = TreeSettings(rounds=1, depth=1, min_gain=1e18)
    monkeypatch.setattr(supervised, "fit_horizon_model", partial(supervised.fit_horizon_model, settings=still))
    assert not model_checks.horizon_invariants(spark, DATA).first()["learned"]
