"""Quantiles behind the draws, against closed forms."""

import numpy as np
import pytest

from tallywise.operators import scorers


def test_quantiles_of_flat_and_steep_laws():
    q = np.linspace(0.0005, 0.9995, 400)
    one = np.ones(len(q))
    for k in (0.05, 0.25, 1.0, 30.0, 1e4):
        assert scorers._beta_quantiles(k * one, one, q) == pytest.approx(q ** (1 / k), abs=1e-8)
        assert scorers._beta_quantiles(one, k * one, q) == pytest.approx(-np.expm1(np.log1p(-q) / k), abs=1e-8)
    assert scorers._beta_quantiles(one / 2, one / 2, q) == pytest.approx(np.sin(np.pi * q / 2) ** 2, abs=1e-8)
