"""Chi-square tails and quantiles of batches against the plain ones, and what a batch of quantiles costs."""

import math

import numpy as np
import pytest

from strandlake.functions import stats as S


@pytest.mark.parametrize("df", [1, 2, 3, 4, 7, 40, 41, 2.5])
def test_tails_and_quantiles(df):
    x = np.concatenate(([0.0, -1.0, np.nan, 1e-12, 1e-3, 1400.0, 1e6], np.linspace(0.01, 120, 200)))
    got, want = S.chi2_tails(x, np.full(len(x), df)), [math.nan if math.isnan(v) else S._upper_gamma(df / 2, v / 2) for v in x]
    assert np.allclose(got, want, rtol=1e-11, atol=1e-300, equal_nan=True)
    p = np.concatenate(([1e-300, 1e-100, 1e-9, 0.5, 1 - 1e-9, 1.0, 0.0, 1.5, np.nan], np.linspace(1e-4, 0.9999, 300)))
    q = S.chi2_quantiles(p, np.full(len(p), df))
    assert q[5] == 0 and np.isnan(q[6:9]).all()
    known = np.r_[0:5, 9 : len(p)]
    assert np.allclose(S.chi2_tails(q[known], np.full(len(known), df)), p[known], rtol=1e-10, atol=0)
    assert not len(S.chi2_quantiles(np.zeros(0), np.zeros(0)))


def test_few_tails_a_quantile(monkeypatch):
    """A batch asked for 60 tails of each row, whatever they were; now few steps reach the quantile."""
    asked, tails = [], S.chi2_tails
    monkeypatch.setattr(S, "chi2_tails", lambda x, df: asked.append(len(x)) or tails(x, df))
    p = np.linspace(1e-6, 1 - 1e-6, 10_000)
    for df in (1, 3):
        S.chi2_quantiles(p, np.full(len(p), df))
    assert sum(asked) < 2 * 10 * len(p)
