import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesforge.functions.kernels import KERNEL_LENGTHS, Kernel, KernelBank, make_kernels
from seriesforge.operators.transform import features, response


def brute(x, k):
    """PPV and MAX of one series by the definition."""
    n, out = len(x), []
    for i in range(-k.padding, n + k.padding - k.span):
        v = k.bias
        for j, w in enumerate(k.weights):
            at = i + j * k.dilation
            if 0 <= at < n:
                v = v + w * x[at]
        out.append(v)
    return sum(v > 0 for v in out) / len(out), max(out), len(out)


@settings(max_examples=40, deadline=None)
@given(st.integers(11, 90), st.integers(1, 12), st.integers(0, 2**31))
def test_bank_invariants(length, count, seed):
    bank = make_kernels(length, count, seed)
    assert bank == make_kernels(length, count, seed)
    for k in bank.kernels:
        assert k.length in KERNEL_LENGTHS and abs(sum(k.weights)) < 1e-9 and -1 < k.bias < 1
        assert k.dilation >= 1 and k.span <= length - 1 and k.padding in (0, k.span // 2)
        assert k.output_length(length) == (length if k.padding else length - k.span)


@settings(max_examples=30, deadline=None)
@given(st.integers(11, 60), st.integers(0, 2**31))
def test_features_equal_brute_force(length, seed):
    bank = make_kernels(length, 6, seed)
    x = np.random.default_rng(seed).normal(size=(3, length))
    f = features(x, bank)
    for i in range(3):
        for j, k in enumerate(bank.kernels):
            ppv, mx, n = brute(x[i], k)
            assert (f[i, 2 * j], f[i, 2 * j + 1]) == (ppv, mx) and n == k.output_length(length)


@pytest.mark.parametrize("padding", [0, 1])
@pytest.mark.parametrize("length", KERNEL_LENGTHS)
def test_edges(length, padding):
    w = np.arange(length, dtype=float)
    for dilation in (1, 15 // (length - 1)):
        k = Kernel(tuple(w - w.mean()), 0.25, dilation, padding * (length - 1) * dilation // 2)
        x = np.sin(np.arange(16.0))[None, :]
        ppv, mx, _ = brute(x[0], k)
        f = features(x, KernelBank(16, (k,)))
        assert f[0].tolist() == [ppv, mx]
    flat = response(np.full((1, 16), 3.0), Kernel(tuple(w - w.mean()), 0.25, 1, 0))
    assert np.allclose(flat, 0.25)


def test_short_series_and_wrong_length_are_refused():
    with pytest.raises(ValueError):
        make_kernels(10, 1, 0)
    with pytest.raises(ValueError):
        make_kernels(20, 0, 0)
    with pytest.raises(ValueError):
        features(np.zeros((1, 20)), make_kernels(21, 1, 0))
