import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meandra.functions import kernels as K


def brute_distance(m):
    z = np.argwhere(~m)
    return np.array([[np.hypot(*(z - [i, j]).T).min() if m[i, j] else 0.0 for j in range(m.shape[1])] for i in range(m.shape[0])])


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6))
def test_distance_transform_is_exact(seed):
    m = np.random.default_rng(seed).random((12, 17)) < 0.7
    m[0, 0] = False
    assert np.allclose(K.distance_transform(m), brute_distance(m))


def test_distance_without_land_is_infinite():
    assert np.isinf(K.distance_transform(np.ones((3, 3), bool))).all()


def test_thinning_of_a_strip_is_a_line():
    m = np.zeros((9, 40), bool)
    m[2:7, 2:38] = True
    t = K.thin(m)
    assert (t & ~m).sum() == 0 and t.any() and t[:, 10:30].sum(axis=0).max() == 1


def test_outline_of_a_block_has_its_perimeter():
    m = np.zeros((6, 6), bool)
    m[1:4, 2:5] = True
    assert len(K.outline_segments(m)) == 12


def test_savgol_keeps_cubics():
    t = np.linspace(-1, 1, 40)
    y = 1 + t - 2 * t**2 + t**3
    assert np.allclose(K.savgol(y, 11), y)
    assert np.array_equal(K.savgol(y[:5], 11), y[:5])


def test_alignment_of_a_curve_with_itself_costs_nothing():
    a = np.sin(np.arange(30.0))
    cost, path = K.align(a, a)
    assert cost == 0 and (path[:, 0] == path[:, 1]).all()


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=7), st.lists(st.floats(-5, 5), min_size=1, max_size=7))
def test_alignment_cost_equals_recursion(a, b):
    t = {(-1, -1): 0.0}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i, j] = abs(x - y) + min(t.get(k, np.inf) for k in ((i - 1, j - 1), (i - 1, j), (i, j - 1)))
    assert K.align(np.array(a), np.array(b))[0] == pytest.approx(t[len(a) - 1, len(b) - 1])


def test_simplify_keeps_corners_only():
    p = np.array([[0, 0], [1, 0.01], [2, 0], [2, 1], [2, 2]], float)
    assert K.simplify(p, 0.1).tolist() == [[0, 0], [2, 0], [2, 2]]


def test_hull_of_a_square_with_inner_points():
    p = np.array([[0, 0], [4, 0], [4, 4], [0, 4], [2, 2], [1, 3]], float)
    assert len(K.hull(p)) == 4


def test_linkage_parts_far_groups():
    p = np.array([[0, 0], [1, 0], [100, 0], [101, 0], [0, 1]], float)
    assert K.average_linkage(p, 10).tolist() == [0, 0, 1, 1, 0]


def test_histogram_minimum():
    r = np.random.default_rng(0)
    v = np.concatenate([r.normal(-0.6, 0.2, 50000), r.normal(0.3, 0.2, 50000)])
    assert -0.6 < K.lowest_negative_minimum(v) < 0
    assert K.lowest_negative_minimum(np.zeros(5)) is None
