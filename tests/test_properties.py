import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pointlens.operators import fps, pixels, topology
from pointlens.operators.geometry import hull

coordinate = st.integers(-40, 40).map(lambda x: x / 4)
clouds = st.lists(st.tuples(coordinate, coordinate), min_size=1, max_size=30).map(lambda p: np.array(p, float))


@settings(max_examples=80, deadline=None)
@given(clouds)
def test_insertion_distances_never_grow(points):
    order = fps.order_in_memory(points[:, 0], points[:, 1])
    assert sorted(order) == list(range(len(points)))
    near = [min(((points[i] - points[j]) ** 2).sum() for j in order[:k]) for k, i in enumerate(order) if k]
    assert all(a >= b for a, b in zip(near, near[1:]))


@settings(max_examples=80, deadline=None)
@given(clouds, st.floats(0.1, 8))
def test_thinning_is_separated_and_maximal(points, distance):
    kept = pixels.thin_in_memory(points[:, 0], points[:, 1], distance)
    gaps = np.sqrt(((points[:, None] - points[kept][None]) ** 2).sum(axis=2))
    assert all((np.delete(gaps[i], k) >= distance * (1 - 1e-9)).all() for k, i in enumerate(kept))
    assert all(gaps[i].min() < distance for i in range(len(points)) if i not in kept)


@settings(max_examples=60, deadline=None)
@given(clouds, clouds)
def test_distances_of_diagrams(a, b):
    h1a, h1b = topology.h1_pairs(a), topology.h1_pairs(b)
    assert topology.bottleneck(h1a, h1a) == topology.wasserstein(h1a, h1a) == 0
    assert topology.bottleneck(h1a, h1b) == topology.bottleneck(h1b, h1a) <= topology.wasserstein(h1a, h1b) + 1e-9
    assert abs(topology.wasserstein(h1a, h1b) - topology.wasserstein(h1b, h1a)) < 1e-9
    assert (h1a[:, 1] > h1a[:, 0]).all() and len(topology.h0_deaths(a)) == len(np.unique(a, axis=0)) - 1


@settings(max_examples=80, deadline=None)
@given(clouds)
def test_all_points_lie_in_the_hull(points):
    ring = hull([tuple(p) for p in points])
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 for x, y in points) or len(ring) < 3
