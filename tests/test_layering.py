"""Further per-graph kernels against invariants."""

from hypothesis import given, settings
from hypothesis import strategies as st

from strata.operators import kernels as K
from strata.operators import layering as L
from strata.operators.arrangements import orthogonal_route

graphs = st.integers(1, 6).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.integers(1, 3)), max_size=9)))


@given(graphs)
@settings(deadline=None, max_examples=150)
def test_orientations_leave_no_cycle(g):
    n, es = g
    for kernel in (L.bfs_orientation, L.scc_orientation):
        K.longest_path(n, K._flow(es, kernel(n, es)))


@given(graphs)
@settings(deadline=None, max_examples=150)
def test_layers_follow_edges(g):
    n, es = g
    es = [(min(s, t), max(s, t), w) for s, t, w in es if s != t]
    start = K.longest_path(n, es)
    for got in (L.min_width(n, es, [1.0] * n), L.stretch_width(n, es, [1.0] * n), L.promote(start, es)):
        assert all(got[t] > got[s] for s, t, _ in es) and min(got) >= 0
    rows = [[a for a in range(n) if start[a] == k] for k in range(max(start) + 1)]
    x = L.aligned_placement(rows, es, [10.0] * n, 5.0)
    assert all(x[b] - x[a] >= 15 - 1e-9 for r in rows for a, b in zip(r, r[1:]))


def test_route_goes_around():
    route = orthogonal_route((0, 0, 10, 10), (100, 0, 10, 10), [(40, -20, 20, 60)])
    assert len(route) >= 4 and all(a[0] == b[0] or a[1] == b[1] for a, b in zip(route, route[1:]))
    assert not any(min(a[0], b[0]) < 60 and max(a[0], b[0]) > 40 and min(a[1], b[1]) < 40 and max(a[1], b[1]) > -20 for a, b in zip(route, route[1:]))
