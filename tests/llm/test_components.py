import numpy as np
import pytest

from sigmill.llm.components import Forest, connected_components


def brute(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


@pytest.mark.parametrize("seed", range(20))
def test_forest(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 60))
    pairs = rng.integers(0, n, (int(rng.integers(0, 2 * n)), 2))
    forest = Forest(n, most=7)
    for k in range(0, len(pairs), 5):
        forest.add(pairs[k : k + 5, 0], pairs[k : k + 5, 1])
    assert forest.roots().tolist() == brute(n, pairs.tolist())


def test_a_link_found_equal_first_is_not_lost():
    forest = Forest(4)
    forest.add(np.array([1, 2, 3]), np.array([2, 3, 0]))
    assert forest.roots().tolist() == [0, 0, 0, 0]


def test_components_of_chains_and_clusters(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (150, 2))] + [(k, k + 1) for k in range(1000, 1100)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = brute(1101, pairs)
    assert got == {n: want[n] for p in pairs if p[0] != p[1] for n in p}
