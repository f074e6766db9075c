"""Links of blocks against all pairs."""

import random

import numpy as np

from sievework.llm import blocks


def components(nodes, parts, pairs):
    """The sets of parts that the pairs of nodes join."""
    part, found = dict(zip(nodes, parts, strict=True)), {p: {p} for p in parts}
    for a, b in pairs:
        one = found[part[a]] | found[part[b]]
        found.update(dict.fromkeys(one, one))
    return {frozenset(x) for x in found.values()}


def test_links_are_fewer_than_rows():
    n = 60
    sets = [np.arange(100, dtype=np.uint64)] * n * 2
    nodes, seek = [*range(n), *range(n)], np.array([True] * n + [False] * n)
    found = blocks.compare(nodes, nodes, seek, sets, 80)
    assert len(found) == n - 1 and components(nodes, nodes, found) == {frozenset(range(n))}


def test_links_connect_what_all_pairs_do():
    r = random.Random(3)
    for _ in range(40):
        sets = [np.array(sorted(r.sample(range(24), r.randint(8, 20))), np.uint64) for _ in range(40)]
        parts = [100 + r.randrange(30) for _ in sets]
        seek = np.array([r.random() < 0.5 for _ in sets])
        like = lambda x, y: 100 * len(set(x) & set(y)) >= 70 * len(set(x) | set(y))
        pairs = {(i, j) for i in np.flatnonzero(seek).tolist() for j in np.flatnonzero(~seek).tolist() if parts[i] != parts[j] and like(sets[i].tolist(), sets[j].tolist())}
        found = blocks.compare(list(range(40)), parts, seek, sets, 70)
        assert set(found) <= pairs and len(found) < len(set(parts))
        assert components(range(40), parts, found) == components(range(40), parts, pairs)
