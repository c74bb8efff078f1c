"""Shortest paths between pairs against a plain search."""

from __future__ import annotations

import random
from collections import deque

from chunkwright.operators import graph as G


def plain(near, start, end):
    """Distances from start, then back from end by the smallest predecessor."""
    dist, queue = {start: 0}, deque([start])
    while queue:
        u = queue.popleft()
        for v in near.get(u, ()):
            if v not in dist:
                dist[v] = dist[u] + 1
                queue.append(v)
    if end not in dist:
        return None
    path = [end]
    while path[0] != start:
        path.insert(0, min(u for u in near[path[0]] if dist.get(u) == dist[path[0]] - 1))
    return path


def test_paths_match_a_plain_search(spark):
    rng = random.Random(4)
    edges, pairs, near = [], [], {}
    for doc in range(12):
        n = rng.randint(2, 9) if doc < 3 else rng.randint(2, 30)
        links = [(i, i + 1) for i in range(n - 1)] if doc < 3 else [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * rng.choice([0.7, 1.2, 3])))]
        near[doc] = {}
        for a, b in links:
            edges.append((doc, a, b))
            if a != b:
                near[doc].setdefault(a, set()).add(b)
                near[doc].setdefault(b, set()).add(a)
        pairs += [(doc, rng.randrange(n), rng.randrange(n)) for _ in range(25)] + [(doc, 0, 0), (doc, 0, 500), (doc, 500, 500)]
    frame = spark.createDataFrame(edges, "doc_id long, src long, dst long")
    got = G.shortest_paths(frame, spark.createDataFrame(pairs, "doc_id long, from long, to long")).collect()
    assert len(got) == len(set(pairs))
    for r in got:
        want = [r["from"]] if r["from"] == r["to"] else plain(near[r["doc_id"]], r["from"], r["to"])
        assert r["path"] == want, r


def test_no_pairs_and_no_edges(spark):
    none = spark.createDataFrame([], "doc_id long, src long, dst long")
    some = spark.createDataFrame([(1, 2, 3), (1, 4, 4)], "doc_id long, from long, to long")
    assert sorted((r["from"], r["path"]) for r in G.shortest_paths(none, some).collect()) == [(2, None), (4, [4])]
    assert G.shortest_paths(none, some.limit(0)).count() == 0
