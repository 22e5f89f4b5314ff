import random

import pytest

from nestlake.operators import hierarchy as H


def brute(nodes, edges):
    """Walk up from every node in plain Python."""
    parent = {}
    for p, c in edges:
        if p is not None and c is not None:
            parent[c] = min(parent.get(c, p), p)
    kinds, paths = {}, {}
    for n in nodes:
        path, at = [n], n
        while True:
            up = parent.get(at)
            if up is None:
                kinds[n], paths[n] = "root", path[::-1]
                break
            if up not in nodes:
                kinds[n] = "orphan"
                break
            if up in path:
                kinds[n] = "cycle" if up == n else "below_cycle"
                break
            path.append(up)
            at = up
    return kinds, paths


def brute_general(nodes, edges):
    """Several parents: circles by mutual reach, shortest paths from roots by breadth-first search, all ancestor pairs."""
    links = {(p, c) for p, c in edges if p is not None and c is not None}
    inner = {(p, c) for p, c in links if p in nodes and c in nodes}
    down = {n: sorted(c for p, c in inner if p == n) for n in nodes}

    def reach(n):
        far, now, step = {}, {n}, 0
        while now:
            step += 1
            now = {c for x in now for c in down[x]} - set(far)
            far |= dict.fromkeys(now, step)
        return far

    far = {n: reach(n) for n in nodes}
    cycle = {n for n in nodes if n in far[n]}
    heads = [n for n in nodes if not any(c == n for _, c in links)], [n for n in nodes if any(c == n for _, c in links) and not any(c == n for _, c in inner)]
    paths, broken = {}, set()
    for group, bad in zip(heads, (False, True), strict=True):
        now = {n: [n] for n in group}
        while now:
            paths |= now
            broken |= set(now) if bad else set()
            after = {}
            for path in sorted(now.values()):
                for c in down[path[-1]]:
                    if c not in paths and c not in after:
                        after[c] = [*path, c]
            now = after
    pairs = {(a, d): k for a in paths for d, k in far[a].items() if d in paths and a != d}
    return paths, broken, cycle, pairs, links, {(p, c) for p, c in inner if p in far[c] or p == c}


@pytest.mark.parametrize("seed", [3, 4])
def test_several_parents(spark, seed):
    rng = random.Random(seed)
    nodes = set(range(1, 40))
    edges = [(rng.randrange(max(1, c - 9), c), c) for c in nodes if c > 3 for _ in range(rng.choice([1, 1, 2]))] + [(rng.randrange(20, 40), rng.randrange(10, 40)) for _ in range(4)]
    edges += [(1, 1), (99, 2), (99, 30), (5, 500), (5, 501), (3, 2), (None, 4)] + [(50, 51), (51, 52), (52, 50), (52, 53), (51, 50)]
    nodes |= {50, 51, 52, 53}
    f = H.build_forest(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "parent long, child long"))
    paths, broken, cycle, pairs, links, closing = brute_general(nodes, edges)
    assert {r.node: r.path for r in f.reached.collect()} == paths and {r.node for r in f.reached.where("broken").collect()} == broken
    assert {r.node: r.kind for r in f.circular.collect()} == {n: "cycle" if n in cycle else "below_cycle" for n in nodes if n in cycle or n not in paths}
    assert {(r.ancestor, r.descendant): r.distance for r in H.descendants(f).collect()} == pairs
    bad = {tuple(r) for r in H.bad_links(f).collect()}
    assert {x[:2] for x in bad if x[2] == "closes_circle"} == closing
    assert {x[:2] for x in bad if x[2] == "multi_parent"} == {(p, c) for p, c in links if c in nodes and sum(d == c for _, d in links) > 1}
    assert {x[:2] for x in bad if x[2].startswith("missing")} == {(p, c) for p, c in links if p not in nodes or c not in nodes}


def test_circle_beside_a_root(spark):
    f = H.build_forest(spark.createDataFrame([(n,) for n in range(1, 5)], "node long"), spark.createDataFrame([(1, 2), (3, 2), (2, 3), (1, 4), (3, 4)], "parent long, child long"))
    assert {r.node for r in f.circular.where("kind = 'cycle'").collect()} == {2, 3}
    assert (3, 4) in {(r.ancestor, r.descendant) for r in H.descendants(f).collect()}
    assert {(r.parent, r.child) for r in H.bad_links(f).where("problem = 'multi_parent'").collect()} == {(1, 2), (3, 2), (1, 4), (3, 4)}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_circles(spark, seed):
    rng = random.Random(seed)
    nodes = set(range(1, 120))
    edges = [(rng.randrange(1, 124), c) for c in nodes if rng.random() < 0.9] + [(5, 500), (None, 3), (4, None)]
    edges += [(200 + k, 201 + k) for k in range(40)]
    nodes |= set(range(200, 241))
    f = H.build_forest(spark.createDataFrame([(n,) for n in list(nodes) * 2], "node long"), spark.createDataFrame(edges * 2, "parent long, child long"))
    kinds, paths = brute(nodes, edges)
    reached = {r.node: r for r in f.reached.collect()}
    assert {n for n, k in kinds.items() if k in ("root", "orphan")} == set(reached)
    assert {n: r.path for n, r in reached.items() if not r.broken} == paths
    assert {r.node: r.kind for r in f.circular.collect()} == {n: k for n, k in kinds.items() if "cycle" in k}
    pairs = {(r.ancestor, r.descendant): r.distance for r in H.descendants(f).collect()}
    assert all(pairs[(p[i], n)] == len(p) - 1 - i for n, p in paths.items() for i in range(len(p) - 1))
    assert (5, 500, "missing_child") in {tuple(r) for r in H.bad_links(f).collect()}


def test_hot_parent_nulls_and_extra_columns(spark):
    links = [(1, c) for c in range(2, 2000)] + [(None, 1), (None, None)]
    f = H.build_forest(spark.createDataFrame([(n, "x") for n in range(1, 2000)] + [(None, "y"), (7, None)], "node long, root string"), spark.createDataFrame(links, "parent long, child long"))
    assert f.reached.count() == 1999 and f.reached.agg({"depth": "max"}).first()[0] == 2 and f.circular.count() == 0


def test_empty(spark):
    f = H.build_forest(spark.createDataFrame([], "node long"), spark.createDataFrame([], "parent long, child long"))
    assert f.reached.count() == f.circular.count() == H.descendants(f).count() == 0
